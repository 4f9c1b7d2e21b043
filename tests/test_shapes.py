"""Each shape rule on rows that keep it and rows that break it."""

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import shapes

KG1, KG2 = "kg://g/identity/" + "1" * 26, "kg://g2/identity/" + "2" * 26
REF = "array<struct<entity_type:string,namespace:string,key:string>>"
SCORE = "scores struct<extraction_confidence:double,source_reliability:double,identity_confidence:double,assertion_confidence:double,corroboration_score:double,policy_risk:double>"
CASES = {
    "scores": (lambda: shapes.scores(), SCORE, [((1.0, 0.5, None, None, None, 0.0),)], [((1.0, None, None, None, None, 0.0),), ((1.1, 0.5, None, None, None, 0.0),), ((1.0, 0.5, -0.1, None, None, 0.0),), ((1.0, 0.5, None, None, float("nan"), 0.0),)]),
    "representation": (lambda: shapes.representation(), "kind string, text string, vector array<float>", [("text", "a", None), ("vector", None, [1.0])], [("text", "a", [1.0]), ("vector", "a", None), ("other", "a", None)]),
    "aliases": (lambda: shapes.aliases(), f"entity_type string, aliases {REF}", [("T", [("T", "n", "k")])], [("T", []), ("T", [("U", "n", "k")])]),
    "relation": (lambda: shapes.relation(), "relation_type string, subject string, object string", [("PLAYS_FOR", "T:n:k", KG1)], [("plays", "T:n:k", KG1), ("P\n", "T:n:k", KG1), ("P", "T:k", KG1), ("P", KG1, "x")]),
    "period": (lambda: shapes.period("a", "b"), "a int, b int", [(1, 1), (None, 1), (1, None)], [(2, 1)]),
    "span": (lambda: shapes.span(), "start int, end int", [(0, 0), (1, 5)], [(-1, 2), (3, 2)]),
    "artifact": (lambda: shapes.artifact(), "artifact_type string, artifact_hash string, source_uri string", [("a", "b", "c")], [("a", None, "c"), (" ", "b", "c")]),
    "observation": (lambda: shapes.observation(), "metric string", [("m",)], [(None,)]),
    "derived": (lambda: shapes.derived_assertion(), "derivation string", [("d",)], [(None,)]),
    "plan": (lambda: shapes.plan(), "objective string", [("o",)], [(None,)]),
    "ontology": (lambda: shapes.ontology_term(), "term_kind string, term string", [("attribute", "t")], [("verb", "t"), ("attribute", None)]),
    "link candidate": (lambda: shapes.link_candidate(), "left string, right string, kind string", [("a", "a", "SAME_AS")], [("", "b", "SAME_AS"), ("a", None, "SAME_AS"), ("a", "b", "LIKE")]),
    "link": (lambda: shapes.identity_link(), "left_identity string, right_identity string, kind string, authority string", [(KG1, KG2, "RELATED_TO", "me")], [(KG1, KG1, "SAME_AS", "me"), ("x", KG2, "SAME_AS", "me"), (KG1, "y", "SAME_AS", "me"), (KG1, KG2, "SAME_AS", None)]),
    "conflict": (lambda: shapes.conflict_record(), "assertion_ids array<string>, preferred_assertion_id string, status string", [(["a", "b"], "a", "RESOLVED"), (["a", "b"], None, "UNRESOLVED")], [(["a"], None, "UNRESOLVED"), (["a", "b"], None, "RESOLVED"), (["a", "b"], "a", "UNRESOLVED"), (["a", "b"], "c", "RESOLVED")]),
    "decision": (lambda: shapes.decision(), "valid boolean, failure_kind string", [(True, None), (False, "BAD_DATA")], [(True, "BAD_DATA"), (False, None)]),
    "resolution": (lambda: shapes.resolution(), "score_vector map<string,double>", [({"a": 1.0},)], [({},)]),
    "review": (lambda: shapes.review_decision(), "action string, edited_payload string", [("EDIT", "{}"), ("APPROVE", None)], [("EDIT", None)]),
    "commit": (lambda: shapes.commit(), "committed boolean, epoch long, error string, failed array<string>", [(True, 1, None, []), (False, None, "e", []), (False, None, None, ["p"])], [(True, None, None, []), (False, None, None, [])]),
    "recommendation": (lambda: shapes.recommendation(), "action string, graph_name string, factor_scores map<string,double>, reasons array<string>", [("extend", "g", {"tenancy": 0.5}, ["r"]), ("create", None, {}, ["r"])], [("extend", None, {}, ["r"]), ("create", None, {"x": 0.5}, ["r"]), ("create", None, {"tenancy": 2.0}, ["r"]), ("create", None, {}, [])]),
    "version": (lambda: shapes.version_change(), "from_version string, to_version string, compatibility string", [(None, "1", shapes.COMPATIBLE), ("1", "2", "REQUIRES_RE_EXTRACTION")], [(None, "1", "REQUIRES_RE_EXTRACTION"), ("", "1", shapes.COMPATIBLE), ("1", "", shapes.COMPATIBLE), ("1", "2", "MAYBE")]),
    "arm": (lambda: shapes.arm(), "attempted int, abstained int, failed int", [(10, 5, 5), (None, 5, 5)], [(10, 6, 5)]),
}


@pytest.mark.parametrize("name", CASES)
def test_shape(spark, name):
    rule, schema, good, bad = CASES[name]
    verdicts = [r[0] for r in spark.createDataFrame([*good, *bad], schema).coalesce(1).select(rule()).collect()]
    assert verdicts[: len(good)] == [None] * len(good) and all(verdicts[len(good) :]), verdicts


def test_first_violation_speaks(spark):
    frame = spark.range(1).select(F.lit(2).alias("a"), F.lit(1).alias("b"))
    assert frame.select(shapes.any_of([shapes.period("b", "a"), shapes.period("a", "b")])).first()[0] == "a is after b"
