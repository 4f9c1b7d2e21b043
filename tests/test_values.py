"""Strict casts, text, identifiers and policy against plain Python."""

import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from loomgraph.errors import ConfigurationError
from loomgraph.functions import identity, policy, text
from loomgraph.operators.normalize import Field, check_fields, normalize
from loomgraph.sources import records as R

RAW = ["42", " 42 ", "-7", "+7", "4.0", "4.5", "1e3", "", "  ", "tall", "nan", "Inf", "true", "YES", "n", "0", "2", "9223372036854775808", "2026-07-14", "2026-07-14T10:00:00+02:00", "12:00", "2026", None]


def _python(kind, raw):
    """What a cast gives for text: (value, failed)."""
    t = raw.strip()
    try:
        if kind == "int":
            v = int(t)
            return (v, False) if -(2**63) <= v < 2**63 else (None, True)
        if kind == "float":
            return float(t), False
        if kind == "bool":
            v = t.casefold()
            return (True, False) if v in text.TRUE_WORDS else (False, False) if v in text.FALSE_WORDS else (None, True)
        return t, False
    except ValueError:
        return None, True


@pytest.mark.parametrize("kind", ["str", "int", "float", "bool"])
def test_casts_of_text(spark, kind):
    rows = R.from_rows(spark, [{"x": r} for r in RAW], "x string")
    got = normalize(rows.frame, [Field("x", kind, required=True)]).orderBy("rec_idx").collect()
    for raw, row in zip(RAW, got, strict=True):
        codes = [i["code"] for i in row["issues"]]
        if raw is None or not raw.strip():
            assert codes == ["missing_required"] and row["values"]["x"] is None
            continue
        value, failed = _python(kind, raw)
        assert (codes == ["coercion_failed"]) == failed, (raw, codes)
        assert row["values"]["x"] == value or value != value


def test_casts_of_variants(spark):
    rows = spark.createDataFrame([(0, '{"x": 1, "b": true}'), (1, '{"x": "1", "b": 1}'), (2, '{"x": 1.0, "b": "no"}'), (3, '{"x": 1.5, "b": 2}'), (4, '{"x": true, "b": 1.0}'), (5, '{"x": [1], "b": null}'), (6, '{" X ": 7}')], "rec_idx long, j string")
    frame = rows.select("rec_idx", R.coordinates("json", "m", F.lit("f")).alias("coord"), F.parse_json("j").cast("map<string,variant>").alias("data"), R.issues_of().alias("issues"))
    got = normalize(frame, [Field("x", "int"), Field("b", "bool")]).orderBy("rec_idx").select("values.*", F.transform("issues", lambda i: i["field"]).alias("bad")).collect()
    assert [(r["x"], r["b"], r["bad"]) for r in got] == [(1, True, []), (1, True, []), (1, False, []), (None, None, ["x", "b"]), (None, None, ["x", "b"]), (None, None, ["x"]), (7, None, [])]


def test_typed_columns_are_not_rounded(spark):
    rows = R.from_rows(spark, [{"a": 42.0, "t": True}, {"a": 42.5, "t": False}], "a double, t boolean")
    got = normalize(rows.frame, [Field("a", "int"), Field("t", "str")]).orderBy("rec_idx").collect()
    assert [r["values"]["a"] for r in got] == [42, None]
    assert [[i["code"] for i in r["issues"]] for r in got] == [["coercion_failed"], ["coercion_failed", "coercion_failed"]]


def test_times(spark):
    raw = ["2026-07-14", "2026-07-14T10:00:00", "2026-07-14 10:00:00.5+02:00", "2026-07-14T10:00:00Z", "2026", "12:00", "14.7.2026"]
    rows = R.from_rows(spark, [{"t": r} for r in raw], "t string")
    got = normalize(rows.frame, [Field("t", "datetime")]).orderBy("rec_idx").select(text.iso(F.col("values.t")).alias("t"), F.transform("issues", lambda i: i["code"]).alias("c")).collect()
    assert [r["t"] for r in got] == ["2026-07-14T00:00:00+00:00", "2026-07-14T10:00:00+00:00", "2026-07-14T08:00:00.500000+00:00", "2026-07-14T10:00:00+00:00", None, None, None]
    assert [r["c"] for r in got] == [["assumed_utc"], ["assumed_utc"], [], [], ["coercion_failed"], ["coercion_failed"], ["coercion_failed"]]


def test_aliases_extras_defaults_and_conflicts(spark):
    rows = R.from_rows(spark, [{"Player_ID ": "7", "other": "x", "note": None}], "`Player_ID ` string, other string, note string")
    got = normalize(rows.frame, [Field("id", "int", aliases=("player_id",)), Field("gone", "str", default="d")]).first()
    assert (got["values"]["id"], got["values"]["gone"], got["extras"]) == (7, "d", {"other": "x", "note": None})
    with pytest.raises(ConfigurationError):
        check_fields([Field("a", aliases=("x",)), Field("b", aliases=(" X",))])


def test_float_text_is_pythons(spark):
    values = [0.0, 1.0, 42.5, 1e16, 1e-5, 123456789.0, 1e-4, 0.001, 3.0e7, -2.5, 1e22, float("inf"), float("-inf"), float("nan"), 9999999.5]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(text.float_text(F.col("v"))).collect()
    assert [r[0] for r in got] == [repr(v) for v in values]


def test_strip_is_pythons(spark):
    values = [" a ", "\t\na ", " x ", "", " \x1c\x1f ", "a b"]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(text.strip(F.col("v"))).collect()
    assert [r[0] for r in got] == [v.strip() for v in values]


def test_stable_suffix(spark):
    parts = ["sports", "entity", "player/league/p1"]
    number = int.from_bytes(hashlib.blake2b("\0".join(parts).encode(), digest_size=16).digest(), "big")
    want = "".join(identity.CROCKFORD[(number >> (5 * i)) & 31] for i in reversed(range(26)))
    assert identity.suffix_of(*parts) == want
    assert spark.range(1).select(identity.candidate_id(*(F.lit(p) for p in parts))).first()[0] == "cand_" + want
    assert identity.suffix_of("ab", "c") != identity.suffix_of("a", "bc")


def test_references(spark):
    got = spark.createDataFrame([("Player:league:a:b",), ("Player:x",), ("player:league:a",), ("Player:League:a",), ("Player:league: ",), (None,)], "s string").select(identity.parse(F.col("s")).alias("p")).collect()
    assert got[0]["p"]["ref"]["key"] == "a:b" and got[0]["p"]["error"] is None
    assert all(r["p"]["ref"] is None and r["p"]["error"] for r in got[1:])


def _route(scores, disposition, p):
    """The policy in plain Python."""
    e, r, i, k = scores
    risk = 2 if k > p.human_risk else 1 if k > p.auto_risk else 0
    if not p.needs_identity:
        ok = True
    elif disposition == policy.UNRESOLVED:
        ok = False
    elif disposition == policy.NEW:
        ok = p.auto_for_new and (i is None or i >= p.auto_identity)
    else:
        ok = i is not None and i >= p.auto_identity
    own = 0 if e >= p.auto_extraction and r >= p.auto_reliability and ok else 1 if e >= p.assess_extraction else 2
    return policy.ROUTES[max(risk, own)]


@pytest.mark.parametrize("p", [policy.Policy(), policy.Policy(auto_for_new=False), policy.Policy(needs_identity=False)])
def test_routes(spark, p):
    cases = list(itertools.product([0.79, 0.8, 0.95, 1.0], [0.89, 0.9], [None, 0.94, 0.95], [0.0, 0.2, 0.21, 0.5, 0.51], [policy.RESOLVED, policy.NEW, policy.UNRESOLVED]))
    frame = spark.createDataFrame(cases, "e double, r double, i double, k double, d string")
    scores = F.struct(F.col("e").alias("extraction_confidence"), F.col("r").alias("source_reliability"), F.col("i").alias("identity_confidence"), F.col("k").alias("policy_risk"))
    got = frame.select("*", policy.route(p, scores, F.col("d")).alias("route")).collect()
    assert all(x["route"] == _route((x["e"], x["r"], x["i"], x["k"]), x["d"], p) for x in got) and len(got) == len(cases)


def test_policy_thresholds_are_ordered():
    with pytest.raises(ConfigurationError):
        policy.Policy(auto_extraction=0.5)
    with pytest.raises(ConfigurationError):
        policy.Policy(human_risk=1.5)


def test_narrow_and_decimal_numbers(spark):
    frame = spark.sql("select cast(1.5 as float) f, cast(3 as smallint) s, cast(4 as tinyint) t, cast(7 as decimal(10,0)) d, cast(2.50 as decimal(10,2)) e, cast(9 as decimal(30,2)) g, cast(1 as tinyint) b")
    for column, want in (("f", (None, 1.5, "1.5")), ("s", (3, 3.0, "3")), ("t", (4, 4.0, "4")), ("d", (7, 7.0, "7")), ("e", (None, 2.5, "2.50")), ("g", (9, 9.0, "9.00")), ("b", (1, 1.0, "1"))):
        kind = frame.schema[column].dataType.simpleString()
        got = frame.select(*(cast(F.col(column), kind)[0] for cast in (text.to_integer, text.to_float, text.to_text))).first()
        assert tuple(got) == want, column
        why = frame.select(text.to_integer(F.col(column), kind)[1]).first()[0]
        assert (why is None) == (want[0] is not None)
    assert frame.select(text.to_boolean(F.col("b"), "tinyint")[0]).first()[0] is True
