"""The pipeline's invariants: dry run equals run, replays change nothing, nothing partial from a bad row."""

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from loomgraph.errors import ConfigurationError, IllegalTransition, SourceError
from loomgraph.operators import admission, curation, validate
from loomgraph.operators.candidates import Attributes, Compose, Entity, Relation, Scoring
from loomgraph.operators.evidence import EvidenceStore, erase, link, row, row_evidence
from loomgraph.operators.ledger import LEGAL, Ledger, MemorySink, Profile, legal
from loomgraph.operators.normalize import Field
from loomgraph.operators.validate import Ontology
from loomgraph.plans.ingest import Pipeline, TableSync
from loomgraph.sources import records as R
from loomgraph.sources.store import Store

ROWS = [{"id": "p1", "name": "Ann", "team": "t1", "height_cm": "170"}, {"id": "p2", "name": "Bob", "team": "t1", "height_cm": "175"}, {"id": "p3", "name": "Cy", "team": "t2", "height_cm": "180"}]
SCHEMA = "id string, name string, team string, height_cm string"
FIELDS = [Field("id", required=True), Field("name"), Field("team"), Field("height_cm", "int")]
PLAYER, TEAM = Entity("league", "id", "Player", display_name="name"), Entity("league", "team", "Team")
BUILDER = Compose(PLAYER, Attributes(PLAYER, ("height_cm",)), Relation("PLAYS_FOR", PLAYER, TEAM))
ONTOLOGY = Ontology("1", frozenset({"Player", "Team"}), frozenset({"PLAYS_FOR"}), frozenset({"height_cm"}))
AT = datetime(2026, 7, 14, tzinfo=UTC)


def pipeline(spark, rows=ROWS, **options):
    return Pipeline("sports", R.from_rows(spark, rows, SCHEMA), BUILDER, Scoring(0.8), **({"fields": FIELDS, "ontology": ONTOLOGY, "run_id": "run-fixed", "clock": lambda: AT} | options))


def test_plan_run_and_replay(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))
    own = pipeline(spark)
    planned, report = own.plan(ledger)
    plan = sorted(map(str, planned.collect()))
    assert report.kind_counts == {"attribute_assertion": 3, "entity": 3, "relation": 3} and report.ledger_duplicates == 0
    assert report.coverage_ratio == 0.75 and {c["term"]: c["status"] for c in report.coverage}["Team"] == "unused"
    assert ledger.store.version() == 0
    first, ran = own.run(ledger)
    assert (ran.received, ran.duplicates, ran.succeeded) == (9, 0, True)
    assert sorted(map(str, own.plan()[0].collect())) == plan
    assert own.plan(ledger)[1].ledger_duplicates == 9
    _, again = own.run(ledger)
    assert (again.received, again.duplicates) == (0, 9)
    assert ledger.entries().count() == 9 and {r["state"] for r in ledger.entries().collect()} == {"RECEIVED"}
    heights = {r["semantic_key"]: r["value"] for r in planned.where("kind = 'attribute_assertion'").collect()}
    assert heights == {"player/league/p1/height_cm": "170", "player/league/p2/height_cm": "175", "player/league/p3/height_cm": "180"}


def test_records_of_one_partition_are_dealt_out(spark, monkeypatch):
    rows = [ROWS[0] | {"id": f"p{i % 9000}", "height_cm": "tall" if i % 7 == 0 else "170"} for i in range(10_000)]

    def ran(most):
        monkeypatch.setattr(R, "RECORDS_A_TASK", most, raising=False)
        own = pipeline(spark, rows)
        own.source = R.Records(own.source.frame.coalesce(1), "memory", "memory")
        planned, report = own.plan()
        held = own._held[0].groupBy(F.spark_partition_id()).count().collect()
        out = sorted(map(str, planned.collect())), report.fingerprint(), [r["count"] for r in held]
        own.release()
        return out

    whole, parts = ran(10_000), ran(1000)
    assert whole[:2] == parts[:2] and whole[2] == [10_000]
    assert sum(parts[2]) == 10_000 and max(parts[2]) < 5000


@pytest.mark.parametrize("kind", ["csv", "json"])
def test_records_of_a_file_are_dealt_out(spark, tmp_path, monkeypatch, kind):
    path = tmp_path / f"rows.{kind}"
    lines = [f"p{i % 900},Ann,t{i % 5},170" for i in range(1000)] if kind == "csv" else [f'{{"id": "p{i % 900}", "name": "Ann", "team": "t{i % 5}", "height_cm": 170, "more": [{i}]}}' for i in range(1000)]
    path.write_text("\n".join(["id,name,team,height_cm"] * (kind == "csv") + lines))

    def ran(most):
        monkeypatch.setattr(R, "RECORDS_A_TASK", most, raising=False)
        own = pipeline(spark)
        own.source = lambda: R.from_csv(spark, str(path)) if kind == "csv" else R.from_json(spark, str(path))
        planned, report = own.plan()
        parts = own._held[0].select(F.spark_partition_id()).distinct().count()
        out = sorted(map(str, planned.collect())), report.fingerprint(), parts
        own.release()
        return out

    whole, parts = ran(1000), ran(100)
    assert whole[:2] == parts[:2] and whole[1]["records_read"] == 1000 and parts[2] > whole[2] == 1


def test_bad_rows_give_nothing(spark):
    bad = [{"id": "", "name": "x", "team": "t", "height_cm": "1"}, {"id": "z", "name": "x", "team": "t", "height_cm": "tall"}, {"id": "y", "name": "x", "team": None, "height_cm": "1"}]
    own = pipeline(spark, [*bad, ROWS[0]])
    planned, report = own.plan()
    assert (report.records_read, report.records_valid, report.records_invalid, report.candidates_built) == (4, 1, 3, 3)
    assert not report.succeeded and planned.count() == 3
    reasons = {r["rec_idx"]: r["reasons"] for r in own.failures().collect()}
    assert "missing_required" in reasons[0][0] and "'tall'" in reasons[1][0] and reasons[2] == ["required_value: 'team' is null"]


def test_inverted_period_rejects_the_record(spark):
    rows = R.from_rows(spark, [{"id": "a", "x": "1", "f": "2026-02-01", "t": "2026-01-01"}, {"id": "b", "x": "1", "f": "2026-01-01", "t": None}], "id string, x string, f string, t string")
    who = Entity("n", "id", "Thing")
    own = Pipeline("g", rows, Compose(who, Attributes(who, ("x",), "f", "t")), Scoring(1.0), fields=[Field("id"), Field("x"), Field("f", "datetime"), Field("t", "datetime")])
    planned, report = own.plan()
    assert report.records_invalid == 1 and report.warnings == 3
    assert "thing/n/b/x@2026-01-01T00:00:00+00:00" in {r["semantic_key"] for r in planned.collect()}


def test_strict_and_permissive_ontology(spark):
    narrow = Ontology("1", frozenset({"Player"}), frozenset({"TRADED"}))
    assert pipeline(spark, ontology=narrow).plan()[1].candidates_rejected == 3
    report = pipeline(spark, ontology=narrow, strict=False).plan()[1]
    assert report.candidates_rejected == 0 and {c["term"]: c["status"] for c in report.coverage}["PLAYS_FOR"] == "unknown"


def test_disposition_is_the_sequential_rule(spark):
    import random

    draw = random.Random(3)
    rows = [(i, 0, draw.choice("abcd"), draw.random() < 0.4) for i in range(300)]
    seen, want = set(), {}
    for i, _, k, ok in rows:
        want[i] = "suppressed" if k in seen else "admitted" if ok else "rejected"
        if want[i] == "admitted":
            seen.add(k)
    frame = spark.createDataFrame(rows, "rec_idx long, pos int, semantic_key string, ok boolean")
    assert {r["rec_idx"]: r["disposition"] for r in admission.disposition(frame, F.col("ok")).collect()} == want
    counts = admission.disposition_counts(frame.withColumn("kind", F.col("semantic_key")), F.col("ok"))
    tally = {}
    for i, _, k, _ in rows:
        tally[k, want[i]] = tally.get((k, want[i]), 0) + 1
    assert {(r["kind"], r["disposition"]): r["n"] for r in counts.collect()} == tally


def test_unreadable_source_is_incomplete(spark, tmp_path):
    def broken():
        raise SourceError("gone")

    _, report = Pipeline("g", broken, PLAYER, Scoring(1.0)).run(Ledger(spark, str(tmp_path / "l")))
    assert report.incomplete and not report.succeeded and "gone" in report.failures[0]


def test_configuration_errors():
    with pytest.raises(ConfigurationError):
        Entity("n", "id")
    with pytest.raises(ConfigurationError):
        Attributes(PLAYER, ())
    with pytest.raises(ConfigurationError):
        Compose()
    with pytest.raises(ConfigurationError):
        Scoring(1.5)


def test_table_sync(spark):
    table = spark.createDataFrame([tuple(r.values()) for r in ROWS], SCHEMA)
    planned, report = TableSync("sports", table, ["id"], "db.players", BUILDER, Scoring(0.8), FIELDS, ONTOLOGY, version="v7").pipeline().plan()
    assert report.locator == "db.players@snapshot=v7" and {r["coord"]["fragment"] for r in planned.collect()} == {"id=p1", "id=p2", "id=p3"}


def test_random_ids_differ(spark):
    ids = [{r["candidate_id"] for r in pipeline(spark, random_ids=True).plan()[0].collect()} for _ in range(2)]
    assert len(ids[0]) == 9 and not ids[0] & ids[1]


def test_validators_merge_reasons(spark):
    own = pipeline(spark, [{"id": None, "name": "x", "team": "t", "height_cm": "x"}], validators=[validate.required_values(["id"])])
    reasons = own.failures().first()["reasons"]
    assert len(reasons) == len(set(reasons)) == 3


# ---------------------------------------------------------------- ledger and evidence


def test_lifecycle(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"), Profile(erasure=True))
    pipeline(spark).run(ledger)
    one, two = sorted(r["candidate_id"] for r in ledger.entries().collect())[:2]
    ledger.transition(one, "VALIDATED", "me")
    ledger.transition(one, "RETRYABLE_ERROR", "me", increment_retry=True, quarantine_reason="net")
    with pytest.raises(IllegalTransition):
        ledger.transition(one, "ACCEPTED", "me")
    row_ = ledger.rows().where(F.col("candidate_id") == one).first()
    assert (row_["state"], row_["retry_count"], row_["quarantine_reason"]) == ("RETRYABLE_ERROR", 1, "net")
    ledger.revoke(two, "wrong", "me")
    ledger.revoke(two, "again", "me")
    assert ledger.is_revoked(two) and ledger.entries().count() == 8
    with pytest.raises(KeyError):
        ledger.transition(two, "VALIDATED", "me")
    # the key is free again, but the id isn't
    _, report = pipeline(spark).run(ledger)
    assert (report.received, report.duplicates) == (0, 9) and pipeline(spark).plan(ledger)[1].ledger_duplicates == 9
    assert pipeline(spark, random_ids=True).run(ledger)[1].received == 1
    ledger.erase(one, "gdpr", "me")
    assert ledger.is_erased(one) and ledger.store.read("payloads").where(F.col("candidate_id") == one).isEmpty()
    asked = spark.createDataFrame([(two, "VALIDATED", "x")], "candidate_id string, to_state string, reason string")
    assert [tuple(r)[2] for r in ledger.transitions(asked, "me").collect()] == [False]
    assert [r["kind"] for r in ledger.audit().where(F.col("candidate_id") == two).collect()] == ["submit", "revoke", "revoke"]


def test_requests_for_one_id_are_judged_in_turn(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))
    pipeline(spark).run(ledger)
    one = ledger.entries().first()["candidate_id"]
    rows = [(one, "VALIDATED", 1), (one, "INVALID", 2), (one, "ACCEPTED", 3), ("cand_none", "VALIDATED", 4)]
    asked = spark.createDataFrame([(i, s, "x", n) for i, s, n in rows], "candidate_id string, to_state string, reason string, ord int")
    assert {r["ord"]: r["applied"] for r in ledger.transitions(asked, "me").collect()} == {1: True, 2: False, 3: True, 4: False}
    assert ledger.rows().where(F.col("candidate_id") == one).first()["state"] == "ACCEPTED"
    with pytest.raises(ValueError):
        ledger.transitions(asked.drop("ord"), "me")


def test_the_last_row_of_an_id_is_kept(spark, tmp_path):
    evidence = EvidenceStore(spark, str(tmp_path / "e"))
    for n, order in enumerate((("a", "b"), ("b", "a"))):
        rows = spark.createDataFrame([(f"ev{n}", v, i) for i, v in enumerate(order)], "e string, h string, ord long")
        rows = rows.select(*row("PRESENT", evidence_id=F.col("e"), payload_hash=F.col("h")), "ord")
        with pytest.raises(ValueError):
            evidence.put(rows.drop("ord"))
        evidence.put(rows, order="ord")
    assert {r["evidence_id"]: r["payload_hash"] for r in evidence.rows().collect()} == {"ev0": "b", "ev1": "a"}


def test_erasure_needs_the_profile(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))
    pipeline(spark).run(ledger)
    with pytest.raises(PermissionError):
        ledger.erase(ledger.entries().first()["candidate_id"], "x", "me")


def test_legal_table(spark):
    states = list(LEGAL)
    pairs = spark.createDataFrame([(a, b) for a in states for b in states], "a string, b string")
    got = {(r[0], r[1]) for r in pairs.where(legal(F.col("a"), F.col("b"))).collect()}
    assert got == {(a, b) for a, to in LEGAL.items() for b in to} and len(got) == 25


def test_reject_only(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"), Profile(reject_ambiguous=True))
    planned, _ = pipeline(spark).plan()
    got = {r["status"]: r["count"] for r in ledger.submit(planned, F.col("kind") == "relation").groupBy("status").count().collect()}
    assert got == {"RECEIVED": 6, "INVALID": 3}


@pytest.mark.parametrize("shared", [True, False])
def test_erasure_follows_citations(spark, tmp_path, shared):
    store = Store(spark, str(tmp_path / "s"), {})
    ledger = Ledger(spark, str(tmp_path / "l"), Profile(erasure=True), store=store if shared else None)
    evidence = EvidenceStore(spark, str(tmp_path / "e"), store=store if shared else None)
    pipeline(spark).run(ledger)
    one, two = sorted(r["candidate_id"] for r in ledger.entries().collect())[:2]
    rows = spark.createDataFrame([("ev1", "alone"), ("ev2", "both")], "e string, c string")
    rows = rows.select(*row("PRESENT", evidence_id=F.col("e"), content=F.col("c"), span=F.struct(F.lit(0).alias("start"), F.lit(3).alias("end"), F.col("c").alias("quote"))))
    refs = spark.createDataFrame([(one, "ev1", "SUPPORTS"), (one, "ev2", "SUPPORTS"), (one, "ev2", "DERIVED_FROM"), (two, "ev2", "SUPPORTS")], "subject_id string, evidence_id string, relationship string")
    evidence.put(rows, refs)
    evidence.cite(refs)
    assert evidence.refs().count() == 4
    report = erase(ledger, evidence, one, "gdpr", "me")
    assert (report["removed"], report["redacted"], report["preserved"]) == (["ev1", "ev2"], ["ev1"], ["ev2"])
    assert erase(ledger, evidence, one, "gdpr", "me")["already_erased"]
    kept = {r["evidence_id"]: r for r in evidence.rows().collect()}
    assert kept["ev1"]["content"] is None and kept["ev1"]["span"]["quote"] is None and kept["ev1"]["span"]["end"] == 3 and kept["ev1"]["payload_hash"].startswith("sha256:")
    assert kept["ev2"]["content"] == "both" and evidence.redaction("ev1")[1] == "gdpr"
    assert "redact" in {r["kind"] for r in ledger.audit().collect()}
    evidence.put(rows)  # a redacted row stays redacted
    assert evidence.rows().where("evidence_id = 'ev1' and content is not null").isEmpty()
    assert evidence.resolve(spark.createDataFrame([(two,)], "subject_id string")).count() == 1


def test_dangling_citations_raise(spark, tmp_path):
    from loomgraph.errors import EvidenceMissing

    evidence = EvidenceStore(spark, str(tmp_path / "e"))
    evidence.cite(spark.createDataFrame([("s", "none", "SUPPORTS")], "subject_id string, evidence_id string, relationship string"))
    with pytest.raises(EvidenceMissing):
        evidence.resolve(spark.createDataFrame([("s",)], "subject_id string"))


def test_row_evidence_links(spark):
    rows = R.from_rows(spark, ROWS, SCHEMA)
    made = row_evidence(rows.frame, "snap_1", "table", "db", AT)
    planned, _ = pipeline(spark).plan()
    assert link(planned, made).count() == 9 and made.select("evidence_id").distinct().count() == 3


def test_pipeline_into_a_sink_in_memory(spark):
    sink = MemorySink(spark)
    assert sink.entries() is None
    first, report = pipeline(spark).run(sink)
    again, second = pipeline(spark).run(sink)
    assert (report.received, report.duplicates, second.received, second.duplicates) == (9, 0, 0, 9) and {r["status"] for r in again.collect()} == {"DUPLICATE"}
    kept = sink.entries("sports", ["RECEIVED"]).collect()
    assert [(r["rec_idx"], r["pos"]) for r in kept] == sorted((r["rec_idx"], r["pos"]) for r in kept) and len(kept) == 9
    assert all(r["received_at"] == r["created_at"] for r in kept) and sink.entries("other").count() == 0 and sink.entries(in_states=["ACCEPTED"]).count() == 0
    assert {r["status"] for r in first.collect()} == {"RECEIVED"}


def test_batches_change_no_outcome(spark):
    """What a sink receives doesn't depend on how the candidates are dealt to batches."""
    rows = [(f"c{i}", "g", f"k{i % 4}", i, 0, "t", AT) for i in range(12)]
    frame = spark.createDataFrame(rows, "candidate_id string, graph_id string, semantic_key string, rec_idx long, pos int, trace_id string, created_at timestamp")
    seen = set()
    for size in (5, 12):
        sink = MemorySink(spark)
        for low in range(0, 12, size):
            sink.submit(frame.where((F.col("rec_idx") >= low) & (F.col("rec_idx") < low + size)))
        seen.add(tuple(r["candidate_id"] for r in sink.entries().collect()))
    assert seen == {("c0", "c1", "c2", "c3")}


def test_plans_come_back_from_lines(spark):
    odd = 'a "b" \n\u00e9\u2028'
    rows = [("p1", ["c", odd], "7", [("ATTACH_ASSERTION", '{"v": 1.0, "n": null}'), (None, odd)], [("cluster_version", "i", "17")], [], "1"), ("p2", ["c", None], "", [], [], ["e"], "")]
    plans = spark.createDataFrame(rows, curation.PLAN)
    assert sorted(map(str, curation.from_lines(curation.to_lines(plans)).drop("why_not").collect())) == sorted(map(str, plans.collect()))
    none = spark.createDataFrame([("p3", [], "7", [], [], [], "1"), (None, ["c"], "7", [], [], [], "1")], curation.PLAN)
    assert [(r["line"], r["why_not"] is None) for r in curation.to_lines(none).collect()] == [(None, False)] * 2
    lines = spark.createDataFrame([("{",), ("[1]",), ('{"plan_id": "x"}',), (None,)], "line string")
    assert all(r["why_not"] for r in curation.from_lines(lines).collect())


def test_counts_of_dispositions_agree_with_dispositions_where_places_are_shared(spark):
    """Rows that share a place and a key are all admitted there, ok or not; what is neither ok nor not is refused."""
    rows = [(1, 0, "a", True), (1, 0, "a", True), (1, 0, "a", False), (0, 0, "a", None), (2, 0, "a", True), (3, 0, "b", None), (3, 1, "b", False), (4, 0, "c", True), (5, 0, "c", None)]
    frame = spark.createDataFrame([("k", *r) for r in rows], "kind string, rec_idx long, pos int, semantic_key string, ok boolean")
    said = admission.disposition(frame, F.col("ok")).groupBy("kind", "disposition").count()
    counts = sorted(tuple(r) for r in admission.disposition_counts(frame, F.col("ok")).collect())
    assert counts == sorted(tuple(r) for r in said.collect()) == [("k", "admitted", 4), ("k", "rejected", 3), ("k", "suppressed", 2)]
