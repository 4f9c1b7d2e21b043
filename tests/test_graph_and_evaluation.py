"""Curation reads, registry, review, extraction and grading against direct statements of their rules."""

import itertools
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomgraph.errors import CapabilityError, Conflict
from loomgraph.operators import chunking, completions, evaluation, graph, registry
from loomgraph.operators.candidates import Entity, Scoring
from loomgraph.operators.evidence import EvidenceStore
from loomgraph.operators.graph import Graph, Operation, ReadOptions
from loomgraph.operators.ledger import Ledger
from loomgraph.operators.normalize import Field
from loomgraph.plans.extraction import DocumentPipeline, Extractor

AT = datetime(2026, 7, 14, tzinfo=UTC)


def kg(n):
    return f"kg://g/identity/{n:026d}"


def asr(n):
    return f"as_{n:026d}"


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "identity_id string")


def fact(n, subject, **more):
    return Operation("ATTACH_ASSERTION", {"assertion_id": asr(n), "subject_identity": subject, "predicate": "p", "recorded_at": AT, "source_candidate_ids": [], "evidence_refs": [], **({"object_value": "1"} | more)})


def test_visibility_table(spark):
    entities = spark.createDataFrame([("live", "ACTIVE"), ("gone", "REVOKED")], "identity_id string, status string")
    facts = spark.createDataFrame([(s, t, 1) for s in ("live", "gone", "unknown") for t in ("ACTIVE", "SUPERSEDED", "REVOKED")], "subject_identity string, status string, curation_epoch long")

    def seen(**options):
        return {(r[0], r[1]) for r in graph.read_assertions(facts, entities, ReadOptions(**options)).select("subject_identity", "status").collect()}

    known = ("live", "unknown")
    assert seen() == {(s, "ACTIVE") for s in known}
    assert seen(include_superseded=True) == {(s, t) for s in known for t in ("ACTIVE", "SUPERSEDED")}
    assert seen(include_revoked=True) == {(s, t) for s in (*known, "gone") for t in ("ACTIVE", "REVOKED")}
    assert len(seen(include_revoked=True, include_superseded=True)) == 9
    assert seen(epoch=0) == set()


def test_batches(spark, tmp_path):
    g = Graph(spark, str(tmp_path / "g"))
    one, two = kg(1), kg(2)
    create = Operation("CREATE_IDENTITY", {"identity_id": one, "entity_type": "T", "aliases": [("T", "n", "k")], "created_at": AT})
    assert g.apply([create, fact(1, one), Operation("REVOKE_IDENTITY", {"identity_id": one})])["epoch"] == 1
    assert g.entities().isEmpty() and g.entities(options=ReadOptions(include_revoked=True)).first()["touches"] == 3
    assert g.assertions(ids(spark, one)).isEmpty() and g.assertions(ids(spark, one), ReadOptions(include_revoked=True)).count() == 1
    for bad in ([Operation("REVOKE_IDENTITY", {"identity_id": one})], [Operation("RESTORE_IDENTITY", {"identity_id": two})], [fact(1, two)], [fact(5, two), fact(5, two)], [Operation("REVOKE_IDENTITY", {"identity_id": 5})]):
        result = g.apply(bad)
        assert not result["committed"] and result["error"] and g.current_epoch() == 1
    assert g.apply([Operation("RESTORE_IDENTITY", {"identity_id": one})], {one: "2"})["failed"] == [one]
    assert g.apply([Operation("RESTORE_IDENTITY", {"identity_id": one})], {one: "3"})["committed"]
    row = g.entities().first()
    assert (row["status"], row["curation_epoch"], row["touches"]) == ("ACTIVE", 1, 4)
    with pytest.raises(NotImplementedError):
        g.apply([Operation("MERGE_IDENTITIES", {})])
    asked = spark.createDataFrame([("T", "n", "k")], "entity_type string, namespace string, key string")
    assert g.find(asked).first()["identity_id"] == one
    g.mark_superseded(asr(1), AT + timedelta(days=1), asr(2))
    assert g.assertions(ids(spark, one)).isEmpty()
    early = ReadOptions(transaction_at=AT + timedelta(hours=1), include_superseded=True)
    late = ReadOptions(transaction_at=AT + timedelta(days=2), include_superseded=True)
    assert g.assertions(ids(spark, one), early).count() == 1 and g.assertions(ids(spark, one), late).isEmpty()
    with pytest.raises(KeyError):
        g.mark_superseded(asr(9), AT)
    with pytest.raises(CapabilityError):
        Graph(spark, str(tmp_path / "g"), temporal=False).assertions(options=ReadOptions(valid_at=AT)).count()


def test_periods(spark):
    day = timedelta(days=1)
    frame = spark.createDataFrame([(None, None), (AT, None), (None, AT), (AT - day, AT)], "valid_from timestamp, valid_to timestamp")
    count = lambda t: frame.where(graph.valid_at(F.lit(t))).count()
    assert [count(AT - 2 * day), count(AT - day), count(AT), count(AT + day)] == [2, 3, 4, 2]


def test_neighborhood_is_the_walk(spark):
    draw = random.Random(5)
    nodes = [f"n{i}" for i in range(30)]
    edges = [(draw.choice(nodes), draw.choice(nodes)) for _ in range(70)]
    live = set(draw.sample(nodes, 22))
    want = set()
    for origin in ("n0", "n1", "ghost"):
        seen, front = {origin}, [origin]
        for hop in (1, 2, 3):
            step = {b for a, b in edges if a in front} - seen
            seen |= step
            front = [x for x in step if x in live]
            want |= {(origin, x, hop) for x in front}
    frame = spark.createDataFrame(edges, "src string, dst string")
    got = graph.neighborhood(frame, ids(spark, *live), ids(spark, "n0", "n1", "ghost"), 3)
    assert {tuple(r) for r in got.collect()} == want


def test_malformed_assertions(spark):
    schema = "subject_identity string, object_value string, object_identity string, status string, superseded_at timestamp, superseded_by string, source_candidate_ids array<string>, valid_from timestamp, valid_to timestamp"
    good = (kg(1), "1", None, "ACTIVE", None, None, ["a"], None, None)
    change = lambda **k: tuple(k.get(n.split()[0], v) for n, v in zip(schema.replace(">", "").split(", "), good, strict=True))
    rows = [good, change(object_value=None), change(object_identity=kg(2)), change(subject_identity="x"), change(superseded_by=asr(1)), change(source_candidate_ids=["a", "a"]), change(valid_from=AT, valid_to=AT - timedelta(days=1))]
    got = [r[0] is None for r in spark.createDataFrame(rows, schema).coalesce(1).select(graph.malformed_assertion()).collect()]
    assert got == [True] + [False] * 6


# ---------------------------------------------------------------- registry


def test_registry(spark, tmp_path):
    now = [AT]
    r = registry.Registry(spark, str(tmp_path / "r"), lambda: now[0])
    assert r.latest_version("a") is None and r.register("a", node_types=["X"]) == 1 and r.register("a", node_types=["X", "Y"], backend_ref="age") == 2 and r.register("b") == 1
    assert [(x["name"], x["version"]) for x in r.snapshot().collect()] == [("a", 2), ("b", 1)]
    assert r.get("a", 1)["node_types"] == ["X"] and r.attributes_for("a") == {"backend.open_id": "age"} and r.get("zz") is None
    key = r.record_decision("{}", registry.EXTEND, "me", "why", "a")
    assert r.record_decision("{}", registry.EXTEND, "me", "why", "a", key) == key
    with pytest.raises(Conflict):
        r.record_decision("{}", registry.ISOLATED, "me", "why", "a", key)
    r.record_outcome(key, "good")
    r.record_outcome(key, "bad", "later")
    assert r.decisions("a").first()["outcome_label"] == "bad" and r.decisions("b").isEmpty()
    with pytest.raises(KeyError):
        r.record_outcome("dec_none", "x")


def _profile(**k):
    names = [n.split()[0] for n in registry.PROFILE.split(", ")]
    return tuple(({"profile_id": "p", "node_types": ["A", "B"], "edge_types": [], "attribute_types": []} | k).get(n) for n in names)


def test_advice(spark):
    graphs = [("g", ["A", "B"], [], {"identity_authority": "crm", "tenancy_class": "t", "is_computed_output": "false"}), ("other", ["Z"], [], {})]
    frame = spark.createDataFrame(graphs, "name string, node_types array<string>, edge_types array<string>, attributes map<string,string>")
    cases = {
        registry.EXTEND: _profile(identity_authority="crm", tenancy_class="t", is_computed_output=False),
        registry.SHARED: _profile(identity_authority="crm", tenancy_class="t", contains_minors_data=True),
        registry.IDENTITY: _profile(identity_authority="crm", node_types=["Q"]),
        registry.ISOLATED: _profile(identity_authority="erp", node_types=["Q"]),
        registry.UNKNOWN: _profile(),
    }
    for outcome, row in cases.items():
        got = registry.advise(spark.createDataFrame([row], registry.PROFILE), frame).first()
        assert got["outcome"] == outcome, (outcome, got)
        assert got["action"] == {registry.EXTEND: "extend", registry.SHARED: "extend", registry.UNKNOWN: None}.get(outcome, "create")
    empty = registry.advise(spark.createDataFrame([cases[registry.EXTEND]], registry.PROFILE), frame.where("false")).first()
    assert (empty["outcome"], empty["action"], empty["target"]) == (registry.ISOLATED, "create", None)


def test_ties_prefer_the_smallest_name_but_the_longer_of_prefixes(spark):
    frame = spark.createDataFrame([("a",), ("ab",), ("b",)], "n string")
    assert [r[0] for r in frame.orderBy(registry.tie_key(F.col("n"))).collect()] == ["ab", "a", "b"]


def test_review_queue(spark, tmp_path):
    q = registry.ReviewQueue(spark, str(tmp_path / "q"))
    rows = lambda *names: spark.createDataFrame([(n, "k", "{}", "P3", "r") for n in names], "item_id string, kind string, payload string, priority string, reason string").coalesce(1)
    q.enqueue(rows("a", "b", "c"))
    q.enqueue(rows("d", "a"))
    assert [r["item_id"] for r in q.pending().collect()] == ["a", "b", "c", "d"] and q.pending(2).count() == 2
    q.resolve("b", "APPROVE", "me")
    with pytest.raises(ValueError):
        q.resolve("a", "EDIT", "me")
    with pytest.raises(KeyError):
        q.resolve("zz", "APPROVE", "me")
    q.resolve("b", "REJECT", "me")
    assert [r["item_id"] for r in q.pending().collect()] == ["a", "c", "d"] and [r["action"] for r in q.history("b").collect()] == ["APPROVE", "REJECT"]


# ---------------------------------------------------------------- extraction


def test_chunkers_keep_offsets(spark):
    texts = ["", " \n\n a b \n\n\n\nc\n", "x" * 25, "one\n\ntwo", "é😀\n\n ü "]
    docs = chunking.documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for frame in (chunking.whole(docs), chunking.paragraphs(docs), chunking.fixed_windows(docs, 10, 3)):
        for r in frame.collect():
            assert texts[int(r["doc_id"])][r["start"] : r["end"]] == r["text"] and r["fragment"] == f"chunk:{r['index']}@chars:{r['start']}-{r['end']}"
    assert chunking.whole(docs).count() == 5
    want = [(str(i), p.strip()) for i, t in enumerate(texts) for p in t.split("\n\n") if p.strip()]
    assert sorted((r["doc_id"], r["text"]) for r in chunking.paragraphs(docs).collect()) == sorted(want)
    assert [r["end"] for r in chunking.fixed_windows(docs, 10, 3).where("doc_id = '2'").orderBy("index").collect()] == [10, 17, 24, 25]
    with pytest.raises(ValueError):
        chunking.fixed_windows(docs, 5, 5)


def test_documents_without_ids_and_with_one_id(spark):
    docs = chunking.documents(spark.createDataFrame([("a", "one"), ("a", "two"), (None, "three"), ("b", "four")], "doc_id string, text string"))
    own = DocumentPipeline("g", docs, chunking.whole, [Extractor("e", "{text}", [Field("name")], Entity("x", "name", "Word"), Scoring(0.7))], lambda a: completions.fixed(a, "[]"), deterministic=True)
    assert sorted((str(r["doc_id"]), r["text"]) for r in own.chunks().collect()) == [("None", "three"), ("a", "one"), ("a", "two"), ("b", "four")]
    failing = DocumentPipeline("g", docs, chunking.whole, own.extractors, lambda a: completions.fixed(a, "nonsense"), deterministic=True)
    report = failing.plan()[1]
    assert report.failure_count == failing.failed.count() == len(report.failures) == 4 and any("doc=NULL" in f for f in report.failures)
    failing.release()


def test_quotes_in_texts(spark):
    texts = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "concatenate"), (3, None), (4, "")], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, "cat"), (2, "cat sat"), (3, "e cat sat on the m"), (4, "dog"), (5, None), (6, "")], "item_id long, quote string")
    want = {(1, 1, 4), (2, 1, 3), (1, 2, 4), (1, 3, 2)}
    assert {tuple(r) for r in completions.quoted(texts, quotes).collect()} == want


def test_parsing(spark):
    cases = [
        ('[{"a":1}]', None, 1), ('{"items":[{"a":1},{"b":2}]}', None, 2), ('{"items":[]}', None, 0), ("nope", "valid JSON", None), ("5", "array or an object", None), ('{"x":1}', "carry items", None), ('{"items":5}', "must be an array", None),
        ("[1]", "must be an object", None), ('[{"confidence":true}]', "must be a number", None), ('[{"confidence":1.5}]', "[0, 1]", None), ('[{"extraction_confidence":"0.5"}]', "must be a number", None),
    ]
    frame = spark.createDataFrame([(i, r, "text", 0, None) for i, (r, _, _) in enumerate(cases)], "i int, response string, text string, start int, error string")
    for (_, error, count), r in zip(cases, completions.parse(frame).orderBy("i").collect(), strict=True):
        assert (error is None) == (r["error"] is None) and (error is None or error in r["error"]), r
        assert (r["items"] is None) == (count is None) and (count is None or len(r["items"]) == count)


def test_quotes_take_successive_places(spark):
    response = '[{"quote":"aa","confidence":0.5,"extraction_confidence":0.1},{"quote":"aa"},{"quote":"aa"},{"quote":"aa"},{"quote":"zz"},{"quote":""},{"quote":5},{"n":1}]'
    r = completions.parse(spark.createDataFrame([(response, "aaaa", 100, None)], "response string, text string, start int, error string")).first()["items"]
    assert [x["quote_start"] for x in r] == [100, 101, 102, 100, None, None, None, None]
    assert [len(x["warnings"]) for x in r] == [0, 0, 0, 0, 1, 1, 1, 0]
    assert r[0]["confidence"] == 0.5 and set(r[0]["values"]) == {"extraction_confidence"} and set(r[7]["values"]) == {"n"}


def test_document_pipeline(spark, tmp_path):
    docs = chunking.documents(spark.createDataFrame([("d1", "Ann plays.\n\nBob plays. Bob plays."), ("d2", "Ann plays.")], "doc_id string, text string"))

    def call(prompt, system):
        if prompt.startswith("Broken"):
            raise ValueError("boom")
        name = "Ann" if "Ann" in prompt else "Bob"
        return f'[{{"name":"{name}","confidence":0.9,"quote":"{name} plays"}},{{"name":"{name}"}}]'

    own = [Extractor("players", "Find: {text}", [Field("name")], Entity("x", "name", "Player"), Scoring(0.7)), Extractor("broken", "Broken {text}", [Field("name")], Entity("x", "name", "Player"), Scoring(0.7))]
    make = lambda answer, **k: DocumentPipeline("g", docs, chunking.paragraphs, own, answer, artifacts=True, run_id="r", clock=lambda: AT, **k)
    live = make(lambda asked: completions.complete(asked, call))
    planned, report, warnings = live.plan()
    assert report.kind_counts == {"artifact": 2, "entity": 2} and (report.candidates_built, report.candidates_suppressed, report.records_read) == (6, 4, 3)
    assert len(report.failures) == 3 and all("extractor=broken" in f and "boom" in f for f in report.failures) and report.incomplete
    assert [r["code"] for r in warnings.collect()] == ["nondeterministic_plan"]
    score = {r["semantic_key"]: (r["scores"]["extraction_confidence"], len(r["evidence_refs"])) for r in planned.collect()}
    assert score == {"player/x/Ann": (0.9, 2), "player/x/Bob": (0.9, 2), "artifact/source_document/d1": (1.0, 1), "artifact/source_document/d2": (1.0, 1)}
    # what was recorded replays to the same plan
    asked = completions.requests(live.chunks(), own[0].template)
    tape = completions.recording(completions.complete(asked, call)).persist()
    replayed = make(lambda a: completions.replay(a, tape, strict=False), deterministic=True)
    again, second, quiet = replayed.plan()
    assert sorted(map(str, again.collect())) == sorted(map(str, planned.collect())) and quiet.isEmpty()
    ledger, evidence = Ledger(spark, str(tmp_path / "l")), EvidenceStore(spark, str(tmp_path / "e"))
    _, ran, _ = replayed.run(ledger, evidence)
    assert ran.received == 4 and evidence.rows().count() == 6 and evidence.refs().count() == 6
    subjects = ledger.entries().select(F.col("candidate_id").alias("subject_id"))
    assert evidence.resolve(subjects).count() == 6
    with pytest.raises(completions.ReplayMiss):
        completions.replay(completions.requests(live.chunks(), "other {text}"), tape).count()


# ---------------------------------------------------------------- evaluation


def test_matching_is_one_to_one(spark):
    gold = spark.createDataFrame([("entity", k, i) for i, k in enumerate("abc")], "category string, match_key string, gold_idx int")
    made = spark.createDataFrame([("x", "entity", k, i) for i, k in enumerate("aabzz")] + [("y", "entity", "c", 0)], "arm_id string, category string, match_key string, ord long")
    arms = spark.createDataFrame([("x",), ("y",), ("none",)], "arm_id string")
    match = evaluation.matched(made, gold)
    assert sorted((r["arm_id"], r["ord"]) for r in match.where("hit").collect()) == [("x", 0), ("x", 2), ("y", 0)]
    got = {(r["arm_id"], r["category"]): r for r in evaluation.prf(match, gold, arms).collect()}
    x = got["x", "entity"]
    assert (x["tp"], x["fp"], x["fn"], x["precision"], x["recall"]) == (2, 3, 1, 0.4, pytest.approx(2 / 3)) and x["f1"] == pytest.approx(0.5)
    none = got["none", "entity"]
    assert none["precision"] is None and none["recall"] == 0.0 and none["f1"] is None and none["precision_note"] == "no entity candidates produced"
    assert got["x", "relation"]["recall"] is None
    assert evaluation.gold_hits(match, gold, arms).count() == 9


def test_values_compare_across_types(spark):
    frame = spark.createDataFrame([("200",), ('"200"',), ('{"b": 1, "a": 2}',), ('{"a":2,"b":1}',)], "v string")
    got = [r[0] for r in frame.select(evaluation.norm_json(F.col("v"))).collect()]
    assert got[0] == got[1] == "200" and got[2] == got[3]


def _interval(values, config):
    """The seeded bootstrap in plain Python."""
    draw = random.Random(config.seed)
    n = len(values)
    means = sorted(sum(values[draw.randrange(n)] for _ in range(n)) / n for _ in range(config.resamples))
    tail = (1 - config.level) / 2

    def at(p):
        rank = p * (len(means) - 1)
        low = int(rank)
        return means[low] * (1 - (rank - low)) + means[min(low + 1, len(means) - 1)] * (rank - low)

    return at(tail), at(1 - tail)


def test_bootstrap(spark):
    config = evaluation.Bootstrap(seed=7, resamples=200)
    values = [float(i % 3 == 0) for i in range(40)]
    frame = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)] + [("few", i, 1.0) for i in range(3)], "g string, item int, v double")
    got = {r["g"]: r for r in evaluation.bootstrap_exact(frame, config, ["g"], "item", "v").collect()}
    assert (got["a"]["lower"], got["a"]["upper"]) == pytest.approx(_interval(values, config)) and got["few"]["lower"] is None and got["few"]["n_items"] == 3
    near = {r["g"]: r for r in evaluation.bootstrap(frame, config, ["g"], "v").collect()}
    assert near["a"]["lower"] == pytest.approx(got["a"]["lower"], abs=0.08) and near["a"]["upper"] == pytest.approx(got["a"]["upper"], abs=0.08) and near["few"]["upper"] is None


def test_scorecard_and_ablation(spark):
    n = 20
    gold = spark.createDataFrame([("entity", f"T\u001fk{i}", i, "doc" if i < 4 else None, "q" if i < 2 else None, 0 if i < 3 else None, 10 if i < 3 else None) for i in range(n)], "category string, match_key string, gold_idx int, source_locator string, quote string, start int, end int")
    entity = lambda arm, i, key, refs: (arm, i, "entity", "T", key, refs)
    support, derive = [("e1", "SUPPORTS")], [("e1", "DERIVED_FROM")]
    rows = [entity("base", i, f"k{i}", derive) for i in range(4)] + [entity("good", i, f"k{i}", support) for i in range(18)]
    rows += [entity("wild", i, f"k{i}", support) for i in range(18)] + [entity("wild", 50 + i, f"z{i}", [("lost", "SUPPORTS")]) for i in range(3)]
    made = spark.createDataFrame(rows, "arm_id string, ord long, kind string, entity_type string, semantic_key string, evidence_refs array<struct<evidence_id:string,relationship:string>>")
    made = made.withColumns({c: F.lit(None).cast("string") for c in ("relation_type", "subject", "object", "attribute", "value")})
    have = spark.createDataFrame([(a, "e1", "PRESENT", "doc", "has q", (5, 8)) for a in ("base", "good", "wild")], "arm_id string, evidence_id string, availability string, source_locator string, content string, span struct<start:int,end:int>")
    arms = spark.createDataFrame([("base", 10, 2, 1, 1.0, None), ("good", 10, 0, 0, 1.0, 2.0), ("wild", None, 0, 0, None, None)], "arm_id string, attempted int, abstained int, failed int, cost_usd double, latency_seconds double")
    cards = evaluation.scorecard(made, gold, have, arms).persist()
    got = {r["arm_id"]: r for r in cards.collect()}
    assert got["base"]["entity_recall"] == 0.2 and got["base"]["abstention_rate"] == 0.2 and got["wild"]["failure_rate"] is None
    assert (got["base"]["ungrounded"], got["base"]["unverified"], got["good"]["unverified"], got["wild"]["ungrounded"]) == (0, 4, 0, 3)
    assert (got["base"]["checked"], got["base"]["covered"], got["base"]["with_offsets"], got["base"]["overlapping"]) == (4, 4, 3, 3)
    assert got["wild"]["resolvable_rate"] == pytest.approx(18 / 21) and got["wild"]["hallucinations"] == 3 and got["base"]["ontology_violations"] is None
    hits = evaluation.gold_hits(evaluation.matched(evaluation.keyed(made), gold), gold, arms)
    config = evaluation.Bootstrap(seed=1, resamples=200)
    verdict = lambda a, b, m="entity.recall", c=config: evaluation.compare(cards, hits, a, b, m, c).first()["verdict"]
    assert verdict("base", "good") == "IMPROVEMENT" and verdict("good", "base") == "REGRESSION" and verdict("good", "good") == "NO_IMPROVEMENT"
    assert verdict("base", "wild") == "NO_IMPROVEMENT"
    assert verdict("base", "good", "entity.precision") == verdict("base", "good", "relation.recall") == verdict("base", "good", c=evaluation.Bootstrap(1, 10, min_items=99)) == "INSUFFICIENT_EVIDENCE"
    assert "insufficient" in evaluation.render_markdown(cards) and '"arm_id": "base"' in evaluation.render_json(cards)
    providers = evaluation.Providers()
    providers.register("extraction", evaluation.flat_metrics)
    with pytest.raises(ValueError):
        providers.register("extraction", evaluation.flat_metrics)
    flat = {(r["arm_id"], r["metric"]): r["value"] for r in providers.evaluate(cards).collect()}
    assert flat["base", "extraction.entity.recall"] == 0.2 and len(flat) == 3 * 13


def test_gold_files(spark, tmp_path):
    path = tmp_path / "gold.json"
    path.write_text('{"gold_set_id":"s","attempted":3,"entities":[{"entity_type":"T","semantic_key":"k","evidence":{"source_locator":"d","quote":"q","start":1,"end":2}}],"attributes":[{"subject":"T:n:k","attribute":"h","value":200}]}')
    items = {r["category"]: r for r in evaluation.gold_from_json(spark, str(path)).collect()}
    assert items["entity"]["match_key"] == "T\u001fk" and items["entity"]["end"] == 2 and items["attribute"]["match_key"] == "T:n:k\u001fh\u001f200"
    gold = evaluation.gold_from_json(spark, str(path))
    assert evaluation.repeated_gold(gold).isEmpty() and not evaluation.repeated_gold(gold.unionByName(gold)).isEmpty() and len(evaluation.gold_hash(gold)) == 64


# ---------------------------------------------------------------- streams


def test_stream_is_admitted_once(spark, tmp_path):
    from loomgraph.plans.ingest import Pipeline
    from loomgraph.streaming import ingest as streaming

    folder = tmp_path / "in"
    for part in range(2):
        spark.createDataFrame([(f"p{i}",) for i in range(part, part + 3)], "id string").coalesce(1).write.mode("append").parquet(str(folder))
    ledger = Ledger(spark, str(tmp_path / "l"))
    own = Pipeline("g", None, Entity("n", "id", "Thing"), Scoring(1.0), fields=[Field("id")])
    reports = []
    for _ in range(2):  # the second run starts over and finds everything known
        query = streaming.ingest(streaming.read_files(spark, str(folder), "id string").withColumn("id", F.col("id")), own, ledger, str(tmp_path / f"c{len(reports)}"), on_report=lambda _, r: reports.append(r), available_now=True)
        query.awaitTermination()
    assert ledger.entries().count() == 4 and sum(r.received for r in reports) == 4


def test_routes_cover_all_pairs():
    from loomgraph.functions.policy import INVERSE

    assert all(INVERSE.get(b) in (a, "RESTORE_IDENTITY") for a, b in INVERSE.items()) and "PROMOTE" not in INVERSE
    assert list(itertools.islice(INVERSE, 1)) == ["CREATE_IDENTITY"]


def test_windowed_counts(spark, tmp_path):
    from loomgraph.streaming import ingest as streaming

    rows = [(AT + timedelta(minutes=m), k) for m, k in ((0, "a"), (1, "a"), (4, "b"), (6, "a"), (7, "b"))]
    spark.createDataFrame(rows, "ts timestamp, kind string").write.parquet(str(tmp_path / "e"))
    counts = streaming.windowed_counts(streaming.read_files(spark, str(tmp_path / "e"), "ts timestamp, kind string"), "ts", "kind", "5 minutes", "1 minute")
    counts.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["start"].minute, r["kind"], r["n"]) for r in spark.table("windows").collect()) == [(0, "a", 2), (0, "b", 1), (5, "a", 1), (5, "b", 1)]
