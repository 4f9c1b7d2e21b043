"""Registered queries that run the stores, pipelines and readers in folders of their own and return what is there afterwards."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import identity, policy
from loomgraph.operators import chunking, completions, curation, evaluation, evidence, registry
from loomgraph.operators.candidates import Attributes, Compose, Entity, Scoring
from loomgraph.operators.evidence import EvidenceStore
from loomgraph.operators.graph import Graph, Operation, ReadOptions
from loomgraph.operators.ledger import LEGAL, Ledger, MemorySink, Profile
from loomgraph.operators.normalize import Field, normalize, passthrough
from loomgraph.operators.validate import Ontology
from loomgraph.plans.catalogue import _ARMS_SQL, _LEGAL_SQL, _arms, query, records, table
from loomgraph.plans.extraction import DocumentPipeline, Extractor
from loomgraph.plans.ingest import Pipeline
from loomgraph.sources import records as readers
from loomgraph.sources.store import Store, scratch

AT = datetime(2026, 1, 1, tzinfo=UTC)
NATION = Entity("geo", "n_nationkey", "Nation", display_name="n_name")


def _nations(spark: SparkSession, sf_dir: str) -> Pipeline:
    def source() -> readers.Records:
        frame = records(table(spark, sf_dir, "nation"), F.col("n_nationkey"), "n_nationkey", "n_name", "n_regionkey")
        return readers.Records(frame, "table", "nation")

    return Pipeline("geo", source, NATION, Scoring(0.9), fields=[Field("n_nationkey", "int"), Field("n_name"), Field("n_regionkey", "int")], run_id="run", clock=lambda: AT)


def _id_of(ledger: Ledger, key: int) -> str:
    return ledger.rows().where(F.col("semantic_key") == f"nation/geo/{key}").first()["candidate_id"]


# ---------------------------------------------------------------- readers


@query("""select (row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1)::bigint as rec_idx,
  'l_orderkey=' || l_orderkey || '&l_linenumber=' || l_linenumber as fragment, l_partkey, l_extendedprice from lineitem""")
def snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a snapshot in key order, rows of one key by their other columns."""
    opened = readers.TableSnapshot(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "lineitem", version="v").open()
    return opened.frame.select("rec_idx", "coord.fragment", "data.l_partkey", "data.l_extendedprice")


@query("""select s as source, (row_number() over (partition by s order by n_nationkey) - 1)::bigint as rec_idx, n_nationkey::varchar as key, n_name as name,
  case s when 'csv' then 'row=' || (row_number() over (partition by s order by n_nationkey) + 1) when 'lines' then 'line=' || row_number() over (partition by s order by n_nationkey) else 'index=' || (row_number() over (partition by s order by n_nationkey) - 1) end as fragment
  from nation, (select unnest(['csv', 'lines', 'array', 'memory']) as s)""")
def readers_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written as CSV, JSON lines and a JSON array, and held in memory: all readers give the same records."""
    base = scratch(spark, "readers")
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("name")).orderBy(F.col("key").cast("int")).coalesce(1)
    rows.write.option("header", True).csv(f"{base}/csv")
    rows.write.json(f"{base}/lines")
    rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("key").cast("int").alias("at"), "key", "name")))).alias("value")).write.text(f"{base}/array")  # 25 nations
    held = [r.asDict() for r in rows.orderBy(F.col("key").cast("int")).collect()]
    sources = {
        "csv": readers.from_csv(spark, f"{base}/csv", multiline=False), "lines": readers.from_json(spark, f"{base}/lines"), "array": readers.from_json(spark, f"{base}/array"),
        "memory": readers.from_rows(spark, held, "key string, name string"),
    }
    out = None
    for name, source in sources.items():
        values = normalize(source.frame, [Field("key"), Field("name")])
        one = values.select(F.lit(name).alias("source"), "rec_idx", "values.key", "values.name", "coord.fragment")
        out = one if out is None else out.unionByName(one)
    return out


@query("""select n_nationkey, n_name, n_regionkey from nation where n_regionkey = 1""")
def sqlite_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of a region, filtered, projected and ordered by SQLite."""
    import os
    import sqlite3
    from urllib.parse import urlparse

    folder = urlparse(scratch(spark, "sqlite")).path
    os.makedirs(folder)
    with sqlite3.connect(f"{folder}/geo.db") as db:
        db.execute("create table nation (n_nationkey bigint primary key, n_name text, n_regionkey bigint, n_comment text)")
        db.executemany("insert into nation values (?, ?, ?, 'x')", [tuple(r) for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()])
    return readers.sqlite_table(spark, f"{folder}/geo.db", "nation", ["n_nationkey", "n_name", "n_regionkey"], "n_regionkey = 1", ["n_nationkey"])


# ---------------------------------------------------------------- normalization


@query("""select c_custkey as id, case when c_custkey % 3 = 0 then 'unknown' else c_mktsegment end as segment, c_custkey % 2 = 0 as flag, (c_custkey % 100)::double as share,
  '{"C_PHONE":' || case when c_custkey % 5 = 0 then 'null' else '"+' || c_custkey || '"' end || '}' as extras from customer""")
def normalized_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in another case and by alias, blank cells, defaults, narrow numbers, and a column that no field claims."""
    c = table(spark, sf_dir, "customer")
    blank = F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit("\t")))
    phone = F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("+"), F.col("c_custkey")))
    frame = records(c, F.col("c_custkey"), F.col("c_custkey").cast("string").alias(" Cust_Key "), blank.alias("MktSegment"), (F.col("c_custkey") % 2 == 0).cast("tinyint").alias("Flag"), (F.col("c_custkey") % 100).cast("float").alias("share"), phone.alias("C_PHONE"))
    fields = [Field("id", "int", required=True, aliases=("cust_key",)), Field("segment", aliases=("mktsegment",), default="unknown"), Field("flag", "bool"), Field("share", "float")]
    return normalize(frame, fields).select("values.*", F.to_json("extras", {"ignoreNullFields": "false"}).alias("extras"))


@query("""select r_regionkey, r_name, 0::bigint as issues from region""")
def passed_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = passthrough(records(table(spark, sf_dir, "region"), F.col("r_regionkey"), "r_regionkey", "r_name"))
    return values.select("values.*", F.size("issues").cast("long").alias("issues"))


# ---------------------------------------------------------------- ingestion


@query("""with o as (select *, o_orderpriority = '5-LOW' as bad from orders), c as (select o_custkey, o_orderkey from o where not bad),
  m as (select 'records_read' as metric, count(*) as n from o union all select 'records_valid', count(*) from c union all select 'records_invalid', count(*) from o where bad
    union all select 'candidates_built', 2 * count(*) from c union all select 'candidates_rejected', count(*) from c union all select 'candidates_suppressed', count(*) - count(distinct o_custkey) from c union all select 'kind_entity', count(distinct o_custkey) from c)
  select 'first' as run, metric, n::bigint as n from m union all select 'first', 'received', count(distinct o_custkey) from c union all select 'first', 'duplicates', 0
  union all select 'again', metric, n from m union all select 'again', 'received', 0 union all select 'again', 'duplicates', count(distinct o_custkey) from c""")
def ingest_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders to customers and to orders, which the ontology doesn't know; low priority lacks a required value. Run twice on one ledger."""
    frame = records(table(spark, sf_dir, "orders").withColumn("p", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))), F.col("o_orderkey"), "o_custkey", "o_orderkey", "p")
    own = Pipeline(
        "crm", readers.Records(frame, "table", "orders"), Compose(Entity("crm", "o_custkey", "Customer"), Entity("crm", "o_orderkey", "Order")), Scoring(0.9),
        fields=[Field("o_custkey", "int"), Field("o_orderkey", "int"), Field("p", required=True)], ontology=Ontology("1", frozenset({"Customer"})), clock=lambda: AT,
    )
    ledger = Ledger(spark, scratch(spark, "ledger"))
    rows = []
    for run in ("first", "again"):
        _, report = own.run(ledger)
        names = ("records_read", "records_valid", "records_invalid", "candidates_built", "candidates_rejected", "candidates_suppressed", "received", "duplicates")
        rows += [(run, n, getattr(report, n)) for n in names] + [(run, f"kind_{k}", n) for k, n in report.kind_counts.items()]
        assert not report.succeeded and report.fingerprint()["mode"] == "execute" and report.summary().startswith("execute read=")
    return spark.createDataFrame(rows, "run string, metric string, n long")


@query("""select 'nation/geo/' || n_nationkey as semantic_key, n_name as display_name, n_nationkey as rec_idx, 'table' as source_type, 'row=' || n_nationkey as fragment, 'run' as producer_run_id, 0.9::double as reliability from nation""")
def ingest_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dry run: the candidates that a run would submit."""
    planned, report = _nations(spark, sf_dir).plan()
    assert report.mode == "dry_run" and report.received == 0
    return planned.select("semantic_key", "display_name", "rec_idx", "coord.source_type", "coord.fragment", "producer_run_id", F.col("scores.source_reliability").alias("reliability"))


# ---------------------------------------------------------------- ledger


@query(f"""with recursive a as (select o_custkey as k, row_number() over (partition by o_custkey order by o_orderkey) as n, case o_orderstatus when 'O' then 'VALIDATED' when 'F' then 'RETRYABLE_ERROR' else 'REVIEW_PENDING' end as t from orders where o_custkey in (select c_custkey from customer)),
  w as (select c_custkey as k, 0::bigint as n, 'RECEIVED' as s, 0 as ok from customer
    union all select a.k, a.n, case when s || '>' || t in ({_LEGAL_SQL}) then t else s end, case when s || '>' || t in ({_LEGAL_SQL}) then 1 else 0 end from w join a on a.k = w.k and a.n = w.n + 1)
  select 'customer/crm/' || k as semantic_key, arg_max(s, n) as state, sum(ok)::bigint as applied, (max(n) - sum(ok))::bigint as refused from w group by k""")
def ledger_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer a row of a ledger; each of its orders asks for a state, in order, in one batch."""
    customers = records(table(spark, sf_dir, "customer"), F.col("c_custkey"), "c_custkey")
    ledger = Ledger(spark, scratch(spark, "ledger"))
    Pipeline("crm", readers.Records(customers, "table", "customer"), Entity("crm", "c_custkey", "Customer"), Scoring(0.9), fields=[Field("c_custkey", "int")], clock=lambda: AT).run(ledger)
    ids = ledger.rows().select("candidate_id", "semantic_key")
    state = F.when(F.col("o_orderstatus") == "O", "VALIDATED").when(F.col("o_orderstatus") == "F", "RETRYABLE_ERROR").otherwise("REVIEW_PENDING")
    asked = table(spark, sf_dir, "orders").select(F.concat(F.lit("customer/crm/"), F.col("o_custkey")).alias("semantic_key"), F.col("o_orderkey").alias("ord"), state.alias("to_state"), F.lit("order").alias("reason"))
    done = ledger.transitions(asked.join(ids, "semantic_key").drop("semantic_key"), "me")
    tally = done.groupBy("candidate_id").agg(F.count_if("applied").alias("applied"), F.count_if(~F.col("applied")).alias("refused"))
    return ledger.rows().join(tally, "candidate_id", "left").select("semantic_key", "state", F.coalesce("applied", F.lit(0)).cast("long").alias("applied"), F.coalesce("refused", F.lit(0)).cast("long").alias("refused"))


@query("""select 'nation/geo/' || n_nationkey as semantic_key, n_nationkey in (3, 7) as revoked, n_nationkey = 5 as erased, n_nationkey <> 5 as has_payload, case n_nationkey when 3 then 3 when 7 then 2 when 5 then 2 else 1 end::bigint as events,
  case when n_nationkey = 4 then 'RETRYABLE_ERROR' else 'RECEIVED' end as state, case when n_nationkey = 4 then 1 else 0 end::bigint as retries from nation where n_nationkey <> 4
  union all select 'nation/geo/4', false, false, true, 2, 'RETRYABLE_ERROR', 1""")
def ledger_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations submitted twice; one fails and may be retried, two are withdrawn, one of them again, one is erased."""
    ledger = Ledger(spark, scratch(spark, "ledger"), Profile(erasure=True), clock=lambda: AT)
    _nations(spark, sf_dir).run(ledger)
    _nations(spark, sf_dir).run(ledger)
    ledger.transition(_id_of(ledger, 4), "RETRYABLE_ERROR", "me", increment_retry=True, quarantine_reason="net")
    for key in (3, 7, 3):
        ledger.revoke(_id_of(ledger, key), "wrong", "me")
    ledger.erase(_id_of(ledger, 5), "asked for", "me")
    assert ledger.is_revoked(_id_of(ledger, 7)) and ledger.is_erased(_id_of(ledger, 5)) and ledger.entries("geo", ["RECEIVED"]).count() == 21
    held = ledger.store.read("payloads").select("candidate_id", F.lit(True).alias("p"))
    events = ledger.audit().groupBy("candidate_id").agg(F.count("*").alias("events"))
    rows = ledger.rows().join(held, "candidate_id", "left").join(events, "candidate_id")
    return rows.select("semantic_key", "revoked", "erased", F.coalesce("p", F.lit(False)).alias("has_payload"), "events", "state", F.col("retry_count").cast("long").alias("retries"))


# ---------------------------------------------------------------- evidence


@query("""select 'ev_' || user_id as evidence_id, arg_max(event_type, event_id) as version, max(event_id) as last from events group by user_id""")
def evidence_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as evidence about users, in two batches that repeat ids: the last written of each is kept."""
    events = table(spark, sf_dir, "events")
    store = EvidenceStore(spark, scratch(spark, "evidence"))
    rows = events.select(*evidence.row("PRESENT", evidence_id=F.concat(F.lit("ev_"), F.col("user_id")), payload_hash=F.col("event_type"), source_locator=F.col("event_id").cast("string")), F.col("event_id").alias("ord"))
    for part in (0, 1):
        own = rows.where(F.col("ord") % 2 == part)
        # what is older than the stored row doesn't replace it
        stored = store.rows().select("evidence_id", F.col("source_locator").cast("long").alias("seen"))
        fresh = own.join(stored, "evidence_id", "left").where("seen is null or ord > seen").drop("seen")
        store.put(fresh, order="ord")
    return store.rows().select("evidence_id", F.col("payload_hash").alias("version"), F.col("source_locator").cast("long").alias("last"))


@query("""select 'ev_n' || n_nationkey as evidence_id, n_nationkey in (3, 7) as redacted, case when n_nationkey in (3, 7) then null else n_name end as content, (case when n_nationkey in (3, 7) then 0 else 1 end)::bigint as citations from nation
  union all select 'ev_r' || r_regionkey, false, r_name, (select count(*) from nation where n_regionkey = r_regionkey and n_nationkey not in (3, 7)) from region""")
def evidence_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations cite a row of their own and their region's; two are erased, and only what nobody else cites loses its text."""
    store = Store(spark, scratch(spark, "store"), {})
    ledger, kept = Ledger(spark, profile=Profile(erasure=True), store=store, clock=lambda: AT), EvidenceStore(spark, store=store)
    _nations(spark, sf_dir).run(ledger)
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    row = lambda frame, letter, key, name: frame.select(*evidence.row("PRESENT", evidence_id=F.concat(F.lit(f"ev_{letter}"), F.col(key)), content=F.col(name), span=F.struct(F.lit(0).alias("start"), F.length(name).alias("end"), F.col(name).alias("quote"))))
    ids = ledger.rows().select(F.col("candidate_id").alias("subject_id"), F.regexp_extract("semantic_key", "[0-9]+$", 0).cast("long").alias("n_nationkey")).join(nation, "n_nationkey")
    refs = ids.select("subject_id", F.explode(F.array(F.struct(F.concat(F.lit("ev_n"), F.col("n_nationkey")).alias("evidence_id"), F.lit("SUPPORTS").alias("relationship")), F.struct(F.concat(F.lit("ev_r"), F.col("n_regionkey")).alias("evidence_id"), F.lit("DERIVED_FROM").alias("relationship")))).alias("r")).select("subject_id", "r.*")
    kept.put(row(nation, "n", "n_nationkey", "n_name").unionByName(row(region, "r", "r_regionkey", "r_name")), refs)
    kept.cite(refs)
    for key in (3, 7):
        report = evidence.erase(ledger, kept, _id_of(ledger, key), "asked for", "me")
        assert report["redacted"] == [f"ev_n{key}"] and len(report["preserved"]) == 1 and not report["already_erased"]
    assert ledger.audit().where("kind = 'redact'").count() == 2 and kept.redaction("ev_n3")[1] == "asked for"
    live = kept.refs_for(ledger.entries().select(F.col("candidate_id").alias("subject_id")))
    assert kept.resolve(live.select("subject_id")).count() == live.count()
    cited = kept.refs().groupBy("evidence_id").agg(F.count("*").alias("citations"))
    return kept.rows().join(cited, "evidence_id", "left").select("evidence_id", F.col("redacted_at").isNotNull().alias("redacted"), "content", F.coalesce("citations", F.lit(0)).cast("long").alias("citations"))


@query("""select 1::bigint as rewritten, (count(*) - 1)::bigint as payloads from nation""")
def erasure_rewrites_a_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many payload buckets an erasure rewrites, and how many payloads are left."""
    ledger = Ledger(spark, scratch(spark, "ledger"), Profile(erasure=True), clock=lambda: AT)
    _nations(spark, sf_dir).run(ledger)
    before = set(ledger.store.state()["payloads"])
    ledger.erase(_id_of(ledger, 6), "asked for", "me")
    gone = before - set(ledger.store.state()["payloads"])
    return spark.createDataFrame([(len(gone), ledger.store.read("payloads").count())], "rewritten long, payloads long")


# ---------------------------------------------------------------- graph


def _kg(column) -> F.col:
    return F.concat(F.lit("kg://geo/identity/"), F.lpad(column.cast("string"), 26, "0"))


@query("""select n_nationkey::bigint as nation, case when n_regionkey = 0 and n_nationkey <> 0 then 'REVOKED' else 'ACTIVE' end as status, (1 + 1 + (n_regionkey = 0)::int + (n_nationkey = 0)::int)::bigint as touches,
  (case when n_regionkey = 0 and n_nationkey <> 0 then 0 when n_nationkey = 1 then 0 else 1 end)::bigint as visible, 1::bigint as attached from nation""")
def graph_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as identities, one fact each; a region is revoked, one of it restored, a fact superseded, and two batches fail whole."""
    g = Graph(spark, scratch(spark, "graph"))
    nation = table(spark, sf_dir, "nation")
    alias = F.array(F.struct(F.lit("Nation").alias("entity_type"), F.lit("geo").alias("namespace"), F.col("n_name").alias("key")))
    g.put_entities(nation.select(_kg(F.col("n_nationkey")).alias("identity_id"), F.lit("Nation").alias("entity_type"), alias.alias("aliases"), F.lit("ACTIVE").alias("status"), F.col("n_name").alias("display_name"), F.lit(AT).cast("timestamp").alias("created_at")))
    rows = [(r["n_nationkey"], r["n_regionkey"]) for r in nation.orderBy("n_nationkey").collect()]
    name = lambda n: f"kg://geo/identity/{n:026d}"
    fact = lambda n: Operation("ATTACH_ASSERTION", {"assertion_id": f"as_{n:026d}", "subject_identity": name(n), "predicate": "IN", "object_value": str(n), "recorded_at": AT, "source_candidate_ids": [], "evidence_refs": []})
    revoke = [Operation("REVOKE_IDENTITY", {"identity_id": name(n)}) for n, r in rows if r == 0]
    done = g.apply([fact(n) for n, _ in rows] + revoke, {name(n): "1" for n, _ in rows})
    assert done["committed"] and done["epoch"] == 2
    assert not g.apply([fact(99), *revoke])["committed"] and g.apply([fact(98)], {name(2): "7"})["failed"] == [name(2)]
    g.apply([Operation("RESTORE_IDENTITY", {"identity_id": name(0)})])
    g.mark_superseded(f"as_{1:026d}", AT + timedelta(days=1), f"as_{2:026d}")
    everything = ReadOptions(include_revoked=True, include_superseded=True)
    seen = lambda options, out: g.assertions(options=options).groupBy("subject_identity").agg(F.count("*").alias(out))
    out = g.entities(options=everything).withColumnRenamed("identity_id", "subject_identity").join(seen(ReadOptions(), "visible"), "subject_identity", "left").join(seen(everything, "attached"), "subject_identity", "left")
    return out.select(F.right("subject_identity", F.lit(26)).cast("long").alias("nation"), "status", "touches", F.coalesce("visible", F.lit(0)).cast("long").alias("visible"), F.col("attached").cast("long").alias("attached"))


@query("""select n_nationkey::bigint as origin, n2::bigint as reached, 1 as hop from (select a.n_nationkey, min(b.n_nationkey) as n2 from nation a join nation b on a.n_regionkey = b.n_regionkey and b.n_nationkey > a.n_nationkey group by 1)""")
def graph_neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation points at the next of its region; what one step reaches, as of the epoch in which it was attached."""
    from pyspark.sql import Window

    g = Graph(spark, scratch(spark, "graph"))
    nation = table(spark, sf_dir, "nation").withColumn("next", F.lead("n_nationkey").over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")))
    g.put_entities(nation.select(_kg(F.col("n_nationkey")).alias("identity_id"), F.lit("Nation").alias("entity_type"), F.lit("ACTIVE").alias("status")))
    name = lambda n: f"kg://geo/identity/{n:026d}"
    links = [(r["n_nationkey"], r["next"]) for r in nation.where("next is not null").orderBy("n_nationkey").collect()]
    g.apply([Operation("ATTACH_ASSERTION", {"assertion_id": f"as_{n:026d}", "subject_identity": name(n), "predicate": "NEXT", "object_identity": name(m), "recorded_at": AT, "source_candidate_ids": [], "evidence_refs": []}) for n, m in links])
    assert g.neighborhood(nation.select(_kg(F.col("n_nationkey")).alias("identity_id")), 1, ReadOptions(epoch=1)).isEmpty()
    reached = g.neighborhood(nation.select(_kg(F.col("n_nationkey")).alias("identity_id")), 1, ReadOptions(epoch=g.current_epoch()))
    number = lambda c: F.right(c, F.lit(26)).cast("long")
    return reached.select(number("origin").alias("origin"), number("identity_id").alias("reached"), "hop")


# ---------------------------------------------------------------- registry and policy


@query("""select r_name as name, (case when r_regionkey % 2 = 0 then 2 else 1 end)::bigint as version, case when r_regionkey % 2 = 0 then 'second' else 'first' end as domain,
  case when r_regionkey = 0 then 'bad' when r_regionkey = 1 then 'good' end as outcome, (case when r_regionkey < 3 then 1 else 0 end)::bigint as decisions from region""")
def registry_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions registered as graphs, some twice; decisions about three, with outcomes of two, one of them corrected."""
    r = registry.Registry(spark, scratch(spark, "registry"), lambda: AT)
    names = [(x["r_regionkey"], x["r_name"]) for x in table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    for key, name in names:
        r.register(name, domain="first", node_types=["A"], backend_ref="own")
        if key % 2 == 0:
            assert r.register(name, domain="second", node_types=["A", "B"]) == 2
    for key, name in names[:3]:
        made = r.record_decision("{}", registry.EXTEND, "me", "why", name)
        assert r.record_decision("{}", registry.EXTEND, "me", "why", name, made) == made
        for label in {0: ("good", "bad"), 1: ("good",)}.get(key, ()):
            r.record_outcome(made, label)
    assert r.get(names[0][1], 1)["domain"] == "first" and r.attributes_for(names[1][1]) == {registry.BACKEND: "own"} and r.versions().count() == 8
    told = r.decisions().groupBy("graph_name").agg(F.max("outcome_label").alias("outcome"), F.count("*").alias("decisions"))
    return r.snapshot().join(told, F.col("name") == F.col("graph_name"), "left").select("name", "version", "domain", "outcome", F.coalesce("decisions", F.lit(0)).cast("long").alias("decisions"))


@query("""with f as (select 'region' || r_regionkey as profile_id, 'nation' || n_nationkey as graph_name, case when r_regionkey = 0 and n_nationkey % 3 <> 0 then 0 else (r_regionkey = n_regionkey)::int end::double as tenancy,
    (case when n_nationkey % 2 = 0 then 1 else 0 end + case when r_regionkey = 1 then null when n_nationkey % 4 = 0 then 1 else 0 end) / 2.0 as two, (n_nationkey % 2 = 0)::int::double as one, r_regionkey as r, n_nationkey as n from region, nation)
  select profile_id, graph_name, tenancy, case when r = 1 then one else two end as lifecycle, case when r = 2 and n % 5 <> 0 then 0 when r = 2 then 1 when n % 5 = 0 then 0 else 1 end::double as computational_coupling from f""")
def advisor_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenancy, lifecycle and coupling of every region against every nation."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    empty, none = F.array().cast("array<string>"), F.lit(None).cast("string")
    key = F.col("n_nationkey")
    attributes = F.create_map(
        F.lit(registry.TENANCY), F.col("n_regionkey").cast("string"), F.lit(registry.LIFECYCLE), F.when(key % 2 == 0, "long").otherwise("short"), F.lit(registry.RETENTION), F.when(key % 4 == 0, "kept").otherwise("dropped"),
        F.lit(registry.MINORS), F.when(key % 3 == 0, "Yes").otherwise("no"), F.lit(registry.COMPUTED), F.when(key % 5 == 0, "1").otherwise("0"),
    )
    graphs = n.select(F.concat(F.lit("nation"), key).alias("name"), empty.alias("node_types"), empty.alias("edge_types"), attributes.alias("attributes"))
    at = F.col("r_regionkey")
    profiles = r.select(
        F.concat(F.lit("region"), at).alias("profile_id"), none.alias("identity_authority"), empty.alias("node_types"), empty.alias("edge_types"), empty.alias("attribute_types"), at.cast("string").alias("tenancy_class"), F.lit("long").alias("lifecycle_class"),
        F.when(at != 1, "kept").alias("retention_class"), (at == 0).alias("contains_minors_data"), (at == 2).alias("is_computed_output"),
    )
    return registry.score(profiles, graphs).select("profile_id", "graph_name", "tenancy", "lifecycle", "computational_coupling")


@query("""select o_orderstatus as status, case when o_orderstatus = 'F' then 'NEW_IDENTITY' when o_custkey % 2 = 0 then 'RESOLVED_EXISTING' else 'UNRESOLVED' end as disposition, case o_orderstatus when 'O' then 'REVOKE_IDENTITY' when 'F' then 'SPLIT_IDENTITY' end as inverse, count(*) as n from orders group by all""")
def policy_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What resolution concluded about orders, and what would undo the operation that each stands for."""
    o = table(spark, sf_dir, "orders")
    operation = F.when(F.col("o_orderstatus") == "O", "CREATE_IDENTITY").when(F.col("o_orderstatus") == "F", "MERGE_IDENTITIES").otherwise("PROMOTE")
    found = policy.disposition(F.col("o_orderstatus") == "F", F.when(F.col("o_custkey") % 2 == 0, F.lit("kg")))
    return o.select(F.col("o_orderstatus").alias("status"), found.alias("disposition"), policy.inverse(operation).alias("inverse")).groupBy("status", "disposition", "inverse").agg(F.count("*").alias("n"))


@query("""select c_custkey % 4 = 0 as wrong, c_custkey % 4 <> 0 as identity, c_custkey % 4 <> 0 as assertion, count(*) as n from customer group by all""")
def id_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of identities and assertions made of customers' numbers, some a character too long."""
    c = table(spark, sf_dir, "customer").withColumn("wrong", F.col("c_custkey") % 4 == 0)
    tail = F.when(F.col("wrong"), "0").otherwise("")
    return c.select("wrong", identity.is_identity(F.concat(_kg(F.col("c_custkey")), tail)).alias("identity"), identity.is_assertion(F.concat(F.lit("as_"), F.lpad(F.col("c_custkey").cast("string"), 26, "0"), tail)).alias("assertion")).groupBy("wrong", "identity", "assertion").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- extraction


@query("""with w as (select item_id, split_part(trim(text), ' ', 1) as w, text from benchmark where trim(text) <> ''), a as (select min(item_id) as item_id, w from w where item_id % 5 <> 0 group by w)
  select 'asked' as what, count(*)::bigint as n from w union all select 'failed', count(*) from w where item_id % 5 = 0 union all select 'received', count(*) from a union all select 'chunk evidence', count(distinct item_id) from a union all select 'quote evidence', count(*) from a
  union all select 'citations', 2 * count(*) from a union all select 'received again', 0 union all select 'duplicates again', count(*) from a""")
def extraction_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the benchmark read by a recorded model that names and quotes their first word, and fails for every fifth: run twice, evidence and all."""
    docs = chunking.documents(table(spark, sf_dir, "benchmark").where("trim(text) <> ''").select(F.col("item_id").alias("doc_id"), "text").orderBy("item_id"))
    extractor = Extractor("words", "First word of {text}", [Field("name")], Entity("x", "name", "Word"), Scoring(0.9))

    def answer(asked: DataFrame) -> DataFrame:
        word = F.get(F.split(F.trim("text"), " "), F.lit(0))
        said = F.when(F.col("doc_id").cast("long") % 5 != 0, F.to_json(F.array(F.struct(word.alias("name"), word.alias("quote"), F.lit(0.5).alias("confidence")))))
        return completions.replay(asked, asked.select("request_key", said.alias("response")).where("response is not null"), strict=False)

    own = DocumentPipeline("g", docs, chunking.whole, [extractor], answer, deterministic=True, run_id="r", clock=lambda: AT)
    store = Store(spark, scratch(spark, "store"), {})
    ledger, kept = Ledger(spark, store=store, clock=lambda: AT), EvidenceStore(spark, store=store)
    _, first, _ = own.run(ledger, kept)
    _, again, _ = own.run(ledger, kept)
    quotes = kept.rows().where("span.quote is not null").count()
    rows = [("asked", first.records_read), ("failed", own.failed.count()), ("received", first.received), ("chunk evidence", kept.rows().count() - quotes), ("quote evidence", quotes), ("citations", kept.refs().count()), ("received again", again.received), ("duplicates again", again.duplicates)]
    own.release()
    return spark.createDataFrame(rows, "what string, n long")


# ---------------------------------------------------------------- evaluation


def _cards(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(scorecards, candidates, gold, arms): candidates cite their document, of which short ones aren't stored."""
    made, gold, arms = _arms(spark, sf_dir)
    made = made.withColumn("evidence_refs", F.array(F.struct(F.concat(F.lit("ev_"), F.col("match_key")).alias("evidence_id"), F.lit("SUPPORTS").alias("relationship"))))
    docs = table(spark, sf_dir, "documents").where("n_chars > 400")
    rows = arms.join(docs).select("arm_id", F.concat(F.lit("ev_"), F.col("doc_id")).alias("evidence_id"), F.lit("PRESENT").alias("availability"), F.lit("doc").alias("source_locator"), F.lit(None).cast("string").alias("content"), F.struct(F.lit(0).alias("start"), F.col("n_chars").cast("int").alias("end")).alias("span"))
    none = lambda kind: F.lit(None).cast(kind)
    gold = gold.withColumns({"source_locator": none("string"), "quote": none("string"), "start": none("int"), "end": none("int")})
    arms = arms.withColumns({"attempted": F.lit(200), "abstained": F.lit(50), "failed": F.when(F.col("arm_id") == "long", 10), "cost_usd": F.when(F.col("arm_id") == "long", 1.0).otherwise(2.0), "latency_seconds": none("double")})
    return evaluation.scorecard(made, gold, rows, arms), made, gold, arms


_CARDS_SQL = f"""with {_ARMS_SQL}, arms as (select unnest(['long', 'english']) as arm), cats as (select unnest(['entity', 'relation', 'attribute']) as cat),
  n as (select arms.arm, cats.cat, (select count(*) from c where c.arm = arms.arm and c.cat = cats.cat) as n, (select count(distinct k) from c where c.arm = arms.arm and c.cat = cats.cat and (c.cat, c.k) in (select (cat, k) from g)) as tp, (select count(*) from g where g.cat = cats.cat) as gold from arms, cats),
  p as (select *, tp / nullif(n, 0)::double as p, tp / nullif(gold, 0)::double as r from n),
  refs as (select arm, count(*) as total, count(*) filter (n_chars > 400) as found from c join documents on doc_id = k group by arm)"""


@query(f"""{_CARDS_SQL}
  select arm as arm_id, cat || '.precision' as metric, round(p, 9) as value from p union all select arm, cat || '.recall', round(r, 9) from p union all select arm, cat || '.f1', round(case when p is null or r is null then null when p + r = 0 then 0 else 2 * p * r / (p + r) end, 9) from p
  union all select arm, 'evidence.resolvable_rate', round(found / total::double, 9) from refs union all select arm, 'evidence.span_coverage_rate', null from arms union all select arm, 'abstention_rate', 0.25 from arms union all select arm, 'failure_rate', case when arm = 'long' then 0.05 end from arms""")
def flat_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both arms' scorecards in long form."""
    cards, *_ = _cards(spark, sf_dir)
    return evaluation.flat_metrics(cards).select("arm_id", "metric", F.round("value", 9).alias("value"))


@query(f"""{_CARDS_SQL}
  select n.arm as arm_id, sum(n - tp)::bigint as hallucinations, any_value(total)::bigint as total_refs, any_value(found)::bigint as resolvable_refs, any_value(total - found)::bigint as ungrounded, any_value(total - found)::bigint as unverified from n join refs on refs.arm = n.arm group by n.arm""")
def scorecard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards, *_ = _cards(spark, sf_dir)
    return cards.select("arm_id", "hallucinations", "total_refs", "resolvable_refs", "ungrounded", "unverified")


@query(f"""{_CARDS_SQL}, v as (select unnest(['entity.recall', 'entity.precision', 'attribute.recall']) as metric),
  x as (select metric, (select case when metric like '%recall' then r else p end from p where arm = 'long' and cat = split_part(metric, '.', 1)) as a, (select case when metric like '%recall' then r else p end from p where arm = 'english' and cat = split_part(metric, '.', 1)) as b from v)
  select metric, round(a, 9) as baseline, round(b, 9) as enhanced, case when metric = 'attribute.recall' then null else round((select r from p where arm = 'english' and cat = 'entity') - (select r from p where arm = 'long' and cat = 'entity'), 9) end as point,
    case when metric = 'attribute.recall' then null else (select count(*) from g where cat = 'entity') end::bigint as n_items, metric = 'entity.recall' as has_signal from x""")
def ablation_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is naming all English documents better than naming long ones? A recall, a precision, which has no paired signal, and what nobody measured."""
    cards, made, gold, arms = _cards(spark, sf_dir)
    hits = evaluation.gold_hits(evaluation.matched(made, gold), gold, arms)
    out = None
    for metric in ("entity.recall", "entity.precision", "attribute.recall"):
        one = evaluation.compare(cards, hits, "long", "english", metric, evaluation.Bootstrap(seed=11, resamples=50))
        out = one if out is None else out.unionByName(one)
    return out.select("metric", F.round("baseline", 9).alias("baseline"), F.round("enhanced", 9).alias("enhanced"), F.round("point", 9).alias("point"), "n_items", (F.col("verdict") != "INSUFFICIENT_EVIDENCE").alias("has_signal"))


@query("""select category, gold_idx::int as gold_idx, match_key from (select 'entity' as category, n_nationkey as gold_idx, 'Nation' || chr(31) || 'nation/geo/' || n_nationkey as match_key from nation
  union all select 'attribute', n_nationkey, 'Nation:geo:' || n_nationkey || chr(31) || 'region' || chr(31) || n_regionkey from nation)""")
def gold_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gold set of nations, written as a JSON file and read: a number and the same digits as text are one key."""
    folder = scratch(spark, "gold")
    number = F.col("n_nationkey").cast("string")
    entity = F.struct(F.lit("Nation").alias("entity_type"), F.concat(F.lit("nation/geo/"), number).alias("semantic_key"))
    fact = F.struct(F.concat(F.lit("Nation:geo:"), number).alias("subject"), F.lit("region").alias("attribute"), F.col("n_regionkey").alias("value"))
    listed = table(spark, sf_dir, "nation").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", entity.alias("e"), fact.alias("f")))).alias("x"))  # 25 nations
    whole = F.struct(F.lit("geo").alias("gold_set_id"), F.transform("x", lambda i: i["e"]).alias("entities"), F.transform("x", lambda i: i["f"]).alias("attributes"))
    listed.select(F.to_json(whole).alias("value")).write.text(folder)
    return evaluation.gold_from_json(spark, folder).select("category", "gold_idx", "match_key")


# ---------------------------------------------------------------- sinks and plans


@query("""select 'cand_' || o_orderkey as candidate_id, case when row_number() over (partition by o_custkey order by o_orderdate >= timestamp '1996-01-01', o_orderkey) = 1 then 'RECEIVED' else 'DUPLICATE' end as status from orders""")
def memory_sink_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of old orders, then of new ones, submitted to a sink that isn't a ledger."""
    key = F.concat(F.lit("customer/crm/"), F.col("o_custkey"))
    orders = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("cand_"), F.col("o_orderkey")).alias("candidate_id"), F.lit("crm").alias("graph_id"), key.alias("semantic_key"), F.col("o_orderkey").alias("rec_idx"),
        F.lit(0).alias("pos"), F.lit("t").alias("trace_id"), F.col("o_orderdate").alias("created_at"),
    )
    sink = MemorySink(spark)
    old = sink.submit(orders.where("created_at < timestamp_ntz '1996-01-01'"))
    return old.unionByName(sink.submit(orders.where("created_at >= timestamp_ntz '1996-01-01'"))).select("candidate_id", "status")


@query("""select 'plan_' || c_custkey as plan_id, 'c' || c_custkey as first_candidate, to_json({'name': c_name, 'segment': c_mktsegment})::varchar as payload, c_nationkey::varchar as expected,
  case when c_acctbal < 0 then 'a plan is for one candidate at least' end as why_not from customer where c_acctbal >= 0
  union all select 'plan_' || c_custkey, null, null, null, 'a plan is for one candidate at least' from customer where c_acctbal < 0""")
def plan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan a customer, written as a line of JSON and read back; those without candidates aren't carried."""
    own = F.when(F.col("c_acctbal") >= 0, F.array(F.concat(F.lit("c"), F.col("c_custkey")))).otherwise(F.array().cast("array<string>"))
    payload = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")))
    plans = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("plan_"), F.col("c_custkey")).alias("plan_id"), own.alias("candidate_ids"), F.lit("7").alias("snapshot_version"),
        F.array(F.struct(F.lit("CREATE_IDENTITY").alias("type"), payload.alias("payload"))).alias("operations"),
        F.array(F.struct(F.lit("cluster_version").alias("kind"), F.lit("i").alias("subject"), F.col("c_nationkey").cast("string").alias("expected"))).alias("preconditions"),
        F.array().cast("array<string>").alias("evidence_ids"), F.lit("1").alias("policy_version"),
    )
    lines = curation.to_lines(plans)
    back = curation.from_lines(lines.where("line is not null"))
    shown = back.select("plan_id", F.col("candidate_ids")[0].alias("first_candidate"), F.col("operations")[0]["payload"].alias("payload"), F.col("preconditions")[0]["expected"].alias("expected"), "why_not")
    empty = F.lit(None).cast("string")
    return shown.unionByName(lines.where("line is null").select("plan_id", empty.alias("first_candidate"), empty.alias("payload"), empty.alias("expected"), "why_not"))
