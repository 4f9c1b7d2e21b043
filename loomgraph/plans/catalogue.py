"""Registered queries over the driver's tables, each with DuckDB SQL that gives the same rows.

Customers, parts and suppliers play entities; orders and line items relations
with repeated keys; events a log of state changes and dated facts; documents,
benchmark and conversations texts to chunk and quote; labels a gold set.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import identity, policy, shapes, text
from loomgraph.operators import admission, candidates, chunking, completions, evaluation, evidence, graph, ledger, registry, validate
from loomgraph.operators.candidates import Attributes, Compose, Entity, Relation
from loomgraph.operators.normalize import Field, normalize
from loomgraph.sources.records import coordinates, issues_of, key_fragment

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def records(frame: DataFrame, order: Column, *columns: str | Column, locator: str = "table") -> DataFrame:
    """A table as records; order is the row's place in the stream."""
    data = F.struct(*(F.col(c) if isinstance(c, str) else c for c in columns))
    return frame.select(order.cast("long").alias("rec_idx"), coordinates("table", locator, F.concat(F.lit("row="), order.cast("string"))).alias("coord"), data.alias("data"), issues_of().alias("issues"))


def built(frame: DataFrame, fields: list[Field], builder) -> DataFrame:
    """Records to a row a candidate, bad records left out."""
    values = validate.verdicts(normalize(frame, fields), [validate.by_issues, validate.required_values(builder.required)])
    ready = candidates.construction(values, builder).where("valid and construction is null")
    return candidates.explode(ready)


CUSTOMER = Entity("crm", "c_custkey", "Customer", display_name="c_name", properties=("c_mktsegment", "c_nationkey"))
PART, SUPPLIER = Entity("shop", "l_partkey", "Part"), Entity("shop", "l_suppkey", "Supplier")
BUYER, ORDER = Entity("crm", "o_custkey", "Customer"), Entity("shop", "o_orderkey", "Order")


# ---------------------------------------------------------------- candidates


@query("""select 'customer/crm/' || c_custkey as semantic_key, 'Customer' as entity_type, c_name as display_name,
  '{"c_mktsegment":"' || c_mktsegment || '","c_nationkey":' || c_nationkey || '}' as properties from customer""")
def entity_candidates_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = records(table(spark, sf_dir, "customer"), F.col("c_custkey"), "c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    made = built(frame, [Field("c_custkey", "int", required=True), Field("c_name"), Field("c_mktsegment"), Field("c_nationkey", "int")], CUSTOMER)
    return made.select("semantic_key", "entity_type", "display_name", "properties")


@query("""select * from (
  select 'part/shop/' || p_partkey || '/brand' as semantic_key, 'brand' as attribute, to_json(p_brand)::varchar as value from part
  union all select 'part/shop/' || p_partkey || '/size', 'size', p_size::varchar from part where p_size > 10
  union all select 'part/shop/' || p_partkey || '/type', 'type', to_json(p_type)::varchar from part)""")
def attribute_fanout_null_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("size", F.when(F.col("p_size") > 10, F.col("p_size")))
    frame = records(part, F.col("p_partkey"), "p_partkey", F.col("p_brand").alias("brand"), "size", F.col("p_type").alias("type"))
    made = built(frame, [Field("p_partkey", "int", required=True), Field("brand"), Field("size", "int"), Field("type")], Attributes(Entity("shop", "p_partkey", "Part"), ("brand", "size", "type")))
    return made.select("semantic_key", "attribute", "value")


@query("""select 'customer/crm/' || o_custkey || '/PLACED/order/shop/' || o_orderkey || '@' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' as semantic_key,
  'Customer:crm:' || o_custkey as subject, 'Order:shop:' || o_orderkey as object from orders""")
def relation_candidates_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = records(table(spark, sf_dir, "orders"), F.col("o_orderkey"), "o_custkey", "o_orderkey", "o_orderdate")
    fields = [Field("o_custkey", "int"), Field("o_orderkey", "int"), Field("o_orderdate", "datetime")]
    made = built(frame, fields, Relation("PLACED", BUYER, ORDER, valid_from="o_orderdate"))
    return made.select("semantic_key", "subject", "object")


_LINE_CANDIDATES = """select l_orderkey * 10 + l_linenumber as rec, 0 as pos, 'entity' as kind, 'part/shop/' || l_partkey as k, l_discount <= 0.05 as ok from lineitem
  union all select l_orderkey * 10 + l_linenumber, 1, 'entity', 'supplier/shop/' || l_suppkey, l_discount <= 0.05 from lineitem
  union all select l_orderkey * 10 + l_linenumber, 2, 'relation', 'part/shop/' || l_partkey || '/SUPPLIED_BY/supplier/shop/' || l_suppkey, l_discount <= 0.05 from lineitem"""


@query(f"""with c as ({_LINE_CANDIDATES}), f as (select *, min(case when ok then (rec * 4 + pos) end) over (partition by k) as first from c)
  select kind, case when first is null or rec * 4 + pos < first then 'rejected' when rec * 4 + pos = first then 'admitted' else 'suppressed' end as disposition, count(*) as n from f group by 1, 2""")
def composite_disposition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, suppliers and who supplies what, from line items; the gate refuses lines with a large discount."""
    line = table(spark, sf_dir, "lineitem")
    place = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    frame = records(line, place, "l_partkey", "l_suppkey", "l_discount")
    values = normalize(frame, [Field("l_partkey", "int"), Field("l_suppkey", "int"), Field("l_discount", "float")])
    made = candidates.construction(values, Compose(PART, SUPPLIER, Relation("SUPPLIED_BY", PART, SUPPLIER)))
    rows = made.select("rec_idx", F.col("values.l_discount").alias("discount"), F.posexplode_outer("made").alias("pos", "c")).where("c is not null").select("rec_idx", "pos", "discount", "c.kind", "c.semantic_key")
    return admission.disposition_counts(rows, F.col("discount") <= 0.05)


@query("""select 'entity' as kind, (select count(*) from customer) + (select count(distinct o_custkey) from orders where o_custkey not in (select c_custkey from customer)) as n
  union all select 'relation', count(distinct (o_custkey, o_orderkey)) from orders""")
def kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of customers and orders together, each key once."""
    customers = records(table(spark, sf_dir, "customer"), F.col("c_custkey"), F.col("c_custkey").alias("o_custkey"))
    orders = records(table(spark, sf_dir, "orders"), F.col("o_orderkey") + (1 << 40), "o_custkey", "o_orderkey")
    fields = [Field("o_custkey", "int"), Field("o_orderkey", "int")]
    every = built(customers, fields, BUYER).unionByName(built(orders, fields, Compose(BUYER, Relation("PLACED", BUYER, ORDER))))
    return admission.disposition_counts(every, F.lit(True)).where("disposition = 'admitted'").select("kind", "n")


@query("""with e as (select event_id, event_type as t, value as v, json_extract_string(props, '$.k') as k from events),
  i as (select 'rank' as field, 'coercion_failed' as code from e where v <> floor(v)
    union all select 'flag', 'coercion_failed' from e where k is not null and k not in ('0', '1')
    union all select 'flag', 'missing_required' from e where k is null
    union all select 'seen', 'assumed_utc' from e
    union all select 'kind', 'coercion_failed' from e where t <> 'error' or true)
  select field, code, count(*) as n from i group by 1, 2""")
def coercion_issues_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read with types that often don't fit: fractions as integers, numbers as booleans, words as numbers."""
    events = table(spark, sf_dir, "events").withColumn("flag", F.get_json_object("props", "$.k"))
    frame = records(events, F.col("event_id"), F.col("value").alias("rank"), "flag", F.col("ts").alias("seen"), F.col("event_type").alias("kind"))
    values = normalize(frame, [Field("rank", "int"), Field("flag", "bool", required=True), Field("seen", "datetime"), Field("kind", "float")])
    return values.select(F.explode_outer("issues").alias("i")).where("i is not null").groupBy(F.col("i.field").alias("field"), F.col("i.code").alias("code")).agg(F.count("*").alias("n"))


@query("""select valid, failure_kind, reason, count(*) as n from (select c_custkey is not null as valid, case when c_custkey is null then 'BAD_DATA' end as failure_kind,
  case when c_custkey is null then 'required_value: ''c_custkey'' is null' end as reason from orders left join (select * from customer where c_acctbal > 0) on o_custkey = c_custkey) group by all""")
def required_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose customer is in credit; the rest lack a required value."""
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey")
    frame = records(table(spark, sf_dir, "orders").join(rich, F.col("o_custkey") == F.col("c_custkey"), "left"), F.col("o_orderkey"), "o_orderkey", "c_custkey")
    values = validate.verdicts(normalize(frame, [Field("o_orderkey", "int"), Field("c_custkey", "int")]), [validate.by_issues, validate.required_values(["c_custkey"])])
    return values.groupBy("valid", "failure_kind", F.get("reasons", F.lit(0)).alias("reason")).agg(F.count("*").alias("n"))


_DECLARED = ("Click", "Error", "Refund", "View")


@query("""with u as (select upper(event_type[1]) || event_type[2:] as term, count(*) as n from events group by 1), d as (select unnest(['Click', 'Error', 'Refund', 'View']) as t)
  select coalesce(term, t) as term, coalesce(n, 0) as n, case when n is null then 'unused' when t is null then 'unknown' else 'used' end as status,
    (select count(*) from u join d on term = t) / 4.0 as ratio from u full join d on term = t""")
def ontology_gate_and_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events as entity types against a vocabulary that lacks some and has one too many."""
    own = validate.Ontology("1", frozenset(_DECLARED))
    used = table(spark, sf_dir, "events").select(F.lit("entity").alias("kind"), F.initcap("event_type").alias("entity_type"), F.lit(None).cast("string").alias("relation_type"), F.lit(None).cast("string").alias("attribute"))
    gated = validate.gate(used, own, strict=False).where("ok")
    usage = validate.term_usage(gated)
    ratio = usage.agg(validate.coverage_ratio(usage, own).alias("ratio"))
    return validate.coverage(usage, own).select("term", "n", "status").join(F.broadcast(ratio))  # one row


# ---------------------------------------------------------------- ledger


def _customer_keys(orders: DataFrame) -> DataFrame:
    key = F.concat(F.lit("customer/crm/"), F.col("o_custkey"))
    return orders.select(F.concat(F.lit("cand_"), F.col("o_orderkey")).alias("candidate_id"), F.lit("crm").alias("graph_id"), key.alias("semantic_key"), F.col("o_orderkey").alias("rec_idx"), F.lit(0).alias("pos"), "o_orderdate", "o_orderstatus", "o_orderpriority")


@query("""select 'cand_' || o_orderkey as candidate_id, 'customer/crm/' || o_custkey as semantic_key from orders
  where o_custkey in (select o_custkey from orders where o_orderdate < timestamp '1996-01-01' and o_orderstatus <> 'F') or o_orderdate < timestamp '1996-01-01'""")
def ledger_duplicates_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which planned candidates the ledger would refuse: old orders are its rows, and failed ones its tombstones."""
    planned = _customer_keys(table(spark, sf_dir, "orders"))
    entries = planned.where("o_orderdate < timestamp_ntz '1996-01-01'")
    return ledger.duplicates(planned, entries, entries.where("o_orderstatus <> 'F'")).select("candidate_id", "semantic_key")


@query("""with p as (select *, 'customer/crm/' || o_custkey as k, o_orderpriority = '5-LOW' as unsure from orders where o_orderdate >= timestamp '1996-01-01'),
  live as (select distinct 'customer/crm/' || o_custkey as k from orders where o_orderdate < timestamp '1996-01-01'),
  j as (select p.*, live.k is not null as taken, min(case when not unsure then o_orderkey end) over (partition by p.k) as first from p left join live on p.k = live.k)
  select case when taken then 'DUPLICATE' when o_orderkey = first then 'RECEIVED' when unsure and (first is null or o_orderkey < first) then 'INVALID' else 'DUPLICATE' end as status, count(*) as n from j group by 1""")
def ledger_submit_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A submission of newer orders' customers to a ledger that has the older ones; low priority counts as ambiguous."""
    every = _customer_keys(table(spark, sf_dir, "orders"))
    old = every.where("o_orderdate < timestamp_ntz '1996-01-01'")
    new = every.where("o_orderdate >= timestamp_ntz '1996-01-01'")
    return ledger.admit(new, old, old, F.col("o_orderpriority") == "5-LOW").groupBy("status").agg(F.count("*").alias("n"))


_STATE = {"signup": "RECEIVED", "view": "VALIDATED", "click": "REVIEW_PENDING", "purchase": "ACCEPTED", "error": "RETRYABLE_ERROR"}
_STATE_SQL = "case event_type when 'signup' then 'RECEIVED' when 'view' then 'VALIDATED' when 'click' then 'REVIEW_PENDING' when 'purchase' then 'ACCEPTED' else 'RETRYABLE_ERROR' end"


def _states(events: DataFrame) -> DataFrame:
    state = F.lit(None).cast("string")
    for kind, name in _STATE.items():
        state = F.when(F.col("event_type") == kind, name).otherwise(state)
    retry = (F.col("event_type") == "error").cast("int")
    return events.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("cand_"), F.col("user_id")).alias("candidate_id"), F.lit("transition").alias("kind"), state.alias("to_state"), retry.alias("retry_delta"), F.col("ts").alias("at"),
        F.when(F.col("value") > 100, F.concat(F.lit("value "), F.floor("value"))).alias("quarantine_reason"),
    )


@query(f"""select 'cand_' || user_id as candidate_id, arg_max({_STATE_SQL}, event_id) as state, sum((event_type = 'error')::int)::bigint as retry_count,
  arg_max('value ' || floor(value)::bigint, event_id) filter (value > 100) as quarantine_reason from events group by 1""")
def ledger_state_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.states(_states(table(spark, sf_dir, "events"))).select("candidate_id", "state", "retry_count", "quarantine_reason")


_LEGAL_SQL = ", ".join(f"'{a}>{b}'" for a, to in ledger.LEGAL.items() for b in to)


@query(f"""with s as (select user_id, event_id, {_STATE_SQL} as to_state from events), p as (select *, lag(to_state) over (partition by user_id order by event_id) as from_state from s)
  select from_state, to_state, count(*) as n from p where from_state is not null and from_state || '>' || to_state not in ({_LEGAL_SQL}) group by 1, 2""")
def illegal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that the log has but the lifecycle forbids."""
    from pyspark.sql import Window

    changes = _states(table(spark, sf_dir, "events"))
    from_state = F.lag("to_state").over(Window.partitionBy("candidate_id").orderBy("seq"))
    pairs = changes.withColumn("from_state", from_state).where("from_state is not null")
    return pairs.where(~ledger.legal(F.col("from_state"), F.col("to_state"))).groupBy("from_state", "to_state").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- canonical graph


def _facts(events: DataFrame) -> DataFrame:
    """Each event a fact about its user that the user's next event of the kind replaces."""
    from pyspark.sql import Window

    following = F.lead("ts").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return events.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("valid_from"), following.cast("timestamp").alias("valid_to"), F.col("ts").cast("timestamp").alias("recorded_at"), following.cast("timestamp").alias("superseded_at"))


@query("""with f as (select *, lead(ts) over (partition by user_id, event_type order by ts, event_id) as nxt from events)
  select user_id, event_type, event_id from f where timestamp '2024-01-15 12:00:00' >= ts and (nxt is null or timestamp '2024-01-15 12:00:00' <= nxt)""")
def bitemporal_valid_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(table(spark, sf_dir, "events")).where(graph.valid_at(F.lit("2024-01-15 12:00:00").cast("timestamp"))).select("user_id", "event_type", "event_id")


@query("""with f as (select *, lead(ts) over (partition by user_id, event_type order by ts, event_id) as nxt from events)
  select user_id, event_type, event_id from f where ts <= timestamp '2024-01-15 12:00:00' and (nxt is null or timestamp '2024-01-15 12:00:00' < nxt)""")
def bitemporal_tx_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(table(spark, sf_dir, "events")).where(graph.known_at(F.lit("2024-01-15 12:00:00").cast("timestamp"))).select("user_id", "event_type", "event_id")


@query("""select 'as_' || o_orderkey as assertion_id, o_orderstatus as s from orders left join customer on c_custkey = o_custkey
  where (c_custkey is null or c_acctbal >= 0) and o_orderstatus <> 'F' and year(o_orderdate) <= 1997""")
def revoked_subject_shield(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as assertions about customers; who is in debt is revoked, failed orders are superseded, the year is the epoch."""
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("identity_id"), F.when(F.col("c_acctbal") < 0, "REVOKED").otherwise("ACTIVE").alias("status"))
    status = F.when(F.col("o_orderstatus") == "F", "SUPERSEDED").otherwise("ACTIVE")
    facts = table(spark, sf_dir, "orders").select(F.concat(F.lit("as_"), F.col("o_orderkey")).alias("assertion_id"), F.col("o_custkey").alias("subject_identity"), status.alias("status"), F.year("o_orderdate").alias("curation_epoch"), F.col("o_orderstatus").alias("s"))
    return graph.read_assertions(facts, people, graph.ReadOptions(epoch=1997)).select("assertion_id", "s")


@query("""with e as (select 'r' || n_regionkey as src, 'n' || n_nationkey as dst from nation union select 'n' || c_nationkey, 'c' || c_custkey from customer union select 'c' || o_custkey, 'o' || o_orderkey from orders),
  alive as (select 'n' || n_nationkey as id from nation union all select 'c' || c_custkey from customer where c_acctbal >= 0),
  h1 as (select 'r' || r_regionkey as origin, dst as id from region join e on src = 'r' || r_regionkey where dst in (select id from alive)),
  h2 as (select distinct origin, dst as id from h1 join e on src = h1.id where dst in (select id from alive))
  select origin, id as identity_id, 1 as hop from h1 union all select origin, id, 2 from h2""")
def neighborhood_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two steps reach from each region: its nations and those of their customers who aren't in debt."""
    nation, customer, orders = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    edges = nation.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"))
    edges = edges.unionByName(customer.select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst"))).unionByName(orders.select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst")))
    live = nation.select(name("n", "n_nationkey").alias("identity_id")).unionByName(customer.where("c_acctbal >= 0").select(name("c", "c_custkey").alias("identity_id")))
    return graph.neighborhood(edges, live, table(spark, sf_dir, "region").select(name("r", "r_regionkey").alias("identity_id")), 2)


@query("""select c_custkey as identity_id from customer where c_name in (select 'Customer#' || lpad(s_suppkey::varchar, 9, '0') from supplier)""")
def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers found by one of their two aliases, asked for with the suppliers' numbers."""
    ref = lambda ns, key: identity.reference(F.lit("Customer"), F.lit(ns), key)
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("identity_id"), F.array(ref("crm", F.col("c_custkey").cast("string")), ref("name", F.col("c_name"))).alias("aliases"))
    asked = table(spark, sf_dir, "supplier").select(F.lit("Customer").alias("entity_type"), F.lit("name").alias("namespace"), F.concat(F.lit("Customer#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("key"))
    return graph.find_by_alias(people, asked).select("identity_id")


# ---------------------------------------------------------------- documents


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("""with n as (select doc_id, text, length(text) as len, case when length(text) <= 500 then 0 else ceil((length(text) - 500) / 450.0)::int end as last from documents where text <> ''),
  w as (select *, unnest(range(0, last + 1)) as i from n)
  select doc_id::varchar as doc_id, i::int as index, (i * 450)::int as start, least(i * 450 + 500, len)::int as "end", sha256(substring(text, i * 450 + 1, 500)) as digest from w""")
def fixed_window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed_windows(_documents(spark, sf_dir), 500, 50).select("doc_id", "index", "start", "end", F.sha2("text", 256).alias("digest"))


def _talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents: turns between blank lines."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return chunking.documents(turns.select(F.col("conv_id").alias("doc_id"), F.concat_ws("\n\n", F.transform("t", lambda x: x["text"])).alias("text")))


@query(r"""with d as (select conv_id, string_agg(text, e'\n\n' order by turn) as text from conversations group by 1),
  p as (select conv_id, text, unnest(string_split(text, e'\n\n')) as piece, generate_subscripts(string_split(text, e'\n\n'), 1) as i, string_split(text, e'\n\n') as parts from d),
  b as (select *, coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(x) + 2)), 0) as base, trim(piece, e' \t\n\r\f\v') as bare, ltrim(piece, e' \t\n\r\f\v') as tail from p)
  select conv_id::varchar as doc_id, (row_number() over (partition by conv_id order by i) - 1)::int as index, (base + length(piece) - length(tail))::int as start,
    (base + length(piece) - length(tail) + length(bare))::int as "end", sha256(bare) as digest from b where bare <> ''""")
def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.paragraphs(_talks(spark, sf_dir)).select("doc_id", "index", "start", "end", F.sha2("text", 256).alias("digest"))


@query("""select length(text)::int as "end", count(*) as n from documents group by 1""")
def whole_document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.whole(_documents(spark, sf_dir)).groupBy("end").agg(F.count("*").alias("n"))


@query("""with q as (select item_id, text from benchmark union all select -item_id - 1, string_split(text, ' ')[1] || ' ' || string_split(text, ' ')[2] from benchmark where item_id < 20)
  select doc_id, item_id, instr(d.text, q.text) - 1 as place from documents d join q on contains(d.text, q.text)""")
def quote_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the benchmark, and the first two words of some, that stand word for word in a document."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    words = F.split("quote", " ")
    short = items.where("item_id < 20").select((-F.col("item_id") - 1).alias("item_id"), F.concat_ws(" ", words[0], words[1]).alias("quote"))
    found = completions.quoted(table(spark, sf_dir, "documents").select("doc_id", "text"), items.unionByName(short))
    return found.select("doc_id", "item_id", F.col("place").cast("long").alias("place"))


@query("""with r as (select conv_id, turn, text, length(text) as n from conversations)
  select conv_id, turn, 'item 1 quote is not an exact substring of the chunk text; quote dropped' as warning, 0 as q0, 10 as q0_end from r where n >= 10
  union all select conv_id, turn, 'item 1 quote is not an exact substring of the chunk text; quote dropped', 0, n from r where n > 0 and n < 10""")
def extraction_parse_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses made from turns: one item quotes their beginning, one something that isn't there."""
    turns = table(spark, sf_dir, "conversations").where("text <> ''")
    first = F.to_json(F.struct(F.lit("a").alias("name"), F.left("text", F.lit(10)).alias("quote"), F.lit(0.5).alias("confidence")))
    response = F.concat(F.lit('{"items":['), first, F.lit(',{"name":"b","quote":"\\u0001"}]}'))
    answered = turns.select("conv_id", "turn", "text", F.lit(0).alias("start"), response.alias("response"), F.lit(None).cast("string").alias("error"))
    items = completions.parse(answered)
    return items.select("conv_id", "turn", F.get(F.col("items")[1]["warnings"], F.lit(0)).alias("warning"), F.col("items")[0]["quote_start"].cast("long").alias("q0"), F.col("items")[0]["quote_end"].cast("long").alias("q0_end"))


# ---------------------------------------------------------------- evidence


def _citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources cite the documents of their language: a subject a source, evidence a document."""
    docs = table(spark, sf_dir, "documents")
    own = docs.select(F.concat(F.lit("source/"), F.col("source")).alias("subject_id"), F.concat(F.lit("ev_"), F.col("doc_id")).alias("evidence_id"), F.lit("DERIVED_FROM").alias("relationship"))
    lang = docs.where("n_chars > 2000").select(F.concat(F.lit("lang/"), F.col("lang")).alias("subject_id"), F.concat(F.lit("ev_"), F.col("doc_id")).alias("evidence_id"), F.lit("SUPPORTS").alias("relationship"))
    return own.unionByName(lang)


@query("""select 'ev_' || doc_id as evidence_id from documents d where d.source in ('src1', 'src2', 'src3') and not d.n_chars > 2000""")
def evidence_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What nobody cites once three sources are erased."""
    gone = spark.createDataFrame([("source/src1",), ("source/src2",), ("source/src3",)], "subject_id string")
    return evidence.orphans(_citations(spark, sf_dir), gone)


@query("""select 'ev_' || doc_id as evidence_id, case when gone then null else text end is null as redacted, 'sha256:' || sha256(text) as payload_hash
  from (select *, source in ('src1', 'src2', 'src3') and not n_chars > 2000 as gone from documents)""")
def redaction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence after the erasure of three sources: orphans lose their text and keep its hash."""
    from datetime import UTC, datetime

    gone = spark.createDataFrame([("source/src1",), ("source/src2",), ("source/src3",)], "subject_id string")
    rows = table(spark, sf_dir, "documents").select(*evidence.row("PRESENT", evidence_id=F.concat(F.lit("ev_"), F.col("doc_id")), content=F.col("text"), payload_hash=evidence.content_digest(F.col("text"))))
    out = evidence.redacted(rows, evidence.orphans(_citations(spark, sf_dir), gone), "erased", datetime(2026, 1, 1, tzinfo=UTC))
    return out.select("evidence_id", F.col("content").isNull().alias("redacted"), "payload_hash")


@query("""select 'ev_' || doc_id as evidence_id, subject_id from documents, (select unnest(['source/', 'lang/']) as p) cross join (select 1) t, lateral (select case p when 'source/' then 'source/' || source else 'lang/' || lang end as subject_id) s
  where doc_id in (select doc_id from labels where toxic = 1) and (p = 'source/' or n_chars > 2000)""")
def evidence_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who cites the documents that are labelled toxic."""
    ids = table(spark, sf_dir, "labels").where("toxic = 1").select(F.concat(F.lit("ev_"), F.col("doc_id")).alias("evidence_id"))
    return evidence.subjects(_citations(spark, sf_dir), ids)


@query("""select 'cand_' || l_orderkey || '_' || l_linenumber as subject_id, 'ev_' || o_orderkey as evidence_id, 'DERIVED_FROM' as relationship from lineitem join orders on l_orderkey = o_orderkey""")
def evidence_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates from line items to the evidence of the order that they came from, by its coordinates."""
    place = lambda c: coordinates("table", "orders", F.concat(F.lit("o_orderkey="), F.col(c).cast("string")))
    made = table(spark, sf_dir, "lineitem").select(F.concat_ws("_", F.lit("cand"), "l_orderkey", "l_linenumber").alias("candidate_id"), place("l_orderkey").alias("coord"))
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("ev_"), F.col("o_orderkey")).alias("evidence_id"), place("o_orderkey").alias("coord"))
    return evidence.link(made, rows)


@query("""select 'n_nationkey=' || n_nationkey || '&n_name=' || coalesce(case when n_regionkey > 0 then n_name end, 'None') as fragment from nation""")
def snapshot_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").withColumn("n_name", F.when(F.col("n_regionkey") > 0, F.col("n_name")))
    return rows.select(key_fragment(["n_nationkey", "n_name"], None).alias("fragment"))


# ---------------------------------------------------------------- policy, registry, review


@query("""with s as (select o_orderkey, (o_totalprice % 1000) / 1000 as e, 0.85 + (o_orderkey % 10) / 50.0 as r, case when o_custkey % 3 = 0 then null else (o_custkey % 100) / 100.0 end as i, (o_orderkey % 7) / 10.0 as k,
    case o_orderstatus when 'F' then 'NEW_IDENTITY' when 'O' then 'UNRESOLVED' else 'RESOLVED_EXISTING' end as d from orders),
  x as (select *, case when k > 0.5 then 3 when k > 0.2 then 2 else 1 end as risk, case d when 'UNRESOLVED' then false when 'NEW_IDENTITY' then i is null or i >= 0.95 else coalesce(i >= 0.95, false) end as ok from s)
  select ['AUTO', 'LLM_ASSESS', 'HUMAN'][greatest(risk, case when e >= 0.95 and r >= 0.90 and ok then 1 when e >= 0.80 then 2 else 3 end)] as route, d as disposition, count(*) as n from x group by 1, 2""")
def route_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' numbers as scores, routed."""
    o = table(spark, sf_dir, "orders")
    scores = F.struct(
        ((F.col("o_totalprice") % 1000) / 1000).alias("extraction_confidence"), (F.lit(0.85) + (F.col("o_orderkey") % 10) / F.lit(50.0)).alias("source_reliability"),
        F.when(F.col("o_custkey") % 3 != 0, (F.col("o_custkey") % 100) / F.lit(100.0)).alias("identity_confidence"), ((F.col("o_orderkey") % 7) / F.lit(10.0)).alias("policy_risk"),
    )
    found = F.when(F.col("o_orderstatus") == "F", policy.NEW).when(F.col("o_orderstatus") == "O", policy.UNRESOLVED).otherwise(policy.RESOLVED)
    return o.select(policy.route(policy.Policy(), scores, found).alias("route"), found.alias("disposition")).groupBy("route", "disposition").agg(F.count("*").alias("n"))


@query("""select 'user' || user_id as name, max(event_id) as version, arg_max(event_type, event_id) as domain from events group by 1""")
def registry_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("user"), F.col("user_id")).alias("name"), F.col("event_id").alias("version"), F.col("event_type").alias("domain"))
    return registry.latest(rows)


@query("""with g as (select 'nation' || c_nationkey as name, list_distinct(list(c_mktsegment)) as terms, case when c_nationkey % 2 = 0 then 'crm' else 'erp' end as auth from customer where c_acctbal > 8000 group by c_nationkey),
  p as (select 'seg' || n_nationkey as pid, list_distinct(list(c_mktsegment)) as terms, case when n_nationkey % 3 = 0 then null else 'crm' end as auth from nation join customer on c_nationkey = n_nationkey where c_acctbal < 1000 group by n_nationkey),
  s as (select pid, name, case when p.auth is null then null else (p.auth = g.auth)::int::double end as i, len(list_intersect(p.terms, g.terms)) / len(list_distinct(p.terms || g.terms))::double as o from p, g),
  a as (select *, case when i is null then o else (i + o) / 2 end as agg, case when i is null then 1 else 2 end as scored from s),
  b as (select *, row_number() over (partition by pid order by agg desc, name || chr(1114111)) as rn from a)
  select pid as profile_id, name as graph_name, scored::int as scored, round(agg, 6) as aggregate, case when scored < 2 then 'INSUFFICIENT_INFORMATION' when agg >= 0.75 then 'EXTEND_SAME_PHYSICAL' when i >= 0.6 then 'SEPARATE_SHARED_IDENTITY' else 'FULLY_ISOLATED' end as outcome from b where rn = 1""")
def advisor_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market segments of nations' customers as vocabularies: poor customers' profiles against rich ones' graphs."""
    people = table(spark, sf_dir, "customer")
    empty = F.array().cast("array<string>")
    authority = lambda c: F.create_map(F.lit(registry.AUTHORITY), c)
    graphs = people.where("c_acctbal > 8000").groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("node_types"))
    graphs = graphs.select(F.concat(F.lit("nation"), F.col("c_nationkey")).alias("name"), "node_types", empty.alias("edge_types"), authority(F.when(F.col("c_nationkey") % 2 == 0, "crm").otherwise("erp")).alias("attributes"))
    poor = people.where("c_acctbal < 1000").groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("node_types"))
    none, unknown = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    profiles = poor.select(
        F.concat(F.lit("seg"), F.col("c_nationkey")).alias("profile_id"), F.when(F.col("c_nationkey") % 3 != 0, "crm").alias("identity_authority"), "node_types", empty.alias("edge_types"), empty.alias("attribute_types"),
        none.alias("tenancy_class"), none.alias("lifecycle_class"), none.alias("retention_class"), unknown.alias("contains_minors_data"), unknown.alias("is_computed_output"),
    )
    return registry.advise(profiles, graphs).select("profile_id", "graph_name", "scored", F.round("aggregate", 6).alias("aggregate"), "outcome")


@query("""with q as (select user_id, min(event_id) as first, arg_min(event_type, event_id) as priority from events where event_type <> 'signup' group by 1), r as (select distinct user_id from events where event_type = 'signup' and value > 95)
  select 'user' || user_id as item_id, first as enqueue_seq, priority from q where user_id not in (select user_id from r) order by first limit 50""")
def review_queue_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("item_id", F.concat(F.lit("user"), F.col("user_id")))
    asked = events.where("event_type <> 'signup'").select("item_id", F.col("event_id").alias("enqueue_seq"), F.col("event_type").alias("priority"))
    return registry.pending(asked, events.where("event_type = 'signup' and value > 95").select("item_id"), 50)


# ---------------------------------------------------------------- evaluation


def _arms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, gold, arms): labels say which documents are good and which toxic; one arm names long documents, one all of a language, twice if toxic words abound."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    gold = labels.where("quality = 1").select(F.lit("entity").alias("category"), F.col("doc_id").alias("match_key"), F.col("doc_id").alias("gold_idx"))
    gold = gold.unionByName(labels.where("toxic = 1").select(F.lit("relation").alias("category"), F.col("doc_id").alias("match_key"), F.col("doc_id").alias("gold_idx")))
    made = lambda arm, category, rows, shift: rows.select(F.lit(arm).alias("arm_id"), F.lit(category).alias("category"), F.col("doc_id").alias("match_key"), (F.col("doc_id") * 4 + shift).alias("ord"))
    every = made("long", "entity", docs.where("n_chars > 1000"), 0).unionByName(made("english", "entity", docs.where("lang = 'en'"), 0)).unionByName(made("english", "entity", docs.where("lang = 'en' and n_chars > 2000"), 1)).unionByName(made("english", "relation", docs.where("lang = 'en' and n_chars < 500"), 2))
    arms = spark.createDataFrame([("long",), ("english",)], "arm_id string")
    return every, gold, arms


_ARMS_SQL = """c as (select 'long' as arm, 'entity' as cat, doc_id as k, doc_id * 4 as o from documents where n_chars > 1000 union all select 'english', 'entity', doc_id, doc_id * 4 from documents where lang = 'en'
    union all select 'english', 'entity', doc_id, doc_id * 4 + 1 from documents where lang = 'en' and n_chars > 2000 union all select 'english', 'relation', doc_id, doc_id * 4 + 2 from documents where lang = 'en' and n_chars < 500),
  g as (select 'entity' as cat, doc_id as k from labels where quality = 1 union all select 'relation', doc_id from labels where toxic = 1)"""


@query(f"""with {_ARMS_SQL}, a as (select unnest(['long', 'english']) as arm), t as (select unnest(['entity', 'relation', 'attribute']) as cat),
  n as (select arm, cat, count(*) as n, count(distinct case when (cat, k) in (select (cat, k) from g) then k end) as tp from c group by 1, 2), z as (select cat, count(*) as gold from g group by 1),
  x as (select a.arm, t.cat, coalesce(tp, 0) as tp, coalesce(n, 0) as n, coalesce(gold, 0) as gold from a cross join t left join n on n.arm = a.arm and n.cat = t.cat left join z on z.cat = t.cat),
  y as (select *, tp / nullif(n, 0)::double as p, tp / nullif(gold, 0)::double as r from x)
  select arm as arm_id, cat as category, tp, n - tp as fp, gold - tp as fn, round(p, 9) as precision, round(r, 9) as recall, round(case when p is null or r is null then null when p + r = 0 then 0 else 2 * p * r / (p + r) end, 9) as f1 from y""")
def prf_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, gold, arms = _arms(spark, sf_dir)
    out = evaluation.prf(evaluation.matched(made, gold), gold, arms)
    return out.select("arm_id", "category", "tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query(f"""with {_ARMS_SQL}, h as (select arm, cat, k from c group by 1, 2, 3)
  select cat as category, k as gold_idx, ((select count(*) from h where arm = 'english' and h.cat = g.cat and h.k = g.k) - (select count(*) from h where arm = 'long' and h.cat = g.cat and h.k = g.k))::double as diff from g""")
def paired_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, gold, arms = _arms(spark, sf_dir)
    hits = evaluation.gold_hits(evaluation.matched(made, gold), gold, arms)
    return evaluation.paired(hits, "long", "english")


def _cited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as candidates that cite two line items each; late ones support, others derive, and some evidence is absent."""
    line = table(spark, sf_dir, "lineitem")
    relationship = F.when(F.col("l_returnflag") == "R", "SUPPORTS").when(F.col("l_returnflag") == "A", "DERIVED_FROM").otherwise("CONTEXTUALIZES")
    refs = line.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.concat_ws("_", F.lit("ev"), "l_partkey").alias("evidence_id"), relationship.alias("relationship"))).alias("evidence_refs"))
    made = table(spark, sf_dir, "orders").join(refs, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderstatus").alias("arm_id"), F.col("o_orderkey").alias("ord"), "evidence_refs")
    parts = table(spark, sf_dir, "part").where("p_size > 5")
    have = F.when(F.col("p_size") > 25, "PRESENT").otherwise("ABSENT")
    rows = parts.select(F.explode(F.array(F.lit("P"), F.lit("O"), F.lit("F"))).alias("arm_id"), F.concat_ws("_", F.lit("ev"), "p_partkey").alias("evidence_id"), have.alias("availability"), F.lit("part").alias("source_locator"), F.col("p_name").alias("content"), F.struct(F.lit(0).alias("start"), F.col("p_size").alias("end")).alias("span"))
    return made, rows


@query("""with r as (select o_orderstatus as arm, o_orderkey as o, l_returnflag as f, p_partkey is not null as found, coalesce(p_size > 25, false) as present from orders left join lineitem on l_orderkey = o_orderkey left join (select * from part where p_size > 5) on p_partkey = l_partkey),
  c as (select arm, o, bool_or(present and f in ('R', 'A')) as g, bool_or(present and f = 'R') as v, count(f) as refs, count(*) filter (f is not null and found) as res from r group by 1, 2)
  select arm as arm_id, count(*) filter (not coalesce(g, false)) as ungrounded, count(*) filter (not coalesce(v, false)) as unverified, sum(refs)::bigint as total_refs, sum(res)::bigint as resolvable_refs from c group by 1""")
def grounding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, rows = _cited(spark, sf_dir)
    links = evaluation.cited(made, rows)
    refs = links.groupBy("arm_id").agg(F.count("*").alias("total_refs"), F.count_if("found").alias("resolvable_refs"))
    return evaluation.grounding(made, links).join(refs, "arm_id")


@query("""with chunk as (select doc_id, unnest(range(0, case when length(text) <= 500 then 1 else ceil((length(text) - 500) / 450.0)::int + 1 end)) as i, length(text) as len from documents where text <> ''),
  hit as (select doc_id, item_id, instr(d.text, b.text) - 1 as s, instr(d.text, b.text) - 1 + length(b.text) as e from documents d join benchmark b on contains(d.text, b.text)),
  j as (select hit.doc_id, hit.item_id, bool_or(s >= i * 450 and e <= least(i * 450 + 500, len) or contains(substring(d.text, i * 450 + 1, 500), b.text)) as covered, bool_or(i * 450 < e and s < least(i * 450 + 500, len)) as meets from hit join chunk on chunk.doc_id = hit.doc_id join documents d on d.doc_id = hit.doc_id join benchmark b on b.item_id = hit.item_id group by 1, 2)
  select 'a' as arm_id, count(*) as checked, count(*) filter (covered) as covered, count(*) as with_offsets, count(*) filter (meets) as overlapping from j""")
def span_overlap_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold spans are where items stand in documents; each candidate cites all of its document's chunks."""
    bench = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    hits = completions.quoted(table(spark, sf_dir, "documents").select("doc_id", "text"), bench).join(bench, "item_id")
    key = F.concat_ws(":", "doc_id", "item_id")
    gold = hits.select(F.lit("entity").alias("category"), key.alias("match_key"), key.alias("gold_idx"), F.concat(F.lit("doc/"), F.col("doc_id")).alias("source_locator"), "quote", F.col("place").cast("int").alias("start"), (F.col("place") + F.length("quote")).cast("int").alias("end"))
    ids = hits.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
    chunks = chunking.fixed_windows(_documents(spark, sf_dir).join(ids, "doc_id", "left_semi"), 500, 50)
    chunk_id = F.concat(F.lit("ev_"), F.col("doc_id"), F.lit("_"), F.col("index"))
    rows = chunks.select(F.lit("a").alias("arm_id"), chunk_id.alias("evidence_id"), F.lit("PRESENT").alias("availability"), F.concat(F.lit("doc/"), F.col("doc_id")).alias("source_locator"), F.col("text").alias("content"), F.struct("start", "end").alias("span"))
    refs = chunks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.collect_list(F.struct(chunk_id.alias("evidence_id"), F.lit("DERIVED_FROM").alias("relationship"))).alias("refs"))
    made = hits.join(refs, "doc_id").select(F.lit("a").alias("arm_id"), F.lit("entity").alias("category"), key.alias("match_key"), (F.col("doc_id") * 100000 + F.col("item_id")).alias("ord"), F.col("refs").alias("evidence_refs"))
    return evaluation.span_checks(evaluation.matched(made, gold), gold, evaluation.cited(made, rows))


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of both arms' recall, drawn by hashes."""
    made, gold, arms = _arms(spark, sf_dir)
    hits = evaluation.gold_hits(evaluation.matched(made, gold), gold, arms).withColumnRenamed("gold_idx", "item")
    return evaluation.bootstrap(hits, evaluation.Bootstrap(seed=7, resamples=200), ["arm_id", "category"], "hit")


@query()
def stable_candidate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all customers, the same in every run."""
    keys = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer/crm/"), F.col("c_custkey")).alias("semantic_key"))
    return keys.withColumn("candidate_id", identity.candidate_id(F.lit("crm"), F.lit("entity"), F.col("semantic_key")))


@query("""select c_mktsegment as segment, 'Customer' as entity_type, 'crm' as namespace, c_custkey || ':' || c_name as key, null::varchar as error from customer
  union all select c_mktsegment, null, null, null, 'namespace missing' from customer""")
def reference_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References written and read back; one with two parts lacks its namespace."""
    people = table(spark, sf_dir, "customer")
    good = people.select(F.col("c_mktsegment").alias("segment"), F.concat(F.lit("Customer:crm:"), F.col("c_custkey"), F.lit(":"), F.col("c_name")).alias("s"))
    bad = people.select(F.col("c_mktsegment").alias("segment"), F.concat(F.lit("Customer:"), F.col("c_custkey")).alias("s"))
    return good.unionByName(bad).select("segment", identity.parse(F.col("s")).alias("p")).select("segment", "p.ref.entity_type", "p.ref.namespace", "p.ref.key", "p.error")


@query("""select doc_id, trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || ' ' || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)) as bare
  from (select doc_id, case doc_id % 3 when 0 then text when 1 then chr(9) || ' ' || text || chr(12288) || chr(10) else chr(160) || chr(8195) || text || chr(28) end as text from documents)""")
def strip_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents with white space of many kinds around them, stripped."""
    third = F.col("doc_id") % 3
    padded = F.when(third == 0, F.col("text")).when(third == 1, F.concat(F.lit("\t "), F.col("text"), F.lit("\u3000\n"))).otherwise(F.concat(F.lit("\xa0\u2003"), F.col("text"), F.lit("\x1c")))
    return table(spark, sf_dir, "documents").select("doc_id", text.strip(padded).alias("bare"))


@query("""select case when o_orderpriority = '5-LOW' then 'without a winner a conflict is unresolved' when o_custkey % 2 = 0 and o_orderstatus <> 'F' then 'the winner is one of the assertions' end as violation, count(*) as n from orders group by 1""")
def conflict_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as conflicts between two assertions, some with a winner from elsewhere, some resolved without one."""
    o = table(spark, sf_dir, "orders")
    low, stray = F.col("o_orderpriority") == "5-LOW", (F.col("o_custkey") % 2 == 0) & (F.col("o_orderstatus") != "F")
    ids = F.array(F.lit("as_a"), F.lit("as_b"))
    rows = o.select(ids.alias("assertion_ids"), F.when(~low, F.when(stray, "as_c").otherwise("as_a")).alias("preferred_assertion_id"), F.lit("RESOLVED").alias("status"))
    return rows.groupBy(shapes.conflict_record().alias("violation")).agg(F.count("*").alias("n"))


@query("""with s as (select 'ev_' || o_custkey as id, max(o_orderkey) as k, bool_or(o_orderstatus = 'F') as red, max(o_orderkey) filter (o_orderstatus = 'F') as kred from orders where o_orderdate < timestamp '1998-01-01' group by 1),
  n as (select 'ev_' || o_custkey as id, max(o_orderkey) as k from orders where o_orderdate >= timestamp '1998-01-01' group by 1)
  select coalesce(s.id, n.id) as evidence_id, case when s.red then 'old' when n.id is not null then 'new' else 'old' end as version, coalesce(s.red, false) as redacted from s full join n on s.id = n.id""")
def evidence_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newer evidence replaces older of the same id, unless that was redacted."""
    o = table(spark, sf_dir, "orders").withColumn("id", F.concat(F.lit("ev_"), F.col("o_custkey")))
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    marked = F.when(F.max(F.col("o_orderstatus") == "F"), F.lit("2026-01-01").cast("timestamp"))
    old = o.where(early).groupBy("id").agg(marked.alias("at"))
    new = o.where(~early).select("id").distinct().withColumn("at", F.lit(None).cast("timestamp"))
    rows = lambda frame, version: frame.select(*evidence.row("PRESENT", evidence_id=F.col("id"), payload_hash=F.lit(version), redacted_at=F.col("at")))
    out = evidence.upsert(rows(old, "old"), rows(new, "new"))
    return out.select("evidence_id", F.col("payload_hash").alias("version"), F.col("redacted_at").isNotNull().alias("redacted"))


@query("""select distinct 'source/' || source as subject_id, 'ev_' || doc_id as evidence_id from documents where n_chars <= 2000""")
def evidence_new_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations that aren't stored yet, each once: long documents are cited already, and everything is asked for twice."""
    docs = table(spark, sf_dir, "documents")
    every = docs.select(F.concat(F.lit("source/"), F.col("source")).alias("subject_id"), F.concat(F.lit("ev_"), F.col("doc_id")).alias("evidence_id"), F.lit("SUPPORTS").alias("relationship"), "n_chars")
    asked = every.drop("n_chars")
    return evidence.add_refs(every.where("n_chars > 2000").drop("n_chars"), asked.unionByName(asked)).select("subject_id", "evidence_id")


@query("""select 'word/x/' || w as semantic_key, min(item_id) as first_item, 0.5::double as confidence from (select item_id, string_split(trim(text), ' ')[1] as w from benchmark) where w <> '' group by 1""")
def extraction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item of the benchmark read by a fixed model that names its first word: the first document of a word is its source."""
    from loomgraph.plans.extraction import DocumentPipeline, Extractor

    docs = chunking.documents(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text").orderBy("item_id"))
    extractor = Extractor("words", "First word of {text}", [Field("name")], Entity("x", "name", "Word"), candidates.Scoring(0.9))

    def answer(asked: DataFrame) -> DataFrame:
        word = F.get(F.split(F.trim("text"), " "), F.lit(0))
        return asked.withColumns({"response": F.to_json(F.array(F.struct(word.alias("name"), word.alias("quote"), F.lit(0.5).alias("confidence")))), "error": F.lit(None).cast("string")})

    pipeline = DocumentPipeline("g", docs, chunking.whole, [extractor], answer, deterministic=True, run_id="r")
    rows = pipeline.admitted(pipeline.built(pipeline.parsed())[0]).where("disposition = 'admitted'")
    return rows.select("semantic_key", F.col("chunk.doc_id").cast("long").alias("first_item"), F.col("chunk.item.confidence").alias("confidence"))


from loomgraph.plans import stateful  # noqa: E402, F401  it registers more queries here
