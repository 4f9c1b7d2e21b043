"""Grading of extraction output against gold sets, all arms in one pass.

Candidates have arm_id, ord (their place in the arm's stream), category and
match_key; gold has category, match_key, gold_idx, and where its support should
lie. What can't be measured is NULL with a note, never zero.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CATEGORIES = ("entity", "relation", "attribute")
GROUNDS = ("SUPPORTS", "DERIVED_FROM")


# ---------------------------------------------------------------- keys


def norm_json(value: Column) -> Column:
    """A JSON value for comparison: texts as they are, all else as compact JSON, so 200 equals "200"."""
    plain = F.try_variant_get(F.try_parse_json(value), "$", "string")
    return F.when(F.startswith(F.ltrim(value), F.lit('"')), plain).otherwise(F.to_json(F.try_parse_json(value)))


def match_key(*parts: Column) -> Column:
    """Parts joined by a character that they don't hold."""
    return F.concat_ws("\u001f", *parts)


def keyed(candidates: DataFrame) -> DataFrame:
    """Candidates with category and match_key; kinds that aren't graded are left out."""
    category = F.when(F.col("kind") == "entity", "entity").when(F.col("kind") == "relation", "relation").when(F.col("kind") == "attribute_assertion", "attribute")
    key = (
        F.when(category == "entity", match_key(F.col("entity_type"), F.col("semantic_key")))
        .when(category == "relation", match_key(F.col("relation_type"), F.col("subject"), F.col("object")))
        .when(category == "attribute", match_key(F.col("subject"), F.col("attribute"), norm_json(F.col("value"))))
    )
    return candidates.withColumns({"category": category, "match_key": key}).where("category is not null")


# ---------------------------------------------------------------- gold sets

SPAN = "evidence:struct<source_locator:string,quote:string,start:int,`end`:int>"
GOLD = "gold_set_id string, attempted int, entities array<struct<entity_type:string,semantic_key:string," + SPAN + ">>, relations array<struct<relation_type:string,subject:string,object:string," + SPAN + ">>, attributes array<struct<subject:string,attribute:string,value:string," + SPAN + ">>"
ITEMS = "gold_set_id string, category string, gold_idx int, match_key string, source_locator string, quote string, start int, end int"


def gold_from_json(spark: SparkSession, path: str) -> DataFrame:
    """The items of gold sets in JSON files, one set a file."""
    sets = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    return gold_items(sets)


def gold_items(sets: DataFrame) -> DataFrame:
    """A row an item from a frame of variants v."""
    get = lambda v, at, kind="string": F.try_variant_get(v, at, kind)
    parts = {
        "entity": ("$.entities", lambda i: match_key(get(i, "$.entity_type"), get(i, "$.semantic_key"))),
        "relation": ("$.relations", lambda i: match_key(get(i, "$.relation_type"), get(i, "$.subject"), get(i, "$.object"))),
        "attribute": ("$.attributes", lambda i: match_key(get(i, "$.subject"), get(i, "$.attribute"), F.coalesce(norm_json(F.to_json(get(i, "$.value", "variant"))), F.lit("null")))),
    }
    out = None
    for category, (at, key) in parts.items():
        items = sets.select(get(F.col("v"), "$.gold_set_id").alias("gold_set_id"), F.posexplode(get(F.col("v"), at, "array<variant>")).alias("gold_idx", "i"))
        rows = items.select(
            "gold_set_id", F.lit(category).alias("category"), "gold_idx", key(F.col("i")).alias("match_key"), get(F.col("i"), "$.evidence.source_locator").alias("source_locator"),
            get(F.col("i"), "$.evidence.quote").alias("quote"), get(F.col("i"), "$.evidence.start", "int").alias("start"), get(F.col("i"), "$.evidence.end", "int").alias("end"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def repeated_gold(gold: DataFrame) -> DataFrame:
    """Keys that two items of a category share: the second could never be found."""
    return gold.groupBy("category", "match_key").count().where("count > 1")


def gold_hash(gold: DataFrame) -> str:
    """A digest of a gold set's labels, for driver-sized sets."""
    rows = sorted((tuple(str(x) for x in r) for r in gold.select("category", "gold_idx", "match_key", "source_locator", "quote", "start", "end").collect()))
    return hashlib.sha256(json.dumps(rows, separators=(",", ":")).encode()).hexdigest()


# ---------------------------------------------------------------- matching


def matched(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """The candidates with gold_idx and hit. One candidate an item: the first of its key in an arm; the rest count as wrong.

    The first is found by an aggregate, which combines before the shuffle, so a
    key that an arm repeats without end is no burden.
    """
    first = candidates.groupBy("arm_id", "category", "match_key").agg(F.min("ord").alias("__first"))
    hits = first.join(gold.select("category", "match_key", "gold_idx"), ["category", "match_key"]).select("arm_id", "category", F.col("__first").alias("ord"), "gold_idx")
    return candidates.join(hits, ["arm_id", "category", "ord"], "left").withColumn("hit", F.col("gold_idx").isNotNull())


def gold_hits(match: DataFrame, gold: DataFrame, arms: DataFrame) -> DataFrame:
    """(arm_id, category, gold_idx, hit 0.0 or 1.0) for every arm and item."""
    every = arms.select("arm_id").distinct().join(gold.select("category", "gold_idx"))  # each arm answers for each item
    found = match.where("hit").select("arm_id", "category", "gold_idx", F.lit(1.0).alias("h"))
    return every.join(found, ["arm_id", "category", "gold_idx"], "left").select("arm_id", "category", "gold_idx", F.coalesce("h", F.lit(0.0)).alias("hit"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is NULL or zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def f1(p: Column, r: Column) -> Column:
    return F.when(p.isNull() | r.isNull(), None).when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def prf(match: DataFrame, gold: DataFrame, arms: DataFrame) -> DataFrame:
    """(arm_id, category, tp, fp, fn, precision, recall, f1, notes) for every arm and category."""
    categories = F.explode(F.array(*(F.lit(c) for c in CATEGORIES)))
    grid = arms.select("arm_id").distinct().select("arm_id", categories.alias("category"))
    made = match.groupBy("arm_id", "category").agg(F.count("*").alias("n"), F.count_if("hit").alias("tp"))
    size = gold.groupBy("category").agg(F.count("*").alias("g"))
    rows = grid.join(made, ["arm_id", "category"], "left").join(F.broadcast(size), "category", "left").fillna(0, ["n", "tp", "g"])
    p, r = ratio(F.col("tp"), F.col("n")), ratio(F.col("tp"), F.col("g"))
    return rows.select(
        "arm_id", "category", "tp", (F.col("n") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"), p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"),
        F.when(p.isNull(), F.concat(F.lit("no "), F.col("category"), F.lit(" candidates produced"))).alias("precision_note"), F.when(r.isNull(), F.concat(F.lit("no "), F.col("category"), F.lit(" gold items"))).alias("recall_note"),
    )


# ---------------------------------------------------------------- evidence


def cited(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """A row a citation: arm_id, ord, evidence_id, relationship, found, present, and the evidence's locator, content and span."""
    refs = candidates.select("arm_id", "ord", F.explode("evidence_refs").alias("r")).select("arm_id", "ord", "r.evidence_id", "r.relationship")
    known = evidence.select("arm_id", "evidence_id", F.lit(True).alias("found"), (F.col("availability") == "PRESENT").alias("present"), F.col("source_locator").alias("locator"), "content", F.col("span.start").alias("s"), F.col("span.end").alias("e"))
    return refs.join(known, ["arm_id", "evidence_id"], "left").fillna(False, ["found", "present"])


def grounding(candidates: DataFrame, citations: DataFrame) -> DataFrame:
    """(arm_id, ungrounded, unverified): candidates without present support or derivation, and without present support."""
    have = citations.where("present").groupBy("arm_id", "ord").agg(F.max(F.col("relationship").isin(*GROUNDS)).alias("grounded"), F.max(F.col("relationship") == "SUPPORTS").alias("verified"))
    joined = candidates.select("arm_id", "ord").join(have, ["arm_id", "ord"], "left")
    no = lambda c: F.count_if(~F.coalesce(F.col(c), F.lit(False)))
    return joined.groupBy("arm_id").agg(no("grounded").alias("ungrounded"), no("verified").alias("unverified"))


def span_checks(match: DataFrame, gold: DataFrame, citations: DataFrame) -> DataFrame:
    """(arm_id, checked, covered, with_offsets, overlapping) over matched items that say where their support lies.

    Covered: present evidence at the same place holds the quote, if there is one.
    Overlapping: its half-open span meets the item's.
    """
    pairs = match.where("hit").join(gold.where("source_locator is not null").select("category", "gold_idx", "source_locator", "quote", "start", "end"), ["category", "gold_idx"])
    near = pairs.select("arm_id", "ord", "category", "source_locator", "quote", "start", "end").join(citations.where("present").select("arm_id", "ord", "locator", "content", "s", "e"), ["arm_id", "ord"], "left")
    at = F.col("locator") == F.col("source_locator")
    covers = at & (F.col("quote").isNull() | F.contains("content", "quote"))
    meets = at & (F.col("s") < F.col("end")) & (F.col("start") < F.col("e"))
    sound = F.col("start").isNotNull() & F.col("end").isNotNull()
    yes = lambda c: F.max(F.coalesce(c, F.lit(False)))
    each = near.groupBy("arm_id", "ord", "category").agg(yes(covers).alias("covered"), yes(meets).alias("meets"), yes(sound).alias("offsets"))
    return each.groupBy("arm_id").agg(F.count("*").alias("checked"), F.count_if("covered").alias("covered"), F.count_if("offsets").alias("with_offsets"), F.count_if(F.col("offsets") & F.col("meets")).alias("overlapping"))


def scorecard(candidates: DataFrame, gold: DataFrame, evidence: DataFrame, arms: DataFrame, ontology=None) -> DataFrame:
    """One row an arm with everything: prf of each category, evidence, hallucinations, violations, rates.

    arms: arm_id, attempted, abstained, failed, cost_usd, latency_seconds. attempted
    falls back to the gold set's, given as a column gold_attempted if there is one.
    """
    own = keyed(candidates) if "category" not in candidates.columns else candidates
    match = matched(own, gold)
    parts = prf(match, gold, arms)
    wide = parts.groupBy("arm_id").agg(*(F.max(F.when(F.col("category") == c, F.col(m))).alias(f"{c}_{m}") for c in CATEGORIES for m in ("tp", "fp", "fn", "precision", "recall", "f1")), F.sum("fp").alias("hallucinations"))
    links = cited(candidates, evidence)
    refs = links.groupBy("arm_id").agg(F.count("*").alias("total_refs"), F.count_if("found").alias("resolvable_refs"))
    attempted = F.coalesce("attempted", "gold_attempted") if "gold_attempted" in arms.columns else F.col("attempted")
    base = arms.withColumns({"__attempted": attempted, "abstention_rate": ratio(F.col("abstained"), attempted), "failure_rate": ratio(F.col("failed"), attempted)}).drop("__attempted")
    out = base.join(wide, "arm_id", "left").join(refs, "arm_id", "left").join(span_checks(match, gold, links), "arm_id", "left").join(grounding(candidates, links), "arm_id", "left")
    out = out.fillna(0, ["total_refs", "resolvable_refs", "checked", "covered", "with_offsets", "overlapping", "ungrounded", "unverified"])
    out = out.withColumns({"resolvable_rate": ratio(F.col("resolvable_refs"), F.col("total_refs")), "span_coverage_rate": ratio(F.col("covered"), F.col("checked")), "span_overlap_rate": ratio(F.col("overlapping"), F.col("with_offsets"))})
    if ontology is None:
        return out.withColumn("ontology_violations", F.lit(None).cast("long"))
    from loomgraph.operators.validate import ontology_reasons

    bad = candidates.where(F.size(ontology_reasons(ontology)) > 0).groupBy("arm_id").agg(F.count("*").alias("ontology_violations"))
    return out.join(bad, "arm_id", "left").fillna(0, ["ontology_violations"])


# ---------------------------------------------------------------- bootstrap


@dataclass(frozen=True)
class Bootstrap:
    seed: int
    resamples: int = 1000
    level: float = 0.95
    min_items: int = 8


def bootstrap_exact(items: DataFrame, config: Bootstrap, group: Sequence[str], order: str, value: str) -> DataFrame:
    """A percentile interval of the mean for each group, drawn with Python's seeded generator over items in order; one group is one arm's items of a gold set.

    NULL bounds under min_items.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        from random import Random

        rows = rows.sort_values(order)
        values = rows[value].tolist()
        n = len(values)
        head = {g: [rows[g].iloc[0]] for g in group}
        if n < config.min_items:
            return pd.DataFrame(head | {"point": [None], "lower": [None], "upper": [None], "n_items": [n]})
        draw = Random(config.seed)
        means = sorted(sum(values[draw.randrange(n)] for _ in range(n)) / n for _ in range(config.resamples))

        def at(share: float) -> float:
            rank = share * (len(means) - 1)
            low = int(rank)
            high = min(low + 1, len(means) - 1)
            return means[low] * (1 - (rank - low)) + means[high] * (rank - low)

        tail = (1 - config.level) / 2
        return pd.DataFrame(head | {"point": [sum(values) / n], "lower": [at(tail)], "upper": [at(1 - tail)], "n_items": [n]})

    kinds = {f.name: f.dataType.simpleString() for f in items.schema.fields}
    schema = ", ".join([*(f"{g} {kinds[g]}" for g in group), "point double", "lower double", "upper double", "n_items long"])
    return items.groupBy(*group).applyInPandas(run, schema)


def bootstrap(items: DataFrame, config: Bootstrap, group: Sequence[str], value: str) -> DataFrame:
    """The same for any number of items, in DataFrame operations: each item takes part in each resample with a Poisson(1) weight drawn from a hash, and the sums combine before they move.

    Its draws differ from bootstrap_exact's. items need a column item that is unique in its group.
    """
    cuts = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253]
    drawn = items.select(*group, F.col(value).alias("v"), F.col("item"), F.explode(F.sequence(F.lit(0), F.lit(config.resamples - 1))).alias("b"))
    unit = F.pmod(F.xxhash64(F.lit(config.seed), *group, "item", "b"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    weight = F.aggregate(F.array(*(F.lit(c) for c in cuts)), F.lit(0), lambda n, c: n + (unit >= c).cast("int"))
    sums = drawn.withColumn("w", weight).groupBy(*group, "b").agg(F.sum(F.col("w") * F.col("v")).alias("s"), F.sum("w").alias("n"))
    tail = (1 - config.level) / 2
    bounds = sums.groupBy(*group).agg(F.percentile(F.try_divide("s", "n"), F.lit(tail)).alias("lower"), F.percentile(F.try_divide("s", "n"), F.lit(1 - tail)).alias("upper"))
    points = items.groupBy(*group).agg(F.avg(value).alias("point"), F.count("*").alias("n_items"))
    enough = F.col("n_items") >= config.min_items
    return points.join(bounds, list(group)).select(*group, F.when(enough, F.col("point")).alias("point"), F.when(enough, F.col("lower")).alias("lower"), F.when(enough, F.col("upper")).alias("upper"), "n_items")


def paired(hits: DataFrame, baseline: str, enhanced: str) -> DataFrame:
    """(category, gold_idx, diff): the enhanced arm's hit less the baseline's, item by item."""
    own = lambda arm, name: hits.where(F.col("arm_id") == arm).select("category", "gold_idx", F.col("hit").alias(name))
    return own(baseline, "a").join(own(enhanced, "b"), ["category", "gold_idx"]).select("category", "gold_idx", (F.col("b") - F.col("a")).alias("diff"))


# ---------------------------------------------------------------- ablation


def concerns(base: str = "b", enhanced: str = "e") -> Column:
    """array<string>: guardrails that the enhanced arm's scorecard (struct) breaks. Cost and latency only count where both are measured."""
    b, e = F.col(base), F.col(enhanced)
    rose = lambda name, words: F.when(e[name] > b[name], F.concat(F.lit(f"{words} rose "), b[name].cast("string"), F.lit(" to "), e[name].cast("string")))
    return F.array_compact(F.array(rose("hallucinations", "hallucinations"), rose("ungrounded", "ungrounded assertions"), rose("cost_usd", "cost"), rose("latency_seconds", "latency")))


def verdict(metric: str, base: Column, enhanced: Column, lower: Column, upper: Column, n_items: Column, config: Bootstrap, guard: Column) -> Column:
    """IMPROVEMENT, NO_IMPROVEMENT, REGRESSION or INSUFFICIENT_EVIDENCE. Only recalls have a paired signal."""
    return (
        F.when(base.isNull() | enhanced.isNull(), "INSUFFICIENT_EVIDENCE")
        .when(F.lit(not metric.endswith(".recall")), "INSUFFICIENT_EVIDENCE")
        .when(n_items.isNull() | (n_items < config.min_items), "INSUFFICIENT_EVIDENCE")
        .when(upper < 0, "REGRESSION")
        .when((lower > 0) & (F.size(guard) > 0), "NO_IMPROVEMENT")
        .when(lower > 0, "IMPROVEMENT")
        .otherwise("NO_IMPROVEMENT")
    )


def compare(cards: DataFrame, hits: DataFrame, baseline: str, enhanced: str, metric: str, config: Bootstrap) -> DataFrame:
    """One row: metric, both values, the interval of the paired difference, guardrail concerns and the verdict."""
    category, name = metric.split(".")
    column = f"{category}_{name}"
    own = lambda arm, as_: cards.where(F.col("arm_id") == arm).select(F.struct(*cards.columns).alias(as_))
    diffs = paired(hits, baseline, enhanced).where(F.col("category") == category)
    interval = bootstrap_exact(diffs, config, ["category"], "gold_idx", "diff")
    both = own(baseline, "b").join(own(enhanced, "e")).join(interval, F.lit(True), "left")  # one row each
    out = both.withColumn("concerns", concerns())
    judged = verdict(metric, F.col(f"b.{column}"), F.col(f"e.{column}"), F.col("lower"), F.col("upper"), F.col("n_items"), config, F.col("concerns"))
    return out.select(F.lit(metric).alias("metric"), F.lit(baseline).alias("baseline_arm"), F.lit(enhanced).alias("enhanced_arm"), F.col(f"b.{column}").alias("baseline"), F.col(f"e.{column}").alias("enhanced"), "point", "lower", "upper", "n_items", "concerns", judged.alias("verdict"))


# ---------------------------------------------------------------- providers and reports


class Providers:
    """Named functions that give (arm_id, metric, value) frames; results are told apart as provider.metric."""

    def __init__(self) -> None:
        self._own: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, name: str, provider: Callable[[DataFrame], DataFrame]) -> None:
        if name in self._own:
            raise ValueError(f"provider {name!r} is registered already")
        self._own[name] = provider

    def names(self) -> tuple[str, ...]:
        return tuple(self._own)

    def evaluate(self, cards: DataFrame) -> DataFrame:
        out = None
        for name, provider in self._own.items():
            rows = provider(cards).withColumn("metric", F.concat(F.lit(f"{name}."), F.col("metric")))
            out = rows if out is None else out.unionByName(rows)
        return out


def flat_metrics(cards: DataFrame) -> DataFrame:
    """(arm_id, metric, value): a scorecard in long form."""
    names = {f"{c}.{m}": f"{c}_{m}" for c in CATEGORIES for m in ("precision", "recall", "f1")} | {"evidence.resolvable_rate": "resolvable_rate", "evidence.span_coverage_rate": "span_coverage_rate", "abstention_rate": "abstention_rate", "failure_rate": "failure_rate"}
    pairs = F.array(*(F.struct(F.lit(n).alias("metric"), F.col(c).cast("double").alias("value")) for n, c in names.items()))
    return cards.select("arm_id", F.explode(pairs).alias("x")).select("arm_id", "x.metric", "x.value")


def _shown(value: float | None, note: str = "not measured") -> str:
    return f"insufficient ({note})" if value is None else f"{value:.3f}"


def render_json(cards: DataFrame) -> str:
    """Scorecards by arm, keys sorted."""
    rows = [r.asDict(recursive=True) for r in cards.orderBy("arm_id").collect()]
    return json.dumps(rows, indent=2, sort_keys=True, default=str)


def render_markdown(cards: DataFrame, title: str = "Evaluation") -> str:
    """One table a metric family, a line a metric and a column an arm; what wasn't measured says so. Counts follow the rates."""
    rows = cards.orderBy("arm_id").collect()
    arms = [str(r["arm_id"]) for r in rows]
    rates = flat_metrics(cards).collect()
    measured = {(str(r["arm_id"]), r["metric"]): r["value"] for r in rates}
    counted = [c for c, kind in cards.dtypes if kind in ("bigint", "int") and c != "arm_id"]
    lines = [title, "=" * len(title), "", " | ".join(["metric", *arms]), " | ".join(["-"] * (len(arms) + 1))]
    for metric in dict.fromkeys(r["metric"] for r in rates):
        lines.append(" | ".join([metric, *(_shown(measured[a, metric]) for a in arms)]))
    for name in counted:
        lines.append(" | ".join([name, *("insufficient (not measured)" if r[name] is None else str(r[name]) for r in rows)]))
    return "\n".join([*lines, ""])
