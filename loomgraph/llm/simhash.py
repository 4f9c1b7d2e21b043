"""SimHash near-duplicates by the generalised pigeonhole.

Fingerprint: words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case, shingles of
SHINGLE words joined by a space, XXH64 with seed 42 of each; a bit is set that
is set in over half of the hashes. Documents link at REACH or fewer differing
bits, and a component is what links connect.

Search: the 64 bits are dealt into partitions, correlated bits together. Two
fingerprints within REACH bits differ, in some partition i, by at most t_i bits,
for any thresholds that sum to REACH - partitions + 1 (-1 leaves a partition
out). The thresholds come from dynamic programming over the candidates that
each would give, estimated on a bounded sample; this choice changes the cost,
never the result. Every distinct fingerprint stands in the index under its bits
in each used partition, and probes the values within t_i bits of them. What
meets under a key is verified on all 64 bits, and only a spanning forest of the
links found there goes on, so a group of n copies gives n - 1 edges. Equal
fingerprints are one node from the start. Large keys are divided further by the
plain pigeonhole before pairs are compared. Components come from alternating
large-star and small-star steps, each written to the shared folder.

Defined results: null, empty or wordless texts have fingerprint zero and are
one group; fewer words than a shingle are one shingle; a component whose ids
are all null has a null component_id; extra columns are ignored; repeated rows
are linked and all returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import common

SHINGLE = 3
REACH = 3
#: Distinct fingerprints on which the cost of thresholds is estimated.
SAMPLE = 2048
#: Fingerprints under one key that are compared pair by pair; more are divided first.
PAIRWISE = 1024
#: Edges that one task solves.
LOCAL_EDGES = 500_000
#: Fingerprints under one key that are gathered in one task; more are dealt by further bits before that.
GATHERED = 20_000


# ---------------------------------------------------------------- fingerprints


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The 64-bit fingerprint of each row."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    rows = len(offsets) - 1
    out = np.zeros(rows, np.uint64)
    lower = common.LOWER[data]
    starts, ends, row = common.word_spans(lower, offsets)
    if not len(starts):
        return out
    # words joined by single spaces
    begin = np.concatenate([[0], np.cumsum(ends - starts + 1)])
    take = np.arange(begin[-1]) - np.repeat(begin[:-1] - starts, ends - starts + 1)
    joined = lower[np.minimum(take, len(lower) - 1)]
    joined[begin[1:] - 1] = 32
    words = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(words)[:-1]])
    count = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    own = np.repeat(np.arange(rows), count)
    lead = first[own] + np.arange(len(own)) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    last = np.minimum(lead + shingle, first[own] + words[own]) - 1
    raw = joined.tobytes()
    hashes = np.array([digest(raw[a:b], 42) for a, b in zip(begin[lead].tolist(), (begin[last + 1] - 1).tolist(), strict=True)], np.uint64)
    return majority(hashes, count)


def majority(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each row, count hashes of which follow one another: the bits that are set in over half of them."""
    out = np.zeros(len(count), np.uint64)
    has = np.flatnonzero(count)
    edges = np.concatenate([[0], np.cumsum(count[has])])
    for low in range(0, len(has), 256):  # bits of a few rows at a time
        high = min(low + 256, len(has))
        bits = np.unpackbits(hashes[edges[low] : edges[high]].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, edges[low:high] - edges[low], axis=0, dtype=np.int64)
        out[has[low:high]] = np.packbits(2 * ones > count[has[low:high], None], axis=1).view(">u8").ravel()
    return out


def fingerprint(documents: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE) -> DataFrame:
    """keep, then fp long: the fingerprint's bits as a signed number."""
    common.prepare(documents.sparkSession)
    frame = documents.select(*keep, F.col(text).alias("__text"))
    out_schema = frame.drop("__text").schema.add("fp", "long", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in common.texts(batches, "__text"):
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(fingerprints(data, offsets, shingle).astype(np.int64))], names=[*rows.schema.names[:-1], "fp"])

    return frame.mapInArrow(common.released(run), out_schema)


# ---------------------------------------------------------------- plan


def deal_bits(sample: np.ndarray, partitions: int) -> list[list[int]]:
    """Bits in partitions of about equal size, each grown by the bit most correlated with it."""
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(float)
    centred = bits - bits.mean(0) if len(sample) else np.zeros((1, 64))
    spread = np.sqrt((centred**2).sum(0)) + 1e-9
    alike = np.abs(centred.T @ centred) / spread[:, None] / spread[None, :]
    left, out = set(range(64)), []
    for i in range(partitions):
        size = len(left) // (partitions - i)
        own = [min(left, key=lambda b: (-sum(alike[b, x] for x in left), b))]
        left.discard(own[0])
        while len(own) < size:
            best = max(left, key=lambda b: (sum(alike[b, x] for x in own), -b))
            own.append(best)
            left.discard(best)
        out.append(sorted(own))
    return out


def _ball(width: int, reach: int) -> int:
    from math import comb

    return sum(comb(width, k) for k in range(reach + 1))


def choose(sample: np.ndarray, total: int, reach: int = REACH) -> tuple[list[list[int]], list[int]]:
    """Partitions and thresholds of least estimated cost for total distinct fingerprints."""
    best = None
    for partitions in range(2, reach + 2):
        dealt = deal_bits(sample, partitions)
        costs = []
        for own in dealt:
            mask = np.uint64(sum(1 << b for b in own))
            part = sample & mask
            near = np.zeros(reach + 2)
            for low in range(0, len(part), 256):
                near += np.bincount(np.minimum(np.bitwise_count(part[low : low + 256, None] ^ part[None, :]), reach + 1).ravel(), minlength=reach + 2)
            near[0] -= len(part)  # with itself
            pairs = max(1, len(part) * (len(part) - 1))
            row = {-1: 0.0}
            for t in range(reach + 1):
                ball = _ball(len(own), t)
                if ball > 2000:
                    break
                share = max(near[: t + 1].sum() / pairs, ball / 2.0 ** len(own))
                # a candidate costs one comparison, a probe about as much as 200
                row[t] = float(total) * total * share / 2 + 200.0 * total * ball
            costs.append(row)
        # dynamic programming over the sum of thresholds
        state = {0: (0.0, [])}
        for row in costs:
            step: dict[int, tuple[float, list[int]]] = {}
            for spent, (cost, picked) in state.items():
                for t, more in row.items():
                    if spent + t not in step or cost + more < step[spent + t][0]:
                        step[spent + t] = (cost + more, [*picked, t])
            state = step
        found = state.get(reach - partitions + 1)
        if found and (best is None or found[0] < best[0]):
            best = (found[0], dealt, found[1])
    return best[1], best[2]


# ---------------------------------------------------------------- links


def _roots(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component."""
    label = np.arange(count)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _near(values: np.ndarray, reach: int, free: list[int], out: list[np.ndarray], who: np.ndarray) -> None:
    """Pairs within reach among values that agree outside the free bits, as a forest where many meet."""
    if len(values) <= PAIRWISE or len(free) <= 2 * (reach + 1):
        found = []
        for low in range(0, len(values), 256):
            i, j = np.nonzero(np.bitwise_count(values[low : low + 256, None] ^ values[None, :]) <= reach)
            keep = i + low < j
            found.append(np.stack([i[keep] + low, j[keep]]))
        pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), int)
        if pairs.shape[1]:
            root = _roots(len(values), pairs[0], pairs[1])
            child = np.flatnonzero(root != np.arange(len(values)))
            out.append(np.stack([who[root[child]], who[child]]))
        return
    for part in np.array_split(np.array(free), reach + 1):
        mask = np.uint64(sum(1 << int(b) for b in part))
        key = values & mask
        order = np.argsort(key, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1], [True]]))
        rest = [b for b in free if b not in set(part.tolist())]
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            if high - low > 1:
                _near(values[order[low:high]], reach, rest, out, who[order[low:high]])


def forest(values: np.ndarray, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """Edges (smaller, larger value) that connect what links of at most reach bits connect."""
    values = np.unique(values)
    out: list[np.ndarray] = []
    _near(values, reach, list(range(64)), out, np.arange(len(values)))
    if not out:
        return values[:0], values[:0]
    a, b = np.concatenate(out, axis=1)
    root = _roots(len(values), a, b)
    child = np.flatnonzero(root != np.arange(len(values)))
    return values[root[child]], values[child]


def links(distinct: DataFrame, reach: int = REACH) -> DataFrame:
    """(a, b) longs, a < b: edges between distinct fingerprints fp whose components are those of all links."""
    spark = distinct.sparkSession
    total = distinct.count()
    drawn = distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toArrow()["fp"].to_numpy().astype(np.int64).view(np.uint64)
    dealt, thresholds = choose(drawn, total, reach)
    probes = []
    for part, (own, t) in enumerate(zip(dealt, thresholds, strict=True)):
        mask = sum(1 << b for b in own)
        for size in range(t + 1):
            for flipped in combinations(own, size):
                probes.append((part, _signed(mask), _signed(sum(1 << b for b in flipped))))
    table = F.array(*(F.struct(F.lit(p).alias("part"), F.lit(m).cast("long").alias("mask"), F.lit(f).cast("long").alias("flip")) for p, m, f in probes))
    keyed = distinct.select("fp", F.inline(table)).select("part", F.col("fp").bitwiseAND(F.col("mask")).bitwiseXOR(F.col("flip")).alias("value"), (F.col("flip") == 0).alias("home"), "fp")
    crowded = common.cut(spark, keyed.groupBy("part", "value").agg(F.count("*").alias("n")).where(F.col("n") > GATHERED).select("part", "value"), "crowded")
    if crowded.isEmpty():
        met = keyed.groupBy("part", "value")
    else:
        # of reach + 1 groups of the bits outside the part, two fingerprints within reach agree on one
        dealt_further = F.array(*(F.array(*(F.lit(_signed(sum(1 << b for b in rest[i :: reach + 1]))) for i in range(reach + 1))) for rest in ([b for b in range(64) if b not in own] for own in dealt)))
        crowd = keyed.join(crowded, ["part", "value"]).select("*", F.posexplode(F.element_at(dealt_further, F.col("part") + 1)).alias("deal", "bits"))
        apart = crowd.select("part", "value", "home", "fp", "deal", F.col("fp").bitwiseAND(F.col("bits")).alias("further"))
        none = F.lit(0)
        rest = keyed.join(crowded, ["part", "value"], "left_anti").select("part", "value", "home", "fp", none.alias("deal"), none.cast("long").alias("further"))
        met = rest.unionByName(apart).groupBy("part", "value", "deal", "further")
    met = met.agg(F.collect_list("fp").alias("fps"), F.count_if("home").alias("homes")).where("size(fps) > 1 and homes > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            values, offsets = lists.values.to_numpy().astype(np.int64).view(np.uint64), lists.offsets.to_numpy()
            a, b = [], []
            size = np.diff(offsets)
            two = np.flatnonzero(size == 2)
            x, y = values[offsets[two]], values[offsets[two] + 1]
            close = np.bitwise_count(x ^ y) <= reach
            a.append(x[close])
            b.append(y[close])
            for i in np.flatnonzero(size > 2):
                x, y = forest(values[offsets[i] : offsets[i + 1]], reach)
                a.append(x)
                b.append(y)
            x, y = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return met.select("fps").mapInArrow(common.released(run), "a long, b long").where("a < b").distinct()


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _solved(table: pa.Table) -> pa.Table:
    """(node, root) of a graph of LOCAL_EDGES edges at most."""
    a, b = (table[c].to_numpy().astype(np.int64) for c in ("a", "b"))
    nodes, which = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = _roots(len(nodes), which[: len(a)], which[len(a) :])
    return pa.table({"node": pa.array(nodes, pa.int64()), "root": pa.array(nodes[root], pa.int64())})


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes with edges, root the smallest of the component.

    Up to LOCAL_EDGES edges are solved in one executor task, which spares many
    small jobs; beyond that large-star and small-star go in turn.
    """
    now = common.cut(spark, edges.select("a", "b"), "edges")
    if now.count() <= LOCAL_EDGES:
        return now.groupBy().applyInArrow(_solved, "node long, root long")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m"), F.explode(F.array("a", "b")).alias("b")).select(F.col("m").alias("a"), "b").where("a < b").distinct()
        now = common.cut(spark, small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
        seen = state


def _named(spark: SparkSession, distinct: DataFrame, reach: int) -> DataFrame:
    """(fp, root, component) of distinct fingerprints with their least ids."""
    found = components(spark, links(distinct.select("fp"), reach)).withColumnRenamed("node", "fp")
    rooted = distinct.join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # only nodes with links need their component's smallest id
    linked = distinct.join(found, "fp").groupBy("root").agg(F.min("least").alias("component"))
    return rooted.join(linked, "root", "left").select("fp", "root", F.coalesce("component", "least").alias("component"))


def groups(documents: DataFrame, text: str = "text", shingle: int = SHINGLE, reach: int = REACH) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest id of the component)."""
    spark = documents.sparkSession
    prints = common.cut(spark, fingerprint(documents, text, shingle=shingle), "fingerprints")
    distinct = common.cut(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    named = _named(spark, distinct, reach)
    # rows of two numbers; where one fingerprint has very many, Spark splits this join
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def representatives(documents: DataFrame, text: str = "text", shingle: int = SHINGLE, reach: int = REACH, similarity: tuple[int, int] | None = None) -> DataFrame:
    """One row of each component, all columns kept: that of smallest id, a null id last, and of wholly equal rows one.

    With a similarity (a fraction), links are between texts whose sets of
    shingles reach it, as near_copies finds them: what the probes reach is
    verified, and what lies further apart is looked for exactly. Without one,
    fingerprints within reach link. Each fingerprint's first row is found before
    anything is joined, so a large group of copies moves as a row a task.
    """
    if similarity is not None:
        from loomgraph.llm import near_copies

        return near_copies.representatives(documents, text, shingle, reach, similarity)
    spark = documents.sparkSession
    names = common.free_names(documents, "one", "two")  # together 128 bits of a row's columns
    marked = documents.withColumns({n: F.xxhash64(F.lit(n), *documents.columns) for n in names})
    row = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", *names)
    prints = fingerprint(marked, text, ("doc_id", *names), shingle)
    distinct = common.cut(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(row).alias("row")), "distinct")
    named = _named(spark, distinct.select("fp", "least"), reach).select("fp", "root")
    first = distinct.join(named, "fp").groupBy("root").agg(F.min("row").alias("row")).select(*(F.col(f"row.{n}").alias(n) for n in names))
    return marked.join(first, list(names), "left_semi").dropDuplicates(list(names)).select(*documents.columns)
