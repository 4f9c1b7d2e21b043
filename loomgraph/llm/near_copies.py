"""Near copies by their sets of shingles, candidates by SimHash and by prefixes.

Words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case; a text is the set of its
runs of so many words, fewer words are one run. Two texts link if the Jaccard
similarity of their sets is LEAST or more and the SimHash fingerprints of their
sets differ in FAR bits at most; a component is what links connect. Sets of that
similarity differ in ten bits of 64 on average (a standard deviation is three),
so the second condition costs none of them in practice and spares most others.
The probes of the generalised pigeonhole reach close copies only; what is left
is found exactly:

1. Equal sets are one node: a 64-bit digest with its fingerprint.
2. Fingerprints within reach, by the generalised pigeonhole, are candidates.
3. All sets are sorted alike, what many documents hold last (counted over all
   documents, of which copies that are read together are one; the counts are
   sorted arrays in the shared folder that workers map). Two sets of similarity
   LEAST share one of their first n - ceil(LEAST * n) + 1 shingles; these go to
   buckets, packed, and shingles of several nodes make groups. A shingle that is
   counted more than GROUP times is dealt to several groups, every two nodes
   together in one.
4. Candidates of 2 and every group's first node with the others are compared,
   by fingerprint and then set by set. In groups whose nodes aren't all connected
   by that, bitmaps of the sets bound from above what two of them share. Nodes of
   different components that may still link make families, of which a group sends
   a spanning forest. A family's sets meet in one task (LOAD shingles or so; larger
   families are dealt, every two nodes together once), which compares every pair
   that isn't connected yet and sends the links that connect something. So rows
   grow with nodes, not with pairs, and no link between components is missed.

Defined results: null, empty or wordless texts are one group; repeated rows are
one; extra columns are kept, whatever their names; a null id counts as largest;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common, shards, simhash

SHINGLE = 5
#: Least Jaccard similarity, as a fraction.
LEAST = (4, 5)
#: Bits in which fingerprints of linked sets may differ.
FAR = 24
#: Documents that one count of a shingle stands for: all are counted.
SHARE = 1
#: Nodes that a group is expected to hold at most.
GROUP = 4096
#: Bits in a set's bitmap.
SIGNATURE = 1024
#: Shingles of sets that are compared in one task, a bitmap's bytes a set added; a larger family of sets is dealt.
LOAD = 1 << 21
#: Entries that a task gathers before it sends them to their buckets.
FLUSH = 400_000
_OFTEN = ("<u8", "<u4")


def shingles(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each row's distinct shingles, ascending."""
    lower = common.LOWER[data]
    starts, ends, rows = common.word_spans(lower, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = common.span_hashes(lower, starts, ends)
    words = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.cumsum(words) - words
    size = np.minimum(words, shingle)
    count = words - size + (words > 0)
    own = np.repeat(np.arange(len(words)), count)
    lead = first[own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    value = size[own].astype(np.uint64)
    for k in range(shingle):
        has = size[own] > k
        value[has] = common.mix(value[has] * np.uint64(0x9E3779B97F4A7C15) + word[lead[has] + k])
    order = np.lexsort((value, own))
    own, value = own[order], value[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (value[1:] != value[:-1])
    return own[new], value[new]


def _nodes(own: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Digest and size of each row's set."""
    size = np.bincount(own, minlength=rows)
    total = np.zeros(rows, np.uint64)
    has = np.flatnonzero(size)
    if len(has):
        total[has] = np.add.reduceat(common.mix(value.copy()), np.searchsorted(own, has))
    return np.where(size > 0, common.mix(total + size.astype(np.uint64)), np.uint64(0)).view(np.int64), size


def _signatures(own: np.ndarray, value: np.ndarray, rows: int) -> list[bytes]:
    """A bitmap of each row's set: a bit that only one of two has stands for a shingle that only this one has."""
    bits = np.zeros((rows, SIGNATURE), bool)
    bits[own, (value % np.uint64(SIGNATURE)).astype(np.int64)] = True
    return [x.tobytes() for x in np.packbits(bits, axis=1)]


def _weights(value: np.ndarray, folder: str, buckets: int) -> np.ndarray:
    """How many documents hold each shingle, 0 for those that fewer than two do."""
    wanted, which = np.unique(value, return_inverse=True)
    out = np.zeros(len(wanted), np.int64)
    home = wanted % np.uint64(buckets)
    order = np.argsort(home, kind="stable")
    edges = np.searchsorted(home[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        own = order[edges[b] : edges[b + 1]]
        keys, counts = shards.read(folder, f"often-{b}", _OFTEN)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, wanted[own]), len(keys) - 1)
            hit = keys[at] == wanted[own]
            out[own[hit]] = counts[at[hit]]
    return out[which]


def _prefixes(own: np.ndarray, value: np.ndarray, size: np.ndarray, weight: np.ndarray, least: tuple[int, int]):
    """Row, shingle, weight and place of the first shingles of each set, of which similar sets share one."""
    order = np.lexsort((value, weight, own))
    place = np.arange(len(own)) - (np.cumsum(size) - size)[own]
    a, b = least
    keep = place < (size - -(-a * size // b) + 1)[own]
    return own[keep], value[order][keep], weight[order][keep], place[keep]


def alike(shared, n, m, least: tuple[int, int] = LEAST):
    """Whether sets of n and m with so much in common reach the similarity."""
    a, b = least
    return (a + b) * shared >= a * (n + m)


def _dealt(key: np.ndarray, node: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, key): entries of a shingle that many nodes have, once for each group; every two nodes of a key share a group."""
    parts = 1 + weight * SHARE // GROUP
    entry = np.repeat(np.arange(len(key)), parts)
    other = np.arange(len(entry)) - np.repeat(np.cumsum(parts) - parts, parts)
    own = (common.mix(node[entry].view(np.uint64)) % parts[entry].astype(np.uint64)).astype(np.int64)
    low, high = np.minimum(own, other).astype(np.uint64), np.maximum(own, other).astype(np.uint64)
    salted = common.mix(key[entry] + low * np.uint64(0x9E3779B97F4A7C15) + high * np.uint64(0xD6E8FEB86659FD93))
    return entry, np.where(parts[entry] > 1, salted, key[entry])


def _groups(table: pa.Table, least: tuple[int, int]) -> pa.Table:
    """Of a bucket's shingles that several nodes have, a row for each list of nodes; and one row of pairs, first nodes with the others."""
    key = np.concatenate([shards.unpack_sorted(x) for x in table["key"].to_pylist()])
    node, size, place = (np.concatenate([shards.unpack(x, k) for x in table[c].to_pylist()]).astype(np.int64) for c, k in (("node", "<i8"), ("size", "<i4"), ("place", "<i4")))
    order = np.lexsort((node, key))
    key, node, size, place = (x[order] for x in (key, node, size, place))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node, size, place = (x[new] for x in (key, node, size, place))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(first, len(key)))
    head = np.repeat(first, count)
    # if a shared shingle is the first that both have, no more can be shared than follows; if not, another group has the pair
    rest = np.minimum(size - place, size[head] - place[head])
    fits = (head != np.arange(len(key))) & alike(rest, size, size[head], least)
    pairs = np.unique(np.stack([node[head[fits]], node[fits]]), axis=1)
    two = count == 2
    two[two] = fits[first[two] + 1]
    found = {}
    for low, high in zip(first[two | (count > 2)].tolist(), (first + count)[two | (count > 2)].tolist(), strict=True):
        if high - low > 2:  # two are a pair already
            found[node[low:high].tobytes()] = size[low:high].astype("<i4").tobytes()
    return pa.table({
        "nodes": pa.array([*found, None], pa.binary()), "sizes": pa.array([*found.values(), None], pa.binary()),
        "a": pa.array([None] * len(found) + [pairs[0].astype("<i8").tobytes()], pa.binary()), "b": pa.array([None] * len(found) + [pairs[1].astype("<i8").tobytes()], pa.binary()),
    })


def _joined(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (a, b) with columns of both nodes, those of b first."""
    left, right = (table.select(F.col("node").alias(n), *(F.col(c).alias(f"{c}_{n}") for c in columns)) for n in ("a", "b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", *(f"{c}_{n}" for n in ("b", "a") for c in columns))


def _close(pairs: DataFrame, nodes: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Of pairs (a, b), those whose fingerprints and sizes allow a link."""
    a, b = least
    low, high = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    close = (F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= FAR) & (b * low >= a * high)
    return _joined(pairs, nodes, ["size", "fp"]).where(close).select("a", "b")


def _sets(ends: DataFrame, nodes: DataFrame, source: DataFrame, names: tuple[str, ...], shingle: int) -> DataFrame:
    """(node, body) of nodes, which are given once each: their sets, ascending. Cut."""

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in common.texts(batches):
            own, value = shingles(data, offsets, shingle)
            edges = np.searchsorted(own, np.arange(rows.num_rows + 1))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([value[a:b].astype("<u8").tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())], names=["node", "body"])

    wanted = ends.join(nodes, "node").select("node", *(F.col(f"row.{n}").alias(n) for n in names))
    texts = source.join(wanted, list(names)).dropDuplicates(["node"]).select("node", "text")
    return common.cut(source.sparkSession, texts.mapInArrow(common.released(bodies), "node long, body binary"), "sets")


def _verified(left: DataFrame, nodes: DataFrame, source: DataFrame, names: tuple[str, ...], shingle: int, least: tuple[int, int]) -> DataFrame:
    """Of close pairs (a, b), which were cut, those that link: their sets are compared."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = np.sort(np.concatenate([x, y]), kind="stable")
                keep.append(bool(alike(int((both[1:] == both[:-1]).sum()), len(x), len(y), least)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    sets = _sets(left.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, source, names, shingle)
    links = common.cut(left.sparkSession, _joined(left, sets, ["body"]).mapInArrow(common.released(compare), "a long, b long"), "links")
    common.discard(left, sets)
    return links


def _lists(batch: pa.RecordBatch, names: tuple[str, ...]):
    """The fields of each row's list of structs, and the list's number."""
    column = batch.column(1)
    fields, edges = column.flatten(), column.offsets.to_numpy() - column.offsets[0].as_py()
    arrays = [fields.field(n) if n == "bits" else fields.field(n).to_numpy().astype(np.int64) for n in names]
    for number, low, high in zip(batch.column(0).to_pylist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield number, [np.frombuffer(b"".join(x[low:high].to_pylist()), "<u8").reshape(high - low, -1) if n == "bits" else x[low:high] for n, x in zip(names, arrays, strict=True)]


def _open(batches: Iterator[pa.RecordBatch], least: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """(list, node) of nodes that a node of another component could link to, by fingerprint and size."""
    a, b = least
    for batch in batches:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for number, (node, size, fp, root) in _lists(batch, ("node", "size", "fp", "root")):
            fp, any_ = fp.view(np.uint64), np.zeros(len(node), bool)
            for at in range(0, len(node), 512):
                rows = slice(at, at + 512)
                fits = (root[rows, None] != root) & (np.bitwise_count(fp[rows, None] ^ fp) <= FAR)
                any_[rows] = (fits & (b * np.minimum(size[rows, None], size) >= a * np.maximum(size[rows, None], size))).any(1)
            out.append((np.full(int(any_.sum()), number), node[any_]))
        x, y = (np.concatenate(z) for z in zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["list", "node"])


def _may(p: int, other: np.ndarray, size: np.ndarray, fp: np.ndarray, bits: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """Of other nodes, those that p can link to, as fingerprints and bitmaps bound it."""
    other = other[np.bitwise_count(fp[other] ^ fp[p]) <= FAR]
    only, lost = np.bitwise_count(bits[p] & ~bits[other]).sum(1, dtype=np.int64), np.bitwise_count(bits[other] & ~bits[p]).sum(1, dtype=np.int64)
    return other[alike(np.minimum(size[p] - only, size[other] - lost), size[p], size[other], least)]


def _families(batches: Iterator[pa.RecordBatch], least: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """(a, b) that connect the nodes of a list as all pairs of different components do that may link: fewer than nodes."""
    for batch in batches:
        out = [np.zeros((2, 0), np.int64)]
        for _, (node, size, fp, root, bits) in _lists(batch, ("node", "size", "fp", "root", "bits")):
            fp, left = fp.view(np.uint64), np.ones(len(node), bool)
            for first in range(len(node)):
                waiting = [first] if left[first] else []
                left[first] = False
                while waiting:
                    p = waiting.pop()
                    other = _may(p, np.flatnonzero(left & (root != root[p])), size, fp, bits, least)
                    left[other] = False
                    waiting += other.tolist()
                    out.append(np.stack([np.minimum(node[p], node[other]), np.maximum(node[p], node[other])]))
        x, y = np.unique(np.concatenate(out, axis=1), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])


def _forest(node: np.ndarray, size: np.ndarray, fp: np.ndarray, root: np.ndarray, bodies: list[bytes], least: tuple[int, int]) -> list[tuple[int, int]]:
    """Links that connect components as all links between the nodes do, fewer than nodes. Every pair that isn't connected by then is compared."""
    value, ends = np.frombuffer(b"".join(bodies), "<u8"), np.cumsum(size)
    bits = np.frombuffer(b"".join(_signatures(np.repeat(np.arange(len(node)), size), value, len(node))), "<u8").reshape(len(node), -1)
    distinct, which = np.unique(value, return_inverse=True)
    mark, label = np.zeros(len(distinct), np.uint8), np.unique(root, return_inverse=True)[1]
    out = []
    for p in range(len(node) - 1):
        other = _may(p, np.flatnonzero(label[p + 1 :] != label[p]) + p + 1, size, fp, bits, least)
        if not len(other):
            continue
        count = size[other]
        edge = np.cumsum(count) - count
        mark[which[ends[p] - size[p] : ends[p]]] = 1
        shared = np.add.reduceat(mark[which[np.arange(int(count.sum())) + np.repeat(ends[other] - count - edge, count)]], edge, dtype=np.int64)
        mark[which[ends[p] - size[p] : ends[p]]] = 0
        for q in other[alike(shared, size[p], count, least)].tolist():
            if label[q] != label[p]:
                out.append((min(int(node[p]), int(node[q])), max(int(node[p]), int(node[q]))))
                label[label == label[q]] = label[p]
    return out


def _connected(families: DataFrame, nodes: DataFrame, found: DataFrame, source: DataFrame, names: tuple[str, ...], shingle: int, least: tuple[int, int], buckets: int) -> DataFrame:
    """Links (a, b) that connect components as all links inside families (node, root) do. Cut."""
    members = families.withColumnRenamed("root", "list").join(nodes.select("node", "size", "fp"), "node").join(found, "node", "left").select("list", "node", "size", "fp", F.coalesce("root", "node").alias("root"))
    loads = families.join(nodes.select("node", "size"), "node").groupBy(F.col("root").alias("list")).agg(F.sum(F.col("size") + SIGNATURE // 8).alias("load"))
    parts = loads.select("list", F.when(F.col("load") > LOAD, F.ceil(2 * F.col("load") / LOAD)).otherwise(1).cast("long").alias("parts"))
    dealt = members.join(parts, "list").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.withColumn("list", F.when(F.col("parts") == 1, F.col("list")).otherwise(F.xxhash64("list", F.least("own", "other"), F.greatest("own", "other"))))
    sets = _sets(families.select("node"), nodes, source, names, shingle)

    @common.trimmed
    def link(table: pa.Table) -> pa.Table:
        table = table.sort_by([("list", "ascending"), ("node", "ascending")]).combine_chunks()
        number, node, size, fp, root = (table[c].to_numpy().astype(np.int64) for c in ("list", "node", "size", "fp", "root"))
        edges = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1], [True]]))
        out = [e for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) for e in _forest(node[a:b], size[a:b], fp[a:b].view(np.uint64), root[a:b], table["body"].slice(a, b - a).to_pylist(), least)]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    rows = dealt.select("list", "node", "size", "fp", "root").join(sets, "node").withColumn("bucket", F.pmod(F.xxhash64("list"), F.lit(buckets)))
    links = common.cut(source.sparkSession, rows.groupBy("bucket").applyInArrow(link, "a long, b long"), "links")
    common.discard(sets)
    return links


def _counted(source: DataFrame, shingle: int, buckets: int) -> str:
    """A folder with the shingles that two documents or more hold, and how many do, as sorted arrays a bucket. Copies in one batch are one."""
    spark = source.sparkSession
    folder = common.shared_folder(spark, "often")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def flush():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            home = keys % np.uint64(buckets)
            order = np.argsort(home, kind="stable")
            edges = np.searchsorted(home[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(edges)).tolist():
                own = order[edges[b] : edges[b + 1]]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([shards.pack_sorted(keys[own])], pa.binary()), pa.array([shards.pack(counts[own].astype("<u4"))], pa.binary())], names=["bucket", "key", "n"])

        for rows, data, offsets in common.texts(batches):
            own, value = shingles(data, offsets, shingle)
            node, _ = _nodes(own, value, rows.num_rows)
            once = np.zeros(rows.num_rows, bool)
            once[np.unique(node, return_index=True)[1]] = True
            held.append(value[once[own]])
            total += len(held[-1])
            if total >= 10 * FLUSH:
                yield from flush()
                held, total = [], 0
        if total:
            yield from flush()

    @common.trimmed
    def add(table: pa.Table) -> pa.Table:
        keys = np.concatenate([shards.unpack_sorted(x) for x in table["key"].to_pylist()])
        counts = np.concatenate([shards.unpack(x, "<u4") for x in table["n"].to_pylist()]).astype(np.int64)
        keys, which = np.unique(keys, return_inverse=True)
        total = np.bincount(which, weights=counts).astype("<u4")
        shards.write(folder, f"often-{table['bucket'][0].as_py()}", [keys[total > 1], total[total > 1]])
        return pa.table({"n": pa.array([int((total > 1).sum())], pa.int64())})

    counts = source.select("text").mapInArrow(common.released(count), "bucket int, key binary, n binary")
    common.discard(common.cut(spark, counts.groupBy("bucket").applyInArrow(add, "n long"), "counted"))  # written for its shuffle files to go
    return folder


def _probed(nodes: DataFrame, reach: int) -> DataFrame:
    """Pairs of nodes by fingerprint: those of one with its least, and those that the generalised pigeonhole links."""
    spark = nodes.sparkSession
    least = common.cut(spark, nodes.groupBy("fp").agg(F.min("node").alias("low")), "prints")
    equal = nodes.select("fp", F.col("node").alias("b")).join(least, "fp").select(F.col("low").alias("a"), "b").where("a < b")
    links = simhash.links(least.select("fp"), reach)
    side = lambda name, to: least.select(F.col("fp").alias(name), F.col("low").alias(to))
    near = links.join(side("a", "x"), "a").join(side("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return equal.unionByName(near)


def representatives(documents: DataFrame, text: str = "text", shingle: int = SHINGLE, reach: int = simhash.REACH, least: tuple[int, int] = LEAST) -> DataFrame:
    """One row of each component, all columns kept: that of smallest id, a null id last, and of wholly equal rows one."""
    spark = documents.sparkSession
    common.prepare(spark)
    one, two = common.free_names(documents, "one", "two")  # together 128 bits of a row's columns
    marked = documents.withColumns({n: F.xxhash64(F.lit(str(i)), *documents.columns) for i, n in enumerate((one, two))})
    source = marked.select("doc_id", F.col(one).alias("one"), F.col(two).alias("two"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    names = ("one", "two")
    buckets = common.bucket_count(documents)
    folder = _counted(source, shingle, buckets)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in common.texts(batches):
            own, value = shingles(data, offsets, shingle)
            node, size = _nodes(own, value, rows.num_rows)
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(node), pa.array(size, pa.int32()), pa.array(simhash.majority(value, size).view(np.int64)), pa.array(_signatures(own, value, rows.num_rows), pa.binary())], names=["doc_id", *names, "node", "size", "fp", "bits"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush():
            key, node, size, place = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = (common.mix(key.copy()) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((node, key, bucket))
            new = np.ones(len(order), bool)  # copies in one task are one entry
            new[1:] = (key[order][1:] != key[order][:-1]) | (node[order][1:] != node[order][:-1])
            order = order[new]
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(edges))
            for a in range(0, len(used), 64):
                own = [order[edges[b] : edges[b + 1]] for b in used[a : a + 64]]
                packed = [pa.array([shards.pack(x[i].astype(k)) for i in own], pa.binary()) for x, k in ((node, "<i8"), (size, "<i4"), (place, "<i4"))]
                yield pa.RecordBatch.from_arrays([pa.array(used[a : a + 64], pa.int32()), pa.array([shards.pack_sorted(key[i]) for i in own], pa.binary()), *packed], names=["bucket", "key", "node", "size", "place"])

        for rows, data, offsets in common.texts(batches):
            own, value = shingles(data, offsets, shingle)
            node, size = _nodes(own, value, rows.num_rows)
            row, key, weight, place = _prefixes(own, value, size, _weights(value, folder, buckets), least)
            entry, key = _dealt(key, node[row], weight)
            row, place = row[entry], place[entry]
            if len(row):
                held.append((key, node[row], size[row], place))
                count += len(row)
            if count >= FLUSH:
                yield from flush()
                held, count = [], 0
        if held:
            yield from flush()
        shards.unmap()

    row = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", *names)
    schema = source.drop("text").schema.add("node", "long", False).add("size", "integer", False).add("fp", "long", False).add("bits", "binary", False)
    nodes = common.cut(spark, source.mapInArrow(common.released(digest), schema).groupBy("node").agg(F.min(row).alias("row"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bits").alias("bits")), "nodes")
    sent = source.select("text").mapInArrow(common.released(send), "bucket int, key binary, node binary, size binary, place binary")
    groups = common.cut(spark, sent.groupBy("bucket").applyInArrow(common.trimmed(lambda table: _groups(table, least)), "nodes binary, sizes binary, a binary, b binary"), "groups")

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.frombuffer(x, "<i8") for x in c.to_pylist()] or [np.zeros(0, "<i8")]), pa.int64()) for c in batch.columns], names=["a", "b"])

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size = (np.concatenate([np.frombuffer(x, k) for x in batch.column(c).to_pylist()] or [np.zeros(0, k)]) for c, k in ((0, "<i8"), (1, "<i4")))
            group = np.repeat(batch.column(2).to_numpy(), [len(x) // 8 for x in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), pa.array(node, pa.int64()), pa.array(size, pa.int32())], names=["list", "node", "size"])

    first = groups.where("a is not null").select("a", "b").mapInArrow(common.released(paired), "a long, b long")
    pairs = common.cut(spark, _close(first.unionByName(_probed(nodes, reach)).distinct(), nodes, least), "pairs")
    edges = _verified(pairs, nodes, source, names, shingle, least)
    found = common.cut(spark, simhash.components(spark, edges), "near")
    lists = groups.where("nodes is not null").withColumn("list", F.xxhash64("nodes")).dropDuplicates(["list"])
    listed = lists.select("nodes", "sizes", "list").mapInArrow(common.released(members), "list long, node long, size int")

    def gathered(rows: DataFrame, *columns: str) -> DataFrame:
        """Lists of several components, with their nodes' columns. A list holds about twice GROUP nodes at most."""
        rooted = rows.join(found, "node", "left").select("list", F.struct("node", *columns, F.coalesce("root", "node").alias("root")).alias("own"))
        return rooted.groupBy("list").agg(F.collect_list("own").alias("own"), F.min("own.root").alias("low"), F.max("own.root").alias("high")).where("low < high").select("list", "own")

    prints = listed.join(nodes.select("node", "fp"), "node")
    opened = gathered(prints, "size", "fp").mapInArrow(common.released(lambda x: _open(x, least)), "list long, node long")
    left = common.cut(spark, opened.join(nodes.select("node", "size", "fp", "bits"), "node"), "open")
    may = gathered(left, "size", "fp", "bits").mapInArrow(common.released(lambda x: _families(x, least)), "a long, b long").distinct()
    families = common.cut(spark, simhash.components(spark, may), "families")
    edges = edges.unionByName(_connected(families, nodes, found, source, names, shingle, least, buckets))
    found = common.cut(spark, simhash.components(spark, edges), "near")
    named = nodes.select("node", "row").join(found, "node", "left").select("row", F.coalesce("root", "node").alias("root"))
    chosen = common.cut(spark, named.groupBy("root").agg(F.min("row").alias("row")).select(F.col("row.one").alias(one), F.col("row.two").alias(two)), "chosen")
    # wholly equal rows are one; the join has dealt and sorted them already
    return marked.join(chosen, [one, two], "left_semi").dropDuplicates([one, two]).select(*documents.columns)
