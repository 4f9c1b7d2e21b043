"""Benchmark decontamination by latent semantic retrieval.

Words are runs of letters, digits and non-ASCII bytes, A-Z in lower case.
Document frequencies are counted over all documents, by the words' hashes. A
passage's vector has sqrt(tf) * idf for each term, which are the words of the
benchmark; words outside it lengthen the vector by their own weight. A
distributed randomised SVD of the passages of the benchmark and of all documents
gives the latent space: the pass that counts frequencies also adds up a sketch of
which terms stand together in a document's passage (WINDOW words, one after the
other), from which, with the benchmark's passages themselves, the factors follow.

Every document is cut into windows of WINDOW words, half a window apart. For
each term the most that any passage gives it, over the cosine that this passage
asks for, is known; the sum over a window's words bounds what the window can
reach, so that most are passed over exactly. The others are projected and
compared with the benchmark's passages, a block of items at a time. The cosine
loses an item of frequent words that stands among rare ones, so wherever SEED
words in a row are those of an item (all of a shorter item's), that place is a
candidate too, whatever its cosine. Candidates are verified with what surrounds
them: the longest common subsequence with the item over the item's length, and
the share of the item's answer (its rarest words) that is there. Both must reach
their least value.

Defined results: null or empty texts match nothing, nor do items without words;
rows that share an id each give their pairs; null ids of documents and of items
are passed on, and an item's id may be of any type; items with
equal texts are all reported; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from loomgraph.llm import common, shards

WINDOW = 32
RANK = 256
OVERSAMPLING = 16
#: Cells of the sketch that a task adds up, where that leaves as many columns as the space needs; twice as many as it has dimensions at most.
SKETCH_CELLS = 1 << 24
#: How much the benchmark's passages weigh in the fit, against all of the documents'.
BENCHMARK_WEIGHT = 4.0
#: Of the cosine that an item has with a window inside a copy of itself, what a window must reach.
COSINE_SHARE = 0.5
#: Words in a row of an item that make a candidate.
SEED = 4
LEAST_COMMON = 0.6
LEAST_ANSWER = 0.5
#: Pairs of terms that are added up at once while fitting, and passages that are projected at once while searching.
FIT_PAIRS, SEARCH_BLOCK = 1 << 20, 1024
#: Hash buckets in which document frequencies are counted; words that share one count as one.
BUCKETS = 1 << 20
#: Items of the benchmark that are held at once, and characters of theirs; more are searched block by block. The latter bounds the terms, and with them the basis. One longer item is a block of its own.
ITEM_BLOCK, ITEM_CHARACTERS = 20_000, 1 << 20
#: Partial counts that meet in one task.
FAN_IN = 32

_SEPARATES = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, start and end of each word."""
    lower = common.LOWER[data]
    lower[_SEPARATES[lower]] = 32
    starts, ends, rows = common.word_spans(lower, offsets)
    return common.span_hashes(lower, starts, ends), rows, starts, ends


def _windows(rows: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last (exclusive) word of the windows of each row."""
    n = np.bincount(rows, minlength=count)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    half = WINDOW // 2
    many = np.where(n > 0, np.maximum(0, -(-(n - WINDOW) // half)) + 1, 0)
    own = np.repeat(np.arange(count), many)
    low = first[own] + (np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)) * half
    return own, low, np.minimum(low + WINDOW, first[own] + n[own])


@dataclass
class Items:
    """A block of the benchmark."""

    ids: list
    item_words: list[np.ndarray]
    terms: np.ndarray  # ascending hashes
    passage_item: np.ndarray  # which item a passage is of
    passages: list[np.ndarray]  # term numbers
    weights: np.ndarray = None  # inverse document frequencies by bucket
    idf: np.ndarray = None  # of the terms
    space: np.ndarray = None  # terms x rank
    query: np.ndarray = None  # rank x passages, unit length in the whole space
    least: np.ndarray = None  # cosine that each passage asks for
    seeds: dict[int, tuple[np.ndarray, np.ndarray]] = None  # by their number of words: ascending hashes of words in a row, and the item of each
    reach: np.ndarray = None  # of each term: its largest part in a passage, over the cosine that the passage asks for

    def term(self, hashes: np.ndarray) -> np.ndarray:
        """Term numbers, -1 for words outside the benchmark."""
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)


def items(ids: list, texts: list[str]) -> Items:
    data, offsets = common.text_buffers(pa.array(texts, pa.large_string()))
    hashes, rows, _, _ = words(data, offsets)
    terms = np.unique(hashes)
    number = np.searchsorted(terms, hashes)
    per_item = [hashes[rows == i] for i in range(len(ids))] if len(ids) < 64 else np.split(hashes, np.searchsorted(rows, np.arange(1, len(ids))))
    owner, passages = [], []
    edges = np.searchsorted(rows, np.arange(len(ids) + 1))
    for i in range(len(ids)):
        own = number[edges[i] : edges[i + 1]]
        if len(own) <= 2 * WINDOW:
            cuts = [(0, len(own))]
        else:
            cuts = [(a, min(a + WINDOW, len(own))) for a in range(0, len(own), WINDOW)]
        for a, b in cuts:
            if b > a:
                owner.append(i)
                passages.append(own[a:b])
    return Items(ids, per_item, terms, np.array(owner, np.int64), passages, seeds=_seeds(hashes, rows, len(ids)))


def _in_a_row(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each stretch of size words of one row."""
    first = np.flatnonzero(rows[: len(rows) - size + 1] == rows[size - 1 :]) if len(rows) >= size else np.zeros(0, np.int64)
    value = np.full(len(first), size, np.uint64)
    for k in range(size):
        value = common.mix(value * np.uint64(0x9E3779B97F4A7C15) + hashes[first + k])
    return first, value


def _seeds(hashes: np.ndarray, rows: np.ndarray, count: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    size = np.minimum(np.bincount(rows, minlength=count), SEED)
    out = {}
    for k in np.unique(size[size > 0]).tolist():
        first, value = _in_a_row(hashes, rows, k)
        own = size[rows[first]] == k
        value, item = value[own], rows[first[own]]
        order = np.lexsort((item, value))
        value, item = value[order], item[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (item[1:] != item[:-1])
        out[k] = value[new], item[new]
    return out


def _vectors(group: np.ndarray, term: np.ndarray, idf: np.ndarray, space: np.ndarray, count: int) -> np.ndarray:
    """Projection of each group's vector of sqrt(tf) * idf."""
    cell, tf = np.unique(group * len(idf) + term, return_counts=True)
    g, t = cell // len(idf), cell % len(idf)
    out = np.zeros((count, space.shape[1]), np.float32)
    if len(cell):
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        weight = (np.sqrt(tf) * idf[t]).astype(np.float32)
        out[g[first]] = np.add.reduceat(space[t] * weight[:, None], first, axis=0)
    return out


def frequencies(documents: DataFrame) -> np.ndarray:
    """Inverse document frequencies of all words, over all documents, by the words' hashes: as many numbers as BUCKETS, however many words there are."""
    return _counted(documents)[0]


def _columns(terms: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each term's column of the sketch, and its sign there."""
    drawn = common.mix(terms + np.uint64(20))
    return (drawn % np.uint64(width)).astype(np.int64), 1.0 - 2.0 * (drawn >> np.uint64(63)).astype(float)


def _together(hashes: np.ndarray, rows: np.ndarray, block: Items, total: np.ndarray) -> None:
    """Add to total (terms x columns, and how often each term stands) what passages of WINDOW words hold together, sqrt(tf) a term."""
    width = total.shape[1] - 1
    column, sign = _columns(block.terms, width)
    if not len(hashes):
        return
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
    passage, term = np.cumsum(place % WINDOW == 0) - 1, block.term(hashes)
    cell, tf = np.unique(passage[term >= 0] * len(block.terms) + term[term >= 0], return_counts=True)
    g, t = cell // len(block.terms), cell % len(block.terms)
    weight = np.sqrt(tf)
    np.add.at(total[:, width], t, tf)
    lead = np.flatnonzero(np.diff(g, prepend=-1))
    count = np.diff(np.append(lead, len(g)))
    many, start = np.repeat(count, count), np.repeat(lead, count)
    edges = np.searchsorted(np.cumsum(many), np.arange(0, int(many.sum()) + FIT_PAIRS, FIT_PAIRS), side="right") if len(g) else np.zeros(1, int)
    flat = total.reshape(-1)
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own = many[low:high]
        left = np.repeat(np.arange(low, high), own)
        right = np.repeat(start[low:high] - (np.cumsum(own) - own), own) + np.arange(len(left))
        np.add.at(flat, t[left] * (width + 1) + column[t[right]], weight[left] * weight[right] * sign[t[right]])


def _counted(documents: DataFrame, block: Items | None = None, words_too: bool = True) -> tuple[np.ndarray | None, np.ndarray | None]:
    """Inverse document frequencies, and for a block the sketch of which of its terms stand together: one pass over all documents."""
    terms = 0 if block is None else len(block.terms)
    height, width = 512, min(terms, max(min(2 * RANK, SKETCH_CELLS // max(terms, 1)), RANK + OVERSAMPLING)) + 1
    plain = None if block is None else Items([], [], block.terms, None, [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows_read = np.zeros(BUCKETS, np.int32), 0
        sketch = None if plain is None else np.zeros((terms, width))
        for rows, data, offsets in common.texts(batches):
            hashes, row, _, _ = words(data, offsets)
            if words_too:
                seen = np.unique(row * BUCKETS + _bucket(hashes)) % BUCKETS
                total += np.bincount(seen, minlength=BUCKETS).astype(np.int32)
                rows_read += rows.num_rows
            if sketch is not None:
                _together(hashes, row, plain, sketch)
        if words_too:
            parts = [total[low : low + BUCKETS // 64] for low in range(0, BUCKETS, BUCKETS // 64)]
            yield pa.RecordBatch.from_arrays([pa.array(range(65), pa.int32()), pa.array([*(shards.pack(p.astype("<i8")) for p in parts), shards.pack(np.array([rows_read], "<i8"))], pa.binary())], names=["part", "counts"])
        for low in range(0, terms, height):
            yield pa.RecordBatch.from_arrays([pa.array([65 + low // height], pa.int32()), pa.array([shards.pack(sketch[low : low + height])], pa.binary())], names=["part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(shards.unpack(x, "<i8" if table["part"][0].as_py() < 65 else "<f8") for x in table["counts"].to_pylist())
        return pa.table({"part": table["part"].slice(0, 1), "counts": pa.array([shards.pack(total)], pa.binary())})

    tasks = documents.rdd.getNumPartitions()
    partial = documents.select("text").mapInArrow(common.released(run), "part int, counts binary").withColumn("task", F.spark_partition_id())
    while tasks > FAN_IN:  # in levels, so that no task adds up what all others send
        tasks = -(-tasks // FAN_IN)
        partial = partial.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int")).groupBy("part", "task").applyInArrow(lambda t: add(t).append_column("task", t["task"].slice(0, 1)), "part int, counts binary, task int")
    found = partial.select("part", "counts").groupBy("part").applyInArrow(add, "part int, counts binary").toArrow()  # the sketch is as large as the basis
    counts = {p: shards.unpack(c, "<i8" if p < 65 else "<f8") for p, c in zip(found["part"].to_pylist(), found["counts"].to_pylist(), strict=True)}
    weights = sketch = None
    if words_too:
        total = np.concatenate([counts.get(p, np.zeros(BUCKETS // 64, np.int64)) for p in range(64)])
        rows = int(counts[64][0]) if 64 in counts else 0
        weights = (np.log((1.0 + rows) / (1.0 + np.minimum(total, rows))) + 1e-3).astype(np.float32)
    if block is not None:
        sketch = np.concatenate([counts.get(65 + low // height, np.zeros(min(height, terms - low) * width)) for low in range(0, terms, height)]).reshape(terms, width)
    return weights, sketch


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(BUCKETS)).astype(np.int64)


def _fit(block: Items, sketch: np.ndarray) -> np.ndarray:
    """Right singular vectors of the passages' matrix (terms x rank): the documents' by their sketch (Nystroem's form), the benchmark's as they are."""
    terms, width = len(block.terms), sketch.shape[1] - 1
    column, sign = _columns(block.terms, width)
    rank = min(RANK, terms)
    group = np.repeat(np.arange(len(block.passages)), [len(p) for p in block.passages])
    cell, tf = np.unique(group * terms + np.concatenate(block.passages), return_counts=True)
    g, t = cell // terms, cell % terms
    weight = np.sqrt(tf) * block.idf[t]
    weight /= np.maximum(np.sqrt(np.bincount(g, weights=weight**2)), 1e-12)[g]
    # the space is to tell the benchmark's passages apart, so they outweigh the documents'
    spread = float((sketch[:, width] * block.idf**2).sum())
    weight *= np.sqrt(BENCHMARK_WEIGHT * spread / len(block.passages)) if spread > 0 else 1.0
    lead = np.flatnonzero(np.diff(g, prepend=-1))

    def project(basis: np.ndarray) -> np.ndarray:
        out = np.empty((len(lead), basis.shape[1]))
        ends = np.append(lead, len(g))
        for low in range(0, len(lead), SEARCH_BLOCK):
            high = min(low + SEARCH_BLOCK, len(lead))
            part = slice(ends[low], ends[high])
            out[low:high] = np.add.reduceat(basis[t[part]] * weight[part, None], lead[low:high] - ends[low], axis=0)
        return out

    start = project(np.random.default_rng(20).standard_normal((terms, min(rank + OVERSAMPLING, terms))))
    order = np.argsort(t, kind="stable")
    own, met = np.zeros_like(start, shape=(terms, start.shape[1])), np.flatnonzero(np.diff(t[order], prepend=-1))
    ends = np.append(met, len(t))
    for low in range(0, len(met), SEARCH_BLOCK):
        high = min(low + SEARCH_BLOCK, len(met))
        part = order[ends[low] : ends[high]]
        own[t[order][met[low:high]]] = np.add.reduceat(start[g[part]] * weight[part, None], met[low:high] - ends[low], axis=0)
    seen = sketch[:, :width] * block.idf[:, None]
    basis, _ = np.linalg.qr(np.concatenate([seen / max(np.linalg.norm(seen), 1e-300), own / max(np.linalg.norm(own), 1e-300)], axis=1))
    # what the sketch's columns say of one another; it is divided out
    core = np.zeros((width, width))
    np.add.at(core, column, sketch[:, :width] * sign[:, None])
    value, vector = np.linalg.eigh((core + core.T) / 2)
    kept = value > 1e-10 * max(value.max(), 1e-300)
    half = (basis.T @ seen) @ (vector[:, kept] / np.sqrt(value[kept]))
    mine = project(basis)
    _, turn = np.linalg.eigh(half @ half.T + mine.T @ mine)
    return np.ascontiguousarray((basis @ turn[:, ::-1][:, :rank])).astype(np.float32)


def prepare_items(spark: SparkSession, documents: DataFrame, block: Items, weights: np.ndarray, sketch: np.ndarray | None = None) -> Items:
    """Weights, latent space, queries and least cosines of a block, whose sketch is counted unless it is given."""
    block.weights = weights
    block.idf = weights[_bucket(block.terms)].astype(float)
    block.space = _fit(block, _counted(documents, block, False)[1] if sketch is None else sketch)
    group = np.repeat(np.arange(len(block.passages)), [len(p) for p in block.passages])
    term = np.concatenate(block.passages)
    latent = _vectors(group, term, block.idf, block.space, len(block.passages))
    length = np.sqrt(np.bincount(group, weights=block.idf[term] ** 2))
    block.query = np.ascontiguousarray((latent / np.maximum(length, 1e-9)[:, None]).T.astype(np.float32))
    n = np.bincount(group)
    kept = np.sum(block.query.astype(float) ** 2, axis=0)  # of a passage's length, what the space holds
    asked = COSINE_SHARE * np.sqrt(np.minimum(n, WINDOW) / np.maximum(n, WINDOW))
    block.least = asked * kept
    cell, tf = np.unique(group * len(block.terms) + term, return_counts=True)
    g, t = cell // len(block.terms), cell % len(block.terms)
    block.reach = np.zeros(len(block.terms))
    np.maximum.at(block.reach, t, np.sqrt(tf) * block.idf[t] / np.maximum(length, 1e-9)[g] / asked[g])
    return block


def common_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bits of a big number a word."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        own = row & masks.get(x, 0)
        if own:
            row = ((row + own) | (row - own)) & full
    return len(a) - row.bit_count()


def _answer(block: Items, item: int) -> np.ndarray:
    """The rarest quarter of an item's distinct words, three at least."""
    own = np.unique(block.item_words[item])
    idf = block.idf[np.searchsorted(block.terms, own)]
    return own[np.argsort(-idf, kind="stable")[: max(3, -(-len(own) // 4))]]


def search(hashes: np.ndarray, rows: np.ndarray, count: int, block: Items):
    """(row, passage, cosine, first word, last word) of windows that reach a passage's least cosine."""
    own, low, high = _windows(rows, count)
    term = block.term(hashes)
    weight = block.weights[_bucket(hashes)].astype(float) ** 2
    whole = np.concatenate([[0], np.cumsum(weight)])
    most = np.concatenate([[0], np.cumsum(np.where(term >= 0, block.idf[term] * block.reach[term], 0))])
    length, part = whole[high] - whole[low], most[high] - most[low]
    keep = np.flatnonzero(part >= np.sqrt(np.maximum(length, 0)) * (1 - 1e-6))
    found = []
    for a in range(0, len(keep), SEARCH_BLOCK):
        w = keep[a : a + SEARCH_BLOCK]
        size = high[w] - low[w]
        take = np.arange(int(size.sum())) + np.repeat(low[w] - (np.cumsum(size) - size), size)
        group = np.repeat(np.arange(len(w)), size)
        known = term[take] >= 0
        latent = _vectors(group[known], term[take][known], block.idf, block.space, len(w))
        latent /= np.sqrt(np.maximum(length[w], 1e-9))[:, None].astype(np.float32)
        for b in range(0, block.query.shape[1], 2048):
            cosine = latent @ block.query[:, b : b + 2048]
            i, j = np.nonzero(cosine >= block.least[b : b + 2048])
            found.append((own[w[i]], j + b, cosine[i, j], low[w[i]], high[w[i]]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0), none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def seeded(hashes: np.ndarray, rows: np.ndarray, block: Items):
    """(row, item, first word, last word) of places that hold words in a row of an item; those within an item's length are one."""
    length = np.array([len(w) for w in block.item_words])
    edges = np.searchsorted(rows, np.arange(int(rows[-1]) + 2)) if len(rows) else np.zeros(1, np.int64)
    found = []
    for size, (keys, owner) in block.seeds.items():
        first, value = _in_a_row(hashes, rows, size)
        at = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
        first, value = first[keys[at] == value], value[keys[at] == value]
        low, high = np.searchsorted(keys, value), np.searchsorted(keys, value, side="right")
        count = high - low
        place = np.repeat(first, count)
        item = owner[np.arange(int(count.sum())) + np.repeat(low - (np.cumsum(count) - count), count)]
        row = rows[place]
        part = (place - edges[row]) // length[item]
        order = np.lexsort((place, part, item, row))
        row, item, part, place = (x[order] for x in (row, item, part, place))
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (part[1:] != part[:-1])
        lead = np.flatnonzero(new)
        if len(lead):
            found.append((row[lead], item[lead], place[lead], place[np.append(lead[1:], len(place)) - 1] + size))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none, none, none)


def _cosine(hashes: np.ndarray, first: int, last: int, low: int, high: int, item: int, block: Items) -> float:
    """The largest cosine of an item's passages with the windows of words first to last that meet low to high."""
    _, a, b = _windows(np.zeros(last - first, np.int64), 1)
    a, b = a + first, b + first
    meets = (a < high) & (b > low)
    best = -1.0
    for x, y in zip(a[meets].tolist(), b[meets].tolist(), strict=True):
        term = block.term(hashes[x:y])
        known = term[term >= 0]
        latent = _vectors(np.zeros(len(known), np.int64), known, block.idf, block.space, 1)[0]
        length = float((block.weights[_bucket(hashes[x:y])].astype(float) ** 2).sum())
        best = max(best, float((latent @ block.query[:, block.passage_item == item]).max()) / max(length, 1e-9) ** 0.5)
    return best


def verified(hashes: np.ndarray, rows: np.ndarray, count: int, block: Items):
    """Dicts of row, item, cosine, common, answer, first and last word of what passes, the best window of each (row, item)."""
    row, passage, cosine, low, high = search(hashes, rows, count, block)
    edges = np.searchsorted(rows, np.arange(count + 1))
    best: dict[tuple[int, int], dict] = {}
    order = np.argsort(-cosine, kind="stable")
    places = [(int(row[k]), int(block.passage_item[passage[k]]), int(low[k]), int(high[k]), float(cosine[k])) for k in order]
    places += [(*map(int, place), None) for place in zip(*seeded(hashes, rows, block), strict=True)]
    for own_row, item, first, last, near in places:
        key = (own_row, item)
        own = block.item_words[item]
        n = len(own)
        old = best.get(key)
        if old and (old["common"] >= 1.0 or old["low"] <= first and last <= old["high"]):
            continue
        a, b = max(edges[own_row], first - n), min(edges[own_row + 1], last + n)
        around = hashes[a:b]
        answer = _answer(block, item)
        share = float(np.isin(answer, around).mean())
        if share < LEAST_ANSWER:
            continue
        found = common_length(own, around) / n
        if found >= LEAST_COMMON and (old is None or found > old["common"]):
            near = _cosine(hashes, int(edges[own_row]), int(edges[own_row + 1]), first, last, item, block) if near is None else near
            best[key] = {"row": own_row, "item": item, "cosine": near, "common": found, "answer": share, "low": int(a), "high": int(b)}
    return list(best.values())


def matches(documents: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each document and item found in it: keep, item_id, cosine, common (share of the item's words in sequence), answer (share of its answer), start and end bytes of what was compared."""
    spark = documents.sparkSession
    common.prepare(spark)
    source = documents.withColumn("text", F.coalesce(F.col(text), F.lit("")))
    rows = benchmark.select("item_id", "text").where("text is not null and trim(text) <> ''").orderBy("item_id", "text")
    frame = source.select(*[F.col(c) for c in keep], F.col("text").alias("__text"))
    extra = StructType.fromDDL("cosine double, common double, answer double, start long, end long")
    item = StructField("item_id", benchmark.schema["item_id"].dataType)
    schema = StructType([f for f in frame.schema.fields if f.name != "__text"] + [item] + [StructField(f.name, f.dataType, False) for f in extra.fields])
    out = weights = None
    corpus = source.select("doc_id" if "doc_id" in documents.columns else F.xxhash64("text").alias("doc_id"), "text")
    for block in _blocks(rows):
        counted, sketch = _counted(corpus, block, weights is None)
        weights = counted if weights is None else weights
        block = prepare_items(spark, corpus, block, weights, sketch)
        found = frame.mapInArrow(common.released(_matcher(spark, block, schema)), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def _blocks(rows: DataFrame) -> Iterator[Items]:
    """The benchmark in bounded blocks of items, those that have words."""
    ids, texts, size = [], [], 0
    for row in rows.toLocalIterator():
        if ids and (len(ids) == ITEM_BLOCK or size + len(row["text"]) > ITEM_CHARACTERS):
            yield from _if_words(items(ids, texts))
            ids, texts, size = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += len(row["text"])
    if ids:
        yield from _if_words(items(ids, texts))


def _if_words(block: Items) -> list[Items]:
    return [block] if len(block.passages) else []


def _matcher(spark: SparkSession, block: Items, schema: StructType):
    shared = spark.sparkContext.broadcast(block)  # ITEM_BLOCK items and ITEM_CHARACTERS characters at most
    item_type = to_arrow_type(schema["item_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for rows, data, offsets in common.texts(batches, "__text"):
            hashes, row, starts, ends = words(data, offsets)
            if not len(hashes):
                continue
            found = verified(hashes, row, len(offsets) - 1, own)
            if not found:
                continue
            at = pa.array([f["row"] for f in found])
            kept = [c.take(at) for c in rows.columns[:-1]]
            base = [int(offsets[f["row"]]) for f in found]
            yield pa.RecordBatch.from_arrays([
                *kept, pa.array([own.ids[f["item"]] for f in found], item_type), *(pa.array([f[n] for f in found], pa.float64()) for n in ("cosine", "common", "answer")),
                pa.array([int(starts[f["low"]]) - b for f, b in zip(found, base, strict=True)], pa.int64()), pa.array([int(ends[f["high"] - 1]) - b for f, b in zip(found, base, strict=True)], pa.int64()),
            ], names=[f.name for f in schema.fields])

    return run


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without those that hold an item. Rows are told apart by all their columns, so one id may have rows that stay and rows that go."""
    names = common.free_names(documents, "one", "two")  # together 128 bits of a row's columns
    marked = documents.withColumns({n: F.xxhash64(F.lit(str(i)), *documents.columns) for i, n in enumerate(names)})
    found = matches(marked, benchmark, keep=names).select(*names).distinct()
    return marked.join(found, list(names), "left_anti").select(*documents.columns)
