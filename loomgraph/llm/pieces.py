"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

A text gets the space in front that the library puts there, and falls into
words: spaces and what follows them. No piece reaches across a word (checked
when the vocabulary is read). The distinct words of a chunk are sorted by length
and advance together, one byte a step: hashes of the substrings that end there
probe the sorted keys of the pieces, and the best predecessor is stored as the
backpointer. For a unigram vocabulary the best has the largest sum of scores.
For a vocabulary of merges the path must also be one that merging in order of
score would leave: a piece may follow another only if no merge across their
boundary comes before a merge inside them. Exactly one such path ends at each
byte, so the ids are those of the library. Characters without a piece become
byte pieces. Words over LONG bytes take the same search one position at a time.

Defined results: null and empty texts have no ids; the mark U+2581 in a text is
a space, as in the library, so decoding gives a space; control pieces are never
encoded and decode to nothing; extra columns pass through if kept; repeated rows
encode alike. Texts are encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from loomgraph.llm import common

MODEL = "piece_bpe_32k.model"
LONG = 256
#: Distinct words whose ids a worker remembers.
REMEMBERED = 300_000

_MARK = "▁".encode()
_BASE = np.uint64(0x5851F42D4C957F2D)
_UNKNOWN = -2
_NEVER = np.int64(1) << np.int64(40)


def _byte_values() -> np.ndarray:
    return common.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_VALUES = _byte_values()


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return common.mix((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64))


def _hash(raw: bytes) -> int:
    h = 0
    for b in raw:
        h = (h * int(_BASE) + int(_VALUES[b])) & (2**64 - 1)
    return h


class Sorted:
    """Ascending 64-bit hashes with values; their first bits lead to where a hash would stand."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        bits = max(8, int(np.ceil(np.log2(len(keys) + 1))) + 3)
        self.shift = np.uint64(64 - bits)
        self.lead = np.searchsorted((self.keys >> self.shift).astype(np.int64), np.arange((1 << bits) + 1)).astype(np.int32)
        self.deepest = int(np.diff(self.lead).max()) if len(keys) else 0

    def look(self, hashes: np.ndarray, missing: int) -> np.ndarray:
        out = np.full(len(hashes), missing, self.values.dtype)
        if not len(self.keys):
            return out
        head = (hashes >> self.shift).astype(np.int64)
        at, end = self.lead[head], self.lead[head + 1]
        left = np.flatnonzero(at < end)
        at, end = at[left], end[left]
        for _ in range(self.deepest):
            hit = self.keys[at] == hashes[left]
            out[left[hit]] = self.values[at[hit]]
            at = at + 1
            more = ~hit & (at < end)
            left, at, end = left[more], at[more], end[more]
            if not len(left):
                break
        return out


@dataclass
class Vocabulary:
    merges: bool
    texts: list[bytes]  # what an id decodes to, a space for the mark
    scores: np.ndarray
    keys: Sorted = field(default=None)  # hashes of pieces, with their ids
    lengths: np.ndarray = field(default=None)  # piece lengths in use
    byte_ids: np.ndarray = field(default=None)
    unknown: int = 0
    rank: np.ndarray = field(default=None)  # of the merge that makes a piece, -1 for single characters
    left: np.ndarray = field(default=None)
    right: np.ndarray = field(default=None)
    pairs: Sorted = field(default=None)  # hashes of (left id, right id) that merge, with the merge's rank
    flat: np.ndarray = field(default=None)
    begin: np.ndarray = field(default=None)
    table: dict | None = field(default=None)
    memory: dict = field(default_factory=dict)  # places of words met before, by hash
    store: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # their ids
    begins: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging in order leaves a before b: undo the merges of both from the last on, and look for an earlier one across."""
        out = np.ones(len(a), bool)
        at, limit = np.arange(len(a)), np.full(len(a), _NEVER)
        a, b = a.astype(np.int64), b.astype(np.int64)
        while len(at):
            across = self.pairs.look(_pair_hash(a, b), _NEVER)
            bad = across < limit
            out[at[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            first = ra > rb
            limit = np.where(first, ra, rb + 1)  # at equal rank the merge further left comes first
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out

    # ------------------------------------------------------------ words

    def search(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words, word after word in some order, and where each word's begin and how many they are."""
        size = ends - starts
        begins, sizes, store, total = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), [np.zeros(0, np.int32)], 0
        for low, high in ((0, 12), (12, 24), (24, 64), (64, LONG)):
            own = np.flatnonzero((size > low) & (size <= high))
            if len(own):
                own = own[np.argsort(-size[own], kind="stable")]
                ids, edges = self._together(data, starts[own], size[own])
                store.append(ids)
                begins[own], sizes[own] = edges[:-1] + total, np.diff(edges)
                total += len(ids)
        for k in np.flatnonzero(size > LONG).tolist():
            ids = self._alone(data[starts[k] : ends[k]].tobytes())
            store.append(ids)
            begins[k], sizes[k] = total, len(ids)
            total += len(ids)
        return np.concatenate(store), begins, sizes

    def _together(self, data: np.ndarray, begins: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count, most = len(size), int(size[0])
        place = np.arange(most)[:, None]
        matrix = np.where(place < size, data[np.minimum(begins + place, len(data) - 1)], 0).astype(np.uint8)  # a row a position
        start = np.ones((most + 1, count), bool)
        start[:most] = (matrix & 0xC0) != 0x80
        prefix = np.zeros((most + 1, count), np.uint64)
        for i in range(most):
            prefix[i + 1] = prefix[i] * _BASE + _VALUES[matrix[i]]
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(most, _BASE)]), dtype=np.uint64)
        piece = np.full((most + 1, count), _UNKNOWN, np.int32)
        width = np.zeros((most + 1, count), np.int32)
        best = np.zeros((most + 1, count))
        lowest = self.scores.min() - 10 if len(self.scores) else -10.0
        lengths = self.lengths[::-1].tolist()
        active = np.searchsorted(-size, -np.arange(most + 1), side="right")  # words at least that long
        for i in range(1, most + 1):
            n = active[i]
            ends = np.flatnonzero(start[i, :n] | (size[:n] == i))
            open_ = ends
            score = np.full(n, -np.inf)
            for k in lengths:
                if k > i or not len(open_):
                    continue
                who = open_[start[i - k, open_]]
                if not len(who):
                    continue
                found = self.keys.look(prefix[i, who] - prefix[i - k, who] * power[k], -1)
                hit = found >= 0
                who, found = who[hit], found[hit]
                if not len(who):
                    continue
                if self.merges:
                    if i > k:
                        before = piece[i - k, who]
                        fits = before == _UNKNOWN
                        ask = np.flatnonzero(~fits)
                        fits[ask] = self.compatible(before[ask], found[ask])
                        who, found = who[fits], found[fits]
                    piece[i, who], width[i, who] = found, k
                    open_ = np.setdiff1d(open_, who, assume_unique=True) if len(who) else open_
                else:
                    total = best[i - k, who] + self.scores[found]
                    better = total > score[who]
                    who, found = who[better], found[better]
                    score[who], piece[i, who], width[i, who] = total[better], found, k
            # a character of its own, unknown
            if self.merges:
                lone = open_
            else:
                lone = ends
            if len(lone):
                k = np.ones(len(lone), np.int32)
                while True:
                    more = ~start[i - k, lone]
                    if not more.any():
                        break
                    k += more
                if not self.merges:
                    total = best[i - k, lone] + lowest
                    single = self.keys.look(prefix[i, lone] - prefix[i - k, lone] * power[k], -1) < 0
                    better = (total > score[lone]) & single
                    lone, k = lone[better], k[better]
                    score[lone] = total[better]
                piece[i, lone], width[i, lone] = _UNKNOWN, k
            best[i, ends] = score[ends]
        # backpointers, all words at once
        at, who = size.copy(), np.arange(count)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        while len(who):
            p, k = piece[at[who], who], width[at[who], who]
            parts.append((who, at[who] - k, p, k))
            at[who] -= k
            who = who[at[who] > 0]
        word, begin, p, k = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((begin, word))
        word, begin, p, k = word[order], begin[order], p[order], k[order]
        if (p == _UNKNOWN).any():
            if self.byte_ids is not None:
                times = np.where(p == _UNKNOWN, k, 1)
                rep = np.repeat(np.arange(len(p)), times)
                inner = np.arange(len(rep)) - np.repeat(np.concatenate([[0], np.cumsum(times)[:-1]]), times)
                unknown = p[rep] == _UNKNOWN
                raw = matrix[np.minimum(begin[rep] + inner, most - 1), word[rep]]
                word, p = word[rep], np.where(unknown, self.byte_ids[raw], p[rep])
            else:
                p = np.where(p == _UNKNOWN, self.unknown, p)
        return p.astype(np.int32), np.searchsorted(word, np.arange(count + 1))

    def _alone(self, word: bytes) -> np.ndarray:
        """The same search for one word, position by position; pairs of pieces are checked once."""
        if self.table is None:
            self.table = {self.texts[i]: int(i) for i in self.keys.values.tolist()}
        table = self.table
        checked: dict[tuple[int, int], bool] = {}
        most = len(word)
        piece, width, best = [_UNKNOWN] * (most + 1), [0] * (most + 1), [0.0] * (most + 1)
        lowest = self.scores.min() - 10
        lengths = self.lengths[::-1].tolist()
        start = [(b & 0xC0) != 0x80 for b in word] + [True]
        for i in range(1, most + 1):
            if not start[i]:
                continue
            score = -np.inf
            chosen = None
            for k in lengths:
                if k > i or not start[i - k]:
                    continue
                found = table.get(word[i - k : i])
                if found is None:
                    continue
                if self.merges:
                    before = piece[i - k]
                    pair = (before, found)
                    if i > k and before != _UNKNOWN and pair not in checked:
                        checked[pair] = bool(self.compatible(np.array([before]), np.array([found]))[0])
                    if i == k or before == _UNKNOWN or checked[pair]:
                        chosen = (found, k)
                        break
                elif best[i - k] + self.scores[found] > score:
                    score, chosen = best[i - k] + self.scores[found], (found, k)
            k = 1
            while not start[i - k]:
                k += 1
            if chosen is None or (not self.merges and best[i - k] + lowest > score and word[i - k : i] not in table):
                score, chosen = best[i - k] + lowest, (_UNKNOWN, k)
            piece[i], width[i], best[i] = *chosen, score
        out, i = [], most
        while i > 0:
            if piece[i] == _UNKNOWN:
                raw = word[i - width[i] : i]
                out += [int(self.byte_ids[b]) for b in reversed(raw)] if self.byte_ids is not None else [self.unknown]
            else:
                out.append(piece[i])
            i -= width[i]
        return np.array(out[::-1], np.int32)

    # ------------------------------------------------------------ texts

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and where each row's begin (one more entry at the end)."""
        data, offsets = _prefixed(data, offsets)
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
        space = data == 32
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(data))
        hashes, lead, which = np.unique(common.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        keys = hashes.tolist()
        slots = np.fromiter((self.memory.get(h, -1) for h in keys), np.int64, len(keys))
        new = np.flatnonzero(slots < 0)
        if len(new):
            found, at, many = self.search(data, starts[lead[new]], ends[lead[new]])
            if len(self.memory) + len(new) > REMEMBERED:  # keep only what this chunk has
                old = np.flatnonzero(slots >= 0)
                kept, take = slots[old], self.sizes[slots[old]]
                edge = np.concatenate([[0], np.cumsum(take)])
                self.store = self.store[np.arange(edge[-1]) - np.repeat(edge[:-1] - self.begins[kept], take)]
                self.begins, self.sizes = edge[:-1], take
                slots[old] = np.arange(len(old))
                self.memory = {keys[i]: k for k, i in enumerate(old.tolist())}
            slots[new] = len(self.begins) + np.arange(len(new))
            self.begins, self.sizes = np.concatenate([self.begins, at + len(self.store)]), np.concatenate([self.sizes, many])
            self.store = np.concatenate([self.store, found])
            self.memory.update(zip(hashes[new].tolist(), slots[new].tolist(), strict=True))
        begin, size, store = self.begins[slots], self.sizes[slots], self.store
        length = size[which]
        edge = np.concatenate([[0], np.cumsum(length)])
        take = np.arange(edge[-1]) - np.repeat(edge[:-1] - begin[which], length)
        return store[take], edge[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows one after another, without the space that encoding put in front, and their offsets."""
        size = self.begin[ids + 1] - self.begin[ids]
        edge = np.concatenate([[0], np.cumsum(size)])
        take = np.arange(edge[-1]) - np.repeat(edge[:-1] - self.begin[ids], size)
        data, offsets = self.flat[take], edge[edges]
        has = np.flatnonzero(np.diff(offsets) > 0)
        drop = offsets[has][data[offsets[has]] == 32]
        keep = np.ones(len(data), bool)
        keep[drop] = False
        return data[keep], offsets - np.concatenate([[0], np.cumsum(~keep)])[offsets]


def _prefixed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row that isn't empty with a space in front; marks become spaces."""
    if len(data) and (data == _MARK[0]).any() and _MARK in (raw := data.tobytes()):
        parts = [raw[a:b].replace(_MARK, b" ") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        data = np.frombuffer(b"".join(parts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    size = np.diff(offsets)
    extra = (size > 0).astype(np.int64)
    new = np.concatenate([[0], np.cumsum(size + extra)])
    out = np.full(new[-1], 32, np.uint8)
    target = np.arange(len(data)) + np.repeat(np.cumsum(extra), size)
    out[target] = data
    return out, new


# ---------------------------------------------------------------- reading a vocabulary


def _merged(symbols: list[int], join: dict[tuple[int, int], tuple[int, int]]) -> tuple[list[int], tuple[int, int]]:
    """Symbols after all merges, and the last merge's parts."""
    last = (-1, -1)
    while len(symbols) > 1:
        options = [(join[p], i) for i, p in enumerate(zip(symbols[:-1], symbols[1:], strict=True)) if p in join]
        if not options:
            break
        (_, made), i = min(options)
        last = (symbols[i], symbols[i + 1])
        symbols = [*symbols[:i], made, *symbols[i + 2 :]]
    return symbols, last


@lru_cache(2)
def load(name: str = MODEL, path: str | None = None, unigram: bool | None = None) -> Vocabulary:
    """Read a .model file. unigram overrides the kind of search that the file names."""
    import public_tokenizers
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path or public_tokenizers.path(name), "rb") as source:
        model.ParseFromString(source.read())
    rules = model.normalizer_spec
    if rules.name != "identity" or rules.precompiled_charsmap or not rules.add_dummy_prefix or rules.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only vocabularies without normalisation, with a space in front, are read")
    merges = model.trainer_spec.model_type == 2 if unigram is None else not unigram
    kinds = [p.type for p in model.pieces]
    texts, plain = [], []
    byte_ids = np.full(256, -1, np.int32)
    unknown = 0
    for i, p in enumerate(model.pieces):
        if p.type == 6:
            value = int(p.piece[1:-1], 16)
            byte_ids[value] = i
            texts.append(bytes([value]))
        elif p.type in (1, 4):
            texts.append(p.piece.replace("▁", " ").encode())
            plain.append(i)
            if " " in p.piece.replace("▁", " ").lstrip(" "):
                raise ValueError("a piece reaches across words")
        else:
            unknown = i if p.type == 2 else unknown
            texts.append(" ⁇ ".encode() if p.type == 2 else b"")
    del kinds
    scores = np.array([p.score for p in model.pieces], float)
    out = Vocabulary(merges, texts, scores, byte_ids=byte_ids if (byte_ids >= 0).all() else None, unknown=unknown)
    count = len(texts)
    out.rank, out.left, out.right = np.full(count, -1, np.int64), np.full(count, -1, np.int64), np.full(count, -1, np.int64)
    reached = plain
    if merges:
        named = {model.pieces[i].piece: i for i in plain}
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in plain}, reverse=True))}
        join = {}
        for text, i in named.items():
            for cut in range(1, len(text)):
                a, b = named.get(text[:cut]), named.get(text[cut:])
                if a is not None and b is not None:
                    join[a, b] = (order[scores[i]], i)
        reached = []
        for text, i in named.items():
            symbols = [named.get(c, -1) for c in text]
            done, last = _merged(symbols, join)
            if done == [i]:
                reached.append(i)
                if len(text) > 1:
                    out.rank[i], out.left[i], out.right[i] = order[scores[i]], *last
        a, b, r = (np.array(x, np.int64) for x in zip(*((a, b, r) for (a, b), (r, _) in join.items()), strict=True))
        out.pairs = Sorted(_pair_hash(a, b), r)
    else:
        out.pairs = Sorted(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    out.keys = Sorted(np.array([_hash(texts[i]) for i in reached], np.uint64), np.array(reached, np.int32))
    out.lengths = np.unique([len(texts[i]) for i in reached])
    out.scores = scores
    out.flat = np.frombuffer(b"".join(texts), np.uint8)
    out.begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    return out


def _shared(spark: SparkSession, vocabulary: Vocabulary):
    return spark.sparkContext.broadcast(vocabulary)  # bounded by the vocabulary


def encode(documents: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, then ids array<int> of the text."""
    common.prepare(documents.sparkSession)
    frame = documents.select(*keep, F.col(text).alias("__text"))
    shared = _shared(documents.sparkSession, vocabulary)
    schema = frame.drop("__text").schema.add("ids", ArrayType(IntegerType(), False), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for rows, data, offsets in common.texts(batches, "__text"):
            ids, edges = own.encode(data, offsets)
            lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids), pa.list_(pa.field("element", pa.int32(), False)))
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], lists], names=[*rows.schema.names[:-1], "ids"])

    return frame.mapInArrow(common.released(run), schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary, column: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and the ids, then decoded, the text they stand for; bytes that are no UTF-8 become U+FFFD."""
    common.prepare(encoded.sparkSession)
    frame = encoded.select(*keep, F.coalesce(F.col(column), F.array().cast("array<int>")).alias("ids"))
    shared = _shared(encoded.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            edges = lists.offsets.to_numpy().astype(np.int64)
            for low, high in common.slices(edges, 1 << 20):
                ids = lists.values.to_numpy()[edges[low] : edges[high]]
                data, offsets = own.decode(ids, edges[low : high + 1] - edges[low])
                raw = data.tobytes()
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                rows = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], names=[*rows.schema.names, "decoded"])

    return frame.mapInArrow(common.released(run), StructType([*frame.schema.fields, StructField("decoded", StringType(), False)]))
