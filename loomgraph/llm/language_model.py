"""An interpolated modified Kneser-Ney model of word n-grams, counted in Spark and memory-mapped for scoring.

Words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case, then one end, are the tokens
of a text; starts that aren't tokens stand before the first, one fewer than the
order. A task sums the words and n-grams of the texts it reads and sends them,
by the hash of an n-gram's context, to buckets: an n-gram and all that follows
its context meet in one, and a frequent word is spread over its predecessors. A
bucket adds them up and writes its n-grams to the shared folder as sorted hash
arrays with their counts, and its contexts, unless one n-gram seen once is all
that follows. How many kinds of word stood before what is left of each n-gram
without its first word goes to the next round, down to single words, whose
arrays are count, kinds before, and what followed once, twice, more. Only sums
of counts of counts come to the driver, for the discounts. Workers map these
files and look up each chunk's distinct n-grams in sorted order.

    P(w | u..v) = (c(u..vw) - D(c)) / c(u..v) + g(u..v) P(w | ..v)
    P(w)        = (k(w) - D'(k(w))) / pairs + g' / (V + 1)

c: how often n-grams of the whole order occur, and for shorter ones how many
kinds of word stand before them; k(w): kinds of word before w; D, D': discounts
of each length for counts of one, two and more; g, g': what the discounts
leave; V: distinct tokens, and one for what is unknown. After a context that
was never seen, P is that of the shorter one.

Defined results: null is an empty text, whose one token is the end; a null id
isn't held out; with nothing to learn from, every token has probability one;
extra columns are ignored; repeated rows are learned from as often as they
occur, and score alike; an order below two is refused. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common, shards

#: Words of an n-gram.
ORDER = 2
#: Tokens whose n-grams a task sums before it sends them on.
FLUSH_TOKENS = 4_000_000
SCORE_BYTES = 4 << 20

START = np.uint64(0x243F6A8885A308D3)
END = np.uint64(0x13198A2E03707344)
_GRAMS = ("<u8", "u1", "<u8", "<u8")
_CONTEXTS = ("<u8", "<u8", "<u4", "<u4", "<u4")
_WORDS = ("<u8", "<u8", "<u4", "<u4", "<u4", "<u4")
#: What tasks send to buckets: words with their counts, or n-grams with theirs, and sums of counts of counts.
_SENT = pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in ("words", "values", "vocabulary", "grams", "times")), ("stats", pa.list_(pa.int64()))])
_SENT_SQL = "bucket int, words binary, values binary, vocabulary binary, grams binary, times binary, stats array<long>"


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token, and where each row's tokens begin (one more entry at the end)."""
    lower = common.LOWER[data]
    starts, ends, row = common.word_spans(lower, offsets)
    rows = len(offsets) - 1
    token = np.full(len(starts) + rows, END)
    token[np.arange(len(starts)) + row] = common.span_hashes(lower, starts, ends)
    return token, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows) + 1)])


def columns(token: np.ndarray, edges: np.ndarray, order: int, start) -> list[np.ndarray]:
    """The words of the n-gram that ends at each token, first to last."""
    place = np.arange(len(token)) - np.repeat(edges[:-1], np.diff(edges))
    out = [token]
    for back in range(1, order):
        before = np.empty_like(token)
        before[back:] = token[:-back]
        before[place < back] = start
        out.insert(0, before)
    return out


def pair_key(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return common.mix(before * np.uint64(0xD6E8FEB86659FD93) + common.mix(token))


def gram_key(words: list[np.ndarray]) -> np.ndarray:
    return reduce(pair_key, words)


def _runs(ascending: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], ascending[1:] != ascending[:-1]])) if len(ascending) else np.zeros(0, np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = _runs(keys)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _distinct(numbers: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of columns of numbers below 2**32, in ascending order, and how often each occurs."""
    lead, found = numbers[0].astype(np.uint64), []
    for column in numbers[1:-1]:
        keys, lead = np.unique(lead << np.uint64(32) | column.astype(np.uint64), return_inverse=True)
        begin = (keys >> np.uint64(32)).astype(np.int64)
        found = [*(f[begin] for f in found), keys & np.uint64(0xFFFFFFFF)] if found else [begin, keys & np.uint64(0xFFFFFFFF)]
        lead = lead.astype(np.uint64)
    at = lead << np.uint64(32) | numbers[-1].astype(np.uint64)
    at.sort()
    first = _runs(at)
    begin = (at[first] >> np.uint64(32)).astype(np.int64)
    return [*(f[begin].astype(np.int64) for f in found or [np.arange(int(begin.max()) + 1)]), (at[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)], np.diff(np.append(first, len(at)))


def _parted(home: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(home, kind="stable")
    edges = np.searchsorted(home[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        yield b, order[edges[b] : edges[b + 1]]


def _send_grams(words: list[np.ndarray], times: np.ndarray, home: np.ndarray, buckets: int, names: np.ndarray | None = None) -> Iterator[dict]:
    """Rows of n-grams for each bucket, as numbers of the row's own words. Words are hashes, or places in the hashes `names`."""
    for b, own in _parted(home, buckets):
        used, number = np.unique(np.concatenate([w[own] for w in words]), return_inverse=True)
        yield {"bucket": b, "vocabulary": shards.pack_sorted(used if names is None else names[used]), "grams": shards.pack_planes(number.astype("<u4")), "times": shards.pack(times[own].astype("<u4"))}


def _sent_grams(rows: list[dict], width: int) -> tuple[list[np.ndarray], np.ndarray]:
    parts, times = [], []
    for r in rows:
        if r["vocabulary"] is not None:
            parts.append(shards.unpack_sorted(r["vocabulary"])[shards.unpack_planes(r["grams"])].reshape(width, -1))
            times.append(shards.unpack(r["times"], "<u4"))
    if not parts:
        return [np.zeros(0, np.uint64)] * width, np.zeros(0, np.int64)
    return list(np.concatenate(parts, axis=1)), np.concatenate(times).astype(np.int64)


def _sent_words(rows: list[dict], values: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and the sums of so many values of each."""
    got = [(shards.unpack_sorted(r["words"]), shards.unpack(r["values"], "<i8").reshape(values, -1)) for r in rows if r["words"] is not None]
    if not got:
        return np.zeros(0, np.uint64), np.zeros((values, 0), np.int64)
    words, at = np.unique(np.concatenate([w for w, _ in got]), return_inverse=True)
    out = np.zeros((values, len(words)), np.int64)
    for target, given in zip(out, np.concatenate([v for _, v in got], axis=1), strict=True):
        np.add.at(target, at, given)
    return words, out


@dataclass
class Model:
    folder: str
    buckets: int
    order: int
    train_tokens: int
    distinct_tokens: int
    pairs: int
    #: Of n-grams of two words, three, and so on.
    discounts: tuple[tuple[float, float, float], ...]
    kind_discounts: tuple[float, float, float]
    kind_spare: float

    def _values(self, name: str, kinds: tuple[str, ...], wanted: np.ndarray) -> list[np.ndarray]:
        """What the files of a name say of distinct hashes: zeros where they don't know one."""
        out = [np.zeros(len(wanted), np.int64) for _ in kinds[1:]]
        for b, own in _parted(wanted % np.uint64(self.buckets), self.buckets):
            keys, *values = shards.read(self.folder, f"{name}-{b}", kinds)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, wanted[own]), len(keys) - 1)
                hit = keys[at] == wanted[own]
                for target, value in zip(out, values, strict=True):
                    target[own[hit]] = value[at[hit]]
        return out

    def _gram_counts(self, length: int, context: np.ndarray, key: np.ndarray) -> np.ndarray:
        out = np.zeros(len(key), np.int64)
        home = context % np.uint64(self.buckets)
        order = np.lexsort((key, home))
        edges = np.searchsorted(home[order], np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            own = order[edges[b] : edges[b + 1]]
            keys, counts, many, large = shards.read(self.folder, f"grams{length}-{b}", _GRAMS)
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, key[own]), len(keys) - 1)
            got = np.where(keys[at] == key[own], counts[at], 0).astype(np.int64)
            full = np.flatnonzero(got == 255)
            if len(full):
                got[full] = large[np.searchsorted(many, key[own[full]])]
            out[own] = got
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray):
        """Per row: tokens, known tokens, base score, score."""
        token, edges = tokens(data, offsets)
        rows = len(edges) - 1
        row = np.repeat(np.arange(rows), np.diff(edges))
        words, which = np.unique(np.concatenate([token, [START]]), return_inverse=True)
        count, kinds, once, twice, more, *total = self._values("words", _words_kinds(self.order), words)
        after = total[0] if total else count
        d1, d2, d3 = self.kind_discounts
        single = np.full(len(words), self.kind_spare / (self.distinct_tokens + 1))
        if self.pairs:
            single += np.where(kinds > 0, (kinds - np.choose(np.minimum(kinds, 3), (0.0, d1, d2, d3))) / self.pairs, 0)
        at = which[:-1]
        chance = single[at]
        gram, counted = columns(token, edges, self.order, START), None
        for length, (e1, e2, e3) in enumerate(self.discounts, 2):
            context = gram_key(gram[-length:-1])
            key, first, back = np.unique(pair_key(context, token), return_index=True, return_inverse=True)
            c = self._gram_counts(length, context[first], key)[back]
            if length == 2:
                prior = np.empty_like(at)
                prior[1:] = at[:-1]
                prior[edges[:-1]] = which[-1]
                follow = [x[prior] for x in (after, once, twice, more)]
            else:
                known, back = np.unique(context, return_inverse=True)
                follow = [x[back] for x in self._values(f"contexts{length}", _CONTEXTS, known)]
                seen = np.zeros(len(token), bool)
                seen[1:] = counted[:-1] > 0
                seen[edges[:-1]] = False
                lone = seen & (follow[0] == 0)  # one n-gram seen once is all that follows: not kept
                follow[0][lone] = follow[1][lone] = 1
            safe = np.maximum(follow[0], 1)
            own = np.where(c > 0, (c - np.choose(np.minimum(c, 3), (0.0, e1, e2, e3))) / safe, 0.0)
            chance = own + np.where(follow[0] > 0, (e1 * follow[1] + e2 * follow[2] + e3 * follow[3]) / safe, 1.0) * chance
            counted = c
        logs = np.log10(chance)
        base = np.log10((count + 1.0) / (self.train_tokens + 1 * (self.distinct_tokens + 1)))[at]
        return np.diff(edges), np.bincount(row, weights=count[at] > 0, minlength=rows).astype(np.int64), np.add.reduceat(base, edges[:-1]), np.add.reduceat(logs, edges[:-1])


def _words_kinds(order: int) -> tuple[str, ...]:
    """Of pairs alone, a word is followed as often as it occurs; of longer n-grams, by kinds of pairs."""
    return _WORDS if order == 2 else (*_WORDS, "<u8")


def _discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """Chen and Goodman's discounts from counts of counts; 0.5, 1 and 1.5 where they can't be had."""
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(float(np.clip(d, 0.05, k)) for k, d in ((0.99, 1 - 2 * y * n2 / n1), (1.99, 2 - 3 * y * n3 / n2), (2.99, 3 - 4 * y * n4 / n3)))


def train(documents: DataFrame, text: str = "text", order: int = ORDER) -> Model:
    """Count all texts of the frame. The model's files stay in the shared folder."""
    if order < 2:
        raise ValueError("n-grams have two words at least")
    spark = documents.sparkSession
    common.prepare(spark)
    buckets = common.bucket_count(documents, 1)
    folder = common.shared_folder(spark, "language-model")
    width = 7 + 5 * (order - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            token = np.concatenate([t for t, _ in held])
            lengths = np.concatenate([np.diff(e) for _, e in held])
            edges = np.concatenate([[0], np.cumsum(lengths)])
            words, at, number = np.unique(np.concatenate([token, np.repeat(START, len(lengths))]), return_inverse=True, return_counts=True)
            start = at[-1]
            gram, times = _distinct(columns(at[: len(token)], edges, order, start))
            for b, own in _parted(words % np.uint64(buckets), buckets):
                yield {"bucket": b, "words": shards.pack_sorted(words[own]), "values": shards.pack(number[own].astype("<i8"))}
            yield from _send_grams(gram, times, gram_key([words[g] for g in gram[:-1]]) % np.uint64(buckets), buckets, words)

        for _, data, offsets in common.texts(batches):
            held.append(tokens(data, offsets))
            size += len(held[-1][0])
            if size >= FLUSH_TOKENS:
                yield from (pa.RecordBatch.from_pylist([r], _SENT) for r in flush())
                held, size = [], 0
        if held:
            yield from (pa.RecordBatch.from_pylist([r], _SENT) for r in flush())

    def add_up(length: int):
        def run(table: pa.Table) -> pa.Table:
            rows = table.to_pylist()
            bucket = rows[0]["bucket"]
            words, values = _sent_words(rows, 1)
            gram, times = _sent_grams(rows, length)
            stats = np.sum([r["stats"] or [0] * width for r in rows], axis=0)
            context = gram_key(gram[:-1])
            key = pair_key(context, gram[-1])
            order_ = np.argsort(key)
            first = _runs(key[order_])
            total = np.add.reduceat(times[order_], first) if len(first) else times
            own = order_[first]
            key, context, gram = key[own], context[own], [g[own] for g in gram]
            many = np.flatnonzero(total >= 255)
            shards.write(folder, f"grams{length}-{bucket}", [key, np.minimum(total, 255).astype("u1"), key[many], total[many].astype("<u8")])
            known, at = (words, np.searchsorted(words, context)) if length == 2 and order == 2 else np.unique(context, return_inverse=True)
            after = [np.bincount(at, weights=total, minlength=len(known)).astype("<i8"), *(np.bincount(at[pick], minlength=len(known)) for pick in (total == 1, total == 2, total >= 3))]
            if length > 2:
                kept = np.flatnonzero((after[0] > 1) | (known == gram_key([np.array([START])] * (length - 1))))
                shards.write(folder, f"contexts{length}-{bucket}", [known[kept], after[0][kept].astype("<u8"), *(x[kept].astype("<u4") for x in after[1:])])
            else:
                real = words != START
                stats[5:7] = int(values[0][real].sum()), int(real.sum())
                wide = np.zeros((5, len(words)), np.int64)
                wide[0] = values[0]
                place = np.searchsorted(words, known)
                for target, x in zip(wide[1:], after, strict=True):
                    target[place] = x
                values = wide
            stats[7 + 5 * (length - 2) : 12 + 5 * (length - 2)] = len(key), *(int((total == k).sum()) for k in (1, 2, 3, 4))
            out = [{"bucket": bucket, "words": shards.pack_sorted(words), "values": shards.pack(values.astype("<i8")), "stats": stats.tolist()}]
            ending = gram_key(gram[1:])
            by = np.argsort(ending)
            first = _runs(ending[by])
            rest = [g[by[first]] for g in gram[1:]]
            home = gram_key(rest[:-1] or rest) % np.uint64(buckets)
            out += _send_grams(rest, np.diff(np.append(first, len(by))), home, buckets)
            return pa.Table.from_pylist(out, _SENT)

        return run

    def finish(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        words, (number, after, *fans) = _sent_words(rows, 5)
        (before,), times = _sent_grams(rows, 1)
        kinds = np.zeros(len(words), np.int64)
        np.add.at(kinds, np.searchsorted(words, before), times)
        shards.write(folder, f"words-{rows[0]['bucket']}", [words, number.astype("<u8"), kinds.astype("<u4"), *(v.astype("<u4") for v in fans), *([after.astype("<u8")] if order > 2 else [])])
        stats = np.sum([r["stats"] or [0] * width for r in rows], axis=0)
        stats[:5] = *(int((kinds == k).sum()) for k in (1, 2, 3, 4)), int((kinds >= 3).sum())
        return pa.Table.from_pylist([{"stats": stats.tolist()}], pa.schema([("stats", pa.list_(pa.int64()))]))

    sent = documents.select(F.col(text).alias("text")).mapInArrow(common.released(count), _SENT_SQL)
    written = []
    for length in range(order, 1, -1):
        sent = sent.groupBy("bucket").applyInArrow(add_up(length), _SENT_SQL)
        if length > 2:  # what was shuffled for longer n-grams can go
            sent = common.cut(spark, sent, "language-model-counts")
            written.append(sent)
    stats = sent.groupBy("bucket").applyInArrow(finish, "stats array<long>")
    k1, k2, k3, k4, k3up, number, distinct, *seen = (int(x or 0) for x in stats.agg(*(F.sum(F.col("stats")[i]) for i in range(width))).first())
    common.discard(*written)
    kind_discounts, pairs = _discounts(k1, k2, k3, k4), seen[0]
    spare = sum(d * k for d, k in zip(kind_discounts, (k1, k2, k3up), strict=True)) / pairs if pairs else 1.0
    return Model(folder, buckets, order, number, distinct, pairs, tuple(_discounts(*seen[i + 1 : i + 5]) for i in range(0, len(seen), 5)), kind_discounts, spare)


def score(documents: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, then n_tokens, n_known, train_tokens, base_score, score (log10) and perplexity."""
    frame = documents.select(*keep, F.col(text).alias("__text"))
    out_schema = frame.drop("__text").schema.add("n_tokens", "long", False).add("n_known", "long", False).add("train_tokens", "long", False).add("base_score", "double", False).add("score", "double", False).add("perplexity", "double", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in common.texts(batches, "__text", SCORE_BYTES):
            number, known, base, logs = model.scores(data, offsets)
            with np.errstate(over="ignore"):
                perplexity = 10 ** (-logs / number)
            arrays = [pa.array(number), pa.array(known), pa.array(np.full(len(number), model.train_tokens)), pa.array(base), pa.array(logs), pa.array(perplexity)]
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *arrays], names=[*rows.schema.names[:-1], "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return frame.mapInArrow(common.released(run), out_schema)
