"""Toxicity by class-conditional Kneser-Ney models of the bytes inside words.

Two models, one of toxic and one of ordinary documents, predict each byte of a
word (A-Z in lower case) from up to HISTORY bytes before it, the space in front
of the word included. Each has its own counts for the full history, discounted
by DISCOUNT, and backs off to one Kneser-Ney chain of continuation counts that both share,
so that an expression rare in both classes scores alike under either. The
difference of the two log-likelihoods, divided by the length, is what is
compared: over the whole document, and over its most telling words. A logistic
fit on labelled rows that the models didn't see turns these into a score.

Defined results: a null or empty text, or one without words, scores the fit's
value for no evidence (below 0.5); a null id is not held out; an id that is
labelled both ways isn't learned from, and of rows that share a labelled id one
is; extra columns are ignored; repeated rows score alike. Texts are read whole,
however long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import common, shards

#: Bytes of history of the full order; seven and the byte itself make a number.
HISTORY = 7
#: What the class counts of the full order are discounted by. What one class has seen once says nothing.
DISCOUNT = 1.0
#: Labelled rows of either class that are used at most.
SAMPLE_ROWS = 3000
#: Longer documents aren't drawn into the sample, which bounds its bytes.
SAMPLE_TEXT_BYTES = 32768
#: A word counts as telling from this log-likelihood difference on.
TELLING = 3.0


def _keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte of each word: eight bytes that end there, its index in the word, and the word."""
    lengths = ends - starts
    word = np.repeat(np.arange(len(starts)), lengths)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
    inside = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    padded = np.concatenate([np.full(8, 32, np.uint8), data])
    at = np.repeat(starts, lengths) + inside
    eight = np.ndarray((len(padded) - 7,), ">u8", np.ascontiguousarray(padded).data, 0, (1,))[at + 1].astype(np.uint64)
    return eight, inside, word


def _shortened(eight: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The last n (1 to 8) of eight bytes."""
    return eight & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((np.uint64(8) - n.astype(np.uint64)) * np.uint64(8)))


def _gram(eight: np.ndarray, inside: np.ndarray, history: int) -> tuple[np.ndarray, np.ndarray]:
    """The last bytes and how many: at most history + 1, no further back than the space before the word."""
    n = np.minimum(inside + 2, history + 1)
    # where the space belongs, what stands before the word in the buffer is another byte of white space
    shift = (n - 1).astype(np.uint64) * np.uint64(8)
    first = inside + 2 <= history + 1
    own = _shortened(eight, n)
    return np.where(first, (own & ~(np.uint64(255) << shift)) | (np.uint64(32) << shift), own), n


def _key(gram: np.ndarray, n: np.ndarray) -> np.ndarray:
    return common.mix(gram ^ (n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _context_key(gram: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The key of what stands before the last byte."""
    return _key(gram >> np.uint64(8), n + 16)


def _discount(counts: np.ndarray) -> float:
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return once / (once + 2 * twice) if once and twice else 0.75


_ARRAYS = {"grams": "<u8", "gram_difference": "<f8", "contexts": "<u8", "context_difference": "<f8", "weights": "<f8", "centre": "<f8", "scale": "<f8"}


@dataclass
class Model:
    """Sorted keys with the log-likelihood difference of a byte after its history, seen or not, and the fit."""

    grams: np.ndarray
    gram_difference: np.ndarray
    contexts: np.ndarray
    context_difference: np.ndarray
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, name) for name in _ARRAYS]

    @staticmethod
    def read(folder: str) -> Model:
        return Model(*shards.read(folder, "model", tuple(_ARRAYS.values())))

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log-likelihood difference of each word, its end included."""
        eight, inside, word = _keys(data, starts, ends)
        gram, n = _gram(eight, inside, HISTORY)
        if not len(self.grams):
            return np.zeros(len(starts))
        history = _context_key(gram, n)
        at = np.minimum(np.searchsorted(self.contexts, history), len(self.contexts) - 1)
        met = self.contexts[at] == history  # a history that neither class knows tells nothing
        value = np.where(met, self.context_difference[at], 0.0)
        known = np.flatnonzero(met)
        key = _key(gram[known], n[known])
        at = np.minimum(np.searchsorted(self.grams, key), len(self.grams) - 1)
        hit = self.grams[at] == key
        value[known[hit]] = self.gram_difference[at[hit]]
        return np.bincount(word, weights=value, minlength=len(starts))

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        lower = common.LOWER[data]
        starts, ends, rows = common.word_spans(lower, offsets)
        out = np.zeros((len(offsets) - 1, 4))
        if not len(starts):
            return out
        hashes = common.span_hashes(lower, starts, ends)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        value = self.words(lower, starts[first], ends[first])[which]
        n = np.bincount(rows, minlength=len(out))
        size = np.bincount(rows, weights=ends - starts, minlength=len(out))
        has = n > 0
        begin = np.searchsorted(rows, np.flatnonzero(has))
        out[has, 0] = np.bincount(rows, weights=value, minlength=len(out))[has] / size[has]
        out[has, 1] = np.maximum.reduceat(value, begin)
        telling = np.bincount(rows, weights=value > TELLING, minlength=len(out))
        out[:, 2] = np.log1p(telling)
        out[has, 3] = np.sqrt(telling[has] / n[has])
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, values[at], 0.0)


def _shared_chain(gram: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The Kneser-Ney probability of each distinct full gram's last byte from the shared lower orders."""
    levels = []
    upper, long = gram, n
    for history in range(HISTORY - 1, -1, -1):
        short = np.minimum(long, history + 1)
        lower = _shortened(upper, short)
        keys, first, counts = np.unique(_key(lower, short), return_index=True, return_counts=True)  # kinds of what stands before: continuation counts
        upper, long = lower[first], short[first]
        levels.append((history, keys, counts.astype(float), _context_key(upper, long)))
    probability = np.full(len(gram), 1 / 256)
    for history, keys, counts, before in reversed(levels):
        discount = _discount(counts)
        contexts, which = np.unique(before, return_inverse=True)
        total, kinds = np.bincount(which, weights=counts), np.bincount(which)
        short = np.minimum(n, history + 1)
        own = _shortened(gram, short)
        c, t = _look(keys, counts, _key(own, short)), _look(contexts, total, _context_key(own, short))
        spare = _look(contexts, discount * kinds, _context_key(own, short))
        known = t > 0
        probability = np.where(known, (np.maximum(c - discount, 0) + spare * probability) / np.where(known, t, 1), probability)
    return probability


def _counts(column: pa.Array) -> dict[str, np.ndarray]:
    """Distinct full grams, their lengths, and how many words of documents hold them: a word counts once a document. Texts are taken a chunk at a time."""
    data, offsets = common.text_buffers(column)
    held = {"key": np.zeros(0, np.uint64), "gram": np.zeros(0, np.uint64), "n": np.zeros(0, np.int64), "count": np.zeros(0)}
    for low, high in common.slices(offsets):
        lower = common.LOWER[data[offsets[low] : offsets[high]]]
        starts, ends, rows = common.word_spans(lower, offsets[low : high + 1] - offsets[low])
        if not len(starts):
            continue
        hashes = common.span_hashes(lower, starts, ends)
        once = np.unique(common.mix(hashes + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
        eight, inside, _ = _keys(lower, starts[once], ends[once])
        gram, n = _gram(eight, inside, HISTORY)
        key, first, count = np.unique(_key(gram, n), return_index=True, return_counts=True)
        merged, at, where = np.unique(np.concatenate([held["key"], key]), return_index=True, return_inverse=True)
        held = {
            "key": merged, "gram": np.concatenate([held["gram"], gram[first]])[at], "n": np.concatenate([held["n"], n[first]])[at],
            "count": np.bincount(where, weights=np.concatenate([held["count"], count]), minlength=len(merged)),
        }
    return held


def _models(toxic: pa.Array, ordinary: pa.Array) -> Model:
    counted = [_counts(x) for x in (toxic, ordinary)]
    keys, first = np.unique(np.concatenate([c["key"] for c in counted]), return_index=True)
    gram, n = (np.concatenate([c[name] for c in counted])[first] for name in ("gram", "n"))
    counts = [_look(c["key"], c["count"], keys) for c in counted]
    shared = _shared_chain(gram, n)
    contexts, which = np.unique(_context_key(gram, n), return_inverse=True)
    logs, spares = [], []
    for c in counts:
        total, kinds = np.bincount(which, weights=c), np.bincount(which, weights=np.minimum(c, DISCOUNT))
        spare = np.where(total > 0, kinds / np.where(total > 0, total, 1), 1.0)
        own = np.where(total[which] > 0, np.maximum(c - DISCOUNT, 0) / np.where(total[which] > 0, total[which], 1), 0.0)
        logs.append(np.log(own + spare[which] * shared + 1e-300))
        spares.append(np.log(np.maximum(spare, 1e-12)))
    return Model(keys, logs[0] - logs[1], contexts, spares[0] - spares[1], np.zeros(5), np.zeros(4), np.ones(4))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[str], labels: list[int], folds: list[int]) -> Model:
    """folds 0 and 1 train the two models, 2 the calibration; without both classes everything scores the share of label 1."""
    y, part = np.array(labels, int), np.array(folds, int)
    pick = lambda keep: pa.array([t for t, k in zip(texts, keep) if k], pa.large_string())
    if len(set(y)) < 2:
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
        empty = np.zeros(0, np.uint64)
        return Model(empty, np.zeros(0), empty, np.zeros(0), np.array([np.log(share / (1 - share)), 0, 0, 0, 0]), np.zeros(4), np.ones(4))
    held = part == 2
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    model = _models(pick(~held & (y == 1)), pick(~held & (y == 0)))
    use = held if held.any() else ~held
    data, offsets = common.text_buffers(pick(use))
    x = np.concatenate([model.features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in common.slices(offsets)])
    model.centre, model.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    model.weights = _logistic((x - model.centre) / model.scale, y[use])
    return model


def train(spark: SparkSession, documents: DataFrame, labels: DataFrame, modulus: int = 5, sample_rows: int = SAMPLE_ROWS) -> str:
    """Fit on at most sample_rows labelled rows of either class, none of them held out; the folder of the model."""
    common.prepare(spark)
    folder = common.shared_folder(spark, "toxicity")
    free = common.crc_mod(F.col("doc_id"), modulus) != 0
    common.fitted(common.labelled(documents, labels, "toxic", free, sample_rows, SAMPLE_TEXT_BYTES, 3), fit, folder)
    return folder


def score(documents: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, then score double, and the two length-normalised differences it rests on. Workers map the model."""
    frame = documents.select(*keep, F.col(text).alias("__text"))
    fields = frame.drop("__text").schema
    out_schema = fields.add("score", "double", False).add("mean_difference", "double", False).add("top_difference", "double", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.read(model)
        for rows, data, offsets in common.texts(batches, "__text"):
            x = own.features(data, offsets)
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(own.score(x)), pa.array(x[:, 0]), pa.array(x[:, 1])], names=[*rows.schema.names[:-1], "score", "mean_difference", "top_difference"])

    return frame.mapInArrow(common.released(run), out_schema)
