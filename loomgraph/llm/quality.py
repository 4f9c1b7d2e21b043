"""Quality by compression: which of two dictionaries, of good or of bad text, shortens a document more.

A zstandard dictionary is built from good and one from bad labelled text. A
document is cut into blocks of BLOCK bytes, so that the dictionaries matter
everywhere in a long text, and every block is compressed with both. The
difference of the two total sizes over the length in bytes, with the sizes
themselves as context (what repeats itself shrinks under either), goes through
a logistic calibration fitted on labelled rows kept out of the dictionaries.

Defined results: a null or empty text, or a dictionary that can't be built for
want of labelled text, scores the share of label 1 among the rows fitted on;
a null id is not held out; an id that is labelled both ways isn't learned from,
and of rows that share a labelled id one is; extra columns are ignored; repeated
rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import common, shards

BLOCK = 1024
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
#: Labelled rows of either class that are used at most, and the bytes of the longest.
SAMPLE_ROWS = 2500
SAMPLE_TEXT_BYTES = 32768


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: np.ndarray
    share: float

    def arrays(self) -> list[np.ndarray]:
        return [np.frombuffer(self.good, np.uint8), np.frombuffer(self.bad, np.uint8), self.weights, np.array([self.share])]

    @staticmethod
    def read(folder: str) -> Model:
        good, bad, weights, share = shards.read(folder, "model", ("u1", "u1", "<f8", "<f8"))
        return Model(good.tobytes(), bad.tobytes(), weights, float(share[0]))

    def compressors(self):
        import zstandard

        out = []
        for raw in (self.good, self.bad):
            kind = zstandard.DICT_TYPE_AUTO if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
            made = zstandard.ZstdCompressionDict(raw, dict_type=kind)
            made.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(dict_data=made, level=LEVEL))
        return out

    def sizes(self, data: np.ndarray, offsets: np.ndarray, compressors) -> np.ndarray:
        """Bytes of each row, and of its blocks under the good and the bad dictionary."""
        good, bad = (c.compress for c in compressors)
        raw = memoryview(np.ascontiguousarray(data))
        out = np.zeros((len(offsets) - 1, 3))
        for row, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            g = b = 0
            for at in range(low, high, BLOCK):
                block = raw[at : min(at + BLOCK, high)]
                g += len(good(block))
                b += len(bad(block))
            out[row] = high - low, g, b
        return out

    def score(self, sizes: np.ndarray) -> np.ndarray:
        if not self.weights.any():
            return np.full(len(sizes), self.share)
        x = design(sizes)
        return np.where(sizes[:, 0] > 0, 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30))), self.share)


def design(sizes: np.ndarray) -> np.ndarray:
    n = np.maximum(sizes[:, 0], 1)
    difference, own = (sizes[:, 2] - sizes[:, 1]) / n * 10, sizes[:, 1] / n
    return np.c_[np.ones(len(n)), difference, own, difference**2, own**2, difference * own, np.log1p(n) / 10]


def _dictionary(texts: list[str]) -> bytes:
    import zstandard

    blocks = [raw[at : at + BLOCK] for raw in (t.encode() for t in texts) for at in range(0, len(raw), BLOCK)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: its bytes themselves serve
        return b"".join(blocks)[-DICTIONARY_BYTES:]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[str], labels: list[int], folds: list[int]) -> Model:
    """fold 0 builds the dictionaries, the others the calibration."""
    y, part = np.array(labels, int), np.array(folds, int)
    share = float(y.mean()) if len(y) else 0.5
    if len(set(y)) < 2:
        return Model(b"", b"", np.zeros(7), share)
    build = part == 0
    if len(set(y[build])) < 2 or len(set(y[~build])) < 2:
        build = np.ones(len(y), bool)
    words = [_dictionary([t for t, k in zip(texts, build & (y == label)) if k]) for label in (1, 0)]
    if not all(words):
        return Model(b"", b"", np.zeros(7), share)
    model = Model(*words, np.zeros(7), share)
    use = ~build if not build.all() else build
    sizes = model.sizes(*common.text_buffers(pa.array([t for t, k in zip(texts, use) if k], pa.large_string())), model.compressors())
    model.weights = _logistic(design(sizes), y[use])
    return model


def train(spark: SparkSession, documents: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, sample_rows: int = SAMPLE_ROWS) -> str:
    """Fit on at most sample_rows labelled rows of either class, none of them held out; the folder of the model."""
    common.prepare(spark)
    folder = common.shared_folder(spark, "quality")
    free = common.crc_mod(F.col("doc_id"), modulus) != held
    common.fitted(common.labelled(documents, labels, "quality", free, sample_rows, SAMPLE_TEXT_BYTES, 2), fit, folder)
    return folder


def score(documents: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, then score double and the normalised sizes under the good and the bad dictionary. Workers map the model."""
    frame = documents.select(*keep, F.col(text).alias("__text"))
    out_schema = frame.drop("__text").schema.add("score", "double", False).add("good_ratio", "double", False).add("bad_ratio", "double", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.read(model)
        compressors = own.compressors() if own.good else None
        for rows, data, offsets in common.texts(batches, "__text"):
            sizes = own.sizes(data, offsets, compressors) if compressors else np.zeros((rows.num_rows, 3))
            n = np.maximum(sizes[:, 0], 1)
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(own.score(sizes)), pa.array(sizes[:, 1] / n), pa.array(sizes[:, 2] / n)], names=[*rows.schema.names[:-1], "score", "good_ratio", "bad_ratio"])

    return frame.mapInArrow(common.released(run), out_schema)
