"""What the corpus operators share: Arrow text access, word hashing and shared folders."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once by the vectorised operators; one longer text is handled alone.
CHUNK_BYTES = 2 << 20
#: Rows in an Arrow batch, so that batches of long texts stay small.
ARROW_ROWS = 512
#: Stored input that one bucket answers for at most. What a bucket holds in memory is a small multiple of it.
BUCKET_BYTES = 16 << 20

_SHIPPED: set[str] = set()
#: Folders made in this process, for clear().
_MADE: list[str] = []


def prepare(spark: SparkSession) -> None:
    """Send this package to the executors once a context, and keep Arrow batches small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="loomgraph-code-")
    target = os.path.join(folder, "loomgraph_code.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, path.relative_to(package.parent))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder that the driver and all executors see: in spark.checkpoint.dir. Where that is unset, only a local master has one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "loomgraph-shared")
        os.makedirs(base, exist_ok=True)
        spark.sparkContext.setCheckpointDir(base)
        base = f"file://{base}"
    _MADE.append(f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}")
    return _MADE[-1]


def clear(spark: SparkSession) -> int:
    """Delete the intermediate tables and models of this process, once results are written; how many there were."""
    gone = len(_MADE)
    while _MADE:
        _delete(spark, _MADE.pop())
    return gone


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Spark deletes the shuffle files of an execution at its end; by default they stay until the driver collects its garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(spark: SparkSession, frame: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, and survives lost executors. What was shuffled for it is gone afterwards."""
    target = shared_folder(spark, purpose)
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        frame.write.mode("overwrite").parquet(target)
    finally:
        spark.conf.unset(_TIDY) if before is None else spark.conf.set(_TIDY, before)
    out = spark.read.schema(frame.schema).parquet(target)
    out.folder = target
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that cut wrote and that nothing reads any more."""
    for frame in frames:
        _MADE.remove(frame.folder)
        _delete(frame.sparkSession, frame.folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def free_names(frame: DataFrame, *wanted: str) -> tuple[str, ...]:
    """Names that no column of a frame has, in any case."""
    taken, out = {c.lower() for c in frame.columns}, []
    for name in wanted:
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return tuple(out)


def input_bytes(frame: DataFrame) -> int | None:
    """Bytes that a frame's sources hold as they are stored, None where Spark can't tell."""
    leaves = frame._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return total if total < 1 << 60 else None


def bucket_count(frame: DataFrame, per_partition: int = 2) -> int:
    """Buckets that keep the stored input of one at BUCKET_BYTES at most, and no fewer than the session's shuffle partitions ask for."""
    asked = per_partition * int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(8, asked, -(-(input_bytes(frame) or 0) // BUCKET_BYTES))


def crc_mod(key: Column, modulus: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % F.lit(modulus)


# ---------------------------------------------------------------- labelled samples


def labelled(documents: DataFrame, labels: DataFrame, label: str, free: Column, sample_rows: int, sample_bytes: int, folds: int) -> DataFrame:
    """(doc_id, text, label, fold): at most sample_rows labelled rows of either class, drawn by a hash of the id.

    An id that is labelled both ways isn't drawn. Texts that are too long, or
    missing, are left out before the draw as far as twice the rows go. Of rows
    that share an id one is taken, whichever text is smallest.
    """
    usable = labels.select("doc_id", F.col(label).alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & free)
    usable = usable.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")
    pick = lambda frame, rows: [frame.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for k in (0, 1)]
    asked = pick(usable, 2 * sample_rows)
    chosen = F.broadcast(asked[0].unionByName(asked[1]))  # at most 4 * sample_rows ids
    fits = documents.select("doc_id", "text").where(F.octet_length("text") <= sample_bytes).join(chosen, "doc_id")
    drawn = pick(fits.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")), sample_rows)
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.col("doc_id")), F.lit(folds)).cast("int").alias("fold")
    return drawn[0].unionByName(drawn[1]).select("doc_id", "text", "label", fold)


def fitted(sample: DataFrame, fit, folder: str) -> None:
    """Run fit(texts, labels, folds) on a bounded sample in one executor task, which writes its arrays to the shared folder."""

    from loomgraph.llm import shards

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("doc_id", "ascending")])
        shards.write(folder, "model", fit(rows["text"].to_pylist(), rows["label"].to_pylist(), rows["fold"].to_pylist()).arrays())
        return pa.table({"n": pa.array([rows.num_rows], pa.int64())})

    if not sample.groupBy().applyInArrow(run, "n long").collect():
        shards.write(folder, "model", fit([], [], []).arrays())


# ---------------------------------------------------------------- Arrow access


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column one after another, and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def slices(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes; a longer row is a range of its own."""
    rows, low = len(offsets) - 1, 0
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
        high = min(max(high, low + 1), rows)
        yield low, high
        low = high


def texts(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES):
    """(record batch slice, bytes, offsets) of bounded size."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        data, offsets = text_buffers(batch.column(at))
        for low, high in slices(offsets, limit):
            yield batch.slice(low, high - low), data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]


def released(run):
    """A batch function that gives free memory back to the system when its partition ends: workers wait for their next task, and others need it."""

    @wraps(run)
    def wrapped(batches):
        yield from run(batches)
        _release()

    return wrapped


def trimmed(run):
    """A function of a group that gives free memory back to the system when it ends."""

    def wrapped(table):
        out = run(table)
        _release()
        return out

    return wrapped


def _release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


# ---------------------------------------------------------------- words

#: ASCII letters in lower case; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Space and the control characters 9 to 13.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

_K1, _K2, _K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_TAIL = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(value: np.ndarray) -> np.ndarray:
    value = value ^ (value >> np.uint64(30))
    value *= _K2
    value ^= value >> np.uint64(27)
    value *= _K3
    value ^= value >> np.uint64(31)
    return value


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a little-endian number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word `[^\\x20\\x09-\\x0D]+`; words end with their row."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = ~IS_SPACE[data]
    cut_here = np.zeros(len(data) + 1, bool)
    cut_here[offsets] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut_here[:-1]))
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut_here[1:])) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, eight bytes a step over all spans that are long enough."""
    import xxhash

    eight = lanes(data)
    lengths = ends - starts
    out = mix(lengths.astype(np.uint64) * _K1 + _K3)
    very_long = lengths > 512
    left = np.flatnonzero(~very_long & (lengths > 0))
    at = starts[left]
    rest = lengths[left]
    while len(left):
        lane = eight[at] & _TAIL[np.minimum(rest, 8)]
        out[left] = mix((out[left] ^ lane) * _K1)
        more = rest > 8
        left, at, rest = left[more], at[more] + 8, rest[more] - 8
    for i in np.flatnonzero(very_long):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), seed=7)
    return out
