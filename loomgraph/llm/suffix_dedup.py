"""Removal of repeated byte strings with a sparse suffix array.

Every byte covered by a string of SPAN bytes that also starts earlier (in a
document of smaller id, or earlier in the same one) is removed. Sorting the
suffixes of all positions would move every text many times over, so positions
that can't have a partner are left out first:

1. Each window of SPAN bytes has an anchor, the GRAM bytes in it with the
   smallest hash. Equal windows have equal anchors. Neighbouring windows with
   one anchor form a run, and runs are counted by anchor: (SPAN - GRAM + 2) / 2
   windows share a run on average, so few numbers move and no text.
2. Runs whose anchor stands elsewhere too send their bytes to the anchor's
   bucket; equal ones from one batch are folded into their first before that.
   Where one anchor fills a tenth of its bucket or more, its runs go as single
   windows instead, each to the bucket of its own hash: equal windows are
   folded, and those that differ part.
3. A bucket sorts the runs by the deep-shallow method (suffix_sort), then the
   windows of those that differ, as suffixes to a depth of SPAN. In each class
   of equal strings all but the first in document order are repeats.
4. The repeats go back to their documents, whose bytes they remove.

Texts move once for steps 2 and 4 (one exchange, reused). Buckets follow the
session's shuffle partitions, so a bucket's size stays as the input grows.

Defined results: null is an empty text; texts under SPAN bytes keep all bytes;
null ids count as smallest; rows that share an id are ordered by their texts'
hashes, and of wholly equal rows one comes first and the rest repeat it; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm import common, suffix_sort

SPAN = 100
GRAM = 32
#: Runs, and bytes of runs, that a task gathers before it sends them to their buckets.
FLUSH_RUNS = 400_000
FLUSH_BYTES = 8 << 20

_NO_ID = -(2**63)
#: Added to a run's windows: some of them may equal one another.
_AGAIN = 1 << 31
#: An anchor is hot if it has so many runs, and so large a share of its bucket's.
HOT_RUNS, HOT_SHARE = 1000, 0.1
#: Flags of a run on its way to its anchor's bucket: may repeat itself, isn't alone in its task, and is known to be shared.
_REPEATS, _SHARED, _PASSIVE = 1, 2, 4
_SEND = "bucket int, run binary, key binary, id binary, copy binary, at binary, windows binary, body binary"
_BACK = "id long, copy long, at binary, windows binary, key binary"


def _pack(values: np.ndarray, level: int = 1) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(values).tobytes())


def _unpack(raw: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def runs(data: np.ndarray, offsets: np.ndarray, span: int = SPAN, gram: int = GRAM):
    """(row, start in the row, windows, anchor hash, whether windows of the run may equal one another) of each run of windows with one anchor."""
    windows = len(data) - span + 1
    none = np.zeros(0, np.int64)
    if windows <= 0:
        return none, none, none, none.astype(np.uint64), none.astype(bool)
    eight = common.lanes(data)
    value = np.zeros(len(data) - gram + 1, np.uint64)
    for lane in range(0, gram, 8):
        value += eight[lane : lane + len(value)] * np.uint64((0x9E3779B97F4A7C15 * (2 * lane + 3) | 1) & (2**64 - 1))
    value ^= value >> np.uint64(32)
    value *= np.uint64(0xD6E8FEB86659FD93)
    value ^= value >> np.uint64(29)
    width = span - gram + 1
    grams, value = value, _sliding(value, width, np.minimum)
    # two anchors of one hash that a window or its neighbour can hold: the run repeats itself
    highest = _sliding(np.concatenate([np.full(width - 1, value[0]), value, np.full(width - 1, value[-1])]), width, np.maximum)
    anchors = np.flatnonzero(grams == highest)
    own = grams[anchors]
    periodic = np.unique(own[1:][(own[1:] == own[:-1]) & (np.diff(anchors) <= width)])
    room = np.diff(offsets) - span + 1
    rows = np.flatnonzero(room > 0)
    edge = np.zeros(windows + 1, np.int8)
    edge[offsets[rows]] += 1
    np.subtract.at(edge, offsets[rows] + room[rows], 1)
    valid = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    change = np.ones(windows + 1, bool)
    change[1:-1] = (value[1:] != value[:-1]) | (valid[1:] != valid[:-1])
    change[offsets[rows]] = True
    at = np.flatnonzero(change)
    start, count = at[:-1], np.diff(at)
    keep = valid[start]
    start, count = start[keep], count[keep]
    row = np.searchsorted(offsets, start, side="right") - 1
    value = value[start]
    return row, start - offsets[row], count, value, np.isin(value, periodic) if len(periodic) else np.zeros(len(row), bool)


def _sliding(value: np.ndarray, width: int, choose) -> np.ndarray:
    """choose over each stretch of width values, by doubling."""
    reach = 1
    while reach * 2 <= width:
        value = choose(value[:-reach], value[reach:])
        reach *= 2
    return choose(value[: reach - width], value[width - reach :]) if reach < width else value


def _send(bucket: np.ndarray, buckets: int, columns: dict[str, np.ndarray], bodies=None) -> Iterator[pa.RecordBatch]:
    """One row a bucket with its entries packed; bodies gives the bytes of chosen entries."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    out = []
    for b in np.flatnonzero(np.diff(edges)):
        own = order[edges[b] : edges[b + 1]]
        packed = {name: _pack(values[own]) for name, values in columns.items()}
        out.append({"bucket": int(b), "run": None, "key": None, "id": None, "copy": None, "at": None, "windows": None, "body": _pack(bodies(own)) if bodies else None} | packed)
    schema = pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in ("run", "key", "id", "copy", "at", "windows", "body"))])
    for low in range(0, len(out), 64):
        yield pa.RecordBatch.from_pylist(out[low : low + 64], schema)


def _gathered(table: pa.Table) -> dict[str, np.ndarray]:
    kinds = {"run": "u1", "key": "<u8", "id": "<i8", "copy": "<i8", "at": "<i8", "windows": "<i8"}
    out = {}
    for name, kind in kinds.items():
        parts = [_unpack(x, kind) for x in table[name].to_pylist() if x is not None]
        out[name] = np.concatenate(parts) if parts else np.zeros(0, kind)
    return out


def _per_document(ids, copies, at, windows, keys) -> pa.Table:
    """A row a document with its entries packed in order of their starts."""
    order = np.lexsort((at, copies, ids))
    ids, copies, at, windows, keys = (x[order] for x in (ids, copies, at, windows, keys))
    change = np.ones(len(ids), bool)
    change[1:] = (ids[1:] != ids[:-1]) | (copies[1:] != copies[:-1])
    edges = np.append(np.flatnonzero(change), len(ids))
    cuts = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
    a, w, k = at.astype("<u4"), windows.astype("<u4"), keys.astype("<u8")
    return pa.table({
        "id": pa.array(ids[edges[:-1]], pa.int64()),
        "copy": pa.array(copies[edges[:-1]], pa.int64()),
        "at": pa.array([a[i:j].tobytes() for i, j in cuts], pa.binary()),
        "windows": pa.array([w[i:j].tobytes() for i, j in cuts], pa.binary()),
        "key": pa.array([k[i:j].tobytes() for i, j in cuts], pa.binary()),
    })


def _shared_anchors(table: pa.Table) -> pa.Table:
    """Of a bucket's runs, those whose anchor occurs more than once, or that may repeat themselves; and without an id the anchors that are hot, ten at most."""
    got = _gathered(table)
    counts = np.concatenate([_unpack(x, "<u4") for x in table["body"].to_pylist() if x] or [np.zeros(0, "<u4")]).astype(np.int64)
    active = np.flatnonzero(got["run"] & _PASSIVE == 0)
    order = active[np.argsort(got["key"][active], kind="stable")]
    key = got["key"][order]
    twice = got["run"][order] & (_REPEATS | _SHARED) > 0
    same = key[1:] == key[:-1]
    twice[1:] |= same
    twice[:-1] |= same
    own = np.concatenate([order[twice], np.flatnonzero(got["run"] & _PASSIVE)])
    windows = got["windows"][own] + (got["run"][own] & _REPEATS).astype(np.int64) * _AGAIN
    out = _per_document(got["id"][own], got["copy"][own], got["at"][own], windows, got["key"][own])
    if len(key):
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        many = np.add.reduceat(counts[order], first)
        hot = key[first][(many >= HOT_RUNS) & (many >= HOT_SHARE * counts.sum())]
        if len(hot):
            out = pa.concat_tables([out, pa.table({"id": pa.nulls(1, pa.int64()), "copy": pa.nulls(1, pa.int64()), "at": pa.nulls(1, pa.binary()), "windows": pa.nulls(1, pa.binary()), "key": pa.array([hot.astype("<u8").tobytes()], pa.binary())})])
    return out


def _fold(body: np.ndarray, start: np.ndarray, key, ids, copies, at, windows, span: int):
    """Classes of equal runs by the sort: (index of each class's first in document order, mask of the rest)."""
    width = windows + span - 1
    _, group = np.unique(np.stack([key, width.astype(np.uint64)]), axis=1, return_inverse=True)
    order, head = suffix_sort.sort(body, start, width, group.ravel())
    klass = np.empty(len(key), np.int64)
    klass[order] = head
    place = np.lexsort((at, copies, ids, klass))
    first = np.ones(len(key), bool)
    first[1:] = klass[place][1:] != klass[place][:-1]
    is_first = np.zeros(len(key), bool)
    is_first[place[first]] = True
    return is_first


def _single_windows(key, ids, copies, at, windows, start, body: np.ndarray, span: int):
    """Runs as entries of one window each, by their own hashes; of equal ones only the first is sent with its bytes."""
    run = np.repeat(np.arange(len(key)), windows)
    inner = np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows)
    begin, place = start[run] + inner, at[run] + inner
    own = common.span_hashes(body, begin, begin + span)
    ones = np.ones(len(run), np.int64)
    first = _fold(body, begin, own, ids[run], copies[run], place, ones, span)
    return own, ids[run], copies[run], place, ones, np.full(len(run), span), begin, first, np.zeros(len(run), bool)


def _copy_spans(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of spans one after another, and where each begins."""
    begin = np.concatenate([[0], np.cumsum(length)])
    take = np.arange(begin[-1]) - np.repeat(begin[:-1] - start, length)
    return data[take], begin[:-1]


def _repeats(table: pa.Table, span: int) -> pa.Table:
    """A bucket's windows that also start earlier, as runs a document."""
    got = _gathered(table)
    known = got["run"] & 1 == 0  # already known to be repeats
    ids, copies, at, windows, key = (got[n][~known] for n in ("id", "copy", "at", "windows", "key"))
    again = got["run"][~known] > 1
    body = np.concatenate([_unpack(x, "u1") for x in table["body"].to_pylist() if x] or [np.zeros(0, np.uint8)])
    out = [[got[n][known] for n in ("id", "copy", "at", "windows", "key")]]
    if len(ids):
        width = windows + span - 1
        start = np.concatenate([[0], np.cumsum(width)[:-1]])
        first = _fold(body, start, key, ids, copies, at, windows, span)
        out.append([x[~first] for x in (ids, copies, at, windows, key)])
        # windows of the differing runs: their suffixes to a depth of span
        left = np.flatnonzero(first)
        _, which, kinds = np.unique(key[left], return_inverse=True, return_counts=True)
        left = left[(kinds[which] > 1) | again[left]]
        n = windows[left]
        run = np.repeat(left, n)
        inner = np.arange(int(n.sum())) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(n) else np.zeros(0, np.int64)
        if len(run):
            _, group = np.unique(key[run], return_inverse=True)
            order, head = suffix_sort.sort(body, start[run] + inner, span, group)
            klass = np.empty(len(run), np.int64)
            klass[order] = head
            place = np.lexsort((at[run] + inner, copies[run], ids[run], klass))
            later = np.zeros(len(run), bool)
            later[place[1:]] = klass[place][1:] == klass[place][:-1]
            hit = np.flatnonzero(later)
            if len(hit):
                r, i = run[hit], inner[hit]
                change = np.ones(len(hit), bool)
                change[1:] = (r[1:] != r[:-1]) | (i[1:] != i[:-1] + 1)
                edge = np.flatnonzero(change)
                r0, i0 = r[edge], i[edge]
                out.append([ids[r0], copies[r0], at[r0] + i0, np.diff(np.append(edge, len(hit))), key[r0]])
    return _per_document(*(np.concatenate(x) for x in zip(*out, strict=True)))


def _spread(rows: pa.RecordBatch, wanted: list[str]) -> tuple[np.ndarray, ...]:
    """Row number and entries of the packed lists that belong to each row's own copy."""
    found = rows.column(rows.schema.get_field_index("found")).to_pylist()
    copies = rows.column(rows.schema.get_field_index("copy")).to_pylist()
    row, parts = [], {n: [] for n in wanted}
    kinds = {"at": "<u4", "windows": "<u4", "key": "<u8"}
    for i, (entries, copy) in enumerate(zip(found, copies, strict=True)):
        for entry in entries or ():
            if entry["copy"] == copy:
                for n in wanted:
                    parts[n].append(np.frombuffer(entry[n], kinds[n]))
                row.append((i, len(entry["at"]) // 4))
    which = np.repeat(np.array([r for r, _ in row], np.int64), np.array([c for _, c in row], np.int64)) if row else np.zeros(0, np.int64)
    return which, *(np.concatenate(parts[n]).astype("<u8" if n == "key" else np.int64) if row else np.zeros(0, "<u8" if n == "key" else np.int64) for n in wanted)


def repeated(documents: DataFrame, span: int = SPAN, keep_text: bool = False, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans array<struct<start, end>> of removed bytes; with keep_text also kept binary."""
    spark = documents.sparkSession
    common.prepare(spark)
    buckets = common.bucket_count(documents)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    # only rows that share an id need telling apart
    repeated_ids = not documents.select(own_id.alias("id")).groupBy("id").count().where("count > 1").isEmpty()
    source = documents.select(own_id.alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    source = source.withColumn("copy", F.xxhash64("text") if repeated_ids else F.lit(0).cast("long"))
    base = source.repartition(parts, "id")
    if repeated_ids:
        base = base.withColumn("nth", F.row_number().over(Window.partitionBy("id", "copy").orderBy("copy")))
    else:
        base = base.withColumn("nth", F.lit(1))

    def send_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush():
            key, ids, copies, at, windows, again = (np.concatenate(x) for x in zip(*held, strict=True))
            # one run of an anchor asks for the rest of its task, which can go anywhere
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
            lead, count = np.zeros(len(key), bool), np.ones(len(key), np.int64)
            lead[order[first]] = True
            count[order[first]] = np.diff(np.append(first, len(key)))
            flags = again * _REPEATS + (count > 1) * _SHARED + ~lead * _PASSIVE
            salted = common.mix(ids.astype(np.uint64) * np.uint64(3) + key) % np.uint64(buckets)
            columns = {"run": flags.astype("u1"), "key": key, "id": ids, "copy": copies, "at": at, "windows": windows}
            yield from _send(np.where(lead, key % np.uint64(buckets), salted).astype(np.int64), buckets, columns, lambda own: count[own].astype("<u4"))

        for rows, data, offsets in common.texts(batches):
            row, at, windows, key, again = runs(data, offsets, span)
            if len(row):
                held.append((key.astype("<u8"), rows.column(0).to_numpy()[row], rows.column(2).to_numpy()[row], at.astype("<i8"), windows.astype("<i8"), again))
                size += len(row)
            if size >= FLUSH_RUNS:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def send_bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush():
            key, ids, copies, at, windows = (np.concatenate([x[i] for x in held]) for i in range(5))
            body = np.concatenate([x[5] for x in held])
            again = windows >= _AGAIN
            windows = windows % _AGAIN
            width = windows + span - 1
            start = np.concatenate([[0], np.cumsum(width)[:-1]])
            first = _fold(body, start, key, ids, copies, at, windows, span)
            order = np.lexsort((at, copies, ids, key))
            key, ids, copies, at, windows, width, start, first, again = (x[order] for x in (key, ids, copies, at, windows, width, start, first, again))
            wide = first & np.isin(key, hot)
            if wide.any():
                one = _single_windows(*(x[wide] for x in (key, ids, copies, at, windows, start)), body, span)
                rest = (key, ids, copies, at, windows, np.where(first, width, 0), start, first, again)
                key, ids, copies, at, windows, width, start, first, again = (np.concatenate([x[~wide], y]) for x, y in zip(rest, one, strict=True))
            home = key % np.uint64(buckets)
            salted = common.mix(ids.astype(np.uint64) + key) % np.uint64(buckets)  # a known repeat needs no bucket of its own
            bodies = lambda own: _copy_spans(body, start[own[first[own]]], width[own[first[own]]])[0]
            yield from _send(np.where(first, home, salted).astype(np.int64), buckets, {"run": first + 2 * again.astype("u1"), "key": key, "id": ids, "copy": copies, "at": at, "windows": windows}, bodies)

        for rows, data, offsets in common.texts(batches):
            row, at, windows, key = _spread(rows, ["at", "windows", "key"])
            if not len(row):
                continue
            if repeated_ids:  # equal rows have sent their runs twice
                _, once = np.unique(np.stack([row, at]), axis=1, return_index=True)
                row, at, windows, key = row[once], at[once], windows[once], key[once]
            body, _ = _copy_spans(data, offsets[row] + at, windows % _AGAIN + span - 1)
            held.append((key, rows.column(0).to_numpy()[row], rows.column(2).to_numpy()[row].astype("<i8"), at, windows, body))
            size += len(body)
            if size >= FLUSH_BYTES:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def by_document(frame: DataFrame) -> DataFrame:
        return frame.where("id is not null").groupBy("id").agg(F.collect_list(F.struct("copy", "at", "windows", "key")).alias("found"))

    anchors = common.cut(spark, source.mapInArrow(common.released(send_runs), _SEND).groupBy("bucket").applyInArrow(_shared_anchors, _BACK), "anchors")
    found = anchors.where("id is null").select("key").toArrow()["key"].to_pylist()  # ten anchors a bucket at most
    hot = np.unique(np.concatenate([np.frombuffer(x, "<u8") for x in found])) if found else np.zeros(0, np.uint64)
    candidates = base.where("nth = 1").join(by_document(anchors), "id")
    repeats = candidates.mapInArrow(common.released(send_bodies), _SEND).groupBy("bucket").applyInArrow(lambda t: _repeats(t, span), _BACK)
    marked = base.join(by_document(repeats), "id", "left")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in common.texts(batches):
            row, at, windows = _spread(rows, ["at", "windows"])
            edge = np.zeros(len(data) + 1, np.int32)
            np.add.at(edge, offsets[row] + at, 1)
            np.subtract.at(edge, offsets[row] + at + windows + span - 1, 1)
            gone = np.cumsum(edge[:-1]) > 0
            for k in np.flatnonzero(rows.column(3).to_numpy() > 1):  # an equal row comes before
                if offsets[k + 1] - offsets[k] >= span:
                    gone[offsets[k] : offsets[k + 1]] = True
            raw, removed, count, digests, kept, spans = data, [], [], [], [], []
            for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                mask = gone[low:high]
                n = int(mask.sum())
                own = raw[low:high]
                step = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))) if n else np.zeros(0, np.int64)
                rest = own[~mask].tobytes() if n else own.tobytes()
                removed.append(n)
                count.append(len(step) // 2)
                spans.append([{"start": a, "end": b} for a, b in zip(step[::2].tolist(), step[1::2].tolist(), strict=True)])
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if keep_text else None)
            ids = rows.column(0)
            fields = [
                pa.array([None if x == _NO_ID else x for x in ids.to_pylist()], pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digests, pa.string()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(fields, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    out = marked.mapInArrow(common.released(remove), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary")
    return out if keep_text else out.drop("kept")


#: DuckDB SQL for the same rows where ids are unique: every window beside its earlier equals, byte by byte.
ORACLE = """with d as (select coalesce(doc_id, -9223372036854775808) as id, doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
  b as (select id, n, unnest(range(0, n)) as p, h from d where n > 0),
  w as (select id, n, p, substr(h, 2 * p + 1, 2) as byte, case when p + 100 <= n then substr(h, 2 * p + 1, 200) end as s from b),
  f as (select *, s is not null and row_number() over (partition by s order by id, p) > 1 as again from w),
  r as (select *, coalesce(max(case when again then p end) over (partition by id order by p rows between 99 preceding and current row), -1) >= 0 as gone from f),
  e as (select *, gone and not coalesce(lag(gone) over (partition by id order by p), false) as starts from r),
  a as (select id, count(*) filter (gone) as n_removed, count(*) filter (starts) as n_spans, coalesce(string_agg(byte, '' order by p) filter (not gone), '') as kept from e group by 1)
  select doc_id, n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256 from d left join a using (id)"""
