"""Readers: rows of CSV, JSON, tables and databases as one kind of frame.

A records frame has rec_idx (0-based place in the stream), coord
struct<source_type, locator, fragment, source_version>, data (a struct of the
source's own columns, or for JSON a map of variants) and issues
array<struct<code, message, severity, field>>. What is wrong with one row is an
issue on it; what is wrong with a source as a whole raises SourceError when the
reader is opened. Frames are lazy and read again each time, so a dry run and a
run see the same rows. Nothing is inferred: CSV stays text, JSON keeps its types.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, StringType, StructType

from loomgraph.errors import ConfigurationError, SourceError
from loomgraph.functions import text
from loomgraph.sources.store import scratch

ISSUE = "struct<code:string,message:string,severity:string,field:string>"
ISSUES = f"array<{ISSUE}>"
COORD = "struct<source_type:string,locator:string,fragment:string,source_version:string>"
#: Records that a task gets on average at most, where they are dealt out.
RECORDS_A_TASK = 1 << 16
#: What stands for a missing cell while CSV is parsed.
_MISSING = "\u0001missing\u0001"
SURPLUS = "__unnamed__"


@dataclass(frozen=True)
class Records:
    """A source that can be read again and again."""

    frame: DataFrame
    source_type: str
    locator: str


def issue(code: str, message: Column | str, severity: str = "error", field: str | None = None) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(code).alias("code"), message.alias("message"), F.lit(severity).alias("severity"), F.lit(field).cast("string").alias("field"))


def render_issue(column: Column) -> Column:
    """code: message, with the field in brackets if there is one."""
    return F.concat(column["code"], F.when(column["field"].isNotNull(), F.concat(F.lit("["), column["field"], F.lit("]"))).otherwise(""), F.lit(": "), column["message"])


def issues_of(*candidates: Column) -> Column:
    """The candidates that aren't NULL."""
    return F.array_compact(F.array(*candidates)).cast(ISSUES) if candidates else F.array().cast(ISSUES)


def coordinates(source_type: str, locator: str, fragment: Column, version: str | None = None) -> Column:
    return F.struct(F.lit(source_type).alias("source_type"), F.lit(locator).alias("locator"), fragment.alias("fragment"), F.lit(version).cast("string").alias("source_version"))


def sequential(frame: DataFrame, name: str = "rec_idx") -> DataFrame:
    """Number the rows 0, 1, 2 in reading order.

    Files that are read straight are split alike in every job: one narrow pass
    counts partitions, and nothing is shuffled. Whatever is dealt anew on the way
    may be split otherwise next time, so that is written first (numbered).
    """
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    if re.search(r"\b(Sort|Join|Aggregate|Repartition\w*|Rebalance\w*|Distinct|Window|GlobalLimit|Except|Intersect|InMemoryRelation|LogicalRDD)\b", plan):
        return numbered(frame, name)
    counts = frame.groupBy(F.spark_partition_id().alias("p")).count().orderBy("p").collect()  # a row a partition
    starts = dict(zip((r["p"] for r in counts), accumulate((r["count"] for r in counts), initial=0), strict=False))
    offsets = F.map_from_arrays(F.array(*(F.lit(p) for p in starts)), F.array(*(F.lit(n).cast("long") for n in starts.values()))) if starts else None
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1).cast("long"))
    return frame.withColumn(name, (F.element_at(offsets, F.spark_partition_id()) + within) if starts else within)


def numbered(frame: DataFrame, name: str = "rec_idx", folder: str | None = None) -> DataFrame:
    """The rows numbered 0, 1, 2 in their order: they are written, and what is read again is numbered by file and place in it, however it is split then."""
    spark = frame.sparkSession
    folder = folder or scratch(spark, "numbered")
    frame.write.mode("overwrite").parquet(folder)
    place, within = free_name(frame, "file"), free_name(frame, "within")
    read = spark.read.schema(frame.schema).parquet(folder).select("*", F.col("_metadata.file_name").alias(place), F.col("_metadata.row_index").alias(within))
    counts = read.groupBy(place).agg(F.count("*").alias("n"))  # a row a file; names begin with the partition's number
    before = F.sum("n").over(Window.orderBy(place).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(place, F.coalesce(before, F.lit(0)).alias("n"))
    return read.join(starts, place).select(*frame.columns, (F.col("n") + F.col(within)).alias(name))


def dealt(frame: DataFrame) -> DataFrame:
    """The records as they lie, or, where a partition has more than RECORDS_A_TASK, dealt out by rec_idx.

    Files are split by their own bytes, which say little about what records grow
    to: a narrow column's candidates are a hundred times as large. Partitions are
    counted in one narrow pass. Up to 256 neighbours stay together, since they
    are sent in fewer bytes.
    """
    sizes = frame.groupBy(F.spark_partition_id().alias("p")).count()
    total, most = sizes.agg(F.sum("count"), F.max("count")).first()
    return frame.repartition(-(-total // RECORDS_A_TASK), F.shiftright("rec_idx", 8)) if most and most > RECORDS_A_TASK else frame


def free_name(frame: DataFrame, name: str) -> str:
    while name in (c.lower() for c in frame.columns):
        name = f"_{name}"
    return name


def from_rows(spark: SparkSession, rows: Sequence[dict], schema: str, source_type: str = "memory", locator: str = "memory") -> Records:
    """Rows that the driver holds."""
    names = StructType.fromDDL(schema).fieldNames()
    data = [(i, tuple(r.get(n) for n in names)) for i, r in enumerate(rows)]
    frame = spark.createDataFrame(data, f"rec_idx long, data struct<{', '.join(f'{f.name}:{f.dataType.simpleString()}' for f in StructType.fromDDL(schema).fields)}>")
    fragment = F.concat(F.lit("index="), F.col("rec_idx").cast("string"))
    return Records(frame.select("rec_idx", coordinates(source_type, locator, fragment).alias("coord"), "data", issues_of().alias("issues")), source_type, locator)


def _readable(spark: SparkSession, path: str) -> None:
    try:
        spark.read.format("binaryFile").load(path).select("path").limit(1).collect()
    except (AnalysisException, PySparkException) as bad:
        raise SourceError(f"{path} can't be read: {str(bad).splitlines()[0]}") from bad


@F.pandas_udf(ArrayType(StringType()))
def _cells(raw: pd.Series, delimiter: pd.Series) -> pd.Series:
    return pd.Series([None if r is None else next(csv.reader(io.StringIO(r.rstrip("\r\n")), delimiter=d), []) for r, d in zip(raw, delimiter, strict=True)])


def from_csv(spark: SparkSession, path: str, locator: str | None = None, source_type: str = "csv", delimiter: str = ",", encoding: str = "UTF-8", multiline: bool = True) -> Records:
    """All cells are text, an empty one ''. A row with too few cells has NULLs and a short_row warning, one with too many keeps them under SURPLUS with unnamed_columns."""
    _readable(spark, path)
    options = {"header": True, "sep": delimiter, "encoding": encoding, "escape": '"', "multiLine": multiline, "emptyValue": "", "nullValue": _MISSING}
    names = spark.read.options(**options).csv(path).columns
    corrupt = "__ragged"
    schema = ", ".join(f"`{n}` string" for n in [*names, corrupt])
    frame = sequential(spark.read.options(**options, columnNameOfCorruptRecord=corrupt, mode="PERMISSIVE").schema(schema).csv(path))
    frame = frame.withColumn("__cells", F.when(F.col(corrupt).isNotNull(), _cells(corrupt, F.lit(delimiter))))
    count = F.size("__cells")
    cells = [F.when(F.col(corrupt).isNull(), F.coalesce(F.col(f"`{n}`"), F.lit(""))).otherwise(F.get("__cells", F.lit(i))).alias(n) for i, n in enumerate(names)]
    surplus = F.when(count > len(names), F.slice("__cells", len(names) + 1, F.greatest(count - len(names), F.lit(1)))).alias(SURPLUS)
    missing = F.array_join(F.slice(F.array(*(F.lit(n) for n in names)), F.greatest(count, F.lit(0)) + 1, F.lit(len(names))), ", ")
    short = F.when((count >= 0) & (count < len(names)), issue("short_row", F.concat(F.lit("row has no cell for "), missing), "warning"))
    long = F.when(count > len(names), issue("unnamed_columns", F.concat((count - len(names)).cast("string"), F.lit(" cells beyond the header")), "warning"))
    place = coordinates(source_type, locator or path, F.concat(F.lit("row="), (F.col("rec_idx") + 2).cast("string")))
    return Records(frame.select("rec_idx", place.alias("coord"), F.struct(*cells, surplus).alias("data"), issues_of(short, long).alias("issues")), source_type, locator or path)


def _json_data(value: Column) -> Column:
    return F.when(text.variant_kind(value) == "object", value.cast("map<string,variant>"))


def _json_issues(value: Column, malformed: Column) -> Column:
    bad = F.when(malformed, issue("malformed_json", "line is not valid JSON"))
    shape = F.when(~malformed & (text.variant_kind(value) != "object"), issue("not_an_object", F.concat(F.lit("expected an object, got "), text.variant_kind(value))))
    return issues_of(bad, shape)


def from_json(spark: SparkSession, path: str, mode: str = "auto", locator: str | None = None, source_type: str = "json") -> Records:
    """An array of objects, or an object a line; auto looks at the first character that isn't a space."""
    if mode not in ("auto", "array", "lines"):
        raise ConfigurationError(f"mode must be auto, array or lines, not {mode!r}")
    _readable(spark, path)
    locator = locator or path
    if mode == "auto":
        first = spark.read.text(path).where(text.nonempty(F.col("value")).isNotNull()).limit(1).collect()
        mode = "array" if first and first[0][0].lstrip().startswith("[") else "lines"
    if mode == "array":
        whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
        bad = whole.where((text.variant_kind(F.col("v")) != "array") | F.col("v").isNull()).limit(1).collect()
        if bad:
            raise SourceError(f"{path} isn't a JSON array")
        rows = whole.select(F.posexplode(F.col("v").cast("array<variant>")).alias("rec_idx", "v")).withColumn("rec_idx", F.col("rec_idx").cast("long"))
        place = coordinates(source_type, locator, F.concat(F.lit("index="), F.col("rec_idx").cast("string")))
        return Records(rows.select("rec_idx", place.alias("coord"), _json_data(F.col("v")).alias("data"), _json_issues(F.col("v"), F.lit(False)).alias("issues")), source_type, locator)
    lines = sequential(spark.read.text(path), "line").where(text.nonempty(F.col("value")).isNotNull())
    rows = sequential(lines).withColumn("v", F.try_parse_json("value"))
    place = coordinates(source_type, locator, F.concat(F.lit("line="), (F.col("line") + 1).cast("string")))
    return Records(rows.select("rec_idx", place.alias("coord"), _json_data(F.col("v")).alias("data"), _json_issues(F.col("v"), F.col("v").isNull()).alias("issues")), source_type, locator)


# ---------------------------------------------------------------- tables and snapshots


def key_fragment(keys: Sequence[str], data: str | None = "data") -> Column:
    """k1=v1&k2=v2, None for NULL."""
    cell = lambda k: F.col(f"{data}.{k}" if data else k)
    return F.concat_ws("&", *(F.concat(F.lit(f"{k}="), F.coalesce(cell(k).cast("string"), F.lit("None"))) for k in keys))


def snapshot_version(frame: DataFrame) -> str:
    """A digest of a frame's rows that doesn't depend on their order, so it needs no sort: count and two sums of row hashes."""
    packed = F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(frame.columns))), {"ignoreNullFields": "false"})
    digest = F.sha2(packed, 256)
    part = lambda at: F.sum(F.conv(F.substring(digest, at, 12), 16, 10).cast("decimal(38,0)"))
    row = frame.select(F.count("*"), part(1), part(13)).first()
    import hashlib

    return "snap_" + hashlib.blake2b("/".join(str(x or 0) for x in row).encode(), digest_size=12).hexdigest()


@dataclass(frozen=True)
class TableSnapshot:
    """A table as a repeatable source: a copy in key order, in a folder of the caller or in the shared one, whose rows are numbered as they lie there."""

    table: DataFrame
    keys: Sequence[str]
    locator: str
    source_type: str = "table"
    version: str | None = None
    folder: str | None = None

    def open(self) -> Records:
        columns = self.table.columns
        # rows that share a key go by their other columns, as far as these have an order
        rest = [f.name for f in self.table.schema.fields if f.name not in self.keys and not re.match("map|variant", f.dataType.simpleString())]
        ordered = self.table.orderBy(*(F.col(f"`{c}`") for c in (*self.keys, *rest))) if self.keys else self.table
        frame = numbered(ordered, free_name(ordered, "rec_idx"), self.folder)
        version = self.version or snapshot_version(frame.select(*(F.col(f"`{c}`") for c in columns)))
        frame = frame.select(F.col(frame.columns[-1]).alias("rec_idx"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("data"))
        fragment = key_fragment(self.keys) if self.keys else F.concat(F.lit("row="), F.col("rec_idx").cast("string"))
        locator = f"{self.locator}@snapshot={version}"
        place = coordinates(self.source_type, locator, fragment, version)
        return Records(frame.select("rec_idx", place.alias("coord"), "data", issues_of().alias("issues")), self.source_type, locator)


class SqliteSource(DataSource):
    """spark.read.format("loomgraph_sqlite"): options path, table, columns (comma-separated), where, keys; rows in key order."""

    @classmethod
    def name(cls) -> str:
        return "loomgraph_sqlite"

    def _columns(self) -> list[str]:
        return [c.strip() for c in self.options["columns"].split(",")]

    def schema(self) -> str:
        import sqlite3

        kinds = {"INT": "bigint", "INTEGER": "bigint", "BIGINT": "bigint", "REAL": "double", "FLOAT": "double", "DOUBLE": "double"}
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            declared = {r[1]: r[2].upper() for r in db.execute(f'PRAGMA table_info("{self.options["table"]}")')}
        return ", ".join(f"`{c}` {kinds.get(declared.get(c, ''), 'string')}" for c in self._columns())

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(self.options, self._columns(), schema)


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str], schema: StructType) -> None:
        self.options, self.columns, self.text = dict(options), columns, [f.dataType.simpleString() == "string" for f in schema.fields]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # one file, one reader

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import sqlite3

        quote = lambda n: '"' + n.replace('"', '""') + '"'
        sql = f"SELECT {', '.join(map(quote, self.columns))} FROM {quote(self.options['table'])}"
        if self.options.get("where"):
            sql += f" WHERE {self.options['where']}"
        if self.options.get("keys"):
            sql += " ORDER BY " + ", ".join(quote(k.strip()) for k in self.options["keys"].split(","))
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            cursor = db.execute(sql)
            while rows := cursor.fetchmany(500):
                for row in rows:
                    yield tuple(str(v) if t and v is not None else v for v, t in zip(row, self.text, strict=True))


def sqlite_table(spark: SparkSession, path: str, table: str, columns: Sequence[str], where: str = "", keys: Sequence[str] = ()) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("loomgraph_sqlite").options(path=path, table=table, columns=",".join(columns), where=where, keys=",".join(keys)).load()


def jdbc_table(spark: SparkSession, url: str, table: str, columns: Sequence[str], where: dict[str, object] | None = None, keys: Sequence[str] = (), split: tuple[str, int, int, int] | None = None, properties: dict | None = None) -> DataFrame:
    """A projection and equality filters that the database evaluates, ordered by keys if there are any.

    Values of where are written as SQL literals, never pasted. split, (column,
    least, most, parts), reads in so many connections at once.
    """
    names = list(dict.fromkeys([*columns, *(where or {}), *keys, *(split[:1] if split else ())]))
    query = f"SELECT {', '.join(map(quote_identifier, names))} FROM {'.'.join(map(quote_identifier, table.split('.')))}"
    if where:
        query += " WHERE " + " AND ".join(f"{quote_identifier(c)} " + ("IS NULL" if v is None else f"= {sql_literal(v)}") for c, v in where.items())
    options = {"url": url, "dbtable": f"({query}) t", **(properties or {})}
    if split:
        column, least, most, parts = split
        options |= {"partitionColumn": column, "lowerBound": str(least), "upperBound": str(most), "numPartitions": str(parts)}
    frame = spark.read.format("jdbc").options(**options).load()
    return (frame.orderBy(*keys) if keys else frame).select(*columns)


def quote_identifier(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def sql_literal(value: object) -> str:
    """A number, truth value or text as SQL writes it; anything else is refused."""
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)) and value == value and abs(value) != float("inf"):
        return repr(value)
    if isinstance(value, str) and "\0" not in value:
        return "'" + value.replace("'", "''") + "'"
    raise ConfigurationError(f"no SQL literal for {value!r}")


def collect_rows(records: Records) -> list[Row]:
    """All rows in stream order, for small sources and tests."""
    return records.frame.orderBy("rec_idx").collect()
