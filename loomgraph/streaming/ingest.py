"""Structured Streaming in front of the batch pipeline, an extension: the semantics are those of the batches.

dropDuplicatesWithinWatermark wouldn't do for admission: it forgets keys and
can't see which candidate is valid. So each micro-batch goes through the same
plan and the ledger, whose commits make a second delivery a duplicate.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.operators.ledger import Ledger
from loomgraph.plans.ingest import Pipeline, Report
from loomgraph.sources.records import Records, coordinates, issues_of, sequential


def as_records(batch: DataFrame, source_type: str, locator: str, batch_id: int) -> Records:
    """A micro-batch as records; the batch id is the version of their coordinates."""
    frame = sequential(batch.select(F.struct(*(F.col(f"`{c}`") for c in batch.columns)).alias("data")))
    fragment = F.concat(F.lit(f"batch={batch_id}&row="), F.col("rec_idx").cast("string"))
    return Records(frame.select("rec_idx", coordinates(source_type, locator, fragment, str(batch_id)).alias("coord"), "data", issues_of().alias("issues")), source_type, locator)


def ingest(stream: DataFrame, pipeline: Pipeline, ledger: Ledger, checkpoint: str, locator: str = "stream", on_report: Callable[[int, Report], None] | None = None, available_now: bool = False) -> StreamingQuery:
    """Run the pipeline on each micro-batch of a stream and submit to the ledger."""

    def one(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            own = replace(pipeline, source=as_records(batch, "stream", locator, batch_id), run_id=f"{pipeline.run_id or 'stream'}-{batch_id}")
            _, report = own.run(ledger)
            if on_report:
                on_report(batch_id, report)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(stream: DataFrame, time: str, kind: str, width: str, late: str) -> DataFrame:
    """Rows by window and kind; rows later than the watermark are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), F.col(kind)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), F.col(kind).alias("kind"), "n")


def read_files(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(folder)
