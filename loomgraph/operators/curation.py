"""Curation plans as lines of JSON, so that a queue, a log or a file can carry them to whoever applies them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A plan. An operation's payload is JSON text, and travels as it is.
PLAN = (
    "plan_id string, candidate_ids array<string>, snapshot_version string, operations array<struct<type:string,payload:string>>, "
    "preconditions array<struct<kind:string,subject:string,expected:string>>, evidence_ids array<string>, policy_version string"
)
_FIELDS = tuple(part.split(" ")[0] for part in PLAN.split(", "))


def broken() -> Column:
    """Why a plan can't be carried, NULL if it can."""
    missing = [F.when(F.col(name).isNull(), f"{name} is missing") for name in _FIELDS]
    return F.coalesce(*missing, F.when(F.size("candidate_ids") == 0, "a plan is for one candidate at least"))


def to_lines(plans: DataFrame) -> DataFrame:
    """(plan_id, line, why_not): a line for each plan. What is null inside stays so; a plan that can't be carried has why_not and no line."""
    line = F.to_json(F.struct(*_FIELDS), {"ignoreNullFields": "false"})
    return plans.select("plan_id", F.when(broken().isNull(), line).alias("line"), broken().alias("why_not"))


def from_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """The plans of JSON lines, with why_not for those that aren't plans. What to_lines wrote comes back equal."""
    read = F.from_json(F.col(column), f"{PLAN}, __broken string", {"columnNameOfCorruptRecord": "__broken"})
    plans = lines.select(read.alias("plan")).select(*(F.col(f"plan.{name}").alias(name) for name in _FIELDS), F.col("plan.__broken").alias("__broken"))
    return plans.withColumn("why_not", F.coalesce(F.when(F.col("__broken").isNotNull(), "not the JSON of a plan"), broken())).drop("__broken")
