"""Normalization: source columns to named, typed values, with everything that doesn't fit kept as issues."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

from loomgraph.errors import ConfigurationError
from loomgraph.functions import text
from loomgraph.sources.records import ISSUES, issue


@dataclass(frozen=True)
class Field:
    """A value to read: its type (str, int, float, bool, datetime), other names it goes by, and what stands for it when absent."""

    name: str
    type: str = "str"
    required: bool = False
    aliases: tuple[str, ...] = ()
    default: object = None
    empty_as_null: bool = True

    @property
    def keys(self) -> tuple[str, ...]:
        return (self.name, *self.aliases)


def check_fields(fields: Sequence[Field]) -> dict[str, str]:
    """Which field claims each source key; one column can't feed two fields."""
    claimed: dict[str, str] = {}
    for field in fields:
        if field.type not in text.CASTS:
            raise ConfigurationError(f"{field.name}: unknown type {field.type!r}")
        for key in field.keys:
            owner = claimed.setdefault(text.key_form(key), field.name)
            if owner != field.name:
                raise ConfigurationError(f"{key!r} is claimed by both {owner!r} and {field.name!r}")
    return claimed


def _entries(key: str) -> Column:
    """The entries of a data map whose name has this form."""
    return F.map_filter("data", lambda k, _: F.lower(text.strip(k)) == key)


def _raw(frame: DataFrame, field: Field) -> tuple[Column, Column, str]:
    """(present, raw value, its Spark type) of a field. The first key that is present wins, even if its value is NULL."""
    kind = frame.schema["data"].dataType
    if isinstance(kind, MapType):
        present, raw = F.lit(False), None
        for key in field.keys:
            own = _entries(text.key_form(key))
            found = F.coalesce(F.size(own) > 0, F.lit(False))
            value = F.element_at(F.map_values(own), -1)
            raw = F.when(found, value) if raw is None else raw.when(found, value)
            present = present | found
        return present, raw, "variant"
    names = {text.key_form(f.name): f for f in kind.fields}
    for key in field.keys:
        own = names.get(text.key_form(key))
        if own is not None:
            return F.lit(True), F.col("data").getField(own.name), own.dataType.simpleString()
    return F.lit(False), F.lit(None).cast("string"), "string"


def _absent(field: Field, present: Column, raw: Column, kind: str) -> Column:
    empty = ~present | raw.isNull()
    if kind == "variant":
        held = text.variant_kind(raw)
        empty = empty | (held == "null")
        if field.empty_as_null:
            empty = empty | ((held == "string") & (text.strip(F.try_variant_get(raw, "$", "string")) == ""))
    elif kind == "string" and field.empty_as_null:
        empty = empty | (text.strip(raw) == "")
    return F.coalesce(empty, F.lit(True))


def _shown(raw: Column, kind: str) -> Column:
    """The raw value as a message shows it."""
    if kind == "string":
        return text.quoted(raw)
    if kind == "variant":
        own = F.try_variant_get(raw, "$", "string")
        return F.when(text.variant_kind(raw) == "string", text.quoted(own)).otherwise(F.to_json(raw))
    raw, kind = text.widened(raw, kind)
    return text.float_text(raw) if kind == "double" else raw.cast("string")


def normalize(frame: DataFrame, fields: Sequence[Field], keep: Sequence[str] = ()) -> DataFrame:
    """rec_idx, coord, values (a struct with a column a field), extras (map of columns that no field claims, as text), issues, and the columns to keep. Never fails on data."""
    claimed = check_fields(fields)
    values, found = [], []
    for field in fields:
        present, raw, kind = _raw(frame, field)
        absent = _absent(field, present, raw, kind)
        value, reason = text.CASTS[field.type](raw, kind)
        default = F.lit(field.default).cast(text.TYPES[field.type])
        values.append(F.when(absent, default).otherwise(value).alias(field.name))
        if field.required:
            found.append(F.when(absent, issue("missing_required", f"required field {field.name!r} is missing or empty", field=field.name)))
        failed = F.concat(F.lit("cannot read "), _shown(raw, kind), F.lit(f" as {field.type}: "), reason)
        found.append(F.when(~absent & reason.isNotNull(), issue("coercion_failed", failed, field=field.name)))
        if field.type == "datetime":
            assumed = ~absent & reason.isNull() & F.coalesce(text.zone_assumed(raw, kind), F.lit(False))
            found.append(F.when(assumed, issue("assumed_utc", F.concat(F.substring(text.iso(value), 1, 19), F.lit(" has no timezone; assuming UTC")), "warning", field.name)))
    issues = F.concat("issues", F.array_compact(F.array(*found)).cast(ISSUES)) if found else F.col("issues")
    return frame.select("rec_idx", "coord", F.struct(*values).alias("values") if values else F.struct(F.lit(None).alias("none")).alias("values"), _extras(frame, claimed).alias("extras"), issues.alias("issues"), *keep)


def _extras(frame: DataFrame, claimed: dict[str, str]) -> Column:
    kind = frame.schema["data"].dataType
    if isinstance(kind, MapType):
        rest = F.map_filter("data", lambda k, _: ~F.lower(text.strip(k)).isin(*claimed)) if claimed else F.col("data")
        return F.transform_values(rest, lambda _, v: F.to_json(v))
    assert isinstance(kind, StructType)
    rest = [f.name for f in kind.fields if text.key_form(f.name) not in claimed]
    if not rest:
        return F.create_map().cast("map<string,string>")
    whole = F.map_from_arrays(F.array(*(F.lit(n) for n in rest)), F.array(*(F.col("data").getField(n).cast("string") for n in rest)))
    return whole.cast("map<string,string>")


def passthrough(frame: DataFrame) -> DataFrame:
    """The source's own columns as values; for sources that are canonical already."""
    return frame.select("rec_idx", "coord", F.col("data").alias("values"), F.create_map().cast("map<string,string>").alias("extras"), "issues")
