"""Text as columns: stripping, canonical JSON, number formats, and strict casts that report instead of raising.

A cast takes a column and its Spark type (string, any number, boolean,
timestamp or variant) and gives two columns: the value, NULL where it can't be
read, and the reason, NULL where it can. Variant values are judged by what they
hold, so that JSON's 1 and CSV's "1" become one key.

Narrower than a general-purpose reader on purpose: integers are plain decimal
literals in the range of bigint, timestamps are dates with or without a time
(`2026-07-14`, `2026-07-14T00:00:00.5+02:00`).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What reads as true and false, in lower case.
TRUE_WORDS = ("true", "t", "yes", "y", "1")
FALSE_WORDS = ("false", "f", "no", "n", "0")

#: White space as Unicode and Python's str.strip know it.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_INTEGER = r"^[+-]?[0-9]+$"
_FLOAT = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_SPECIAL = r"^[+-]?(nan|inf|infinity)$"
_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}(:[0-9]{2}(:[0-9]{2}([.,][0-9]{1,6})?)?)?(Z|[+-][0-9]{2}(:?[0-9]{2})?)?)?$"
_ZONE = r"[T ].*(Z|[+-][0-9]{2}(:?[0-9]{2})?)$"


def strip(column: Column) -> Column:
    """Without white space at either end, any that Unicode knows."""
    return F.btrim(column, F.lit(SPACES))


def nonempty(column: Column) -> Column:
    """Stripped text, NULL if nothing is left."""
    return F.nullif(strip(column), F.lit(""))


def key_form(name: str) -> str:
    """How column names are compared: trimmed, without case."""
    return name.strip().casefold()


def quoted(column: Column) -> Column:
    """A text in quotes for messages: double ones only if it holds a single one."""
    double = F.contains(column, F.lit("'")) & ~F.contains(column, F.lit('"'))
    escaped = F.replace(F.replace(column, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))


def float_text(column: Column) -> Column:
    """A double in shortest decimal form: 42.0, 0.001, 1e+16, 1e-05, nan, inf."""
    size = F.abs(column)
    plain = column.cast("decimal(38,20)").cast("string")
    trimmed = F.regexp_replace(F.regexp_replace(plain, r"0+$", ""), r"\.$", ".0")
    power = column.cast("string")  # 1.5E16
    mantissa = F.regexp_replace(F.split_part(power, F.lit("E"), F.lit(1)), r"\.0$", "")
    exponent = F.split_part(power, F.lit("E"), F.lit(2)).cast("int")
    signed = F.concat(F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    return (
        F.when(F.isnan(column), "nan")
        .when(size == float("inf"), F.when(column > 0, "inf").otherwise("-inf"))
        .when(column == 0, F.when(F.lit(1.0).cast("double") / F.nullif(column, F.lit(0.0)) < 0, "-0.0").otherwise("0.0"))
        .when((size >= 1e-4) & (size < 1e16), trimmed)
        .otherwise(F.concat(mantissa, F.lit("e"), signed))
    )


# ---------------------------------------------------------------- variant


def let(column: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(column), body), F.lit(0))


#: Entries of an array that are folded at once.
PART = 256


def running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """An array of numbers, 0 or more, folded up to each place by add (a sum, or the greater one). A part at a time, so that a long array isn't copied once an entry."""

    def fold(part: Column) -> Column:
        return F.aggregate(part, F.array(F.lit(0)), lambda out, x: F.array_append(out, add(F.element_at(out, -1), x)))

    def joined(own: Column) -> Column:
        last = F.floor(F.greatest(F.size(own) - 1, F.lit(0)) / PART).cast("int")
        within = F.transform(F.sequence(F.lit(0), last), lambda i: fold(F.slice(own, i * PART + 1, PART)))
        return let(within, lambda parts: F.flatten(F.zip_with(parts, F.slice(fold(F.transform(parts, lambda x: F.element_at(x, -1))), 1, F.size(parts)), lambda x, base: F.transform(F.slice(x, 2, PART), lambda y: add(y, base)))))

    return let(values, joined)


def variant_kind(column: Column) -> Column:
    """string, int, float, bool, null, object or array: what a variant holds."""

    def name(schema: Column) -> Column:
        return (
            F.when(schema.isNull() | (schema == "VOID"), "null")
            .when(schema == "STRING", "string")
            .when(schema == "BOOLEAN", "bool")
            .when((schema == "BIGINT") | schema.rlike(r"^DECIMAL\((19|[23][0-9]),0\)$"), "int")  # a shorter one was written 1.0
            .when(schema.rlike(r"^DECIMAL|^DOUBLE|^FLOAT"), "float")
            .when(schema.startswith("ARRAY"), "array")
            .otherwise("object")
        )

    return let(F.schema_of_variant(column), name)


def _variant(column: Column, kind: str) -> Column:
    return F.try_variant_get(column, "$", kind)


def _of_variant(column: Column, casts: dict[str, Callable[[Column], tuple[Column, Column]]], target: str) -> tuple[Column, Column]:
    """Choose the cast by what the variant holds."""
    held = variant_kind(column)
    typed = {"string": _variant(column, "string"), "int": _variant(column, "bigint"), "float": _variant(column, "double"), "bool": _variant(column, "boolean")}
    value = reason = None
    for kind, cast in casts.items():
        v, r = cast(typed[kind])
        value = F.when(held == kind, v) if value is None else value.when(held == kind, v)
        reason = F.when(held == kind, r) if reason is None else reason.when(held == kind, r)
    if "int" in casts:  # whole numbers beyond bigint
        reason = F.when((held == "int") & typed["int"].isNull(), "out of range").otherwise(reason.otherwise(F.concat(held, F.lit(f" is not {target}"))))
    else:
        reason = reason.otherwise(F.concat(held, F.lit(f" is not {target}")))
    return value, reason


# ---------------------------------------------------------------- casts



#: Why a value can't be read, as callers compare it.
NOT_A_NUMBER, NOT_INTEGER, FRACTION, NO_TEXT_OF_BOOLEAN, NOT_A_TIME = "not a number", "not an integer literal", "would lose the fractional part", "a boolean has no unambiguous string form", "not an ISO-8601 datetime"


def _fine() -> Column:
    return F.lit(None).cast("string")


def widened(column: Column, kind: str) -> tuple[Column, str]:
    """Narrow integers as bigint, single floats as double; decimals without a fraction in their type as bigint if they fit."""
    if kind in ("tinyint", "smallint", "int"):
        return column.cast("bigint"), "bigint"
    if kind == "float":
        return column.cast("double"), "double"
    found = re.fullmatch(r"decimal\((\d+),(\d+)\)", kind)
    if found:
        return (column.cast("bigint"), "bigint") if found[2] == "0" and int(found[1]) <= 18 else (column, "decimal")
    return column, kind


def to_text(column: Column, kind: str) -> tuple[Column, Column]:
    """Stripped text; numbers in their usual form; booleans have none."""
    column, kind = widened(column, kind)
    if kind == "string":
        return strip(column), _fine()
    if kind == "double":
        return float_text(column), _fine()
    if kind == "boolean":
        return F.lit(None).cast("string"), F.when(column.isNotNull(), NO_TEXT_OF_BOOLEAN)
    if kind == "variant":
        return _of_variant(column, {k: (lambda c, t=t: to_text(c, t)) for k, t in (("string", "string"), ("int", "bigint"), ("float", "double"), ("bool", "boolean"))}, "a scalar")
    return column.cast("string"), _fine()


def to_integer(column: Column, kind: str) -> tuple[Column, Column]:
    """Whole numbers only: nothing is rounded."""
    column, kind = widened(column, kind)
    if kind == "bigint":
        return column, _fine()
    if kind == "decimal":
        value = F.when(column == F.floor(column), column.try_cast("bigint"))
        return value, F.when(column != F.floor(column), FRACTION).when(value.isNull(), "out of range")
    if kind == "double":
        whole = (column == F.floor(column)) & (F.abs(column) < 2.0**63)
        return F.when(whole, column.try_cast("bigint")), F.when(~whole | F.isnan(column), FRACTION)
    if kind == "string":
        text = strip(column)
        value = F.when(text.rlike(_INTEGER), F.regexp_replace(text, r"^\+", "").try_cast("bigint"))
        return value, F.when(value.isNull(), NOT_INTEGER)
    if kind == "boolean":
        return F.lit(None).cast("bigint"), F.when(column.isNotNull(), "a truth value counts nothing")
    if kind == "variant":
        return _of_variant(column, {k: (lambda c, t=t: to_integer(c, t)) for k, t in (("string", "string"), ("int", "bigint"), ("float", "double"), ("bool", "boolean"))}, "a number")
    return F.lit(None).cast("bigint"), F.when(column.isNotNull(), f"{kind} is not a number")


def to_float(column: Column, kind: str) -> tuple[Column, Column]:
    """Numbers and numeric text, nan and inf included."""
    column, kind = widened(column, kind)
    if kind in ("bigint", "double", "decimal"):
        return column.cast("double"), _fine()
    if kind == "string":
        text = F.lower(strip(column))
        special = F.regexp_replace(F.regexp_replace(text, r"^([+-]?)inf$", "$1infinity"), r"^[+-]nan$", "nan")
        value = F.when(text.rlike(_FLOAT), text.try_cast("double")).when(text.rlike(_SPECIAL), special.try_cast("double"))
        return value, F.when(value.isNull(), NOT_A_NUMBER)
    if kind == "boolean":
        return F.lit(None).cast("double"), F.when(column.isNotNull(), "a truth value measures nothing")
    if kind == "variant":
        return _of_variant(column, {k: (lambda c, t=t: to_float(c, t)) for k, t in (("string", "string"), ("int", "bigint"), ("float", "double"), ("bool", "boolean"))}, "a number")
    return F.lit(None).cast("double"), F.when(column.isNotNull(), f"{kind} is not a number")


def to_boolean(column: Column, kind: str) -> tuple[Column, Column]:
    """Words for true and false, and the integers 0 and 1."""
    column, kind = widened(column, kind)
    if kind == "boolean":
        return column, _fine()
    if kind == "bigint":
        return F.when(column.isin(0, 1), column == 1), F.when(~column.isin(0, 1), "a number is a truth value only if it is 0 or 1")
    if kind == "string":
        text = F.lower(strip(column))
        value = F.when(text.isin(*TRUE_WORDS), True).when(text.isin(*FALSE_WORDS), False)
        return value, F.when(value.isNull(), "neither a word for true nor for false")
    if kind == "variant":
        return _of_variant(column, {k: (lambda c, t=t: to_boolean(c, t)) for k, t in (("string", "string"), ("int", "bigint"), ("bool", "boolean"))}, "a boolean")
    return F.lit(None).cast("boolean"), F.when(column.isNotNull(), f"{kind} is not a boolean")


def to_timestamp(column: Column, kind: str) -> tuple[Column, Column]:
    """ISO-8601 dates and times; without a zone they count as UTC, which zone_assumed tells."""
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return column.cast("timestamp"), _fine()
    if kind == "string":
        text = strip(column)
        value = F.when(text.rlike(_DATE), F.replace(text, F.lit(","), F.lit(".")).try_cast("timestamp"))
        return value, F.when(value.isNull(), NOT_A_TIME)
    if kind == "variant":
        return _of_variant(column, {"string": lambda c: to_timestamp(c, "string")}, "a datetime")
    return F.lit(None).cast("timestamp"), F.when(column.isNotNull(), f"{kind} is not a datetime")


def zone_assumed(column: Column, kind: str) -> Column:
    """Whether a readable time names no zone."""
    if kind in ("timestamp_ntz", "date"):
        return column.isNotNull()
    if kind == "string":
        return ~strip(column).rlike(_ZONE)
    if kind == "variant":
        return (variant_kind(column) == "string") & ~strip(_variant(column, "string")).rlike(_ZONE)
    return F.lit(False)


CASTS = {"str": to_text, "int": to_integer, "float": to_float, "bool": to_boolean, "datetime": to_timestamp}
TYPES = {"str": "string", "int": "bigint", "float": "double", "bool": "boolean", "datetime": "timestamp"}


def iso(column: Column) -> Column:
    """A timestamp in ISO form, UTC, with a fraction only if there is one."""
    utc = F.to_utc_timestamp(column, F.current_timezone())
    whole = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")
    micro = F.date_format(utc, "SSSSSS")
    return F.concat(whole, F.when(micro != "000000", F.concat(F.lit("."), micro)).otherwise(""), F.lit("+00:00"))


def json_value(column: Column, kind: str) -> Column:
    """Canonical JSON of a scalar: sorted keys, no white space, whole floats with .0."""
    if kind == "string":
        listed = F.to_json(F.array(column))  # ["..."]
        return F.when(column.isNotNull(), F.substring(listed, F.lit(2), F.length(listed) - 2))
    if kind == "variant":
        return F.when(column.isNotNull(), F.to_json(column))
    column, kind = widened(column, kind)
    if kind == "double":
        return float_text(column)
    if kind == "timestamp":
        return F.concat(F.lit('"'), iso(column), F.lit('"'))
    return column.cast("string")
