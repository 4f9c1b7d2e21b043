"""Identifiers: entity references, semantic keys, and ids that are stable across runs.

A reference is a struct<entity_type, namespace, key>, written Type:namespace:key.
A stable id's suffix is the 128-bit BLAKE2b digest of its parts, joined by NUL, as
26 Crockford characters. Spark has no BLAKE2b, so this one runs in an Arrow
function; joins and comparisons use semantic keys and never need it.
"""

from __future__ import annotations

import hashlib
import os
import time

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomgraph.functions import text

#: Fixed values.
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
ENTITY_TYPE = r"^[A-Z][A-Za-z0-9]*\z"
NAMESPACE = r"^[a-z][a-z0-9_.-]*\z"
RELATION_TYPE = r"^[A-Z][A-Z0-9_]*\z"
IDENTITY_ID = r"^kg://[a-z][a-z0-9-]*/identity/[0-9A-Z]{26}\z"
ASSERTION_ID = r"^as_[0-9A-HJKMNP-TV-Z]{26}\z"
GRAPH_ID = r"^[a-z][a-z0-9-]*\z"


def crockford(raw: bytes, length: int = 26) -> str:
    """The last bits of a big-endian number, five a character."""
    number = int.from_bytes(raw, "big")
    return "".join(CROCKFORD[number >> shift & 31] for shift in range(5 * (length - 1), -1, -5))


def suffix_of(*parts: str) -> str:
    return crockford(hashlib.blake2b("\0".join(parts).encode(), digest_size=16).digest())


def random_suffix() -> str:
    """Milliseconds, then 80 random bits."""
    return crockford(int(time.time() * 1000).to_bytes(6, "big"), 10) + crockford(os.urandom(10), 16)


@F.pandas_udf(StringType())
def _suffix(joined: pd.Series) -> pd.Series:
    return joined.map(lambda x: None if x is None else crockford(hashlib.blake2b(x.encode(), digest_size=16).digest()))


@F.pandas_udf(StringType())
def _digest(value: pd.Series) -> pd.Series:
    return value.map(lambda x: None if x is None else "b2:" + hashlib.blake2b(x.encode(), digest_size=16).hexdigest())


def stable_suffix(*parts: Column) -> Column:
    return _suffix(F.concat_ws("\0", *parts))


def content_hash(json: Column) -> Column:
    """b2: and the 128-bit BLAKE2b digest of canonical JSON."""
    return _digest(json)


def candidate_id(graph: Column, kind: Column, key: Column) -> Column:
    return F.concat(F.lit("cand_"), stable_suffix(graph, kind, key))


def trace_id(run: Column, graph: Column, kind: Column, key: Column) -> Column:
    return F.concat(F.lit("trace_"), stable_suffix(run, graph, kind, key))


def reference(entity_type: Column, namespace: Column, key: Column) -> Column:
    return F.struct(entity_type.alias("entity_type"), namespace.alias("namespace"), key.alias("key"))


def render(ref: Column) -> Column:
    return F.concat_ws(":", ref["entity_type"], ref["namespace"], ref["key"])


def parse(column: Column) -> Column:
    """struct<ref, error>: a reference, split at the first two colons, or what is wrong with it."""
    parts = F.split(column, ":", 3)
    many = F.size(parts)
    error = F.when(column.isNull(), "reference is missing").when(many == 2, "namespace missing").when(many < 2, "not a reference")
    ref = reference(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2)))
    problem = F.coalesce(error, invalid(ref))
    return F.struct(F.when(problem.isNull(), ref).alias("ref"), problem.alias("error"))


def misnamed(ref: Column) -> Column:
    """What a reference's type or namespace violates, or NULL."""
    return F.when(~ref["entity_type"].rlike(ENTITY_TYPE), F.concat(F.lit("entity_type is malformed: "), ref["entity_type"])).when(~ref["namespace"].rlike(NAMESPACE), F.concat(F.lit("namespace is malformed: "), ref["namespace"]))


def invalid(ref: Column) -> Column:
    """What a reference violates, or NULL."""
    return F.coalesce(misnamed(ref), F.when(text.nonempty(ref["key"]).isNull(), "key is blank"))


def entity_key(ref: Column) -> Column:
    """type/namespace/key, the type in lower case."""
    return F.concat_ws("/", F.lower(ref["entity_type"]), ref["namespace"], ref["key"])


def period_suffix(valid_from: Column) -> Column:
    """A fact's time is part of its identity."""
    return F.when(valid_from.isNotNull(), F.concat(F.lit("@"), text.iso(valid_from))).otherwise("")


def is_identity(column: Column) -> Column:
    return F.coalesce(column.rlike(IDENTITY_ID), F.lit(False))


def is_assertion(column: Column) -> Column:
    return F.coalesce(column.rlike(ASSERTION_ID), F.lit(False))
