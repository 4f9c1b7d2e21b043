"""The canonical graph: bitemporal reads, neighborhoods, and batches that commit whole.

Entities and assertions are tables of a Store; a batch is an ordered list of
operations that the driver stages over the rows it touches, and its commit is
the next epoch. Status isn't kept by epoch: an old epoch hides what is revoked
now, unless asked for.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.errors import CapabilityError
from loomgraph.functions import identity
from loomgraph.operators.candidates import REF, SCORES
from loomgraph.operators.ledger import REFS
from loomgraph.sources.store import Store

SCHEMAS = {
    "entities": f"identity_id string, entity_type string, aliases array<{REF}>, status string, display_name string, created_at timestamp, curation_epoch long, touches long",
    "assertions": f"assertion_id string, subject_identity string, predicate string, object_value string, object_identity string, status string, valid_from timestamp, valid_to timestamp, recorded_at timestamp, superseded_at timestamp, superseded_by string, scores {SCORES}, evidence_refs {REFS}, source_candidate_ids array<string>, curation_epoch long, ord long",
}


@dataclass(frozen=True)
class ReadOptions:
    epoch: int | None = None
    valid_at: datetime | None = None
    transaction_at: datetime | None = None
    include_superseded: bool = False
    include_revoked: bool = False
    #: Declared for callers; no read looks at it.
    minimum_evidence_policy: str | None = None


# ---------------------------------------------------------------- predicates


def visible(options: ReadOptions) -> Column:
    """Committed by the epoch, and superseded or revoked only if asked for."""
    out = F.lit(True)
    if options.epoch is not None:
        out = out & (F.col("curation_epoch") <= options.epoch)
    if not options.include_superseded:
        out = out & (F.col("status") != "SUPERSEDED")
    if not options.include_revoked:
        out = out & (F.col("status") != "REVOKED")
    return out


def valid_at(moment: Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    """The closed period holds the moment; an open end holds everything on its side."""
    return (F.col(start).isNull() | (moment >= F.col(start))) & (F.col(end).isNull() | (moment <= F.col(end)))


def known_at(moment: Column, start: str = "recorded_at", end: str = "superseded_at") -> Column:
    """Recorded by the moment and not yet replaced then."""
    return (F.col(start) <= moment) & (F.col(end).isNull() | (moment < F.col(end)))


def shielded(assertions: DataFrame, entities: DataFrame, options: ReadOptions) -> DataFrame:
    """Without assertions about a revoked subject, unless asked for. A subject that isn't known hides nothing."""
    if options.include_revoked:
        return assertions
    revoked = entities.where("status = 'REVOKED'").select(F.col("identity_id").alias("subject_identity"))
    return assertions.join(revoked, "subject_identity", "left_anti")


def read_assertions(assertions: DataFrame, entities: DataFrame, options: ReadOptions = ReadOptions()) -> DataFrame:
    out = shielded(assertions, entities, options).where(visible(options))
    if options.valid_at is not None:
        out = out.where(valid_at(F.lit(options.valid_at)))
    if options.transaction_at is not None:
        out = out.where(known_at(F.lit(options.transaction_at)))
    return out


def find_by_alias(entities: DataFrame, refs: DataFrame) -> DataFrame:
    """Entities that have one of the references (entity_type, namespace, key) among their aliases: an equi-join on exploded aliases."""
    exploded = entities.select("identity_id", F.explode("aliases").alias("a")).select("identity_id", "a.*")
    return entities.join(exploded.join(refs.distinct(), ["entity_type", "namespace", "key"], "left_semi").select("identity_id").distinct(), "identity_id", "left_semi")


def neighborhood(edges: DataFrame, live: DataFrame, start: DataFrame, hops: int, cut=None) -> DataFrame:
    """(origin, identity_id, hop): what outgoing edges (src, dst) reach from each start (identity_id) in at most so many hops.

    Targets that aren't live are neither returned nor gone through; a start is
    not returned and need not exist. cut, given a frame, writes it and reads it
    back, for long walks.
    """
    links = edges.select("src", "dst").distinct()
    frontier = start.select(F.col("identity_id").alias("origin"), "identity_id").distinct()
    seen = frontier
    alive = live.select("identity_id").distinct()
    out = None
    for hop in range(1, hops + 1):
        step = frontier.join(links, F.col("identity_id") == F.col("src")).select("origin", F.col("dst").alias("identity_id")).distinct()
        step = step.join(seen, ["origin", "identity_id"], "left_anti")
        seen = seen.unionByName(step)
        frontier = step.join(alive, "identity_id", "left_semi").select("origin", "identity_id")
        if cut is not None:
            frontier, seen = cut(frontier), cut(seen)
        found = frontier.withColumn("hop", F.lit(hop))
        out = found if out is None else out.unionByName(found)
    return out if out is not None else frontier.withColumn("hop", F.lit(0)).where("false")


def malformed_assertion() -> Column:
    """What an assertion row's shape violates, or NULL."""
    both = F.col("object_value").isNull() == F.col("object_identity").isNull()
    replaced = F.col("superseded_by").isNotNull()
    return (
        F.when(both, "either object_value or object_identity")
        .when(~identity.is_identity(F.col("subject_identity")), "subject is not an identity id")
        .when(F.col("object_identity").isNotNull() & ~identity.is_identity(F.col("object_identity")), "object is not an identity id")
        .when(replaced & ((F.col("status") != "SUPERSEDED") | F.col("superseded_at").isNull() | ~identity.is_assertion(F.col("superseded_by"))), "superseded_by needs a superseded row and a well-formed id")
        .when(F.size("source_candidate_ids") != F.size(F.array_distinct("source_candidate_ids")), "source candidates repeat")
        .when(F.col("valid_from") > F.col("valid_to"), "valid_from is after valid_to")
    )


# ---------------------------------------------------------------- store


@dataclass(frozen=True)
class Operation:
    """type and payload: a row of entities or assertions, or {identity_id}."""

    type: str
    payload: dict


class Graph:
    """A canonical graph in a folder."""

    def __init__(self, spark: SparkSession, folder: str, temporal: bool = True) -> None:
        self.store, self.temporal = Store(spark, folder, SCHEMAS), temporal

    def current_epoch(self) -> int:
        return self.store.version()

    def _check(self, options: ReadOptions) -> None:
        if not self.temporal and (options.valid_at is not None or options.transaction_at is not None):
            raise CapabilityError("this graph doesn't answer temporal reads")

    def entities(self, ids: DataFrame | None = None, options: ReadOptions = ReadOptions()) -> DataFrame:
        """Entities, of the ids of a frame if given. Time doesn't filter entities."""
        self._check(options)
        frame = self.store.read("entities")
        if ids is not None:
            frame = frame.join(ids.select("identity_id").distinct(), "identity_id", "left_semi")
        return frame.where(visible(options))

    def find(self, refs: DataFrame, options: ReadOptions = ReadOptions()) -> DataFrame:
        return find_by_alias(self.entities(options=options), refs)

    def assertions(self, ids: DataFrame | None = None, options: ReadOptions = ReadOptions()) -> DataFrame:
        """Assertions about the identity_ids of a frame, in the order in which they were attached."""
        self._check(options)
        frame = self.store.read("assertions")
        if ids is not None:
            frame = frame.join(ids.select(F.col("identity_id").alias("subject_identity")).distinct(), "subject_identity", "left_semi")
        return read_assertions(frame, self.store.read("entities"), options).orderBy("curation_epoch", "ord")

    def assertion(self, ids: DataFrame, options: ReadOptions = ReadOptions()) -> DataFrame:
        return self.assertions(options=options).join(ids.select("assertion_id").distinct(), "assertion_id", "left_semi")

    def neighborhood(self, start: DataFrame, hops: int = 1, options: ReadOptions = ReadOptions()) -> DataFrame:
        edges = self.assertions(options=options).where("object_identity is not null").select(F.col("subject_identity").alias("src"), F.col("object_identity").alias("dst"))
        return neighborhood(edges, self.entities(options=options), start, hops)

    # writes

    def apply(self, operations: Sequence[Operation], versions: dict[str, str] | None = None) -> dict:
        """Commit a batch as the next epoch: {committed, epoch, error, failed}. versions: how often each identity must have been touched so far.

        Operations act in order on rows that the driver staged, so a batch may
        create and revoke one identity. A batch that fails changes nothing.
        """
        spark, base = self.store.spark, self.store.version()
        epoch = base + 1
        named = {o.payload.get("identity_id") or o.payload.get("subject_identity") for o in operations} | set(versions or {})
        wanted = spark.createDataFrame([(n,) for n in named if n], "identity_id string")
        stored = self.store.read("entities", base)
        touched = {r["identity_id"]: r.asDict(recursive=True) for r in stored.join(F.broadcast(wanted), "identity_id", "left_semi").collect()}  # the rows that the batch names
        failed = [i for i, v in (versions or {}).items() if str((touched.get(i) or {"touches": 0})["touches"]) != str(v)]
        if failed:
            return {"committed": False, "epoch": None, "error": None, "failed": failed}
        for o in operations:
            if o.type not in ("CREATE_IDENTITY", "ATTACH_ASSERTION", "REVOKE_IDENTITY", "RESTORE_IDENTITY"):
                raise NotImplementedError(f"{o.type} is not implemented")
        no = lambda error: {"committed": False, "epoch": None, "error": error, "failed": []}
        attached: list[dict] = []
        known = self._known(operations, base)
        counts: dict[str, int] = {}
        for place, o in enumerate(operations):
            if o.type == "CREATE_IDENTITY":
                key = o.payload["identity_id"]
                old = touched.get(key)
                touched[key] = {"status": "ACTIVE", **o.payload, "curation_epoch": epoch, "touches": old["touches"] if old else 0}
            elif o.type == "ATTACH_ASSERTION":
                key = o.payload["subject_identity"]
                if o.payload["assertion_id"] in known:
                    return no(f"ATTACH_ASSERTION repeats assertion {o.payload['assertion_id']!r}")
                known.add(o.payload["assertion_id"])
                attached.append({"status": "ACTIVE", **o.payload, "curation_epoch": epoch, "ord": place})
            else:
                key = o.payload.get("identity_id")
                if not isinstance(key, str):
                    return no(f"{o.type} needs a text identity_id, not {key!r}")
                if key not in touched:
                    return no(f"{o.type} names an unknown identity: {key!r}")
                gone = touched[key]["status"] == "REVOKED"
                if o.type == "REVOKE_IDENTITY" and gone:
                    return no(f"REVOKE_IDENTITY names an identity that is revoked already: {key!r}")
                if o.type == "RESTORE_IDENTITY" and not gone:
                    return no(f"RESTORE_IDENTITY names an identity that is not revoked: {key!r}")
                touched[key] = touched[key] | {"status": "REVOKED" if o.type == "REVOKE_IDENTITY" else "ACTIVE"}
            counts[key] = counts.get(key, 0) + 1
        for key, n in counts.items():
            if key in touched:
                touched[key]["touches"] += n
        changed = self._frame("entities", [touched[k] for k in counts if k in touched])
        append = {"assertions": self._frame("assertions", attached)} if attached else None
        replace = {"entities": stored.join(changed.select("identity_id"), "identity_id", "left_anti").unionByName(changed)}
        self.store.commit(append, replace, base, "batch")
        return {"committed": True, "epoch": epoch, "error": None, "failed": []}

    def _known(self, operations: Sequence[Operation], base: int) -> set[str]:
        asked = [(o.payload["assertion_id"],) for o in operations if o.type == "ATTACH_ASSERTION"]
        if not asked:
            return set()
        ids = self.store.spark.createDataFrame(asked, "assertion_id string")
        return {r[0] for r in self.store.read("assertions", base).join(F.broadcast(ids), "assertion_id", "left_semi").select("assertion_id").collect()}

    def _frame(self, table: str, rows: list[dict]) -> DataFrame:
        empty = self.store.spark.createDataFrame([], SCHEMAS[table])
        return self.store.spark.createDataFrame([tuple(r.get(n) for n in empty.columns) for r in rows], empty.schema)

    def put_entities(self, rows: DataFrame) -> int:
        """Many entities at once, replacing those of the same id."""
        base = self.store.version()
        new = rows.withColumns({"curation_epoch": F.lit(base + 1).cast("long"), "touches": F.lit(1).cast("long")})
        kept = self.store.read("entities", base).join(new.select("identity_id"), "identity_id", "left_anti")
        return self.store.commit(None, {"entities": kept.unionByName(new, allowMissingColumns=True)}, base, "put")

    def mark_superseded(self, assertion_id: str, at: datetime, by: str | None = None) -> None:
        """Close an assertion, naming what follows it if anything does."""
        base = self.store.version()
        rows = self.store.read("assertions", base)
        own = F.col("assertion_id") == assertion_id
        if rows.where(own).isEmpty():
            raise KeyError(f"no assertion {assertion_id!r}")
        if by is not None and rows.sparkSession.range(1).select(identity.is_assertion(F.lit(by))).first()[0] is False:
            raise ValueError(f"not an assertion id: {by!r}")
        marked = rows.withColumns({
            "status": F.when(own, "SUPERSEDED").otherwise(F.col("status")), "superseded_at": F.when(own, F.lit(at).cast("timestamp")).otherwise(F.col("superseded_at")),
            "superseded_by": F.when(own & F.lit(by is not None), F.lit(by).cast("string")).otherwise(F.col("superseded_by")),
        })
        self.store.commit(None, {"assertions": marked}, base, "supersede")
