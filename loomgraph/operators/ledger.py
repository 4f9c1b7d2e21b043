"""The candidate ledger: idempotent admission, state changes, withdrawal and erasure.

Rows, payloads and events are append-only tables of one Store; a row's state is
its latest event, by commit and step within it. A row is live unless it was
revoked or erased; tombstones free the semantic key but keep the candidate id.
Payloads lie in buckets; erasing rewrites the row's bucket alone, and the files
that it replaces can be deleted afterwards (Store.vacuum).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.errors import IllegalTransition
from loomgraph.operators.candidates import BODY, SCORES
from loomgraph.sources.records import COORD
from loomgraph.sources.store import Store, scratch

#: The states that each state can go to.
LEGAL: dict[str, tuple[str, ...]] = {
    "RECEIVED": ("VALIDATED", "INVALID", "BLOCKED", "RETRYABLE_ERROR", "OBSOLETE"),
    "VALIDATED": ("RESOLUTION_PENDING", "REVIEW_PENDING", "ACCEPTED", "OBSOLETE", "RETRYABLE_ERROR"),
    "BLOCKED": ("RECEIVED", "REJECTED", "INVALID"),
    "RESOLUTION_PENDING": ("REVIEW_PENDING", "ACCEPTED", "REJECTED", "OBSOLETE", "RETRYABLE_ERROR"),
    "REVIEW_PENDING": ("ACCEPTED", "REJECTED", "OBSOLETE"),
    "RETRYABLE_ERROR": ("VALIDATED", "RECEIVED", "PERMANENT_ERROR", "REJECTED"),
    "ACCEPTED": (),
    "REJECTED": (),
    "INVALID": (),
    "OBSOLETE": (),
    "PERMANENT_ERROR": (),
}
TERMINAL = tuple(s for s, to in LEGAL.items() if not to)

REFS = "array<struct<evidence_id:string,relationship:string>>"
#: A candidate as it is planned and submitted.
COLUMNS = {
    **dict.fromkeys(("candidate_id", "graph_id", "kind", "semantic_key", "content_hash", "producer", "producer_run_id", "ontology_version", "trace_id"), "string"),
    "created_at": "timestamp", "rec_idx": "long", "pos": "int", "coord": COORD, "scores": SCORES, "evidence_refs": REFS,
    **dict.fromkeys(("model_id", "model_version", "extractor_version", "prompt_version", "passage"), "string"),
    **{name: kind for name, kind in BODY.items() if name not in ("kind", "semantic_key")},
}
CANDIDATE = ", ".join(f"{name} {kind}" for name, kind in COLUMNS.items())

SCHEMAS = {
    "entries": "candidate_id string, graph_id string, semantic_key string, kind string, payload_hash string, valid_from timestamp, valid_to timestamp, received_at timestamp, recorded_at timestamp, trace_id string",
    "payloads": "candidate_id string, bucket int, payload string",
    "events": "seq long, candidate_id string, kind string, from_state string, to_state string, reason string, actor string, at timestamp, retry_delta int, quarantine_reason string, payload_hash string, detail string, step int",
}
BUCKETS = 64


def edges(spark: SparkSession) -> DataFrame:
    """(from_state, to_state) of all legal transitions."""
    return spark.createDataFrame([(a, b) for a, to in LEGAL.items() for b in to], "from_state string, to_state string")


def legal(from_state: Column, to_state: Column) -> Column:
    pairs = [f"{a}>{b}" for a, to in LEGAL.items() for b in to]
    return F.coalesce(F.concat(from_state, F.lit(">"), to_state).isin(*pairs), F.lit(False))


def bucket(candidate_id: Column) -> Column:
    return F.pmod(F.xxhash64(candidate_id), F.lit(BUCKETS)).cast("int")


def admit(candidates: DataFrame, entries: DataFrame, live: DataFrame, ambiguous: Column | None = None, order: Sequence[str] = ("rec_idx", "pos")) -> DataFrame:
    """The candidates with status and reason.

    DUPLICATE: the key has a live row, or the id has any row, or an earlier one of
    the batch took either. INVALID: ambiguous, which reserves nothing and is only
    asked where the key is free. RECEIVED: the first of a key that is neither.
    """
    unsure = F.coalesce(ambiguous, F.lit(False)) if ambiguous is not None else F.lit(False)
    taken = live.select("graph_id", "semantic_key").distinct().withColumn("__live", F.lit(True))
    known = entries.select("candidate_id").distinct().withColumn("__known", F.lit(True))
    frame = candidates.withColumn("__unsure", unsure).join(taken, ["graph_id", "semantic_key"], "left").join(known, "candidate_id", "left")
    free = F.col("__live").isNull() & ~F.col("__unsure") & F.col("__known").isNull()
    place = F.struct(*(F.col(c) for c in order))
    # one row a key and one an id: aggregates combine before the shuffle, so hot keys don't meet in a task
    first_key = frame.where(free).groupBy("graph_id", "semantic_key").agg(F.min(F.struct(*(F.col(c) for c in order), F.col("candidate_id").alias("__id"))).alias("__first"))
    first_id = first_key.groupBy(F.col("__first.__id").alias("candidate_id")).agg(F.min(F.struct(*(F.col(f"__first.{c}").alias(c) for c in order))).alias("__first_id"))
    joined = frame.join(first_key, ["graph_id", "semantic_key"], "left").join(first_id, "candidate_id", "left")
    own = F.struct(*(F.col(f"__first.{c}").alias(c) for c in order))
    wins = free & (place == own) & (place == F.col("__first_id"))
    before = F.col("__first").isNull() | (place < own)
    status = F.when(wins, "RECEIVED").when(F.col("__live").isNull() & F.col("__unsure") & before, "INVALID").otherwise("DUPLICATE")
    reason = F.when(status == "INVALID", "ambiguous identity match rejected (REJECT_ONLY)").when(status == "DUPLICATE", F.concat(F.lit("semantic_key already in ledger: "), F.col("semantic_key")))
    return joined.withColumns({"status": status, "reason": reason}).drop("__live", "__known", "__unsure", "__first", "__first_id")


def states(events: DataFrame) -> DataFrame:
    """candidate_id, state, retry_count, quarantine_reason, revoked, erased, last_at: what the events add up to."""
    changes = F.col("kind").isin("submit", "transition")
    at = F.struct("seq", F.coalesce("step", F.lit(0)).alias("step")) if "step" in events.columns else F.struct("seq")
    return events.groupBy("candidate_id").agg(
        F.max_by(F.when(changes, F.col("to_state")), F.when(changes, at)).alias("state"),
        F.coalesce(F.sum("retry_delta"), F.lit(0)).alias("retry_count"),
        F.max_by("quarantine_reason", F.when(F.col("quarantine_reason").isNotNull(), at)).alias("quarantine_reason"),
        F.max(F.col("kind") == "revoke").alias("revoked"),
        F.max(F.col("kind") == "erase").alias("erased"),
        F.max("at").alias("last_at"),
    )


def folded(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """Changes asked for (candidate_id, ord, to_state, reason) with state (what each finds), why_not (NULL if it is legal) and step.

    One id's requests are folded in their order: a refused one leaves the state as it is.
    """
    each = asked.groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct("ord", "to_state", "reason"))).alias("asked")).join(rows, "candidate_id", "left")
    live = F.col("state").isNotNull() & ~F.col("revoked") & ~F.col("erased")

    def step(found: Column, one: Column) -> Column:
        why = F.when(~live, "no live ledger entry").when(~legal(found["state"], one["to_state"]), F.concat(found["state"], F.lit(" can't go to "), one["to_state"]))
        judged = F.struct(one["ord"].alias("ord"), one["to_state"].alias("to_state"), one["reason"].alias("reason"), found["state"].alias("state"), why.alias("why_not"))
        return F.struct(F.when(why.isNull(), one["to_state"]).otherwise(found["state"]).alias("state"), F.array_append(found["out"], judged).alias("out"))

    kind = f"array<struct<ord:{dict(asked.dtypes)['ord']},to_state:string,reason:string,state:string,why_not:string>>"
    out = F.aggregate("asked", F.struct(F.col("state").alias("state"), F.array().cast(kind).alias("out")), step, lambda found: found["out"])
    return each.select("candidate_id", "payload_hash", F.posexplode(out).alias("step", "r")).select("candidate_id", "payload_hash", "step", "r.*")


def duplicates(planned: DataFrame, entries: DataFrame, live: DataFrame) -> DataFrame:
    """Planned candidates that a submit would call DUPLICATE: a live row has the key, or any row the id. Two flags, so no join has an OR."""
    keys = live.select("graph_id", "semantic_key").distinct().withColumn("__k", F.lit(True))
    ids = entries.select("candidate_id").distinct().withColumn("__i", F.lit(True))
    return planned.join(keys, ["graph_id", "semantic_key"], "left").join(ids, "candidate_id", "left").where("__k or __i").drop("__k", "__i")


@dataclass(frozen=True)
class Profile:
    """What a consumer allows."""

    reject_ambiguous: bool = False
    erasure: bool = False


class Sink(Protocol):
    """What an ingestion hands its candidates to."""

    spark: SparkSession

    def submit(self, candidates: DataFrame) -> DataFrame:
        """Outcomes: candidate_id, status, reason, trace_id."""


class MemorySink:
    """A sink that lives as long as this object, for trials and tests: its rows are intermediate tables, and nothing is committed.

    The first candidate of a key is received and stays as it was; ids and keys
    are taken as in a ledger. Rows are read in the order in which they came.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._batches: list[DataFrame] = []

    def received(self) -> DataFrame | None:
        """Received candidates of all batches with state and received_at, None before the first batch."""
        out = None
        for place, batch in enumerate(self._batches):
            rows = batch.where("status = 'RECEIVED'").drop("status", "reason").withColumns({"state": F.lit("RECEIVED"), "received_at": F.col("created_at"), "batch": F.lit(place)})
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def entries(self, graph_id: str | None = None, in_states: Sequence[str] | None = None) -> DataFrame | None:
        frame = self.received()
        if frame is None:
            return None
        if graph_id is not None:
            frame = frame.where(F.col("graph_id") == graph_id)
        if in_states is not None:
            frame = frame.where(F.col("state").isin(*in_states))
        return frame.orderBy("batch", "rec_idx", "pos").drop("batch")

    def submit(self, candidates: DataFrame) -> DataFrame:
        known = self.received()
        taken = candidates.limit(0) if known is None else known
        folder = scratch(self.spark, "memory-sink")
        judged = admit(candidates, taken, taken)
        judged.write.parquet(folder)
        self._batches.append(self.spark.read.schema(judged.schema).parquet(folder))
        return self._batches[-1].select("candidate_id", "status", "reason", "trace_id")


class Ledger:
    """A ledger in a folder, or in a Store that it shares with evidence."""

    def __init__(self, spark: SparkSession, folder: str | None = None, profile: Profile = Profile(), store: Store | None = None, clock=lambda: datetime.now(UTC)) -> None:
        self.store = store or Store(spark, folder, SCHEMAS)
        self.store.schemas |= SCHEMAS
        self.store.parted |= {"payloads": "bucket"}
        self.spark, self.profile, self.clock = self.store.spark, profile, clock

    # reads

    def rows(self, version: int | None = None) -> DataFrame:
        """Every row with its state, tombstones included."""
        return self.store.read("entries", version).join(states(self.store.read("events", version)), "candidate_id")

    def live(self, version: int | None = None) -> DataFrame:
        return self.rows(version).where("not revoked and not erased")

    def entries(self, graph_id: str | None = None, in_states: Sequence[str] | None = None) -> DataFrame:
        """Live rows with their payload, by time and id."""
        frame = self.live()
        if graph_id is not None:
            frame = frame.where(F.col("graph_id") == graph_id)
        if in_states is not None:
            frame = frame.where(F.col("state").isin(*in_states))
        return frame.join(self.store.read("payloads").select("candidate_id", "payload"), "candidate_id").orderBy("recorded_at", "candidate_id")

    def entry(self, ids: DataFrame) -> DataFrame:
        """Rows for the ids of a frame, revoked ones too, erased ones not."""
        return self.rows().join(ids.select("candidate_id").distinct(), "candidate_id", "left_semi").where("not erased").join(self.store.read("payloads").select("candidate_id", "payload"), "candidate_id")

    def audit(self) -> DataFrame:
        return self.store.read("events").orderBy("seq", "candidate_id", "kind")

    def _one(self, candidate_id: str, version: int | None = None):
        return self.rows(version).where(F.col("candidate_id") == candidate_id).first()

    def is_revoked(self, candidate_id: str) -> bool:
        row = self._one(candidate_id)
        return bool(row and row["revoked"])

    def is_erased(self, candidate_id: str) -> bool:
        row = self._one(candidate_id)
        return bool(row and row["erased"])

    def known(self, ids: DataFrame) -> DataFrame:
        """Of a frame's ids, those that any row has."""
        return ids.join(self.store.read("entries").select("candidate_id").distinct(), "candidate_id", "left_semi")

    # writes

    def submit(self, candidates: DataFrame, ambiguous: Column | None = None) -> DataFrame:
        """Admit a batch; outcomes are candidate_id, status, reason, trace_id. All of it is committed, or nothing."""
        base = self.store.version()
        now = F.lit(self.clock()).cast("timestamp")
        judged = admit(candidates, self.store.read("entries", base), self.live(base), ambiguous if self.profile.reject_ambiguous else None)
        packed = F.to_json(F.struct(*(F.col(c) for c in candidates.columns)))
        judged = judged.withColumns({"payload": packed, "payload_hash": F.sha2(packed, 256)})
        staged = f"{self.store.folder}/_staged/{base + 1:010d}-{uuid.uuid4().hex}"
        judged.write.parquet(staged)
        judged = self.store.spark.read.schema(judged.schema).parquet(staged)
        got = judged.where("status = 'RECEIVED'")
        self.store.commit(
            append={
                "entries": got.select("candidate_id", "graph_id", "semantic_key", "kind", "payload_hash", "valid_from", "valid_to", F.col("created_at").alias("received_at"), now.alias("recorded_at"), "trace_id"),
                "payloads": got.select("candidate_id", bucket(F.col("candidate_id")).alias("bucket"), "payload"),
                "events": self._events(got, base, "submit", F.lit(None), F.lit("RECEIVED"), F.lit(None), F.col("producer")),
            },
            base=base,
            note="submit",
        )
        return judged.select("candidate_id", "status", "reason", "trace_id")

    def _events(self, rows: DataFrame, base: int, kind: str, from_state: Column, to_state: Column, reason: Column, actor: Column, retry: int = 0, quarantine: str | None = None, detail: Column | None = None) -> DataFrame:
        text = lambda c: c.cast("string")
        return rows.select(
            F.lit(base + 1).cast("long").alias("seq"), "candidate_id", F.lit(kind).alias("kind"), text(from_state).alias("from_state"), text(to_state).alias("to_state"), text(reason).alias("reason"), text(actor).alias("actor"),
            F.lit(self.clock()).cast("timestamp").alias("at"), F.lit(retry).alias("retry_delta"), F.lit(quarantine).cast("string").alias("quarantine_reason"), "payload_hash", text(detail if detail is not None else F.lit(None)).alias("detail"), (F.col("step") if "step" in rows.columns else F.lit(0)).cast("int").alias("step"),
        )

    def transition(self, candidate_id: str, to_state: str, actor: str, reason: str | None = None, increment_retry: bool = False, quarantine_reason: str | None = None) -> None:
        base = self.store.version()
        row = self._one(candidate_id, base)
        if row is None or row["revoked"] or row["erased"]:
            raise KeyError(f"no live ledger entry for {candidate_id}")
        if to_state not in LEGAL.get(row["state"], ()):
            raise IllegalTransition(f"{row['state']} can't go to {to_state}")
        self._append_event(base, candidate_id, "transition", row["state"], to_state, reason, actor, int(increment_retry), quarantine_reason)

    def transitions(self, asked: DataFrame, actor: str) -> DataFrame:
        """Many at once: (candidate_id, to_state, reason). Legal ones are committed; all come back with applied and why not.

        An id may be asked for several times if a column ord says in which order:
        each is judged by the state that those before it led to. Without ord an id
        may come once.
        """
        base = self.store.version()
        if "ord" not in asked.columns:
            again = asked.groupBy("candidate_id").count().where("count > 1").first()
            if again:
                raise ValueError(f"{again[0]} is asked for more than once, and nothing says in which order")
            asked = asked.withColumn("ord", F.lit(0))
        rows = self.rows(base).select("candidate_id", "state", "revoked", "erased", "payload_hash")
        target = scratch(self.store.spark, "transitions")
        folded(asked, rows).write.parquet(target)
        judged = self.store.spark.read.parquet(target)
        ok = judged.where("why_not is null")
        self.store.commit(append={"events": self._events(ok, base, "transition", F.col("state"), F.col("to_state"), F.col("reason"), F.lit(actor))}, base=base, note="transitions")
        return judged.select("candidate_id", "to_state", F.col("why_not").isNull().alias("applied"), "why_not", "ord")

    def _append_event(self, base: int, candidate_id: str, kind: str, from_state, to_state, reason, actor, retry: int = 0, quarantine: str | None = None) -> None:
        rows = self.store.read("entries", base).where(F.col("candidate_id") == candidate_id)
        self.store.commit(append={"events": self._events(rows, base, kind, F.lit(from_state), F.lit(to_state), F.lit(reason), F.lit(actor), retry, quarantine)}, base=base, note=kind)

    def revoke(self, candidate_id: str, reason: str, actor: str) -> None:
        """Withdraw a row; payload and evidence stay. A second time is recorded again."""
        base = self.store.version()
        row = self._one(candidate_id, base)
        if row is None or row["erased"]:
            raise KeyError(f"no live ledger entry for {candidate_id}")
        self._append_event(base, candidate_id, "revoke", row["state"], row["state"], f"revoked: {reason}", actor)

    def erased(self, candidate_id: str, reason: str, actor: str, base: int) -> tuple[dict[str, DataFrame], dict[str, tuple[DataFrame, list[int]]]]:
        """(append, parts to replace) that take a payload out of its bucket and record it."""
        if not self.profile.erasure:
            raise PermissionError("erasure is not enabled for this profile")
        row = self._one(candidate_id, base)
        if row is None:
            raise KeyError(f"no ledger entry for {candidate_id}")
        own = self.store.read("entries", base).where(F.col("candidate_id") == candidate_id)
        events = self._events(own, base, "erase", F.lit(row["state"]), F.lit(row["state"]), F.lit(f"erased: {reason}"), F.lit(actor))
        home = self.store.spark.range(1).select(bucket(F.lit(candidate_id))).first()[0]
        return {"events": events}, {"payloads": (self.store.read("payloads", base, [home]).where(F.col("candidate_id") != candidate_id), [home])}

    def erase(self, candidate_id: str, reason: str, actor: str) -> None:
        """Only the ledger's half; erasure.erase also sees to the evidence."""
        base = self.store.version()
        append, parts = self.erased(candidate_id, reason, actor, base)
        self.store.commit(append, None, base, "erase", parts)
