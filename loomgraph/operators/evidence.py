"""Evidence, who cites it, and erasure that follows the citations."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.errors import EvidenceMissing
from loomgraph.functions import identity
from loomgraph.operators.ledger import Ledger
from loomgraph.sources.store import Store

SPAN = "struct<start:int,end:int,quote:string>"
PROVENANCE = "struct<source:string,source_ref:string,actor:string,model:string,model_version:string,prompt_version:string>"
SCHEMAS = {
    "evidence": f"evidence_id string, source_type string, source_locator string, observed_at timestamp, availability string, absence_reason string, payload_hash string, content string, error string, span {SPAN}, provenance {PROVENANCE}, redacted_at timestamp, redaction_reason string",
    "evidence_refs": "subject_id string, evidence_id string, relationship string",
}
RELATIONSHIPS = ("SUPPORTS", "CONTRADICTS", "DERIVED_FROM", "CONTEXTUALIZES")
#: Inline text is kept up to so many characters; the hash covers all of it.
INLINE = 4000


def content_digest(column: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(column, 256))


def provenance(source: Column, source_ref: Column, actor: Column, model: Column | None = None, model_version: Column | None = None, prompt_version: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        source.alias("source"), source_ref.alias("source_ref"), actor.alias("actor"), (none if model is None else model).alias("model"), (none if model_version is None else model_version).alias("model_version"),
        (none if prompt_version is None else prompt_version).alias("prompt_version"),
    )


def row(availability: str, **columns: Column) -> list[Column]:
    """Columns of an evidence row: PRESENT has a hash or content, ABSENT a reason, ERROR an error."""
    wanted = {f.name: f.dataType for f in _fields("evidence")}
    columns["availability"] = F.lit(availability)
    return [columns.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in wanted.items()]


def _fields(table: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(SCHEMAS[table]).fields


def malformed(frame: DataFrame) -> Column:
    """What a row's shape violates, or NULL."""
    held = F.col("payload_hash").isNotNull() | F.col("content").isNotNull() | F.col("span.quote").isNotNull()
    return (
        F.when((F.col("availability") == "PRESENT") & ~held, "present evidence holds a hash or content")
        .when((F.col("availability") == "ABSENT") & (F.col("absence_reason").isNull() | held), "absent evidence has a reason and nothing else")
        .when((F.col("availability") == "ERROR") & F.col("error").isNull(), "failed evidence names its error")
        .when(F.col("span.start") > F.col("span.end"), "a span starts before it ends")
    )


def upsert(stored: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """Rows by id, the last written wins, except that a redacted row stays as it is. Of new rows that share an id the one with the greatest order is the last.

    The winner is found by an aggregate that combines before the shuffle, so an
    id that is written again and again sends a row a task.
    """
    names = stored.columns
    place = F.col(order).cast("long") if order else F.lit(0).cast("long")
    both = stored.select(*names, F.lit(0).alias("__new"), F.lit(0).cast("long").alias("__place")).unionByName(new.select(*names, F.lit(1).alias("__new"), place.alias("__place")))
    rank = F.struct(F.col("redacted_at").isNotNull(), "__new", "__place", F.xxhash64("payload_hash", "observed_at"))
    return both.groupBy("evidence_id").agg(F.max_by(F.struct(*names), rank).alias("r")).select("r.*")


def add_refs(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The citations of new that aren't stored yet, each once."""
    return new.select("subject_id", "evidence_id", "relationship").distinct().join(stored, ["subject_id", "evidence_id", "relationship"], "left_anti")


def subjects(refs: DataFrame, ids: DataFrame, relationship: str | None = None) -> DataFrame:
    """(evidence_id, subject_id) of whoever cites the ids of a frame."""
    own = refs if relationship is None else refs.where(F.col("relationship") == relationship)
    return own.join(ids.select("evidence_id").distinct(), "evidence_id", "left_semi").select("evidence_id", "subject_id").distinct()


def orphans(refs: DataFrame, erased: DataFrame) -> DataFrame:
    """(evidence_id) that the subjects of erased cite and nobody else does."""
    gone = refs.join(erased.select("subject_id").distinct(), "subject_id", "left_semi").select("evidence_id").distinct()
    kept = refs.join(erased.select("subject_id").distinct(), "subject_id", "left_anti").select("evidence_id").distinct()
    return gone.join(kept, "evidence_id", "left_anti")


def redacted(evidence: DataFrame, ids: DataFrame, reason: str | None, at: datetime) -> DataFrame:
    """All rows; those named lose content and quote, keep offsets and a hash, and are marked. Only PRESENT rows with text change."""
    named = ids.select("evidence_id").distinct().withColumn("__named", F.lit(True))
    inline = F.coalesce("content", "span.quote")
    hit = F.coalesce(F.col("__named") & (F.col("availability") == "PRESENT") & inline.isNotNull(), F.lit(False))
    blank = F.when(F.col("span").isNotNull(), F.struct(F.col("span.start").alias("start"), F.col("span.end").alias("end"), F.lit(None).cast("string").alias("quote")))
    marked = evidence.join(named, "evidence_id", "left").withColumn("__hit", hit)
    return marked.withColumns(
        {
            "payload_hash": F.when(F.col("__hit"), F.coalesce("payload_hash", content_digest(inline))).otherwise(F.col("payload_hash")),
            "content": F.when(~F.col("__hit"), F.col("content")),
            "span": F.when(F.col("__hit"), blank).otherwise(F.col("span")),
            "redacted_at": F.when(F.col("__hit"), F.lit(at).cast("timestamp")).otherwise(F.col("redacted_at")),
            "redaction_reason": F.when(F.col("__hit"), F.lit(reason).cast("string")).otherwise(F.col("redaction_reason")),
        }
    ).drop("__named")


class EvidenceStore:
    """Evidence in a folder, or in a Store that it shares with a ledger."""

    def __init__(self, spark: SparkSession, folder: str | None = None, store: Store | None = None) -> None:
        self.store = store or Store(spark, folder, SCHEMAS)
        self.store.schemas |= SCHEMAS

    def rows(self, version: int | None = None) -> DataFrame:
        return self.store.read("evidence", version)

    def refs(self, version: int | None = None) -> DataFrame:
        return self.store.read("evidence_refs", version)

    def put(self, rows: DataFrame, refs: DataFrame | None = None, order: str | None = None) -> None:
        """Upsert rows, and add citations, in one commit. order names a column that says which of several rows of one id is the last; without it an id may come once."""
        base = self.store.version()
        if order is None:
            again = rows.groupBy("evidence_id").count().where("count > 1").first()
            if again:
                raise ValueError(f"{again[0]} comes more than once, and nothing says in which order")
        bad = rows.where(malformed(rows).isNotNull()).select("evidence_id", malformed(rows)).first()
        if bad:
            raise ValueError(f"{bad[0]}: {bad[1]}")
        append = {"evidence_refs": add_refs(self.refs(base), refs)} if refs is not None else {}
        self.store.commit(append, {"evidence": upsert(self.rows(base), rows, order)}, base, "put")

    def cite(self, refs: DataFrame) -> None:
        base = self.store.version()
        self.store.commit({"evidence_refs": add_refs(self.refs(base), refs)}, None, base, "cite")

    def refs_for(self, ids: DataFrame, relationship: str | None = None) -> DataFrame:
        own = self.refs() if relationship is None else self.refs().where(F.col("relationship") == relationship)
        return own.join(ids.select("subject_id").distinct(), "subject_id", "left_semi")

    def resolve(self, ids: DataFrame, relationship: str | None = None) -> DataFrame:
        """The evidence that subjects cite. A citation without evidence raises EvidenceMissing."""
        refs = self.refs_for(ids, relationship)
        lost = refs.join(self.rows(), "evidence_id", "left_anti").first()
        if lost:
            raise EvidenceMissing(f"evidence {lost['evidence_id']} that {lost['subject_id']} cites is not stored")
        return refs.join(self.rows(), "evidence_id")

    def redaction(self, evidence_id: str) -> tuple | None:
        found = self.rows().where(F.col("evidence_id") == evidence_id).select("redacted_at", "redaction_reason").first()
        return tuple(found) if found else None


def _cascade(evidence: EvidenceStore, candidate_id: str, base: int, reason: str, at: datetime) -> tuple[dict[str, DataFrame], DataFrame, DataFrame, DataFrame]:
    """(tables to replace, cited, orphaned, rows that lose text)."""
    spark = evidence.store.spark
    gone = spark.createDataFrame([(candidate_id,)], "subject_id string")
    refs, rows = evidence.refs(base), evidence.rows(base)
    cited = refs.join(F.broadcast(gone), "subject_id", "left_semi").select("evidence_id").distinct()
    lost = orphans(refs, gone)
    changed = redacted(rows, lost, reason, at)
    tables = {"evidence_refs": refs.join(F.broadcast(gone), "subject_id", "left_anti"), "evidence": changed}
    return tables, cited, lost, changed.where("__hit").select("evidence_id", "payload_hash")


def erase(ledger: Ledger, evidence: EvidenceStore, candidate_id: str, reason: str, actor: str) -> dict:
    """Erase a candidate and what only it cites. In a shared Store it is one commit; in two, evidence goes first, and asking again finishes the rest.

    A report with removed, redacted and preserved evidence ids, and whether it was done before.
    """
    if not ledger.profile.erasure:
        raise PermissionError("erasure is not enabled for this profile")
    row = ledger._one(candidate_id)
    if row is None:
        raise KeyError(f"no ledger entry for {candidate_id}")
    if row["erased"]:
        return {"candidate_id": candidate_id, "removed": [], "redacted": [], "preserved": [], "already_erased": True}
    at = datetime.now(UTC)
    shared = ledger.store is evidence.store
    base, other = ledger.store.version(), evidence.store.version()
    tables, cited, lost, changed = _cascade(evidence, candidate_id, other, reason, at)
    removed, gone = sorted(r[0] for r in cited.collect()), {r[0] for r in lost.collect()}  # one candidate's citations
    texts = {r["evidence_id"]: r["payload_hash"] for r in changed.collect()}
    append, parts = ledger.erased(candidate_id, reason, actor, base)
    if texts:
        audit = ledger.store.spark.createDataFrame([(candidate_id, h, e) for e, h in sorted(texts.items())], "candidate_id string, payload_hash string, evidence_id string")
        detail = F.to_json(F.struct("evidence_id", F.lit(reason).alias("reason"), F.lit(actor).alias("actor")))
        append["events"] = append["events"].unionByName(ledger._events(audit, base, "redact", F.lit(None), F.lit(None), F.lit(reason), F.lit(actor), detail=detail))
    if shared:
        ledger.store.commit(append, tables, base, "erase", parts)
    else:
        evidence.store.commit(None, tables, other, "erase")
        ledger.store.commit(append, None, base, "erase", parts)
    return {"candidate_id": candidate_id, "removed": removed, "redacted": [e for e in removed if e in texts], "preserved": [e for e in removed if e not in gone], "already_erased": False}


def revoke(ledger: Ledger, candidate_id: str, reason: str, actor: str) -> None:
    """Withdraw a candidate; its evidence stays cited and readable."""
    ledger.revoke(candidate_id, reason, actor)


# ---------------------------------------------------------------- evidence of rows


def row_evidence(records: DataFrame, version: str, source_type: str, locator: str, observed_at: datetime, actor: str = "loomgraph.structured") -> DataFrame:
    """One PRESENT row a record, by hash only, with its coord for linking."""
    fragment = F.coalesce("coord.fragment", F.lit(""))
    made = row(
        "PRESENT",
        evidence_id=F.concat(F.lit("ev_"), identity.stable_suffix(F.col("coord.source_type"), F.col("coord.locator"), fragment, F.lit(version))),
        source_type=F.col("coord.source_type"), source_locator=F.col("coord.locator"), observed_at=F.lit(observed_at), payload_hash=identity.content_hash(F.to_json("data")),
        provenance=provenance(F.lit(source_type), F.lit(locator), F.lit(actor)),
    )
    return records.select("coord", *made)


def link(candidates: DataFrame, rows: DataFrame, relationship: str = "DERIVED_FROM") -> DataFrame:
    """(subject_id, evidence_id, relationship): candidates to the evidence of their row, where type, locator and fragment agree, NULL fragments too."""
    keys = lambda c: (F.col(f"{c}.source_type"), F.col(f"{c}.locator"))
    left = candidates.select("candidate_id", *(k.alias(n) for k, n in zip(keys("coord"), ("t", "l"), strict=True)), F.col("coord.fragment").alias("f"))
    right = rows.select("evidence_id", *(k.alias(n) for k, n in zip(keys("coord"), ("t2", "l2"), strict=True)), F.col("coord.fragment").alias("f2"))
    met = left.join(right, (F.col("t") == F.col("t2")) & (F.col("l") == F.col("l2")) & F.col("f").eqNullSafe(F.col("f2")))
    return met.select(F.col("candidate_id").alias("subject_id"), "evidence_id", F.lit(relationship).alias("relationship"))
