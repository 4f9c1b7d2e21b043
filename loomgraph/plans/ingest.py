"""Ingestion end to end: records, values, verdicts, candidates, admission, submission.

plan() and run() walk the same frames; run() alone hands candidates to the sink.
Everything before that is lazy, and a report is one aggregate over them.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.errors import SourceError
from loomgraph.functions import identity
from loomgraph.operators import admission, candidates, validate
from loomgraph.operators.candidates import Scoring
from loomgraph.operators.ledger import CANDIDATE, COLUMNS, Ledger, Sink, duplicates
from loomgraph.operators.normalize import Field, normalize, passthrough
from loomgraph.operators.validate import Ontology
from loomgraph.sources.records import Records, dealt


@dataclass
class Report:
    """What a run read, built, dropped and submitted. NULL counts weren't looked at."""

    graph_id: str
    job_id: str
    run_id: str
    mode: str
    source_type: str
    locator: str
    records_read: int = 0
    records_valid: int = 0
    records_invalid: int = 0
    candidates_built: int = 0
    candidates_suppressed: int = 0
    candidates_rejected: int = 0
    candidates_submitted: int = 0
    received: int = 0
    duplicates: int = 0
    invalid: int = 0
    ledger_duplicates: int | None = None
    kind_counts: dict[str, int] = field(default_factory=dict)
    coverage: list[dict] = field(default_factory=list)
    coverage_ratio: float | None = None
    incomplete: bool = False
    failures: list[str] = field(default_factory=list)
    failure_count: int = 0
    warnings: int = 0
    elapsed: float = 0.0

    @property
    def succeeded(self) -> bool:
        return not self.incomplete and not (self.records_invalid or self.candidates_rejected or self.invalid)

    def fingerprint(self) -> dict:
        """Everything but times and ids: equal for replays of equal data."""
        return {k: v for k, v in vars(self).items() if k not in ("elapsed", "job_id", "run_id", "coverage", "source_type", "locator", "warnings", "coverage_ratio", "ledger_duplicates", "failure_count")}

    def summary(self) -> str:
        parts = [self.mode, *(f"{n}={getattr(self, a)}" for n, a in (("read", "records_read"), ("valid", "records_valid"), ("invalid", "records_invalid"), ("built", "candidates_built")))]
        parts += [f"{n}={v}" for n, v in (("suppressed", self.candidates_suppressed), ("rejected", self.candidates_rejected)) if v]
        if self.mode == "execute":
            parts += [f"received={self.received}", *(f"{n}={v}" for n, v in (("duplicates", self.duplicates), ("sink_invalid", self.invalid)) if v)]
        else:
            parts.append(f"would_submit={sum(self.kind_counts.values())}")
        parts += [f"warnings={self.warnings}"] * bool(self.warnings) + ["INCOMPLETE"] * self.incomplete + [f"{self.elapsed:.3f}s"]
        return " ".join(parts)


@dataclass
class Pipeline:
    """How a source becomes candidates of a graph."""

    graph_id: str
    source: Callable[[], Records] | Records
    builder: object
    scoring: Scoring
    fields: Sequence[Field] | None = None
    ontology: Ontology | None = None
    strict: bool = True
    producer: str = "loomgraph"
    validators: Sequence[validate.Validator] = ()
    run_id: str | None = None
    job_id: str | None = None
    clock: Callable[[], datetime] = lambda: datetime.now(UTC)
    random_ids: bool = False
    _held: list = field(default_factory=list, repr=False)

    def release(self) -> None:
        """Give back what the last plan keeps in memory; its candidates can still be read, and are then worked out again."""
        while self._held:
            self._held.pop().unpersist()

    def records(self) -> Records:
        return self.source() if callable(self.source) else self.source

    def judged(self, records: DataFrame) -> DataFrame:
        """Normalized records with verdicts and the array of what they would become."""
        values = normalize(records, self.fields) if self.fields is not None else passthrough(records)
        checks = [validate.by_issues, *self.validators, validate.required_values(self.builder.required)]
        frame = validate.verdicts(values, checks)
        frame = candidates.construction(frame, self.builder)
        broken = F.col("valid") & F.col("construction").isNotNull()
        return frame.withColumns(
            {
                "made": F.when(F.col("valid") & F.col("construction").isNull(), F.col("made")),
                "reasons": F.when(broken, F.array(F.col("construction"))).otherwise(F.col("reasons")),
                "failure_kind": F.when(broken, validate.BAD_DATA).otherwise(F.col("failure_kind")),
                "valid": F.col("valid") & F.col("construction").isNull(),
            }
        ).drop("construction")

    def built(self, judged: DataFrame) -> DataFrame:
        """A row a candidate with its disposition."""
        gated = validate.gate(candidates.explode(judged.where("valid")), self.ontology, self.strict)
        return admission.disposition(gated, F.col("ok"))

    def stamped(self, built: DataFrame, run_id: str, at: datetime) -> DataFrame:
        """Admitted candidates as they are submitted; ids are made for these only."""
        graph, run = F.lit(self.graph_id), F.lit(run_id)
        key = F.col("semantic_key")
        own = F.concat(F.lit("cand_"), F.replace(F.uuid(), F.lit("-"), F.lit(""))) if self.random_ids else identity.candidate_id(graph, F.col("kind"), key)
        version = self.ontology.version if self.ontology else "unversioned"
        wide = built.where("disposition = 'admitted'").withColumns(
            {
                "candidate_id": own, "graph_id": graph, "content_hash": candidates.content_hash(), "producer": F.lit(self.producer), "producer_run_id": run, "ontology_version": F.lit(version),
                "trace_id": identity.trace_id(run, graph, F.col("kind"), key), "created_at": F.lit(at).cast("timestamp"), "scores": self.scoring.column(), "evidence_refs": F.array().cast("array<struct<evidence_id:string,relationship:string>>"),
                **{n: F.lit(None).cast("string") for n in ("model_id", "model_version", "extractor_version", "prompt_version", "passage")},
            }
        )
        return wide.select(*(F.col(name).cast(kind) for name, kind in COLUMNS.items()))

    def plan(self, ledger: Ledger | None = None) -> tuple[DataFrame, Report]:
        """The candidates that run() would submit, and the report. Nothing is written."""
        return self._execute(None, ledger)

    def run(self, sink: Sink) -> tuple[DataFrame, Report]:
        """Submit: outcomes and the report."""
        return self._execute(sink, None)

    def _execute(self, sink: Sink | None, ledger: Ledger | None) -> tuple[DataFrame, Report]:
        began, at = time.monotonic(), self.clock()
        run_id, job_id = self.run_id or f"run_{identity.random_suffix()}", self.job_id or f"job_{identity.random_suffix()}"
        mode = "execute" if sink else "dry_run"
        try:
            records = self.records()
        except SourceError as bad:
            report = Report(self.graph_id, job_id, run_id, mode, "unknown", "unknown", incomplete=True, failures=[f"source read failed: {bad}"])
            spark = (sink or ledger).spark if sink or ledger else None
            return (spark.createDataFrame([], CANDIDATE) if spark else None), report
        report = Report(self.graph_id, job_id, run_id, mode, records.source_type, records.locator)
        self.release()
        # only what is read again is kept, in partitions of bounded size
        judged = self.judged(dealt(records.frame)).select("rec_idx", "coord", "made", "valid", "warnings").persist()
        built = self.built(judged).persist()
        self._held += [judged, built]
        try:
            planned = self.stamped(built, run_id, at)
            if sink:
                outcome = sink.submit(planned)
                for status, n in outcome.groupBy("status").count().collect():
                    setattr(report, {"RECEIVED": "received", "DUPLICATE": "duplicates", "INVALID": "invalid"}[status], n)
                report.candidates_submitted = report.received
            else:
                outcome = planned
                if ledger:
                    report.ledger_duplicates = duplicates(planned, ledger.store.read("entries"), ledger.live().where(F.col("graph_id") == self.graph_id)).count()
            self._count(report, judged, built)
        finally:
            if sink:  # outcomes are read from what the ledger staged
                self.release()
            report.elapsed = time.monotonic() - began
        return outcome, report

    def _count(self, report: Report, judged: DataFrame, built: DataFrame) -> None:
        row = judged.agg(F.count("*"), F.count_if("valid"), F.sum(F.size("warnings"))).first()
        report.records_read, report.records_valid, report.warnings = row[0], row[1], row[2] or 0
        report.records_invalid = report.records_read - report.records_valid
        for (disposition,), n in ((tuple(r[:1]), r[1]) for r in built.groupBy("disposition").count().collect()):
            report.candidates_built += n
            if disposition != "admitted":
                setattr(report, f"candidates_{disposition}", n)
        admitted = built.where("disposition = 'admitted'")
        report.kind_counts = dict(sorted((r[0], r[1]) for r in admitted.groupBy("kind").count().collect()))
        usage = validate.term_usage(admitted)
        report.coverage = [r.asDict() for r in validate.coverage(usage, self.ontology).orderBy("category", "term").collect()]
        report.coverage_ratio = usage.agg(validate.coverage_ratio(usage, self.ontology)).first()[0]

    def failures(self) -> DataFrame:
        """Rejected records with their reasons."""
        return self.judged(self.records().frame).where("not valid").select("rec_idx", "coord", "failure_kind", "reasons", "warnings")

    def warnings(self) -> DataFrame:
        """(code, message, record_index, locator), a row a warning."""
        judged = self.judged(self.records().frame)
        return judged.select(F.lit("record_warning").alias("code"), F.explode("warnings").alias("message"), F.col("rec_idx").alias("record_index"), F.col("coord.locator").alias("locator"))


@dataclass
class TableSync:
    """A table as a source: keys, fields and a builder make a pipeline over a pinned snapshot."""

    graph_id: str
    table: DataFrame
    keys: Sequence[str]
    locator: str
    builder: object
    scoring: Scoring
    fields: Sequence[Field] | None = None
    ontology: Ontology | None = None
    version: str | None = None

    def pipeline(self, **options) -> Pipeline:
        from loomgraph.sources.records import TableSnapshot

        snapshot = TableSnapshot(self.table, self.keys, self.locator, version=self.version)
        opened: list[Records] = []

        def source() -> Records:  # opened once: a dry run and a run see one snapshot
            if not opened:
                opened.append(snapshot.open())
            return opened[0]

        return Pipeline(self.graph_id, source, self.builder, self.scoring, fields=self.fields, ontology=self.ontology, **options)
