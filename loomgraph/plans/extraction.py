"""Extraction end to end: documents, chunks, completions, items, candidates with evidence.

Each extractor's chunks are asked for, parsed and built in one pass. Answers are
written to a folder before anything is read from them: a model asked twice may
answer otherwise, so a lost executor must not ask again. What fails
for one (chunk, extractor) is a row of failures; its siblings go on. Order is
(document, chunk, extractor, item, part), so the first of a key is the same in
every run. Evidence belongs to admitted candidates and is written by run() only.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.errors import ConfigurationError
from loomgraph.functions import identity
from loomgraph.operators import admission, candidates, completions, evidence, validate
from loomgraph.operators.candidates import Scoring
from loomgraph.operators.ledger import COLUMNS, Ledger
from loomgraph.operators.normalize import Field, normalize
from loomgraph.operators.validate import Ontology
from loomgraph.plans.ingest import Report
from loomgraph.sources.records import issues_of, sequential

#: Characters of a chunk that a candidate carries as its passage.
PASSAGE = 2000
#: Failures that a report quotes. It counts all, and DocumentPipeline.failed is the frame of all.
FAILURES_SHOWN = 1000


@dataclass(frozen=True)
class Extractor:
    """A prompt, a model, the fields its items have and the builder for them."""

    extractor_id: str
    template: str
    fields: Sequence[Field]
    builder: object
    scoring: Scoring
    system: str = ""
    model_id: str = "model"
    model_version: str = "1"
    extractor_version: str = "1"
    prompt_version: str = "1"

    def __post_init__(self) -> None:
        if "{text}" not in self.template:
            raise ConfigurationError("a prompt template holds {text}")

    def producer(self, base: str) -> str:
        return f"{base}:{self.extractor_id}@{self.extractor_version}"


@dataclass
class DocumentPipeline:
    """documents: a frame with doc_id and text as chunking.documents gives it. answer: requests to frame with response and error."""

    graph_id: str
    documents: DataFrame
    chunker: Callable[[DataFrame], DataFrame]
    extractors: Sequence[Extractor]
    answer: Callable[[DataFrame], DataFrame]
    deterministic: bool = False
    ontology: Ontology | None = None
    strict: bool = True
    producer: str = "loomgraph.extraction"
    artifacts: bool = False
    run_id: str | None = None
    clock: Callable[[], datetime] = lambda: datetime.now(UTC)
    #: Where answers are kept: by default in spark.checkpoint.dir; without either they are only persisted.
    folder: str | None = None
    #: (doc_id, fragment, extractor, message) of whatever failed in the last plan or run.
    failed: DataFrame | None = field(default=None, repr=False)
    _docs: DataFrame | None = field(default=None, repr=False)
    _held: list = field(default_factory=list, repr=False)

    def __post_init__(self) -> None:
        if not self.extractors:
            raise ConfigurationError("at least one extractor is needed")

    def docs(self) -> DataFrame:
        if self._docs is None:
            self._docs = sequential(self.documents, "doc_ord")
        return self._docs

    def chunks(self) -> DataFrame:
        """Chunks with the document's place in the stream, doc_ord, which the chunkers pass on: texts don't move, and ids may be missing or shared."""
        chunks = self.chunker(self.docs())
        if "doc_ord" not in chunks.columns:
            raise ConfigurationError("a chunker passes doc_ord on")
        return chunks

    def parsed(self) -> DataFrame:
        """A row a (chunk, extractor): error, or items."""
        out = None
        chunks = self.chunks()
        for place, e in enumerate(self.extractors):
            asked = completions.requests(chunks, e.template, e.system).withColumns({"extractor": F.lit(e.extractor_id), "ext_ord": F.lit(place)})
            got = self._settled(self.answer(asked))
            rows = completions.parse(got).drop("prompt", "system")
            out = rows if out is None else out.unionByName(rows)
        return out

    def _settled(self, answered: DataFrame) -> DataFrame:
        """Answers that stay as they are, whoever is lost."""
        spark = answered.sparkSession
        base = self.folder or spark.conf.get("spark.checkpoint.dir", None)
        if self.deterministic or not base:
            self._held.append(answered.persist())
            return answered
        target = f"{base.rstrip('/')}/answers-{identity.random_suffix()}"
        answered.write.parquet(target)
        return spark.read.schema(answered.schema).parquet(target)

    def built(self, parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(candidates of all extractors with their chunk, failures): an item that can't be built fails its (chunk, extractor)."""
        rows = failures = None
        for place, e in enumerate(self.extractors):
            own = parsed.where(F.col("ext_ord") == place)
            items = own.where("error is null").select("*", F.posexplode("items").alias("item_ord", "item"))
            coord = F.struct(F.col("source_type"), F.col("locator"), F.col("fragment"), F.lit(None).cast("string").alias("source_version"))
            keep = F.struct("doc_id", "doc_ord", "index", "ext_ord", "item_ord", "source_type", "locator", "fragment", "start", "end", "text", "item")
            records = items.select(F.col("item_ord").cast("long").alias("rec_idx"), coord.alias("coord"), F.col("item.values").alias("data"), issues_of().alias("issues"), keep.alias("chunk"))
            values = normalize(records, e.fields, ("chunk",))
            judged = candidates.construction(validate.verdicts(values, [validate.by_issues, validate.required_values(e.builder.required)]), e.builder)
            why = F.coalesce(F.get("reasons", F.lit(0)), F.col("construction"))
            judged = judged.withColumn("why", why)
            bad = judged.where("why is not null").groupBy(F.col("chunk.doc_ord").alias("doc_ord"), F.col("chunk.fragment").alias("fragment")).agg(F.first("chunk.doc_id").alias("doc_id"), F.min_by("why", F.col("chunk.item_ord")).alias("why"))
            ok = judged.withColumns({"doc_ord": F.col("chunk.doc_ord"), "fragment": F.col("chunk.fragment")}).join(bad.select("doc_ord", "fragment"), ["doc_ord", "fragment"], "left_anti")
            made = ok.select("chunk", "coord", F.posexplode_outer("made").alias("pos", "c")).where("c is not null").select("chunk", "coord", "pos", "c.*", F.lit(place).alias("ext_ord"))
            lost = own.where("error is not null").select("doc_id", "fragment", "extractor", F.col("error").alias("why")).unionByName(bad.select("doc_id", "fragment", F.lit(e.extractor_id).alias("extractor"), "why"))
            rows, failures = (made, lost) if rows is None else (rows.unionByName(made), failures.unionByName(lost))
        message = F.concat(F.lit("extractor="), F.col("extractor"), F.lit(" doc="), F.coalesce("doc_id", F.lit("NULL")), F.lit(" chunk="), F.col("fragment"), F.lit(": "), F.col("why"))
        return rows, failures.select("doc_id", "fragment", "extractor", message.alias("message"))

    def admitted(self, built: DataFrame) -> DataFrame:
        """Built candidates, and artifacts before their document's facts, with disposition."""
        order = ("doc_ord", "a", "index", "ext_ord", "item_ord", "pos")
        facts = built.withColumns({"doc_ord": F.col("chunk.doc_ord"), "a": F.lit(1), "index": F.col("chunk.index"), "item_ord": F.col("chunk.item_ord")})
        if self.artifacts:
            facts = facts.unionByName(self._artifacts(), allowMissingColumns=True)
        gated = validate.gate(facts, self.ontology, self.strict)
        return admission.disposition(gated, F.col("ok"), order)

    def _artifacts(self) -> DataFrame:
        """A source_document for each document that has a chunk."""
        docs = self.docs().join(self.chunks().select("doc_ord").distinct(), "doc_ord", "left_semi")
        digest = identity.content_hash(F.col("text"))
        made = candidates.body(
            kind=F.lit("artifact"), semantic_key=F.concat(F.lit("artifact/source_document/"), F.col("doc_id")), artifact_type=F.lit("source_document"), artifact_hash=digest, source_uri=F.col("locator"), media_type=F.lit("text/plain")
        )
        coord = F.struct(F.col("source_type"), F.col("locator"), F.lit("document").alias("fragment"), F.lit(None).cast("string").alias("source_version"))
        zero = lambda n: F.lit(0).alias(n)
        return docs.select(made.alias("c"), coord.alias("coord"), zero("pos"), F.lit(-1).alias("ext_ord"), "doc_ord", zero("a"), zero("index"), zero("item_ord"), "doc_id").select("c.*", "coord", "pos", "ext_ord", "doc_ord", "a", "index", "item_ord")

    # ------------------------------------------------------------ ids and evidence

    def _per_extractor(self, name: str) -> Column:
        out = F.lit(None).cast("string")
        for place, e in enumerate(self.extractors):
            out = F.when(F.col("ext_ord") == place, getattr(e, name) if name != "producer" else e.producer(self.producer)).otherwise(out)
        return out

    def stamped(self, admitted: DataFrame, run_id: str, at: datetime) -> DataFrame:
        """Admitted candidates with ids, citations (chunk and verified quote), and the columns of their evidence."""
        graph, run, key = F.lit(self.graph_id), F.lit(run_id), F.col("semantic_key")
        rows = admitted.where("disposition = 'admitted'").withColumns({n: self._per_extractor(n) for n in ("extractor_id", "model_id", "model_version", "extractor_version", "prompt_version")})
        versions = [F.col(n) for n in ("extractor_id", "model_id", "model_version", "prompt_version")]
        chunk = lambda n: F.col(f"chunk.{n}")
        fact = F.col("kind") != "artifact"
        chunk_id = F.concat(F.lit("ev_"), identity.stable_suffix(chunk("doc_id"), chunk("fragment"), *versions))
        quote = chunk("item.quote").isNotNull()
        quote_id = F.concat(F.lit("ev_"), identity.stable_suffix(chunk("doc_id"), chunk("fragment"), chunk("item.quote_start").cast("string"), chunk("item.quote_end").cast("string"), *versions))
        document_id = F.concat(F.lit("ev_"), identity.stable_suffix(F.regexp_replace("semantic_key", "^artifact/source_document/", ""), F.lit("document"), F.col("artifact_hash")))
        rows = rows.withColumns({"chunk_evidence": F.when(fact, chunk_id), "quote_evidence": F.when(fact & quote, quote_id), "document_evidence": F.when(~fact, document_id)})
        ids = F.array_compact(F.array("quote_evidence", "chunk_evidence", "document_evidence"))
        refs = F.transform(ids, lambda i: F.struct(i.alias("evidence_id"), F.lit("DERIVED_FROM").alias("relationship")))
        scores = F.lit(None).cast(candidates.SCORES)
        for place, e in enumerate(self.extractors):
            own = e.scoring.column().withField("extraction_confidence", F.coalesce(chunk("item.confidence"), F.lit(e.scoring.extraction_confidence)))
            scores = F.when(F.col("ext_ord") == place, own).otherwise(scores)
        scores = F.when(fact, scores).otherwise(Scoring(1.0).column())
        base = F.when(fact, self._per_extractor("producer")).otherwise(F.lit(self.producer))
        return rows.withColumns(
            {
                "candidate_id": identity.candidate_id(graph, F.col("kind"), key), "graph_id": graph, "content_hash": candidates.content_hash(), "producer": base, "producer_run_id": run,
                "ontology_version": F.lit(self.ontology.version if self.ontology else "unversioned"), "trace_id": identity.trace_id(run, graph, F.col("kind"), key), "created_at": F.lit(at).cast("timestamp"), "scores": scores,
                "evidence_refs": refs, "passage": F.when(fact, F.left(chunk("text"), F.lit(PASSAGE))), "rec_idx": F.col("doc_ord"), "pos": F.col("pos"),
            }
        )

    def evidence(self, stamped: DataFrame, at: datetime) -> tuple[DataFrame, DataFrame]:
        """(evidence rows, citations) of admitted candidates."""
        chunk = lambda n: F.col(f"chunk.{n}")
        made_by = evidence.provenance(chunk("locator"), chunk("fragment"), F.col("extractor_id"), F.col("model_id"), F.col("model_version"), F.col("prompt_version"))
        place = F.concat(chunk("locator"), F.lit("#"), chunk("fragment"))
        span = lambda a, b, q: F.struct(a.alias("start"), b.alias("end"), q.alias("quote"))
        none = F.lit(None).cast("string")
        common = {"observed_at": F.lit(at)}
        chunks = stamped.where("chunk_evidence is not null").select(*evidence.row("PRESENT", evidence_id=F.col("chunk_evidence"), source_type=chunk("source_type"), source_locator=place, content=F.left(chunk("text"), F.lit(evidence.INLINE)), payload_hash=identity.content_hash(chunk("text")), span=span(chunk("start"), chunk("end"), none), provenance=made_by, **common))
        quote = chunk("item.quote")
        quotes = stamped.where("quote_evidence is not null").select(*evidence.row("PRESENT", evidence_id=F.col("quote_evidence"), source_type=chunk("source_type"), source_locator=place, content=F.left(quote, F.lit(evidence.INLINE)), span=span(chunk("item.quote_start"), chunk("item.quote_end"), quote), provenance=made_by, **common))
        out = chunks.unionByName(quotes)
        if self.artifacts:
            whole = self.docs().select(F.concat(F.lit("artifact/source_document/"), F.col("doc_id")).alias("semantic_key"), F.col("text").alias("whole"))
            docs = stamped.where("document_evidence is not null").join(whole, "semantic_key")
            out = out.unionByName(docs.select(*evidence.row("PRESENT", evidence_id=F.col("document_evidence"), source_type=F.col("coord.source_type"), source_locator=F.col("source_uri"), content=F.left("whole", F.lit(evidence.INLINE)), payload_hash=F.col("artifact_hash"), provenance=evidence.provenance(F.col("source_uri"), none, F.lit(self.producer)), **common)))
        refs = stamped.select(F.col("candidate_id").alias("subject_id"), F.explode("evidence_refs").alias("r")).select("subject_id", "r.evidence_id", "r.relationship")
        return out.dropDuplicates(["evidence_id"]), refs

    # ------------------------------------------------------------ run

    def release(self) -> None:
        """Give back what the last plan or run keeps in memory; its frames can still be read, and are then worked out again."""
        while self._held:
            self._held.pop().unpersist()

    def plan(self, ledger: Ledger | None = None) -> tuple[DataFrame, Report, DataFrame]:
        """(candidates that run would submit, report, warnings)."""
        return self._execute(None, None, ledger)

    def run(self, sink: Ledger, registry: evidence.EvidenceStore) -> tuple[DataFrame, Report, DataFrame]:
        """(outcomes, report, warnings). Evidence is written before the outcomes are known."""
        return self._execute(sink, registry, None)

    def _execute(self, sink, registry, ledger) -> tuple[DataFrame, Report, DataFrame]:
        began, at = time.monotonic(), self.clock()
        run_id = self.run_id or f"run_{identity.random_suffix()}"
        report = Report(self.graph_id, f"job_{identity.random_suffix()}", run_id, "execute" if sink else "dry_run", "document", "documents")
        self.release()
        parsed = self.parsed().persist()
        self._held.append(parsed)
        built, failures = self.built(parsed)
        judged = self.admitted(built).persist()
        self._held.append(judged)
        stamped = self.stamped(judged, run_id, at)
        if sink:  # evidence and candidates are made of the same ids
            self._held.append(stamped.persist())
        planned = stamped.select(*(F.col(name).cast(kind) for name, kind in COLUMNS.items()))
        report.records_read = parsed.select("doc_ord", "fragment").distinct().count()
        self.failed = failures
        report.failure_count = failures.count()
        report.failures = [r["message"] for r in failures.orderBy("doc_id", "fragment", "extractor").limit(FAILURES_SHOWN).collect()]
        report.incomplete = report.failure_count > 0
        warnings = parsed.where("error is null").select("fragment", F.explode(F.flatten(F.transform("items", lambda i: i["warnings"]))).alias("message")).select(F.lit("quote_not_verified").alias("code"), "message", F.col("fragment").alias("locator"))
        if not sink and not self.deterministic:
            said = parsed.sparkSession.createDataFrame([("nondeterministic_plan", "a later run may extract something else", None)], "code string, message string, locator string")
            warnings = warnings.unionByName(said)
        report.warnings = warnings.count()
        for disposition, n in judged.where("kind <> 'artifact'").groupBy("disposition").count().collect():
            report.candidates_built += n
            if disposition != "admitted":
                setattr(report, f"candidates_{disposition}", n)
        report.kind_counts = dict(sorted((r[0], r[1]) for r in judged.where("disposition = 'admitted'").groupBy("kind").count().collect()))
        outcome = planned
        if sink:
            rows, refs = self.evidence(stamped, at)
            registry.put(rows.withColumn("ord", F.lit(0)), refs, order="ord")  # ids are unique already
            outcome = sink.submit(planned)
            for status, n in outcome.groupBy("status").count().collect():
                setattr(report, {"RECEIVED": "received", "DUPLICATE": "duplicates", "INVALID": "invalid"}[status], n)
            report.candidates_submitted = report.received
        elif ledger:  # live keys only: an id that a tombstone holds isn't looked for here
            live = ledger.live().where(F.col("graph_id") == self.graph_id).select("semantic_key").distinct()
            report.ledger_duplicates = planned.join(live, "semantic_key", "left_semi").count()
        report.elapsed = time.monotonic() - began
        return outcome, report, warnings

