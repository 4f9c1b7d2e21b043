"""Record verdicts and the ontology gate, as columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.records import render_issue

BAD_DATA = "BAD_DATA"
UNSUPPORTED_ONTOLOGY = "UNSUPPORTED_ONTOLOGY"

#: A validator gives (failure kind or NULL, reasons, warnings) for a normalized frame.
Validator = Callable[[DataFrame], tuple[Column, Column, Column]]


def _texts(*columns: Column) -> Column:
    return F.array_compact(F.array(*columns)).cast("array<string>") if columns else F.array().cast("array<string>")


def by_issues(frame: DataFrame) -> tuple[Column, Column, Column]:
    """Rejects records with an error issue; warnings are carried along."""
    of = lambda severity: F.transform(F.filter("issues", lambda i: i["severity"] == severity), render_issue)
    return F.when(F.exists("issues", lambda i: i["severity"] == "error"), BAD_DATA), of("error"), of("warning")


def required_values(names: Sequence[str]) -> Validator:
    """Rejects records in which a named value is NULL."""

    def validator(frame: DataFrame) -> tuple[Column, Column, Column]:
        have = set(frame.schema["values"].dataType.fieldNames())
        null = lambda n: F.col("values").getField(n).isNull() if n in have else F.lit(True)
        reasons = _texts(*(F.when(null(n), f"required_value: {n!r} is null") for n in names))
        return F.when(F.size(reasons) > 0, BAD_DATA), reasons, _texts()

    return validator


def verdicts(frame: DataFrame, validators: Sequence[Validator], policy_versions: Sequence[str] = ()) -> DataFrame:
    """The frame with valid, failure_kind, reasons, warnings and policy_version. All validators speak; the first failure names the kind, and nothing is said twice."""
    found = [v(frame) for v in validators]
    kinds = [k for k, _, _ in found]
    failure = F.coalesce(*kinds) if kinds else F.lit(None).cast("string")
    reasons = F.array_distinct(F.concat(_texts(), *(F.when(k.isNotNull(), r).otherwise(_texts()) for k, r, _ in found)))
    warnings = F.array_distinct(F.concat(_texts(), *(w for _, _, w in found)))
    return frame.withColumns({"valid": failure.isNull(), "failure_kind": failure, "reasons": reasons, "warnings": warnings, "policy_version": F.lit("+".join(policy_versions) or "v1")})


# ---------------------------------------------------------------- ontology


@dataclass(frozen=True)
class Ontology:
    """Declared terms. A category that declares nothing constrains nothing."""

    version: str = "unversioned"
    entity_types: frozenset[str] = field(default_factory=frozenset)
    relation_types: frozenset[str] = field(default_factory=frozenset)
    attributes: frozenset[str] = field(default_factory=frozenset)

    @staticmethod
    def of_descriptor(ontology_version: str | None, node_types: Sequence[str], edge_types: Sequence[str]) -> Ontology:
        """A registered graph's terms; it declares no attributes."""
        return Ontology(ontology_version or "unversioned", frozenset(node_types), frozenset(edge_types))

    def categories(self) -> dict[str, frozenset[str]]:
        return {"entity_type": self.entity_types, "relation_type": self.relation_types, "attribute": self.attributes}


#: Which kind of candidate uses which category of term.
TERM_OF_KIND = {"entity": "entity_type", "relation": "relation_type", "attribute_assertion": "attribute"}


def term() -> Column:
    """The term that a candidate uses, NULL for kinds without one."""
    return F.when(F.col("kind") == "entity", F.col("entity_type")).when(F.col("kind") == "relation", F.col("relation_type")).when(F.col("kind") == "attribute_assertion", F.col("attribute"))


def category() -> Column:
    out = F.lit(None).cast("string")
    for kind, name in TERM_OF_KIND.items():
        out = F.when(F.col("kind") == kind, name).otherwise(out)
    return out


def declared(column: Column, terms: frozenset[str]) -> Column:
    return column.isin(*sorted(terms)) if terms else F.lit(True)


def ontology_reasons(ontology: Ontology | None) -> Column:
    """array<string>: what a candidate's term violates."""
    if ontology is None:
        return _texts()
    found = []
    for kind, name in TERM_OF_KIND.items():
        terms = ontology.categories()[name]
        if terms:
            bad = (F.col("kind") == kind) & ~declared(F.col(name), terms)
            found.append(F.when(bad, F.concat(F.lit(f"{name} '"), F.col(name), F.lit("' is not in the ontology"))))
    return _texts(*found)


def gate(candidates: DataFrame, ontology: Ontology | None, strict: bool = True) -> DataFrame:
    """The candidates with ok, rejection (failure kind) and rejection_reasons. Permissive mode admits and leaves the trace to coverage."""
    reasons = ontology_reasons(ontology)
    bad = (F.size(reasons) > 0) & F.lit(strict)
    return candidates.withColumns({"ok": ~bad, "rejection": F.when(bad, UNSUPPORTED_ONTOLOGY), "rejection_reasons": reasons})


def term_usage(candidates: DataFrame) -> DataFrame:
    """(category, term, n) over the candidates given."""
    used = candidates.select(category().alias("category"), term().alias("term"))
    return used.where("category is not null").groupBy("category", "term").agg(F.count("*").alias("n"))


def coverage(usage: DataFrame, ontology: Ontology | None) -> DataFrame:
    """(category, term, n, declared, status): used, unknown, or unused. Unknown only where the category declares anything; unused attributes aren't reported."""
    if ontology is None:
        return usage.withColumns({"declared": F.lit(False), "status": F.lit("used")})
    spark = usage.sparkSession
    rows = [(c, t) for c, terms in ontology.categories().items() for t in sorted(terms)]
    known = spark.createDataFrame(rows, "category string, term string").withColumn("__d", F.lit(True))
    out = usage.join(F.broadcast(known), ["category", "term"], "full")  # the vocabulary that the caller holds
    constrained = [c for c, terms in ontology.categories().items() if terms]
    status = (
        F.when(F.col("n").isNull(), F.when(F.col("category") == "attribute", "unused_attribute").otherwise("unused"))
        .when(F.col("__d").isNull() & F.col("category").isin(*constrained), "unknown")
        .otherwise("used")
    )
    return out.select("category", "term", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("__d", F.lit(False)).alias("declared"), status.alias("status"))


def coverage_ratio(usage: DataFrame, ontology: Ontology | None) -> Column:
    """For usage.agg: the share of declared terms that are used, over all categories as plain strings; NULL if nothing is declared."""
    terms = frozenset().union(*ontology.categories().values()) if ontology else frozenset()
    if not terms:
        return F.lit(None).cast("double")
    return F.count_distinct(F.when(F.col("term").isin(*sorted(terms)), F.col("term"))) / F.lit(float(len(terms)))
