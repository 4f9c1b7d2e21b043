"""What rows of each kind must look like, as columns: the first violation in words, or NULL.

A rule takes the names of the columns that it reads, so that a frame is checked
with `frame.select("*", conflict_record().alias("violation"))`. Rules state
shape only; who may write what, and when, is the business of the operators.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions import identity, text

#: Fixed values.
TERM_KINDS = ("entity_type", "relation_type", "attribute")
LINK_KINDS = ("SAME_AS", "POSSIBLY_SAME_AS", "RELATED_TO")
COMPATIBLE = "BACKWARD_COMPATIBLE"
COMPATIBILITY = (COMPATIBLE, "REQUIRES_CANDIDATE_REVALIDATION", "REQUIRES_RE_EXTRACTION", "REQUIRES_GRAPH_MIGRATION", "REQUIRES_DERIVED_INDEX_REBUILD")
SCORED = ("identity_value", "ontology_compatibility", "tenancy", "lifecycle", "computational_coupling")


def _first(*rules: tuple[Column, str]) -> Column:
    out = None
    for broken, words in rules:
        broken = F.coalesce(broken, F.lit(False))
        out = F.when(broken, words) if out is None else out.when(broken, words)
    return out


def _blank(name: str) -> Column:
    return F.col(name).isNull() | (text.strip(F.col(name)) == "")


def _outside(value: Column) -> Column:
    """Not in [0, 1]; NULL is no violation."""
    return (value < 0) | (value > 1) | F.isnan(value)


def scores(name: str = "scores") -> Column:
    """Extraction and reliability are known, and every score that is lies in [0, 1]."""
    at = F.col(name)
    axes = ("extraction_confidence", "source_reliability", "identity_confidence", "assertion_confidence", "corroboration_score", "policy_risk")
    return _first(
        (at["extraction_confidence"].isNull() | at["source_reliability"].isNull(), "extraction_confidence and source_reliability are required"),
        *((_outside(at[a]), f"{a} must lie in [0, 1]") for a in axes),
    )


def representation(kind: str = "kind", words: str = "text", vector: str = "vector") -> Column:
    """Text or a vector, as its kind says."""
    k = F.col(kind)
    return _first(
        (~k.isin("text", "vector"), "a representation is text or a vector"),
        ((k == "text") & (F.col(words).isNull() | F.col(vector).isNotNull()), "a text representation has text only"),
        ((k == "vector") & (F.col(vector).isNull() | F.col(words).isNotNull()), "a vector representation has a vector only"),
    )


def aliases(name: str = "aliases", entity_type: str = "entity_type") -> Column:
    """At least one, all of the entity's type."""
    return _first((F.size(name) < 1, "an entity has an alias"), (F.exists(name, lambda a: a["entity_type"] != F.col(entity_type)), "aliases have the entity's type"))


def endpoint(name: str) -> Column:
    """A written reference or an identity id."""
    return _first((~identity.is_identity(F.col(name)) & identity.parse(F.col(name))["error"].isNotNull(), f"{name} is neither a reference nor an identity id"))


def relation(relation_type: str = "relation_type", subject: str = "subject", target: str = "object") -> Column:
    return F.coalesce(_first((~F.col(relation_type).rlike(identity.RELATION_TYPE), "relation_type must be UPPER_SNAKE")), endpoint(subject), endpoint(target))


def period(start: str = "valid_from", end: str = "valid_to") -> Column:
    return _first((F.col(start) > F.col(end), f"{start} is after {end}"))


def span(start: str = "start", end: str = "end") -> Column:
    return _first(((F.col(start) < 0) | (F.col(end) < 0), "offsets aren't negative"), (F.col(start) > F.col(end), "a span starts before it ends"))


def artifact(kind: str = "artifact_type", digest: str = "artifact_hash", uri: str = "source_uri") -> Column:
    return _first(*((_blank(n), f"{n} is required") for n in (kind, digest, uri)))


def observation(metric: str = "metric") -> Column:
    return _first((F.col(metric).isNull(), "an observation names its metric"))


def derived_assertion(derivation: str = "derivation") -> Column:
    return _first((F.col(derivation).isNull(), "a derived assertion has a derivation"))


def plan(objective: str = "objective") -> Column:
    return _first((F.col(objective).isNull(), "a plan has an objective"))


def ontology_term(kind: str = "term_kind", term: str = "term") -> Column:
    return _first((~F.col(kind).isin(*TERM_KINDS) | F.col(kind).isNull(), "term_kind is unknown"), (F.col(term).isNull(), "a proposal names its term"))


def link_candidate(left: str = "left", right: str = "right", kind: str = "kind") -> Column:
    """Ends that aren't empty; whether they are identities is checked when the link is made."""
    return _first((F.coalesce(F.col(left), F.lit("")) == "", "left is required"), (F.coalesce(F.col(right), F.lit("")) == "", "right is required"), (~F.col(kind).isin(*LINK_KINDS), "kind is unknown"))


def identity_link(left: str = "left_identity", right: str = "right_identity", kind: str = "kind", authority: str = "authority") -> Column:
    return _first(
        (~identity.is_identity(F.col(left)), f"{left} is not an identity id"),
        (~identity.is_identity(F.col(right)), f"{right} is not an identity id"),
        (F.col(left) == F.col(right), "a link joins two identities"),
        (~F.col(kind).isin(*LINK_KINDS), "kind is unknown"),
        (F.col(authority).isNull(), "a link names its authority"),
    )


def conflict_record(ids: str = "assertion_ids", preferred: str = "preferred_assertion_id", status: str = "status") -> Column:
    """Two assertions at least; a winner exactly when it is resolved, and among them."""
    won = F.col(preferred).isNotNull()
    return _first(
        (F.size(ids) < 2, "a conflict is between two assertions at least"),
        (~won & (F.col(status) != "UNRESOLVED"), "without a winner a conflict is unresolved"),
        (won & (F.col(status) != "RESOLVED"), "with a winner a conflict is resolved"),
        (won & ~F.array_contains(F.col(ids), F.col(preferred)), "the winner is one of the assertions"),
    )


def decision(valid: str = "valid", kind: str = "failure_kind") -> Column:
    """Valid exactly when nothing failed."""
    return _first((~F.col(valid) & F.col(kind).isNull(), "a rejection names its failure"), (F.col(valid) & F.col(kind).isNotNull(), "what is valid has no failure"))


def resolution(vector: str = "score_vector") -> Column:
    return _first((F.size(vector) < 1, "a resolution has scores"))


def review_decision(action: str = "action", edited: str = "edited_payload") -> Column:
    return _first(((F.col(action) == "EDIT") & F.col(edited).isNull(), "an EDIT needs edited_payload"))


def commit(committed: str = "committed", epoch: str = "epoch", error: str = "error", failed: str = "failed") -> Column:
    """A commit has its epoch, anything else a reason."""
    return _first((F.col(committed) & F.col(epoch).isNull(), "a commit has an epoch"), (~F.col(committed) & F.col(error).isNull() & (F.coalesce(F.size(failed), F.lit(0)) < 1), "what isn't committed has a reason"))


def recommendation(action: str = "action", graph: str = "graph_name", factors: str = "factor_scores", reasons: str = "reasons") -> Column:
    return _first(
        ((F.col(action) == "extend") & F.col(graph).isNull(), "extending names a graph"),
        (F.exists(F.map_keys(factors), lambda k: ~k.isin(*SCORED)), "a factor is unknown"),
        (F.exists(F.map_values(factors), _outside), "factor scores lie in [0, 1]"),
        (F.size(reasons) < 1, "a recommendation has reasons"),
    )


def version_change(before: str = "from_version", after: str = "to_version", compatibility: str = "compatibility") -> Column:
    return _first(
        (F.col(before) == "", f"{before} is NULL or a version"),
        (F.coalesce(F.col(after), F.lit("")) == "", f"{after} is required"),
        (~F.col(compatibility).isin(*COMPATIBILITY), "compatibility is unknown"),
        (F.col(before).isNull() & (F.col(compatibility) != COMPATIBLE), f"a first version is {COMPATIBLE}"),
    )


def arm(attempted: str = "attempted", abstained: str = "abstained", failed: str = "failed") -> Column:
    return _first((F.col(abstained) + F.col(failed) > F.col(attempted), "more inputs abstained or failed than were attempted"))


def any_of(rules: Sequence[Column]) -> Column:
    """The first violation of several rules."""
    return F.coalesce(*rules)
