"""Routing by confidence policy, as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.errors import ConfigurationError

#: From the least to the most careful.
ROUTES = ("AUTO", "LLM_ASSESS", "HUMAN")
RESOLVED, NEW, UNRESOLVED = "RESOLVED_EXISTING", "NEW_IDENTITY", "UNRESOLVED"
#: What undoes an operation. Promotion has no inverse.
INVERSE = {
    "CREATE_IDENTITY": "REVOKE_IDENTITY",
    "REVOKE_IDENTITY": "RESTORE_IDENTITY",
    "RESTORE_IDENTITY": "REVOKE_IDENTITY",
    "ATTACH_ASSERTION": "RETRACT_ASSERTION",
    "RETRACT_ASSERTION": "ATTACH_ASSERTION",
    "MERGE_IDENTITIES": "SPLIT_IDENTITY",
    "SPLIT_IDENTITY": "MERGE_IDENTITIES",
    "REASSIGN_ASSERTION": "REASSIGN_ASSERTION",
}


@dataclass(frozen=True)
class Policy:
    auto_extraction: float = 0.95
    auto_reliability: float = 0.90
    auto_risk: float = 0.20
    human_risk: float = 0.5
    assess_extraction: float = 0.80
    needs_identity: bool = True
    auto_identity: float = 0.95
    auto_for_new: bool = True
    version: str = "1"

    def __post_init__(self) -> None:
        for name in ("auto_extraction", "auto_reliability", "auto_risk", "human_risk", "assess_extraction", "auto_identity"):
            if not 0.0 <= getattr(self, name) <= 1.0:
                raise ConfigurationError(f"{name} must lie in [0, 1]")
        if self.auto_extraction < self.assess_extraction or self.human_risk < self.auto_risk:
            raise ConfigurationError("thresholds are out of order")


def _severity(route: Column) -> Column:
    return F.array_position(F.array(*(F.lit(r) for r in ROUTES)), route)


def risk_floor(policy: Policy, risk: Column) -> Column:
    return F.when(risk > policy.human_risk, "HUMAN").when(risk > policy.auto_risk, "LLM_ASSESS").otherwise("AUTO")


def identity_ok(policy: Policy, confidence: Column, disposition: Column) -> Column:
    """Whether identity lets a candidate go AUTO. A missing score is excused for a new identity only; a low one never is."""
    if not policy.needs_identity:
        return F.lit(True)
    enough = F.coalesce(confidence >= policy.auto_identity, F.lit(False))
    fresh = (confidence.isNull() | enough) if policy.auto_for_new else F.lit(False)
    return F.when(disposition == UNRESOLVED, False).when(disposition == NEW, fresh).otherwise(enough)


def extraction_route(policy: Policy, scores: Column, disposition: Column) -> Column:
    auto = (scores["extraction_confidence"] >= policy.auto_extraction) & (scores["source_reliability"] >= policy.auto_reliability) & identity_ok(policy, scores["identity_confidence"], disposition)
    return F.when(auto, "AUTO").when(scores["extraction_confidence"] >= policy.assess_extraction, "LLM_ASSESS").otherwise("HUMAN")


def route(policy: Policy, scores: Column, disposition: Column | None = None) -> Column:
    """The more careful of what the risk and what the confidence ask for."""
    disposition = F.lit(RESOLVED) if disposition is None else F.coalesce(disposition, F.lit(RESOLVED))
    worse = F.greatest(_severity(risk_floor(policy, scores["policy_risk"])), _severity(extraction_route(policy, scores, disposition)))
    return F.element_at(F.array(*(F.lit(r) for r in ROUTES)), worse.cast("int"))


def disposition(create_new: Column, resolved: Column) -> Column:
    """What resolution concluded: a new identity wins over a resolved one."""
    return F.when(F.coalesce(create_new, F.lit(False)), NEW).when(resolved.isNotNull(), RESOLVED).otherwise(UNRESOLVED)


def inverse(operation: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, back in INVERSE.items():
        out = F.when(operation == name, back).otherwise(out)
    return out
