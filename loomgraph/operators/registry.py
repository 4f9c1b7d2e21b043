"""The graph registry and the advisor that scores new data against it.

Versions, decisions and outcomes are append-only tables. Advice is a join of
profiles with the latest version of each graph and a chain of conditions, so a
batch of profiles is advised at once; the registry is the small side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.errors import Conflict
from loomgraph.functions import identity
from loomgraph.sources.store import Store

SCHEMAS = {
    "graph_versions": "name string, version long, owner string, domain string, backend string, ontology_version string, node_types array<string>, edge_types array<string>, attributes map<string,string>, registered_at timestamp",
    "decisions": "decision_id string, graph_name string, recommendation string, chosen_outcome string, decided_by string, rationale string, decided_at timestamp",
    "outcomes": "decision_id string, label string, note string, recorded_at timestamp, seq long",
}
PROFILE = (
    "profile_id string, identity_authority string, node_types array<string>, edge_types array<string>, attribute_types array<string>, tenancy_class string, lifecycle_class string, retention_class string, "
    "contains_minors_data boolean, is_computed_output boolean"
)
#: Names of the attributes that the advisor reads.
AUTHORITY, TENANCY, MINORS, LIFECYCLE, RETENTION, COMPUTED, VOCABULARY, BACKEND = (
    "identity_authority", "tenancy_class", "contains_minors_data", "lifecycle_class", "retention_class", "is_computed_output", "attribute_types", "backend.open_id",
)
#: The factors that are scored, in their order, and number and id of those that people judge.
FACTORS = ("identity_value", "ontology_compatibility", "tenancy", "lifecycle", "computational_coupling")
CHECKLIST = (
    (3, "assertion_evidence_semantics"), (4, "temporal_model_compatibility"), (7, "workload_backend_compatibility"), (8, "governance_stewardship"), (9, "failure_blast_radius"),
    (10, "cross_domain_traversal_value"), (12, "rebuild_deletion_boundaries"),
)
#: The outcomes.
EXTEND, SHARED, IDENTITY, ISOLATED, UNKNOWN = "EXTEND_SAME_PHYSICAL", "SHARED_LOGICAL_SEPARATE_PHYSICAL", "SEPARATE_SHARED_IDENTITY", "FULLY_ISOLATED", "INSUFFICIENT_INFORMATION"


# ---------------------------------------------------------------- advisor


@dataclass(frozen=True)
class Thresholds:
    extend: float = 0.75
    shared_logical: float = 0.6
    shared_identity: float = 0.6
    tenancy_floor: float = 0.5
    coupling_floor: float = 0.5
    min_factors: int = 2


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets; NULL when both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def same(a: Column, b: Column) -> Column:
    """1, 0, or NULL when either side is unknown."""
    return F.when(a.isNull() | b.isNull(), None).otherwise((a == b).cast("double"))


def truth(value: Column) -> Column:
    return F.lower(F.trim(value)).isin("1", "true", "yes")


def _terms(*arrays: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*(F.coalesce(a, empty) for a in arrays)))


def vocabulary(attributes: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(F.element_at(attributes, VOCABULARY), F.lit("")), ","), F.trim)
    return F.filter(parts, lambda p: p != "")


def factors() -> dict[str, Column]:
    """Scores of a profile (columns p_*) against a graph (columns g_*)."""
    own = lambda name: F.element_at("g_attributes", name)
    incoming = _terms(F.col("p_node_types"), F.col("p_edge_types"), F.col("p_attribute_types"))
    existing = _terms(F.col("g_node_types"), F.col("g_edge_types"), vocabulary(F.col("g_attributes")))
    minors = F.coalesce(F.col("p_contains_minors_data"), F.lit(False)) & ~F.coalesce(truth(own(MINORS)), F.lit(False))
    lives = F.array_compact(F.array(same(F.col("p_lifecycle_class"), own(LIFECYCLE)), same(F.col("p_retention_class"), own(RETENTION))))
    computed = truth(own(COMPUTED))
    return {
        "identity_value": same(F.col("p_identity_authority"), own(AUTHORITY)),
        "ontology_compatibility": jaccard(incoming, existing),
        "tenancy": F.when(minors, 0.0).otherwise(same(F.col("p_tenancy_class"), own(TENANCY))),
        "lifecycle": F.try_divide(F.aggregate(lives, F.lit(0.0), lambda s, x: s + x), F.size(lives).cast("double")),
        "computational_coupling": F.when(F.col("p_is_computed_output") & ~F.coalesce(computed, F.lit(False)), 0.0).otherwise(same(F.col("p_is_computed_output"), computed)),
    }


def tie_key(name: Column) -> Column:
    """Orders names so that, of two where one begins the other, the longer comes first, as comparing negated characters does."""
    return F.concat(name, F.lit("\U0010ffff"))


def score(profiles: DataFrame, graphs: DataFrame) -> DataFrame:
    """A row for each profile and graph: graph_name, factor scores, scored (how many), aggregate (their mean, NULL if none)."""
    p = profiles.select(*(F.col(c).alias(f"p_{c}") for c in profiles.columns))
    g = graphs.select(F.col("name").alias("graph_name"), F.col("node_types").alias("g_node_types"), F.col("edge_types").alias("g_edge_types"), F.coalesce("attributes", F.create_map().cast("map<string,string>")).alias("g_attributes"))
    made = p.join(g).withColumns(factors())  # every profile meets every registered graph: that is the question; Spark broadcasts the smaller side if it is small
    have = F.array_compact(F.array(*FACTORS))
    missing = F.array_compact(F.array(*(F.when(F.col(f).isNull(), f) for f in FACTORS)))
    return made.withColumns({"scored": F.size(have), "aggregate": F.try_divide(F.aggregate(have, F.lit(0.0), lambda s, x: s + x), F.size(have).cast("double")), "unscored": missing}).select(F.col("p_profile_id").alias("profile_id"), "graph_name", *FACTORS, "scored", "aggregate", "unscored")


def classify(t: Thresholds) -> Column:
    """The outcome for the best graph's row."""
    tenancy = F.col("tenancy").isNull() | (F.col("tenancy") >= t.tenancy_floor)
    coupling = F.col("computational_coupling").isNull() | (F.col("computational_coupling") >= t.coupling_floor)
    return (
        F.when(F.col("graph_name").isNull(), ISOLATED)
        .when(F.col("aggregate").isNull() | (F.col("scored") < t.min_factors), UNKNOWN)
        .when((F.col("aggregate") >= t.extend) & tenancy & coupling, EXTEND)
        .when((F.col("aggregate") >= t.shared_logical) & ~tenancy, SHARED)
        .when(F.col("identity_value") >= t.shared_identity, IDENTITY)
        .otherwise(ISOLATED)
    )


def advise(profiles: DataFrame, graphs: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """The best graph of each profile and what to do: outcome, action (extend, create, or NULL where nothing can be said), target and the scores."""
    scored = score(profiles, graphs)
    best = scored.groupBy("profile_id").agg(F.min_by(F.struct("graph_name", *FACTORS, "scored", "aggregate", "unscored"), F.struct(-F.coalesce("aggregate", F.lit(-1.0)), tie_key(F.col("graph_name")))).alias("b"))
    out = profiles.select("profile_id").join(best, "profile_id", "left").select("profile_id", "b.*").withColumn("outcome", classify(thresholds))
    extends = F.col("outcome").isin(EXTEND, SHARED)
    return out.withColumns({"action": F.when(F.col("outcome") != UNKNOWN, F.when(extends, "extend").otherwise("create")), "target": F.when(extends, F.col("graph_name"))})


# ---------------------------------------------------------------- store


def latest(versions: DataFrame) -> DataFrame:
    """The last version of each name, by name."""
    row = F.struct(*versions.columns)
    return versions.groupBy("name").agg(F.max_by(row, "version").alias("r")).select("r.*").orderBy("name")


class Registry:
    def __init__(self, spark: SparkSession, folder: str, clock=lambda: datetime.now(UTC)) -> None:
        self.store, self.clock = Store(spark, folder, SCHEMAS), clock

    def register(self, name: str, owner: str | None = None, domain: str | None = None, backend: str | None = None, ontology_version: str | None = None, node_types: Sequence[str] = (), edge_types: Sequence[str] = (), attributes: Mapping[str, str] | None = None, backend_ref: str | None = None) -> int:
        """Append the next version of a graph; backend_ref names a store that the usual names don't."""
        base = self.store.version()
        version = (self.latest_version(name) or 0) + 1
        extra = dict(attributes or {}) | ({BACKEND: backend_ref} if backend_ref is not None else {})
        row = (name, version, owner, domain, backend, ontology_version, list(node_types), list(edge_types), extra, self.clock())
        self.store.commit({"graph_versions": self.store.spark.createDataFrame([row], SCHEMAS["graph_versions"])}, None, base, "register")
        return version

    def versions(self, name: str | None = None) -> DataFrame:
        frame = self.store.read("graph_versions")
        return (frame if name is None else frame.where(F.col("name") == name)).orderBy("name", "version")

    def latest_version(self, name: str) -> int | None:
        return self.store.read("graph_versions").where(F.col("name") == name).agg(F.max("version")).first()[0]

    def get(self, name: str, version: int | None = None):
        rows = self.versions(name)
        return (rows.orderBy(F.col("version").desc()) if version is None else rows.where(F.col("version") == version)).first()

    def attributes_for(self, name: str, version: int | None = None) -> dict:
        row = self.get(name, version)
        return dict(row["attributes"] or {}) if row else {}

    def snapshot(self) -> DataFrame:
        return latest(self.store.read("graph_versions"))

    def advise(self, profiles: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
        return advise(profiles, self.snapshot(), thresholds)

    def record_decision(self, recommendation: str, chosen_outcome: str, decided_by: str, rationale: str, graph_name: str | None = None, decision_id: str | None = None) -> str:
        """Keep that someone decided. The same row again changes nothing; another one under its id is a Conflict."""
        base, at = self.store.version(), self.clock()
        key = decision_id or "dec_" + identity.suffix_of(decided_by, chosen_outcome, graph_name or "", at.isoformat())
        row = (key, graph_name, recommendation, chosen_outcome, decided_by, rationale, at)
        new = self.store.spark.createDataFrame([row], SCHEMAS["decisions"])
        old = self.store.read("decisions", base).where(F.col("decision_id") == key)
        if not old.isEmpty():
            if old.exceptAll(new).isEmpty():
                return key
            raise Conflict(f"another decision is recorded as {key}")
        self.store.commit({"decisions": new}, None, base, "decision")
        return key

    def record_outcome(self, decision_id: str, label: str, note: str | None = None) -> None:
        base = self.store.version()
        if self.store.read("decisions", base).where(F.col("decision_id") == decision_id).isEmpty():
            raise KeyError(f"no decision {decision_id!r}")
        self.store.commit({"outcomes": self.store.spark.createDataFrame([(decision_id, label, note, self.clock(), base + 1)], SCHEMAS["outcomes"])}, None, base, "outcome")

    def decisions(self, graph_name: str | None = None) -> DataFrame:
        """Decisions with their last outcome, by time and id."""
        last = self.store.read("outcomes").withColumn("__n", F.row_number().over(Window.partitionBy("decision_id").orderBy(F.col("seq").desc()))).where("__n = 1")
        rows = self.store.read("decisions").join(last.select("decision_id", F.col("label").alias("outcome_label"), F.col("note").alias("outcome_note"), F.col("recorded_at").alias("outcome_recorded_at")), "decision_id", "left")
        return (rows if graph_name is None else rows.where(F.col("graph_name") == graph_name)).orderBy("decided_at", "decision_id")


# ---------------------------------------------------------------- review queue


def pending(enqueued: DataFrame, resolved: DataFrame, limit: int | None = 50) -> DataFrame:
    """Items without a decision, first come first served; asking for an item again keeps its place, and priority doesn't order."""
    first = enqueued.groupBy("item_id").agg(F.min("enqueue_seq").alias("enqueue_seq"), F.min_by("priority", "enqueue_seq").alias("priority"))
    out = first.join(resolved.select("item_id").distinct(), "item_id", "left_anti").orderBy("enqueue_seq", "item_id")
    return out if limit is None else out.limit(limit)


REVIEW = {
    "review_items": "item_id string, kind string, payload string, priority string, reason string, enqueued_at timestamp, enqueue_seq long",
    "review_decisions": "item_id string, action string, actor string, edited_payload string, note string, decided_at timestamp, seq long",
}


class ReviewQueue:
    def __init__(self, spark: SparkSession, folder: str, clock=lambda: datetime.now(UTC)) -> None:
        self.store, self.clock = Store(spark, folder, REVIEW), clock

    def enqueue(self, items: DataFrame) -> None:
        base = self.store.version()
        order = F.lit(base + 1).cast("long") * F.lit(1 << 40) + F.monotonically_increasing_id()
        self.store.commit({"review_items": items.withColumns({"enqueued_at": F.lit(self.clock()).cast("timestamp"), "enqueue_seq": order})}, None, base, "enqueue")

    def pending(self, limit: int = 50) -> DataFrame:
        return pending(self.store.read("review_items"), self.store.read("review_decisions"), limit)

    def resolve(self, item_id: str, action: str, actor: str, edited_payload: str | None = None, note: str | None = None) -> None:
        """An item may be decided many times; an EDIT brings what it was edited to."""
        if action == "EDIT" and edited_payload is None:
            raise ValueError("an EDIT needs edited_payload")
        base = self.store.version()
        if self.store.read("review_items", base).where(F.col("item_id") == item_id).isEmpty():
            raise KeyError(f"no review item {item_id!r}")
        row = (item_id, action, actor, edited_payload, note, self.clock(), base + 1)
        self.store.commit({"review_decisions": self.store.spark.createDataFrame([row], REVIEW["review_decisions"])}, None, base, "resolve")

    def history(self, item_id: str) -> DataFrame:
        return self.store.read("review_decisions").where(F.col("item_id") == item_id).orderBy("seq")
