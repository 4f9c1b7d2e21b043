"""Builders: from a valid record to its candidates, as one array of structs that is exploded once.

All kinds share one wide struct. Values and properties are canonical JSON text,
which compares and groups, unlike a variant. A builder is an object with
`required` (values that must not be NULL) and `parts(values)`: for each
candidate it may build a pair (reason it can't be built or NULL, struct or NULL).
A record of which any part has a reason gives no candidates at all.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.errors import ConfigurationError
from loomgraph.functions import identity, text

REF = "struct<entity_type:string,namespace:string,key:string>"
#: What builders fill in; the run adds the rest.
BODY = {
    "kind": "string", "semantic_key": "string", "entity_type": "string", "aliases": f"array<{REF}>", "display_name": "string", "properties": "string", "relation_type": "string",
    "subject": "string", "object": "string", "attribute": "string", "value": "string", "valid_from": "timestamp", "valid_to": "timestamp", "artifact_type": "string", "artifact_hash": "string", "source_uri": "string", "media_type": "string",
}
SCORES = "struct<extraction_confidence:double,source_reliability:double,identity_confidence:double,assertion_confidence:double,corroboration_score:double,policy_risk:double>"


@dataclass(frozen=True)
class Scoring:
    """What a source claims for its candidates. Axes that are unknown stay NULL."""

    source_reliability: float
    extraction_confidence: float = 1.0
    policy_risk: float = 0.0

    def __post_init__(self) -> None:
        for name in ("source_reliability", "extraction_confidence", "policy_risk"):
            if not 0.0 <= getattr(self, name) <= 1.0:
                raise ConfigurationError(f"{name} must lie in [0, 1]")

    def column(self) -> Column:
        unknown = F.lit(None).cast("double")
        return F.struct(
            F.lit(self.extraction_confidence).alias("extraction_confidence"), F.lit(self.source_reliability).alias("source_reliability"), unknown.alias("identity_confidence"),
            unknown.alias("assertion_confidence"), unknown.alias("corroboration_score"), F.lit(self.policy_risk).alias("policy_risk"),
        )


def body(**columns: Column) -> Column:
    """The wide struct with the given columns, the rest NULL."""
    return F.struct(*(columns.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in BODY.items()))


class Values:
    """Access to the values of a normalized frame by name and type."""

    def __init__(self, frame: DataFrame, column: str = "values") -> None:
        self.column = column
        #: Columns to add to the frame first: texts that several parts use are worked out once.
        self.prepared: dict[str, Column] = {}
        self.kinds = {f.name: f.dataType.simpleString() for f in frame.schema[column].dataType.fields}

    def raw(self, name: str) -> Column:
        return F.col(self.column).getField(name) if name in self.kinds else F.lit(None).cast("string")

    def text(self, name: str) -> Column:
        """A value as stripped text, NULL if blank: a column that construction adds."""
        self.prepared.setdefault(f"__text_{name}", self._text(name))
        return F.col(f"`__text_{name}`")

    def _text(self, name: str) -> Column:
        kind = self.kinds.get(name, "string")
        raw, kind = text.widened(self.raw(name), kind)
        if kind == "string":
            return text.nonempty(raw)
        if kind == "double":
            return text.float_text(raw)
        if kind == "boolean":
            return F.when(raw, "True").when(~raw, "False")
        return raw.cast("string")

    def json(self, name: str) -> Column:
        return text.json_value(self.raw(name), self.kinds.get(name, "string"))

    def properties(self, names: Sequence[str]) -> Column:
        """A JSON object of the values that aren't NULL, keys sorted."""
        pairs = [F.when(self.raw(n).isNotNull(), F.concat(F.lit(f'"{n}":'), self.json(n))) for n in sorted(names)]
        return F.concat(F.lit("{"), F.concat_ws(",", *pairs) if pairs else F.lit(""), F.lit("}"))

    def period(self, start: str | None, end: str | None) -> tuple[Column, Column, Column]:
        """(valid_from, valid_to, reason): inverted periods are the record's fault."""
        a = self.raw(start).cast("timestamp") if start else F.lit(None).cast("timestamp")
        b = self.raw(end).cast("timestamp") if end else F.lit(None).cast("timestamp")
        return a, b, F.when(a > b, "valid_from is after valid_to")


Part = tuple[Column, Column]


@dataclass(frozen=True)
class Entity:
    """A row to an entity. Its type is fixed or read from a column."""

    namespace: str
    key: str
    entity_type: str | None = None
    entity_type_field: str | None = None
    display_name: str | None = None
    properties: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if (self.entity_type is None) == (self.entity_type_field is None):
            raise ConfigurationError("an entity has either a type or a type field")

    @property
    def required(self) -> tuple[str, ...]:
        return (self.key,) if self.entity_type_field is None else (self.key, self.entity_type_field)

    def reference(self, values: Values) -> tuple[Column, Column]:
        """(reference, reason it can't be made)."""
        kind = F.lit(self.entity_type) if self.entity_type else values.text(self.entity_type_field)
        ref = identity.reference(kind, F.lit(self.namespace), values.text(self.key))
        reason = F.when(values.text(self.key).isNull(), f"entity key field {self.key!r} is empty").when(kind.isNull(), f"entity type field {self.entity_type_field!r} is empty")
        return ref, F.coalesce(reason, identity.misnamed(ref))

    def parts(self, values: Values) -> list[Part]:
        ref, reason = self.reference(values)
        properties = values.properties(self.properties)
        made = body(kind=F.lit("entity"), semantic_key=identity.entity_key(ref), entity_type=ref["entity_type"], aliases=F.array(ref), display_name=values.text(self.display_name) if self.display_name else F.lit(None), properties=properties)
        return [(reason, made)]


@dataclass(frozen=True)
class Attributes:
    """A row to a fact for each attribute that isn't NULL, about the entity that the same row names."""

    subject: Entity
    names: tuple[str, ...]
    valid_from: str | None = None
    valid_to: str | None = None

    def __post_init__(self) -> None:
        if not self.names:
            raise ConfigurationError("attributes need names")

    @property
    def required(self) -> tuple[str, ...]:
        return self.subject.required

    def parts(self, values: Values) -> list[Part]:
        ref, reason = self.subject.reference(values)
        start, end, inverted = values.period(self.valid_from, self.valid_to)
        out = []
        for name in self.names:
            value = values.json(name)
            key = F.concat(identity.entity_key(ref), F.lit(f"/{name}"), identity.period_suffix(start))
            made = body(kind=F.lit("attribute_assertion"), semantic_key=key, subject=identity.render(ref), attribute=F.lit(name), value=value, valid_from=start, valid_to=end)
            out.append((F.coalesce(reason, inverted), F.when(values.raw(name).isNotNull(), made)))
        return out


@dataclass(frozen=True)
class Relation:
    """A row to a relation between two entities."""

    relation_type: str
    subject: Entity
    object: Entity
    properties: tuple[str, ...] = ()
    valid_from: str | None = None
    valid_to: str | None = None

    @property
    def required(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((*self.subject.required, *self.object.required)))

    def parts(self, values: Values) -> list[Part]:
        (a, bad_a), (b, bad_b) = self.subject.reference(values), self.object.reference(values)
        start, end, inverted = values.period(self.valid_from, self.valid_to)
        kind = F.lit(self.relation_type)
        shape = F.when(~kind.rlike(identity.RELATION_TYPE), F.concat(F.lit("relation_type must be UPPER_SNAKE: "), kind))
        properties = values.properties(self.properties)
        key = F.concat(F.concat_ws("/", identity.entity_key(a), kind, identity.entity_key(b)), identity.period_suffix(start))
        made = body(kind=F.lit("relation"), semantic_key=key, relation_type=kind, subject=identity.render(a), object=identity.render(b), properties=properties, valid_from=start, valid_to=end)
        return [(F.coalesce(bad_a, bad_b, inverted, shape), made)]


@dataclass(frozen=True)
class Compose:
    """Several builders, one after another: the order in which duplicates are judged."""

    builders: tuple

    def __init__(self, *builders) -> None:
        if not builders:
            raise ConfigurationError("nothing to compose")
        object.__setattr__(self, "builders", builders)

    @property
    def required(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(n for b in self.builders for n in b.required))

    def parts(self, values: Values) -> list[Part]:
        return [p for b in self.builders for p in b.parts(values)]


def construction(frame: DataFrame, builder, reason: str = "construction", made: str = "made") -> DataFrame:
    """The normalized frame with the reason why a record's candidates can't be built, or NULL, and their array."""
    values = Values(frame)
    parts = builder.parts(values)
    why = F.coalesce(*(r for r, _ in parts), F.lit(None).cast("string"))
    columns = {reason: F.when(why.isNotNull(), F.concat(F.lit("candidate construction failed: "), why)), made: F.array(*(m for _, m in parts))}
    return frame.withColumns(values.prepared).withColumns(columns).drop(*values.prepared)


def content_hash() -> Column:
    """A digest of what a candidate says, from the body's columns: worked out for those that are admitted."""
    word = lambda c: text.json_value(c, "string")
    entity = F.concat(F.lit('{"alias":'), word(identity.render(F.get("aliases", F.lit(0)))), F.lit(',"properties":'), F.col("properties"), F.lit("}"))
    fact = F.concat(F.lit('{"attribute":'), word(F.col("attribute")), F.lit(',"value":'), F.col("value"), F.lit("}"))
    edge = F.concat(F.lit('{"object":'), word(F.col("object")), F.lit(',"properties":'), F.col("properties"), F.lit(',"relation":'), word(F.col("relation_type")), F.lit(',"subject":'), word(F.col("subject")), F.lit("}"))
    said = F.when(F.col("kind") == "entity", entity).when(F.col("kind") == "attribute_assertion", fact).when(F.col("kind") == "relation", edge)
    return F.when(F.col("kind") == "artifact", F.col("artifact_hash")).otherwise(identity.content_hash(said))


def explode(frame: DataFrame, made: str = "made") -> DataFrame:
    """A row a candidate: rec_idx, coord, pos (place within the record), and the body's columns.

    The outer form, since Spark would put a filter on the array's size under the
    other one and so build every candidate twice.
    """
    pos = F.posexplode_outer(made).alias("pos", "c")
    return frame.select("rec_idx", "coord", pos).where("c is not null").select("rec_idx", "coord", "pos", "c.*")
