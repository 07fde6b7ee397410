"""What users define at run time: object types, their attributes, relations and matching rules; and the errors that say what is wrong."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class SpecError(ValueError):
    """A request that can't be compiled; `code` names the reason."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


#: Stored type of each attribute type's column, and what may be asked of it.
TEXT, ORDERED, SET = {"contains", "starts_with"}, {"gt", "gte", "lt", "lte", "between"}, {"eq", "neq", "in", "not_in", "is_null", "is_not_null"}
TYPES: dict[str, tuple[str, set[str]]] = {
    "text": ("string", SET | TEXT), "rich_text": ("string", {"contains", "is_null", "is_not_null"}), "number": ("decimal(38,10)", SET | ORDERED),
    "currency": ("struct<amount:decimal(38,4),currency:string>", SET | ORDERED), "percent": ("decimal(38,10)", SET | ORDERED), "boolean": ("boolean", SET),
    "date": ("date", SET | ORDERED), "datetime": ("timestamp", SET | ORDERED), "select": ("string", SET | TEXT), "status": ("string", SET), "rating": ("int", SET | ORDERED),
    "email": ("string", SET | TEXT), "phone": ("string", SET), "url": ("string", SET | TEXT), "domain": ("string", SET | TEXT), "registry_id": ("string", SET | TEXT),
    "location": ("struct<line1:string,line2:string,city:string,region:string,country:string,postal:string,lat:double,lng:double>", SET),
    "personal_name": ("struct<first:string,last:string,full:string>", SET | TEXT), "actor_reference": ("struct<type:string,id:string>", SET | {"contains"}),
    "record_reference": ("string", SET | {"contains"}), "timestamp_system": ("timestamp", SET | ORDERED), "json": ("string", {"is_null", "is_not_null"}),
}
UNSORTABLE = {"json", "record_reference", "actor_reference", "location", "personal_name", "rich_text"}


@dataclass(frozen=True)
class Attribute:
    slug: str
    type: str = "text"
    multi: bool = False
    required: bool = False
    unique: bool = False
    sensitivity: str = "internal"
    relation: str | None = None
    fixed_currency: str | None = None
    archived: bool = False
    position: int = 0

    @property
    def spark_type(self) -> str:
        base = TYPES[self.type][0]
        return f"array<{base}>" if self.multi else base

    def extract(self, data: Column) -> Column:
        """This attribute of a JSON text, typed; null where it is missing or doesn't fit."""
        if self.type in ("currency", "location", "personal_name", "actor_reference") or self.multi:
            return F.from_json(F.get_json_object(data, f"$.{self.slug}"), self.spark_type)
        return F.get_json_object(data, f"$.{self.slug}").try_cast(self.spark_type)


@dataclass(frozen=True)
class Relation:
    slug: str
    from_type: str | None = None
    to_type: str | None = None
    cardinality: str = "many_to_many"
    on_delete: str = "unlink"


@dataclass(frozen=True)
class Rule:
    """A matching rule on one to four attributes: exact, normalized or fuzzy; block or warn."""

    id: str
    attributes: tuple[str, ...]
    kind: str = "normalized"
    action: str = "warn"
    threshold: float = 0.6
    position: int = 0

    def __post_init__(self):
        if self.kind == "fuzzy" and (self.action != "warn" or len(self.attributes) != 1 or not 0.5 <= self.threshold <= 1):
            raise SpecError("invalid_rule", "fuzzy rules warn, on one attribute, from 0.5 to 1")
        if not 1 <= len(self.attributes) <= 4:
            raise SpecError("invalid_rule", "one to four attributes")


@dataclass(frozen=True)
class ObjectType:
    slug: str
    attributes: tuple[Attribute, ...] = ()
    primary: str | None = None
    archived: bool = False
    rules: tuple[Rule, ...] = ()

    def attribute(self, slug: str) -> Attribute:
        for a in self.attributes:
            if a.slug == slug:
                if a.archived:
                    raise SpecError("archived_attribute", slug)
                return a
        raise SpecError("unknown_attribute", slug)


@dataclass(frozen=True)
class Catalog:
    """An immutable snapshot; every change gives a new one with the next version."""

    types: dict[str, ObjectType] = field(default_factory=dict)
    relations: dict[str, Relation] = field(default_factory=dict)
    version: int = 0

    def _next(self, **changes) -> Catalog:
        return replace(self, version=self.version + 1, **changes)

    def with_type(self, t: ObjectType) -> Catalog:
        return self if self.types.get(t.slug) == t else self._next(types=self.types | {t.slug: t})

    def with_attribute(self, type_slug: str, a: Attribute) -> Catalog:
        t = self.types[type_slug]
        old = next((x for x in t.attributes if x.slug == a.slug), None)
        if old and (old.type, old.multi) != (a.type, a.multi):
            raise SpecError("immutable_type", a.slug)
        kept = tuple(a if x.slug == a.slug else x for x in t.attributes)
        return self.with_type(replace(t, attributes=kept if old else (*kept, a)))

    def archive_attribute(self, type_slug: str, slug: str) -> Catalog:
        return self.with_attribute(type_slug, replace(self.types[type_slug].attribute(slug), archived=True))

    def with_relation(self, r: Relation) -> Catalog:
        return self if self.relations.get(r.slug) == r else self._next(relations=self.relations | {r.slug: r})

    def with_rule(self, type_slug: str, rule: Rule) -> Catalog:
        t = self.types[type_slug]
        for a in rule.attributes:
            t.attribute(a)
        return self.with_type(replace(t, rules=(*(r for r in t.rules if r.id != rule.id), rule)))

    def apply_template(self, types: Iterable[ObjectType], relations: Iterable[Relation] = ()) -> Catalog:
        """Adds what is missing; applying it again changes nothing."""
        out = self
        for t in types:
            if t.slug not in out.types:
                out = out.with_type(t)
        for r in relations:
            if r.slug not in out.relations:
                out = out.with_relation(r)
        return out


def typed_projection(records: DataFrame, t: ObjectType) -> DataFrame:
    """The wide, typed table of one object type: the system columns of records, and a column for each attribute of its JSON `data`."""
    return records.select(*[c for c in records.columns if c != "data"], *[a.extract(F.col("data")).alias(a.slug) for a in t.attributes if not a.archived and a.type != "record_reference"])
