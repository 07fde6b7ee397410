"""Compiles the structured filter grammar to Columns.

Predicates that ask whether something exists (links, search tokens, quality sets) become sets of ids, each left-joined once as a marker, so
that they nest freely under and, or and not. Comparisons keep SQL's three-valued logic; mode "memory" is the two-valued evaluator
of roll-up filters, in which a missing value satisfies `neq` alone."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstone.catalog import ORDERED, TEXT, TYPES, Attribute, ObjectType, SpecError
from fieldstone.functions.text import tokens

MAX_DEPTH, MAX_NODES, MAX_BYTES, MAX_VALUES = 8, 100, 16_384, 100
SYSTEM_TIMES = {"created_at", "updated_at", "last_activity_at"}


@dataclass
class Sources:
    """What existence predicates look into: current links (relation, from_id, to_id), search documents (record_id, tokens), and the id sets
    of quality predicates by name."""

    links: DataFrame | None = None
    search: DataFrame | None = None
    quality: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)
    id_col: str = "id"


@dataclass
class _Compiler:
    of: ObjectType
    sources: Sources
    mode: str = "sql"
    markers: list[tuple[str, DataFrame]] = field(default_factory=list)

    def marker(self, ids: DataFrame) -> Column:
        name = f"__marker_{len(self.markers)}"
        self.markers.append((name, ids.toDF("__id").distinct()))
        return F.coalesce(F.col(name), F.lit(False))

    def node(self, n: dict) -> Column:
        if "and" in n or "or" in n:
            kind = "and" if "and" in n else "or"
            if not n[kind]:
                raise SpecError("empty_logical", kind)
            return reduce(lambda a, b: a & b if kind == "and" else a | b, map(self.node, n[kind]))
        if "not" in n:
            return ~self.node(n["not"])
        if "attribute" in n:
            return self.leaf(self.of.attribute(n["attribute"]), n)
        if "system" in n:
            return self.system(n)
        if "linked_to" in n:
            x = n["linked_to"]
            near, far = ("from_id", "to_id") if x.get("direction", "from") == "from" else ("to_id", "from_id")
            links = self.sources.links.filter(F.col("relation") == x["relation"])
            return self.marker((links.filter(F.col(far) == x["record"]) if x.get("record") is not None else links).select(near))
        if "text" in n:
            return self.text(n["text"])
        if "quality" in n:
            return self.marker(self.sources.quality[n["quality"]]())
        raise SpecError("unknown_node", str(sorted(n)))

    def text(self, query: str) -> Column:
        wanted = tokens(F.lit(query))
        return self.marker(self.sources.search.filter(F.size(F.array_except(wanted, F.col("tokens"))) == 0).select("record_id"))

    def values(self, n: dict) -> list:
        if n["op"] in ("is_null", "is_not_null"):
            if n.get("value") is not None:
                raise SpecError("null_arity", n["op"])
            return []
        if n.get("value") is None:
            raise SpecError("missing_value", n["op"])
        out = n["value"] if n["op"] in ("in", "not_in", "between") else [n["value"]]
        if n["op"] in ("in", "not_in") and not (isinstance(out, list) and 1 <= len(out) <= MAX_VALUES):
            raise SpecError("array_arity", n["op"])
        if n["op"] == "between":
            if not (isinstance(out, list) and len(out) == 2):
                raise SpecError("array_arity", "between")
            if type(out[0]) is not type(out[1]) or _order(out[0]) > _order(out[1]):
                raise SpecError("between_order", str(out))
        return out

    def leaf(self, a: Attribute, n: dict) -> Column:
        op = n["op"]
        if op not in TYPES[a.type][1] or (a.multi and op in ORDERED):
            raise SpecError("unsupported_operator", f"{a.slug} {op}")
        if a.type == "currency" and op in ORDERED and not a.fixed_currency:
            raise SpecError("unsupported_operator", f"{a.slug} {op} needs a fixed currency")
        values = self.values(n)
        if a.type == "record_reference":
            links = self.sources.links.filter(F.col("relation") == a.relation)
            linked = self.marker((links.filter(F.col("to_id").isin(values)) if values else links).select("from_id"))
            return ~linked if op in ("neq", "not_in", "is_null") else linked
        if a.type == "rich_text" and op == "contains" and self.sources.search is not None:
            return self.text(values[0])
        x = F.col(a.slug)
        if a.multi and op in ("contains", "starts_with"):
            if a.type == "personal_name" or op == "starts_with":
                part = lambda e: e["full"] if a.type == "personal_name" else e
                pattern = f"%{values[0]}%" if op == "contains" else f"{values[0]}%"
                return self.told(F.exists(x, lambda e: F.ilike(part(e), F.lit(pattern))), op)
            return self.told(F.array_contains(x, self.literal(a, values[0])), op)
        if op in TEXT:
            return self.told(_ilike(x["full"] if a.type == "personal_name" else x, op, values[0]), op)
        if a.type == "currency" and op in ORDERED:
            x, values = x["amount"], [v["amount"] if isinstance(v, dict) else v for v in values]
            return self.told(_compare(x, op, [F.lit(_decimal(v)) for v in values]), op)
        return self.told(_compare(x, op, [self.literal(a, v) for v in values]), op)

    def system(self, n: dict) -> Column:
        name, op = n["system"], n["op"]
        values = self.values(n)
        if name in SYSTEM_TIMES and op not in TEXT:
            return self.told(_compare(F.col(name), op, [F.lit(v).cast("timestamp") for v in values]), op)
        if name == "display_name" and op in {"eq", "neq", *TEXT}:
            return self.told(_ilike(F.col(name), op, values[0]) if op in TEXT else _compare(F.col(name), op, [F.lit(values[0])]), op)
        if name == "owner" and op in {"eq", "neq", "in", "not_in"}:
            is_one = reduce(lambda a, b: a | b, [(F.col("owner_type") == v["type"]) & (F.col("owner_id") == v["id"]) for v in values])
            return self.told(~is_one if op in ("neq", "not_in") else is_one, op)
        raise SpecError("unsupported_operator", f"{name} {op}")

    def told(self, x: Column, op: str) -> Column:
        return F.coalesce(x, F.lit(op in ("neq", "not_in"))) if self.mode == "memory" else x

    def literal(self, a: Attribute, v) -> Column:
        if a.type in ("number", "percent", "rating"):
            return F.lit(_decimal(v))
        if a.type in ("date", "datetime", "timestamp_system"):
            return F.lit(v).cast(TYPES[a.type][0])
        if isinstance(v, dict):
            return F.from_json(F.lit(json.dumps(v)), TYPES[a.type][0])
        return F.lit(v)


def _decimal(v) -> Decimal:
    try:
        return Decimal(str(v))
    except InvalidOperation:
        raise SpecError("invalid_value", str(v)) from None


def _order(v):
    try:
        return (0, Decimal(str(v)))
    except InvalidOperation:
        return (1, str(v))


def _ilike(x: Column, op: str, v: str) -> Column:
    return F.ilike(x, F.lit(f"%{v}%" if op == "contains" else f"{v}%"))


def _compare(x: Column, op: str, v: list[Column]) -> Column:
    return {
        "is_null": lambda: x.isNull(), "is_not_null": lambda: x.isNotNull(), "eq": lambda: x == v[0], "neq": lambda: x != v[0], "in": lambda: x.isin(*v), "not_in": lambda: ~x.isin(*v),
        "gt": lambda: x > v[0], "gte": lambda: x >= v[0], "lt": lambda: x < v[0], "lte": lambda: x <= v[0], "between": lambda: x.between(v[0], v[1]),
    }[op]()


def check_limits(node: dict) -> None:
    if len(json.dumps(node, default=str).encode()) > MAX_BYTES:
        raise SpecError("filter_limit", "bytes")
    count = 0

    def walk(n: dict, depth: int) -> None:
        nonlocal count
        count += 1
        if depth > MAX_DEPTH or count > MAX_NODES:
            raise SpecError("filter_limit", "depth" if depth > MAX_DEPTH else "nodes")
        for child in n.get("and") or n.get("or") or ([n["not"]] if "not" in n else []):
            walk(child, depth + 1)

    walk(node, 1)


def apply_filter(df: DataFrame, node: dict | None, of: ObjectType, sources: Sources | None = None, mode: str = "sql") -> DataFrame:
    """Rows of df (a typed table with an id column) for which the filter is true."""
    if node is None:
        return df
    check_limits(node)
    c = _Compiler(of, sources or Sources(), mode)
    condition = c.node(node)
    for name, ids in c.markers:
        df = df.join(ids.withColumn(name, F.lit(True)), df[c.sources.id_col] == F.col("__id"), "left").drop("__id")
    return df.filter(condition).drop(*[name for name, _ in c.markers])
