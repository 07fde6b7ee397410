"""Derived attributes: formulas, scores, roll-ups and copies over relations, compiled to Columns and joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstone.catalog import SpecError

MAX_NODES = 100
ARITHMETIC, COMPARISON = {"add", "subtract", "multiply", "divide"}, {"eq", "neq", "gt", "gte", "lt", "lte"}
_NUMBER = "decimal(38,10)"


def references(node: dict) -> set[str]:
    """Attributes that a formula reads."""
    return {node["attribute"]} if "attribute" in node else set().union(*map(references, node.get("args", [])), set())


def evaluation_order(formulas: dict[str, dict]) -> list[str]:
    """Formulas with those first that others read; a circle is an error."""
    done: list[str] = []
    open_: set[str] = set()

    def visit(name: str) -> None:
        if name in done:
            return
        if name in open_:
            raise SpecError("derivation_cycle", name)
        open_.add(name)
        for r in sorted(references(formulas[name]) & formulas.keys()):
            visit(r)
        done.append(name)

    for name in formulas:
        visit(name)
    return done


def formula(node: dict, now: Column | None = None) -> Column:
    """A formula {"literal"}, {"attribute"} or {"fn", "args"} as a Column. Numbers are decimals; what isn't a number gives null, as does a
    division by zero; comparison is by number where both are, else by text."""
    left = MAX_NODES

    def go(n: dict) -> Column:
        nonlocal left
        left -= 1
        if left < 0:
            raise SpecError("formula_limit")
        if "literal" in n:
            return F.lit(n["literal"])
        if "attribute" in n:
            return F.col(n["attribute"])
        fn, args = n["fn"], [go(a) for a in n["args"]]
        number = lambda x: x.cast("string").try_cast(_NUMBER)
        if fn in ARITHMETIC:
            a, b = map(number, args)
            return {"add": lambda: a + b, "subtract": lambda: a - b, "multiply": lambda: a * b, "divide": lambda: F.try_divide(a, b)}[fn]().try_cast("double")
        if fn in COMPARISON:
            a, b = args
            ops = {"eq": lambda x, y: x == y, "neq": lambda x, y: x != y, "gt": lambda x, y: x > y, "gte": lambda x, y: x >= y, "lt": lambda x, y: x < y, "lte": lambda x, y: x <= y}
            return F.when(number(a).isNotNull() & number(b).isNotNull(), ops[fn](number(a), number(b))).otherwise(ops[fn](a.cast("string"), b.cast("string")))
        if fn == "concat":
            return F.concat(*[a.cast("string") for a in args])
        if fn == "coalesce":
            return F.coalesce(*args)
        if fn in ("lower", "upper", "length"):
            return {"lower": F.lower, "upper": F.upper, "length": F.char_length}[fn](args[0].cast("string"))
        if fn == "days_since":
            at = F.current_timestamp() if now is None else now
            return F.floor((F.unix_millis(at) - F.unix_millis(args[0].cast("timestamp"))) / 86_400_000)
        raise SpecError("unknown_function", fn)

    return go(node)


def derive(df: DataFrame, formulas: dict[str, dict], now: Column | None = None) -> DataFrame:
    """df with each formula's column; later ones see earlier ones."""
    return reduce(lambda d, name: d.withColumn(name, formula(formulas[name], now)), evaluation_order(formulas), df)


def score(rules: list[tuple[Column, float]], age_days: Column | None = None, half_life: float | None = None) -> Column:
    """The weights of the rules that hold, added up; halved for every half_life of age."""
    held = reduce(lambda a, b: a + b, [F.when(F.coalesce(c, F.lit(False)), F.lit(float(w))).otherwise(0.0) for c, w in rules])
    if half_life:
        held = held * F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0)) / half_life)
    return held


def rollup(parents: DataFrame, related: DataFrame, value: str, operations: list[str], key: str = "record_id", currency: str | None = None) -> DataFrame:
    """parents (key, ...) with one column per operation over related (key, value): count is 0 without related rows, others null. A value that
    isn't a number makes sum and average null, as do amounts of several currencies."""
    number = F.col(value).cast("string").try_cast(_NUMBER)
    sound = F.count_if(F.col(value).isNotNull() & number.isNull()) == 0
    if currency:
        sound = sound & F.coalesce(F.min(currency) == F.max(currency), F.lit(False))
    parts = {
        "count": F.count(F.lit(1)), "sum": F.when(sound, F.sum(number)), "average": F.when(sound, F.avg(number)), "min": F.min(value), "max": F.max(value),
        "earliest_date": F.min(F.col(value).try_cast("timestamp")), "latest_date": F.max(F.col(value).try_cast("timestamp")),
    }
    told = related.groupBy(key).agg(*[parts[o].alias(o) for o in operations])
    out = parents.join(told, key, "left")
    return out.fillna(0, ["count"]) if "count" in operations else out


def relation_sync(parents: DataFrame, related: DataFrame, value: str, order: list[str], key: str = "record_id") -> DataFrame:
    """parents with the value of the first related row in the given order, and how many there are."""
    first = related.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value), F.count(F.lit(1)).alias("related"))
    return parents.join(first, key, "left").fillna(0, ["related"])


def impacted(sources: DataFrame, links: DataFrame) -> DataFrame:
    """Ids to recompute: the changed records and both ends of their active links."""
    ends = links.filter(F.col("active_until").isNull()).select("from_id", "to_id")
    s = sources.toDF("id")
    out = ends.join(s, ends["from_id"] == s["id"]).select(F.col("to_id").alias("id"))
    back = ends.join(s, ends["to_id"] == s["id"]).select(F.col("from_id").alias("id"))
    return s.union(out).union(back).distinct()
