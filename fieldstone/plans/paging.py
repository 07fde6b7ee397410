"""Sorting with nulls last, keyset pages, totals and sealed cursors."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstone.catalog import UNSORTABLE, ObjectType, SpecError
from fieldstone.plans.filters import SYSTEM_TIMES

MAX_SORTS, MAX_PAGE, DEFAULT_PAGE = 3, 500, 50


@dataclass(frozen=True)
class Sort:
    key: str
    descending: bool = False


def check_sorts(sorts: Sequence[Sort], of: ObjectType) -> None:
    if len(sorts) > MAX_SORTS or len({s.key for s in sorts}) < len(sorts):
        raise SpecError("invalid_sort", "at most three different keys")
    for s in sorts:
        if s.key in SYSTEM_TIMES | {"display_name"}:
            continue
        a = of.attribute(s.key)
        if a.multi or a.type in UNSORTABLE or (a.type == "currency" and not a.fixed_currency):
            raise SpecError("unsortable", s.key)


def order(sorts: Sequence[Sort], id_col: str = "id") -> list[Column]:
    """Nulls last in both directions; ties by id, in the last key's direction."""
    keys = [F.col(s.key).desc_nulls_last() if s.descending else F.col(s.key).asc_nulls_last() for s in sorts]
    return [*keys, F.col(id_col).desc() if sorts and sorts[-1].descending else F.col(id_col).asc()]


def after(sorts: Sequence[Sort], values: Sequence, last_id, id_col: str = "id") -> Column:
    """What comes after a row with these values: an equal beginning and then a key beyond, or all equal and an id beyond. A null value
    has nothing behind it on its own key."""
    types = [v if isinstance(v, Column) else F.lit(v) for v in values]
    clauses, equal = [], []
    for s, raw, v in zip(sorts, values, types, strict=True):
        x = F.col(s.key)
        if raw is not None:
            beyond = x.isNull() | ((x < v) if s.descending else (x > v))
            clauses.append(reduce(lambda a, b: a & b, [*equal, beyond]))
        equal.append(x.isNull() if raw is None else x.isNotNull() & (x == v))
    i = F.col(id_col)
    clauses.append(reduce(lambda a, b: a & b, [*equal, i < last_id if sorts and sorts[-1].descending else i > last_id]))
    return F.coalesce(reduce(lambda a, b: a | b, clauses), F.lit(False))


def page(df: DataFrame, sorts: Sequence[Sort], limit: int = DEFAULT_PAGE, cursor: tuple[Sequence, object] | None = None, id_col: str = "id", of: ObjectType | None = None) -> DataFrame:
    """One page and, if there is more, one row beyond it: a top-k, never a sort of everything."""
    if not 1 <= limit <= MAX_PAGE:
        raise SpecError("invalid_limit", str(limit))
    sorts = list(sorts) or [Sort("created_at", True)]
    if of:
        check_sorts(sorts, of)
    rows = df.filter(after(sorts, *cursor, id_col)) if cursor else df
    return rows.orderBy(*order(sorts, id_col)).limit(limit + 1)


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def seal(tool: str, arguments: dict, position) -> str:
    """A cursor that holds only for the same tool and arguments."""
    body = json.dumps({"for": _digest(tool, arguments), "at": position}, default=str)
    return base64.urlsafe_b64encode(body.encode()).decode()


def unseal(cursor: str, tool: str, arguments: dict):
    body = json.loads(base64.urlsafe_b64decode(cursor))
    if body["for"] != _digest(tool, arguments):
        raise SpecError("cursor_mismatch")
    return body["at"]


def _digest(tool: str, arguments: dict) -> str:
    return hashlib.sha256(f"{tool}\n{json.dumps(arguments, sort_keys=True, default=str)}".encode()).hexdigest()
