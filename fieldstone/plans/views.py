"""Saved views and list definitions: named queries that a team keeps beside its catalog, checked when they are saved."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from fieldstone.catalog import Catalog, ObjectType, SpecError
from fieldstone.plans.filters import Sources, apply_filter, check_limits
from fieldstone.plans.paging import DEFAULT_PAGE, Sort, check_sorts, page


@dataclass(frozen=True)
class View:
    slug: str
    name: str
    object_type: str
    filter: dict | None = None
    sort: tuple[Sort, ...] = (Sort("created_at", True),)
    attributes: tuple[str, ...] = ()
    description: str = ""


@dataclass(frozen=True)
class ListSpec:
    """A static list holds entries, a dynamic one what its filter finds; `evaluation` grows with each change of the filter."""

    slug: str
    name: str
    kind: str = "static"
    object_type: str | None = None
    filter: dict | None = None
    description: str = ""
    evaluation: int = 0
    state: str = "ready"


@dataclass(frozen=True)
class Saved:
    """An immutable snapshot of views and lists; a change that changes something gives one with the next version."""

    views: dict[str, View] = field(default_factory=dict)
    lists: dict[str, ListSpec] = field(default_factory=dict)
    version: int = 0

    def save_view(self, catalog: Catalog, view: View) -> Saved:
        """Adds or replaces the view of that slug; saving the same again changes nothing."""
        of = _type(catalog, view.object_type)
        view = replace(view, attributes=tuple(dict.fromkeys(view.attributes)))
        if view.filter is not None:
            check_limits(view.filter)
        check_sorts(view.sort, of)
        for slug in view.attributes:
            of.attribute(slug)
        return self if self.views.get(view.slug) == view else replace(self, views=self.views | {view.slug: view}, version=self.version + 1)

    def delete_view(self, slug: str) -> Saved:
        self.view(slug)
        return replace(self, views={k: v for k, v in self.views.items() if k != slug}, version=self.version + 1)

    def view(self, slug: str) -> View:
        if slug not in self.views:
            raise SpecError("not_found", slug)
        return self.views[slug]

    def create_list(self, catalog: Catalog, new: ListSpec) -> Saved:
        if new.slug in self.lists:
            raise SpecError("schema_conflict", f"list {new.slug}")
        if new.kind == "dynamic" and (new.object_type is None or new.filter is None):
            raise SpecError("validation_failed", "dynamic lists need a type and a filter")
        if new.kind == "static" and new.filter is not None:
            raise SpecError("validation_failed", "static lists have no filter")
        if new.object_type is not None:
            _type(catalog, new.object_type)
        if new.filter is not None:
            check_limits(new.filter)
            new = replace(new, evaluation=1, state="refreshing")
        return replace(self, lists=self.lists | {new.slug: new}, version=self.version + 1)

    def update_list(self, slug: str, name: str | None = None, description: str | None = None, filter: dict | None = None) -> Saved:
        """What is None stays; another filter starts the next evaluation."""
        if slug not in self.lists:
            raise SpecError("not_found", slug)
        old = self.lists[slug]
        new = replace(old, name=old.name if name is None else name, description=old.description if description is None else description)
        if filter is not None:
            if old.kind != "dynamic":
                raise SpecError("schema_conflict", "static lists have no filter")
            check_limits(filter)
            new = replace(new, filter=filter, evaluation=old.evaluation + 1, state="refreshing")
        return replace(self, lists=self.lists | {slug: new}, version=self.version + 1)


def run_view(df: DataFrame, view: View, of: ObjectType, sources: Sources | None = None, limit: int = DEFAULT_PAGE, cursor=None, id_col: str = "id") -> DataFrame:
    """A page of the view over df, the record set that the caller may see; with attributes named, those and the id."""
    rows = page(apply_filter(df, view.filter, of, sources), view.sort, limit, cursor, id_col, of)
    return rows.select(id_col, *[a for a in view.attributes if a != id_col]) if view.attributes else rows


def _type(catalog: Catalog, slug: str) -> ObjectType:
    t = catalog.types.get(slug)
    if t is None or t.archived:
        raise SpecError("unknown_object_type", slug)
    return t
