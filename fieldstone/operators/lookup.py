"""Reads by identity: single records with merge redirects, batches in order, unique values, lists, tasks, events and files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstone.catalog import Catalog, SpecError
from fieldstone.plans.paging import Sort, page

MAX_IDS = 100


def redirected(records: DataFrame, id_col: str = "id") -> DataFrame:
    """(asked, ...record): every id with the live record that answers for it: its own, or, one step, the one that it was merged into."""
    to = records.select(F.col(id_col).alias("asked"), F.coalesce("merged_into_id", id_col).alias("__at"))
    whole = records.filter(F.col("merged_into_id").isNull() & F.col("deleted_at").isNull() & F.col("erased_at").isNull())
    return to.join(whole, to["__at"] == whole[id_col]).drop("__at")


def get_many(records: DataFrame, ids: Sequence, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows in the order asked, ids that are missing) of at most a hundred ids."""
    if not 1 <= len(ids) <= MAX_IDS:
        raise SpecError("array_arity", "1 to 100 ids")
    asked = records.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, ids))).alias("__at", "__id")).withColumn("__id", F.col("__id").cast(records.schema[id_col].dataType))
    found = records.join(F.broadcast(asked), records[id_col] == asked["__id"]).orderBy("__at").drop("__at", "__id")
    hit = records.select(id_col).join(F.broadcast(asked), records[id_col] == asked["__id"], "left_semi").distinct()
    return found, asked.join(hit, asked["__id"] == hit[id_col], "left_anti").select(F.col("__id").alias(id_col))


def by_unique(records: DataFrame, attribute: str, value: Column, form=lambda x: x) -> DataFrame:
    """Holders of a value in normal form, by its hash; more than one is a duplicate for the caller to report."""
    return records.filter(F.sha2(form(F.col(attribute)).cast("string"), 256) == F.sha2(form(value).cast("string"), 256))


def list_entries(entries: DataFrame, lists: DataFrame, records: DataFrame, list_id, limit: int = 50, cursor=None) -> DataFrame:
    """A page of a list's entries whose records can be seen, by position and id."""
    own = entries.join(lists.filter(F.col("list_id") == list_id).select("list_id"), "list_id", "left_semi")
    return page(own.join(records, "record_id"), [Sort("position")], limit, cursor, id_col="record_id")


def tasks_filter(status: str | None = None, assignee: dict | None = None, due_before: str | None = None, due_after: str | None = None, about=None) -> dict | None:
    """The filter that a task list's arguments stand for."""
    parts = [
        *([{"attribute": "status", "op": "eq", "value": status}] if status else []), *([{"attribute": "assignee", "op": "eq", "value": assignee}] if assignee else []),
        *([{"attribute": "due_at", "op": "lte", "value": due_before}] if due_before else []), *([{"attribute": "due_at", "op": "gte", "value": due_after}] if due_after else []),
        *([{"linked_to": {"relation": "task_about", "record": about}}] if about is not None else []),
    ]
    return {"and": parts} if parts else None


def events_page(events: DataFrame, limit: int = 50, cursor: tuple | None = None, **equal) -> DataFrame:
    """Events newest first; equal times are told apart by id, so that no page skips one."""
    for column, value in equal.items():
        events = events.filter(F.col(column) == value)
    return page(events, [Sort("occurred_at", True)], limit, None if cursor is None else ([cursor[0]], cursor[1]))


def register_files(files: DataFrame, new: DataFrame) -> DataFrame:
    """files with new ones, each provider key once; the stored one stays."""
    return files.unionByName(new.dropDuplicates(["provider", "provider_key"]).join(files.select("provider", "provider_key"), ["provider", "provider_key"], "left_anti").select(*files.columns))


def catalog_frame(spark: SparkSession, catalog: Catalog) -> DataFrame:
    """The catalog as rows (object_type, attribute, type, multi, required, unique, sensitivity, archived)."""
    rows = [(t.slug, a.slug, a.type, a.multi, a.required, a.unique, a.sensitivity, a.archived) for t in catalog.types.values() for a in t.attributes]
    return spark.createDataFrame(rows, "object_type string, attribute string, type string, multi boolean, required boolean, `unique` boolean, sensitivity string, archived boolean")


def options_in_use(records: DataFrame, attribute: str, multi: bool = False) -> DataFrame:
    """Distinct options that records hold; those may be archived but not removed."""
    return records.select((F.explode(attribute) if multi else F.col(attribute)).alias("option")).filter("option is not null").distinct()


def archive_preview(records: DataFrame, type_col: str = "object_type") -> DataFrame:
    """(object_type, records) that archiving a type would hide."""
    return records.groupBy(type_col).agg(F.count(F.lit(1)).alias("records"))


def files_page(files: DataFrame, limit: int = 50, cursor: tuple | None = None, **equal) -> DataFrame:
    """Files of a target, record or event, newest first."""
    return page(_equal(files, equal), [Sort("created_at", True)], limit, None if cursor is None else ([cursor[0]], cursor[1]))


def suppressions_page(entries: DataFrame, limit: int = 50, cursor: tuple | None = None, **equal) -> DataFrame:
    """Suppressions by kind, channel or reason, oldest first."""
    return page(_equal(entries, equal), [Sort("created_at")], limit, None if cursor is None else ([cursor[0]], cursor[1]))


def proposals_page(proposals: DataFrame, limit: int = 50, cursor: tuple | None = None, **equal) -> DataFrame:
    """Proposals by status, kind, record or source, oldest first."""
    return page(_equal(proposals, equal), [Sort("created_at")], limit, None if cursor is None else ([cursor[0]], cursor[1]))


def webhooks(subscriptions: DataFrame, team: str, enabled: bool | None = None) -> DataFrame:
    own = subscriptions.filter(F.col("team_id") == team)
    return own if enabled is None else own.filter(F.col("enabled") == enabled)


def _equal(df: DataFrame, equal: dict) -> DataFrame:
    for column, value in equal.items():
        df = df.filter(F.col(column) == value)
    return df
