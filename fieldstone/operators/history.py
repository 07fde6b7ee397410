"""Point-in-time replay, change pages, differences, timelines and the change feed's batch form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldstone.catalog import SpecError

KIND_RANK = {"activity": 4, "change": 3, "note": 2, "task": 1}
EVENT_NAMES = {"create": "record.created", "set": "record.updated", "unset": "record.updated", "restore": "record.updated", "delete": "record.deleted", "merge": "record.merged", "erase": "record.erased", "link": "link.created", "unlink": "link.ended", "schema": "schema.changed"}


def record_at(changes: DataFrame, at: Column) -> DataFrame:
    """(record_id, slug, value): attributes as they stood. The last set or unset of each slug holds, by time and then seq; one that was
    unset is absent, and a record whose last of create, delete and restore is a delete, or that wasn't created yet, has none.
    max_by of a struct aggregates before the shuffle, where a window would move all changes."""
    then = changes.filter(F.col("occurred_at") <= at)
    last = F.struct("occurred_at", "seq")
    state = then.filter(F.col("kind").isin("set", "unset")).groupBy("record_id", "slug").agg(F.max_by(F.struct("kind", "value"), last).alias("last"))
    life = then.filter(F.col("kind").isin("create", "delete", "restore")).groupBy("record_id").agg(F.max_by("kind", last).alias("life"), F.bool_or(F.col("kind") == "create").alias("made"))
    alive = life.filter(F.col("made") & (F.col("life") != "delete")).select("record_id")
    return state.filter(F.col("last.kind") == "set").join(alive, "record_id", "left_semi").select("record_id", "slug", F.col("last.value").alias("value"))


def values_at(changes: DataFrame, at: Column) -> DataFrame:
    """record_at for a log of sets alone."""
    return changes.filter(F.col("occurred_at") <= at).groupBy("record_id", "slug").agg(F.max_by("value", F.struct("occurred_at", "seq")).alias("value"))


def history(changes: DataFrame, slugs: list[str] | None = None) -> DataFrame:
    return (changes.filter(F.col("slug").isin(slugs)) if slugs else changes).orderBy(F.desc("occurred_at"), F.desc("seq"))


def history_page(changes: DataFrame, record_id, slugs: list[str] | None = None, limit: int = 50, cursor: tuple | None = None) -> DataFrame:
    """A page of a record's changes, newest first by (occurred_at, seq, id), after the cursor (those three); one row more if there is more."""
    rows = changes.filter(F.col("record_id") == record_id)
    rows = rows.filter(F.col("slug").isin(slugs)) if slugs else rows
    key = F.struct("occurred_at", "seq", "id")
    if cursor:
        at = F.struct(F.lit(cursor[0]).cast("timestamp").alias("occurred_at"), F.lit(cursor[1]).cast(changes.schema["seq"].dataType).alias("seq"), F.lit(cursor[2]).cast(changes.schema["id"].dataType).alias("id"))
        rows = rows.filter(key < at)
    return rows.orderBy(key.desc()).limit(limit + 1)


MAX_CHANGES = 200


def changes_by_ids(changes: DataFrame, ids: list) -> DataFrame:
    """The changes of these ids, 200 at most, with their place `nth` in the order asked."""
    if not 1 <= len(ids) <= MAX_CHANGES:
        raise SpecError("array_arity", f"1 to {MAX_CHANGES} ids")
    asked = changes.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, ids))).alias("nth", "__id"))
    return changes.join(F.broadcast(asked.withColumn("__id", F.col("__id").cast(changes.schema["id"].dataType))), changes["id"] == F.col("__id")).drop("__id")


def pull(changes: DataFrame, cursor: int | None, head: int, visible: Column, batch: int = 500, batches: int = 10, beginning: bool = False) -> tuple[DataFrame, DataFrame]:
    """(events, (cursor, has_more)): at most `batches` times `batch` changes after the cursor are looked at, in the order of commits, and
    those that the caller sees come back; the cursor moves over hidden ones too. Without a cursor the feed is at its head, or at its beginning."""
    start = cursor if cursor is not None else (0 if beginning else head)
    seen = changes.filter((F.col("seq") > start) & (F.col("seq") <= head)).orderBy("seq").limit(batch * batches)
    state = seen.agg(F.coalesce(F.max("seq"), F.lit(start)).alias("cursor")).withColumn("has_more", F.col("cursor") < head)
    if cursor is None and not beginning:
        state = state.withColumn("has_more", F.lit(False))
    return seen.filter(visible).withColumn("event", event_name(F.col("kind"))), state


def watched(changes: DataFrame, record_ids: list, types: list[str]) -> DataFrame:
    """Changes of the records, links with one of them at either end (from_id, to_id), and schema changes of their types."""
    link = F.col("kind").isin("link", "unlink") & (F.col("from_id").isin(record_ids) | F.col("to_id").isin(record_ids))
    schema = (F.col("kind") == "schema_change") & F.col("object_type").isin(types)
    return changes.filter(F.coalesce(F.col("record_id").isin(record_ids), F.lit(False)) | F.coalesce(link, F.lit(False)) | F.coalesce(schema, F.lit(False)))


STALE_DAYS = 30


def fresh(subscriptions: DataFrame, last_seen: DataFrame, now: Column, days: int = STALE_DAYS) -> DataFrame:
    """Subscriptions whose person was seen within the days; who was never seen is stale."""
    seen = last_seen.filter(F.col("last_seen_at") >= now - F.make_dt_interval(F.lit(days))).select("team_id", "user_id").distinct()
    return subscriptions.join(seen, ["team_id", "user_id"], "left_semi")


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(record_id, slug, kind, old, new) between two states (record_id, slug, value): set where a value is new or other, unset where it is gone."""
    b, a = before.withColumnRenamed("value", "old"), after.withColumnRenamed("value", "new")
    both = b.join(a, ["record_id", "slug"], "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))
    return both.select("record_id", "slug", F.when(F.col("new").isNull(), "unset").otherwise("set").alias("kind"), "old", "new")


def timeline(items: dict[str, DataFrame], limit: int | None = None, after: tuple | None = None) -> DataFrame:
    """Kinds of items (record_id, occurred_at, id) as one line, newest first; ties by kind, then id. `after` is (occurred_at, rank, id)."""
    union = reduce(DataFrame.unionByName, [d.select("record_id", "occurred_at", F.lit(k).alias("kind"), F.lit(KIND_RANK[k]).alias("rank"), F.col("id").cast("string").alias("id")) for k, d in items.items()])
    if after:
        union = union.filter(F.struct("occurred_at", "rank", "id") < F.struct(F.lit(after[0]).cast("timestamp"), F.lit(after[1]), F.lit(after[2])))
    keys = [F.desc("occurred_at"), F.desc("rank"), F.desc("id")]
    return union.orderBy(*keys).limit(limit) if limit else union


def stage_moves(moves: DataFrame) -> DataFrame:
    """Moves without those to the stage that the record already has."""
    before = F.lag("stage").over(Window.partitionBy("record_id").orderBy("started_at", "id"))
    return moves.withColumn("__before", before).filter(~F.col("stage").eqNullSafe(F.col("__before"))).drop("__before")


def last_activity(records: DataFrame, activities: DataFrame, id_col: str = "id") -> DataFrame:
    """records with last_activity_at moved forward to the newest activity, never back."""
    newest = activities.groupBy("record_id").agg(F.max("occurred_at").alias("__newest"))
    joined = records.join(newest, records[id_col] == newest["record_id"], "left").drop("record_id")
    return joined.withColumn("last_activity_at", F.greatest("last_activity_at", "__newest")).drop("__newest")


def last_set(changes: DataFrame) -> DataFrame:
    """(record_id, slug, occurred_at, seq) of each attribute's last `set`; the highest seq decides, not the latest time."""
    of = changes.filter("kind = 'set'").groupBy("record_id", "slug")
    return of.agg(F.max_by("occurred_at", "seq").alias("occurred_at"), F.max("seq").alias("seq"))


def event_name(kind: Column) -> Column:
    """The feed's name of a kind of change."""
    out = F.lit(None).cast("string")
    for k, name in EVENT_NAMES.items():
        out = F.when(kind == k, name).otherwise(out)
    return out


def changes_since(changes: DataFrame, cursor: int, head: int | None = None, limit: int | None = None) -> DataFrame:
    """The feed after a cursor, in the order of commits, no further than head."""
    out = changes.filter(F.col("seq") > cursor)
    out = (out if head is None else out.filter(F.col("seq") <= head)).withColumn("event", event_name(F.col("kind")))
    return out.orderBy("seq").limit(limit) if limit else out


def number_changes(changes: DataFrame, start: DataFrame) -> DataFrame:
    """Gives new changes their team's next numbers without gaps, in the order (committed_at, id); start is (team_id, seq)."""
    n = F.row_number().over(Window.partitionBy("team_id").orderBy("committed_at", "id"))
    return changes.withColumn("__n", n).join(start.withColumnRenamed("seq", "__from"), "team_id", "left").withColumn("seq", F.coalesce("__from", F.lit(0)) + F.col("__n")).drop("__n", "__from")
