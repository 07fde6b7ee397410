"""Batches of link, list, proposal and tenant writes, and the change rows that they leave."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldstone.operators.links import active_at

EDGE = ["relation", "from_id", "to_id"]


def unlink(links: DataFrame, commands: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links after, change rows, commands without an active link). A change row (record_id, kind, group_id, relation, from_id, to_id) stands
    for each end of a link that was ended; both have its id as group_id. Either end's version grows with its row."""
    wanted = commands.select(*EDGE).distinct()
    ended = links.filter(active_at()).join(wanted, EDGE, "left_semi")
    marked = links.join(wanted.withColumn("__end", F.lit(True)), EDGE, "left")
    after = marked.withColumn("active_until", F.when(active_at() & F.col("__end"), now).otherwise(F.col("active_until"))).select(*links.columns)
    ends = F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("record_id")
    changes = ended.select(ends, F.lit("unlink").alias("kind"), F.col("id").alias("group_id"), *EDGE)
    return after, changes, wanted.join(ended.select(*EDGE), EDGE, "left_anti")


def bumped(records: DataFrame, changes: DataFrame, id_col: str = "id") -> DataFrame:
    """records with their versions moved on by the number of groups of change rows that name them."""
    groups = changes.groupBy(F.col("record_id").alias("__id")).agg(F.count_distinct("group_id").alias("__n"))
    joined = records.join(groups, records[id_col] == F.col("__id"), "left")
    return joined.withColumn("version", F.col("version") + F.coalesce("__n", F.lit(0))).select(*records.columns)


def restricted(start: DataFrame, links: DataFrame, relations: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, relation) of records whose deletion an active link forbids: one of a restricting relation, at either end, to a record that isn't
    deleted with them."""
    ids = start.select(F.col(id_col).alias("id")).distinct()
    of = links.filter(active_at()).join(F.broadcast(relations.filter("on_delete = 'restrict'").select("relation")), "relation", "left_semi").filter("from_id <> to_id")
    ends = of.select("relation", F.col("from_id").alias("id"), F.col("to_id").alias("other")).unionByName(of.select("relation", F.col("to_id").alias("id"), F.col("from_id").alias("other")))
    return ends.join(ids, "id", "left_semi").join(ids.withColumnRenamed("id", "other"), "other", "left_anti").select("id", "relation").distinct()


def restore_conflicts(closed: DataFrame, restored: DataFrame, records: DataFrame, links: DataFrame, relations: DataFrame, id_col: str = "id") -> DataFrame:
    """(link id, reason) of links, ended by the deletion of `restored`, that cannot come back: an end outside that isn't live, an archived
    relation, or a single-valued end that another active link has taken."""
    live = records.filter(F.col("deleted_at").isNull() & F.col("merged_into_id").isNull() & F.col("erased_at").isNull()).select(F.col(id_col).alias("__live")).union(restored.select(id_col)).distinct()
    dead = lambda end: closed.join(live, closed[end] == F.col("__live"), "left_anti").select("id", F.lit("dead_endpoint").alias("reason"))
    known = closed.join(F.broadcast(relations.select("relation", "cardinality", "archived")), "relation")
    out = dead("from_id").union(dead("to_id")).union(known.filter("archived").select("id", F.lit("archived_relation").alias("reason")))
    for end, kinds in (("from_id", ("many_to_one", "one_to_one")), ("to_id", ("one_to_many", "one_to_one"))):
        taken = links.filter(active_at()).select("relation", end).distinct()
        out = out.union(known.filter(F.col("cardinality").isin(*kinds)).join(taken, ["relation", end], "left_semi").select("id", F.lit("slot_taken").alias("reason")))
    return out.distinct()


def restore_links(closed: DataFrame, links: DataFrame, conflicts: DataFrame) -> DataFrame:
    """links with the closed ones active again, all or, if there is any conflict, none."""
    none = F.broadcast(conflicts.limit(1).select(F.lit(True).alias("__conflict")))
    back = closed.select("id").distinct().join(none, F.lit(True), "left_anti").withColumn("__back", F.lit(True))
    return links.join(back, "id", "left").withColumn("active_until", F.when(F.col("__back"), F.lit(None)).otherwise(F.col("active_until"))).select(*links.columns)


def reference_links(records: DataFrame, attribute: str, relation: str, id_col: str = "id") -> DataFrame:
    """(relation, from_id, to_id, position) of a multi-reference: positions from 0 in the value's order, each target once, where it comes first."""
    return records.select(F.lit(relation).alias("relation"), F.col(id_col).alias("from_id"), F.posexplode(F.array_distinct(F.filter(attribute, lambda x: x.isNotNull()))).alias("position", "to_id"))


def create_changes(records: DataFrame, columns: list[str], id_col: str = "id") -> DataFrame:
    """(record_id, kind, slug, value, resulting_version): one create and a set for each attribute that has a value, all of version 1."""
    sets = [F.when(F.col(c).isNotNull(), F.struct(F.lit("set").alias("kind"), F.lit(c).alias("slug"), F.col(c).cast("string").alias("value"))) for c in columns]
    create = F.struct(F.lit("create").alias("kind"), F.lit(None).cast("string").alias("slug"), F.lit(None).cast("string").alias("value"))
    return records.select(F.col(id_col).alias("record_id"), F.inline(F.array_compact(F.array(create, *sets)))).withColumn("resulting_version", F.lit(1))


@dataclass(frozen=True)
class Guard:
    """What a team refuses in writes: a missing or a rejected origin, and visibility other than the team's from some apps."""

    require_origin: bool = False
    rejected_origins: tuple[str, ...] = ()
    team_only_apps: tuple[str, ...] = ()

    def error(self, origin: Column, origin_required: Column, visibility: Column, app: Column) -> Column:
        """The code by which a write is refused, or null."""
        missing = origin.isNull() & F.lit(self.require_origin) & origin_required
        rejected = F.coalesce(origin.isin(*self.rejected_origins), F.lit(False)) if self.rejected_origins else F.lit(False)
        hidden = (visibility != "team") & app.isin(*self.team_only_apps) if self.team_only_apps else F.lit(False)
        return F.when(missing | rejected, "origin_rejected").when(hidden, "visibility_rejected")


def merge_entries(entries: DataFrame, merges: DataFrame) -> DataFrame:
    """entries (list_id, record_id, created_at, id, ...) with losers' moved to their survivor, the earliest of each list, unless the survivor
    is there already; what isn't moved stays with the loser."""
    to = entries.join(merges.select(F.col("loser_id").alias("record_id"), "survivor_id"), "record_id", "left")
    held = entries.select("list_id", F.col("record_id").alias("survivor_id")).distinct().withColumn("__held", F.lit(True))
    nth = F.row_number().over(Window.partitionBy("list_id", "survivor_id").orderBy("created_at", "id"))
    losing = to.filter("survivor_id is not null").withColumn("__n", nth).join(held, ["list_id", "survivor_id"], "left")
    moved = losing.withColumn("record_id", F.when((F.col("__n") == 1) & F.col("__held").isNull(), F.col("survivor_id")).otherwise(F.col("record_id")))
    return to.filter("survivor_id is null").select(*entries.columns).unionByName(moved.select(*entries.columns))


def list_add(entries: DataFrame, new: DataFrame) -> DataFrame:
    """entries with new ones (list_id, record_id) behind the list's last position, in the order of record_id; present ones stay as they are."""
    fresh = new.select("list_id", "record_id").distinct().join(entries.select("list_id", "record_id"), ["list_id", "record_id"], "left_anti")
    last = entries.groupBy("list_id").agg(F.max("position").alias("__last"))
    nth = F.row_number().over(Window.partitionBy("list_id").orderBy("record_id"))
    placed = fresh.withColumn("__n", nth).join(last, "list_id", "left").withColumn("position", (F.coalesce("__last", F.lit(-1)) + F.col("__n")).cast(entries.schema["position"].dataType))
    return entries.select("list_id", "record_id", "position").unionByName(placed.select("list_id", "record_id", "position"))


def list_remove(entries: DataFrame, gone: DataFrame) -> DataFrame:
    return entries.join(gone.select("list_id", "record_id").distinct(), ["list_id", "record_id"], "left_anti")


def visible_counts(entries: DataFrame, records: DataFrame, id_col: str = "id") -> DataFrame:
    """(list_id, entries) of records that the caller sees; records is what record_set() gave."""
    return entries.join(records.select(F.col(id_col).alias("record_id")), "record_id", "left_semi").groupBy("list_id").agg(F.count(F.lit(1)).alias("entries"))


def decide(proposals: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(proposals after, writes). A decision (id, decision, record_id) of a pending proposal settles it: accept writes an amendment's value,
    pairs a match with the record named or creates one, reject writes nothing. Decisions on settled ones change nothing."""
    d = decisions.select("id", "decision", F.col("record_id").alias("__named")).dropDuplicates(["id"])
    both = proposals.join(d, "id", "left").withColumn("__hit", (F.col("status") == "pending") & F.col("decision").isin("accept", "reject"))
    after = both.withColumn("status", F.when(F.col("__hit"), F.when(F.col("decision") == "accept", "accepted").otherwise("rejected")).otherwise(F.col("status"))).select(*proposals.columns)
    accepted = both.filter(F.col("__hit") & (F.col("decision") == "accept"))
    action = F.when(F.col("kind") == "amendment", "set").when(F.col("__named").isNotNull(), "pair").otherwise("create")
    return after, accepted.select("id", action.alias("action"), F.when(F.col("kind") == "amendment", F.col("record_id")).otherwise(F.col("__named")).alias("record_id"), F.when(F.col("kind") == "amendment", F.col("value")).alias("value"))


def reparent(df: DataFrame, moves: DataFrame) -> DataFrame:
    """df with the organisation of teams that moved; moves is (team_id, organization_id), a few rows."""
    to = F.broadcast(moves.select("team_id", F.col("organization_id").alias("__to")))
    return df.join(to, "team_id", "left").withColumn("organization_id", F.coalesce("__to", "organization_id")).select(*df.columns)


def suppress(entries: DataFrame, new: DataFrame) -> DataFrame:
    """entries with new ones (key_hash, channel, reason, created_at): one for each key and channel, of which the first stays."""
    return entries.unionByName(new.select(*entries.columns)).groupBy("key_hash", "channel").agg(F.min_by(F.struct(*[c for c in entries.columns if c not in ("key_hash", "channel")]), F.struct("created_at", "reason")).alias("__e")).select("key_hash", "channel", "__e.*").select(*entries.columns)


def unsuppress(entries: DataFrame, gone: DataFrame) -> DataFrame:
    return entries.join(gone.select("key_hash", "channel").distinct(), ["key_hash", "channel"], "left_anti")
