"""Batches of writes: validation, keyed upsert, patches, merge and unmerge plans, lists, erasure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldstone.catalog import ObjectType, SpecError
from fieldstone.functions.text import normalize_text, ordered_union

#: Members of a dynamic list, at most.
MAX_MEMBERS = 10_000


def validate(rows: DataFrame, of: ObjectType, data: str | None = None) -> DataFrame:
    """rows with `issues`, sorted: required attributes that are missing and, where `data` names the JSON column that the typed columns were
    taken from, values that didn't fit their type and names that the type doesn't have or has archived."""
    active = [a for a in of.attributes if not a.archived and a.type != "record_reference"]
    found = []
    for a in active:
        there = F.get_json_object(F.col(data), f"$.{a.slug}").isNotNull() if data else F.lit(False)
        missing = F.lit(f"{a.slug}: required") if a.required else F.lit(None)
        found.append(F.when(F.col(a.slug).isNull(), F.when(there, f"{a.slug}: type").otherwise(missing)))
    issues = F.array_compact(F.array(*found)).cast("array<string>")
    if data:
        known = [a.slug for a in of.attributes if not a.archived]
        names = F.coalesce(F.json_object_keys(F.col(data)), F.array().cast("array<string>"))
        issues = F.concat(issues, F.transform(F.filter(names, lambda x: ~x.isin(*known)), lambda x: F.concat(x, F.lit(": unknown"))))
    return rows.withColumn("issues", F.array_sort(issues))


def upsert(existing: DataFrame, incoming: DataFrame, key: str, columns: list[str], id_col: str = "id") -> DataFrame:
    """(key, action, id, columns...): what each key of the frame leads to. created, updated or unchanged for one holder, duplicate for several,
    failed for a null key. The last of repeated incoming rows (by `at` if there is one) holds; what it leaves null keeps the old value."""
    at = F.col("at") if "at" in incoming.columns else F.lit(0)
    last = incoming.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*columns), F.struct(at, *columns)).alias("__new"))
    holders = existing.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key2")).agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct(id_col, *columns)).alias("__old"))
    both = last.join(holders, F.col("__key") == F.col("__key2"), "left")
    value = lambda c: F.coalesce(F.col(f"__new.{c}"), F.col(f"__old.{c}"))
    same = reduce(lambda a, b: a & b, [value(c).eqNullSafe(F.col(f"__old.{c}")) for c in columns])
    action = F.when(F.col("__key").isNull(), "failed").when(F.col("__n").isNull(), "created").when(F.col("__n") > 1, "duplicate").when(same, "unchanged").otherwise("updated")
    return both.select(F.col("__key").alias(key), action.alias("action"), F.col(f"__old.{id_col}").alias(id_col), *[value(c).alias(c) for c in columns])


def patch(records: DataFrame, patches: DataFrame, columns: list[str], clears: str = "clears", id_col: str = "id") -> DataFrame:
    """records with each patch's values; a name in `clears` empties its attribute. The version grows where something changed, and a patch
    that expects another version (expected_version) changes nothing and is marked in `conflict`."""
    p = patches.select(F.col(id_col).alias("__id"), F.col("expected_version").alias("__expected"), F.col(clears).alias("__clears"), *[F.col(c).alias(f"__{c}") for c in columns])
    both = records.join(p, records[id_col] == F.col("__id"), "left")
    conflict = F.coalesce(F.col("__expected") != F.col("version"), F.lit(False))
    new = {c: F.when(conflict, F.col(c)).when(F.array_contains("__clears", F.lit(c)), None).otherwise(F.coalesce(f"__{c}", c)) for c in columns}
    changed = reduce(lambda a, b: a | b, [~new[c].eqNullSafe(F.col(c)) for c in columns])
    kept = [c for c in records.columns if c not in columns and c != "version"]
    return both.select(*kept, *[new[c].alias(c) for c in columns], (F.col("version") + changed.cast("int")).alias("version"), conflict.alias("conflict"))


def merge_fields(records: DataFrame, merges: DataFrame, last_set: DataFrame, columns: list[str], choices: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """One row per survivor: an explicit choice, else the survivor's value, else the newest value of its losers. merges is (survivor_id, loser_id),
    last_set (record_id, slug, occurred_at, seq); of losers set at the same time the first by id holds."""
    losers = merges.join(records.withColumnRenamed(id_col, "loser_id"), "loser_id")
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("slug"), F.col(c).cast("string").alias("value")) for c in columns])).alias("f")
    values = losers.select("survivor_id", "loser_id", named).select("survivor_id", "loser_id", "f.slug", "f.value").filter("value is not null")
    timed = values.join(last_set.withColumnRenamed("record_id", "loser_id"), ["loser_id", "slug"], "left")
    newest = timed.groupBy("survivor_id", "slug").agg(F.max_by("value", F.struct("occurred_at", "seq", -F.col("loser_id"))).alias("value"))
    wide = newest.groupBy("survivor_id").agg(*[F.max(F.when(F.col("slug") == c, F.col("value"))).alias(f"__{c}") for c in columns])
    out = records.join(wide, records[id_col] == wide["survivor_id"])
    chosen = {c: F.lit(None) for c in columns}
    if choices is not None:
        c_ = choices.select(F.col("survivor_id").alias("__chooser"), *[F.col(c).alias(f"__choice_{c}") for c in choices.columns if c != "survivor_id"])
        out = out.join(c_, out["survivor_id"] == c_["__chooser"], "left")
        chosen |= {c: F.col(f"__choice_{c}") for c in choices.columns if c != "survivor_id"}
    return out.select(F.col("survivor_id").alias(id_col), *[F.coalesce(chosen[c].cast("string"), F.col(c).cast("string"), F.col(f"__{c}")).alias(c) for c in columns])


def merge_links(links: DataFrame, merges: DataFrame, single_from: bool = False) -> DataFrame:
    """Links with losers replaced by survivors and `kept`: links of a record to itself and later copies of a (relation, from, to) end; where a
    source may have one link, the survivor's own and then the oldest stays. Positions of those kept are renumbered from 0."""
    end = lambda p: merges.select(F.col("loser_id").alias(f"__{p}"), F.col("survivor_id").alias(f"__new_{p}"))
    moved = links.join(end("f"), F.col("from_id") == F.col("__f"), "left").join(end("t"), F.col("to_id") == F.col("__t"), "left")
    out = moved.withColumn("own", F.col("__new_f").isNull()).withColumn("from_id", F.coalesce("__new_f", "from_id")).withColumn("to_id", F.coalesce("__new_t", "to_id")).drop("__f", "__t", "__new_f", "__new_t")
    age = [F.col("active_from"), F.col("id")]
    copy = F.row_number().over(Window.partitionBy("relation", "from_id", "to_id").orderBy(*age))
    out = out.withColumn("kept", (F.col("from_id") != F.col("to_id")) & (copy == 1))
    if single_from:
        rank = F.row_number().over(Window.partitionBy("relation", "from_id", "kept").orderBy(F.desc("own"), *age))
        out = out.withColumn("kept", F.col("kept") & (rank == 1))
    place = F.row_number().over(Window.partitionBy("relation", "from_id", "kept").orderBy(F.desc("own"), F.col("position").asc_nulls_last(), *age)) - 1
    return out.withColumn("position", F.when(F.col("kept") & F.col("position").isNotNull(), place))


def unmerge(snapshot: DataFrame, later: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(values to restore, conflicts): a snapshot (record_id, slug, value) of before the merge; attributes set or unset since are conflicts."""
    keys = later.filter(F.col("kind").isin("set", "unset")).select("record_id", "slug").distinct()
    return snapshot.join(keys, ["record_id", "slug"], "left_anti"), snapshot.join(keys, ["record_id", "slug"], "left_semi")


def merged_visibility(records: DataFrame, merges: DataFrame, id_col: str = "id") -> DataFrame:
    """(survivor_id, visibility): the most restrictive of all that are merged: private, then users, then team."""
    ranks = F.create_map(*[x for v, r in (("private", 0), ("users", 1), ("team", 2)) for x in (F.lit(v), F.lit(r))])
    every = merges.select("survivor_id", F.col("loser_id").alias("__m")).union(merges.select("survivor_id", "survivor_id"))
    return every.join(records, records[id_col] == F.col("__m")).groupBy("survivor_id").agg(F.min_by("visibility", ranks[F.col("visibility")]).alias("visibility"))


def merge_multi(records: DataFrame, merges: DataFrame, column: str, form=normalize_text, choices: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """(survivor_id, column): a multi-valued attribute's values after a merge: those of the record that choices (survivor_id, record_id) names,
    else the survivor's and then its losers' by id, each normal form once. A merge has few losers."""
    every = merges.select("survivor_id", F.col("loser_id").alias("__m")).union(merges.select("survivor_id", "survivor_id")).distinct()
    values = every.join(records.select(F.col(id_col).alias("__m"), F.col(column).alias("__v")), "__m")
    ranked = F.array_sort(F.collect_list(F.struct((F.col("__m") != F.col("survivor_id")).alias("loser"), F.col("__m").alias("m"), F.col("__v").alias("v"))))
    out = values.groupBy("survivor_id").agg(ranked.alias("__all")).select("survivor_id", ordered_union(F.col("__all.v"), form).alias(column))
    if choices is None:
        return out
    picked = choices.select("survivor_id", F.col("record_id").alias("__m"), F.lit(True).alias("__chosen")).join(values.select("survivor_id", "__m", "__v"), ["survivor_id", "__m"], "left")
    return out.join(picked, "survivor_id", "left").select("survivor_id", F.when(F.col("__chosen"), F.col("__v")).otherwise(F.col(column)).alias(column))


def merged_grants(records: DataFrame, grants: DataFrame, merges: DataFrame, id_col: str = "id") -> DataFrame:
    """(record_id, user_id): grants of survivors after a merge: all that any of the merged had and, where the merged record is for named
    users, those for whom the merged ones were created."""
    every = merges.select("survivor_id", F.col("loser_id").alias("__m")).union(merges.select("survivor_id", "survivor_id")).distinct()
    had = every.join(grants.select(F.col("record_id").alias("__m"), "user_id"), "__m").select("survivor_id", "user_id")
    named = merged_visibility(records, merges, id_col).filter("visibility = 'users'")
    creators = every.join(named, "survivor_id", "left_semi").join(records.select(F.col(id_col).alias("__m"), F.col("created_on_behalf_of").alias("user_id")), "__m").select("survivor_id", "user_id")
    return had.union(creators.filter("user_id is not null")).distinct().select(F.col("survivor_id").alias("record_id"), "user_id")


def apply_merges(records: DataFrame, merges: DataFrame, now: Column, id_col: str = "id") -> DataFrame:
    """records after merges: losers point to their survivor and are deleted, what pointed to a loser points to the survivor, and the versions
    of survivors and losers grow. A loser has one survivor."""
    to = merges.select(F.col("loser_id").alias("__l"), F.col("survivor_id").alias("__s"))
    survivors = merges.select(F.col("survivor_id").alias("__keeps")).distinct()
    out = records.join(to, records[id_col] == F.col("__l"), "left").join(survivors, records[id_col] == F.col("__keeps"), "left")
    out = out.join(to.select(F.col("__l").alias("__via"), F.col("__s").alias("__then")), F.col("merged_into_id") == F.col("__via"), "left")
    lost = F.col("__l").isNotNull()
    new = {
        "merged_into_id": F.coalesce("__s", "__then", "merged_into_id"), "deleted_at": F.when(lost, now).otherwise(F.col("deleted_at")),
        "version": F.col("version") + (lost | F.col("__keeps").isNotNull()).cast("int"),
    }
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in records.columns])


def list_members(rows: DataFrame, order: list[Column], most: int | None = MAX_MEMBERS) -> DataFrame:
    """(record_id, position) of a dynamic list: all rows of its query in order, counted from 0; an error if there are more than `most`. A
    global order is what a list is; ranges sort in parallel and each adds the sizes of those before it."""
    ordered = rows.orderBy(*order).select(F.col("id").alias("record_id")).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    ordered = ordered.checkpoint()
    if most is not None and ordered.count() > most:
        raise SpecError("list_limit", f"more than {most} members")
    sizes = ordered.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("__base"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ordered.join(F.broadcast(before), "__part").select("record_id", (F.col("__before") + F.col("__at") - F.col("__base")).alias("position"))


def erase(records: DataFrame, ids: DataFrame, columns: list[str], now: Column, id_col: str = "id") -> DataFrame:
    """records with the erased ones' attributes emptied and erased_at set."""
    gone = ids.toDF("__gone").distinct()
    out = records.join(gone, records[id_col] == F.col("__gone"), "left")
    hit = F.col("__gone").isNotNull()
    return out.select(*[F.when(hit, None).otherwise(F.col(c)).alias(c) if c in columns else F.when(hit, now).otherwise(F.col(c)).alias(c) if c == "erased_at" else F.col(c) for c in records.columns])


def retire(records: DataFrame, now: Column, days: int) -> DataFrame:
    """Without rows deleted longer than `days` ago, unless erased."""
    return records.filter(F.col("deleted_at").isNull() | F.col("erased_at").isNotNull() | (F.col("deleted_at") >= now - F.make_interval(days=F.lit(days))))
