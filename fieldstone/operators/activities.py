"""Activities, notes and tasks: records about other records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def logged(stored: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """stored (id, external_ref, columns...) with new ones (the same columns). A new one whose external_ref is stored changes that row, where
    what is null stays; of repeated refs the largest id speaks. Without a ref each is a row of its own."""
    one = new.filter("external_ref is not null").groupBy("external_ref").agg(F.max_by(F.struct("id", *columns), "id").alias("__new"))
    known = stored.select("external_ref").distinct()
    changed = stored.join(one, "external_ref", "left").select("id", "external_ref", *[F.coalesce(f"__new.{c}", c).alias(c) for c in columns])
    added = one.join(known, "external_ref", "left_anti").select("__new.id", "external_ref", *[F.col(f"__new.{c}").alias(c) for c in columns])
    return changed.unionByName(added).unionByName(new.filter("external_ref is null").select("id", "external_ref", *columns))


def about_links(new: DataFrame, relation: str) -> DataFrame:
    """(relation, from_id, to_id): each activity with each record that it is about, once."""
    return new.select(F.lit(relation).alias("relation"), F.col("id").alias("from_id"), F.explode(F.array_distinct("about")).alias("to_id")).filter("to_id is not null")


def touched(records: DataFrame, new: DataFrame, at: str = "occurred_at", id_col: str = "id") -> DataFrame:
    """records whose last_activity_at moved on to the newest of the activities (about, at) about them; it never goes back."""
    last = new.select(F.explode(F.array_distinct("about")).alias("__id"), at).groupBy("__id").agg(F.max(at).alias("__at"))
    joined = records.join(last, records[id_col] == F.col("__id"), "left")
    return joined.withColumn("last_activity_at", F.greatest("last_activity_at", "__at")).select(*records.columns)
