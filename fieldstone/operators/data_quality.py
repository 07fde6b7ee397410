"""The data-quality report: missing, stale, orphaned and colliding records. Each bucket is a frame (record_id, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing_required(records: DataFrame, required: list[str], id_col: str = "id") -> DataFrame:
    """Records that lack a required attribute, with the names of those that lack, sorted."""
    lacking = F.array_compact(F.array(*[F.when(F.col(a).isNull(), F.lit(a)) for a in sorted(required)]))
    return records.select(F.col(id_col).alias("record_id"), lacking.alias("names")).filter(F.size("names") > 0).select("record_id", F.array_join("names", "; ").alias("detail"))


def stale(records: DataFrame, now: Column, days: int = 90, id_col: str = "id", at: str = "last_activity_at") -> DataFrame:
    return records.filter(F.col(at).isNull() | (F.col(at) < now - F.make_interval(days=F.lit(days)))).select(F.col(id_col).alias("record_id"), F.lit("stale").alias("detail"))


def orphans(records: DataFrame, links: list[DataFrame], id_col: str = "id") -> DataFrame:
    """Records without an active link of any of the given relations, each a frame with from_id."""
    linked = reduce(DataFrame.unionByName, [x.select("from_id") for x in links]).distinct()
    return records.join(linked, records[id_col] == linked["from_id"], "left_anti").select(F.col(id_col).alias("record_id"), F.lit("no link").alias("detail"))


def collisions(values: DataFrame) -> DataFrame:
    """Records that share a unique value: (record_id, attribute, value) to the sorted distinct details of each record. Values are aggregated
    before the join, so that a value that many records hold is one row."""
    keyed = values.select("record_id", "attribute", F.sha2(F.col("value").cast("string"), 256).alias("hash"), F.col("value").cast("string").alias("value"))
    shared = keyed.groupBy("attribute", "hash").agg(F.min("record_id").alias("low"), F.max("record_id").alias("high")).filter("low <> high").select("attribute", "hash")
    hit = keyed.join(shared, ["attribute", "hash"], "left_semi").select("record_id", F.concat_ws("=", "attribute", "value").alias("detail"))
    return hit.distinct().groupBy("record_id").agg(F.array_join(F.array_sort(F.collect_list("detail")), "; ").alias("detail"))


def report(buckets: dict[str, DataFrame], top: int = 100) -> DataFrame:
    """(bucket, total, record_id, detail): of each bucket the first records by id, beside the count of all."""
    out = []
    for name, b in buckets.items():
        count = b.agg(F.count(F.lit(1)).alias("total"))
        out.append(b.orderBy("record_id").limit(top).join(F.broadcast(count), F.lit(True)).select(F.lit(name).alias("bucket"), "total", "record_id", "detail"))
    return reduce(DataFrame.unionByName, out)
