"""Temporal links: projections, neighbours, cardinality, closures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldstone.plans.paging import Sort, page


def active_at(at: Column | None = None) -> Column:
    """Current links, or those whose half-open validity holds the instant."""
    return F.col("active_until").isNull() if at is None else (F.col("active_from") <= at) & (F.col("active_until").isNull() | (F.col("active_until") > at))


def projected(links: DataFrame) -> DataFrame:
    """(record_id, ids): targets of each record's links by position, a null one as -1, then by id."""
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("position", F.lit(-1)).alias("position"), F.col("to_id"))))
    return links.groupBy(F.col("from_id").alias("record_id")).agg(F.transform(ordered, lambda x: x["to_id"]).alias("ids"))


def list_links(links: DataFrame, record_id, relation: str | None = None, direction: str = "both", history: bool = False) -> DataFrame:
    """All links of a record, newest first."""
    return _listed(links, record_id, relation, direction, history).orderBy(F.desc("active_from"), F.desc("id"))


def _listed(links: DataFrame, record_id, relation: str | None, direction: str, history: bool) -> DataFrame:
    ends = {"from": F.col("from_id") == record_id, "to": F.col("to_id") == record_id}
    hit = ends["from"] | ends["to"] if direction == "both" else ends[direction]
    out = links.filter(hit if history else hit & active_at())
    return out.filter(F.col("relation") == relation) if relation else out


def links_page(links: DataFrame, record_id, relation: str | None = None, direction: str = "both", history: bool = False, visible: DataFrame | None = None, limit: int = 50, cursor: tuple | None = None) -> DataFrame:
    """A page of list_links(), newest first by (active_from, id), of links whose other end is among the ids `visible`, after the cursor."""
    out = _listed(links, record_id, relation, direction, history)
    if visible is not None:
        other = F.when(F.col("from_id") == record_id, F.col("to_id")).otherwise(F.col("from_id"))
        out = out.withColumn("__other", other).join(visible.toDF("__other"), "__other", "left_semi").drop("__other")
    return page(out, [Sort("active_from", True)], limit, None if cursor is None else ([cursor[0]], cursor[1]))


def neighbours(links: DataFrame, ids: DataFrame) -> DataFrame:
    """(anchor, neighbour) over links in either direction: two equi-joins rather than one with an alternative."""
    out = links.join(ids.toDF("from_id"), "from_id").select(F.col("from_id").alias("anchor"), F.col("to_id").alias("neighbour"))
    back = links.join(ids.toDF("to_id"), "to_id").select(F.col("to_id").alias("anchor"), F.col("from_id").alias("neighbour"))
    return out.union(back).distinct()


def apply_links(links: DataFrame, commands: DataFrame, cardinality: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(links after the commands, commands refused). A command (relation, from_id, to_id, at) ends active links that its cardinality
    excludes, is a no-op where the same link is active, and is refused as a link of a record to itself. Of commands for one
    constrained end the last by `at` holds."""
    refused = commands.filter(F.col("from_id") == F.col("to_id"))
    ends = {"many_to_many": [], "many_to_one": ["from_id"], "one_to_many": ["to_id"], "one_to_one": ["from_id", "to_id"]}[cardinality]
    wanted = commands.filter(F.col("from_id") != F.col("to_id")).dropDuplicates(["relation", "from_id", "to_id"])
    for end in ends:
        wanted = wanted.withColumn("__n", F.row_number().over(Window.partitionBy("relation", end).orderBy(F.desc("at"), F.desc("from_id"), F.desc("to_id")))).filter("__n = 1").drop("__n")
    current = links.filter(active_at())
    same = wanted.join(current.select("relation", "from_id", "to_id"), ["relation", "from_id", "to_id"], "left_semi").select("relation", "from_id", "to_id", F.lit(True).alias("__same"))
    out = links.join(same, ["relation", "from_id", "to_id"], "left")
    for end in ends:
        taken = wanted.select("relation", end).distinct().withColumn(f"__by_{end}", F.lit(True))
        out = out.join(taken, ["relation", end], "left")
    hit = F.lit(False)
    for end in ends:
        hit = hit | F.coalesce(F.col(f"__by_{end}"), F.lit(False))
    out = out.withColumn("active_until", F.when(active_at() & hit & F.col("__same").isNull(), now).otherwise(F.col("active_until"))).select(*links.columns)
    new = wanted.join(same, ["relation", "from_id", "to_id"], "left_anti").withColumn("active_from", now)
    return out.unionByName(new.select(*[c for c in new.columns if c in links.columns]), allowMissingColumns=True), refused


def cascade_closure(start: DataFrame, links: DataFrame) -> DataFrame:
    """Ids that deleting the start deletes: again and again the sources of active cascading links into the set, however long the chain. Only
    the newly found are joined; each round's set is checkpointed, so a lost executor doesn't replay them all, and what rounds found is
    laid together now and then, so that a long chain doesn't make a plan of as many parts."""
    edges = links.filter(active_at() & F.col("from_id").isNotNull()).select("from_id", "to_id").distinct().checkpoint()
    found = frontier = start.toDF("id").distinct().checkpoint()
    rounds = 0
    while not frontier.isEmpty():
        frontier = edges.join(frontier, edges["to_id"] == frontier["id"]).select(F.col("from_id").alias("id")).distinct().join(found, "id", "left_anti").checkpoint()
        found = found.union(frontier)
        rounds += 1
        if rounds % 16 == 0:
            found = found.repartition("id").checkpoint()
    return found
