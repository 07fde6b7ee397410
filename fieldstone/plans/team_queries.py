"""Merges, default policies, validation, activities and views over the driver's tables, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldstone.catalog import Attribute, Catalog, ObjectType, typed_projection
from fieldstone.operators import access, activities, compliance, history, links, mutation, pipeline, search
from fieldstone.plans import views
from fieldstone.plans.paging import Sort

from .driver_queries import _MERGES, _companies, _deals, _merges, _t, query

# Customers as records with some visibility, a creator and two tags.
_OWNED = """r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 28 = 1 THEN 'private' WHEN c_custkey % 3 = 0 THEN 'users' ELSE 'team' END AS visibility, 'u' || c_custkey % 7 AS owner FROM customer),
  e AS (SELECT survivor_id, loser_id AS member FROM m UNION SELECT survivor_id, survivor_id FROM m)"""


def _owned(spark, d):
    visibility = F.expr("case when id % 28 = 1 then 'private' when id % 3 = 0 then 'users' else 'team' end")
    return _companies(spark, d).select("id", "segment", "nation", visibility.alias("visibility"), F.concat(F.lit("u"), F.col("id") % 7).alias("created_on_behalf_of"))


@query(f"""WITH {_MERGES}, {_OWNED}, v AS (SELECT survivor_id, id, unnest([1, 2]) AS place, unnest([CASE WHEN c_custkey % 2 = 1 THEN lower(c_mktsegment) ELSE c_mktsegment END, 'n' || c_nationkey % 3]) AS tag
    FROM e JOIN customer ON c_custkey = member JOIN r ON id = member),
  n AS (SELECT *, row_number() OVER (PARTITION BY survivor_id, lower(tag) ORDER BY id <> survivor_id, id, place) AS nth FROM v)
  SELECT survivor_id, string_agg(tag, ',' ORDER BY id <> survivor_id, id, place) AS tags FROM n WHERE nth = 1 GROUP BY 1""")
def merge_multi_union(spark, d):
    tagged = _owned(spark, d).withColumn("tags", F.array(F.expr("if(id % 2 = 1, lower(segment), segment)"), F.concat(F.lit("n"), F.col("nation") % 3)))
    return mutation.merge_multi(tagged, _merges(spark, d), "tags").withColumn("tags", F.array_join("tags", ","))


@query(f"""WITH {_MERGES}, {_OWNED}, least AS (SELECT survivor_id, bool_or(visibility = 'private') AS p, bool_or(visibility = 'users') AS u FROM e JOIN r ON id = member GROUP BY 1)
  SELECT survivor_id AS record_id, 'g' || o_orderkey % 5 AS user_id FROM e JOIN orders ON o_custkey = member WHERE o_orderstatus = 'P'
  UNION SELECT survivor_id, owner FROM e JOIN least USING (survivor_id) JOIN r ON id = member WHERE u AND NOT p""")
def merge_grants(spark, d):
    grants = _deals(spark, d).filter("status = 'P'").select(F.col("company_id").alias("record_id"), F.concat(F.lit("g"), F.col("id") % 5).alias("user_id"))
    return mutation.merged_grants(_owned(spark, d), grants, _merges(spark, d))


# Every fourth customer had been merged into one that is a loser now.
@query(f"""WITH {_MERGES} SELECT c_custkey AS id, CASE WHEN c_custkey % 4 IN (2, 3) THEN c_custkey - c_custkey % 4 + 1 WHEN c_custkey % 4 = 0 AND c_custkey + 2 IN (SELECT loser_id FROM m) THEN c_custkey + 1
    WHEN c_custkey % 4 = 0 THEN c_custkey + 2 END AS merged_into_id, c_custkey % 4 IN (2, 3) AS deleted, CAST(CASE WHEN c_custkey % 4 IN (2, 3) OR c_custkey IN (SELECT survivor_id FROM m) THEN 2 ELSE 1 END AS BIGINT) AS version FROM customer""")
def merge_apply(spark, d):
    rows = _companies(spark, d).select("id", F.when(F.col("id") % 4 == 0, F.col("id") + 2).alias("merged_into_id"), F.lit(None).cast("timestamp").alias("deleted_at"), F.lit(1).cast("long").alias("version"))
    out = mutation.apply_merges(rows, _merges(spark, d), F.lit("2025-01-01").cast("timestamp"))
    return out.select("id", "merged_into_id", F.col("deleted_at").isNotNull().alias("deleted"), "version")


@query("""SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'allow'
    WHEN 1 THEN CASE c_nationkey % 4 WHEN 0 THEN 'approval' WHEN 3 THEN 'deny' ELSE 'allow' END
    WHEN 2 THEN CASE c_nationkey % 4 WHEN 0 THEN 'approval' WHEN 3 THEN 'deny' ELSE 'allow' END
    WHEN 3 THEN CASE c_nationkey % 4 WHEN 0 THEN 'deny' WHEN 3 THEN 'deny' ELSE 'approval' END
    WHEN 4 THEN CASE c_nationkey % 4 WHEN 3 THEN 'deny' ELSE 'approval' END
    ELSE CASE c_nationkey % 4 WHEN 0 THEN 'deny' ELSE 'allow' END END AS outcome FROM customer""")
def policy_defaults(spark, d):
    """What a new team's rules say to members, admins, owners and someone without any of these roles."""
    asked = F.array(*[F.struct(*[F.lit(x).cast("string").alias(n) for n, x in zip(("resource_type", "action", "sensitivity"), a, strict=True)]) for a in (
        ("record", "view", None), ("record", "delete", None), ("schema", "define", None), ("webhook", "admin", None), ("record", "erase", None), ("attribute", "view", "restricted"),
    )])
    role = F.element_at(F.array(*map(F.lit, ("member", "admin", "owner", "guest"))), (F.col("nation") % 4 + 1).cast("int"))
    requests = _companies(spark, d).withColumn("a", F.element_at(asked, (F.col("id") % 6 + 1).cast("int"))).select("id", F.lit("role").alias("actor_type"), role.alias("actor_id"), "a.*")
    return access.evaluate(requests, *access.default_policies(spark, "o1", "t1", ("app",))).select("id", "outcome")


_CHECKED = ObjectType("company", (Attribute("name", required=True), Attribute("balance", "number"), Attribute("since", "date"), Attribute("old", archived=True)))


@query("""SELECT c_custkey AS id, array_to_string(list_filter([CASE WHEN c_custkey % 3 = 0 THEN 'balance: type' END, CASE WHEN c_custkey % 7 = 0 THEN 'colour: unknown' END, CASE WHEN c_custkey % 5 = 0 THEN 'name: required' END,
    CASE WHEN c_custkey % 11 = 0 THEN 'old: unknown' END], lambda x: x IS NOT NULL), ';') AS issues FROM customer""")
def validate_records(spark, d):
    fields = {"name": "if(id % 5 = 0, null, name)", "balance": "if(id % 3 = 0, 'much', cast(balance as string))", "colour": "if(id % 7 = 0, 'red', null)", "old": "if(id % 11 = 0, 'x', null)", "since": "'2024-02-29'"}
    data = F.to_json(F.struct(*[F.expr(e).alias(n) for n, e in fields.items()]))
    rows = _companies(spark, d).select("id", data.alias("data"), data.alias("raw"))
    return mutation.validate(typed_projection(rows, _CHECKED), _CHECKED, "raw").select("id", F.array_join("issues", ";").alias("issues"))


@query("SELECT user_id AS record_id, event_type AS slug, arg_max(ts, event_id) AS occurred_at, max(event_id) AS seq FROM events WHERE event_id % 5 <> 0 GROUP BY 1, 2")
def last_set(spark, d):
    changes = _t(spark, d, "events").select(F.col("user_id").alias("record_id"), F.col("event_type").alias("slug"), F.expr("if(event_id % 5 = 0, 'unset', 'set')").alias("kind"), F.col("ts").alias("occurred_at"), F.col("event_id").alias("seq"))
    return history.last_set(changes)


@query("SELECT o_orderstatus AS stage, count(*) AS records, CAST(sum(CAST(round(o_totalprice, 2) AS DECIMAL(38,4))) FILTER (o_orderkey % 9 <> 0) AS VARCHAR) AS amount FROM orders GROUP BY 1")
def pipeline_amounts(spark, d):
    text = F.when(F.col("id") % 9 != 0, F.round("amount", 2).cast("decimal(18,2)").cast("string"))
    rows = _deals(spark, d).select(F.col("status").alias("stage"), F.lit(None).cast("timestamp").alias("ended_at"), text.alias("text"))
    amount = pipeline.fixed_amount(F.col("text"), F.when(F.col("text").isNotNull(), F.lit("EUR")), "EUR")
    return pipeline.current(rows, amount).withColumn("amount", F.col("amount").cast("string"))


# Orders as activities about their customer and another; a third of them has a reference, half of those are stored already.
def _calls(spark, d):
    ref = F.when(F.col("id") % 3 == 0, F.concat(F.lit("x"), F.col("id") % 1000))
    return _deals(spark, d).select("id", ref.alias("external_ref"), F.col("priority").alias("subject"), F.col("close_date").alias("occurred_at"), F.array(F.col("company_id"), F.col("company_id"), F.col("company_id") + 1).alias("about"), "status")


@query("""WITH a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'x' || o_orderkey % 1000 END AS ref, o_orderpriority AS subject, o_orderstatus = 'F' AS stored FROM orders),
  s AS (SELECT min(id) AS id, ref, arg_min(subject, id) AS subject FROM a WHERE stored AND ref IS NOT NULL GROUP BY ref), n AS (SELECT max(id) AS id, ref, arg_max(subject, id) AS subject FROM a WHERE NOT stored AND ref IS NOT NULL GROUP BY ref)
  SELECT id, ref AS external_ref, subject FROM a WHERE ref IS NULL AND NOT stored
  UNION ALL SELECT coalesce(s.id, n.id), ref, coalesce(n.subject, s.subject) FROM s FULL JOIN n USING (ref)""")
def activities_logged(spark, d):
    calls = _calls(spark, d)
    stored = calls.filter("status = 'F' and external_ref is not null").groupBy("external_ref").agg(F.min("id").alias("id"), F.min_by("subject", "id").alias("subject"))
    return activities.logged(stored, calls.filter("status <> 'F'"), ["subject"])


@query("SELECT 'activity_about' AS relation, o_orderkey AS from_id, unnest([o_custkey, o_custkey + 1]) AS to_id FROM orders")
def activities_about(spark, d):
    return activities.about_links(_calls(spark, d), "activity_about")


@query("""WITH a AS (SELECT unnest([o_custkey, o_custkey + 1]) AS id, o_orderdate AS t FROM orders)
  SELECT c_custkey AS id, greatest(CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '1996-06-01' END, max(t)) AS last_activity_at FROM customer LEFT JOIN a ON id = c_custkey GROUP BY c_custkey""")
def activities_touched(spark, d):
    rows = _companies(spark, d).select("id", F.expr("if(id % 2 = 0, timestamp_ntz'1996-06-01', null)").cast(dict(_deals(spark, d).dtypes)["close_date"]).alias("last_activity_at"))
    return activities.touched(rows, _calls(spark, d))


_DEAL = ObjectType("deal", (Attribute("status", "status"), Attribute("amount", "number"), Attribute("priority", "select")))


@query("SELECT o_orderkey AS id, o_orderpriority AS priority FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderpriority, o_orderkey LIMIT 51")
def view_saved(spark, d):
    catalog = Catalog().with_type(_DEAL)
    view = views.View("open", "Open deals", "deal", {"attribute": "status", "op": "eq", "value": "P"}, (Sort("priority"),), ("priority", "priority"))
    return views.run_view(_deals(spark, d), views.Saved().save_view(catalog, view).view("open"), _DEAL)


# Customers hang on the customer of a third of their number; the links of every tenth have ended.
@query("""WITH RECURSIVE e AS (SELECT c_custkey AS f, c_custkey // 3 AS t FROM customer WHERE c_custkey % 10 <> 0), d AS (SELECT 5::BIGINT AS id UNION SELECT f FROM e JOIN d ON t = id) SELECT id FROM d""")
def delete_closure(spark, d):
    edges = _companies(spark, d).select(F.col("id").cast("long").alias("from_id"), F.expr("cast(id div 3 as bigint)").alias("to_id"), F.expr("if(id % 10 = 0, timestamp'2024-01-01', null)").alias("active_until"))
    return links.cascade_closure(spark.range(5, 6), edges)


# Every third customer's segment changed since its vector was made, every seventh is new.
@query("""SELECT c_custkey AS record_id, c_name || ' · ' || c_mktsegment AS content, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 7 <> 0 THEN c_nationkey WHEN c_custkey % 2 = 0 THEN c_nationkey + 100 END AS first FROM customer""")
def search_reindex(spark, d):
    rows = _companies(spark, d)
    fresh = search.search_documents(rows, ["name", "segment"])
    old = rows.withColumn("segment", F.expr("if(id % 3 = 0, 'OTHER', segment)")).filter("id % 7 <> 0")
    stored = search.search_documents(old, ["name", "segment"]).join(rows.select(F.col("id").alias("record_id"), F.array(F.col("nation").cast("double"), F.lit(1.0)).alias("embedding")), "record_id")
    kept = search.reindexed(fresh, stored)
    # Vectors for all that lack one; those of odd ids were made for a text that has changed again.
    wanted = kept.filter("embedding is null").join(rows.select(F.col("id").alias("record_id"), "nation"), "record_id")
    made = wanted.select("record_id", F.expr("if(record_id % 2 = 1, 'older', content)").alias("content"), F.array(F.col("nation") + F.lit(100.0), F.lit(0.0)).alias("embedding"))
    return search.store_embeddings(kept, made, 2).select("record_id", "content", F.col("embedding")[0].cast("int").alias("first"))


# Customers had two values; those of every fourth lose the first, every third gains one, every fifth had archived that one before.
@query("""WITH v AS (SELECT c_custkey AS record_id, unnest(['a' || c_custkey, 'b' || c_nationkey, 'n' || c_custkey]) AS value, unnest([1, 2, 3]) AS k FROM customer)
  SELECT record_id, value, k = 3 AND record_id % 5 = 0 AS confirmed, CASE k WHEN 1 THEN record_id % 4 = 0 WHEN 3 THEN record_id % 3 <> 0 ELSE false END AS archived FROM v WHERE k < 3 OR record_id % 3 = 0 OR record_id % 5 = 0""")
def contact_points_set(spark, d):
    rows = _companies(spark, d).select(F.col("id").alias("record_id"), F.concat(F.lit("a"), "id").alias("a"), F.concat(F.lit("b"), "nation").alias("b"), F.concat(F.lit("n"), "id").alias("n"))
    told = lambda *values: rows.select("record_id", F.explode(F.array_compact(F.array(*map(F.expr, values)))).alias("value"))
    archived = F.lit("2024-01-01").cast("timestamp")
    states = told("a", "b").withColumns({"confirmed": F.lit(False), "archived_at": F.lit(None).cast("timestamp")}).unionByName(told("if(record_id % 5 = 0, n, null)").withColumns({"confirmed": F.lit(True), "archived_at": archived}))
    out = compliance.set_points(states.withColumn("value_hash", F.sha2("value", 256)), told("a", "b"), told("if(record_id % 4 = 0, null, a)", "b", "if(record_id % 3 = 0, n, null)"), F.lit("2025-01-01").cast("timestamp"))
    return out.select("record_id", "value", "confirmed", F.col("archived_at").isNotNull().alias("archived"))


@query("""SELECT s.stage, count(h.stage) AS records FROM (SELECT DISTINCT event_type AS stage FROM events WHERE event_type <> 'click' UNION SELECT 'won') s
  LEFT JOIN (SELECT user_id, arg_max(event_type, (ts, event_id)) AS stage FROM events GROUP BY 1) h USING (stage) GROUP BY 1""")
def pipeline_archived_stages(spark, d):
    """Zero for a stage without records, nothing for an archived one, though it has some."""
    moves = _t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("record_id"), F.col("event_type").alias("stage"), F.col("ts").alias("started_at"))
    stages = moves.select("stage").distinct().union(spark.createDataFrame([("won",)], "stage string")).select("stage", F.lit(0).alias("position"), (F.col("stage") == "click").alias("archived"))
    return pipeline.funnel(pipeline.intervals(moves), stages).select("stage", "records")
