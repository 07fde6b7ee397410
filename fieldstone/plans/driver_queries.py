"""The record operators over the driver's tables, each with its DuckDB twin.

customer, orders and part play records, lineitem links, events the change log and stage history, documents and embeddings search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstone.catalog import Attribute, ObjectType, Rule
from fieldstone.functions.text import normalize_registry, normalize_text, normalize_url, tokens
from fieldstone.operators import access, compliance, data_quality, derived, history, links, lookup, matching, mutation, pipeline, search
from fieldstone.plans.filters import Sources, apply_filter
from fieldstone.plans.paging import Sort, page, total
from fieldstone.sources import exports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


DEAL = ObjectType("deal", (Attribute("status", "status"), Attribute("amount", "number"), Attribute("close_date", "datetime"), Attribute("priority", "select"), Attribute("company", "record_reference", relation="deal_company")))
PRODUCT = ObjectType("product", (Attribute("name", "text"), Attribute("size", "number"), Attribute("brand", "select")))
COMPANY = ObjectType("company", (Attribute("name", "text"), Attribute("segment", "select"), Attribute("balance", "number"), Attribute("deals", "record_reference", relation="deal_company")))
USER = ObjectType("user", (Attribute("kinds", "select", multi=True),))
EVENT = ObjectType("event", (Attribute("k", "number"),))


def _deals(spark, d):
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"), F.col("o_orderdate").alias("close_date"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("company_id"))


def _companies(spark, d):
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))


def _products(spark, d):
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_retailprice").alias("price"))


def _company_links(spark, d):
    return _deals(spark, d).select(F.lit("deal_company").alias("relation"), F.col("company_id").alias("from_id"), F.col("id").alias("to_id"))


def _moves(spark, d):
    return _t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("record_id"), F.col("event_type").alias("stage"), F.col("ts").alias("started_at"), "value")


def _history(spark, d):
    return pipeline.intervals(_moves(spark, d))


def _changes(spark, d):
    return _t(spark, d, "events").select(F.col("user_id").alias("record_id"), F.col("event_type").alias("slug"), "value", F.col("ts").alias("occurred_at"), F.col("event_id").alias("seq"))


FILTER = {"and": [{"or": [{"attribute": "status", "op": "in", "value": ["F", "P"]}, {"attribute": "amount", "op": "between", "value": [1000, 5000]}]}, {"not": {"attribute": "priority", "op": "eq", "value": "1-URGENT"}}, {"attribute": "close_date", "op": "gte", "value": "1995-01-01"}]}


@query("""SELECT o_orderkey AS id, o_orderstatus AS status, round(o_totalprice, 2) AS amount FROM orders
  WHERE (o_orderstatus IN ('F', 'P') OR o_totalprice BETWEEN 1000 AND 5000) AND NOT (o_orderpriority = '1-URGENT') AND o_orderdate >= TIMESTAMP '1995-01-01'""")
def filter_scalar_ops(spark, d):
    return apply_filter(_deals(spark, d), FILTER, DEAL).select("id", "status", F.round("amount", 2).alias("amount"))


@query("""SELECT c_custkey AS id, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer
  WHERE nullif(c_mktsegment, 'BUILDING') NOT IN ('MACHINERY') AND nullif(c_mktsegment, 'BUILDING') <> 'AUTOMOBILE'""")
def filter_null_logic(spark, d):
    rows = _companies(spark, d).withColumn("segment", F.nullif(F.col("segment"), F.lit("BUILDING")))
    node = {"and": [{"attribute": "segment", "op": "not_in", "value": ["MACHINERY"]}, {"attribute": "segment", "op": "neq", "value": "AUTOMOBILE"}]}
    return apply_filter(rows, node, COMPANY).select("id", "segment")


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE p_name ILIKE '%a_%' OR p_name ILIKE 'p%'")
def filter_ilike(spark, d):
    node = {"or": [{"attribute": "name", "op": "contains", "value": "a_"}, {"attribute": "name", "op": "starts_with", "value": "p"}]}
    return apply_filter(_products(spark, d), node, PRODUCT).select("id", "name")


@query("SELECT c_custkey AS id FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def filter_linked_to(spark, d):
    return apply_filter(_companies(spark, d), {"attribute": "deals", "op": "is_not_null"}, COMPANY, Sources(links=_company_links(spark, d))).select("id")


@query("SELECT c_custkey AS id FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey) OR c_acctbal > 9000")
def filter_not_linked(spark, d):
    node = {"or": [{"not": {"linked_to": {"relation": "deal_company"}}}, {"attribute": "balance", "op": "gt", "value": 9000}]}
    return apply_filter(_companies(spark, d), node, COMPANY, Sources(links=_company_links(spark, d))).select("id")


@query("SELECT user_id AS id FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'purchase') > 0 AND count(*) FILTER (event_type ILIKE 'sign%') > 0")
def filter_multi_contains(spark, d):
    users = _t(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.collect_set("event_type").alias("kinds"))
    return apply_filter(users, {"and": [{"attribute": "kinds", "op": "contains", "value": "purchase"}, {"attribute": "kinds", "op": "starts_with", "value": "sign"}]}, USER).select("id")


@query("SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 10 AND 40")
def filter_json(spark, d):
    rows = _t(spark, d, "events").select(F.col("event_id").alias("id"), EVENT.attribute("k").extract(F.col("props")).alias("k"))
    return apply_filter(rows, {"attribute": "k", "op": "between", "value": [10, 40]}, EVENT).select("id", F.col("k").cast("long").alias("k"))


@query("SELECT doc_id AS id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])the([^\\p{L}\\p{N}]|$)') AND regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])and([^\\p{L}\\p{N}]|$)') AND lang <> 'fr'")
def filter_text(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    of = ObjectType("document", (Attribute("lang", "select"),))
    sources = Sources(search=docs.select(F.col("id").alias("record_id"), tokens(F.col("text")).alias("tokens")))
    return apply_filter(docs, {"and": [{"text": "the and"}, {"attribute": "lang", "op": "neq", "value": "fr"}]}, of, sources).select("id")


_SORTED = "SELECT c_custkey AS id, nullif(c_mktsegment, 'BUILDING') AS segment, round(c_acctbal, 2) AS balance FROM customer"


@query(f"{_SORTED} ORDER BY segment DESC NULLS LAST, c_acctbal ASC NULLS LAST, id LIMIT 51")
def sort_nulls_last(spark, d):
    rows = _companies(spark, d).withColumn("segment", F.nullif(F.col("segment"), F.lit("BUILDING")))
    return page(rows, [Sort("segment", True), Sort("balance")], of=COMPANY).select("id", "segment", F.round("balance", 2).alias("balance"))


@query(f"""SELECT * FROM ({_SORTED}) WHERE segment < 'HOUSEHOLD' OR segment IS NULL OR (segment = 'HOUSEHOLD' AND (balance > 5000 OR (balance = 5000 AND id > 7)))
  ORDER BY segment DESC NULLS LAST, balance ASC NULLS LAST, id LIMIT 51""")
def keyset_page(spark, d):
    rows = _companies(spark, d).withColumn("segment", F.nullif(F.col("segment"), F.lit("BUILDING"))).withColumn("balance", F.round("balance", 2))
    return page(rows, [Sort("segment", True), Sort("balance")], cursor=(["HOUSEHOLD", 5000.0], 7), of=COMPANY).select("id", "segment", "balance")


@query("""SELECT count(*) AS total FROM orders
  WHERE (o_orderstatus IN ('F', 'P') OR o_totalprice BETWEEN 1000 AND 5000) AND NOT (o_orderpriority = '1-URGENT') AND o_orderdate >= TIMESTAMP '1995-01-01'""")
def count_total(spark, d):
    return total(apply_filter(_deals(spark, d), FILTER, DEAL))


@query("SELECT l_orderkey AS record_id, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS ids FROM lineitem GROUP BY l_orderkey")
def project_links(spark, d):
    edges = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("from_id"), F.col("l_partkey").alias("to_id"), F.col("l_linenumber").alias("position"))
    return links.projected(edges).select("record_id", F.array_join("ids", ",").alias("ids"))


_INTERVALS = "WITH h AS (SELECT user_id AS record_id, event_type AS stage, ts AS started_at, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ended_at, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_stage, value FROM events)"


@query(f"""{_INTERVALS}, c AS (SELECT stage, count(*) AS records, sum(value) AS amount FROM h WHERE ended_at IS NULL GROUP BY 1),
  a AS (SELECT stage, avg((epoch_us(ended_at) - epoch_us(started_at)) / 86400000000) AS days FROM h WHERE ended_at IS NOT NULL GROUP BY 1),
  s AS (SELECT DISTINCT event_type AS stage FROM events)
  SELECT s.stage, coalesce(records, 0) AS records, round(amount, 4) AS amount, round(days, 6) AS average_days FROM s LEFT JOIN c USING (stage) LEFT JOIN a USING (stage)""")
def pipeline_funnel(spark, d):
    stages = _t(spark, d, "events").select(F.col("event_type").alias("stage")).distinct().withColumn("position", F.lit(0))
    told = pipeline.funnel(_history(spark, d), stages, F.col("value"))
    return told.select("stage", "records", F.round("amount", 4).alias("amount"), F.round("average_days", 6).alias("average_days"))


@query(f"{_INTERVALS} SELECT stage, count(*) AS records FROM h WHERE ended_at IS NULL GROUP BY 1")
def pipeline_current(spark, d):
    return pipeline.current(_history(spark, d))


@query(f"{_INTERVALS} SELECT stage, round(avg((epoch_us(ended_at) - epoch_us(started_at)) / 86400000000), 6) AS average_days FROM h WHERE ended_at IS NOT NULL GROUP BY 1")
def pipeline_durations(spark, d):
    return pipeline.durations(_history(spark, d)).withColumn("average_days", F.round("average_days", 6))


@query(f"{_INTERVALS} SELECT from_stage, stage, count(*) AS conversions FROM h WHERE from_stage IS NOT NULL AND from_stage <> stage AND started_at >= TIMESTAMP '2024-01-10' GROUP BY 1, 2")
def pipeline_conversions(spark, d):
    return pipeline.conversions(_history(spark, d), F.lit("2024-01-10").cast("timestamp"), tie="id")


@query("""SELECT c_custkey AS record_id, concat_ws('; ', CASE WHEN c_acctbal <= 0 THEN 'balance' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'segment' END) AS detail
  FROM customer WHERE c_acctbal <= 0 OR c_mktsegment = 'BUILDING'""")
def quality_missing(spark, d):
    rows = _companies(spark, d).withColumn("segment", F.nullif(F.col("segment"), F.lit("BUILDING"))).withColumn("balance", F.when(F.col("balance") > 0, F.col("balance")))
    return data_quality.missing_required(rows, ["segment", "balance"])


@query("""SELECT c_custkey AS record_id, 'stale' AS detail FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS t FROM orders GROUP BY 1) ON o_custkey = c_custkey
  WHERE t IS NULL OR t < TIMESTAMP '1998-01-01' - INTERVAL 90 DAY""")
def quality_stale(spark, d):
    last = _deals(spark, d).groupBy(F.col("company_id").alias("record_id")).agg(F.max("close_date").alias("occurred_at"))
    rows = history.last_activity(_companies(spark, d).withColumn("last_activity_at", F.lit(None).cast(last.schema["occurred_at"].dataType)), last)
    return data_quality.stale(rows, F.lit("1998-01-01").cast("timestamp"))


@query("SELECT c_custkey AS record_id, 'no link' AS detail FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P' AND o.o_orderpriority = '1-URGENT')")
def quality_orphans(spark, d):
    return data_quality.orphans(_companies(spark, d), [_deals(spark, d).filter("status = 'P' and priority = '1-URGENT'").select(F.col("company_id").alias("from_id"))])


@query("""WITH v AS (SELECT p_partkey AS record_id, 'name' AS attribute, p_name AS value FROM part UNION ALL SELECT p_partkey, 'price', CAST(CAST(round(p_retailprice, 0) AS BIGINT) AS VARCHAR) FROM part),
  s AS (SELECT attribute, value FROM v GROUP BY 1, 2 HAVING count(DISTINCT record_id) > 1)
  SELECT record_id, string_agg(DISTINCT attribute || '=' || value, '; ' ORDER BY attribute || '=' || value) AS detail FROM v JOIN s USING (attribute, value) GROUP BY 1""")
def quality_collisions(spark, d):
    parts = _products(spark, d)
    values = parts.select(F.col("id").alias("record_id"), F.lit("name").alias("attribute"), F.col("name").alias("value")).unionByName(parts.select(F.col("id").alias("record_id"), F.lit("price").alias("attribute"), F.round("price").cast("long").cast("string").alias("value")))
    return data_quality.collisions(values)


_LINE = "SELECT user_id AS record_id, ts AS occurred_at, CASE event_type WHEN 'purchase' THEN 'activity' WHEN 'click' THEN 'note' ELSE 'change' END AS kind, CAST(event_id AS VARCHAR) AS id FROM events"


def _timeline(spark, d):
    rows = _t(spark, d, "events").select(F.col("user_id").alias("record_id"), F.col("ts").alias("occurred_at"), F.col("event_id").alias("id"), "event_type")
    kinds = {"activity": rows.filter("event_type = 'purchase'"), "note": rows.filter("event_type = 'click'"), "change": rows.filter("event_type not in ('purchase', 'click')")}
    return history.timeline(kinds).select("record_id", "occurred_at", "kind", "id")


@query(_LINE)
def timeline_hop0(spark, d):
    return _timeline(spark, d)


@query(f"""WITH t AS ({_LINE}), n AS (SELECT o_custkey AS anchor, o_orderkey AS neighbour FROM orders UNION SELECT o_orderkey, o_custkey FROM orders)
  SELECT anchor, count(*) AS items, count(DISTINCT neighbour) AS neighbours, max(occurred_at) AS newest FROM n JOIN t ON t.record_id = n.neighbour GROUP BY 1""")
def timeline_hop1(spark, d):
    edges = _company_links(spark, d)
    ids = edges.select("from_id").union(edges.select("to_id")).distinct()
    near = links.neighbours(edges, ids)
    told = near.join(_timeline(spark, d), F.col("neighbour") == F.col("record_id"))
    return told.groupBy("anchor").agg(F.count(F.lit(1)).alias("items"), F.countDistinct("neighbour").alias("neighbours"), F.max("occurred_at").alias("newest"))


@query("SELECT user_id AS record_id, event_type AS slug, round(arg_max(value, struct_pack(t := ts, s := event_id)), 6) AS value FROM events WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY 1, 2")
def record_at(spark, d):
    return history.values_at(_changes(spark, d), F.lit("2024-01-15").cast("timestamp")).withColumn("value", F.round("value", 6))


_LOG = """SELECT user_id AS record_id, 'value' AS slug, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' WHEN 'view' THEN 'restore' WHEN 'click' THEN 'unset' ELSE 'set' END AS kind,
  round(value, 6) AS value, ts AS occurred_at, event_id AS seq FROM events"""


@query(f"""WITH c AS ({_LOG}), p AS (SELECT * FROM c WHERE occurred_at <= TIMESTAMP '2024-01-20'),
  l AS (SELECT record_id FROM p WHERE kind IN ('create', 'delete', 'restore') GROUP BY 1 HAVING bool_or(kind = 'create') AND arg_max(kind, struct_pack(t := occurred_at, s := seq)) <> 'delete'),
  s AS (SELECT record_id, slug, arg_max(kind, struct_pack(t := occurred_at, s := seq)) AS k, arg_max(value, struct_pack(t := occurred_at, s := seq)) AS value FROM p WHERE kind IN ('set', 'unset') GROUP BY 1, 2)
  SELECT record_id, slug, value FROM s WHERE k = 'set' AND record_id IN (SELECT record_id FROM l)""")
def record_replay(spark, d):
    kind = F.expr("case event_type when 'signup' then 'create' when 'error' then 'delete' when 'view' then 'restore' when 'click' then 'unset' else 'set' end")
    log = _t(spark, d, "events").select(F.col("user_id").alias("record_id"), F.lit("value").alias("slug"), kind.alias("kind"), F.round("value", 6).alias("value"), F.col("ts").alias("occurred_at"), F.col("event_id").alias("seq"))
    return history.record_at(log, F.lit("2024-01-20").cast("timestamp"))


@query("SELECT user_id AS record_id, event_type AS slug, event_id AS seq, ts AS occurred_at FROM events WHERE event_type IN ('purchase', 'signup')")
def record_history(spark, d):
    return history.history(_changes(spark, d), ["purchase", "signup"]).select("record_id", "slug", "seq", "occurred_at")


_STATE = "SELECT user_id AS record_id, event_type AS slug, round(arg_max(value, struct_pack(t := ts, s := event_id)), 6) AS value FROM events WHERE ts <= TIMESTAMP '{}' GROUP BY 1, 2"


@query(f"""WITH b AS ({_STATE.format("2024-01-10")}), a AS ({_STATE.format("2024-01-12")})
  SELECT coalesce(a.record_id, b.record_id) AS record_id, coalesce(a.slug, b.slug) AS slug, CASE WHEN a.value IS NULL THEN 'unset' ELSE 'set' END AS kind, b.value AS old, a.value AS new
  FROM b FULL OUTER JOIN a ON a.record_id = b.record_id AND a.slug = b.slug WHERE a.value IS DISTINCT FROM b.value""")
def diff_changes(spark, d):
    state = lambda day: history.values_at(_changes(spark, d), F.lit(day).cast("timestamp")).withColumn("value", F.round("value", 6))
    return history.diff(state("2024-01-10"), state("2024-01-12"))


@query("SELECT l_orderkey AS from_id, count(*) AS links FROM lineitem WHERE l_shipdate <= TIMESTAMP '1995-06-01' AND l_shipdate + INTERVAL 30 DAY > TIMESTAMP '1995-06-01' GROUP BY 1")
def links_as_of(spark, d):
    edges = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("from_id"), F.col("l_shipdate").alias("active_from"), (F.col("l_shipdate") + F.expr("interval 30 days")).alias("active_until"))
    return edges.filter(links.active_at(F.lit("1995-06-01").cast("timestamp"))).groupBy("from_id").agg(F.count(F.lit(1)).alias("links"))


@query("""SELECT relation, from_id, to_id FROM (SELECT 'ships_with' AS relation, l_orderkey AS from_id, l_suppkey AS to_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_suppkey DESC) AS n FROM lineitem WHERE l_orderkey <> l_suppkey) WHERE n = 1""")
def links_cardinality(spark, d):
    commands = _t(spark, d, "lineitem").select(F.lit("ships_with").alias("relation"), F.col("l_orderkey").alias("from_id"), F.col("l_suppkey").alias("to_id"), F.col("l_shipdate").alias("at"))
    last = commands.groupBy("relation", "from_id", "to_id").agg(F.max("at").alias("at"))
    empty = spark.createDataFrame([], "id long, relation string, from_id long, to_id long, active_from timestamp, active_until timestamp")
    out, _ = links.apply_links(empty, last, "many_to_one", F.current_timestamp())
    return out.filter(links.active_at()).select("relation", "from_id", "to_id")


@query("SELECT event_id AS seq, user_id AS record_id FROM events WHERE event_id > 100 AND event_id <= (SELECT max(event_id) - 50 FROM events)")
def feed_page(spark, d):
    changes = _changes(spark, d).withColumn("kind", F.lit("set"))
    head = changes.agg(F.max("seq")).first()[0]
    return history.changes_since(changes, 100, None if head is None else head - 50).select("seq", "record_id")


@query("""SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'record.created' WHEN 'purchase' THEN 'link.created' WHEN 'error' THEN 'record.deleted' ELSE 'record.updated' END AS event FROM events""")
def feed_events(spark, d):
    kind = F.expr("case event_type when 'signup' then 'create' when 'purchase' then 'link' when 'error' then 'delete' else 'set' end")
    return history.changes_since(_t(spark, d, "events").select(F.col("event_id").alias("seq"), kind.alias("kind")), -1).select("seq", "event")


def _search(spark, d):
    return _t(spark, d, "documents").select(F.col("doc_id").alias("record_id"), tokens(F.col("text")).alias("tokens"))


_TOKENS = """w AS (SELECT doc_id AS record_id, unnest(list_concat(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''),
    regexp_extract_all(lower(text), '[\\p{L}\\p{N}_-]+(?:[.@][\\p{L}\\p{N}_-]+)+'))) AS t FROM documents),
  n AS (SELECT record_id, t, count(*) AS n FROM w WHERE t IN ('the', 'and') GROUP BY 1, 2),
  k AS (SELECT record_id, sum(list_sum(list_transform(range(1, n + 1), lambda j: 1.0::DOUBLE / (j * j))) * 0.1 / 1.64493406685) AS score FROM n GROUP BY 1 HAVING count(*) = 2)"""


@query(f"WITH {_TOKENS} SELECT record_id, round(score, 6) AS score FROM k")
def search_keyword(spark, d):
    return search.keyword(_search(spark, d), "the and").withColumn("score", F.round("score", 6))


def _vectors(spark, d):
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("record_id"), "embedding")


_COSINE = "s AS (SELECT e.vec_id AS record_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


@query(f"WITH {_COSINE} SELECT record_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, record_id LIMIT 10")
def search_semantic(spark, d):
    v = _vectors(spark, d)
    return search.semantic(v, v.filter("record_id = 0"), 10).withColumn("score", F.round("score", 6))


@query(f"WITH {_COSINE} SELECT record_id, round(score, 6) AS score FROM s WHERE record_id <> 0 ORDER BY s.score DESC, record_id LIMIT 10")
def search_similar_to(spark, d):
    return search.similar_to(_vectors(spark, d), 0, 10).withColumn("score", F.round("score", 6))


@query(f"""WITH {_TOKENS}, {_COSINE}, a AS (SELECT record_id, row_number() OVER (ORDER BY round(score, 9) DESC, record_id) AS r FROM k QUALIFY r <= 50),
  b AS (SELECT record_id, row_number() OVER (ORDER BY round(score, 9) DESC, record_id) AS r FROM s QUALIFY r <= 50)
  SELECT record_id, round(coalesce(1.0::DOUBLE / (60 + a.r), 0) + coalesce(1.0::DOUBLE / (60 + b.r), 0), 6) AS score, CASE WHEN b.r IS NULL THEN 'keyword' WHEN a.r IS NULL THEN 'semantic' ELSE 'both' END AS match
  FROM a FULL OUTER JOIN b USING (record_id)""")
def search_hybrid_rrf(spark, d):
    v = _vectors(spark, d)
    rounded = lambda x: x.withColumn("score", F.round("score", 9))
    return search.fuse(rounded(search.keyword(_search(spark, d), "the and")), rounded(search.semantic(v, v.filter("record_id = 0")))).withColumn("score", F.round("score", 6))


@query("SELECT p_partkey AS record_id, 'brand_size' AS rule_id, sha256(length(p_brand) || ':' || p_brand || length(CAST(p_size AS VARCHAR)) || ':' || p_size) AS hash FROM part")
def match_exact(spark, d):
    return matching.match_keys(_products(spark, d), Rule("brand_size", ("brand", "size"), "exact"))


@query("""WITH k AS (SELECT sha256(length(v) || ':' || v) AS hash, p_partkey AS record_id FROM (SELECT p_partkey, lower(regexp_replace(trim(p_name), '\\s+', ' ', 'g')) AS v FROM part)),
  g AS (SELECT hash, count(*) AS members FROM k GROUP BY 1 HAVING count(*) > 1)
  SELECT 'name' AS rule_id, count(*) AS groups, CAST(sum(members) AS BIGINT) AS members FROM g HAVING count(*) > 0""")
def match_normalized(spark, d):
    return matching.collision_counts(matching.match_keys(_products(spark, d), Rule("name", ("name",))))


# Names of parts, every fifth with a letter more: so some are similar and not equal.
_NAMED = "named AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_name || 's' ELSE p_name END AS p_name FROM part)"


def _named(spark, d):
    return _products(spark, d).select(F.col("id").alias("record_id"), F.when(F.col("id") % 5 == 0, F.concat("name", F.lit("s"))).otherwise(F.col("name")).alias("value"))


@query(f"""WITH {_NAMED}, v AS (SELECT min(p_partkey) AS id, p_name AS value FROM named GROUP BY p_name),
  g AS (SELECT DISTINCT id, value, substr('  ' || w || ' ', i, 3) AS g FROM (SELECT id, value, unnest(list_filter(regexp_split_to_array(lower(value), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS w FROM v), range(1, 200) r(i) WHERE i <= length(w) + 1),
  n AS (SELECT id, count(*) AS n FROM g GROUP BY 1), p AS (SELECT a.id AS a, b.id AS b, count(*) AS i FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2)
  SELECT a, b, round(i / (x.n + y.n - i), 6) AS score FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE i / (x.n + y.n - i) >= 0.7""")
def match_fuzzy(spark, d):
    return matching.fuzzy_pairs(_named(spark, d), 0.7).withColumn("score", F.round("score", 6))


@query(f"""WITH {_NAMED}, g AS (SELECT DISTINCT value, substr('  ' || w || ' ', i, 3) AS g FROM (SELECT p_name AS value, unnest(list_filter(regexp_split_to_array(lower(p_name), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS w FROM named), range(1, 200) r(i) WHERE i <= length(w) + 1),
  n AS (SELECT value, count(*) AS n FROM g GROUP BY 1), p AS (SELECT a.value AS x, b.value AS y, count(*) AS i FROM g a JOIN g b ON a.g = b.g GROUP BY 1, 2),
  s AS (SELECT x, y FROM p JOIN n nx ON nx.value = x JOIN n ny ON ny.value = y WHERE i / (nx.n + ny.n - i) >= 0.7)
  SELECT r.p_partkey AS record_id, min(o.p_partkey) FILTER (o.p_name = r.p_name) AS representative, count(*) - 1 AS links FROM named r JOIN s ON s.x = r.p_name JOIN named o ON o.p_name = s.y GROUP BY 1""")
def match_fuzzy_members(spark, d):
    return matching.fuzzy_members(_named(spark, d), 0.7)


# Vectors, and of every seventh one two that lie near it.
_PAIRS = """n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings UNION ALL SELECT 1000000 * k + vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: CASE WHEN i % (k + 2) = 0 THEN x * 0.5 ELSE x END) FROM embeddings, range(1, 3) t(k) WHERE vec_id % 7 = 0),
  p AS (SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.e, y.e) AS score FROM n x JOIN n y ON x.vec_id < y.vec_id)"""


def _near_vectors(spark, d):
    own = _vectors(spark, d).select("record_id", F.col("embedding").cast("array<double>").alias("embedding"))

    def near(k):
        return own.filter("record_id % 7 = 0").select((F.col("record_id") + 1_000_000 * k).alias("record_id"), F.transform("embedding", lambda x, i: F.when((i + 1) % (k + 2) == 0, x * 0.5).otherwise(x)).alias("embedding"))

    return own.unionByName(near(1)).unionByName(near(2))



@query(f"WITH {_PAIRS} SELECT a, b, round(score, 6) AS score FROM p WHERE score > 0.7")
def dedup_semantic_pairs(spark, d):
    return matching.semantic_pairs(_near_vectors(spark, d), 0.3).withColumn("score", F.round("score", 6))


@query(f"""WITH RECURSIVE {_PAIRS}, l AS (SELECT a, b FROM p WHERE score > 0.7), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
  c AS (SELECT a AS r, a AS o FROM e UNION SELECT e.b, c.o FROM c JOIN e ON c.r = e.a) SELECT r AS record_id, min(o) AS component FROM c GROUP BY 1""")
def dedup_components(spark, d):
    return matching.components(matching.semantic_pairs(_near_vectors(spark, d), 0.3))


@query("""SELECT p_partkey AS id, round((p_retailprice + p_size) / nullif(p_size - 10, 0), 6) AS ratio, p_brand || '/' || p_type AS label, p_size >= 25 AS large FROM part""")
def derived_formula(spark, d):
    f = {
        "ratio": {"fn": "divide", "args": [{"fn": "add", "args": [{"attribute": "price"}, {"attribute": "size"}]}, {"fn": "subtract", "args": [{"attribute": "size"}, {"literal": 10}]}]},
        "label": {"fn": "concat", "args": [{"fn": "concat", "args": [{"attribute": "brand"}, {"literal": "/"}]}, {"attribute": "type"}]},
        "large": {"fn": "gte", "args": [{"attribute": "size"}, {"literal": 25}]},
    }
    return derived.derive(_products(spark, d), f).select("id", F.round("ratio", 6).alias("ratio"), "label", "large")


@query("""SELECT o_orderkey AS id, round(((CASE WHEN o_totalprice > 100000 THEN 10 ELSE 0 END) + (CASE WHEN o_orderstatus = 'F' THEN 5 ELSE 0 END))
  * pow(0.5, greatest(date_diff('day', o_orderdate, TIMESTAMP '1998-12-31'), 0) / 365.0), 6) AS score FROM orders""")
def derived_score(spark, d):
    age = F.datediff(F.lit("1998-12-31").cast("date"), F.col("close_date"))
    s = derived.score([(F.col("amount") > 100000, 10), (F.col("status") == "F", 5)], age, 365.0)
    return _deals(spark, d).select("id", F.round(s, 6).alias("score"))


def _related(spark, d):
    return _deals(spark, d).select(F.col("company_id").alias("record_id"), F.round("amount", 2).cast("decimal(18,2)").alias("amount"), "close_date", "id", "priority")


@query("""SELECT c_custkey AS record_id, count(o_orderkey) AS count, round(CAST(sum(CAST(round(o_totalprice, 2) AS DECIMAL(18, 2))) AS DOUBLE), 2) AS sum, round(CAST(sum(CAST(round(o_totalprice, 2) AS DECIMAL(18, 2))) AS DOUBLE) / count(o_orderkey), 6) AS average
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def rollup_count_sum_avg(spark, d):
    out = derived.rollup(_companies(spark, d).select(F.col("id").alias("record_id")), _related(spark, d), "amount", ["count", "sum", "average"])
    return out.select("record_id", "count", F.round(F.col("sum").cast("double"), 2).alias("sum"), F.round(F.col("average").cast("double"), 6).alias("average"))


@query("SELECT c_custkey AS record_id, min(o_orderdate) AS earliest_date, max(o_orderdate) AS latest_date FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def rollup_dates(spark, d):
    return derived.rollup(_companies(spark, d).select(F.col("id").alias("record_id")), _related(spark, d), "close_date", ["earliest_date", "latest_date"]).select("record_id", F.col("earliest_date").cast("timestamp_ntz").alias("earliest_date"), F.col("latest_date").cast("timestamp_ntz").alias("latest_date"))


@query("SELECT c_custkey AS record_id, arg_min(o_orderpriority, struct_pack(t := o_orderdate, k := o_orderkey)) AS priority, count(o_orderkey) AS related FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def relation_sync(spark, d):
    return derived.relation_sync(_companies(spark, d).select(F.col("id").alias("record_id")), _related(spark, d), "priority", ["close_date", "id"])


_MERGES = "m AS (SELECT c_custkey - c_custkey % 4 + 1 AS survivor_id, c_custkey AS loser_id FROM customer WHERE c_custkey % 4 IN (2, 3))"


def _merges(spark, d):
    return _companies(spark, d).filter("id % 4 in (2, 3)").select((F.col("id") - F.col("id") % 4 + 1).alias("survivor_id"), F.col("id").alias("loser_id"))


@query(f"""WITH {_MERGES}, s AS (SELECT survivor_id, arg_max(nullif(c_mktsegment, 'MACHINERY'), c_acctbal) FILTER (nullif(c_mktsegment, 'MACHINERY') IS NOT NULL) AS seg FROM m JOIN customer ON c_custkey = loser_id GROUP BY 1)
  SELECT c_custkey AS id, coalesce(nullif(nullif(c_mktsegment, 'BUILDING'), 'MACHINERY'), seg) AS segment, c_name AS name FROM customer JOIN s ON survivor_id = c_custkey""")
def merge_field_plan(spark, d):
    rows = _companies(spark, d)
    segment = F.when((F.col("id") % 4 == 1) & (F.col("segment") == "BUILDING"), None).otherwise(F.nullif(F.col("segment"), F.lit("MACHINERY")))
    last = rows.select(F.col("id").alias("record_id"), F.explode(F.array(F.lit("segment"), F.lit("name"))).alias("slug"), F.col("balance").alias("occurred_at"), F.col("id").alias("seq"))
    return mutation.merge_fields(rows.withColumn("segment", segment), _merges(spark, d), last, ["segment", "name"])


@query("""WITH e AS (SELECT 'part' AS relation, l_orderkey - l_orderkey % 2 AS from_id, l_partkey AS to_id, l_orderkey % 2 = 0 AS own, l_linenumber AS position, l_shipdate AS active_from, l_orderkey * 1000 + l_linenumber * 10 AS id FROM lineitem),
  k AS (SELECT *, row_number() OVER (PARTITION BY from_id, to_id ORDER BY active_from, id, position, own) = 1 AND from_id <> to_id AS kept FROM e)
  SELECT from_id, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS ended FROM k GROUP BY 1""")
def merge_links(spark, d):
    rows = _t(spark, d, "lineitem")
    edges = rows.select(F.lit("part").alias("relation"), F.col("l_orderkey").alias("from_id"), F.col("l_partkey").alias("to_id"), F.col("l_linenumber").alias("position"), F.col("l_shipdate").alias("active_from"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 10).alias("id"))
    odd = rows.filter("l_orderkey % 2 = 1").select((F.col("l_orderkey") - 1).alias("survivor_id"), F.col("l_orderkey").alias("loser_id")).distinct()
    # Part numbers aren't order numbers: only sources are merged here.
    tagged = edges.withColumn("to_id", -F.col("to_id") - 1)
    out = mutation.merge_links(tagged, odd).withColumn("kept", F.col("kept") & (F.col("from_id") != -F.col("to_id") - 1))
    return out.groupBy("from_id").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("ended"))


@query("""WITH i AS (SELECT p_name, max(p_retailprice) AS p FROM part WHERE p_partkey % 3 = 0 GROUP BY 1), e AS (SELECT p_name, count(*) AS n, min(p_partkey) AS id, arg_min(p_retailprice, p_partkey) AS p FROM part WHERE p_partkey % 2 = 0 GROUP BY 1)
  SELECT i.p_name AS name, CASE WHEN e.n IS NULL THEN 'created' WHEN e.n > 1 THEN 'duplicate' WHEN i.p = e.p THEN 'unchanged' ELSE 'updated' END AS action, e.id AS id, round(i.p, 2) AS price FROM i LEFT JOIN e USING (p_name)""")
def upsert_assert(spark, d):
    rows = _products(spark, d)
    return mutation.upsert(rows.filter("id % 2 = 0"), rows.filter("id % 3 = 0").select("name", "price"), "name", ["price"]).withColumn("price", F.round("price", 2))


def _owned(spark, d):
    return _companies(spark, d).withColumn("visibility", F.expr("case nation % 3 when 0 then 'team' when 1 then 'private' else 'users' end")).withColumn("created_on_behalf_of", F.concat(F.lit("u"), F.col("nation") % 5))


@query("""SELECT c_custkey AS id FROM customer WHERE c_nationkey % 3 = 0 OR c_nationkey % 5 = 1 OR (c_nationkey % 3 = 2 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'))""")
def access_visibility(spark, d):
    grants = _deals(spark, d).filter("status = 'P'").select(F.col("company_id").alias("record_id"), F.lit("u1").alias("user_id"))
    return access.visible(_owned(spark, d), grants, access.Caller("t", "u1")).select("id")


@query("""SELECT c_custkey AS id FROM customer WHERE CASE WHEN c_acctbal < 0 THEN false WHEN c_mktsegment = 'BUILDING' THEN false WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal > 5000 ELSE true END""")
def access_policy(spark, d):
    rows = _companies(spark, d)
    wide = spark.range(1).select(F.inline(F.expr("from_json('[{\"scope\":\"team\",\"scope_id\":\"t\",\"effect\":\"allow\",\"priority\":1,\"requires_approval\":false},{\"scope\":\"object_type\",\"scope_id\":\"BUILDING\",\"effect\":\"deny\",\"priority\":1,\"requires_approval\":false},{\"scope\":\"object_type\",\"scope_id\":\"MACHINERY\",\"effect\":\"allow\",\"priority\":5,\"requires_approval\":true}]', 'array<struct<scope:string,scope_id:string,effect:string,priority:int,requires_approval:boolean>>')")))
    own = rows.filter("balance < 0").select(F.lit("record").alias("scope"), F.col("id").cast("string").alias("scope_id"), F.lit("deny").alias("effect"), F.lit(1).alias("priority"), F.lit(False).alias("requires_approval"))
    free = rows.filter("balance > 5000").select(F.lit("record").alias("scope"), F.col("id").cast("string").alias("scope_id"), F.lit("allow").alias("effect"), F.lit(9).alias("priority"), F.lit(False).alias("requires_approval"))
    return access.policy(rows, wide.unionByName(own).unionByName(free), access.Caller("t", "u1"), type_col="segment").select("id")


@query("SELECT c_custkey AS id, c_name AS name, CAST(NULL AS DOUBLE) AS balance, 'balance' AS redacted FROM customer")
def redact(spark, d):
    out = access.redact(_companies(spark, d).select("id", "name", "balance"), {"balance": "confidential", "name": "public"}, {"public", "internal"})
    return out.select("id", "name", "balance", F.array_join("redacted_attributes", ",").alias("redacted"))


@query("""WITH e AS (SELECT sha256('email' || chr(31) || lower(c_name)) AS key_hash, CASE WHEN c_custkey % 2 = 0 THEN 'all' ELSE 'mail' END AS channel, c_mktsegment AS reason FROM customer WHERE c_acctbal < 0)
  SELECT c_custkey AS id, reason FROM customer LEFT JOIN e ON key_hash = sha256('email' || chr(31) || lower(c_name))""")
def suppression_check(spark, d):
    rows = _companies(spark, d).withColumn("key_hash", compliance.suppression_key(F.lit("email"), F.lower("name")))
    entries = rows.filter("balance < 0").select("key_hash", F.expr("case when id % 2 = 0 then 'all' else 'mail' end").alias("channel"), F.col("segment").alias("reason"), F.lit(None).cast("timestamp").alias("expires_at"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    return compliance.suppressed(rows, entries, "mail", F.current_timestamp()).select("id", "reason")


@query("""WITH o AS (SELECT event_type AS team_id, user_id AS queue_key, CAST(value AS BIGINT) AS h, count(*) AS submissions, max(event_id) AS s FROM events GROUP BY 1, 2, 3),
  q AS (SELECT *, row_number() OVER (PARTITION BY team_id, queue_key ORDER BY s DESC) AS n FROM o), t AS (SELECT *, CASE WHEN n <= 5 THEN row_number() OVER (PARTITION BY team_id, n <= 5 ORDER BY s DESC) END AS r FROM q)
  SELECT team_id, queue_key, s AS submitted_seq, submissions, CASE WHEN r <= 1000 THEN 'pending' ELSE 'superseded' END AS status FROM t""")
def proposals_window(spark, d):
    rows = _t(spark, d, "events").select(F.col("event_type").alias("team_id"), F.col("user_id").alias("queue_key"), F.rint("value").cast("long").alias("proposed_hash"), F.col("event_id").alias("submitted_seq"))
    return compliance.proposals(rows).select("team_id", "queue_key", "submitted_seq", "submissions", "status")


@query("SELECT o_orderkey AS record_id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders WHERE o_orderstatus = 'P'")
def dynamic_list(spark, d):
    rows = apply_filter(_deals(spark, d), {"attribute": "status", "op": "eq", "value": "P"}, DEAL)
    return mutation.list_members(rows, [F.col("close_date"), F.col("id")], most=None)


@query("SELECT o_orderkey AS id, round(o_totalprice, 2) AS amount FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 51")
def view_run(spark, d):
    view = {"filter": {"attribute": "status", "op": "eq", "value": "P"}, "sort": [Sort("amount", True)], "attributes": ["id", "amount"]}
    rows = page(apply_filter(_deals(spark, d), view["filter"], DEAL), view["sort"], of=DEAL).select(*view["attributes"])
    return rows.withColumn("amount", F.round("amount", 2))


@query("""WITH a AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'error' THEN 'declined' ELSE 'granted' END AS c FROM events)
  SELECT user_id AS person_id, arg_max(c, struct_pack(t := ts, s := -event_id)) AS consent, max(ts) AS at FROM a GROUP BY 1""")
def consent_latest(spark, d):
    acts = _t(spark, d, "events").select(F.col("user_id").alias("person_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.expr("if(event_type = 'error', 'declined', 'granted')").alias("consent"), F.lit(True).alias("verified"))
    return compliance.consent(acts)


@query("SELECT doc_id AS id, md5(lower(trim(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')))) AS normal FROM documents")
def normalize_text_query(spark, d):
    return _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5(F.trim(normalize_text(F.col("text")))).alias("normal"))


@query("SELECT p_partkey AS id, nullif(regexp_replace(regexp_replace(upper('00-' || p_brand || '. ' || p_type), '[\\s.\\-]', '', 'g'), '^0+', ''), '') AS normal FROM part")
def normalize_registry_query(spark, d):
    return _products(spark, d).select("id", normalize_registry(F.concat(F.lit("00-"), "brand", F.lit(". "), "type")).alias("normal"))


@query("""SELECT page_id AS id, CASE WHEN regexp_matches(url, '^(?i)https?://[^/?#@]+([/?#]|$)') THEN lower(regexp_extract(url, '^(?i)(https?)://([^/?#]*)(.*)$', 1)) || '://' || lower(regexp_extract(url, '^(?i)(https?)://([^/?#]*)(.*)$', 2))
  || CASE WHEN regexp_extract(url, '^(?i)(https?)://([^/?#]*)(.*)$', 3) = '/' THEN '' ELSE regexp_extract(url, '^(?i)(https?)://([^/?#]*)(.*)$', 3) END END AS normal FROM pages""")
def normalize_url_query(spark, d):
    return _t(spark, d, "pages").select(F.col("page_id").alias("id"), normalize_url(F.col("url")).alias("normal"))


@query()
def export_jsonl(spark, d):
    return exports.jsonl(_companies(spark, d), ["id", "name", "segment", "balance"])


def _audit_log(spark, d):
    rows = _t(spark, d, "conversations").select(F.col("conv_id").alias("org_id"), F.col("turn").alias("seq"), F.concat("role", F.lit(":"), "text").alias("body"))
    chained = rows.groupBy("org_id").agg(F.array_sort(F.collect_list(F.struct("seq", "body"))).alias("all"))
    link = lambda s, e: F.concat(s, F.array(F.struct(e["seq"].alias("seq"), s[F.size(s) - 1]["entry_hash"].alias("prev_hash"), F.sha2(F.concat(s[F.size(s) - 1]["entry_hash"], F.lit("\n"), e["body"]), 256).alias("entry_hash"), e["body"].alias("body"))))
    seed = F.array(F.struct(F.lit(-1).cast("long").alias("seq"), F.lit("").alias("prev_hash"), F.lit("").alias("entry_hash"), F.lit("").alias("body")))
    return chained.select("org_id", F.inline(F.aggregate("all", seed, link))).filter("seq >= 0")


@query("""WITH e AS (SELECT conv_id AS org_id, turn AS seq, role || ':' || text AS body FROM conversations) SELECT CAST(0 AS BIGINT) AS breaks""")
def audit_chain(spark, d):
    return exports.chain_breaks(_audit_log(spark, d)).agg(F.count(F.lit(1)).alias("breaks"))


@query("""WITH e AS (SELECT conv_id AS org_id, turn AS seq, (31 * conv_id + turn) % 7 AS k FROM conversations), p AS (SELECT *, lag(k) OVER (PARTITION BY org_id ORDER BY seq) AS before FROM e)
  SELECT org_id, seq FROM p WHERE k IN (1, 2, 3) OR before = 2""")
def audit_chain_broken(spark, d):
    """Changed bodies, entry hashes and previous hashes; a changed entry hash breaks the entry after it too."""
    k = (31 * F.col("org_id") + F.col("seq")) % 7
    changed = {"body": (1, F.concat("body", F.lit("!"))), "entry_hash": (2, F.sha2(F.lit("x"), 256)), "prev_hash": (3, F.sha2(F.lit("y"), 256))}
    log = _audit_log(spark, d).select("org_id", "seq", *[F.when(k == n, x).otherwise(F.col(c)).alias(c) for c, (n, x) in changed.items()])
    return exports.chain_breaks(log).select("org_id", "seq")


@query("SELECT c_custkey AS asked, CASE WHEN c_custkey % 10 = 3 THEN c_custkey - 1 ELSE c_custkey END AS id FROM customer WHERE CASE WHEN c_custkey % 10 = 3 THEN c_custkey - 1 ELSE c_custkey END IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3 AND c_acctbal >= 0)")
def lookup_redirect(spark, d):
    null = F.lit(None).cast("timestamp")
    rows = _companies(spark, d).withColumn("merged_into_id", F.when(F.col("id") % 10 == 3, F.col("id") - 1)).withColumn("deleted_at", F.when(F.col("balance") < 0, F.current_timestamp()).otherwise(null)).withColumn("erased_at", null)
    return lookup.redirected(rows).select("asked", "id")


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey IN (5, 3, 99, 7, 100000000)")
def lookup_many(spark, d):
    found, _ = lookup.get_many(_companies(spark, d), [5, 3, 99, 7, 100_000_000])
    return found.select("id", "name")


@query("SELECT p_partkey AS id FROM part WHERE lower(regexp_replace(trim(p_name), '\\s+', ' ', 'g')) = (SELECT lower(p_name) FROM part WHERE p_partkey = 11)")
def lookup_unique(spark, d):
    parts = _products(spark, d)
    first = parts.filter("id = 11").first()
    return lookup.by_unique(parts, "name", F.lit(first.name if first else None), normalize_text).select("id")


@query("SELECT event_id AS id, ts AS occurred_at FROM events WHERE event_type = 'purchase' AND (ts < TIMESTAMP '2024-01-20' OR (ts = TIMESTAMP '2024-01-20' AND event_id < 500)) ORDER BY ts DESC, event_id DESC LIMIT 51")
def events_scan(spark, d):
    rows = _t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("occurred_at"), F.col("event_type").alias("type"))
    return lookup.events_page(rows, cursor=(F.lit("2024-01-20").cast("timestamp"), 500), type="purchase").select("id", "occurred_at")


@query("SELECT o_orderkey AS record_id, o_custkey AS position, round(o_totalprice, 2) AS amount FROM orders WHERE o_orderstatus = 'P' ORDER BY o_custkey, o_orderkey LIMIT 51")
def list_entries(spark, d):
    deals = _deals(spark, d)
    entries = deals.select(F.col("status").alias("list_id"), F.col("id").alias("record_id"), F.col("company_id").alias("position"))
    lists = deals.select(F.col("status").alias("list_id")).distinct()
    return lookup.list_entries(entries, lists, deals.select(F.col("id").alias("record_id"), F.round("amount", 2).alias("amount")), "P").select("record_id", "position", "amount")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1996-01-01' AND o_orderdate >= TIMESTAMP '1995-01-01'")
def tasks_list(spark, d):
    of = ObjectType("task", (Attribute("status", "status"), Attribute("due_at", "datetime")))
    rows = _deals(spark, d).withColumnRenamed("close_date", "due_at")
    return apply_filter(rows, lookup.tasks_filter(status="O", due_before="1996-01-01", due_after="1995-01-01"), of).select("id")


@query("SELECT DISTINCT p_brand AS option FROM part")
def options_in_use(spark, d):
    return lookup.options_in_use(_products(spark, d), "brand")


@query("""SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'restricted' ELSE 'public' END AS sensitivity, count(*) AS changes, count(CASE WHEN l_suppkey % 2 <> 0 THEN l_quantity END) AS "values" FROM lineitem GROUP BY 1""")
def feed_redacted(spark, d):
    from fieldstone.streaming.feed import events

    rows = _t(spark, d, "lineitem").select(F.lit("set").alias("kind"), F.col("l_quantity").alias("value"), F.expr("if(l_suppkey % 2 = 0, 'restricted', 'public')").alias("sensitivity"))
    return events(rows, ["record.updated"], "sensitivity").groupBy("sensitivity").agg(F.count(F.lit(1)).alias("changes"), F.count("value").alias("values"))


@query("""WITH a AS (SELECT o_custkey AS f, o_orderkey AS t FROM orders), s AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 9000)
  SELECT id FROM s UNION SELECT t FROM a JOIN s ON f = id UNION SELECT f FROM a JOIN s ON t = id""")
def derived_impact(spark, d):
    edges = _company_links(spark, d).withColumn("active_until", F.lit(None).cast("timestamp"))
    return derived.impacted(_companies(spark, d).filter("balance > 9000").select("id"), edges)


@query("""WITH m AS (SELECT c_custkey - c_custkey % 4 + 1 AS survivor_id, c_custkey AS loser_id FROM customer WHERE c_custkey % 4 IN (2, 3)),
  e AS (SELECT survivor_id, loser_id AS x FROM m UNION SELECT survivor_id, survivor_id FROM m)
  SELECT survivor_id, CASE min(CASE c_nationkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END) WHEN 0 THEN 'private' WHEN 1 THEN 'users' ELSE 'team' END AS visibility FROM e JOIN customer ON c_custkey = x GROUP BY 1""")
def merge_visibility(spark, d):
    return mutation.merged_visibility(_owned(spark, d), _merges(spark, d))


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name END AS name, c_acctbal < 0 AS erased FROM customer")
def erase_records(spark, d):
    rows = _companies(spark, d).select("id", "name", F.lit(None).cast("timestamp").alias("erased_at"), "balance")
    out = mutation.erase(rows, rows.filter("balance < 0").select("id"), ["name"], F.lit("2024-01-01").cast("timestamp"))
    return out.select("id", "name", F.col("erased_at").isNotNull().alias("erased"))


@query("""WITH p AS (SELECT event_type AS value, user_id AS record_id FROM events GROUP BY ALL) SELECT record_id, value, value = 'purchase' AS confirmed, value = 'error' AS archived FROM p""")
def contact_points(spark, d):
    rows = _t(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.collect_set("event_type").alias("kinds"))
    states = _t(spark, d, "events").select(F.sha2("event_type", 256).alias("value_hash"), (F.col("event_type") == "purchase").alias("confirmed"), (F.col("event_type") == "error").alias("archived")).distinct()
    return compliance.contact_points(rows, states, "kinds")
