"""Tenant access, writes, pages, feeds, matching and search documents over the driver's tables, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldstone.catalog import Rule
from fieldstone.functions.text import canonical_json, dedupe_by, ordered_union, rfc3339
from fieldstone.operators import access, history, links, lookup, matching, search, writes

from .driver_queries import _companies, _deals, _products, _t, query

# Customers as records of several tenants, some private, shared, deleted or merged.
_RECORDS = """r AS (SELECT c_custkey AS id, 'o' || c_nationkey % 2 AS organization_id, 't' || c_nationkey % 3 AS team_id, c_mktsegment AS object_type, c_acctbal AS balance, c_nationkey AS nation, c_name AS name,
  CASE c_custkey % 4 WHEN 2 THEN 'private' WHEN 3 THEN 'users' ELSE 'team' END AS visibility, 'u' || c_custkey % 7 AS owner, c_custkey % 11 = 0 AS deleted, c_custkey % 13 = 0 AS merged FROM customer)"""


def _records(spark, d):
    at = F.lit("2024-01-01").cast("timestamp")
    return _companies(spark, d).select(
        "id", F.concat(F.lit("o"), F.col("nation") % 2).alias("organization_id"), F.concat(F.lit("t"), F.col("nation") % 3).alias("team_id"), F.col("segment").alias("object_type"), "balance", "nation", "name",
        F.expr("case id % 4 when 2 then 'private' when 3 then 'users' else 'team' end").alias("visibility"), F.concat(F.lit("u"), F.col("id") % 7).alias("created_on_behalf_of"),
        F.when(F.col("id") % 11 == 0, at).alias("deleted_at"), F.when(F.col("id") % 13 == 0, F.col("id") - 1).alias("merged_into_id"), F.lit(None).cast("timestamp").alias("erased_at"),
    )


CALLER = access.Caller("t1", "u1", organization="o1", role="member", app="app", agent="bot")
AGENT = access.Caller("t1", "u1", channel="agent", organization="o1", role="member", app="app", agent="bot")
_RULES = "rule_id string, organization_id string, team_id string, resource_type string, action string, scope string, scope_id string, effect string, priority int, requires_approval boolean, condition string"


def _policy(spark, d):
    """Rules of the tenant, the negative balances' denied one by one, and who they are bound to."""
    rules = spark.createDataFrame(
        [
            ("held", "o1", "t1", "record", "view", "object_type", "AUTOMOBILE", "allow", 9, True, None), ("free", "o1", "t1", "record", "view", "object_type", "AUTOMOBILE", "allow", 5, False, None),
            ("tied", "o1", "t1", "record", "view", "object_type", "FURNITURE", "allow", 5, True, None), ("tied", "o1", "t1", "record", "view", "object_type", "FURNITURE", "allow", 5, False, None),
            ("elsewhere", "o1", "t2", "record", "view", "team", "t1", "deny", 1, False, None), ("unbound", "o1", "t1", "record", "view", "team", "t1", "deny", 1, False, None),
            ("write", "o1", "t1", "record", "update", "team", "t1", "deny", 1, False, None), ("app", "o1", "t1", "record", "view", "team", "t1", "allow", 1, False, None),
            ("bot", "o1", "t1", "record", "view", "object_type", "MACHINERY", "deny", 1, True, None), ("secret", "o1", "t1", "attribute", "view", "object_type", "BUILDING", "deny", 1, False, "confidential"),
        ],
        _RULES,
    )
    own = _records(spark, d).filter("balance < 0").select(
        F.lit("poor").alias("rule_id"), "organization_id", "team_id", F.lit("record").alias("resource_type"), F.lit("view").alias("action"), F.lit("record").alias("scope"), F.col("id").cast("string").alias("scope_id"),
        F.lit("deny").alias("effect"), F.lit(1).alias("priority"), F.lit(False).alias("requires_approval"), F.lit(None).cast("string").alias("condition"),
    )
    bindings = spark.createDataFrame(
        [("held", "human", "u2"), ("free", "role", "member"), ("tied", "human", "u1"), ("elsewhere", "human", "u1"), ("unbound", "human", "u5"), ("write", "human", "u1"), ("poor", "role", "member"), ("secret", "human", "u1"), ("app", "agent", "agent:app:*"), ("bot", "agent", "agent:app:bot")],
        "rule_id string, actor_type string, actor_id string",
    )
    return rules.unionByName(own), bindings


_PERMITTED = "balance >= 0 AND object_type <> 'FURNITURE'"


@query(f"WITH {_RECORDS} SELECT id FROM r WHERE organization_id = 'o1' AND team_id = 't1'")
def tenant_scope(spark, d):
    return access.scoped(_records(spark, d), CALLER).select("id")


@query(f"WITH {_RECORDS} SELECT id FROM r WHERE organization_id = 'o1' AND team_id = 't1' AND {_PERMITTED}")
def policy_bindings(spark, d):
    return access.permitted(access.scoped(_records(spark, d), CALLER), *_policy(spark, d), CALLER).select("id")


@query(f"WITH {_RECORDS} SELECT id FROM r WHERE organization_id = 'o1' AND team_id = 't1' AND {_PERMITTED} AND object_type <> 'MACHINERY'")
def policy_agent(spark, d):
    return access.permitted(access.scoped(_records(spark, d), AGENT), *_policy(spark, d), AGENT).select("id")


@query(f"WITH {_RECORDS} SELECT id FROM r WHERE organization_id = 'o1' AND team_id = 't1' AND object_type <> 'BUILDING'")
def attribute_gate(spark, d):
    return access.attribute_gate(access.scoped(_records(spark, d), CALLER), *_policy(spark, d), CALLER, ["public", "confidential"]).select("id")


def _shared(spark, d):
    return _deals(spark, d).filter("status = 'P'").select(F.col("company_id").alias("record_id"), F.lit("u1").alias("user_id"))


_VISIBLE = "(visibility = 'team' OR owner = 'u1' OR visibility = 'users' AND id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')) AND NOT deleted AND NOT merged"


@query(f"WITH {_RECORDS} SELECT id FROM r WHERE organization_id = 'o1' AND team_id = 't1' AND object_type = 'AUTOMOBILE' AND {_VISIBLE} AND {_PERMITTED}")
def record_set(spark, d):
    return access.record_set(_records(spark, d), _shared(spark, d), *_policy(spark, d), CALLER, "AUTOMOBILE", reads=["public"]).select("id")


_SET = f"s AS (SELECT id FROM r WHERE organization_id = 'o1' AND team_id = 't1' AND object_type = 'MACHINERY' AND {_VISIBLE} AND {_PERMITTED})"


def _set(spark, d):
    return access.record_set(_records(spark, d), _shared(spark, d), *_policy(spark, d), CALLER, "MACHINERY")


# Orders as links from customers, ended for status F; the orders' own ids are negative.
_LINKS = """l AS (SELECT o_orderkey AS id, 'deal_company' AS relation, o_custkey AS from_id, -o_orderkey AS to_id, o_orderdate AS active_from, o_orderstatus <> 'F' AS active, o_orderpriority AS priority, o_orderstatus AS status FROM orders)"""


def _links(spark, d):
    return _t(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit("deal_company").alias("relation"), F.col("o_custkey").alias("from_id"), (-F.col("o_orderkey")).alias("to_id"), F.col("o_orderdate").alias("active_from"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("interval 30 days")).alias("active_until"), F.lit(None).cast("int").alias("position"), F.col("o_orderpriority").alias("priority"),
    )


def _unlink(spark, d):
    commands = _links(spark, d).filter("priority = '1-URGENT'")
    return writes.unlink(_links(spark, d), commands, F.lit("2025-01-01").cast("timestamp"))


@query(f"WITH {_LINKS} SELECT unnest([from_id, to_id]) AS record_id, 'unlink' AS kind, id AS group_id FROM l WHERE active AND priority = '1-URGENT'")
def unlink_changes(spark, d):
    return _unlink(spark, d)[1].select("record_id", "kind", "group_id")


@query(f"WITH {_LINKS} SELECT id, NOT active OR priority = '1-URGENT' AS ended FROM l")
def unlink_links(spark, d):
    return _unlink(spark, d)[0].select("id", F.col("active_until").isNotNull().alias("ended"))


@query(f"WITH {_LINKS} SELECT from_id, to_id FROM l WHERE NOT active AND priority = '1-URGENT'")
def unlink_missing(spark, d):
    return _unlink(spark, d)[2].select("from_id", "to_id")


@query(f"WITH {_LINKS} SELECT c_custkey AS id, CAST(1 + (SELECT count(*) FROM l WHERE from_id = c_custkey AND active AND priority = '1-URGENT') AS BIGINT) AS version FROM customer")
def unlink_versions(spark, d):
    # Companies are the from ends; the to end of order 0 is 0 as well, as is company 0, and must not move that company's version.
    changes = _unlink(spark, d)[1].filter("record_id = from_id")
    return writes.bumped(_companies(spark, d).select("id", F.lit(1).cast("long").alias("version")), changes)


def _relations(spark, archived=False):
    return spark.createDataFrame([("deal_company", "restrict", "many_to_one", archived)], "relation string, on_delete string, cardinality string, archived boolean")


@query(f"WITH {_LINKS} SELECT DISTINCT c_custkey AS id, relation FROM customer JOIN l ON from_id = c_custkey WHERE c_nationkey = 3 AND active AND to_id % 2 <> 0")
def delete_restricted(spark, d):
    start = _companies(spark, d).filter("nation = 3").select("id").union(_links(spark, d).filter("to_id % 2 = 0").select("to_id"))
    return writes.restricted(start, _links(spark, d), _relations(spark)).filter("id > 0")


def _conflicts(spark, d, reopened="priority = '2-HIGH'"):
    people = _records(spark, d).select("id", "deleted_at", "merged_into_id", "erased_at")
    both = people.unionByName(_links(spark, d).select(F.col("to_id").alias("id"), *[F.lit(None).cast(people.schema[c].dataType).alias(c) for c in people.columns[1:]]))
    closed = _links(spark, d).filter("active_until is not null").filter(reopened)
    back = _records(spark, d).filter("id % 22 = 0").select("id")
    return closed, writes.restore_conflicts(closed, back, both, _links(spark, d), _relations(spark))


@query(f"""WITH {_LINKS}, k AS (SELECT * FROM l WHERE NOT active AND priority = '2-HIGH') SELECT id, 'dead_endpoint' AS reason FROM k WHERE (from_id % 11 = 0 OR from_id % 13 = 0) AND from_id % 22 <> 0
  UNION SELECT id, 'slot_taken' FROM k WHERE from_id IN (SELECT from_id FROM l WHERE active)""")
def restore_conflicts(spark, d):
    return _conflicts(spark, d)[1]


@query(f"WITH {_LINKS}, t AS (SELECT DISTINCT from_id FROM l WHERE active) SELECT id, active OR (NOT EXISTS (SELECT 1 FROM l k WHERE k.id % 2 = 0 AND NOT k.active AND (k.from_id IN (SELECT from_id FROM t) OR (k.from_id % 11 = 0 OR k.from_id % 13 = 0) AND k.from_id % 22 <> 0)) AND id % 2 = 0) AS active FROM l")
def restore_all_or_nothing(spark, d):
    closed, conflicts = _conflicts(spark, d, "id % 2 = 0")
    return writes.restore_links(closed, _links(spark, d), conflicts).select("id", F.col("active_until").isNull().alias("active"))


@query(f"WITH {_LINKS} SELECT id, active OR priority = '3-MEDIUM' AS active FROM l")
def restore_links(spark, d):
    closed = _links(spark, d).filter("active_until is not null and priority = '3-MEDIUM'")
    none = spark.createDataFrame([], "id long, reason string")
    return writes.restore_links(closed, _links(spark, d), none).select("id", F.col("active_until").isNull().alias("active"))


@query("""SELECT event_id AS from_id, to_id, CAST(position AS INTEGER) AS position FROM (SELECT event_id, event_type AS to_id, 0 AS position FROM events UNION ALL
  SELECT event_id, 'signup', 1 FROM events WHERE event_type <> 'signup' UNION ALL SELECT event_id, 'view', CASE WHEN event_type = 'signup' THEN 1 ELSE 2 END FROM events WHERE event_type <> 'view')""")
def reference_positions(spark, d):
    rows = _t(spark, d, "events").select(F.col("event_id").alias("id"), F.array("event_type", F.lit("signup"), F.lit(None), "event_type", F.lit("view")).alias("kinds"))
    return writes.reference_links(rows, "kinds", "of_kind").select("from_id", "to_id", "position")


@query("""SELECT c_custkey AS record_id, 'create' AS kind, NULL AS slug, NULL AS value, 1 AS resulting_version FROM customer UNION ALL SELECT c_custkey, 'set', 'name', c_name, 1 FROM customer
  UNION ALL SELECT c_custkey, 'set', 'segment', c_mktsegment, 1 FROM customer WHERE c_mktsegment <> 'BUILDING'""")
def create_changes(spark, d):
    return writes.create_changes(_companies(spark, d).withColumn("segment", F.nullif(F.col("segment"), F.lit("BUILDING"))), ["name", "segment"])


@query("""SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal > 0 OR c_mktsegment = 'MACHINERY' THEN 'origin_rejected' WHEN c_custkey % 4 >= 2 AND c_nationkey % 2 = 0 THEN 'visibility_rejected' END AS error FROM customer""")
def write_guard(spark, d):
    guard = writes.Guard(True, ("MACHINERY",), ("app0",))
    rows = _records(spark, d)
    return rows.select("id", guard.error(F.nullif(F.col("object_type"), F.lit("BUILDING")), F.col("balance") > 0, F.col("visibility"), F.concat(F.lit("app"), F.col("nation") % 2)).alias("error"))


def _entries(spark, d):
    return _companies(spark, d).select((F.col("nation") % 5).alias("list_id"), F.col("id").alias("record_id"), (F.col("balance") * 100).cast("long").alias("created_at"), "id", F.col("id").cast("int").alias("position"))


@query("""WITH e AS (SELECT c_nationkey % 5 AS list_id, c_custkey AS record_id, CAST(trunc(c_acctbal * 100) AS BIGINT) AS created_at, c_custkey AS id, CASE WHEN c_custkey % 4 > 0 THEN c_custkey - c_custkey % 4 END AS s FROM customer),
  m AS (SELECT *, row_number() OVER (PARTITION BY list_id, s ORDER BY created_at, id) AS n FROM e WHERE s IS NOT NULL)
  SELECT id, list_id, record_id FROM e WHERE s IS NULL UNION ALL SELECT id, list_id, CASE WHEN n = 1 AND NOT EXISTS (SELECT 1 FROM e x WHERE x.list_id = m.list_id AND x.record_id = m.s) THEN s ELSE record_id END FROM m""")
def merge_list_entries(spark, d):
    merges = _companies(spark, d).filter("id % 4 > 0").select((F.col("id") - F.col("id") % 4).alias("survivor_id"), F.col("id").alias("loser_id"))
    return writes.merge_entries(_entries(spark, d), merges).select("id", "list_id", "record_id")


@query("""WITH e AS (SELECT c_nationkey % 5 AS list_id, c_custkey AS record_id, CAST(c_custkey AS INTEGER) AS position FROM customer WHERE c_custkey % 3 > 0),
  f AS (SELECT c_nationkey % 5 AS list_id, c_custkey AS record_id FROM customer WHERE c_custkey % 3 = 0),
  a AS (SELECT * FROM e UNION ALL SELECT list_id, record_id, CAST((SELECT max(position) FROM e WHERE e.list_id = f.list_id) + row_number() OVER (PARTITION BY list_id ORDER BY record_id) AS INTEGER) FROM f)
  SELECT * FROM a WHERE record_id % 10 <> 7""")
def list_members(spark, d):
    every = _entries(spark, d).select("list_id", "record_id", "position")
    added = writes.list_add(every.filter("record_id % 3 > 0"), every.filter("record_id % 3 = 0 or record_id % 10 = 1"))
    return writes.list_remove(added, every.filter("record_id % 10 = 7"))


@query(f"WITH {_RECORDS}, {_SET} SELECT nation % 5 AS list_id, count(*) AS entries FROM r WHERE id IN (SELECT id FROM s) GROUP BY 1")
def list_visible_counts(spark, d):
    return writes.visible_counts(_entries(spark, d), _set(spark, d))


def _proposals(spark, d):
    return _t(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.expr("case o_orderstatus when 'F' then 'amendment' else 'match' end").alias("kind"), F.expr("case o_orderpriority when '1-URGENT' then 'accepted' else 'pending' end").alias("status"),
        F.col("o_orderpriority").alias("value"), F.col("o_custkey").alias("record_id"), F.col("o_orderdate").alias("created_at"),
    )


def _decided(spark, d):
    decisions = _proposals(spark, d).filter("id % 5 < 3").select("id", F.expr("case id % 5 when 1 then 'reject' else 'accept' end").alias("decision"), F.when(F.col("id") % 5 == 2, F.col("record_id") + 1).alias("record_id"))
    return writes.decide(_proposals(spark, d), decisions)


@query("SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'accepted' WHEN o_orderkey % 5 IN (0, 2) THEN 'accepted' WHEN o_orderkey % 5 = 1 THEN 'rejected' ELSE 'pending' END AS status FROM orders")
def decide_proposals(spark, d):
    return _decided(spark, d)[0].select("id", "status")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'set' WHEN o_orderkey % 5 = 2 THEN 'pair' ELSE 'create' END AS action, CASE WHEN o_orderstatus = 'F' THEN o_custkey WHEN o_orderkey % 5 = 2 THEN o_custkey + 1 END AS record_id,
  CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS value FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_orderkey % 5 IN (0, 2)""")
def decide_writes(spark, d):
    return _decided(spark, d)[1]


@query(f"WITH {_RECORDS} SELECT id, CASE WHEN team_id = 't1' THEN 'o9' ELSE organization_id END AS organization_id FROM r")
def tenant_reparent(spark, d):
    return writes.reparent(_records(spark, d), spark.createDataFrame([("t1", "o9")], "team_id string, organization_id string")).select("id", "organization_id")


@query("""SELECT c_mktsegment AS key_hash, channel, min(c_custkey) AS created_at FROM (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN 'all' ELSE 'mail' END AS channel FROM customer) WHERE NOT (c_mktsegment = 'MACHINERY' AND channel = 'mail') GROUP BY 1, 2""")
def suppressions_change(spark, d):
    rows = _companies(spark, d).select(F.col("segment").alias("key_hash"), F.expr("case id % 2 when 0 then 'all' else 'mail' end").alias("channel"), F.lit("x").alias("reason"), F.col("id").alias("created_at"))
    added = writes.suppress(rows.filter("created_at % 3 = 0"), rows.filter("created_at % 3 > 0"))
    return writes.unsuppress(added, spark.createDataFrame([("MACHINERY", "mail")], "key_hash string, channel string")).select("key_hash", "channel", "created_at")


_AT = "TIMESTAMP '1996-01-02 00:00:00'"


@query(f"SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders WHERE o_orderpriority = '2-HIGH' AND (o_orderdate < {_AT} OR o_orderdate = {_AT} AND o_orderkey < 50) ORDER BY created_at DESC, id DESC LIMIT 51")
def files_list(spark, d):
    files = _proposals(spark, d).select("id", F.col("value").alias("target"), "created_at")
    return lookup.files_page(files, cursor=(F.lit("1996-01-02").cast("timestamp"), 50), target="2-HIGH").select("id", "created_at")


@query(f"SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'O' AND o_orderdate > {_AT} ORDER BY created_at, id LIMIT 51")
def suppressions_list(spark, d):
    entries = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("reason"), F.col("o_orderstatus").alias("channel"), F.col("o_orderdate").alias("created_at"))
    return lookup.suppressions_page(entries.filter(F.col("created_at") > F.lit("1996-01-02").cast("timestamp")), reason="2-HIGH", channel="O").select("id", "created_at")


@query(f"SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_orderstatus = 'F' AND (o_orderdate > {_AT} OR o_orderdate = {_AT} AND o_orderkey > 50) ORDER BY created_at, id LIMIT 51")
def proposals_list(spark, d):
    return lookup.proposals_page(_proposals(spark, d), cursor=(F.lit("1996-01-02").cast("timestamp"), 50), status="pending", kind="amendment").select("id", "created_at")


@query("SELECT c_custkey AS id FROM customer WHERE c_nationkey % 3 = 1 AND c_acctbal > 0")
def webhooks_list(spark, d):
    return lookup.webhooks(_records(spark, d).withColumn("enabled", F.col("balance") > 0), "t1", True).select("id")


def _log(spark, d):
    kind = F.expr("case event_type when 'signup' then 'create' when 'purchase' then 'link' when 'error' then 'schema_change' else 'set' end")
    return _t(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("event_id").alias("seq"), F.col("user_id").alias("record_id"), F.col("event_type").alias("slug"), "value", F.col("ts").alias("occurred_at"), kind.alias("kind"),
        F.col("user_id").alias("from_id"), (F.col("user_id") + 1).alias("to_id"), F.concat(F.lit("type"), F.col("user_id") % 3).alias("object_type"),
    )



@query("""WITH h AS (SELECT event_id AS id, ts AS occurred_at, event_type AS slug, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE user_id = (SELECT min(user_id) FROM events) AND event_type IN ('click', 'purchase'))
  SELECT id, slug, occurred_at FROM h WHERE n > 2 ORDER BY n LIMIT 51""")
def history_keyset(spark, d):
    log = _log(spark, d)
    first = log.agg(F.min("record_id")).first()[0]
    *_, last = history.history_page(log, first, ["click", "purchase"], limit=1).collect()
    return history.history_page(log, first, ["click", "purchase"], cursor=(last.occurred_at, last.seq, last.id)).select("id", "slug", "occurred_at")


@query("SELECT event_id AS id, event_type AS slug, CAST(list_position([5, 3, 9, 100000000], event_id) - 1 AS INTEGER) AS nth FROM events WHERE event_id IN (5, 3, 9, 100000000)")
def changes_by_ids(spark, d):
    return history.changes_by_ids(_log(spark, d), [5, 3, 9, 100_000_000]).select("id", "slug", "nth")


@query(f"""WITH {_LINKS}, b AS (SELECT from_id FROM l WHERE active GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
  o AS (SELECT id, to_id, active_from, row_number() OVER (ORDER BY active_from DESC, id DESC) AS n FROM l WHERE active AND to_id % 3 <> 0 AND from_id = (SELECT from_id FROM b)) SELECT id, to_id FROM o WHERE n > 2""")
def links_keyset(spark, d):
    own = _links(spark, d)
    busiest = own.filter("active_until is null").groupBy("from_id").count().orderBy(F.desc("count"), "from_id").first().from_id
    seen = own.filter("to_id % 3 <> 0").select("to_id")
    *_, last = links.links_page(own, busiest, visible=seen, limit=1).collect()
    return links.links_page(own, busiest, visible=seen, limit=200, cursor=(F.lit(last.active_from), last.id)).select("id", "to_id")


@query("""WITH s AS (SELECT * FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 600) SELECT event_id AS seq FROM s WHERE user_id % 2 = 0""")
def feed_pull(spark, d):
    return history.pull(_log(spark, d), 100, 1_000_000_000, F.col("record_id") % 2 == 0, batch=60)[0].select("seq")


@query("""WITH s AS (SELECT * FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 600) SELECT max(event_id) AS cursor, max(event_id) < 1000000000 AS has_more FROM s
  UNION ALL SELECT 700, false""")
def feed_cursor(spark, d):
    moved = history.pull(_log(spark, d), 100, 1_000_000_000, F.col("record_id") % 2 == 0, batch=60)[1]
    head = history.pull(_log(spark, d), None, 700, F.lit(True))[1]
    return moved.select(F.col("cursor").cast("long").alias("cursor"), "has_more").unionByName(head.select(F.col("cursor").cast("long").alias("cursor"), "has_more"))


@query("SELECT event_id AS id FROM events WHERE user_id IN (3, 4) OR event_type = 'purchase' AND user_id + 1 IN (3, 4) OR event_type = 'error' AND user_id % 3 = 2")
def feed_watch(spark, d):
    return history.watched(_log(spark, d), [3, 4], ["type2"]).select("id")


@query("""WITH n AS (SELECT max(ts) AS t FROM events), s AS (SELECT user_id, max(ts) AS seen FROM events WHERE event_id % 7 = 0 GROUP BY 1)
  SELECT c_custkey AS id FROM customer JOIN s ON s.user_id = c_custkey, n WHERE seen >= t - INTERVAL 24 HOUR""")
def feed_fresh(spark, d):
    events = _t(spark, d, "events")
    now = events.agg(F.max("ts")).first()[0]
    seen = events.filter("event_id % 7 = 0").groupBy("user_id").agg(F.max("ts").alias("last_seen_at")).select(F.lit("t").alias("team_id"), "user_id", "last_seen_at")
    hooks = _companies(spark, d).select("id", F.lit("t").alias("team_id"), F.col("id").alias("user_id"))
    return history.fresh(hooks, seen, F.lit(now), days=1).select("id")


@query("SELECT p_size AS rule_position, CASE WHEN p_partkey % 3 > 0 THEN round(p_retailprice, 2) END AS score, p_partkey AS record_id FROM part ORDER BY 1, 2 DESC NULLS LAST, 3 LIMIT 20")
def candidate_order(spark, d):
    rows = _products(spark, d).select(F.col("size").alias("rule_position"), F.when(F.col("id") % 3 > 0, F.round("price", 2)).alias("score"), F.col("id").alias("record_id"))
    return matching.ordered_candidates(rows)


_BRAND = "b AS (SELECT p_partkey AS record_id, 'brand' AS rule_id, sha256(length(lower(p_brand)) || ':' || lower(p_brand)) AS hash FROM part)"
BRAND = Rule("brand", ("brand",))


def _old_keys(spark, d):
    return matching.match_keys(_products(spark, d).filter("id % 4 > 0").withColumn("brand", F.when(F.col("id") % 4 == 1, "old").otherwise(F.col("brand"))), BRAND)


@query(f"WITH {_BRAND} SELECT * FROM b WHERE record_id % 4 < 2")
def keys_backfill(spark, d):
    return matching.backfill(_products(spark, d), BRAND, _old_keys(spark, d))


@query(f"WITH {_BRAND} SELECT * FROM b")
def keys_recompute(spark, d):
    return matching.recomputed(_old_keys(spark, d), _products(spark, d), BRAND)


@query("""SELECT 'brand' AS rule_id, (SELECT count(*) FROM part WHERE p_partkey % 4 < 2) AS missing, (SELECT count(*) FROM (SELECT 1 FROM part WHERE p_partkey % 4 > 0 GROUP BY CASE WHEN p_partkey % 4 = 1 THEN 'old' ELSE p_brand END HAVING count(*) > 1)) AS collisions, 'pending_backfill' AS state
  UNION ALL SELECT 'brand', 0, (SELECT count(*) FROM (SELECT 1 FROM part GROUP BY p_brand HAVING count(*) > 1)), 'collision_blocked' UNION ALL SELECT 'brand', 0, (SELECT count(*) FROM (SELECT 1 FROM part GROUP BY p_brand HAVING count(*) > 1)), 'active'""")
def rule_generations(spark, d):
    rows, old = _products(spark, d), _old_keys(spark, d)
    new = matching.recomputed(old, rows, BRAND)
    return matching.generation_state(BRAND, rows, old, True).unionByName(matching.generation_state(BRAND, rows, new, True)).unionByName(matching.generation_state(BRAND, rows, new, False))


@query("""WITH RECURSIVE k AS (SELECT p_partkey AS id, p_brand || '|' || p_size || '|' || p_type AS k FROM part), f AS (SELECT k.id AS a, min(o.id) AS b FROM k JOIN k o USING (k) GROUP BY 1)
  SELECT a AS record_id, b AS component FROM f WHERE EXISTS (SELECT 1 FROM k x JOIN k y USING (k) WHERE x.id = a AND y.id <> a)""")
def dedup_job(spark, d):
    return matching.dedup_job(matching.match_keys(_products(spark, d), Rule("same", ("brand", "size", "type"), "exact")))


@query("""SELECT c_custkey AS record_id, concat_ws(' · ', c_name, c_mktsegment, (SELECT c_name FROM customer n WHERE n.c_custkey = c.c_custkey + 2), (SELECT c_name FROM customer n WHERE n.c_custkey = c.c_custkey + 1)) AS content FROM customer c""")
def search_documents(spark, d):
    rows = _companies(spark, d)
    near = rows.select(F.col("id").alias("from_id"), F.explode(F.array(F.struct(F.lit("near").alias("relation"), F.lit(None).cast("int").alias("position"), (F.col("id") + 1).alias("to_id")), F.struct(F.lit("near").alias("relation"), F.lit(0).alias("position"), (F.col("id") + 2).alias("to_id")))).alias("l")).select("from_id", "l.*")
    return search.search_documents(rows, ["name", "segment"], near).select("record_id", "content")


@query(f"WITH {_RECORDS}, {_SET} SELECT id AS record_id, round(balance, 2) AS score FROM r WHERE id IN (SELECT id FROM s) ORDER BY balance DESC, id LIMIT 50")
def search_visible(spark, d):
    hits = _records(spark, d).select(F.col("id").alias("record_id"), F.col("balance").alias("score"))
    return search.visible_search(hits, _set(spark, d)).withColumn("score", F.round("score", 2))


@query("SELECT p_partkey AS id, CASE WHEN lower(trim(p_name)) = lower(p_brand) THEN p_name || '|z' ELSE p_name || '|' || p_brand || '|z' END AS kept, p_brand || '|' || p_name || '|Q' AS merged FROM part")
def array_forms(spark, d):
    rows = _products(spark, d)
    kept = dedupe_by(F.array(F.col("name"), F.concat(F.lit(" "), F.upper("name")), F.col("brand"), F.lit("z"), F.col("brand"), F.lit(" Z ")))
    merged = ordered_union(F.array(F.array(F.col("brand")), F.lit(None).cast("array<string>"), F.array(F.lower("brand"), F.col("name")), F.array(F.lit("Q"), F.lit("q"))))
    return rows.select("id", F.array_join(kept, "|").alias("kept"), F.array_join(merged, "|").alias("merged"))


@query("""SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(millisecond(ts) % 1000 AS VARCHAR), 3, '0') || 'Z' WHEN 1 THEN strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S.000Z') END AS at FROM events""")
def datetimes(spark, d):
    shown = F.when(F.col("id") % 4 == 0, F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).when(F.col("id") % 4 == 1, F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'+02:00'")).when(F.col("id") % 4 == 2, F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.lit("2024-01-01T25:00:00Z"))
    rows = _t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"))
    return rows.select("id", F.date_format(rfc3339(shown), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("at"))


@query("""SELECT c_custkey AS id, '{"a":"' || c_nationkey || '","b":"' || c_name || '","z":"' || c_mktsegment || '"}' AS json FROM customer""")
def canonical_maps(spark, d):
    return _companies(spark, d).select("id", canonical_json(F.create_map(F.lit("z"), "segment", F.lit("a"), F.col("nation").cast("string"), F.lit("b"), "name")).alias("json"))
