"""Record operators on small frames with known answers, and the driver's queries against their SQL."""

import datetime as dt
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from fieldstone.catalog import Attribute, Catalog, ObjectType, Relation, Rule, SpecError, typed_projection
from fieldstone.functions import text
from fieldstone.operators import access, activities, compliance, data_quality, derived, history, links, matching, mutation, pipeline, search
from fieldstone.plans import driver_queries, record_queries, team_queries, views  # noqa: F401  the latter register their queries
from fieldstone.plans.filters import Sources, apply_filter
from fieldstone.plans.paging import Sort, after, order, page, seal, unseal
from fieldstone.sources import exports
from fieldstone.streaming import feed

T = dt.datetime
PERSON = ObjectType("person", (
    Attribute("name"), Attribute("age", "number"), Attribute("emails", "email", multi=True), Attribute("amount", "currency", fixed_currency="EUR"), Attribute("company", "record_reference", relation="works_at"),
    Attribute("full", "personal_name"), Attribute("old", archived=True), Attribute("extra", "json"), Attribute("percent", "percent"),
))


@pytest.fixture(scope="module")
def people(spark):
    rows = [
        (1, "Ann", 30, ["a@x.org"], "2024-01-01", "team", '{"amount": "10.50", "currency": "EUR"}', 10.0),
        (2, "bob", None, [], "2024-01-02", "private", None, 20.0),
        (3, None, 40, ["b@x.org", "c@x.org"], "2024-01-03", "users", '{"amount": "7", "currency": "EUR"}', None),
        (4, "Anna", 30, None, None, "team", None, 5.0),
    ]
    df = spark.createDataFrame(rows, "id long, name string, age int, emails array<string>, at string, visibility string, money string, percent double")
    return df.withColumn("created_at", F.col("at").cast("timestamp")).withColumn("age", F.col("age").cast("decimal(38,10)")).withColumn("amount", F.from_json("money", "struct<amount:decimal(38,4),currency:string>")).withColumn("created_on_behalf_of", F.when(F.col("id") == 2, "u1").otherwise("u9"))


def ids(df, column="id"):
    return sorted(r[column] for r in df.select(column).collect())


@pytest.mark.parametrize(("node", "want"), [
    ({"attribute": "name", "op": "neq", "value": "Ann"}, [2, 4]),
    ({"attribute": "name", "op": "not_in", "value": ["bob"]}, [1, 4]),
    ({"not": {"attribute": "age", "op": "gt", "value": 35}}, [1, 4]),
    ({"attribute": "name", "op": "contains", "value": "an"}, [1, 4]),
    ({"attribute": "name", "op": "contains", "value": "a_n"}, [1, 4]),
    ({"attribute": "name", "op": "starts_with", "value": "AN_A"}, [4]),
    ({"attribute": "age", "op": "between", "value": [30, 35]}, [1, 4]),
    ({"attribute": "percent", "op": "gte", "value": 10}, [1, 2]),
    ({"attribute": "emails", "op": "contains", "value": "c@x.org"}, [3]),
    ({"attribute": "emails", "op": "starts_with", "value": "A@"}, [1]),
    ({"attribute": "amount", "op": "lt", "value": "8"}, [3]),
    ({"attribute": "amount", "op": "gt", "value": {"amount": "8", "currency": "EUR"}}, [1]),
    ({"attribute": "company", "op": "is_null"}, [3, 4]),
    ({"attribute": "company", "op": "neq", "value": 70}, [2, 3, 4]),
    ({"or": [{"attribute": "company", "op": "eq", "value": 71}, {"attribute": "name", "op": "is_null"}]}, [2, 3]),
    ({"not": {"linked_to": {"relation": "works_at", "record": 70}}}, [2, 3, 4]),
    ({"text": "red fox"}, [1]),
    ({"system": "created_at", "op": "gte", "value": "2024-01-02"}, [2, 3]),
    ({"quality": "stale"}, [4]),
])
def test_filters(spark, people, node, want):
    edges = spark.createDataFrame([("works_at", 1, 70), ("works_at", 2, 71), ("other", 3, 70)], "relation string, from_id long, to_id long")
    docs = spark.createDataFrame([(1, "The red, quick fox"), (2, "red")], "record_id long, t string").select("record_id", text.tokens(F.col("t")).alias("tokens"))
    sources = Sources(edges, docs, {"stale": lambda: people.filter("created_at is null").select("id")})
    assert ids(apply_filter(people, node, PERSON, sources)) == want


def test_two_valued_filters_of_rollups(people):
    keep = lambda op, v: ids(apply_filter(people, {"attribute": "name", "op": op, "value": v}, PERSON, mode="memory"))
    assert keep("neq", "Ann") == [2, 3, 4] and keep("eq", "Ann") == [1]


@pytest.mark.parametrize(("node", "code"), [
    ({"and": []}, "empty_logical"), ({"attribute": "nope", "op": "eq", "value": 1}, "unknown_attribute"), ({"attribute": "old", "op": "eq", "value": 1}, "archived_attribute"),
    ({"attribute": "extra", "op": "eq", "value": 1}, "unsupported_operator"), ({"attribute": "emails", "op": "gt", "value": 1}, "unsupported_operator"), ({"attribute": "name", "op": "eq"}, "missing_value"),
    ({"attribute": "age", "op": "in", "value": []}, "array_arity"), ({"attribute": "age", "op": "between", "value": [2, 1]}, "between_order"), ({"attribute": "age", "op": "is_null", "value": 1}, "null_arity"),
    ({"attribute": "age", "op": "gt", "value": "x"}, "invalid_value"), ({"or": [{"attribute": "name", "op": "eq", "value": "a"}] * 101}, "filter_limit"),
])
def test_filter_errors(people, node, code):
    with pytest.raises(SpecError) as e:
        apply_filter(people, node, PERSON)
    assert e.value.code == code


def test_pages_neither_skip_nor_repeat(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice([None, "a", "b"]), rnd.choice([None, 1, 2])) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, k string, n int")
    for sorts in ([Sort("k"), Sort("n", True)], [Sort("n", True), Sort("k")], [Sort("k", True)]):
        whole = [r.id for r in df.orderBy(*order(sorts)).collect()]
        seen, cursor = [], None
        while True:
            got = page(df, sorts, 7, cursor).collect()
            seen += [r.id for r in got[:7]]
            if len(got) <= 7:
                break
            cursor = [got[6][s.key] for s in sorts], got[6].id
        assert seen == whole
    assert df.filter(after([Sort("k")], [None], 39)).count() == 0
    sealed = seal("q", {"a": 1}, [1, 2])
    assert unseal(sealed, "q", {"a": 1}) == [1, 2]
    with pytest.raises(SpecError, match="cursor_mismatch"):
        unseal(sealed, "q", {"a": 2})


def test_funnel_known_answer(spark):
    day = lambda n: T(2026, 8, n)
    rows = [(1, "lead", day(1), day(4)), (1, "proposal", day(4), None), (2, "qualified", day(4), day(7)), (2, "proposal", day(7), day(9)), (2, "won", day(9), None)]
    h = spark.createDataFrame([(*r, r[2], 10 * r[0]) for r in rows], "record_id long, stage string, started_at timestamp, ended_at timestamp, created_at timestamp, amount int")
    stages = spark.createDataFrame([("lead", 0), ("qualified", 1), ("proposal", 2), ("won", 3), ("lost", 4)], "stage string, position int")
    got = {r.stage: (r.records, r.amount, r.average_days) for r in pipeline.funnel(h, stages, F.col("amount")).collect()}
    assert got == {"lead": (0, None, 3.0), "qualified": (0, None, 3.0), "proposal": (1, 10, 2.0), "won": (1, 20, None), "lost": (0, None, None)}
    moves = {(r.from_stage, r.stage): r.conversions for r in pipeline.conversions(h, F.lit("2026-08-04").cast("timestamp")).collect()}
    assert moves == {("lead", "proposal"): 1, ("qualified", "proposal"): 1, ("proposal", "won"): 1}


def test_access(spark, people):
    grants = spark.createDataFrame([(3, "u1"), (3, "u1"), (4, "u2")], "record_id long, user_id string")
    assert ids(access.visible(people, grants, access.Caller("t", "u1"))) == [1, 2, 3, 4]
    assert ids(access.visible(people, grants, access.Caller("t", "u5"))) == [1, 4]
    assert ids(access.visible(people, grants, access.Caller("t", None))) == []
    rule = "scope string, scope_id string, effect string, priority int, requires_approval boolean"
    rules = spark.createDataFrame([("record", "1", "deny", 1, False), ("record", "2", "allow", 5, True), ("object_type", "private", "allow", 5, False), ("record", "4", "allow", 1, False)], rule)
    see = lambda r, channel: ids(access.policy(people, r, access.Caller("t", "u", channel), type_col="visibility"))
    assert see(rules, "human") == [3, 4] and see(rules, "agent") == [4]
    assert see(rules.limit(0), "human") == [1, 2, 3, 4] and see(rules.limit(0), "agent") == []
    hidden = access.redact(people, {"age": "restricted"}, {"public"}).first()
    assert hidden.age is None and hidden.redacted_attributes == ["age"]


def test_links(spark):
    e = "id long, relation string, from_id long, to_id long, position int, active_from timestamp, active_until timestamp"
    rows = [(1, "r", 1, 5, 1, T(2024, 1, 1), None), (2, "r", 1, 6, None, T(2024, 1, 1), None), (3, "r", 2, 6, 0, T(2024, 1, 1), T(2024, 2, 1)), (4, "r", 5, 9, 0, T(2024, 1, 5), None)]
    edges = spark.createDataFrame(rows, e)
    assert {r.record_id: r.ids for r in links.projected(edges.filter(links.active_at())).collect()} == {1: [6, 5], 5: [9]}
    assert edges.filter(links.active_at(F.lit("2024-02-01").cast("timestamp"))).count() == 3
    assert edges.filter(links.active_at(F.lit("2024-01-01").cast("timestamp"))).count() == 3
    assert ids(links.cascade_closure(spark.createDataFrame([(9,)], "id long"), edges)) == [1, 5, 9]
    chain = spark.range(1, 20).select((F.col("id") + 1).alias("from_id"), F.col("id").alias("to_id"), F.lit(None).cast("timestamp").alias("active_until"))
    assert ids(links.cascade_closure(spark.createDataFrame([(1,)], "id long"), chain.union(spark.createDataFrame([(1, 20, None)], chain.schema)))) == [*range(1, 21)]
    assert [r.id for r in links.list_links(edges, 6, history=True).collect()] == [3, 2] and [r.id for r in links.list_links(edges, 6).collect()] == [2]
    commands = spark.createDataFrame([("r", 1, 8, T(2024, 3, 1)), ("r", 3, 3, T(2024, 3, 1)), ("r", 5, 9, T(2024, 3, 1))], "relation string, from_id long, to_id long, at timestamp")
    out, refused = links.apply_links(edges, commands, "many_to_one", F.lit("2024-03-02").cast("timestamp"))
    assert {(r.from_id, r.to_id) for r in out.filter(links.active_at()).collect()} == {(1, 8), (5, 9)} and refused.count() == 1


def test_quality_report(spark, people):
    missing = {r.record_id: r.detail for r in data_quality.missing_required(people, ["name", "age"]).collect()}
    assert missing == {2: "age", 3: "name"}
    values = spark.createDataFrame([(1, "mail", "x"), (2, "mail", "x"), (2, "mail", "x"), (3, "mail", "y"), (3, "name", "x")], "record_id long, attribute string, value string")
    bad = data_quality.collisions(values)
    assert ids(bad, "record_id") == [1, 2]
    got = data_quality.report({"collisions": bad, "missing": data_quality.missing_required(people, ["name"])}, top=1).collect()
    assert {(r.bucket, r.total, r.record_id) for r in got} == {("collisions", 2, 1), ("missing", 1, 3)}


def test_replay_is_the_state_at_any_time(spark):
    rnd = random.Random(6)
    log, expected = [], {}
    for seq in range(300):
        r, slug = rnd.randint(1, 6), rnd.choice("ab")
        kind = rnd.choice(["create", "set", "set", "set", "unset", "delete", "restore"])
        log.append((r, slug if kind in ("set", "unset") else None, kind, str(seq) if kind == "set" else None, T(2024, 1, 1) + dt.timedelta(hours=seq // 3), seq))
    for cut in (20, 57, 99):
        at = T(2024, 1, 1) + dt.timedelta(hours=cut)
        state, made, alive = {}, set(), {}
        for r, slug, kind, value, when, _ in log:
            if when > at:
                break
            if kind in ("set", "unset"):
                state[r, slug] = value
            else:
                alive[r] = kind != "delete"
                made |= {r} if kind == "create" else set()
        expected = {k: v for k, v in state.items() if v is not None and k[0] in made and alive.get(k[0])}
        df = spark.createDataFrame(log, "record_id long, slug string, kind string, value string, occurred_at timestamp, seq long")
        assert {(r.record_id, r.slug): r.value for r in history.record_at(df, F.lit(at)).collect()} == expected
    b = spark.createDataFrame([(1, "a", "x"), (1, "b", "y")], "record_id long, slug string, value string")
    a = spark.createDataFrame([(1, "a", "z"), (1, "c", "w")], "record_id long, slug string, value string")
    assert {(r.slug, r.kind) for r in history.diff(b, a).collect()} == {("a", "set"), ("b", "unset"), ("c", "set")}


def test_numbering_and_stage_moves(spark):
    new = spark.createDataFrame([("t", T(2024, 1, 2), 2), ("t", T(2024, 1, 1), 9), ("u", T(2024, 1, 1), 1)], "team_id string, committed_at timestamp, id long")
    got = {(r.team_id, r.id): r.seq for r in history.number_changes(new, spark.createDataFrame([("t", 40)], "team_id string, seq long")).collect()}
    assert got == {("t", 9): 41, ("t", 2): 42, ("u", 1): 1}
    moves = spark.createDataFrame([(1, "a", T(2024, 1, 1), 1), (1, "a", T(2024, 1, 2), 2), (1, "b", T(2024, 1, 3), 3)], "record_id long, stage string, started_at timestamp, id long")
    assert ids(history.stage_moves(moves)) == [1, 3]


def test_search(spark):
    docs = spark.createDataFrame([(1, "acme.example is here", [1.0, 0.0]), (2, "acme and example", [0.9, 0.1]), (3, "acme acme.example", None), (4, "x", [0.0, 0.0])], "record_id long, t string, embedding array<float>").withColumn("tokens", text.tokens(F.col("t")))
    assert [r.record_id for r in search.keyword(docs, "acme.example").orderBy("record_id").collect()] == [1, 3]
    assert [r.record_id for r in search.keyword(docs, "acme", 2).collect()] == [3, 1]
    assert [r.record_id for r in search.similar_to(docs, 1, 5).collect()] == [2]
    got = search.fuse(search.keyword(docs, "acme"), search.semantic(docs, docs.filter("record_id = 1"))).collect()
    assert {r.record_id: r.match for r in got} == {1: "both", 2: "both", 3: "keyword"}
    assert got[0].score == pytest.approx(1 / 62 + 1 / 61)
    assert spark.range(1).select(text.utf8_truncate(F.lit("aéé"), 4).alias("x")).first().x == "aé"


def test_fuzzy_and_semantic_pairs_lose_nothing(spark):
    rnd = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "gemma", "alpine", "betas"]
    names = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 3)))) for i in range(60)]
    grams = lambda s: {("  " + w + " ")[i : i + 3] for w in s.split() for i in range(len(w) + 1)}
    first = {}
    for i, n in names:
        first.setdefault(n, i)
    want = {tuple(sorted((first[a], first[b]))) for a in first for b in first if a < b and len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= 0.5}
    got = matching.fuzzy_pairs(spark.createDataFrame(names, "record_id long, value string"), 0.5).collect()
    assert {(r.a, r.b) for r in got} == want
    vectors = [(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(80)]
    cos = lambda u, v: sum(x * y for x, y in zip(u, v)) / (sum(x * x for x in u) * sum(y * y for y in v)) ** 0.5  # noqa: E731,B905
    want = {(a, b) for a, u in vectors for b, v in vectors if a < b and cos(u, v) > 0.92}
    got = matching.semantic_pairs(spark.createDataFrame(vectors, "record_id long, embedding array<double>")).collect()
    assert {(r.a, r.b) for r in got} == want


def test_fuzzy_members_and_links_reach_every_record(spark):
    names = [(1, "alpha beta"), (2, "alpha beta"), (3, "Alpha  beta"), (4, "alpha betas"), (5, "gamma"), (6, "gamma"), (7, "delta"), (8, None), (9, "--"), (10, "--"), (11, "alpha betas")]
    df = spark.createDataFrame(names, "record_id long, value string")
    grams = lambda s: {("  " + w + " ")[i : i + 3] for w in s.lower().split() for i in range(len(w) + 1)}
    known = [(i, n) for i, n in names if n and n != "--"]
    near = {i: {j for j, m in known if j != i and len(grams(n) & grams(m)) / len(grams(n) | grams(m)) >= 0.5} for i, n in known}
    got = {r.record_id: r for r in matching.fuzzy_members(df, 0.5).collect()}
    assert {i: r.links for i, r in got.items()} == {i: len(x) for i, x in near.items()}
    assert {i: r.representative for i, r in got.items()} == {i: min(j for j, m in known if m == n) for i, n in known}
    links = matching.fuzzy_links(df, 0.5)
    assert {(r.a, r.b) for r in links.filter("score = 1").collect()} >= {(1, 2), (4, 11), (5, 6)}
    assert {r.record_id: r.component for r in matching.components(links).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 11: 1, 5: 5, 6: 5}


def test_keys_and_components(spark):
    df = spark.createDataFrame([(1, " A  b", ["x", "y"]), (2, "a B", ["y"]), (3, "", ["y"]), (4, None, None)], "id long, name string, tags array<string>")
    keys = matching.match_keys(df, Rule("r", ("name", "tags")), multi=frozenset({"tags"}))
    assert keys.count() == 3
    assert [(r.a, r.b) for r in matching.key_links(keys).collect()] == [(1, 2)]
    chain = [(i, i + 1) for i in range(1, 30)] + [(100, 101), (100, 102)]
    got = {r.record_id: r.component for r in matching.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert set(got.values()) == {1, 100} and got[30] == 1 and got[102] == 100
    assert matching.find_matches(keys, keys.filter("record_id = 1")).count() == 1
    with pytest.raises(SpecError):
        Rule("f", ("a",), "fuzzy", "block")


def test_derivation(spark):
    df = spark.createDataFrame([(1, 10, 0, "x", T(2024, 1, 1)), (2, 9, 3, None, None)], "id long, a int, b int, s string, d timestamp")
    f = {
        "twice": {"fn": "multiply", "args": [{"attribute": "ratio"}, {"literal": 2}]}, "ratio": {"fn": "divide", "args": [{"attribute": "a"}, {"attribute": "b"}]},
        "days": {"fn": "days_since", "args": [{"attribute": "d"}]}, "more": {"fn": "gt", "args": [{"literal": "10"}, {"attribute": "a"}]}, "text": {"fn": "concat", "args": [{"attribute": "s"}, {"literal": "!"}]},
    }
    got = {r.id: r for r in derived.derive(df, f, F.lit("2024-01-11 12:00:00").cast("timestamp")).collect()}
    assert (got[1].ratio, got[2].ratio, got[2].twice, got[1].days, got[1].more, got[2].more, got[1].text, got[2].text) == (None, 3.0, 6.0, 10, False, True, "x!", None)
    with pytest.raises(SpecError, match="derivation_cycle"):
        derived.evaluation_order({"a": {"attribute": "b"}, "b": {"attribute": "a"}})
    parents = spark.createDataFrame([(1,), (2,), (3,)], "record_id long")
    related = spark.createDataFrame([(1, "5", "EUR"), (1, "7", "EUR"), (2, "5", "EUR"), (2, "7", "USD")], "record_id long, amount string, currency string")
    sums = {r.record_id: (r["count"], r["sum"] and float(r["sum"])) for r in derived.rollup(parents, related, "amount", ["count", "sum"], currency="currency").collect()}
    assert sums == {1: (2, 12.0), 2: (2, None), 3: (0, None)}


def test_upsert_patch_and_merge(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "b", 3), (4, "d", 4)], "id long, key string, v int")
    new = spark.createDataFrame([("a", 9, 1), ("a", 5, 2), ("b", 1, 1), ("c", 1, 1), (None, 1, 1), ("d", None, 1)], "key string, v int, at int")
    got = {r.key: (r.action, r.id, r.v) for r in mutation.upsert(old, new, "key", ["v"]).collect()}
    assert got == {"a": ("updated", 1, 5), "b": ("duplicate", 2, 1), "c": ("created", None, 1), None: ("failed", None, 1), "d": ("unchanged", 4, 4)}
    records = spark.createDataFrame([(1, "x", "y", 3), (2, "x", "y", 3), (3, "x", "y", 3)], "id long, a string, b string, version int")
    patches = spark.createDataFrame([(1, 3, ["b"], "z", None), (2, 1, [], "z", None), (3, None, [], "x", None)], "id long, expected_version int, clears array<string>, a string, b string")
    out = {r.id: (r.a, r.b, r.version, r.conflict) for r in mutation.patch(records, patches, ["a", "b"]).collect()}
    assert out == {1: ("z", None, 4, False), 2: ("x", "y", 3, True), 3: ("x", "y", 3, False)}
    people = spark.createDataFrame([(1, None, "s"), (2, "old", "t"), (3, "new", None)], "id long, a string, b string")
    merges = spark.createDataFrame([(1, 2), (1, 3)], "survivor_id long, loser_id long")
    last = spark.createDataFrame([(2, "a", 1, 1), (3, "a", 2, 2)], "record_id long, slug string, occurred_at int, seq int")
    one = mutation.merge_fields(people, merges, last, ["a", "b"]).first()
    assert (one.id, one.a, one.b) == (1, "new", "s")
    chosen = mutation.merge_fields(people, merges, last, ["a", "b"], spark.createDataFrame([(1, "mine")], "survivor_id long, b string")).first()
    assert chosen.b == "mine"
    e = "id long, relation string, from_id long, to_id long, position int, active_from timestamp"
    edges = spark.createDataFrame([(1, "r", 1, 9, 0, T(2024, 1, 2)), (2, "r", 2, 9, 0, T(2024, 1, 1)), (3, "r", 2, 1, 1, T(2024, 1, 1)), (4, "r", 3, 8, 2, T(2024, 1, 1))], e)
    kept = {r.id: (r.kept, r.position) for r in mutation.merge_links(edges, merges).collect()}
    assert kept == {1: (False, None), 2: (True, 0), 3: (False, None), 4: (True, 1)}
    snapshot = spark.createDataFrame([(1, "a", "x"), (1, "b", "y")], "record_id long, slug string, value string")
    back, conflicts = mutation.unmerge(snapshot, spark.createDataFrame([(1, "b", "set")], "record_id long, slug string, kind string"))
    assert [r.slug for r in back.collect()] == ["a"] and [r.slug for r in conflicts.collect()] == ["b"]


def test_list_positions_are_contiguous(spark):
    rows = spark.createDataFrame([(i, (i * 37) % 101) for i in range(101)], "id long, k long").repartition(5)
    got = sorted((r.position, r.record_id) for r in mutation.list_members(rows, [F.col("k"), F.col("id")]).collect())
    assert [p for p, _ in got] == list(range(101)) and [i for _, i in got] == [i for i, _ in sorted(((r.id, r.k) for r in rows.collect()), key=lambda x: x[1])]


def test_compliance(spark):
    acts = [(1, 1, T(2024, 1, 1), "granted", True), (1, 2, T(2024, 1, 3), "declined", True), (1, 3, T(2024, 1, 4), "granted", False), (2, 1, T(2024, 1, 2), "granted", True), (2, 2, T(2024, 1, 2), "declined", True)]
    df = spark.createDataFrame(acts, "person_id long, seq long, at timestamp, consent string, verified boolean")
    assert {r.person_id: r.consent for r in compliance.consent(df).collect()} == {1: "declined", 2: "granted"}
    entries = spark.createDataFrame([("k", "all", "a", None, T(2024, 2, 1)), ("k", "mail", "m", None, T(2024, 1, 1)), ("l", "all", "x", T(2024, 1, 1), T(2024, 1, 1))], "key_hash string, channel string, reason string, expires_at timestamp, created_at timestamp")
    points = spark.createDataFrame([("k",), ("l",)], "key_hash string")
    assert {r.key_hash: r.reason for r in compliance.suppressed(points, entries, "mail", F.lit("2024-06-01").cast("timestamp")).collect()} == {"k": "m", "l": None}
    many = spark.createDataFrame([("t", "q", f"h{i % 8}", i) for i in range(16)], "team_id string, queue_key string, proposed_hash string, submitted_seq long")
    got = compliance.proposals(many).collect()
    assert sorted(r.submitted_seq for r in got if r.status == "pending") == [11, 12, 13, 14, 15] and all(r.submissions == 2 for r in got)
    subs = spark.createDataFrame([(1, "a@x", None, "New"), (2, "zz", None, "N")], "submission_id long, email string, phone string, name string")
    recs = spark.createDataFrame([(5, "a@x", "1", None)], "id long, email string, phone string, name string")
    out = {r.submission_id: (r.record_id, r.fills) for r in compliance.intake(subs, recs, ["email", "phone"], ["name"]).collect()}
    assert out == {1: (5, ["name"]), 2: (None, [])}


def test_catalog_and_typed_projection(spark):
    c = Catalog().apply_template([PERSON], [Relation("works_at")])
    assert c.version == 2 and c.apply_template([PERSON], [Relation("works_at")]).version == 2
    with pytest.raises(SpecError, match="immutable_type"):
        c.with_attribute("person", Attribute("name", "number"))
    assert c.archive_attribute("person", "name").types["person"].attributes[0].archived
    df = spark.createDataFrame([(1, '{"name": "x", "age": "12.5", "emails": ["a"], "amount": {"amount": "1.5", "currency": "EUR"}}'), (2, '{"age": "no"}')], "id long, data string")
    one, two = typed_projection(df, PERSON).orderBy("id").collect()
    assert (one.name, float(one.age), one.emails, float(one.amount.amount)) == ("x", 12.5, ["a"], 1.5) and two.age is None and two.name is None


def test_exports_and_audit(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "x",', [1, 2], None)], "id long, t string, a array<int>, n string")
    assert exports.export(df.coalesce(1), f"{tmp_path}/c") == 1
    body = next(open(f"{tmp_path}/c/{f}", newline="").read() for f in os.listdir(f"{tmp_path}/c") if f.endswith(".csv"))
    assert body == 'id,t,a,n\r\n1,"say ""x"",","[1,2]",\r\n'
    exports.export(df.coalesce(1), f"{tmp_path}/j", "jsonl")
    assert '"n":null' in next(open(f"{tmp_path}/j/{f}").read() for f in os.listdir(f"{tmp_path}/j") if f.endswith(".json"))
    with pytest.raises(SpecError, match="export_limit"):
        exports.export(df, f"{tmp_path}/d", max_rows=0)
    import hashlib

    one = hashlib.sha256(b"\na").hexdigest()
    log = spark.createDataFrame([("o", 1, "", one, "a"), ("o", 2, "x", "y", "b")], "org_id string, seq long, prev_hash string, entry_hash string, body string")
    assert ids(exports.chain_breaks(log), "seq") == [2]


def test_stream_of_changes(spark, tmp_path):
    schema = "record_id long, kind string, seq long, value string, sensitivity string"
    source, checkpoint = f"{tmp_path}/changes", f"{tmp_path}/cursor"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    got = []
    handle = lambda batch, n: got.extend((r.seq, r.event) for r in batch.collect())
    put([(1, "create", 1, None, None), (1, "set", 2, "x", "restricted")])
    run = lambda: feed.deliver(feed.read_changes(spark, source, schema), handle, checkpoint).awaitTermination()
    run()
    put([(1, "delete", 3, None, None)])
    run()
    assert got == [(1, "record.created"), (2, "record.updated"), (3, "record.deleted")]
    rows = feed.events(spark.read.parquet(source), ["record.updated"], "sensitivity").collect()
    assert [(r.seq, r.value) for r in rows] == [(2, None)]


def test_merges_of_several_values(spark):
    rows = spark.createDataFrame([(1, ["A", "b"], "team", "u1"), (2, ["a", None, "C"], "users", "u2"), (3, None, "team", None)], "id long, tags array<string>, visibility string, created_on_behalf_of string")
    merges = spark.createDataFrame([(1, 2), (1, 3)], "survivor_id long, loser_id long")
    assert mutation.merge_multi(rows, merges, "tags").collect()[0].tags == ["A", "b", "C"]
    chosen = spark.createDataFrame([(1, 2)], "survivor_id long, record_id long")
    assert mutation.merge_multi(rows, merges, "tags", choices=chosen).collect()[0].tags == ["a", None, "C"]
    grants = spark.createDataFrame([(2, "u9"), (3, "u9")], "record_id long, user_id string")
    assert sorted((r.record_id, r.user_id) for r in mutation.merged_grants(rows, grants, merges).collect()) == [(1, "u1"), (1, "u2"), (1, "u9")]
    assert mutation.merged_grants(rows.filter("id > 9"), grants.filter("record_id > 9"), merges).collect() == []


def test_limits_and_invalid_values(spark):
    many = spark.createDataFrame([(1, [str(i) for i in range(17)], [str(i) for i in range(16)])], "id long, a array<string>, b array<string>")
    rule = Rule("r", ("a", "b"))
    with pytest.raises(Exception, match="too_many_tuples"):
        matching.match_keys(many, rule, multi=frozenset(("a", "b"))).collect()
    assert matching.match_keys(many.withColumn("a", F.slice("a", 1, 16)), rule, multi=frozenset(("a", "b"))).count() == 256
    with pytest.raises(SpecError, match="list_limit"):
        mutation.list_members(spark.range(3), [F.col("id")], most=2)
    paid = lambda rows: pipeline.fixed_amount(F.col("a"), F.col("c"), "EUR")
    good = spark.createDataFrame([("1.50", "EUR"), (None, None)], "a string, c string")
    assert [None if r[0] is None else float(r[0]) for r in good.select(paid(good)).collect()] == [1.5, None]
    for a, c in (("1e3", "EUR"), ("1", "USD"), ("x", "EUR"), (None, "EUR"), ("1", None)):
        bad = spark.createDataFrame([(a, c)], "a string, c string")
        with pytest.raises(Exception, match="invalid_amount"):
            bad.select(paid(bad)).collect()


def test_policies_of_a_new_team(spark):
    rules, bindings = access.default_policies(spark, "o", "t", ("app",))
    ask = [("role", "member", "record", "view"), ("role", "guest", "record", "edit"), ("role", "guest", "record", "merge"), ("agent", "agent:app:*", "record", "erase"), ("agent", "agent:other:*", "record", "view"), (None, None, None, None)]
    requests = spark.createDataFrame([(i, *a, None) for i, a in enumerate(ask)], "n int, actor_type string, actor_id string, resource_type string, action string, sensitivity string")
    assert [r.outcome for r in access.evaluate(requests, rules, bindings).orderBy("n").collect()] == ["allow", "allow", "deny", "allow", "deny", "deny"]


def test_views_and_lists():
    catalog = Catalog().with_type(ObjectType("deal", (Attribute("status", "status"), Attribute("data", "json"))))
    view = views.View("v", "V", "deal", {"attribute": "status", "op": "eq", "value": "P"}, (Sort("status"),), ("status", "status"))
    saved = views.Saved().save_view(catalog, view)
    assert saved.view("v").attributes == ("status",) and saved.save_view(catalog, view) is saved and saved.delete_view("v").views == {}
    for bad in ({"object_type": "none"}, {"attributes": ("none",)}, {"sort": (Sort("data"),)}):
        with pytest.raises(SpecError):
            saved.save_view(catalog, views.replace(view, **bad))
    with pytest.raises(SpecError, match="not_found"):
        saved.delete_view("w")
    lists = saved.create_list(catalog, views.ListSpec("s", "S")).create_list(catalog, views.ListSpec("d", "D", "dynamic", "deal", view.filter))
    assert (lists.lists["d"].evaluation, lists.lists["d"].state, lists.update_list("d", filter=view.filter).lists["d"].evaluation) == (1, "refreshing", 2)
    assert lists.update_list("s", name="T").lists["s"] == views.ListSpec("s", "T")
    for wrong in (lambda: lists.update_list("s", filter=view.filter), lambda: lists.create_list(catalog, views.ListSpec("s", "S")), lambda: lists.create_list(catalog, views.ListSpec("x", "X", "dynamic"))):
        with pytest.raises(SpecError):
            wrong()


def test_activities(spark):
    columns = "id long, external_ref string, subject string, about array<long>, at timestamp"
    stored = spark.createDataFrame([(1, "a", "old", None, None), (2, None, "own", None, None)], columns)
    new = spark.createDataFrame([(3, "a", "new", [7, 7, None], dt.datetime(2024, 1, 2)), (4, "a", None, [], None), (5, None, "x", [8], dt.datetime(2020, 1, 1)), (6, "b", "y", None, None)], columns)
    assert sorted((r.id, r.external_ref, r.subject) for r in activities.logged(stored, new, ["subject"]).collect()) == [(1, "a", "old"), (2, None, "own"), (5, None, "x"), (6, "b", "y")]
    assert sorted((r.from_id, r.to_id) for r in activities.about_links(new, "about").collect()) == [(3, 7), (5, 8)]
    records = spark.createDataFrame([(7, None), (8, dt.datetime(2023, 1, 1)), (9, None)], "id long, last_activity_at timestamp")
    assert [r.last_activity_at for r in activities.touched(records, new, "at").orderBy("id").collect()] == [dt.datetime(2024, 1, 2), dt.datetime(2023, 1, 1), None]


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return round(float(v), 6) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(driver_queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in os.listdir(d):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{d}/{f}'")
    df = driver_queries.QUERIES[name](spark, d)
    columns = sorted(df.columns)
    told = con.execute(driver_queries.ORACLES[name])
    names = [c[0] for c in told.description]
    assert sorted(names) == columns
    want = sorted((tuple(_plain(r[names.index(c)]) for c in columns) for r in told.fetchall()), key=repr)
    assert sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want


def test_reindexed_documents_keep_vectors_of_equal_content(spark):
    fresh = spark.createDataFrame([(1, "a", ["a"]), (2, "b", ["b"]), (3, None, [])], "record_id long, content string, tokens array<string>")
    stored = spark.createDataFrame([(1, "a", [1.0]), (2, "old", [2.0]), (3, None, [3.0]), (4, "gone", [4.0])], "record_id long, content string, embedding array<double>")
    kept = search.reindexed(fresh, stored)
    assert {r.record_id: r.embedding for r in kept.collect()} == {1: [1.0], 2: None, 3: [3.0]}
    made = stored.filter("record_id = 2").unionByName(spark.createDataFrame([(1, "a", [9.0])], stored.schema))
    assert {r.record_id: r.embedding for r in search.store_embeddings(kept, made, 1).collect()} == {1: [9.0], 2: None, 3: [3.0]}
    for wrong in ([1.0, 2.0], [float("nan")], [float("inf")], [None], None):
        with pytest.raises(Exception, match="embedding_width"):
            search.store_embeddings(kept, spark.createDataFrame([(2, "b", wrong)], stored.schema), 1).collect()


def test_contact_points_follow_the_values(spark):
    known = spark.createDataFrame([(1, "a", True, None), (1, "b", False, T(2024, 1, 1)), (1, "c", False, T(2024, 1, 1))], "record_id long, value string, confirmed boolean, archived_at timestamp").withColumn("value_hash", F.sha2("value", 256))
    told = lambda *v: spark.createDataFrame([(1, x) for x in v], "record_id long, value string")
    got = compliance.set_points(known, told("a", "c", "x", None), told("b", "d", "d", "x", None), F.lit("2025-01-01").cast("timestamp"))
    assert {r.value: (r.confirmed, r.archived_at) for r in got.collect()} == {"a": (True, T(2025, 1, 1)), "b": (False, None), "c": (False, T(2024, 1, 1)), "d": (False, None)}


def test_unlinked_order_zero_leaves_company_zero_alone(spark, tmp_path):
    con, d = duckdb.connect(), "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{d}/customer.parquet'")
    con.execute(f"CREATE VIEW orders AS SELECT * REPLACE (CASE o_orderkey WHEN 0 THEN 'O' ELSE o_orderstatus END AS o_orderstatus, CASE o_orderkey WHEN 0 THEN '1-URGENT' ELSE o_orderpriority END AS o_orderpriority) FROM '{d}/orders.parquet'")
    for t in ("customer", "orders"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    got = {r.id: r.version for r in driver_queries.QUERIES["unlink_versions"](spark, str(tmp_path)).collect()}
    assert got == dict(con.execute(driver_queries.ORACLES["unlink_versions"]).fetchall())
