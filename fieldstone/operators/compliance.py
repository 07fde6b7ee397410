"""Suppressions, consent, proposals and contact points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER_QUEUE, PER_TEAM = 5, 1000


def suppression_key(kind: Column, normal: Column) -> Column:
    return F.sha2(F.concat(kind, F.lit("\x1f"), normal), 256)


def suppressed(points: DataFrame, entries: DataFrame, channel: str, now: Column) -> DataFrame:
    """points (key_hash, ...) with reason: of entries that haven't expired, for all channels or this one, the exact channel first, then the newest.
    Entries are reduced to one a key before the join."""
    open_ = entries.filter(F.col("channel").isin("all", channel) & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))
    best = open_.groupBy("key_hash").agg(F.max_by("reason", F.struct(F.col("channel") == channel, "created_at", "reason")).alias("reason"))
    return points.join(best, "key_hash", "left")


def consent(acts: DataFrame) -> DataFrame:
    """(person_id, consent, at) after acts (person_id, seq, at, consent, verified) in the order of seq: a strictly newer act replaces the stored
    one, but an unverified one never a declined. The rule reads what is stored, so it is a fold over each person's acts; a person's acts
    are few."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "at", "consent", "verified")))
    start = F.struct(F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("string").alias("consent"))
    step = lambda s, a: F.when(s["at"].isNull() | ((a["at"] > s["at"]) & (a["verified"] | (s["consent"] != "declined"))), F.struct(a["at"].alias("at"), a["consent"].alias("consent"))).otherwise(s)
    types = dict(acts.dtypes)
    start = F.struct(F.lit(None).cast(types["at"]).alias("at"), F.lit(None).cast(types["consent"]).alias("consent"))
    return acts.groupBy("person_id").agg(F.aggregate(ordered, start, step).alias("s")).select("person_id", "s.consent", "s.at")


def proposals(submissions: DataFrame) -> DataFrame:
    """Identical submissions of a queue as one, with their count; the newest five of a queue and the newest thousand of a team stay pending,
    the rest is superseded."""
    one = submissions.groupBy("team_id", "queue_key", "proposed_hash").agg(F.count(F.lit(1)).alias("submissions"), F.max("submitted_seq").alias("submitted_seq"))
    in_queue = F.row_number().over(Window.partitionBy("team_id", "queue_key").orderBy(F.desc("submitted_seq")))
    ranked = one.withColumn("in_queue", in_queue)
    newest = ranked.filter(F.col("in_queue") <= PER_QUEUE).withColumn("in_team", F.row_number().over(Window.partitionBy("team_id").orderBy(F.desc("submitted_seq"))))
    # The filter on the rank lets each task cut its share of a team to a thousand before the shuffle.
    pending = newest.filter(F.col("in_team") <= PER_TEAM).select("team_id", "queue_key", "proposed_hash", F.lit("pending").alias("status"))
    return one.join(pending, ["team_id", "queue_key", "proposed_hash"], "left").select(*one.columns, F.coalesce("status", F.lit("superseded")).alias("status"))


def contact_points(records: DataFrame, states: DataFrame, column: str, id_col: str = "id") -> DataFrame:
    """(record_id, value, confirmed, archived) of each value of a multi-valued column, with its state (value_hash, confirmed, archived) if any."""
    points = records.select(F.col(id_col).alias("record_id"), F.explode(column).alias("value")).withColumn("value_hash", F.sha2("value", 256))
    out = points.join(states, "value_hash", "left")
    return out.select("record_id", "value", F.coalesce("confirmed", F.lit(False)).alias("confirmed"), F.coalesce("archived", F.lit(False)).alias("archived"))


def set_points(states: DataFrame, before: DataFrame, after: DataFrame, now: Column) -> DataFrame:
    """states (record_id, value_hash, value, confirmed, archived_at) after records' values (record_id, value) went from before to after: new
    values get a state or have theirs revived, with its confirmation kept; values that went are archived, once; others stay as they are."""
    held = lambda values, name: values.filter(F.col("value").isNotNull()).select("record_id", F.sha2("value", 256).alias("value_hash"), "value").groupBy("record_id", "value_hash").agg(F.min("value").alias(name))
    changed = held(before, "__was").join(held(after, "__is"), ["record_id", "value_hash"], "full_outer").filter(F.col("__was").isNull() != F.col("__is").isNull())
    out = states.join(changed, ["record_id", "value_hash"], "full_outer").filter(F.col("value").isNotNull() | F.col("__is").isNotNull())
    ended = F.when(F.col("__is").isNotNull(), None).when(F.col("__was").isNotNull(), F.coalesce("archived_at", now)).otherwise(F.col("archived_at"))
    return out.select("record_id", "value_hash", F.coalesce("value", "__is").alias("value"), F.coalesce("confirmed", F.lit(False)).alias("confirmed"), ended.alias("archived_at"))


def intake(submissions: DataFrame, records: DataFrame, keys: list[str], columns: list[str], id_col: str = "id") -> DataFrame:
    """(submission_id, record_id, candidates, fills, amendments): what pairing each submission with the only record that shares a key would do;
    a null stored value is filled, another one an amendment. Without one record, or with several, record_id is null."""
    hits = None
    for k in keys:
        hit = submissions.filter(F.col(k).isNotNull()).select("submission_id", k).join(records.select(F.col(id_col).alias("record_id"), k), k).select("submission_id", "record_id")
        hits = hit if hits is None else hits.union(hit)
    found = hits.distinct().groupBy("submission_id").agg(F.count(F.lit(1)).alias("candidates"), F.min("record_id").alias("record_id"))
    paired = submissions.join(found, "submission_id", "left").withColumn("record_id", F.when(F.col("candidates") == 1, F.col("record_id")))
    stored = records.select(F.col(id_col).alias("__id"), *[F.col(c).alias(f"__{c}") for c in columns])
    both = paired.join(stored, F.col("record_id") == F.col("__id"), "left")
    named = lambda test: F.array_compact(F.array(*[F.when(F.col("record_id").isNotNull() & test(c), F.lit(c)) for c in columns]))
    return both.select("submission_id", "record_id", F.coalesce("candidates", F.lit(0)).alias("candidates"), named(lambda c: F.col(f"__{c}").isNull() & F.col(c).isNotNull()).alias("fills"), named(lambda c: F.col(f"__{c}") != F.col(c)).alias("amendments"))
