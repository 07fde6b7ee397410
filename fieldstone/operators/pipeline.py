"""Pipelines: stage intervals and the funnel summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def intervals(moves: DataFrame, record: str = "record_id", at: str = "started_at", tie: str = "id") -> DataFrame:
    """Closes each move of a record with the start of its next."""
    return moves.withColumn("ended_at", F.lead(at).over(Window.partitionBy(record).orderBy(at, tie)))


def with_origin(history: DataFrame, tie: str = "created_at") -> DataFrame:
    """History with from_stage: the stage before, of the same record."""
    return history.withColumn("from_stage", F.lag("stage").over(Window.partitionBy("record_id").orderBy("started_at", tie)))


def current(history: DataFrame, amount: Column | None = None) -> DataFrame:
    """(stage, records, amount): open intervals by stage."""
    open_ = history.filter(F.col("ended_at").isNull()).groupBy("stage")
    return open_.agg(F.count(F.lit(1)).alias("records"), *([F.sum(amount).alias("amount")] if amount is not None else []))


def fixed_amount(amount: Column, currency: Column, fixed: str) -> Column:
    """A stored amount, text of a plain decimal, in the attribute's one currency; null if there is none. An amount that is there but isn't
    that stops the report."""
    sound = amount.rlike(r"^-?\d+(\.\d+)?$") & (currency == fixed)
    return F.when(amount.isNull() & currency.isNull(), None).when(sound, amount.try_cast("decimal(38,4)")).otherwise(F.raise_error(F.lit("invalid_amount")).cast("decimal(38,4)"))


def durations(history: DataFrame) -> DataFrame:
    """(stage, average_days): closed intervals by stage."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    days = (micros("ended_at") - micros("started_at")) / DAY_MICROS
    return history.filter(F.col("ended_at").isNotNull()).groupBy("stage").agg(F.avg(days).alias("average_days"))


def conversions(history: DataFrame, since: Column | None = None, tie: str = "created_at") -> DataFrame:
    """(from_stage, stage, conversions): moves to another stage. The stage before is known before `since` leaves moves out."""
    moved = with_origin(history, tie).filter(F.col("from_stage").isNotNull() & (F.col("from_stage") != F.col("stage")))
    return (moved if since is None else moved.filter(F.col("started_at") >= since)).groupBy("from_stage", "stage").agg(F.count(F.lit(1)).alias("conversions"))


def funnel(history: DataFrame, stages: DataFrame, amount: Column | None = None) -> DataFrame:
    """Every active stage (stage, position) with its open records (0 where none), amount and average days. Where stages say that they are
    archived, those are left out."""
    active = stages.filter(~F.coalesce("archived", F.lit(False))).drop("archived") if "archived" in stages.columns else stages
    out = active.join(current(history, amount), "stage", "left").join(durations(history), "stage", "left")
    return out.fillna(0, ["records"]).orderBy("position", "stage")
