"""Sinks and audit: CSV and JSON-lines exports, and the check of a hash chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldstone.catalog import SpecError

MAX_ROWS = 100_000


def flat(df: DataFrame) -> DataFrame:
    """Structs, arrays and maps as JSON text, for a format of flat rows."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema])


def export(df: DataFrame, path: str, kind: str = "csv", max_rows: int | None = MAX_ROWS) -> int:
    """Writes df as "csv" (header, CRLF, nulls empty) or "jsonl" (nulls kept) and returns its rows; more than max_rows is an error. Spark's commit
    protocol publishes whole files only."""
    n = df.count()
    if max_rows is not None and n > max_rows:
        raise SpecError("export_limit", f"{n} rows")
    if kind == "csv":
        flat(df).write.csv(path, header=True, lineSep="\r\n", emptyValue="", nullValue="", escape='"')
    elif kind == "jsonl":
        df.write.json(path, ignoreNullFields=False)
    else:
        raise SpecError("unknown_format", kind)
    return n


def jsonl(df: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON object a row in column `line`, nulls kept."""
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("line"))


def chain_breaks(log: DataFrame) -> DataFrame:
    """Entries (org_id, seq, prev_hash, entry_hash, body) whose hash isn't SHA-256 of the previous hash, a line feed and the body, or whose
    previous hash isn't that of the entry before."""
    before = F.coalesce(F.lag("entry_hash").over(Window.partitionBy("org_id").orderBy("seq")), F.lit(""))
    told = log.withColumn("__before", before)
    return told.filter((F.col("prev_hash") != F.col("__before")) | (F.col("entry_hash") != F.sha2(F.concat("prev_hash", F.lit("\n"), "body"), 256))).drop("__before")
