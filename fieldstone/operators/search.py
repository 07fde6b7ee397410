"""Search over documents: keywords, vectors, and both fused by reciprocal ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldstone.catalog import SpecError
from fieldstone.functions.text import term_rank, tokens, utf8_truncate
from fieldstone.functions.vectors import cosine

DEPTH, K = 50, 60
MAX_CONTENT = 8192


def search_content(parts: list[Column]) -> Column:
    """A search document's text: its parts that aren't empty, up to 8 KiB."""
    return utf8_truncate(F.array_join(F.filter(F.array(*parts), lambda x: F.coalesce(x, F.lit("")) != ""), " · "), MAX_CONTENT)


def keyword(documents: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """(record_id, score): documents (record_id, tokens) that hold all terms of the query, by the sum of their terms' ranks."""
    wanted = F.array_distinct(tokens(F.lit(query)))
    hit = documents.filter((F.size(wanted) > 0) & (F.size(F.array_except(wanted, F.col("tokens"))) == 0))
    score = F.aggregate(wanted, F.lit(0.0), lambda s, t: s + term_rank(F.size(F.filter("tokens", lambda x: x == t))))
    out = hit.select("record_id", score.alias("score"))
    return out.orderBy(F.desc("score"), "record_id").limit(limit) if limit else out


def semantic(documents: DataFrame, vector: DataFrame, limit: int | None = None, exclude=None) -> DataFrame:
    """(record_id, score): cosine to the one row of `vector`; documents without a vector are no hits."""
    rows = documents.filter(F.col("embedding").isNotNull())
    rows = rows if exclude is None else rows.filter(F.col("record_id") != exclude)
    q = F.broadcast(vector.select(F.col("embedding").alias("__q")).limit(1))
    out = rows.join(q, F.lit(True)).select("record_id", cosine(F.col("embedding"), F.col("__q")).alias("score")).filter(F.col("score").isNotNull())
    return out.orderBy(F.desc("score"), "record_id").limit(limit) if limit else out


def similar_to(documents: DataFrame, record_id, limit: int | None = None) -> DataFrame:
    return semantic(documents, documents.filter(F.col("record_id") == record_id), limit, exclude=record_id)


def fuse(first: DataFrame, second: DataFrame, limit: int | None = None, depth: int = DEPTH, k: int = K) -> DataFrame:
    """(record_id, score, match): both hit lists' first `depth` by rank, 1 / (k + rank) added up. Ranks are numbered over those few rows."""
    ranked = lambda d, name: d.orderBy(F.desc("score"), "record_id").limit(depth).select("record_id", F.row_number().over(Window.orderBy(F.desc("score"), "record_id")).alias(name))
    both = ranked(first, "a").join(ranked(second, "b"), "record_id", "full_outer")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    out = both.select("record_id", (part("a") + part("b")).alias("score"), F.when(F.col("b").isNull(), "keyword").when(F.col("a").isNull(), "semantic").otherwise("both").alias("match"))
    return out.orderBy(F.desc("score"), "record_id").limit(limit) if limit else out


def check_mode(query: str | None, similar_to: object | None, mode: str | None = None) -> str:
    """The mode that a search's arguments mean: a query is hybrid unless it says otherwise, similar_to always semantic."""
    if (query is None) == (similar_to is None):
        raise SpecError("invalid_search", "either a query or similar_to")
    if similar_to is not None:
        if mode == "keyword":
            raise SpecError("invalid_search", "similar_to has no keyword mode")
        return "semantic"
    if mode not in (None, "keyword", "semantic", "hybrid"):
        raise SpecError("invalid_search", str(mode))
    return mode or "hybrid"


def search_documents(records: DataFrame, attributes: list[str], links: DataFrame | None = None, name_col: str = "name", id_col: str = "id") -> DataFrame:
    """(record_id, content, tokens): the re-indexed search documents of all records: their attributes in order, then the names of what they
    link to, by relation, position (null last) and id. Tokens are made once, here, and stored; queries read them."""
    told = records.select(F.col(id_col).alias("record_id"), F.array(*[F.col(a).cast("string") for a in attributes]).alias("own"))
    near = F.array().cast("array<string>")
    if links is not None:
        names = records.select(F.col(id_col).alias("to_id"), F.col(name_col).alias("__name"))
        place = F.struct("relation", F.col("position").isNull().alias("last"), "position", "to_id", "__name")
        of = links.join(names, "to_id").groupBy(F.col("from_id").alias("record_id")).agg(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["__name"]).alias("near"))
        told, near = told.join(of, "record_id", "left"), F.coalesce("near", near)
    content = utf8_truncate(F.array_join(F.filter(F.concat("own", near), lambda x: F.coalesce(x, F.lit("")) != ""), " · "), MAX_CONTENT)
    return told.select("record_id", content.alias("content")).withColumn("tokens", tokens(F.col("content")))


def reindexed(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """fresh search documents (record_id, content, tokens) with the embedding that is stored (record_id, content, embedding) for the same
    content; null where it has to be made. Records that fresh lacks lose their documents."""
    old = stored.select("record_id", F.col("content").alias("__content"), "embedding")
    kept = F.when(F.col("__content").eqNullSafe(F.col("content")), F.col("embedding"))
    return fresh.join(old, "record_id", "left").select(*[F.col(c) for c in fresh.columns if c != "embedding"], kept.alias("embedding"))


def store_embeddings(documents: DataFrame, made: DataFrame, width: int) -> DataFrame:
    """documents with the embeddings made (record_id, content, embedding) for them, each only if its document still has the content that it
    was made for. One of another width, or with a value that isn't finite, stops the job."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    sound = (F.size("embedding") == width) & F.forall("embedding", finite)
    checked = F.when(F.coalesce(sound, F.lit(False)), F.col("embedding")).otherwise(F.raise_error(F.lit("embedding_width")).cast(made.schema["embedding"].dataType))
    new = made.select("record_id", "content", checked.alias("__new"))
    out = documents.join(new, ["record_id", "content"], "left")
    return out.select(*[F.coalesce("__new", "embedding").alias("embedding") if c == "embedding" else F.col(c) for c in documents.columns])


def visible_search(hits: DataFrame, records: DataFrame, limit: int = 50, id_col: str = "id") -> DataFrame:
    """The best hits among the records that the caller sees; these are what record_set() gave, so nothing hidden takes a rank."""
    return hits.join(records.select(F.col(id_col).alias("record_id")), "record_id", "left_semi").orderBy(F.desc("score"), "record_id").limit(limit)
