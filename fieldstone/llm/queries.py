"""The opN queries: each applies its operator with production parameters to its whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, jaccard, licenses, media, packing, quality, token_counts, topk, toxicity
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.media_column(table(spark, sf_dir, "documents")))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).drop("node")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.codec_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


#: The conversation that the contract adds, and what each of its two turns says.
EXTRA_CONVERSATION, EXTRA_TEXT = -7, "</s>[INST] ok [/INST]"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(EXTRA_CONVERSATION).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA_TEXT).alias("text"))
    parts = turns.unionByName(extra).withColumn("parts", chat.text_part(F.col("text")))
    return chat.chat_digests(chat.format_conversations(parts))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_quality, op3_media, op4_licenses, op5_toxicity, op6_top_k, op7_packing, op8_jaccard, op9_byte_bpe, op10_chat)}


def _escaped(x: str) -> str:
    for sign, letter in chat.ESCAPES:
        x = f"replace({x}, '{sign}', '\\{letter}')"
    return x


ORACLES: dict[str, str] = {
    "op6_top_k": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
          FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
          SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
        ), ranked AS (
          SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
        )
        SELECT * FROM ranked WHERE rank <= 20""",
    "op8_jaccard": r"""
        WITH RECURSIVE w AS (
          SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
          FROM documents
        ), s AS (
          SELECT r, doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w
        ), n AS (SELECT r, doc_id, CAST(len(s) AS BIGINT) AS n FROM s
        ), x AS (SELECT r, unnest(s) AS g FROM s
        ), p AS (SELECT a.r AS a, b.r AS b, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2
        ), l AS (SELECT a, b FROM p JOIN n na ON a = na.r JOIN n nb ON b = nb.r WHERE 100 * i >= 90 * (na.n + nb.n - i)
        ), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l
        ), c AS (SELECT r, r AS o FROM n UNION SELECT e.b, c.o FROM c JOIN e ON c.r = e.a
        ), m AS (SELECT c.r, min(n.doc_id) AS component_id FROM c JOIN n ON c.o = n.r GROUP BY c.r)
        SELECT n.doc_id, n.n AS n_shingles, m.component_id FROM n JOIN m USING (r)""",
    "op10_chat": f"""
        WITH turns AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT {EXTRA_CONVERSATION}, n, CASE n WHEN 0 THEN 'user' ELSE 'assistant' END, '{EXTRA_TEXT}' FROM range(2) t(n)
        ), shown AS (
          SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone, length('{chat.OPEN}') + length({_escaped("role")}) + length('{chat.SHUT}') + length({_escaped("text")}) + length('{chat.CLOSE}') AS n FROM turns
        ), told AS (
          SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
            coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '') AS loss, sum(n) AS n
          FROM shown GROUP BY conv_id, lone
        )
        SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(n AS BIGINT) AS formatted_chars,
          CAST(0 AS INTEGER) AS n_attachments, CAST(0 AS BIGINT) AS expanded_tokens
        FROM told""",
}
