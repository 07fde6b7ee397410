"""Quality classifier (op2): perplexity under an interpolated modified Kneser-Ney model of character 4-grams of trusted text.

The model's counts lie in sharded tables. The n-grams that a partition of documents needs are looked up there by joins, level by level, and
the answers come back as a table for each partition in the shared folder, so that texts themselves are never shuffled. Trusted texts are
dealt to two folds by a hash, each with a model of its own, and every document is scored by the model of the fold that its text isn't in:
so no text, trusted or not, is scored by a model that has seen it, and the thresholds hold for new texts as for trusted ones."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Places, cut, distinct, from_files, ranked, slices, tidy, write_by_partition

ORDER = 4
#: Distinct n-grams that a task holds before it passes on what it has counted.
HELD = 1_000_000
#: Trusted ids and languages up to which a join broadcasts them; beyond, it shuffles.
BROADCAST_IDS, BROADCAST_LANGS = 1_000_000, 10_000
#: Characters of the language's mean that a document's own are mixed with, so that a few odd ones don't decide over a short text.
PRIOR_CHARS = 64
#: Rejection starts above this quantile of the language's trusted texts.
QUANTILE = 0.995
#: Folds of texts, by their hash, so that copies of a text are in one fold.
FOLDS = 2
#: Distinct trusted texts from which a language has a threshold of its own.
MIN_TRUSTED = 50
#: With fewer, the threshold lies above the median of all the language's texts by this many times the median's distance from LOW, their low quantile.
SPREAD, LOW = 3.0, 0.01


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For every character the key of the 4-gram that it ends, 16 bits a character, and its text. Code points beyond 16 bits take the
    2,048 codes of surrogates, which no text holds, by their lowest 11 bits."""
    joined = "".join("\0\0\0" + t for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le" if sys.byteorder == "little" else "utf-32-be"), np.uint32)
    points = np.where(points > 0xFFFF, 0xD800 + (points & 0x7FF), points).astype(np.uint64)
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    keys = points[3:].copy()
    for back in (1, 2, 3):
        keys |= points[3 - back : len(points) - back] << np.uint64(16 * back)
    begin = np.cumsum(n + 3) - n - 3
    at = np.arange(int(n.sum())) + np.repeat(begin - (np.cumsum(n) - n), n)
    return keys[at].view(np.int64), np.repeat(np.arange(len(texts)), n)


def _by_model(part: pa.RecordBatch, texts: list[str]) -> list[tuple[int, np.ndarray]]:
    """(model, places of its texts) of a slice with the column __model."""
    model = part.column(part.schema.get_field_index("__model")).to_numpy(zero_copy_only=False)
    return [(int(m), np.flatnonzero(model == m)) for m in distinct(model)]


def _counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(model, key, n) of the texts of docs (text_col, __model)."""

    @tidy
    def run(batches):
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(own):
            keys, at = ranked(np.concatenate([k for k, _ in own]))
            return keys, np.bincount(at, np.concatenate([c for _, c in own])).astype(np.int64)

        def told(model, keys, counts):
            return pa.record_batch([pa.array(np.full(len(keys), model, np.int32)), pa.array(keys), pa.array(counts)], ["model", "key", "n"])

        for part, texts in slices(batches, text_col):
            for m, places in _by_model(part, texts):
                codes, seen = pd.factorize(grams([texts[i] for i in places])[0])
                own = held.setdefault(m, [])
                own.append((seen, np.bincount(codes, minlength=len(seen))))
                if sum(len(k) for k, _ in own) > 2 * HELD // FOLDS:
                    own[:] = [merged(own)]
                    if len(own[0][0]) > HELD // FOLDS:
                        yield told(m, *own.pop())
        for m, own in held.items():
            if own:
                yield told(m, *merged(own))

    return docs.select(text_col, "__model").mapInArrow(run, "model int, key long, n long").groupBy("model", "key").agg(F.sum("n").alias("n"))


def _suffix(level: int):
    return F.col("key").bitwiseAND(F.lit((1 << 16 * (level - 1)) - 1)) if level > 1 else F.lit(0).cast("long")


def _chosen(values: dict[int, float], default: float) -> Column:
    """The value of the row's model."""
    out = F.lit(default)
    for m, x in values.items():
        out = F.when(F.col("model") == m, F.lit(x)).otherwise(out)
    return out


def _levels(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For levels 1 to 4: (model, key, own: discounted share of its context) and (model, context, left: weight that the context leaves to the level below)."""
    level, out = counts, []
    for order in range(ORDER, 0, -1):
        if order < ORDER:
            level = cut(level.groupBy("model", _suffix(order + 1).alias("key")).agg(F.count(F.lit(1)).alias("n")), f"kn{order}")
        taken: list[dict[int, float]] = [{}, {}, {}]
        for r in level.groupBy("model").agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).collect():
            y = r.n1 / (r.n1 + 2 * r.n2) if r.n1 else 0.0
            for i, a, b in ((1, r.n1, r.n2), (2, r.n2, r.n3), (3, r.n3, r.n4)):
                taken[i - 1][r.model] = max(0.0, min(float(i), i - (i + 1) * y * b / a)) if a and b else 0.5 * i
        d = [_chosen(x, 0.0) for x in taken]
        discount = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        context = F.shiftrightunsigned("key", 16) if order > 1 else F.lit(0).cast("long")
        contexts = level.groupBy("model", context.alias("context")).agg(F.sum("n").alias("total"), F.sum(discount).alias("taken"), F.count(F.lit(1)).alias("kinds"))
        own = level.withColumn("context", context).join(contexts, ["model", "context"]).select("model", "key", ((F.col("n") - discount) / F.col("total")).alias("own"))
        out.append((own, contexts.select("model", "context", (F.col("taken") / F.col("total")).alias("left"), "kinds")))
    return out[::-1]


def _surprise(wanted: DataFrame, levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(model, key, nll) of every wanted 4-gram. Levels are joined from the lowest; a key of a level meets at most an alphabet of keys above."""
    keys = [wanted]
    for order in range(ORDER, 1, -1):
        keys.append(keys[-1].select("model", _suffix(order).alias("key")).distinct())
    keys.reverse()
    own, contexts = levels[0]
    rest = _chosen({r.model: r.left / (r.kinds + 1) for r in contexts.collect()}, 1.0)  # one context a model
    below = keys[0].join(own, ["model", "key"], "left").select("model", "key", (F.coalesce("own", F.lit(0.0)) + rest).alias("p"))
    for order in range(2, ORDER + 1):
        own, contexts = levels[order - 1]
        asked = keys[order - 1].withColumn("context", F.shiftrightunsigned("key", 16)).withColumn("suffix", _suffix(order))
        asked = asked.join(own, ["model", "key"], "left").join(contexts.select("model", "context", "left"), ["model", "context"], "left")
        asked = asked.join(below.select("model", F.col("key").alias("suffix"), "p"), ["model", "suffix"])
        below = asked.select("model", "key", (F.coalesce("own", F.lit(0.0)) + F.coalesce("left", F.lit(1.0)) * F.col("p")).alias("p"))
    return below.select("model", "key", (-F.ln("p")).alias("nll"))


def _looked_up(docs: DataFrame, counts: DataFrame, text_col: str) -> Places:
    """Fits the models on `counts` and answers, for each partition of docs, what the 4-grams that it asks of them cost."""
    levels = _levels(counts)

    @tidy
    def asks(batches):
        held: dict[int, np.ndarray] = {}
        new: dict[int, list[np.ndarray]] = {}
        for part, texts in slices(batches, text_col):
            for m, places in _by_model(part, texts):
                own = new.setdefault(m, [])
                own.append(pd.unique(grams([texts[i] for i in places])[0]))
                if sum(map(len, own)) > HELD:
                    held[m] = distinct(np.concatenate([held.get(m, np.zeros(0, np.int64)), *own]))
                    own.clear()
        number = TaskContext.get().partitionId()
        for m, own in new.items():
            keys = distinct(np.concatenate([held.get(m, np.zeros(0, np.int64)), *own]))
            for at in range(0, len(keys), 100_000):
                some = keys[at : at + 100_000]
                yield pa.record_batch([pa.array(np.full(len(some), number, np.int64)), pa.array(np.full(len(some), m, np.int32)), pa.array(some)], ["part", "model", "key"])

    wanted = cut(docs.select(text_col, "__model").mapInArrow(asks, "part long, model int, key long"), "kn-asked")
    told = _surprise(wanted.select("model", "key").distinct(), levels)
    return write_by_partition(wanted.join(told, ["model", "key"]), "kn-told", docs.rdd.getNumPartitions())


def _scored(docs: DataFrame, answers: Places, text_col: str, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs with __chars and __nll, the sum over a text's characters. docs is read a second time here, and each
    partition has to hold the rows that it held before."""

    @tidy
    def score(batches):
        tables = None
        for part, texts in slices(batches, text_col):
            total, chars = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for m, places in _by_model(part, texts):
                own, doc = grams([texts[i] for i in places])
                if not len(own):
                    continue
                tables = tables or _answers(answers, TaskContext.get().partitionId())
                keys, nll = tables.get(m, (np.zeros(0, np.int64), np.zeros(0)))
                codes, seen = pd.factorize(own)
                at = np.minimum(np.searchsorted(keys, seen), max(0, len(keys) - 1))
                if not len(keys) or not (keys[at] == seen).all():
                    raise RuntimeError("the documents' partitions changed between two readings; write them to a table first")
                total[places] = np.bincount(doc, nll[at][codes], len(places))
                chars[places] = np.bincount(doc, minlength=len(places))
            yield pa.record_batch([*(part.column(part.schema.get_field_index(c)) for c in keep), pa.array(chars), pa.array(total)], [*keep, "__chars", "__nll"])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("__chars", T.LongType()), T.StructField("__nll", T.DoubleType())])
    return docs.select(*dict.fromkeys([*keep, text_col, "__model"])).mapInArrow(score, schema)


def _answers(places: Places, part: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    found = places.read(part, ["model", "key", "nll"])
    if found is None:
        return {}
    model, keys, nll = (found.column(c).to_numpy() for c in ("model", "key", "nll"))
    out = {}
    for m in distinct(model):
        order = np.flatnonzero(model == m)
        order = order[np.argsort(keys[order], kind="stable")]
        out[int(m)] = keys[order], nll[order]
    return out


def perplexities(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(id_col, lang, chars, nll) of every row of docs, by one model of all rows of `trusted`."""
    docs = from_files(docs, "quality-docs").withColumn("__model", F.lit(0))
    answers = _looked_up(docs, cut(_counts(trusted.withColumn("__model", F.lit(0)), text_col), "kn4"), text_col)
    told = _scored(docs, answers, text_col, [id_col, lang_col])
    return told.select(id_col, F.col(lang_col).alias("lang"), F.col("__chars").alias("chars"), F.col("__nll").alias("nll"))


class _Limits:
    """A language's mean and threshold, from trusted rows `held` (lang, text_hash, chars, nll) that models without them scored. A language
    with fewer than MIN_TRUSTED distinct trusted texts takes the threshold of all, raised over the bulk of its own rows in `scored` (lang,
    chars, nll); one with fewer than MIN_TRUSTED different rows there too has none."""

    def __init__(self, held: DataFrame, scored: DataFrame):
        known = held.filter("chars > 0")
        self.mean = known.agg((F.sum("nll") / F.sum("chars")).alias("mean")).first().mean
        self.means = known.groupBy("lang").agg((F.sum("nll") / F.sum("chars")).alias("mean"))
        judged = cut(self._mixed(known), "quality-trusted")
        kinds = cut(judged.select("lang", "text_hash").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("kinds")), "quality-kinds")
        enough = kinds.filter(F.col("kinds") >= MIN_TRUSTED).select(F.col("lang").alias("of"))
        own = judged.join(self._small(enough), F.col("lang").eqNullSafe(F.col("of")), "left_semi")
        limits = self._limit(own.groupBy("lang"))
        if (kinds.agg(F.sum("kinds")).first()[0] or 0) >= MIN_TRUSTED:
            rest = self._mixed(scored.filter("chars > 0").join(self._small(enough), F.col("lang").eqNullSafe(F.col("of")), "left_anti"))
            q = F.percentile_approx("mixed", [LOW, 0.5], 10_000)
            bulk = rest.select("lang", "mixed").distinct().groupBy("lang").agg((q[1] + SPREAD * (q[1] - q[0])).alias("threshold"), F.count(F.lit(1)).alias("n"))
            every = F.lit(self._limit(judged).first().threshold)
            limits = limits.unionByName(bulk.filter(F.col("n") >= MIN_TRUSTED).select("lang", F.greatest("threshold", every).alias("threshold")))
        self.by_lang = cut(limits, "quality-limits")

    @staticmethod
    def _small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= BROADCAST_LANGS else df

    def _mixed(self, df: DataFrame) -> DataFrame:
        mean = F.coalesce("mean", F.lit(self.mean), F.lit(0.0))
        joined = df.join(self._small(self.means).withColumnRenamed("lang", "of"), F.col("lang").eqNullSafe(F.col("of")), "left")
        return joined.withColumn("mixed", (F.col("nll") + PRIOR_CHARS * mean) / (F.col("chars") + PRIOR_CHARS)).drop("of", "mean")

    @staticmethod
    def _limit(df):
        return df.agg(F.percentile_approx("mixed", QUANTILE, 10_000).alias("threshold"))

    def judge(self, df: DataFrame) -> DataFrame:
        """df (lang, chars, nll, ...) with threshold and rejected."""
        limits = self._small(self.by_lang).withColumnRenamed("lang", "of")
        out = self._mixed(df).join(limits, F.col("lang").eqNullSafe(F.col("of")), "left")
        return out.withColumn("rejected", F.coalesce((F.col("chars") > 0) & (F.col("mixed") > F.col("threshold")), F.lit(False))).drop("mixed", "of")


def _trusted_ids(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    ids = labels.filter((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("trusted_id")).distinct()
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _judged(docs: DataFrame, labels: DataFrame, id_col: str, lang_col: str, text_col: str, label_col: str) -> tuple[DataFrame, Places, DataFrame, _Limits]:
    """docs with the model that each text asks, the models' answers, scores (id_col, lang, text_hash, chars, nll) and thresholds."""
    docs = from_files(docs, "quality-docs")
    fold = F.pmod(F.xxhash64(text_col), F.lit(FOLDS)).cast("int")
    ids = _trusted_ids(labels, id_col, label_col)
    trusted = docs.select(id_col, text_col).join(ids, F.col(id_col) == F.col("trusted_id"), "left_semi").select(text_col, fold.alias("__model"))
    docs = docs.withColumn("__model", (FOLDS - 1 - fold).cast("int"))
    answers = _looked_up(docs, cut(_counts(trusted, text_col), "kn4"), text_col)
    told = _scored(docs.withColumn("__hash", F.xxhash64(text_col)), answers, text_col, [id_col, lang_col, "__hash"])
    scored = cut(told.select(id_col, F.col(lang_col).alias("lang"), F.col("__hash").alias("text_hash"), F.col("__chars").alias("chars"), F.col("__nll").alias("nll")), "quality")
    held = scored.join(ids, F.col(id_col) == F.col("trusted_id"), "left_semi")
    return docs, answers, scored, _Limits(held, scored)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Judges every row: id_col, lang, chars, log_perplexity (nats per character), threshold, rejected.

    Trusted are the rows whose id is labelled 1, all of them. Every text is scored by the model of the trusted texts of the other fold. A
    document is rejected if its log perplexity, mixed with PRIOR_CHARS characters of its language's mean, lies above the language's
    threshold: QUANTILE of the language's trusted texts. Languages with fewer than MIN_TRUSTED distinct trusted texts, and the null one
    alike, take the threshold of all trusted texts or, if higher, one above the bulk of their own rows (SPREAD, LOW); with too few rows
    for that, they have no threshold and nothing is rejected. Null and empty texts have no perplexity and are kept; a text of any length
    counts whole; without any trusted text nothing is rejected. Repeated rows each give a row; an empty table gives none."""
    _, _, scored, limits = _judged(docs, labels, id_col, lang_col, text_col, label_col)
    told = limits.judge(scored)
    return told.select(id_col, "lang", "chars", F.when(F.col("chars") > 0, F.col("nll") / F.col("chars")).alias("log_perplexity"), "threshold", "rejected")


def reject_poor(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of docs, with all their columns, that quality() doesn't reject, decided row by row."""
    columns = docs.columns
    docs, answers, _, limits = _judged(docs, labels, id_col, lang_col, text_col, label_col)
    whole = _scored(docs, answers, text_col, columns)
    packed = whole.select(F.struct(*columns).alias("__row"), F.col(lang_col).alias("lang"), F.col("__chars").alias("chars"), F.col("__nll").alias("nll"))
    return limits.judge(packed).filter(~F.col("rejected")).select("__row.*")
