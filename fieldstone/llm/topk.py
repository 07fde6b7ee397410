"""Exact top-k search by inner product (op6): vectors grouped by length over the whole table, pruned by local cosine thresholds, then verified.

One sort deals all vectors by length to ranges, whose shards hold vectors of about the same length. Each query starts from the k-th score
that it has among the longest vectors and in its own shard, and goes only to ranges whose longest vector can reach that."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Vectors in a shard, the unit that meets blocks of queries, and in one of its buckets of similar length.
SHARD, BUCKET = 4096, 256
#: Median local cosine threshold of a bucket from which candidates are pruned by a coordinate, else by length.
COORDINATE_FROM = 0.5
_LARGEST = 1 << 62
_SCHEMA = "kind string, g long, shard long, longest double, n int, dim int, ids binary, vectors binary, bounds binary"
_FIELDS = ("shard", "n", "dim", "ids", "vectors", "bounds")


class Best:
    """The k best (score, id) of each query so far, ties to the smaller id, and the score to reach."""

    def __init__(self, ids: np.ndarray, k: int, bounds: np.ndarray):
        self.ids, self.k, self.bounds = ids, k, bounds.copy()
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]

    def offer(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        own = self.found[query]
        own += zip((-scores).tolist(), ids.tolist(), strict=True)
        if len(own) >= self.k:
            own.sort()
            del own[self.k :]
            self.bounds[query] = max(self.bounds[query], -own[-1][0])


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors, exact: in doubles where no partial sum can pass 2**53, else in Python's integers."""
    if not len(q) or not len(c):
        return np.zeros((len(q), len(c)), np.int64)
    most = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if most < 1 << 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return q @ c.T
    out = q.astype(object) @ c.astype(object).T
    if any(abs(x) >= 1 << 63 for x in out.ravel()):
        raise OverflowError("an inner product doesn't fit a long")
    return out.astype(np.int64)


def search(best: Best, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
    """Offers to each query what can be among its best of a shard, whose vectors are sorted by falling length."""
    width = max(queries.shape[1], vectors.shape[1])
    queries, vectors = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (queries, vectors))
    q_len = np.linalg.norm(queries.astype(np.float64), axis=1)
    c_len = np.linalg.norm(vectors.astype(np.float64), axis=1)
    focus = np.abs(queries).argmax(axis=1) if width else np.zeros(len(queries), int)
    for at in range(0, len(ids), BUCKET):
        own, length, vec = ids[at : at + BUCKET], c_len[at : at + BUCKET], vectors[at : at + BUCKET]
        # A little slack keeps rounding from pruning what reaches the bound exactly.
        reach = q_len * length[0] * (1 + 1e-9) + 1e-6
        active = np.flatnonzero(best.bounds <= reach)
        if not len(active):
            continue
        cosine = np.clip(best.bounds[active] / np.maximum(reach[active], 1e-300), -1, 1)
        if width and np.median(cosine) >= COORDINATE_FROM:
            unit = vec / np.maximum(length, 1e-300)[:, None]
            for a, t in zip(active.tolist(), cosine.tolist(), strict=True):
                f = focus[a]
                x = queries[a, f] / max(q_len[a], 1e-300)
                near = np.flatnonzero(x * unit[:, f] + np.sqrt(np.maximum(0, (1 - x * x) * (1 - unit[:, f] ** 2))) >= t - 1e-9) if t > 0 else np.arange(len(own))
                if len(near):
                    _verify(best, np.array([a]), queries, own[near], vec[near])
        else:
            shortest = (best.bounds[active] / np.maximum(q_len[active], 1e-300)).min() * (1 - 1e-9) - 1e-6
            n = len(own) if not np.isfinite(shortest) else int(np.searchsorted(-length, -shortest, "right"))
            _verify(best, active, queries, own[:n], vec[:n])


def _verify(best: Best, active: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
    scores = products(queries[active], vectors)
    hit = (scores >= best.bounds[active][:, None]) & (best.ids[active][:, None] != ids[None])
    for r in np.flatnonzero(hit.any(axis=1)).tolist():
        # Against the bound of now: earlier buckets may have raised it.
        keep = np.flatnonzero(hit[r] & (scores[r] >= best.bounds[active[r]]))
        if len(keep) > best.k:
            keep = keep[np.lexsort((ids[keep], -scores[r][keep]))[: best.k]]
        best.offer(int(active[r]), ids[keep], scores[r][keep])


def _load(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.int64 if row["n"] * row["dim"] * 8 == len(row["vectors"]) else np.int16).reshape(row["n"], row["dim"]).astype(np.int64), np.frombuffer(row["bounds"], np.float64)


def _row(kind: str, g: int, shard: int, longest: float, ids: np.ndarray, vectors: np.ndarray, bounds: np.ndarray) -> tuple:
    small = not vectors.size or np.abs(vectors).max() < 1 << 15
    return kind, g, shard, longest, len(ids), vectors.shape[1], ids.tobytes(), vectors.astype(np.int16 if small else np.int64).tobytes(), bounds.tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [f.split()[0] for f in _SCHEMA.split(", ")])


def top_k(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, groups: int | None = None) -> DataFrame:
    """For each row for which is_query (a Column) holds, its k best other rows by inner product of the vectors floor(scale * x).

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller id, fewer than k rows give what there is. Rows whose id or
    vector is null, or whose vector holds a null or a non-finite component, take no part; a shorter vector counts as ended by zeros.
    Rows that repeat a query's id are its own and no candidates of it; repeated queries each give their rows. No other column is read."""
    spark = vectors.sparkSession
    groups = groups or int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = F.col(vector_col)
    whole = F.transform(x, lambda e: F.floor(F.lit(scale) * e.cast("double")))
    sound = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda e: F.coalesce((e == e) & (F.abs(e) < F.lit(float("inf"))), F.lit(False)))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(sound, whole).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).filter("v is not null")
    # Vectors of equal length are told apart by a hash, so that a frequent length spreads over ranges.
    length = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
    ranged = rows.withColumn("length", length).withColumn("tie", F.xxhash64("id", F.col("asks"))).repartitionByRange(groups, F.desc("length"), "tie").sortWithinPartitions(F.desc("length"), "tie").select("id", "v", "asks")

    def pack(batches):
        """Shards of candidates by falling length, and the queries among them with a bound: their k-th score within the shard."""
        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal made
            ids, asks = (np.concatenate([h[i] for h in held]) for i in (0, 2))
            width = max(h[1].shape[1] for h in held)
            vec = np.concatenate([np.pad(h[1], ((0, 0), (0, width - h[1].shape[1]))) for h in held])
            lengths = np.linalg.norm(vec.astype(np.float64), axis=1)
            order = np.lexsort((ids, -lengths))
            ids, vec, asks = ids[order], vec[order], asks[order]
            shard, longest = part << 24 | made, float(lengths.max(initial=0))
            made += 1
            out = [_row("shard", part, shard, longest, ids, vec, np.zeros(0))]
            if asks.any():
                best = Best(ids[asks], k, np.full(int(asks.sum()), -np.inf))
                search(best, vec[asks], ids, vec)
                out.append(_row("queries", part, shard, longest, ids[asks], vec[asks], best.bounds))
            return _batch(out)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                b = batch.slice(at, SHARD - size)
                lists = b.column(1)
                many = np.diff(lists.offsets.to_numpy()).astype(np.int64)
                vec = np.zeros((b.num_rows, int(many.max(initial=0))), np.int64)
                vec[np.arange(vec.shape[1])[None] < many[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
                held.append((b.column(0).to_numpy(zero_copy_only=False), vec, b.column(2).to_numpy(zero_copy_only=False).astype(bool)))
                at, size = at + b.num_rows, size + b.num_rows
                if size >= SHARD:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    packed = cut(ranged.mapInArrow(pack, _SCHEMA), "topk")
    of_kind = lambda kind: packed.filter(F.col("kind") == kind)
    reach = {r.g: r.longest for r in of_kind("shard").groupBy("g").agg(F.max("longest").alias("longest")).collect()}  # a row for each range
    # The shards of the longest vectors, as many as make up a full one, whatever the number of partitions.
    names, many = [], 0
    for r in of_kind("shard").select("shard", "n", "longest").orderBy(F.desc("longest"), "shard").limit(SHARD).collect():
        if names and many + r.n > SHARD:
            break
        names, many = [*names, r.shard], many + r.n
    first = of_kind("shard").filter(F.col("shard").isin(names)).select(*_FIELDS).collect()
    longest = spark.sparkContext.broadcast((reach, [r.asDict() for r in first]))

    def aim(batches):
        """Query blocks with bounds raised by the longest vectors, once for each range that a query of the block can gain from."""
        reach, shards = longest.value
        for batch in batches:
            for row in batch.to_pylist():
                ids, vec, bounds = _load(row)
                for s in shards:
                    if s["shard"] != row["shard"]:
                        best = Best(ids, k, bounds)
                        search(best, vec, *_load(s)[:2])
                        bounds = best.bounds
                own = np.linalg.norm(vec.astype(np.float64), axis=1)
                for g, top in reach.items():
                    some = bounds <= own * top * (1 + 1e-9) + 1e-6
                    if some.any():  # the others ask for what no vector reaches
                        yield _batch([_row("queries", g, row["shard"], row["longest"], ids, vec, np.where(some, bounds, np.inf))])

    asked = of_kind("queries").mapInArrow(aim, _SCHEMA).select("g", F.struct(*_FIELDS).alias("q"))
    shards = of_kind("shard").select("g", F.struct(*_FIELDS).alias("c"))

    def meet(batches):
        """The best of each query over the shards that follow one another for its block; a bound found in one holds in the next."""
        held = None

        def told():
            found = [(held[0], n, int(held[2][n]), i, -s) for n, own in enumerate(held[1].found) for s, i in sorted(own)[:k]]
            return [pa.record_batch([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["block", "nth", "query_id", "vec_id", "score"])] if found else []

        for batch in batches:
            for i in range(batch.num_rows):
                q = batch.column(0)[i].as_py()
                if held is None or held[0] != q["shard"]:
                    if held:
                        yield from told()
                    ids, vec, bounds = _load(q)
                    held = (q["shard"], Best(ids, k, bounds), ids, vec)
                search(held[1], held[3], *_load(batch.column(1)[i].as_py())[:2])
        if held:
            yield from told()

    met = asked.join(shards, "g").select("q", "c").mapInArrow(meet, "block long, nth long, query_id long, vec_id long, score long")
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("block", "nth").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
