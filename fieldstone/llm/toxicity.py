"""Toxicity (op5): FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Pieces
from .common import Places, distinct, dropped, ranked, released, scratch, slices, tidy, write_by_partition

#: Bits of a feature's index.
BITS = 20
#: Training rows that a shard has about, and shards at most: a shard is one task's work in each pass.
SHARD_ROWS, SHARDS = 32768, 32
#: Training rows that a piece has about, which a task holds at once, and pieces at most.
PIECE_ROWS, PIECES = 2048, 4096
#: Coordinates of a slice of the weights' state, which is added up over shards slice by slice; two bytes hold a place in it.
SLICE = 1 << 16
#: Labelled ids up to which the join with texts broadcasts them; beyond, it shuffles.
BROADCAST_IDS = 1_000_000
_SPLIT = str.maketrans({c: " " for c in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~«»¿¡„“”‘’…–—"})
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def word_hashes() -> Pieces:
    return Pieces(lambda w: zlib.crc32(w.encode()) << 32 | zlib.adler32(w.encode()))


def features(texts: list[str], hashes: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every word, pair of neighbours, and pair with one word between; with repeats."""
    words = [t.lower().translate(_SPLIT).split() for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    h = np.fromiter((hashes[w] for own in words for w in own), np.uint64, int(n.sum())) * _ODD[0]
    hashes.trim()
    doc = np.repeat(np.arange(len(texts)), n)
    pair, skip = doc[1:] == doc[:-1], doc[2:] == doc[:-2]
    two = ((h[:-1] ^ (h[:-1] >> np.uint64(29))) * _ODD[1] + h[1:] * _ODD[2])[pair]
    gap = ((h[:-2] ^ (h[:-2] >> np.uint64(31))) * _ODD[3] + h[2:] * _ODD[4])[skip]
    mixed = np.concatenate((h, two, gap))
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _ODD[0]
    return np.concatenate((doc, doc[1:][pair], doc[2:][skip])), (mixed >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Ftrl:
    """FTRL-proximal with a rate of its own for each coordinate; L1 keeps most weights at zero."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 20.0
    l2: float = 1.0
    epochs: int = 8
    #: Rows that a feature must occur in to be learned.
    min_rows: int = 3

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, importance: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
        """Indices and values of the weights that aren't zero, and the bias; each row lists its features once."""
        bias = 1 << BITS
        z, n = np.zeros(bias + 1), np.zeros(bias + 1)
        seen = np.zeros(bias, np.int32)
        for r in rows:
            seen[r] += 1
        rows = [r[seen[r] >= self.min_rows] for r in rows]
        rnd = np.random.default_rng(seed)
        for _ in range(self.epochs):
            order = rnd.permutation(len(rows)).tolist()
            self.learn(z, n, [rows[i] for i in order], labels[order], importance[order])
        return self.weights(z, n)

    def learn(self, z: np.ndarray, n: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, importance: np.ndarray) -> None:
        """One pass over the rows, in order, that changes the state z, n: sums of every coordinate, the bias last."""
        bias = 1 << BITS
        for row, y, much in zip(rows, labels, importance, strict=True):
            at = np.append(row, bias)
            l1 = np.full(len(at), self.l1)
            l1[-1] = 0
            own, seen = z[at], n[at]
            w = self._weights(own, seen, l1)
            g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y) * much
            more = seen + g * g
            z[at] = own + g - (np.sqrt(more) - np.sqrt(seen)) / self.alpha * w
            n[at] = more

    def weights(self, z: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        bias = 1 << BITS
        l1 = np.full(bias + 1, self.l1)
        l1[bias] = 0
        w = self._weights(z, n, l1)
        at = np.flatnonzero(w[:bias])
        return at.astype(np.int32), w[at].astype(np.float32), float(w[bias])

    def _weights(self, z: np.ndarray, n: np.ndarray, l1: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))


def held_out(id_column: Column) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text leaves 1 modulo 3; a row without id is too."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 3 == 1, F.lit(True))


def _packed(own: np.ndarray) -> bytes:
    """The features of a row, in order, at two bytes each: how many begin with each high part, then the low parts."""
    return np.bincount(own >> 16, minlength=1 << (BITS - 16)).astype(np.uint32).tobytes() + (own & 0xFFFF).astype(np.uint16).tobytes()


def _unpacked(row: bytes) -> np.ndarray:
    high = 1 << (BITS - 16)
    return np.repeat(np.arange(high, dtype=np.int32) << 16, np.frombuffer(row, np.uint32, high)) | np.frombuffer(row, np.uint16, offset=4 * high)


def _piece(places: Places, piece: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The different rows of a piece and their labels, in an order that doesn't depend on how they came."""
    found = places.read(piece, ["label", "features"])
    rows = sorted(set(zip(found.column("label").to_pylist(), found.column("features").to_pylist(), strict=True))) if found else []
    return [_unpacked(row) for _, row in rows], np.array([label for label, _ in rows], float)


def _summed(spark: SparkSession, shards: int, work: Callable[[int], tuple[np.ndarray, np.ndarray, np.ndarray]], parts: int) -> str:
    """The folder of the sums over all shards, divided by `parts`, of two values for each coordinate, which work(shard) tells as
    (coordinates in order, first, second). They are added up slice by slice, in the order of shards, and never come through Spark's driver.
    What shards tell lies in the shared folder until it is added up, not in a shuffle, whose files would stay for all passes."""

    @tidy
    def run(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                at, a, b = work(shard)
                edges = np.searchsorted(at, np.arange(0, (1 << BITS) + 2 * SLICE, SLICE))
                told = [(k, i, j) for k, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if i < j]
                columns = (at % SLICE).astype(np.uint16), a.astype(np.float32), b.astype(np.float32)
                yield pa.record_batch([pa.array([k for k, _, _ in told], pa.int64()), pa.array([shard] * len(told), pa.int64()), *(pa.array([x[i:j].tobytes() for _, i, j in told], pa.binary()) for x in columns)], ["part", "shard", "at", "a", "b"])

    many = (1 << BITS) // SLICE + 1
    told = write_by_partition(spark.range(0, shards, 1, shards).mapInArrow(run, "part long, shard long, at binary, a binary, b binary"), "toxic-shards", many, gathered=False)

    @tidy
    def add(batches):
        for batch in batches:
            for part in batch.column(0).to_pylist():
                if found := told.read(part, ["shard", "at", "a", "b"]):
                    found = found.sort_by("shard")
                    at, a, b = (np.frombuffer(b"".join(found.column(c).to_pylist()), t) for c, t in (("at", np.uint16), ("a", np.float32), ("b", np.float32)))
                    own, place = ranked(at)
                    a, b = ((np.bincount(place, x) / parts).astype(np.float32).tobytes() for x in (a, b))
                    yield pa.record_batch([pa.array([part], pa.int64()), *(pa.array([x], pa.binary()) for x in (own.tobytes(), a, b))], ["slice", "at", "a", "b"])

    path = scratch(spark, "toxic-state")
    spark.range(0, many, 1, many).mapInArrow(add, "slice long, at binary, a binary, b binary").write.parquet(path)
    dropped(spark, told.folder)
    return path


def _sums(folder: str) -> tuple[np.ndarray, np.ndarray]:
    """What _summed wrote, with a place for every coordinate."""
    out = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    system, root = pafs.FileSystem.from_uri(folder)
    for f in system.get_file_info(pafs.FileSelector(root)):
        if f.path.endswith(".parquet"):
            for r in pq.read_table(f.path, filesystem=system, partitioning=None).to_pylist():
                at = np.frombuffer(r["at"], np.uint16).astype(np.int64) + r["slice"] * SLICE
                out[0][at], out[1][at] = np.frombuffer(r["a"], np.float32), np.frombuffer(r["b"], np.float32)
    return out


@released
def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", model: Ftrl | None = None, shard_rows: int = SHARD_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Fits on all labelled rows that aren't held out, with all their features. Rows of equal label and features count once, both classes
    weigh the same. Several labels of an id count as toxic if one does. Without labelled rows of both classes there are no weights and
    every score is the share of toxic rows, a half without any.

    The rows' features are dealt by their digest to pieces in the shared folder, so that the result doesn't depend on partitions, and
    pieces to shards. In each pass every shard learns from the common state, and the mean of the shards' states is the next one.
    The driver reads the last state alone. What the shards of a pass tell is deleted once it is added up, the rows' features after the last."""
    spark, model = docs.sparkSession, model or Ftrl()
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("key")).agg(F.max(F.col(label_col).cast("int")).alias("label")).filter("label IN (0, 1)")
    total = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    every = sum(total.values())
    share = total.get(1, 0) / every if total else 0.5
    prior = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    nothing = np.zeros(0, np.int32), np.zeros(0, np.float32), prior
    if len(total) < 2:
        return nothing
    pieces = min(PIECES, -(-every // PIECE_ROWS))
    shards = min(SHARDS, pieces, -(-every // shard_rows))

    @tidy
    def run(batches):
        hashes, seen = word_hashes(), set()
        for part, texts in slices(batches, text_col):
            doc, feature = features(texts, hashes)
            pairs = distinct(doc << BITS | feature)
            cutoff = np.searchsorted(pairs, np.arange(len(texts) + 1) << BITS)
            own, out = pairs & ((1 << BITS) - 1), []
            for label, a, b in zip(part.column(0).to_pylist(), cutoff[:-1], cutoff[1:], strict=True):
                row = _packed(own[a:b])
                digest = blake2b(row + bytes([label]), digest_size=16).digest()
                if digest not in seen:
                    seen.add(digest)
                    out.append((int.from_bytes(digest[:7], "little") % pieces, label, row))
            yield pa.record_batch([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["part", "label", "features"])

    ids = F.broadcast(known) if every <= BROADCAST_IDS else known
    joined = docs.select(F.col(id_col).alias("key"), text_col).join(ids, "key").select("label", text_col)
    places = write_by_partition(joined.mapInArrow(run, "part long, label int, features binary"), "toxic-rows", pieces)

    def counted(shard):
        seen, kinds = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
        for piece in range(shard, pieces, shards):
            for row, label in zip(*_piece(places, piece), strict=True):
                seen[row] += 1
                seen[-1] += label
                kinds[-1] += 1
        at = np.append(np.flatnonzero(seen[:-1]), 1 << BITS)
        return at, seen[at], kinds[at]

    counts = _summed(spark, shards, counted, 1)
    toxic, rows = (float(x[-1]) for x in _sums(counts))
    if not 0 < toxic < rows:
        dropped(spark, places.folder)
        return nothing
    state = None
    for epoch in range(model.epochs):

        def learned(shard, epoch=epoch, state=state):
            z, n = _sums(state) if state else (np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1))
            frequent = _sums(counts)[0] >= model.min_rows
            rnd = np.random.default_rng([7, epoch, shard])
            for piece in rnd.permutation(range(shard, pieces, shards)).tolist():
                own, y = _piece(places, piece)
                order = rnd.permutation(len(own)).tolist()
                y = y[order]
                model.learn(z, n, [own[i][frequent[own[i]]] for i in order], y, np.where(y == 1, (rows - toxic) / toxic, 1.0))
            at = np.flatnonzero(n)
            return at, z[at], n[at]

        state = _summed(spark, shards, learned, shards)
    dropped(spark, places.folder)
    return model.weights(*_sums(state))


def _scores(texts: list[str], dense: np.ndarray, bias: float, hashes: Pieces) -> np.ndarray:
    doc, feature = features(texts, hashes)
    told = dense[feature] != 0
    pairs = distinct(doc[told] << BITS | feature[told])
    total = bias + np.bincount(pairs >> BITS, dense[pairs & ((1 << BITS) - 1)], len(texts))
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _dense(at: np.ndarray, values: np.ndarray) -> np.ndarray:
    dense = np.zeros(1 << BITS)
    dense[at] = values
    return dense


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Scores every whole text: id_col, held_out, score (0 to 1), predicted (score >= threshold).

    Only texts enter a score. A null text counts as empty, and an empty text has the score of the bias alone; a text of any length
    counts whole. Repeated rows and null ids each give a row; an empty table gives none; other columns are not read."""
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col))

    @tidy
    def run(batches):
        at, values, bias = weights.value
        dense, hashes = _dense(at, values), word_hashes()
        for part, texts in slices(batches, text_col):
            yield pa.record_batch([part.column(0), pa.array(_scores(texts, dense, bias, hashes))], [id_col, "score"])

    scored = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold; scores as in toxicity()."""
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col))

    @tidy
    def run(batches):
        at, values, bias = weights.value
        dense, hashes = _dense(at, values), word_hashes()
        for part, texts in slices(batches, text_col):
            yield part.filter(pa.array(_scores(texts, dense, bias, hashes) < threshold))

    return docs.mapInArrow(run, docs.schema)
