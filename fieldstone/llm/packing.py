"""Packing (op7): hierarchical packing of token sequences into windows of several lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices, tidy
from .library_pieces import PieceIds, ids_of, special_tokens
from .pretokens import tokenizers_classes

#: Window lengths, longest first; all powers of two, so that a full window of any tier needs no padding.
TIERS = (1024, 512, 256, 128, 64)
#: Remainders that wait for a window before packing starts; bounds a task's memory.
POOL = 4096
#: Tokens of a step group: as many windows of one tier as make this sum.
STEP_TOKENS = 65_536

Piece = tuple[int, int, int, int, int, int, int]


class Packer:
    """Packs the documents of one partition. Whole windows of the longest tier are cut off first. What is left of a document is routed to
    the shortest tier that holds it; each tier's windows are packed from the longest down, and the gap in a window is filled with the
    longest waiting pieces of shorter tiers that fit, at last by cutting one. The tail of a partition goes to ever shorter windows."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, shard: int = 0):
        self.tiers, self.shard = tiers, shard
        self.waiting: list[list[tuple]] = [[] for _ in range(tiers[0] + 1)]
        self.mask = self.count = self.tokens = self.sequences = 0
        self.by_tier = dict.fromkeys(tiers, 0)

    def _put(self, item: tuple) -> None:
        n = len(item[2])
        self.waiting[n].append(item)
        self.mask |= 1 << n
        self.count += 1
        self.tokens += n

    def _take(self, n: int) -> tuple:
        item = self.waiting[n].pop()
        if not self.waiting[n]:
            self.mask &= ~(1 << n)
        self.count -= 1
        self.tokens -= n
        return item

    def add(self, doc: object, ids: np.ndarray) -> Iterator[tuple]:
        top, n = self.tiers[0], len(ids)
        whole = n // top * top
        for start in range(0, whole, top):
            yield from self._window(top, [(doc, start, ids[start : start + top], n)])
        if whole < n:
            self._put((doc, whole, ids[whole:].copy(), n))
        if self.count > POOL:
            yield from self.pack(POOL // 2)

    def pack(self, keep: int = 0) -> Iterator[tuple]:
        while self.count > keep:
            longest = self.mask.bit_length() - 1
            room = next(t for t in reversed(self.tiers) if t >= longest)
            if self.tokens < room:
                room = 1 << (self.tokens.bit_length() - 1)
            parts, tier = [], room
            while room:
                fits = (self.mask & ((1 << (room + 1)) - 1)).bit_length() - 1
                if fits > 0:
                    parts.append(self._take(fits))
                    room -= fits
                else:
                    doc, start, ids, n = self._take((self.mask & -self.mask).bit_length() - 1)
                    parts.append((doc, start, ids[:room], n))
                    self._put((doc, start + room, ids[room:], n))
                    room = 0
            yield from self._window(tier, parts)

    def _window(self, tier: int, parts: list[tuple]) -> Iterator[tuple]:
        sequence = self.shard << 40 | self.sequences
        self.sequences += 1
        nth = self.by_tier.get(tier, 0)
        self.by_tier[tier] = nth + 1
        at = 0
        for doc, start, ids, n in parts:
            yield doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, sequence, at, tier, nth
            at += len(ids)


COLUMNS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "nth")


def balance_steps(pieces: DataFrame) -> DataFrame:
    """pieces with step_group in place of nth, a window's number within its shard and tier: the windows of a tier are numbered over all
    shards and dealt to steps of STEP_TOKENS each, so that only the last step of a tier holds fewer. The shards' counts, one row for a
    shard and tier, are written before they are joined: the planner broadcasts them if that table is small, else it sorts both sides."""
    shard = F.shiftright("sequence_id", 40)
    counts = pieces.filter("offset = 0").groupBy(shard.alias("shard"), F.col("tier").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("of").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = cut(counts.select("shard", "of", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "steps")
    numbered = pieces.join(before, (shard == F.col("shard")) & (F.col("tier") == F.col("of")))
    step = F.expr(f"shiftleft(cast(tier as bigint), 40) + (before + nth) div greatest(1, {STEP_TOKENS} div tier)")
    return numbered.select(*[c for c in pieces.columns if c != "nth"], step.alias("step_group"))


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, end: int = 0) -> DataFrame:
    """Packs all documents into windows of the tiers' lengths, each partition by itself, without a shuffle of texts or ids. The pieces are
    written to the shared folder, so that their steps can be balanced over all partitions without packing twice.

    A document is its text's ids by the library's file at `path` (null text: none), then the id `end`; so even an empty text has one id.
    Returns a row for each piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier (the window's length) and
    step_group (windows of a tier that make up one step of equal tokens; of each tier only the last step may hold fewer). Only a partition's tail goes to windows shorter than the
    shortest tier, each again a power of two. Repeated rows are packed each for itself; an empty table gives no rows."""
    classes = tokenizers_classes()

    @tidy
    def run(batches):
        packer = Packer(tiers, TaskContext.get().partitionId())
        pieces = PieceIds(path)
        specials = special_tokens(pieces.tokenizer)
        types = [kind, *[pa.int64()] * 5, pa.int64(), pa.int32(), pa.int64()]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [id_col, *COLUMNS])

        for part, texts in slices(batches, text_col):
            rows = []
            for doc, ids in zip(part.column(0).to_pylist(), ids_of(texts, pieces, classes, specials), strict=True):
                rows += packer.add(doc, np.append(ids, np.uint32(end)))
            if rows:
                yield made(rows)
        if rows := list(packer.pack()):
            yield made(rows)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(docs.schema[id_col].dataType)
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, nth long"
    return balance_steps(cut(docs.select(id_col, text_col).mapInArrow(run, schema), "pieces"))
