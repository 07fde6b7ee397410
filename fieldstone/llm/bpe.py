"""Byte-level BPE: encoding and decoding by a rank table (op9)."""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices
from .pretokens import cut_texts, tiktoken_classes

#: Pre-tokens that a worker's cache holds; bounds its memory, results don't depend on it.
CACHE = 300_000
#: Bytes up to which a plain scan for the lowest rank beats the heap.
SHORT = 60


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    get, none = ranks.get, len(ranks)
    part = [piece[i : i + 1] for i in range(len(piece))]
    rank = [get(a + b, none) for a, b in zip(part, part[1:], strict=False)]
    rank.append(none)
    while (least := min(rank)) < none:
        i = rank.index(least)
        made = part[i] = part[i] + part[i + 1]
        del part[i + 1], rank[i]
        rank[i] = get(made + part[i + 1], none) if i + 1 < len(part) else none
        if i:
            rank[i - 1] = get(part[i - 1] + made, none)
    return [ranks[x] for x in part]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank, the leftmost of equals, is merged until none is left. A heap and linked
    parts keep it at n log n for long pre-tokens."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n <= SHORT:
        return _merge_short(piece, ranks)
    end = list(range(1, n + 1))
    prev, alive = list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i] = stop
        if stop < n:
            prev[stop] = i
            r = ranks.get(piece[i : end[stop]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        h = prev[i]
        if h >= 0:
            r = ranks.get(piece[h:stop])
            if r is not None:
                heapq.heappush(heap, (r, h, stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Pieces(dict):
    """Pre-token to what `make` gives for it. trim() starts a new generation when this one is full; entries still in use move over."""

    def __init__(self, make: Callable[[str], object], known: dict | None = None):
        super().__init__()
        self.make, self.old, self.known = make, {}, known or {}

    def __missing__(self, piece: str):
        out = self.known.get(piece)
        if out is None and (out := self.old.get(piece)) is None:
            out = self.make(piece)
        self[piece] = out
        return out

    def trim(self) -> None:
        if len(self) > CACHE // 2:
            self.old = dict(self)
            self.clear()


@dataclass(frozen=True)
class Codec:
    """Encoder and decoder over a rank file at `path`; `classes` as pretokens.tiktoken_classes() gives them."""

    path: str
    classes: bytes

    def pieces(self) -> Pieces:
        ranks = load_ranks(self.path)
        return Pieces(lambda piece: array("I", merge(piece.encode(), ranks)).tobytes())

    def encode(self, texts: list[str], pieces: Pieces) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text its ids, and for each of its pre-tokens the offset in code points and the number of ids."""
        cut, first, offsets = cut_texts(texts, self.classes)
        found = list(map(pieces.__getitem__, cut))
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield np.frombuffer(b"".join(found[a:b]), np.uint32), offsets[a:b], np.fromiter(map(len, found[a:b]), np.int64, b - a) // 4
        pieces.trim()


class ByteTable:
    """Bytes of each id, laid end to end, so that many ids turn into bytes by one gather."""

    def __init__(self, entries: list[bytes]):
        self.flat = np.frombuffer(b"".join(entries), np.uint8)
        self.length = np.fromiter(map(len, entries), np.int64, len(entries))
        self.at = np.cumsum(self.length) - self.length

    def join(self, ids: np.ndarray) -> bytes:
        length = self.length[ids]
        stop = np.cumsum(length)
        total = int(stop[-1]) if len(ids) else 0
        return self.flat[np.arange(total) + np.repeat(self.at[ids] - (stop - length), length)].tobytes()


@cache
def vocabulary(path: str) -> ByteTable:
    return ByteTable([x for x, _ in sorted(load_ranks(path).items(), key=lambda x: x[1])])


def decode(ids: np.ndarray, path: str) -> bytes:
    return vocabulary(path).join(ids)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of each whole text, with the pre-tokens' offsets: id_col, ids array<int>, piece_offsets array<long>, piece_tokens array<long>.
    A null text counts as empty and gives no ids; repeated rows each give a row; other columns are not read."""
    codec = Codec(path, tiktoken_classes())
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>, piece_offsets array<long>, piece_tokens array<long>"

    def run(batches):
        pieces = codec.pieces()
        for part, texts in slices(batches, text_col):
            rows = list(codec.encode(texts, pieces))
            yield pa.record_batch([part.column(0), pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], [id_col, "ids", "piece_offsets", "piece_tokens"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """Bytes of each row's ids: id_col, decoded binary. Null ids give null."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.record_batch([part.column(0), pa.array([None if x.as_py() is None else decode(np.array(x.as_py(), np.int64), path) for x in part.column(1)], pa.binary())], [id_col, "decoded"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, decoded binary")


def codec_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes each whole text in one pass: id_col, n_tokens, ids_sha256 (of the decimal ids joined by a space),
    decoded_sha256. One row per row; a null text counts as empty: no tokens, digests of nothing; an empty table gives no rows."""
    codec = Codec(path, tiktoken_classes())
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        pieces, size = codec.pieces(), len(load_ranks(path))
        words = ByteTable([b" %d" % i for i in range(size)])
        for part, texts in slices(batches, text_col):
            n, shown, back = [], [], []
            for ids, _, _ in codec.encode(texts, pieces):
                n.append(len(ids))
                shown.append(hashlib.sha256(words.join(ids)[1:]).hexdigest())
                back.append(hashlib.sha256(decode(ids, path)).hexdigest())
            yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(shown, pa.string()), pa.array(back, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)
