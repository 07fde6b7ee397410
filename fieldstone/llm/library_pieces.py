"""Encoding of texts by a file of the tokenizers library: pre-tokens are cut here, each one's ids come from the library once and are cached."""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from functools import cache
from itertools import chain

import numpy as np

from .bpe import Pieces
from .pretokens import SPACE, bounds, class_table, cut_texts


@cache
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@cache
def encoder(path: str):
    """A function from pre-tokens to their ids, for many at once; made once a worker."""
    tokenizer = library(path)
    model = json.loads(tokenizer.to_str())["model"]
    vocab, suffix = model["vocab"], model.get("end_of_word_suffix")

    def each(pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    if suffix:
        last = np.zeros(max(vocab.values()) + 1, bool)
        last[[i for t, i in vocab.items() if t.endswith(suffix)]] = True

        def words(pieces: list[str]) -> list[list[int]]:
            """One call for all, a space between two; where a word ends is seen by its last token. What isn't one word goes alone."""
            ids = tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids
            stops = (np.flatnonzero(last[ids]) + 1).tolist()
            return [ids[a:b] for a, b in zip([0, *stops], stops)] if len(stops) == len(pieces) else each(pieces)

        return words
    signs = {c: bytes([b]) for b, c in byte_signs().items()}
    try:
        ranks = {b"".join(signs[c] for c in t): i for t, i in vocab.items()}
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    except KeyError:
        return each
    if len(ranks) != len(vocab) or merged != list(range(256, 256 + len(merged))):
        return each
    # Ids in the order of the merges: then merging by ranks gives the same ids, by the faster library.
    import tiktoken

    fast = tiktoken.Encoding(path, pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})
    # The call beneath encode_ordinary for one pre-token: without looking for the pattern in it.
    one = fast._core_bpe.encode_single_piece
    return lambda pieces: [one(p.encode()) for p in pieces]


def byte_signs() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is printable, else the next free one above 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class LibraryPieces(Pieces):
    """Pre-token to a value made of the library's ids for it. What the cache lacks is encoded in one call."""

    def __init__(self, path: str, value, known: dict | None = None):
        super().__init__(None, known)
        self.tokenizer, self.value = library(path), value
        self.encode = encoder(path)

    def of(self, pieces: list[str]) -> list:
        out = list(map(self.get, pieces))
        missed = [i for i, value in enumerate(out) if value is None]
        wanted = {pieces[i] for i in missed}
        for source in (self.known, self.old):
            if source and wanted:
                found = {p: source[p] for p in wanted if p in source}
                self.update(found)
                wanted.difference_update(found)
        if wanted:
            wanted = list(wanted)
            for p, ids in zip(wanted, self.encode(wanted), strict=True):
                self[p] = self.value(ids)
        for i in missed:
            out[i] = self[pieces[i]]
        self.trim()
        return out


def special_parts(text: str, specials: dict[str, int]) -> list[tuple[str, int | None]]:
    """The text cut at the strings of special tokens, which the library finds before all else: (text before, id or None at the end)."""
    out, rest = [], text
    while True:
        found = min(((at, s) for s in specials if (at := rest.find(s)) >= 0), default=None)
        if found is None:
            return [*out, (rest, None)]
        at, s = found
        out.append((rest[:at], specials[s]))
        rest = rest[at + len(s) :]


def special_tokens(tokenizer) -> dict[str, int]:
    return {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}


class PieceIds:
    """Ids of pre-tokens, looked up many at once without a string for each. A pre-token of up to 16 bytes is its own key, two 64-bit words
    padded with NULs, in an open-addressing hash table of arrays whose values are places in one array of ids. Keys are compared whole. What
    the table lacks is encoded once. Longer pre-tokens and those that end in NUL, as which padding would pass, go through LibraryPieces."""

    #: Slots of the table, a power of two. It starts anew when 3/8 are taken; bounds its memory, results don't depend on it.
    SLOTS = 1 << 20

    def __init__(self, path: str):
        self.long = LibraryPieces(path, lambda ids: array("I", ids).tobytes())
        self.tokenizer, self.encode = self.long.tokenizer, self.long.encode
        self.low, self.high = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.uint64)
        #: Place of the first id times 32, plus the number of ids; 0: free.
        self.value = np.zeros(self.SLOTS, np.uint64)
        self.ids, self.used, self.taken = np.zeros(1 << 16, np.uint32), 0, 0

    def _home(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = low * np.uint64(0x9E3779B97F4A7C15) + high * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(65 - self.SLOTS.bit_length())).astype(np.intp)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Values of keys, 0 for those that the table lacks."""
        at = self._home(low, high)
        out = self.value[at]
        left = np.arange(len(at))
        while len(left := left[again := ((self.low[at] != low[left]) | (self.high[at] != high[left])) & (out[left] != 0)]):
            at = at[again] + 1 & self.SLOTS - 1
            out[left] = self.value[at]
        return out

    def _insert(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> None:
        """New keys, no two of them equal."""
        at = self._home(low, high)
        while len(at):
            free = np.flatnonzero(self.value[at] == 0)
            self.value[at[free]] = value[free]
            mine = self.value[at] == value
            self.low[at[mine]], self.high[at[mine]] = low[mine], high[mine]
            rest = ~mine
            low, high, value, at = low[rest], high[rest], value[rest], at[rest] + 1 & self.SLOTS - 1

    def _store(self, ids: np.ndarray, keep: bool) -> int:
        """Place of ids in the array of ids; what isn't kept is overwritten by the next call."""
        at, end = self.used, self.used + len(ids)
        if end > len(self.ids):
            self.ids = np.concatenate((self.ids[:at], np.zeros(max(end, 2 * len(self.ids)) - at, np.uint32)))
        self.ids[at:end] = ids
        self.used = end if keep else at
        return at

    def of(self, joined: str, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens of a text, end to end, and the number of ids before each, with their sum at the end."""
        data = joined.encode()
        a, b = starts, stops
        if len(data) > len(joined):
            place = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
            a, b = place[starts], place[stops]
        data += bytes(24 - len(data) % 8)
        step = self.SLOTS // 4
        parts = [self._of(joined, data, *(x[i : i + step] for x in (starts, stops, a, b))) for i in range(0, len(starts), step)]
        ids, n = map(np.concatenate, zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        return ids, np.concatenate(([0], np.cumsum(n)))

    def _of(self, joined: str, data: bytes, starts: np.ndarray, stops: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers for at most a quarter as many pre-tokens as there are slots. a, b: starts and stops in bytes."""
        if self.taken > self.SLOTS // 8 * 3:
            self.value[:] = 0
            self.used = self.taken = 0
        size, words = b - a, np.frombuffer(data, "<u8")
        low, middle, high = (words[(a >> 3) + i] for i in range(3))
        down = (a & 7).astype(np.uint64) << np.uint64(3)
        up = np.uint64(64) - down
        low, high = low >> down | middle << up, middle >> down | high << up
        low, high = low & MASKS[np.minimum(size, 8)], high & MASKS[np.clip(size - 8, 0, 8)]
        long = np.flatnonzero((size > 16) | (np.frombuffer(data, np.uint8)[b - 1] == 0))
        value = self._find(low, high)
        value[long] = 1
        if len(lack := np.flatnonzero(value == 0)):
            new: dict[str, int] = {}
            for i, s, e in zip(lack.tolist(), starts[lack].tolist(), stops[lack].tolist(), strict=True):
                new.setdefault(joined[s:e], i)
            found = self.encode(list(new))
            n = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter(chain.from_iterable(found), np.uint32, int(n.sum()))
            at = self._store(ids, True) + np.cumsum(n) - n
            first = np.fromiter(new.values(), np.int64, len(new))
            self._insert(low[first], high[first], (at << 5 | n).astype(np.uint64))
            self.taken += len(new)
            value[lack] = self._find(low[lack], high[lack])
        value = value.astype(np.int64)
        n, at = value & 31, value >> 5
        if len(long):
            found = self.long.of([joined[s:e] for s, e in zip(starts[long].tolist(), stops[long].tolist(), strict=True)])
            n[long] = np.fromiter(map(len, found), np.int64, len(found)) // 4
            at[long] = self._store(np.frombuffer(b"".join(found), np.uint32), False) + np.cumsum(n[long]) - n[long]
        stop = np.cumsum(n)
        return self.ids[np.arange(stop[-1]) + np.repeat(at - (stop - n), n)], n


#: MASKS[n] keeps the first n bytes of a little-endian word.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def ids_of(texts: list[str], pieces: PieceIds, classes: bytes, specials: dict[str, int]) -> list[np.ndarray]:
    """Ids of whole texts for a byte-level vocabulary without a normaliser."""
    flat, owner = [], []
    for i, t in enumerate(texts):
        for part, special in special_parts(t, specials) if any(s in t for s in specials) else [(t, None)]:
            flat.append(part)
            owner.append((i, special))
    joined, starts, stops, first = bounds(flat, classes)
    found, before = pieces.of(joined, starts, stops)
    before = before[first].tolist()
    ids: list[list[np.ndarray]] = [[] for _ in texts]
    for (i, special), a, b in zip(owner, before[:-1], before[1:], strict=True):
        ids[i].append(found[a:b])
        if special is not None:
            ids[i].append(np.array([special], np.uint32))
    return [x[0] if len(x) == 1 else np.concatenate(x) for x in ids]


@cache
def plain_points() -> np.ndarray:
    """Code points, up to those of Chinese characters, that normalisation (NFC) keeps whatever stands beside them, apart from combining
    marks, and whose lower case is one of their own class. Texts of these alone are cut into pre-tokens as they are."""
    plain = np.zeros(0x110000, bool)
    for c in chain(range(0x1100), range(0x1200, 0xA000)):
        x = chr(c)
        if (k := unicodedata.category(x)) not in ("Cn", "Mn", "Mc", "Me") and unicodedata.normalize("NFC", x) == x and not unicodedata.combining(x):
            low = x.lower()
            plain[c] = len(low) == 1 and unicodedata.category(low)[0] == k[0]
    return plain


def units_of(texts: list[str], classes: bytes) -> tuple[list[str], np.ndarray]:
    """Independent units of texts for a vocabulary that normalises and drops white space: pre-tokens, or in texts with other than plain
    code points the stretches between white space, which the library's normaliser sees alike alone. And each text's first unit."""
    table = class_table(classes)
    plain = [t if t.isascii() or plain_points()[np.frombuffer(t.encode("utf-32-le"), np.uint32)].all() else "" for t in texts]
    cut, first, _ = cut_texts(plain, classes, "words", any_case=True, spaces=False)
    units, bounds = [], [0]
    for i, t in enumerate(texts):
        if plain[i] or not t:
            units += cut[first[i] : first[i + 1]]
        else:
            points = np.frombuffer(t.encode("utf-32-le"), np.uint32)
            gap = np.concatenate(([True], table[points] == SPACE, [True]))
            at = np.flatnonzero(gap)
            units += [t[a:b] for a, b in zip(at[:-1].tolist(), (at[1:] - 1).tolist(), strict=True) if b > a]
        bounds.append(len(units))
    return units, np.array(bounds)
