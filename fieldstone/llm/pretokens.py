"""Pre-token boundaries without regular expressions.

Each code point gets a class from an array; with one or two code points of look-ahead a class becomes a symbol, and a symbol is a
transition function over eight states. These functions form a finite monoid under composition, so their prefixes come from an
associative scan: composition is one look-up in a table, done over blocks of many lanes at a time in NumPy. State and symbol then say
where a pre-token begins. Several texts are scanned as one array; a separator's function leads back to the start state from any other.
"""

from __future__ import annotations

import sys
import zlib
from functools import cache

import numpy as np

from .common import released

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: Symbols: letter, number, other, space that joins what follows, other last white space of a run, white space before more, an
#: apostrophe before one or two letters of a contraction, separator of texts.
L, N, P, SP, WL, W, A2, A3, Z = range(9)
#: States: start of a pre-token, in letters, in numbers, in others, in white space, after a joining space, one or two letters of a contraction left.
START, IN_L, IN_N, IN_P, IN_W, JOIN, C1, C2 = range(8)


def _all_points() -> str:
    return "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))


def _pack(letters, numbers, spaces) -> bytes:
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, points in ((LETTER, letters), (NUMBER, numbers), (SPACE, spaces)):
        table[points] = kind
    return zlib.compress(table.tobytes(), 9)


@cache
def tiktoken_classes() -> bytes:
    """Class of every code point as tiktoken's regex engine has it, asked of the engine itself: a pattern that matches one class alone
    encodes to the bytes of that class's characters. Compressed, to be sent to workers."""
    import tiktoken

    def of(pattern: str) -> list[int]:
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        return [ord(c) for c in bytes(probe.encode_ordinary(_all_points())).decode()]

    return _pack(of(r"\p{L}"), of(r"\p{N}"), of(r"\s"))


@cache
@released
def tokenizers_classes() -> bytes:
    """The same as the tokenizers library's regex engine has them, which knows another version of Unicode."""
    from tokenizers import Regex, pre_tokenizers

    points = _all_points()

    def of(pattern: str) -> list[int]:
        runs = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(points)
        return [ord(c) for run, _ in runs for c in run]

    return _pack(of(r"\p{L}+"), of(r"\p{N}+"), of(r"\s+"))


def _step_joined(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a pre-token begins at the symbol: contractions, and runs of one class with one space before them."""
    if symbol == Z:
        return START, True
    if state == C2:
        return C1, False
    if state == C1:
        return START, False
    run = {L: IN_L, N: IN_N, P: IN_P, A2: IN_P, A3: IN_P}.get(symbol)
    if state == JOIN and run is not None:
        return run, False
    if symbol in (A2, A3):
        return (IN_P, False) if state == IN_P else (C1 if symbol == A2 else C2, True)
    if run is not None:
        return run, state != run
    if symbol == W:
        return IN_W, state != IN_W
    return (JOIN if symbol == SP else START), True


def _step_words(state: int, symbol: int) -> tuple[int, bool]:
    """As above for pre-tokens without white space, where each number is a pre-token of its own."""
    if symbol == Z:
        return START, True
    if state == C2:
        return C1, False
    if state == C1:
        return START, False
    if symbol in (SP, WL, W):
        return IN_W, state != IN_W
    if symbol in (A2, A3):
        return (IN_P, False) if state == IN_P else (C1 if symbol == A2 else C2, True)
    if symbol == N:
        return IN_N, True
    run = IN_L if symbol == L else IN_P
    return run, state != run


class Machine:
    """Transition functions of the nine symbols, closed under composition."""

    def __init__(self, step):
        moves = np.array([[step(s, c)[0] for s in range(8)] for c in range(9)], np.uint8)
        self.begins = np.array([[step(s, c)[1] for c in range(9)] for s in range(8)], bool)
        known = {tuple(range(8)): 0}
        todo = list(known)
        for f in map(tuple, moves.tolist()):
            if f not in known:
                known[f] = len(known)
                todo.append(f)
        gens = [tuple(f) for f in moves.tolist()]
        while todo:
            f = todo.pop()
            for g in gens:
                h = tuple(g[x] for x in f)
                if h not in known:
                    known[h] = len(known)
                    todo.append(h)
        fns = np.array(list(known), np.uint8)
        size = len(fns)
        self.kind = np.uint8 if size <= 256 else np.uint16
        index = {f: i for f, i in known.items()}
        self.of_symbol = np.array([index[f] for f in gens], self.kind)
        #: compose[f * size + g]: first f, then g.
        self.compose = np.array([index[tuple(b)] for f in fns for b in fns[:, f].tolist()], self.kind)
        self.size, self.apply = size, fns.ravel()

    def scan(self, f: np.ndarray) -> np.ndarray:
        """Inclusive prefix compositions of an array of functions."""
        n = len(f)
        if n <= 64:
            out = f.copy()
            for i in range(1, n):
                out[i] = self.compose[int(out[i - 1]) * self.size + int(f[i])]
            return out
        width = 64 if n > 1 << 14 else 16
        lanes = -(-n // width)
        grid = np.zeros(lanes * width, self.kind)
        grid[:n] = f
        grid = np.ascontiguousarray(grid.reshape(lanes, width).T)
        for i in range(1, width):
            grid[i] = self.compose[grid[i - 1].astype(np.intp) * self.size + grid[i]]
        before = np.zeros(lanes, self.kind)
        before[1:] = self.scan(grid[-1])[:-1]
        grid = self.compose[before.astype(np.intp) * self.size + grid]
        return np.ascontiguousarray(grid.T).ravel()[:n]

    def starts(self, symbols: np.ndarray) -> np.ndarray:
        """Positions at which a pre-token begins; a separator is one too."""
        state = np.zeros(len(symbols), np.uint8)
        state[1:] = self.apply[self.scan(self.of_symbol[symbols])[:-1].astype(np.intp) * 8]
        return np.flatnonzero(self.begins.ravel()[state.astype(np.intp) * 9 + symbols])


@cache
def machine(name: str) -> Machine:
    return Machine({"joined": _step_joined, "words": _step_words}[name])


@cache
def class_table(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def symbols(points: np.ndarray, classes: np.ndarray, separators: np.ndarray, any_case: bool) -> np.ndarray:
    """Symbols of code points. any_case: contractions are recognised in capitals too, as where texts are lower-cased first."""
    kind = classes[points]
    kind[separators] = 0
    out = np.array([Z, L, N, W, P], np.uint8)[kind]
    n = len(points)
    space = np.flatnonzero(kind == SPACE)
    after = kind[np.minimum(space + 1, n - 1)]
    last = space[(after != SPACE) & (after != 0) & (space + 1 < n)]
    out[last] = np.where(points[last] == 32, SP, WL)
    mark = np.flatnonzero(points == 39)
    mark = mark[(kind[mark] != 0) & (mark + 1 < n)]
    if len(mark):
        fold = (lambda x: np.where((x >= 65) & (x <= 90), x + 32, x)) if any_case else (lambda x: x)
        one, two = fold(points[mark + 1]), fold(points[np.minimum(mark + 2, n - 1)])
        two = np.where((mark + 2 < n) & (kind[np.minimum(mark + 2, n - 1)] != 0), two, 0)
        one = np.where(kind[mark + 1] != 0, one, 0)
        out[mark[np.isin(one, [ord(c) for c in "stmd"])]] = A2
        pair = one * 256 + np.minimum(two, 255)
        out[mark[np.isin(pair, [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")])]] = A3
    return out


def bounds(texts: list[str], packed: bytes, name: str = "joined", any_case: bool = False, spaces: bool = True) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined, each with a NUL behind it; where in it, in code points, each pre-token begins and where it stops, in order; and for
    each text the index of its first pre-token, with one more at the end. spaces: whether those that begin with white space count."""
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le" if sys.byteorder == "little" else "utf-32-be"), np.uint32)
    ends = text_ends(texts)
    classes = class_table(packed)
    starts = machine(name).starts(symbols(points, classes, ends, any_case))
    stops = np.append(starts[1:], len(points))
    real = np.ones(len(starts), bool)
    real[np.searchsorted(starts, ends)] = False
    if not spaces:
        real &= classes[points[starts]] != SPACE
    starts, stops = starts[real], stops[real]
    return joined, starts, stops, np.searchsorted(starts, np.append(np.append(0, ends[:-1] + 1), len(points)))


def text_ends(texts: list[str]) -> np.ndarray:
    """Where each text's NUL stands when they are joined."""
    return np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1


def cut_texts(texts: list[str], packed: bytes, name: str = "joined", any_case: bool = False, spaces: bool = True) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Pre-tokens of all texts in order; for each text the index of its first pre-token, with one more at the end; and each pre-token's
    offset in its text, in code points. spaces: whether those that begin with white space count."""
    joined, starts, stops, first = bounds(texts, packed, name, any_case, spaces)
    offsets = starts - np.repeat(np.append(0, text_ends(texts)[:-1] + 1), np.diff(first))
    return [joined[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], first, offsets
