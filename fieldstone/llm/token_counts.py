"""Token counts (op1): a broadcast table of frequent pre-tokens' lengths first, worker caches for the rest; pre-tokens are never shuffled."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices
from .library_pieces import LibraryPieces, byte_signs, library, special_parts, special_tokens, units_of
from .pretokens import tokenizers_classes

#: Entries of the broadcast table: its size bound, whatever the corpus.
FREQUENT = 32_768


def frequent_pieces(path: str, size: int = FREQUENT) -> list[str]:
    """Frequent pre-tokens, in small letters and with a capital, as the file's own vocabulary tells them: its whole words in the order in
    which they were merged, the most frequent first. No text is read for it; what else is frequent, the worker caches learn."""
    model = json.loads(library(path).to_str())["model"]
    suffix, signs = model.get("end_of_word_suffix") or "", {c: b for b, c in byte_signs().items()}
    out: dict[str, None] = {}
    for token, _ in sorted(model["vocab"].items(), key=lambda x: x[1]):
        if token.endswith(suffix) and all(c in signs for c in token.removesuffix(suffix)):
            word = bytes(signs[c] for c in token.removesuffix(suffix)).decode(errors="ignore")
            if word.strip() and (word.isalpha() or len(word) == 1):
                out |= dict.fromkeys((word, word[0].upper() + word[1:]))
        if len(out) >= size:
            break
    return list(out)[:size]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Tokens of each whole text as the library's file at `path` gives them, without tokens added around it; special strings in a text
    count as one token. Returns id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit). A null or empty text has 0 tokens; a
    text of any length counts whole; repeated rows and null ids each give a row; an empty table gives none; other columns are not read."""
    spark, classes = docs.sparkSession, tokenizers_classes()
    pieces = frequent_pieces(path)
    lengths = {p: len(e.ids) for p, e in zip(pieces, library(path).encode_batch_fast(pieces, add_special_tokens=False), strict=True)}
    frequent = spark.sparkContext.broadcast(lengths)

    def run(batches):
        cache = LibraryPieces(path, len, frequent.value)
        specials = special_tokens(cache.tokenizer)
        for part, texts in slices(batches, text_col):
            flat, owner = [], []
            extra = np.zeros(len(texts), np.int64)
            for i, t in enumerate(texts):
                for piece, special in special_parts(t, specials) if any(x in t for x in specials) else [(t, None)]:
                    flat.append(piece)
                    owner.append(i)
                    extra[i] += special is not None
            units, first = units_of(flat, classes)
            total = np.concatenate(([0], np.cumsum(np.fromiter(cache.of(units), np.int64, len(units)))))
            n = extra + np.bincount(owner, total[first[1:]] - total[first[:-1]], len(texts)).astype(np.int64)
            yield pa.record_batch([part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
