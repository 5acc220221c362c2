r"""Substring dedup over words by recompression.

Words `[^\x20\x09-\x0D]+` (null: none) are 64-bit names. Each round first names runs of equal symbols by (name, length) and then pairs of neighbours
whose hashed names say left and right. A name is a hash of what it stands for, so naming is the same in every task without a
shuffle, and equal passages get equal symbols except near their ends. For each symbol the words that determine it are tracked;
a window of 13 words is keyed by its highest symbol that the window alone determines. Shared keys bring
equal windows together (`repeats`), where the windows themselves are compared.

A word goes if a window that covers it also starts in a document with a smaller doc_id, judged on the input. Defined cases: rows with a
null id keep all words and take none from others; rows of one doc_id are one document that may have several texts, none of which is
smaller than the other; texts shorter than a window stay; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, types as T

from seqpulse.llm.common import WordHashes, mix, words_of
from seqpulse.llm.repeats import INF, Parse, Symbols, apply_repeats, covered_tokens, find_repeats

ROUNDS = 2


def _neighbour(s: Symbols, keep: np.ndarray, x: np.ndarray, step: int, end: int) -> np.ndarray:
    """x of the symbol beside each kept one, `end` at the border of its row."""
    at = keep + step
    inside = (at >= 0) & (at < len(x))
    at = np.clip(at, 0, max(len(x) - 1, 0))
    return np.where(inside & (s.row[at] == s.row[keep]), x[at], end)


def name_runs(s: Symbols) -> Symbols:
    new = np.ones(len(s.name), bool)
    new[1:] = (s.name[1:] != s.name[:-1]) | (s.row[1:] != s.row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(new)) - 1
    size = last - first + 1
    with np.errstate(over="ignore"):
        name = np.where(size > 1, mix(s.name[first] * np.uint64(31) + size.astype(np.uint64)), s.name[first])
    # where a run ends is seen from the symbols beside it
    return Symbols(name, s.row[first], np.minimum(s.left[first], _neighbour(s, first, s.left, -1, -INF)), np.maximum(s.right[last], _neighbour(s, last, s.right, 1, INF)))


def name_pairs(s: Symbols, salt: int) -> Symbols:
    with np.errstate(over="ignore"):
        side = (mix(s.name + np.uint64(salt)) & np.uint64(1)).astype(bool)
    pair = np.zeros(len(side), bool)
    pair[:-1] = ~side[:-1] & side[1:] & (s.row[:-1] == s.row[1:])
    second = np.concatenate([[False], pair[:-1]])[: len(pair)]
    keep = np.flatnonzero(~second)
    paired = pair[keep]
    after = np.minimum(keep + 1, len(side) - 1)
    with np.errstate(over="ignore"):
        name = np.where(paired, mix(s.name[keep] * np.uint64(33) + s.name[after]), s.name[keep])
    # a left symbol is paired or not by its right neighbour, a right one by its left neighbour
    right = np.where(side[keep], s.right[keep], np.maximum(s.right[keep], _neighbour(s, keep, s.right, 1, INF)))
    left = np.where(side[keep], np.minimum(s.left[keep], _neighbour(s, keep, s.left, -1, -INF)), s.left[keep])
    return Symbols(name, s.row[keep], left, right)


def recompress(h: np.ndarray, row: np.ndarray) -> list[Symbols]:
    at = np.arange(len(h))
    s, out = Symbols(h, row, at, at + 1), []
    for k in range(ROUNDS):
        s = name_pairs(name_runs(s), 1000 + k)
        out.append(s)
    return out


def word_parse(width: int = 13) -> Parse:
    hashes: list[WordHashes] = []

    def tokens(texts: list[str | None]) -> list[np.ndarray]:
        if not hashes:
            hashes.append(WordHashes())
        return [hashes[0].of(words_of(t)) for t in texts]

    return Parse(tokens, recompress, width, gram=4, chunk=6 << 20)


def remove_repeats(docs: DataFrame, width: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed and text (the kept words joined by one space) of every row."""
    parse = word_parse(width)
    hits = find_repeats(docs, parse, sparse=False)
    known: list[WordHashes] = []

    def cut(text: str | None, ranges: list[bytes] | None) -> tuple[int, int, str]:
        words = words_of(text)
        if not ranges:
            return len(words), 0, b" ".join(words).decode("utf-8", "surrogatepass")
        if not known:
            known.append(WordHashes())
        gone = covered_tokens(known[0].of(words), ranges, width)
        kept = [w for w, g in zip(words, gone.tolist()) if not g]
        return len(words), int(gone.sum()), b" ".join(kept).decode("utf-8", "surrogatepass")

    added = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("text", T.StringType())])
    return apply_repeats(docs, hits, cut, added)
