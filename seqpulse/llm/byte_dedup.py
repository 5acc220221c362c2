"""Substring dedup over bytes by the reduction of induced sorting.

Induced sorting picks the suffixes that start at local minima, names the substrings between them, and recurs on the names until suffixes are told
apart. Here that recursion selects, level by level, sampled suffixes that equal passages share (a minimum is seen from its neighbours alone);
Spark's sort-based shuffle, which spills to disk, is the external queue in which the tuples of equal names meet and are ordered by (name,
document), instead of one queue per shard: nothing is held beyond one chunk of texts or one bucket. First only the suffixes' names with their
first 24 bytes, as one hash, are exchanged; the 50-byte strings around those that several documents have follow, and are compared themselves (`repeats`).

A byte goes if a string of 50 bytes that covers it also starts in a document with a smaller doc_id, judged on the input; strings never cross
documents. Defined cases as in `word_dedup`; a null text is empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, types as T

from seqpulse.llm.common import mix
from seqpulse.llm.repeats import Parse, Symbols, apply_repeats, covered_tokens, find_repeats

LEVELS = 2
PREFIX = 24
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = 0x9E3779B97F4A7C15


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


class Powers:
    """Powers of the base of the hashes and of its inverse, as many as were asked for."""

    def __init__(self):
        self.power = self.back = np.zeros(0, np.uint64)

    def sums(self, name: np.ndarray) -> np.ndarray:
        """Prefix sums of which two tell the hash of what is between them."""
        n = len(name) + 1
        if len(self.power) < n:
            one = np.ones(1, np.uint64)
            with np.errstate(over="ignore"):
                self.power, self.back = (np.multiply.accumulate(np.concatenate([one, np.full(n, np.uint64(x))])) for x in (_ODD, pow(_ODD, -1, 1 << 64)))
        out = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(name * self.power[: n - 1], out=out[1:])
        return out

    def between(self, sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (sums[b] - sums[a]) * self.back[a]


def name_between_minima(s: Symbols, powers: Powers, sums: np.ndarray) -> Symbols:
    """The substrings from one local minimum up to the next, named by a hash of their symbols."""
    none = Symbols(s.name[:0], s.row[:0], s.left[:0], s.right[:0])
    if len(s.name) < 3:
        return none
    # runs of equal symbols: a minimum is the start of one that is below both beside it, within the row
    new = np.ones(len(s.name), bool)
    new[1:] = (s.name[1:] != s.name[:-1]) | (s.row[1:] != s.row[:-1])
    runs = np.flatnonzero(new)
    name, row = s.name[runs], s.row[runs]
    here, up = row[1:] == row[:-1], name[1:] > name[:-1]
    k = np.flatnonzero(here[:-1] & here[1:] & ~up[:-1] & up[1:]) + 1
    m, after = runs[k], runs[k + 1]
    if len(m) < 2:
        return none
    joined = s.row[m[:-1]] == s.row[m[1:]]
    a, b, after = m[:-1][joined], m[1:][joined], after[1:][joined]
    with np.errstate(over="ignore"):
        name = mix(powers.between(sums, a, b) + (b - a).astype(np.uint64))
    # a minimum is seen from the symbol before it and the first that differs after it
    return Symbols(name, s.row[a], s.left[a - 1], np.maximum(s.right[b], s.right[after]))


def induced_levels(h: np.ndarray, row: np.ndarray, powers: Powers) -> list[Symbols]:
    """The sampled suffixes of each level, told apart by their first bytes beside their names: common names alone bring much text together."""
    at = np.arange(len(h))
    s, out = Symbols(h, row, at, at + 1), []
    of_bytes = sums = powers.sums(h)
    for level in range(LEVELS):
        s = name_between_minima(s, powers, sums)
        ok = s.left + PREFIX <= len(h)
        ok[ok] = row[s.left[ok] + PREFIX - 1] == s.row[ok]
        left = s.left[ok]
        with np.errstate(over="ignore"):
            name = mix(s.name[ok] + mix(powers.between(of_bytes, left, left + PREFIX)))
        out.append(Symbols(name, s.row[ok], left, np.maximum(s.right[ok], left + PREFIX)))
        if level + 1 < LEVELS:
            sums = powers.sums(s.name)
    return out


def byte_parse(width: int = 50) -> Parse:
    def tokens(texts: list[str | None]) -> list[np.ndarray]:
        return [_BYTES[np.frombuffer(_bytes(t), np.uint8)] for t in texts]

    powers = Powers()
    return Parse(tokens, lambda h, row: induced_levels(h, row, powers), width, gram=PREFIX, chunk=2 << 20, raw=_bytes, alphabet=_BYTES)


def remove_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every row."""
    hits = find_repeats(docs, byte_parse(width), sparse=True)

    def cut(text: str | None, ranges: list[bytes] | None) -> tuple[int, int, int, bytes]:
        raw = _bytes(text)
        if not ranges:
            return len(raw), 0, 0, raw
        values = np.frombuffer(raw, np.uint8)
        gone = covered_tokens(_BYTES[values], ranges, width)
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])[: len(gone)]).sum())
        return len(raw), int(gone.sum()), spans, values[~gone].tobytes()

    added = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())])
    return apply_repeats(docs, hits, cut, added)
