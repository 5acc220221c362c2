r"""Quality: log-likelihood ratio of hashed n-grams between a trusted target and the raw corpus.

Words `[^\x20\x09-\x0D]+`, unchanged, and word pairs are hashed to 2**bits slots. Two multinomials with add-one smoothing are counted: the raw
corpus over all documents, the target over all trusted ones (labelled quality 1). A document scores the mean over its n-grams of
log(p_target / p_raw). The threshold is the value that best parts all labelled documents by their label (the smallest such value, so that
it is deterministic). Counts leave a task as one block per slice of slots, hence what is shuffled depends on the number of tasks and not on
the texts, unless there are too many trusted ids to broadcast; the two tables of 2**bits numbers are broadcast.

Base columns per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and base_failed when there are fewer than
`min_words` words or more than half of them lie in repeated 3-word windows.

Defined cases: a null or empty text has no words, scores 0 and fails the base; a null label is not used; a repeated label of one
doc_id counts as its largest. Without documents of both labels the threshold is 0. Repeated rows score alike; other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from seqpulse.llm.common import BROADCAST_BYTES, WordHashes, chunks, count_slots, mix, store, words_of

_SYMBOL = re.compile(r"[#*$%&|<>]")


@dataclass(frozen=True)
class Ratio:
    bits: int = 18
    min_words: int = 50


def _grams(h: np.ndarray, doc: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of words and of pairs within a document, and the document of each."""
    with np.errstate(over="ignore"):
        pairs = mix(h[:-1] * np.uint64(3) + h[1:])
    same = doc[:-1] == doc[1:]
    slots = np.concatenate([mix(h), pairs[same]]) >> np.uint64(64 - bits)
    return slots.astype(np.int64), np.concatenate([doc, doc[:-1][same]])


def _words(texts: list[str | None], hashes: WordHashes) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    words = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    return words, hashes.of([x for w in words for x in w]), np.repeat(np.arange(len(words)), sizes)


def repeated_words(h: np.ndarray, doc: np.ndarray, n_docs: int, width: int = 3) -> np.ndarray:
    """Per document, words in windows of `width` words that occur twice or more in it."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(n_docs, np.int64)
    with np.errstate(over="ignore"):
        key = mix(doc[:n].astype(np.uint64) + np.uint64(1))
        for k in range(width):
            key = mix(key * np.uint64(31) + h[k : k + n])
    inside = np.flatnonzero(doc[:n] == doc[width - 1 :])
    _, back, count = np.unique(key[inside], return_inverse=True, return_counts=True)
    at = inside[count[back] > 1]
    hit = np.zeros(len(h), bool)
    for k in range(width):
        hit[at + k] = True
    return np.bincount(doc[hit], minlength=n_docs)


_SPACE = dict.fromkeys([32, *range(9, 14)])


def _word_chars(text: str | None) -> int:
    """Code points that are in words."""
    return len(text.translate(_SPACE)) if text else 0


def duplicate_lines(text: str | None) -> int:
    seen, found = set(), 0
    for line in (text or "").split("\n"):
        if line.encode("utf-8", "surrogatepass").split():
            found += line in seen
            seen.add(line)
    return found


def _counts(docs: DataFrame, bits: int) -> np.ndarray:
    def slots(texts: list[str | None], hashes: WordHashes) -> np.ndarray:
        _, h, doc = _words(texts, hashes)
        return _grams(h, doc, bits)[0]

    return count_slots(docs, bits, slots)


_ID_BYTES = 32  # of an id in a broadcast hash table


def label_ids(labels: DataFrame) -> DataFrame:
    """doc_id, label: one row per labelled id, stored."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("label"))
    return store(known, "quality-labels")


def fit(docs: DataFrame, known: DataFrame, cfg: Ratio = Ratio()) -> np.ndarray:
    """The log ratio of each slot: all documents labelled 1 in `known` (see `label_ids`) against all documents."""
    trusted = known.filter("label = 1").select("doc_id")
    few = trusted.count() * _ID_BYTES <= BROADCAST_BYTES
    target = _counts(docs.select("doc_id", "text").join(F.broadcast(trusted) if few else trusted, "doc_id"), cfg.bits)
    raw = _counts(docs, cfg.bits)
    return np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw)))


def threshold(scored: DataFrame, known: DataFrame) -> float:
    """The llr that best parts all labelled documents, from ranges of their distinct values; a row a range reaches one task.

    Cutting before a value keeps it and all larger ones; the best cut has the largest share of label 1 kept plus share of the others cut.
    """
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = F.col("label") == 1
    values = (
        scored.join(known, "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.min("llr").alias("x"))
        .groupBy("x").agg(F.count_if(one).alias("good"), F.count_if(~one).alias("bad"))
    )
    placed = store(values.repartitionByRange(parts, "x").withColumn("part", F.spark_partition_id()), "quality-values")
    sums = placed.groupBy("part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    before, all_parts = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(1))
    # one row for each range
    bases = sums.select(
        "part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_base") for c in ("good", "bad")],
        *[F.sum(c).over(all_parts).alias(f"{c}_all") for c in ("good", "bad")])
    within = W.partitionBy("part").orderBy("x").rowsBetween(W.unboundedPreceding, -1)
    good, bad = (F.col(f"{c}_base") + F.coalesce(F.sum(c).over(within), F.lit(0)) for c in ("good", "bad"))
    gain = (bad * F.col("good_all") - good * F.col("bad_all")).alias("gain")
    best = (
        placed.join(bases, "part").filter("good_all > 0 AND bad_all > 0").select("x", gain)
        .agg(F.max(F.struct("gain", (-F.col("x")).alias("lowest"))).alias("best")).first()["best"]
    )
    if best is None:
        return 0.0
    x = -best["lowest"]
    below = placed.filter(F.col("x") < F.lit(x)).agg(F.max("x").alias("x")).first()["x"]
    return x if below is None else (below + x) / 2


def _score(docs: DataFrame, ratio: np.ndarray, cfg: Ratio) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    added = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("llr", "double")]
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ratio = WordHashes(), shared.value
        for table in chunks(batches, 8 << 20):
            texts = table["text"].to_pylist()
            words, h, doc = _words(texts, hashes)
            slots, owner = _grams(h, doc, cfg.bits)
            n = len(texts)
            grams = np.maximum(np.bincount(owner, minlength=n), 1)
            columns = [
                [len(w) for w in words], [_word_chars(t) for t in texts],
                [len(_SYMBOL.findall(t or "")) for t in texts], [duplicate_lines(t) for t in texts], repeated_words(h, doc, n),
                np.bincount(owner, ratio[slots], minlength=n) / grams]
            out = table.select(kept)
            for (name, kind), values in zip(added, columns):
                out = out.append_column(name, pa.array(values, pa.float64() if kind == "double" else pa.int64()))
            yield from out.to_batches()

    schema = docs.select(*kept).schema
    for name, kind in added:
        schema = schema.add(name, kind)
    return docs.select(*kept, "text").mapInArrow(run, schema)


def assess(docs: DataFrame, labels: DataFrame, cfg: Ratio = Ratio()) -> DataFrame:
    """doc_id, the base columns, llr, base_failed and kept for every row."""
    known = label_ids(labels)
    base = F.col("n_words") < cfg.min_words
    failed = base | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    texts = docs.select("doc_id", "text")
    scored = store(_score(texts, fit(texts, known, cfg), cfg), "quality-scores")
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(threshold(scored, known))))
