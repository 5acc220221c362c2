"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the presence of hashed words, their beginnings, word pairs and pairs with one word between, of its
letters-only words in lower case.
Training reads at most `sample` labelled rows (the smallest id hashes; a documented bound), whose texts Spark turns into
features where they lie; one task then runs FTRL over them in hash order, with per-coordinate rates and L1, so that few weights remain. The
weights (at most 2**bits) are broadcast and every whole text is scored where it lies, without a shuffle.

Defined cases: a null or empty text has no features and scores by the intercept; labels that are null are not learnt
from; a doc_id labelled more than once takes its largest label, one with several texts its smallest text. Without a
single usable label every score is 0.5. Extra columns are ignored, repeated rows score alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from seqpulse.llm.common import chunks, mix

_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Ftrl:
    bits: int = 20
    sample: int = 8000
    epochs: int = 4
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 0.1


#: Lengths of the word beginnings that are features beside the whole word: inflected and compounded forms share them.
BEGINNINGS = (4, 5, 6, 7)


class WordFeatures(dict):
    """Hashes of a word and of its beginnings (0 where the word is not longer), emptied at `limit` words."""

    def __init__(self, limit: int = 200_000):
        import xxhash

        super().__init__()
        self.limit, self.digest = limit, xxhash.xxh3_64_intdigest

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        found = [self.digest(word), *(self.digest(word[:k], seed=k) if len(word) > k else 0 for k in BEGINNINGS)]
        value = self[word] = np.array(found, np.uint64).tobytes()
        return value


def features(text: str | None, known: WordFeatures, bits: int) -> np.ndarray:
    """Distinct slots of the text's words, beginnings, pairs and skip-pairs; slot 0 is the intercept."""
    words = _WORD.findall((text or "").lower())
    table = np.frombuffer(b"".join([known[w] for w in words]), np.uint64).reshape(-1, 1 + len(BEGINNINGS))
    h = table[:, 0]
    with np.errstate(over="ignore"):
        pairs = mix(h[:-1] * np.uint64(3) + h[1:])
        skips = mix(h[:-2] * np.uint64(5) + h[2:])
    slots = np.concatenate([mix(table.reshape(-1)), pairs, skips]) >> np.uint64(64 - bits)
    return np.unique(np.concatenate([np.zeros(1, np.int32), slots.astype(np.int32)]))


def _learn(rows: list[tuple[np.ndarray, float]], cfg: Ftrl) -> np.ndarray:
    z, n = np.zeros(1 << cfg.bits), np.zeros(1 << cfg.bits)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= cfg.l1, 0.0, -(zi - np.sign(zi) * cfg.l1) / ((cfg.beta + np.sqrt(n[i])) / cfg.alpha + cfg.l2))

    for _ in range(cfg.epochs):
        for i, y in rows:
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / cfg.alpha
            z[i] += g - step * w
            n[i] += g * g
    return weights(np.arange(1 << cfg.bits))


def train(docs: DataFrame, labels: DataFrame, usable: Column, cfg: Ftrl = Ftrl()) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights that are not zero. `usable` tells, on doc_id, which labels may be learnt from."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = known.select(order.alias("order"), "doc_id", F.col("toxic").cast("double").alias("toxic")).orderBy("order", "doc_id").limit(cfg.sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "order", "toxic").agg(F.min("text").alias("text"))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordFeatures()
        for b in batches:
            found = [features(t, known, cfg.bits).tobytes() for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["order"], b["doc_id"], b["toxic"], pa.array(found, pa.binary())], ["order", "doc_id", "toxic", "slots"])

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending"), ("doc_id", "ascending")])
        rows = [(np.frombuffer(s, np.int32), y) for s, y in zip(table["slots"].to_pylist(), table["toxic"].to_pylist())]
        w = _learn(rows, cfg)
        i = np.flatnonzero(w).astype(np.int32)
        return pa.table({"slots": pa.array([i.tobytes()], pa.binary()), "weights": pa.array([w[i].tobytes()], pa.binary())})

    rows = texts.mapInArrow(slots, f"order long, doc_id {dict(docs.dtypes)['doc_id']}, toxic double, slots binary")
    model = rows.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(learn, "slots binary, weights binary").first()  # at most `sample` rows
    if model is None:
        return np.zeros(0, np.int32), np.zeros(0)
    return np.frombuffer(model["slots"], np.int32), np.frombuffer(model["weights"])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], bits: int = Ftrl.bits) -> DataFrame:
    """The given columns and toxicity_score, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = "toxicity_score"
    if name in docs.columns:
        raise ValueError(f"a column {name} is there already")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(1 << bits)
        w[shared.value[0]] = shared.value[1]
        known = WordFeatures()
        for table in chunks(batches, 2 << 20):
            sums = [w[features(t, known, bits)].sum() for t in table["text"].to_pylist()]
            p = 1 / (1 + np.exp(-np.clip(sums, -30, 30)))
            yield from table.append_column(name, pa.array(p, pa.float64())).to_batches()

    return docs.mapInArrow(scored, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, cfg: Ftrl = Ftrl()) -> DataFrame:
    """Documents whose score is below the threshold, with the columns they came with."""
    return score(docs, train(docs, labels, F.lit(True), cfg), cfg.bits).filter(F.col("toxicity_score") < threshold).select(*docs.columns)
