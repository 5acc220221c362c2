r"""Target-distribution importance resampling over hashed word n-grams, by CRCs of substrings taken from running CRCs.

1. A text is brought to its words joined by one space and scanned once; the CRC-32 of everything up to the end of each word is kept.
2. CRC-32 is linear over GF(2): appending n zero bytes to a prefix is a fixed linear map ("shift by n"), and
   crc(AB) = shift(crc(A), |B|) xor crc(B). So crc(B) = crc(AB) xor shift(crc(A), |B|): the prefix cancels, and the CRC of every run of words
   comes from the running CRCs at its two ends, without its bytes being read again.
3. Bucket counts of the corpus and of the target (`n_buckets` numbers each, whatever the size of the corpus) give each bucket an integer gain,
   the weight of a text is the sum over its features, and a Gumbel draw seeded by the id turns weights into a sample without replacement.
4. Ranks come from a range shuffle by score: rows in front of a range are counted, rows inside it are numbered. No task holds all.

The buckets of a text are stored in the shared folder by the scan (two bytes a feature), so that texts are read once.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased. A null or empty text has no features and weight 0. A null id draws as the
empty text would. Rows that repeat an id are drawn each by itself; rows equal in score and id are numbered in any order. An empty corpus gives
an empty result, an empty target counts of 0. Other columns play no part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from seqpulse.llm.common import chunks, row_key, store

N_BUCKETS = 10_000
WIDEST = 3
#: Lower-cases A-Z and turns every ASCII byte that is no digit or letter into the separator.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_POLYNOMIAL = 0xEDB88320  # of CRC-32 as zlib has it, bits reversed


class Shifter:
    """The linear maps "append n zero bytes" on CRC-32 values, by tables over the four bytes of a value."""

    def __init__(self):
        one = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            one = np.where(one & 1, (one >> 1) ^ np.uint32(_POLYNOMIAL), one >> 1).astype(np.uint32)
        self.one = one
        value = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
        low = []
        for _ in range(256):
            low.append(value.reshape(-1))
            value = one[value & 255] ^ (value >> 8)
        self.low = np.concatenate(low)
        # value is now the map for 256 bytes; each further map is the one before applied twice
        self.high = [value.reshape(-1)]
        while len(self.high) < 24:
            last = self.high[-1]
            self.high.append(self._apply(last, np.zeros(len(last), np.int64), last))

    @staticmethod
    def _apply(tables: np.ndarray, base: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return (tables[base + (crc & 255)] ^ tables[base + 256 + ((crc >> 8) & 255)]
                ^ tables[base + 512 + ((crc >> 16) & 255)] ^ tables[base + 768 + (crc >> 24)])

    def step(self, crc: np.ndarray, byte: int) -> np.ndarray:
        """The CRCs after one more byte."""
        raw = ~crc
        return ~(self.one[(raw ^ byte) & 255] ^ (raw >> 8))

    def shift(self, crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = self._apply(self.low, (lengths & 255) << 10, crc)
        rest = lengths >> 8
        bit = 0
        while rest.any():
            some = np.flatnonzero(rest & 1)
            out[some] = self._apply(self.high[bit], np.zeros(len(some), np.int64), out[some])
            rest, bit = rest >> 1, bit + 1
        return out


def _extend(crc: int, piece: bytes) -> int:
    return zlib.crc32(piece, crc)


def feature_crcs(texts: list[bytes | None], shifter: Shifter, widest: int = WIDEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The CRCs of all runs of 1 to `widest` words, text after text; words and features of each text."""
    words = [(t or b"").translate(NORMAL).split() for t in texts]
    n_words = np.array([len(w) for w in words], np.int64)
    total = int(n_words.sum())
    if not total:
        return np.zeros(0, np.uint32), n_words, np.zeros(len(texts), np.int64)
    ends: list[int] = []
    for w in words:
        if w:
            ends.extend(accumulate([b" " + x for x in w[1:]], _extend, initial=zlib.crc32(w[0])))
    end = np.array(ends, np.uint32)
    doc = np.repeat(np.arange(len(texts)), n_words)
    first = np.zeros(total, bool)
    first[(np.cumsum(n_words) - n_words)[n_words > 0]] = True
    # the CRC in front of a word: nothing in front of the first, else what was before it and a separator
    start = shifter.step(np.concatenate([end[:1], end[:-1]]), 32)
    start[first] = 0
    lengths = np.fromiter((len(x) for w in words for x in w), np.int64, total)
    stop = np.cumsum(lengths + 1) - 1
    at = stop - lengths
    crcs, real = np.zeros((total, widest), np.uint32), np.zeros((total, widest), bool)
    for k in range(min(widest, total)):
        n = total - k
        inside = np.flatnonzero(doc[:n] == doc[k:])
        crcs[inside, k] = end[inside + k] ^ shifter.shift(start[inside], stop[inside + k] - at[inside])
        real[inside, k] = True
    return crcs[real], n_words, np.bincount(doc, real.sum(axis=1), len(texts)).astype(np.int64)


def scan(docs: DataFrame, n_buckets: int = N_BUCKETS, widest: int = WIDEST, keep: bool = True) -> DataFrame:
    """doc_id, row_key, n_words, n_features and buckets (two bytes a feature) of each row; and a row with `counts` for each task that had rows.

    The rows of counts have a null row_key. Without `keep` they are the only ones.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifter, counts = Shifter(), np.zeros(n_buckets, np.int64)
        for table in chunks(batches, 512 << 10):
            crcs, n_words, n_features = feature_crcs(table["text"].cast(pa.binary()).to_pylist(), shifter, widest)
            buckets = (crcs % np.uint32(n_buckets)).astype("<u2")
            counts += np.bincount(buckets, minlength=n_buckets)
            if keep:
                cut = np.concatenate([[0], np.cumsum(n_features)])
                out = pa.table({
                    "doc_id": table["doc_id"], "row_key": table["row_key"], "n_words": pa.array(n_words), "n_features": pa.array(n_features),
                    "buckets": pa.array([buckets[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
                    "counts": pa.nulls(table.num_rows, pa.binary())})
                yield from out.to_batches()
        if counts.any():
            yield from pa.table({
                "doc_id": pa.nulls(1, id_type), "row_key": pa.nulls(1, pa.int64()), "n_words": pa.nulls(1, pa.int64()), "n_features": pa.nulls(1, pa.int64()),
                "buckets": pa.nulls(1, pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary())}).to_batches()

    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    rows = docs.select("doc_id", row_key().alias("row_key"), "text")
    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, row_key long, n_words long, n_features long, buckets binary, counts binary")


def add_counts(rows: DataFrame, n_buckets: int = N_BUCKETS) -> np.ndarray:
    """The bucket counts of all tasks, added up in two steps; `n_buckets` numbers reach the driver from each of a few tasks."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for b in batches:
            for x in b["counts"]:
                total += np.frombuffer(x.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    counts = rows.filter(F.col("counts").isNotNull()).select("counts")
    few = counts.mapInArrow(add, "counts binary").repartition(8).mapInArrow(add, "counts binary")
    return sum((np.frombuffer(r["counts"], np.int64) for r in few.collect()), np.zeros(n_buckets, np.int64))


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(...)) of the smoothed ratio of target to corpus in each bucket, in doubles."""
    s, t, n = float(raw.sum()), float(target.sum()), len(raw)
    return np.array([math.floor(1000.0 * math.log((float(y) + 1) * (s + n) / ((float(x) + 1) * (t + n)))) for x, y in zip(raw, target)], np.int64)


def weigh(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, row_key, n_words, n_features, weight from the stored buckets."""
    shared = rows.sparkSession.sparkContext.broadcast(gain)  # n_buckets numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for table in chunks(batches, 1 << 20, "buckets"):
            weight = [int(gain[np.frombuffer(x.as_buffer(), "<u2")].sum()) for x in table["buckets"]]
            yield from table.drop_columns(["buckets"]).append_column("weight", pa.array(weight, pa.int64())).to_batches()

    kind = dict(rows.dtypes)["doc_id"]
    real = rows.filter(F.col("counts").isNull()).select("doc_id", "row_key", "n_words", "n_features", "buckets")
    return real.mapInArrow(run, f"doc_id {kind}, row_key long, n_words long, n_features long, weight long")


def gumbel(seed: int, doc_id: str = "doc_id"):
    """A thousandfold standard Gumbel number, rounded down, from the digest of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """`scored` (a stored table) with `rank`: 1, 2, 3... for the drawn rows, null for the others."""
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("tie")]
    able = scored.filter(F.col("n_words") >= least_words).withColumn("tie", F.monotonically_increasing_id())
    placed = store(able.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "importance-ranges")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # one row for each range
    bases = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(W.partitionBy(F.lit(1))).alias("able"))
    number = F.col("base") + F.row_number().over(W.partitionBy("part").orderBy(*order))
    rank = F.when(number <= F.floor(F.lit(percent) * F.col("able") / F.lit(100)), number).cast("long")
    drawn = placed.join(bases, "part").withColumn("rank", rank).select(*scored.columns, "rank")
    return drawn.union(scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42, least_words: int = 20, n_buckets: int = N_BUCKETS, widest: int = WIDEST) -> DataFrame:
    """doc_id, row_key, n_words, n_features, weight, score, rank for every row; the rows with a rank are the sample.

    `target` needs a column text alone. `n_buckets` is at most 65,536.
    """
    rows = store(scan(docs, n_buckets, widest), "importance-buckets")
    wanted = scan(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), n_buckets, widest, keep=False)
    gain = gains(add_counts(rows, n_buckets), add_counts(wanted, n_buckets))
    scored = store(weigh(rows, gain).withColumn("score", F.col("weight") + gumbel(seed)), "importance-scores")
    return ranked(scored, percent, least_words)


def draw(docs: DataFrame, target: DataFrame, percent: int = 5, **more) -> DataFrame:
    """The drawn documents, columns as given. Rows equal in id and text come out once."""
    chosen = resample(docs, target, percent, **more).filter(F.col("rank").isNotNull()).select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")).distinct()
    key = f"_key_{len(docs.columns)}"
    keyed = docs.withColumn(key, row_key())
    same = keyed["doc_id"].eqNullSafe(chosen["_id"]) & (keyed[key] == chosen["_key"])
    return keyed.join(chosen, same, "left_semi").dropDuplicates(["doc_id", key]).select(*docs.columns)
