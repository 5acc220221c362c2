"""What the training-data operators share: the shared folder, stored intermediates, broadcast bounds, word hashes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A side of a join is broadcast only when its measured text is below this many bytes.
BROADCAST_BYTES = 64 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of rows that are handed to an Arrow function at once, about; by their number alone, 10,000 long texts would be.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset a local master may use one below the warehouse; on a cluster it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (folder or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints").rstrip("/")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """These settings for what is run inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def store(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so that a lost executor costs a re-read.

    The shuffle files of the write are removed when it has ended, as what it made is stored.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with settings(df.sparkSession, {CLEANUP: "true", BATCH: str(BATCH_BYTES)}):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def free(*frames: DataFrame) -> None:
    """Remove what `store` wrote for these frames, once all that is made of them is stored itself."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def row_key(text: str = "text") -> Column:
    """Tells rows of one doc_id apart by their text; equal rows get equal results."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def fold(id_column: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


# numpy helpers, used inside Arrow functions ----------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of a word's bytes, remembered; emptied when it holds `limit` words, so that memory stays bounded."""

    def __init__(self, limit: int = 400_000):
        import xxhash

        super().__init__()
        self.limit, self.digest = limit, xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.digest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    r"""Words `[^\x20\x09-\x0D]+` as UTF-8; bytes.split() cuts at exactly these six characters."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.translate(_LOWER) if lower else raw).split()


def chunks(batches: Iterator[pa.RecordBatch], size: int, weight: str = "text") -> Iterator[pa.Table]:
    """Rows of the incoming batches in tables of about `size` bytes of text; a single larger row makes its own."""
    held, held_bytes = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.schema.get_field_index(weight))), 0), np.int64)
        start = 0
        ends = np.cumsum(lengths)
        base = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, base + size - held_bytes, "right"))
            stop = min(max(stop, start + (not held)), batch.num_rows)
            if stop > start:
                held.append(batch.slice(start, stop - start))
                held_bytes += int(ends[stop - 1] - base)
                base, start = int(ends[stop - 1]), stop
            if start < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, held_bytes = [], 0
    if held:
        yield pa.Table.from_batches(held)


_SLICES = 64


def count_slots(docs: DataFrame, bits: int, slots: Callable[[list[str | None], WordHashes], np.ndarray]) -> np.ndarray:
    """How often each of 2**bits hash slots occurs in all texts: 2**bits numbers, whatever the size of the corpus.

    A task adds up its own texts and hands on one block per slice of slots, so that what is shuffled follows the number
    of tasks; each slice is added up by itself.
    """
    width = (1 << bits) // _SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, hashes = np.zeros(1 << bits, np.int64), WordHashes()
        for table in chunks(batches, 2 << 20):
            total += np.bincount(slots(table["text"].to_pylist(), hashes), minlength=1 << bits)
        blocks = [total[i * width : (i + 1) * width] for i in range(_SLICES)]
        kept = [i for i, b in enumerate(blocks) if b.any()]
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array([blocks[i].tobytes() for i in kept], pa.binary())], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, block in zip(b["slice"].to_pylist(), b["counts"]):
                sums[i] = sums.get(i, 0) + np.frombuffer(block.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "counts"])

    schema = "slice int, counts binary"
    rows = docs.select("text").mapInArrow(count, schema).repartition("slice").mapInArrow(add, schema)
    out = np.zeros((_SLICES, width), np.int64)
    with settings(docs.sparkSession, {BATCH: str(BATCH_BYTES)}):
        found = rows.collect()  # 2**bits numbers
    for r in found:
        out[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    return out.reshape(-1)


def connected(edges: DataFrame) -> DataFrame:
    """Columns node, root (the smallest node it is linked with) for the nodes of undirected edges (a, b).

    Each round takes the smallest label around a node and then the label of that label, so that long chains halve.
    """
    both = store(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        nearer = labels.join(near, "node").select("node", F.least("root", "near").alias("up"), F.col("root").alias("old"))
        jump = labels.select(F.col("node").alias("up"), F.col("root").alias("far"))
        new = store(nearer.join(jump, "up", "left").select("node", F.least("up", "far").alias("root"), "old"), "labels")
        changed = new.filter("root != old").limit(1).count()
        labels = new.select("node", "root")
        if not changed:
            return labels
