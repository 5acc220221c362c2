"""Token ids in the Arrow file format: record batches of fixed-size lists, for random access without copying.

Documents are dealt by ranges of doc_id and sorted, each task encodes its range and writes one Arrow IPC file: batches with
`ids` and `mask`, both fixed-size lists of `length`. The ids of a range run on from sequence to sequence; the last sequence of a file is padded
with `end_id` and masked 0. A row of the index tells, per document, the file, the offset in it and the number of ids; the global start follows
from sums over files. File names hold the attempt, and only files named in the stored index count, so a task that runs twice does no
harm. Ids are 16-bit where the vocabulary allows it.

Where a tokenizer drops spaces (found out by probe texts), words between spaces are encoded once per task and remembered up to a bound of bytes, in one call
for the texts of a chunk; any other tokenizer gets whole texts. Where its file says that it lower-cases and cuts by the pattern below, these
pieces stand for the words: there are fewer different ones, and its model alone gets them. The tests hold all three against encoding whole texts.

Defined cases: null and empty texts give the end id alone; rows of one doc_id follow each other by text; null ids come
first; an empty table gives an empty index and no file. A very long text is a chunk of its own. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window as W, functions as F

from seqpulse.llm.common import chunks, shared_folder, store

INDEX = "file string, at long, n_tokens long"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder named by URI or by path, and the path on it."""
    return (fs.FileSystem.from_uri(uri) if urlparse(uri).scheme else (fs.LocalFileSystem(), uri))


#: Texts by which it is found out whether a tokenizer gives the same ids for a text and for its words between single spaces.
PROBES = ("the quick  brown fox ", " a b", "x\n y   z", "don't stop , 12 34 . <a> b", "\u00c4\u00d6 \u6f22\u5b57  caf\u00e9 \u0301e", "   ")
#: Bytes the remembered words of a task may take, about.
REMEMBERED = 64 << 20
_BATCH = 4_000

#: The normalizer and pre-tokenizer whose cuts are made here, as tokenizer files write them.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
#: Letters that NFC leaves alone and that have one lower-case letter each, among these.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u017e\u0400-\u045f"
#: On texts without any other character, that pattern in Python's words. Of white space only what both call so.
_OTHER = re.compile(f"[^{_LETTERS}\\t\\n\\r -~\u00a1\u00ab\u00bb\u00bf\u2010-\u2027]")
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s{_LETTERS}0-9]+")


class Encoder:
    """Ids of whole texts, as bytes of unsigned 32-bit numbers.

    Where the tokenizer drops spaces, texts are cut at them or into the tokenizer's own pieces, these are remembered, and those not known yet go to the
    tokenizer in one call for all texts of a chunk. Any other tokenizer gets the texts whole.
    """

    def __init__(self, tokenizer_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.held = Tokenizer.from_file(tokenizer_path), {}, 0
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.cuts = not any(t.lstrip or t.rstrip or " " in t.content for t in added) and all(
            self._ids([p])[0] == b"".join(self._ids(p.split(" "))) for p in PROBES)
        self.added, self.model = [t.content for t in added], None
        if self.cuts and not any(t.normalized for t in added):
            self._take_model(json.loads(self.tokenizer.to_str()))

    def _take_model(self, said: dict) -> None:
        """The model by itself, if the tokenizer is one whose pieces can be cut here; `ends` tells the ids that end a piece."""
        from tokenizers import Tokenizer, models, pre_tokenizers

        model = {k: v for k, v in said["model"].items() if v is not None}
        wanted = (said["normalizer"], said["pre_tokenizer"], said["truncation"], said["padding"])
        suffix = model.get("end_of_word_suffix")
        if wanted != (_NORMALIZER, {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]}, None, None) or model.pop("type") != "BPE" or not suffix or "dropout" in model:
            return
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model.pop("merges")]
        self.model = Tokenizer(models.BPE(merges=merges, cache_capacity=0, **model))  # what it has seen is remembered here
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
        self.ends[[i for token, i in model["vocab"].items() if token.endswith(suffix)]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of_pieces(self, pieces: list[str]) -> list[bytes]:
        ids = np.array(self.model.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(pieces):  # a symbol the vocabulary lacks
            return self._ids(pieces)
        flat, at = ids.tobytes(), (4 * ends).tolist()
        return [flat[a:b] for a, b in zip([0, *at], at)]

    def _plain(self, text: str) -> bool:
        return not _OTHER.search(text) and not any(x in text for x in self.added)

    def _cut(self, text: str) -> list[str]:
        """Words, or pieces; among pieces a word that has to go to the tokenizer as it is begins with a space."""
        if not self.model:
            return text.split(" ")
        if self._plain(text):
            return _PIECE.findall(text.lower())
        return [x for w in text.split(" ") for x in (_PIECE.findall(w.lower()) if self._plain(w) else [" " + w])]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        if not self.cuts:
            return [np.frombuffer(self._ids([t])[0], np.uint32) if t else np.zeros(0, np.uint32) for t in texts]
        words = [self._cut(t) if t else [] for t in texts]
        known = self.known
        missing = set().union(*words).difference(known)
        if missing and self.held > REMEMBERED:
            known.clear()
            self.held, missing = 0, set().union(*words)
        whole = [w for w in missing if not self.model or w[0] == " "]
        for todo, encode in ((whole, self._ids), (list(missing.difference(whole)), self._ids_of_pieces)):
            for at in range(0, len(todo), _BATCH):
                piece = todo[at : at + _BATCH]
                ids = encode(piece)
                known.update(zip(piece, ids))
                self.held += sum(map(len, piece)) + sum(map(len, ids)) + 200 * len(piece)
        return [np.frombuffer(b"".join(map(known.__getitem__, some)), np.uint32) for some in words]


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1, length: int = 2048, parts: int | None = None) -> DataFrame:
    """Write the files below `folder`; returns the stored index: doc_id, file, at, n_tokens, start."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    run = uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        encoder, writer, held, n_held, at = Encoder(tokenizer_path), None, [], 0, 0
        kind = pa.uint16() if encoder.tokenizer.get_vocab_size() <= 1 << 16 else pa.uint32()
        schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        name = f"{folder}/{run}-{context.partitionId():06d}-{context.taskAttemptId()}.arrow"
        system, path = open_folder(name)

        def put(values: np.ndarray, n: int) -> None:
            mask = np.arange(len(values)) < n
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(values, kind), length), pa.FixedSizeListArray.from_arrays(pa.array(mask), length)]
            writer.write_batch(pa.RecordBatch.from_arrays(arrays, schema=schema))

        sink = None
        for table in chunks(batches, 2 << 20):
            if writer is None:
                system.create_dir(path.rpartition("/")[0], recursive=True)
                sink = system.open_output_stream(path)
                writer = pa.ipc.new_file(sink, schema)
            sizes = []
            for of_text in encoder.encode_all(table["text"].to_pylist()):
                ids = np.append(of_text, end_id).astype(kind.to_pandas_dtype())
                sizes.append(len(ids))
                held.append(ids)
                n_held += len(ids)
                if n_held >= 256 * length:
                    flat = np.concatenate(held)
                    full = n_held // length * length
                    put(flat[:full], full)
                    held, n_held = [flat[full:]], n_held - full
            ends = at + np.cumsum(sizes)
            yield from pa.table({
                "doc_id": table["doc_id"], "file": pa.array([name] * len(sizes)), "at": pa.array(ends - sizes), "n_tokens": pa.array(sizes, pa.int64())}).to_batches()
            at = int(ends[-1])
        if writer is not None:
            if n_held:
                flat = np.concatenate(held)
                put(np.append(flat, np.full(-n_held % length, end_id, flat.dtype)), n_held)
            writer.close()
            sink.close()

    kind = dict(docs.dtypes)["doc_id"]
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    index = store(ordered.mapInArrow(write, f"doc_id {kind}, {INDEX}"), "token-index")
    # files in order of their part number; the sums over files are one row per file
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    starts = files.select("file", F.coalesce(F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return index.join(starts, "file").select("doc_id", "file", "at", "n_tokens", (F.col("base") + F.col("at")).alias("start"))


def read_tokens(index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian 32-bit numbers), from the files the index names.

    Any row is found by its offset alone: files are mapped where the file system is local, and only the sequences that hold
    the document are touched.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple = ("", None, None)
        for b in batches:
            crc = []
            for file, at, n in zip(b["file"].to_pylist(), b["at"].to_pylist(), b["n_tokens"].to_pylist()):
                if opened[0] != file:
                    system, path = open_folder(file)
                    source = pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)
                    reader = pa.ipc.open_file(source)
                    lists = [reader.get_batch(i)["ids"] for i in range(reader.num_record_batches)]
                    flat = [x.values for x in lists]
                    opened = (file, flat, np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int64))
                _, flat, ends = opened
                k, value, left = int(np.searchsorted(ends, at, "right")) - 1, 0, n
                while left:
                    piece = flat[k].slice(at - ends[k], left).to_numpy(zero_copy_only=True)
                    value = zlib.crc32(piece.astype("<u4").tobytes(), value)
                    at, left, k = at + len(piece), left - len(piece), k + 1
                crc.append(value)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["start"], b["n_tokens"], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = dict(index.dtypes)["doc_id"]
    return index.select("doc_id", "file", "at", "n_tokens", "start").sortWithinPartitions("file", "at").mapInArrow(read, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def token_folder(spark) -> str:
    return f"{shared_folder(spark)}/tokens"
