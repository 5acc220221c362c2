"""Windows of tokens that also start in a document with a smaller id: the exchange that both substring operators use.

Every window of `width` tokens gets a key: the name of an interior symbol that its own tokens determine (`Parse.keys`), so equal windows
have equal keys wherever they stand. A task first settles its own chunk: of equal windows those in later documents are covered, and one row per
window and chunk goes on, however often it occurs. The rows of a key meet in one bucket, where windows (told apart by key and
48 more bits of an independent hash) are covered if a smaller id has them. So a window costs at most one row per chunk, whatever the number of
copies. The number of buckets follows the bytes of all texts, so that a bucket's share stays the same. Consecutive windows of one
key travel as a group: with their hashes, or, where tokens are bytes, as the bytes they span, which are fewer and compress.

Results are ranges of covered window starts by doc_id; the caller applies them to the texts. Both are dealt by doc_id and joined, by one plan at
every size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from seqpulse.llm.common import chunks, free, mix, store

RANGE = np.dtype([("start", "<u4"), ("count", "<u4"), ("check", "<u4")])
BUCKET_BYTES = 16 << 20  # text for each bucket
BLOCK = 1 << 16  # windows that are hashed at once
LONGEST = 1 << 15  # windows in a group, whose count has 16 bits
_ODD = np.uint64(0x9E3779B97F4A7C15)
INF = 1 << 60


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each `width` consecutive tokens, by doubling."""
    with np.errstate(over="ignore"):
        parts, size, at = [], 1, h
        left = width
        while left:
            if left & 1:
                parts.append((size, at))
            left >>= 1
            if left:
                p = np.uint64(pow(int(_ODD), size, 1 << 64))
                at = at[:-size] * p + at[size:] if len(at) > size else at[:0]
                size *= 2
        n = len(h) - width + 1
        out, offset = np.zeros(max(n, 0), np.uint64), 0
        for size, x in parts:
            out = out * np.uint64(pow(int(_ODD), size, 1 << 64)) + x[offset : offset + len(out)]
            offset += size
        return mix(out)


def sliding_max(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.maximum(x[:-size], x[size:])
        size *= 2
    return np.maximum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def stable_order(x: np.ndarray) -> np.ndarray:
    """The stable order of 64-bit hashes: sorted as numbers, with the position in their lowest bits; where those bits were needed, by a stable sort."""
    low = np.uint64((1 << max(len(x) - 1, 1).bit_length()) - 1)
    order = (np.sort((x & ~low) | np.arange(len(x), dtype=np.uint64)) & low).astype(np.int64)
    found = x[order]
    return order if (found[1:] >= found[:-1]).all() else np.argsort(x, kind="stable")


def cut_out(starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of the windows at these (sorted) starts without the rest: their positions, the piece each one is in, and where each window starts among them."""
    first = np.concatenate([[True], starts[1:] > starts[:-1] + width])
    begin, end = starts[first], starts[np.append(np.flatnonzero(first)[1:] - 1, len(starts) - 1)] + width
    sizes = end - begin
    before = np.cumsum(sizes) - sizes
    at = np.arange(sizes.sum()) + np.repeat(begin - before, sizes)
    return at, np.repeat(np.arange(len(begin)), sizes), starts - (begin - before)[np.cumsum(first) - 1]


@dataclass
class Symbols:
    """A parse of the tokens: names, rows, and for each symbol the tokens [left, right) that determine it."""
    name: np.ndarray
    row: np.ndarray
    left: np.ndarray
    right: np.ndarray


@dataclass(frozen=True)
class Parse:
    """tokens: text to 64-bit tokens; levels: tokens and their rows to parses, coarsest last; width of a window; gram for the rest."""
    tokens: Callable[[list[str | None]], list[np.ndarray]]
    levels: Callable[[np.ndarray, np.ndarray], list[Symbols]]
    width: int
    gram: int
    chunk: int
    raw: Callable[[str | None], bytes] | None = None  # where tokens are bytes: these, and the token of each byte value
    alphabet: np.ndarray | None = None

    def _blocks(self, n: int) -> list[slice]:
        return [slice(a, a + BLOCK + self.width - 1) for a in range(0, max(n - self.width + 1, 0), BLOCK)]

    def keys(self, h: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Key of each window, block by block: it follows from the window alone, and arrays of a block stay near the core."""
        ends = self._blocks(len(h))
        return np.concatenate([np.zeros(0, np.uint64), *[self._keys(h[x], row[x]) for x in ends]])

    def hashes(self, h: np.ndarray) -> np.ndarray:
        """Hash of each window, by the same blocks."""
        ends = self._blocks(len(h))
        return np.concatenate([np.zeros(0, np.uint64), *[window_hashes(h[x], self.width) for x in ends]])

    def _keys(self, h: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Its symbol of the highest level, of these the one with the largest hashed name."""
        n = len(h) - self.width + 1
        best = np.zeros(max(n, 0), np.uint64)
        if n <= 0:
            return best
        lacking = np.ones(n, bool)
        for level, s in reversed(list(enumerate(self.levels(h, row), 1))):
            lo, hi = np.maximum(s.right - self.width, 0), np.minimum(s.left, n - 1)
            before = np.concatenate([[0], np.cumsum(lacking)])
            ok = (hi >= lo) & (s.right < INF) & (s.left >= 0)
            ok[ok] = before[hi[ok] + 1] > before[lo[ok]]
            lo, hi = lo[ok], hi[ok]
            value = (mix(s.name[ok] + np.uint64(level)) >> np.uint64(2)) | np.uint64(level << 62)
            most = int((hi - lo).max()) + 1 if len(lo) else 0
            found = np.zeros(n, np.uint64)
            for k in range(most):
                at = lo + k
                in_range = at <= hi
                np.maximum.at(found, at[in_range], value[in_range])
            best = np.where(lacking, found, best)
            lacking &= found == 0
            if not lacking.any():
                return best
        grams = window_hashes(h, self.gram) >> np.uint64(2)
        return np.where(lacking, sliding_max(grams, self.width - self.gram + 1), best)


def _ranges(row: np.ndarray, at: np.ndarray, check: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Runs of consecutive starts of a row (sorted by row, start): the row of each run, and the runs."""
    if not len(at):
        return row[:0], np.zeros(0, RANGE)
    new = np.ones(len(at), bool)
    new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    out = np.zeros(len(first), RANGE)
    out["start"], out["check"] = at[first], check[first]
    out["count"] = np.diff(np.append(first, len(at)))
    return row[first], out


def _by_id(ids: np.ndarray, runs: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Runs sorted by id, as one block per id."""
    cut = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, int)
    ends = np.append(cut[1:], len(ids))
    return [int(ids[i]) for i in cut], [runs[a:b].tobytes() for a, b in zip(cut, ends)]


def _load(table: pa.Table, parse: Parse):
    """The rows with an id, in its order: ids, dense ranks, tokens, the row of each token, where rows begin, and the table."""
    ids = table["doc_id"].combine_chunks()
    keep = ids.is_valid().to_numpy(zero_copy_only=False)
    table = table.filter(pa.array(keep))
    ids = table["doc_id"].to_numpy().astype(np.int64)
    order = np.argsort(ids, kind="stable")
    table, ids = table.take(pa.array(order)), ids[order]
    tokens = parse.tokens(table["text"].to_pylist())
    sizes = np.array([len(t) for t in tokens], np.int64)
    h = np.concatenate([*tokens, np.zeros(0, np.uint64)])
    rank = np.unique(ids, return_inverse=True)[1]
    return ids, rank, h, np.repeat(np.arange(len(ids)), sizes), np.concatenate([[0], np.cumsum(sizes)]), table


def _split(bucket: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    if n_buckets <= 1 << 16:
        bucket = bucket.astype(np.uint16)  # so short ones are sorted digit by digit
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n_buckets + 1))


def _rows(out: list[tuple[int, int | None, bytes, bytes]]) -> pa.RecordBatch:
    b, i, x, y = zip(*out) if out else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(i, pa.int64()), pa.array(x, pa.binary()), pa.array(y, pa.binary())], ["bucket", "doc_id", "groups", "data"])


_EXCHANGE = "bucket int, doc_id long, groups binary, data binary"
OPEN = np.dtype([("start", "<u4"), ("count", "<u2")])
_GROUP = np.dtype([("id", "<i8"), ("key", "<u8"), ("at", "<u4"), ("count", "<u2")])


def _pack(ids: np.ndarray, key: np.ndarray, at: np.ndarray, count: np.ndarray) -> bytes:
    """Columns one after the other, ids as differences: small numbers in sequence, which the shuffle's compression shortens."""
    return b"".join(x.tobytes() for x in (np.diff(ids, prepend=0).astype("<i8"), key.astype("<u8"), at.astype("<u4"), count.astype("<u2")))


def _unpack(block: bytes) -> tuple[np.ndarray, ...]:
    g = len(block) // 22
    return (np.cumsum(np.frombuffer(block, "<i8", g)), np.frombuffer(block, "<u8", g, 8 * g),
            np.frombuffer(block, "<u4", g, 16 * g), np.frombuffer(block, "<u2", g, 20 * g))


def _emit_windows(parse: Parse, n_buckets: int, with_open: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, parse.chunk):
            ids, rank, h, row, begin, table = _load(table, parse)
            n = len(h) - parse.width + 1
            if n <= 0:
                continue
            valid = row[:n] == row[parse.width - 1 :]
            if with_open:
                valid &= _open_windows(table["open"].to_pylist(), begin, n)
            at = np.flatnonzero(valid)
            if not len(at):
                continue
            row_of = row[at]
            # a key follows from the tokens of its window, so those of the windows that go are all that is parsed
            tokens, piece, place = cut_out(at, parse.width)
            own = h[tokens]
            key, w = parse.keys(own, row[tokens] + piece)[place], parse.hashes(own)[place]
            order = stable_order(w)  # rows are in order of id, so the first of equals has the smallest
            sw, sr = w[order], row_of[order]
            new = np.concatenate([[True], sw[1:] != sw[:-1]])[: len(sw)]
            first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(sw) else np.zeros(0, int)
            covered, goes = np.zeros(len(at), bool), np.zeros(len(at), bool)
            covered[order] = rank[sr] > rank[sr[first]]
            goes[order] = new | np.concatenate([[True], sr[1:] != sr[:-1]])[: len(sw)]
            goes &= ~covered
            check = w >> np.uint64(16)
            start = at - begin[row_of]
            out = []
            r, runs = _ranges(row_of[covered], start[covered], check[covered] >> np.uint64(16))
            out += [(i % n_buckets, i, None, x) for i, x in zip(*_by_id(ids[r], runs))]
            k, r, s, c = key[goes], row_of[goes], start[goes], check[goes]
            if len(k):
                cut = np.ones(len(k), bool)
                cut[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1)
                cut[::LONGEST] = True
                g = np.flatnonzero(cut)
                count = np.diff(np.append(g, len(k)))
                order, edge = _split((mix(k[g]) % np.uint64(n_buckets)).astype(np.int64), n_buckets)
                g, count = g[order], count[order]
                if parse.raw is None:
                    source, first, length, pack = c, g, count, _pack_checks
                else:
                    source = np.frombuffer(b"".join(map(parse.raw, table["text"].to_pylist())), np.uint8)
                    first, length, pack = at[goes][g], count + parse.width - 1, _squeeze
                ends = np.concatenate([[0], np.cumsum(length)])
                data = source[np.arange(ends[-1]) + np.repeat(first - ends[:-1], length)]
                for b in np.flatnonzero(np.diff(edge)):
                    i, j = edge[b], edge[b + 1]
                    x = g[i:j]
                    out.append((int(b), None, _pack(ids[r[x]], k[x], s[x], count[i:j]), pack(data[ends[i] : ends[j]])))
            yield _rows(out)
    return run


def _pack_checks(check: np.ndarray) -> bytes:
    return (check & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (check >> np.uint64(32)).astype("<u2").tobytes()


def _unpack_checks(block: bytes) -> np.ndarray:
    n = len(block) // 6
    return np.frombuffer(block, "<u4", n).astype(np.uint64) | (np.frombuffer(block, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32))


def _squeeze(data: np.ndarray) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data.tobytes(), "zstd", asbytes=True)


def _stretch(block: bytes) -> bytes:
    return pa.decompress(block[8:], int.from_bytes(block[:8], "little"), "zstd", asbytes=True)


def _spanned_checks(raw: np.ndarray, count: np.ndarray, parse: Parse) -> np.ndarray:
    """Hashes of the windows of groups that lie in `raw` one after the other, some a block or LONGEST windows at a time."""
    out, length = [np.zeros(0, np.uint64)], count + parse.width - 1
    ends = np.concatenate([[0], np.cumsum(length)])
    part = ends[:-1] // BLOCK
    cuts = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(count))
    for i, j in zip(cuts[:-1], cuts[1:]):
        w = window_hashes(parse.alphabet[raw[ends[i] : ends[j]]], parse.width) >> np.uint64(16)
        n = count[i:j]
        out.append(w[np.arange(n.sum()) + np.repeat(ends[i:j] - ends[i] - (np.cumsum(n) - n), n)])
    return np.concatenate(out)


def _join_groups(table: pa.Table, parse: Parse) -> tuple[np.ndarray, ...] | None:
    blocks = [(_unpack(g), d) for g, d in zip(table["groups"].to_pylist(), table["data"].to_pylist()) if g is not None]
    if not blocks:
        return None
    ids, key, at, count = (np.concatenate([b[0][k] for b in blocks]) for k in range(4))
    count = count.astype(np.int64)
    if parse.raw is None:
        check = np.concatenate([_unpack_checks(b[1]) for b in blocks])
    else:
        check = _spanned_checks(np.frombuffer(b"".join([_stretch(b[1]) for b in blocks]), np.uint8), count, parse)
    return ids, key, at.astype(np.int64), count, check


def _passed(table: pa.Table) -> tuple[list[int], list[bytes]]:
    rows = [(i, d) for i, d in zip(table["doc_id"].to_pylist(), table["data"].to_pylist()) if i is not None]
    return [i for i, _ in rows], [d for _, d in rows]


def _settle_windows(parse: Parse):
    def run(table: pa.Table) -> pa.Table:
        """Of the windows of a bucket those that a smaller id has too."""
        ids_out, runs_out = _passed(table)
        found = _join_groups(table, parse)
        if found is not None:
            ids, key, at, count, check = found
            ends = np.cumsum(count)
            at = np.arange(ends[-1]) - np.repeat(ends - count - at, count)
            ids, key = np.repeat(ids, count), np.repeat(key, count)
            with np.errstate(over="ignore"):
                same = mix(key + check * _ODD)
            by_id = np.argsort(ids, kind="stable")
            order = by_id[stable_order(same[by_id])]
            sk, sc, si = key[order], check[order], ids[order]
            new = np.ones(len(order), bool)
            new[1:] = (sk[1:] != sk[:-1]) | (sc[1:] != sc[:-1])
            covered = order[si > si[np.flatnonzero(new)[np.cumsum(new) - 1]]]
            covered = covered[np.lexsort((at[covered], ids[covered]))]
            r, runs = _ranges(ids[covered], at[covered], check[covered] >> np.uint64(16))
            more, blocks = _by_id(r, runs)
            ids_out, runs_out = ids_out + more, runs_out + blocks
        return pa.table({"doc_id": pa.array(ids_out, pa.int64()), "ranges": pa.array(runs_out, pa.binary())})
    return run


# keys that several documents share --------------------------------------------------------------------

def _emit_keys(parse: Parse, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, parse.chunk):
            ids, rank, h, row, begin, _ = _load(table, parse)
            n = len(h) - parse.width + 1
            if n <= 0:
                continue
            key = parse.keys(h, row)
            at = np.flatnonzero(row[:n] == row[parse.width - 1 :])
            if not len(at):
                continue
            key, row_of = key[at], row[at]
            cut = np.ones(len(at), bool)
            cut[1:] = (key[1:] != key[:-1]) | (row_of[1:] != row_of[:-1])
            cut[::LONGEST] = True
            cut = np.flatnonzero(cut)
            runs = np.zeros(len(cut), OPEN)
            at, key, row_of, runs["count"] = at[cut], key[cut], row_of[cut], np.diff(np.append(cut, len(at)))
            runs["start"] = at - begin[row_of]
            order = stable_order(key)
            sk, sr = key[order], row_of[order]
            new = np.concatenate([[True], sk[1:] != sk[:-1]])[: len(sk)]
            group = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(sk)) - 1
            shared = (rank[sr[first]] != rank[sr[last]])[group]
            here = np.sort(order[shared])
            out = [(i % n_buckets, i, None, x) for i, x in zip(*_by_id(ids[row_of[here]], runs[here]))]
            # one row per key that several documents of the chunk have, and all runs of the others; which it is is in the lowest bit of the start
            flag = np.zeros(len(at), np.int64)
            flag[order[shared & new]] = 1
            pick = np.sort(order[~shared | new])
            k, r, s, c = key[pick], row_of[pick], runs["start"][pick].astype(np.int64) * 2 + flag[pick], runs["count"][pick]
            order, edge = _split((mix(k) % np.uint64(n_buckets)).astype(np.int64), n_buckets)
            k, i, s, c = mix(k[order]) >> np.uint64(24), ids[r[order]], s[order], c[order]
            for b in np.flatnonzero(np.diff(edge)):
                x = slice(edge[b], edge[b + 1])
                low = b"".join(y.tobytes() for y in (np.diff(i[x], prepend=0).astype("<i8"), s[x].astype("<u4"), c[x].astype("<u2"), (k[x] >> np.uint64(32)).astype("u1")))
                out.append((int(b), None, low, (k[x] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()))
            yield _rows(out)
    return run


def _settle_keys(table: pa.Table) -> pa.Table:
    """The runs of windows, by document, whose key another document has too (40 bits of it: more may be found, never less)."""
    ids_out, runs_out = _passed(table)
    blocks = [(g, d) for g, d in zip(table["groups"].to_pylist(), table["data"].to_pylist()) if g is not None]
    if blocks:
        sizes = [len(d) // 4 for _, d in blocks]
        ids = np.concatenate([np.cumsum(np.frombuffer(g, "<i8", n)) for (g, _), n in zip(blocks, sizes)])
        start = np.concatenate([np.frombuffer(g, "<u4", n, 8 * n) for (g, _), n in zip(blocks, sizes)])
        count = np.concatenate([np.frombuffer(g, "<u2", n, 12 * n) for (g, _), n in zip(blocks, sizes)])
        high = np.concatenate([np.frombuffer(g, "u1", n, 14 * n) for (g, _), n in zip(blocks, sizes)])
        key = np.frombuffer(b"".join(d for _, d in blocks), "<u4").astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))
        order = stable_order(key << np.uint64(24))
        sk, si = key[order], ids[order]
        new = np.concatenate([[True], sk[1:] != sk[:-1]])
        first = np.flatnonzero(new)
        many = np.logical_or.reduceat((start[order] & 1).astype(bool), first) | (np.minimum.reduceat(si, first) != np.maximum.reduceat(si, first))
        found = order[many[np.cumsum(new) - 1]]
        found = found[np.argsort(ids[found], kind="stable")]
        runs = np.zeros(len(found), OPEN)
        runs["start"], runs["count"] = start[found] >> 1, count[found]
        more, more_runs = _by_id(ids[found], runs)
        ids_out, runs_out = ids_out + more, runs_out + more_runs
    return pa.table({"doc_id": pa.array(ids_out, pa.int64()), "starts": pa.array(runs_out, pa.binary())})


def _open_windows(opened: list, begin: np.ndarray, n: int) -> np.ndarray:
    """Which windows lie in an open run of their row."""
    blocks = [b"".join(x) if x else b"" for x in opened]
    runs = np.frombuffer(b"".join(blocks), OPEN)
    owner = np.repeat(np.arange(len(blocks)), [len(x) // OPEN.itemsize for x in blocks])
    start = np.minimum(runs["start"] + begin[owner], begin[owner + 1])  # rows of one id may differ in text
    end = np.minimum(start + runs["count"], begin[owner + 1])
    size = int(begin[-1]) + 1
    return np.cumsum(np.bincount(start, minlength=size) - np.bincount(end, minlength=size))[:n] > 0


def find_repeats(docs: DataFrame, parse: Parse, sparse: bool) -> DataFrame:
    """Stored columns doc_id, ranges (list of blocks) of the window starts that a document with a smaller id has too.

    With `sparse`, keys alone are exchanged first, and only windows whose key several documents have follow.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(3 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if sparse:
        keys = rows.mapInArrow(_emit_keys(parse, n_buckets), _EXCHANGE)
        opened = keys.groupBy("bucket").applyInArrow(_settle_keys, "doc_id long, starts binary")
        # stored, so that the shuffled keys are gone before the windows are
        opened = store(opened.groupBy("doc_id").agg(F.collect_list("starts").alias("open")), "repeats-open")
        rows = rows.join(opened.hint("merge"), "doc_id")
    windows = rows.mapInArrow(_emit_windows(parse, n_buckets, sparse), _EXCHANGE)
    hits = windows.groupBy("bucket").applyInArrow(_settle_windows(parse), "doc_id long, ranges binary")
    found = store(hits.groupBy("doc_id").agg(F.collect_list("ranges").alias("ranges")), "repeats")
    if sparse:
        free(opened)
    return found


def covered_tokens(h: np.ndarray, ranges: list[bytes] | None, width: int) -> np.ndarray:
    """Which tokens of one text lie in a covered window. Equal windows of the text share their verdict."""
    out = np.zeros(len(h), bool)
    n = len(h) - width + 1
    if not ranges or n <= 0:
        return out
    w = window_hashes(h, width)
    r = np.frombuffer(b"".join(ranges), RANGE)
    start, count = r["start"].astype(np.int64), r["count"].astype(np.int64)
    fits = start + count <= n
    fits[fits] = (w[start[fits]] >> np.uint64(32)).astype(np.uint32) == r["check"][fits]  # rows of one id may differ in text
    start, count = start[fits], count[fits]
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, start, 1)
    np.add.at(marks, start + count, -1)
    begins = np.cumsum(marks[:-1]) > 0
    in_order = np.sort(w)
    if (in_order[1:] == in_order[:-1]).any():
        begins = np.isin(w, w[begins])
    edges = np.zeros(len(h) + 1, np.int64)
    at = np.flatnonzero(begins)
    edges[at] += 1
    np.add.at(edges, at + width, -1)
    return np.cumsum(edges[:-1]) > 0


def apply_repeats(docs: DataFrame, hits: DataFrame, cut: Callable[[str | None, list[bytes] | None], tuple], added: T.StructType) -> DataFrame:
    """doc_id and what `cut` makes of each text and its ranges."""
    kind = dict(docs.dtypes)["doc_id"]
    ranges = hits.select(F.col("doc_id").cast(kind).alias("doc_id"), "ranges")
    joined = docs.select("doc_id", "text").join(ranges.hint("merge"), "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, 4 << 20):
            rows = [cut(t, r) for t, r in zip(table["text"].to_pylist(), table["ranges"].to_pylist())]
            arrays = [pa.array([x[i] for x in rows], pa.int64() if f.dataType == T.LongType() else pa.string() if f.dataType == T.StringType() else pa.binary())
                      for i, f in enumerate(added.fields)]
            yield from pa.table([table["doc_id"].combine_chunks(), *arrays], names=["doc_id", *added.names]).to_batches()

    schema = T.StructType([next(f for f in docs.schema.fields if f.name == "doc_id"), *added.fields])
    return joined.mapInArrow(run, schema)
