"""Hard negatives by the threshold algorithm: anchors search blocks of sorted lists, one list for each dimension.

Rows are dealt into blocks, anchors into slices, both of bounded size, and each pair of a block and a slice is one group. In a block every
dimension has a list of its rows sorted by that component. An anchor walks all lists at once, from the top where its own component is positive
and from the bottom where it is negative (a component of 0 adds nothing, so its list is left out). Each row it meets is scored by the exact integer inner product. No row that
has not been met can score above the threshold, the product of the anchor with the components at the present depth; the walk ends as soon as the
threshold is strictly below the k-th score of every window (strictly, as a tie may be won by a smaller id) or below the window's lower end, at the latest when all rows are met.

The first walk, over the rows of the anchor's label, gives the k best positives of a block; the best over all blocks set the windows of the second walk,
over the rows of other labels. Both walks keep k rows for each anchor, window and block.

Components are floor(scale x) of x as double. Rows with a null id, label or vector, or a null or non-finite component, take no part. Of rows that share an id and a length the one with
the smallest label, then vector, takes part. Only vectors of equal length meet. An empty table, and an anchor without positives or
negatives, give no rows. A score that a long cannot hold is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from seqpulse.llm.common import store

#: Rows of a block and anchors of a slice, at least and at most; between them the sizes follow the table.
BLOCK = (4096, 65536)
SLICE = (256, 16384)
#: The depth of the first step of a walk; each further step goes four times as deep.
FIRST = 16


class Lists:
    """The sorted lists of some rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").T.astype(np.int32)
        self.values = np.take_along_axis(vectors.T, self.order, axis=1)

    def walk(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """The rows met by each step, their scores, and what no other row can exceed."""
        n, dims = len(self.ids), np.flatnonzero(anchor)
        up, down = dims[anchor[dims] > 0], dims[anchor[dims] < 0]
        met, depth, step = np.zeros(n, bool), 0, FIRST
        while depth < n:
            to = depth + step
            # once most rows are met the rest is scored at one go: the lists are used up
            if len(dims) * to >= 2 * n or to >= n or not len(dims):
                to = n
                rows = np.flatnonzero(~met)
                bound = -np.inf
            else:
                new = np.zeros(n, bool)
                new[self.order[up, n - to : n - depth].ravel()] = True
                new[self.order[down, depth:to].ravel()] = True
                new &= ~met
                met |= new
                rows = np.flatnonzero(new)
                bound = float(anchor[up] @ self.values[up, n - to] + anchor[down] @ self.values[down, to - 1])
            yield rows, self.vectors[rows] @ anchor, bound
            depth, step = to, step * 4


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores, ties by smaller id."""
    if len(ids) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= cut)
    else:
        some = np.arange(len(ids))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def search(lists: Lists, anchor: np.ndarray, windows: list[tuple[float, float]], k: int, skip: Callable[[np.ndarray], np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and scores of the k best rows in each window [low, high] of scores; rows for which `skip` holds are passed over."""
    none = np.zeros(0, lists.ids.dtype), np.zeros(0, lists.vectors.dtype)
    found = [none] * len(windows)
    open_ = set(range(len(windows)))
    for rows, scores, bound in lists.walk(anchor):
        use = ~skip(rows)
        rows, scores = rows[use], scores[use]
        for w in list(open_):
            low, high = windows[w]
            fits = (scores >= low) & (scores <= high)
            if fits.any():
                ids, values = np.concatenate([found[w][0], lists.ids[rows[fits]]]), np.concatenate([found[w][1], scores[fits]])
                top = best(ids, values, k)
                found[w] = ids[top], values[top]
            kth = found[w][1][-1] if len(found[w][1]) == k else -np.inf
            if bound < max(kth, low):
                open_.discard(w)
        if not open_:
            break
    return found


def _whole(vectors: np.ndarray, anchors: np.ndarray) -> np.dtype:
    """Doubles hold every product and sum exactly where they stay below 2**53; else longs, where they fit."""
    bound = float(np.abs(vectors).max(initial=0)) * float(np.abs(anchors).max(initial=0)) * max(vectors.shape[1], 1)
    if bound < 2.0**53:
        return np.dtype(np.float64)
    if bound < 2.0**62:
        return np.dtype(np.int64)
    raise ValueError("inner products of these vectors do not fit a long")


def _vectors(column: pa.ChunkedArray, scale: int) -> np.ndarray:
    n = len(column)
    values = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * values).reshape(n, -1)


def _usable(rows: DataFrame, modulus: int, labels: int) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % modulus == 0, (label + 1) % labels).otherwise(label) if modulus else label
    real = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    return rows.select("vec_id", "label", "embedding").filter(real & finite).select(
        F.col("vec_id").cast("long").alias("id"), moved.alias("label"), F.col("embedding").alias("vector"), F.size("embedding").alias("dims"))


def _meet(rows: DataFrame, anchors: DataFrame, sizes: tuple[int, int], answer: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """`answer` for each pair of a block of rows and a slice of anchors; anchors may have more columns."""
    n_blocks, n_slices = sizes
    more = [c for c in anchors.columns if c not in rows.columns]
    block = F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")
    piece = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_slices)).cast("int")
    kinds = dict(anchors.dtypes)
    some = rows.withColumns({c: F.lit(None).cast(kinds[c]) for c in more})
    some = some.withColumns({"block": block, "piece": F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))), "asks": F.lit(False)})
    asking = anchors.withColumns({"block": F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))), "piece": piece, "asks": F.lit(True)})

    def run(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy()
        order = np.lexsort((table["label"].to_numpy(), table["id"].to_numpy()))
        left, right = order[~asks[order]], order[asks[order]]
        return answer(table.take(left), table.take(right))

    names = [*rows.columns, *more, "block", "piece", "asks"]
    return some.select(names).union(asking.select(names)).groupBy("dims", "block", "piece").applyInArrow(run, schema)


def _first_of_id(table: pa.Table) -> pa.Table:
    """Rows sorted by id and label: of those with one id the first, by label and then vector."""
    ids = table["id"].to_numpy()
    new = np.ones(len(ids), bool)
    new[1:] = ids[1:] != ids[:-1]
    starts = np.flatnonzero(new)
    if len(starts) == len(ids):
        return table
    label, keep = table["label"].to_numpy(), []
    for a, b in zip(starts, np.append(starts[1:], len(ids))):
        same = [i for i in range(a, b) if label[i] == label[a]]
        keep.append(a if len(same) == 1 else min(same, key=lambda i: table["vector"][i].as_py()))
    return table.take(keep)


def mine(rows: DataFrame, anchor_step: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
         moved_step: int = 7, labels: int = 10) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from rows vec_id, embedding, label.

    Anchors are the rows whose id `anchor_step` divides. A negative's score is `low` to `high` percent of its positive's. Labels of rows whose id
    `moved_step` divides move on by one of `labels`; 0 moves none.
    """
    usable = _usable(rows, moved_step, labels)
    asked = usable.filter(F.col("id") % anchor_step == 0).groupBy("id").agg(F.min(F.struct("dims", "label", "vector")).alias("r")).select("id", "r.label", "r.vector", "r.dims")
    asked = store(asked, "anchors")
    n, n_asked = usable.count(), asked.count()
    block = min(BLOCK[1], max(BLOCK[0], n // 64))
    piece = min(SLICE[1], max(SLICE[0], n_asked // 4))
    sizes = (max(-(-n // block), 1), max(-(-n_asked // piece), 1))

    def positive(some: pa.Table, asking: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if some.num_rows and asking.num_rows:
            some = _first_of_id(some)
            vectors, wanted = _vectors(some["vector"], scale), _vectors(asking["vector"], scale)
            kind = _whole(vectors, wanted)
            vectors, wanted = vectors.astype(kind), wanted.astype(kind)
            ids, label = some["id"].to_numpy(), some["label"].to_numpy()
            by_label: dict[int, Lists] = {}
            for anchor, its, v in zip(asking["id"].to_pylist(), asking["label"].to_pylist(), wanted):
                if its not in by_label:
                    inside = np.flatnonzero(label == its)
                    by_label[its] = Lists(ids[inside], vectors[inside])
                lists = by_label[its]
                (found, scores), = search(lists, v, [(-np.inf, np.inf)], positives, lambda r: lists.ids[r] == anchor)
                out += [(anchor, int(i), int(s)) for i, s in zip(found, scores)]
        a, b, c = zip(*out) if out else ((), (), ())
        return pa.table({"anchor": pa.array(a, pa.int64()), "positive_id": pa.array(b, pa.int64()), "positive_score": pa.array(c, pa.int64())})

    near = _meet(usable, asked, sizes, positive, "anchor long, positive_id long, positive_score long")
    place = F.row_number().over(W.partitionBy("anchor").orderBy(F.col("positive_score").desc(), "positive_id"))
    near = near.withColumn("place", place).filter(F.col("place") <= positives)
    chosen = near.groupBy("anchor").agg(F.collect_list("positive_id").alias("p_ids"), F.collect_list("positive_score").alias("p_scores"))
    # at most `positives` entries for each anchor
    asked = store(asked.join(chosen, asked["id"] == chosen["anchor"]).drop("anchor"), "anchors-windows")

    def negative(some: pa.Table, asking: pa.Table) -> pa.Table:
        cols: list[list[np.ndarray]] = [[], [], [], [], []]
        if some.num_rows and asking.num_rows:
            some = _first_of_id(some)
            vectors, wanted = _vectors(some["vector"], scale), _vectors(asking["vector"], scale)
            kind = _whole(vectors, wanted)
            label, lists, wanted = some["label"].to_numpy(), Lists(some["id"].to_numpy(), vectors.astype(kind)), wanted.astype(kind)
            for anchor, its, v, p_ids, p_scores in zip(*(asking[c].to_pylist() for c in ("id", "label")), wanted, asking["p_ids"].to_pylist(), asking["p_scores"].to_pylist()):
                # whole numbers s with low * p <= 100 * s <= high * p
                windows = [(-(-low * p // 100), high * p // 100) for p in p_scores]
                for p, score, (found, scores) in zip(p_ids, p_scores, search(lists, v, windows, negatives, lambda r: label[r] == its)):
                    n = len(found)
                    for c, x in zip(cols, (np.full(n, anchor), np.full(n, p), found, np.full(n, score), scores)):
                        c.append(np.asarray(x, np.int64))
        names = ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")
        return pa.table({k: np.concatenate(c) if c else np.zeros(0, np.int64) for k, c in zip(names, cols)})

    hard = _meet(usable, asked, sizes, negative, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    rank = F.row_number().over(W.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id"))
    return hard.withColumn("rank", rank).filter(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
