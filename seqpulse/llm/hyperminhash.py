r"""Near copies by HyperMinHash: compressed one-permutation registers, banded, estimated with a correction for chance, and verified on whole sets.

1. A set of word shingles is hashed once. The first 8 bits of a hash choose one of 256 buckets, the smallest rest of a bucket is kept as its
   number of leading zeros and the 10 bits that follow the first one: 16 bits a register. Empty buckets borrow the register of another bucket, in an order
   fixed for each bucket, so that a register of two sets agrees with their Jaccard similarity as chance whatever their sizes. Equal sets form a class
   (a 64-bit hash of the whole set and its size) and are treated once.
2. 51 bands of 5 registers are the keys by which classes meet. Two sets at the threshold of 0.8 share no band with chance (1 - 0.8^5)^51, 2e-9.
3. Two classes that meet are compared by their registers. The share that agrees, less what sets of these sizes agree by chance,
   estimates the similarity; pairs six standard deviations below the threshold are dropped, the others are verified on their full sets.
4. Each class is first compared with one hub, the one of most of its bands, in linear work. Bands that still hold several components are then compared
   in full: in tiles by salt, whose number follows the size of the band's group, each pair in the first band it shares, and verified there, so that
   pairs are never written out. Pairs inside a component cannot change a component and are left out.

Words are `[^\x20\x09-\x0D]+` after A-Z are lower-cased. A text of fewer words than a shingle is one shingle. Null or empty texts have no set and are linked with nothing.
A component's id is its smallest id that is not null; a row with a null id takes part, and alone keeps a null component. Repeated rows fall into one class.
Other columns play no part. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from seqpulse.llm.common import WordHashes, chunks, connected, free, mix, row_key, store, words_of

REGISTERS = 256
MANTISSA = 10
BAND = 5
BANDS = REGISTERS // BAND
#: Rounds in which each class meets one hub.
STARS = 2
#: Rows of a band's group that are compared with as many others in one tile.
TILE = 2000
#: Rows of tiles that one task holds at a time, about.
TASK_ROWS = 10_000
EMPTY = np.uint16(0xFFFF)
_REST = 52  # bits of a hash below the bucket that count, so that doubles hold them


def shingles(texts: list[str | None], width: int, hashes: WordHashes) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = [words_of(t, lower=True) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    h = hashes.of([x for w in words for x in w])
    starts = np.cumsum(sizes) - sizes
    n = max(len(h) - width + 1, 0)
    with np.errstate(over="ignore"):
        key = np.full(n, np.uint64(width))
        for k in range(width):
            key = mix(key * np.uint64(31) + h[k : k + n])
        out = []
        for at, size in zip(starts, sizes):
            if size >= width:
                out.append(np.unique(key[at : at + size - width + 1]))
            else:
                one = np.full(min(size, 1), np.uint64(size))
                for j in range(at, at + size):
                    one = mix(one * np.uint64(31) + h[j : j + 1])
                out.append(one)
    return out


def class_of(members: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(members.tobytes(), seed=len(members)) - (1 << 63)


def donors() -> np.ndarray:
    """For each try (row) and bucket (column) the bucket to borrow from: all other buckets, in an order of the bucket's own."""
    rng = np.random.default_rng(1)
    return np.stack([rng.permutation(REGISTERS) for _ in range(REGISTERS)], axis=1)


def registers(sets: list[np.ndarray], borrow: np.ndarray) -> np.ndarray:
    """One row of registers for each set; sets without members have EMPTY in all."""
    sizes = np.array([len(s) for s in sets], np.int64)
    h = np.concatenate([*sets, np.zeros(0, np.uint64)])
    row = np.repeat(np.arange(len(sets)), sizes)
    bucket = (h >> np.uint64(56)).astype(np.int64)
    first = np.ones(len(h), bool)  # members are sorted, so the first of a bucket is its smallest
    first[1:] = (bucket[1:] != bucket[:-1]) | (row[1:] != row[:-1])
    h, row, bucket = h[first], row[first], bucket[first]
    rest = (h >> np.uint64(56 - _REST)) & np.uint64((1 << _REST) - 1)
    zeros = _REST - np.frexp(rest.astype(np.float64))[1].astype(np.int64)
    after = ((rest << zeros.astype(np.uint64)) >> np.uint64(_REST - 1 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    base = np.full((len(sets), REGISTERS), EMPTY)
    base[row, bucket] = (zeros << MANTISSA) | after.astype(np.int64)
    out = base.copy()
    r, c = np.nonzero((base == EMPTY) & (sizes > 0)[:, None])
    for source in borrow:
        if not len(r):
            break
        given = base[r, source[c]]
        out[r, c] = given
        r, c = r[given == EMPTY], c[given == EMPTY]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row."""
    bands = regs[:, : BANDS * BAND].reshape(-1, BANDS, BAND).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), bands.shape[:2])
        for k in range(BAND):
            key = mix(key * np.uint64(31) + bands[:, :, k])
    return key.view(np.int64)


def levels(n: np.ndarray) -> np.ndarray:
    """For sets of these sizes the chance of each number of leading zeros in a register."""
    edge = np.concatenate([2.0 ** -np.arange(_REST + 1, dtype=np.float64), [0.0]])
    return np.diff((1.0 - edge) ** np.maximum(np.asarray(n, np.float64) / REGISTERS, 1.0)[:, None], axis=1)


def estimate(agree: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of registers that agree, corrected for those that agree by chance.

    `a` and `b` are the levels of the two sets: registers of disjoint sets agree if both have the same zeros and then the same mantissa.
    """
    chance = (a * b).sum(axis=1) / (1 << MANTISSA)
    return (agree / REGISTERS - chance) / (1.0 - chance)


def cutoff(threshold: int) -> float:
    """Six standard deviations below the threshold."""
    t = threshold / 100
    return t - 6 * (t * (1 - t) / REGISTERS) ** 0.5


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, row_key, n, class and registers (binary); the last two are null without words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, borrow = WordHashes(200_000), donors()
        for table in chunks(batches, 2 << 20):
            sets = shingles(table["text"].to_pylist(), width, hashes)
            regs = registers(sets, borrow)
            out = pa.table({
                "doc_id": table["doc_id"], "row_key": table["row_key"], "n": pa.array([len(s) for s in sets], pa.int64()),
                "class": pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()),
                "registers": pa.array([r.tobytes() if len(s) else None for r, s in zip(regs, sets)], pa.binary())})
            yield from out.to_batches()

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", row_key().alias("row_key"), "text").mapInArrow(run, f"doc_id {kind}, row_key long, n long, class long, registers binary")


def _keyed(classes: DataFrame) -> DataFrame:
    """class, key: one row for each band of each class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                piece = b.slice(at, 2000)
                keys = band_keys(_matrix(piece["registers"]))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(piece["class"].to_numpy(), BANDS)), pa.array(keys.ravel())], ["class", "key"])

    return classes.select("class", "registers").mapInArrow(run, "class long, key long")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _set(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), np.uint64)


def _linked_to(one: np.ndarray, others: list[np.ndarray], threshold: int) -> np.ndarray:
    """Which of some sets the one is linked with, by the exact sizes of the intersections."""
    sizes = np.array([len(x) for x in others], np.int64)
    flat = np.concatenate(others)
    place = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    both = np.add.reduceat((one[place] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * both >= threshold * (len(one) + sizes - both)


def _likely(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Pairs (class, hub) with their estimate, without those that the estimate rules out."""
    least = cutoff(threshold)
    mine = classes.select("class", "n", "registers")
    theirs = classes.select(F.col("class").alias("hub"), F.col("n").alias("m"), F.col("registers").alias("others"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n, m = b["n"].to_numpy(), b["m"].to_numpy()
                guess = estimate((_matrix(b["registers"]) == _matrix(b["others"])).sum(axis=1), levels(n), levels(m))
                ok = (guess >= least) & (100 * np.minimum(n, m) >= threshold * np.maximum(n, m))
                yield pa.RecordBatch.from_arrays([b["class"].filter(pa.array(ok)), b["hub"].filter(pa.array(ok)), pa.array(guess[ok])], ["class", "hub", "guess"])

    return pairs.join(mine, "class").join(theirs, "hub").select("class", "n", "registers", "hub", "m", "others").mapInArrow(run, "class long, hub long, guess double")


def _members(docs: DataFrame, classes: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """class, members (the sorted hashes) of the wanted classes, from the whole text of one row of each."""
    reps = wanted.join(classes.select("class", "rep.doc_id", "rep.row_key"), "class").select(F.col("class"), F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"))
    rows = docs.select("doc_id", row_key().alias("row_key"), "text")
    # one plan at every size: texts are dealt by their key once
    rows = rows.join(reps.hint("merge"), F.col("row_key").eqNullSafe(F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(200_000)
        for table in chunks(batches, 2 << 20):
            sets = [s for s in shingles(table["text"].to_pylist(), width, hashes) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([class_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["class", "members"])

    return rows.select("text").mapInArrow(run, "class long, members binary").dropDuplicates(["class"])


def _verified(pairs: DataFrame, members: DataFrame, threshold: int) -> DataFrame:
    """Linked pairs (a, b) among the pairs (class, hub), by exact intersection of the full sets.

    Pairs are grouped by hub and salt, and the hub's set goes to each of its salts once.
    """
    salts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / TILE).cast("int").alias("salts"))
    spread = pairs.join(salts, "hub").select("hub", "class", F.pmod(F.xxhash64("class"), "salts").cast("int").alias("salt"))
    hubs = spread.select("hub", F.col("hub").alias("class"), "salt").distinct()
    rows = spread.union(hubs).join(members, "class")

    def verify(table: pa.Table) -> pa.Table:
        hub = table["hub"][0].as_py()
        classes = table["class"].to_pylist()
        sets = [_set(x) for x in table["members"]]
        linked = _linked_to(sets[classes.index(hub)], sets, threshold)
        found = [c for c, ok in zip(classes, linked) if ok and c != hub]
        return pa.table({"a": pa.array([hub] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    return rows.groupBy("hub", "salt").applyInArrow(verify, "a long, b long")


def _tile_links(rows: DataFrame, classes: DataFrame, members: DataFrame, threshold: int) -> DataFrame:
    """Verified links (a, b) that join components, from stored rows key, class, root.

    Rows are dealt to tiles by themselves, so that one shuffle alone carries registers. Pairs are looked at in the first band they share and passed by
    sizes and estimate. Only rows that this leaves a partner get their sets, on which pairs are verified inside the tile; of the links only those come out that
    join what is still apart in the bucket, so that no more rows come out than went in.
    """
    salts = rows.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("salts"))
    salted = rows.join(salts, "key").withColumn("salt", F.pmod(F.xxhash64("class"), "salts").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
    dealt = salted.withColumn("other", other).select("key", F.least("salt", "other").alias("s1"), F.greatest("salt", "other").alias("s2"), "salt", "class", "root")
    buckets = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))
    placed = dealt.withColumn("bucket", F.pmod(F.xxhash64("key", "s1", "s2"), F.lit(buckets)).cast("int"))
    columns, sketched, least = placed.columns, classes.select("class", "n", "registers"), cutoff(threshold)

    def partners(table: pa.Table, apart: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """For the rows of all tiles of a bucket, one after the other, the rows that may be linked with each."""
        key, s1, s2, salt, c, n = (table[x].to_numpy() for x in ("key", "s1", "s2", "salt", "class", "n"))
        regs = _matrix(table["registers"])
        keys, level = band_keys(regs), levels(n)
        order = np.lexsort((s2, s1, key))
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in (key, s1, s2)])
        cut = np.append(np.flatnonzero(new), len(order))
        for a, b in zip(cut[:-1], cut[1:]):
            rows = order[a:b]
            x, y = rows[salt[rows] == s1[rows[0]]], rows[salt[rows] == s2[rows[0]]]
            for i in x:
                fits = apart(i, y) & (100 * np.minimum(n[i], n[y]) >= threshold * np.maximum(n[i], n[y]))
                if s1[i] == s2[i]:
                    fits &= c[y] > c[i]
                at = y[fits]
                at = at[keys[i][(keys[at] == keys[i]).argmax(axis=1)] == key[i]]
                if len(at):
                    at = at[estimate((regs[at] == regs[i]).sum(axis=1), level[i], level[at]) >= least]
                if len(at):
                    yield i, at

    def possible(table: pa.Table) -> pa.Table:
        root, ok = table["root"].to_numpy(), np.zeros(len(table), bool)
        for i, at in partners(table, lambda i, y: root[y] != root[i]):
            ok[i] = ok[at] = True
        return table.select(columns).filter(pa.array(ok))

    def compare(table: pa.Table) -> pa.Table:
        c, sets = table["class"].to_numpy(), [_set(x) for x in table["members"]]
        label = np.unique(table["root"].to_numpy(), return_inverse=True)[1]
        now = np.arange(label.max(initial=-1) + 1)  # the component of each root so far
        links = []
        for i, at in partners(table, lambda i, y: now[label[y]] != now[label[i]]):
            for j in at[_linked_to(sets[i], [sets[k] for k in at], threshold)]:
                p, q = now[label[i]], now[label[j]]
                if p != q:
                    now[now == q] = p
                    links.append((c[i], c[j]))
        pairs = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs.min(axis=1, initial=2**63 - 1), "b": pairs.max(axis=1, initial=-(2**63))})

    left = store(placed.join(sketched, "class").groupBy("bucket").applyInArrow(possible, placed.schema), "hmh-possible")
    return left.join(sketched, "class").join(members, "class").groupBy("bucket").applyInArrow(compare, "a long, b long")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Roots (class, root) after links (a, b): only what joins two components goes into the search for components."""
    ends = links.join(roots.toDF("a", "x"), "a").join(roots.toDF("b", "y"), "b").filter("x != y")
    up = connected(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return store(roots.join(up.toDF("root", "up"), "root", "left").select("class", F.coalesce("up", "root").alias("root")), "hmh-roots")


def _nearest(candidates: DataFrame, roots: DataFrame, turn: int) -> DataFrame:
    """Pairs (class, hub) of different components: for each class the hub of most of its bands, among the hubs of this turn."""
    rooted = candidates.select("key", "class").join(roots, "class")
    hubs = rooted.groupBy("key").agg(F.min(F.struct(F.xxhash64("class", F.lit(turn)), "class", "root")).alias("h"))
    pairs = rooted.join(hubs, "key").filter(F.col("root") != F.col("h.root")).select("class", F.col("h.class").alias("hub"))
    return pairs.groupBy("class", "hub").count().groupBy("class").agg(F.max_by("hub", F.struct("count", "hub")).alias("hub"))


def _open(candidates: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows (key, class) of bands that hold several components, with their root."""
    rooted = candidates.join(roots, "class")
    several = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("key")
    return rooted.join(several, "key", "left_semi").select("key", "class", "root")


def near_copies(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, row_key, n_shingles, component_id and kept (doc_id is the component's) for every row."""
    sketched = store(sketches(docs, width), "hmh-sketches")
    rows = store(sketched.drop("registers"), "hmh-rows")
    full = sketched.filter(F.col("class").isNotNull())
    classes = store(full.groupBy("class").agg(F.first("n").alias("n"), F.first("registers").alias("registers"), F.min(F.struct("doc_id", "row_key")).alias("rep"),
                                              F.min("doc_id").alias("least")), "hmh-classes")
    free(sketched)
    # sets too small to reach the threshold with any other set meet none
    each = _keyed(classes.filter(100 * F.col("n") >= threshold * (F.col("n") + 1)))
    met = each.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    candidates = store(each.join(met, "key"), "hmh-candidates")
    members = store(_members(docs, classes, candidates.select("class").distinct(), width), "hmh-members")
    roots = store(members.select("class", F.col("class").alias("root")), "hmh-roots")
    for turn in range(STARS):
        # one hub for each class, the one it shares most bands with: a family becomes one component in linear work
        star = store(_likely(_nearest(candidates, roots, turn), classes, threshold).select("class", "hub"), "hmh-star")
        roots = _merged(roots, _verified(star, members, threshold))
        done, candidates = candidates, store(_open(candidates.select("key", "class"), roots), "hmh-open")
        free(done)
    roots = _merged(roots, store(_tile_links(candidates, classes, members, threshold), "hmh-links"))

    of_class = classes.select("class", "least").join(roots, "class", "left").select("class", "least", F.coalesce("root", "class").alias("root"))
    of_root = of_class.groupBy("root").agg(F.min("least").alias("component"))
    known = store(of_class.join(of_root, "root").select("class", "component"), "hmh-components")
    free(classes, candidates, members)
    component = F.coalesce("component", "doc_id")
    return rows.join(known, "class", "left").select(
        "doc_id", "row_key", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_copies(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """One document of each component, the one with the smallest id; documents without words stay. Columns as given.

    Of rows that repeat the kept id one of each text stays.
    """
    kept = near_copies(docs, width, threshold).filter("kept").select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")).distinct()
    key = f"_key_{len(docs.columns)}"
    keyed = docs.withColumn(key, row_key())
    same = keyed["doc_id"].eqNullSafe(kept["_id"]) & (keyed[key] == kept["_key"])
    return keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", key]).select(*docs.columns)
