r"""N-gram Jaccard join: documents whose sets of word shingles overlap by `threshold` percent or more, and their groups.

1. A text becomes a set of 64-bit shingle hashes. Equal sets form a class (known by a 64-bit hash of the whole set and its size) and are treated once.
2. Shingles are put in one global order, those with the rarest word first (word counts from a sketch of fixed size over all documents; the
   order steers the work, any order gives the same links). Two sets that reach the threshold share one of the first
   n - ceil(t n) + 1 shingles of each, so classes meet by these keys.
3. Each class belongs to the family of the hub it shares most keys with (the smallest class of a key). All classes of a family are compared in tiles that
   hold their sets, whose number follows the family's size in classes and shingles. Sizes and bitmaps of 2,048 bits bound the overlap from above; what they
   leave is decided by an exact intersection of the sorted sets. A tile gives the links of each class as a sum, and of the links themselves only those that join what is
   still apart in it, so that no more rows come out than went in. Sets are fetched only for classes that bitmaps leave a possible partner.
4. Classes of different families that share a key meet by it: those of a key of few classes as plain pairs, those of other keys in tiles by size band (sizes beyond the
   threshold's ratio never meet) and salt, by sizes and bitmaps. Two sets that reach the threshold share more than one key: all of their overlap but what may lie behind the
   keys of either. Only pairs with that many common keys whose bitmaps allow it are verified on the full sets. Links of two classes of one family are never looked for by keys, so that each link counts once.

For the components alone (`jaccard_groups`, for drop_near_copies) the tiles of families leave out pairs that are joined already.

Words are `[^\x20\x09-\x0D]+` after A-Z are lower-cased. A text of fewer words than a shingle is one shingle. Null or empty texts have no
set and are linked with nothing. Rows with a null id take part; a component's id is its smallest id that is not null.
Repeated rows fall into one class. Other columns play no part. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from seqpulse.llm.common import WordHashes, chunks, connected, count_slots, free, mix, row_key, store, words_of

SKETCH_BITS = 16
BITMAP_BITS = 2048
TILE = 1000
#: Classes of different families that share a key of at most so many classes are paired without bitmaps.
FEW = 16
#: Shingles on one side of a family's tile, and rows of key tiles and shingles of family tiles that one task holds at a time, about.
TILE_SHINGLES = 2_000_000
TASK_ROWS = 100_000
TASK_SHINGLES = 4_000_000


def _slot(h: np.ndarray) -> np.ndarray:
    return (mix(h) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _sets(texts: list[str | None], width: int, hashes: WordHashes, counts: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """For each text its distinct shingles, sorted, and the count of each one's rarest word."""
    words = [words_of(t, lower=True) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    h = hashes.of([x for w in words for x in w])
    rarity = counts[_slot(h)] if counts is not None else None
    n = max(len(h) - width + 1, 0)
    out = []
    with np.errstate(over="ignore"):
        key = np.full(n, np.uint64(width))
        for k in range(width):
            key = mix(key * np.uint64(31) + h[k : k + n])
        rare = None
        if rarity is not None:
            rare = rarity[:n].copy()
            for k in range(1, width):
                np.minimum(rare, rarity[k : k + n], out=rare)
        for at, size in zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist()):
            if size >= width:
                mine = key[at : at + size - width + 1]
                order = np.argsort(mine)
                mine = mine[order]
                new = np.ones(len(mine), bool)
                np.not_equal(mine[1:], mine[:-1], out=new[1:])
                out.append((mine[new], rare[at : at + size - width + 1][order][new] if rare is not None else None))
            else:
                one = np.full(min(size, 1), np.uint64(size))
                for j in range(at, at + size):
                    one = mix(one * np.uint64(31) + h[j : j + 1])
                out.append((one, rarity[at : at + size].min(keepdims=True) if size and rarity is not None else np.zeros(len(one), np.int64)))
    return out


def _class_of(members: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(members.tobytes(), seed=len(members)) - (1 << 63)


def least_overlap(n: np.ndarray | int, threshold: int):
    """The smallest overlap a set of n needs with any partner."""
    return -(-threshold * n // 100)


def shingle_classes(docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """doc_id, row_key, n, class (null without words), keys (the first shingles in global order), bitmap."""
    def slots(texts, hashes):
        return _slot(hashes.of([w for t in texts for w in words_of(t, lower=True)]))

    shared = docs.sparkSession.sparkContext.broadcast(count_slots(docs, SKETCH_BITS, slots))

    def first(members: np.ndarray, rare: np.ndarray) -> np.ndarray:
        n = len(members)
        if 100 * n < threshold * (n + 1):
            return members[:0]  # too small to reach the threshold with any other set
        # members are sorted, so a stable sort by rarity orders equal ones by hash
        return members[np.argsort(rare, kind="stable")[: n - least_overlap(n, threshold) + 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = WordHashes(200_000), shared.value
        for table in chunks(batches, 2 << 20):
            sets = _sets(table["text"].to_pylist(), width, hashes, counts)
            chosen = [first(*x) for x in sets]
            ends = np.cumsum([0, *map(len, chosen)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*chosen, np.zeros(0, np.uint64)]).view(np.int64)))
            out = pa.table({
                "doc_id": table["doc_id"], "row_key": table["row_key"], "n": pa.array([len(x) for x, _ in sets], pa.int64()),
                "class": pa.array([_class_of(x) if len(x) else None for x, _ in sets], pa.int64()), "keys": lists,
                "bitmap": pa.array([x.tobytes() for x in _bitmaps([x for x, _ in sets])], pa.binary())})
            yield from out.to_batches()

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", row_key().alias("row_key"), "text").mapInArrow(run, f"doc_id {kind}, row_key long, n long, class long, keys array<long>, bitmap binary")


def _members(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The wanted rows (doc_id, row_key, class and `kept`, a struct) with members (sorted hashes), one row per class: the fields of kept and members.

    Texts and wanted rows are dealt by id and key together, so that one shuffle finds the texts and folds repeated rows.
    """
    kept = wanted.schema["kept"].dataType
    texts = docs.select("doc_id", row_key().alias("row_key"), "text", F.lit(None).cast(kept).alias("kept"))
    marks = wanted.select("doc_id", "row_key", F.lit(None).cast("string").alias("text"), "kept")
    rows = texts.union(marks).groupBy("doc_id", "row_key").agg(F.max("kept").alias("kept"), F.first("text", ignorenulls=True).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(200_000)
        for table in chunks(batches, 2 << 20):
            sets = [x for x, _ in _sets(table["text"].to_pylist(), width, hashes)]
            yield pa.RecordBatch.from_arrays([table["kept"].combine_chunks(), pa.array([x.tobytes() for x in sets], pa.binary())], ["kept", "members"])

    schema = f"kept {kept.simpleString()}, members binary"
    return rows.filter("kept is not null").select("kept", "text").mapInArrow(run, schema).select("kept.*", "members")


def _bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """For each slot whether the set has an odd number of members there: two such maps differ in no more slots than the sets in members, however full they are."""
    slots = (np.concatenate([*sets, np.zeros(0, np.uint64)]) >> np.uint64(65 - BITMAP_BITS.bit_length())).astype(np.int64)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    odd = np.bincount(row * BITMAP_BITS + slots, minlength=len(sets) * BITMAP_BITS) & 1
    return np.packbits(odd.astype(bool).reshape(len(sets), BITMAP_BITS), axis=1).view(np.uint64)


def _least_both(total: np.ndarray, threshold: int) -> np.ndarray:
    """The smallest overlap with which two sets of `total` members together are linked."""
    return -(-threshold * total // (100 + threshold))


def least_shared(total: np.ndarray | int, larger: np.ndarray | int, threshold: int):
    """The fewest common keys of two linked sets of `total` members together, the larger of `larger`: of the one whose keys end first, least_overlap - 1 members lie behind them."""
    return _least_both(total, threshold) - least_overlap(larger, threshold) + 1


def _linked(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= threshold * (len(a) + len(b) - both)


def _set(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), np.uint64)


def _star_edges(pairs: DataFrame, members: DataFrame, threshold: int) -> DataFrame:
    """Verified pairs (a, b). Pairs are grouped by a hub and a salt, the hub's set goes to each of its salts once."""
    salts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / TILE).cast("int").alias("salts"))
    spread = pairs.join(salts, "hub").select("hub", "class", F.pmod(F.xxhash64("class"), "salts").cast("int").alias("salt"))
    hubs = spread.select("hub", F.col("hub").alias("class"), "salt").distinct()
    rows = spread.union(hubs).join(members.select("class", "members"), "class")

    def verify(table: pa.Table) -> pa.Table:
        hub = table["hub"][0].as_py()
        classes = table["class"].to_pylist()
        centre = _set(table["members"][classes.index(hub)])
        found = [c for c, s in zip(classes, table["members"]) if c != hub and _linked(centre, _set(s), threshold)]
        return pa.table({"a": pa.array([hub] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    return rows.groupBy("hub", "salt").applyInArrow(verify, "a long, b long")


def _tile_pairs(rows: DataFrame, bitmaps: DataFrame, threshold: int) -> DataFrame:
    """Pairs (hub, class) of different roots that sizes and bitmaps allow, with their common keys in a bucket (shared) and those needed, from rows key, class, n, root, weight.

    Rows are dealt to tiles before they get their bitmap, so that only one shuffle carries bitmaps.
    """
    band = F.floor(F.log(F.col("n") + F.lit(0.5)) / F.lit(float(np.log(100 / threshold)))).cast("int")
    banded = rows.withColumn("band", band)
    # a partner's size is within the threshold's ratio, so it is in the same band or the next
    salts = banded.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("salts"))
    salted = banded.join(salts, "key").withColumn("salt", F.pmod(F.xxhash64("class"), "salts").cast("int"))
    every = F.sequence(F.lit(0), F.col("salts") - 1)
    whole = F.array(F.struct(F.lit(0).alias("low"), F.lit(0).alias("step"), F.lit(0).alias("s1"), F.lit(0).alias("s2"), F.lit(0).alias("side")))
    banded = F.flatten(F.transform(every, lambda s: F.array(
        F.struct(F.col("band").alias("low"), F.lit(0).alias("step"), F.least("salt", s).alias("s1"), F.greatest("salt", s).alias("s2"), F.lit(0).alias("side")),
        F.struct(F.col("band").alias("low"), F.lit(1).alias("step"), F.col("salt").alias("s1"), s.alias("s2"), F.lit(0).alias("side")),
        F.struct((F.col("band") - 1).alias("low"), F.lit(1).alias("step"), s.alias("s1"), F.col("salt").alias("s2"), F.lit(1).alias("side")))))
    # the group of most keys fits into one tile, with all its bands
    left = salted.withColumn("t", F.explode(F.when(F.col("salts") == 1, whole).otherwise(banded)))
    tiles = left.select("key", "t.low", "t.step", "t.s1", "t.s2", "t.side", "salt", "class", "n", "root", "weight")

    def compare(table: pa.Table) -> pa.Table:
        """All tiles of a bucket, one after the other."""
        key, low, step, s1, s2, side, salt, n, c, root, weight = (table[x].to_numpy() for x in ("key", "low", "step", "s1", "s2", "side", "salt", "n", "class", "root", "weight"))
        bits = np.frombuffer(b"".join(table["bitmap"].to_pylist()), np.uint64).reshape(len(n), -1)
        order = np.lexsort((s2, s1, step, low, key))
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in (key, low, step, s1, s2)])
        cut = np.append(np.flatnonzero(new), len(order))
        found = [np.zeros((0, 4), np.int64)]
        for a, b in zip(cut[:-1], cut[1:]):
            rows = order[a:b]
            if b - a < 2:
                continue
            one = rows[0]
            if step[one]:
                x, y = rows[side[rows] == 0], rows[side[rows] == 1]
            else:
                x, y = rows[salt[rows] == s1[one]], rows[salt[rows] == s2[one]]
            for i in x:
                total = n[i] + n[y]
                need = _least_both(total, threshold)
                fits = (np.minimum(n[i], n[y]) >= need) & (root[y] != root[i])
                if not step[one] and s1[one] == s2[one]:
                    fits &= c[y] > c[i]
                z = y[fits]
                if len(z):
                    differ = np.bitwise_count(bits[i] ^ bits[z]).sum(axis=1, dtype=np.int64)
                    z = z[total[fits] - 2 * need[fits] >= differ]
                    needed = least_shared(n[i] + n[z], np.maximum(n[i], n[z]), threshold)
                    found.append(np.stack([np.minimum(c[i], c[z]), np.maximum(c[i], c[z]), needed, np.full(len(z), weight[i])], axis=1))
        found = np.concatenate(found)
        pairs, place = np.unique(found[:, :3], axis=0, return_inverse=True)
        shared = np.zeros(len(pairs), np.int64)
        np.add.at(shared, place.reshape(-1), found[:, 3])
        return pa.table({"hub": pairs[:, 0], "class": pairs[:, 1], "needed": pairs[:, 2], "shared": shared})

    # many small tiles share a bucket, so that a call's cost is spread over them
    buckets = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))
    placed = tiles.withColumn("bucket", F.pmod(F.xxhash64("key", "low", "step", "s1", "s2"), F.lit(buckets)).cast("int"))
    dealt = placed.join(bitmaps.select("class", "bitmap"), "class")
    return dealt.groupBy("bucket").applyInArrow(compare, "hub long, class long, needed long, shared long")


def _plain_pairs(rows: DataFrame, threshold: int) -> DataFrame:
    """As _tile_pairs, for keys of few classes and by sizes alone: a row for each pair and key, which is less than bitmaps are."""
    one, other = rows.select("key", F.col("class").alias("hub"), F.col("n").alias("m"), F.col("root").alias("up"), "weight"), rows.select("key", "class", "n", "root")
    both = F.expr(f"({threshold} * (m + n) + {99 + threshold}) div {100 + threshold}")
    met = one.join(other, "key").filter((F.col("hub") < F.col("class")) & (F.col("up") != F.col("root")) & (F.least("m", "n") >= both))
    least = F.expr(f"({threshold} * greatest(m, n) + 99) div 100")
    return met.select("hub", "class", (both - least + 1).alias("needed"), F.col("weight").alias("shared"))


def _allowed(pairs: DataFrame, bitmaps: DataFrame, threshold: int) -> DataFrame:
    """The pairs (hub, class) that bitmaps allow."""
    of = bitmaps.select("class", "n", "bitmap")
    both = pairs.join(of.toDF("hub", "m", "hub_bitmap"), "hub").join(of, "class").select("hub", "class", (F.col("m") + F.col("n")).alias("total"), "hub_bitmap", "bitmap")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, other = (np.frombuffer(b"".join(b[x].to_pylist()), np.uint64).reshape(b.num_rows, -1) for x in ("hub_bitmap", "bitmap"))
            total = b["total"].to_numpy()
            fits = total - 2 * _least_both(total, threshold) >= np.bitwise_count(one ^ other).sum(axis=1, dtype=np.int64)
            yield b.select(["hub", "class"]).filter(pa.array(fits))

    return both.mapInArrow(run, "hub long, class long")


def _families(candidates: DataFrame, classes: DataFrame) -> DataFrame:
    """class, n, size, rep, bitmap, family, its classes (c) and tiles (salts, salt) for every class that shares a key.

    The family is the hub that a class shares most keys with, itself among them; where that hub belongs to another one, that one.
    """
    most = store(candidates.groupBy("class", "hub").count().groupBy("class").agg(F.max_by("hub", F.struct("count", "hub")).alias("hub")), "shingle-hubs")
    up = most.toDF("hub", "up")
    mine = store(most.join(up, "hub", "left").select("class", F.coalesce("up", "hub").alias("family")).join(classes, "class"), "shingle-family")
    salts = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int")
    of_family = mine.groupBy("family").agg(F.count("*").alias("c"), salts.alias("salts"))
    return store(mine.join(of_family, "family").select(
        "class", "n", "size", "rep", "bitmap", "family", "c", "salts", F.pmod(F.xxhash64("class"), "salts").cast("int").alias("salt")), "shingle-families")


def _possible(families: DataFrame, threshold: int) -> DataFrame:
    """The classes that sizes and bitmaps allow a link within their family; no set is needed for that."""
    several = families.filter("c > 1")
    held = several.agg(F.sum("salts")).first()[0] or 0
    buckets = max(int(families.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // TASK_ROWS))
    dealt = several.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select(
        "family", F.least("salt", "other").alias("s1"), F.greatest("salt", "other").alias("s2"), "salt", "class", "n", "bitmap")

    def compare(table: pa.Table) -> pa.Table:
        family, s1, s2, salt, c, n = (table[x].to_numpy() for x in ("family", "s1", "s2", "salt", "class", "n"))
        bits = np.frombuffer(b"".join(table["bitmap"].to_pylist()), np.uint64).reshape(len(n), -1)
        order = np.lexsort((n, s2, s1, family))
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in (family, s1, s2)])
        cut = np.append(np.flatnonzero(new), len(order))
        ok = np.zeros(len(n), bool)
        for first, end in zip(cut[:-1], cut[1:]):
            at = order[first:end]
            same = s1[at[0]] == s2[at[0]]
            x = at if same else at[salt[at] == s1[at[0]]]
            y = at if same else at[salt[at] == s2[at[0]]]
            for k, i in enumerate(x):
                z = y[k + 1 :] if same else y
                # sorted by size: those beyond the threshold's ratio are cut off
                lo, hi = np.searchsorted(n[z], [-(-threshold * n[i] // 100), 100 * n[i] // threshold + 1])
                z = z[lo:hi]
                if len(z):
                    total = n[i] + n[z]
                    z = z[total - 2 * _least_both(total, threshold) >= np.bitwise_count(bits[i] ^ bits[z]).sum(axis=1, dtype=np.int64)]
                    ok[z] = True
                    ok[i] |= len(z) > 0
        return pa.table({"class": pa.array(c[ok], pa.int64())})

    placed = dealt.withColumn("bucket", F.pmod(F.xxhash64("family", "s1", "s2"), F.lit(buckets)).cast("int"))
    return placed.groupBy("bucket").applyInArrow(compare, "class long")


def _family_tiles(members: DataFrame, threshold: int, mode: str) -> DataFrame:
    """All classes of a family against each other, in tiles that hold their sets. Rows (a, b, links):

    `links`: per class a and tile the number of rows linked with it (b null), and links (a, b) that join what is apart in the tile (links 0);
    `joins`: only the latter, without looking at pairs that are joined already; `pairs`: every link (a, b).
    """
    several = members.filter("c > 1")
    held = several.agg(F.sum(F.col("n") * F.col("salts"))).first()[0] or 0
    buckets = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // TASK_SHINGLES))
    dealt = several.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select(
        "family", F.least("salt", "other").alias("s1"), F.greatest("salt", "other").alias("s2"), "salt", "class", "size", "members")

    def compare(table: pa.Table) -> pa.Table:
        """All tiles of a bucket, one after the other."""
        family, s1, s2, salt, c, size = (table[x].to_numpy() for x in ("family", "s1", "s2", "salt", "class", "size"))
        order = np.lexsort((s2, s1, family))
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in (family, s1, s2)])
        cut = np.append(np.flatnonzero(new), len(order))
        column = table["members"].combine_chunks()
        out_a, out_b, out_links = [], [], []
        for first, end in zip(cut[:-1], cut[1:]):
            at = order[first:end]
            if len(at) < 2:
                continue
            sets = [_set(column[int(i)]) for i in at]
            n = np.array([len(x) for x in sets], np.int64)
            bits = _bitmaps(sets)
            # shingles numbered within the tile, so that an intersection is a look at marks
            names, flat = np.unique(np.concatenate(sets), return_inverse=True)
            ends = np.cumsum(n)
            sets = [flat[e - k : e] for e, k in zip(ends, n)]
            marked = np.zeros(len(names), bool)
            now = np.arange(len(at))  # what is joined so far
            links = np.zeros(len(at), np.int64)
            name, weight, side = c[at], size[at], salt[at]
            same = s1[at[0]] == s2[at[0]]
            x = np.arange(len(at)) if same else np.flatnonzero(side == s1[at[0]])
            y = x if same else np.flatnonzero(side == s2[at[0]])
            for i in x:
                z = y[y > i] if same else y
                total = n[i] + n[z]
                need = _least_both(total, threshold)
                fits = np.minimum(n[i], n[z]) >= need
                if mode == "joins":
                    fits &= now[z] != now[i]
                z, total, need = z[fits], total[fits], need[fits]
                if len(z):
                    fits = total - 2 * need >= np.bitwise_count(bits[i] ^ bits[z]).sum(axis=1, dtype=np.int64)
                    z, need = z[fits], need[fits]
                if not len(z):
                    continue
                marked[sets[i]] = True
                starts = np.cumsum(n[z]) - n[z]
                both = np.add.reduceat(marked[np.concatenate([sets[j] for j in z])], starts, dtype=np.int64)
                marked[sets[i]] = False
                z = z[both >= need]
                links[i] += weight[z].sum()
                links[z] += weight[i]
                for j in z if mode == "pairs" else z[now[z] != now[i]]:
                    if mode != "pairs":
                        if now[j] == now[i]:
                            continue
                        now[now == now[j]] = now[i]
                    out_a.append(min(name[i], name[j]))
                    out_b.append(max(name[i], name[j]))
                    out_links.append(0)
            if mode == "links":
                found = np.flatnonzero(links)
                out_a += name[found].tolist()
                out_b += [None] * len(found)
                out_links += links[found].tolist()
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64()), "links": pa.array(out_links, pa.int64())})

    placed = dealt.withColumn("bucket", F.pmod(F.xxhash64("family", "s1", "s2"), F.lit(buckets)).cast("int"))
    return placed.groupBy("bucket").applyInArrow(compare, "a long, b long, links long")


def _cross_pairs(candidates: DataFrame, families: DataFrame, threshold: int) -> DataFrame:
    """Pairs (hub, class) of classes of different families that bitmaps allow and that share as many keys as linked sets of their sizes do at least, each once.

    Where bitmaps rule a pair out some of its common keys are not counted, but a linked pair is never ruled out.
    """
    rooted = candidates.select("key", "class").join(families.select("class", "n", F.col("family").alias("root")), "class")
    # keys that the same classes have find the same pairs: of these the smallest stands for all
    same = [F.count("*"), F.bit_xor(F.xxhash64("class")), F.bit_xor(F.xxhash64("class", F.lit(1)))]
    shared = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("class").alias("first"), *[x.alias(f"by_{i}") for i, x in enumerate(same)])
    several = shared.filter("lo != hi").groupBy("first", *[f"by_{i}" for i in range(len(same))]).agg(
        F.min("key").alias("key"), F.count("*").alias("weight")).select("key", "weight", F.col("by_0").alias("c"))
    apart = store(rooted.join(several, "key"), "shingle-open")
    met = _plain_pairs(apart.filter(F.col("c") <= FEW), threshold).union(_tile_pairs(apart.filter(F.col("c") > FEW), families, threshold))
    enough = met.groupBy("hub", "class", "needed").agg(F.sum("shared").alias("shared")).filter("shared >= needed").select("hub", "class")
    pairs = store(_allowed(enough, families, threshold), "shingle-pairs")
    free(apart)
    return pairs


@dataclass(frozen=True)
class Joined:
    """Rows with their class, classes with their size, component of each class, the sets, links in tiles and across families."""

    rows: DataFrame
    classes: DataFrame
    known: DataFrame
    members: DataFrame
    inside: DataFrame
    cross: DataFrame


def _join(docs: DataFrame, width: int, threshold: int, links: bool) -> Joined:
    keyed = store(shingle_classes(docs, width, threshold), "shingle-rows")
    rows = store(keyed.drop("keys", "bitmap"), "shingle-classes")
    sets = store(keyed.filter(F.col("class").isNotNull()).groupBy("class").agg(
        F.first("n").alias("n"), F.first("keys").alias("keys"), F.count("*").alias("size"), F.min(F.struct("doc_id", "row_key")).alias("rep"), F.min("doc_id").alias("least"),
        F.first("bitmap").alias("bitmap")), "shingle-sets")
    free(keyed)
    classes = store(sets.drop("keys"), "shingle-sizes")
    each = sets.select(F.explode("keys").alias("key"), "class")
    met = store(each.groupBy("key").agg(F.min("class").alias("hub"), F.count("*").alias("c")).filter("c > 1").select("key", "hub"), "shingle-keys")
    candidates = store(each.join(met, "key"), "shingle-candidates")
    free(sets, met)
    families = _families(candidates, classes.select("class", "n", "size", "rep", "bitmap"))
    pairs = _cross_pairs(candidates, families, threshold)
    possible = _possible(families, threshold).union(pairs.select("class")).union(pairs.select("hub")).distinct()
    wanted = store(families.join(possible, "class").select("rep.doc_id", "rep.row_key", F.struct("class", "n", "size", "family", "c", "salts", "salt").alias("kept")), "shingle-wanted")
    members = store(_members(docs, wanted, width), "shingle-members")
    inside = store(_family_tiles(members, threshold, "links" if links else "joins"), "shingle-inside")
    cross = store(_star_edges(pairs, members, threshold), "shingle-cross")
    joins = inside.filter("b is not null").select("a", "b")
    nodes = connected(joins.union(cross)).select(F.col("node").alias("class"), "root")
    of_class = classes.select("class", "least").join(nodes, "class", "left").select("class", "least", F.coalesce("root", "class").alias("root"))
    of_root = of_class.groupBy("root").agg(F.min("least").alias("component"))
    known = store(of_class.join(of_root, "root").select("class", "component"), "shingle-components")
    free(candidates, families, pairs, wanted)
    return Joined(rows, classes, known, members, inside, cross)


def _grouped(rows: DataFrame, known: DataFrame) -> DataFrame:
    return rows.join(known, "class", "left").select(
        "doc_id", "row_key", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), "class")


def jaccard_groups(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, row_key, n_shingles, component_id for every row."""
    found = _join(docs, width, threshold, links=False)
    free(found.members, found.inside, found.cross)
    return _grouped(found.rows, found.known).drop("class")


def jaccard_links(docs: DataFrame, width: int = 5, threshold: int = 80) -> tuple[DataFrame, DataFrame]:
    """The join itself: every linked pair (a, b) of classes with a < b, and the membership: doc_id, row_key, n_shingles, component_id, class, n_links for every row.

    Rows of one class are linked with each other and with all rows of the classes theirs is paired with; n_links counts the other rows linked with a row.
    The pairs, whose number may grow with the square of a family, are worked out only where they are used; the membership doesn't need them.
    """
    found = _join(docs, width, threshold, links=True)
    both = found.cross.select("a", "b").union(found.cross.select("b", "a")).toDF("class", "other")
    across = both.join(found.classes.select(F.col("class").alias("other"), "size"), "other").select("class", F.col("size").alias("links"))
    inside = found.inside.filter("b is null").select(F.col("a").alias("class"), "links")
    linked = inside.union(across).groupBy("class").agg(F.sum("links").alias("links"))
    links = store(found.classes.join(linked, "class", "left").select("class", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "shingle-n-links")
    pairs = _family_tiles(found.members, threshold, "pairs").select("a", "b").union(found.cross)
    return pairs, _grouped(found.rows, found.known).join(links, "class", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))


def drop_near_copies(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """One document of each group, the one with the smallest id; documents without words stay. Columns as given.

    Of rows that repeat the kept id one stays. Rows that share no link stay even if a null id is all they have.
    """
    groups = jaccard_groups(docs, width, threshold)
    kept = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")).distinct()
    key = f"_key_{len(docs.columns)}"
    once = docs.withColumn(key, row_key()).dropDuplicates(["doc_id", key])
    # by plain equality texts need no second shuffle; null ids meet by the key alone
    known = once.join(kept, (once["doc_id"] == kept["_id"]) & (once[key] == kept["_key"]), "left_semi")
    unknown = once.filter("doc_id is null").join(kept.filter("_id is null"), once[key] == kept["_key"], "left_semi")
    return known.union(unknown).select(*docs.columns)
