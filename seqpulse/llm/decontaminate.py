r"""Benchmark decontamination with DataFrame functions only.

Benchmark items are cut into windows of `n` words (an item of fewer words is one window). The windows form a hash set
that is broadcast when its measured size is below a bound, and is shuffled like any other table beyond it. Windows are
looked up by two rare words and compared as whole strings, so that every hit is exact.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased. A null or empty text has no words and no hits. A row
holds the words of a text, never its windows. Rows are told apart by doc_id and text: repeated rows each get the same
result, rows of one doc_id with other texts their own. Only doc_id and text (item_id and text) are read; other columns of either table, whatever their names, play no part. An empty
table gives an empty result, an empty benchmark hits nothing, an item with a null id counts as the item "".
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from seqpulse.llm.common import BROADCAST_BYTES, row_key, store

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CASED_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PIECE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, GAP), "")


def _cut(w: Column, at: Column, length: Column, n: int) -> Column:
    """`length` (at most n) words from `at` on, joined by one space; fewer where the text ends or begins in between."""
    return F.concat_ws(" ", *[F.when(F.lit(j) < length, F.get(w, at + j)) for j in range(n)])


def _lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def benchmark_windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Columns window, n_window (its words), items (sorted distinct item ids as strings)."""
    w = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w"))
    short = w.filter(F.size("w").between(1, n - 1)).select(
        "item", F.array_join("w", " ").alias("window"), F.size("w").alias("n_window"))
    each = w.select("item", "w", F.posexplode("w").alias("at", "word")).filter(F.col("at") + n <= F.size("w"))
    full = each.select("item", _cut(F.col("w"), F.col("at"), F.lit(n), n).alias("window"), F.lit(n).alias("n_window"))
    return full.union(short).groupBy("window", "n_window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _anchored(windows: DataFrame) -> DataFrame:
    """Each window with its anchor, the two consecutive words it is looked up by (its word, if it has one only), and their place in it.

    The pair is the one that the fewest windows hold, and of these the longest: what opens every item is no anchor.
    """
    w = windows.select("window", F.split("window", " ").alias("w")).select("window", "w", F.posexplode("w").alias("offset", "word"))
    pairs = w.filter((F.col("offset") + 1 < F.size("w")) | (F.size("w") == 1)).select(
        "window", "offset", F.lower(F.concat_ws(" ", "word", F.get("w", F.col("offset") + 1))).alias("anchor"))
    shared = pairs.groupBy("anchor").agg(F.count_distinct("window").alias("shared"))
    best = pairs.join(shared, "anchor").groupBy("window").agg(
        F.min(F.struct("shared", (-F.length("anchor")).alias("shortness"), "offset", "anchor")).alias("best"))
    return windows.join(best, "window").select("window", "n_window", "items", "best.anchor", "best.offset")


def _known(benchmark: DataFrame, n: int) -> tuple[DataFrame, list[int], bool]:
    """The stored windows with their anchors, the lengths among them, and whether their measured size allows a broadcast."""
    known = store(_anchored(benchmark_windows(benchmark, n)), "benchmark-windows")
    size = known.agg(
        F.sum(F.octet_length("window") + F.octet_length("anchor") + F.octet_length(F.array_join("items", "")) + 16 * F.size("items") + 64).alias("bytes"),
        F.collect_set("n_window").alias("lengths")).first()
    return known, sorted(size["lengths"]), (size["bytes"] or 0) <= BROADCAST_BYTES


def _hits(docs: DataFrame, known: DataFrame, lengths: list[int], small: bool, n: int) -> DataFrame:
    """One row per occurrence of a window.

    With a broadcast each two consecutive words ask for the windows they are the anchor of, and the words around them are
    compared with these on the spot: a text is read once and stays where it is, and only true hits leave the task. Anchors meet
    in Unicode lower case, which is coarser than the exact comparison that follows. Beyond the bound of the broadcast the
    windows of the documents are shuffled to those of the benchmark.
    """
    w = F.array_remove(F.split(F.coalesce("text", F.lit("")), CASED_GAP), "")
    # outer: an inner one would add a filter on the size of w, which splits each text once more
    each = docs.select("doc_id", row_key().alias("row_key"), w.alias("w")).select("doc_id", "row_key", "w", F.posexplode_outer("w").alias("place", "word"))
    found = []
    if small:
        for anchor_words in {min(k, 2) for k in lengths or [n]}:
            windows = known.filter(F.least("n_window", F.lit(2)) == anchor_words)
            anchor = F.lower(_cut(F.col("w"), F.col("place"), F.lit(anchor_words), anchor_words))
            at = F.col("place") - F.col("offset")
            exact = _lowered(_cut(F.col("w"), at, F.col("n_window"), n)) == F.col("window")
            met = each.join(F.broadcast(windows), (anchor == F.col("anchor")) & exact)
            found.append(met.select("doc_id", "row_key", at.alias("at"), "n_window", "items"))
    else:
        for k in lengths:
            window = _lowered(_cut(F.col("w"), F.col("place"), F.lit(k), k))
            grams = each.filter(F.col("place") + k <= F.size("w")).select("doc_id", "row_key", F.col("place").alias("at"), window.alias("window"))
            found.append(grams.join(known.filter(F.col("n_window") == k).drop("anchor", "offset"), "window").drop("window"))
    return reduce(DataFrame.union, found)


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Columns doc_id, row_key, at (first word), n_window, items: one row per occurrence of a benchmark window."""
    return _hits(docs, *_known(benchmark, n), n)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Per row: doc_id, row_key, n_words, n_hit, n_items, items_sha256, contaminated."""
    hits = find_hits(docs, benchmark, n)
    pieces = F.split(F.coalesce("text", F.lit("")), CASED_GAP)
    n_words = F.size(pieces) - (F.get(pieces, F.lit(0)) == "").cast("int") - ((F.size(pieces) > 1) & (F.element_at(pieces, -1) == "")).cast("int")
    scanned = docs.select("doc_id", row_key().alias("row_key"), n_words.alias("n_words"))
    keys = ["doc_id", "row_key"]
    # one row per hit word and one per hit item, told apart by kind, so that both counts take one pass
    marks = hits.select(*keys, F.explode(F.concat(
        F.transform(F.sequence(F.col("at"), F.col("at") + F.col("n_window") - 1), lambda i: F.struct(i.alias("word"), F.lit(None).cast("string").alias("item"))),
        F.transform("items", lambda x: F.struct(F.lit(None).cast("int").alias("word"), x.alias("item"))))).alias("m")).distinct()
    per_row = marks.groupBy(*keys).agg(
        F.count("m.word").alias("n_hit"), F.count("m.item").alias("n_items"),
        F.array_join(F.sort_array(F.collect_list("m.item")), ",").alias("ids"))
    hit = per_row.select(F.col("doc_id").alias("hit_id"), F.col("row_key").alias("hit_key"), "n_hit", "n_items", "ids")
    joined = scanned.join(hit, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("row_key") == F.col("hit_key")), "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return joined.select(
        "doc_id", "row_key", "n_words", count("n_hit").alias("n_hit"), count("n_items").alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (count("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, mode: str = "documents") -> DataFrame:
    """Documents without benchmark text, with the columns they came with.

    `documents` drops every document that holds a window; `spans` keeps all documents and takes the words that windows
    cover out of the text, each with the separators after it.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"unknown mode {mode!r}")
    hits = find_hits(docs, benchmark, n)
    key = f"_key_{len(docs.columns)}"
    keyed = docs.withColumn(key, row_key())
    if mode == "documents":
        hit = hits.select(F.col("doc_id").alias("_hit_id"), F.col("row_key").alias("_hit_key")).distinct()
        same = keyed["doc_id"].eqNullSafe(hit["_hit_id"]) & (keyed[key] == hit["_hit_key"])
        return keyed.join(hit, same, "left_anti").drop(key)
    gone = hits.select(
        F.col("doc_id").alias("_hit_id"), F.col("row_key").alias("_hit_key"),
        F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n_window") - 1)).alias("word")).distinct()
    gone = gone.groupBy("_hit_id", "_hit_key").agg(F.map_from_arrays(F.collect_list("word"), F.collect_list(F.lit(True))).alias("_gone"))
    same = keyed["doc_id"].eqNullSafe(gone["_hit_id"]) & (keyed[key] == gone["_hit_key"])
    pieces = F.regexp_extract_all("text", F.lit(PIECE), F.lit(0))
    left = F.array_join(F.filter(pieces, lambda p, i: ~F.coalesce(F.map_contains_key("_gone", i), F.lit(False))), "")
    cut = keyed.join(gone, same, "left").withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(left))
    return cut.select(*docs.columns)
