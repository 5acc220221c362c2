"""What must not grow faster than the input: joins that change with its size, rows that carry sets, keys that say the same, batches of long texts."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqpulse.llm import byte_dedup, common, hyperminhash, mixing, ngram_join, word_dedup
from tests.llm import brute


def _text(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))


@pytest.mark.parametrize("remove", [word_dedup.remove_repeats, byte_dedup.remove_repeats])
def test_ranges_and_texts_meet_by_one_plan(spark, remove):
    rng = random.Random(1)
    same = _text(rng, 40)
    docs = spark.createDataFrame([(i, f"{_text(rng, 20)} {same}") for i in range(6)], "doc_id long, text string")
    plan = remove(docs)._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("remove", [word_dedup.remove_repeats, byte_dedup.remove_repeats])
def test_texts_that_are_all_shorter_than_a_window(spark, remove):
    docs = spark.createDataFrame([(i, "a b c d e f g") for i in range(20)], "doc_id long, text string").coalesce(1)
    assert {r["n_removed"] for r in remove(docs).collect()} == {0}


def test_both_texts_of_an_id_lose_a_passage(spark):
    """The two texts of id 10 have it at different places, and an id of another task has it first."""
    rng = random.Random(2)
    same = _text(rng, 60)
    ten = [(10, f"{_text(rng, 30)} {same}"), (10, f"{_text(rng, 50)} {same}")]
    docs = spark.createDataFrame([(5, same)], "doc_id long, text string").coalesce(1).union(spark.createDataFrame(ten, "doc_id long, text string").coalesce(1))
    size = len(same)
    assert sorted((r["doc_id"], r["n_removed"] >= size) for r in byte_dedup.remove_repeats(docs).collect()) == [(5, False), (10, True), (10, True)]


@pytest.mark.parametrize("parse", [word_dedup.word_parse(), byte_dedup.byte_parse()])
def test_a_key_follows_from_the_window_alone(parse):
    """So windows that are cut out of their texts get the keys they have there."""
    from seqpulse.llm import repeats

    rng = random.Random(3)
    tokens = parse.tokens([_text(rng, rng.randint(0, 400)) + "aaaa " * rng.randint(0, 30) for _ in range(20)])
    h, row = np.concatenate(tokens), np.repeat(np.arange(20), [len(t) for t in tokens])
    valid = np.flatnonzero(row[: len(h) - parse.width + 1] == row[parse.width - 1 :])
    some = valid[np.sort(np.random.default_rng(3).choice(len(valid), len(valid) // 8, replace=False))]
    at, piece, place = repeats.cut_out(some, parse.width)
    assert len(at) < len(h)
    assert (parse.keys(h[at], row[at] + piece)[place] == parse.keys(h, row)[some]).all()


def test_stable_order():
    from seqpulse.llm import repeats

    rng = np.random.default_rng(4)
    for x in (rng.integers(0, 1 << 64, 3000, np.uint64), rng.integers(0, 50, 3000).astype(np.uint64), rng.integers(0, 50, 3000).astype(np.uint64) << np.uint64(40), np.zeros(0, np.uint64)):
        assert (repeats.stable_order(x) == np.argsort(x, kind="stable")).all()


def test_only_rows_with_a_partner_get_their_sets(spark, monkeypatch):
    """Rows are passed by registers before they get sets, and links are those of the whole sets."""
    rng = random.Random(5)
    base = [_text(rng, 120).split() for _ in range(12)]
    rows = [(100 * k + j, " ".join(words[:60 + 5 * j])) for k, words in enumerate(base) for j in range(6)]
    stored = {}

    def kept(df, name):
        stored[name] = common.store(df, name)
        return stored[name]

    monkeypatch.setattr(hyperminhash, "store", kept)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes = kept(hyperminhash.sketches(docs, 1).withColumn("rep", F.struct("doc_id", "row_key")), "classes")
    members = hyperminhash._members(docs, classes, classes.select("class"), 1)
    candidates = kept(hyperminhash._keyed(classes).withColumn("root", F.col("class")), "candidates")
    links = hyperminhash._tile_links(candidates, classes, members, 80)
    of = {r["class"]: r["doc_id"] for r in classes.collect()}
    group = {d: d for d in of.values()}
    for r in links.collect():
        p, q = sorted((group[of[r["a"]]], group[of[r["b"]]]))
        group = {d: p if g == q else g for d, g in group.items()}
    assert group == {d: c for d, (_, c) in brute.jaccard(rows, 1, 80).items()}
    left = stored["hmh-possible"]
    assert not {"members", "registers"} & set(left.columns) and 0 < left.count() < candidates.count()


def test_keys_of_the_same_classes_find_a_pair_once(spark, monkeypatch):
    stored = {}

    def kept(df, name):
        stored[name] = out = common.store(df, name)
        stored[name, "n"] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "store", kept)
    candidates = spark.createDataFrame([(k, c, 1) for k in range(50) for c in ((1, 2) if k < 40 else (1, 2, 3))], "key long, class long, hub long")
    bits = np.zeros(ngram_join.BITMAP_BITS // 8, np.uint8).tobytes()
    families = spark.createDataFrame([(c, 100, bytearray(bits), f) for c, f in ((1, 1), (2, 9), (3, 1))], "class long, n long, bitmap binary, family long")
    pairs = ngram_join._cross_pairs(candidates, families, 90)
    assert sorted((r["hub"], r["class"]) for r in pairs.collect()) == [(1, 2), (2, 3)]
    assert stored["shingle-open", "n"] == 5


def test_large_sets_that_share_a_few_keys_are_not_paired(spark):
    """Their bitmaps allow a link, but linked sets of 6,000 have 535 common keys at least; keys of few classes and of many count alike."""
    rng = np.random.default_rng(8)
    pool = rng.integers(0, 1 << 64, (24, 6000), np.uint64)
    pool[1, :5500] = pool[0, :5500]
    bits = [x.tobytes() for x in ngram_join._bitmaps([*pool])]
    families = spark.createDataFrame([(c, 6000, bytearray(bits[c]), 100 + c) for c in range(24)], "class long, n long, bitmap binary, family long")
    keys = [(a, b) for a in range(24) for b in range(a)] + [range(24)] * 3 + [(0, 1, 2 + k % 22) for k in range(300)] + [(0, 1)] * 100 + [(0, 1, *range(2 + k % 5, 24)) for k in range(140)]
    candidates = spark.createDataFrame([(k, c, min(x)) for k, x in enumerate(keys) for c in x], "key long, class long, hub long")
    assert [(r["hub"], r["class"]) for r in ngram_join._cross_pairs(candidates, families, 80).collect()] == [(0, 1)]


def test_linked_sets_share_the_fewest_keys():
    """However the members are ordered, two sets that reach the threshold share least_shared of their first ones; fewer would leave out links."""
    rng = np.random.default_rng(9)
    tight = 0
    for _ in range(4000):
        threshold, both = int(rng.choice([50, 80, 90])), int(rng.integers(1, 60))
        m, n = both + int(rng.integers(0, 8)), both + int(rng.integers(0, 8))
        if 100 * both < threshold * (m + n - both):
            continue
        order = rng.permutation(m + n - both)
        sets = [np.sort(x) for x in (order[:m], np.concatenate([order[:both], order[m:]]))]
        shared = len(np.intersect1d(*[x[: len(x) - ngram_join.least_overlap(len(x), threshold) + 1] for x in sets]))
        least = ngram_join.least_shared(m + n, max(m, n), threshold)
        assert shared >= least >= 1
        tight += shared == least
    assert tight > 20


@pytest.mark.parametrize("few", [0, 3, 1000])
def test_keys_of_few_and_of_many_classes_find_the_same_links(spark, monkeypatch, few):
    monkeypatch.setattr(ngram_join, "FEW", few)
    rng = random.Random(10)
    words = _text(rng, 400).split()
    rows = []
    for k in range(90):
        a = rng.randint(0, 300)
        rows.append((k, " ".join(w if rng.random() > 0.02 else "other" for w in words[a : a + rng.randint(3, 90)])))
    pairs, found = ngram_join.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string"), 2, 70)
    got = {r["doc_id"]: r for r in found.collect()}
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == brute.jaccard(rows, 2, 70)
    sets = {d: set(zip(x.split(), x.split()[1:])) for d, x in rows}
    linked = {(min(got[a]["class"], got[b]["class"]), max(got[a]["class"], got[b]["class"])) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 70 * len(sets[a] | sets[b]) and got[a]["class"] != got[b]["class"]}
    assert linked and sorted((r["a"], r["b"]) for r in pairs.collect()) == sorted(linked)


def test_bitmaps_of_large_sets_rule_out(spark):
    """Sets of thousands of members without a common one are told apart; no more slots differ than members."""
    rng = np.random.default_rng(6)
    for n in (50, 4000, 8000):
        pool = np.unique(rng.integers(0, 1 << 64, 2 * n, np.uint64))
        for shift in (1, n // 20, n // 2, n - 1):
            a, b = pool[:n], pool[shift : shift + n]
            differ = int(np.bitwise_count(np.bitwise_xor(*ngram_join._bitmaps([a, b]))).sum())
            assert differ <= len(np.setxor1d(a, b))
        assert differ > 2 * n - 2 * ngram_join._least_both(2 * n, 90)


def test_batches_of_long_texts_are_bounded(spark):
    docs = spark.range(9000, numPartitions=1).select(F.repeat(F.lit("x"), 2000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["size"])

    found = [r["size"] for r in common.store(docs.mapInArrow(sizes, "size long"), "sizes").collect()]
    assert sum(found) > 9000 * 2000 and max(found) < 2 * common.BATCH_BYTES
    assert spark.conf.get(common.BATCH, None) is None


def test_texts_of_a_mix_pass_one_python_worker(spark):
    """Posteriors and rates of the rows handed on are found by one function; what it holds follows a piece of the texts."""
    import tracemalloc

    rows = [(i, f"le la des {i} " * 5 if i % 2 else f"the of and {i} " * 5, "fr" if i % 2 else "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, quality int")
    mixed = mixing.mix_documents(docs, labels)
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    rates = {r["doc_id"]: r["rate"] for r in mixing.mixing_rates(docs, labels, keep=["doc_id"]).collect()}
    assert {r["doc_id"]: pytest.approx(r["rate"]) for r in mixing.mixing_rates(docs, labels).collect()} == rates

    class Frame:
        schema, sparkSession = docs.schema, spark  # noqa: N815

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return run

    batch = pa.record_batch({"doc_id": pa.array(range(6000)), "text": [" ".join(f"w{i}" for i in range(200))] * 6000})
    domains = mixing.Domains(["a", "b"], np.log([0.5, 0.5]), np.zeros((1 << 16, 2)))
    run = mixing.posteriors(Frame(), domains, mixing.Mix(), ["doc_id"])
    tracemalloc.start()
    n = sum(b.num_rows for b in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 6000 and peak < 60 << 20
