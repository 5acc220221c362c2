"""Importance resampling, hard negatives and HyperMinHash against brute force, and on odd and empty input."""

import hashlib
import math
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from seqpulse.llm import hard_negatives, hyperminhash, importance
from seqpulse.llm import queries as q
from tests.llm import brute

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
ODD = [
    (1, "a b c d e f g h i j k l m n o p q r s t u"), (2, "a b c d e f g h i j k l m n o p q r s t v"), (3, None), (4, ""), (5, " \n\t "), (6, "same " * 40), (7, "X"), (8, LONG),
    (9, LONG + " end"), (None, "a b c d e f g h i j k l m n o p q r s t u"), (None, None), (10, "a b c d e f g h i j k l m n o p q r s t u"),
    (10, "a b c d e f g h i j k l m n o p q r s t u"), (11, "ÄÖ-<|im_end|>\\ñ 漢字 🙂 A1b2"), (12, "x" * 3000 + " y"),
]
CLASH = "lang string, row_key string, weight string, score string, rank string, buckets string, counts string, part string, tie string, n string, class string, registers string, kept string, text_ string"


@pytest.fixture(scope="module")
def odd(spark):
    n = CLASH.count(" string")
    return spark.createDataFrame([(*r, *["k"] * n) for r in ODD], f"doc_id long, text string, {CLASH}")


@pytest.fixture(scope="module")
def texts(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# importance resampling ---------------------------------------------------------------------------

def grams(text):
    w = (text or "").encode().translate(importance.NORMAL).split()
    return len(w), [b" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def resampled(rows, target, percent=5):
    """(id, features, weight, score, rank) of each row, by the formula."""
    bucket = lambda g: zlib.crc32(g) % 10_000
    s, t = Counter(bucket(g) for _, x in rows for g in grams(x)[1]), Counter(bucket(g) for x in target for g in grams(x)[1])
    n, m = sum(s.values()), sum(t.values())
    out = []
    for d, x in rows:
        n_words, gs = grams(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (n + 10_000) / ((s[b] + 1) * (m + 10_000)))) for b in map(bucket, gs))
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(gs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def as_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_crcs_of_runs_come_from_prefixes():
    """Every run's CRC, without reading it: short and very long words, several widths, texts without words."""
    shifter = importance.Shifter()
    some = ["one two three four", None, "", "a", "ä" * 70_000 + " b " + "c" * 300, "UPPER lower-Mixed 12"]
    for widest in (1, 3, 5):
        crcs, n_words, n_features = importance.feature_crcs([None if t is None else t.encode() for t in some], shifter, widest)
        cut = np.concatenate([[0], np.cumsum(n_features)])
        for i, t in enumerate(some):
            w = (t or "").encode().translate(importance.NORMAL).split()
            want = Counter(zlib.crc32(b" ".join(w[j : j + k])) for k in range(1, widest + 1) for j in range(len(w) - k + 1))
            assert Counter(crcs[cut[i] : cut[i + 1]].tolist()) == want and n_words[i] == len(w)


def test_shift_is_appending_zero_bytes():
    """For any prefix and piece: crc(both) xor shift(crc(prefix)) is the piece's CRC."""
    shifter = importance.Shifter()
    for n in (0, 1, 255, 256, 257, 65_536, 1_000_003):
        a, b = b"prefix %d" % n, bytes(range(256)) * (n // 256) + bytes(n % 256)
        moved = shifter.shift(np.array([zlib.crc32(a)], np.uint32), np.array([n]))
        assert int(moved[0]) ^ zlib.crc32(a + b) == zlib.crc32(b)


def test_resampling_against_the_formula(spark, texts):
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert as_rows(q.op11_importance_resampling(spark, SF)) == resampled(texts, target)


def test_resampling_of_odd_rows(spark, odd):
    target = ["a b c d same words", None, ""]
    wanted = spark.createDataFrame([(x, "u") for x in target], "text string, doc_id string")
    assert as_rows(importance.resample(odd, wanted, percent=60)) == resampled(ODD, target, 60)
    drawn = importance.draw(odd, wanted, percent=100)
    assert drawn.columns == odd.columns and drawn.count() == 7  # of the two equal rows one comes out
    # an empty target, an empty corpus
    assert as_rows(importance.resample(odd, wanted.filter("false"), percent=60)) == resampled(ODD, [], 60)
    assert importance.resample(odd.filter("false"), wanted).count() == 0 and importance.draw(odd.filter("false"), wanted).count() == 0


def test_ranks_over_many_ranges_with_ties(spark):
    """A third of all rows equal in everything, ranks without gaps, whatever the partitions."""
    rows = [(i, "w " * 25) for i in range(200)] + [(7, "w " * 25)] * 100
    got = as_rows(importance.resample(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), spark.createDataFrame([("w",)], "text string"), percent=50))
    assert got == resampled(rows, ["w"], 50)


# hard negatives ----------------------------------------------------------------------------------

def mined(rows, k=5, n=10):
    usable = [(i, (l + 1) % 10 if i % 7 == 0 else l, np.floor(256 * np.array(v, np.float64)).astype(object)) for i, v, l in rows
              if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, la, va in usable:
        if a % 100 == 0:
            scored = sorted((-int(va @ v), i, l) for i, l, v in usable if i != a and len(v) == len(va))
            for ps, p, _ in [x for x in scored if x[2] == la][:k]:
                fit = [(s, i) for s, i, l in scored if l != la and 30 * -ps <= 100 * -s <= 90 * -ps][:n]
                out += [(a, p, r + 1, i, -ps, -s) for r, (s, i) in enumerate(fit)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, id string, block string")


def random_rows(n, d, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(10, d))
    return [(i, [float(np.float32(x)) for x in centre[i % 10] * spread + rng.normal(size=d)], int(rng.integers(10)) if i % 3 else i % 10) for i in range(n)]


@pytest.mark.parametrize("d, spread", [(1, 1.0), (3, 2.0), (24, 0.7)])
def test_hard_negatives_against_brute_force(spark, d, spread, monkeypatch):
    """Also over several blocks and slices."""
    rows = random_rows(600, d, d, spread)
    want = mined(rows)
    assert want and sorted(map(tuple, hard_negatives.mine(vectors(spark, rows)).collect())) == want
    monkeypatch.setattr(hard_negatives, "BLOCK", (100, 100))
    monkeypatch.setattr(hard_negatives, "SLICE", (2, 2))
    assert sorted(map(tuple, hard_negatives.mine(vectors(spark, rows)).collect())) == want


def test_odd_vectors(spark):
    """Nulls, non-finite components, zero anchors, one vector in a third of all rows, repeated rows, mixed lengths, negative ids."""
    rows = random_rows(60, 4, 5) + [(100 + i, [0.5, 0.25, -0.5, 1.0], i % 4) for i in range(40)] + [(200, [0.0] * 4, 1), (300, [1.0, 2.0], 1), (303, [1.0, 2.0], 1), (304, [0.5, 1.0], 2), (-100, [0.5, 0.2, -0.1, 1.0], 3)]
    bad = [(None, [1.0] * 4, 1), (400, None, 1), (401, [1.0] * 4, None), (500, [1.0, None, 1.0, 1.0], 1), (501, [float("nan")] * 4, 2), (502, [float("inf"), 1.0, 1.0, 1.0], 2), (600, [], 1)]
    got = sorted(map(tuple, hard_negatives.mine(vectors(spark, rows + bad + rows[:70])).collect()))
    assert got == mined(rows) and {r[0] for r in got} >= {0, 100, 300}
    assert hard_negatives.mine(vectors(spark, rows).filter("false")).count() == 0
    assert hard_negatives.mine(vectors(spark, bad)).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(i * 25, [float(np.float32(2.0**17 + 3 * i)), float(2.0**15 * (i % 5))], i % 2) for i in range(60)]
    assert sorted(map(tuple, hard_negatives.mine(vectors(spark, rows)).collect())) == mined(rows)
    with pytest.raises(Exception, match="do not fit a long"):
        hard_negatives.mine(vectors(spark, [(i, [3e30, 1.0], 1) for i in range(0, 300, 50)])).collect()


def test_a_walk_stops_early():
    """Where one component decides, few rows are met; the end comes only once the threshold is strictly below the k-th score."""
    n = 5000
    data = np.zeros((n, 3))
    data[:, 0] = np.arange(n)
    lists, met = hard_negatives.Lists(np.arange(n), data), 0
    anchor = np.array([2.0, 0.0, 0.0])
    for rows, scores, bound in lists.walk(anchor):
        met += len(rows)
        if bound < np.sort(scores)[-5]:
            break
    assert met == hard_negatives.FIRST
    (ids, _), = hard_negatives.search(hard_negatives.Lists(np.arange(n)[::-1].copy(), np.ones((n, 3))), anchor, [(-np.inf, np.inf)], 4, lambda r: np.zeros(len(r), bool))
    assert ids.tolist() == [0, 1, 2, 3]


# HyperMinHash ------------------------------------------------------------------------------------

def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("width, threshold", [(2, 80), (5, 80), (1, 90)])
def test_near_copies_against_brute_force(spark, texts, width, threshold):
    got = by_id(hyperminhash.near_copies(spark.createDataFrame(texts, "doc_id long, text string"), width, threshold))
    want = brute.jaccard(texts, width, threshold)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert {d for d, r in got.items() if r["kept"]} == {d for d, (_, c) in want.items() if d == c}


def test_chains_families_and_tiny_sets(spark, monkeypatch):
    """A chain whose ends are not linked, a family around 0.8, sets of one to ten members; also in tiles of two rows."""
    words = [f"t{i}" for i in range(90)]
    rows = [(k, " ".join(words[2 * k : 2 * k + 30])) for k in range(20)]
    rows += [(100 + k, " ".join([*words[:40], *(f"u{k}-{j}" for j in range(k % 9))])) for k in range(40)]
    rows += [(200 + k, " ".join(f"v{j}" for j in range(k % 11 + 1))) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.jaccard(rows, 1, 80)
    for tile in (2000, 2):
        monkeypatch.setattr(hyperminhash, "TILE", tile)
        assert {d: (r["n_shingles"], r["component_id"]) for d, r in by_id(hyperminhash.near_copies(docs, 1, 80)).items()} == want


def test_estimates_are_near_the_similarity():
    """Also for small sets, whose empty registers are borrowed; disjoint sets are estimated at 0."""
    rng, borrow = np.random.default_rng(3), hyperminhash.donors()
    for n in (6, 40, 300, 20_000):
        for share in (0.0, 0.5, 0.9):
            pool = rng.integers(0, 1 << 64, 2 * n, np.uint64)
            both = int(n * share)
            a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:both], pool[n : 2 * n - both]]))
            true = both / (2 * n - both)
            r = hyperminhash.registers([a, b], borrow)
            guess = hyperminhash.estimate(np.array([(r[0] == r[1]).sum()]), hyperminhash.levels(np.array([n])), hyperminhash.levels(np.array([n])))[0]
            assert abs(guess - true) <= 6 * max(true * (1 - true) / min(n, 256), 1e-4) ** 0.5


def test_register_of_equal_minima(texts):
    """A register depends on a bucket's smallest hash alone; sets without members stay empty."""
    borrow = hyperminhash.donors()
    low, high = np.array([5, 1 << 60], np.uint64), np.array([5, 9, 1 << 60], np.uint64)
    r = hyperminhash.registers([low, high, np.zeros(0, np.uint64)], borrow)
    assert (r[0] == r[1]).all() and (r[2] == hyperminhash.EMPTY).all()


def test_near_copies_of_odd_rows(spark, odd):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in hyperminhash.near_copies(odd, 2, 80).collect()]
    assert len(got) == len(ODD)
    want = {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 8, 10: 1, 11: 11, 12: 12}
    assert all(c == want[d] and k == (d == c) for d, _, c, k in got if d is not None)
    # a null id with copies belongs to their component, one without words to none
    assert sorted(repr((n, c, k)) for d, n, c, k in got if d is None) == sorted(repr(x) for x in ((20, 1, False), (0, None, True)))
    kept = hyperminhash.drop_near_copies(odd, 2, 80)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 3, 4, 5, 6, 7, 8, 11, 12, None]))
    assert hyperminhash.near_copies(odd.filter("false"), 2, 80).count() == 0 and hyperminhash.drop_near_copies(odd.filter("false")).count() == 0


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_hard_negatives", "op13_minhash_near_dedup"])
def test_registered_with_sql(spark, name):
    assert name in q.QUERIES and name in q.SQL
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    cur = con.execute(q.SQL[name])
    assert sorted(c[0] for c in cur.description) == sorted(q.QUERIES[name](spark, SF).columns)


# tokens --------------------------------------------------------------------------------------------

@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_any_tokenizer_are_those_of_whole_texts(name, texts, monkeypatch):
    """One tokenizer drops spaces, the other does not; also when remembered words are given up at each chunk."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from seqpulse.llm import token_file

    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    some = [None, "", " ", "the quick  brown fox", " a  b ", "x\n y\t z", "don't  stop", "ÄÖ <|im_end|> \\ ñ 漢字 🙂", *(t for _, t in texts[:40])]
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in some]
    assert [x.tolist() for x in token_file.Encoder(path).encode_all(some)] == want
    monkeypatch.setattr(token_file, "REMEMBERED", 0)
    monkeypatch.setattr(token_file, "_BATCH", 7)
    encoder = token_file.Encoder(path)
    assert [x.tolist() for t in some for x in encoder.encode_all([t])] == want
    assert encoder.cuts == name.startswith("word")


def test_pieces_are_those_of_the_tokenizer(monkeypatch):
    """Forms of one word share their ids; any character beside, between and after letters, and added tokens, give what whole texts give."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from seqpulse.llm import token_file

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, encoder = Tokenizer.from_file(path), token_file.Encoder(path)
    encoder.encode_all(["Word, word. WORD! (word) wOrd\nword; words"])
    assert len(encoder.known) == 8  # two words and six marks
    chars = [chr(c) for c in range(1, 0x3000)] + ["\ufb01", "\uff21", "\U0001f642", "e\u0301"]
    odd = [f"a{c}B .{c}{c}'{c}s 1{c} {c}" for c in chars] + ["<|endoftext|>", "a<|startoftext|>b, <|ENDOFTEXT|>", "don't WE'LL i've 's 'S ''s '", "x" * 3000 + ". y", "\n\r\t"]
    rng = np.random.default_rng(3)
    odd += ["".join(rng.choice(list("azAZ'sStvremLd09.,-!_<|>  \n\té\u00c9ßŽ«’…Жё\u0301\u00a0\u00b2漢"), 40)) for _ in range(3000)]
    want = [e.ids for e in plain.encode_batch(odd, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode_all(odd)] == want
    monkeypatch.setattr(encoder, "ends", np.zeros_like(encoder.ends))  # pieces whose ends are not found go to the tokenizer
    encoder.known.clear()
    assert [x.tolist() for x in encoder.encode_all(odd)] == want


def test_importance_scan_holds_little_text_at_a_time(spark):
    """What a worker holds follows a piece of the texts and not the batch."""
    import tracemalloc

    import pyarrow as pa
    from pyspark.sql.types import LongType, StructType

    class Frame:
        schema = StructType().add("doc_id", LongType())

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return run

    n, text = 1200, " ".join(f"w{i}" for i in range(600))
    batch = pa.record_batch({"doc_id": pa.array(range(n)), "row_key": pa.array(range(n)), "text": [text] * n})
    run = importance.scan(Frame())
    list(run(iter([batch.slice(0, 1)])))
    tracemalloc.start()
    rows = sum(b.num_rows for b in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == n + 1 and peak < 40 << 20
