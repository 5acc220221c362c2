import struct
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT))

import corpus_pipeline  # noqa: E402
from seqpulse.llm import byte_dedup, chat, context_mixing, decontaminate, mixing, ngram_join, quality, token_file, toxicity, word_dedup  # noqa: E402
from seqpulse.llm import queries as q  # noqa: E402
from seqpulse.llm.common import WordHashes, words_of  # noqa: E402
from tests.llm import brute  # noqa: E402

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))

#: Nulls, empty and very long texts, ties and repeated rows, and columns whose names clash with ours.
ODD = [
    (1, "a b c d e f g h i j k l m n o p", "en"), (2, "a b c d e f g h i j k l m n o q", "en"), (3, None, None), (4, "", "de"), (5, " \n\t ", "de"),
    (6, "same same same same same same same same same same same same same same same same", "fr"), (7, "x", None), (8, LONG, "en"), (9, LONG + " end", "en"),
    (None, "a b c d e f g h i j k l m n o p", "en"), (10, "a b c d e f g h i j k l m n o p", "en"), (10, "a b c d e f g h i j k l m n o p", "en"), (11, "ÄÖ <|im_end|> \\ ñ 漢字 🙂", "es"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key string, word string, w string, item string, block string, bucket string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, None, None, "k", "w", "w", "i", "b", "u") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (6, 0, 1), (6, 0, 1), (8, 1, None), (None, 1, 1), (99, None, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def texts(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(q.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[names.index(c)] for c in cols) for r in cur.fetchall())


def test_word_dedup_against_brute_force(spark, texts):
    want = brute.repeats(texts, 13, True)
    got = by_id(q.op2_substring_dedup(spark, SF))
    assert {d: (r["n_words"], r["n_removed"], r["kept_sha256"]) for d, r in got.items()} == {d: (w[0], w[1], w[3]) for d, w in want.items()}
    assert sum(w[1] for w in want.values()) > 0


def test_byte_dedup_against_brute_force(spark, texts):
    want = brute.repeats(texts, 50, False)
    got = by_id(q.op6_suffix_dedup(spark, SF))
    assert {d: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for d, r in got.items()} == want


@pytest.mark.parametrize("width, threshold", [(3, 90), (5, 80), (2, 50)])
def test_jaccard_against_brute_force(spark, texts, width, threshold):
    got = by_id(ngram_join.jaccard_groups(spark.createDataFrame(texts, "doc_id long, text string"), width, threshold))
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == brute.jaccard(texts, width, threshold)


def test_tiles_find_the_links_a_star_misses(spark):
    """A chain of sets in which the ends of a key's group are not linked with its hub."""
    words = [f"t{i}" for i in range(60)]
    rows = [(k, " ".join(words[2 * k : 2 * k + 30])) for k in range(10)]
    got = by_id(ngram_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80))
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == brute.jaccard(rows, 1, 80)


def test_join_finds_every_link(spark, texts):
    """All pairs, also inside a component: a chain, a family of near copies, exact copies, and the test texts."""
    words = [f"t{i}" for i in range(60)]
    rows = [(k, " ".join(words[2 * k : 2 * k + 30])) for k in range(10)] + [(20 + k, " ".join([*words[:40], f"u{k // 2}"])) for k in range(12)] + [(90, None)]
    for some, width, threshold in ((rows, 1, 80), (texts, 3, 90)):
        pairs, found = ngram_join.jaccard_links(spark.createDataFrame(some, "doc_id long, text string"), width, threshold)
        sets = {}
        for d, t in some:
            w = brute.tokens(t)
            sets[d] = {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()
        want = {d: sum(e != d and bool(s) and 100 * len(s & o) >= threshold * len(s | o) for e, o in sets.items()) for d, s in sets.items()}
        got = by_id(found)
        assert {d: r["n_links"] for d, r in got.items()} == want
        assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == brute.jaccard(some, width, threshold)
        least = {}
        for d, r in got.items():
            least.setdefault(r["class"], d)
        assert {frozenset((least[r["a"]], least[r["b"]])) for r in pairs.collect()} == {
            frozenset((least[got[d]["class"]], least[got[e]["class"]])) for d, s in sets.items() for e, o in sets.items()
            if s and s != o and 100 * len(s & o) >= threshold * len(s | o)}


def test_repeats_over_many_chunks(spark, texts, monkeypatch):
    """The same result when each chunk holds a few texts only, groups of windows are cut and buckets are many."""
    import dataclasses

    from seqpulse.llm import repeats

    monkeypatch.setattr(repeats, "LONGEST", 5)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 50_000)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    for parse, sparse, width in ((word_dedup.word_parse(), False, 13), (byte_dedup.byte_parse(), True, 50)):
        small = dataclasses.replace(parse, chunk=20_000)
        hits = {r["doc_id"]: r["ranges"] for r in repeats.find_repeats(docs, small, sparse).collect()}
        want = brute.repeats(texts, width, width == 13)
        for d, t in texts:
            assert repeats.covered_tokens(parse.tokens([t])[0], hits.get(d), width).sum() == want[d][1], d


def test_lm_base_scores_and_probability(spark, texts):
    got, want = by_id(q.op10_lm_scoring(spark, SF)), brute.base_scores(texts)
    for d, r in got.items():
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[d][:3]
        assert r["base_score"] == pytest.approx(want[d][3])
        assert r["score"] < 0 and r["held_out"] == (zlib.crc32(str(d).encode()) % 7 == 2)


def test_spelling_is_a_distribution():
    """The probabilities of all first bytes, and of the end of an empty text, add up to one."""
    code = context_mixing.Code(np.arange(256))
    rng = np.random.default_rng(1)
    model = context_mixing._model(code, rng.integers(0, 50, (2, len(context_mixing.ORDERS), 1 << context_mixing.BITS)).astype(np.float32))
    letters = [bytes([i]) for i in range(256) if i != context_mixing.END_MARK]
    cost, text = context_mixing.byte_costs(letters, model)
    first = np.flatnonzero(np.diff(text, prepend=-1))
    assert (10 ** cost[first]).sum() + 10.0 ** context_mixing.spelled([b""], model)[0] == pytest.approx(1, abs=1e-5)


def test_lm_score_is_the_plain_bit_loop(spark):
    """Exact contexts in dictionaries and one bit after the other: the same scores up to the 16 bits of the stored odds."""
    learnt = [f"left{k % 9} right{k % 9} and north{k % 7} \u00e9t\u00e9 south{k % 7}" for k in range(60)]
    asked = ["left1 right1 and north2 south2 " * 9, "", "south2", "zq zq zq new words zq", learnt[3] + " " + learnt[4]]
    docs = spark.createDataFrame([*enumerate(learnt), *enumerate(asked, 1000)], "doc_id long, text string")
    got = by_id(context_mixing.score_texts(docs.repartition(3), F.col("doc_id") < 1000))
    want = brute.lm_scores(learnt, asked)
    for k, score in enumerate(want, 1000):
        assert got[k]["score"] == pytest.approx(score, rel=2e-3)


def test_lm_scores_do_not_depend_on_neighbours():
    """A text scores alike alone and among others, also beyond one block and one step."""
    texts = [b"some words here " * 40, b"", b"x ", b"other words there and here " * 900]
    code = context_mixing.Code(context_mixing._byte_counts(texts))
    rng = np.random.default_rng(2)
    model = context_mixing._model(code, rng.integers(0, 9, (2, len(context_mixing.ORDERS), 1 << context_mixing.BITS)).astype(np.float32))
    alone = [context_mixing.spelled([t], model)[0] for t in texts]
    assert context_mixing.spelled(texts, model) == pytest.approx(alone, rel=1e-5)


def test_words_are_predicted_from_the_words_before(spark):
    """The same words in another order have another score: pairs that were learnt cost less."""
    learnt = [(k, f"left{k % 9} right{k % 9} and north{k % 7} south{k % 7}") for k in range(200)]
    asked = [(1000, "left1 right1 and north2 south2"), (1001, "south2 right1 and left1 north2")]
    docs = spark.createDataFrame(learnt + asked, "doc_id long, text string")
    got = by_id(context_mixing.score_texts(docs, F.col("doc_id") < 1000))
    assert got[1000]["base_score"] == pytest.approx(got[1001]["base_score"])
    assert got[1000]["score"] > got[1001]["score"] + 3


def test_lm_fit_counts_every_occurrence_however_dealt(spark):
    """Every bit of every training text is in the tables, as often as it occurs, and partitions do not matter."""
    long = "zq " * 60_000  # beyond any bound on the length of a text
    rows = [(1, long), (2, "zx"), *((k, f"word{k % 5} here") for k in range(3, 60)), (1000, "zq"), (1001, "zx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = (by_id(context_mixing.score_texts(docs.repartition(n), F.col("doc_id") < 1000)) for n in (1, 7))
    for d, r in one.items():
        assert r["score"] == pytest.approx(many[d]["score"], rel=1e-4)
    streams = context_mixing._streams([t for d, t in rows if d < 1000])
    code = context_mixing.Code(context_mixing._byte_counts(streams))
    tables = context_mixing._bit_tables(docs.filter("doc_id < 1000").repartition(7), code)
    assert tables[:, 0].sum() == code.length[np.frombuffer(b" ".join(streams) + b" ", np.uint8)].sum()


def test_lm_counts_equal_bytes_of_equal_contexts_at_once(monkeypatch):
    """Bits are looked up once for each byte of each context, and count as often as they occur."""
    symbols, sizes = context_mixing._spaced([b"some words come back " * 500, b"", b"back "])
    code, asked, slots = context_mixing.Code(context_mixing._symbol_counts(symbols)), [], context_mixing._slots
    monkeypatch.setattr(context_mixing, "_slots", lambda hashes, owner, salt: asked.append(len(owner)) or slots(hashes, owner, salt))
    total = np.zeros((len(context_mixing.ORDERS), 2 << context_mixing.BITS), np.uint32)
    context_mixing._add_bits(total, symbols, sizes, code)
    assert (total.sum(axis=1) == code.length[symbols].sum()).all()
    assert sum(asked) < code.length[symbols].sum() / 10


def test_lm_streams_are_words_with_single_spaces():
    texts = ["", None, " \t\n", "One  TWO\x0b\x0cthree\r", "\u00c9t\u00e9\u00a0\x1f x", " a", "b "]
    want = [b"".join(w + b" " for w in words_of(t, lower=True)) for t in texts]
    assert context_mixing._streams(texts) == want
    symbols, _ = context_mixing._spaced(want)
    tokens = context_mixing._tokens(symbols)
    assert tokens.to_pylist() == [w + b" " for t in texts for w in [*words_of(t, lower=True), b""]]


def test_quality_base_columns(spark, texts):
    got = by_id(q.op4_quality_rules(spark, SF))
    for d, t in texts:
        r = got[d]
        want = brute.quality_base(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_quality_learns_from_every_labelled_row(spark):
    """More labelled rows than any fixed sample; each has a word of its own, so that a row left out shows in the scores."""
    n, cfg = 20_200, quality.Ratio(min_words=1)
    rows = [(i, f"w{i} {'good' if i % 5 else 'bad'} x{i % 7}", int(i % 5 > 0)) for i in range(n)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(8)
    got = by_id(quality.assess(frame.drop("quality"), frame.drop("text"), cfg))

    def counts(texts):
        _, h, doc = quality._words(texts, WordHashes())
        return np.bincount(quality._grams(h, doc, cfg.bits)[0], minlength=1 << cfg.bits) + 1

    target, raw = counts([t for _, t, y in rows if y]), counts([t for _, t, _ in rows])
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    _, h, doc = quality._words([t for _, t, _ in rows], WordHashes())
    slots, owner = quality._grams(h, doc, cfg.bits)
    want = np.bincount(owner, ratio[slots]) / np.bincount(owner)
    assert np.allclose([got[i]["llr"] for i in range(n)], want, rtol=0, atol=1e-9)


def test_quality_threshold_against_plain_loop(spark):
    rng = np.random.default_rng(3)
    for scale in (4, 1000):  # many ties, and hardly any
        x, y = np.round(rng.normal(0, 1, 300) * scale) / scale, rng.integers(0, 2, 300)
        x += np.where(y, 0.5, 0)
        cuts = [(sum(y[x >= v]) * sum(1 - y) + sum(1 - y[x < v]) * sum(y), -v) for v in set(x)]
        v = -max(cuts)[1]
        want = (max(x[x < v]) + v) / 2 if (x < v).any() else v
        scored = spark.createDataFrame([(i, float(a)) for i, a in enumerate(x)], "doc_id long, llr double")
        known = spark.createDataFrame([(i, int(b)) for i, b in enumerate(y)], "doc_id long, label int")
        assert quality.threshold(scored, known) == want
        assert quality.threshold(scored, known.filter("label = 1")) == 0.0


def test_quality_same_with_shuffled_labels(spark, monkeypatch):
    """Trusted ids beyond the broadcast bound are joined by a shuffle, with the same rows."""
    near = by_id(q.op4_quality_rules(spark, SF))
    monkeypatch.setattr(quality, "BROADCAST_BYTES", 0)
    assert by_id(q.op4_quality_rules(spark, SF)) == near


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in q.op1_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in truth]
    right = np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows])
    clean = np.mean([r["predicted"] for r in rows if not truth[r["doc_id"]]])
    assert right > 0.94 and clean < 0.02


def test_token_files_hold_what_the_tokenizer_says(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    got, start = by_id(q.op5_token_output(spark, SF)), 0
    for d, text in sorted(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        r = got[d]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_chat_trees(spark):
    rows = [(1, 1, None, "system", "be kind", 0.0), (1, 2, 1, "user", "hi", 0.5), (1, 3, 2, "assistant", "low", 0.1), (1, 4, 2, "assistant", "high \\<|im_end|>", 0.9),
            (1, 5, 4, None, None, 0.0), (2, 1, 7, "a\nb", "<\\|", None), (None, 1, None, "assistant", "", 1.0)]
    made = chat.format_chats(spark.createDataFrame(rows, "tree_id long, message_id long, parent_id long, role string, text string, score double"))
    got = {r["tree_id"]: r for r in chat.read_chats(made).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("system", "be kind"), ("user", "hi"), ("assistant", "high \\<|im_end|>"), ("", "")]
    assert got[1]["loss_text"] == "high \\<|im_end|>"
    assert [tuple(t) for t in got[2]["turns"]] == [("a\nb", "<\\|")] and got[None]["loss_text"] == ""
    loop = spark.createDataFrame([(1, 1, 2, "user", "x", 0.0), (1, 2, 1, "user", "y", 0.0)], "tree_id long, message_id long, parent_id long, role string, text string, score double")
    with pytest.raises(ValueError, match="circle"):
        chat.chosen_paths(loop)


def test_mixing_reaches_its_targets(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    cfg = mixing.Mix()
    domains = mixing.fit_domains(docs, labels, "lang", cfg)
    scored = mixing.posteriors(docs, domains, cfg, ["doc_id"])
    _, targets, reached = mixing.fit_rates(scored, len(domains.names), cfg)
    assert np.allclose(reached, targets, rtol=0.02)
    rows = mixing.mixing_rates(docs, labels, keep=["doc_id"]).collect()
    p, n, r = (np.array([x[c] for x in rows]) for c in ("posterior", "n_words", "rate"))
    assert np.allclose((n * r) @ p, targets, rtol=0.02) and r.min() >= 0


def test_mixing_to_given_targets(spark):
    """Given weights are reached by query and stage, also where a domain shrinks; what can't be reached is an error with the gaps."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    names = mixing.fit_domains(docs, labels, "lang", mixing.Mix()).names
    targets = dict(zip(names, (3.0, 2.0, 2.0, 3.0)))
    rows = q.op8_mixing(spark, SF, targets=targets).collect()
    p, n, r = (np.array([x[c] for x in rows]) for c in ("posterior", "n_words", "rate"))
    reached = (n * r) @ p
    assert np.allclose(reached / n.sum(), [targets[x] / 10 for x in names], rtol=0.02) and r.min() >= 0
    assert (reached < 0.9 * (n @ p)).any()
    assert corpus_pipeline.mix_languages(spark, docs, SF, targets=targets).columns == docs.columns
    with pytest.raises(ValueError, match="not reached"):
        mixing.mixing_rates(docs, labels, cfg=mixing.Mix(at_least=1.0), targets=targets)
    with pytest.raises(ValueError, match="without a domain"):
        mixing.mixing_rates(docs, labels, targets={"xx": 1.0})


def test_mixing_learns_every_domain(spark):
    """Forty domains, one of them rare, and values without a labelled document."""
    rows = [(k, f"w{k % 40} x{k % 40} y{k % 40}", f"d{k % 40}") for k in range(800)] + [(900, "rare words", "rare"), (901, "w1 x2", "unseen"), (902, "w3", "unseen too")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(k,) for k in range(901)], "doc_id long")
    domains = mixing.fit_domains(docs, labels, "source", mixing.Mix())
    assert sorted(domains.names) == sorted([*(f"d{k}" for k in range(40)), "rare", mixing.OTHER])
    assert np.exp(domains.prior)[domains.names.index(mixing.OTHER)] == pytest.approx(2 / 803)
    got = {r["doc_id"]: r["posterior"] for r in mixing.posteriors(docs, domains, mixing.Mix(), ["doc_id"]).collect()}
    assert domains.names[int(np.argmax(got[37]))] == "d37" and got[900][domains.names.index("rare")] > 3 * np.exp(domains.prior)[domains.names.index("rare")]


def test_decontamination_removes_spans(spark):
    docs = spark.createDataFrame([(1, "Keep this. One two, three four! Keep that.", "x"), (2, "nothing here", "y"), (3, None, "z")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(7, "ONE two three four", 1), (8, None, 2), (None, "...", 3)], "item_id long, text string, doc_id long")
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()) == [2, 3]
    got = by_id(decontaminate.decontaminate(docs, bench, mode="spans"))
    assert got[1]["text"] == "Keep this. Keep that." and got[3]["text"] is None and got[1]["item_id"] == "x"
    none = decontaminate.contamination(docs, bench.filter("false")).collect()
    assert len(none) == 3 and not any(r["contaminated"] for r in none)


def test_decontamination_broadcast_and_shuffled(spark, monkeypatch):
    """Items of one, two, three and more words, at both ends of a text, with letters whose case differs: the same from a hash set and from a shuffle."""
    texts = ["Solo", "x solo y SOLO", "pair Of", "a pair of b", "one two three", "ONE  two\nthree one two three", " ".join(f"W{k}" for k in range(30)),
             "w5 " + " ".join(f"w{k}" for k in range(3, 15)), "\u0130x \u00c9t\u00e9", "i\u0307x \u00e9t\u00e9", "\u0130X \u00c9t\u00e9", "", None, "...", ". solo ."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = ["solo", "pair of", "one two three", " ".join(f"w{k}" for k in range(3, 16)), " ".join(f"w{k}" for k in range(20, 30)), "\u0130x \u00c9t\u00e9", "", None]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = []
    for bound in (decontaminate.BROADCAST_BYTES, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", bound)
        found.append({r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in decontaminate.contamination(docs, bench).collect()})
    assert found[0] == found[1] == {
        0: (1, 1, 1), 1: (4, 2, 1), 2: (2, 2, 1), 3: (4, 2, 1), 4: (3, 3, 1), 5: (6, 6, 1), 6: (30, 23, 2), 7: (13, 12, 1),
        8: (2, 2, 1), 9: (2, 0, 0), 10: (2, 2, 1), 11: (0, 0, 0), 12: (0, 0, 0), 13: (0, 0, 0), 14: (1, 1, 1)}


def test_decontamination_reads_texts_in_place(spark):
    """No exchange of texts or windows: the hash set comes to the documents."""
    hits = decontaminate.find_hits(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and plan.count("split(") == 1


def test_odd_rows(spark, odd, labels):
    """Every operator takes odd rows and gives one row for each."""
    n = odd.count()
    bench = spark.createDataFrame([(1, "c d e f g h i j k l"), (2, None), (None, "")], "item_id long, text string")
    assert toxicity.score(odd, toxicity.train(odd, labels, F.lit(True))).count() == n
    assert quality.assess(odd, labels).count() == n
    found = decontaminate.contamination(odd, bench)
    assert found.count() == n and {r["doc_id"] for r in found.filter("contaminated").collect()} == {1, 2, None, 10}
    words = word_dedup.remove_repeats(odd).collect()
    assert len(words) == n and {r["doc_id"]: r["n_removed"] for r in words if r["doc_id"] in (None, 1, 2, 10)} == {None: 0, 1: 0, 2: 15, 10: 16}
    assert {r["doc_id"]: r["n_removed"] for r in words if r["doc_id"] in (6, 8, 9)} == {6: 0, 8: 0, 9: 30_000}
    raw = byte_dedup.remove_repeats(odd).collect()
    assert len(raw) == n and {r["doc_id"]: r["n_removed"] for r in raw if r["doc_id"] in (6, 8, 9)} == {6: 0, 8: 0, 9: len(LONG)}
    groups = ngram_join.jaccard_groups(odd, 3, 90).collect()
    assert len(groups) == n and {r["doc_id"]: r["component_id"] for r in groups} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 8, None: 1, 10: 1, 11: 11}
    assert sorted(str(r["doc_id"]) for r in ngram_join.drop_near_copies(odd, 3, 90).select("doc_id").collect()) == sorted("1 2 3 4 5 6 7 8 11".split())
    assert mixing.mixing_rates(odd, labels).count() == n
    scored = context_mixing.score_texts(odd, F.coalesce(F.col("doc_id"), F.lit(0)) != 2)
    assert scored.count() == n and scored.filter("score > 0 or score is null").count() == 0
    index = token_file.write_tokens(odd, corpus_pipeline.TOKENIZER, token_file.token_folder(spark))
    assert token_file.read_tokens(index).count() == n


def test_empty_tables(spark, empty, labels):
    none = labels.filter("false")
    assert toxicity.score(empty, toxicity.train(empty, none, F.lit(True))).count() == 0
    assert quality.assess(empty, none).count() == 0
    assert decontaminate.contamination(empty, empty.withColumnRenamed("doc_id", "item_id").select("item_id", "text")).count() == 0
    assert word_dedup.remove_repeats(empty).count() == 0
    assert byte_dedup.remove_repeats(empty).count() == 0
    assert ngram_join.jaccard_groups(empty).count() == 0
    assert mixing.mixing_rates(empty, none).count() == 0
    assert context_mixing.score_texts(empty, F.lit(True)).count() == 0
    assert token_file.read_tokens(token_file.write_tokens(empty, corpus_pipeline.TOKENIZER, token_file.token_folder(spark))).count() == 0
    messages = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_chats(chat.format_chats(chat.linear_messages(messages))).count() == 0


def test_pipeline_stages_take_effect(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], SF).cache())
    for df in kept[1:-1]:
        assert df.columns == docs.columns
    after = [{r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()} for df in kept[:-1]]
    groups = brute.jaccard(after[1].items(), 5, 80)
    assert set(after[2]) == {root for _, root in groups.values()}
    hit = {r["doc_id"] for r in decontaminate.contamination(kept[2], spark.read.parquet(f"{SF}/benchmark.parquet")).filter("contaminated").collect()}
    assert set(after[3]) == set(after[2]) - hit and set(after[4]) == set(after[3])
    assert kept[5].count() == kept[4].count() >= kept[3].count()
