r"""Mixing to target weights with soft membership.

Domains are all values of the column, with their shares of all documents as prior. Their words are learnt from about `sample` labelled rows, as many of each
domain (chosen by id hash; a documented bound; `least` or all of a domain if there are many domains): naive Bayes over hashed words, whose
evidence is divided by the square root of the text's length so that posteriors stay soft. Each document then has posteriors
over the domains. Document rates are the ones nearest to 1,

    min  1/2 sum_d n_d (r_d - 1)^2   with   sum_d r_d n_d p_dk = T_k  and  r_d >= at_least,

where n_d are the document's words and T_k a domain's target: given weights, or self-made ones. They are r_d = max(at_least, 1 - p_d y), and y is found by gradient
steps on the dual, scaled by the K x K matrix sum_d n_d p_d p_d'. A step needs only the K sums over documents, so each iteration is one aggregation; a document's
rate is a function of its own posteriors and of y and is computed anew where the document lies. Nothing per document reaches the driver. It ends at a tolerance, and what is left of the gap beyond it is told by domain.

The mix holds floor(rate) copies of a document and one more where a hash of its id and text falls below the fraction.

Defined cases: a null or empty text has no words, adds nothing to any total and takes the prior as posterior; a null domain is not
learnt from; domains without any labelled row are one class OTHER with the words of all labelled rows, which has posterior 1 if there are no others. Repeated rows have equal rates. Columns named
`posterior`, `n_words`, `rate` must not be there already; any other column is carried along.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from seqpulse.llm.common import WordHashes, chunks, mix, store, words_of


OTHER = "__other__"  # the class of all domains without a labelled document
PIECE = 32 << 20  # bytes of text held at a time, times the domains (32 at least)


@dataclass(frozen=True)
class Mix:
    bits: int = 16
    sample: int = 8000
    least: int = 50  # about so many labelled documents of each domain are in the sample, or all it has
    steps: int = 100  # at most; it ends when the totals are within 0.1 %, or no longer come nearer
    tolerance: float = 0.02  # gap of a total, as a part of its target, beyond which the targets count as missed
    ridge: float = 1e-6
    power: float = 0.7  # targets: share ** power, scaled so that no domain shrinks
    at_least: float = 0.0


@dataclass(frozen=True)
class Domains:
    names: list[str]
    prior: np.ndarray  # log
    word: np.ndarray  # log, slots x domains


def _slots(texts: list[str | None], hashes: WordHashes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    words = [words_of(t, lower=True) for t in texts]
    h = hashes.of([x for w in words for x in w])
    return (mix(h) >> np.uint64(64 - bits)).astype(np.int64), np.array([len(w) for w in words], np.int64)


def _word_counts(sample: DataFrame, bits: int) -> dict[str, np.ndarray]:
    """How often each slot occurs in the sampled texts of each domain, which are bounded, so that a domain is one task's work."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, hashes = {}, WordHashes()
        for table in chunks(batches, 1 << 20):
            slots, sizes = _slots(table["text"].to_pylist(), hashes, bits)
            ends = np.cumsum(sizes)
            for d, a, b in zip(table["domain"].to_pylist(), ends - sizes, ends):
                np.add.at(total.setdefault(d, np.zeros(1 << bits, np.int64)), slots[a:b], 1)
        for d, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([d]), pa.array([x.tobytes()], pa.binary())], ["domain", "counts"])

    rows = sample.select("domain", "text").repartition("domain").mapInArrow(run, "domain string, counts binary").collect()
    return {r["domain"]: np.frombuffer(r["counts"], np.int64) for r in rows}


def fit_domains(docs: DataFrame, labels: DataFrame, domain: str, cfg: Mix) -> Domains:
    """Every domain of the documents; those without a labelled document share the class OTHER."""
    known = labels.filter(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    rows = docs.filter(F.col(domain).isNotNull()).select("doc_id", F.col(domain).cast("string").alias("domain"), "text")
    documents = {r["domain"]: r["count"] for r in rows.groupBy("domain").count().collect()}  # one number for each domain
    labelled = store(rows.select("doc_id", "domain").join(known, "doc_id", "left_semi").distinct(), "mixing-labelled")
    share = F.lit(float(max(cfg.least, -(-cfg.sample // max(len(documents), 1))))) / F.col("count")
    u = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    chosen = labelled.join(labelled.groupBy("domain").count(), "domain").filter(u < share).select("doc_id", "domain")
    sample = store(rows.join(F.broadcast(chosen), ["doc_id", "domain"]).dropDuplicates(["doc_id", "domain"]), "mixing-sample")
    counts = _word_counts(sample, cfg.bits)
    names = sorted(counts)
    weights = [documents[n] for n in names]
    if len(names) < len(documents) or not names:
        # no text says what the others look like: they have the words of all
        counts[OTHER] = sum(counts.values(), np.zeros(1 << cfg.bits, np.int64))
        names.append(OTHER)
        weights.append(sum(documents.values()) - sum(weights) or 1)
    table = np.stack([counts[n] for n in names], axis=1) + 0.5
    weights = np.array(weights, float)
    return Domains(names, np.log(weights / weights.sum()), np.log(table / table.sum(axis=0)))


def posteriors(docs: DataFrame, domains: Domains, cfg: Mix, keep: list[str], steps: list[np.ndarray] | None = None) -> DataFrame:
    """The kept columns, n_words and posterior (in the order of domains.names); with steps also the rate, so that texts pass one Python worker."""
    if clash := {"posterior", "n_words", "rate"} & set(keep):
        raise ValueError(f"columns {sorted(clash)} are there already")
    shared = docs.sparkSession.sparkContext.broadcast((domains.prior, domains.word))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (prior, word), hashes = shared.value, WordHashes()
        for table in chunks(batches, PIECE // max(len(prior), 32)):
            slots, sizes = _slots(table["text"].to_pylist(), hashes, cfg.bits)
            sums = np.concatenate([np.zeros((1, len(prior))), np.cumsum(word[slots], axis=0)])
            ends = np.cumsum(sizes)
            logits = prior + (sums[ends] - sums[ends - sizes]) / np.sqrt(np.maximum(sizes, 1))[:, None]
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.reshape(-1)))
            out = table.select(keep).append_column("n_words", pa.array(sizes)).append_column("posterior", lists)
            yield from (out if steps is None else out.append_column("rate", pa.array(_rates(p, steps, cfg)))).to_batches()

    wanted = docs.select(*dict.fromkeys([*keep, "text"]))
    fields = [f for f in docs.schema.fields if f.name in keep]
    fields = sorted(fields, key=lambda f: keep.index(f.name))
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))])
    schema = schema if steps is None else schema.add("rate", T.DoubleType())
    return wanted.mapInArrow(run, schema)


def _rates(p: np.ndarray, steps: list[np.ndarray], cfg: Mix) -> np.ndarray:
    return np.maximum(cfg.at_least, 1 - p @ np.sum(steps, axis=0)) if steps else np.maximum(cfg.at_least, np.ones(len(p)))


def _added_up(scored: DataFrame, k: int, f, size: int) -> np.ndarray:
    """f(posteriors, words) of `size` numbers, added up over all documents: one row per number and task, added by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            p = b["posterior"].flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            total += f(p, b["n_words"].to_numpy()).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], ["k", "total"])

    rows = scored.select("n_words", "posterior").mapInArrow(run, "k int, total double").groupBy("k").agg(F.sum("total").alias("total")).collect()
    out = np.zeros(size)
    for r in rows:
        out[r["k"]] = r["total"]
    return out


def _totals(scored: DataFrame, steps: list[np.ndarray], cfg: Mix, k: int) -> np.ndarray:
    """Sums of rate x words x posterior by domain."""
    return _added_up(scored, k, lambda p, n: (_rates(p, steps, cfg) * n) @ p, k)


def target_totals(targets: Mapping[str, float], names: list[str], n: float) -> np.ndarray:
    """The words each domain is to have, of n in all; weights need not add up to one."""
    if set(targets) != set(names):
        raise ValueError(f"targets without a domain: {sorted(set(targets) - set(names))}; domains without a target: {sorted(set(names) - set(targets))}")
    weights = np.array([targets[x] for x in names], float)
    if not (np.isfinite(weights).all() and (weights > 0).all()):
        raise ValueError("targets must be positive numbers")
    return weights / weights.sum() * n


def fit_rates(scored: DataFrame, k: int, cfg: Mix, targets: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The steps that give every document its rate, the targets, and the totals reached."""
    base = _added_up(scored, k, lambda p, n: n @ p, k)
    n = base.sum()
    if not n:
        return [], np.zeros(k), base
    share = np.maximum(base / n, 1e-12)
    if targets is None:
        wish = share**cfg.power
        targets = wish / np.min(wish / share) * n
    # how the totals answer to a step where no rate is at its bound; elsewhere they answer less, so that steps are never too long
    answer = _added_up(scored, k, lambda p, w: (p * w[:, None]).T @ p, k * k).reshape(k, k) / n + cfg.ridge * np.diag(share)
    steps, reached, gaps = [], _totals(scored, [], cfg, k), []
    for turn in range(cfg.steps):
        gaps.append(np.max(np.abs(reached - targets) / targets))
        if gaps[-1] < 1e-3 or turn >= 15 and gaps[-1] > 0.99 * gaps[-11]:
            break
        steps.append(np.linalg.solve(answer, (reached - targets) / n))
        reached = _totals(scored, steps, cfg, k)
    return steps, targets, reached


def missed(names: list[str], targets: np.ndarray, reached: np.ndarray, cfg: Mix) -> dict[str, float]:
    """Of each domain beyond the tolerance the gap, as a part of its target."""
    gap = (reached - targets) / np.maximum(targets, 1e-300)
    return {x: round(float(g), 4) for x, g in zip(names, gap) if abs(g) > cfg.tolerance}


def mixing_rates(docs: DataFrame, labels: DataFrame, domain: str = "lang", cfg: Mix = Mix(), keep: list[str] | None = None,
                 targets: Mapping[str, float] | None = None) -> DataFrame:
    """The kept columns (default: all), n_words, posterior and rate of every document.

    `targets` are weights by domain, for a mix with as many words as there are; without them see `Mix.power`. Given targets that can't be reached raise an error that
    names the gap of each domain; of the self-made ones a warning tells them.
    """
    keep = list(keep or docs.columns)
    domains = fit_domains(docs, labels, domain, cfg)
    k = len(domains.names)
    scored = store(posteriors(docs, domains, cfg, ["doc_id"]), "mixing-posteriors")
    words = None if targets is None else scored.agg(F.sum("n_words")).first()[0] or 0
    wanted = None if targets is None else target_totals(targets, domains.names, words)
    steps, wanted, reached = fit_rates(scored, k, cfg, wanted)
    if gaps := missed(domains.names, wanted, reached, cfg):
        if targets is not None:
            raise ValueError(f"targets not reached, gap by domain: {gaps}")
        warnings.warn(f"targets not reached, gap by domain: {gaps}")
    if keep != ["doc_id"]:
        return posteriors(docs, domains, cfg, keep, steps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b["posterior"].flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_rates(p, steps, cfg))], [*b.schema.names, "rate"])

    return scored.mapInArrow(run, T.StructType([*scored.schema.fields, T.StructField("rate", T.DoubleType())]))


def copies(rate, *by):
    """floor(rate), and one more where the hash falls below the fraction."""
    u = F.shiftrightunsigned(F.xxhash64(*by), 11) / float(1 << 53)
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("long")).cast("long")


def mix_documents(docs: DataFrame, labels: DataFrame, domain: str = "lang", cfg: Mix | None = None, targets: Mapping[str, float] | None = None) -> DataFrame:
    """The mix, with the columns of the documents. Without targets every document stays and some come more than once; with targets rates go below 1 too."""
    cfg = cfg or Mix(at_least=1.0 if targets is None else 0.0)
    rated = mixing_rates(docs, labels, domain, cfg, targets=targets)
    n = copies(F.col("rate"), "doc_id", "text")
    return rated.withColumn("rate", F.explode(F.array_repeat(F.lit(1.0), n.cast("int")))).select(*docs.columns)
