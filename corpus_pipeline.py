"""From raw documents to token files: five stages, each written to the shared folder before the next one reads it.

Every stage works on all that its predecessor kept and takes effect: toxic documents go, one document of each group of near copies
(five words, 80 percent) stays, documents with benchmark text go, documents are repeated at the rates that bring the
languages to their targets (none is dropped by that, unless targets are given), and the ids are written and read back.
"""

from __future__ import annotations

from collections.abc import Mapping

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seqpulse.llm import decontaminate, mixing, ngram_join, token_file, toxicity
from seqpulse.llm.common import store

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.drop_near_copies(docs, width=5, threshold=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str, targets: Mapping[str, float] | None = None) -> DataFrame:
    return mixing.mix_documents(docs, _table(spark, sf_dir, "labels"), targets=targets)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_file.read_tokens(token_file.write_tokens(docs, TOKENIZER, token_file.token_folder(spark)))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_languages),
    ("token_output", write_token_files),
]

#: The models of stages 1 and 4 can't be said in SQL; the tests hold run() against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, targets: Mapping[str, float] | None = None) -> DataFrame:
    """`targets`: weights of the languages in the mix, without which the mixing stage sets its own."""
    rows = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        more = {"targets": targets} if stage is mix_languages else {}
        rows = store(stage(spark, rows, sf_dir, **more), f"pipeline-{name}")
    return rows
