"""Name resolution, exclusions and data-quality listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seqpulse.config import Config
from seqpulse.functions import (
    contains_any, is_internal, norm_cadence, rep_facing, spread_null, step_state,
)


def trim_cadence(df: DataFrame, column: str = "cadence_id") -> DataFrame:
    return df.withColumn(column, norm_cadence(column))


def resolve_cadence(checkpoints: DataFrame, keyword: str) -> DataFrame:
    """Stored names that contain a keyword, with their row counts, most frequent first."""
    return (
        checkpoints.select(norm_cadence().alias("cadence_id"))
        .filter(contains_any(F.col("cadence_id"), (keyword,)))
        .groupBy("cadence_id").agg(F.count("*").alias("rows"))
        .orderBy(F.desc("rows"), "cadence_id")
    )


def for_cadence(df: DataFrame, cadence_id: str, column: str = "cadence_id") -> DataFrame:
    """Rows of exactly one confirmed name."""
    return df.filter(norm_cadence(column) == cadence_id)


def exclude_domains(df: DataFrame, domains: tuple[str, ...], column: str = "email") -> DataFrame:
    """Without internal traffic. A row without an e-mail is dropped, one without a domain is kept."""
    return df.filter(~is_internal(F.col(column), domains))


def exclude_names(df: DataFrame, substrings: tuple[str, ...], column: str = "cadence_id") -> DataFrame:
    return df.filter(~contains_any(norm_cadence(column), substrings)) if substrings else df


def tag_quiet(df: DataFrame, cfg: Config, column: str = "cadence_id") -> DataFrame:
    """Mark sequences that are not meant to surface steps."""
    return df.withColumn("is_quiet", F.coalesce(contains_any(norm_cadence(column), cfg.quiet_substrings), F.lit(False)))


def rep_steps(steps: DataFrame, cfg: Config) -> DataFrame:
    return steps.filter(rep_facing(cfg))


def with_step_state(steps: DataFrame, blank_is_open: bool = False) -> DataFrame:
    return steps.withColumn("step_state", step_state(blank_is_open))


def result_variants(steps: DataFrame, cfg: Config) -> DataFrame:
    """Spellings of each outcome that differ only in case or padding.

    Spellings are counted first, so that the list kept per outcome holds distinct spellings, not rows.
    """
    spelled = rep_steps(steps, cfg).filter(F.col("result__c").isNotNull()).groupBy("result__c").agg(F.count("*").alias("n"))
    return (
        spelled.groupBy(F.lower(F.trim("result__c")).alias("result_folded"))
        .agg(
            F.sum("n").alias("rows"),
            F.count("*").alias("n_variants"),
            F.array_join(F.sort_array(F.collect_list("result__c")), " | ").alias("variants"),
        )
    )


def case_duplicates(checkpoints: DataFrame) -> DataFrame:
    """Names that differ only in case; the checks count each of them on its own."""
    names = checkpoints.select(norm_cadence().alias("cadence_id")).filter("cadence_id IS NOT NULL").groupBy("cadence_id").agg(F.count("*").alias("n"))
    return (
        names.groupBy(F.upper("cadence_id").alias("cadence_upper"))
        .agg(
            F.count("*").alias("n_variants"),
            F.sum("n").alias("rows"),
            F.array_join(F.sort_array(F.collect_list("cadence_id")), " | ").alias("variants"),
        )
        .filter("n_variants > 1")
    )


def is_lost(cfg: Config) -> Column:
    """The reason outlives the status: either of them marks a lost lead."""
    return F.col("lost_lead_reason__c").isNotNull() | F.coalesce(F.col("status") == cfg.lost_status, F.lit(False))


def exclude_lost(df: DataFrame, leads: DataFrame, cfg: Config, key: str = "lead_id") -> DataFrame:
    """Rows whose lead is not lost. Rows without a lead id stay."""
    lost = leads.filter(is_lost(cfg)).select(F.col("id").alias("_lead")).distinct()
    keyed = df.withColumn("_lead", spread_null(df, key))
    return keyed.join(lost, "_lead", "left_anti").drop("_lead")


def with_lost_reason(df: DataFrame, leads: DataFrame, cfg: Config, key: str = "lead_id") -> DataFrame:
    """All rows, with `lead_status`, `lost_lead_reason` and `is_lost` beside them."""
    known = leads.groupBy(F.col("id").alias("_lead")).agg(F.min(F.struct("status", "lost_lead_reason__c")).alias("l"))
    known = known.select(
        "_lead", F.col("l.status").alias("status"), F.col("l.lost_lead_reason__c").alias("lost_lead_reason__c")
    ).withColumn("is_lost", is_lost(cfg))
    return (
        df.withColumn("_lead", spread_null(df, key))
        .join(known, "_lead", "left").drop("_lead")
        .withColumnsRenamed({"status": "lead_status", "lost_lead_reason__c": "lost_lead_reason"})
        .withColumn("is_lost", F.coalesce("is_lost", F.lit(False)))
    )
