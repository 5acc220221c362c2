"""Breaks: a prescribed action that was not done in time, recorded in one of three ways."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, functions as F

from seqpulse.config import Config
from seqpulse.functions import bucket, fill_weeks, is_break, is_break_exit, norm_cadence, weeks_back
from seqpulse.sources import snapshot


def _recent(checkpoints: DataFrame, as_of: date, days: int) -> DataFrame:
    return snapshot(checkpoints, "checkpoints", as_of, as_of - timedelta(days=days))


def break_reasons(checkpoints: DataFrame, as_of: date, cfg: Config = Config(), days: int = 30) -> DataFrame:
    return (
        _recent(checkpoints, as_of, days).filter(is_break(cfg))
        .groupBy(norm_cadence().alias("cadence_id"), F.col("cadence_step_value").alias("break_reason"))
        .agg(F.count("*").alias("total_breaks"))
        .orderBy(F.desc("total_breaks"))
    )


def break_signals(checkpoints: DataFrame, as_of: date, cfg: Config = Config(), days: int = 30) -> DataFrame:
    """The three signals side by side, their union and the exits that are breaks at the same time."""
    status = F.col("cadence_step_status")
    return (
        _recent(checkpoints, as_of, days)
        .groupBy(norm_cadence().alias("cadence_id"))
        .agg(
            F.count_if(F.col("cadence_step") == "Break").alias("break_step_cnt"),
            F.count_if((F.lower(status) == "break") if cfg.fold_status else (status == "Break")).alias("break_status_cnt"),
            F.count_if(is_break_exit(cfg)).alias("break_exit_cnt"),
            F.count_if(is_break(cfg)).alias("break_union_cnt"),
        )
    )


def weekly_breaks(checkpoints: DataFrame, as_of: date, cfg: Config = Config()) -> DataFrame:
    """Break volume per week, zero-filled for every sequence that broke at least once in the period."""
    floor = weeks_back(as_of, cfg.n_weeks)[0]
    weekly = (
        snapshot(checkpoints, "checkpoints", as_of, floor, cfg.tz).filter(is_break(cfg))
        .groupBy(norm_cadence().alias("cadence_id"), bucket("event_timestamp", "week", cfg.tz).alias("week_start"))
        .agg(F.count("*").alias("breaks"))
    )
    return fill_weeks(weekly, ["breaks"], as_of, cfg.n_weeks)


def exit_break_overlap(checkpoints: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Rows that count as an exit and as a break. They belong to both; the overlap is stated, not removed."""
    exit_row = F.col("cadence_step") == "Exit"
    return (
        checkpoints.groupBy(norm_cadence().alias("cadence_id"))
        .agg(
            F.count_if(exit_row).alias("exit_rows"),
            F.count_if(is_break(cfg)).alias("break_rows"),
            F.count_if(exit_row & is_break(cfg)).alias("overlap_rows"),
        )
    )
