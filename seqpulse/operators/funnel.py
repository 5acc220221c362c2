"""The four-stage funnel: entries (and control), steps surfaced, steps completed, exits."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window, functions as F

from seqpulse.config import Config
from seqpulse.functions import (
    bucket, fill_weeks, is_completed, monday, norm_cadence, ratio, rep_facing, weeks_back,
)
from seqpulse.operators.clean import tag_quiet
from seqpulse.sources import snapshot

STAGES = ["entries", "control", "steps_surfaced", "steps_completed", "exits"]


def _since(as_of: date, cfg: Config) -> date:
    return weeks_back(as_of, cfg.n_weeks)[0]


def people_per_week(checkpoints: DataFrame, steps_to_metrics: dict[str, str], tz: str | None = None) -> DataFrame:
    """Distinct e-mails per sequence, week and step.

    People are folded to one row of 0/1 flags first; the distinct count is then a plain sum, with one shuffle on
    (sequence, week, e-mail) whatever the number of metrics, and no task sees a whole sequence.
    """
    step = F.col("cadence_step")
    flags = [F.max((step == value).cast("int")).alias(metric) for metric, value in steps_to_metrics.items()]
    return (
        checkpoints.filter(step.isin(*steps_to_metrics.values()) & F.col("email").isNotNull())
        .groupBy(norm_cadence().alias("cadence_id"), bucket("event_timestamp", "week", tz).alias("week_start"), "email")
        .agg(*flags)
        .groupBy("cadence_id", "week_start").agg(*[F.sum(m).alias(m) for m in steps_to_metrics])
    )


def steps_per_week(steps: DataFrame, cfg: Config, blank_is_open: bool = False) -> DataFrame:
    """Surfaced by creation week and completed by result week, from one pass over the rep-facing steps."""
    surfaced = F.struct(
        bucket("createddate", "week", cfg.tz).alias("week_start"),
        F.lit(1).alias("steps_surfaced"), F.lit(0).alias("steps_completed"),
    )
    done = F.struct(
        F.when(is_completed(blank_is_open), bucket("result_date_time__c", "week", cfg.tz)).alias("week_start"),
        F.lit(0).alias("steps_surfaced"), F.lit(1).alias("steps_completed"),
    )
    return (
        steps.filter(rep_facing(cfg))
        .select(norm_cadence("cadence_id__c").alias("cadence_id"), F.inline(F.array(surfaced, done)))
        .filter(F.col("week_start").isNotNull())
        .groupBy("cadence_id", "week_start")
        .agg(F.sum("steps_surfaced").alias("steps_surfaced"), F.sum("steps_completed").alias("steps_completed"))
    )


def weekly_entries(checkpoints: DataFrame, tz: str | None = None) -> DataFrame:
    return people_per_week(checkpoints, {"entries": "Start"}, tz)


def weekly_control(checkpoints: DataFrame, tz: str | None = None) -> DataFrame:
    """`Test` rows are people held out, a population beside the entries."""
    return people_per_week(checkpoints, {"control": "Test"}, tz)


def weekly_exits(checkpoints: DataFrame, tz: str | None = None) -> DataFrame:
    return people_per_week(checkpoints, {"exits": "Exit"}, tz)


def weekly_surfaced(steps: DataFrame, cfg: Config) -> DataFrame:
    return (
        steps.filter(rep_facing(cfg))
        .groupBy(norm_cadence("cadence_id__c").alias("cadence_id"),
                 bucket("createddate", "week", cfg.tz).alias("week_start"))
        .agg(F.count("*").alias("steps_surfaced"))
    )


def weekly_completed(steps: DataFrame, cfg: Config, blank_is_open: bool = False) -> DataFrame:
    return (
        steps.filter(rep_facing(cfg) & is_completed(blank_is_open))
        .groupBy(norm_cadence("cadence_id__c").alias("cadence_id"),
                 bucket("result_date_time__c", "week", cfg.tz).alias("week_start"))
        .agg(F.count("*").alias("steps_completed"))
    )


def sequence_names(checkpoints: DataFrame, as_of: date) -> DataFrame:
    """Every sequence with a checkpoint up to `as_of`."""
    return snapshot(checkpoints, "checkpoints", as_of).select(norm_cadence().alias("cadence_id")).distinct()


def four_stage_funnel(
    checkpoints: DataFrame, steps: DataFrame, as_of: date, cfg: Config = Config(), cadences: DataFrame | None = None
) -> DataFrame:
    """All stages on a zero-filled spine of weeks, the current one included, with the completion rate.

    `cadences` (a frame with `cadence_id`) limits the result and saves the pass that lists the names. A week may
    complete more steps than it surfaced; that is not an error.
    """
    floor = _since(as_of, cfg)
    keys = sequence_names(checkpoints, as_of) if cadences is None else cadences
    people = people_per_week(
        snapshot(checkpoints, "checkpoints", as_of, floor, cfg.tz),
        {"entries": "Start", "control": "Test", "exits": "Exit"}, cfg.tz,
    )
    worked = steps_per_week(snapshot(steps, "steps", as_of, floor, cfg.tz), cfg)
    weekly = (
        people.unionByName(worked, allowMissingColumns=True)
        .groupBy("cadence_id", "week_start").agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in STAGES])
    )
    return fill_weeks(weekly, STAGES, as_of, cfg.n_weeks, keys=keys).withColumn(
        "completion_rate", ratio(F.col("steps_completed"), F.col("steps_surfaced"))
    )


def wow(weekly: DataFrame, metrics: list[str], key: str = "cadence_id") -> DataFrame:
    """Prior week and relative change of each metric on a gap-free weekly series."""
    by_week = Window.partitionBy(key).orderBy("week_start")
    prior = weekly.withColumns({f"prior_{m}": F.lag(m).over(by_week) for m in metrics})
    return prior.withColumns(
        {f"{m}_wow": ratio(F.col(m) - F.col(f"prior_{m}"), F.col(f"prior_{m}")) for m in metrics}
    )


def decoupled(funnel: DataFrame, as_of: date, cfg: Config = Config()) -> DataFrame:
    """Weeks in which entries hold or rise while a later stage collapses by `wow_drop` or more.

    Only complete weeks count: in the week of `as_of` the later stages have not had their time yet.
    """
    later = ["steps_surfaced", "steps_completed", "exits"]
    changed = wow(funnel, ["entries", *later])
    holds = (F.col("entries") >= F.col("prior_entries")) & (F.col("entries") > 0)
    flags = {
        f"{m}_decoupled": F.coalesce(holds & (F.col(f"{m}_wow") <= -cfg.wow_drop), F.lit(False)) for m in later
    }
    complete = changed.filter(F.col("week_start") < F.lit(monday(as_of)))
    flagged = tag_quiet(complete.withColumns(flags), cfg)
    return flagged.filter(" OR ".join(flags)).select(
        "cadence_id", "week_start", "entries", "prior_entries", *[f"{m}_wow" for m in later], *flags, "is_quiet"
    )


def exit_reason_mix(checkpoints: DataFrame, tz: str | None = None) -> DataFrame:
    return (
        checkpoints.filter(F.col("cadence_step") == "Exit")
        .groupBy(norm_cadence().alias("cadence_id"), bucket("event_timestamp", "week", tz).alias("week_start"),
                 F.col("cadence_step_value").alias("exit_reason"))
        .agg(F.count_distinct("email").alias("exits"))
    )


def exit_reason_shift(checkpoints: DataFrame, as_of: date, tz: str | None = None) -> DataFrame:
    """Share of each reason within a week's exits and its change to the week before.

    A week's row is laid beside the one seven days later and both are added up, so that a reason that vanished
    shows its loss too. Weeks after the current one are left out.
    """
    mix = exit_reason_mix(snapshot(checkpoints, "checkpoints", as_of, tz=tz), tz)
    week = Window.partitionBy("cadence_id", "week_start")
    total = F.nullif(F.sum("exits").over(week), F.lit(0))  # 0 where no exit of the week has an e-mail
    share = mix.withColumn("share", F.coalesce(F.col("exits") / total, F.lit(0.0)))
    now = F.struct(
        F.col("week_start"), F.col("exits"), F.col("share"), F.lit(0.0).alias("prior_share")
    )
    following = F.struct(
        F.date_add("week_start", 7).alias("week_start"), F.lit(0).cast("bigint").alias("exits"),
        F.lit(0.0).alias("share"), F.col("share").alias("prior_share"),
    )
    return (
        share.select("cadence_id", "exit_reason", F.inline(F.array(now, following)))
        .filter(F.col("week_start") <= F.trunc(F.lit(as_of), "week"))
        .groupBy("cadence_id", "week_start", "exit_reason")
        .agg(F.sum("exits").alias("exits"), F.round(F.sum("share"), 4).alias("share"),
             F.round(F.sum("prior_share"), 4).alias("prior_share"))
        .withColumn("share_shift", F.round(F.col("share") - F.col("prior_share"), 4))
    )


def outcome_mix(steps: DataFrame, cfg: Config) -> DataFrame:
    return (
        steps.filter(rep_facing(cfg))
        .groupBy(norm_cadence("cadence_id__c").alias("cadence_id"), "result__c").agg(F.count("*").alias("cnt"))
        .orderBy("cadence_id", F.desc("cnt"))
    )


def in_flight(checkpoints: DataFrame, key: str = "object_record_id") -> DataFrame:
    """People with a `Start` that no later `Exit` follows, as one row with that start.

    A start without a later exit exists exactly when the last start is not before the last exit, so two maxima
    replace the anti join.
    """
    step, ts = F.col("cadence_step"), F.col("event_timestamp")
    return (
        checkpoints.filter(step.isin("Start", "Exit") & F.col(key).isNotNull())
        .groupBy(norm_cadence().alias("cadence_id"), key)
        .agg(F.max(F.when(step == "Start", ts)).alias("last_start_ts"),
             F.max(F.when(step == "Exit", ts)).alias("last_exit_ts"))
        .filter("last_start_ts IS NOT NULL AND (last_exit_ts IS NULL OR last_exit_ts <= last_start_ts)")
        .select("cadence_id", key, "last_start_ts")
    )


def rollout_mix(checkpoints: DataFrame, tz: str | None = None) -> DataFrame:
    """Treated and held-out people per week and landing group. Control shrinks as a rollout widens."""
    step = F.col("cadence_step")
    person = (
        checkpoints.filter(step.isin("Start", "Test") & F.col("email").isNotNull())
        .groupBy(norm_cadence().alias("cadence_id"), bucket("event_timestamp", "week", tz).alias("week_start"),
                 "entry_group", "email")
        .agg(F.max((step == "Start").cast("int")).alias("treated"), F.max((step == "Test").cast("int")).alias("held"))
    )
    return (
        person.groupBy("cadence_id", "week_start", "entry_group")
        .agg(F.sum("treated").alias("treatment"), F.sum("held").alias("control"))
        .withColumn("control_share", ratio(F.col("control"), F.col("control") + F.col("treatment")))
    )

