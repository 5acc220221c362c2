"""Two folds of the fact tables, from which checks 1 and 5 to 9 are rolled up.

The day cube holds one row per sequence, person and local day, from one pass over the checkpoints and one over the steps; the
mail fold one row per workflow and week, and per message in the days check 6 looks at, from one pass over the messages. A batch run
stores both: every check then reads them, and no fact table is scanned a second time.

All windows of these checks begin and end at midnight of the zone, so a day is never cut.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, functions as F

from seqpulse.config import Config
from seqpulse.functions import bucket, contains_any, is_completed, norm_cadence, ratio, rep_facing, starts_with_any, weeks_back
from seqpulse.operators.alerts import judge, months_back, received_by, recent_weeks
from seqpulse.operators.clean import exclude_domains
from seqpulse.operators.comms import name_bridge, per_cadence
from seqpulse.sources import snapshot
from seqpulse.sources.snapshot import at

CUBE = ["cadence_id", "email", "day"]


def cube_floor(as_of: date, cfg: Config) -> date:
    """The first day any of the checks looks at."""
    alive = months_back(as_of, cfg.alive_months)
    return min(weeks_back(as_of, cfg.n_weeks)[0], alive, as_of - timedelta(days=cfg.engage_band[1]))


def day_cube(
    checkpoints: DataFrame, steps: DataFrame, as_of: date, cfg: Config = Config(), floor: date | None = None
) -> DataFrame:
    """starts, exits, first_start, last_start, surfaced, completed and last_touch per sequence, external person and day.

    From `floor` on, by default the first day the checks look at. A step counts as surfaced on the day it was created and as completed on the day of its result; both are touches.
    """
    floor, ts, step = floor or cube_floor(as_of, cfg), F.col("event_timestamp"), F.col("cadence_step")
    start = F.when(step == "Start", ts)
    no_time, none = F.lit(None).cast("timestamp"), F.lit(0).cast("bigint")
    one = F.lit(1).cast("bigint")
    moved = (
        exclude_domains(snapshot(checkpoints, "checkpoints", as_of, floor, cfg.tz), cfg.internal_domains)
        .filter(step.isin("Start", "Exit"))
        .select(norm_cadence().alias("cadence_id"), "email", bucket(ts, "day", cfg.tz).alias("day"),
                F.when(step == "Start", one).otherwise(none).alias("starts"), F.when(step == "Exit", one).otherwise(none).alias("exits"),
                start.alias("first_start"), start.alias("last_start"), none.alias("surfaced"), none.alias("completed"),
                no_time.alias("last_touch"))
    )
    created, result = F.col("createddate"), F.col("result_date_time__c")
    done = F.coalesce(is_completed(True), F.lit(False)) & result.isNotNull()
    events = F.array(
        F.struct(created.alias("touch"), one.alias("surfaced"), none.alias("completed")),
        F.struct(result.alias("touch"), none.alias("surfaced"), F.when(done, one).otherwise(none).alias("completed")),
    )
    worked = (
        exclude_domains(snapshot(steps, "steps", as_of, floor, cfg.tz), cfg.internal_domains, "email__c").filter(rep_facing(cfg))
        .select(norm_cadence("cadence_id__c").alias("cadence_id"), F.col("email__c").alias("email"),
                F.inline(F.filter(events, lambda e: e["touch"].isNotNull())))
        .filter(F.col("touch") >= at(floor, cfg.tz))
        .select("cadence_id", "email", bucket("touch", "day", cfg.tz).alias("day"), none.alias("starts"), none.alias("exits"),
                no_time.alias("first_start"), no_time.alias("last_start"), "surfaced", "completed", F.col("touch").alias("last_touch"))
    )
    return moved.unionByName(worked).groupBy(*CUBE).agg(
        F.sum("starts").alias("starts"), F.sum("exits").alias("exits"), F.min("first_start").alias("first_start"),
        F.max("last_start").alias("last_start"), F.sum("surfaced").alias("surfaced"), F.sum("completed").alias("completed"),
        F.max("last_touch").alias("last_touch"),
    )


def mail_fold(comms: DataFrame, as_of: date, cfg: Config = Config()) -> DataFrame:
    """emails and last time per workflow name, week and, in the days of check 6, message."""
    weeks = weeks_back(as_of, cfg.n_weeks, include_current=False)
    oldest = as_of - timedelta(days=cfg.engage_band[1])
    sent = F.col("comm_date")
    return (
        snapshot(comms, "comms", as_of, min(weeks[0], oldest), cfg.tz).filter("workflow_name IS NOT NULL")
        .filter((F.col("comm_type") == "email") | (sent >= at(oldest, cfg.tz)))
        .groupBy("workflow_name", bucket(sent, "week", cfg.tz).alias("week_start"),
                 F.when(sent >= at(oldest, cfg.tz), F.col("comm_id")).alias("comm_id"))
        .agg(F.count_if(F.col("comm_type") == "email").alias("emails"), F.max(sent).alias("touch"))
    )


# 1 ------------------------------------------------------------------------------------------------

def start_recency(cube: DataFrame, as_of: date, cfg: Config = Config()) -> DataFrame:
    """As `alerts.start_recency`."""
    silent = F.lit(as_of - timedelta(days=cfg.silent_days))
    return (
        cube.filter((F.col("starts") > 0) & (F.col("day") >= F.lit(months_back(as_of, cfg.alive_months))))
        .groupBy("cadence_id")
        .agg(F.sum("starts").alias("starts_last_4mo"),
             F.sum(F.when(F.col("day") >= silent, F.col("starts")).otherwise(0)).alias("starts_last_7d"),
             F.max("last_start").alias("last_start_ts"))
    )


# 5, 7, 8 ------------------------------------------------------------------------------------------

def weekly_baselines(cube: DataFrame, as_of: date, cfg: Config = Config()) -> DataFrame:
    """Entries, exits, steps surfaced and completed per week with their baselines, from one shuffle. A person counts once a week.

    A sequence that has people but no steps, or steps but no people, gets zeros for the others, which cannot be flagged.
    """
    weekly = (
        cube.groupBy("cadence_id", "email", F.trunc("day", "week").alias("week_start"))
        .agg(F.max((F.col("starts") > 0).cast("int")).alias("entered"), F.max((F.col("exits") > 0).cast("int")).alias("left"),
             F.sum("surfaced").alias("surfaced"), F.sum("completed").alias("completed"))
        .groupBy("cadence_id", "week_start")
        .agg(F.sum("entered").alias("entries"), F.sum("left").alias("exits"), F.sum("surfaced").alias("steps_surfaced"),
             F.sum("completed").alias("steps_completed"))
    )
    return recent_weeks(judge(weekly, ["entries", "exits", "steps_surfaced", "steps_completed"], as_of, cfg), as_of, cfg)


# 6 ------------------------------------------------------------------------------------------------

def engagement(cube: DataFrame, mail: DataFrame, email_msgs: DataFrame, as_of: date, cfg: Config = Config()) -> DataFrame:
    """As `alerts.engagement`: one row per sequence and person holds the start of the band and the last touch by a step."""
    newest, oldest = (F.lit(as_of - timedelta(days=d)) for d in cfg.engage_band)
    people = (
        cube.filter((F.col("day") >= oldest) & ~contains_any(F.col("cadence_id"), cfg.quiet_substrings))
        .groupBy("cadence_id", "email")
        .agg(F.min(F.when(F.col("day") <= newest, F.col("first_start"))).alias("start_ts"), F.max("last_touch").alias("worked"))
        .filter("start_ts IS NOT NULL AND cadence_id IS NOT NULL")
    )
    messages = mail.filter("comm_id IS NOT NULL").groupBy("comm_id", "workflow_name").agg(F.max("touch").alias("touch"))
    by_sequence = (
        messages.join(name_bridge(messages, people), "workflow_name")
        .groupBy("comm_id", "cadence_id").agg(F.max("touch").alias("touch"))
    )
    mailed = received_by(people, by_sequence, email_msgs).groupBy("cadence_id", "email").agg(F.max("touch").alias("mailed"))
    engaged = F.greatest("worked", "mailed") >= F.col("start_ts")
    return (
        people.join(mailed, ["cadence_id", "email"], "left").groupBy("cadence_id")
        .agg(F.count("*").alias("cohort_size"), F.count_if(engaged).alias("engaged_count"))
        .withColumn("engaged_pct", ratio(F.col("engaged_count"), F.col("cohort_size")))
    )


# 9 ------------------------------------------------------------------------------------------------

def email_baselines(mail: DataFrame, names: DataFrame, as_of: date, cfg: Config = Config()) -> DataFrame:
    """As `alerts.email_baselines`."""
    watched = names.filter(starts_with_any(F.col("cadence_id"), cfg.name_prefixes)) if cfg.name_prefixes else names
    weeks = weeks_back(as_of, cfg.n_weeks, include_current=False)
    counts = (
        mail.filter((F.col("emails") > 0) & F.col("week_start").between(F.lit(weeks[0]), F.lit(weeks[-1])))
        .groupBy("workflow_name", "week_start").agg(F.sum("emails").alias("n"))
    )
    return recent_weeks(judge(per_cadence(counts, watched, ["week_start"], "email_volume"), ["email_volume"], as_of, cfg), as_of, cfg)
