"""The eight mechanical checks of a sequence, the payload profile and the parts of a ticket."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from seqpulse.config import Config
from seqpulse.functions import bucket, fill_weeks, is_break_exit, monday, norm_cadence, weeks_back
from seqpulse.operators import sequence as seq
from seqpulse.operators.funnel import people_per_week, sequence_names, steps_per_week, wow
from seqpulse.sources import snapshot
from seqpulse.sources.snapshot import at


def last_starts(checkpoints: DataFrame, as_of: date, cfg: Config = Config()) -> DataFrame:
    """Age of the last start, and the earlier volume that tells a silent sequence from a sparse one."""
    ts = F.col("event_timestamp")
    recent = as_of - timedelta(days=cfg.silent_days)
    earlier = recent - timedelta(weeks=cfg.n_weeks)
    return (
        snapshot(checkpoints, "checkpoints", as_of, tz=cfg.tz).filter("cadence_step = 'Start'")
        .groupBy(norm_cadence().alias("cadence_id"))
        .agg(F.max(ts).alias("last_start_ts"),
             F.count_if((ts >= at(earlier, cfg.tz)) & (ts < at(recent, cfg.tz))).alias("starts_prior_weeks"))
        .withColumn("days_since_last_start", F.date_diff(F.lit(as_of), bucket("last_start_ts", "day", cfg.tz)))
        .withColumn("prior_weekly_starts", F.round(F.col("starts_prior_weeks") / cfg.n_weeks, 4))
        .withColumn("is_sparse", F.col("starts_prior_weeks") < cfg.n_weeks)
    )


def no_starts(checkpoints: DataFrame, as_of: date, cfg: Config = Config()) -> DataFrame:
    return last_starts(checkpoints, as_of, cfg).filter(F.col("days_since_last_start") >= cfg.silent_days)


def _floor(as_of: date, cfg: Config) -> date:
    return weeks_back(as_of, cfg.n_weeks)[0]


def weekly_people(
    checkpoints: DataFrame, as_of: date, cfg: Config = Config(), cadences: DataFrame | None = None
) -> DataFrame:
    """Entries and exits per week with the week before and the relative change."""
    weekly = people_per_week(
        snapshot(checkpoints, "checkpoints", as_of, _floor(as_of, cfg), cfg.tz), {"entries": "Start", "exits": "Exit"}, cfg.tz
    )
    keys = sequence_names(checkpoints, as_of) if cadences is None else cadences
    return wow(fill_weeks(weekly, ["entries", "exits"], as_of, cfg.n_weeks, keys=keys), ["entries", "exits"])


def weekly_steps(
    steps: DataFrame, as_of: date, cfg: Config = Config(), cadences: DataFrame | None = None
) -> DataFrame:
    """Steps surfaced and completed per week with the week before and the relative change.

    Without `cadences` the sequences are those that have steps in the period.
    """
    metrics = ["steps_surfaced", "steps_completed"]
    weekly = steps_per_week(snapshot(steps, "steps", as_of, _floor(as_of, cfg), cfg.tz), cfg)
    return wow(fill_weeks(weekly, metrics, as_of, cfg.n_weeks, keys=cadences), metrics)


def weekly_metric(weekly: DataFrame, metric: str) -> DataFrame:
    return weekly.select("cadence_id", "week_start", metric, f"prior_{metric}", f"{metric}_wow")


# payload -------------------------------------------------------------------------------------------

def payload_class(cfg: Config) -> Column:
    """Which known signal a (step, status, value) is, or what is wrong with it.

    Malformed: a known word in another spelling. Unknown: no known word at all. Sources write a status in any case,
    which is no fault: such rows are a class of their own, or count as the word they spell where the case is folded.
    """
    step, status = F.col("cadence_step"), F.col("cadence_step_status")
    said = F.lower(status)
    is_break_status = said == "break" if cfg.fold_status else status == "Break"
    steps = [s.lower() for s in cfg.known_steps]
    statuses = [s.lower() for s in cfg.known_statuses]
    return (
        F.when(step.isNull() | ~F.lower(F.trim(step)).isin(*steps), "unknown step")
        .when(~step.isin(*cfg.known_steps), "malformed step")
        .when(status.isNotNull() & ~F.lower(F.trim(status)).isin(*statuses), "unknown status")
        .when(status.isNotNull() & ~said.isin(*statuses), "malformed status")
        .when(step == "Break", "break step")
        .when(is_break_status, "break status")
        .when(is_break_exit(cfg), "break exit")
        .when(F.lit(not cfg.fold_status) & status.isNotNull() & ~status.isin(*cfg.known_statuses), "status case")
        .otherwise("ok")
    )


def payload_profile(checkpoints: DataFrame, as_of: date, cfg: Config = Config()) -> DataFrame:
    recent = snapshot(checkpoints, "checkpoints", as_of, as_of - timedelta(days=cfg.payload_days), cfg.tz)
    return (
        recent.groupBy(norm_cadence().alias("cadence_id"), "cadence_step", "cadence_step_status", "cadence_step_value")
        .agg(F.count("*").alias("rows"))
        .withColumn("payload_class", payload_class(cfg))
    )


def sibling_profile(
    checkpoints: DataFrame, cadence_a: str, cadence_b: str, as_of: date, cfg: Config = Config()
) -> DataFrame:
    """How two sequences write the same events: rows and shares of each payload side by side."""
    name = norm_cadence()
    recent = snapshot(checkpoints, "checkpoints", as_of, as_of - timedelta(days=cfg.payload_days), cfg.tz)
    a, b = F.count_if(name == cadence_a), F.count_if(name == cadence_b)
    return (
        recent.filter(name.isin(cadence_a, cadence_b))
        .groupBy("cadence_step", "cadence_step_status", "cadence_step_value")
        .agg(a.alias("rows_a"), b.alias("rows_b"))
        .withColumn("only_in", F.when(F.col("rows_b") == 0, "a").when(F.col("rows_a") == 0, "b"))
    )


# ticket --------------------------------------------------------------------------------------------

def ticket_scope(checkpoints: DataFrame, affected: Column, as_of: date, days: int = 35) -> DataFrame:
    """Workflows with affected rows, and how many in the period."""
    recent = snapshot(checkpoints, "checkpoints", as_of, as_of - timedelta(days=days))
    return (
        recent.filter(affected).groupBy(norm_cadence().alias("cadence_id"), "workflow_id")
        .agg(F.count("*").alias("affected_rows"), F.min("event_timestamp").alias("first_ts"),
             F.max("event_timestamp").alias("last_ts"))
    )


def ticket_samples(checkpoints: DataFrame, affected: Column, as_of: date, n: int = 5, days: int = 35) -> DataFrame:
    """The latest few affected e-mails and times per sequence.

    Copies are folded first; Spark then keeps the best `n` of each task before the shuffle.
    """
    latest = Window.partitionBy("cadence_id").orderBy(F.desc("event_timestamp"), "email")
    recent = snapshot(checkpoints, "checkpoints", as_of, as_of - timedelta(days=days))
    return (
        recent.filter(affected).select(norm_cadence().alias("cadence_id"), "email", "event_timestamp").distinct()
        .withColumn("sample", F.row_number().over(latest)).filter(F.col("sample") <= n)
    )


# summary -------------------------------------------------------------------------------------------

def profile(checkpoints: DataFrame, as_of: date, cfg: Config = Config()) -> DataFrame:
    """What checks 1, 4 and 5 need of each sequence, from one fold per sequence and person: last_start_ts, d4_stuck, and entries and exits by week.

    The weeks in which a person entered or left are the bits of one number, so that the fold holds one row per person whatever the number of weeks,
    with map-side combine; a sequence's people per week are sums of bits. Every sequence with a checkpoint has a row.
    """
    weeks = weeks_back(as_of, cfg.n_weeks)
    if len(weeks) > 63:
        raise ValueError("weeks are the bits of a long: n_weeks is at most 63")
    ts, step = F.col("event_timestamp"), F.col("cadence_step")
    start, leave = F.when(step == "Start", ts), F.when((step == "Exit") & F.col("email").isNotNull(), ts)
    week = F.date_diff(bucket(ts, "week", cfg.tz), F.lit(weeks[0])) / 7
    in_weeks = (ts >= at(weeks[0], cfg.tz)) & F.col("email").isNotNull()
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), week.cast("int"))

    def seen(value: str) -> Column:
        return F.coalesce(F.bit_or(F.when((step == value) & in_weeks, bit)), F.lit(0).cast("bigint"))

    people = (
        snapshot(checkpoints, "checkpoints", as_of, tz=cfg.tz).groupBy(norm_cadence().alias("cadence_id"), "email")
        .agg(F.min(start).alias("start_ts"), F.max(start).alias("last_start_ts"), F.min(leave).alias("first_exit"), F.max(leave).alias("last_exit"),
             seen("Start").alias("entered"), seen("Exit").alias("left"))
    )
    stuck = seq.still_in("start_ts", cfg) & (F.date_diff(F.lit(as_of), bucket("start_ts", "day", cfg.tz)) >= cfg.stuck_days)

    def per_week(mask: str) -> Column:
        return F.array(*[F.sum(F.call_function("getbit", F.col(mask), F.lit(i)).cast("bigint")) for i in range(len(weeks))])

    return people.filter("cadence_id IS NOT NULL").groupBy("cadence_id").agg(
        F.max("last_start_ts").alias("last_start_ts"), F.count_if(stuck).alias("d4_stuck"),
        per_week("entered").alias("entries"), per_week("left").alias("exits"))


def _falls(weekly: Column, cfg: Config) -> Column:
    """For each complete week after the first whether it fell by `wow_drop` or more against the week before."""
    before, week = F.slice(weekly, 1, cfg.n_weeks - 2), F.slice(weekly, 2, cfg.n_weeks - 2)
    return F.zip_with(before, week, lambda b, w: F.coalesce(F.round((w - b) / F.nullif(b, F.lit(0)), 4) <= -cfg.wow_drop, F.lit(False)))


def diagnose(
    checkpoints: DataFrame, steps: DataFrame, as_of: date, cfg: Config = Config(), cadences: DataFrame | None = None
) -> DataFrame:
    """One row per sequence: findings of each of the eight checks, clean only if all eight have none.

    A weekly check counts the complete weeks that fell by `wow_drop` or more against the week before; the week of
    `as_of` has not had its time yet. Checkpoints are read three times: one fold per person for checks 1, 4, 5 and the names, the order of
    events for checks 2 and 3, and the recent days for check 8.
    """
    events = seq.all_events(snapshot(checkpoints, "checkpoints", as_of, tz=cfg.tz))
    worked = weekly_steps(steps, as_of, cfg)

    def fell(metric: str) -> Column:
        dropped = F.col(f"{metric}_wow") <= -cfg.wow_drop
        return F.coalesce(F.count_if(dropped & (F.col("week_start") < F.lit(monday(as_of)))), F.lit(0))

    def found(df: DataFrame, **hits: Column) -> DataFrame:
        return df.groupBy("cadence_id").agg(*[e.alias(c) for c, e in hits.items()])

    faulty = F.col("payload_class").isin("unknown step", "malformed step", "unknown status", "malformed status")
    silent = F.date_diff(F.lit(as_of), bucket("last_start_ts", "day", cfg.tz)) >= cfg.silent_days
    either = F.zip_with(_falls(F.col("entries"), cfg), _falls(F.col("exits"), cfg), lambda e, x: e | x)
    people = profile(checkpoints, as_of, cfg).select(
        "cadence_id", F.lit(1).alias("known"), F.when(silent, 1).otherwise(0).alias("d1_no_starts"), "d4_stuck",
        F.size(F.filter(either, lambda f: f)).alias("d5_entry_exit_drops"))
    parts = [
        seq.all_doubles_by_cadence(events, cfg).select(
            "cadence_id", F.col("double_starts").alias("d2_double_starts"), F.col("double_exits").alias("d3_double_exits")),
        found(worked, d6_surfaced_drops=fell("steps_surfaced"), d7_completed_drops=fell("steps_completed")),
        found(payload_profile(checkpoints, as_of, cfg), d8_faulty_payloads=F.sum(F.when(faulty, F.col("rows")).otherwise(0))),
    ]
    checks = [
        "d1_no_starts", "d2_double_starts", "d3_double_exits", "d4_stuck", "d5_entry_exit_drops", "d6_surfaced_drops",
        "d7_completed_drops", "d8_faulty_payloads",
    ]
    if cadences is not None:
        asked = cadences.select("cadence_id").distinct()
        people, parts = people.drop("known"), [*parts, asked.withColumn("known", F.lit(1))]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts, people)
    return (
        stacked.groupBy("cadence_id")
        .agg(F.max("known").alias("known"), *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in checks])
        .filter("known = 1 AND cadence_id IS NOT NULL").drop("known")
        .withColumn("clean", reduce(lambda a, b: a & b, [F.col(c) == 0 for c in checks]))
    )


# corroboration -------------------------------------------------------------------------------------

def corroborating_events(
    flagged: DataFrame, checkpoints: DataFrame, changes: DataFrame, days: int = 7, person: str = "user_id",
    period: tuple[date, date] | None = None,
) -> DataFrame:
    """Changes to the people of a flagged sequence within `days` of the flagged week.

    It states that things happened at the same time, never that one caused the other. A flagged week is unfolded to its days, so that
    the band becomes an equality. Before anything is shuffled, changes are cut to the flagged days and checkpoints to the flagged
    sequences; changes of others than their members go before the count. `period` holds the first and the last flagged week start: with it
    the scan of the changes is bounded, too.
    """
    weeks = flagged.select("cadence_id", "week_start").distinct()
    band = F.sequence(F.date_sub("week_start", days), F.date_add("week_start", 6 + days))
    dates = weeks.select("cadence_id", "week_start", F.explode(band).alias("day"))
    members = (
        checkpoints.select(norm_cadence().alias("cadence_id"), F.col(person).alias("id")).filter("id IS NOT NULL")
        .join(weeks.select("cadence_id").distinct(), "cadence_id", "left_semi").distinct()
    )
    seen = changes.filter("id IS NOT NULL")
    if period is not None:
        seen = seen.filter((F.col("changed_at") >= at(period[0] - timedelta(days=days))) & (F.col("changed_at") < at(period[1] + timedelta(days=7 + days))))
    near = seen.withColumn("day", F.to_date("changed_at")).join(dates.select("day").distinct(), "day", "left_semi")
    daily = (
        near.join(members.select("id").distinct(), "id", "left_semi")
        .groupBy("id", "field", "day").agg(F.count("*").alias("n"))
    )
    return (
        members.join(daily, "id").join(dates, ["cadence_id", "day"])
        .groupBy("cadence_id", "week_start", "field", "id").agg(F.sum("n").alias("n"))
        .groupBy("cadence_id", "week_start", "field")
        .agg(F.sum("n").alias("changes"), F.count("*").alias("people"))
    )
