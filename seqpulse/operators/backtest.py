"""How often checks 2, 3, 4 and 6 would have fired on every day of a period, at several thresholds, from one pass over the days.

A check that is run for each day reads the history once a day. Here a person's days are turned into intervals of report days on which the
person counts (as active, stuck, in the cohort, engaged), and an interval into two changes, +1 at its first day and -1 after its last. Changes are added up
per sequence and day, and a running sum along the days gives the counts of each day.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from seqpulse.config import Config
from seqpulse.functions import bucket, contains_any, ratio
from seqpulse.operators import folds, slices as sl
from seqpulse.operators.alerts import received_by
from seqpulse.operators.clean import exclude_names
from seqpulse.operators.comms import name_bridge
from seqpulse.operators.sequence import PERSON
from seqpulse.sources import Tables, snapshot

#: Levels at which each check is judged where none are given; the standing ones are among them.
THRESHOLDS = {2: (0.05, 0.1, 0.2), 3: (0.05, 0.1, 0.2), 4: (0.05, 0.1, 0.2), 6: (0.05, 0.1, 0.2)}


def _shift(day: Column, days: Column | int) -> Column:
    return F.date_add(day, days if isinstance(days, Column) else F.lit(days))


def _interval(metric: str, first: Column, last: Column, metrics: Sequence[str]) -> list[Column]:
    """The two changes of one interval, none where it is empty."""
    def change(at: Column, by: int) -> Column:
        return F.struct(F.when(first <= last, at).alias("day"), *[F.lit(by if m == metric else 0).cast("bigint").alias(m) for m in metrics])
    return [change(first, 1), change(_shift(last, 1), -1)]


def _running(changes: DataFrame, keys: list[str], metrics: list[str], first: date, last: date) -> DataFrame:
    """The running sums of changes on each day of the period; changes before it are its opening balance."""
    opening = F.greatest("day", F.lit(first))
    daily = changes.filter(F.col("day") <= F.lit(last)).groupBy(*keys, opening.alias("day")).agg(*[F.sum(m).alias(m) for m in metrics])
    folded = daily.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("day", F.struct(*metrics)))).alias("by_day"))
    spine = F.explode(F.sequence(F.lit(first), F.lit(last)))
    change = F.col("by_day")[F.col("day")]
    so_far = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    each = folded.withColumn("day", spine).select(*keys, "day", *[F.coalesce(change[m], F.lit(0)).alias(m) for m in metrics])
    return each.select(*keys, F.col("day").alias("as_of"), *[F.sum(m).over(so_far).alias(m) for m in metrics])


def _starts(days: DataFrame, *more: Column | str) -> DataFrame:
    """The days on which a person started, each with the start day before; `days` has one row per person and day."""
    in_order = Window.partitionBy(*PERSON).orderBy("day")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(F.when(F.col("first_start").isNotNull(), F.col("day"))).over(earlier)
    return days.select(*PERSON, "day", "first_start", before.alias("day_before"), *more).filter("first_start IS NOT NULL")


# 2, 3 ---------------------------------------------------------------------------------------------

def doubles_by_day(slices: DataFrame, first: date, last: date, cfg: Config = Config()) -> DataFrame:
    """The shares of checks 2 and 3 on each day. Whether an event repeats depends on earlier ones alone, so a day counts in each of the windows that hold it."""
    named = exclude_names(slices, cfg.recurring_substrings).filter(F.col("day") <= F.lit(last))
    sums = [("n_start", "total_starts"), ("n_exit", "total_exits"), ("double_starts", "double_starts"), ("double_exits", "double_exits")]
    daily = sl.chained(named).filter(F.col("day") >= F.lit(first - timedelta(days=cfg.double_days))).groupBy("cadence_id", "day").agg(
        *[F.sum(c).alias(c) for c, _ in sums])
    reports = F.explode(F.sequence(F.greatest("day", F.lit(first)), F.least(_shift(F.col("day"), cfg.double_days), F.lit(last))))
    return (
        daily.withColumn("as_of", reports).groupBy("cadence_id", "as_of").agg(*[F.sum(c).alias(name) for c, name in sums])
        .withColumns({"double_start_pct": ratio(F.col("double_starts"), F.col("total_starts")),
                      "double_exit_pct": ratio(F.col("double_exits"), F.col("total_exits"))})
    )


# 4 ------------------------------------------------------------------------------------------------

def stuck_by_day(slices: DataFrame, first: date, last: date, cfg: Config = Config(), windows: Sequence[int] | None = None) -> DataFrame:
    """Active and stuck people of check 4 on each day, for each length of the entrant window.

    A start day is the first one of the window from the day the one before has left it until it leaves itself. A person is in until the day of
    the exit that ends the stay; an exit of a later day is not known before.
    """
    named = exclude_names(slices, cfg.recurring_substrings).filter(F.col("day") <= F.lit(last))
    person = Window.partitionBy(*PERSON)
    later = person.orderBy("day").rowsBetween(1, Window.unboundedFollowing)
    left = F.when(F.col("last_exit").isNotNull(), F.col("day"))
    if cfg.exit_rule == "first":
        exit_ts, exit_day = F.min("first_exit").over(person), F.min(left).over(person)
        leave = F.when(exit_ts > F.col("first_start"), exit_day)
    else:
        leave = F.when(F.col("last_exit") > F.col("first_start"), F.col("day")).otherwise(F.min(left).over(later))
    lengths = F.explode(F.array(*[F.lit(int(w)) for w in windows or [cfg.stuck_window]]))
    entered = _starts(named, leave.alias("leave_day")).withColumn("entrant_window", lengths)
    day, window = F.col("day"), F.col("entrant_window")
    opens = F.greatest(day, F.date_add("day_before", window + 1))
    closes = F.least(F.date_add(day, window), F.date_sub("leave_day", 1))
    metrics = ["active_pros", "stuck_pros"]
    changes = F.array(*_interval("active_pros", opens, closes, metrics),
                      *_interval("stuck_pros", F.greatest(opens, _shift(day, cfg.stuck_days)), closes, metrics))
    rows = entered.select("cadence_id", "entrant_window", F.inline(changes)).filter("day IS NOT NULL")
    return _running(rows, ["cadence_id", "entrant_window"], metrics, first, last).filter("active_pros > 0").withColumn(
        "stuck_pct", ratio(F.col("stuck_pros"), F.col("active_pros")))


# 6 ------------------------------------------------------------------------------------------------

def touches_by_day(tables: Tables, first: date, last: date, cfg: Config, cube: DataFrame) -> DataFrame:
    """cadence_id, email, day, touch: the last touch of each day, by a step or by a message of the sequence."""
    floor = first - timedelta(days=cfg.engage_band[1])
    people = cube.filter("starts > 0").select("cadence_id", "email").distinct()
    sent = snapshot(tables.comms, "comms", last, floor, cfg.tz).filter("comm_id IS NOT NULL AND workflow_name IS NOT NULL")
    # a message counts on each of its days: by id, workflow and day
    messages = sent.groupBy("comm_id", "workflow_name", bucket("comm_date", "day", cfg.tz).alias("sent_day")).agg(F.max("comm_date").alias("touch"))
    by_sequence = (
        messages.join(name_bridge(messages, people), "workflow_name")
        .groupBy("comm_id", "cadence_id", "sent_day").agg(F.max("touch").alias("touch"))
    )
    mailed = received_by(people, by_sequence, tables.email_msgs)
    return (
        cube.filter("last_touch IS NOT NULL").select("cadence_id", "email", F.col("last_touch").alias("touch"))
        .unionByName(mailed).groupBy("cadence_id", "email", bucket("touch", "day", cfg.tz).alias("day")).agg(F.max("touch").alias("touch"))
    )


def engagement_by_day(tables: Tables, first: date, last: date, cfg: Config = Config()) -> DataFrame:
    """Cohort and engaged people of check 6 on each day.

    A start day is the first one of the band while the one before is too old for it; the person is engaged from the day of the first touch at or after the start.
    """
    newest, oldest = cfg.engage_band
    span = (last - first).days
    cube = folds.day_cube(tables.checkpoints, tables.steps, last, cfg, floor=first - timedelta(days=oldest))
    cube = cube.filter("cadence_id IS NOT NULL").filter(~contains_any(F.col("cadence_id"), cfg.quiet_substrings))
    touches = touches_by_day(tables, first, last, cfg, cube)
    started = cube.filter("first_start IS NOT NULL").select(*PERSON, "day", "first_start", F.lit(None).cast("timestamp").alias("touch"))
    line = started.unionByName(touches.select(*PERSON, "day", F.lit(None).cast("timestamp").alias("first_start"), "touch")).groupBy(*PERSON, "day").agg(
        F.min("first_start").alias("first_start"), F.max("touch").alias("touch"))
    later = Window.partitionBy(*PERSON).orderBy("day").rowsBetween(1, Window.unboundedFollowing)
    touched = F.when(F.col("touch").isNotNull(), F.col("day"))
    engaged_day = F.when(F.col("touch") >= F.col("first_start"), F.col("day")).otherwise(F.min(touched).over(later))
    entered = _starts(line, engaged_day.alias("engaged_day"))
    day = F.col("day")
    opens, closes = F.greatest(_shift(day, newest), _shift(F.col("day_before"), oldest + 1)), _shift(day, oldest)
    metrics = ["cohort_size", "engaged_count"]
    never = F.lit(last + timedelta(days=span + oldest + 1))
    changes = F.array(*_interval("cohort_size", opens, closes, metrics),
                      *_interval("engaged_count", F.greatest(opens, F.coalesce("engaged_day", never)), closes, metrics))
    rows = entered.select("cadence_id", F.inline(changes)).filter("day IS NOT NULL")
    return _running(rows, ["cadence_id"], metrics, first, last).filter("cohort_size > 0").withColumn(
        "engaged_pct", ratio(F.col("engaged_count"), F.col("cohort_size")))


# all ----------------------------------------------------------------------------------------------

def _fires(rates: DataFrame, check: int, metric: str, levels: Sequence[float], compare: str) -> DataFrame:
    window = F.col("entrant_window") if "entrant_window" in rates.columns else F.lit(None).cast("int")
    value, level = F.col(metric), F.col("threshold")
    fires = {"above": value > level, "reached": value >= level, "below": value < level}[compare]
    return (
        rates.filter(value.isNotNull()).select("as_of", metric, window.alias("entrant_window"), F.explode(F.array(*[F.lit(float(x)) for x in levels])).alias("threshold"))
        .groupBy("as_of", "entrant_window", "threshold").agg(F.count("*").alias("evaluated"), F.count_if(fires).alias("flagged"))
        .select(F.lit(check).alias("check_number"), "as_of", "entrant_window", "threshold", "evaluated", "flagged",
                F.round(F.col("flagged") / F.col("evaluated"), 4).alias("fire_rate"))
    )


def fire_rates(
    tables: Tables, first: date, last: date, cfg: Config = Config(), slices: DataFrame | None = None,
    thresholds: Mapping[int, Sequence[float]] = THRESHOLDS, windows: Sequence[int] | None = None,
) -> DataFrame:
    """check_number, as_of, entrant_window (check 4), threshold, evaluated, flagged, fire_rate for each day of the period.

    Each day's row is what `feed.fire_rate` gives for the check run on that day. A day without a sequence to evaluate has no row.
    `slices` are the stored `day_slices`; they must reach back to the first event.
    """
    days = sl.day_slices(tables.checkpoints, last, cfg) if slices is None else slices
    doubles = doubles_by_day(days, first, last, cfg)
    return (
        _fires(doubles, 2, "double_start_pct", thresholds[2], "above")
        .unionByName(_fires(doubles, 3, "double_exit_pct", thresholds[3], "above"))
        .unionByName(_fires(stuck_by_day(days, first, last, cfg, windows), 4, "stuck_pct", thresholds[4], "reached"))
        .unionByName(_fires(engagement_by_day(tables, first, last, cfg), 6, "engaged_pct", thresholds[6], "below"))
    )
