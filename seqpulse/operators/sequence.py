"""Order of events per person: repeated starts or exits, and people who never leave.

One person's rows may be a large part of the table (a placeholder address, a replayed batch). Nothing here
brings all rows of a person into one task: copies are folded before the first shuffle, events are scanned within
slices of time, and only one summary row per slice is carried from slice to slice.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from seqpulse.config import Config
from seqpulse.functions import bucket, is_internal, norm_cadence
from seqpulse.sources import snapshot
from seqpulse.sources.snapshot import at

PERSON = ["cadence_id", "email"]
_NO_EMAIL = "\0"


def _starts_and_exits(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.filter(F.col("cadence_step").isin("Start", "Exit")).select(
        norm_cadence().alias("cadence_id"), "email", "cadence_step", "event_timestamp"
    ).filter(F.col("cadence_id").isNotNull())


def external_events(checkpoints: DataFrame, cfg: Config) -> DataFrame:
    """Starts and exits without internal traffic; all of them have an e-mail."""
    return _starts_and_exits(checkpoints).filter(~is_internal(F.col("email"), cfg.internal_domains))


def all_events(checkpoints: DataFrame) -> DataFrame:
    """All starts and exits, with a stand-in for a missing e-mail, so that the e-mail can be a join key."""
    return _starts_and_exits(checkpoints).withColumn("email", F.coalesce("email", F.lit(_NO_EMAIL)))


STATE = ["start_before", "exit_before", "recent_start", "first_exit", "last_exit"]


def _state_columns(as_of: date, cfg: Config, before_day: date | None = None) -> dict[str, Column]:
    ts, step = F.col("event_timestamp"), F.col("cadence_step")
    before = ts < at(before_day or as_of - timedelta(days=cfg.double_days), cfg.tz)
    recent = ts >= at(as_of - timedelta(days=cfg.stuck_window), cfg.tz)
    return {
        "start_before": F.when((step == "Start") & before, ts),
        "exit_before": F.when((step == "Exit") & before, ts),
        "recent_start": F.when((step == "Start") & recent, ts),
        "first_exit": F.when(step == "Exit", ts),
        "last_exit": F.when(step == "Exit", ts),
    }


def _fold_state(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*PERSON).agg(
        F.max("start_before").alias("start_before"), F.max("exit_before").alias("exit_before"),
        F.min("recent_start").alias("recent_start"),
        F.min("first_exit").alias("first_exit"), F.max("last_exit").alias("last_exit"),
    )


def person_state(checkpoints: DataFrame, as_of: date, cfg: Config, before_day: date | None = None) -> DataFrame:
    """One row per sequence and person: all that checks 2-4 need from the whole history.

    `start_before` and `exit_before` are the last ones before `before_day`, by default the first of the trailing
    days of checks 2 and 3. A single pass with map-side combine; a batch run stores it once for all checks.
    """
    events = external_events(snapshot(checkpoints, "checkpoints", as_of, tz=cfg.tz), cfg)
    return _fold_state(events.select(*PERSON, *[e.alias(c) for c, e in _state_columns(as_of, cfg, before_day).items()]))


def advance_state(
    previous: DataFrame, checkpoints: DataFrame, previous_day: date, as_of: date, cfg: Config
) -> DataFrame:
    """The state of `as_of` from a stored one of an earlier day and the events since.

    All but `recent_start` only ever grow to a later maximum or an earlier minimum, so that events met twice do no
    harm; `recent_start` is taken anew from its window. The scan is floored at the older of the window and the
    days the stored state had not closed yet. Events that arrive after their day need a state from the history.
    """
    floor = min(previous_day - timedelta(days=cfg.double_days), as_of - timedelta(days=cfg.stuck_window))
    events = external_events(snapshot(checkpoints, "checkpoints", as_of, floor, cfg.tz), cfg)
    fresh = events.select(*PERSON, *[e.alias(c) for c, e in _state_columns(as_of, cfg).items()])
    kept = previous.select(*PERSON, *STATE).withColumn("recent_start", F.lit(None).cast("timestamp"))
    return _fold_state(kept.unionByName(fresh))


def event_sequence(events: DataFrame, cfg: Config, state: DataFrame | None = None) -> DataFrame:
    """Per person and instant: how many starts and exits, and the last start and exit strictly before.

    `events` has cadence_id, email (never NULL), cadence_step and event_timestamp; `state` carries what happened
    before the first of them. Both the scan within a slice and the summary of the slices read the same folded
    rows, whose shuffle Spark then reuses.
    """
    ts, step = F.col("event_timestamp"), F.col("cadence_step")
    sliced = [*PERSON, "slice"]
    # the join below implies that its keys are never NULL; said here, both of its inputs have the same plan
    instants = (
        events.withColumn("slice", F.floor(F.unix_seconds(ts) / cfg.slice_seconds))
        .filter("slice IS NOT NULL AND email IS NOT NULL AND cadence_id IS NOT NULL")
        .groupBy(*sliced, "event_timestamp")
        .agg(F.count_if(step == "Start").alias("n_start"), F.count_if(step == "Exit").alias("n_exit"))
    )
    started, exited = F.when(F.col("n_start") > 0, ts), F.when(F.col("n_exit") > 0, ts)

    earlier = Window.partitionBy(*sliced).orderBy("event_timestamp").rowsBetween(Window.unboundedPreceding, -1)
    within = instants.select(
        *sliced, "event_timestamp", "n_start", "n_exit",
        F.max(started).over(earlier).alias("start_within"), F.max(exited).over(earlier).alias("exit_within"),
    )

    slices = instants.groupBy(*sliced).agg(F.max(started).alias("last_start"), F.max(exited).alias("last_exit"))
    earlier_slices = Window.partitionBy(*PERSON).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select(
        *sliced,
        F.max("last_start").over(earlier_slices).alias("start_carried"),
        F.max("last_exit").over(earlier_slices).alias("exit_carried"),
    )
    if state is not None:
        carried = carried.join(state.select(*PERSON, "start_before", "exit_before"), PERSON, "left").select(
            *sliced,
            F.coalesce("start_carried", "start_before").alias("start_carried"),
            F.coalesce("exit_carried", "exit_before").alias("exit_carried"),
        )
    return within.join(carried, sliced).select(
        *PERSON, "event_timestamp", "n_start", "n_exit",
        F.coalesce("start_within", "start_carried").alias("prev_start_ts"),
        F.coalesce("exit_within", "exit_carried").alias("prev_exit_ts"),
    )


def _repeat(event: str) -> tuple[Column, Column, Column]:
    """Count, previous instant, and whether the first event of an instant repeats the one before.

    The bounds are strict: a separator at the very time of either event does not separate. A separator without
    an e-mail belongs to nobody.
    """
    other = "exit" if event == "start" else "start"
    count, previous, separator = F.col(f"n_{event}"), F.col(f"prev_{event}_ts"), F.col(f"prev_{other}_ts")
    unseparated = (F.col("email") == _NO_EMAIL) | separator.isNull() | (separator <= previous)
    return count, previous, (count > 0) & previous.isNotNull() & unseparated


def repeats(event: str) -> Column:
    """How many of the events at an instant repeat: all but the first, and the first if nothing lay between."""
    count, _, first_repeats = _repeat(event)
    return F.when(count > 0, count - 1 + first_repeats.cast("int")).otherwise(F.lit(0))


def double_events(events: DataFrame, cfg: Config, event: str, state: DataFrame | None = None) -> DataFrame:
    """Starts (or exits) that follow another one with no exit (start) strictly between.

    One row per person, previous and current time; `copies` counts events that share all of them.
    """
    sequence = event_sequence(events, cfg, state)
    count, previous, first_repeats = _repeat(event)
    now = F.col("event_timestamp")
    pairs = F.array(
        F.struct(previous.alias(f"prev_{event}_ts"), F.when(first_repeats, 1).otherwise(0).cast("bigint").alias("copies")),
        F.struct(now.alias(f"prev_{event}_ts"), F.greatest(count - 1, F.lit(0)).alias("copies")),
    )
    return (
        sequence.select(
            "cadence_id", F.nullif("email", F.lit(_NO_EMAIL)).alias("email"), now.alias(f"this_{event}_ts"), F.inline(pairs)
        )
        .filter("copies > 0")
    )


def double_starts(checkpoints: DataFrame, as_of: date, cfg: Config = Config()) -> DataFrame:
    """All second starts of the whole history, all domains."""
    return double_events(all_events(snapshot(checkpoints, "checkpoints", as_of, tz=cfg.tz)), cfg, "start")


def double_exits(checkpoints: DataFrame, as_of: date, cfg: Config = Config()) -> DataFrame:
    return double_events(all_events(snapshot(checkpoints, "checkpoints", as_of, tz=cfg.tz)), cfg, "exit")


def doubles_by_cadence(
    checkpoints: DataFrame, as_of: date, cfg: Config, state: DataFrame | None = None
) -> DataFrame:
    """Per sequence, over the trailing days: starts, exits, the repeats among them and the people concerned.

    Only the trailing days are scanned in order; all earlier history enters through `state`.
    """
    history = person_state(checkpoints, as_of, cfg) if state is None else state
    recent = external_events(
        snapshot(checkpoints, "checkpoints", as_of, as_of - timedelta(days=cfg.double_days), cfg.tz), cfg
    )
    return _count_doubles(event_sequence(recent, cfg, history))


def all_doubles_by_cadence(events: DataFrame, cfg: Config) -> DataFrame:
    """The same counts over all the events given."""
    return _count_doubles(event_sequence(events, cfg))


def _count_doubles(sequence: DataFrame) -> DataFrame:
    per_person = sequence.groupBy(*PERSON).agg(
        F.sum("n_start").alias("starts"), F.sum("n_exit").alias("exits"),
        F.sum(repeats("start")).alias("double_starts"), F.sum(repeats("exit")).alias("double_exits"),
    )
    named = F.col("email") != _NO_EMAIL
    return per_person.groupBy("cadence_id").agg(
        F.sum("starts").alias("total_starts"), F.sum("exits").alias("total_exits"),
        F.sum("double_starts").alias("double_starts"), F.sum("double_exits").alias("double_exits"),
        F.count_if(named & (F.col("double_starts") > 0)).alias("double_start_people"),
        F.count_if(named & (F.col("double_exits") > 0)).alias("double_exit_people"),
    )


def daily_doubles(events: DataFrame, cfg: Config, event: str, state: DataFrame | None = None) -> DataFrame:
    """Repeats per sequence and day."""
    return (
        event_sequence(events, cfg, state)
        .withColumn("n", repeats(event)).filter("n > 0")
        .groupBy("cadence_id", bucket("event_timestamp", "day", cfg.tz).alias("day")).agg(F.sum("n").alias("doubles"))
    )


def still_in(first_start: str, cfg: Config) -> Column:
    """In by the first-exit rule, or by the stricter rule that any later exit ends the stay.

    The first exit may lie before the start; under the first rule such a person stays in for good.
    """
    leave = F.col("first_exit" if cfg.exit_rule == "first" else "last_exit")
    return F.col(first_start).isNotNull() & (leave.isNull() | (leave <= F.col(first_start)))


def stuck(checkpoints: DataFrame, as_of: date, cfg: Config = Config()) -> DataFrame:
    """People who entered `stuck_days` or more ago and have not left. All history, all domains."""
    ts, step = F.col("event_timestamp"), F.col("cadence_step")
    # an exit without an e-mail belongs to nobody
    left = F.when((step == "Exit") & F.col("email").isNotNull(), ts)
    return (
        _starts_and_exits(snapshot(checkpoints, "checkpoints", as_of, tz=cfg.tz))
        .groupBy(*PERSON)
        .agg(F.min(F.when(step == "Start", ts)).alias("start_ts"),
             F.min(left).alias("first_exit"), F.max(left).alias("last_exit"))
        .filter(still_in("start_ts", cfg))
        .withColumn("days_in_cadence", F.date_diff(F.lit(as_of), bucket("start_ts", "day", cfg.tz)))
        .filter(F.col("days_in_cadence") >= cfg.stuck_days)
        .select(*PERSON, "start_ts", "days_in_cadence")
    )
