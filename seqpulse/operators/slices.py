"""State of checks 2 to 4 as one mergeable summary per person and day, so that events may arrive late.

A day's summary depends on that day's events alone: first and last start and exit, counts, the repeats inside the day, and its edges, that is
the last exit before the day's first start and the last start before its first exit. Whether the first start of a day repeats the one before is
decided when days are put together, from the edges and from what earlier days carry. Putting together is associative (minima, maxima
and sums over days in order), so a day whose events changed is summarised anew and replaced, and everything after it comes out right.
"""

from __future__ import annotations

import hashlib
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from seqpulse.config import Config
from seqpulse.functions import bucket, ratio
from seqpulse.operators import sequence as seq
from seqpulse.operators.clean import exclude_names
from seqpulse.operators.sequence import PERSON, STATE
from seqpulse.sources import snapshot
from seqpulse.sources.snapshot import at

SLICE = [
    *PERSON, "day", "n_start", "n_exit", "first_start", "last_start", "first_exit", "last_exit", "exit_before", "start_before",
    "double_starts", "double_exits",
]


def fingerprint(cfg: Config) -> str:
    """Of the parameters that shape a summary; stored beside them, and compared before they are used again."""
    return hashlib.sha256(repr((1, sorted(cfg.internal_domains), cfg.tz)).encode()).hexdigest()


def _runs(days: list[date]) -> list[tuple[date, date]]:
    """Days as runs of consecutive ones, first and last."""
    runs: list[tuple[date, date]] = []
    for d in sorted(set(days)):
        if runs and d - runs[-1][1] == timedelta(days=1):
            runs[-1] = runs[-1][0], d
        else:
            runs.append((d, d))
    return runs


def of_days(checkpoints: DataFrame, as_of: date, cfg: Config, days: list[date]) -> DataFrame:
    """Checkpoints of the given local days up to `as_of`; the bounds are on the raw column and reach the scan."""
    ts = F.col("event_timestamp")
    wanted = F.lit(False)
    for first, last in _runs(days):
        wanted = wanted | ((ts >= at(first, cfg.tz)) & (ts < at(last + timedelta(days=1), cfg.tz)))
    return snapshot(checkpoints, "checkpoints", as_of, min(days, default=None), cfg.tz).filter(wanted)


def day_slices(checkpoints: DataFrame, as_of: date, cfg: Config = Config(), days: list[date] | None = None) -> DataFrame:
    """The summaries of all days up to `as_of`, or of the given ones.

    The order of events comes from `event_sequence`, which spreads a person's events over slices of time.
    """
    rows = snapshot(checkpoints, "checkpoints", as_of, tz=cfg.tz) if days is None else of_days(checkpoints, as_of, cfg, days)
    events, ts = seq.external_events(rows, cfg), F.col("event_timestamp")
    day = bucket(ts, "day", cfg.tz)
    midnight = F.to_utc_timestamp(day.cast("timestamp"), cfg.tz) if cfg.tz else day.cast("timestamp")
    inside = seq.event_sequence(events, cfg).select(
        *PERSON, "event_timestamp", "n_start", "n_exit", day.alias("day"),
        *[F.when(F.col(c) >= midnight, F.col(c)).alias(c) for c in ("prev_start_ts", "prev_exit_ts")],
    )
    start, leave = F.when(F.col("n_start") > 0, ts), F.when(F.col("n_exit") > 0, ts)
    return inside.groupBy(*PERSON, "day").agg(
        F.sum("n_start").alias("n_start"), F.sum("n_exit").alias("n_exit"),
        F.min(start).alias("first_start"), F.max(start).alias("last_start"),
        F.min(leave).alias("first_exit"), F.max(leave).alias("last_exit"),
        F.min_by("prev_exit_ts", start).alias("exit_before"), F.min_by("prev_start_ts", leave).alias("start_before"),
        F.sum(seq.repeats("start")).alias("double_starts"), F.sum(seq.repeats("exit")).alias("double_exits"),
    ).select(SLICE)


def replaced(stored: DataFrame, checkpoints: DataFrame, as_of: date, cfg: Config, days: list[date]) -> DataFrame:
    """The stored summaries with those of the given days taken from the events anew."""
    others = stored.filter(~F.col("day").isin(*days)) if days else stored
    return others.select(SLICE).unionByName(day_slices(checkpoints, as_of, cfg, days)) if days else others


def person_state(slices: DataFrame, as_of: date, cfg: Config = Config()) -> DataFrame:
    """As `sequence.person_state`, put together from the days."""
    day = F.col("day")
    before, recent = day < F.lit(as_of - timedelta(days=cfg.double_days)), day >= F.lit(as_of - timedelta(days=cfg.stuck_window))
    return (
        slices.filter(day <= F.lit(as_of)).groupBy(*PERSON)
        .agg(F.max(F.when(before, F.col("last_start"))).alias("start_before"), F.max(F.when(before, F.col("last_exit"))).alias("exit_before"),
             F.min(F.when(recent, F.col("first_start"))).alias("recent_start"),
             F.min("first_exit").alias("first_exit"), F.max("last_exit").alias("last_exit"))
        .select(*PERSON, *STATE)
    )


def _edge(first: str, last: str, other_last: str, edge: str, carried: tuple[Column, Column] | None) -> Column:
    """1 where the first event of a day repeats the last one of earlier days."""
    earlier = Window.partitionBy(*PERSON).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    previous, separator = F.max(last).over(earlier), F.max(other_last).over(earlier)
    if carried is not None:
        previous, separator = F.coalesce(previous, carried[0]), F.greatest(separator, carried[1])
    separator = F.greatest(separator, F.col(edge))
    repeats = F.col(first).isNotNull() & previous.isNotNull() & (separator.isNull() | (separator <= previous))
    return F.when(repeats, 1).otherwise(0)


def chained(slices: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """cadence_id, email, day, n_start, n_exit and all repeats of each day, those across days included.

    `state` carries what happened before the first of the days; without it they must be all days. A window holds one row per day of a person.
    """
    rows, starts, exits = slices, None, None
    if state is not None:
        carried = state.select(*PERSON, F.col("start_before").alias("s0"), F.col("exit_before").alias("e0"))
        rows = slices.join(carried, PERSON, "left")
        starts, exits = (F.col("s0"), F.col("e0")), (F.col("e0"), F.col("s0"))
    first_start = _edge("first_start", "last_start", "last_exit", "exit_before", starts)
    first_exit = _edge("first_exit", "last_exit", "last_start", "start_before", exits)
    return rows.select(
        *PERSON, "day", "n_start", "n_exit", (F.col("double_starts") + first_start).alias("double_starts"),
        (F.col("double_exits") + first_exit).alias("double_exits"))


def double_rates(slices: DataFrame, as_of: date, cfg: Config = Config(), state: DataFrame | None = None) -> DataFrame:
    """As `alerts.double_rates`, from the summaries of the trailing days and the state before them."""
    named = exclude_names(slices, cfg.recurring_substrings)
    history = person_state(named, as_of, cfg) if state is None else state
    recent = named.filter(F.col("day").between(F.lit(as_of - timedelta(days=cfg.double_days)), F.lit(as_of)))
    per_person = chained(recent, history).groupBy(*PERSON).agg(
        *[F.sum(c).alias(c) for c in ("n_start", "n_exit", "double_starts", "double_exits")])
    return (
        per_person.groupBy("cadence_id")
        .agg(F.sum("n_start").alias("total_starts"), F.sum("n_exit").alias("total_exits"),
             F.sum("double_starts").alias("double_starts"), F.sum("double_exits").alias("double_exits"),
             F.count_if(F.col("double_starts") > 0).alias("double_start_people"), F.count_if(F.col("double_exits") > 0).alias("double_exit_people"))
        .withColumns({"double_start_pct": ratio(F.col("double_starts"), F.col("total_starts")),
                      "double_exit_pct": ratio(F.col("double_exits"), F.col("total_exits"))})
    )
