"""The batch jobs. Their only output is tables."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from seqpulse.config import Config
from seqpulse.functions import bucket
from seqpulse.operators import alerts, feed as feeds, folds, marts, slices
from seqpulse.session import configure, durable
from seqpulse.sources import Tables, read_feed, snapshot, write_feed, write_mart
from seqpulse.sources.snapshot import at


def run_alerts(
    spark: SparkSession, tables: Tables, as_of: date, cfg: Config, out: str, previous_day: date | None = None,
    late: DataFrame | None = None,
) -> DataFrame:
    """All nine checks into the feed folder of this run.

    What the checks share is stored first: one summary per person and day (`operators.slices`), the state put together from them, the list of sequences, the
    day cube and the mail fold. With `previous_day` the summaries and names of that run are carried forward and only the days since are
    read; `late` holds checkpoints that arrived after their day, whose days are summarised anew. Summaries of other parameters are refused.
    Running a day again replaces its own folders only.
    """
    configure(spark)
    cp = tables.checkpoints
    if previous_day is not None and previous_day >= as_of:
        raise ValueError(f"previous_day {previous_day} is not before {as_of}")
    if previous_day is None:
        days = slices.day_slices(cp, as_of, cfg)
        names = alerts.active_names(cp, as_of)
    else:
        stored = _read(spark, out, "day_slices", previous_day)
        made_with = _read(spark, out, "day_slices_made_with", previous_day).first()["fingerprint"]
        if made_with != slices.fingerprint(cfg):
            raise ValueError(f"the summaries of {previous_day} were made with other parameters; run without previous_day")
        fresh = [previous_day + timedelta(days=i) for i in range(1, (as_of - previous_day).days + 1)]
        days = slices.replaced(stored, cp, as_of, cfg, sorted({*fresh, *_days_of(late, as_of, cfg)}))
        known = _read(spark, out, "sequence_names", previous_day)
        recent = alerts.active_names(cp, as_of, floor=previous_day)
        names = known.union(recent if late is None else recent.union(alerts.active_names(late, as_of))).distinct()
    days = _store(days, out, "day_slices", as_of)
    _store(spark.createDataFrame([(slices.fingerprint(cfg),)], "fingerprint string"), out, "day_slices_made_with", as_of)
    state = _store(slices.person_state(days, as_of, cfg), out, "person_state", as_of)
    names = _store(names, out, "sequence_names", as_of)
    cube = _store(folds.day_cube(cp, tables.steps, as_of, cfg), out, "day_cube", as_of)
    mail = _store(folds.mail_fold(tables.comms, as_of, cfg), out, "mail_fold", as_of)
    rates = slices.double_rates(days, as_of, cfg, state)
    write_feed(feeds.alert_feed(tables, as_of, cfg, state, names, cube, mail, rates), f"{out}/alert_feed", as_of)
    return read_feed(spark, f"{out}/alert_feed")


def _days_of(late: DataFrame | None, as_of: date, cfg: Config) -> list[date]:
    """The local days of late rows: as many as the history has days at most."""
    if late is None:
        return []
    seen = snapshot(late, "checkpoints", as_of, tz=cfg.tz).select(bucket("event_timestamp", "day", cfg.tz).alias("day")).distinct()
    return [r["day"] for r in seen.filter("day IS NOT NULL").collect()]


def _read(spark: SparkSession, out: str, table: str, day: date) -> DataFrame:
    return spark.read.parquet(f"{out}/{table}/as_of={day.isoformat()}")


def _store(df: DataFrame, out: str, table: str, day: date) -> DataFrame:
    df.write.mode("overwrite").parquet(f"{out}/{table}/as_of={day.isoformat()}")
    return _read(df.sparkSession, out, table, day)


def run_digest(spark: SparkSession, today: date, cfg: Config, out: str, ledger: DataFrame | None = None) -> None:
    """The tables a sender needs, from the stored feed: messages, digest, overview, offenders, freshness, ledger.

    The feed holds alerts only and is small; it is brought to one row per id by its latest run first.
    """
    configure(spark)
    history = read_feed(spark, f"{out}/alert_feed").filter(F.col("run_date") <= F.lit(today))
    current = history.filter(F.col("run_date") == F.lit(today)).drop("run_date")
    latest = durable(feeds.freshest(history).drop("run_date"))
    period = feeds.digest_period(latest, today)
    results = {
        "urgent_messages": feeds.urgent_messages(current, _samples(spark, current, today, cfg, out)),
        "digest_message": feeds.digest_message(latest, today),
        "check_overview": feeds.check_overview(period),
        "top_by_severity": feeds.top_by_severity(period),
        "repeat_offenders": feeds.repeat_offenders(period),
        "staleness": feeds.staleness(latest, today, cfg),
    }
    if ledger is not None:
        # both sides hold all checks: an open alert is closed only if its check no longer has it
        results["actions"] = durable(feeds.reconcile(current, ledger, today))
        results["ledger"] = feeds.next_ledger(results["actions"], today)
    for name, df in results.items():
        df.write.mode("overwrite").parquet(f"{out}/digest/{name}/run_date={today.isoformat()}")


def _samples(spark: SparkSession, feed: DataFrame, today: date, cfg: Config, out: str) -> DataFrame | None:
    """The people behind today's alerts, where the run that found them left its summaries."""
    try:
        days, state = (_read(spark, out, name, today) for name in ("day_slices", "person_state"))
    except AnalysisException:
        return None
    return feeds.samples(feed, days, state, today, cfg)


def run_marts(
    spark: SparkSession, tables: Tables, as_of: date, cfg: Config, out: str, previous_day: date | None = None,
    late: DataFrame | None = None,
) -> None:
    """Checkpoint facts, entries, cohort performance and, where there are eligible rows, their counts.

    With `previous_day` the facts of the months since that run and of the months of `late` rows are written anew, and the counts of the days since; the
    other folders stay as they are. Entries may change at any time in the past, so entries and cohorts are written whole; the
    cohort mart reads the entries just written.
    """
    configure(spark)
    known = tables.as_of(as_of)
    months = None if previous_day is None else _months(previous_day, as_of) | {d.replace(day=1) for d in _days_of(late, as_of, replace(cfg, tz=None))}
    facts = marts.checkpoint_facts(_of_months(known.checkpoints, months), cfg).withColumn("event_dt", F.to_date("event_timestamp"))
    write_mart(facts, f"{out}/fact_cadence_checkpoints", "event_dt", only_months=months is not None)
    write_mart(marts.entries(tables.checkpoints, tables.account_map, as_of, cfg), f"{out}/detail_cadence_entries", "entry_dt")
    stored = spark.read.parquet(f"{out}/detail_cadence_entries").drop("entry_dt_month")
    write_mart(marts.cohort_performance(stored, tables.activity, as_of, cfg), f"{out}/cohort_cadence_performance", "entry_dt")
    if tables.eligible is not None:
        floor = None if previous_day is None else min(_months(previous_day, as_of))
        write_mart(marts.eligible_counts(tables.eligible, as_of, floor), f"{out}/eligible_counts", "eligible_dt", only_months=floor is not None)


def _months(after: date, as_of: date) -> set[date]:
    """First days of the months with a day after `after` up to `as_of`."""
    return {(after + timedelta(days=i)).replace(day=1) for i in range(1, (as_of - after).days + 1)}


def _of_months(checkpoints: DataFrame, months: set[date] | None) -> DataFrame:
    """Rows of the given months, by bounds on the raw column; all rows where none are given."""
    if months is None:
        return checkpoints
    ts, wanted = F.col("event_timestamp"), F.lit(False)
    for first in sorted(months):
        following = (first + timedelta(days=31)).replace(day=1)
        wanted = wanted | ((ts >= at(first)) & (ts < at(following)))
    return checkpoints.filter(wanted)
