"""Day, week and month buckets and zero-filled series. Weeks start on Monday."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F


def monday(day: date) -> date:
    return day - timedelta(days=day.weekday())


def weeks_back(as_of: date, n_weeks: int, include_current: bool = True) -> list[date]:
    """The last `n_weeks` week starts up to the week of `as_of`, which may be left out as incomplete."""
    last = monday(as_of)
    weeks = [last - timedelta(weeks=i) for i in range(n_weeks - 1, -1, -1)]
    return weeks if include_current else weeks[:-1]


def bucket(ts: str | Column, grain: str = "week", tz: str | None = None) -> Column:
    """Start of the day, week or month, in UTC or in a local zone.

    Filters belong on the raw column: a floor on the bucket does not reach the scan.
    """
    ts = F.col(ts) if isinstance(ts, str) else ts
    day = F.to_date(F.from_utc_timestamp(ts, tz) if tz else ts)
    return day if grain == "day" else F.trunc(day, grain)


def zero_fill(
    series: DataFrame,
    metrics: list[str],
    spine: list[date],
    time_column: str = "week_start",
    key: str = "cadence_id",
    keys: DataFrame | None = None,
) -> DataFrame:
    """One row per key and spine date; metrics without a row become 0.

    The series is folded to one row per key (at most one entry per spine date) and unfolded along the spine, so
    that neither a cross join nor a second pass over the source is needed. Keys come from the series itself, or
    from `keys`, which may name some that have no rows at all.
    """
    entry = F.struct(time_column, F.struct(*metrics))
    folded = (
        series.filter(F.col(key).isNotNull() & F.col(time_column).between(F.lit(spine[0]), F.lit(spine[-1])))
        .groupBy(key)
        .agg(F.map_from_entries(F.collect_list(entry)).alias("by_date"))
    )
    if keys is not None:
        folded = keys.select(key).filter(F.col(key).isNotNull()).distinct().join(folded, key, "left")
    dates = F.array(*[F.lit(d) for d in spine])
    found = F.col("by_date")[F.col(time_column)]
    return folded.withColumn(time_column, F.explode(dates)).select(
        key, time_column,
        *[F.coalesce(found[m], F.lit(0)).cast("bigint").alias(m) for m in metrics],
    )


def fill_weeks(series, metrics, as_of, n_weeks, include_current=True, keys=None, key="cadence_id") -> DataFrame:
    return zero_fill(series, metrics, weeks_back(as_of, n_weeks, include_current), "week_start", key, keys)


def fill_days(series, metrics, as_of, n_days, keys=None, key="cadence_id") -> DataFrame:
    days = [as_of - timedelta(days=i) for i in range(n_days - 1, -1, -1)]
    return zero_fill(series, metrics, days, "day", key, keys)
