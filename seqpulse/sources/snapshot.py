"""The state of a table as it stood at the end of a day.

Replays and backfills see rows from after `as_of`; these filters are on the raw columns, so that they reach the
Parquet scan.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F

_CREATED = {
    "checkpoints": "event_timestamp",
    "comms": "comm_date",
    "changes": "changed_at",
    "steps": "createddate",
}
_DATED = {"activity": "activity_date", "eligible": "eligible_dt"}


def at(day: date, tz: str | None = None) -> Column:
    """Midnight at the start of `day`, in UTC or in a local zone, as an instant: a constant that reaches the scan."""
    midnight = F.lit(day).cast("timestamp")
    return F.to_utc_timestamp(midnight, tz) if tz else midnight


def day_after(as_of: date, tz: str | None = None) -> Column:
    return at(as_of + timedelta(days=1), tz)


def snapshot(df: DataFrame, table: str, as_of: date, floor: date | None = None, tz: str | None = None) -> DataFrame:
    """Rows known at the end of `as_of`, optionally only those since the start of `floor`; days of the zone, if one is given."""
    if table == "steps":
        return _steps(df, as_of, floor, tz)
    if table in _DATED:
        column = F.col(_DATED[table])
        kept = df.filter(column <= F.lit(as_of))
        return kept.filter(column >= F.lit(floor)) if floor else kept
    if table in _CREATED:
        column = F.col(_CREATED[table])
        kept = df.filter(column < day_after(as_of, tz))
        return kept.filter(column >= at(floor, tz)) if floor else kept
    return df


def _steps(df: DataFrame, as_of: date, floor: date | None, tz: str | None) -> DataFrame:
    """A step carries its outcome in the same row: a result from after `as_of` is still open at `as_of`."""
    end = day_after(as_of, tz)
    kept = df.filter(F.col("createddate") < end)
    if floor:
        kept = kept.filter((F.col("createddate") >= at(floor, tz)) | (F.col("result_date_time__c") >= at(floor, tz)))
    later = F.col("result_date_time__c") >= end
    return kept.withColumns({
        "result__c": F.when(~F.coalesce(later, F.lit(False)), F.col("result__c")),
        "result_date_time__c": F.when(~later, F.col("result_date_time__c")),
    })
