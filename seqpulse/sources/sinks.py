"""Where results go: Parquet by default, CSV on request."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from seqpulse.sources.schema import SCHEMAS


def write_mart(
    df: DataFrame, path: str, date_column: str | None = None, mode: str = "overwrite", only_months: bool = False
) -> None:
    """Write a mart, one folder per month of `date_column`; `only_months` replaces the months that occur in `df` and leaves the others.

    Rows of a month are first brought together, so that a run does not leave one small file per task and month; the
    rebalancing splits months that are too large for one file.
    """
    if date_column is None:
        df.write.mode(mode).parquet(path)
        return
    month = f"{date_column}_month"
    (
        df.withColumn(month, F.trunc(F.col(date_column), "month")).hint("rebalance", F.col(month))
        .write.mode(mode).option("partitionOverwriteMode", "dynamic" if only_months else "static").partitionBy(month).parquet(path)
    )


def write_feed(feed: DataFrame, path: str, run_date: date) -> None:
    """One folder per run; writing a run again replaces that run, also when it now finds nothing."""
    feed.write.mode("overwrite").parquet(f"{path}/run_date={run_date.isoformat()}")


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """The feed of all runs, with the day of each."""
    schema = T.StructType([*SCHEMAS["alert_feed"].fields, T.StructField("run_date", T.DateType())])
    return spark.read.schema(schema).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
