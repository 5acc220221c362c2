"""Comparison of a period with the mean and deviation of the periods before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from seqpulse.config import Config


def baseline(
    series: DataFrame, metrics: list[str], length: int, time_column: str = "week_start", key: str = "cadence_id"
) -> DataFrame:
    """Trailing mean, sample deviation and number of periods for each metric, the current period left out.

    All metrics share one window, hence one shuffle and sort. The variance comes from exact integer sums, so that
    a value on the threshold is decided the same way on every engine and partitioning.
    """
    trailing = Window.partitionBy(key).orderBy(time_column).rowsBetween(-length, -1)
    wide = {m: F.col(m).cast("decimal(18,0)") for m in metrics}
    sums: dict[str, Column] = {}
    for m in metrics:
        sums[f"{m}_n"] = F.count(m).over(trailing)
        sums[f"{m}_s"] = F.sum(wide[m]).over(trailing)
        sums[f"{m}_ss"] = F.sum(wide[m] * wide[m]).over(trailing)
    summed = series.withColumns(sums)
    stats: dict[str, Column] = {}
    for m in metrics:
        n, s, ss = F.col(f"{m}_n"), F.col(f"{m}_s").cast("decimal(19,0)"), F.col(f"{m}_ss")
        spread = (n.cast("decimal(4,0)") * ss.cast("decimal(34,0)") - s * s).cast("double")
        stats[f"{m}_baseline_mean"] = s.cast("double") / F.nullif(n, F.lit(0))
        stats[f"{m}_baseline_sd"] = F.sqrt(spread / F.nullif(n * (n - 1), F.lit(0)))
        stats[f"{m}_baseline_n"] = n
    return summed.withColumns(stats).drop(*sums)


def _judged(metric: str, length: int, min_mean: float) -> Column:
    return (F.col(f"{metric}_baseline_n") >= length) & (F.col(f"{metric}_baseline_mean") >= min_mean)


def is_drop(metric: str, cfg: Config, length: int | None = None, min_mean: float | None = None) -> Column:
    mean, sd = F.col(f"{metric}_baseline_mean"), F.col(f"{metric}_baseline_sd")
    judged = _judged(metric, length or cfg.baseline_weeks, cfg.min_mean if min_mean is None else min_mean)
    return F.coalesce(judged & (F.col(metric) <= mean - cfg.n_sd * sd), F.lit(False))


def is_spike(metric: str, cfg: Config, length: int | None = None, min_mean: float | None = None) -> Column:
    mean, sd = F.col(f"{metric}_baseline_mean"), F.col(f"{metric}_baseline_sd")
    judged = _judged(metric, length or cfg.baseline_weeks, cfg.min_mean if min_mean is None else min_mean)
    return F.coalesce(judged & (F.col(metric) >= mean + cfg.n_sd * sd), F.lit(False))
