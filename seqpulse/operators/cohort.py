"""Reads of the cohort mart."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from seqpulse.config import Config
from seqpulse.functions import ratio
from seqpulse.operators.marts import MEASURES


def _totals(cfg: Config) -> list[str]:
    return [f"{m}_{h}_days" for m in MEASURES for h in cfg.horizons]


def cohort_rollup(cohort: DataFrame, grain: str = "week", cfg: Config = Config()) -> DataFrame:
    """Measures per sequence and entry week or month."""
    return (
        cohort.groupBy("cadence_id", F.trunc("entry_dt", grain).alias("entry_period"))
        .agg(F.count("*").alias("entries"), *[F.sum(t).alias(t) for t in _totals(cfg)])
    )


def _periods(cohort: DataFrame, horizon: int, as_of: date | None, grain: str | None) -> tuple[DataFrame, list[str]]:
    """The cohort with `mature` (old enough at `as_of` for the horizon to be over; all, where no day is given), and the keys of a period."""
    mature = F.lit(True) if as_of is None else F.coalesce(F.date_diff(F.lit(as_of), "entry_dt") >= horizon, F.lit(False))
    marked = cohort.withColumn("mature", mature)
    return (marked, []) if grain is None else (marked.withColumn("entry_period", F.trunc("entry_dt", grain)), ["entry_period"])


def conversion_funnel(cohort: DataFrame, horizon: int = 60, as_of: date | None = None, grain: str | None = None) -> DataFrame:
    """Entries that reached each stage at least once, with the rate against the stage before and against entries.

    Both enrolment types are compared with the demos attended. With `as_of` only entries old enough for the horizon are counted, as
    the others had no time to convert: stage 0 is `mature_entries`, and `all_entries` stands beside it. `grain` splits by entry week or month.
    """
    before = dict(zip(MEASURES, ["entries", *MEASURES[:6], "demo_attended"]))
    marked, period = _periods(cohort, horizon, as_of, grain)
    mature = F.col("mature")
    reached = marked.groupBy("cadence_id", *period).agg(
        F.count("*").alias("all_entries"), F.count_if(mature).alias("entries"),
        *[F.count_if(mature & (F.col(f"{m}_{horizon}_days") > 0)).alias(m) for m in MEASURES]
    )

    def stage(position: int, name: str, previous: str) -> Column:
        return F.struct(
            F.lit(position).alias("stage_no"), F.lit(name).alias("stage"), F.col(name).alias("reached"),
            ratio(F.col(name), F.col(previous)).alias("step_rate"),
            ratio(F.col(name), F.col("entries")).alias("cumulative_rate"),
        )

    stages = [stage(0, "entries", "entries"), *[stage(i, m, before[m]) for i, m in enumerate(MEASURES, 1)]]
    beside = [] if as_of is None else ["all_entries", F.col("entries").alias("mature_entries")]
    return reached.select("cadence_id", *period, *beside, F.inline(F.array(*stages)))


def test_vs_control(
    cohort: DataFrame, horizon: int = 60, by: str | None = None, as_of: date | None = None, grain: str | None = None
) -> DataFrame:
    """Mean measure per entry of the treated and of the held-out population, and their difference.

    `by="entry_group"` also splits by landing group, `grain` by entry week or month. With `as_of` both means are over
    entries old enough for the horizon alone, and `all_entries` tells how many there are of any age.
    """
    marked, period = _periods(cohort, horizon, as_of, grain)
    keys = ["cadence_id", *([by] if by else []), *period]
    treated, held = F.col("mature") & (F.col("test_flag") == 0), F.col("mature") & (F.col("test_flag") == 1)
    sums = marked.groupBy(*keys).agg(
        F.count("*").alias("all_entries"),
        F.count_if(treated).alias("treatment_entries"), F.count_if(held).alias("control_entries"),
        *[F.sum(F.when(treated, F.col(f"{m}_{horizon}_days"))).alias(f"{m}_t") for m in MEASURES],
        *[F.sum(F.when(held, F.col(f"{m}_{horizon}_days"))).alias(f"{m}_c") for m in MEASURES],
    )

    def compared(m: str) -> Column:
        t = ratio(F.col(f"{m}_t"), F.col("treatment_entries"))
        c = ratio(F.col(f"{m}_c"), F.col("control_entries"))
        return F.struct(
            F.lit(m).alias("measure"), t.alias("treatment_mean"), c.alias("control_mean"),
            F.round(t - c, 4).alias("difference"),
        )

    beside = [] if as_of is None else ["all_entries"]
    return sums.select(*keys, *beside, "treatment_entries", "control_entries", F.inline(F.array(*map(compared, MEASURES))))


test_vs_control.__test__ = False


def with_maturity(cohort: DataFrame, as_of: date, cfg: Config = Config()) -> DataFrame:
    """Whether an entry is old enough for each window to be complete."""
    age = F.date_diff(F.lit(as_of), "entry_dt")
    return cohort.withColumns(
        {"cohort_age_days": age, **{f"mature_{h}_days": age >= h for h in cfg.horizons}}
    )


def maturity(cohort: DataFrame, as_of: date, grain: str = "month", cfg: Config = Config()) -> DataFrame:
    """Entries per period and how many of them are mature."""
    marked = with_maturity(cohort, as_of, cfg)
    return marked.groupBy("cadence_id", F.trunc("entry_dt", grain).alias("entry_period")).agg(
        F.count("*").alias("entries"), *[F.count_if(f"mature_{h}_days").alias(f"mature_{h}_days") for h in cfg.horizons]
    )
