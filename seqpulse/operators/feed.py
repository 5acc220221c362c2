"""One feed for all checks, and what is read from it: routing, ledger, digest and messages."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from seqpulse.config import Config
from seqpulse.functions import bucket
from seqpulse.operators import alerts, folds, slices
from seqpulse.operators.baseline import is_drop, is_spike
from seqpulse.operators.sequence import still_in
from seqpulse.sources import Tables

# The number, name and tier of each check, as readers of the feed know them.
CHECKS = {
    1: ("No Starts in 7 Days", "urgent"),
    2: ("Double Starts", "urgent"),
    3: ("Double Exits", "urgent"),
    4: ("Entered Not Exited in 100+ Days", "urgent"),
    5: ("Drop in Weekly Entries/Exits", "report"),
    6: ("Low Engagement on Recent Starts", "urgent"),
    7: ("Drop in Steps Surfaced", "report"),
    8: ("Drop in Steps Completed", "report"),
    9: ("Email Volume Drops/Spikes", "report"),
}
FEED_COLUMNS = [
    "id", "check_number", "check_name", "cadence_id", "sub_key", "metric_value", "reference_value", "detail", "as_of",
]
REPORT_TITLE = "Cadence Alerts Report"


# the feed -----------------------------------------------------------------------------------------

def _text(**parts: Column) -> Column:
    """`name=value; name=value`, with an empty value where it is NULL."""
    pieces = [F.concat(F.lit(f"{name}="), F.coalesce(value.cast("string"), F.lit(""))) for name, value in parts.items()]
    return F.concat_ws("; ", *pieces)


def _tenths(column: str) -> Column:
    """One decimal in plain notation."""
    return F.round(column, 1).cast("decimal(38,1)")


def _alert(check: int, flagged: Column, metric: Column, reference: Column, detail: Column, as_of: Column,
           sub_key: str | None = None) -> Column:
    return F.struct(
        flagged.alias("flagged"),
        F.lit(check).alias("check_number"),
        F.lit(CHECKS[check][0]).alias("check_name"),
        F.lit(sub_key).cast("string").alias("sub_key"),
        metric.cast("double").alias("metric_value"),
        reference.cast("double").alias("reference_value"),
        detail.alias("detail"),
        as_of.alias("as_of"),
    )


def _emit(df: DataFrame, *rows: Column) -> DataFrame:
    return df.select("cadence_id", F.inline(F.array(*rows))).filter("flagged").drop("flagged")


def _against_baseline(check: int, series: str, flagged: Column, sub_key: str | None = None, **lead: Column) -> Column:
    detail = _text(**lead, baseline_sd=_tenths(f"{series}_baseline_sd"), week_start=F.col("week_start"))
    return _alert(check, flagged, F.col(series), F.round(f"{series}_baseline_mean", 1), detail, F.col("week_start"), sub_key)


def alert_feed(
    tables: Tables, as_of: date, cfg: Config = Config(), state: DataFrame | None = None, names: DataFrame | None = None,
    cube: DataFrame | None = None, mail: DataFrame | None = None, rates: DataFrame | None = None,
) -> DataFrame:
    """Every alert of every check as one row of nine columns. No rows means that nothing was found.

    Checks 1 and 5 to 9 are rolled up from the day cube and the mail fold (`operators.folds`), checks 2 to 4 from the state of each person. A batch
    run stores these and the list of `active_names`, and gives the `rates` of checks 2 and 3 from the stored slices: then no fact table is scanned here.
    """
    cp, steps = tables.checkpoints, tables.steps
    cube = folds.day_cube(cp, steps, as_of, cfg) if cube is None else cube
    mail = folds.mail_fold(tables.comms, as_of, cfg) if mail is None else mail
    names = alerts.active_names(cp, as_of) if names is None else names
    rates = alerts.double_rates(cp, as_of, cfg, state) if rates is None else rates
    today = F.lit(as_of)
    col = F.col

    silent = _emit(
        folds.start_recency(cube, as_of, cfg),
        _alert(1, col("starts_last_7d") == 0, col("starts_last_7d"), F.lit(cfg.silent_days),
               _text(last_start_ts=F.date_format("last_start_ts", "yyyy-MM-dd HH:mm:ss.SSS")), today),
    )
    doubled = _emit(
        rates,
        *[
            _alert(check, col(f"double_{e}_pct") > cfg.double_pct, col(f"double_{e}_pct"), F.lit(cfg.double_pct),
                   _text(**{f"double_{e}_count": col(f"double_{e}s"), f"total_{e}s_7d": col(f"total_{e}s"),
                            "pros_affected": col(f"double_{e}_people")}), today)
            for check, e in ((2, "start"), (3, "exit"))
        ],
    )
    stuck = _emit(
        alerts.stuck_rates(cp, as_of, cfg, state),
        _alert(4, col("stuck_pct") >= cfg.stuck_pct, col("stuck_pct"), F.lit(cfg.stuck_pct),
               _text(stuck_pros=col("stuck_pros"), active_pros=col("active_pros"),
                     longest_days_in_cadence=col("longest_days_in_cadence")), today),
    )
    weekly = _emit(
        folds.weekly_baselines(cube, as_of, cfg),
        *[_against_baseline(5, m, is_drop(m, cfg), m, metric=F.lit(m)) for m in ("entries", "exits")],
        *[_against_baseline(check, m, is_drop(m, cfg)) for check, m in ((7, "steps_surfaced"), (8, "steps_completed"))],
    )
    ignored = _emit(
        folds.engagement(cube, mail, tables.email_msgs, as_of, cfg),
        _alert(6, col("engaged_pct") < cfg.engage_pct, col("engaged_pct"), F.lit(cfg.engage_pct),
               _text(cohort_size=col("cohort_size"), engaged_count=col("engaged_count")), today),
    )
    mailed = _emit(
        folds.email_baselines(mail, names, as_of, cfg),
        _against_baseline(9, "email_volume", is_drop("email_volume", cfg), "drop", direction=F.lit("drop")),
        _against_baseline(9, "email_volume", is_spike("email_volume", cfg), "spike", direction=F.lit("spike")),
    )
    rows = silent
    for part in (doubled, stuck, weekly, ignored, mailed):
        rows = rows.unionByName(part)
    return rows.withColumn("id", row_id()).select(FEED_COLUMNS)


def row_id() -> Column:
    """The same period gives the same id, a new period a new one."""
    return F.concat_ws(
        "|", F.col("check_number"), F.coalesce("cadence_id", F.lit("")), F.col("as_of").cast("string"), F.col("sub_key")
    )


# routing and freshness ----------------------------------------------------------------------------

def tier() -> Column:
    urgent = [number for number, (_, t) in CHECKS.items() if t == "urgent"]
    return F.when(F.col("check_number").isin(*urgent), "urgent").otherwise("report")


def route(feed: DataFrame) -> DataFrame:
    return feed.withColumn("tier", tier())


def staleness(feed: DataFrame, today: date, cfg: Config = Config()) -> DataFrame:
    """One row: whether an empty result may be read as clean. An empty feed is stale too."""
    return feed.agg(F.max("as_of").alias("last_as_of")).select(
        "last_as_of",
        F.date_diff(F.lit(today), "last_as_of").alias("days_old"),
        (F.col("last_as_of").isNull() | (F.date_diff(F.lit(today), "last_as_of") > cfg.stale_days)).alias("is_stale"),
    )


def freshest(history: DataFrame, run_column: str = "run_date") -> DataFrame:
    """One row per id: the one of the latest run."""
    rest = [c for c in history.columns if c not in ("id", run_column)]
    return (
        history.groupBy("id").agg(F.max(F.struct(run_column, *rest)).alias("r"))
        .select(*[F.col("id") if c == "id" else F.col(f"r.{c}").alias(c) for c in history.columns])
    )


def upsert(history: DataFrame, new: DataFrame, run_column: str = "run_date") -> DataFrame:
    """Feed history after a run: known ids are replaced, new ones added."""
    return freshest(history.unionByName(new), run_column)


# ledger -------------------------------------------------------------------------------------------

def ledger_key() -> Column:
    """What makes an alert the same one on another day: weekly checks keep their week, daily ones have none."""
    week = F.when(tier() == "report", F.col("as_of").cast("string"))
    return F.concat_ws("|", week, F.col("sub_key"))


def reconcile(feed: DataFrame, ledger: DataFrame, today: date) -> DataFrame:
    """What to do about each alert: post a new one, reply to an open one (once a day), close one that is gone."""
    cadence = F.coalesce("cadence_id", F.lit("")).alias("cadence_id")
    now = feed.select("check_number", cadence, ledger_key().alias("key"), F.lit(True).alias("in_feed"))
    known = ledger.select("check_number", cadence, "key", "thread", "last_reply", F.lit(True).alias("in_ledger"))
    action = (
        F.when(F.col("in_ledger").isNull(), "post").when(F.col("in_feed").isNull(), "resolved")
        .when(F.col("last_reply") == F.lit(today), "skip").otherwise("reply")
    )
    return (
        now.distinct().join(known, ["check_number", "cadence_id", "key"], "full_outer")
        .select("check_number", "cadence_id", "key", "thread", "last_reply", action.alias("action"))
    )


def next_ledger(actions: DataFrame, today: date) -> DataFrame:
    """The ledger after the actions were carried out; the sender fills in the thread of a new entry."""
    answered = F.when(F.col("action").isin("post", "reply"), F.lit(today)).otherwise(F.col("last_reply"))
    return actions.filter("action != 'resolved'").select(
        "check_number", "cadence_id", "key", "thread", answered.alias("last_reply")
    )


# digest -------------------------------------------------------------------------------------------

def severity(missing_reference: Column | None = None) -> Column:
    """Distance from the reference; the metric itself where there is none (or against the given stand-in)."""
    if missing_reference is not None:
        return F.abs(F.col("metric_value") - F.coalesce("reference_value", missing_reference))
    return F.coalesce(F.abs(F.col("metric_value") - F.col("reference_value")), F.col("metric_value"))


def digest_period(feed: DataFrame, today: date) -> DataFrame:
    """Today's rows of the daily checks and those of the latest week of the weekly ones."""
    routed = route(feed)
    latest = routed.filter("tier = 'report'").groupBy("tier").agg(F.max("as_of").alias("latest"))
    return (
        routed.join(latest, "tier", "left")
        .filter(F.col("as_of") == F.when(F.col("tier") == "urgent", F.lit(today)).otherwise(F.col("latest")))
        .select(*FEED_COLUMNS, "tier")
    )


def top_by_severity(feed: DataFrame, n: int = 3) -> DataFrame:
    """The worst sequences of each check, each by its worst row."""
    worst = Window.partitionBy("check_number").orderBy(F.desc("severity"), "id")
    return (
        _worst_rows(feed.withColumn("severity", F.round(severity(), 4)))
        .withColumn("rank", F.row_number().over(worst)).filter(F.col("rank") <= n)
        .select("check_number", "check_name", "cadence_id", "sub_key", "as_of", "severity", "rank")
    )


def _worst_rows(feed: DataFrame) -> DataFrame:
    """One row per check and sequence, the one of the highest severity."""
    own = Window.partitionBy("check_number", "cadence_id").orderBy(F.desc("severity"), "id")
    return feed.withColumn("_place", F.row_number().over(own)).filter("_place = 1").drop("_place")


def repeat_offenders(feed: DataFrame, n: int | None = 3) -> DataFrame:
    """Sequences in the most distinct checks, names folded to upper case; ties by summed severity."""
    per_check = (
        feed.groupBy(F.upper("cadence_id").alias("cadence_upper"), "check_number")
        .agg(F.sum(severity(F.lit(0.0))).alias("s"), F.max("check_name").alias("check_name"))
    )
    named = F.transform(F.sort_array(F.collect_list(F.struct("check_number", "check_name"))), lambda c: c["check_name"])
    ranked = (
        per_check.groupBy("cadence_upper")
        .agg(F.count("*").alias("n_checks"), F.round(F.sum("s"), 4).alias("severity"),
             F.array_join(named, ", ").alias("checks"))
        .orderBy(F.desc("n_checks"), F.desc("severity"), "cadence_upper")
    )
    return ranked if n is None else ranked.limit(n)


def digest_branch(feed: DataFrame) -> DataFrame:
    """One row: nothing flagged, one check flagged, or several."""
    n = F.col("n_checks")
    return feed.agg(F.count_distinct("check_number").alias("n_checks")).withColumn(
        "branch", F.when(n == 0, "nothing").when(n == 1, "one check").otherwise("several checks")
    )


def check_overview(feed: DataFrame) -> DataFrame:
    """Flagged sequences per check, zero rows kept, and how serious the total is."""
    per_check = feed.groupBy("check_number").agg(F.count_distinct("cadence_id").alias("n"))
    found = per_check.agg(F.map_from_entries(F.collect_list(F.struct("check_number", "n"))).alias("found"))
    fired = F.size("found")
    rows = F.array(*[
        F.struct(F.lit(k).alias("check_number"), F.lit(name).alias("check_name"), F.lit(t).alias("tier"))
        for k, (name, t) in CHECKS.items()
    ])
    return (
        found.select("found", F.inline(rows))
        .select(
            "check_number", "check_name", "tier",
            F.coalesce(F.col("found")[F.col("check_number")], F.lit(0)).cast("bigint").alias("cadences_flagged"),
            fired.alias("checks_flagged"),
            F.when(fired == 0, "clean").when(fired <= 3, "warning").when(fired <= 6, "serious").otherwise("critical")
            .alias("band"),
        )
    )


# Main column of each check and its direction; the weekly checks are sorted by how far the week lies from its baseline.
MAIN_COLUMN = {
    1: ("last_start_ts", "desc"),
    2: ("double_start_pct", "desc"),
    3: ("double_exit_pct", "desc"),
    4: ("stuck_pct", "desc"),
    5: ("gap", "desc"),
    6: ("engaged_pct", "asc"),
    7: ("gap", "desc"),
    8: ("gap", "desc"),
    9: ("gap", "desc"),
}
_WEEKLY = {5: {"entries": "entries_", "exits": "exits_"}, 7: {"steps_surfaced": ""}, 8: {"steps_completed": ""}, 9: {"email_volume": ""}}


def _weekly_detail(rows: DataFrame, metrics: dict[str, str]) -> DataFrame:
    """cadence_id, week_start, metric, this_week, baseline, gap: one row for each metric that was flagged."""
    def line(metric: str, prefix: str) -> Column:
        flag = F.col(f"{metric}_drop_flag") if prefix else F.lit(True)
        baseline = F.col(f"{prefix}baseline_mean")
        return F.when(flag, F.struct(F.lit(metric).alias("metric"), F.col(metric).alias("this_week"), baseline.alias("baseline"),
                                     F.round(F.abs(F.col(metric) - baseline), 1).alias("gap")))
    lines = F.filter(F.array(*[line(m, p) for m, p in metrics.items()]), lambda r: r.isNotNull())
    return rows.select("cadence_id", "week_start", F.inline(lines))


def check_detail(checks: dict[int, DataFrame], number: int) -> DataFrame:
    """The detail table of one check, sorted by the column that matters most: its own columns, of a weekly check this week beside its baseline."""
    rows = _weekly_detail(checks[number], _WEEKLY[number]) if number in _WEEKLY else checks[number]
    column, direction = MAIN_COLUMN[number]
    order = F.desc(column) if direction == "desc" else F.asc(column)
    return rows.orderBy(order, "cadence_id", *(["week_start"] if number in _WEEKLY else []))


# text ---------------------------------------------------------------------------------------------

def _number(column: str) -> Column:
    return F.round(column, 4).cast("decimal(38,4)").cast("string")


def samples(feed: DataFrame, days: DataFrame, state: DataFrame, as_of: date, cfg: Config = Config(), n: int = 5) -> DataFrame:
    """check_number, cadence_id, emails: up to `n` of the people behind each alert of checks 2 to 4, those with most repeats or days first.

    From the stored `day_slices` and `person_state`. Only people of flagged sequences are ranked, and each task keeps its best `n` before the shuffle.
    """
    recent = days.filter(F.col("day").between(F.lit(as_of - timedelta(days=cfg.double_days)), F.lit(as_of)))
    repeated = slices.chained(recent, state).groupBy("cadence_id", "email").agg(
        F.sum("double_starts").alias("double_starts"), F.sum("double_exits").alias("double_exits"))
    stay = F.date_diff(F.lit(as_of), bucket("recent_start", "day", cfg.tz))
    waiting = state.filter(still_in("recent_start", cfg) & (stay >= cfg.stuck_days))
    people = (
        repeated.select("cadence_id", "email", F.inline(F.array(
            F.struct(F.lit(2).alias("check_number"), F.col("double_starts").alias("weight")),
            F.struct(F.lit(3).alias("check_number"), F.col("double_exits").alias("weight")))))
        .filter("weight > 0")
        .unionByName(waiting.select("cadence_id", "email", F.lit(4).alias("check_number"), stay.cast("bigint").alias("weight")))
    )
    alerts_of = feed.filter(F.col("check_number").isin(2, 3, 4)).select("check_number", "cadence_id").distinct()
    most = Window.partitionBy("check_number", "cadence_id").orderBy(F.desc("weight"), "email")
    best = people.join(alerts_of, ["check_number", "cadence_id"], "left_semi").withColumn("place", F.row_number().over(most)).filter(F.col("place") <= n)
    in_order = F.sort_array(F.collect_list(F.struct("place", "email")))  # at most n
    return best.groupBy("check_number", "cadence_id").agg(F.transform(in_order, lambda r: r["email"]).alias("emails"))


def urgent_messages(feed: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """One message per alert: headline, numbers and, where there are `samples`, some of the people. No cause is stated."""
    headline = F.concat(F.lit("**"), F.col("check_name"), F.lit(" — "), F.coalesce("cadence_id", F.lit("")), F.lit("**"))
    against = F.concat(
        F.lit("• "), _number("metric_value"),
        F.coalesce(F.concat(F.lit(" vs. "), _number("reference_value")), F.lit("")),
    )
    lines = [headline, against, F.concat(F.lit("• "), F.col("detail"))]
    urgent = route(feed).filter("tier = 'urgent'")
    if samples is not None:
        urgent = urgent.join(samples, ["check_number", "cadence_id"], "left")
        lines.append(F.concat(F.lit("• e.g. "), F.array_join("emails", ", ")))
    return urgent.select("id", "check_number", "cadence_id", F.concat_ws("\n", *lines).alias("message"))


def digest_message(feed: DataFrame, today: date, n: int = 3) -> DataFrame:
    """One row with the text of the periodic digest.

    Nothing flagged: a line that says so. One check: its worst rows. Several: the sequences in most checks.
    """
    period = digest_period(feed, today)
    counted = period.agg(
        F.count_distinct("check_number").alias("n_checks"), F.max("check_name").alias("only_check"),
        F.lit(None).cast("string").alias("worst"), F.lit(None).cast("string").alias("offenders"),
    )
    worst = (
        _worst_rows(period.withColumn("severity", severity())).orderBy(F.desc("severity"), "id").limit(n)
        .select((-F.col("severity")).alias("a"), F.lit(0.0).alias("b"), "id",
                F.concat(F.col("cadence_id"), F.lit(" — "), _number("metric_value")).alias("line"))
    )
    offenders = repeat_offenders(period, n).select(
        (-F.col("n_checks")).cast("double").alias("a"), (-F.col("severity")).alias("b"), F.col("cadence_upper").alias("id"),
        F.concat(F.col("cadence_upper"), F.lit(" — "), F.col("n_checks").cast("string"), F.lit(" checks ("),
                 F.col("checks"), F.lit(")")).alias("line"),
    )
    none = F.lit(None).cast("string")
    parts = (
        counted
        .unionByName(_numbered(worst).select(F.lit(None).cast("bigint").alias("n_checks"), none.alias("only_check"),
                                             F.col("lines").alias("worst"), none.alias("offenders")))
        .unionByName(_numbered(offenders).select(F.lit(None).cast("bigint").alias("n_checks"), none.alias("only_check"),
                                                 none.alias("worst"), F.col("lines").alias("offenders")))
    )
    one = parts.agg(*[F.max(c).alias(c) for c in ("n_checks", "only_check", "worst", "offenders")])
    title = f"**{REPORT_TITLE} — {today.isoformat()}**"
    total = F.lit(f" of the {len(CHECKS)} checks flagged.")
    text = (
        F.when(F.col("n_checks") == 0, F.lit(f"{title} — Nothing to report this run."))
        .when(F.col("n_checks") == 1, F.concat(
            F.lit(f"{title}\n1 of the {len(CHECKS)} checks flagged: "), F.col("only_check"),
            F.lit(f".\n\n**Top {n} by severity**\n"), F.col("worst")))
        .otherwise(F.concat(
            F.lit(f"{title}\n"), F.col("n_checks").cast("string"), total,
            F.lit(f"\n\n**Top {n} repeat offenders**\n"), F.col("offenders")))
    )
    return one.select("n_checks", text.alias("message"))


def _numbered(lines: DataFrame) -> DataFrame:
    """A handful of lines as one numbered list."""
    ordered = F.sort_array(F.collect_list(F.struct("a", "b", "id", "line")))
    return lines.agg(
        F.array_join(F.transform(ordered, lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r["line"])), "\n")
        .alias("lines")
    )


# threshold review ---------------------------------------------------------------------------------

def fire_rate(rates: DataFrame, metric: str, thresholds: list[float], above: bool = True) -> DataFrame:
    """How many sequences a check would flag at each threshold, of all it evaluated."""
    levels = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    fires = F.col(metric) > F.col("threshold") if above else F.col(metric) < F.col("threshold")
    return (
        rates.filter(F.col(metric).isNotNull()).select(metric, levels)
        .groupBy("threshold").agg(F.count("*").alias("evaluated"), F.count_if(fires).alias("flagged"))
        .withColumn("fire_rate", F.round(F.col("flagged") / F.col("evaluated"), 4))
    )
