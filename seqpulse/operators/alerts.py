"""The nine checks, for all sequences at once. Each returns only the sequences (and weeks) worth an alert."""

from __future__ import annotations

from calendar import monthrange
from datetime import date, timedelta

from pyspark.sql import DataFrame, functions as F

from seqpulse.config import Config
from seqpulse.functions import (
    bucket, fill_days, fill_weeks, norm_cadence, ratio, rep_facing, starts_with_any, weeks_back,
)
from seqpulse.operators import sequence as seq
from seqpulse.operators.baseline import baseline, is_drop, is_spike
from seqpulse.operators.clean import exclude_domains, exclude_names
from seqpulse.operators.comms import name_bridge, weekly_email_volume
from seqpulse.operators.funnel import people_per_week, steps_per_week
from seqpulse.sources import Tables, snapshot
from seqpulse.sources.snapshot import at


def months_back(as_of: date, months: int) -> date:
    """The same day of an earlier month, or the last day of a shorter one."""
    year, month = divmod(as_of.year * 12 + as_of.month - 1 - months, 12)
    return date(year, month + 1, min(as_of.day, monthrange(year, month + 1)[1]))


# 1 ------------------------------------------------------------------------------------------------

def start_recency(checkpoints: DataFrame, as_of: date, cfg: Config = Config()) -> DataFrame:
    """Starts of the last months and days per sequence that was alive in those months.

    The floor is safe: a sequence is kept only with a start inside the months, so its last start lies there too.
    """
    ts = F.col("event_timestamp")
    alive = months_back(as_of, cfg.alive_months)
    recent = at(as_of - timedelta(days=cfg.silent_days), cfg.tz)
    starts = exclude_domains(snapshot(checkpoints, "checkpoints", as_of, alive, cfg.tz), cfg.internal_domains)
    return (
        starts.filter(F.col("cadence_step") == "Start")
        .groupBy(norm_cadence().alias("cadence_id"))
        .agg(F.count("*").alias("starts_last_4mo"), F.count_if(ts >= recent).alias("starts_last_7d"),
             F.max(ts).alias("last_start_ts"))
    )


def no_starts(checkpoints: DataFrame, as_of: date, cfg: Config = Config()) -> DataFrame:
    return start_recency(checkpoints, as_of, cfg).filter("starts_last_7d = 0")


# 2, 3 ---------------------------------------------------------------------------------------------

def double_rates(
    checkpoints: DataFrame, as_of: date, cfg: Config = Config(), state: DataFrame | None = None
) -> DataFrame:
    """Shares of repeated starts and exits in the trailing days, recurring sequences left out."""
    rates = seq.doubles_by_cadence(exclude_names(checkpoints, cfg.recurring_substrings), as_of, cfg, state)
    return rates.withColumns({
        "double_start_pct": ratio(F.col("double_starts"), F.col("total_starts")),
        "double_exit_pct": ratio(F.col("double_exits"), F.col("total_exits")),
    })


def _double_alert(rates: DataFrame, cfg: Config, event: str) -> DataFrame:
    return rates.filter(F.col(f"double_{event}_pct") > cfg.double_pct).select(
        "cadence_id",
        F.col(f"double_{event}s").alias(f"double_{event}_count"),
        F.col(f"double_{event}_people").alias("pros_affected"),
        F.col(f"total_{event}s").alias(f"total_{event}s_7d"),
        f"double_{event}_pct",
    )


def double_starts(checkpoints, as_of: date, cfg: Config = Config(), state: DataFrame | None = None) -> DataFrame:
    return _double_alert(double_rates(checkpoints, as_of, cfg, state), cfg, "start")


def double_exits(checkpoints, as_of: date, cfg: Config = Config(), state: DataFrame | None = None) -> DataFrame:
    return _double_alert(double_rates(checkpoints, as_of, cfg, state), cfg, "exit")


def recent_doubles(checkpoints: DataFrame, as_of: date, event: str, cfg: Config = Config()) -> DataFrame:
    """Drill-down: who repeated, with previous and current time, in the sequences flagged by check 2 or 3."""
    named = exclude_names(checkpoints, cfg.recurring_substrings)
    state = seq.person_state(named, as_of, cfg)
    floor = as_of - timedelta(days=cfg.double_days)
    events = seq.external_events(snapshot(named, "checkpoints", as_of, floor, cfg.tz), cfg)
    flagged = _double_alert(double_rates(checkpoints, as_of, cfg, state), cfg, event).select("cadence_id")
    return seq.double_events(events, cfg, event, state).join(flagged, "cadence_id", "left_semi")


# 4 ------------------------------------------------------------------------------------------------

def stuck_rates(
    checkpoints: DataFrame, as_of: date, cfg: Config = Config(), state: DataFrame | None = None
) -> DataFrame:
    """Of the recent entrants who are still in: how many have been for `stuck_days` or more."""
    people = seq.person_state(checkpoints, as_of, cfg) if state is None else state
    active = exclude_names(people, cfg.recurring_substrings).filter(seq.still_in("recent_start", cfg))
    days = F.date_diff(F.lit(as_of), bucket("recent_start", "day", cfg.tz))
    return (
        active.groupBy("cadence_id")
        .agg(F.count("*").alias("active_pros"), F.count_if(days >= cfg.stuck_days).alias("stuck_pros"),
             F.max(days).alias("longest_days_in_cadence"))
        .withColumn("stuck_pct", ratio(F.col("stuck_pros"), F.col("active_pros")))
    )


def stuck_share(checkpoints, as_of: date, cfg: Config = Config(), state: DataFrame | None = None) -> DataFrame:
    return stuck_rates(checkpoints, as_of, cfg, state).filter(F.col("stuck_pct") >= cfg.stuck_pct)


# 5, 7, 8 ------------------------------------------------------------------------------------------

def _grid_floor(as_of: date, cfg: Config) -> date:
    return weeks_back(as_of, cfg.n_weeks)[0]


def judge(weekly: DataFrame, metrics: list[str], as_of: date, cfg: Config) -> DataFrame:
    """Zero-filled complete weeks with their baselines.

    A sequence without a single row in these weeks has a mean of 0 and cannot be flagged, so the series alone
    names the sequences.
    """
    filled = fill_weeks(weekly, metrics, as_of, cfg.n_weeks, include_current=False)
    return baseline(filled, metrics, cfg.baseline_weeks)


def recent_weeks(weekly: DataFrame, as_of: date, cfg: Config) -> DataFrame:
    return weekly.filter(F.col("week_start") >= F.lit(as_of - timedelta(days=cfg.recent_days)))


def _rounded(metric: str, prefix: str | None = None) -> list:
    name = "" if prefix is None else f"{prefix}_"
    return [
        F.round(f"{metric}_baseline_mean", 1).alias(f"{name}baseline_mean"),
        F.round(f"{metric}_baseline_sd", 1).alias(f"{name}baseline_sd"),
    ]


def entry_exit_baselines(checkpoints: DataFrame, as_of: date, cfg: Config = Config()) -> DataFrame:
    people = exclude_domains(
        snapshot(checkpoints, "checkpoints", as_of, _grid_floor(as_of, cfg), cfg.tz), cfg.internal_domains
    )
    weekly = people_per_week(people, {"entries": "Start", "exits": "Exit"}, cfg.tz)
    return recent_weeks(judge(weekly, ["entries", "exits"], as_of, cfg), as_of, cfg)


def entry_exit_drop(checkpoints: DataFrame, as_of: date, cfg: Config = Config()) -> DataFrame:
    flags = {"entries_drop_flag": is_drop("entries", cfg), "exits_drop_flag": is_drop("exits", cfg)}
    judged = entry_exit_baselines(checkpoints, as_of, cfg).withColumns(flags)
    return judged.filter("entries_drop_flag OR exits_drop_flag").select(
        "cadence_id", "week_start", "entries", "exits",
        *_rounded("entries", "entries"), *_rounded("exits", "exits"), *flags,
    )


def step_baselines(steps: DataFrame, as_of: date, cfg: Config = Config()) -> DataFrame:
    """Surfaced and completed steps with their baselines, from one pass. An empty result is not a completion."""
    seen = exclude_domains(
        snapshot(steps, "steps", as_of, _grid_floor(as_of, cfg), cfg.tz), cfg.internal_domains, "email__c"
    )
    weekly = steps_per_week(seen, cfg, blank_is_open=True)
    return recent_weeks(judge(weekly, ["steps_surfaced", "steps_completed"], as_of, cfg), as_of, cfg)


def _step_drop(judged: DataFrame, metric: str, cfg: Config) -> DataFrame:
    return judged.filter(is_drop(metric, cfg)).select("cadence_id", "week_start", metric, *_rounded(metric))


def surfaced_drop(steps: DataFrame, as_of: date, cfg: Config = Config()) -> DataFrame:
    return _step_drop(step_baselines(steps, as_of, cfg), "steps_surfaced", cfg)


def completed_drop(steps: DataFrame, as_of: date, cfg: Config = Config()) -> DataFrame:
    return _step_drop(step_baselines(steps, as_of, cfg), "steps_completed", cfg)


# 6 ------------------------------------------------------------------------------------------------

def engagement(
    checkpoints: DataFrame, steps: DataFrame, comms: DataFrame, email_msgs: DataFrame,
    as_of: date, cfg: Config = Config(),
) -> DataFrame:
    """Of those who started 3-10 days ago: who had a step or an e-mail of the sequence since.

    One start and one last touch per person decide, since any touch at or after any start in the band counts.
    Both sides are folded before they meet; the fact tables are floored at the start of the band.
    """
    newest, oldest = cfg.engage_band
    floor = as_of - timedelta(days=oldest)
    cohort = (
        exclude_names(
            exclude_domains(snapshot(checkpoints, "checkpoints", as_of - timedelta(days=newest), floor, cfg.tz),
                            cfg.internal_domains),
            cfg.quiet_substrings,
        )
        .filter("cadence_step = 'Start'")
        .groupBy(norm_cadence().alias("cadence_id"), "email").agg(F.min("event_timestamp").alias("start_ts"))
        .filter("cadence_id IS NOT NULL")
    )
    worked = (
        exclude_domains(snapshot(steps, "steps", as_of, floor, cfg.tz), cfg.internal_domains, "email__c")
        .filter(rep_facing(cfg))
        .select(norm_cadence("cadence_id__c").alias("cadence_id"), F.col("email__c").alias("email"),
                F.greatest("createddate", "result_date_time__c").alias("touch"))
    )
    touches = worked.unionByName(_mail_touches(cohort, comms, email_msgs, as_of, floor, cfg))
    last = touches.groupBy("cadence_id", "email").agg(F.max("touch").alias("touch"))
    return (
        cohort.join(last, ["cadence_id", "email"], "left")
        .groupBy("cadence_id")
        .agg(F.count("*").alias("cohort_size"), F.count_if(F.col("touch") >= F.col("start_ts")).alias("engaged_count"))
        .withColumn("engaged_pct", ratio(F.col("engaged_count"), F.col("cohort_size")))
    )


def _mail_touches(
    cohort: DataFrame, comms: DataFrame, email_msgs: DataFrame, as_of: date, floor: date, cfg: Config
) -> DataFrame:
    """Times of e-mails to members of the cohort, from workflows named after the member's sequence.

    Messages are brought to one row per id and sequence, receivers to the members they concern; the two then meet
    on id and sequence, so that a message id with many workflows and many receivers does not multiply.
    """
    sent = snapshot(comms, "comms", as_of, floor, cfg.tz).filter("comm_id IS NOT NULL AND workflow_name IS NOT NULL")
    messages = sent.groupBy("comm_id", "workflow_name").agg(F.max("comm_date").alias("touch"))
    by_sequence = (
        messages.join(name_bridge(messages.filter("touch IS NOT NULL"), cohort), "workflow_name")
        .groupBy("comm_id", "cadence_id").agg(F.max("touch").alias("touch"))
    )
    return received_by(cohort, by_sequence, email_msgs)


def received_by(people: DataFrame, by_sequence: DataFrame, email_msgs: DataFrame) -> DataFrame:
    """cadence_id, email, touch: the messages (comm_id, cadence_id, touch) that members of the sequence received.

    `email_msgs` has no date and is the large side. It is first cut to the ids of these messages: where they are few Spark hands them
    out, else it sifts the receivers by a bloom filter of the ids before it deals them.
    """
    ids = by_sequence.select("comm_id").distinct()
    received = email_msgs.select(F.col("message_id").alias("comm_id"), F.col("pro_email_address").alias("email")).filter("comm_id IS NOT NULL")
    members = received.join(ids, "comm_id", "left_semi").join(people.select("cadence_id", "email"), "email")
    return members.join(by_sequence, ["comm_id", "cadence_id"]).select("cadence_id", "email", "touch")


def low_engagement(
    checkpoints: DataFrame, steps: DataFrame, comms: DataFrame, email_msgs: DataFrame,
    as_of: date, cfg: Config = Config(),
) -> DataFrame:
    return engagement(checkpoints, steps, comms, email_msgs, as_of, cfg).filter(F.col("engaged_pct") < cfg.engage_pct)


# 9 ------------------------------------------------------------------------------------------------

def active_names(checkpoints: DataFrame, as_of: date, floor: date | None = None) -> DataFrame:
    """Sequences that ever (or since `floor`) started or ended somebody."""
    return (
        snapshot(checkpoints, "checkpoints", as_of, floor).filter(F.col("cadence_step").isin("Start", "Exit"))
        .select(norm_cadence().alias("cadence_id")).filter("cadence_id IS NOT NULL").distinct()
    )


def email_baselines(
    checkpoints: DataFrame, comms: DataFrame, as_of: date, cfg: Config = Config(), names: DataFrame | None = None
) -> DataFrame:
    """Weekly e-mail volume of the sequences with a watched prefix, of all where none is given; `names` saves the pass that lists them."""
    listed = active_names(checkpoints, as_of) if names is None else names
    watched = listed.filter(starts_with_any(F.col("cadence_id"), cfg.name_prefixes)) if cfg.name_prefixes else listed
    weekly = weekly_email_volume(comms, watched, as_of, weeks_back(as_of, cfg.n_weeks, include_current=False), cfg.tz)
    return recent_weeks(judge(weekly, ["email_volume"], as_of, cfg), as_of, cfg)


def email_volume(
    checkpoints: DataFrame, comms: DataFrame, as_of: date, cfg: Config = Config(), names: DataFrame | None = None
) -> DataFrame:
    """Weeks in which the e-mail volume fell or rose by two deviations or more; a flat series does both."""
    flags = {"drop_flag": is_drop("email_volume", cfg), "spike_flag": is_spike("email_volume", cfg)}
    judged = email_baselines(checkpoints, comms, as_of, cfg, names).withColumns(flags)
    return judged.filter("drop_flag OR spike_flag").select(
        "cadence_id", "week_start", "email_volume", *_rounded("email_volume"), *flags
    )


# earlier forms of the rules, as options ------------------------------------------------------------

def double_baseline(
    checkpoints: DataFrame, as_of: date, event: str, cfg: Config = Config(), days: int = 34,
    recent_days: int = 1, min_mean: float = 0.0,
) -> DataFrame:
    """Days on which repeats exceed their own trailing mean by `n_sd` deviations."""
    named = exclude_names(checkpoints, cfg.recurring_substrings)
    first_day = as_of - timedelta(days=days + recent_days - 1)
    events = seq.external_events(snapshot(named, "checkpoints", as_of, first_day, cfg.tz), cfg)
    state = seq.person_state(named, as_of, cfg, before_day=first_day)
    daily = fill_days(seq.daily_doubles(events, cfg, event, state), ["doubles"], as_of, days + recent_days)
    judged = baseline(daily, ["doubles"], days, "day")
    return (
        judged.filter((F.col("doubles") > 0) & is_spike("doubles", cfg, days, min_mean))
        .select("cadence_id", "day", "doubles", *_rounded("doubles"))
    )


def any_doubles(checkpoints: DataFrame, as_of: date, event: str, cfg: Config = Config()) -> DataFrame:
    """Any repeat in the trailing days, whatever its share."""
    return (
        double_rates(checkpoints, as_of, cfg).filter(F.col(f"double_{event}s") > 0)
        .select("cadence_id", F.col(f"double_{event}s").alias(f"double_{event}_count"),
                F.col(f"double_{event}_people").alias("pros_affected"))
    )


def newly_stuck(checkpoints: DataFrame, as_of: date, cfg: Config = Config(), days: int = 7) -> DataFrame:
    """People who passed `stuck_days` within the last days, of all who ever started."""
    people = exclude_names(exclude_domains(checkpoints, cfg.internal_domains), cfg.recurring_substrings)
    return (
        seq.stuck(people, as_of, cfg).filter(F.col("days_in_cadence") < cfg.stuck_days + days)
        .groupBy("cadence_id").agg(F.count("*").alias("newly_stuck_pros"))
    )


def no_surfaced(steps: DataFrame, as_of: date, cfg: Config = Config()) -> DataFrame:
    """Sequences that surfaced steps in the last months but none in the last days."""
    created = F.col("createddate")
    seen = exclude_names(
        exclude_domains(snapshot(steps, "steps", as_of, tz=cfg.tz), cfg.internal_domains, "email__c"),
        cfg.quiet_substrings, "cadence_id__c",
    )
    return (
        seen.filter(rep_facing(cfg) & (created >= at(months_back(as_of, cfg.alive_months), cfg.tz)))
        .groupBy(norm_cadence("cadence_id__c").alias("cadence_id"))
        .agg(F.count("*").alias("surfaced_last_4mo"),
             F.count_if(created >= at(as_of - timedelta(days=cfg.silent_days), cfg.tz)).alias("surfaced_last_7d"),
             F.max(created).alias("last_surfaced_ts"))
        .filter("surfaced_last_7d = 0")
    )


def run_checks(
    tables: Tables, as_of: date, cfg: Config = Config(), state: DataFrame | None = None
) -> dict[int, DataFrame]:
    """All nine checks with their own columns, for the detail view of each.

    Pass a stored `person_state` to read the event history once instead of once for each of checks 2-4.
    """
    cp, steps = tables.checkpoints, tables.steps
    rates = double_rates(cp, as_of, cfg, state)
    judged = step_baselines(steps, as_of, cfg)
    return {
        1: no_starts(cp, as_of, cfg),
        2: _double_alert(rates, cfg, "start"),
        3: _double_alert(rates, cfg, "exit"),
        4: stuck_share(cp, as_of, cfg, state),
        5: entry_exit_drop(cp, as_of, cfg),
        6: low_engagement(cp, steps, tables.comms, tables.email_msgs, as_of, cfg),
        7: _step_drop(judged, "steps_surfaced", cfg),
        8: _step_drop(judged, "steps_completed", cfg),
        9: email_volume(cp, tables.comms, as_of, cfg),
    }
