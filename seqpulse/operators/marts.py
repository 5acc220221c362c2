"""Stored tables: checkpoint facts, first entries, cohort performance, eligibility counts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from seqpulse.config import Config
from seqpulse.functions import identity_kind, is_break, norm_cadence, unique_id
from seqpulse.operators.identity import resolve_account
from seqpulse.sources import snapshot
from seqpulse.sources.schema import REP_FIELDS

ENTRY_COLUMNS = [
    "unique_id", "user_type", "account_lead_id", "account_id", "user_id", "cadence_id", "email", "lead_id",
    "workflow_id", "anonymous_id", "test_flag", "entry_group", "entry_timestamp", "entry_dt", "rep_id",
    "object_record_id", "cadence_time_required", "sdr_id", "sdr_name", "sdr_pod_role", "opportunity_id", "case_id",
    "case_owner_id", "exit_group", "exit_dt", "exit_timestamp",
]

MEASURES = [
    "calls", "connect_calls", "contact_calls", "conversation_calls", "demo_booked", "demo_attended",
    "enroll_type_3", "enroll_type_1",
]


_PERSON = ["unique_id", "cadence_id"]
_NOBODY = "\0"  # rows without any id form one person


def _is_entry() -> Column:
    return F.col("cadence_step").isin("Start", "Test")


def _is_exit() -> Column:
    return F.col("cadence_step") == "Exit"


def _rep_fields(df: DataFrame) -> list[Column]:
    return [F.col(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in REP_FIELDS]


def checkpoint_facts(checkpoints: DataFrame, cfg: Config = Config()) -> DataFrame:
    """One row per checkpoint with its person and what it counts as. `Test` is not an entry."""
    step, day = F.col("cadence_step"), F.to_date("event_timestamp")
    entry, leave = step == "Start", step == "Exit"
    rep = {c: e for c, e in zip(REP_FIELDS, _rep_fields(checkpoints))}
    return checkpoints.select(
        unique_id().alias("unique_id"), norm_cadence().alias("cadence_id"), "cadence_step", "cadence_step_value",
        F.coalesce(entry, F.lit(False)).alias("valid_entry"), F.coalesce(leave, F.lit(False)).alias("valid_exit"),
        is_break(cfg).alias("valid_break"),
        "entry_group", F.when(entry, day).alias("entry_dt"),
        F.when(leave, F.col("cadence_step_value")).alias("exit_group"), F.when(leave, day).alias("exit_dt"),
        *[rep[c] for c in ("sdr_id", "sdr_name", "sdr_pod_role", "opportunity_id", "case_id")],
        "object_record_id", rep["rep_id"], "event_timestamp",
    )


_ATTRIBUTES = [
    "cadence_step", "entry_group", "workflow_id", "email", "lead_id", "user_id", "anonymous_id", "object_record_id", *REP_FIELDS,
]


def _first_entry_and_exit(events: DataFrame, cfg: Config) -> DataFrame:
    """The first entry per person and sequence with its attributes, and the first exit at or after it with its reason.

    Time and attributes travel together as one struct, whose minimum is the earliest event (of equal times the one with the
    smallest attributes), so that nothing has to be fetched afterwards. The exit depends on the entry: events are first folded per slice of
    time, where only exits from the slice's first entry on count, and later slices give their earliest exit. A person with very
    many events is spread over many groups; each slice hands on at most one entry and two exits.
    """
    ts = F.col("event_timestamp")
    sliced = [*_PERSON, "slice"]
    entry = F.when(_is_entry(), F.struct("event_timestamp", *_ATTRIBUTES))
    leave = F.when(_is_exit(), F.struct("event_timestamp", "cadence_step_value"))
    instants = (
        events.withColumn("slice", F.floor(F.unix_seconds(ts) / cfg.slice_seconds))
        .groupBy(*sliced, "event_timestamp").agg(F.min(entry).alias("entered"), F.min(leave).alias("left"))
    )
    slice_entry = F.min("entered.event_timestamp").over(Window.partitionBy(*sliced))
    slices = (
        instants.withColumn("slice_entry", slice_entry).groupBy(*sliced)
        .agg(
            F.min("entered").alias("entered"),
            F.min(F.when(F.col("left.event_timestamp") >= F.col("slice_entry"), F.col("left"))).alias("left_after"),
            F.min("left").alias("left_any"),
        )
    )
    entry_slice = F.min(F.when(F.col("entered").isNotNull(), F.col("slice"))).over(Window.partitionBy(*_PERSON))
    here, later = F.col("slice") == F.col("entry_slice"), F.col("slice") > F.col("entry_slice")
    return (
        slices.withColumn("entry_slice", entry_slice).groupBy(*_PERSON)
        .agg(F.min("entered").alias("entry"), F.min(F.when(here, F.col("left_after")).when(later, F.col("left_any"))).alias("exit"))
        .filter("entry IS NOT NULL")
    )


def entries(
    checkpoints: DataFrame, account_map: DataFrame, as_of: date, cfg: Config = Config()
) -> DataFrame:
    """First entry (treated or held out) per person and sequence, with the first exit at or after it, from one pass.

    Events that tie are decided by their attributes, so that a rerun gives the same row.
    """
    known = snapshot(checkpoints, "checkpoints", as_of)
    events = (
        known.filter(F.col("cadence_step").isin("Start", "Test", "Exit") & F.col("cadence_id").isNotNull())
        .withColumns({"unique_id": F.coalesce(unique_id(), F.lit(_NOBODY)), "cadence_id": norm_cadence(),
                      **dict(zip(REP_FIELDS, _rep_fields(known)))})
    )
    found = (
        _first_entry_and_exit(events, cfg)
        .select(
            F.nullif("unique_id", F.lit(_NOBODY)).alias("unique_id"), "cadence_id", "entry.*",
            F.col("exit.event_timestamp").alias("exit_timestamp"), F.col("exit.cadence_step_value").alias("exit_group"),
        )
        .withColumnRenamed("event_timestamp", "entry_timestamp")
    )
    return (
        resolve_account(found, account_map).drop("organization_id")
        .withColumns({
            "user_type": identity_kind(F.col("cadence_id"), cfg),
            "account_lead_id": F.coalesce("account_id", "lead_id"),
            "test_flag": (F.col("cadence_step") == "Test").cast("int"),
            "entry_dt": F.to_date("entry_timestamp"),
            "exit_dt": F.to_date("exit_timestamp"),
        })
        .select(ENTRY_COLUMNS)
    )


# cohort mart ---------------------------------------------------------------------------------------

#: Activities (and entries) that one task of the cohort mart is given; the number of tasks follows the tables.
ROWS_PER_TASK = 200_000


def _task_count(*frames: DataFrame) -> int:
    """Tasks for all rows of these frames. Adaptive execution would merge what compresses well into tasks of millions of rows."""
    rows = sum(df.count() for df in frames)
    return max(frames[0].sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))


def _measures(cfg: Config) -> dict[str, Column]:
    enrolled, kind = F.col("enroll_flag"), F.col("enroll_type")
    return {
        "calls": F.col("call_flag"),
        "connect_calls": F.col("connected_call_flag"),
        "contact_calls": F.col("contact_call_flag"),
        "conversation_calls": F.col("conversation_call_flag"),
        "demo_booked": F.col("demo_created_flag"),
        "demo_attended": F.col("demo_attended_flag"),
        "enroll_type_3": F.when(~kind.isin(*cfg.type_3_excludes), enrolled),
        "enroll_type_1": F.when(kind.isin(*cfg.lite_enroll_types), enrolled),
    }


def _by_link(*carried: str) -> list[Column]:
    """A row once per way it can be linked: by lead, by account, and by both (which the first two count twice)."""
    lead, account = F.col("lead_id"), F.col("account_id")
    links = F.array(
        F.struct(F.lit("lead").alias("link"), lead.alias("k1"), F.when(lead.isNotNull(), "").alias("k2")),
        F.struct(F.lit("account").alias("link"), account.alias("k1"), F.when(account.isNotNull(), "").alias("k2")),
        F.struct(F.lit("both").alias("link"), lead.alias("k1"), account.alias("k2")),
    )
    return [*map(F.col, carried), F.inline(F.filter(links, lambda k: k["k1"].isNotNull() & k["k2"].isNotNull()))]


def cohort_performance(
    entries: DataFrame, activity: DataFrame, as_of: date, cfg: Config = Config()
) -> DataFrame:
    """Entries with the sums of eight activity measures within 30 and 60 days, day 0 included.

    An activity may reach an entry by lead, by account or by both and counts once: sums by lead plus sums by
    account minus sums by both. Each of the three is additive, so activity is folded to one row per key and day
    and entries to one per key and entry day before they meet; a join pairs days, never rows. The join also
    matches a period of the length of the window, so that a key's days are spread and at most two periods are
    looked up per entry day. Rows are dealt by key and day to as many tasks as they ask for before they are folded, and folded
    ones by key and period before they meet, so that no fold or join holds more of them when the tables grow. `entries` should be stored, as it is read four times.
    """
    short, long = cfg.horizons
    link, width = ["link", "k1", "k2"], long + 1
    measures = _measures(cfg)

    dated = snapshot(activity, "activity", as_of).filter("lead_id IS NOT NULL OR account_id IS NOT NULL")
    tasks = _task_count(dated, entries)
    daily = (
        dated.select("lead_id", "account_id", "activity_date", *[F.coalesce(e, F.lit(0)).alias(m) for m, e in measures.items()])
        .select(*_by_link("activity_date", *MEASURES))
        .repartition(tasks, *link, "activity_date")
        .groupBy(*link, "activity_date").agg(*[F.sum(m).alias(m) for m in MEASURES])
        .withColumn("period", F.floor(F.unix_date("activity_date") / width))
        .repartition(tasks, *link, "period")
    )

    linked = entries.select(*_by_link("unique_id", "cadence_id", "entry_dt"))
    first_period = F.floor(F.unix_date("entry_dt") / width)
    anchors = (
        linked.select(*link, "entry_dt", F.explode(F.array(first_period, first_period + 1)).alias("period"))
        .repartition(tasks, *link, "period").distinct()
    )
    age = F.date_diff("activity_date", "entry_dt")
    windows = (
        anchors.join(daily, [*link, "period"]).filter(age.between(0, long))
        .groupBy(*link, "entry_dt")
        .agg(*[F.sum(F.when(age <= short, F.col(m)).otherwise(0)).alias(f"{m}_{short}_days") for m in MEASURES],
             *[F.sum(m).alias(f"{m}_{long}_days") for m in MEASURES])
    )

    totals = [f"{m}_{h}_days" for m in MEASURES for h in cfg.horizons]
    sign = F.when(F.col("link") == "both", -1).otherwise(1)
    per_entry = (
        linked.join(windows, [*link, "entry_dt"])
        .groupBy("unique_id", "cadence_id").agg(*[F.sum(sign * F.col(t)).alias(t) for t in totals])
    )
    # keys are never NULL here: an entry without any id has no link and gets zeros
    return (
        entries.join(per_entry, ["unique_id", "cadence_id"], "left")
        .select(*[entries[c] for c in entries.columns], *[F.coalesce(t, F.lit(0)).cast("bigint").alias(t) for t in totals])
    )


def eligible_counts(eligible: DataFrame, as_of: date | None = None, floor: date | None = None) -> DataFrame:
    """Eligible leads and accounts per day, segment and assignment, of the days from `floor` to `as_of`.

    Ids are folded before they are counted, so that copies of an id end where they lie and a day's count is a sum over many tasks.
    The bounds are on the day the table is stored by.
    """
    day = F.col("eligible_dt")
    kept = eligible if as_of is None else eligible.filter(day <= F.lit(as_of))
    kept = kept if floor is None else kept.filter(day >= F.lit(floor))
    keys = ["eligible_dt", "lead_specialization_segment", "object_type", "assigned_flag"]
    return (
        kept.groupBy(*keys, "id").agg(F.count("*").alias("rows"))
        .groupBy(*keys).agg(F.sum("rows").alias("rows"), F.count("id").alias("ids"))
    )
