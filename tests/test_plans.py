"""What Spark makes of the operators: joins, shuffles and what reaches the scan."""

import re

import pytest
from pyspark.sql import functions as F

from fixtures import project as p
from fixtures.project import AS_OF, CONFIG
from seqpulse import Tables
from seqpulse.operators import alerts, comms, diagnostics, feed, funnel, marts, sequence

SF = "/root/testdata/sf0.001"
NAMES = ("checkpoints", "steps", "comms", "email_msgs", "activity", "account_map", "changes")


@pytest.fixture(scope="module")
def t(spark, tmp_path_factory):
    """The projected tables as stored ones, so that filters can reach the scan."""
    folder = tmp_path_factory.mktemp("tables")
    source = p.Source(spark, SF)
    frames = {}
    for name in NAMES:
        getattr(source, name).write.parquet(f"{folder}/{name}")
        frames[name] = spark.read.parquet(f"{folder}/{name}")
    return Tables(**frames)


def plan(df):
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return text


def big_plans(t):
    entries = marts.entries(t.checkpoints, t.account_map, AS_OF, CONFIG)
    return {
        "funnel": funnel.four_stage_funnel(t.checkpoints, t.steps, AS_OF, CONFIG),
        "feed": feed.alert_feed(t, AS_OF, CONFIG),
        "doubles": sequence.double_starts(t.checkpoints, AS_OF, CONFIG),
        "diagnose": diagnostics.diagnose(t.checkpoints, t.steps, AS_OF, CONFIG),
        "cohort": marts.cohort_performance(entries, t.activity, AS_OF, CONFIG),
        "comms": comms.comms_volume(t.comms, funnel.sequence_names(t.checkpoints, AS_OF), AS_OF),
        "corroborate": diagnostics.corroborating_events(
            diagnostics.weekly_people(t.checkpoints, AS_OF, CONFIG).filter("entries_wow < 0"), t.checkpoints, t.changes),
        "message": feed.digest_message(feed.alert_feed(t, AS_OF, CONFIG), AS_OF),
    }


def test_no_cross_join_and_no_nested_loop(t):
    for name, df in big_plans(t).items():
        text = plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_no_window_over_everything(t):
    for name, df in big_plans(t).items():
        for spec in re.findall(r"windowspecdefinition\((.*?),? ?specifiedwindowframe", plan(df)):
            assert not re.match(r"\w+#\d+L? (ASC|DESC)", spec), f"{name}: {spec}"


def test_no_python_in_any_operator(t):
    for name, df in big_plans(t).items():
        assert "Python" not in plan(df) and "ArrowEval" not in plan(df), name


def pushed(df):
    return " ".join(re.findall(r"PushedFilters: \[(.*?)\]\n", plan(df)))


def test_floors_reach_the_scan(t):
    assert "GreaterThanOrEqual(event_timestamp" in pushed(alerts.no_starts(t.checkpoints, AS_OF, CONFIG))
    assert "GreaterThanOrEqual(event_timestamp" in pushed(alerts.entry_exit_drop(t.checkpoints, AS_OF, CONFIG))
    steps = pushed(alerts.surfaced_drop(t.steps, AS_OF, CONFIG))
    assert "Or(GreaterThanOrEqual(createddate" in steps and "EqualTo(step_id__c,Call attempt)" in steps
    mails = pushed(alerts.email_volume(t.checkpoints, t.comms, AS_OF, CONFIG))
    assert "GreaterThanOrEqual(comm_date" in mails and "EqualTo(comm_type,email)" in mails


def test_only_needed_columns_are_read(t):
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", plan(sequence.double_starts(t.checkpoints, AS_OF, CONFIG)))
    assert {c.split(":")[0] for c in ",".join(schemas).split(",")} == {"cadence_id", "email", "cadence_step", "event_timestamp"}


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_history_is_scanned_once(t):
    """The scan within slices and the summary of the slices share one pass and one shuffle."""
    text = executed(sequence.double_starts(t.checkpoints, AS_OF, CONFIG))
    assert text.count("FileScan") == 1 and "ReusedExchange" in text


def test_messages_are_scanned_once(t):
    text = executed(comms.comms_volume(t.comms, funnel.sequence_names(t.checkpoints, AS_OF), AS_OF))
    assert len(re.findall(r"FileScan parquet .*?workflow_name", text)) == 1 and "ReusedExchange" in text


def test_one_shuffle_for_all_baselines(t):
    """Mean, deviation and count of two metrics share one window and the shuffle of the zero-filled series."""
    text = plan(alerts.entry_exit_drop(t.checkpoints, AS_OF, CONFIG))
    assert len(re.findall(r"^\(\d+\) Window$", text, flags=re.M)) == 1
    assert len(re.findall(r"^\(\d+\) Exchange$", text, flags=re.M)) == 3


def test_stored_state_replaces_the_history(t, spark, tmp_path):
    sequence.person_state(t.checkpoints, AS_OF, CONFIG).write.parquet(f"{tmp_path}/state")
    state = spark.read.parquet(f"{tmp_path}/state")
    fresh = feed.alert_feed(t, AS_OF, CONFIG)
    stored = feed.alert_feed(t, AS_OF, CONFIG, state)
    assert sorted(map(str, stored.collect())) == sorted(map(str, fresh.collect()))
    full_scans = [s for s in re.findall(r"PushedFilters: \[(.*?)\]\n", plan(alerts.double_starts(t.checkpoints, AS_OF, CONFIG, state)))
                  if "event_timestamp" in s and "GreaterThanOrEqual(event_timestamp" not in s]
    assert not full_scans


def test_the_best_few_are_kept_before_the_shuffle(t):
    samples = diagnostics.ticket_samples(t.checkpoints, F.col("cadence_step") == "Exit", AS_OF, days=2000)
    assert "WindowGroupLimit" in plan(samples)


def scans(df, column):
    text = df._jdf.queryExecution().executedPlan().toString()
    return len([s for s in re.findall(r"FileScan parquet \[(.*?)\]", text) if re.search(rf"\b{column}#", s)])


def test_entry_mart_is_one_pass(t):
    """Attributes travel with the time: one scan, and no join but the one for the account."""
    mart = marts.entries(t.checkpoints, t.account_map, AS_OF, CONFIG)
    assert scans(mart, "event_timestamp") == 1
    assert len(re.findall(r"^\(\d+\) (?:SortMerge|BroadcastHash|ShuffledHash)Join", plan(mart), flags=re.M)) == 1


def test_diagnosis_reads_checkpoints_three_times(t):
    df = diagnostics.diagnose(t.checkpoints, t.steps, AS_OF, CONFIG)
    text = executed(df)
    assert len([s for s in re.findall(r"FileScan parquet \[(.*?)\]", text) if "event_timestamp#" in s]) <= 3
    assert len([s for s in re.findall(r"FileScan parquet \[(.*?)\]", text) if "createddate#" in s]) == 1


def test_corroboration_is_bounded_before_the_shuffle(t):
    from datetime import date

    flagged = diagnostics.weekly_people(t.checkpoints, AS_OF, CONFIG).filter("entries_wow < 0")
    df = diagnostics.corroborating_events(flagged, t.checkpoints, t.changes, period=(date(2001, 1, 1), date(2001, 6, 4)))
    filters = pushed(df)
    assert "GreaterThanOrEqual(changed_at" in filters and "LessThan(changed_at" in filters


def test_eligible_bounds_reach_the_scan(t, spark, tmp_path):
    p.Source(spark, SF).eligible.write.parquet(f"{tmp_path}/eligible")
    stored = spark.read.parquet(f"{tmp_path}/eligible")
    filters = pushed(marts.eligible_counts(stored, AS_OF, AS_OF.replace(day=1)))
    assert "LessThanOrEqual(eligible_dt" in filters and "GreaterThanOrEqual(eligible_dt" in filters


def test_samples_are_cut_before_the_shuffle(t):
    from seqpulse.operators import slices

    days = slices.day_slices(t.checkpoints, AS_OF, CONFIG)
    found = feed.samples(feed.alert_feed(t, AS_OF, CONFIG), days, slices.person_state(days, AS_OF, CONFIG), AS_OF, CONFIG)
    assert "WindowGroupLimit" in plan(found)
