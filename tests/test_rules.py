"""Rules that the incomplete week, the case of a status, repeated rows and long names must not bend."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from seqpulse import Config
from seqpulse.operators import alerts, comms, diagnostics, feed as feeds, funnel
from seqpulse.session import shared_folder
from seqpulse.sources import read_tables


def _steady(cp, st, as_of):
    """25 equal weeks, each person in on Monday and out on Tuesday, and nothing yet in the current week but entries."""
    monday = as_of - timedelta(days=as_of.weekday())
    starts, exits, steps = [], [], []
    for w in range(1, 26):
        day = monday - timedelta(weeks=w)
        for k in range(4):
            starts.append(("A", f"p{w}-{k}@x.example", "Start", f"{day}"))
            exits.append(("A", f"p{w}-{k}@x.example", "Exit", f"{day + timedelta(days=1)}"))
            steps.append(("A", f"p{w}-{k}@x.example", f"{day}", "Done", f"{day}"))
    now = [("A", f"now{k}@x.example", "Start", f"{monday}") for k in range(4)]
    return cp(*starts, *exits, *now), st(*steps)


@pytest.mark.parametrize("weekday", [0, 3, 6])
def test_a_steady_sequence_is_clean_on_every_day(cp, st, rows, weekday):
    as_of = date(2024, 6, 3) + timedelta(days=weekday)
    checkpoints, steps = _steady(cp, st, as_of)
    found = rows(diagnostics.diagnose(checkpoints, steps, as_of).filter("cadence_id = 'A'"))[0]
    assert (found["d5_entry_exit_drops"], found["d6_surfaced_drops"], found["d7_completed_drops"]) == (0, 0, 0) and found["clean"]
    assert rows(funnel.decoupled(funnel.four_stage_funnel(checkpoints, steps, as_of), as_of)) == []


def test_the_case_of_a_status_is_no_fault(cp, rows):
    made = cp(("A", "p@x.example", "Start", "2024-06-01", None, "success"), ("A", "p@x.example", "Start", "2024-06-01", None, " Success"))
    for fold, want in ((False, {"success": "status case", " Success": "malformed status"}), (True, {"success": "ok", " Success": "malformed status"})):
        got = rows(diagnostics.payload_profile(made, date(2024, 6, 3), Config(fold_status=fold)))
        assert {r["cadence_step_status"]: r["payload_class"] for r in got} == want


def test_pieces_of_a_long_name_grow_with_its_length(spark, rows):
    names = spark.createDataFrame([("x" * 300 + "Welcome" + "y" * 300,), ("welcome",), (None,)], "workflow_name string")
    known = spark.createDataFrame([("Welcome",), ("other name",), ("",)], "cadence_id string")
    bridge = comms.name_bridge(names, known)
    assert bridge.count() == 4  # both names hold "Welcome" and the empty name
    plan = bridge._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(sequence(1" in plan and "CartesianProduct" not in plan


def test_a_sequence_is_listed_once_per_check(spark, rows):
    made = [(f"{k}", 5, "Drop", name, key, value, 10.0, "d", date(2024, 6, 3)) for k, (name, key, value) in enumerate(
        [("A", "entries", 1.0), ("A", "exits", 2.0), ("B", "entries", 3.0), ("C", "entries", 4.0)])]
    feed = spark.createDataFrame(made, "id string, check_number int, check_name string, cadence_id string, sub_key string, metric_value double, "
                                       "reference_value double, detail string, as_of date")
    assert [(r["cadence_id"], r["rank"]) for r in sorted(rows(feeds.top_by_severity(feed)), key=lambda r: r["rank"])] == [("A", 1), ("B", 2), ("C", 3)]


def test_swapped_headers_are_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("email,cadence_id\nNew,Not Ready\n")
    tables = read_tables(spark, {"checkpoints": f"{tmp_path}/"}, "csv", header=True)
    with pytest.raises(Exception):
        tables.checkpoints.select("email", "cadence_id").collect()


def test_shared_folder_is_named_by_the_session(spark):
    assert shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir"))


@pytest.mark.parametrize("tz, hour", [("Asia/Tokyo", -9), ("America/New_York", 4), (None, 0)])
def test_weeks_begin_and_end_at_local_midnight(cp, st, rows, tz, hour):
    """The first week of the series is whole, and nothing of the day after `as_of` counts."""
    as_of, n_weeks = date(2024, 6, 4), 3
    first, end = datetime(2024, 5, 20) + timedelta(hours=hour), datetime(2024, 6, 5) + timedelta(hours=hour)
    times = [first - timedelta(seconds=1), first, first + timedelta(hours=12), end - timedelta(seconds=1), end]
    checkpoints = cp(*[("A", f"p{k}@x.example", "Start", f"{t}") for k, t in enumerate(times)])
    steps = st(*[("A", f"p{k}@x.example", f"{t}", "Done", f"{t}") for k, t in enumerate(times)])
    funnel_rows = rows(funnel.four_stage_funnel(checkpoints, steps, as_of, Config(tz=tz, n_weeks=n_weeks)))
    by_week = {r["week_start"]: (r["entries"], r["steps_surfaced"], r["steps_completed"]) for r in funnel_rows}
    assert by_week == {date(2024, 5, 20): (2, 2, 2), date(2024, 5, 27): (0, 0, 0), date(2024, 6, 3): (1, 1, 1)}


@pytest.mark.parametrize("tz, entries", [("Asia/Tokyo", 2), (None, 1)])
def test_checks_use_the_zone(cp, rows, tz, entries):
    made = cp(("A", "p@x.example", "Start", "2024-05-26 18:00:00"), ("A", "q@x.example", "Start", "2024-05-28"), ("A", "r@x.example", "Start", "2024-05-07"))
    got = rows(alerts.entry_exit_baselines(made, date(2024, 6, 4), Config(tz=tz)).filter("week_start = DATE '2024-05-27'"))
    assert [r["entries"] for r in got] == [entries]
