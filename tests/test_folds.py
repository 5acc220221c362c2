"""The stored folds, the mergeable summaries and the back-test against the plain operators, run by run."""

import random
import re
from dataclasses import replace
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from seqpulse import Config, Tables
from seqpulse.operators import alerts, backtest, diagnostics, feed, folds, sequence, slices
from seqpulse.plans import run_alerts
from tests.test_sequence import random_events

CFG = Config(internal_domains=("in.example",), quiet_substrings=("quiet",), recurring_substrings=("again",))
DAY = date(2024, 5, 28)


def rows(df, *columns):
    return sorted(repr(tuple(r)) for r in (df.select(*columns) if columns else df).collect())


def tables(spark, cp, make, seed, n=900, days=40):
    """Random events of three sequences with steps and messages; people of one domain are internal."""
    rng = random.Random(seed)
    start = datetime(2024, 4, 20)
    mails = ["hot@x", "a@in.example", *[f"u{i}@x" for i in range(15)]]
    when = lambda: start + timedelta(minutes=rng.randrange(days * 1440))
    who = lambda: "hot@x" if rng.random() < 0.3 else rng.choice(mails)
    names = ["S", "T again", "quiet U"]
    events = [(rng.choice(names), who() if rng.random() > 0.05 else None, rng.choice(["Start", "Start", "Exit", "Break"]), when()) for _ in range(n)]
    done = [{"cadence_id__c": rng.choice(names), "email__c": who(), "createddate": (t := when()), "name": "step", "step_id__c": "Call attempt",
             **({"result__c": rng.choice(["Displayed", "", "Spoke"]), "result_date_time__c": t + timedelta(hours=rng.randrange(90))} if rng.random() < 0.6 else {})}
            for _ in range(60)]
    sent = [{"comm_id": f"m{rng.randrange(90)}", "comm_type": rng.choice(["email", "sms"]), "workflow_name": f"{rng.choice(names)} v{rng.randrange(3)}", "comm_date": when()} for _ in range(150)]
    got = [{"message_id": f"m{rng.randrange(90)}", "pro_email_address": who()} for _ in range(150)]
    return Tables(checkpoints=cp(*events), steps=make("steps", done), comms=make("comms", sent), email_msgs=make("email_msgs", got))


# folds ---------------------------------------------------------------------------------------------

@pytest.mark.parametrize("tz", [None, "Asia/Tokyo", "America/Los_Angeles"])
def test_checks_from_folds_equal_the_checks(spark, cp, make, tz):
    cfg = replace(CFG, tz=tz, min_mean=0.5, baseline_weeks=2, recent_days=60)
    t = tables(spark, cp, make, 1)
    cube, mail = folds.day_cube(t.checkpoints, t.steps, DAY, cfg), folds.mail_fold(t.comms, DAY, cfg)
    columns = ["cadence_id", "starts_last_4mo", "starts_last_7d", "last_start_ts"]
    assert rows(folds.start_recency(cube, DAY, cfg), *columns) == rows(alerts.start_recency(t.checkpoints, DAY, cfg), *columns)
    weekly = folds.weekly_baselines(cube, DAY, cfg)
    for metrics, plain in ((["entries", "exits"], alerts.entry_exit_baselines(t.checkpoints, DAY, cfg)),
                           (["steps_surfaced", "steps_completed"], alerts.step_baselines(t.steps, DAY, cfg))):
        columns = ["cadence_id", "week_start", *[f"{m}{s}" for m in metrics for s in ("", "_baseline_mean", "_baseline_sd", "_baseline_n")]]
        assert rows(weekly, *columns) == rows(plain, *columns)
    engaged = ["cadence_id", "cohort_size", "engaged_count", "engaged_pct"]
    want = rows(alerts.engagement(t.checkpoints, t.steps, t.comms, t.email_msgs, DAY, cfg), *engaged)
    assert rows(folds.engagement(cube, mail, t.email_msgs, DAY, cfg), *engaged) == want and want
    names = alerts.active_names(t.checkpoints, DAY)
    columns = ["cadence_id", "week_start", "email_volume", "email_volume_baseline_mean", "email_volume_baseline_n"]
    assert rows(folds.email_baselines(mail, names, DAY, cfg), *columns) == rows(alerts.email_baselines(t.checkpoints, t.comms, DAY, cfg, names), *columns)


def test_a_day_is_a_day_of_the_zone(cp):
    """In Tokyo the day of the report ends, and its windows begin, nine hours before those of UTC."""
    tokyo = replace(CFG, tz="Asia/Tokyo", stuck_days=20, stuck_window=25, double_pct=0.0, exit_rule="first")
    late = ("S", "b@x", "Start", datetime(2024, 5, 28, 15, 30))  # already the 29th in Tokyo
    first = ("S", "a@x", "Start", datetime(2024, 5, 20, 15, 30))  # the 21st in Tokyo: inside the last seven days; in UTC it is not
    older = ("S", "a@x", "Start", datetime(2024, 5, 20, 14, 30))
    df = cp(late, first, older)
    assert alerts.start_recency(df, DAY, tokyo).first().starts_last_7d == 1 and alerts.start_recency(df, DAY, CFG).first().starts_last_7d == 1
    assert alerts.start_recency(df, DAY, tokyo).first().last_start_ts == first[3]
    assert [(r.total_starts, r.double_starts) for r in alerts.double_rates(df, DAY, tokyo).collect()] == [(1, 1)]
    assert [(r.total_starts, r.double_starts) for r in alerts.double_rates(df, DAY, CFG).collect()] == [(1, 0)]
    entered = cp(("S", "c@x", "Start", datetime(2024, 5, 2, 15, 30)), ("S", "d@x", "Start", datetime(2024, 5, 2, 14, 30)))
    day = date(2024, 5, 28)
    assert alerts.stuck_rates(entered, day, replace(tokyo, stuck_window=25)).first().active_pros == 1
    assert alerts.stuck_rates(entered, day, replace(tokyo, stuck_window=26)).first().longest_days_in_cadence == 26
    assert sequence.stuck(entered, day, tokyo).agg(F.min("days_in_cadence")).first()[0] == 25
    assert diagnostics.last_starts(entered, day, tokyo).first().days_since_last_start == 25


def scans(df, column):
    text = df._jdf.queryExecution().executedPlan().toString()
    return len([s for s in re.findall(r"FileScan parquet \[(.*?)\]", text) if re.search(rf"\b{column}#", s)])


def test_a_run_reads_each_fact_table_once(spark, cp, make, tmp_path):
    t = tables(spark, cp, make, 2, n=200)
    stored = {}
    for name in ("checkpoints", "steps", "comms", "email_msgs"):
        getattr(t, name).write.parquet(f"{tmp_path}/{name}")
        stored[name] = spark.read.parquet(f"{tmp_path}/{name}")
    t = Tables(**stored)
    cube, mail = folds.day_cube(t.checkpoints, t.steps, DAY, CFG), folds.mail_fold(t.comms, DAY, CFG)
    assert (scans(cube, "event_timestamp"), scans(cube, "createddate"), scans(mail, "comm_date")) == (1, 1, 1)
    days = slices.day_slices(t.checkpoints, DAY, CFG)
    shared = {}
    for name, df in (("cube", cube), ("mail", mail), ("days", days), ("names", alerts.active_names(t.checkpoints, DAY))):
        df.write.parquet(f"{tmp_path}/{name}")
        shared[name] = spark.read.parquet(f"{tmp_path}/{name}")
    slices.person_state(shared["days"], DAY, CFG).write.parquet(f"{tmp_path}/state")
    state = spark.read.parquet(f"{tmp_path}/state")
    rates = slices.double_rates(shared["days"], DAY, CFG, state)
    whole = feed.alert_feed(t, DAY, CFG, state, shared["names"], shared["cube"], shared["mail"], rates)
    assert [scans(whole, c) for c in ("event_timestamp", "createddate", "comm_date")] == [0, 0, 0]
    assert rows(whole) == rows(feed.alert_feed(t, DAY, CFG))


# summaries -----------------------------------------------------------------------------------------

@pytest.mark.parametrize("seed, tz", [(1, None), (2, "Asia/Tokyo"), (3, None)])
def test_state_and_doubles_from_days(cp, seed, tz):
    cfg = replace(CFG, tz=tz, double_days=9, stuck_window=15)
    df = cp(*random_events(seed, n=1200))
    days = slices.day_slices(df, DAY, cfg)
    for day in (DAY, DAY - timedelta(days=11)):
        assert rows(slices.person_state(days, day, cfg)) == rows(sequence.person_state(df, day, cfg))
        want = alerts.double_rates(df, day, cfg)
        assert rows(slices.double_rates(days, day, cfg), *want.columns) == rows(want) and want.agg(F.sum("double_starts")).first()[0] > 0


def test_late_rows_replace_their_days(cp):
    """Summaries after late rows are those built anew; no other day is read."""
    events = [e for e in random_events(5, n=900) if e[1] is not None]
    rng = random.Random(6)
    late_days = {date(2024, 5, 3), date(2024, 5, 4), date(2024, 5, 17)}
    late = [e for e in events if e[3].date() in late_days and rng.random() < 0.5]
    early = [e for e in events if e not in late]
    stored = slices.day_slices(cp(*early), DAY, CFG)
    whole = cp(*events)
    fixed = slices.replaced(stored, whole, DAY, CFG, sorted({e[3].date() for e in late}))
    anew = slices.day_slices(whole, DAY, CFG)
    assert late and rows(fixed) == rows(anew) != rows(stored)
    assert rows(slices.person_state(fixed, DAY, CFG)) == rows(sequence.person_state(whole, DAY, CFG))
    assert rows(slices.replaced(stored, whole, DAY, CFG, [])) == rows(stored)
    plan = slices.of_days(whole, DAY, CFG, sorted(late_days))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(">=") >= 2


def test_job_takes_late_rows_and_refuses_other_parameters(spark, cp, make, tmp_path):
    t = tables(spark, cp, make, 7, n=500)
    out, before = str(tmp_path), DAY - timedelta(days=3)
    is_late = (F.to_date("event_timestamp") == F.lit(date(2024, 5, 10))) & (F.col("cadence_step") != "Break")
    late = t.checkpoints.filter(is_late)
    assert late.count() > 0
    run_alerts(spark, replace(t, checkpoints=t.checkpoints.filter(~is_late)), before, CFG, out)
    run_alerts(spark, t, DAY, CFG, out, previous_day=before, late=late)
    got = spark.read.parquet(f"{out}/alert_feed/run_date={DAY}")
    assert rows(got, *feed.FEED_COLUMNS) == rows(feed.alert_feed(t, DAY, CFG), *feed.FEED_COLUMNS)
    assert rows(spark.read.parquet(f"{out}/day_slices/as_of={DAY}"), *slices.SLICE) == rows(slices.day_slices(t.checkpoints, DAY, CFG))
    with pytest.raises(ValueError, match="other parameters"):
        run_alerts(spark, t, DAY + timedelta(days=1), replace(CFG, internal_domains=()), out, previous_day=DAY)


# back-test -----------------------------------------------------------------------------------------

@pytest.mark.parametrize("rule, tz", [("first", None), ("any_after", "Asia/Tokyo")])
def test_back_test_equals_the_checks_day_by_day(spark, cp, make, rule, tz):
    cfg = replace(CFG, exit_rule=rule, tz=tz, stuck_days=12, double_days=4, engage_band=(2, 6))
    t = tables(spark, cp, make, 11)
    first, last, windows, levels = date(2024, 5, 9), DAY, [15, 30], {k: (0.05, 0.1, 0.3, 0.6) for k in (2, 3, 4, 6)}
    got = {}
    for r in backtest.fire_rates(t, first, last, cfg, thresholds=levels, windows=windows).collect():
        got.setdefault((r.check_number, r.as_of, r.entrant_window), set()).add((r.threshold, r.evaluated, r.flagged, r.fire_rate))
    for day in (first, date(2024, 5, 14), date(2024, 5, 20), last):
        doubles = alerts.double_rates(t.checkpoints, day, cfg)
        runs = [(2, None, feed.fire_rate(doubles, "double_start_pct", levels[2])), (3, None, feed.fire_rate(doubles, "double_exit_pct", levels[3])),
                (6, None, feed.fire_rate(alerts.engagement(t.checkpoints, t.steps, t.comms, t.email_msgs, day, cfg), "engaged_pct", levels[6], above=False))]
        for check, window, rates in runs:
            assert {tuple(r) for r in rates.collect()} == got.get((check, day, window), set()), (check, day)
        for window in windows:
            stuck = alerts.stuck_rates(t.checkpoints, day, replace(cfg, stuck_window=window)).collect()
            want = {(x, len(stuck), sum(r.stuck_pct >= x for r in stuck), round(sum(r.stuck_pct >= x for r in stuck) / len(stuck), 4)) for x in levels[4]} if stuck else set()
            assert want == got.get((4, day, window), set()), (window, day)
    assert {k[0] for k in got} == {2, 3, 4, 6} and len({k[1] for k in got}) == (last - first).days + 1
