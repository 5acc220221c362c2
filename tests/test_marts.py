"""Entry and cohort marts against plain loops, with hot keys, ties and rows that match by both keys."""

import random
import re
from collections import defaultdict
from dataclasses import replace
from datetime import date, datetime, timedelta

import pytest

from seqpulse import Config
from seqpulse.operators import cohort, marts

DAY = date(2024, 6, 5)
CFG = Config()


def people(rng, n):
    rows = []
    for _ in range(n):
        who = 0 if rng.random() < 0.33 else rng.randrange(1, 25)
        kind = rng.random()
        rows.append({
            "cadence_id": rng.choice(["Pre-Enroll: A", " Pre-Enroll: A", "Post-Enroll: B"]),
            "lead_id": f"L{who}" if kind < 0.6 else None,
            "user_id": f"U{who}" if 0.4 < kind < 0.9 else None,
            "email": f"{who}@x",
            "cadence_step": rng.choice(["Start", "Test", "Exit", "Exit", "Break"]),
            "cadence_step_value": rng.choice(["lost", "enrolled", None]),
            "workflow_id": str(rng.randrange(3)), "entry_group": rng.choice(["g0", "g1"]),
            "event_timestamp": datetime(2024, 1, 1) + timedelta(minutes=20 * rng.randrange(3000)),
        })
    return rows


def expected_entries(rows):
    logs = defaultdict(list)
    for r in rows:
        logs[r["lead_id"] or r["user_id"] or r["email"], r["cadence_id"].strip()].append(r)
    found = {}
    for key, log in logs.items():
        starts = [r for r in log if r["cadence_step"] in ("Start", "Test")]
        if not starts:
            continue
        first = min(starts, key=lambda r: (r["event_timestamp"], r["cadence_step"], r["entry_group"], r["workflow_id"]))
        exits = [r for r in log if r["cadence_step"] == "Exit" and r["event_timestamp"] >= first["event_timestamp"]]
        at = min((r["event_timestamp"] for r in exits), default=None)
        values = {r["cadence_step_value"] for r in exits if r["event_timestamp"] == at}
        found[key] = (first["event_timestamp"], int(first["cadence_step"] == "Test"), first["workflow_id"], at, values)
    return found


@pytest.mark.parametrize("seed, slice_seconds", [(1, 3600), (2, 86400), (3, 10**9)])
def test_entries(make, seed, slice_seconds):
    rows = people(random.Random(seed), 900)
    accounts = make("account_map", [{"pro_uuid": f"U{i}", "organization_id": f"o{i // 3}", "account_id": f"A{i // 3}"} for i in range(25)] * 2)
    got = marts.entries(make("checkpoints", rows), accounts, DAY, replace(CFG, slice_seconds=slice_seconds)).collect()
    want = expected_entries(rows)
    assert len(got) == len(want)
    for r in got:
        at, test, workflow, left, reasons = want[r.unique_id, r.cadence_id]
        assert (r.entry_timestamp, r.test_flag, r.workflow_id, r.exit_timestamp) == (at, test, workflow, left)
        assert r.exit_group in (reasons or {None})
        assert r.account_id == (f"A{int(r.user_id[1:]) // 3}" if r.user_id else None)
        assert r.account_lead_id == (r.account_id or r.lead_id)


FLAGS = {"calls": "call_flag", "connect_calls": "connected_call_flag", "contact_calls": "contact_call_flag",
         "conversation_calls": "conversation_call_flag", "demo_booked": "demo_created_flag", "demo_attended": "demo_attended_flag"}


@pytest.mark.parametrize("seed", [1, 2])
def test_cohort(make, seed):
    rng = random.Random(seed)
    rows = people(rng, 500)
    accounts = make("account_map", [{"pro_uuid": f"U{i}", "organization_id": f"o{i // 3}", "account_id": f"A{i // 3}"} for i in range(25)])
    acts = []
    for i in range(800):
        who = 0 if rng.random() < 0.4 else rng.randrange(25)
        acts.append({
            "activity_id": str(i), "lead_id": rng.choice([f"L{who}", None]), "account_id": rng.choice([f"A{who // 3}", None]),
            "activity_date": date(2023, 12, 25) + timedelta(days=rng.randrange(140)),
            "enroll_flag": rng.randrange(2), "enroll_type": rng.choice(["Type 3", "Lite", "Type 1", "Type 2", None]),
            **{f: rng.randrange(2) for f in FLAGS.values()},
        })
    entries = marts.entries(make("checkpoints", rows), accounts, DAY, CFG)
    got = marts.cohort_performance(entries, make("activity", acts), DAY, CFG).collect()
    assert len(got) == entries.count() > 30
    both = 0
    for e in got:
        for horizon in (30, 60):
            near = [a for a in acts if (e.lead_id and a["lead_id"] == e.lead_id or e.account_id and a["account_id"] == e.account_id)
                    and 0 <= (a["activity_date"] - e.entry_dt).days <= horizon]
            both += sum(bool(e.lead_id and e.account_id and a["lead_id"] == e.lead_id and a["account_id"] == e.account_id) for a in near)
            for measure, flag in FLAGS.items():
                assert e[f"{measure}_{horizon}_days"] == sum(a[flag] for a in near)
            assert e[f"enroll_type_3_{horizon}_days"] == sum(a["enroll_flag"] for a in near if a["enroll_type"] == "Type 3")
            assert e[f"enroll_type_1_{horizon}_days"] == sum(a["enroll_flag"] for a in near if a["enroll_type"] in ("Lite", "Type 1"))
    assert both > 0


def test_cohort_tasks_follow_the_rows(make, monkeypatch):
    """A task folds a bounded number of activities: none is folded before it is dealt, and twice the rows make twice the tasks."""
    rows = people(random.Random(3), 60)
    accounts = make("account_map", [{"pro_uuid": f"U{i}", "organization_id": f"o{i // 3}", "account_id": f"A{i // 3}"} for i in range(25)])
    entries = marts.entries(make("checkpoints", rows), accounts, DAY, CFG)
    acts = [{"activity_id": str(i), "lead_id": f"L{i % 25}", "activity_date": date(2024, 1, 1) + timedelta(days=i % 90), "call_flag": 1} for i in range(400)]
    found = {}
    for size in (1_000_000, 10):
        monkeypatch.setattr(marts, "ROWS_PER_TASK", size, raising=False)
        for n in (200, 400):
            df = marts.cohort_performance(entries, make("activity", acts[:n]), DAY, CFG)
            text = df._jdf.queryExecution().toString()
            dealt = {int(x) for x in re.findall(r"hashpartitioning\(link#\d+, k1#\d+, k2#\d+, (?:activity_date|period)#\d+L?, (\d+)\), REPARTITION_BY_NUM", text)}
            assert len(dealt) == 1 and "keys=[lead_id" not in text
            found[size, n] = dealt.pop(), sorted(map(str, df.collect()))
    tasks = {k: v[0] for k, v in found.items()}
    assert tasks[10, 400] - tasks[10, 200] == 20 and tasks[1_000_000, 400] == tasks[1_000_000, 200] < tasks[10, 200]
    assert found[10, 400][1] == found[1_000_000, 400][1]


def test_maturity(spark):
    df = spark.createDataFrame([("S", DAY - timedelta(days=d)) for d in (29, 30, 59, 60)], "cadence_id string, entry_dt date")
    marked = {r.cohort_age_days: (r.mature_30_days, r.mature_60_days) for r in cohort.with_maturity(df, DAY, CFG).collect()}
    assert marked == {29: (False, False), 30: (True, False), 59: (True, False), 60: (True, True)}


def test_rates_are_over_mature_entries_by_period(spark):
    """A young entry has had no time to convert: it is neither in the numerator nor in the denominator."""
    from datetime import date

    from seqpulse.operators import cohort

    totals = [f"{m}_{h}_days" for m in marts.MEASURES for h in (30, 60)]
    rows = [("S", date(2024, 1, 5), 0, 1), ("S", date(2024, 1, 9), 0, 0), ("S", date(2024, 1, 31), 1, 1), ("S", date(2024, 3, 2), 0, 1), ("S", None, 0, 1)]
    kind = "cadence_id string, entry_dt date, test_flag int, entry_group string, " + ", ".join(f"{c} long" for c in totals)
    df = spark.createDataFrame([(c, d, f, "g", *[n] * len(totals)) for c, d, f, n in rows], kind)
    day = date(2024, 3, 20)
    found = {(r.entry_period, r.stage): r for r in cohort.conversion_funnel(df, 60, day, "month").collect()}
    january, march = date(2024, 1, 1), date(2024, 3, 1)
    assert [(found[january, s].all_entries, found[january, s].mature_entries, found[january, s].reached) for s in ("entries", "calls")] == [(3, 2, 2), (3, 2, 1)]
    assert found[january, "calls"].cumulative_rate == 0.5
    assert (found[march, "calls"].all_entries, found[march, "calls"].reached, found[march, "calls"].cumulative_rate) == (1, 0, None)
    assert found[None, "calls"].mature_entries == 0
    compared = {r.entry_period: r for r in cohort.test_vs_control(df, 60, as_of=day, grain="month").filter("measure = 'calls'").collect()}
    assert (compared[january].treatment_entries, compared[january].control_entries, compared[january].treatment_mean) == (2, 0, 0.5)
    older = {r.entry_period: r for r in cohort.test_vs_control(df, 30, as_of=day, grain="month").filter("measure = 'calls'").collect()}
    assert (older[january].control_entries, older[january].control_mean) == (1, 1.0)
