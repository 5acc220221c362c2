"""Order of events against a plain loop over each person, on random events with many ties."""

import random
from collections import Counter, defaultdict
from dataclasses import replace
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from seqpulse import Config
from seqpulse.operators import alerts, funnel, sequence

DAY = date(2024, 6, 5)
CFG = Config()


def random_events(seed, n=1500, people=40, minutes=60 * 24 * 30):
    rng = random.Random(seed)
    start = datetime(2024, 5, 1)
    events = []
    for _ in range(n):
        # a third of all events belongs to one person
        who = "hot@x" if rng.random() < 0.33 else rng.choice([f"u{rng.randrange(people)}@x", None])
        at = start + timedelta(minutes=rng.randrange(minutes) // 30 * 30)
        events.append((rng.choice("ST"), who, rng.choice(["Start", "Start", "Exit", "Break"]), at))
    return events


def by_person(events):
    grouped = defaultdict(list)
    for cadence, email, step, at in events:
        grouped[cadence, email].append((at, step))
    return grouped


def expected_doubles(events, event, separator):
    found = Counter()
    for (cadence, email), log in by_person(events).items():
        own = sorted(at for at, step in log if step == event)
        other = [at for at, step in log if step == separator] if email is not None else []
        for before, now in zip(own, own[1:]):
            if not any(before < x < now for x in other):
                found[cadence, email, before, now] += 1
    return found


@pytest.mark.parametrize("seed, slice_seconds", [(1, 3600), (1, 60), (2, 86400 * 365), (3, 7 * 86400)])
def test_doubles(cp, seed, slice_seconds):
    events = random_events(seed)
    cfg = replace(CFG, slice_seconds=slice_seconds)
    df = cp(*events).coalesce(2)
    got = Counter({(r.cadence_id, r.email, r.prev_start_ts, r.this_start_ts): r.copies for r in sequence.double_starts(df, DAY, cfg).collect()})
    assert got == expected_doubles(events, "Start", "Exit")
    got = Counter({(r.cadence_id, r.email, r.prev_exit_ts, r.this_exit_ts): r.copies for r in sequence.double_exits(df, DAY, cfg).collect()})
    assert got == expected_doubles(events, "Exit", "Start")


@pytest.mark.parametrize("seed", [4, 5])
def test_recent_doubles_use_all_history(cp, seed):
    events = [e for e in random_events(seed, n=1200) if e[1] is not None]
    day = date(2024, 5, 20)
    cfg = replace(CFG, double_pct=0.0)
    cut, end = datetime(2024, 5, 13), datetime(2024, 5, 21)
    seen = [e for e in events if e[3] < end]
    want = {k: n for k, n in expected_doubles(seen, "Start", "Exit").items() if k[3] >= cut}
    df = cp(*events)
    got = {(r.cadence_id, r.email, r.prev_start_ts, r.this_start_ts): r.copies for r in alerts.recent_doubles(df, day, "start", cfg).collect()}
    assert got == want
    totals = Counter(e[0] for e in seen if e[2] == "Start" and e[3] >= cut)
    for r in alerts.double_starts(df, day, cfg).collect():
        assert r.double_start_count == sum(n for k, n in want.items() if k[0] == r.cadence_id)
        assert r.pros_affected == len({k[1] for k in want if k[0] == r.cadence_id})
        assert r.total_starts_7d == totals[r.cadence_id]


@pytest.mark.parametrize("rule", ["first", "any_after"])
def test_stuck(cp, rule):
    events = random_events(6, n=400)
    cfg = replace(CFG, exit_rule=rule, stuck_days=20)
    want = {}
    for (cadence, email), log in by_person(events).items():
        starts = [at for at, step in log if step == "Start"]
        exits = [at for at, step in log if step == "Exit"] if email is not None else []
        if not starts:
            continue
        leave = [x for x in ([min(exits)] if rule == "first" and exits else exits) if x > min(starts)]
        days = (DAY - min(starts).date()).days
        if not leave and days >= 20:
            want[cadence, email] = days
    got = {(r.cadence_id, r.email): r.days_in_cadence for r in sequence.stuck(cp(*events), DAY, cfg).collect()}
    assert got == want


def test_in_flight(make):
    rng = random.Random(7)
    events = [{"cadence_id": "S", "object_record_id": f"a1n{rng.randrange(30)}", "cadence_step": rng.choice(["Start", "Exit"]),
               "event_timestamp": datetime(2024, 5, 1) + timedelta(days=rng.randrange(20))} for _ in range(120)]
    want = {}
    for e in events:
        if e["cadence_step"] == "Start" and not any(
                x["cadence_step"] == "Exit" and x["object_record_id"] == e["object_record_id"] and x["event_timestamp"] > e["event_timestamp"]
                for x in events):
            key = e["object_record_id"]
            want[key] = max(want.get(key, e["event_timestamp"]), e["event_timestamp"])
    got = {r.object_record_id: r.last_start_ts for r in funnel.in_flight(make("checkpoints", events)).collect()}
    assert got == want


def test_a_hot_person_is_spread_over_slices(cp, spark):
    """No group that a window sorts is larger than a person's events within one slice."""
    start = datetime(2024, 5, 1)
    df = cp(*[("S", "hot@x", "Start" if i % 3 else "Exit", start + timedelta(minutes=7 * i)) for i in range(3000)])
    events = sequence.all_events(df)
    largest = (
        events.groupBy("cadence_id", "email", F.floor(F.unix_seconds("event_timestamp") / CFG.slice_seconds))
        .count().agg(F.max("count")).first()[0]
    )
    assert largest <= 9
    one_slice = sequence.double_starts(df, DAY, replace(CFG, slice_seconds=10**9)).count()
    assert sequence.double_starts(df, DAY, CFG).count() == one_slice > 0


def test_daily_baseline(cp):
    rng = random.Random(8)
    rows = []
    for d in range(60):
        for i in range(2 + d % 2):
            at = datetime(2024, 6, 5, 12) - timedelta(days=d)
            rows += [("S", f"{d}-{i}@x", "Start", at - timedelta(hours=1)), ("S", f"{d}-{i}@x", "Start", at)]
    spike = [("S", f"s{i}@x", "Start", datetime(2024, 6, 5, h)) for i in range(20) for h in (1, 2)]
    found = alerts.double_baseline(cp(*rows, *spike), DAY, "start", CFG).collect()
    assert [(r.day, r.doubles) for r in found] == [(DAY, 22)]
    assert alerts.double_baseline(cp(*rows), DAY, "start", CFG).count() == 0


def test_state_carried_from_day_to_day(cp):
    """A state advanced in uneven steps is the state built from the whole history."""
    events = [e for e in random_events(9, n=800) if e[1] is not None]
    cfg = replace(CFG, stuck_window=10)
    df = cp(*events)
    day = date(2024, 5, 6)
    state = sequence.person_state(df, day, cfg)
    for step in (1, 9, 14):
        following = day + timedelta(days=step)
        state = sequence.advance_state(state, df, day, following, cfg)
        day = following
        whole = sequence.person_state(df, day, cfg)
        assert sorted(map(str, state.collect())) == sorted(map(str, whole.select(state.columns).collect()))
