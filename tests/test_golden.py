"""One hand-made case per rule (FIXTURES.md, section 3). The day is a Wednesday."""

from dataclasses import replace
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from seqpulse import Config, Tables
from seqpulse.functions import is_break, is_break_exit
from seqpulse.operators import alerts, baseline, breaks, clean, comms, diagnostics, feed, funnel, marts, sequence
from seqpulse.sources import SCHEMAS, snapshot

DAY = date(2024, 6, 5)
CFG = Config(internal_domains=("internal.example",), name_prefixes=("S",))
W = [date(2024, 6, 3) - timedelta(weeks=i) for i in range(27)]  # W[0] is the current week


def ago(days, hour=12):
    return datetime(2024, 6, 5, hour) - timedelta(days=days)


def doubles(df, event="start"):
    return sequence.double_starts(df, DAY, CFG) if event == "start" else sequence.double_exits(df, DAY, CFG)


def test_g1_bounds_are_strict(cp, rows):
    df = cp(("S", "a", "Start", "2024-06-01 10:00"), ("S", "a", "Exit", "2024-06-01 10:00"), ("S", "a", "Start", "2024-06-01 11:00"))
    found = rows(doubles(df))
    assert [(r["prev_start_ts"].hour, r["this_start_ts"].hour, r["copies"]) for r in found] == [(10, 11, 1)]


def test_g2_exit_between(cp):
    df = cp(("S", "a", "Start", "2024-05-01"), ("S", "a", "Exit", "2024-05-10"), ("S", "a", "Start", "2024-05-20"))
    assert doubles(df).count() == 0


def test_g3_other_sequence(cp):
    assert doubles(cp(("S", "a", "Start", "2024-05-01"), ("T", "a", "Start", "2024-05-20"))).count() == 0


def test_copies_of_one_instant_repeat_each_other(cp, rows):
    df = cp(*[("S", "a", "Start", "2024-05-01")] * 3)
    found = rows(doubles(df))
    assert len(found) == 1 and found[0]["copies"] == 2 and found[0]["prev_start_ts"] == found[0]["this_start_ts"]


def test_an_exit_without_email_separates_nobody(cp, rows):
    df = cp(("S", None, "Start", "2024-05-01"), ("S", None, "Exit", "2024-05-02"), ("S", None, "Start", "2024-05-03"))
    found = rows(doubles(df))
    assert len(found) == 1 and found[0]["email"] is None


@pytest.mark.parametrize("repeated, flagged", [(100, False), (101, True)])
def test_g4_share_of_doubles(cp, repeated, flagged):
    once = [("S", f"u{i}", "Start", ago(3)) for i in range(1000 - 2 * repeated)]
    twice = [("S", f"d{i}", "Start", ago(d)) for i in range(repeated) for d in (2, 4)]
    found = alerts.double_starts(cp(*once, *twice), DAY, CFG).collect()
    assert bool(found) is flagged
    if found:
        assert (found[0].double_start_count, found[0].total_starts_7d, found[0].double_start_pct) == (101, 1000, 0.101)


def test_double_after_long_history_is_found_through_the_state(cp, rows):
    df = cp(("S", "a", "Start", ago(900)), ("S", "a", "Start", ago(1)), ("S", "b", "Start", ago(900)),
            ("S", "b", "Exit", ago(30)), ("S", "b", "Start", ago(1)))
    found = rows(alerts.double_starts(df, DAY, CFG))
    assert [(r["double_start_count"], r["pros_affected"], r["total_starts_7d"]) for r in found] == [(1, 1, 2)]


def test_g5_stuck_share_at_the_threshold(cp, rows):
    df = cp(*[("S", f"u{i}", "Start", ago(10)) for i in range(9)], ("S", "old", "Start", ago(110)))
    found = rows(alerts.stuck_share(df, DAY, CFG))
    assert [(r["active_pros"], r["stuck_pros"], r["stuck_pct"], r["longest_days_in_cadence"]) for r in found] == [(10, 1, 0.1, 110)]


def test_g6_entrants_of_120_days(cp, rows):
    df = cp(("S", "in", "Start", ago(120, 0)), ("S", "out", "Start", ago(121, 23)))
    found = rows(alerts.stuck_share(df, DAY, CFG))
    assert [(r["active_pros"], r["longest_days_in_cadence"]) for r in found] == [(1, 120)]


def test_g7_first_exit_before_the_start(cp):
    df = cp(("S", "a", "Exit", ago(115)), ("S", "a", "Start", ago(114)), ("S", "a", "Exit", ago(113)))
    assert alerts.stuck_share(df, DAY, CFG).count() == 1
    assert alerts.stuck_share(df, DAY, replace(CFG, exit_rule="any_after")).count() == 0
    assert sequence.stuck(df, DAY, CFG).count() == 1
    assert sequence.stuck(df, DAY, replace(CFG, exit_rule="any_after")).count() == 0


def surfaced(st, counts):
    """Steps per week back from the current one."""
    return st(*[("S", f"u{i}@x", W[w]) for w, n in counts.items() for i in range(n)])


def test_g8_flat_series_falls_and_rises(st, make, cp, rows):
    steps = surfaced(st, {w: 10 for w in range(1, 26)})
    found = rows(alerts.surfaced_drop(steps, DAY, CFG))
    # Wednesday minus 28 days leaves three complete weeks
    assert sorted(r["week_start"] for r in found) == [W[3], W[2], W[1]]
    mails = make("comms", [{"comm_id": f"{w}-{i}", "comm_type": "email", "comm_date": datetime.combine(W[w], datetime.min.time()),
                            "workflow_name": "1Q S - x"} for w in range(1, 26) for i in range(10)])
    both = rows(alerts.email_volume(cp(("S", "a", "Start", ago(3))), mails, DAY, CFG))
    assert len(both) == 3 and all(r["drop_flag"] and r["spike_flag"] for r in both)


def test_first_weeks_of_the_grid_have_no_baseline(st, rows):
    steps = surfaced(st, {w: 10 for w in range(1, 26)})
    found = rows(alerts.surfaced_drop(steps, DAY, replace(CFG, recent_days=400)))
    assert len(found) == 25 - 8


def test_g9_mean_and_sample_deviation(st, rows):
    steps = surfaced(st, {1: 90, **{w: 100 if w % 2 else 102 for w in range(2, 10)}})
    found = [r for r in rows(alerts.surfaced_drop(steps, DAY, CFG)) if r["week_start"] == W[1]]
    assert [(r["steps_surfaced"], r["baseline_mean"], r["baseline_sd"]) for r in found] == [(90, 101.0, 1.1)]


def test_g10_low_volume(st):
    assert alerts.surfaced_drop(surfaced(st, {w: 9 for w in range(2, 26)}), DAY, CFG).count() == 0


def test_g11_current_week_is_not_judged(st):
    steps = surfaced(st, {w: 10 + w % 3 for w in range(1, 26)})
    assert W[0] not in [r.week_start for r in alerts.surfaced_drop(steps, DAY, CFG).collect()]


@pytest.mark.parametrize("day, weeks", [(date(2024, 6, 3), 4), (DAY, 3)])
def test_g12_judged_weeks(st, day, weeks):
    steps = surfaced(st, {w: 10 for w in range(1, 26)})
    assert alerts.surfaced_drop(steps, day, CFG).count() == weeks


def test_g13_seven_days_of_silence(cp):
    df = cp(("S", "a@x", "Start", "2024-05-29 00:00"))
    assert alerts.no_starts(df, DAY, CFG).count() == 0
    assert [r.days_since_last_start for r in diagnostics.no_starts(df, DAY, CFG).collect()] == [7]


def test_g14_domains(cp):
    df = cp(*[("S", e, "Start", ago(1)) for e in (None, "noat", "x@INTERNAL.example", "x@internal.example")])
    kept = clean.exclude_domains(df, CFG.internal_domains).select("email").collect()
    assert sorted(r.email for r in kept) == ["noat", "x@INTERNAL.example"]
    assert clean.exclude_domains(df, ()).count() == 3


def test_g15_breaks(cp, rows):
    df = cp(("S", "a", "Break", ago(1)), ("S", "a", "Call Disposition", ago(1), "none", "Break"),
            ("S", "a", "Exit", ago(1), "CADENCE BREAK - x"), ("S", "a", "Exit", ago(1), "lost"))
    signals = rows(breaks.break_signals(df, DAY, CFG))[0]
    assert [signals[f"break_{c}_cnt"] for c in ("step", "status", "exit", "union")] == [1, 1, 1, 3]
    assert rows(breaks.exit_break_overlap(df, CFG))[0]["overlap_rows"] == 1
    folded = cp(("S", "a", "Call Disposition", ago(1), "none", "break"))
    assert folded.filter(is_break(CFG)).count() == 0
    assert folded.filter(is_break(replace(CFG, fold_status=True))).count() == 1


def test_g16_surfaced_and_completed(st, cp, rows):
    t = ago(1)
    steps = st(("S", "a", t), ("S", "a", t, "Displayed", t), ("S", "a", t, "", t), ("S", "a", t, "Won", t),
               ("S", "a", t, "Won", t, "clear_step"), ("S", "a", t, "Won", t, "step", "Email"))
    now = [r for r in rows(funnel.four_stage_funnel(cp(("S", "a", "Start", t)), steps, DAY, CFG)) if r["week_start"] == W[0]]
    assert [(r["steps_surfaced"], r["steps_completed"], r["completion_rate"]) for r in now] == [(4, 2, 0.5)]
    blank_open = funnel.weekly_completed(steps, CFG, blank_is_open=True).collect()
    assert [r.steps_completed for r in blank_open] == [1]


def test_g17_completed_in_a_later_week(st, rows):
    weekly = {r["week_start"]: r for r in rows(funnel.steps_per_week(st(("S", "a", W[2], "Won", W[1])), CFG))}
    assert (weekly[W[2]]["steps_surfaced"], weekly[W[2]]["steps_completed"]) == (1, 0)
    assert (weekly[W[1]]["steps_surfaced"], weekly[W[1]]["steps_completed"]) == (0, 1)


def test_g18_silent_sequence_has_zero_rows(cp, st, rows):
    found = rows(funnel.four_stage_funnel(cp(("S", "a", "Start", ago(900))), st(("T", "a", ago(1))), DAY, CFG))
    assert len(found) == 26 and {r["cadence_id"] for r in found} == {"S"}
    assert all(r[s] == 0 for r in found for s in funnel.STAGES)


def test_g19_control_is_not_an_entry(cp, st, rows):
    found = rows(funnel.four_stage_funnel(cp(("S", "a", "Test", ago(1)), ("S", "b", "Test", ago(1))), st(("S", "a", ago(1))), DAY, CFG))
    assert [(r["entries"], r["control"]) for r in found if r["week_start"] == W[0]] == [(0, 2)]


def engagement(cp, st, make, starts, steps=(), mails=()):
    sent = make("comms", [{"comm_id": str(i), "comm_type": "email", "comm_date": t, "workflow_name": n} for i, (n, _, t) in enumerate(mails)])
    to = make("email_msgs", [{"message_id": str(i), "pro_email_address": e} for i, (_, e, _) in enumerate(mails)])
    found = alerts.engagement(cp(*starts), st(*steps), sent, to, DAY, CFG).collect()
    return {r.cadence_id: (r.cohort_size, r.engaged_count) for r in found}


def test_g20_cohort_band(cp, st, make):
    starts = [("S", f"u{d}@x", "Start", ago(d, 0)) for d in (10, 3, 11, 2)]
    assert engagement(cp, st, make, starts) == {"S": (2, 0)}


def test_g21_result_after_the_start(cp, st, make):
    assert engagement(cp, st, make, [("S", "a@x", "Start", ago(5))], [("S", "a@x", ago(20), "Won", ago(4))]) == {"S": (1, 1)}


def test_g22_mail_before_the_start(cp, st, make):
    start = [("S", "a@x", "Start", ago(5, 10))]
    assert engagement(cp, st, make, start, mails=[("1Q S", "a@x", ago(5, 0))]) == {"S": (1, 0)}
    assert engagement(cp, st, make, start, mails=[("1Q s", "a@x", ago(5, 10))]) == {"S": (1, 1)}


def test_two_starts_in_the_band_are_one_person(cp, st, make):
    starts = [("S", "a@x", "Start", ago(9)), ("S", "a@x", "Start", ago(4))]
    assert engagement(cp, st, make, starts, [("S", "a@x", ago(6))]) == {"S": (1, 1)}


def bridge(spark, names, cadences):
    found = comms.name_bridge(spark.createDataFrame([(n,) for n in names], "workflow_name string"),
                              spark.createDataFrame([(c,) for c in cadences], "cadence_id string"))
    return sorted(map(tuple, found.collect()))


def test_g23_nested_names(spark):
    assert bridge(spark, ["1Q Inbound Demo - v1"], ["Inbound", "Inbound Demo", "Outbound"]) == [
        ("1Q Inbound Demo - v1", "Inbound"), ("1Q Inbound Demo - v1", "Inbound Demo")]


def test_g24_names_are_literal(spark):
    assert bridge(spark, ["x a_b y", "x axb y", r"p\q"], ["A_B", r"p\q", "%"]) == [(r"p\q", r"p\q"), ("x a_b y", "A_B")]


def cohort(make, entries, activity):
    base = {"call_flag": 1}
    spark_entries = make("checkpoints", [{"cadence_id": "S", "cadence_step": "Start", "event_timestamp": "2024-01-01", **e} for e in entries])
    accounts = make("account_map", [{"pro_uuid": "p", "organization_id": "o", "account_id": "A"}])
    built = marts.entries(spark_entries, accounts, DAY, CFG)
    acts = make("activity", [{"activity_id": str(i), **base, **a} for i, a in enumerate(activity)])
    return [r.asDict() for r in marts.cohort_performance(built, acts, DAY, CFG).collect()]


def test_g25_both_keys_count_once(make):
    acts = [{"lead_id": "L", "account_id": "A", "activity_date": "2024-01-05"},
            {"lead_id": "L", "activity_date": "2024-01-05"}, {"account_id": "A", "activity_date": "2024-01-05"},
            {"lead_id": "M", "account_id": "B", "activity_date": "2024-01-05"}]
    found = cohort(make, [{"lead_id": "L", "user_id": "p"}], acts)
    assert [(r["unique_id"], r["calls_30_days"], r["calls_60_days"], r["account_lead_id"]) for r in found] == [("L", 3, 3, "A")]


def test_g26_window_ends(make):
    start = date(2024, 1, 1)
    acts = [{"lead_id": "L", "activity_date": start + timedelta(days=d)} for d in (-1, 0, 30, 31, 60, 61)]
    found = cohort(make, [{"lead_id": "L"}], acts)
    assert [(r["calls_30_days"], r["calls_60_days"]) for r in found] == [(2, 4)]


def full_tables(cp, st, make):
    checkpoints = cp(("S", "a@x", "Start", ago(900)), ("S", "a@x", "Start", ago(1)), ("S", "c@x", "Start", ago(5)),
                     ("T", "b@x", "Start", ago(20)))
    steps = surfaced(st, {w: 10 for w in range(1, 26)})
    sent = make("comms", [{"comm_id": "1", "comm_type": "email", "comm_date": ago(3), "workflow_name": "S"}])
    return Tables(checkpoints=checkpoints, steps=steps, comms=sent,
                  email_msgs=make("email_msgs", [{"message_id": "1", "pro_email_address": "z@x"}]))


def test_g27_ids_follow_the_period(cp, st, make):
    t = full_tables(cp, st, make)
    def ids(day):
        return {r.id for r in feed.alert_feed(t, day, CFG).select("id").collect()}
    today, again, tomorrow = ids(DAY), ids(DAY), ids(DAY + timedelta(days=1))
    assert today == again and len(today) >= 4
    weekly = {i for i in today if i[0] in "5789"}
    assert weekly <= tomorrow and not (today - weekly) & tomorrow


def feed_rows(make, *given):
    base = {"check_name": "x", "detail": "", "metric_value": 1.0, "as_of": DAY}
    return make("alert_feed", [{**base, "id": str(i), **g} for i, g in enumerate(given)])


def test_g28_ledger(make, rows):
    now = feed_rows(make, *[{"check_number": 1, "cadence_id": c} for c in ("open", "new", "answered")])
    ledger = make("alert_ledger", [
        {"check_number": 1, "cadence_id": "open", "key": "", "thread": "t", "last_reply": DAY - timedelta(days=1)},
        {"check_number": 1, "cadence_id": "gone", "key": "", "thread": "t"},
        {"check_number": 1, "cadence_id": "answered", "key": "", "thread": "t", "last_reply": DAY}])
    actions = feed.reconcile(now, ledger, DAY)
    assert {r["cadence_id"]: r["action"] for r in rows(actions)} == {"open": "reply", "new": "post", "gone": "resolved", "answered": "skip"}
    kept = rows(feed.next_ledger(actions, DAY))
    assert {r["cadence_id"] for r in kept} == {"open", "new", "answered"} and all(r["last_reply"] == DAY for r in kept)


def test_g29_offenders_fold_case(make, rows):
    alerts_ = feed_rows(make, {"check_number": 1, "cadence_id": "SaaS"}, {"check_number": 2, "cadence_id": "SaaS"},
                        {"check_number": 2, "cadence_id": "SAAS"}, {"check_number": 3, "cadence_id": "SAAS"},
                        {"check_number": 4, "cadence_id": "Other", "metric_value": 99.0})
    found = rows(feed.repeat_offenders(alerts_))
    assert [(r["cadence_upper"], r["n_checks"]) for r in found] == [("SAAS", 3), ("OTHER", 1)]


@pytest.mark.parametrize("age, stale", [(8, False), (9, True)])
def test_g30_staleness(make, rows, age, stale):
    old = feed_rows(make, {"check_number": 1, "cadence_id": "S", "as_of": DAY - timedelta(days=age)})
    assert rows(feed.staleness(old, DAY, CFG))[0]["is_stale"] is stale
    assert rows(feed.staleness(old.filter("false"), DAY, CFG))[0]["is_stale"] is True


def test_g31_rows_after_the_day_change_nothing(cp, st, make):
    t = full_tables(cp, st, make)
    later = Tables(
        checkpoints=t.checkpoints.unionByName(cp(("S", "a@x", "Exit", ago(-1, 0)), ("T", "b@x", "Start", ago(-2)), ("U", "n@x", "Start", ago(-1)))),
        steps=t.steps.unionByName(st(("S", "c@x", ago(-1)))),
        comms=t.comms.unionByName(make("comms", [{"comm_id": "9", "comm_type": "email", "comm_date": ago(-1), "workflow_name": "S"}])),
        email_msgs=t.email_msgs.unionByName(make("email_msgs", [{"message_id": "9", "pro_email_address": "c@x"}])),
    )
    def all_rows(tables):
        frames = [feed.alert_feed(tables, DAY, CFG), funnel.four_stage_funnel(tables.checkpoints, tables.steps, DAY, CFG),
                  diagnostics.diagnose(tables.checkpoints, tables.steps, DAY, CFG)]
        return [sorted(map(str, f.collect())) for f in frames]
    assert all_rows(t) == all_rows(later)


def test_g32_result_after_the_day(st, rows):
    steps = st(("S", "a", ago(1), "Won", ago(-1)), ("S", "a", ago(1), "Won", ago(0)))
    found = snapshot(steps, "steps", DAY).collect()
    assert sorted(str(r["result__c"]) for r in found) == ["None", "Won"]
    assert sum(r["result_date_time__c"] is None for r in found) == 1


def test_padding_and_case(cp, st, rows):
    df = cp((" X ", "a", "Start", ago(1)), ("X", "b", "Start", ago(1)), ("x", "c", "Start", ago(1)))
    assert {r["cadence_id"]: r["entries"] for r in rows(funnel.weekly_entries(df))} == {"X": 2, "x": 1}
    assert [r["variants"] for r in rows(clean.case_duplicates(df))] == ["X | x"]


def test_low_engagement_threshold_is_strict(make, cp, st):
    people = [("S", f"u{i}@x", "Start", ago(5)) for i in range(10)]
    sent = make("comms", []), make("email_msgs", [])
    one = alerts.low_engagement(cp(*people), st(("S", "u0@x", ago(1))), *sent, DAY, CFG)
    assert one.count() == 0
    none = alerts.low_engagement(cp(*people), st(("S", "other@x", ago(1))), *sent, DAY, CFG)
    assert none.count() == 1


def test_digest_branches(make, rows):
    none = feed_rows(make, {"check_number": 1, "cadence_id": "S"}).filter("false")
    assert rows(feed.digest_message(none, DAY))[0]["message"] == "**Cadence Alerts Report — 2024-06-05** — Nothing to report this run."
    assert rows(feed.digest_branch(none))[0]["branch"] == "nothing"
    assert [r["band"] for r in rows(feed.check_overview(none))] == ["clean"] * 9
    one = feed_rows(make, *[{"check_number": 4, "check_name": "Stuck", "cadence_id": c, "metric_value": v, "reference_value": 0.1}
                            for c, v in (("a", 0.2), ("b", 0.9), ("c", 0.5), ("d", 0.3))])
    text = rows(feed.digest_message(one, DAY))[0]["message"]
    assert "1 of the 9 checks flagged: Stuck" in text and text.endswith("1. b — 0.9000\n2. c — 0.5000\n3. d — 0.3000")
    several = one.unionByName(feed_rows(make, {"check_number": 2, "check_name": "Double Starts", "cadence_id": "d"}))
    text = rows(feed.digest_message(several, DAY))[0]["message"]
    assert "2 of the 9 checks flagged" in text and "1. D — 2 checks (Double Starts, Stuck)" in text


def test_reasons_that_vanish_lose_their_share(cp, rows):
    df = cp(("S", "a", "Exit", W[2], "enrolled"), ("S", "b", "Exit", W[2], "lost"), ("S", "c", "Exit", W[1], "lost"))
    found = {(r["week_start"], r["exit_reason"]): r["share_shift"] for r in rows(funnel.exit_reason_shift(df, DAY)) if r["week_start"] == W[1]}
    assert found == {(W[1], "enrolled"): -0.5, (W[1], "lost"): 0.5}


def test_configuration_is_checked():
    with pytest.raises(ValueError):
        Config(min_mean=0)
    with pytest.raises(ValueError):
        Config(exit_rule="last")
