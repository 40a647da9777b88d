"""Checks on literal frames: the cases that each check must tell apart."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from framewatch.operators import rules as R


def flags(df, check):
    return [r.x for r in df.select("seq", check.alias("x")).orderBy("seq").collect()]


def hits(spark, frames, *rules):
    return [(r.seq, r.rule_name) for r in R.evaluate(frames, R.rules_frame(spark, [{"severity": "HIGH", "description": "", "action": "alert", **x} for x in rules])).orderBy("seq", "rule_no").collect()]


def test_strict_length(make):
    f = make([{"data": [0] * 8}, {"data": [0] * 8, "dlc": 9}, {"data": [0] * 4, "dlc": 5}, {"data": [0]}, {"data": [], "dlc": -1}])
    assert flags(f, R.validate_dlc(2)) == [False, True, True, True, True]


def test_frame_format(make):
    f = make([{}, {"can_id": 0x800}, {"can_id": 0x1FFFFFFF, "ext": True}, {"can_id": 0x20000000, "ext": True}, {"err": True}, {"rtr": True}, {"dlc": 9}])
    assert flags(f, R.check_frame_format()) == [False, True, False, True, True, True, True]


@pytest.mark.parametrize(("times", "any_hit"), [([i * 0.01 for i in range(50)], False), ([i * 0.005 for i in range(150)], True), ([i * 0.001 for i in range(100)] + [2.2 + i * 0.001 for i in range(50)], False)])
def test_global_rate(make, times, any_hit):
    f = make([{"t": t, "can_id": 0x100 + i % 30} for i, t in enumerate(times)])
    assert any(r.hit for r in R.check_global_rate(f, 100, 1.0, "hit").collect()) == any_hit


def test_global_rate_counts_ties_in_order(make):
    random.seed(3)
    times = sorted(random.choice([0.0, 0.5, 1.0, 1.2, 2.0, 2.1, 3.3]) for _ in range(60))
    f = make([{"t": t} for t in times])
    got = {r.seq: r.hit for r in R.check_global_rate(f, 9, 1.0, "hit").collect()}
    us = [int(t * 1_000_000) for t in times]
    assert got == {i: sum(1 for j in range(i + 1) if us[j] >= us[i] - 1_000_000) > 9 for i in range(60)}


def test_replay(make):
    same, other = [9] * 8, [9] * 7 + [8]
    at = lambda gaps, datas: make([{"t": sum(gaps[: i + 1]), "data": d} for i, d in enumerate(datas)])
    run = lambda f: flags(R.add_state(f), R.check_replay(1.0))
    assert run(at([0, 0.05], [same, same])) == [False, True]
    assert run(at([0, 0.3, 0.3, 0.3], [same] * 4)) == [False, False, False, True]
    assert run(at([0, 2], [same, same])) == [False, False]
    assert run(at([0, 0.05], [same, other])) == [False, False]


def test_replay_exact_is_the_scan(make):
    random.seed(5)
    t, rows = 0.0, []
    for _ in range(300):
        t += random.choice([0.01, 0.05, 0.2, 0.4, 1.5])
        rows.append({"t": t, "can_id": random.choice([1, 2]), "data": [random.choice([1, 2])]})
    want, memory = {}, {}
    for i, r in enumerate(rows):
        key, us = (r["can_id"], r["data"][0]), int(r["t"] * 1_000_000)
        hit = False
        if key in memory:
            kept, n = memory[key]
            hit = us - kept < 1_000_000 and (n + 1 >= 3 or us - kept < 100_000)
            memory[key] = (kept if hit else us, n + 1)
        else:
            memory[key] = (us, 0)
        want[i] = hit
    assert {r.seq: r.replay for r in R.replay_exact(make(rows), 1.0).collect()} == want


def test_bytes(make):
    f = make([{"data": [0x10, 0, 1, 1, 1, 1, 1, 0xFF]}, {"data": [0x11, 0, 1, 1, 1, 1, 1, 0xFF]}, {"data": [0x10, 0]}])
    assert flags(f, R.check_data_bytes(0x10, 0, None, None, None, None, None, 0xFF)) == [False, True, True]


def test_checksum(make):
    f = make([{"data": [1, 2, 3, 0]}, {"data": [1, 2, 3, 1]}, {"data": [1]}, {"data": []}])
    assert flags(f, R.check_integrity()) == [False, True, True, True]


def test_steering(make):
    le = lambda v: [v & 255, (v >> 8) & 255]
    f = make([{"data": le(100)}, {"data": le(5400)}, {"data": le(-5400)}, {"data": le(5500)}, {"data": [1]}])
    assert flags(f, R.check_steering(-540.05, 540.05)) == [False, False, False, True, True]


def test_repetition(make):
    run = lambda datas: flags(R.add_state(make([{"t": i * 0.5, "data": d} for i, d in enumerate(datas)])), R.check_repetition(5))
    assert not any(run([[i] for i in range(10)]))
    assert run([[7]] * 7) == [False] * 5 + [True, True]
    assert not any(run([[7]] * 5 + [[8]] + [[7]] * 5))


def test_frame_type(make):
    f = make([{}, {"ext": True, "can_id": 0x12345}, {"can_id": 0x900}])
    assert flags(f, R.check_frame_type("standard")) == [False, True, True]
    assert flags(f, R.check_frame_type("extended")) == [True, False, True]


def test_source(make):
    rows = [{"can_id": 0x7E0, "source": s, "t": i} for i, s in enumerate([1, 2, 3, 1, 4])] + [{"can_id": 0x100, "source": 9, "t": 9}]
    assert flags(R.add_state(make(rows)), R.check_source([])) == [False] * 4 + [True, False]
    assert flags(R.add_state(make(rows)), R.check_source([1]))[:4] == [False, True, True, False]


def test_counter_skips_empty_frames(make):
    f = R.add_state(make([{"t": i, "data": d} for i, d in enumerate([[1], [2], [], [3], [5]])]))
    assert flags(f, R.check_counter()) == [False, False, False, False, True]


def test_content_alone_alerts_and_gates_later_checks(spark, make):
    f = make([{"data": [0xDE, 0xAD, 1], "can_id": 0x200}, {"data": [0, 0xAD, 1], "can_id": 0x200}])
    assert hits(spark, f, {"name": "p", "can_id": 0x200, "data_pattern": "DE AD"}) == [(0, "p")]
    assert hits(spark, f, {"name": "p", "can_id": 0x200, "data_pattern": "DE AD", "max_frequency": 5, "time_window": 1}) == []
    assert hits(spark, f, {"name": "p", "data_pattern": "DE AD", "dlc_min": 8}) == [(0, "p"), (1, "p")]


def test_early_exit_takes_rules_of_the_id_first(spark, make):
    f = make([{"can_id": 5}])
    rules = [{"name": "global critical", "dlc_min": 9, "priority": 0}, {"name": "own", "can_id": 5, "dlc_min": 9, "priority": 5}, {"name": "global late", "dlc_min": 9, "priority": 6}]
    full = R.evaluate(f, R.rules_frame(spark, [{"severity": "LOW", "description": "", "action": "log", **r} for r in rules]))
    assert {r.rule_name for r in R.early_exit(full).collect()} == {"own", "global critical"}


def test_pattern_types_list_or_map(spark, make):
    f = make([{"data": [0, 0]}, {"data": []}, {"data": [1, 2, 4]}])
    for kinds in (["all_zeros"], {"all_zeros": True}):
        assert hits(spark, f, {"name": "z", "check_payload_pattern": True, "pattern_types": kinds}) == [(0, "z"), (1, "z")]


def test_no_frames(spark, make):
    f = make([{}]).filter("false")
    assert hits(spark, f, {"name": "x", "can_id": 1, "check_timing": True, "expected_interval": 1, "interval_variance": 1}, {"name": "y", "global_message_rate": 5}) == []


def test_no_python_in_rule_checks(spark, make):
    from framewatch.plans.queries_rules import DEMO_RULES

    plan = R.evaluate(make([{}]), R.rules_frame(spark, DEMO_RULES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan


def test_scopes_are_counted_as_they_are_joined(spark, make):
    rules = [{"name": "own", "severity": "LOW", "can_id": 5}, {"name": "own too", "severity": "LOW", "can_id": 5}, {"name": "range", "severity": "LOW", "can_id_range": [4, 6]}, {"name": "listed", "severity": "LOW", "whitelist_mode": True, "allowed_can_ids": [5, 9]}, {"name": "all", "severity": "LOW", "validate_dlc": True}]
    frames = make([{"can_id": c} for c in (4, 5, 5, 7, 9, None)])
    for some in (rules, rules[2:], rules[:1]):
        table = R.rules_frame(spark, some)
        one = R.statistics(frames, R.evaluate(frames, table), table).first()
        assert one.avg_rules == R.match_scope(frames, table).count() / 6
