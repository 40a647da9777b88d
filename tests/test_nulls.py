"""Null keys, repeated rows, rule files as they are found, and no limit where the rules ask for more."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from framewatch.operators import alerts as A
from framewatch.operators import rules as R
from framewatch.operators import windows as W
from framewatch.sources import io
from framewatch.storage import shared_dir
from framewatch.streaming import stream as S

ALERT = "bus string, seq long, ts_us long, can_id int, rule_name string, severity string, confidence double, description string, action string"


def alert(seq, t, bus="b", can_id=1, rule="r", severity="HIGH"):
    return (bus, seq, int(t * 1_000_000), can_id, rule, severity, 0.9, "", "alert")


def test_alerts_without_an_id_a_severity_or_a_bus_are_kept(spark):
    rows = [alert(0, 0), alert(1, 0, can_id=None), alert(2, 0, severity=None), alert(3, 0, bus=None), alert(4, 30, can_id=None), alert(5, 60, can_id=None), alert(6, 10, severity=None), alert(7, 10, rule=None)]
    df = spark.createDataFrame(rows, ALERT)
    assert sorted(r.seq for r in A.dedup(df).collect()) == [0, 1, 2, 3, 5, 7]
    assert sorted(r.seq for r in A.rate_limit(df, 2, sliding=True).collect()) == [0, 1, 3, 4, 5, 6, 7]
    assert A.process(df, min_severity="INFO").count() == 6


def test_repeated_alerts_count_one_by_one(spark):
    df = spark.createDataFrame([alert(1, 0)] * 5 + [alert(2, 2)] * 2, ALERT)
    assert A.dedup(df).count() == 1
    assert A.rate_limit(df, 3).count() == A.rate_limit(df, 3, sliding=True).count() == 5
    assert A.dedup(df.limit(0)).count() == A.rate_limit(df.limit(0), 3, sliding=True).count() == 0


def test_frames_without_a_bus_and_repeated_ones_pass_all_joins(spark, make):
    frames = make([{"seq": i // 2, "t": i // 2, "bus": None if i % 4 < 2 else "b", "can_id": 0x7E0, "source": i} for i in range(20)])
    assert W.running_sum(frames, F.lit(1), "n").count() == 20
    assert W.first_seen(frames, ("can_id",)).count() == 20
    assert R.add_state(frames).count() == R.replay_exact(frames).count() == 20
    rules = [{"name": "s", "severity": "LOW", "check_source": True}, {"name": "g", "severity": "LOW", "global_message_rate": 3, "time_window": 100, "can_id_range": [0, 2047]}, {"name": "i", "severity": "LOW", "can_id": 0x7E0, "global_message_rate": 9, "time_window": 100}]
    hits = R.evaluate(frames, R.rules_frame(spark, rules)).groupBy("rule_name").count().collect()
    assert {r.rule_name: r["count"] for r in hits} == {"s": 14, "g": 14, "i": 2}


RULES = """
rules:
- {name: limit, severity: HIGH, description: d, action: alert, can_id: 5, max_frequency: 222.6, time_window: 1, priority: 3}
- {name: unknown field, severity: HIGH, no_such_field: 1}
- {name: bad value, severity: HIGH, max_frequency: often}
- {severity: LOW}
- just text
- {name: map, severity: LOW, pattern_types: {all_zeros: true}, check_payload_pattern: true, priority: 1}
- {name: wide, severity: LOW, can_id: 4, byte_ranges_by_id: {4: {0: [1, 2]}}, expected_dlc_by_id: {4: 8}, sigma_extreme: 2, priority: null}
"""


def test_a_bad_rule_is_left_out_not_the_file(spark, tmp_path):
    (tmp_path / "r.yaml").write_text(RULES)
    with pytest.warns(UserWarning, match="left out"):
        rows = io.load_rules(spark, str(tmp_path / "r.yaml")).orderBy("rule_no").collect()
    assert [(r.name, r.priority, r.max_frequency) for r in rows] == [("limit", 3, 222), ("wide", 5, None), ("map", 1, None)]
    assert rows[1].byte_ranges_by_id == {4: {0: [1, 2]}} and rows[1].sigma_extreme == 2.0 and rows[2].pattern_types == ["all_zeros"]
    (tmp_path / "none.yaml").write_text("")
    assert io.load_rules(spark, str(tmp_path / "none.yaml")).count() == 0


def test_a_limit_over_a_hundred_fires_in_the_stream_as_in_batch(spark, make, tmp_path):
    frames = make([{"t": i / 1000, "can_id": 5} for i in range(400)])
    rules = R.rules_frame(spark, [{"name": "flood", "severity": "HIGH", "can_id": 5, "max_frequency": 222.6, "time_window": 1}, {"name": "few", "severity": "LOW", "max_frequency": 5, "time_window": 0.002}])
    frames.withColumn("ts", F.timestamp_micros("ts_us")).withColumn("source_file", F.lit(None).cast("string")).write.parquet(str(tmp_path / "in"))
    out = S.drain(S.detect_rules(S.enrich(S.read_frames(spark, str(tmp_path / "in")), rules), rules), "hits").collect()
    batch = R.evaluate(frames, rules).collect()
    assert {(r.seq, r.rule_name) for r in out} == {(r.seq, r.rule_name) for r in batch} == {(i, "flood") for i in range(221, 400)}


def test_the_shared_folder_must_be_set_on_a_cluster(spark):
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: {"spark.master": "spark://host:7077"}.get(key, default))

    with pytest.raises(ValueError, match="share"):
        shared_dir(Cluster())
