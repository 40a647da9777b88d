"""Streams give what batch gives, however frames fall into files, batches and restarts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from framewatch.operators import rules as R
from framewatch.streaming import stream as S

RULES = [
    {"name": "sources", "severity": "HIGH", "can_id": 0x7E0, "check_source": True},
    {"name": "replay", "severity": "HIGH", "check_replay": True, "replay_time_threshold": 200.0},
    {"name": "constant", "severity": "LOW", "check_repetition": True, "repetition_threshold": 1},
    {"name": "counter", "severity": "LOW", "can_id": 5, "check_counter": True},
    {"name": "flood", "severity": "LOW", "can_id": 5, "max_frequency": 4, "time_window": 30.0},
    {"name": "timing", "severity": "LOW", "can_id": 5, "check_timing": True, "expected_interval": 20000.0, "interval_variance": 9000.0, "consecutive_required": 3, "payload_repetition_threshold": 0.3},
]


def some_frames(n):
    """Frames of two ids some twenty seconds apart, so that a minute passes between the repeats of a payload."""
    rng, t, rows = random.Random(n), 0.0, []
    for i in range(n):
        t += rng.choice([0.05, 5, 20, 40, 70])
        diagnostic = rng.random() < 0.4
        rows.append({"t": t, "can_id": 0x7E0 if diagnostic else 5, "source": rng.randrange(5) if diagnostic else None, "data": [rng.choice([1, 2, 3]), rng.choice([7, 8])] if rng.random() < 0.95 else []})
    return rows


def put(make, rows, path, first=0):
    frames = make([{**r, "seq": first + i} for i, r in enumerate(rows)]).withColumn("ts", F.timestamp_micros("ts_us")).withColumn("source_file", F.lit(None).cast("string"))
    frames.coalesce(1).write.mode("append").parquet(path)


def alerts(df):
    return sorted((r.seq, r.rule_name) for r in df.collect())


@pytest.mark.parametrize("files,memory", [(1, None), (4, None), (12, None), (4, 60_000_000), (1, 60_000_000)])
def test_any_batches_give_what_batch_gives(spark, make, tmp_path, files, memory):
    rows = some_frames(48)
    rules = R.rules_frame(spark, RULES)
    want = alerts(R.evaluate(make(rows), rules, memory))
    assert {n for _, n in want} == {r["name"] for r in RULES}
    if memory:
        assert want != alerts(R.evaluate(make(rows), rules))
    path = str(tmp_path / "in")
    for k in range(files):
        part = range(len(rows) * k // files, len(rows) * (k + 1) // files)
        put(make, [rows[i] for i in part], path, part[0])
    stream = S.detect_rules(S.enrich(S.read_frames(spark, path, per_batch=1), rules, memory), rules)
    assert alerts(S.drain(stream, "hits")) == want


def test_a_restart_goes_on_where_it_ended(spark, make, tmp_path):
    rows, path, out = some_frames(40), str(tmp_path / "in"), str(tmp_path / "out")
    rules = R.rules_frame(spark, RULES)
    for part in (range(15), range(15, 40)):
        put(make, [rows[i] for i in part], path, part[0])
        stream = S.detect_rules(S.enrich(S.read_frames(spark, path), rules), rules)
        S.write_alerts(stream.select("seq", "rule_name"), out, str(tmp_path / "c"), once=True).awaitTermination()
    assert alerts(spark.read.json(out)) == alerts(R.evaluate(make(rows), rules))


def test_late_frames_are_counted_over_all_batches(spark, make, tmp_path):
    """More batches than a query remembers the progress of."""
    path = str(tmp_path / "in")
    times = [[100.0], [200.0, 199.0], [1.0, 2.0, 300.0], [400.0, 5.0], [500.0], [6.0, 600.0]]
    for k, part in enumerate(times):
        put(make, [{"t": t, "can_id": 5} for t in part], path, k * 10)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", 2)
    try:
        rows, late = S.count_late(S.enrich(S.read_frames(spark, path, per_batch=1), R.rules_frame(spark, RULES), drop_late=True))
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert late == 4 and sorted(r.ts_us // 1_000_000 for r in rows.collect()) == [100, 199, 200, 300, 400, 500, 600]
