"""State of an id in segments equals state by plain windows, whatever the segments."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from framewatch.operators import calibrate as C
from framewatch.operators import detect as D
from framewatch.operators import features as FT
from framewatch.operators import hot
from framewatch.operators import rules as R

COLUMNS = ["seq", "_n", "interval_ms", "_payload", "_nibble", "_counter_before", "_run_length", "_gap_us", "_repeats", "_source", "_sources", "_intervals", "_payloads", "_back_1", "_back_4", "_back_9"]


def some_frames(n, seed):
    rng, t, rows = random.Random(seed), 0.0, []
    for _ in range(n):
        t += rng.choice([0, 0.001, 0.3, 2, 200])
        rows.append({"t": t, "bus": rng.choice(["a", "a", "a", None]), "can_id": rng.choice([0x7E0, 0x7E0, 0x7E0, 5, None]), "source": rng.choice([None, *range(6)]), "data": rng.choice([[1, 2], [1, 2], [rng.randrange(4)], [], None])})
        if rows[-1]["data"] is None:
            rows[-1] |= {"data": [], "dlc": 0}
    return rows


def values(df):
    return sorted(tuple(str(r[c]) for c in COLUMNS) for r in df.select(*COLUMNS).collect())


@pytest.mark.parametrize("slab_us,block,memory", [(1_000_000, 10, None), (3_600_000_000, 7, 2_000_000)])
def test_segments_give_what_windows_give(spark, make, slab_us, block, memory):
    frames = make(some_frames(240, 3)).withColumn("data", F.expr("if(seq % 11 = 0, null, data)"))
    plain = R.state_by_id(frames, True, memory, 7, [1, 4, 9])
    assert values(hot.segmented_state(frames, True, memory, 7, [1, 4, 9], slab_us, block)) == values(plain)


def test_hot_ids_are_taken_apart_and_put_together(spark, make):
    frames = make(some_frames(300, 4))
    assert 0 < hot.hot_ids(frames, 50).count() < hot.hot_ids(frames, 0).count()
    want = values(R.state_by_id(frames, True, None, 7, [1, 4, 9]))
    assert values(R.state_by_id(frames, True, None, 7, [1, 4, 9], hot_rows=50)) == want
    assert values(R.state_by_id(frames, True, None, 7, [1, 4, 9], hot_rows=0)) == want


FEATURES = {
    "interarrival": FT.interarrival,
    "rates": FT.rates,
    "interval_stats": FT.interval_stats,
    "behavior": FT.behavior,
    "base47": FT.base47,
    "ml23": FT.ml23,
    "id_frequency": lambda f, busy: FT.id_frequency(f, busy=busy),
    "id_count": lambda f, busy: FT.id_frequency(f, "count", busy),
    "basic9": FT.basic9,
    "tree12": FT.tree12,
    "lags": lambda f, busy: FT.lags(f, ["ts_us", "dlc"], 3, busy),
    "hamming": lambda f, busy: C.with_hamming(f, busy=busy),
    "delta": lambda f, busy: C.with_delta(f, busy=busy),
    "prefilter": lambda f, busy: D.prefilter(f, f.sparkSession.createDataFrame([("a", 5, 0.3), ("a", 0x7E0, None)], "bus string, can_id int, expected double"), busy=busy),
}


@pytest.mark.parametrize("name", FEATURES)
def test_features_of_hot_ids_are_those_of_plain_windows(spark, make, name):
    frames = make(some_frames(500, 5)).withColumn("data", F.expr("if(seq % 11 = 0, array(), data)"))
    feature = FEATURES[name]
    plain = feature(frames, hot.busy(frames))
    rounded = lambda df: sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in df.select(plain.columns).collect())
    want = rounded(plain)
    assert len(want) == 500
    busy = hot.busy(frames, rows=60, block=7, slab_us=1_000_000)
    assert busy.ids is not None
    assert rounded(feature(frames, busy)) == want


def test_one_hot_id_lies_in_many_blocks(spark, make):
    frames = make([{"t": i * 0.001} for i in range(900)])
    busy = hot.busy(frames, rows=100, block=50)
    rows, _ = busy.rows_back(frames, 10)
    sizes = [r[0] for r in rows.groupBy("_block").agg(F.count("*")).select("count(1)").collect()]
    assert len(sizes) >= 18 and max(sizes) <= 60


def test_rate_reads_no_sliding_range(spark, make):
    """The oldest frame of the last minute by windows that only grow, equal to a plain loop."""
    rng, t, rows = random.Random(6), 0.0, []
    for _ in range(400):
        t += rng.choice([0, 0, 0.5, 20, 59.999999, 60, 60.000001, 90])
        rows.append({"t": round(t, 6), "bus": rng.choice(["a", None]), "can_id": rng.choice([5, None])})
    out = FT.id_frequency(make(rows))
    assert "RangeFrame, -60000000" not in out._jdf.queryExecution().optimizedPlan().toString()
    mine = {r["seq"]: r for r in out.collect()}
    for r in mine.values():
        span = [o.ts_us for o in mine.values() if (o.bus, o.can_id) == (r.bus, r.can_id) and r.ts_us - 60_000_000 <= o.ts_us and (o.ts_us, o.seq) <= (r.ts_us, r.seq)]
        assert r.id_frequency == pytest.approx(len(span) / (r.ts_us - min(span)) * 1e6 if r.ts_us > min(span) else 0.0)
