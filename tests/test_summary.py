"""Profiles of periods, merged, are those of all frames."""

from __future__ import annotations

import random

import numpy as np
import pytest

from framewatch.operators import summary as SU
from framewatch.sources import io


def some_frames(make):
    rng, rows, now = random.Random(2), [], {("a", 1): 0.0, ("a", None): 0.0, (None, 1): 50.0}
    for i in range(3_000):
        key = rng.choice([*now])
        now[key] += rng.choice([0.01, 0.02, 0.5]) * rng.random()
        rows.append({"t": now[key], "bus": key[0], "can_id": key[1], "seq": i})
    return make([*rows, {"t": 7, "bus": "alone", "can_id": 3, "seq": 5_000}]), rows


def exact(rows):
    times: dict = {}
    for r in rows:
        times.setdefault((r["bus"], r["can_id"]), []).append(int(r["t"] * 1_000_000))
    return {k: np.diff(np.sort(v)) / 1_000_000 for k, v in times.items()}


@pytest.mark.parametrize("period_us", [5_000_000, SU.DAY_US])
def test_merged_periods_are_one_profile(spark, make, tmp_path, period_us):
    frames, rows = some_frames(make)
    io.save_profile(SU.interval_summary(frames, period_us=period_us), str(tmp_path / "p"))
    merged = SU.merge(io.load_profile(spark, str(tmp_path / "p")))
    got = {(r.bus, r.can_id): r for r in SU.statistics(merged, quantiles=(0.05, 0.5, 0.95)).collect()}
    want = exact(rows)
    assert got.keys() == want.keys()
    for key, gaps in want.items():
        r = got[key]
        assert r.n == len(gaps)
        assert (r.iat_mean, r.iat_std, r.iat_min, r.iat_max) == pytest.approx((gaps.mean(), gaps.std(), gaps.min(), gaps.max()), abs=1e-9)
        for q, value in ((0.05, r.iat_p5), (0.5, r.iat_p50), (0.95, r.iat_p95)):
            assert (gaps < value).mean() - 0.01 <= q <= (gaps <= value).mean() + 0.01


def test_merging_in_steps_and_empty(spark, make):
    frames, rows = some_frames(make)
    parts = [SU.interval_summary(frames.filter(f"ts_us div 20000000 {c}"), period_us=4_000_000) for c in ("= 0", "= 1", "> 1")]
    early = SU.merge(parts[0].unionByName(parts[1]))
    twice = {(r.bus, r.can_id): (r.n, r.mean, r.m2) for r in SU.merge(early.unionByName(parts[2])).collect()}
    for key, gaps in exact(rows).items():
        assert twice[key] == pytest.approx((len(gaps), gaps.mean(), gaps.var() * len(gaps)), rel=1e-9)
    assert twice["alone", 3][0] == 0
    assert SU.statistics(SU.merge(SU.interval_summary(frames.filter("false")))).count() == 0
