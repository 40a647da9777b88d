"""Rows that are far enough apart, taken in slabs, are those of one scan."""

from __future__ import annotations

import random

import numpy as np
import pytest

from framewatch.operators import alerts as A
from framewatch.operators import apart


def scan(times, width):
    out, last = [], None
    for t in sorted(set(times)):
        if last is None or t - last >= width:
            out.append(t)
            last = t
    return out


def test_functions_of_slabs_compose():
    rng = random.Random(1)
    for _ in range(300):
        width, slab = rng.randrange(1, 40), rng.choice([5, 13, 64])
        times = np.array(sorted({rng.randrange(-100, 300) for _ in range(rng.randrange(1, 120))}))
        last, found = np.array([apart.NEVER]), []
        for node in range(int(times[0] // slab), int(times[-1] // slab) + 1):
            own = times[times // slab == node]
            found += own[apart.keep_apart(own, width, int(last[0]))].tolist()
            if len(own):
                last = apart.after(*apart.steps(own, apart.last_kept(own, width), node * slab + width), last, width)
        assert found == scan(times.tolist(), width)
        assert last[0] == found[-1]


@pytest.mark.parametrize("slab_us,fan", [(1_000, 2), (7_000, 3), (10**9, 32)])
def test_kept_rows_are_those_of_a_scan(spark, slab_us, fan):
    rng, width = random.Random(slab_us), 2_500
    times = {("a", None): [i * 10 for i in range(3_000)], (None, 5): [rng.randrange(-9_000, 30_000) for _ in range(400)], ("b", 5): [4], ("c", 1): [rng.randrange(0, 40) * 1_000 for _ in range(30)]}
    rows = spark.createDataFrame([(b, i, t) for (b, i), ts in times.items() for t in sorted(set(ts))], "bus string, can_id int, ts_us long")
    got: dict = {k: [] for k in times}
    for r in apart.first_apart(rows, ["bus", "can_id"], width, slab_us, fan).collect():
        got[r.bus, r.can_id].append(r.ts_us)
    assert {k: sorted(v) for k, v in got.items()} == {k: scan(v, width) for k, v in times.items()}


def test_alerts_of_one_flooding_signature(spark):
    alerts = spark.createDataFrame([("b", "r", None, "HIGH", i * 7_000, i % 3) for i in range(2_000)] * 2, "bus string, rule_name string, can_id int, severity string, ts_us long, seq long")
    want = scan([i * 7_000 for i in range(2_000)], 1_000_000)
    for slab_us in (300_000, 10**10):
        assert sorted(r.ts_us for r in A.dedup(alerts, 1.0, slab_us).collect()) == want
    assert A.dedup(alerts, 0.0).count() == 4_000
    assert A.dedup(alerts.filter("false")).count() == 0
