"""Streamed state of payloads in buckets, and batches of several files."""

from __future__ import annotations

import glob

import duckdb
import numpy as np
import pandas as pd
import pytest

from framewatch.plans import ORACLE, QUERIES, queries_analytics
from framewatch.streaming import state as ST

SF = "/root/testdata/sf0.001"


class Store:
    """A value or map state in memory that counts what is asked of it."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def _count(self, result=None):
        self.calls += 1
        return result

    def get(self):
        return self._count(self.held.get(()))

    def update(self, value):
        self._count(self.held.update({(): value}))

    def getValue(self, key):
        return self._count(self.held.get(key))

    def updateValue(self, key, value):
        self._count(self.held.update({key: value}))

    def removeKey(self, key):
        self._count(self.held.pop(key))

    def iterator(self):
        return iter(list(self.held.items()))


class Handle:
    def __init__(self):
        self.states = {}

    def getValueState(self, name, *schema):
        return self.states.setdefault(name, Store())

    getMapState = getValueState

    def registerTimer(self, at):
        pass


class Expired:
    def __init__(self, ms):
        self.ms = ms

    def getExpiryTimeInMs(self):
        return self.ms


def batches(seed, sizes):
    """Frames at a microsecond each whose payloads repeat now and then, null and empty ones among them."""
    rng, t = np.random.default_rng(seed), 0
    for size in sizes:
        payload = [None if v % 97 == 0 else "" if v % 89 == 0 else f"{v:016X}" for v in rng.integers(0, 6000, size).tolist()]
        time = np.arange(t, t + size)
        yield pd.DataFrame({"bus": "b", "seq": time, "ts_us": time, "can_id": 1, "dlc": 8, "data": [[0]] * size, "is_extended": False, "is_remote": False, "is_error": False, "payload": payload, "nibble": 0, "source": None})
        t += size


@pytest.mark.parametrize("memory", [None, 900])
def test_payloads_in_buckets(memory):
    """Gaps and repeats are those of a plain loop, and a batch asks for far fewer values than it has payloads."""
    handle = Handle()
    state = ST.IdState([], 0, True, memory)
    state.init(handle)
    seen, distinct = {}, 0
    for batch in batches(3, [2500, 1, 4000, 30, 4000]):
        out = pd.concat(list(state.handleInputRows(("b", 1), iter([batch]), None)))
        for t, p, gap, repeats in zip(batch["ts_us"], batch["payload"], out["_gap_us"], out["_repeats"]):
            last, n = seen.get(p, (None, -1))
            known = last is not None and (memory is None or t - last <= memory)
            assert (None if pd.isna(gap) else gap) == (t - last if known else None)
            assert repeats == (n + 1 if known else 0)
            seen[p] = (t, repeats)
        distinct += batch["payload"].nunique(dropna=False)
    assert sum(s.calls for s in handle.states.values()) < distinct / 10
    held = handle.states["seen"]
    assert sum(len(ST.unpacked(v[0])) for v in held.held.values()) == len(seen) == handle.states["size"].held[()][0]
    if memory is not None:
        list(state.handleExpiredTimer(("b", 1), None, Expired(10)))  # forgets what is older than 10 000 - 2 * 900
        left = [t for v in held.held.values() for t in ST.unpacked(v[0]).column("ts_us").to_pylist()]
        assert sorted(left) == sorted(t for t, _ in seen.values() if t >= 8200)
        assert handle.states["size"].held[()][0] == len(left)


@pytest.mark.parametrize("name", ["T8_dedup_alerts", "T11_late_frames", "T7_bursts"])
def test_batches_of_many_files(spark, monkeypatch, name):
    """No result depends on the files of a batch; some of them are empty here."""
    wrote = []
    real = queries_analytics.written_as
    monkeypatch.setattr(queries_analytics, "FILE_ROWS", 40)
    monkeypatch.setattr(queries_analytics, "written_as", lambda *a: wrote.append(real(*a)) or wrote[-1])
    got = sorted(map(tuple, QUERIES[name](spark, SF).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    assert got == sorted(con.execute(ORACLE[name]).fetchall())
    (path, files), = wrote
    assert files > 2 and len(glob.glob(f"{path}/*.parquet")) % files == 0
