"""Greedy helpers against plain loops, slab invariance, file formats, learning."""

from __future__ import annotations

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewatch.functions import payload as P
from framewatch.operators import alerts as A
from framewatch.operators import calibrate as C
from framewatch.operators import detect as D
from framewatch.operators import features as FT
from framewatch.operators import ml as M
from framewatch.operators import windows as W
from framewatch.sources import io
from framewatch.streaming import stream as S


def one(make, data, column):
    return make([{"data": data}]).select(column.alias("x")).first().x


def test_payload(make):
    assert one(make, [7] * 8, P.entropy("data")) == 0.0
    assert one(make, list(range(8)), P.entropy("data")) == 3.0
    assert one(make, [], P.entropy("data")) == 0.0
    assert one(make, [], P.stats("data")).asDict() == {k: 0.0 for k in ("mean", "median", "std", "min", "max", "range", "sum", "zeros", "ones")}
    assert one(make, [], P.patterns("data")).sequential_pattern == 0.0
    assert one(make, [1], P.patterns("data")).ascending_bytes == 0.0
    assert one(make, [8], P.hamming("data", F.array(F.lit(9), F.lit(1)))) == 2
    assert one(make, [1], P.hex_to_bytes(F.lit("0xDEADF"))) == [0xDE, 0xAD]
    assert one(make, [1], P.hex_to_bytes(F.lit("zz"))) is None
    assert one(make, [0xDE, 5, 0xAD], P.matches_pattern("data", F.lit("DE * AD"))) is True
    assert one(make, [0xDE], P.matches_pattern("data", F.lit("DE AD"))) is False


def alerts(spark, n, seed):
    random.seed(seed)
    t, rows = 0, []
    for i in range(n):
        t += random.choice([0, 10_000, 400_000, 20_000_000, 60_000_000])
        rows.append((random.choice("ab"), i, t, random.choice([1, 2]), random.choice(["r", "s"]), random.choice(["LOW", "HIGH"])))
    return rows, spark.createDataFrame(rows, "bus string, seq long, ts_us long, can_id int, rule_name string, severity string")


def test_dedup_counts_from_the_kept_alert(spark):
    rows, df = alerts(spark, 400, 1)
    kept, want = {}, set()
    for bus, seq, t, cid, rule, sev in rows:
        key = (bus, rule, cid, sev)
        if key not in kept or t - kept[key] >= 60_000_000:
            kept[key] = t
            want.add(seq)
    assert {r.seq for r in A.dedup(df, 60).collect()} == want


def test_sliding_rate_limit(spark):
    rows, df = alerts(spark, 300, 2)
    want, kept = set(), {"a": [], "b": []}
    for bus, seq, t, *_ in rows:
        if sum(1 for k in kept[bus] if t - k < 1_000_000) < 2:
            kept[bus].append(t)
            want.add(seq)
    assert {r.seq for r in A.rate_limit(df, 2, sliding=True).collect()} == want


def test_ten_alerts_at_once_leave_two(spark):
    df = spark.createDataFrame([("b", i, 5, 1, "r", "HIGH") for i in range(10)], "bus string, seq long, ts_us long, can_id int, rule_name string, severity string")
    assert A.rate_limit(df, 2).count() == 2


def random_frames(make, n, seed, ids=5):
    random.seed(seed)
    t, rows = 0.0, []
    for _ in range(n):
        t += random.choice([0.0, 0.0002, 0.01, 0.3, 2.0])
        rows.append({"t": t, "bus": random.choice("xy"), "can_id": random.randrange(ids), "data": [random.randrange(3) for _ in range(random.randrange(9))]})
    return rows, make(rows)


def test_slabs_make_no_difference(make):
    _, f = random_frames(make, 300, 4)
    ask = lambda slab: sorted(tuple(r) for r in FT.communication(f, slab).select("bus", "seq", "total_messages", "unique_can_ids").collect())
    assert ask(1_000_000) == ask(10**12)
    blocks, w = W.bus_blocks(f, 3, 1_000_000)
    got = {r.seq: r.p for r in blocks.withColumn("p", F.lag("seq", 3).over(w)).filter("_native = 1").collect()}
    whole = {r.seq: r.p for r in f.withColumn("p", F.lag("seq", 3).over(W.by_bus())).collect()}
    assert got == whole


def test_burst_is_the_scan(make):
    rows, f = random_frames(make, 200, 6)
    out = {r.seq: (r.burst_size, r.is_burst) for r in FT.burst(C.with_delta(f), 0.05).collect()}
    last, run, want = {}, {}, {}
    for i, r in enumerate(rows):
        us = int(r["t"] * 1_000_000)
        delta = (us - last.get((r["bus"], r["can_id"]), us)) / 1e6
        last[r["bus"], r["can_id"]] = us
        run[r["bus"]] = run.get(r["bus"], 1) + 1 if delta < 0.05 else 1
        want[i] = (run[r["bus"]], int(run[r["bus"]] > 3))
    assert out == want


def test_prefilter_stream_is_batch(spark, make, tmp_path):
    _, f = random_frames(make, 200, 8)
    expected = C.prefilter_intervals(f.filter("can_id < 4"))
    batch = {(r.bus, r.seq): r.suspicious for r in D.prefilter(f, expected).collect()}
    f.withColumn("ts", F.timestamp_micros("ts_us")).withColumn("source_file", F.lit(None).cast("string")).write.parquet(str(tmp_path / "in"))
    out = S.drain(S.prefilter(S.read_frames(spark, str(tmp_path / "in")), expected), "p")
    assert {(r.bus, r.seq): r.suspicious for r in out.collect()} == batch


def test_csv(spark, tmp_path):
    (tmp_path / "DoS-1.csv").write_text("timestamp,arbitration_id,data_field,attack\n1672531200.000001,0C1,3000000430000004,0\nx,0C1,00,0\n1.5,zz,00,0\n2.5,1F4,0g,1\n3.5,18FF1234,ABC,1\n")
    rows = io.read_can_csv(spark, str(tmp_path)).orderBy("ts_us").collect()
    assert [(r.ts_us, r.can_id, r.data, r.is_extended, r.attack) for r in rows] == [(3_500_000, 0x18FF1234, [0xAB], True, 1), (1_672_531_200_000_001, 0xC1, [0x30, 0, 0, 4, 0x30, 0, 0, 4], False, 0)]
    assert {r.attack_type for r in io.read_dataset(spark, str(tmp_path)).collect()} == {"dos"}


def test_candump(spark, tmp_path):
    (tmp_path / "a.log").write_text("# comment\n(1234.567890) can0 123#DEADBEEF\n(1.0) can0 12345678#00\n(2.0) can0 100#\n(3.0) can0 100#R\ninvalid line format\n(4.0) can0 1#ABC\n")
    rows = {r.ts_us: (r.can_id, r.data, r.is_extended, r.is_remote) for r in io.read_candump(spark, str(tmp_path / "a.log")).collect()}
    assert rows == {1_234_567_890: (0x123, [0xDE, 0xAD, 0xBE, 0xEF], False, False), 1_000_000: (0x12345678, [0], True, False), 2_000_000: (0x100, [], False, False), 3_000_000: (0x100, [], False, True), 4_000_000: (1, [0xAB], False, False)}
    (tmp_path / "b.log").write_text("(1.0) can0 100#01\n101#02\n102#03\n2.0 can0 123 [4] DE AD BE EF\n104#05\n")
    assert [(r.ts_us, r.can_id) for r in io.read_candump(spark, str(tmp_path / "b.log"), "all").orderBy("seq").collect()] == [(1_000_000, 0x100), (1_001_000, 0x101), (1_002_000, 0x102), (2_000_000, 0x123), (2_001_000, 0x104)]


@pytest.mark.parametrize(("order", "magic", "unit"), [("<", b"\xd4\xc3\xb2\xa1", 1), (">", b"\xa1\xb2\xc3\xd4", 1), ("<", b"\x4d\x3c\xb2\xa1", 1000)])
def test_pcap(spark, tmp_path, order, magic, unit):
    frame = struct.pack(">IB3x", 0x123, 3) + bytes([1, 2, 3])
    long = b"\0" * 16 + struct.pack(">IB3x", 0x80000000 | 0x12345, 1) + b"\x09"
    body = magic + b"\0" * 20
    for i, f in enumerate((frame, long)):
        body += struct.pack(order + "IIII", 5 + i, 250 * unit, len(f), len(f)) + f
    (tmp_path / "x.pcap").write_bytes(body)
    rows = io.read_pcap(spark, str(tmp_path / "x.pcap")).orderBy("seq").collect()
    assert [(r.ts_us, r.can_id, r.data) for r in rows][0] == (5_000_250, 0x123, [1, 2, 3])
    assert (rows[1].can_id, rows[1].is_extended, rows[1].data) == (0x12345, True, [9])


def test_rules_yaml(spark, tmp_path):
    io.save_rules(spark, [{"name": "a", "severity": "LOW", "can_id": 5, "priority": 7}, {"severity": "LOW"}, {"name": "b", "severity": "HIGH", "expected_dlc_by_id": {5: 8}}], str(tmp_path / "r.yaml"))
    assert [(r.name, r.priority, r.expected_dlc_by_id) for r in io.load_rules(spark, str(tmp_path / "r.yaml")).orderBy("rule_no").collect()] == [("a", 7, None), ("b", 5, {5: 8})]


def test_scaler(spark):
    df = spark.createDataFrame([(0.0, 100.0, 3.0), (10.0, 200.0, 3.0)], "a double, b double, c double")
    s = M.fit_scaler(df, ["a", "b", "c"])
    assert tuple(M.transform(spark.createDataFrame([(5.0, 150.0, 3.0)], df.schema), s).first()) == (0.5, 0.5, 0.0)
    with pytest.raises(ValueError):
        M.fit_scaler(df, ["a"], "other")


def test_isolation_forest_finds_the_odd_one(spark):
    rng = np.random.default_rng(1)
    rows = [("b", i, i, 1, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(500, 2)))] + [("b", 500, 500, 1, 40.0, -40.0)]
    df = spark.createDataFrame(rows, "bus string, seq long, ts_us long, can_id int, x double, y double")
    scored = M.isolation_forest_score(df, M.isolation_forest_fit(df, ["x", "y"], trees=20, contamination=0.01))
    assert scored.orderBy("score").first().seq == 500
    assert M.ml_alerts(scored, ["x", "y"]).filter("seq = 500").count() == 1


def test_upper_median(make):
    f = make([{"t": t} for t in (0, 1, 3, 6, 10)])
    assert C.prefilter_intervals(f).first().expected == 3.0


def test_bare_lines_in_stretches(spark, tmp_path):
    """The last time is carried over stretches without any; no window sees a whole file."""
    lines = ["1#00", "2#00"] + [line for i in range(6) for line in (f"({i + 10}.5) c 3#01", *["4#02", "what"] * (7 * (i % 3)))]
    (tmp_path / "a.log").write_text("\n".join(lines))
    at, want = None, []
    for line in lines:
        if line != "what":
            at = int(float(line[1:5]) * 1e6) if line[0] == "(" else (at or 0) + 1000
            want.append(at)
    for stretch in (3, 1 << 16):
        got = io.read_candump(spark, str(tmp_path), "all", stretch)
        assert [r.ts_us for r in got.orderBy("seq").collect()] == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_slab" in plan and "_group" not in plan
