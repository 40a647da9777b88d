"""Captures read in ranges equal those read whole, whatever the ranges."""

from __future__ import annotations

import random
import struct

import pytest

from framewatch.sources import io, pcap

COLUMNS = ["ts_us", "can_id", "dlc", "data", "is_extended", "is_remote", "is_error", "bus"]


def capture(rng, n, order, magic, nanos):
    out = magic + bytes(20)
    for i in range(n):
        size = rng.choice([8, 8, 3, 0])
        word = rng.choice([0x123, 0x7FF, 0x80000000 | 0x12345, 0x40000000 | 0x55, 0x20000001])
        frame = bytes(rng.choice(pcap.LINKS)) + struct.pack(">IB3x", word, size) + bytes(rng.randrange(256) for _ in range(size)) + bytes(rng.choice([0, 8 - size]))
        if rng.random() < 0.1:
            frame = bytes(rng.randrange(256) for _ in range(rng.choice([4, 40, 300])))
        out += struct.pack(order + "IIII", 1_700_000_000 + i, rng.randrange(10**6) * nanos, len(frame), len(frame)) + frame
    return out


def rows(df):
    return sorted(tuple(str(r[c]) for c in COLUMNS) for r in df.collect())


@pytest.mark.parametrize(("order", "magic", "nanos"), [("<", b"\xd4\xc3\xb2\xa1", 1), (">", b"\xa1\xb2\xc3\xd4", 1), ("<", b"\x4d\x3c\xb2\xa1", 1000)])
def test_ranges_equal_whole_files(spark, tmp_path, order, magic, nanos):
    rng = random.Random(7)
    for name in ("a", "b"):
        (tmp_path / f"{name}.pcap").write_bytes(capture(rng, 400, order, magic, nanos))
    (tmp_path / "c.pcap").write_bytes(b"no capture")
    (tmp_path / "d.pcap").write_bytes(b"")
    want = rows(io.read_pcap(spark, str(tmp_path)))
    assert len(want) > 500
    for size in (300, 5000, 1 << 20):
        found = pcap.ranges(spark, str(tmp_path), size)
        assert found.count() > (20 if size == 300 else 1)
        assert rows(pcap.read_pcap_ranges(spark, str(tmp_path), size)) == want


def test_written_frames_come_back(spark, make, tmp_path):
    rng = random.Random(3)
    frames = make([{"t": i / 7, "can_id": rng.choice([0x12, 0x7FF, 0x1FFFFFFF]), "data": [rng.randrange(256) for _ in range(rng.randrange(9))], "rtr": i % 3 == 0} for i in range(300)])
    frames = frames.selectExpr("* except (is_extended)", "can_id > 2047 as is_extended")
    pcap.write_pcap(frames.repartition(2), str(tmp_path / "out"))
    got = pcap.read_pcap_ranges(spark, str(tmp_path / "out"), 1000)
    keep = COLUMNS[:-1]
    assert sorted(map(str, got.select(*keep).collect())) == sorted(map(str, frames.select(*keep).collect()))
    one = got.filter("bus = 'part-000000.pcap'").orderBy("seq")
    assert [r.seq for r in one.select("seq").collect()] == [24 + 32 * i for i in range(one.count())]


def test_a_cut_off_record_fails(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(capture(random.Random(1), 50, "<", b"\xd4\xc3\xb2\xa1", 1)[:-3])
    with pytest.raises(Exception, match="past its range"):
        pcap.read_pcap_ranges(spark, str(tmp_path)).collect()


def test_a_payload_that_looks_like_a_header(spark, tmp_path):
    """Eight zero bytes before a record of second 24 read as the header of a record that ends with the next but one: a chain that holds from there on."""
    one = lambda us, data: struct.pack("<IIII", 24, us, 16, 16) + struct.pack(">IB3x", 0x123, len(data)) + data.ljust(8, b"\0")
    (tmp_path / "a.pcap").write_bytes(b"\xd4\xc3\xb2\xa1" + bytes(20) + b"".join(one(100 + i, b"\1\2\3\4") for i in range(300)))
    want = rows(io.read_pcap(spark, str(tmp_path)))
    assert len(want) == 300
    for size in (300, 1000, 3200):
        assert rows(pcap.read_pcap_ranges(spark, str(tmp_path), size)) == want
