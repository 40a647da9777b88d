"""PCAP captures of SocketCAN frames, a file in as many tasks as it has ranges of bytes.

A range begins at the first record in it. Records have no marks between them, and bytes
within a record may look like a header, so a range is followed from every place in it
where its first record may begin to where the records leave it. Nearly all of these
chains meet; which one holds follows from the range before, from the file's first record
on. A range is read up to where the next one begins, and its last record must end
there exactly; if not, the file is no such capture and the read fails.

Files are opened by the tasks (by path, or by any URI that Arrow's file systems
know); ``io.read_pcap`` reads whole files through Spark instead, from any store.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewatch.sources.io import frame_columns
from framewatch.storage import kept

#: Bytes of a range, and of a record at most.
RANGE, LONGEST = 64 << 20, 1 << 16
#: The first four bytes of a file, its byte order and the units of a fraction in a second.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\xa1\xb2\xc3\xd4": (">", 10**6), b"\x4d\x3c\xb2\xa1": ("<", 10**9), b"\xa1\xb2\x3c\x4d": (">", 10**9)}
HEAD, RECORD = 24, 16
#: Link headers that may stand before the frame, in bytes.
LINKS = (0, 14, 16, 18)
_LOOK = pa.schema([("path", pa.string()), ("length", pa.int64()), ("start", pa.int64()), ("usual", pa.int64()), ("entries", pa.list_(pa.int64())), ("leaves", pa.list_(pa.int64()))])
_FRAMES = "file string, at long, us long, id long, ext boolean, rtr boolean, err boolean, d array<int>"


def _open(path: str) -> pa.NativeFile:
    system, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return system.open_input_file(name)


def _headers(data: np.ndarray, at: np.ndarray, order: str) -> np.ndarray:
    """The four numbers of the record headers at some places."""
    return np.ascontiguousarray(data[at[:, None] + np.arange(RECORD)]).view(order + "u4").astype(np.int64)


def exits(data: bytes, stop: int, order: str, units: int, last: bool) -> dict[int, int | None]:
    """For each place before ``stop`` where the first record of a range may begin: where the records from there on first reach ``stop`` (None: they don't). ``last``: the file ends with the data."""
    unpack, n = struct.Struct(order + "IIII").unpack_from, len(data)
    at = np.arange(max(0, min(stop, LONGEST + RECORD, n - RECORD + 1)))
    h = _headers(np.frombuffer(data, np.uint8), at, order)
    likely = at[(h[:, 1] < units) & (h[:, 2] <= h[:, 3]) & (h[:, 3] < LONGEST) & (h[:, 2] > 0)]
    after = dict(zip(likely.tolist(), (likely + RECORD + h[likely, 2]).tolist()))

    def ahead(q: int, upto: int) -> int | None:
        """The first record from ``q`` on at ``upto`` or later."""
        while q < upto:
            if q + RECORD > n:
                return None
            _, part, size, whole = unpack(data, q)
            if part >= units or not 0 < size <= whole < LONGEST:
                return None
            q += RECORD + size
        return q

    # Chains from the places looked at go on together, the hindmost first, so that those that meet are followed once.
    beyond = {q: [q] for q in set(after.values()) if q >= len(at)}
    queue, left = list(beyond), {}
    heapq.heapify(queue)
    while queue:
        q = heapq.heappop(queue)
        ids = beyond.pop(q)
        to = ahead(q, stop if not queue else min(stop, queue[0] + 1))
        if to is None or to >= stop:
            left |= dict.fromkeys(ids, None if to is None or last and to != n else to)
        elif to in beyond:
            beyond[to] += ids
        else:
            beyond[to] = ids
            heapq.heappush(queue, to)
    out: dict[int, int | None] = {}
    for q in sorted(after, reverse=True):
        out[q] = left[after[q]] if after[q] >= len(at) else out.get(after[q])
    return out


def _look(path: str, start: int, length: int, size: int) -> tuple[int | None, list[int], list[int | None]] | None:
    """Of a range: where most of its chains leave it, and the begins and ends of the others; None if the file is no capture."""
    with _open(path) as file:
        kind = MAGIC.get(file.read_at(4, 0))
        if kind is None:
            return None
        begin = max(start, HEAD)
        stop = min(start + size, length)
        data = file.read_at(max(0, min(stop + RECORD, length) - begin), begin)
    found = {begin + q: None if to is None else begin + to for q, to in exits(data, stop - begin, *kind, stop == length).items()}
    common = Counter(to for to in found.values() if to is not None).most_common(1)
    usual = common[0][0] if common else None
    others = [q for q, to in found.items() if to != usual]
    return usual, others, [found[q] for q in others]


def same_lengths(data: np.ndarray, at: int, order: str) -> tuple[int, int]:
    """The length of the record at a place, and how many in a row have it."""
    size = int(_headers(data, np.array([at]), order)[0, 2])
    step, count = RECORD + size, 1
    limit = (len(data) - at) // step
    if limit < 1:
        raise ValueError("a record goes on past its range")
    while count < limit:
        ahead = np.arange(count, min(limit, count + 4096))
        differ = np.flatnonzero(_headers(data, at + ahead * step, order)[:, 2] != size)
        if len(differ):
            return size, int(ahead[differ[0]])
        count = int(ahead[-1]) + 1
    return size, count


def frames_in(records: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of records of one length (a row each): which hold a frame, its id word, number of data bytes and where its data begin."""
    n, size = records.shape
    found, word, dlc, begin = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for skip in LINKS:
        if size - skip < 8 or size - skip > 16:
            continue
        w = np.ascontiguousarray(records[:, skip : skip + 4]).view(">u4")[:, 0].astype(np.int64)
        k = records[:, skip + 4].astype(np.int64)
        plain = (w & 0x80000000 == 0) & (w & 0x1FFFF800 != 0)
        ok = ~found & (k <= 8) & (8 + k <= size - skip) & ~plain & (records[:, skip + 5 : skip + 8] == 0).all(axis=1)
        word[ok], dlc[ok], begin[ok] = w[ok], k[ok], skip + 8
        found |= ok
    return found, word, dlc, begin


def parsed(data: np.ndarray, order: str, units: int, offset: int) -> Iterator[dict[str, pa.Array]]:
    """The frames of a range that holds whole records, the first of them at its begin."""
    at = 0
    while at < len(data):
        if at + RECORD > len(data):
            raise ValueError("a record goes on past its range")
        size, count = same_lengths(data, at, order)
        step = RECORD + size
        block = data[at : at + count * step].reshape(count, step)
        h = np.ascontiguousarray(block[:, :RECORD]).view(order + "u4").astype(np.int64)
        records = block[:, RECORD:]
        found, word, dlc, begin = frames_in(records) if size else (np.zeros(count, bool),) * 4
        which = np.flatnonzero(found)
        word, dlc, begin = word[which], dlc[which], begin[which]
        flat = np.repeat(np.arange(len(which)), dlc)
        inner = np.arange(dlc.sum()) - np.repeat(np.cumsum(dlc) - dlc, dlc)
        bytes_ = records[which[flat], begin[flat] + inner].astype(np.int32)
        yield {
            "at": pa.array(offset + at + which * step), "us": pa.array(h[which, 0] * 1_000_000 + h[which, 1] * 1_000_000 // units),
            "id": pa.array(word & np.where(word & 0x80000000, 0x1FFFFFFF, 0x7FF)), "ext": pa.array(word & 0x80000000 != 0), "rtr": pa.array(word & 0x40000000 != 0), "err": pa.array(word & 0x20000000 != 0),
            "d": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(dlc)]), pa.int32()), pa.array(bytes_)),
        }
        at += count * step


def ranges(spark: SparkSession, path: str | list[str], size: int = RANGE) -> DataFrame:
    """(path, begin, past) of the ranges of whole records: each is followed from all places where it may begin, then a file's ranges are put together from its first record on."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    starts = files.filter("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(size))).alias("start"))
    dealt = starts.repartition("path", "start")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                found = _look(r["path"], r["start"], r["length"], size)
                if found is not None:
                    yield pa.RecordBatch.from_pylist([{**r, "usual": found[0], "entries": found[1], "leaves": found[2]}], _LOOK)

    def follow(part: pa.Table) -> pa.Table:
        rows = part.sort_by("start").to_pylist()
        at, begins = HEAD, []
        for r in rows:
            if at is not None and at < min(r["start"] + size, r["length"]):
                begins.append(at)
                at = dict(zip(r["entries"], r["leaves"])).get(at, r["usual"])
        length = rows[0]["length"]
        return pa.table({"path": pa.array([rows[0]["path"]] * len(begins), pa.string()), "begin": pa.array(begins, pa.int64()), "past": pa.array([*begins[1:], length][: len(begins)], pa.int64())})

    found = dealt.mapInArrow(look, "path string, length long, start long, usual long, entries array<long>, leaves array<long>")
    return kept(found.groupBy("path").applyInArrow(follow, "path string, begin long, past long"), "ranges")


def read_pcap_ranges(spark: SparkSession, path: str | list[str], size: int = RANGE) -> DataFrame:
    """PCAP files in the frame schema, ``size`` bytes a task; seq is the byte at which the record begins, bus the file's name.

    Files that don't begin as captures do are left out, and so are records without a
    frame. A last record that is cut off fails the read.
    """
    dealt = ranges(spark, path, size).repartition("path", "begin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with _open(r["path"]) as file:
                    kind = MAGIC[file.read_at(4, 0)]
                    data = np.frombuffer(file.read_at(r["past"] - r["begin"], r["begin"]), np.uint8)
                try:
                    for part in parsed(data, *kind, r["begin"]):
                        yield pa.RecordBatch.from_pydict({"file": pa.array([r["path"]] * len(part["at"]), pa.string()), **part})
                except ValueError as e:
                    raise ValueError(f"{r['path']}, bytes {r['begin']} to {r['past']}: {e}") from None

    rows = dealt.mapInArrow(run, _FRAMES)
    return frame_columns(rows, seq=F.col("at"), ts_us=F.col("us"), can_id=F.col("id"), dlc=F.size("d"), data=F.col("d"), is_extended=F.col("ext"), is_remote=F.col("rtr"), is_error=F.col("err"), source_file=F.col("file"), bus=F.regexp_extract("file", r"([^/]+)$", 1))


def write_pcap(frames: DataFrame, folder: str) -> None:
    """Frames as PCAP files in a folder that all tasks share, a file for each partition, in its order; a task that runs again writes the same file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder) if folder.startswith("file:") else folder)
        system.create_dir(name, recursive=True)
        number = TaskContext.get().partitionId()
        count = 0
        with system.open_output_stream(f"{name}/part-{number:06d}.pcap") as out:
            out.write(b"\xd4\xc3\xb2\xa1\x02\x00\x04\x00" + bytes(8) + (65535).to_bytes(4, "little") + (227).to_bytes(4, "little"))
            for batch in batches:
                n = batch.num_rows
                raw = np.zeros((n, RECORD + 16), np.uint8)
                us = batch.column("ts_us").to_numpy()
                sizes = np.full(n, 16, np.int64)
                raw[:, :RECORD] = np.stack([us // 1_000_000, us % 1_000_000, sizes, sizes], axis=1).astype("<u4").view(np.uint8).reshape(n, RECORD)
                flag = lambda c, bit: np.where(np.array(batch.column(c).to_pylist(), bool), bit, 0)  # noqa: E731, B023
                word = batch.column("can_id").to_numpy().astype(np.int64) | flag("is_extended", 0x80000000) | flag("is_remote", 0x40000000) | flag("is_error", 0x20000000)
                raw[:, RECORD : RECORD + 4] = word.astype(">u4").view(np.uint8).reshape(n, 4)
                data = batch.column("data")
                sizes = np.diff(data.offsets.to_numpy())
                flat = data.flatten().to_numpy()
                row = np.repeat(np.arange(n), sizes)
                raw[:, RECORD + 4] = sizes
                raw[row, RECORD + 8 + np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
                out.write(raw.tobytes())
                count += n
        yield pa.RecordBatch.from_pydict({"frames": [count]})

    columns = frames.select("ts_us", "can_id", "is_extended", "is_remote", "is_error", F.coalesce("data", F.expr("cast(array() as array<int>)")).alias("data"))
    columns.mapInArrow(write, "frames long").agg(F.sum("frames")).collect()
