"""Byte strings of a given length that occur twice anywhere, found by sorting suffixes, and texts without them.

A window is ``length`` consecutive bytes of one text. Its anchor is the least gram
of bytes in it (by hash, the leftmost of equal ones), which depends on nothing but
the window's bytes: equal windows have equal anchors at equal places. The windows
of one anchor are neighbours, so that about one suffix in ``length`` / 2 stands
for all, that at the anchor. A suffix is a key of three 64-bit tokens: its core,
the bytes that all its windows share, and the whole stretch they cover, twice.

Suffixes are range-partitioned by their leading tokens with sampled splitters; ties
are dealt on by text and place, so that no common string fills a bucket. Buckets
sort by multikey quicksort and compare neighbours; the first and last suffix of each
bucket are compared with those of the buckets beside it. A suffix that shares all
tokens with a neighbour is repeated with all its windows; one that shares no core
has no repeated window; of the others, and of one repeated suffix on each side of
such a place in the order, the windows are split by their distance from the anchor
into cells, each a suffix with a longer core, and sorted again: cells of 47, of 6
and of 1 window for a length of 400. Work beyond the first sort grows with the
edges of repeated passages, not with their bytes.

Strings are equal if 128 bits of two polynomial hashes are: at 10**14 suffixes the
odds of one wrong match are about 10**-10. Texts are told apart by their MD5.

Null and empty texts, and those shorter than ``length``, have nothing to remove.
Repeated rows are different places: a text of ``length`` bytes and more that two
rows have goes whole. Bytes, not characters, are removed; what is left is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewatch.llm.common import SLICE_BYTES, kept, released, slices, texts, widened
from framewatch.llm.words import buffer, mix, powers

LENGTH, GRAM, CELLS = 400, 32, 8
#: Windows of a text that a task turns into numpy at a time, and suffixes that are sorted without more partitioning.
PIECE, SMALL = 1 << 20, 1 << 12
SUFFIX = "key binary, lo int, pos int, cell int, first int, last int, core long, full_a long, full_b long"
_TOKENS = ["core", "full_a", "full_b"]
_LANES = [(base | 1, pow(base | 1, -1, 1 << 64), np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) for base, seed in ((0x9E3779B97F4A7C15, 11), (0xC2B2AE3D27D4EB4F, 12))]


class Spans:
    """Hashes of any spans of some bytes, in two independent lanes."""

    def __init__(self, data: np.ndarray, lanes: int = 2):
        self.sums = []
        for base, _, table in _LANES[:lanes]:
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(table[data] * powers(base, len(data)), out=total[1:])
            self.sums.append(total)

    def __call__(self, lane: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        total = self.sums[lane]
        return mix((total[ends] - total[starts]) * powers(_LANES[lane][1], len(total))[starts] ^ (ends - starts).astype(np.uint64))


def gram_of(length: int) -> int:
    return max(1, min(GRAM, length // 8))


def key_of(text: str | Column) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")))


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def _stretches(data: np.ndarray, places: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """The runs of windows with one anchor in some texts that lie one after the other: text, first and last window, anchor (in bytes of ``data``), tokens."""
    gram = gram_of(length)
    n = len(data) - length + 1
    if n <= 0:
        return {}
    spans = Spans(data)
    at = np.arange(len(data) - gram + 1)
    grams = spans(0, at, at + gram)
    chosen = least((grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64), length - gram + 1)
    anchor = (chosen & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(places) - 1), np.diff(places))[:n]
    inside = np.arange(n) + length <= places[row + 1]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1]) | (row[1:] != row[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    live = inside[first]
    first, last = first[live], last[live]
    pos = anchor[first]
    return {"row": row[first], "first": first, "last": last, "pos": pos, "core": grams[pos], "full_a": spans(0, first, last + length), "full_b": spans(1, first, last + length)}


def anchored(docs: DataFrame, length: int, piece_size: int = PIECE) -> DataFrame:
    """The suffixes of all windows of ``docs`` (key, text), one for each run of windows with the same anchor; runs end where a long text is taken in pieces."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            keys = piece.column("key")
            data, places = buffer(texts(piece.column("text")))
            step = piece_size if len(data) > 2 * piece_size else max(1, len(data))
            for at in range(0, len(data), step):
                end = min(at + step + length - 1, len(data))
                got = _stretches(data[at:end], np.clip(places - at, 0, end - at), length)
                if not got:
                    continue
                begin = places[got["row"]] - at
                lo = (got["first"] - begin).astype(np.int32)
                columns = [keys.take(pa.array(got["row"])), lo, got["pos"] - begin, np.zeros(len(lo)), lo, got["last"] - begin]
                columns = columns[:1] + [pa.array(np.asarray(c).astype(np.int32)) for c in columns[1:]]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(got[t].view(np.int64)) for t in _TOKENS)], names=["key", "lo", "pos", "cell", "first", "last", *_TOKENS])

    return docs.mapInArrow(find, SUFFIX)


def multikey_order(tokens: list[np.ndarray]) -> np.ndarray:
    """The order of keys of several tokens by multikey quicksort: three parts by one token, the middle one goes on with the next."""
    order = np.arange(len(tokens[0]))
    todo = [(0, len(order), 0)]
    while todo:
        low, high, depth = todo.pop()
        if high - low < 2 or depth == len(tokens):
            continue
        part = order[low:high]
        if high - low <= SMALL:
            order[low:high] = part[np.lexsort([t[part] for t in reversed(tokens[depth:])])]
            continue
        v = tokens[depth][part]
        pivot = np.sort(v[:: max(1, len(v) // 63)])[min(len(v), 63) // 2]
        less, more = v < pivot, v > pivot
        below, above = part[less], part[more]
        order[low:high] = np.concatenate([below, part[~less & ~more], above])
        todo += [(low, low + len(below), depth), (low + len(below), high - len(above), depth + 1), (high - len(above), high, depth)]
    return order


def _sorted_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket in order; ``left`` and ``right`` are the leading tokens shared with the neighbours, -1 where the bucket ends."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    bucket = pa.Table.from_batches(held).combine_chunks()
    tokens = [bucket.column(t).to_numpy() for t in _TOKENS]
    order = multikey_order(tokens)
    shared = np.zeros(len(order) - 1, np.int32)
    same = np.ones(len(order) - 1, bool)
    for t in tokens:
        same &= t[order[1:]] == t[order[:-1]]
        shared += same
    bucket = bucket.take(pa.array(order))
    bucket = bucket.append_column("bucket", pa.array(np.full(len(order), TaskContext.get().partitionId(), np.int32)))
    bucket = bucket.append_column("left", pa.array(np.append(np.int32(-1), shared))).append_column("right", pa.array(np.append(shared, np.int32(-1))))
    yield from bucket.to_batches(max_chunksize=1 << 16)


def ranked(suffixes: DataFrame) -> DataFrame:
    """``suffixes`` with the number of leading tokens that each shares with the one before (``left``) and behind it (``right``) in the order of all."""
    base = kept(suffixes, "suffixes")  # written, as the splitters are sampled from it first
    dealt = base.repartitionByRange(*_TOKENS, "key", "lo", "cell")
    out = kept(dealt.mapInArrow(_sorted_bucket, widened(base, bucket="integer", left="integer", right="integer")), "buckets")
    released(base)
    ends = sorted(out.filter("left < 0 or right < 0").select("bucket", F.col("left") < 0, F.col("right") < 0, *_TOKENS).collect(), key=lambda r: r[0])  # two rows a bucket
    beside: dict[int, list[int]] = {r[0]: [0, 0] for r in ends}
    for a, b in zip([r for r in ends if r[2]], [r for r in ends if r[1]][1:]):
        both = [x == y for x, y in zip(a[3:], b[3:])]
        beside[a[0]][1] = beside[b[0]][0] = both.index(False) if False in both else len(both)
    borders = out.sparkSession.createDataFrame([(k, *v) for k, v in beside.items()], "bucket int, __before int, __after int")
    out = out.join(F.broadcast(borders), "bucket")
    return out.withColumn("left", F.when(F.col("left") < 0, F.col("__before")).otherwise(F.col("left"))).withColumn("right", F.when(F.col("right") < 0, F.col("__after")).otherwise(F.col("right"))).drop("bucket", "__before", "__after")


def _verdicts(suffixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, first, last) of the windows found repeated, and the suffixes that have to be split."""
    found = ranked(suffixes)
    repeated = found.filter((F.col("left") == len(_TOKENS)) | (F.col("right") == len(_TOKENS))).select("key", "first", "last").distinct()
    undecided = found.filter(F.col("left").between(1, len(_TOKENS) - 1) | F.col("right").between(1, len(_TOKENS) - 1)).select("key", "lo", "pos", "cell", "last")
    repeated, undecided = kept(repeated, "repeated"), kept(undecided, "undecided")
    released(found)
    return repeated, undecided


def _with_bytes(docs: DataFrame, suffixes: DataFrame, length: int) -> DataFrame:
    """The bytes that the windows of ``suffixes`` cover, once for each text and place, from ``docs`` (key, text)."""
    wanted = suffixes.groupBy("key").agg(F.collect_set(F.struct("lo", "pos", "last")).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            data, places = buffer(texts(piece.column("text")))
            at = piece.column("at")
            row = np.repeat(np.arange(len(at)), np.diff(at.offsets.to_numpy()))
            lo, pos, last = (at.flatten().field(i).to_numpy() for i in range(3))
            chunks = [data[places[r] + a : places[r] + b + length].tobytes() for r, a, b in zip(row, lo, last)]
            yield pa.RecordBatch.from_arrays([piece.column("key").take(pa.array(row)), pa.array(lo), pa.array(pos), pa.array(last), pa.array(chunks, pa.binary())], names=["key", "lo", "pos", "last", "bytes"])

    return docs.join(wanted, "key").mapInArrow(cut, "key binary, lo int, pos int, last int, bytes binary").dropDuplicates(["key", "lo"])


def _cells(stretches: DataFrame, width: int, parent: int, length: int) -> DataFrame:
    """The suffixes of the cells of ``width`` windows within the cells of ``parent`` windows that ``stretches`` lists in ``cells``."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "bytes", SLICE_BYTES):
            data, places = buffer(piece.column("bytes").cast(pa.large_binary()))
            spans = Spans(data)
            cells = piece.column("cells")
            row = np.repeat(np.arange(len(cells)), np.diff(cells.offsets.to_numpy()))
            start = cells.flatten().to_numpy().astype(np.int64)
            step = np.arange(0, parent, width)
            row, start, inner = np.repeat(row, len(step)), np.repeat(start, len(step)), np.tile(step, len(start))
            lo, pos, last = (piece.column(c).to_numpy().astype(np.int64)[row] for c in ("lo", "pos", "last"))
            begin = start + inner  # the least distance of a window's start from the anchor
            end = np.minimum(begin + width, start + parent)
            first, final = np.maximum(lo, pos - end + 1), np.minimum(last, pos - begin)
            live = first <= final
            row, begin, end, lo, pos, first, final = (v[live] for v in (row, begin, end, lo, pos, first, final))
            base = places[row] - lo
            core = mix(spans(0, base + pos - begin, base + pos - end + 1 + length) + begin.astype(np.uint64))
            columns = [piece.column("key").take(pa.array(row)), *(pa.array(v.astype(np.int32)) for v in (lo, pos, begin, first, final)), pa.array(core.view(np.int64))]
            columns += [pa.array(spans(lane, base + first, base + final + length).view(np.int64)) for lane in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "lo", "pos", "cell", "first", "last", *_TOKENS])

    return stretches.mapInArrow(split, SUFFIX)


def repeated_windows(docs: DataFrame, length: int = LENGTH, piece_size: int = PIECE) -> DataFrame:
    """(key, first, last): for each distinct text of ``docs`` (key, text) runs of windows, by first byte, that occur at another place too."""
    found, undecided = _verdicts(anchored(docs, length, piece_size))
    out = [found]
    stretches = kept(_with_bytes(docs, undecided, length), "stretches")
    parent = length - gram_of(length) + 1
    cells = stretches.withColumn("cells", F.array(F.lit(0)))
    while parent > 1:
        width = -(-parent // CELLS)
        found, undecided = _verdicts(_cells(cells, width, parent, length))
        out.append(found)
        cells = stretches.join(undecided.groupBy("key", "lo").agg(F.collect_set("cell").alias("cells")), ["key", "lo"])
        parent = width
    all_found = out[0]
    for more in out[1:]:
        all_found = all_found.unionByName(more)
    return all_found


def removed(first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of bytes, as starts and ends, that runs of windows cover."""
    order = np.argsort(first, kind="stable")
    starts, ends = first[order], np.maximum.accumulate(last[order] + length)
    new = np.concatenate([[True], starts[1:] > ends[:-1]]) if len(starts) else np.zeros(0, bool)
    return starts[new], ends[np.append(np.flatnonzero(new)[1:], len(ends)) - 1] if len(starts) else ends


def cut(docs: DataFrame, text: str = "text", length: int = LENGTH, piece_size: int = PIECE) -> DataFrame:
    """``docs`` with ``spans`` (start and end byte of each removed run) and ``kept`` (the bytes that are left); columns of these names are replaced."""
    whole = docs.select(key_of(f"`{text}`").alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text}`").alias("text"))
    found = repeated_windows(whole.select("key", "text"), length, piece_size).groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("windows"))
    schema = widened(whole.select("row"), spans="array<struct<start:int,end:int>>", kept="binary")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for piece in slices(batches, "text"):
            data, places = buffer(texts(piece.column("text")))
            spans, left = [], []
            for i, windows in enumerate(piece.column("windows")):
                whole = data[places[i] : places[i + 1]]
                runs = windows.values
                starts, ends = removed(runs.field(0).to_numpy(), runs.field(1).to_numpy(), length) if runs is not None else ((), ())
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(starts, ends)])
                edges = [0, *(int(v) for pair in zip(starts, ends) for v in pair), len(whole)]
                left.append(b"".join(whole[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays([piece.column("row"), pa.array(spans, kind), pa.array(left, pa.binary())], names=["row", "spans", "kept"])

    out = whole.join(found, "key", "left").select("row", "text", "windows").mapInArrow(take, schema)
    return out.select(*(F.col(f"row.`{c}`") for c in docs.columns if c not in ("spans", "kept")), "spans", "kept")
