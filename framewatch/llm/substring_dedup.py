"""Removal of word passages that an earlier document already has, by FM-indexes of shards.

A window is ``window`` consecutive words of a document. Each window belongs to the
shard of its minimizer, the least hash among the short word grams inside it: equal
windows have equal minimizers, so every repeat meets in one shard, and neighbouring
windows mostly share theirs, so they travel as one segment. Minimizers that only
one document has cannot hold a repeat; they are counted first (map-side combined)
and their segments stay at home
(a broadcast filter of fixed size says which; beyond its capacity, a join does). A shard indexes its distinct segments, streams
them through backward search, and learns for each window the least document id in
its interval; windows of documents with a larger id are reported back.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewatch.llm.common import Marks, kept, slices, texts, widened
from framewatch.llm.fmindex import FMIndex
from framewatch.llm.words import grams, words

WINDOW = 13
GRAM = 4
#: Windows in one segment at most; a longer run of one minimizer (repeated words) is cut.
SEGMENT = 64
#: Words of the segments that a shard indexes at a time.
SHARD_WORDS = 1 << 20


def minimizers(hashes: np.ndarray, row: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place where a window starts within one row: the place, and the window's minimizer."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = grams(hashes, gram)
    least = g[:n].copy()
    for i in range(1, window - gram + 1):
        np.minimum(least, g[i : n + i], out=least)
    at = np.flatnonzero(row[:n] == row[window - 1 :])
    return at, least[at].view(np.int64)


def runs(at: np.ndarray, least: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of neighbouring windows of a row with one minimizer, cut to SEGMENT: indexes into ``at`` of first and past last."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1) | (row[at][1:] != row[at][:-1])
    place = np.arange(len(at))
    start = np.maximum.accumulate(np.where(new, place, 0))
    new |= (place - start) % SEGMENT == 0
    low = np.flatnonzero(new)
    return low, np.append(low[1:], len(at))


def _seeds(window: int, gram: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            w = words(texts(batch.column("text")))
            row = w.row_of_word()
            at, least = minimizers(w.hashes, row, window, gram)
            low, _ = runs(at, least, row)
            pair = np.empty(len(low), [("m", np.int64), ("d", np.int64)])
            pair["m"], pair["d"] = least[low], batch.column("doc_id").to_numpy()[row[at[low]]]
            pair = np.unique(pair)
            yield pa.RecordBatch.from_arrays([pa.array(pair["m"]), pa.array(pair["d"])], names=["m", "doc"])

    return run


def _segments(window: int, gram: int, known: Callable[[np.ndarray, pa.RecordBatch, np.ndarray], np.ndarray]) -> Callable:
    """Segments of a document whose minimizer ``known`` marks: minimizer, document, crc of its text, first word, 32-bit words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            column = texts(batch.column("text"))
            w = words(column)
            row = w.row_of_word()
            at, least = minimizers(w.hashes, row, window, gram)
            low, high = runs(at, least, row)
            keep = known(least[low], batch, row[at[low]])
            low, high = low[keep], high[keep]
            if not len(low):
                continue
            first, size = at[low], high - low + window - 1
            offsets = np.concatenate([[0], np.cumsum(size)])
            place = np.repeat(first - offsets[:-1], size) + np.arange(offsets[-1])
            small = w.hashes.astype(np.uint32)[place]
            binary = pa.Array.from_buffers(pa.binary(), len(low), [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(small)])
            rows = row[first]
            data = memoryview(w.data)
            byte = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(column), np.int64))])
            tags = np.array([zlib.crc32(data[a:b]) for a, b in zip(byte[:-1], byte[1:])], np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(least[low]), pa.array(batch.column("doc_id").to_numpy()[rows]), pa.array(tags[rows].astype(np.int64)), pa.array((first - w.offsets[rows]).astype(np.int32)), binary],
                names=["m", "doc", "tag", "start", "words"],
            )

    return run


def _removed(window: int, offsets: np.ndarray, symbols: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows (segment, place in it) of one shard that also start in a segment of a smaller document."""
    sizes = np.diff(offsets)
    alphabet, text = np.unique(symbols, return_inverse=True)
    text = text + 1
    # One copy of equal segments, with the least document that has it.
    key = np.zeros(len(sizes), np.uint64)
    place = np.arange(len(symbols)) - np.repeat(offsets[:-1], sizes)
    weight = np.random.default_rng(7).integers(1, 1 << 63, int(sizes.max()), dtype=np.uint64)
    np.add.at(key, np.repeat(np.arange(len(sizes)), sizes), (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * weight[place])
    key ^= sizes.astype(np.uint64) << np.uint64(56)
    _, one, same = np.unique(key, return_index=True, return_inverse=True)
    least = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(least, same, doc)
    length = sizes[one]
    places = np.concatenate([[0], np.cumsum(length + 1)])
    inside = np.repeat(offsets[:-1][one] - places[:-1], length + 1) + np.arange(places[-1])
    joined = np.zeros(places[-1], np.int64)
    is_word = np.ones(places[-1], bool)
    is_word[places[1:] - 1] = False
    joined[is_word] = text[inside[is_word]]
    owner = np.repeat(np.arange(len(one)), length + 1)
    index = FMIndex(joined, len(alphabet) + 1, window)
    # Matching statistics of the streamed segments, at the end of each window.
    windows = length - window + 1
    begin = np.concatenate([[0], np.cumsum(windows)])
    which = np.repeat(np.arange(len(one)), windows)
    ends = places[which] + np.arange(begin[-1]) - begin[which] + window
    several = _distinct_windows(joined, ends - window, window)
    length_of, low, high = index.statistics(joined, ends[several[0]], window)
    full = length_of >= window
    holder = least[owner[index.order]]
    found = np.full(len(several[0]), np.iinfo(np.int64).max)
    full = np.flatnonzero(full)
    full = full[np.argsort(low[full])]  # intervals of distinct windows don't overlap
    cuts = np.stack([low[full], high[full]], axis=1).ravel()
    if len(cuts):
        found[full] = np.minimum.reduceat(np.append(holder, np.iinfo(np.int64).max), cuts)[::2]
    of_window = found[several[1]]
    # Back to every streamed segment.
    count = sizes - window + 1
    segment = np.repeat(np.arange(len(sizes)), count)
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    gone = of_window[begin[same[segment]] + inner] < doc[segment]
    return segment[gone], inner[gone]


def _distinct_windows(text: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """One index into ``starts`` for each distinct window, and for each start which of these it equals."""
    _, one, same = np.unique(grams(text.astype(np.uint64), window)[starts], return_index=True, return_inverse=True)
    return one, same


def _search(window: int) -> Callable:
    def shard(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks()
        if not table.num_rows:
            return
        column = table.column("words").combine_chunks().cast(pa.large_binary())
        raw = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        symbols = np.frombuffer(column.buffers()[2], np.uint32)[raw[0] // 4 : raw[-1] // 4]
        doc, tag, start = (table.column(c).to_numpy() for c in ("doc", "tag", "start"))
        segment, inner = _removed(window, (raw - raw[0]) // 4, symbols, doc)
        if not len(segment):
            return
        order = np.lexsort((tag[segment], doc[segment]))
        segment, inner = segment[order], inner[order]
        places = (start[segment] + inner).astype(np.int32)
        d, t = doc[segment], tag[segment]
        edge = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])]))
        offsets = np.append(edge, len(places)).astype(np.int32) * 4
        binary = pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(offsets), pa.py_buffer(places)])
        yield pa.RecordBatch.from_arrays([pa.array(d[edge]), pa.array(t[edge]), binary], names=["doc", "tag", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows come ordered by minimizer: a shard ends between two of them once it is large enough."""
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            m = batch.column("m").to_numpy()
            lengths = np.asarray(pc.binary_length(batch.column("words")), np.int64) // 4
            cuts = [*(np.flatnonzero(m[1:] != m[:-1]) + 1), batch.num_rows]
            begin = 0
            if last is not None and m[0] != last and size >= SHARD_WORDS:
                yield from shard(held)
                held, size = [], 0
            done = np.concatenate([[0], np.cumsum(lengths)])
            for c in cuts:
                if size + done[c] - done[begin] >= SHARD_WORDS and c < batch.num_rows:
                    held.append(batch.slice(begin, c - begin))
                    yield from shard(held)
                    held, size, begin = [], 0, c
            held.append(batch.slice(begin))
            size += int(done[-1] - done[begin])
            last = m[-1]
        if held:
            yield from shard(held)

    return run


def repeated_places(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc, tag (crc32 of the text) and ``places``: binary int32 starts of windows that also start in a document with a smaller id."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull())
    pairs = rows.mapInArrow(_seeds(window, gram), "m long, doc long")
    shared = pairs.groupBy("m").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a < b").select("m")
    shared = kept(shared, "shared")
    if shared.count() <= Marks.ITEMS:
        marks = Marks(shared, "m")

        def known(m: np.ndarray, batch: pa.RecordBatch, row: np.ndarray) -> np.ndarray:
            return marks(m)
    else:
        mine = pairs.join(shared, "m", "left_semi").groupBy("doc").agg(F.collect_set("m").alias("known"))
        rows = rows.join(mine, rows.doc_id == mine.doc).select("doc_id", "text", "known")

        def known(m: np.ndarray, batch: pa.RecordBatch, row: np.ndarray) -> np.ndarray:
            column = batch.column("known")
            size = np.asarray(pc.list_value_length(column), np.int64)
            have = np.empty(int(size.sum()), [("r", np.int64), ("m", np.int64)])
            have["r"], have["m"] = np.repeat(np.arange(len(column)), size), column.flatten().to_numpy()
            want = np.empty(len(m), have.dtype)
            want["r"], want["m"] = row, m
            return np.isin(want, have)

    segments = rows.mapInArrow(_segments(window, gram, known), "m long, doc long, tag long, start int, words binary")
    dealt = segments.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "m").sortWithinPartitions("m")
    return dealt.mapInArrow(_search(window), "doc long, tag long, places binary")


def mark_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with ``__places``: list of binary int32 arrays of the starts of repeated windows (null: none).

    A null text has no words; a null doc_id is never smaller or larger than
    another, so its text stays whole. Rows that share a doc_id are one document
    for this purpose: neither is earlier than the other.
    """
    found = repeated_places(docs, window, gram).groupBy("doc", "tag").agg(F.collect_list("places").alias("__places")).withColumnsRenamed({"doc": "__doc", "tag": "__crc"})
    tagged = docs.withColumn("__tag", F.crc32(F.coalesce("text", F.lit(""))))
    return tagged.join(found, (F.col("doc_id") == F.col("__doc")) & (F.col("__tag") == F.col("__crc")), "left").drop("__doc", "__crc", "__tag")


def kept_words(text: bytes, places: list[bytes] | None, window: int) -> tuple[list[bytes], int]:
    """The words of a text outside all marked windows, and how many words it has."""
    own = text.split()
    if not places:
        return own, len(own)
    starts = np.concatenate([np.frombuffer(p, np.int32) for p in places])
    cover = np.zeros(len(own) + 1, np.int32)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    keep = np.cumsum(cover[:-1]) == 0
    return [own[i] for i in np.flatnonzero(keep)], len(own)


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) of each document."""
    marked = mark_repeats(docs.select("doc_id", "text"), window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            total, gone, sha = [], [], []
            for text, places in zip(texts(batch.column("text")).cast(pa.large_binary()).to_pylist(), batch.column("__places").to_pylist()):
                left, n = kept_words(text, places, window)
                total.append(n)
                gone.append(n - len(left))
                sha.append(hashlib.sha256(b" ".join(left)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return marked.mapInArrow(run, widened(marked.select("doc_id"), n_words="long", n_removed="long", kept_sha256="string"))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text``.

    A text without repeats stays byte for byte; from others the covered words go,
    and the kept words are joined by one space. A text left without words is empty.
    """
    marked = mark_repeats(docs, window)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for text, places in zip(batch.column("text").to_pylist(), batch.column("__places").to_pylist()):
                out.append(b" ".join(kept_words(text.encode(), places, window)[0]).decode() if places and text else text)
            cols = [pa.array(out, batch.column("text").type) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return marked.mapInArrow(run, docs.schema)
