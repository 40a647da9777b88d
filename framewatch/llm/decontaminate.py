"""Benchmark passages inside documents, within an edit distance in words.

CGK's random walk embeds a sequence of words so that few edits become few
differing places. Each repetition has a walk of its own and compares BITS sampled
places of it (bit-sampling LSH): the items' sampled places are hash tables, one for
each length, and the windows of that length in a document, one at every word, are
looked up in them. The repetitions are as many as the target recall asks for at the
edits allowed. Pairs that meet are verified by the exact edit distance. Windows that
cannot match any item are not looked up: with at most k edits, n words keep a run of
(n - k) / (k + 1) words, and all but k * q of their grams of q words.

An embedding goes on past the end of its window, and only places are sampled that
an item's walk reaches inside the item; so one walk from a word serves the windows
of all lengths that begin there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from framewatch.llm.common import slices, texts
from framewatch.llm.words import grams, mix, words

#: Edits allowed as a share of the item's words.
EDITS = 0.2
GRAM = 3
#: Sampled places of the embedding in one repetition, and the recall to reach for items at the full distance.
BITS, RECALL = 2, 0.999
#: Places are sampled below this share of an item's words; a walk takes a word in two places on average.
REACH = 1.6
#: Walks (repetitions of windows) that a task holds at a time, some 50 bytes each.
WALKS = 1 << 17
#: Characters of benchmark text that are sent to the tasks at a time; a task holds some 40 bytes for each.
BROADCAST_CHARS = 4 << 20
_BITMAP = 1 << 22


def agreement(edits: int) -> float:
    """The chance that one repetition agrees for texts ``edits`` edits apart, a power law fitted to random edits; tests/llm holds that pairs agree as often, to four fifths of it."""
    return 1.0 if edits == 0 else 0.34 * edits**-0.46


def repetitions(edits: int, recall: float = RECALL) -> int:
    return 1 if edits == 0 else math.ceil(math.log(1 - recall) / math.log(1 - agreement(edits)))


def sampled(size: int, repetition: int, bits: int = BITS) -> np.ndarray:
    """The places that a repetition compares of items of ``size`` words."""
    reach = max(1, int(size * REACH))
    return np.sort(np.random.default_rng([size, repetition]).choice(reach, min(bits, reach), replace=False))


def walked_keys(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, places: np.ndarray) -> np.ndarray:
    """repetition x start: a hash of the repetition and of the symbols that the CGK walk of symbols[start:end] (0 past the end) has at its sampled ``places`` (repetition x place, ascending).

    The walk of a repetition goes on at a place if an odd number of its own, times the
    symbol there, has its top bit set. Only the walks' positions and hashes are held.
    """
    r = np.arange(len(places), dtype=np.uint64)
    at = np.tile(starts, (len(places), 1))
    key = np.tile(r[:, None], (1, len(starts)))
    for place in range(int(places.max(initial=-1)) + 1):
        inside = at < ends
        s = np.where(inside, symbols[np.minimum(at, len(symbols) - 1)], np.uint64(0))
        asked = (places == place).any(axis=1)
        key[asked] = mix(key[asked] * np.uint64(0x9E3779B97F4A7C15) + s[asked])
        odd = mix(r + np.uint64(place << 32)) | np.uint64(1)
        at += ((s * odd[:, None]) >> np.uint64(63)).astype(np.int64)
    return key


@dataclass
class Length:
    """The hash tables of the items of one length; a key has its repetition in it."""

    size: int
    edits: int
    gram: int
    need: int  # grams of the item that are left by so many edits
    places: np.ndarray  # repetition x sampled place
    keys: np.ndarray  # sorted
    items: np.ndarray
    bitmap: np.ndarray


@dataclass
class Items:
    ids: pa.Array  # distinct ones
    id_of: np.ndarray  # the id of each item
    symbols: np.ndarray  # all items' words, one after the other
    offsets: np.ndarray
    edits: np.ndarray
    grams: dict[int, tuple[np.ndarray, ...]]  # size -> sorted grams, a bitmap of them, where the lengths that have each begin, these lengths
    lengths: list[Length]

    @classmethod
    def of(cls, ids: pa.Array, column: pa.LargeStringArray, edits: float = EDITS, bits: int = BITS, recall: float = RECALL) -> Items:
        w = words(column, lower=True)
        size = np.diff(w.offsets)
        keep = np.flatnonzero(size)
        size = size[keep]
        coded = pc.dictionary_encode(ids.take(pa.array(keep)), null_encoding="encode")
        offsets = np.concatenate([[0], np.cumsum(size)])
        allowed = np.floor(size * edits + 1e-9).astype(np.int64)
        lengths, values = [], {}
        for n in np.unique(size).tolist():
            which = np.flatnonzero(size == n)
            k = int(allowed[which[0]])
            gram = min(n, GRAM) if k == 0 else min(GRAM, n, max(1, -(-(n - k) // (k + 1))))
            place = (offsets[which][:, None] + np.arange(n - gram + 1)).ravel()
            own = np.unique(grams(w.hashes, gram)[place])
            values.setdefault(gram, []).append((own, np.full(len(own), len(lengths))))
            reps = repetitions(k, recall)
            places = np.stack([sampled(n, r, bits) for r in range(reps)])
            keys = walked_keys(w.hashes, offsets[which], offsets[which + 1], places)
            order = np.argsort(keys.ravel(), kind="stable")
            keys = keys.ravel()[order]
            lengths.append(Length(n, k, gram, max(1, n - gram + 1 - k * gram), places, keys, np.tile(which, reps)[order], _bitmap(keys)))
        found = {}
        for g, parts in values.items():
            own, of = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(own, kind="stable")
            value, first = np.unique(own[order], return_index=True)
            found[g] = (value, _bitmap(value), np.append(first, len(own)), of[order])
        return cls(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), w.hashes, offsets, allowed, found, lengths)


def _bitmap(keys: np.ndarray) -> np.ndarray:
    table = np.zeros(max(1 << 10, min(_BITMAP, 1 << (16 * len(keys)).bit_length())), bool)
    table[keys & np.uint64(len(table) - 1)] = True
    return table


def _known(keys: np.ndarray, values: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Where ``keys`` has one of the sorted ``values``."""
    at = np.flatnonzero(bitmap[keys & np.uint64(len(bitmap) - 1)])
    return at[values[np.minimum(np.searchsorted(values, keys[at]), len(values) - 1)] == keys[at]]


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance between ``item`` and any stretch of ``text``, and where the first such stretch ends."""
    row = np.zeros(len(text) + 1, np.int64)
    place = np.arange(len(text) + 1)
    for i, s in enumerate(item, 1):
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (text != s))
        new[0] = i
        row = np.minimum.accumulate(new - place) + place
    end = int(row.argmin())
    return int(row[end]), end


def windows(length: Length, hits: np.ndarray, row: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where windows begin that hold enough of ``hits`` (ascending places of grams of items of this length) for a match."""
    reach = length.size + length.edits - length.gram
    one, last = hits[: max(0, len(hits) - length.need + 1)], hits[length.need - 1 :]
    ok = (last - one <= reach) & (row[one] == row[last])
    one, last = one[ok], last[ok]
    low = np.maximum(last - reach, first[row[one]])
    count = one - low + 1
    return np.unique(np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))


def candidates(items: Items, symbols: np.ndarray, row: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, item) of the item-sized windows that agree with an item in some repetition."""
    able = [np.zeros(0, np.int64)] * len(items.lengths)
    for g, (values, bitmap, cuts, which) in items.grams.items():
        own = grams(symbols, g)
        at = _known(own, values, bitmap)
        at = at[row[at] == row[at + g - 1]]
        gram = np.searchsorted(values, own[at])
        count = cuts[gram + 1] - cuts[gram]
        of = which[np.repeat(cuts[gram], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        place = np.repeat(at, count)
        order = np.argsort(of, kind="stable")
        edges = np.searchsorted(of[order], np.arange(len(items.lengths) + 1))
        for i in np.flatnonzero(np.diff(edges)).tolist():
            able[i] = windows(items.lengths[i], place[order[edges[i] : edges[i + 1]]], row, offsets[:-1])
    found = [np.zeros((2, 0), np.int64)]
    for length, starts in zip(items.lengths, able):
        step = max(1, WALKS // len(length.places))
        for low in range(0, len(starts), step):
            chunk = starts[low : low + step]
            keys = walked_keys(symbols, chunk, offsets[1:][row[chunk]], length.places).ravel()
            at = _known(keys, length.keys, length.bitmap)
            first, last = (np.searchsorted(length.keys, keys[at], side) for side in ("left", "right"))
            count = last - first
            which = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            found.append(np.unique(np.stack([np.repeat(chunk[at % len(chunk)], count), length.items[which]]), axis=1))
    start, item = np.concatenate(found, axis=1)
    return start, item


def find(items: Items, column: pa.LargeStringArray) -> list[tuple[int, int, int, int, int]]:
    """(row, id, edits, first word, past last word) of the best match of each id in each text, where there is one."""
    w = words(column, lower=True)
    if not len(w.hashes) or not len(items.id_of):
        return []
    row = w.row_of_word()
    start, item = candidates(items, w.hashes, row, w.offsets)
    order = np.lexsort((start, item, row[start]))
    start, item = start[order], item[order]
    own = row[start]
    # Windows of one match begin within k words of each other: these are verified at once.
    new = np.ones(len(start), bool)
    new[1:] = (own[1:] != own[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > items.edits[item[1:]])
    edge = np.append(np.flatnonzero(new), len(start))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        r, it = int(own[a]), int(item[a])
        k, key = int(items.edits[it]), (r, int(items.id_of[it]))
        symbols = items.symbols[items.offsets[it] : items.offsets[it + 1]]
        first = int(w.offsets[r])
        low, high = max(first, int(start[a]) - k), min(int(w.offsets[r + 1]), int(start[b - 1]) + len(symbols) + k)
        edits, end = best_match(symbols, w.hashes[low:high])
        if edits <= k:
            length = best_match(symbols[::-1], w.hashes[low : low + end][::-1])[1] if edits else len(symbols)
            best[key] = min(best.get(key, (edits + 1, 0, 0)), (edits, low + end - length - first, low + end - first))
    return [(*key, *v) for key, v in sorted(best.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """doc_id, item_id, edits, first_word, past_word for each document and item that meet within ``edits`` times the item's words.

    The item's best place in the document is given (fewest edits, then the first).
    Words are compared as they stand, but for the case of A-Z. Items without words
    (or null) are never found; of items with one id (null is one, too) the best
    is given. Every row of a repeated doc_id has rows of its own. A match longer
    than its item by insertions is found from where it begins. The benchmark is sent to the tasks in parts of about
    BROADCAST_CHARS, whole ids each; so a single id's texts must fit a task's memory, nothing else need.
    """
    rows = docs.select("doc_id", "text")
    asked = benchmark.select("item_id", "text")
    size = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-size // BROADCAST_CHARS) or 1
    schema = StructType([docs.schema["doc_id"], benchmark.schema["item_id"]]).add("edits", "integer").add("first_word", "integer").add("past_word", "integer")
    out = None
    for part in range(parts):
        got = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).toArrow()
        items = Items.of(got.column("item_id").combine_chunks(), texts(got.column("text")), edits)
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                cols = np.array(find(sent.value, texts(batch.column("text"))), np.int64).reshape(-1, 5).T
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(cols[0])), sent.value.ids.take(pa.array(cols[1])), *(pa.array(c.astype(np.int32)) for c in cols[2:])],
                    names=schema.names,
                )

        one = rows.mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return out
