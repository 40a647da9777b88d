"""Language identification by segmentation-marginalised unigrams.

The vocabulary is that of a public byte-level tokenizer, read from a file and
never trained. Each language has a probability for every piece, learned by
expectation-maximisation from word counts of a bounded sample. A word's
probability under a language is the sum over all its segmentations into pieces
(forward algorithm, in numpy over all distinct words of a slice at once); a text's
is the product over its words. Words are lower-cased in A-Z and keep a leading
space. A word may be any length: long ones are worked on in parts between places
that no piece of the vocabulary crosses, where the sum is a product of exact parts.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewatch.llm.common import slices, texts, widened
from framewatch.llm.words import LOWER, Words, mix, words

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Words of more bytes are looked through for places that no piece crosses.
LONG = 32
#: Sums are multiplied by this for each byte, and taken apart into a factor every so many bytes, to stay within a float.
BOOST, RESCALE = 8.0, 128
#: Sums (for one language) that a task holds at a time.
CELLS = 1 << 19
#: Rows of each language in the sample that the piece probabilities are fitted to (in expectation).
SAMPLE = 1500
ROUNDS = 3
SMOOTHING = 0.02
#: Distinct words that a task keeps scores of before it starts anew.
CACHE = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)


def pieces(path: str) -> list[bytes]:
    """The pieces of a vocabulary file, one in base64 at the head of each line; bytes that it lacks are added."""
    with open(path, "rb") as file:
        found = [base64.b64decode(line.split()[0]) for line in file if line.strip()]
    have = set(found)
    return found + [bytes([i]) for i in range(256) if bytes([i]) not in have]


class Vocabulary:
    """Pieces by a hash of their bytes, in a table that answers for whole arrays. It is read on the driver and sent to the tasks."""

    def __init__(self, path: str):
        found = pieces(path)
        self.size = len(found)
        self.length = np.array([len(p) for p in found])
        self.hashes = np.zeros(self.size + 1, np.uint64)
        for i, p in enumerate(found):
            h = 0
            for b in p:
                h = (h * int(_BASE) + b + 1) & 0xFFFFFFFFFFFFFFFF
            self.hashes[i] = h
        self.shift = np.uint64(64 - 21)
        self._build()

    def _build(self) -> None:
        self.tables, rest = [], np.arange(self.size)
        while len(rest):  # what collides goes to a further table
            table = np.full(1 << 21, self.size, np.int32)
            slot = mix(self.hashes[rest]) >> self.shift
            table[slot[::-1]] = rest[::-1]
            self.tables.append(table)
            rest = rest[table[slot] != rest]

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "tables"}

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state)
        self._build()

    def find(self, hashes: np.ndarray) -> np.ndarray:
        slot = mix(hashes) >> self.shift
        out = np.full(len(hashes), self.size, np.int32)
        for table in self.tables:
            got = table[slot]
            out = np.where((self.hashes[got] == hashes) & (got < self.size), got, out)
        return out

    def boosted(self, p: np.ndarray) -> np.ndarray:
        """``p`` times BOOST for each byte of the piece; its last row (no piece) stays 0."""
        return p * (BOOST ** np.append(self.length, 0))[:, None]


class Lattice:
    """Parts of words, longest first, with the piece (or none) of every length at every place."""

    def __init__(self, vocabulary: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.vocabulary = vocabulary
        self.words = len(starts)
        size = ends - starts + 1  # with the space before the word
        begin = np.cumsum(size) - size
        total = int(size.sum())
        place = np.arange(total) - np.repeat(begin, size)
        flat = LOWER[data[np.maximum(np.repeat(starts, size) + place - 1, 0)]] if len(data) else np.zeros(total, np.uint8)
        flat[place == 0] = 32
        flat = flat.astype(np.uint64) + np.uint64(1)
        room = np.repeat(size, size) - place
        #: Length of pieces -> the piece of that length at every place.
        self.ids: dict[int, np.ndarray] = {}
        live, h = np.arange(total), np.zeros(total, np.uint64)
        crossed = np.zeros(total + 1, np.int64)
        for n in range(1, int(vocabulary.length.max()) + 1):
            inside = room[live] >= n
            live, h = live[inside], h[inside] * _BASE + flat[live[inside] + n - 1]
            if not len(live):
                break
            found = vocabulary.find(h)
            hit = found < vocabulary.size
            if hit.any():
                self.ids[n] = np.full(total, vocabulary.size, np.int32)
                self.ids[n][live] = found
                np.add.at(crossed, live[hit] + 1, 1)
                np.add.at(crossed, live[hit] + n, -1)
        # A long word may be cut wherever no piece goes on.
        first = (place == 0) | (np.cumsum(crossed)[:total] == 0) & (np.repeat(size, size) > LONG)
        self.at = np.flatnonzero(first)
        self.length = np.diff(np.append(self.at, total))
        self.word = np.repeat(np.arange(self.words), size)[self.at]
        order = np.argsort(-self.length, kind="stable")
        self.at, self.length, self.word = self.at[order], self.length[order], self.word[order]

    def groups(self) -> Iterator[slice]:
        """The parts in groups of bounded size."""
        low = 0
        while low < len(self.length):
            count = max(1, CELLS // (int(self.length[low]) + 1))
            yield slice(low, low + count)
            low += count

    def forward(self, group: slice, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums over segmentations up to each place: part x place x language; and, after each number of rescalings, the logarithm of what was taken out of those of each part. ``p``: boosted, piece x language.

        The rescaling at place e takes the same factor out of all places from e - reach on, reach being the longest piece; earlier ones are not used again.
        """
        at, length = self.at[group], self.length[group]
        longest = int(length[0])
        active = np.searchsorted(-length, -np.arange(longest + 1), side="right")
        reach = max(self.ids)
        out, taken = np.zeros((len(at), longest + 1, p.shape[1])), np.zeros((longest // RESCALE + 1, len(at), p.shape[1]))
        out[:, 0] = 1
        for e in range(1, longest + 1):
            k = active[e]
            for n, ids in self.ids.items():
                if n <= e:
                    out[:k, e] += out[:k, e - n] * p[ids[at[:k] + e - n]]
            if e % RESCALE == 0:
                low = max(0, e - reach)
                top = out[:k, low : e + 1].max(axis=1)
                out[:k, low : e + 1] /= top[:, None]
                taken[e // RESCALE :, :k] += np.log(top)
        return out, taken

    def totals(self, p: np.ndarray) -> np.ndarray:
        """log probability of each word under each language. ``p``: piece x language, its last row 0."""
        p = self.vocabulary.boosted(p)
        out = np.zeros((self.words, p.shape[1]))
        for group in self.groups():
            sums, taken = self.forward(group, p)
            length = self.length[group]
            np.add.at(out, self.word[group], np.log(np.maximum(sums[np.arange(len(length)), length], 1e-300)) + taken[-1] - length[:, None] * np.log(BOOST))
        return out

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected count of every piece under one language (``p``: piece x 1), words weighted. Sums from the end are kept in the scale of those from the start, so that parts may be of any length."""
        p = self.vocabulary.boosted(p)
        out = np.zeros(len(p))
        reach = max(self.ids, default=0)
        for group in self.groups():
            at, length = self.at[group], self.length[group]
            a, taken = (x[:, :, 0] for x in self.forward(group, p))
            k = np.arange(len(length))
            b = np.zeros_like(a)
            b[k, length] = weight[self.word[group]] / np.maximum(a[k, length], 1e-300)
            active = np.searchsorted(-length, -np.arange(length[0] + 1), side="right")
            scale = lambda e: min((e + reach) // RESCALE, len(taken) - 1)
            for e in range(int(length[0]), 0, -1):
                live = active[e]
                for n, piece in self.ids.items():
                    if n <= e:
                        ids = piece[at[:live] + e - n]
                        step = p[ids, 0] * b[:live, e]
                        if scale(e) != scale(e - n):
                            step = step * np.exp(taken[scale(e - n), :live] - taken[scale(e), :live])
                        b[:live, e - n] += step
                        out += np.bincount(ids, a[:live, e - n] * step, len(p))
        return out


def _distinct(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.unique(w.hashes, return_index=True, return_inverse=True)


def fit_pieces(column: pa.LargeStringArray, vocabulary: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language from its texts."""
    w = words(column, lower=True)
    hashes, one, same = _distinct(w)
    p = np.full((vocabulary.size + 1, 1), 1.0)
    p[-1] = 0
    if len(hashes):
        weight = np.bincount(same).astype(float)
        lattice = Lattice(vocabulary, w.data, w.starts[one], w.ends[one])
        count = np.full(vocabulary.size + 1, 0.01)
        live = np.repeat(weight, w.ends[one] - w.starts[one] + 1)
        for ids in lattice.ids.values():  # to begin with: how often the piece occurs at all
            count += np.bincount(ids, live, vocabulary.size + 1)
        for _ in range(rounds):
            count[-1] = 0
            p = ((count + SMOOTHING) / (count + SMOOTHING).sum())[:, None]
            p[-1] = 0
            count = lattice.expected(p, weight)
    else:
        count = np.zeros(vocabulary.size + 1)
    count = count[:-1] + SMOOTHING
    return np.append(count / count.sum(), 0.0)


def fit(labelled: DataFrame, vocabulary: str = VOCABULARY, sample: int = SAMPLE, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages, and piece x language probabilities, from (lang, text, doc_id); rows with a null lang are left out.

    Fitted on about ``sample`` rows of each language, chosen by a hash of doc_id and lang;
    repeated rows count as often as they occur. No row at all gives no language.
    """
    known_pieces = labelled.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))
    known = labelled.filter(F.col("lang").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "lang").alias("_h"))
    counts = known.groupBy("lang").agg(F.count("*").alias("_n"))
    chosen = known.join(F.broadcast(counts), "lang").filter((F.pmod("_h", F.lit(1 << 20)) * F.col("_n")) < F.lit(sample << 20)).select("lang", "text")

    def learn(table: pa.Table) -> pa.Table:
        p = fit_pieces(texts(table.column("text")), known_pieces.value, rounds)
        return pa.table({"lang": table.column("lang").slice(0, 1), "p": pa.array([p.tobytes()], pa.binary())})

    got = sorted((r.lang, r.p) for r in chosen.groupBy("lang").applyInArrow(learn, "lang string, p binary").collect())
    if not got:
        return [], np.zeros((0, 0))
    return [lang for lang, _ in got], np.stack([np.frombuffer(p) for _, p in got], axis=1)


class Scorer:
    def __init__(self, vocabulary: Vocabulary, p: np.ndarray):
        self.vocabulary, self.p = vocabulary, p
        self.known, self.scores = np.zeros(0, np.uint64), np.zeros((0, p.shape[1]), np.float32)

    def texts(self, column: pa.LargeStringArray) -> np.ndarray:
        """log probability of each text under each language."""
        w = words(column, lower=True)
        hashes, one, same = _distinct(w)
        at = np.searchsorted(self.known, hashes)
        missing = np.flatnonzero(np.append(self.known, 0)[at] != hashes if len(self.known) else np.ones(len(hashes), bool))
        if len(missing):
            if len(self.known) > CACHE:
                self.known, self.scores, missing = self.known[:0], self.scores[:0], np.arange(len(hashes))
            lattice = Lattice(self.vocabulary, w.data, w.starts[one[missing]], w.ends[one[missing]])
            known = np.concatenate([self.known, hashes[missing]])
            scores = np.concatenate([self.scores, lattice.totals(self.p).astype(np.float32)])
            order = np.argsort(known, kind="stable")
            self.known, self.scores = known[order], scores[order]
            at = np.searchsorted(self.known, hashes)
        of_word = self.scores[at][same].astype(np.float64)
        total = np.concatenate([np.zeros((1, self.p.shape[1])), np.cumsum(of_word, axis=0)])
        return total[w.offsets[1:]] - total[w.offsets[:-1]]


def predict(df: DataFrame, langs: list[str], p: np.ndarray, vocabulary: str = VOCABULARY, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys``, lang_pred and score (its posterior, languages equally likely beforehand) of every whole text.

    A text that is null or has no letter, or any text if no language was learned, gives ``und`` and 0.
    Every row has a result, repeated ones the same; ties go to the language that is first by name.
    """
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast((Vocabulary(vocabulary) if langs else None, p))
    rows = df.select(*keys, "text")
    schema = widened(rows.drop("text"), lang_pred="string", score="double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value) if langs else None
        for batch in slices(batches, "text"):
            column = texts(batch.column("text"))
            letter = np.array([any(map(str.isalpha, t)) for t in column.to_pylist()], bool)
            if scorer is None:
                lang, score = ["und"] * len(column), np.zeros(len(column))
            else:
                log = scorer.texts(column)
                best = log.argmax(axis=1)
                score = np.where(letter, 1 / np.exp(log - log.max(axis=1, keepdims=True)).sum(axis=1), 0.0)
                lang = [langs[b] if ok else "und" for b, ok in zip(best, letter)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return rows.mapInArrow(run, schema)
