"""Toxicity by a weighted lexicon: Aho-Corasick over folded text, normalised by length, with exception phrases.

Folding lower-cases, maps homoglyphs (Cyrillic, Greek, full width) and digit or
sign substitutions to one letter, drops invisible characters and accents and turns
punctuation into spaces. ``l`` and ``1`` and ``i`` fold to one letter, in texts
and lexicon alike. An entry is the beginning of a word (or a whole one); it is
learned, with its weight, from how much more often labelled toxic texts use it.
A phrase around an entry that only clean texts use is an exception: a match
inside it doesn't count.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewatch.llm.common import slices, texts, widened

#: Labelled rows that the lexicon, its exceptions and the curve are fitted to (in expectation); so many texts bound them.
SAMPLE = 20_000
#: An entry has so many characters at least, occurs in so many toxic texts, and so much more often there than in clean ones.
SHORTEST, LONGEST, DOCS, RATIO = 4, 10, 6, 8.0
#: An exception occurs in so many clean texts, and in no toxic one.
EXCEPTION = 3
THRESHOLD = 0.7
#: Characters that look like a Latin letter, and the letter.
HOMOGLYPHS = {
    "аɑα": "a", "ьъв": "b", "сϲ": "c", "ԁ": "d", "еєε": "e", "ɡ": "g", "һн": "h", "іїιı": "i", "ј": "j", "кκ": "k", "мμ": "m", "пηո": "n", "оοσօ": "o",
    "рρ": "p", "ѕ": "s", "тτ": "t", "υս": "u", "ѵν": "v", "ԝω": "w", "хχ": "x", "уγү": "y",
}
SUBSTITUTES = {"0": "o", "1": "i", "l": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


def _folds() -> dict[int, str | None]:
    table: dict[int, str | None] = {}
    for code in range(0x3100):
        kind = unicodedata.category(chr(code))
        if kind[0] in "PZ" or kind == "Cc" or kind[0] == "S":
            table[code] = " "
        elif kind == "Cf" or 0x300 <= code < 0x370:  # invisible, and accents
            table[code] = None
    for code in range(0xFF01, 0xFF5F):  # full width
        plain = chr(code - 0xFEE0).lower()
        table[code] = SUBSTITUTES.get(plain, plain if plain.isalnum() else " ")
    for signs, letter in HOMOGLYPHS.items():
        for sign in signs:
            table[ord(sign)] = SUBSTITUTES.get(letter, letter)
    return table | {ord(k): v for k, v in SUBSTITUTES.items()}


_TABLE = _folds()
#: For ASCII texts, bytes are enough.
_ASCII = bytes(ord(_TABLE.get(i, chr(i)) or " ") for i in range(128)) + bytes(range(128, 256))


def fold(text: str) -> str:
    """The folded text with a space before each word and one at the end."""
    text = text.lower()
    text = text.encode().translate(_ASCII).decode() if text.isascii() else unicodedata.normalize("NFKD", text).translate(_TABLE)
    return f" {text} "


@dataclass
class Lexicon:
    """``entries``: folded beginning of a word, with a space before -> weight. ``exceptions``: folded phrases."""

    entries: dict[str, float]
    exceptions: frozenset[str]
    curve: tuple[float, ...] = (-4.0, 0.0, 0.0, 0.0)  # bias, and weights of what ``measure`` gives

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for entry, weight in self.entries.items():
            found.add_word(entry, (len(entry), weight))
        if self.entries:
            found.make_automaton()
        return found


def phrases(folded: str, start: int) -> tuple[str, ...]:
    """The word at ``start`` (of the space before it), and with the word before and after it."""
    end = folded.find(" ", start + 1)
    word = folded[start + 1 : end]
    low, high = start, end
    while low > 0 and folded[low - 1] == " ":
        low -= 1
    while high < len(folded) and folded[high] == " ":
        high += 1
    before = folded[folded.rfind(" ", 0, low) + 1 : low] if low else ""
    after = folded[high : folded.find(" ", high)] if high < len(folded) else ""
    return (word, f"{before} {word}" if before else "", f"{word} {after}" if after else "")


def matches(folded: str, automaton: ahocorasick.Automaton) -> dict[int, float]:
    """Place of each word that begins with an entry -> weight of its longest entry."""
    best: dict[int, tuple[int, float]] = {}
    if len(automaton):
        for end, (size, weight) in automaton.iter(folded):
            start = end - size + 1
            if size > best.get(start, (0, 0))[0]:
                best[start] = (size, weight)
    return {start: weight for start, (_, weight) in best.items()}


def measure(text: str, automaton: ahocorasick.Automaton, exceptions: frozenset[str]) -> tuple[float, float, float]:
    """Of the matches outside exceptions: logarithms of one plus their weight per hundred words (ten added, so that one match in a very short text is no proof) and of one plus their weight, and the greatest weight."""
    folded = fold(text)
    found = [w for start, w in matches(folded, automaton).items() if not exceptions or exceptions.isdisjoint(phrases(folded, start))]
    weight = sum(found)
    return float(np.log1p(100 * weight / (len(folded.split()) + 10))) if found else 0.0, float(np.log1p(weight)), max(found, default=0.0)


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """A lexicon from (text, toxic) rows; rows whose label is null are left out. ``sample`` rows at most, in expectation."""
    rows = labelled.filter(F.col("toxic").isNotNull()).select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(entry, occurrences in toxic and clean texts, toxic texts with it); the entry '' counts words."""
        bad, good, docs = Counter(), Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                own: Counter[str] = Counter()
                for word, n in Counter(fold(text).split()).items():
                    own[""] += n
                    for size in range(SHORTEST, min(LONGEST, len(word)) + 1):
                        own[word[:size]] += n
                (bad if toxic else good).update(own)
                if toxic:
                    docs.update(own.keys())
        names = list(bad.keys() | good.keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[k] for k in names], pa.int64()) for c in (bad, good, docs))], names=["entry", "bad", "good", "docs"])

    counts = rows.mapInArrow(count, "entry string, bad long, good long, docs long").groupBy("entry").agg(*(F.sum(c).alias(c) for c in ("bad", "good", "docs")))
    total = F.broadcast(counts.filter("entry = ''").select(F.col("bad").alias("all_bad"), F.col("good").alias("all_good")))
    ratio = ((F.col("bad") + 0.5) / (F.col("all_bad") + 1)) / ((F.col("good") + 0.5) / (F.col("all_good") + 1))
    best = counts.filter(f"entry != '' and docs >= {DOCS}").join(total).withColumn("ratio", ratio).filter(F.col("ratio") >= RATIO).collect()
    entries: dict[str, float] = {}
    kept: dict[str, tuple[float, int]] = {}
    for r in sorted(best, key=lambda r: (len(r.entry), r.entry)):
        parents = [kept[r.entry[:n]] for n in range(SHORTEST, len(r.entry)) if r.entry[:n] in kept]
        if parents and not (r.ratio > 2 * parents[-1][0] and r.bad > 0.3 * parents[-1][1]):
            continue
        kept[r.entry] = (r.ratio, r.bad)
        entries[f" {r.entry}"] = float(np.log(min(r.ratio, 200.0)))
    lexicon = Lexicon(entries, frozenset())

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            found: list[tuple[str, int]] = []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                folded = fold(text)
                found += {(p, toxic) for start in matches(folded, automaton) for p in phrases(folded, start) if p}
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([t for _, t in found], pa.int32())], names=["phrase", "toxic"])

    seen = rows.mapInArrow(around, "phrase string, toxic int").groupBy("phrase").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    exceptions = frozenset(r.phrase for r in seen.filter(f"bad = 0 and n >= {EXCEPTION}").collect())
    lexicon.exceptions = exceptions

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            got = np.array([measure(t, automaton, exceptions) for t in batch.column("text").to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array(c) for c in got.T)], names=["toxic", "a", "b", "c"])

    got = rows.mapInArrow(features, "toxic int, a double, b double, c double").toArrow()
    lexicon.curve = _logistic(np.stack([got.column(c).to_numpy() for c in "abc"], axis=1), got.column("toxic").to_numpy().astype(float))
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Bias and weights by Newton steps, with a little ridge."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        w += np.linalg.solve(h, x.T @ (y - p) - 0.1 * w)
    return tuple(float(v) for v in w)


def score(df: DataFrame, lexicon: Lexicon, keys: list[str] | None = None, out: str = "score") -> DataFrame:
    """``keys`` (by default all columns) of every row and the score (0 to 1) of its whole text as ``out``, in place of a column of that name; a null text scores as an empty one."""
    keys = [c for c in (keys if keys is not None else df.columns) if c != out]
    rows = df.select(*dict.fromkeys([*keys, "text"]))
    schema = widened(df.select(*keys), **{out: "double"})
    sent = df.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = sent.value
        automaton = lexicon.automaton()
        for batch in slices(batches, "text"):
            x = np.array([measure(t, automaton, lexicon.exceptions) for t in texts(batch.column("text")).to_pylist()]).reshape(-1, 3)
            z = lexicon.curve[0] + x @ np.array(lexicon.curve[1:])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=schema.names)

    return rows.mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(text, toxic) of about ``size`` labelled documents at most, chosen by a hash of doc_id; that many ids are broadcast."""
    known = labels.filter(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) * F.lit(n) < F.lit(size << 20))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
