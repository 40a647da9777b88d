"""Suffix dedup against all windows by brute force, and its sort and windows against plain ones."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from framewatch.llm import suffix_dedup as sd


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + (len(b) > 0 and gone[0]))
        out.append((int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone[: len(b)]])))
    return out


def compare(spark, texts, length, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    got = {r.doc_id: (sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in sd.cut(df, length=length, **how).collect()}
    want = brute(texts, length)
    assert [got[i] for i in range(len(texts))] == want
    return want


def passages(rng, n, alphabet, size):
    common = ["".join(rng.choices(alphabet, k=size)) for _ in range(6)]
    texts = []
    for _ in range(n):
        t = "".join(rng.choices(alphabet, k=rng.randrange(0, size * 2)))
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(common)
            a = rng.randrange(0, size // 2)
            p = list(p[a : a + rng.randrange(5, size)])
            for _ in range(rng.randrange(0, 3)):
                p[rng.randrange(len(p))] = rng.choice(alphabet)
            t += "".join(p) + "".join(rng.choices(alphabet, k=rng.randrange(0, 30)))
        texts.append(t)
    return texts


@pytest.mark.parametrize("length,alphabet,how", [(40, "abcdefgh é", {}), (40, "abcdefgh", {"piece_size": 64}), (9, "ab", {}), (100, "xyz ", {})])
def test_against_all_windows(spark, length, alphabet, how):
    rng = random.Random(length)
    texts = passages(rng, 60, alphabet, length * 3)
    texts += [None, "", "a" * (length - 1), "b" * length, texts[0], texts[0], texts[1][5:], "ab" * length, "line of text\n" * 20, "x" + "line of text\n" * 9]
    want = compare(spark, texts, length, **how)
    assert sum(w[0] for w in want) and (len(alphabet) < 3 or any(w[1] > 1 for w in want))


def test_whole_length(spark):
    rng = random.Random(8)
    word = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    shared, near = word(120), word(400)
    texts = [word(30) + shared[:401] + word(30), shared[1:402], shared[2:402], word(300), near, near[:900] + "!" + near[900:], "漢字" * 300, word(20) + "漢字" * 70]
    compare(spark, texts, sd.LENGTH)


def test_within_one_text(spark):
    compare(spark, ["abcdefghij" * 3 + "Z" + "abcdefghij" * 3], 20)
    compare(spark, ["a" * 50, "a" * 10], 12)
    compare(spark, [], 12)


def test_other_columns(spark):
    df = spark.createDataFrame([(1, "x" * 30, "k", 5), (None, "x" * 30, None, 6), (2, None, "q", 7)], "doc_id int, text string, key string, spans int")
    out = sd.cut(df, length=10)
    assert sorted(out.columns) == ["doc_id", "kept", "key", "spans", "text"]
    assert sorted((r.doc_id or 0, r.key or "", len(r.kept), len(r.spans)) for r in out.collect()) == [(0, "", 0, 1), (1, "k", 0, 1), (2, "q", 0, 0)]


def test_multikey_order():
    rng = np.random.default_rng(2)
    tokens = [rng.integers(-3, 3, 30000), rng.integers(-1 << 62, 1 << 62, 30000) // (1 << 59), rng.integers(0, 2, 30000)]
    order = sd.multikey_order(tokens)
    assert sorted(order) == list(range(30000))
    assert [tuple(t[i] for t in tokens) for i in order] == sorted(zip(*tokens))


def test_least():
    rng = np.random.default_rng(4)
    for n, w in ((1, 1), (10, 3), (50, 7), (64, 64)):
        v = rng.integers(0, 100, n).astype(np.uint64)
        assert sd.least(v, w).tolist() == [v[i : i + w].min() for i in range(n - w + 1)]


def test_tables_are_removed_when_read(spark):
    from framewatch.llm.common import kept, released

    a, b = kept(spark.range(5), "one"), kept(spark.range(3), "two")
    files = a.inputFiles()
    released(a)
    assert spark.read.parquet(b.inputFiles()[0]).count() >= 0 and b.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FileNotFound"):
        spark.read.parquet(*files).count()
