"""Whitening against numpy on all rows at once, and refinement against matrices whose eigenvectors are known."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewatch.llm import whitening
from framewatch.llm.common import added_up
from framewatch.llm.queries import QUERIES

INF, NAN = float("inf"), float("nan")


def orthogonal(n, seed):
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))[0]


@pytest.mark.parametrize("values", [np.arange(1, 33.0), np.r_[np.full(5, 3.0), np.full(3, 2.0), 1, 0], np.r_[1 + np.arange(6) * 1e-9, 0.5, 1e-6], np.r_[1, 1 + 1e-12, 0.3], np.zeros(4), np.ones(1)])
def test_refined_eigenvectors(values):
    q = orthogonal(len(values), 5)
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    got, x = whitening.eigen(a)
    assert np.all(np.diff(got) <= 1e-15) and np.allclose(got, np.sort(values)[::-1], atol=1e-14 * max(1, values.max()))
    wide = x.astype(np.longdouble)
    assert np.abs(wide.T @ wide - np.eye(len(a))).max() < 2e-15
    assert np.abs(a.astype(np.longdouble) @ wide - wide * got).max() < 1e-14 * max(1, np.abs(a).max())
    gaps = np.abs(np.subtract.outer(values, values))[~np.eye(len(a), dtype=bool)]
    if len(gaps) and gaps.min() > 1e-10:
        want = q[:, np.argsort(-values)]
        assert np.abs(np.abs((want * x).sum(0)) - 1).max() < 1e-10


def test_float32_start_is_corrected():
    values = np.r_[5, 4 + np.arange(8) * 1e-7, 1]
    q = orthogonal(10, 1)
    a = (q * values) @ q.T
    start = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    assert np.abs(a @ start - start * np.diag(start.T @ a @ start)).max() > 1e-8
    found, x = whitening.refine(a.astype(np.longdouble), start)
    assert np.abs(a.astype(np.longdouble) @ x - x * found).max() < 1e-15 * 10


def brute(rows):
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    xs = [tuple(int(np.floor(256 * float(c))) for c in v) for _, v in rows]
    fit = np.array(sorted(set(xs)), dtype=float)
    n, sums = len(fit), [sum(c) for c in zip(*set(xs))]
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    out = []
    for (i, _), x in zip(rows, xs):
        w = (np.array(x) - fit.mean(0)) @ vectors / np.sqrt(values)
        for k in range(len(values)):
            out.append((i, k + 1, n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), w[k], values[k] / np.trace(np.cov(fit.T, bias=True))))
    return out


def compare(got, want):
    assert len(got) == len(want)
    got, want = sorted(got, key=lambda r: (r.component, r.vec_id, r.whitened)), sorted(want, key=lambda r: (r[1], r[0], r[4]))
    for k in {r[1] for r in want}:
        a, b = [r for r in got if r.component == k], [r for r in want if r[1] == k]
        assert [(r.vec_id, r.n, r.deviation) for r in a] == [(r[0], r[2], r[3]) for r in b]
        x, y = np.array([r.whitened for r in a]), np.array([r[4] for r in b])
        assert min(np.abs(x - y).max(), np.abs(x + y).max()) < 1e-9
        assert abs(a[0].explained - b[0][5]) < 1e-12
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-10


def test_query_against_numpy(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    compare(QUERIES["op11_embedding_whitening"](spark, sf).collect(), brute(rows))


def run(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    x = df.filter(whitening.usable("embedding")).select("vec_id", whitening.scaled("embedding").alias("x"))
    return whitening.whiten(x, whitening.fit(x)).collect()


def test_copies_and_bad_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, (rng.normal(size=6) * np.arange(1, 7)).tolist()) for i in range(200)]
    good += [(500 + i, good[0][1]) for i in range(100)] + [good[1], (900, [-0.0] * 6)]
    bad = [(1000, None), (1001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1002, [NAN] * 6), (1003, [INF, 1.0, 1.0, 1.0, 1.0, 1.0]), (1004, [1.0, 2.0]), (1005, [])]
    compare(run(spark, good + bad), brute(good))


def test_few_rows(spark):
    assert run(spark, []) == [] and run(spark, [(1, None), (2, [])]) == []
    one = run(spark, [(1, [0.5, 0.25])])
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained) for r in one] == [(1, 1, 0, None, 0.0), (2, 1, 0, None, 0.0)]
    flat = run(spark, [(1, [0.0, 1.0, 3.0]), (2, [2.0, 1.0, 3.0]), (None, [2.0, 1.0, 3.0])])
    assert [(r.component, r.n, r.deviation) for r in flat if r.vec_id is None] == [(k, 2, 512**2) for k in (1, 2, 3)]
    assert sorted(abs(r.whitened) for r in flat if r.component == 1) == [1, 1, 1] and all(r.whitened is None for r in flat if r.component > 1)


def test_beyond_a_long(spark):
    rows = run(spark, [(1, [1e15, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])])
    assert {r.vec_id: r.deviation for r in rows}[1] is None
    assert whitening.deviations(np.array([[1 << 40, 0]]), 3, [7, 7]) == [None]
    assert whitening.deviations(np.array([[1 << 28, 0]]), 3, [7, 7]) == [(3 * (1 << 28) - 7) ** 2 + 49]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", "b", [1, 2]), (2, "c", "d", [3, 5])], "vec_id long, part string, at string, v array<long>")
    out = whitening.whiten(df, whitening.fit(df, "v"), "v", 1)
    assert sorted((r.vec_id, r.part, r.at) for r in out.collect()) == [(1, "a", "b"), (2, "c", "d")]


def test_sums_in_rounds(spark):
    parts = spark.range(70).repartition(9).select(F.lit(np.array([1.0, 2.0]).tobytes()).alias("part"))
    assert added_up(parts, 4).tolist() == [70, 140]
    assert added_up(parts.limit(0)) is None
