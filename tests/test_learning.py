"""Learned models against brute force in numpy."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from framewatch.operators import ml as M

COLUMNS = ["x", "y", "z"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 3)) @ np.array([[2, 0.5, 0], [0, 1, 0.3], [0, 0, 0.2]])
    label = (x[:, 0] + 0.3 * rng.normal(size=400) > 1).astype(int)
    rows = [("b", i, int(label[i]), f"f{i % 3}", *map(float, v)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "bus string, seq long, attack int, source_file string, x double, y double, z double").cache()


def test_components_are_those_of_the_correlation_matrix(table):
    x = np.array(table.orderBy("seq").select(*COLUMNS).collect())
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    values, vectors = values[::-1], vectors[:, ::-1]
    r = M.pca_fit(table, COLUMNS, 2)
    got = r.model.pc.toArray()
    assert np.allclose(np.abs(got), np.abs(vectors[:, :2]), atol=1e-8)  # up to sign
    assert np.allclose(r.model.explainedVariance.toArray(), values[:2] / values.sum())
    pc = np.array([v.pc for v in M.pca_transform(table, r).orderBy("seq").collect()])
    assert np.allclose(np.abs(pc), np.abs(z @ vectors[:, :2]), atol=1e-6)
    back = np.array(M.pca_inverse(M.pca_transform(table, r).drop(*COLUMNS), r).orderBy("seq").select(*COLUMNS).collect())
    assert np.allclose(back, (z @ vectors[:, :2] @ vectors[:, :2].T) * x.std(axis=0, ddof=1) + x.mean(axis=0), atol=1e-6)
    assert M.importance(r) == sorted(((c, pytest.approx(np.abs(row).sum())) for c, row in zip(COLUMNS, vectors[:, :2])), key=lambda p: -np.abs(vectors[COLUMNS.index(p[0]), :2]).sum())
    assert {(c, j): pytest.approx(abs(v)) for c, j, v in M.loadings(r)} == {(c, j): abs(vectors[i, j]) for i, c in enumerate(COLUMNS) for j in range(2)}


def test_isolation_scores_are_those_of_walks_down_the_trees(table):
    forest = M.isolation_forest_fit(table, COLUMNS, trees=8, sample=64)
    assert len(forest.trees) == 8
    x = np.array(table.orderBy("seq").select(*COLUMNS).collect())
    got = [r.score for r in M.isolation_forest_score(table, forest).orderBy("seq").collect()]

    def walk(tree, row):
        at = 0
        while tree[at][0] >= 0:
            f, split, left, right, _ = tree[at]
            at = left if row[f] < split else right
        return tree[at][4]

    for row, s in zip(x[:50], got):
        assert s == pytest.approx(0.5 - 2 ** (-np.mean([walk(t, row) for t in forest.trees]) / M.average_path(64)))
    # A leaf's path is its depth and the mean depth of a search among the rows in it.
    for tree in forest.trees:
        depth = {0: 0}
        for at, (f, _, left, right, path) in enumerate(tree):
            if f >= 0:
                depth[left] = depth[right] = depth[at] + 1
            else:
                assert depth[at] <= 6 and path >= depth[at]
    flagged = sum(s < forest.threshold for s in got)
    assert flagged <= 0.06 * len(got)


def test_leaf_probabilities_are_weighted_shares(table):
    model = M.decision_tree_fit(table, COLUMNS, depth=4, leaf=10)
    rows = M.decision_tree_score(table, model, COLUMNS).collect()
    n, k = len(rows), Counter(r.attack for r in rows)
    weight = {label: n / (2 * c) for label, c in k.items()}
    leaves = defaultdict(list)
    for r in rows:
        leaves[model.predictLeaf(Vectors.dense([r[c] for c in COLUMNS]))].append(r)
    assert len(leaves) >= 2
    for leaf in leaves.values():
        share = sum(weight[r.attack] for r in leaf if r.attack == 1) / sum(weight[r.attack] for r in leaf)
        assert all(r.probability == pytest.approx(share) and r.label == int(share >= 0.5) for r in leaf) and len(leaf) >= 10
    assert sum(v for _, v in M.importances(model, COLUMNS, 0.0)) == pytest.approx(1)


def test_balanced_sample_and_dual_models(table):
    got = M.balanced_sample(table, {0: 40, 1: 25}).collect()
    have = Counter((r.attack, r.source_file) for r in table.collect())
    assert Counter((r.attack, r.source_file) for r in got) == {k: min(n, 40 if k[0] == 0 else 25) for k, n in have.items()}
    assert {(r.seq, r.split) for r in got} == {(r.seq, r.split) for r in M.balanced_sample(table.repartition(7), {0: 40, 1: 25}).collect()}
    assert 0.65 < sum(r.split == "train" for r in got) / len(got) < 0.95
    a, b = M.dual_models(table, ["x"], ["y", "z"])
    for model, columns in ((a, ["x"]), (b, ["y", "z"])):
        alone = M.decision_tree_fit(table, columns)
        assert model.toDebugString.split("\n")[1:] == alone.toDebugString.split("\n")[1:]


def test_models_of_empty_tables(table):
    none = table.filter(F.lit(False))
    forest = M.isolation_forest_fit(none, COLUMNS, trees=3)
    assert M.isolation_forest_score(none, forest).count() == 0 and M.balanced_sample(none, {0: 1}).count() == 0
