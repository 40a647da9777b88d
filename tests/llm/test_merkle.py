"""Merkle manifests against trees built with hashlib."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from framewatch.llm import merkle

SCHEMA = "doc_id long, lang string, text string, path string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves, arity):
    """The root and each leaf's list of (left, right)."""
    level, owners, paths = list(leaves), [[i] for i in range(len(leaves))], [[] for _ in leaves]
    while len(level) > 1:
        up, held = [], []
        for at in range(0, len(level), arity):
            run = level[at : at + arity]
            for k in range(len(run)):
                for i in owners[at + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(h(*run))
            held.append([i for o in owners[at : at + arity] for i in o])
        level, owners = up, held
    return level[0], paths


def expected(rows, arity):
    trees = {}
    for r in rows:
        trees.setdefault("" if r[1] is None else "=" + r[1], []).append(((r[0] is not None, r[0] or 0, h(*(field(v) for v in r))), r))
    names = sorted(trees, key=str.encode)
    built = {n: tree([k[2] for k, _ in sorted(trees[n])], arity) for n in names}
    root, crown = tree([built[n][0] for n in names], arity)
    out = []
    for n, above in zip(names, crown):
        for (key, _), path in zip(sorted(trees[n]), built[n][1]):
            out.append((key[2], built[n][0], root, "".join(a + b for a, b in path + above)))
    return sorted(out)


def run(spark, rows, arity=8):
    df = spark.createDataFrame(rows, SCHEMA)
    df = df.withColumn("leaf", merkle.leaf(*(F.col(c) for c in df.columns)))
    return merkle.manifest(df.withColumnRenamed("path", "tree"), "lang", [F.col("doc_id")], "leaf", arity)


@pytest.mark.parametrize("arity", [2, 3, 8])
def test_against_hashlib(spark, arity):
    rows = [(i, lang, f"text {i} ä" * (i % 5), None) for i in range(-5, 140) for lang in ("de", "zh")] + [(3, "one", "x", "p"), (1, None, "a", "b"), (None, None, None, None), (7, "ä", "", "")]
    rows += [rows[3]] * 20 + [(5, "de", None, "q"), (None, "de", "y", "z")]
    out = run(spark, rows, arity)
    got = out.select("leaf", "subroot", "root", merkle.siblings(F.col("path")).alias("proof"), merkle.fold(F.col("leaf"), F.col("path")).alias("folded"), merkle.fold(F.lit(h("other")), F.col("path")).alias("wrong"))
    found = got.collect()
    assert sorted(tuple(r)[:4] for r in found) == expected(rows, arity)
    assert all(r.folded == r.root and r.wrong != r.root for r in found)


def test_few_rows(spark):
    assert run(spark, []).collect() == []
    lone = run(spark, [(1, "en", "a", None)]).first()
    assert lone.path == [] and lone.leaf == lone.subroot == lone.root
    two = run(spark, [(1, "en", "a", None), (1, "fr", "a", None)]).collect()
    assert len({r.root for r in two}) == 1 and all(r.subroot == r.leaf and len(r.path) == 1 for r in two)


def test_columns_and_case(spark):
    df = spark.createDataFrame([(1, "en", "a", "B")], "place long, size string, digest string, row string")
    out = merkle.manifest(df.withColumn("h", merkle.leaf(F.col("place"))), "size", [F.col("place")], "h")
    assert out.drop("subroot", "root", "path", "h").first() == (1, "en", "a", "B")
    assert spark.range(1).select(merkle.lowered(F.lit("AZ İÄz")).alias("x")).first().x == "az İÄz"
