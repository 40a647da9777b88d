"""Distributed selection against sorting."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from framewatch.operators import ensemble as EN
from framewatch.operators import ml as M
from framewatch.operators import select

LOW, HIGH = -(1 << 63), (1 << 63) - 1


def table(spark, n, seed):
    rng = random.Random(seed)
    values = [lambda: rng.randrange(-5, 5), lambda: rng.randrange(LOW, HIGH), lambda: rng.choice([LOW, HIGH, 0, -1]), lambda: 70_000 * rng.randrange(3)]
    rows = [(rng.choice(["a", "b", None, "c"]), rng.choice(values)(), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, v long, seq long").repartition(3)


@pytest.mark.parametrize("finish", [1 << 20, 0])
def test_first_rows_and_nth(spark, finish):
    rows, df = table(spark, 400, 1)
    n = {"a": 17, "b": 10_000, None: 1, "c": 0, "d": 4}
    need = spark.createDataFrame(list(n.items()), "k string, n long")
    order = [F.col("v"), F.col("seq")]
    own = {k: sorted((v, s) for kk, v, s in rows if kk == k) for k in n}
    got = select.mark_first(df, ["k"], need, order, "first", finish).collect()
    assert len(got) == len(rows)
    assert {r.seq for r in got if r["first"]} == {s for k, vs in own.items() for _, s in vs[: n[k]]}
    nth = {r.k: (r.v, r.seq) for r in select.nth(df, ["k"], need, order, finish).collect()}
    assert nth == {"a": own["a"][16], None: own[None][0]}


def test_median(spark):
    rows, df = table(spark, 301, 2)
    df = df.withColumn("v", F.col("v") % 1000).unionByName(spark.createDataFrame([("z", None, 1), ("y", 4, 1), ("a", None, 2)], "k string, v long, seq long"))
    got = {r.k: r.median for r in select.median(df, ["k"], "v").collect()}
    want = {r.k: r.m for r in df.groupBy("k").agg(F.percentile("v", F.lit(0.5)).alias("m")).filter("m is not null").collect()}
    assert got == want and "y" in got and select.median(df.limit(0), ["k"], "v").count() == 0


def test_the_split_is_stratified(spark):
    rows = [("f", i, int(i >= 40)) for i in range(50)] + [("g", 100 + i, 2) for i in range(3)] + [(None, 200, 0)]
    df = spark.createDataFrame(rows, "bus string, seq long, attack int").withColumn("source_file", F.col("bus"))
    got = M.balanced_sample(df, {0: 1000, 1: 1000, 2: 2})
    sizes = {(r.attack, r.split): r["count"] for r in got.groupBy("attack", "split").count().collect()}
    assert sizes == {(0, "train"): 32, (0, "test"): 9, (1, "train"): 8, (1, "test"): 2, (2, "train"): 1, (2, "test"): 1}


@pytest.mark.parametrize("load", [0.0, 0.1, 0.33, 1.0])
def test_load_cut(spark, load):
    rng = random.Random(5)
    rows = [(rng.choice(["x", "y", None]), i // 2, rng.randrange(2), rng.choice([0.1, 0.5, -2.0]), rng.randrange(2), rng.randrange(2), rng.random()) for i in range(120)]
    df = spark.createDataFrame(rows, "bus string, seq long, stage1 int, stage1_score double, rule_a int, rule_b int, stage3_probability double")
    got = EN.multistage(df, load=load)
    stages = [r.stage for r in got.collect()]
    two = sum(s >= 2 for s in stages)
    free = sum(r.stage == 3 for r in EN.multistage(df, load=2.0).collect())
    assert len(stages) == 120 and sum(s == 3 for s in stages) == min(free, int(load * two))
    least = got.filter("stage = 3").select("seq").count()
    assert least <= int(load * two)
