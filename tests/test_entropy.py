"""Entropy of many payloads at once against that of the JVM expression."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from framewatch.functions import payload as P
from framewatch.operators import features as FT


def test_entropy_of_many_lists(spark):
    rng = random.Random(7)
    lists = [[rng.randrange(rng.choice([2, 9, 256])) for _ in range(rng.randrange(65))] for _ in range(3000)]
    lists += [None, [], [0], [255] * 40, [1, None], [None], list(range(256)), None]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(lists)], "i int, d array<int>")
    got = rows.select("i", F.arrow_udf(FT.byte_entropy, "double")("d").alias("a"), P.entropy("d").alias("b")).collect()
    assert len(got) == len(lists)
    for r in got:
        assert r.a == (r.b if r.b is None else pytest.approx(r.b, abs=1e-12)), lists[r.i]
