"""The first n rows of a key in some order, by passes of counts: no sort, no window or list over a key.

Each pass counts the rows of each key by the next 16 bits of the order and picks the
digit at which the n-th row lies; only rows with that digit are counted again. When
few rows are left between the cuts (``finish`` in all), a window over these decides.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewatch.operators import windows as W
from framewatch.storage import kept

#: Rows that one window may see in the end, of all keys together.
FINISH = 1 << 20


def _digits(order: list[Column]) -> list[Column]:
    """Sixteen bits at a time of each column of longs, highest first; negative numbers come first."""
    flipped = [c.cast("long").bitwiseXOR(F.lit(-(1 << 63))) for c in order]
    return [F.shiftrightunsigned(c, shift).bitwiseAND(F.lit(0xFFFF)).cast("int") for c in flipped for shift in (48, 32, 16, 0)]


def _cuts(df: DataFrame, keys: list[str], need: DataFrame, order: list[Column], finish: int) -> tuple[DataFrame, int]:
    """``keys``, the digits ``_t0``, ``_t1``, ... up to which a key's first rows go, and the rows ``_need`` still wanted among those with all of these digits; how many digits.

    A key with fewer rows than it needs has no digits: all its rows are first.
    """
    digits = _digits(order)
    cuts, level = need.select(*keys, F.col("n").cast("long").alias("_need")).filter("_need > 0"), 0
    while True:
        inside = W.null_safe(df, cuts, keys)
        for i in range(level):
            inside = inside.filter(digits[i] == F.col(f"_t{i}"))
        counts = inside.groupBy(*keys, "_need", digits[level].alias("_d")).agg(F.count("*").alias("_c"))
        upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_d"))
        found = counts.withColumn("_upto", upto).filter("_upto >= _need and _upto - _c < _need")
        found = found.select(*keys, F.col("_d").alias(f"_t{level}"), (F.col("_need") - F.col("_upto") + F.col("_c")).alias("_left"), "_c")
        cuts = W.null_safe(cuts.drop("_c"), found, keys, "left").withColumn("_need", F.coalesce("_left", "_need")).drop("_left")
        cuts, level = kept(cuts, "cuts"), level + 1
        if level == len(digits) or (cuts.agg(F.sum("_c")).first()[0] or 0) <= finish:
            return cuts.drop("_c"), level


def _parts(df: DataFrame, keys: list[str], need: DataFrame, order: list[Column], finish: int) -> tuple[DataFrame, DataFrame]:
    """The rows that the cuts decide, with ``_in``; and those between them, with their place ``_at`` there and ``_need``."""
    cuts, level = _cuts(df, keys, need, order, finish)
    digits = _digits(order)
    rows = W.null_safe(df, cuts, keys, "left")
    same = [digits[i] == F.col(f"_t{i}") for i in range(level)]
    below = [functools.reduce(lambda a, b: a & b, same[:i], digits[i] < F.col(f"_t{i}")) for i in range(level)]
    between = F.coalesce(functools.reduce(lambda a, b: a & b, same), F.lit(False))
    whole = F.col("_need").isNotNull() & F.col("_t0").isNull()
    names = [f"_t{i}" for i in range(level)]
    decided = rows.filter(~between).withColumn("_in", whole | F.coalesce(functools.reduce(lambda a, b: a | b, below), F.lit(False)))
    left = rows.filter(between).withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return decided.drop(*names, "_need"), left.drop(*names)


def mark_first(df: DataFrame, keys: list[str], need: DataFrame, order: list[Column], out: str, finish: int = FINISH) -> DataFrame:
    """Adds ``out``: whether a row is among the first ``n`` (of ``need``: keys, n) of its key by ``order``, columns of longs without nulls that tell rows of a key apart. A key without a need has no first rows."""
    decided, left = _parts(df, keys, need, order, finish)
    return decided.withColumnRenamed("_in", out).unionByName(left.withColumn(out, F.col("_at") <= F.col("_need")).drop("_at", "_need"))


def nth(df: DataFrame, keys: list[str], need: DataFrame, order: list[Column], finish: int = FINISH) -> DataFrame:
    """The ``n``-th row (from 1) of each key; keys with fewer rows have none."""
    left = _parts(df, keys, need, order, finish)[1]
    return left.filter("_at = _need").drop("_at", "_need")


def median(df: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    """``keys`` and the median of the longs in ``value``, the mean of the two middle ones where there are two. Nulls don't count."""
    rows = df.filter(F.col(value).isNotNull())
    n = kept(rows.groupBy(*keys).agg(F.count("*").alias("n")), "counts")
    low, high = (nth(rows.select(*keys, value), keys, n.select(*keys, F.expr(e).alias("n")), [F.col(value)]) for e in ("(n + 1) div 2", "n div 2 + 1"))
    both = W.null_safe(low, high.withColumnRenamed(value, "_high"), keys)
    return both.select(*keys, ((F.col(value) + F.col("_high")) / 2).alias(out))
