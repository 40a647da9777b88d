"""Interval profiles of an id by period, small and mergeable, so that old frames are never read again.

A period's row holds its first and last time, moments of the intervals between its
frames, and a quantile sketch of bounded size. ``merge`` puts periods of an id
together, with the intervals between the last frame of one and the first of the
next, so that n, mean, deviation, least and greatest are those of one pass over
all frames (up to rounding), and quantiles within the sketch's rank error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewatch.operators import calibrate as C

DAY_US = 86_400_000_000
#: Size of a sketch: about 0.4 % of rank.
SKETCH = 800


def _moments(column: str, sketch: int) -> list:
    n = F.count(column)
    return [n.alias("n"), F.avg(column).alias("mean"), (F.var_pop(column) * n).alias("m2"), F.min(column).alias("least"), F.max(column).alias("greatest"), F.kll_sketch_agg_double(column, sketch).alias("sketch")]


def interval_summary(frames: DataFrame, keys: tuple[str, ...] = C.KEYS, period_us: int = DAY_US, sketch: int = SKETCH) -> DataFrame:
    """``keys``, first_us, last_us, n, mean, m2 (sum of squared deviations), least, greatest, sketch of the intervals (s) of each key and period. Of a single frame n is 0."""
    periods = frames.withColumn("_period", F.expr(f"(ts_us - pmod(ts_us, {period_us})) div {period_us}"))
    gaps = C.gaps(periods, (*keys, "_period"))
    return gaps.groupBy(*keys, "_period").agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), *_moments("_gap", sketch)).drop("_period")


def merge(summaries: DataFrame, keys: tuple[str, ...] = C.KEYS, sketch: int = SKETCH) -> DataFrame:
    """One row a key, of the same columns, of summaries of the key whose times don't overlap (of days, or themselves merged). Null is a key like any other."""
    before = Window.partitionBy(*keys).orderBy("first_us")
    between = summaries.select(*keys, "first_us", "last_us", ((F.col("first_us") - F.lag("last_us").over(before)) / 1_000_000).alias("_gap"))
    seams = between.groupBy(*keys).agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), *_moments("_gap", sketch))
    whole = Window.partitionBy(*keys)
    rows = summaries.unionByName(seams).withColumn("_all", F.sum(F.col("n") * F.col("mean")).over(whole) / F.sum("n").over(whole))
    return rows.groupBy(*keys).agg(
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("n").alias("n"), F.first("_all").alias("mean"),
        F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("_all"), 2)).alias("m2"), F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.kll_merge_agg_double("sketch", sketch).alias("sketch"),
    )


def statistics(summaries: DataFrame, keys: tuple[str, ...] = C.KEYS, quantiles: tuple[float, ...] = (0.05, 0.95)) -> DataFrame:
    """iat_mean, iat_std (population), iat_min, iat_max, iat_p5 and the like, n, of the keys with an interval."""
    found = {f"iat_p{round(q * 100)}": F.kll_sketch_get_quantile_double("sketch", F.lit(q)) for q in quantiles}
    some = summaries.filter("n > 0")
    return some.select(*keys, F.col("mean").alias("iat_mean"), F.sqrt(F.col("m2") / F.col("n")).alias("iat_std"), F.col("least").alias("iat_min"), F.col("greatest").alias("iat_max"), *(v.alias(k) for k, v in found.items()), "n")
