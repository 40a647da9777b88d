"""Ordered work on frames at scale: windows, slabs, bucketed counts, runs, running distinct counts.

Everything is partitioned by bus (one capture or vehicle) at least. What a whole
bus needs in one order is done in two passes over slabs of time, so that no task
ever holds a bus: sums within a slab, then the sums of the slabs before it.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

ORDER = ("ts_us", "seq")
#: Time slab of two-pass operators, microseconds.
SLAB_US = 60_000_000


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joins on ``keys``, null to null; the columns of ``left``, then the others of ``right``."""
    named = right.select(*(F.col(c).alias(f"_right_{c}") if c in keys else F.col(c) for c in right.columns))
    on = functools.reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys))
    return left.join(named, on, how).drop(*(f"_right_{k}" for k in keys))


def copies(df: DataFrame, keys: list[str], out: str = "_copy") -> DataFrame:
    """Adds which of the rows with equal ``keys`` a row is, from 1."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1))))


def by_id() -> WindowSpec:
    return Window.partitionBy("bus", "can_id").orderBy(*ORDER)


def by_bus() -> WindowSpec:
    return Window.partitionBy("bus").orderBy(*ORDER)


def slab(slab_us: int = SLAB_US) -> Column:
    return F.expr(f"ts_us div {slab_us}").alias("slab")


def running_sum(df: DataFrame, value: Column, out: str, keys: tuple[str, ...] = ("bus",), slab_us: int = SLAB_US) -> DataFrame:
    """Adds the running sum of ``value`` over ``keys`` in order, by slabs: a window within each, plus the sums of earlier slabs."""
    rows = df.withColumn("_slab", slab(slab_us)).withColumn("_v", value)
    inner = Window.partitionBy(*keys, "_slab").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(out, F.sum("_v").over(inner))
    sums = rows.groupBy(*keys, "_slab").agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_slab", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    return null_safe(rows, offsets, [*keys, "_slab"]).withColumn(out, F.col(out) + F.col("_before")).drop("_slab", "_v", "_before")


def running_max(df: DataFrame, values: dict[str, Column], keys: tuple[str, ...], upto: int = 0, slab_us: int = SLAB_US) -> DataFrame:
    """Adds for each of ``values`` its greatest so far (``upto`` -1: before the row) over ``keys`` in order, by slabs as ``running_sum`` has them. Nulls don't count; of structs that begin with a row number the greatest is the last."""
    rows = df.withColumn("_slab", slab(slab_us)).withColumns({f"_v_{out}": v for out, v in values.items()})
    inner = Window.partitionBy(*keys, "_slab").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, upto)
    rows = rows.withColumns({out: F.max(f"_v_{out}").over(inner) for out in values})
    tops = rows.groupBy(*keys, "_slab").agg(*(F.max(f"_v_{out}").alias(f"_t_{out}") for out in values))
    before = Window.partitionBy(*keys).orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)
    earlier = tops.select(*keys, "_slab", *(F.max(f"_t_{out}").over(before).alias(f"_e_{out}") for out in values))
    rows = null_safe(rows, earlier, [*keys, "_slab"])
    return rows.withColumns({out: F.greatest(out, f"_e_{out}") for out in values}).drop("_slab", *(f"{x}{out}" for out in values for x in ("_v_", "_e_")))


def first_seen(df: DataFrame, keys: tuple[str, ...], within: tuple[str, ...] = ("bus",)) -> DataFrame:
    """Adds ``_first``: 1 on the first frame of each value of ``keys`` within ``within``. A join with one row a value, no window over the bus."""
    place = F.struct(*ORDER)
    first = df.filter(F.col(keys[0]).isNotNull()).groupBy(*within, *keys).agg(F.min(place).alias("_at"))
    joined = null_safe(df, first, [*within, *keys], "left")
    return joined.withColumn("_first", F.coalesce((F.col("_at") == place).cast("int"), F.lit(0))).drop("_at")


def trailing_count(df: DataFrame, width_us: int, out: str, keys: tuple[str, ...] = ("bus",), where: Column | None = None) -> DataFrame:
    """Adds how many frames of the same ``keys`` (for which ``where`` holds) lie in [t - width, t], up to this one in order.

    Exact in buckets of the width: each frame goes to its own bucket and, as a
    helper, to the next; a window of that width spans two buckets at most.
    """
    native = df.withColumn("_bucket", F.expr(f"ts_us div {width_us}")).withColumn("_native", F.lit(1)).withColumn("_counted", F.lit(1) if where is None else F.when(where, 1))
    helpers = native.filter("_counted = 1").select(*keys, "ts_us", "seq", (F.col("_bucket") + 1).alias("_bucket"), F.lit(0).alias("_native"), "_counted")
    both = native.unionByName(helpers, allowMissingColumns=True)
    part = [*keys, "_bucket"]
    upto = Window.partitionBy(*part).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    older = Window.partitionBy(*part).orderBy("ts_us").rangeBetween(Window.unboundedPreceding, -(width_us + 1))
    return both.withColumn(out, F.count("_counted").over(upto) - F.count("_counted").over(older)).filter("_native = 1").drop("_bucket", "_native", "_counted")


def run_length(same: Column, w: WindowSpec, part: list[str], df: DataFrame, out: str) -> DataFrame:
    """Adds the length so far of the run of rows for which ``same`` (as the row before) holds."""
    rows = df.withColumn("_run", F.sum(F.when(same, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy(*part, "_run").orderBy(*ORDER)
    return rows.withColumn(out, F.row_number().over(inner)).drop("_run")


def bus_blocks(df: DataFrame, rows_back: int, slab_us: int = SLAB_US) -> tuple[DataFrame, WindowSpec]:
    """Rows of a bus in blocks of time, each preceded by copies (``_native`` = 0) of the last ``rows_back`` rows before it.

    A window of at most ``rows_back`` rows back over (bus, block) then sees what one
    over the bus would. Rows are numbered in two passes, so blocks have equal rows.
    """
    size = max(rows_back * 4, 20_000)
    numbered = running_sum(df, F.lit(1), "_rn", slab_us=slab_us)
    native = numbered.withColumn("_block", F.expr(f"(_rn - 1) div {size}")).withColumn("_native", F.lit(1))
    tail = native.filter(F.expr(f"(_rn - 1) % {size} >= {size - rows_back}")).withColumn("_block", F.col("_block") + 1).withColumn("_native", F.lit(0))
    return native.unionByName(tail), Window.partitionBy("bus", "_block").orderBy(*ORDER)
