"""Rows of a key that are at least so far apart: the first, and each that is ``width`` or more after the one kept before.

Which rows of a stretch of time are kept depends on the stretches before it by the
last kept time alone. So each slab of a key becomes a step function from the last
time kept before it to the last kept after it; functions of neighbouring slabs are
composed, FAN at a time, up to one node a key; from there the last kept times go
down again to the slabs, which then choose their rows. A function has at most as many
steps as there are distinct times within ``width`` of its beginning. No task holds more of a
key than a slab, or FAN functions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewatch.operators import windows as W
from framewatch.storage import kept

#: Time of a key that one task scans, and functions composed at a time.
SLAB_US, FAN = 3_600_000_000, 32
#: The last kept time where nothing was kept yet.
NEVER = -(1 << 61)


def keep_apart(times: np.ndarray, width: int, last: int = NEVER) -> np.ndarray:
    """Places of the times (ascending) that are kept after ``last``; a jump for each kept one."""
    found, i = [], int(np.searchsorted(times, last + width, "left"))
    while i < len(times):
        found.append(i)
        i = int(np.searchsorted(times, times[i] + width, "left"))
    return np.array(found, int)


def last_kept(times: np.ndarray, width: int) -> np.ndarray:
    """For each of the distinct times (ascending) the last that is kept if this one is, by doubling jumps."""
    jump = np.searchsorted(times, times + width, "left")
    end = np.where(jump < len(times), jump, np.arange(len(times)))
    while True:
        further = end[end]
        if (further == end).all():
            return times[end]
        end = further


def steps(times: np.ndarray, ends: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal ends as (their greatest time, the end); times after the first at ``bound`` or later can't be met first."""
    n = min(len(times), int(np.searchsorted(times, bound, "left")) + 1)
    last = np.append(np.flatnonzero(np.diff(ends[:n])), n - 1)
    return times[last], ends[last]


def after(upto: np.ndarray, ends: np.ndarray, last: np.ndarray, width: int) -> np.ndarray:
    """The function: the last kept times after a slab from those before it, which stay where no row is far enough."""
    at = np.searchsorted(upto, last + width, "left")
    return np.where(at < len(upto), ends[np.minimum(at, len(upto) - 1)], last)


def _arrays(part: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """The functions of a group, in order of their nodes."""
    return [tuple(np.asarray(part.column(c)[i].values) for c in ("upto", "ends")) for i in range(part.num_rows)]


def first_apart(rows: DataFrame, keys: list[str], width: int, slab_us: int = SLAB_US, fan: int = FAN) -> DataFrame:
    """``keys`` and ts_us of the kept ones of some distinct (``keys``, ts_us); null is a key like any other. ``rows`` is read several times."""
    if width <= 0:
        return rows.select(*keys, "ts_us")
    number = lambda c, size: f"cast(({c} - pmod({c}, {size})) div {size} as long)"
    span = rows.agg(F.min(F.expr(number("ts_us", slab_us))), F.max(F.expr(number("ts_us", slab_us)))).first()
    if span[0] is None:
        return rows.select(*keys, "ts_us")
    origin, nodes = span[0] * slab_us, span[1] - span[0] + 1
    slim = rows.select(*keys, "ts_us", F.expr(f"{number('ts_us', slab_us)} - {span[0]}").alias("node"))
    kinds = ", ".join(f"{k} {slim.schema[k].dataType.simpleString()}" for k in keys)
    function = f"{kinds}, node long, upto array<long>, ends array<long>"

    def row(part: pa.Table, node: int, upto: np.ndarray, ends: np.ndarray) -> pa.Table:
        lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for v in (upto, ends)]
        return pa.table([*(part.column(k).slice(0, 1) for k in keys), pa.array([node], pa.int64()), *lists], [*keys, "node", "upto", "ends"])

    def summed(part: pa.Table) -> pa.Table:
        times, node = np.sort(part.column("ts_us").to_numpy()), part.column("node")[0].as_py()
        return row(part, node, *steps(times, last_kept(times, width), origin + node * slab_us + width))

    def composed(size: int):
        def run(part: pa.Table) -> pa.Table:
            part, node = part.sort_by("node"), part.column("node")[0].as_py() // fan
            children = _arrays(part)
            met = np.unique(np.concatenate([upto for upto, _ in children]))
            bound = origin + node * size * slab_us + width
            met = met[: int(np.searchsorted(met, bound, "left")) + 1]
            last = met - width
            for child in children:
                last = after(*child, last, width)
            return row(part, node, *steps(met, last, bound))

        return run

    def handed(part: pa.Table) -> pa.Table:
        part = part.sort_by("node")
        last, before = np.array([part.column("last")[0].as_py()]), []
        for child in _arrays(part):
            before.append(int(last[0]))
            last = after(*child, last, width)
        return part.select([*keys, "node"]).append_column("last", pa.array(before, pa.int64()))

    def chosen(part: pa.Table) -> pa.Table:
        part = part.sort_by("ts_us")
        return part.take(pa.array(keep_apart(part.column("ts_us").to_numpy(), width, part.column("last")[0].as_py()))).select([*keys, "ts_us"])

    parent = F.expr(f"node div {fan}")
    levels: list[DataFrame] = []
    size = 1
    while nodes > 1:
        level = slim.groupBy(*keys, "node").applyInArrow(summed, function) if not levels else levels[-1].groupBy(*keys, parent.alias("_up")).applyInArrow(composed(size), function)
        levels.append(kept(level, "steps"))
        nodes, size = -(-nodes // fan), size * fan
    last: DataFrame | None = None
    for level in reversed(levels):
        down = level.withColumn("_up", parent)
        given = down.withColumn("last", F.lit(NEVER)) if last is None else W.null_safe(down, last.select(*keys, F.col("node").alias("_up"), "last"), [*keys, "_up"])
        last = given.groupBy(*keys, "_up").applyInArrow(handed, f"{kinds}, node long, last long")
    dealt = slim.withColumn("last", F.lit(NEVER)) if last is None else W.null_safe(slim, last, [*keys, "node"])
    return dealt.groupBy(*keys, "node").applyInArrow(chosen, f"{kinds}, ts_us long")
