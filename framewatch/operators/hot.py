"""State by id where one id may hold most frames: segments of time, summaries of each, carried over and applied.

What ``rules.add_state`` takes from windows over (bus, can_id) is associative: row
numbers and distinct sources are sums, the start of a run, the last counter and the
last time of a payload are running maxima. Each is a window within a slab of time
and the combined summaries of the slabs before it. What looks back a bounded number
of rows (intervals, payloads, the time so many frames ago) is a window within blocks
of rows of the id, each preceded by copies of as many rows before it. No task holds
an id, nor a payload that an id repeats without end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from framewatch.functions import payload as P
from framewatch.functions.frames import diagnostic_source
from framewatch.operators import windows as W
from framewatch.storage import kept

#: Frames of one id from which it is taken in segments; results are the same either way.
HOT_ROWS = 1 << 20
#: Rows of an id in a block at least.
BLOCK = 20_000
_KEYS = ("bus", "can_id")


def segmented_state(frames: DataFrame, sources: bool = True, memory_us: int | None = None, history: int = 0, backs: list[int] | None = None, slab_us: int = W.SLAB_US, block: int = BLOCK) -> DataFrame:
    """What ``rules.add_state`` adds, with ``_intervals`` and ``_payloads`` of the last ``history`` rows (if any) and ``_back_n`` for each n of ``backs``."""
    rows = frames.withColumns({"_payload": P.bytes_to_hex("data", ""), "_nibble": F.try_element_at("data", F.lit(1)).bitwiseAND(F.lit(15))})
    rows = W.running_sum(rows, F.lit(1), "_n", _KEYS, slab_us)

    rows = _row_blocks(rows, max([2, history + 1, *(backs or [])]), block)
    w = Window.partitionBy(*_KEYS, "_block").orderBy(*W.ORDER)
    rows = rows.withColumns({
        "interval_ms": (F.col("ts_us") - F.lag("ts_us").over(w)) / 1000,
        "_start": F.when(F.coalesce(F.col("_payload") == F.lag("_payload").over(w), F.lit(False)), F.lit(None)).otherwise(F.col("_n")),
        **{f"_back_{n}": F.lag("ts_us", n - 1).over(w) for n in backs or []},
    })
    if history:
        last = w.rowsBetween(-(history - 1), 0)
        rows = rows.withColumns({"_intervals": F.collect_list("interval_ms").over(last), "_payloads": F.collect_list("_payload").over(last)})
    rows = rows.filter("_native = 1").drop("_native", "_block")

    rows = W.running_max(rows, {"_run": F.col("_start")}, _KEYS, 0, slab_us)
    numbered = F.when(F.col("_nibble").isNotNull(), F.struct("_n", "_nibble"))
    rows = W.running_max(rows, {"_counter": numbered}, _KEYS, -1, slab_us)
    rows = rows.withColumns({"_run_length": F.col("_n") - F.col("_run") + 1, "_counter_before": F.coalesce("_counter._nibble", F.lit(0))}).drop("_run", "_counter", "_start")

    again = (*_KEYS, "_payload")
    rows = W.running_sum(rows, F.lit(1), "_repeats", again, slab_us).withColumn("_repeats", F.col("_repeats") - 1)
    rows = W.running_max(rows, {"_seen": F.col("ts_us")}, again, -1, slab_us)
    rows = rows.withColumn("_gap_us", F.col("ts_us") - F.col("_seen")).drop("_seen")
    if memory_us is not None:
        anew: Column = F.col("_gap_us").isNull() | (F.col("_gap_us") > memory_us)
        rows = W.running_max(rows, {"_since": F.when(anew, F.col("_repeats"))}, again, 0, slab_us)
        rows = rows.withColumns({"_repeats": F.col("_repeats") - F.col("_since"), "_gap_us": F.when(~anew, F.col("_gap_us"))}).drop("_since")
    if sources:
        rows = W.first_seen(rows.withColumn("_source", diagnostic_source()), ("_source",), _KEYS)
        rows = W.running_sum(rows, F.col("_first"), "_sources", _KEYS, slab_us).drop("_first")
    return rows


def hot_ids(frames: DataFrame, rows: int = HOT_ROWS, keys: tuple[str, ...] = _KEYS) -> DataFrame:
    """``keys`` (an id) of those with more frames than ``rows``."""
    return frames.groupBy(*keys).agg(F.count("*").alias("_count")).filter(F.col("_count") > rows).select(*keys)


def _row_blocks(rows: DataFrame, reach: int, block: int) -> DataFrame:
    """Rows numbered ``_n`` in blocks (``_block``), each with copies (``_native`` 0) of the ``reach`` rows before it."""
    size = max(block, 4 * reach)
    native = rows.withColumn("_block", F.expr(f"(_n - 1) div {size}")).withColumn("_native", F.lit(1))
    tail = native.filter(F.expr(f"(_n - 1) % {size} >= {size - reach}")).withColumn("_block", F.col("_block") + 1).withColumn("_native", F.lit(0))
    return native.unionByName(tail)


@dataclass
class Busy:
    """The ids of a table that are too hot for one task (``ids`` None: there is none), and windows over all ids that spread these over blocks.

    ``rows_back`` and ``time_back`` give rows and the partition of windows that look
    back a bounded number of rows, or a bounded time; ``whole`` then drops the copies
    that blocks begin with. Without hot ids rows and windows are those of plain SQL.
    """

    ids: DataFrame | None
    keys: tuple[str, ...] = _KEYS
    block: int = BLOCK
    slab_us: int = W.SLAB_US

    def _split(self, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Frames of hot ids, and the others as one block an id."""
        marked = W.null_safe(frames, self.ids.withColumn("_hot", F.lit(1)), list(self.keys), "left")
        rest = marked.filter("_hot is null").drop("_hot")
        return marked.filter("_hot = 1").drop("_hot"), rest.withColumns({"_block": F.lit(-1).cast("long"), "_native": F.lit(1)})

    def rows_back(self, frames: DataFrame, reach: int, number: str | None = None) -> tuple[DataFrame, WindowSpec]:
        """Rows, and the ordered window in which each has its ``reach`` rows before it at least; ``number``: adds the row's number within its id under this name."""
        plain = Window.partitionBy(*self.keys).orderBy(*W.ORDER)
        if self.ids is None:
            return frames.withColumn(number, F.row_number().over(plain)) if number else frames, plain
        busy, rest = self._split(frames)
        blocks = _row_blocks(W.running_sum(busy, F.lit(1), "_n", self.keys, self.slab_us), reach, self.block)
        if number:
            blocks, rest = blocks.withColumn(number, F.col("_n").cast("int")), rest.withColumn(number, F.row_number().over(plain))
        return rest.unionByName(blocks.drop("_n")), Window.partitionBy(*self.keys, "_block").orderBy(*W.ORDER)

    def time_back(self, frames: DataFrame, width_us: int) -> tuple[DataFrame, tuple[str, ...]]:
        """Rows, and the columns by which to partition windows in which each has all rows of the last ``width_us`` (of copies: keys and times only)."""
        if self.ids is None:
            return frames, self.keys
        busy, rest = self._split(frames)
        native = busy.withColumn("_block", F.expr(f"ts_us div {width_us}")).withColumn("_native", F.lit(1))
        before = native.select(*self.keys, *W.ORDER, (F.col("_block") + 1).alias("_block"), F.lit(0).alias("_native"))
        return rest.unionByName(native).unionByName(before, allowMissingColumns=True), (*self.keys, "_block")

    def whole(self, rows: DataFrame) -> DataFrame:
        """Each row once again."""
        return rows if self.ids is None else rows.filter("_native = 1").drop("_native", "_block")

    def by_id(self, frames: DataFrame, values: dict[str, Column]) -> DataFrame:
        """Adds aggregates over all rows of the id."""
        if self.ids is None:
            w = Window.partitionBy(*self.keys)
            return frames.withColumns({k: v.over(w) for k, v in values.items()})
        return W.null_safe(frames, frames.groupBy(*self.keys).agg(*(v.alias(k) for k, v in values.items())), list(self.keys))


def busy(frames: DataFrame, keys: tuple[str, ...] = _KEYS, rows: int = HOT_ROWS, **sizes: int) -> Busy:
    """Counts the frames of each id; those with more than ``rows`` are hot. One table with few rows: an id a million frames at most."""
    found = hot_ids(frames, rows, keys)
    return Busy(None if found.isEmpty() else kept(found, "hot"), keys, **sizes)
