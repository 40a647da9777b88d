"""Expressions and filters on frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bit_time(delta_s: Column | str) -> Column:
    """struct(mean, rms, energy) of the time per bit of a 108-bit frame; 0 unless the time since the last frame is positive."""
    t = F.col(delta_s) if isinstance(delta_s, str) else delta_s
    per = F.when(t > 0, t / 108).otherwise(0.0)
    return F.struct(per.alias("mean"), F.abs(per).alias("rms"), (per * per).alias("energy"))


def id_priority(can_id: Column | str = "can_id") -> Column:
    """struct(normalized, priority): the id over 0x7FF, and one minus that."""
    share = (F.col(can_id) if isinstance(can_id, str) else can_id) / 0x7FF
    return F.struct(share.alias("normalized"), (1 - share).alias("priority"))


def calendar(ts_us: Column | str = "ts_us") -> list[Column]:
    """hour, minute, second of the UTC day."""
    second = F.expr(f"{ts_us} div 1000000") if isinstance(ts_us, str) else F.floor(ts_us / 1_000_000)
    return [((second / 3600).cast("long") % 24).cast("int").alias("hour"), ((second / 60).cast("long") % 60).cast("int").alias("minute"), (second % 60).cast("int").alias("second")]


def time_range(frames: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Frames in the closed range."""
    return frames.filter(F.col("ts_us").between(start_us, end_us))


def by_id(frames: DataFrame, can_id: int) -> DataFrame:
    return frames.filter(F.col("can_id") == can_id)


def is_diagnostic(can_id: Column | str = "can_id") -> Column:
    c = F.col(can_id) if isinstance(can_id, str) else can_id
    return (c == 0x7DF) | c.between(0x7E0, 0x7E7) | c.between(0x7E8, 0x7EF)


def diagnostic_source(can_id: Column | str = "can_id", source_id: Column | str = "source_id") -> Column:
    """The source of a diagnostic frame: the one supplied, else the id's low four bits; null for other frames."""
    c, s = (F.col(x) if isinstance(x, str) else x for x in (can_id, source_id))
    return F.when(is_diagnostic(c), F.coalesce(s, c.bitwiseAND(F.lit(15))))
