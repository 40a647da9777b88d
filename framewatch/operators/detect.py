"""Detectors: each adds a 0/1 column to a frame or feature table, most by joining a profile of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewatch.functions import payload as P
from framewatch.operators import calibrate as C
from framewatch.operators import hot
from framewatch.operators import windows as W
from framewatch.operators.evaluate import metrics

KEYS = ["bus", "can_id"]


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def _known(df: DataFrame, profile: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Left join of a profile (one row per id); ``_known`` tells whether there is one. Spark broadcasts it while it is small."""
    return df.join(profile.withColumn("_known", F.lit(True)), keys or KEYS, "left").withColumn("_known", F.coalesce("_known", F.lit(False)))


def prefilter(frames: DataFrame, expected: DataFrame, tolerance: float = 0.3, busy: hot.Busy | None = None) -> DataFrame:
    """Adds ``suspicious``: an unknown id, or an interval off the expected one by more than the tolerance.

    Expected is the calibrated interval, else the id's first in the table; an id's first frame passes if the id is known.
    Frames of hot ids (``busy``) are taken in blocks.
    """
    busy = busy or hot.busy(frames)
    rows, w = busy.rows_back(frames, 1)
    rows = busy.whole(rows.withColumn("_iat", (F.col("ts_us") - F.lag("ts_us").over(w)) / 1_000_000))
    if busy.ids is None:
        rows = rows.withColumn("_second", F.first("_iat", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        rows = busy.by_id(rows, {"_second": F.min_by("_iat", F.when(F.col("_iat").isNotNull(), F.struct(*W.ORDER)))})
    rows = _known(rows, expected)
    want = F.coalesce("expected", "_second")
    off = F.abs(F.col("_iat") - want) > tolerance * want
    return rows.withColumn("suspicious", F.when(~F.col("_known"), 1).otherwise(_flag(off))).drop("_iat", "_second", "_known", "expected")


def split(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames that pass, and suspicious ones."""
    return frames.filter("suspicious = 0"), frames.filter("suspicious = 1")


def prefilter_stats(frames: DataFrame) -> DataFrame:
    out = frames.agg(F.count("*").alias("processed"), F.sum(1 - F.col("suspicious")).alias("passed"), F.sum("suspicious").alias("flagged"))
    return out.withColumn("pass_rate", F.when(F.col("processed") > 0, F.col("passed") / F.col("processed")).otherwise(0.0))


def simple_rules(df: DataFrame) -> DataFrame:
    """Adds timing_flag (under 1 ms or over 1 s since the last frame), frequency_flag (over 100), dlc_flag, and simple, any of them."""
    t = F.col("time_delta")
    out = df.withColumns({"timing_flag": _flag((t < 0.001) | (t > 1.0)), "frequency_flag": _flag(F.col("id_frequency") > 100), "dlc_flag": _flag(~F.col("dlc").between(0, 8))})
    return out.withColumn("simple", F.greatest("timing_flag", "frequency_flag", "dlc_flag"))


def time_based(df: DataFrame, profile: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Adds time_based: an unknown id, or time_delta off the mean by more than the tolerance (of 0: over 0.1 s)."""
    rows = _known(df, profile.select(*KEYS, "mean"))
    off = F.when(F.col("mean") == 0, F.col("time_delta") > 0.1).otherwise(F.abs(F.col("time_delta") - F.col("mean")) > tolerance * F.col("mean"))
    return rows.withColumn("time_based", F.when(F.col("_known"), _flag(off)).otherwise(1)).drop("_known", "mean")


def cumulative_timing(df: DataFrame, profile: DataFrame, window: int = 100, threshold: float = 0.4) -> DataFrame:
    """Adds cumulative_timing: mean over the bus's last frames of min(relative timing error, 1), unknown ids counting 1, over the threshold."""
    rows = _known(df, profile.select(*KEYS, "mean"))
    error = F.when(~F.col("_known"), 1.0).when(F.col("mean") > 0, F.least(F.abs(F.col("time_delta") - F.col("mean")) / F.col("mean"), F.lit(1.0))).otherwise(0.0)
    blocks, b = W.bus_blocks(rows.withColumn("_e", error), window - 1)
    out = blocks.withColumn("_m", F.round(F.avg("_e").over(b.rowsBetween(-(window - 1), 0)), 9)).filter("_native = 1")
    return out.withColumn("cumulative_timing", _flag(F.col("_m") > threshold)).drop("_known", "mean", "_e", "_m", "_native", "_block", "_rn")


def signature(df: DataFrame, profile: DataFrame) -> DataFrame:
    """Adds signature: an unknown id, id_frequency under 0.001 or over 10 times the mean, or a length off by more than 2."""
    rows = _known(df, profile.select(*KEYS, "mean_frequency", "common_length"))
    off = (F.col("id_frequency") < 0.001 * F.col("mean_frequency")) | (F.col("id_frequency") > 10 * F.col("mean_frequency")) | (F.abs(F.col("dlc") - F.col("common_length")) > 2)
    return rows.withColumn("signature", F.when(F.col("_known"), _flag(off)).otherwise(1)).drop("_known", "mean_frequency", "common_length")


def dos_window(frames: DataFrame, width_s: float = 0.1, limit: int = 100) -> DataFrame:
    """Adds dos: over ``limit`` frames of the id in its tumbling window. Counts are made first and joined, so that a flood isn't one window's partition."""
    rows = frames.withColumn("_w", F.expr(f"ts_us div {int(width_s * 1_000_000)}"))
    counts = rows.groupBy(*KEYS, "_w").agg(F.count("*").alias("_c")).filter(F.col("_c") > limit)
    return rows.join(counts, [*KEYS, "_w"], "left").withColumn("dos", _flag(F.col("_c").isNotNull())).drop("_w", "_c")


def spoof_hamming(frames: DataFrame, p99: DataFrame, margin: int = 32) -> DataFrame:
    """Adds spoof: Hamming distance to the id's last payload over its 99 % quantile plus the margin (unknown ids: over the margin)."""
    rows = C.with_hamming(frames).join(p99.select(*KEYS, "p99"), KEYS, "left")
    return rows.withColumn("spoof", _flag(F.col("hamming") > F.coalesce("p99", F.lit(0.0)) + margin)).drop("p99")


def fuzzy(frames: DataFrame, known: DataFrame, limit: float = 6.5) -> DataFrame:
    """Adds fuzz: an unknown id, or payload entropy over the limit."""
    rows = _known(frames, known.select(*KEYS).distinct())
    return rows.withColumn("fuzz", _flag(~F.col("_known") | (P.entropy("data") > limit))).drop("_known")


def hybrid(frames: DataFrame, p99: DataFrame, **limits: float) -> DataFrame:
    """Adds dos, spoof, fuzz and hybrid, any of them."""
    rows = fuzzy(spoof_hamming(dos_window(frames, **limits), p99), p99)
    return rows.withColumn("hybrid", F.greatest("dos", "spoof", "fuzz"))


def dos_crosscheck(df: DataFrame, fp_max: int, base: str = "pred", id_threshold: int = 0x100, epoch_s: float = 1.0) -> DataFrame:
    """Adds dos_check: of base hits, those of ids up to the threshold beyond the first ``fp_max`` of the id in its epoch (counted from the bus's first frame)."""
    first = df.groupBy("bus").agg(F.min("ts_us").alias("_t0"))
    rows = W.null_safe(df, first, ["bus"]).withColumn("_epoch", F.expr(f"(ts_us - _t0) div {int(epoch_s * 1_000_000)}"))
    hit = (F.col(base) == 1) & (F.col("can_id") <= id_threshold)
    count = F.sum(_flag(hit)).over(Window.partitionBy(*KEYS, "_epoch").orderBy(*W.ORDER).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("dos_check", _flag(hit & (count > fp_max))).drop("_t0", "_epoch")


def spoof_crosscheck(df: DataFrame, profile: DataFrame, columns: list[str], base: str = "pred", sigma: float = 3.0, match: float = 0.7) -> DataFrame:
    """Adds spoof_check: of base hits, unknown ids; else enough outlying features and time_delta outside the widened 10-90 % range."""
    rows = _known(df, profile)
    outliers = sum((_flag(F.abs(F.col(c) - F.col(f"{c}_mean")) > sigma * F.col(f"{c}_std")) for c in columns), F.lit(0))
    margin = (F.col("q90") - F.col("q10")) * 0.5
    inside = F.col("time_delta").between(F.col("q10") - margin, F.col("q90") + margin)
    few = F.round(outliers / len(columns), 9) < round(1 - match, 9)
    out = F.when(F.col(base) != 1, 0).when(~F.col("_known"), 1).when(few, 0).when(inside, 0).otherwise(1)
    return rows.withColumn("spoof_check", out).drop("_known", *(c for c in profile.columns if c not in KEYS))


def fuzz_crosscheck(df: DataFrame, profile: DataFrame, base: str = "pred", z: float = 2.5) -> DataFrame:
    """Adds fuzz_check and fuzz_rule (which rule decided): of base hits, odd lengths; else time_delta neither within z nor within 1-99 % and two interquartile ranges of the median."""
    rows = _known(df, profile)
    t = F.col("time_delta")
    odd = F.col("_known") & ~F.array_contains("lengths", F.col("dlc"))
    near = (F.col("std") > 0) & (F.abs((t - F.col("mean")) / F.col("std")) < z)
    inside = t.between(F.col("q01"), F.col("q99")) & t.between(F.col("q50") - 2 * F.col("iqr"), F.col("q50") + 2 * F.col("iqr"))
    rule = F.when(F.col(base) != 1, 0).when(odd, 1).when(_flag(near) == 1, 2).when(_flag(inside) == 1, 3).otherwise(4)
    return rows.withColumn("fuzz_rule", rule).withColumn("fuzz_check", F.col("fuzz_rule").isin(1, 4).cast("int")).drop("_known", *(c for c in profile.columns if c not in KEYS))


def infer_vehicle(frames: DataFrame, known: DataFrame, least: float = 0.5, default: str = "unknown") -> DataFrame:
    """(bus, vehicle, similarity): the vehicle whose ids have the greatest Jaccard similarity with the bus's, if over ``least``; ties go to the first name."""
    mine, theirs = frames.select("bus", "can_id").distinct(), known.select("vehicle", "can_id").distinct()
    n_mine, n_theirs = mine.groupBy("bus").agg(F.count("*").alias("_a")), theirs.groupBy("vehicle").agg(F.count("*").alias("_b"))
    both = mine.join(theirs, "can_id").groupBy("bus", "vehicle").agg(F.count("*").alias("_n")).join(n_mine, "bus").join(n_theirs, "vehicle")
    scored = both.withColumn("similarity", F.col("_n") / (F.col("_a") + F.col("_b") - F.col("_n")))
    best = scored.groupBy("bus").agg(F.min_by("vehicle", F.struct(-F.col("similarity"), "vehicle")).alias("_v"), F.max("similarity").alias("_s"))
    out = n_mine.join(best, "bus", "left")
    return out.select("bus", F.when(F.col("_s") > least, F.col("_v")).otherwise(default).alias("vehicle"), F.coalesce("_s", F.lit(0.0)).alias("similarity"))


def by_vehicle(df: DataFrame, profiles: DataFrame, default: str, columns: list[str]) -> DataFrame:
    """Adds the profile's ``columns`` of the row's vehicle and id, or of the default vehicle."""
    own = profiles.select("vehicle", "can_id", *(F.col(c).alias(f"_own_{c}") for c in columns))
    spare = profiles.filter(F.col("vehicle") == default).select("can_id", *(F.col(c).alias(f"_default_{c}") for c in columns))
    rows = df.join(own, ["vehicle", "can_id"], "left").join(spare, "can_id", "left")
    return rows.withColumns({c: F.coalesce(f"_own_{c}", f"_default_{c}") for c in columns}).drop(*(f"{p}{c}" for c in columns for p in ("_own_", "_default_")))


def compare_vehicles(df: DataFrame, profiles: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """recall, precision, f1 of each vehicle's timing calibration (``mean`` per id) on one labelled table; an id that a calibration lacks counts as a hit."""
    attack, normal = F.coalesce(F.col("attack") == 1, F.lit(False)), ~F.coalesce(F.col("attack") == 1, F.lit(False))
    count = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name)
    joined = df.select("can_id", "time_delta", "attack").join(profiles.select(F.col("vehicle").alias("calibration"), "can_id", "mean"), "can_id")
    hit = F.coalesce(F.abs(F.col("time_delta") - F.col("mean")) > tolerance * F.col("mean"), F.lit(True))
    seen = joined.groupBy("calibration").agg(count(attack, "a"), count(normal, "b"), count(attack & hit, "ah"), count(normal & hit, "bh"))
    all_rows = df.agg(count(attack, "all_a"), count(normal, "all_b"))
    rows = profiles.select(F.col("vehicle").alias("calibration")).distinct().join(seen, "calibration", "left").fillna(0).join(F.broadcast(all_rows))
    tp, fp = F.col("all_a") - F.col("a") + F.col("ah"), F.col("all_b") - F.col("b") + F.col("bh")
    return rows.withColumns(metrics(tp, fp, F.col("b") - F.col("bh"), F.col("a") - F.col("ah"))).select("calibration", "recall", "precision", "f1")
