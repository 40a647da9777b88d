"""Profiles learned from attack-free frames, one row per id (and bus or vehicle), and n-grams of ids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewatch.functions import payload as P
from framewatch.operators import hot, select
from framewatch.operators import windows as W

KEYS = ("bus", "can_id")
#: Intervals in one stretch of an id's history, each of which has a spectrum of its own.
STRETCH = 65_536


def gaps(frames: DataFrame, keys: tuple[str, ...] = KEYS, busy: hot.Busy | None = None) -> DataFrame:
    """Adds ``_gap``, the time (s) since the id's frame before; frames of hot ids are taken in blocks."""
    busy = busy or hot.busy(frames, keys)
    rows, w = busy.rows_back(frames, 1)
    return busy.whole(rows.withColumn("_gap", (F.col("ts_us") - F.lag("ts_us").over(w)) / 1_000_000))


def with_delta(frames: DataFrame, keys: tuple[str, ...] = KEYS, busy: hot.Busy | None = None) -> DataFrame:
    """Adds time_delta (s) to the id's last frame; 0 for the first."""
    return gaps(frames, keys, busy).withColumn("time_delta", F.coalesce("_gap", F.lit(0.0))).drop("_gap")


def _later(frames: DataFrame, keys: tuple[str, ...], busy: hot.Busy | None = None) -> DataFrame:
    """Only frames with an earlier one of their id, with the interval to it (s) as ``iat``."""
    return gaps(frames, keys, busy).filter("_gap is not null").withColumn("iat", F.col("_gap")).drop("_gap")


def quantile(c: str, p: float | list[float], approx: bool = False) -> Column:
    """Exact with interpolation, or approximate (bounded memory) for very hot ids."""
    at = F.array(*(F.lit(x) for x in p)) if isinstance(p, list) else F.lit(p)
    return F.percentile_approx(c, at, 10_000) if approx else F.percentile(c, at)


def mode(rows: DataFrame, keys: tuple[str, ...], value: str, out: str) -> DataFrame:
    """The commonest value per key, the least of ties."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(out))


def iat_stats(frames: DataFrame, keys: tuple[str, ...] = KEYS, approx: bool = False) -> DataFrame:
    return _later(frames, keys).groupBy(*keys).agg(F.avg("iat").alias("iat_mean"), F.stddev_pop("iat").alias("iat_std"), quantile("iat", 0.05, approx).alias("iat_p5"), quantile("iat", 0.95, approx).alias("iat_p95"), F.count("*").alias("n"))


def frequency_profile(frames: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """rate (frames a second of the id's span), mean_iat, std_iat, min_iat, max_iat, count."""
    own = gaps(frames, keys, None).withColumnRenamed("_gap", "iat")
    span = (F.max("ts_us") - F.min("ts_us")) / 1_000_000
    return own.groupBy(*keys).agg(F.when(span > 0, F.count("*") / span).otherwise(0.0).alias("frequency"), F.avg("iat").alias("mean_iat"), F.stddev_samp("iat").alias("std_iat"), F.min("iat").alias("min_iat"), F.max("iat").alias("max_iat"), F.count("*").alias("n"))


def payload_profile(frames: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """entropy_mean, entropy_std (sample), common_dlc, dlc_variance."""
    agg = frames.withColumn("_e", P.entropy("data")).groupBy(*keys).agg(F.avg("_e").alias("entropy_mean"), F.coalesce(F.stddev_samp("_e"), F.lit(0.0)).alias("entropy_std"), F.coalesce(F.var_samp("dlc"), F.lit(0.0)).alias("dlc_variance"))
    return agg.join(mode(frames, keys, "dlc", "common_dlc"), list(keys))


def periodicity(deltas: np.ndarray) -> float:
    """Share of the strongest frequency in the spectrum of the intervals, the mean left out; 0 for ten or fewer."""
    if len(deltas) <= 10:
        return 0.0
    power = np.abs(np.fft.rfft(deltas - deltas.mean()))[1:]
    return float(power.max() / power.sum()) if power.sum() > 1e-12 else 0.0


def timing_profile(frames: DataFrame, keys: tuple[str, ...] = KEYS, stretch: int = STRETCH) -> DataFrame:
    """regularity_cv, and periodicity_score: the mean over consecutive stretches of ``stretch`` intervals, weighted by their intervals.

    An id's history is taken in stretches at every size (the averaged periodogram), so that
    what is periodic within one is found wherever it lies and no task holds more than a
    stretch; a history shorter than that is one stretch, and the score that of its whole spectrum.
    """
    rows = _later(frames, keys).withColumn("_part", F.expr(f"(row_number() over (partition by {', '.join(keys)} order by ts_us, seq) - 1) div {stretch}"))
    cv = rows.groupBy(*keys).agg(F.when(F.avg("iat") > 0, F.coalesce(F.stddev_samp("iat"), F.lit(0.0)) / F.avg("iat")).otherwise(0.0).alias("regularity_cv"))
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema.fields}

    def spectrum(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["ts_us", "seq"])
        return pd.DataFrame({**{k: [part[k].iloc[0]] for k in keys}, "_p": [periodicity(part["iat"].to_numpy())], "_n": [len(part)]})

    parts = rows.select(*keys, "_part", "ts_us", "seq", "iat").groupBy(*keys, "_part").applyInPandas(spectrum, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", _p double, _n long")
    return cv.join(parts.groupBy(*keys).agg((F.sum(F.col("_p") * F.col("_n")) / F.sum("_n")).alias("periodicity_score")), list(keys))


def ngrams(frames: DataFrame, n: int = 3, top: int | None = None) -> DataFrame:
    """(gram, n) of ``n`` consecutive ids of a bus over the whole ordered stream; the ``top`` commonest if asked for."""
    rows, w = W.bus_blocks(frames.select("bus", "ts_us", "seq", "can_id"), n - 1)
    gram = F.array(*(F.lag("can_id", i).over(w) for i in range(n - 1, 0, -1)), F.col("can_id"))
    counts = rows.withColumn("gram", gram).filter("_native = 1").filter(~F.exists("gram", lambda x: x.isNull())).groupBy("gram").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "gram").limit(top) if top else counts


def time_profile(frames: DataFrame, keys: tuple[str, ...] = KEYS, approx: bool = False) -> DataFrame:
    """mean, sd, 5/50/95 % quantile of time_delta (the first frame's 0 included)."""
    return with_delta(frames, keys).groupBy(*keys).agg(F.avg("time_delta").alias("mean"), F.coalesce(F.stddev_samp("time_delta"), F.lit(0.0)).alias("std"), *(quantile("time_delta", p, approx).alias(f"q{int(p * 100):02d}") for p in (0.05, 0.5, 0.95)))


def signature_profile(features: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """mean_frequency (of id_frequency), modal length, length sd, count."""
    agg = features.groupBy(*keys).agg(F.avg("id_frequency").alias("mean_frequency"), F.coalesce(F.stddev_samp("dlc"), F.lit(0.0)).alias("length_std"), F.count("*").alias("n"))
    return agg.join(mode(features, keys, "dlc", "common_length"), list(keys))


def spoofing_profile(features: DataFrame, columns: list[str], keys: tuple[str, ...] = KEYS, approx: bool = False) -> DataFrame:
    """mean, sd, min, max of each column, and the 10/50/90 % quantiles of time_delta."""
    aggs = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    return features.groupBy(*keys).agg(*aggs, *(quantile("time_delta", p, approx).alias(f"q{int(p * 100)}") for p in (0.1, 0.5, 0.9)))


def fuzzing_profile(frames: DataFrame, keys: tuple[str, ...] = KEYS, approx: bool = False) -> DataFrame:
    """Valid lengths; mean, sd, variance, cv of time_delta; its quantiles and interquartile range."""
    ps = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    td = with_delta(frames, keys).groupBy(*keys).agg(F.sort_array(F.collect_set("dlc")).alias("lengths"), F.avg("time_delta").alias("mean"), F.coalesce(F.stddev_samp("time_delta"), F.lit(0.0)).alias("std"), F.coalesce(F.var_samp("time_delta"), F.lit(0.0)).alias("var"), quantile("time_delta", ps, approx).alias("_q"))
    out = td.select(*keys, "lengths", "mean", "std", "var", F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(0.0).alias("cv"), *(F.col("_q")[i].alias(f"q{int(p * 100):02d}") for i, p in enumerate(ps)))
    return out.withColumn("iqr", F.col("q75") - F.col("q25"))


def dos_fpmax(normal: DataFrame, pred: str = "pred") -> DataFrame:
    """One row: the most false alarms of one id on normal frames."""
    return normal.groupBy(*KEYS).agg(F.sum(F.col(pred).cast("long")).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("fp_max"))


def with_hamming(frames: DataFrame, keys: tuple[str, ...] = KEYS, busy: hot.Busy | None = None) -> DataFrame:
    """Adds hamming: bits changed since the id's last payload; 0 for the first."""
    busy = busy or hot.busy(frames, keys)
    rows, w = busy.rows_back(frames, 1)
    return busy.whole(rows.withColumn("hamming", F.coalesce(P.hamming("data", F.lag("data").over(w)), F.lit(0))))


def hamming_p99(frames: DataFrame, keys: tuple[str, ...] = KEYS, approx: bool = False) -> DataFrame:
    return with_hamming(frames, keys).groupBy(*keys).agg(quantile("hamming", 0.99, approx).cast("double").alias("p99"))


def prefilter_intervals(frames: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Upper median of the id's intervals (s)."""
    later = _later(frames, keys).select(*keys, F.round(F.col("iat") * 1_000_000).cast("long").alias("_us"))
    need = later.groupBy(*keys).agg(F.expr("count(*) div 2 + 1").alias("n"))
    return select.nth(later, list(keys), need, [F.col("_us")]).select(*keys, (F.col("_us") / 1_000_000).alias("expected"))


def vehicle(frames: DataFrame) -> dict[str, DataFrame]:
    """All profiles by vehicle and id, and per-vehicle metadata (samples, distinct ids)."""
    keys = ("vehicle", "can_id")
    normal = frames.filter("attack = 0")
    return {
        "iat": iat_stats(normal, keys), "frequency": frequency_profile(normal, keys), "payload": payload_profile(normal, keys), "time": time_profile(normal, keys),
        "fuzzing": fuzzing_profile(normal, keys), "hamming": hamming_p99(normal, keys), "prefilter": prefilter_intervals(normal, keys), "meta": normal.groupBy("vehicle").agg(F.count("*").alias("samples"), F.countDistinct("can_id").alias("ids")),
    }
