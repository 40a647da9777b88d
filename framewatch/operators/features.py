"""Feature tables over frames: window functions per id and, in blocks, per bus.

What looks back within an id takes ``busy``, the ids that are too hot for one task,
whose frames are windowed in blocks (``hot.Busy``); it is found by a count where it
isn't given. Chains of features find it once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from framewatch.functions import frames as FR
from framewatch.functions import payload as P
from framewatch.operators import calibrate as C
from framewatch.operators import hot
from framewatch.operators import windows as W
from framewatch.storage import kept


def _back(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def interarrival(frames: DataFrame, busy: hot.Busy | None = None) -> DataFrame:
    """Adds interval_ms and time_delta (s) since the id's last frame, and bus_delta since the bus's; 0 for the first."""
    busy = busy or hot.busy(frames)
    rows, w = busy.rows_back(frames, 1)
    own = F.col("ts_us") - F.lag("ts_us").over(w)
    rows = busy.whole(rows.withColumns({"interval_ms": F.coalesce(own / 1000, F.lit(0.0)), "time_delta": F.coalesce(own / 1_000_000, F.lit(0.0))}))
    blocks, b = W.bus_blocks(rows, 1)
    return blocks.withColumn("bus_delta", F.coalesce((F.col("ts_us") - F.lag("ts_us").over(b)) / 1_000_000, F.lit(0.0))).filter("_native = 1").drop("_native", "_block", "_rn")


def _trailing(keys: tuple[str, ...], us: int) -> Column:
    """Frames of the id in [t - us, t] up to this one in order; ``keys`` as ``Busy.time_back`` gives them for ``us`` or more."""
    older = Window.partitionBy(*keys).orderBy("ts_us").rangeBetween(Window.unboundedPreceding, -(us + 1))
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*W.ORDER)) - F.count(F.lit(1)).over(older)


def rates(frames: DataFrame, busy: hot.Busy | None = None) -> DataFrame:
    """Adds freq_last_1s, 5s, 10s, 30s: frames of the id over the window; 0 unless it has two in a minute."""
    busy = busy or hot.busy(frames)
    rows, keys = busy.time_back(frames, 60_000_000)
    out = rows.withColumn("_m", _trailing(keys, 60_000_000))
    for s in (1, 5, 10, 30):
        out = out.withColumn(f"freq_last_{s}s", F.when(F.col("_m") >= 2, _trailing(keys, s * 1_000_000) / s).otherwise(0.0))
    return busy.whole(out.drop("_m"))


def interval_stats(frames: DataFrame, busy: hot.Busy | None = None) -> DataFrame:
    """Adds mean, sample sd, min, max and jitter (max - min) of the last 10 intervals (s); 0 with fewer than three frames."""
    busy = busy or hot.busy(frames)
    rows, by = busy.rows_back(frames, 10)
    rows = rows.withColumn("_i", (F.col("ts_us") - F.lag("ts_us").over(by)) / 1_000_000).withColumn("_k", F.row_number().over(by))
    w = _back(by, 10)
    some = lambda c: F.when(F.col("_k") >= 3, c).otherwise(0.0)
    rows = rows.withColumns({"interval_mean": some(F.avg("_i").over(w)), "interval_std": some(F.stddev_samp("_i").over(w)), "interval_min": some(F.min("_i").over(w)), "interval_max": some(F.max("_i").over(w))})
    return busy.whole(rows.withColumn("interval_jitter", F.col("interval_max") - F.col("interval_min")).drop("_i", "_k"))


def behavior(frames: DataFrame, busy: hot.Busy | None = None) -> DataFrame:
    """Adds dlc_consistency (last 10), data_change_rate against the last payload, payload_variance (mean of the bytes' sample sd over the last 5)."""
    busy = busy or hot.busy(frames)
    rows, by = busy.rows_back(frames, 10)
    w5, w10 = _back(by, 5), _back(by, 10)
    rows = rows.withColumns({f"_b{i}": F.coalesce(F.try_element_at("data", F.lit(i + 1)), F.lit(0)) for i in range(8)})
    rows = rows.withColumns({"_k": F.row_number().over(by), "_p": F.lag("data").over(by), "_m": F.max("dlc").over(w5), **{f"_s{i}": F.stddev_samp(f"_b{i}").over(w5) for i in range(8)}, "_a": F.min("dlc").over(w10), "_z": F.max("dlc").over(w10)})
    changed = F.size(F.filter(F.zip_with("data", "_p", lambda x, y: x != y), lambda x: x))
    spread = F.aggregate(F.slice(F.array(*(f"_s{i}" for i in range(8))), 1, F.least("_m", F.lit(8))), F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumns({
        "dlc_consistency": F.when(F.col("_k") < 2, 1.0).otherwise((F.col("_a") == F.col("_z")).cast("double")),
        "data_change_rate": F.when(F.col("_k") < 2, 0.0).when(F.size("data") != F.size("_p"), 1.0).otherwise(changed / F.greatest(F.size("data"), F.lit(1))),
        "payload_variance": F.when((F.col("_k") >= 5) & (F.col("_m") > 0), spread / F.col("_m")).otherwise(0.0),
    })
    return busy.whole(rows.drop("_k", "_p", "_m", "_a", "_z", *(f"_b{i}" for i in range(8)), *(f"_s{i}" for i in range(8))))


def communication(frames: DataFrame, slab_us: int = W.SLAB_US) -> DataFrame:
    """Adds running total_messages, unique_can_ids, id_diversity, runtime_seconds and global_message_rate of the bus, in two passes over slabs."""
    rows = W.first_seen(frames, ("can_id",))
    rows = W.running_sum(rows, F.lit(1), "total_messages", slab_us=slab_us)
    rows = W.running_sum(rows, F.col("_first"), "unique_can_ids", slab_us=slab_us)
    start = frames.groupBy("bus").agg(F.min("ts_us").alias("_t0"))
    rows = W.null_safe(rows, start, ["bus"]).withColumn("runtime_seconds", (F.col("ts_us") - F.col("_t0")) / 1_000_000)
    rows = rows.withColumn("id_diversity", F.col("unique_can_ids") / F.col("total_messages")).withColumn("global_message_rate", F.when(F.col("runtime_seconds") > 0, F.col("total_messages") / F.col("runtime_seconds")).otherwise(0.0))
    return rows.drop("_first", "_t0")


#: The published order of the base features.
BASE_FEATURES = (
    "can_id", "dlc", "is_extended", "is_remote", "is_error", "data_byte_0", "data_byte_1", "data_byte_2", "data_byte_3", "data_byte_4", "data_byte_5", "data_byte_6", "data_byte_7",
    "data_mean", "data_median", "data_std", "data_min", "data_max", "data_range", "data_sum", "data_entropy", "zero_bytes", "max_bytes",
    "freq_last_1s", "freq_last_5s", "freq_last_10s", "freq_last_30s", "interval_mean", "interval_std", "interval_min", "interval_max", "interval_jitter",
    "pattern_repetition", "sequential_pattern", "alternating_pattern", "ascending_bytes", "descending_bytes", "dlc_consistency", "data_change_rate", "payload_variance",
    "total_messages", "unique_can_ids", "id_diversity", "runtime_seconds", "global_message_rate", "can_id_normalized", "estimated_priority",
)


def base47(frames: DataFrame, busy: hot.Busy | None = None) -> DataFrame:
    """bus, seq and the base features, all doubles, in the published order."""
    busy = busy or hot.busy(frames)
    rows = communication(kept(behavior(interval_stats(rates(frames, busy), busy), busy), "base"))
    rows = rows.withColumn("_s", P.stats("data")).withColumn("_p", P.patterns("data")).withColumn("_i", FR.id_priority())
    have = {
        "data_mean": "_s.mean", "data_median": "_s.median", "data_std": "_s.std", "data_min": "_s.min", "data_max": "_s.max", "data_range": "_s.range", "data_sum": "_s.sum", "zero_bytes": "_s.zeros", "max_bytes": "_s.ones",
        "can_id_normalized": "_i.normalized", "estimated_priority": "_i.priority",
    }
    cols = {c: F.col(have.get(c, c)) for c in BASE_FEATURES if c in have or c in rows.columns}
    cols |= {c: F.col(f"_p.{c}") for c in ("pattern_repetition", "sequential_pattern", "alternating_pattern", "ascending_bytes", "descending_bytes")}
    cols |= {f"data_byte_{i}": c for i, c in enumerate(P.byte_columns("data"))} | {"data_entropy": P.entropy("data")}
    return rows.select("bus", "seq", *(F.coalesce(cols[c].cast("double"), F.lit(0.0)).alias(c) for c in BASE_FEATURES))


def unknown_ngrams(frames: DataFrame, bigrams: DataFrame, trigrams: DataFrame, direction: str = "backward") -> DataFrame:
    """Adds unknown_bigram and unknown_trigram: 1 where the ids up to (or from) this frame were not learned. Learned n-grams are joined by their key."""
    sign = 1 if direction == "backward" else -1
    rows, w = W.bus_blocks(frames, 2) if sign == 1 else (frames.withColumn("_native", F.lit(1)).withColumn("_block", F.lit(0)), W.by_bus())
    step = (lambda i: F.lag("can_id", i).over(w)) if sign == 1 else (lambda i: F.lead("can_id", i).over(w))
    two = F.array(step(1), "can_id") if sign == 1 else F.array("can_id", step(1))
    three = F.array(step(2), step(1), "can_id") if sign == 1 else F.array("can_id", step(1), step(2))
    rows = rows.withColumn("_2", two).withColumn("_3", three).filter("_native = 1")
    for key, known, out in (("_2", bigrams, "unknown_bigram"), ("_3", trigrams, "unknown_trigram")):
        rows = rows.join(known.select(F.col("gram").alias(key), F.lit(1).alias("_known")), key, "left").withColumn(out, F.when(F.exists(key, lambda x: x.isNull()) | F.col("_known").isNotNull(), 0).otherwise(1)).drop("_known", key)
    return rows.drop("_native", "_block", "_rn")


def enhanced8(frames: DataFrame, iat: DataFrame, bigrams: DataFrame, trigrams: DataFrame) -> DataFrame:
    """Adds payload_entropy, hamming_distance, iat_zscore, unknown_bigram, unknown_trigram, bit_time_mean, bit_time_rms, bit_time_energy."""
    busy = hot.busy(frames)
    rows = C.with_hamming(C.with_delta(frames, busy=busy), busy=busy).withColumnRenamed("hamming", "hamming_distance").withColumn("payload_entropy", P.entropy("data")).withColumn("_b", FR.bit_time("time_delta"))
    rows = rows.join(iat.select("bus", "can_id", "iat_mean", "iat_std"), ["bus", "can_id"], "left")
    z = F.when((F.col("iat_std") > 0) & (F.col("time_delta") > 0), (F.col("time_delta") - F.col("iat_mean")) / F.col("iat_std")).otherwise(0.0)
    rows = rows.withColumn("iat_zscore", z).withColumns({f"bit_time_{k}": F.col(f"_b.{k}") for k in ("mean", "rms", "energy")}).drop("_b", "iat_mean", "iat_std")
    return unknown_ngrams(rows, bigrams, trigrams)


def byte_entropy(lists: pa.Array) -> pa.Array:
    """Shannon entropy of each list of bytes in bits, as ``payload.entropy`` has it: 0 of an empty list, null of null and where an entry is null. Equal bytes meet by one sort."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values, row = lists.flatten(), np.repeat(np.arange(len(n)), n)
    unknown = lists.is_null().to_numpy(zero_copy_only=False).copy()
    if values.null_count:
        unknown[row[values.is_null().to_numpy(zero_copy_only=False)]] = True
    key = row << 32 | (values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) & 0xFFFFFFFF)
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=-1))
    of = key[first] >> 32
    share = np.diff(np.append(first, len(key))) / n[of]
    return pa.array(np.bincount(of, -share * np.log2(share), len(n)), mask=unknown)


_entropy = F.arrow_udf(byte_entropy, DoubleType())


def ml23(frames: DataFrame, busy: hot.Busy | None = None) -> DataFrame:
    """bus, seq, n (frames of the id so far) and 23 features: bytes, payload statistics (population sd), 10 s rate, last 50 intervals, entropy of the last 5 frames' bytes, dlc sd over 10."""
    busy = busy or hot.busy(frames)
    rows, keys = busy.time_back(frames, 10_000_000)
    rows = busy.whole(rows.withColumn("rate_10s", _trailing(keys, 10_000_000) / 10))
    rows, w = busy.rows_back(rows, 50, "n")
    rows = rows.withColumn("_i", (F.col("ts_us") - F.lag("ts_us").over(w)) / 1000)
    w50 = _back(w, 50)
    rows = rows.withColumns({
        "interval_ms": F.coalesce("_i", F.lit(0.0)), "interval_mean": F.coalesce(F.avg("_i").over(w50), F.lit(0.0)), "interval_std": F.coalesce(F.stddev_pop("_i").over(w50), F.lit(0.0)),
        "interval_min": F.coalesce(F.min("_i").over(w50), F.lit(0.0)), "interval_max": F.coalesce(F.max("_i").over(w50), F.lit(0.0)),
        "_recent": F.flatten(F.collect_list("data").over(_back(w, 5))), "dlc_std": F.coalesce(F.stddev_pop("dlc").over(_back(w, 10)), F.lit(0.0)),
    })
    rows = busy.whole(rows).withColumn("_s", P.stats("data"))
    size = F.size("data")
    pop = F.when(size > 1, F.col("_s.std") * F.sqrt((size - 1) / size)).otherwise(0.0)
    return rows.select(
        "bus", "seq", "n", "can_id", "dlc", *P.byte_columns("data"), F.col("_s.mean").alias("data_mean"), pop.alias("data_std"), F.col("_s.min").alias("data_min"), F.col("_s.max").alias("data_max"),
        _entropy("data").alias("data_entropy"), "rate_10s", "interval_ms", "interval_mean", "interval_std", "interval_min", "interval_max", _entropy("_recent").alias("recent_entropy"), "dlc_std",
    )


def id_frequency(frames: DataFrame, mode: str = "rate", busy: hot.Busy | None = None) -> DataFrame:
    """Adds id_frequency: ``rate`` frames a second since the oldest of the last minute; ``share`` of the bus's frames in the last second; ``count`` of all the id's frames."""
    if mode == "count":
        return (busy or hot.busy(frames)).by_id(frames, {"id_frequency": F.count(F.lit(1))}).withColumn("id_frequency", F.col("id_frequency").cast("double"))
    if mode == "share":
        total = W.trailing_count(frames, 1_000_000, "_all")
        own = W.trailing_count(total, 1_000_000, "_own", ("bus", "can_id"))
        return own.withColumn("id_frequency", F.col("_own") / F.col("_all")).drop("_own", "_all")
    busy = busy or hot.busy(frames)
    rows, keys = busy.time_back(frames, 60_000_000)
    w = Window.partitionBy(*keys).orderBy("ts_us")
    # The oldest frame follows the last one that is too old: frames of windows that only grow, where a sliding range is read anew for each row.
    rows = rows.withColumn("_next", F.lead("ts_us").over(Window.partitionBy(*keys).orderBy(*W.ORDER)))
    oldest = F.coalesce(F.max("_next").over(w.rangeBetween(Window.unboundedPreceding, -60_000_001)), F.min("ts_us").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    span = (F.col("ts_us") - oldest) / 1_000_000
    return busy.whole(rows.withColumn("id_frequency", F.when(span > 0, _trailing(keys, 60_000_000) / span).otherwise(0.0)).drop("_next"))


def basic9(frames: DataFrame, busy: hot.Busy | None = None) -> DataFrame:
    """bus, seq and the basic nine; means and deviations over the last 50 frames."""
    busy = busy or hot.busy(frames)
    rows, by = busy.rows_back(id_frequency(C.with_delta(frames, busy=busy), busy=busy), 50)
    w = _back(by, 50)
    rows = busy.whole(rows.withColumns({"id_mean_time_delta": F.avg("time_delta").over(w), "id_std_time_delta": F.coalesce(F.stddev_samp("time_delta").over(w), F.lit(0.0))}))
    return rows.select("bus", "seq", F.col("can_id").alias("arb_id_numeric"), F.col("dlc").alias("data_length"), "id_frequency", "time_delta", "id_mean_time_delta", "id_std_time_delta", *FR.calendar())


def tree12(frames: DataFrame, busy: hot.Busy | None = None) -> DataFrame:
    """bus, seq, eight bytes, dlc, interval_ms, frequency over the last 100 frames, quick entropy."""
    busy = busy or hot.busy(frames)
    rows, by = busy.rows_back(frames, 100)
    w = _back(by, 100)
    rows = busy.whole(rows.withColumns({"_i": (F.col("ts_us") - F.lag("ts_us").over(by)) / 1000, "_f": F.first("ts_us").over(w), "_n": F.count(F.lit(1)).over(w)}))
    span = (F.col("ts_us") - F.col("_f")) / 1_000_000
    return rows.select("bus", "seq", *P.byte_columns("data"), "dlc", F.coalesce("_i", F.lit(0.0)).alias("interval_ms"), F.when(span > 0, F.col("_n") / span).otherwise(0.0).alias("frequency"), P.entropy_fast("data").alias("entropy"))


def deviation(frames: DataFrame, frequency: DataFrame, payload: DataFrame, timing: DataFrame) -> DataFrame:
    """Adds freq_deviation, iat_deviation, entropy_anomaly, dlc_anomaly, periodicity_score, timing_irregularity; 0 for unknown ids. Needs id_frequency and time_delta."""
    keys = ["bus", "can_id"]
    rows = frames.withColumn("_e", P.entropy("data")).join(frequency.select(*keys, "frequency", "mean_iat"), keys, "left").join(payload, keys, "left").join(timing, keys, "left")
    off = lambda have, want: F.coalesce(F.abs(F.col(have) - F.col(want)) / (F.col(want) + 1e-6), F.lit(0.0))
    return rows.withColumns({
        "freq_deviation": off("id_frequency", "frequency"), "iat_deviation": off("time_delta", "mean_iat"),
        "entropy_anomaly": F.when(F.col("entropy_std") > 0, F.abs(F.col("_e") - F.col("entropy_mean")) / F.col("entropy_std")).otherwise(0.0),
        "dlc_anomaly": F.coalesce(F.abs(F.col("dlc") - F.col("common_dlc")), F.lit(0)).cast("double"),
        "periodicity_score": F.coalesce("periodicity_score", F.lit(0.0)), "timing_irregularity": F.coalesce("regularity_cv", F.lit(0.0)),
    }).drop("_e", "frequency", "mean_iat", "entropy_mean", "entropy_std", "dlc_variance", "common_dlc", "regularity_cv")


def burst(frames: DataFrame, threshold_s: float = 0.001, delta: str = "time_delta") -> DataFrame:
    """Adds burst_size (run of frames of the bus with ``delta`` under the threshold, starting at 1) and is_burst (over 3).

    Runs are numbered within slabs; a slab's first run goes on from the run its predecessors end in.
    """
    rows = frames.withColumn("_new", F.when(F.col(delta) < threshold_s, 0).otherwise(1))
    numbered = W.running_sum(W.running_sum(rows, F.col("_new"), "_run"), F.lit(1), "_rn")
    starts = numbered.filter("_new = 1").select("bus", "_run", F.col("_rn").alias("_at"))
    joined = numbered.join(starts, ["bus", "_run"], "left")
    size = F.col("_rn") - F.coalesce("_at", F.lit(0)) + 1
    return joined.withColumn("burst_size", size).withColumn("is_burst", (F.col("burst_size") > 3).cast("int")).drop("_new", "_run", "_rn", "_at")


def sequence_novelty(frames: DataFrame, grams: DataFrame, n: int = 3) -> DataFrame:
    """Adds sequence_novelty: 1 / (1 + count) of the known n-gram ending here, 1 for an unknown one, 0 for the first n - 1 frames. ``grams``: top 100 or so, broadcast."""
    rows, w = W.bus_blocks(frames, n - 1)
    gram = F.array(*(F.lag("can_id", i).over(w) for i in range(n - 1, 0, -1)), F.col("can_id"))
    rows = rows.withColumn("gram", gram).filter("_native = 1").join(F.broadcast(grams.select("gram", F.col("n").alias("_n"))), "gram", "left")
    whole = ~F.exists("gram", lambda x: x.isNull())
    return rows.withColumn("sequence_novelty", F.when(whole, 1.0 / (1.0 + F.coalesce("_n", F.lit(0)))).otherwise(0.0)).drop("gram", "_n", "_native", "_block", "_rn")


def rolling(frames: DataFrame, n: int = 100) -> DataFrame:
    """Adds the mean and sample sd of time_delta and id_frequency over the bus's last ``n`` frames; over all of them where it has fewer (frequency: the value itself and 0)."""
    blocks, b = W.bus_blocks(frames, n - 1)
    w = b.rowsBetween(-(n - 1), 0)
    rows = blocks.withColumns({"_tm": F.avg("time_delta").over(w), "_ts": F.coalesce(F.stddev_samp("time_delta").over(w), F.lit(0.0)), "_fm": F.avg("id_frequency").over(w), "_fs": F.coalesce(F.stddev_samp("id_frequency").over(w), F.lit(0.0))}).filter("_native = 1")
    whole = frames.groupBy("bus").agg(F.count("*").alias("_n"), F.avg("time_delta").alias("_am"), F.coalesce(F.stddev_samp("time_delta"), F.lit(0.0)).alias("_as"))
    rows = W.null_safe(rows, whole, ["bus"])
    long = F.col("_n") >= n
    rows = rows.withColumns({
        "time_delta_rolling_mean": F.when(long, F.col("_tm")).otherwise(F.col("_am")), "time_delta_rolling_std": F.when(long, F.col("_ts")).otherwise(F.col("_as")),
        "freq_rolling_mean": F.when(long, F.col("_fm")).otherwise(F.col("id_frequency")), "freq_rolling_std": F.when(long, F.col("_fs")).otherwise(0.0),
    })
    return rows.drop("_tm", "_ts", "_fm", "_fs", "_am", "_as", "_n", "_native", "_block", "_rn")


def enhanced13(frames: DataFrame, normal: DataFrame) -> DataFrame:
    """Deviation, burst, novelty and rolling features in one table, calibrated on ``normal``. Steps that read their input more than once get it from a written table."""
    busy = hot.busy(frames)
    rows = id_frequency(C.with_delta(frames, busy=busy), busy=busy)
    rows = kept(deviation(rows, C.frequency_profile(normal), C.payload_profile(normal), C.timing_profile(normal)), "deviation")
    rows = kept(sequence_novelty(kept(burst(rows), "burst"), C.ngrams(normal, 3, 100)), "novelty")
    return rolling(rows)


def lags(df: DataFrame, columns: list[str], n: int = 3, busy: hot.Busy | None = None) -> DataFrame:
    """Adds {c}_lag1..n of the id's earlier frames, 0 where there is none."""
    busy = busy or hot.busy(df)
    rows, w = busy.rows_back(df, n)
    return busy.whole(rows.withColumns({f"{c}_lag{k}": F.lag(c, k, 0).over(w) for c in columns for k in range(1, n + 1)}))
