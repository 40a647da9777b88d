"""The monitor as Structured Streaming: frames in, state per id, rules, windows, alerts out.

Event time is ``ts``; frames older than the watermark are late: Spark drops them
before windows and event-time state, and ``LateFrames`` counts them. Of the others, those of an
id that are in one batch are taken in order of time, those of later batches after them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from framewatch.functions import payload as P
from framewatch.functions.frames import diagnostic_source
from framewatch.operators import apart
from framewatch.operators import rules as R
from framewatch.schema import FRAME_SCHEMA
from framewatch.storage import fresh
from framewatch.streaming.state import ENRICHED, IdState, use_state_store

LATENESS = "5 seconds"


def read_frames(spark: SparkSession, path: str, format: str = "parquet", lateness: str = LATENESS, per_batch: int | None = None) -> DataFrame:
    """A stream of frames from files as they arrive: Parquet in the frame schema, or candump text; with a watermark on ``ts``."""
    reader = spark.readStream
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    if format == "parquet":
        frames = reader.schema(FRAME_SCHEMA).parquet(path)
    elif format == "candump":
        line = reader.text(path)
        pattern = r"^\s*\((\d+(?:\.\d+)?)\)\s+(\S+)\s+([0-9A-Fa-f]+)#(R|[0-9A-Fa-f]*)\s*$"
        get = lambda i: F.regexp_extract("value", pattern, i)
        rows = line.filter(F.col("value").rlike(pattern)).select(F.round(get(1).cast("decimal(20,6)") * 1_000_000).cast("long").alias("ts_us"), get(2).alias("bus"), F.conv(get(3), 16, 10).cast("int").alias("can_id"), F.when(get(4) == "R", F.expr("cast(array() as array<int>)")).otherwise(P.hex_to_bytes(get(4))).alias("data"), (get(4) == "R").alias("is_remote"))
        frames = rows.select(F.col("ts_us").alias("seq"), "ts_us", F.timestamp_micros("ts_us").alias("ts"), "bus", "can_id", F.size("data").alias("dlc"), "data", (F.col("can_id") > 0x7FF).alias("is_extended"), "is_remote", F.lit(False).alias("is_error"), *(F.lit(None).cast(FRAME_SCHEMA[c].dataType).alias(c) for c in ("source_id", "attack", "attack_type", "vehicle", "source_file")))
    else:
        raise ValueError(f"unknown format: {format}")
    return with_watermark(frames, lateness)


def with_watermark(frames: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Adds ``ts`` from ts_us if need be, and the watermark: frames later than this are dropped (``count_late`` counts them)."""
    return (frames if "ts" in frames.columns else frames.withColumn("ts", F.timestamp_micros("ts_us"))).withWatermark("ts", lateness)


def limits(rules: DataFrame) -> tuple[list[int], int]:
    """The distinct frame limits of frequency rules, and the most intervals that a timing rule looks at (0: there is none)."""
    known = rules.select("max_frequency", "consecutive_required", "check_timing").collect()
    return sorted({r.max_frequency for r in known if r.max_frequency}), max([0, *((r.consecutive_required or 5) + 2 for r in known if r.check_timing)])


def enrich(frames: DataFrame, rules: DataFrame, memory_us: int | None = None, drop_late: bool = False) -> DataFrame:
    """The columns that the stateful checks of ``rules`` read, as ``rules.add_state`` (with the same ``memory_us``) has them in batch.

    State is kept for each bus and id by ``state.IdState``: it doesn't depend on how
    frames fall into batches, nor on a restart from the checkpoint. Without
    ``memory_us`` it grows with the distinct payloads of an id, as nothing is
    forgotten; with it, payloads not seen for longer are new again, here and in batch.
    ``_backs``: for each distinct frame limit, the time of the frame so many back (this one counted).
    With ``drop_late`` (and with ``memory_us``, which needs event time) frames behind the
    watermark are dropped and counted; Spark's watermark begins at the epoch, so that
    frames of time 0 and before are, too. Else all frames count, as they come.
    """
    counts, history = limits(rules)
    replay = not rules.filter("check_replay").isEmpty()
    use_state_store(frames.sparkSession)
    rows = frames.select("ts", "bus", "seq", "ts_us", "can_id", "dlc", "data", "is_extended", "is_remote", "is_error", P.bytes_to_hex("data", "").alias("payload"), F.try_element_at("data", F.lit(1)).bitwiseAND(F.lit(15)).alias("nibble"), diagnostic_source().alias("source"))
    return rows.groupBy("bus", "can_id").transformWithStateInPandas(IdState(counts, history, replay, memory_us), ENRICHED, "append", "eventTime" if drop_late or memory_us is not None else "none")


def detect_rules(enriched: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule hits on enriched frames (as ``rules.evaluate`` finds them, global rate rules aside: see ``global_rate``)."""
    known = rules.orderBy("rule_no").collect()
    counts, _ = limits(rules)
    hits: list[Column] = []
    for r in known:
        p = R.literal(r)
        scope = F.col("can_id") == r.can_id if r.can_id is not None else F.col("can_id").between(*r.can_id_range) if r.can_id_range else ~F.col("can_id").isin(*r.allowed_can_ids) if r.whitelist_mode and r.allowed_can_ids else F.lit(True)
        n = r.max_frequency
        frequency = F.coalesce(F.col("ts_us") - F.get("_backs", F.lit(counts.index(n))) <= (r.time_window or 1.0) * 1_000_000, F.lit(False)) if n else F.lit(False)
        hits.append(F.when(scope & R.fired(p, F.lit(False), frequency, R.sets(r)), F.struct(F.lit(r.rule_no).alias("rule_no"), p("name").alias("rule_name"), p("severity").alias("severity"), p("priority").alias("priority"), p("description").alias("description"), p("action").alias("action"), R.confidence(p).alias("confidence"), F.lit(r.can_id is None).alias("is_global"))))
    return enriched.withColumn("h", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull()))).select("bus", "seq", "ts_us", "can_id", "dlc", "data", "h.*")


def prefilter(frames: DataFrame, expected: DataFrame, tolerance: float = 0.3) -> DataFrame:
    """bus, seq, suspicious: as ``detect.prefilter``, with the id's last time and expected interval as state. ``expected`` (bus, can_id, expected in s) is joined to the stream."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, want = state.get if state.exists else (None, None)
        batch = pd.concat(list(parts), ignore_index=True).sort_values(["ts_us", "seq"], kind="stable")
        learned = batch["expected"].iloc[0]
        known = not pd.isna(learned)
        want = float(learned) if known else want
        flags = []
        for t in batch["ts_us"].tolist():
            gap = None if last is None else (t - last) / 1_000_000
            if want is None and gap is not None:
                want = gap
            flags.append(int(not known or (gap is not None and abs(gap - want) > tolerance * want)))
            last = t
        state.update((last, want))
        yield pd.DataFrame({"bus": batch["bus"], "seq": batch["seq"], "suspicious": flags})

    joined = frames.select("bus", "can_id", "ts_us", "seq").join(expected.select("bus", "can_id", "expected"), ["bus", "can_id"], "left")
    return joined.groupBy("bus", "can_id").applyInPandasWithState(run, "bus string, seq long, suspicious int", "last long, want double", "append", GroupStateTimeout.NoTimeout)


def global_rate(frames: DataFrame, limit: int, window: str = "1 second", slide: str = "100 milliseconds") -> DataFrame:
    """Sliding windows of a bus with more than ``limit`` frames."""
    counts = frames.groupBy("bus", F.window("ts", window, slide)).agg(F.count("*").alias("frames"))
    return counts.filter(F.col("frames") > limit).select("bus", F.unix_micros("window.start").alias("start_us"), "frames")


def dos_window(frames: DataFrame, limit: int = 100, window: str = "100 milliseconds") -> DataFrame:
    """Tumbling windows of an id with more than ``limit`` frames."""
    counts = frames.groupBy("bus", "can_id", F.window("ts", window)).agg(F.count("*").alias("frames"))
    return counts.filter(F.col("frames") > limit).select("bus", "can_id", F.unix_micros("window.start").alias("start_us"), "frames")


def bursts(frames: DataFrame, gap: str = "1 millisecond", least: int = 4) -> DataFrame:
    """Bursts of a bus: runs of ``least`` frames or more with less than ``gap`` between them."""
    found = frames.groupBy("bus", F.session_window("ts", gap)).agg(F.count("*").alias("frames"))
    return found.filter(F.col("frames") >= least).select("bus", F.unix_micros("session_window.start").alias("start_us"), "frames")


def dedup_alerts(alerts: DataFrame, window_s: int = 60) -> DataFrame:
    """One alert per bus, rule, id and severity in ``window_s`` since the last kept one; state goes when event time has passed it. Needs a watermark on ``ts``."""
    width = window_s * 1_000_000

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else apart.NEVER
        batch = pd.concat(list(parts), ignore_index=True).sort_values(["ts_us", "seq"], kind="stable")
        times = batch["ts_us"].to_numpy()
        keep = apart.keep_apart(times, width, last)
        last = int(times[keep[-1]]) if len(keep) else last
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + window_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield batch.iloc[keep][["bus", "rule_name", "can_id", "severity", "ts_us", "seq"]]

    keys = ["bus", "rule_name", "can_id", "severity"]
    return alerts.select(*keys, "ts_us", "seq", "ts").groupBy(*keys).applyInPandasWithState(run, "bus string, rule_name string, can_id int, severity string, ts_us long, seq long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def traffic_monitor(frames: DataFrame, window: str = "10 seconds") -> DataFrame:
    """Messages, distinct ids (approximate) and rate of each bus by window."""
    out = frames.groupBy("bus", F.window("ts", window)).agg(F.count("*").alias("messages"), F.approx_count_distinct("can_id").alias("ids"))
    seconds = (F.unix_micros("window.end") - F.unix_micros("window.start")) / 1_000_000
    return out.select("bus", F.unix_micros("window.start").alias("start_us"), "messages", "ids", (F.col("messages") / seconds).alias("rate"))


def write_alerts(alerts: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """JSON lines, exactly once by the checkpoint; ``once`` takes what is there and ends."""
    writer = alerts.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


class LateFrames(StreamingQueryListener):
    """Counts the rows that each query's operators dropped for being later than the watermark, over all batches.

    Rows are frames where nothing is aggregated before state (``enrich``, ``prefilter``,
    ``dedup_alerts``); before windows Spark has summed the frames of a task, and counts these sums.
    """

    def __init__(self):
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped[str(event.id)] = 0

    def onQueryProgress(self, event) -> None:
        name = str(event.progress.id)
        self.dropped[name] = self.dropped.get(name, 0) + sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def count_late(stream: DataFrame, name: str = "late") -> tuple[DataFrame, int]:
    """Runs a stream as ``drain`` does; its rows, and how many input rows were late."""
    spark, listener = stream.sparkSession, LateFrames()
    spark.streams.addListener(listener)
    try:
        rows = drain(stream, name)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return rows, sum(listener.dropped.values())
    finally:
        spark.streams.removeListener(listener)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what its source has, into a table in the shared folder, and returns the table.

    Each batch has a folder of its own, overwritten if the batch is run again. In
    ``update`` mode rows come with ``_batch``, the number of their batch, the last of which hold.
    """
    spark = stream.sparkSession
    path, checkpoint = fresh(spark, name), fresh(spark, f"{name}-checkpoint")
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/batch=-1")
    put = lambda df, number: df.write.mode("overwrite").parquet(f"{path}/batch={number}")
    stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    rows = spark.read.schema(StructType(list(stream.schema.fields)).add("batch", "long")).parquet(path)
    return rows.withColumnRenamed("batch", "_batch") if mode == "update" else rows.drop("batch")
