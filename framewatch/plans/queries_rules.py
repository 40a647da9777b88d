"""Queries: payload and frame expressions, rule checks, evaluation, baseline. Each with the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewatch.functions import frames as FR
from framewatch.functions import payload as P
from framewatch.operators import baseline as B
from framewatch.operators import rules as R
from framewatch.operators.calibrate import with_delta, with_hamming
from framewatch.plans.demo import FRAMES_SQL, frames
from framewatch.plans.registry import query

WIN = " WINDOW w AS (PARTITION BY bus, can_id ORDER BY ts_us, seq)"
ENTROPY = "coalesce(-list_sum(list_transform(list_distinct({d}), lambda x: (len(list_filter({d}, lambda y: y = x)) / len({d})) * log2(len(list_filter({d}, lambda y: y = x)) / len({d})))), 0)"
PAD = "[coalesce(data[1], 0), coalesce(data[2], 0), coalesce(data[3], 0), coalesce(data[4], 0), coalesce(data[5], 0), coalesce(data[6], 0), coalesce(data[7], 0), coalesce(data[8], 0)]"
XOR = "list_reduce(list_prepend(0, data), lambda a, x: xor(a, x))"
HEX = "array_to_string(list_transform(data, lambda x: lpad(hex(x), 2, '0')), '{s}')"


def r6(c: Column, name: str) -> Column:
    return F.round(c.cast("double"), 6).alias(name)


def per_frame(name: str, sql: str, columns: Callable[[], list[Column]]) -> None:
    """A query of expressions over each frame: seq and the columns; ``sql`` is what DuckDB selects beside seq."""

    @query(name, f"{FRAMES_SQL} SELECT seq, {sql} FROM frames")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return frames(spark, sf_dir).select("seq", *columns())


def joined(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


per_frame("P1_hex_to_bytes", "array_to_string(data, ',') AS bytes", lambda: [joined(P.hex_to_bytes(P.bytes_to_hex("data"))).alias("bytes")])
per_frame("P2_bytes_to_hex", HEX.format(s=" ") + " AS hexed", lambda: [P.bytes_to_hex("data").alias("hexed")])
per_frame("P3_byte_columns", ", ".join(f"coalesce(data[{i + 1}], 0) AS data_byte_{i}" for i in range(8)), lambda: [*P.byte_columns("data")])
per_frame("P4_entropy", f"round({ENTROPY.format(d='data')}, 6) AS entropy", lambda: [r6(P.entropy("data"), "entropy")])
per_frame("P5_entropy_fast", f"round(len(list_distinct({PAD})) / 8 * 2.5, 6) AS entropy", lambda: [r6(P.entropy_fast("data"), "entropy")])
per_frame(
    "P6_stats",
    "round(list_avg(data), 6) AS mean, round(list_median(data), 6) AS median, round(coalesce(list_stddev_samp(data), 0), 6) AS std, CAST(list_min(data) AS DOUBLE) AS low, CAST(list_max(data) AS DOUBLE) AS high, CAST(list_max(data) - list_min(data) AS DOUBLE) AS span, CAST(list_sum(data) AS DOUBLE) AS total, CAST(len(list_filter(data, lambda x: x = 0)) AS DOUBLE) AS zeros, CAST(len(list_filter(data, lambda x: x = 255)) AS DOUBLE) AS ones",
    lambda: [r6(P.stats("data")["mean"], "mean"), r6(P.stats("data")["median"], "median"), r6(P.stats("data")["std"], "std"), P.stats("data")["min"].alias("low"), P.stats("data")["max"].alias("high"), P.stats("data")["range"].alias("span"), P.stats("data")["sum"].alias("total"), P.stats("data")["zeros"].alias("zeros"), P.stats("data")["ones"].alias("ones")],
)
_steps = "list_transform(range(1, len(data)), lambda i: data[i + 1] - data[i])"
per_frame(
    "P7_patterns",
    f"round(len(list_filter({_steps}, lambda s: s = 0)) / (len(data) - 1), 6) AS repetition, CAST(len(list_filter({_steps}, lambda s: s < 0)) = 0 OR len(list_filter({_steps}, lambda s: s > 0)) = 0 AS INT) AS monotone, round(len(list_filter(range(1, len(data) - 2), lambda i: data[i] = data[i + 2] AND data[i + 1] = data[i + 3])) / (len(data) - 3), 6) AS alternating, round(len(list_filter({_steps}, lambda s: s = 1)) / (len(data) - 1), 6) AS up, round(len(list_filter({_steps}, lambda s: s = -1)) / (len(data) - 1), 6) AS down",
    lambda: [r6(P.patterns("data")["pattern_repetition"], "repetition"), P.patterns("data")["sequential_pattern"].cast("int").alias("monotone"), r6(P.patterns("data")["alternating_pattern"], "alternating"), r6(P.patterns("data")["ascending_bytes"], "up"), r6(P.patterns("data")["descending_bytes"], "down")],
)
per_frame(
    "P8_constant_payload", "len(list_filter(data, lambda x: x <> 0)) = 0 AS zeros, len(list_filter(data, lambda x: x <> 255)) = 0 AS ones, len(list_filter(range(1, len(data) + 1), lambda i: data[i] <> (data[1] + i - 1) % 256)) = 0 AS counting",
    lambda: [P.is_all_zeros("data").alias("zeros"), P.is_all_ones("data").alias("ones"), P.is_sequential("data").alias("counting")],
)
per_frame("P10_xor_checksum", f"{XOR} = 0 AS ok", lambda: [P.xor_checksum_ok("data").alias("ok")])
per_frame("P11_steering_angle", "round((CASE WHEN data[1] + 256 * data[2] >= 32768 THEN data[1] + 256 * data[2] - 65536 ELSE data[1] + 256 * data[2] END) * 0.1, 6) AS angle", lambda: [r6(P.steering_angle("data"), "angle")])
per_frame("P12_matches_pattern", "data[1] = 170 AND len(data) >= 3 AND data[3] = 170 AS ok", lambda: [P.matches_pattern("data", F.lit("AA * AA")).alias("ok")])
per_frame("P13_contains_any", f"contains({HEX.format(s=' ')}, 'AA AA') OR contains({HEX.format(s=' ')}, 'FF') AS ok", lambda: [P.contains_any("data", F.array(F.lit("aa aa"), F.lit("FF"))).alias("ok")])
per_frame("P15_id_priority", "round(can_id / 2047, 6) AS normalized, round(1 - can_id / 2047, 6) AS priority", lambda: [r6(FR.id_priority()["normalized"], "normalized"), r6(FR.id_priority()["priority"], "priority")])
per_frame("P16_calendar", "CAST(ts_us // 3600000000 % 24 AS INT) AS hour, CAST(ts_us // 60000000 % 60 AS INT) AS minute, CAST(ts_us // 1000000 % 60 AS INT) AS second", lambda: [*FR.calendar()])
per_frame("P18_diagnostic_source", "CAST(CASE WHEN can_id = 2015 OR can_id BETWEEN 2016 AND 2031 THEN coalesce(source_id, can_id & 15) END AS INT) AS source", lambda: [FR.diagnostic_source().alias("source")])


@query("P9_hamming", f"{FRAMES_SQL}, p AS (SELECT *, lag(data) OVER w AS before FROM frames{WIN}) SELECT seq, CAST(CASE WHEN before IS NULL THEN 0 ELSE list_sum(list_transform(range(1, 9), lambda i: bit_count(xor(coalesce(data[i], 0), coalesce(before[i], 0))))) END AS INT) AS bits FROM p")
def _p9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_hamming(frames(spark, sf_dir)).select("seq", F.col("hamming").alias("bits"))


@query("P14_bit_time", f"{FRAMES_SQL}, p AS (SELECT seq, coalesce((ts_us - lag(ts_us) OVER w) / 1000000, 0) AS t FROM frames{WIN}) SELECT seq, round(t / 108, 9) AS mean, round(t / 108, 9) AS rms, round(t / 108 * t / 108, 9) AS energy FROM p")
def _p14(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = FR.bit_time("time_delta")
    return with_delta(frames(spark, sf_dir)).select("seq", *(F.round(b[k], 9).alias(k) for k in ("mean", "rms", "energy")))


@query("P17_time_range_by_id", f"{FRAMES_SQL} SELECT seq, can_id, ts_us FROM frames WHERE ts_us BETWEEN 1000000 AND 60000000 AND can_id = 261")
def _p17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FR.by_id(FR.time_range(frames(spark, sf_dir), 1_000_000, 60_000_000), 261).select("seq", "can_id", "ts_us")


# --- single checks --------------------------------------------------------------


def check(name: str, sql: str, violated: Callable[[], Column]) -> None:
    per_frame(name, f"{sql} AS violated", lambda: [violated().alias("violated")])


check("R2_check_id_range", "can_id < 260 OR can_id > 1000", lambda: R.check_id_range(260, 1000))
check("R3_check_payload_pattern", "len(list_filter(data, lambda x: x <> 255)) = 0 OR len(list_filter(range(1, len(data) + 1), lambda i: data[i] <> (data[1] + i - 1) % 256)) = 0", lambda: R.check_payload_pattern(["all_ones", "sequential"]))
check("R4_check_known_ids", "can_id NOT IN (256, 257, 258, 259, 260, 270)", lambda: R.check_known_ids([256, 257, 258, 259, 260, 270]))
check("R5_check_dlc_by_id", "(can_id = 256 AND dlc <> 8) OR (can_id = 257 AND dlc <> 4)", lambda: R.check_dlc_by_id({256: 8, 257: 4}))
check("R6_check_entropy", f"{ENTROPY.format(d='data')} > 2.7", lambda: R.check_entropy(2.7))
check("R7_check_byte_ranges", "can_id = 261 AND (data[1] > 100 OR coalesce(data[8] < 20, false))", lambda: R.check_byte_ranges({261: {0: [0, 100], 7: [20, 255]}}))
check("R8_validate_dlc", "dlc NOT BETWEEN 0 AND 8 OR dlc <> len(data) OR dlc < 6", lambda: R.validate_dlc(6))
check("R9_dlc_bounds", "dlc < 5 OR dlc > 8", lambda: R.dlc_bounds(5, 8))
check("R10_check_frame_format", "can_id > 2047 OR dlc NOT BETWEEN 0 AND 8 OR len(data) <> dlc OR is_error OR (is_remote AND len(data) > 0)", lambda: R.check_frame_format())
check("R11_check_data_bytes", "data[1] <> 170 OR coalesce(data[6] <> 170, true)", lambda: R.check_data_bytes(170, None, None, None, None, 170))
check("R12_check_integrity", f"{XOR} <> 0", lambda: R.check_integrity())
check("R13_check_steering", "(CASE WHEN data[1] + 256 * data[2] >= 32768 THEN data[1] + 256 * data[2] - 65536 ELSE data[1] + 256 * data[2] END) * 0.1 NOT BETWEEN -540.05 AND 1540.05", lambda: R.check_steering(-540.05, 1540.05))
check("R14_check_frame_type", "NOT is_extended", lambda: R.check_frame_type("extended"))

STATE_SQL = f"""{FRAMES_SQL}, s1 AS (SELECT *, {HEX.format(s="")} AS payload, row_number() OVER w AS n, (ts_us - lag(ts_us) OVER w) / 1000 AS interval_ms, data[1] & 15 AS nibble,
  coalesce(lag(data[1] & 15) OVER w, 0) AS counter_before, CASE WHEN can_id BETWEEN 2015 AND 2031 THEN coalesce(source_id, can_id & 15) END AS source FROM frames{WIN}),
s2 AS (SELECT *, CASE WHEN payload = lag(payload) OVER w THEN 0 ELSE 1 END AS new, ts_us - lag(ts_us) OVER (PARTITION BY bus, can_id, payload ORDER BY ts_us, seq) AS gap_us,
  row_number() OVER (PARTITION BY bus, can_id, payload ORDER BY ts_us, seq) - 1 AS repeats,
  CASE WHEN source IS NOT NULL AND row_number() OVER (PARTITION BY bus, can_id, source ORDER BY ts_us, seq) = 1 THEN 1 ELSE 0 END AS first_source FROM s1{WIN}),
s3 AS (SELECT *, sum(new) OVER w AS run, sum(first_source) OVER w AS sources FROM s2{WIN}),
state AS (SELECT *, row_number() OVER (PARTITION BY bus, can_id, run ORDER BY ts_us, seq) AS run_length, list(interval_ms) OVER h AS intervals, list(payload) OVER h AS payloads, ts_us - lag(ts_us, 4) OVER w AS back5
  FROM s3{WIN}, h AS (PARTITION BY bus, can_id ORDER BY ts_us, seq ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))"""


def stateful(name: str, sql: str, violated: Callable[[], Column], history: bool = False) -> None:
    @query(name, f"{STATE_SQL} SELECT seq, coalesce({sql}, false) AS violated FROM state")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = R.add_state(frames(spark, sf_dir))
        return (R.timing_history(rows, 7) if history else rows).select("seq", violated().alias("violated"))


TIMING_SQL = """n >= 3 AND (interval_ms < greatest(0, 500 - 3.0 * 300) OR interval_ms > 500 + 3.0 * 300
  OR (n - 1 >= 7 AND len(list_filter(intervals, lambda x: x < greatest(0, 500 - 1.0 * 300) OR x > 500 + 1.0 * 300)) >= 5
      AND list_max(list_transform(payloads, lambda p: len(list_filter(payloads, lambda q: q = p)))) / len(payloads) >= 0.55))"""
REPLAY_SQL = "gap_us < 1000000 AND (gap_us < 100000 OR repeats >= 3)"
stateful("R17_check_timing", TIMING_SQL, lambda: R.check_timing(500.0, 300.0, 3.0, 1.0, 5, 0.55), history=True)
stateful("R18_check_replay", REPLAY_SQL, lambda: R.check_replay(1.0))
stateful("R19_check_repetition", "run_length > 10", lambda: R.check_repetition(10))
stateful("R20_check_counter", "nibble <> (counter_before + 1) % 16", lambda: R.check_counter())
stateful("R21_check_source", "can_id BETWEEN 2015 AND 2031 AND (source NOT IN (4, 8) OR sources > 3)", lambda: R.check_source([4, 8]))


@query("R15_check_frequency", f"{STATE_SQL} SELECT seq, coalesce(back5 <= 1500000, false) AS violated FROM state")
def _r15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("seq", R.check_frequency(5, 1.5).alias("violated"))


RATE_SQL = "(SELECT count(*) FROM frames g WHERE g.bus = f.bus AND g.ts_us BETWEEN f.ts_us - {w} AND f.ts_us AND (g.ts_us, g.seq) <= (f.ts_us, f.seq))"


@query("R16_check_global_rate", f"{FRAMES_SQL}, c AS (SELECT seq, bus, ts_us, count(*) OVER (PARTITION BY bus ORDER BY ts_us, seq) - count(*) OVER (PARTITION BY bus ORDER BY ts_us RANGE BETWEEN UNBOUNDED PRECEDING AND 1000001 PRECEDING) AS n FROM frames) SELECT seq, n > 25 AS violated FROM c")
def _r16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.check_global_rate(frames(spark, sf_dir), 25, 1.0, "violated").select("seq", "violated")


@query(
    "R18_replay_exact",
    FRAMES_SQL.replace("WITH frames", "WITH RECURSIVE frames", 1)
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY bus, can_id, data ORDER BY ts_us, seq) AS r FROM frames),
    x AS (SELECT bus, can_id, data, seq, r, ts_us AS kept_us, 0 AS again, false AS replay FROM o WHERE r = 1
      UNION ALL SELECT o.bus, o.can_id, o.data, o.seq, o.r,
        CASE WHEN o.ts_us - kept_us < 1000000 AND (again + 1 >= 3 OR o.ts_us - kept_us < 100000) THEN kept_us ELSE o.ts_us END, again + 1,
        o.ts_us - kept_us < 1000000 AND (again + 1 >= 3 OR o.ts_us - kept_us < 100000)
      FROM x JOIN o ON o.bus = x.bus AND o.can_id = x.can_id AND o.data = x.data AND o.r = x.r + 1)
    SELECT seq, replay FROM x""",
)
def _r18x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.replay_exact(frames(spark, sf_dir), 1.0).select("seq", "replay")


#: A small rule file that uses every kind of scope, and checks before, at and after the content gate.
DEMO_RULES = [
    {"name": "strict length", "severity": "LOW", "description": "length", "action": "log", "validate_dlc": True, "dlc_min": 6, "priority": 5},
    {"name": "constant payload", "severity": "MEDIUM", "description": "repetition", "action": "alert", "can_id": 261, "check_repetition": True, "repetition_threshold": 10, "priority": 3},
    {"name": "diagnostics", "severity": "CRITICAL", "description": "source", "action": "block", "can_id_range": [2016, 2031], "check_source": True, "allowed_sources": [4, 8], "priority": 1},
    {"name": "counter", "severity": "HIGH", "description": "counter after AA", "action": "alert", "data_pattern": "AA *", "check_counter": True, "priority": 4},
    {"name": "marker", "severity": "MEDIUM", "description": "content alone", "action": "alert", "data_contains": ["FF"], "priority": 2},
    {"name": "flood", "severity": "CRITICAL", "description": "bus rate", "action": "block", "global_message_rate": 25, "priority": 2},
    {"name": "timing 262", "severity": "HIGH", "description": "timing", "action": "alert", "can_id": 262, "check_timing": True, "expected_interval": 500, "interval_variance": 300, "sigma_extreme": 3.0, "sigma_moderate": 1.0, "consecutive_required": 5, "payload_repetition_threshold": 0.55, "priority": 4},
    {"name": "frequency 270", "severity": "HIGH", "description": "frequency", "action": "alert", "can_id": 270, "max_frequency": 5, "time_window": 1.5, "priority": 2},
    {"name": "not listed", "severity": "LOW", "description": "whitelist", "action": "log", "whitelist_mode": True, "allowed_can_ids": list(range(256, 290)), "priority": 9},
    {"name": "replay", "severity": "HIGH", "description": "replay", "action": "alert", "can_id_range": [256, 265], "check_replay": True, "replay_time_threshold": 1.0, "priority": 6},
]

HITS_SQL = STATE_SQL + f""", rated AS (SELECT *, count(*) OVER (PARTITION BY bus ORDER BY ts_us, seq) - count(*) OVER (PARTITION BY bus ORDER BY ts_us RANGE BETWEEN UNBOUNDED PRECEDING AND 1000001 PRECEDING) AS rate FROM state),
hits AS (SELECT bus, seq, ts_us, can_id, unnest(list_filter([
  CASE WHEN dlc NOT BETWEEN 0 AND 8 OR dlc <> len(data) OR dlc < 6 THEN {{'no': 0, 'name': 'strict length', 'severity': 'LOW', 'priority': 5, 'confidence': 0.5, 'global': true}} END,
  CASE WHEN can_id = 261 AND run_length > 10 THEN {{'no': 1, 'name': 'constant payload', 'severity': 'MEDIUM', 'priority': 3, 'confidence': 0.5, 'global': false}} END,
  CASE WHEN can_id BETWEEN 2016 AND 2031 AND (source NOT IN (4, 8) OR sources > 3) THEN {{'no': 2, 'name': 'diagnostics', 'severity': 'CRITICAL', 'priority': 1, 'confidence': 0.7, 'global': true}} END,
  CASE WHEN data[1] = 170 AND len(data) >= 2 AND nibble <> (counter_before + 1) % 16 THEN {{'no': 3, 'name': 'counter', 'severity': 'HIGH', 'priority': 4, 'confidence': 0.8, 'global': true}} END,
  CASE WHEN contains({HEX.format(s=' ')}, 'FF') THEN {{'no': 4, 'name': 'marker', 'severity': 'MEDIUM', 'priority': 2, 'confidence': 0.5, 'global': true}} END,
  CASE WHEN rate > 25 THEN {{'no': 5, 'name': 'flood', 'severity': 'CRITICAL', 'priority': 2, 'confidence': 0.7, 'global': true}} END,
  CASE WHEN can_id = 262 AND {TIMING_SQL} THEN {{'no': 6, 'name': 'timing 262', 'severity': 'HIGH', 'priority': 4, 'confidence': 0.5, 'global': false}} END,
  CASE WHEN can_id = 270 AND back5 <= 1500000 THEN {{'no': 7, 'name': 'frequency 270', 'severity': 'HIGH', 'priority': 2, 'confidence': 0.7, 'global': false}} END,
  CASE WHEN can_id NOT BETWEEN 256 AND 289 THEN {{'no': 8, 'name': 'not listed', 'severity': 'LOW', 'priority': 9, 'confidence': 0.5, 'global': true}} END,
  CASE WHEN can_id BETWEEN 256 AND 265 AND {REPLAY_SQL} THEN {{'no': 9, 'name': 'replay', 'severity': 'HIGH', 'priority': 6, 'confidence': 0.5, 'global': true}} END
], lambda h: h IS NOT NULL)) AS h FROM rated),
flat AS (SELECT bus, seq, ts_us, can_id, h['no'] AS rule_no, h['name'] AS rule_name, h['severity'] AS severity, h['priority'] AS priority, round(h['confidence'], 6) AS confidence, h['global'] AS is_global FROM hits),
early AS (SELECT * FROM (SELECT *, coalesce(max(CASE WHEN priority <= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY bus, seq ORDER BY is_global, priority, rule_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stop FROM flat) WHERE stop = 0)"""


def demo_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.evaluate(frames(spark, sf_dir), R.rules_frame(spark, DEMO_RULES))


@query("R1_match_scope", f"{FRAMES_SQL}, r(rule_no, low, high) AS (VALUES (0, 0, 9999), (1, 261, 261), (2, 2016, 2031), (3, 0, 9999), (4, 0, 9999), (5, 0, 9999), (6, 262, 262), (7, 270, 270), (9, 256, 265)) SELECT bus, seq, rule_no FROM frames JOIN r ON can_id BETWEEN low AND high UNION ALL SELECT bus, seq, 8 FROM frames WHERE can_id NOT BETWEEN 256 AND 289")
def _r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.match_scope(frames(spark, sf_dir), R.rules_frame(spark, DEMO_RULES))


@query("R22_evaluate", f"{HITS_SQL} SELECT bus, seq, rule_no, rule_name, severity FROM flat")
def _r22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo_hits(spark, sf_dir).select("bus", "seq", "rule_no", "rule_name", "severity")


@query("R23_early_exit", f"{HITS_SQL} SELECT bus, seq, rule_no FROM early")
def _r23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.early_exit(demo_hits(spark, sf_dir)).select("bus", "seq", "rule_no")


@query("R24_confidence", f"{HITS_SQL} SELECT rule_name, confidence, count(*) AS hits FROM flat GROUP BY ALL")
def _r24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo_hits(spark, sf_dir).groupBy("rule_name", r6(F.col("confidence"), "confidence")).agg(F.count("*").alias("hits"))


@query("R25_statistics", f"{HITS_SQL}, n AS (SELECT count(*) AS n, sum(7 + CASE WHEN can_id IN (261, 262, 270) THEN 1 ELSE 0 END - 2 + CASE WHEN can_id BETWEEN 2016 AND 2031 THEN 1 ELSE 0 END + CASE WHEN can_id BETWEEN 256 AND 265 THEN 1 ELSE 0 END + CASE WHEN can_id NOT BETWEEN 256 AND 289 THEN 1 ELSE 0 END - 1) AS scopes FROM frames) SELECT n AS processed, (SELECT count(*) FROM flat) AS alerts, round((SELECT count(*) FROM flat) / n, 6) AS alert_rate, round((SELECT count(DISTINCT (bus, seq)) FROM flat) / n, 6) AS match_rate, round(scopes / n, 6) AS avg_rules FROM n")
def _r25(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, rules = frames(spark, sf_dir), R.rules_frame(spark, DEMO_RULES)
    s = R.statistics(f, R.evaluate(f, rules), rules)
    return s.select("processed", "alerts", *(r6(F.col(c), c) for c in ("alert_rate", "match_rate", "avg_rules")))


@query("R26_describe", f"{FRAMES_SQL}, r(name, severity, priority, can_id, stateful) AS (VALUES ('strict length', 'LOW', 5, NULL, false), ('constant payload', 'MEDIUM', 3, 261, true), ('diagnostics', 'CRITICAL', 1, NULL, true), ('counter', 'HIGH', 4, NULL, true), ('marker', 'MEDIUM', 2, NULL, false), ('flood', 'CRITICAL', 2, NULL, true), ('timing 262', 'HIGH', 4, 262, true), ('frequency 270', 'HIGH', 2, 270, true), ('not listed', 'LOW', 9, NULL, false), ('replay', 'HIGH', 6, NULL, true)) SELECT name, severity, priority, r.can_id, stateful, count(f.seq) AS frames FROM r LEFT JOIN frames f ON f.can_id = r.can_id GROUP BY ALL")
def _r26(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules, and how many frames have the id of each."""
    counts = frames(spark, sf_dir).groupBy("can_id").agg(F.count("*").alias("frames"))
    return R.describe(R.rules_frame(spark, DEMO_RULES)).join(counts, "can_id", "left").select("name", "severity", "priority", "can_id", "stateful", F.coalesce("frames", F.lit(0)).alias("frames"))


@query("R27_known_ids", f"{FRAMES_SQL} SELECT can_id, count(*) AS frames FROM frames WHERE can_id BETWEEN 256 AND 265 OR can_id = 270 OR can_id BETWEEN 2016 AND 2031 GROUP BY can_id")
def _r27(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of ids that the rules name."""
    ids = R.known_ids(R.rules_frame(spark, DEMO_RULES))
    return frames(spark, sf_dir).join(F.broadcast(ids), "can_id").groupBy("can_id").agg(F.count("*").alias("frames"))


# --- baseline -------------------------------------------------------------------

BASE_SQL = f"""{FRAMES_SQL}, d AS (SELECT *, (ts_us - lag(ts_us) OVER w) / 1000 AS d, row_number() OVER (PARTITION BY bus, can_id ORDER BY ts_us DESC, seq DESC) AS back FROM frames WHERE attack = 0{WIN}),
b AS (SELECT bus, can_id, avg(d) FILTER (d > 0) AS mean_ms, stddev_samp(d) FILTER (d > 0) AS std_ms, min(d) FILTER (d > 0) AS min_ms, max(d) FILTER (d > 0) AS max_ms, count(d) FILTER (d > 0) AS intervals, count(*) AS frames, count(DISTINCT data) AS payloads,
  CASE WHEN max(ts_us) FILTER (back <= 1000) > min(ts_us) FILTER (back <= 1000) THEN count(*) FILTER (back <= 1000) / ((max(ts_us) FILTER (back <= 1000) - min(ts_us) FILTER (back <= 1000)) / 1000000) ELSE 0 END AS rate FROM d GROUP BY bus, can_id),
base AS (SELECT * FROM b WHERE intervals >= 10),
rules AS (SELECT bus, can_id, 'timing' AS kind, round(mean_ms, 2) AS expected_interval, round(greatest(std_ms, 2.0), 2) AS interval_variance,
  CASE WHEN rate > 50 THEN 2.5 WHEN rate > 10 THEN 2.8 ELSE 3.0 END + CASE WHEN std_ms / mean_ms > 0.5 THEN 0.3 ELSE 0 END AS sigma_extreme,
  CASE WHEN rate > 10 AND rate <= 50 THEN 5 ELSE 4 END + CASE WHEN std_ms / mean_ms > 0.5 THEN 1 ELSE 0 END AS consecutive_required, NULL AS max_frequency,
  CASE WHEN rate > 50 THEN 1.3 WHEN rate > 10 THEN 1.5 ELSE 1.7 END + CASE WHEN std_ms / mean_ms > 0.5 THEN 0.1 ELSE 0 END AS sigma_moderate FROM base WHERE std_ms / mean_ms <= 2
  UNION ALL SELECT bus, can_id, 'frequency', NULL, NULL, NULL, NULL, CAST(floor(rate * 4) AS INT), NULL FROM base WHERE std_ms / mean_ms <= 2 AND rate >= 10)"""


def demo_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.analyze(B.attack_free(frames(spark, sf_dir)))


@query("B1_attack_free", f"{FRAMES_SQL} SELECT bus, attack_type, count(*) AS frames FROM frames WHERE attack = 0 GROUP BY ALL")
def _b1(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return B.attack_free(f.filter("bus = 'v0'"), f.filter("bus != 'v0'")).groupBy("bus", "attack_type").agg(F.count("*").alias("frames"))


@query("B2_analyze", f"{BASE_SQL} SELECT bus, can_id, round(mean_ms, 4) AS mean_ms, round(std_ms, 4) AS std_ms, round(min_ms, 4) AS min_ms, round(max_ms, 4) AS max_ms, intervals, frames, payloads, round(rate, 4) AS rate FROM base")
def _b2(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = demo_profile(spark, sf_dir)
    return p.select("bus", "can_id", *(F.round(c, 4).alias(c) for c in ("mean_ms", "std_ms", "min_ms", "max_ms", "rate")), "intervals", "frames", "payloads")


@query("B3_generate_rules", f"{BASE_SQL} SELECT bus, can_id, kind, expected_interval, interval_variance, round(sigma_extreme, 4) AS sigma_extreme, consecutive_required, max_frequency FROM rules")
def _b3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.generate_rules(demo_profile(spark, sf_dir)).select("bus", "can_id", "kind", "expected_interval", "interval_variance", F.round("sigma_extreme", 4).alias("sigma_extreme"), "consecutive_required", "max_frequency")


@query("B4_merge_rules", f"{BASE_SQL}, n AS (SELECT can_id, kind FROM rules WHERE bus = 'v0'), o AS (SELECT can_id, kind FROM rules WHERE bus = 'v1'), u AS (SELECT can_id, kind, 'old' AS origin FROM o WHERE kind <> 'timing' OR can_id NOT IN (SELECT can_id FROM n WHERE kind = 'timing') UNION ALL SELECT can_id, kind, 'new' FROM n) SELECT can_id, kind, origin, (SELECT array_to_string(list_sort(list(DISTINCT can_id)), ',') FROM n) AS ids FROM u")
def _b4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = B.generate_rules(demo_profile(spark, sf_dir)).select("bus", "can_id", "name", "kind")
    old, new = (rules.filter(F.col("bus") == b).select("can_id", "name", "kind", F.lit(o).alias("origin")) for b, o in (("v1", "old"), ("v0", "new")))
    return B.merge_rules(old, new).select("can_id", "kind", "origin", joined(F.col("allowed_can_ids")).alias("ids"))


WB_SQL = f"""{BASE_SQL}, rr AS (SELECT can_id AS rid, expected_interval AS e, interval_variance AS v, sigma_extreme AS se, sigma_moderate AS sm, consecutive_required AS c, max_frequency AS mf, kind FROM rules WHERE bus = 'v0'),
st AS (SELECT *, {HEX.format(s="")} AS payload, row_number() OVER w AS n, (ts_us - lag(ts_us) OVER w) / 1000 AS interval_ms FROM frames{WIN}),
hh AS (SELECT *, list(interval_ms) OVER h AS intervals, list(payload) OVER h AS payloads, list(ts_us) OVER w AS times FROM st WINDOW w AS (PARTITION BY bus, can_id ORDER BY ts_us, seq), h AS (PARTITION BY bus, can_id ORDER BY ts_us, seq ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
j AS (SELECT hh.*, rr.*, intervals[greatest(len(intervals) - c - 1, 1):] AS li, payloads[greatest(len(payloads) - c - 1, 1):] AS lp FROM hh JOIN rr ON rid = can_id),
f AS (SELECT bus, kind, can_id, CASE WHEN kind = 'frequency' THEN coalesce(len(times) >= mf AND ts_us - times[len(times) - mf + 1] <= 1000000, false)
  ELSE e <> 0 AND v <> 0 AND n >= 3 AND (interval_ms < greatest(0, e - se * v) OR interval_ms > e + se * v
    OR (n - 1 >= c + 2 AND len(list_filter(li, lambda x: x < greatest(0, e - sm * v) OR x > e + sm * v)) >= c
      AND list_max(list_transform(lp, lambda p: len(list_filter(lp, lambda q: q = p)))) / len(lp) >= {B.REPEATED})) END AS hit FROM j)
SELECT bus, concat(kind, ' 0x', lpad(hex(can_id), 3, '0')) AS rule_name, count(*) AS alerts FROM f WHERE hit GROUP BY ALL"""


@query("W_B_redetect", WB_SQL)
def _wb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn a baseline from one bus, generate rules, and run them on all; no rules learned, no alerts."""
    f = frames(spark, sf_dir)
    rules = B.rules_from_profile(B.generate_rules(B.analyze(B.attack_free(f.filter("bus = 'v0'")))))
    hits = R.evaluate(f, R.rules_frame(spark, rules)) if rules else f.limit(0).withColumn("rule_name", F.lit(None).cast("string"))
    return hits.groupBy("bus", "rule_name").agg(F.count("*").alias("alerts"))
