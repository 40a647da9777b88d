"""Queries: calibration, features, detectors, ensembles, learning, alerts, evaluation, exploration, streams."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewatch.functions import payload as P
from framewatch.operators import alerts as A
from framewatch.operators import baseline as B
from framewatch.operators import calibrate as C
from framewatch.operators import detect as D
from framewatch.operators import ensemble as EN
from framewatch.operators import evaluate as E
from framewatch.operators import explore as X
from framewatch.operators import features as FT
from framewatch.operators import ml as M
from framewatch.operators import rules as R
from framewatch.operators import summary as SU
from framewatch.operators import windows as W
from framewatch.operators.forest import IsolationForest
from framewatch.plans.demo import FRAMES_SQL, frames
from framewatch.plans.queries_rules import BASE_SQL as BASE_SQL_RULES
from framewatch.plans.queries_rules import DEMO_RULES, ENTROPY, HITS_SQL, PAD, WIN, demo_hits, joined, r6
from framewatch.plans.registry import ORACLE, query
from framewatch.sources import io, pcap
from framewatch.storage import fresh, kept
from framewatch.streaming import stream as S


def rounded(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.select(*keys, *(near(c) for c in values))


def near(c: str) -> Column:
    """Six places; a billionth is added on both sides, as many values lie halfway between two of them."""
    return F.round(F.col(c).cast("double") + 1e-9, 6).alias(c)


def rsql(*columns: str) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE) + 1e-9, 6) AS {c.split('.')[-1]}" for c in columns)


# --- calibration ----------------------------------------------------------------

DELTA_SQL = f"{FRAMES_SQL}, n AS (SELECT * FROM frames WHERE attack = 0), i AS (SELECT *, (ts_us - lag(ts_us) OVER w) / 1000000 AS iat, coalesce((ts_us - lag(ts_us) OVER w) / 1000000, 0) AS time_delta, lag(data) OVER w AS before, row_number() OVER w AS k FROM n{WIN})"


def normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).filter("attack = 0")


def profile(name: str, sql: str, values: list[str], make: Callable[[DataFrame], DataFrame], keys: tuple[str, ...] = ("bus", "can_id"), exact: list[str] | None = None) -> None:
    body = f"{DELTA_SQL} SELECT {', '.join(keys)}, {rsql(*values)}{''.join(', ' + c for c in exact or [])} FROM ({sql})"

    @query(name, body)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(normal(spark, sf_dir)).select(*keys, *(near(c) for c in values), *(exact or []))


GROUP = "FROM i GROUP BY bus, can_id"
profile("B5_iat_stats", f"SELECT bus, can_id, avg(iat) AS iat_mean, stddev_pop(iat) AS iat_std, quantile_cont(iat, 0.05) AS iat_p5, quantile_cont(iat, 0.95) AS iat_p95, count(iat) AS n {GROUP} HAVING count(iat) > 0", ["iat_mean", "iat_std", "iat_p5", "iat_p95"], C.iat_stats, exact=["n"])
profile("B5_merged_summaries", f"SELECT bus, can_id, avg(iat) AS iat_mean, stddev_pop(iat) AS iat_std, min(iat) AS iat_min, max(iat) AS iat_max, count(iat) AS n {GROUP} HAVING count(iat) > 0", ["iat_mean", "iat_std", "iat_min", "iat_max"], lambda f: SU.statistics(SU.merge(kept(SU.interval_summary(f, period_us=10_000_000), "summaries"))), exact=["n"])
profile("B6_frequency_profile", f"SELECT bus, can_id, CASE WHEN max(ts_us) > min(ts_us) THEN count(*) / ((max(ts_us) - min(ts_us)) / 1000000) ELSE 0 END AS frequency, avg(iat) AS mean_iat, stddev_samp(iat) AS std_iat, min(iat) AS min_iat, max(iat) AS max_iat, count(*) AS n {GROUP}", ["frequency", "mean_iat", "std_iat", "min_iat", "max_iat"], C.frequency_profile, exact=["n"])
MODE = "(SELECT dlc FROM (SELECT m.dlc, count(*) AS c FROM n m WHERE m.bus = g.bus AND m.can_id = g.can_id GROUP BY m.dlc) ORDER BY c DESC, dlc LIMIT 1)"
profile("B7_payload_profile", f"SELECT *, {MODE} AS common_dlc FROM (SELECT bus, can_id, avg({ENTROPY.format(d='data')}) AS entropy_mean, coalesce(stddev_samp({ENTROPY.format(d='data')}), 0) AS entropy_std, coalesce(var_samp(dlc), 0) AS dlc_variance {GROUP}) g", ["entropy_mean", "entropy_std", "dlc_variance"], C.payload_profile, exact=["common_dlc"])


#: The amplitude spectrum of each id's intervals, term by term (ids with more than ten); the share of its greatest value, and the coefficient of variation.
PERIOD_SQL = """, pi AS (SELECT bus, can_id, x, x - avg(x) OVER g AS d, row_number() OVER (PARTITION BY bus, can_id ORDER BY ts_us, seq) - 1 AS j, count(*) OVER g AS m FROM (SELECT *, (ts_us - lag(ts_us) OVER (PARTITION BY bus, can_id ORDER BY ts_us, seq)) / 1000000 AS x FROM frames WHERE attack = 0) WHERE x IS NOT NULL WINDOW g AS (PARTITION BY bus, can_id)),
pf AS (SELECT bus, can_id, h, sqrt(pow(sum(d * cos(2 * pi() * j * h / m)), 2) + pow(sum(d * sin(2 * pi() * j * h / m)), 2)) AS a FROM (SELECT *, unnest(range(1, m // 2 + 1)) AS h FROM pi WHERE m > 10) GROUP BY ALL),
pc AS (SELECT bus, can_id, CASE WHEN avg(x) > 0 THEN coalesce(stddev_samp(x), 0) / avg(x) ELSE 0 END AS regularity_cv FROM pi GROUP BY ALL),
per AS (SELECT pc.*, coalesce(s, 0) AS periodicity_score FROM pc LEFT JOIN (SELECT bus, can_id, CASE WHEN sum(a) > 1e-12 THEN max(a) / sum(a) ELSE 0 END AS s FROM pf GROUP BY ALL) f ON f.bus = pc.bus AND f.can_id = pc.can_id)"""


@query("B8_timing_profile", f"{FRAMES_SQL}{PERIOD_SQL} SELECT bus, can_id, {rsql('regularity_cv', 'periodicity_score')} FROM per")
def _b8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.timing_profile(normal(spark, sf_dir)), ["bus", "can_id"], ["regularity_cv", "periodicity_score"])


GRAM_SQL = "g AS (SELECT lag(can_id, 2) OVER (PARTITION BY bus ORDER BY ts_us, seq) AS a, lag(can_id) OVER (PARTITION BY bus ORDER BY ts_us, seq) AS b, can_id AS c FROM n)"


@query("B9_ngrams", f"{DELTA_SQL}, {GRAM_SQL} SELECT concat(a, ',', b, ',', c) AS gram, count(*) AS n FROM g WHERE a IS NOT NULL GROUP BY a, b, c")
def _b9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ngrams(normal(spark, sf_dir), 3).select(joined(F.col("gram")).alias("gram"), "n")


@query("B9_ngrams_top", f"{DELTA_SQL}, {GRAM_SQL} SELECT concat(b, ',', c) AS gram, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY b, c ORDER BY n DESC, b, c LIMIT 100")
def _b9t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ngrams(normal(spark, sf_dir), 2, 100).select(joined(F.col("gram")).alias("gram"), "n")


QS = "quantile_cont(time_delta, 0.05) AS q05, quantile_cont(time_delta, 0.5) AS q50, quantile_cont(time_delta, 0.95) AS q95"
profile("B10_time_profile", f"SELECT bus, can_id, avg(time_delta) AS mean, coalesce(stddev_samp(time_delta), 0) AS std, {QS} {GROUP}", ["mean", "std", "q05", "q50", "q95"], C.time_profile)
profile("B11_signature_profile", f"SELECT bus, can_id, CAST(count(*) AS DOUBLE) AS mean_frequency, coalesce(stddev_samp(dlc), 0) AS length_std, count(*) AS n, {MODE} AS common_length FROM i g GROUP BY bus, can_id", ["mean_frequency", "length_std"], lambda f: C.signature_profile(FT.id_frequency(f, "count")), exact=["n", "common_length"])
profile("B12_spoofing_profile", f"SELECT bus, can_id, avg(dlc) AS dlc_mean, stddev_samp(dlc) AS dlc_std, CAST(min(dlc) AS DOUBLE) AS dlc_min, CAST(max(dlc) AS DOUBLE) AS dlc_max, quantile_cont(time_delta, 0.1) AS q10, quantile_cont(time_delta, 0.5) AS q50, quantile_cont(time_delta, 0.9) AS q90 {GROUP}", ["dlc_mean", "dlc_std", "dlc_min", "dlc_max", "q10", "q50", "q90"], lambda f: C.spoofing_profile(C.with_delta(f), ["dlc"]))
FUZZ_SQL = "SELECT bus, can_id, list_sort(list(DISTINCT dlc)) AS lengths, avg(time_delta) AS mean, coalesce(stddev_samp(time_delta), 0) AS std, coalesce(var_samp(time_delta), 0) AS var, quantile_cont(time_delta, 0.01) AS q01, quantile_cont(time_delta, 0.25) AS q25, quantile_cont(time_delta, 0.5) AS q50, quantile_cont(time_delta, 0.75) AS q75, quantile_cont(time_delta, 0.99) AS q99 FROM i GROUP BY bus, can_id"
profile("B13_fuzzing_profile", f"SELECT *, array_to_string(lengths, ',') AS valid, CASE WHEN mean > 0 THEN std / mean ELSE 0 END AS cv, q75 - q25 AS iqr FROM ({FUZZ_SQL})", ["mean", "std", "var", "cv", "q01", "q25", "q50", "q75", "q99", "iqr"], lambda f: C.fuzzing_profile(f).withColumn("valid", joined(F.col("lengths"))), exact=["valid"])


@query("B14_dos_fpmax", f"{DELTA_SQL} SELECT max(n) AS fp_max FROM (SELECT CAST(sum(CASE WHEN time_delta < 0.1 THEN 1 ELSE 0 END) AS BIGINT) AS n {GROUP})")
def _b14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dos_fpmax(C.with_delta(normal(spark, sf_dir)).withColumn("pred", (F.col("time_delta") < 0.1).cast("int")))


HAMMING = "CASE WHEN before IS NULL THEN 0 ELSE list_sum(list_transform(range(1, 9), lambda i: bit_count(xor(coalesce(data[i], 0), coalesce(before[i], 0))))) END"
profile("B15_hamming_p99", f"SELECT bus, can_id, quantile_cont(CAST({HAMMING} AS DOUBLE), 0.99) AS p99 {GROUP}", ["p99"], C.hamming_p99)
MEDIAN_SQL = "SELECT bus, can_id, iat AS expected FROM (SELECT *, row_number() OVER (PARTITION BY bus, can_id ORDER BY iat, ts_us, seq) AS r, count(*) OVER (PARTITION BY bus, can_id) AS m FROM i WHERE iat IS NOT NULL) WHERE r = m // 2 + 1"
profile("B16_prefilter_intervals", MEDIAN_SQL, ["expected"], C.prefilter_intervals)


VEHICLE = ["iat_mean", "iat_std", "iat_p5", "iat_p95", "frequency", "std_iat", "max_iat", "entropy_mean", "entropy_std", "dlc_variance", "mean", "std", "q05", "q50", "fuzz_mean", "cv", "q01", "q99", "iqr", "p99", "expected"]


@query(
    "B17_vehicle",
    f"{DELTA_SQL}, md AS ({MEDIAN_SQL}), vm AS (SELECT bus AS vehicle, count(*) AS samples, count(DISTINCT can_id) AS ids FROM i GROUP BY bus), p AS (SELECT bus, can_id, avg(iat) AS iat_mean, stddev_pop(iat) AS iat_std, quantile_cont(iat, 0.05) AS iat_p5, quantile_cont(iat, 0.95) AS iat_p95, CASE WHEN max(ts_us) > min(ts_us) THEN count(*) / ((max(ts_us) - min(ts_us)) / 1000000) ELSE 0 END AS frequency, stddev_samp(iat) AS std_iat, max(iat) AS max_iat, avg({ENTROPY.format(d='data')}) AS entropy_mean, coalesce(stddev_samp({ENTROPY.format(d='data')}), 0) AS entropy_std, coalesce(var_samp(dlc), 0) AS dlc_variance, avg(time_delta) AS mean, coalesce(stddev_samp(time_delta), 0) AS std, quantile_cont(time_delta, 0.05) AS q05, quantile_cont(time_delta, 0.5) AS q50, avg(time_delta) AS fuzz_mean, CASE WHEN avg(time_delta) > 0 THEN coalesce(stddev_samp(time_delta), 0) / avg(time_delta) ELSE 0 END AS cv, quantile_cont(time_delta, 0.01) AS q01, quantile_cont(time_delta, 0.99) AS q99, quantile_cont(time_delta, 0.75) - quantile_cont(time_delta, 0.25) AS iqr, quantile_cont(CAST({HAMMING} AS DOUBLE), 0.99) AS p99, {MODE} AS common_dlc FROM i g GROUP BY bus, can_id HAVING count(iat) > 0) SELECT vehicle, p.can_id, {rsql(*VEHICLE)}, common_dlc, samples, ids FROM p JOIN vm ON vm.vehicle = p.bus JOIN md ON md.bus = p.bus AND md.can_id = p.can_id",
)
def _b17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight profiles of each vehicle side by side."""
    p = C.vehicle(frames(spark, sf_dir))
    keys = ["vehicle", "can_id"]
    out = p["iat"].drop("n").join(p["frequency"].drop("n"), keys).join(p["payload"], keys).join(p["time"].drop("q95"), keys)
    fuzzing = p["fuzzing"].select(*keys, F.col("mean").alias("fuzz_mean"), "cv", "q01", "q99", "iqr")
    return rounded(out.join(fuzzing, keys).join(p["hamming"], keys).join(p["prefilter"], keys).join(p["meta"], "vehicle"), keys + ["common_dlc", "samples", "ids"], VEHICLE)


# --- features -------------------------------------------------------------------

ALL_SQL = f"{FRAMES_SQL}, i AS (SELECT *, (ts_us - lag(ts_us) OVER w) / 1000000 AS iat, coalesce((ts_us - lag(ts_us) OVER w) / 1000000, 0) AS time_delta, lag(data) OVER w AS before, row_number() OVER w AS k, row_number() OVER (PARTITION BY bus ORDER BY ts_us, seq) AS rn FROM frames{WIN})"
IDW = "(PARTITION BY bus, can_id ORDER BY ts_us, seq{rows})"
BUSW = "(PARTITION BY bus ORDER BY ts_us, seq{rows})"


def trailing_sql(us: int) -> str:
    return f"(k - count(*) OVER (PARTITION BY bus, can_id ORDER BY ts_us RANGE BETWEEN UNBOUNDED PRECEDING AND {us + 1} PRECEDING))"


FEATURE_SQL: dict[str, str] = {}


def feature(name: str, sql: str, values: list[str], make: Callable[[SparkSession, str], DataFrame], exact: list[str] | None = None) -> None:
    FEATURE_SQL[name] = sql
    body = f"{ALL_SQL} SELECT bus, seq, {rsql(*values) if values else ''}{', ' if values and exact else ''}{', '.join(exact or [])} FROM ({sql})"

    @query(name, body)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(spark, sf_dir).select("bus", "seq", *(near(c) for c in values), *(exact or []))


feature("F1_interarrival", f"SELECT bus, seq, time_delta * 1000 AS interval_ms, time_delta, coalesce((ts_us - lag(ts_us) OVER {BUSW.format(rows='')}) / 1000000, 0) AS bus_delta FROM i", ["interval_ms", "time_delta", "bus_delta"], lambda s, d: FT.interarrival(frames(s, d)))
feature("F2_rates", "SELECT bus, seq, " + ", ".join(f"CASE WHEN {trailing_sql(60000000)} >= 2 THEN {trailing_sql(n * 1000000)} / {n} ELSE 0 END AS freq_last_{n}s" for n in (1, 5, 10, 30)) + " FROM i", [f"freq_last_{n}s" for n in (1, 5, 10, 30)], lambda s, d: FT.rates(frames(s, d)))
L10 = IDW.format(rows=" ROWS BETWEEN 9 PRECEDING AND CURRENT ROW")
feature("F3_interval_stats", "SELECT *, interval_max - interval_min AS interval_jitter FROM (SELECT bus, seq, " + ", ".join(f"CASE WHEN k >= 3 THEN {f}(iat) OVER {L10} ELSE 0 END AS interval_{n}" for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))) + " FROM i)", ["interval_mean", "interval_std", "interval_min", "interval_max", "interval_jitter"], lambda s, d: FT.interval_stats(frames(s, d)))
L5 = IDW.format(rows=" ROWS BETWEEN 4 PRECEDING AND CURRENT ROW")
feature(
    "F4_behavior",
    f"SELECT bus, seq, CASE WHEN k < 2 THEN 1 ELSE CAST(min(dlc) OVER {L10} = max(dlc) OVER {L10} AS INT) END AS dlc_consistency, CASE WHEN k < 2 THEN 0 WHEN len(data) <> len(before) THEN 1 ELSE len(list_filter(range(1, len(data) + 1), lambda x: data[x] <> before[x])) / greatest(len(data), 1) END AS data_change_rate, CASE WHEN k >= 5 AND max(dlc) OVER {L5} > 0 THEN list_sum([" + ", ".join(f"stddev_samp(coalesce(data[{b + 1}], 0)) OVER {L5}" for b in range(8)) + f"][1:max(dlc) OVER {L5}]) / max(dlc) OVER {L5} ELSE 0 END AS payload_variance FROM i",
    ["dlc_consistency", "data_change_rate", "payload_variance"], lambda s, d: FT.behavior(frames(s, d)),
)
FIRST_ID = "CASE WHEN row_number() OVER (PARTITION BY bus, can_id ORDER BY ts_us, seq) = 1 THEN 1 ELSE 0 END"
feature(
    "F5_communication",
    f"SELECT *, unique_can_ids / total_messages AS id_diversity, CASE WHEN runtime_seconds > 0 THEN total_messages / runtime_seconds ELSE 0 END AS global_message_rate FROM (SELECT bus, seq, rn AS total_messages, sum(first) OVER {BUSW.format(rows='')} AS unique_can_ids, (ts_us - min(ts_us) OVER (PARTITION BY bus)) / 1000000 AS runtime_seconds FROM (SELECT *, {FIRST_ID} AS first FROM i))",
    ["total_messages", "unique_can_ids", "id_diversity", "runtime_seconds", "global_message_rate"], lambda s, d: FT.communication(frames(s, d)),
)


_step_sql = "list_transform(range(1, len(data)), lambda i: data[i + 1] - data[i])"
BASE_COLUMNS = {
    "can_id": "can_id", "dlc": "dlc", "is_extended": "CAST(is_extended AS INT)", "is_remote": "CAST(is_remote AS INT)", "is_error": "CAST(is_error AS INT)",
    **{f"data_byte_{b}": f"coalesce(data[{b + 1}], 0)" for b in range(8)},
    "data_mean": "list_avg(data)", "data_median": "list_median(data)", "data_std": "coalesce(list_stddev_samp(data), 0)", "data_min": "list_min(data)", "data_max": "list_max(data)", "data_range": "list_max(data) - list_min(data)", "data_sum": "list_sum(data)",
    "data_entropy": ENTROPY.format(d="data"), "zero_bytes": "len(list_filter(data, lambda x: x = 0))", "max_bytes": "len(list_filter(data, lambda x: x = 255))",
    "pattern_repetition": f"len(list_filter({_step_sql}, lambda s: s = 0)) / (len(data) - 1)", "sequential_pattern": f"CAST(len(list_filter({_step_sql}, lambda s: s < 0)) = 0 OR len(list_filter({_step_sql}, lambda s: s > 0)) = 0 AS INT)",
    "alternating_pattern": "len(list_filter(range(1, len(data) - 2), lambda i: data[i] = data[i + 2] AND data[i + 1] = data[i + 3])) / (len(data) - 3)", "ascending_bytes": f"len(list_filter({_step_sql}, lambda s: s = 1)) / (len(data) - 1)", "descending_bytes": f"len(list_filter({_step_sql}, lambda s: s = -1)) / (len(data) - 1)",
    "can_id_normalized": "can_id / 2047", "estimated_priority": "1 - can_id / 2047",
}


@query(
    "F6_base47",
    f"{ALL_SQL} SELECT i.bus, i.seq, " + ", ".join(f"round(CAST(coalesce({BASE_COLUMNS.get(c, c)}, 0) AS DOUBLE) + 1e-9, 6) AS {c}" for c in FT.BASE_FEATURES) + " FROM i " + " ".join(f"JOIN ({FEATURE_SQL[f]}) x{k} USING (bus, seq)" for k, f in enumerate(("F2_rates", "F3_interval_stats", "F4_behavior", "F5_communication"))),
)
def _f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(FT.base47(frames(spark, sf_dir)), ["bus", "seq"], list(FT.BASE_FEATURES))


KNOWN_SQL = f", nn AS (SELECT * FROM frames WHERE attack = 0 AND seq % 2 = 0), gg AS (SELECT bus, lag(can_id, 2) OVER {BUSW.format(rows='')} AS a, lag(can_id) OVER {BUSW.format(rows='')} AS b, can_id AS c FROM nn), g2 AS (SELECT DISTINCT b, c, 1 AS known FROM gg WHERE b IS NOT NULL), g3 AS (SELECT DISTINCT a, b, c, 1 AS known FROM gg WHERE a IS NOT NULL), st AS (SELECT bus, can_id, avg(x) AS iat_mean, stddev_pop(x) AS iat_std FROM (SELECT bus, can_id, (ts_us - lag(ts_us) OVER w) / 1000000 AS x FROM nn{WIN}) GROUP BY ALL HAVING count(x) > 0)"


@query(
    "F7_enhanced8",
    f"{ALL_SQL}{KNOWN_SQL}, j AS (SELECT *, lag(can_id) OVER {BUSW.format(rows='')} AS p1, lag(can_id, 2) OVER {BUSW.format(rows='')} AS p2 FROM i) SELECT j.bus, seq, round({ENTROPY.format(d='data')}, 6) AS payload_entropy, CAST({HAMMING} AS INT) AS hamming_distance, round(CASE WHEN iat_std > 0 AND time_delta > 0 THEN (time_delta - iat_mean) / iat_std ELSE 0 END, 6) AS iat_zscore, CASE WHEN p1 IS NULL OR g2.known = 1 THEN 0 ELSE 1 END AS unknown_bigram, CASE WHEN p2 IS NULL OR g3.known = 1 THEN 0 ELSE 1 END AS unknown_trigram, round(time_delta / 108, 9) AS bit_time_mean, round(time_delta / 108, 9) AS bit_time_rms, round(time_delta / 108 * time_delta / 108, 9) AS bit_time_energy FROM j LEFT JOIN g2 ON g2.b = p1 AND g2.c = can_id LEFT JOIN g3 ON g3.a = p2 AND g3.b = p1 AND g3.c = can_id LEFT JOIN st ON st.bus = j.bus AND st.can_id = j.can_id",
)
def _f7(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    n = f.filter("attack = 0 and seq % 2 = 0")
    out = FT.enhanced8(f, C.iat_stats(n), C.ngrams(n, 2), C.ngrams(n, 3))
    return out.select("bus", "seq", r6(F.col("payload_entropy"), "payload_entropy"), "hamming_distance", r6(F.col("iat_zscore"), "iat_zscore"), "unknown_bigram", "unknown_trigram", *(F.round(f"bit_time_{k}", 9).alias(f"bit_time_{k}") for k in ("mean", "rms", "energy")))


L50 = IDW.format(rows=" ROWS BETWEEN 49 PRECEDING AND CURRENT ROW")
feature(
    "F8_ml23",
    f"SELECT bus, seq, k AS n, can_id, dlc, {', '.join(f'coalesce(data[{b + 1}], 0) AS data_byte_{b}' for b in range(8))}, list_min(data) AS data_min, list_max(data) AS data_max, coalesce(min(iat * 1000) OVER {L50}, 0) AS interval_min, coalesce(max(iat * 1000) OVER {L50}, 0) AS interval_max, list_avg(data) AS data_mean, list_stddev_pop(data) AS data_std, {ENTROPY.format(d='data')} AS data_entropy, {trailing_sql(10000000)} / 10 AS rate_10s, coalesce(iat * 1000, 0) AS interval_ms, coalesce(avg(iat * 1000) OVER {L50}, 0) AS interval_mean, coalesce(stddev_pop(iat * 1000) OVER {L50}, 0) AS interval_std, coalesce(stddev_pop(dlc) OVER {L10}, 0) AS dlc_std, {ENTROPY.format(d='recent')} AS recent_entropy FROM (SELECT *, flatten(list(data) OVER {L5}) AS recent FROM i)",
    ["can_id", "dlc", *(f"data_byte_{b}" for b in range(8)), "data_min", "data_max", "interval_min", "interval_max", "data_mean", "data_std", "data_entropy", "rate_10s", "interval_ms", "interval_mean", "interval_std", "dlc_std", "recent_entropy"], lambda s, d: FT.ml23(frames(s, d)), exact=["n"],
)
RATE_ID = "CASE WHEN ts_us > oldest THEN m60 / ((ts_us - oldest) / 1000000) ELSE 0 END"
RATED = f"(SELECT *, {trailing_sql(60000000)} AS m60, min(ts_us) OVER (PARTITION BY bus, can_id ORDER BY ts_us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS oldest FROM i)"
feature("F9_basic9", f"SELECT bus, seq, can_id AS arb_id_numeric, dlc AS data_length, {RATE_ID} AS id_frequency, time_delta, avg(time_delta) OVER {L50} AS id_mean_time_delta, coalesce(stddev_samp(time_delta) OVER {L50}, 0) AS id_std_time_delta, CAST(ts_us // 3600000000 % 24 AS INT) AS hour, CAST(ts_us // 60000000 % 60 AS INT) AS minute, CAST(ts_us // 1000000 % 60 AS INT) AS second FROM {RATED}", ["id_frequency", "time_delta", "id_mean_time_delta", "id_std_time_delta"], lambda s, d: FT.basic9(frames(s, d)), exact=["arb_id_numeric", "data_length", "hour", "minute", "second"])
L100 = IDW.format(rows=" ROWS BETWEEN 99 PRECEDING AND CURRENT ROW")
feature("F10_tree12", f"SELECT bus, seq, dlc, coalesce(iat * 1000, 0) AS interval_ms, CASE WHEN ts_us > first(ts_us) OVER {L100} THEN count(*) OVER {L100} / ((ts_us - first(ts_us) OVER {L100}) / 1000000) ELSE 0 END AS frequency, len(list_distinct({PAD})) / 8 * 2.5 AS entropy FROM i", ["interval_ms", "frequency", "entropy"], lambda s, d: FT.tree12(frames(s, d)), exact=["dlc"])
DEV_SQL = f", fp AS (SELECT bus, can_id, CASE WHEN max(ts_us) > min(ts_us) THEN count(*) / ((max(ts_us) - min(ts_us)) / 1000000) ELSE 0 END AS frequency, avg(x) AS mean_iat, avg({ENTROPY.format(d='data')}) AS em, coalesce(stddev_samp({ENTROPY.format(d='data')}), 0) AS es, coalesce(stddev_samp(x) / avg(x), 0) AS cv, count(x) AS nx FROM (SELECT *, (ts_us - lag(ts_us) OVER w) / 1000000 AS x FROM frames WHERE attack = 0{WIN}) GROUP BY ALL)"


DEVIATION_SQL = f"{ALL_SQL}{DEV_SQL}{PERIOD_SQL}, dm AS (SELECT bus, can_id, first(dlc ORDER BY c DESC, dlc) AS common_dlc FROM (SELECT bus, can_id, dlc, count(*) AS c FROM frames WHERE attack = 0 GROUP BY ALL) GROUP BY ALL), r AS (SELECT *, {RATE_ID} AS id_frequency FROM {RATED}), dv AS (SELECT r.bus, seq, coalesce(abs(id_frequency - frequency) / (frequency + 1e-6), 0) AS freq_deviation, coalesce(abs(time_delta - mean_iat) / (mean_iat + 1e-6), 0) AS iat_deviation, CASE WHEN es > 0 THEN abs({ENTROPY.format(d='data')} - em) / es ELSE 0 END AS entropy_anomaly, coalesce(abs(dlc - common_dlc), 0) AS dlc_anomaly, coalesce(periodicity_score, 0) AS periodicity_score, CASE WHEN nx > 0 THEN coalesce(cv, 0) ELSE 0 END AS timing_irregularity FROM r LEFT JOIN fp ON fp.bus = r.bus AND fp.can_id = r.can_id LEFT JOIN per ON per.bus = r.bus AND per.can_id = r.can_id LEFT JOIN dm ON dm.bus = r.bus AND dm.can_id = r.can_id)"
DEVIATION = ("freq_deviation", "iat_deviation", "entropy_anomaly", "dlc_anomaly", "periodicity_score", "timing_irregularity")


@query("F11_deviation", DEVIATION_SQL + " SELECT bus, seq, " + ", ".join(f"round(CAST({c} AS DOUBLE) + 1e-9, 5) AS {c}" for c in DEVIATION) + " FROM dv")
def _f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, n = frames(spark, sf_dir), normal(spark, sf_dir)
    out = FT.deviation(FT.id_frequency(C.with_delta(f)), C.frequency_profile(n), C.payload_profile(n), C.timing_profile(n))
    return out.select("bus", "seq", *(F.round(F.col(c) + 1e-9, 5).alias(c) for c in DEVIATION))


feature("F12_burst", f"SELECT bus, seq, CASE WHEN run = 0 THEN 1 ELSE 0 END + row_number() OVER (PARTITION BY bus, run ORDER BY ts_us, seq) AS burst_size, CAST(CASE WHEN run = 0 THEN 1 ELSE 0 END + row_number() OVER (PARTITION BY bus, run ORDER BY ts_us, seq) > 3 AS INT) AS is_burst FROM (SELECT *, sum(CASE WHEN time_delta < 0.3 THEN 0 ELSE 1 END) OVER {BUSW.format(rows='')} AS run FROM i)", [], lambda s, d: FT.burst(C.with_delta(frames(s, d)), 0.3), exact=["burst_size", "is_burst"])


NOVELTY_SQL = f", g AS (SELECT bus, seq, lag(can_id, 2) OVER {BUSW.format(rows='')} AS a, lag(can_id) OVER {BUSW.format(rows='')} AS b, can_id AS c, attack FROM i), n3 AS (SELECT lag(can_id, 2) OVER {BUSW.format(rows='')} AS a, lag(can_id) OVER {BUSW.format(rows='')} AS b, can_id AS c FROM frames WHERE attack = 0), top AS (SELECT a, b, c, count(*) AS n FROM n3 WHERE a IS NOT NULL GROUP BY ALL ORDER BY n DESC, a, b, c LIMIT 100), nv AS (SELECT bus, seq, CASE WHEN g.a IS NULL THEN 0 ELSE 1.0 / (1.0 + coalesce(n, 0)) END AS sequence_novelty FROM g LEFT JOIN top USING (a, b, c))"


@query("F13_sequence_novelty", f"{ALL_SQL}{NOVELTY_SQL} SELECT bus, seq, {rsql('sequence_novelty')} FROM nv")
def _f13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(FT.sequence_novelty(frames(spark, sf_dir), C.ngrams(normal(spark, sf_dir), 3, 100)), ["bus", "seq"], ["sequence_novelty"])


R100 = BUSW.format(rows=" ROWS BETWEEN 99 PRECEDING AND CURRENT ROW")
feature("F14_rolling", f"SELECT bus, seq, CASE WHEN n >= 100 THEN avg(time_delta) OVER {R100} ELSE avg(time_delta) OVER (PARTITION BY bus) END AS time_delta_rolling_mean, CASE WHEN n >= 100 THEN coalesce(stddev_samp(time_delta) OVER {R100}, 0) ELSE coalesce(stddev_samp(time_delta) OVER (PARTITION BY bus), 0) END AS time_delta_rolling_std, CASE WHEN n >= 100 THEN avg(f) OVER {R100} ELSE f END AS freq_rolling_mean, CASE WHEN n >= 100 THEN coalesce(stddev_samp(f) OVER {R100}, 0) ELSE 0 END AS freq_rolling_std FROM (SELECT *, {RATE_ID} AS f, count(*) OVER (PARTITION BY bus) AS n FROM {RATED})", ["time_delta_rolling_mean", "time_delta_rolling_std", "freq_rolling_mean", "freq_rolling_std"], lambda s, d: FT.rolling(FT.id_frequency(C.with_delta(frames(s, d)))))


ENHANCED = (*DEVIATION, "burst_size", "is_burst", "sequence_novelty", "time_delta_rolling_mean", "time_delta_rolling_std", "freq_rolling_mean", "freq_rolling_std")


@query("F15_enhanced13", f"{DEVIATION_SQL}{NOVELTY_SQL} SELECT bus, seq, " + ", ".join(f"round(CAST({c} AS DOUBLE) + 1e-9, 5) AS {c}" for c in ENHANCED) + f" FROM dv JOIN nv USING (bus, seq) JOIN ({FEATURE_SQL['F12_burst'].replace('< 0.3', '< 0.001')}) USING (bus, seq) JOIN ({FEATURE_SQL['F14_rolling']}) USING (bus, seq)")
def _f15(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = FT.enhanced13(frames(spark, sf_dir), normal(spark, sf_dir))
    return out.select("bus", "seq", *(F.round(F.col(c).cast("double") + 1e-9, 5).alias(c) for c in ENHANCED))


feature("F16_lags", "SELECT bus, seq, " + ", ".join(f"coalesce(lag(time_delta, {n}) OVER {IDW.format(rows='')}, 0) AS time_delta_lag{n}" for n in (1, 2, 3)) + " FROM i", [f"time_delta_lag{n}" for n in (1, 2, 3)], lambda s, d: FT.lags(C.with_delta(frames(s, d)), ["time_delta"]))
feature("F17_id_frequency_rate", f"SELECT bus, seq, {RATE_ID} AS id_frequency FROM {RATED}", ["id_frequency"], lambda s, d: FT.id_frequency(frames(s, d), "rate"))
feature("F17_id_frequency_share", f"SELECT bus, seq, {trailing_sql(1000000)} / (rn - count(*) OVER (PARTITION BY bus ORDER BY ts_us RANGE BETWEEN UNBOUNDED PRECEDING AND 1000001 PRECEDING)) AS id_frequency FROM i", ["id_frequency"], lambda s, d: FT.id_frequency(frames(s, d), "share"))
feature("F17_id_frequency_count", "SELECT bus, seq, count(*) OVER (PARTITION BY bus, can_id) AS id_frequency FROM i", ["id_frequency"], lambda s, d: FT.id_frequency(frames(s, d), "count"))


# --- detectors ------------------------------------------------------------------

#: Frames with time_delta and counts (i), the profiles of attack-free frames (fz, md), a base detector (pred).
DET_SQL = ALL_SQL + f""", q AS (SELECT *, (ts_us - lag(ts_us) OVER w) / 1000000 AS x, coalesce((ts_us - lag(ts_us) OVER w) / 1000000, 0) AS td, lag(data) OVER w AS bf FROM frames WHERE attack = 0 AND can_id < 290{WIN}),
fz AS (SELECT bus, can_id, list_sort(list(DISTINCT dlc)) AS lengths, avg(td) AS mean, coalesce(stddev_samp(td), 0) AS std, quantile_cont(td, 0.01) AS q01, quantile_cont(td, 0.1) AS q10, quantile_cont(td, 0.25) AS q25, quantile_cont(td, 0.5) AS q50, quantile_cont(td, 0.75) AS q75, quantile_cont(td, 0.9) AS q90, quantile_cont(td, 0.99) AS q99, avg(dlc) AS dlc_mean, stddev_samp(dlc) AS dlc_std, avg(td) AS td_mean, stddev_samp(td) AS td_std, count(*) AS n,
  quantile_cont(CAST({HAMMING.replace('before', 'bf')} AS DOUBLE), 0.99) AS p99 FROM q GROUP BY bus, can_id),
md AS (SELECT bus, can_id, x AS expected FROM (SELECT *, row_number() OVER (PARTITION BY bus, can_id ORDER BY x, ts_us, seq) AS r, count(*) OVER (PARTITION BY bus, can_id) AS m FROM q WHERE x IS NOT NULL) WHERE r = m // 2 + 1),
j AS (SELECT i.*, fz.* EXCLUDE (bus, can_id), fz.can_id IS NOT NULL AS known, CAST(time_delta < 0.4 AS INT) AS pred, {HAMMING} AS hamming FROM i LEFT JOIN fz ON fz.bus = i.bus AND fz.can_id = i.can_id)"""


def base_pred(f: DataFrame) -> DataFrame:
    return C.with_delta(f).withColumn("pred", (F.col("time_delta") < 0.4).cast("int"))


def trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).filter("attack = 0 and can_id < 290")


def detector(name: str, sql: str, columns: list[str], make: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    @query(name, f"{DET_SQL} {sql}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(frames(spark, sf_dir), trained(spark, sf_dir)).select("bus", "seq", *columns)


PRE_SQL = "p AS (SELECT i.*, md.expected, coalesce(md.expected, first_value(iat IGNORE NULLS) OVER (PARTITION BY i.bus, i.can_id ORDER BY ts_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS want FROM i LEFT JOIN md ON md.bus = i.bus AND md.can_id = i.can_id), pre AS (SELECT bus, seq, CASE WHEN expected IS NULL THEN 1 WHEN coalesce(abs(iat - want) > 0.3 * want, false) THEN 1 ELSE 0 END AS suspicious FROM p)"
detector("D1_prefilter", f", {PRE_SQL} SELECT bus, seq, suspicious FROM pre", ["suspicious"], lambda f, n: D.prefilter(f, C.prefilter_intervals(n)))


@query("D2_prefilter_stats", f"{DET_SQL}, {PRE_SQL} SELECT count(*) AS processed, count(*) FILTER (suspicious = 0) AS passed, count(*) FILTER (suspicious = 1) AS flagged, round(count(*) FILTER (suspicious = 0) / count(*), 6) AS pass_rate FROM pre")
def _d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.prefilter_stats(D.prefilter(frames(spark, sf_dir), C.prefilter_intervals(trained(spark, sf_dir))))
    return s.select("processed", "passed", "flagged", r6(F.col("pass_rate"), "pass_rate"))


detector("D3_simple_rules", f"SELECT bus, seq, CAST(time_delta < 0.001 OR time_delta > 1 AS INT) AS timing_flag, CAST({RATE_ID} > 100 AS INT) AS frequency_flag, CAST(dlc NOT BETWEEN 0 AND 8 AS INT) AS dlc_flag, CAST(time_delta < 0.001 OR time_delta > 1 OR {RATE_ID} > 100 OR dlc NOT BETWEEN 0 AND 8 AS INT) AS simple FROM {RATED}", ["timing_flag", "frequency_flag", "dlc_flag", "simple"], lambda f, n: D.simple_rules(FT.id_frequency(C.with_delta(f))))
detector("D4_time_based", "SELECT bus, seq, CAST(NOT known OR abs(time_delta - mean) > 0.1 * mean OR (mean = 0 AND time_delta > 0.1) AS INT) AS time_based FROM j", ["time_based"], lambda f, n: D.time_based(C.with_delta(f), C.time_profile(n)))
detector("D5_cumulative_timing", f"SELECT bus, seq, CAST(round(avg(CASE WHEN NOT known THEN 1 WHEN mean > 0 THEN least(abs(time_delta - mean) / mean, 1) ELSE 0 END) OVER {R100}, 9) > 0.7 AS INT) AS cumulative_timing FROM j", ["cumulative_timing"], lambda f, n: D.cumulative_timing(C.with_delta(f), C.time_profile(n), 100, 0.7))
detector("D6_signature", "SELECT bus, seq, CAST(CASE WHEN known THEN c < 0.001 * n OR c > 10 * n OR abs(dlc - ml) > 2 ELSE true END AS INT) AS signature FROM (SELECT j.*, count(*) OVER (PARTITION BY j.bus, j.can_id) AS c, m.ml FROM j LEFT JOIN (SELECT bus, can_id, first(dlc ORDER BY k DESC, dlc) AS ml FROM (SELECT bus, can_id, dlc, count(*) AS k FROM q GROUP BY ALL) GROUP BY ALL) m ON m.bus = j.bus AND m.can_id = j.can_id)", ["signature"], lambda f, n: D.signature(FT.id_frequency(f, "count"), C.signature_profile(FT.id_frequency(n, "count"))))
detector("D7_dos_window", "SELECT bus, seq, CAST(count(*) OVER (PARTITION BY bus, can_id, ts_us // 2000000) > 5 AS INT) AS dos FROM i", ["dos"], lambda f, n: D.dos_window(f, 2.0, 5))
detector("D8_spoof_hamming", "SELECT bus, seq, CAST(hamming > coalesce(p99, 0) + 2 AS INT) AS spoof FROM j", ["spoof"], lambda f, n: D.spoof_hamming(f, C.hamming_p99(n), 2))
detector("D9_fuzzy", f"SELECT bus, seq, CAST(NOT known OR {ENTROPY.format(d='data')} > 2.9 AS INT) AS fuzz FROM j", ["fuzz"], lambda f, n: D.fuzzy(f, n, 2.9))
detector("D10_hybrid", f"SELECT bus, seq, CAST(count(*) OVER (PARTITION BY bus, can_id, ts_us // 2000000) > 5 OR hamming > coalesce(p99, 0) + 32 OR NOT known OR {ENTROPY.format(d='data')} > 6.5 AS INT) AS hybrid FROM j", ["hybrid"], lambda f, n: D.hybrid(f, C.hamming_p99(n), width_s=2.0, limit=5))
DOS_HIT = "sum(CASE WHEN pred = 1 AND can_id <= 280 THEN 1 ELSE 0 END) OVER (PARTITION BY bus, can_id, (ts_us - t0) // 10000000 ORDER BY ts_us, seq)"
CHECK_SQL = f""", c AS (SELECT *, CAST(pred = 1 AND can_id <= 280 AND {DOS_HIT} > 2 AS INT) AS dos_check,
  CASE WHEN pred <> 1 THEN 0 WHEN NOT known THEN 1 WHEN round((CAST(coalesce(abs(dlc - dlc_mean) > 1.0 * dlc_std, false) AS INT) + CAST(coalesce(abs(time_delta - td_mean) > 1.0 * td_std, false) AS INT)) / 2, 9) < 0.3 THEN 0 WHEN time_delta BETWEEN q10 - (q90 - q10) * 0.5 AND q90 + (q90 - q10) * 0.5 THEN 0 ELSE 1 END AS spoof_check,
  CASE WHEN pred <> 1 THEN 0 WHEN known AND NOT list_contains(lengths, dlc) THEN 1 WHEN coalesce(std > 0 AND abs((time_delta - mean) / std) < 0.5, false) THEN 2 WHEN coalesce(time_delta BETWEEN q01 AND q99 AND time_delta BETWEEN q50 - 2 * (q75 - q25) AND q50 + 2 * (q75 - q25), false) THEN 3 ELSE 4 END AS fuzz_rule
  FROM (SELECT *, min(ts_us) OVER (PARTITION BY bus) AS t0 FROM j)),
cc AS (SELECT *, CAST(fuzz_rule IN (1, 4) AS INT) AS fuzz_check,
  CASE WHEN count(*) OVER (PARTITION BY bus, can_id) / count(*) OVER (PARTITION BY bus) > 0.03 THEN 'dos' WHEN NOT known THEN 'spoofing' WHEN NOT list_contains(lengths, dlc) THEN 'fuzzing' ELSE 'unknown' END AS attack_class FROM c)"""


def spoof_profile(n: DataFrame) -> DataFrame:
    return C.spoofing_profile(C.with_delta(n), ["dlc", "time_delta"])


def checked(f: DataFrame, n: DataFrame) -> DataFrame:
    """Frames with the base detector and its three cross-checks, and the class of attack. Written once: ensembles read it several times."""
    rows = D.dos_crosscheck(base_pred(f), 2, id_threshold=280, epoch_s=10.0)
    rows = D.spoof_crosscheck(rows, spoof_profile(n), ["dlc", "time_delta"], sigma=1.0)
    return EN.classify_mass(D.fuzz_crosscheck(rows, C.fuzzing_profile(n), z=0.5), C.fuzzing_profile(n), 0.03)


detector("D11_dos_crosscheck", f"{CHECK_SQL} SELECT bus, seq, dos_check FROM cc", ["dos_check"], lambda f, n: D.dos_crosscheck(base_pred(f), 2, id_threshold=280, epoch_s=10.0))
detector("D12_spoof_crosscheck", f"{CHECK_SQL} SELECT bus, seq, spoof_check FROM cc", ["spoof_check"], lambda f, n: D.spoof_crosscheck(base_pred(f), spoof_profile(n), ["dlc", "time_delta"], sigma=1.0))
detector("D13_fuzz_crosscheck", f"{CHECK_SQL} SELECT bus, seq, fuzz_rule, fuzz_check FROM cc", ["fuzz_rule", "fuzz_check"], lambda f, n: D.fuzz_crosscheck(base_pred(f), C.fuzzing_profile(n), z=0.5))
detector("D14_classify_mass", f"{CHECK_SQL} SELECT bus, seq, attack_class FROM cc", ["attack_class"], lambda f, n: EN.classify_mass(f, C.fuzzing_profile(n), 0.03))
VOTE3 = "CAST(dos_check + spoof_check + fuzz_check >= 2 AS INT)"
detector("D15_crosscheck_auto", f"{CHECK_SQL} SELECT bus, seq, CASE attack_class WHEN 'dos' THEN dos_check WHEN 'spoofing' THEN spoof_check WHEN 'fuzzing' THEN fuzz_check ELSE {VOTE3} END AS ensemble, CASE WHEN attack_class = 'unknown' THEN 'voting' ELSE attack_class END AS routed FROM cc", ["ensemble", "routed"], lambda f, n: EN.crosscheck(checked(f, n), "auto"))
detector("D15_crosscheck_routing", f"{CHECK_SQL} SELECT bus, seq, spoof_check AS ensemble FROM cc", ["ensemble"], lambda f, n: EN.crosscheck(checked(f, n), "routing", "rpm"))
detector("D15_crosscheck_voting", f"{CHECK_SQL} SELECT bus, seq, {VOTE3} AS ensemble FROM cc", ["ensemble"], lambda f, n: EN.crosscheck(checked(f, n), "voting"))
detector("D15_crosscheck_cascade", f"{CHECK_SQL} SELECT bus, seq, least(dos_check, spoof_check, fuzz_check) AS ensemble FROM cc", ["ensemble"], lambda f, n: EN.crosscheck(checked(f, n), "cascade"))


@query("D15_routing_statistics", f"{DET_SQL}{CHECK_SQL} SELECT CASE WHEN attack_class = 'unknown' THEN 'voting' ELSE attack_class END AS routed, count(*) AS rows, CAST(sum(CASE attack_class WHEN 'dos' THEN dos_check WHEN 'spoofing' THEN spoof_check WHEN 'fuzzing' THEN fuzz_check ELSE {VOTE3} END) AS BIGINT) AS detections FROM cc GROUP BY 1")
def _d15s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EN.routing_statistics(EN.crosscheck(checked(frames(spark, sf_dir), trained(spark, sf_dir))))


detector("D16_vote", f"{CHECK_SQL} SELECT bus, seq, CAST(pred + dos_check + spoof_check + fuzz_check >= 2 AS INT) AS vote FROM cc", ["vote"], lambda f, n: EN.vote(checked(f, n), ["pred", "dos_check", "spoof_check", "fuzz_check"]))
detector("D17_weighted_vote", f"{CHECK_SQL} SELECT bus, seq, CAST((pred * 0.5 + dos_check * 1.5 + fuzz_check * 1.0) / 3.0 > 0.5 AS INT) AS weighted FROM cc", ["weighted"], lambda f, n: EN.weighted_vote(checked(f, n), {"pred": 0.5, "dos_check": 1.5, "fuzz_check": 1.0}))
CLASS_SQL = f", d AS (SELECT *, time_delta / 0.5 AS freq_deviation, 1.21 * {ENTROPY.format(d='data')} AS payload_entropy, hamming / 8 AS entropy_anomaly, abs(dlc - 8) AS dlc_anomaly FROM cc), k AS (SELECT *, CASE WHEN freq_deviation > 3 THEN 'dos' WHEN payload_entropy > 3 AND entropy_anomaly > 2 THEN 'fuzzing' WHEN dlc_anomaly > 0.5 THEN CASE WHEN freq_deviation > 1 THEN 'rpm' ELSE 'gear' END ELSE 'unknown' END AS feature_class FROM d), a AS (SELECT *, round(CASE feature_class WHEN 'fuzzing' THEN 0.15 * pred + 0.05 * dos_check + 0.05 * spoof_check + 0.75 * fuzz_check WHEN 'dos' THEN 0.3 * pred + 0.6 * dos_check + 0.05 * spoof_check + 0.05 * fuzz_check WHEN 'rpm' THEN 0.5 * pred + 0.2 * dos_check + 0.2 * spoof_check + 0.1 * fuzz_check WHEN 'gear' THEN 0.7 * pred + 0.1 * dos_check + 0.1 * spoof_check + 0.1 * fuzz_check ELSE 0.4 * pred + 0.2 * dos_check + 0.2 * spoof_check + 0.2 * fuzz_check END, 9) AS conf FROM k)"
VOTE4 = ("pred", "dos_check", "spoof_check", "fuzz_check")


def classified(f: DataFrame, n: DataFrame) -> DataFrame:
    """Entropy is stretched a little: of eight bytes it is never over the limit of 3, and no frame would be of class fuzzing."""
    rows = C.with_hamming(checked(f, n))
    return EN.classify_features(rows.withColumns({"freq_deviation": F.col("time_delta") / 0.5, "payload_entropy": 1.21 * P.entropy("data"), "entropy_anomaly": F.col("hamming") / 8, "dlc_anomaly": F.abs(F.col("dlc") - 8)}))


detector("D18_classify_features", f"{CHECK_SQL}{CLASS_SQL} SELECT bus, seq, feature_class FROM k", ["feature_class"], classified)
detector("D19_adaptive_weighted", f"{CHECK_SQL}{CLASS_SQL} SELECT bus, seq, feature_class, CAST(conf AS DOUBLE) AS adaptive_confidence, CAST(conf >= 0.5 AS INT) AS adaptive FROM a", ["feature_class", "adaptive_confidence", "adaptive"], lambda f, n: EN.adaptive_weighted(classified(f, n), VOTE4))


@query("D19_adaptive_statistics", f"{DET_SQL}{CHECK_SQL}{CLASS_SQL} SELECT feature_class, count(*) AS rows, count(*) FILTER (conf >= 0.5) AS detections FROM a GROUP BY 1")
def _d19s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EN.adaptive_statistics(EN.adaptive_weighted(classified(frames(spark, sf_dir), trained(spark, sf_dir)), VOTE4))


@query("D20_optimize_weights", f"{DET_SQL}{CHECK_SQL}, w AS (SELECT m * 25 + i * 5 + j AS k, (m + 1) / 10 AS w0, (1 - (m + 1) / 10) * i / 4 AS w1, ((1 - (m + 1) / 10) - (1 - (m + 1) / 10) * i / 4) * j / 4 AS w2, (1 - (m + 1) / 10) - (1 - (m + 1) / 10) * i / 4 - ((1 - (m + 1) / 10) - (1 - (m + 1) / 10) * i / 4) * j / 4 AS w3 FROM range(7) a(m), range(5) b(i), range(5) c(j)), v AS (SELECT bus AS kind, attack AS label, pred, dos_check, spoof_check, fuzz_check, count(*) AS c FROM cc GROUP BY ALL), s AS (SELECT kind, k, w0, w1, w2, w3, sum(c) FILTER (label = 1 AND p) AS tp, sum(c) FILTER (label = 0 AND p) AS fp, sum(c) FILTER (label = 1 AND NOT p) AS fn FROM (SELECT *, round(pred * w0 + dos_check * w1 + spoof_check * w2 + fuzz_check * w3, 9) >= 0.5 AS p FROM v, w) GROUP BY ALL), f AS (SELECT *, CASE WHEN coalesce(tp, 0) > 0 THEN round(2 * tp / (2 * tp + coalesce(fp, 0) + coalesce(fn, 0)), 9) ELSE 0 END AS f1 FROM s) SELECT kind, f1, round(w0, 6) AS w_pred, round(w1, 6) AS w_dos_check, round(w2, 6) AS w_spoof_check, round(w3, 6) AS w_fuzz_check FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY f1 DESC, k) AS r FROM f) WHERE r = 1")
def _d20(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = EN.optimize_weights(checked(frames(spark, sf_dir), trained(spark, sf_dir)), "bus", "attack", VOTE4)
    return out.select("kind", "f1", *(r6(F.col(f"w_{v}"), f"w_{v}") for v in VOTE4))


STAGES_SQL = f"{CHECK_SQL}, s1 AS (SELECT *, 1 / (1 + exp(5 * (time_delta - 0.2))) AS c1 FROM cc), s2 AS (SELECT *, pred = 1 OR c1 < 0.8 AS to2, greatest(spoof_check, fuzz_check) AS l2, round(greatest(c1, ((CASE WHEN spoof_check = 1 THEN 0.9 ELSE 0.1 END) + (CASE WHEN fuzz_check = 1 THEN 0.9 ELSE 0.1 END)) / 2), 9) AS c2 FROM s1), s3 AS (SELECT *, to2 AND (l2 = 1 OR c2 < 0.95) AS to3 FROM s2), tot AS (SELECT count(*) FILTER (to2) AS two, count(*) FILTER (to3) AS three FROM s3), rk AS (SELECT *, row_number() OVER (PARTITION BY to3 ORDER BY c2 DESC, seq, bus) AS r FROM s3), fin AS (SELECT *, to3 AND (three <= 0.2 * two OR r <= floor(0.2 * two)) AS go FROM rk, tot), o AS (SELECT bus, seq, CASE WHEN go THEN 3 WHEN to2 THEN 2 ELSE 1 END AS stage, CASE WHEN go THEN dos_check WHEN to2 THEN l2 ELSE pred END AS pred FROM fin)"


def staged(f: DataFrame, n: DataFrame) -> DataFrame:
    rows = kept(checked(f, n).withColumn("stage1", F.col("pred")).withColumn("_score", F.col("time_delta") - 0.2).withColumn("_probability", F.col("dos_check").cast("double")).drop("pred"), "stages")
    return EN.multistage(rows, "stage1", "_score", ["spoof_check", "fuzz_check"], "_probability")


detector("D21_multistage", f"{STAGES_SQL} SELECT bus, seq, stage, pred FROM o", ["stage", "pred"], staged)


@query("D22_stage_statistics", f"{DET_SQL}{STAGES_SQL}, t AS (SELECT stage, count(*) AS ended, CAST(sum(pred) AS BIGINT) AS detections FROM o GROUP BY stage) SELECT stage, CAST(sum(ended) OVER (ORDER BY stage DESC) AS BIGINT) AS processed, CAST(sum(ended) OVER (ORDER BY stage DESC) - ended AS BIGINT) AS passed, detections FROM t")
def _d22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EN.stage_statistics(staged(frames(spark, sf_dir), trained(spark, sf_dir))).select("stage", "processed", "passed", "detections")


@query("D23_infer_vehicle", f"{FRAMES_SQL}, m AS (SELECT DISTINCT bus, can_id FROM frames), t AS (SELECT DISTINCT vehicle, can_id FROM frames WHERE seq % 2 = 0), na AS (SELECT bus, count(*) AS a FROM m GROUP BY bus), nb AS (SELECT vehicle, count(*) AS b FROM t GROUP BY vehicle), ab AS (SELECT bus, vehicle, count(*) AS c FROM m JOIN t USING (can_id) GROUP BY ALL), s AS (SELECT bus, vehicle, c / (a + b - c) AS sim FROM ab JOIN na USING (bus) JOIN nb USING (vehicle)) SELECT bus, CASE WHEN max(sim) > 0.5 THEN first(vehicle ORDER BY sim DESC, vehicle) ELSE 'unknown' END AS vehicle, round(max(sim), 6) AS similarity FROM s GROUP BY bus")
def _d23(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return D.infer_vehicle(f, f.filter("seq % 2 = 0")).select("bus", "vehicle", r6(F.col("similarity"), "similarity"))


VEH_SQL = f"{FRAMES_SQL}, i AS (SELECT *, coalesce((ts_us - lag(ts_us) OVER w) / 1000000, 0) AS time_delta FROM frames{WIN}), vp AS (SELECT vehicle, can_id, avg(td) AS mean FROM (SELECT vehicle, can_id, coalesce((ts_us - lag(ts_us) OVER (PARTITION BY vehicle, can_id ORDER BY ts_us, seq)) / 1000000, 0) AS td FROM frames WHERE attack = 0 AND seq % 3 < 2) GROUP BY ALL)"


def vehicle_profiles(f: DataFrame) -> DataFrame:
    return C.time_profile(f.filter("attack = 0 and seq % 3 < 2"), ("vehicle", "can_id")).select("vehicle", "can_id", "mean")


@query("D24_by_vehicle", f"{VEH_SQL} SELECT seq, round(coalesce(o.mean, d.mean), 6) AS mean FROM i LEFT JOIN (SELECT * FROM vp WHERE vehicle <> 'v2') o ON o.vehicle = i.vehicle AND o.can_id = i.can_id LEFT JOIN vp d ON d.vehicle = 'v0' AND d.can_id = i.can_id")
def _d24(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return D.by_vehicle(f, vehicle_profiles(f).filter("vehicle != 'v2'"), "v0", ["mean"]).select("seq", r6(F.col("mean"), "mean"))


CONF = "count(*) FILTER (attack = 1 AND pred) AS tp, count(*) FILTER (attack = 0 AND pred) AS fp, count(*) FILTER (attack = 0 AND NOT pred) AS tn, count(*) FILTER (attack = 1 AND NOT pred) AS fn, count(*) AS n"
RATES = "round(CASE WHEN n > 0 THEN (tp + tn) / n ELSE 0 END, 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END, 6) AS specificity, round(CASE WHEN tn + fp > 0 THEN fp / (tn + fp) ELSE 0 END, 6) AS fpr, round(CASE WHEN tp + fn > 0 THEN fn / (tp + fn) ELSE 0 END, 6) AS fnr, round(CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0 END, 6) AS npv"


@query("D25_compare_vehicles", f"{VEH_SQL}, c AS (SELECT v.vehicle AS calibration, attack, coalesce(abs(time_delta - mean) > 0.1 * mean, true) AS pred FROM i, (SELECT DISTINCT vehicle FROM vp) v LEFT JOIN vp ON vp.vehicle = v.vehicle AND vp.can_id = i.can_id), m AS (SELECT calibration, {CONF} FROM c GROUP BY calibration), r AS (SELECT calibration, {RATES} FROM m) SELECT calibration, recall, precision, f1 FROM r")
def _d25(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return rounded(D.compare_vehicles(C.with_delta(f), vehicle_profiles(f)), ["calibration"], ["recall", "precision", "f1"])


# --- learning -------------------------------------------------------------------

COLS = ["time_delta", "dlc", "hamming"]
ML_SQL = f"{ALL_SQL}, h AS (SELECT *, CAST({HAMMING} AS DOUBLE) AS hamming FROM i)"


def table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_hamming(C.with_delta(frames(spark, sf_dir)))


for _method, _a, _b in (("minmax", "min({c})", "max({c}) - min({c})"), ("zscore", "avg({c})", "stddev_samp({c})"), ("robust", "quantile_cont(CAST({c} AS DOUBLE), 0.5)", "quantile_cont(CAST({c} AS DOUBLE), 0.75) - quantile_cont(CAST({c} AS DOUBLE), 0.25)")):

    @query(f"M1_normalize_{_method}", f"{ML_SQL}, s AS (SELECT " + ", ".join(f"{_a.format(c=c)} AS {c}_a, CASE WHEN {_b.format(c=c)} = 0 THEN 1 ELSE {_b.format(c=c)} END AS {c}_b" for c in COLS) + " FROM h) SELECT bus, seq, " + ", ".join(f"round(({c} - {c}_a) / {c}_b + 1e-9, 6) AS {c}" for c in COLS) + " FROM h, s")
    def _m1(spark: SparkSession, sf_dir: str, method: str = _method) -> DataFrame:
        t = table(spark, sf_dir)
        return rounded(M.transform(t, M.fit_scaler(t, COLS, method)), ["bus", "seq"], COLS)


@query("M1_inverse", f"{ML_SQL} SELECT bus, seq, " + ", ".join(f"round({c} + 1e-9, 6) AS {c}" for c in COLS) + " FROM h")
def _m1i(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir)
    s = M.fit_scaler(t, COLS, "zscore")
    return rounded(M.inverse(M.transform(t, s), s), ["bus", "seq"], COLS)


@query("M2_validate_features", f"{ML_SQL} SELECT 'absent' AS feature, 'missing' AS problem, 0 AS rows UNION ALL SELECT 'bus', 'not numeric', 0 UNION ALL SELECT 'dlc', 'extra', 0 UNION ALL SELECT 'huge', 'too large', count(*) FROM h WHERE can_id > 290")
def _m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir).select("bus", "seq", "dlc", "time_delta", F.when(F.col("can_id") > 290, 1e12).otherwise(0.0).alias("huge"))
    return M.validate_features(t, ["bus", "seq", "time_delta", "huge", "absent"])


@query("M3_select_by_variance", f"{ML_SQL} SELECT unnest(['time_delta', 'dlc', 'hamming']) AS feature, unnest([var_samp(time_delta) >= 3, var_samp(dlc) >= 3, var_samp(hamming) >= 3]) AS kept FROM h")
def _m3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.select_by_variance(table(spark, sf_dir), COLS, 3.0)
    return spark.createDataFrame([(c, c in found) for c in COLS], "feature string, kept boolean")


@query("M4_pca", f"{ML_SQL} SELECT bus, seq, " + ", ".join(f"round({c} + 1e-9, 4) AS {c}" for c in COLS) + " FROM h")
def _m4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components, and back: the table itself (signs of components don't matter)."""
    t = table(spark, sf_dir)
    r = M.pca_fit(t, COLS, 3)
    back = M.pca_inverse(M.pca_transform(t, r).drop(*COLS), r)
    return back.select("bus", "seq", *(F.round(F.col(c) + 1e-9, 4).alias(c) for c in COLS))


@query("M4_pca_loadings")
def _m4l(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir)
    r = M.pca_fit(t, COLS, 2)
    return spark.createDataFrame([(c, round(v, 6)) for c, v in M.importance(r)], "feature string, importance double")


@query("M5_M6_isolation_forest")
def _m56(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir)
    forest = M.isolation_forest_fit(t.filter("attack = 0"), COLS)
    return M.ml_alerts(M.isolation_forest_score(t, forest), COLS).select("bus", "seq", "can_id", r6(F.col("anomaly_score"), "anomaly_score"), r6(F.col("confidence"), "confidence"), "reason")


@query("M5_forest_reloaded", f"{FRAMES_SQL} SELECT bus, seq, true AS same FROM frames")
def _m5r(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a saved and loaded pipeline of assembler and forest scores each frame as before."""
    path, t = fresh(spark, "pipeline"), table(spark, sf_dir)
    steps = Pipeline(stages=[VectorAssembler(inputCols=COLS, outputCol="features", handleInvalid="keep"), IsolationForest()])
    fitted = steps.fit(t.filter("attack = 0"))
    fitted.write().save(path)
    both = PipelineModel.load(path).transform(fitted.transform(t).drop("features").withColumnsRenamed({"score": "before", "prediction": "odd"}))
    return both.select("bus", "seq", ((F.col("before") == F.col("score")) & (F.col("odd") == F.col("prediction"))).alias("same"))


@query("M7_decision_tree")
def _m7(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = FT.tree12(frames(spark, sf_dir)).join(frames(spark, sf_dir).select("bus", "seq", "attack"), ["bus", "seq"])
    columns = [c for c in t.columns if c not in ("bus", "seq", "attack")]
    model = M.decision_tree_fit(t, columns)
    return M.decision_tree_score(t, model, columns).select("bus", "seq", "attack", r6(F.col("probability"), "probability"), "label")


HASH = "('0x' || substr(md5(concat_ws('|', coalesce(bus, ''), seq, {seed})), 1, 15))::BIGINT"


@query("M8_balanced_sample", f"""{FRAMES_SQL}, h AS (SELECT bus, seq, attack, row_number() OVER (PARTITION BY attack, bus ORDER BY {HASH.format(seed=42)}, seq) AS r, {HASH.format(seed=43)} AS h2 FROM frames),
    s AS (SELECT bus, seq, attack, row_number() OVER (PARTITION BY attack ORDER BY h2, seq) AS r, count(*) OVER (PARTITION BY attack) AS n FROM h WHERE r <= CASE attack WHEN 0 THEN 300 ELSE 100 END)
    SELECT bus, seq, attack, CASE WHEN r <= (n * 200 + 999) // 1000 THEN 'test' ELSE 'train' END AS split FROM s""")
def _m8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.balanced_sample(frames(spark, sf_dir), {0: 300, 1: 100}, by="bus").select("bus", "seq", "attack", "split")


@query("M8_balanced_counts", f"{FRAMES_SQL} SELECT bus, attack, least(count(*), CASE attack WHEN 0 THEN 300 ELSE 100 END) AS n FROM frames GROUP BY bus, attack")
def _m8c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each class and file the sample has."""
    return M.balanced_sample(frames(spark, sf_dir), {0: 300, 1: 100}, by="bus").groupBy("bus", "attack").agg(F.count("*").alias("n"))


@query("M9_dual_models")
def _m9(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = FT.tree12(frames(spark, sf_dir)).join(frames(spark, sf_dir).select("bus", "seq", "attack"), ["bus", "seq"])
    timing, payload = ["interval_ms", "frequency"], [f"data_byte_{i}" for i in range(8)] + ["dlc", "entropy"]
    a, b = M.dual_models(t, timing, payload)
    first = M.decision_tree_score(t, a, timing).withColumnRenamed("label", "timing_label").drop("probability")
    return M.decision_tree_score(first, b, payload).select("bus", "seq", "attack", "timing_label", F.col("label").alias("payload_label"))


# --- alerts ---------------------------------------------------------------------

ALERT_SQL = HITS_SQL + ", al AS (SELECT *, CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END AS level FROM early)"


def demo_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.normalize(R.early_exit(demo_hits(spark, sf_dir)), "rules")


@query("A1_normalize", f"{ALERT_SQL} SELECT bus, seq, rule_name, level, 'rules' AS source, concat('alert-', bus, '-', ts_us // 1000000, '-', lpad(CAST(row_number() OVER (PARTITION BY bus, ts_us // 1000000 ORDER BY ts_us, seq, rule_name) AS VARCHAR), 6, '0')) AS alert_id FROM al")
def _a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo_alerts(spark, sf_dir).select("bus", "seq", "rule_name", "level", "source", "alert_id")


@query("A2_filter", f"{ALERT_SQL} SELECT bus, seq, rule_name FROM al WHERE level >= 3 AND confidence >= 0.6")
def _a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.filter_alerts(demo_alerts(spark, sf_dir), "HIGH", 0.6, ["rules"]).select("bus", "seq", "rule_name")


@query("A3_rate_limit", f"{ALERT_SQL} SELECT bus, seq, rule_name FROM (SELECT *, row_number() OVER (PARTITION BY bus, ts_us // 1000000 ORDER BY ts_us, seq, rule_name) AS r FROM al) WHERE r <= 3")
def _a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rate_limit(demo_alerts(spark, sf_dir), 3).select("bus", "seq", "rule_name")


#: A kept alert is compared with the third kept before it; scanned in order, its three last kept times carried along.
SLIDING_SQL = ALERT_SQL.replace("WITH frames", "WITH RECURSIVE frames", 1) + ", o AS (SELECT *, row_number() OVER (PARTITION BY bus ORDER BY ts_us, seq, rule_name) AS r FROM al), s AS (SELECT bus, seq, rule_name, r, [ts_us] AS kept, true AS keep FROM o WHERE r = 1 UNION ALL SELECT o.bus, o.seq, o.rule_name, o.r, CASE WHEN len(kept) < 3 OR o.ts_us - kept[-3] >= 1000000 THEN list_append(kept, o.ts_us)[-3:] ELSE kept END, len(kept) < 3 OR o.ts_us - kept[-3] >= 1000000 FROM s JOIN o ON o.bus = s.bus AND o.r = s.r + 1)"


@query("A3_rate_limit_sliding", SLIDING_SQL + " SELECT bus, seq, rule_name FROM s WHERE keep")
def _a3s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rate_limit(kept(demo_alerts(spark, sf_dir), "alerts"), 3, sliding=True).select("bus", "seq", "rule_name")


DEDUP_SQL = ", o AS (SELECT *, row_number() OVER (PARTITION BY bus, rule_name, can_id, severity ORDER BY ts_us, seq) AS r FROM al), dd AS (SELECT bus, rule_name, can_id, severity, ts_us, seq, r, ts_us AS kept_us, true AS keep FROM o WHERE r = 1 UNION ALL SELECT o.bus, o.rule_name, o.can_id, o.severity, o.ts_us, o.seq, o.r, CASE WHEN o.ts_us - dd.kept_us >= 60000000 THEN o.ts_us ELSE dd.kept_us END, o.ts_us - dd.kept_us >= 60000000 FROM dd JOIN o ON o.bus = dd.bus AND o.rule_name = dd.rule_name AND o.can_id = dd.can_id AND o.severity = dd.severity AND o.r = dd.r + 1)"


@query("A4_dedup", ALERT_SQL.replace("WITH frames", "WITH RECURSIVE frames", 1) + DEDUP_SQL + " SELECT bus, seq, rule_name FROM dd WHERE keep")
def _a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.dedup(kept(demo_alerts(spark, sf_dir), "alerts")).select("bus", "seq", "rule_name")


PROCESS_SQL = ALERT_SQL.replace("WITH frames", "WITH RECURSIVE frames", 1).replace(", al AS (", ", al0 AS (", 1) + ", al1 AS (SELECT *, concat('alert-', bus, '-', ts_us // 1000000, '-', lpad(CAST(row_number() OVER (PARTITION BY bus, ts_us // 1000000 ORDER BY ts_us, seq, rule_name) AS VARCHAR), 6, '0')) AS alert_id FROM al0), al AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bus, ts_us // 1000000 ORDER BY ts_us, seq, rule_name) AS nth FROM al1 WHERE level >= 2) WHERE nth <= 10)" + DEDUP_SQL


@query("A5_process", PROCESS_SQL + " SELECT dd.bus, dd.seq, dd.rule_name, dd.severity, alert_id FROM dd JOIN al USING (bus, seq, rule_name) WHERE keep")
def _a5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.process(kept(R.early_exit(demo_hits(spark, sf_dir)), "hits"), "rules", "MEDIUM").select("bus", "seq", "rule_name", "severity", "alert_id")


@query("A6_statistics", f"{ALERT_SQL} SELECT severity, source, rule_name, count(*) AS alerts, round(count(*) / ((max(ts_us) - min(ts_us)) / 3600000000), 4) AS per_hour FROM (SELECT *, 'rules' AS source FROM al) GROUP BY GROUPING SETS ((severity), (source), (rule_name), ())")
def _a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    # As SQL rounds: Spark's own round to places goes by a number's decimal digits, which differs for large rates.
    per_hour = F.round(F.col("per_hour") * 10_000) / 10_000
    return A.statistics(demo_alerts(spark, sf_dir)).select("severity", "source", "rule_name", "alerts", per_hour.alias("per_hour"))


@query("A6_dropped", f"{ALERT_SQL} SELECT count(*) AS received, count(*) FILTER (r <= 3) AS kept, count(*) FILTER (r > 3) AS dropped FROM (SELECT *, row_number() OVER (PARTITION BY bus, ts_us // 1000000 ORDER BY ts_us, seq, rule_name) AS r FROM al)")
def _a6d(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = kept(demo_alerts(spark, sf_dir), "alerts")
    return A.dropped(a, A.rate_limit(a, 3))


@query("A7_recent", f"{ALERT_SQL} SELECT bus, seq, rule_name FROM al ORDER BY ts_us DESC, seq DESC, rule_name LIMIT 50")
def _a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.recent(demo_alerts(spark, sf_dir), 50).select("bus", "seq", "rule_name")


@query("A7_by_severity", f"{ALERT_SQL} SELECT bus, seq, rule_name FROM al WHERE severity = 'HIGH' AND ts_us >= (SELECT max(ts_us) FROM al) - 36000000")
def _a7s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.by_severity(kept(demo_alerts(spark, sf_dir), "alerts"), "HIGH", 0.01).select("bus", "seq", "rule_name")


# --- evaluation -----------------------------------------------------------------

EV_SQL = f"{ALL_SQL}, e AS (SELECT *, time_delta < 0.4 AS pred, round(1 / (1 + time_delta), 3) AS score, len(data) = 4 AS rule_pred FROM i)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base_pred(frames(spark, sf_dir)).withColumn("score", F.round(1 / (1 + F.col("time_delta")), 3)).withColumn("rule_pred", (F.size("data") == 4).cast("int"))


@query("E1_confusion", f"{EV_SQL}, m AS (SELECT {CONF} FROM e) SELECT tp, fp, tn, fn, n, {RATES} FROM m")
def _e1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_plain(E.confusion(scored(spark, sf_dir)), ["tp", "fp", "tn", "fn", "n"], ["accuracy", "precision", "recall", "f1", "specificity", "fpr", "fnr", "npv"])


def rounded_plain(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.select(*keys, *(r6(F.col(c), c) for c in values))


@query("E2_by_attack_type", f"{EV_SQL}, m AS (SELECT attack_type, {CONF} FROM e GROUP BY attack_type), r AS (SELECT attack_type, n, {RATES} FROM m) SELECT attack_type, n AS samples, precision, recall, f1 FROM r")
def _e2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_plain(E.by_attack_type(scored(spark, sf_dir)), ["attack_type", "samples"], ["precision", "recall", "f1"])


@query("E3_roc", f"{EV_SQL}, p AS (SELECT score, count(*) FILTER (attack = 1) AS p, count(*) FILTER (attack <> 1) AS q FROM e GROUP BY score), c AS (SELECT score, sum(p) OVER (ORDER BY score DESC) / (SELECT sum(p) FROM p) AS tpr, sum(q) OVER (ORDER BY score DESC) / (SELECT sum(q) FROM p) AS fpr FROM p), d AS (SELECT *, (fpr - coalesce(lag(fpr) OVER (ORDER BY score DESC), 0)) * (tpr + coalesce(lag(tpr) OVER (ORDER BY score DESC), 0)) / 2 AS a FROM c) SELECT score, round(tpr + 1e-9, 6) AS tpr, round(fpr + 1e-9, 6) AS fpr, round(sum(a) OVER (ORDER BY score DESC) + 1e-9, 6) AS auc FROM d")
def _e3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.roc(scored(spark, sf_dir)).select("score", near("tpr"), near("fpr"), near("auc"))


@query("E4_detection_gaps", f"{EV_SQL}, g AS (SELECT bus, (ts_us - lag(ts_us) OVER {BUSW.format(rows='')}) / 1000000 AS gap FROM e WHERE pred) SELECT bus, {rsql('mean', 'median', 'min', 'max', 'std')}, gaps FROM (SELECT bus, avg(gap) AS mean, quantile_cont(gap, 0.5) AS median, min(gap) AS min, max(gap) AS max, stddev_pop(gap) AS std, count(gap) AS gaps FROM g WHERE gap IS NOT NULL GROUP BY bus)")
def _e4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.detection_gaps(scored(spark, sf_dir)).select("bus", *(near(c) for c in ("mean", "median", "min", "max", "std")), "gaps")


@query("E5_rate_over_time", f"{EV_SQL} SELECT bus, (ts_us - t0) // 60000000 AS \"window\", count(*) AS messages, count(*) FILTER (pred) AS detections, round(count(*) FILTER (pred) / count(*), 6) AS rate FROM (SELECT *, min(ts_us) OVER (PARTITION BY bus) AS t0 FROM e) GROUP BY 1, 2")
def _e5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_plain(E.rate_over_time(scored(spark, sf_dir)), ["bus", "window", "messages", "detections"], ["rate"])


def two_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    both = rows.select("attack", F.explode(F.array(F.struct(F.lit("interval").alias("model"), F.col("pred").alias("pred")), F.struct(F.lit("length").alias("model"), F.col("rule_pred").alias("pred")))).alias("m")).select("attack", "m.*")
    return E.confusion(both, by=["model"])


@query("E6_compare_models", f"{EV_SQL}, b AS (SELECT 'interval' AS model, attack, pred FROM e UNION ALL SELECT 'length', attack, rule_pred FROM e), m AS (SELECT model, {CONF} FROM b GROUP BY model), r AS (SELECT model, {RATES} FROM m), l AS (UNPIVOT (SELECT model, accuracy, precision, recall, f1, fpr, fnr FROM r) ON accuracy, precision, recall, f1, fpr, fnr INTO NAME metric VALUE value) SELECT metric, first(model ORDER BY CASE WHEN metric IN ('fpr', 'fnr') THEN value ELSE -value END, model) AS model FROM l GROUP BY metric")
def _e6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.compare_models(two_models(spark, sf_dir)).select("metric", "model")


@query("E7_assess", f"{EV_SQL}, b AS (SELECT 'interval' AS model, attack, pred FROM e UNION ALL SELECT 'length', attack, rule_pred FROM e), m AS (SELECT model, {CONF} FROM b GROUP BY model), r AS (SELECT model, {RATES} FROM m) SELECT model, CASE WHEN f1 >= 0.9 THEN 'Excellent' WHEN f1 >= 0.8 THEN 'Good' WHEN f1 >= 0.7 THEN 'Fair' ELSE 'Poor' END AS grade, CASE WHEN fpr > 0.05 THEN 'raise thresholds: many false alarms' WHEN recall < 0.8 THEN 'lower thresholds: attacks are missed' ELSE 'none' END AS advice FROM r")
def _e7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.assess(two_models(spark, sf_dir)).select("model", "grade", "advice")


@query("E8_stage_credit", f"{EV_SQL} SELECT CASE WHEN rule_pred THEN 'rules' WHEN pred THEN 'model' ELSE 'none' END AS stage, count(*) FILTER (attack = 1) AS attacks, count(*) FILTER (attack <> 1) AS normal FROM e GROUP BY 1")
def _e8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.stage_credit(scored(spark, sf_dir).withColumn("model_pred", F.col("pred")))


@query("E9_traffic_summary", f"{FRAMES_SQL} SELECT bus, count(*) AS messages, count(DISTINCT can_id) AS ids, round((max(ts_us) - min(ts_us)) / 1000000, 6) AS seconds, round(count(*) / ((max(ts_us) - min(ts_us)) / 1000000), 6) AS rate, max(ts_us) AS last_us FROM frames GROUP BY bus")
def _e9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_plain(X.traffic_summary(frames(spark, sf_dir)), ["bus", "messages", "ids", "last_us"], ["seconds", "rate"])


@query("E10_dataset_stats", f"{FRAMES_SQL}, t AS (SELECT vehicle, attack_type, count(*) AS n FROM frames GROUP BY ALL) SELECT vehicle, count(*) AS frames, CAST(sum(attack) AS BIGINT) AS attacks, count(DISTINCT can_id) AS ids, round((max(ts_us) - min(ts_us)) / 1000000, 6) AS seconds, (SELECT string_agg(concat(attack_type, '=', n), ',' ORDER BY attack_type) FROM t WHERE t.vehicle = f.vehicle) AS by_type FROM frames f GROUP BY vehicle")
def _e10(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.dataset_stats(frames(spark, sf_dir))
    text = F.array_join(F.transform(F.map_entries("by_type"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return s.select("vehicle", "frames", "attacks", "ids", r6(F.col("seconds"), "seconds"), text.alias("by_type"))


@query("E11_data_summary", f"{FRAMES_SQL} SELECT unnest(['seq', 'bus', 'source_id', 'attack_type']) AS \"column\", count(*) AS rows, unnest([count(*) - count(seq), count(*) - count(bus), count(*) - count(source_id), count(*) - count(attack_type)]) AS nulls FROM frames")
def _e11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.data_summary(frames(spark, sf_dir).select("seq", "bus", "source_id", "attack_type")).select("column", "rows", "nulls")


@query("E12_correlation", f"{ML_SQL} SELECT a, b, round(r, 5) AS r FROM (SELECT unnest(['time_delta', 'time_delta', 'dlc']) AS a, unnest(['dlc', 'hamming', 'hamming']) AS b, unnest([corr(time_delta, dlc), corr(time_delta, hamming), corr(dlc, hamming)]) AS r FROM h)")
def _e12(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.correlation(table(spark, sf_dir), COLS)
    order = F.array(*(F.lit(x) for x in COLS))
    return c.filter(F.array_position(order, F.col("a")) < F.array_position(order, F.col("b"))).select("a", "b", F.round("r", 5).alias("r"))


@query("E13_histogram", f"{ML_SQL}, m AS (SELECT min(hamming) AS a, max(hamming) AS b FROM h) SELECT signal, bin, round(a + (b - a) / 50 * bin, 6) AS low, n FROM (SELECT 'hamming' AS signal, CAST(least(floor((hamming - a) / (b - a) * 50), 49) AS INT) AS bin, count(*) AS n FROM h, m GROUP BY ALL), m")
def _e13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.histogram(table(spark, sf_dir), ["hamming"]).select("signal", "bin", r6(F.col("low"), "low"), "n")


# --- sources and sinks: written to the shared folder, read back ------------------


@query("S1_read_can_csv", f"{FRAMES_SQL} SELECT ts_us, can_id, array_to_string(data, ',') AS bytes, attack FROM frames")
def _s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "csv")
    frames(spark, sf_dir).select(F.format_string("%.6f", F.col("ts_us") / 1_000_000).alias("timestamp"), F.hex("can_id").alias("arbitration_id"), P.bytes_to_hex("data", "").alias("data_field"), "attack").write.option("header", True).csv(path)
    return io.read_can_csv(spark, path).select("ts_us", "can_id", joined(F.col("data")).alias("bytes"), "attack")


@query("S2_read_can_csv_padded", f"{FRAMES_SQL} SELECT ts_us, can_id, array_to_string({PAD}, ',') AS bytes FROM frames")
def _s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "csv")
    frames(spark, sf_dir).select(F.format_string("%.6f", F.col("ts_us") / 1_000_000).alias("timestamp"), F.concat(F.lit("0x"), F.hex("can_id")).alias("can_id"), P.bytes_to_hex("data").alias("Data"), F.col("attack").alias("Attack")).write.option("header", True).csv(path)
    return io.read_can_csv(spark, path, pad=True).select("ts_us", "can_id", joined(F.col("data")).alias("bytes"))


@query("S3_read_candump", f"{FRAMES_SQL} SELECT ts_us, bus, can_id, array_to_string(data, ',') AS bytes FROM frames")
def _s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "candump")
    frames(spark, sf_dir).select(F.format_string("(%.6f) %s %03X#%s", F.col("ts_us") / 1_000_000, F.col("bus"), F.col("can_id"), P.bytes_to_hex("data", ""))).write.text(path)
    return io.read_candump(spark, path).select("ts_us", "bus", "can_id", joined(F.col("data")).alias("bytes"))


@query("S6_read_frames_json", f"{FRAMES_SQL} SELECT ts_us, can_id, dlc, attack FROM frames")
def _s6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "json")
    frames(spark, sf_dir).select((F.col("ts_us") / 1_000_000).alias("timestamp"), "can_id", "dlc", "data", (F.col("attack") == 1).alias("is_attack")).write.json(path)
    return io.read_frames_json(spark, path, lines=True).select("ts_us", "can_id", "dlc", "attack")


@query("S4_read_candump_all", f"{FRAMES_SQL} SELECT CASE WHEN seq % 5 = 4 AND lag(seq) OVER (ORDER BY seq) IS NOT NULL THEN lag(ts_us) OVER (ORDER BY seq) + 1000 ELSE ts_us END AS ts_us, can_id, array_to_string(data, ',') AS bytes FROM frames WHERE seq > 0")
def _s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all three kinds in turn, in files that begin with a line with a time where there is one; a bare one has none."""
    path = fresh(spark, "candump")
    t, i = F.col("ts_us") / 1_000_000, F.col("can_id")
    standard = F.format_string("(%.6f) %s %03X#%s", t, F.col("bus"), i, P.bytes_to_hex("data", ""))
    detailed = F.format_string("%.6f %s %03X [%d] %s", t, F.col("bus"), i, F.size("data"), P.bytes_to_hex("data"))
    line = F.when(F.expr("seq % 5 = 4"), F.format_string("%03X#%s", i, P.bytes_to_hex("data", ""))).when(F.expr("seq % 2 = 0"), standard).otherwise(detailed)
    lines = frames(spark, sf_dir).filter("seq > 0").select("seq", line.alias("line"), F.col("seq").alias("ts_us"), F.lit(0).alias("_all"))
    lines = W.running_max(lines, {"_timed": F.when(F.expr("seq % 5 <> 4"), F.col("seq"))}, ("_all",), slab_us=1 << 16)
    lines.repartitionByRange(F.coalesce("_timed", F.lit(-1))).sortWithinPartitions("seq").select("line").write.text(path)
    return io.read_candump(spark, path, "all").select("ts_us", "can_id", joined(F.col("data")).alias("bytes"))


@query("S6_read_frames_json_array", f"{FRAMES_SQL} SELECT ts_us, can_id, dlc, attack FROM frames")
def _s6a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One array over several lines for each bus and id."""
    path = fresh(spark, "json")
    frame = F.struct((F.col("ts_us") / 1_000_000).alias("timestamp"), "can_id", "dlc", "data", (F.col("attack") == 1).alias("is_attack"))
    arrays = frames(spark, sf_dir).groupBy("bus", "can_id").agg(F.replace(F.to_json(F.collect_list(frame)), F.lit("},{"), F.lit("},\n{")).alias("value"))
    arrays.repartition("bus", "can_id").select("bus", F.col("can_id").alias("id"), "value").write.partitionBy("bus", "id").text(path)
    return io.read_frames_json(spark, path).select("ts_us", "can_id", "dlc", "attack")


NAMED = ("attack-free", "DoS", "fuzzing", "rpm", "other")


@query("S7_dataset_labels", f"{FRAMES_SQL} SELECT attack_type, vehicle, count(*) AS frames FROM (SELECT CASE seq % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'dos' WHEN 2 THEN 'fuzzing' WHEN 3 THEN 'rpm' ELSE 'unknown' END AS attack_type, CASE WHEN seq % 7 = 0 THEN 'unknown' ELSE concat('set_0', seq % 4, CASE seq % 3 WHEN 0 THEN '_train' WHEN 1 THEN '_known' ELSE '_unknown' END) END AS vehicle FROM frames) GROUP BY ALL")
def _s7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attack and vehicle from the paths of captures: the frames written as CSV files in folders, and all of them read."""
    kind = F.when(F.expr("seq % 3 = 0"), "train_01").when(F.expr("seq % 3 = 1"), "test_01_known_vehicle_known_attack").otherwise("test_02_unknown_vehicle_known_attack")
    folder = F.when(F.expr("seq % 7 = 0"), "plain").otherwise(F.concat(F.lit("set_0"), F.expr("cast(seq % 4 as string)"), F.lit("/"), kind))
    name = F.concat(folder, F.lit("/"), F.get(F.array(*map(F.lit, NAMED)), F.expr("cast(seq % 5 as int)")))
    line = F.concat_ws(",", F.format_string("%.6f", F.col("ts_us") / 1_000_000), F.hex("can_id"), P.bytes_to_hex("data", ""), F.col("attack").cast("string"))
    root = fresh(spark, "captures")
    write_lines(frames(spark, sf_dir).select(name.alias("name"), line.alias("line")), root, "timestamp,arbitration_id,data_field,attack")
    return io.read_dataset(spark, root).groupBy("attack_type", "vehicle").agg(F.count("*").alias("frames"))


def write_lines(lines: DataFrame, root: str, head: str) -> None:
    """Text files by ``name`` below a folder that all tasks share, one for each name and partition, each with a head line."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", root))
        number, files = TaskContext.get().partitionId(), {}
        for batch in batches:
            for name, line in zip(batch.column("name").to_pylist(), batch.column("line").to_pylist()):
                if name not in files:
                    system.create_dir(f"{base}/{name.rpartition('/')[0]}", recursive=True)
                    files[name] = system.open_output_stream(f"{base}/{name}-{number}.csv")
                    files[name].write(head.encode() + b"\n")
                files[name].write(line.encode() + b"\n")
        for file in files.values():
            file.close()
        yield pa.RecordBatch.from_pydict({"files": [len(files)]})

    lines.mapInArrow(write, "files long").agg(F.sum("files")).collect()


@query("S8_S11_rule_file", f"{BASE_SQL_RULES} SELECT concat(kind, ' 0x', lpad(hex(can_id), 3, '0')) AS name, can_id, expected_interval, consecutive_required, max_frequency FROM rules WHERE bus = 'v0'")
def _s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules generated from one bus, saved as a file (its limits with a fraction, and two bad rules among them), and loaded again."""
    rules = B.rules_from_profile(B.generate_rules(B.analyze(B.attack_free(frames(spark, sf_dir).filter("bus = 'v0'")))))
    path = fresh(spark, "rules") + ".yaml"
    written = [r | ({"max_frequency": r["max_frequency"] + 0.6} if "max_frequency" in r else {}) for r in rules]
    io.save_rules(spark, [{"name": "no severity"}, *written, {"name": "bad", "severity": "LOW", "max_frequency": "many"}], path, frames="v0")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", UserWarning)
        loaded = io.load_rules(spark, path)
    return loaded.select("name", "can_id", "expected_interval", "consecutive_required", "max_frequency")


@query("S9_write_csv", f"{ALERT_SQL} SELECT bus, seq, rule_name FROM al")
def _s9c(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "alerts")
    io.write_alerts(demo_alerts(spark, sf_dir).withColumn("nested", F.array("seq")), path, "csv")
    return spark.read.option("header", True).csv(path).select("bus", F.from_json("nested", "array<long>")[0].alias("seq"), "rule_name")


@query("S10_save_table", f"{FRAMES_SQL} SELECT vehicle, seq, can_id FROM frames")
def _s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "table")
    io.save_table(frames(spark, sf_dir), path, by="vehicle")
    return spark.read.parquet(path).select("vehicle", "seq", "can_id")


@query("S12_profile", ORACLE["B5_iat_stats"])
def _s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calibration saved and used again."""
    path = fresh(spark, "profile")
    io.save_profile(C.iat_stats(normal(spark, sf_dir)), path)
    return rounded(io.load_profile(spark, path), ["bus", "can_id", "n"], ["iat_mean", "iat_std", "iat_p5", "iat_p95"])


WA_SQL = PROCESS_SQL + f", e AS (SELECT frames.*, EXISTS (SELECT 1 FROM dd WHERE keep AND dd.bus = frames.bus AND dd.seq = frames.seq) AS pred FROM frames), m AS (SELECT attack_type, {CONF} FROM e GROUP BY GROUPING SETS ((attack_type), ()))"


@query("W_A_detect_and_measure", f"{WA_SQL} SELECT coalesce(attack_type, 'all') AS attack_type, tp, fp, tn, fn, {RATES} FROM m")
def _wa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main work in one: captures from files, a rule file, alerts with limits, and how well they tell attacks, in all and by type."""
    captures, file = fresh(spark, "captures"), fresh(spark, "rules") + ".yaml"
    io.save_table(frames(spark, sf_dir), captures)
    io.save_rules(spark, DEMO_RULES, file)
    f = spark.read.parquet(captures)
    found = A.process(kept(R.early_exit(R.evaluate(f, io.load_rules(spark, file))), "hits"), "rules", "MEDIUM")
    rows = f.join(found.select("bus", "seq").distinct().withColumn("pred", F.lit(1)), ["bus", "seq"], "left")
    both = rows.select("attack", "pred", F.explode(F.array(F.lit("all"), "attack_type")).alias("attack_type"))
    return rounded_plain(E.confusion(both, by=["attack_type"]).drop("n"), ["attack_type", "tp", "fp", "tn", "fn"], ["accuracy", "precision", "recall", "f1", "specificity", "fpr", "fnr", "npv"])


@query("S9_S12_write_read", f"{ALERT_SQL} SELECT bus, seq, rule_name FROM al")
def _s9(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "alerts")
    io.write_alerts(demo_alerts(spark, sf_dir), path)
    return spark.read.json(path).select("bus", "seq", "rule_name")


# --- streams --------------------------------------------------------------------


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames as a stream of three batches: written as files in the frame schema, a third of the time each, then read one by one."""
    f = frames(spark, sf_dir)
    first, last = f.agg(F.min("ts_us"), F.max("ts_us")).first()
    third = F.least(F.lit(2), F.expr(f"(ts_us - {first or 0}) * 3 div {(last or 0) - (first or 0) + 1}"))
    path, files = in_batches(f, third, 3)
    return S.read_frames(spark, path, per_batch=files)


#: Rows of a file of a stream.
FILE_ROWS = 1 << 18


def in_batches(f: DataFrame, number: Column, count: int) -> tuple[str, int]:
    """The folder of ``f`` as stream frames, in ``count`` batches written one after the other by batch number, and the files of a batch."""
    rows = kept(f.withColumn("ts", F.timestamp_micros("ts_us")).withColumn("source_file", F.lit(None).cast("string")).withColumn("_batch_no", number), "frames")
    return written_as([rows.filter(F.col("_batch_no") == k).drop("_batch_no") for k in range(count)], rows.count())


def written_as(batches: list[DataFrame], rows: int) -> tuple[str, int]:
    """A folder to which batches of ``rows`` rows in all are written one after the other, each in as many files, and this number; a batch of few rows has empty ones."""
    spark = batches[0].sparkSession
    path, files = fresh(spark, "batches"), max(1, -(-rows // (FILE_ROWS * len(batches))))
    there = 0
    for batch in batches:
        (batch.coalesce(1) if files == 1 else batch.repartition(files)).write.mode("append").parquet(path)
        missing = there + files - len(spark.read.schema(batch.schema).parquet(path).inputFiles())
        for _ in range(missing):
            spark.createDataFrame([], batch.schema).coalesce(1).write.mode("append").parquet(path)
        there += files
    return path, files


LATE_BATCHES, LATE_SLAB = 8, "(ts_us - (SELECT min(ts_us) FROM frames)) * 8 // ((SELECT max(ts_us) - min(ts_us) FROM frames) + 1)"


@query("T11_late_frames", f"""{FRAMES_SQL}, b AS (SELECT *, least(7, {LATE_SLAB} + CASE WHEN seq % 23 = 0 THEN 3 ELSE 0 END) AS k FROM frames),
    m AS (SELECT k, max(max(ts_us) // 1000 - 5000) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS mark FROM b GROUP BY k)
    SELECT bus, seq, (SELECT count(*) FROM b JOIN m USING (k) WHERE ts_us <= mark * 1000) AS late FROM b JOIN m USING (k) WHERE mark IS NULL OR ts_us > mark * 1000""")
def _t11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames in eight batches, some of them three batches late: those that rules see, and how many were too late. Spark judges a batch by the watermark that held in the one before."""
    f = frames(spark, sf_dir)
    first, last = f.agg(F.min("ts_us"), F.max("ts_us")).first()
    number = F.least(F.lit(LATE_BATCHES - 1), F.expr(f"(ts_us - {first or 0}) * {LATE_BATCHES} div {(last or 0) - (first or 0) + 1}") + F.when(F.col("seq") % 23 == 0, 3).otherwise(0))
    rules = R.rules_frame(spark, [{"name": "again", "severity": "LOW", "check_replay": True}])
    path, files = in_batches(f, number, LATE_BATCHES)
    rows, late = S.count_late(S.enrich(S.read_frames(spark, path, per_batch=files), rules, drop_late=True))
    return rows.select("bus", "seq", F.lit(late).cast("long").alias("late"))


@query("T2_T3_detect_rules", f"{HITS_SQL} SELECT bus, seq, rule_name FROM flat WHERE rule_name <> 'flood'")
def _t23(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = R.rules_frame(spark, [r for r in DEMO_RULES if r["name"] != "flood"])
    return S.drain(S.detect_rules(S.enrich(stream(spark, sf_dir), rules), rules), "hits").select("bus", "seq", "rule_name")


@query("T4_prefilter", f"{DET_SQL}, {PRE_SQL} SELECT bus, seq, suspicious FROM pre")
def _t4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drain(S.prefilter(stream(spark, sf_dir), kept(C.prefilter_intervals(trained(spark, sf_dir)), "expected")), "prefilter")


@query("T5_global_rate", f"{FRAMES_SQL}, w AS (SELECT bus, unnest(range(ts_us // 100000 - 9, ts_us // 100000 + 1)) * 100000 AS start_us FROM frames) SELECT bus, start_us, count(*) AS frames FROM w GROUP BY ALL HAVING count(*) > 25")
def _t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(S.drain(S.global_rate(stream(spark, sf_dir), 25), "rate", "update"), ["bus", "start_us"], ["frames"])


def latest(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.max_by(v, "_batch").alias(v) for v in values))


@query("T6_dos_window", f"{FRAMES_SQL} SELECT bus, can_id, ts_us // 2000000 * 2000000 AS start_us, count(*) AS frames FROM frames GROUP BY ALL HAVING count(*) > 5")
def _t6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(S.drain(S.dos_window(stream(spark, sf_dir), 5, "2 seconds"), "dos", "update"), ["bus", "can_id", "start_us"], ["frames"])


@query("T7_bursts", f"{FRAMES_SQL}, g AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER {BUSW.format(rows='')} <= 20000 THEN 0 ELSE 1 END AS new FROM frames), r AS (SELECT *, sum(new) OVER {BUSW.format(rows='')} AS run FROM g) SELECT bus, min(ts_us) AS start_us, count(*) AS frames FROM r GROUP BY bus, run HAVING count(*) >= 3 AND max(ts_us) + 20000 <= ((SELECT max(ts_us) FROM frames) // 1000 - 5000) * 1000")
def _t7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drain(S.bursts(stream(spark, sf_dir), "20 milliseconds", 3), "bursts")


@query("T8_dedup_alerts", ALERT_SQL.replace("WITH frames", "WITH RECURSIVE frames", 1) + DEDUP_SQL + " SELECT bus, seq, rule_name FROM dd WHERE keep")
def _t8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kept(demo_alerts(spark, sf_dir).withColumn("ts", F.timestamp_micros("ts_us")), "alerts")
    middle = (found.agg(F.max("ts_us")).first()[0] or 0) // 2
    path, files = written_as([found.filter(part) for part in (F.col("ts_us") < middle, F.col("ts_us") >= middle)], found.count())
    alerts = spark.readStream.schema(found.schema).option("maxFilesPerTrigger", files).parquet(path).withWatermark("ts", S.LATENESS)
    return S.drain(S.dedup_alerts(alerts), "dedup").select("bus", "seq", "rule_name")


@query("T9_traffic_monitor", f"{FRAMES_SQL} SELECT bus, ts_us // 10000000 * 10000000 AS start_us, count(*) AS messages, round(count(*) / 10, 6) AS rate FROM frames GROUP BY ALL")
def _t9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = latest(S.drain(S.traffic_monitor(stream(spark, sf_dir)), "traffic", "update"), ["bus", "start_us"], ["messages", "rate"])
    return out.select("bus", "start_us", "messages", r6(F.col("rate"), "rate"))


@query("T1_candump_stream", f"{FRAMES_SQL} SELECT ts_us, bus, can_id, array_to_string(data, ',') AS bytes FROM frames")
def _t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "candump")
    frames(spark, sf_dir).select(F.format_string("(%.6f) %s %03X#%s", F.col("ts_us") / 1_000_000, F.col("bus"), F.col("can_id"), P.bytes_to_hex("data", ""))).write.text(path)
    return S.drain(S.read_frames(spark, path, "candump"), "frames").select("ts_us", "bus", "can_id", joined(F.col("data")).alias("bytes"))


@query("T1_T10_write_alerts", f"{FRAMES_SQL} SELECT bus, seq FROM frames WHERE dlc < 6")
def _t10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "sink")
    S.write_alerts(stream(spark, sf_dir).filter(R.validate_dlc(6)).select("bus", "seq"), path, fresh(spark, "sink-checkpoint"), once=True).awaitTermination()
    return spark.read.schema("bus string, seq long").json(path)


@query("S5_pcap_ranges", f"{FRAMES_SQL} SELECT ts_us, can_id, is_remote, is_error, array_to_string(data, ',') AS bytes FROM frames")
def _s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames written as captures, and read in ranges of a few thousand bytes each."""
    path = fresh(spark, "pcap")
    pcap.write_pcap(frames(spark, sf_dir).repartition(3, "bus"), path)
    f = pcap.read_pcap_ranges(spark, path, 50_000)
    return f.select("ts_us", "can_id", "is_remote", "is_error", joined(F.col("data")).alias("bytes"))
