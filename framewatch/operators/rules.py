"""Signature rules over frames: scope, stateless and stateful checks, evaluation, early exit, figures.

A check is an expression that is true where the rule is violated. Its parameters
may be Python values or columns (of a joined rule), null where a rule leaves them unset.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewatch.functions import payload as P
from framewatch.functions.frames import diagnostic_source, is_diagnostic
from framewatch.operators import hot
from framewatch.operators import windows as W
from framewatch.schema import RULE_FIELDS, RULE_SCHEMA
from framewatch.storage import kept


def _v(x: Any) -> Column:
    """A Python value (lists and maps too) or a column as a column."""
    if isinstance(x, Column):
        return x
    if isinstance(x, dict):
        return F.create_map(*(y for k, v in x.items() for y in (_v(k), _v(v)))) if x else F.lit(None)
    if isinstance(x, (list, tuple)):
        return F.array(*(_v(y) for y in x))
    return F.lit(x)


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


# --- stateless checks ---------------------------------------------------------


def check_id_range(low: Any, high: Any) -> Column:
    return _true(F.col("can_id") < _v(low)) | _true(F.col("can_id") > _v(high))


def check_payload_pattern(kinds: Any) -> Column:
    """Constant or counting payload; an empty payload is all of these."""
    kinds, d = _v(kinds), F.col("data")
    has = lambda k: _true(F.array_contains(kinds, k))
    return (has("all_zeros") & P.is_all_zeros(d)) | (has("all_ones") & P.is_all_ones(d)) | (has("sequential") & P.is_sequential(d))


def check_known_ids(known: Any, consecutive_required: Any = None) -> Column:
    """An id that is not in the list; never where more than one in a row is asked for."""
    return _true(~F.array_contains(_v(known), F.col("can_id"))) & (F.coalesce(_v(consecutive_required), F.lit(1)) <= 1)


def check_dlc_by_id(expected: Any) -> Column:
    return _true(F.try_element_at(_v(expected), F.col("can_id")) != F.col("dlc"))


def check_entropy(limit: Any) -> Column:
    return _true(P.entropy("data") > _v(limit))


def check_byte_ranges(ranges: Any) -> Column:
    """Any configured byte of the id outside its range; bytes that the payload lacks are skipped."""
    own = F.try_element_at(_v(ranges), F.col("can_id"))
    byte = lambda e: F.try_element_at(F.col("data"), e["key"] + 1)
    return _true(F.exists(F.map_entries(own), lambda e: _true((byte(e) < e["value"][0]) | (byte(e) > e["value"][1]))))


def validate_dlc(low: Any = None, high: Any = None) -> Column:
    d = F.col("dlc")
    return ~d.between(0, 8) | (d != F.size("data")) | _true(d < _v(low)) | _true(d > _v(high))


def dlc_bounds(low: Any, high: Any) -> Column:
    return _true(F.col("dlc") < _v(low)) | _true(F.col("dlc") > _v(high))


def check_frame_format() -> Column:
    long = F.when(F.col("is_extended"), F.col("can_id") > 0x1FFFFFFF).otherwise(F.col("can_id") > 0x7FF)
    return long | ~F.col("dlc").between(0, 8) | (F.size("data") != F.col("dlc")) | _true(F.col("is_error")) | (_true(F.col("is_remote")) & (F.size("data") > 0))


def check_data_bytes(*want: Any) -> Column:
    """Any set byte missing or different."""
    bad = F.lit(False)
    for i, x in enumerate(want):
        bad = bad | (_v(x).isNotNull() & ~_true(F.try_element_at(F.col("data"), F.lit(i + 1)) == _v(x)))
    return bad


def check_integrity(offset: Any = None) -> Column:
    return ~P.xor_checksum_ok("data", _v(offset))


def check_steering(low: Any, high: Any) -> Column:
    angle = P.steering_angle("data")
    return angle.isNull() | _true(angle < _v(low)) | _true(angle > _v(high))


def check_frame_type(kind: Any) -> Column:
    extended = _true(F.col("is_extended"))
    want = F.lower(_v(kind)) == "extended"
    return _true(extended != want) | (~extended & (F.col("can_id") > 0x7FF)) | (extended & (F.col("can_id") > 0x1FFFFFFF))


# --- state --------------------------------------------------------------------


def add_state(frames: DataFrame, sources: bool = True, memory_us: int | None = None) -> DataFrame:
    """Adds what the stateful checks read: times, run lengths, counters and repeats of the frame's id, and distinct sources so far.

    One shuffle by (bus, can_id) serves all windows; repeats of a payload are
    clustered by it already and need another sort only. A payload that the id has not
    sent for longer than ``memory_us`` is new again (None: it never is).
    """
    w = W.by_id()
    hexed = frames.withColumn("_payload", P.bytes_to_hex("data", ""))
    same = F.col("_payload") == F.lag("_payload").over(w)
    out = hexed.withColumns({
        "_n": F.row_number().over(w),
        "interval_ms": (F.col("ts_us") - F.lag("ts_us").over(w)) / 1000,
        "_same": F.coalesce(same, F.lit(False)),
        "_nibble": F.try_element_at("data", F.lit(1)).bitwiseAND(F.lit(15)),
    })
    before = F.last("_nibble", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = out.withColumn("_counter_before", F.coalesce(before, F.lit(0)))
    out = W.run_length(F.col("_same"), w, ["bus", "can_id"], out, "_run_length").drop("_same")
    again = Window.partitionBy("bus", "can_id", "_payload").orderBy(*W.ORDER)
    out = out.withColumn("_gap_us", F.col("ts_us") - F.lag("ts_us").over(again)).withColumn("_repeats", F.row_number().over(again) - 1)
    if memory_us is not None:
        anew = F.col("_gap_us").isNull() | (F.col("_gap_us") > memory_us)
        since = F.max(F.when(anew, F.col("_repeats"))).over(again.rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumns({"_repeats": F.col("_repeats") - since, "_gap_us": F.when(~anew, F.col("_gap_us"))})
    if sources:
        out = out.withColumn("_source", diagnostic_source())
        earlier = F.row_number().over(Window.partitionBy("bus", "can_id", "_source").orderBy(*W.ORDER))
        out = out.withColumn("_first", (F.col("_source").isNotNull() & (earlier == 1)).cast("int"))
        out = out.withColumn("_sources", F.sum("_first").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_first")
    return out


def state_by_id(frames: DataFrame, sources: bool = True, memory_us: int | None = None, history: int = 0, backs: list[int] | None = None, hot_rows: int = hot.HOT_ROWS) -> DataFrame:
    """``add_state``, ``timing_history`` of ``history`` rows (if any) and ``_back_n``, the time n - 1 frames before, for each n of ``backs``.

    Ids are counted first; those with more than ``hot_rows`` frames are taken in segments
    (``hot.segmented_state``), the others by plain windows, with the same results.
    """
    backs = backs or []

    def plain(rows: DataFrame) -> DataFrame:
        out = add_state(rows, sources, memory_us)
        if history:
            out = timing_history(out, history)
        return out.withColumns({f"_back_{n}": F.lag("ts_us", n - 1).over(W.by_id()) for n in backs}) if backs else out

    found = kept(hot.hot_ids(frames, hot_rows), "hot")
    if found.isEmpty():
        return plain(frames)
    marked = W.null_safe(frames, found.withColumn("_hot", F.lit(1)), ["bus", "can_id"], "left")
    busy, rest = (marked.filter(c).drop("_hot") for c in ("_hot = 1", "_hot is null"))
    return plain(rest).unionByName(hot.segmented_state(busy, sources, memory_us, history, backs))


def check_frequency(max_frequency: int, window_s: float) -> Column:
    """``max_frequency`` frames of the id within ``window_s``; over frames, not on joined rules."""
    return _true(F.col("ts_us") - F.lag("ts_us", max_frequency - 1).over(W.by_id()) <= window_s * 1_000_000)


def check_global_rate(frames: DataFrame, limit: int, window_s: float = 1.0, out: str = "global_rate") -> DataFrame:
    """Adds ``out``: more than ``limit`` frames of the bus within the last ``window_s``."""
    counted = W.trailing_count(frames, int(window_s * 1_000_000), "_rate")
    return counted.withColumn(out, F.col("_rate") > limit).drop("_rate")


def timing_history(frames: DataFrame, most: int) -> DataFrame:
    """Adds the last ``most`` intervals (ms) and payloads of the id, oldest first."""
    w = W.by_id().rowsBetween(-(most - 1), 0)
    return frames.withColumn("_intervals", F.collect_list("interval_ms").over(w)).withColumn("_payloads", F.collect_list("_payload").over(w))


def check_timing(expected: Any, sd: Any, sigma_extreme: Any = None, sigma_moderate: Any = None, required: Any = None, repetition: Any = None) -> Column:
    """Three tiers on add_state and timing_history: an extreme interval; else N of the last N + 2 moderately off and, if asked for, one payload repeated in that share of them."""
    expected, sd = _v(expected), _v(sd)
    extreme = F.coalesce(_v(sigma_extreme), F.lit(3.0)) * sd
    moderate = F.coalesce(_v(sigma_moderate), F.lit(1.5)) * sd
    n = F.coalesce(_v(required), F.lit(5))
    now = F.col("interval_ms")
    tier1 = (now < F.greatest(F.lit(0.0), expected - extreme)) | (now > expected + extreme)
    last = lambda c: F.slice(c, F.greatest(F.size(c) - n - 1, F.lit(1)), n + 2)
    low, high = F.greatest(F.lit(0.0), expected - moderate), expected + moderate
    off = F.size(F.filter(last(F.col("_intervals")), lambda x: (x < low) | (x > high)))
    payloads = last(F.col("_payloads"))
    modal = F.array_max(F.transform(F.array_distinct(payloads), lambda p: F.size(F.filter(payloads, lambda q: q == p))))
    tier3 = F.coalesce(modal / F.size(payloads) >= _v(repetition), F.lit(True))
    usable = (expected != 0) & (sd != 0) & (F.col("_n") >= 3)
    return _true(usable & (tier1 | ((F.col("_n") - 1 >= n + 2) & (off >= n) & tier3)))


def check_replay(threshold_s: Any = 1.0) -> Column:
    """On add_state: the same payload of the id again within the threshold, in under 0.1 s or for the third time at least."""
    gap = F.col("_gap_us")
    limit = F.coalesce(_v(threshold_s), F.lit(1.0)) * 1_000_000
    return _true((gap < limit) & ((gap < 100_000) | (F.col("_repeats") >= 3)))


def replay_exact(frames: DataFrame, threshold_s: float = 1.0) -> DataFrame:
    """Adds ``replay``, as a monitor sees it that keeps an alerting frame out of its memory: the gap counts from the last frame that didn't alert.

    A scan in order, times and payload hashes only; a payload's frames of one id on one bus go to one task.
    """
    limit = threshold_s * 1e6

    def scan(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["ts_us", "seq"], kind="stable")
        flags, memory = np.zeros(len(part), bool), {}
        for i, (p, t) in enumerate(zip(part["_hash"].tolist(), part["ts_us"].tolist())):
            kept, count = memory.get(p, (None, -1))
            count += 1
            if kept is not None:
                gap = t - kept
                flags[i] = gap < limit and (count >= 3 or gap < 100_000)
            memory[p] = (kept if flags[i] else t, count)
        return part[keys].assign(replay=flags)

    keys = ["bus", "can_id", "_hash", "ts_us", "seq", "_copy"]
    rows = W.copies(frames.withColumn("_hash", F.xxhash64(P.bytes_to_hex("data", ""))), keys[:-1])
    slim = rows.select(*keys, F.pmod("_hash", F.lit(16)).alias("_part"))
    marked = slim.groupBy("bus", "can_id", "_part").applyInPandas(scan, "bus string, can_id int, _hash long, ts_us long, seq long, _copy int, replay boolean")
    return W.null_safe(rows, marked, keys).drop("_hash", "_copy")


def check_repetition(threshold: Any = 10) -> Column:
    """On add_state: a run of identical payloads of the id longer than the threshold."""
    return F.col("_run_length") > F.coalesce(_v(threshold), F.lit(10))


def check_counter() -> Column:
    """On add_state: low four bits of the first byte not one more (modulo 16) than in the last frame with data; the first expects 1."""
    return _true(F.col("_nibble") != (F.col("_counter_before") + 1) % 16)


def check_source(allowed: Any = None) -> Column:
    """On add_state: a diagnostic frame from a source that is not allowed (an empty list allows all), or after more than three sources of its id."""
    allowed = _v(allowed)
    banned = (F.size(allowed) > 0) & ~F.array_contains(allowed, F.col("_source"))
    return _true(is_diagnostic()) & (_true(banned) | _true(F.col("_sources") > 3))


# --- rules as a table ---------------------------------------------------------


def typed(value: Any, kind: T.DataType) -> Any:
    """A value of a rule file as its field's type: numbers are cut to integers where these are asked for. Raises where it can't be."""
    if value is None:
        return None
    if isinstance(kind, T.ArrayType):
        return [typed(v, kind.elementType) for v in value]
    if isinstance(kind, T.MapType):
        return {typed(k, kind.keyType): typed(v, kind.valueType) for k, v in value.items()}
    if isinstance(kind, T.IntegerType):
        return int(value)
    return float(value) if isinstance(kind, T.DoubleType) else bool(value) if isinstance(kind, T.BooleanType) else str(value)


def rule_row(rule: dict[str, Any]) -> tuple:
    """The fields of a rule in order; unset ones are null, priority is 5. ``pattern_types`` may be a list or a map. Raises for a field that is not known or not of its type."""
    unknown = set(rule) - set(RULE_FIELDS)
    if unknown:
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    full = {k: typed(rule.get(k), kind) for k, kind in RULE_FIELDS.items()}
    return tuple((full | {"priority": 5 if full["priority"] is None else full["priority"]}).values())


def rules_frame(spark: SparkSession, rules: list[dict[str, Any]]) -> DataFrame:
    """A rule table from dicts with the fields of RULE_SCHEMA (see ``rule_row``)."""
    return spark.createDataFrame([(i, *rule_row(r)) for i, r in enumerate(rules)], RULE_SCHEMA)


def match_scope(frames: DataFrame, rules: DataFrame) -> DataFrame:
    """(bus, seq, rule_no) of every frame and rule whose scope holds it: exact id, else id range, else (whitelist mode) not an allowed id, else all.

    Rules are few (hundreds); their three kinds are broadcast.
    """
    f = frames.select("bus", "seq", F.col("can_id").alias("_id"))
    exact = f.join(F.broadcast(rules.filter("can_id is not null").select("rule_no", "can_id")), F.col("_id") == F.col("can_id")).drop("can_id")
    ranged = rules.filter("can_id is null and can_id_range is not null").select("rule_no", F.col("can_id_range")[0].alias("_low"), F.col("can_id_range")[1].alias("_high"))
    in_range = f.join(F.broadcast(ranged), F.col("_id").between(F.col("_low"), F.col("_high"))).drop("_low", "_high")
    rest = rules.filter("can_id is null and can_id_range is null").select("rule_no", F.when(F.col("whitelist_mode") & (F.size("allowed_can_ids") > 0), F.col("allowed_can_ids")).alias("_allowed"))
    anywhere = f.join(F.broadcast(rest), F.coalesce(~F.array_contains("_allowed", F.col("_id")), F.lit(True))).drop("_allowed")
    return exact.unionByName(in_range).unionByName(anywhere).select("bus", "seq", "rule_no")


def fired(p: Callable[[str], Column], rate: Column, frequency: Column, has: Callable[[str], bool] = lambda name: True) -> Column:
    """Whether a rule alerts on a frame: any check before the content gate, or the gate and any check after it.

    A rule with a content match and no check after it alerts on the match itself.
    ``has`` tells which fields any of the rules sets; checks of others are left out.
    """
    on = lambda name: _true(p(name))
    set_ = lambda name: p(name).isNotNull()
    listed = lambda: on("whitelist_mode") & _true(F.size(p("allowed_can_ids")) > 0)
    before: dict[str, Callable[[], Column]] = {
        "check_can_id_range": lambda: on("check_can_id_range") & check_id_range(p("min_can_id"), p("max_can_id")),
        "check_payload_pattern": lambda: on("check_payload_pattern") & check_payload_pattern(p("pattern_types")),
        "check_can_id_whitelist": lambda: on("check_can_id_whitelist") & check_known_ids(p("known_ids"), p("consecutive_required")),
        "check_dlc_validity": lambda: on("check_dlc_validity") & check_dlc_by_id(p("expected_dlc_by_id")),
        "check_entropy": lambda: on("check_entropy") & check_entropy(p("min_entropy")),
        "check_byte_ranges": lambda: on("check_byte_ranges") & check_byte_ranges(p("byte_ranges_by_id")),
        "validate_dlc": lambda: on("validate_dlc") & validate_dlc(p("dlc_min"), p("dlc_max")),
        "check_frame_format": lambda: on("check_frame_format") & check_frame_format(),
        "global_message_rate": lambda: set_("global_message_rate") & rate,
        "check_source": lambda: on("check_source") & check_source(p("allowed_sources")),
        "check_replay": lambda: on("check_replay") & check_replay(p("replay_time_threshold")),
        **{f"data_byte_{i}": lambda i=i: set_(f"data_byte_{i}") & ~_true(F.try_element_at(F.col("data"), F.lit(i + 1)) == p(f"data_byte_{i}")) for i in range(8)},
        "check_data_integrity": lambda: on("check_data_integrity") & check_integrity(p("integrity_checksum_offset")),
        "check_steering_range": lambda: on("check_steering_range") & check_steering(p("steering_min"), p("steering_max")),
        "check_repetition": lambda: on("check_repetition") & check_repetition(p("repetition_threshold")),
        "frame_type": lambda: set_("frame_type") & check_frame_type(p("frame_type")),
        "dlc_min": lambda: ~on("validate_dlc") & dlc_bounds(p("dlc_min"), p("dlc_max")),
        "dlc_max": lambda: ~on("validate_dlc") & dlc_bounds(p("dlc_min"), p("dlc_max")),
    }
    after: dict[str, Callable[[], Column]] = {
        "max_frequency": lambda: set_("max_frequency") & frequency,
        "check_timing": lambda: on("check_timing") & check_timing(*(p(c) for c in ("expected_interval", "interval_variance", "sigma_extreme", "sigma_moderate", "consecutive_required", "payload_repetition_threshold"))),
        "check_counter": lambda: on("check_counter") & check_counter(),
        "entropy_threshold": lambda: check_entropy(p("entropy_threshold")),
        "whitelist_mode": lambda: listed() & ~F.array_contains(p("allowed_can_ids"), F.col("can_id")),
    }
    asked: dict[str, Callable[[], Column]] = {
        "max_frequency": lambda: set_("max_frequency"), "check_timing": lambda: on("check_timing"), "check_counter": lambda: on("check_counter"), "entropy_threshold": lambda: set_("entropy_threshold"), "whitelist_mode": listed,
    }
    any_of = lambda checks: functools.reduce(lambda a, b: a | b, [make() for name, make in checks.items() if has(name)], F.lit(False))
    gate, content = F.lit(True), F.lit(False)
    if has("data_pattern"):
        gate, content = gate & F.coalesce(P.matches_pattern("data", p("data_pattern")), F.lit(True)), content | set_("data_pattern")
    if has("data_contains"):
        gate, content = gate & F.coalesce(P.contains_any("data", p("data_contains")), F.lit(True)), content | _true(F.size(p("data_contains")) > 0)
    return any_of(before) | (gate & ((content & ~any_of(asked)) | any_of(after)))


def literal(rule: Row) -> Callable[[str], Column]:
    kinds = dict(RULE_FIELDS)
    return lambda name: _v(rule[name]).cast(kinds[name]) if rule[name] is not None else F.lit(None).cast(kinds[name])


def sets(*rules: Row) -> Callable[[str], bool]:
    """Whether any of the rules sets a field to something."""
    return lambda name: any(r[name] not in (None, False) and r[name] != [] and r[name] != {} for r in rules)


def confidence(p: Callable[[str], Column]) -> Column:
    """0.5, and 0.3 for a pattern, 0.2 for a frequency limit, 0.2 for critical severity; 1 at most."""
    return F.least(F.lit(1.0), 0.5 + F.when(p("data_pattern").isNotNull(), 0.3).otherwise(0.0) + F.when(p("max_frequency").isNotNull(), 0.2).otherwise(0.0) + F.when(p("severity") == "CRITICAL", 0.2).otherwise(0.0))


def _scope(rule: Row) -> Column | None:
    """The frames that a rule is for; None: all."""
    if rule.can_id is not None:
        return F.col("can_id") == rule.can_id
    if rule.can_id_range:
        return F.col("can_id").between(*rule.can_id_range)
    return ~F.col("can_id").isin(*rule.allowed_can_ids) if rule.whitelist_mode and rule.allowed_can_ids else None


def evaluate(frames: DataFrame, rules: DataFrame, memory_us: int | None = None) -> DataFrame:
    """One row for each frame and rule that alerts: bus, seq, ts_us, can_id, dlc, data, rule_no, rule_name, severity, priority, description, action, confidence, is_global.

    State is computed once and read once. Rules for one id are joined by a broadcast
    on it (a frame without any stays); others become expressions over each frame (the
    first of its joined rows), and only hits are exploded, so no rule multiplies the frames.
    """
    known = rules.orderBy("rule_no").collect()
    history = max((0, *((r.consecutive_required or 5) + 2 for r in known if r.check_timing)))
    state = state_by_id(frames, any(r.check_source for r in known), memory_us, history, sorted({r.max_frequency for r in known if r.max_frequency}))
    if not history:
        state = state.withColumn("_intervals", F.array().cast("array<double>")).withColumn("_payloads", F.array().cast("array<string>"))
    rate_of: dict[int, str] = {}
    for r in known:
        if r.global_message_rate:
            width = int((r.time_window or 1.0) * 1_000_000)
            rate_of[r.rule_no] = f"_rate_{r.rule_no}"
            state = W.trailing_count(state, width, rate_of[r.rule_no], where=_scope(r))

    def row(p: Callable[[str], Column], number: Column, is_global: bool) -> Column:
        return F.struct(number.alias("rule_no"), p("name").alias("rule_name"), p("severity").alias("severity"), p("priority").alias("priority"), p("description").alias("description"), p("action").alias("action"), confidence(p).alias("confidence"), F.lit(is_global).alias("is_global"))

    hits = []
    for r in known:
        if r.can_id is not None:
            continue
        p = literal(r)
        scope = F.lit(True) if _scope(r) is None else _scope(r)
        rate = _true(F.col(rate_of[r.rule_no]) > r.global_message_rate) if r.rule_no in rate_of else F.lit(False)
        frequency = _true(F.col("ts_us") - F.col(f"_back_{r.max_frequency}") <= (r.time_window or 1.0) * 1_000_000) if r.max_frequency else F.lit(False)
        hits.append((scope & fired(p, rate, frequency, sets(r)), row(p, F.lit(r.rule_no), True)))
    frame = ["bus", "seq", "ts_us", "can_id", "dlc", "data"]
    if any(r.can_id is not None for r in known):
        first = F.row_number().over(Window.partitionBy("can_id").orderBy("rule_no")) == 1
        own = rules.filter("can_id is not null").select(F.col("can_id").alias("_rule_id"), first.alias("_first"), F.struct(*rules.columns).alias("r"))
        p = lambda name: F.col(f"r.{name}")
        state = state.join(F.broadcast(own), F.col("can_id") == F.col("_rule_id"), "left")
        hits = [(F.coalesce("_first", F.lit(True)) & hit, alert) for hit, alert in hits]
        rate = F.lit(False)
        for r in known:
            if r.can_id is not None and r.rule_no in rate_of:
                rate = rate | ((p("rule_no") == r.rule_no) & _true(F.col(rate_of[r.rule_no]) > p("global_message_rate")))
        frequency = F.lit(False)
        for n in sorted({r.max_frequency for r in known if r.can_id is not None and r.max_frequency}):
            frequency = frequency | ((p("max_frequency") == n) & _true(F.col("ts_us") - F.col(f"_back_{n}") <= F.coalesce(p("time_window"), F.lit(1.0)) * 1_000_000))
        hits.append((F.col("_rule_id").isNotNull() & fired(p, rate, frequency, sets(*(r for r in known if r.can_id is not None))), row(p, p("rule_no"), False)))
    if not hits:
        raise ValueError("no rules")
    found = F.filter(F.array(*(F.when(hit, alert) for hit, alert in hits)), lambda h: h.isNotNull())
    return state.withColumn("_hits", found).filter(F.size("_hits") > 0).select(*frame, F.explode("_hits").alias("h")).select(*frame, "h.*")


def early_exit(hits: DataFrame, critical: int = 2) -> DataFrame:
    """Keeps each frame's alerts up to and including the first critical one: rules of the id by priority, then global ones, each in the order of the file."""
    w = Window.partitionBy("bus", "seq").orderBy("is_global", "priority", "rule_no")
    before = F.coalesce(F.max((F.col("priority") <= critical).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return hits.withColumn("_stop", before).filter("_stop = 0").drop("_stop")


def scopes(rules: list[Row]) -> Column:
    """How many of the rules have a frame in their scope (as ``match_scope`` pairs them)."""
    of_id: dict[int, int] = {}
    count = F.lit(0).cast("long")
    for r in rules:
        if r.can_id is not None:
            of_id[r.can_id] = of_id.get(r.can_id, 0) + 1
        else:
            scope = _scope(r)
            count = count + (F.lit(1) if scope is None else F.coalesce(scope, F.lit(r.can_id_range is None)).cast("int"))
    return count + F.coalesce(F.element_at(_v(of_id), F.col("can_id")), F.lit(0)) if of_id else count


def statistics(frames: DataFrame, hits: DataFrame, rules: DataFrame) -> DataFrame:
    """One row: processed, alerts, alert_rate, match_rate (frames with an alert), avg_rules (in scope of a frame). Scopes are summed up over frames, not joined."""
    n = frames.agg(F.count("*").alias("processed"), F.sum(scopes(rules.collect())).alias("evaluated"))
    a = hits.agg(F.count("*").alias("alerts"), F.countDistinct("bus", "seq").alias("matched"))
    ratio = lambda c: F.when(F.col("processed") > 0, F.col(c) / F.col("processed")).otherwise(0.0)
    return n.join(a).select("processed", "alerts", ratio("alerts").alias("alert_rate"), ratio("matched").alias("match_rate"), ratio("evaluated").alias("avg_rules"))


def describe(rules: DataFrame) -> DataFrame:
    """name, severity, description, priority, can_id, stateful."""
    stateful = F.lit(False)
    for c in ("check_timing", "check_counter", "check_replay", "check_repetition", "check_source"):
        stateful = stateful | _true(F.col(c))
    stateful = stateful | F.col("max_frequency").isNotNull() | F.col("global_message_rate").isNotNull()
    return rules.select("rule_no", "name", "severity", "description", "priority", "can_id", stateful.alias("stateful"))


def known_ids(rules: DataFrame, widest: int = 100) -> DataFrame:
    """Distinct ids named by rules, and those of ranges shorter than ``widest``."""
    ranged = rules.filter((F.col("can_id_range")[1] - F.col("can_id_range")[0]).between(0, widest - 1)).select(F.explode(F.sequence(F.col("can_id_range")[0], F.col("can_id_range")[1])).alias("can_id"))
    return rules.filter("can_id is not null").select("can_id").unionByName(ranged).distinct()
