"""Schemas of frames, rules and alerts."""

from __future__ import annotations

from pyspark.sql import types as T

FRAME_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("ts_us", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("bus", T.StringType()),
    T.StructField("can_id", T.IntegerType()), T.StructField("dlc", T.IntegerType()), T.StructField("data", T.ArrayType(T.IntegerType())),
    T.StructField("is_extended", T.BooleanType()), T.StructField("is_remote", T.BooleanType()), T.StructField("is_error", T.BooleanType()),
    T.StructField("source_id", T.IntegerType()), T.StructField("attack", T.IntegerType()), T.StructField("attack_type", T.StringType()),
    T.StructField("vehicle", T.StringType()), T.StructField("source_file", T.StringType()),
])

_LONGS, _DOUBLES, _BOOLS = T.ArrayType(T.IntegerType()), T.DoubleType(), T.BooleanType()
#: The fields of a rule and their types.
RULE_FIELDS: dict[str, T.DataType] = {
    "name": T.StringType(), "severity": T.StringType(), "description": T.StringType(), "action": T.StringType(),
    "can_id": T.IntegerType(), "can_id_range": _LONGS, "dlc_min": T.IntegerType(), "dlc_max": T.IntegerType(),
    "data_pattern": T.StringType(), "data_contains": T.ArrayType(T.StringType()), "max_frequency": T.IntegerType(), "time_window": _DOUBLES,
    "check_timing": _BOOLS, "expected_interval": _DOUBLES, "interval_variance": _DOUBLES, "allowed_sources": _LONGS, "check_checksum": _BOOLS, "check_counter": _BOOLS,
    "entropy_threshold": _DOUBLES, "whitelist_mode": _BOOLS, "allowed_can_ids": _LONGS,
    "validate_dlc": _BOOLS, "check_frame_format": _BOOLS, "global_message_rate": T.IntegerType(), "check_source": _BOOLS, "check_replay": _BOOLS,
    **{f"data_byte_{i}": T.IntegerType() for i in range(8)}, "replay_time_threshold": _DOUBLES,
    "check_data_integrity": _BOOLS, "check_steering_range": _BOOLS, "check_repetition": _BOOLS, "frame_type": T.StringType(), "steering_min": _DOUBLES, "steering_max": _DOUBLES,
    "repetition_threshold": T.IntegerType(), "integrity_checksum_offset": T.IntegerType(), "sigma_extreme": _DOUBLES, "sigma_moderate": _DOUBLES, "consecutive_required": T.IntegerType(),
    "payload_repetition_threshold": _DOUBLES, "priority": T.IntegerType(), "check_can_id_range": _BOOLS, "min_can_id": T.IntegerType(), "max_can_id": T.IntegerType(),
    "check_payload_pattern": _BOOLS, "pattern_types": T.ArrayType(T.StringType()), "check_can_id_whitelist": _BOOLS, "known_ids": _LONGS, "check_dlc_validity": _BOOLS,
    "expected_dlc_by_id": T.MapType(T.IntegerType(), T.IntegerType()), "check_entropy": _BOOLS, "min_entropy": _DOUBLES, "window_size": T.IntegerType(), "check_byte_ranges": _BOOLS,
    "byte_ranges_by_id": T.MapType(T.IntegerType(), T.MapType(T.IntegerType(), _LONGS)),
}
RULE_SCHEMA = T.StructType([T.StructField("rule_no", T.IntegerType()), *(T.StructField(k, v) for k, v in RULE_FIELDS.items())])
