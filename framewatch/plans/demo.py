"""The ``events`` table seen as CAN frames, in Spark and in DuckDB SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_BODY = """
SELECT seq, ts_us, bus, can_id, dlc, {slice} AS data, false AS is_extended, event_type = 'purchase' AND k % 9 = 0 AS is_remote,
  event_type = 'error' AND k % 13 = 0 AS is_error, source_id, attack, event_type AS attack_type, bus AS vehicle
FROM (SELECT *, CASE WHEN seq % 2 = 0 THEN {xor} ELSE CASE WHEN same THEN 170 ELSE (k + 1) % 256 END END AS b7
FROM (SELECT event_id AS seq, {us} AS ts_us, concat('v', CAST(user_id % 3 AS {text})) AS bus, event_type, k, user_id % 5 = 0 AS same,
  CAST(CASE WHEN event_type = 'signup' AND user_id % 4 = 0 THEN 2016 + user_id % 16 ELSE 256 + user_id % 40 END AS INT) AS can_id,
  CAST(CASE WHEN event_type = 'view' THEN 4 ELSE 8 END AS INT) AS dlc,
  CAST(CASE WHEN user_id % 5 = 0 THEN 170 ELSE event_id % 256 END AS INT) AS b0, CAST(CASE WHEN user_id % 5 = 0 THEN 170 ELSE k END AS INT) AS b1,
  CAST(CASE WHEN user_id % 5 = 0 THEN 170 ELSE cents % 256 END AS INT) AS b2, CAST(CASE WHEN user_id % 5 = 0 THEN 170 ELSE {high} END AS INT) AS b3,
  CAST(CASE WHEN user_id % 5 = 0 THEN 170 WHEN event_type = 'error' THEN 255 ELSE 0 END AS INT) AS b4, CAST(CASE WHEN user_id % 5 = 0 THEN 170 ELSE user_id % 256 END AS INT) AS b5,
  CAST(CASE WHEN user_id % 5 = 0 THEN 170 ELSE 7 * event_id % 251 END AS INT) AS b6,
  CAST(CASE WHEN event_type = 'signup' AND user_id % 4 = 0 AND k % 2 = 0 THEN user_id % 16 END AS INT) AS source_id,
  CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS INT) AS attack
FROM (SELECT event_id, user_id, event_type, ts, CAST(round(value * 100) AS BIGINT) % 65536 AS cents, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events}) x) y) z
"""

#: The same in DuckDB: frames as a CTE named ``frames`` for the queries' SQL to begin with.
FRAMES_SQL = "WITH frames AS (" + _BODY.format(
    slice="[b0, b1, b2, b3, b4, b5, b6, b7][1:dlc]", xor="xor(xor(xor(xor(xor(xor(b0, b1), b2), b3), b4), b5), b6)", us="(epoch_us(ts) - 1704067200000000) // 20000", text="VARCHAR", high="cents // 256", events="events"
) + ")"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of three buses from the events table; time runs 20 000 times as fast."""
    body = _BODY.format(
        slice="slice(array(b0, b1, b2, b3, b4, b5, b6, b7), 1, dlc)", xor="(b0 ^ b1 ^ b2 ^ b3 ^ b4 ^ b5 ^ b6)",
        us="timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', cast(ts as timestamp_ntz)) div 20000", text="STRING", high="cents div 256", events="{events}",
    )
    return spark.sql(body, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
