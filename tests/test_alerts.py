"""Alert statistics where alerts come within a moment, against SQL."""

from __future__ import annotations

import duckdb
import pytest

from framewatch.plans import ORACLE, QUERIES

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.mark.parametrize("span_us", [0, 260_000, 47_000_000_000])
def test_rates_of_alerts_within_a_moment(spark, tmp_path, span_us):
    """Alerts all at one time have an infinite rate, as in SQL; those within microseconds such large ones that how they are rounded tells."""
    con = duckdb.connect()
    ts = f"TIMESTAMP '2024-01-01' + to_microseconds(CAST(event_id * {span_us} // (SELECT max(event_id) FROM '{EVENTS}') AS BIGINT))"
    con.execute(f"COPY (SELECT * REPLACE ({ts} AS ts) FROM '{EVENTS}') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = sorted(map(str, map(tuple, QUERIES["A6_statistics"](spark, str(tmp_path)).collect())))
    assert got == sorted(map(str, con.execute(ORACLE["A6_statistics"]).fetchall()))
    assert ("inf" in "".join(got)) == (span_us < 1_000_000)
