from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session


SCHEMA = "seq long, ts_us long, bus string, can_id int, dlc int, data array<int>, is_extended boolean, is_remote boolean, is_error boolean, source_id int, attack int, attack_type string, vehicle string"


@pytest.fixture(scope="session")
def make(spark):
    """Frames from dicts; what is left out has a plain value."""

    def build(rows):
        full = []
        for i, r in enumerate(rows):
            data = r.get("data", [1, 2, 3, 4, 5, 6, 7, 8])
            full.append((r.get("seq", i), int(r.get("t", i) * 1_000_000), r.get("bus", "b"), r.get("can_id", 0x100), r.get("dlc", len(data)), data, r.get("ext", False), r.get("rtr", False), r.get("err", False), r.get("source"), r.get("attack", 0), r.get("kind", "none"), r.get("vehicle", "v")))
        return spark.createDataFrame(full, SCHEMA)

    return build
