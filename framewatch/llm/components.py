"""Connected components of a graph of 64-bit ids, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewatch.llm.common import kept


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id in ``edges`` (a, b), root being the least id of its component.

    Each round links every neighbour of a node to the least one (large star: the
    larger neighbours; small star: the smaller ones), which keeps the components
    and flattens them to stars in a logarithmic number of rounds. Rounds are
    written to the shared folder; only two figures a round reach the driver.
    """
    now = kept(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    figures = None
    while True:
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if new == figures or not new[0]:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        figures = new
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        flat = small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        now = kept(flat.filter("u != v").distinct(), "edges")
