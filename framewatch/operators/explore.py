"""A first look at frames and tables."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def traffic_summary(frames: DataFrame, approximate: bool = False) -> DataFrame:
    """Per bus: messages, distinct ids, seconds, messages a second, last time."""
    ids = F.approx_count_distinct("can_id") if approximate else F.countDistinct("can_id")
    out = frames.groupBy("bus").agg(F.count("*").alias("messages"), ids.alias("ids"), ((F.max("ts_us") - F.min("ts_us")) / 1_000_000).alias("seconds"), F.max("ts_us").alias("last_us"))
    return out.withColumn("rate", F.when(F.col("seconds") > 0, F.col("messages") / F.col("seconds")).otherwise(0.0))


def dataset_stats(frames: DataFrame) -> DataFrame:
    """Per vehicle: frames, attacks, ids, seconds, and a map of frames by attack type."""
    kinds = frames.groupBy("vehicle", "attack_type").agg(F.count("*").alias("n")).groupBy("vehicle").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("attack_type", "n")))).alias("by_type"))
    totals = frames.groupBy("vehicle").agg(F.count("*").alias("frames"), F.sum("attack").alias("attacks"), F.countDistinct("can_id").alias("ids"), ((F.max("ts_us") - F.min("ts_us")) / 1_000_000).alias("seconds"))
    return totals.join(kinds, "vehicle")


def data_summary(df: DataFrame) -> DataFrame:
    """(column, type, rows, nulls), one row per column."""
    counts = df.agg(F.count("*").alias("_rows"), *(F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns))
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("_rows").alias("rows"), F.coalesce(F.col(c), F.lit(0)).alias("nulls")) for c, t in df.dtypes))
    return counts.select(F.explode(cells).alias("c")).select("c.*")


def correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlations (a, b, r) of columns; rows with a null are left out, a constant column gives NaN."""
    rows = VectorAssembler(inputCols=columns, outputCol="v", handleInvalid="skip").transform(df.select(*(F.col(c).cast("double").alias(c) for c in columns)))
    m = Correlation.corr(rows, "v").first()[0].toArray()
    return df.sparkSession.createDataFrame([(a, b, float(m[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns)], "a string, b string, r double")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def histogram(df: DataFrame, columns: list[str], bins: int = 50) -> DataFrame:
    """(signal, bin, low, n): equal-width bins from the least to the greatest value; the greatest falls into the last bin, a constant signal into the first."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("signal"), F.col(c).cast("double").alias("x")) for c in columns))).alias("s")).select("s.*").filter("x is not null")
    ends = long.groupBy("signal").agg(F.min("x").alias("_a"), F.max("x").alias("_b"))
    rows = long.join(F.broadcast(ends), "signal")
    place = F.when(F.col("_b") > F.col("_a"), F.least(F.floor((F.col("x") - F.col("_a")) / (F.col("_b") - F.col("_a")) * bins), F.lit(bins - 1))).otherwise(0).cast("int")
    return rows.withColumn("bin", place).groupBy("signal", "bin").agg(F.first(F.col("_a") + (F.col("_b") - F.col("_a")) / bins * F.col("bin")).alias("low"), F.count("*").alias("n"))
