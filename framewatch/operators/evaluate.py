"""Detection metrics from rows with ``attack`` (label) and ``pred``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewatch.operators import select
from framewatch.operators import windows as W
from framewatch.storage import kept


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def metrics(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return {
        "accuracy": _ratio(tp + tn, tp + tn + fp + fn), "precision": precision, "recall": recall, "f1": _ratio(2 * precision * recall, precision + recall),
        "specificity": _ratio(tn, tn + fp), "fpr": _ratio(fp, fp + tn), "fnr": _ratio(fn, fn + tp), "npv": _ratio(tn, tn + fn),
    }


def confusion(df: DataFrame, label: str = "attack", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    """tp, fp, tn, fn, n and the rates derived from them, in all or ``by`` columns."""
    a, p = F.coalesce(F.col(label), F.lit(0)) == 1, F.coalesce(F.col(pred), F.lit(0)) == 1
    count = lambda c: F.sum(c.cast("long"))
    out = df.groupBy(*(by or [])).agg(count(a & p).alias("tp"), count(~a & p).alias("fp"), count(~a & ~p).alias("tn"), count(a & ~p).alias("fn"), F.count("*").alias("n"))
    return out.withColumns(metrics(*(F.col(c) for c in ("tp", "fp", "tn", "fn"))))


def by_attack_type(df: DataFrame, label: str = "attack", pred: str = "pred") -> DataFrame:
    """samples, precision, recall and F1 per attack type."""
    return confusion(df, label, pred, ["attack_type"]).select("attack_type", F.col("n").alias("samples"), "precision", "recall", "f1")


def roc(df: DataFrame, label: str = "attack", score: str = "score") -> DataFrame:
    """Points (score, tpr, fpr) of the ROC curve, one for each distinct score, highest first, and the area so far.

    Rows are counted by score; distinct scores are dealt in order to partitions, written,
    and summed up within each, with the sums of those before it added.
    """
    points = df.groupBy(F.col(score).alias("score")).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) != 1).cast("long")).alias("q"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(points.repartitionByRange(n, F.desc("score")).withColumn("_part", F.spark_partition_id()), "scores")
    upto = Window.partitionBy("_part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition

    def summed(rows: DataFrame, *columns: str) -> DataFrame:
        parts = rows.groupBy("_part").agg(*(F.sum(c).alias(c) for c in columns))
        before = parts.select("_part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before_{c}") for c in columns))
        return rows.join(F.broadcast(before), "_part").withColumns({f"{c}_sum": F.sum(c).over(upto) + F.col(f"_before_{c}") for c in columns}).drop(*(f"_before_{c}" for c in columns))

    total = dealt.agg(F.sum("p").alias("_p"), F.sum("q").alias("_q"))
    sums = summed(dealt, "p", "q").join(F.broadcast(total))
    tpr, fpr = _ratio(F.col("p_sum"), F.col("_p")), _ratio(F.col("q_sum"), F.col("_q"))
    last_tpr = _ratio(F.col("p_sum") - F.col("p"), F.col("_p"))
    area = sums.select("_part", "score", tpr.alias("tpr"), fpr.alias("fpr"), (_ratio(F.col("q"), F.col("_q")) * (tpr + last_tpr) / 2).alias("a"))
    return summed(area, "a").select("score", "tpr", "fpr", F.col("a_sum").alias("auc"))


def detection_gaps(df: DataFrame, pred: str = "pred") -> DataFrame:
    """Per bus: mean, median, min, max and population sd (s) of the gaps between detections."""
    found, w = W.bus_blocks(df.filter(F.col(pred) == 1).select("bus", "ts_us", "seq"), 1)
    gaps = kept(found.withColumn("_us", F.col("ts_us") - F.lag("ts_us").over(w)).filter("_native = 1 and _us is not null").select("bus", "_us"), "gaps")
    s = F.col("_us") / 1_000_000
    rest = gaps.groupBy("bus").agg(F.avg(s).alias("mean"), F.min(s).alias("min"), F.max(s).alias("max"), F.stddev_pop(s).alias("std"), F.count("*").alias("gaps"))
    middle = select.median(gaps, ["bus"], "_us").withColumn("median", F.col("median") / 1_000_000)
    return W.null_safe(rest, middle, ["bus"]).select("bus", "mean", "median", "min", "max", "std", "gaps")


def rate_over_time(df: DataFrame, width_s: float = 60.0, pred: str = "pred") -> DataFrame:
    """Messages, detections and rate per window of the bus, counted from its first frame."""
    first = df.groupBy("bus").agg(F.min("ts_us").alias("_t0"))
    width = int(width_s * 1_000_000)
    rows = W.null_safe(df, first, ["bus"]).withColumn("window", F.expr(f"(ts_us - _t0) div {width}"))
    return rows.groupBy("bus", "window").agg(F.count("*").alias("messages"), F.sum(F.col(pred).cast("long")).alias("detections")).withColumn("rate", F.col("detections") / F.col("messages"))


#: Metrics for which less is better.
LOWER = ("fpr", "fnr")


def compare_models(metrics: DataFrame, names: tuple[str, ...] = ("accuracy", "precision", "recall", "f1", "fpr", "fnr")) -> DataFrame:
    """(metric, model, value) of the best model per metric, from one row per model; ties go to the first name."""
    long = metrics.select("model", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names))).alias("m")).select("model", "m.*")
    key = F.struct(F.when(F.col("metric").isin(*LOWER), F.col("value")).otherwise(-F.col("value")).alias("v"), F.col("model"))
    return long.groupBy("metric").agg(F.min_by("model", key).alias("model"), F.min_by("value", key).alias("value"))


def assess(metrics: DataFrame) -> DataFrame:
    """Adds ``grade`` from F1 and ``advice`` from the weaker of precision and recall."""
    f1 = F.col("f1")
    grade = F.when(f1 >= 0.9, "Excellent").when(f1 >= 0.8, "Good").when(f1 >= 0.7, "Fair").otherwise("Poor")
    advice = F.when(F.col("fpr") > 0.05, "raise thresholds: many false alarms").when(F.col("recall") < 0.8, "lower thresholds: attacks are missed").otherwise("none")
    return metrics.withColumn("grade", grade).withColumn("advice", advice)


def stage_credit(df: DataFrame, rule: str = "rule_pred", model: str = "model_pred", label: str = "attack") -> DataFrame:
    """Detections by stage: an attack that rules found counts for them, the rest for the model or as missed."""
    stage = F.when(F.col(rule) == 1, "rules").when(F.col(model) == 1, "model").otherwise("none")
    return df.groupBy(stage.alias("stage")).agg(F.sum((F.col(label) == 1).cast("long")).alias("attacks"), F.sum((F.col(label) != 1).cast("long")).alias("normal"))
