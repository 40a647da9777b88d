"""A timing baseline per id from attack-free frames, and detection rules generated from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewatch.operators import windows as W

#: Traffic class by frames a second -> (least rate, extreme sigma, moderate sigma, intervals off of the last so many and two).
TRAFFIC = {"high": (50.0, 2.5, 1.3, 4), "medium": (10.0, 2.8, 1.5, 5), "low": (0.0, 3.0, 1.7, 4)}
#: Confidence level -> sigmas of the frequency limit, least standard deviation (ms), share of repeated payloads.
SIGMAS = ((0.997, 3.0), (0.954, 2.0), (0.683, 1.0))
LEAST_SD_MS, REPEATED = 2.0, 0.55


#: Rules that may be turned into expressions.
MOST_RULES = 10_000


def attack_free(*frames: DataFrame) -> DataFrame:
    """The union of captures, less frames marked as attacks."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.filter("attack = 0")


def analyze(frames: DataFrame, least: int = 10, recent: int = 1000, keys: tuple[str, ...] = ("bus", "can_id")) -> DataFrame:
    """Per id: positive intervals (ms) mean, sample sd, min, max, their number; rate over the last ``recent`` frames; frames, distinct payloads.

    Ids with fewer than ``least`` positive intervals are left out.
    """
    w = Window.partitionBy(*keys).orderBy(*W.ORDER)
    back = Window.partitionBy(*keys).orderBy(F.desc("ts_us"), F.desc("seq"))
    rows = frames.withColumn("_d", (F.col("ts_us") - F.lag("ts_us").over(w)) / 1000).withColumn("_back", F.row_number().over(back))
    d = F.when(F.col("_d") > 0, F.col("_d"))
    late = F.when(F.col("_back") <= recent, F.col("ts_us"))
    out = rows.groupBy(*keys).agg(
        F.avg(d).alias("mean_ms"), F.stddev_samp(d).alias("std_ms"), F.min(d).alias("min_ms"), F.max(d).alias("max_ms"), F.count(d).alias("intervals"),
        F.count("*").alias("frames"), F.countDistinct("data").alias("payloads"), (F.max(late) - F.min(late)).alias("_span"), F.count(late).alias("_late"),
    )
    rate = F.when(F.col("_span") > 0, F.col("_late") / (F.col("_span") / 1_000_000)).otherwise(0.0)
    return out.filter(F.col("intervals") >= least).withColumn("rate", rate).drop("_span", "_late")


def _by_class(rate: Column, which: int) -> Column:
    return F.when(rate > TRAFFIC["high"][0], TRAFFIC["high"][which]).when(rate > TRAFFIC["medium"][0], TRAFFIC["medium"][which]).otherwise(TRAFFIC["low"][which])


def sigma_of(confidence: float) -> float:
    return next((sigma for least, sigma in SIGMAS if confidence >= least), 1.5)


def generate_rules(profile: DataFrame, confidence: float = 0.997) -> DataFrame:
    """Timing rules, and frequency rules for ids with 10 frames a second or more, of ids whose coefficient of variation is 2 at most."""
    cv = F.when(F.col("mean_ms") > 0, F.col("std_ms") / F.col("mean_ms")).otherwise(0.0)
    base = profile.withColumn("cv", cv).filter("cv <= 2").withColumn("traffic", F.when(F.col("rate") > 50, "high").when(F.col("rate") > 10, "medium").otherwise("low"))
    jitter = F.col("cv") > 0.5
    base = base.withColumns({
        "sigma_extreme": _by_class(F.col("rate"), 1) + F.when(jitter, 0.3).otherwise(0.0),
        "sigma_moderate": _by_class(F.col("rate"), 2) + F.when(jitter, 0.1).otherwise(0.0),
        "consecutive_required": _by_class(F.col("rate"), 3) + F.when(jitter, 1).otherwise(0),
        "interval_variance": F.round(F.greatest("std_ms", F.lit(LEAST_SD_MS)), 2),
        "expected_interval": F.round("mean_ms", 2),
    })
    name = lambda kind: F.concat(F.lit(f"{kind} 0x"), F.lpad(F.hex("can_id"), 3, "0"))
    keys = [c for c in ("bus", "vehicle") if c in profile.columns]
    timing = base.select(*keys, "can_id", name("timing").alias("name"), F.lit("timing").alias("kind"), "traffic", "expected_interval", "interval_variance", "sigma_extreme", "sigma_moderate", "consecutive_required", F.lit(None).cast("int").alias("max_frequency"))
    limit = F.floor(F.col("rate") * (1 + sigma_of(confidence))).cast("int")
    frequency = base.filter("rate >= 10").select(*keys, "can_id", name("frequency").alias("name"), F.lit("frequency").alias("kind"), "traffic", *(F.lit(None).cast(t).alias(c) for c, t in (("expected_interval", "double"), ("interval_variance", "double"), ("sigma_extreme", "double"), ("sigma_moderate", "double"), ("consecutive_required", "int"))), limit.alias("max_frequency"))
    return timing.unionByName(frequency)


def merge_rules(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rules that are not timing rules, old timing rules of ids without a new one, and the new ones; all with the refreshed list of ids.

    Both have (can_id, name, kind) at least; the list is of the distinct ids in ``new``, one row that is joined to each rule.
    """
    fresh = new.filter("kind = 'timing'").select("can_id").distinct()
    kept = old.filter("kind != 'timing'").unionByName(old.filter("kind = 'timing'").join(fresh, "can_id", "left_anti").select(*old.columns))
    ids = new.agg(F.sort_array(F.collect_set("can_id")).alias("allowed_can_ids"))
    return kept.unionByName(new, allowMissingColumns=True).join(F.broadcast(ids))


def rules_from_profile(rules: DataFrame) -> list[dict]:
    """Generated rules as dicts for ``rules_frame``: of one bus or vehicle, MOST_RULES at most (more raise, as they all become expressions of one plan)."""
    known = rules.orderBy("can_id", "name").limit(MOST_RULES + 1).collect()
    if len(known) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules; take them for one bus at a time")
    out = []
    for r in known:
        rule = {"name": r.name, "severity": "HIGH", "description": f"{r.kind} baseline of 0x{r.can_id:X}", "action": "alert", "can_id": r.can_id, "priority": 4}
        if r.kind == "timing":
            rule |= {"check_timing": True, "payload_repetition_threshold": REPEATED} | {k: r[k] for k in ("expected_interval", "interval_variance", "sigma_extreme", "sigma_moderate", "consecutive_required")}
        else:
            rule |= {"max_frequency": r.max_frequency, "time_window": 1}
        out.append(rule)
    return out
