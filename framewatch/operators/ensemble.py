"""Ensembles of detector columns: routing, voting, cascades, weights, stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewatch.operators import select
from framewatch.storage import kept


#: Weights of model, DoS, spoofing and fuzzing votes by class of attack, and the weights without a class.
BASE_WEIGHTS = (0.4, 0.2, 0.2, 0.2)
CLASS_WEIGHTS = {"fuzzing": (0.15, 0.05, 0.05, 0.75), "dos": (0.30, 0.60, 0.05, 0.05), "rpm": (0.50, 0.20, 0.20, 0.10), "gear": (0.70, 0.10, 0.10, 0.10), "unknown": BASE_WEIGHTS}
VOTES = ("ml", "dos", "spoof", "fuzz")


def classify_mass(df: DataFrame, profile: DataFrame, share: float = 0.1) -> DataFrame:
    """Adds attack_class: dos for an id with over ``share`` of its bus's rows, spoofing for an unknown id, fuzzing for a length not among ``lengths``, else unknown.

    Counts are made by id and joined; no window over a bus.
    """
    own = df.groupBy("bus", "can_id").agg(F.count("*").alias("_own"))
    sizes = own.groupBy("bus").agg(F.sum("_own").alias("_all"))
    shares = own.join(sizes, "bus").select("bus", "can_id", (F.col("_own") / F.col("_all")).alias("_share"))
    rows = df.join(shares, ["bus", "can_id"]).join(profile.select("bus", "can_id", F.col("lengths").alias("_lengths")), ["bus", "can_id"], "left")
    kind = F.when(F.col("_share") > share, "dos").when(F.col("_lengths").isNull(), "spoofing").when(~F.array_contains("_lengths", F.col("dlc")), "fuzzing").otherwise("unknown")
    return rows.withColumn("attack_class", kind).drop("_share", "_lengths")


def majority(*columns: str) -> Column:
    """1 if two or more of three say so (half and over of any number)."""
    return (sum((F.col(c) for c in columns), F.lit(0)) * 2 > len(columns)).cast("int")


def crosscheck(df: DataFrame, mode: str = "auto", attack_class: str | None = None, dos: str = "dos_check", spoof: str = "spoof_check", fuzz: str = "fuzz_check", base: str = "pred") -> DataFrame:
    """Adds ensemble and routed (which filter decided): ``auto`` routes by attack_class, ``routing`` by the class given, ``voting`` by majority, ``cascade`` by all in turn."""
    vote = majority(dos, spoof, fuzz)
    if attack_class is not None:
        mode = "routing"
    if mode == "auto":
        kind = F.col("attack_class")
        out = F.when(kind == "dos", F.col(dos)).when(kind == "spoofing", F.col(spoof)).when(kind == "fuzzing", F.col(fuzz)).otherwise(vote)
        routed = F.when(kind.isin("dos", "spoofing", "fuzzing"), kind).otherwise("voting")
    elif mode == "routing":
        name = (attack_class or "unknown").lower()
        target = {"dos": dos, "spoofing": spoof, "rpm": spoof, "gear": spoof, "fuzzing": fuzz}.get(name, base)
        out, routed = F.col(target), F.lit({dos: "dos", spoof: "spoofing", fuzz: "fuzzing"}.get(target, "ml"))
    elif mode == "voting":
        out, routed = vote, F.lit("voting")
    elif mode == "cascade":
        out = F.least(dos, spoof, fuzz)
        routed = F.when(F.col(dos) == 0, "dos").when(F.col(spoof) == 0, "spoofing").otherwise("fuzzing")
    else:
        raise ValueError(f"unknown mode: {mode}")
    return df.withColumn("ensemble", out).withColumn("routed", routed)


def routing_statistics(df: DataFrame) -> DataFrame:
    return df.groupBy("routed").agg(F.count("*").alias("rows"), F.sum("ensemble").alias("detections"))


def vote(df: DataFrame, columns: list[str], mode: str = "hard", threshold: float = 0.5) -> DataFrame:
    """Adds vote: ``hard``, half of the columns or more; ``soft``, their mean at the threshold or over."""
    total = sum((F.col(c) for c in columns), F.lit(0))
    out = total * 2 >= len(columns) if mode == "hard" else total / len(columns) >= threshold
    return df.withColumn("vote", out.cast("int"))


def weighted_vote(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Adds weighted: the weights of columns that say 1 over all weights, more than a half."""
    total = sum(weights.values())
    score = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))
    return df.withColumn("weighted", (score / total > 0.5).cast("int") if total > 0 else F.lit(0))


def classify_features(df: DataFrame) -> DataFrame:
    """Adds feature_class from freq_deviation, payload_entropy, entropy_anomaly and dlc_anomaly."""
    f = F.col("freq_deviation")
    kind = F.when(f > 3, "dos").when((F.col("payload_entropy") > 3) & (F.col("entropy_anomaly") > 2), "fuzzing").when(F.col("dlc_anomaly") > 0.5, F.when(f > 1, "rpm").otherwise("gear")).otherwise("unknown")
    return df.withColumn("feature_class", kind)


def adaptive_weighted(df: DataFrame, votes: tuple[str, str, str, str] = VOTES, weights: dict[str, tuple[float, ...]] | None = None, threshold: float = 0.5, kind: str = "feature_class") -> DataFrame:
    """Adds adaptive_confidence (votes weighted by the row's class) and adaptive, at the threshold or over."""
    table = CLASS_WEIGHTS | (weights or {})
    score = F.lit(None).cast("double")
    for name, w in {**table, None: BASE_WEIGHTS}.items():
        total = sum((F.col(v) * x for v, x in zip(votes, w)), F.lit(0.0))
        score = F.when(F.col(kind) == name, total).otherwise(score) if name else F.coalesce(score, total)
    return df.withColumn("adaptive_confidence", F.round(score, 9)).withColumn("adaptive", (F.col("adaptive_confidence") >= threshold).cast("int"))


def adaptive_statistics(df: DataFrame, kind: str = "feature_class") -> DataFrame:
    return df.groupBy(kind).agg(F.count("*").alias("rows"), F.sum("adaptive").alias("detections"))


def weight_grid() -> list[tuple[float, float, float, float]]:
    """175 combinations in the order of the search: model weight 0.1 to 0.7, then five shares of the rest, and five of what is left."""
    out = []
    for m in range(1, 8):
        for i in range(5):
            for j in range(5):
                rest = 1 - m / 10
                dos = rest * i / 4
                spoof = (rest - dos) * j / 4
                out.append((m / 10, dos, spoof, rest - dos - spoof))
    return out


def optimize_weights(df: DataFrame, kind: str = "attack_type", label: str = "attack", votes: tuple[str, str, str, str] = VOTES, threshold: float = 0.5) -> DataFrame:
    """The weights with the best F1 per class, the first of the best. Rows collapse to counts of distinct votes before they meet the grid."""
    counts = df.groupBy(F.col(kind).alias("kind"), F.col(label).alias("label"), *votes).agg(F.count("*").alias("c"))
    grid = df.sparkSession.createDataFrame([(i, *w) for i, w in enumerate(weight_grid())], "k int, w0 double, w1 double, w2 double, w3 double")
    score = F.round(sum((F.col(v) * F.col(f"w{i}") for i, v in enumerate(votes)), F.lit(0.0)), 9)
    rows = counts.join(F.broadcast(grid)).withColumn("p", (score >= threshold).cast("int"))
    some = lambda p, y: F.sum(F.when((F.col("p") == p) & (F.col("label") == y), F.col("c")).otherwise(0))
    sums = rows.groupBy("kind", "k", "w0", "w1", "w2", "w3").agg(some(1, 1).alias("tp"), some(1, 0).alias("fp"), some(0, 1).alias("fn"))
    f1 = F.when(F.col("tp") > 0, F.round(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")), 9)).otherwise(0.0)
    best = sums.withColumn("f1", f1).withColumn("_r", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("f1"), "k"))).filter("_r = 1")
    return best.select("kind", "f1", *(F.col(f"w{i}").alias(f"w_{v}") for i, v in enumerate(votes)))


def multistage(df: DataFrame, stage1: str = "stage1", score: str = "stage1_score", rules: list[str] | None = None, probability: str = "stage3_probability", load: float = 0.2, threshold: float = 0.7) -> DataFrame:
    """Adds pred, confidence and stage (the last that saw the row).

    Stage 1's label has confidence 1 / (1 + e^(5 score)); its hits, and what is
    under 0.8, go on. In stage 2 any rule decides, with the mean of 0.9 and 0.1 for
    the rules' votes; hits and what is under 0.95 go on, but at most ``load`` of
    stage 2's rows, the most confident (then the first). Stage 3's probability
    overrides. The cut is found by counts (``select``); no task holds what passes it.
    """
    rules = rules or ["rule_a", "rule_b"]
    c1 = 1 / (1 + F.exp(5 * F.col(score)))
    rows = df.withColumn("_c1", c1).withColumn("_to2", (F.col(stage1) == 1) | (c1 < 0.8))
    mean = sum((F.when(F.col(r) == 1, 0.9).otherwise(0.1) for r in rules), F.lit(0.0)) / len(rules)
    any_rule = F.greatest(*rules, F.lit(0))
    rows = rows.withColumn("_l2", F.when(F.col("_to2"), any_rule)).withColumn("_c2", F.when(F.col("_to2"), F.round(F.greatest("_c1", mean), 9)))
    rows = rows.withColumn("_to3", F.col("_to2") & ((F.col("_l2") == 1) | (F.col("_c2") < 0.95)))
    rows = kept(rows, "stages")  # read once for the sizes, for each pass of counts, and for the result
    sizes = rows.agg(F.sum(F.col("_to2").cast("long")).alias("two"), F.sum(F.col("_to3").cast("long")).alias("three")).first()
    two, three = sizes.two or 0, sizes.three or 0
    if three > load * two:
        rows = rows.withColumns({"_all": F.lit(0), "_less": -F.round(F.col("_c2") * 1_000_000_000).cast("long"), "_bus": F.xxhash64("bus")})
        need = rows.sparkSession.createDataFrame([(0, int(load * two))], "_all int, n long")
        asked = select.mark_first(rows.filter("_to3"), ["_all"], need, [F.col("_less"), F.coalesce("seq", F.lit(-1)), F.col("_bus")], "_to3_")
        rows = asked.withColumn("_to3", F.col("_to3_")).drop("_to3_").unionByName(rows.filter(~F.coalesce("_to3", F.lit(False)))).drop("_all", "_less", "_bus")
    p = F.col(probability)
    return rows.select(
        *df.columns, F.when(F.col("_to3"), 3).when(F.col("_to2"), 2).otherwise(1).alias("stage"),
        F.when(F.col("_to3"), (p >= threshold).cast("int")).when(F.col("_to2"), F.col("_l2")).otherwise(F.col(stage1)).alias("pred"),
        F.when(F.col("_to3"), p).when(F.col("_to2"), F.col("_c2")).otherwise(F.col("_c1")).alias("confidence"),
    )


def stage_statistics(df: DataFrame) -> DataFrame:
    """Per stage: rows that it saw, rows passed on, detections it decided, share of all rows."""
    n = df.groupBy("stage").agg(F.count("*").alias("ended"), F.sum("pred").alias("detections"))
    w = Window.orderBy(F.desc("stage")).rowsBetween(Window.unboundedPreceding, 0)  # three rows
    seen = n.withColumn("processed", F.sum("ended").over(w)).withColumn("passed", F.col("processed") - F.col("ended"))
    total = n.agg(F.sum("ended").alias("_all"))
    return seen.join(total).select("stage", "processed", "passed", "detections", (F.col("processed") / F.col("_all")).alias("load"))
