"""Scaling, selection, PCA, isolation forests, decision trees and sampling on feature tables."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.feature import PCA, PCAModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from framewatch.operators import select
from framewatch.storage import kept


@dataclass
class Scaler:
    """shift and scale by column: (x - shift) / scale."""

    method: str
    shift: dict[str, float]
    scale: dict[str, float]


def fit_scaler(df: DataFrame, columns: list[str], method: str = "minmax") -> Scaler:
    """``minmax``, ``zscore`` (sample sd), ``robust`` (median, interquartile range) or ``none``, in one aggregate. A column without spread is only shifted (minmax: to 0); a missing value counts as 0."""
    c = {x: F.coalesce(F.col(x).cast("double"), F.lit(0.0)) for x in columns}
    aggs: list[Column] = []
    for x, v in c.items():
        if method == "minmax":
            pair = (F.min(v), F.max(v) - F.min(v))
        elif method == "zscore":
            pair = (F.avg(v), F.stddev_samp(v))
        elif method == "robust":
            pair = (F.percentile(v, F.lit(0.5)), F.percentile(v, F.lit(0.75)) - F.percentile(v, F.lit(0.25)))
        elif method == "none":
            pair = (F.lit(0.0), F.lit(1.0))
        else:
            raise ValueError(f"unknown method: {method}")
        aggs += [F.first(pair[0]).alias(f"{x}_a") if method == "none" else pair[0].alias(f"{x}_a"), F.first(pair[1]).alias(f"{x}_b") if method == "none" else pair[1].alias(f"{x}_b")]
    r = df.agg(*aggs).first()
    return Scaler(method, {x: r[f"{x}_a"] or 0.0 for x in columns}, {x: r[f"{x}_b"] or 1.0 for x in columns})


def transform(df: DataFrame, scaler: Scaler) -> DataFrame:
    """Scaled columns; one that was not fitted, or is missing, is 0."""
    value = lambda x: F.coalesce(F.col(x).cast("double"), F.lit(0.0)) if x in df.columns else F.lit(0.0)
    return df.withColumns({x: (value(x) - scaler.shift[x]) / scaler.scale[x] for x in scaler.shift})


def inverse(df: DataFrame, scaler: Scaler) -> DataFrame:
    return df.withColumns({x: F.col(x) * scaler.scale[x] + scaler.shift[x] for x in scaler.shift if x in df.columns})


def validate_features(df: DataFrame, expected: list[str]) -> DataFrame:
    """(feature, problem, rows): missing, extra, non-numeric columns, and values of 1e10 and over or not finite."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    found = [(c, "missing", 0) for c in expected if c not in kinds] + [(c, "extra", 0) for c in kinds if c not in expected]
    found += [(c, "not numeric", 0) for c in expected if c in kinds and not isinstance(kinds[c], NumericType)]
    numeric = [c for c in expected if c in kinds and isinstance(kinds[c], NumericType)]
    if numeric:
        big = lambda c: F.coalesce((F.abs(F.col(c).cast("double")) >= 1e10) | F.isnan(F.col(c).cast("double")), F.lit(False))
        r = df.agg(*(F.coalesce(F.sum(big(c).cast("long")), F.lit(0)).alias(c) for c in numeric)).first()
        found += [(c, "too large", r[c]) for c in numeric if r[c]]
    return df.sparkSession.createDataFrame(found, "feature string, problem string, rows long")


def select_by_variance(df: DataFrame, columns: list[str], threshold: float = 0.0) -> list[str]:
    r = df.agg(*(F.coalesce(F.var_samp(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in columns)).first()
    return [c for c in columns if r[c] >= threshold]


@dataclass
class Reduction:
    columns: list[str]
    scaler: Scaler
    model: PCAModel


def _assembled(df: DataFrame, scaler: Scaler, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=[f"_z_{c}" for c in columns], outputCol="_v").transform(transform(df.select("*"), scaler).withColumns({f"_z_{c}": F.col(c) for c in columns}))


def pca_fit(df: DataFrame, columns: list[str], k: int) -> Reduction:
    """Standardise, then principal components."""
    scaler = fit_scaler(df, columns, "zscore")
    return Reduction(columns, scaler, PCA(k=k, inputCol="_v", outputCol="_pc").fit(_assembled(df, scaler, columns)))


def pca_transform(df: DataFrame, r: Reduction) -> DataFrame:
    """Adds ``pc``, an array of the components."""
    keep = df.columns
    scored = r.model.transform(_assembled(df.withColumns({f"_keep_{c}": F.col(c) for c in r.columns}), r.scaler, r.columns))
    return scored.select(*((F.col(f"_keep_{c}").alias(c) if c in r.columns else F.col(c)) for c in keep), vector_to_array("_pc").alias("pc"))


def pca_inverse(df: DataFrame, r: Reduction) -> DataFrame:
    """Columns rebuilt from ``pc``."""
    m = r.model.pc.toArray()
    out = {}
    for i, c in enumerate(r.columns):
        z = sum((F.col("pc")[j] * float(m[i, j]) for j in range(m.shape[1])), F.lit(0.0))
        out[c] = z * r.scaler.scale[c] + r.scaler.shift[c]
    return df.withColumns(out)


def loadings(r: Reduction) -> list[tuple[str, int, float]]:
    m = r.model.pc.toArray()
    return [(c, j, float(m[i, j])) for i, c in enumerate(r.columns) for j in range(m.shape[1])]


def importance(r: Reduction) -> list[tuple[str, float]]:
    """Features by the sum of their absolute loadings, highest first."""
    return sorted(((c, float(np.abs(row).sum())) for c, row in zip(r.columns, r.model.pc.toArray())), key=lambda x: -x[1])


# --- isolation forest ---------------------------------------------------------


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple[int, float, int, int, float]]:
    """Nodes (feature or -1, split, left, right, path length) of one tree."""
    nodes: list[tuple[int, float, int, int, float]] = []

    def add(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append((-1, 0.0, 0, 0, depth + average_path(len(rows))))
        low, high = (x[rows].min(axis=0), x[rows].max(axis=0)) if len(rows) else (np.zeros(x.shape[1]),) * 2
        live = np.flatnonzero(high > low)
        if depth < limit and len(rows) > 1 and len(live):
            f = int(rng.choice(live))
            split = float(rng.uniform(low[f], high[f]))
            left = x[rows, f] < split
            nodes[at] = (f, split, add(rows[left], depth + 1), add(rows[~left], depth + 1), 0.0)
        return at

    add(np.arange(len(x)), 0)
    return nodes


def average_path(n: int) -> float:
    """Mean depth of an unsuccessful search among n."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


@dataclass
class Forest:
    columns: list[str]
    trees: list[list[tuple[int, float, int, int, float]]]
    norm: float
    threshold: float = 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0.5 - 2^(-mean path / norm): under 0 is more isolated than average."""
        total = np.zeros(len(x))
        for tree in self.trees:
            f, split, left, right, path = (np.array(v) for v in zip(*tree))
            at = np.zeros(len(x), int)
            while True:
                inner = np.flatnonzero(f[at] >= 0)
                if not len(inner):
                    break
                now = at[inner]
                at[inner] = np.where(x[inner, f[now]] < split[now], left[now], right[now])
            total += path[at]
        return 0.5 - 2.0 ** (-total / max(1, len(self.trees)) / self.norm)


def isolation_forest_fit(df: DataFrame, columns: list[str], trees: int = 50, sample: int = 256, contamination: float = 0.05, seed: int = 42, keys: tuple[str, ...] = ("bus", "seq")) -> Forest:
    """One tree for each of ``trees`` groups of about ``sample`` rows, grown in parallel; rows are dealt by a seeded hash of ``keys``.

    The threshold is the contamination quantile of the scores of all rows.
    """
    n = df.count()
    h = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(max(n, trees * sample)))
    rows = df.select(h.alias("_h"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns))
    if n >= trees * sample:
        rows = rows.filter(F.col("_h") < trees * sample).withColumn("_tree", F.expr(f"cast(_h % {trees} as int)"))
    else:  # too few rows for samples of their own: every tree draws from all
        copies = [t for t in range(trees)]
        rows = rows.withColumn("_tree", F.explode(F.array(*(F.lit(t) for t in copies)))).filter(F.expr(f"pmod(xxhash64(_h, _tree), {max(n, 1)}) < {sample}"))

    def grow(key: tuple[int], part: pd.DataFrame) -> pd.DataFrame:
        x = part[columns].to_numpy()
        order = np.lexsort(x.T[::-1])  # the same tree whatever order rows arrive in
        return pd.DataFrame({"tree": [key[0]], "nodes": [pickle.dumps(_grow(x[order], np.random.default_rng(seed + key[0]), int(np.ceil(np.log2(max(2, sample))))))]})

    got = sorted(rows.groupBy("_tree").applyInPandas(grow, "tree int, nodes binary").collect())
    forest = Forest(columns, [pickle.loads(r.nodes) for r in got], average_path(min(sample, max(2, n))))
    forest.threshold = isolation_forest_score(df, forest).agg(F.percentile_approx("score", contamination, 10_000)).first()[0] or 0.0
    return forest


def isolation_forest_score(df: DataFrame, forest: Forest, score_name: str = "score", label_name: str = "label") -> DataFrame:
    """Adds score and label (1 under the threshold), under the names given; trees are broadcast (bounded by trees x sample)."""
    sent = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in parts:
            yield pd.Series(sent.value.scores(np.stack([c.fillna(0).to_numpy(float) for c in columns], axis=1)))

    return df.withColumn(score_name, score(*(F.col(c).cast("double") for c in forest.columns))).withColumn(label_name, (F.col(score_name) < forest.threshold).cast("int"))


def ml_alerts(scored: DataFrame, columns: list[str]) -> DataFrame:
    """Alerts of hits: anomaly_score, confidence min(|score|, 1), features as a map, reason."""
    features = F.map_from_arrays(F.array(*(F.lit(c) for c in columns)), F.array(*(F.col(c).cast("double") for c in columns)))
    return scored.filter("label = 1").select("bus", "seq", "ts_us", "can_id", F.col("score").alias("anomaly_score"), F.least(F.abs("score"), F.lit(1.0)).alias("confidence"), features.alias("features"), F.lit("isolated from normal traffic").alias("reason"))


# --- decision tree ------------------------------------------------------------


def decision_tree_fit(df: DataFrame, columns: list[str], label: str = "attack", depth: int = 10, leaf: int = 10) -> DecisionTreeClassificationModel:
    """A tree with balanced class weights."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    n, k = sum(counts.values()), max(1, len(counts))
    weight = F.lit(1.0)
    for value, c in counts.items():
        weight = F.when(F.col(label) == value, n / (k * c)).otherwise(weight)
    rows = VectorAssembler(inputCols=columns, outputCol="_v", handleInvalid="keep").transform(df.select(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns), F.col(label).cast("double").alias("_y"), weight.alias("_w")))
    return DecisionTreeClassifier(featuresCol="_v", labelCol="_y", weightCol="_w", maxDepth=depth, minInstancesPerNode=leaf, seed=42).fit(rows)


def decision_tree_score(df: DataFrame, model: DecisionTreeClassificationModel, columns: list[str], threshold: float = 0.5) -> DataFrame:
    """Adds probability (of label 1) and label."""
    rows = df.withColumn("_v", F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns)))


    scored = model.setPredictionCol("_p").setRawPredictionCol("_r").setProbabilityCol("_q").transform(rows.withColumn("_v", array_to_vector("_v")))
    p = vector_to_array("_q")
    return scored.withColumn("probability", F.coalesce(F.try_element_at(p, F.lit(2)), F.lit(0.0))).withColumn("label", (F.col("probability") >= threshold).cast("int")).drop("_v", "_p", "_r", "_q")


def importances(model: DecisionTreeClassificationModel, columns: list[str], least: float = 0.01) -> list[tuple[str, float]]:
    return sorted(((c, float(v)) for c, v in zip(columns, model.featureImportances.toArray()) if v > least), key=lambda x: -x[1])


def seeded_hash(*columns: str, seed: int) -> Column:
    """Sixty bits of the MD5 of some columns and a seed, as SQL has it too."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns), F.lit(str(seed))).cast("binary")), 1, 15), 16, 10).cast("long")


def balanced_sample(df: DataFrame, caps: dict[int, int], label: str = "attack", by: str = "source_file", seed: int = 42, train: float = 0.8) -> DataFrame:
    """At most ``caps[label]`` rows per class and file, those of the least seeded hash, with ``split``: test for 1 - ``train`` of each class (rounded up, of the rows left), else train.

    Both cuts are found by counts (``select``), so that neither a class nor a file is
    sorted or windowed. Rows of one bus and seq that are repeated stand in any order.
    """
    rows = df.withColumns({"_h": seeded_hash("bus", "seq", seed=seed), "_s": F.coalesce("seq", F.lit(-1))})
    cap = F.lit(0)
    for value, n in caps.items():
        cap = F.when(F.col(label) == value, n).otherwise(cap)
    need = rows.select(label, by).distinct().withColumn("n", cap)
    chosen = select.mark_first(rows, [label, by], need, [F.col("_h"), F.col("_s")], "_kept").filter("_kept").drop("_kept")
    chosen = kept(chosen.withColumn("_h", seeded_hash("bus", "seq", seed=seed + 1)), "sample")
    tests = chosen.groupBy(label).agg(F.count("*").alias("n")).withColumn("n", F.expr(f"(n * {1000 - round(train * 1000)} + 999) div 1000"))
    split = select.mark_first(chosen, [label], tests, [F.col("_h"), F.col("_s")], "_test")
    return split.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_h", "_s", "_test")


def dual_models(df: DataFrame, timing: list[str], payload: list[str], label: str = "attack") -> tuple[DecisionTreeClassificationModel, DecisionTreeClassificationModel]:
    """A tree on timing columns and one on payload columns."""
    return decision_tree_fit(df, timing, label), decision_tree_fit(df, payload, label)
