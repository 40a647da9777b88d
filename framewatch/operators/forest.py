"""The isolation forest as a Spark ML stage: fitted in pipelines, saved and loaded with them."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewatch.operators import ml


class _ForestParams(HasFeaturesCol, HasPredictionCol, HasSeed):
    """``featuresCol`` (a vector; a null one counts as zeros), ``keyCols`` (what rows are dealt to trees by), ``scoreCol``, ``predictionCol``."""

    keyCols = Param(Params._dummy(), "keyCols", "columns that tell rows apart", TypeConverters.toListString)
    scoreCol = Param(Params._dummy(), "scoreCol", "column of the score, under 0: more isolated than average", TypeConverters.toString)

    def _spread(self, df: DataFrame, size: int) -> tuple[DataFrame, list[str]]:
        """The entries of the vector as columns."""
        columns = [f"_forest_{i}" for i in range(size)]
        values = vector_to_array(self.getFeaturesCol())
        return df.withColumns({c: F.try_element_at(values, F.lit(i + 1)) for i, c in enumerate(columns)}), columns


class IsolationForest(Estimator, _ForestParams, DefaultParamsReadable, DefaultParamsWritable):
    """``numTrees`` trees of about ``sampleSize`` rows each; rows whose score is under the ``contamination`` quantile (a sketch's) of the fitted rows are predicted 1."""

    numTrees = Param(Params._dummy(), "numTrees", "trees", TypeConverters.toInt)
    sampleSize = Param(Params._dummy(), "sampleSize", "rows of a tree", TypeConverters.toInt)
    contamination = Param(Params._dummy(), "contamination", "share of rows that are taken for odd", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", predictionCol: str = "prediction", scoreCol: str = "score", keyCols: list[str] | None = None, numTrees: int = 50, sampleSize: int = 256, contamination: float = 0.05, seed: int = 42):
        super().__init__()
        self._setDefault(featuresCol="features", predictionCol="prediction", scoreCol="score", keyCols=["bus", "seq"], numTrees=50, sampleSize=256, contamination=0.05, seed=42)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> IsolationForestModel:
        size = dataset.agg(F.max(F.size(vector_to_array(self.getFeaturesCol())))).first()[0] or 0
        rows, columns = self._spread(dataset, max(size, 0))
        get = self.getOrDefault
        forest = ml.isolation_forest_fit(rows, columns, get("numTrees"), get("sampleSize"), get("contamination"), self.getSeed(), tuple(get("keyCols")))
        return self._copyValues(IsolationForestModel(forest))


class IsolationForestModel(Model, _ForestParams, MLWritable, MLReadable):
    """Adds the score and the prediction (1: odd)."""

    def __init__(self, forest: ml.Forest | None = None):
        super().__init__()
        self._setDefault(featuresCol="features", predictionCol="prediction", scoreCol="score", keyCols=["bus", "seq"], seed=42)
        self.forest = forest

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rows, columns = self._spread(dataset, len(self.forest.columns))
        score, label = self.getOrDefault("scoreCol"), self.getPredictionCol()
        return ml.isolation_forest_score(rows, self.forest, score, label).drop(*columns)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


_NODES = "tree int, node int, feature int, split double, left int, right int, path double"


class _Writer(MLWriter):
    """Parameters as Spark ML has them, and one table of nodes (bounded by trees x sample)."""

    def __init__(self, model: IsolationForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        forest = self.model.forest
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, {"columns": forest.columns, "norm": float(forest.norm), "threshold": float(forest.threshold)})
        nodes = [(t, i, int(f), float(split), int(left), int(right), float(long)) for t, tree in enumerate(forest.trees) for i, (f, split, left, right, long) in enumerate(tree)]
        self.sparkSession.createDataFrame(nodes, _NODES).coalesce(1).write.parquet(f"{path}/nodes")


class _Reader(MLReader):
    def load(self, path: str) -> IsolationForestModel:
        known = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        trees: dict[int, list] = {}
        for r in self.sparkSession.read.schema(_NODES).parquet(f"{path}/nodes").orderBy("tree", "node").collect():
            trees.setdefault(r.tree, []).append((r.feature, r.split, r.left, r.right, r.path))
        model = IsolationForestModel(ml.Forest(known["columns"], [trees[t] for t in sorted(trees)], known["norm"], known["threshold"]))
        model._resetUid(known["uid"])
        DefaultParamsReader.getAndSetParams(model, known)
        return model
