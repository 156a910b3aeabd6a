"""Fit and apply the claim classifier: features, scaling, boosted trees."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope import schemas as S
from claimscope.functions.claims import quoted
from claimscope.operators.forest import Forest
from claimscope.operators.lookup import id_join, skew_safe_join
from claimscope.operators.scale import Scaler, fit_scaler
from claimscope.plans.features import ROW_ID, ClaimPool, Limits, make_pool, pool_matrix
from claimscope.plans.history_store import HistoryStore, history_moments
from claimscope.sources.staging import stage, staging_root, use_checkpoint_dir

LABEL = "label"


def assemble(scaled: DataFrame, names: list[str]) -> DataFrame:
    """Features as one vector column, other columns kept out of it."""
    return VectorAssembler(inputCols=names, outputCol="features").transform(scaled).drop(*names)


@dataclass
class ClaimScorer:
    """Fitted state: category levels, scaler in feature order, trees; after a fit also the model they come from.

    A history is a table of claims, or kept statistics, of which a batch reads what its own keys and ids need.
    """

    levels: dict
    scaler: Scaler
    forest: Forest
    model: GBTClassificationModel | None = field(default=None, compare=False)

    @classmethod
    def fit(
        cls,
        history: DataFrame | HistoryStore,
        labels: DataFrame,
        trees: int = 20,
        depth: int = 5,
        seed: int = 42,
        limits: Limits = Limits(),
    ) -> ClaimScorer:
        """Fit on the history itself; ``labels`` gives each ``Provider`` a 0/1 ``label``."""
        spark = labels.sparkSession
        use_checkpoint_dir(spark)
        kept = isinstance(history, HistoryStore)
        pool = history.own_pool(limits) if kept else ClaimPool(history, None, limits)
        fitted = pool_matrix(pool, None, False, ["Provider"])
        matrix = stage(fitted.frame, "matrix")
        scaler = history_moments(history, fitted.levels).scaler() if kept else fit_scaler(matrix, fitted.names)
        vectors = assemble(scaler.transform(matrix), fitted.names)
        training = skew_safe_join(vectors, stage(labels, "labels"), "Provider", "inner")
        trees_fit = GBTClassifier(
            labelCol=LABEL, featuresCol="features", maxIter=trees, maxDepth=depth, seed=seed
        )
        model = trees_fit.fit(training.select("features", LABEL))
        forest = Forest.of_model(spark, model, fitted.names, f"{staging_root(spark)}/trees-{uuid.uuid4().hex}")
        return cls(fitted.levels, scaler, forest, model)

    def margins(
        self, batch: DataFrame, history: DataFrame | HistoryStore, limits: Limits = Limits()
    ) -> DataFrame:
        """``ClaimID`` and ``margin``, one row per distinct batch claim; only the trees' features are built."""
        used = self.forest.features()
        matrix = pool_matrix(make_pool(batch, history, limits), self.levels, False, only=used)
        scaled = self.scaler.only(used).transform(matrix.frame)
        margin = self.forest.margin({n: quoted(n) for n in used})
        return scaled.selectExpr(ROW_ID, f"{margin} AS margin")

    def predict(
        self, batch: DataFrame, history: DataFrame | HistoryStore, limits: Limits = Limits()
    ) -> DataFrame:
        """``ClaimID`` and predicted label, one row per distinct batch claim."""
        return self.margins(batch, history, limits).select(
            ROW_ID, (F.col("margin") > 0).cast("int").alias(S.PREDICTION)
        )

    def score(
        self, sample: DataFrame, history: DataFrame | HistoryStore, limits: Limits = Limits()
    ) -> DataFrame:
        """Every row of the sample with its prediction."""
        predicted = stage(self.predict(sample, history, limits), "predictions")
        return id_join(sample, predicted, ROW_ID)

    def save(self, spark: SparkSession, path: str) -> None:
        self.scaler.save(spark, f"{path}/scaler")
        rows = [(c, i, v) for c, values in self.levels.items() for i, v in enumerate(values)]
        spark.createDataFrame(rows, "category string, position int, level int").coalesce(
            1
        ).write.mode("overwrite").parquet(f"{path}/levels")
        self.forest.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ClaimScorer:
        levels: dict = {c: [] for c in S.CATEGORIES}
        for row in spark.read.parquet(f"{path}/levels").orderBy("category", "position").collect():
            levels[row.category].append(row.level)
        scaler = Scaler.load(spark, f"{path}/scaler")
        return cls(levels, scaler, Forest.of_table(spark.read.parquet(f"{path}/trees")))
