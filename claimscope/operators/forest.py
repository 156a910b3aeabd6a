"""Tree ensembles as a table of nodes, evaluated as one column expression.

A row is a node: an inner one sends values up to ``threshold`` of ``feature`` to ``left_node`` and others to ``right_node``, a leaf has a ``value``, weighted
already. The margin of a row is the sum of the leaves it comes to; a margin above 0 means label 1.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "tree int, node int, feature string, threshold double, left_node int, right_node int, value double"
Node = tuple[int, int, str | None, float | None, int | None, int | None, float | None]


@dataclass(frozen=True)
class Forest:
    """The nodes of all trees, by tree and node; each tree starts at node 0."""

    nodes: tuple[Node, ...]

    @classmethod
    def of_model(cls, spark: SparkSession, model: GBTClassificationModel, features: Sequence[str], path: str) -> Forest:
        """The nodes of a fitted model, which is written to ``path`` and read back as a table.

        ``features`` names the model's vector in order. Their number is bounded by the parameters of the fit.
        """
        model.write().overwrite().save(path)
        data = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
        is_leaf = F.col("leftChild") < 0
        rows = data.select(
            F.col("treeID").alias("tree"),
            F.col("id").alias("node"),
            F.when(~is_leaf, F.col("split.featureIndex")).alias("place"),
            F.when(~is_leaf, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
            F.when(~is_leaf, F.col("leftChild")).alias("left_node"),
            F.when(~is_leaf, F.col("rightChild")).alias("right_node"),
            F.when(is_leaf, F.col("prediction")).alias("value"),
        )
        nodes = []
        for tree, node, place, threshold, left, right, value in rows.orderBy("tree", "node").collect():
            feature = None if place is None else features[place]
            weighted = None if value is None else value * model.treeWeights[tree]
            nodes.append((tree, node, feature, threshold, left, right, weighted))
        return cls(tuple(nodes))

    @classmethod
    def of_table(cls, table: DataFrame) -> Forest:
        columns = [part.split()[0] for part in NODES.split(", ")]
        return cls(tuple(tuple(r) for r in table.select(*columns).orderBy("tree", "node").collect()))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.nodes), NODES)

    def features(self) -> list[str]:
        """The features that the trees ask for, in order of their names."""
        return sorted({n[2] for n in self.nodes if n[2] is not None})

    def margin(self, columns: Mapping[str, str]) -> str:
        """SQL text of the margin; ``columns`` gives the text of each feature."""
        trees: dict[int, dict[int, Node]] = {}
        for node in self.nodes:
            trees.setdefault(node[0], {})[node[1]] = node

        def walk(tree: Mapping[int, Node], at: int) -> str:
            _, _, feature, threshold, left, right, value = tree[at]
            if feature is None:
                return f"{value!r}D"
            return f"CASE WHEN {columns[feature]} <= {threshold!r}D THEN {walk(tree, left)} ELSE {walk(tree, right)} END"

        return " + ".join(walk(tree, 0) for tree in trees.values())
