"""Decision trees on labelled rows.

Labelled rows with a column `n` stand for so many rows that are alike, see `transactions.alike`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit, TrainValidationSplitModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coterie.functions.frames import bounded_names, new_path, scalar_of, settle
from coterie.operators import pruning

NULL_THRESHOLD = 0.3
DEFAULT_VALUE = 0.0
MAX_DEPTH = 15
MIN_LEAF = 30
MIN_GAIN = 0.001
CCP_ALPHA = 0.001


def value_counts(rows: DataFrame) -> DataFrame:
    """`label, feature, value, n`: rows of each label by value; settled, as it has the vocabulary's size."""
    long = rows.select("label", pruning.weight(rows).alias("n"), F.inline("features"))
    return settle(long.groupBy("label", "feature", "value").agg(F.sum("n").alias("n")))


def feature_nulls(rows: DataFrame, threshold: float = NULL_THRESHOLD, counts: DataFrame | None = None) -> DataFrame:
    """`feature, present, null_share, kept` over the labelled rows; `counts` if their values are counted already."""
    total = scalar_of(rows, F.sum(pruning.weight(rows)))
    counts = value_counts(rows) if counts is None else counts
    present = F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0))
    share = (total - F.col("present")) / total
    by_feature = counts.groupBy("feature").agg(present.alias("present"))
    return by_feature.withColumn("null_share", share).withColumn("kept", F.col("null_share") <= threshold)


def kept_features(rows: DataFrame, threshold: float = NULL_THRESHOLD, counts: DataFrame | None = None) -> list[str]:
    """Sorted names of the features kept."""
    return bounded_names(feature_nulls(rows, threshold, counts).where("kept"), "feature")


def modes(counts: DataFrame, *keys: str) -> DataFrame:
    """Most frequent value per key, ties to the smallest value."""
    counted = counts.groupBy(*keys, "value").agg(F.sum("n").alias("n"))
    return counted.groupBy(*keys).agg(F.max_by("value", F.struct("n", -F.col("value"))).alias("mode"))


def imputations(rows: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """`label, by_label, by_all`: maps from feature to the value that replaces a null.

    Settled: it is small and every pass over the rows needs it. With its true size Spark sends it to every
    task, so that rows are not shuffled by label, of which there are few.
    """
    counts = value_counts(rows) if counts is None else counts
    by_label = modes(counts, "label", "feature").groupBy("label").agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "mode"))).alias("by_label")
    )
    by_all = modes(counts, "feature").agg(F.map_from_entries(F.collect_list(F.struct("feature", "mode"))).alias("m")).scalar()
    labels = rows.select("label").distinct()
    return settle(labels.join(by_label, "label", "left").withColumn("by_all", by_all))


def _filled(rows: DataFrame, features: Sequence[str], fills: DataFrame, label_known: bool) -> tuple[DataFrame, list[str], list[Column]]:
    """The rows with their fills, the columns they keep, and the value of every feature."""
    kept = [c for c in ("id", "label", "n") if c in rows.columns]
    plain = rows.select(*kept, F.map_from_entries("features").alias("f"))
    if label_known:
        joined, steps = plain.join(fills, "label", "left"), ("f", "by_label", "by_all")
    else:
        joined, steps = plain.withColumn("by_all", scalar_of(fills, F.first("by_all"))), ("f", "by_all")
    values = [F.coalesce(*[F.element_at(s, n) for s in steps], F.lit(DEFAULT_VALUE)).alias(n) for n in features]
    return joined, kept, values


def imputed(rows: DataFrame, features: Sequence[str], fills: DataFrame, label_known: bool = True) -> DataFrame:
    """`id, label` and one column per feature, nulls replaced by label mode, overall mode or 0.

    Rows to be scored have no label yet: without `label_known` it is not looked at.
    """
    joined, kept, values = _filled(rows, features, fills, label_known)
    return joined.select(*kept, *values)


def vectors(rows: DataFrame, features: Sequence[str], fills: DataFrame, label_known: bool = True) -> DataFrame:
    """The imputed rows with their values as one vector `features`."""
    joined, kept, values = _filled(rows, features, fills, label_known)
    return joined.select(*kept, array_to_vector(F.array(*values)).alias("features"))


@dataclass
class Tree:
    """A fitted tree with its features and the imputations of its training rows.

    With an alpha above 0 it is the tree pruned at that cost a leaf.
    """

    model: PipelineModel
    features: list[str]
    fills: DataFrame
    ccp_alpha: float = 0.0

    @property
    def whole(self) -> dict[int, pruning.Node]:
        return pruning.read_nodes(self._saved())

    def text(self) -> str:
        """The whole tree as Spark writes it; a pruned tree by the names of its features and labels."""
        if self.ccp_alpha <= 0:
            return self.model.stages[-1].toDebugString
        kept = pruning.kept_nodes(self.whole, self.ccp_alpha)
        head = f"DecisionTree of {len(kept)} nodes, pruned at {self.ccp_alpha}"
        return head + "\n" + pruning.tree_text(kept, self.features, self.model.stages[0].labels)

    def scored(self, rows: DataFrame) -> DataFrame:
        """The rows with target and `leaf` of the whole tree; nulls are filled without a look at the label."""
        self.model.stages[-1].setLeafCol("leaf")
        return self.model.transform(vectors(rows, self.features, self.fills, label_known=False))

    def predict(self, rows: DataFrame) -> DataFrame:
        """The rows scored; nulls are filled without a look at the label, which a new row does not have."""
        scored = self.scored(rows)
        if self.ccp_alpha <= 0:
            return scored.drop("leaf")
        nodes = self.whole
        done = sum(c.alpha <= self.ccp_alpha for c in pruning.weakest_links(nodes))
        spans = pruning.leaf_spans(rows.sparkSession, nodes).where((F.col("step") <= done) & (F.coalesce("until", F.lit(done + 1)) > done))
        given = spans.select(F.col("leaf").cast("double").alias("leaf"), "prediction")
        return scored.drop("prediction", "rawPrediction", "probability").join(given, "leaf").drop("leaf")

    def path(self, rows: DataFrame) -> DataFrame:
        """The pruning path with the accuracy on labelled rows at every step, see `pruning.path_accuracy`."""
        return pruning.path_accuracy(self.scored(rows), self.whole)

    def pruned(self, ccp_alpha: float) -> Tree:
        return replace(self, ccp_alpha=ccp_alpha)

    def best_alpha(self, rows: DataFrame) -> float:
        """The alpha with the best accuracy on labelled rows that the tree has not seen; of equal ones the largest."""
        best = self.path(rows).agg(F.max_by("alpha", F.struct("hits", "step"))).head()
        return best[0]

    def accuracy(self, rows: DataFrame) -> float:
        scored = self.predict(rows).select("prediction", "target", pruning.weight(rows).cast("double").alias("n"))
        return MulticlassClassificationEvaluator(labelCol="target", metricName="accuracy", weightCol="n").evaluate(scored)

    def accuracies(self, parts: Mapping[str, DataFrame]) -> DataFrame:
        """`part, rows, accuracy` of each named table of labelled rows; a part without rows is left out."""
        scored = [
            self.predict(rows).select(F.lit(name).alias("part"), "prediction", "target", pruning.weight(rows).alias("n"))
            for name, rows in parts.items()
        ]
        hits = F.sum(F.when(F.col("prediction") == F.col("target"), F.col("n")).otherwise(0))
        return reduce(DataFrame.unionByName, scored).groupBy("part").agg(
            F.sum("n").alias("rows"), (hits / F.sum("n")).alias("accuracy")
        )

    def _saved(self) -> DataFrame:
        spark = self.fills.sparkSession
        path = new_path(spark)
        self.model.stages[-1].write().save(path)
        # Spark counts the rows it was given, which may stand for several; the statistics have their weights.
        stats = F.aggregate("impurityStats", F.lit(0.0), lambda acc, x: acc + x)
        return spark.read.parquet(f"{path}/data").withColumn("rawCount", stats.cast("long"))

    def nodes(self, spark) -> DataFrame:
        """The model's node table; below a pruned node there are none."""
        saved = self._saved()
        if self.ccp_alpha <= 0:
            return saved
        kept = pruning.kept_nodes(pruning.read_nodes(saved), self.ccp_alpha)
        table = spark.createDataFrame([(i, n.is_leaf) for i, n in kept.items()], "id int, ends boolean")
        ends = {c: F.when(F.col("ends"), F.lit(-1)).otherwise(F.col(c)).alias(c) for c in ("leftChild", "rightChild")}
        return saved.join(table, "id").select(*[ends.get(c, F.col(c)) for c in saved.columns])


def classifier(max_depth: int = MAX_DEPTH, min_leaf: int = MIN_LEAF, min_gain: float = MIN_GAIN) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(
        labelCol="target", featuresCol="features", impurity="gini", maxDepth=max_depth,
        minInstancesPerNode=min_leaf, minInfoGain=min_gain, seed=0,
    )


def weighted_classifier(total: int, max_depth: int = MAX_DEPTH, min_leaf: int = MIN_LEAF, min_gain: float = MIN_GAIN) -> DecisionTreeClassifier:
    """The classifier for rows that stand for `n` rows each, `total` in all: a leaf has `min_leaf` of them."""
    tree = classifier(max_depth, 1, min_gain).setWeightCol("n")
    if total < 2 * min_leaf:
        return tree.setMinInstancesPerNode(2 * min_leaf)  # nothing can be split
    return tree.setMinWeightFractionPerNode((min_leaf - 0.5) / total)


def even_weights(data: DataFrame, most: int) -> DataFrame:
    """The rows with no `n` above `most`, heavier ones in several even parts.

    Spark looks for thresholds in a sample of the rows it is given; so it holds what a sample of single rows would.
    """
    parts = data.withColumn("__parts", F.ceil(F.col("n") / most).cast("long"))
    parts = parts.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "__parts")).alias("__part"))
    rest = F.when(F.col("__part") <= F.col("n") % F.col("__parts"), 1).otherwise(0)
    n = F.floor(F.col("n") / F.col("__parts")) + rest
    return parts.withColumn("n", n.cast("long")).drop("__parts", "__part")


def fit_tree(rows: DataFrame, null_threshold: float = NULL_THRESHOLD, ccp_alpha: float = 0.0, **limits) -> Tree:
    """Fit a Gini tree on labelled rows, pruned at the given cost a leaf.

    Rows of one label and equal features are fitted as one with a weight, so every pass of the fit reads the
    distinct rows only; they are settled as vectors first.
    """
    counts = value_counts(rows)
    features = kept_features(rows, null_threshold, counts)
    if not features:
        raise ValueError("no feature is present often enough for the null threshold")
    fills = imputations(rows, counts)
    data = settle(vectors(rows.withColumn("n", pruning.weight(rows)), features, fills).select("label", "n", "features"))
    size = data.agg(F.sum("n").alias("total"), F.count("*").alias("rows")).first()
    indexer = StringIndexer(inputCol="label", outputCol="target", stringOrderType="alphabetAsc", handleInvalid="keep")
    stages = [indexer, weighted_classifier(size["total"], **limits)]
    return Tree(Pipeline(stages=stages).fit(even_weights(data, -(-size["total"] // size["rows"]))), features, fills, ccp_alpha)


def prune_search(
    rows: DataFrame,
    depths: Sequence[int] = (5, 10, MAX_DEPTH),
    gains: Sequence[float] = (MIN_GAIN, 0.01),
    null_threshold: float = NULL_THRESHOLD,
    train_ratio: float = 0.75,
) -> TrainValidationSplitModel:
    """Choose depth and gain on a validation share of single rows."""
    features = kept_features(rows, null_threshold)
    data = settle(vectors(rows, features, imputations(rows)))
    tree = classifier()
    indexer = StringIndexer(inputCol="label", outputCol="target", stringOrderType="alphabetAsc", handleInvalid="keep")
    grid = ParamGridBuilder().addGrid(tree.maxDepth, list(depths)).addGrid(tree.minInfoGain, list(gains)).build()
    return TrainValidationSplit(
        estimator=Pipeline(stages=[indexer, tree]), estimatorParamMaps=grid, trainRatio=train_ratio, seed=0,
        evaluator=MulticlassClassificationEvaluator(labelCol="target", metricName="accuracy"),
    ).fit(data)
