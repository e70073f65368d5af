"""Training, tuning and scoring of flow classifiers with Spark ML."""

from __future__ import annotations

import itertools
import random
from collections import Counter

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassificationModel, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.functions.columns import finite, label_index, probability_map
from flowquarry.operators import metrics
from flowquarry.operators.profile import q
from flowquarry.operators.quantiles import exact_quantiles
from flowquarry.plans import forest as flat
from flowquarry.schema import CLASSES

SEED, TREES, CANDIDATES = 42, 100, 20

#: The search space. Trees deeper than 30 and a least number of rows to split are not offered by Spark's forest.
SPACE = {
    "numTrees": [100, 200, 300, 500], "maxDepth": [10, 20, 30], "minInstancesPerNode": [1, 2, 4],
    "featureSubsetStrategy": ["sqrt", "log2", "all"], "bootstrap": [True, False], "balanced": [True, False],
}


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight) with weight = rows / (classes * rows of the class)."""
    n = df.where(q(label).isNotNull()).groupBy(q(label).alias("label")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return n.crossJoin(F.broadcast(total)).select("label", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))


def medians(train: DataFrame, names: list[str]) -> DataFrame:
    """(column_name, median) of finite values, interpolated."""
    found = exact_quantiles(train, names, [0.5])
    return train.sparkSession.createDataFrame([(n, v[0]) for n, v in found.items()], "column_name string, median double")


def impute(df: DataFrame, train: DataFrame, names: list[str]) -> DataFrame:
    """Missing and non-finite values replaced by the training rows' medians."""
    found = exact_quantiles(train, names, [0.5])
    new = {c: F.coalesce(finite(q(c).cast("double")), F.lit(found[c][0]).cast("double")) for c in names}
    return df.select(*[new[c].alias(c) if c in new else q(c) for c in df.columns])


class MedianImputer(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Exact, interpolated medians of finite values (the built-in imputer takes a data point and keeps infinities)."""

    def __init__(self, names: list[str] | None = None):
        super().__init__()
        if names:
            self._set(inputCols=names)

    def _fit(self, dataset: DataFrame) -> MedianImputerModel:
        names = self.getInputCols()
        found = exact_quantiles(dataset, names, [0.5])
        return MedianImputerModel(names, [found[c][0] or 0.0 for c in names])


class MedianImputerModel(Model, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    values = Param(Params._dummy(), "values", "the value that stands for what is missing, per input column", TypeConverters.toListFloat)

    def __init__(self, names: list[str] | None = None, values: list[float] | None = None):
        super().__init__()
        if names is not None:
            self._set(inputCols=names, values=values)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        new = {c: F.coalesce(finite(q(c).cast("double")), F.lit(m)) for c, m in zip(self.getInputCols(), self.getOrDefault(self.values))}
        return dataset.select(*[new[c].alias(c) if c in new else q(c) for c in dataset.columns])


class BalancedWeights(Estimator):
    """Adds a weight column from the class counts of the rows it is fitted on, so folds get weights of their own."""

    def _fit(self, dataset: DataFrame) -> BalancedWeightsModel:
        rows = class_weights(dataset.withColumn("_i", q("label_index").cast("string")), "_i").collect()  # one row per class
        return BalancedWeightsModel([float(r["label"]) for r in rows], [r["weight"] for r in rows])


class BalancedWeightsModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    classes = Param(Params._dummy(), "classes", "class indices", TypeConverters.toListFloat)
    weights = Param(Params._dummy(), "weights", "the weight of each class", TypeConverters.toListFloat)

    def __init__(self, classes: list[float] | None = None, weights: list[float] | None = None):
        super().__init__()
        if classes is not None:
            self._set(classes=classes, weights=weights)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Rows without a class, as in scoring, weigh 1."""
        if "label_index" not in dataset.columns:
            return dataset.withColumn("weight", F.lit(1.0))
        table = F.create_map(*[F.lit(x) for pair in zip(self.getOrDefault(self.classes), self.getOrDefault(self.weights)) for x in pair])
        return dataset.withColumn("weight", F.coalesce(F.element_at(table, q("label_index").cast("double")), F.lit(1.0)))


class MacroF1(Evaluator):
    """Macro-averaged F1 over the fixed classes (the built-in "f1" is the weighted one)."""

    def _evaluate(self, dataset: DataFrame) -> float:
        """One short job: the confusion counts (at most classes * classes rows) are added up here, as `metrics.overall` does in a plan."""
        found = dataset.where("label_index is not null and prediction is not null").groupBy("label_index", "prediction").count().collect()
        actual, predicted, hits = Counter(), Counter(), Counter()
        for i, j, n in found:
            actual[int(i)] += n
            predicted[int(j)] += n
            hits[int(i)] += n * (i == j)
        f1 = [2.0 * hits[k] / (actual[k] + predicted[k]) if actual[k] + predicted[k] else 0.0 for k in range(len(CLASSES))]
        return round(sum(f1) / len(CLASSES), 6)

    def isLargerBetter(self) -> bool:
        return True


def named_predictions(scored: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(c) for c in CLASSES])
    at = lambda c: F.get(names, q(c).cast("int"))
    return scored.withColumn("label", at("label_index")).withColumn("predicted_label", at("prediction"))


def with_index(df: DataFrame, label: str) -> DataFrame:
    """The fixed class index; rows out of scope go."""
    return df.withColumn("label_index", label_index(q(label)).cast("double")).where("label_index is not null")


class ForestModel(RandomForestClassificationModel):
    """Wraps its trees when they are asked for. The built-in model wraps all of them with every fit, by some dozens of calls each."""

    @property
    def trees(self) -> list[DecisionTreeClassificationModel]:
        return [DecisionTreeClassificationModel(t) for t in self._call_java("trees")]


#: Rows times trees of one fit. Spark keeps a number for each, by row, besides the rows, and some more for the nodes that rows are in.
CELLS = 1 << 28


class Forest(RandomForestClassifier):
    """Trees are fitted in groups whose rows times trees stay under CELLS, and put together as one forest: what a fit keeps in memory and on disk
    grows with the rows, but not with the rows times all trees. Groups differ in their seeds; one group is the built-in forest itself."""

    def _create_model(self, java_model) -> ForestModel:
        return ForestModel(java_model)

    def _fit(self, dataset: DataFrame) -> ForestModel:
        trees = self.getNumTrees()
        at_once = max(1, CELLS // max(1, dataset.count()))
        if trees <= at_once:
            return super()._fit(dataset)
        found, sizes = [], [len(range(i, trees, -(-trees // at_once))) for i in range(-(-trees // at_once))]  # even groups
        for i, n in enumerate(sizes):
            # a few shallow trees are sent to the tasks at less cost than rows remember their nodes
            own = {self.numTrees: n, self.seed: self.getSeed() + i, self.cacheNodeIds: self.getCacheNodeIds() and self.getMaxDepth() > 10}
            found.append(self.copy(own)._fit_java(dataset))
        gateway, kinds = dataset.sparkSession.sparkContext._gateway, dataset.sparkSession.sparkContext._jvm.org.apache.spark.ml.classification
        whole, every = gateway.new_array(kinds.DecisionTreeClassificationModel, trees), [t for m in found for t in m.trees()]
        for i, t in enumerate(every):
            whole[i] = t
        classes = max(m.numClasses() for m in found)
        model = self._copyValues(self._create_model(kinds.RandomForestClassificationModel(found[0].uid(), whole, found[0].numFeatures(), classes)))
        model._transfer_params_to_java()
        return model


def forest(balanced: bool = True, **params) -> Forest:
    # rows remember the node they are in, so that a level of deep trees does not send the whole forest to the tasks again
    given = {"numTrees": TREES, "maxDepth": 10, "featureSubsetStrategy": "sqrt", "cacheNodeIds": True} | params
    weight = {"weightCol": "weight"} if balanced else {}
    return Forest(labelCol="label_index", featuresCol="features", seed=SEED, **weight, **given)


def preparation(features: list[str]) -> list:
    """The stages before the forest: impute, weigh, assemble; all fitted on the training rows alone."""
    return [MedianImputer(features), BalancedWeights(), VectorAssembler(inputCols=[f"`{c}`" if "." in c else c for c in features], outputCol="features")]


def fit(train: DataFrame, features: list[str], **params) -> PipelineModel:
    """A pipeline that can be saved whole. Trees depend on the order of rows: give rows that are stored in one, or sort them."""
    return Pipeline(stages=[*preparation(features), forest(**params)]).fit(train)


def score(model: PipelineModel, df: DataFrame, version: str) -> DataFrame:
    """Inputs with predicted_label, confidence, probabilities and model_version, by the forest in flat arrays; by the pipeline, if it is too large for that."""
    compiled = flat.compiled(model)
    return flat.score(compiled, df, version) if compiled else score_by_pipeline(model, df, version)


def score_by_pipeline(model: PipelineModel, df: DataFrame, version: str) -> DataFrame:
    """As `score`, by the pipeline's own stages."""
    names = F.array(*[F.lit(c) for c in CLASSES])
    out = model.transform(df)
    p = probability_map("probability", CLASSES)
    label = F.get(names, q("prediction").cast("int"))
    return out.select(*[q(c) for c in df.columns], label.alias("predicted_label"), F.element_at(p, label).alias("confidence"), p.alias("probabilities"), F.lit(version).alias("model_version"))


def score_batch(model: PipelineModel, df: DataFrame, version: str, keep: list[str]) -> DataFrame:
    """The columns `keep` with prediction, confidence, probabilities, model_version and ignored_features: all other columns that the model does not use.

    Columns may come in any order. A missing or doubled feature is an error, and so is a batch without rows.
    """
    wanted = model.stages[0].getInputCols()
    odd = sorted({c for c in wanted if df.columns.count(c) != 1})
    if odd:
        raise ValueError(f"features that are missing or doubled: {odd}")
    if df.isEmpty():
        raise ValueError("the batch has no rows")
    ignored = [c for c in df.columns if c not in wanted and c not in keep]
    used = df.select(*[q(c) for c in dict.fromkeys([*keep, *wanted])])
    out = score(model, used, version).drop(*[c for c in wanted if c not in keep])
    return out.withColumn("ignored_features", F.array(*[F.lit(c) for c in ignored]).cast("array<string>"))


def candidates(space: dict[str, list], n: int, seed: int = SEED) -> list[dict]:
    """n distinct points of the space (all, if it has no more), in a fixed random order."""
    grid = [dict(zip(space, values)) for values in itertools.product(*space.values())]
    random.Random(seed).shuffle(grid)
    return grid[:n]


def search(train: DataFrame, features: list[str], space: dict[str, list] | None = None, n: int = CANDIDATES) -> DataFrame:
    """(candidate, params, fold, train_f1, test_f1) for each candidate and value of train's `fold` column; see `forest.search`."""
    return flat.search(train, features, candidates(space or SPACE, n))


def cv_results(found: DataFrame) -> DataFrame:
    mean = [F.avg("train_f1").alias("mean_train_f1"), F.avg("test_f1").alias("mean_test_f1"), F.stddev_pop("test_f1").alias("std_test_f1")]
    return found.groupBy("candidate", "params").agg(*mean)


def best_candidate(results: DataFrame) -> DataFrame:
    """The row of `cv_results` with the largest mean on the test folds; of equal ones the first candidate."""
    return results.orderBy(F.desc("mean_test_f1"), "candidate").limit(1)


def importances(spark: SparkSession, model: PipelineModel, features: list[str]) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, importance double")
