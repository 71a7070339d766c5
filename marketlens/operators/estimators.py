"""Three-class classifiers on Spark ML. Every fitted model is a `PipelineModel`.

Logistic regression and the forest are Spark's own; boosting and the kernel machine are in
`boosting` and `kernel_svm`.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens import params
from marketlens.functions.labels import argmax_class
from marketlens.operators.align import weight_join
from marketlens.operators.boosting import fit_boosting
from marketlens.operators.ensemble import PROBABILITIES
from marketlens.operators.kernel_svm import TOLERANCE, fit_margins
from marketlens.operators.metrics import class_weights


def balanced(train: DataFrame, label: str = "label", in_place: bool = False) -> DataFrame:
    """Rows with the weight of their class. A shuffle by label would leave all rows in as many
    tasks as there are classes; `in_place` sends the weights, one row per class, to the rows."""
    weights = class_weights(train, label)
    return weight_join(train, F.broadcast(weights) if in_place else weights, label)


@contextmanager
def prepared(train: DataFrame, features: str, label: str, in_place: bool = False):
    """(rows, n): balanced, persisted training rows and their number.

    Fitting reads its input several times (count, class weights, solver set-up), so features
    are computed once and spill to disk when memory is short.
    """
    narrow = train.select(features, label).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = narrow.count()
        yield balanced(narrow, label, in_place), n
    finally:
        narrow.unpersist()


def scale_gamma(train: DataFrame, vector: str) -> float:
    """1 / (features * variance of all entries), from one aggregation."""
    x = vector_to_array(vector)
    sums = train.select(
        F.size(x).alias("d"), F.aggregate(x, F.lit(0.0), lambda t, v: t + v).alias("s"),
        F.aggregate(x, F.lit(0.0), lambda t, v: t + v * v).alias("q"))
    d, n, s, q = sums.agg(F.max("d"), F.sum("d"), F.sum("s"), F.sum("q")).first()
    variance = q / n - (s / n) ** 2 if n else 0.0
    return 1.0 / (d * variance) if variance else 1.0


def fit_logistic(train: DataFrame, features: str = "features", label: str = "label",
                 C: float = 1.0, max_iter: int = 2000) -> PipelineModel:
    """Multinomial logistic regression with L2 penalty 1 / (C n) and balanced classes."""
    with prepared(train, features, label, in_place=True) as (rows, n):
        stage = LogisticRegression(
            featuresCol=features, labelCol=label, weightCol="weight", family="multinomial",
            regParam=1.0 / (C * n), elasticNetParam=0.0, standardization=False,
            maxIter=max_iter)
        return Pipeline(stages=[stage]).fit(rows)


def fit_random_forest(train: DataFrame, features: str = "features", label: str = "label",
                      trees: int = 500, depth: int = 20, min_leaf: int = 2,
                      subset: str = "sqrt", seed: int = params.SEED) -> PipelineModel:
    stage = RandomForestClassifier(
        featuresCol=features, labelCol=label, weightCol="weight", numTrees=trees,
        maxDepth=depth, minInstancesPerNode=min_leaf, featureSubsetStrategy=subset, seed=seed)
    with prepared(train, features, label) as (rows, _):
        return Pipeline(stages=[stage]).fit(rows)


def fit_gbt(train: DataFrame, features: str = "features", label: str = "label",
            rounds: int = 500, depth: int = 6, rate: float = 0.1, rows: float = 0.8,
            columns: float = 0.8, seed: int = params.SEED) -> PipelineModel:
    """Softmax boosting with one tree per class and round; see `boosting`."""
    return PipelineModel([fit_boosting(train, features, label, rounds, depth, rate, rows,
                                       columns, seed=seed)])


def fit_svm(train: DataFrame, features: str = "features", label: str = "label",
            C: float = 10.0, gamma: float | str = "scale", calibration_iter: int = 1000,
            tolerance: float = TOLERANCE) -> PipelineModel:
    """RBF-kernel machines, one-vs-rest with balanced classes, each margin calibrated by a
    logistic fit; see `kernel_svm`."""
    with prepared(train, features, label) as (source, _):
        width = scale_gamma(source, features) if gamma == "scale" else float(gamma)
        machines = fit_margins(source, features, label, "weight", C, width, tolerance)
        scored = machines.transform(source).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            stages: list = [machines]
            for c in params.CLASSES:
                own = scored.withColumn("_is", (F.col(label) == c).cast("double"))
                stages.append(LogisticRegression(
                    featuresCol=f"raw_{c}", labelCol="_is", regParam=1e-4,
                    maxIter=calibration_iter, probabilityCol=f"prob_{c}",
                    predictionCol=f"_p_{c}", rawPredictionCol=f"_r_{c}").fit(own))
        finally:
            scored.unpersist()
    return PipelineModel(stages)


FITTERS = {
    "logistic_regression": fit_logistic,
    "svm": fit_svm,
    "random_forest": fit_random_forest,
    "gbt": fit_gbt,
}


def with_probabilities(scored: DataFrame) -> DataFrame:
    """Append p_down, p_neutral, p_up and the winning class to a model's output."""
    if "probability" in scored.columns:
        parts = vector_to_array("probability")
        shares = [F.coalesce(F.get(parts, c), F.lit(0.0)) for c in params.CLASSES]
    else:
        each = [vector_to_array(f"prob_{c}")[1] for c in params.CLASSES]
        total = each[0] + each[1] + each[2]
        shares = [F.coalesce(F.try_divide(p, total), F.lit(1.0 / len(each))) for p in each]
    named = scored.drop("prediction").withColumns(dict(zip(PROBABILITIES, shares)))
    return named.withColumn("prediction", argmax_class(*PROBABILITIES))


def predict_probabilities(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Append p_down, p_neutral, p_up and the winning class, dropping the model's columns."""
    return with_probabilities(model.transform(df)).select(
        *df.columns, *PROBABILITIES, "prediction")
