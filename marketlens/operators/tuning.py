"""Grid search, cross-validation, benchmark and explanation jobs."""

from __future__ import annotations

import itertools
import json
import time
from collections.abc import Callable, Mapping
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens import params
from marketlens.operators.estimators import FITTERS, predict_probabilities
from marketlens.operators.metrics import cv_summary, metrics_summary, rank_models
from marketlens.operators.running import hash_bucket, hash_key
from marketlens.operators.splits import stratified_folds
from marketlens.sources.workspace import new_path

#: Fits that run at a time.
PARALLELISM = 4

# Full search spaces, by the fitters' arguments; pass a smaller grid to bound
# the cost.
PARAM_GRIDS = {
    "logistic_regression": {"C": [0.1, 1.0, 10.0, 100.0]},
    "svm": {"C": [1.0, 10.0, 50.0, 100.0], "gamma": ["scale", 0.01, 0.001]},
    "random_forest": {"trees": [300, 500, 700], "depth": [15, 20, 30],
                      "subset": ["sqrt", "log2"]},
    "gbt": {"rounds": [300, 500, 700], "depth": [4, 6, 8], "rate": [0.01, 0.05, 0.1],
            "rows": [0.7, 0.8, 1.0]},
}


def grid_search(df: DataFrame, name: str, grid: Mapping[str, list] | None = None,
                row_id: str = "id", label: str = "label", k: int = params.FOLDS,
                fixed: Mapping | None = None, parallelism: int = PARALLELISM
                ) -> tuple[PipelineModel, DataFrame]:
    """Exhaustive search over a fitter's arguments by k-fold macro-F1; refits the best point.

    All fits read one stored table of folded rows, and `parallelism` of them run at a time.

    `grid` is the model's entry of `PARAM_GRIDS` by default, `fixed` holds further arguments.
    Class weights are computed inside each fit, so a fold never sees the held-out counts.
    Returns the model and a table (params, f1_macro), one row per point, best first; the
    smaller parameter text wins a tie.
    """
    grid, fixed = PARAM_GRIDS[name] if grid is None else grid, fixed or {}
    points = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    spark = df.sparkSession
    path = new_path(spark, "folds")
    stratified_folds(df, label, row_id, k).write.parquet(path)
    folded = spark.read.parquet(path)

    def one(job: tuple[int, int]) -> float:
        point, fold = job
        return _fold_score(folded, fold, lambda train: FITTERS[name](
            train, **fixed, **points[point]))

    scores = _concurrently(spark, one, [(p, fold) for p in range(len(points))
                                        for fold in range(k)], parallelism)
    rows = [(json.dumps(point, sort_keys=True), sum(scores[i * k:(i + 1) * k]) / k)
            for i, point in enumerate(points)]
    table = df.sparkSession.createDataFrame(rows, "params string, f1_macro double")
    table = table.orderBy(F.col("f1_macro").desc(), "params")
    best = json.loads(min(rows, key=lambda row: (-row[1], row[0]))[0])
    return FITTERS[name](df, **fixed, **best), table


def _concurrently(spark: SparkSession, job: Callable, jobs: list, parallelism: int) -> list:
    """Results of independent driver-side jobs, in order, `parallelism` of them at a time."""
    with ThreadPool(min(parallelism, len(jobs)) or 1) as pool:
        return pool.map(inheritable_thread_target(spark)(job), jobs)


def _fold_score(folded: DataFrame, fold: int,
                fit: Callable[[DataFrame], PipelineModel]) -> float:
    """Macro-F1 on one fold of a model fitted on the others."""
    model = fit(folded.where(F.col("fold") != fold))
    scored = predict_probabilities(model, folded.where(F.col("fold") == fold))
    return float(metrics_summary(scored).first()["f1_macro"])


def fold_scores(df: DataFrame, fit: Callable[[DataFrame], PipelineModel], row_id: str = "id",
                label: str = "label", k: int = params.FOLDS) -> DataFrame:
    """(fold, score): macro-F1 of each fold under a model fitted on the other folds."""
    folded = stratified_folds(df, label, row_id, k).persist()
    try:
        scores = _concurrently(df.sparkSession, lambda fold: _fold_score(folded, fold, fit),
                               list(range(k)), PARALLELISM)
    finally:
        folded.unpersist()
    rows = list(enumerate(scores))
    return df.sparkSession.createDataFrame(rows, "fold int, score double")


def cross_validate(df: DataFrame, name: str, row_id: str = "id", k: int = params.FOLDS,
                   **options) -> DataFrame:
    scores = fold_scores(df, lambda train: FITTERS[name](train, **options), row_id, k=k)
    return cv_summary(scores.withColumn("model", F.lit(name)), ["model"])


METRIC_COLUMNS = ["accuracy", "precision_macro", "recall_macro", "f1_macro", "f1_weighted"]
BENCHMARK_SCHEMA = ("model string, " + ", ".join(f"{c} double" for c in METRIC_COLUMNS)
                    + ", train_time_s double, error string")


def benchmark(spark: SparkSession, train: DataFrame, test: DataFrame,
              options: Mapping[str, Mapping] | None = None,
              save: Callable[[str, PipelineModel], None] | None = None,
              grids: Mapping[str, Mapping[str, list]] | None = None) -> DataFrame:
    """Fit each named model, measure it on the test rows and rank by macro-F1.

    A model with an entry in `grids` is tuned on the training rows first, its other arguments
    fixed.
    A model that fails becomes a row with its error. `train` and `test` are persisted because
    every model reads them again.
    """
    options = options if options is not None else {name: {} for name in FITTERS}
    train, test = train.persist(), test.persist()
    rows = []
    try:
        for name, chosen in options.items():
            started = time.monotonic()
            try:
                if name in (grids or {}):
                    model, _ = grid_search(train, name, grids[name], fixed=chosen)
                else:
                    model = FITTERS[name](train, **chosen)
                result = metrics_summary(predict_probabilities(model, test)).first()
                if save:
                    save(name, model)
                rows.append((name, *[float(result[c]) for c in METRIC_COLUMNS],
                             round(time.monotonic() - started, 2), None))
            except Exception as failure:  # one broken model must not end the comparison
                rows.append((name, *[None] * len(METRIC_COLUMNS), None, str(failure)))
    finally:
        train.unpersist()
        test.unpersist()
    return rank_models(spark.createDataFrame(rows, BENCHMARK_SCHEMA))


def feature_importance(spark: SparkSession, model: PipelineModel, names: list[str],
                       top: int = params.TOP_IMPORTANCE) -> DataFrame:
    """Impurity or gain importance per feature; empty for models without one."""
    found = [s.featureImportances for s in model.stages if hasattr(s, "featureImportances")]
    each = [v.toArray() if hasattr(v, "toArray") else v for v in found]
    if any(len(values) != len(names) for values in each):
        raise ValueError(f"{len(names)} names for {len(each[0])} features")
    rows = list(zip(names, (sum(each) / len(each)).tolist())) if each else []
    table = spark.createDataFrame(rows, "feature string, importance double")
    return topk_features(table, "importance", top)


def topk_features(table: DataFrame, metric: str, top: int) -> DataFrame:
    return table.orderBy(F.col(metric).desc(), "feature").limit(top)


def feature_rows(df: DataFrame, row_id: str, vector: Column) -> DataFrame:
    """Long form (row_id, feature index, x)."""
    return df.select(row_id, F.posexplode(vector).alias("feature", "x"))


def linear_attribution(rows: DataFrame, weights: DataFrame, row_id: str) -> DataFrame:
    """w_cj (x_j - mean x_j) per row, class and feature.

    `weights(class, feature, w)` and the means hold one row per model coefficient; the planner
    broadcasts them by their size.
    """
    means = rows.groupBy("feature").agg(F.avg("x").alias("mean_x"))
    coefficients = weights.join(means, "feature")
    return rows.join(coefficients, "feature").select(
        row_id, "class", "feature",
        (F.col("w") * (F.col("x") - F.col("mean_x"))).alias("attribution"))


def mean_abs_attribution(attribution: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature: over rows, then over classes."""
    per_class = attribution.groupBy("class", "feature").agg(
        F.avg(F.abs("attribution")).alias("value"))
    return per_class.groupBy("feature").agg(F.avg("value").alias("importance"))


def model_weights(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """Coefficients of a fitted multinomial logistic stage as weights(class, feature, w)."""
    stage = next(s for s in model.stages if hasattr(s, "coefficientMatrix"))
    matrix = stage.coefficientMatrix.toArray()
    rows = [(c, j, float(w)) for c, row in enumerate(matrix) for j, w in enumerate(row)]
    return spark.createDataFrame(rows, "class int, feature int, w double")


def permutation_importance(df: DataFrame, model: PipelineModel, features: str = "features",
                           row_id: str = "id", seed: int = params.SEED,
                           digits: int = 1) -> DataFrame:
    """Drop in accuracy and macro-F1 when one feature is exchanged between rows.

    Each row takes its feature from the next row of its hash bucket (the last from the
    first), which permutes every column inside buckets. There are 16^digits buckets whatever
    the size of the table; choose more digits for larger tables, up to a bucket per task. All
    features are scored in one plan.
    """
    keyed = df.select(row_id, "label", vector_to_array(features).alias("_x"),
                      hash_key(row_id, seed=seed).alias("_key"))
    keyed = keyed.withColumn("_bucket", hash_bucket("_key", digits))
    ring = Window.partitionBy("_bucket").orderBy("_key", row_id)
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    donors = keyed.withColumn("_donor", F.coalesce(
        F.lead("_x").over(ring), F.first("_x").over(whole)))
    exchanged = donors.select(row_id, "label", "_x", F.posexplode("_donor").alias("feature", "_v"))
    swapped = F.transform("_x", lambda x, i: F.when(i == F.col("feature"), F.col("_v")).otherwise(x))
    perturbed = exchanged.select(row_id, "label", "feature",
                                 array_to_vector(swapped).alias(features))
    after = metrics_summary(predict_probabilities(model, perturbed), ["feature"])
    before = metrics_summary(predict_probabilities(model, df.select(row_id, "label", features)))
    base = before.select(F.struct("accuracy", "f1_macro").alias("base")).scalar()
    return after.withColumn("_base", base).select(
        "feature", (F.col("_base.accuracy") - F.col("accuracy")).alias("accuracy_drop"),
        (F.col("_base.f1_macro") - F.col("f1_macro")).alias("f1_drop"))


