"""Classification metrics as aggregations over scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens import params
from marketlens.operators.running import running_sums, with_offsets

LABEL, PREDICTION = "label", "prediction"


def _per(keys: list[str]):
    """Window over a table that is already aggregated to a few rows per key."""
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def label_distribution(df: DataFrame, label: str = "label_name") -> DataFrame:
    return (df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), label))


def class_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Balanced weights n / (k * n_c); the window runs on one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = _per([])
    weight = F.sum("n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n"))
    return counts.select(label, "n", weight.alias("weight"))


def confusion_counts(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(keys or []), LABEL, PREDICTION).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per actual class, one column per predicted class."""
    wide = (df.groupBy(*(keys or []), LABEL).pivot(PREDICTION, list(params.CLASSES))
            .agg(F.count(F.lit(1))))
    return wide.na.fill(0).select(
        *(keys or []), LABEL,
        *[F.col(str(c)).alias(f"pred_{params.LABEL_NAMES[c].lower()}") for c in params.CLASSES])


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def class_rows(confusion: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """precision, recall, F1 and support per class; an empty denominator gives 0."""
    keys = keys or []
    hit = F.when(F.col(LABEL) == F.col(PREDICTION), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    roles = F.array(
        F.struct(F.col(LABEL).cast("int").alias("class"), hit.alias("tp"),
                 F.col("n").alias("support"), zero.alias("predicted")),
        F.struct(F.col(PREDICTION).cast("int").alias("class"), zero.alias("tp"),
                 zero.alias("support"), F.col("n").alias("predicted")))
    sums = (confusion.select(*keys, F.inline(roles)).groupBy(*keys, "class")
            .agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")]))
    return sums.select(
        *keys, "class",
        _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"),
        "support", "tp")


def per_class_report(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Class rows plus `macro avg` and `weighted avg` rows."""
    keys = keys or []
    rows = class_rows(confusion_counts(df, keys), keys)
    scores = ["precision", "recall", "f1"]
    named = rows.select(*keys, F.element_at(
        F.create_map(*[F.lit(x) for kv in params.LABEL_NAMES.items() for x in kv]),
        F.col("class")).alias("row"), *scores, "support")
    total = F.sum("support")
    macro = rows.groupBy(*keys).agg(
        F.lit("macro avg").alias("row"), *[F.avg(s).alias(s) for s in scores],
        total.alias("support"))
    weighted = rows.groupBy(*keys).agg(
        F.lit("weighted avg").alias("row"),
        *[_ratio(F.sum(F.col(s) * F.col("support")), total).alias(s) for s in scores],
        total.alias("support"))
    order = [*keys, "row", *scores, "support"]
    return named.select(*order).union(macro.select(*order)).union(weighted.select(*order))


def metrics_summary(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """accuracy, macro precision / recall / F1 and weighted F1, one row per key."""
    keys = keys or []
    rows = class_rows(confusion_counts(df, keys), keys)
    return rows.groupBy(*keys).agg(
        _ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
        _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_weighted"))


def model_comparison(df: DataFrame, model: str = "model") -> DataFrame:
    return rank_models(metrics_summary(df, [model]))


def rank_models(summary: DataFrame, metric: str = "f1_macro", model: str = "model") -> DataFrame:
    """Best first; models without the metric (failed ones) last."""
    return summary.orderBy(F.col(metric).desc_nulls_last(), model)


def score_counts(df: DataFrame, keys: list[str], probabilities: dict[int, str]) -> DataFrame:
    """Positives and negatives per (keys, class, distinct score), aggregated map-side."""
    rows = F.array(*[
        F.struct(F.lit(c).alias("class"), F.col(p).cast("double").alias("score"),
                 (F.col(LABEL) == c).cast("long").alias("pos"))
        for c, p in probabilities.items()])
    return (df.select(*keys, F.inline(rows)).groupBy(*keys, "class", "score")
            .agg(F.sum("pos").alias("pos"), F.sum(1 - F.col("pos")).alias("neg")))


def _bucketed(counts: DataFrame, groups: list[str], buckets: int) -> DataFrame:
    """Append `_bucket`, ascending with the score: cut points are quantiles of each group's
    own distinct scores, so that no bucket has much more than its share, however they lie."""
    shares = [i / buckets for i in range(1, buckets)]
    cuts = counts.groupBy(*groups).agg(
        F.array_distinct(F.percentile_approx("score", shares, 50 * buckets)).alias("_cuts"))
    joined = with_offsets(counts, cuts, groups, ["_cuts"])
    return joined.withColumn("_bucket", F.size(F.filter(
        "_cuts", lambda c: c < F.col("score")))).drop("_cuts")


def roc_curve(df: DataFrame, keys: list[str], probabilities: dict[int, str],
              buckets: int = 64) -> DataFrame:
    """One-vs-rest ROC points per distinct score, highest score first. A group's scores are
    added up in `buckets` tasks."""
    groups = [*keys, "class"]
    counts = score_counts(df, keys, probabilities)
    placed = _bucketed(counts, groups, buckets).withColumn("_bucket", -F.col("_bucket"))
    points = running_sums(placed, groups, "_bucket", [F.col("score").desc()],
                          {"tp": "pos", "fp": "neg"})
    totals = counts.groupBy(*groups).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    joined = points.join(totals, groups)
    return joined.select(
        *groups, F.col("score").alias("threshold"), "tp", "fp",
        F.try_divide(F.col("fp"), F.col("_n")).alias("fpr"),
        F.try_divide(F.col("tp"), F.col("_p")).alias("tpr"))


def roc_auc_ovr(df: DataFrame, keys: list[str], probabilities: dict[int, str],
                buckets: int = 64) -> DataFrame:
    """AUC per class (rank-sum form with half credit for ties), null if a class is absent."""
    groups = [*keys, "class"]
    placed = _bucketed(score_counts(df, keys, probabilities), groups, buckets)
    ranked = running_sums(placed, groups, "_bucket", ["score"], {"_upto": "neg"})
    # Twice the rank sum stays an exact integer.
    twice = F.sum(F.col("pos") * (2 * (F.col("_upto") - F.col("neg")) + F.col("neg")))
    return ranked.groupBy(*groups).agg(
        F.try_divide(twice.cast("double"), 2.0 * F.sum("pos") * F.sum("neg")).alias("auc"))


def macro_auc(per_class: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over classes; null when any class has no AUC."""
    complete = F.count("auc") == F.count(F.lit(1))
    return per_class.groupBy(*keys).agg(F.when(complete, F.avg("auc")).alias("roc_auc_macro"))


def cv_summary(scores: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Mean and population standard deviation of fold scores."""
    return scores.groupBy(*keys).agg(F.avg(score).alias("cv_mean"),
                                     F.stddev_pop(score).alias("cv_std"))


def evaluate(df: DataFrame, keys: list[str], probabilities: dict[int, str]) -> DataFrame:
    """Long metric table (keys, metric, value): summary, per-class report, AUC, confusion."""
    summary = metrics_summary(df, keys)
    names = [c for c in summary.columns if c not in keys]

    def long(frame: DataFrame, pairs: list[tuple[Column, Column]]) -> DataFrame:
        return frame.select(*keys, F.inline(F.array(*[
            F.struct(n.alias("metric"), v.cast("double").alias("value")) for n, v in pairs])))

    per_class = roc_auc_ovr(df, keys, probabilities)
    report = per_class_report(df, keys)
    parts = [
        long(summary, [(F.lit(n), F.col(n)) for n in names]),
        long(report, [(F.concat(F.col("row"), F.lit(f".{s}")), F.col(s))
                      for s in ("precision", "recall", "f1", "support")]),
        long(per_class, [(F.format_string("auc.%d", F.col("class")), F.col("auc"))]),
        long(macro_auc(per_class, keys), [(F.lit("roc_auc_macro"), F.col("roc_auc_macro"))]),
        long(confusion_counts(df, keys), [(F.format_string(
            "confusion.%d.%d", F.col(LABEL), F.col(PREDICTION)), F.col("n"))]),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
