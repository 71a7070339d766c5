"""Batch scoring: one set-based plan from headlines to prediction records."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens import params, schemas
from marketlens.functions.labels import confidence, label_name, round4
from marketlens.functions.text import finance_keywords
from marketlens.operators.ensemble import PROBABILITIES, decide
from marketlens.operators.estimators import predict_probabilities, with_probabilities


def score_batch(df: DataFrame, model: PipelineModel, model_name: str, row_id: str = "id",
                text: str = "title", clean: str = "clean_text") -> DataFrame:
    """Prediction record per headline.

    `model` makes the sentiment columns on its way from the raw headline (see
    `headline_model.fit`), or `df` has them with the feature vector.
    """
    scored = with_probabilities(model.transform(df))
    sentiment = F.struct(
        round4("sentiment_polarity").alias("polarity"),
        round4("sentiment_subjectivity").alias("subjectivity"),
        round4("valence_compound").alias("compound"),
        round4("valence_positive").alias("positive"),
        round4("valence_negative").alias("negative"))
    return scored.select(
        row_id, F.col(text).alias("headline"), F.col(clean).alias("clean_text"),
        label_name("prediction").alias("prediction"),
        F.col("prediction").alias("prediction_id"),
        confidence(*PROBABILITIES).alias("confidence"),
        F.struct(round4("p_down").alias("down"), round4("p_neutral").alias("neutral"),
                 round4("p_up").alias("up")).alias("probabilities"),
        sentiment.alias("sentiment"),
        finance_keywords(text).alias("financial_keywords"),
        F.array().cast(schemas.ENTITIES).alias("entities"),
        F.lit(model_name).alias("model_used"))


def score_ensemble(df: DataFrame, models: Mapping[str, PipelineModel]) -> DataFrame:
    """Score with several models and vote inside the row: features are computed once and
    nothing is shuffled. Feed the result to `ensemble.safety_rules`."""
    if not models:
        raise ValueError("no trained models")
    scored, packs = df, []
    for name, model in models.items():
        scored = predict_probabilities(model, scored)
        pack = f"_m{len(packs)}"
        scored = scored.withColumn(pack, F.struct(
            F.lit(name).alias("model"), *[round4(p).alias(p) for p in PROBABILITIES],
            F.col("prediction"))).drop(*PROBABILITIES, "prediction")
        packs.append(pack)
    n = len(packs)
    means = {p: F.round(sum((F.col(f"{k}.{p}") for k in packs[1:]),
                            F.col(f"{packs[0]}.{p}")) / n, 10) for p in PROBABILITIES}
    votes = {}
    for c, label in params.LABEL_NAMES.items():
        cast = [(F.col(f"{k}.prediction") == c).cast("long") for k in packs]
        votes[f"votes_{label.lower()}"] = sum(cast[1:], cast[0])
    each = F.map_from_arrays(F.array(*[F.col(f"{k}.model") for k in packs]),
                             F.array(*[label_name(F.col(f"{k}.prediction")) for k in packs]))
    grouped = scored.withColumns({
        **means, **votes, "n_models": F.lit(n).cast("long"), "individual_predictions": each})
    return decide(grouped).drop(*packs)
