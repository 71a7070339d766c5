"""Voting ensemble over per-model class probabilities, with safety rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens import params
from marketlens.functions.labels import argmax_class, confidence, label_name, percent, round4

PROBABILITIES = ["p_down", "p_neutral", "p_up"]


def ensemble_align(*model_scores: DataFrame) -> DataFrame:
    """Stack score tables (id, model, p_down, p_neutral, p_up); failed rows (nulls) drop out."""
    stacked = model_scores[0].select("id", "model", *PROBABILITIES)
    for scores in model_scores[1:]:
        stacked = stacked.unionByName(scores.select("id", "model", *PROBABILITIES))
    return stacked.na.drop(subset=PROBABILITIES)


def with_model_class(scores: DataFrame) -> DataFrame:
    rounded = scores.withColumns({p: round4(p) for p in PROBABILITIES})
    return rounded.withColumn("prediction", argmax_class(*PROBABILITIES))


def _vote(c: int) -> Column:
    return F.count(F.when(F.col("prediction") == c, 1))


def _mean(p: str) -> Column:
    """Mean of four-digit values; rounding removes the summation order, so a re-run of a
    lost task cannot move a value across a rule threshold."""
    return F.round(F.avg(p), 10)


def votes(scores: DataFrame) -> DataFrame:
    """Number of models per predicted class, one row per id."""
    return with_model_class(scores).groupBy("id").agg(
        *[_vote(c).alias(f"votes_{n.lower()}") for c, n in params.LABEL_NAMES.items()])


def mean_probabilities(scores: DataFrame) -> DataFrame:
    return with_model_class(scores).groupBy("id").agg(
        *[_mean(p).alias(p) for p in PROBABILITIES])


def ensemble_vote(scores: DataFrame) -> DataFrame:
    """Mean probabilities, votes, winning class and unrounded agreement per id.

    One aggregation; the collected map holds one entry per model.
    """
    grouped = with_model_class(scores).groupBy("id").agg(
        *[_mean(p).alias(p) for p in PROBABILITIES],
        *[_vote(c).alias(f"votes_{n.lower()}") for c, n in params.LABEL_NAMES.items()],
        F.count(F.lit(1)).alias("n_models"),
        F.map_from_entries(F.array_sort(F.collect_list(
            F.struct("model", label_name("prediction").alias("name")))))
        .alias("individual_predictions"))
    return decide(grouped)


def decide(grouped: DataFrame) -> DataFrame:
    winner = argmax_class(*PROBABILITIES)
    won = (F.when(winner == params.DOWN, F.col("votes_down"))
           .when(winner == params.NEUTRAL, F.col("votes_neutral"))
           .otherwise(F.col("votes_up")))
    return grouped.withColumns({
        "raw_prediction": label_name(winner),
        "confidence": confidence(*PROBABILITIES),
        "agreement_ratio": won / F.col("n_models")})


def safety_rules(voted: DataFrame, safe_mode: bool = True,
                 min_confidence: float = params.MIN_CONFIDENCE,
                 min_agreement: float = params.MIN_AGREEMENT,
                 min_gap: float = params.MIN_OPPOSITE_GAP) -> DataFrame:
    """Final class, rule flag and reason, recommendation; first matching rule wins.

    Rules see unrounded confidence, agreement and probabilities.
    """
    conf, agree = F.col("confidence"), F.col("agreement_ratio")
    directional = F.col("raw_prediction").isin("UP", "DOWN")
    gap = F.abs(F.col("p_up") - F.col("p_down"))
    reason = F.lit(None).cast("string")
    if safe_mode:
        reason = (
            F.when(conf < min_confidence,
                   F.concat(F.lit("Confidence too low ("), percent(conf, 1),
                            F.lit(f" < {min_confidence:.0%})")))
            .when(agree < min_agreement,
                  F.concat(F.lit("Models disagree ("), percent(agree, 0),
                           F.lit(f" < {min_agreement:.0%} agreement)")))
            .when(directional & (gap < min_gap),
                  F.lit("UP/DOWN too close - uncertain market direction")))
    actions = params.SAFE_ACTIONS if safe_mode else params.ACTIONS
    table = F.create_map(*[F.lit(x) for kv in actions.items() for x in kv])
    ruled = voted.withColumn("safety_reason", reason)
    ruled = ruled.withColumns({
        "safety_applied": F.col("safety_reason").isNotNull(),
        "prediction": F.when(F.col("safety_reason").isNotNull(), F.lit("NEUTRAL"))
        .otherwise(F.col("raw_prediction"))})
    return ruled.withColumns({
        "action": F.element_at(table, F.col("prediction")),
        "agreement": F.round("agreement_ratio", 2)})


def vote_items(voted: DataFrame) -> DataFrame:
    """Votes as a map with only the classes voted for, and lookups with default 0."""
    entries = F.array(*[F.struct(F.lit(n).alias("key"), F.col(f"votes_{n.lower()}").alias("value"))
                        for n in params.LABEL_NAMES.values()])
    cast = F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0))
    with_map = voted.withColumn("model_votes", cast)
    return with_map.withColumns({
        f"n_{n.lower()}": F.coalesce(F.try_element_at("model_votes", F.lit(n)), F.lit(0))
        for n in params.LABEL_NAMES.values()})
