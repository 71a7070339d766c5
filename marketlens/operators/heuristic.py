"""Model-free scorer and the fallback for headlines without model scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens import params
from marketlens.functions.labels import label_name, round4
from marketlens.functions.bind import bind
from marketlens.functions.lexicon import lower_words, word_hits, word_polarity
from marketlens.operators.lexicon_scan import scan
from marketlens.lexicons import DEFAULT_LEXICON, STRONG_BEARISH, STRONG_BULLISH, Lexicon

# Weights of the heuristic.
TOKEN_WEIGHT, POLARITY_WEIGHT, NEUTRAL_WEIGHT = 0.3, 0.4, 0.2
STRONG_BONUS, LEAD = 0.5, 0.1
BASE_CONFIDENCE, CONFIDENCE_SLOPE, MAX_CONFIDENCE = 0.65, 0.1, 0.95
OPPOSITE, SHARED = 0.10, 0.90
UNDECIDED = (0.25, 0.50, 0.25)


def _direction(count: Column, strength: Column, strong: Column) -> Column:
    return (count * TOKEN_WEIGHT + F.greatest(F.lit(0.0), strength) * POLARITY_WEIGHT
            + F.when(strong > 0, F.lit(STRONG_BONUS)).otherwise(F.lit(0.0)))


def heuristic_score(df: DataFrame, text: str = "title",
                    lexicon: Lexicon | DataFrame = DEFAULT_LEXICON) -> DataFrame:
    """Class, confidence and probabilities from exact token hits and polarity.

    The neutral share is clamped at 0 before normalising. Row-local: the same plan serves
    batch and streaming. A lexicon table of any size is scanned in blocks.
    """
    if isinstance(lexicon, Lexicon):
        hits = {"n_bull": word_hits("_words", lexicon.terms("bullish")),
                "n_bear": word_hits("_words", lexicon.terms("bearish")),
                "n_neut": word_hits("_words", lexicon.terms("neutral")),
                "polarity": word_polarity("_words", lexicon)}
    else:
        found = scan(df.select(F.struct(*df.columns).alias("_row"), F.col(text).alias("_own")),
                     "_own", lexicon)
        df = found.select("_row.*", F.struct(
            "bullish_tokens", "bearish_tokens", "neutral_tokens", "polarity").alias("_hits"))
        hits = {"n_bull": F.col("_hits.bullish_tokens"), "n_bear": F.col("_hits.bearish_tokens"),
                "n_neut": F.col("_hits.neutral_tokens"), "polarity": F.col("_hits.polarity")}
    # The text is cut into words once for all counts.
    base = bind(bind(df, {"_words": lower_words(text)}), {
        **hits, "_strong_up": word_hits("_words", STRONG_BULLISH),
        "_strong_down": word_hits("_words", STRONG_BEARISH)})
    scored = base.withColumns({
        "_up": _direction(F.col("n_bull"), F.col("polarity"), F.col("_strong_up")),
        "_down": _direction(F.col("n_bear"), -F.col("polarity"), F.col("_strong_down")),
        "_flat": F.col("n_neut") * NEUTRAL_WEIGHT})
    up, down, flat = F.col("_up"), F.col("_down"), F.col("_flat")
    chosen = scored.withColumn(
        "prediction_id",
        F.when((up > down + LEAD) & (up > flat), F.lit(params.UP))
        .when((down > up + LEAD) & (down > flat), F.lit(params.DOWN))
        .otherwise(F.lit(params.NEUTRAL)))
    picked = F.col("prediction_id")
    lead = F.when(picked == params.UP, up).otherwise(down)
    sure = F.least(BASE_CONFIDENCE + lead * CONFIDENCE_SLOPE, F.lit(MAX_CONFIDENCE))
    chosen = chosen.withColumns({
        "_sure": F.round(sure, 2),
        "_rest": F.greatest(F.round(SHARED - sure, 2), F.lit(0.0))})
    undecided = picked == params.NEUTRAL

    def share(direction: int, fallback: float) -> Column:
        return (F.when(undecided, F.lit(fallback)).when(picked == direction, F.col("_sure"))
                .otherwise(F.lit(OPPOSITE)))

    weights = chosen.withColumns({
        "_d": share(params.DOWN, UNDECIDED[0]), "_u": share(params.UP, UNDECIDED[2]),
        "_n": F.when(undecided, F.lit(UNDECIDED[1])).otherwise(F.col("_rest"))})
    total = F.col("_d") + F.col("_n") + F.col("_u")
    final = weights.withColumns({
        "p_down": round4(F.col("_d") / total), "p_neutral": round4(F.col("_n") / total),
        "p_up": round4(F.col("_u") / total), "prediction": label_name(picked),
        "model_used": F.lit("heuristic_fallback")})
    return (final.withColumn("confidence", F.greatest("p_down", "p_neutral", "p_up"))
            .drop("_words", "_hits", "_strong_up", "_strong_down", "_up", "_down", "_flat", "_sure", "_rest",
                  "_d", "_n", "_u"))


def score_with_fallback(headlines: DataFrame, scores: DataFrame, text: str = "title",
                        lexicon: Lexicon | DataFrame = DEFAULT_LEXICON) -> DataFrame:
    """Model scores where a headline has them, the heuristic elsewhere.

    `scores`: (id, model_used, prediction, p_down, p_neutral, p_up), unique by id.
    """
    names = ["prediction", "p_down", "p_neutral", "p_up", "model_used"]
    model = scores.select("id", *[F.col(n).alias(f"_m_{n}") for n in names])
    joined = heuristic_score(headlines, text, lexicon).join(model, "id", "left")
    missing = F.col("_m_prediction").isNull()
    merged = joined.withColumns({
        n: F.when(missing, F.col(n)).otherwise(F.col(f"_m_{n}")) for n in names})
    return (merged.withColumn("confidence", F.greatest("p_down", "p_neutral", "p_up"))
            .drop(*[f"_m_{n}" for n in names]))
