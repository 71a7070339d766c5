"""Registered queries on scores, metrics, splits, scaling, models and ensembles."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from marketlens import params
from marketlens.functions import calendar as cal
from marketlens.functions import labels as lab
from marketlens.functions.vectors import sparse_parts
from marketlens.lexicons import DEFAULT_LEXICON, STRONG_BEARISH, STRONG_BULLISH
from marketlens.operators import (
    align, ensemble, estimators, headline_model, heuristic, indicators, metrics, scoring, splits,
    standardise as scaling, tuning, vocabulary)
from marketlens.plans import sql as s
from marketlens.plans.dataset import preprocess
from marketlens.plans.tables import (
    headlines, outcomes, printable, rounded, samples, scored, scores, spread,
    spread_headlines, table, ticks_bars)
from marketlens.plans.text_queries import (
    DEFAULT_ROWS, KEYWORDS, VOCAB, _polarity_sql)
from marketlens.sources import sinks
from marketlens.sources.workspace import new_path

QUERIES, SQL = {}, {}


def query(key: str, twin: str | None = None):
    def register(fn):
        QUERIES[key] = fn
        if twin is not None:
            SQL[key] = twin
        return fn
    return register


P = ["p_down", "p_neutral", "p_up"]
PROBABILITIES = dict(zip(params.CLASSES, P))

# --- metrics on score tables -----------------------------------------------------------------


def class_views(source: str, keys: str) -> dict[str, str]:
    return {
        "cm": f"SELECT {keys}, label, prediction, count(*) AS n FROM {source} GROUP BY ALL",
        "sums": f"""SELECT {keys}, c AS class,
                      coalesce(sum(n) FILTER (label = c AND prediction = c), 0) AS tp,
                      coalesce(sum(n) FILTER (label = c), 0) AS support,
                      coalesce(sum(n) FILTER (prediction = c), 0) AS predicted
                    FROM cm, (VALUES (0), (1), (2)) AS t(c) GROUP BY {keys}, c""",
        "cls": f"""SELECT {keys}, class, CAST(support AS BIGINT) AS support, tp,
                     coalesce(tp / nullif(predicted, 0), 0) AS precision,
                     coalesce(tp / nullif(support, 0), 0) AS recall,
                     coalesce(2 * tp / nullif(predicted + support, 0), 0) AS f1
                   FROM sums WHERE support + predicted > 0""",
        "summary": f"""SELECT {keys}, sum(tp) / sum(support) AS accuracy,
                         avg(precision) AS precision_macro, avg(recall) AS recall_macro,
                         avg(f1) AS f1_macro, sum(f1 * support) / sum(support) AS f1_weighted
                       FROM cls GROUP BY {keys}"""}


NAME = s.LABEL_NAME.format("class")
SUMMARY = ", ".join(f"round({c}, 6) AS {c}" for c in tuning.METRIC_COLUMNS)
REPORT = ", ".join(f"round({c}, 6) AS {c}" for c in ("precision", "recall", "f1"))
REPORT_ROWS = f"""
    SELECT model, {NAME} AS row, precision, recall, f1, support FROM cls
    UNION ALL SELECT model, 'macro avg', avg(precision), avg(recall), avg(f1),
                     CAST(sum(support) AS BIGINT) FROM cls GROUP BY model
    UNION ALL SELECT model, 'weighted avg', sum(precision * support) / sum(support),
                     sum(recall * support) / sum(support), sum(f1 * support) / sum(support),
                     CAST(sum(support) AS BIGINT) FROM cls GROUP BY model"""


@query("confusion_matrix", s.twin(
    "SELECT model, label, " + ", ".join(
        f"count(*) FILTER (prediction = {c}) AS pred_{n.lower()}"
        for c, n in params.LABEL_NAMES.items()) + " FROM scored GROUP BY model, label", "scored"))
def confusion_matrix(spark, sf):
    return printable(metrics.confusion_matrix(scored(spark, sf), ["model"]))


@query("per_class_report", s.twin(f"SELECT model, row, {REPORT}, support FROM r", "scored",
                                  **class_views("scored", "model"), r=REPORT_ROWS))
def per_class_report(spark, sf):
    return rounded(metrics.per_class_report(scored(spark, sf), ["model"]),
                   "precision", "recall", "f1")


@query("metrics_summary", s.twin(f"SELECT model, {SUMMARY} FROM summary", "scored",
                                 **class_views("scored", "model")))
def metrics_summary(spark, sf):
    return rounded(metrics.metrics_summary(scored(spark, sf), ["model"]),
                   *tuning.METRIC_COLUMNS)


@query("model_comparison", s.twin(
    f"SELECT model, {SUMMARY} FROM summary ORDER BY f1_macro DESC, model", "scored",
    **class_views("scored", "model")))
def model_comparison(spark, sf):
    return rounded(metrics.model_comparison(scored(spark, sf)), *tuning.METRIC_COLUMNS)


@query("rank_models", s.twin(
    """SELECT model, round(f1_macro, 6) AS f1_macro,
              row_number() OVER (ORDER BY round(f1_macro, 6) DESC NULLS LAST, model) AS place
       FROM (SELECT model, f1_macro FROM summary UNION ALL SELECT 'failed', NULL)""", "scored",
    **class_views("scored", "model")))
def rank_models(spark, sf):
    summary = rounded(metrics.metrics_summary(scored(spark, sf), ["model"])
                      .select("model", "f1_macro"), "f1_macro")
    failed = spark.createDataFrame([("failed", None)], "model string, f1_macro double")
    ranked = metrics.rank_models(summary.unionByName(failed))
    place = F.row_number().over(metrics._per([]).orderBy(
        F.col("f1_macro").desc_nulls_last(), "model"))  # one row per model
    return printable(ranked.withColumn("place", place))


LONG = ("SELECT model, class, score, sum(pos) AS pos, sum(1 - pos) AS neg FROM ("
        + " UNION ALL ".join(
            f"SELECT model, {c} AS class, {p} AS score, CASE WHEN label = {c} THEN 1 ELSE 0 END "
            f"AS pos FROM scored" for c, p in PROBABILITIES.items())
        + ") GROUP BY model, class, score")
AUC = """SELECT model, class, CAST(sum(pos * (below + neg / 2.0)) AS DOUBLE)
                / (sum(pos) * sum(neg)) AS auc
         FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model, class ORDER BY score
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM long)
         GROUP BY model, class"""


@query("roc_curve", s.twin(
    """SELECT model, CAST(class AS BIGINT) AS class, score AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
              fp / sum(neg) OVER (PARTITION BY model, class) AS fpr,
              tp / sum(pos) OVER (PARTITION BY model, class) AS tpr
       FROM (SELECT *, sum(pos) OVER (PARTITION BY model, class ORDER BY score DESC) AS tp,
                    sum(neg) OVER (PARTITION BY model, class ORDER BY score DESC) AS fp FROM long)""",
    "scored", long=LONG))
def roc_curve(spark, sf):
    return printable(metrics.roc_curve(scored(spark, sf), ["model"], PROBABILITIES))


@query("roc_auc_ovr", s.twin(
    """SELECT model, CAST(class AS VARCHAR) AS class, round(auc, 9) AS auc FROM auc
       UNION ALL SELECT model, 'macro', round(avg(auc), 9) FROM auc GROUP BY model""",
    "scored", long=LONG, auc=AUC))
def roc_auc_ovr(spark, sf):
    each = metrics.roc_auc_ovr(scored(spark, sf), ["model"], PROBABILITIES)
    macro = metrics.macro_auc(each, ["model"])
    out = each.select("model", F.col("class").cast("string").alias("class"), "auc").union(
        macro.select("model", F.lit("macro"), "roc_auc_macro"))
    return rounded(out, "auc", digits=9)


@query("evaluate", s.twin(
    "SELECT model, metric, round(value, 6) AS value FROM ("
    + " UNION ALL ".join(
        [f"SELECT model, '{c}' AS metric, {c} AS value FROM summary"
         for c in tuning.METRIC_COLUMNS]
        + [f"SELECT model, row || '.{c}', CAST({c} AS DOUBLE) FROM r"
           for c in ("precision", "recall", "f1", "support")]
        + ["SELECT model, 'auc.' || class, auc FROM auc",
           "SELECT model, 'roc_auc_macro', avg(auc) FROM auc GROUP BY model",
           "SELECT model, 'confusion.' || label || '.' || prediction, CAST(n AS DOUBLE) FROM cm"])
    + ")", "scored", **class_views("scored", "model"), r=REPORT_ROWS, long=LONG, auc=AUC))
def evaluate(spark, sf):
    return rounded(metrics.evaluate(scored(spark, sf), ["model"], PROBABILITIES), "value")


# --- splits ----------------------------------------------------------------------------------

FOLDED = ("SELECT id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY "
          "md5('42|' || id), id) - 1) % 5 AS BIGINT) AS fold FROM outcomes")
SPLIT = """SELECT e.*, row_number() OVER (PARTITION BY event_type
                         ORDER BY md5('42|' || event_id), event_id) <= quota AS is_test
           FROM events e JOIN (
             SELECT event_type, base + CASE WHEN turn <= target - sum(base) OVER () THEN 1
                                            ELSE 0 END AS quota
             FROM (SELECT *, row_number() OVER (ORDER BY rest DESC, event_type) AS turn
                   FROM (SELECT event_type, floor(count(*) * 0.2) AS base,
                                count(*) * 0.2 - floor(count(*) * 0.2) AS rest,
                                (SELECT ceil(count(*) * 0.2) FROM events) AS target
                         FROM events GROUP BY event_type))) q USING (event_type)"""


def _outcomes(spark, sf):
    return outcomes(spark, sf)


@query("stratified_split", s.twin("SELECT event_id, event_type, is_test FROM sp", sp=SPLIT))
def stratified_split(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type")
    return splits.stratified_split(events, "event_type", "event_id")


@query("stratified_folds", s.twin("SELECT id, label, fold FROM f", "outcomes", f=FOLDED))
def stratified_folds(spark, sf):
    return printable(splits.stratified_folds(_outcomes(spark, sf), "label", "id"))


@query("sample_first_n", s.twin(
    "SELECT id, title FROM headlines ORDER BY md5('42|' || id), id LIMIT 500", "headlines"))
def sample_first_n(spark, sf):
    return splits.sample_first_n(headlines(spark, sf).select("id", "title"), "id")


@query("cv_summary", s.twin(
    "SELECT model, round(avg(f1_macro), 6) AS cv_mean, round(stddev_pop(f1_macro), 6) AS cv_std "
    "FROM summary GROUP BY model", "scored", f=FOLDED,
    sf="SELECT scored.*, fold FROM scored JOIN f USING (id)", **class_views("sf", "model, fold")))
def cv_summary(spark, sf):
    folds = splits.stratified_folds(_outcomes(spark, sf), "label", "id").select("id", "fold")
    per_fold = metrics.metrics_summary(scored(spark, sf).join(folds, "id"), ["model", "fold"])
    return rounded(metrics.cv_summary(per_fold, ["model"], "f1_macro"), "cv_mean", "cv_std")


# --- ensemble --------------------------------------------------------------------------------

BY_ID = """SELECT id, round(avg(p_down), 10) AS p_down, round(avg(p_neutral), 10) AS p_neutral,
                  round(avg(p_up), 10) AS p_up,
                  count(*) FILTER (prediction = 0) AS votes_down,
                  count(*) FILTER (prediction = 1) AS votes_neutral,
                  count(*) FILTER (prediction = 2) AS votes_up, count(*) AS n_models,
                  string_agg(model || '=' || CASE prediction WHEN 0 THEN 'DOWN'
                    WHEN 1 THEN 'NEUTRAL' ELSE 'UP' END, ',' ORDER BY model) AS calls
           FROM scored GROUP BY id"""
VOTED = """SELECT *, CASE w WHEN 0 THEN 'DOWN' WHEN 1 THEN 'NEUTRAL' ELSE 'UP' END
                       AS raw_prediction, greatest(p_down, p_neutral, p_up) AS confidence,
                  CASE w WHEN 0 THEN votes_down WHEN 1 THEN votes_neutral ELSE votes_up END
                    / n_models AS agreement_ratio
           FROM (SELECT *, CASE WHEN p_down >= p_neutral AND p_down >= p_up THEN 0
                                WHEN p_neutral >= p_up THEN 1 ELSE 2 END AS w FROM by_id)"""


@query("ensemble_align", s.twin("SELECT id, model, p_down, p_neutral, p_up FROM scores", "scores"))
def ensemble_align(spark, sf):
    stacked = ensemble.ensemble_align(*[
        scores(spark, sf).where(F.col("model") == m) for m in ("m1", "m2", "m3", "m4")])
    return rounded(stacked, *P, digits=4)


@query("votes", s.twin("SELECT id, votes_down, votes_neutral, votes_up FROM by_id", "scored",
                       by_id=BY_ID))
def votes(spark, sf):
    return ensemble.votes(scores(spark, sf))


@query("mean_probabilities", s.twin("SELECT id, p_down, p_neutral, p_up FROM by_id", "scored",
                                    by_id=BY_ID))
def mean_probabilities(spark, sf):
    return ensemble.mean_probabilities(scores(spark, sf))


@query("round4", s.twin("SELECT id, model, p_down, p_neutral, p_up FROM scores", "scores"))
def round4(spark, sf):
    return scores(spark, sf).withColumns({p: lab.round4(p) for p in P})


@query("argmax_class", s.twin("SELECT id, model, CAST(prediction AS BIGINT) AS prediction FROM scored", "scored"))
def argmax_class(spark, sf):
    rows = scores(spark, sf).withColumns({p: lab.round4(p) for p in P})
    return printable(rows.select("id", "model", lab.argmax_class(*P).alias("prediction")))


@query("confidence", s.twin(
    "SELECT id, model, greatest(p_down, p_neutral, p_up) AS confidence FROM scored", "scored"))
def confidence(spark, sf):
    rows = scores(spark, sf).withColumns({p: lab.round4(p) for p in P})
    return rows.select("id", "model", lab.confidence(*P).alias("confidence"))


VOTE_COLUMNS = ["p_down", "p_neutral", "p_up", "votes_down", "votes_neutral", "votes_up",
                "n_models", "raw_prediction", "confidence", "agreement_ratio"]


@query("ensemble_vote", s.twin(f"SELECT id, calls, {', '.join(VOTE_COLUMNS)} FROM voted",
                               "scored", by_id=BY_ID, voted=VOTED))
def ensemble_vote(spark, sf):
    calls = F.transform(F.map_entries("individual_predictions"),
                        lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return ensemble.ensemble_vote(scores(spark, sf)).select(
        "id", F.array_join(calls, ",").alias("calls"), *VOTE_COLUMNS)


@query("map_items", s.twin(
    """SELECT id, votes_up AS n_up, votes_down AS n_down,
              CAST(CASE WHEN votes_up > 0 THEN 1 ELSE 0 END
                   + CASE WHEN votes_down > 0 THEN 1 ELSE 0 END
                   + CASE WHEN votes_neutral > 0 THEN 1 ELSE 0 END AS BIGINT) AS n_classes
       FROM by_id""", "scored", by_id=BY_ID))
def map_items(spark, sf):
    out = ensemble.vote_items(ensemble.ensemble_vote(scores(spark, sf)))
    return printable(out.select("id", "n_up", "n_down",
                                F.size("model_votes").alias("n_classes")))


def _actions(table: dict) -> str:
    return "CASE prediction " + " ".join(
        f"WHEN {s.quote(k)} THEN {s.quote(v)}" for k, v in table.items()) + " END"


def ruled_sql(min_confidence: float) -> str:
    return f"""SELECT *, CASE WHEN confidence < {s.double(min_confidence)}
        THEN 'Confidence too low (' || printf('%.1f', {s.decimal_round('confidence * 100', 1)})
             || '% < {min_confidence:.0%})'
      WHEN agreement_ratio < 0.6e0
        THEN 'Models disagree (' || printf('%.0f', {s.decimal_round('agreement_ratio * 100', 0)})
             || '% < 60% agreement)'
      WHEN raw_prediction IN ('UP', 'DOWN') AND abs(p_up - p_down) < 0.15e0
        THEN 'UP/DOWN too close - uncertain market direction' END AS safety_reason FROM voted"""


RULED = """SELECT id, raw_prediction, safety_reason, safety_reason IS NOT NULL AS safety_applied,
                  CASE WHEN safety_reason IS NULL THEN raw_prediction ELSE 'NEUTRAL' END AS prediction,
                  round(agreement_ratio, 2) AS agreement FROM ruled"""
RULE_COLUMNS = ["id", "raw_prediction", "safety_reason", "safety_applied", "prediction",
                "agreement", "action"]


@query("safety_rules", s.twin(f"SELECT *, {_actions(params.SAFE_ACTIONS)} AS action FROM out",
                              "scored", by_id=BY_ID, voted=VOTED,
                              ruled=ruled_sql(params.MIN_CONFIDENCE), out=RULED))
def safety_rules(spark, sf):
    return ensemble.safety_rules(ensemble.ensemble_vote(scores(spark, sf))).select(*RULE_COLUMNS)


@query("safety_rules_low_confidence", s.twin(
    f"SELECT *, {_actions(params.SAFE_ACTIONS)} AS action FROM out", "scored", by_id=BY_ID,
    voted=VOTED, ruled=ruled_sql(0.4), out=RULED))
def safety_rules_low_confidence(spark, sf):
    """A lower confidence bound, so that the opposite-gap rule can fire."""
    voted = ensemble.ensemble_vote(scores(spark, sf))
    return ensemble.safety_rules(voted, min_confidence=0.4).select(*RULE_COLUMNS)


# --- heuristic -------------------------------------------------------------------------------

def _hit(words) -> str:
    return (f"len(list_filter(list_distinct({s.words('lower(title)')}), "
            f"lambda w: list_contains({s.listing(words)}, w)))")


HEUR_VIEWS = dict(
    **_polarity_sql("headlines", "id", "title", DEFAULT_ROWS),
    base=f"""SELECT id, title, coalesce(polarity, 0) AS polarity,
               {_hit(DEFAULT_LEXICON.terms('bullish'))} AS n_bull,
               {_hit(DEFAULT_LEXICON.terms('bearish'))} AS n_bear,
               {_hit(DEFAULT_LEXICON.terms('neutral'))} AS n_neut,
               {_hit(STRONG_BULLISH)} AS s_up, {_hit(STRONG_BEARISH)} AS s_down
             FROM headlines LEFT JOIN pol ON id = k""",
    pts="""SELECT *, n_bull * 0.3e0 + greatest(0.0e0, polarity) * 0.4e0
                     + CASE WHEN s_up > 0 THEN 0.5e0 ELSE 0 END AS up,
                  n_bear * 0.3e0 + greatest(0.0e0, -polarity) * 0.4e0
                     + CASE WHEN s_down > 0 THEN 0.5e0 ELSE 0 END AS dn,
                  n_neut * 0.2e0 AS fl FROM base""",
    pick="""SELECT *, CASE WHEN up > dn + 0.1e0 AND up > fl THEN 2
                           WHEN dn > up + 0.1e0 AND dn > fl THEN 0 ELSE 1 END AS pid FROM pts""",
    conf="""SELECT *, least(0.65e0 + CASE WHEN pid = 2 THEN up ELSE dn END * 0.1e0, 0.95e0)
                   AS c FROM pick""",
    wts=f"""SELECT *, CASE pid WHEN 1 THEN 0.25e0 WHEN 0 THEN {s.decimal_round('c', 2)}
                               ELSE 0.1e0 END AS d,
                   CASE pid WHEN 1 THEN 0.5e0
                            ELSE greatest({s.decimal_round('0.9e0 - c', 2)}, 0.0e0) END AS n,
                   CASE pid WHEN 1 THEN 0.25e0 WHEN 2 THEN {s.decimal_round('c', 2)}
                            ELSE 0.1e0 END AS u
            FROM conf""",
    heur="""SELECT id, title, n_bull, n_bear, n_neut, polarity, pid AS prediction_id,
                   CASE pid WHEN 0 THEN 'DOWN' WHEN 1 THEN 'NEUTRAL' ELSE 'UP' END AS prediction,
                   round(d / (d + n + u), 4) AS p_down, round(n / (d + n + u), 4) AS p_neutral,
                   round(u / (d + n + u), 4) AS p_up FROM wts""")
HEUR_COLUMNS = ["id", "n_bull", "n_bear", "n_neut", "polarity", "prediction_id", "prediction",
                *P, "confidence"]


@query("heuristic_score", s.twin(
    "SELECT id, n_bull, n_bear, n_neut, polarity, CAST(prediction_id AS BIGINT) AS prediction_id, prediction, p_down, p_neutral, "
    "p_up, greatest(p_down, p_neutral, p_up) AS confidence FROM heur", "headlines", **HEUR_VIEWS))
def heuristic_score(spark, sf):
    return printable(heuristic.heuristic_score(spread_headlines(spark, sf)).select(*HEUR_COLUMNS))


@query("score_with_fallback", s.twin(
    """SELECT h.id, coalesce(m.prediction, h.prediction) AS prediction,
              coalesce(m.p_down, h.p_down) AS p_down,
              coalesce(m.p_neutral, h.p_neutral) AS p_neutral, coalesce(m.p_up, h.p_up) AS p_up,
              coalesce(m.model_used, 'heuristic_fallback') AS model_used
       FROM heur h LEFT JOIN m USING (id)""", "scored", "headlines", **HEUR_VIEWS,
    m=f"""SELECT id, 'm1' AS model_used, {s.LABEL_NAME.format('prediction')} AS prediction,
                 p_down, p_neutral, p_up FROM scored
          WHERE model = 'm1' AND greatest(p_down, p_neutral, p_up) >= 0.8e0"""))
def score_with_fallback(spark, sf):
    """The model abstains below a confidence of 0.8; the heuristic takes over there."""
    rows = scored(spark, sf).where((F.col("model") == "m1")
                                   & (lab.confidence(*P) >= 0.8))
    model = rows.select("id", F.col("model").alias("model_used"),
                        lab.label_name("prediction").alias("prediction"), *P)
    return heuristic.score_with_fallback(spread_headlines(spark, sf), model).select(
        "id", "prediction", *P, "model_used")


# --- scaling ---------------------------------------------------------------------------------

X_ROWS = ("SELECT vec_id AS id, label % 3 AS label, CAST(unnest(embedding) AS DOUBLE) AS x, "
          "generate_subscripts(embedding, 1) - 1 AS feature FROM embeddings")


@query("scaler_stats", s.twin(
    "SELECT 'x' || feature AS feature, round(avg(x), 6) + 0.0 AS mean, "
    "round(stddev_pop(x), 6) AS std FROM r GROUP BY feature", r=X_ROWS))
def scaler_stats(spark, sf):
    vectors = table(spark, sf, "embeddings").select(
        F.col("embedding").cast("array<double>").alias("x"))
    stats = rounded(scaling.vector_stats(vectors, "x"), "mean", "std")
    return stats.select(F.concat(F.lit("x"), "position").alias("feature"), "mean", "std")


SCALE_COLUMNS = ["hour", "day_of_week", "cents", "one"]


def _event_features(spark, sf):
    events = table(spark, sf, "events")
    split = splits.stratified_split(events.select("event_id", "event_type", "ts", "value"),
                                    "event_type", "event_id")
    return split.select(
        "event_id", "is_test", F.hour("ts").alias("hour"), cal.day_of_week("ts").alias("day_of_week"),
        F.round(F.col("value") * 100).cast("long").alias("cents"), F.lit(1).alias("one"))


EVENT_FEATURES = ("SELECT event_id, is_test, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week, "
                  "CAST(round(value * 100) AS BIGINT) AS cents, 1 AS one FROM sp")


@query("standardise", s.twin(
    "SELECT event_id, " + ", ".join(
        f"round(CASE WHEN s_{c} = 0 THEN 0 ELSE ({c} - m_{c}) / s_{c} END, 6) + 0.0 AS {c}"
        for c in SCALE_COLUMNS) + " FROM e, st", sp=SPLIT, e=EVENT_FEATURES,
    st="SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}"
                             for c in SCALE_COLUMNS) + " FROM e WHERE NOT is_test"))
def standardise(spark, sf):
    rows = _event_features(spark, sf)
    out = scaling.standardise(rows, rows.where(~F.col("is_test")), SCALE_COLUMNS)
    out = rounded(out.select("event_id", *SCALE_COLUMNS), *SCALE_COLUMNS)
    return out.withColumns({c: F.col(c) + F.lit(0.0) for c in SCALE_COLUMNS})


@query("pad_missing_features", s.twin(
    "SELECT event_id, coalesce(CASE WHEN NOT is_test THEN hour END, m_hour) AS hour, "
    "CAST(cents AS DOUBLE) AS cents, m_dow AS day_of_week FROM e, st",
    sp=SPLIT, e=EVENT_FEATURES,
    st="SELECT avg(hour) AS m_hour, avg(day_of_week) AS m_dow FROM e WHERE NOT is_test"))
def pad_missing_features(spark, sf):
    """Test rows lack `hour` and no row has `day_of_week`."""
    rows = _event_features(spark, sf)
    lacking = rows.withColumn("hour", F.when(~F.col("is_test"), F.col("hour"))).drop("day_of_week")
    out = scaling.pad_missing_features(lacking, rows.where(~F.col("is_test")),
                                       ["hour", "cents", "day_of_week"])
    return out.select("event_id", F.col("hour").cast("double").alias("hour"),
                      F.col("cents").cast("double").alias("cents"), "day_of_week")


# --- attribution -----------------------------------------------------------------------------

ATTRIBUTED = {
    "r": X_ROWS,
    "w": "SELECT label AS class, feature, avg(x) AS w FROM r GROUP BY ALL",
    "att": """SELECT r.id, w.class, feature, w * (x - mean_x) AS attribution
              FROM r JOIN w USING (feature)
              JOIN (SELECT feature, avg(x) AS mean_x FROM r GROUP BY feature) USING (feature)""",
    "imp": """SELECT feature, round(avg(v), 9) AS importance
              FROM (SELECT class, feature, avg(abs(attribution)) AS v FROM att GROUP BY ALL)
              GROUP BY feature"""}


def _attribution(spark, sf):
    """Attribution of the nearest-centroid linear model: a class's weights are its means."""
    rows = samples(spark, sf)
    long = rows.select("id", "label", F.posexplode("x").alias("feature", "x"))
    weights = long.groupBy(F.col("label").alias("class"), "feature").agg(F.avg("x").alias("w"))
    return tuning.linear_attribution(tuning.feature_rows(rows, "id", F.col("x")), weights, "id")


@query("linear_attribution", s.twin(
    "SELECT id, CAST(class AS BIGINT) AS class, feature, round(attribution, 6) + 0.0 AS attribution FROM att",
    **{k: ATTRIBUTED[k] for k in ("r", "w", "att")}))
def linear_attribution(spark, sf):
    out = rounded(_attribution(spark, sf), "attribution")
    return printable(out.withColumn("attribution", F.col("attribution") + F.lit(0.0)))


@query("mean_abs_attribution", s.twin("SELECT feature, importance FROM imp", **ATTRIBUTED))
def mean_abs_attribution(spark, sf):
    out = tuning.mean_abs_attribution(_attribution(spark, sf))
    return printable(rounded(out, "importance", digits=9))


@query("topk_features", s.twin(
    "SELECT feature, importance FROM imp ORDER BY importance DESC, feature LIMIT 15",
    **ATTRIBUTED))
def topk_features(spark, sf):
    table_ = rounded(tuning.mean_abs_attribution(_attribution(spark, sf)), "importance", digits=9)
    return printable(tuning.topk_features(table_, "importance", params.TOP_ATTRIBUTION))


# --- model jobs (rows only) ------------------------------------------------------------------

# Labelled rows that a fit of the forest, the boosted trees or the kernel machine takes, chosen
# by a hash of the id. The logistic model takes all. Models have their full size, but for the
# rounds of the boosted trees: a round is a job per level, see the README.
FIT_ROWS = 500
# On thousands of term features the logistic solver is stopped after so many steps.
HEADLINE_ARGUMENTS = {"max_iter": 50}
ARGUMENTS = {"logistic_regression": {}, "svm": {}, "random_forest": {}, "gbt": {"rounds": 10}}


def _bounded(rows, name):
    if name == "logistic_regression":
        return rows
    return rows.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS)


# What the scores must be at any size: one row per vector, shares of one, the class with the
# largest, and (over all rows) more right than the most frequent class would be.
FLAGS_SQL = s.twin(
    "SELECT vec_id AS id, true AS sums_to_one, true AS is_largest, true AS in_range FROM embeddings")


def _flags(scored):
    total = F.col("p_down") + F.col("p_neutral") + F.col("p_up")
    own = F.element_at(F.array(*P), F.col("prediction").cast("int") + 1)
    return scored.select("id", (F.abs(total - 1) < 1e-6).alias("sums_to_one"),
                         (own == F.greatest(*P)).alias("is_largest"),
                         (F.least(*P) >= 0).alias("in_range"))


def _fit_and_score(spark, sf, name):
    rows = samples(spark, sf).drop("x")
    model = estimators.FITTERS[name](_bounded(rows, name), **ARGUMENTS[name])
    return estimators.predict_probabilities(model, rows).drop("features")


@query("fit_logistic")
def fit_logistic(spark, sf):
    return _fit_and_score(spark, sf, "logistic_regression")


@query("fit_svm", FLAGS_SQL)
def fit_svm(spark, sf):
    return _flags(_fit_and_score(spark, sf, "svm"))


@query("fit_random_forest", FLAGS_SQL)
def fit_random_forest(spark, sf):
    return _flags(_fit_and_score(spark, sf, "random_forest"))


@query("fit_gbt", FLAGS_SQL)
def fit_gbt(spark, sf):
    return _flags(_fit_and_score(spark, sf, "gbt"))


@query("grid_search")
def grid_search(spark, sf):
    """Full grid and folds of the logistic model."""
    return tuning.grid_search(samples(spark, sf).drop("x"), "logistic_regression")[1]


@query("cross_validate")
def cross_validate(spark, sf):
    return tuning.cross_validate(samples(spark, sf).drop("x"), "logistic_regression")


@query("benchmark")
def benchmark(spark, sf):
    split = splits.stratified_split(samples(spark, sf).drop("x"), "label", "id")
    train, test = split.where(~F.col("is_test")), split.where("is_test")
    scaler = scaling.fit_vector_scaler(train)

    def scaled(df):
        return scaler.transform(df).select("id", "label", F.col("scaled").alias("features"))

    folder = new_path(spark, "benchmark-models")
    fitted = scaled(train.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS))
    return tuning.benchmark(
        spark, fitted, scaled(test), ARGUMENTS,
        save=lambda name, model: sinks.save_model(model, f"{folder}/{name}"),
        grids={"logistic_regression": tuning.PARAM_GRIDS["logistic_regression"]}
    ).drop("train_time_s")


@query("feature_importance")
def feature_importance(spark, sf):
    rows = samples(spark, sf).drop("x")
    model = estimators.fit_random_forest(_bounded(rows, "random_forest"))
    width = len(rows.select("features").first()[0])
    return tuning.feature_importance(spark, model, [f"x{i}" for i in range(width)])


@query("permutation_importance")
def permutation_importance(spark, sf):
    rows = samples(spark, sf).drop("x")
    model = estimators.fit_logistic(rows)
    return tuning.permutation_importance(rows, model)


def _news(spark, sf):
    """Headlines aligned with their instruments' labelled bars and indicators.

    A join leaves its rows in as few partitions as their bytes need; they are dealt to all
    cores again before the costly text work.
    """
    market = indicators.market_features(ticks_bars(spark, sf))
    return spread(align.align_news_prices(headlines(spark, sf), market), "id")


def _same():
    return [(F.col("a_p") == F.col("b_p")).alias("same_scores"),
            (F.unwrap_udt("a_x") == F.unwrap_udt("b_x")).alias("same_features")]


@query("sink_model", s.twin("SELECT id, true AS same_scores, true AS same_features FROM headlines",
                            "headlines"))
def sink_model(spark, sf):
    """Headlines scored by a whole saved pipeline, loaded again, as by the one in memory."""
    model = headline_model.fit(_news(spark, sf), arguments=HEADLINE_ARGUMENTS)
    path = new_path(spark, "model")
    sinks.save_model(model, path)
    texts = new_path(spark, "headlines")
    spread_headlines(spark, sf).select("id", "title", "published_at").write.parquet(texts)
    both, models = spark.read.parquet(texts), {"a": model, "b": sinks.load_model(path)}

    def scored(df, name):
        out = estimators.with_probabilities(models[name].transform(df))
        return out.select(*df.columns, F.struct(*P, "prediction").alias(f"{name}_p"),
                          F.col("features").alias(f"{name}_x"))

    # Both models score a row where it is. Only the rows of an id that comes more than once are
    # joined by it, all with all.
    counts = both.where("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    repeated = counts.where("n > 1").select("id")
    once = scored(scored(both.where("id IS NOT NULL").join(repeated, "id", "left_anti"), "a"), "b")
    pairs = both.join(repeated, "id", "left_semi")
    for name in models:
        rows = pairs.select("id", "title", "published_at")
        pairs = pairs.join(scored(rows, name).select("id", f"{name}_p", f"{name}_x"), "id")
    return once.select("id", *_same()).unionByName(pairs.select("id", *_same()))


@query("feature_matrix", s.twin(
    """SELECT id, (SELECT count(*) FROM vocab) + 384 + 13 + 13 + 8 AS n_features,
              coalesce(n_terms, 0) AS n_terms, coalesce(n_buckets, 0) AS n_buckets
       FROM news LEFT JOIN (SELECT doc_id, count(*) AS n_terms FROM term_counts
                            JOIN vocab USING (term) GROUP BY doc_id) t ON t.doc_id = id
       LEFT JOIN (SELECT doc_id, count(DISTINCT CAST(concat('0x', substring(md5(w), 1, 8)) AS BIGINT)
                         % 384) AS n_buckets FROM clean_words GROUP BY doc_id) b ON b.doc_id = id""",
    "headlines", "ticks_bars", ret=s.returns("ticks_bars"),
    news=f"""SELECT h.id, {s.clean('title')} AS clean_text FROM headlines h
             JOIN ret r ON r.ticker = h.ticker AND r.date = CAST(h.published_at AS DATE)
             WHERE r.forward_return IS NOT NULL""",
    clean_docs="SELECT id AS doc_id, clean_text FROM news",
    clean_words=s.VIEWS["clean_words"], grams=s.VIEWS["grams"], term_counts=s.VIEWS["term_counts"],
    vocab=VOCAB))
def feature_matrix(spark, sf):
    # The vocabulary's two passes and the matrix read the clean rows, not the joins behind them.
    path = new_path(spark, "clean-news")
    preprocess(_news(spark, sf)).select("id", "clean_text", "published_at", *indicators.MARKET_FEATURES
                                        ).write.parquet(path)
    news = spark.read.parquet(path)
    matrix = headline_model.feature_matrix(news, vocabulary.fit_vocabulary(news, "clean_text"))
    filled = [F.size(F.filter(sparse_parts(c)[1], lambda x: x != 0)).cast("long")
              for c in ("tfidf", "embedding")]
    return matrix.select("id", F.size(vector_to_array("features")).cast("long").alias("n_features"),
                         filled[0].alias("n_terms"), filled[1].alias("n_buckets"))



@query("score_batch", s.twin(
    f"""SELECT id, title AS headline, {s.clean('title')} AS clean_text,
               CAST(len({KEYWORDS.replace('text', 'title')}) AS BIGINT) AS n_keywords,
               round(coalesce(polarity, 0), 4) AS polarity, true AS class_of_largest,
               true AS sums_to_one
        FROM headlines LEFT JOIN pol ON id = k""", "headlines",
    clean=f"SELECT id, {s.clean('title')} AS clean_text FROM headlines",
    **_polarity_sql("clean", "id", "clean_text", DEFAULT_ROWS)))
def score_batch(spark, sf):
    """One saved pipeline with the whole feature set, trained on aligned headlines, loaded and
    run over all raw headlines; checked by its deterministic parts."""
    path = new_path(spark, "headline-model")
    sinks.save_model(headline_model.fit(_news(spark, sf), arguments=HEADLINE_ARGUMENTS), path)
    raw = spread_headlines(spark, sf).select("id", "title", "published_at")
    out = scoring.score_batch(raw, sinks.load_model(path), "logistic_regression")
    shares = [F.col(f"probabilities.{c}") for c in ("down", "neutral", "up")]
    picked = F.element_at(F.array(*shares), F.col("prediction_id").cast("int") + 1)
    return out.select(
        "id", "headline", "clean_text",
        F.size("financial_keywords").cast("long").alias("n_keywords"),
        F.col("sentiment.polarity").alias("polarity"),
        (picked == F.greatest(*shares)).alias("class_of_largest"),
        (F.abs(shares[0] + shares[1] + shares[2] - 1) < 2e-4).alias("sums_to_one"))
