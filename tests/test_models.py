"""Model jobs: quality on separable data, determinism, persistence."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.lexicons import DEFAULT_LEXICON
from marketlens.operators import (
    boosting, ensemble, estimators, headline_model, kernel_svm, scoring, splits, standardise,
    tuning, vocabulary)
from marketlens.sources import sinks
from marketlens.sources.workspace import new_path


@pytest.fixture(scope="module")
def separable(spark):
    rows = []
    for i in range(240):
        c = i % 3
        noise = ((i * 37) % 11 - 5) / 12
        rows.append((i, c, Vectors.dense([(c == 0) * 2 + noise, (c == 1) * 2 - noise,
                                          (c == 2) * 2 + noise / 2])))
    return spark.createDataFrame(rows, ["id", "label", "features"]).withColumn(
        "label", F.col("label").cast("int")).coalesce(2).persist()


OPTIONS = {"logistic_regression": {"max_iter": 50}, "svm": {},
           "random_forest": {"trees": 20, "depth": 5}, "gbt": {"rounds": 3, "depth": 3}}


@pytest.mark.parametrize("name", sorted(OPTIONS))
def test_fitters_learn_and_reload(spark, separable, name):
    model = estimators.FITTERS[name](separable, **OPTIONS[name])
    scored = estimators.predict_probabilities(model, separable)
    assert scored.where(F.col("label") == F.col("prediction")).count() > 0.9 * 240
    path = new_path(spark, name)
    sinks.save_model(model, path)
    again = estimators.predict_probabilities(sinks.load_model(path), separable)
    pick = ["id", "p_down", "p_neutral", "p_up", "prediction"]
    assert scored.select(pick).exceptAll(again.select(pick)).count() == 0


def test_ensemble_in_row_equals_long_form(separable):
    models = {n: estimators.FITTERS[n](separable, **OPTIONS[n])
              for n in ("logistic_regression", "random_forest")}
    wide = scoring.score_ensemble(separable, models)
    long = ensemble.ensemble_align(*[
        estimators.predict_probabilities(m, separable).withColumn("model", F.lit(n))
        for n, m in models.items()])
    names = ["id", "p_down", "p_neutral", "p_up", "raw_prediction", "agreement_ratio"]
    voted = ensemble.ensemble_vote(long).select(names)
    assert wide.select(names).exceptAll(voted).count() == 0
    assert ensemble.safety_rules(wide).count() == 240


def test_population_scaling(separable):
    scaled = standardise.fit_vector_scaler(separable).transform(separable)
    values = [r["scaled"][0] for r in scaled.collect()]
    mean = sum(values) / len(values)
    assert mean == pytest.approx(0, abs=1e-9)
    assert sum((v - mean) ** 2 for v in values) / len(values) == pytest.approx(1)


def test_importance_and_attribution(spark, separable):
    model = estimators.fit_logistic(separable, max_iter=50)
    drops = tuning.permutation_importance(separable, model).collect()
    assert len(drops) == 3 and all(r["accuracy_drop"] > 0.1 for r in drops)
    weights = tuning.model_weights(spark, model)
    assert weights.count() == 9
    forest = estimators.fit_random_forest(separable, trees=10, depth=4)
    table = tuning.feature_importance(spark, forest, ["a", "b", "c"]).collect()
    assert sum(r["importance"] for r in table) == pytest.approx(1)
    assert tuning.feature_importance(spark, model, ["a", "b", "c"]).count() == 0


@pytest.mark.parametrize("name, grid, fixed", [
    ("logistic_regression", {"C": [1.0]}, {}), ("svm", {"C": [10.0], "gamma": ["scale"]}, {}),
    ("gbt", {"rate": [0.1]}, {"rounds": 3, "depth": 3})])
def test_every_model_can_be_searched(spark, separable, name, grid, fixed):
    assert set(grid) <= set(tuning.PARAM_GRIDS[name])
    _, table = tuning.grid_search(separable, name, grid, k=2, fixed=fixed)
    assert table.first()["f1_macro"] > 0.9


def test_boosted_importance(spark, separable):
    model = estimators.fit_gbt(separable, rounds=2, depth=2)
    got = {r["feature"]: r["importance"] for r in
           tuning.feature_importance(spark, model, ["a", "b", "c"]).collect()}
    assert [got[f] for f in "abc"] == pytest.approx(list(model.stages[0].featureImportances))
    assert sum(got.values()) == pytest.approx(1)
    with pytest.raises(ValueError):
        tuning.feature_importance(spark, model, ["a", "b"])


def noisy(n, seed):
    """Rows of small whole numbers, so that every value is a bin of its own."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rng.randint(0, 5) for _ in range(3)]
        c = (x[0] + x[1] > 5) + (x[2] > 3) if rng.random() < 0.8 else rng.randint(0, 2)
        rows.append((i, c, [float(v) for v in x]))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, c, Vectors.dense(x)) for i, c, x in rows],
                                 T.StructType([T.StructField("id", T.LongType()),
                                               T.StructField("label", T.IntegerType()),
                                               T.StructField("features", VectorUDT())]))


def brute_booster(rows, rounds, depth, rate, reg=1.0, min_weight=1.0):
    """Margins of plain exact boosting, tree by tree and node by node."""
    xs, ys = [x for *_, x in rows], [c for _, c, _ in rows]
    margins = [[0.0] * 3 for _ in rows]

    def grow(ids, g, h, level, out):
        total_g, total_h = sum(g[i] for i in ids), sum(h[i] for i in ids)
        best = (1e-9, None, None)
        if level < depth:
            for f in range(3):
                for cut in sorted({x[f] for x in xs})[:-1]:
                    left = [i for i in ids if xs[i][f] <= cut]
                    lg, lh = sum(g[i] for i in left), sum(h[i] for i in left)
                    rg, rh = total_g - lg, total_h - lh
                    if lh < min_weight or rh < min_weight:
                        continue
                    gain = round(lg ** 2 / (lh + reg) + rg ** 2 / (rh + reg)
                                 - total_g ** 2 / (total_h + reg), 9)
                    if gain > best[0]:
                        best = gain, f, cut
        if best[1] is None:
            for i in ids:
                out[i] = -rate * total_g / (total_h + reg)
            return
        _, f, cut = best
        grow([i for i in ids if xs[i][f] <= cut], g, h, level + 1, out)
        grow([i for i in ids if xs[i][f] > cut], g, h, level + 1, out)

    for _ in range(rounds):
        shares = []
        for m in margins:
            e = [math.exp(v - max(m)) for v in m]
            shares.append([v / sum(e) for v in e])
        steps = []
        for c in range(3):
            g = [p[c] - (y == c) for p, y in zip(shares, ys)]
            h = [2 * p[c] * (1 - p[c]) for p in shares]
            out = [0.0] * len(rows)
            grow(list(range(len(rows))), g, h, 0, out)
            steps.append(out)
        margins = [[m[c] + steps[c][i] for c in range(3)] for i, m in enumerate(margins)]
    return margins


@pytest.mark.parametrize("parts", [1, 5])
def test_boosting_equals_brute_force(spark, parts):
    rows = noisy(150, 4)
    train = frame(spark, rows).repartition(parts)
    losses = []
    model = boosting.fit_boosting(train, rounds=4, depth=3, rate=0.3, rows=1.0, columns=1.0,
                                  losses=losses)
    got = {r["id"]: r["probability"] for r in model.transform(train).collect()}
    for (i, *_), margins in zip(rows, brute_booster(rows, 4, 3, 0.3)):
        e = [math.exp(v) for v in margins]
        assert list(got[i]) == pytest.approx([v / sum(e) for v in e], abs=1e-9)
    assert losses == sorted(losses, reverse=True) and len(set(losses)) == 4


def test_boosting_subsamples_and_edge_cases(spark):
    rows = noisy(300, 5)
    train = frame(spark, rows)
    losses = []
    first = boosting.fit_boosting(train, rounds=6, depth=3, losses=losses)
    again = boosting.fit_boosting(train.repartition(3), rounds=6, depth=3)
    # The draw depends on the rows' content only.
    assert (first.arrays["feature"] == again.arrays["feature"]).all()
    assert losses == sorted(losses, reverse=True)
    one = frame(spark, [(1, 2, [1.0, 1.0, 1.0]), (2, 2, [1.0, 1.0, 1.0])])
    flat = boosting.fit_boosting(one, rounds=3, depth=2)
    p = flat.transform(one).first()["probability"]
    assert p[2] > p[0] == p[1]
    with pytest.raises(ValueError):
        boosting.fit_boosting(train.where("false"), rounds=1)


def plain_dual(k, y, c, sweeps=40_000):
    """Dual objective by exact steps on the most violating pair, without second order."""
    alpha = np.zeros(len(y))
    for _ in range(sweeps):
        minus = -y * (y * (k @ (alpha * y)) - 1)
        up = np.where(y > 0, alpha < c - 1e-12, alpha > 1e-12)
        low = np.where(y > 0, alpha > 1e-12, alpha < c - 1e-12)
        i = np.argmax(np.where(up, minus, -np.inf))
        j = np.argmin(np.where(low, minus, np.inf))
        if minus[i] - minus[j] < 1e-6:
            break
        step = (minus[i] - minus[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        step = min(step, c[i] - alpha[i] if y[i] > 0 else alpha[i],
                   alpha[j] if y[j] > 0 else c[j] - alpha[j])
        alpha[i] += y[i] * step
        alpha[j] -= y[j] * step
    return alpha.sum() - (alpha * y) @ k @ (alpha * y) / 2


@pytest.mark.parametrize("block_rows", [40, 1000])
def test_kernel_machine_is_optimal(spark, block_rows):
    rows = noisy(220, 6)
    rows += rows[:10]  # repeated rows
    train = frame(spark, rows).withColumn("weight", F.lit(1.0) + F.col("label") / 4)
    fitted = kernel_svm.fit_margins(train, "features", "label", "weight", 2.0, 0.3,
                                    tolerance=1e-4, block_rows=block_rows)
    model = fitted.arrays
    x = np.array([x for *_, x in rows])
    k = kernel_svm.rbf(x, x, 0.3)
    for c in range(3):
        y = np.array([1.0 if own == c else -1.0 for _, own, _ in rows])
        penalty = np.array([2.0 * (1 + own / 4) for _, own, _ in rows])
        best = plain_dual(k, y, penalty)
        assert abs(model["gap"][c]) < 1e-3 * model["primal"][c]
        assert model["primal"][c] == pytest.approx(best, rel=1e-3)
    margins = {r["id"]: r["raw_1"][0] for r in fitted.transform(train).collect()}
    by_hand = kernel_svm.rbf(x, model["vectors"], 0.3) @ model["weights"][1] + model["bias"][1]
    assert [margins[i] for i, *_ in rows] == pytest.approx(list(by_hand))


def test_kernel_machine_without_a_class(spark):
    train = frame(spark, [(i, i % 2, [float(i % 2), 0.0, 0.0]) for i in range(20)])
    model = estimators.fit_svm(train)
    out = estimators.predict_probabilities(model, train).collect()
    assert all(r["prediction"] == r["label"] for r in out)


def test_grid_and_benchmark(spark, separable):
    model, table = tuning.grid_search(separable, "random_forest", {"depth": [0, 4]}, k=3,
                                      fixed={"trees": 10})
    best = table.collect()
    assert best[0]["f1_macro"] > best[1]["f1_macro"] and best[0]["params"] == '{"depth": 4}'
    assert max(tree.depth for tree in model.stages[0].trees) > 0
    split = splits.stratified_split(separable, "label", "id")
    train, test = split.where(~F.col("is_test")), split.where("is_test")
    options = {"logistic_regression": {"max_iter": 20}, "random_forest": {"trees": -1}}
    summary = tuning.benchmark(spark, train, test, options).collect()
    assert [r["model"] for r in summary] == ["logistic_regression", "random_forest"]
    assert summary[0]["f1_macro"] > 0.9 and summary[1]["error"]


def news_rows(spark, n=90):
    titles = ["Shares surge after record profit!", "Shares plunge on weak demand",
              "Board keeps guidance unchanged", "", None]
    rows = [(i, titles[i % 5], dt.datetime(2024, 1, 1 + i % 20, i % 24), (i % 5) % 3,
             float(i % 7), None if i % 4 else 1.5) for i in range(n)]
    return spark.createDataFrame(
        rows, "id long, title string, published_at timestamp_ntz, label int, ma_5 double, "
              "rsi double")


def test_saved_headline_model_scores_alike(spark):
    """One pipeline from raw headline to record, with all features, saved and loaded."""
    train = news_rows(spark)
    model = headline_model.fit(train, arguments={"max_iter": 50})
    path = new_path(spark, "headline-model")
    sinks.save_model(model, path)
    again = sinks.load_model(path)
    raw = train.select("id", "title", "published_at")  # no market columns when scoring
    first, second = (scoring.score_batch(raw, m, "m").orderBy("id").collect()
                     for m in (model, again))
    assert first == second and len(first) == 90
    width = len(again.transform(raw).first()["features"])
    terms = vocabulary.fit_vocabulary(again.transform(raw), "clean_text").count()
    assert width == terms + 384 + 13 + 2 + 8
    hit = [r for r in first if r["headline"] and "surge" in r["headline"]]
    assert hit[0]["sentiment"]["polarity"] > 0
    right = sum(r["prediction_id"] == x["label"] for r, x in zip(
        first, train.orderBy("id").collect()))
    assert right > 80


def test_padding_uses_training_means(spark):
    train = news_rows(spark)
    model = headline_model.fit(train, arguments={"max_iter": 5}, scale=False)
    filled = model.transform(train.select("id", "title")).first()
    assert filled["ma_5"] == pytest.approx(sum(i % 7 for i in range(90)) / 90)
    assert filled["rsi"] == 1.5 and filled["hour"] == 0


def test_lexicon_table_in_saved_model(spark):
    path = new_path(spark, "lexicon")
    DEFAULT_LEXICON.table(spark).write.parquet(path)
    train = news_rows(spark)
    plain, tabled = (headline_model.fit(train, arguments={"max_iter": 20}, **options)
                     for options in ({}, {"lexicon": path}))
    columns = ["id", "p_down", "p_neutral", "p_up"]
    one, two = (estimators.with_probabilities(m.transform(train)).select(columns).orderBy("id")
                .collect() for m in (plain, tabled))
    assert one == two


def test_feature_matrix_runs_in_the_row(spark):
    train = news_rows(spark).withColumn("clean_text", F.lower(F.coalesce("title", F.lit(""))))
    vocab = vocabulary.fit_vocabulary(train, "clean_text").persist()
    matrix = headline_model.feature_matrix(train, vocab)
    plan = matrix._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    long = vocabulary.tfidf_transform(train, vocab, "clean_text", "id")
    place = {r["term"]: i for i, r in enumerate(vocab.orderBy("term").collect())}
    expected = {}
    for r in long.collect():
        expected.setdefault(r["id"], {})[place[r["term"]]] = r["weight"]
    for r in matrix.collect():
        got = dict(zip(r["tfidf"].indices.tolist(), r["tfidf"].values.tolist()))
        assert got == pytest.approx(expected.get(r["id"], {}))


def test_tfidf_in_row_equals_join(spark):
    docs = spark.createDataFrame([(1, "aa bb cc aa"), (2, "bb bb dd"), (2, "aa"), (None, None),
                                  (3, "")], "id long, t string")
    vocab = vocabulary.fit_vocabulary(docs, "t", min_df=1)
    rows = [sorted(((r["id"], r["term"], r["tf"], round(r["weight"], 12)) for r in f(
        docs, vocab, "t", "id").collect()), key=str)
        for f in (vocabulary.tfidf_in_row, vocabulary.tfidf_transform)]
    assert rows[0] == rows[1] and len(rows[0]) > 8
    assert vocabulary.tfidf_in_row(docs, vocab.where("false"), "t", "id").count() == 0
