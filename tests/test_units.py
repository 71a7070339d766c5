"""Hand-computed edge cases."""

import datetime as dt
import math
import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens import params
from marketlens.functions import calendar as cal
from marketlens.functions import labels as lab
from marketlens.functions import lexicon as lex
from marketlens.functions import text as tx
from marketlens.lexicons import DEFAULT_LEXICON, Lexicon
from marketlens.operators import (
    align, embedding, ensemble, features, headline_model, heuristic, indicators, lemmas,
    lexicon_scan, metrics, splits, standardise, token_arrays, vocabulary)
from marketlens.sources import news, prices

DAY = dt.date(2024, 1, 1)


def bars_of(spark, closes, volumes=None, ticker="A"):
    volumes = volumes or [1] * len(closes)
    rows = [(ticker, DAY + dt.timedelta(days=i), float(c) if c is not None else None, v)
            for i, (c, v) in enumerate(zip(closes, volumes))]
    return spark.createDataFrame(rows, "ticker string, date date, close double, volume bigint")


def one(df, column):
    return [r[column] for r in df.orderBy("date").collect()]


def text_values(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["x"] for r in df.select("i", expression.alias("x")).orderBy("i").collect()]


def test_label_edges(spark):
    rows = [(None,), (0.01,), (0.0100001,), (-0.01,), (-0.0100001,)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, r double")
    got = df.select("i", lab.label_from_return("r").alias("x")).orderBy("i").collect()
    assert [r["x"] for r in got] == [-1, 1, 2, 1, 0]


def test_single_bar(spark):
    bars = bars_of(spark, [10])
    assert one(indicators.forward_return(bars), "forward_return") == [None]
    row = indicators.market_features(bars).first()
    assert row["volatility"] == 0 and row["rsi"] == 0 and row["momentum"] == 0
    assert all(row[f"ma_{n}"] == 10 for n in params.MA_WINDOWS)


def test_rsi_without_losses(spark):
    bars = bars_of(spark, range(1, 21))
    assert set(one(indicators.rsi(bars), "rsi")) == {0.0}
    assert one(indicators.rsi(bars, zero_loss=100.0), "rsi")[1:] == [100.0] * 19


def test_zero_volume_and_zero_price(spark):
    bars = bars_of(spark, [0, 5, 6], [0, 0, 0])
    rows = indicators.market_features(bars).orderBy("date").collect()
    assert [r["volume_ratio"] for r in rows] == [0, 0, 0]
    assert one(indicators.pct_change(bars), "pct_change")[:2] == [None, None]


def test_gaps_are_filled_before_returns(spark):
    bars = bars_of(spark, [10, None, 20])
    assert one(indicators.pct_change(bars), "pct_change") == [None, 0.0, 1.0]


@pytest.mark.parametrize("block_rows", [50, 64, 200])
def test_blocks_equal_plain_window(spark, block_rows):
    rng = random.Random(7)
    closes = [None if rng.random() < 0.1 else rng.randint(1, 900) for _ in range(430)]
    volumes = [rng.randint(0, 50) for _ in closes]
    hot = bars_of(spark, closes, volumes)
    bars = hot.unionByName(bars_of(spark, [4, 5, 6], ticker="B"))
    order = ["ticker", "date"]
    plain = indicators.market_features(bars).orderBy(order).collect()
    blocks = indicators.market_features(bars, block_rows=block_rows)
    blocks = blocks.select(*plain[0].asDict()).orderBy(order).collect()
    assert len(plain) == len(blocks)
    for a, b in zip(plain, blocks):
        assert (a["ticker"], a["date"]) == (b["ticker"], b["date"])
        assert [a[c] for c in indicators.MARKET_FEATURES] == pytest.approx(
            [b[c] for c in indicators.MARKET_FEATURES], rel=1e-9)
    ahead = indicators.forward_return(bars, 3)
    assert sorted(ahead.collect(), key=str) == sorted(
        indicators.forward_return(bars, 3, block_rows=block_rows)
        .select(ahead.columns).collect(), key=str)


def test_temporal_edges(spark):
    times = [None, "2024-01-06 08:00:00", "2024-01-06 09:00:00", "2024-01-05 15:59:59",
             "2024-01-05 16:00:00"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t string")
    out = (df.withColumn("ts", cal.parse_lenient("t")).select("i", *cal.temporal_features("ts"))
           .orderBy("i").collect())
    assert [out[0][c] for c in cal.TEMPORAL_FEATURES] == [0] * 8
    assert [r["market_session"] for r in out] == [0, 0, 1, 1, 2]
    assert out[1]["day_of_week"] == 5 and out[1]["is_weekend"] == 1
    assert out[3]["is_weekend"] == 0


def test_lenient_parsing_and_epoch(spark):
    got = text_values(spark, ["nope", None, "2024-02-30", "2024-02-29T10:00:00"],
                      cal.parse_lenient("t"))
    assert got == [None, None, None, dt.datetime(2024, 2, 29, 10)]
    df = spark.range(1).select(cal.parse_epoch(F.lit(86401)).alias("x"))
    assert df.first()["x"] == dt.datetime(1970, 1, 2, 0, 0, 1)


def test_cleaning(spark):
    raw = ["  Café  chain\tcannot CONFIRM talks ", "don't sell-off 12%!", None, ""]
    assert text_values(spark, raw, tx.normalise_text("t")) == [
        "caf chain cannot confirmtalks", "don't sell-off 12%!", "", ""]
    assert text_values(spark, raw, tx.clean_text("t")) == [
        "caf chain confirmtalks", "dont selloff 12", "", ""]
    assert text_values(spark, ["cannot wanna cannots"], tx.tokenize("t")) == [
        ["can", "not", "wan", "na", "cannots"]]
    assert text_values(spark, ["the a bc stock x gains"],
                       tx.remove_stopwords(tx.split_words("t"))) == [["bc", "gains"]]


def test_punctuation_shortcut_equals_pattern(spark):
    ascii_text = "".join(chr(c) for c in range(1, 128)) * 2
    normal = tx.normalise_text("t")
    a = text_values(spark, [ascii_text], tx.remove_punctuation(normal))
    b = text_values(spark, [ascii_text], F.translate(normal, tx.ASCII_PUNCTUATION, ""))
    assert a == b


def test_lemmas(spark):
    vocabulary = ["bank", "loss", "box", "church", "woman", "company", "men", "leaf", "gas"]
    words = ["banks", "losses", "boxes", "churches", "women", "companies", "men", "leaves",
             "gas", "unknowns"]
    expected = ["bank", "loss", "box", "church", "woman", "company", "men", "leaf", "gas",
                "unknowns"]
    assert text_values(spark, [" ".join(words)],
                       tx.lemmatize(tx.split_words("t"), vocabulary)) == [expected]
    tokens = spark.createDataFrame([(w,) for w in words], "term string")
    vocab = spark.createDataFrame([(w,) for w in vocabulary], "term string")
    table = {r["token"]: r["lemma"] for r in lemmas.lemma_table(tokens, vocab).collect()}
    assert table == dict(zip(words, expected))


def test_lemma_table_by_force(spark):
    """Nulls, repeats, ties of length, tokens that the vocabulary lacks."""
    words = ["men", "women", "man", "ladies", "lady", "losses", "loss", "losse", "gas", "s", "ses",
             "", None, "axes", "ax", "axe", "leaves", "leaf", "plain", "omen", "oman", "a\n", "as\n"]
    for kept in (words[::2], words[1::2], words, []):
        known = {w for w in kept if w is not None}
        expected = {}
        for w in words:
            forms = [w] + [w[:len(w) - len(a)] + b for a, b in lemmas.NOUN_SUFFIXES
                           if w.endswith(a)] if w is not None else []
            hits = [(len(f), i, f) for i, f in enumerate(forms) if f in known]
            expected[w] = min(hits)[2] if hits else w
        vocab = spark.createDataFrame([(w,) for w in kept * 2], "term string")
        for unique, times in ((True, 1), (False, 3)):
            tokens = spark.createDataFrame([(w,) for w in words * times], "term string")
            rows = lemmas.lemma_table(tokens, vocab, unique=unique).collect()
            assert sorted(map(tuple, rows), key=str) == sorted(expected.items(), key=str)


def test_clean_tokens_equal_the_single_steps(spark):
    points = [chr(c) for c in range(1, 0x2070)] + ["\u3000", "\u212a", "\ufeff", "\U0001f600"]
    texts = ["".join(points), " a".join(points), *(f"ab{c}cd {c}cannot{c} x" for c in points[:300]),
             "\x85 \u2003cannot, gon-na\twanna\r\nlemme2 got_ta banks ", "", None, "\x00banks\x00"]
    bare = tx.remove_punctuation(tx.normalise_text("t"))
    single = tx.lemmatize(tx.remove_stopwords(tx.tokenize(bare)))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", single.alias("a"), tx.clean_tokens("t").alias("b"),
                     tx.clean_text("t").alias("c")).collect()
    assert [r["t"] for r in rows if r["a"] != r["b"] or " ".join(r["a"]) != r["c"]] == []


def test_keywords_are_substrings(spark):
    assert text_values(spark, ["Sector talks, INTEREST RATE up"], tx.finance_keywords("t")) == [
        ["interest rate", "sec"]]


def test_ngrams_of_short_texts(spark):
    grams = tx.ngrams(tx.split_words("t"))
    assert text_values(spark, ["", "one", "one two", "aa bb cc"], grams) == [
        [], ["one"], ["one", "two", "one two"],
        ["aa", "bb", "cc", "aa bb", "bb cc", "aa bb cc"]]


def test_term_counts(spark):
    df = spark.createDataFrame([(1, "b a b c b"), (2, ""), (3, "x")], "id int, t string")
    words = df.select("id", tx.split_words("t").alias("w"))
    rows = tx.term_counts(words, "w", ["id"]).collect()
    assert sorted(map(tuple, rows)) == [(1, "a", 1), (1, "b", 3), (1, "c", 1), (3, "x", 1)]


def test_tfidf_by_hand(spark):
    import math

    docs = spark.createDataFrame([(1, "aa aa bb"), (2, "aa cc"), (3, "")], "id int, t string")
    got = {(r["id"], r["term"]): r["weight"] for r in
           vocabulary.tfidf(docs, "t", "id", high=1).collect()}
    assert got == {(1, "aa"): pytest.approx(1.0), (2, "aa"): pytest.approx(1.0)}
    vocab = vocabulary.fit_vocabulary(docs, "t", min_df=1, high=1)
    idf = {r["term"]: r["idf"] for r in vocab.collect()}
    assert idf["aa"] == pytest.approx(math.log(4 / 3) + 1)
    capped = vocabulary.fit_vocabulary(docs, "t", max_terms=1, min_df=1, high=1).collect()
    assert [r["term"] for r in capped] == ["aa"]


def test_hashed_embedding_keeps_empty_rows(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "")], "id int, t string")
    rows = {r["id"]: r["embedding"] for r in embedding.hashed_embedding(df, "t", 16).collect()}
    assert sum(x * x for x in rows[1]) == pytest.approx(1.0, abs=1e-6)
    assert rows[2] == [0.0] * 16


def test_model_embedding_hook(spark):
    def make_predict():
        import numpy as np

        def predict(texts):
            return np.array([[float(len(t)), 1.0] for t in texts], dtype="float32")
        return predict

    df = spark.createDataFrame([(1, "abc"), (2, None)], "id int, t string")
    rows = embedding.model_embedding(df, "t", make_predict).orderBy("id").collect()
    assert [r["embedding"] for r in rows] == [[3.0, 1.0], [0.0, 1.0]]


def test_lexicon_counts_and_polarity(spark):
    texts = ["Profits surge, sector steady", "", None]
    assert text_values(spark, texts, lex.lexicon_count("t", "bullish")) == [2, 0, 0]
    assert text_values(spark, texts, lex.lexicon_count("t", "neutral")) == [2, 0, 0]
    assert text_values(spark, ["surge surge risk", "none here"], lex.polarity("t")) == [
        pytest.approx((0.75 + 0.75 - 0.25) / 3), 0.0]


def test_lexicon_scan_equals_columns(spark):
    """Tables give what literals give, in one block and in many."""
    texts = ["Profits SURGE, surge sector steady", "", None, "sell-off no change risk risk",
             "x\u00a0surge lawsuit\x1cplunge holds", "İstanbul hold"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    names = ["bullish", "bearish", "neutral"]
    expected = df.select("i", *[lex.lexicon_count("t", c).alias(f"{c}_count") for c in names],
                         *[lex.token_hits("t", DEFAULT_LEXICON.terms(c)).alias(f"{c}_tokens")
                           for c in names],
                         lex.polarity("t").alias("polarity"),
                         lex.subjectivity("t").alias("subjectivity")).orderBy("i").collect()
    for size in (lexicon_scan.BLOCK_BYTES, 300):
        got = lexicon_scan.scan(df, "t", DEFAULT_LEXICON.table(spark), block_bytes=size)
        assert got.drop("t").orderBy("i").collect() == expected
    table = DEFAULT_LEXICON.table(spark)
    for make in (features.sentiment_features, heuristic.heuristic_score):
        assert (make(df, "t", lexicon=table).orderBy("i").collect()
                == make(df, "t").orderBy("i").collect())


def test_large_lexicon(spark):
    """20,000 terms: prefixes of each other, multi-word, the empty and the null term."""
    rng = random.Random(7)
    terms = sorted({"".join(rng.choice("abc ") for _ in range(rng.randint(1, 9))).strip()
                    for _ in range(40_000)} - {""})
    while len(terms) < 20_000:
        terms.append(f"t{len(terms)}")
    rows = [(t, rng.choice(["bullish", "bearish", "neutral"]), rng.randint(-8, 8) / 8, 0.5)
            for t in terms] + [("", "bullish", 0.0, 0.0), (None, "bullish", 1.0, 1.0)]
    table = spark.createDataFrame(rows, Lexicon.SCHEMA.fieldNames())
    texts = ["".join(rng.choice("ABc ") for _ in range(300)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for size in (lexicon_scan.BLOCK_BYTES, 400_000):
        got = lexicon_scan.scan(df, "t", table, block_bytes=size).orderBy("i").collect()
        found = lexicon_scan.contained_terms(df, "t", table, block_bytes=size).orderBy("i")
        for text, row, terms_row in zip(texts, got, found.collect()):
            low = text.lower()
            for label in ("bullish", "bearish", "neutral"):
                assert row[f"{label}_count"] == sum(
                    t in low for t, c, *_ in rows if t is not None and c == label)
            weights = {t: p for t, _, p, _ in rows if t}
            hits = [weights[w] for w in low.split() if w in weights]
            assert row["polarity"] == pytest.approx(sum(hits) / len(hits) if hits else 0.0)
            assert terms_row["terms"] == sorted(t for t, *_ in rows if t is not None and t in low)


def test_lemmatize_by_table(spark):
    rng = random.Random(5)
    nouns = [f"noun{i}" for i in range(6000)] + ["lass", "loss", "losse", "woman", "city", "box"]
    table = spark.createDataFrame([(n,) for n in nouns], "term string")
    words = ["losses", "women", "cities", "boxes", "noun17s", "noun5999ses", "plain", None, "box"]
    lists = [[rng.choice(words) for _ in range(6)] for _ in range(10)] + [None, []]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(lists)], "i int, w array<string>")
    expected = df.select("i", tx.lemmatize("w", nouns).alias("w")).orderBy("i").collect()
    for size in (lexicon_scan.BLOCK_BYTES, 100_000):
        got = lexicon_scan.lemmatize(df, "w", table, block_bytes=size)
        assert got.orderBy("i").collect() == expected


def test_valence_rules(spark):
    texts = ["good", "not good", "very good", "good!!", "plain words"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = lex.add_valence(df, "t", "v", {"good": 2.0}).orderBy("i").collect()
    compound = [r["v"]["compound"] for r in out]
    assert compound[0] == pytest.approx(2 / (4 + 15) ** 0.5, abs=1e-4)
    assert compound[1] < 0 < compound[0] < compound[2]
    assert compound[3] > compound[0] and compound[4] == 0
    assert out[4]["v"]["neutral"] == 1.0


def test_valence_capitals_and_contrast(spark):
    """Hand-computed: total / sqrt(total^2 + 15)."""
    cases = {"GOOD day": 2 + 0.733, "GOOD DAY": 2.0, "BAD day": -2 - 0.733,
             "VERY good day": 2 + 0.293 + 0.733, "barely good": 2 - 0.293,
             "good but bad": 2 * 0.5 - 2 * 1.5, "bad day, but a GOOD one": -2 * 0.5 + 2.733 * 1.5,
             "but good": 2 * 1.5,
             # The negation is among the three tokens before either word.
             "not good but bad": 2 * -0.74 * 0.5 - 2 * -0.74 * 1.5}
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    out = lex.add_valence(df, "t", "v", {"good": 2.0, "bad": -2.0}).orderBy("i").collect()
    for row, total in zip(out, cases.values()):
        assert row["v"]["compound"] == pytest.approx(total / (total * total + 15) ** 0.5, abs=1e-4)


def test_argmax_ties_and_requests(spark):
    df = spark.createDataFrame([(0.4, 0.4, 0.2), (0.2, 0.4, 0.4)], "a double, b double, c double")
    assert [r[0] for r in df.select(lab.argmax_class("a", "b", "c")).collect()] == [0, 1]
    texts = ["x" * n for n in (4, 5, 1000, 1001)] + [None]
    assert text_values(spark, texts, tx.valid_headline("t")) == [False, True, True, False, False]


def test_heuristic_clamp_and_sum(spark):
    text = "record beats surge rally profit growth upgrade raised"
    df = spark.createDataFrame([(1, text), (2, "nothing at all"), (3, None)], "id int, title string")
    rows = heuristic.heuristic_score(df).orderBy("id").collect()
    assert rows[0]["prediction"] == "UP" and rows[0]["p_neutral"] == 0
    assert [r["prediction"] for r in rows[1:]] == ["NEUTRAL", "NEUTRAL"]
    for r in rows:
        assert r["p_down"] + r["p_neutral"] + r["p_up"] == pytest.approx(1, abs=2e-4)


def ensemble_rows(spark, rows):
    return spark.createDataFrame(rows, "id int, model string, p_down double, p_neutral double, p_up double")


def test_opposite_gap_rule(spark):
    scores = ensemble_rows(spark, [(1, m, 0.42, 0.10, 0.48) for m in ("a", "b")])
    ruled = ensemble.safety_rules(ensemble.ensemble_vote(scores), min_confidence=0.4).first()
    assert ruled["raw_prediction"] == "UP" and ruled["prediction"] == "NEUTRAL"
    assert ruled["safety_reason"].startswith("UP/DOWN")
    relaxed = ensemble.safety_rules(ensemble.ensemble_vote(scores), safe_mode=False).first()
    assert relaxed["prediction"] == "UP" and not relaxed["safety_applied"]


def test_failed_model_is_skipped(spark):
    scores = ensemble_rows(spark, [(1, "a", 0.1, 0.1, 0.8), (1, "b", None, None, None)])
    voted = ensemble.ensemble_vote(ensemble.ensemble_align(scores)).first()
    assert voted["n_models"] == 1 and voted["agreement_ratio"] == 1.0


def test_absent_class_has_no_auc(spark):
    rows = [(i, i % 2, 0.1 * i, 0.5, 0.3) for i in range(8)]
    df = spark.createDataFrame(rows, "id int, label int, p0 double, p1 double, p2 double")
    auc = metrics.roc_auc_ovr(df, [], {0: "p0", 1: "p1", 2: "p2"})
    values = {r["class"]: r["auc"] for r in auc.collect()}
    assert values[2] is None and values[1] == 0.5
    assert metrics.macro_auc(auc, []).first()["roc_auc_macro"] is None


def test_auc_against_pairs(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 2), *(rng.random() for _ in range(3))) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, label int, p0 double, p1 double, p2 double")
    got = {r["class"]: r["auc"] for r in
           metrics.roc_auc_ovr(df, [], {0: "p0", 1: "p1", 2: "p2"}).collect()}
    for c in range(3):
        pos = [r[2 + c] for r in rows if r[1] == c]
        neg = [r[2 + c] for r in rows if r[1] != c]
        wins = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
        assert got[c] == pytest.approx(wins / (len(pos) * len(neg)))


def test_split_is_stratified_and_repeatable(spark):
    df = spark.range(1003).select("id", (F.col("id") % 3).cast("int").alias("label"))
    first = splits.stratified_split(df, "label", "id").collect()
    again = splits.stratified_split(df.repartition(5), "label", "id").collect()
    chosen = {r["id"] for r in first if r["is_test"]}
    assert chosen == {r["id"] for r in again if r["is_test"]} and len(first) == 1003
    assert len(chosen) == 201
    per_class = [sum(1 for r in first if r["is_test"] and r["label"] == c) for c in range(3)]
    assert max(per_class) - min(per_class) <= 1
    assert splits.test_share(2000, 100) == 0.2 and splits.test_share(10, 100) == 0.1


def test_folds_are_even(spark):
    df = spark.range(500).select("id", F.when(F.col("id") < 400, 0).otherwise(1).alias("label"))
    rows = splits.stratified_folds(df, "label", "id").groupBy("label", "fold").count().collect()
    assert {(r["label"], r["count"]) for r in rows} == {(0, 80), (1, 20)}


def test_untagged_counts_equal_pairs(spark):
    rng = random.Random(5)
    bars = bars_of(spark, [rng.randint(1, 9) for _ in range(6)])
    bars = bars.unionByName(bars_of(spark, [rng.randint(1, 9) for _ in range(6)], ticker="B"))
    feed = spark.createDataFrame(
        [(i, "X", f"2024-01-0{rng.randint(1, 9)} 10:00:00") for i in range(60)] + [(99, "X", None)],
        "id int, ticker string, published_at string")
    pairs = (align.align_untagged_news(feed, bars).groupBy("ticker", "date", "label")
             .agg(F.count("*").alias("n_news")))
    counts = align.align_untagged_counts(feed, bars).select(pairs.columns)
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, counts.collect()))


def test_resolve_columns_and_headers(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Date long, AdjClose long, Close_A long")
    assert prices.resolve_columns(df).columns == ["date", "close"]
    with pytest.raises(KeyError):
        prices.resolve_columns(df.select("Date"))
    feed = spark.createDataFrame([(None, "h", "b", "x")],
                                 "title string, Headline string, body string, Extra string")
    out = news.canonical_news(feed)
    assert out.columns == ["title", "description", "Extra"] and out.first()["title"] == "h"
    assert prices.period_days("1y") == 365 and prices.period_days("?") == 30


def test_daily_series_payload(spark):
    body = ('{"Time Series (Daily)": {"2024-01-03": {"1. open": "1.5", "4. close": "x"}, '
            '"2024-01-02": {"4. close": "2"}}}')
    df = spark.createDataFrame([(body,)], "body string")
    rows = prices.flatten_daily_series(df, "body", ["open", "close"]).orderBy("date").collect()
    assert [tuple(r) for r in rows] == [(dt.date(2024, 1, 2), None, 2.0),
                                        (dt.date(2024, 1, 3), 1.5, None)]


# --- dates, unions and repeated ids ----------------------------------------------------------

@pytest.mark.parametrize("text, expected", [
    ("2024-01-05", "2024-01-05 00:00:00"), ("2024-01-05T10:20:30", "2024-01-05 10:20:30"),
    ("Jan 5, 2024", "2024-01-05 00:00:00"), ("January 5, 2024 10:20", "2024-01-05 10:20:00"),
    ("01/05/2024", "2024-01-05 00:00:00"), ("2024/01/05 10:20:30", "2024-01-05 10:20:30"),
    ("Fri, 05 Jan 2024 10:00:00 GMT", "2024-01-05 10:00:00"),
    ("5 Jan 2024", "2024-01-05 00:00:00"),
    ("2024-01-05T23:30:00-05:00", "2024-01-06 04:30:00"),
    ("2024-01-05T01:15:00+05:30", "2024-01-04 19:45:00"),
    ("2024-01-05T23:30:00Z", "2024-01-05 23:30:00"), ("", None), ("n/a", None), (None, None),
    ("13/45/2024", None)])
def test_lenient_dates(spark, text, expected):
    df = spark.createDataFrame([(text,)], "raw string")
    got = df.select(cal.parse_lenient("raw").alias("t"), cal.unparsed("raw").over(
        Window.partitionBy(F.lit(0))).alias("bad")).first()
    assert got["t"] == (expected and dt.datetime.fromisoformat(expected))
    assert got["bad"] == (text is not None and text != "" and expected is None)


def test_lenient_dates_equal_each_format(spark):
    """The guarded formats accept what the listed ones accept, each by itself."""
    days = ["Jan 5, 2024", "january 5, 2024", "May 05, 2024", "Jan  5, 2024", "5 Jan 2024", "x 1 2",
            "05 March 2024", "1/5/2024", "01/05/2024", "2024/01/05", "2024/1/5", "20240105",
            "-20240105", "Feb 30, 2024", "Jan 5, +12024", "unknown", "7", ""]
    clocks = ["", " 10:20", " 10:20:30", " 2:30 PM", " 02:30 am", " 12:00 AM", " 13:30 PM", " 2:30",
              " 10:20:30 PM", " 10:20 10:20", " 25:00", " 2:30 xx", " 10:20:30.5"]
    df = spark.createDataFrame([(d + c,) for d in days for c in clocks], "t string")
    each = [F.try_to_timestamp("t", F.lit(day + clock)).cast("timestamp_ntz")
            for day in cal.DAY_FORMATS for clock in cal.CLOCK_FORMATS]
    expected = F.coalesce(F.col("t").try_cast("timestamp_ntz"), *each)
    rows = df.select("t", cal.parse_lenient("t").cast("string").alias("got"),
                     expected.cast("string").alias("all")).collect()
    assert [r for r in rows if r["got"] != r["all"]] == []
    assert sum(r["got"] is not None for r in rows) > 50


def test_articles_with_missing_dates_align(spark):
    body = '{"articles": [{"title": "a", "publishedAt": "2024-01-02T10:00:00Z"}, {"title": "b"}]}'
    articles = news.flatten_articles(spark.createDataFrame([(body,)], "v string"), F.col("v"))
    assert dict(articles.dtypes)["published_at"] == "timestamp_ntz"
    bars = spark.createDataFrame(
        [("x", DAY + dt.timedelta(days=1), 100), ("x", DAY + dt.timedelta(days=2), 105)],
        "ticker string, date date, close long")
    rows = align.align_untagged_news(articles, bars).collect()
    assert [(r["title"], r["label"]) for r in rows] == [("a", 2)]
    company = spark.createDataFrame(
        [('[{"headline": "c", "datetime": 1704189600}]', 7)], "v string, ticker int")
    both = news.union_news(articles, news.flatten_company_news(company, F.col("v"), "ticker"),
                           spark.createDataFrame([("d", "01/02/2024")],
                                                 "title string, published_at string"))
    assert {r["title"]: str(r["published_at"]) for r in both.collect()} == {
        "a": "2024-01-02 10:00:00", "b": "None", "c": "2024-01-02 10:00:00",
        "d": "2024-01-02 00:00:00"}


def test_split_keeps_null_labels(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 10 != 0, F.col("id") % 3)
                                  .alias("label"))
    out = splits.stratified_split(df, "label", "id")
    assert out.columns == ["id", "label", "is_test"]
    sizes = {r["label"]: (r["n"], r["t"]) for r in out.groupBy("label").agg(
        F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert sizes == {None: (100, 20), 0: (300, 60), 1: (300, 60), 2: (300, 60)}


def test_repeated_ids_have_their_own_norms(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (1, "alpha beta"), (2, "beta gamma")],
                                 "id long, clean_text string")
    vocab = vocabulary.fit_vocabulary(docs, "clean_text", min_df=1)
    weights = vocabulary.tfidf_transform(docs, vocab, "clean_text", "id")
    norms = weights.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert {r["id"]: round(r["n"], 9) for r in norms} == {1: 2.0, 2: 1.0}
    matrix = headline_model.feature_matrix(docs, vocab)
    rows = matrix.collect()
    assert len(rows) == 3 and len({str(r["features"]) for r in rows if r["id"] == 1}) == 1


def test_vector_stats_cover_every_position(spark):
    df = spark.createDataFrame([([1.0] * 70,), ([3.0] * 70,)], "x array<double>")
    stats = standardise.vector_stats(df, "x").collect()
    assert len(stats) == 70 and all((r["mean"], r["std"]) == (2.0, 1.0) for r in stats)


def test_sentiment_in_batches_equals_expressions(spark, monkeypatch):
    """Words, capitals, negation, contrast, edges and terms with a space, over cut batches."""
    monkeypatch.setattr(token_arrays, "PART_WORDS", 5)
    texts = ["VERY strong but NOT a surge!", "SURGE", "'Weak' sell-off; no change?? risk!!!!!",
             "never ever barely risk, but fraud BUT growth", "", None, "  ", "... !",
             "Don't  fall’s ÉCU losses\n(record)", "no\tchange in-line"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").coalesce(2)
    for lexicon in (DEFAULT_LEXICON, Lexicon((("", "bullish", 0.5, 0.5), ("risk", "bearish", 0.1, 0.3),
                                              ("risk", "neutral", 0.2, 0.7)))):
        one, two = (f(df, "t", lexicon=lexicon) for f in (
            features.sentiment_features, features.sentiment_in_batches))
        assert one.dtypes == two.dtypes
        assert one.orderBy("id").collect() == two.orderBy("id").collect()


def test_term_vectors_over_cut_batches(spark, monkeypatch):
    """N-grams stay inside their rows; unknown prefixes and rows without words count nothing."""
    monkeypatch.setattr(token_arrays, "PART_WORDS", 3)
    docs = spark.createDataFrame(
        [(1, "aa bb cc aa bb"), (2, "bb cc"), (3, None), (4, ""), (5, "dd aa bb cc x"), (5, "zz")],
        "id int, t string").coalesce(1)
    vocab = spark.createDataFrame([("aa bb cc", 2.0), ("bb", 3.0), ("bb cc", 1.5), ("cc aa", 1.0),
                                   ("a b c d", 1.0)], "term string, idf double")
    rows = PipelineModel(headline_model.text_stages(vocab, "t", embedding="e", size=7)[0]
                         ).transform(docs).collect()
    place = {"aa bb cc": 1, "bb": 2, "bb cc": 3, "cc aa": 4}
    expected = {1: {"aa bb cc": 2.0, "bb": 3 * (1 + math.log(2)), "bb cc": 1.5, "cc aa": 1.0},
                2: {"bb": 3.0, "bb cc": 1.5}, 5: {"aa bb cc": 2.0, "bb": 3.0, "bb cc": 1.5}}
    for r in rows:
        raw = expected.get(r["id"], {}) if r["t"] != "zz" else {}
        length = math.sqrt(sum(x * x for x in raw.values()))
        assert dict(zip(r["tfidf"].indices.tolist(), r["tfidf"].values)) == pytest.approx(
            {place[t]: x / length for t, x in raw.items()})
        assert r["tfidf"].size == 5 and r["e"].size == 7
    buckets = {r["id"]: r["b"] for r in embedding.hashed_counts(docs, "t", "b", 7).collect()
               if r["t"] != "zz"}
    for r in rows:
        if r["t"] != "zz":
            assert r["e"].indices.tolist() == [b["bucket"] for b in buckets[r["id"]]]
    found = vocabulary.text_statistics(docs, "t", 2, 3).collect()
    assert {r["term"]: (r["df"], r["ctf"]) for r in found} == {
        "aa bb": (2, 3), "bb cc": (3, 3), "cc aa": (1, 1), "dd aa": (1, 1), "aa bb cc": (2, 2),
        "bb cc aa": (1, 1), "cc aa bb": (1, 1), "dd aa bb": (1, 1)}
