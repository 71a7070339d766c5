"""Plan shapes that keep the queries scalable, and stream behaviour."""

import datetime as dt
import os
from collections import Counter

from pyspark.sql import functions as F

from marketlens.functions import calendar, lexicon, text
from marketlens.lexicons import DEFAULT_LEXICON
from marketlens.operators import (
    align, embedding, estimators, headline_model, heuristic, indicators, lexicon_scan, metrics,
    vocabulary)
from marketlens.plans import flow_queries, learn_queries, tables, text_queries
from marketlens.sources import prices, sinks
from marketlens.sources.workspace import new_path, shared_folder
from marketlens.streaming import streams


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_indicators_share_one_shuffle_and_sort(spark, sf_dir):
    bars = spark.read.parquet(_write_bars(spark, sf_dir))
    plan = plan_of(indicators.market_features(bars))
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 1


def _write_bars(spark, sf_dir):
    path = new_path(spark, "plan-bars")
    tables.bars(spark, sf_dir).write.parquet(path)
    return path


def test_slice_reaches_the_scan(spark, sf_dir):
    path = _write_bars(spark, sf_dir)
    cut = prices.ohlcv_history(spark.read.parquet(path), 3, "1997-01-01", "1998-01-01")
    plan = plan_of(cut.select("date", "close"))
    assert "PushedFilters: [IsNotNull(ticker), IsNotNull(date), EqualTo(ticker,3)" in plan
    assert "volume" not in plan.split("ReadSchema")[1]
    by_ticker = new_path(spark, "bars-by-ticker")
    sinks.write_bars(spark.read.parquet(path), by_ticker)
    pruned = plan_of(prices.ohlcv_history(spark.read.parquet(by_ticker), 3))
    assert "PartitionFilters: [isnotnull(ticker" in pruned


def test_term_counting_does_not_shuffle(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert "Exchange" not in plan_of(vocabulary.document_terms(docs, "text", ["doc_id"]))


def test_rows_of_one_split_reach_all_cores(spark):
    """A file of one row group gives many splits, all but one of them empty."""
    crowded = spark.range(0, 4000, 1, 16).where("id < 250")
    per_task = tables.spread(crowded, "id").rdd.glom().map(len).collect()
    assert sum(per_task) == 250 and max(per_task) < 50


def test_training_rows_reach_all_cores(spark, sf_dir):
    per_task = learn_queries._news(spark, sf_dir).rdd.glom().map(len).collect()
    assert max(per_task) < sum(per_task) / 4


def test_row_work_is_done_once(spark):
    """No text is lower-cased, cut or searched by pattern again for every term or word."""
    df = spark.createDataFrame([(1, "Not GOOD?! But 'good'")], "id int, t string")
    assert "contains(lower" not in plan_of(df.select(text.finance_keywords("t"))).lower()
    assert "regexp_replace" not in plan_of(df.select(lexicon.emphasis("t")))
    assert "sort_array(transform(" in plan_of(embedding.hashed_counts(df, "t", "b"))
    assert plan_of(heuristic.heuristic_score(df, "t")).count("split(") == 1
    assert "MapInArrow" in plan_of(vocabulary.document_terms(df, "t", ["id"]))
    assert "_words" not in plan_of(lexicon_scan.scan(df, "t", DEFAULT_LEXICON))


def test_terms_of_many_rows_leave_in_parts(spark, monkeypatch):
    monkeypatch.setattr(vocabulary, "BATCH_TERMS", 4)
    df = spark.createDataFrame([(1, "aa bb aa"), (1, "aa bb aa"), (None, None), (2, "cc x \u00e9\u00e9")],
                               "id int, t string")
    rows = vocabulary.document_terms(df, "t", ["id"], 1, 2).collect()
    once = [(1, "aa", 2), (1, "aa bb", 1), (1, "bb", 1), (1, "bb aa", 1)]
    assert sorted(map(tuple, rows)) == sorted(
        [*once, *once, (2, "cc", 1), (2, "\u00e9\u00e9", 1), (2, "cc \u00e9\u00e9", 1)])


def test_lemmas_shuffle_no_pair_of_document_and_term(spark, sf_dir):
    assert "doc_id" not in plan_of(text_queries.lemmatize(spark, sf_dir))


def test_only_inflected_tokens_are_shuffled(spark, sf_dir):
    """Once to meet the vocabulary, once to choose; the text is cut by two patterns and a split."""
    plan = plan_of(text_queries.lemmatize(spark, sf_dir))
    assert plan.count("Exchange hashpartitioning(token") == 1 and "SortAggregate" not in plan
    df = spark.createDataFrame([("a",)], "t string")
    cleaning = plan_of(df.select(text.clean_text("t").alias("c")))
    assert cleaning.count("regexp_replace(") == 2 and "translate(" not in cleaning


def test_payloads_are_collected_after_one_exchange(spark, sf_dir):
    """No task collects the pages of rows that another task shares them with."""
    plan = plan_of(flow_queries._company_news(spark, sf_dir))
    assert "partial_collect_list" in plan.split("Exchange hashpartitioning(ticker")[0]
    assert "hashpartitioning(id" not in plan


def test_times_are_tried_by_shape(spark):
    """One try per day format, in a lambda, and only on text of its shape."""
    df = spark.createDataFrame([("unknown",)], "t string")
    plan = plan_of(df.select(calendar.parse_lenient("t")))
    assert plan.lower().count("gettimestamp") <= len(calendar.DAY_FORMATS)
    assert "lambda" in plan


def test_hot_key_join_keeps_all_rows(spark):
    """A third of the news on one instrument and day."""
    news = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("ticker"),
        F.lit("2024-01-02 10:00:00").cast("timestamp_ntz").alias("published_at"))
    bars = spark.range(50).select(
        F.col("id").alias("ticker"), F.explode(F.sequence(
            F.lit("2024-01-01").cast("date"), F.lit("2024-01-04").cast("date"))).alias("date"),
        F.lit(100).alias("close"))
    assert align.align_news_prices(news, bars).count() == 3000


def test_workspace_is_local_only_without_setting(spark):
    assert shared_folder(spark) == shared_folder(spark)
    assert new_path(spark, "a") != new_path(spark, "a")


def test_stream_resumes_without_duplicates(spark, sf_dir):
    """A second run over the same folder adds nothing; new files are scored once."""
    folder, out = new_path(spark, "feed"), new_path(spark, "scored")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    half = F.col("event_id") % 2 == 0
    events.where(half).write.mode("append").parquet(folder)

    def run():
        stream = tables.headlines_from(
            spark.readStream.schema(events.schema).parquet(folder), sf_dir)
        scored = streams.stream_score(stream).select("id", "prediction")
        streams.write_append(scored, out, f"{out}-checkpoint").awaitTermination()
        return spark.read.parquet(out).count()

    first = run()
    assert run() == first
    events.where(~half).write.mode("append").parquet(folder)
    assert run() == tables.headlines_from(events, sf_dir).count()
    assert spark.read.parquet(out).select("id").distinct().count() == run()


def test_watermarked_timeline_appends(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = tables.headlines_from(
        streams.read_table_stream(spark, sf_dir, "events.parquet", schema), sf_dir)
    scored = streams.stream_score(stream).withColumn("ts", F.col("published_at").cast("timestamp"))
    timeline = streams.stream_timeline(scored, every="1 day")
    out = streams.run_to_table(timeline, new_path(spark, "timeline"))
    batch = tables.headlines(spark, sf_dir).select(F.to_date("published_at").alias("d")).distinct()
    days = out.count()
    assert 0 < days <= batch.count()


def test_timeline_frees_state(spark, sf_dir):
    """Days that the watermark has passed leave the state; late rows do not reopen them."""
    folder = new_path(spark, "days")
    start = "2024-01-01 00:00:00"
    for day in range(4):
        spark.range(48).select(
            (F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(
                F.lit(day), F.col("id") % 24)).alias("published_at"),
            F.lit("Shares surge").alias("title"), (F.col("id") % 3).alias("ticker"),
        ).coalesce(1).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    scored = streams.stream_score(stream).withColumn("ts", F.col("published_at").cast("timestamp"))
    timeline = streams.stream_timeline(scored, every="1 hour", keys=["ticker"])
    out = new_path(spark, "days-out")
    query = streams.write_append(timeline, out, f"{out}-checkpoint")
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress
            if p["stateOperators"]]
    assert max(held) < 4 * 24 and held[-1] < 24
    written = spark.read.parquet(out)
    assert written.count() == written.select("window_start", "ticker").distinct().count()
    assert written.agg(F.sum("n")).first()[0] + 2 * held[-1] >= 4 * 48 - 2 * 3 * 2


def test_late_bar_meets_its_headline(spark):
    """The bar's file arrives in a later run than the headline's."""
    news, bars, out = (new_path(spark, n) for n in ("late-news", "late-bars", "late-out"))
    spark.sql("SELECT 1 AS id, 'A' AS ticker, timestamp_ntz'2024-01-02 10:00:00' AS published_at "
              "UNION ALL SELECT 2, 'B', timestamp_ntz'2024-01-02 11:00:00'").write.parquet(news)
    one = ("SELECT '{}' AS ticker, date'2024-01-02' AS date, 2 AS label, "
           "timestamp'2024-01-03 00:00:00' AS known_at")
    spark.sql(one.format("A")).write.parquet(bars)

    def run():
        joined = streams.stream_align_late(
            spark.readStream.schema(spark.read.parquet(news).schema).parquet(news),
            spark.readStream.schema(spark.read.parquet(bars).schema).parquet(bars))
        streams.write_append(joined.select("id", "label"), out,
                             f"{out}-checkpoint").awaitTermination()
        return sorted(r["id"] for r in spark.read.parquet(out).collect())

    assert run() == [1]
    spark.sql(one.format("B")).write.mode("append").parquet(bars)
    assert run() == [1, 2]


def test_roc_buckets_are_even_on_skewed_scores(spark):
    df = spark.range(4000).select(
        F.lit("m").alias("model"), (F.col("id") % 2).cast("int").alias("label"),
        (F.pow(F.col("id") / 4000.0, 8) / 1000).alias("p"))
    counts = metrics.score_counts(df, ["model"], {1: "p"})
    placed = metrics._bucketed(counts, ["model", "class"], 64)
    most = placed.groupBy("_bucket").count().agg(F.max("count")).first()[0]
    assert most <= 2 * 4000 / 64


def test_training_rows_are_made_once(spark, sf_dir):
    """The joins behind the training rows run once, not once per pass over them."""
    rows = tables.headlines(spark, sf_dir).limit(300).select(
        "id", "title", "published_at", (F.col("id") % 3).cast("int").alias("label"))
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    _, kept = headline_model.fit_front(rows.mapInArrow(watched, rows.schema))
    assert kept.count() == 300 and seen.value == 300


def test_term_totals_leave_in_parts(spark, monkeypatch):
    monkeypatch.setattr(vocabulary, "BATCH_TERMS", 4)
    df = spark.createDataFrame([("aa bb aa",), ("aa bb aa",), (None,), ("cc x éé aa",)], "t string")
    found = vocabulary.text_statistics(df, "t", 1, 2)
    counted = vocabulary.term_statistics(vocabulary.document_terms(df, "t", [], 1, 2))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, counted.collect()))


def test_folders_do_not_grow_with_instruments(spark):
    rows = spark.range(3000).select(
        (F.col("id") % 1500).alias("ticker"), F.lit("2024-01-02").cast("date").alias("date"),
        F.col("id").alias("close")).unionByName(spark.sql(
            "SELECT CAST(NULL AS bigint) AS ticker, date'2024-01-02' AS date, -1L AS close"))
    path = new_path(spark, "shared-bars")
    sinks.write_bars(rows, path, shared=True)
    assert len([f for f in os.listdir(path) if "=" in f]) <= sinks.BAR_FOLDERS + 1
    back = prices.read_bars(spark, path)
    assert back.count() == 3001
    cut = prices.ohlcv_history(back, 7)
    assert sorted(map(tuple, cut.select("ticker", "close").collect())) == [(7, 7), (7, 1507)]
    assert f"PartitionFilters: [isnotnull({sinks.BAR_FOLDER}" in plan_of(cut)


def test_history_query_writes_a_bounded_number_of_folders(spark, sf_dir, monkeypatch):
    made = []
    monkeypatch.setattr(flow_queries, "new_path",
                        lambda s, n: made.append(new_path(s, n)) or made[-1])
    monkeypatch.setattr(sinks, "BAR_FOLDERS", 3)
    assert flow_queries.src_ohlcv_history(spark, sf_dir).count() > 0
    assert len([f for f in os.listdir(made[0]) if "=" in f]) <= 3


def test_class_weights_come_to_the_rows(spark):
    """The logistic fit must not deal its rows by label: that is three tasks at any size."""
    rows = spark.range(100).select((F.col("id") % 3).cast("int").alias("label"), "id")
    plan = plan_of(estimators.balanced(rows, in_place=True))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted(map(tuple, estimators.balanced(rows, in_place=True).collect())) == sorted(
        map(tuple, estimators.balanced(rows).collect()))


def news_tables(spark, folder, repeated):
    """Events of three users on twelve days, some of them twice, and conversations."""
    rows = [(i, dt.datetime(2024, 1, 1 + i // 6, i % 24), i % 3, 10.0 + i * i % 17)
            for i in range(72)]
    rows += [rows[i] for i in repeated]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double") \
        .write.parquet(f"{folder}/events.parquet")
    spark.createDataFrame([(i, 0, t) for i, t in enumerate(["strong growth", "weak sales", ""])],
                          "conv_id long, turn int, text string") \
        .write.parquet(f"{folder}/conversations.parquet")
    return folder


def test_sink_model_scores_rows_in_place(spark, tmp_path):
    """Vectors are not shuffled to meet by id; rows of a repeated id meet all with all."""
    df = learn_queries.sink_model(spark, news_tables(spark, str(tmp_path), [5]))
    assert "LeftAnti" in plan_of(df)
    rows = df.collect()
    assert all(r["same_scores"] and r["same_features"] for r in rows)
    assert Counter(r["id"] for r in rows) == {**{i: 1 for i in range(72)}, 5: 16}


def test_feature_matrix_reads_stored_rows(spark, tmp_path):
    df = learn_queries.feature_matrix(spark, news_tables(spark, str(tmp_path), []))
    plan = plan_of(df)
    assert "Join" not in plan and "Window" not in plan and "Exchange" not in plan
    assert df.count() > 20
