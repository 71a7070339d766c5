"""Views the registered queries run on, derived by Spark from the given tables.

Prices are integer cents, so window averages are exact and engines agree bit for bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.lexicons import Lexicon
from marketlens.operators.ensemble import with_model_class

# Opening phrases of the headline view, by event_id % 10; the rest of a headline is the first
# turn of a conversation.
PHRASES = [
    "Shares SURGE 12% after record profit, raising outlook!",
    "Chipmaker beats estimates; revenue growth accelerates",
    "Retailer’s shares plunge on weak demand — losses widen",
    "Regulators open fraud probe; lawsuit risk rises",
    "Board keeps guidance unchanged, results in-line",
    "Café chain cannot confirm merger talks with  rival",
    "Fed holds interest rate steady as sector waits",
    "Profit warning: margins fall while sales climb",
    "Weather turns mild over the weekend",
    "Dividend raised and buyback doubled; analysts upgrade",
]

# Frequent tokens of the document corpus with weights in eighths, so that lexicon queries on
# `documents` have hits of every class.
CORPUS_LEXICON = Lexicon(tuple(
    (term, label, weight, subjectivity)
    for label, weight, subjectivity, terms in [
        ("bullish", 0.5, 0.5, "the and les une"), ("bullish", 0.25, 0.125, "que los das"),
        ("bearish", -0.75, 0.625, "der el in"), ("bearish", -0.125, 0.25, "und le to a"),
        ("neutral", 0.0, 0.125, "de la of est ion")]
    for term in terms.split()))
CORPUS_VALENCE = {"the": 1.5, "les": 2.0, "der": -1.5, "el": -2.5, "und": 0.5, "de": -0.5,
                  "la": 1.0}

#: Model k looks at the k-th quarter of a headline's vector; the larger the sharpness, the
#: surer it is of the nearest centroid.
SHARPNESS = {"m1": 10.0, "m2": 40.0, "m3": 160.0, "m4": 640.0}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Share CPU-heavy row work evenly among all cores, however the rows lie in their files.

    The number of file splits says little about it: rows come with the split that holds their
    row group, so a file of one large row group feeds one task and leaves the others empty, and
    a join's output sits in as few partitions as its bytes need. The rows are therefore always
    dealt by the hash of their id, over a fixed number of partitions; rows that are grouped
    next are dealt by the group, so that they need no second exchange.
    """
    spark = df.sparkSession
    slots = spark.sparkContext.defaultParallelism
    return df.repartition(max(2 * slots, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", *more), "doc_id")


def _bars(ticks: DataFrame) -> DataFrame:
    """First, highest, lowest, last price and volume per (ticker, date).

    Plain aggregates combine map-side, so a hot instrument-day never meets in one task.
    """
    return ticks.groupBy("ticker", "date").agg(
        F.min_by("c", "at").alias("open"), F.max("c").alias("high"), F.min("c").alias("low"),
        F.max_by("c", "at").alias("close"), F.sum("q").alias("volume"))


def _cents(price: str) -> Column:
    return F.round(F.col(price) * 100).cast("long")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long price history: one row per supplier and ship day."""
    return _bars(table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date"),
        _cents("l_extendedprice").alias("c"), F.col("l_quantity").cast("long").alias("q"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
        .alias("at")))


def ticks_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars that share instruments and dates with `headlines`."""
    return _bars(table(spark, sf_dir, "events").select(
        F.col("user_id").alias("ticker"), F.to_date("ts").alias("date"),
        _cents("value").alias("c"), F.lit(1).cast("long").alias("q"),
        F.struct("ts", "event_id").alias("at")))


def headlines_from(events: DataFrame, sf_dir: str) -> DataFrame:
    """A headline per event, also of a stream: a phrase and a conversation's first turn."""
    turns = table(events.sparkSession, sf_dir, "conversations")
    n = turns.agg(F.max("conv_id")).first()[0] + 1
    texts = turns.where("turn = 0").select(F.col("conv_id").alias("_conv"), "text")
    phrase = F.element_at(F.array(*[F.lit(t) for t in PHRASES]),
                          (F.col("event_id") % 10 + 1).cast("int"))
    joined = events.withColumn("_conv", F.col("event_id") % n).join(texts, "_conv", "left")
    return joined.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("ticker"),
        F.col("ts").alias("published_at"), F.concat_ws(" ", phrase, "text").alias("title"))


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headlines_from(table(spark, sf_dir, "events"), sf_dir)


def spread_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows for CPU-heavy work, dealt to all cores."""
    return spread(headlines(spark, sf_dir), "id")


def hash_of(key: Column | str) -> Column:
    """H(k): first 8 hex digits of md5(k || '|' || id)."""
    key = F.lit(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(key, F.lit("|"), F.col("id").cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _vector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, model, p_down, p_neutral, p_up) of four nearest-centroid models.

    A model weighs every label's centroid by exp(-sharpness d^2), d the distance in its quarter
    of the vector; a class has the weights of the labels that fall on it modulo three.
    """
    raw = table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    width = len(raw.select("x").first()[0])
    means = raw.groupBy("label").agg(
        F.array(*[F.avg(F.get("x", F.lit(i))) for i in range(width)]).alias("mean"))
    # One row per label of the table.
    centroids = means.agg(F.array_sort(F.collect_list(F.struct("label", "mean")))).scalar()
    rows = raw.select("vec_id", "x", F.inline(centroids))
    parts = []
    for k, (model, sharpness) in enumerate(SHARPNESS.items()):
        cut = [F.slice(c, k * width // 4 + 1, width // 4) for c in ("x", "mean")]
        square = F.aggregate(F.zip_with(*cut, lambda a, b: (a - b) * (a - b)), F.lit(0.0),
                             lambda total, v: total + v)
        parts.append(F.struct(F.lit(model).alias("model"),
                              F.exp(-square * sharpness).alias("w")))
    each = rows.select("vec_id", "label", F.inline(F.array(*parts)))
    return each.groupBy("vec_id", "model").agg(*[
        (F.sum(F.when(F.col("label") % 3 == c, F.col("w")).otherwise(0.0)) / F.sum("w")).alias(p)
        for c, p in enumerate(["p_down", "p_neutral", "p_up"])])


def _by_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vec_id) of headlines: vectors are dealt to them in turn."""
    n = table(spark, sf_dir, "embeddings").count()
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), (F.col("event_id") % n).alias("vec_id"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, model, p_down, p_neutral, p_up)."""
    return _by_vector(spark, sf_dir).join(_vector_scores(spark, sf_dir), "vec_id").select(
        "id", "model", "p_down", "p_neutral", "p_up")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label): actual class of a headline, that of its vector."""
    labels = table(spark, sf_dir, "embeddings").select(
        "vec_id", (F.col("label") % 3).cast("int").alias("label"))
    return _by_vector(spark, sf_dir).join(labels, "vec_id").select("id", "label")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounded scores with predicted and actual class."""
    labels = table(spark, sf_dir, "embeddings").select(
        "vec_id", (F.col("label") % 3).cast("int").alias("label"))
    known = _by_vector(spark, sf_dir).join(
        _vector_scores(spark, sf_dir).join(labels, "vec_id"), "vec_id")
    return with_model_class(known.select(
        "id", "model", "p_down", "p_neutral", "p_up", "label"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labeled vectors for model jobs: (id, label in 0..2, features, x)."""
    from pyspark.ml.functions import array_to_vector

    raw = table(spark, sf_dir, "embeddings")
    x = F.col("embedding").cast("array<double>")
    return raw.select(F.col("vec_id").alias("id"), (F.col("label") % 3).alias("label"),
                      array_to_vector(x).alias("features"), x.alias("x"))


def printable(df: DataFrame) -> DataFrame:
    """Fix output types for comparison: dates and times as text, integers as bigint."""
    def convert(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        return c.alias(field.name)

    return df.select(*[convert(f) for f in df.schema.fields])


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})
