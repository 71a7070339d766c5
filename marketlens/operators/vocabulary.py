"""Term statistics, vocabulary selection and TF-IDF weights.

Counting inside a document happens in the row (`term_counts`), so the only shuffle is that of
the per-term totals (pre-aggregated map-side). A vocabulary without a cap is joined, and the
weights of a document are then regrouped.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens import params
from marketlens.functions.text import adjacent, null_text_to_empty
from marketlens.functions.vectors import sparse_parts, sparse_vector
from marketlens.operators import token_arrays
from marketlens.sources.workspace import new_path


def scoring_tokens(text: str) -> Column:
    """Lower-cased runs of two or more word characters."""
    lowered = F.lower(null_text_to_empty(text))
    # The plain classes mean the same in ASCII text and are looked up much faster.
    ascii_only = F.octet_length(lowered) == F.length(lowered)
    return F.when(ascii_only, F.regexp_extract_all(lowered, F.lit(r"\b\w\w+\b"), F.lit(0))) \
        .otherwise(F.regexp_extract_all(lowered, F.lit(r"(?U)\b\w\w+\b"), F.lit(0)))


#: About as many (row, n-gram) pairs leave a worker at a time.
BATCH_TERMS = 1 << 16


def document_terms(docs: DataFrame, text: str, keep: list[str],
                   low: int = params.NGRAM_MIN, high: int = params.NGRAM_MAX) -> DataFrame:
    """One row per (document, n-gram) with its count; no shuffle.

    A row's n-grams are counted in one hash table by a small Arrow function: sorting them and
    measuring runs inside the row costs several times as much.
    """
    tokens = docs.select(*keep, scoring_tokens(text).alias("_tokens"))
    schema = T.StructType([*tokens.schema.fields[:-1], T.StructField("term", T.StringType()),
                           T.StructField("tf", T.LongType())])
    n = len(keep)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, terms, counts = [], [], []
            for i, words in enumerate(batch.column(n)):
                words, grams = words.as_py(), Counter()
                for size in range(low, high + 1):
                    grams.update(words if size == 1 else
                                 map(" ".join, zip(*(words[k:] for k in range(size)))))
                rows += [i] * len(grams)
                terms += grams
                counts += grams.values()
                if len(rows) >= BATCH_TERMS or i + 1 == batch.num_rows:
                    kept = [batch.column(c).take(pa.array(rows, pa.int32())) for c in range(n)]
                    yield pa.RecordBatch.from_arrays(
                        [*kept, pa.array(terms, pa.string()), pa.array(counts, pa.int64())],
                        schema.names)
                    rows, terms, counts = [], [], []

    return tokens.mapInArrow(counted, schema)


def term_statistics(terms: DataFrame) -> DataFrame:
    """Document frequency and corpus frequency per term, in one aggregation."""
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ctf"))


def text_statistics(docs: DataFrame, text: str, low: int = params.NGRAM_MIN,
                    high: int = params.NGRAM_MAX) -> DataFrame:
    """`term_statistics` of the n-grams of `docs`, counted over many rows before they leave a
    worker: no row per pair of document and n-gram is made."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in token_arrays.parts(batch):
                words = token_arrays.words_of(part.column(0))
                for row, gram, terms in token_arrays.grams(words, low, high):
                    n = len(terms)
                    once = token_arrays.count_pairs(row, gram, n)[1]
                    yield pa.RecordBatch.from_arrays(
                        [terms, pa.array(np.bincount(once, minlength=n), pa.int64()),
                         pa.array(np.bincount(gram, minlength=n), pa.int64())],
                        ["term", "df", "ctf"])

    parts = docs.select(scoring_tokens(text).alias("_tokens")).mapInArrow(
        counted, "term string, df long, ctf long")
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("ctf").alias("ctf"))


def document_frequency(terms: DataFrame, min_df: int = params.MIN_DOC_FREQ) -> DataFrame:
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return counts.where(F.col("df") >= min_df)


def corpus_term_frequency(terms: DataFrame) -> DataFrame:
    return terms.groupBy("term").agg(F.sum("tf").alias("ctf"))


def topk_vocabulary(statistics: DataFrame, max_terms: int | None = params.MAX_TERMS,
                    min_df: int = params.MIN_DOC_FREQ) -> DataFrame:
    """The most frequent terms that pass `min_df`; the term breaks ties. None: all of them."""
    passing = statistics.where(F.col("df") >= min_df)
    if max_terms is None:
        return passing
    return passing.orderBy(F.col("ctf").desc(), "term").limit(max_terms)


def fit_vocabulary(docs: DataFrame, text: str, max_terms: int | None = params.MAX_TERMS,
                   min_df: int = params.MIN_DOC_FREQ, low: int = params.NGRAM_MIN,
                   high: int = params.NGRAM_MAX) -> DataFrame:
    """vocabulary(term, df, ctf, idf) with the smoothed inverse document frequency."""
    picked = topk_vocabulary(text_statistics(docs, text, low, high), max_terms, min_df)
    n_docs = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    idf = F.log((1 + n_docs) / (1 + F.col("df"))) + 1
    return picked.withColumn("idf", idf)


def tfidf_transform(docs: DataFrame, vocabulary: DataFrame, text: str, doc_id: str,
                    low: int = params.NGRAM_MIN,
                    high: int = params.NGRAM_MAX) -> DataFrame:
    """L2-normalised sublinear TF-IDF in long form (doc_id, term, tf, weight).

    Terms outside the vocabulary are ignored. The row limit of a fitted vocabulary (or the
    file size of a saved one) is a statistic, so the planner broadcasts it when it is small
    and shuffles when a caller brings a large one.
    """
    # Rows are numbered, because an id may come more than once and each row has its own norm.
    numbered = docs.select(doc_id, text, F.monotonically_increasing_id().alias("_row"))
    terms = document_terms(numbered, text, [doc_id, "_row"], low, high)
    known = terms.join(vocabulary.select("term", "idf"), "term")
    raw = known.withColumn("_raw", (1 + F.log(F.col("tf"))) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(Window.partitionBy("_row")))
    return raw.select(doc_id, "term", "tf", (F.col("_raw") / norm).alias("weight"))


def tfidf_in_row(docs: DataFrame, vocabulary: DataFrame, text: str, doc_id: str,
                 low: int = params.NGRAM_MIN, high: int = params.NGRAM_MAX) -> DataFrame:
    """`tfidf_transform` for a vocabulary with a cap on its terms; no document is shuffled.

    The vocabulary's rows (at most its cap) become a count vectoriser, which looks all n-grams
    of a row up in one hash table; weights and norm come from the row's sparse vector.
    """
    rows = vocabulary.select("term", "idf").collect()
    terms = sorted((r["term"], float(r["idf"])) for r in rows)
    spark, size = docs.sparkSession, len(terms)
    grams = docs.select(doc_id, scoring_tokens(text).alias("_tokens")).select(
        doc_id, adjacent("_tokens", low, high).alias("_grams"))
    if not terms:
        return grams.select(doc_id, F.lit("").alias("term"), F.lit(0).cast("long").alias("tf"),
                            F.lit(0.0).alias("weight")).where("false")
    counted = CountVectorizerModel.from_vocabulary(
        [t for t, _ in terms], inputCol="_grams", outputCol="_counts").transform(grams)
    indices, counts = sparse_parts("_counts")
    damped = counted.select(doc_id, "_counts", sparse_vector(
        indices, F.transform(counts, lambda n: 1 + F.log(n)), size).alias("_damped"))
    weighed = ElementwiseProduct(inputCol="_damped", outputCol="_weights",
                                 scalingVec=Vectors.dense([w for _, w in terms])).transform(damped)
    unit = Normalizer(inputCol="_weights", outputCol="_unit", p=2.0).transform(weighed)
    entries = unit.select(doc_id, F.inline(F.arrays_zip(
        indices.alias("index"), counts.alias("tf"), sparse_parts("_unit")[1].alias("weight"))))
    # As many rows as the vocabulary's cap.
    named = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(terms)],
                                  "index int, term string")
    return entries.join(F.broadcast(named), "index").select(
        doc_id, "term", F.col("tf").cast("long").alias("tf"), "weight")


def tfidf(docs: DataFrame, text: str, doc_id: str, max_terms: int | None = params.MAX_TERMS,
          min_df: int = params.MIN_DOC_FREQ, low: int = params.NGRAM_MIN,
          high: int = params.NGRAM_MAX) -> DataFrame:
    """Fit a vocabulary on the documents and weigh the same documents with it.

    The text, usually the product of a long expression, is stored first and read three times.
    Without a cap on its terms the vocabulary stays a table and is joined.
    """
    path = new_path(docs.sparkSession, "tfidf-texts")
    docs.select(doc_id, text).write.parquet(path)
    docs = docs.sparkSession.read.parquet(path)
    vocabulary = fit_vocabulary(docs, text, max_terms, min_df, low, high)
    weigh = tfidf_transform if max_terms is None else tfidf_in_row
    return weigh(docs, vocabulary, text, doc_id, low, high)
