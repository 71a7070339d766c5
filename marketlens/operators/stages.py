"""Feature steps as persistable pipeline stages.

Every step from a raw headline to the assembled vector is a `Transformer` that can be saved,
so one `PipelineModel` on disk holds all that scoring needs: cleaning, vocabulary, term
weights, embedding, sentiment, calendar, padding, scaling and the classifier. Nothing is
shuffled; the words of a text are counted and looked up in Arrow batches with NumPy.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens import params
from marketlens.functions.calendar import TEMPORAL_FEATURES, temporal_features
from marketlens.functions.lexicon import lower_words
from marketlens.functions.text import clean_text
from marketlens.lexicons import DEFAULT_LEXICON, DEFAULT_NOUNS, Lexicon
from marketlens.operators import token_arrays
from marketlens.operators.features import sentiment_features, sentiment_in_batches
from marketlens.operators.vocabulary import scoring_tokens


class _Stage(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable,
             DefaultParamsWritable):
    """A step that keeps all columns of its input and appends its own."""

    def _given(self, values: dict) -> None:
        self._set(**{k: v for k, v in values.items() if v is not None})


class TextCleaner(_Stage):
    """Raw text to clean text."""

    nouns = Param(Params._dummy(), "nouns", "noun vocabulary", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, nouns=None):
        super().__init__()
        self._setDefault(nouns=list(DEFAULT_NOUNS))
        self._given(self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cleaned = clean_text(self.getInputCol(), self.getOrDefault("nouns"))
        return dataset.withColumn(self.getOutputCol(), cleaned)


class TextVectors(_Stage):
    """Clean text to sparse vectors of unit length, in one Arrow function.

    `outputCol` holds the TF-IDF weights of `terms`: all n-grams of scoring tokens are counted,
    n is damped to 1 + ln n and multiplied by the term's `idf`. `embeddingCol` holds the
    white-space tokens counted in `size` buckets by md5. Either may be left out.
    """

    terms = Param(Params._dummy(), "terms", "vocabulary", TypeConverters.toListString)
    idf = Param(Params._dummy(), "idf", "factor of each term", TypeConverters.toListFloat)
    low = Param(Params._dummy(), "low", "shortest n-gram", TypeConverters.toInt)
    high = Param(Params._dummy(), "high", "longest n-gram", TypeConverters.toInt)
    embeddingCol = Param(Params._dummy(), "embeddingCol", "column of buckets",
                         TypeConverters.toString)
    size = Param(Params._dummy(), "size", "number of buckets", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, terms=None, idf=None, low=None, high=None,
                 embeddingCol=None, size=None):
        super().__init__()
        self._setDefault(terms=[], idf=[], low=params.NGRAM_MIN, high=params.NGRAM_MAX,
                         embeddingCol="", size=params.EMBEDDING_DIM)
        self._given(self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        text, terms, size = self.getInputCol(), self.getOrDefault("terms"), self.getOrDefault("size")
        makers = {}
        if terms:
            makers[self.getOutputCol()] = (scoring_tokens(text), token_arrays.term_weights(
                terms, *map(self.getOrDefault, ("idf", "low", "high"))), len(terms))
        if self.getOrDefault("embeddingCol"):
            makers[self.getOrDefault("embeddingCol")] = (
                lower_words(text), token_arrays.bucket_weights(size), size)
        return token_arrays.append_vectors(dataset, makers) if makers else dataset


class SentimentColumns(_Stage):
    """The 13 sentiment columns of a text.

    The lexicon is kept with the stage as rows; one of any size is read from the table at
    `lexiconPath` instead.
    """

    lexicon = Param(Params._dummy(), "lexicon", "lexicon rows as JSON", TypeConverters.toString)
    lexiconPath = Param(Params._dummy(), "lexiconPath", "lexicon table", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol=None, lexicon=None, lexiconPath=None):
        super().__init__()
        self._setDefault(lexicon=json.dumps(DEFAULT_LEXICON.rows), lexiconPath="")
        self._given(self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        path, text = self.getOrDefault("lexiconPath"), self.getInputCol()
        if path:
            return sentiment_features(dataset, text, lexicon=dataset.sparkSession.read.parquet(path))
        rows = json.loads(self.getOrDefault("lexicon"))
        return sentiment_in_batches(dataset, text, Lexicon(tuple(map(tuple, rows))))


class CalendarColumns(_Stage):
    """The eight calendar columns of a time; zeros where it is null or no column."""

    @keyword_only
    def __init__(self, *, inputCol=None):
        super().__init__()
        self._given(self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        time = self.getInputCol()
        known = F.col(time) if time in dataset.columns else F.lit(None).cast("timestamp")
        made = temporal_features(known)
        kept = [c for c in dataset.columns if c not in TEMPORAL_FEATURES]
        return dataset.select(*kept, *made)


class FillColumns(_Stage):
    """Null, NaN or absent columns take the value they had on average in training."""

    names = Param(Params._dummy(), "names", "columns", TypeConverters.toListString)
    means = Param(Params._dummy(), "means", "their means", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, names=None, means=None):
        super().__init__()
        self._given(self._input_kwargs)

    @staticmethod
    def fit(train: DataFrame, names: list[str]) -> "FillColumns":
        means = train.agg(*[F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None))).alias(c)
                            for c in names]).first() if names else ()
        return FillColumns(names=names, means=[0.0 if m is None else float(m) for m in means])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        filled = {}
        for name, mean in zip(self.getOrDefault("names"), self.getOrDefault("means")):
            value = F.lit(mean)
            if name in dataset.columns:
                own = F.col(name).cast("double")
                value = F.when(own.isNotNull() & ~F.isnan(own), own).otherwise(F.lit(mean))
            filled[name] = value
        return dataset.withColumns(filled) if filled else dataset
