"""From raw headlines to scores with one saved model.

`fit` learns the vocabulary, the padding means, the scaling and a classifier on labelled
headlines and returns one `PipelineModel` of persistable stages; whoever loads it scores raw
headlines with exactly the features that it was trained on.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler, VectorSizeHint
from pyspark.sql import DataFrame

from marketlens import params
from marketlens.functions.calendar import TEMPORAL_FEATURES
from marketlens.lexicons import DEFAULT_LEXICON, Lexicon
from marketlens.operators.estimators import FITTERS
from marketlens.operators.features import SENTIMENT_FEATURES
from marketlens.operators.indicators import MARKET_FEATURES
from marketlens.operators.stages import (
    CalendarColumns, FillColumns, SentimentColumns, TextCleaner, TextVectors)
from marketlens.operators.standardise import fit_vector_scaler
from marketlens.operators.vocabulary import fit_vocabulary
from marketlens.sources.workspace import new_path


def text_stages(vocabulary: DataFrame | None, text: str, output: str = "tfidf",
                embedding: str | None = None, size: int = params.EMBEDDING_DIM
                ) -> tuple[list[Transformer], list[str]]:
    """(stages from clean text to unit-length TF-IDF weights and bucket counts, their columns).

    Positions of weights follow the term order. The vocabulary's rows, at most its `max_terms`,
    come to the driver to become a stage; without any there is no column of weights.
    """
    rows = [] if vocabulary is None else vocabulary.select("term", "idf").collect()
    terms = sorted((r["term"], float(r["idf"])) for r in rows)
    made = {**({output: len(terms)} if terms else {}), **({embedding: size} if embedding else {})}
    if not made:
        return [], []
    vectors = TextVectors(inputCol=text, outputCol=output, terms=[t for t, _ in terms],
                          idf=[w for _, w in terms], embeddingCol=embedding, size=size)
    return [vectors, *[VectorSizeHint(inputCol=c, size=n, handleInvalid="optimistic")
                       for c, n in made.items()]], list(made)


def term_stages(vocabulary: DataFrame, text: str, output: str = "tfidf") -> list[Transformer]:
    """Stages from clean text to unit-length TF-IDF weights."""
    return text_stages(vocabulary, text, output)[0]


def embedding_stages(text: str, output: str = "embedding",
                     size: int = params.EMBEDDING_DIM) -> list[Transformer]:
    return text_stages(None, text, embedding=output, size=size)[0]


def feature_stages(vocabulary: DataFrame, *, text: str = "clean_text",
                   time: str | None = "published_at", use_embedding: bool = True,
                   lexicon: Lexicon | str = DEFAULT_LEXICON, market: FillColumns | None = None,
                   model_embedding: str | None = None, output: str = "features"
                   ) -> list[Transformer]:
    """Stages from clean text to one vector: term weights, embedding, sentiment, [a model's
    embedding], market and calendar columns, in that order. `lexicon` may be the path of a
    lexicon table; `market` fills the market columns."""
    vectors, inputs = text_stages(vocabulary, text,
                                  embedding="embedding" if use_embedding else None)
    # The sentiment comes first, so that no vector passes through its Arrow function.
    if isinstance(lexicon, Lexicon):
        stages = [SentimentColumns(inputCol=text, lexicon=json.dumps(lexicon.rows)), *vectors]
    else:
        stages = [SentimentColumns(inputCol=text, lexiconPath=lexicon), *vectors]
    inputs += SENTIMENT_FEATURES
    if model_embedding:
        inputs.append(model_embedding)
    if market is not None:
        stages.append(market)
        inputs += market.getOrDefault("names")
    if time:
        stages.append(CalendarColumns(inputCol=time))
        inputs += TEMPORAL_FEATURES
    return [*stages, VectorAssembler(inputCols=inputs, outputCol=output, handleInvalid="keep")]


def feature_matrix(df: DataFrame, vocabulary: DataFrame, *, text: str = "clean_text",
                   time: str = "published_at", **options) -> DataFrame:
    """Append `features` and its parts. Everything is computed in the row: ids and texts may
    repeat, and nothing is shuffled. Market columns join in when `df` has them."""
    present = [c for c in MARKET_FEATURES if c in df.columns]
    market = FillColumns(names=present, means=[0.0] * len(present)) if present else None
    stages = feature_stages(vocabulary, text=text, time=time if time in df.columns else None,
                            market=market, **options)
    return PipelineModel(stages).transform(df)


def fit_front(train: DataFrame, *, text: str = "title", max_terms: int = params.MAX_TERMS,
              scale: bool = True, **options) -> tuple[PipelineModel, DataFrame]:
    """(stages from raw headlines to scaled features, the training rows with them).

    The clean training rows are stored once: the vocabulary, the means and the features read
    that table and not the joins behind `train`. So are the features, as (label, features) with
    an id if there is one, and every fit reads that table. Scaling does not centre: none of the
    classifiers' scores depends on it, and the vectors stay sparse.
    """
    cleaner = TextCleaner(inputCol=text, outputCol="clean_text")
    present = [c for c in MARKET_FEATURES if c in train.columns]
    kept = ["label", *(c for c in ("id",) if c in train.columns)]
    needed = {*kept, *present, options.get("time", "published_at"), options.get("model_embedding")}
    path = new_path(train.sparkSession, "clean-training")
    cleaner.transform(train).select("clean_text", *[
        c for c in train.columns if c in needed - {"clean_text"}]).write.parquet(path)
    clean = train.sparkSession.read.parquet(path)
    vocabulary = fit_vocabulary(clean, "clean_text", max_terms)
    market = FillColumns.fit(clean, present) if present else None
    raw = "_unscaled" if scale else "features"
    steps = feature_stages(vocabulary, market=market, output=raw, **options)
    stages: list[Transformer] = [cleaner, *steps]
    path = new_path(train.sparkSession, "features")
    PipelineModel(steps).transform(clean).select(*kept, raw).write.parquet(path)
    rows = train.sparkSession.read.parquet(path)
    if scale:
        scaler = fit_vector_scaler(rows, raw, "features", center=False)
        stages += scaler.stages
        rows = scaler.transform(rows).select(*kept, "features")
    return PipelineModel(stages), rows


def fit(train: DataFrame, name: str = "logistic_regression", arguments: Mapping | None = None,
        **options) -> PipelineModel:
    """One model from raw headlines to probabilities. `train` has text, time, label and, if
    they are to be features, the market columns; at scoring any of them may be missing."""
    front, rows = fit_front(train, **options)
    return PipelineModel([*front.stages, *FITTERS[name](rows, **(arguments or {})).stages])


def fit_all(train: DataFrame, arguments: Mapping[str, Mapping], **options
            ) -> tuple[PipelineModel, dict[str, PipelineModel]]:
    """Several classifiers on one set of features: (front, {name: classifier})."""
    front, rows = fit_front(train, **options)
    return front, {name: FITTERS[name](rows, **chosen) for name, chosen in arguments.items()}
