"""Registered queries on text: cleaning, lexicons, term weights, embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens import params
from marketlens.functions import lexicon as lex
from marketlens.functions import text as tx
from marketlens.lexicons import (
    DAMPENERS, DEFAULT_LEXICON, ENGLISH_STOP_WORDS, FINANCE_KEYWORDS, FINANCE_STOP_WORDS,
    INTENSIFIERS, NEGATIONS)
from marketlens.operators import (
    align, embedding, features, lemmas, lexicon_scan, vocabulary)
from marketlens.plans import sql as s
from marketlens.plans.tables import (
    CORPUS_LEXICON, CORPUS_VALENCE, documents, printable, rounded, spread, spread_headlines,
    table)
from marketlens.sources.workspace import new_path

QUERIES, SQL = {}, {}


def query(key: str, twin: str):
    def register(fn):
        QUERIES[key] = fn
        SQL[key] = twin
        return fn
    return register


def _docs(spark, sf, *more: str):
    return documents(spark, sf, *more)


def _clean_docs(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.clean_text("text").alias("clean_text"))


# --- cleaning --------------------------------------------------------------------------------

N = s.normalise("text")
UNPUNCTUATED = s.unpunctuated(N)
TOKENS = s.tokens(UNPUNCTUATED)


@query("normalise_text", f"SELECT doc_id, {N} AS clean FROM documents")
def normalise_text(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.normalise_text("text").alias("clean"))


@query("remove_punctuation", f"SELECT doc_id, {UNPUNCTUATED} AS clean FROM documents")
def remove_punctuation(spark, sf):
    return _docs(spark, sf).select(
        "doc_id", tx.remove_punctuation(tx.normalise_text("text")).alias("clean"))


@query("tokenize", f"SELECT doc_id, len(t) AS n, array_to_string(t, '|') AS tokens "
                   f"FROM (SELECT doc_id, {TOKENS} AS t FROM documents)")
def tokenize(spark, sf):
    out = _docs(spark, sf).select(
        "doc_id", tx.tokenize(tx.remove_punctuation(tx.normalise_text("text"))).alias("t"))
    return printable(out.select("doc_id", F.size("t").alias("n"),
                                F.array_join("t", "|").alias("tokens")))


@query("remove_stopwords",
       f"SELECT doc_id, len(t) AS n, array_to_string(t, '|') AS tokens "
       f"FROM (SELECT doc_id, {s.without_stopwords(TOKENS)} AS t FROM documents)")
def remove_stopwords(spark, sf):
    tokens = tx.tokenize(tx.remove_punctuation(tx.normalise_text("text")))
    out = _docs(spark, sf).select("doc_id", tx.remove_stopwords(tokens).alias("t"))
    return printable(out.select("doc_id", F.size("t").alias("n"),
                                F.array_join("t", "|").alias("tokens")))


@query("clean_text", s.twin("""
    SELECT 'd' AS origin, doc_id AS id, clean_text FROM clean_docs
    UNION ALL SELECT 'h', id, clean_text FROM clean_headlines""", "headlines", "clean_docs",
    clean_headlines=f"SELECT id, {s.clean('title')} AS clean_text FROM headlines"))
def clean_text(spark, sf):
    docs = _docs(spark, sf).select(F.lit("d").alias("origin"), F.col("doc_id").alias("id"),
                                   tx.clean_text("text").alias("clean_text"))
    news = spread_headlines(spark, sf).select(F.lit("h").alias("origin"), "id",
                                       tx.clean_text("title").alias("clean_text"))
    return docs.unionByName(news)


def _stem(suffix: str, ending: str) -> str:
    return f"concat(left(token, length(token) - {len(suffix)}), '{ending}')"


@query("lemmatize", s.twin(
    """SELECT token, coalesce(min_by(lemma, length(lemma) * 100 + turn), token) AS lemma
       FROM tokens LEFT JOIN known USING (token) GROUP BY token""", "clean_words",
    tokens="SELECT DISTINCT w AS token FROM clean_words",
    vocab="SELECT w AS term FROM clean_words GROUP BY w HAVING count(DISTINCT doc_id) >= 2",
    tried="SELECT token, token AS lemma, 0 AS turn FROM tokens " + " ".join(
        f"UNION ALL SELECT token, {_stem(a, b)}, {i} FROM tokens WHERE token LIKE '%{a}'"
        for i, (a, b) in enumerate(lemmas.NOUN_SUFFIXES, start=1)),
    known="SELECT token, lemma, turn FROM tried WHERE lemma IN (SELECT term FROM vocab)"))
def lemmatize(spark, sf):
    """Corpus vocabulary: every clean token that occurs in two documents."""
    rows = align.token_table(_docs(spark, sf), tx.clean_tokens("text"), ["doc_id"])
    # A term is in two documents if its ids differ; no pair of document and term is shuffled.
    spans = rows.groupBy("term").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
        F.count_if(F.col("doc_id").isNull()).alias("nameless"))
    path = new_path(spark, "token-spans")
    spans.write.parquet(path)
    spans = spark.read.parquet(path)
    several = (F.col("low") != F.col("high")) | (F.col("low").isNotNull() & (F.col("nameless") > 0))
    return lemmas.lemma_table(spans, spans.where(several), unique=True)


KEYWORDS = (f"list_sort(list_filter({s.listing(sorted(FINANCE_KEYWORDS))}, "
            "lambda k: contains(lower(coalesce(text, '')), k)))")
ALL_TEXT = ("SELECT 'd' AS origin, doc_id AS id, text FROM documents "
            "UNION ALL SELECT 'h', id, title FROM headlines")


def _all_text(spark, sf):
    docs = _docs(spark, sf).select(F.lit("d").alias("origin"), F.col("doc_id").alias("id"), "text")
    return docs.unionByName(spread_headlines(spark, sf).select(
        F.lit("h").alias("origin"), "id", F.col("title").alias("text")))


@query("finance_keywords", s.twin(
    f"SELECT origin, id, array_to_string({KEYWORDS}, '|') AS keywords, len({KEYWORDS}) AS n "
    "FROM t", "headlines", t=ALL_TEXT))
def finance_keywords(spark, sf):
    out = _all_text(spark, sf).withColumn("k", tx.finance_keywords("text"))
    return printable(out.select("origin", "id", F.array_join("k", "|").alias("keywords"),
                                F.size("k").alias("n")))


@query("keyword_count", s.twin(
    f"SELECT origin, id, len({KEYWORDS}) AS n_financial_keywords FROM t", "headlines",
    t=ALL_TEXT))
def keyword_count(spark, sf):
    return printable(_all_text(spark, sf).select(
        "origin", "id", F.size(tx.finance_keywords("text")).alias("n_financial_keywords")))


@query("null_text_to_empty",
       "SELECT doc_id, text FROM documents "
       "UNION ALL SELECT doc_id, '' FROM documents WHERE lang = 'fr'")
def null_text_to_empty(spark, sf):
    """All texts, with a missing one beside every French text."""
    docs = _docs(spark, sf, "lang")
    missing = docs.where("lang = 'fr'").withColumn("text", F.lit(None).cast("string"))
    docs = docs.unionByName(missing)
    return docs.select("doc_id", tx.null_text_to_empty("text").alias("text"))


@query("ngrams", s.twin("SELECT doc_id, term, count(*) AS tf FROM grams WHERE term IS NOT NULL "
                        "GROUP BY doc_id, term", "grams"))
def ngrams(spark, sf):
    return vocabulary.document_terms(_clean_docs(spark, sf), "clean_text", ["doc_id"])


# --- stop words and lexicons -----------------------------------------------------------------

@query("stopword_anti", s.twin(
    "SELECT doc_id, CAST(pos - 1 AS BIGINT) AS pos, w AS term FROM w WHERE length(w) > 1 AND "
    f"w NOT IN {s.tuple_of(tx.stop_words())}",
    n=f"SELECT doc_id, {TOKENS} AS ws FROM documents",
    w="SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM n"))
def stopword_anti(spark, sf):
    tokens = tx.tokenize(tx.remove_punctuation(tx.normalise_text("text")))
    rows = align.token_table(_docs(spark, sf), tokens, ["doc_id"])
    stops = spark.createDataFrame([(w,) for w in tx.stop_words()], "term string")
    return printable(align.stopword_anti(rows, stops).select("doc_id", "pos", "term"))


@query("stopset_union", s.twin(
    "SELECT term, count(*) AS n FROM w WHERE term IN (SELECT term FROM stops) GROUP BY term",
    stops=(f"SELECT unnest({s.listing(ENGLISH_STOP_WORDS)}) AS term UNION "
           f"SELECT unnest({s.listing(FINANCE_STOP_WORDS)})"),
    w=f"SELECT unnest({TOKENS}) AS term FROM documents"))
def stopset_union(spark, sf):
    """Corpus counts of the united stop set."""
    english = spark.createDataFrame([(w,) for w in ENGLISH_STOP_WORDS], "term string")
    finance = spark.createDataFrame([(w,) for w in FINANCE_STOP_WORDS], "term string")
    stops = english.union(finance).distinct()
    tokens = tx.tokenize(tx.remove_punctuation(tx.normalise_text("text")))
    counts = (_docs(spark, sf).select(F.explode(tokens).alias("term"))
              .groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    return counts.join(stops, "term", "left_semi")


LEX = "lexicon(term, class, polarity, subjectivity)"
CORPUS_ROWS = s.values(CORPUS_LEXICON.rows)
DEFAULT_ROWS = s.values(DEFAULT_LEXICON.rows)
LOWER_WORDS = s.words("lower(coalesce(text, ''))")


@query("lexicon_token_join", s.twin(
    "SELECT doc_id, t.term, class, polarity FROM t JOIN lexicon USING (term)",
    t=f"SELECT doc_id, unnest(list_distinct({LOWER_WORDS})) AS term FROM documents",
    **{LEX: CORPUS_ROWS}))
def lexicon_token_join(spark, sf):
    return align.lexicon_token_join(
        _docs(spark, sf), CORPUS_LEXICON.table(spark), "text", ["doc_id"]).select(
        "doc_id", "term", "class", "polarity")


@query("token_lexicon_intersect", s.twin(
    f"SELECT doc_id, len(list_intersect(list_distinct({LOWER_WORDS}), "
    f"{s.listing(CORPUS_LEXICON.terms('bullish'))})) AS n_bullish FROM documents"))
def token_lexicon_intersect(spark, sf):
    return printable(_docs(spark, sf).select(
        "doc_id", lex.token_hits("text", CORPUS_LEXICON.terms("bullish")).alias("n_bullish")))


@query("lexicon_substring_join", s.twin(
    "SELECT origin, id, term FROM t JOIN (SELECT DISTINCT term FROM lexicon) l "
    "ON contains(lower(coalesce(t.text, '')), l.term)", "headlines", t=ALL_TEXT,
    **{LEX: DEFAULT_ROWS}))
def lexicon_substring_join(spark, sf):
    terms = DEFAULT_LEXICON.table(spark).select("term")
    return align.lexicon_substring_join(_all_text(spark, sf), terms, "text", ["origin", "id"])


def _counts(text: str, lexicon) -> str:
    return ", ".join(
        f"len(list_filter({s.listing(lexicon.terms(c))}, lambda k: "
        f"contains(lower({text}), k))) AS {c}_count" for c in ("bullish", "bearish", "neutral"))


def _lexicon_counts(spark, df, text, lexicon):
    return lexicon_scan.scan(df, text, lexicon.table(spark))


COUNT_NAMES = ["bullish_count", "bearish_count", "neutral_count"]


@query("lexicon_counts", s.twin(
    f"SELECT 'd' AS origin, doc_id AS id, {_counts('text', CORPUS_LEXICON)} FROM documents "
    f"UNION ALL SELECT 'h', id, {_counts('title', DEFAULT_LEXICON)} FROM headlines", "headlines"))
def lexicon_counts(spark, sf):
    docs = _lexicon_counts(spark, _docs(spark, sf), "text", CORPUS_LEXICON).select(
        F.lit("d").alias("origin"), F.col("doc_id").alias("id"), *COUNT_NAMES)
    news = _lexicon_counts(spark, spread_headlines(spark, sf), "title", DEFAULT_LEXICON).select(
        F.lit("h").alias("origin"), "id", *COUNT_NAMES)
    return printable(docs.unionByName(news))


COMBINED = f"concat(title, ' ', {s.clean('title')})"


@query("combined_text_counts", s.twin(
    f"SELECT id, {_counts(COMBINED, DEFAULT_LEXICON)} FROM headlines", "headlines"))
def combined_text_counts(spark, sf):
    news = spread_headlines(spark, sf).withColumn(
        "_t", lex.combined_text("title", tx.clean_text("title")))
    return printable(_lexicon_counts(spark, news, "_t", DEFAULT_LEXICON).select("id", *COUNT_NAMES))


def _polarity_sql(source: str, row: str, text: str, rows: str) -> dict[str, str]:
    """Views `lexicon`, `hits`, `pol` for mean weights of token hits."""
    return {
        LEX: rows,
        "first_rows": "SELECT term, arg_min(polarity, class) AS polarity, "
                      "arg_min(subjectivity, class) AS subjectivity FROM lexicon GROUP BY term",
        "hits": f"SELECT {row} AS k, unnest({s.words(f'lower({text})')}) AS term FROM {source}",
        "pol": "SELECT k, sum(polarity) / count(*) AS polarity, "
               "sum(subjectivity) / count(*) AS subjectivity "
               "FROM hits JOIN first_rows USING (term) GROUP BY k"}


@query("lexicon_sentiment", s.twin(
    "SELECT doc_id, coalesce(polarity, 0) AS polarity, coalesce(subjectivity, 0) AS subjectivity, "
    "abs(coalesce(polarity, 0)) AS intensity, "
    "coalesce(polarity * subjectivity, 0) AS polarity_x_subjectivity "
    "FROM documents LEFT JOIN pol ON doc_id = k",
    **_polarity_sql("documents", "doc_id", "text", CORPUS_ROWS)))
def lexicon_sentiment(spark, sf):
    out = _docs(spark, sf).select(
        "doc_id", lex.polarity("text", CORPUS_LEXICON).alias("polarity"),
        lex.subjectivity("text", CORPUS_LEXICON).alias("subjectivity"))
    return out.withColumns({
        "intensity": F.abs("polarity"),
        "polarity_x_subjectivity": F.col("polarity") * F.col("subjectivity")})


# A lexicon of corpus size: the words of the benchmark's texts, with classes and weights from
# their md5.
WORD_HASH = "CAST(concat('0x', substring(md5(term), 1, 6)) AS BIGINT)"
WORD_ROWS = f"""SELECT term, CASE h % 3 WHEN 0 THEN 'bullish' WHEN 1 THEN 'bearish' ELSE 'neutral' END,
    (h % 17 - 8) / 8.0e0, (h % 9) / 8.0e0
    FROM (SELECT term, {WORD_HASH} AS h FROM
          (SELECT DISTINCT unnest({LOWER_WORDS}) AS term FROM benchmark))"""


def word_lexicon(spark, sf):
    words = table(spark, sf, "benchmark").select(
        F.explode(tx.split_words(F.lower(tx.null_text_to_empty("text")))).alias("term")).distinct()
    h = F.conv(F.substring(F.md5("term"), 1, 6), 16, 10).cast("long")
    label = F.when(h % 3 == 0, "bullish").when(h % 3 == 1, "bearish").otherwise("neutral")
    return words.select("term", label.alias("class"), ((h % 17 - 8) / 8.0).alias("polarity"),
                        ((h % 9) / 8.0).alias("subjectivity"))


def _word_counts(label: str) -> str:
    return (f"len(list_filter((SELECT list(term) FROM lexicon WHERE class = '{label}'), "
            f"lambda k: contains(lower(coalesce(text, '')), k))) AS {label}_count")


@query("lexicon_table_counts", s.twin(
    f"SELECT doc_id, {', '.join(map(_word_counts, lexicon_scan.CLASSES))}, "
    "coalesce(polarity, 0) AS polarity, coalesce(subjectivity, 0) AS subjectivity "
    "FROM documents LEFT JOIN pol ON doc_id = k",
    **_polarity_sql("documents", "doc_id", "coalesce(text, '')", WORD_ROWS)))
def lexicon_table_counts(spark, sf):
    """All documents against a lexicon that is a table, derived from another table's words."""
    found = lexicon_scan.scan(_docs(spark, sf), "text", word_lexicon(spark, sf))
    return printable(found.select("doc_id", *COUNT_NAMES, "polarity", "subjectivity"))


# --- valence ---------------------------------------------------------------------------------

def valence_views(source: str, row: str, text: str, valence: dict) -> dict[str, str]:
    """Views ending in `v(k, compound, positive, negative, neutral)`."""
    bare = (f"list_transform({s.words(text)}, lambda w: regexp_replace("
            r"regexp_replace(w, '[''’]', '', 'g'), '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g'))")
    back = ", ".join(
        f"coalesce(lag(b, {i}) OVER (PARTITION BY k ORDER BY pos), 0) AS b{i}, "
        f"coalesce(lag(neg, {i}) OVER (PARTITION BY k ORDER BY pos), false) AS n{i}"
        for i in (1, 2, 3))
    sign = "(CASE WHEN v < 0 THEN -1.0e0 ELSE 1.0e0 END)"
    boosted = f"(v + {sign} * b1 * 1.0e0 + {sign} * b2 * 0.95e0 + {sign} * b3 * 0.9e0)"
    return {
        "valence(w, v)": s.values(sorted((t, float(x)) for t, x in valence.items())),
        "vw": f"SELECT {row} AS k, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM "
              f"(SELECT {row}, list_filter({bare}, lambda w: w <> '') AS ws FROM {source})",
        "cased": """SELECT k, pos, lower(w) AS w, upper(w) = w AND lower(w) <> w AS up,
                      bool_or(upper(w) = w AND lower(w) <> w) OVER (PARTITION BY k)
                      AND bool_or(NOT (upper(w) = w AND lower(w) <> w)) OVER (PARTITION BY k) AS mixed
                    FROM vw""",
        "plain": f"""SELECT k, pos, w, up AND mixed AS loud, coalesce(v, 0.0e0) AS v,
                       CASE WHEN w IN {s.tuple_of(INTENSIFIERS)} THEN 0.293e0
                            WHEN w IN {s.tuple_of(DAMPENERS)} THEN -0.293e0 ELSE 0.0e0 END AS b,
                       w IN {s.tuple_of(NEGATIONS)} AS neg
                     FROM cased LEFT JOIN valence USING (w)""",
        "facts": """SELECT k, pos, neg,
                      CASE WHEN loud AND v > 0 THEN v + 0.733e0
                           WHEN loud AND v < 0 THEN v - 0.733e0 ELSE v END AS v,
                      CASE WHEN loud AND b <> 0 THEN b + 0.733e0 ELSE b END AS b,
                      min(pos) FILTER (w = 'but') OVER (PARTITION BY k) AS but FROM plain""",
        "ctx": f"SELECT *, {back} FROM facts",
        "adj": f"""SELECT k, (CASE WHEN v = 0 THEN 0.0e0
                       WHEN n1 OR n2 OR n3 THEN {boosted} * -0.74e0 ELSE {boosted} END)
                     * CASE WHEN pos < but THEN 0.5e0 WHEN pos > but THEN 1.5e0 ELSE 1.0e0 END AS x
                   FROM ctx""",
        "sums": """SELECT k, sum(CAST(x AS DOUBLE)) AS total,
                          coalesce(sum(x + 1) FILTER (x > 0), 0) AS p,
                          coalesce(sum(x - 1) FILTER (x < 0), 0) AS g,
                          count(*) FILTER (x = 0) AS u FROM adj GROUP BY k""",
        "amounts": f"""SELECT {row} AS k,
                least(length(regexp_replace({text}, '[^!]', '', 'g')), 4) * 0.292e0
                + CASE WHEN length(regexp_replace({text}, '[^?]', '', 'g')) > 3 THEN 0.96e0
                       WHEN length(regexp_replace({text}, '[^?]', '', 'g')) > 1
                       THEN length(regexp_replace({text}, '[^?]', '', 'g')) * 0.18e0
                       ELSE 0 END AS amount FROM {source}""",
        "toward": """SELECT k, CASE WHEN total > 0 THEN total + amount
                                    WHEN total < 0 THEN total - amount
                                    ELSE coalesce(total, 0) END AS s,
                       CASE WHEN p > -g THEN p + amount ELSE coalesce(p, 0) END AS p,
                       CASE WHEN p < -g THEN g - amount ELSE coalesce(g, 0) END AS g,
                       coalesce(u, 0) AS u
                     FROM amounts LEFT JOIN sums USING (k)""",
        "v": """SELECT k, round(s / sqrt(s * s + 15.0e0), 4) AS compound,
                       round(coalesce(p / nullif(p - g + u, 0), 0), 3) AS positive,
                       round(coalesce(-g / nullif(p - g + u, 0), 0), 3) + 0.0 AS negative,
                       round(coalesce(u / nullif(p - g + u, 0), 0), 3) AS neutral FROM toward""",
    }


def _valence(df, row, text, valence):
    scored = lex.add_valence(df.select(row, text), text, "_v", valence)
    return scored.select(
        row, *[F.col(f"_v.{c}").alias(c) for c in ("compound", "positive", "negative", "neutral")])


@query("valence_sentiment", s.twin(
    "SELECT k AS doc_id, compound, positive, negative, neutral FROM v",
    **valence_views("documents", "doc_id", "text", CORPUS_VALENCE)))
def valence_sentiment(spark, sf):
    return _valence(_docs(spark, sf), "doc_id", "text", CORPUS_VALENCE)


@query("sentiment_label", s.twin(
    "SELECT k AS id, CASE WHEN compound >= 0.05 THEN 'positive' WHEN compound <= -0.05 "
    "THEN 'negative' ELSE 'neutral' END AS label, abs(compound) AS score FROM v", "headlines",
    **valence_views("headlines", "id", "title", lex.DEFAULT_VALENCE)))
def sentiment_label(spark, sf):
    out = _valence(spread_headlines(spark, sf), "id", "title", lex.DEFAULT_VALENCE)
    return out.select("id", lex.sentiment_label("compound").alias("label"),
                      F.abs("compound").alias("score"))


@query("sentiment_features", s.twin(
    f"""SELECT id, coalesce(polarity, 0) AS sentiment_polarity,
          coalesce(subjectivity, 0) AS sentiment_subjectivity,
          abs(coalesce(polarity, 0)) AS sentiment_intensity,
          coalesce(polarity * subjectivity, 0) AS polarity_x_subjectivity,
          bullish_count AS bullish_keyword_count, bearish_count AS bearish_keyword_count,
          neutral_count AS neutral_keyword_count,
          bullish_count - bearish_count AS keyword_sentiment,
          CAST(CASE WHEN neutral_count > 0 THEN 1 ELSE 0 END AS BIGINT) AS neutral_signal,
          compound AS valence_compound, positive AS valence_positive,
          negative AS valence_negative, neutral AS valence_neutral
        FROM c LEFT JOIN pol ON pol.k = c.id JOIN v ON v.k = c.id""", "headlines",
    clean=f"SELECT id, {s.clean('title')} AS clean_text FROM headlines",
    c=f"SELECT id, {_counts('clean_text', DEFAULT_LEXICON)} FROM clean",
    **_polarity_sql("clean", "id", "clean_text", DEFAULT_ROWS),
    **valence_views("clean", "id", "clean_text", lex.DEFAULT_VALENCE)))
def sentiment_features(spark, sf):
    clean = spread_headlines(spark, sf).select("id", tx.clean_text("title").alias("clean_text"))
    return printable(features.sentiment_features(clean, "clean_text")
                     .select("id", *features.SENTIMENT_FEATURES))


# --- term weights and embeddings -------------------------------------------------------------

TF = "SELECT doc_id, term, tf, (1 + ln(tf)) * idf AS raw FROM term_counts JOIN vocab USING (term)"
VOCAB = f"""SELECT term, df, ctf,
              ln((1 + (SELECT count(*) FROM clean_docs)) / (1 + df)) + 1 AS idf
            FROM (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS ctf
                  FROM term_counts GROUP BY term HAVING count(*) >= {params.MIN_DOC_FREQ})
            ORDER BY ctf DESC, term LIMIT {params.MAX_TERMS}"""


@query("document_frequency", s.twin(
    "SELECT term, count(*) AS df FROM term_counts GROUP BY term HAVING count(*) >= 2",
    "term_counts"))
def document_frequency(spark, sf):
    return vocabulary.document_frequency(
        vocabulary.document_terms(_clean_docs(spark, sf), "clean_text", []))


@query("corpus_term_frequency", s.twin(
    "SELECT term, CAST(sum(tf) AS BIGINT) AS ctf FROM term_counts GROUP BY term", "term_counts"))
def corpus_term_frequency(spark, sf):
    return vocabulary.corpus_term_frequency(
        vocabulary.document_terms(_clean_docs(spark, sf), "clean_text", []))


@query("topk_vocabulary", s.twin("SELECT term, df, ctf, round(idf, 6) AS idf FROM vocab",
                                 "term_counts", vocab=VOCAB))
def topk_vocabulary(spark, sf):
    return rounded(vocabulary.fit_vocabulary(_clean_docs(spark, sf), "clean_text"), "idf")


@query("tfidf", s.twin(
    "SELECT doc_id, term, tf, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) "
    "AS weight FROM t", "term_counts", vocab=VOCAB, t=TF))
def tfidf(spark, sf):
    return rounded(vocabulary.tfidf(_clean_docs(spark, sf), "clean_text", "doc_id"), "weight")


CONV_TEXT = f"SELECT conv_id * 1000 + turn AS row_id, {s.clean('text')} AS clean_text FROM conversations"


@query("tfidf_transform", s.twin(
    "SELECT row_id, term, tf, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY row_id)), 6) "
    "AS weight FROM t", "term_counts", vocab=VOCAB, conv=CONV_TEXT,
    cw="SELECT row_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM "
       f"(SELECT row_id, {s.words('clean_text')} AS ws FROM conv)",
    cg=s.VIEWS["grams"].replace("doc_id", "row_id").replace("clean_words", "cw"),
    cc="SELECT row_id, term, count(*) AS tf FROM cg WHERE term IS NOT NULL GROUP BY ALL",
    t="SELECT row_id, term, tf, (1 + ln(tf)) * idf AS raw FROM cc JOIN vocab USING (term)"))
def tfidf_transform(spark, sf):
    """Score conversation turns with the vocabulary fitted on the documents."""
    vocab = vocabulary.fit_vocabulary(_clean_docs(spark, sf), "clean_text")
    turns = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "text")
    turns = spread(turns, "row_id").select("row_id", tx.clean_text("text").alias("clean_text"))
    return rounded(vocabulary.tfidf_in_row(turns, vocab, "clean_text", "row_id"), "weight")


@query("text_embedding", s.twin(
    "SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight "
    "FROM b",
    w=f"SELECT doc_id, unnest({LOWER_WORDS}) AS w FROM documents",
    b="SELECT doc_id, CAST(concat('0x', substring(md5(w), 1, 8)) AS BIGINT) % 384 AS bucket, "
      "count(*) AS n FROM w GROUP BY ALL"))
def text_embedding(spark, sf):
    return printable(rounded(embedding.hashed_buckets(_docs(spark, sf), "text", "doc_id"),
                             "weight"))


@query("text_embedding_vectors", s.twin(
    "SELECT doc_id, 384 AS dim, coalesce(n_filled, 0) AS n_filled, "
    "CASE WHEN n_filled > 0 THEN 1.0e0 ELSE 0.0e0 END AS length FROM documents LEFT JOIN "
    "(SELECT doc_id, count(DISTINCT CAST(concat('0x', substring(md5(w), 1, 8)) AS BIGINT) % 384) "
    "AS n_filled FROM w GROUP BY doc_id) USING (doc_id)",
    w=f"SELECT doc_id, unnest({LOWER_WORDS}) AS w FROM documents"))
def text_embedding_vectors(spark, sf):
    """The dense form: one array per document."""
    rows = embedding.hashed_embedding(_docs(spark, sf), "text")
    square = F.aggregate("embedding", F.lit(0.0), lambda t, v: t + v.cast("double") * v)
    return rows.select("doc_id", F.size("embedding").alias("dim"),
                       F.size(F.filter("embedding", lambda v: v != 0)).cast("long").alias("n_filled"),
                       F.round(F.sqrt(square), 4).alias("length"))
