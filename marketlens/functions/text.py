"""Text cleaning as Column expressions; no Python runs on the executors.

Arrays are only combined with `zip_with` / `slice` on whole arrays: an index lookup inside a
lambda would evaluate the array expression again for every element.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens import params
from marketlens.lexicons import (
    DEFAULT_NOUNS, ENGLISH_STOP_WORDS, FINANCE_KEYWORDS, FINANCE_STOP_WORDS, FUSED_WORDS,
    NOUN_SUFFIXES)

# Character classes. Java evaluates `\s` and `\p{Alnum}` as one table test each,
# several times faster than the equal unions of ranges.
SPACES = r"[\s\x1C\x1D\x1E\x1F]"
NOT_ASCII = r"[^\x00-\x7F]"
NOT_WORD_OR_SPACE = r"[^\p{Alnum}\s\x1C\x1D\x1E\x1F]"
ASCII_PUNCTUATION = "".join(
    chr(c) for c in range(128) if not chr(c).isalnum() and not chr(c).isspace())
# The class `NOT_WORD_OR_SPACE` with every character listed: Java tests that by one table, and
# each range or class in a negated union by a call of its own.
NOT_LISTED = "[^{}]+".format("".join(
    chr(c) if chr(c).isalnum() else rf"\x{c:02X}" for c in range(128)
    if chr(c).isalnum() or chr(c).isspace()))
# White space that is not one plain space already.
UNEVEN_SPACES = rf"(?: {SPACES}+|[\t\n\x0B\f\r\x1C\x1D\x1E\x1F]{SPACES}*)"
EDGE_SPACES = ("\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
               "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _from(array: Column, position: int) -> Column:
    """The array from a 1-based position on."""
    return F.slice(array, position, F.size(array))


def null_text_to_empty(text: Column | str) -> Column:
    return F.coalesce(_col(text), F.lit(""))


def strip(text: Column | str) -> Column:
    """Remove white space of any kind at both ends (plain `trim` removes only spaces)."""
    return F.trim(_col(text), F.lit(EDGE_SPACES))


def normalise_text(text: Column | str) -> Column:
    """Lower-case and strip, then drop non-ASCII, then collapse white space."""
    ascii_only = F.regexp_replace(strip(F.lower(null_text_to_empty(text))), NOT_ASCII, "")
    return F.regexp_replace(ascii_only, UNEVEN_SPACES, " ")


def remove_punctuation(text: Column | str) -> Column:
    """Delete (do not space out) everything but ASCII letters, digits and white space."""
    return F.regexp_replace(_col(text), NOT_WORD_OR_SPACE, "")


def split_words(text: Column | str) -> Column:
    """White-space tokens, without empty ones."""
    return F.filter(F.split(_col(text), f"{SPACES}+"), lambda t: t != F.lit(""))


def tokenize(text: Column | str) -> Column:
    """Word tokens of normalised, punctuation-free text; fused words are split."""
    halves = [parts.split(" ") for parts in FUSED_WORDS.values()]
    # The first letter is the cheapest test, and nearly all positions fail it.
    letters = "".join(sorted({a[0] for a, _ in halves}))
    pattern = (rf"(?=[{letters}])\b(?:" + "|".join(f"({a})({b})" for a, b in halves) + r")\b")
    groups = range(1, 2 * len(halves) + 1)
    # One pass: only the matching alternative's two groups are non-empty.
    firsts, seconds = ("".join(f"${g}" for g in groups[k::2]) for k in (0, 1))
    text = F.regexp_replace(_col(text), pattern, f"{firsts} {seconds}")
    return split_words(text)


def stop_words(include_finance: bool = True) -> list[str]:
    return sorted({*ENGLISH_STOP_WORDS, *(FINANCE_STOP_WORDS if include_finance else ())})


def remove_stopwords(tokens: Column | str, words: Iterable[str] | None = None,
                     include_finance: bool = True) -> Column:
    """Drop stop words and one-character tokens. `isin` on literals is a hash-set probe."""
    words = stop_words(include_finance) if words is None else sorted(words)
    return F.filter(_col(tokens), lambda t: (F.length(t) > 1) & ~t.isin(words))


def noun_lemma(token: Column, vocabulary: Iterable[str]) -> Column:
    """Shortest vocabulary entry among the token and its suffix rewrites, else the token.

    The vocabulary becomes literals; `operators.lexicon_scan.lemmatize` takes a table. The
    tokens that a rule can lead to an entry are known beforehand, so that one probe settles
    all others.
    """
    vocabulary = sorted(set(vocabulary))
    inflected = sorted({entry[:len(entry) - len(ending)] + suffix
                        for suffix, ending in NOUN_SUFFIXES
                        for entry in vocabulary if entry.endswith(ending)})
    # The longest net cut gives the shortest rewrite, so it is tried first.
    shortening = sorted((rule for rule in NOUN_SUFFIXES if len(rule[0]) > len(rule[1])),
                        key=lambda rule: len(rule[1]) - len(rule[0]))
    same_length = [rule for rule in NOUN_SUFFIXES if len(rule[0]) == len(rule[1])]

    def rewrite(suffix: str, ending: str) -> tuple[Column, Column]:
        stem = token.substr(F.lit(1), F.length(token) - len(suffix))
        candidate = F.concat(stem, F.lit(ending))
        return token.endswith(suffix) & candidate.isin(vocabulary), candidate

    chain = F.when(token.isNull(), token)
    for rule in shortening:
        chain = chain.when(*rewrite(*rule))
    for rule in same_length:
        hit, candidate = rewrite(*rule)
        chain = chain.when(hit & ~token.isin(vocabulary), candidate)
    return F.when(token.isin(inflected), chain.otherwise(token)).otherwise(token)


def lemmatize(tokens: Column | str, vocabulary: Iterable[str] = DEFAULT_NOUNS) -> Column:
    return F.transform(_col(tokens), lambda t: noun_lemma(t, vocabulary))


def bare_words(text: Column | str) -> Column:
    """Text with the words of `remove_punctuation(normalise_text(text))`, in one pass.

    White space is left as it is, at the ends too: it makes no word.
    """
    return F.regexp_replace(F.lower(null_text_to_empty(text)), NOT_LISTED, "")


def clean_tokens(text: Column | str, vocabulary: Iterable[str] = DEFAULT_NOUNS,
                 include_finance: bool = True) -> Column:
    """The words of `clean_text`."""
    kept = remove_stopwords(tokenize(bare_words(text)), include_finance=include_finance)
    return lemmatize(kept, vocabulary)


def clean_text(text: Column | str, vocabulary: Iterable[str] = DEFAULT_NOUNS,
               include_finance: bool = True) -> Column:
    return F.array_join(clean_tokens(text, vocabulary, include_finance), " ")


def contained_terms(text: Column | str, terms: Iterable[str]) -> Column:
    """Sorted array of the terms that are substrings of `text` (pass lower-cased text).

    Walks over the text once per term; `operators.lexicon_scan.contained_terms` takes a table
    and walks once. The text is bound to the row first: an expression inside the lambda would
    be evaluated again for every term.
    """
    literals = F.array(*[F.lit(t) for t in sorted(set(terms))])
    return F.transform(F.array(_col(text)), lambda own: F.filter(
        literals, lambda term: F.contains(own, term)))[0]


def finance_keywords(text: Column | str, keywords: Iterable[str] = FINANCE_KEYWORDS) -> Column:
    """Domain keywords occurring anywhere in the raw text, substrings included."""
    return contained_terms(F.lower(null_text_to_empty(text)), keywords)


def adjacent(words: Column | str, low: int = params.NGRAM_MIN,
             high: int = params.NGRAM_MAX) -> Column:
    """All n-grams (low <= n <= high) of a word array. Pass a column, not an expression: the
    array is read once per n."""
    words = _col(words)
    parts, gram = [], words
    for n in range(1, high + 1):
        if n > 1:
            gram = F.zip_with(gram, _from(words, n), lambda a, b: F.concat(a, F.lit(" "), b))
        if n >= low:
            # A shifted array is shorter; the grams running past the end are null.
            parts.append(F.array_compact(gram) if n > 1 else gram)
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def ngrams(tokens: Column | str, low: int = params.NGRAM_MIN,
           high: int = params.NGRAM_MAX) -> Column:
    """All n-grams of the tokens with at least two characters."""
    return adjacent(F.filter(_col(tokens), lambda t: F.length(t) >= 2), low, high)


def term_counts(df: DataFrame, terms: str, keep: list[str]) -> DataFrame:
    """Rows (keep, term, tf) from an array column, counted inside each input row.

    The array is sorted and run lengths are measured, so per-document counting needs no
    shuffle and only distinct terms leave the row. The sorted array and the run ends are
    columns of their own because both are read twice.
    """
    ordered = df.select(*keep, F.sort_array(terms).alias("_sorted"))
    ends = ordered.select(*keep, F.array_compact(F.transform(
        "_sorted", lambda term, i: F.when(
            ~F.get("_sorted", i + 1).eqNullSafe(term),
            F.struct(term.alias("term"), (i + 1).alias("seen"))))).alias("_ends"))
    counts = F.transform("_ends", lambda end, i: F.struct(
        end["term"].alias("term"),
        (end["seen"] - F.coalesce(F.get("_ends", i - 1)["seen"], F.lit(0))).cast("long")
        .alias("tf")))
    return ends.select(*keep, F.inline(counts))


def display_headline(text: Column | str, width: int = params.DISPLAY_WIDTH) -> Column:
    text = _col(text)
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("…"))) \
            .otherwise(text)


def valid_headline(text: Column | str, low: int = params.MIN_HEADLINE,
                   high: int = params.MAX_HEADLINE) -> Column:
    return F.coalesce(F.length(_col(text)).between(low, high), F.lit(False))
