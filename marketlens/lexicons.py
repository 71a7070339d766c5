"""Word lists. The class lexicon is a parameter: `DEFAULT_LEXICON` is a small starter set
and callers pass their own rows, or a table of any size, to get their own scores."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# English stop words that can survive punctuation removal.
ENGLISH_STOP_WORDS = (
    "a about above after again against ain all am an and any are aren as at be because "
    "been before being below between both but by can couldn d did didn do does doesn "
    "doing don down during each few for from further had hadn has hasn have haven having "
    "he her here hers herself him himself his how i if in into is isn it its itself just "
    "ll m ma me mightn more most mustn my myself needn no nor not now o of off on once "
    "only or other our ours ourselves out over own re s same shan she should shouldn so "
    "some such t than that the their theirs them themselves then there these they this "
    "those through to too under until up ve very was wasn we were weren what when where "
    "which while who whom why will with won wouldn y you your yours yourself yourselves"
).split()

# Domain stop words.
FINANCE_STOP_WORDS = (
    "stock market share shares company inc corp ltd said today also new year quarter"
).split()

# Domain keywords, matched as substrings.
FINANCE_KEYWORDS = [
    "earnings", "revenue", "profit", "loss", "dividend", "merger", "acquisition", "ipo",
    "bankruptcy", "regulation", "inflation", "recession", "bull", "bear", "rally", "crash",
    "volatility", "growth", "decline", "upgrade", "downgrade", "buyback", "guidance",
    "forecast", "target", "overweight", "underweight", "sec", "fed", "interest rate", "gdp",
    "cpi", "unemployment", "hedge", "short", "squeeze", "options", "derivatives",
]

# Words that add a fixed bonus in the heuristic scorer.
STRONG_BULLISH = (
    "record beat beats beating exceeded soar soars surge surges rally rallies breakthrough "
    "skyrocket"
).split()
STRONG_BEARISH = (
    "crash plunge collapse bankruptcy crisis fraud scandal lawsuit recession default"
).split()

# Words the tokenizer splits in two.
FUSED_WORDS = {
    "cannot": "can not",
    "gonna": "gon na",
    "gotta": "got ta",
    "wanna": "wan na",
    "gimme": "gim me",
    "lemme": "lem me",
}

# Noun suffix rewrites, tried against a vocabulary.
NOUN_SUFFIXES = [
    ("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"),
    ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"),
]

# Starter noun vocabulary for lemmatisation; pass your own for real corpora.
DEFAULT_NOUNS = (
    "analyst bank bond chip chain cost crisis debt dividend earning estimate fee forecast "
    "gain index investor lawsuit loss margin merger option outlook penny price probe profit "
    "rate regulator result retailer risk sale sector share talk tax trade woman"
).split()


@dataclass(frozen=True)
class Lexicon:
    """Rows of (term, class, polarity, subjectivity); a term may sit in several classes.

    For lists that belong in a plan as literals. The operators that take a `Lexicon` take a
    table of the same columns just as well (see `operators.lexicon_scan`).
    """

    rows: tuple[tuple[str, str, float, float], ...] = field(default_factory=tuple)

    SCHEMA = T.StructType([
        T.StructField("term", T.StringType(), False),
        T.StructField("class", T.StringType(), False),
        T.StructField("polarity", T.DoubleType(), False),
        T.StructField("subjectivity", T.DoubleType(), False),
    ])

    def terms(self, label: str) -> list[str]:
        return sorted({term for term, cls, _, _ in self.rows if cls == label})

    def weights(self) -> dict[str, tuple[float, float]]:
        """term -> (polarity, subjectivity); the first class in sort order wins."""
        weights: dict[str, tuple[float, float]] = {}
        for term, _, polarity, subjectivity in sorted(self.rows):
            weights.setdefault(term, (polarity, subjectivity))
        return weights

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.SCHEMA)


def _rows(label: str, weight: float, subjectivity: float, words: str):
    return tuple((w.replace("_", " "), label, weight, subjectivity) for w in words.split())


# Independently written starter lexicon; weights are eighths so that sums are exact.
DEFAULT_LEXICON = Lexicon(
    _rows("bullish", 0.75, 0.5, "surge soar rally record breakthrough beats")
    + _rows("bullish", 0.5, 0.375, "profit growth upgrade raised raising doubled accelerates")
    + _rows("bullish", 0.25, 0.25, "climb dividend buyback revenue strong")
    + _rows("bearish", -0.75, 0.625, "plunge crash fraud collapse bankruptcy lawsuit")
    + _rows("bearish", -0.5, 0.5, "loss losses weak warning downgrade probe fall")
    + _rows("bearish", -0.25, 0.375, "risk widen sell-off uncertainty")
    + _rows("neutral", 0.0, 0.125, "unchanged steady in-line mild hold holds guidance sector "
                                   "estimates outlook no_change waits")
)

# Starter valence table for the rule-based scorer (scale -4..4), plus modifiers.
DEFAULT_VALENCE = {
    "surge": 2.5, "record": 1.5, "profit": 2.0, "beats": 2.0, "growth": 2.0, "strong": 2.0,
    "upgrade": 1.5, "raised": 1.0, "doubled": 1.5, "plunge": -2.5, "weak": -2.0,
    "losses": -2.0, "fraud": -3.0, "lawsuit": -2.0, "risk": -1.5, "warning": -1.5,
    "fall": -1.5, "mild": 0.5, "confirm": 1.0, "rival": -0.5,
}
# Modifier words of the published valence-scoring rules.
INTENSIFIERS = (
    "absolutely amazingly completely considerably decidedly deeply enormously entirely "
    "especially exceptionally extremely fully greatly highly hugely incredibly intensely "
    "more most particularly purely quite really remarkably so substantially thoroughly "
    "totally tremendously unbelievably unusually utterly very"
).split()
DAMPENERS = (
    "almost barely hardly less little marginally occasionally partly scarcely slightly "
    "somewhat"
).split()
NEGATIONS = (
    "aint arent cannot cant couldnt darent didnt doesnt dont hadnt hasnt havent isnt mightnt "
    "mustnt neednt neither never no none nope nor not nothing nowhere oughtnt rarely seldom "
    "shant shouldnt wasnt werent without wont wouldnt"
).split()
