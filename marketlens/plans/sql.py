"""SQL twins of the derived views, and helpers to write twins of whole queries."""

from __future__ import annotations

from marketlens.functions.text import stop_words
from marketlens.lexicons import DEFAULT_NOUNS, FUSED_WORDS, NOUN_SUFFIXES
from marketlens.plans.tables import PHRASES, SHARPNESS


# The same character classes in RE2 syntax.
SPACES = r"[\t\n\x0B\f\r\x1C-\x1F ]"
EDGE_SPACES = (r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
               r"\x{202F}\x{205F}\x{3000}]")
NOT_ASCII = r"[^\x00-\x7F]"
NOT_WORD_OR_SPACE = r"[^a-zA-Z0-9\t\n\x0B\f\r\x1C-\x1F ]"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listing(words) -> str:
    return "[" + ", ".join(quote(w) for w in words) + "]"


def tuple_of(words) -> str:
    return "(" + ", ".join(quote(w) for w in words) + ")"


def _bars(source: str, ticker: str, day: str, cents: str, volume: str, order: list[str]) -> str:
    down = ", ".join(f"{c} DESC" for c in order)
    up = ", ".join(order)
    return f"""
    SELECT ticker, date, max(CASE WHEN a = 1 THEN c END) AS open, max(c) AS high,
           min(c) AS low, max(CASE WHEN z = 1 THEN c END) AS close,
           CAST(sum(q) AS BIGINT) AS volume
    FROM (SELECT {ticker} AS ticker, CAST({day} AS DATE) AS date,
                 CAST(round({cents} * 100) AS BIGINT) AS c, {volume} AS q,
                 row_number() OVER (PARTITION BY {ticker}, CAST({day} AS DATE) ORDER BY {up}) AS a,
                 row_number() OVER (PARTITION BY {ticker}, CAST({day} AS DATE) ORDER BY {down}) AS z
          FROM {source})
    GROUP BY ticker, date"""


def h(key: str) -> str:
    return (f"CAST(concat('0x', substring(md5(concat({key}, '|', CAST(id AS VARCHAR))), 1, 8))"
            " AS BIGINT)")


_PHRASE = "CASE CAST(event_id % 10 AS INT) " + " ".join(
    f"WHEN {i} THEN {quote(t)}" for i, t in enumerate(PHRASES)) + " END"


def normalise(text: str) -> str:
    stripped = (f"regexp_replace(lower(coalesce({text}, '')), "
                f"'^{EDGE_SPACES}+|{EDGE_SPACES}+$', '', 'g')")
    ascii_only = f"regexp_replace({stripped}, '{NOT_ASCII}', '', 'g')"
    return f"regexp_replace({ascii_only}, '{SPACES}+', ' ', 'g')"


def unpunctuated(text: str) -> str:
    return f"regexp_replace({text}, '{NOT_WORD_OR_SPACE}', '', 'g')"


def words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{SPACES}+'), lambda t: t <> '')"


def tokens(text: str) -> str:
    for fused, parts in FUSED_WORDS.items():
        text = f"regexp_replace({text}, '\\b{fused}\\b', '{parts}', 'g')"
    return words(text)


def without_stopwords(array: str) -> str:
    return (f"list_filter({array}, lambda t: length(t) > 1 AND "
            f"NOT list_contains({listing(stop_words())}, t))")


def lemma(token: str, vocabulary: str) -> str:
    """Shortest vocabulary entry among the token and its rewrites (written as a CASE)."""
    cases = []
    for suffix, ending in NOUN_SUFFIXES[1:7] + NOUN_SUFFIXES[8:] + NOUN_SUFFIXES[:1]:
        stem = f"concat(left({token}, length({token}) - {len(suffix)}), '{ending}')"
        cases.append(f"WHEN {token} LIKE '%{suffix}' AND list_contains({vocabulary}, {stem}) "
                     f"THEN {stem}")
    man = f"concat(left({token}, length({token}) - 3), 'man')"
    cases.append(f"WHEN {token} LIKE '%men' AND NOT list_contains({vocabulary}, {token}) "
                 f"AND list_contains({vocabulary}, {man}) THEN {man}")
    return f"CASE {' '.join(cases)} ELSE {token} END"


def clean(text: str) -> str:
    kept = without_stopwords(tokens(unpunctuated(normalise(text))))
    return (f"array_to_string(list_transform({kept}, lambda t: "
            f"{lemma('t', listing(sorted(DEFAULT_NOUNS)))}), ' ')")


def double(x: float) -> str:
    """Double literal; a bare 0.5 would be a decimal."""
    return f"{x!r}e0"


def decimal_round(x: str, digits: int) -> str:
    """Round a double by its decimal value; plain round() scales in binary first."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 17)), {digits}) AS DOUBLE)"


def values(rows) -> str:
    def cell(x):
        return quote(x) if isinstance(x, str) else double(x) if isinstance(x, float) else repr(x)
    return "VALUES " + ", ".join(
        "(" + ", ".join(cell(x) for x in row) + ")" for row in rows)


VIEWS = {
    "bars": _bars("lineitem", "l_suppkey", "l_shipdate", "l_extendedprice",
                  "CAST(l_quantity AS BIGINT)",
                  ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]),
    "ticks_bars": _bars("events", "user_id",
                        "ts", "value", "1", ["ts", "event_id"]),
    "headlines": f"""SELECT event_id AS id, user_id AS ticker, ts AS published_at,
                            concat_ws(' ', {_PHRASE}, text) AS title
                     FROM events LEFT JOIN (SELECT conv_id, text FROM conversations WHERE turn = 0)
                     ON conv_id = event_id % (SELECT max(conv_id) + 1 FROM conversations)""",
    "entries": """SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x,
                         generate_subscripts(embedding, 1) - 1 AS f, len(embedding) AS width
                  FROM embeddings""",
    "centroids": "SELECT label AS c, f, avg(x) AS m FROM entries GROUP BY ALL",
    "distances": """SELECT vec_id, c, 4 * f // width AS k, sum((x - m) * (x - m)) AS d
                    FROM entries JOIN centroids USING (f) GROUP BY ALL""",
    "sharpness": "SELECT * FROM (VALUES " + ", ".join(
        f"({k}, {quote(m)}, {b!r}e0)" for k, (m, b) in enumerate(SHARPNESS.items()))
        + ") AS t(k, model, b)",
    "vector_scores": "SELECT vec_id, model, " + ", ".join(
        f"coalesce(sum(exp(-d * b)) FILTER (c % 3 = {c}), 0) / sum(exp(-d * b)) AS {p}"
        for c, p in enumerate(["p_down", "p_neutral", "p_up"]))
        + " FROM distances JOIN sharpness USING (k) GROUP BY vec_id, model",
    "by_vector": """SELECT event_id AS id, event_id % (SELECT count(*) FROM embeddings) AS vec_id
                    FROM events""",
    "scores": """SELECT id, model, round(p_down, 4) AS p_down,
                        round(p_neutral, 4) AS p_neutral, round(p_up, 4) AS p_up
                 FROM by_vector JOIN vector_scores USING (vec_id)""",
    "outcomes": """SELECT id, label % 3 AS label FROM by_vector
                   JOIN embeddings USING (vec_id)""",
    "scored": """SELECT s.*, o.label,
                        CASE WHEN p_down >= p_neutral AND p_down >= p_up THEN 0
                             WHEN p_neutral >= p_up THEN 1 ELSE 2 END AS prediction
                 FROM scores s JOIN outcomes o USING (id)""",
    "returns": """SELECT *, lead(close) OVER (PARTITION BY ticker ORDER BY date) / nullif(close, 0) - 1
                            AS forward_return FROM {bars}""",
    "clean_docs": f"SELECT doc_id, lang, {clean('text')} AS clean_text FROM documents",
    "clean_words": f"""SELECT doc_id, w, pos FROM (
                         SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos
                         FROM (SELECT doc_id, {words('clean_text')} AS ws FROM clean_docs))""",
    "grams": """SELECT doc_id, unnest([w,
                   w || ' ' || lead(w) OVER (PARTITION BY doc_id ORDER BY pos),
                   w || ' ' || lead(w) OVER (PARTITION BY doc_id ORDER BY pos) || ' '
                     || lead(w, 2) OVER (PARTITION BY doc_id ORDER BY pos)]) AS term
                FROM clean_words""",
    "term_counts": """SELECT doc_id, term, count(*) AS tf FROM grams WHERE term IS NOT NULL
                      GROUP BY doc_id, term""",
}
NEEDS = {
    "centroids": ["entries"], "distances": ["entries", "centroids"],
    "vector_scores": ["distances", "sharpness"], "scores": ["by_vector", "vector_scores"],
    "outcomes": ["by_vector"],
    "scored": ["scores", "outcomes"], "clean_words": ["clean_docs"], "grams": ["clean_words"],
    "term_counts": ["grams"],
}


def twin(body: str, *views: str, **more: str) -> str:
    """`body` under a WITH clause of the named views, their prerequisites and `more`."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in NEEDS.get(name, []):
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in views:
        visit(name)
    parts = [f"{name} AS ({VIEWS[name]})" for name in ordered]
    parts += [f"{name} AS ({text})" for name, text in more.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


LABEL = ("CASE WHEN forward_return IS NULL THEN -1 WHEN forward_return > 0.01 THEN 2 "
         "WHEN forward_return < -0.01 THEN 0 ELSE 1 END")
LABEL_NAME = "CASE {0} WHEN 0 THEN 'DOWN' WHEN 1 THEN 'NEUTRAL' WHEN 2 THEN 'UP' END"


def returns(bars: str) -> str:
    return VIEWS["returns"].replace("{bars}", bars)


def labeled(bars: str) -> str:
    return f"SELECT * FROM (SELECT *, {LABEL} AS label FROM ({returns(bars)})) WHERE label >= 0"
