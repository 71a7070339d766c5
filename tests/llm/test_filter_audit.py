"""Filter audit against brute force and SQL."""

import random
import re
from itertools import permutations

import duckdb

from marketlens.llm import filter_audit as fa

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    low = {}
    for i, text, _ in docs:
        if i is not None:
            low[text or ""] = min(i, low.get(text or "", i))
    parts = {}
    for i, text, lang in docs:
        text = text or ""
        words = WORD.findall(text)
        failed = "".join(f for f, bad in (
            ("A", len(words) < 100), ("B", 100 * len(set(words)) < 80 * len(words)),
            ("C", 100 * len(re.findall("[A-Z]", text)) > 10 * len(text)),
            ("D", bool(re.search("[#$%&*|]", text))),
            ("E", i is not None and i > low[text])) if bad)
        parts.setdefault(lang or "", []).append((failed, i in good, i in toxic))
    rows = set()
    for part, kinds in parts.items():
        out, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, start=1):
                c = dict.fromkeys(fa.COUNTERS, 0)
                for failed, is_good, is_toxic in kinds:
                    before = bool(set(order[:step - 1]) & set(failed))
                    removed = f in failed and not before
                    c["kept"] += not before and f not in failed
                    c["removed"] += removed
                    c["redundant"] += f in failed and before
                    c["unique_fails"] += failed == f
                    c["good_lost"] += removed and is_good
                    c["toxic_lost"] += removed and is_toxic
                shapley[f] += c["removed"]
                out.append((order, step, f, tuple(c.values())))
        rows |= {(part, o, s, *c, shapley[f]) for o, s, f, c in out}
    return rows


def tables(spark, docs, labels):
    d = spark.createDataFrame([(i, t, g, "x", 1) for i, t, g in docs],
                              "doc_id long, text string, lang string, mask string, n int")
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_brute_force(spark):
    rng = random.Random(3)
    long_words = [f"w{i}" for i in range(150)]
    texts = [None, "", "  \t", " ".join(long_words), " ".join(long_words[:120]) + " A#",
             "x " * 200, "ABC DEF", "p $ q", " ".join(long_words).upper(), "ÄÖ " * 3,
             " ".join(long_words) * 400]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["en", "", None, "de"]))
            for _ in range(300)]
    docs += docs[:20]  # repeated rows
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 40, 2)]
    labels += [(2, 1, 1), (None, 1, 1), (999, 1, 1)]
    d, l = tables(spark, docs, labels)
    got = {tuple(r) for r in fa.audit(fa.mask_counts(d, l)).collect()}
    assert got == brute(docs, labels)


def test_hot_copies_and_fields():
    # A sum far above 32 bits stays in its field.
    n = 10 ** 15
    counts = fa.unpacked(n * fa.packed(0b10001, True, False) + fa.packed(0b00001, True, True))
    assert counts.max() == n + 1 and (counts[:, 5] <= 1).all()
    assert fa.packed(31, True, True) < 1 << (8 * 8 * 600 * 6)


def test_empty(spark):
    d, l = tables(spark, [], [])
    assert fa.audit(fa.mask_counts(d, l)).collect() == []
    d, _ = tables(spark, [(1, "a", None)], [])
    assert len(fa.audit(fa.mask_counts(d, l)).collect()) == 600


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    df = fa.op11_filter_audit(spark, sf_dir)
    result = con.execute(fa.OP11_SQL)
    names = [c[0] for c in result.description]
    assert names == df.columns
    assert sorted(result.fetchall()) == sorted(tuple(r) for r in df.collect())
