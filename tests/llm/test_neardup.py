"""Near-duplicate classes against all pairs of small tables; estimator laws of signatures."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from marketlens.llm import neardup as nd


def bag(text):
    w = (text or "").encode().lower().split()
    if 0 < len(w) < 5:
        return Counter([tuple(w)])
    return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def jaccard(a, b):
    low = sum((a & b).values())
    return low / (sum(a.values()) + sum(b.values()) - low) if a and b else 0.0


def brute_classes(rows):
    """Smallest id of each row's class, by comparing all pairs that share a shingle."""
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    bags = [bag(t) for _, t in rows]
    sharing = defaultdict(list)
    for i, b in enumerate(bags):
        for s in b:
            sharing[s].append(i)
    seen = {(x, y) for own in sharing.values() for x in own for y in own if x < y}
    empty = defaultdict(list)
    for i, (_, t) in enumerate(rows):
        if not bags[i]:
            empty[t or ""].append(i)
    pairs = [(x, y) for x, y in seen if jaccard(bags[x], bags[y]) >= 0.8]
    pairs += [(own[0], i) for own in empty.values() for i in own[1:]]
    for x, y in pairs:
        parent[top(x)] = top(y)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[top(i)] = min(low.get(top(i), (True, 0)), (d is None, d or 0))
    return [None if low[top(i)][0] else low[top(i)][1] for i in range(len(rows))]


def signature_of(bags, slots):
    """Signatures of bags of words, through the text interface of one-word elements."""
    value = {w: nd._mix(np.array([hash(w) & (2**63 - 1)], np.uint64))[0]
             for b in bags for w in b}
    owner = [i for i, b in enumerate(bags) for _ in b]
    return nd.signatures(np.array(owner), np.array([value[w] for b in bags for w in b], np.uint64),
                         np.array([n for b in bags for n in b.values()]), len(bags), slots)


def test_collisions_estimate_weighted_jaccard():
    rng = random.Random(1)
    for _ in range(6):
        a = Counter({w: rng.choice([1, 1, 2, 3, 9, 40]) for w in range(30)})
        b = Counter({w: max(1, n + rng.choice([0, 0, 2, -1, -20])) for w, n in a.items()
                     if rng.random() < 0.85})
        sig = signature_of([a, b], 4000)
        assert abs((sig[0] == sig[1]).mean() - jaccard(a, b)) < 0.035


def test_signature_does_not_depend_on_company():
    a, b = Counter("abcdefg" * 3), Counter({"z": 100})
    assert (signature_of([a], 125)[0] == signature_of([b, a], 125)[1]).all()
    assert not (signature_of([a], 125) == 0).any()


def test_multiset_similarity():
    for x, y in [("a b c d e f g", "a b c d e f h"), ("a " * 40, "a " * 35), ("a b", "A  b"),
                 ("", ""), (None, "a")]:
        sets = [nd.multiset(*nd.shingles([t])) for t in (x, y)]
        assert abs(nd.similarity(*sets) - jaccard(bag(x), bag(y))) < 1e-12


def base_rows():
    rng = random.Random(7)
    words = ["w%d" % i for i in range(500)]
    rows = [(10, None), (11, ""), (12, None), (13, " \n"), (14, "one two"), (15, "ONE\ttwo"),
            (16, "one two three"), (None, "no id here"), (None, "No id here"), (17, "x " * 400),
            (17, "x " * 400), (18, "x " * 399), (19, "x " * 250)]
    for k in range(12):
        text = rng.choices(words, k=120)
        for copy in range(6):
            new = list(text)
            for _ in range(copy * 2):
                new[rng.randrange(len(new))] = rng.choice(words)
            rows.append((100 + 10 * k + copy, " ".join(new)))
    # A chain: neighbours are alike, the ends are not.
    chain = rng.choices(words, k=200)
    for step in range(8):
        rows.append((900 - step, " ".join(chain[8 * step:8 * step + 130])))
    return rows


def test_shared_counts(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype(np.uint64)
            for _ in range(9)]
    for columns in (4096, 7):
        monkeypatch.setattr(nd, "_COLUMNS", columns)
        for a, b in [(sets[:4], sets[4:]), (sets, sets), (sets[:1], sets[1:2])]:
            assert nd.shared_counts(a, b).tolist() == [
                [len(set(x.tolist()) & set(y.tolist())) for y in b] for x in a]


@pytest.mark.parametrize("block", [nd.BLOCK, 3])
def test_graded_near_copies(spark, block):
    """One text with one to twelve words changed: most copies are alike to a few others only."""
    rng = random.Random(8)
    text = ["t%d" % i for i in range(100)]
    rows = []
    for i in range(120):
        new = list(text)
        for at in rng.sample(range(100), 1 + i % 12):
            new[at] = f"n{i}"
        rows.append((i, " ".join(new)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in nd.assign(df, block=block).collect()}
    assert found == dict(enumerate(brute_classes(rows)))
    assert 5 < len(set(found.values())) < 115


def test_classes_against_all_pairs(spark):
    rows = base_rows()
    df = spark.createDataFrame([(d, t, "k") for d, t in rows],
                               "doc_id long, text string, node string")
    expected = Counter(((d, c) for (d, _), c in zip(rows, brute_classes(rows))))
    found = nd.assign(df).collect()
    got = Counter()
    for r in found:
        got[r["doc_id"], r["class_id"]] += r["copies"]
    assert got == expected
    left = nd.deduplicate(df)
    assert left.columns == df.columns
    kept = left.collect()
    classes = Counter(c for c in brute_classes(rows))
    assert len(kept) == len(classes)
    assert Counter(r["doc_id"] for r in kept) == Counter(dict.fromkeys(classes, 1))


def test_large_group_of_near_copies(spark):
    rng = random.Random(3)
    text = ["t%d" % i for i in range(90)]
    rows = [(0, " ".join(text))]
    for i in range(1, 400):
        new = list(text)
        new[rng.randrange(90)] = f"n{i}"
        rows.append((i, " ".join(new)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["class_id"], r["class_rows"]) for r in nd.assign(df).collect()} == {(0, 400)}


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)]
    edges += [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(50)]
    parent = {x: x for e in edges for x in e}

    def top(x):
        return x if parent[x] == x else top(parent[x])

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    out = nd.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in out} == {
        x: top(x) for a, b in edges if a != b for x in (a, b)}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert nd.assign(df).collect() == []
    assert nd.deduplicate(df).collect() == []


def test_one_of_all_repeated_rows_is_kept(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text), (2, text + " more"), (3, "another text of its own here")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    out = nd.op7_neardup(spark, str(tmp_path)).collect()
    assert len(out) == 4
    kept = [(r["class_id"], r["doc_id"]) for r in out if r["kept"]]
    assert sorted(kept) == [(1, 1), (3, 3)]


def test_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, long[:100])],
                                 "doc_id long, text string")
    out = {r["doc_id"]: r["class_id"] for r in nd.assign(docs).collect()}
    assert out == {1: 1, 2: 1, 3: 3}


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet")
            .select("doc_id", "text").collect()]
    expected = dict(zip([d for d, _ in rows], brute_classes(rows)))
    found = nd.op7_neardup(spark, sf_dir).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == expected
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in found)


def test_word_hashes_tell_words_apart():
    """By all bytes and the length, wherever a word stands and however long it is."""
    words = ["a", "aa", "a\0", "\0", "é", "w" * 8, "w" * 9, "w" * 16, "w" * 64, "w" * 65,
             "w" * 65 + "x", "x" * 200]
    blanks = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "  "]
    text = "".join(w + blanks[i % 7] for i, w in enumerate(words * 2))
    starts, hashes = nd.word_hashes(text.encode())
    assert hashes[:len(words)].tolist() == hashes[len(words):].tolist()
    assert len(set(hashes.tolist())) == len(words) == len(starts) / 2
    assert [len(x) for x in nd.word_hashes(b"")] == [0, 0]


def test_short_texts_take_few_rounds(monkeypatch):
    """One shingle fills all slots by itself, many points at a time and not one after another."""
    rounds = []
    mix = nd._mix
    monkeypatch.setattr(nd, "_mix", lambda x: rounds.append(1) or mix(x))
    sig = nd.signatures(*nd.shingles(["a b c d e"]), 1, nd.BANDS * nd.ROWS)
    assert (sig != 0).all() and len(rounds) < 200
