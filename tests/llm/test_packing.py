"""Packing against a search of all bins for each piece."""

import random
import re
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from marketlens.llm import neardup, packing

PIECE = st.tuples(st.integers(1, 20), st.sampled_from([None, "a", "b", "c", "d"]),
                  st.sampled_from([None, 1, 2, 3, 4, 5]))


def brute(pieces, capacity):
    bins, out = [], []
    for size, source, cluster in pieces:
        fit = [(b["room"], i) for i, b in enumerate(bins) if b["room"] >= size
               and not (source is not None and source in b["sources"])
               and not (cluster is not None and cluster in b["clusters"])]
        if not fit:
            bins.append({"room": capacity, "sources": set(), "clusters": set()})
        i = min(fit)[1] if fit else len(bins) - 1
        out.append((i, capacity - bins[i]["room"]))
        bins[i]["room"] -= size
        bins[i]["sources"].add(source)
        bins[i]["clusters"].add(cluster)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECE, max_size=60), st.booleans())
def test_tightest_compatible_bin(pieces, ordered):
    if ordered:
        pieces.sort(key=lambda p: -p[0])
    columns = list(map(list, zip(*pieces))) or [[], [], []]
    assert list(zip(*packing.best_fit(*columns, 20))) == brute(pieces, 20)


def check(rows, lengths, capacity):
    """All tokens are placed once, bins do not overflow or overlap, sources do not meet."""
    by_bin, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_bin[r["bin"]].append(r)
        by_doc[r["doc_id"]].append(r)
    assert set(by_doc) == {i for i, n in lengths.items() if n > 0}
    for i, own in by_doc.items():
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert sum(r["n_tokens"] for r in own) == lengths[i]
        assert all(r["start"] == capacity * k for k, r in enumerate(own))
    for own in by_bin.values():
        end = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["n_tokens"]
        assert end <= capacity
        sources = [r["source"] for r in own if r["source"] is not None]
        assert len(sources) == len(set(sources))


def test_groups_and_hot_source(spark):
    rng = random.Random(2)
    data = [(i, "hot" if i % 3 == 0 else f"s{rng.randint(0, 30)}", f"c{i % 200}",
             rng.randint(1, 250), "x") for i in range(1500)]
    df = spark.createDataFrame(
        data, "doc_id long, source string, cluster string, n_tokens long, bin string")
    rows = packing.pack(df, capacity=100, group_rows=100).collect()
    check(rows, {d[0]: d[3] for d in data}, 100)
    cluster = {d[0]: d[2] for d in data}
    held = defaultdict(list)
    for r in rows:
        held[r["bin"]].append(cluster[r["doc_id"]])
    assert all(len(c) == len(set(c)) for c in held.values())
    assert {tuple(r) for r in rows} == {
        tuple(r) for r in packing.pack(df, capacity=100, group_rows=100).collect()}


def test_edges(spark):
    schema = "doc_id long, source string, cluster string, n_tokens long"
    df = spark.createDataFrame([(None, None, None, 5), (1, None, None, None), (2, "a", None, 0),
                                (3, "a", "c", 10), (3, "a", "c", 10), (4, "b", "c", 3)], schema)
    rows = packing.pack(df, capacity=10).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in rows) == [
        (-1, 5), (3, 10), (3, 10), (4, 3)]
    assert packing.pack(df.limit(0)).collect() == []
    texts = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "x y\n\tz", None)],
                                  "doc_id long, text string, source string")
    assert {r["doc_id"]: r["n_tokens"] for r in packing.pack_documents(texts).collect()} == {
        1: 1, 2: 1, 3: 4}


def test_near_copies_never_share_a_bin(spark):
    rng = random.Random(4)
    rows = []
    for k in range(20):
        words = [f"w{rng.randint(0, 9999)}" for _ in range(60)]
        near = [*words[:-1], "other"]
        texts = [words, near, [*words, "É"], [*words, "é"]]
        rows += [(4 * k + i, "  ".join(t).upper() + "\n", f"s{4 * k + i}")
                 for i, t in enumerate(texts)]
    rows += [(100, None, "a"), (101, " \n", "b"), (102, "", "c"), (None, "one more", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed = packing.pack_documents(docs, capacity=2000).collect()
    assert len(placed) == len(rows)
    cluster = {i: i // 4 for i in range(80)} | {100: -1, 101: -1, 102: -1, None: None}
    held = defaultdict(list)
    for r in placed:
        held[r["bin"]].append(cluster[r["doc_id"]])
    assert all(len(c) == len(set(c)) for c in held.values())
    assert len(held) == 4


def test_query_keeps_near_duplicates_apart(spark, sf_dir):
    docs = neardup.table(spark, sf_dir, "documents")
    found = {r["doc_id"]: r["class_id"] for r in neardup.op7_neardup(spark, sf_dir).collect()}
    assert len(found) == docs.count() > len(set(found.values()))
    held = defaultdict(list)
    for r in packing.op8_packing(spark, sf_dir).collect():
        held[r["bin"]].append(found[r["doc_id"]])
    assert all(len(c) == len(set(c)) for c in held.values())


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    lengths = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) + 1 for r in docs}
    rows = packing.op8_packing(spark, sf_dir).collect()
    check(rows, lengths, packing.CAPACITY)
    text = {r["doc_id"]: " ".join(r["text"].split()).lower() for r in docs}
    held = defaultdict(list)
    for r in rows:
        held[r["bin"]].append(text[r["doc_id"]])
    assert all(len(t) == len(set(t)) for t in held.values())
