"""Near-duplicate classes by BagMinHash signatures, banding and exact verification.

A text is the multiset of its five-word shingles. Every shingle carries a Poisson process over
time and weight. Weights are discretised to whole numbers and split into levels (0, 1], (1, 2],
(2, 4], (4, 8] and so on, each with a process of its own whose rate is the level's width; a
point in a level that the multiset fills only in part has a position in it and counts if the
position is filled. The first point of each of the signature's slots then is the same in two
texts with a probability equal to their weighted Jaccard similarity.

Equal texts are one node. Nodes that agree in a whole band of slots are candidates: each meets
the leader of its bucket, drawn anew for every band. Verified pairs form components. What a
bucket still holds of different components after that is compared in blocks: a task gets two
blocks of one bucket with their multisets, counts shared elements with matrix products and
returns only the links that join components, fewer than it has members. So no pair of
candidates goes unchecked that is not joined already, and no pair is ever a row before it is
known to be a link or one of a member with its leader.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import stored, table

SHINGLE, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 shares no band with probability (1 - 0.8^5)^25 < 5e-5.
BANDS, ROWS = 25, 5
SEED = 11
#: Bytes of text whose signatures are drawn together.
_BATCH_BYTES = 1 << 20
#: Mean members in a block of a bucket, and elements compared at a time.
BLOCK, _COLUMNS = 512, 4096
#: Points that all processes of a batch draw together, at least, while enough are left.
_DRAWS = 1 << 14
_GOLD, _A, _B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9,
                                        0x94D049BB133111EB))


#: Which bytes are white space, and the masks of the first bytes of eight.
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of a word from which it is hashed alone.
_LONG_WORD = 64


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of every word of `data`, eight bytes of all words at a time."""
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = _BLANK[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edges[::2], edges[1::2]
    # The eight bytes from every place on, as one number.
    eight = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))
    value = (ends - starts).astype(np.uint64)
    at, left = starts, ends - starts
    short = np.arange(len(starts))
    for _ in range(_LONG_WORD // 8):
        part = eight[at] & _FIRST[np.minimum(left, 8)]
        value[short] = _mix(value[short] * _GOLD + part)
        more = left > 8
        short, at, left = short[more], at[more] + 8, left[more] - 8
        if not len(short):
            return starts, value
    # The few longer words one by one.
    value[short] = [xxhash.xxh3_64_intdigest(data[starts[i]:ends[i]]) for i in short]
    return starts, value


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, count), ordered by both, of all texts.

    Words are what stands between ASCII white space, A-Z lower-cased. A text of one to four
    words is one shingle; a text without words has none.
    """
    coded = [(text or "").encode("utf-8") for text in texts]
    begins = np.cumsum([0, *(len(text) + 1 for text in coded)])
    starts, words = word_hashes(b" ".join(coded).lower())
    lengths = np.diff(np.searchsorted(starts, begins))
    # Short texts are filled up with an empty word, which no text has.
    fill = np.where(lengths > 0, np.maximum(SHINGLE - lengths, 0), 0)
    if fill.any():
        words = np.insert(words, np.repeat(np.cumsum(lengths), fill), np.uint64(0))
    owner = np.repeat(np.arange(len(texts)), lengths + fill)
    n = len(words) - SHINGLE + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    value = words[:n].copy()
    for i in range(1, SHINGLE):
        value = value * _GOLD + words[i:i + n]
    inside = owner[:n] == owner[SHINGLE - 1:]
    owner, value = owner[:n][inside], _mix(value[inside])
    # Texts lie one after another, so each sorts its own stretch.
    ends = np.flatnonzero(owner[1:] != owner[:-1]) + 1
    for a, b in zip((0, *ends.tolist()), (*ends.tolist(), len(owner))):
        value[a:b].sort()
    new = np.ones(len(value), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    return owner[first], value[first], np.diff(np.append(first, len(value)))


def signatures(owner: np.ndarray, value: np.ndarray, count: np.ndarray, texts: int,
               slots: int, seed: int = SEED) -> np.ndarray:
    """Signature (texts x slots) of weighted sets; rows of texts without elements are 0."""
    best = np.full(texts * slots, np.inf)
    out = np.zeros(texts * slots, np.uint64)
    if not len(owner):
        return out.reshape(texts, slots)
    # One row per element and level that its count reaches into.
    top = np.ceil(np.log2(count)).astype(np.int64)
    row = np.repeat(np.arange(len(count)), top + 1)
    level = np.arange(len(row)) - np.repeat(np.cumsum(top + 1) - (top + 1), top + 1)
    below = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    width = np.maximum(below, 1)
    key = _mix(value[row] + level.astype(np.uint64) * _GOLD + np.uint64(seed))
    owner, count = owner[row], count[row]
    weight = np.bincount(owner, np.minimum(count - below, width), texts)
    # By this time all slots of a text have a point, but for a few texts, which go on longer.
    until = np.divide(slots * (math.log(slots) + 3), weight, out=np.zeros(texts),
                      where=weight > 0)
    time, turn = np.zeros(len(key)), np.zeros(len(key), np.uint64)
    active = np.arange(len(key))
    while len(active):
        while len(active):
            # When few processes are left they draw several points at a time.
            points = min(max(_DRAWS // len(active), 1), 256)
            turns = np.arange(1, points + 1, dtype=np.uint64)
            draw = _mix(key[active][:, None] + (turn[active][:, None] + turns) * _GOLD)
            uniform = (draw >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
            ahead = -np.log1p(-uniform) / width[active][:, None]
            ahead[:, 0] += time[active]
            np.cumsum(ahead, axis=1, out=ahead)
            on_time = ahead <= until[owner[active]][:, None]
            passed = on_time.sum(axis=1)
            moved = passed > 0
            time[active[moved]] = ahead[moved, passed[moved] - 1]
            turn[active] += passed.astype(np.uint64)
            draw, moment, own = draw[on_time], ahead[on_time], np.repeat(active, passed)
            active = active[passed == points]
            more = _mix(draw ^ _B)
            slot = ((more >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
            place = below[own] + 1 + ((more & np.uint64(0xFFFFFFFF)).astype(np.float64)
                                      * 2.0 ** -32 * width[own]).astype(np.int64)
            counts = place <= count[own]
            at, moment = owner[own][counts] * slots + slot[counts], moment[counts]
            np.minimum.at(best, at, moment)
            won = best[at] == moment
            out[at[won]] = draw[counts][won]
        late = (np.isinf(best.reshape(texts, slots)).any(axis=1)) & (weight > 0)
        until = np.where(late, until * 2, -1.0)
        active = np.flatnonzero(late[owner])
    return out.reshape(texts, slots)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One key per band; keys of different bands do not meet."""
    parts = sig.reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(rows):
        key = _mix(key * _GOLD + parts[:, :, i])
    return key.view(np.int64)


def multiset(owner: np.ndarray, value: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Hashes of one text's elements, the second and later copies under their own, sorted."""
    copy = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return np.sort(_mix(np.repeat(value, count) + copy.astype(np.uint64) * _GOLD))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two such arrays."""
    if not len(a) or not len(b):
        return 0.0
    both = np.concatenate([a, b])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared / (len(a) + len(b) - shared)


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts with about `_BATCH_BYTES` in each."""
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text or "") + 200
        if held >= _BATCH_BYTES:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def node_id(text: Column) -> Column:
    """Digest of a text; equal texts are one node, null is the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def sign(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, node, n, words, keys, carried columns): band keys of every row.

    `n` is the size of the multiset, `words` the number of words.
    """
    texts = docs.select("doc_id", node_id(docs["text"]).alias("node"), "text", *carry)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in _slices(texts):
                owner, value, count = shingles(texts[a:b])
                sig = signatures(owner, value, count, b - a, BANDS * ROWS)
                n = np.bincount(owner, count, b - a).astype(np.int64)
                # Texts of one to four words are one shingle, too.
                words = np.where(n > 1, n + SHINGLE - 1, 0)
                for i in np.flatnonzero(n == 1):
                    words[i] = len(texts[a + i].encode("utf-8").split())
                keys = [k if m else k[:0] for k, m in zip(band_keys(sig), n)]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n), pa.array(words),
                     pa.array(keys, pa.list_(pa.int64())), *part.columns[3:]],
                    ["doc_id", "node", "n", "words", "keys", *carry])

    number = F.lit(0).cast("long")
    schema = texts.select("doc_id", "node", number.alias("n"), number.alias("words"),
                          F.array().cast("array<long>").alias("keys"), *carry).schema
    return texts.mapInArrow(signed, schema)


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose multisets are similar enough."""
    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similarity(np.frombuffer(x.as_py(), np.uint64),
                               np.frombuffer(y.as_py(), np.uint64)) >= least
                    for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    both = (pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
            .select("a", "b", "set_a", "set_b"))
    return both.mapInArrow(checked, pairs.select("a", "b").schema)


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, set) of the given nodes (node, id), where `id` is one document of the node.

    The id is part of the key, so that the copies of a hot text do not meet.
    """
    wanted = (docs.select(node_id(docs["text"]).alias("node"),
                          F.coalesce(docs["doc_id"], F.lit(-1)).alias("id"), "text")
              .join(nodes, ["node", "id"], "left_semi").dropDuplicates(["node", "id"]))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sets = batch.column(2).to_pylist(), []
            for a, b in _slices(texts):
                parts = shingles(texts[a:b])
                cuts = np.searchsorted(parts[0], np.arange(b - a + 1)).tolist()
                sets += [multiset(*(x[i:j] for x in parts)).tobytes()
                         for i, j in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())],
                                             ["node", "set"])

    return wanted.mapInArrow(made, "node binary, set binary")


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Elements that each of `a` shares with each of `b`; elements are distinct in each."""
    values = np.concatenate([*a, *b])
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    _, place, often = np.unique(values, return_inverse=True, return_counts=True)
    # Elements of one set only cannot be shared.
    number = np.cumsum(often > 1) - 1
    kept = often[place] > 1
    row, place = row[kept], number[place[kept]]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    total = np.zeros((len(a), len(b)))
    for start in range(0, int(place[-1]) + 1 if len(place) else 0, _COLUMNS):
        part = slice(*np.searchsorted(place, [start, start + _COLUMNS]))
        held = np.zeros((len(a) + len(b), _COLUMNS), np.float32)
        held[row[part], place[part] - start] = 1
        total += held[:len(a)] @ held[len(a):].T
    return total


def _joining(pairs: Iterator[tuple[int, int]], roots: list[bytes]) -> Iterator[tuple[int, int]]:
    """Those of `pairs` that join two components, given each member's component so far."""
    parent = {r: r for r in roots}

    def top(r: bytes) -> bytes:
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        return r

    for x, y in pairs:
        p, q = top(roots[x]), top(roots[y])
        if p != q:
            parent[p] = q
            yield x, y


def _links_in_blocks(members: DataFrame, sets: DataFrame, least: float, block: int) -> DataFrame:
    """Links (a, b) between components inside the buckets of `members` (key, node, root, size).

    Every two blocks of a bucket meet in one task of bounded size.
    """
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (members.withColumn("blocks", blocks).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("key", F.least("own", "other").alias("i"),
                     F.greatest("own", "other").alias("j"), "own", "node", "root"))

    def linked(rows: pa.Table) -> pa.Table:
        first = rows["i"][0].as_py()
        own = rows["own"].to_numpy()
        nodes, roots = rows["node"].to_pylist(), rows["root"].to_pylist()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in rows["set"]]
        left = np.flatnonzero(own == first)
        right = left if rows["j"][0].as_py() == first else np.flatnonzero(own != first)
        found = []
        if len(left) and len(right):
            shared = shared_counts([sets[x] for x in left], [sets[y] for y in right])
            n = np.array([len(x) for x in sets])
            alike = shared / (n[left][:, None] + n[right][None, :] - shared) >= least
            found = list(_joining(((left[x], right[y]) for x, y in zip(*np.nonzero(alike))),
                                  roots))
        return pa.table({side: pa.array([nodes[pair[k]] for pair in found], pa.binary())
                         for k, side in enumerate("ab")})

    return (dealt.join(sets, "node").groupBy("key", "i", "j")
            .applyInArrow(linked, "a binary, b binary"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): the smallest node it is connected to.

    Alternates two star steps until nothing changes: larger neighbours move to the smallest
    neighbour, then smaller ones do. Every step is an aggregate and a join on edges, so a node
    with many neighbours is combined map-side and split by the join.
    """
    edges = stored(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        ways = edges.union(edges.select("b", "a"))
        low = ways.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = (ways.join(low, "a").where("b > a").select(F.col("b").alias("a"),
                                                           F.col("low").alias("b")))
        large = stored(large.where("a <> b").distinct(), "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (large.join(low, "a").where("b <> low")
                 .select(F.col("b").alias("a"), F.col("low").alias("b"))
                 .union(low))
        edges = stored(small.where("a <> b").distinct(), "small-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select("b", "b").distinct())
        before = now


def classify(docs: DataFrame, least: float = SIMILARITY,
             block: int = BLOCK, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, node, words) of all documents and the class (node, root) of each node.

    Null texts count as empty; texts without words are alike only if equal. Ids may be null or
    repeat. Only doc_id, text and the columns of `carry`, which the rows keep, are read.
    """
    rows = stored(sign(docs, carry), "signatures")
    nodes = rows.groupBy("node").agg(
        F.first("n").alias("n"), F.first("keys").alias("keys"),
        F.min(F.coalesce("doc_id", F.lit(-1))).alias("id"))
    listed = stored(nodes.select("node", "id", "n", F.explode("keys").alias("key")), "bands")
    draw = F.xxhash64("key", "node")
    heads = (listed.groupBy("key").agg(
        F.count("*").alias("size"), F.min_by("node", draw).alias("head"),
        F.min_by("n", draw).alias("head_n")).where("size > 1"))
    members = stored(listed.join(heads, "key"), "buckets")

    def near(x: str, y: str) -> Column:
        """Multisets of too different a size cannot be similar enough."""
        return F.least(x, y) >= F.greatest(x, y) * least - 1e-9

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"),
                            F.greatest("a", "b").alias("b")).distinct()

    first = (ordered(members.where((F.col("node") != F.col("head")) & near("n", "head_n"))
                           .select(F.col("node").alias("a"), F.col("head").alias("b"))))
    sets = stored(_sets(docs, members.select("node", "id").distinct()), "multisets")
    links = stored(_verified(first, sets, least), "links")
    joined = components(links)

    # Buckets whose members are not of one component yet; of two members one is the leader.
    placed = members.where("size > 2").join(joined, "node", "left").select(
        "key", "node", "size", F.coalesce("root", "node").alias("root"))
    mixed = (placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"))
             .where("x <> y").select("key"))
    found = stored(_links_in_blocks(placed.join(mixed, "key"), sets, least, block),
                   "more-links")
    if not found.isEmpty():
        joined = components(links.union(found))
    classes = (rows.select("node").distinct().join(joined, "node", "left")
               .select("node", F.coalesce("root", "node").alias("root")))
    return rows.select("doc_id", "node", "words", *carry), classes


def assign(docs: DataFrame, least: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(doc_id, node, class_id, class_rows, kept) of every row.

    The class id is the smallest doc_id in the class. Exactly one row of a class is kept: one
    with that id, of the smallest digest; `copies` tells how many rows are alike even in id
    and text, of which one stays. Texts are compared whole, at any length. An empty table gives
    no rows.
    """
    rows, classes = classify(docs, least, block)
    # Copies of one text and id are counted first, so a hot text meets its class as few rows.
    held = (rows.groupBy("doc_id", "node").agg(F.count("*").alias("copies"))
            .join(classes, "node"))
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node"))
    # A table of its own, so that the join with a hot class can be split.
    held = stored(held, "class-rows")
    heads = stored(held.groupBy("root").agg(
        smallest.alias("head"), F.sum("copies").alias("class_rows")), "class-heads")
    return stored(held.join(heads, "root").select(
        "doc_id", "node", F.col("head.doc_id").alias("class_id"), "class_rows", "copies",
        (F.col("head.doc_id").eqNullSafe(F.col("doc_id"))
         & (F.col("head.node") == F.col("node"))).alias("kept")), "classes")


def deduplicate(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """`docs` with one row of each class, all columns as they were."""
    kept = assign(docs, least).where("kept").select(
        F.col("node").alias("__kept"), F.col("doc_id").alias("__id"), "copies")
    keyed = docs.withColumn("__node", node_id(docs["text"]))
    same = [F.col("__node") == F.col("__kept"), docs["doc_id"].eqNullSafe(F.col("__id"))]
    once = keyed.join(kept.where("copies = 1").drop("copies"), same, "left_semi")
    again = (keyed.join(kept.where("copies > 1").drop("copies"), same, "left_semi")
             .dropDuplicates(["__node", "doc_id"]))
    return once.unionByName(again).select(*docs.columns)


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document, its size, and whether the document stays."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")
    # Of rows that are alike even in id and text, the first stays.
    return assign(docs).select("doc_id", "class_id", "class_rows", "kept", copies).withColumn(
        "kept", F.col("kept") & (F.col("copy") == 1))
