"""Multiclass second-order gradient boosting on binned features.

Features are cut into bins once and the binned rows are stored. A level of all classes' trees
is one job: every partition adds up gradients and Hessians of the softmax loss by class, node,
feature and bin; the sums meet by class, node and a few features, where the best split is
found; only splits come back to the driver. Nothing of the size of the rows or of the
histograms ever does.

A row's margins follow from the finished trees. A worker remembers the margins of the
partitions it has seen and adds the newest trees only; one that has not, say after a loss,
computes them from all trees, with the same result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens import params
from marketlens.operators.arrays import matrix, pack, unpack
from marketlens.operators.token_arrays import append_columns
from marketlens.sources.workspace import new_path

BINS = 32
#: Features per split search, and per aggregation of quantiles.
SPLIT_FEATURES, QUANTILE_FEATURES = 16, 256
#: Bytes of binned features in a partition.
PARTITION_BYTES = 16 << 20
_remembered: dict[tuple[str, int], tuple[int, np.ndarray]] = {}


class Tree:
    """A complete binary tree in heap order; feature -1 marks a leaf."""

    def __init__(self, depth: int) -> None:
        n = 2 ** (depth + 1) - 1
        self.feature = np.full(n, -1, np.int32)
        self.bin = np.zeros(n, np.int32)
        self.value = np.zeros(n)

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """Node of every row of binned features."""
        node = np.zeros(len(bins), np.int64)
        while True:
            inner = np.flatnonzero(self.feature[node] >= 0)
            if not len(inner):
                return node
            at = node[inner]
            right = bins[inner, self.feature[at]] > self.bin[at]
            node[inner] = 2 * at + 1 + right


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def bin_cuts(rows: DataFrame, x: str, size: int, bins: int = BINS) -> list[np.ndarray]:
    """Upper bounds of the bins of each feature but the last bin, from approximate quantiles."""
    shares = [i / bins for i in range(1, bins)]
    cuts = []
    for start in range(0, size, QUANTILE_FEATURES):
        some = range(start, min(start + QUANTILE_FEATURES, size))
        row = rows.agg(*[F.percentile_approx(F.get(x, F.lit(i)), shares, 10_000).alias(f"q{i}")
                         for i in some]).first()
        high = rows.agg(*[F.max(F.get(x, F.lit(i))).alias(f"q{i}") for i in some]).first()
        for i in some:
            found = np.unique(row[f"q{i}"] or [])
            cuts.append(found[found < high[f"q{i}"]] if len(found) else found)
    return cuts


def to_bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(x.shape, np.uint8)
    for j, own in enumerate(cuts):
        if len(own):
            out[:, j] = np.searchsorted(own, x[:, j], side="left")
    return out


def best_split(g: np.ndarray, h: np.ndarray, reg: float, min_weight: float
               ) -> tuple[float, int, int, float, float]:
    """(gain, feature, bin, left G, left H) of histograms (feature x bin); ties go to the
    first feature and bin."""
    left_g, left_h = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
    all_g, all_h = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True)
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = (left_g ** 2 / (left_h + reg) + right_g ** 2 / (right_h + reg)
            - all_g ** 2 / (all_h + reg))
    gain = np.where((left_h >= min_weight) & (right_h >= min_weight), gain, -np.inf)
    # Sums come in any order; gains that differ by less than that do not decide.
    gain = np.round(gain, 9)
    at = int(np.argmax(gain))
    f, b = divmod(at, gain.shape[1])
    return float(gain[f, b]), f, b, float(left_g[f, b]), float(left_h[f, b])


class BoostedTreesModel(Transformer, HasInputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted trees; appends `probability` as a vector column."""

    trees = Param(Params._dummy(), "trees", "packed arrays", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol=None, trees=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @property
    def arrays(self) -> dict[str, np.ndarray]:
        """feature, cut and value (round x class x node), gains per feature, used features."""
        return unpack(self.getOrDefault("trees"))

    @property
    def featureImportances(self) -> np.ndarray:
        """Share of each feature in the total gain."""
        gains = self.arrays["gains"]
        return gains / gains.sum() if gains.sum() else gains

    def _transform(self, dataset: DataFrame) -> DataFrame:
        packed = self.getOrDefault("trees")
        used = [int(i) for i in self.arrays["used"]]
        x = vector_to_array(self.getInputCol())
        # Only features that some tree asks for leave the JVM.
        asked = F.array(*[F.get(x, F.lit(i)) for i in used]) if used else F.array(F.lit(0.0))
        found = append_columns(dataset, [asked], [
            T.StructField("_probability", T.ArrayType(T.DoubleType()))], _probabilities(packed))
        return found.withColumn("probability", array_to_vector("_probability")).drop("_probability")


def _probabilities(packed: str):
    held = []

    def scored(given: list[pa.Array]) -> list[pa.Array]:
        if not held:
            model = unpack(packed)
            place = {int(f): i for i, f in enumerate(model["used"])}
            held.append((model, np.vectorize(lambda f: place.get(int(f), -1), otypes=[np.int64])(
                model["feature"])))
        (model, feature), x = held[0], matrix(given[0])
        margins = np.zeros((len(x), feature.shape[1]))
        for r in range(feature.shape[0]):
            for c in range(feature.shape[1]):
                own, node = feature[r, c], np.zeros(len(x), np.int64)
                while True:
                    inner = np.flatnonzero(own[node] >= 0)
                    if not len(inner):
                        break
                    at = node[inner]
                    left = x[inner, own[at]] <= model["cut"][r, c, at]
                    node[inner] = 2 * at + 2 - left
                margins[:, c] += model["value"][r, c, node]
        return [pa.array(list(softmax(margins)), pa.list_(pa.float64()))]

    return scored


def fit_boosting(train: DataFrame, features: str = "features", label: str = "label",
                 rounds: int = 500, depth: int = 6, rate: float = 0.1, rows: float = 0.8,
                 columns: float = 0.8, reg: float = 1.0, min_weight: float = 1.0,
                 bins: int = BINS, seed: int = params.SEED,
                 losses: list[float] | None = None) -> BoostedTreesModel:
    """Softmax boosting of one tree per class and round.

    Every round draws a share `rows` of the rows and every tree a share `columns` of the
    features. Splits gain by the second-order rule with the penalty `reg`, and both sides need
    a Hessian of `min_weight`. `losses`, if given, receives the mean log-loss on all rows
    before each round and at the end. Rows without a label are left out.
    """
    spark, classes = train.sparkSession, len(params.CLASSES)
    known = train.where(F.col(label).isNotNull()).select(
        F.col(label).cast("int").alias("label"),
        vector_to_array(features).alias("x"))
    source = new_path(spark, "boosting-rows")
    # What decides whether a row is drawn is its content, so that no run depends on row order.
    known.withColumn("key", F.xxhash64("label", "x")).write.parquet(source)
    known = spark.read.parquet(source)
    first = known.first()
    if first is None:
        raise ValueError("no labelled rows")
    size = len(first["x"])
    cuts = bin_cuts(known, "x", size, bins)
    path = new_path(spark, "boosting-bins")

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = to_bins(matrix(batch.column(1)), cuts) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([r.tobytes() for r in out],
                                                            pa.binary())],
                ["label", "key", "bins"])

    known.select("label", "x", "key").mapInArrow(
        binned, "label int, key long, bins binary").write.parquet(path)
    # A task per so many bytes: a job of this loop costs more than a small partition's work.
    table = spark.read.parquet(path).coalesce(max(1, known.count() * size // PARTITION_BYTES))
    # Without anything to split on, one feature still gives the roots their sums.
    split_on = [j for j in range(size) if len(cuts[j])] or list(range(min(size, 1)))
    fit_id, done, gains = uuid.uuid4().hex, [], np.zeros(size)
    for r in range(rounds):
        rng = np.random.default_rng([seed, r])
        width = max(1, round(columns * len(split_on))) if split_on else 0
        chosen = [np.sort(rng.choice(split_on, width, replace=False)) for _ in range(classes)] \
            if width else [np.empty(0, np.int64)] * classes
        trees = [Tree(depth) for _ in range(classes)]
        finished = spark.sparkContext.broadcast(list(done))
        open_nodes = [[0] for _ in range(classes)]
        totals: dict[tuple[int, int], tuple[float, float]] = {}
        for level in range(depth):
            if not any(open_nodes) or not width:
                break
            found = _level(table, fit_id, finished, trees, open_nodes, chosen, r, rows, seed,
                           size, bins, reg, min_weight).collect()
            best: dict[tuple[int, int], tuple] = {}
            for s in found:
                at = s["cls"], s["node"]
                totals.setdefault(at, (s["g"], s["h"]))
                order = (-s["gain"], s["feature"], s["bin"])
                if s["gain"] > 1e-9 and (at not in best or order < best[at][0]):
                    best[at] = order, s
            open_nodes = [[] for _ in range(classes)]
            for (c, node), (_, s) in sorted(best.items()):
                trees[c].feature[node], trees[c].bin[node] = s["feature"], s["bin"]
                gains[s["feature"]] += s["gain"]
                for side, (g, h) in enumerate(((s["left_g"], s["left_h"]),
                                               (s["g"] - s["left_g"], s["h"] - s["left_h"]))):
                    child = 2 * node + 1 + side
                    totals[c, child] = g, h
                    open_nodes[c].append(child)
        for (c, node), (g, h) in totals.items():
            trees[c].value[node] = -rate * g / (h + reg)
        done.append(trees)
        finished.unpersist()
        if losses is not None:
            losses.append(_loss(table, fit_id, spark.sparkContext.broadcast(list(done)), size))
    return BoostedTreesModel(inputCol=features, trees=_packed(done, cuts, gains, classes, depth))


def _packed(done: list[list[Tree]], cuts: list[np.ndarray], gains: np.ndarray, classes: int,
            depth: int) -> str:
    shape = (len(done), classes, 2 ** (depth + 1) - 1)
    feature, cut, value = np.full(shape, -1, np.int32), np.zeros(shape), np.zeros(shape)
    for r, trees in enumerate(done):
        for c, tree in enumerate(trees):
            feature[r, c], value[r, c] = tree.feature, tree.value
            for node in np.flatnonzero(tree.feature >= 0):
                cut[r, c, node] = cuts[tree.feature[node]][tree.bin[node]]
    return pack(feature=feature, cut=cut, value=value, gains=gains,
                used=np.unique(feature[feature >= 0]).astype(np.int64))


def _partition(batches: Iterator[pa.RecordBatch], size: int
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(labels, keys, bins) of a whole partition."""
    labels, keys, bins = [], [], []
    for batch in batches:
        if batch.num_rows:
            labels.append(batch.column("label").to_numpy())
            keys.append(batch.column("key").to_numpy())
            bins.append(np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8)
                        .reshape(-1, size))
    if not labels:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, size), np.uint8)
    return np.concatenate(labels), np.concatenate(keys), np.concatenate(bins)


def _margins(fit_id: str, bins: np.ndarray, done: list[list[Tree]]) -> np.ndarray:
    """Margins (row x class) of the partition at hand under the finished trees."""
    key = fit_id, TaskContext.get().partitionId()
    applied, margins = _remembered.get(key, (0, None))
    if margins is None or len(margins) != len(bins) or applied > len(done):
        applied, margins = 0, np.zeros((len(bins), len(params.CLASSES)))
    for trees in done[applied:]:
        margins = margins + np.stack([t.value[t.leaves(bins)] for t in trees], axis=1)
    for old in [k for k in _remembered if k[0] != fit_id]:
        del _remembered[old]
    _remembered[key] = len(done), margins
    return margins


def _drawn(keys: np.ndarray, seed: int, turn: int, share: float) -> np.ndarray:
    """Which rows take part in a round: a hash of the row's key and the round."""
    x = keys.astype(np.uint64) ^ np.uint64((seed * 1_000_003 + turn * 7919 + 1) & (2 ** 63 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(np.float64) * 2.0 ** -53 < share


def _level(table: DataFrame, fit_id: str, finished, trees: list[Tree],
           open_nodes: list[list[int]], chosen: list[np.ndarray], turn: int, share: float,
           seed: int, size: int, bins: int, reg: float, min_weight: float) -> DataFrame:
    """The best split of every open node in every group of features, with the node's sums."""
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, keys, binned = _partition(batches, size)
        if not len(labels):
            return
        p = softmax(_margins(fit_id, binned, finished.value))
        drawn = _drawn(keys, seed, turn, share)
        labels, binned, p = labels[drawn], binned[drawn], p[drawn]
        out = []
        for c, nodes in enumerate(open_nodes):
            if not nodes:
                continue
            place = np.full(len(trees[c].feature), -1)
            place[nodes] = np.arange(len(nodes))
            at = place[trees[c].leaves(binned)]
            here = np.flatnonzero(at >= 0)
            at, own = at[here], binned[here]
            g = p[here, c] - (labels[here] == c)
            h = np.maximum(2 * p[here, c] * (1 - p[here, c]), 1e-16)
            for start in range(0, len(chosen[c]), SPLIT_FEATURES):
                some = chosen[c][start:start + SPLIT_FEATURES]
                sums = np.empty((len(nodes), 2, len(some), bins))
                for k, f in enumerate(some):
                    cell = at * bins + own[:, f]
                    for w, weight in enumerate((g, h)):
                        sums[:, w, k] = np.bincount(
                            cell, weight, len(nodes) * bins).reshape(-1, bins)
                out += [(c, node, start, sums[i].tobytes()) for i, node in enumerate(nodes)]
        columns = list(zip(*out)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(),
                                                      pa.binary()))],
            ["cls", "node", "start", "sums"])

    def searched(rows: pa.Table) -> pa.Table:
        c, node, start = (rows[k][0].as_py() for k in ("cls", "node", "start"))
        some = chosen[c][start:start + SPLIT_FEATURES]
        total = np.zeros((2, len(some), bins))
        for sums in sorted(rows["sums"].to_pylist()):
            total += np.frombuffer(sums).reshape(total.shape)
        gain, f, b, left_g, left_h = best_split(total[0], total[1], reg, min_weight)
        return pa.table({
            "cls": pa.array([c], pa.int32()), "node": pa.array([node], pa.int32()),
            "feature": pa.array([int(some[f])], pa.int32()), "bin": pa.array([b], pa.int32()),
            "gain": [gain], "left_g": [left_g], "left_h": [left_h],
            "g": [float(total[0, 0].sum())], "h": [float(total[1, 0].sum())]})

    partial = table.mapInArrow(summed, "cls int, node int, start int, sums binary")
    return partial.groupBy("cls", "node", "start").applyInArrow(
        searched, "cls int, node int, feature int, bin int, gain double, left_g double, "
                  "left_h double, g double, h double")


def _loss(table: DataFrame, fit_id: str, finished, size: int) -> float:
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, _, binned = _partition(batches, size)
        if len(labels):
            p = softmax(_margins(fit_id, binned, finished.value))
            lost = -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-300)).sum()
            yield pa.RecordBatch.from_arrays(
                [pa.array([lost]), pa.array([len(labels)], pa.int64())], ["lost", "n"])

    row = table.mapInArrow(summed, "lost double, n long").agg(
        (F.sum("lost") / F.sum("n")).alias("loss")).first()
    return float(row["loss"])
