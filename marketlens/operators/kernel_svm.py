"""Support-vector machines with the exact RBF kernel, solved as a cascade.

Rows are dealt into blocks. Every block is solved by sequential minimal optimisation in a task
of its own; only its support vectors go on and meet those of a second block, and so on until
one set is left. Then every row is held against the machine: rows that violate their margin
join the set, it is solved again, and this goes on until none does. The machine is then the
optimum over all rows, and the duality gap says how close.

Support vectors grow with the rows on noisy data, and the last sets of the cascade are solved
in one task, as in any exact kernel machine. So many rows call for a bound on the labelled
rows that a fit takes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
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

#: Rows of a block, violators that a partition may add in a round, and when a row violates.
BLOCK_ROWS, ADDED_ROWS, TOLERANCE = 500, 200, 1e-3


def rbf(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    distance = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(distance, 0))


def solve(k: np.ndarray, y: np.ndarray, c: np.ndarray, alpha: np.ndarray | None = None,
          tolerance: float = TOLERANCE, steps: int = 10_000_000
          ) -> tuple[np.ndarray, float, float]:
    """(alpha, bias, violation) of the dual: max sum(a) - a'Qa/2, 0 <= a <= c, y'a = 0.

    Pairs are chosen by the largest gain of second order until the largest violation is under
    the tolerance. `alpha` is a feasible start.
    """
    alpha = np.zeros(len(y)) if alpha is None else alpha.copy()
    gradient = y * (k @ (alpha * y)) - 1
    diagonal = np.diag(k)
    for _ in range(steps):
        minus = -y * gradient
        up = np.where(y > 0, alpha < c, alpha > 0)
        low = np.where(y > 0, alpha > 0, alpha < c)
        if not up.any() or not low.any():
            break
        i = int(np.argmax(np.where(up, minus, -np.inf)))
        ahead = minus[i] - minus
        if ahead[low].max() <= tolerance:
            break
        curve = np.maximum(diagonal[i] + diagonal - 2 * k[i], 1e-12)
        j = int(np.argmax(np.where(low & (ahead > 0), ahead * ahead / curve, -np.inf)))
        step = ahead[j] / curve[j]
        # Along y_i a_i up and y_j a_j down, as far as both stay in their box.
        step = min(step, c[i] - alpha[i] if y[i] > 0 else alpha[i],
                   alpha[j] if y[j] > 0 else c[j] - alpha[j])
        for at, move in ((i, step * y[i]), (j, -step * y[j])):
            alpha[at] = min(max(alpha[at] + move, 0.0), c[at])
        gradient += step * y * (k[:, i] - k[:, j])
    minus = -y * gradient
    up = np.where(y > 0, alpha < c, alpha > 0)
    low = np.where(y > 0, alpha > 0, alpha < c)
    high = minus[up].max() if up.any() else 0.0
    deep = minus[low].min() if low.any() else 0.0
    free = (alpha > 1e-9) & (alpha < c - 1e-9)
    bias = float(minus[free].mean()) if free.any() else float((high + deep) / 2)
    return alpha, bias, float(max(high - deep, 0.0))


class KernelMargins(Transformer, HasInputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted one-vs-rest machines; appends the margin of class c as the vector `raw_c`."""

    machines = Param(Params._dummy(), "machines", "packed arrays", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol=None, machines=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @property
    def arrays(self) -> dict[str, np.ndarray]:
        """gamma, vectors (row x feature), weights (class x row: alpha y), bias, gap."""
        return unpack(self.getOrDefault("machines"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        packed = self.getOrDefault("machines")

        held = []

        def margins(given: list[pa.Array]) -> list[pa.Array]:
            if not held:
                held.append(unpack(packed))
            model, x = held[0], matrix(given[0])
            out = np.empty((len(x), len(model["bias"])))
            for a in range(0, len(x), 1024):
                kernel = rbf(x[a:a + 1024], model["vectors"], float(model["gamma"]))
                out[a:a + 1024] = kernel @ model["weights"].T + model["bias"]
            return [pa.array(list(out), pa.list_(pa.float64()))]

        found = append_columns(dataset, [vector_to_array(self.getInputCol())],
                               [T.StructField("_margins", T.ArrayType(T.DoubleType()))], margins)
        return found.withColumns({
            f"raw_{c}": array_to_vector(F.array(F.get("_margins", F.lit(c))))
            for c in params.CLASSES}).drop("_margins")


def fit_margins(train: DataFrame, features: str, label: str, weight: str, C: float,
                gamma: float, tolerance: float = TOLERANCE, block_rows: int = BLOCK_ROWS,
                most_rounds: int = 100) -> KernelMargins:
    """One machine per class against the rest, with the penalty C times the row's weight.

    Ties, repeated rows and rows of one class are fine: a class that no row has, or all rows
    have, gets a machine without support vectors and a margin of -1 or 1.
    """
    spark = train.sparkSession
    path = new_path(spark, "svm-rows")
    train.where(F.col(label).isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.col(label).cast("int").alias("label"),
        (F.lit(float(C)) * F.col(weight)).alias("c"), vector_to_array(features).alias("x")
    ).write.parquet(path)
    rows = spark.read.parquet(path)
    n = rows.count()
    blocks = max(1, -(-n // block_rows))
    each = F.explode(F.array(*[F.lit(k) for k in params.CLASSES]))
    held = rows.select("row", each.alias("cls"), "c", "x", "label").select(
        "row", "cls", F.when(F.col("label") == F.col("cls"), 1.0).otherwise(-1.0).alias("y"),
        "c", "x", F.lit(0.0).alias("alpha"),
        F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"))
    schema = held.schema

    def solved(group: pa.Table) -> pa.Table:
        """The group's support vectors, with their alphas; a class alone keeps one row."""
        x = matrix(group["x"].combine_chunks())
        y, c = group["y"].to_numpy(), group["c"].to_numpy()
        alpha, _, _ = solve(rbf(x, x, gamma), y, c, tolerance=tolerance)
        kept = alpha > 1e-9
        if not kept.any():
            kept[0] = True
        group = group.set_column(group.schema.get_field_index("alpha"), "alpha",
                                 pa.array(alpha))
        return group.filter(pa.array(kept))

    def merged(table: DataFrame, name: str) -> DataFrame:
        out = new_path(spark, name)
        table.groupBy("cls", "block").applyInArrow(solved, schema).write.parquet(out)
        return spark.read.parquet(out)

    held = merged(held, "svm-blocks")
    while blocks > 1:
        blocks = -(-blocks // 2)
        held = merged(held.withColumn("block", F.floor(F.col("block") / 2)), "svm-merge")
    # One set per class is left: support vectors of a bounded number of rows.
    sets = {c: held.where(F.col("cls") == c).drop("cls", "block", "alpha").collect()
            for c in params.CLASSES}
    machines = {}
    for c, own in sets.items():
        machines[c] = _polished(rows, c, own, gamma, tolerance, most_rounds)
    vectors = np.concatenate([m["x"] for m in machines.values()])
    weights = np.zeros((len(machines), len(vectors)))
    at = 0
    for k, m in enumerate(machines.values()):
        weights[k, at:at + len(m["x"])] = m["weights"]
        at += len(m["x"])
    return KernelMargins(inputCol=features, machines=pack(
        gamma=np.array(gamma), vectors=vectors, weights=weights,
        bias=np.array([m["bias"] for m in machines.values()]),
        gap=np.array([m["gap"] for m in machines.values()]),
        primal=np.array([m["primal"] for m in machines.values()])))


def _polished(rows: DataFrame, cls: int, own: list, gamma: float, tolerance: float,
              most_rounds: int) -> dict:
    """The optimum over all rows, from a set of support vectors."""
    spark = rows.sparkSession
    ids = [r["row"] for r in own]
    x, y = np.array([r["x"] for r in own]), np.array([r["y"] for r in own])
    c, alpha = np.array([r["c"] for r in own]), np.zeros(len(own))
    for _ in range(most_rounds):
        kernel = rbf(x, x, gamma)
        alpha, bias, _ = solve(kernel, y, c, alpha, tolerance / 2)
        if not (alpha > 0).any():  # one class only
            bias = float(y[0])
        kept = np.flatnonzero(alpha > 0)
        machine = spark.sparkContext.broadcast(
            (x[kept], alpha[kept] * y[kept], bias, set(ids)))

        def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vectors, weights, b, inside = machine.value
            worst, lost = [], 0.0
            for batch in batches:
                if not batch.num_rows:
                    continue
                at = np.where(batch.column("label").to_numpy() == cls, 1.0, -1.0)
                xs = matrix(batch.column("x"))
                margin = at * (rbf(xs, vectors, gamma) @ weights + b)
                penalty = batch.column("c").to_numpy()
                lost += float((penalty * np.maximum(1 - margin, 0)).sum())
                numbers = batch.column("row").to_pylist()
                worst += [(float(m), r, float(s), float(p), row.tolist()) for m, r, s, p, row in
                          zip(margin, numbers, at, penalty, xs)
                          if m < 1 - tolerance and r not in inside]
                worst = sorted(worst, key=lambda w: w[:2])[:ADDED_ROWS]
            out = [(None, None, None, None, None, lost), *[(*w, 0.0) for w in worst]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(zip(*out), (
                    pa.float64(), pa.int64(), pa.float64(), pa.float64(),
                    pa.list_(pa.float64()), pa.float64()))],
                ["margin", "row", "y", "c", "x", "lost"])

        # At most ADDED_ROWS rows of every partition, the worst of which are added, and the
        # partition's losses.
        path = new_path(spark, "svm-check")
        rows.mapInArrow(checked, "margin double, row long, y double, c double, "
                                 "x array<double>, lost double").write.parquet(path)
        found = spark.read.parquet(path)
        answer = found.where("row is not null").orderBy("margin", "row").limit(
            ADDED_ROWS).collect()
        machine.unpersist()
        if not answer:
            lost = found.agg(F.sum("lost")).first()[0] or 0.0
            break
        ids += [r["row"] for r in answer]
        x = np.concatenate([x, [r["x"] for r in answer]])
        y, c = (np.concatenate([old, [r[k] for r in answer]]) for old, k in ((y, "y"), (c, "c")))
        alpha = np.concatenate([alpha, np.zeros(len(answer))])
    else:
        raise RuntimeError(f"no optimum after {most_rounds} rounds")
    norm = float((alpha * y) @ kernel @ (alpha * y))
    primal, dual = norm / 2 + lost, float(alpha.sum()) - norm / 2
    return {"x": x[kept], "weights": alpha[kept] * y[kept], "bias": bias,
            "gap": primal - dual, "primal": primal}
