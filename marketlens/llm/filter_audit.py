"""Interaction of filters: what each step of each order of five filters keeps and removes.

A document is described by a mask, one bit per filter that it fails. What happens to it at step
s of an order depends on the mask alone. So every mask has a wide integer of packed counters:
one 64-bit field for each of the outcomes of each of the 600 steps (120 orders of five), with a
one where the outcome holds. The integers of a part's documents are added up, those of equal
masks as a product with their number, and the sum is cut into its fields again. No field can
carry into the next: it holds at most the number of documents, below 2^63.

Masks come from the row's own text, but for exact copies. Rows of one text have equal bits for
all other filters, so they are first counted by digest, part and labels together with their
smallest id and how often it stands there; the smallest id of the digest then tells how many of
each count pass. No row ever meets all copies of its text.
"""

from __future__ import annotations

from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.llm.common import SPACE, stored, table

FILTERS = "ABCDE"
MIN_WORDS = 100
#: Filter B asks for so many distinct words, C for at most so many capitals, in a hundred.
MIN_DISTINCT, MAX_CAPITALS = 80, 10
SYMBOLS = "[#$%&*|]"
ORDERS = ["".join(order) for order in permutations(FILTERS)]
#: (order, step from 1, filter) of all steps.
STEPS = [(order, k, letter) for order in ORDERS for k, letter in enumerate(order, start=1)]
#: Counters of a step, in the order of the fields.
COUNTERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
FIELD_BYTES = 8


@cache
def packed(mask: int, good: bool, toxic: bool) -> int:
    """All counters of one document with this mask and these labels as one integer."""
    fields = []
    for order, k, letter in STEPS:
        failed = [bool(mask >> FILTERS.index(f) & 1) for f in order[:k]]
        before, here = any(failed[:-1]), failed[-1]
        removed = here and not before
        fields += [not before and not here, removed, here and before,
                   mask == 1 << FILTERS.index(letter), removed and good, removed and toxic]
    return int.from_bytes(np.array(fields, f"<i{FIELD_BYTES}").tobytes(), "little")


def unpacked(total: int) -> np.ndarray:
    """Counters (step x counter) of a sum of such integers."""
    raw = total.to_bytes(len(STEPS) * len(COUNTERS) * FIELD_BYTES, "little")
    return np.frombuffer(raw, f"<i{FIELD_BYTES}").reshape(len(STEPS), len(COUNTERS))


def text_bits(text: Column) -> Column:
    """Bits of the filters A to D of a text."""
    words = F.array_remove(F.split(text, f"[{SPACE}]+"), "")
    return F.transform(F.array(words), lambda w: (
        (F.size(w) < MIN_WORDS).cast("int")
        + (F.size(F.array_distinct(w)) * 100 < F.size(w) * MIN_DISTINCT).cast("int") * 2
        + (F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100
           > F.length(text).cast("long") * MAX_CAPITALS).cast("int") * 4
        + text.rlike(SYMBOLS).cast("int") * 8))[0]


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): how many documents there are of each kind.

    `docs` has doc_id, text and lang, `labels` doc_id, quality and toxic. Null texts are empty,
    null languages are the part ''. A row without id is never a copy of another and makes no
    other row one; of rows that repeat an id with its text none is a copy of the others. A
    document is good or toxic if any of its labels says 1. Texts count whole, at any length.
    Empty tables give no rows; further columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    marks = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"),
                        F.unhex(F.md5(text)).alias("digest"),
                        text_bits(text).alias("bits"))
    # Repeated rows are counted before the join, and the flags are a table of their own, so
    # that a hot id can be split.
    rows = stored(marks.groupBy("doc_id", "part", "digest", "bits").agg(
        F.count("*").alias("n")), "filter-marks")
    flags = stored(labels.groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")), "filter-labels")
    none = F.lit(False)
    known = (rows.where("doc_id is not null").join(flags, "doc_id", "left")
             .select(*rows.columns, F.coalesce("good", none).alias("good"),
                     F.coalesce("toxic", none).alias("toxic")))
    unknown = rows.where("doc_id is null").select("*", none.alias("good"), none.alias("toxic"))
    # Smallest id with the number of rows there. Rows of one id, text and part are one row by
    # now, so the smallest struct has all of that id.
    kinds = known.unionByName(unknown).groupBy("digest", "part", "bits", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"))
    least = F.min("least.doc_id").over(Window.partitionBy("digest"))
    first = F.when(F.col("least.doc_id") == F.col("low"), F.col("least.n")).otherwise(0)
    passing = F.col("nameless") + F.coalesce(first, F.lit(0))
    both = F.array(F.struct(F.col("bits").alias("mask"), passing.alias("n")),
                   F.struct((F.col("bits") + 16).alias("mask"),
                            (F.col("n") - passing).alias("n")))
    return (kinds.withColumn("low", least).select("part", "good", "toxic", F.inline(both))
            .where("n > 0").groupBy("part", "mask", "good", "toxic")
            .agg(F.sum("n").alias("n")))


def audit(counts: DataFrame) -> DataFrame:
    """One row per part, order and step with all counters, from `mask_counts`.

    A part has at most 128 kinds of documents, so its sum of packed integers is one small task.
    `shapley` is what the step's filter removes, summed over all orders at any step.
    """
    def summed(rows: pa.Table) -> pa.Table:
        total = sum(n * packed(mask, good, toxic) for mask, good, toxic, n in zip(
            *(rows[c].to_pylist() for c in ("mask", "good", "toxic", "n"))))
        fields = unpacked(total)
        place = np.array([FILTERS.index(letter) for _, _, letter in STEPS])
        by_filter = np.zeros(len(FILTERS), np.int64)
        np.add.at(by_filter, place, fields[:, COUNTERS.index("removed")])
        return pa.table({
            "part": pa.array([rows["part"][0].as_py()] * len(STEPS), pa.string()),
            "filter_order": pa.array([order for order, _, _ in STEPS], pa.string()),
            "step": pa.array([k for _, k, _ in STEPS], pa.int32()),
            **{name: pa.array(fields[:, i]) for i, name in enumerate(COUNTERS)},
            "shapley": pa.array(by_filter[place])})

    longs = ", ".join(f"{name} long" for name in (*COUNTERS, "shapley"))
    return counts.groupBy("part").applyInArrow(
        summed, f"part string, filter_order string, step int, {longs}")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps of all orders for every language."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    return audit(mask_counts(docs, table(spark, sf_dir, "labels")))


OP11_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
flags AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good,
         coalesce(bool_or(toxic = 1), false) AS toxic
  FROM labels GROUP BY doc_id),
firsts AS (SELECT text, min(doc_id) AS low FROM docs GROUP BY text),
words AS (
  SELECT d.doc_id, d.part, d.text, d.doc_id > f.low AS copied,
         regexp_extract_all(d.text, '[^\x20\x09-\x0D]+') AS w
  FROM docs d JOIN firsts f ON d.text = f.text),
fails AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         len(w) < 100 AS a,
         100 * len(list_distinct(w)) < 80 * len(w) AS b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d, coalesce(copied, false) AS e
  FROM words LEFT JOIN flags USING (doc_id)),
kinds AS (
  SELECT part, good, toxic,
         (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END)
         || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END)
         || (CASE WHEN e THEN 'E' ELSE '' END) AS failed, count(*) AS n
  FROM fails GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT p.l || q.l || r.l || s.l || t.l AS filter_order
  FROM letters p, letters q, letters r, letters s, letters t
  WHERE q.l <> p.l AND r.l NOT IN (p.l, q.l) AND s.l NOT IN (p.l, q.l, r.l)
    AND t.l NOT IN (p.l, q.l, r.l, s.l)),
steps AS (
  SELECT filter_order, step, filter_order[step] AS l, filter_order[1:step - 1] AS earlier
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
outcomes AS (
  SELECT k.*, s.filter_order, s.step, s.l, contains(k.failed, s.l) AS here,
         s.step > 1 AND k.failed <> '' AND regexp_matches(s.earlier, '[' || k.failed || 'x]')
           AS before
  FROM kinds k, steps s),
counted AS (
  SELECT part, filter_order, step, any_value(l) AS l,
         sum(CASE WHEN NOT here AND NOT before THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN here AND NOT before THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN here AND before THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN failed = l THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN here AND NOT before AND good THEN n ELSE 0 END) AS good_lost,
         sum(CASE WHEN here AND NOT before AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM outcomes GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept,
       removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, l))::BIGINT AS shapley
FROM counted
"""
