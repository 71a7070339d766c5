"""Compute expensive columns once, whatever is built on top of them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Append columns through a one-row `inline`.

    A later filter on something derived from plain projected columns is pushed below the
    projection with the whole expression copied in for every mention; nested mentions grow
    exponentially. A generator's output is opaque to that rewrite, so each column here is
    evaluated once per row.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(row)))
