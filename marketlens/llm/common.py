"""Helpers shared by the operators: table access, stored intermediates, word rules."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.sources.workspace import new_path

#: ASCII white space between words, as a class of Java and Python patterns.
SPACE = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """`df` written to the shared folder and read back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other letter as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def slots(spark: SparkSession) -> int:
    """The session's shuffle partitions: how many parts an exchange is cut into."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
