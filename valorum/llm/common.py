"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valorum.session import work_table

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package (a cluster job ships it with ``--py-files``)."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def text_of(column: str = "text") -> Column:
    """The text as a string, null counted as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, under the operator's own names (extra columns never clash)."""
    return df.select(*[F.col(f"`{src}`").alias(dst) for dst, src in columns.items()])


def fresh(name: str, taken) -> str:
    """A column name that no input column has (names compare without case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def stored(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder and read back: lineage ends, executors may be lost."""
    return work_table(df, label)
