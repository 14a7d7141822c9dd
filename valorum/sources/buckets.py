"""Tables stored in buckets: rows are dealt by key once, when written, and joins or groups by that key move nothing.

Store rows that are already reduced by key (a few rows of each key at most): a bucket is read by one task, so a key that
held a third of all raw rows would hold up that task. Nulls share one bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_buckets(df: DataFrame, table: str, path: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` as the external table ``table`` under ``path`` (a shared folder), ``buckets`` by ``key``, and read it.

    One shuffle by the key, so each bucket is one sorted file. Tables that are to be joined without a shuffle need the
    same number of buckets; take it from the size the tables shall grow to (a bucket should fit a task).
    An empty frame gives an empty table.
    """
    if buckets < 1:
        raise ValueError("buckets must be positive")
    dealt = df.repartition(buckets, key)
    dealt.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return df.sparkSession.table(table)
