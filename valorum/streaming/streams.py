"""Structured Streaming jobs for arriving quotes and assumption edits.

Both keep a table of one row per key, the newest by the ordering columns (the rule of batch M2: an edit that
arrives late never replaces a newer one, merging rows twice changes nothing). The table is Parquet partitioned
by a hash bucket of the key. A micro-batch reads and rewrites, by Spark's dynamic partition overwrite, the buckets of
its own keys; all other buckets keep their files, and a reader reads the table as it is.

A crash while buckets are replaced must not lose them, so a batch first writes their new content aside (two slots in
turn, so nothing piles up), then a mark that it is complete, then the buckets. A replay of the batch that finds its mark
replaces the buckets again from there; without a mark the buckets are still the old ones. Slots and logs lie under the
id of the streaming query, which Spark keeps in the checkpoint: a new checkpoint on an old folder adds to it. One query
at a time may write a folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from valorum.operators.latest import latest_per_key
from valorum.operators.quotes import drop_missing

BUCKETS = 64
QUOTE_ORDER = ("last_ts", "price")
EDIT_ORDER = ("event_time", "id")
QUOTE_DELAY = "5 days"  # the look-back within which a quote counts
# A task sorts the rows of its split to find the newest of each key, and unpacked they take some 30 times the bytes of the file.
SPLIT_BYTES = 16 << 20


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at a path; None if nothing is written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _bucket_column(buckets: int) -> str:
    return f"bucket_of_{buckets}"


def _current(spark: SparkSession, state_dir: str, buckets: int | None = None) -> DataFrame | None:
    found = _table(spark, f"{state_dir.rstrip('/')}/current")
    if found is not None and buckets is not None and _bucket_column(buckets) not in found.columns:
        raise ValueError(f"{state_dir} is not kept in {buckets} buckets")
    return found


def read_state(spark: SparkSession, state_dir: str) -> DataFrame:
    """The newest row of every key."""
    found = _current(spark, state_dir)
    if found is None:
        raise FileNotFoundError(f"no state under {state_dir}")
    return found.drop(*[c for c in found.columns if c.startswith("bucket_of_")])


def merge_batch(changes: DataFrame, batch_id: int, state_dir: str, writer: str, key: str = "ticker",
                order_by: Sequence[str] = QUOTE_ORDER, buckets: int = BUCKETS) -> None:
    """Merge a batch's rows into the state: M2 on the buckets of its keys.

    ``changes`` is read twice and so should be a written table. ``writer`` names the query; the same batch of the same writer may be merged again after a failure at any point.
    """
    spark, base, bucket = changes.sparkSession, state_dir.rstrip("/"), _bucket_column(buckets)
    aside, mark = (f"{base}/{part}/{writer}/slot={batch_id % 2}" for part in ("aside", "marks"))
    done = _table(spark, mark)
    if done is None or done.first()["batch"] != batch_id:
        keyed = changes.withColumn(bucket, F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int"))
        newest = latest_per_key(keyed, [key, bucket], list(order_by))
        # At most as many numbers as there are buckets; they prune the scan of the state.
        touched = [r[0] for r in keyed.select(bucket).distinct().collect()]
        before = _current(spark, state_dir, buckets) if touched else None
        if before is not None:
            newest = latest_per_key(before.where(F.col(bucket).isin(touched)).unionByName(newest), [key, bucket], list(order_by))
        newest.repartition(bucket).write.mode("overwrite").parquet(aside)
        spark.range(1).select(F.lit(batch_id).alias("batch"), F.lit(len(touched)).alias("buckets")).coalesce(1).write.mode(
            "overwrite").parquet(mark)
        if not touched:
            return
    elif not done.first()["buckets"]:
        return
    schema = StructType([*changes.schema.fields, StructField(bucket, IntegerType())])
    (spark.read.schema(schema).parquet(aside).repartition(bucket).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(bucket)
     .parquet(f"{base}/current"))


def _writer(batch: DataFrame) -> str:
    """The id of the streaming query whose micro-batch this is (kept in its checkpoint)."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def _small_splits(batch: DataFrame) -> SparkSession:
    """The streaming query's own session, reading files in splits of at most SPLIT_BYTES."""
    spark = batch.sparkSession
    if spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() > SPLIT_BYTES:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(SPLIT_BYTES))
    return spark


def _start(frame: DataFrame, apply, checkpoint: str, available_now: bool, mode: str = "append") -> StreamingQuery:
    w = frame.writeStream.outputMode(mode).foreachBatch(apply).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="60 seconds")
    return w.start()


def daily_quotes(stream: DataFrame, key: str, ts: Column | str, close: str, delay: str = QUOTE_DELAY) -> DataFrame:
    """The newest non-null close of each key and day; a stream keeps the days that its watermark leaves open.

    ``ts`` may be a timestamp without zone; the watermark then runs on it as session time.
    """
    quotes = drop_missing(stream.select(key, F.col(ts).alias("_ts") if isinstance(ts, str) else ts.alias("_ts"), close), close)
    quotes = quotes.withColumn("_time", F.col("_ts").cast("timestamp")).withWatermark("_time", delay)
    return quotes.groupBy(F.col(key), F.window("_time", "1 day").alias("day")).agg(
        F.max_by(F.col(close), F.struct("_ts", close)).alias("price"), F.max("_ts").alias("last_ts"))


def stream_latest_quote(stream: DataFrame, state_dir: str, checkpoint: str, key: str = "ticker", ts: str = "ts",
                        close: str = "close", available_now: bool = True, delay: str = QUOTE_DELAY,
                        buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the latest non-null close per key from a stream of quotes.

    A stateful aggregate in update mode: per key and day in the state store, with a watermark ``delay`` behind the newest
    quote. Late quotes of a day that is still open count; those of a day that was closed when the batch before ran
    (Spark's rule) are dropped, and :func:`late_groups` counts them. What a batch changes is merged into the state by key, so days that
    the watermark has removed from the store stay in the table.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        # Written first: every action on the batch itself would run the stateful aggregate again.
        changed = f"{state_dir.rstrip('/')}/changed/{_writer(batch)}/slot={batch_id % 2}"
        batch = batch.drop("day")
        batch.write.mode("overwrite").parquet(changed)
        merge_batch(_small_splits(batch).read.schema(batch.schema).parquet(changed), batch_id, state_dir, _writer(batch), key, QUOTE_ORDER, buckets)

    return _start(daily_quotes(stream, key, ts, close, delay), apply, checkpoint, available_now, "update")


def late_groups(query: StreamingQuery) -> int:
    """Late (key, day) groups that the watermark dropped in the run's recent batches (Spark counts them after partial sums)."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def stream_assumptions(stream: DataFrame, state_dir: str, log_dir: str, checkpoint: str, key: str = "ticker",
                       order_by: Sequence[str] = EDIT_ORDER, available_now: bool = True,
                       buckets: int = BUCKETS) -> StreamingQuery:
    """Append every edit to the log and keep the newest edit per key as the current row.

    Per micro-batch: the batch goes to ``log_dir/writer=<query>/batch=<id>`` (M4), its newest edit of each key to the state.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        log = f"{log_dir.rstrip('/')}/writer={_writer(batch)}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(log)
        merge_batch(_small_splits(batch).read.schema(batch.schema).parquet(log), batch_id, state_dir, _writer(batch), key, order_by, buckets)

    return _start(stream, apply, checkpoint, available_now)
