"""Quotes: look-back windows, latest close, series, freshness, ranked sources."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valorum.functions.values import epoch_micros, epoch_millis, is_ntz, round_half_up

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's.
# ---------------------------------------------------------------------------
QUOTE_TTL_SECONDS = 900      # a cached quote is stale after 15 minutes
HISTORY_TTL_SECONDS = 1800   # a cached history is stale after 30 minutes
DEFAULT_QUOTE_RANGE = "5d"   # look-back of the latest quote
DEFAULT_HISTORY_RANGE = "5y"  # default chart range
UNAVAILABLE_LABEL = "indisponível"  # price source label when no source has a price
PRICE_PLACES = 2
# ---------------------------------------------------------------------------

_RANGE = re.compile(r"^(\d+)(d|wk|mo|y)$")
_UNIT = {"d": "DAYS", "wk": "WEEKS", "mo": "MONTHS", "y": "YEARS"}


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_of_time(as_of: str | Column) -> Column:
    """A time given as text or as a column, such as :func:`newest_time`, without zone."""
    return (as_of if isinstance(as_of, Column) else F.lit(as_of)).cast("timestamp_ntz")


def newest_time(df: DataFrame, ts: str = "ts") -> Column:
    """The data's own as-of time: its newest timestamp, as a scalar subquery that runs once."""
    return df.select(F.max(ts)).scalar()


def lookback_start(as_of: str | Column, range_str: str) -> Column | None:
    """Lower bound of a range string ('5d', '1wk', '6mo', '5y', 'ytd', 'max') before ``as_of``."""
    as_of_c = as_of_time(as_of)
    if range_str == "max":
        return None
    if range_str == "ytd":
        return F.date_trunc("year", as_of_c).cast("timestamp_ntz")
    m = _RANGE.match(range_str)
    if not m:
        raise ValueError(f"unknown range {range_str!r}")
    n, unit = int(m.group(1)), _UNIT[m.group(2)]
    if unit == "WEEKS":
        n, unit = n * 7, "DAYS"
    return as_of_c - F.expr(f"INTERVAL {n} {unit}")


def history_lookback(df: DataFrame, ts: str, as_of: str | Column, range_str: str = DEFAULT_HISTORY_RANGE,
                     day: str | None = None) -> DataFrame:
    """Rows with ``as_of - range <= ts <= as_of``.

    ``day`` names the partition column of a table written by :func:`write_by_day`: its bounds prune the
    folders, also when ``as_of`` is a subquery that only runs with the query. Constant bounds reach the parquet scan.
    """
    upper, lo = as_of_time(as_of), lookback_start(as_of, range_str)
    cond = _c(ts) <= upper
    if lo is not None:
        cond = cond & (_c(ts) >= lo)
    if day is not None:
        cond = cond & (F.col(day) <= F.to_date(upper))
        if lo is not None:
            cond = cond & (F.col(day) >= F.to_date(lo))
    return df.where(cond)


def write_by_day(df: DataFrame, path: str, ts: str = "ts", day: str = "day") -> None:
    """Quotes as Parquet partitioned by the day of ``ts``; rebalanced by day, so that a heavy day is several files.

    Quotes without a time lie in the default folder, which no look-back reads.
    """
    df.withColumn(day, F.to_date(ts)).hint("rebalance", day).write.mode("overwrite").partitionBy(day).parquet(path)


def drop_missing(df: DataFrame, value: str) -> DataFrame:
    """Drop null (and NaN) measurements."""
    v = F.col(value)
    return df.where(v.isNotNull() & ~F.isnan(v))


def latest_quote(df: DataFrame, key: str = "ticker", ts: str = "ts", close: str = "close",
                 as_of: str | Column | None = None, range_str: str = DEFAULT_QUOTE_RANGE,
                 places: int | None = PRICE_PLACES, out: str = "price", day: str | None = None) -> DataFrame:
    """Latest non-null close per key inside the look-back, rounded to cents.

    Partial ``max_by`` before the exchange: one row per key and map task is shuffled.
    Ties on ``ts`` go to the larger close (a total order).
    """
    if as_of is not None:
        df = history_lookback(df, ts, as_of, range_str, day)
    df = drop_missing(df, close)
    best = F.max_by(F.col(close), F.struct(F.col(ts), F.col(close)))
    price = round_half_up(best, places) if places is not None else best
    return df.groupBy(key).agg(price.alias(out), F.max(ts).alias("last_ts"))


def history_series(df: DataFrame, key: str = "ticker", ts: str = "ts", close: str = "close",
                   as_of: str | Column | None = None, range_str: str = DEFAULT_HISTORY_RANGE,
                   as_array: bool = False, places: int = PRICE_PLACES) -> DataFrame:
    """A10: the ``[epoch_ms, close]`` series per key, nulls dropped, closes in cents.

    Long form (default): one row per point, dealt by key and 30-day bucket and ordered by key and time
    within a partition, so a key with many points spreads over several tasks.
    Array form: one row per key with the daily series (the last close of each day,
    as the provider's 1-day interval); each key first shrinks to one point per day
    by a partial aggregate, so an array holds at most one point per day of the
    look-back, however many raw points a key has. A look-back range is required.
    """
    if as_of is not None:
        df = history_lookback(df, ts, as_of, range_str)
    df = drop_missing(df, close)
    ntz = is_ntz(df, ts)
    points = df.select(F.col(key), epoch_millis(ts, ntz).alias("ts_ms"),
                       round_half_up(F.col(close), places).alias("close"))
    if not as_array:
        month = F.floor(F.col("ts_ms") / (30 * 86400000))
        return points.repartition(F.col(key), month).sortWithinPartitions(key, "ts_ms")
    if as_of is None or range_str == "max":
        raise ValueError("array form needs a bounded look-back (as_of and a range)")
    day = F.floor(F.col("ts_ms") / 86400000)
    daily = (points.groupBy(key, day.alias("_day"))
             .agg(F.max_by(F.struct("ts_ms", "close"), F.struct("ts_ms", "close")).alias("_p")))
    pairs = F.array_sort(F.collect_list("_p"))
    return daily.groupBy(key).agg(
        F.transform(pairs, lambda p: F.array(p["ts_ms"].cast("double"), p["close"])).alias("series"))


def chart_rows(df: DataFrame, key: str = "ticker", result: str = "result") -> DataFrame:
    """Chart payload with parallel ``timestamp`` / ``close`` arrays to (key, ts_ms, close) rows.

    ``result`` is a struct column with fields ``timestamp ARRAY<BIGINT>`` (seconds)
    and ``close ARRAY<DOUBLE>``; null closes are dropped, seconds become milliseconds.
    """
    zipped = df.select(F.col(key), F.inline(F.arrays_zip(F.col(result)["timestamp"].alias("t"),
                                                          F.col(result)["close"].alias("c"))))
    return (zipped.where(F.col("c").isNotNull())
            .select(F.col(key), (F.col("t") * 1000).alias("ts_ms"), round_half_up(F.col("c"), PRICE_PLACES).alias("close")))


def unpivot_quotes(df: DataFrame, ts: str = "ts", key: str = "ticker", value: str = "close") -> DataFrame:
    """Wide frame (one close column per ticker) to long (ticker, ts, close)."""
    values = [c for c in df.columns if c != ts]
    return df.unpivot([ts], values, key, value)


def quote_freshness(df: DataFrame, ts: str, as_of: str | Column, ttl_seconds: int = QUOTE_TTL_SECONDS,
                    out: str = "stale") -> DataFrame:
    """Age in seconds at ``as_of`` and a stale flag (age > ttl)."""
    ntz = is_ntz(df, ts)
    as_of_c = (as_of if isinstance(as_of, Column) else F.lit(as_of)).cast("timestamp_ntz" if ntz else "timestamp")
    age = (epoch_micros(as_of_c, ntz) - epoch_micros(ts, ntz)) / 1e6
    return df.withColumn("age_s", age).withColumn(out, F.col("age_s") > ttl_seconds)


def price_fallback(keys: DataFrame, sources: Sequence[tuple[str, DataFrame]], key: str = "ticker",
                   price: str = "price", unavailable: str = UNAVAILABLE_LABEL) -> DataFrame:
    """Per key, the price of the first source (in list order) that has one, and its name.

    Sources are ``(name, df)`` with ``df(key, price)``. They are unioned with their
    rank, reduced per key by a partial ``min_by`` (skew-safe), and left-joined to
    the keys; keys no source prices get ``unavailable``.
    """
    ranked = None
    for rank, (name, sdf) in enumerate(sources):
        part = (sdf.where(F.col(price).isNotNull() & ~F.isnan(price))
                .select(F.col(key), F.col(price).alias("_p"), F.lit(rank).alias("_rank"), F.lit(name).alias("_src")))
        ranked = part if ranked is None else ranked.unionByName(part)
    best = ranked.groupBy(key).agg(
        F.min_by(F.struct(F.col("_p"), F.col("_src")), F.struct(F.col("_rank"), F.col("_p"))).alias("_b"))
    out = keys.join(best, key, "left")
    return out.withColumn(price, F.col("_b._p")).withColumn(
        "price_source", F.coalesce(F.col("_b._src"), F.lit(unavailable))).drop("_b")
