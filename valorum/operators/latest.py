"""Newest-row-per-key, top-k per key, per-year sums and arg-max.

The newest row per key is one ``max_by`` over a struct of the ordering columns, partial before the exchange: every
map task ships one row of each key, so a key holding a third of all rows is small before anything is
shuffled. Top-k per key, and orders that such a struct cannot hold (ascending text), use ``row_number`` with a limit on
it, whose partial ``WindowGroupLimit`` ships at most k rows of each key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valorum.functions.values import epoch_micros


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def _order_spec(order_by) -> list[tuple[Column, bool]]:
    """Normalise ``order_by`` into (column, descending) pairs. Plain items are descending."""
    out = []
    for item in order_by:
        if isinstance(item, tuple):
            col, direction = item
            out.append((_c(col), str(direction).lower() == "desc"))
        else:
            out.append((_c(item), True))
    return out


def order_struct(df: DataFrame, order_by: Sequence) -> Column | None:
    """A struct whose largest value is the row that sorts first under ``order_by``; None if there is none.

    Nulls lose in both directions. Ascending integers, times and dates are turned round bit by bit (no overflow),
    ascending floating numbers by their sign, with NaN, the largest, last.
    """
    fields = []
    for column, descending in _order_spec(order_by):
        kind = df.select(column).schema[0].dataType
        if isinstance(kind, (T.MapType, T.VariantType)):
            return None
        if descending:
            parts = [column]
        elif isinstance(kind, T.IntegralType):
            parts = [F.bitwise_not(column)]
        elif isinstance(kind, T.BooleanType):
            parts = [~column]
        elif isinstance(kind, (T.FloatType, T.DoubleType)):
            parts = [column.isNotNull(), F.when(~F.isnan(column), -column)]
        elif isinstance(kind, T.DateType):
            parts = [F.bitwise_not(F.unix_date(column))]
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            parts = [F.bitwise_not(epoch_micros(column, isinstance(kind, T.TimestampNTZType)))]
        else:
            return None
        fields += parts
    return F.struct(*[f.alias(f"o{i}") for i, f in enumerate(fields)])


def latest_per_key(df: DataFrame, keys, order_by: Sequence, columns: Sequence[str] | None = None) -> DataFrame:
    """Keep, per key, the row that sorts first under ``order_by``.

    ``order_by`` items are columns (descending: the largest wins) or
    ``(column, 'asc'|'desc')`` pairs, of any sortable type. Give a total order (add tie-break
    columns): the result is then deterministic. Nulls in an ordering column lose in both directions.
    """
    keys = _keys(keys)
    columns = [c for c in (columns or df.columns) if c not in keys]
    order = order_struct(df, order_by) if columns and order_by else None
    if order is not None:
        row = "_row"
        while row in keys:
            row = "_" + row
        best = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in columns]), order).alias(row))
        return best.select(*[F.col(f"`{k}`") for k in keys], *[F.col(row)[c].alias(c) for c in columns])
    place = "_place"
    while place in df.columns:
        place = "_" + place
    return top_k_per_key(df, keys, order_by, 1, place).select(*keys, *columns)


def top_k_per_key(df: DataFrame, keys, order_by: Sequence, k: int, rank_col: str = "rank") -> DataFrame:
    """The first ``k`` rows per key under ``order_by`` with their rank (1 = first)."""
    keys = _keys(keys)
    spec = _order_spec(order_by)
    w = Window.partitionBy(*keys).orderBy(*[(c.desc_nulls_last() if d else c.asc_nulls_last()) for c, d in spec])
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def sum_abs_by_year(df: DataFrame, keys, year, value, exact_scale: int | None = 2,
                    out: str = "total") -> DataFrame:
    """A1: sum of absolute values per key and year.

    With ``exact_scale`` the sum runs in decimal (exact, order-independent) and is
    returned as double; ``None`` sums doubles.
    """
    keys = _keys(keys)
    v = F.abs(_c(value))
    if exact_scale is not None:
        v = v.cast(f"decimal(28,{exact_scale})")
    agg = F.sum(v)
    if exact_scale is not None:
        agg = agg.cast("double")
    return df.groupBy(*keys, _c(year).alias("year")).agg(agg.alias(out))


def value_at_latest(df: DataFrame, keys, order, value, out: str | None = None) -> DataFrame:
    """A2: per key, the non-null value at the largest ``order`` (nulls skipped first)."""
    keys = _keys(keys)
    v = _c(value)
    name = out or (value if isinstance(value, str) else "value")
    return df.where(v.isNotNull()).groupBy(*keys).agg(F.max_by(v, _c(order)).alias(name))


def dedupe_last_wins(df: DataFrame, keys, order_col) -> DataFrame:
    """A4: keyed lookup where the last row (largest ``order_col``) wins."""
    return latest_per_key(df, keys, [order_col])


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    """Distinct non-null keys (sorted by the caller if needed)."""
    return df.select(key).where(F.col(key).isNotNull()).distinct()


def history_for_key(df: DataFrame, key: str, value, order_col: str, k: int = 40) -> DataFrame:
    """The newest ``k`` rows of one key (point lookup, then a top-k sort)."""
    return df.where(F.col(key) == value).orderBy(F.col(order_col).desc()).limit(k)
