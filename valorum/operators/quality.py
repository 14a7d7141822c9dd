"""Row validation, portfolio valuation and table health."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valorum.operators.latest import latest_per_key

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's.
# ---------------------------------------------------------------------------
DUPLICATE_KEY = "duplicate_key"
SCREENER_DROP = ("g1", "gp", "payout", "user")
SCREENER_RENAME = {"price_source": "fonte_preco"}
# ---------------------------------------------------------------------------


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def validate(df: DataFrame, rules: Sequence[tuple[str, Column]], unique: str | None = None,
             order_by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Evaluate named rules (a Column that is true when the row passes) on every row.

    Returns (accepted, rejected); ``rejected`` carries ``errors ARRAY<STRING>`` with
    the names of the failed rules, in rule order. With ``unique`` (a key) the first passing row of a key under
    ``order_by`` (a total order) is accepted; later ones fail with 'duplicate_key'.
    """
    if unique and not order_by:
        raise ValueError("unique needs order_by: the first row of a key wins")
    errs = F.filter(F.array(*[F.when(~F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules]),
                    lambda x: x.isNotNull())
    marked = df.withColumn("errors", errs)
    if unique:
        at = [f"_o{i}" for i in range(len(order_by))]
        passing = marked.where(F.size("errors") == 0).select(unique, *[F.col(c).alias(o) for c, o in zip(order_by, at)])
        first = latest_per_key(passing, unique, [(o, "asc") for o in at])
        again = F.lit(False)
        for c, o in zip(order_by, at):
            again = again | ~F.col(c).eqNullSafe(F.col(o))
        repeated = (F.size("errors") == 0) & again
        marked = marked.join(first, unique, "left").withColumn(
            "errors", F.when(repeated, F.array(F.lit(DUPLICATE_KEY))).otherwise(F.col("errors"))).drop(*at)
    return (marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0))


def position_rules(quantity: str = "quantidade", price: str = "preco_medio") -> list[tuple[str, Column]]:
    """P8 rules of a portfolio position: finite numbers, quantity > 0, average price >= 0."""
    q = F.col(quantity).try_cast("double")
    p = F.col(price).try_cast("double")
    return [("quantity_finite", finite(q)), ("price_finite", finite(p)),
            ("quantity_positive", q > 0), ("price_non_negative", p >= 0)]


def portfolio_value(positions: DataFrame, screener: DataFrame, key: str = "ticker") -> DataFrame:
    """Position value, cost, gain, gain %, and fair-value upside from the screener row."""
    j = positions.join(screener.select(key, "price", "fair", "valid"), key, "left")
    q, avg, price = F.col("quantidade"), F.col("preco_medio"), F.col("price")
    value = q * price
    cost = q * avg
    return j.select(
        key, "quantidade", "preco_medio", "price", "fair",
        value.alias("value"), cost.alias("cost"), (value - cost).alias("gain"),
        (F.try_divide(value - cost, cost) * 100.0).alias("gain_pct"),
        F.when(F.col("valid"), F.try_divide(F.col("fair") - price, price) * 100.0).alias("upside_pct"),
    )


def table_health(tables: Mapping[str, DataFrame]) -> DataFrame:
    """A5: one row per table with its row count (one aggregate per table, unioned)."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


def screener_shape(df: DataFrame, drop: Sequence[str] = SCREENER_DROP,
                   rename: Mapping[str, str] = SCREENER_RENAME, whitelist: Sequence[str] | None = None) -> DataFrame:
    """Output shape: optional whitelist, dropped columns, renamed columns."""
    if whitelist is not None:
        df = df.select(*[c for c in whitelist if c in df.columns])
    df = df.drop(*[c for c in drop if c in df.columns])
    return df.withColumnsRenamed({k: v for k, v in rename.items() if k in df.columns})


def lookup_by_keys(df: DataFrame, keys: DataFrame | Sequence, key: str = "ticker", upper: bool = True) -> DataFrame:
    """P7 / L4 batch form: rows whose key is in ``keys``, a table (semi join) or a list (a filter that reaches the scan).

    Requested keys are upper-cased and read as the stored key's type; the stored key stays as it is, so its
    statistics, partitions and buckets serve. Requests that are null or no such key find nothing, repeated ones change nothing.
    """
    kind = df.schema[key].dataType

    def asked(c: Column) -> Column:
        return (F.upper(c.cast("string")) if upper else c.cast("string")).try_cast(kind)

    if not isinstance(keys, DataFrame):
        return df.where(F.col(key).isin([asked(F.lit(k)) for k in keys if k is not None]))
    return df.join(keys.select(asked(F.col(key)).alias(key)).distinct(), key, "left_semi")
