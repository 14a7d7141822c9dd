"""Fundamentals from filing facts: latest EPS, latest net income, dividends, payout.

:func:`filing_figures` gives all of them in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valorum.functions.text import fold_accents, fold_literal
from valorum.functions.values import (DIVIDEND_SCALE, PAYOUT_CAP, PAYOUT_DEFAULT, clamp, first_plausible,
                                      round_half_even, scale_units)
from valorum.operators.latest import latest_per_key, order_struct, sum_abs_by_year, value_at_latest

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's.
# ---------------------------------------------------------------------------
FILING_SCOPE = {"tipo_dem": "con", "ordem_exerc": "ÚLTIMO"}  # consolidated, latest exercise
EPS_ACCOUNT_PREFIX = "3.99.01."
EPS_SHARE_CLASSES = ("ON", "PN", "PNA", "PNB")
EPS_PREFERRED_CLASS = "ON"
NET_INCOME_ACCOUNTS = ("3.11", "3.09")
NET_INCOME_PREFERRED = "3.11"
DIVIDEND_PATTERNS = ("dividendo", "juros sobre capital")
PAYOUT_PLACES = 3
# ---------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def filing_filter(df: DataFrame, equals: dict | None = None, isin: dict | None = None,
                  prefix: dict | None = None) -> DataFrame:
    """Equality, IN and prefix predicates; all of them reach the parquet scan."""
    cond = F.lit(True)
    for c, v in (equals or {}).items():
        cond = cond & (F.col(c) == v)
    for c, vs in (isin or {}).items():
        cond = cond & F.col(c).isin(*vs)
    for c, p in (prefix or {}).items():
        cond = cond & F.col(c).startswith(p)
    return df.where(cond)


def contains_any_folded(col, patterns: Sequence[str]) -> Column:
    """Accent- and case-insensitive substring test, OR over the patterns."""
    folded = F.lower(fold_accents(col))
    cond = None
    for p in patterns:
        c = folded.contains(fold_literal(p).lower())
        cond = c if cond is None else (cond | c)
    return cond


def latest_eps(filings: DataFrame, key: str, year, value: str, share_class, preferred=EPS_PREFERRED_CLASS,
               classes: Sequence[str] = EPS_SHARE_CLASSES, tie_break: Sequence[str] = ()) -> DataFrame:
    """Per entity the EPS of the newest year, preferred class first, then the largest |value|.

    Rows with a zero value or another class are dropped first (as the reference's WHERE).
    """
    cls = _c(share_class)
    f = filings.withColumn("_year", _c(year)).withColumn("_class", cls)
    f = f.where((F.col(value) != 0) & F.col("_class").isin(*classes))
    order = [F.col("_year"), F.col("_class") == preferred, F.abs(F.col(value)),
             *[(t, "asc") for t in tie_break]]
    out = latest_per_key(f.select(key, "_year", "_class", value, *tie_break), key, order,
                         columns=["_year", "_class", value])
    return out.select(key, F.col(value).alias("eps"), F.col("_year").alias("year"), F.col("_class").alias("share_class"))


def latest_net_income(filings: DataFrame, key: str, year, value: str, account, scale: str,
                      preferred=NET_INCOME_PREFERRED, accounts: Sequence[str] = NET_INCOME_ACCOUNTS,
                      tie_break: Sequence[str] = ()) -> DataFrame:
    """Per entity the net income of the newest year, preferred account first; keeps the scale."""
    f = filings.withColumn("_year", _c(year)).withColumn("_acct", _c(account)).withColumn("_scale", _c(scale))
    f = f.where(F.col("_acct").isin(*accounts))
    order = [F.col("_year"), F.col("_acct") == preferred, *[(t, "asc") for t in tie_break]]
    out = latest_per_key(f.select(key, "_year", "_acct", "_scale", value, *tie_break), key, order,
                         columns=["_year", "_scale", value])
    return out.select(key, F.col(value).alias("net_income"), F.col("_scale").alias("scale"),
                      F.col("_year").alias("year"),
                      scale_units(F.col(value), F.col("_scale")).alias("net_income_units"))


def dividends_by_year(filings: DataFrame, key: str, year, value: str, scale: str | None = None) -> DataFrame:
    """A1: sum of |value| per entity and year (exact decimal sum); with ``scale`` in currency units, row by row."""
    if scale is None:
        return sum_abs_by_year(filings, key, year, value, exact_scale=2, out="dividends")
    return sum_abs_by_year(filings, key, year, scale_units(F.col(value), F.col(scale)), exact_scale=2, out="dividends")


def latest_year_dividends(by_year: DataFrame, key: str) -> DataFrame:
    """A2: per entity the yearly total of the newest year (null totals skipped first)."""
    return value_at_latest(by_year, key, "year", "dividends")


def payout_of(dividends, net_income_units, dividend_scale=DIVIDEND_SCALE, cap: float = PAYOUT_CAP,
              places: int = PAYOUT_PLACES) -> Column:
    """V1: clamp(dividends * scale / net income, 0, cap) when dividends are non-zero and income > 0, else null."""
    d, ni = _c(dividends), _c(net_income_units)
    scale = dividend_scale if isinstance(dividend_scale, Column) else F.lit(float(dividend_scale))
    ok = F.coalesce((d != 0) & (ni > 0), F.lit(False))
    return F.when(ok, round_half_even(clamp(d * scale / ni, 0.0, cap), places))


def payout_ratio(income: DataFrame, dividends: DataFrame, key: str, dividend_scale=DIVIDEND_SCALE,
                 cap: float = PAYOUT_CAP, default: float = PAYOUT_DEFAULT, places: int = PAYOUT_PLACES,
                 require_same_year: bool = False) -> DataFrame:
    """V1: the payout of every entity of either input; where no ratio exists the default applies.

    ``income`` has (key, net_income_units), ``dividends`` (key, dividends). ``dividend_scale`` is a number or a column of
    ``dividends`` (a scale for each row). By default each side brings its own newest year, which may differ. With
    ``require_same_year`` both have a ``year`` as well, ``dividends`` every year of an entity, and the ratio is that
    of the income's year; entities without dividends of that year get the default.
    """
    on = [key, "year"] if require_same_year else [key]
    scale = dividend_scale if isinstance(dividend_scale, Column) else F.lit(float(dividend_scale))
    paid = dividends.select(*on, "dividends", scale.alias("_scale"))
    own = income.select(*on, "net_income_units")
    if require_same_year:
        # Entities with dividends only have no income year: one row each, without a ratio.
        others = paid.select(key).distinct().join(own, key, "left_anti")
        j = own.join(paid, on, "left").unionByName(others, allowMissingColumns=True)
    else:
        j = own.join(paid, key, "full")
    ratio = payout_of("dividends", "net_income_units", F.col("_scale"), cap, places)
    return j.select(key, "dividends", "net_income_units", ratio.alias("payout_raw"),
                    F.coalesce(ratio, F.lit(default)).alias("payout"))


def filing_years(filings: DataFrame, key: str, year: str, tie_break: Sequence[str], *, eps_where: Column, eps_value: Column,
                 eps_class: str, eps_preferred, income_where: Column, income_value: Column, income_account: str,
                 income_preferred, scale: str, dividend_where: Column, dividend_value: Column, exact_scale: int = 2) -> DataFrame:
    """The figures of every entity and year, for :func:`newest_figures`: (key, _year, _eps, _income, _paid).

    One aggregate takes the best EPS row, the best income row (each a maximum over its order, under its own filter; rows
    outside it are null and lose) and the exact dividend total. An entity keeps one row a year however many filings it
    has, so this is the form to store in buckets by entity.
    """
    def best(where: Column, order: Sequence, **values) -> Column:
        row = F.struct(order_struct(filings, order).alias("order"), *[v.alias(n) for n, v in values.items()])
        return F.max(F.when(where, row))

    asc = [(t, "asc") for t in tie_break]
    total = F.abs(F.when(dividend_where, dividend_value)).cast(f"decimal(28,{exact_scale})")
    return filings.groupBy(F.col(key), F.col(year).alias("_year")).agg(
        best(eps_where & (eps_value != 0), [F.col(eps_class) == eps_preferred, F.abs(eps_value), *asc], value=eps_value).alias("_eps"),
        best(income_where, [F.col(income_account) == income_preferred, *asc], value=income_value, scale=F.col(scale)).alias("_income"),
        F.sum(total).cast("double").alias("_paid"))


def newest_figures(years: DataFrame, key: str) -> DataFrame:
    """The newest EPS, income and dividends of every entity from :func:`filing_years`; columns as :func:`filing_figures`.

    Over rows stored in buckets by ``key`` this is one aggregate without a shuffle.
    """
    def newest(value: Column, name: str) -> Column:
        return F.max_by(F.struct(value.alias("v"), F.col("_year").alias("year")), F.when(value.isNotNull(), F.struct(F.col("_year").isNotNull(), "_year"))).alias(name)

    rows = years.groupBy(key).agg(newest(F.col("_eps"), "_eps"), newest(F.col("_income"), "_income"),
                                  F.max_by(F.struct(F.col("_paid").alias("v"), F.col("_year").alias("year")),
                                           F.when(F.col("_paid").isNotNull(), F.col("_year"))).alias("_paid"))
    income, unit = F.col("_income.v.value"), F.col("_income.v.scale")
    return rows.select(key, F.col("_eps.v.value").alias("eps"), F.col("_eps.year").alias("eps_year"), income.alias("net_income"),
                       unit.alias("scale"), F.col("_income.year").alias("income_year"), scale_units(income, unit).alias("net_income_units"),
                       F.col("_paid.v").alias("dividends"), F.col("_paid.year").alias("dividends_year"))


def filing_figures(filings: DataFrame, key: str, year: str, tie_break: Sequence[str], **accounts) -> DataFrame:
    """W1, W2, A1 and A2 in one pass over the filings: one row per entity.

    :func:`filing_years` (its ``accounts``) reduces the filings to an entity's years before and after one shuffle,
    :func:`newest_figures` takes the newest of each. The filings are scanned and shuffled once.
    Columns: key, eps, eps_year, net_income, scale, income_year, net_income_units, dividends, dividends_year.
    """
    return newest_figures(filing_years(filings, key, year, tie_break, **accounts), key)


def eps_with_fallback(primary, secondary, places: int = 2) -> Column:
    """V2: primary EPS if plausible, else the secondary source if plausible (Q4)."""
    fallback = round_half_even(first_plausible(secondary), places)
    return round_half_even(F.coalesce(first_plausible(primary), fallback), places)
