"""Two-stage dividend-discount valuation over whole tables.

The projection is unrolled into Column arithmetic for a fixed number of years, so
every stock is valued inside one whole-stage-codegen projection, with no Python
and no shuffle. Year-by-year multiplication keeps the reference's float order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valorum.functions.sqltext import expr, ident, lit
from valorum.functions.values import format_brl, format_ptbr

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's.
# ---------------------------------------------------------------------------
DEFAULT_YEARS = 5
# What-if input ranges of the calculator, in percent: (low, high, step).
PAYOUT_RANGE = (0.0, 100.0, 1.0)
GROWTH_RANGE = (0.0, 20.0, 0.5)
RATE_RANGE = (6.0, 25.0, 0.5)
PERPETUAL_RANGE = (0.0, 10.0, 0.5)
STEP_LABELS = ("base dividend", "present value sum", "terminal value", "discounted terminal", "fair value")
# ---------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ddm_columns(eps, payout, g1, ke, gp, years: int = DEFAULT_YEARS) -> dict[str, Column]:
    """Column expressions of the valuation for one stock row (V6, V7).

    Returns d0, pv_sum, d_next, terminal, terminal_pv, fair, valid, fair_display.
    """
    if years < 1:
        raise ValueError("years must be >= 1")
    if all(isinstance(c, str) for c in (eps, payout, g1, ke, gp)):
        return {k: expr(v) for k, v in ddm_sql_text(*map(ident, (eps, payout, g1, ke, gp)), years).items()}
    eps, payout, g1, ke, gp = map(_c, (eps, payout, g1, ke, gp))
    d0 = eps * payout
    d = d0
    pv_sum = None
    for n in range(1, years + 1):
        d = d * (1.0 + g1)
        pv = d / F.power(1.0 + ke, F.lit(float(n)))
        pv_sum = pv if pv_sum is None else pv_sum + pv
    d_next = d * (1.0 + gp)
    valid = ke > gp
    terminal = F.when(valid, d_next / (ke - gp))
    terminal_pv = F.when(valid, terminal / F.power(1.0 + ke, F.lit(float(years))))
    fair = F.when(valid, pv_sum + terminal_pv).otherwise(pv_sum)
    return {
        "d0": d0,
        "pv_sum": pv_sum,
        "d_next": d_next,
        "terminal": terminal,
        "terminal_pv": terminal_pv,
        "fair": fair,
        "valid": valid,
        "fair_display": F.when(valid, fair),
    }


def ddm_sql_text(eps: str, payout: str, g1: str, ke: str, gp: str, years: int = DEFAULT_YEARS) -> dict[str, str]:
    """The same valuation as SQL expression text (one parse instead of one call per node)."""
    d = f"({eps} * {payout})"
    d0 = d
    pv_sum = None
    for n in range(1, years + 1):
        d = f"({d} * (1.0D + {g1}))"
        pv = f"({d} / power(1.0D + {ke}, {float(n)}D))"
        pv_sum = pv if pv_sum is None else f"({pv_sum} + {pv})"
    d_next = f"({d} * (1.0D + {gp}))"
    valid = f"({ke} > {gp})"
    terminal = f"CASE WHEN {valid} THEN ({d_next} / ({ke} - {gp})) END"
    terminal_pv = f"CASE WHEN {valid} THEN ({terminal} / power(1.0D + {ke}, {float(years)}D)) END"
    fair = f"CASE WHEN {valid} THEN ({pv_sum} + {terminal_pv}) ELSE {pv_sum} END"
    return {"d0": d0, "pv_sum": pv_sum, "d_next": d_next, "terminal": terminal, "terminal_pv": terminal_pv,
            "fair": fair, "valid": valid, "fair_display": f"CASE WHEN {valid} THEN {fair} END"}


def ddm_value(df: DataFrame, eps="eps", payout="payout", g1="g1", ke="ke", gp="gp",
              years: int = DEFAULT_YEARS, prefix: str = "") -> DataFrame:
    """V7: add the valuation columns to every row (narrow, no shuffle)."""
    cols = ddm_columns(eps, payout, g1, ke, gp, years)
    return df.withColumns({prefix + k: v for k, v in cols.items()})


def margin_of_safety(fair, price, valid) -> Column:
    """V9: (fair - price) / price * 100 when price > 0 and the value is valid."""
    fair, price, valid = map(_c, (fair, price, valid))
    ok = F.coalesce(price > 0, F.lit(False)) & F.coalesce(valid, F.lit(False))
    return F.when(ok, (fair - price) / price * 100.0)


def margin_label(mos) -> Column:
    """V9: 'good' for a non-negative margin, 'bad' below zero, null without a margin."""
    m = _c(mos)
    return F.when(m >= 0, F.lit("good")).when(m < 0, F.lit("bad"))


def margin_text(mos, price) -> Column:
    """V9 badge text: '+34,4% de margem vs R$ 30,50' (sign only when non-negative); null without a margin."""
    m, p = _c(mos), _c(price)
    sign = F.when(m >= 0, F.lit("+")).otherwise(F.lit(""))
    return F.when(m.isNotNull(), F.concat(sign, format_ptbr(m, 1), F.lit("% de margem vs R$ "), format_ptbr(p, 2)))


def ddm_ledger(df: DataFrame, key, eps="eps", payout="payout", g1="g1", ke="ke",
               years: int = DEFAULT_YEARS) -> DataFrame:
    """V8: one row per projection year with the year-0 base row (n=0, no factor/pv).

    Rows are generated next to their stock (Generate, no join, no shuffle).
    """
    keys = [key] if isinstance(key, str) else list(key)
    eps, payout, g1, ke = map(_c, (eps, payout, g1, ke))
    # Year by year, as the valuation itself multiplies.
    dividends = [eps * payout]
    for _ in range(years):
        dividends.append(dividends[-1] * (1.0 + g1))
    base = df.select(*keys, ke.alias("_ke"), F.posexplode(F.array(*dividends)).alias("n", "dividend"))
    factor = F.when(F.col("n") > 0, F.power(1.0 + F.col("_ke"), F.col("n").cast("double")))
    return base.select(*keys, "n", "dividend", factor.alias("factor"),
                       (F.col("dividend") / factor).alias("pv"))


def ddm_steps(df: DataFrame, key, prefix: str = "") -> DataFrame:
    """The calculation steps as long rows (step, label, value, text).

    Expects the columns added by :func:`ddm_value`.
    """
    keys = [key] if isinstance(key, str) else list(key)
    p = prefix
    entries = [
        (1, STEP_LABELS[0], F.col(p + "d0")),
        (2, STEP_LABELS[1], F.col(p + "pv_sum")),
        (3, STEP_LABELS[2], F.col(p + "terminal")),
        (3, STEP_LABELS[3], F.col(p + "terminal_pv")),
        (4, STEP_LABELS[4], F.col(p + "fair_display")),
    ]
    structs = [F.struct(F.lit(s).alias("step"), F.lit(lbl).alias("label"), v.cast("double").alias("value"))
               for s, lbl, v in entries]
    long = df.select(*keys, F.inline(F.array(*structs)))
    return long.withColumn("text", F.when(F.col("value").isNull(), F.lit("—"))
                           .otherwise(format_brl(F.col("value"))))


def grid_values(lo: float, hi: float, step: float) -> list[float]:
    """Points of a slider range, in fractions (percent / 100)."""
    count = int(round((hi - lo) / step)) + 1
    return [round(lo + i * step, 10) / 100.0 for i in range(count)]


def _grid_fair(eps, payout, g1, rates, perpetuals, years: int) -> tuple[Column, dict[str, Column]]:
    """Array of fair values (NULL where invalid) over the (rate, perpetual) grid, rate-major.

    The projected dividends d_1..d_N do not depend on the grid, so they are row
    columns; the inner lambdas only redo what depends on the rate (present values,
    discount factor) and on the perpetual growth (terminal value), with the same
    float operations, in the same order, as :func:`ddm_columns`.
    """
    eps, payout, g1 = map(_c, (eps, payout, g1))
    d = eps * payout
    divs = {}
    for n in range(1, years + 1):
        d = d * (1.0 + g1)
        divs[f"_d{n}"] = d
    ke_arr = F.array(*[F.lit(float(k)) for k in rates])
    gp_arr = F.array(*[F.lit(float(g)) for g in perpetuals])

    def per_rate(k):
        pv_sum = None
        for n in range(1, years + 1):
            pv = F.col(f"_d{n}") / F.power(1.0 + k, F.lit(float(n)))
            pv_sum = pv if pv_sum is None else pv_sum + pv
        return F.struct(k.alias("ke"), pv_sum.alias("pv"), F.power(1.0 + k, F.lit(float(years))).alias("f"))

    def per_point(r, g):
        terminal = F.col(f"_d{years}") * (1.0 + g) / (r["ke"] - g)
        return F.struct(r["ke"].alias("ke"), g.alias("gp"),
                        F.when(r["ke"] > g, r["pv"] + terminal / r["f"]).alias("fair"))

    grid = F.flatten(F.transform(F.transform(ke_arr, per_rate),
                                 lambda r: F.transform(gp_arr, lambda g: per_point(r, g))))
    return grid, divs


def ddm_scenarios(df: DataFrame, key, eps="eps", payout="payout", g1="g1",
                  rates=None, perpetuals=None, years: int = DEFAULT_YEARS) -> DataFrame:
    """V11 long form: one row per stock and (rate, perpetual growth) grid point.

    The grid is generated next to each stock row from a fixed, parameter-sized
    list (39 x 21 = 819 points by default); no join.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rates = rates if rates is not None else grid_values(*RATE_RANGE)
    perpetuals = perpetuals if perpetuals is not None else grid_values(*PERPETUAL_RANGE)
    grid, divs = _grid_fair(eps, payout, g1, rates, perpetuals, years)
    base = df.select(*keys, *[v.alias(k) for k, v in divs.items()])
    return base.select(*keys, F.inline(grid)).select(*keys, "ke", "gp", "fair",
                                                     F.col("fair").isNotNull().alias("valid"))


def scenario_summary(df: DataFrame, key, eps="eps", payout="payout", g1="g1",
                     rates=None, perpetuals=None, years: int = DEFAULT_YEARS) -> DataFrame:
    """V11 summary per stock: points, valid share, min / median / max fair over valid points.

    Computed inside each row with array functions, so the 819-fold expansion
    never reaches a shuffle.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rates = rates if rates is not None else grid_values(*RATE_RANGE)
    perpetuals = perpetuals if perpetuals is not None else grid_values(*PERPETUAL_RANGE)
    from valorum.session import spread

    eps, payout, g1 = map(_c, (eps, payout, g1))
    d, divs = eps * payout, {}
    for n in range(1, years + 1):
        d = d * (1.0 + g1)
        divs[f"_d{n}"] = d
    base = spread(df.select(*keys, *[v.alias(k) for k, v in divs.items()]))
    # Rates and perpetuals are known here, so each point is a short compiled expression (with the operations of ddm_columns, in
    # their order); what depends on one of the two only is a column of its own. sort_array compares doubles without a lambda.
    points = [(i, j) for i, k in enumerate(rates) for j, g in enumerate(perpetuals) if k > g and 1.0 + k != 0]
    present = [" + ".join(f"_d{n} / power({lit(1.0 + float(k))}, {lit(float(n))})" for n in range(1, years + 1)) for k in rates]
    grown = [f"_d{years} * {lit(1.0 + float(g))}" for g in perpetuals]
    base = base.select(*keys, *[expr(x).alias(f"_p{i}") for i, x in enumerate(present)], *[expr(x).alias(f"_g{j}") for j, x in enumerate(grown)])
    fair = [f"_p{i} + _g{j} / {lit(float(rates[i]) - float(perpetuals[j]))} / power({lit(1.0 + float(rates[i]))}, {lit(float(years))})" for i, j in points]
    # Without a dividend no point has a value; with one, every point has. The small lambda keeps the long array out of whole-stage
    # code, whose one method it would not fit; the projection is then compiled in pieces.
    none = "cast(array() as array<double>)"
    vals = expr(f"CASE WHEN exists(array(_g{points[0][1]}), x -> x IS NULL) THEN {none} ELSE sort_array(array({', '.join(fair)})) END"
                if fair else none)
    n_points = len(rates) * len(perpetuals)
    out = base.select(*keys, vals.alias("_v"))
    n = F.size("_v")
    mid_lo = F.element_at("_v", ((n + 1) / 2).cast("int"))
    mid_hi = F.element_at("_v", (n / 2 + 1).cast("int"))
    median = F.when(n == 0, F.lit(None)).when(n % 2 == 1, mid_lo).otherwise(
        (F.element_at("_v", (n / 2).cast("int")) + mid_hi) / 2.0)
    return out.select(
        *keys,
        F.lit(n_points).cast("long").alias("n_points"),
        n.cast("long").alias("n_valid"),
        (n / float(n_points)).alias("share_valid"),
        F.when(n > 0, F.element_at("_v", 1)).alias("min_fair"),
        median.alias("median_fair"),
        F.when(n > 0, F.element_at("_v", -1)).alias("max_fair"),
    )


# --- all four sliders at once ---------------------------------------------------------------------------------------
def unit_values(growths, rates, perpetuals, years: int = DEFAULT_YEARS) -> np.ndarray:
    """Fair values of one unit of base dividend over the valid (growth, rate, perpetual) points, ascending."""
    g, k, p = (np.array(a, float) for a in (growths, rates, perpetuals))
    grown = (1 + g)[:, None] ** np.arange(1, years + 1)
    present = (grown[:, None, :] / (1 + k)[None, :, None] ** np.arange(1, years + 1)).sum(2)
    valid = k[:, None] > p
    with np.errstate(divide="ignore"):
        terminal = (1 + p) / np.where(valid, k[:, None] - p, 1) / (1 + k)[:, None] ** years
    fair = present[:, :, None] + grown[:, None, None, -1] * terminal
    return np.sort(fair[:, valid].ravel())


def kth_product(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """The k-th smallest (from 0) of all products of two ascending lists of non-negative numbers.

    Bisection over the floating numbers themselves: a row of products ascends, so each count of products up to a value is
    one binary search for each entry of ``a``. The products are never written out.
    """
    def upto(t: float) -> int:
        with np.errstate(divide="ignore", invalid="ignore"):
            n = np.searchsorted(b, np.where(a > 0, t / np.where(a > 0, a, 1), np.inf), "right")
        while (more := (n < len(b)) & (a * b[np.minimum(n, len(b) - 1)] <= t)).any():  # rounding of the quotient
            n = n + more
        while (less := (n > 0) & (a * b[np.maximum(n - 1, 0)] > t)).any():
            n = n - less
        return int(n.sum())

    # Non-negative floating numbers are ordered as their bits are.
    lo, hi = -1, int(np.float64(a[-1] * b[-1]).view(np.int64))
    while hi - lo > 1:
        middle = (lo + hi) // 2
        if upto(float(np.int64(middle).view(np.float64))) > k:
            hi = middle
        else:
            lo = middle
    return float(np.int64(hi).view(np.float64))


def what_if_summary(df: DataFrame, key, eps="eps", payouts=None, growths=None, rates=None, perpetuals=None,
                    years: int = DEFAULT_YEARS) -> DataFrame:
    """V11 over all four sliders: points, valid share, min / median / max fair value per stock.

    A fair value is EPS x payout x G(growth, rate, perpetual), and the last two range over the sliders alone. So a stock's
    order statistics are its EPS times those of the products payout x G (the mirrored ones for a negative EPS),
    which are found once from the two sorted factor lists. The plan is one projection; the 101 x 41 x 39 x 21
    points are never made. Stocks without EPS have no valid point. Slider values below zero are allowed for growth and
    perpetual growth down to -1, not for payouts.
    """
    payouts = payouts if payouts is not None else grid_values(*PAYOUT_RANGE)
    growths = growths if growths is not None else grid_values(*GROWTH_RANGE)
    rates = rates if rates is not None else grid_values(*RATE_RANGE)
    perpetuals = perpetuals if perpetuals is not None else grid_values(*PERPETUAL_RANGE)
    if min(payouts) < 0 or min(*growths, *perpetuals) < -1 or min(rates) <= -1:
        raise ValueError("slider values must keep every factor of the fair value at zero or above")
    a, b = np.sort(np.array(payouts, float)), unit_values(growths, rates, perpetuals, years)
    points, valid = len(payouts) * len(growths) * len(rates) * len(perpetuals), len(a) * len(b)
    keys = [key] if isinstance(key, str) else list(key)
    e = _c(eps)
    has = e.isNotNull() & F.lit(valid > 0)
    low = high = median = F.lit(None).cast("double")
    if valid:
        middle = (kth_product(a, b, (valid - 1) // 2) + kth_product(a, b, valid // 2)) / 2
        ends = [F.lit(float(a[0] * b[0])), F.lit(float(a[-1] * b[-1]))]
        low = F.when(e >= 0, e * ends[0]).otherwise(e * ends[1])
        high = F.when(e >= 0, e * ends[1]).otherwise(e * ends[0])
        median = e * F.lit(middle)
    return df.select(*keys, F.lit(points).cast("long").alias("n_points"), F.when(has, F.lit(valid)).otherwise(0).cast("long").alias("n_valid"),
                     F.when(has, F.lit(valid / points)).otherwise(0.0).alias("share_valid"), low.alias("min_fair"),
                     median.alias("median_fair"), high.alias("max_fair"))


__all__ = [
    "ddm_columns", "ddm_value", "margin_of_safety", "margin_label", "ddm_ledger", "ddm_steps",
    "ddm_scenarios", "scenario_summary", "what_if_summary", "grid_values", "format_ptbr",
]


def register_sql_functions(spark, years: int = DEFAULT_YEARS, name: str = "ddm_fair") -> str:
    """SQL surface (2.13): the fair value as a SQL-bodied temporary function.

    ``ddm_fair(eps, payout, g1, ke, gp)`` is inlined by the optimizer like any
    expression (no Python in the plan). Returns the function name.
    """
    body = ddm_sql_text("eps", "payout", "g1", "ke", "gp", years)["fair"]
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(eps DOUBLE, payout DOUBLE, g1 DOUBLE, ke DOUBLE, "
              f"gp DOUBLE) RETURNS DOUBLE RETURN {body}")
    return name


def register_ledger_function(spark, years: int = DEFAULT_YEARS, name: str = "ddm_ledger") -> str:
    """SQL surface (2.13): the projection ledger as a SQL-bodied table function, called with LATERAL.

    ``ddm_ledger(eps, payout, g1, ke)`` returns a row for each year from 0 (no factor, no present value): dividend, discount
    factor, present value, and the present values summed so far, so the last row holds the total. The body reads its
    arguments alone and is inlined next to each row. Returns the function name.
    """
    dividends = ["(eps * payout)"]
    for _ in range(years):
        dividends.append(f"({dividends[-1]} * (1.0D + g1))")
    rows, total = [], None
    for n, dividend in enumerate(dividends):
        factor = f"power(1.0D + ke, {float(n)}D)" if n else "CAST(NULL AS DOUBLE)"
        pv = f"({dividend} / {factor})"
        total = None if not n else pv if total is None else f"({total} + {pv})"
        rows.append(f"struct({n} AS n, {dividend} AS dividend, {factor} AS factor, {pv} AS pv, {total or '0.0D'} AS pv_sum)")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(eps DOUBLE, payout DOUBLE, g1 DOUBLE, ke DOUBLE) "
              f"RETURNS TABLE (n INT, dividend DOUBLE, factor DOUBLE, pv DOUBLE, pv_sum DOUBLE) "
              f"RETURN SELECT r.n, r.dividend, r.factor, r.pv, r.pv_sum FROM (SELECT explode(array({', '.join(rows)})) AS r)")
    return name
