"""Global config and per-stock effective assumptions.

The global config is one row by construction (a global aggregate); it reaches the
stock rows as uncorrelated scalar subqueries, which Spark runs once and merges,
so applying it costs no join and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valorum.functions.values import flag_override, mode_to_text, nonblank, text_to_mode

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's.
# ---------------------------------------------------------------------------
# (API name, stored key, default) of the numeric global settings.
CONFIG_KEYS = (
    ("ke", "ke_global", 0.14),
    ("roet", "roet_global", 0.12),
    ("payoutt", "payoutt_global", 0.60),
    ("fade", "fade_global", 10.0),
    ("ipca", "ipca_global", 0.045),
    ("ntnb", "ntnb_global", 0.072),
    ("premio", "premio_global", 0.0),
)
CONFIG_MODE_KEY = ("ke_mode", "ke_mode_global", 0.0)
DEFAULT_ROE_I = 0.15
DEFAULT_GROWTH_MODE = "roe"
# Columns of a stored assumption row, then its four "use global default" flags.
ASSUMPTION_VALUES = ("lpa", "roe_i", "payout_i", "roe_t", "payout_t", "fade", "ke",
                     "growth_mode", "g_i", "g_t", "fut_pe", "mos")
ASSUMPTION_FLAGS = ("ke_default", "roet_default", "payoutt_default", "fade_default")
# ---------------------------------------------------------------------------


def config_wide(config: DataFrame, key: str = "k", value: str = "v") -> DataFrame:
    """key/value rows to exactly one wide row; NULL or absent values take the default (D3)."""
    k, v = F.col(key), F.col(value)
    cols = [F.coalesce(F.max(F.when(k == dbk, v)), F.lit(float(dflt))).alias(api)
            for api, dbk, dflt in CONFIG_KEYS]
    api, dbk, dflt = CONFIG_MODE_KEY
    cols.append(mode_to_text(F.coalesce(F.max(F.when(k == dbk, v)), F.lit(dflt))).alias(api))
    return config.agg(*cols)


def config_long(changes: DataFrame, carry=()) -> DataFrame:
    """A wide change (API names) to (k, v) rows; absent (NULL) settings are skipped.

    Text values are parsed with ``try_cast`` (D7): unparsable text is skipped like an
    absent value instead of failing the job; :func:`config_rejects` lists those rows.
    ``carry`` columns (e.g. the write time) are kept beside every (k, v) row.
    """
    present = [api for api, _, _ in CONFIG_KEYS if api in changes.columns]
    exprs = [F.struct(F.lit(dbk).alias("k"), F.col(api).try_cast("double").alias("v"))
             for api, dbk, _ in CONFIG_KEYS if api in present]
    if CONFIG_MODE_KEY[0] in changes.columns:
        api, dbk, _ = CONFIG_MODE_KEY
        exprs.append(F.struct(F.lit(dbk).alias("k"),
                              F.when(F.col(api).isNotNull(), text_to_mode(F.col(api))).alias("v")))
    return changes.select(*carry, F.inline(F.array(*exprs))).where(F.col("v").isNotNull())


def config_rejects(changes: DataFrame, carry=()) -> DataFrame:
    """The (k, text) settings that were sent but are not numbers."""
    exprs = [F.struct(F.lit(dbk).alias("k"), F.col(api).cast("string").alias("text"),
                      F.col(api).try_cast("double").alias("v"))
             for api, dbk, _ in CONFIG_KEYS if api in changes.columns]
    out = changes.select(*carry, F.inline(F.array(*exprs)))
    return out.where(F.col("text").isNotNull() & F.col("v").isNull()).drop("v")


def monitored_flag(stocks: DataFrame, watchlist: DataFrame, key: str = "ticker",
                   own_flag: str = "monitored", out: str = "monitored") -> DataFrame:
    """Membership in the watchlist when it has any row, else the stock's own flag (Q11)."""
    members = watchlist.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_in_wl", F.lit(True))
    joined = stocks.join(members, key, "left")
    flag = F.when(F.lit(watchlist.exists()), F.coalesce(F.col("_in_wl"), F.lit(False))).otherwise(
        F.coalesce(F.col(own_flag).cast("boolean"), F.lit(False)))
    return joined.withColumn(out, flag).drop("_in_wl")


def effective_assumptions(stocks: DataFrame, current: DataFrame, config: DataFrame,
                          watchlist: DataFrame | None = None, key: str = "ticker",
                          keep_seed_rates: bool = False) -> DataFrame:
    """V5: per-stock effective assumptions.

    ``stocks`` has key, lpa, payout, roe_i (and g1, gp); ``current`` one row per key
    with the stored assumption columns and flags; ``config`` the wide row of
    :func:`config_wide`. Starting values: stored, else the stock's data; terminal
    values and the rate: stored only if its flag is off (NULL flag = on, D1).
    """
    # One uncorrelated scalar subquery returns the config values (run once, no join). An
    # array, not a struct: field pruning would split a struct into one subquery per field.
    # It is attached once as a column; every use reads that column.
    names = ("ke", "roet", "payoutt", "fade")
    row = config.select(F.array(*[F.col(c).cast("double") for c in names]).alias("cfg")).scalar()
    cfg = {c: F.element_at(F.col("_cfg"), i + 1) for i, c in enumerate(names)}
    g_t_global = cfg["roet"] * (1.0 - cfg["payoutt"])
    cur_cols = [c for c in (*ASSUMPTION_VALUES, *ASSUMPTION_FLAGS) if c in current.columns]
    cur = current.select(F.col(key), *[F.col(c).alias("a_" + c) for c in cur_cols])
    for c in (*ASSUMPTION_VALUES, *ASSUMPTION_FLAGS):
        if c not in cur_cols:
            cur = cur.withColumn("a_" + c, F.lit(None).cast("string" if c == "growth_mode" else "double"))
    base = stocks
    if watchlist is not None:
        base = monitored_flag(base, watchlist, key)
    j = base.join(cur, key, "left").withColumn("_cfg", row)

    def a(c) -> Column:
        return F.col("a_" + c)

    out = j.withColumns({
        "lpa": F.coalesce(a("lpa"), F.col("lpa")),
        "roe_i": F.coalesce(a("roe_i"), F.col("roe_i"), F.lit(DEFAULT_ROE_I)),
        "payout_i": F.coalesce(a("payout_i"), F.col("payout")),
        "ke_eff": flag_override(a("ke_default"), a("ke"), cfg["ke"]),
        "roe_t": flag_override(a("roet_default"), a("roe_t"), cfg["roet"]),
        "payout_t": flag_override(a("payoutt_default"), a("payout_t"), cfg["payoutt"]),
        "fade": flag_override(a("fade_default"), a("fade"), cfg["fade"]),
        "growth_mode": F.coalesce(nonblank(a("growth_mode")), F.lit(DEFAULT_GROWTH_MODE)),
        "g_i": a("g_i"),
        "g_t": flag_override(a("roet_default"), a("g_t"), g_t_global),
        "fut_pe": a("fut_pe"),
        "mos": a("mos"),
    })
    drop = [c for c in out.columns if c.startswith("a_") or c == "_cfg"]
    out = out.drop(*drop)
    if not keep_seed_rates:
        out = out.drop(*[c for c in ("g1", "gp", "payout") if c in out.columns])
        if "ke" in out.columns:
            out = out.drop("ke")
    else:
        out = out.withColumnRenamed("ke", "seed_ke") if "ke" in out.columns else out
    return out.withColumnRenamed("ke_eff", "ke")
