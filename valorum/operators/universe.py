"""Universe build: one row per listed security with identity, classes, tags and fundamentals.

Joins are grouped by key: everything keyed by company code is joined first (all
inputs are one row per code, so they co-partition), then the resolved tickers
meet that company table once, then the ticker-keyed inputs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from valorum.functions.classify import (SqlText, classify_governance, classify_size, derive_profile, derive_tags)
from valorum.functions.sqltext import ident
from valorum.functions.text import clean_label, clean_label_sql
from valorum.functions.values import DIVIDEND_SCALE, PAYOUT_DEFAULT, nonzero, plausible, round_half_even
from valorum.operators.fundamentals import payout_of
from valorum.operators.resolve import resolve_entities
from valorum.sources.files import double_decode, write_version

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's.
# ---------------------------------------------------------------------------
DEFAULT_MODEL = "DDM · 2 est."
DEFAULT_ROE_I = 0.15
SEED_RATES = {"g1": 0.06, "ke": 0.14, "gp": 0.04}
SPOT_CHECK = ("PETR4", "VALE3", "ITUB4", "BBAS3", "WEGE3", "ABEV3", "TAEE11", "MGLU3")
UNMATCHED_SAMPLE = 8
# ---------------------------------------------------------------------------

UNIVERSE_COLUMNS = ("ticker", "nome", "cd_cvm", "setor", "subsetor", "segmento", "perfil", "tamanho", "gov", "ctrl",
                    "modelo", "tags", "monitored", "lpa", "payout", "roe_i", "liquidez", "g1", "ke", "gp")


def initial_roe(roe) -> Column:
    """V3: ROE percent / 100 (4 places) when positive, else 0.15."""
    r = F.col(roe) if isinstance(roe, str) else roe
    return F.when(F.coalesce(r > 0, F.lit(False)), round_half_even(r / 100.0, 4)).otherwise(F.lit(DEFAULT_ROE_I))


def company_facts(figures: DataFrame, registry: DataFrame, dividend_scale: float | Column = DIVIDEND_SCALE,
                  require_same_year: bool = False) -> DataFrame:
    """Per company code: EPS, payout, control and governance labels (all keyed by the padded code).

    ``figures`` is :func:`valorum.operators.fundamentals.filing_figures` (cd_cvm, eps, net_income_units, dividends and
    their years), one row per code; ``registry(cd_cvm, ctrl, payload)`` is brought to one row per code here. Both are
    grouped by the code already when they meet, so the join adds no exchange, and none is left at all where the inputs
    are stored in buckets by the code (:mod:`valorum.sources.buckets`). Rows without a code are left out: no security
    can be matched to them.
    """
    same = F.lit(True) if not require_same_year else F.coalesce(F.col("income_year") == F.col("dividends_year"), F.lit(False))
    payout = F.when(same, payout_of("dividends", "net_income_units", dividend_scale))
    own = figures.where(F.col("cd_cvm").isNotNull()).select("cd_cvm", "eps", payout.alias("payout_calc"))
    reg = (registry.where(F.col("cd_cvm").isNotNull())
           .select("cd_cvm", "ctrl", classify_governance(double_decode("payload")).alias("gov"))
           .groupBy("cd_cvm").agg(F.max("ctrl").alias("ctrl"), F.max("gov").alias("gov")))
    return own.join(reg, "cd_cvm", "full").select("cd_cvm", "eps", "payout_calc", "ctrl", "gov")


def build_universe(tickers: DataFrame, companies: DataFrame, facts: DataFrame, indicators: DataFrame,
                   snapshot: DataFrame, threshold: float = 0.72) -> DataFrame:
    """V4: the universe rows.

    ``tickers(ticker, empresa)``, ``companies(cd_cvm, empresa, ultimo_ano)`` with
    ``cd_cvm`` already padded text, ``facts`` from :func:`company_facts`,
    ``indicators`` one row per ticker (raw labels and numbers), ``snapshot(ticker, market_cap)``.
    """
    res = resolve_entities(tickers, "ticker", "empresa",
                           companies.withColumnRenamed("empresa", "_cname"), "cd_cvm", "_cname", "ultimo_ano",
                           threshold)
    # The company joins come first, on rows without the name: names are exchanged once, by ticker.
    company = res.select("ticker", F.col("match_id").alias("cd_cvm"), "how").join(facts, "cd_cvm", "left")
    # What follows from the indicators alone is worked out on their rows, before they meet the names.
    ind = indicators.select(
        "ticker", "lpa", "valormercado", "liquidezmediadiaria", F.lit(True).alias("_has_ind"),
        clean_label("sectorname").alias("_setor"), clean_label("subsectorname").alias("_subsetor"),
        clean_label("segmentname").alias("_segmento"),
        derive_profile(SqlText(clean_label_sql(ident("sectorname"))), "dy", "p_l", "p_vp", "receitas_cagr5", "roe").alias("_perfil"),
        derive_tags("dy", "p_l", "p_vp", "roe", "dividaliquidaebit", "lpa", "valormercado").alias("_tags"),
        initial_roe("roe").alias("_roe_i"))
    u = (tickers.join(company, "ticker", "left").join(ind, "ticker", "left")
         .join(snapshot.select("ticker", "market_cap"), "ticker", "left"))
    has = F.coalesce(F.col("_has_ind"), F.lit(False))
    fallback = round_half_even(plausible(F.col("lpa")), 2)
    lpa = F.coalesce(F.when(F.col("cd_cvm").isNotNull(), plausible(F.col("eps"))), fallback)
    mcap = F.coalesce(nonzero(F.col("valormercado")), F.col("market_cap"))
    liq = F.col("liquidezmediadiaria")
    out = u.select(
        "ticker",
        F.col("empresa").alias("nome"),
        "cd_cvm",
        *[F.when(has, F.col(f"_{c}")).otherwise(F.lit("")).alias(c) for c in ("setor", "subsetor", "segmento", "perfil")],
        classify_size(mcap).alias("tamanho"),
        F.coalesce(F.col("gov"), F.lit("")).alias("gov"),
        F.coalesce(F.col("ctrl"), F.lit("")).alias("ctrl"),
        F.lit(DEFAULT_MODEL).alias("modelo"),
        F.when(has, F.col("_tags")).otherwise(F.array().cast("array<string>")).alias("tags"),
        F.lit(False).alias("monitored"),
        round_half_even(lpa, 2).alias("lpa"),
        F.coalesce(F.col("payout_calc"), F.lit(PAYOUT_DEFAULT)).alias("payout"),
        F.when(has, F.col("_roe_i")).otherwise(F.lit(DEFAULT_ROE_I)).alias("roe_i"),
        F.when(F.coalesce(liq != 0, F.lit(False)), F.bround(liq, 0)).alias("liquidez"),
        *[F.lit(v).alias(k) for k, v in SEED_RATES.items()],
        "how",
    )
    return out


def quality_counters(key: str = "ticker", spot_check: Sequence[str] = SPOT_CHECK) -> list[Column]:
    """The build counters as aggregate columns."""
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("cd_cvm").isNotNull()).alias("matched"),
        F.count_if(F.col("lpa").isNotNull()).alias("with_lpa"),
        F.count_if(F.col("cd_cvm").isNull()).alias("no_match"),
        F.count_if(F.col("gov") != "").alias("gov_filled"),
        F.count_if(F.col(key).cast("string").isin(*[str(s) for s in spot_check])).alias("spot_found"),
    ]


def write_universe(universe: DataFrame, base: str, spot_check: Sequence[str] = SPOT_CHECK, sample: int = UNMATCHED_SAMPLE,
                   key: str = "ticker") -> tuple[str, DataFrame]:
    """V4 and A7 together: write the universe as a new version and report on it. Returns (path, one-row report).

    The counters are observed on the rows as they are written, so the universe is computed once and never read again for
    them. Only the first ``sample`` unmatched keys (a top-k, cut before anything is collected) read the written
    key columns back.
    """
    spark = universe.sparkSession
    seen = Observation()
    path = write_version(universe.observe(seen, *quality_counters(key, spot_check)), base)
    counts = seen.get
    first = (spark.read.parquet(path).where(F.col("cd_cvm").isNull()).select(key).orderBy(key).limit(sample)
             .agg(F.array_sort(F.collect_list(key)).alias("unmatched_sample")))
    names = ("total", "matched", "with_lpa", "no_match", "gov_filled")
    return path, first.select(*[F.lit(counts[n]).cast("long").alias(n) for n in names], "unmatched_sample",
                              F.lit(counts["spot_found"]).cast("long").alias("spot_found"))
