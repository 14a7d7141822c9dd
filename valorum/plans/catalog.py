"""Demo plans: one query per operator of the inventory, over the stand-in roles.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame; nothing is collected. Entries that write work
tables, files or streams (name resolution, universe, append log, sources, streams) do that work when called;
the others are lazy. Float outputs are rounded to six places (the oracle does the same).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valorum.operators import valuation as val
from valorum.plans import roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def r6(c: Column | str) -> Column:
    """Six-place display rounding, the same rule as the oracle's ``round(x, 6)``."""
    return F.round((F.col(c) if isinstance(c, str) else c) * 1e6) / 1e6


@query("ddm_fair_value")
def ddm_fair_value(spark: SparkSession, d: str) -> DataFrame:
    s = roles.stocks(spark, d)
    v = val.ddm_value(s, eps="lpa", payout="payout", g1="g1", ke="ke", gp="gp")
    return v.select("ticker", *[r6(c).alias(c) for c in
                                ("d0", "pv_sum", "d_next", "terminal", "terminal_pv", "fair")], "valid")


# --- filings: W1, W2, A1, A2, V1, V2 ---------------------------------------------------------
from valorum.operators import fundamentals as fund  # noqa: E402
from valorum.operators import latest as lt  # noqa: E402
from valorum.operators import quotes as qt  # noqa: E402
from valorum.operators import assumptions as asm  # noqa: E402
from valorum.functions import values as fv  # noqa: E402

TIE = ("l_orderkey", "l_linenumber")


def _eps(spark, d):
    f = roles.filings(spark, d).where(F.col("scope") == "F")
    return fund.latest_eps(f, "entity", "year", "value", "klass", preferred="R", classes=("R", "A"), tie_break=TIE)


def _net_income(spark, d):
    f = roles.filings(spark, d).where(F.col("scope") == "F")
    return fund.latest_net_income(f, "entity", "year", "value", "klass", "scale", preferred="R",
                                  accounts=("R", "N"), tie_break=TIE)


def _div_by_year(spark, d):
    f = roles.filings(spark, d).where((F.col("scope") == "F") & (F.col("klass") == "A"))
    return fund.dividends_by_year(f, "entity", "year", "value")


@query("latest_eps")
def latest_eps(spark, d):
    return _eps(spark, d)


@query("latest_net_income")
def latest_net_income(spark, d):
    return _net_income(spark, d)


@query("dividends_by_year")
def dividends_by_year(spark, d):
    return _div_by_year(spark, d)


@query("latest_year_dividends")
def latest_year_dividends(spark, d):
    return fund.latest_year_dividends(_div_by_year(spark, d), "entity")


@query("payout_ratio")
def payout_ratio(spark, d):
    div = fund.latest_year_dividends(_div_by_year(spark, d), "entity")
    return fund.payout_ratio(_net_income(spark, d), div, "entity", dividend_scale=1.0)


@query("eps_with_fallback")
def eps_with_fallback(spark, d):
    s = roles.table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"), "s_acctbal")
    j = s.join(_eps(spark, d), "entity", "left")
    return j.select("entity", fund.eps_with_fallback(F.col("eps") / 1000.0, F.col("s_acctbal") / 100.0).alias("lpa"))


# --- config and assumptions: A4, A8, W3, V5, J6 ----------------------------------------------
def _config(spark, d):
    w = roles.config_writes(spark, d).where(F.col("k").isNotNull())
    return lt.latest_per_key(w, "k", ["written_at", "write_id"], columns=["v"])


@query("dedupe_last_wins")
def dedupe_last_wins(spark, d):
    return _config(spark, d).select("k", r6("v").alias("v"))


@query("config_wide")
def config_wide(spark, d):
    w = asm.config_wide(_config(spark, d))
    return w.select(*[r6(c).alias(c) for c in ("ke", "roet", "payoutt", "fade", "ipca", "ntnb", "premio")],
                    "ke_mode")


@query("assumption_history_topk")
def assumption_history_topk(spark, d):
    h = roles.history_log(spark, d)
    top = lt.top_k_per_key(h, "ticker", ["id"], 40)
    return top.select("ticker", "id", F.col("rank").cast("long").alias("rank"), "value")


def _current(spark, d):
    return lt.latest_per_key(roles.assumption_events(spark, d), "ticker", ["event_time", "id"])


def _effective(spark, d, keep_seed_rates=False):
    return asm.effective_assumptions(roles.stocks(spark, d), _current(spark, d), asm.config_wide(_config(spark, d)),
                                     watchlist=roles.watchlist(spark, d), keep_seed_rates=keep_seed_rates)


@query("monitored_flag")
def monitored_flag(spark, d):
    return asm.monitored_flag(roles.stocks(spark, d), roles.watchlist(spark, d)).select("ticker", "monitored")


EFFECTIVE_OUT = ("lpa", "roe_i", "payout_i", "ke", "roe_t", "payout_t", "fade")


@query("effective_assumptions")
def effective_assumptions(spark, d):
    e = _effective(spark, d)
    return e.select("ticker", "nome", "monitored", *[r6(c).alias(c) for c in EFFECTIVE_OUT], "growth_mode",
                    *[r6(c).alias(c) for c in ("g_i", "g_t", "fut_pe", "mos")])


# --- quotes: A9, P6, A10, T3, J8 ---------------------------------------------------------------
@query("latest_quote")
def latest_quote(spark, d):
    return qt.latest_quote(roles.quotes(spark, d), as_of=roles.quote_as_of(spark, d), range_str=roles.QUOTE_LOOKBACK)


@query("history_lookback")
def history_lookback(spark, d):
    return qt.history_lookback(roles.quotes(spark, d), "ts", roles.quote_as_of(spark, d), "1wk")


@query("history_lookback_by_day")
def history_lookback_by_day(spark, d):
    """The look-back over quotes stored by day: only the folders of its days are read."""
    path = _scratch(spark, f"quotes_by_day/{uuid.uuid4().hex}")
    qt.write_by_day(roles.quotes(spark, d), path)
    stored = spark.read.parquet(path)
    return qt.history_lookback(stored, "ts", qt.newest_time(stored), "1wk", day="day").drop("day")


@query("history_series")
def history_series(spark, d):
    return qt.history_series(roles.quotes(spark, d), as_of=roles.quote_as_of(spark, d), range_str="5y")


@query("quote_freshness")
def quote_freshness(spark, d):
    last = qt.drop_missing(roles.quotes(spark, d), "close").groupBy("ticker").agg(F.max("ts").alias("last_ts"))
    f = qt.quote_freshness(last, "last_ts", roles.quote_as_of(spark, d), qt.QUOTE_TTL_SECONDS, "stale_quote")
    f = qt.quote_freshness(f, "last_ts", roles.quote_as_of(spark, d), qt.HISTORY_TTL_SECONDS, "stale_history")
    return f.select("ticker", "last_ts", r6("age_s").alias("age_s"), "stale_quote", "stale_history")


def _price_sources(spark, d):
    snap = qt.latest_quote(roles.quotes(spark, d), as_of=roles.quote_as_of(spark, d), range_str=roles.QUOTE_LOOKBACK)
    chart = roles.second_quotes(spark, d).select("ticker", fv.round_half_up("price", 2).alias("price"))
    return [("snapshot", snap.select("ticker", "price")), ("chart", chart)]


@query("price_fallback")
def price_fallback(spark, d):
    keys = roles.stocks(spark, d).select("ticker")
    return qt.price_fallback(keys, _price_sources(spark, d)).select("ticker", r6("price").alias("price"),
                                                                    "price_source")


# --- screener and valuation views: V12, V9, V8, V10, V11 ---------------------------------------
def _screener_frame(spark, d):
    """Effective assumptions + ranked price sources + valuation + margin, unrounded."""
    e = _effective(spark, d, keep_seed_rates=True)
    p = qt.price_fallback(e, _price_sources(spark, d))
    g1 = F.when((F.col("growth_mode") == "g") & F.col("g_i").isNotNull(), F.col("g_i")).otherwise(F.col("g1"))
    v = val.ddm_value(p.withColumn("g1_used", g1), eps="lpa", payout="payout_i", g1="g1_used", ke="ke", gp="g_t")
    return v.withColumn("margin", val.margin_of_safety("fair", "price", "valid"))


@query("screener")
def screener(spark, d):
    v = _screener_frame(spark, d)
    return v.select("ticker", "nome", "monitored", *[r6(c).alias(c) for c in ("lpa", "payout_i", "ke", "g_t", "g1_used")],
                    "growth_mode", r6("price").alias("price"), "price_source", r6("fair").alias("fair"), "valid",
                    r6("margin").alias("margin"))


@query("margin_of_safety")
def margin_of_safety(spark, d):
    v = val.ddm_value(roles.stocks(spark, d), eps="lpa", payout="payout", g1="g1", ke="ke", gp="gp")
    q = roles.second_quotes(spark, d).select("ticker", fv.round_half_up("price", 2).alias("price"))
    v = v.join(q, "ticker", "left").withColumn("margin", val.margin_of_safety("fair", "price", "valid"))
    return v.select("ticker", r6("fair").alias("fair"), "valid", r6("price").alias("price"), r6("margin").alias("margin"),
                    val.margin_label("margin").alias("margin_label"), val.margin_text("margin", "price").alias("badge"))


@query("ddm_projection_ledger")
def ddm_projection_ledger(spark, d):
    led = val.ddm_ledger(roles.stocks(spark, d), "ticker", eps="lpa", payout="payout", g1="g1", ke="ke")
    return led.select("ticker", F.col("n").cast("long").alias("n"),
                      *[r6(c).alias(c) for c in ("dividend", "factor", "pv")])


@query("ddm_step_ledger")
def ddm_step_ledger(spark, d):
    v = val.ddm_value(roles.stocks(spark, d), eps="lpa", payout="payout", g1="g1", ke="ke", gp="gp")
    st = val.ddm_steps(v, "ticker")
    return st.select("ticker", "step", "label", r6("value").alias("value"), "text")


@query("ddm_scenario_grid")
def ddm_scenario_grid(spark, d):
    s = val.scenario_summary(roles.stocks(spark, d), "ticker", eps="lpa", payout="payout", g1="g1")
    return s.select("ticker", "n_points", "n_valid",
                    *[r6(c).alias(c) for c in ("share_valid", "min_fair", "median_fair", "max_fair")])


# --- names: F1-F3, J1-J3 -----------------------------------------------------------------------
from valorum.functions import text as tx  # noqa: E402
from valorum.operators import resolve as rs  # noqa: E402


@query("fold_accents")
def fold_accents(spark, d):
    return roles.table(spark, d, "documents").select("doc_id", tx.fold_accents("text").alias("folded"))


@query("normalize_name")
def normalize_name(spark, d):
    return roles.table(spark, d, "documents").select("doc_id", tx.normalize_name("text").alias("norm"))


@query("name_tokens")
def name_tokens(spark, d):
    return roles.table(spark, d, "documents").select("doc_id", F.array_sort(tx.name_tokens("text")).alias("tokens"))


def _names(spark, d):
    return roles.listed_names(spark, d), roles.registry_names(spark, d)


@query("name_exact_match")
def name_exact_match(spark, d):
    left, right = _names(spark, d)
    return rs.exact_match(left, "ticker_id", "empresa", right, "cd", "nome", "ultimo_ano")


@query("name_token_match")
def name_token_match(spark, d):
    left, right = _names(spark, d)
    m = rs.token_match(left, "ticker_id", "empresa", right, "cd", "nome", "ultimo_ano")
    return m.select("ticker_id", "match_id", r6("jaccard").alias("jaccard"))


@query("entity_resolution")
def entity_resolution(spark, d):
    left, right = _names(spark, d)
    m = rs.resolve_entities(left, "ticker_id", "empresa", right, "cd", "nome", "ultimo_ano")
    return m.select("ticker_id", "match_id", "how", r6("jaccard").alias("jaccard"))


# --- classification: C1-C5, F4, F5 -------------------------------------------------------------
from valorum.functions import classify as cl  # noqa: E402


@query("classify_governance")
def classify_governance(spark, d):
    return roles.indicators(spark, d).select("ticker", cl.classify_governance("listing").alias("gov"))


@query("classify_control")
def classify_control(spark, d):
    return roles.indicators(spark, d).select("ticker", cl.classify_control("controle").alias("ctrl"))


@query("classify_size")
def classify_size(spark, d):
    return roles.indicators(spark, d).select("ticker", cl.classify_size("valormercado").alias("tamanho"))


@query("derive_tags")
def derive_tags(spark, d):
    i = roles.indicators(spark, d)
    return i.select("ticker", cl.derive_tags("dy", "p_l", "p_vp", "roe", "dividaliquidaebit", "lpa",
                                             "valormercado").alias("tags"))


@query("derive_profile")
def derive_profile(spark, d):
    i = roles.indicators(spark, d)
    sector = cl.SqlText(tx.clean_label_sql("`sectorname`"))
    return i.select("ticker", cl.derive_profile(sector, "dy", "p_l", "p_vp", "receitas_cagr5", "roe").alias("perfil"))


@query("clean_label")
def clean_label(spark, d):
    i = roles.indicators(spark, d)
    return i.select("ticker", tx.clean_label("sectorname").alias("setor"), tx.clean_label("subsectorname").alias("subsetor"))


@query("clean_registry_sector")
def clean_registry_sector(spark, d):
    from valorum.sources import files as src
    r = src.registry_rows(roles.registry_extract(spark, d))
    return r.select("cd_cvm", "setor", "ctrl")


# --- universe: V3, V4, A7 ------------------------------------------------------------------------
from valorum.operators import universe as uv  # noqa: E402
from valorum.sources import buckets as bk  # noqa: E402


def _figures(filings, key, value, paid, exact_scale=2):
    """The demo's filing accounts: EPS and dividends of class R or A, income of account R or N."""
    return fund.newest_figures(_figure_years(filings, key, value, paid, exact_scale), key)


def _figure_years(filings, key, value, paid, exact_scale=2):
    k = F.col("klass")
    return fund.filing_years(
        filings.where(F.col("scope") == "F"), key, "year", TIE, eps_where=k.isin("R", "A"), eps_value=value, eps_class="klass",
        eps_preferred="R", income_where=k.isin("R", "N"), income_value=F.col("value"), income_account="klass", income_preferred="R",
        scale="scale", dividend_where=k == "A", dividend_value=paid, exact_scale=exact_scale)


def _universe(spark, d):
    figures = _figures(roles.part_filings(spark, d), "cd", F.col("value") / 1000.0, F.col("paid"), 4)
    reg = roles.company_registry(spark, d)
    facts = uv.company_facts(figures.withColumnRenamed("cd", "cd_cvm"),
                             reg.select("cd_cvm", cl.classify_control("controle").alias("ctrl"), "payload"))
    tickers = roles.listed_names(spark, d).withColumnRenamed("ticker_id", "ticker")
    companies = roles.registry_names(spark, d).select(F.col("cd").alias("cd_cvm"), F.col("nome").alias("empresa"),
                                                      "ultimo_ano")
    ind = roles.indicators(spark, d)
    return uv.build_universe(tickers, companies, facts, ind, roles.snapshot(spark, d))


def bucketed_facts(spark, d, buckets=8):
    """The company table from inputs stored in buckets by company code: (years, registry) tables and the facts."""
    run, codes = uuid.uuid4().hex, roles.company_registry(spark, d)
    years = _figure_years(roles.part_filings(spark, d).withColumnRenamed("cd", "cd_cvm"), "cd_cvm", F.col("value") / 1000.0, F.col("paid"), 4)
    years = bk.write_buckets(years, f"filing_years_{run}", _scratch(spark, f"filing_years/{run}"), "cd_cvm", buckets)
    reg = bk.write_buckets(codes.select("cd_cvm", cl.classify_control("controle").alias("ctrl"), "payload"),
                           f"company_registry_{run}", _scratch(spark, f"company_registry/{run}"), "cd_cvm", buckets)
    return uv.company_facts(fund.newest_figures(years, "cd_cvm"), reg)


@query("company_facts_bucketed")
def company_facts_bucketed(spark, d):
    """J4 over stored buckets: newest figures and company joins without an exchange."""
    return bucketed_facts(spark, d)


@query("universe_build")
def universe_build(spark, d):
    u = _universe(spark, d)
    return u.select(*[c for c in uv.UNIVERSE_COLUMNS if c != "nome"], "how")


@query("build_quality_report")
def build_quality_report(spark, d):
    u = _universe(spark, d).withColumn("ticker", F.col("ticker").cast("string"))
    return uv.write_universe(u, _scratch(spark, "universe_build"), spot_check=("0", "2", "4", "6", "8", "10", "12", "14"))[1]


@query("filing_figures")
def filing_figures(spark, d):
    """EPS, income and dividends with their years, in one pass."""
    return _figures(roles.filings(spark, d), "entity", F.col("value"), F.col("value"))


@query("payout_same_year")
def payout_same_year(spark, d):
    """Payout of the income's own year, dividends in units by the scale of each row."""
    f = roles.filings(spark, d).where((F.col("scope") == "F") & (F.col("klass") == "A"))
    by_year = fund.dividends_by_year(f, "entity", "year", "value", "scale")
    return fund.payout_ratio(_net_income(spark, d), by_year, "entity", dividend_scale=1.0, require_same_year=True)


# --- state: M1-M12, J7, J10 ----------------------------------------------------------------------
from valorum.operators import state as stt  # noqa: E402
from valorum.operators import quality as qa  # noqa: E402

STATE_FLOATS = ("lpa", "payout", "liquidez", "roe_i", "g1", "ke", "gp")


def _r6_floats(df, floats):
    return df.select(*[r6(c).alias(c) if c in floats else F.col(c) for c in df.columns])


@query("merge_seed")
def merge_seed(spark, d):
    m = stt.merge_seed(roles.state_stocks(spark, d), roles.seed_rows(spark, d), roles.removed(spark, d))
    return _r6_floats(m, STATE_FLOATS)


@query("seed_minus_removed")
def seed_minus_removed(spark, d):
    return stt.seed_minus_removed(roles.seed_rows(spark, d), roles.removed(spark, d)).select("ticker", "nome")


def _current_split(spark, d, cut="1998-01-01"):
    """A current table, and changes: all newer edits, and every fifth older one arriving late."""
    ev = roles.assumption_events(spark, d)
    late = F.col("id") % 5 == 0
    newer = F.col("event_time") >= F.lit(cut).cast("timestamp_ntz")
    return lt.latest_per_key(ev.where(~newer & ~late), "ticker", ["event_time", "id"]), ev.where(newer | late)


ASSUMPTION_FLOATS = ("lpa", "roe_i", "payout_i", "roe_t", "payout_t", "fade", "ke", "g_i", "g_t", "fut_pe", "mos")


@query("upsert_latest")
def upsert_latest(spark, d):
    cur, after = _current_split(spark, d)
    nxt = stt.upsert_latest(cur, after, "ticker", ["event_time", "id"])
    return _r6_floats(nxt, ASSUMPTION_FLOATS)


def _watch_adds(spark, d):
    """One key per line: the part, or (for small quantities) the supplier's stock."""
    li = roles.table(spark, d, "lineitem")
    return li.select(F.when(F.col("l_quantity") >= 25, F.col("l_partkey")).otherwise(-1 - F.col("l_suppkey"))
                     .alias("ticker"))


@query("insert_ignore")
def insert_ignore(spark, d):
    cur = roles.watchlist(spark, d).distinct()
    return stt.insert_ignore(cur, _watch_adds(spark, d).distinct(), "ticker")


@query("append_log")
def append_log(spark, d):
    from valorum.session import shared_path
    from valorum.sources import files as src
    ev = roles.assumption_events(spark, d)
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    base = shared_path(spark, "demo", "assumption_log")
    path = src.write_version(ev.where(F.col("event_time") < cut), base)
    ev.where(F.col("event_time") >= cut).write.mode("append").parquet(path)
    return _r6_floats(spark.read.parquet(path), ASSUMPTION_FLOATS)


def _patch_changes(spark, d):
    """Every line is a change; four kinds that send different columns, some to keys that do not exist."""
    li = roles.table(spark, d, "lineitem")
    kind = F.col("l_linenumber") % 4
    nome = F.when(F.col("l_tax") > 0.04, F.concat(F.lit("N"), F.col("l_linestatus"), F.col("l_suppkey").cast("string")))
    setor = F.concat(F.lit("S"), F.col("l_returnflag"), F.col("l_orderkey").cast("string"))
    fields = (F.when(kind == 0, F.create_map(F.lit("bogus"), F.lit("x")))
              .when(kind == 1, F.create_map(F.lit("setor"), setor)).when(kind == 2, F.create_map(F.lit("nome"), nome))
              .otherwise(F.create_map(F.lit("segmento"), F.col("l_returnflag"), F.lit("tags"),
                                      F.lit(None).cast("string"))))
    key = F.when(F.col("l_linenumber") == 7, F.col("l_partkey") + roles.NEW_KEY).otherwise(F.col("l_partkey"))
    return li.select(key.alias("ticker"), fields.alias("fields"), F.col("l_shipdate").alias("ts"),
                     F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"))


PATCH_ORDER = ("ts", "id", "line")


@query("patch_columns")
def patch_columns(spark, d):
    nxt, _ = stt.patch_columns(roles.state_stocks(spark, d), _patch_changes(spark, d), "ticker", order_by=PATCH_ORDER)
    return nxt.select("ticker", "nome", "setor", "segmento", "tags")


@query("patch_status")
def patch_status(spark, d):
    _, st = stt.patch_columns(roles.state_stocks(spark, d), _patch_changes(spark, d), "ticker", order_by=PATCH_ORDER)
    return st.drop("ts")


@query("cascade_delete")
def cascade_delete(spark, d):
    """The keys that are left in each table, with their rows."""
    keys = roles.removed(spark, d)
    tables = {"stocks": roles.state_stocks(spark, d), "watchlist": roles.watchlist(spark, d),
              "premissa_atual": _current(spark, d), "premissa_hist": roles.assumption_events(spark, d)}
    out = stt.cascade_delete(tables, keys, _watch_adds(spark, d).distinct())
    rows = None
    for name, df in out.items():
        part = df.select(F.lit(name).alias("table"), "ticker")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("table", "ticker").agg(F.count(F.lit(1)).alias("rows"))


@query("clear_tombstone")
def clear_tombstone(spark, d):
    p = roles.table(spark, d, "part")
    added = p.where((F.col("p_type") == "PROMO") & (F.col("p_size") == 3)).select(F.col("p_partkey").alias("ticker"))
    return stt.clear_tombstones(roles.removed(spark, d), added)


def _requests(spark, d):
    """Requests in order of id: every supplier's stock again, and three for each new key from the customers."""
    s = roles.table(spark, d, "supplier").select(
        (F.lit(-1) - F.col("s_suppkey")).alias("ticker"),
        F.when(F.col("s_acctbal") >= 0, F.col("s_name")).alias("nome"),
        (F.col("s_acctbal") / 1000.0).alias("lpa"), (F.lit(-1) - F.col("s_suppkey")).alias("id"))
    c = roles.table(spark, d, "customer").select(
        (F.floor(F.col("c_custkey") / 3) + roles.NEW_KEY).alias("ticker"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("nome"), F.lit(None).cast("double").alias("lpa"),
        F.col("c_custkey").alias("id"))
    return s.unionByName(c)


ADD_DEFAULTS = {"setor": "", "subsetor": "", "segmento": "", "perfil": "", "tamanho": "", "gov": "", "ctrl": "",
                "modelo": roles.MODEL_DEFAULT, "tags": "[]", "monitored": 0, "roe_i": 0.15, "user": 1}


def _tombstones(spark, d):
    """Removed parts, and a key for every customer (the third of them that is added again loses it)."""
    c = roles.table(spark, d, "customer").select((F.col("c_custkey") + roles.NEW_KEY).alias("ticker"))
    return roles.removed(spark, d).unionByName(c)


@query("insert_status")
def insert_status(spark, d):
    return stt.insert_status(roles.state_stocks(spark, d), _requests(spark, d), order_by=["id"]).select(
        "ticker", "id", "status", "error")


@query("add_entities")
def add_entities(spark, d):
    nxt, _, _ = stt.add_entities(roles.state_stocks(spark, d), _requests(spark, d), ADD_DEFAULTS, order_by=["id"])
    return _r6_floats(nxt, STATE_FLOATS)


@query("add_entities_tombstones")
def add_entities_tombstones(spark, d):
    _, _, left = stt.add_entities(roles.state_stocks(spark, d), _requests(spark, d), ADD_DEFAULTS, order_by=["id"],
                                  tombstones=_tombstones(spark, d))
    return left


ASSUMPTION_SCHEMA_DDL = ("ticker BIGINT, event_time TIMESTAMP_NTZ, id BIGINT, lpa DOUBLE, roe_i DOUBLE, "
                         "payout_i DOUBLE, roe_t DOUBLE, payout_t DOUBLE, fade DOUBLE, ke DOUBLE, growth_mode STRING, "
                         "g_i DOUBLE, g_t DOUBLE, fut_pe DOUBLE, mos DOUBLE, ke_default INT, roet_default INT, "
                         "payoutt_default INT, fade_default INT")


@query("evolve_schema")
def evolve_schema(spark, d):
    from pyspark.sql.types import _parse_datatype_string
    old = roles.assumption_events(spark, d).select("ticker", "event_time", "id", "lpa", "ke", "ke_default")
    schema = _parse_datatype_string(ASSUMPTION_SCHEMA_DDL)
    out = stt.evolve_schema(old, schema, {"ke_default": 1, "roet_default": 1, "payoutt_default": 1,
                                          "fade_default": 1, "growth_mode": "roe"})
    return _r6_floats(out, ASSUMPTION_FLOATS)


@query("config_unpivot")
def config_unpivot(spark, d):
    o = roles.table(spark, d, "orders")
    v = F.col("o_totalprice") / 2e6
    wide = o.select(
        F.col("o_orderdate").alias("written_at"), F.col("o_orderkey").alias("write_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", v).alias("ke"),
        F.when(F.col("o_orderpriority") == "2-HIGH", v).alias("roet"),
        F.when(F.col("o_orderstatus") == "P", v * 10).alias("ipca"),
        F.when(F.col("o_orderpriority") == "5-LOW",
               F.when(F.col("o_orderstatus") == "F", F.lit("real")).otherwise(F.lit("nom"))).alias("ke_mode"))
    rows = asm.config_long(wide, carry=("written_at", "write_id"))
    nxt = stt.upsert_latest(_config(spark, d), rows, "k", ["written_at", "write_id"])
    return nxt.select("k", r6("v").alias("v"))


# --- validation, portfolio, health: P8, J11, A5, A6, L1, P1, P7 ------------------------------------
@query("validate_positions")
def validate_positions(spark, d):
    acc, rej = qa.validate(roles.more_positions(spark, d), qa.position_rules(), unique="ticker", order_by=["batch"])
    out = acc.withColumn("errors", F.array().cast("array<string>")).unionByName(rej)
    return out.select("ticker", "batch", r6("quantidade").alias("quantidade"), r6("preco_medio").alias("preco_medio"),
                      (F.size("errors") == 0).alias("valid"), F.array_join("errors", ",").alias("errors"))


@query("portfolio_valuation")
def portfolio_valuation(spark, d):
    acc, _ = qa.validate(roles.positions(spark, d), qa.position_rules())
    pv = qa.portfolio_value(acc, _screener_frame(spark, d))
    return _r6_floats(pv, ("quantidade", "preco_medio", "price", "fair", "value", "cost", "gain", "gain_pct",
                           "upside_pct"))


@query("table_health")
def table_health(spark, d):
    return qa.table_health({"stocks": roles.stocks(spark, d), "premissa_hist": roles.assumption_events(spark, d),
                            "watchlist": roles.watchlist(spark, d), "quotes": roles.quotes(spark, d)})


@query("distinct_keys")
def distinct_keys(spark, d):
    return lt.distinct_keys(roles.assumption_events(spark, d), "ticker").orderBy("ticker")


@query("watchlist_sorted")
def watchlist_sorted(spark, d):
    return roles.watchlist(spark, d).distinct().orderBy("ticker")


@query("screener_shape")
def screener_shape(spark, d):
    e = _effective(spark, d, keep_seed_rates=True)
    p = qt.price_fallback(e, _price_sources(spark, d))
    shaped = qa.screener_shape(p.drop("seed_ke", "setor", "segmento"))
    return _r6_floats(shaped, ("lpa", "roe_i", "payout_i", "ke", "roe_t", "payout_t", "fade", "g_i", "g_t", "fut_pe",
                               "mos", "price"))


@query("lookup_by_keys")
def lookup_by_keys(spark, d):
    cur = _current(spark, d)
    hit = qa.lookup_by_keys(cur, roles.watchlist(spark, d))
    return _r6_floats(hit.select("ticker", "event_time", "ke", "roe_t", "ke_default"), ("ke", "roe_t"))


# --- scalar function demos: F6, F11, F13, F15, F17, S6, P2, P3 --------------------------------------
from valorum.sources import files as src  # noqa: E402


@query("ticker_symbol")
def ticker_symbol(spark, d):
    p = roles.table(spark, d, "part")
    code = F.concat(F.lower(F.substring("p_type", 1, 4)), F.col("p_size").cast("string"))
    sym = tx.add_suffix(code)
    return p.select("p_partkey", sym.alias("symbol"), tx.strip_suffix(sym).alias("ticker"))


@query("numeric_guard")
def numeric_guard(spark, d):
    e = roles.table(spark, d, "events")
    return e.select("event_id", fv.numeric_guard(F.get_json_object("props", "$.k")).alias("k_num"),
                    fv.numeric_guard("event_type").alias("junk"))


@query("json_double_decode")
def json_double_decode(spark, d):
    e = roles.table(spark, d, "events")
    raw = F.when(F.col("event_type").isin("view", "click"), F.col("props")).otherwise(
        F.concat(F.lit('"'), F.replace(F.col("props"), F.lit('"'), F.lit('\\"')), F.lit('"')))
    return e.select("event_id", src.double_decode(raw, "k").alias("k"))


@query("falsy_coalesce")
def falsy_coalesce(spark, d):
    i = roles.indicators(spark, d)
    return i.select("ticker", r6(fv.falsy_coalesce(F.floor("dy").cast("double"), "p_vp")).alias("num"),
                    fv.falsy_coalesce("listing", "controle", kind="text").alias("txt"))


@query("tags_json")
def tags_json(spark, d):
    i = roles.indicators(spark, d)
    txt = fv.tags_to_json(cl.derive_tags("dy", "p_l", "p_vp", "roe", "dividaliquidaebit", "lpa", "valormercado"))
    return i.select("ticker", txt.alias("tags_text"), F.size(fv.tags_from_json(txt)).cast("long").alias("n_tags"))


@query("format_ptbr")
def format_ptbr(spark, d):
    v = val.ddm_value(roles.stocks(spark, d), eps="lpa", payout="payout", g1="g1", ke="ke", gp="gp")
    return v.select("ticker", fv.format_brl("fair").alias("fair_text"),
                    F.concat(fv.format_ptbr(F.col("payout") * 100.0, 0), F.lit("%")).alias("payout_pct"),
                    fv.format_ptbr(F.col("ke") * 100.0, 1).alias("ke_dec"))


@query("filing_filter")
def filing_filter(spark, d):
    p = roles.table(spark, d, "part")
    f = fund.filing_filter(p, equals={"p_type": "PROMO"}, isin={"p_size": list(range(1, 11))},
                           prefix={"p_brand": "Brand#1"})
    return f.select("p_partkey", "p_brand", "p_size")


ACCENT_PATTERNS = ("éeau", "ÇOUE")


@query("accent_insensitive_filter")
def accent_insensitive_filter(spark, d):
    docs = roles.table(spark, d, "documents")
    return docs.where(fund.contains_any_folded("text", ACCENT_PATTERNS)).select("doc_id")


# --- sources and sinks: S1, S2, S4, S5, S7, S8, K1 ---------------------------------------------------
from valorum.session import shared_path  # noqa: E402


def _scratch(spark, name):
    return shared_path(spark, "demo", name)


@query("src_csv_roundtrip")
def src_csv_roundtrip(spark, d):
    p = roles.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("ticker"),
                                             F.col("p_name").alias("empresa"))
    path = src.write_version(p, _scratch(spark, "tickers_csv"), fmt="csv", header=True, quote='"', escape='"')
    return src.read_ticker_list(spark, path)


@query("src_registry_csv")
def src_registry_csv(spark, d):
    path = src.write_version(roles.registry_extract(spark, d), _scratch(spark, "registry_csv"), fmt="csv",
                             header=True, sep=";", encoding=src.REGISTRY_ENCODING)
    return src.registry_rows(src.read_registry(spark, path))


def _batches(df, key, size=60):
    """Documents of at most ``size`` records each, like the provider's batched replies."""
    return df.groupBy(F.floor(F.col(key) / size).alias("_batch"))


@query("src_quote_snapshot")
def src_quote_snapshot(spark, d):
    c = roles.table(spark, d, "customer")
    recs = c.select(F.col("c_custkey"), F.struct(F.col("c_custkey").cast("string").alias("stock"),
                                                 (F.col("c_acctbal") / 100.0).alias("close"),
                                                 (F.col("c_acctbal") * 2e6).alias("market_cap")).alias("r"))
    docs = _batches(recs, "c_custkey").agg(F.collect_list("r").alias("stocks")).select("stocks")
    path = src.write_version(docs, _scratch(spark, "snapshot_json"), fmt="json")
    snap = src.read_quote_snapshot(spark, path)
    return snap.select("stock", r6("close").alias("close"), r6("market_cap").alias("market_cap"))


@query("src_indicator_json")
def src_indicator_json(spark, d):
    i = roles.indicators(spark, d)
    fields = ["sectorname", "subsectorname", "segmentname", *src.INDICATOR_FIELDS]
    recs = i.select("ticker", F.struct(F.col("ticker").cast("string").alias("ticker"),
                                       *[F.col(c) for c in fields]).alias("r"))
    docs = _batches(recs, "ticker").agg(F.collect_list("r").alias("list")).select("list")
    path = src.write_version(docs, _scratch(spark, "indicators_json"), fmt="json")
    rows = src.read_indicator_list(spark, path)
    return rows.select("ticker", "sectorname", r6("dy").alias("dy"), r6("p_l").alias("p_l"),
                       r6("valormercado").alias("valormercado"))


@query("chart_arrays_to_rows")
def chart_arrays_to_rows(spark, d):
    e = roles.table(spark, d, "events")
    pts = e.select(F.col("user_id").cast("string").alias("ticker"),
                   F.floor(F.col("event_id") / 60).alias("chunk"),  # at most 60 points per payload
                   F.struct(F.floor(fv.epoch_micros("ts", ntz=True) / 1000000).cast("long").alias("t"),
                            F.when(F.col("event_type") != "error", F.col("value")).alias("c")).alias("p"))
    docs = pts.groupBy("ticker", "chunk").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    payload = docs.select("ticker", F.struct(F.transform("ps", lambda p: p["t"]).alias("timestamp"),
                                              F.transform("ps", lambda p: p["c"]).alias("close")).alias("result"))
    return qt.chart_rows(payload, "ticker", "result")


WIDE_TYPES = ("view", "click", "purchase", "signup", "error")


@query("wide_quotes_unpivot")
def wide_quotes_unpivot(spark, d):
    e = roles.table(spark, d, "events").select(
        F.to_date("ts").alias("day"), "ts", "event_type",
        F.when(F.col("event_type") != "error", F.col("value")).alias("close"))
    wide = e.groupBy("day").pivot("event_type", list(WIDE_TYPES)).agg(F.max_by("close", "ts"))
    long = qt.unpivot_quotes(wide, ts="day")
    return qt.latest_quote(long, key="ticker", ts="day", close="close").select("ticker", "price")


@query("universe_write_read")
def universe_write_read(spark, d):
    seed = roles.seed_rows(spark, d).withColumn("tags", F.array(F.col("setor"), F.col("segmento")))
    path = src.write_version(seed, _scratch(spark, "universe"))
    back = spark.read.parquet(path)
    return _r6_floats(back.select("ticker", "nome", "tags", "lpa", "payout", "monitored"), ("lpa", "payout"))


# --- streams: T1, T2, T3 ------------------------------------------------------------------------------
from valorum.streaming import streams as sm  # noqa: E402


def _stream_source(spark, d, name, base, time=None):
    """A stream over the whole table in eight files, two for each micro-batch; by ``time`` in four steps if given."""
    t = roles.table(spark, d, name)
    steps = [t.repartition(8, *t.columns)]  # by hash: dealing in turn would sort each task's rows first
    if time:
        micros = F.unix_micros(F.col(time).cast("timestamp"))
        lo, hi = t.agg(F.min(micros), F.max(micros)).first()
        place = F.coalesce(F.floor((micros - lo) * 4 / (hi - lo + 1)), F.lit(0)) if lo is not None else F.lit(0)
        steps = [t.where(place == i).repartition(2) for i in range(4)]
    for step in steps:
        step.write.mode("append").parquet(base + "/source")
    return spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 2).parquet(base + "/source")


# The demo states are small.
STREAM_BUCKETS = 8


@query("stream_latest_quote")
def stream_latest_quote(spark, d):
    base = _scratch(spark, f"stream_quote/{uuid.uuid4().hex}")
    ev = _stream_source(spark, d, "events", base, "ts")
    quotes = ev.select(F.col("user_id").alias("ticker"), "ts",
                       F.when(F.col("event_type") != "error", F.col("value")).alias("close"))
    q = sm.stream_latest_quote(quotes, base + "/state", base + "/checkpoint", buckets=STREAM_BUCKETS)
    q.awaitTermination()
    st = sm.read_state(spark, base + "/state")
    return st.select("ticker", fv.round_half_up("price", 2).alias("price"), "last_ts")


@query("stream_assumption_state")
def stream_assumption_state(spark, d):
    base = _scratch(spark, f"stream_assumptions/{uuid.uuid4().hex}")
    li = _stream_source(spark, d, "lineitem", base)
    events = roles.assumption_events_from(li)
    q = sm.stream_assumptions(events, base + "/state", base + "/log", base + "/checkpoint", buckets=STREAM_BUCKETS)
    q.awaitTermination()
    return _r6_floats(sm.read_state(spark, base + "/state"), ASSUMPTION_FLOATS)


# --- SQL surface, config defaults, single-key history: 2.13, M8, L2 ------------------------------------
@query("ddm_sql_function")
def ddm_sql_function(spark, d):
    fn = val.register_sql_functions(spark)
    view = f"stocks_{uuid.uuid4().hex[:8]}"
    roles.stocks(spark, d).createOrReplaceTempView(view)
    return spark.sql(f"SELECT ticker, round({fn}(lpa, payout, g1, ke, gp) * 1e6D) / 1e6D AS fair FROM {view}")


@query("ddm_ledger_function")
def ddm_ledger_function(spark, d):
    """The ledger rows by a SQL table function joined laterally to the stocks."""
    fn = val.register_ledger_function(spark)
    view = f"stocks_{uuid.uuid4().hex[:8]}"
    roles.stocks(spark, d).createOrReplaceTempView(view)
    out = spark.sql(f"SELECT s.ticker, l.* FROM {view} s, LATERAL {fn}(s.lpa, s.payout, s.g1, s.ke) l")
    return out.select("ticker", F.col("n").cast("long").alias("n"), *[r6(c).alias(c) for c in ("dividend", "factor", "pv", "pv_sum")])


@query("ddm_what_if_summary")
def ddm_what_if_summary(spark, d):
    """All four sliders at once, per stock."""
    s = val.what_if_summary(roles.stocks(spark, d), "ticker", eps="lpa")
    return s.select("ticker", "n_points", "n_valid", *[r6(c).alias(c) for c in ("share_valid", "min_fair", "median_fair", "max_fair")])


@query("config_defaults")
def config_defaults(spark, d):
    defaults = spark.createDataFrame([(dbk, float(v)) for _, dbk, v in asm.CONFIG_KEYS[:4]], "k string, v double")
    cur = _config(spark, d).where(F.col("v").isNotNull())
    return stt.insert_ignore(cur, defaults, "k").select("k", r6("v").alias("v"))


@query("assumption_history_one")
def assumption_history_one(spark, d):
    return lt.history_for_key(roles.history_log(spark, d), "ticker", 7, "id", 40).select("ticker", "id", "value")


@query("history_series_daily")
def history_series_daily(spark, d):
    return qt.history_series(roles.quotes(spark, d), as_of=roles.quote_as_of(spark, d), range_str="1mo", as_array=True)


@query("format_number_ties")
def format_number_ties(spark, d):
    """Eighths have exact ties at 0, 1 and 2 places."""
    x = (F.col("o_orderkey") % 100_000 - 50_000) / 8.0
    o = roles.table(spark, d, "orders")
    return o.select("o_orderkey", fv.format_ptbr(x, 0).alias("p0"), fv.format_ptbr(x, 1).alias("p1"),
                    fv.format_ptbr(x, 2).alias("p2"), fv.format_pct(x, 0).alias("pct0"), fv.format_pct(x, 1).alias("pct1"))


@query("src_meta_json")
def src_meta_json(spark, d):
    """Curated metadata: an array of records with a tag array, written from the parts and read back."""
    from valorum.sources import files as src
    p = roles.table(spark, d, "part")
    rec = F.struct(F.col("p_partkey").cast("string").alias("ticker"), F.col("p_name").alias("nome"),
                   F.col("p_type").alias("setor"), F.array("p_brand", "p_type").alias("tags"),
                   (F.col("p_size") > 25).alias("monitored"), (F.col("p_size") / 100.0).alias("g1"),
                   F.col("p_retailprice").alias("lpa"))
    docs = _batches(p, "p_partkey").agg(F.collect_list(rec).alias("all"))
    path = src.write_version(docs.select(F.to_json("all").alias("value")), _scratch(spark, "meta"), fmt="text")
    m = src.read_meta(spark, path, multi_line=False)
    return m.select("ticker", "nome", "setor", F.array_join("tags", "|").alias("tags"), "monitored", r6("g1").alias("g1"),
                    r6("lpa").alias("lpa"), F.col("gov").isNull().alias("no_gov"))


@query("message_cut")
def message_cut(spark, d):
    """Error texts cut to 120 and 80 characters."""
    t = roles.table(spark, d, "documents")
    return t.select("doc_id", tx.cut("text", 120).alias("m120"), tx.cut("text", 80).alias("m80"))
