"""DuckDB oracle SQL for every demo plan, over the same parquet tables.

Each role of :mod:`valorum.plans.roles` has a SQL twin here (``ROLE_*``), and each
demo key has one SQL text in :data:`ORACLE_SQL`. Float outputs are rounded to six
places on both sides.
"""

from __future__ import annotations

ROLE_STOCKS = """
stocks AS (
  SELECT p_partkey AS ticker, p_name AS nome, p_type AS setor, p_brand AS segmento,
         p_retailprice / 100.0 AS lpa,
         CAST(p_size AS DOUBLE) / 50.0 AS payout,
         CASE WHEN p_size <= 40 THEN CAST(p_size AS DOUBLE) / 200.0 END AS roe_i,
         CAST(p_size AS DOUBLE) / 500.0 AS g1,
         0.06 + CAST(p_size AS DOUBLE) / 250.0 AS ke,
         CAST(p_partkey % 11 AS DOUBLE) / 100.0 AS gp,
         p_size > 25 AS monitored
  FROM part)"""

ROLE_EVENTS = """
events_log AS (
  SELECT l_orderkey * 8 + l_linenumber AS id, l_partkey AS ticker, l_shipdate AS event_time,
         CASE WHEN l_quantity > 45 THEN l_extendedprice / l_quantity / 100.0 END AS lpa,
         CASE WHEN l_linestatus = 'F' THEN 0.05 + l_tax * 2.0 END AS roe_i,
         CASE WHEN l_returnflag = 'R' THEN l_discount * 5.0 END AS payout_i,
         0.05 + l_tax AS roe_t,
         0.3 + l_discount * 3.0 AS payout_t,
         CAST(l_linenumber * 2 AS DOUBLE) AS fade,
         0.10 + l_discount AS ke,
         CASE WHEN l_quantity > 40 THEN 'g' WHEN l_quantity < 5 THEN '' WHEN l_quantity < 10 THEN NULL
              ELSE 'roe' END AS growth_mode,
         l_tax * 2.0 AS g_i,
         0.02 + l_discount / 2.0 AS g_t,
         l_quantity / 2.0 AS fut_pe,
         l_discount * 2.0 AS mos,
         CASE WHEN l_returnflag = 'N' THEN 1 WHEN l_returnflag = 'A' THEN 0 END AS ke_default,
         CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS roet_default,
         CASE WHEN l_quantity >= 25 THEN 0 ELSE 1 END AS payoutt_default,
         CASE WHEN l_linenumber > 4 THEN 0 ELSE 1 END AS fade_default
  FROM lineitem)"""

ROLE_CONFIG = """
config_writes AS (
  SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'ke_global' WHEN '2-HIGH' THEN 'roet_global'
              WHEN '3-MEDIUM' THEN 'payoutt_global' WHEN '4-NOT SPECIFIED' THEN 'fade_global'
              WHEN '5-LOW' THEN 'ke_mode_global' END AS k,
         CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 2e6 END AS v,
         o_orderdate AS written_at, o_orderkey AS write_id
  FROM orders),
config AS (
  SELECT k, v FROM (
    SELECT *, row_number() OVER (PARTITION BY k ORDER BY written_at DESC, write_id DESC) AS rn
    FROM config_writes WHERE k IS NOT NULL) WHERE rn = 1)"""

ROLE_WATCHLIST = """
watchlist AS (SELECT l_partkey AS ticker FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.1)"""

ROLE_REMOVED = """
removed AS (SELECT p_partkey AS ticker FROM part WHERE p_type = 'PROMO' AND p_size <= 5)"""

ROLE_QUOTES = """
quotes AS (SELECT user_id AS ticker, ts, CASE WHEN event_type <> 'error' THEN value END AS close FROM events)"""

ROLE_SECOND_QUOTES = """
second_quotes AS (SELECT l_partkey AS ticker, CAST(sum(CAST(l_extendedprice AS DECIMAL(28,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(28,2))) AS DOUBLE) AS price
                  FROM lineitem GROUP BY l_partkey)"""


def with_roles(*roles: str) -> str:
    return "WITH " + ",".join(roles)


def pyround_sql(x: str, places: int) -> str:
    """Python's round(x, places) in DuckDB: Dekker two-product error decides the apparent ties."""
    m = float(10 ** places)
    c = 134217729.0 * m
    hm = c - (c - m)
    lm = m - hm
    p = f"(({x}) * {m!r})"
    hx = f"((({x}) * 134217729.0) - ((({x}) * 134217729.0) - ({x})))"
    lx = f"(({x}) - {hx})"
    err = f"((({hx} * {hm!r} - {p}) + {hx} * {lm!r} + {lx} * {hm!r}) + {lx} * {lm!r})"
    tie = f"({p} - floor({p}) = 0.5)"
    return (f"(CASE WHEN {tie} AND {err} > 0 THEN floor({p}) + 1 WHEN {tie} AND {err} < 0 THEN floor({p}) "
            f"ELSE round_even({p}, 0) END / {m!r})")



def ddm_sql(eps: str, payout: str, g1: str, ke: str, gp: str, years: int = 5) -> dict[str, str]:
    """SQL text of the year-by-year two-stage valuation."""
    d0 = f"({eps}) * ({payout})"
    d = d0
    pv_sum = None
    for n in range(1, years + 1):
        d = f"({d}) * (1.0 + {g1})"
        pv = f"({d}) / pow(1.0 + {ke}, {float(n)})"
        pv_sum = pv if pv_sum is None else f"{pv_sum} + {pv}"
    d_next = f"({d}) * (1.0 + {gp})"
    valid = f"({ke} > {gp})"
    terminal = f"CASE WHEN {valid} THEN ({d_next}) / ({ke} - {gp}) END"
    terminal_pv = f"CASE WHEN {valid} THEN ({d_next}) / ({ke} - {gp}) / pow(1.0 + {ke}, {float(years)}) END"
    fair = f"CASE WHEN {valid} THEN ({pv_sum}) + ({d_next}) / ({ke} - {gp}) / pow(1.0 + {ke}, {float(years)}) ELSE ({pv_sum}) END"
    return {"d0": d0, "pv_sum": pv_sum, "d_next": d_next, "terminal": terminal,
            "terminal_pv": terminal_pv, "fair": fair, "valid": valid}


def _ddm_fair_value() -> str:
    s = ddm_sql("lpa", "payout", "g1", "ke", "gp")
    return with_roles(ROLE_STOCKS) + f"""
SELECT ticker,
       round({s['d0']}, 6) AS d0,
       round({s['pv_sum']}, 6) AS pv_sum,
       round({s['d_next']}, 6) AS d_next,
       round({s['terminal']}, 6) AS terminal,
       round({s['terminal_pv']}, 6) AS terminal_pv,
       round({s['fair']}, 6) AS fair,
       {s['valid']} AS valid
FROM stocks"""


ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str) -> None:
    ORACLE_SQL[name] = sql


register("ddm_fair_value", _ddm_fair_value())

ROLE_FILINGS = """
filings AS (
  SELECT l_suppkey AS entity, CAST(year(l_shipdate) AS INTEGER) AS year, l_linestatus AS scope, l_returnflag AS klass,
         l_extendedprice AS value, CASE WHEN l_quantity > 25 THEN 'MIL' ELSE 'UN' END AS scale,
         l_orderkey, l_linenumber, l_partkey
  FROM lineitem)"""

SQL_LATEST_EPS = """
eps AS (
  SELECT entity, value AS eps, year, klass AS share_class FROM (
    SELECT *, row_number() OVER (PARTITION BY entity ORDER BY year DESC, (klass = 'R') DESC, abs(value) DESC,
                                 l_orderkey, l_linenumber) AS rn
    FROM filings WHERE scope = 'F' AND value <> 0 AND klass IN ('R', 'A')) WHERE rn = 1)"""

SQL_NET_INCOME = """
ni AS (
  SELECT entity, value AS net_income, scale, year,
         CASE WHEN scale = 'MIL' THEN value * 1000.0 ELSE value END AS net_income_units FROM (
    SELECT *, row_number() OVER (PARTITION BY entity ORDER BY year DESC, (klass = 'R') DESC,
                                 l_orderkey, l_linenumber) AS rn
    FROM filings WHERE scope = 'F' AND klass IN ('R', 'N')) WHERE rn = 1)"""

SQL_DIV_BY_YEAR = """
div_year AS (
  SELECT entity, year, CAST(sum(CAST(abs(value) AS DECIMAL(28,2))) AS DOUBLE) AS dividends
  FROM filings WHERE scope = 'F' AND klass = 'A' GROUP BY entity, year)"""

SQL_DIV_LATEST = """
div_latest AS (SELECT entity, arg_max(dividends, year) AS dividends FROM div_year
               WHERE dividends IS NOT NULL GROUP BY entity)"""

register("latest_eps", with_roles(ROLE_FILINGS, SQL_LATEST_EPS) + " SELECT * FROM eps")
register("latest_net_income", with_roles(ROLE_FILINGS, SQL_NET_INCOME) + " SELECT * FROM ni")
register("dividends_by_year", with_roles(ROLE_FILINGS, SQL_DIV_BY_YEAR) + " SELECT * FROM div_year")
register("latest_year_dividends", with_roles(ROLE_FILINGS, SQL_DIV_BY_YEAR, SQL_DIV_LATEST)
         + " SELECT * FROM div_latest")
register("payout_ratio", with_roles(ROLE_FILINGS, SQL_NET_INCOME, SQL_DIV_BY_YEAR, SQL_DIV_LATEST) + """
SELECT coalesce(ni.entity, d.entity) AS entity, d.dividends, ni.net_income_units,
       CASE WHEN d.dividends <> 0 AND ni.net_income_units > 0
            THEN """ + pyround_sql("least(1.5, greatest(0.0, d.dividends * 1.0 / ni.net_income_units))", 3) + """ END AS payout_raw,
       coalesce(CASE WHEN d.dividends <> 0 AND ni.net_income_units > 0
            THEN """ + pyround_sql("least(1.5, greatest(0.0, d.dividends * 1.0 / ni.net_income_units))", 3) + """ END, 0.45) AS payout
FROM ni FULL OUTER JOIN div_latest d ON ni.entity = d.entity""")
register("filing_figures", with_roles(ROLE_FILINGS, SQL_LATEST_EPS, SQL_NET_INCOME, SQL_DIV_BY_YEAR) + """
, d AS (SELECT entity, arg_max(dividends, year) AS dividends, max(year) AS dividends_year FROM div_year
        WHERE dividends IS NOT NULL GROUP BY entity)
, e AS (SELECT DISTINCT entity FROM filings WHERE scope = 'F')
SELECT e.entity, eps.eps, eps.year AS eps_year, ni.net_income, ni.scale, ni.year AS income_year, ni.net_income_units,
       d.dividends, d.dividends_year
FROM e LEFT JOIN eps USING (entity) LEFT JOIN ni USING (entity) LEFT JOIN d USING (entity)""")
_SAME_YEAR = pyround_sql("least(1.5, greatest(0.0, d.dividends * 1.0 / k.net_income_units))", 3)
register("payout_same_year", with_roles(ROLE_FILINGS, SQL_NET_INCOME) + f"""
, d AS (SELECT entity, year, CAST(sum(CAST(abs(CASE WHEN scale = 'MIL' THEN value * 1000.0 ELSE value END) AS DECIMAL(28,2))) AS DOUBLE) AS dividends
        FROM filings WHERE scope = 'F' AND klass = 'A' GROUP BY entity, year)
, k AS (SELECT entity, year, net_income_units FROM ni
        UNION ALL SELECT DISTINCT entity, NULL, NULL FROM d WHERE entity NOT IN (SELECT entity FROM ni))
SELECT k.entity, d.dividends, k.net_income_units,
       CASE WHEN d.dividends <> 0 AND k.net_income_units > 0 THEN {_SAME_YEAR} END AS payout_raw,
       coalesce(CASE WHEN d.dividends <> 0 AND k.net_income_units > 0 THEN {_SAME_YEAR} END, 0.45) AS payout
FROM k LEFT JOIN d ON d.entity = k.entity AND d.year = k.year""")
register("eps_with_fallback", with_roles(ROLE_FILINGS, SQL_LATEST_EPS) + """
SELECT s.s_suppkey AS entity,
       """ + pyround_sql("coalesce(CASE WHEN abs(e.eps / 1000.0) <= 100 AND e.eps <> 0 THEN e.eps / 1000.0 END, "
                         + pyround_sql("CASE WHEN abs(s.s_acctbal / 100.0) <= 100 AND s.s_acctbal <> 0 "
                                       "THEN s.s_acctbal / 100.0 END", 2) + ")", 2) + """ AS lpa
FROM supplier s LEFT JOIN eps e ON e.entity = s.s_suppkey""")

register("dedupe_last_wins", with_roles(ROLE_CONFIG) + " SELECT k, round(v, 6) AS v FROM config")
register("config_wide", with_roles(ROLE_CONFIG) + """
SELECT round(coalesce(max(v) FILTER (WHERE k = 'ke_global'), 0.14), 6) AS ke,
       round(coalesce(max(v) FILTER (WHERE k = 'roet_global'), 0.12), 6) AS roet,
       round(coalesce(max(v) FILTER (WHERE k = 'payoutt_global'), 0.60), 6) AS payoutt,
       round(coalesce(max(v) FILTER (WHERE k = 'fade_global'), 10.0), 6) AS fade,
       round(coalesce(max(v) FILTER (WHERE k = 'ipca_global'), 0.045), 6) AS ipca,
       round(coalesce(max(v) FILTER (WHERE k = 'ntnb_global'), 0.072), 6) AS ntnb,
       round(coalesce(max(v) FILTER (WHERE k = 'premio_global'), 0.0), 6) AS premio,
       CASE WHEN coalesce(max(v) FILTER (WHERE k = 'ke_mode_global'), 0.0) <> 0 THEN 'real' ELSE 'nom' END
         AS ke_mode
FROM config""")
register("assumption_history_topk", """
SELECT ticker, id, rank, value FROM (
  SELECT user_id AS ticker, event_id AS id, value,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rank
  FROM events) WHERE rank <= 40""")

QUOTE_WINDOW = "ts >= (SELECT max(ts) FROM events) - INTERVAL 5 DAY AND ts <= (SELECT max(ts) FROM events)"
SQL_LATEST_QUOTE = f"""
last_quote AS (
  SELECT ticker, floor(close * 100.0 + 0.5) / 100.0 AS price, last_ts FROM (
    SELECT ticker, close, max(ts) OVER (PARTITION BY ticker) AS last_ts,
           row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, close DESC) AS rn
    FROM quotes WHERE {QUOTE_WINDOW} AND close IS NOT NULL AND NOT isnan(close)) WHERE rn = 1)"""
register("latest_quote", with_roles(ROLE_QUOTES, SQL_LATEST_QUOTE) + " SELECT * FROM last_quote")
register("history_lookback", with_roles(ROLE_QUOTES) + """
SELECT ticker, ts, close FROM quotes
WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY AND ts <= (SELECT max(ts) FROM events)""")
register("history_lookback_by_day", ORACLE_SQL["history_lookback"])
register("history_series", with_roles(ROLE_QUOTES) + """
SELECT ticker, epoch_us(ts) // 1000 AS ts_ms, floor(close * 100.0 + 0.5) / 100.0 AS close FROM quotes
WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 5 YEAR AND ts <= (SELECT max(ts) FROM events)
  AND close IS NOT NULL AND NOT isnan(close)""")
register("quote_freshness", with_roles(ROLE_QUOTES) + """
SELECT ticker, last_ts,
       round((epoch_us((SELECT max(ts) FROM events)) - epoch_us(last_ts)) / 1e6, 6) AS age_s,
       (epoch_us((SELECT max(ts) FROM events)) - epoch_us(last_ts)) / 1e6 > 900 AS stale_quote,
       (epoch_us((SELECT max(ts) FROM events)) - epoch_us(last_ts)) / 1e6 > 1800 AS stale_history
FROM (SELECT ticker, max(ts) AS last_ts FROM quotes WHERE close IS NOT NULL GROUP BY ticker)""")

SQL_PRICES = """
prices AS (
  SELECT s.ticker, coalesce(q.price, (floor(sq.price * 100.0 + 0.5) / 100.0)) AS price,
         CASE WHEN q.price IS NOT NULL THEN 'snapshot' WHEN sq.price IS NOT NULL THEN 'chart'
              ELSE 'indisponível' END AS price_source
  FROM stocks s LEFT JOIN last_quote q ON q.ticker = s.ticker LEFT JOIN second_quotes sq ON sq.ticker = s.ticker)"""
register("price_fallback", with_roles(ROLE_STOCKS, ROLE_QUOTES, SQL_LATEST_QUOTE, ROLE_SECOND_QUOTES, SQL_PRICES)
         + " SELECT ticker, round(price, 6) AS price, price_source FROM prices")

SQL_MONITORED = """
mon AS (
  SELECT s.*, CASE WHEN (SELECT count(*) FROM watchlist) > 0
                   THEN s.ticker IN (SELECT ticker FROM watchlist WHERE ticker IS NOT NULL)
                   ELSE coalesce(s.monitored, false) END AS monitored_eff
  FROM stocks s)"""
register("monitored_flag", with_roles(ROLE_STOCKS, ROLE_WATCHLIST, SQL_MONITORED)
         + " SELECT ticker, monitored_eff AS monitored FROM mon")

SQL_CURRENT = """
cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY event_time DESC, id DESC) AS rn
                       FROM events_log) WHERE rn = 1)"""
SQL_CFG_WIDE = """
cfg AS (SELECT coalesce(max(v) FILTER (WHERE k = 'ke_global'), 0.14) AS ke,
               coalesce(max(v) FILTER (WHERE k = 'roet_global'), 0.12) AS roet,
               coalesce(max(v) FILTER (WHERE k = 'payoutt_global'), 0.60) AS payoutt,
               coalesce(max(v) FILTER (WHERE k = 'fade_global'), 10.0) AS fade FROM config)"""
SQL_EFFECTIVE = """
eff AS (
  SELECT m.ticker, m.nome, m.monitored_eff AS monitored, m.g1, m.gp,
         coalesce(c.lpa, m.lpa) AS lpa,
         coalesce(c.roe_i, m.roe_i, 0.15) AS roe_i,
         coalesce(c.payout_i, m.payout) AS payout_i,
         CASE WHEN NOT coalesce(CAST(c.ke_default AS BOOLEAN), true) AND c.ke IS NOT NULL THEN c.ke ELSE g.ke END AS ke,
         CASE WHEN NOT coalesce(CAST(c.roet_default AS BOOLEAN), true) AND c.roe_t IS NOT NULL THEN c.roe_t ELSE g.roet END
           AS roe_t,
         CASE WHEN NOT coalesce(CAST(c.payoutt_default AS BOOLEAN), true) AND c.payout_t IS NOT NULL THEN c.payout_t
              ELSE g.payoutt END AS payout_t,
         CASE WHEN NOT coalesce(CAST(c.fade_default AS BOOLEAN), true) AND c.fade IS NOT NULL THEN c.fade ELSE g.fade END
           AS fade,
         coalesce(nullif(c.growth_mode, ''), 'roe') AS growth_mode,
         c.g_i,
         CASE WHEN NOT coalesce(CAST(c.roet_default AS BOOLEAN), true) AND c.g_t IS NOT NULL THEN c.g_t
              ELSE g.roet * (1.0 - g.payoutt) END AS g_t,
         c.fut_pe, c.mos
  FROM mon m LEFT JOIN cur c ON c.ticker = m.ticker CROSS JOIN cfg g)"""
EFFECTIVE_ROLES = (ROLE_STOCKS, ROLE_EVENTS, ROLE_CONFIG, ROLE_WATCHLIST, SQL_MONITORED, SQL_CURRENT, SQL_CFG_WIDE,
                   SQL_EFFECTIVE)
register("effective_assumptions", with_roles(*EFFECTIVE_ROLES) + """
SELECT ticker, nome, monitored, round(lpa, 6) AS lpa, round(roe_i, 6) AS roe_i, round(payout_i, 6) AS payout_i,
       round(ke, 6) AS ke, round(roe_t, 6) AS roe_t, round(payout_t, 6) AS payout_t, round(fade, 6) AS fade,
       growth_mode, round(g_i, 6) AS g_i, round(g_t, 6) AS g_t, round(fut_pe, 6) AS fut_pe, round(mos, 6) AS mos
FROM eff""")


def _screener() -> str:
    g1 = "CASE WHEN growth_mode = 'g' AND g_i IS NOT NULL THEN g_i ELSE g1 END"
    s = ddm_sql("lpa", "payout_i", f"({g1})", "ke", "g_t")
    return with_roles(*EFFECTIVE_ROLES, ROLE_QUOTES, SQL_LATEST_QUOTE, ROLE_SECOND_QUOTES, """
prices AS (
  SELECT e.ticker, coalesce(q.price, (floor(sq.price * 100.0 + 0.5) / 100.0)) AS price,
         CASE WHEN q.price IS NOT NULL THEN 'snapshot' WHEN sq.price IS NOT NULL THEN 'chart'
              ELSE 'indisponível' END AS price_source
  FROM eff e LEFT JOIN last_quote q ON q.ticker = e.ticker LEFT JOIN second_quotes sq ON sq.ticker = e.ticker)""",
                      f"""
val AS (SELECT e.*, p.price, p.price_source, {g1} AS g1_used, {s['fair']} AS fair, {s['valid']} AS valid
        FROM eff e JOIN prices p ON p.ticker = e.ticker)""") + """
SELECT ticker, nome, monitored, round(lpa, 6) AS lpa, round(payout_i, 6) AS payout_i, round(ke, 6) AS ke,
       round(g_t, 6) AS g_t, round(g1_used, 6) AS g1_used, growth_mode, round(price, 6) AS price, price_source,
       round(fair, 6) AS fair, valid,
       round(CASE WHEN price > 0 AND valid THEN (fair - price) / price * 100.0 END, 6) AS margin
FROM val"""


register("screener", _screener())


def _mos() -> str:
    s = ddm_sql("lpa", "payout", "g1", "ke", "gp")
    return with_roles(ROLE_STOCKS, ROLE_SECOND_QUOTES) + f"""
SELECT ticker, round(fair, 6) AS fair, valid, round(price, 6) AS price, round(mos, 6) AS margin,
       CASE WHEN mos >= 0 THEN 'good' WHEN mos < 0 THEN 'bad' END AS margin_label,
       CASE WHEN mos IS NOT NULL THEN (CASE WHEN mos >= 0 THEN '+' ELSE '' END)
            || translate(format('{{:,.1f}}', mos), ',.', '.,') || '% de margem vs R$ '
            || translate(format('{{:,.2f}}', price), ',.', '.,') END AS badge
FROM (SELECT s.ticker, {s['fair']} AS fair, {s['valid']} AS valid, (floor(q.price * 100.0 + 0.5) / 100.0) AS price,
             CASE WHEN (floor(q.price * 100.0 + 0.5) / 100.0) > 0 AND {s['valid']}
                  THEN ({s['fair']} - (floor(q.price * 100.0 + 0.5) / 100.0)) / (floor(q.price * 100.0 + 0.5) / 100.0) * 100.0 END AS mos
      FROM stocks s LEFT JOIN second_quotes q ON q.ticker = s.ticker)"""


register("margin_of_safety", _mos())
register("ddm_projection_ledger", with_roles(ROLE_STOCKS) + """
SELECT ticker, n, round(dividend, 6) AS dividend, round(factor, 6) AS factor, round(dividend / factor, 6) AS pv
FROM (SELECT ticker, n, lpa * payout * pow(1.0 + g1, CAST(n AS DOUBLE)) AS dividend,
             CASE WHEN n > 0 THEN pow(1.0 + ke, CAST(n AS DOUBLE)) END AS factor
      FROM stocks, range(0, 6) t(n))""")


def _steps() -> str:
    s = ddm_sql("lpa", "payout", "g1", "ke", "gp")
    txt = ("CASE WHEN value IS NULL THEN '—' ELSE 'R$ ' || translate(format('{:,.2f}', value), ',.', '.,') END")
    return with_roles(ROLE_STOCKS) + f"""
, v AS (SELECT ticker, {s['d0']} AS d0, {s['pv_sum']} AS pv_sum, {s['terminal']} AS terminal,
               {s['terminal_pv']} AS terminal_pv, CASE WHEN {s['valid']} THEN {s['fair']} END AS fair FROM stocks)
, l AS (SELECT ticker, 1 AS step, 'base dividend' AS label, d0 AS value FROM v
        UNION ALL SELECT ticker, 2, 'present value sum', pv_sum FROM v
        UNION ALL SELECT ticker, 3, 'terminal value', terminal FROM v
        UNION ALL SELECT ticker, 3, 'discounted terminal', terminal_pv FROM v
        UNION ALL SELECT ticker, 4, 'fair value', fair FROM v)
SELECT ticker, step, label, round(value, 6) AS value, {txt} AS text FROM l"""


register("ddm_step_ledger", _steps())


def _grid() -> str:
    s = ddm_sql("lpa", "payout", "g1", "k", "g")
    return with_roles(ROLE_STOCKS) + f"""
, grid AS (SELECT (6.0 + i * 0.5) / 100.0 AS k, (j * 0.5) / 100.0 AS g FROM range(0, 39) a(i), range(0, 21) b(j))
, pts AS (SELECT ticker, CASE WHEN {s['valid']} THEN {s['fair']} END AS fair FROM stocks, grid)
SELECT ticker, CAST(819 AS BIGINT) AS n_points, count(fair) AS n_valid, round(count(fair) / 819.0, 6) AS share_valid,
       round(min(fair), 6) AS min_fair, round(median(fair), 6) AS median_fair, round(max(fair), 6) AS max_fair
FROM pts GROUP BY ticker"""


register("ddm_scenario_grid", _grid())

# --- names: F1-F3, J1-J3 ---------------------------------------------------------------------
STOP_SQL = "['SA', 'S', 'A', 'DO', 'DA', 'DE', 'E', 'DOS', 'DAS', 'CIA', 'COMPANHIA']"


def fold_sql(x: str) -> str:
    return f"regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g')"


def norm_sql(x: str) -> str:
    s = f"upper({fold_sql(x)})"
    s = f"regexp_replace({s}, 'EM RECUPERACAO JUDICIAL', ' ', 'g')"
    s = f"regexp_replace({s}, '[^A-Z0-9 ]', ' ', 'g')"
    s = f"regexp_replace({s}, ' +', ' ', 'g')"
    return f"trim({s})"


def tokens_sql(norm: str) -> str:
    return (f"list_sort(list_distinct(list_filter(string_split({norm}, ' '), "
            f"lambda w: length(w) > 1 AND NOT list_contains({STOP_SQL}, w))))")


ROLE_NAMES = f"""
listed AS (SELECT doc_id AS ticker_id, text AS empresa, {norm_sql('text')} AS norm FROM documents WHERE doc_id % 2 = 0),
registry AS (SELECT doc_id AS cd, text AS nome, CAST(2000 + n_chars % 25 AS INTEGER) AS ultimo_ano,
                    {norm_sql('text')} AS norm FROM documents WHERE doc_id % 2 = 1),
best_norm AS (SELECT norm, arg_max(cd, ultimo_ano * 1e12 - cd) AS cd FROM registry GROUP BY norm),
exact AS (SELECT l.ticker_id, b.cd AS match_id FROM listed l LEFT JOIN best_norm b ON b.norm = l.norm),
ltok AS (SELECT ticker_id, {tokens_sql('norm')} AS toks FROM listed),
rtok AS (SELECT cd, ultimo_ano, {tokens_sql('norm')} AS toks FROM registry)"""


def token_best_sql(left_filter: str = "TRUE") -> str:
    return """
scored AS (
  SELECT l.ticker_id, r.cd, r.ultimo_ano,
         len(list_intersect(l.toks, r.toks)) / (len(l.toks) + len(r.toks) - len(list_intersect(l.toks, r.toks)))
           AS j
  FROM ltok l, rtok r WHERE len(l.toks) > 0 AND len(r.toks) > 0 AND """ + left_filter + """),
tbest AS (SELECT ticker_id, cd AS match_id, j AS jaccard FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker_id ORDER BY j DESC, ultimo_ano DESC, cd ASC) AS rn
  FROM scored WHERE j >= 0.72) WHERE rn = 1)"""


register("fold_accents", f"SELECT doc_id, {fold_sql('text')} AS folded FROM documents")
register("normalize_name", f"SELECT doc_id, {norm_sql('text')} AS norm FROM documents")
register("name_tokens", f"SELECT doc_id, {tokens_sql(norm_sql('text'))} AS tokens FROM documents")
register("name_exact_match", with_roles(ROLE_NAMES) + " SELECT ticker_id, match_id FROM exact")
register("name_token_match", with_roles(ROLE_NAMES) + "," + token_best_sql()
         + " SELECT ticker_id, match_id, round(jaccard, 6) AS jaccard FROM tbest")
register("entity_resolution", with_roles(ROLE_NAMES) + "," + token_best_sql(
    "l.ticker_id IN (SELECT ticker_id FROM exact WHERE match_id IS NULL)") + """
SELECT e.ticker_id,
       coalesce(e.match_id, t.match_id) AS match_id,
       CASE WHEN e.match_id IS NOT NULL THEN 'exato'
            WHEN t.match_id IS NOT NULL THEN 'token ' || format('{:.2f}', t.jaccard)
            ELSE 'SEM MATCH' END AS how,
       round(CASE WHEN e.match_id IS NULL THEN t.jaccard END, 6) AS jaccard
FROM exact e LEFT JOIN tbest t ON t.ticker_id = e.ticker_id""")

# --- classification: C1-C5, F4, F5 -----------------------------------------------------------


def pick_sql(options, idx: str) -> str:
    arr = "[" + ", ".join("'" + o.replace("'", "''") + "'" for o in options) + "]"
    return f"{arr}[CAST({idx} % {len(options)} AS INTEGER) + 1]"


def _ind_sql() -> str:
    from valorum.plans import roles as R
    return f"""
ind AS (
  SELECT c_custkey AS ticker,
         {pick_sql(R.RAW_SECTORS, 'c_nationkey')} AS sectorname,
         {pick_sql(R.RAW_SUBSECTORS, 'c_nationkey')} AS subsectorname,
         c_mktsegment AS segmentname,
         c_acctbal / 700.0 AS dy,
         o.sum_total / o.n_orders / 6000.0 - 5.0 AS p_l,
         o.n_orders / 3.0 AS p_vp,
         CAST((c_custkey % 40) - 5 AS DOUBLE) AS roe,
         CAST(c_nationkey - 5 AS DOUBLE) AS receitas_cagr5,
         o.n_orders / 4.0 AS dividaliquidaebit,
         c_acctbal / 1000.0 AS lpa,
         c_acctbal * 1e7 AS valormercado,
         o.sum_total AS liquidezmediadiaria,
         {pick_sql(R.LISTING_SEGMENTS, 'c_custkey')} AS listing,
         {pick_sql(R.CONTROL_TEXTS, 'c_nationkey')} AS controle
  FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(28,2))) AS DOUBLE) AS sum_total
                             FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey)"""


def gov_sql(x: str) -> str:
    u = f"upper(coalesce({x}, ''))"
    return (f"CASE WHEN contains({u}, 'NOVO MERCADO') THEN 'Novo Mercado' "
            f"WHEN contains({u}, 'MAIS N') THEN 'Bovespa Mais N2' "
            f"WHEN contains({u}, 'NIVEL 2') OR contains({u}, 'NÍVEL 2') THEN 'Nível 2' "
            f"WHEN contains({u}, 'NIVEL 1') OR contains({u}, 'NÍVEL 1') THEN 'Nível 1' "
            f"WHEN contains({u}, 'MAIS') THEN 'Bovespa Mais' "
            f"WHEN {u} = '' THEN '' ELSE 'Tradicional' END")


def ctrl_sql(x: str) -> str:
    u = f"upper(coalesce({x}, ''))"
    return (f"CASE WHEN contains({u}, 'ESTATAL') THEN 'Estatal' WHEN contains({u}, 'ESTRANGEIRO') THEN 'Estrangeiro' "
            f"WHEN contains({u}, 'PRIVADO') THEN 'Privada nacional' ELSE '' END")


def size_sql(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL OR {x} = 0 THEN '' WHEN {x} >= 10e9 THEN 'Large cap' "
            f"WHEN {x} >= 2e9 THEN 'Mid cap' ELSE 'Small cap' END")


def ge_sql(x: str, k: float) -> str:
    return f"coalesce({x} >= {k}, false)"


def between_sql(x: str, hi: float) -> str:
    return f"coalesce({x} > 0 AND {x} <= {hi}, false)"


def tags_sql(dy, pl, pvp, roe, lev, eps, mc) -> str:
    loss = f"coalesce({eps} < 0, false)"
    cheap = f"({between_sql(pl, 8.0)} AND {between_sql(pvp, 1.0)})"
    exp = f"({ge_sql(pl, 25.0)} OR {ge_sql(pvp, 4.0)})"
    qual = f"({ge_sql(roe, 15.0)} AND ({lev} IS NULL OR coalesce({lev} <= 2.0, false)))"
    items = [f"CASE WHEN {loss} THEN 'Prejuízo' END",
             f"CASE WHEN {ge_sql(dy, 8.0)} THEN 'Alta DY' END",
             f"CASE WHEN {cheap} THEN 'Barata' WHEN {exp} THEN 'Cara' END",
             f"CASE WHEN {qual} THEN 'Qualidade' END",
             f"CASE WHEN {ge_sql(lev, 3.5)} THEN 'Alavancada' END",
             f"CASE WHEN {ge_sql(mc, 5e10)} AND NOT {loss} THEN 'Blue chip' END"]
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)[1:3]"


def profile_sql(sector, dy, pl, pvp, cagr, roe) -> str:
    return (f"CASE WHEN {sector} IN ('Materiais Básicos', 'Petróleo, Gás e Biocombustíveis') THEN 'Cíclica' "
            f"WHEN {ge_sql(dy, 6.0)} THEN 'Dividendos' "
            f"WHEN {ge_sql(cagr, 12.0)} AND {ge_sql(roe, 12.0)} THEN 'Crescimento' "
            f"WHEN {between_sql(pl, 9.0)} AND {between_sql(pvp, 1.2)} THEN 'Valor' "
            f"WHEN {sector} IN ('Utilidade Pública', 'Consumo não Cíclico', 'Saúde') THEN 'Defensiva' "
            f"WHEN {ge_sql(cagr, 8.0)} THEN 'Crescimento' ELSE 'Valor' END")


WS = "[\\s]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def clean_label_sql(x: str) -> str:
    s = strip_sql(x)
    s = f"replace({s}, 'Financeiro e Outros', 'Financeiro')"
    s = f"replace(replace(replace({s}, '..', ', '), ' . ', ', '), '. ', ', ')"
    s = strip_sql(f"regexp_replace({s}, '{WS}+', ' ', 'g')")
    s = strip_sql(f"regexp_replace({s}, '^,+|,+$', '', 'g')")
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN '' ELSE {s} END"


def clean_registry_sql(x: str) -> str:
    s = f"regexp_replace({strip_sql(f'coalesce({x}, {chr(39)}{chr(39)})')}, '^Emp\\. Adm\\. Part\\. - ', '')"
    return f"CASE WHEN {s} = 'Sem Setor Principal' THEN '' ELSE {s} END"


IND = _ind_sql()
register("classify_governance", with_roles(IND) + f" SELECT ticker, {gov_sql('listing')} AS gov FROM ind")
register("classify_control", with_roles(IND) + f" SELECT ticker, {ctrl_sql('controle')} AS ctrl FROM ind")
register("classify_size", with_roles(IND) + f" SELECT ticker, {size_sql('valormercado')} AS tamanho FROM ind")
register("derive_tags", with_roles(IND) + " SELECT ticker, "
         + tags_sql("dy", "p_l", "p_vp", "roe", "dividaliquidaebit", "lpa", "valormercado") + " AS tags FROM ind")
register("derive_profile", with_roles(IND) + " SELECT ticker, "
         + profile_sql(clean_label_sql("sectorname"), "dy", "p_l", "p_vp", "receitas_cagr5", "roe")
         + " AS perfil FROM ind")
register("clean_label", with_roles(IND) + f" SELECT ticker, {clean_label_sql('sectorname')} AS setor, "
         f"{clean_label_sql('subsectorname')} AS subsetor FROM ind")


def _registry_sql() -> str:
    from valorum.plans import roles as R
    return f"""
reg AS (SELECT CAST(s_suppkey AS VARCHAR) AS CD_CVM,
               {pick_sql(R.REGISTRY_SECTORS, 's_nationkey')} AS SETOR_ATIV,
               {pick_sql(R.CONTROL_TEXTS, 's_nationkey')} AS CONTROLE_ACIONARIO FROM supplier)"""


REG = _registry_sql()
register("clean_registry_sector", with_roles(REG) + f"""
SELECT CASE WHEN length(CD_CVM) < 6 THEN lpad(CD_CVM, 6, '0') ELSE CD_CVM END AS cd_cvm,
       {clean_registry_sql('SETOR_ATIV')} AS setor, {ctrl_sql('CONTROLE_ACIONARIO')} AS ctrl FROM reg""")

# --- universe: V4, A7 --------------------------------------------------------------------------


def _universe_sql() -> str:
    from valorum.plans import roles as R
    seg = pick_sql(R.LISTING_SEGMENTS, "p_partkey")
    obj = f"""'{{"market": "' || {seg} || '"}}'"""
    return with_roles(ROLE_NAMES) + "," + token_best_sql(
        "l.ticker_id IN (SELECT ticker_id FROM exact WHERE match_id IS NULL)") + f""",
res AS (SELECT e.ticker_id AS ticker, coalesce(e.match_id, t.match_id) AS cd_cvm,
               CASE WHEN e.match_id IS NOT NULL THEN 'exato'
                    WHEN t.match_id IS NOT NULL THEN 'token ' || format('{{:.2f}}', t.jaccard)
                    ELSE 'SEM MATCH' END AS how
        FROM exact e LEFT JOIN tbest t ON t.ticker_id = e.ticker_id),
pf AS (SELECT l_partkey AS cd, CAST(year(l_shipdate) AS INTEGER) AS year, l_returnflag AS klass,
              l_extendedprice AS value, l_extendedprice * l_discount AS paid,
              CASE WHEN l_quantity > 25 THEN 'MIL' ELSE 'UN' END AS scale, l_orderkey, l_linenumber
       FROM lineitem WHERE l_linestatus = 'F'),
eps AS (SELECT cd, value / 1000.0 AS eps FROM (
          SELECT *, row_number() OVER (PARTITION BY cd ORDER BY year DESC, (klass = 'R') DESC,
                                       abs(value / 1000.0) DESC, l_orderkey, l_linenumber) AS rn
          FROM pf WHERE value / 1000.0 <> 0 AND klass IN ('R', 'A')) WHERE rn = 1),
ni AS (SELECT cd, CASE WHEN scale = 'MIL' THEN value * 1000.0 ELSE value END AS ni FROM (
          SELECT *, row_number() OVER (PARTITION BY cd ORDER BY year DESC, (klass = 'R') DESC, l_orderkey,
                                       l_linenumber) AS rn
          FROM pf WHERE klass IN ('R', 'N')) WHERE rn = 1),
dy AS (SELECT cd, year, CAST(sum(CAST(abs(paid) AS DECIMAL(28,4))) AS DOUBLE) AS d FROM pf WHERE klass = 'A'
       GROUP BY cd, year),
dl AS (SELECT cd, arg_max(d, year) AS d FROM dy WHERE d IS NOT NULL GROUP BY cd),
reg AS (SELECT p_partkey AS cd, {pick_sql(R.CONTROL_TEXTS, 'p_size')} AS controle,
               CASE WHEN p_size % 2 = 0 THEN to_json({obj}) ELSE {obj} END AS payload FROM part),
facts AS (
  SELECT coalesce(eps.cd, ni.cd, dl.cd, reg.cd) AS cd, eps.eps,
         CASE WHEN dl.d <> 0 AND ni.ni > 0
              THEN {pyround_sql("least(1.5, greatest(0.0, dl.d * 1000.0 / ni.ni))", 3)} END AS payout_calc,
         {ctrl_sql('reg.controle')} AS ctrl,
         {gov_sql("json_extract_string(CASE WHEN ltrim(reg.payload) LIKE '\"%' THEN json_extract_string(reg.payload, '$') ELSE reg.payload END, '$.market')")} AS gov
  FROM eps FULL JOIN ni ON ni.cd = eps.cd FULL JOIN dl ON dl.cd = coalesce(eps.cd, ni.cd)
       FULL JOIN reg ON reg.cd = coalesce(eps.cd, ni.cd, dl.cd)),
ind AS (SELECT * FROM ({_ind_sql().split('AS (', 1)[1].rsplit(')', 1)[0]})),
snap AS (SELECT c_custkey AS ticker, c_acctbal * 2e6 AS market_cap FROM customer),
u AS (
  SELECT r.ticker, r.cd_cvm, r.how, f.eps, f.payout_calc, f.ctrl, f.gov, i.*, i.ticker IS NOT NULL AS has_ind,
         i.lpa AS ind_lpa, s.market_cap
  FROM res r LEFT JOIN facts f ON f.cd = r.cd_cvm LEFT JOIN ind i ON i.ticker = r.ticker
       LEFT JOIN snap s ON s.ticker = r.ticker)"""


def _universe_select() -> str:
    setor = clean_label_sql("sectorname")
    fallback = pyround_sql("CASE WHEN abs(ind_lpa) <= 100 AND ind_lpa <> 0 THEN ind_lpa END", 2)
    prim = "CASE WHEN cd_cvm IS NOT NULL AND abs(eps) <= 100 AND eps <> 0 THEN eps END"
    mcap = "coalesce(nullif(valormercado, 0), market_cap)"
    return f"""
SELECT ticker, cd_cvm,
       CASE WHEN has_ind THEN {setor} ELSE '' END AS setor,
       CASE WHEN has_ind THEN {clean_label_sql('subsectorname')} ELSE '' END AS subsetor,
       CASE WHEN has_ind THEN {clean_label_sql('segmentname')} ELSE '' END AS segmento,
       CASE WHEN has_ind THEN {profile_sql(setor, 'dy', 'p_l', 'p_vp', 'receitas_cagr5', 'roe')} ELSE '' END AS perfil,
       {size_sql(mcap)} AS tamanho,
       coalesce(gov, '') AS gov, coalesce(ctrl, '') AS ctrl, 'DDM · 2 est.' AS modelo,
       CASE WHEN has_ind THEN {tags_sql('dy', 'p_l', 'p_vp', 'roe', 'dividaliquidaebit', 'ind_lpa', 'valormercado')}
            ELSE CAST([] AS VARCHAR[]) END AS tags,
       false AS monitored,
       {pyround_sql(f"coalesce({prim}, {fallback})", 2)} AS lpa,
       coalesce(payout_calc, 0.45) AS payout,
       CASE WHEN has_ind AND roe > 0 THEN {pyround_sql("roe / 100.0", 4)} ELSE 0.15 END AS roe_i,
       CASE WHEN liquidezmediadiaria <> 0 THEN round_even(liquidezmediadiaria, 0) END AS liquidez,
       CAST(0.06 AS DOUBLE) AS g1, CAST(0.14 AS DOUBLE) AS ke, CAST(0.04 AS DOUBLE) AS gp, how
FROM u"""


register("universe_build", _universe_sql() + _universe_select())
register("company_facts_bucketed", _universe_sql() + " SELECT cd AS cd_cvm, eps, payout_calc, ctrl, gov FROM facts")
register("build_quality_report", _universe_sql() + ", uni AS (" + _universe_select() + """)
SELECT count(*) AS total, count(*) FILTER (WHERE cd_cvm IS NOT NULL) AS matched,
       count(*) FILTER (WHERE lpa IS NOT NULL) AS with_lpa, count(*) FILTER (WHERE cd_cvm IS NULL) AS no_match,
       count(*) FILTER (WHERE gov <> '') AS gov_filled,
       (SELECT list_sort(list(t)) FROM (SELECT CAST(ticker AS VARCHAR) AS t FROM uni WHERE cd_cvm IS NULL
                                        ORDER BY t LIMIT 8)) AS unmatched_sample,
       (SELECT count(*) FROM uni WHERE CAST(ticker AS VARCHAR) IN ('0','2','4','6','8','10','12','14')) AS spot_found
FROM uni""")

# --- state: M1-M12, J7, J10, M9, M10 ---------------------------------------------------------
ROLE_STATE_STOCKS = """
cur_stocks AS (
  SELECT p_partkey AS ticker, p_name AS nome, CAST(p_partkey AS VARCHAR) AS cd_cvm, 'edited ' || p_type AS setor,
         '' AS subsetor, p_brand AS segmento, '' AS perfil, '' AS tamanho, '' AS gov, '' AS ctrl,
         CASE WHEN p_size % 3 = 0 THEN 'custom' ELSE 'DDM · 2 est.' END AS modelo, '[]' AS tags,
         CAST(p_size > 20 AS INTEGER) AS monitored, p_retailprice / 100.0 AS lpa,
         CAST(p_size AS DOUBLE) / 50.0 AS payout, CAST(NULL AS DOUBLE) AS liquidez, CAST(0.15 AS DOUBLE) AS roe_i,
         CAST(0.06 AS DOUBLE) AS g1, CAST(0.14 AS DOUBLE) AS ke, CAST(0.04 AS DOUBLE) AS gp,
         CAST(p_size > 40 AS INTEGER) AS "user"
  FROM part
  UNION ALL
  SELECT -1 - s_suppkey, s_name, CAST(NULL AS VARCHAR), 'user', '', '', '', '', '', '', 'DDM · 2 est.', '[]', 0,
         s_acctbal / 1000.0, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(0.15 AS DOUBLE), CAST(0.06 AS DOUBLE),
         CAST(0.14 AS DOUBLE), CAST(0.04 AS DOUBLE), 1
  FROM supplier)"""

ROLE_SEED = """
listed AS (SELECT p_partkey AS ticker, p_name AS name, p_type AS setor, p_brand AS segmento,
                  CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part
           UNION ALL SELECT c_custkey + 1000000000, c_name, c_mktsegment, '', CAST(c_nationkey AS DOUBLE), c_acctbal
           FROM customer),
seed AS (
  SELECT ticker, upper(name) AS nome, CAST(ticker AS VARCHAR) AS cd_cvm, setor,
         '' AS subsetor, segmento, 'Valor' AS perfil, 'Small cap' AS tamanho, '' AS gov, '' AS ctrl,
         'DDM · 2 est.' AS modelo, '[]' AS tags, CAST(size > 30 AS INTEGER) AS monitored,
         price / 90.0 AS lpa, size / 40.0 AS payout, price * 1000.0 AS liquidez,
         size / 100.0 AS roe_i, CAST(0.06 AS DOUBLE) AS g1, CAST(0.14 AS DOUBLE) AS ke,
         CAST(0.04 AS DOUBLE) AS gp
  FROM listed)"""

KEEP = ("nome", "setor", "subsetor", "segmento", "perfil", "tamanho", "gov", "ctrl", "modelo", "tags")
REFRESH = ("cd_cvm", "monitored", "lpa", "payout", "liquidez", "roe_i", "g1", "ke", "gp")
FLOATS = ("lpa", "payout", "liquidez", "roe_i", "g1", "ke", "gp")


def _merge_seed() -> str:
    cols = []
    for c in ("nome", "cd_cvm", "setor", "subsetor", "segmento", "perfil", "tamanho", "gov", "ctrl", "modelo", "tags",
              "monitored", "lpa", "payout", "liquidez", "roe_i", "g1", "ke", "gp"):
        if c in REFRESH:
            e = f"CASE WHEN s.ticker IS NOT NULL THEN s.{c} ELSE c.{c} END"
        else:
            e = f"CASE WHEN c.ticker IS NOT NULL THEN c.{c} ELSE s.{c} END"
        if c in FLOATS:
            e = f"round({e}, 6)"
        cols.append(f"{e} AS {c}")
    return with_roles(ROLE_STATE_STOCKS, ROLE_SEED, ROLE_REMOVED) + f"""
, s2 AS (SELECT * FROM seed WHERE ticker NOT IN (SELECT ticker FROM removed))
SELECT coalesce(c.ticker, s.ticker) AS ticker, {', '.join(cols)},
       CASE WHEN c.ticker IS NOT NULL THEN c."user" ELSE 0 END AS "user"
FROM cur_stocks c FULL JOIN s2 s ON c.ticker = s.ticker"""


register("merge_seed", _merge_seed())
register("seed_minus_removed", with_roles(ROLE_SEED, ROLE_REMOVED)
         + " SELECT ticker, nome FROM seed WHERE ticker NOT IN (SELECT ticker FROM removed)")

A_FLOATS = ("lpa", "roe_i", "payout_i", "roe_t", "payout_t", "fade", "ke", "g_i", "g_t", "fut_pe", "mos")
A_COLS = ("id", "event_time", "lpa", "roe_i", "payout_i", "roe_t", "payout_t", "fade", "ke", "growth_mode", "g_i",
          "g_t", "fut_pe", "mos", "ke_default", "roet_default", "payoutt_default", "fade_default")


def _acols(prefix: str = "") -> str:
    return ", ".join(f"round({prefix}{c}, 6) AS {c}" if c in A_FLOATS else f"{prefix}{c} AS {c}" for c in A_COLS)


register("upsert_latest", with_roles(ROLE_EVENTS) + f"""
SELECT ticker, {_acols()} FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY event_time DESC, id DESC) rn FROM events_log) WHERE rn = 1""")

WATCH_ADDS = "SELECT CASE WHEN l_quantity >= 25 THEN l_partkey ELSE -1 - l_suppkey END AS ticker FROM lineitem"
register("insert_ignore", with_roles(ROLE_WATCHLIST) + f"""
SELECT DISTINCT ticker FROM watchlist
UNION ALL SELECT DISTINCT ticker FROM ({WATCH_ADDS}) WHERE ticker NOT IN (SELECT ticker FROM watchlist)""")
register("append_log", with_roles(ROLE_EVENTS) + f" SELECT ticker, {_acols()} FROM events_log")

PATCH_CHANGES = """
chg AS (
  SELECT CASE WHEN l_linenumber = 7 THEN l_partkey + 1000000000 ELSE l_partkey END AS ticker, l_orderkey AS id,
         l_linenumber AS line, l_linenumber % 4 AS kind,
         strftime(l_shipdate, '%Y%m%d%H%M%S') || lpad(CAST(l_orderkey AS VARCHAR), 15, '0') || l_linenumber AS ord,
         'S' || l_returnflag || CAST(l_orderkey AS VARCHAR) AS p_setor,
         coalesce(CASE WHEN l_tax > 0.04 THEN 'N' || l_linestatus || CAST(l_suppkey AS VARCHAR) END, '') AS p_nome,
         l_returnflag AS p_segmento FROM lineitem),
patch AS (
  SELECT ticker, arg_max(p_setor, ord) FILTER (WHERE kind = 1) AS p_setor,
         arg_max(p_nome, ord) FILTER (WHERE kind = 2) AS p_nome,
         arg_max(p_segmento, ord) FILTER (WHERE kind = 3) AS p_segmento,
         arg_max('[]', ord) FILTER (WHERE kind = 3) AS p_tags FROM chg GROUP BY ticker)"""
register("patch_columns", with_roles(ROLE_STATE_STOCKS, PATCH_CHANGES) + """
SELECT s.ticker, coalesce(p_nome, nome) AS nome, coalesce(p_setor, setor) AS setor,
       coalesce(p_segmento, segmento) AS segmento, coalesce(p_tags, tags) AS tags
FROM cur_stocks s LEFT JOIN patch p ON p.ticker = s.ticker""")
register("patch_status", with_roles(ROLE_STATE_STOCKS, PATCH_CHANGES) + """
SELECT c.ticker, c.id, c.line,
       CASE WHEN kind = 0 THEN 'nada para atualizar'
            WHEN c.ticker NOT IN (SELECT ticker FROM cur_stocks) THEN 'ticker não encontrado' ELSE 'ok' END AS status
FROM chg c""")
register("cascade_delete", with_roles(ROLE_STATE_STOCKS, ROLE_EVENTS, ROLE_WATCHLIST, ROLE_REMOVED, SQL_CURRENT) + f"""
, adds AS (SELECT DISTINCT ticker FROM ({WATCH_ADDS}))
SELECT "table", ticker, count(*) AS rows FROM (
  SELECT 'stocks' AS "table", ticker FROM cur_stocks WHERE ticker NOT IN (SELECT ticker FROM removed)
  UNION ALL SELECT 'watchlist', ticker FROM watchlist WHERE ticker NOT IN (SELECT ticker FROM removed)
  UNION ALL SELECT 'premissa_atual', ticker FROM cur WHERE ticker NOT IN (SELECT ticker FROM removed)
  UNION ALL SELECT 'premissa_hist', ticker FROM events_log WHERE ticker NOT IN (SELECT ticker FROM removed)
  UNION ALL SELECT 'removed', ticker FROM (SELECT ticker FROM adds UNION SELECT ticker FROM removed))
GROUP BY "table", ticker""")
register("clear_tombstone", with_roles(ROLE_REMOVED) + """
SELECT ticker FROM removed WHERE ticker NOT IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO' AND p_size = 3)""")

REQUESTS = """
req AS (SELECT -1 - s_suppkey AS ticker, CASE WHEN s_acctbal >= 0 THEN s_name END AS nome, s_acctbal / 1000.0 AS lpa,
               -1 - s_suppkey AS id FROM supplier
        UNION ALL SELECT c_custkey // 3 + 1000000000, CASE WHEN c_acctbal >= 0 THEN c_name END, CAST(NULL AS DOUBLE),
                         c_custkey FROM customer),
checked_req AS (SELECT *, ticker IS NULL OR nome IS NULL OR nome = '' AS bad FROM req),
st AS (SELECT *, CASE WHEN bad THEN 'invalid'
                      WHEN ticker IN (SELECT ticker FROM cur_stocks)
                        OR row_number() OVER (PARTITION BY ticker, bad ORDER BY id) > 1 THEN 'duplicate'
                      ELSE 'inserted' END AS status
       FROM checked_req)"""
register("insert_status", with_roles(ROLE_STATE_STOCKS, REQUESTS) + """
SELECT ticker, id, status, CASE status WHEN 'invalid' THEN 'ticker e nome obrigatórios'
                                       WHEN 'duplicate' THEN 'ticker já cadastrado' END AS error FROM st""")
register("add_entities_tombstones", with_roles(ROLE_STATE_STOCKS, ROLE_REMOVED, REQUESTS) + """
SELECT ticker FROM (SELECT ticker FROM removed UNION ALL SELECT c_custkey + 1000000000 FROM customer)
WHERE ticker NOT IN (SELECT ticker FROM st WHERE status = 'inserted')""")
register("add_entities", with_roles(ROLE_STATE_STOCKS, REQUESTS) + """
SELECT ticker, nome, cd_cvm, setor, subsetor, segmento, perfil, tamanho, gov, ctrl, modelo, tags, monitored,
       round(lpa, 6) AS lpa, round(payout, 6) AS payout, round(liquidez, 6) AS liquidez, round(roe_i, 6) AS roe_i,
       round(g1, 6) AS g1, round(ke, 6) AS ke, round(gp, 6) AS gp, "user" FROM cur_stocks
UNION ALL
SELECT ticker, nome, CAST(NULL AS VARCHAR), '', '', '', '', '', '', '', 'DDM · 2 est.', '[]', 0, round(lpa, 6),
       CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(0.15 AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE),
       CAST(NULL AS DOUBLE), 1
FROM st WHERE status = 'inserted'""")
register("evolve_schema", with_roles(ROLE_EVENTS) + """
SELECT ticker, event_time, id, round(lpa, 6) AS lpa, CAST(NULL AS DOUBLE) AS roe_i, CAST(NULL AS DOUBLE) AS payout_i,
       CAST(NULL AS DOUBLE) AS roe_t, CAST(NULL AS DOUBLE) AS payout_t, CAST(NULL AS DOUBLE) AS fade,
       round(ke, 6) AS ke, 'roe' AS growth_mode, CAST(NULL AS DOUBLE) AS g_i, CAST(NULL AS DOUBLE) AS g_t,
       CAST(NULL AS DOUBLE) AS fut_pe, CAST(NULL AS DOUBLE) AS mos, coalesce(ke_default, 1) AS ke_default,
       1 AS roet_default, 1 AS payoutt_default, 1 AS fade_default
FROM events_log""")
register("config_unpivot", with_roles(ROLE_CONFIG) + """
, wide AS (SELECT o_orderdate AS written_at, o_orderkey AS write_id,
                  CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice / 2e6 END AS ke,
                  CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice / 2e6 END AS roet,
                  CASE WHEN o_orderstatus = 'P' THEN o_totalprice / 2e6 * 10 END AS ipca,
                  CASE WHEN o_orderpriority = '5-LOW' THEN CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END END
                    AS mode FROM orders)
, rows AS (SELECT 'ke_global' AS k, ke AS v, written_at, write_id FROM wide WHERE ke IS NOT NULL
           UNION ALL SELECT 'roet_global', roet, written_at, write_id FROM wide WHERE roet IS NOT NULL
           UNION ALL SELECT 'ipca_global', ipca, written_at, write_id FROM wide WHERE ipca IS NOT NULL
           UNION ALL SELECT 'ke_mode_global', mode, written_at, write_id FROM wide WHERE mode IS NOT NULL)
, newest AS (SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY written_at DESC, write_id DESC) rn
                               FROM rows) WHERE rn = 1)
SELECT k, round(v, 6) AS v FROM config WHERE k NOT IN (SELECT k FROM newest)
UNION ALL SELECT k, round(v, 6) FROM newest""")

# --- validation, portfolio, health -------------------------------------------------------------
ROLE_POSITIONS = """
positions AS (
  SELECT ticker, quantidade, CASE WHEN min_flag = 'R' THEN -1.0 ELSE avg_price END AS preco_medio FROM (
    SELECT l_partkey AS ticker, CAST(sum(CAST(l_quantity AS DECIMAL(28,2))) AS DOUBLE) - 700.0 AS quantidade, CAST(sum(CAST(l_extendedprice AS DECIMAL(28,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(28,2))) AS DOUBLE) AS avg_price,
           min(l_returnflag) AS min_flag FROM lineitem GROUP BY l_partkey)),
checked AS (
  SELECT *, list_filter([CASE WHEN NOT coalesce(quantidade IS NOT NULL AND NOT isnan(quantidade) AND NOT isinf(quantidade), false) THEN 'quantity_finite' END,
                         CASE WHEN NOT coalesce(preco_medio IS NOT NULL AND NOT isnan(preco_medio) AND NOT isinf(preco_medio), false) THEN 'price_finite' END,
                         CASE WHEN NOT coalesce(quantidade > 0, false) THEN 'quantity_positive' END,
                         CASE WHEN NOT coalesce(preco_medio >= 0, false) THEN 'price_non_negative' END],
                        lambda x: x IS NOT NULL) AS errs
  FROM positions)"""
register("validate_positions", with_roles(ROLE_POSITIONS.replace("  FROM positions)", """  FROM (
    SELECT *, 1 AS batch FROM positions
    UNION ALL SELECT p_partkey, CAST(p_size AS DOUBLE) - 3.0, p_retailprice, 2 FROM part))""")) + """
, numbered AS (SELECT *, len(errs) > 0 AS bad,
                      row_number() OVER (PARTITION BY ticker, len(errs) > 0 ORDER BY batch) AS no FROM checked)
SELECT ticker, batch, round(quantidade, 6) AS quantidade, round(preco_medio, 6) AS preco_medio,
       NOT bad AND no = 1 AS valid,
       CASE WHEN bad OR no = 1 THEN array_to_string(errs, ',') ELSE 'duplicate_key' END AS errors FROM numbered""")


def _portfolio() -> str:
    scr = ORACLE_SQL["screener"]
    body = scr.split("SELECT ticker, nome, monitored, round(lpa, 6)")[0]
    g1 = "CASE WHEN growth_mode = 'g' AND g_i IS NOT NULL THEN g_i ELSE g1 END"
    del g1
    return body + ", " + ROLE_POSITIONS.strip() + """
, pv AS (SELECT c.ticker, c.quantidade, c.preco_medio, v.price, CASE WHEN v.valid THEN v.fair ELSE v.fair END AS fair,
                v.valid FROM checked c LEFT JOIN val v ON v.ticker = c.ticker WHERE len(c.errs) = 0)
SELECT ticker, round(quantidade, 6) AS quantidade, round(preco_medio, 6) AS preco_medio, round(price, 6) AS price,
       round(fair, 6) AS fair, round(quantidade * price, 6) AS value, round(quantidade * preco_medio, 6) AS cost,
       round(quantidade * price - quantidade * preco_medio, 6) AS gain,
       round(CASE WHEN quantidade * preco_medio <> 0
                  THEN (quantidade * price - quantidade * preco_medio) / (quantidade * preco_medio) END * 100.0, 6)
         AS gain_pct,
       round(CASE WHEN valid AND price <> 0 THEN (fair - price) / price END * 100.0, 6) AS upside_pct
FROM pv"""


register("portfolio_valuation", _portfolio())
register("table_health", with_roles(ROLE_STOCKS, ROLE_EVENTS, ROLE_WATCHLIST, ROLE_QUOTES) + """
SELECT 'stocks' AS "table", count(*) AS rows FROM stocks
UNION ALL SELECT 'premissa_hist', count(*) FROM events_log
UNION ALL SELECT 'watchlist', count(*) FROM watchlist
UNION ALL SELECT 'quotes', count(*) FROM quotes""")
register("distinct_keys", "SELECT DISTINCT l_partkey AS ticker FROM lineitem WHERE l_partkey IS NOT NULL")
register("watchlist_sorted", with_roles(ROLE_WATCHLIST) + " SELECT DISTINCT ticker FROM watchlist")
register("lookup_by_keys", with_roles(ROLE_EVENTS, ROLE_WATCHLIST, SQL_CURRENT) + """
SELECT ticker, event_time, round(ke, 6) AS ke, round(roe_t, 6) AS roe_t, ke_default FROM cur
WHERE CAST(ticker AS VARCHAR) IN (SELECT upper(CAST(ticker AS VARCHAR)) FROM watchlist)""")


def _screener_shape() -> str:
    scr = ORACLE_SQL["screener"]
    body = scr.split("SELECT ticker, nome, monitored, round(lpa, 6)")[0]
    return body + """
SELECT e.ticker, e.nome, e.monitored, round(e.lpa, 6) AS lpa, round(e.roe_i, 6) AS roe_i,
       round(e.payout_i, 6) AS payout_i, round(e.ke, 6) AS ke, round(e.roe_t, 6) AS roe_t,
       round(e.payout_t, 6) AS payout_t, round(e.fade, 6) AS fade, e.growth_mode, round(e.g_i, 6) AS g_i,
       round(e.g_t, 6) AS g_t, round(e.fut_pe, 6) AS fut_pe, round(e.mos, 6) AS mos, round(p.price, 6) AS price,
       p.price_source AS fonte_preco
FROM eff e JOIN prices p ON p.ticker = e.ticker"""


register("screener_shape", _screener_shape())

# --- scalar function demos, sources, streams ------------------------------------------------------
register("ticker_symbol", """
SELECT p_partkey, upper(lower(substr(p_type, 1, 4)) || CAST(p_size AS VARCHAR)) || '.SA' AS symbol,
       regexp_replace(upper(lower(substr(p_type, 1, 4)) || CAST(p_size AS VARCHAR)) || '.SA', '\\.SA$', '') AS ticker
FROM part""")
register("numeric_guard", """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k_num,
       TRY_CAST(event_type AS DOUBLE) AS junk FROM events""")
register("json_double_decode", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
register("falsy_coalesce", with_roles(IND) + """
SELECT ticker, round(coalesce(nullif(CAST(floor(dy) AS DOUBLE), 0), nullif(p_vp, 0)), 6) AS num,
       coalesce(nullif(listing, ''), nullif(controle, '')) AS txt FROM ind""")
register("tags_json", with_roles(IND) + f"""
SELECT ticker, CAST(to_json({tags_sql('dy', 'p_l', 'p_vp', 'roe', 'dividaliquidaebit', 'lpa', 'valormercado')}) AS VARCHAR)
         AS tags_text,
       len({tags_sql('dy', 'p_l', 'p_vp', 'roe', 'dividaliquidaebit', 'lpa', 'valormercado')}) AS n_tags FROM ind""")


def _fmt() -> str:
    s = ddm_sql("lpa", "payout", "g1", "ke", "gp")
    return with_roles(ROLE_STOCKS) + f"""
SELECT ticker, 'R$ ' || translate(format('{{:,.2f}}', {s['fair']}), ',.', '.,') AS fair_text,
       translate(format('{{:,.0f}}', payout * 100.0), ',.', '.,') || '%' AS payout_pct,
       translate(format('{{:,.1f}}', ke * 100.0), ',.', '.,') AS ke_dec
FROM stocks"""


register("format_ptbr", _fmt())
register("filing_filter", """
SELECT p_partkey, p_brand, p_size FROM part
WHERE p_type = 'PROMO' AND p_size IN (1, 2, 3, 4, 5, 6, 7, 8, 9, 10) AND starts_with(p_brand, 'Brand#1')""")
register("accent_insensitive_filter", f"""
SELECT doc_id FROM documents
WHERE contains(lower({fold_sql('text')}), 'eeau') OR contains(lower({fold_sql('text')}), 'coue')""")
register("src_csv_roundtrip", "SELECT CAST(p_partkey AS VARCHAR) AS ticker, p_name AS empresa FROM part")
register("src_registry_csv", ORACLE_SQL["clean_registry_sector"])
register("src_quote_snapshot", """
SELECT CAST(c_custkey AS VARCHAR) AS stock, round(c_acctbal / 100.0, 6) AS close,
       round(c_acctbal * 2e6, 6) AS market_cap FROM customer""")
register("src_indicator_json", with_roles(IND) + """
SELECT CAST(ticker AS VARCHAR) AS ticker, sectorname, round(dy, 6) AS dy, round(p_l, 6) AS p_l,
       round(valormercado, 6) AS valormercado FROM ind""")
register("chart_arrays_to_rows", with_roles(ROLE_QUOTES) + """
SELECT CAST(ticker AS VARCHAR) AS ticker, (epoch_us(ts) // 1000000) * 1000 AS ts_ms,
       floor(close * 100.0 + 0.5) / 100.0 AS close FROM quotes WHERE close IS NOT NULL""")
register("wide_quotes_unpivot", """
WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type, arg_max(CASE WHEN event_type <> 'error' THEN value END, ts) AS c
           FROM events GROUP BY 1, 2)
SELECT event_type AS ticker, floor(arg_max(c, day) * 100.0 + 0.5) / 100.0 AS price
FROM d WHERE c IS NOT NULL GROUP BY event_type""")
register("universe_write_read", with_roles(ROLE_SEED) + """
SELECT ticker, nome, [setor, segmento] AS tags, round(lpa, 6) AS lpa, round(payout, 6) AS payout, monitored FROM seed""")
register("stream_latest_quote", with_roles(ROLE_QUOTES) + """
SELECT ticker, floor(arg_max(close, ts) * 100.0 + 0.5) / 100.0 AS price, max(ts) AS last_ts
FROM quotes WHERE close IS NOT NULL AND NOT isnan(close) GROUP BY ticker""")
register("stream_assumption_state", with_roles(ROLE_EVENTS, SQL_CURRENT) + f"""
SELECT ticker, {_acols()} FROM cur""")



register("ddm_sql_function", with_roles(ROLE_STOCKS) + f"""
SELECT ticker, round({ddm_sql('lpa', 'payout', 'g1', 'ke', 'gp')['fair']}, 6) AS fair FROM stocks""")
def _ledger_row(n: int) -> str:
    """Year n with the products taken year by year, as the ledger takes them."""
    dividend = [f"lpa * payout{' * (1.0 + g1)' * i}" for i in range(n + 1)]
    pv = [f"({dividend[i]}) / pow(1.0 + ke, {i}.0)" for i in range(1, n + 1)]
    return (f"SELECT ticker, {n}::BIGINT AS n, {dividend[n]} AS dividend, {f'pow(1.0 + ke, {n}.0)' if n else 'NULL::DOUBLE'} AS factor, "
            f"{pv[-1] if n else 'NULL::DOUBLE'} AS pv, {' + '.join(pv) if n else '0.0::DOUBLE'} AS pv_sum FROM stocks")


register("ddm_ledger_function", with_roles(ROLE_STOCKS) + f"""
SELECT ticker, n, round(dividend, 6) AS dividend, round(factor, 6) AS factor, round(pv, 6) AS pv, round(pv_sum, 6) AS pv_sum
FROM ({" UNION ALL ".join(_ledger_row(n) for n in range(6))})""")
# One stock of EPS 1 over every point of the four sliders; the others are its multiples.
register("ddm_what_if_summary", with_roles(ROLE_STOCKS) + f"""
, pts AS (SELECT p.i / 100.0::DOUBLE AS payout, g.i * 0.5::DOUBLE / 100.0 AS g1, (6 + k.i * 0.5::DOUBLE) / 100.0 AS ke, q.i * 0.5::DOUBLE / 100.0 AS gp
          FROM range(0, 101) p(i), range(0, 41) g(i), range(0, 39) k(i), range(0, 21) q(i))
, one AS (SELECT {ddm_sql('1.0::DOUBLE', 'payout', 'g1', 'ke', 'gp')['fair']} AS fair, ke > gp AS valid FROM pts)
, u AS (SELECT count(*) AS n_points, count(*) FILTER (WHERE valid) AS n_valid, min(fair) FILTER (WHERE valid) AS lo,
               quantile_cont(fair, 0.5) FILTER (WHERE valid) AS mid, max(fair) FILTER (WHERE valid) AS hi FROM one)
SELECT ticker, n_points, CASE WHEN lpa IS NULL THEN 0 ELSE n_valid END AS n_valid,
       round(CASE WHEN lpa IS NULL THEN 0 ELSE n_valid / n_points END, 6) AS share_valid,
       round(least(lpa * lo, lpa * hi), 6) AS min_fair, round(lpa * mid, 6) AS median_fair, round(greatest(lpa * lo, lpa * hi), 6) AS max_fair
FROM stocks, u""")
register("config_defaults", with_roles(ROLE_CONFIG) + """
, cur AS (SELECT k, v FROM config WHERE v IS NOT NULL)
SELECT k, round(v, 6) AS v FROM cur
UNION ALL SELECT k, v FROM (VALUES ('ke_global', 0.14::DOUBLE), ('roet_global', 0.12::DOUBLE),
                                  ('payoutt_global', 0.60::DOUBLE), ('fade_global', 10.0::DOUBLE)) t(k, v)
WHERE k NOT IN (SELECT k FROM cur)""")
register("assumption_history_one", """
SELECT user_id AS ticker, event_id AS id, value FROM events WHERE user_id = 7 ORDER BY event_id DESC LIMIT 40""")
register("history_series_daily", with_roles(ROLE_QUOTES) + """
, pts AS (SELECT ticker, epoch_us(ts) // 1000 AS ts_ms, floor(close * 100.0 + 0.5) / 100.0 AS close FROM quotes
          WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 MONTH AND ts <= (SELECT max(ts) FROM events)
            AND close IS NOT NULL AND NOT isnan(close))
, daily AS (SELECT ticker, arg_max(ts_ms, ts_ms) AS ts_ms, arg_max(close, ts_ms) AS close FROM pts
            GROUP BY ticker, ts_ms // 86400000)
SELECT ticker, list([CAST(ts_ms AS DOUBLE), close] ORDER BY ts_ms) AS series FROM daily GROUP BY ticker""")

_TIE = "(o_orderkey % 100000 - 50000) / 8.0"


def _tie_text(places: int) -> str:
    """Eighths times a power of ten are exact, so half away from zero is exact as well."""
    scale = 10.0 ** places
    x = f"CAST({_TIE} AS DOUBLE)"
    up = f"sign({x}) * floor(abs({x}) * {scale} + 0.5) / {scale}"
    return f"translate(format('{{:,.{places}f}}', {up}), ',.', '.,')"


register("format_number_ties", f"""
SELECT o_orderkey, {_tie_text(0)} AS p0, {_tie_text(1)} AS p1, {_tie_text(2)} AS p2, {_tie_text(0)} || '%' AS pct0,
       regexp_replace({_tie_text(1)}, ',0$', '') || '%' AS pct1 FROM orders""")
register("src_meta_json", """
SELECT CAST(p_partkey AS VARCHAR) AS ticker, p_name AS nome, p_type AS setor, p_brand || '|' || p_type AS tags,
       p_size > 25 AS monitored, round(p_size / 100.0, 6) AS g1, round(p_retailprice, 6) AS lpa, true AS no_gov FROM part""")
register("message_cut", "SELECT doc_id, left(text, 120) AS m120, left(text, 80) AS m80 FROM documents")
