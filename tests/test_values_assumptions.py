import pytest
from pyspark.sql import functions as F

from valorum.functions import values as fv
from valorum.operators import assumptions as asm
from valorum.operators import fundamentals as fund


def test_flag_override_null_flag_counts_as_default(spark):
    rows = [(None, None), (None, 0.2), (0, 0.2), (0, None), (1, 0.2)]
    df = spark.createDataFrame(rows, "flag int, v double")
    got = [r[0] for r in df.select(fv.flag_override("flag", "v", 0.14)).collect()]
    assert got == [0.14, 0.14, 0.2, 0.14, 0.14]


def test_config_wide_empty_and_null(spark):
    empty = spark.createDataFrame([], "k string, v double")
    r = asm.config_wide(empty).collect()
    assert len(r) == 1 and r[0].ke == 0.14 and r[0].fade == 10.0 and r[0].ke_mode == "nom"
    cfg = spark.createDataFrame([("ke_global", None), ("roet_global", 0.2), ("ke_mode_global", 1.0)], "k string, v double")
    r = asm.config_wide(cfg).first()
    assert r.ke == 0.14 and r.roet == 0.2 and r.ke_mode == "real" and r.ipca == 0.045


def test_config_long_skips_nulls(spark):
    ch = spark.createDataFrame([(0.15, None, "real")], "ke double, fade double, ke_mode string")
    got = sorted((r.k, r.v) for r in asm.config_long(ch).collect())
    assert got == [("ke_global", 0.15), ("ke_mode_global", 1.0)]


def test_effective_assumptions_rules(spark):
    stocks = spark.createDataFrame([(1, 2.0, 0.5, None, False), (2, 3.0, 0.4, 0.2, True), (3, 1.0, 0.3, 0.1, False)],
                                   "ticker int, lpa double, payout double, roe_i double, monitored boolean")
    cur = spark.createDataFrame(
        [(1, None, 0.3, None, 0.2, 0, 0.11, 1, 0.05, "", None),
         (2, 4.0, None, 0.6, 0.25, None, 0.09, 0, 0.07, "g", 0.1)],
        "ticker int, lpa double, roe_i double, payout_i double, ke double, ke_default int, roe_t double, "
        "roet_default int, g_t double, growth_mode string, g_i double")
    cfg = asm.config_wide(spark.createDataFrame([("roet_global", 0.10), ("payoutt_global", 0.5)], "k string, v double"))
    wl = spark.createDataFrame([], "ticker int")
    out = {r.ticker: r for r in asm.effective_assumptions(stocks, cur, cfg, watchlist=wl).collect()}
    a, b, c = out[1], out[2], out[3]
    assert (a.lpa, a.roe_i, a.payout_i) == (2.0, 0.3, 0.5)
    assert a.ke == 0.2  # flag 0 and value present
    assert a.roe_t == 0.10 and a.g_t == pytest.approx(0.05)  # flag 1 -> global; g_t shares the roe_t flag
    assert a.growth_mode == "roe"  # blank -> default
    assert (b.lpa, b.roe_i, b.payout_i) == (4.0, 0.2, 0.6)
    assert b.ke == 0.14  # NULL flag counts as "use default"
    assert b.roe_t == 0.09 and b.g_t == 0.07 and b.growth_mode == "g"
    assert c.roe_i == 0.1 and c.ke == 0.14 and c.g_t == pytest.approx(0.10 * 0.5)
    assert (a.monitored, b.monitored, c.monitored) == (False, True, False)  # empty watchlist -> own flag


def test_monitored_flag_watchlist_replaces_own_flag(spark):
    stocks = spark.createDataFrame([(1, True), (2, False)], "ticker int, monitored boolean")
    wl = spark.createDataFrame([(2,)], "ticker int")
    got = {r.ticker: r.monitored for r in asm.monitored_flag(stocks, wl).collect()}
    assert got == {1: False, 2: True}


def test_rounding_rules(spark):
    df = spark.createDataFrame([(2.675,), (4.015,), (1.005,), (0.125,), (-2.5,)], "x double")
    r = df.select(fv.round_half_up("x", 2).alias("u"), fv.round_half_even("x", 2).alias("e"),
                  fv.format_ptbr("x", 2).alias("t")).collect()
    # 4.015 * 100 is 401.49999999999994 in binary, as in the browser: 4.01
    assert [x.u for x in r] == [2.68, 4.01, 1.0, 0.13, -2.5]
    assert [x.e for x in r] == [2.67, 4.01, 1.0, 0.12, -2.5]
    assert [x.t for x in r] == ["2,67", "4,01", "1,00", "0,13", "-2,50"]


def test_format_thousands(spark):
    df = spark.createDataFrame([(1234567.891,)], "x double")
    assert df.select(fv.format_brl("x")).first()[0] == "R$ 1.234.567,89"


def test_eps_plausibility_and_fallback(spark):
    rows = [(None, 5.0), (0.0, 5.0), (100.0, 5.0), (100.01, 5.0), (-101.0, None), (-101.0, 0.0), (3.333, None),
            (None, 100.5)]
    df = spark.createDataFrame(rows, "p double, s double")
    got = [r[0] for r in df.select(fund.eps_with_fallback("p", "s")).collect()]
    assert got == [5.0, 5.0, 100.0, 5.0, None, None, 3.33, None]


def test_payout_rules(spark):
    inc = spark.createDataFrame([(1, 1000.0), (2, -5.0), (3, 10.0), (4, 0.0), (5, 100.0)],
                                "k int, net_income_units double")
    div = spark.createDataFrame([(1, 0.5), (2, 1.0), (3, 1.0), (4, 1.0), (5, 0.0), (6, 1.0)], "k int, dividends double")
    got = {r.k: r.payout for r in fund.payout_ratio(inc, div, "k").collect()}
    assert got == {1: 0.5, 2: 0.45, 3: 1.5, 4: 0.45, 5: 0.45, 6: 0.45}


def test_scale_units(spark):
    df = spark.createDataFrame([(2.0, "MIL"), (2.0, "UN"), (2.0, None)], "v double, s string")
    assert [r[0] for r in df.select(fv.scale_units("v", "s")).collect()] == [2000.0, 2.0, 2.0]


def test_numeric_guard_and_tags_json(spark):
    df = spark.createDataFrame([("12.5",), ("abc",), ("NaN",), (None,)], "s string")
    assert [r[0] for r in df.select(fv.numeric_guard("s")).collect()] == [12.5, None, None, None]
    t = spark.createDataFrame([('["Alta DY","Prejuízo"]',), ("",), (None,)], "s string")
    got = [r[0] for r in t.select(fv.tags_from_json("s")).collect()]
    assert got == [["Alta DY", "Prejuízo"], [], []]
    back = t.select(fv.tags_to_json(fv.tags_from_json("s"))).first()[0]
    assert back == '["Alta DY","Prejuízo"]'


def test_accent_insensitive_filter(spark):
    df = spark.createDataFrame([("Dividendos pagos",), ("JUROS SOBRE CAPITAL próprio",),
                                ("Juros sobre o capital",), ("Dívida",)], "s string")
    got = [r[0] for r in df.where(fund.contains_any_folded("s", fund.DIVIDEND_PATTERNS)).collect()]
    assert got == ["Dividendos pagos", "JUROS SOBRE CAPITAL próprio"]


def test_config_rejects_and_cut(spark):
    ch = spark.createDataFrame([("0.15", "12abc", None)], "ke string, roet string, fade string")
    assert [(r.k, r.v) for r in asm.config_long(ch).collect()] == [("ke_global", 0.15)]
    assert [(r.k, r.text) for r in asm.config_rejects(ch).collect()] == [("roet_global", "12abc")]
    from valorum.functions import text as tx
    df = spark.createDataFrame([("x" * 200,), ("short",)], "s string")
    assert [len(r[0]) for r in df.select(tx.cut("s", 120)).collect()] == [120, 5]


def test_format_ties_and_percent(spark):
    df = spark.createDataFrame([(12.5,), (2.5,), (-2.5,), (0.125,), (4.015,), (1234.0,), (None,)], "x double")
    got = df.select(fv.format_ptbr("x", 0), fv.format_ptbr("x", 2), fv.format_pct("x", 1), fv.format_pct("x")).collect()
    assert [r[0] for r in got] == ["13", "3", "-3", "0", "4", "1.234", None]
    assert [r[1] for r in got] == ["12,50", "2,50", "-2,50", "0,13", "4,01", "1.234,00", None]
    assert [r[2] for r in got] == ["12,5%", "2,5%", "-2,5%", "0,1%", "4%", "1.234%", None]
    assert [r[3] for r in got] == ["13%", "3%", "-3%", "0%", "4%", "1.234%", None]
