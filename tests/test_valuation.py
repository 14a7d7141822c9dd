import numpy as np
import pytest
from pyspark.sql import functions as F

from valorum.operators import valuation as val

GOLDEN = dict(lpa=4.24, payout=0.70, g1=0.10, ke=0.15, gp=0.06, price=30.50)


def _golden_df(spark, **over):
    row = dict(GOLDEN, **over)
    return spark.createDataFrame([(1, row["lpa"], row["payout"], row["g1"], row["ke"], row["gp"], row["price"])],
                                 "k int, eps double, payout double, g1 double, ke double, gp double, price double")


def test_golden_worked_example(spark):
    df = val.ddm_value(_golden_df(spark))
    df = df.withColumn("mos", val.margin_of_safety("fair", "price", "valid"))
    r = df.first()
    assert round(r.d0, 2) == 2.97
    assert round(r.pv_sum, 2) == 13.01
    assert round(r.d_next, 2) == 5.07
    assert round(r.terminal, 2) == 56.30
    assert round(r.terminal_pv, 2) == 27.99
    assert round(r.fair, 2) == 41.00
    assert r.valid is True
    assert round(r.mos, 1) == 34.4


@pytest.mark.parametrize("ke,gp", [(0.06, 0.06), (0.05, 0.08)])
def test_invalid_terminal_keeps_sum(spark, ke, gp):
    r = val.ddm_value(_golden_df(spark, ke=ke, gp=gp)).withColumn(
        "mos", val.margin_of_safety("fair", "price", "valid")).first()
    assert r.valid is False
    assert r.terminal is None and r.terminal_pv is None and r.fair_display is None
    assert r.fair == pytest.approx(r.pv_sum)
    assert r.mos is None


@pytest.mark.parametrize("price", [0.0, None])
def test_no_margin_without_price(spark, price):
    df = spark.createDataFrame([(41.0, price, True)], "fair double, price double, valid boolean")
    assert df.select(val.margin_of_safety("fair", "price", "valid").alias("m")).first().m is None


def test_ledger_sum_equals_value(spark):
    base = _golden_df(spark)
    led = val.ddm_ledger(base, "k")
    rows = sorted(led.collect(), key=lambda r: r.n)
    assert [r.n for r in rows] == [0, 1, 2, 3, 4, 5]
    assert rows[0].factor is None and rows[0].pv is None and round(rows[0].dividend, 2) == 2.97
    total = sum(r.pv for r in rows[1:])
    assert total == pytest.approx(val.ddm_value(base).first().pv_sum, rel=1e-12)


def test_steps_and_text(spark):
    steps = val.ddm_steps(val.ddm_value(_golden_df(spark)), "k").orderBy("step", "label").collect()
    texts = {r.label: r.text for r in steps}
    assert texts["fair value"] == "R$ 41,00"
    assert texts["base dividend"] == "R$ 2,97"
    assert texts["terminal value"] == "R$ 56,30"


def test_scenario_summary_counts(spark):
    s = val.scenario_summary(_golden_df(spark), "k").first()
    assert s.n_points == 819
    assert s.n_valid == 774
    long = val.ddm_scenarios(_golden_df(spark), "k")
    agg = long.where("valid").agg(F.min("fair").alias("mn"), F.max("fair").alias("mx"),
                                  F.expr("median(fair)").alias("md")).first()
    assert agg.mn == pytest.approx(s.min_fair) and agg.mx == pytest.approx(s.max_fair)
    assert agg.md == pytest.approx(s.median_fair)


def test_scenario_summary_compiles_each_point(spark):
    """No lambda for the points or for comparing them; nulls, zero and negative earnings as on the expanded grid."""
    stocks = spark.createDataFrame([("A", 4.24, 0.7, 0.1), ("B", -2.5, 0.5, 0.0), ("C", 0.0, 0.5, 0.2), ("D", None, 0.5, 0.1), ("E", 1.0, 0.5, None)],
                                   "k string, eps double, payout double, g1 double")
    rates, perpetuals = [0.06, 0.1, 0.0], [0.0, 0.03, 0.1]
    got = val.scenario_summary(stocks, "k", rates=rates, perpetuals=perpetuals)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "transform(" not in plan and "array_sort(" not in plan
    want = {}
    for r in val.ddm_scenarios(stocks, "k", rates=rates, perpetuals=perpetuals).where("valid").collect():
        want.setdefault(r.k, []).append(r.fair)
    for r in got.collect():
        v = sorted(want.get(r.k, []))
        assert (r.n_points, r.n_valid, r.min_fair, r.max_fair) == (9, len(v), v[0] if v else None, v[-1] if v else None)
        assert r.median_fair == (float(np.median(v)) if v else None) and r.share_valid == len(v) / 9
    assert sorted(want) == ["A", "B", "C"]
    assert val.scenario_summary(stocks, "k", rates=[0.0], perpetuals=[0.1]).first().n_valid == 0


def _expanded(spark, stocks, payouts, growths, rates, perpetuals):
    """The order statistics over the expanded grid of every stock."""
    axes = [("p", payouts), ("g", growths), ("k", rates), ("q", perpetuals)]
    df = stocks
    for name, values in axes:
        df = df.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    cols = val.ddm_columns(F.col("lpa"), F.col("p"), F.col("g"), F.col("k"), F.col("q"))
    df = df.withColumn("fair", F.when(F.col("k") > F.col("q"), cols["fair"]))
    return {r.ticker: tuple(r)[1:] for r in df.groupBy("ticker").agg(
        F.count(F.lit(1)), F.count("fair"), F.min("fair"), F.median("fair"), F.max("fair")).collect()}


@pytest.mark.parametrize("axes", [
    ([0.0, 0.3, 0.5, 1.0], [0.0, 0.05, 0.2], [0.06, 0.1, 0.25], [0.0, 0.06, 0.1]), ([0.7], [0.1], [0.15], [0.06]), ([0.2, 0.4], [-0.5, 0.0], [0.05], [0.0, 0.05]),
    ([0.0], [0.0, 0.1], [0.2], [0.1]), ([0.5, 0.6], [0.1], [0.05, 0.04], [0.05, 0.06])])
def test_what_if_equals_the_expanded_grid(spark, axes):
    stocks = spark.createDataFrame([("A", 4.24), ("B", -2.5), ("C", 0.0), ("D", None)], "ticker string, lpa double")
    want = _expanded(spark, stocks, *axes)
    df = val.what_if_summary(stocks, "ticker", "lpa", *axes)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Generate", "Join", "transform("))
    for r in df.collect():
        points, valid, low, middle, high = want[r.ticker]
        assert (r.n_points, r.n_valid) == (points, valid), r.ticker
        assert r.share_valid == pytest.approx(valid / points)
        for got, exact in ((r.min_fair, low), (r.median_fair, middle), (r.max_fair, high)):
            assert (got is None) == (exact is None) and (got is None or got == pytest.approx(exact, rel=1e-12, abs=1e-12)), r.ticker
    with pytest.raises(ValueError):
        val.what_if_summary(stocks, "ticker", "lpa", [-0.1])


def test_kth_product_equals_sorting():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (3, 50), (40, 7), (20, 20)):
        a, b = np.sort(np.round(rng.random(n), 2)), np.sort(np.round(rng.random(m) * 9, 2))
        every = np.sort((a[:, None] * b).ravel())
        assert [val.kth_product(a, b, k) for k in range(len(every))] == every.tolist()


def test_ledger_function_equals_the_ledger(spark):
    stocks = spark.createDataFrame([("A", 4.24, 0.7, 0.1, 0.15), ("B", None, 0.7, 0.1, 0.15), ("C", -1.0, 0.5, 0.0, 0.1), ("A", 1.0, 1.0, 0.0, 0.0)],
                                   "ticker string, lpa double, payout double, g1 double, ke double")
    stocks.createOrReplaceTempView("ledger_stocks")
    fn = val.register_ledger_function(spark)
    out = spark.sql(f"SELECT s.ticker, s.lpa, l.* FROM ledger_stocks s, LATERAL {fn}(s.lpa, s.payout, s.g1, s.ke) l")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Python" not in plan
    led = val.ddm_ledger(stocks, ["ticker", "lpa"], "lpa", "payout", "g1", "ke")
    rows = lambda df: sorted((tuple(r) for r in df.select("ticker", "lpa", "n", "dividend", "factor", "pv").collect()), key=str)
    assert rows(out) == rows(led)
    last = out.where("n = 5 AND lpa = 4.24").first()
    assert last.pv_sum == pytest.approx(13.01, abs=0.005)
    assert [r.n for r in spark.sql(f"SELECT n FROM {fn}(1D, 1D, 0D, 0.1D)").collect()] == [0, 1, 2, 3, 4, 5]
