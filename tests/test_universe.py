import random

from pyspark.sql import functions as F

from valorum.operators import fundamentals as fund
from valorum.operators import latest as lt
from valorum.operators import universe as uv
from valorum.plans import catalog

IND_DDL = ("ticker string, sectorname string, subsectorname string, segmentname string, dy double, p_l double, "
           "p_vp double, receitas_cagr5 double, roe double, dividaliquidaebit double, lpa double, valormercado double, "
           "liquidezmediadiaria double")


def test_universe_rows(spark):
    tickers = spark.createDataFrame([("T1", "Banco Alfa S.A."), ("T2", "Beta Gama Delta Zeta"), ("T3", "Sem Par")],
                                    "ticker string, empresa string")
    companies = spark.createDataFrame([("C1", "Banco Alfa S.A.", 2023), ("C2", "Beta Gama Delta Zeta Epsilon", 2022)],
                                      "cd_cvm string, empresa string, ultimo_ano int")
    figures = spark.createDataFrame([("C1", 150.0, 1000.0, 0.5, 2022, 2023), ("C2", 3.456, -5.0, 1.0, 2023, 2023)],
                                    "cd_cvm string, eps double, net_income_units double, dividends double, income_year int, dividends_year int")
    reg = spark.createDataFrame([("C1", "Estatal", '{"market": "NOVO MERCADO"}'), ("C2", None, '"{\\"market\\": \\"Nível 2\\"}"')],
                                "cd_cvm string, ctrl string, payload string")
    facts = uv.company_facts(figures, reg)
    # Income of 2022 and dividends of 2023 are not set against each other if the years must agree.
    assert {r.cd_cvm: r.payout_calc for r in uv.company_facts(figures, reg, require_same_year=True).collect()} == {"C1": None, "C2": None}
    same = figures.withColumn("income_year", F.lit(2023))
    assert {r.cd_cvm: r.payout_calc for r in uv.company_facts(same, reg, require_same_year=True).collect()} == {"C1": 0.5, "C2": None}
    ind = spark.createDataFrame([("T1", "Financeiro e Outros", "Bancos", "Bancos", 9.0, 5.0, 0.9, 3.0, 18.0, None, 2.34,
                                  0.0, 12345.5)], IND_DDL)
    snap = spark.createDataFrame([("T1", 3e9), ("T2", 2e10)], "ticker string, market_cap double")
    rows = {r.ticker: r for r in uv.build_universe(tickers, companies, facts, ind, snap).collect()}
    t1, t2, t3 = rows["T1"], rows["T2"], rows["T3"]
    assert (t1.cd_cvm, t1.how, t2.cd_cvm, t2.how, t3.cd_cvm, t3.how) == (
        "C1", "exato", "C2", "token 0.80", None, "SEM MATCH")
    # EPS 150 is implausible -> the indicator's EPS; C2's EPS is used (3.456 -> 3.46)
    assert (t1.lpa, t2.lpa, t3.lpa) == (2.34, 3.46, None)
    # payout: 0.5 * 1000 / 1000; negative income -> default; no match -> default
    assert (t1.payout, t2.payout, t3.payout) == (0.5, 0.45, 0.45)
    assert (t1.setor, t1.subsetor, t1.perfil) == ("Financeiro", "Bancos", "Dividendos")
    assert t1.tags == ["Alta DY", "Barata", "Qualidade"]
    assert (t2.setor, t2.perfil, t2.tags) == ("", "", [])
    # market cap 0 in the indicators -> the snapshot's; no indicators -> the snapshot's
    assert (t1.tamanho, t2.tamanho, t3.tamanho) == ("Mid cap", "Large cap", "")
    assert (t1.gov, t1.ctrl, t2.gov, t2.ctrl) == ("Novo Mercado", "Estatal", "Nível 2", "")
    assert (t1.roe_i, t2.roe_i) == (0.18, 0.15)
    assert t1.liquidez == 12346.0 and t2.liquidez is None  # Python's round: half to even
    assert (t1.modelo, t1.monitored, t1.g1, t1.ke, t1.gp) == ("DDM · 2 est.", False, 0.06, 0.14, 0.04)


FILINGS = "cd string, year int, account string, klass string, value double, scale string, doc long"


def _filings(spark, n=600):
    rng = random.Random(4)
    rows = [(f"C{rng.randrange(40)}" if rng.random() > 0.02 else None, rng.choice([2019, 2020, 2021, None]), rng.choice(["E", "I", "D"]),
             rng.choice(["ON", "PN", "PNB", "XX"]), rng.choice([None, 0.0, 1.5, -1.5, 2.25, -7.0]), rng.choice(["MIL", "UN", None]), i) for i in range(n)]
    return spark.createDataFrame(rows, FILINGS)


def test_filing_figures_equal_the_single_operators(spark):
    f = _filings(spark)
    is_ = lambda a: F.col("account") == a
    got = fund.filing_figures(f, "cd", "year", ("doc",), eps_where=is_("E") & F.col("klass").isin(*fund.EPS_SHARE_CLASSES),
                              eps_value=F.col("value"), eps_class="klass", eps_preferred="ON", income_where=is_("I") & F.col("klass").isin("ON", "PN"),
                              income_value=F.col("value"), income_account="klass", income_preferred="PN", scale="scale",
                              dividend_where=is_("D"), dividend_value=F.col("value"))
    by = {r.cd: r.asDict() for r in got.collect()}
    assert set(by) == {r.cd for r in f.select("cd").distinct().collect()}
    eps = {r.cd: r for r in fund.latest_eps(f.where(is_("E")), "cd", "year", "value", "klass", tie_break=("doc",)).collect()}
    ni = {r.cd: r for r in fund.latest_net_income(f.where(is_("I")), "cd", "year", "value", "klass", "scale", preferred="PN",
                                                  accounts=("ON", "PN"), tie_break=("doc",)).collect()}
    div = {r.cd: r.dividends for r in fund.latest_year_dividends(fund.dividends_by_year(f.where(is_("D")), "cd", "year", "value"), "cd").collect()}
    for k, r in by.items():
        assert (r["eps"], r["eps_year"]) == ((eps[k].eps, eps[k].year) if k in eps else (None, None)), k
        assert (r["net_income"], r["scale"], r["income_year"], r["net_income_units"]) == (
            (ni[k].net_income, ni[k].scale, ni[k].year, ni[k].net_income_units) if k in ni else (None,) * 4), k
        assert r["dividends"] == div.get(k), k


def test_filings_are_scanned_and_shuffled_once(spark, tmp_path):
    _filings(spark).write.parquet(str(tmp_path / "f"))
    f = spark.read.parquet(str(tmp_path / "f")).withColumnRenamed("cd", "entity").withColumn("scope", F.lit("F"))
    f = f.withColumns({"l_orderkey": F.col("doc"), "l_linenumber": F.lit(1)})
    plan = catalog._figures(f, "entity", F.col("value"), F.col("value"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 2 and "Window" not in plan  # filings, then an entity's years
    universe = catalog._universe(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert universe.count("l_linestatus#") and universe.count("FileScan parquet [l_orderkey") <= 1


def test_names_are_exchanged_once(spark):
    """Names used to travel by ticker, by company code (all unmatched in one task) and by ticker again, 3 times their size on disk."""
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        universe = catalog._universe(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", text)
    exchanges = []

    def walk(node):
        if node.nodeName() == "Exchange":
            exchanges.append(node.output().mkString(","))
        for i in range(node.children().size()):
            walk(node.children().apply(i))
    walk(universe.initialPlan() if universe.nodeName() == "AdaptiveSparkPlan" else universe)
    assert sum("empresa#" in e for e in exchanges) == 1 and len(exchanges) > 3


def test_payout_of_the_same_year_and_row_scales(spark):
    income = spark.createDataFrame([("A", 2021, 100.0), ("B", 2020, 50.0), ("C", 2021, None), ("E", 2021, 1e6)], "k string, year int, net_income_units double")
    paid = spark.createDataFrame([("A", 2021, 30.0, "UN"), ("A", 2022, 90.0, "UN"), ("B", 2021, 10.0, "UN"), ("D", 2021, 1.0, "UN"),
                                  ("E", 2021, 0.2, "MIL"), ("E", 2021, 40.0, "UN")], "k string, year int, value double, scale string")
    by_year = fund.dividends_by_year(paid, "k", "year", "value", "scale")
    got = {r.k: (r.dividends, r.payout_raw, r.payout) for r in fund.payout_ratio(income, by_year, "k", 1.0, require_same_year=True).collect()}
    assert got == {"A": (30.0, 0.3, 0.3), "B": (None, None, 0.45), "C": (None, None, 0.45), "D": (None, None, 0.45), "E": (240.0, 0.0, 0.0)}
    latest = fund.latest_year_dividends(by_year, "k").withColumn("unit", F.when(F.col("k") == "A", 0.5).otherwise(1.0))
    scaled = {r.k: r.payout for r in fund.payout_ratio(income, latest, "k", F.col("unit")).collect()}
    assert scaled["A"] == 0.45 and scaled["B"] == 0.2  # A: 90 * 0.5 / 100


def test_report_comes_from_the_rows_as_they_are_written(spark, tmp_path):
    rows = [(f"T{i:02d}", None if i % 3 == 0 else f"C{i}", float(i) if i % 2 else None, "Novo" if i % 5 == 0 else "") for i in range(30)]
    u = spark.createDataFrame(rows, "ticker string, cd_cvm string, lpa double, gov string").repartition(5)
    path, report = uv.write_universe(u, str(tmp_path / "u"), spot_check=("T01", "T02", "zz"))
    r = report.first()
    assert (r.total, r.matched, r.with_lpa, r.no_match, r.gov_filled, r.spot_found) == (30, 20, 15, 10, 6, 2)
    assert r.unmatched_sample == [f"T{i:02d}" for i in range(0, 24, 3)]
    assert spark.read.parquet(path).count() == 30
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ticker:string,cd_cvm:string>" in plan
    empty = uv.write_universe(u.limit(0), str(tmp_path / "e"))[1].first()
    assert (empty.total, empty.unmatched_sample) == (0, [])


def test_order_struct_equals_the_window(spark):
    rng = random.Random(9)
    top = (1 << 63) - 1
    rows = [(rng.choice("abcd"), rng.choice([None, 1, 2, -1, top, -top - 1]), rng.choice([None, 0.5, -0.5, float("nan"), float("inf")]),
             rng.choice([None, True, False]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i long, x double, b boolean, id long")
    df = df.withColumns({"t": F.timestamp_micros(F.coalesce("i", F.lit(5)) % 1000).cast("timestamp_ntz"), "d": F.date_from_unix_date((F.col("id") % 7).cast("int"))})
    for order in (["i", "x", "id"], [("i", "asc"), ("x", "asc"), ("b", "asc"), ("id", "asc")], [("x", "asc"), ("d", "asc"), ("t", "desc"), "id"],
                  [("t", "asc"), ("b", "desc"), ("id", "asc")]):
        assert lt.order_struct(df, order) is not None
        want = lt.top_k_per_key(df, "k", order, 1, "r").select("k", "id").collect()
        assert sorted(lt.latest_per_key(df, "k", order).select("k", "id").collect()) == sorted(want), order
    assert lt.order_struct(df, [("k", "asc")]) is None
    assert lt.latest_per_key(df, "k", [("k", "asc"), "id"]).count() == 4
