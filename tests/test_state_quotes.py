import pytest
from pyspark.sql import functions as F

from valorum.operators import quality as qa
from valorum.operators import quotes as qt
from valorum.operators import state as st
from valorum.operators import latest as lt

STOCK_DDL = ("ticker string, nome string, setor string, modelo string, tags string, cd_cvm string, lpa double, "
             "monitored int, user int")
SEED_DDL = "ticker string, nome string, setor string, modelo string, tags string, cd_cvm string, lpa double, monitored int"


def test_merge_seed_keeps_user_columns_and_skips_vetoed(spark):
    cur = spark.createDataFrame([("PETR4", "Petro (edit)", "Energia*", "Gordon", "[\"x\"]", "1", 4.0, 1, 0),
                                 ("MINE3", "Mine", "Mine", "DDM", "[]", None, 1.0, 0, 1)], STOCK_DDL)
    seed = spark.createDataFrame([("PETR4", "Petrobras", "Petróleo", "DDM", "[]", "9512", 5.0, 0),
                                  ("MINE3", "Mine SA", "Outro", "DDM", "[]", "77", 2.0, 1),
                                  ("VALE3", "Vale", "Mineração", "DDM", "[]", "4170", 6.0, 0),
                                  ("OIBR3", "Oi", "Telecom", "DDM", "[]", "11312", 0.1, 0)], SEED_DDL)
    removed = spark.createDataFrame([("OIBR3",)], "ticker string")
    got = {r.ticker: r for r in st.merge_seed(cur, seed, removed).collect()}
    assert set(got) == {"PETR4", "MINE3", "VALE3"}
    p = got["PETR4"]
    assert (p.nome, p.setor, p.modelo, p.tags) == ("Petro (edit)", "Energia*", "Gordon", "[\"x\"]")
    assert (p.cd_cvm, p.lpa, p.monitored, p.user) == ("9512", 5.0, 0, 0)
    m = got["MINE3"]  # user-added ticker also in the seed: refreshed too (Q9)
    assert (m.nome, m.lpa, m.cd_cvm, m.user) == ("Mine", 2.0, "77", 1)
    assert got["VALE3"].user == 0 and got["VALE3"].nome == "Vale"


def test_upsert_is_idempotent_and_equals_log_replay(spark):
    log = spark.createDataFrame([("a", 1, 1.0), ("a", 3, 3.0), ("b", 2, 2.0), ("c", 5, 5.0), ("a", 4, 4.0)],
                                "ticker string, t int, v double")
    first = log.where("t <= 2")
    cur = lt.latest_per_key(first, "ticker", ["t"])
    changes = log.where("t > 2")
    once = st.upsert_latest(cur, changes, "ticker", ["t"])
    twice = st.upsert_latest(once, changes, "ticker", ["t"])
    replay = lt.latest_per_key(log, "ticker", ["t"])
    norm = lambda df: sorted(tuple(r) for r in df.select("ticker", "t", "v").collect())
    assert norm(once) == norm(twice) == norm(replay)


def test_late_change_does_not_replace_a_newer_row(spark):
    cur = spark.createDataFrame([("A", 5, "cur"), ("B", 5, "cur")], "ticker string, t int, v string")
    ch = spark.createDataFrame([("A", 3, "late"), ("B", 5, "same"), ("C", 1, "new")], "ticker string, t int, v string")
    assert sorted(r.v for r in st.upsert_latest(cur, ch, "ticker", ["t"]).collect()) == ["cur", "new", "same"]
    untimed = st.upsert_latest(cur.drop("t"), ch, "ticker", ["t"])
    assert sorted(r.v for r in untimed.collect()) == ["late", "new", "same"]


def test_insert_ignore_first_wins(spark):
    cur = spark.createDataFrame([("k1", 1.0)], "k string, v double")
    ch = spark.createDataFrame([("k1", 9.0, 1), ("k2", 2.0, 2), ("k2", 3.0, 1)], "k string, v double, o int")
    got = sorted(tuple(r) for r in st.insert_ignore(cur, ch, "k", order_by=["o"]).collect())
    assert got == [("k1", 1.0), ("k2", 3.0)]


PATCH_DDL = "ticker string, t int, fields map<string,string>"


def test_patch_blank_for_null_and_statuses(spark):
    cur = spark.createDataFrame([("A", "n", "s")], "ticker string, nome string, setor string")
    ch = spark.createDataFrame([("A", 1, {"nome": None, "cd_cvm": "x"}), ("Z", 1, {"setor": "y"}), ("A2", 1, {"bogus": "1"}),
                                ("A", 2, None)], PATCH_DDL)
    nxt, status = st.patch_columns(cur, ch, order_by=["t"])
    assert [tuple(r) for r in nxt.collect()] == [("A", "", "s")]
    assert {(r.ticker, r.t): r.status for r in status.collect()} == {
        ("A", 1): "ok", ("Z", 1): "ticker não encontrado", ("A2", 1): "nada para atualizar", ("A", 2): "nada para atualizar"}


def test_patches_of_one_key_apply_in_order(spark):
    cur = spark.createDataFrame([("A", "n", "s"), ("B", "n", "s")], "ticker string, nome string, setor string")
    ch = spark.createDataFrame([("A", 1, {"nome": "N1"}), ("A", 2, {"setor": "S2"}), ("A", 3, {"bogus": "x"}),
                                ("B", 2, {"nome": "late"}), ("B", 1, {"nome": "early", "setor": "S1"})], PATCH_DDL)
    nxt, status = st.patch_columns(cur, ch, order_by=["t"])
    assert sorted(tuple(r) for r in nxt.collect()) == [("A", "N1", "S2"), ("B", "late", "S1")]
    assert status.count() == 5
    with pytest.raises(ValueError):
        st.patch_columns(cur, ch)


def test_cascade_delete_then_readd_clears_tombstone(spark):
    stocks = spark.createDataFrame([("A",), ("B",)], "ticker string")
    wl = spark.createDataFrame([("A",)], "ticker string")
    keys = spark.createDataFrame([("A",)], "ticker string")
    tomb = spark.createDataFrame([], "ticker string")
    out = st.cascade_delete({"stocks": stocks, "watchlist": wl}, keys, tomb)
    assert [r.ticker for r in out["stocks"].collect()] == ["B"]
    assert out["watchlist"].count() == 0
    assert [r.ticker for r in out["removed"].collect()] == ["A"]
    assert st.clear_tombstones(out["removed"], keys).count() == 0


def test_add_entities_statuses_and_defaults(spark):
    cur = spark.createDataFrame([("PETR4", "Petro", "DDM", 1)], "ticker string, nome string, modelo string, user int")
    req = spark.createDataFrame([("PETR4", "x", 1), ("NEW3", "Nova", 2), ("BAD3", "", 3), (None, "y", 4)],
                                "ticker string, nome string, n int")
    nxt, status, left = st.add_entities(cur, req, {"modelo": "DDM · 2 est.", "user": 1}, order_by=["n"])
    assert left is None
    assert {r.ticker: r.status for r in status.collect()} == {
        "PETR4": "duplicate", "NEW3": "inserted", "BAD3": "invalid", None: "invalid"}
    new = [r for r in nxt.collect() if r.ticker == "NEW3"][0]
    assert (new.modelo, new.user) == ("DDM · 2 est.", 1)


def test_repeated_requests_in_one_batch_insert_once(spark):
    cur = spark.createDataFrame([("P", "Petro")], "ticker string, nome string")
    req = spark.createDataFrame([("new", "third", 3), ("NEW", "first", 1), ("NEW", "second", 2), ("p", "again", 4), ("NEW", "", 0)],
                                "ticker string, nome string, n int")
    tomb = spark.createDataFrame([("NEW",), ("P",), ("GONE",)], "ticker string")
    nxt, status, left = st.add_entities(cur, req, {}, order_by=["n"], tombstones=tomb)
    assert {r.n: (r.ticker, r.status) for r in status.collect()} == {
        0: ("NEW", "invalid"), 1: ("NEW", "inserted"), 2: ("NEW", "duplicate"), 3: ("NEW", "duplicate"), 4: ("P", "duplicate")}
    assert sorted(tuple(r) for r in nxt.collect()) == [("NEW", "first"), ("P", "Petro")]
    assert sorted(r.ticker for r in left.collect()) == ["GONE", "P"]


def test_evolve_schema_adds_defaults(spark):
    from pyspark.sql.types import _parse_datatype_string
    df = spark.createDataFrame([("A", 1)], "ticker string, ke_default int")
    out = st.evolve_schema(df, _parse_datatype_string("ticker string, ke_default int, growth_mode string, mos double"),
                           {"growth_mode": "roe"}).first()
    assert tuple(out) == ("A", 1, "roe", None)


def test_validate_positions(spark):
    pos = spark.createDataFrame([("A", "10", "5"), ("B", "0", "5"), ("C", "3", "-1"), ("D", "abc", "1"),
                                 ("E", "1", "Infinity")], "ticker string, quantidade string, preco_medio string")
    acc, rej = qa.validate(pos, qa.position_rules())
    assert [r.ticker for r in acc.collect()] == ["A"]
    errs = {r.ticker: r.errors for r in rej.collect()}
    assert errs == {"B": ["quantity_positive"], "C": ["price_non_negative"],
                    "D": ["quantity_finite", "quantity_positive"], "E": ["price_finite"]}


def test_validate_repeated_keys(spark):
    pos = spark.createDataFrame([("A", -1.0, 1), ("A", 2.0, 2), ("A", 3.0, 3), ("B", 1.0, 9)], "ticker string, q double, n int")
    acc, rej = qa.validate(pos, [("positive", F.col("q") > 0)], unique="ticker", order_by=["n"])
    assert sorted((r.ticker, r.n) for r in acc.collect()) == [("A", 2), ("B", 9)]
    assert sorted((r.n, r.errors) for r in rej.collect()) == [(1, ["positive"]), (3, ["duplicate_key"])]


# --- quotes --------------------------------------------------------------------------------------------
QUOTES_DDL = "ticker string, ts timestamp_ntz, close double"


def _quotes(spark, rows):
    from datetime import datetime
    return spark.createDataFrame([(t, datetime.fromisoformat(ts), c) for t, ts, c in rows], QUOTES_DDL)


def test_latest_quote_skips_trailing_nulls_and_lookback(spark):
    q = _quotes(spark, [("A", "2024-01-29 10:00:00", 10.004), ("A", "2024-01-30 10:00:00", None),
                        ("B", "2024-01-29 10:00:00", None), ("C", "2024-01-01 10:00:00", 5.0),
                        ("D", "2024-01-30 10:00:00", 1.005)])
    got = {r.ticker: r.price for r in qt.latest_quote(q, as_of="2024-01-31 00:00:00", range_str="5d").collect()}
    assert got == {"A": 10.0, "D": 1.0}  # B only nulls, C outside the window; cents like the browser


def test_price_fallback_ranked(spark):
    keys = spark.createDataFrame([("A",), ("B",), ("C",)], "ticker string")
    s1 = spark.createDataFrame([("A", 1.0), ("B", None)], "ticker string, price double")
    s2 = spark.createDataFrame([("A", 9.0), ("B", 2.0)], "ticker string, price double")
    got = {r.ticker: (r.price, r.price_source) for r in qt.price_fallback(keys, [("one", s1), ("two", s2)]).collect()}
    assert got == {"A": (1.0, "one"), "B": (2.0, "two"), "C": (None, "indisponível")}


def test_history_series_and_freshness(spark):
    q = _quotes(spark, [("A", "2024-01-30 23:50:00", 2.0), ("A", "2024-01-30 23:40:00", 1.0),
                        ("A", "2024-01-30 23:55:00", None)])
    rows = qt.history_series(q, as_of="2024-01-31 00:00:00", range_str="5d").collect()
    assert [(r.ts_ms, r.close) for r in rows] == [(1706658000000, 1.0), (1706658600000, 2.0)]
    arr = qt.history_series(q, as_of="2024-01-31 00:00:00", range_str="5d", as_array=True).first().series
    assert arr == [[1706658600000.0, 2.0]]  # one point per day: the day's last close
    last = q.groupBy("ticker").agg(F.max("ts").alias("ts"))
    f = qt.quote_freshness(last, "ts", "2024-01-31 00:00:00", 900).first()
    assert f.age_s == 300.0 and f.stale is False


def test_chart_rows_and_unpivot(spark):
    payload = spark.createDataFrame([("A", ([1, 2, 3], [1.004, None, 2.5]))],
                                    "ticker string, result struct<timestamp:array<bigint>,close:array<double>>")
    assert [(r.ts_ms, r.close) for r in qt.chart_rows(payload).collect()] == [(1000, 1.0), (3000, 2.5)]
    wide = spark.createDataFrame([(1, 1.0, None), (2, None, 3.0)], "ts int, A double, B double")
    got = sorted(tuple(r) for r in qt.unpivot_quotes(wide).where("close IS NOT NULL").collect())
    assert got == [(1, "A", 1.0), (2, "B", 3.0)]


def test_lookback_ranges():
    with pytest.raises(ValueError):
        qt.lookback_start("2024-01-31 00:00:00", "5x")
    assert qt.lookback_start("2024-01-31 00:00:00", "max") is None


def test_look_back_prunes_the_days(spark, tmp_path):
    rows = [(t, f"2024-01-{d:02d} {h:02d}:00:00", float(d * 100 + h)) for t in "AB" for d in range(1, 29) for h in (0, 12, 23)]
    q = _quotes(spark, rows).unionByName(spark.createDataFrame([("N", None, 1.0)], QUOTES_DDL))
    path = str(tmp_path / "quotes")
    qt.write_by_day(q, path)
    stored = spark.read.parquet(path)
    as_of = qt.newest_time(stored)
    got = qt.history_lookback(stored, "ts", as_of, "5d", day="day")
    assert sorted(r.close for r in got.where("ticker = 'A'").collect()) == sorted(c for t, ts, c in rows if t == "A" and ts >= "2024-01-23 23:00:00")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "PartitionFilters: []" in plan  # the look-back's scan, the subquery's
    latest = qt.latest_quote(stored, as_of=as_of, range_str="1d", day="day")
    assert {r.ticker: (r.price, str(r.last_ts)) for r in latest.collect()} == {k: (2823.0, "2024-01-28 23:00:00") for k in "AB"}
    # Only the folders of the look-back are read.
    files = got.select("_metadata.file_path").distinct().collect()
    assert {r.file_path.split("day=")[1][:10] for r in files} == {f"2024-01-{d}" for d in (23, 24, 25, 26, 27, 28)}
    plain = qt.history_lookback(q, "ts", "2024-01-28 23:00:00", "5d")
    assert plain.count() == got.count()
    empty = qt.history_lookback(q.limit(0), "ts", qt.newest_time(q.limit(0)), "5d")
    assert empty.count() == 0
