import os

import pytest
from pyspark.sql import functions as F

from valorum.functions.text import fold_accents, fold_literal, fold_sql
from valorum.operators import quality as qa
from valorum.plans import catalog
from valorum.session import shared_path
from valorum.sources import buckets as bk

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_company_facts_over_buckets_need_no_exchange(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        facts = catalog.bucketed_facts(spark, SF)
        plan = _plan(facts)
        assert "Exchange" not in plan, plan
        assert plan.count("SelectedBucketsCount: 8 out of 8") == 2
        years = catalog._figure_years(catalog.roles.part_filings(spark, SF), "cd", F.col("value"), F.col("paid"), 4)
        assert "Exchange" in _plan(years)
        assert facts.count() == facts.select("cd_cvm").distinct().count() == spark.read.parquet(f"{SF}/part.parquet").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_buckets_keep_all_rows(spark):
    df = spark.createDataFrame([(k, i) for i, k in enumerate(["a", "b", None, "a", None, ""] * 5)], "k string, v int")
    path = shared_path(spark, "test-buckets")
    got = bk.write_buckets(df, "test_buckets", path, "k", 4)
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    assert len([f for f in os.listdir(path.removeprefix("file:")) if f.endswith(".parquet")]) <= 4
    assert bk.write_buckets(df.limit(0), "test_buckets_empty", path + "-empty", "k", 4).count() == 0
    with pytest.raises(ValueError):
        bk.write_buckets(df, "test_buckets_none", path + "-none", "k", 0)
    for t in ("test_buckets", "test_buckets_empty"):
        spark.sql(f"DROP TABLE {t}")


def test_lookup_upper_cases_the_request_only(spark):
    df = spark.createDataFrame([("PETR4", 1), ("petr4", 2), ("VALE3", 3), (None, 4), ("VALE3", 5)], "ticker string, v int")
    asked = spark.createDataFrame([("petr4",), ("PETR4",), (None,), ("none",)], "ticker string")
    assert [r.v for r in qa.lookup_by_keys(df, asked).collect()] == [1]
    assert sorted(r.v for r in qa.lookup_by_keys(df, ["petr4", "vale3", None]).collect()) == [1, 3, 5]
    assert [r.v for r in qa.lookup_by_keys(df, ["petr4"], upper=False).collect()] == [2]
    assert qa.lookup_by_keys(df, []).count() == 0
    parts = spark.read.parquet(f"{SF}/part.parquet")
    hit = qa.lookup_by_keys(parts, ["3", "x", 5], key="p_partkey")
    assert sorted(r.p_partkey for r in hit.collect()) == [3, 5]
    assert "PushedFilters: [In(p_partkey" in _plan(hit)


def test_fold_of_texts_with_a_ligature(spark):
    texts = ["a…b ½ ação ¼¨¯ ﬁm №7 ÀÉ", "ºª²µ… 日本", "plain", "", None, "…"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = [None if t is None else fold_literal(t) for t in texts]
    assert [r[0] for r in df.select(fold_accents("t")).collect()] == want
    assert [r[0] for r in df.select(fold_accents(F.col("t"))).collect()] == want
    assert [r[0] for r in df.selectExpr(fold_sql("t")).collect()] == want
