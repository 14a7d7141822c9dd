import os
import sys
import tempfile

import duckdb
from pyspark.sql import functions as F

from valorum.operators import latest as lt
from valorum.plans import roles
from valorum.streaming import streams as sm

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "scripts"))


def _split_events(spark, n_files=3):
    """The events table split into several files (by time), to drive several micro-batches."""
    src = tempfile.mkdtemp(prefix="valorum-stream-src-")
    ev = roles.table(spark, SF, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    bounds = ev.select(F.min(micros).alias("lo"), F.max(micros).alias("hi")).first()
    step = (bounds.hi - bounds.lo) // n_files + 1
    for i in range(n_files):
        part = ev.where((micros >= bounds.lo + i * step) & (micros < bounds.lo + (i + 1) * step))
        part.coalesce(1).write.parquet(f"{src}/part{i}")
    return src, ev.schema


def _stream_quotes(spark, src, schema):
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(src)
    return s.select(F.col("user_id").alias("ticker"), "ts",
                    F.when(F.col("event_type") != "error", F.col("value")).alias("close"))


def test_stream_latest_quote_equals_batch_and_restarts(spark):
    src, schema = _split_events(spark)
    work = tempfile.mkdtemp(prefix="valorum-stream-")
    q = sm.stream_latest_quote(_stream_quotes(spark, src, schema), work + "/state", work + "/ckpt", buckets=4)
    q.awaitTermination()
    assert q.lastProgress is not None
    state = {r.ticker: (r.price, r.last_ts) for r in sm.read_state(spark, work + "/state").collect()}
    batch = roles.quotes(spark, SF).where(F.col("close").isNotNull())
    want = {r.ticker: (r.price, r.last_ts) for r in batch.groupBy("ticker").agg(
        F.max_by("close", F.struct("ts", "close")).alias("price"), F.max("ts").alias("last_ts")).collect()}
    assert state == want
    # Restart from the checkpoint: nothing new, same state.
    q2 = sm.stream_latest_quote(_stream_quotes(spark, src, schema), work + "/state", work + "/ckpt", buckets=4)
    q2.awaitTermination()
    assert {r.ticker: (r.price, r.last_ts) for r in sm.read_state(spark, work + "/state").collect()} == state


def test_stream_assumptions_equals_batch(spark):
    li = roles.table(spark, SF, "lineitem")
    src = tempfile.mkdtemp(prefix="valorum-stream-li-")
    for i, flag in enumerate(("A", "N", "R")):  # late and early edits arrive in different batches
        li.where(F.col("l_returnflag") == flag).coalesce(1).write.parquet(f"{src}/part{i}")
    work = tempfile.mkdtemp(prefix="valorum-stream-")
    stream = spark.readStream.schema(li.schema).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", True).parquet(src)
    q = sm.stream_assumptions(roles.assumption_events_from(stream), work + "/state", work + "/log", work + "/ckpt",
                              buckets=4)
    q.awaitTermination()
    got = sorted(tuple(r) for r in sm.read_state(spark, work + "/state").select("ticker", "id", "ke").collect())
    want = sorted(tuple(r) for r in lt.latest_per_key(roles.assumption_events(spark, SF), "ticker", ["event_time", "id"])
                  .select("ticker", "id", "ke").collect())
    assert got == want
    assert spark.read.parquet(work + "/log").count() == li.count()


def test_entry_and_every_query_against_oracle(spark):
    import __spark_entry__ as E
    from check_oracle import TABLES, rows_of
    from valorum.plans.catalog import QUERIES

    df = E.entry(spark)
    assert df.count() > 0 and len(df.columns) > 5
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    bad = []
    assert set(QUERIES) <= set(qs)
    for name, fn in QUERIES.items():
        out = fn(spark, SF)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan, name
        if name not in sqls:
            continue
        if rows_of(out.toPandas()) != rows_of(con.execute(sqls[name]).df()):
            bad.append(name)
    assert bad == []
