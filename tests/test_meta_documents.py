"""The metadata demo writes documents of at most 60 records, however large the table."""

import json

import duckdb

from valorum.plans.catalog import QUERIES
from valorum.plans.oracle import ORACLE_SQL
from valorum.sources import files as src

SF = "/root/testdata/sf0.1"


def test_meta_documents_are_bounded(spark, monkeypatch):
    paths, read_meta = [], src.read_meta
    monkeypatch.setattr(src, "read_meta", lambda s, path, *a, **k: paths.append(path) or read_meta(s, path, *a, **k))
    got = QUERIES["src_meta_json"](spark, SF)
    sizes = [len(json.loads(r.value)) for r in spark.read.text(paths[0]).collect()]
    assert max(sizes) <= 60
    assert sum(sizes) == spark.read.parquet(f"{SF}/part.parquet").count()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{SF}/part.parquet')")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL['src_meta_json']})").fetchall()
    key = lambda r: tuple(map(str, r))
    close = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    assert sorted(map(close, got.collect()), key=key) == sorted(map(close, want), key=key)
