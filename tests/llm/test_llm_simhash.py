import brute
import numpy as np
import pytest
from llm_cases import DOCS, clashing, empty, frame, rows
from pyspark.sql import functions as F

from valorum.llm import simhash as sh

SF = "/root/testdata/sf0.001"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_tree_search_equals_all_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    flips = [base ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64))
             for _ in range(6)]
    v = np.unique(np.concatenate([base, *flips]))
    q, n = sh.BKTree(v).search(v, 3)
    got = np.zeros((len(v), len(v)), int)
    np.add.at(got, (q, n), 1)
    assert (got == (np.bitwise_count(v[:, None] ^ v) <= 3)).all()
    assert sh.BKTree(v[:0]).search(v, 3)[0].size == 0


def test_fingerprint_rule():
    for _, t, *_ in rows():
        assert sh.simhash(t) == signed(brute.simhash(t)), t[:40] if t else t
    assert sh.simhash("A  b\tC") == sh.simhash("a b c") and sh.simhash(None) == sh.simhash(" ") == 0


@pytest.mark.parametrize("tree_size", [3, 2048])
def test_components_equal_all_pairs(spark, tree_size):
    want = brute.simhash_components([(d, t) for d, t, *_ in rows()])
    got = sh.near_duplicates(clashing(frame(spark)), tree_size=tree_size).collect()
    assert {r.doc_id: (r.fp, r.component_id) for r in got} == {d: (signed(f), c) for d, (f, c) in want.items()}


def test_components_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    data = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute.simhash_components(data)
    got = {r.doc_id: (r.fp, r.component_id) for r in sh.near_duplicates(docs).collect()}
    assert got == {d: (signed(f), c) for d, (f, c) in want.items()}
    kept = sorted(r.doc_id for r in sh.keep_one(docs).select("doc_id").collect())
    assert kept == sorted({c for _, c in want.values()})


def test_chain_of_links_is_one_component(spark):
    fps = [0]
    for i in range(20):  # each two bits from the one before
        fps.append(fps[-1] ^ (3 << (2 * i)))
    fps += [((1 << 64) - 1) ^ f for f in fps[:3]]
    nodes = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for size in (2, 100):
        got = {r.fp: r.root for r in sh.components(nodes, sh.fingerprint_links(nodes, 3, 5, size)).collect()}
        assert len({got[signed(f)] for f in fps[:21]}) == 1 and len(set(got.values())) == 2


def test_odd_tables(spark):
    assert sh.near_duplicates(empty(spark)).count() == 0 and sh.keep_one(empty(spark)).count() == 0
    data = [(None, "a b c d", "x", None, None), (None, "a b c d", "x", None, None), (9, "a b c d", None, "s", 1), (9, "a b c d", None, "s", 1),
            (9, "quite another text altogether", None, "s", 1), (3, None, None, None, None), (4, "", None, None, None)]
    df = clashing(spark.createDataFrame(data, DOCS))
    got = sorted((r.doc_id or 0, r.component_id) for r in sh.near_duplicates(df).collect())
    assert got == [(0, 9), (0, 9), (3, 3), (4, 3), (9, 9), (9, 9), (9, 9)]
    kept = sh.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.select("doc_id", "text").collect()) == [
        (3, ""), (9, "a b c d"), (9, "quite another text altogether")]
    assert sh.keep_one(df.where(F.col("doc_id").isNull())).count() == 1
