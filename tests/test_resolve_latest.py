import random

import pytest
from pyspark.sql import functions as F

from valorum.functions import values as fv
from valorum.operators import fundamentals as fund
from valorum.operators import latest as lt
from valorum.operators import resolve as rs


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# --- latest per key (W1, W2, A2, W3) -------------------------------------------------------------

FILINGS_DDL = "cd string, ano int, klass string, v double, tie int"


def test_latest_eps_preference_order(spark):
    rows = [
        ("a", 2022, "PN", 5.0, 1), ("a", 2023, "PN", 1.0, 2),   # newest year wins even for a less preferred class
        ("b", 2023, "PN", 9.0, 1), ("b", 2023, "ON", 2.0, 2),   # preferred class within the year
        ("c", 2023, "PN", -7.0, 1), ("c", 2023, "PNA", 3.0, 2),  # then the largest |value|
        ("d", 2023, "ON", 4.0, 2), ("d", 2023, "ON", 4.0, 1),   # then the tie-break
        ("e", 2023, "ON", 0.0, 1), ("e", 2023, "XX", 8.0, 2),   # zero and other classes are dropped
    ]
    f = spark.createDataFrame(rows, FILINGS_DDL)
    out = {r.cd: (r.eps, r.year, r.share_class) for r in
           fund.latest_eps(f, "cd", "ano", "v", "klass", tie_break=("tie",)).collect()}
    assert out == {"a": (1.0, 2023, "PN"), "b": (2.0, 2023, "ON"), "c": (-7.0, 2023, "PN"), "d": (4.0, 2023, "ON")}


def test_latest_per_key_limits_before_exchange(spark):
    f = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    plan = _plan(lt.latest_per_key(f, "k", ["v"]))
    assert plan.index("functions=[max_by") < plan.index("Exchange") < plan.index("functions=[partial_max_by")
    plan = _plan(lt.latest_per_key(f.withColumn("s", F.col("v").cast("string")), "k", [("s", "asc")]))  # no struct holds it
    assert "Partial" in plan and plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


@pytest.mark.parametrize("cast", ["int", "string", "date", "timestamp", "boolean"])
@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_latest_per_key_is_one_rule_for_all_types(spark, cast, direction):
    value = {"int": "v", "string": "cast(v as string)", "date": "date_add(date'2020-01-01', v)", "boolean": "v = 7",
             "timestamp": "timestamp_seconds(v)"}[cast]
    df = spark.createDataFrame([("k", None, "null"), ("k", 7, "seven"), ("k", 3, "three"), ("z", None, "only")],
                               "k string, v int, rank string").withColumn("o", F.expr(f"if(v is null, null, {value})"))
    got = {r.k: tuple(r) for r in lt.latest_per_key(df, "k", [("o", direction)], columns=["rank", "v"]).collect()}
    assert got == {"k": ("k", "three", 3) if direction == "asc" else ("k", "seven", 7), "z": ("z", "only", None)}


def test_value_at_latest_skips_nulls(spark):
    df = spark.createDataFrame([("a", 2022, 5.0), ("a", 2023, None), ("b", 2023, None)], "k string, y int, v double")
    got = {r.k: r.v for r in lt.value_at_latest(df, "k", "y", "v").collect()}
    assert got == {"a": 5.0}


def test_top_k_has_group_limit_and_bounds_rows(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("k"), F.col("id").alias("id"))
    top = lt.top_k_per_key(df, "k", ["id"], 40)
    rows = top.collect()
    assert len(rows) == 80 and max(r["rank"] for r in rows) == 40
    assert {r.id for r in rows if r.k == 0} == set(range(20, 100, 2))
    assert "WindowGroupLimit" in _plan(top)


def test_sum_abs_by_year_is_exact(spark):
    df = spark.createDataFrame([("a", 2020, 0.1), ("a", 2020, -0.2), ("a", 2020, 0.3)], "k string, y int, v double")
    assert lt.sum_abs_by_year(df, "k", "y", "v").first().total == 0.6


def test_python_round_parity(spark):
    rnd = random.Random(7)
    vals = [rnd.randint(-10 ** 6, 10 ** 6) / 10 ** rnd.randint(1, 5) for _ in range(3000)] + [2.675, 1.005, 0.125, -2.5]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for places in (2, 3, 4):
        got = [r[0] for r in df.select(fv.round_half_even("x", places)).collect()]
        assert got == [round(v, places) for v in vals]


# --- resolution (J1-J3) ----------------------------------------------------------------------------

def _names(spark, left, right):
    lft = spark.createDataFrame(left, "lid int, name string")
    rgt = spark.createDataFrame(right, "rid int, name string, year int")
    return lft, rgt


def test_exact_match_newest_year_then_smallest_id(spark):
    lft, rgt = _names(spark, [(1, "Banco do Brasil S.A."), (2, "Vale")],
                      [(10, "BANCO DO BRASIL SA", 2020), (11, "banco do brasil s.a.", 2023), (12, "Banco do Brasil SA", 2023),
                       (13, "Vale S/A", 2023)])
    got = {r.lid: r.match_id for r in rs.exact_match(lft, "lid", "name", rgt, "rid", "name", "year").collect()}
    assert got == {1: 11, 2: None}


def test_token_threshold_edges_and_ties(spark):
    # 18 of 25 shared tokens -> Jaccard exactly 0.72; 18 of 26 just under.
    base = [f"T{i:02d}" for i in range(18)]
    l1 = " ".join(base + ["L1", "L2", "L3", "L4", "L5", "L6", "L7"])   # 25 tokens
    r1 = " ".join(base)                                               # 18 tokens: J = 18/25
    l2 = " ".join([b + "X" for b in base] + ["M1", "M2", "M3", "M4", "M5", "M6", "M7", "M8"])  # 26 tokens
    r2 = " ".join(b + "X" for b in base)                              # J = 18/26 < 0.72
    lft, rgt = _names(spark, [(1, l1), (2, l2), (3, "S.A. DE DA"), (4, "ALFA BETA")],
                      [(10, r1, 2020), (20, r2, 2020), (30, "ALFA BETA GAMA", 2019), (31, "ALFA BETA GAMA", 2021),
                       (32, "BETA ALFA", 2018), (33, "SA DO", 2022)])
    got = {r.lid: (r.match_id, round(r.jaccard, 4)) for r in
           rs.token_match(lft, "lid", "name", rgt, "rid", "name", "year").collect()}
    assert got == {1: (10, 0.72), 4: (32, 1.0)}


def test_token_tie_goes_to_newer_year(spark):
    lft, rgt = _names(spark, [(1, "ALFA BETA GAMA DELTA")],
                      [(10, "ALFA BETA GAMA DELTA EPSILON", 2019), (11, "ALFA BETA GAMA DELTA ZETA", 2022)])
    assert rs.token_match(lft, "lid", "name", rgt, "rid", "name", "year").first().match_id == 11


def test_resolution_labels(spark):
    lft, rgt = _names(spark, [(1, "Itaú Unibanco Holding S.A."), (2, "ALFA BETA GAMA DELTA"), (3, "nada")],
                      [(10, "ITAU UNIBANCO HOLDING S.A.", 2023), (11, "ALFA BETA GAMA DELTA OMEGA", 2023)])
    got = {r.lid: (r.match_id, r.how) for r in
           rs.resolve_entities(lft, "lid", "name", rgt, "rid", "name", "year").collect()}
    assert got == {1: (10, "exato"), 2: (11, "token 0.80"), 3: (None, "SEM MATCH")}


def _brute(left, right, t):
    def toks(s):
        return {w for w in s.split() if len(w) > 1}
    out = {}
    for lid, ln in left:
        a = toks(ln)
        best = None
        for rid, rn, yr in right:
            b = toks(rn)
            if not a or not b:
                continue
            j = len(a & b) / len(a | b)
            key = (j, yr, -rid)
            if j >= t and (best is None or key > best[0]):
                best = (key, rid)
        if best:
            out[lid] = best[1]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_token_join_equals_brute_force_with_hot_tokens(spark, seed):
    rnd = random.Random(seed)
    vocab = [f"W{i}" for i in range(40)]
    hot = ["HOTA", "HOTB"]

    def name():
        k = rnd.randint(1, 8)
        words = rnd.sample(vocab, k)
        if rnd.random() < 0.4:  # a third or more of all rows share the hot tokens
            words += hot
        return " ".join(words)
    left = [(i, name()) for i in range(150)]
    right = [(1000 + i, name(), rnd.randint(2000, 2005)) for i in range(150)]
    right += [(2000 + i, n, y) for i, (_, n, y) in enumerate(right[:30])]  # identical sets on the right
    lft, rgt = _names(spark, left, right)
    for t in (0.72, 0.5):
        got = {r.lid: r.match_id for r in rs.token_match(lft, "lid", "name", rgt, "rid", "name", "year", t).collect()}
        assert got == _brute(left, right, t)


def _sets(spark, texts):
    return (spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "_set long, _toks array<string>")
            .withColumn("_sid", rs.set_id("_toks")))


def test_token_counts_are_bounded_and_met_without_a_join(spark, monkeypatch):
    """Every token of the corpus used to be offered in 16 copies, all broadcast through the driver."""
    monkeypatch.setattr(rs, "_COUNTER_BITS", 6)
    texts = [" ".join(f"T{i * 7 + k}" for k in range(5)) + " HOT" for i in range(50)]
    sets = _sets(spark, texts).persist()
    assert rs._counters(sets.where("_set < 5")) == 2 and rs._counters(sets, sets) == 64 and rs._counters(*[sets] * 9) == 64
    counts = rs._token_counts(64, sets, sets)
    assert [len(r._counts) for r in counts.collect()] == [64]  # 251 tokens
    assert sum(counts.first()._counts) == 64 + 2 * 50 * 6
    prefix = rs._prefix_tokens(sets, counts, 64, 0.72)
    plan = _plan(prefix).partition("Subquery")[0]
    assert not any(x in plan for x in ("Join", "Exchange"))
    got = {}
    for r in prefix.collect():
        got.setdefault(r["_set"], []).append((r["_pos"], r["tok"]))
    hot = spark.range(1).select(F.xxhash64(F.lit("HOT"))).first()[0]
    assert all(sorted(p for p, _ in v) == [0, 1] and hot not in [t for _, t in v] for v in got.values()) and len(got) == 50
    sets.unpersist()


@pytest.mark.parametrize("bits", [0, 4])
def test_tokens_that_share_a_counter_lose_no_match(spark, monkeypatch, bits):
    monkeypatch.setattr(rs, "_COUNTER_BITS", bits)
    rnd = random.Random(bits)
    words = [f"W{i:02d}" for i in range(40)]
    left = [(i, " ".join(rnd.sample(words[:25], rnd.randint(2, 9)))) for i in range(120)]
    right = [(1000 + i, " ".join(rnd.sample(words[:25], rnd.randint(2, 9))), 2000 + i % 5) for i in range(120)]
    right += [(2000 + i, t + " EXTRA", 2001) for i, t in left[::4]]
    lft, rgt = _names(spark, left, right)
    found = rs.token_match(lft, "lid", "name", rgt, "rid", "name", "year", 0.6)
    assert "SortMergeJoin [tok#" in _plan(found) and "BroadcastHashJoin [tok#" not in _plan(found)  # prefixes are never broadcast
    got = {r.lid: r.match_id for r in found.collect()}
    assert got == _brute(left, right, 0.6) and len(got) >= 30


def test_resolution_plan_has_no_pair_explosion(spark):
    lft, rgt = _names(spark, [(1, "ALFA BETA")], [(10, "ALFA BETA GAMA", 2020)])
    plan = _plan(rs.resolve_entities(lft, "lid", "name", rgt, "rid", "name", "year"))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_spread_starts_no_job(spark):
    from valorum.session import spread
    grouped = spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()
    sc = spark.sparkContext
    sc.setJobGroup("spread", "spread")
    try:
        spread_ = spread(grouped, 4)
        assert len(sc.statusTracker().getJobIdsForGroup("spread")) == 0
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert spread_.rdd.getNumPartitions() == 4


def test_cluster_without_shared_folder_is_an_error():
    from types import SimpleNamespace

    from valorum.session import ensure_checkpoint_dir
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        fake = SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master=master),
                               conf=SimpleNamespace(get=lambda *_: None))
        with pytest.raises(RuntimeError):
            ensure_checkpoint_dir(fake)


def _words_of(t):
    return set(t.split())


def test_parity_signatures_never_exceed_the_difference(spark):
    """Sets of 2 to 600 tokens: signatures of 4 to 16 words, the longer brought to the shorter one's length."""
    rnd = random.Random(5)
    vocab = [f"V{i}" for i in range(1500)]
    texts = [" ".join(rnd.sample(vocab, n)) for n in (2, 9, 64, 250, 257, 300, 500, 513, 600)]
    texts += [" ".join(rnd.sample(t.split(), max(1, len(t.split()) - 7)) + ["X", "Y"]) for t in texts]
    s = _sets(spark, texts).select("_set", F.size("_toks").alias("n"), rs.parity_words().alias("_w"))
    assert all(len(r["_w"]) == max(4, 1 << max(0, -(-r.n // 64) - 1).bit_length()) for r in s.collect())
    pairs = s.select(F.col("_set").alias("a"), F.col("_w").alias("_lw")).crossJoin(s.select(F.col("_set").alias("b"), F.col("_w").alias("_rw")))
    seen = {(r.a, r.b): r.d for r in pairs.select("a", "b", rs._parity_distance("_lw", "_rw").alias("d")).collect()}
    for (a, b), d in seen.items():
        real = len(_words_of(texts[a]) ^ _words_of(texts[b]))
        assert d <= real and (real - d) % 2 == 0 and (real > 12 or d >= real - 6), (a, b, d, real)


def test_candidates_are_near_pairs_only(spark):
    """Pairs that met on one rare token used to be candidates, over 100 for each that matches."""
    rnd = random.Random(6)
    vocab = [f"V{i}" for i in range(2500)]
    texts = [" ".join(rnd.sample(vocab, rnd.randint(60, 200))) for _ in range(300)]
    near = [" ".join(t.split()[6:] + [f"N{i}"]) for i, t in enumerate(texts[:40])]
    left, right = _sets(spark, texts), _sets(spark, near + texts[100:])
    counters = rs._counters(left, right)
    counts = rs._token_counts(counters, left, right)
    got = {(r["_lset"], r["_rset"]): r["_d"] for r in rs._candidates(left, right, counts, counters, 0.72).collect()}
    rtexts = near + texts[100:]
    true = {(i, k): len(_words_of(a) ^ _words_of(b)) for i, a in enumerate(texts) for k, b in enumerate(rtexts)
            if len(_words_of(a) & _words_of(b)) >= 0.72 * len(_words_of(a) | _words_of(b))}
    assert len(true) == 240 and set(true) <= set(got) and all(got[p] <= d for p, d in true.items())
    assert len(got) <= 1.1 * len(true)


def _files(spark, what):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return [f for f in found.split("\n") if what in f]


def test_many_postings_leave_no_shuffle_files_and_no_profiles(spark, monkeypatch, tmp_path):
    """Shuffle files and work tables of every step used to stay until the query ended, 1.04 GB for 0.1 GB when it was stopped."""
    import os

    from valorum import session
    rnd = random.Random(8)
    vocab = [f"W{i}" for i in range(60)]
    base = rnd.sample(vocab, 30)  # a group of near copies: every pair of them is near
    near = [" ".join(w for w in base if rnd.random() > 0.04) + f" Z{rnd.randint(0, 3)}Z" for _ in range(60)]
    names = near + [" ".join(rnd.sample(vocab, rnd.randint(1, 12))) for _ in range(200)] + ["", "S A"]
    left = [(i, n) for i, n in enumerate(names)]
    right = [(1000 + i, n, rnd.choice([None, 2001, 2002])) for i, n in enumerate(reversed(names[10:150]))] + [(5000, near[0] + " Q9", 2003)]
    lft, rgt = _names(spark, left, right)
    plain = sorted(rs.resolve_entities(lft, "lid", "name", rgt, "rid", "name", "year").collect())
    monkeypatch.setattr(rs, "_POSTINGS_IN_ONE_PLAN", 0)
    monkeypatch.setattr(session, "shared_path", lambda spark, *parts: "/".join([f"file://{tmp_path}", *parts]))
    before = _files(spark, "shuffle_")
    found = rs.token_match(lft, "lid", "name", rgt, "rid", "name", "year")
    assert set(_files(spark, "shuffle_")) <= set(before)
    assert sorted(f.rpartition("-")[0] for f in os.listdir(tmp_path / "work")) == ["best-scores", "left-rows", "token-counts"]
    want = _brute(left, [(i, n, y or 0) for i, n, y in right], 0.72)
    assert {r.lid: r.match_id for r in found.collect()} == want and len(want) > 140
    assert sorted(rs.resolve_entities(lft, "lid", "name", rgt, "rid", "name", "year").collect()) == plain
    text_ids = rgt.withColumn("rid", F.col("rid").cast("string"))  # no struct holds this order
    assert {r.lid: int(r.match_id) for r in rs.token_match(lft, "lid", "name", text_ids, "rid", "name", "year").collect()} == want


def test_resolution_keeps_no_names(spark, monkeypatch, tmp_path):
    """Profiles with the whole names, and the exact result with the tokens, used to stay on disk beside the sets."""
    import os

    from valorum import session
    monkeypatch.setattr(rs, "_POSTINGS_IN_ONE_PLAN", 0)
    monkeypatch.setattr(session, "shared_path", lambda spark, *parts: "/".join([f"file://{tmp_path}", *parts]))
    # 1 meets 10 exactly, and 4 has the same tokens as 1 without being equal to any name; nothing is the null name's or the empty name's own.
    lft, rgt = _names(spark, [(1, "Banco Alfa S.A."), (2, None), (3, ""), (4, "ALFA BANCO"), (5, "Banco Alfa S.A."), (6, "GAMA")],
                      [(10, "BANCO ALFA SA", 2020), (11, "banco alfa s.a.", 2019), (12, None, 2023), (13, "S/A", 2023)])
    found = rs.resolve_entities(lft, "lid", "name", rgt, "rid", "name", "year")
    tables = {f.rpartition("-")[0]: spark.read.parquet(str(tmp_path / "work" / f)).columns for f in os.listdir(tmp_path / "work")}
    assert sorted(tables) == ["best-scores", "exact-match", "token-counts"] and tables["exact-match"] == ["_id", "_sid", "_match"]
    assert {r.lid: (r.match_id, r.how) for r in found.collect()} == {
        1: (11, "exato"), 2: (None, "SEM MATCH"), 3: (None, "SEM MATCH"), 4: (10, "token 1.00"), 5: (11, "exato"), 6: (None, "SEM MATCH")}


def test_work_table_gives_back_the_setting(spark):
    from valorum import session
    key = session._DROP_SHUFFLES
    before = spark.conf.get(key, None)
    table = session.work_table(spark.range(10).repartition(3), "some")
    assert spark.conf.get(key, None) == before and table.count() == 10
    session.drop_table(table)
    with pytest.raises(Exception):
        spark.read.parquet(table.inputFiles()[0])
    with pytest.raises(ValueError):
        session.drop_table(spark.read.parquet("/root/testdata/sf0.001/part.parquet"))
