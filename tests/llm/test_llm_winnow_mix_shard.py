import hashlib
from collections import Counter, defaultdict

import brute
import duckdb
import pytest
from llm_cases import DOCS, clashing, empty, frame, rows
from pyspark.sql import functions as F

from valorum.llm import mixing, sharding, winnow
from valorum.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def check_edits(got, data):
    want = brute.edits(data)
    text = lambda f: ",".join(f"{h}@{p}" for h, p in f)
    assert len(got) == len(want)
    for r in got:
        n, edited, own, changed, near, nxt = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest()), r.doc_id
        assert (r.fingerprint, r.edited_fingerprint) == (text(own), text(changed)), r.doc_id
        assert r.near_edited == pytest.approx(near) and r.near_next == pytest.approx(nxt)


def test_winnow_equals_definition(spark):
    check_edits(winnow.compare_edits(clashing(frame(spark))).collect(), [(d, t) for d, t, *_ in rows()])
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_edits(winnow.compare_edits(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_winnow_rightmost_ties_and_guarantee(spark):
    same = "x " * 40
    a = " ".join(f"a{i}" for i in range(60))
    shared = " ".join(f"s{i}" for i in range(12))  # w + k - 1 units
    df = spark.createDataFrame([(1, same, None, None, None), (2, f"{a} {shared}", None, None, None),
                                (3, f"{shared} other ending", None, None, None)], DOCS)
    got = {r.doc_id: r.chosen for r in winnow.fingerprints(df, k=5, w=8).collect()}
    top = (1 << 31) - 1
    places = [top - (x & top) for x in got[1]]
    assert places == list(range(7, 36))  # all grams tie: the last of each window
    assert {x >> 31 for x in got[2]} & {x >> 31 for x in got[3]}


def test_winnow_small_modulus_has_ties(spark):
    data = [(d, t) for d, t, *_ in rows()[:40]]
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in data], DOCS)
    got = winnow.with_winnow(df.select("doc_id", "text"), "text", "chosen", 2, 5, modulus=7).collect()
    for r in got:
        want = brute.winnow(r.text, 2, 5, modulus=7)
        assert [(x >> 31, (1 << 31) - 1 - (x & ((1 << 31) - 1))) for x in r.chosen] == want


def test_winnow_odd_tables(spark):
    assert winnow.compare_edits(empty(spark)).count() == 0
    one = winnow.compare_edits(spark.createDataFrame([(5, "abcd efgh", None, None, None)], DOCS)).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcd efab").hexdigest() and one.near_next == 1.0
    data = [(None, "alpha beta gamma delta", None, None, None)] * 4 + [(1, "one two three four", None, None, None)] * 3 + [(2, None, None, None, None)]
    got = winnow.compare_edits(clashing(spark.createDataFrame(data, DOCS))).collect()
    assert len(got) == 8 and len({(r.doc_id, r.edited_sha256) for r in got}) == 3
    assert next(r for r in got if r.doc_id is None).edited_sha256 == hashlib.sha256(b"alpha beta gamma " + b"one t").hexdigest()


def targets_by_rounds(sizes):
    """Targets by resharing the excess until no source is above its cap."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: float(i % 3 + 1) for i, s in enumerate(order)}
    capped, total = set(), float(sum(sizes.values()))
    while True:
        rest = total - sum(3.0 * sizes[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        level = rest / sum(w[s] for s in open_) if open_ else 0.0
        above = [s for s in open_ if level * w[s] > 3.0 * sizes[s] * (1 + 1e-12)]
        if not above:
            return {s: 3.0 * sizes[s] if s in capped else level * w[s] for s in order}
        capped |= set(above)


def check_mix(got, source_of):
    size, taken, target, largest = Counter(), Counter(), {}, Counter()
    for r in got:
        s = source_of[r.doc_id]
        size[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        largest[s] = max(largest[s], r.size)
        assert 0 <= r.taken <= 3 * r.size
    want = targets_by_rounds({s: size[s] for s in target})
    for s in target:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    assert all(r.source_size == size[source_of[r.doc_id]] for r in got)


@pytest.mark.parametrize("bits", [2, 10, 20])
def test_mix_meets_targets(spark, bits):
    source_of = {d: s for d, _, _, s, _ in rows()}
    got = mixing.mix(clashing(frame(spark)), bits=bits).collect()
    check_mix(got, source_of)
    again = mixing.mix(frame(spark, partitions=7), bits=10).collect()
    assert {r.doc_id: r.taken for r in got} == {r.doc_id: r.taken for r in again}


def test_mix_equals_sql_and_is_nested(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = {r[0]: r[1:] for r in con.execute(ORACLE_SQL["op5_mix_sources"]).fetchall()}
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op5_mix_sources"](spark, SF).collect()}
    assert {d: (a, b, e) for d, (a, b, _, e) in got.items()} == {d: (a, b, e) for d, (a, b, _, e) in want.items()}
    assert all(got[d][2] == pytest.approx(want[d][2]) for d in want)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    small = {r.doc_id: r.copies for r in mixing.mix(docs, share=0.3).collect()}
    large = {r.doc_id: r.copies for r in mixing.mix(docs, share=0.6).collect()}
    assert all(small[d] <= large[d] for d in small)


@pytest.mark.parametrize("few", [10_000, 0])
def test_take_repeats_rows(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    df = clashing(frame(spark))
    copies = {r.doc_id: r.copies for r in mixing.mix(df).collect()}
    got = mixing.take(df)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not few or "hashpartitioning" not in plan  # with few sources no text is shuffled
    assert got.columns == df.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter({d: c for d, c in copies.items() if c})


def test_mix_odd_tables(spark):
    assert mixing.mix(empty(spark)).count() == 0 and mixing.take(empty(spark)).count() == 0
    data = [(None, "a b", None, None, None)] * 4 + [(1, None, None, "z", None), (2, "", None, "z", None), (3, "c d e", None, "", None)]
    got = mixing.mix(spark.createDataFrame(data, DOCS)).collect()
    assert len(got) == 7 and all(r.target == r.taken == 0 for r in got if r.doc_id in (1, 2))
    assert len({r.taken for r in got if r.doc_id is None}) == 1


def check_shards(got, tolerance):
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
        assert r.law == "bytes" and r.grown_shard is None
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    total = sum(r.size for r in got)
    for part in by.values():
        assert abs(sum(r.size for r in part) - total / 16) <= tolerance
    return by


def test_shards_are_near_equal(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sharding.shard(docs).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        assert (r.size, r.text_crc32) == (len((text[r.doc_id] or "").encode()) + 1, brute.crc(text[r.doc_id]))
    check_shards(got, 1.01 * max(r.size for r in got))
    home = defaultdict(set)
    for r in got:
        home[text[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in home.values())  # equal texts share a shard


def test_hot_group_and_repeated_rows_are_subdivided(spark):
    data = [(i, f"text {i} " * (i % 7), None, None, None) for i in range(3000)] + [(i, "the same copy of a text", None, None, None) for i in range(3000, 5000)]
    data += [(9, "one row again and again", None, None, None)] * 1500
    got = sharding.shard(clashing(frame(spark, data)), min_ranges=256).collect()
    by = check_shards(got, 0.05 * sum(r.size for r in got) / 16)
    assert len(by) == 16


def homes(got, text):
    """{text: shards that hold its rows}."""
    home = defaultdict(set)
    for r in got:
        home[text[r.doc_id]].add(r.shard)
    return home


def test_small_groups_stay_whole_in_overfull_ranges(spark):
    """Thousands of short pairs beside few long texts: their ranges hold too many rows and are cut between keys only."""
    data = [(i, f"t{i // 2}", None, None, None) for i in range(6000)] + [(6000 + i, f"{i} " * 4000, None, None, None) for i in range(300)]
    data += [(7000 + i, "x", None, None, None) for i in range(3000)]  # many rows, hardly any bytes
    docs = frame(spark, data)
    got = sharding.shard(docs, min_ranges=256).collect()
    check_shards(got, 1.01 * max(r.size for r in got))
    assert [t for t, s in homes(got, {d: t for d, t, *_ in data}).items() if len(s) > 1] == []


def test_shards_do_not_depend_on_the_file_split(spark):
    data = [(i, f"text {i % 900} " * (1 + i % 9), None, None, None) for i in range(2500)] + [(5, "again", None, None, None)] * 700
    found = []
    for parts in (2, 11):
        got = sharding.shard(frame(spark, data, parts), min_ranges=256).collect()
        found.append(sorted((r.doc_id, r.text_crc32, r.shard) for r in got))
    assert found[0] == found[1]


def test_shard_odd_tables(spark):
    assert sharding.shard(empty(spark)).count() == 0
    got = sharding.shard(spark.createDataFrame([(None, None, None, None, None)] * 3 + [(1, "", None, None, None)], DOCS)).collect()
    assert sorted(r.size for r in got) == [1] * 4 and {r.text_crc32 for r in got} == {0}
