"""op12 against a scan of every period and place."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from llm_cases import DOCS, clashing, empty, frame, rows

from valorum.llm import runs
from valorum.llm.queries import QUERIES


def brute(w, least=6, times=4):
    """[(start, length, period)] of every run, by start then period."""
    n, out = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def collapse(w, found):
    dropped = {x for s, n, q in found for x in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in dropped)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    n, g = len(w), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def digest(doc_id, text):
    w = planted(doc_id, words_of(text))
    found = brute(w)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha(lines), sha(collapse(w, found)))


def odd_texts(seed, many):
    rng = random.Random(seed)
    for _ in range(many):
        k = rng.choice([0, 1, 5, 20, 100, 300])
        w = [rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ"[:rng.choice([1, 2, 3, 30])]) for _ in range(k)]
        for _ in range(rng.randint(0, 3) if k else 0):
            s, p = rng.randrange(k), rng.randint(1, max(1, k // 5))
            for i in range(s, min(k, s + p * rng.randint(2, 9))):
                w[i] = w[s + (i - s) % p]
        yield w


@pytest.mark.parametrize("least, times", [(6, 4), (1, 3), (9, 5)])
def test_blocks_equal_definition(monkeypatch, least, times):
    monkeypatch.setattr(runs, "QUERIES", 500)
    data = list(odd_texts(least, 150))
    data += [data[-1]] * 3 + [["a"] * 50, ["a"] * 50, ["a", "b"] * 25]  # copies and texts of one length side by side
    for k in range(0, len(data), 9):
        some = data[k:k + 9]
        for w, (own, rest) in zip(some, runs.runs_of([" ".join(w).encode() for w in some], least, times)):
            want = brute(w, least, times)
            assert [tuple(r) for r in own.tolist()] == want and rest.decode() == collapse(w, want), w


def test_extensions_equal_comparison():
    rng = np.random.default_rng(3)
    parts = [rng.integers(1, 3, n) for n in (40, 1, 200, 7)] + [np.ones(90, int), np.tile([1, 2, 3], 30), np.ones(90, int)]
    words = np.concatenate([[0]] + [np.append(p, 0) for p in parts])
    docs = np.concatenate([[len(parts)]] + [np.full(len(p) + 1, k) for k, p in enumerate(parts)])
    made = runs.Extensions(words, docs)
    i, j = np.triu_indices(len(words), 1)
    same = (docs[i] == docs[j]) & (words[i] > 0)
    i, j = i[same], j[same]
    want = []
    for a, b in zip(i.tolist(), j.tolist()):
        k = 0
        while words[a + k] == words[b + k] and words[b + k]:
            k += 1
        want.append(k)
    assert made(i, j).tolist() == want


def test_cover_meets_every_difference():
    assert {(a - b) % runs.V for a in runs.COVER for b in runs.COVER} == set(range(runs.V))
    assert all((x + runs.SYNC[x, y]) % runs.V in runs.COVER and (y + runs.SYNC[x, y]) % runs.V in runs.COVER
               for x in range(runs.V) for y in range(runs.V))


def test_long_repeats_in_one_document():
    for w, want in ((["x"] * 20000, (0, 20000, 1)), (["a", "b", "c"] * 6000, (0, 18000, 3)),
                    ([str(i % 4000) for i in range(20000)], (0, 20000, 4000))):
        (own, _), = runs.runs_of([" ".join(w).encode()], 6, 4)
        assert [tuple(r) for r in own.tolist()] == [want]


def test_query_equals_brute_force(spark, tmp_path):
    got = [tuple(r) for r in QUERIES["op12_run_detection"](spark, "/root/testdata/sf0.01").collect()]
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    assert sorted(got) == sorted(digest(r.doc_id, r.text) for r in table)
    data = rows() + [(1000 + i, "\v".join(w) + " \n", None, None, None) for i, w in enumerate(odd_texts(4, 80))]
    data += data[:3] + [(5000, "to be or   to be or   " * 9, "en", "s", 1), (5001, "é " * 7, None, None, None)]
    spark.createDataFrame(data, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in QUERIES["op12_run_detection"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((digest(d, t) for d, t, *_ in data), key=str)


def test_odd_tables(spark):
    assert runs.find_runs(empty(spark)).count() == 0 and runs.plant(empty(spark)).count() == 0
    data = [(None, "a " * 9, None, None, None), (1, None, "en", "s", 1), (1, None, "en", "s", 1), (2, "", None, None, None), (3, "\n \t", None, None, None)]
    df = clashing(frame(spark, data))
    got = {(r.doc_id, tuple(map(tuple, r.runs)), r.collapsed) for r in runs.find_runs(df).collect()}
    assert got == {(None, ((0, 9, 1),), "a"), (1, (), ""), (2, (), ""), (3, (), "")}
    kept = runs.with_runs(df, runs="r", collapsed="c")
    assert kept.columns == [*df.columns, "r", "c"] and kept.count() == len(data)
    assert [r.text for r in runs.plant(df).where("doc_id is null").collect()] == ["a " * 9]
    with pytest.raises(ValueError):
        runs.find_runs(df, times=2)
