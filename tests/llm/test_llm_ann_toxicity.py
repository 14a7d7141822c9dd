import math
import random

import numpy as np
import pytest
from llm_cases import DOCS, clashing, empty, frame
from pyspark.sql import functions as F

from valorum.llm import ann, toxicity
from valorum.llm.queries import QUERIES, seen_label

SF = "/root/testdata/sf0.01"
VEC = "vec_id long, embedding array<float>, label int"


def nearest(data, query, k):
    x = {i: np.array(v, np.float64) for i, v in data}
    best = sorted((-float((x[query] * x[i]).sum()), i) for i in x if i != query)[:k]
    return [(i, -s) for s, i in best]


def by_query(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: [(i, s) for _, i, s in sorted(v)] for q, v in out.items()}


def test_cells_come_in_falling_order():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=9), rng.normal(size=7)
    counts = rng.integers(0, 3, (9, 7))
    got = ann.visit(a, b, counts, 10**9)
    want = sorted(((i, j) for i in range(9) for j in range(7) if counts[i, j]), key=lambda c: -(a[c[0]] + b[c[1]]))
    assert got == want
    some = ann.visit(a, b, counts, 10)
    held = [counts[c] for c in some]
    assert some == want[:len(some)] and sum(held) >= 10 > sum(held[:-1])


def test_recall_on_the_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = [(r.vec_id, r.embedding) for r in vectors.collect()]
    got = by_query(ann.search(vectors, F.col("vec_id") % 20 == 0, least=100))
    assert set(got) == {i for i, _ in data if i % 20 == 0}
    x, ids = np.array([v for _, v in data], float), np.array([i for i, _ in data])
    hits = 0
    for q, found in got.items():
        scores = x @ x[ids == q][0]
        scores[ids == q] = -np.inf
        hits += len({i for i, _ in found} & set(ids[np.lexsort((ids, -scores))[:20]]))
        assert len(found) == 20 and found == sorted(found, key=lambda p: (-p[1], p[0]))
        assert all(s == pytest.approx(scores[ids == i][0], abs=1e-12) for i, s in found)
    assert hits / (20 * len(got)) >= 0.9


def test_the_visited_share_follows_the_data(spark, monkeypatch):
    """Clustered vectors need few of their entries, vectors without structure most; recall holds in both."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 16)) * 4
    seen, search = [], ann.visited_share
    monkeypatch.setattr(ann, "visited_share", lambda *args: seen.append(search(*args)) or seen[-1])
    for x in (centres[rng.integers(0, 60, 3000)] + rng.normal(size=(3000, 16)) * 0.3, rng.normal(size=(3000, 16))):
        data = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
        got = by_query(ann.search(spark.createDataFrame(data, VEC), F.col("vec_id") % 60 == 0, k=10, least=20))
        x32 = np.float32(x).astype(float)
        hits = 0
        for q, found in got.items():
            scores = x32 @ x32[q]
            scores[q] = -np.inf
            hits += len({i for i, _ in found} & set(np.lexsort((np.arange(3000), -scores))[:10].tolist()))
        assert hits / (10 * len(got)) >= 0.9
    assert seen[0] < 0.2 < seen[1], seen
    print("visited shares", seen)


def test_copies_ties_and_unusable_vectors(spark):
    rng = random.Random(4)
    good = [(i, [rng.uniform(-1, 1) for _ in range(5)], 0) for i in range(40)]
    good += [(100 + i, good[3][1], 0) for i in range(70)] + [(200, [-c for c in good[5][1]], 1)]
    bad = [(300, None, 0), (320, [0.0] * 5, 0), (340, [1.0, None, 0.0, 0.0, 0.0], 0), (360, [math.nan, 1.0, 1.0, 1.0, 1.0], 0),
           (380, [math.inf, 1.0, 1.0, 1.0, 1.0], 0), (400, [1.0, 2.0], 0), (None, [1.0] * 5, 0), (420, [], 0)]
    df = spark.createDataFrame(good + bad + good[:2], VEC)
    data = [(i, list(np.float32(v))) for i, v, _ in good]
    got = by_query(ann.search(clashing(df), F.col("vec_id") % 20 == 0, least=10**6, list_size=16))
    assert set(got) == {i for i, _ in data if i % 20 == 0}
    for q, found in got.items():
        want = nearest(data, q, 20)
        assert [i for i, _ in found] == [i for i, _ in want]
        assert [s for _, s in found] == pytest.approx([s for _, s in want])


def test_few_and_no_vectors(spark):
    assert ann.search(spark.createDataFrame([], VEC), F.lit(True)).count() == 0
    one = spark.createDataFrame([(20, [1.0], 0)], VEC)
    assert ann.search(one, F.lit(True)).count() == 0
    two = spark.createDataFrame([(20, [1.0], 0), (40, [2.0], 0)], VEC)
    assert by_query(ann.search(two, F.lit(True))) == {20: [(40, 2.0)], 40: [(20, 2.0)]}


def test_folding():
    assert toxicity.fold("ＴＲ４ＳＨ tr4sh тrаsh 𝐭𝐫𝐚𝐬𝐡") == "trash trash trash trash"
    assert toxicity.fold("ТRАSН trásh tra\u0301sh ΤRΑSΗ") == "trash trash trash trash"
    assert toxicity.fold("ѕсυm SСUΜ 8a9 Жук Ünï") == "scum scum bag жyk uni"
    assert toxicity.fold("іdіоt 1d10t IDIOT") == "idiot idiot idiot"


def test_matches_are_whole_words_outside_exceptions():
    m = toxicity.Model({"scum": 1.0, "clown": 0.5}, frozenset({"clown fish"}), 0.1)
    made = m.automaton()
    d = lambda t: toxicity.density(toxicity.fold(t), made)
    assert d("you scum") == 0.5 and d("scumbag") == 0 and d("a clown!") == 0.25 and d("SCUM### scum") == 1.0
    assert d("clown fish swim") == 0 and d("clown fish clown") == pytest.approx(0.5 / 3) and d("") == 0
    assert toxicity.density("any", toxicity.Model({}).automaton()) == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op2_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    hit = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert hit / (got.toxic == 1).sum() > 0.85 and hit / (got.predicted == 1).sum() > 0.9
    assert got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()


def test_learning_and_odd_tables(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(200)]
    data, marks = [], []
    for i in range(600):
        toxic = i % 6 == 0
        text = rng.choices(words, k=60) + (["zork"] * 2 if toxic else [])
        if i % 5 == 1:
            text += ["zork", "plant"]  # harmless: an exception phrase
        rng.shuffle(text) if toxic else None
        data.append((i, " ".join(text), None, None, None))
        marks.append((i, None if i % 50 == 49 else int(toxic)))
    labels = spark.createDataFrame([*marks, (None, 1)], "doc_id long, toxic int")
    docs = clashing(spark.createDataFrame(data, DOCS))
    model = toxicity.fit(docs, labels, seen_label())
    assert "zork" in model.terms and "zork plant" in model.exceptions
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert sum(got[i] == int(i % 6 == 0) for i in got) >= 590
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(i for i in got if not got[i])
    odd = toxicity.score(frame(spark), model)
    assert odd.count() == frame(spark).count() and odd.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(empty(spark), model).count() == 0 and toxicity.keep_clean(empty(spark), model).count() == 0
    none = toxicity.fit(empty(spark), labels, seen_label())
    assert none.terms == {} and toxicity.score(docs, none).where("score > 0").count() == 0


def plain_fit(texts, min_groups=2, min_odds=8.0, false_terms=50.0, max_terms=20_000):
    """(terms, exceptions, densities) of labelled texts, counted one text after another."""
    def support(units):
        """{term: [[clean, toxic] of even groups, of odd groups]} by groups of near copies."""
        held = {}
        for text, toxic in texts:
            words = toxicity.words_of(text)
            for u in units(words):
                held.setdefault(u, set()).add((toxicity.group_of(words), toxic))
        return {u: [[sum(g % 2 == h and t == label for g, t in s) for label in (0, 1)] for h in (0, 1)] for u, s in held.items()}

    total = lambda c, label: c[0][label] + c[1][label]
    words = support(lambda w: {"", *w})
    n_clean, n_tox = total(words[""], 0), total(words[""], 1)
    odds = lambda c: ((total(c, 1) + 0.5) / max(1, n_tox)) / ((total(c, 0) + 0.5) / max(1, n_clean))
    kept = {w: c for w, c in words.items() if total(c, 0) + total(c, 1) >= min_groups}
    candidates = {w for w, c in kept.items() if total(c, 1) >= min_groups and odds(c) >= min_odds / 4 and len(w) > 1}
    pairs = support(lambda w: {f"{x} {y}" for x, y in zip(w, w[1:]) if x in candidates or y in candidates})
    safe = {p for p, c in pairs.items() if total(c, 0) >= max(3, min_groups) and odds(c) < 1}

    def outside(w):
        inside = {k for i in range(len(w) - 1) if f"{w[i]} {w[i + 1]}" in safe for k in (i, i + 1)}
        return {x for i, x in enumerate(w) if i not in inside and x in candidates}

    left = support(outside)
    limits = (min_groups, min_odds, false_terms, max_terms)
    pick = lambda of: toxicity.choose([(w, of(c, 1), of(c, 0)) for w, c in left.items()], of(words[""], 1), of(words[""], 0), len(kept), *limits)
    terms, halves = pick(total), [pick(lambda c, label, h=h: c[h][label]) for h in (0, 1)]
    learned = set(terms) | set(halves[0]) | set(halves[1])
    return terms, {p for p in safe if set(p.split(" ")) & learned}


def plain_density(text, terms, exceptions):
    """Weight of the text's words that are terms outside exception phrases, per word, on texts of words and blanks."""
    w = toxicity.words_of(text)
    inside = {k for i in range(len(w) - 1) if f"{w[i]} {w[i + 1]}" in exceptions for k in (i, i + 1)}
    return sum(terms.get(x, 0) for i, x in enumerate(w) if i not in inside) / max(1, len(w))


def test_the_lexicon_equals_a_plain_count(spark):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(120)]
    data, marks = [], []
    for i in range(500):
        toxic = i % 4 == 0
        text = rng.choices(words, k=rng.randint(5, 40)) + rng.choices(["zork", "TRASH", "tr4sh", "blat"], k=2) * toxic
        if i % 8 == 1:
            text += ["zork", "plant"]  # raw odds under 8
        if i % 9 == 2:
            text += ["big", "blat"]
        rng.shuffle(text) if toxic else None
        data.append((i, " ".join(text), None, None, None))
        marks.append((i, int(toxic)))
    data += [(500 + i, t, None, None, None) for i, (_, t, *_) in enumerate(data[:60])]  # copies
    marks += [(500 + i, m) for i, (_, m) in enumerate(marks[:60])]
    docs, labels = frame(spark, data), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    terms, exceptions = plain_fit([(t, dict(marks)[d]) for d, t, *_ in data])
    assert {"zork", "trash", "blat"} <= set(terms) and {"zork plant", "big blat"} <= exceptions
    assert model.terms == pytest.approx(terms) and set(model.exceptions) == exceptions
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for d, t, *_ in data:
        x = plain_density(t, terms, exceptions)
        assert got[d] == pytest.approx(x / (x + model.scale)), d
