"""op13: gradients against differences, whole texts against pieces, and accuracy on labels it never saw."""

import random

import numpy as np
import pytest
from llm_cases import DOCS, clashing, empty, frame

from valorum.llm import quality
from valorum.llm.queries import QUERIES, seen_label


def plain_logit(net, text):
    """The network written out for one text, byte by byte."""
    codes = list(text)
    begins = range(0, max(1, len(codes) - quality.CHUNK + quality.STEP), quality.STEP) if codes else []
    hidden = []
    for b in begins:
        chunk = (codes[b:b + quality.CHUNK] + [quality.PAD] * quality.CHUNK)[:quality.CHUNK]
        top = np.full(quality.FILTERS, -np.inf)
        for p in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE):
            top = np.maximum(top, net.embed[chunk[p:p + quality.WIDTH]].ravel() @ net.filters)
        hidden.append(np.maximum(np.maximum(top + net.bias, 0) @ net.hidden + net.hidden_bias, 0))
    h = np.array(hidden) if hidden else np.zeros((1, quality.HIDDEN))
    return float(np.concatenate([h.max(0), h.mean(0)]) @ net.out + net.out_bias[0])


@pytest.fixture(scope="module")
def net():
    return quality.Network.start(np.random.default_rng(9))


def test_scores_cover_whole_texts(net):
    rng = random.Random(1)
    sizes = [0, 1, 7, 8, 127, 128, 129, 240, 241, 5000]
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in sizes]
    assert net.logits(texts) == pytest.approx([plain_logit(net, t) for t in texts], abs=1e-4)
    block, counts = quality.chunks(texts)
    for t, part in zip(texts, np.split(block, np.cumsum(counts)[:-1])):
        seen = np.zeros(len(t), bool)
        for i, row in enumerate(part):
            own = row[row != quality.PAD]
            assert bytes(own.tolist()) == t[i * quality.STEP:i * quality.STEP + quality.CHUNK]
            seen[i * quality.STEP:i * quality.STEP + quality.CHUNK] = True
        assert seen.all()
    # What stands last in a very long text counts, in whatever group it is scored.
    long = b"a" * (3 << 20)
    one = net.logits([long + b"zqxj" * 30, b"x", long])
    assert one[0] != one[2] and one == pytest.approx(np.concatenate([net.logits([t]) for t in (long + b"zqxj" * 30, b"x", long)]), abs=1e-4)


def test_gradients_equal_differences(net):
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 105, n).tolist()) for n in (300, 90, 500)]
    block, counts = quality.chunks(texts)
    y, weight = np.array([1, 0, 1], np.float32), np.array([0.5, 1.0, 0.7], np.float32)
    grads = quality.gradients(net, block, counts, y, weight)

    def loss():
        z = np.array([plain_logit(net, t) for t in texts])
        return float((weight * (np.logaddexp(0, z) - y * z)).sum())

    for name, g in zip(quality.Network.NAMES, grads):
        part = getattr(net, name)
        assert g.shape == part.shape
        strong = np.argsort(-np.abs(g).ravel())[:3]
        for at in strong:
            at = np.unravel_index(at, part.shape)
            held, step = part[at], 2e-3
            part[at] = held + step
            up = loss()
            part[at] = held - step
            down = loss()
            part[at] = held
            assert (up - down) / (2 * step) == pytest.approx(float(g[at]), rel=0.1, abs=2e-3), name


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_held_out_accuracy(spark, sf):
    folder = f"/root/testdata/{sf}"
    got = QUERIES["op13_byte_cnn_quality"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").toPandas()
    low, found = got.quality == 0, got.predicted == 0
    assert (low & found).sum() / low.sum() >= 0.9 and (low & found).sum() / found.sum() >= 0.9
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_learning_and_odd_tables(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 7)))
    data, marks = [], []
    for i in range(240):
        good = i % 3 > 0
        text = " ".join(word() for _ in range(60)) if good else (word() + " ") * 60
        data.append((i, text, None, None, None))
        marks.append((i, None if i % 40 == 39 else int(good)))
    data += data[:2] + [(None, "x y", None, None, None), (900, None, None, None, None), (901, "", None, None, None)]
    labels = clashing(spark.createDataFrame([*marks, (None, 1), (5000, 0), (1, 7), (900, 0)], "doc_id long, quality int"))
    docs = clashing(frame(spark, data))
    net = quality.fit(docs, labels, seen_label(), max_rows=60)
    got = quality.score(docs, net).collect()
    assert len(got) == len(data)
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in got if r.doc_id is not None and r.doc_id < 900) >= 236
    assert len({r.score for r in got if r.doc_id in (900, 901)}) == 1
    kept = quality.with_quality(docs, net, score="quality_score")
    assert kept.columns == [*docs.columns, "quality_score"]
    again = {(r.doc_id, r.score) for r in quality.score(docs, quality.fit(docs.repartition(7), labels, seen_label(), max_rows=60)).collect()}
    assert again == {(r.doc_id, r.score) for r in got}
    assert quality.score(empty(spark), net).count() == 0
    assert quality.score(frame(spark), net).where("score is null or score < 0 or score > 1").count() == 0
    bare = quality.fit(empty(spark), labels, seen_label())
    assert quality.score(docs, bare).where("predicted = 1").count() == len(data)
    lows = quality.fit(docs, labels.where("quality = 0"), seen_label())
    assert quality.score(docs, lows).where("predicted = 0").count() == len(data)


def test_the_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, f"text {i % 50} " * (1 + i % 3), None, None, None) for i in range(400)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    some = quality.sample(docs, labels, seen_label(), "doc_id", "text", "quality", 20, 24).collect()
    assert sum(r.label == 0 for r in some) == sum(r.label == 1 for r in some) == 20
    assert len({(r.label, r.text) for r in some}) == 40 and max(len(r.text) for r in some) <= 24
