"""The units that op6 winnows: words, code points of unspaced scripts, single signs."""

import base64
import random

import brute
import pytest
from llm_cases import DOCS, frame, rows

from valorum.llm import winnow

TOP = (1 << 31) - 1


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)


def chosen(df, **args):
    return {r.doc_id: [(x >> 31, TOP - (x & TOP)) for x in r.chosen] for r in winnow.fingerprints(df, **args).collect()}


def test_fingerprints_equal_definition(spark):
    got = chosen(frame(spark))
    for d, t, *_ in rows():
        assert got[d] == brute.winnow(t), d
    small = winnow.with_winnow(frame(spark).select("doc_id", "text"), "text", "chosen", 2, 5, modulus=7).collect()
    texts = {d: t for d, t, *_ in rows()}
    for r in small:
        assert [(x >> 31, TOP - (x & TOP)) for x in r.chosen] == brute.winnow(texts[r.doc_id], 2, 5, modulus=7), r.doc_id


def test_edits_equal_definition(spark):
    data = [(d, t) for d, t, *_ in rows()]
    want = brute.edits(data)
    text = lambda f: ",".join(f"{h}@{p}" for h, p in f)
    got = winnow.compare_edits(frame(spark)).collect()
    assert len(got) == len(want)
    for r in got:
        _, _, own, changed, near, nxt = want[r.doc_id]
        assert (r.fingerprint, r.edited_fingerprint) == (text(own), text(changed)), r.doc_id
        assert r.near_edited == pytest.approx(near) and r.near_next == pytest.approx(nxt)


def _letters(first, n, seed):
    rng = random.Random(seed)
    return "".join(chr(first + rng.randrange(40)) for _ in range(n))


@pytest.mark.parametrize("passage", [
    _letters(0x4E00, 60, 1), _letters(0x3042, 60, 2), _letters(0x0E01, 60, 3),  # zh, ja, th: no sign at all
    base64.b64encode(random.Random(4).randbytes(1500)).decode(), "f(x[i],y[j])=g*h+k;" * 12,
])
def test_shifted_passage_without_spaces_is_found(spark, passage):
    shifts = range(1, 12)
    df = docs_of(spark, [passage, *[passage[:1] * n + passage for n in shifts]])
    got = {d: {h for h, _ in c} for d, c in chosen(df).items()}
    for n in shifts:
        assert got[0] & got[n], n
