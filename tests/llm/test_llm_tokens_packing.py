import random
import zlib

import numpy as np
import pytest
from llm_cases import clashing, empty, frame, rows
from tokenizers import Tokenizer

from valorum.llm import packing, tokens

JSON, RANKS = tokens.tokenizer_files()


@pytest.fixture(scope="module")
def ids():
    tok = Tokenizer.from_file(JSON)
    return {d: tok.encode(t or "", add_special_tokens=False).ids for d, t, *_ in rows()}


def test_fast_encoding_equals_the_library():
    tok, own = Tokenizer.from_file(JSON), tokens.bpe(JSON, RANKS)
    rng = random.Random(3)
    alphabet = list("ab Z9.'\n\t\r\x0b\x1c\x1f\x85  　éß你😀-_@") + ["'s", "'ll", "  ", "\n\n", "<|endoftext|>", " the"]
    for _ in range(1500):
        t = "".join(rng.choices(alphabet, k=rng.randint(0, 60)))
        assert own.ids(t) == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_chunk_cuts_cover_and_widen():
    for text, chunk, overlap in (("ab " * 500, 100, 8), ("x" * 1000, 100, 8), ("a" * 300 + " " + "b" * 300, 50, 4), ("", 10, 2)):
        cuts = tokens.cut(text, chunk, overlap)
        assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
        for (s, e, _), (s2, _, before) in zip(cuts, cuts[1:]):
            assert s2 == s + chunk and e - s2 == before and tokens.STABLE.search(text, s2 + 1, e - 1)


@pytest.mark.parametrize("chunk,overlap", [(32768, 512), (300, 16), (64, 4)])
def test_counts_equal_the_library(spark, ids, chunk, overlap):
    got = tokens.token_counts(frame(spark), JSON, RANKS, chunk_chars=chunk, overlap_chars=overlap).collect()
    assert len(got) == len(ids)
    text = {d: t or "" for d, t, *_ in rows()}
    for r in got:
        assert (r.n_bytes, r.n_tokens) == (len(text[r.doc_id].encode()), len(ids[r.doc_id])), r.doc_id
        assert r.over_limit == (r.n_tokens > 512)


def test_counts_odd_tables(spark):
    assert tokens.token_counts(empty(spark), JSON, RANKS).count() == 0
    data = [(None, "ab cd " * 100, None, None, None)] * 5 + [(7, None, None, None, None)] * 2
    got = tokens.token_counts(clashing(frame(spark, data)), JSON, None, chunk_chars=100, overlap_chars=8).collect()
    want = len(Tokenizer.from_file(JSON).encode("ab cd " * 100).ids)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, want)] * 5 + [(7, 0)] * 2


def check_packed(got, ids, size=1024, end=2):
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for d, pieces in by_doc.items():
        want, pos = [*ids[d], end], 0
        pieces.sort(key=lambda r: r.piece)
        for i, r in enumerate(pieces):
            part = np.array(want[r.start:r.start + r.length], "<u4")
            assert (r.piece, r.start, r.length) == (i, pos, len(part)) and r.ids_crc32 == zlib.crc32(part.tobytes())
            assert i == 0 or r.length == size
            pos += r.length
        assert pos == len(want) and (len(want) > size or len(pieces) == 1)
    for seq in by_seq.values():
        pos = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == pos
            pos += r.length
        assert pos <= size
    return len(by_seq), -(-sum(len(v) + 1 for v in ids.values()) // size)


def test_pack_whole_documents(spark, ids):
    n, least = check_packed(packing.pack(frame(spark), JSON, RANKS).collect(), ids)
    assert n <= least + 2


def test_pack_odd_tables(spark):
    assert packing.pack(empty(spark), JSON, RANKS).count() == 0
    data = [(None, None, None, None, None)] * 3 + [(4, "", None, None, None), (5, "same text", None, None, None), (5, "same text", None, None, None)]
    got = packing.pack(clashing(frame(spark, data)), JSON, RANKS, size=8, pieces_per_task=2).collect()
    assert len(got) == 6 and sorted(r.length for r in got) == [1, 1, 1, 1, 3, 3]


def test_best_fit_bound_and_quality():
    rng = random.Random(1)
    lengths = [rng.randint(1, 600) for _ in range(20000)]
    for bound, most in ((1, 1.4), (64, 1.05), (4096, 1.03)):
        p, used = packing.BestFit(1024, bound), {}
        for n in lengths:
            no, at = p.put(n)
            assert used.get(no, 0) == at
            used[no] = at + n
            assert p.n_open <= bound and used[no] <= 1024
        assert len(used) == p.n_bins <= most * sum(lengths) / 1024
    small = packing.BestFit(10, 8)
    assert [small.put(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]  # the tightest fit
    full = packing.BestFit(10, 2)
    assert [full.put(n) for n in (6, 7, 8, 3)] == [(0, 0), (1, 0), (2, 0), (1, 7)]  # the third is fullest and closes
    with pytest.raises(ValueError):
        small.put(11)
