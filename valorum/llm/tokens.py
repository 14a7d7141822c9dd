"""Token counts of whole documents; huge documents in overlapping chunks that are spliced exactly.

Documents up to ``chunk_chars`` code points are encoded whole. Longer ones are cut into chunks that
overlap; every chunk is encoded on its own, with offsets, on whichever executor it lands. A chunk's
first and last tokens may be wrong, because a cut can fall inside a word. Two neighbours are
spliced at a *proven stable common boundary*: a place in their overlap where

* both encodings have a token boundary, and
* a character that is no white space is followed by a white-space character. No match of the
  byte-level pre-tokenizer's pattern spans such a place (white space only ever opens a match), and a
  match that starts there depends on the text after it alone. So the left chunk is right up to it
  and the right chunk from it on.

An overlap that holds no such place is doubled until it does, at the latest at the end of the text.
Counts are additive: total = tokens of the last chunk + sum over seams of (left count - right count).
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valorum.llm.common import ready, text_of

# Not white space before, white space after (\x1c-\x1f: white space to Python only, so never used).
STABLE = re.compile(r"(?<=[^\s])(?=[^\S\x1c-\x1f])")
# Texts that go to the tokenizers library itself: its special strings, and runs so long that
# the other library's pattern engine or merge loop is slow on them.
LONG_RUN = re.compile(r"\S{2000}|\s{500}")


class ByteBpe:
    """Ids of a byte-level BPE ``tokenizers`` file, without added special tokens.

    ``ranks`` names the same vocabulary as tiktoken ranks. Texts without special strings and without
    very long runs are encoded with it (the same ids, several times faster); all others,
    and everything if it is None, by the tokenizers library.
    """

    def __init__(self, path: str, ranks: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else re.compile(r"(?!)")
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table,
                                          special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is not None and not self.special.search(text) and not LONG_RUN.search(text):
            return self.fast.encode_ordinary(text)
        return self.tok.encode(text, add_special_tokens=False).ids

    def count(self, text: str) -> int:
        return len(self.ids(text))

    def starts(self, text: str) -> np.ndarray:
        """The code point at which each token starts."""
        found = self.tok.encode(text, add_special_tokens=False).offsets
        return np.fromiter((a for a, _ in found), dtype=np.int64, count=len(found))


@lru_cache(maxsize=2)
def bpe(path: str, ranks: str | None) -> ByteBpe:
    """One tokenizer per worker process."""
    return ByteBpe(path, ranks)


def tokenizer_files(name: str = "byte_bpe_50k") -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken")


def cut(text: str, chunk: int, overlap: int) -> list[tuple[int, int, int]]:
    """Chunks of a text as (start, end, overlap with the one before).

    A chunk runs from its start to the end of its overlap with the next one. Overlaps are doubled
    until they hold a stable place; one that reaches the end of the text makes the chunk the last.
    """
    n, out, start, before = len(text), [], 0, 0
    while True:
        nxt, wide = start + chunk, overlap
        while nxt + wide < n and not STABLE.search(text, nxt + 1, nxt + wide - 1):
            wide *= 2
        if nxt + wide >= n:
            out.append((start, n, before))
            return out
        out.append((start, nxt + wide, before))
        start, before = nxt, wide


def _cut_rows(chunk: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, text in zip(b["key"], b["text"]):
                cuts = cut(text, chunk, overlap)
                for i, (s, e, before) in enumerate(cuts):
                    after = e - cuts[i + 1][0] if i + 1 < len(cuts) else 0
                    yield pd.DataFrame({"key": [key], "chunk": [i], "before": [before], "after": [after],
                                        "text": [text[s:e]]})
    return run


def _seam_rows(path: str, ranks: str | None):
    """Per chunk: a row for each of its seams (stable places and the tokens before each), and its total if last."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = bpe(path, ranks)
        for b in batches:
            out = {"key": [], "seam": [], "side": [], "places": [], "counts": [], "total": []}
            for key, chunk, before, after, text in zip(b["key"], b["chunk"], b["before"], b["after"], b["text"]):
                starts = tok.starts(text)

                def seam(no, side, base, width):
                    at = np.array([m.start() for m in STABLE.finditer(text, base + 1, base + width - 1)], np.int64)
                    index = np.searchsorted(starts, at)
                    ok = (index < len(starts)) & (starts[np.minimum(index, len(starts) - 1)] == at)
                    for k, v in zip(out, (key, no, side, (at[ok] - base).tolist(), index[ok].tolist(), 0)):
                        out[k].append(v)
                if before:
                    seam(chunk, "right", 0, before)
                if after:
                    seam(chunk + 1, "left", len(text) - after, after)
                else:
                    for k, v in zip(out, (key, -1, "last", [], [], len(starts))):
                        out[k].append(v)
            yield pd.DataFrame(out)
    return run


def _count_rows(path: str, ranks: str | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = bpe(path, ranks)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": b["n_bytes"],
                                "n_tokens": [tok.count(t) for t in b["text"]]})
    return run


def token_counts(docs: DataFrame, path: str, ranks: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text", limit: int = 512, chunk_chars: int = 32768,
                 overlap_chars: int = 512) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null text counts as empty: 0 bytes, 0 tokens. A null or repeated id is carried through; repeated
    rows each give their row. An empty table gives an empty result; other columns are ignored.
    Equal huge texts are encoded once (they meet by SHA-256). ``path``: a byte-level BPE file of
    the tokenizers library; ``ranks``: the same vocabulary for faster encoding.
    """
    ready(docs.sparkSession)
    id_type = dict(docs.dtypes)[id_col]
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    base = base.withColumns({"n_bytes": F.octet_length("text").cast("long"), "n": F.char_length("text")})
    short = (base.where(F.col("n") <= chunk_chars).select("doc_id", "n_bytes", "text")
             .mapInPandas(_count_rows(path, ranks), f"doc_id {id_type}, n_bytes long, n_tokens long"))

    long = base.where(F.col("n") > chunk_chars).withColumn("key", F.sha2("text", 256))
    chunks = (long.select("key", "text")
              .mapInPandas(_cut_rows(chunk_chars, overlap_chars),
                           "key string, chunk int, before int, after int, text string")
              .dropDuplicates(["key", "chunk"]))
    parts = chunks.mapInPandas(
        _seam_rows(path, ranks),
        "key string, seam int, side string, places array<int>, counts array<long>, total long")
    # The two sides of a seam meet in one small group; a seam is worth left count - right count.
    side = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    seams = parts.groupBy("key", "seam").agg(
        side("left", "places").alias("lp"), side("left", "counts").alias("lc"),
        side("right", "places").alias("rp"), side("right", "counts").alias("rc"), F.max("total").alias("total"))
    at = F.array_min(F.array_intersect("lp", "rp"))
    seams = seams.withColumn("at", at).select("key", F.when(F.col("seam") < 0, F.col("total")).otherwise(
        F.expr("coalesce(element_at(lc, cast(array_position(lp, at) as int))"
               " - element_at(rc, cast(array_position(rp, at) as int)),"
               " raise_error('no common token boundary in an overlap'))").cast("long")).alias("n"))
    totals = seams.groupBy("key").agg(F.sum("n").alias("n_tokens"))
    huge = long.select("doc_id", "n_bytes", "key").join(totals, "key").select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(huge).withColumn("over_limit", F.col("n_tokens") > limit)
