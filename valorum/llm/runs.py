"""Runs of repeated words: longest common extensions on a difference cover, enumerated on harmonic grids.

A run is a stretch of words with smallest period q, at least ``max(least, times * q)`` long, that no neighbouring
word extends keeping period q. A text's runs are found without looking at all pairs of places:

* **Grid.** For a period q, words q apart are equal all along a run. That stretch of equalities is at least
  ``(times - 1) * q`` long, so places that far apart meet every run; over all periods they are n log n places. A
  place whose few neighbours already rule out a stretch long enough is passed over.
* **Extension.** From a place that remains, the run reaches as far as the suffixes at i and i + q agree, forward and
  (on the reversed text) backward.
* **Difference cover.** Only suffixes at places whose remainder modulo 13 is in {0, 1, 3, 9} are sorted. Any two
  places reach two such places after the same number of words, at most 12; these few are compared
  one by one, the rest is a range minimum (sparse table) over the common prefixes of neighbours in the sorted sample.

Extensions are exact, so the runs are. A multiple of a run's smallest period gives the same stretch again; the
smallest period, which comes first, stays.

Words are runs of anything but ASCII white space. Documents are worked on in blocks of about ``BLOCK`` words; a
longer one is a block of its own, so memory follows the longest document (some 300 bytes a word). Null and
empty texts have no runs and collapse to the empty string. Rows that are repeated are returned each; null ids are
carried; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valorum.llm.common import WORD, fresh, pick, ready, text_of

V = 13
COVER = (0, 1, 3, 9)  # every difference modulo 13 is one between two of these
BLOCK = 400_000
QUERIES = 1 << 18
FEW = 6  # words in a row that must be equal before an extension is asked for

OFFSET = np.full(V, -1)
OFFSET[list(COVER)] = range(len(COVER))
# SYNC[a, b]: the least d with a + d and b + d both in the cover.
SYNC = np.array([[next(d for d in range(V) if OFFSET[(a + d) % V] >= 0 and OFFSET[(b + d) % V] >= 0)
                  for b in range(V)] for a in range(V)])


class Extensions:
    """Longest common extensions of suffixes of one document within an array of documents.

    ``words``: word numbers from 1, a 0 after each document; ``docs``: the document of each place (of a 0, the one
    before it). Suffixes of one document always differ, at the latest at its 0.
    """

    def __init__(self, words: np.ndarray, docs: np.ndarray):
        self.words = np.concatenate([words, np.zeros(V, words.dtype)])
        blocks = -(-len(words) // V)
        places = (np.arange(blocks)[:, None] * V + np.array(COVER)).ravel()
        self.count = int(np.searchsorted(places, len(words)))
        places = places[:self.count]
        levels = self.sort(places, docs)
        order = np.argsort(levels[-1], kind="stable")
        self.rank = np.empty(self.count, np.int64)
        self.rank[order] = np.arange(self.count)
        self.table = self.minima(self.common(places[order], docs, levels))

    def number(self, places: np.ndarray) -> np.ndarray:
        """Places of the cover as numbers in the sample."""
        return places // V * len(COVER) + OFFSET[places % V]

    def sort(self, places: np.ndarray, docs: np.ndarray) -> list[np.ndarray]:
        """Ranks of the sampled suffixes by document and their first V, 2V, 4V, ... words, until all differ."""
        bits = max(1, int(self.words.max()).bit_length())
        each = max(1, 62 // bits)
        keys = [docs[places]]
        for first in range(0, V, each):
            key = np.zeros(len(places), np.int64)
            for k in range(first, min(first + each, V)):
                key = (key << bits) | self.words[places + k]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.ones(len(places), bool)
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
        rank = np.empty(len(places), np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))
        levels, span = [rank], V
        while True:
            # Only groups of more than one are sorted again, by what follows their common words.
            size = np.bincount(rank, minlength=len(places))
            open_ = np.flatnonzero(size[rank] > 1)
            if not len(open_):
                return levels
            after = rank[self.number(places[open_] + span)]
            order = np.lexsort([after, rank[open_]])
            group, after = rank[open_][order], after[order]
            head = np.ones(len(order), bool)
            head[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
            start = np.ones(len(order), bool)
            start[1:] = group[1:] != group[:-1]
            at = np.arange(len(order))
            inside = np.maximum.accumulate(np.where(head, at, 0)) - np.maximum.accumulate(np.where(start, at, 0))
            rank = rank.copy()
            rank[open_[order]] = group + inside
            levels.append(rank)
            span *= 2

    def common(self, places: np.ndarray, docs: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Words that each sorted suffix shares with the one before it (0 between documents)."""
        if len(places) < 2:
            return np.zeros(len(places), np.int64)
        a, b, out = places[:-1].copy(), places[1:].copy(), np.zeros(len(places), np.int64)
        same = docs[a] == docs[b]
        got = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            step = V << k
            on = np.flatnonzero(same)
            on = on[levels[k][self.number(a[on])] == levels[k][self.number(b[on])]]
            got[on] += step
            a[on] += step
            b[on] += step
        on = np.flatnonzero(same)
        for _ in range(V):
            on = on[self.words[a[on]] == self.words[b[on]]]
            got[on] += 1
            a[on] += 1
            b[on] += 1
        out[1:] = got
        return out

    @staticmethod
    def minima(values: np.ndarray) -> list[np.ndarray]:
        table, width = [values.astype(np.int32)], 1
        while 2 * width <= len(values):
            last = table[-1]
            table.append(np.minimum(last[:-width], last[width:]))
            width *= 2
        return table

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of words that the suffixes at i and j (i < j) share."""
        sync, out = SYNC[i % V, j % V], np.zeros(len(i), np.int64)
        on = np.arange(len(i))
        reached = []
        for d in range(V):
            there = sync[on] == d
            reached.append(on[there])
            on = on[~there]
            on = on[self.words[i[on] + d] == self.words[j[on] + d]]
            out[on] = d + 1
        at = np.concatenate(reached)
        at = at[j[at] + sync[at] < len(self.words) - V]
        a, b = self.rank[self.number(i[at] + sync[at])], self.rank[self.number(j[at] + sync[at])]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((hi - lo).astype(float))[1] - 1
        for k in np.unique(level):
            on = np.flatnonzero(level == k)
            t = self.table[k]
            out[at[on]] = sync[at[on]] + np.minimum(t[lo[on]], t[hi[on] - (1 << k)])
        return out


def grid(words: np.ndarray, docs: np.ndarray, q: int, least: int, times: int) -> np.ndarray:
    """Places of period q's grid that may lie in a run: words q apart are equal there and for long enough around."""
    stretch = max((times - 1) * q, least - q)
    at = np.flatnonzero(words[:len(words) - q:stretch] == words[q::stretch]) * stretch
    at = at[docs[at] == docs[at + q]]
    if not len(at):
        return at
    need, length = min(stretch, FEW), np.ones(len(at), np.int64)
    for sign in (1, -1):
        on = np.arange(len(at))
        for k in range(1, need):
            p = at[on] + sign * k
            inside = (p >= 0) & (p + q < len(words))
            on, p = on[inside], p[inside]
            on = on[words[p] == words[p + q]]
            if not len(on):
                break
            length[on] += 1
    return at[length >= need]


def block_runs(words: np.ndarray, docs: np.ndarray, longest: int, least: int, times: int) -> np.ndarray:
    """(start, length, period) of every run, by place; a 0 stands before, between and after documents."""
    n = len(words)
    periods = range(1, longest // times + 1)
    marked = np.zeros(int(docs.max()) + 1, bool)
    for q in periods:
        marked[docs[grid(words, docs, q, least, times)]] = True
        if marked[:-1].all():
            break
    if not marked.any():
        return np.zeros((0, 3), np.int64)
    # Only documents that may have a run are sorted.
    keep = np.flatnonzero(marked[docs] | (words == 0))
    part, own = words[keep], docs[keep]
    ahead = Extensions(part, own)
    back_docs = own[::-1].copy()
    zero = part[::-1] == 0
    back_docs[1:][zero[1:]] = back_docs[:-1][zero[1:]]  # of a 0, the document before it in this order
    back_docs[0] = len(marked)
    back = Extensions(part[::-1], back_docs)
    found = np.zeros((0, 3), np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0

    def extend() -> np.ndarray:
        i, q = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        after = ahead(i, i + q)
        before = back(len(part) - i - q, len(part) - i)
        start, length = i - before, before + q + after
        good = length >= np.maximum(times * q, least)
        more = np.concatenate([found, np.column_stack([start, length, q])[good]])
        # The smallest period of a stretch comes first.
        _, first = np.unique(more[:, 0] * (len(part) + 1) + more[:, 1], return_index=True)
        return more[np.sort(first)]

    for q in periods:
        at = grid(part, own, q, least, times)
        if len(at):
            held.append((at, np.full(len(at), q)))
            waiting += len(at)
        if waiting >= QUERIES:
            found, held, waiting = extend(), [], 0
    if held:
        found = extend()
    found[:, 0] = keep[found[:, 0]]
    return found[np.lexsort([found[:, 2], found[:, 0]])]


def runs_of(texts: list[bytes], least: int, times: int) -> Iterator[tuple[np.ndarray, bytes]]:
    """Runs of each text (start, length, period; word numbers from 0) and its words without repeats, one blank apart."""
    split = [t.split() for t in texts]
    numbers: dict[bytes, int] = {}
    sizes = np.array([len(w) for w in split])
    words = np.zeros(int(sizes.sum()) + len(split) + 1, np.int64)
    starts = np.cumsum(sizes + 1) - sizes
    for w, s in zip(split, starts.tolist()):
        words[s:s + len(w)] = [numbers.setdefault(x, len(numbers) + 1) for x in w]
    docs = np.full(len(words), len(split))
    docs[1:] = np.repeat(np.arange(len(split)), sizes + 1)
    longest = int(sizes.max()) if len(sizes) else 0
    found = block_runs(words, docs, longest, least, times) if longest >= max(least, times) else np.zeros((0, 3), np.int64)
    edges = np.searchsorted(docs[found[:, 0]], np.arange(len(split) + 1))
    for k, w in enumerate(split):
        own = found[edges[k]:edges[k + 1]]
        if len(own):
            own = own - np.array([starts[k], 0, 0])
            mark = np.zeros(len(w) + 1, np.int64)
            np.add.at(mark, own[:, 0] + own[:, 2], 1)
            np.add.at(mark, own[:, 0] + own[:, 1], -1)
            w = [w[x] for x in np.flatnonzero(np.cumsum(mark)[:-1] == 0).tolist()]
        yield own, b" ".join(w)


def blocks(sizes: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """Numbers of texts, short ones first, in blocks of at most about ``limit`` bytes."""
    order = np.argsort(sizes, kind="stable")
    part = np.cumsum(sizes[order]) // limit
    yield from np.split(order, np.flatnonzero(np.diff(part)) + 1)


def with_runs(docs: DataFrame, text_col: str = "text", runs: str = "runs", collapsed: str = "collapsed",
              least: int = 6, times: int = 4) -> DataFrame:
    """The input rows with ``runs``, an array of (start, length, period) by start then period, and ``collapsed``.

    ``least`` is the least length of a run in words, ``times`` (3 or more) the least number of periods. ``collapsed`` holds the
    words, one blank apart, without those that some run holds after its first period.
    """
    if times < 3:
        raise ValueError("runs of fewer than three periods are not enumerated on this grid")
    ready(docs.sparkSession)
    text = fresh("runs_text", docs.columns)
    frame = docs.withColumn(text, text_of(text_col))
    frame = frame.withColumns({runs: F.array().cast("array<struct<start:long,length:long,period:long>>"), collapsed: F.lit("")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = [t.encode() for t in b[text]]
            out, kept = [None] * len(raw), [""] * len(raw)
            for some in blocks(np.array([len(t) for t in raw], np.int64), BLOCK * 6) if raw else ():
                for at, (own, rest) in zip(some, runs_of([raw[x] for x in some], least, times)):
                    out[at] = [{"start": s, "length": n, "period": q} for s, n, q in own.tolist()]
                    kept[at] = rest.decode()
            yield b.assign(**{runs: pd.Series(out, index=b.index, dtype=object), collapsed: kept}).drop(columns=[text])

    return frame.mapInPandas(run, frame.drop(text).schema)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """One row per input row: doc_id, runs, collapsed (see :func:`with_runs`)."""
    return with_runs(pick(docs, doc_id=id_col, text=text_col), "text", least=least, times=times).select("doc_id", "runs", "collapsed")


def plant(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text; the texts of every tenth id become periodic from some word on.

    With h the crc32 of the id in decimal and g = floor(h / 10): where h % 10 = 0, each word i >= a of n becomes word
    a + (i - a) % p, with a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). Null ids are left alone.
    """
    base = pick(docs, doc_id=id_col, text=text_col)
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(F.coalesce(h % 10 == 0, F.lit(False)), F.regexp_extract_all(text_of(), F.lit(WORD), F.lit(0)))
    base = base.withColumn("g", F.floor(h / 10)).withColumn("w", words)
    base = base.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    period = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))
    base = base.withColumn("p", period)
    i = F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)
    source = F.transform(i, lambda x: F.when(x < F.col("a"), x).otherwise(F.col("a") + (x - F.col("a")) % F.col("p")))
    changed = F.array_join(F.transform(source, lambda x: F.get(F.col("w"), x.cast("int"))), " ")
    return base.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Number of runs, the longest of them, and the digests of all runs and of the collapsed text."""
    def line(r: Column) -> Column:
        return F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))

    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    found = found.withColumn("best", best)
    length, period = F.col("best.length"), -F.col("best.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"),
        period.alias("period"), F.floor(length * 1000 / period).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
