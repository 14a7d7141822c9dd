"""Approximate nearest neighbours by an inverted multi-index, for the largest inner product.

Vectors are split into two halves, each quantised by its own ``centroids`` k-means codewords, so a cell
is a pair of codewords. The index holds every vector; only the codebooks are fitted on a bounded sample.
A query visits cells in the order of the summed nearness of its two halves to the two codewords (the
multi-sequence algorithm: a heap over the two sorted lists), until the cells visited hold a share of all
entries. Their exact inner products, in double precision, rank the answers.

The share follows from the data: a bounded sample of queries is searched among the vectors that the codebooks were
fitted on, and the share is the one by which ``recall`` of their true neighbours there had been visited. Vectors with
cluster structure need few of their entries, those without any need most of them.

Vectors that are equal are one entry of the index (a third of all rows may be copies of one): an entry
keeps its ``k + 1`` smallest ids, which is all that a ranking by (score, id) can ever take from it.

Entries lie in lists by first codeword. A long list is cut into pieces of at most about ``list_size``
entries, and the queries that visit it likewise, so every task sees a bounded block of each.
Broadcast: codebooks and the number of entries per cell, at most ``2 * centroids * dim`` doubles and
``centroids ** 2`` counts; ``centroids`` grows with the root of the number of entries, up to ``max_centroids``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from valorum.llm.common import ready, stored


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Plain Lloyd k-means; empty clusters keep their codeword."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        a = nearest(x, c)
        n = np.bincount(a, minlength=len(c))
        order = np.argsort(a, kind="stable")
        full = np.flatnonzero(n)
        sums = np.add.reduceat(x[order], (np.cumsum(n) - n)[full], axis=0)
        c[full] = sums / n[full, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, step: int = 8192) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmax(x[i:i + step] @ c.T - half, axis=1) for i in range(0, len(x), step)]
                          or [np.zeros(0, np.int64)])


def visit(a: np.ndarray, b: np.ndarray, counts: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Non-empty cells (i, j) in falling order of a[i] + b[j] until they hold ``enough`` entries."""
    oa, ob = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    sa, sb = a[oa].tolist(), b[ob].tolist()
    oa, ob = oa.tolist(), ob.tolist()
    heap = [(-(sa[0] + sb[0]), 0, 0)]
    found, held = [], 0
    while heap and held < enough:
        _, r, s = heapq.heappop(heap)
        n = int(counts[oa[r], ob[s]])
        if n:
            found.append((oa[r], ob[s]))
            held += n
        # Every pair is reached once: along its row, and rows open from the first column.
        if s + 1 < len(sb):
            heapq.heappush(heap, (-(sa[r] + sb[s + 1]), r, s + 1))
        if s == 0 and r + 1 < len(sa):
            heapq.heappush(heap, (-(sa[r + 1] + sb[0]), r + 1, 0))
    return found


def visited_share(x: np.ndarray, a: np.ndarray, b: np.ndarray, counts: np.ndarray, near: int, recall: float,
                  trials: int) -> float:
    """Share of all entries that a query visits until ``recall`` of its ``near`` nearest among ``x`` were visited.

    ``trials`` evenly spaced rows of ``x`` are the queries. ``counts`` are those of the whole index. Cells come in the order
    in which :func:`visit` takes them.
    """
    half = a.shape[1]
    i, j = nearest(x[:, :half], a), nearest(x[:, half:], b) if b.shape[1] else np.zeros(len(x), np.int64)
    reached = []
    for q in np.unique(np.linspace(0, len(x) - 1, min(trials, len(x))).astype(int)):
        scores = x @ x[q]
        scores[q] = -np.inf
        best = np.argsort(-scores, kind="stable")[:min(near, len(x) - 1)]
        order = np.argsort(-np.add.outer(a @ x[q, :half], b @ x[q, half:]).ravel(), kind="stable")
        held = np.empty(counts.size)
        held[order] = np.cumsum(counts.ravel()[order])
        reached.append(held[i[best] * len(b) + j[best]])
    every = np.sort(np.concatenate(reached)) if reached else np.zeros(0)
    if not len(every):
        return 1.0
    return float(every[min(len(every) - 1, int(np.ceil(recall * len(every))) - 1)] / max(1, counts.sum()))


def _matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors])


def _code_rows(a: np.ndarray, b: np.ndarray):
    half = a.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                x = _matrix(p["vec"])
                p["i"], p["j"] = nearest(x[:, :half], a).astype(np.int32), nearest(x[:, half:], b).astype(np.int32)
                yield p
    return run


def _visit_rows(a: np.ndarray, b: np.ndarray, counts: np.ndarray, enough: int):
    """A row for each list that a query visits, with the cells of that list as a bit mask."""
    half = a.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for s in range(0, len(p), 256):
                out = {"query": [], "vec": [], "i": [], "cells": []}
                part = p.iloc[s:s + 256]
                x = _matrix(part["vec"])
                near_a, near_b = x[:, :half] @ a.T, x[:, half:] @ b.T
                for n, (query, vec) in enumerate(zip(part["query"], part["vec"])):
                    seen = np.zeros(counts.shape, bool)
                    for i, j in visit(near_a[n], near_b[n], counts, enough):
                        seen[i, j] = True
                    for i in np.flatnonzero(seen.any(axis=1)):
                        for k, v in zip(out, (query, vec, int(i), np.packbits(seen[i]).tobytes())):
                            out[k].append(v)
                yield pd.DataFrame(out)
    return run


def _score_block(keep: int):
    """The ``keep`` best entries of a block for each query that visits it (exact scores, only visited cells)."""
    def run(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query": np.zeros(0, np.int64), "entry": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(entries) or not len(queries):
            return none
        entries = entries.sort_values("entry", kind="stable")
        e, ids, j = _matrix(entries["vec"]), entries["entry"].to_numpy(), entries["j"].to_numpy()
        out = []
        for s in range(0, len(queries), 256):
            part = queries.iloc[s:s + 256]
            q = _matrix(part["vec"])
            cells = np.unpackbits(np.stack([np.frombuffer(c, np.uint8) for c in part["cells"]]), axis=1)
            rough = np.where(cells[:, j] > 0, q @ e.T, -np.inf)
            # A margin beyond the rounding of the product keeps all that can be among the best.
            top = min(keep, len(e))
            edge = np.partition(rough, len(e) - top, axis=1)[:, len(e) - top]
            row, col = np.nonzero((rough >= (edge - 1e-9 * (1 + np.abs(edge)))[:, None]) & np.isfinite(rough))
            score = (q[row] * e[col]).sum(axis=1)
            found = pd.DataFrame({"query": part["query"].to_numpy()[row], "entry": ids[col], "score": score})
            found = found.sort_values(["query", "score", "entry"], ascending=[True, False, True])
            out.append(found.groupby("query").head(keep))
        return pd.concat(out) if out else none
    return run


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec) once each: finite, non-zero vectors of the most frequent length."""
    v = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"),
                       F.col(f"`{vec_col}`").cast("array<double>").alias("vec")).where(
        "vec_id is not null and vec is not null"
        " and forall(vec, x -> x is not null and abs(x) < double('inf')) and exists(vec, x -> x <> 0)")
    v = v.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))  # no negative zero
    sizes = v.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1)
    dim = sizes.first()
    return v.where(F.size("vec") == (dim.n if dim else 0)).groupBy("vec_id", "vec").agg(F.lit(1).alias("one")).drop("one")


def search(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
           centroids: int | None = None, share: float | None = None, least: int = 1000, fit_rows: int = 16_384,
           list_size: int = 4096, max_centroids: int = 1024, recall: float = 0.96, trials: int = 200) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest found, itself left out.

    ``is_query`` is a condition on vec_id. ``share`` of the entries (``least`` at least) are visited for a
    query; by default it is estimated for ``recall`` with ``trials`` queries from the fit list (see
    :func:`visited_share`). ``centroids`` of each half: by default the root of a sixteenth of the entries, 16 at
    least. Codebooks are fitted on about ``fit_rows`` entries, drawn by a hash. Null ids, null or zero vectors, those holding null or non-finite
    components or of another length than most take no part. Rows that repeat an (id, vector) count once; ties
    go to the smaller id. An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    ready(spark)
    empty = "query_id long, rank int, vec_id long, score double"
    all_ = stored(usable(vectors, id_col, vec_col), "ann-vectors")
    # Equal vectors: the k + 1 smallest ids, in two steps so that a vector held by many rows is no hot key.
    some = Window.partitionBy("vec", "salt").orderBy("vec_id")
    every = Window.partitionBy("vec").orderBy("vec_id")
    members = (all_.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(16)))
               .withColumn("no", F.row_number().over(some)).where(F.col("no") <= k + 1)
               .withColumn("no", F.row_number().over(every)).where(F.col("no") <= k + 1)
               .withColumn("entry", F.first("vec_id").over(every)).select("vec", "vec_id", "entry"))
    members = stored(members, "ann-members")
    entries = members.where("vec_id = entry").select("entry", "vec")
    n = entries.count()
    if not n:
        return spark.createDataFrame([], empty)

    keep_share = min(1.0, fit_rows / n)
    draw = F.pmod(F.xxhash64(F.lit(3), "entry"), F.lit(1 << 30)) < int(keep_share * (1 << 30))
    fit = entries.where(draw | (F.lit(n) <= fit_rows)).orderBy("entry").toPandas()
    x = _matrix(fit["vec"])
    half = (x.shape[1] + 1) // 2
    size = min(centroids or max(16, int(np.ceil((n / 16) ** 0.5))), max_centroids, len(x))
    # One component has no second half; a constant one changes no inner product.
    second = x[:, half:] if half < x.shape[1] else np.zeros((len(x), 0))
    a, b = kmeans(x[:, :half], size), kmeans(second, size) if second.shape[1] else np.zeros((1, 0))
    coded = stored(entries.mapInPandas(_code_rows(a, b), "entry long, vec array<double>, i int, j int"), "ann-codes")
    counts = np.zeros((len(a), len(b)), np.int64)
    for r in coded.groupBy("i", "j").count().collect():  # at most centroids ** 2 rows
        counts[r.i, r.j] = r["count"]

    queries = stored(all_.where(is_query).join(entries, "vec").select(F.col("vec_id").alias("query_id"), "entry"),
                     "ann-queries")
    searched = coded.join(queries.select("entry").distinct(), "entry", "left_semi")
    if share is None:
        # The neighbours asked for, as many as the fit list holds of them, but a few at least.
        share = visited_share(x, a, b, counts, max(5, -(-k * len(x) // n)), recall, trials if len(a) <= 128 else trials // 4)
    enough = max(least, int(np.ceil(share * n)))
    visits = searched.select(F.col("entry").alias("query"), "vec").mapInPandas(
        _visit_rows(a, b, counts, enough), "query long, vec array<double>, i int, cells binary")

    # Blocks: piece e of a list meets piece q of the queries.
    in_list = counts.sum(axis=1)
    pieces = F.element_at(F.lit([int(-(-c // list_size)) or 1 for c in in_list]), F.col("i") + 1)
    q_pieces = max(1, -(-queries.select("entry").distinct().count() // list_size))
    left = (coded.withColumn("e", F.pmod(F.xxhash64("entry"), pieces).cast("int"))
            .withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_pieces - 1)))))
    right = (visits.withColumn("q", F.pmod(F.xxhash64("query"), F.lit(q_pieces)).cast("int"))
             .withColumn("e", F.explode(F.sequence(F.lit(0), pieces - 1))))
    found = (left.groupBy("i", "e", "q").cogroup(right.groupBy("i", "e", "q"))
             .applyInPandas(_score_block(k + 1), "query long, entry long, score double"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "entry")
    found = found.withColumn("no", F.row_number().over(best)).where(F.col("no") <= k + 1)

    # Entries back to ids; k + 1 of them, since the query itself may be one.
    ids = found.join(members.select("entry", "vec_id"), "entry")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ids = ids.withColumn("no", F.row_number().over(best)).where(F.col("no") <= k + 1)
    answers = stored(ids.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("no", "vec_id", "score"))).alias("near"))
                     .withColumnRenamed("query", "entry"), "ann-answers")
    mine = queries.join(answers, "entry").select("query_id", F.slice(F.filter(
        "near", lambda r: r["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return mine.select("query_id", F.posexplode("near").alias("at", "r")).select(
        "query_id", (F.col("at") + 1).alias("rank"), "r.vec_id", "r.score")
