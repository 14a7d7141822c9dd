"""SimHash near-duplicates: fingerprints of word shingles, linked within a few differing bits.

1. Every text gets a 64-bit fingerprint; documents with equal fingerprints are one node from then on.
2. Two fingerprints at most ``radius`` bits apart agree on all but ``radius`` of ``blocks`` bit blocks.
   So a node is dealt to one shard for each choice of ``blocks - radius`` blocks, keyed by their bits:
   every link lies inside some shard, and no other candidates are looked at.
3. A shard is held in BK-trees (children keyed by integer Hamming distance to the parent). A search
   follows only edges within the radius of the query's distance. No tree holds more than
   ``tree_size`` nodes: a larger shard is dealt to several trees, and each pair of them meets in a
   task of its own, so a task's memory is bounded and no link is lost.
4. A task does not emit its links but a spanning forest of them (at most one edge per node); components
   follow by repeated minimum over the neighbours and label jumping, on tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valorum.llm.common import fresh, ready, stored, text_of

SEED = 42


def simhash(text: str | None, words: int = 3) -> int:
    """The fingerprint as a signed 64-bit integer.

    A-Z lower-cased, words are runs of anything but ASCII white space, shingles are space-joined with
    repeats, XXH64 with seed 42; a bit is set if it is set in over half the shingle hashes. Fewer words
    than a shingle: the whole sequence is the shingle. No words: 0.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    flat = b" ".join(parts)
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(flat, SEED)]
    else:
        ends = np.cumsum([len(p) + 1 for p in parts])
        starts = (ends[:len(parts) - words + 1] - [len(p) + 1 for p in parts[:len(parts) - words + 1]]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(flat[a:b], SEED) for a, b in zip(starts, (ends[words - 1:] - 1).tolist())]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        block = np.array(hashes[i:i + 65_536], dtype="<u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


class BKTree:
    """A BK-tree over distinct 64-bit integers, searched for many queries at once."""

    def __init__(self, values: np.ndarray):
        self.values = values.astype(np.uint64)
        kids: list[dict[int, int]] = [{} for _ in range(len(values))]
        vals = self.values.tolist()
        for i in range(1, len(vals)):
            at, v = 0, vals[i]
            while True:
                edge = (vals[at] ^ v).bit_count()
                nxt = kids[at].get(edge)
                if nxt is None:
                    kids[at][edge] = i
                    break
                at = nxt
        self.count = np.array([len(k) for k in kids], np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.count)[:-1])) if len(kids) else self.count
        self.edge = np.array([e for k in kids for e in k], np.int64)
        self.child = np.array([c for k in kids for c in k.values()], np.int64)

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query index, node index) at most ``radius`` apart."""
        q = np.arange(len(queries))
        node = np.zeros(len(queries), np.int64)
        hits_q, hits_n = [], []
        while len(q) and len(self.values):
            dist = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
            near = dist <= radius
            hits_q.append(q[near])
            hits_n.append(node[near])
            n = self.count[node]
            slot = np.repeat(self.first[node] - np.cumsum(n) + n, n) + np.arange(n.sum())
            keep = np.abs(self.edge[slot] - np.repeat(dist, n)) <= radius
            q, node = np.repeat(q, n)[keep], self.child[slot[keep]]
        none = np.zeros(0, np.int64)
        return (np.concatenate(hits_q), np.concatenate(hits_n)) if hits_q else (none, none)


def forest(values: np.ndarray, tree_of: np.ndarray, queries: np.ndarray, radius: int,
           step: int = 512) -> list[tuple[int, int]]:
    """Edges (positions in ``values``) that connect what the links between trees and queries connect."""
    parent = np.arange(len(values))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    edges = []
    tree = BKTree(values[tree_of])
    for i in range(0, len(queries), step):
        block = queries[i:i + step]
        q, n = tree.search(values[block].astype(np.uint64), radius)
        a, b = block[q], tree_of[n]
        while len(a):
            while (parent[parent] != parent).any():
                parent = parent[parent]
            ra, rb = parent[a], parent[b]
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            if not len(a):
                break
            # One link of each pair of roots; roots change as they are joined, so look again.
            _, one = np.unique(np.minimum(ra, rb) * len(values) + np.maximum(ra, rb), return_index=True)
            for x, y in zip(a[one].tolist(), b[one].tolist()):
                rx, ry = root(x), root(y)
                if rx != ry:
                    parent[max(rx, ry)] = min(rx, ry)
                    edges.append((x, y))
    return edges


def _fingerprint_rows(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["fp"] = np.array([simhash(t, words) for t in b.pop("text")], np.int64)
            yield b
    return run


def _tree_edges(radius: int):
    """Rows come sorted by shard; a shard is one or two trees' nodes (side 0 and 1)."""
    def solve(fp: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1)
        values = fp.astype(np.uint64)
        got = forest(values, left, right if len(right) else left, radius)
        a, b = (np.array(x, np.int64) for x in zip(*got)) if got else (np.zeros(0, np.int64),) * 2
        return fp[a], fp[b]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        key = None

        def flush():
            fp, side = (np.concatenate(x) for x in zip(*held))
            return solve(fp, side) if len(fp) > 1 else (fp[:0], fp[:0])

        for b in batches:
            shard, fp, side = b["shard"].to_numpy(), b["fp"].to_numpy(), b["side"].to_numpy()
            out_a, out_b = [], []
            cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))).tolist() if len(b) else []
            for s, e in zip(cuts, [*cuts[1:], len(b)]):
                if shard[s] != key:
                    if held:
                        x, y = flush()
                        out_a.append(x)
                        out_b.append(y)
                    held, key = [], shard[s]
                held.append((fp[s:e], side[s:e]))
            if out_a:
                yield pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})
        if held:
            x, y = flush()
            yield pd.DataFrame({"a": x, "b": y})
    return run


def fingerprint_links(nodes: DataFrame, radius: int = 3, blocks: int = 5, tree_size: int = 2048) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose components are those of all links."""
    bounds = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = [sum(1 << bit for i in chosen for bit in range(bounds[i], bounds[i + 1]))
             for chosen in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(signed)])
    dealt = nodes.select("fp", F.explode(keys).alias("shard"))
    # Shards of one node have no links; large ones are dealt to several trees.
    sizes = (dealt.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > 1)
             .withColumn("trees", F.ceil(F.col("n") / tree_size).cast("int")))
    held = stored(dealt.join(sizes, "shard"), "shards")
    own = F.pmod(F.xxhash64(F.lit(7), "fp"), F.col("trees")).cast("int")
    held = held.withColumn("own", own)
    # Tree i meets tree j (i <= j): its nodes are the tree (side 0) there, those of j the queries (side 1).
    meets = F.transform(F.sequence(F.lit(0), F.col("trees") - 1), lambda j: F.struct(
        F.least("own", j).alias("i"), F.greatest("own", j).alias("j"),
        F.when(F.col("own") <= j, 0).otherwise(1).alias("side")))
    pairs = held.select("fp", "shard", F.explode(meets).alias("m")).select(
        "fp", F.xxhash64("shard", "m.i", "m.j").alias("shard"), "m.side")
    return (pairs.repartition("shard").sortWithinPartitions("shard", "side", "fp")
            .mapInPandas(_tree_edges(radius), "a long, b long"))


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(fp, root) for every fp that has an edge; root is one fp of its component.

    Each round takes the least label among a node and its neighbours, then jumps to that label's own
    label, so chains shrink by more than half. It ends when no label changes.
    """
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct()
    both = stored(both, "links")
    label = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "fp"),
                   "labels")
    for _ in range(max_rounds):
        seen = both.join(label, F.col("b") == F.col("fp")).groupBy("a").agg(F.min("root").alias("near"))
        least = (label.join(seen, F.col("fp") == F.col("a"))
                 .select("fp", F.col("root").alias("old"), F.least("root", "near").alias("mid")))
        jump = label.select(F.col("fp").alias("mid"), F.col("root").alias("next"))
        new = stored(least.join(jump, "mid").select("fp", "old", F.least("mid", "next").alias("root")), "labels")
        changed = new.where("root <> old").limit(1).count()
        label = new.select("fp", "root")
        if not changed:
            return label
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _classes(docs: DataFrame, id_col: str, text_col: str, words: int, radius: int, blocks: int,
             tree_size: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, mark, fp), and (fp, root, first) per fingerprint: first is the component's least (doc_id, mark).

    mark is a hash of the text; a null id comes after all others.
    """
    spark = docs.sparkSession
    ready(spark)
    id_type = dict(docs.dtypes)[id_col]
    text = text_of(text_col)
    prints = stored(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
                    .mapInPandas(_fingerprint_rows(words), f"doc_id {id_type}, mark long, fp long"), "simhash")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    nodes = prints.groupBy("fp").agg(F.min(row).alias("least"))
    roots = components(nodes, fingerprint_links(nodes.select("fp"), radius, blocks, tree_size))
    grouped = nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    firsts = grouped.groupBy("root").agg(F.min("least").alias("first"))
    return prints, grouped.select("fp", "root").join(firsts, "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                    radius: int = 3, blocks: int = 5, tree_size: int = 2048) -> DataFrame:
    """One row per input row: doc_id, fp (long), component_id (smallest id reachable, itself included).

    Null and empty texts have fingerprint 0 and link like any other. Null ids are carried; they are
    never smallest unless a component has no other id. Repeated rows each give their row. An
    empty table gives an empty result; other columns are ignored.
    """
    prints, classes = _classes(docs, id_col, text_col, words, radius, blocks, tree_size)
    return prints.join(classes, "fp").select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3,
             blocks: int = 5, tree_size: int = 2048) -> DataFrame:
    """One input row of each component, all columns as they are: that of the smallest id.

    Among rows of one id the least text hash stays, of equal rows one. Documents without a near copy stay. Texts move once,
    by (id, text hash), which no group of copies makes hot.
    """
    _, classes = _classes(docs, id_col, text_col, words, radius, blocks, tree_size)
    key = fresh("row_key", docs.columns)

    def row_key(doc: Column, mark: Column) -> Column:
        return F.concat_ws(":", F.coalesce(doc.cast("string"), F.lit("null")), mark.cast("string"))

    firsts = classes.groupBy("root").agg(F.first("first").alias("first"))
    kept = firsts.select(row_key(F.col("first.doc_id"), F.col("first.mark")).alias(key))
    rows = docs.withColumn(key, row_key(F.col(f"`{id_col}`"), F.xxhash64(text_of(text_col))))
    return rows.join(kept, key, "left_semi").dropDuplicates([key]).select(*[F.col(f"`{c}`") for c in docs.columns])
