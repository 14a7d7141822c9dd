"""Best-fit packing of documents into sequences of a fixed token length.

Bounded-space online best-fit: a packer sees pieces one at a time and keeps at most ``open_bins``
unfinished sequences in stacks keyed by free space. An integer used as a bitset marks the free
spaces that occur; the tightest fit is its lowest set bit at or above the piece's length. When
a new sequence would exceed the bound, the fullest open one closes.

Pieces are tokenized where the documents lie; only (id, position, length, checksum) is shuffled, dealt
evenly whatever the ids are. Every task packs about ``pieces_per_task`` pieces, longest first, so the
sequences left open at a task's end are few beside those it fills. Dealing and order follow from the
stored pieces alone: a lost task repeated elsewhere gives the same sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valorum.llm.common import ready, stored, text_of
from valorum.llm.tokens import bpe


class BestFit:
    """Bounded-space best-fit over bins of ``size``; ``put`` returns (bin, offset)."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.open_bins = size, open_bins
        self.bits = 0  # bit f is set when a bin with f free tokens is open
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]
        self.n_open = self.n_bins = 0

    def _pop(self, free: int) -> int:
        stack = self.bins[free]
        got = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return got

    def put(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self.size:
            raise ValueError(f"a piece of {length} tokens cannot be placed in {self.size}")
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            no = self._pop(free)
        else:
            free, no = self.size, self.n_bins
            self.n_bins += 1
        left = free - length
        if left:
            if self.n_open == self.open_bins:  # the fullest closes, which may be this one
                least = (self.bits & -self.bits).bit_length() - 1
                if left <= least:
                    return no, self.size - free
                self._pop(least)
            self.bins[left].append(no)
            self.bits |= 1 << left
            self.n_open += 1
        return no, self.size - free


def pieces_of(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only a longer document is cut, its first piece takes the rest."""
    if n <= size:
        return [(0, n)]
    head = n % size
    starts = ([0] if head else []) + list(range(head, n, size))
    return [(s, (head if head and s == 0 else size)) for s in starts]


def _piece_rows(path: str, ranks: str | None, end_id: int, size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = bpe(path, ranks)
        for b in batches:
            out = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for doc, text in zip(b["doc_id"], b["text"]):
                ids = np.array([*tok.ids(text), end_id], dtype="<u4")
                for i, (s, n) in enumerate(pieces_of(len(ids), size)):
                    for k, v in zip(out, (doc, i, s, n, zlib.crc32(ids[s:s + n].tobytes()))):
                        out[k].append(v)
            yield pd.DataFrame(out)
    return run


def _pack_rows(size: int, open_bins: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, task = BestFit(size, open_bins), None
        for b in batches:
            if task is None and len(b):
                task = int(b["task"].iloc[0]) << 40
            placed = [packer.put(int(n)) for n in b["length"]]
            b["sequence_id"] = [task + no for no, _ in placed]
            b["offset"] = [at for _, at in placed]
            yield b.drop(columns="task")
    return run


def pack(docs: DataFrame, path: str, ranks: str | None = None, end_id: int = 2, size: int = 1024,
         open_bins: int = 32_768, pieces_per_task: int = 50_000, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its whole text and ``end_id`` (null or empty text: that id alone). Null and
    repeated ids are carried; every row is packed, so repeated rows give repeated pieces. An empty
    table gives an empty result; other columns are ignored. Ties in length go by id, piece,
    checksum; rows equal in all of these are alike, so their order does not matter.
    """
    spark = docs.sparkSession
    ready(spark)
    id_type = dict(docs.dtypes)[id_col]
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long"
    pieces = stored(base.mapInPandas(_piece_rows(path, ranks, end_id, size), schema), "pieces")
    tasks = max(1, -(-pieces.count() // pieces_per_task))
    return (pieces.repartition(tasks)
            .withColumn("task", F.spark_partition_id())
            .sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids_crc32")
            .mapInPandas(_pack_rows(size, open_bins), f"{schema}, sequence_id long, offset long"))
