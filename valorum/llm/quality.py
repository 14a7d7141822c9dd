"""Quality of whole documents by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into chunks of ``CHUNK`` bytes that overlap by ``CHUNK - STEP``, from the first byte to the last.
Each byte has a learned vector; learned filters of ``WIDTH`` bytes slide over every chunk, and of each filter the
greatest response in the chunk stays (max-pooling). A hidden layer reads a chunk's pooled responses (a chunk of
few distinct patterns, such as one repeated word, shows by what is missing); over all chunks of a document the
hidden responses are pooled by maximum and by mean, and combined into one probability. Work and memory per
document grow with its length only: chunks pass in blocks of ``BLOCK``.

The network is trained by gradient descent (Adam) with a fixed seed, in one task, on a bounded sample of labelled rows:
of each label at most ``max_rows`` distinct texts of at most ``max_bytes`` bytes, those of the smallest hash. The
sample's bound is all that training holds; scoring reads every byte of every document.

Odd rows: a null text counts as empty; an empty text has no chunk, pools to zeros and gets the same score everywhere.
Rows without a label, without an id or labelled other than 0 and 1 are not learned from; several labels of an id count
each. Repeated rows are scored each. Without both labels in the sample every score is 0.5 or more where only
label 1 (or no row) was seen, below 0.5 where only label 0. Extra columns are kept by :func:`with_quality`, not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from valorum.llm.common import fresh, pick, ready, stored, text_of

CHUNK, STEP, WIDTH, STRIDE = 128, 112, 8, 2
EMBED, FILTERS, HIDDEN = 8, 32, 16
BLOCK = 1024
PAD = 256  # what follows the last byte of a text
PLACES = (CHUNK - WIDTH) // STRIDE + 1
CUT = 0.5


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of all texts (rows of byte numbers, padded) and the number of each text's chunks."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - CHUNK) // STEP)), 0)
    ends = np.cumsum(sizes + CHUNK)
    flat = np.full(int(ends[-1]) if len(ends) else 0, PAD, np.int16)
    starts = ends - sizes - CHUNK
    for t, s in zip(texts, starts.tolist()):
        flat[s:s + len(t)] = np.frombuffer(t, np.uint8)
    first = np.repeat(starts - STEP * (np.cumsum(counts) - counts), counts) + STEP * np.arange(int(counts.sum()))
    return flat[first[:, None] + np.arange(CHUNK)], counts


@dataclass
class Network:
    """Weights: byte vectors, filters, hidden layer, and the combination of the pooled hidden responses."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    NAMES = ("embed", "filters", "bias", "hidden", "hidden_bias", "out", "out_bias")

    @staticmethod
    def start(rng: np.random.Generator) -> Network:
        def normal(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        embed = (rng.standard_normal((PAD + 1, EMBED)) / 2).astype(np.float32)
        embed[PAD] = 0
        zeros = [np.zeros(n, np.float32) for n in (FILTERS, HIDDEN, 1)]
        return Network(embed, normal(WIDTH * EMBED, FILTERS), zeros[0], normal(FILTERS, HIDDEN), zeros[1],
                       normal(2 * HIDDEN, 1)[:, 0], zeros[2])

    @staticmethod
    def constant(logit: float) -> Network:
        zero = Network.start(np.random.default_rng(0))
        parts = [np.zeros_like(getattr(zero, n)) for n in Network.NAMES]
        parts[-1][:] = logit
        return Network(*parts)

    def pooled(self, block: np.ndarray, places: bool = False):
        """Greatest response of each filter in each chunk (and where, if asked)."""
        x = self.embed[block].reshape(len(block), CHUNK * EMBED)
        windows = np.lib.stride_tricks.sliding_window_view(x, WIDTH * EMBED, axis=1)[:, ::STRIDE * EMBED]
        a = (windows.reshape(-1, WIDTH * EMBED) @ self.filters).reshape(len(block), PLACES, FILTERS)
        at = a.argmax(1) if places else None
        top = np.maximum(a.max(1) + self.bias, 0)
        return (top, at) if places else top

    def hiddens(self, top: np.ndarray) -> np.ndarray:
        return np.maximum(top @ self.hidden + self.hidden_bias, 0)

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """Of each text, from all its chunks, a block at a time."""
        most, total, number = (np.zeros((len(texts), HIDDEN), np.float32) for _ in range(3))
        for some in groups(texts):
            block, counts = chunks([texts[i] for i in some])
            h = np.concatenate([self.hiddens(self.pooled(block[i:i + BLOCK])) for i in range(0, len(block), BLOCK)]
                               or [np.zeros((0, HIDDEN), np.float32)])
            full = np.flatnonzero(counts)
            if len(full):
                begin = (np.cumsum(counts) - counts)[full]
                at = np.array(some)[full]
                most[at], total[at] = np.maximum.reduceat(h, begin), np.add.reduceat(h, begin)
                number[at] = counts[full, None]
        return np.column_stack([most, total / np.maximum(number, 1)]) @ self.out + self.out_bias[0]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(texts).astype(float)))


def groups(texts: list[bytes], limit: int = 1 << 20) -> Iterator[list[int]]:
    """Numbers of texts in groups of about ``limit`` bytes."""
    some, held = [], 0
    for i, t in enumerate(texts):
        some.append(i)
        held += len(t) + CHUNK
        if held >= limit:
            yield some
            some, held = [], 0
    if some:
        yield some


def gradients(net: Network, block: np.ndarray, counts: np.ndarray, target: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Of the weighted logistic loss of some documents, in the order of ``Network.NAMES``."""
    parts = [net.pooled(block[i:i + BLOCK], True) for i in range(0, len(block), BLOCK)]
    top, at = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    h = net.hiddens(top)
    owner = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    most, mean = np.maximum.reduceat(h, begin), np.add.reduceat(h, begin) / counts[:, None]
    features = np.column_stack([most, mean]).astype(np.float32)
    p = 1 / (1 + np.exp(-(features @ net.out + net.out_bias[0])))
    d = ((p - target) * weight).astype(np.float32)
    d_features = d[:, None] * net.out
    first = h == most[owner]
    share = first / np.add.reduceat(first, begin)[owner]
    d_h = d_features[owner, :HIDDEN] * share + d_features[owner, HIDDEN:] / counts[owner, None]
    d_h = (d_h * (h > 0)).astype(np.float32)
    d_top = ((d_h @ net.hidden.T) * (top > 0)).astype(np.float32)
    # Only the window of the greatest response has a gradient.
    row, col = np.nonzero(d_top)
    g = d_top[row, col]
    codes = block[row[:, None], (at[row, col] * STRIDE)[:, None] + np.arange(WIDTH)]
    d_filters = np.zeros_like(net.filters)
    order = np.argsort(col, kind="stable")
    d_embed = np.zeros_like(net.embed)
    for c, some in zip(range(FILTERS), np.split(order, np.searchsorted(col[order], np.arange(1, FILTERS)))):
        x = net.embed[codes[some]].reshape(len(some), WIDTH * EMBED)
        d_filters[:, c] = g[some] @ x
        onto = net.filters[:, c].reshape(WIDTH, EMBED)
        for w in range(WIDTH):
            d_embed += np.bincount(codes[some, w], g[some], PAD + 1).astype(np.float32)[:, None] * onto[w]
    d_embed[PAD] = 0
    return [d_embed, d_filters, d_top.sum(0), top.T @ d_h, d_h.sum(0), features.T @ d, np.array([d.sum()], np.float32)]


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 12, batch: int = 24, rate: float = 0.01, seed: int = 0) -> Network:
    """A network for the labels; both count alike however rare one is. Texts without bytes are left out."""
    keep = [i for i, t in enumerate(texts) if t]
    texts, y = [texts[i] for i in keep], np.asarray(labels, np.float32)[keep]
    ones = int(y.sum())
    if not ones or ones == len(y):
        return Network.constant(2.0 if ones or not len(y) else -2.0)
    weight = np.where(y == 1, len(y) / (2 * ones), len(y) / (2 * (len(y) - ones))).astype(np.float32)
    rng = np.random.default_rng(seed)
    net = Network.start(rng)
    names, step = Network.NAMES, 0
    first, second = ([np.zeros_like(getattr(net, n)) for n in names] for _ in range(2))
    epochs = max(epochs, -(-600 * batch // len(texts)))  # 600 steps at least, however few the texts
    steps = epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), batch):
            some = order[i:i + batch]
            block, counts = chunks([texts[j] for j in some])
            grad = gradients(net, block, counts, y[some], weight[some] / len(some))
            step += 1
            now = rate * (1 - step / (steps + 1))
            for n, g, a, b in zip(names, grad, first, second):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                move = now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
                setattr(net, n, (getattr(net, n) - move).astype(np.float32))
    return net


# --- on tables --------------------------------------------------------------------------------------------------
def sample(docs: DataFrame, labels: DataFrame, seen: Column, id_col: str, text_col: str, label_col: str,
           max_rows: int, max_bytes: int) -> DataFrame:
    """At most ``max_rows`` distinct texts of each label: (label, key, text). Texts are chosen by hash before any text moves."""
    text = text_of("text")
    marked = pick(labels, doc_id=id_col, label=label_col).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & seen)
    base = pick(docs, doc_id=id_col, text=text_col)
    narrow = base.where(F.octet_length(text).between(1, max_bytes)).select("doc_id", F.xxhash64(text).alias("key"))
    held = narrow.join(marked.distinct(), "doc_id").groupBy("label", "key").agg(F.min("doc_id").alias("doc_id"))
    # Ranked within 64 slices of the keys first, so that no task sees all rows of a label.
    slice_ = F.pmod(F.col("key"), F.lit(64))
    for group in (Window.partitionBy("label", slice_), Window.partitionBy("label")):
        held = held.withColumn("place", F.row_number().over(group.orderBy("key"))).where(F.col("place") <= max_rows)
    chosen = held.drop("place")
    # Two labels of max_rows ids each: a proven bound for the broadcast.
    found = base.withColumn("key", F.xxhash64(text)).join(F.broadcast(chosen), ["doc_id", "key"])
    return found.groupBy("label", "key").agg(F.first("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, seen: Column, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", max_rows: int = 600, max_bytes: int = 16_384) -> Network:
    """The network learned from the labels that ``seen`` (a condition on the id) admits.

    Bounds: ``max_rows`` distinct texts of each label, each of at most ``max_bytes`` bytes; one task holds them.
    """
    ready(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([b for b in batches] or [pd.DataFrame({"label": [], "key": [], "text": []})])
        rows = rows.sort_values(["label", "key"])
        net = train([t.encode() for t in rows.text], rows.label.to_numpy())
        yield pd.DataFrame({"name": Network.NAMES, "shape": [list(getattr(net, n).shape) for n in Network.NAMES],
                            "weights": [getattr(net, n).ravel() for n in Network.NAMES]})

    some = sample(docs, labels, seen, id_col, text_col, label_col, max_rows, max_bytes)
    made = some.repartition(1).mapInPandas(run, "name string, shape array<int>, weights array<float>")
    parts = {r.name: np.array(r.weights, np.float32).reshape(r.shape) for r in stored(made, "quality-network").collect()}
    return Network(**parts) if parts else Network.constant(2.0)


def with_quality(docs: DataFrame, net: Network, text_col: str = "text", score: str = "score") -> DataFrame:
    """The input rows with ``score``: the probability of label 1."""
    ready(docs.sparkSession)
    text = fresh("quality_text", docs.columns)
    frame = docs.withColumn(text, text_of(text_col)).withColumn(score, F.lit(0.0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{score: net.scores([t.encode() for t in b[text]])}).drop(columns=[text])

    return frame.mapInPandas(run, frame.drop(text).schema)


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """One row per input row: doc_id, score, predicted (1 from ``cut`` on)."""
    found = with_quality(pick(docs, doc_id=id_col, text=text_col), net)
    return found.select("doc_id", "score", (F.col("score") >= cut).cast("int").alias("predicted"))
