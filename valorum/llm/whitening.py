"""Whitening of embeddings: leading principal components by spectrum slicing.

Entries are put on an integer grid, ``x = floor(64 * c) + 1000000``, so that every corpus-wide sum is exact: the
counts and sums per dimension, and the products of entries centred at the integer next to their mean. From
these the covariance follows as a quotient of integers, the same for every layout of the table.

The covariance (dimension x dimension, the only thing that reaches the driver) is then sliced:

* the number of eigenvalues above a shift is the number of positive pivots of LDL^T of the shifted covariance
  (Sylvester's law of inertia); bisection by such counts isolates each of the leading eigenvalues;
* within its interval Rayleigh quotient iteration converges cubically to the eigenpair; if it leaves the
  interval, the interval is cut further;
* counts just above and just below each found eigenvalue certify its number. Eigenvalues that no interval
  wider than rounding parts are a cluster, whose vectors come from inverse iteration on a block.

Components whose eigenvalue is below ``RANK`` of the greatest are rounding noise and not returned, so constant
dimensions and tables of few rows have fewer components.

Odd rows: vectors that are null, or hold null or non-finite entries, entries of 2^55 or more in size, or
another number of entries than most rows (ties: the larger number) take no part. Repeated rows count and are
returned each; null ids are carried. No usable row: an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valorum.llm.common import pick, ready, stored

SCALE, SHIFT = 64, 1_000_000
LARGEST = float(1 << 55)
RANK = 1e-11
EPS = float(np.finfo(float).eps)
PIVOT = (1 + 17 ** 0.5) / 8  # Bunch and Kaufman's bound on the growth of pivots


# --- the spectrum of a symmetric matrix ------------------------------------------------------------------------
def positive(a: np.ndarray) -> int:
    """Number of positive eigenvalues: the positive pivots of LDL^T with symmetric pivoting (blocks of 1 and 2)."""
    a, n, k, count = a.copy(), len(a), 0, 0

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        below = np.abs(a[k + 1:, k])
        r = k + 1 + int(below.argmax()) if len(below) else k
        off, pair = (float(below.max()) if len(below) else 0.0), False
        if abs(a[k, k]) < PIVOT * off:
            row = np.abs(a[k:, r])
            row[r - k] = 0
            most = float(row.max())
            if abs(a[k, k]) * most < PIVOT * off * off:
                if abs(a[r, r]) >= PIVOT * most:
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    pair = True
        if pair:
            block, rest = a[k:k + 2, k:k + 2], a[k + 2:, k:k + 2]
            det = block[0, 0] * block[1, 1] - block[0, 1] ** 2
            count += 1 if det < 0 else 2 * int(block[0, 0] + block[1, 1] > 0)
            turned = np.array([[block[1, 1], -block[0, 1]], [-block[0, 1], block[0, 0]]]) / det
            a[k + 2:, k + 2:] -= rest @ turned @ rest.T
            k += 2
        else:
            p = a[k, k]
            count += int(p > 0)
            if p:
                a[k + 1:, k + 1:] -= np.outer(a[k + 1:, k], a[k + 1:, k] / p)
            k += 1
    return count


def solve(a: np.ndarray, b: np.ndarray, move: float) -> np.ndarray:
    """(a)^-1 b; an exactly singular matrix is moved by rounding, further until it can be solved."""
    for step in (0.0, move, 8 * move, 64 * move):
        try:
            out = np.linalg.solve(a + step * np.eye(len(a)), b)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(out).all():
            return out
    raise ArithmeticError("a shifted covariance could not be solved")


def leading(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues, falling, and their unit eigenvectors as columns; numbering certified by counts."""
    d, eye = len(v), np.eye(len(v))
    size = float(np.abs(v).sum(1).max()) if d else 0.0
    if not size:
        return np.zeros(0), np.zeros((d, 0))
    tiny = 4 * d * EPS * size
    rng = np.random.default_rng(0)
    above: Callable[[float], int] = lambda s: positive(v - s * eye)
    values: list[float] = []
    found = np.zeros((d, 0))

    def free(x: np.ndarray) -> np.ndarray:
        """Without what earlier eigenvectors explain."""
        for _ in range(2):
            x = x - found @ (found.T @ x)
        return x

    def rayleigh(lo: float, hi: float) -> tuple[float, np.ndarray] | None:
        """The eigenpair of an interval that holds one, or none if the iteration leaves the interval."""
        x, shift = free(rng.standard_normal(d)), (lo + hi) / 2
        best = None
        for _ in range(12):
            x = solve(v - shift * eye, x / np.linalg.norm(x), EPS * size)
            x = free(x / np.abs(x).max())
            x /= np.linalg.norm(x)
            y = v @ x
            shift = float(x @ y)
            error = float(np.linalg.norm(y - shift * x))
            if best is not None and error >= best[0] and best[0] <= tiny:
                break
            if best is None or error < best[0]:
                best = (error, shift, x)
        error, shift, x = best
        return (shift, x) if error <= tiny and lo - tiny <= shift <= hi + tiny else None

    def cluster(lo: float, hi: float, many: int) -> tuple[np.ndarray, np.ndarray]:
        x = rng.standard_normal((d, many))
        for _ in range(4):
            x = solve(v - ((lo + hi) / 2) * eye, np.linalg.qr(free(x))[0], EPS * size)
            x = np.linalg.qr(free(x / np.abs(x).max()))[0]
        e = np.einsum("ij,ij->j", x, v @ x)
        order = np.argsort(-e, kind="stable")
        return e[order], x[:, order]

    # Intervals (lo, hi] with the numbers of eigenvalues above each end; the greatest is taken first.
    todo = [(-tiny, size + tiny, above(-tiny), 0)]
    while todo and len(values) < components:
        lo, hi, n_lo, n_hi = todo.pop()
        if values and lo < RANK * values[0]:  # what lies below is rounding
            lo = min(RANK * values[0], hi)
            n_lo = above(lo)
        if n_lo <= n_hi or not lo < hi:
            continue
        if n_lo - n_hi == 1 and (pair := rayleigh(lo, hi)):
            values.append(pair[0])
            found = np.column_stack([found, pair[1]])
            continue
        middle = (lo + hi) / 2
        if hi - lo <= tiny or not lo < middle < hi:
            e, x = cluster(lo, hi, n_lo - n_hi)
            values.extend(e.tolist())
            found = np.column_stack([found, x])
            continue
        n = above(middle)
        todo += [(lo, middle, n_lo, n), (middle, hi, n, n_hi)]

    e = np.array(values[:components])
    keep = e > RANK * (e[0] if len(e) else 0)
    e, found = e[keep], found[:, :components][:, keep]
    for k, value in enumerate(e):
        if not above(value + 4 * tiny) <= k < above(value - 4 * tiny):
            raise ArithmeticError(f"eigenvalue {k + 1} is not certified by the counts beside it")
    return e, found


# --- exact sums over the table ----------------------------------------------------------------------------------
def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and x (array of long), without the vectors that take no part (but those of another length)."""
    def good(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(LARGEST))

    base = pick(vectors, vec_id=id_col, vec=vec_col).withColumn("vec", F.col("vec").cast("array<double>"))
    base = base.where(F.col("vec").isNotNull() & (F.size("vec") > 0) & F.coalesce(F.forall("vec", good), F.lit(False)))
    return base.select("vec_id", F.transform("vec", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def exact(x: np.ndarray, bound: int) -> np.ndarray:
    """The array itself if sums up to ``bound`` fit 63 bits, else one of Python integers."""
    return x if bound < 1 << 62 else x.astype(object)


def dimension_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per length and dimension: number, sum, least and greatest of x in this task."""
    held: dict[int, list] = {}
    for b in batches:
        lengths = b.column("x").value_lengths().to_numpy(zero_copy_only=False)
        for d in np.unique(lengths):
            part = b.column("x").filter(pa.array(lengths == d))
            x = matrix(part, int(d))
            total = exact(x, int(np.abs(x).max()) * len(x)).sum(0).tolist()
            n, s, lo, hi = held.get(int(d), [0, [0] * int(d), x.min(0), x.max(0)])
            held[int(d)] = [n + len(x), [a + c for a, c in zip(s, total)], np.minimum(lo, x.min(0)), np.maximum(hi, x.max(0))]
    for d, (n, s, lo, hi) in held.items():
        yield pa.RecordBatch.from_pydict({"d": [d] * d, "j": list(range(d)), "n": [n] * d, "s": [str(v) for v in s],
                                          "lo": lo.tolist(), "hi": hi.tolist()})


def products(d: int, middle: list[int], reach: int):
    """Sums of y_i * y_j, i <= j, with y = x - middle, exactly; one row for each pair and task."""
    i, j = np.triu_indices(d)
    centre = np.array(middle, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            y = matrix(b.column("x"), d) - centre
            bound = max(1, len(y)) * reach * reach
            # Below 2^53 every partial sum of the floating product is an integer that a double holds.
            g = (y.astype(float).T @ y.astype(float)).astype(np.int64) if bound < 1 << 53 else (m := exact(y, bound)).T @ m
            g = [int(v) for v in g[i, j]]
            total = g if total is None else [a + c for a, c in zip(total, g)]
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": i, "j": j, "g": [str(v) for v in total]})

    return run


@dataclass(frozen=True)
class Spectrum:
    """What a whitening needs: fit-list size, exact sums, eigenvalues (falling), eigenvectors (columns), trace."""

    n: int = 0
    sums: tuple[int, ...] = ()
    reach: int = 0
    values: np.ndarray | None = None
    vectors: np.ndarray | None = None
    trace: float = 0.0

    @property
    def centre(self) -> list[int]:
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]

    @property
    def explained(self) -> list[float]:
        return [float(e) / self.trace for e in self.values] if self.n else []


def same_length(x: DataFrame, model: Spectrum) -> DataFrame:
    return x.where(F.size("x") == len(model.sums))


def fit(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vec_col: str = "embedding") -> Spectrum:
    """The leading spectrum of the covariance over all usable vectors.

    To the driver: two numbers for each dimension and one for each pair of dimensions, whatever the number of rows.
    """
    ready(vectors.sparkSession)
    x = usable(vectors, id_col, vec_col)
    parts = x.select("x").mapInArrow(dimension_sums, "d long, j long, n long, s string, lo long, hi long")
    sums = stored(parts.groupBy("d", "j").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s"),
                                              F.min("lo").alias("lo"), F.max("hi").alias("hi")), "whiten-sums")
    first = sums.where("j = 0").orderBy(F.desc("n"), F.desc("d")).head()
    if first is None:
        return Spectrum()
    rows = sums.where(F.col("d") == first.d).orderBy("j").collect()
    n, d, total = first.n, first.d, tuple(int(r.s) for r in rows)
    bare = Spectrum(n, total)
    middle = bare.centre
    reach = 1 + max(max(r.hi - m, m - r.lo) for r, m in zip(rows, middle))
    grams = same_length(x, bare).select("x").mapInArrow(products(d, middle, reach), "i long, j long, g string")
    grams = grams.groupBy("i", "j").agg(F.sum(F.col("g").cast("decimal(38,0)")).cast("string").alias("g"))
    off = [s - n * m for s, m in zip(total, middle)]
    v = np.zeros((d, d))
    for r in grams.collect():
        v[r.i, r.j] = v[r.j, r.i] = (n * int(r.g) - off[r.i] * off[r.j]) / (n * n)
    values, found = leading(v, min(components, d))
    return Spectrum(n, total, reach, values, found, float(np.trace(v)))


def transform(vectors: DataFrame, model: Spectrum, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per usable vector: vec_id, deviation (exact; null where a long cannot hold it), whitened (array)."""
    ready(vectors.sparkSession)
    x = usable(vectors, id_col, vec_col)
    kind = x.schema["vec_id"].dataType.simpleString()
    if not model.n:
        return x.limit(0).selectExpr("vec_id", "cast(null as long) AS deviation", "array(0D) AS whitened")
    n, d, middle = model.n, len(model.sums), np.array(model.centre, np.int64)
    off = np.array([s - n * int(m) for s, m in zip(model.sums, middle)], np.int64)
    weights = model.vectors / np.sqrt(model.values)
    bound = d * (n * (model.reach + 1)) ** 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = exact(matrix(b.column("x"), d) - middle, bound)
            wide = n * y - (off if bound < 1 << 62 else off.astype(object))
            deviation = [v if v < 1 << 63 else None for v in (wide * wide).sum(1).tolist()]
            white = (wide / n).astype(float) @ weights
            flat = pa.array(white.ravel())
            offsets = pa.array(np.arange(len(white) + 1, dtype=np.int32) * white.shape[1])
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(deviation, pa.int64()),
                                              pa.ListArray.from_arrays(offsets, flat)], ["vec_id", "deviation", "whitened"])

    return same_length(x, model).mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, components: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` (divisor n) minus the identity.

    Tasks centre on their own means; their products and means add up to those of the whole.
    """
    i, j = np.triu_indices(components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = matrix(b.column("whitened"), components)
            if len(w):
                mean = w.mean(0)
                c = w - mean
                g = c.T @ c + len(w) * np.outer(mean, mean)
                yield pa.RecordBatch.from_pydict({"i": np.r_[i, np.full(components, -1)], "j": np.r_[j, np.arange(components)],
                                                  "g": np.r_[g[i, j], mean * len(w)], "n": np.full(len(i) + components, len(w))})

    if not components:
        return 0.0
    parts = whitened.select("whitened").mapInArrow(run, "i long, j long, g double, n long")
    rows = parts.groupBy("i", "j").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).collect()
    mean = {r.j: r.g / r.n for r in rows if r.i < 0}
    return max((abs(r.g / r.n - mean[r.i] * mean[r.j] - (r.i == r.j)) for r in rows if r.i >= 0), default=0.0)


def whiten(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    model = fit(vectors, components, id_col, vec_col)
    white = stored(transform(vectors, model, id_col, vec_col), "whitened")
    error = identity_error(white, len(model.values) if model.n else 0)
    share = F.array(*[F.lit(e) for e in model.explained]).cast("array<double>")
    long = white.select("vec_id", "deviation", F.posexplode("whitened").alias("p", "whitened"))
    return long.select("vec_id", (F.col("p") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
                       "whitened", F.get(share, F.col("p")).alias("explained"), F.lit(error).alias("identity_error"))
