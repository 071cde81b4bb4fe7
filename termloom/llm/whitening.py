"""Embedding whitening by incremental eigendecomposition.

Vectors are taken on a grid (floor of ``GRID`` times the entry) as integers, and each distinct one counts once.
A partition keeps the eigendecomposition of the scatter around its own mean and adds one vector at a time:
the centred vector is a rank-one update, whose eigenvalues are the roots of the secular equation. Entries
that the update does not touch, and poles that coincide, are deflated first; the eigenvectors come from
the vector for which the computed roots are exact, so they stay orthogonal. The spectra of two partitions
are combined in the same way: one update for each eigenpair of the other, and one for the distance
of the means; spectra meet in groups of a bounded number until one is left. Its basis is refined by a
distributed Rayleigh-Ritz step: sums of exactly centred vectors (n*x - S in integers) projected on the basis
give a small matrix, whose eigenvectors turn the basis into that of the whole covariance in double precision.

Only matrices of the dimension squared reach the driver; rows and distinct vectors do not.

Defined cases: a vector that is null or empty, or holds null or non-finite entries, is dropped, and so is one of another
than the most common length (the longer in a tie). Copies, and rows without an id, are whitened like others. Without
rows there is no result. A component whose eigenvalue is zero by rounding is kept with null ``whitened``, and
counts in no ``identity_error`` (null if no component is left); ``explained`` is null if all vectors are equal.
``deviation`` is null beyond 63 bits. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import ship
from termloom.session import checkpointed

ship(__name__)

GRID = 256
COMPONENTS = 4
#: Spectra (or matrices) that one task combines.
FAN_IN = 8
EPS = np.finfo(float).eps
#: An eigenvalue below this part of the largest one is rounding.
NEGLIGIBLE = 1e-12
LARGEST = (1 << 63) - 1


# ---- rank-one updates


def secular_roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + sum(weights / (poles - x)), one above each pole: (index of the nearer pole, distance to it).

    ``poles`` rise strictly and ``weights`` are positive. All roots are sought at once, each from its nearer
    pole, by a two-pole interpolation that falls back to halving its bracket.
    """
    k = len(poles)
    total = weights.sum()
    own, nxt = np.arange(k), np.minimum(np.arange(k) + 1, k - 1)
    gap = np.append(np.diff(poles), total)
    half = gap / 2
    halfway = weights / ((poles[None, :] - poles[:, None]) - half[:, None])
    middle = 1 + halfway.sum(axis=1)
    near = np.where((middle > 0) | (own == k - 1), own, nxt)
    shifted = poles[None, :] - poles[near][:, None]
    low, high = np.where(near == own, 0.0, -half), np.where(near == own, half, 0.0)
    if middle[-1] <= 0:
        low[-1], high[-1] = half[-1], gap[-1]
    else:
        low[-1], high[-1] = 0.0, half[-1]
    lower = (np.arange(k)[None, :] <= own[:, None]).astype(float)  # poles below each root
    to_own, to_next, last = shifted[own, own], shifted[own, nxt], own == k - 1
    with np.errstate(all="ignore"):
        # first guess: the two poles beside the root exactly, all others by their sum halfway
        w1, w2 = weights, np.where(last, 0.0, weights[nxt])
        rest = middle - halfway[own, own] - np.where(last, 0.0, halfway[own, nxt])
        b = rest * (to_own + to_next) + w1 + w2
        c = rest * to_own * to_next + w1 * to_next + w2 * to_own
        root = np.sqrt(np.abs(b * b - 4 * rest * c))
        x = np.where(last, w1 / rest, np.where(b > 0, 2 * c / (b + root), (b - root) / (2 * rest)))
        x = np.where((x > low) & (x < high), x, (low + high) / 2)
        for _ in range(80):
            distance = shifted - x[:, None]
            part = weights / distance
            total = part.sum(axis=1)
            under = np.einsum("ij,ij->i", part, lower)
            f = 1 + total
            up = f < 0  # f rises between two poles
            low, high = np.where(up, x, low), np.where(up, high, x)
            done = (np.abs(f) <= EPS * k * (1 + total - 2 * under)) | (high - low <= 2 * EPS * np.abs(x))
            if done.all():
                break
            part /= distance
            slope = part.sum(axis=1)
            below = np.einsum("ij,ij->i", part, lower)
            d1, d2 = to_own - x, to_next - x
            both = d1 * d2
            a = (d1 + d2) * f - both * slope
            b = both * f
            c = f - d1 * below - d2 * (slope - below)
            root = np.sqrt(np.abs(a * a - 4 * b * c))
            to = x + np.where(last, -f / slope, np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root)))
            to = np.where((to > low) & (to < high), to, (low + high) / 2)
            x = np.where(done, x, to)
    return near, x


def rank_one(values: np.ndarray, vectors: np.ndarray, added: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of the given decomposition plus the outer square of ``added``."""
    z = vectors.T @ added
    norm = float(z @ z)
    scale = max(float(values[-1]), 0.0) + norm
    if not norm:
        return values, vectors
    tolerance = 8 * EPS * scale
    # deflation: poles that coincide are turned so that all of z lies on the last of them ...
    close = np.flatnonzero(np.diff(values) <= tolerance)
    if len(close):
        values, vectors = values.copy(), vectors.copy()
        for i in close:
            r = np.hypot(z[i], z[i + 1])
            if r:
                c, s = z[i + 1] / r, z[i] / r
                left, right = vectors[:, i].copy(), vectors[:, i + 1]
                vectors[:, i], vectors[:, i + 1] = c * left - s * right, s * left + c * right
                z[i], z[i + 1] = 0.0, r
    # ... and entries that change nothing keep their pair
    live = np.flatnonzero(np.abs(z) * np.sqrt(norm) > tolerance)
    if not len(live):
        return values, vectors
    poles, part = values[live], z[live]
    near, x = secular_roots(poles, part * part)
    to_root = poles[:, None] - poles[near][None, :] - x[None, :]  # pole i minus root j
    between = poles[None, :] - poles[:, None]  # pole j minus pole i
    ratio = -to_root
    with np.errstate(divide="ignore", invalid="ignore"):
        np.divide(ratio, between, out=ratio, where=~np.eye(len(live), dtype=bool))
    exact = np.sqrt(np.abs(np.prod(ratio, axis=1))) * np.sign(part)
    turn = exact[:, None] / to_root
    turn /= np.sqrt((turn * turn).sum(axis=0))
    if len(live) == len(values):
        new_values, new_vectors = poles[near] + x, vectors @ turn
    else:
        new_values, new_vectors = values.copy(), vectors.copy()
        new_values[live], new_vectors[:, live] = poles[near] + x, vectors[:, live] @ turn
    order = np.argsort(new_values, kind="stable")
    return new_values[order], new_vectors[:, order]


class Spectrum:
    """Number, mean, and eigendecomposition of the scatter of the vectors seen."""

    def __init__(self, dim: int):
        self.n, self.mean, self.values, self.vectors = 0, np.zeros(dim), np.zeros(dim), np.eye(dim)

    def add(self, x: np.ndarray) -> None:
        off = x - self.mean
        if self.n:
            self.values, self.vectors = rank_one(self.values, self.vectors, off * np.sqrt(self.n / (self.n + 1)))
        self.n += 1
        self.mean = self.mean + off / self.n

    def merge(self, other: Spectrum) -> None:
        if not other.n:
            return
        off, n = other.mean - self.mean, self.n + other.n
        added = [other.vectors[:, k] * np.sqrt(v) for k, v in enumerate(other.values) if v > 0]
        for x in [*added, off * np.sqrt(self.n * other.n / n)]:
            self.values, self.vectors = rank_one(self.values, self.vectors, x)
        self.n, self.mean = n, self.mean + off * (other.n / n)

    def row(self) -> np.ndarray:
        return np.concatenate([[self.n], self.mean, self.values, self.vectors.ravel()])

    @classmethod
    def of_row(cls, row: np.ndarray, dim: int) -> Spectrum:
        out = cls(dim)
        out.n, out.mean, out.values = int(row[0]), row[1 : dim + 1], row[dim + 1 : 2 * dim + 1]
        out.vectors = row[2 * dim + 1 :].reshape(dim, dim)
        return out


# ---- Spark


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def on_grid(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that remain: x holds the grid's integers."""
    known = embeddings.filter(F.size("embedding") > 0).select(
        "vec_id", F.transform("embedding", lambda c: c.cast("double")).alias("c")
    )
    limit = float(1 << 62)
    good = known.filter(F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < limit / GRID)))
    found = good.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return good.filter(F.size("c") == (found.d if found else 0)).select(
        "vec_id", F.transform("c", lambda c: F.floor(c * GRID).cast("bigint")).alias("x")
    )


def gathered(parts: DataFrame, combine: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """``combine`` (rows to one row) over all rows of (v array<double>), a bounded number in a task, in rounds."""
    def some(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"v": [combine(np.stack(rows["v"].to_numpy()))]})

    left = checkpointed(parts.select("v", F.monotonically_increasing_id().alias("at")))
    n = left.count()
    while n > FAN_IN:
        numbered = left.select("v", F.pmod(F.xxhash64("at"), F.lit(-(-n // FAN_IN))).alias("g"))
        met = numbered.groupBy("g").applyInPandas(some, "v array<double>")
        left = checkpointed(met.select("v", F.monotonically_increasing_id().alias("at")))
        n = left.count()
    rows = left.select("v").collect()
    return combine(np.array([r.v for r in rows])) if rows else None


def _spectra(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum = Spectrum(dim)
        for batch in batches:
            for x in _matrix(batch.column(0), dim).astype(float):
                spectrum.add(x)
        if spectrum.n:
            yield pa.RecordBatch.from_arrays([pa.array([spectrum.row()], pa.list_(pa.float64()))], ["v"])

    return run


def _combined(dim: int):
    def run(rows: np.ndarray) -> np.ndarray:
        first, *others = sorted((Spectrum.of_row(r, dim) for r in rows), key=lambda s: -s.n)
        for other in others:
            first.merge(other)
        return first.row()

    return run


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S exactly: 64-bit integers where they suffice, Python's beyond."""
    most = n * int(max(abs(int(x.max())), abs(int(x.min())))) + max(abs(s) for s in sums) if x.size else 0
    if most <= LARGEST:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def deviations(off: np.ndarray) -> list[int | None]:
    """The exact sum of squares of each row; None beyond 63 bits."""
    if not off.size:
        return []
    most = int(np.abs(off).max())
    if off.dtype != object and most * most * off.shape[1] <= LARGEST:
        return (off * off).sum(axis=1).tolist()
    sums = (off.astype(object) ** 2).sum(axis=1)
    return [int(s) if s <= LARGEST else None for s in sums]


def _products(dim: int, n: int, sums: list[int], basis: np.ndarray):
    """Of each partition: the sum of the outer squares of its centred, projected vectors, and their plain sum."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = basis.shape[1]
        square, plain = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            y = (centred(_matrix(batch.column(0), dim), n, sums) / n).astype(float) @ basis
            square += y.T @ y
            plain += y.sum(axis=0)
        v = np.concatenate([square.ravel(), plain])
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.list_(pa.float64()))], ["v"])

    return run


def covariance(distinct: DataFrame, dim: int, n: int, sums: list[int], basis: np.ndarray) -> np.ndarray:
    """The covariance over the distinct vectors, projected on the columns of ``basis``."""
    k = basis.shape[1]
    total = gathered(distinct.mapInArrow(_products(dim, n, sums, basis), "v array<double>"), lambda rows: rows.sum(axis=0))
    mean = total[k * k :] / n
    return total[: k * k].reshape(k, k) / n - np.outer(mean, mean)


def _sums(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dim, object)
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            n += len(x)
            if x.size:
                safe = int(np.abs(x).max()) * len(x) <= LARGEST
                sums = sums + (x.sum(axis=0) if safe else x.astype(object).sum(axis=0)).astype(object)
        rows = [("n", n), *((str(i), s) for i, s in enumerate(sums))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows]), pa.array([str(r[1]) for r in rows])], ["of", "part"]
        )

    return run


def _rows(dim: int, n: int, sums: list[int], axes: np.ndarray, roots: list[float | None], explained: list[float | None], error):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = axes.shape[1]
        for batch in batches:
            if not batch.num_rows:
                continue
            off = centred(_matrix(batch.column(1), dim), n, sums)
            y = (off / n).astype(float) @ axes
            white = [y[:, c] / np.sqrt(roots[c]) if roots[c] else np.full(len(y), np.nan) for c in range(k)]
            flat = np.stack(white, axis=1).ravel()
            rows = len(y)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, n, np.int64)),
                    pa.array([d for d in deviations(off) for _ in range(k)], pa.int64()),
                    pa.array(flat, pa.float64(), from_pandas=True),  # nan becomes null
                    pa.array(explained * rows, pa.float64()),
                    pa.array([error] * (rows * k), pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row and leading component.

    Components have unit length and a positive largest entry, and are numbered from 1 by falling eigenvalue.
    """
    spark = embeddings.sparkSession
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    placed = on_grid(embeddings)
    distinct = checkpointed(placed.select("x").distinct())
    first = distinct.first()
    if first is None:
        return spark.createDataFrame([], schema)
    dim = len(first.x)
    parts = distinct.mapInArrow(_sums(dim), "of string, part string")
    totals = {r.of: int(r.total) for r in parts.groupBy("of").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()}
    n, sums = totals["n"], [totals[str(i)] for i in range(dim)]

    spectrum = Spectrum.of_row(gathered(distinct.mapInArrow(_spectra(dim), "v array<double>"), _combined(dim)), dim)
    basis, _ = np.linalg.qr(spectrum.vectors[:, ::-1])
    whole = covariance(distinct, dim, n, sums, basis)
    values, turn = np.linalg.eigh((whole + whole.T) / 2)
    trace = float(np.trace(whole))
    lead = np.argsort(-values, kind="stable")[: min(components, dim)]
    axes = basis @ turn[:, lead]
    axes = axes / np.sqrt((axes * axes).sum(axis=0))
    axes = axes * np.sign(axes[np.argmax(np.abs(axes), axis=0), np.arange(len(lead))])
    roots = [float(v) if v > NEGLIGIBLE * max(values[-1], 0) and v > 0 else None for v in values[lead]]
    explained = [float(max(v, 0) / trace) if trace > 0 else None for v in values[lead]]
    live = [i for i, r in enumerate(roots) if r]
    error = None
    if live:
        unit = covariance(distinct, dim, n, sums, axes[:, live] / np.sqrt([roots[i] for i in live]))
        error = float(np.abs(unit - np.eye(len(live))).max())
    return placed.mapInArrow(_rows(dim, n, sums, axes, roots, explained, error), schema)
