"""Whitening of embeddings by a QDWH spectral divide and conquer.

Entries become whole numbers by a fixed scale. Rows of equal vectors count once in what is
fitted: exact sums per dimension and one small covariance matrix per task, added up by Spark.
Only matrices of dimension x dimension reach the driver, whatever the number of rows; there a
polar decomposition of the shifted covariance (dynamically weighted Halley iterations by QR,
or Cholesky once well conditioned) gives the projector on the eigenvectors above the shift,
which splits the matrix into two smaller ones, until a block is a multiple of the identity.
The components, at most dimension x components numbers, are broadcast to whiten all rows.

Rows whose vector is null, or holds a null or non-finite entry, are dropped; so are empty
vectors, as they have no component. Repeated rows each get their result; a null id is kept.
Vectors of another length are another fit, with components of their own. A component whose
variance is nothing but rounding (fewer distinct vectors than dimensions, constant entries)
has a null ``whitened`` and no part in ``identity_error``. A ``deviation`` that a long cannot
hold is null. An empty table gives no rows. Further columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsig.session import materialize

SCALE, OFFSET = 64, 1_000_000
#: Rows of an Arrow batch that are worked on at once.
ROWS = 2048
#: Most dimensions of a vector: the covariance, and its split on the driver, stay bounded by this.
MAX_DIMENSIONS = 4096
EPS = np.finfo(float).eps


# ---- The spectral divide and conquer, on one small symmetric matrix ----


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric nonsingular matrix by QDWH."""
    d = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    # A lower bound of the least singular value; too small a bound costs an iteration.
    low = EPS
    for _ in range(30):
        squared = low * low
        root = np.cbrt(4 * (1 - squared) / (squared * squared))
        first = np.sqrt(1 + root)
        wa = first + 0.5 * np.sqrt(8 - 4 * root + 8 * (2 - squared) / (squared * first))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(d)]))[0]
            y = (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * (q[:d] @ q[d:].T)
        else:
            z = np.eye(d) + wc * (x.T @ x)
            y = (wb / wc) * x + (wa - wb / wc) * np.linalg.solve(z, x.T).T
        y = (y + y.T) / 2
        low = min(low * (wa + wb * squared) / (1 + wc * squared), 1 - EPS)
        moved, x = np.linalg.norm(y - x), y
        if moved < np.cbrt(EPS) ** 2 and 1 - low < 1e-8:
            break
    return x


def invariant_basis(projector: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of a projector's range and of its complement, by subspace iteration."""
    d = len(projector)
    # The columns of the largest diagonal entries start; fixed noise makes them independent.
    start = projector[:, np.argsort(-np.diag(projector), kind="stable")]
    noise = np.random.default_rng(d).standard_normal((d, rank))
    basis = np.linalg.qr(projector @ (start[:, :rank] + noise))[0]
    basis = np.linalg.qr(projector @ basis)[0]
    whole = np.linalg.qr(np.hstack([basis, np.eye(d)]))[0]
    return whole[:, :rank], whole[:, rank:]


def components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by fall and unit eigenvectors in columns, by recursive spectral splits."""
    d = len(v)
    scale = np.linalg.norm(v)
    values, vectors = [], []
    stack = [np.eye(d)]
    while stack:
        basis = stack.pop()
        a = basis.T @ v @ basis
        a = (a + a.T) / 2
        m = len(a)
        centre = np.trace(a) / m
        if m == 1 or np.linalg.norm(a - centre * np.eye(m)) <= 4 * EPS * scale:
            values += [*np.diag(a)]
            vectors += [*basis.T]
            continue
        stack += [basis @ part for part in split(a)]
    values, vectors = np.array(values), np.array(vectors)
    by = np.argsort(-values, kind="stable")
    return values[by], vectors[by].T


def split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bases of two complementary invariant subspaces of a symmetric matrix that is no multiple
    of the identity."""
    m = len(a)
    low = float((np.diag(a) - np.abs(a).sum(axis=1) + np.abs(np.diag(a))).min())
    high = float((np.diag(a) + np.abs(a).sum(axis=1) - np.abs(np.diag(a))).max())
    # The mean of the eigenvalues lies strictly between least and largest; the median of
    # the diagonal usually halves the matrix.
    shifts = [float(np.median(np.diag(a))), float(np.trace(a) / m)]
    best, least = None, np.inf
    for shift in [*shifts, *np.linspace(low, high, 9)[1:-1]]:
        u = polar(a - shift * np.eye(m))
        rank = int(round((np.trace(u) + m) / 2))
        if not 0 < rank < m:
            continue
        parts = invariant_basis((u + np.eye(m)) / 2, rank)
        # How far the subspace is from invariant: a shift on an eigenvalue shows here.
        off = np.linalg.norm(parts[0].T @ a @ parts[1])
        if off < least:
            best, least = parts, off
        if off <= 64 * EPS * np.linalg.norm(a):
            break
    if best is None:
        raise ArithmeticError("no shift splits the spectrum")
    return best


# ---- What is fitted, from Spark's sums ----


@dataclass
class Model:
    """Of one vector length: distinct vectors, exact sums, variances and unit components."""

    n: int
    sums: np.ndarray
    variances: np.ndarray
    vectors: np.ndarray
    total: float
    identity_error: float | None = None

    @property
    def usable(self) -> np.ndarray:
        """Components whose variance is more than the rounding of the largest."""
        if not len(self.variances):
            return np.zeros(0, bool)
        return self.variances > len(self.sums) * 16 * EPS * max(self.total, 0.0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - sums / n`` without cancellation: whole numbers first, then the fraction."""
        whole = self.sums // self.n
        return (x - whole).astype(float) - (self.sums - whole * self.n) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            made = (self.centred(x) @ self.vectors) / np.sqrt(np.maximum(self.variances, 0))
        made[:, ~self.usable] = np.nan
        return made

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums of ``(n x - sums) ** 2``, exact."""
        apart, rest = x - self.sums // self.n, self.sums % self.n
        most = self.n * (int(np.abs(apart).max(initial=0)) + 1)
        if most * most * max(apart.shape[1], 1) < 1 << 63:
            return ((self.n * apart - rest) ** 2).sum(axis=1).tolist()
        own = rest.tolist()
        made = [sum((self.n * v - r) ** 2 for v, r in zip(row, own)) for row in apart.tolist()]
        return [v if v < 1 << 63 else None for v in made]


def scaled(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``key`` and ``x``, the whole numbers of each usable vector."""
    v = F.col(vector).cast("array<double>")
    odd = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(v, lambda c: F.floor(c * SCALE).cast("bigint") + OFFSET)
    usable = F.col(vector).isNotNull() & (F.size(v) > 0) & ~F.coalesce(odd, F.lit(True))
    return df.filter(usable).select(F.col(key), whole.alias("x"))


def _matrices(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places and rows of a batch's vectors, some thousands at a time."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for d in np.unique(sizes):
        places = np.flatnonzero(sizes == d)
        for a in range(0, len(places), ROWS):
            own = places[a : a + ROWS]
            yield int(d), own, flat[starts[own][:, None] + np.arange(d)]


def _summed(table: DataFrame, part) -> dict[int, tuple[int, np.ndarray]]:
    """Per vector length the number of rows of ``table`` and the sum of ``part(d, x)``, an array
    of a shape that depends on ``d`` alone. One partial sum per task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in batches:
            for d, own, x in _matrices(batch.column("x")):
                held = totals.setdefault(d, [0, 0])
                held[0] += len(own)
                held[1] = held[1] + part(d, x)
        for d, (n, total) in totals.items():
            whole = total.dtype.kind == "i"
            at = pa.array(np.arange(total.size), pa.int32())
            flat, none = pa.array(total.ravel()), pa.nulls(total.size)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(total.size, d), pa.int32()),
                    at,
                    pa.array(np.full(total.size, n)),
                    flat if whole else none.cast(pa.int64()),
                    none.cast(pa.float64()) if whole else flat,
                ],
                names=["d", "at", "n", "whole", "real"],
            )

    parts = table.mapInArrow(run, "d int, at int, n bigint, whole bigint, real double")
    rows = (
        parts.groupBy("d", "at")
        .agg(F.sum("n").alias("n"), F.sum("whole").alias("whole"), F.sum("real").alias("real"))
        .orderBy("d", "at")
        .toPandas()
    )
    found = {}
    for d, own in rows.groupby("d"):
        value = own["whole"] if own["real"].isna().all() else own["real"]
        found[int(d)] = (int(own["n"].iloc[0]), value.to_numpy())
    return found


def fit(distinct: DataFrame, keep: int = 16) -> dict[int, Model]:
    """A model per vector length of ``distinct``, a stored table of distinct vectors ``x``."""
    longest = distinct.agg(F.max(F.size("x"))).first()[0] or 0
    if longest > MAX_DIMENSIONS:
        raise ValueError(f"vectors have at most {MAX_DIMENSIONS} dimensions, not {longest}")
    empty = np.zeros(0)
    models = {
        d: Model(n, sums.astype(np.int64), empty, np.zeros((d, 0)), 0.0)
        for d, (n, sums) in _summed(distinct, lambda d, x: x.sum(axis=0)).items()
    }

    def products(made: np.ndarray) -> np.ndarray:
        return made.T @ made

    grams = _summed(distinct, lambda d, x: products(models[d].centred(x)))
    for d, (n, gram) in grams.items():
        covariance = gram.reshape(d, d) / n
        values, vectors = components((covariance + covariance.T) / 2)
        models[d].total = float(np.trace(covariance))
        models[d].variances, models[d].vectors = values[:keep], vectors[:, :keep]
    held = _summed(distinct, lambda d, x: products(np.nan_to_num(models[d].whitened(x))))
    for d, (n, gram) in held.items():
        model = models[d]
        c = len(model.variances)
        apart = np.abs(gram.reshape(c, c) / n - np.eye(c))[np.ix_(model.usable, model.usable)]
        model.identity_error = float(apart.max()) if apart.size else None
    return models


def whitened(df: DataFrame, key: str, vector: str, keep: int = 16) -> DataFrame:
    """Per usable row and component: ``key``, ``component`` (from 1, by falling variance), ``n``,
    ``deviation``, ``whitened``, ``explained`` and ``identity_error``."""
    rows = scaled(df, key, vector)
    models = fit(materialize(rows.select("x").distinct()), keep)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, own, x in _matrices(batch.column("x")):
                model = models[d]
                c = len(model.variances)
                made = model.whitened(x).ravel()
                share = model.variances / model.total if model.total > 0 else np.zeros(c)
                each = np.repeat(own, c)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, c + 1), len(own)), pa.int32()),
                        pa.array(np.full(len(each), model.n)),
                        pa.array(model.deviation(x), pa.int64()).take(
                            pa.array(np.repeat(np.arange(len(own)), c))
                        ),
                        pa.array(made, mask=np.isnan(made)),
                        pa.array(np.tile(share, len(own))),
                        pa.array([model.identity_error] * len(each), pa.float64()),
                    ],
                    names=["key", *OUTPUT],
                )

    schema = ", ".join(f"{n} {t}" for n, t in OUTPUT.items())
    return rows.mapInArrow(run, f"key {kind}, {schema}").withColumnRenamed("key", key)


OUTPUT = {
    "component": "int",
    "n": "bigint",
    "deviation": "bigint",
    "whitened": "double",
    "explained": "double",
    "identity_error": "double",
}
