"""Embedding whitening (operator 11) with principal directions from LOBPCG.

The covariance is never built. Each iteration spans a basis by the iterate, its residuals and the
previous directions, multiplies the covariance with the whole basis in one pass over the rows (each
task sums X'(XB) of its centred rows, the sums are added by entry), and takes the best vectors of
the span (Rayleigh-Ritz). As the products are fresh in each pass, so are the residuals; it ends
when every wanted component's residual is certified to be at double precision, and fails if that
isn't reached. Rows are centred exactly: (n * x - S) / n with integers n * x - S.

Defined results: rows whose vector is null or holds null or non-finite entries are left out, and so
are vectors that aren't as long as most are (ties: the longer ones); directions without variance
(at most a multiple of rounding beside the largest eigenvalue) aren't components, so equal rows
have none; a deviation that doesn't fit a long is null; rows of one key, or with a null key, are
rows of their own; an empty table gives no rows. Columns beside key and vector aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, stash
from .topk import finite

#: Vectors iterated beside the wanted ones: the last of these converge faster.
GUARD = 8
MOST_ITERATIONS = 1_000
#: Rows that are multiplied at once.
SLICE = 4_096


def integers(rows: DataFrame, key: str, vector: str, scale: int, shift: int) -> DataFrame:
    """key and x: floor(scale * entry) + shift, of the vectors of the usual length."""
    v = F.col(vector).cast("array<double>")
    made = rows.filter(finite(v)).select(F.col(key).alias("id"), F.transform(v, lambda c: F.floor(c * scale) + shift).alias("x"))
    made = stash(made, "integers")
    usual = made.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return made.filter(F.size("x") == (usual["d"] if usual else 0))


def matrix(b: pa.RecordBatch, d: int) -> np.ndarray:
    return b["x"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d)


def summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], d: int, size: int, kind: str) -> np.ndarray:
    """The sum of part(matrix of a batch), `size` numbers, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                own = part(matrix(b.slice(at, SLICE), d))
                total = own if total is None else total + own
        if total is not None:
            yield pa.record_batch({"at": np.arange(size, dtype=np.int32), "value": total})

    out = np.zeros(size, np.int64 if kind == "long" else np.float64)
    for at, value in rows.select("x").mapInArrow(run, f"at int, value {kind}").groupBy("at").agg(F.sum("value")).collect():
        out[at] = value
    return out


def independent(basis: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span what block adds to the orthonormal basis."""
    length = np.linalg.norm(block, axis=0)
    block = block[:, length > 0] / length[length > 0]
    for least in (1e-8, 0.5):
        block = block - basis @ (basis.T @ block)
        if not block.shape[1]:
            break
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > least]
    return block[:, : basis.shape[0] - basis.shape[1]]


@dataclass
class Components:
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    passes: int


def lobpcg(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, seed: int = 7) -> Components:
    """The k largest eigenvalues and unit eigenvectors of a symmetric matrix known by its products
    with blocks of columns, with residuals certified to a few roundings of the largest eigenvalue."""
    m = min(d, k + GUARD)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, m)))[0]
    for passes in range(1, MOST_ITERATIONS + 1):
        made = product(basis)
        small = basis.T @ made
        values, q = np.linalg.eigh((small + small.T) / 2)
        values, q = values[::-1][:m], q[:, ::-1][:, :m]
        x = basis @ q
        left = made @ q - x * values
        sizes = np.linalg.norm(left[:, :k], axis=0)
        if (sizes <= np.maximum(1e-13 * np.abs(values[:k]), 8 * d * np.finfo(float).eps * max(values[0], 0))).all():
            return Components(values[:k], x[:, :k], sizes, passes)
        step = basis[:, m:] @ q[m:]
        basis = np.linalg.qr(x)[0]
        for block in (left, step):
            basis = np.hstack([basis, independent(basis, block)])
    raise RuntimeError(f"the residuals reached {sizes.max():.3g} only")


@dataclass
class Whitening:
    """rows: id, x; n rows, sums and directions; explained: each component's share of the variance;
    error: of the whitened rows' covariance against the identity."""

    rows: DataFrame
    n: int
    sums: np.ndarray
    found: Components
    explained: np.ndarray
    error: float

    def centred(self) -> Callable[[np.ndarray], np.ndarray]:
        n, sums = self.n, self.sums
        return lambda x: (n * x - sums) / n

    def apply(self) -> DataFrame:
        """id, deviation, whitened (array<double>) of every row."""
        n, sums, e, v = self.n, self.sums, self.found.values, self.found.vectors

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                away = n * matrix(b, len(sums)) - sums
                white = (away / n) @ v / np.sqrt(e)
                fits = (away.astype(float) ** 2).sum(axis=1) < 2.0**63 * (1 - 1e-9)
                with np.errstate(over="ignore"):
                    deviation = pa.array((away * away).sum(axis=1), mask=~fits)
                yield pa.record_batch({"id": b["id"], "deviation": deviation, "whitened": pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * len(e), pa.int32()), pa.array(white.ravel()))})

        return self.rows.mapInArrow(run, f"id {dict(self.rows.dtypes)['id']}, deviation long, whitened array<double>")


def fit(rows: DataFrame, components: int) -> Whitening:
    """Fitted on all of rows(id, x array<long>), which are of one length and have been written."""
    ready(rows.sparkSession)
    first = rows.select(F.size("x").alias("d")).first()
    d = first["d"] if first else 0
    if not d:
        return Whitening(rows, 0, np.zeros(d, np.int64), Components(np.zeros(0), np.zeros((d, 0)), np.zeros(0), 0), np.zeros(0), 0.0)
    told = summed(rows, lambda x: np.append(x.sum(axis=0), len(x)), d, d + 1, "long")
    n, sums = int(told[-1]), told[:-1]
    made = Whitening(rows, n, sums, Components(np.zeros(0), np.zeros((d, 0)), np.zeros(0), 0), np.zeros(0), 0.0)
    centred = made.centred()
    trace = summed(rows, lambda x: (centred(x) ** 2).sum(axis=0), d, d, "double").sum() / n

    def product(block: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = centred(x)
            return (c.T @ (c @ block)).ravel()

        return summed(rows, part, d, block.size, "double").reshape(block.shape) / n

    found = lobpcg(product, d, min(components, d)) if trace > 0 else made.found
    real = found.values > 16 * d * np.finfo(float).eps * found.values.max(initial=0)
    made.found = Components(found.values[real], found.vectors[:, real], found.residuals[real], found.passes)
    made.explained = made.found.values / trace if trace > 0 else np.zeros(0)
    m = int(real.sum())
    if m:
        over = made.found.vectors / np.sqrt(made.found.values)

        def part(x: np.ndarray) -> np.ndarray:
            w = centred(x) @ over
            return np.append((w.T @ w).ravel(), w.sum(axis=0))

        told = summed(rows, part, d, m * m + m, "double") / n
        made.error = float(np.abs(told[: m * m].reshape(m, m) - np.outer(told[m * m :], told[m * m :]) - np.eye(m)).max())
    return made
