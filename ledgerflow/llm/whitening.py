"""Operator 13: leading principal components by a block Jacobi-Davidson method on distributed products, and whitening."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import durable
from .common import give_back

SCALE, SHIFT = 1024, 100_000
INNER = 3  # MINRES steps at most for one correction
FEWER = 0.05  # a correction is good enough when its residual has shrunk to this share
START, LARGEST = 3, 8  # size of the subspace at the start and at most, times the wanted vectors
BLOCK = 4096  # vectors multiplied at once


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """``(vec_id, x)`` of the rows fit to be used, and their width: the commonest length, of equals the longest."""
    value = F.col("v").cast("array<double>")
    sound = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall(value, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.select(vectors[id_col].alias("vec_id"), vectors[vector_col].alias("v")).where(F.coalesce(sound, F.lit(False)))
    commonest = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = commonest.width if commonest else 0
    whole = F.transform(value, lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    return rows.where(F.size("v") == width).select("vec_id", whole.alias("x")), width


@dataclass
class Centred:
    """All vectors ``x`` less their mean, reachable only by passes over them.

    The mean is kept as the exact sums ``S`` and the number ``n``: ``(n x - S) / n``
    rounds once, so nothing is lost by centring.
    """

    rows: DataFrame
    n: int
    sums: np.ndarray
    adders: int = 1

    def passed(self, each: Callable[[np.ndarray], np.ndarray], count: int) -> np.ndarray:
        """Sum over all blocks of vectors of ``each(block)``, ``count`` numbers: one partial sum per task, added up 64 at a time."""
        n, sums = self.n, self.sums

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            give_back()
            total = np.zeros(count)
            for batch in batches:
                x = _matrix(batch.column(0), len(sums))
                for at in range(0, len(x), BLOCK):
                    total += each((n * x[at:at + BLOCK] - sums) / n)
            yield packed(total)

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(count)
            for batch in batches:
                for part in batch.column(0):
                    total += np.frombuffer(part.as_py())
            yield packed(total)

        def packed(total: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["part"])

        parts = self.rows.select("x").mapInArrow(run, "part binary")
        totals = parts.repartition(self.adders).mapInArrow(added, "part binary").collect()
        return np.sum([np.frombuffer(row.part) for row in totals], axis=0)

    def product(self, q: np.ndarray) -> np.ndarray:
        """The covariance times the columns of ``q``, in one pass and without forming the covariance."""
        return self.passed(lambda c: (c.T @ (c @ q)).ravel(), q.size).reshape(q.shape) / self.n

    def covariance_of(self, w: np.ndarray) -> np.ndarray:
        """Covariance of the vectors projected on the columns of ``w``."""
        k = w.shape[1]
        mean = self.passed(lambda c: (c @ w).sum(axis=0), k) / self.n

        def squares(c: np.ndarray) -> np.ndarray:
            z = c @ w - mean
            return (z.T @ z).ravel()

        return self.passed(squares, k * k).reshape(k, k) / self.n


def orthonormal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """The columns of ``new`` made orthonormal to the bases and each other; those that add nothing are left out."""
    kept: list[np.ndarray] = []
    for column in new.T:
        before = np.linalg.norm(column)
        if not before > 0:
            continue
        column = column / before
        for _ in range(3):
            for base in bases:
                column = column - base @ (base.T @ column)
            for other in kept:
                column = column - other * (other @ column)
            size = np.linalg.norm(column)
            if size < 1e-10:
                break
            column = column / size
        else:
            kept.append(column)
    return np.array(kept).T.reshape(len(new), len(kept))


def minres(product: Callable[[np.ndarray], np.ndarray], right: np.ndarray, shifts: np.ndarray, project: Callable[[np.ndarray], np.ndarray],
           steps: int, enough: float) -> np.ndarray:
    """Solve ``P (A - shift) P t = right`` for every column at once by MINRES; one product with ``A`` per step.

    Each column has its own shift and its own Lanczos row; columns that have
    converged or broken down stay as they are while the others go on.
    """
    t = np.zeros_like(right)
    beta = np.linalg.norm(right, axis=0)
    start = np.where(beta > 0, beta, 1.0)
    v_old, v = np.zeros_like(right), right / start
    w_old, w = np.zeros_like(right), np.zeros_like(right)
    rest = beta.copy()  # residual carried along, with its sign
    c_old = c = -np.ones(right.shape[1])
    s_old = s = np.zeros(right.shape[1])
    b = np.zeros(right.shape[1])
    live = beta > 0
    for _ in range(steps):
        if not live.any():
            break
        y = np.zeros_like(v)
        y[:, live] = product(v[:, live])
        y = project(y - v * shifts) - v_old * b
        alpha = (v * y).sum(axis=0)
        y = project(y - v * alpha)
        b_new = np.linalg.norm(y, axis=0)
        # Two earlier rotations, then the new one.
        epsilon = s_old * b
        delta_bar = -c_old * b
        delta = c * delta_bar + s * alpha
        gamma_bar = s * delta_bar - c * alpha
        gamma = np.hypot(gamma_bar, b_new)
        safe = np.where(gamma > 0, gamma, 1.0)
        c_new, s_new = gamma_bar / safe, b_new / safe
        w_new = (v - w_old * epsilon - w * delta) / safe
        go = live & (gamma > 1e-300)
        t[:, go] += (w_new * (c_new * rest))[:, go]
        rest = np.where(go, s_new * rest, rest)
        w_old, w = w, w_new
        c_old, s_old, c, s = c, s, c_new, s_new
        live = go & (np.abs(rest) > enough * beta) & (b_new > 1e-14 * np.maximum(np.abs(alpha), 1e-300))
        v_old, v = v, np.where(b_new > 0, y / np.where(b_new > 0, b_new, 1.0), 0.0)
        b = b_new
    return t


def leading_pairs(product: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their vectors, by block Jacobi-Davidson.

    Rayleigh-Ritz in a growing subspace; Ritz pairs whose residual has reached
    double precision are locked in order and taken out; for all others of the
    wanted ones the projected correction equation is solved by a few MINRES steps,
    in lockstep so that a step is one product. The subspace restarts from its
    best vectors when it is eight times as large as wanted; vectors no wider than
    that are searched whole before it comes to a restart.
    """
    wanted = min(wanted, width)
    space = orthonormal(np.random.default_rng(seed).standard_normal((width, min(width, START * wanted))))
    images = product(space)
    locked, locked_images, values = np.zeros((width, 0)), np.zeros((width, 0)), np.zeros(0)
    scale, best, stalled = 0.0, np.inf, 0
    while True:
        h = space.T @ images
        theta, turn = np.linalg.eigh((h + h.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        space, images = space @ turn, images @ turn
        scale = max(scale, np.abs(theta).max(initial=0.0), np.abs(values).max(initial=0.0))
        missing = wanted - len(values)
        todo = min(missing, space.shape[1])
        wrong = images[:, :todo] - space[:, :todo] * theta[:todo]
        wrong -= locked @ (locked.T @ wrong)
        size = np.linalg.norm(wrong, axis=0)
        full = locked.shape[1] + space.shape[1] >= width
        # The floor of rounding: with the whole space searched, or no more progress, nothing better can be had.
        worst = size.max(initial=0.0)
        stalled = stalled + 1 if worst > best / 2 else 0
        best = min(best, worst)
        limit = width * np.finfo(float).eps * scale
        reached = size <= limit
        if full:
            reached[:] = True
        elif stalled >= 8:
            reached = size <= 10 * limit
        if stalled > 200:
            raise RuntimeError(f"residuals stay at {worst:.2e} of {scale:.2e}")
        ready = int(np.argmin(np.append(reached, False)))
        if ready:
            locked, locked_images = np.hstack([locked, space[:, :ready]]), np.hstack([locked_images, images[:, :ready]])
            values = np.append(values, theta[:ready])
            space, images, theta, wrong = space[:, ready:], images[:, ready:], theta[ready:], wrong[:, ready:]
            todo, best, stalled = todo - ready, np.inf, 0
        if len(values) == wanted:
            break
        if space.shape[1] > (LARGEST - 1) * wanted:
            space, images = space[:, : START * wanted], images[:, : START * wanted]
        near = space[:, :todo]

        def project(y: np.ndarray) -> np.ndarray:
            y = y - locked @ (locked.T @ y)
            return y - near * (near * y).sum(axis=0)

        corrections = minres(product, -project(wrong), theta[:todo], project, INNER, FEWER)
        fresh = orthonormal(np.hstack([corrections, wrong]) if not np.any(corrections) else corrections, locked, space)
        if not fresh.shape[1]:
            # Corrections that lie in the space already: go on with any other direction.
            fresh = orthonormal(np.random.default_rng(seed + space.shape[1]).standard_normal((width, todo)), locked, space)
        fresh = fresh[:, : width - locked.shape[1] - space.shape[1]]
        space, images = np.hstack([space, fresh]), np.hstack([images, product(fresh)])
    # A last Rayleigh-Ritz step in the locked space puts the pairs in order.
    h = locked.T @ locked_images
    theta, turn = np.linalg.eigh((h + h.T) / 2)
    return theta[::-1], locked @ turn[:, ::-1]


WHITENED = "vec_id {}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def _deviations(t: np.ndarray) -> list:
    """Exact sums of the squares of each row of longs."""
    most = int(np.abs(t).max(initial=0))
    if most * most * t.shape[1] < 1 << 63:
        return (t * t).sum(axis=1).tolist()
    return (t.astype(object) ** 2).sum(axis=1).tolist()


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``: a row for each vector and component.

    Entries become ``x = floor(1024 c) + 100000``. Components are unit
    eigenvectors of the covariance of all ``x`` (divisor ``n``), numbered from 1 by
    falling eigenvalue; each one's sign makes its largest entry positive.
    ``deviation`` is the exact sum of ``(n x - S)^2``, as decimal(38,0).

    Rows are dropped whose vector is NULL, empty, or holds NULL or non-finite
    entries, or has another length than most. Repeated rows and ids, and NULL
    ids, are rows like any other. Components without variance to double precision
    cannot be whitened and are left out, so equal vectors, a single one or an
    empty table give no rows. Columns besides the two are not looked at.
    Entries so large that ``n x`` leaves 63 bits are an error.

    The covariance is never formed: each product with a block of directions is a
    pass over the vectors, which are kept as one table of the shared folder;
    tasks send sums of the size of the block. The driver holds the subspace, of
    the vector's width times a few dozen columns, whatever the number of rows.
    """
    rows, width = quantised(vectors, id_col, vector_col)
    kind = rows.schema["vec_id"].dataType.simpleString()
    nothing = vectors.sparkSession.createDataFrame([], WHITENED.format(kind))
    if not width:
        return nothing
    rows = durable(rows, "vectors")
    entries = rows.select(F.posexplode("x").alias("at", "c")).groupBy("at").agg(F.sum("c").alias("sum"), F.max(F.abs("c")).alias("most"), F.count(F.lit(1)).alias("n"))
    found = sorted(entries.collect())
    n = found[0].n
    if n * max(r.most for r in found) >= 1 << 62:
        raise ValueError("vectors hold entries too large for exact sums")
    sums = np.array([r["sum"] for r in found], np.int64)
    # One adder for about 64 tasks of 32 MB.
    centred = Centred(rows, n, sums, 1 + n * width // (1 << 28))
    values, axes = leading_pairs(centred.product, width, components)
    trace = float(centred.passed(lambda c: np.array([(c * c).sum()]), 1)[0]) / n
    usable = values > width * np.finfo(float).eps * trace
    values, axes = values[usable], axes[:, usable]
    if not len(values):
        return nothing
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(values))])
    to_white = axes / np.sqrt(values)
    error = float(np.abs(centred.covariance_of(to_white) - np.eye(len(values))).max())
    explained, k = values / trace, len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                m = part.num_rows
                t = n * _matrix(part.column(1), width) - sums
                exact = pa.array(_deviations(t), pa.decimal128(38, 0))
                owner = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(owner), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), exact.take(owner),
                        pa.array(((t / n) @ to_white).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, WHITENED.format(kind))
