"""Whitening of embeddings: the leading components of their covariance by a block Jacobi-Davidson method.

The covariance is never built. Its product with a block of vectors is one pass
over the saved rows: each task sums d (d w) over its centred rows d, Spark adds
the sums. What reaches the driver is dimensions x block, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesaudit.llm.shared import saved

SCALE, SHIFT = 1024, 100_000  # of the whole numbers that stand for entries
LARGEST = 2.0**43  # from here on an entry's whole number is not exact as a double
HALF = 1 << 20  # whole numbers are summed in two parts, so that sums fit 64 bits
GUARD = 4  # further components in the block, so that close ones are told apart
INNER = 5  # steps of MINRES for a correction
ROUNDS = 200

Array = np.ndarray
Product = Callable[[Array], Array]


def whole_numbers(entries: Column) -> Column:
    """Entries as whole numbers, NULL for a vector with an entry that is NULL, not finite, or too large."""
    value = lambda x: x.cast("double")
    sound = F.forall(entries, lambda x: F.coalesce(~F.isnan(value(x)) & (F.abs(value(x)) < LARGEST), F.lit(False)))
    whole = F.transform(entries, lambda x: F.floor(value(x) * SCALE).cast("long") + F.lit(SHIFT))
    return F.when(sound & (F.size(entries) > 0), whole)


class Fit:
    """The rows to fit on: their number, dimensions and sums, and sums over them."""

    def __init__(self, rows: DataFrame, dimensions: int, n: int):
        self.rows, self.dimensions, self.n = rows, dimensions, n
        self.sums: list[int] = []
        parts = self.summed(lambda x: np.stack((x // HALF, x % HALF)).sum(axis=1), "long", "decimal(38,0)")
        self.sums = [int(high) * HALF + int(low) for high, low in zip(*np.split(parts, 2), strict=True)]

    def summed(self, work: Callable[[Array], Array], kind: str, total: str) -> Array:
        """The sum of ``work`` over blocks of whole-number rows, flat: added in the tasks, then by Spark."""
        dimensions = self.dimensions

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for batch in batches:
                if batch.num_rows:
                    part = work(_matrix(batch, dimensions))
                    held = part if held is None else held + part
            if held is not None:
                flat = held.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["place", "value"])

        parts = self.rows.select("x").mapInArrow(task, f"place int, value {kind}")
        added = parts.groupBy("place").agg(F.sum(F.col("value").cast(total)).alias("value")).collect()
        found = np.empty(len(added), dtype=object if kind == "long" else float)
        for row in added:
            found[row["place"]] = row["value"]
        return found

    def centred(self) -> Callable[[Array], Array]:
        """Rows less the mean as doubles: exact whole numbers n x - S first, then divided by n."""
        n, sums = self.n, self.sums
        return lambda x: numerators(x, n, sums).astype(float) / n

    def covariance(self, block: Array) -> Array:
        centred = self.centred()

        def work(x: Array) -> Array:
            d = centred(x)
            return d.T @ (d @ block)

        return self.summed(work, "double", "double").reshape(block.shape) / self.n


def _matrix(batch: pa.RecordBatch, dimensions: int) -> Array:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def numerators(x: Array, n: int, sums: list[int]) -> Array:
    """n x - S, exact: in 64 bits where they are enough."""
    if n * int(np.abs(x).max()) + max(map(abs, sums)) < 2**62:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def squares(d: Array) -> Array:
    """Sums of the squares of each row, exact."""
    if d.dtype != object and int(np.abs(d).max()) ** 2 * d.shape[1] < 2**62:
        return (d * d).sum(axis=1)
    wide = d.astype(object)
    return (wide * wide).sum(axis=1)


def _safe(x: Array) -> Array:
    """Without zeros, to divide by: what is divided is zero there too."""
    return np.where(x == 0, 1.0, x)


def minres(operator: Product, right: Array, steps: int, enough: float) -> Array:
    """Solutions of operator(x) = right by so many MINRES steps, for all columns in step.

    Each column has its own symmetric system; a step applies all of them at once.
    """
    first = np.linalg.norm(right, axis=0)
    x, w, w_before = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    v, v_before = right / _safe(first), np.zeros_like(right)
    cos = cos_before = np.ones_like(first)
    sin = sin_before = beta = np.zeros_like(first)
    rest = first.copy()
    for _ in range(steps):
        p = operator(v) - beta * v_before
        alpha = (v * p).sum(axis=0)
        p -= alpha * v
        longer = np.linalg.norm(p, axis=0)
        longer = np.where(longer > 1e-14 * (np.abs(alpha) + beta), longer, 0.0)
        turned = cos * alpha - cos_before * sin * beta
        length = np.hypot(turned, longer)
        w, w_before = (v - sin_before * beta * w_before - (sin * alpha + cos_before * cos * beta) * w) / _safe(length), w
        w[:, length == 0] = 0
        cos_before, cos = cos, turned / _safe(length)
        sin_before, sin = sin, longer / _safe(length)
        x += cos * rest * w
        rest = -sin * rest
        v_before, v, beta = v, np.where(longer > 0, p / _safe(longer), 0.0), longer
        if (np.abs(rest) <= enough * first).all():
            break
    return x


def _against(block: Array, basis: Array) -> Array:
    return block - basis @ (basis.T @ block)


def _orthonormal(block: Array, *bases: Array) -> Array:
    """An orthonormal basis of what ``block`` has outside the orthonormal ``bases``."""
    norms = np.linalg.norm(block, axis=0)
    block = block[:, norms > 0] / norms[norms > 0]
    for _ in range(2):
        for basis in bases:
            block = _against(block, basis)
    found = np.zeros((len(block), 0))
    for column in block.T:
        for _ in range(2):
            for basis in (*bases, found):
                column = _against(column, basis)
        norm = np.linalg.norm(column)
        if norm > 1e-10:
            found = np.column_stack((found, column / norm))
    return found


def leading_components(product: Product, dimensions: int, components: int) -> tuple[Array, Array]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix given by its product with a block.

    Block Jacobi-Davidson. Rayleigh-Ritz in a search space gives approximate
    pairs; for each of the leading ones the correction equation
    (I - QQ')(V - value)(I - QQ') t = -residual, Q the locked vectors and its
    own, is solved roughly by MINRES, and the corrections enlarge the space. A
    pair is locked when those above it are and its residual is at the rounding
    error of the product, dimensions x 2**-52 of the largest value.
    """
    wanted = min(components, dimensions)
    width = min(dimensions, wanted + GUARD)
    most = min(dimensions, 4 * width)
    basis = _orthonormal(np.random.default_rng(0).standard_normal((dimensions, width)))
    image = product(basis)
    locked, values = np.zeros((dimensions, 0)), np.zeros(0)
    largest = 0.0
    for _ in range(ROUNDS):
        small = basis.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        residual = image - basis * theta
        norms = np.linalg.norm(residual, axis=0)
        largest = max(largest, abs(theta[0]) if len(theta) else 0.0)
        good = norms <= max(dimensions, 32) * np.finfo(float).eps * largest
        done = int(np.argmin(good)) if not good.all() else len(good)
        done = min(done, wanted - len(values))
        locked, values = np.column_stack((locked, basis[:, :done])), np.append(values, theta[:done])
        if len(values) == wanted:
            return values, locked
        basis, image, theta, residual = basis[:, done:], image[:, done:], theta[done:], residual[:, done:]
        block = min(width, wanted - len(values) + GUARD, basis.shape[1])
        if basis.shape[1] + block > most:
            basis, image = basis[:, : most - 2 * block or block], image[:, : most - 2 * block or block]
        own, shift, right = basis[:, :block], theta[:block], -residual[:, :block]

        def projected(t: Array, own: Array = own) -> Array:
            t = _against(t, locked)
            return t - own * (own * t).sum(axis=0)

        def operator(t: Array, shift: Array = shift, projected: Product = projected) -> Array:
            t = projected(t)
            return projected(product(t) - shift * t)

        found = minres(operator, projected(right), INNER, 1e-3)
        new = _orthonormal(projected(found), locked, basis)
        if not new.shape[1]:  # the space is closed: another direction, if there is one
            new = _orthonormal(np.eye(dimensions), locked, basis)[:, :1]
        if new.shape[1]:
            basis, image = np.column_stack((basis, new)), np.column_stack((image, product(new)))
    raise RuntimeError(f"the components did not settle in {ROUNDS} rounds")


def _whitener(fit: Fit, directions: Array, values: Array) -> Callable[[Array], Array]:
    centred, scaled = fit.centred(), directions / np.sqrt(values)
    return lambda x: centred(x) @ scaled


def identity_error(fit: Fit, whitener: Callable[[Array], Array], components: int) -> float:
    """Largest absolute entry of the covariance of the whitened rows less the identity."""

    def work(x: Array) -> Array:
        w = whitener(x)
        return np.vstack((w.sum(axis=0), w.T @ w))

    parts = fit.summed(work, "double", "double").reshape(components + 1, components) / fit.n
    return float(np.abs(parts[1:] - np.outer(parts[0], parts[0]) - np.eye(components)).max())


def whitened(vectors: DataFrame, components: int = 8, embedding: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """Per fitted row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    An entry c becomes x = floor(1024 c) + 100000. Left out are rows whose
    vector is NULL or empty, holds a NULL or an entry that is not finite, or one
    of 2**43 or more, or has not the commonest length (of equally common ones
    the larger). All others, repeated ones included, are the fit list of n rows
    with sums S. Components are numbered from 1 by falling variance; one without
    variance (up to rounding) cannot be scaled and has no rows, so that equal
    rows alone give none. whitened is (x - S/n) on the component over its
    deviation; deviation is the exact sum over dimensions of (n x - S)^2, NULL
    beyond 38 digits; explained is the component's share of all variance;
    identity_error is one value for all rows. NULL ids stay as they are, an
    empty table gives no rows, and other columns are not read.
    """
    kept = vectors.select(F.col(id_column).alias("vec_id"), whole_numbers(F.col(embedding)).alias("x")).filter("x IS NOT NULL")
    kept = saved(kept, "whole-vectors")
    common = kept.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    kind = kept.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if common is None:
        return kept.sparkSession.createDataFrame([], schema)
    dimensions, n = common["size"], common["count"]
    fit = Fit(kept.filter(F.size("x") == dimensions), dimensions, n)
    values, directions = leading_components(fit.covariance, dimensions, components)
    sound = values > dimensions * np.finfo(float).eps * max(values[0], 0.0)
    values, directions = values[sound], directions[:, sound]
    many = len(values)
    if not many:
        return kept.sparkSession.createDataFrame([], schema)
    centred = fit.centred()
    trace = float(fit.summed(lambda x: np.square(centred(x)).sum(axis=0), "double", "double").sum()) / n
    whitener, explained = _whitener(fit, directions, values), values / trace
    error, sums = identity_error(fit, whitener, many), fit.sums

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, dimensions)
            own = [Decimal(int(v)) if abs(int(v)) < 10**38 else None for v in squares(numerators(x, n, sums))]
            rows = pa.array(np.repeat(np.arange(len(x)), many))
            columns = [
                batch.column("vec_id").take(rows),
                pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(rows), n, dtype=np.int64)),
                pa.array(own, pa.decimal128(38, 0)).take(rows),
                pa.array(whitener(x).ravel()),
                pa.array(np.tile(explained, len(x))),
                pa.array(np.full(len(rows), error)),
            ]
            names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return fit.rows.mapInArrow(task, schema)
