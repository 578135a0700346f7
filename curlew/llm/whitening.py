"""Whitening of embeddings: principal components by QDWH spectral divide and conquer, applied to all rows.

Vectors become whole numbers; each distinct one counts once in the fit. Spark finds the distinct vectors (packed to as few bytes as their
components need, combined in each task before the shuffle), their sums and their centred products. Centring subtracts the whole number
nearest to the mean before multiplying, and the rest (at most a half) after, so that all sums are of whole numbers: exact, and the same in
any order, while they stay below 2^53.

The covariance, whose size depends on the number of dimensions alone, is taken apart on the driver. The polar factor of the covariance
less a shift has the eigenvalues -1 and 1, so half of it and the identity is the projector on the eigenvectors above the shift. The polar
factor comes from the dynamically weighted Halley iteration, in its form with QR while that is needed and with Cholesky later. A basis of the
projector's range and one of its complement cut the matrix into two independent blocks, which are divided in the same way down to single
eigenvectors. The resulting projection is broadcast, and each row is whitened where it lies.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curlew.llm.registry import query, table
from curlew.llm.vectors import extent, matrix
from curlew.session import store

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
LARGEST = 2.0**40  # beyond it the whole numbers would not be exact doubles after centring
EPS = np.finfo(np.float64).eps
FEW = 32  # groups of partial sums that are added up side by side


def polar_factor(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix: the same eigenvectors, each eigenvalue replaced by its sign."""
    x = a / np.linalg.norm(a)
    low, identity = EPS, np.eye(len(a))  # a lower bound of the smallest singular value that matters
    for _ in range(20):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        root = np.sqrt(1 + d)
        p = root + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low**2) / (low**2 * root)))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        if r > 100:
            upper, lower = np.split(np.linalg.qr(np.vstack([np.sqrt(r) * x, identity]))[0], [len(x)])
            y = q / r * x + (p - q / r) / np.sqrt(r) * (upper @ lower.T)
        else:
            factor = np.linalg.cholesky(identity + r * (x.T @ x))
            half = np.linalg.solve(factor, x.T)
            y = q / r * x + (p - q / r) * np.linalg.solve(factor.T, half).T
        y = (y + y.T) / 2
        low = min(1.0, low * (p + q * low**2) / (1 + r * low**2))
        still = np.linalg.norm(y - x) <= np.cbrt(4 * EPS) and 1 - low < 10 * EPS
        x = y
        if still:
            break
    return x


def _range_and_rest(projector: np.ndarray, rank: int) -> np.ndarray:
    """An orthogonal matrix whose first ``rank`` columns span the projector's range and whose others span its complement."""
    # the largest columns, taken one after another, lie well apart; then one step of subspace iteration
    rest, picked = projector.copy(), []
    for _ in range(rank):
        j = int((rest**2).sum(0).argmax())
        unit = rest[:, j] / np.linalg.norm(rest[:, j])
        rest -= np.outer(unit, unit @ rest)
        picked.append(j)
    basis = projector @ np.linalg.qr(projector[:, picked])[0]
    return np.linalg.qr(basis, mode="complete")[0]


def _divide(a: np.ndarray, scale: float) -> tuple[np.ndarray, int] | None:
    """(orthogonal matrix, size of the first block) that cuts a symmetric matrix in two; None if it is a multiple of the identity."""
    size = len(a)
    mean = np.trace(a) / size
    spread = np.linalg.norm(a - mean * np.eye(size)) / np.sqrt(size)
    if spread <= 4 * EPS * scale:
        return None
    best, least = None, np.inf
    for step in (0.0, 0.13, -0.13, 0.37, -0.37, 0.71, -0.71):  # other shifts if the mean is too close to an eigenvalue
        projector = (polar_factor(a - (mean + step * spread) * np.eye(size)) + np.eye(size)) / 2
        rank = round(np.trace(projector))
        if not 0 < rank < size:
            continue
        basis = _range_and_rest(projector, rank)
        loose = np.linalg.norm(basis[:, rank:].T @ a @ basis[:, :rank])
        if loose < least:
            best, least = (basis, rank), loose
        if least <= 8 * size * EPS * scale:
            break
    return best


def _refined(a: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors after a first-order correction of what rounding left between the blocks; equal eigenvalues keep
    their vectors but for orthogonality."""
    for _ in range(2):
        loose = np.eye(len(a)) - vectors.T @ vectors
        inner = vectors.T @ a @ vectors
        inner = (inner + inner.T) / 2  # so that the correction is a turn, however small a gap is
        values = np.diag(inner) / (1 - np.diag(loose))
        near = 2 * (np.linalg.norm(inner - np.diag(values), 2) + np.linalg.norm(a, 2) * np.linalg.norm(loose, 2))
        gaps = values[None, :] - values[:, None]
        apart = np.abs(gaps) > near
        vectors = vectors + vectors @ np.where(apart, (inner + values * loose) / np.where(apart, gaps, 1.0), loose / 2)
    return values, vectors / np.linalg.norm(vectors, axis=0)


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of a symmetric matrix."""
    scale = np.linalg.norm(a)
    values, vectors = [], []
    blocks = [((a + a.T) / 2, np.eye(len(a)))] if len(a) else []
    while blocks:
        block, basis = blocks.pop()
        cut = _divide(block, scale) if len(block) > 1 else None
        if cut is None:
            values += np.diag(block).tolist()
            vectors += list(basis.T)
            continue
        turn, rank = cut
        turned = turn.T @ block @ turn
        for part in (slice(None, rank), slice(rank, None)):
            inner = turned[part, part]
            blocks.append(((inner + inner.T) / 2, basis @ turn[:, part]))
    if not len(a):
        return np.zeros(0), np.zeros((0, 0))
    values, vectors = _refined(a, np.array(vectors).T)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _packed(rows: np.ndarray) -> list[bytes]:
    """Whole numbers in as few bytes as the largest of their row needs; equal rows are equal bytes."""
    out = np.empty(len(rows), object)
    largest = np.abs(rows).max(axis=1, initial=0)
    bounds = [(1, 2**7), (2, 2**15), (4, 2**31), (8, 2**63)]
    done = np.zeros(len(rows), bool)
    for width, bound in bounds:
        some = ~done & (largest < bound)
        flat = rows[some].astype(f"<i{width}")
        out[some] = [bytes([width]) + row.tobytes() for row in flat]
        done |= some
    return out.tolist()


def _unpacked(data: list[bytes], length: int) -> np.ndarray:
    out = np.zeros((len(data), length), np.int64)
    widths = np.array([x[0] for x in data], np.int64)
    for width in set(widths.tolist()):
        at = np.flatnonzero(widths == width)
        out[at] = np.frombuffer(b"".join(data[i][1:] for i in at), f"<i{width}").reshape(-1, length)
    return out


def _whole(values: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(values * scale).astype(np.int64)


def _added(distinct: DataFrame, length: int, rows_of) -> np.ndarray:
    """Sum over all distinct vectors of a matrix per batch of them, ``rows_of(whole numbers)``.

    Each task adds up its own; the rows of the tasks' matrices are added in groups, then the groups: what a task of the adding stages
    holds is a fixed part of the tasks' rows of one index."""

    def run(batches):
        total, context = None, TaskContext.get()
        for batch in batches:
            for at in range(0, len(batch), 4096):
                some = rows_of(_unpacked(batch.column("packed").slice(at, 4096).to_pylist(), length))
                total = some if total is None else total + some
        if total is not None:
            task = context.partitionId() if context else 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total)), pa.int32()), pa.array(np.full(len(total), task), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))],
                names=["i", "task", "cells"],
            )

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        ordered = frame.sort_values("task")
        cells = functools.reduce(np.add, [np.asarray(c) for c in ordered.cells])
        return pd.DataFrame({"i": [ordered.i.iloc[0]], "task": [ordered.task.iloc[0]], "cells": [cells]})

    schema = "i int, task int, cells array<double>"
    partial = distinct.mapInArrow(run, schema)
    grouped = partial.groupBy("i", F.pmod("task", F.lit(FEW))).applyInPandas(lambda key, f: fold(f), schema)
    rows = grouped.groupBy("i").applyInPandas(lambda key, f: fold(f), schema).orderBy("i").collect()
    return np.array([r.cells for r in rows], np.float64)


class Whitening:
    """What the fit found: ``n`` distinct vectors, their ``sums`` (Python whole numbers), eigenvalues, eigenvectors, and how far the whitened
    fit list's covariance is from the identity."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, total: float):
        self.n, self.sums, self.total = n, sums, total
        self.near = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)  # the whole number nearest to the mean
        self.rest = np.array([(s - n * int(m)) / n for s, m in zip(sums, self.near, strict=True)], np.float64)
        # a direction without variance cannot be scaled
        self.flat = values <= len(sums) * EPS * max(total, 0.0)
        self.values, self.vectors = values, vectors
        self.identity_error: float | None = None

    def apply(self, whole: np.ndarray) -> np.ndarray:
        """Whitened values, not a number for directions without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scaled = np.where(self.flat, np.nan, 1.0 / np.sqrt(np.where(self.flat, 1.0, self.values)))
        return ((whole - self.near) - self.rest) @ self.vectors * scaled

    def deviation(self, whole: np.ndarray) -> list[int | None]:
        """Per row, the sum of (n * x - sum)^2, exact; None from 10^38 on."""
        rest = [int(s) - self.n * int(m) for s, m in zip(self.sums, self.near, strict=True)]
        away, largest = whole - self.near, max(map(abs, rest), default=0)
        reach = int(np.abs(away).max(initial=0))
        kind = np.int64 if reach * max(reach, largest) * len(rest) < 2**62 else object
        away = away.astype(kind)
        squares, cross = (away * away).sum(axis=1).tolist(), (away * np.array(rest, kind)).sum(axis=1).tolist()
        n, last = self.n, sum(r * r for r in rest)
        sums = (n * n * a - 2 * n * b + last for a, b in zip(squares, cross, strict=True))
        return [x if x < 10**38 else None for x in sums]


def fit(vectors: DataFrame, length: int, most: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> Whitening | None:
    """The whitening of the distinct whole-number vectors; None without any."""

    def pack(batches):
        for batch in batches:
            _, values = matrix(batch, length)
            yield pa.RecordBatch.from_arrays([pa.array(_packed(_whole(values, scale)), pa.binary())], names=["packed"])

    if not length:
        return None
    distinct = store(vectors.select("embedding").mapInArrow(pack, "packed binary").distinct(), "distinct")
    n = distinct.count()
    # sums as doubles would be exact up to 2^53; in two halves they are at any size that can be stored
    halves = _added(distinct, length, lambda x: np.stack([(x >> 20).sum(0), (x & (2**20 - 1)).sum(0)]).astype(np.float64))
    sums = [(int(high) << 20) + int(low) for high, low in zip(*halves.tolist(), strict=True)]
    near = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)

    def products(x: np.ndarray) -> np.ndarray:
        y = (x - near).astype(np.float64)
        return y.T @ y

    rest = np.array([(s - n * int(m)) / n for s, m in zip(sums, near, strict=True)])
    covariance = _added(distinct, length, products) / n - np.outer(rest, rest)
    values, axes = eigenvectors(covariance)
    found = Whitening(n, [s + n * shift for s in sums], values[:most], axes[:, :most], float(np.trace(covariance)))

    def white_products(x: np.ndarray) -> np.ndarray:
        white = found.apply(x + shift)[:, ~found.flat]
        return np.vstack([white.sum(0), white.T @ white])

    if not found.flat.all():
        mean, *second = _added(distinct, length, white_products) / n
        found.identity_error = float(np.abs(np.array(second) - np.outer(mean, mean) - np.eye(len(mean))).max())
    return found


def whiten(vectors: DataFrame, most: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, component (from 1), n, deviation (a decimal, exact), whitened, explained, identity_error for each row and component.

    ``vectors`` has vec_id and embedding (an array of numbers); other columns are left out. Rows whose vector is null or empty, holds null
    or non-finite components, or has another length than most are dropped. Repeated rows and equal vectors all return, and count once in
    the fit; null ids stay. ``whitened`` is null for components without variance (and so ``identity_error``, if there are no others);
    ``explained`` is null if nothing varies. Components beyond 2^40 are an error. No vectors give no rows."""
    vectors = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    length, largest = extent(vectors)
    if largest * scale > LARGEST:
        raise ValueError("components are too large to be whole numbers that can be centred exactly")
    found = fit(vectors, length, most, scale, shift)
    schema = pa.schema(
        [
            ("vec_id", pa.int64()),
            ("component", pa.int32()),
            ("n", pa.int64()),
            ("deviation", pa.decimal128(38, 0)),
            ("whitened", pa.float64()),
            ("explained", pa.float64()),
            ("identity_error", pa.float64()),
        ]
    )

    def run(batches):
        for batch in batches:
            if found is None:
                continue
            places, values = matrix(batch, length)
            for at in range(0, len(places), 2048):
                whole = _whole(values[at : at + 2048], scale) + shift
                yield from rows(batch.column("vec_id").take(pa.array(places[at : at + 2048])), whole)

    def rows(ids: pa.Array, whole: np.ndarray):
        count, size = len(whole), len(found.values)
        again = np.repeat(np.arange(count), size)
        white = found.apply(whole).ravel()
        share = found.values / found.total if found.total > 0 else np.full(size, np.nan)
        columns = [
            ids.take(pa.array(again)),
            pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), count)),
            pa.array(np.full(count * size, found.n)),
            pa.array(found.deviation(whole), pa.decimal128(38, 0)).take(pa.array(again)),
            pa.array(white, mask=np.isnan(white)),
            pa.array(np.tile(share, count), mask=np.isnan(np.tile(share, count))),
            pa.array(list(itertools.repeat(found.identity_error, count * size)), pa.float64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)

    out = "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    return vectors.mapInArrow(run, out)


@query("op12_whitening")
def op12_whitening(spark, sf):
    # a deviation beyond a long is null here, and whole in the operator's decimal
    return whiten(table(spark, sf, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("bigint"))
