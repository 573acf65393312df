"""Principal components and whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

Rows become integers (a grid of 1/``GRID``), so sums, the fit list of distinct vectors and the squared
deviation are exact. The fit list is written once as blocks of centred rows; its mean is taken off exactly,
as ``(n*x - S) / n``. With X these rows, the iteration alternates distributed products:

    alpha_j u_j = X v_j - beta_(j-1) u_(j-1),   beta_j v_(j+1) = X'u_j - alpha_j v_j,

each time made orthogonal to all vectors before. A u has one entry per row and is never gathered or stored:
it lies in the range of X, so it is kept as y with u = X y, a vector as long as a row. One pass over the
blocks forms X y row by row and adds up X'(X y); inner products with all earlier u follow from it, since
X'u_i is known. The passes are as many as the vectors have entries (bounded, and also the most rows of the
bidiagonal matrix): only a whole basis shows equal eigenvalues as often as they occur. Where a direction
is exhausted, the iteration starts again from a new one. The singular values and vectors of the small
bidiagonal matrix give the components and deviations, and the sum of its squares is the whole variance. A
last pass measures the covariance of the whitened rows.

Rows whose vector is null, empty or has null or non-finite entries are dropped, and so are vectors of
another length than the most frequent (of several, the longest). Repeated vectors count once in the fit;
every row gets its values. Components without variance have no whitened value and are left out: equal
vectors, or a single one, give no rows, as does an empty table. A component's sign is that which makes its
largest entry positive (ties: the first). Null ids and other columns: ids are carried, columns ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servescope.session import cut

GRID = 64
SHIFT = 1_000_000
BLOCK_ROWS = 2048
#: A direction is exhausted below this share of the largest singular value seen.
EXHAUSTED = 1e-12
#: A component has no variance below this share of the largest singular value.
NOTHING = 1e-9


@dataclass
class Whitening:
    """What the fit found: ``n`` rows with sums ``total``, components (columns) with their variances."""

    n: int
    total: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float


def on_grid(vectors: DataFrame, grid: int = GRID, shift: int = SHIFT) -> DataFrame:
    """``vec_id, x``: rows of ``vectors(vec_id, embedding)`` as whole numbers."""
    entry = "CAST(c AS DOUBLE)"
    bad = f"c IS NULL OR isnan({entry}) OR abs({entry}) = double('infinity')"
    rows = vectors.select("vec_id", "embedding").where(f"size(embedding) > 0 AND NOT exists(embedding, c -> {bad})").selectExpr(
        "vec_id", f"transform(embedding, c -> CAST(floor({grid} * {entry}) AS BIGINT) + {shift}L) AS x")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (lengths[0] if lengths else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1)


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and sums per entry, as Python integers."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column("x"))
                # added up in two halves, so that no sum leaves 64 bits
                high, low = (m >> 32).sum(axis=0), (m & 0xFFFFFFFF).sum(axis=0)
                part = [int(a) * 2**32 + int(b) for a, b in zip(high, low)]
                total = part if total is None else [a + b for a, b in zip(total, part)]
                n += batch.num_rows
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[str(t) for t in total]], pa.list_(pa.string()))], names=["n", "total"])

    parts = rows.select("x").mapInArrow(add, "n long, total array<string>").collect()  # one row for each task
    return sum(p.n for p in parts), [sum(int(t) for t in c) for c in zip(*[p.total for p in parts])]


def _centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """``x - total / n`` with one rounding: the whole part of the mean goes first, exactly."""
    whole = np.array([t // n for t in total], np.int64)
    rest = np.array([(t % n) / n for t in total])
    return (x - whole).astype(np.float64) - rest


def _blocks(rows: DataFrame, n: int, total: list[int]) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _centred(_matrix(batch.column("x")), n, total)
                cuts = [x[i : i + BLOCK_ROWS].tobytes() for i in range(0, len(x), BLOCK_ROWS)]
                yield pa.RecordBatch.from_arrays([pa.array(cuts, pa.binary())], names=["rows"])

    return cut(rows.select("x").mapInArrow(pack, "rows binary"))


def _product(blocks: DataFrame, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """X'(X y) and the squared lengths of X y, for one vector or the columns of a matrix; one small row a
    task comes to the driver."""
    d, shape = len(y), y.shape

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, squares = np.zeros(shape), np.zeros(shape[1:])
        for batch in batches:
            for block in batch.column("rows"):
                x = np.frombuffer(block.as_buffer()).reshape(-1, d)
                u = x @ y
                out += x.T @ u
                squares += (u * u).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()]), pa.array([squares.tobytes()])], names=["product", "squares"])

    parts = blocks.mapInArrow(multiply, "product binary, squares binary").collect()
    return (np.sum([np.frombuffer(p["product"]).reshape(shape) for p in parts], axis=0),
            np.sum([np.frombuffer(p["squares"]).reshape(shape[1:]) for p in parts], axis=0))


def _orthogonal(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for b in basis:
            v = v - (b @ v) * b
    return v


def bidiagonal(blocks: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    """``V, B``: an orthonormal basis of the rows' space and the upper bidiagonal matrix of X in it."""
    draw = np.random.default_rng(13)
    vs: list[np.ndarray] = []
    us: list[tuple[np.ndarray, np.ndarray]] = []  # y and X'u of each u = X y
    alphas, betas = np.zeros(d), np.zeros(d)
    v, beta, largest = None, 0.0, 0.0
    while len(vs) < d:
        j = len(vs)
        if v is None:  # the start, or what is left after an exhausted direction
            v, beta = _orthogonal(draw.standard_normal(d), vs), 0.0
            v = v / np.linalg.norm(v)
        y = v - beta * us[-1][0] if beta else v
        z, square = _product(blocks, y)
        vs.append(v)
        betas[j] = beta
        changed = 0.0
        for yi, zi in us * 2:  # u against all before, twice
            c = yi @ z
            y, z, changed = y - c * yi, z - c * zi, max(changed, abs(c))
        if changed > 1e-9 * math.sqrt(square):
            z, square = _product(blocks, y)
        alpha = math.sqrt(square)
        if alpha <= EXHAUSTED * largest or alpha == 0.0:
            v = None
            continue
        largest = max(largest, alpha)
        alphas[j] = alpha
        us.append((y / alpha, z / alpha))
        v = _orthogonal(z / alpha - alpha * v, vs)
        beta = float(np.linalg.norm(v))
        largest = max(largest, beta)
        v = v / beta if beta > EXHAUSTED * largest else None
    return np.array(vs).reshape(-1, d).T, np.diag(alphas) + np.diag(betas[1:], 1)


def fit(rows: DataFrame, components: int = 16) -> Whitening | None:
    """The components of the distinct vectors of ``rows(x)``, at most ``components``; None without rows."""
    distinct = cut(rows.select("x").distinct())
    n, total = _sums(distinct)
    if not n:
        return None
    blocks = _blocks(distinct, n, total)
    basis, matrix = bidiagonal(blocks, len(total))
    _, singular, right = np.linalg.svd(matrix)
    variances = singular**2 / n
    trace = float((matrix**2).sum() / n)
    keep = (singular > NOTHING * max(singular[0], 1.0)) & (np.arange(len(singular)) < components)
    found, variances = (basis @ right.T)[:, keep], variances[keep]
    found = found / np.linalg.norm(found, axis=0)
    top = np.abs(found) >= np.abs(found).max(axis=0, initial=0) * (1 - 1e-9)
    found = found * np.sign(found[np.argmax(top, axis=0), np.arange(found.shape[1])])
    error = 0.0
    if len(variances):
        scaled = found / np.sqrt(variances)
        error = float(np.abs(scaled.T @ _product(blocks, scaled)[0] / n - np.eye(len(variances))).max())
    return Whitening(n, total, found, variances, trace, error)


def whiten(vectors: DataFrame, components: int = 16) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` per row and component;
    ``deviation`` is a decimal: the sum over entries of ``(n*x - S)^2``."""
    rows = cut(on_grid(vectors))
    model = fit(rows, components)
    schema = "vec_id long, component int, n long, deviation decimal(38, 0), whitened double, explained double, identity_error double"
    if model is None or not len(model.variances):
        return vectors.sparkSession.createDataFrame([], schema)
    n, total = model.n, model.total
    scaled = model.components / np.sqrt(model.variances)
    k = scaled.shape[1]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.array(total, dtype=object)

        def deviation(x: np.ndarray) -> np.ndarray:
            if n * int(np.abs(x).max()) < 2**62:  # else, and for large squares, Python's integers
                t = x * n - sums.astype(np.int64)
                if int(np.abs(t).max()) ** 2 * t.shape[1] < 2**63:
                    return (t * t).sum(axis=1)
            return ((x.astype(object) * n - sums) ** 2).sum(axis=1)

        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(low, BLOCK_ROWS)
                x = _matrix(part.column("x"))
                white = _centred(x, n, total) @ scaled
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id").cast(pa.int64()), pa.array([Decimal(int(v)) for v in deviation(x)], pa.decimal128(38, 0)),
                     pa.FixedSizeListArray.from_arrays(pa.array(white.ravel()), k).cast(pa.list_(pa.float64()))],
                    names=["vec_id", "deviation", "white"])

    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.variances])
    return rows.mapInArrow(project, "vec_id long, deviation decimal(38, 0), white array<double>").select(
        "vec_id", "deviation", F.posexplode("white").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
