"""Whitening of vectors by the leading components of their covariance, without ever forming it.

Block Lanczos: each step multiplies the covariance by a block of orthonormal directions, which is one pass of Spark
over the vectors (centred in the task, a ``dimensions x BLOCK`` sum for each task, added up by dimension before it reaches the driver). The
driver holds the basis only (dimensions x directions; its size doesn't depend on the number of rows): new directions are orthogonalised twice
against the whole basis, a direction that vanishes is replaced by a random one (breakdown), and the
basis is cut back to its best Ritz vectors when it reaches ``MOST`` directions. It ends when the residuals of all wanted pairs are
under ``TOLERANCE`` of the largest eigenvalue, or the basis spans the whole space.

Entries are whole numbers, ``floor(1024 c) + 100000``, so sums and deviations are exact.

Defined cases: rows with a null vector, null or non-finite entries, entries over 2^42, no entries, or another number of them than the
commonest (of equals the smallest) take no part; a null id is kept; repeated rows are rows of their own; zero vectors are vectors like others; fewer
dimensions or fewer directions with variance than ``components`` give as many components as there are (equal vectors: none, so no
rows); equal eigenvalues come in any order, with any basis of their space; a deviation beyond a long is null; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.session import cut

COMPONENTS, BLOCK, MOST, TOLERANCE, PASSES = 8, 8, 512, 1e-13, 400
LARGEST = float(1 << 42)
#: Eigenvalues under this share of the trace are no variance but rounding.
NOTHING = 1e-14
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def valid(table: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``vec_id, vector`` of the rows that take part, but for their dimension."""
    v = F.col(vector)
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST))
    return table.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("vector")).where(v.isNotNull() & (F.size(v) > 0) & usable)


def whole(column: pa.Array, dim: int) -> np.ndarray:
    """The whole-number entries of a column of vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    c = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)
    return np.floor(1024 * c).astype(np.int64) + 100_000


def deviations(x: np.ndarray, sums: np.ndarray, n: int) -> list[int]:
    """The sum over dimensions of ``(n x - S)^2`` of each row, exactly."""
    if n * max(int(np.abs(x).max(initial=0)), 1) < 1 << 62:
        off = n * x - sums
        if int(np.abs(off).max(initial=0)) ** 2 * x.shape[1] < 1 << 63:
            return (off * off).sum(axis=1).tolist()
    return [sum((n * a - s) ** 2 for a, s in zip(row, sums.tolist())) for row in x.tolist()]


def _summed(rows: DataFrame, dim: int, part: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum over all vectors of a matrix that ``part`` gives for some of them; each line is added up on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                some = part(whole(batch.column(0).slice(a, 4096), dim))
                held = some if held is None else held + some
        if held is not None:
            yield pa.record_batch([pa.array(np.arange(len(held), dtype=np.int32)), pa.array(list(held))], ["line", "held"])

    lines = rows.select("vector").mapInArrow(run, f"line int, held array<{kind}>")
    wide = lines.select("line", F.posexplode("held").alias("at", "held")).groupBy("line", "at").agg(F.sum("held").alias("held")).groupBy("line").agg(F.sort_array(F.collect_list(F.struct("at", "held")))["held"].alias("held"))
    return np.array([r["held"] for r in wide.orderBy("line").collect()])  # a row for each dimension, as wide as a block


def orthonormal(fresh: np.ndarray, basis: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Orthonormal columns that are orthogonal to ``basis``, from those of ``fresh``; random ones where those have nothing new."""
    out = basis
    for column in fresh.T:
        size = np.linalg.norm(column)
        for _ in range(8):
            v = column.copy()
            for _ in range(2):
                v -= out @ (out.T @ v)
            left = np.linalg.norm(v)
            if size and left > 1e-10 * size:
                v /= left
                v -= out @ (out.T @ v)
                out = np.column_stack([out, v / np.linalg.norm(v)])
                break
            column = rng.standard_normal(len(column))
            size = np.linalg.norm(column)
        if out.shape[1] == len(column):
            break
    return out[:, basis.shape[1] :]


def leading(product: Callable[[np.ndarray], np.ndarray], dim: int, k: int, block: int = BLOCK, most: int = MOST, tolerance: float = TOLERANCE, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and unit eigenvectors (columns) of the symmetric matrix that ``product`` multiplies by."""
    k, block = min(k, dim), min(block, dim)
    most = min(dim, max(most, 3 * k + 2 * block))
    rng = np.random.default_rng(seed)
    basis, image = np.zeros((dim, 0)), np.zeros((dim, 0))
    fresh = orthonormal(rng.standard_normal((dim, block)), basis, rng)
    for _ in range(PASSES):
        basis, image = np.column_stack([basis, fresh]), np.column_stack([image, product(fresh)])
        small = basis.T @ image
        value, turn = np.linalg.eigh((small + small.T) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        wanted = turn[:, :k]
        rest = image @ wanted - (basis @ wanted) * value[: wanted.shape[1]]
        size = np.linalg.norm(rest, axis=0)
        if basis.shape[1] == dim or basis.shape[1] >= k and (size <= tolerance * max(value[0], 0)).all():
            vectors = basis @ wanted
            return value[:k], vectors / np.linalg.norm(vectors, axis=0)
        if basis.shape[1] + block > most and most < dim:  # go on from the best directions so far
            best = turn[:, : 2 * k + block]
            basis, image = np.linalg.qr(basis @ best)[0], None
            image = product(basis)
            fresh = rest[:, np.argsort(-size, kind="stable")]
        else:
            fresh = image[:, -fresh.shape[1] :]
        fresh = orthonormal(fresh[:, : min(block, dim - basis.shape[1])], basis, rng)
    raise RuntimeError(f"components did not settle in {PASSES} passes")


def whiten(table: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    spark = table.sparkSession
    rows = valid(table, vec_id, vector)
    dims = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if dims is None:
        return spark.createDataFrame([], SCHEMA)
    dim, n = dims["d"], dims["n"]
    rows = cut(rows.where(F.size("vector") == dim))
    sums = _summed(rows, dim, lambda x: x.sum(axis=0)[:, None], "bigint")[:, 0].astype(np.int64)
    mean = sums / n

    def product(v: np.ndarray) -> np.ndarray:
        return _summed(rows, dim, lambda x: (x - mean).T @ ((x - mean) @ v)) / n

    value, direction = leading(product, dim, components)
    total = _summed(rows, dim, lambda x: np.array([[float(sum(deviations(x, sums, n)))]]))[0, 0] / n**3
    kept = value > NOTHING * total
    value, k = value[kept], int(kept.sum())
    if k == 0:
        return spark.createDataFrame([], SCHEMA)
    turn = direction[:, kept] / np.sqrt(value)

    def moments(x: np.ndarray) -> np.ndarray:
        z = np.column_stack([(x - mean) @ turn, np.ones(len(x))])
        return z.T @ z

    held = _summed(rows, dim, moments) / n
    spread = held[:k, :k] - np.outer(held[:k, k], held[:k, k])
    error = float(np.abs(spread - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                some = batch.slice(a, 4096)
                x = whole(some.column(1), dim)
                m = len(x)
                far = pa.array([f if f < 1 << 63 else None for f in deviations(x, sums, n)], pa.int64())
                each = pa.array(np.repeat(np.arange(m), k))
                columns = [some.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), far.take(each), pa.array(((x - mean) @ turn).ravel()), pa.array(np.tile(value / total, m)), pa.array(np.full(m * k, error))]
                yield pa.record_batch(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, SCHEMA)
