"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Coarse centroids and the codebooks of the residuals are fitted by k-means on a bounded sample (``SAMPLE`` rows, the
least by a hash of the id); every row is indexed. The number of cells is about ``CELLS_PER_ROOT`` times the root of the
number of rows, ``MOST_CELLS`` at most. How many of the nearest cells a query probes is set from the data: the least
share of them that holds ``TARGET`` of the ``AIM`` nearest sample rows of ``TRIALS`` sample rows (rows of the whole
table are nearer than those of a sample, so this errs on the safe side), and more until they hold ``COVER`` rows. In a cell its table of distances from the residual to all codewords ranks the codes
(asymmetric distances); the best ``RERANK`` are compared exactly, in double precision, where the cell's
rows stand, so vectors are shuffled once and only the nearest ``k`` of each cell go on.

A cell of more than ``PART_ROWS`` rows is dealt into parts, and where more than ``PART_QUERIES`` queries probe it, so
are they; each part meets each, so no group grows with the input, whatever vector a third of all rows repeat.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids or
vectors of another dimension than the commonest (of equals the smallest); an id that stands in several rows counts once,
at its nearest; ties go to the smaller id; fewer rows than ``k`` give all of them; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadloom.session import cut

SAMPLE, CELLS_PER_ROOT, MOST_CELLS = 65_536, 1.0, 4096
TARGET, AIM, TRIALS, COVER, RERANK = 0.96, 10, 256, 2_000, 128
SUB, WORDS = 4, 256
PART_ROWS, PART_QUERIES, PAIRS = 4096, 512, 1_000_000


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """At most ``k`` centroids."""
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.permutation(len(x))[: min(k, len(x))])]
    for _ in range(rounds):
        own = nearest(x, centres)
        count = np.bincount(own, minlength=len(centres))
        total = np.stack([np.bincount(own, c, len(centres)) for c in x.T], axis=1)
        lost = count == 0
        centres = (total / np.maximum(count, 1)[:, None]).astype(np.float32)
        if lost.any():
            centres[lost] = x[rng.integers(0, len(x), int(lost.sum()))]
    return centres


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all of ``y``."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(squared(x[a : a + 4096], centres).argmin(axis=1) for a in range(0, len(x), 4096))])


class Index:
    """Coarse centroids and, for each run of ``SUB`` dimensions, the codewords of residuals. Its size is bounded."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.dim = sample.shape[1]
        self.centres = kmeans(sample, cells)
        rest = self.split(sample - self.centres[nearest(sample, self.centres)])
        self.books = [kmeans(rest[:, k], WORDS) for k in range(rest.shape[1])]
        self.share = self.calibrated(sample)

    def calibrated(self, sample: np.ndarray) -> float:
        """The share of the cells that a query has to probe."""
        trial, own = sample[:TRIALS], nearest(sample, self.centres)
        if len(sample) <= AIM or len(self.centres) == 1:
            return 1.0
        rank = squared(trial, self.centres).argsort(axis=1).argsort(axis=1)
        far = squared(trial, sample)
        far[np.arange(len(trial)), np.arange(len(trial))] = np.inf
        near = np.argpartition(far, AIM - 1, axis=1)[:, :AIM]
        at = np.take_along_axis(rank, own[near], axis=1)
        return float((np.quantile(at, TARGET) + 1) / len(self.centres))

    def split(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), -(-self.dim // SUB) * SUB), np.float32)
        out[:, : self.dim] = x
        return out.reshape(len(x), -1, SUB)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell and the codes of each vector."""
        cell = nearest(x, self.centres)
        rest = self.split(x - self.centres[cell])
        return cell, np.stack([nearest(rest[:, k], book) for k, book in enumerate(self.books)], axis=1).astype(np.uint8)

    def probes(self, x: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
        """Cells to look into for each vector, nearest first; ``rows`` has the number of rows of each cell."""
        full = np.flatnonzero(rows)
        share = max(1, int(np.ceil(self.share * len(full))))
        out = []
        for line in squared(x, self.centres[full]):
            order = full[np.argsort(line, kind="stable")]
            held = np.cumsum(rows[order])
            out.append(order[: max(share, int(np.searchsorted(held, COVER)) + 1)])
        return out

    def best(self, queries: np.ndarray, cell: int, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row) of a cell: for each query its ``n`` least asymmetric distances, and all that equal the last."""
        rest = self.split(queries - self.centres[cell])
        far = np.zeros((len(codes), len(queries)), np.float32)
        for k, book in enumerate(self.books):
            far += squared(book, np.ascontiguousarray(rest[:, k]))[codes[:, k]]
        far = np.ascontiguousarray(far.T)
        last = np.partition(far, n - 1, axis=1)[:, n - 1 : n] if far.shape[1] > n else np.inf
        return np.nonzero(far <= last)


def _matrix(column: pa.Array, dim: int, kind=np.float32) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), dim)


def valid(table: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``vec_id, vector`` of the rows that take part, but for their dimension."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("vector")).where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def fit(rows: DataFrame) -> tuple[Index, DataFrame] | None:
    """The index for valid rows and the rows of its dimension; None if there are none."""
    dims = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if dims is None:
        return None
    rows = rows.where(F.size("vector") == dims["d"])
    cells = int(np.clip(round(CELLS_PER_ROOT * dims["n"] ** 0.5), 1, MOST_CELLS))
    least = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < int(min(1.0, 1.2 * SAMPLE / dims["n"]) * (1 << 40)))  # about 1.2 * SAMPLE rows, of which SAMPLE stay
    sample = least.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow()
    return Index(_matrix(sample.column(0), dims["d"]), cells), rows


def nearest_of(query: np.ndarray, found: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest of each query's candidates, each id once and never its own; of equals the smaller ids."""
    order = np.lexsort((score, found, query))
    query, found, score = query[order], found[order], score[order]
    fresh = np.ones(len(query), bool)
    fresh[1:] = (query[1:] != query[:-1]) | (found[1:] != found[:-1])
    fresh &= query != found
    query, found, score = query[fresh], found[fresh], score[fresh]
    order = np.lexsort((found, score, query))
    query, found, score = query[order], found[order], score[order]
    begin = np.searchsorted(query, query)
    some = np.arange(len(query)) - begin < k
    return query[some], found[some], score[some]


def search(table: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest rows of ``table`` found for each row of ``queries``."""
    spark = table.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fitted = fit(valid(table, vec_id, vector))
    if fitted is None:
        return empty
    index, rows = fitted
    sent, dim = spark.sparkContext.broadcast(index), index.dim

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, codes = sent.value.encode(_matrix(batch.column(1), dim))
            yield pa.record_batch([*batch.columns, pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "vector", "cell", "codes"])

    kind = rows.schema["vector"].dataType.simpleString()
    coded = cut(rows.mapInArrow(encode, f"vec_id long, vector {kind}, cell int, codes binary"))
    count = np.zeros(len(index.centres), np.int64)
    for r in coded.groupBy("cell").count().collect():  # a row for each cell
        count[r["cell"]] = r["count"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                some = batch.slice(a, 256)
                cells = sent.value.probes(_matrix(some.column(1), dim), count)
                yield pa.record_batch([*some.columns, pa.array([c.astype(np.int32) for c in cells], pa.list_(pa.int32()))], ["query_id", "query", "cells"])

    asked = valid(queries, vec_id, vector).where(F.size("vector") == dim)
    asked = cut(asked.mapInArrow(probe, f"query_id long, query {kind}, cells array<int>")).select("query_id", "query", F.explode("cells").alias("cell"))
    asks = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}
    parts = spark.createDataFrame([(c, -(-int(count[c]) // PART_ROWS), -(-n // PART_QUERIES)) for c, n in asks.items()], "cell int, parts int, turns int")
    parts = F.broadcast(parts)  # a row for each cell
    deal = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = coded.join(parts, "cell").withColumn("part", deal("vec_id", "parts")).withColumn("turn", every("turns")).select("cell", "part", "turn", "vec_id", "vector", "codes")
    right = asked.join(parts, "cell").withColumn("turn", deal("query_id", "turns")).withColumn("part", every("parts")).select("cell", "part", "turn", "query_id", "query")

    def meet(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if rows.num_rows and queries.num_rows:
            ids, vectors = rows.column("vec_id").to_numpy(), _matrix(rows.column("vector"), dim, np.float64)
            codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
            cell, asking = queries.column("cell")[0].as_py(), queries.column("query_id").to_numpy()
            wanted = _matrix(queries.column("query"), dim, np.float64)
            step = max(1, PAIRS // len(ids))
            for a in range(0, len(asking), step):
                q, r = sent.value.best(wanted[a : a + step].astype(np.float32), cell, codes, RERANK)
                q, near = asking[q + a], [q + a, r]
                score = np.sqrt(np.add.accumulate((vectors[near[1]] - wanted[near[0]]) ** 2, axis=1)[:, -1])  # one component after another
                for column, value in zip(out, nearest_of(q, ids[r], score, k)):
                    column.append(value)
        joined = [np.concatenate([np.zeros(0, t), *x]) for t, x in zip((np.int64, np.int64, np.float64), out)]
        return pa.table(joined, ["query_id", "vec_id", "score"])

    keys = ["cell", "part", "turn"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
