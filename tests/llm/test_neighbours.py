import math

import duckdb
import numpy as np
from corpus_tables import SF
from pyspark.sql import functions as F

from roadloom.llm import neighbours, queries

SF_LARGER = SF.replace("0.001", "0.01")


def brute(rows, k=10):
    """Exact nearest rows of those whose id is divisible by 100."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    out = {}
    for q in np.flatnonzero(ids % 100 == 0):
        far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        far[ids == ids[q]] = np.inf
        order = np.lexsort((ids, far))[:k]
        out[int(ids[q])] = [(int(ids[o]), float(far[o])) for o in order if far[o] < np.inf]
    return out


def asked(rows):
    return rows.where(F.col("vec_id") % 100 == 0)


def test_recall_and_exact_scores(shipped):
    rows = shipped.read.parquet(f"{SF_LARGER}/embeddings.parquet")
    want = brute([(r["vec_id"], r["embedding"]) for r in rows.collect()])
    exact = {(q, v): d for q, held in want.items() for v, d in held}
    got = neighbours.search(rows, asked(rows)).collect()
    assert len(got) == 10 * len(want)
    hits = [(r["query_id"], r["vec_id"]) in exact for r in got]
    assert np.mean(hits) >= 0.9
    for r in got:
        if (r["query_id"], r["vec_id"]) in exact:
            assert math.isclose(r["score"], exact[r["query_id"], r["vec_id"]], rel_tol=1e-12)


def test_ties_and_a_common_vector(shipped, monkeypatch):
    monkeypatch.setattr(neighbours, "PART_ROWS", 50)
    monkeypatch.setattr(neighbours, "PART_QUERIES", 2)
    rng = np.random.default_rng(0)
    rows = [(k, [1.0, 2.0, 3.0] if k % 3 == 0 else [float(v) for v in rng.standard_normal(3)]) for k in range(900)]
    table = shipped.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = {}
    for r in neighbours.search(table, asked(table)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in (0, 300, 600):  # copies of the common vector: the smallest other ids at distance 0
        want = [k for k in range(0, 40, 3) if k != q][:10]
        assert [v for _, v, _ in sorted(got[q])] == want and all(s == 0 for _, _, s in got[q])


def test_edges(shipped):
    rows = [(0, [1.0, 0.0]), (100, [0.0, 2.0]), (3, None), (4, []), (5, [0.0, 0.0]), (200, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0]), (9, [1.0, 1.0]), (9, [1.0, 1.0]), (None, [1.0, 0.0]), (10, [1.0, 2.0, 3.0])]
    table = shipped.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("rank", F.lit(2))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.search(table, asked(table)).collect())
    assert got == [(0, 1, 9, 1.0), (0, 2, 100, math.sqrt(5)), (100, 1, 9, math.sqrt(2)), (100, 2, 0, math.sqrt(5))]
    assert neighbours.search(table.where("false"), table.where("false")).collect() == []
    assert neighbours.search(table, table.where("false")).collect() == []


def test_recall_where_most_cells_are_left_out(shipped, monkeypatch):
    """Clustered vectors, probes set from the sample alone: under half the cells are probed and nine in ten neighbours found."""
    monkeypatch.setattr(neighbours, "COVER", 1)
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((60, 16)) * 3
    vectors = (centres[rng.integers(0, 60, 6000)] + rng.standard_normal((6000, 16))).astype(np.float32)
    rows = shipped.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    index, _ = neighbours.fit(neighbours.valid(rows, "vec_id", "embedding"))
    count = np.bincount(index.encode(vectors)[0], minlength=len(index.centres))
    probed = [len(c) for c in index.probes(vectors[::100], count)]
    assert max(probed) < 0.5 * (count > 0).sum()
    got = {}
    for r in neighbours.search(rows, rows.where("vec_id % 100 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    found = 0
    for q in range(0, 6000, 100):
        far = ((vectors.astype(np.float64) - vectors[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        found += len(got[q] & set(np.argsort(far, kind="stable")[:10].tolist()))
    assert found >= 0.9 * 600


def test_equals_sql(shipped):
    folder = SF.replace("0.001", "0.01")
    rows = queries.op6_neighbours(shipped, folder).select("query_id", "rank", "vec_id", "score").collect()
    with duckdb.connect() as engine:
        engine.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
        held = engine.execute(queries.SQL["op6_neighbours"])
        names = [d[0] for d in held.description]
        want = sorted(tuple(r[names.index(c)] for c in ("query_id", "rank", "vec_id", "score")) for r in held.fetchall())
    assert sorted(map(tuple, rows)) == want
