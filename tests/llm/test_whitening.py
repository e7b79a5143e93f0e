import numpy as np
import pytest
from corpus_tables import CLASHING, SF
from pyspark.sql import functions as F

from roadloom.llm import whitening


def exact(vectors):
    """Whole entries, falling eigenvalues and eigenvectors by a dense decomposition."""
    x = np.floor(1024 * np.asarray(vectors, float)) + 100_000
    value, vector = np.linalg.eigh(np.cov(x.T, bias=True).reshape(x.shape[1], x.shape[1]))
    return x, value[::-1], vector[:, ::-1]


def check(found, ids, vectors, k=8):
    x, value, vector = exact(vectors)
    n, s = len(x), [int(v) for v in x.sum(axis=0)]
    assert len(found) == n * k and {r["n"] for r in found} == {n}
    held = np.full((n, k), np.nan)
    at = {i: j for j, i in enumerate(ids)}
    for r in found:
        held[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert abs(r["explained"] / (value[r["component"] - 1] / value.sum()) - 1) < 1e-9 and r["identity_error"] < 1e-9
    far = {r["vec_id"]: r["deviation"] for r in found}
    assert all(far[i] == sum((n * int(a) - b) ** 2 for a, b in zip(row, s)) for i, row in zip(ids, x))
    want = (x - x.mean(axis=0)) @ vector[:, :k] / np.sqrt(value[:k])
    for a, b in zip(held.T, want.T):
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
    assert np.abs(np.cov(held.T, bias=True) - np.eye(k)).max() < 1e-9


def vectors(spark, rows, kind="double"):
    held = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
    return held.withColumns({c: F.lit(7) for c in CLASHING})


def test_equals_a_dense_decomposition(shipped):
    rows = shipped.read.parquet(f"{SF}/embeddings.parquet")
    held = rows.orderBy("vec_id").collect()
    check(whitening.whiten(rows).collect(), [r["vec_id"] for r in held], [r["embedding"] for r in held])


def test_more_dimensions_than_rows_between(shipped):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 90)) * np.linspace(3, 0.1, 90)
    check(whitening.whiten(vectors(shipped, [(k, v.tolist()) for k, v in enumerate(x)])).collect(), range(300), x)


def test_rows_that_take_no_part(shipped):
    rng = np.random.default_rng(2)
    good = [(k, v.tolist()) for k, v in enumerate(rng.standard_normal((40, 12)))]
    bad = [(100, None), (101, []), (102, [1.0] * 11 + [None]), (103, [float("nan")] * 12), (104, [float("inf")] + [0.0] * 11), (105, [1.0] * 5), (106, [1e300] + [0.0] * 11)]
    check(whitening.whiten(vectors(shipped, good + bad)).collect(), range(40), [v for _, v in good])


def test_null_ids_zero_vectors_and_repeated_rows(shipped):
    rng = np.random.default_rng(3)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.standard_normal((30, 4)))] + [(None, [0.0] * 4), (5, [1.0, 2.0, 3.0, 4.0]), (5, [1.0, 2.0, 3.0, 4.0])]
    found = whitening.whiten(vectors(shipped, rows)).collect()
    assert len(found) == 33 * 4 and {r["n"] for r in found} == {33}
    assert sum(r["vec_id"] is None for r in found) == 4 and sum(r["vec_id"] == 5 for r in found) == 12
    held = np.array([[r["whitened"] for r in found if r["component"] == k] for k in range(1, 5)])
    assert np.abs(np.cov(held, bias=True) - np.eye(4)).max() < 1e-9


def test_little_or_no_variance(shipped):
    assert whitening.whiten(vectors(shipped, [(k, [1.0, 2.0]) for k in range(9)])).collect() == []
    assert whitening.whiten(vectors(shipped, [(1, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(vectors(shipped, [(1, [1.0])]).where("false")).collect() == []
    line = whitening.whiten(vectors(shipped, [(k, [float(k), 2.0 * k, 0.0]) for k in range(20)])).collect()
    assert {r["component"] for r in line} == {1} and all(abs(r["explained"] - 1) < 1e-9 for r in line)


def test_whole_table_as_one_vector_but_one(shipped):
    rows = [(k, [1.0, 0.0, 0.0]) for k in range(500)] + [(500, [0.0, 1.0, 0.0])]
    found = whitening.whiten(vectors(shipped, rows)).collect()
    assert {r["component"] for r in found} == {1} and len(found) == 501


def test_deviations_beyond_a_long_are_null(shipped):
    x = np.array([[2**40, 0], [-(2**40), 0], [0, 1]])
    assert whitening.deviations(x, x.sum(axis=0), 3)[0] == (3 * 2**40) ** 2 + 1
    found = whitening.whiten(vectors(shipped, [(k, [float(2**41 * (k % 2)), float(k)]) for k in range(50)])).collect()
    assert all(r["deviation"] is None for r in found)


@pytest.mark.parametrize("most", [512, 40])
def test_lanczos_with_restarts_and_breakdown(most):
    rng = np.random.default_rng(4)
    for rank, d in ((200, 200), (5, 120), (60, 60)):
        a = rng.standard_normal((d, rank)) * np.linspace(5, 0.5, rank)
        v = a @ a.T / rank
        value, vector = whitening.leading(lambda x: v @ x, d, 8, most=most)
        want = np.linalg.eigvalsh(v)[::-1][:8]
        assert np.abs(value - want).max() < 1e-11 * want[0]
        assert np.abs(vector.T @ vector - np.eye(8)).max() < 1e-9
        assert np.abs(v @ vector - vector * value).max() < 1e-9 * want[0]
