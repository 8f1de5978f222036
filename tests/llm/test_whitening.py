"""Whitening against numpy's eigenvectors and exact integers."""

import numpy as np
import pytest

from siltstone.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, deviation string, whitened int"


def plainly(rows, k):
    """ids, exact deviations, whitened, eigenvalues and trace of (id, vector)."""
    x = np.array([[int(np.floor(64 * float(c))) + whitening.OFFSET for c in v] for _, v in rows], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    far = n * x - sums
    c = far.astype(float) / n
    cov = c.T @ c / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return [int(v) for v in (far * far).sum(axis=1)], c @ vectors / np.sqrt(values), values, np.trace(cov)


def held(got, rows, k):
    dev, white, values, trace = plainly(rows, k)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert sorted(by) == sorted(i for i, _ in rows) and len(got) == k * len(rows)
    w = np.array([[by[i][j + 1]["whitened"] for j in range(k)] for i, _ in rows])
    assert np.minimum(abs(w - white), abs(w + white)).max() < 1e-9
    assert all(np.minimum(abs(w[:, j] - white[:, j]).max(), abs(w[:, j] + white[:, j]).max()) < 1e-9 for j in range(k))
    for (i, _), d in zip(rows, dev):
        assert {r["deviation"] for r in by[i].values()} == {d} and {r["n"] for r in by[i].values()} == {len(rows)}
    assert all(abs(by[i][j + 1]["explained"] - values[j] / trace) < 1e-12 for i, _ in rows for j in range(k))
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9


def test_query_against_numpy(spark):
    at = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{at}/embeddings.parquet").collect()]
    held(queries.op12_whitening(spark, at).collect(), rows, 32)


def test_rows_that_are_left_out(spark):
    rng = np.random.default_rng(1)
    good = [(k, [float(np.float32(c)) for c in rng.standard_normal(5) * [5, 3, 2, 1, 0.5]]) for k in range(60)]
    bad = [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0]), (102, [float("nan")] * 5), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (104, []), (105, [1.0, 2.0]), (106, [1e30] * 5)]
    df = spark.createDataFrame([(*r, "x", 1) for r in good + bad], SCHEMA).repartition(4)
    model = whitening.fit(df)
    held(whitening.components(df, model).collect(), good, 5)


def test_repeated_and_null_keys(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], "", 1), (None, [1.0, 0.0], "", 1), (3, [0.0, 2.0], "", 1)], SCHEMA)
    got = whitening.components(df, whitening.fit(df)).collect()
    assert len(got) == 3 and [r["vec_id"] for r in got].count(None) == 2  # two different vectors have one direction


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 0.5])], [(1, [0.5, 0.5])] * 7])
def test_nothing_to_whiten(spark, rows):
    df = spark.createDataFrame([(*r, "", 1) for r in rows], SCHEMA)
    assert whitening.fit(df) is None and whitening.empty(df).collect() == []


def test_large_numbers_stay_exact():
    x = np.array([[2**40, -5], [3, 2**41], [-(2**39), 7]], np.int64)
    sums = x.sum(axis=0)
    far = [[3 * int(a) - int(s) for a, s in zip(row, sums)] for row in x]
    assert whitening.deviations(x, 3, sums) == [v if v < 2**63 else None for v in (sum(a * a for a in row) for row in far)]
    small = np.array([[2, -5], [3, 9]], np.int64)
    assert whitening.deviations(small, 2, small.sum(axis=0)) == [1 + 14**2, 1 + 14**2]


@pytest.mark.parametrize("d,k,gap", [(300, 12, 0.9), (200, 8, 0.98), (40, 32, 0.9)])
def test_lobpcg_over_many_rounds(d, k, gap):
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    values = gap ** np.arange(d)
    a = (q * values) @ q.T
    got, vectors, residuals, _ = whitening.lobpcg(lambda b: a @ b, d, k)
    assert abs(got - values[:k]).max() < 1e-12 and residuals.max() < 1e-12
    assert abs(abs((vectors * q[:, :k]).sum(axis=0)) - 1).max() < 1e-12
