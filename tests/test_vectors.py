"""Similarity join by pivots against every pair, greedy dropping, and what is sent."""

import numpy as np
import pytest

from siltstone.operators import vectors
from siltstone.operators.stage import written


def clustered(n=1500, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((60, 16))[rng.integers(0, 60, n)] + 0.1 * rng.standard_normal((n, 16))
    x[: n // 3] = x[0]  # a third of all rows are copies
    x[n // 3 : n // 3 + 40] += 0.01 * rng.standard_normal((40, 16))
    x[7] = 0
    return x


def unit(x):
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def frame(spark, x, first=0):
    rows = [(first + k, v.tolist()) for k, v in enumerate(x)]
    return spark.createDataFrame([*rows, (10**6 + first, None), (10**6 + first + 1, [])], "pos long, vector array<double>").repartition(4)


@pytest.mark.parametrize("threshold", [0.999, 0.9, 0.3])
@pytest.mark.parametrize("rows,pivots", [(64, 200), (2048, 10), (300, 1)])
def test_pairs_against_every_pair(spark, threshold, rows, pivots):
    x = clustered(450)
    s = unit(x) @ unit(x).T
    want = {(int(b), int(a)) for a, b in np.argwhere(np.triu(s >= threshold, 1))}
    got = vectors.similar_pairs(frame(spark, x), threshold, rows=rows, pivots=pivots).collect()
    assert len(got) == len(want) and {(r[0], r[1]) for r in got} == want
    assert all(abs(r[2] - s[r[0], r[1]]) < 1e-9 for r in got)


def test_cells_apart_never_meet(spark):
    """Rows sent on clustered vectors stay below rows times blocks, and no block holds much more than it may."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((80, 32))[rng.integers(0, 80, 4000)] + 0.02 * rng.standard_normal((4000, 32))
    x[:1300] = x[0]
    cells = vectors._Cells(written(vectors._units(frame(spark, x), "pos", "vector")), 0.98, 100, 500)
    sent = cells.dealt(cells.home, True)
    assert sent.filter("side = 1").count() < 0.1 * 4000 * 40 and sent.count() < 0.3 * 4000 * 40
    sizes = [r["count"] for r in sent.groupBy("cell", "i", "j", "side").count().collect()]
    assert max(sizes) < 250


def test_cells_that_spare_nothing_are_one(spark):
    """At a low threshold every row would visit most cells: rows are sent once for each block, in batches of bounded size."""
    x = np.random.default_rng(4).standard_normal((4000, 32))
    cells = vectors._Cells(written(vectors._units(frame(spark, x), "pos", "vector")), 0.2, 500, 500)
    for below, most in ((True, 4000 * 8), (False, 2 * 4000 * 8)):
        sent = cells.dealt(cells.home, below)
        assert sent.count() == most and sent.select("cell").distinct().count() == 1
    wide = sent.mapInArrow(lambda batches: (b.select(["pos"]).slice(0, 1) for b in batches if b.num_rows > vectors.SENT), "pos long")
    assert not wide.count()


def test_against_index(spark):
    x, y = clustered(200, 2), clustered(300, 2)
    s = unit(x) @ unit(y).T
    for threshold in (0.95, 0.5):
        got = {r["pos"]: r["best"] for r in vectors.against_index(frame(spark, x), frame(spark, y, 5000), threshold, rows=50, pivots=40).collect()}
        want = {k: v for k, v in enumerate(s.max(axis=1)) if v >= threshold}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_vectors(spark, n):
    df = spark.createDataFrame([(k, [1.0, 0.5]) for k in range(n)], "pos long, vector array<double>")
    assert [(r[0], r[1]) for r in vectors.similar_pairs(df, 0.9).collect()] == [(1, 0)][: n - 1 if n else 0]
    assert vectors.against_index(df, df, 0.9).count() == n


@pytest.mark.parametrize("links", [10**6, 3])
def test_greedy_pass_and_what_it_skips(spark, links):
    rng = np.random.default_rng(3)
    n = 60
    pairs = {(int(max(a, b)), int(min(a, b))): float(rng.uniform(0.9, 1)) for a, b in rng.integers(0, n, (70, 2)) if a != b}
    pairs |= {(k + 1, k): 0.95 for k in range(40, 59)}  # a chain
    kept: list[int] = []
    for k in range(n):
        if not any((k, j) in pairs for j in kept):
            kept.append(k)
    df = spark.createDataFrame([(k,) for k in range(n)], "pos long")
    found = spark.createDataFrame([(a, b, s) for (a, b), s in pairs.items()], "later long, earlier long, score double")
    got = vectors.greedy_drop(df, found, links=links)
    assert sorted(r["pos"] for r in got.collect()) == kept
    best = {k: max((pairs[k, j], -j) for j in kept if (k, j) in pairs) for k in range(n) if k not in kept}
    assert {r["pos"]: (round(r["score"], 9), r["match"]) for r in vectors.skipped(found, got).collect()} == {k: (round(s, 9), -j) for k, (s, j) in best.items()}


def test_scores_of_the_report_are_not_rounded(spark):
    pairs = spark.createDataFrame([(2, 0, 0.40619049999), (2, 1, 0.40619049998)], "later long, earlier long, score double")
    assert [tuple(r) for r in vectors.duplicate_report(pairs).collect()] == [(2, 0.40619049999, 0)]
