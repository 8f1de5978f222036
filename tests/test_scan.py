"""Prefix scans and order statistics over groups of any size against windows and sorted lists."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.operators import chunking, scan, vectors
from siltstone.operators.order import selected


@pytest.fixture
def spread(spark):
    """No coalescing of partitions, and more of them, as over a large table."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "9"}
    kept = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in kept.items():
        spark.conf.set(n, v)


def rows(spark):
    rng = random.Random(3)
    out = [("hot", k, rng.choice([None, None, f"v{k}"]), 1.5) for k in range(300)]
    out += [(rng.choice(["a", "b", None]), k, rng.choice([None, f"w{k}"]), 0.5) for k in range(300, 360)]
    return spark.createDataFrame(out, "g string, k long, v string, other double").repartition(5)


def test_scan_against_windows(spark, spread):
    df = rows(spark)
    line = Window.partitionBy("g").orderBy("k")
    want = df.withColumns({"_n": F.row_number().over(line).cast("long"), "_c": F.last("v", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))})
    got = scan.running(df, [F.col("g")], ["k"], {"_c": F.col("v")})
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_one_group_lies_in_all_partitions(spark, spread):
    df = spark.range(900).withColumns({"content": F.concat(F.lit("text "), F.col("id").cast("string")), "source_file": F.lit("one"), "source": F.lit(None).cast("string"), "section_name": F.lit("s")})
    got = chunking.tagged(df, "fixed", ["id"])
    assert [r["chunk_index"] for r in got.orderBy("id").collect()] == list(range(900))
    dealt = df.repartitionByRange("source_file", "id").groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) >= 8 and max(r["count"] for r in dealt) < 300


def test_scan_of_nothing(spark):
    assert scan.running(rows(spark).limit(0), [F.col("g")], ["k"], {"_c": F.col("v")}).count() == 0


@pytest.mark.parametrize("few", [3, 50, 10**6])
def test_order_statistics(spark, few):
    rng = random.Random(8)
    values = {"a": [rng.gauss(0, 5) for _ in range(701)], "b": [float(rng.randrange(4)) for _ in range(400)], "c": [7.0] * 90, None: [1.0, 2.0], "d": [None]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in [*vs, None]], "g string, v double").repartition(4)
    for place, pick in ((lambda n: F.floor(n / 2), lambda s: s[len(s) // 2]), (lambda n: n - 1, lambda s: s[-1]), (lambda n: F.floor(n * 0.05), lambda s: s[int(len(s) * 0.05)])):
        got = {r["g"]: (r["n"], r["least"], r["selected"], r["most"]) for r in selected(df, "g", "v", place, few).collect()}
        want = {g: (len(s), s[0], pick(s), s[-1]) for g, vs in values.items() if (s := sorted(v for v in vs if v is not None))}
        assert got == want


def test_rolling_windows_are_those_of_joined_texts(spark):
    rng = np.random.default_rng(4)
    parts = [" ".join(f"w{x}" for x in rng.integers(0, 50, rng.integers(0, 9))) + "." for _ in range(40)]
    embed = vectors.Hashed(16)
    assert (embed.counts([" ".join(parts[3:6])])[0] == embed.counts(parts[3:6]).sum(axis=0)).all()
    got = spark.createDataFrame([(t,) for t in parts], "t string").select("t", embed(F.col("t")).alias("v")).collect()
    assert all((np.array(r["v"]) == embed.counts([r["t"]])[0]).all() for r in got)


def test_semantic_chunks_either_way(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" + ("." if x % 9 == 0 else "") for x in rng.integers(0, 90, n)) for n in (5, 40, 400, 900)] + ["", "  ", "One sentence only without an end", None]
    df = spark.createDataFrame([(k, t, "s", None, None, "n") for k, t in enumerate(texts)], "doc_id long, text string, source string, source_file string, section_name string, n_parts string")
    told = lambda e: sorted((r["doc_id"], r["chunk_index"], r["content"], r["n_parts"]) for r in chunking.chunk(df, "semantic", embed=e).collect())
    assert told(vectors.Hashed(16)) == told(lambda t: vectors.hashed(t, 16)) != []
