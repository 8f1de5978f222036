"""Many names at once against one pattern after another, and evidence against a plain search."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.functions import entities
from siltstone.operators import names


def test_register_mentions_as_the_patterns_do(spark):
    rng = random.Random(2)
    words = ["Apple", "apple", "apples", "aapl", "AAPL", "JP Morgan", "jpmorgan chase", "Chase", "purchase", "GS", "gs", "Goldman", "goldman sachs", "tesla", "Tesla's", "x_Tesla", "MSFT-", "Microsoft", "and", "ÉApple", "Pineapple", "the", "J.P. Morgan"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 9))) for _ in range(300)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(3)
    got = {r["k"]: r["entities"] for r in names.mentioned(df, names.register(spark)).collect()}
    want = {r["k"]: r["e"] for r in df.select("k", F.coalesce(entities.detect(F.col("text")), F.array().cast("array<string>")).alias("e")).collect()}
    assert got == want and sum(map(len, want.values())) > 200


def test_a_hundred_thousand_names_in_one_pass(spark):
    held = spark.range(100_000).select(F.concat(F.lit("Firm "), F.col("id").cast("string")).alias("alias"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.col("id").cast("int").alias("place"), F.lit(False).alias("exact"))
    df = spark.createDataFrame([(0, "firm 99999 then FIRM 12, not Firm 12345678 nor affirm 7"), (1, "Firm 5Firm 6 firm 7")], "k int, text string")
    got = {r["k"]: r["entities"] for r in names.mentioned(df, held).collect()}
    assert got == {0: ["f99999", "f12"], 1: ["f7"]}


def test_too_many_names_are_refused(spark, monkeypatch):
    monkeypatch.setattr(names, "NAMES", 3)
    with pytest.raises(ValueError, match="more than one automaton holds"):
        names.mentioned(spark.createDataFrame([("a",)], "text string"), names.register(spark))


@pytest.mark.parametrize("chars", [20, 10**6])
def test_evidence(spark, chars):
    rng = random.Random(6)
    texts = ["".join(rng.choices("abAB ", k=rng.randrange(0, 30))) for _ in range(80)] + [None, ""]
    chunks = [(t, rng.choice(["X", "Y", None])) for t in texts] + [(None, "Z")]
    probes = [(k, rng.choice(["X", "Y", "Z", None]), rng.choice([None, "", "".join(rng.choices("abAB ", k=rng.randrange(1, 7)))])) for k in range(60)]
    got = {r["probe_id"] for r in names.held(spark.createDataFrame(probes, "probe_id int, ticker string, evidence string"), spark.createDataFrame(chunks, "content string, ticker string").repartition(3), chars).collect()}
    want = {k for k, t, e in probes if t is not None and e is not None and any(c == t and x is not None and e.lower() in x.lower() for x, c in chunks)}
    assert got == want and 5 < len(want) < 55


def test_no_names_and_no_evidence(spark):
    assert names.mentioned(spark.createDataFrame([("GS",)], "text string"), names.register(spark).limit(0)).first()["entities"] == []
    assert names.held(spark.createDataFrame([], "probe_id int, ticker string, evidence string"), spark.createDataFrame([("x", "X")], "content string, ticker string")).count() == 0
