"""The kept index against BM25 made anew: deltas, changed documents, scopes, skipped blocks, engines that share it."""

import random

import pytest

from siltstone.operators import lexical, rank
from siltstone.operators.access import Authorized
from siltstone.operators.stage import shared_path
from siltstone.plans.engine import Engine

WORDS = [f"w{k}" for k in range(60)]
ASKED = ["w1 w2 w2", "w59", "w3 w40 w41 nothing", "!!!", "w0", "w7 w8 w9 w10 w11"]


def texts(n=400, seed=5):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, [1 / (k + 1) for k in range(60)], k=rng.choice([1, 3, 8, 30, 200]))) for _ in range(n)]


def corpus(spark, rows):
    return Authorized(spark.createDataFrame(rows, "doc_pos long, passage string").repartition(3))


def asked(spark):
    return spark.createDataFrame(list(enumerate(ASKED)), "query_id int, query string")


def told(df):
    return sorted((r["query_id"], r["scope"], r["rank"], r["doc_pos"], round(r["score"], 9)) for r in df.collect())


@pytest.fixture
def few_first(monkeypatch):
    monkeypatch.setattr(lexical, "FIRST", 1)


@pytest.mark.parametrize("k", [1, 7, None])
def test_same_rows_as_a_full_search(spark, few_first, k):
    docs = corpus(spark, list(enumerate(texts())))
    index = lexical.KeptBm25.open(docs, shared_path(spark, "index"), "all", block=64)
    assert told(index.search(asked(spark), k)) == told(rank.Bm25(docs).search(asked(spark), k))


def test_blocks_are_skipped(spark, few_first):
    docs = corpus(spark, list(enumerate(texts(1500))))
    index = lexical.KeptBm25.open(docs, shared_path(spark, "index"), "all", block=256)
    scored, all_ = index.skipped(asked(spark), 3)
    assert scored < 0.6 * all_


def test_deltas_add_up(spark, few_first):
    rows, root = list(enumerate(texts())), shared_path(spark, "index")
    part = lexical.KeptBm25.open(corpus(spark, rows[100:300]), root, "all")
    assert part.tokenised == 200
    again = lexical.KeptBm25.open(corpus(spark, rows), root, "all")
    assert again.tokenised == 200 and again.deltas() == [0, 1]
    full = rank.Bm25(corpus(spark, rows))
    assert told(again.search(asked(spark), 5)) == told(full.search(asked(spark), 5))
    idf = lambda x: {r["token"]: round(r["idf"], 9) for r in x.idf().collect()}
    assert idf(again) == idf(full)
    assert lexical.KeptBm25.open(corpus(spark, rows[::-1]), root, "all").tokenised == 0


def test_changed_documents_make_a_new_generation(spark):
    rows, root = list(enumerate(texts(60))), shared_path(spark, "index")
    lexical.KeptBm25.open(corpus(spark, rows), root, "all")
    rows[3] = (3, "w1 w1 w1")
    index = lexical.KeptBm25.open(corpus(spark, rows[:50]), root, "all")
    assert index.generation == 1 and index.tokenised == 50
    assert told(index.search(asked(spark), 5)) == told(rank.Bm25(corpus(spark, rows[:50])).search(asked(spark), 5))


def test_a_delta_that_was_cut_short_counts_for_nothing(spark):
    rows, root = list(enumerate(texts(60))), shared_path(spark, "index")
    index = lexical.KeptBm25.open(corpus(spark, rows[:30]), root, "all")
    spark.createDataFrame([(99, 1)], "doc_pos long, hash long").write.parquet(index._path("docs", 1))  # the task died after its first table
    again = lexical.KeptBm25.open(corpus(spark, rows), root, "all")
    assert again.deltas() == [0, 1]
    assert told(again.search(asked(spark), 5)) == told(rank.Bm25(corpus(spark, rows)).search(asked(spark), 5))


def test_scopes_and_many_tokens(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PUSHED", 2)
    rows = [(k, t, ["", "even" if k % 2 == 0 else "odd"]) for k, t in enumerate(texts(200))]
    docs = Authorized(spark.createDataFrame(rows, "doc_pos long, passage string, scopes array<string>"))
    legs = asked(spark).selectExpr("query_id", "query", "explode(array('', 'even', 'none')) AS scope")
    index = lexical.KeptBm25.open(docs, shared_path(spark, "index"), "legs")
    assert told(index.search(legs, 4)) == told(rank.Bm25(docs).search(legs, 4))


def test_empty_corpus(spark):
    index = lexical.KeptBm25.open(corpus(spark, []), shared_path(spark, "index"), "all")
    assert index.search(asked(spark), 5).count() == 0


def test_second_batch_tokenises_nothing(spark):
    rows = [(k, t, ["general", "trading"][k % 2], "AAPL" if k % 3 else "GS", "Risk", "s", None, None, "10-K", "2024-01-01", k) for k, t in enumerate(texts(80))]
    docs = spark.createDataFrame(rows, "doc_pos long, content string, department string, ticker string, section_name string, source_file string, section_id string, cik string, filing_type string, filing_date string, chunk_index int")
    root = shared_path(spark, "index")
    q = spark.createDataFrame([(0, "What of w1 and w2?"), (1, "Apple w5?")], "query_id long, query string")
    one = Engine(docs, index_root=root)
    first = sorted(map(str, one.ask_batch(q, {"admin"}).collect()))
    made = {k: i.tokenised for k, i in one._indexes.items()}
    assert sum(made.values()) == 80
    assert sorted(map(str, one.ask_batch(q, {"admin"}).collect())) == first
    assert {k: i.tokenised for k, i in one._indexes.items()} == made
    other = Engine(docs, index_root=root)
    assert sorted(map(str, other.ask_batch(q, {"admin"}).collect())) == first
    assert sum(i.tokenised for i in other._indexes.values()) == 0
    viewer = Engine(docs, index_root=root)
    viewer.retrieve(q, {"viewer"})
    assert all(d["department"] != "trading" for d in viewer.retrieve(q, {"viewer"}).select("department").collect())


def test_a_batch_without_an_index_root_makes_no_postings(spark, monkeypatch):
    rows = [(k, t, ["general", "trading"][k % 2], "AAPL" if k % 3 else "GS", "Risk", "s", None, None, "10-K", "2024-01-01", k) for k, t in enumerate(texts(80))]
    docs = spark.createDataFrame(rows, "doc_pos long, content string, department string, ticker string, section_name string, source_file string, section_id string, cik string, filing_type string, filing_date string, chunk_index int")
    q = spark.createDataFrame([(0, "What of w1 and w2?"), (1, "Apple w5?"), (2, "Apple and Goldman on w3")], "query_id long, query string")
    kept = Engine(docs, index_root=shared_path(spark, "index"))
    want = sorted(map(str, kept.by_entity(q, {"admin"}).collect()))
    monkeypatch.setattr(lexical.KeptBm25, "_append", lambda *a: pytest.fail("postings were made"))
    assert sorted(map(str, Engine(docs).by_entity(q, {"admin"}).collect())) == want


def test_hybrid_takes_the_first_of_equal_texts(spark):
    rows = [(k, "w1 w2" if k in (4, 9) else t, "general", "GS", "Risk", "s", None, k) for k, t in enumerate(texts(30))]
    docs = spark.createDataFrame(rows, "doc_pos long, content string, department string, ticker string, section_name string, source_file string, section_id string, chunk_index int")
    from siltstone.operators import vectors

    engine = Engine(docs, embed=lambda t: vectors.hashed(t, 16))
    got = engine.retrieve(spark.createDataFrame([(0, "w1 w2")], "query_id long, query string"), {"admin"}, mode="hybrid", reranked=False)
    found = [r["doc_pos"] for r in got.orderBy("rank").collect()]
    assert len(found) == len(set(found)) and 4 in found and 9 not in found


def test_a_document_s_counts_are_made_in_its_task():
    import pyarrow as pa

    lists = pa.array([["b", "a", "b"], None, [], ["a"]], pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array([["", "x"], [""], [""], [""]]), lists], names=["doc_pos", "scopes", "t"])
    rows = [tuple(r.values()) for b in lexical._counts([batch]) for r in b.to_pylist()]
    assert sorted(rows) == [("a", [""], 4, 1, 1), ("a", ["", "x"], 1, 3, 1), ("b", ["", "x"], 1, 3, 2)]
