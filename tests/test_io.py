import json

import pytest
from pyspark.sql import functions as F

from siltstone.operators import access, evaluate, filings, vectors
from siltstone.sources import readers, sinks
from siltstone.streaming import audit


def test_directory_and_unknown_suffix(spark, tmp_path):
    (tmp_path / "a.txt").write_text("héllo", encoding="utf-8")
    (tmp_path / "b.html").write_text("<p>hi</p><script>x</script>", encoding="utf-8")
    (tmp_path / "c.xyz").write_text("no")
    got = {r["path"].rsplit("/", 1)[-1]: r["text"].strip() for r in readers.load_directory(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "héllo", "b.html": "hi"}
    with pytest.raises(ValueError):
        readers.load(spark, str(tmp_path / "c.xyz"))


def test_filings_with_and_without_metadata(spark, tmp_path):
    (tmp_path / "AAPL").mkdir()
    (tmp_path / "GS").mkdir()
    (tmp_path / "AAPL" / "10-K_2024-11-01.html").write_text("<p>x</p>")
    (tmp_path / "GS" / "10-K_2025-02-01.html").write_text("<p>y</p>")
    (tmp_path / "GS" / "10-K_2025-02-01.json").write_text(json.dumps({"ticker": "gs", "cik": "1", "company_name": "G", "form_type": "10-K/A", "filing_date": "2025-02-02"}))
    got = {r["ticker"]: (r["company_name"], r["filing_type"], r["filing_date"]) for r in readers.filings_from_disk(spark, str(tmp_path)).collect()}
    assert got == {"AAPL": ("Apple Inc.", "10-K", "2024-11-01"), "GS": ("G", "10-K/A", "2025-02-02")}


def test_collection_life(spark, tmp_path):
    path, to = str(tmp_path / "c"), str(tmp_path / "d")
    df = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "b")], "chunk_id string, content string")
    assert sinks.add_chunks(df, path) == 2 and sinks.add_chunks(df, path) == 0
    n, digest = sinks.copy_collection(spark, path, to)
    assert n == 2 and len(digest) == 16
    ids = spark.read.parquet(path).limit(1).select("chunk_id")
    sinks.delete_chunks(spark, path, ids, str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).count() == 1


def test_users(spark):
    held = spark.createDataFrame([("ann",)], "username string")
    assert sinks.insert_users(spark.createDataFrame([("bob",), ("bob",)], "username string"), held).count() == 1
    with pytest.raises(ValueError):
        sinks.insert_users(held, held)


def test_stream_of_audit_rows(spark, tmp_path):
    rows = [("rag_query", f"2025-01-0{1 + k % 2} 00:00:{k:02d}", f"u{k % 3}") for k in range(30)]
    df = spark.createDataFrame(rows, "event_type string, timestamp string, username string").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    sinks.append_audit(df, str(tmp_path / "trail"))
    stream = audit.requests(audit.read_trail(spark, str(tmp_path / "trail") + "/*"), "username", "timestamp", 2)
    q = stream.writeStream.format("memory").queryName("trail").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("trail").select("window.start", "username", "n", "rejected").collect()))
    want = sorted(map(tuple, audit.requests(df, "username", "timestamp", 2).select("window.start", "username", "n", "rejected").collect()))
    assert got == want and got


def test_similar_chunks_are_not_added(spark, tmp_path):
    path = str(tmp_path / "c")
    embed = lambda t: vectors.hashed(t, 64)
    words = [f"w{k}" for k in range(40)]
    a, b, other = " ".join(words), " ".join([*words[:-1], "changed"]), "entirely different words stand here"
    df = spark.createDataFrame([("1", a), ("2", b), ("3", other)], "chunk_id string, content string").coalesce(1)
    assert sinks.add_chunks(df, path, embed, 0.95) == 2
    more = spark.createDataFrame([("4", b), ("5", "something new altogether is said")], "chunk_id string, content string")
    assert sinks.add_chunks(more, path, embed, 0.95) == 1
    assert {r["content"] for r in spark.read.parquet(path).collect()} >= {other, "something new altogether is said"}
    assert spark.read.parquet(path).count() == 3


def test_run_is_one_json_row(spark, tmp_path):
    corpus = spark.createDataFrame([(3, "abc")], "chunk_count long, digest string")
    scores = spark.createDataFrame([("faithfulness", 0.5), ("recall", 0.25)], "metric string, value double")
    rows = spark.createDataFrame([("q1", 1.0), ("q2", None)], "question string, faithfulness double")
    sinks.write_run({"judge_model": "m"}, corpus, scores, rows, str(tmp_path / "run"))
    got = spark.read.json(str(tmp_path / "run")).collect()
    assert len(got) == 1 and got[0]["config"]["judge_model"] == "m" and got[0]["corpus"]["content_digest"] == "abc" and got[0]["scores"]["recall"] == 0.25
    assert sorted(r["question"] for r in got[0]["per_question_scores"]) == ["q1", "q2"]


def test_roles_and_sections_of_filings(spark):
    held = spark.createDataFrame([("admin",)], "name string")
    assert [r[0] for r in sinks.seed_roles(spark.createDataFrame([("admin",), ("viewer",)], "name string"), held).collect()] == ["viewer"]
    parts = spark.createDataFrame([(1, "item_1", "text"), (2, "item_7", "more")], "doc_id long, section_id string, content string")
    papers = spark.createDataFrame([(1, "aapl", "10-K", "2024-11-01"), (2, "NONE", "10-K", "2024-01-01")], "doc_id long, ticker string, filing_type string, filing_date string")
    got = filings.section_documents(parts, papers).collect()
    assert len(got) == 1 and got[0]["ticker"] == "AAPL" and got[0]["source_file"] == "AAPL_10-K_2024-11-01" and got[0]["company_name"] == "Apple Inc."
    df = filings.enriched(spark.createDataFrame([("/x/y/a.txt",)], "path string"), F.col("path"), "research", ["admin", "viewer"])
    assert df.first()["source_file"] == "a.txt" and df.first()["access_roles"] == "admin,viewer"
    assert access.may_read({"admin"}, "anything") and access.may_read({"viewer"}, "general") and not access.may_read({"research"}, "trading") and not access.may_read(set(), "general")


def test_runs_that_cannot_be_compared(spark):
    run = lambda **x: spark.createDataFrame(list(x.items()), "key string, value string")
    evaluate.require_comparable(run(judge_model="a", top_k="5"), run(judge_model="a", top_k="9"))
    with pytest.raises(ValueError, match="corpus, judge_model"):
        evaluate.require_comparable(run(judge_model="a", corpus="1"), run(judge_model="b", corpus="2", top_k="3"))
    apart = evaluate.incomparable(run(judge_model="a", top_k="5"), run(top_k="9"))
    assert [tuple(r) for r in apart.collect()] == [("judge_model", "a", None)]
    assert [evaluate.weight_ratio(*x) for x in ((0.7, 0.3), (1, 0), (0, 0))] == ["2.333:1", "dense_only", "none"]


def test_judged_rows_meet_by_number(spark):
    results = spark.createDataFrame([(0, "a", "answer", None), (1, "b", "refuse", None), (2, "c", None, "boom")], "question_no long, question string, expected_behavior string, error string")
    scores = spark.createDataFrame([(0, "a ", 0.5)], "question_no long, question string, recall double")
    out, each = evaluate.judged(results, scores, ["recall"])
    assert out.first()["recall"] == 0.5 and out.first()["recall_n"] == 1 and each.count() == 3
    with pytest.raises(ValueError, match="order"):
        evaluate.judged(results, scores.withColumn("question", F.lit("zzz")), ["recall"])
