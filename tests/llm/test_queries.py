"""Registered queries on a small table: held-out quality, the SQL, and the pipeline's stages."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from siltstone.llm import queries

SF = "/root/testdata/sf0.01"


def test_mix_agrees_with_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute("SELECT doc_id, size, source_size, target, taken FROM (" + queries.ORACLE["op1_mix_sources"] + ")").fetchall())
    got = sorted(tuple(r) for r in queries.op1_mix_sources(spark, SF).select("doc_id", "size", "source_size", "target", "taken").collect())
    assert got == want


def test_language_held_out(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in queries.op9_language(spark, SF).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.98


def test_toxicity_held_out(spark):
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [r for r in queries.op5_toxicity(spark, SF).collect() if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.9


def test_toxic_texts_are_found_and_clean_ones_left_alone(spark):
    """Recall and false alarms, which a share of right answers hides where most texts are clean."""
    at = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    held = [r for r in queries.op5_toxicity(spark, at).collect() if r["held_out"] and r["doc_id"] in truth]
    toxic, clean = ([r["predicted"] for r in held if truth[r["doc_id"]] == k] for k in (1, 0))
    assert len(toxic) > 50 and np.mean(toxic) > 0.85 and np.mean(clean) < 0.01


def test_model_beats_the_base_on_held_out_texts(spark):
    held = [r for r in queries.op2_lm_score(spark, SF).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_on_nothing(spark, k):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[k][1](spark, docs, SF).count() == 0


def test_stages_leave_columns_of_their_results_names_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "concat('l', doc_id) AS lang_pred", "doc_id * 2 AS toxic_score", "doc_id AS lang_share", "'k' AS _k", "'h' AS _h")
    for name, stage in corpus_pipeline.STAGES[:3]:
        found = stage(spark, docs, SF)
        assert found.columns == docs.columns
        got = found.collect()
        assert got and all((r["lang_pred"], r["toxic_score"], r["lang_share"], r["_k"], r["_h"]) == (f"l{r['doc_id']}", 2 * r["doc_id"], r["doc_id"], "k", "h") for r in got)


def test_pipeline_keeps_clean_documents(spark):
    from siltstone.llm.common import staged

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    a = staged(corpus_pipeline.language(spark, docs, SF), "t1")
    assert a.columns == docs.columns and a.count() == docs.count()
    b = staged(corpus_pipeline.toxic(spark, a, SF), "t2")
    gone = {r["doc_id"] for r in a.join(b, "doc_id", "left_anti").collect()}
    assert b.columns == docs.columns and not [d for d in gone if labels.get(d) == 0]


def test_pipeline_on_a_small_table(spark):
    from tokenizers import Tokenizer

    from siltstone.llm import mixing
    from siltstone.llm.common import staged

    at = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = staged(stage(spark, kept, at), name)
        assert kept.columns == docs.columns
    classes = {r["doc_id"]: r["class_id"] for r in queries.op3_near_duplicates(spark, at).collect()}
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and len({classes[k] for k in ids}) == len(ids)
    plan = {r["key"]: r["copies"] for r in mixing.mix_plan(kept).collect()}
    library = Tokenizer.from_file(queries.tokenizer_file())
    text = {r["doc_id"]: r["text"] or "" for r in kept.collect()}
    got = Counter()
    for r in corpus_pipeline.run(spark, at).collect():
        ids = library.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert bytes(r["ids"]) == np.array(ids, "<u4").tobytes() and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        got[r["doc_id"]] += 1
    assert got == {k: n for k, n in plan.items() if n}
