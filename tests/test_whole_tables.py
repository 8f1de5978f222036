"""Queries without SQL over a small table, against the same job in plain Python."""

import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siltstone.config import DEFAULTS
from siltstone.operators import chunking, vectors


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = np.random.default_rng(2)
    rows = []
    for k in list(range(230)) + list(range(9990, 10010)):
        n = int(rng.choice([12, 60, 250, 800]))
        t = " ".join(f"w{x}" + ("." if x % 29 == 0 else "") for x in rng.integers(0, 400, n))
        rows.append((k, t, f"s{k % 3}", "en", len(t)))
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{at}/documents.parquet")
    return at, rows


def test_section_spans_reads_every_document(spark, table):
    at, rows = table
    got = {(r["doc_id"], r["section_id"], r["n_chars"]) for r in entry.queries()["section_spans"](spark, at).collect()}
    # Titles are consumed as whole lines.
    want = {(k // 4, "item_" + ("1", "1a", "7", "8")[k % 4], len(t)) for k, t, *_ in rows if len(t) >= 100}
    assert any(len(t) >= 3000 for _, t, *_ in rows) and any(len(t) < 200 for _, t, *_ in rows)
    assert {(a, b) for a, b, _ in got} == {(a, b) for a, b, _ in want}
    assert {(a, b): n for a, b, n in got} == {(a, b): n for a, b, n in want}


def test_running_header_strip_reads_every_document(spark, table):
    at, rows = table
    pages = defaultdict(list)
    for k, _, s, *_ in sorted(rows):
        pages[f"{s}/{k // 9999}"].append(k % 9999 + 1)
    pages = {s: p for s, p in pages.items() if len(p) >= 8}
    got = defaultdict(list)
    for r in entry.queries()["running_header_strip"](spark, at).orderBy("doc_id", "line_no").collect():
        assert r["line"] == "ACME CORP AND SUBSIDIARIES"
        got[r["doc_id"]].append(r["page"])
    assert got == pages and sum(map(len, pages.values())) > 200


def test_chunk_semantic_reads_every_document(spark, table):
    at, rows = table
    parts = {k: [x for x in (y.strip() for y in re.split(r"(?<=[.?!])\s+", t)) if x] for k, t, *_ in rows}
    wide = [(k, i, " ".join(s[max(0, i - 1) : i + 2])) for k, s in parts.items() for i in range(len(s))]
    df = spark.createDataFrame(wide, "k long, i int, w string").select("k", "i", vectors.hashed(F.col("w"), 16).alias("v"))
    vec = {(r["k"], r["i"]): np.array(r["v"], float) for r in df.collect()}
    want = []
    for k, s in parts.items():
        u = [vec[k, i] / np.linalg.norm(vec[k, i]) for i in range(len(s))]
        gaps = [1 - float(a @ b) for a, b in zip(u, u[1:])]
        cut = np.percentile(gaps, 100 * DEFAULTS.breakpoint_percentile) if gaps else 0
        segments = [[s[0]]]
        for gap, x in zip(gaps, s[1:]):
            if gap > cut + 1e-12:  # two equal gaps differ by rounding alone
                segments.append([])
            segments[-1].append(x)
        for text in map(" ".join, segments):
            pieces = chunking.split_recursively(text, DEFAULTS.chunk_size, DEFAULTS.chunk_overlap) if len(text) > DEFAULTS.max_semantic_chars else [text]
            want += [(k, len(x)) for x in pieces if len(x) >= DEFAULTS.min_chunk_chars]
    got = [(r["doc_id"], r["char_count"]) for r in entry.queries()["chunk_semantic"](spark, at).collect()]
    assert sorted(got) == sorted(want)
