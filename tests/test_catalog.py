import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FEW = ["bm25_topk", "rbac_departments", "documents_listing", "rrf_weighted", "dense_topk", "table_detect", "citation_parse", "pii_redact", "near_dup_greedy", "gate_thresholds", "rate_limit_fixed_window"]


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", FEW)
def test_query_and_sql_agree(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    rel = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    want = sorted(str([plain(dict(zip(names, r))[c]) for c in cols]) for r in rel.fetchall())
    assert sorted(names) == cols and got == want


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_no_roles_reach_no_scan_rows(spark):
    assert entry.queries()["unknown_role_reads_nothing"](spark, SF).count() == 0


def test_role_filter_reaches_the_scan(spark):
    plan = entry.queries()["metadata_scan"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,lang:string,source:string>" in plan
