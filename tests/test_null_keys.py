"""Queries against their oracles on tables with null sectors, texts and languages."""
import importlib.util
import os
import shutil
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def altered():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("test tables not present")
    out = tempfile.mkdtemp(prefix="trendspark-nulls-", dir="/tmp")
    con = duckdb.connect()
    changed = {
        "customer": "case when c_custkey % 7 = 0 then null else c_mktsegment end as c_mktsegment",
        "documents": "case when doc_id % 9 = 0 then null else text end as text, case when doc_id % 4 = 0 then null else lang end as lang",
    }
    for t in TABLES:
        if t in changed:
            con.execute(f"copy (select * replace ({changed[t]}) from '{SF}/{t}.parquet') to '{out}/{t}.parquet' (format parquet)")
        else:
            shutil.copyfile(f"{SF}/{t}.parquet", f"{out}/{t}.parquet")
        con.execute(f"create view {t} as select * from read_parquet('{out}/{t}.parquet')")
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    return out, con, entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", ["join_target", "ts_folds", "sector_forecasts", "sectors_without_model", "completeness_impact",
                                  "source_recommendations", "drift_check", "raw_asof", "flatten_papers", "flatten_article_xml"])
def test_null_groups_and_texts(spark, altered, name):
    out, con, queries, oracles = altered
    got = sorted((tuple(sorted(r.asDict().items())) for r in queries[name](spark, out).collect()), key=str)
    rel = con.sql(oracles[name])
    want = sorted((tuple(sorted(zip(rel.columns, row))) for row in rel.fetchall()), key=str)
    assert len(got) == len(want) and got == want
