"""The registered queries and their SQL fit together."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from remedia.catalog.base import table


def test_every_sql_has_a_query_and_names_its_columns(spark, sf_dir):
    queries, oracle = entry_module.queries(), entry_module.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 70
    con = duckdb.connect()
    for name in ("orders", "lineitem", "customer", "events", "documents", "labels", "embeddings",
                 "benchmark", "part"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    for name, sql in oracle.items():
        cols = [d[0] for d in con.execute(f"DESCRIBE {sql}").description] and [
            r[0] for r in con.execute(f"DESCRIBE {sql}").fetchall()]
        assert len(cols) == len(set(cols)), name


@pytest.mark.parametrize("name", [
    "deadline_rows_by_regulation", "silver_quarantine_counts", "psi_numeric", "triage_routing"])
def test_same_rows_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    res = con.execute(entry_module.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    want = sorted(map(repr, res.fetchall()))
    df = entry_module.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(repr(tuple(r)) for r in df.select(*cols).collect()) == want


def test_scans_are_pruned_and_filters_pushed(spark, sf_dir):
    plan = entry_module.queries()["shadow_by_segment"](
        spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,lang:string,n_chars:bigint>" in plan
    old = table(spark, sf_dir, "events").where("user_id = 3").select("value")
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,3)]" in (
        old._jdf.queryExecution().executedPlan().toString())
