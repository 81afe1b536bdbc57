"""Registered queries against their reference SQL on the smallest data."""
import duckdb
import pytest

import __spark_entry__ as entry_module
from check import rows_of
from faultlens.catalog.views import TABLES

DATA = "/root/testdata/sf0.001"
SAMPLE = (
    "C05_primary_classification", "C16_failed_tests", "Q10_duration_stats", "Q18_test_classification", "I05_recurrence", "G03_changed_line_coverage",
    "G10_gate_reasons", "D09_critical_path", "D11_metric_window", "X03_test_recommendations", "E10_corpus_audit", "O05_budget_admission", "L04_redact_documents",
    "S05_junit_results", "W03_stream_recurrence",
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, duck, name):
    df = entry_module.queries()[name](spark, DATA)
    cursor = duck.execute(entry_module.oracle_sql()[name])
    names = [item[0] for item in cursor.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cursor.fetchall())


def test_entry_and_registry(spark):
    assert entry_module.entry(spark).columns == ["stage", "kind", "severity", "component", "failures"]
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_no_cross_join_in_any_plan_of_the_sample(spark):
    for name in ("Q20_related_incidents", "G03_changed_line_coverage", "X01_related_tests", "T05_owners", "D11_metric_window", "O04_token_cost"):
        plan = entry_module.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
