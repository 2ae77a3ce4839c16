"""Steps that must do their work once: date counts without messages, first rows of repeated ids."""

from pyspark.sql import functions as F

from remedia.operators import layers
from remedia.operators import validation as v

DAYS = [None, "", "n/a", "1999-12-31", "2000-01-05", "20000210", " 2002-01-01 ", "2024-02-30"]


def test_date_counts_are_those_of_the_issues_and_make_no_message(spark):
    rows = [(a, b, c) for a in DAYS for b in DAYS for c in DAYS]
    df = spark.createDataFrame(rows, "transaction_date string, statement_date string, notice_date string")
    as_of = F.to_date(F.lit("2001-06-30"))
    issues = F.col("date_check.issues")
    of = lambda kind: F.size(F.filter(issues, lambda i: i["severity"] == kind))
    both = v.count_date_issues(v.validate_dates(df, as_of), as_of)
    assert both.where((F.col("errors") != of("error")) | (F.col("warnings") != of("warning"))).count() == 0
    counted = v.count_date_issues(df, as_of)
    assert counted.agg(F.sum("errors")).first()[0] > 500
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "implausibly" not in plan and plan.count("gettimestamp") <= 6


def test_first_rows_of_repeated_ids_are_found_once(spark):
    df = spark.range(90).select(
        "id", F.when(F.col("id") % 10 != 3, F.col("id") % 40).alias("key"), (F.col("id") % 4 != 0).alias("ok"))
    marked = layers.mark_repeats(df, "key", ["id"], F.col("ok"))
    plan = marked._jdf.queryExecution().optimizedPlan().toString()
    assert "min(" not in plan
    first, want = {}, set()
    for r in df.orderBy("id").collect():
        if r["key"] in first and r["key"] is not None:
            want.add(r["id"])
        elif r["ok"]:
            first[r["key"]] = r["id"]
    assert {r["id"] for r in marked.where("_repeat").collect()} == want and want
