"""The 22 hand-computed deadline cases, plus calendar points and invariants."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from remedia.functions.dates import is_business_day, is_federal_holiday
from remedia.operators import calendar as cal
from remedia.operators.deadlines import compute_deadlines

D = date.fromisoformat


def _dues(spark, rows, regulation):
    df = spark.createDataFrame(rows).withColumn("regulation", F.lit(regulation))
    return {r["case"]: r for r in compute_deadlines(df).collect()}


def _due(row, name):
    return {d["name"]: d["due"].isoformat() for d in row["deadlines"]["deadlines"]}.get(name)


INITIAL = "investigation concluded, or provisional credit given"
EXTENDED = "extended investigation deadline"


def test_calendar_points(spark):
    rows = [("2024-11-20", 10, "2024-12-05"), ("2024-12-27", 3, "2025-01-02"),
            ("2024-11-28", 0, "2024-11-28"), ("2024-11-27", 1, "2024-11-29")]
    df = spark.createDataFrame([(D(a), n, D(b)) for a, n, b in rows], "s date, n int, want date")
    got = cal.add_business_days(df, "s", "n", "due").collect()
    assert all(r["due"] == r["want"] for r in got)
    days = {"2020-06-19": False, "2021-06-18": True, "2024-11-28": True, "2023-11-23": True,
            "2021-07-05": True, "2021-07-04": False, "2021-12-31": True, "2024-11-23": False}
    df = spark.createDataFrame([(D(k), v) for k, v in days.items()], "d date, want boolean")
    for r in df.select("*", is_federal_holiday(F.col("d")).alias("h")).collect():
        assert r["h"] == r["want"], r


def test_walk_matches_day_by_day_count(spark):
    table = {r["day"]: r["b"] for r in cal.business_calendar(spark, 2020, 2026).select(
        "day", is_business_day(F.col("day")).alias("b")).collect()}

    def walk(day, n):
        step = 1 if n > 0 else -1
        left = abs(n)
        while left:
            day += timedelta(days=step)
            left -= table[day]
        return day

    rows = [(D("2021-12-20") + timedelta(days=3 * i), n) for i in range(40)
            for n in (-20, -3, -1, 0, 1, 2, 10, 20)]
    df = spark.createDataFrame(rows, "s date, n int")
    for r in cal.add_business_days(df, "s", "n", "due").collect():
        assert r["due"] == walk(r["s"], r["n"])
    pairs = spark.createDataFrame(
        [(D("2024-11-01"), D("2025-01-15")), (D("2025-01-15"), D("2024-11-01"))],
        "a date, b date")
    forward, back = [r["n"] for r in cal.business_days_between(pairs, "a", "b", "n").orderBy(
        "a").collect()]
    assert forward == -back == sum(
        table[D("2024-11-01") + timedelta(days=i)] for i in range(1, 76))


def test_closed_form_over_all_years(spark):
    """Index and inverse agree with a count of every day, from year 1 to 9999 in one table."""
    days = cal.business_calendar(spark, 1994, 2035).orderBy("day").collect()
    count = 0
    for r in days:
        count += r["is_business_day"]
        assert r["idx"] == count and r["is_business_day"] == (r["day"].weekday() < 5 and not r["is_holiday"])
    rows = [(date.fromordinal(n), k) for n in range(1 + 400, date.max.toordinal() - 400, 12_345) for k in (-250, -1, 1, 7, 251)]
    df = spark.createDataFrame(rows, "s date, n int")
    out = cal.next_business_day(cal.add_business_days(df, "s", "n", "due"), "due", "after")
    out = cal.business_days_between(out, "s", "due", "between")
    for r in out.select("*", is_business_day(F.col("s")).alias("b"), is_business_day(F.col("due")).alias("d"),
                        is_business_day(F.col("after")).alias("a")).collect():
        assert r["d"] and r["a"] and 1 <= (r["after"] - r["due"]).days <= 5
        assert r["between"] == (r["n"] if r["n"] > 0 else r["n"] + 1 - r["b"]), r
    nothing = spark.createDataFrame([(None, 3)], "s date, n int")
    assert cal.next_business_day(cal.add_business_days(nothing, "s", "n", "due"), "s", "x").first()["due"] is None


def test_reg_e(spark):
    base = dict(notice_date="2024-11-20", statement_date="2024-11-01", account_opened=None,
                provisional_credit_given=False, point_of_sale=False)
    rows = [
        dict(base, case="plain"),
        dict(base, case="credit", provisional_credit_given=True),
        dict(base, case="pos", provisional_credit_given=True, point_of_sale=True),
        dict(base, case="new", account_opened="2024-11-05"),
        dict(base, case="in", notice_date="2024-12-31"),
        dict(base, case="late", notice_date="2025-01-01"),
        dict(base, case="missing", notice_date=None)]
    schema = ("case string, notice_date string, statement_date string, account_opened string, "
              "provisional_credit_given boolean, point_of_sale boolean")
    df = spark.createDataFrame(rows, schema).withColumn("regulation", F.lit("REG_E"))
    got = {r["case"]: r for r in compute_deadlines(df).collect()}
    assert _due(got["plain"], INITIAL) == "2024-12-05"
    assert _due(got["credit"], EXTENDED) == "2025-01-04"
    assert _due(got["pos"], EXTENDED) == "2025-02-18"
    assert _due(got["pos"], INITIAL) == "2024-12-05"
    assert _due(got["new"], INITIAL) == "2024-12-19"
    assert got["in"]["deadlines"]["consumer_notice_timely"] is True
    assert got["late"]["deadlines"]["consumer_notice_timely"] is False
    assert _due(got["plain"], EXTENDED) is None
    assert got["missing"]["deadlines"]["error"] == "missing date field 'notice_date'"
    assert got["late"]["deadlines"]["findings"][0].startswith("Consumer notice arrived 1 day(s)")


@pytest.mark.parametrize("discovery,notice,statement,cap", [
    ("2024-11-18", "2024-11-19", "2024-11-01", 50.0),
    ("2024-11-01", "2024-11-20", "2024-11-01", 500.0),
    ("2024-08-01", "2025-01-15", "2024-11-01", None)])
def test_liability(spark, discovery, notice, statement, cap):
    df = spark.createDataFrame(
        [(discovery, notice, statement, "REG_E")],
        "discovery_date string, notice_date string, statement_date string, regulation string")
    assert compute_deadlines(df).first()["liability"]["liability_cap_usd"] == cap


def test_other_regulations(spark):
    z = _dues(spark, [
        dict(case=str(c), notice_date="2024-11-20", statement_date="2024-11-01",
             billing_cycle_days=c) for c in (30, 50)], "REG_Z")
    assert _due(z["30"], "resolution complete") == "2025-01-19"
    assert _due(z["50"], "resolution complete") == "2025-02-18"
    assert _due(z["30"], "written acknowledgement to the consumer") == "2024-12-20"
    f = _dues(spark, [
        dict(case=str(m), notice_date="2024-11-20", additional_information_provided=m)
        for m in (False, True)], "FCRA")
    assert _due(f["False"], "reinvestigation complete") == "2024-12-20"
    assert _due(f["True"], "reinvestigation complete") == "2025-01-04"
    p = _dues(spark, [
        dict(case=w, first_contact_date="2024-11-20", written_dispute_date=w)
        for w in ("2024-12-20", "2024-12-21")], "FDCPA")
    assert _due(p["2024-12-20"], "validation notice sent") == "2024-11-25"
    assert p["2024-12-20"]["deadlines"]["consumer_notice_timely"] is True
    assert p["2024-12-21"]["deadlines"]["consumer_notice_timely"] is False
    assert p["2024-12-21"]["deadlines"]["citations"] == ["1692d", "1692e", "1692g(a)"]


def test_deadlines_do_not_shuffle(spark):
    df = spark.createDataFrame(
        [("2024-11-20", "2024-11-01", "REG_E")],
        "notice_date string, statement_date string, regulation string")
    plan = compute_deadlines(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    assert "Join" not in plan and "Window" not in plan


@pytest.mark.parametrize("year", [1905, 1985, 2024, 2065, 2190])
def test_any_year(spark, year):
    """The calendar follows the dates: the same clock gives the same tier in every century."""
    rows = [("REG_E", f"{year}-06-04", f"{year}-06-03", f"{year}-05-20", True)]
    df = spark.createDataFrame(
        rows, "regulation string, notice_date string, discovery_date string, statement_date string, access_device boolean")
    got = compute_deadlines(df).first()
    assert got.deadlines.error is None and got.liability.tier == "tier 1"
    assert got.liability.liability_cap_usd == 50.0
