"""The case chain computes each of its parts once."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from remedia.catalog import cases as catalog
from remedia.functions.dates import business_index, is_business_day
from remedia.operators import calendar as cal
from remedia.plans import triage as plan
from remedia.streaming import feeds


def test_letters_are_searched_once_a_check(spark, sf_dir):
    text = plan.failures(catalog.cases(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    # three checks, each with one search for citations and one for dates
    assert text.count("regexp_extract_all(") == 6


def test_business_index_over_four_centuries(spark):
    days = cal.business_calendar(spark, 1999, 2403).select(
        "day", business_index(F.col("day")).alias("i"), is_business_day(F.col("day")).alias("b")).toPandas()
    days = days.sort_values("day")
    counted = days["b"].astype(int).cumsum()
    assert (days["i"] - counted).nunique() == 1
    ahead = spark.createDataFrame([(d,) for d in days["day"][20:-400:97]], "day date").withColumn(
        "n", F.lit(20))
    due = {r["day"]: r["due"] for r in cal.look_ahead(ahead, F.col("day"), "x").select(
        "day", cal.nth_ahead("x", 20).alias("due")).collect()}
    place = dict(zip(days["day"], days["i"]))
    work = dict(zip(days["day"], days["b"]))
    assert all(place[end] == place[start] + 20 and work[end] for start, end in due.items())


def test_required_stages_read_the_cases_in_one_pass(spark, sf_dir):
    plan_text = catalog.required_stages(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan_text.count("Relation [") == 1


def test_a_feed_of_one_file_is_spread(spark, tmp_path):
    rows = spark.range(64).select(F.col("id").cast("string").alias("complaint_id"), F.lit("q").alias("queue"))
    rows.coalesce(1).write.parquet(str(tmp_path / "feed"))
    feed = feeds.file_feed(spark, str(tmp_path / "feed"), rows.schema)
    feeds.start_triage(feed, lambda batch: batch.withColumn("task", F.spark_partition_id()),
                       str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    done = spark.read.parquet(str(tmp_path / "out/cases"))
    assert done.count() == 64 and done.select("task").distinct().count() > 1


def test_attempts_take_rows_and_leave_unchanged_state_alone():
    class State:
        value, writes = None, 0

        def get(self):
            return self.value

        def update(self, value):
            self.value, self.writes = value, self.writes + 1

    case = feeds.Attempts(lambda case, attempt: None, 3)
    case.state = State()
    rows = [Row(payload='{"id": 1}'), Row(payload='{"id": 1}')]
    first = list(case.handleInputRows(("1",), iter(rows), None))
    assert [(r.attempts, r.state) for r in first] == [(1, "succeeded")]
    assert not list(case.handleInputRows(("1",), iter(rows), None)) and case.state.writes == 1
