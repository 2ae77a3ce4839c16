"""Streams: retries by keyed state, labels that arrive late."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from remedia.operators import shadow
from remedia.streaming import feeds


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", feeds.ROCKSDB)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_failed_cases_are_tried_three_times(spark, tmp_path, rocksdb):
    def work(case, attempt):
        if case["name"] == "never" or (case["name"] == "third" and attempt < 3):
            raise ValueError(f"{case['name']} {attempt}")

    schema = "id long, name string"
    feed_path, out = str(tmp_path / "feed"), str(tmp_path / "out")
    rows = [(i, f"fine{i}") for i in range(10)] + [(100, "third"), (101, "never"), (None, "nameless")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(feed_path)

    def start():
        feed = feeds.file_feed(spark, feed_path, schema)
        return feeds.start_attempts(feed, work, lambda c: c.withColumn("seen", F.lit(True)), "id", out, f"{out}/ck")

    start().awaitTermination()
    first = {r["name"] for r in spark.read.parquet(f"{out}/cases").collect()}
    assert first == {f"fine{i}" for i in range(10)}  # a failed case holds up none of its batch
    feeds.run_attempts(start)
    done = {r["name"]: r["work_attempts"] for r in spark.read.parquet(f"{out}/cases").collect()}
    assert done == {f"fine{i}": 1 for i in range(10)} | {"third": 3}
    dead = spark.read.parquet(f"{out}/dead").collect()
    assert [(r["key"], r["attempts"], r["error"]) for r in dead] == [("101", 3, "ValueError: never 3")]
    spark.createDataFrame([(3, "fine3")], schema).coalesce(1).write.mode("append").parquet(feed_path)
    start().awaitTermination()
    assert spark.read.parquet(f"{out}/cases").count() == 11  # a repeated delivery is left out


def test_labels_after_their_events(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    hour = dt.timedelta(hours=1)
    events = [(i, day + i * hour) for i in range(200)]
    labels = [(i, day + (i + 30 * (i % 2)) * hour, "1") for i in range(0, 200, 3)]
    spark.createDataFrame(events + events[:5], "id long, ts timestamp").write.parquet(str(tmp_path / "e"))
    spark.createDataFrame(labels, "id long, known timestamp, truth string").write.parquet(str(tmp_path / "l"))
    rows = feeds.labelled(
        feeds.file_feed(spark, str(tmp_path / "e"), "id long, ts timestamp"),
        feeds.file_feed(spark, str(tmp_path / "l"), "id long, known timestamp, truth string"),
        "id", "ts", "known", "24 hours", "1 hour")
    counts = feeds.shadow_windows(rows, "ts", F.lit("1"), F.lit("0"), shadow.value_segment(
        F.lit(1), F.lit("no")), F.col("truth"))
    feeds.start_shadow(counts, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r["window_start"].day: (r["n"], r["labelled"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got and all(n == 24 for n, _ in got.values())
    for d, (_, labelled) in got.items():  # labels of odd ids come 30 hours after their event: too late
        assert labelled == sum(1 for i in range(24 * (d - 1), 24 * d) if i % 6 == 0)


def test_numeric_drift_of_closed_days(spark, tmp_path):
    """Days beside the index worked out bin by bin; NULLs, a constant and an empty column."""
    import math
    from bisect import bisect_left

    base = [(dt.datetime(2024, 1, 1, i % 24), float(i % 50), 7.0, None) for i in range(200)]
    base.append((dt.datetime(2024, 1, 1), None, None, None))
    days = {2: [float(i % 50) for i in range(80)], 3: [40.0 + i % 5 for i in range(60)]}
    feed_rows = [(dt.datetime(2024, 1, d, 3), v, 7.0, None) for d, vs in days.items() for v in vs]
    feed_rows += [(dt.datetime(2024, 1, 2, 4), None, None, None), (dt.datetime(2024, 1, 9), 1.0, 7.0, None)]
    schema = "ts timestamp, a double, b double, c double"
    spark.createDataFrame(feed_rows, schema).coalesce(1).write.parquet(str(tmp_path / "feed"))
    names = ["a", "b", "c"]
    fixed = feeds.store_numeric_baseline(spark.createDataFrame(base, schema), names, str(tmp_path / "base"))
    row = {r["signal"]: r for r in fixed.collect()}
    assert set(row) == {"a", "b"} and sum(row["a"]["n"]) == 200 and row["b"]["n"][0] == 200

    out = str(tmp_path / "out")
    feeds.start_daily_numeric_psi(
        feeds.file_feed(spark, str(tmp_path / "feed"), schema), fixed, "ts", names, out,
        str(tmp_path / "ck")).awaitTermination()
    got = {(r["window_start"].day, r["signal"]): r for r in spark.read.parquet(out).collect()}
    assert set(got) == {(d, s) for d in days for s in "ab"}
    edges = sorted(row["a"]["edges"])
    for day, values in days.items():
        bins = [bisect_left(edges, v) for v in values]
        want = 0.0
        for k, n in enumerate(row["a"]["n"]):
            here = bins.count(k)
            if n or here:
                b, c = max(n / 200, 1e-6), max(here / len(values), 1e-6)
                want += (c - b) * math.log(c / b)
        assert got[day, "a"]["psi"] == pytest.approx(want, abs=1e-9)
        assert got[day, "a"]["rows"] == len(values)
        assert got[day, "a"]["current_mean"] == pytest.approx(sum(values) / len(values))
        assert got[day, "b"]["psi"] == pytest.approx(0.0, abs=1e-12)
    assert got[2, "a"]["status"] == "stable" and got[3, "a"]["status"] == "alert"
