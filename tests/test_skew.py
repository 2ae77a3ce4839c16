"""Skew helpers against brute force, with one key owning a third of the rows."""

import random

from pyspark.sql import functions as F

from remedia.operators import skew


def test_running_total_matches_sorting(spark):
    rng = random.Random(3)
    values = [rng.choice([7.0, rng.random() * 100]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r["v"]: r["before"] for r in skew.running_total(
        skew.value_counts(df, "v"), ["v"], "n").collect()}
    for v in set(values):
        assert got[v] == sum(x < v for x in values)


def test_running_total_by_group_and_composite_key(spark):
    rows = [(g, i % 5, i) for g in ("a", "b") for i in range(200)]
    df = spark.createDataFrame(rows, "g string, d int, id int").withColumn("w", F.lit(1))
    got = skew.running_total(df, ["d", "id"], "w", by=["g"]).collect()
    for g in ("a", "b"):
        ordered = sorted((d, i) for gg, d, i in rows if gg == g)
        rank = {r["id"]: r["before"] for r in got if r["g"] == g}
        assert [rank[i] for _, i in ordered] == list(range(200))


def test_order_statistics(spark):
    values = [float(i % 37) for i in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r["pos_index"]: r["value"] for r in skew.order_statistics(
        df, "v", F.array(F.lit(0), F.expr("_n div 2"), F.col("_n") - 1)).collect()}
    ordered = sorted(values)
    assert got == {0: ordered[0], 1: ordered[500], 2: ordered[-1]}


def test_join_unique_splits_the_hot_key(spark):
    rows = [("hot" if i % 3 == 0 else f"k{i % 50}", i) for i in range(3000)]
    fact = spark.createDataFrame(rows, "k string, i int")
    lookup = fact.groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    got = skew.join_unique(fact, lookup, "k", "n", F.lit(3000), ["i"]).collect()
    first = {}
    for k, i in rows:
        first.setdefault(k, i)
    assert len(got) == 3000 and all(r["first"] == first[r["k"]] for r in got)
