"""Drift, shadow, metrics, curriculum and gates on small exact fixtures."""

import random

from pyspark.sql import functions as F

from remedia.operators import curriculum, drift, metrics, shadow


def test_psi_of_a_table_with_itself_is_zero(spark):
    df = spark.createDataFrame([(c,) for c in "a" * 50 + "b" * 30 + "c" * 20], "k string")
    row = drift.psi(drift.contributions(drift.frequencies(df, df, ["k"]))).first()
    assert row["psi"] == 0 and row["status"] == "stable"


def test_bins_come_from_the_baseline_only(spark):
    base = spark.createDataFrame([(float(i),) for i in range(100)], "v double")
    moved = spark.createDataFrame([(float(i),) for i in range(500, 600)], "v double")
    assert drift.baseline_edges(base, ["v"]).first()["edges"] == [
        float(10 * i) for i in range(1, 10)]
    found = drift.signals(base, moved, numeric=["v"]).first()
    assert found["value"] > 1 and found["status"] == "alert"


def test_a_moved_outcome_is_concept_drift(spark):
    base = spark.createDataFrame([("x", "won")] * 90 + [("x", "lost")] * 10, "k string, y string")
    curr = spark.createDataFrame([("x", "won")] * 40 + [("x", "lost")] * 60, "k string, y string")
    row = drift.roll_up(drift.signals(base, curr, ["k"], label="y")).first()
    assert row["concept_drift_detected"] and row["overall_status"] == "alert"
    assert row["action"] == drift.ACTIONS["concept"]


def test_empty_side(spark):
    df = spark.createDataFrame([("a",)], "k string")
    row = drift.psi(drift.contributions(drift.frequencies(df, df.limit(0), ["k"]))).first()
    assert row["psi"] > 1


def test_shadow_reports_segments_first(spark):
    rows = [(f"s{i}", "x", "y", "standard", "y") for i in range(4)]
    rows.append(("h", "x", "y", "high_value", "x"))
    df = spark.createDataFrame(rows, "key string, i string, c string, s string, o string")
    recs = shadow.records(df, "key", F.col("i"), F.col("c"), F.col("s"), F.col("o"))
    row = shadow.report(recs).first()
    assert row["contested"] == 5 and row["candidate_correct"] == 4
    assert row["high_value_segments_with_disagreement"] == ["high_value"]
    assert row["recommendation"] == shadow.PROMOTE_AFTER_REVIEW
    none = shadow.report(recs.limit(0)).first()
    assert none["recommendation"] == shadow.KEEP_IN_SHADOW


def test_ranking_metrics_match_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, int(rng.random() < 0.1), rng.choice([0.5, round(rng.random(), 2)]))
            for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, label int, score double")
    pos = [s for _, y, s in rows if y]
    neg = [s for _, y, s in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(metrics.roc_auc(df).first()["roc_auc"] - auc) < 1e-9
    for budget in (0.02, 0.5):  # the second cut falls inside the large tie
        k = max(1, round(len(rows) * budget))
        top = sorted(rows, key=lambda r: (-r[2], r[0]))[:k]
        got = metrics.recall_at_budget(df, budget=budget).first()
        assert got["alerts"] == k and got["caught"] == sum(y for _, y, _ in top)


def test_classification_summary(spark):
    df = spark.createDataFrame(
        [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("c", "a")],
        "label string, prediction string")
    row = metrics.classification_summary(df).first()
    f1 = (2 * .75 * .75 / 1.5 + 2 * (2 / 3) / (5 / 3)) / 3
    assert abs(row["macro_f1"] - f1) < 1e-12
    assert abs(row["balanced_accuracy"] - (0.75 + 1 + 0) / 3) < 1e-12
    assert row["accuracy"] == row["micro_f1"] == 5 / 7


def test_remainder_makes_one_bucket_more(spark):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(9)],
                               "example_id int, difficulty double")
    got = curriculum.curriculum_buckets(df).collect()
    assert sorted(r["rank"] for r in got) == list(range(9))
    assert len({r["bucket"] for r in got}) == 9


def test_gates_skip_what_was_not_measured(spark):
    df = spark.createDataFrame([("deadline_exactness", 1.0), ("rag_recall_at_k", 0.5)],
                               "name string, actual double")
    got = {r["gate"]: r["status"] for r in metrics.promotion_gates(
        df, invented_dates=F.lit(2)).collect()}
    assert got["deadline_exactness"] == "pass" and got["rag_recall_at_k"] == "FAIL"
    assert got["issue_macro_f1"] == "skipped" and got["no_invented_dates"] == "FAIL"
    assert "no_invented_dates" not in [r["gate"] for r in metrics.promotion_gates(
        df, invented_dates=F.lit(0)).collect()]
