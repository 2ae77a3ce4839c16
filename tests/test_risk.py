"""The risk model's search: inputs derived once, the same recall as the whole report."""

from pyspark.sql import functions as F

from remedia.catalog import live
from remedia.operators import models


def test_search_derives_its_rows_once(spark, sf_dir, monkeypatch):
    calls, fitted = spark.sparkContext.accumulator(0), []

    def counted(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    rows = live.risk_rows(spark, sf_dir)
    monkeypatch.setattr(live, "risk_rows", lambda *_: rows.mapInArrow(counted, rows.schema))
    fit = models.fit_risk
    monkeypatch.setattr(models, "fit_risk", lambda train, *a: fitted.append(train) or fit(train, *a))
    assert live.fraud_search(spark, sf_dir).count() == 3 and len(fitted) == 3
    assert calls.value <= rows.count()


def test_recall_is_that_of_the_report_and_weights_leave_out_unlabelled(spark):
    rows = spark.range(300).select(
        "id", (F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"),
        F.when(F.col("id") % 50 != 7, (F.col("id") % 17 > 12).cast("int")).alias("label"))
    model = models.fit_risk(rows, ["x", "y"], "label", 1.0, True, 20)
    before = models.class_weights(rows, "label", True)
    assert before.count() == rows.where("label IS NOT NULL").count()
    known = rows.where("label IS NOT NULL")
    report = models.risk_report(model, known, "label", "id").first()
    assert models.risk_recall(model, known, "label", "id") == report["recall"] > 0
