"""Raw files to bronze, silver and gold, with contracts at every boundary."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remedia import policy
from remedia.operators import contracts, layers, manifest
from remedia.sources import readers, writers


class Build(NamedTuple):
    layers: dict[str, layers.Layer]
    splits: DataFrame
    manifest: DataFrame | None


def build(
    spark: SparkSession, complaints: str, fraud: str, out: str | None = None,
    strict: bool = True, minimum: int = 1000, split_dates=policy.COMPLAINT_SPLIT_DATES,
    split_months=policy.FRAUD_SPLIT_MONTHS, multiline: bool = True,
) -> Build:
    """Build all layers; with ``out``, write them and the manifest.

    Silver is written, sorted, before its contract is checked and gold is made
    from it, so each raw file is parsed once. A strict build stops at the first
    layer that fails a blocking expectation.
    """
    def check(layer: layers.Layer) -> layers.Layer:
        if strict:
            contracts.enforce(layer.name, layer.report)
        return layer

    raw_c = readers.read_csv(spark, complaints, readers.COMPLAINT_COLUMNS, multiline)
    raw_f = readers.read_csv(spark, fraud, readers.FRAUD_COLUMNS, multiline)
    done = {}
    for layer in (layers.bronze_complaints(raw_c, minimum), layers.bronze_fraud(raw_f, minimum)):
        done[layer.name] = check(layer)
    silver_c = layers.silver_complaints(raw_c, readers.ORDINAL)
    silver_f = layers.silver_fraud(raw_f, readers.ORDINAL)
    if out:
        silver_c = _stored(spark, silver_c, f"{out}/silver/complaints",
                           ["date_received", "complaint_id"], layers.complaint_contract)
        silver_f = _stored(spark, silver_f, f"{out}/silver/fraud",
                           ["month", "application_id"], layers.fraud_contract)
        writers.write_quarantine(
            f"{out}/silver/quarantine", silver_c.quarantine, silver_f.quarantine)
    for layer in (silver_c, silver_f):
        done[layer.name] = check(layer)
    gold_c = layers.gold_complaints(silver_c, split_dates)
    gold_f = layers.gold_fraud(silver_f, split_months)
    for layer in (gold_c, gold_f):
        done[layer.name] = check(layer)
    splits = layers.counts(gold_c.rows, "split").withColumn("feed", F.lit("complaints")).unionByName(
        layers.counts(gold_f.rows, "split").withColumn("feed", F.lit("fraud")))
    tracked = None
    if out:
        writers.write_gold(gold_c.rows, f"{out}/gold/complaints", ["date_received", "complaint_id"])
        writers.write_gold(gold_f.rows, f"{out}/gold/fraud", ["month", "application_id"])
        tables = {n: spark.read.parquet(f"{out}/{n}") for n in (
            "silver/complaints", "silver/fraud", "gold/complaints", "gold/fraud")}
        for name, df in tables.items():
            entry = manifest.track_table(df, name, f"{out}/{name}")
            tracked = entry if tracked is None else tracked.unionByName(entry)
        tracked.write.mode("overwrite").parquet(f"{out}/manifest")
        tracked = spark.read.parquet(f"{out}/manifest")
    return Build(done, splits, tracked)


def _stored(spark, layer, path, keys, contract) -> layers.Layer:
    writers.write_sorted(layer.rows, path, keys)
    rows = spark.read.parquet(path)
    placed = readers.with_row_index(rows)
    return layer._replace(rows=rows, report=contract(placed, ["_file", "_index"]))


def summary(built: Build) -> DataFrame:
    """One row per layer: checks made and checks failed."""
    out = None
    for name, layer in built.layers.items():
        part = layer.report.agg(
            F.count(F.lit(1)).alias("checks"), F.count_if(~F.col("passed")).alias("failed"),
            F.count_if(~F.col("passed") & (F.col("severity") == "error")).alias("blocking"),
        ).withColumn("layer", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
