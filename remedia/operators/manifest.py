"""Content manifest of datasets: what exactly a model or a report was built from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def track_files(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """``name, path, md5, size_bytes, rows`` per file; hashed where the file is read.

    ``rows`` counts the lines of ``.csv`` and ``.jsonl`` files and is NULL for
    others. A file is one value of the binary source, so this suits tracked
    extracts and documents; a table is tracked with ``track_table``.
    """
    out = None
    for name, path in files.items():
        raw = spark.read.format("binaryFile").load(path)
        text = F.decode(F.col("content"), "ISO-8859-1")
        lines = F.length(text) - F.length(F.replace(text, F.lit("\n")))
        part = raw.select(
            F.lit(name).alias("name"), F.lit(path).alias("path"),
            F.md5("content").alias("md5"), F.col("length").alias("size_bytes"),
            F.when(F.lit(path.endswith((".csv", ".jsonl"))), lines).cast("long").alias("rows"))
        out = part if out is None else out.unionByName(part)
    return out


def track_table(df: DataFrame, name: str, path: str = "") -> DataFrame:
    """The same entry for a table, whatever its files and row order.

    The digest is of the row count and two order-free sums of row hashes, so it
    is one map-side combined aggregate and changes with any value.
    """
    columns = [F.col(c) for c in sorted(df.columns)]
    low = F.xxhash64(*columns).cast("decimal(20,0)")
    high = F.xxhash64(F.lit("second"), *columns).cast("decimal(20,0)")
    sums = df.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(low).alias("_a"), F.sum(high).alias("_b"))
    return sums.select(
        F.lit(name).alias("name"), F.lit(path).alias("path"),
        F.md5(F.concat_ws(":", F.col("rows").cast("string"), F.coalesce(
            F.col("_a").cast("string"), F.lit("0")), F.coalesce(
            F.col("_b").cast("string"), F.lit("0")))).alias("md5"),
        F.lit(None).cast("long").alias("size_bytes"), "rows")


def table_summary(df: DataFrame, name: str) -> DataFrame:
    """Row count and order-free sums of every numeric column, for comparing engines."""
    numeric = [c for c, t in df.dtypes if t in ("bigint", "int", "double", "float")]
    return df.agg(F.count(F.lit(1)).alias("rows"), *[
        F.round(F.sum(F.col(c).cast("double")), 2).alias(c) for c in numeric]).withColumn(
        "name", F.lit(name))


def fingerprint(manifest: DataFrame) -> DataFrame:
    """One hash over the names and digests, in name order: 16 hex digits.

    The hashed text is the entries as a JSON object with sorted keys. A manifest
    has one row per dataset, so the list is short.
    """
    entry = F.concat(F.lit('"'), "name", F.lit('": "'), "md5", F.lit('"'))
    listed = F.array_sort(F.collect_list(F.struct("name", entry.alias("e"))))
    body = F.concat(F.lit("{"), F.array_join(F.transform(listed, lambda x: x["e"]), ", "),
                    F.lit("}"))
    return manifest.agg(F.substring(F.sha2(body, 256), 1, 16).alias("fingerprint"))


def verify(stored: DataFrame, actual: DataFrame) -> DataFrame:
    """``name, state`` (clean, changed, missing, untracked) with the size difference."""
    s = stored.select("name", F.col("md5").alias("expected"), F.col("size_bytes").alias("_old"))
    a = actual.select("name", F.col("md5").alias("actual"), F.col("size_bytes").alias("_new"))
    joined = s.join(a, "name", "full_outer")
    return joined.select(
        "name", "expected", "actual", (F.col("_new") - F.col("_old")).alias("size_delta"),
        F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "untracked")
        .when(F.col("actual").eqNullSafe(F.col("expected")), "clean")
        .otherwise("changed").alias("state"))


def is_clean(checked: DataFrame) -> DataFrame:
    return checked.agg(
        F.count_if(F.col("state") != "untracked").alias("tracked"),
        F.count_if(F.col("state") == "changed").alias("changed"),
        F.count_if(F.col("state") == "missing").alias("missing"),
        (F.count_if(F.col("state").isin("changed", "missing")) == 0).alias("clean"))
