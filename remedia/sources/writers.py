"""Sinks. Order, where it matters, is made at the write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remedia.operators.layers import union_quarantines


def write_sorted(
    df: DataFrame, path: str, keys: list, fmt: str = "parquet", mode: str = "overwrite",
    partition_by: list[str] | None = None,
) -> None:
    """Range-partition by the sort keys, then sort each part: a total order over the files."""
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    writer = ordered.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).save(path)


def write_json_lines(df: DataFrame, path: str, keys: list | None = None) -> None:
    if keys:
        write_sorted(df, path, keys, "json")
    else:
        df.write.mode("overwrite").json(path)


def write_gold(df: DataFrame, path: str, keys: list[str]) -> None:
    """Parquet, one folder per fold, each sorted."""
    write_sorted(df, path, ["split", *keys], partition_by=["split"])


def write_quarantine(path: str, *parts: DataFrame) -> bool:
    """All quarantined rows together; nothing is written when there are none."""
    both = union_quarantines(*parts)
    if both.isEmpty():
        return False
    both.write.mode("overwrite").json(path)
    return True


def shuffled(id_column: str, seed: int) -> Column:
    """A seeded order: the same for the same ids and seed, whatever the partitioning."""
    return F.xxhash64(F.col(id_column), F.lit(seed))


def write_examples(
    df: DataFrame, path: str, id_column: str = "example_id", curriculum: bool = True,
    seed: int = 0,
) -> None:
    """Training examples, easy first or in a seeded random order."""
    if curriculum:
        write_sorted(df, path, ["difficulty", id_column], "json")
    else:
        write_sorted(df, path, [shuffled(id_column, seed), F.col(id_column)], "json")


def write_report(df: DataFrame, path: str, limit: int | None = None, order=None) -> None:
    """A report as JSON; ``limit`` keeps the first rows of an explicit order."""
    if limit is not None:
        df = df.orderBy(*order).limit(limit)
    df.write.mode("overwrite").json(path)
