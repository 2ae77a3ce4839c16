"""Business-day arithmetic in closed form: no calendar table, no join, no pass over the dates.

Weekdays are counted by arithmetic and holidays by a short list for the years at hand
(``functions.dates``), so every date from year 1 to 9999 is served, in batch and in streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from remedia.functions.dates import (
    business_day_at,
    business_days_after,
    business_index,
    holidays_ahead,
    is_business_day,
    is_federal_holiday,
)


def place(day: Column, since: str = "0001-01-01") -> list[Column]:
    """``is_holiday, is_business_day, idx`` of a day; ``idx`` counts the business days from ``since``."""
    before = business_index(F.date_sub(F.to_date(F.lit(since)), 1)) if since > "0001-01-01" else F.lit(0)
    return [is_federal_holiday(day).alias("is_holiday"), is_business_day(day).alias("is_business_day"),
            (business_index(day) - before).alias("idx")]


def business_calendar(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """``day, is_holiday, is_business_day, idx`` of every day of these years; ``idx`` counts from the first."""
    if last_year < first_year:
        raise ValueError("the last year comes before the first")
    start = F.make_date(F.lit(first_year), F.lit(1), F.lit(1))
    days = spark.range((last_year - first_year + 1) * 366).select(
        F.date_add(start, F.col("id").cast("int")).alias("day")).where(F.year("day") <= last_year)
    return days.select("day", *place(F.col("day"), f"{first_year:04d}-01-01"))


def add_business_days(df: DataFrame, start: str, n: str, out: str) -> DataFrame:
    """``n`` business days after ``start`` (before it when negative, ``start`` itself for 0).

    A positive step lands on the business day with index ``idx(start) + n``; a negative
    one on index ``idx(start) - is_business_day(start) + n + 1``.
    """
    day = F.col(start)
    index = business_index(day) + F.col(n)
    target = F.when(F.col(n) > 0, index).otherwise(index - is_business_day(day).cast("int") + 1)
    placed = df.withColumn("_target", target)
    return placed.withColumn(
        out, F.when(F.col(n) == 0, day).otherwise(business_day_at(F.col("_target")))).drop("_target")


def business_days_between(df: DataFrame, start: str, end: str, out: str) -> DataFrame:
    """Business days after ``start`` up to and including ``end``; antisymmetric."""
    return df.withColumn(out, business_index(F.col(end)) - business_index(F.col(start)))


def next_business_day(df: DataFrame, start: str, out: str) -> DataFrame:
    return look_ahead(df, F.col(start), "_nbd").withColumn(out, nth_ahead("_nbd", 1)).drop("_nbd_ahead")


def look_ahead(df: DataFrame, anchor: Column, prefix: str) -> DataFrame:
    """Add ``{prefix}_ahead`` for an anchor date: what its business-day periods are counted with.

    The one-element ``explode`` keeps the optimiser from writing the whole expression out at
    every use, which a filter on a letter far above would do hundreds of times.
    """
    ahead = F.when(anchor.isNotNull(), holidays_ahead(anchor))
    return df.select("*", F.explode_outer(F.array(ahead)).alias(f"{prefix}_ahead"))


def nth_ahead(prefix: str, n: int | Column) -> Column:
    """The ``n``-th business day after the anchor, for ``n`` up to 240."""
    return business_days_after(F.col(f"{prefix}_ahead"), n)
