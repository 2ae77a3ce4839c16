"""Joins and ranks that hold when one key owns a large share of the rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remedia.session import stored

HOT_SHARE = 0.001  # a key with this share of the rows is hot; at most 1 / HOT_SHARE exist
SALTS = 64
SAMPLE = 64  # keys sampled per bucket


def join_unique(
    fact: DataFrame, lookup: DataFrame, on: str, weight: str, total: Column,
    spread: list[str], salts: int = SALTS, share: float = HOT_SHARE,
) -> DataFrame:
    """Left join ``fact`` to ``lookup``, which is unique in ``on``.

    ``weight`` is the number of fact rows a key has and ``total`` the number of
    all fact rows. Hot keys (at most ``1 / share`` of them, so their list may be
    broadcast) are replicated ``salts`` times in the lookup, and their fact rows
    spread over the copies by a hash of the ``spread`` columns: no task gets the
    whole of a hot key, and a retried task salts its rows the same way.
    """
    marked = lookup.withColumn("_total", total).withColumn(
        "_hot", F.col(weight) > F.greatest(F.col("_total") * share, F.lit(1.0))).drop("_total")
    hot = F.broadcast(marked.where("_hot").select(on, F.lit(True).alias("_is_hot")))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.lit(salts)).cast("int")
    salted_fact = fact.join(hot, on, "left").withColumn(
        "_salt", F.when(F.col("_is_hot"), salt).otherwise(F.lit(0))).drop("_is_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
        F.array(F.lit(0)))
    salted_lookup = marked.withColumn("_salt", F.explode(copies)).drop("_hot", weight)
    return salted_fact.join(salted_lookup, [on, "_salt"], "left").drop("_salt")


def range_buckets(df: DataFrame) -> int:
    """Key ranges for a global order: the session's shuffle partitions, up to the next square."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2, math.isqrt(partitions - 1) + 1) ** 2


def _bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """Add ``_bucket``: the place of a row's key among sampled cut points.

    The cut points come from a bounded sample (``SAMPLE`` keys a bucket, chosen by
    hash so that every evaluation picks the same ones) through a scalar subquery.
    """
    key = F.struct(*keys)
    picked = (
        df.select(key.alias("_k")).orderBy(F.xxhash64("_k"), "_k").limit(SAMPLE * buckets)
        .agg(F.array_sort(F.collect_list("_k")).alias("_s"))
        .select(F.transform(
            F.sequence(F.lit(1), F.lit(buckets - 1)),
            lambda i: F.try_element_at(
                F.col("_s"),
                (F.floor(i * F.size("_s") / F.lit(float(buckets))) + 1).cast("int"))
        ).alias("_cuts")))
    # two short passes over the cuts: every `side`-th one, then those in between
    side = int(buckets ** 0.5)
    below = lambda cuts: F.size(F.filter(cuts, lambda c: c <= key))
    coarse = F.transform(
        F.sequence(F.lit(1), F.lit(side - 1)),
        lambda i: F.try_element_at(F.col("_cuts"), (i * side).cast("int")))
    return (
        df.withColumn("_cuts", picked.select(
            "_cuts", coarse.alias("_coarse")).select(F.struct("_cuts", "_coarse")).scalar())
        .withColumn("_step", below(F.col("_cuts._coarse")))
        .withColumn("_bucket", F.col("_step") * side + below(
            F.slice(F.col("_cuts._cuts"), F.col("_step") * side + 1, F.lit(side - 1))))
        .drop("_cuts", "_step"))


def running_total(
    df: DataFrame, keys: list[str], weight: str, out: str = "before",
    by: list[str] | None = None,
) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over rows whose ``keys`` sort before this row's.

    The exact global prefix sum without a window over the whole table: rows are
    put into key-range buckets, bucket totals (at most one per bucket and
    group of ``by``) are accumulated, and the window runs inside one bucket. Keys must be
    unique within ``by``, which a prior ``groupBy`` gives: equal keys, however
    many, are then one row, so no value can overfill a bucket. The input is stored,
    so it is computed once for the sample, the totals and the placing.
    """
    by = by or []
    placed = _bucketed(stored(df, "ranked"), by + keys, range_buckets(df))
    group = [*by, "_bucket"]
    totals = placed.groupBy(*group).agg(F.sum(weight).alias("_t"))
    before = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(
        "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*group).orderBy(*keys).rowsBetween(
        Window.unboundedPreceding, -1)
    return (
        placed.join(F.broadcast(offsets), group)
        .withColumn(out, F.col("_offset") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .drop("_bucket", "_offset"))


def value_counts(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*(by or []), value).agg(
        F.count(F.lit(1)).alias("n"))


def order_statistics(
    df: DataFrame, value: str, positions: Column, by: list[str] | None = None,
) -> DataFrame:
    """Values at 0-based sorted ``positions`` (an array Column over ``_n``, the row count).

    Exact at any size: distinct values are counted first, then located through
    ``running_total``. Returns ``by..., pos_index, value``.
    """
    by = by or []
    counts = stored(value_counts(df, value, by), "counts")
    placed = running_total(counts, [value], "n", by=by)
    if by:
        sizes = counts.groupBy(*by).agg(F.sum("n").alias("_n"))
        placed = placed.join(sizes, by)
    else:
        placed = placed.withColumn("_n", counts.agg(F.sum("n")).scalar())
    hits = placed.select(*by, F.col(value).alias("value"), "before", "n",
                         F.posexplode(positions).alias("pos_index", "_pos"))
    return hits.where(
        (F.col("_pos") >= F.col("before")) & (F.col("_pos") < F.col("before") + F.col("n"))
    ).select(*by, "pos_index", "value")
