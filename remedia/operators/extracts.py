"""Silver by extracts: a new extract is deduplicated against the ids of those before it.

The ids that a valid row has claimed are kept in a table bucketed by id. A new extract is
reduced to one row an id and joined with that table bucket by bucket, so the stored side is
not shuffled and no row of an old extract is read again. Loading extracts one after the other
gives the rows of one load over all of them, in the order of the extracts.

An id is claimed with the number of its extract, and only smaller numbers count against it:
an extract that is loaded again after a failure, in whole or in part, gives the same rows.

Defined results: a row whose id is NULL is no repeat and claims nothing; a row that is itself
not valid claims nothing; every later row of a claimed id is a repeat, valid or not; an empty
extract gives two empty tables; columns other than the id and the ordinal are carried.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from remedia.operators.layers import REASON
from remedia.operators.skew import join_unique
from remedia.session import scratch_path, stored

BUCKETS = 64  # chosen once for a table: some 100 MB of ids a bucket at its expected size


class ClaimedIds:
    """The ids of all extracts so far: ``_key, extract``, bucketed by id. Grows by appends."""

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None,
                 buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.name = name or f"claimed_{uuid.uuid4().hex}"
        self.path = path or scratch_path(spark, "claimed-ids")

    def before(self, extract: int) -> DataFrame | None:
        """``_key`` of every id claimed by an earlier extract, once; stays in its buckets."""
        if not self.spark.catalog.tableExists(self.name):
            return None
        return self.spark.table(self.name).where(F.col("extract") < extract).groupBy("_key").agg(
            F.lit(True).alias("_claimed"))

    def add(self, keys: DataFrame, extract: int) -> None:
        keys.select("_key", F.lit(extract).alias("extract")).repartition(self.buckets, "_key").write.mode(
            "append").bucketBy(self.buckets, "_key").sortBy("_key").option("path", self.path).saveAsTable(self.name)


def firsts_of(parsed: DataFrame, ordinal: list[str], valid: Column, ids: ClaimedIds, extract: int) -> DataFrame:
    """``_key, _n, _ok, _first, _claimed``: one row an id of the extract, combined in the tasks.

    ``_ok`` says whether a valid row has the id; ``_first``, the place of the first one, is kept
    where the id repeats, as nothing else asks for it. These rows are dealt into the table's number of buckets, whatever the session's number of
    shuffle partitions: otherwise the optimiser may deal both sides anew.
    """
    claimed = ids.before(extract)
    found = parsed.where(F.col("_key").isNotNull()).withColumn("_valid", valid).groupBy("_key").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.when(F.col("_valid"), F.struct(*ordinal))).alias("_first"))
    found = found.select("_key", "_n", F.col("_first").isNotNull().alias("_ok"), F.when(F.col("_n") > 1, F.col("_first")).alias("_first"))
    if claimed is None:
        return found.withColumn("_claimed", F.lit(False))
    return found.repartition(ids.buckets, "_key").join(claimed.hint("merge"), "_key", "left").withColumn(
        "_claimed", F.coalesce("_claimed", F.lit(False)))


def judge_extract(parsed: DataFrame, ids: ClaimedIds, extract: int, ordinal: list[str],
                  duplicate_reason: str) -> DataFrame:
    """The rows of a parsed extract (``_key, _typed, _error``) with a reason, NULL where they are kept.

    Claims the extract's new ids. What decides is stored, so the reasons don't change with it; the
    rows are not: only columns that are asked for are moved to find them.
    """
    # the few columns that decide are small beside the rows; they are read once for both uses
    facts = stored(firsts_of(parsed, ordinal, F.col("_error").isNull(), ids, extract), "firsts")
    total = facts.agg(F.coalesce(F.sum("_n"), F.lit(0))).scalar()
    lookup = facts.where("_n > 1 OR _claimed").select("_key", "_n", "_first", "_claimed")
    marked = join_unique(parsed, lookup, "_key", "_n", total, ordinal)
    repeat = F.coalesce(F.col("_claimed") | F.coalesce(F.struct(*ordinal) > F.col("_first"), F.lit(False)), F.lit(False))
    ids.add(facts.where("NOT _claimed AND _ok"), extract)
    return marked.withColumn(REASON, F.when(repeat, F.lit(duplicate_reason)).otherwise(F.col("_error")))


def load_extract(parsed: DataFrame, ids: ClaimedIds, extract: int, ordinal: list[str],
                 duplicate_reason: str, raw_columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(clean typed rows, quarantined raw rows) of ``judge_extract``, stored once for both."""
    judged = stored(judge_extract(parsed, ids, extract, ordinal, duplicate_reason).select(
        *raw_columns, "_typed", REASON), "extract")
    return (judged.where(F.col(REASON).isNull()).select("_typed.*"),
            judged.where(F.col(REASON).isNotNull()).select(*raw_columns, REASON))
