"""Sharding by proportional stratified interleaving, in DataFrame functions only.

The rows of each stratum (a source) are shuffled by a seeded hash and ranked. Row ``r`` of a
stratum of ``n`` gets the fractional rank ``(r + u) / n``, with an offset ``u`` in [0, 1) of
the stratum's own, so that strata of one row don't all meet in the middle. In order of
fractional rank every stretch holds the strata in the proportions of the whole; it is cut
into shards of equal counts (law ``rows``: at most one row apart). A shard's count of a
stratum differs from its share by a few rows at most.

Neither rank needs a window over a stratum or the table. The first cuts a stratum into
ranges of the hash, the second the fractional ranks into equal ranges, both evenly filled by
construction and sized by ``ROWS``. Counts of ranges are added up in two levels, and windows
run inside one range. Rows that are alike in all that the hash sees (one id, one text) can
overfill a range; such a range is dealt out over lanes by the rows' serial numbers. Stratum
sizes are joined with hot strata salted.

Defined results: a NULL text counts as an empty one (size 1, checksum 0). NULL is a stratum of
its own. NULL ids are shuffled by their texts. Rows that repeat get a place each, which of
them gets which is arbitrary. The strata are sources: equal texts are not kept together, as
a group of copies may exceed a shard. An empty table gives an empty result. Only ``doc_id``,
``text``, the stratum's column and the columns asked for by ``keep`` are read; they are
carried in a struct, so their names may clash with any used here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remedia.llm.common import stored, text_of
from remedia.operators.skew import HOT_SHARE, join_unique

SHARDS = 8
SEED = 11
ROWS = 4_096      # rows of a range, about
RANGES = 1_000    # ranges whose counts are added up in one window
LAW = "rows"


def _first_32_bits(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _starts(counts: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``counts`` (``by``, ``order``, ``c``) with ``start``, the sum of ``c`` before a row, in two levels.

    ``order`` begins with a number; ``RANGES`` numbers are a block. One window adds up the
    blocks, another the rows of a block.
    """
    blocks = counts.withColumn("block", F.floor(F.col(order[0]) / RANGES))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*by, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy(*by, "block").agg(F.sum("c").alias("_s")).select(
        *by, "block", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    return blocks.join(sums, [*by, "block"]).select(*by, *order, (
        F.col("_before") + F.coalesce(F.sum("c").over(inside), F.lit(0))).alias("start"))


def rows_of(docs: DataFrame, by: str, keep: list[str], seed: int) -> DataFrame:
    """``kept, size, text_crc32, stratum, key, serial``, stored: the texts are read once."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id"), F.lit("null")), F.lit(":"), F.md5("t")))
    narrow = docs.select(
        F.struct(*[F.col(c) for c in keep]).alias("kept"), text_of().alias("t"), F.col("doc_id").cast("string").alias("id"),
        F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("")).alias("stratum"))
    return stored(narrow.select(
        "kept", (F.octet_length("t") + 1).cast("long").alias("size"), F.crc32(F.encode("t", "UTF-8")).alias("text_crc32"),
        "stratum", digest.alias("key"), F.monotonically_increasing_id().alias("serial")), "shard-rows")


def fractional_ranks(rows: DataFrame, total: int, seed: int) -> DataFrame:
    """``rows`` with ``fraction``: the place of a row in its shuffled stratum, from 0 to 1."""
    strata = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).withColumn("_w", F.col("n"))
    sized = join_unique(rows, strata, "stratum", "_w", F.lit(total), ["serial"]).withColumn(
        "range", F.floor(_first_32_bits(F.col("key")) * F.ceil(F.col("n") / ROWS) / F.lit(2**32)))
    counts = sized.groupBy("stratum", "range").agg(F.count(F.lit(1)).alias("c"))
    # at most 1 / HOT_SHARE ranges hold so large a share: the list may be broadcast
    crowded = F.broadcast(counts.where(F.col("c") > max(4 * ROWS, int(total * HOT_SHARE))).select(
        "stratum", "range", F.ceil(F.col("c") / ROWS).alias("lanes")))
    laned = sized.join(crowded, ["stratum", "range"], "left").withColumn(
        "lane", F.coalesce(F.pmod("serial", "lanes"), F.lit(0))).drop("lanes")
    starts = _starts(laned.groupBy("stratum", "range", "lane").agg(F.count(F.lit(1)).alias("c")),
                     ["stratum"], ["range", "lane"])
    inside = Window.partitionBy("stratum", "range", "lane").orderBy("key", "serial")
    rank = F.col("start") + F.row_number().over(inside) - 1
    offset = _first_32_bits(F.md5(F.concat(F.lit(f"{seed}:"), F.col("stratum")))) / F.lit(2.0**32)
    return laned.join(starts, ["stratum", "range", "lane"]).select(
        *rows.columns, ((rank + offset) / F.col("n")).alias("fraction"))


def interleave(docs: DataFrame, shards: int = SHARDS, by: str = "source", keep: list[str] | None = None,
               seed: int = SEED) -> DataFrame:
    """``kept`` (struct of the columns ``keep``), ``size, text_crc32, fraction, shard, slot``.

    ``shard`` and ``slot`` are the row's place: slots of a shard run from 0 without a gap.
    """
    rows = rows_of(docs, by, keep or ["doc_id"], seed)
    total = rows.count()
    ranges = max(1, -(-total // ROWS))
    placed = stored(fractional_ranks(rows, total, seed), "shard-ranks").withColumn(
        "range", F.least(F.floor(F.col("fraction") * ranges), F.lit(ranges - 1)))
    starts = _starts(placed.groupBy("range").agg(F.count(F.lit(1)).alias("c")), [], ["range"])
    inside = Window.partitionBy("range").orderBy("fraction", "key", "stratum", "serial")
    place = placed.join(starts, "range").withColumn("at", F.col("start") + F.row_number().over(inside) - 1)
    cut = place.withColumn("shard", F.expr(f"CAST(at * {shards}L DIV {max(total, 1)}L AS INT)"))
    return cut.select(
        "kept", "size", "text_crc32", "fraction", "shard",
        F.expr(f"at - (shard * {total}L + {shards - 1}L) DIV {shards}L").alias("slot"))


def write(placed: DataFrame, path: str) -> None:
    """A folder per shard under ``path``, its files in order of slots; for rows whose ``kept`` holds the text."""
    flat = placed.select("kept.*", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    flat.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot").write.partitionBy(
        "_shard").parquet(path)


def assign(docs: DataFrame, shards: int = SHARDS, by: str = "source", seed: int = SEED) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``"""
    return interleave(docs, shards, by, seed=seed).select(
        "kept.doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
