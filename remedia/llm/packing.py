"""Best-fit packing of token sequences with exact complements.

Every document is tokenised, ended by a separator id and cut into pieces of ``size``
tokens at most. Only the number of pieces of each length (``size`` numbers, whatever
the corpus) goes to the driver, where the plan is made: take the longest length left,
look its gap up among the sums of one, two or three available lengths, and use that
combination as often as its lengths last. Where no sum fills the gap exactly, the
piece that fits best goes in and the rest is looked up again. The plan is a list of
patterns with counts; its size depends on ``size`` alone, as each step uses a length up.

Pieces then number themselves within their length, in salted buckets with offsets,
and find their place by binary search in the plan.

Defined results: a NULL or empty text is one piece of the separator alone; NULL ids
stay NULL, repeated rows are packed as documents of their own; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remedia.llm.common import stored, text_of
from remedia.llm.tokens import word_encoder

SIZE = 2048
SEPARATOR = 0


def pieces(docs: DataFrame, path: str, size: int = SIZE, separator: int = SEPARATOR) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    if size < 1:
        raise ValueError("a sequence holds one token at least")
    kind = docs.schema["doc_id"].dataType
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_of().alias("text"))  # digits survive pandas
    end = np.array([separator], "<u4").tobytes()

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = word_encoder(path)
        for frame in frames:
            found = [t.encode("utf-8").split() for t in frame["text"]]
            known = cache.learn(set().union(*found))
            ids = [b"".join([known[w] for w in ws]) + end for ws in found]
            n = np.array([len(x) // 4 for x in ids])
            count = -(-n // size)
            doc = np.repeat(np.arange(len(ids)), count)
            piece = np.arange(len(doc)) - np.repeat(count.cumsum() - count, count)
            start = piece * size
            crc = [zlib.crc32(ids[d][4 * s:4 * (s + size)]) for d, s in zip(doc, start, strict=True)]
            yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy()[doc], "piece": piece.astype("i4"),
                                "start": start, "length": np.minimum(size, n[doc] - start), "ids_crc32": crc})

    return rows.mapInPandas(cut, T.StructType([
        T.StructField("doc_id", T.StringType()), T.StructField("piece", T.IntegerType()),
        *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]])).withColumn(
        "doc_id", F.col("doc_id").cast(kind))


def _filling(left: np.ndarray, gap: int) -> list[int] | None:
    """One, two or three available lengths that sum to the gap, longest first."""
    if left[gap]:
        return [gap]
    have = np.flatnonzero(left[:gap])
    if not len(have):
        return None
    there = left[:gap + 1] > 0

    def pair(total: int, most: int, taken: int = 0) -> list[int] | None:
        own = have[(have <= min(most, total - 1))]
        own = own[2 * own >= total]
        need = total - own
        fits = there[need] & (left[own] > (own == taken)) & (left[need] > (need == own) + 1 * (need == taken))
        hit = own[fits]
        return [int(hit[-1]), int(total - hit[-1])] if len(hit) else None

    if found := pair(gap, gap - 1):
        return found
    for first in have[::-1]:
        if 3 * first < gap:
            return None
        if first <= gap - 2 and (found := pair(gap - int(first), int(first), int(first))):
            lengths = [int(first), *found]
            if all(lengths.count(x) <= left[x] for x in lengths):
                return lengths
    return None


def plan(histogram: np.ndarray, size: int = SIZE) -> list[tuple[list[int], int]]:
    """Patterns of lengths with how many sequences use each. ``histogram[n]``: pieces of length n."""
    left = histogram.astype("i8").copy()
    if left[size]:
        out = [([size], int(left[size]))]
        left[size] = 0
    else:
        out = []
    while (have := np.flatnonzero(left)).size:
        pattern = [int(have[-1])]
        left[pattern[0]] -= 1
        gap = size - pattern[0]
        while gap:
            if filling := _filling(left, gap):
                for x in filling:
                    left[x] -= 1
                pattern += filling
                break
            fits = np.flatnonzero(left[:gap])
            if not fits.size:
                break
            pattern.append(int(fits[-1]))
            left[fits[-1]] -= 1
            gap -= int(fits[-1])
        needs = {x: pattern.count(x) for x in pattern}
        more = min(int(left[x]) // n for x, n in needs.items())
        for x, n in needs.items():
            left[x] -= n * more
        out.append((pattern, more + 1))
    return out


def places(patterns: list[tuple[list[int], int]]) -> pd.DataFrame:
    """Per length, ranges of ranks and the sequence and offset that each range begins at."""
    rows, used, base = [], {}, 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            rank = used.get(length, 0)
            rows.append((length, rank, base, offset))
            used[length] = rank + count
            offset += length
        base += count
    return pd.DataFrame(rows, columns=["length", "rank", "sequence", "offset"]).sort_values(["length", "rank"])


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``. Adds no piece and drops none."""
    spark = cut.sparkSession
    salts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = stored(cut.withColumn("at", F.monotonically_increasing_id()).withColumn(
        "salt", F.pmod(F.xxhash64("at"), F.lit(salts)).cast("int")), "pieces")
    histogram = np.zeros(size + 1, "i8")
    # At most `size` rows.
    for length, n in salted.groupBy("length").count().toLocalIterator():
        histogram[length] = n
    where = places(plan(histogram, size))
    lengths, ranks, sequences, offsets = (where[c].to_numpy() for c in where.columns)

    # The ranges of length n are begins[n]:begins[n + 1].
    begins = np.searchsorted(lengths, np.arange(size + 2))

    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    offset = sizes.select("length", "salt", F.coalesce(F.expr(
        "sum(n) OVER (PARTITION BY length ORDER BY salt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"),
        F.lit(0)).alias("before"))
    ranked = salted.withColumn(
        "rank", F.expr("row_number() OVER (PARTITION BY length, salt ORDER BY at)") - 1
    ).join(offset.withColumnRenamed("salt", "its_salt").withColumnRenamed("length", "its_length"),
           (F.col("length") == F.col("its_length")) & (F.col("salt") == F.col("its_salt"))
           ).withColumn("rank", F.col("rank") + F.col("before"))

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = np.empty(len(frame), "i8")
            length, rank = frame["length"].to_numpy(), frame["rank"].to_numpy()
            for n in np.unique(length):
                mine = length == n
                low, high = begins[n], begins[n + 1]
                at[mine] = low + np.searchsorted(ranks[low:high], rank[mine], "right") - 1
            yield frame.drop(columns="rank").assign(
                sequence_id=sequences[at] + rank - ranks[at], offset=offsets[at])

    kind = cut.schema["doc_id"].dataType
    texts = ranked.withColumn("doc_id", F.col("doc_id").cast("string")).select(*cut.columns, "rank")
    fields = [*texts.schema.fields[:-1], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return texts.mapInPandas(put, T.StructType(fields)).withColumn("doc_id", F.col("doc_id").cast(kind))


def best_fit(docs: DataFrame, path: str, size: int = SIZE, separator: int = SEPARATOR) -> DataFrame:
    return pack(pieces(docs, path, size, separator), size)
