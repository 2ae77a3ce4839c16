"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of (line hash, number of documents) sorted by hash. A batch adds
one run to level 0; as soon as a level holds ``fanout`` runs they are merged into
one run of the next level, so a corpus of n batches keeps O(fanout * log n) runs
and rewrites each hash O(log n) times. A batch is judged by a merge anti-join of
its lines against the runs.

A whole table goes the same way: its texts are read once and cut into batches of line
hashes; each batch adds its run and is merge-anti-joined with the lines that some run
alone knows as frequent (these are stored apart in each run, so no run is read whole for
it). What is left of all batches is anti-joined once more, with the sums over all runs,
for lines that became frequent later or only across runs.

Hot lines: the ``HEAVIEST`` lines by documents are dropped by a broadcast of so many hashes;
any other line has at most one in ``HEAVIEST`` of all (document, line) rows.

Defined results: a NULL or empty text is one empty line, which is never dropped;
a NULL or repeated ``doc_id`` is a document of its own, rows that repeat count as
several documents; a text of any length is one row a different line; a line found in
exactly ``min_docs`` documents goes; an empty table gives an empty result; other
columns are not read by the operator.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remedia.llm.common import SPACE, add_columns, row_hash, stored, text_of
from remedia.session import scratch_path

FANOUT = 2
BATCH_BYTES = 128 * 1024 * 1024
MOST_BATCHES = 64   # a larger table has larger batches
HEAVIEST = 4096
HASH = ["h1", "h2"]
RUN = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()),
                    T.StructField("docs", T.LongType())])
LINES = T.StructType([T.StructField(c, T.LongType()) for c in ("_k0", "_k1", *HASH)]).add(
    "places", T.ArrayType(T.IntegerType())).add("batch", T.IntegerType())


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document and different line: 128 bits of its key, and its places."""
    for rows in batches:
        owner, digests, places, ends = [], [], [], [0]
        for i, text in enumerate(rows.column("_text").to_pylist()):
            found: dict[bytes, list[int]] = {}
            for at, line in enumerate(text.split("\n")):
                key = line.strip(SPACE)
                if key:
                    found.setdefault(key.encode("utf-8").lower(), []).append(at)
            for key, at in found.items():
                owner.append(i)
                digests.append(xxhash.xxh3_128_digest(key))
                places += at
                ends.append(len(places))
        mine = pa.array(owner, pa.int64())
        halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [rows.column("_k0").take(mine), rows.column("_k1").take(mine), pa.array(halves[:, 0].copy()),
             pa.array(halves[:, 1].copy()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32())),
             rows.column("batch").take(mine)], names=LINES.names)


def hashed_lines(docs: DataFrame, batches: int = 1) -> DataFrame:
    """``_k0, _k1`` (a document's key), ``h1, h2, places, batch``; blank lines have no row."""
    return docs.select(
        F.coalesce("doc_id", F.lit(0)).alias("_k0"), row_hash("doc_id", "text").alias("_k1"),
        text_of().alias("_text"),
        F.pmod(row_hash("doc_id", "text"), F.lit(batches)).cast("int").alias("batch")).mapInArrow(_split, LINES)


def line_counts(lines: DataFrame) -> DataFrame:
    """Number of documents per line hash; hot lines are summed in the tasks first."""
    return lines.groupBy(*HASH).agg(F.count(F.lit(1)).alias("docs"))


def _without(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """Merge anti-join with ``keys`` (h1, h2, docs); the heaviest ones go before the shuffle."""
    heaviest = keys.orderBy(F.desc("docs"), *HASH).limit(HEAVIEST).select(*HASH)
    return lines.join(F.broadcast(heaviest), HASH, "left_anti").join(
        keys.select(*HASH).hint("merge"), HASH, "left_anti")


def _union(tables: list[DataFrame]) -> DataFrame:
    every = tables[0]
    for one in tables[1:]:
        every = every.unionByName(one)
    return every


class LineRuns:
    """The runs of a corpus, by level. Rows of ``min_docs`` and more lie apart in each run."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, min_docs: int = 2):
        if fanout < 2:
            raise ValueError("a level is merged from two runs at least")
        self.spark, self.fanout, self.min_docs = spark, fanout, min_docs
        self.levels: list[list[DataFrame]] = []

    def _write(self, counts: DataFrame, level: int) -> None:
        ordered = counts.select(*HASH, "docs", (F.col("docs") >= self.min_docs).alias("often"))
        path = scratch_path(self.spark, f"line-run-{level}")
        ordered.sortWithinPartitions("often", *HASH).write.partitionBy("often").parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self.spark.read.schema(ordered.schema).parquet(path))
        if len(self.levels[level]) == self.fanout:
            merged = self._merged(self.levels[level])
            self.levels[level] = []
            self._write(merged, level + 1)

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        return _union(runs).groupBy(*HASH).agg(F.sum("docs").alias("docs"))

    def add(self, counts: DataFrame) -> None:
        """A run of (h1, h2, docs), one row per hash."""
        self._write(counts, 0)

    def counts(self) -> DataFrame:
        runs = [run for level in self.levels for run in level]
        return self._merged(runs) if runs else self.spark.createDataFrame([], RUN)

    def known(self) -> DataFrame:
        """The lines that a run alone shows to be in ``min_docs`` documents; one may come from several runs."""
        runs = [run.where("often").select(*RUN.names) for level in self.levels for run in level]
        return _union(runs) if runs else self.spark.createDataFrame([], RUN)

    def frequent(self, min_docs: int) -> DataFrame:
        return self.counts().where(F.col("docs") >= min_docs)


def _rebuild(docs: list, keeps: list) -> tuple[list, list, list]:
    texts, n_lines, n_dropped = [], [], []
    for text, kept in zip(docs, keeps, strict=True):
        lines = text.split("\n")
        stay = {i for places in kept or () for i in places}
        left = [x for i, x in enumerate(lines) if i in stay or not x.strip(SPACE)]
        texts.append("\n".join(left))
        n_lines.append(len(lines))
        n_dropped.append(len(lines) - len(left))
    return texts, n_lines, n_dropped


def _apply(docs: DataFrame, kept: DataFrame, *keep: str) -> DataFrame:
    """The documents with their ``kept`` lines and blank ones; a text is shuffled once, to its places."""
    carried = [F.col(f"`{c}`") for c in ("doc_id", *keep)]
    rows = docs.select(*carried, text_of().alias("_text"), F.coalesce("doc_id", F.lit(0)).alias("_k0"),
                       row_hash("doc_id", "text").alias("_k1"))
    places = kept.groupBy("_k0", "_k1").agg(F.collect_list("places").alias("_kept"))
    joined = rows.join(places, ["_k0", "_k1"], "left").drop("_k0", "_k1")
    return add_columns(joined, ["_text", "_kept"], lambda: _rebuild,
                       {"_kept_text": "string", "_n_lines": "long", "_n_dropped": "long"})


def drop_lines(docs: DataFrame, runs: LineRuns, min_docs: int, *keep: str) -> DataFrame:
    """The documents without the lines that ``runs`` has seen in ``min_docs`` documents.

    Columns: doc_id, ``keep``, _kept_text, _n_lines, _n_dropped.
    """
    return _apply(docs, _without(hashed_lines(docs), stored(runs.frequent(min_docs), "line-frequent")), *keep)


def ingest(docs: DataFrame, runs: LineRuns, min_docs: int) -> DataFrame:
    """One batch of a feed: adds its run, then judges its lines by the sums over all runs so far."""
    runs.add(line_counts(hashed_lines(docs)))
    return drop_lines(docs, runs, min_docs)


def batches_of(docs: DataFrame) -> int:
    """Batches of some ``BATCH_BYTES`` of input, by the plan's own estimate; two at least."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(2, min(MOST_BATCHES, math.ceil(size / BATCH_BYTES)))


def dedup(docs: DataFrame, min_docs: int, *keep: str, batches: int | None = None,
          fanout: int = FANOUT) -> DataFrame:
    """A whole table by batches, and once more for lines that became frequent later."""
    spark = docs.sparkSession
    batches = batches or batches_of(docs)
    path = scratch_path(spark, "lines")
    hashed_lines(docs, batches).write.partitionBy("batch").parquet(path)
    lines, runs, left = spark.read.schema(LINES).parquet(path), LineRuns(spark, fanout, min_docs), []
    for batch in range(batches):
        own = lines.where(F.col("batch") == batch).drop("batch")
        runs.add(line_counts(own))
        left.append(stored(_without(own, runs.known()), "lines-left"))
    return _apply(docs, _without(_union(left), stored(runs.frequent(min_docs), "line-frequent")), *keep)
