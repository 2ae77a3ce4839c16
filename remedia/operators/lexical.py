"""BM25 over postings in blocks, skipping blocks that can't hold a ranked document.

Documents are put into blocks of ``BLOCK_DOCS``. For every term and block the index keeps the
greatest frequency and the least length, which bound the term's weight in the block for any
setting of the formula; their sum over a query's terms bounds every document of the block.
A query scores its ``PROBED`` most promising blocks first. The score of its ``k``-th best there
rules out all blocks whose bound is below it; only the postings of the others are read.

A corpus is tokenised once, when the index is built; the index is stored tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remedia import policy
from remedia.operators.terms import document_texts, query_counts, query_terms, term_counter
from remedia.session import stored

BLOCK_DOCS = 64
PROBED = 4     # blocks that a query scores to find its threshold
SLACK = 1e-6   # scores are ranked to nine digits; bounds give way by more
LOT_TERMS = 1 << 20   # terms of queries in a task's hands, about, where there are many queries
PART_ROWS = 1 << 18   # postings beside them, about
CELLS = 1 << 20       # scores or postings at once, about


class Index(NamedTuple):
    lists: DataFrame      # term, block, tf, length (the greatest and the least), n, cf, docs (doc_id, tf, length)
    terms: DataFrame      # term, df
    stats: DataFrame      # docs, avg_length: one row

    @property
    def postings(self) -> DataFrame:
        """``term, block, doc_id, tf, length``: a row a term and document."""
        return self.lists.select("term", "block", F.explode("docs").alias("d")).select("term", "block", "d.*")


def block_lists(corpus: DataFrame) -> DataFrame:
    """The lists of each block, and for every block a row with a NULL term: its documents and their length.

    ``BLOCK_DOCS`` documents of a task are a block, so its lists are made where they are cut.
    """
    wide, texts = BLOCK_DOCS, document_texts(corpus)
    posting = T.StructType([texts.schema["doc_id"], T.StructField("tf", T.IntegerType()), T.StructField("length", T.IntegerType())])
    schema = T.StructType([
        T.StructField("term", T.StringType()), T.StructField("block", T.LongType()), T.StructField("tf", T.IntegerType()),
        T.StructField("length", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("cf", T.LongType()),
        T.StructField("docs", T.ArrayType(posting))])

    def made(ids: pa.Array, found: list[dict[str, int]], block: int) -> pa.RecordBatch:
        lengths = np.array([sum(f.values()) for f in found], np.int32)
        coded = pa.array([t for f in found for t in f], pa.string()).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        code, tf = code[order], np.array([n for f in found for n in f.values()], np.int32)[order]
        owner = np.repeat(np.arange(len(found)), [len(f) for f in found])[order]
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, int)
        over = (lambda f, x: f.reduceat(x, starts)) if len(starts) else (lambda f, x: x[:0])
        docs = pa.StructArray.from_arrays([ids.take(pa.array(owner)), pa.array(tf), pa.array(lengths[owner])], posting.names)
        counts = np.diff(np.r_[starts, len(code)])
        return pa.RecordBatch.from_arrays([
            pa.concat_arrays([coded.dictionary.take(pa.array(code[starts])), pa.nulls(1, pa.string())]),
            pa.array(np.full(len(starts) + 1, block)), pa.array(np.r_[over(np.maximum, tf), 0], pa.int32()),
            pa.array(np.r_[over(np.minimum, lengths[owner]), 0], pa.int32()), pa.array(np.r_[counts, len(found)], pa.int32()),
            pa.array(np.r_[over(np.add, tf.astype(np.int64)), lengths.sum(dtype=np.int64)], pa.int64()),
            pa.ListArray.from_arrays(pa.array(np.r_[starts, len(code), len(code)], pa.int32()), docs)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, block = term_counter(), TaskContext.get().partitionId() << 33
        for batch in batches:
            for begin in range(0, batch.num_rows, wide):
                some = batch.slice(begin, wide)
                yield made(some.column(0), [count(t) for t in some.column(1).to_pylist()], block)
                block += 1

    return texts.mapInArrow(run, schema)


def build_index(corpus: DataFrame, vocabulary: DataFrame | None = None) -> Index:
    """Index of a corpus, limited to ``vocabulary`` (``term``) where one is given."""
    lists = block_lists(corpus)
    if vocabulary is not None:
        known = stored(vocabulary.select("term").distinct().withColumn("_known", F.lit(True)), "vocabulary")
        lists = lists.join(known, "term", "left").where("_known OR term IS NULL").drop("_known")
    made = stored(lists, "lists")
    stats = made.where("term IS NULL").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("docs"), F.try_divide(F.sum("cf"), F.sum("n")).alias("avg_length"))
    lists = made.where("term IS NOT NULL")
    terms = stored(lists.groupBy("term").agg(F.sum("n").alias("df")), "terms")
    return Index(lists, terms, stored(stats, "stats"))


def save_index(index: Index, path: str) -> None:
    """Write the index once, in order of terms: a batch of queries reads the files of its own."""
    for name, keys in (("lists", ["term", "block"]), ("terms", ["term"])):
        getattr(index, name).repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(
            "overwrite").parquet(f"{path}/{name}")
    index.stats.write.mode("overwrite").parquet(f"{path}/stats")


def load_index(spark: SparkSession, path: str) -> Index:
    return Index(*[spark.read.parquet(f"{path}/{name}") for name in Index._fields])


def inverse_frequency(index: Index) -> DataFrame:
    """``term, idf``; a positive weight for every term of the index."""
    n = index.stats.select("docs").scalar()
    return index.terms.withColumn("_n", n).select("term", F.ln(
        1 + (F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """Best ``k`` per query, by score (to nine digits) then id; limited per task first."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= k).select("query_id", "doc_id", "rank", "score")


class Search(NamedTuple):
    scores: DataFrame     # query_id, doc_id, score: the exact best k of each query among them
    scored: DataFrame     # query_id, blocks, postings: what was read
    skipped: DataFrame    # query_id, blocks: those that hold a term and were not read


def _weight(k1: float, b: float) -> Column:
    return (F.col("idf") * F.col("tf") * (k1 + 1)
            / (F.col("tf") + k1 * (1 - b + b * (F.col("length") / F.col("_avg"))))).alias("weight")


def search(index: Index, queries: DataFrame, k: int, k1: float = policy.BM25_K1, b: float = policy.BM25_B) -> Search:
    asked = stored(query_terms(queries).join(inverse_frequency(index), "term"), "asked")
    average = index.stats.select("avg_length").scalar()
    weight = _weight(k1, b)

    bounds = index.lists.drop("docs").withColumn("_avg", average).join(asked, "term")
    bounds = stored(bounds.select("query_id", "block", "n", weight).groupBy("query_id", "block").agg(
        F.sum("weight").alias("bound"), F.sum("n").alias("n")), "bounds")
    order = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "block")
    probes = stored(bounds.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PROBED), "probes")

    def scores(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select("query_id", "block").join(asked, "query_id")
        held = index.lists.select("term", "block", "docs").join(wanted, ["term", "block"])
        rows = held.withColumn("d", F.explode("docs")).select("query_id", "idf", "d.*").withColumn("_avg", average)
        return rows.select("query_id", "doc_id", weight).groupBy("query_id", "doc_id").agg(
            F.sum("weight").alias("score"))

    first = stored(scores(probes), "scores")
    least = ranked(first, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    open_ = bounds.join(probes.select("query_id", "block"), ["query_id", "block"], "left_anti").join(
        least, "query_id", "left").withColumn("_read", F.coalesce(F.col("bound") >= F.col("least") - SLACK, F.lit(True)))
    rest = open_.where("_read")
    read = probes.select("query_id", "n").unionByName(rest.select("query_id", "n"))
    return Search(first.unionByName(scores(rest)), read.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("postings")),
        open_.where("NOT _read").groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks")))


def _best_of_part(k: int):
    """Best ``k`` of a part's documents for each query of a lot: by score to nine digits, then by id."""

    def work(asked: pa.Table, held: pa.Table) -> pa.Table:
        names = ["query_id", "doc_id", "score"]
        queries = asked.column("query_id").combine_chunks().dictionary_encode("encode")
        docs = held.column("doc_id").combine_chunks().dictionary_encode("encode")
        out = [pa.table([queries.dictionary.slice(0, 0), docs.dictionary.slice(0, 0), pa.array([], pa.float64())], names)]
        if not asked.num_rows or not held.num_rows:
            return out[0]
        rank = np.empty(len(docs.dictionary), np.int64)
        rank[pc.sort_indices(docs.dictionary, null_placement="at_start").to_numpy()] = np.arange(len(rank))
        words = held.column("term").combine_chunks().dictionary_encode()
        code = words.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        starts = np.searchsorted(code[order], np.arange(len(words.dictionary) + 1))
        doc, weight = docs.indices.to_numpy()[order], held.column("weight").to_numpy()[order]
        lists = asked.column("terms").combine_chunks()
        owner = np.repeat(queries.indices.to_numpy(), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        at = pc.fill_null(pc.index_in(lists.flatten(), value_set=words.dictionary), -1).to_numpy(zero_copy_only=False)
        owner, at = owner[at >= 0], at[at >= 0]
        if (owner[1:] < owner[:-1]).any():  # rows of one id are one query
            turn = np.argsort(owner, kind="stable")
            owner, at = owner[turn], at[turn]
        long = starts[at + 1] - starts[at]
        load = np.maximum(np.bincount(owner, long, len(queries.dictionary)), len(rank))
        lot = (np.cumsum(load) // CELLS).astype(int)
        for begin, end in zip(*[np.flatnonzero(np.r_[True, lot[1:] != lot[:-1], True])[i] for i in (slice(None, -1), slice(1, None))], strict=True):
            x, y = np.searchsorted(owner, [begin, end])
            n = long[x:y]
            entry = np.repeat(starts[at[x:y]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            cell = np.repeat(owner[x:y] - begin, n) * len(rank) + doc[entry]
            score = np.bincount(cell, weight[entry], (end - begin) * len(rank)).reshape(-1, len(rank)).astype(float)  # whole numbers where no term is known
            place = np.unique(np.rint(score * 1e9), return_inverse=True)[1].reshape(score.shape)
            key = np.where(score > 0, -(place * len(rank) + len(rank) - 1 - rank), 1)
            top = np.argpartition(key, min(k, len(rank)) - 1, 1)[:, :k]
            found = np.take_along_axis(score, top, 1)
            who, what = np.nonzero(found > 0)
            out.append(pa.table([queries.dictionary.take(pa.array(who + begin)), docs.dictionary.take(
                pa.array(top[who, what])), pa.array(found[who, what])], names))
        return pa.concat_tables(out)

    return work


def search_many(
    index: Index, queries: DataFrame, k: int, k1: float, b: float, counted: DataFrame | None = None,
) -> DataFrame:
    """Scores that hold the exact best ``k`` of each of very many queries.

    Queries are dealt into lots and the documents' weights into parts; a task scores a lot
    against a part, so no row is made for a term that a query and a document share.
    ``counted`` are the ``query_counts`` of the queries where these are stored.
    """
    if counted is None:
        counted = stored(query_counts(queries).select("query_id", "terms"), "asked")
    asked = counted.select("query_id", "terms")
    rows = index.postings.join(inverse_frequency(index), "term").withColumn("_avg", index.stats.select("avg_length").scalar())
    held = stored(rows.select("term", "doc_id", _weight(k1, b)), "weights")
    lots = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // LOT_TERMS))
    parts = max(1, -(-held.count() // PART_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = asked.withColumn("lot", F.pmod(F.xxhash64("query_id"), F.lit(lots)).cast("int")).withColumn("part", every(parts))
    placed = held.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")).withColumn("lot", every(lots))
    schema = T.StructType([asked.schema["query_id"], held.schema["doc_id"], T.StructField("score", T.DoubleType())])
    key = ["part", "lot"]
    return dealt.groupBy(*key).cogroup(placed.groupBy(*key)).applyInArrow(_best_of_part(k), schema)


def bm25(
    corpus: DataFrame, queries: DataFrame, k: int = policy.CANDIDATE_K,
    k1: float = policy.BM25_K1, b: float = policy.BM25_B, large: str = "corpus",
    index: Index | None = None, counted: DataFrame | None = None,
) -> DataFrame:
    """Ranking by BM25; without an index one is built, limited to the terms asked for unless
    there are many queries (``large="queries"``), whose stored ``query_counts`` may be given."""
    if index is None:
        index = build_index(corpus, None if large == "queries" else query_terms(queries))
    if large == "queries":
        return ranked(search_many(index, queries, k, k1, b, counted), k)
    return ranked(search(index, queries, k, k1, b).scores, k)
