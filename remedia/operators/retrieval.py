"""Batch retrieval: lexical, latent-semantic, fused and reranked rankings.

A corpus is ``id, regulation, title, text``; queries are ``query_id, query`` and
optionally ``regulation``. Rankings are ``query_id, doc_id, rank, score``. All
queries are answered together. ``large`` names the side the work is spread over:
``corpus`` (few questions against many documents) or ``queries`` (many cases
against a section corpus).

Joins carry no broadcast hints: the optimiser broadcasts the side it measures to
be small, and otherwise shuffles on the term with skewed partitions split.

The lexical part is in ``lexical``, the projection in ``semantics``, the dense search in
``nearest``; this module fuses, reranks and judges their rankings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remedia import policy
from remedia.functions.text import tokenize
from remedia.operators.lexical import (  # noqa: F401
    Index,
    bm25,
    build_index,
    inverse_frequency,
    load_index,
    ranked,
    save_index,
)
from remedia.operators.nearest import VectorIndex, build_lists, nearest
from remedia.operators.semantics import (  # noqa: F401
    Projection,
    embed_many,
    embed_queries,
    fit_projection,
    sums_over_terms,
    unit,
)
from remedia.operators.terms import counted_terms, cuttable, indexed_text, query_counts, query_terms
from remedia.session import stored, unnest

LOT_PAIRS = 1 << 14  # candidates in a task's hands, about

# --- latent semantics ---------------------------------------------------------------

def dense_topk(
    vectors: DataFrame, queries: DataFrame, k: int = policy.CANDIDATE_K, index: VectorIndex | None = None,
) -> DataFrame:
    """Exact cosine ranking of unit vectors (``doc_id, vector`` and ``query_id, vector``).

    Goes through lists and rings (``nearest``); an index built once serves many batches.
    """
    return ranked(nearest(index or build_lists(vectors), queries, k)[0], k)


# --- fusion and rerank ---------------------------------------------------------------

def rrf(rankings: list[DataFrame], k: int = policy.RRF_K, limit: int | None = None) -> DataFrame:
    """Reciprocal rank fusion; symmetric in its inputs, ties by id."""
    union = None
    for ranking in rankings:
        part = ranking.select("query_id", "doc_id", (1.0 / (k + F.col("rank"))).alias("r"))
        union = part if union is None else union.unionByName(part)
    fused = union.groupBy("query_id", "doc_id").agg(F.sum("r").alias("score"))
    return ranked(fused, limit if limit is not None else 2**31 - 1)


def _lists(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The values of a column of lists one after another, and where each list begins and the last ends."""
    lists = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.r_[0, np.cumsum(sizes, dtype=np.int64)]


def _spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places from each start to its end, one after another."""
    sizes = ends - starts
    return np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())


def _codes(values: pa.Array, known: pa.Array) -> np.ndarray:
    """The place of each value among the known ones, -1 where it is none of them."""
    return pc.fill_null(pc.index_in(values, value_set=known), -1).to_numpy(zero_copy_only=False)


def _covered(asked: pa.Table, held: pa.Table) -> pa.Table:
    """What the candidates of a lot of queries cover: summed weight of shared terms, shared words of the title."""
    terms, of_terms = _lists(held.column("terms"))
    title, of_title = _lists(held.column("title"))
    idf = _lists(held.column("idfs"))[0].to_numpy(zero_copy_only=False)
    words = pa.chunked_array([terms, title]).unique()
    term, word = _codes(terms, words), _codes(title, words)
    names, of_names = _lists(asked.column("names"))
    name = _codes(names, words)
    # every candidate with each of the documents of its id
    ids = held.column("doc_id").unique()
    at = _codes(held.column("doc_id").combine_chunks(), ids)
    order = np.argsort(at, kind="stable")
    begin = np.searchsorted(at[order], np.arange(len(ids) + 1))
    candidates, of_candidates = _lists(asked.column("candidates"))
    wanted = _codes(candidates.field("doc_id"), ids)
    some = np.flatnonzero(wanted >= 0)
    copies = begin[wanted[some] + 1] - begin[wanted[some]]
    place = order[_spans(begin[wanted[some]], begin[wanted[some] + 1])]
    pick = np.repeat(some, copies)
    query = np.repeat(np.arange(asked.num_rows), np.diff(of_candidates))[pick]
    bounds = np.searchsorted(query, np.arange(asked.num_rows + 1))
    covered, shared = np.zeros(len(place)), np.zeros(len(place), np.int32)
    has = np.zeros(len(words), bool)
    for q, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        own = name[of_names[q]:of_names[q + 1]]
        own = own[own >= 0]
        if a == b or not len(own):
            continue
        has[own] = True
        for out, starts, code, weight in ((covered, of_terms, term, idf), (shared, of_title, word, None)):
            first, last = starts[place[a:b]], starts[place[a:b] + 1]
            entry = _spans(first, last)
            hit = has[code[entry]]
            pair = np.repeat(np.arange(b - a), last - first)[hit]
            out[a:b] = np.bincount(pair, None if weight is None else weight[entry[hit]], b - a)
        has[own] = False
    query, place = pa.array(query, pa.int64()), pa.array(place, pa.int64())
    return pa.table([
        *[asked.column(c).take(query) for c in ("query_id", "size", "total", "wanted")],
        *[held.column(c).take(place) for c in ("doc_id", "given")], candidates.field("rank").take(pa.array(pick)).cast(pa.int32()),
        pa.array(covered), pa.array(shared)],
        names=["query_id", "size", "total", "wanted", "doc_id", "given", "rank", "covered", "shared"])


def rerank(
    candidates: DataFrame, corpus: DataFrame, queries: DataFrame, idf: DataFrame,
    k: int = policy.TOP_K, counted: DataFrame | None = None,
) -> DataFrame:
    """Reorder candidates by position, covered term weight, title and regulation.

    Works on the candidates alone, which are computed once: their texts are fetched by id and
    cut once, and lots of queries meet the documents that they have as candidates. ``counted``
    are the ``query_counts`` of very many queries where these are stored.
    """
    has_regulation = "regulation" in queries.columns
    pairs = stored(candidates.select("query_id", "doc_id", F.col("rank").cast("int").alias("rank")), "candidates")
    if counted is None:
        counted = stored(query_counts(queries).select("query_id", F.col("terms").alias("names")), "asked")
        totals = counted.select("query_id", F.explode("names").alias("term")).join(idf, "term").groupBy("query_id").agg(
            F.sum("idf").alias("total"))
    else:
        once_each = counted.select("query_id", "terms", F.array_repeat(F.lit(1), F.size("terms")).alias("counts"))
        totals = sums_over_terms(once_each, idf.select("term", "idf", F.array(F.lit(1.0)).alias("factor"))).select(
            "query_id", F.get("v", F.lit(0)).alias("total")).groupBy("query_id").agg(F.sum("total").alias("total"))
        counted = counted.select("query_id", F.col("terms").alias("names"))
    regs = queries.select("query_id", (
        F.col("regulation") if has_regulation else F.lit(None).cast("string")).alias("wanted"))
    asked_for = pairs.select(F.col("doc_id").alias("id")).distinct()
    texts = corpus.join(asked_for, "id", "left_semi").select(
        F.col("id").alias("doc_id"), F.col("regulation").alias("given"),
        F.array_distinct(tokenize(F.col("title"))).alias("title"), cuttable(indexed_text(corpus)).alias("text"))
    texts = stored(texts.withColumn("row", F.monotonically_increasing_id()), "candidate-texts")
    cut = unnest(counted_terms(texts, "row"), F.col("terms"), "term", "row").join(idf, "term").groupBy("row").agg(
        F.collect_list(F.struct("term", "idf")).alias("t"))
    docs = stored(texts.join(cut, "row", "left").select(
        "doc_id", "given", "title", F.col("t.term").alias("terms"), F.col("t.idf").alias("idfs")), "candidate-terms")
    lots = max(1, -(-pairs.count() // LOT_PAIRS))
    lot = F.pmod(F.xxhash64("query_id"), F.lit(lots)).cast("int").alias("lot")
    held = pairs.select(lot, "doc_id").distinct().join(docs, "doc_id")
    asked = pairs.groupBy("query_id").agg(F.collect_list(F.struct("doc_id", "rank")).alias("candidates")).join(
        counted, "query_id").join(regs, "query_id").join(totals, "query_id", "left").select(
        lot, "query_id", "names", "candidates", "wanted", F.size("names").alias("size"), F.coalesce("total", F.lit(0.0)).alias("total"))
    schema = T.StructType([
        asked.schema["query_id"], T.StructField("size", T.IntegerType()), T.StructField("total", T.DoubleType()),
        T.StructField("wanted", T.StringType()), docs.schema["doc_id"], T.StructField("given", T.StringType()),
        T.StructField("rank", T.IntegerType()), T.StructField("covered", T.DoubleType()), T.StructField("shared", T.IntegerType())])
    rows = asked.groupBy("lot").cogroup(held.groupBy("lot")).applyInArrow(_covered, schema)
    title = F.col("shared") / F.greatest(F.col("size"), F.lit(1))
    same = F.when(F.col("given") == F.col("wanted"), policy.RERANK_REGULATION).otherwise(0.0)
    circular = F.when(
        F.coalesce(F.col("wanted") != "", F.lit(False)) & (F.col("given") == "CIRCULAR"),
        policy.RERANK_CIRCULAR).otherwise(0.0)
    score = (
        policy.RERANK_POSITION / F.col("rank")
        + policy.RERANK_COVERED * (F.col("covered") / F.when(F.col("total") == 0, 1.0).otherwise(F.col("total")))
        + policy.RERANK_TITLE * title + same + circular)
    return ranked(rows.select("query_id", "doc_id", score.alias("score")), k)


def hybrid_search(
    corpus: DataFrame, queries: DataFrame, projection: Projection | None = None,
    large: str = "corpus", k: int = policy.TOP_K, candidates: int = policy.CANDIDATE_K,
    with_rerank: bool = True, index: Index | None = None,
) -> DataFrame:
    """Lexical and dense candidates, fused, cut to ``candidates`` and reranked to ``k``."""
    rankings = search_all(corpus, queries, projection, large, k, candidates, index)
    return rankings["reranked" if with_rerank else "fused"].where(F.col("rank") <= k)


def search_all(
    corpus: DataFrame, queries: DataFrame, projection: Projection | None = None,
    large: str = "corpus", k: int = policy.TOP_K, candidates: int = policy.CANDIDATE_K,
    index: Index | None = None,
) -> dict[str, DataFrame]:
    """The four rankings of an ablation, over one index and one projection."""
    index = index or build_index(
        corpus, None if large == "queries" else query_terms(queries))
    projection = projection or fit_projection(corpus)
    # the terms of very many queries are counted once for all that reads them
    counted = stored(query_counts(queries).select(
        "query_id", "terms", "counts"), "counted-queries") if large == "queries" else None
    lexical = bm25(corpus, queries, candidates, large=large, index=index, counted=counted)
    vectors = embed_queries(queries, projection) if counted is None else embed_many(queries, projection, counted)
    dense = dense_topk(projection.vectors, vectors, candidates)
    fused = rrf([lexical, dense], limit=candidates)
    reranked = rerank(fused, corpus, queries, inverse_frequency(index), k, counted)
    return {"lexical": lexical, "dense": dense, "fused": fused, "reranked": reranked}


# --- evaluation -----------------------------------------------------------------------

def judge(ranking: DataFrame, golden: DataFrame, k: int = policy.TOP_K,
          regulations: DataFrame | None = None) -> DataFrame:
    """Per-query recall, any-primary, precision, reciprocal rank and routing.

    ``golden`` is ``query_id, regulation, primary, secondary`` (arrays of doc ids);
    ``regulations`` maps ``doc_id`` to ``regulation``. A query without primaries has
    NULL recall, which averages skip.
    """
    top = ranking.where(F.col("rank") <= k)
    if regulations is not None:
        top = top.join(regulations.select(
            "doc_id", F.col("regulation").alias("_reg")), "doc_id", "left")
    else:
        top = top.withColumn("_reg", F.lit(None).cast("string"))
    hits = top.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "doc_id", "_reg"))).alias("_h"))
    rows = golden.join(hits, "query_id", "left").withColumn(
        "hits", F.coalesce(F.transform("_h", lambda h: h["doc_id"]), F.array()))
    primary = F.array_distinct("primary")
    relevant = F.array_union(primary, F.coalesce(F.col("secondary"), F.array()))
    found = F.size(F.array_intersect(primary, "hits"))
    first = F.array_min(F.transform(
        F.filter("_h", lambda h: F.array_contains(F.col("primary"), h["doc_id"])),
        lambda h: h["rank"]))
    return rows.select(
        "query_id", "regulation", "hits",
        F.when(F.size(primary) > 0, found / F.size(primary)).alias("recall"),
        (found > 0).cast("double").alias("any_primary"),
        (F.size(F.array_intersect(relevant, "hits")) / F.lit(float(k))).alias("precision"),
        F.coalesce(1.0 / first, F.lit(0.0)).alias("mrr"),
        F.coalesce((F.get("_h", F.lit(0))["_reg"] == F.col("regulation")).cast("double"),
                   F.lit(0.0)).alias("routed"),
        F.array_sort(F.array_except(primary, "hits")).alias("missed"))


def summarise(judged: DataFrame, *by: str) -> DataFrame:
    return judged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("questions"), *[F.avg(m).alias(m) for m in (
            "recall", "any_primary", "precision", "mrr", "routed")])


def ablation(rankings: dict[str, DataFrame], golden: DataFrame, k: int = policy.TOP_K,
             regulations: DataFrame | None = None) -> DataFrame:
    """The same metrics for each named ranking."""
    out = None
    for name, ranking in rankings.items():
        part = judge(ranking, golden, k, regulations).withColumn("config", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return summarise(out, "config")


def deadline_agreement(golden: DataFrame) -> DataFrame:
    """Expected numbers of the questions that state one, against the rule constants."""
    constants = F.create_map(*[F.lit(x) for kv in policy.RULE_CONSTANTS.items() for x in kv])
    rows = golden.where(F.coalesce(F.col("deadline_check") != "", F.lit(False))).withColumn(
        "rule_value", F.try_element_at(constants, F.col("deadline_check")))
    return rows.select("deadline_check", "expected", "rule_value", F.col("rule_value").eqNullSafe(
        F.col("expected")).alias("agrees"))
