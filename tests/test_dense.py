"""The projection against a full decomposition, and the inverted file against all pairs."""

import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from remedia.operators import nearest, retrieval, semantics

CORPUS = "id string, regulation string, title string, text string"


def topics(n, seed=2, words=900):
    """Documents of six topics over about a thousand terms."""
    rng = random.Random(seed)
    return [(f"d{i}", "R", f"title{i % 6}", " ".join(
        f"topic{'abcdef'[i % 6]}{rng.randrange(20 + i % 6)}" if rng.random() < 0.7 else f"word{rng.randrange(words)}"
        for _ in range(60))) for i in range(n)]


@pytest.mark.parametrize("size", [32 << 20, 9_000])
def test_projection_matches_full_decomposition(spark, monkeypatch, size):
    monkeypatch.setattr(semantics, "CHUNK_BYTES", size)
    docs = spark.createDataFrame(topics(240), CORPUS)
    matrix = semantics.term_matrix(docs)
    assert matrix.n_terms > 1000 and (matrix.chunks == 1) == (size > 1 << 20)
    column = {r["term"]: (i, r["idf"]) for i, r in enumerate(matrix.terms.collect())}
    dense, names = np.zeros((240, matrix.n_terms)), []
    for i, r in enumerate(matrix.rows.collect()):
        names.append(r["doc_id"])
        for term, n in zip(r["terms"], r["counts"], strict=True):
            dense[i, column[term][0]] = (1 + np.log(n)) * column[term][1]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    u, s, vt = np.linalg.svd(dense, full_matrices=False)
    k = 6
    p = semantics.fit_projection(docs, k)
    found = {r["term"]: r["f"] for r in p.factors.select("term", vector_to_array("factor").alias("f")).collect()}
    v = np.zeros((matrix.n_terms, k))
    for term, factor in found.items():
        v[column[term][0]] = factor
    assert np.allclose(v.T @ v, np.eye(k), atol=1e-5)
    assert np.allclose(np.linalg.svd(dense @ v)[1], s[:k], rtol=0.005)  # singular values to half a percent
    want = dense @ vt[:k].T
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    got = {r["doc_id"]: r["vector"] for r in p.vectors.collect()}
    mine = np.array([got[n] for n in names])
    assert np.abs(mine @ mine.T - want @ want.T).max() < 0.05  # likeness of any two documents


def test_shared_terms_travel_in_pieces_not_rows(spark, monkeypatch):
    monkeypatch.setattr(semantics, "CHUNK_BYTES", 20_000)
    matrix = semantics.term_matrix(spark.createDataFrame(topics(240), CORPUS))
    block = semantics._returned(matrix, None, None, 8)
    assert matrix.chunks > 2 and block.count() <= matrix.chunks * (matrix.chunks + 3)
    assert block.where(F.col("kind") == semantics.SHARED).agg(F.sum(F.length("v"))).first()[0] > 8 * 4 * 1000


def test_projection_of_little(spark):
    empty = semantics.fit_projection(spark.createDataFrame([], CORPUS))
    assert empty.factors.count() == 0 and empty.vectors.count() == 0
    rows = [("", "", "", "the of"), ("a1", "R", "x", "apple pear"), ("a2", "R", "x", "apple plum")]
    p = semantics.fit_projection(spark.createDataFrame(rows, CORPUS), 5)
    got = {r["doc_id"]: r["vector"] for r in p.vectors.collect()}
    assert got[""] is None and abs(np.linalg.norm(got["a1"]) - 1) < 1e-6
    asked = spark.createDataFrame([("q1", "apple pear"), ("q2", "unknown")], "query_id string, query string")
    vectors = {r["query_id"]: r["vector"] for r in semantics.embed_queries(asked, p).collect()}
    assert vectors["q2"] is None and np.dot(vectors["q1"], got["a1"]) > np.dot(vectors["q1"], got["a2"]) - 1e-9


def ranked(spark, docs, asked, k, kind="long"):
    d = spark.createDataFrame(docs, f"doc_id {kind}, vector array<double>")
    q = spark.createDataFrame(asked, "query_id long, vector array<double>")
    return {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in retrieval.dense_topk(d, q, k).collect()}


def brute(docs, asked, k):
    out = {}
    for q, x in asked:
        scores = [(-round(float(np.dot(x, y)), 9) if x and y else 0.0, i) for i, y in docs]
        for rank, (s, i) in enumerate(sorted(scores)[:k], 1):
            out[q, rank] = (i, -s)
    return out


def same(got, want):
    assert got.keys() == want.keys()
    assert all(got[p][0] == want[p][0] and abs(got[p][1] - want[p][1]) < 1e-8 for p in want)


def unit(x):
    return [float(v) for v in np.asarray(x) / np.linalg.norm(x)]


def clouds(n, dim=12, centres=8, spread=0.05, seed=4):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    return [unit(c[i % centres] + rng.normal(0, spread, dim)) for i in range(n)]


@pytest.fixture
def small(monkeypatch):
    for name, value in (("LIST_ROWS", 60), ("RING_ROWS", 12), ("PIECE_ROWS", 10), ("LOT", 7)):
        monkeypatch.setattr(nearest, name, value)


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_search_equals_all_pairs(spark, small, spread):
    docs = list(enumerate(clouds(500, spread=spread)))
    asked = list(enumerate(clouds(20, spread=spread, seed=9)))
    same(ranked(spark, docs, asked, 5), brute(docs, asked, 5))


def test_search_ties_nulls_and_copies(spark, small):
    docs = [(i, unit([1, 2, 3])) for i in range(90)] + [(100 + i, v) for i, v in enumerate(clouds(40, 3))]
    docs += [(200 + i, None) for i in range(5)] + [(300, [0.0] * 3)]
    asked = [(1, unit([1, 2, 3])), (2, None), (3, [0.0] * 3), (4, unit([-1, -2, -3]))]
    brute_docs = [(i, v if v and any(v) else None) for i, v in docs]
    same(ranked(spark, docs, asked, 7), brute(brute_docs, [(q, v if v and any(v) else None) for q, v in asked], 7))


def test_search_of_little(spark):
    assert ranked(spark, [], [(1, [1.0, 0.0])], 3) == {}
    assert ranked(spark, [(1, [1.0, 0.0])], [], 3) == {}
    same(ranked(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])], [(9, unit([1, 1]))], 3),
         {(9, 1): (1, 0.5 ** 0.5), (9, 2): (2, 0.5 ** 0.5)})
    named = ranked(spark, [("b", [1.0, 0.0]), ("a", [1.0, 0.0])], [(1, [1.0, 0.0])], 1, "string")
    assert named == {(1, 1): ("a", 1.0)}


def test_bounds_spare_most_pairs(spark, small):
    vectors = spark.createDataFrame(list(enumerate(clouds(2000, centres=20))), "doc_id long, vector array<double>")
    index = nearest.build_lists(vectors)
    asked = vectors.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    found, scored = nearest.nearest(index, asked, 5)
    counts = [r["scored"] for r in scored.collect()]
    assert len(counts) == 40 and max(counts) < 2000 and sum(counts) < 0.4 * 40 * 2000
    assert found.groupBy("query_id").agg(F.max("score").alias("s")).where("s < 0.999999").count() == 0
