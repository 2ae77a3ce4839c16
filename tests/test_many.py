"""Very many queries against a small corpus: the same vectors and ranks as few of them."""

import pytest

from remedia.operators import retrieval, semantics

CORPUS = "id string, regulation string, title string, text string"
DOCS = [(f"S{i}", "REG_E" if i % 2 else "REG_Z", f"title w{i % 5}", " ".join(f"w{(i * j) % 17}" for j in range(1, 9)))
        for i in range(30)]
ASKED = [(f"q{i}", None if i == 3 else f"w{i % 17} w{(3 * i) % 17} w{i % 5} thirty", "REG_E") for i in range(40)]


def test_lots_give_the_same_vectors_and_ranks(spark, monkeypatch):
    corpus = spark.createDataFrame(DOCS, CORPUS)
    queries = spark.createDataFrame(ASKED, "query_id string, query string, regulation string")
    projection = retrieval.fit_projection(corpus, 4)
    few = {r[0]: r[1] for r in semantics.embed_queries(queries, projection).collect()}
    monkeypatch.setattr(semantics, "LOT_TERMS", 20)
    monkeypatch.setattr(semantics, "PART_TERMS", 9)
    many = {r[0]: r[1] for r in semantics.embed_many(queries, projection).collect()}
    assert many.keys() == few.keys() and many["q3"] is None and few["q3"] is None
    assert all(many[q] == pytest.approx(v, abs=1e-9) for q, v in few.items() if v)

    index = retrieval.build_index(corpus)
    found = retrieval.bm25(corpus, queries, 6, index=index)
    idf = retrieval.inverse_frequency(index)
    order = lambda: {(r["query_id"], r["rank"]): (r["doc_id"], round(r["score"], 9)) for r in retrieval.rerank(
        found, corpus, queries, idf, 3).collect()}
    whole = order()
    monkeypatch.setattr(retrieval, "LOT_PAIRS", 7)
    assert order() == whole and len(whole) >= 3 * 30
