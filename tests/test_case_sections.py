"""The section search of very many cases: each text cut once, no step row by row in the optimiser's hands."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from remedia.operators import lexical, retrieval, semantics, terms
from remedia.plans import triage as plan

CORPUS = "id string, regulation string, title string, text string"
DOCS = [(f"S{i}", "REG_E", f"title w{i % 5}", " ".join(f"w{(i * j) % 17}" for j in range(1, 9))) for i in range(30)]
ASKED = "query_id string, query string, regulation string"


def test_a_lot_without_a_known_term_has_no_ranks(spark):
    corpus = spark.createDataFrame(DOCS, CORPUS)
    asked = spark.createDataFrame([("q1", "nothing here is known", "REG_E")], ASKED)
    assert retrieval.bm25(corpus, asked, 5, large="queries").count() == 0
    top = retrieval.hybrid_search(corpus, asked, retrieval.fit_projection(corpus, 4), "queries").collect()
    assert len(top) == 4 and {r["query_id"] for r in top} == {"q1"}


def test_the_length_of_a_vector_is_worked_out_once(spark):
    rows = [(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None])]
    df = spark.createDataFrame(rows, "id long, v array<double>").select("id", semantics.unit(F.col("v")).alias("u"))
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("aggregate(") == 1
    got = {r["id"]: r["u"] for r in df.collect()}
    assert got == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: None, 4: [None, None]}


def test_terms_of_many_queries_are_counted_once(spark, monkeypatch):
    calls = []
    for module in (retrieval, lexical, semantics):
        monkeypatch.setattr(module, "query_counts", lambda q: calls.append(1) or terms.query_counts(q))
    corpus = spark.createDataFrame(DOCS, CORPUS)
    asked = spark.createDataFrame([(f"q{i}", f"w{i % 17} w{(3 * i) % 17} zzz", "REG_E") for i in range(20)], ASKED)
    projection = retrieval.fit_projection(corpus, 4)
    many = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in retrieval.hybrid_search(
        corpus, asked, projection, "queries").collect()}
    assert len(calls) == 1
    few = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in retrieval.hybrid_search(
        corpus, asked, projection).collect()}
    assert many.keys() == few.keys() and all(
        many[k][0] == few[k][0] and many[k][1] == pytest.approx(few[k][1], abs=1e-9) for k in few)


def test_requests_are_gathered_before_the_other_steps(spark, monkeypatch):
    seen = []
    stored = plan.stored
    monkeypatch.setattr(plan, "stored", lambda df, name: seen.append((name, df)) or stored(df, name))
    corpus = spark.createDataFrame(DOCS, CORPUS)
    cases = spark.createDataFrame(
        [("a", "Fraud or scam", "w1 w2", 1.0, "2024-10-28", "2024-11-01", "2024-11-20")],
        "complaint_id string, issue string, narrative string, disputed_amount double, transaction_date string, "
        "statement_date string, notice_date string")
    done = plan.triage(cases, F.to_date(F.lit("2025-06-01")), corpus, retrieval.fit_projection(corpus, 4))
    requests = next(df for name, df in seen if name == "requests")
    assert "implausibly" not in requests._jdf.queryExecution().optimizedPlan().toString()
    assert len(done.first()["sections"]) == 4


def test_copies_of_a_document_are_all_covered():
    import pyarrow as pa
    held = pa.table({
        "doc_id": ["a", "b", "a", "c"], "given": ["R", "R", "S", "R"], "title": [["x"], [], ["x", "y"], None],
        "terms": [["x", "y"], ["y"], ["z"], None], "idfs": [[1.0, 2.0], [2.0], [4.0], None]})
    asked = pa.table({
        "query_id": [1, 2, 3], "names": [["y", "x", "no"], [], ["z"]], "size": [3, 0, 1], "wanted": ["R", None, "R"],
        "total": [3.0, 0.0, 4.0], "candidates": [
            [{"doc_id": "a", "rank": 1}, {"doc_id": "c", "rank": 2}], [{"doc_id": "b", "rank": 1}],
            [{"doc_id": "gone", "rank": 1}, {"doc_id": "a", "rank": 2}]]})
    rows = retrieval._covered(asked, held).to_pylist()
    assert [(r["query_id"], r["doc_id"], r["given"], r["rank"], r["covered"], r["shared"]) for r in rows] == [
        (1, "a", "R", 1, 3.0, 1), (1, "a", "S", 1, 0.0, 2), (1, "c", "R", 2, 0.0, 0), (2, "b", "R", 1, 0.0, 0),
        (3, "a", "R", 2, 0.0, 0), (3, "a", "S", 2, 4.0, 0)]
    assert retrieval._covered(asked.slice(0, 0), held).num_rows == 0
    assert retrieval._covered(asked, held.slice(0, 0)).num_rows == 0
    assert np.isfinite(retrieval._covered(asked, held)["covered"].to_numpy()).all()
