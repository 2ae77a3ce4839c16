"""Tokens, retrieval, letters, verification and the case chain."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from remedia.functions.text import tokenize
from remedia.operators import letters, retrieval
from remedia.plans import triage as plan

SECTIONS = [
    ("E-1", "REG_E", "Unauthorized transfers", "A bank must investigate an unauthorized debit. More."),
    ("E-2", "REG_E", "Provisional credit", "Credit is due within ten business days. More text."),
    ("Z-1", "REG_Z", "Billing errors", "A card issuer shall resolve a billing error in 90 days."),
    ("F-1", "FCRA", "Reinvestigation", "An agency shall reinvestigate a disputed report item."),
]


def tokens(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(tokenize(F.col("t"))).first()[0]


def test_tokens(spark):
    assert "60" in tokens(spark, "sixty days") and "sixty" in tokens(spark, "60 days")
    assert Counter(tokens(spark, "sixty"))["sixty"] == 2
    assert tokens(spark, "1005.11(c) cap") == ["1005.11", "1005", "11", "c", "cap", "liability",
                                               "exceed"]
    assert tokens(spark, "forty five") == ["forty", "five", "5", "45", "forty", "five", "5"]
    assert tokens(spark, "été of the") == ["t"]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(SECTIONS, "id string, regulation string, title string, text string")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(
        [("q1", "unauthorized debit on my card", "REG_E"), ("q2", "billing error days", "REG_Z"),
         ("q3", "nothing relevant zzz", None)],
        "query_id string, query string, regulation string")


def test_bm25_matches_the_formula_both_ways(spark, corpus, queries):
    docs = {i: tokens(spark, f"{i} {r} {t}. {x}") for i, r, t, x in SECTIONS}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    want = {}
    for q in queries.collect():
        for term in set(tokens(spark, q["query"])):
            df = sum(term in d for d in docs.values())
            if not df:
                continue
            idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
            for i, d in docs.items():
                tf = d.count(term)
                if tf:
                    want[q["query_id"], i] = want.get((q["query_id"], i), 0) + idf * tf * 2.2 / (
                        tf + 1.2 * (0.3 + 0.7 * len(d) / avg))
    for large in ("corpus", "queries"):
        got = {(r["query_id"], r["doc_id"]): r["score"] for r in retrieval.bm25(
            corpus, queries, large=large).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_fusion_is_symmetric(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "query_id string, doc_id string, rank int")
    b = spark.createDataFrame([("q", "y", 1), ("q", "z", 2)], "query_id string, doc_id string, rank int")
    one = [(r["doc_id"], round(r["score"], 12)) for r in retrieval.rrf([a, b]).orderBy("rank").collect()]
    two = [(r["doc_id"], round(r["score"], 12)) for r in retrieval.rrf([b, a]).orderBy("rank").collect()]
    assert one == two and one[0][0] == "y"


def test_hybrid_prefers_the_governing_regulation(corpus, queries):
    projection = retrieval.fit_projection(corpus)
    for large in ("corpus", "queries"):
        top = {r["query_id"]: r["doc_id"] for r in retrieval.hybrid_search(
            corpus, queries, projection, large).where("rank = 1").collect()}
        assert top["q1"] == "E-1" and top["q2"] == "Z-1"


def test_index_round_trip(spark, corpus, queries, tmp_path):
    retrieval.save_index(retrieval.build_index(corpus), str(tmp_path / "ix"))
    stored = retrieval.load_index(spark, str(tmp_path / "ix"))
    row = lambda df: sorted((r["query_id"], r["doc_id"], round(r["score"], 9)) for r in df.collect())
    assert row(retrieval.bm25(corpus, queries, index=stored)) == row(retrieval.bm25(corpus, queries))


def check(spark, text, dues=(("investigation", "2024-12-05"),)):
    df = spark.createDataFrame([(text,)], "t string")
    deadlines = F.struct(F.array(*[
        F.struct(F.lit(n).alias("name"), F.to_date(F.lit(d)).alias("due")) for n, d in dues]
    ).alias("deadlines"))
    return df.select(letters.verify(F.col("t"), deadlines, F.array(F.lit("1005.11(c)(1)"))).alias(
        "v")).first()["v"]


def test_verifier(spark):
    bad = check(spark, "The institution must respond within ten business days [reg:MADE-UP].")
    assert not bad["passed"] and bad["unresolved"] == ["MADE-UP"]
    bad = check(spark, "It must conclude within ten days by 2024-12-31 [reg:1005.11(c)(1)].")
    assert bad["invented_dates"] == ["2024-12-31"]
    good = check(spark, "The investigation must conclude by 2024-12-05 [calc:investigation] "
                        "[reg:1005.11(c)(1)].")
    assert good["passed"] and good["citations"] == 2
    bare = check(spark, "Short one. The bank is required to finish all of its work by then.")
    assert len(bare["uncited_claims"]) == 1


DISPUTE = ("complaint_id string, issue string, narrative string, disputed_amount double, "
           "transaction_date string, statement_date string, notice_date string, "
           "provisional_credit_given boolean, account_opened string")
BASE = ("Fraud or scam", "they took money", 120.0, "2024-10-28", "2024-11-01")


def test_case_chain(spark, corpus):
    rows = [("ok", *BASE, "2024-11-20", True, None), ("late", *BASE, "2025-03-01", True, None),
            ("new", *BASE, "2024-11-20", False, "2024-11-05"),
            ("none", None, *BASE[1:], "2024-11-20", True, None),
            (None, *BASE, "2024-11-20", True, None)]
    rows += [(f"copy{i}", *BASE, "2024-11-20", True, None) for i in range(50)]
    df = spark.createDataFrame(rows, DISPUTE)
    valid = F.array(*[F.lit(x) for x in (
        "1005.11(b)", "1005.11(c)(1)", "1005.11(c)(2)", "1005.11(c)(3)", "1005.11(d)", "E-1", "E-2",
        "Z-1", "F-1")])
    cases = plan.triage(df, F.to_date(F.lit("2025-06-01")), corpus,
                        retrieval.fit_projection(corpus), valid).cache()
    got = {r["complaint_id"]: r for r in cases.collect()}
    assert len(got) == len(rows) and "unassigned" in got
    assert got["ok"]["path"] == [*plan.STEPS, "draft", "verify", "route"]
    assert got["ok"]["verification"]["passed"] and got["ok"]["queue"] == "auto_send"
    assert len(got["ok"]["sections"]) == 4 and got["copy7"]["sections"] == got["ok"]["sections"]
    assert "after the notice period closed" in got["late"]["letter"]
    assert got["new"]["attempts"] == 3 and got["new"]["queue"] == "manual_review"
    assert got["new"]["letter"].endswith(
        "<!-- revised after review: 1 factual sentence(s) with no citation -->")
    assert got["none"]["queue"] == "manual_review" and got["none"]["letter"] is None
    assert plan.required_stages_met(cases).first()["violations"] == 0
    dues = {d["due"].isoformat() for d in got["ok"]["deadlines"]["deadlines"]}
    assert check(spark, got["ok"]["letter"], [("x", d) for d in dues])["invented_dates"] == []
