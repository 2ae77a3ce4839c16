"""BM25 by blocks against the plain formula."""

import math
import random
from collections import Counter

import pytest

from remedia.operators import lexical

CORPUS = "id long, regulation string, title string, text string"
ASKED = "query_id string, query string"


def documents(n, seed=3):
    rng = random.Random(seed)
    return [(1000 + i, "R", "t", " ".join(
        f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(rng.randrange(0, 60))) + (" rare" * (i % 97 == 5)))
        for i in range(n)]


def brute(docs, asked, k, k1=1.2, b=0.7):
    tokens = [[t for t in f"{i} {r.lower()} {title}. {text}".replace(".", " ").split()] for i, r, title, text in docs]
    average = sum(map(len, tokens)) / len(tokens)
    df = Counter(t for d in tokens for t in set(d))
    out = {}
    for q, query in asked:
        scores = []
        for (i, *_), d in zip(docs, tokens, strict=True):
            tf = Counter(d)
            found = [t for t in set(query.split()) if t in tf]
            if found:
                scores.append((-round(sum(
                    math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (k1 + 1)
                    / (tf[t] + k1 * (1 - b + b * len(d) / average)) for t in found), 9), i))
        out |= {(q, rank): (i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)}
    return out


def rows(ranking):
    return {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in ranking.collect()}


@pytest.mark.parametrize("setting", [(1.2, 0.7), (2.0, 0.0), (0.5, 1.0)])
def test_blocks_give_the_same_ranking(spark, monkeypatch, setting):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 8)
    docs = documents(400)
    asked = [("a", "w1 w7 rare"), ("b", "w3 w3 w250"), ("c", "nowhere"), ("d", "rare w12 w13 w14 w15"), ("e", "w2")]
    corpus, queries = spark.createDataFrame(docs, CORPUS), spark.createDataFrame(asked, ASKED)
    got, want = rows(lexical.bm25(corpus, queries, 5, *setting)), brute(docs, asked, 5, *setting)
    assert got.keys() == want.keys()
    assert all(got[p][0] == want[p][0] and abs(got[p][1] - want[p][1]) < 1e-8 for p in want)
    many = rows(lexical.bm25(corpus, queries, 5, *setting, large="queries"))
    assert {p: (i, round(s, 9)) for p, (i, s) in many.items()} == {p: (i, round(s, 9)) for p, (i, s) in got.items()}


def test_blocks_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 4)
    docs = documents(400)
    index = lexical.build_index(spark.createDataFrame(docs, CORPUS).coalesce(1))
    queries = spark.createDataFrame([("a", "rare w5")], ASKED)
    found = lexical.search(index, queries, 3)
    read, skipped = found.scored.first(), found.skipped.first()
    assert read["blocks"] < skipped["blocks"] and read["blocks"] + skipped["blocks"] <= 100
    everything = index.postings.where("term IN ('rare', 'w5')").count()
    assert read["postings"] < everything
    got = rows(lexical.ranked(found.scores, 3))
    want = brute(docs, [("a", "rare w5")], 3)
    assert {p: v[0] for p, v in got.items()} == {p: v[0] for p, v in want.items()}


def test_a_saved_index_gives_the_same(spark, tmp_path):
    docs = documents(60)
    queries = spark.createDataFrame([("a", "w1 w2"), ("b", "rare")], ASKED)
    corpus = spark.createDataFrame(docs, CORPUS)
    lexical.save_index(lexical.build_index(corpus), str(tmp_path / "ix"))
    index = lexical.load_index(spark, str(tmp_path / "ix"))
    assert rows(lexical.bm25(None, queries, 4, index=index)).keys() == brute(docs, [("a", "w1 w2"), ("b", "rare")], 4).keys()


def test_empty_sides(spark):
    none = spark.createDataFrame([], CORPUS)
    asked = spark.createDataFrame([("a", "w1")], ASKED)
    assert lexical.bm25(none, asked, 3).count() == 0
    corpus = spark.createDataFrame(documents(5), CORPUS)
    assert lexical.bm25(corpus, spark.createDataFrame([], ASKED), 3).count() == 0
    nulls = spark.createDataFrame([(1, None, None, None), (2, "R", "t", "w1")], CORPUS)
    assert [r["doc_id"] for r in lexical.bm25(nulls, asked, 3).collect()] == [2]


def test_terms_counted_in_tasks_are_those_of_the_tokeniser(spark):
    from pyspark.sql import functions as F

    from remedia import policy
    from remedia.functions.text import tokenize
    from remedia.operators.terms import counted_terms, cuttable

    rng = random.Random(4)
    bits = [*policy.SYNONYMS, *list(policy.STOP_WORDS)[:9], "forty-five", "forty five", "60", "1005.11", "2.5.", "x9y", "É60",
            "naïve", "_30", "٣.٤", "9a.b", "İ", "thirty", "\n", "a.1", "Σας"]
    texts = [(i, "".join(rng.choice(bits) + rng.choice([" ", "", ".", "-", " "]) for _ in range(40))) for i in range(400)]
    df = spark.createDataFrame([*texts, (900, None), (901, "")], "id long, text string")
    want = {r[0]: Counter(r[1] or []) for r in df.select("id", tokenize(F.col("text"))).collect()}
    found = counted_terms(df.select("id", cuttable(F.col("text")).alias("text")), "id").collect()
    assert {r["id"]: Counter(dict(zip(r["terms"], r["counts"]))) for r in found} == want
    assert all(r["length"] == want[r["id"]].total() for r in found)


def test_many_queries_in_lots_and_parts(spark, monkeypatch):
    for name in ("LOT_TERMS", "PART_ROWS", "CELLS"):
        monkeypatch.setattr(lexical, name, 60)
    docs = documents(120)
    asked = [(f"q{i}", " ".join(t for t in docs[i][3].split()[:i % 12])) for i in range(60)] + [("none", "nowhere"), ("null", None)]
    corpus, queries = spark.createDataFrame(docs, CORPUS), spark.createDataFrame(asked, ASKED)
    made = []
    monkeypatch.setattr(lexical, "stored", lambda df, name, keep=lexical.stored: made.append(keep(df, name)) or made[-1])
    got, want = rows(lexical.bm25(corpus, queries, 3, large="queries")), brute(docs, [(q, t or "") for q, t in asked], 3)
    assert {p: v[0] for p, v in got.items()} == {p: v[0] for p, v in want.items()}
    # a row a query, none for a term that it shares with a document
    assert max(m.count() for m in made if "query_id" in m.columns) == len(asked)
