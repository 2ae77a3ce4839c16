import hashlib
import random

import pytest
from pyspark.sql import functions as F

from remedia.llm.fingerprint import LANES, combine, compare_edited, fingerprints

SCHEMA = "doc_id long, text string"


def expected(docs):
    rows = sorted(docs, key=lambda d: -d[0])
    out = {}
    for i, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        out[doc_id] = (len(text), hashlib.sha256(edited.encode()).hexdigest())
    return out


@pytest.mark.parametrize("n", [1, 2, 7, 300])
def test_successors_and_edits(spark, n):
    rng = random.Random(n)
    docs = [(i * 3 - 50, "".join(rng.choice("aé b.\n🙂") for _ in range(rng.randrange(0, 60)))) for i in range(n)]
    rng.shuffle(docs)
    frame = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 AS range", "2 AS n", "3 AS x0", "true AS ghost")
    got = {r.doc_id: r for r in compare_edited(frame).collect()}
    want = expected(docs)
    assert set(got) == set(want)
    for doc_id, (size, sha) in want.items():
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (size, sha)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    if n == 1:
        assert got[-50].near_next == 1.0


def test_equal_texts_nulls_and_repeats(spark):
    docs = [(1, "a b c\nd"), (2, "a b c\nd"), (2, "a b c\nd"), (3, None), (4, ""), (None, "x"), (None, None)]
    rows = compare_edited(spark.createDataFrame(docs, SCHEMA)).collect()
    assert len(rows) == len(docs)
    assert len({r.fingerprint for r in rows if r.n_chars == 7}) == 1
    assert len({r.fingerprint for r in rows if r.n_chars == 0}) == 1
    assert len({r.fingerprint for r in rows}) == 3
    assert compare_edited(spark.createDataFrame([], SCHEMA)).count() == 0


def test_order_and_updates(spark):
    def lanes(*texts):
        rows = fingerprints(spark.createDataFrame([(1, t) for t in texts], SCHEMA), "doc_id").collect()
        return tuple(rows[0][c] for c in LANES)

    assert lanes("one two three\nfour\n\nfive") == lanes("five\n\none two three\nfour")
    assert lanes("one\ntwo") != lanes("one\ntwo\ntwo")
    a, b, both = (fingerprints(spark.createDataFrame([(1, t)], SCHEMA), "doc_id").select(
        F.col("doc_id"), *[F.col(c).alias(p + c) for c in LANES])
        for p, t in (("a", "one two three four"), ("b", "five\nsix"), ("c", "six\none two three four\nfive")))
    row = a.join(b, "doc_id").join(both, "doc_id")
    named = {p: {c: F.col(p + c) for c in LANES} for p in "abc"}
    up = combine(named["a"], named["b"])
    down = combine(named["c"], named["b"], -1)
    r = row.select(*[(up[c] == F.col("c" + c)).alias("u" + c) for c in LANES],
                   *[(down[c] == F.col("a" + c)).alias("d" + c) for c in LANES]).first()
    assert all(r)


def test_likeness_follows_what_is_shared(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    docs = [(i, "\n".join(" ".join(rng.choice(words) for _ in range(30)) for _ in range(12))) for i in range(40)]
    rows = compare_edited(spark.createDataFrame(docs, SCHEMA)).collect()
    assert sum(r.near_edited for r in rows) / 40 > 0.35
    assert sum(r.near_next for r in rows) / 40 < 0.15


@pytest.mark.parametrize("n", [70_000, 131_072])
def test_likeness_of_very_long_texts(spark, n):
    rng = random.Random(n)
    docs = [(i, " ".join(map(str, rng.choices(range(10**6), k=n)))) for i in range(3)]
    rows = compare_edited(spark.createDataFrame(docs, SCHEMA)).collect()
    assert all(r.near_next < 0.5 and 0.2 < r.near_edited < 0.9 for r in rows)
