"""Text models fitted together, against dense numpy and against fits on their own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from remedia.operators import models, trials
from remedia.operators.models import TextParams

SCHEMA = "id long, part int, label string, text string"
WORDS = ["refund", "card", "late", "fee", "loan", "court", "letter", "paid", "never", "again"]


def corpus(n=240):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        kind = i % 3
        words = rng.choice(WORDS[kind * 3:kind * 3 + 4] + WORDS, size=int(rng.integers(1, 14)))
        rows.append((i, i % 4, "abc"[kind], " ".join(words)))
    return rows + [(900, 0, "a", None), (901, 1, None, "refund card"), (902, None, "b", "late fee"), (903, 0, "c", "")]


def dense(rows, spec):
    """The objective's minimum by plain descent over dense vectors, and the vocabulary with its weights."""
    import collections
    import re
    worded = [(p, y, re.findall(r"\b\w\w+\b", t or "")) for _, p, y, t in rows]
    if spec.params.ngram_high == 2:
        worded = [(p, y, w + [f"{a} {b}" for a, b in zip(w, w[1:])]) for p, y, w in worded]
    own = [r for r in worded if r[0] in spec.fit and r[1] is not None]
    cf, df = collections.Counter(), collections.Counter()
    for _, _, w in own:
        cf.update(w)
        df.update(set(w))
    terms = sorted([t for t in cf if df[t] >= spec.params.min_df], key=lambda t: (-cf[t], t))[:spec.params.max_features]
    idf = {t: np.log((1 + len(own)) / (1 + df[t])) + 1 for t in terms}

    def vector(w):
        n = collections.Counter(w)
        v = np.array([(1 + np.log(n[t])) * idf[t] if n[t] else 0.0 for t in terms])
        return np.append(v / (np.linalg.norm(v) or 1.0), 1.0)

    classes = sorted({y for _, y, _ in worded if y})
    x = np.array([vector(w) for _, _, w in own])
    y = np.eye(len(classes))[[classes.index(k) for _, k, _ in own]]
    weight = np.ones(len(own))
    if spec.params.balanced:
        weight = (len(own) / len(classes) / y.sum(0))[y.argmax(1)]
    lam = np.full((len(terms) + 1, 1), 1 / (spec.params.C * len(own)))
    lam[-1] = 0

    def value(w):
        z = x @ w
        z -= z.max(1, keepdims=True)
        log_p = z - np.log(np.exp(z).sum(1, keepdims=True))
        slope = x.T @ ((np.exp(log_p) - y) * weight[:, None]) / len(own) + lam * w
        return -(weight * (log_p * y).sum(1)).sum() / len(own) + 0.5 * (lam * w * w).sum(), slope

    w = np.zeros((x.shape[1], len(classes)))
    before, t = w, 1.0
    for _ in range(4000):
        ahead = w + (t - 1) / (t + 2) * (w - before)
        before, w, t = w, ahead - value(ahead)[1], t + 1
    shares = {}
    for (i, p, _, _), (_, _, words) in zip(rows, worded):
        z = vector(words) @ w
        shares[i] = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    return value(w)[0], set(terms), shares


def test_models_fitted_together_reach_the_dense_minimum(spark):
    rows = corpus()
    specs = [trials.Spec(TextParams(C=1.0, min_df=2, max_features=100), frozenset({0, 1, 2})),
             trials.Spec(TextParams(C=5.0, min_df=1, max_features=25, ngram_high=2, balanced=True), frozenset({1, 3})),
             trials.Spec(TextParams(C=0.3, min_df=1, max_features=4), frozenset({0}))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    features = trials.store_features(df, "text", "label", F.col("part"), specs, ["id"])
    fit = trials.Fit(features)
    fit.run(60)
    got = {(r["model"], r["id"]): r["probabilities"] for r in fit.scores(lambda s, p: True).collect()}
    for m, spec in enumerate(specs):
        least, terms, shares = dense(rows, spec)
        assert {t for t, s in zip(features.terms, features.scales[m]) if s} == terms
        assert fit.walks[m].f == pytest.approx(least, abs=1e-6)
        assert (m, 902) not in got  # no part: judged by nobody
        for i, want in shares.items():
            if i != 902:
                assert got[m, i] == pytest.approx(list(want), abs=2e-3)


def test_search_uses_every_parameter_and_repeats(spark):
    rows = [(i, p, y, t) for i, p, y, t in corpus() if p is not None]
    df = spark.createDataFrame(rows, SCHEMA).withColumn(
        "split", F.when(F.col("part") < 2, "train").when(F.col("part") == 2, "validation").otherwise("test"))
    space = [(n, lo, 12 if n == "max_features" else hi, k) if n != "max_features" else (n, 3, 40, k)
             for n, lo, hi, k in models.TEXT_SPACE]
    best, table = trials.search(df, "text", "label", "split", space, 5, 3, (2, 3, 4))
    found = table.orderBy("trial").collect()
    assert [r["trial"] for r in found] == list(range(5)) and [r["chosen"] for r in found].count(True) == 1
    assert sorted(r["rung"] for r in found) == [0, 0, 0, 1, 2]
    assert all(set(r["params"]) == {n for n, *_ in space} for r in found)
    top = next(r for r in found if r["chosen"])
    assert top["rung"] == 2 and best.C == top["params"]["C"] and top["score"] > 0.5
    again = trials.search(df.repartition(7), "text", "label", "split", space, 5, 3, (2, 3, 4))[1]
    assert again.orderBy("trial").collect() == found


def test_scores_come_from_models_that_saw_no_copy(spark):
    """A word that marks one text's copies alone can't tell their label; general words can."""
    rng = np.random.default_rng(1)
    rows = [(i, 0, str(i % 2), " ".join(rng.choice(WORDS[:5] if i % 2 else WORDS[5:], 6))) for i in range(200)]
    rows += [(1000 + i, 0, "1", "unheard") for i in range(30)] + [(2000, 0, None, "refund card late")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = trials.out_of_fold(df, "text", "label", "1", ["id"], TextParams(min_df=1), passes=15)
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == len(rows) and out.columns == ["id", "fold", "label", "score"]
    assert len({got[1000 + i]["fold"] for i in range(30)}) == 1
    assert {round(got[1000 + i]["score"], 9) for i in range(30)} == {round(got[1000]["score"], 9)}
    held = [(got[i]["score"] > 0.5) == bool(i % 2) for i in range(200)]
    assert sum(held) >= 198 and got[2000]["label"] is None and got[2000]["score"] > 0.5
    # the copies' own fold is judged by the share of classes, as if the word did not exist
    assert got[1000]["score"] < 0.75


def test_empty_and_one_class(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert trials.out_of_fold(none, "text", "label", "1", ["id"]).count() == 0
    one = spark.createDataFrame([(1, 0, "1", "refund"), (1, 0, "1", "refund"), (2, 0, "1", "late")], SCHEMA)
    assert [r["score"] for r in trials.out_of_fold(one, "text", "label", "1", ["id"]).collect()] == [1.0] * 3


def test_both_splits_are_judged_over_one_feature_table(spark, monkeypatch):
    rows = [(i, "test" if i % 5 == 0 else "train", y, t) for i, _, y, t in corpus()]
    df = spark.createDataFrame(rows, "id long, split string, label string, text string").repartition(5)
    tables, store = [], trials.store_features
    monkeypatch.setattr(trials, "store_features", lambda *a: tables.append(1) or store(*a))
    params = TextParams(C=1.0, min_df=1, max_features=30)
    got = {r[0]: r[1] for r in trials.temporal_penalty(df, "id", "text", "label", params, 8).collect()}
    assert len(tables) == 1
    alone = {"temporal": df, "random": models.random_split(df, "id")}
    for name, split in alone.items():
        report = trials.issue_report(split, params, "text", "label", 8).first()
        assert got[name] == pytest.approx(report["balanced_accuracy"], abs=0.02) and report["classes"] == 3
    assert report["rows"] == models.random_split(df, "id").where("split = 'test' AND label IS NOT NULL").count()
