import random

import numpy as np
import pytest

from remedia.llm.common import lower_words
from remedia.llm.near_dedup import Rule, Shingler, components, keep_one, near_duplicates

RULE = Rule(3, 85)
SCHEMA = "doc_id long, text string"


def brute(docs, rule=RULE):
    sets = {}
    for i, (_, text) in enumerate(docs):
        w = lower_words(text)
        k = min(rule.width, len(w))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if w else set()
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= rule.percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i in sets:
        groups.setdefault(find(i), []).append(i)
    out = []
    for i, (doc_id, _) in enumerate(docs):
        ids = [docs[m][0] for m in groups[find(i)] if docs[m][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids, default=None), doc_id == min(ids, default=None)))
    return out


def corpus(seed=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 120))) for _ in range(80)]
    for base in docs[:25]:
        for _ in range(rng.randrange(1, 6)):
            w = base.split()
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            docs.append((" " if rng.random() < 0.3 else "\n").join(w).upper() if rng.random() < 0.3 else " ".join(w))
    hub = " ".join(rng.choice(words) for _ in range(100)).split()
    for _ in range(60):
        w = list(hub)
        w[rng.randrange(100)] = rng.choice(words)
        docs.append(" ".join(w))
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", [0, 1])
def test_same_as_all_pairs(spark, seed):
    docs = corpus(seed) + [(900, None), (901, ""), (902, " \n "), (None, "w1 w2 w3"), (903, "W1 w2 w3"),
                           (904, "w9"), (905, "w9"), (905, "w9"), (906, "x y"), (907, "long " * 9000)]
    frame = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 AS node", "2 AS k1", "3 AS label")
    got = [tuple(r) for r in near_duplicates(frame, RULE).collect()]
    want = [(a, n, c, a == c) for a, n, c, _ in brute(docs)]
    want = [(a, n, a, True) if n == 0 else (a, n, c, k) for a, n, c, k in want]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA), RULE).count() == 0


def test_chain_of_links(spark):
    edges = [(bytes([0, i]), bytes([0, i + 1])) for i in range(200)] + [(b"\x05", b"\x04")]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a binary, b binary")).collect()))
    assert {bytes(got[k]) for k in got if len(k) == 2} == {b"\0\0"} and bytes(got[b"\x05"]) == b"\x04"


def test_shingles_are_sets():
    s = Shingler(3)
    assert len(s([b"a"] * 9)) == 1 and len(s([b"a", b"b"])) == 1 and len(s([])) == 0
    assert len(np.intersect1d(s([b"a", b"b"]), s([b"a", b"b", b"c"]))) == 0


def test_one_of_each_stays(spark):
    docs = [(3, "a b c d e f"), (1, "A b c d e f"), (1, "A b c d e f"), (2, None), (4, ""), (None, "z z z"), (None, "Z z z"), (5, "q")]
    frame = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "doc_id AS node", "'x' AS lang")
    out = keep_one(frame, Rule())
    assert out.columns == frame.columns
    ids = sorted((r.doc_id for r in out.collect()), key=str)
    assert ids == sorted([1, 2, 4, None, 5], key=str)


def test_components_of_chains_and_later_links(spark):
    rng = np.random.default_rng(3)
    names = [rng.bytes(8) for _ in range(300)]
    first = [(names[i], names[i + 1]) for i in range(199)] + [(names[i], names[i + 1]) for i in range(210, 250)]
    later = [(names[150], names[230]), (names[260], names[261])]

    def frame(links):
        return spark.createDataFrame([(min(x), max(x)) for x in links], "a binary, b binary")

    before = components(frame(first))
    got = {bytes(r["node"]): bytes(r["label"]) for r in components(frame(later), before).collect()}
    one, other = names[:200] + names[210:251], names[260:262]
    assert got == {**{n: min(one) for n in one}, **{n: min(other) for n in other}}


def test_dense_family_below_the_threshold(spark):
    """Neighbours of the forest are other members of the family; the few alike enough stand far apart."""
    rng = random.Random(11)
    def member(at, name):
        return " ".join(f"{name}x{i}" if i in at else f"t{i}" for i in range(300))

    docs = []
    for i in range(500):
        at = rng.sample(range(2, 298, 4), 8)
        docs.append(member(at, f"f{i}"))
        if i < 40:
            docs.append(member(at, f"p{i}"))
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    want = [(a, n, c, k) for a, n, c, k in brute(docs)]
    assert sum(not k for *_, k in want) == 40
    got = [tuple(r) for r in near_duplicates(spark.createDataFrame(docs, SCHEMA), RULE).collect()]
    assert sorted(got) == sorted(want)
