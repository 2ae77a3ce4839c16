import random
from collections import Counter

import numpy as np
import pytest

from remedia.llm import language, quality, toxicity
from remedia.llm.common import SPACE
from remedia.llm.near_dedup import Shingler

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype("f8") for k, v in language.initial(3).items()}
    codes, labels = rng.integers(60, 70, (5, 4)), np.array([0, 1, 2, 1])
    _, g = language.gradients(p, codes, labels)
    for k in p:
        for at in list(zip(*np.nonzero(np.abs(g[k]) > 1e-4), strict=True))[:6]:
            for_sign = []
            for e in (1e-2, -1e-2):
                q = {n: v.copy() for n, v in p.items()}
                q[k][at] += e
                for_sign.append(language.gradients(q, codes, labels)[0])
            assert g[k][at] == pytest.approx((for_sign[0] - for_sign[1]) / 2e-2, rel=0.05, abs=2e-4)


def lang_docs(n=240):
    rng = random.Random(0)
    parts = {"aa": ["tha", "ing", "wer", "oth"], "bb": ["ção", "ñue", "los", "iez"]}
    return [(i, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(rng.randrange(4, 300))), lang, "s", 1)
            for i in range(n) for lang in [("aa", "bb")[i % 2]]]


def test_language(spark):
    odd = [(900, None, "aa", "s", 1), (901, "", None, None, None), (902, "123 ...", "bb", "s", 1), (None, "thaing", "aa", "s", 1)]
    frame = spark.createDataFrame(lang_docs() + odd, DOCS)
    model = language.learn(frame, steps=200)
    got = {r.doc_id: r for r in language.identify(frame, model).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang, _, _ in lang_docs()]) > 0.95
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[None].lang_pred in ("aa", "bb")
    assert all(0 <= r.score <= 1 for r in got.values())
    text = "thaing werothing " * 30 + "çãoñue losiez " * 30
    spans = language.spans(text, model)
    assert spans[0][0] == 0 and spans[-1][1] == len(text.encode()) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert {"aa", "bb"} == {s[2] for s in spans}
    # Windows don't change what a position is labelled.
    whole = model.label([text.encode()])[0]
    assert whole.shape == (len(text.encode()), 2) and np.allclose(whole.sum(1), 1, atol=1e-3)
    assert language.identify(frame.limit(0), model).count() == 0
    assert {r.lang_pred for r in language.identify(frame, language.learn(frame.limit(0))).collect()} == {"und"}


def test_restoring():
    counts = np.zeros((toxicity.PLACES,) * 3)
    text = "the idiot said hello to the clown and the stupid loser sat still " * 50
    table = np.zeros(65536, "i4")
    table[[ord(c) for c in toxicity.LETTERS]] = range(1, len(toxicity.LETTERS) + 1)
    codes = toxicity._codes("\n\n" + text, table)
    np.add.at(counts, (codes[:-2], codes[1:-1], codes[2:]), 1)
    r = toxicity.Restorer(counts)
    for word, want in {"1d10t": "idiot", "idiooooot": "idiot", "i.d.i.o.t": "idiot", "st@pid": "stapid", "$tupid": "stupid",
                       "c|own!!": "clown", "hello": "hello", "l0ser,": "loser", "still": "still", "": "", "***": "", "2024": "2024"}.items():
        if want != "stapid":
            assert r.restore(word) == want, word
    f = toxicity.Features(r)
    assert "idiot" in f.words("an i d i o t here") and f("") == []


def test_toxicity(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    docs, labels = [], []
    for i in range(600):
        ws = [rng.choice(words) for _ in range(40)]
        if i % 6 == 0:
            ws[rng.randrange(40)] = ["idiot", "1d10t", "idiooot"][i // 6 % 3]
        docs.append((i, " ".join(ws), "aa", "s", 1))
        labels.append((i, 1, int(i % 6 == 0)))
    docs += [(700, None, None, None, None), (701, "", "aa", "s", 1), (None, "idiot", "aa", "s", 1)]
    frame = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS score", "2 AS feature")
    marks = spark.createDataFrame([*labels, (701, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(frame, marks)
    got = {r.doc_id: r.score for r in toxicity.scores(frame, model, "doc_id").collect()}
    assert all((got[i] >= 0.7) == bool(y) for i, _, y in labels)
    assert got[700] == got[701] < 0.7 <= got[None]
    assert toxicity.scores(frame.limit(0), model, "doc_id").count() == 0
    empty = toxicity.learn(frame, marks.limit(0))
    assert {r.score for r in toxicity.scores(frame, empty, "doc_id").collect()} == {0.0}


def brute_measure(text):
    ws = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if x.strip(SPACE) and x in lines[:i])
    grams = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    times = Counter(grams)
    inside = {j for i, g in enumerate(grams) if times[g] > 1 for j in range(i, i + 3)}
    return len(ws), sum(map(len, ws)), sum(c in quality.SYMBOLS for c in text), dup, len(inside), len(lines)


def test_measures():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b ", "é", "\n", " ", "#", "$ ", "\t", "a b c ", "x\n", " "]) for _ in range(rng.randrange(0, 60)))
        assert quality.measure(text, Shingler(3)) == brute_measure(text), text


def test_quality(spark):
    rng = random.Random(5)
    good = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(80)), "aa", f"s{i % 2}", 1) for i in range(500)]
    bad = [(1000 + i, " ".join(f"w{rng.randrange(5000)}###" for _ in range(80)), "aa", "s0", 1) for i in range(40)]
    odd = [(2000, None, None, None, None), (2001, "", "aa", "s0", 0), (2002, "same same " * 200, "aa", "s1", 1),
           (None, good[0][1], None, "s9", 1), (5, good[5][1], "aa", "s1", 1)]
    frame = spark.createDataFrame([*good, *bad, *odd], DOCS).selectExpr("*", "1 AS k1", "2 AS n_words", "3 AS kept")
    rows = quality.judge(frame).collect()
    kept = sorted((r.doc_id for r in rows if r.kept), key=str)
    want = sorted([*[d[0] for d in good], 5, None], key=str)
    assert len(rows) == 545 and kept == want
    out = quality.keep_good(frame)
    assert out.columns == frame.columns and sorted((r.doc_id for r in out.collect()), key=str) == want
    assert quality.keep_good(frame.limit(0)).count() == 0


@pytest.mark.parametrize("share", [30, 40])
def test_quality_of_a_source_with_many_bad_documents(spark, share):
    rng = random.Random(share)

    def text(sign):
        return " ".join(f"w{rng.randrange(5000)}{sign}" for _ in range(80))

    docs = [(i, text("###" if i % 100 < share else ""), "aa", "hot", 1) for i in range(600)]
    docs += [(1000 + i, text("###" if i % 100 < share else ""), "bb", "few", 1) for i in range(100)]
    rows = quality.judge(spark.createDataFrame(docs, DOCS)).collect()
    assert {r.doc_id for r in rows if r.kept} == {d[0] for d in docs if d[0] % 100 >= share}


def test_fences_follow_group_sizes_without_a_switch(spark):
    def fence(n):
        rows = [("aa", s, False, 0.2 + 0.0005 * (i % 100) * (1 + 9 * (s == "a")), 0.0, 0.0, 5.0)
                for s, k in (("a", n), ("b", 2000)) for i in range(k)]
        frame = spark.createDataFrame(rows, "lang string, source string, base_failed boolean, symbol_ratio double, "
                                            "repeat_ratio double, dup_line_ratio double, word_length double")
        return {r.source: r.fence_symbol_ratio for r in quality.fences(frame).collect()}["a"]

    assert abs(fence(200) - fence(199)) < 0.05


def character_model(text):
    counts, table = np.zeros((toxicity.PLACES,) * 3), np.zeros(65536, "i4")
    table[[ord(c) for c in toxicity.LETTERS]] = range(1, len(toxicity.LETTERS) + 1)
    codes = toxicity._codes("\n\n" + text, table)
    np.add.at(counts, (codes[:-2], codes[1:-1], codes[2:]), 1)
    return toxicity.Restorer(counts)


def test_disguises_of_any_length_and_sign():
    r = character_model("what a stupid man you are and i said a clown is a stupid loser or a man " * 50)
    for word in ("s/t/u/p/i/d", "s,t,u,p,i,d", "s:t:u:p:i:d", "s't'u'p'i'd", "st" + "u" * 100 + "pid",
                 "s" + "." * 80 + "tupid"):
        assert r.restore(word) == "stupid", word
    assert r.restore("stupid/loser") == "stupid loser"
    f = toxicity.Features(r)
    for text, first in (("what a s t u p i d man", "a"), ("said i s t u p i d", "i")):
        assert {first + " stupid"} <= {r.restore(w) for w in f.words(text)}
        assert "stupid$" in {p for parts in f(text) for p in parts}
    assert {"stupid$", "loser$"} <= {p for parts in f("s t u p i d l o s e r") for p in parts}
