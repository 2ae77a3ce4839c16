import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from remedia.llm.packing import best_fit, pack, plan
from remedia.llm.tokens import LATIN_WORD, tokenizer, vocabulary, word_encoder

PATH = vocabulary("word_bpe_49k.json")


def direct(text):
    return tokenizer(PATH).encode(text, add_special_tokens=False).ids


def test_words_like_the_library():
    enc, rng = word_encoder(PATH), random.Random(3)
    latin = [c for c in map(chr, range(0x250)) if LATIN_WORD.fullmatch(c)]
    texts = ["".join(rng.choice("etaoinshrdlu'.,-0123") for _ in range(rng.randrange(1, 14))) for _ in range(4000)]
    texts += ["".join(rng.choice(latin) for _ in range(rng.randrange(1, 9))) for _ in range(4000)]
    texts += ["a<|endoftext|>b", "日本語", "éa", "don't've", "\x00x", "\x01", "a b", "ΣΑΣ", "x\x1cy", "İ", "'s", "aaaa" * 200]
    for text in texts:
        for word in text.encode().split():
            ids = np.frombuffer(enc.learn({word})[word], "<u4").tolist()
            assert ids == direct(word.decode()), word
    many = {w for t in texts for w in t.encode().split()}
    enc.known.clear()
    known = enc.learn(many)
    assert all(np.frombuffer(known[w], "<u4").tolist() == direct(w.decode()) for w in many)


def test_every_token_encodes_to_itself():
    for token, i in tokenizer(PATH).get_vocab(with_added_tokens=False).items():
        if token.endswith("</w>") and token[:-4].isascii() and token[:-4].isalpha() and token.islower():
            assert direct(token[:-4]) == [i]


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    size = 32
    have = rng.integers(0, 40, size + 1) * (rng.random(size + 1) < 0.6)
    have[0] = 0
    used = np.zeros(size + 1, int)
    for pattern, count in plan(have, size):
        assert sum(pattern) <= size and count > 0
        for x in pattern:
            used[x] += count
    assert (used == have).all()
    total = int((have * np.arange(size + 1)).sum())
    assert sum(c for _, c in plan(have, size)) <= 1.25 * -(-total // size) + 1


def test_exact_complements_first():
    have = np.zeros(11, int)
    have[[6, 4, 3, 1]] = [2, 1, 1, 1]
    assert sorted(sorted(p) for p, _ in plan(have, 10)) == [[1, 3, 6], [4, 6]]


def check(rows, docs, size):
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    assert set(by_doc) == set(docs)
    for doc_id, text in docs.items():
        ids = np.array([*direct(text or ""), 0], "<u4")
        mine = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(-(-len(ids) // size)))
        for r in mine:
            assert r.start == r.piece * size and r.length == len(ids[r.start:r.start + size])
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + size].tobytes())
    for rows in bins.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size


def test_best_fit(spark):
    rng = random.Random(2)
    docs = {i: " ".join(rng.choice(["the", "cat.", "zyx", "été", "12"]) for _ in range(rng.randrange(0, 90)))
            for i in range(300)}
    docs |= {1000: None, 1001: "", 1002: "word " * 3000, None: "no id"}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").selectExpr("*", "1 AS length", "2 AS rank")
    check(best_fit(frame, PATH, 64).collect(), docs, 64)
    assert best_fit(frame.limit(0), PATH, 64).count() == 0


def test_repeated_rows_and_a_hot_length(spark):
    frame = spark.createDataFrame([(7, "a b c")] * 900, "doc_id long, text string")
    rows = best_fit(frame, PATH, 16).collect()
    assert len(rows) == 900 and len({(r.sequence_id, r.offset) for r in rows}) == 900
    assert len({r.sequence_id for r in rows}) == 225


def test_pack_keeps_columns(spark):
    cut = spark.createDataFrame([(1, 0, 0, 5, 9)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    assert pack(cut, 8).columns == [*cut.columns, "sequence_id", "offset"]
