import hashlib
import random
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from remedia.llm.bpe import TreeEncoder, encode_digests
from remedia.llm.tokens import LATIN, tokenizer, vocabulary

PATH = vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def small():
    return TreeEncoder(PATH, leaf=8, window=2)


def direct(text):
    return tokenizer(PATH).encode(text, add_special_tokens=False).ids


def random_text(rng, n):
    parts = ["the ", "Thread", "  ", "\n", "\n\n ", "'s", "'ll", "don't", "12345", "é", "ß", "日本語", "🙂",
             "<|endoftext|>", "<|endof", "text|>", "aaaa", "===", "!!'", " \t", " ", " x", "\x1c", "é"]
    return "".join(rng.choice(parts) for _ in range(n))


def test_random_texts(small):
    rng = random.Random(5)
    texts = [random_text(rng, rng.randrange(1, 120)) for _ in range(400)]
    for text, coded in zip(texts, small.encode_many(texts), strict=True):
        assert coded.ids.tolist() == direct(text), text
        assert small.decode(coded.ids) == tokenizer(PATH).decode(direct(text), skip_special_tokens=False)


@pytest.mark.parametrize("unit", ["a", "ab", "=", " ", "\n", "0", "é", "日", "🙂", "xyzzy", "'s", "tion"])
def test_unsplit_texts(small, unit):
    for n in (30, 301, 3000):
        assert small.encode_many([unit * n])[0].ids.tolist() == direct(unit * n)


def test_random_letters_without_a_break():
    enc = TreeEncoder(PATH, leaf=200)
    rng = random.Random(1)
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(60_000))
    assert enc.encode_many([text])[0].ids.tolist() == direct(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    assert tiny().encode_many([text])[0].ids.tolist() == direct(text)


@lru_cache
def tiny():
    return TreeEncoder(PATH, leaf=4, window=1)



def test_digests(spark):
    long = "Some words of a long text. " * 400
    rows = [(1, "the cat"), (2, None), (3, ""), (None, "x y"), (4, long), (4, long), (5, "z" * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS n")
    got = sorted(encode_digests(docs, PATH, leaf=256, block=1000).collect(), key=str)
    want = []
    for doc_id, text in rows:
        ids = direct(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert encode_digests(docs.limit(0), PATH).count() == 0


def test_latin_classes():
    """The fast path and the library agree on every character that it takes, beside every class."""
    enc = tiny()
    kinds = ["a", "1", " ", "\n", "-", "é", "'", "  ", "\t ", "s"]
    taken = [c for c in map(chr, range(0x250)) if LATIN.fullmatch(c)]
    for kind in kinds:
        text = kind.join(x for c in taken for x in (c, c + c, c + "s", " " + c))
        assert np.array_equal(enc.encode(text).ids, direct(text)), kind


def test_every_token_encodes_to_itself():
    enc = tiny()
    broken = [i for b, i in enc.table.ranks.items() if enc.fast.encode_single_token(b) != i]
    assert not broken
    shown = [(i, b.decode()) for b, i in enc.table.ranks.items() if b.decode("utf-8", "ignore").encode() == b]
    for i, t in shown:
        if LATIN.fullmatch(t):
            assert direct(t) == enc.fast.encode_ordinary(t), t
