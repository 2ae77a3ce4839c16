"""Ids keep all their digits in batches that also hold NULL ids."""

import pytest

from remedia.llm import bpe, language, line_dedup, near_dedup, packing, quality, toxicity, warc
from remedia.llm.tokens import vocabulary

BIG = 2**53 + 1


@pytest.fixture(scope="module")
def docs(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(BIG, text, "en", "web", BIG + 2), (None, text, None, None, None), (BIG + 4, "", "en", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_ids_stay_whole(docs):
    want = {BIG, None, BIG + 4}
    model = toxicity.Model(toxicity.character_counts(docs), {}, 0.0)
    assert ids(quality.judge(docs)) == want
    assert ids(line_dedup.dedup(docs, 10)) == want
    assert ids(near_dedup.signatures(docs, near_dedup.Rule(width=3, percent=85))) == want
    assert ids(language.identify(docs, language.Model([], None))) == want
    assert ids(packing.best_fit(docs, vocabulary("word_bpe_49k.json"))) == want
    assert ids(bpe.encode_digests(docs, vocabulary("byte_bpe_50k.json"))) == want
    assert ids(bpe.encode_digests(docs, vocabulary("byte_bpe_50k.json"), leaf=16, block=64)) == want
    carried = toxicity.scores(docs, model, "doc_id", "n_chars").collect()
    assert {(r["doc_id"], r["n_chars"]) for r in carried} == {(BIG, BIG + 2), (None, None), (BIG + 4, None)}


def test_page_ids_stay_whole(spark):
    rows = [(BIG, "http://a/", "x"), (BIG + 2, "http://a/", "x"), (None, "http://a/", "y"), (BIG + 4, "http://a/", "y")]
    found = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in found}
    assert {(p, t) for p, t, _ in got} >= {(BIG, "revisit"), (BIG + 2, "response"), (BIG + 4, "response")}
    assert (BIG, "revisit", BIG + 2) in got and len(found) == 4
