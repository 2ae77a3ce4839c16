"""Terms of a corpus and of questions, counted row by row."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remedia import policy
from remedia.functions.text import expand_numbers, tokenize
from remedia.session import spread, unnest

WORD = r"[A-Za-z][A-Za-z0-9]*|\d+(?:\.\d+)*"
SLICE = 256            # rows counted at once
KNOWN_WORDS = 200_000  # words whose terms a task remembers


def indexed_text(corpus: DataFrame) -> Column:
    return F.concat(
        F.col("id").cast("string"), F.lit(" "), F.col("regulation"), F.lit(" "),
        F.col("title"), F.lit(". "), F.col("text"))


def cuttable(text: Column) -> Column:
    """The text as ``term_counter`` takes it: lower case, numbers spelled both ways."""
    return expand_numbers(F.lower(text))


def document_texts(corpus: DataFrame) -> DataFrame:
    """``doc_id, text``: what is indexed of a document, ready to be cut."""
    corpus = spread(corpus.select("id", "regulation", "title", "text"))
    return corpus.select(F.col("id").alias("doc_id"), cuttable(indexed_text(corpus)).alias("text"))


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, term``: the terms of a query as a set."""
    return unnest(
        spread(queries.select("query_id", "query")),
        F.array_distinct(tokenize(F.col("query"))), "term", "query_id")


def query_counts(queries: DataFrame) -> DataFrame:
    """``query_id, length, terms, counts``: a row a query, for very many of them."""
    asked = spread(queries.select("query_id", "query"))
    return counted_terms(asked.select("query_id", cuttable(F.col("query")).alias("text")), "query_id")


def term_counter() -> Callable[[str | None], dict[str, int]]:
    """How often each term of ``functions.text.tokenize`` occurs in a cuttable text.

    A distinct word is looked at once: stop words go, synonyms and the parts of dotted numbers
    are added.
    """
    find, stop, known = re.compile(WORD).findall, frozenset(policy.STOP_WORDS), {}

    def terms_of(word: str) -> tuple[str, ...]:
        if word in stop:
            return ()
        if word in policy.SYNONYMS:
            return (word, *policy.SYNONYMS[word])
        return (word, *[p for p in word.split(".") if p]) if "." in word else (word,)

    def count(text: str | None) -> dict[str, int]:
        out: dict[str, int] = {}
        for word, n in Counter(find(text or "")).items():
            made = known.get(word)
            if made is None:
                if len(known) >= KNOWN_WORDS:
                    known.clear()
                made = known[word] = terms_of(word)
            for term in made:
                out[term] = out.get(term, 0) + n
        return out

    return count


def counted_terms(texts: DataFrame, key: str) -> DataFrame:
    """``key, length, terms, counts`` of ``key, text`` (cuttable): the terms of a row once each.

    A row's terms are counted where they are cut, ``SLICE`` rows at a time; nothing is
    shuffled. A NULL text has none.
    """
    schema = texts.select(key).schema.add("length", "integer").add(
        "terms", T.ArrayType(T.StringType())).add("counts", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = term_counter()
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE):
                some = batch.slice(begin, SLICE)
                found = [count(text) for text in some.column(1).to_pylist()]
                starts = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    some.column(0), pa.array([sum(f.values()) for f in found], pa.int32()),
                    pa.ListArray.from_arrays(starts, pa.array([t for f in found for t in f], pa.string())),
                    pa.ListArray.from_arrays(starts, pa.array([n for f in found for n in f.values()], pa.int32()))],
                    names=[key, "length", "terms", "counts"])

    return texts.select(key, "text").mapInArrow(run, schema)
