"""Toxicity scores of text restored by a noisy-channel decoder.

A word that may be disguised (digits and signs among letters, letters repeated three
times or more, letters apart by signs or blanks) is a lattice: at each character stand
the letters that it may stand for, or nothing where it repeats or parts, or a word's border
where it parts. Viterbi decoding under a trigram language model of characters finds the
likeliest reading, of any length; a word whose lattice has a single path is its own
reading. A run of single characters apart by blanks is one lattice, cut into words by the
reading; each word of a reading is scored. The model's counts come from all documents.

The restored words are scored by a lexicon learned from a bounded sample of the labelled rows
(``SAMPLE_ROWS``, taken by a hash of the id): words and word beginnings that occur in toxic documents far beyond chance (G test), each with its
precision. A document's score is the chance that one of its words is toxic after all
(noisy or), on top of the base rate. Counting is done in the tasks first; the lexicon is
bounded by ``LEXICON`` entries, the language model by its alphabet.

Defined results: NULL and empty texts have no words and score the base rate; NULL ids are
never learned from; NULL labels are ignored; repeated rows are scored each; an empty
table or no labels at all give scores of 0. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remedia.llm.common import add_columns, lower_words, stored, text_of
from remedia.llm.near_dedup import Shingler

#: Letters of the language model, a place each; all else is a word's border (0).
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœ"
PLACES = 64
#: Fixed: what signs are read as.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a",
        "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "¡": "i"}
PARTING = set(".-_*'~^,:/")
#: Log probabilities of the channel.
AS_SIGN, LITERAL, DROPPED, DOUBLED, BREAK = -0.5, -9.0, -0.5, -2.0, -2.0
LEXICON = 4096
SAMPLE_ROWS = 12_000
LEAST_G = 30.0
LEAST_PRECISION = 0.9
BEGINNINGS = (4, 5, 6)
CACHE_WORDS = 300_000
FLUSH = 200_000
SLICE = 1 << 20  # characters counted at once

SUSPECT = regex.compile(r"\p{L}[0-9@$!|+€._*~^',:/-]+\p{L}|^[0-9@$!|+€]\p{L}|\p{L}[0-9@$|+€]+$|(\p{L})\1\1")
SPACED = regex.compile(r"(?<!\S)(?:\S[ \t]){2,}\S(?!\S)")
#: Signs that EDGES takes away too, cut first: most words are letters alone then, and need no pattern.
PLAIN_EDGES = ".,;:?\"'()[]{}-_*"
LETTER = regex.compile(r"\p{L}")
TRIPLE = re.compile(r"(.)\1\1")
EDGES = regex.compile(r"^[^\p{L}0-9@$!|+€]+|(?<![^\p{L}0-9@$|+€])[^\p{L}0-9@$|+€]+$")


def _codes(text: str, table: np.ndarray) -> np.ndarray:
    return table[np.frombuffer(text.encode("utf-16-le"), "<u2")]


def _joined(texts: Iterable[str]) -> Iterator[str]:
    """Texts with two line ends before, between and after them, some ``SLICE`` characters at a time."""
    part, size = [""], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= SLICE:
            yield "\n\n".join([*part, ""])
            part, size = [""], 0
    if len(part) > 1:
        yield "\n\n".join([*part, ""])


def character_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts over all texts; tasks add up first, at most PLACES**3 numbers each."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, table = np.zeros(PLACES**3, "i8"), np.zeros(65_536, "u1")
        table[[ord(c) for c in LETTERS]] = range(1, len(LETTERS) + 1)
        for frame in frames:
            for text in _joined(frame["text"]):
                codes = _codes(text.lower(), table)
                for i in range(0, len(codes) - 2, SLICE):
                    c = codes[i:i + SLICE + 2].astype("i4")
                    total += np.bincount((c[:-2] * PLACES + c[1:-1]) * PLACES + c[2:], minlength=len(total))
        there = np.flatnonzero(total)
        yield pd.DataFrame({"gram": there, "n": total[there]})

    counted = docs.select(text_of().alias("text")).mapInPandas(count, "gram int, n long").groupBy("gram").agg(F.sum("n"))
    out = np.zeros(PLACES**3, "i8")
    for gram, n in counted.toLocalIterator():
        out[gram] = n
    return out.reshape(PLACES, PLACES, PLACES)


class Restorer:
    """Viterbi decoding of character lattices under a trigram model (with bigram and letter back-off)."""

    def __init__(self, counts: np.ndarray):
        c = counts.astype("f8")
        one = c.sum((0, 1)) + 0.5
        one /= one.sum()
        two = c.sum(0)
        two = (two + 20 * one) / (two.sum(1, keepdims=True) + 20)
        three = (c + 20 * two[None]) / (c.sum(2, keepdims=True) + 20)
        self.log = np.log(three)
        self.place = {ch: i for i, ch in enumerate(LETTERS, 1)}

    def lattice(self, word: str) -> list[list[tuple[str, float]]]:
        steps, last = [], ""
        for i, c in enumerate(word):
            if c in self.place:
                again = c == last
                steps.append([(c, DOUBLED if again else 0.0), *([("", DROPPED)] if again else [])])
            elif c in LEET:
                steps.append([*((x, AS_SIGN) for x in LEET[c]), (c, LITERAL), *([("", DROPPED)] if c == last else [])])
            elif (c in PARTING or c == " ") and 0 < i < len(word) - 1:
                steps.append([("", DROPPED), (" ", BREAK)])
            else:
                steps.append([(c, 0.0)])
            last = c
        return steps

    def decode(self, word: str) -> str:
        states = {(0, 0): (0.0, None)}
        for options in self.lattice(word):
            after: dict = {}
            for (a, b), (score, path) in states.items():
                for c, cost in options:
                    if c:
                        p = self.place.get(c, 0)
                        key, value = (b, p), score + cost + self.log[a, b, p]
                    else:
                        key, value = (a, b), score + cost
                    if key not in after or value > after[key][0]:
                        after[key] = value, (path, c) if c else path
            states = after
        path = max(((s + self.log[a, b, 0], path) for (a, b), (s, path) in states.items()), key=lambda x: x[0])[1]
        found = []
        while path:
            path, c = path
            found.append(c)
        return " ".join("".join(reversed(found)).split())

    def restore(self, word: str) -> str:
        """``word`` in lower case, without the punctuation around it; blanks where it reads as several words."""
        core = word.strip(PLAIN_EDGES)
        if core.isalpha() and not TRIPLE.search(core):
            return core
        core = EDGES.sub("", core)
        if not (SUSPECT.search(core) or " " in core and LETTER.search(core)):
            return core
        return self.decode(core)


class Features:
    """The features of a text: restored words and their beginnings; words are remembered within bounds."""

    def __init__(self, restorer: Restorer):
        self.restorer, self.known = restorer, {}

    def of_word(self, word: str) -> tuple[str, ...]:
        return tuple(f for w in self.restorer.restore(word).split() if len(w) > 2
                     for f in (w + "$", *[w[:n] for n in BEGINNINGS if len(w) >= n]))

    def words(self, text: str) -> set[str]:
        lower = text.lower()
        runs = [m.group().split() for m in SPACED.finditer(lower)]
        return {*lower.split(), *["".join(run) for run in runs], *[" ".join(run) for run in runs]}

    def __call__(self, text: str) -> list[tuple[str, ...]]:
        found = self.words(text)
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        for w in found.difference(self.known):
            self.known[w] = self.of_word(w)
        return [self.known[w] for w in found]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


class Model:
    """Bounded: goes to the tasks with the function."""

    def __init__(self, counts: np.ndarray, lexicon: dict[str, float], rate: float):
        self.counts, self.lexicon, self.rate = counts, lexicon, rate

    def scorer(self):
        features, lexicon, rate = Features(Restorer(self.counts)), self.lexicon, self.rate
        seen: set[str] = set()
        marked: dict[str, float] = {}

        def value(word: str) -> float:
            return max((lexicon.get(p, 0.0) for p in features.of_word(word)), default=0.0)

        def score(text: str) -> float:
            if len(seen) > CACHE_WORDS:
                seen.clear()
                marked.clear()
            found = features.words(text)
            fresh = found - seen
            seen.update(fresh)
            for w in fresh:
                if p := value(w):
                    marked[w] = p
            clean = 1.0 - rate
            for w in sorted(found & marked.keys()):
                clean *= 1.0 - marked[w]
            return 1.0 - clean

        return score


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """From all documents (characters) and ``SAMPLE_ROWS`` labelled rows that are not held out (words)."""
    counts = character_counts(docs)
    marked = labels.select(F.col("doc_id").alias("l_id"), F.col("toxic").cast("int").alias("toxic")).where(
        "toxic IS NOT NULL AND l_id IS NOT NULL").groupBy("l_id").agg(F.max("toxic").alias("toxic")).where(
        ~held_out(F.col("l_id"))).orderBy(F.xxhash64("l_id"), "l_id").limit(SAMPLE_ROWS)
    rows = docs.select("doc_id", text_of().alias("text")).join(
        marked, F.col("doc_id") == F.col("l_id")).select("text", "toxic")

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(3)
        for frame in frames:
            least = [shingler(lower_words(t)).astype("i8").min(initial=2**63 - 1) for t in frame["text"]]
            yield frame.assign(near=least)

    # Near copies share the least hash of their shingles, mostly; a group of them is little more than one witness.
    rows = rows.mapInPandas(mark, "text string, toxic int, near long").groupBy("near", "toxic").agg(F.min("text").alias("text"))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features(Restorer(counts))
        toxic, every = Counter(), Counter()

        def flush() -> pd.DataFrame:
            names = list(every)
            out = pd.DataFrame({"feature": names, "toxic": [toxic[n] for n in names], "n": [every[n] for n in names]})
            toxic.clear()
            every.clear()
            return out

        for frame in frames:
            for text, y in zip(frame["text"], frame["toxic"], strict=True):
                found = {"", *[p for parts in features(text) for p in parts]}  # "" counts the documents
                every.update(found)
                if y:
                    toxic.update(found)
                if len(every) > FLUSH:
                    yield flush()
        if every:
            yield flush()

    table = rows.mapInPandas(count, "feature string, toxic long, n long").groupBy("feature").agg(
        F.sum("toxic").alias("k"), F.sum("n").alias("n"))
    table = stored(table, "features")
    base = table.where("feature = ''").first()
    if base is None or not base["k"]:
        return Model(counts, {}, 0.0)
    rate = base["k"] / base["n"]
    k, n = F.col("k").cast("double"), F.col("n").cast("double")

    def part(x: Column, share: float) -> Column:
        return F.when(x > 0, x * F.log(x / (n * share))).otherwise(0.0)

    g = 2 * (part(k, rate) + part(n - k, max(1 - rate, 1e-9)))
    precision = (k + 0.5) / (n + 1)
    top = table.where("feature <> ''").withColumn("g", g).withColumn("p", precision).where(
        (F.col("g") >= LEAST_G) & (F.col("p") >= LEAST_PRECISION)).orderBy(
        F.desc("g"), "feature").limit(LEXICON).select("feature", "p").collect()
    return Model(counts, {r["feature"]: r["p"] for r in top}, min(rate, 0.5) / 4)


def scores(docs: DataFrame, model: Model, *keep: str, name: str = "score") -> DataFrame:
    """``keep`` and the score of every document."""
    kept = [F.col(f"`{c}`") for c in keep]
    rows = docs.select(*kept, text_of().alias("_scored"))

    def make():
        score = model.scorer()
        return lambda texts: ([score(t) for t in texts],)

    return add_columns(rows, ["_scored"], make, {name: "double"})
