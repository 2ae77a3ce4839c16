"""Homomorphic multiset fingerprints of documents, in DataFrame functions only.

A paragraph (a line) is hashed to a wide vector and a document is the sum of its
paragraphs' vectors, each lane modulo a power of two. Sums don't depend on the order of
paragraphs, and a paragraph is put in or taken out by adding or subtracting its vector.
The lanes are of two kinds:

* ``EXACT`` lanes of 32 bits, from the paragraph's own hash: equal multisets, and only
  those (but for chance of 2**-128 and less), have equal lanes;
* ``SKETCH`` lanes of 48 bits, more than any text has windows, each the count of the paragraph's three-word windows with
  that bit of their hash set. Centred on half the number of windows (the last lane) they
  are a random-sign projection, so their cosine estimates how alike two documents are.

The documents' successors in descending ``doc_id`` come from one window per range of ids:
the ranges' borders are ids of documents, and each border row is also put at the end of
the range above, so no window runs over the whole table.

Defined results: a NULL text is an empty one: one empty paragraph. Equal texts have equal
fingerprints and likeness 1. A document alone is its own successor. A NULL id comes last,
rows of one id are in order of their text's hash, rows that repeat give a row each. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import bisect
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remedia.llm.common import text_of

EXACT = 8
EXACT_MOD = 2**32
SKETCH = 64
SKETCH_MOD = 2**48
WORDS = 3
LANES = [f"x{i}" for i in range(EXACT)] + [f"s{i}" for i in range(SKETCH)] + ["windows"]
#: Stands for a NULL id: below every other.
LAST = -(2**63)


def _windows() -> Column:
    """Hashes of the three-word windows of ``ws``; a shorter paragraph is one window, a blank one none."""
    def hashed(w: Column, i: Column) -> Column:
        return F.xxhash64(w, *[F.get("ws", i + k) for k in range(1, WORDS)])

    return F.slice(F.transform("ws", hashed), F.lit(1), F.greatest(F.size("ws") - F.lit(WORDS - 1), F.lit(1)))


def paragraph_rows(texts: DataFrame, text: Column, *by: str) -> DataFrame:
    """Rows of paragraphs: lanes that are summed. One row per window, the exact lanes on the first alone."""
    exact = [f"h{i}" for i in range(EXACT // 2)]
    lines = texts.select(*by, F.explode(F.split(text, "\n", -1)).alias("line"))
    # The words are a column of their own: inside the windows' function they would be cut anew at each word.
    cut = lines.select(*by, *[F.xxhash64(F.lit(i), "line").alias(h) for i, h in enumerate(exact)], F.filter(
        F.split("line", "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "").alias("ws"))
    return cut.select(*by, *exact, F.posexplode_outer(_windows()).alias("pos", "part"))


def summed(rows: DataFrame, *by: str) -> DataFrame:
    """The fingerprint lanes of each group; tasks add up their own rows first."""
    first = F.coalesce("pos", F.lit(0)) == 0
    exact = []
    for i in range(EXACT // 2):
        h = F.col(f"h{i}")
        exact += [h.bitwiseAND(F.lit(EXACT_MOD - 1)), F.shiftrightunsigned(h, 32)]
    lanes = [F.sum(F.when(first, e).otherwise(0)).alias(f"x{i}") for i, e in enumerate(exact)]
    lanes += [F.sum(F.shiftrightunsigned("part", i).bitwiseAND(F.lit(1))).alias(f"s{i}") for i in range(SKETCH)]
    total = rows.groupBy(*by).agg(*lanes, F.count("part").alias("windows"))
    return total.select(*by, *[F.pmod(F.coalesce(c, F.lit(0)), F.lit(EXACT_MOD if c[0] == "x" else SKETCH_MOD)).alias(c)
                               for c in LANES])


def combine(a: dict[str, Column], b: dict[str, Column], sign: int = 1) -> dict[str, Column]:
    """Lanes of two documents put together, or with sign -1 of the first without the second."""
    return {c: F.pmod(a[c] + sign * b[c], F.lit(EXACT_MOD if c[0] == "x" else SKETCH_MOD)) for c in LANES}


def shown(prefix: str = "") -> Column:
    """The lanes as text: the exact ones, then the others."""
    parts = [F.lpad(F.lower(F.hex(prefix + c)), 8 if c[0] == "x" else 12, "0") for c in LANES]
    return F.concat(*parts)


def _total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def likeness(a: str, b: str) -> Column:
    """0 to 1: 1 for equal fingerprints, else the cosine of the centred sketches, not below 0."""
    def signs(p: str) -> list[Column]:
        return [(2 * F.col(f"{p}s{i}") - F.col(p + "windows")).cast("double") for i in range(SKETCH)]

    x, y = signs(a), signs(b)
    dot = _total([p * q for p, q in zip(x, y, strict=True)])
    sizes = F.sqrt(_total([p * p for p in x])) * F.sqrt(_total([p * p for p in y]))
    same = reduce(lambda p, q: p & q, [F.col(a + c) == F.col(b + c) for c in LANES])
    cosine = F.when(sizes > 0, dot / sizes).otherwise(0.0)
    return F.when(same, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def fingerprints(docs: DataFrame, *by: str) -> DataFrame:
    """``by`` and the lanes, of the texts of each group together."""
    return summed(paragraph_rows(docs.withColumn("_text", text_of()), F.col("_text"), *by), *by)


def ranges(docs: DataFrame) -> DataFrame:
    """k, tie, text and the range of ids; border rows once more at the end of the range above (``ghost``)."""
    spark = docs.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", text_of().alias("text"), F.coalesce(F.col("doc_id"), F.lit(LAST)).alias("k")).withColumn(
        "tie", F.xxhash64("text"))
    cuts = rows.agg(F.percentile_approx("k", [i / parts for i in range(1, parts + 1)], 10 * parts)).first()[0]
    borders = sorted(set(cuts or []))  # ids of documents, one for each range at most

    def place(k: Column, low: int, high: int) -> Column:
        """Number of borders below k, as a tree of comparisons."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(k <= borders[middle], place(k, low, middle)).otherwise(place(k, middle + 1, high))

    real = rows.withColumn("range", place(F.col("k"), 0, max(len(borders) - 1, 0))).withColumn("ghost", F.lit(False))
    above = {b: bisect.bisect_left(borders, b) + 1 for b in borders}
    if borders:
        above[borders[-1]] = 0  # the first document follows the last
    ghost = rows.where(F.col("k").isin(borders)).withColumn("ghost", F.lit(True))
    lifted = F.create_map(*[x for b in borders for x in (F.lit(b), F.lit(above[b]))]) if borders else None
    ghost = ghost.withColumn("range", F.element_at(lifted, F.col("k")) if borders else F.lit(0))
    return real.unionByName(ghost)


ORDER = "PARTITION BY range ORDER BY ghost, k DESC, tie"


def with_successor(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_chars, edited, and (range, ghost, n): the place in descending order of ids."""
    rows = ranges(docs)
    n, half = F.char_length("text"), F.floor(F.col("n_chars") / 2).cast("int")
    placed = rows.withColumn("n", F.expr(f"row_number() OVER ({ORDER})")).withColumn(
        "next", F.expr(f"lead(text) OVER ({ORDER})")).withColumn("n_chars", n.cast("long"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")),
                      F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    return placed.select("doc_id", "range", "ghost", "n", "n_chars", "text", edited.alias("edited"))


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and its edited text, and their likeness to each other and to the next document."""
    key = ["range", "n", "ghost", "doc_id", "n_chars"]
    rows = with_successor(docs)
    both = rows.select(*key, F.sha2("edited", 256).alias("sha"), F.explode(F.array(
        F.struct(F.lit(0).alias("which"), F.col("text").alias("t")),
        F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))).alias("one")).select(
        *key, "sha", "one.which", "one.t").where("which = 0 OR NOT ghost")
    lanes = summed(paragraph_rows(both, F.col("t"), *key, "sha", "which"), *key, "sha", "which")
    own = [F.max(F.when(F.col("which") == w, F.col(c))).alias(p + c) for w, p in ((0, "own_"), (1, "ed_")) for c in LANES]
    wide = lanes.groupBy(*key, "sha").agg(*own)
    after = wide.withColumn("own", F.struct(*["own_" + c for c in LANES])).withColumn(
        "next", F.expr("lead(own) OVER (PARTITION BY range ORDER BY n)")).where("NOT ghost")
    return after.select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), shown("own_").alias("fingerprint"),
        shown("ed_").alias("edited_fingerprint"), likeness("own_", "ed_").alias("near_edited"),
        likeness("own_", "next.own_").alias("near_next"))
