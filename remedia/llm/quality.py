"""Quality rules with thresholds that follow the corpus.

Fixed rules first: too few words, or mostly repeated three-word windows. Then each ratio
of a document is held against a fence made from KLL quantile sketches of its own language
and source. Sketches merge, so tasks add up their own
rows, and a source that holds a third of the rows is no task of its own. A group's fence
is a mean of its own and its language's, the language's one of its own and the corpus's;
the weight of the own one is n / (n + ``HALF_GROUP``), so no row count switches a verdict.
The fences are joined to the documents' ratios, never to their texts.

A fence is the median plus ``REACH`` times a spread, and never below the ratio's floor, so
uniform groups lose nothing. The spread is the distance from the median to the lower
quartile, or to the upper one where that is less: bad documents have high ratios, so it
stays one of good documents until nearly half of the group is bad.

Defined results: a NULL, empty or blank text has no words and fails the fixed rules; a
NULL language or source is a group like any other; NULL and repeated ids give a row each;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remedia.llm.common import SPACE, add_columns, row_hash, stored, text_of, words
from remedia.llm.near_dedup import Shingler

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 50
REACH = 6.0
#: Rows of a group whose own fence counts as much as the wider one's.
HALF_GROUP = 200
#: ratio -> the least fence.
FLOORS = {"symbol_ratio": 0.05, "repeat_ratio": 0.45, "dup_line_ratio": 0.40, "word_length": 12.0}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def measure(text: str, windows: Shingler) -> tuple[int, ...]:
    ws, lines = words(text), text.split("\n")
    seen: set[str] = set()
    repeated_lines = 0
    for line in lines:
        if line in seen:
            repeated_lines += line.strip(SPACE) != ""
        else:
            seen.add(line)
    repeats = 0
    if len(ws) >= windows.width:
        _, place, times = np.unique(windows.every(ws), return_inverse=True, return_counts=True)
        twice = times[place] > 1
        covered = np.zeros(len(ws), bool)
        for i in range(windows.width):
            covered[i:i + len(twice)] |= twice
        repeats = int(covered.sum())
    return (len(ws), len(text) - sum(text.count(c) for c in SPACE), sum(text.count(c) for c in SYMBOLS),
            repeated_lines, repeats, len(lines))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, k1, lang, source, counts, base_failed and the ratios; one pass over the texts."""
    rows = docs.select("doc_id", row_hash("doc_id", "text").alias("k1"), F.col("lang").cast("string").alias("lang"),
                       F.col("source").cast("string").alias("source"), text_of().alias("text"))

    def make():
        windows = Shingler(3)
        return lambda texts: np.array([measure(t, windows) for t in texts], "i8").reshape(-1, len(COUNTS)).T

    counted = add_columns(rows, ["text"], make, dict.fromkeys(COUNTS, "long"))

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return counted.select("*", failed.alias("base_failed"), ratio("n_symbols", "word_chars").alias("symbol_ratio"),
                          ratio("n_repeat_words", "n_words").alias("repeat_ratio"),
                          ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
                          ratio("word_chars", "n_words").alias("word_length"))


def fences(measured: DataFrame) -> DataFrame:
    """lang, source and a fence per ratio, from the rows that pass the fixed rules."""
    sketches = stored(measured.where("NOT base_failed").groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(c).alias(c) for c in FLOORS]), "sketches")

    def own(c: str) -> Column:
        low, middle, high = (F.kll_sketch_get_quantile_double(c, F.lit(q)) for q in (0.25, 0.5, 0.75))
        return middle + REACH * F.least(middle - low, high - middle)

    def limits(groups: DataFrame, up: str) -> DataFrame:
        return groups.select(*[c for c in ("lang", "source") if c in groups.columns], F.col("n").alias("n" + up),
                             *[own(c).alias(c + up) for c in FLOORS])

    def merged(*by: str) -> DataFrame:
        return sketches.groupBy(*by).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(c).alias(c) for c in FLOORS])

    def blended(n: str, narrow: Column, wide: Column) -> Column:
        share = F.col(n) / (F.col(n) + HALF_GROUP)
        return share * narrow + (1 - share) * wide

    by_lang = limits(merged("lang"), "_lang").withColumnRenamed("lang", "of_lang")
    # The last join is with one row.
    joined = limits(sketches, "").join(by_lang, F.col("lang").eqNullSafe(F.col("of_lang"))).join(
        limits(merged(), "_all"), F.lit(True))
    return joined.select("lang", "source", *[F.greatest(F.lit(floor), blended(
        "n", F.col(c), blended("n_lang", F.col(c + "_lang"), F.col(c + "_all")))).alias("fence_" + c)
        for c, floor in FLOORS.items()])


def judge(docs: DataFrame) -> DataFrame:
    """The measures of every document with ``kept``."""
    measured = stored(measures(docs), "measures")
    limits = fences(measured).withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("of_lang"))
                           & F.col("source").eqNullSafe(F.col("of_source")), "left")
    within = F.lit(True)
    for c in FLOORS:
        within = within & (F.col(c) <= F.coalesce("fence_" + c, F.lit(float("inf"))))
    return joined.withColumn("kept", ~F.col("base_failed") & within)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, all their columns."""
    good = judge(docs).where("kept").select(F.coalesce("doc_id", F.lit(0)).alias("_k0"), F.col("k1").alias("_k1")).distinct()
    marked = docs.withColumn("_k0", F.coalesce("doc_id", F.lit(0))).withColumn("_k1", row_hash("doc_id", "text"))
    return marked.join(good, ["_k0", "_k1"], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
