"""Training-corpus pipeline: quality rules, toxicity, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; it is written as Parquet below
the shared checkpoint folder and read again as the next one's ``docs``. All stages but the
last keep the columns of ``docs``, others than those of ``documents`` included.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remedia.llm import line_dedup, near_dedup, packing, quality, toxicity
from remedia.llm.common import stored, table
from remedia.llm.tokens import vocabulary

TOXIC_FROM = 0.7
LINE_MIN_DOCS = 10


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule go."""
    return quality.keep_good(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. Learned from the labels of documents still there."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.scores(docs, model, *docs.columns, name="_score")
    return scored.where(F.col("_score") < TOXIC_FROM).drop("_score")


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents go; every document stays, perhaps with an empty text."""
    kept = line_dedup.dedup(docs, LINE_MIN_DOCS, *[c for c in docs.columns if c != "doc_id"])
    n_chars = docs.schema["n_chars"].dataType
    return kept.withColumn("text", F.col("_kept_text")).withColumn(
        "n_chars", F.char_length("text").cast(n_chars)).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup.keep_one(docs, near_dedup.Rule(width=5, percent=80))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.best_fit(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("near_dedup", drop_near_copies),
    ("best_fit_packing", pack),
]

#: The toxicity model, the signatures and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
