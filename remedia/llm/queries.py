"""Registered queries of this subpackage: name -> (Spark builder, equivalent SQL or None)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from remedia.llm import bpe, chat, fingerprint, language, line_dedup, near_dedup, packing, quality, toxicity, vector_queries, warc
from remedia.llm.common import table
from remedia.llm.tokens import vocabulary

LINE_MIN_DOCS = 10


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents"), LINE_MIN_DOCS)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
                      F.sha2("_kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM docs),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
hot AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
marked AS (SELECT keyed.*, hot.key IS NOT NULL AS gone FROM keyed LEFT JOIN hot ON keyed.key = hot.key)
SELECT any_value(docs.doc_id) AS doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked JOIN docs USING (r) GROUP BY r
"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.learn(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), near_dedup.Rule(width=3, percent=85))


OP5_SQL = r"""
WITH RECURSIVE worded AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
classes AS MATERIALIZED (SELECT w, min(r) AS c FROM worded WHERE len(w) > 0 GROUP BY w),
shingles AS MATERIALIZED (
  SELECT DISTINCT c, hash(list_slice(w, i, i + 2)) AS s
  FROM (SELECT c, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM classes)),
sizes AS MATERIALIZED (SELECT c, count(*) AS n FROM shingles GROUP BY c),
shared AS (
  SELECT x.c AS a, y.c AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.c <> y.c
  GROUP BY x.c, y.c),
links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes p ON p.c = a JOIN sizes q ON q.c = b
  WHERE 100 * k >= 85 * (p.n + q.n - k)),
walk AS (
  SELECT c AS origin, c AS reached FROM classes
  UNION SELECT origin, b FROM walk JOIN links ON reached = a),
members AS MATERIALIZED (
  SELECT r, doc_id, c FROM worded JOIN classes USING (w)),
named AS (SELECT origin AS c, min(doc_id) AS component_id FROM walk JOIN members ON members.c = reached GROUP BY origin)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept
FROM members JOIN named USING (c) JOIN sizes USING (c)
UNION ALL SELECT doc_id, 0, doc_id, true FROM worded WHERE len(w) = 0
"""


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edited(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


#: Tools of the calls that are derived from the assistant's turns.
SCHEMAS = {
    name: {"type": "object", "required": ["query", "turn"], "additionalProperties": False,
           "properties": {"query": {"type": "string", "minLength": 1, "maxLength": 1000},
                          "turn": {"type": "integer", "minimum": 0, "maximum": 6}, "after": {"type": "string"}}}
    for name in ("search", "look_up")}


def op9_chat_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant turn is a call, the next turn of its conversation the result; turn n uses the call of turn n / 2."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")

    def call_id(turn) -> Column:
        return F.md5(F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string")))

    before = F.floor(F.col("turn") / 2)
    calls = rows.where("role = 'assistant'").select(
        "conv_id", "turn", call_id(F.col("turn")).alias("call_id"),
        F.when(F.col("turn") % 3 == 0, "count").when(F.col("turn") % 3 == 1, "search").otherwise("look_up").alias("name"),
        F.to_json(F.struct(F.col("turn").alias("turn"), F.col("text").alias("query"),
                           F.when(before < F.col("turn"), call_id(before)).alias("after"))).alias("arguments"))
    results = rows.where("turn > 0").select(
        call_id(F.col("turn") - 1).alias("call_id"), F.struct("turn", "text").alias("result_order"), F.col("text").alias("content"))
    needs = rows.where("role = 'assistant' AND turn > 0").select(
        call_id(F.col("turn")).alias("call_id"), call_id(before).alias("needs"))
    out = chat.link(calls, results, needs, SCHEMAS)
    return out.select("conv_id", "turn", "call_id", "name", "n_results", "level", "valid",
                      F.sha2("result", 256).alias("result_sha256"), F.sha2("message", 256).alias("message_sha256"))


TOXIC_FROM = 0.7


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.scores(docs, model, "doc_id").select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_line_dedup": (op1_line_dedup, OP1_SQL),
    "op2_language_id": (op2_language_id, None),
    "op3_best_fit_packing": (op3_best_fit_packing, None),
    "op4_bpe": (op4_bpe, None),
    "op5_near_dedup": (op5_near_dedup, OP5_SQL),
    "op6_warc": (op6_warc, None),
    "op7_toxicity": (op7_toxicity, None),
    "op8_quality_rules": (op8_quality_rules, None),
    "op9_chat_tools": (op9_chat_tools, None),
    "op10_fingerprint": (op10_fingerprint, None),
    **vector_queries.QUERIES,
    "pipeline": (pipeline, corpus_pipeline.ORACLE_SQL),
}
