"""Registered queries over shards, vector codes and clusters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from remedia.llm import clustering, sharding, vector_codes
from remedia.llm.common import table


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


# 3988292384 is the reflected polynomial of CRC-32, from which its table of 256 numbers follows
OP11_SQL = f"""
WITH polynomial AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, b:
    CASE WHEN a % 2 = 1 THEN xor(3988292384, a // 2) ELSE a // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
bytes AS (
  SELECT doc_id, source, coalesce(text, '') AS text, list_transform(regexp_extract_all(
    hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS b FROM documents),
d AS (
  SELECT doc_id, len(b) + 1 AS size, xor(4294967295, list_reduce(list_prepend(4294967295, b),
      lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1]))) AS text_crc32,
    coalesce('=' || source, '') AS stratum,
    md5('{sharding.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(text)) AS key
  FROM bytes, polynomial),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY key) - 1 AS r, count(*) OVER (PARTITION BY stratum) AS n,
    CAST('0x' || substr(md5('{sharding.SEED}:' || stratum), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM d),
placed AS (
  SELECT *, row_number() OVER (ORDER BY (r + u) / n, key, stratum) - 1 AS place, count(*) OVER () AS total FROM ranked),
cut AS (SELECT *, place * {sharding.SHARDS} // total AS s FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, '{sharding.LAW}' AS law,
  CAST(s AS INT) AS shard, place - (s * total + {sharding.SHARDS - 1}) // {sharding.SHARDS} AS slot,
  CAST(NULL AS INT) AS grown_shard FROM cut"""

WHOLE = "list_transform(embedding, lambda x: CAST(floor({factor} * CAST(x AS DOUBLE)) AS BIGINT))"
FINITE = ("embedding IS NOT NULL AND len(embedding) > 0 "
          "AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0")
SQUARED = "list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _round_sql(i: int, by: str, number: str, most: int) -> str:
    """Assignment ``a{i}`` to the entries ``b{i}``, and the entries ``b{i + 1}`` after it."""
    keys = f"{by}, {number}" if by else number
    using = f"USING ({by})" if by else "ON true"
    group = f"r, {by}" if by else "r"
    return f"""a{i} AS MATERIALIZED (
  SELECT {group}, any_value(x) AS x, CAST(min({SQUARED} * {most} + {number}) AS BIGINT) AS m
  FROM p JOIN b{i} {using} GROUP BY {group}),
u{i} AS (
  SELECT {keys}, list((s - ((s % n) + n) % n) // n ORDER BY i) AS z FROM (
    SELECT {keys}, i, sum(v) AS s, count(*) AS n FROM (
      SELECT {by + ',' if by else ''} m % {most} AS {number}, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{i})
    GROUP BY {keys}, i) GROUP BY {keys}),
b{i + 1} AS MATERIALIZED (
  SELECT {keys}, coalesce(list_transform(z, lambda v: CAST(v AS BIGINT)), y) AS y
  FROM b{i} LEFT JOIN u{i} USING ({keys}))"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


_PARTS, _ENTRIES, _LAST = vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.ROUNDS
OP12_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, {WHOLE.format(factor=vector_codes.FACTOR)} AS c
  FROM embeddings WHERE {FINITE}),
p AS MATERIALIZED (
  SELECT r, vec_id, CAST(part AS INT) AS part,
    c[part * len(c) // {_PARTS} + 1:(part + 1) * len(c) // {_PARTS}] AS x
  FROM kept, range({_PARTS}) t(part)),
b0 AS MATERIALIZED (
  SELECT part, e, x AS y FROM (
    SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id, r) - 1 AS e FROM p) WHERE e < {_ENTRIES}),
{','.join(_round_sql(i, 'part', 'e', _ENTRIES) for i in range(_LAST + 1))},
codes AS (
  SELECT r, string_agg(format('{{:02x}}', m % {_ENTRIES}), '' ORDER BY part) AS code,
    CAST(sum(m // {_ENTRIES}) AS BIGINT) AS error FROM a{_LAST} GROUP BY r),
shown AS (
  SELECT sha256(string_agg(v, ',' ORDER BY part, e, i)) AS codebooks_sha256 FROM (
    SELECT part, e, unnest(y) AS v, generate_subscripts(y, 1) AS i FROM b{_LAST}))
SELECT vec_id, label, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN codes USING (r), shown"""


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


_K, _END = clustering.CENTROIDS, clustering.ROUNDS
OP13_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, {WHOLE.format(factor=clustering.FACTOR)} AS x
  FROM embeddings WHERE {FINITE} AND len(embedding) = {clustering.DIM}),
p AS (SELECT r, x FROM kept),
b0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{clustering.SEED}:' || vec_id), r) - 1 AS c, x AS y FROM kept
  QUALIFY c < {_K}),
{','.join(_round_sql(i, '', 'c', _K) for i in range(_END + 1))},
found AS (SELECT r, CAST(m % {_K} AS INT) AS cluster, m // {_K} AS distance FROM a{_END}),
named AS (SELECT CAST(c AS INT) AS cluster, sha256(array_to_string(y, ',')) AS centroid_sha256 FROM b{_END})
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM kept JOIN found USING (r) JOIN named USING (cluster)"""

QUERIES = {
    "op11_sharding": (op11_sharding, OP11_SQL),
    "op12_vector_codes": (op12_vector_codes, OP12_SQL),
    "op13_centroids": (op13_centroids, OP13_SQL),
}
