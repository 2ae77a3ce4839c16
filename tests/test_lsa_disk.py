"""The projection keeps little on disk: sums once, large chunks, nothing that was read for the last time."""

import os

import pytest
from pyspark.sql import functions as F

from remedia.operators import semantics
from remedia.session import checkpoint_root

CORPUS = "id string, regulation string, title string, text string"


def docs(spark, n=160):
    return spark.createDataFrame([(f"d{i}", "R", "", " ".join(f"w{(i * j) % 211}" for j in range(1, 40))) for i in range(n)], CORPUS)


def test_sums_are_stored_once(spark, monkeypatch):
    monkeypatch.setattr(semantics, "CHUNK_BYTES", 2_000)
    matrix = semantics.term_matrix(docs(spark))
    assert matrix.chunks > 8
    block = semantics._returned(matrix, None, None, 8).where(F.col("kind") == semantics.SHARED)
    shared = matrix.packed.select("id", "shared").collect()
    ids = {i for r in shared for i, s in zip(memoryview(bytes(r["id"])).cast("q"), bytes(r["shared"]), strict=True) if s}
    pieces = sum(sum(bytes(r["shared"])) for r in shared)
    held = block.agg(F.sum(F.length("v") + F.coalesce(F.length("ids"), F.lit(0)))).first()[0]
    assert held == len(ids) * 8 * 4 + pieces * 4  # a row of the block once, a place for every chunk that has the term


def test_read_blocks_and_chunks_are_removed(spark, monkeypatch):
    monkeypatch.setattr(semantics, "CHUNK_BYTES", 2_000)
    seen = set(os.listdir(f"{checkpoint_root(spark)}/remedia"))
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    p = semantics.fit_projection(docs(spark), 5)
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(f"{checkpoint_root(spark)}/remedia")) - seen}
    assert left == {"products", "factors"} and spark.conf.get(setting) == before
    assert p.vectors.count() == 160 and p.factors.count() >= 211


@pytest.mark.parametrize("size, chunks", [(1, 1), (31, 31), (32, 32), (100, 32), (192, 32), (600, 100)])
def test_chunks_grow_where_there_are_many(spark, monkeypatch, size, chunks):
    monkeypatch.setattr(semantics, "CHUNK_BYTES", 100)
    assert semantics.chunk_count(size * 100) == chunks
