"""Proportional stratified interleaving against the same law in plain Python."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from remedia.llm import sharding

SCHEMA = "doc_id long, text string, source string"


def brute(rows, shards, seed=sharding.SEED):
    strata = {}
    for i, text, source in rows:
        name = "" if source is None else f"={source}"
        inner = hashlib.md5((text or "").encode()).hexdigest()
        key = hashlib.md5(f"{seed}:{'null' if i is None else i}:{inner}".encode()).hexdigest()
        strata.setdefault(name, []).append((key, i, text))
    placed = []
    for name, own in strata.items():
        u = int(hashlib.md5(f"{seed}:{name}".encode()).hexdigest()[:8], 16) / 2**32
        placed += [((r + u) / len(own), key, name, i, text) for r, (key, i, text) in enumerate(sorted(
            own, key=lambda o: o[0]))]
    placed.sort(key=lambda p: p[:3])
    out, slots = [], Counter()
    for at, (_, _, _, i, text) in enumerate(placed):
        shard = at * shards // len(placed)
        data = (text or "").encode()
        out.append((str(i), len(data) + 1, zlib.crc32(data), "rows", shard, slots[shard], None))
        slots[shard] += 1
    return sorted(out, key=str)


def got(spark, rows, shards=4):
    return sorted(((str(r["doc_id"]), *r[1:]) for r in sharding.assign(
        spark.createDataFrame(rows, SCHEMA), shards).collect()), key=str)


def mixed(n=400):
    return [(i, f"texte numéro {i} 文" * (i % 5), "web" if i % 3 else ["a", "b", "c", None][i % 4]) for i in range(n)]


@pytest.mark.parametrize("rows", [4_096, 16])
def test_matches_plain_python(spark, monkeypatch, rows):
    monkeypatch.setattr(sharding, "ROWS", rows)
    monkeypatch.setattr(sharding, "RANGES", 3 if rows == 16 else 1000)
    data = mixed()
    assert got(spark, data, 7) == brute(data, 7)


def test_counts_mixture_and_slots(spark):
    data = mixed(1001) + [(10_000 + i, "x", f"single{i}") for i in range(80)]
    found = sharding.interleave(spark.createDataFrame(data, SCHEMA), 8, keep=["doc_id", "source"]).collect()
    sizes = Counter(r["shard"] for r in found)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 8
    for s in range(8):
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sizes[s]))
    whole = Counter(r["kept"]["source"] for r in found)
    for s in range(8):
        own = Counter(r["kept"]["source"] for r in found if r["shard"] == s)
        assert all(abs(own[name] - n / 8) <= 3 for name, n in whole.items())
        assert abs(sum(n for name, n in own.items() if (name or "").startswith("single")) - 10) <= 6


def test_nulls_repeats_and_a_giant_group(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS", 16)
    data = [(None, "same", "hot")] * 300 + [(None, None, None), (5, "", None), (7, "long " * 50_000, "hot")] + mixed(100)
    found = got(spark, data)
    assert Counter((r[0], r[2]) for r in found) == Counter((r[0], r[2]) for r in brute(data, 4))
    per = Counter(r[4] for r in found)
    assert max(per.values()) - min(per.values()) <= 1
    assert {r[1:3] for r in found if r[0] == "5"} == {(1, 0)}
    for s in per:
        assert sorted(r[5] for r in found if r[4] == s) == list(range(per[s]))
    same = Counter(r[4] for r in found if r[2] == zlib.crc32(b"same"))
    assert max(same.values()) - min(same.values()) <= 3


def test_empty_and_fewer_rows_than_shards(spark):
    assert got(spark, []) == []
    few = [(1, "a", "x"), (2, "b", "y"), (3, None, None)]
    assert got(spark, few, 8) == brute(few, 8)


def test_clashing_names_and_no_python(spark, sf_dir):
    docs = spark.createDataFrame(mixed(60), SCHEMA)
    named = docs.withColumn("shard", F.lit(9)).withColumn("range", F.lit("r")).withColumn("key", F.lit(1)).withColumn("n", F.lit(1))
    placed = sharding.interleave(named, 4, keep=["doc_id", "shard", "key"])
    assert {r["kept"]["shard"] for r in placed.collect()} == {9}
    plan = placed._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    base = sharding.assign(docs, 4).select("doc_id", "shard", "slot")
    assert sorted(base.collect()) == sorted(placed.select("kept.doc_id", "shard", "slot").withColumn(
        "shard", F.col("shard")).collect())


def test_written_shards(spark, tmp_path):
    data = mixed(50)
    placed = sharding.interleave(spark.createDataFrame(data, SCHEMA), 4, keep=["doc_id", "text", "source"])
    sharding.write(placed, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 50 and {r["_shard"] for r in back.select("_shard").distinct().collect()} == {0, 1, 2, 3}
    assert {(r["doc_id"], r["text"]) for r in back.collect()} == {(i, t) for i, t, _ in data}
