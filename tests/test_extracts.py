"""Extracts one after the other give the rows of one load."""

import random
import re

from pyspark.sql import functions as F

from remedia.operators import extracts, layers

SCHEMA = "extract int, place long, key string, ok boolean, extra string"


def parsed(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({
        "_key": F.col("key"), "_typed": F.struct("key", "place"),
        "_error": F.when(~F.col("ok"), F.lit("bad"))})


def expected(rows):
    claimed, kept, held = set(), set(), set()
    for _, place, key, ok, _ in sorted(rows, key=lambda r: r[1]):
        if key is not None and key in claimed:
            held.add((place, "again"))
        elif not ok:
            held.add((place, "bad"))
        else:
            kept.add(place)
            claimed.add(key)
    return kept, held


def test_extracts_equal_one_load_and_replays_change_nothing(spark):
    rng = random.Random(2)
    rows = [(i // 100, i, None if rng.random() < 0.05 else "hot" if rng.random() < 0.3 else f"k{rng.randint(0, 120)}",
             rng.random() < 0.8, "x") for i in range(300)]
    ids = extracts.ClaimedIds(spark, buckets=4)
    kept, held = set(), set()
    for i in (0, 1, 1, 2, 0):  # the second extract is loaded twice, the first one again at the end
        clean, out = extracts.load_extract(
            parsed(spark, [r for r in rows if r[0] == i]), ids, i, ["place"], "again",
            ["extract", "place", "key", "ok", "extra"])
        kept |= {r.place for r in clean.collect()}
        held |= {(r.place, r[layers.REASON]) for r in out.collect()}
    assert (kept, held) == expected(rows)
    clean, out = extracts.load_extract(parsed(spark, []), ids, 3, ["place"], "again", ["place"])
    assert clean.count() == out.count() == 0


def test_the_stored_side_is_not_shuffled(spark):
    ids = extracts.ClaimedIds(spark, buckets=4)
    ids.add(spark.range(1000).select(F.col("id").cast("string").alias("_key")), 0)
    new = parsed(spark, [(1, i, str(i * 2), True, "x") for i in range(800)])
    facts = extracts.firsts_of(new, ["place"], F.col("_error").isNull(), ids, 1)
    assert facts.where("_claimed").count() == 500
    plan = facts._jdf.queryExecution().executedPlan().toString()
    depth, below = [], 0  # an exchange above the scan of the bucketed table would have a smaller depth
    for line in plan.splitlines():
        at = len(re.match(r"[\s:|+\-*()\d]*", line).group())
        depth = [(d, t) for d, t in depth if d < at] + [(at, line)]
        if ids.name in line:
            below += 1
            assert not any("Exchange" in t for _, t in depth), plan
    assert below and "Exchange" in plan


def test_judging_moves_and_stores_only_what_is_asked_for(spark):
    rows = [(0, i, f"k{i % 90}", i % 7 != 0, "x" * 50) for i in range(100)]
    ids = extracts.ClaimedIds(spark, buckets=4)
    judged = extracts.judge_extract(parsed(spark, rows), ids, 0, ["place"], "again")
    asked = judged.select("place", layers.REASON)
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    assert "extra" not in plan.split("LogicalRDD")[0] and "_typed" not in plan
    kept, held = expected(rows)
    got = {(r.place, r[layers.REASON]) for r in asked.collect()}
    assert got == {(p, None) for p in kept} | held
