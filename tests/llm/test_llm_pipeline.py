import random

import corpus_pipeline
from remedia.llm.common import table
from remedia.llm.line_dedup import LineRuns, dedup, hashed_lines, ingest, line_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("*", "doc_id AS _extra", "1 AS kept", "2 AS node")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir).cache()
        assert after.columns == docs.columns, name
        assert 0 < after.count() <= before
        assert after.where("_extra <> doc_id").count() == 0
        before, docs = after.count(), after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_line_dedup_cases(spark):
    hot = [(i, f"own {i}\n  Shared LINE\t\nshared line", "aa", "s", 1) for i in range(12)]
    odd = [(50, None, None, None, None), (51, "", "aa", "s", 0), (52, "\n\n", "aa", "s", 2), (53, "shared line", "aa", "s", 11),
           (None, "shared line\nx", "aa", "s", 1), (53, "shared line", "aa", "s", 11), (54, "É\né" , "aa", "s", 1)]
    frame = spark.createDataFrame(hot + odd, DOCS).selectExpr("*", "1 AS h1", "2 AS pos", "3 AS n_lines")
    rows = {}
    for r in dedup(frame, 10, "lang", "h1").collect():
        rows.setdefault(r.doc_id, []).append((r._kept_text, r._n_lines, r._n_dropped))
    assert all(rows[i] == [(f"own {i}", 3, 2)] for i in range(12))
    assert rows[50] == rows[51] == [("", 1, 0)] and rows[52] == [("\n\n", 3, 0)]
    assert rows[53] == [("", 1, 1)] * 2 and rows[None] == [("x", 2, 1)] and rows[54] == [("É\né", 2, 0)]
    assert dedup(frame.limit(0), 10).count() == 0


def test_runs_are_merged_by_level(spark):
    runs = LineRuns(spark, fanout=2)
    kept = []
    for i in range(6):
        batch = spark.createDataFrame([(i, f"line\nown {i}", "aa", "s", 1)], DOCS)
        kept += [r._kept_text for r in ingest(batch, runs, 3).collect()]
    assert [len(level) for level in runs.levels] == [0, 1, 1]
    assert kept == [f"line\nown {i}" for i in (0, 1)] + [f"own {i}" for i in range(2, 6)]
    assert sorted(r.docs for r in runs.counts().collect()) == [1] * 6 + [6]


def by_hand(rows, least):
    """Texts without the lines found in ``least`` rows."""
    keyed = [[x.strip(" \t\n\x0b\x0c\r").encode().lower() for x in (t or "").split("\n")] for _, t, *_ in rows]
    seen = {}
    for keys in keyed:
        for k in set(keys):
            seen[k] = seen.get(k, 0) + 1
    return sorted("\n".join(x for x, k in zip((t or "").split("\n"), keys) if not k or seen[k] < least)
                  for (_, t, *_), keys in zip(rows, keyed))


def test_line_dedup_by_batches(spark):
    """Lines that turn frequent late or across runs only, ties at the threshold, a hot line, a long text."""
    rng = random.Random(3)
    rows = []
    for i in range(300):
        lines = [f"own {i}", "HOT " if i % 3 else "other", *(f"w{rng.randint(0, 150)}" for _ in range(6)), "", " \t"]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), "aa", "s", 1))
    rows += [(1000 + i, "nine" if i < 9 else "ten\nTEN", "aa", "s", 1) for i in range(19)]
    rows += [(2000, "\n".join(["again", f"long {i % 7000}"][i % 2] for i in range(60000)), "aa", "s", 1)]
    frame = spark.createDataFrame(rows, DOCS).repartition(6)
    want = by_hand(rows, 10)
    for batches, fanout in ((1, 2), (6, 3)):
        got = dedup(frame, 10, batches=batches, fanout=fanout).collect()
        assert sorted(r._kept_text for r in got) == want
    assert "nine" in want and "" in want


def test_a_batch_meets_the_runs_before_it(spark):
    runs = LineRuns(spark, fanout=2, min_docs=3)
    for i in range(3):
        docs = spark.createDataFrame([(10 * i + k, f"line\nown {i} {k}", "aa", "s", 1) for k in range(2)], DOCS)
        runs.add(line_counts(hashed_lines(docs)))
        known = {r.docs for r in runs.known().collect()}
        assert known == (set() if i == 0 else {4})  # two documents a run; four in the merged one
    assert runs.frequent(3).select("docs").collect()[0][0] == 6
