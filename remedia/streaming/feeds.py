"""Continuous jobs: daily drift, case triage and shadow comparison."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from remedia import policy
from remedia.operators import drift, shadow
from remedia.session import stored

ATTEMPTS = 3  # fixed: a case is tried three times
LOTS = 1 << 14  # lots that cases are dealt into; part of the state's layout
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_feed(spark: SparkSession, path: str, schema, glob: str | None = None,
              fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def daily_frequencies(
    feed: DataFrame, time: str, columns: Sequence[str], late: str = "2 days",
    window: str = "1 day",
) -> DataFrame:
    """Counts per closed window, column and value. Later rows than ``late`` are dropped.

    All columns share the one stateful shuffle; state is a counter per window,
    column and value, freed when the watermark passes the window.
    """
    pairs = F.array(*[
        F.struct(F.lit(n).alias("signal"), drift.category_text(feed, n).alias("category"))
        for n in columns])
    return (
        feed.withWatermark(time, late)
        .select(time, F.explode(pairs).alias("p"))
        .groupBy(F.window(time, window).alias("w"), F.col("p.signal").alias("signal"),
                 F.col("p.category").alias("category"))
        .agg(F.count(F.lit(1)).alias("current_n"))
        .select(F.col("w.start").alias("window_start"), "signal", "category", "current_n"))


def window_psi(counts: DataFrame, baseline: DataFrame) -> DataFrame:
    """Index of every window against a fixed baseline (``signal, category, baseline_n``).

    A window is compared over its own categories and the baseline's. A baseline category
    that a window lacks has the same term in every window: these terms are summed once a
    signal, and a window's own categories replace theirs. So nothing is joined on the
    signal alone, and no grid of windows and categories is built.
    """
    shares = baseline.groupBy("signal").agg(F.greatest(F.sum("baseline_n"), F.lit(1)).alias("_all"))
    floor = F.lit(policy.PSI_FLOOR)
    b = F.greatest(F.col("baseline_n") / F.col("_all"), floor)
    known = baseline.join(shares, "signal").select(
        "signal", "category", b.alias("_b"), ((floor - b) * F.ln(floor / b)).alias("_absent"))
    rest = known.groupBy("signal").agg(F.sum("_absent").alias("_rest"))
    key = ["window_start", "signal"]
    totals = counts.groupBy(*key).agg(F.greatest(F.sum("current_n"), F.lit(1)).alias("_all"))
    c = F.greatest(F.col("current_n") / F.col("_all"), floor)
    base = F.coalesce("_b", floor)
    seen = counts.join(totals, key).join(known, ["signal", "category"], "left").select(
        *key, ((c - base) * F.ln(c / base) - F.coalesce("_absent", F.lit(0.0))).alias("_term"))
    found = seen.groupBy(*key).agg(F.sum("_term").alias("_own")).join(rest, "signal", "left")
    return found.withColumn("psi", F.col("_own") + F.coalesce("_rest", F.lit(0.0))).select(
        *key, "psi", drift.status(F.col("psi")).alias("status"))


def _idempotent(path: str, build: Callable[[DataFrame], DataFrame]):
    """Write each micro-batch to its own folder: a batch that is replayed replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            build(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        finally:
            batch.unpersist()
    return write


def start_daily_psi(
    feed: DataFrame, baseline_rows: DataFrame, time: str, columns: Sequence[str], path: str,
    checkpoint: str, late: str = "2 days",
) -> StreamingQuery:
    """Drift of each closed day against the baseline, written as the days close."""
    names = list(columns)
    base = drift.frequencies(baseline_rows, baseline_rows.limit(0), names).select(
        "signal", "category", "baseline_n")
    return (
        daily_frequencies(feed, time, names, late).writeStream.outputMode("append")
        .foreachBatch(_idempotent(path, lambda batch: window_psi(batch, base)))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def store_numeric_baseline(rows: DataFrame, columns: Sequence[str], path: str, bins: int = 10) -> DataFrame:
    """Write the fixed side of numeric drift: ``signal, edges, n, total``, one row a column.

    ``n`` counts the baseline in each of the ``len(edges) + 1`` bins and ``total`` sums its
    values, so baselines over the same edges merge by addition. A column without a value
    has no row. A feed reads this table alone, however large the baseline was.
    """
    edges = stored(drift.baseline_edges(rows, columns, bins), "edges")
    counted = drift.binned(rows, columns, edges).groupBy("signal", "bin").agg(
        F.count(F.lit(1)).alias("k"), F.sum("value").alias("v")).groupBy("signal").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "k"))).alias("by_bin"),
        F.sum("v").alias("total"))
    slots = F.transform(F.sequence(F.lit(0), F.size("edges")),
                        lambda i: F.coalesce(F.element_at("by_bin", i), F.lit(0)).cast("long"))
    edges.join(counted, "signal").select("signal", "edges", slots.alias("n"), "total").write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def daily_bins(feed: DataFrame, time: str, baseline: DataFrame, columns: Sequence[str],
               late: str = "2 days", window: str = "1 day") -> DataFrame:
    """Rows and sum of values per closed window, column and bin of the stored edges.

    NULL values count nowhere. The table of edges has one row a monitored column and is
    broadcast; state is two numbers per window, column and bin, freed by the watermark.
    """
    marked = feed.withWatermark(time, late)
    return (
        drift.binned(marked, columns, baseline.select("signal", "edges"), time)
        .groupBy(F.window(time, window).alias("w"), "signal", "bin")
        .agg(F.count(F.lit(1)).alias("current_n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("window_start"), "signal",
                F.col("bin").cast("string").alias("category"), "current_n", "total"))


def window_numeric_psi(counts: DataFrame, baseline: DataFrame) -> DataFrame:
    """Index and means of every window against a stored numeric baseline."""
    bins = baseline.select("signal", F.posexplode("n").alias("bin", "baseline_n")).where(
        "baseline_n > 0").select("signal", F.col("bin").cast("string").alias("category"), "baseline_n")
    key = ["window_start", "signal"]
    now = counts.groupBy(*key).agg(
        F.sum("current_n").alias("rows"), (F.sum("total") / F.sum("current_n")).alias("current_mean"))
    size = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    old = baseline.select("signal", (F.col("total") / size).alias("baseline_mean"))
    return window_psi(counts.drop("total"), bins).join(now, key).join(old, "signal").select(
        *key, "rows", "psi", "status", "baseline_mean", "current_mean")


def start_daily_numeric_psi(
    feed: DataFrame, baseline: DataFrame, time: str, columns: Sequence[str], path: str,
    checkpoint: str, late: str = "2 days",
) -> StreamingQuery:
    """Numeric drift of each closed day against a table of ``store_numeric_baseline``."""
    return (
        daily_bins(feed, time, baseline, list(columns), late).writeStream.outputMode("append")
        .foreachBatch(_idempotent(path, lambda batch: window_numeric_psi(batch, baseline)))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def start_triage(
    feed: DataFrame, plan: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
) -> StreamingQuery:
    """Each micro-batch of disputes through the case chain, split by queue.

    Rows without an id go to ``failed``; one without a notice date gets the outcome
    that the batch chain gives it. A micro-batch is kept while both parts are written. A restarted job replays its unfinished
    batch over the same folders, so no case is written twice. A feed of one file is one
    task, so the cases are dealt out to all cores before the chain.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        broken = F.col("complaint_id").isNull()
        cores = batch.sparkSession.sparkContext.defaultParallelism
        batch = batch.repartition(cores).persist()
        try:
            plan(batch.where(~broken)).write.mode("overwrite").partitionBy("queue").parquet(
                f"{path}/cases/batch_id={batch_id}")
            batch.where(broken).write.mode("overwrite").parquet(
                f"{path}/failed/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return (feed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


class Attempts(StatefulProcessor):
    """Counts a case's attempts in keyed state and says what becomes of it.

    ``work`` gets the case as a dict and the number of the attempt; raising makes the
    attempt fail. A case that has ended is remembered by a number and a flag, so a repeated
    delivery of it is left out; without ``remember`` its state is freed. Cases pass as rows:
    a pandas frame for each key costs more than the work.
    """

    def __init__(self, work: Callable[[dict, int], None], attempts: int, remember: bool = True):
        self.work, self.attempts, self.remember = work, attempts, remember

    def init(self, handle) -> None:
        self.state = handle.getValueState("attempts", "made int, ended boolean")

    def handleInputRows(self, key, rows, timerValues):
        made, ended = before = self.state.get() or (0, False)
        for row in rows:
            if ended:
                break
            made += 1
            error = None
            try:
                self.work(json.loads(row.payload), made)
            except Exception as raised:  # whatever a step raises is an attempt that failed
                error = f"{type(raised).__name__}: {raised}"
            ended = error is None or made >= self.attempts
            state = "succeeded" if error is None else "dead" if ended else "requeued"
            yield Row(key=key[0], payload=row.payload, attempts=made, state=state, error=error)
        if ended and not self.remember:
            self.state.clear()
        elif (made, ended) != tuple(before):
            self.state.update((made, ended))

    def close(self) -> None:
        pass


class _Held:
    """The state of one case within that of its lot: attempts made, negative once it has ended."""

    def __init__(self, lot: dict[str, int], key: str):
        self.lot, self.key, self.changed = lot, key, False

    def get(self) -> tuple[int, bool] | None:
        made = self.lot.get(self.key)
        return None if made is None else (abs(made), made < 0)

    def update(self, value: tuple[int, bool]) -> None:
        made, ended = value
        self.lot[self.key], self.changed = -made if ended else made, True

    def clear(self) -> None:
        self.changed |= self.lot.pop(self.key, None) is not None


class AttemptsOfLot(StatefulProcessor):
    """``Attempts`` for a lot of cases, whose state is one value.

    An exchange with the state store costs a hundred times what a case does, so it is made once
    a lot and batch. A case has at most ``attempts`` rows to go through in a batch; more are not held.
    """

    def __init__(self, work: Callable[[dict, int], None], attempts: int, remember: bool = True):
        self.cases = Attempts(work, attempts, remember)

    def init(self, handle) -> None:
        self.state = handle.getValueState("lot", "held string")

    def handleInputRows(self, key, rows, timerValues):
        arrived: dict[str, list] = {}
        for row in rows:
            own = arrived.setdefault(row.key, [])
            if len(own) < self.cases.attempts:
                own.append(row)
        before = self.state.get()
        lot = json.loads(before[0]) if before else {}
        changed = False
        for case, own in arrived.items():
            self.cases.state = held = _Held(lot, case)
            yield from self.cases.handleInputRows((case,), iter(own), timerValues)
            changed |= held.changed
        if changed and lot:
            self.state.update((json.dumps(lot),))
        elif changed:
            self.state.clear()

    def close(self) -> None:
        pass


def start_attempts(
    feed: DataFrame, work: Callable[[dict, int], None], plan: Callable[[DataFrame], DataFrame],
    key: str, path: str, checkpoint: str, attempts: int = ATTEMPTS, remember: bool = True,
) -> StreamingQuery:
    """Cases whose ``work`` may fail: tried up to ``attempts`` times, then put into ``dead``.

    A case that fails does not hold up the others of its micro-batch: those that succeeded
    go through ``plan`` into ``cases``, the failed one into ``requeue``, a folder that the
    stream reads as a second source. State is kept by lots of cases (``LOTS``) and survives
    restarts with the checkpoint. The session's state store must be ``ROCKSDB``.
    """
    spark = feed.sparkSession
    requeue = f"{path}/requeue"
    waiting = "key string, payload string"
    spark.createDataFrame([], waiting).write.mode("append").parquet(requeue)
    fresh = feed.where(F.col(key).isNotNull()).select(
        F.col(key).cast("string").alias("key"), F.to_json(F.struct(*feed.columns)).alias("payload"))
    again = spark.readStream.schema(waiting).option("recursiveFileLookup", "true").parquet(requeue)
    lot = F.pmod(F.xxhash64("key"), F.lit(LOTS)).cast("int")
    tried = fresh.unionByName(again).withColumn("lot", lot).groupBy("lot").transformWithState(
        AttemptsOfLot(work, attempts, remember), "key string, payload string, attempts int, state string, error string",
        "Append", "None")
    schema = feed.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            done = batch.where("state = 'succeeded'").select(
                F.from_json("payload", schema).alias("c"), "attempts")
            plan(done.select("c.*", F.col("attempts").alias("work_attempts"))).write.mode("overwrite").parquet(
                f"{path}/cases/batch_id={batch_id}")
            batch.where("state = 'requeued'").select("key", "payload").write.mode("overwrite").parquet(
                f"{requeue}/batch-{batch_id}")
            batch.where("state = 'dead'").select("key", "payload", "attempts", "error").write.mode(
                "overwrite").parquet(f"{path}/dead/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return (tried.writeStream.outputMode("append").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def run_attempts(start: Callable[[], StreamingQuery], attempts: int = ATTEMPTS) -> None:
    """Start the job of ``start_attempts`` as often as its requeued cases need: a run reads what
    was there when it began."""
    for _ in range(attempts):
        start().awaitTermination()


def triage_status(spark: SparkSession, path: str) -> DataFrame:
    """Cases per batch and state: succeeded by queue, or failed."""
    done = spark.read.parquet(f"{path}/cases").groupBy("batch_id", "queue").agg(
        F.count(F.lit(1)).alias("cases")).select(
        "batch_id", F.lit("succeeded").alias("state"), "queue", "cases")
    failed = spark.read.parquet(f"{path}/failed").groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("cases")).select(
        "batch_id", F.lit("failed").alias("state"), F.lit(None).cast("string").alias("queue"),
        "cases")
    return done.unionByName(failed)


def labelled(
    feed: DataFrame, labels: DataFrame, key: str, time: str, label_time: str, within: str,
    late: str = "2 days",
) -> DataFrame:
    """Each row of ``feed`` once, with the label of its key that arrives up to ``within`` after it.

    Both sides are streams. A row waits in state for its label; when the watermark has passed
    its time by ``within`` it goes on without one and its state is freed, as that of a label
    without a row is. A label that comes later than that, by its own time, counts for none.
    """
    once = feed.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    arrived = labels.withWatermark(label_time, late).withColumnRenamed(key, "_label_of")
    on = ((F.col(key) == F.col("_label_of")) & (F.col(label_time) >= F.col(time))
          & (F.col(label_time) <= F.col(time) + F.expr(f"INTERVAL {within}")))
    return once.join(arrived, on, "left").drop("_label_of")


def shadow_windows(
    rows: DataFrame, time: str, incumbent: Column, candidate: Column, segment: Column,
    observed: Column, window: str = "1 day",
) -> DataFrame:
    """Segment counts of each closed window of ``labelled`` rows."""
    recs = rows.select(
        F.window(time, window).alias("w"), incumbent.alias("incumbent"),
        candidate.alias("candidate"), segment.alias("segment"), observed.alias("observed")
    ).withColumn("agreed", F.col("incumbent").eqNullSafe(F.col("candidate")))
    counts = shadow.segment_counts(recs, F.col("w"))
    return counts.select(F.col("w.start").alias("window_start"), *[
        c for c in counts.columns if c != "w"])


def start_shadow(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (counts.writeStream.outputMode("append")
            .foreachBatch(_idempotent(path, lambda batch: batch))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
