"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "remedia", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC, AQE, skew-join splitting."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A cluster names one that every executor can reach. Only where none is set
    (a local session, as in tests) is a temporary folder chosen.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    chosen = os.path.join(tempfile.mkdtemp(prefix="remedia-"), "checkpoints")
    spark.conf.set("spark.checkpoint.dir", chosen)
    return chosen


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for one run of a job."""
    return f"{checkpoint_root(spark)}/remedia/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write below the shared folder and read back: computed once, however often it is used."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*read: DataFrame) -> None:
    """Remove the tables below the shared folder that these read, after their last use."""
    for df in read:
        spark = df.sparkSession
        ours = f"{checkpoint_root(spark)}/remedia/".removeprefix("file://").removeprefix("file:")
        for folder in {os.path.dirname(name) for name in df.inputFiles()}:
            if ours in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


SPLIT_BYTES = 128 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of an input too small to be split by the scan.

    One small file is one scan task, however heavy the work per row. Inputs at
    least as large as one split per core are left as they are, so this adds a
    shuffle only where it is small.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) >= cores * SPLIT_BYTES:
        return df
    return df.repartition(cores)


def unnest(df: DataFrame, items: Column, name: str, *keep: str) -> DataFrame:
    """One row per element that is not NULL.

    A plain ``explode`` makes the optimiser add a filter on the size of the array
    at the scan, which computes an expensive array a second time. The outer form
    does not; its row for an empty array is dropped afterwards.
    """
    return df.select(*keep, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def once(df: DataFrame, *names: str) -> DataFrame:
    """The same rows, with these columns computed once however often they are read above.

    The optimiser writes a computed struct out again at every use of one of its fields, so
    stages that read each other multiply. It does not look through the one-element ``explode``.
    """
    held = F.explode_outer(F.array(F.struct(*names))).alias("_once")
    kept = df.select(*[c for c in df.columns if c not in names], held)
    return kept.select(*[F.col(f"_once.{c}").alias(c) if c in names else F.col(c) for c in df.columns])
