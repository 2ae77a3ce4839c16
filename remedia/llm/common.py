"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remedia.session import scratch_path

#: Fixed: the white space that words and lines are cut and stripped at.
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write below the shared checkpoint folder and read back: the lineage ends here.

    Files written by the committer survive a lost executor. The folder belongs to
    the run; whoever owns ``spark.checkpoint.dir`` removes it after the results
    have been written.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ARROW = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(),
         "boolean": pa.bool_()}


def add_columns(rows: DataFrame, inputs: Sequence[str], make: Callable[[], Callable], fields: dict[str, str],
                drop: Sequence[str] | None = None) -> DataFrame:
    """``rows`` without ``drop`` (the inputs, unless given), and new ``fields`` (name -> type).

    ``make`` runs once a task; what it returns gets the inputs of a batch as lists, NULLs as
    None, and returns the fields' values. The other columns stay Arrow columns, so ids keep
    all their digits beside NULLs.
    """
    gone = set(inputs if drop is None else drop)
    at = [rows.columns.index(c) for c in inputs]
    kept = [i for i, c in enumerate(rows.columns) if c not in gone]
    schema = T.StructType([rows.schema.fields[i] for i in kept])
    for name, kind in fields.items():
        schema = schema.add(name, kind)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            found = work(*[batch.column(i).to_pylist() for i in at])
            new = [pa.array(v, ARROW[kind]) for v, kind in zip(found, fields.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], *new], names=names)

    return rows.mapInArrow(run, schema)


def ascii_lower(text: Column) -> Column:
    """A-Z lowered, nothing else. Pure ASCII text takes the short way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower()))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_hash(*parts: str) -> Column:
    """64 bits that tell apart rows of one id, NULLs included."""
    flags = [F.coalesce(F.col(p).isNull(), F.lit(True)) for p in parts]
    return F.xxhash64(*flags, *[F.col(p) for p in parts])


def words(text: str | None) -> list[bytes]:
    """Words cut at ASCII white space, in UTF-8."""
    return text.encode("utf-8").split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """Words with A-Z lowered; other letters stay, as bytes.lower() touches ASCII alone."""
    return text.encode("utf-8").lower().split() if text else []
