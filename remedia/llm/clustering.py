"""Centroid clustering with a VA-file: few-bit cells decide, full vectors are looked at where they can't.

Every component of a vector is replaced by the cell it lies in, one of ``2**BITS`` of its
dimension: cells of equal width between two outer quantiles of all vectors, and one for the
rest on either side. The cells of a vector are packed into a few bytes stored beside it. For a set of centroids a table gives, for every dimension, cell
and centroid, the least and the greatest squared difference to a number in the cell. Their
sums over the dimensions are the interval of the squared distance, in whole numbers without
rounding. A centroid whose interval begins above the least upper end can't be the nearest; if
one remains, the vector is assigned without its full components being read. Else the exact
distances to the remaining ones decide, ties going to the smaller number.

A round is one scan: tasks assign their vectors and send one sum a centroid. The update needs
the sum of all full vectors, so a scan reads them together with the cells; a separate file of
vectors joined by id would shuffle them every round. What the cells save is the arithmetic:
``Assigner.fetched`` counts the vectors compared in full.

Defined results: only vectors of ``dim`` components, none NULL or not finite, are kept.
Components are held within 2**62, distances and their sums at the largest long. First
centroids come from the smallest hashes of ids; NULL ids come last, rows of one id in order of
their vectors. Fewer rows than centroids give fewer centroids, an empty table an empty
result. Rows that repeat give a row each. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remedia.llm import vectors as v
from remedia.llm.common import stored

DIM = 64
FACTOR = 256
CENTROIDS = 40
ROUNDS = 5
SEED = 2
BITS = 7
TAIL = 0.001      # share of the numbers of a dimension in each of its two outermost cells, about
ACCURACY = 10_000  # of the quantile sketches


class Grid(NamedTuple):
    """Of each dimension the least number of every cell, and the greatest number of all."""

    starts: list[list[int]]
    ends: list[int]


def grid(kept: DataFrame, bits: int = BITS) -> Grid | None:
    """The cells of each dimension, from one aggregate over all rows; None without rows.

    They decide how narrow the intervals are, not what is right: any cells give the same result.
    """
    found = kept.select(F.posexplode("ints").alias("i", "x")).groupBy("i").agg(
        F.min("x").alias("least"), F.max("x").alias("most"),
        F.percentile_approx("x", [TAIL, 1 - TAIL], ACCURACY).alias("ends")).orderBy("i").collect()  # a row a dimension
    if not found:
        return None

    def starts(least: int, most: int, ends: list[int]) -> list[int]:
        low, high = ends[0], ends[1] + 1
        steps = 2**bits - 2
        return sorted({least, *(s for s in (low + (high - low) * j // steps for j in range(steps + 1)) if s <= most)})

    return Grid([starts(r["least"], r["most"], r["ends"]) for r in found], [r["most"] for r in found])


def pack(cells: np.ndarray, bits: int) -> list[bytes]:
    """Rows of cell numbers, ``bits`` bits each."""
    wide = np.unpackbits(cells.astype(np.uint8)[:, :, None], axis=2)[:, :, 8 - bits:]
    return [row.tobytes() for row in np.packbits(wide.reshape(len(cells), -1), axis=1)]


def unpack(column: pa.Array, dim: int, bits: int) -> np.ndarray:
    packed = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    wide = np.unpackbits(packed, axis=1)[:, :dim * bits].reshape(len(column), dim, bits)
    return np.packbits(wide, axis=2)[:, :, 0] >> (8 - bits)


def with_cells(kept: DataFrame, marks: Grid, bits: int = BITS) -> DataFrame:
    """``vec_id, ints, cells``, stored."""
    dim = len(marks.ends)
    schema = kept.select("vec_id", "ints").schema.add("cells", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = [np.array(s, np.int64) for s in marks.starts]
        for batch in batches:
            if batch.num_rows:
                rows = v.matrix(batch.column(1), dim)
                cells = np.stack([np.searchsorted(s, c, "right") - 1 for s, c in zip(starts, rows.T, strict=True)], 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(pack(cells, bits), pa.binary())], names=schema.names)

    return stored(kept.select("vec_id", "ints").mapInArrow(run, schema), "cells")


class Assigner:
    """Nearest centroids through the cells; ``fetched`` counts the vectors compared in full."""

    def __init__(self, centroids: list[list[int]], marks: Grid, bits: int = BITS):
        self.bits, self.dim, self.k, self.fetched = bits, len(marks.ends), len(centroids), 0
        points = np.array(centroids, object)
        reach = max(v.largest(points), *(abs(x) for x in marks.ends), *(abs(s[0]) for s in marks.starts))
        self.kind = v.number_type(reach, self.dim)
        self.points = points.astype(self.kind)
        self.tables = [self._table(s, e, c) for s, e, c in zip(marks.starts, marks.ends, points.T, strict=True)]

    def _table(self, starts: list[int], end: int, coordinate: np.ndarray) -> np.ndarray:
        """A row a cell: least, then greatest squared difference to each centroid."""
        low = np.array(starts, object)[:, None]
        high = np.array([*(s - 1 for s in starts[1:]), end], object)[:, None]
        below, above = low - coordinate, coordinate - high
        least = np.maximum(np.maximum(below, above), 0) ** 2
        most = np.maximum(abs(below), abs(above)) ** 2
        return np.concatenate([least, most], 1).astype(self.kind)

    def nearest(self, packed: pa.Array, ints: pa.Array) -> np.ndarray:
        cells = unpack(packed, self.dim, self.bits)
        bounds = np.zeros((len(cells), 2 * self.k), self.kind)
        for table, column in zip(self.tables, cells.T, strict=True):
            bounds += table[column]
        possible = bounds[:, :self.k] <= bounds[:, self.k:].min(1)[:, None]
        at = possible.argmax(1)
        unclear = np.flatnonzero(possible.sum(1) > 1)
        self.fetched += len(unclear)
        if len(unclear):
            full = v.matrix(ints.take(pa.array(unclear)), self.dim).astype(self.kind)
            best = np.full(len(unclear), -1, self.kind)
            for c in range(self.k):
                here = np.flatnonzero(possible[unclear, c])
                squares = v.squared(full[here], self.points[c:c + 1])[:, 0]
                closer = (best[here] < 0) | (squares < best[here])
                best[here[closer]], at[unclear[here[closer]]] = squares[closer], c
        return at


def centroid_sums(table: DataFrame, centroids: list[list[int]], marks: Grid, bits: int = BITS) -> DataFrame:
    """``cluster, n, sums``: one row a task and centroid in use."""
    k, dim = len(centroids), len(marks.ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assigner = Assigner(centroids, marks, bits)
        total, n = np.zeros((k, dim), object), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                at = assigner.nearest(batch.column(1), batch.column(0))
                total += v.add_up(v.matrix(batch.column(0), dim).astype(assigner.kind), at, k)
                n += np.bincount(at, minlength=k)
        used = np.flatnonzero(n)
        flat = v.decimals(total[used].ravel())
        yield pa.RecordBatch.from_arrays([
            pa.array(used, pa.int32()), pa.array(n[used], pa.int64()),
            pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * dim, pa.int32()), flat)],
            names=["cluster", "n", "sums"])

    return table.select("ints", "cells").mapInArrow(run, "cluster int, n long, sums array<decimal(38,0)>")


def assign(table: DataFrame, centroids: list[list[int]], marks: Grid, bits: int = BITS) -> DataFrame:
    """``vec_id, cluster, distance``"""
    schema = table.select("vec_id").schema.add("cluster", "integer").add("distance", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assigner = Assigner(centroids, marks, bits)
        for batch in batches:
            if batch.num_rows:
                at = assigner.nearest(batch.column(2), batch.column(1))
                full = v.matrix(batch.column(1), assigner.dim).astype(assigner.kind)
                distance = ((full - assigner.points[at]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(at, pa.int32()), v.as_longs(distance)], names=schema.names)

    return table.select("vec_id", "ints", "cells").mapInArrow(run, schema)


def first_centroids(table: DataFrame, k: int, seed: int) -> list[list[int]]:
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r["ints"] for r in table.orderBy(F.asc_nulls_last(order), "ints").limit(k).select("ints").collect()]


def cluster(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED,
            bits: int = BITS) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector."""
    kept = embeddings.where(v.is_finite("embedding") & (F.size("embedding") == dim)).select(
        "vec_id", v.whole("embedding", FACTOR).alias("ints"))
    marks = grid(kept, bits)
    if marks is None:
        return kept.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (
            ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"),
            ("centroid_sha256", "string"))])
    table = with_cells(kept, marks, bits)
    centroids = first_centroids(table, k, seed)
    for _ in range(rounds):
        found = v.mean_floors(centroid_sums(table, centroids, marks, bits), "cluster")
        centroids = [found.get((c,), old) for c, old in enumerate(centroids)]
    out = stored(assign(table, centroids, marks, bits), "clusters")
    inertia = {r["cluster"]: int(r["t"]) for r in out.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("t")).collect()}  # one row a centroid

    def by_cluster(values: list, kind: str):
        return F.get(F.array(*[F.lit(x).cast(kind) for x in values]), F.col("cluster"))

    own = [min(inertia.get(c, 0), v.LONG_MAX) for c in range(len(centroids))]
    return out.select(
        "vec_id", "cluster", "distance", by_cluster(own, "long").alias("cluster_inertia"),
        F.lit(min(sum(inertia.values()), v.LONG_MAX)).cast("long").alias("inertia"),
        by_cluster([v.digest([c]) for c in centroids], "string").alias("centroid_sha256"))
