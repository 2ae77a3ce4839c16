"""Vector code compression: product codes whose nearest entries are found with GNATs.

A vector of whole numbers is cut into equal parts; each part position has a codebook and a
part is replaced by the number of its nearest entry. A codebook is searched through a
geometric near-neighbour access tree: a node holds a few split points, the other entries
belong to the nearest split point, and for every pair (split point i, child j) it stores the
range of distances from i to the members of j. A part goes first into the child of its
nearest split point. Then a child is left out if, for any split point, the distance of the
part to it differs from the stored range by more than the best distance so far: strictly
more, with roots rounded outwards, so that no equal distance is lost. Distances themselves
are compared as integers, equal ones by the entry's number.

A round is one scan of the stored vectors: tasks assign their parts and send the sums of
each entry's parts, one row an entry; nothing else is shuffled. The driver holds the
codebooks alone (``parts * entries`` rows). The sums by label join salted where a label is hot.

Defined results: rows whose vector is NULL, or holds NULL or a number that isn't finite, go;
so do those whose length is not the most frequent among the lengths that can be cut (of
equally frequent ones the smallest). Components are held within 2**62, errors and their sums
at the largest long. The first entries are those of the smallest ids, NULL ids last, rows of
one id in order of their vectors; fewer rows than entries give a smaller codebook. Rows that
repeat give a row each. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remedia.llm import vectors as v
from remedia.llm.common import stored
from remedia.operators.skew import join_unique

PARTS = 4
ENTRIES = 256       # two hexadecimal digits an entry
ROUNDS = 4
FACTOR = 1024
SPLITS = 8          # split points of a node
LEAF = 12           # entries that are not split further
MARGIN = 2.0 ** -50  # more than the relative error of a rounded root or difference


class Node(NamedTuple):
    splits: np.ndarray           # entry numbers, ascending
    low: np.ndarray              # least distance from split point i to a member of child j, rounded down
    high: np.ndarray             # greatest, rounded up
    children: list[Node | None]


def _grow(points: np.ndarray, numbers: np.ndarray) -> Node:
    if len(numbers) <= LEAF:
        return Node(numbers, np.empty((0, 0)), np.empty((0, 0)), [])
    chosen = [0]  # each further split point is the entry farthest from those chosen
    apart = v.squared(points[numbers], points[numbers[:1]])[:, 0]
    for _ in range(SPLITS - 1):
        open_ = np.ones(len(numbers), bool)
        open_[chosen] = False
        at = np.flatnonzero(open_)
        chosen.append(int(at[np.argmax(apart[at])]))
        apart = np.minimum(apart, v.squared(points[numbers], points[numbers[chosen[-1:]]])[:, 0])
    splits = np.sort(numbers[chosen])
    rest = np.setdiff1d(numbers, splits)
    home = np.argmin(v.squared(points[rest], points[splits]), 1)
    low, high, children = np.zeros((SPLITS, SPLITS)), np.full((SPLITS, SPLITS), -1.0), []
    for j in range(SPLITS):
        members = rest[home == j]
        children.append(_grow(points, members) if len(members) else None)
        if len(members):
            root = np.sqrt(v.squared(points[splits], points[members]).astype(np.float64))
            low[:, j], high[:, j] = root.min(1) * (1 - MARGIN), root.max(1) * (1 + MARGIN)
    return Node(splits, low, high, children)


class Gnat:
    """The tree of one codebook; ``scored`` counts distances to entries."""

    def __init__(self, points: np.ndarray):
        self.points, self.scored = points, 0
        self.root = _grow(points, np.arange(len(points)))

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest entry of each row and the squared distance; ties to the smaller number."""
        best = np.full(len(rows), -1, rows.dtype)
        at = np.full(len(rows), -1)
        self._visit(self.root, rows, np.arange(len(rows)), best, at)
        return at, best

    def _visit(self, node: Node, rows: np.ndarray, here: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        squares = v.squared(rows[here], self.points[node.splits])
        self.scored += squares.size
        first = np.argmin(squares, 1)  # of equal ones the smallest number
        least, number = squares[np.arange(len(here)), first], node.splits[first]
        better = (at[here] < 0) | (least < best[here]) | ((least == best[here]) & (number < at[here]))
        best[here[better]], at[here[better]] = least[better], number[better]
        if not node.children:
            return
        for j, child in enumerate(node.children):
            if child and (own := here[first == j]).size:
                self._visit(child, rows, own, best, at)
        root = np.sqrt(squares.astype(np.float64))
        down, up = root * (1 - MARGIN), root * (1 + MARGIN)
        for j, child in enumerate(node.children):
            if child:
                gap = np.maximum(down - node.high[:, j], node.low[:, j] - up).max(1) * (1 - MARGIN)
                bound = np.sqrt(best[here].astype(np.float64)) * (1 + MARGIN)
                left = here[(first != j) & (gap <= bound)]
                if left.size:
                    self._visit(child, rows, left, best, at)


class Search:
    """The trees of all part positions, in a number type that is exact for the batch at hand."""

    def __init__(self, codebooks: list[list[list[int]]]):
        self.books = [np.array(b, object) for b in codebooks]
        self.bound = max(v.largest(b) for b in self.books)
        self.trees: dict[type, list[Gnat]] = {}

    def parts(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each part position: the rows' parts, the numbers of their entries, their squared distances."""
        kind = v.number_type(max(self.bound, v.largest(rows)), rows.shape[1])
        if kind not in self.trees:
            self.trees[kind] = [Gnat(b.astype(kind)) for b in self.books]
        for tree, part in zip(self.trees[kind], np.split(rows.astype(kind), len(self.books), 1), strict=True):
            yield part, *tree.nearest(part)


def prepare(embeddings: DataFrame, parts: int = PARTS) -> tuple[DataFrame, int]:
    """``vec_id, label, ints`` of the rows that are kept, stored, and their number of components."""
    kept = stored(embeddings.where(v.is_finite("embedding")).select(
        "vec_id", "label", v.whole("embedding", FACTOR).alias("ints")), "vectors")
    sizes = kept.groupBy(F.size("ints").alias("size")).count().where((F.col("size") > 0) & (F.col("size") % parts == 0))
    common = sizes.orderBy(F.desc("count"), "size").first()
    dim = common["size"] if common else 0
    return kept.where(F.size("ints") == dim), dim


def first_codebooks(kept: DataFrame, parts: int, entries: int) -> list[list[list[int]]]:
    rows = kept.orderBy(F.asc_nulls_last("vec_id"), "ints").limit(entries).select("ints").collect()
    width = len(rows[0]["ints"]) // parts if rows else 0
    return [[r["ints"][p * width:(p + 1) * width] for r in rows] for p in range(parts)]


def entry_sums(kept: DataFrame, codebooks: list[list[list[int]]], dim: int) -> DataFrame:
    """``part, entry, n, sums``: one row a task and entry in use."""
    parts, entries = len(codebooks), len(codebooks[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(codebooks)
        total = np.zeros((parts, entries, dim // parts), object)
        n = np.zeros((parts, entries), np.int64)
        for batch in batches:
            if batch.num_rows:
                for p, (part, at, _) in enumerate(search.parts(v.matrix(batch.column(0), dim))):
                    total[p] += v.add_up(part, at, entries)
                    n[p] += np.bincount(at, minlength=entries)
        p, e = np.nonzero(n)
        flat = v.decimals(total[p, e].ravel())
        width = dim // parts
        yield pa.RecordBatch.from_arrays([
            pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e], pa.int64()),
            pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * width, pa.int32()), flat)],
            names=["part", "entry", "n", "sums"])

    return kept.select("ints").mapInArrow(run, "part int, entry int, n long, sums array<decimal(38,0)>")


def train(kept: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES,
          rounds: int = ROUNDS) -> list[list[list[int]]]:
    """Codebooks by part position: entries of whole components."""
    codebooks = first_codebooks(kept, parts, entries)
    for _ in range(rounds if codebooks[0] else 0):
        found = v.mean_floors(entry_sums(kept, codebooks, dim), "part", "entry")
        codebooks = [[found.get((p, e), old) for e, old in enumerate(book)] for p, book in enumerate(codebooks)]
    return codebooks


def encode(kept: DataFrame, codebooks: list[list[list[int]]], dim: int) -> DataFrame:
    """``vec_id, label, code, error``"""
    schema = kept.select("vec_id", "label").schema.add("code", "string").add("error", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, digits = Search(codebooks), np.array([f"{i:02x}" for i in range(ENTRIES)], object)
        for batch in batches:
            if not batch.num_rows:
                continue
            code, error = np.full(batch.num_rows, "", object), 0
            for _, at, squares in search.parts(v.matrix(batch.column(2), dim)):
                code, error = code + digits[at], error + squares
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(code, pa.string()), v.as_longs(error)], names=schema.names)

    return kept.select("vec_id", "label", "ints").mapInArrow(run, schema)


def decode(codes: DataFrame, codebooks: list[list[list[int]]], code: str = "code", out: str = "ints") -> DataFrame:
    """``codes`` with the entries that a code names, put together: the vector it stands for."""
    books = F.from_json(F.lit(json.dumps(codebooks)), "array<array<array<bigint>>>")
    pick = [F.get(F.get(F.col("_books"), F.lit(p)), F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int"))
            for p in range(len(codebooks))]
    return codes.withColumn("_books", books).withColumn(out, F.concat(*pick)).drop("_books")


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` of every kept vector of ``vec_id, embedding, label``."""
    if not 0 < entries <= ENTRIES:
        raise ValueError(f"entries must be 1 to {ENTRIES}: a code has two digits an entry")
    kept, dim = prepare(embeddings, parts)
    codebooks = train(kept, dim, parts, entries, rounds)
    coded = stored(encode(kept, codebooks, dim), "codes").withColumn("_key", F.coalesce(
        F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    totals = coded.groupBy("_key").agg(v.long_sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n"))
    joined = join_unique(coded, totals, "_key", "_n", F.lit(coded.count()), ["vec_id", "code", "error"])
    shown = v.digest(entry for book in codebooks for entry in book)
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(shown).alias("codebooks_sha256"))
