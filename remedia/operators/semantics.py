"""Latent semantics: a truncated SVD of the weighted term matrix by a randomised range finder.

The matrix ``A`` has a row a document (unit length) and a column a term. A block of random
signs, hashed from the terms, is multiplied by ``A' A`` a fixed number of times, ``POWER_STEPS``
of them after being made orthonormal, and the leading directions are read off the small
matrix of what remains. Sizes do not change the way it goes.

The corpus is tokenised once and its documents are dealt into chunks of about ``CHUNK_BYTES``
of text, more where there are many of them: the larger a chunk, the fewer terms it shares. A chunk is one row: its distinct terms, and its documents as places among them and
counts, packed as numbers. Chunks and the weights of their terms are bucketed tables that later
steps read without a shuffle; no term is read, compared or moved as text after that. In a step a
chunk multiplies its documents by the block and back. Only rows of terms that occur in several
chunks travel: the chunk sends one packed piece to each of as many parts, where the rows are
added up. The sums are stored once, and each piece comes back as it went when the next step reads
them. The row of a term of one chunk
alone is made again in that chunk from the products of its documents, which are few numbers a
document. What a step has read for the last time is removed. The driver holds matrices of the
block's width squared.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remedia import policy
from remedia.functions.text import tokenize
from remedia.operators.terms import counted_terms, document_texts, query_counts
from remedia.session import discard, scratch_path, stored, unnest

POWER_STEPS = 2
OVERSAMPLING = 10        # columns of the block beyond those asked for
CHUNK_BYTES = 16 << 20   # text in a task's hands, about
FEW_CHUNKS = 32          # beyond so many, chunks grow
LARGEST = 6              # to at most so many times their size
TURNED = 1 << 17         # rows turned at once
OWNERS = 4096            # documents weighed at once
LOT_TERMS = 1 << 20      # terms of queries in a task's hands, about, where there are many queries
PART_TERMS = 1 << 16     # rows of factors beside them, about
RANK = 1e-14             # directions with less than this share of the largest are none
SHARED, PRODUCTS, GRAM = 1, 2, 3  # kinds of rows of a block: of terms of several chunks; of a chunk's documents; products of columns


class Projection(NamedTuple):
    factors: DataFrame    # term, idf, factor (vector)
    vectors: DataFrame    # doc_id, vector (unit length array)


class TermMatrix(NamedTuple):
    """Counts of terms by document, and the weights that make them a matrix."""

    tables: tuple[str, str]  # the bucketed tables
    rows: DataFrame       # doc_id, row, chunk, terms, counts: cut anew when read
    packed: DataFrame     # a row a chunk: its documents and the weights of its terms
    terms: DataFrame      # term, id, df, idf
    docs: int
    n_terms: int
    chunks: int


def unit(vector: Column) -> Column:
    """At length 1. The length is the one element of an array, so that it is worked out once, not for every number."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.get(F.transform(F.array(norm), lambda n: F.transform(
        vector, lambda x: F.when(n == 0, x).otherwise(x / n))), F.lit(0))


def _pack(docs: pa.Table) -> pa.Table:
    """The documents of a chunk as one row: distinct terms, places among them, counts."""
    docs = docs.take(pc.sort_indices(docs.column("row")))
    lists = docs.column("terms").combine_chunks()
    code = lists.flatten().dictionary_encode()
    at = code.indices.to_numpy().astype(np.int32)
    n = np.bincount(at, minlength=len(code.dictionary))
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pa.table([
        docs.column("chunk").slice(0, 1), one(docs.column("doc_id").combine_chunks()), one(code.dictionary),
        one(pa.array(n, pa.int32())), pa.array([lists.value_lengths().to_numpy().astype(np.int32).tobytes()]),
        pa.array([at.tobytes()]),
        pa.array([docs.column("counts").combine_chunks().flatten().to_numpy().astype(np.int32).tobytes()])],
        names=["chunk", "docs", "terms", "n", "lengths", "at", "counts"])


def _weigh(known: pa.Table) -> pa.Table:
    """The terms of a chunk, in their places, as one row."""
    known = known.sort_by("pos")
    blob = lambda name, kind: pa.array([known.column(name).to_numpy().astype(kind).tobytes()])
    return pa.table([known.column("chunk").slice(0, 1), blob("id", np.int64), blob("idf", np.float64),
                     blob("hash", np.int64), blob("shared", bool), blob("lead", bool)],
                    names=["chunk", "id", "idf", "hash", "shared", "lead"])


def chunk_count(size: int) -> int:
    """Chunks of ``size`` bytes of text."""
    return max(1, min(-(-size // CHUNK_BYTES), FEW_CHUNKS), -(-size // (LARGEST * CHUNK_BYTES)))


def term_matrix(corpus: DataFrame) -> TermMatrix:
    spark = corpus.sparkSession
    docs, size = corpus.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    chunks = chunk_count(size)
    counted = counted_terms(document_texts(corpus), "doc_id").drop("length").withColumn(
        "row", F.monotonically_increasing_id()).withColumn(
        "chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int"))

    def bucketed(rows: DataFrame, kind: str) -> str:
        name = f"{kind}_{uuid.uuid4().hex}"
        rows.write.bucketBy(chunks, "chunk").option("path", scratch_path(spark, kind)).saveAsTable(name)
        return name

    of_docs = T.StructType([
        T.StructField("chunk", T.IntegerType()), T.StructField("docs", T.ArrayType(counted.schema["doc_id"].dataType)),
        T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("n", T.ArrayType(T.IntegerType())),
        *[T.StructField(name, T.BinaryType()) for name in ("lengths", "at", "counts")]])
    held = bucketed(counted.repartition(chunks, "chunk").groupBy("chunk").applyInArrow(_pack, of_docs), "chunks")
    needs = spark.table(held).select("chunk", F.posexplode(F.arrays_zip("terms", "n")).alias("pos", "t")).select(
        "chunk", "pos", F.col("t.terms").alias("term"), F.col("t.n").alias("n"))
    terms = stored(needs.groupBy("term").agg(
        F.sum("n").alias("df"), F.count(F.lit(1)).alias("in"), F.min("chunk").alias("first")).select(
        "term", "df", "in", "first", (F.ln((1.0 + docs) / (1 + F.col("df"))) + 1.0).alias("idf"),
        F.monotonically_increasing_id().alias("id")), "terms")
    known = needs.join(terms, "term").select(
        "chunk", "pos", "id", "idf", F.xxhash64("term").alias("hash"), (F.col("in") > 1).alias("shared"),
        (F.col("first") == F.col("chunk")).alias("lead"))
    weighed = bucketed(known.groupBy("chunk").applyInArrow(
        _weigh, "chunk int, id binary, idf binary, hash binary, shared binary, lead binary"), "weights")
    packed = spark.table(held).select("chunk", "docs", "lengths", "at", "counts").join(
        spark.table(weighed).hint("merge"), "chunk")
    return TermMatrix((held, weighed), counted, packed, terms.select("term", "id", "df", "idf"), docs, terms.count(),
                      chunks)


def _signs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rows of 1 and -1 from 64-bit hashes, 64 to a hash mixed anew."""
    out = []
    for block in range(-(-width // 64)):
        with np.errstate(over="ignore"):  # the steps of a 64-bit finaliser, wrapping as they should
            h = hashes.astype(np.int64).view(np.uint64) + np.uint64((block + 1) * 0x9E3779B97F4A7C15 % 2**64)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
            h ^= h >> np.uint64(31)
        out.append((h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1))
    return np.concatenate(out, 1)[:, :width].astype(np.float64) * 2 - 1


def _packed(rows: np.ndarray) -> pa.Array:
    """Rows as bytes of single precision, which halves what is moved."""
    rows = np.ascontiguousarray(rows, np.float32)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1] * 4)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def _rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.float32).reshape(len(values), -1).astype(np.float64)


class Chunk:
    """A chunk's documents in order, its terms and the rows of ``Q`` it needs.

    ``Q`` is the block that was sent times the small matrix ``turn``, or the signs. A shared
    term's rows are added up in the part of its id.
    """

    def __init__(self, held: pa.Table, sent: pa.Table, turn: np.ndarray | None, width: int, parts: int):
        of = lambda name, kind: np.frombuffer(held.column(name)[0].as_buffer(), kind)
        self.docs = held.column("docs").combine_chunks().flatten()
        lengths = of("lengths", np.int32)
        self.ends = np.r_[0, np.cumsum(lengths, dtype=np.int64)]
        self.at, self.ids = of("at", np.int32), of("id", np.int64)
        self.shared, self.lead = of("shared", bool), of("lead", bool)
        counts, idf = of("counts", np.int32), of("idf", np.float64)
        self.weights = np.empty(len(counts))
        for begin in range(0, len(lengths), OWNERS):  # some documents at a time, for what is made beside the weights
            some = lengths[begin:begin + OWNERS]
            a, b = self.ends[begin], self.ends[begin + len(some)]
            weights = (1.0 + np.log(counts[a:b])) * idf[self.at[a:b]]
            owner = np.repeat(np.arange(len(some)), some)
            norms = np.sqrt(np.bincount(owner, weights * weights, len(some)))
            self.weights[a:b] = weights / norms[owner] if len(weights) else weights
        places = np.flatnonzero(self.shared)
        part = self.ids[places] % parts
        self.pieces = [(p, places[part == p]) for p in np.unique(part).tolist()]
        if turn is None:
            self.q = _signs(of("hash", np.int64), width)
            return
        kinds, values = sent.column("kind").to_numpy(), sent.column("v")
        rows = lambda i: np.frombuffer(values[int(i)].as_buffer(), np.float32).reshape(-1, len(turn))
        z = self.back(rows(np.flatnonzero(kinds == PRODUCTS)[0]).astype(np.float64))
        came = {p: i for i, (p, k) in enumerate(zip(sent.column("part").to_pylist(), kinds.tolist(), strict=True))
                if k == SHARED}
        for p, at in self.pieces:
            z[at] = rows(came[p])
        for begin in range(0, len(z), TURNED):  # in place: there is no second block beside it
            z[begin:begin + TURNED, :turn.shape[1]] = z[begin:begin + TURNED] @ turn
        self.q = z[:, :turn.shape[1]]

    def products(self) -> np.ndarray:
        """A row for each document: the sum of its terms' rows of ``Q``."""
        out = np.zeros((len(self.ends) - 1, self.q.shape[1]))
        for i, (a, b) in enumerate(zip(self.ends[:-1], self.ends[1:], strict=True)):
            out[i] = self.weights[a:b] @ self.q[self.at[a:b]]
        return out

    def back(self, products: np.ndarray) -> np.ndarray:
        """A row for each term: the sum of its documents' products."""
        out = np.zeros((len(self.ids), products.shape[1]))
        for i, (a, b) in enumerate(zip(self.ends[:-1], self.ends[1:], strict=True)):
            out[self.at[a:b]] += self.weights[a:b, None] * products[i]  # a document's terms differ
        return out


BLOCK = "of int, part int, kind int, ids binary, v binary"


def _on_chunks(matrix: TermMatrix, block: DataFrame | None, work: Callable, schema: T.StructType | str) -> DataFrame:
    if block is None:
        return matrix.packed.groupBy("chunk").applyInArrow(lambda held: work(held, None), schema)
    names = ["of", "part", "kind", "v"]

    def back(rows: pa.Table) -> pa.Table:
        """The sums of a part as pieces again: what is at the places of each."""
        ids, v = rows.column("ids").to_pylist(), rows.column("v").to_pylist()
        first = next(i for i, x in enumerate(ids) if x is not None)
        at = [np.frombuffer(y if x is None else x, np.int32) for x, y in zip(ids, v, strict=True)]
        sums = np.frombuffer(v[first], np.float32).reshape(1 + max(int(x.max()) for x in at), -1)
        return pa.table([*[rows.column(c) for c in names[:3]], pa.array([sums[x].tobytes() for x in at], pa.binary())], names)

    pieces = block.where(F.col("kind") == SHARED).groupBy("part").applyInArrow(back, "of int, part int, kind int, v binary")
    sent = pieces.unionByName(block.where(F.col("kind") == PRODUCTS).select(*names))
    return matrix.packed.groupBy("chunk").cogroup(sent.groupBy("of")).applyInArrow(work, schema)


def _block(rows: list[tuple]) -> pa.Table:
    of, part, kind, ids, v = zip(*rows, strict=True)
    return pa.table([pa.array(of, pa.int32()), pa.array(part, pa.int32()), pa.array(kind, pa.int32()),
                     pa.array(ids, pa.binary()), pa.array(v, pa.binary())], names=["of", "part", "kind", "ids", "v"])


def _returned(matrix: TermMatrix, block: DataFrame | None, turn: np.ndarray | None, width: int) -> DataFrame:
    """``A' A Q`` as a block: for every chunk and part the places of the chunk's shared terms in the sums
    of the part. These stand once, in the first of its rows, which has its places beside them."""
    parts = matrix.chunks

    def work(held: pa.Table, sent: pa.Table | None) -> pa.Table:
        chunk = Chunk(held, sent, turn, width, parts)
        products = chunk.products()
        del chunk.q
        z = chunk.back(products)
        own, of = z[~chunk.shared], held.column("chunk")[0].as_py()
        rows = [(of, of, PRODUCTS, None, products.astype(np.float32).tobytes()), (of, of, GRAM, None, (own.T @ own).tobytes())]
        del own
        rows += [(of, p, SHARED, chunk.ids[at].tobytes(), z[at].astype(np.float32).tobytes()) for p, at in chunk.pieces]
        del z, chunk
        return _block(rows)

    def add(pieces: pa.Table) -> pa.Table:
        whole = pieces.filter(pc.not_equal(pieces.column("kind"), SHARED)).select(["of", "part", "kind", "ids", "v"])
        # sums in one order, whichever way the pieces came
        pieces = pieces.filter(pc.equal(pieces.column("kind"), SHARED)).sort_by("of")
        if not pieces.num_rows:
            return whole
        sizes = [len(x) // 8 for x in pieces.column("ids").to_pylist()]
        ids = np.frombuffer(b"".join(pieces.column("ids").to_pylist()), np.int64)
        rows = np.frombuffer(b"".join(pieces.column("v").to_pylist()), np.float32).reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        lead = np.r_[True, ids[order][1:] != ids[order][:-1]]
        sums = np.add.reduceat(rows[order].astype(np.float64), np.flatnonzero(lead)).astype(np.float32)
        place = np.empty(len(ids), np.int32)
        place[order] = np.cumsum(lead) - 1
        wide = sums.astype(np.float64)
        part, ends = pieces.column("part")[0].as_py(), np.r_[0, np.cumsum(sizes)]
        back = [(of, part, SHARED, None, place[a:b].tobytes()) if a else (
            of, part, SHARED, place[a:b].tobytes(), sums.tobytes()) for of, a, b in zip(
            pieces.column("of").to_pylist(), ends[:-1], ends[1:], strict=True)]
        return pa.concat_tables([whole, _block([(part, part, GRAM, None, (wide.T @ wide).tobytes()), *back])])

    pieces = _on_chunks(matrix, block, work, BLOCK)
    return stored(pieces.repartition(parts, "part").groupBy("part").applyInArrow(add, BLOCK), "block")


def _last_products(matrix: TermMatrix, block: DataFrame, turn: np.ndarray, width: int) -> DataFrame:
    """``A Q`` (``doc_id, v``) and, where ``id`` is set, rows of ``Q``, each from one chunk that has the term."""
    schema = T.StructType([T.StructField("doc_id", matrix.rows.schema["doc_id"].dataType),
                           T.StructField("id", T.LongType()), T.StructField("v", T.BinaryType())])
    parts = matrix.chunks

    def work(held: pa.Table, sent: pa.Table) -> pa.Table:
        chunk = Chunk(held, sent, turn, width, parts)
        ids = pa.array(chunk.ids[chunk.lead])
        return pa.table([
            pa.concat_arrays([chunk.docs, pa.nulls(len(ids), chunk.docs.type)]),
            pa.concat_arrays([pa.nulls(len(chunk.docs), pa.int64()), ids]),
            pa.concat_arrays([_packed(chunk.products()), _packed(chunk.q[chunk.lead])])], names=["doc_id", "id", "v"])

    return stored(_on_chunks(matrix, block, work, schema), "products")


def _gram(rows: DataFrame, width: int) -> np.ndarray:
    """Products of the columns of ``v`` with each other: ``width * width`` numbers."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch.column(0))
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    return _sum(rows.select("v").mapInArrow(multiply, "total binary"), "total", width)


def _sum(matrices: DataFrame, name: str, width: int) -> np.ndarray:
    """The sum of small matrices, added up by tasks first, in a fixed order of their bytes."""

    def add(table: pa.Table) -> pa.Table:
        found = sorted(table.column(1).to_pylist())
        total = np.sum([np.frombuffer(m) for m in found], 0)
        return pa.table([pa.array([total.tobytes()], pa.binary())], names=["total"])

    few = matrices.select(F.pmod(F.xxhash64(name), F.lit(64)).alias("_lot"), F.col(name).alias("total")).groupBy(
        "_lot").applyInArrow(add, "total binary").collect()
    return np.sum([np.zeros(width * width), *[np.frombuffer(m) for m in sorted(
        bytes(r["total"]) for r in few)]], 0).reshape(width, width)


def _block_gram(block: DataFrame, width: int) -> np.ndarray:
    return _sum(block.where(F.col("kind") == GRAM), "v", width)


def _orthonormal(gram: np.ndarray) -> np.ndarray:
    """The matrix that makes columns with these products orthonormal, without null directions."""
    size, axes = np.linalg.eigh(gram)
    held = size > size[-1] * RANK
    return axes[:, held] / np.sqrt(size[held])


def _turned(rows: DataFrame, key: str, turn: np.ndarray, out: str, scaled: bool) -> DataFrame:
    """``key, out``: rows times a small matrix, as arrays; if ``scaled`` at unit length, zero ones as NULL."""
    schema = rows.select(key).schema.add(out, T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch.column(1)) @ turn
                none = np.zeros(len(x), bool)
                if scaled:
                    norm = np.sqrt((x * x).sum(1, keepdims=True))
                    none = norm[:, 0] == 0
                    x = x / np.where(norm == 0, 1, norm)
                found = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()), mask=pa.array(none))
                yield pa.RecordBatch.from_arrays([batch.column(0), found], names=schema.names)

    return rows.select(key, "v").mapInArrow(run, schema)


def fit_projection(corpus: DataFrame, dim: int = policy.EMBED_DIM) -> Projection:
    """The leading ``dim`` directions of the terms, and every document in them.

    The subspace is that of ``POWER_STEPS`` power steps: leading directions are those of the
    full decomposition to many digits, the last ones of ``dim`` less exactly (the test states
    by how much). A document without terms gets a NULL vector, which scores 0 against all.
    """
    conf, kept = corpus.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(kept)
    conf.set(kept, "true")  # a step's result is stored: its shuffles would only fill the disks
    try:
        return _fitted(corpus, dim)
    finally:
        conf.set(kept, before)


def _fitted(corpus: DataFrame, dim: int) -> Projection:
    matrix = term_matrix(corpus)
    if not matrix.n_terms:
        empty = matrix.terms.select("term", "idf", array_to_vector(F.array().cast("array<double>")).alias("factor"))
        return Projection(empty, corpus.select(F.col("id").alias("doc_id"), F.lit(None).cast("array<double>").alias("vector")))
    k = max(1, min(dim, min(matrix.n_terms, matrix.docs) - 1))
    width = min(k + OVERSAMPLING, matrix.docs, matrix.n_terms)
    block = _returned(matrix, None, None, width)
    for _ in range(POWER_STEPS):
        turn = _orthonormal(_block_gram(block, width))
        read, block, width = block, _returned(matrix, block, turn, width), turn.shape[1]
        discard(read)
    turn = _orthonormal(_block_gram(block, width))
    last = _last_products(matrix, block, turn, width)
    discard(block)
    products, rows = last.where("id IS NULL"), last.where("id IS NOT NULL")
    axes = np.linalg.eigh(_gram(products, turn.shape[1]))[1][:, ::-1][:, :k]
    factors = stored(matrix.terms.join(_turned(rows, "id", axes, "factor", False), "id").select(
        "term", "idf", array_to_vector("factor").alias("factor")), "factors")
    discard(matrix.packed, matrix.terms)
    for name in matrix.tables:
        corpus.sparkSession.sql(f"DROP TABLE {name}")
    return Projection(factors, _turned(products, "doc_id", axes, "vector", True))


def embed_queries(queries: DataFrame, projection: Projection) -> DataFrame:
    """``query_id, vector``: sums of ``w * factor`` over the terms of each query, at unit length.

    A query without known terms keeps a NULL vector.
    """
    tokens = queries.select("query_id", tokenize(F.col("query")).alias("tokens"))
    weighted = unnest(tokens, F.col("tokens"), "term", "query_id").groupBy("query_id", "term").agg(
        (1.0 + F.ln(F.count(F.lit(1)))).alias("tf"))
    joined = weighted.join(projection.factors, "term").select(
        "query_id", (F.col("tf") * F.col("idf")).alias("w"), "factor")
    total = joined.groupBy("query_id").agg(
        Summarizer.metrics("sum").summary(F.col("factor"), F.col("w")).alias("s"))
    found = total.select("query_id", unit(vector_to_array("s.sum")).alias("vector"))
    return queries.select("query_id").join(found, "query_id", "left")


def _sums_of_part(asked: pa.Table, held: pa.Table) -> pa.Table:
    """For each query of a lot the weighted sum of the factors of a part; NULL where it has none of them."""
    terms, factors = held.column("term").combine_chunks(), held.column("factor").combine_chunks()
    factors = factors.flatten().to_numpy().reshape(len(terms), -1) * held.column("idf").to_numpy()[:, None]
    lists, counts = asked.column("terms").combine_chunks(), asked.column("counts").combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    at = pc.fill_null(pc.index_in(lists.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(sizes)), sizes)[at >= 0]
    weight, at = 1.0 + np.log(counts.flatten().to_numpy()[at >= 0]), at[at >= 0]
    sums = np.zeros((len(sizes), factors.shape[1]))
    for begin in range(0, len(at), 1 << 16):
        some = slice(begin, begin + (1 << 16))
        starts = np.flatnonzero(np.r_[True, owner[some][1:] != owner[some][:-1]])
        sums[owner[some][starts]] += np.add.reduceat(weight[some, None] * factors[at[some]], starts)
    none = np.bincount(owner, minlength=len(sizes)) == 0
    v = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1) * sums.shape[1], pa.int32()), pa.array(sums.ravel()),
                                 mask=pa.array(none))
    return pa.table([asked.column("query_id"), v], names=["query_id", "v"])


def sums_over_terms(asked: DataFrame, factors: DataFrame) -> DataFrame:
    """``query_id, v``: for very many queries (``query_id, terms, counts``) the sums of ``(1 + ln count) * idf * factor``
    over the terms of each in ``factors`` (``term, idf, factor``); NULL where there are none.

    Lots of queries meet parts of the factors, no row is made for a term.
    """
    n, dim = factors.agg(F.count(F.lit(1)), F.max(F.size("factor"))).first()
    if not n:
        return asked.select("query_id", F.lit(None).cast("array<double>").alias("v"))
    lots = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // LOT_TERMS))
    parts = -(-n // PART_TERMS)
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dealt = asked.select("query_id", "terms", "counts").withColumn(
        "lot", F.pmod(F.xxhash64("query_id"), F.lit(lots)).cast("int")).withColumn("part", every(parts))
    placed = factors.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")).withColumn("lot", every(lots))
    schema = T.StructType([asked.schema["query_id"], T.StructField("v", T.ArrayType(T.DoubleType()))])

    def work(some: pa.Table, held: pa.Table) -> pa.Table:
        if held.num_rows and some.num_rows:
            return _sums_of_part(some, held)
        return pa.table([some.column("query_id"), pa.nulls(some.num_rows, pa.list_(pa.float64()))], names=["query_id", "v"])

    sums = dealt.groupBy("part", "lot").cogroup(placed.groupBy("part", "lot")).applyInArrow(work, schema)
    if parts > 1:
        added = sums.groupBy("query_id").agg(*[F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(dim)])
        sums = added.select("query_id", F.when(F.col("v0").isNotNull(), F.array(*[f"v{i}" for i in range(dim)])).alias("v"))
    return sums


def embed_many(queries: DataFrame, projection: Projection, counted: DataFrame | None = None) -> DataFrame:
    """``embed_queries`` for very many queries; ``counted`` are their ``query_counts`` where these are stored."""
    if counted is None:
        counted = stored(query_counts(queries).select("query_id", "terms", "counts"), "counted-queries")
    factors = projection.factors.select("term", "idf", vector_to_array("factor").alias("factor"))
    return sums_over_terms(counted, factors).select("query_id", unit(F.col("v")).alias("vector"))
