"""MinHash near-duplicate detection with an LSH forest.

Documents with the same words form a class; one signature stands for the class. The
forest is a set of sorted orders ("trees") over the signatures: a tree's key is a run of
MinHash values, and classes that agree on a longer prefix stand closer together. Each
order is one range-partitioned sort, so a region of any size (a third of the corpus may
be near copies of each other) is split over tasks anywhere, even between equal keys.
The candidates of a class are its neighbours in each order, as long as they share
``MIN_DEPTH`` values: where a region is dense the neighbours share longer prefixes, so
the depth follows the density by itself. Rows beside a border of two tasks are put in
order once more, so no neighbours are missed.

Candidates whose two-bit sketches disagree too often are dropped (the allowance is over
four standard deviations below the threshold); the others are confirmed on full shingle
sets. Only links that can still join two components are confirmed: first the two most
alike of every class, then those between what the first left apart.

Where more classes share ``MIN_DEPTH`` values of a tree than a walk over ``NEIGHBOURS``
compares, the members are crowded, and the links between crowded classes that are still
in different components come from an exact join on prefixes: every class's shingles in
one order of the corpus, rare ones first; two classes that are alike enough share one
among the first few of both. Lengths and places of the shared shingle are held against
the threshold in the join, a shingle's rows are dealt over salts, and rows of its
commonest component are not held against each other.

Defined results: NULL, empty or blank texts have no shingles and are linked with nothing,
their component is their own id. Equal texts are one class whatever their ids; a NULL id
is linked like any other but never names a component unless no other id is there. Rows
that repeat give a row each. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remedia.llm.common import SPACE, add_columns, lower_words, row_hash, stored, text_of

TREES = 12
DEPTH = 6
MIN_DEPTH = 2
NEIGHBOURS = 4
FIRST_PARTNERS = 2
#: Counters of shingles; they set the order alone, so shared ones cost time and no links.
COUNTERS = 2**20
#: Rows of one shingle that a salt takes.
SALT_ROWS = 1000
CACHE_WORDS = 200_000


@dataclass(frozen=True)
class Rule:
    """``width`` words to a shingle; linked from ``percent`` of a hundred parts of the union."""

    width: int = 5
    percent: int = 80

    @property
    def least_agreement(self) -> float:
        """Share of equal two-bit values that a pair at the threshold stays above."""
        mean = (1 + 3 * self.percent / 100) / 4
        return mean - 4.5 * (mean * (1 - mean) / (TREES * DEPTH)) ** 0.5


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (Stafford's variant 13)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct shingles of word lists as 64-bit hashes; hashes of words are remembered within bounds."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), "u8", len(words))

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.unique(self.every(words)) if words else np.empty(0, "u8")

    def every(self, words: list[bytes]) -> np.ndarray:
        """In order, repeats included; a list shorter than a shingle is one."""
        h, width = self._hashes(words), min(self.width, len(words))
        n = len(h) - width + 1
        out = np.full(n, width, "u8")
        for i in range(width):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i:i + n])
        return out


def _multipliers() -> np.ndarray:
    return _mix(np.arange(1, TREES * DEPTH + 1, dtype="u8")) | np.uint64(1)


def signature(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The least value of each hash function, 32 bits each."""
    least = np.full(len(multipliers), np.iinfo("u8").max, "u8")
    for at in range(0, len(shingles), 4096):  # a block at a time: texts may be long
        block = shingles[at:at + 4096]
        for k, m in enumerate(multipliers):
            least[k] = min(least[k], (block * m).min())
    return (_mix(least) >> np.uint64(32)).astype("u4")


def signatures(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, k1, n_shingles, node (digest of the words; NULL without words), signature."""
    rows = docs.select("doc_id", text_of().alias("text"), row_hash("doc_id", "text").alias("k1"))
    width = rule.width

    def make():
        shingler, multipliers = Shingler(width), _multipliers()

        def sign(texts: list[str]) -> tuple[list, list, list]:
            counts, nodes, signs = [], [], []
            for text in texts:
                words = lower_words(text)
                shingles = shingler(words)
                counts.append(len(shingles))
                nodes.append(hashlib.md5(b" ".join(words)).digest() if words else None)
                signs.append(signature(shingles, multipliers).astype(">u4").tobytes() if words else None)
            return counts, nodes, signs

        return sign

    return add_columns(rows, ["text"], make, {"n_shingles": "long", "node": "binary", "signature": "binary"})


def forest_rows(classes: DataFrame) -> DataFrame:
    """tree, key, node, sketch: one row per class and tree."""

    def grow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            signs = np.frombuffer(b"".join(frame["signature"]), ">u4").reshape(len(frame), TREES * DEPTH)
            bits = np.unpackbits((signs & 3).astype("u1")[:, :, None], axis=2)[:, :, 6:]
            sketch = np.packbits(bits.reshape(len(frame), -1), axis=1)
            sketches = [s.tobytes() for s in sketch]
            for tree in range(TREES):
                keys = signs[:, tree * DEPTH:(tree + 1) * DEPTH]
                yield pd.DataFrame({"tree": tree, "key": [k.tobytes() for k in keys],
                                    "node": frame["node"], "sketch": sketches})

    return classes.select("node", "signature").mapInPandas(
        grow, "tree int, key binary, node binary, sketch binary")


def _compare(rows: pd.DataFrame, old: int, least: float, reach: int):
    """Pairs of rows up to ``reach`` apart, the later one not among the first ``old``."""
    n = len(rows)
    keys = np.frombuffer(b"".join(rows["key"]), ">u4").reshape(n, DEPTH)
    keys = np.column_stack([rows["tree"].to_numpy(), keys])
    sketch = np.frombuffer(b"".join(rows["sketch"]), "u1").reshape(n, -1)
    halves = np.stack([(sketch >> s) & 3 for s in (6, 4, 2, 0)], 2).reshape(n, -1)
    nodes = rows["node"].to_numpy()
    for apart in range(1, reach + 1):
        later = np.arange(max(apart, old), n)
        if not len(later):
            return
        same = (keys[later, :1 + MIN_DEPTH] == keys[later - apart, :1 + MIN_DEPTH]).all(1)
        later = later[same]
        agree = (halves[later] == halves[later - apart]).mean(1)
        later, agree = later[agree >= least], agree[agree >= least]
        if len(later):
            a, b = nodes[later], nodes[later - apart]
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "agree": agree})


def _walk(least: float, reach: int, borders: bool):
    """Neighbours of a task's sorted rows; with ``borders`` also its first and last rows."""
    fields = ["tree", "key", "node", "sketch"]

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, seen = None, 0
        for frame in frames:
            if not len(frame):
                continue
            if borders and seen < reach:
                yield frame.iloc[:reach - seen]
            rows = frame if kept is None else pd.concat([kept, frame], ignore_index=True)
            yield from _compare(rows, 0 if kept is None else len(kept), least, reach)
            seen += len(frame)
            kept = rows.iloc[-reach:]
        if borders and kept is not None:
            yield kept

    def aligned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in walk(frames):
            yield frame.reindex(columns=[*fields, "a", "b", "agree"])

    return aligned


WALKED = "tree int, key binary, node binary, sketch binary, a binary, b binary, agree double"


def candidates(classes: DataFrame, rule: Rule) -> DataFrame:
    """a, b, agree: every pair of classes that are neighbours in a tree, once."""
    order = ["tree", "key", "node"]
    rows = stored(forest_rows(classes), "forest")
    walked = stored(
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .mapInPandas(_walk(rule.least_agreement, NEIGHBOURS, True), WALKED), "neighbours")
    # At most 2 * NEIGHBOURS rows of each task of the sort.
    borders = walked.where("a IS NULL").select(*order, "sketch").coalesce(1).sortWithinPartitions(*order)
    across = borders.mapInPandas(_walk(rule.least_agreement, NEIGHBOURS, False), WALKED)
    both = walked.where("a IS NOT NULL").select("a", "b", "agree").unionByName(across.select("a", "b", "agree"))
    return both.where("a <> b").groupBy("a", "b").agg(F.max("agree").alias("agree"))


def crowded(classes: DataFrame) -> DataFrame:
    """node: the classes that share ``MIN_DEPTH`` values of some tree with more than ``NEIGHBOURS`` others."""
    prefixes = F.array(*[F.struct(F.lit(t).alias("tree"), F.substring("signature", 4 * DEPTH * t + 1, 4 * MIN_DEPTH).alias(
        "start")) for t in range(TREES)])
    rows = classes.select("node", F.explode(prefixes).alias("p")).select("node", "p.*")
    full = rows.groupBy("tree", "start").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > NEIGHBOURS + 1)
    return rows.join(full, ["tree", "start"], "left_semi").select("node").distinct()


def shingle_counts(texts: DataFrame, rule: Rule) -> np.ndarray:
    """How many shingles fall to each of ``COUNTERS`` counters; tasks add up their own first."""
    width = rule.width

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, total = Shingler(width), np.zeros(COUNTERS, "i8")
        for frame in frames:
            for text in frame["text"]:
                total += np.bincount((shingler(lower_words(text)) % np.uint64(COUNTERS)).astype("i8"), minlength=COUNTERS)
        there = np.flatnonzero(total)
        yield pd.DataFrame({"at": there, "n": total[there]})

    found = texts.select("text").mapInPandas(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, "i8")
    out[found["at"].to_numpy()] = found["n"].to_numpy()
    return np.minimum(out, np.iinfo("i4").max).astype("i4")


def prefix_rows(texts: DataFrame, rule: Rule) -> DataFrame:
    """node, label, s, n, at, short: the rarest shingles of each class, as many as a partner may lack, and one.

    ``short`` marks those that a partner of no fewer shingles must share one of.
    """
    width, percent, counts = rule.width, rule.percent, shingle_counts(texts, rule)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(width)
        for frame in frames:
            for node, label, text in zip(frame["node"], frame["label"], frame["text"], strict=True):
                s = shingler(lower_words(text))
                often, n = counts[(s % np.uint64(COUNTERS)).astype("i8")], len(s)
                order = np.lexsort((s, often))[:n + percent * n // -100 + 1]
                at = np.flatnonzero(often[order] > 1)  # a shingle alone on its counter is in no other class
                if len(at):
                    yield pd.DataFrame({"node": node, "label": label, "s": s[order[at]].astype("i8"), "n": n, "at": at,
                                        "short": at <= n + 2 * percent * n // -(100 + percent)})

    return texts.select("node", "label", "text").mapInPandas(
        cut, "node binary, label binary, s long, n long, at long, short boolean")


def crowded_pairs(texts: DataFrame, rule: Rule) -> DataFrame:
    """a, b: every pair of different labels that can be alike enough. ``texts``: node, label, text."""
    rows = stored(prefix_rows(texts, rule), "prefixes")
    held = rows.groupBy("s", "label").agg(F.count(F.lit(1)).alias("k"), F.max("short").alias("short")).groupBy("s").agg(
        F.max_by("label", F.struct("k", "label")).alias("main"), F.sum("k").alias("rows"),
        F.count(F.lit(1)).alias("labels"), F.max("short").alias("any_short")).where("labels > 1 AND any_short")
    shared = stored(rows.join(held.select("s", "main", F.ceil(F.col("rows") / SALT_ROWS).cast("int").alias("salts")), "s"), "shared")
    minor = F.col("label") != F.col("main")

    def pairs(every: DataFrame, dealt: DataFrame, shorter: str, longer: str) -> DataFrame:
        one = every.select("s", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
                           *[F.col(c).alias("e_" + c) for c in ("node", "label", "n", "at")])
        other = dealt.select("s", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"),
                             *[F.col(c).alias("d_" + c) for c in ("node", "label", "n", "at")])
        x, y = ({c: F.col(f"{side}_{c}") for c in ("node", "label", "n", "at")} for side in (shorter, longer))
        left = F.least(x["n"] - x["at"], y["n"] - y["at"])
        alike = ((x["label"] != y["label"])
                 & ((x["n"] < y["n"]) | ((x["n"] == y["n"]) & (x["node"] < y["node"])))
                 & (100 * x["n"] >= rule.percent * y["n"])
                 & ((100 + rule.percent) * left >= rule.percent * (x["n"] + y["n"])))
        return one.join(other, (one["s"] == other["s"]) & (one["salt"] == other["salt"]) & alike).select(
            F.least("e_node", "d_node").alias("a"), F.greatest("e_node", "d_node").alias("b"))

    return pairs(shared.where(minor & F.col("short")), shared, "e", "d").unionByName(
        pairs(shared.where(minor), shared.where(~minor & F.col("short")), "d", "e")).distinct()


def confirm(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are alike enough. ``texts``: node, text."""
    joined = pairs.select("a", "b").join(
        texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    width, percent = rule.width, rule.percent

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(width)
        for frame in frames:
            keep = []
            for one, other in zip(frame["text_a"], frame["text_b"], strict=True):
                x, y = shingler(lower_words(one)), shingler(lower_words(other))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield frame.loc[keep, ["a", "b"]]

    return joined.mapInPandas(check, "a binary, b binary")


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """node, label: the least node that can be reached. ``labels``: components that other links made before.

    In each round a whole component takes the least label beside it, and that one's own
    new label, so rounds grow with the logarithm of a chain's length.
    """
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    if labels is None:
        labels = ends.select("node", F.col("node").alias("label"))
    else:
        alone = ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
        labels = labels.unionByName(alone)
    labels = stored(labels, "labels")
    while True:
        sided = links.join(labels.toDF("a", "label_a"), "a").join(labels.toDF("b", "label_b"), "b").where(
            F.col("label_a") != F.col("label_b"))
        moves = stored(sided.groupBy(F.greatest("label_a", "label_b").alias("label")).agg(
            F.min(F.least("label_a", "label_b")).alias("to")), "moves")
        if moves.limit(1).count() == 0:
            return labels
        twice = moves.join(moves.toDF("to", "further"), "to", "left").select(
            "label", F.coalesce("further", "to").alias("to"))
        labels = stored(labels.join(twice, "label", "left").select(
            "node", F.coalesce("to", "label").alias("label")), "labels")


def _other_sides(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components so far."""
    of = labels.select(F.col("node"), F.col("label"))
    sided = pairs.join(of.toDF("a", "label_a"), "a", "left").join(of.toDF("b", "label_b"), "b", "left")
    return sided.where(
        F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")


def link(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Signed rows of all documents, and node -> label of the classes that are linked."""
    signed = stored(signatures(docs, rule), "signed")
    classes = stored(signed.where("node IS NOT NULL").groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1")).alias("rep"),
        F.min("signature").alias("signature")), "classes")
    pairs = stored(candidates(classes, rule), "candidates")
    dense = stored(crowded(classes), "crowded")
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(
        dense).distinct()
    wanted = classes.join(ends, "node", "left_semi").select(
        "node", F.coalesce("rep.doc_id", F.lit(0)).alias("k0"), F.col("rep.k1").alias("k1"))
    rows = docs.select(text_of().alias("text"), F.coalesce("doc_id", F.lit(0)).alias("k0"),
                       row_hash("doc_id", "text").alias("k1"))
    texts = stored(wanted.join(rows, ["k0", "k1"]).groupBy("node").agg(
        F.min("text").alias("text")), "texts")

    by = {s: F.expr(f"row_number() OVER (PARTITION BY {s} ORDER BY agree DESC, a, b)") for s in ("a", "b")}
    near = stored(pairs.withColumn("of_a", by["a"]).withColumn("of_b", by["b"]).select(
        "a", "b", (F.least("of_a", "of_b") <= FIRST_PARTNERS).alias("first")), "ranked")
    links = stored(confirm(near.where("first"), texts, rule), "links-1")
    labels = components(links)
    rest = confirm(_other_sides(near.where("NOT first"), labels), texts, rule)
    more = stored(rest, "links-2")
    if more.limit(1).count():
        labels = components(more, labels)
    apart = texts.join(dense, "node", "left_semi").join(labels, "node", "left").select(
        "node", F.coalesce("label", "node").alias("label"), "text")
    if dense.limit(1).count():
        last = stored(confirm(stored(crowded_pairs(apart, rule), "crowded-pairs"), texts, rule), "links-3")
        if last.limit(1).count():
            labels = components(last, labels)
    return signed, labels


def near_duplicates(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    signed, labels = link(docs, rule)
    named = signed.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least")).join(
        labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of = named.select("node", "label").join(least, "label").select("node", "component_id")
    alone = signed.where("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = signed.where("node IS NOT NULL").select("doc_id", "n_shingles", "node").join(of, "node").select(
        "doc_id", "n_shingles", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, rule: Rule) -> DataFrame:
    """The documents, all their columns, with one of each component: the least id; blank texts all stay."""
    signed, labels = link(docs, rule)
    keepers = signed.where("node IS NOT NULL").join(labels, "node", "left").groupBy(
        F.coalesce("label", "node").alias("of")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1")).alias("rep")).select(
        F.coalesce("rep.doc_id", F.lit(0)).alias("_k0"), F.col("rep.k1").alias("_k1"))
    blank = F.btrim(text_of(), F.lit(SPACE)) == ""
    marked = docs.where(~blank).withColumn("_k0", F.coalesce("doc_id", F.lit(0))).withColumn(
        "_k1", row_hash("doc_id", "text")).dropDuplicates(["_k0", "_k1"])
    kept = marked.join(keepers, ["_k0", "_k1"], "left_semi").drop("_k0", "_k1")
    return kept.unionByName(docs.where(blank))
