"""Many text models over one stored feature table: one pass a step for all of them.

A model is a ``Spec``: its parameters and the parts of the table (folds) it may learn from.
Terms are counted once for every set of parts, so a model's vocabulary and weights of terms
come from its own parts alone. Rows are stored once as term columns and counts. A step sends
all weight vectors to the tasks, each task adds up the gradients of all models over its rows,
and the sums are added by piece in a shuffle; the driver holds vectors alone: for each model
some ``2 * MEMORY + 4`` of ``(terms + 1) * classes`` numbers, whatever the number of rows.

Defined results: a NULL text has no terms and is judged by the intercepts; a row with a NULL
label or part is not learned from; rows that repeat count as often as they stand there; a spec
without rows or with one class keeps zero weights. Columns other than those named are carried
if asked for. Nothing depends on how the rows are dealt, but for the last digits of sums.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remedia.operators import metrics
from remedia.operators.models import TextParams, random_split, sample_params, with_terms
from remedia.session import stored

MEMORY = 5      # steps that a walk remembers
COUNTED_ROWS = 256  # rows whose terms are counted at once
PIECE = 8192    # numbers of a gradient that travel as one row
SUFFICIENT = 1e-4
FLAT = 1e-6     # a walk ends where no component of its gradient is larger


@dataclass(frozen=True)
class Spec:
    params: TextParams
    fit: frozenset[int]


class Features(NamedTuple):
    """``rows``: kept columns, _part, _y, _columns, _tf. ``scales``: idf by spec and column, 0 outside."""

    rows: DataFrame
    keep: list[str]
    specs: list[Spec]
    classes: list[str]
    terms: list[str]
    scales: np.ndarray
    sizes: np.ndarray


def _term_counts(rows: DataFrame, sets: list[frozenset[int]]) -> DataFrame:
    """``term, cf<i>, df<i>`` for each set of parts: occurrences and rows.

    Some rows at a time are counted where they are cut, so what is shuffled is one row for a
    term and part of them, not one for each word.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, COUNTED_ROWS):
                some = batch.slice(begin, COUNTED_ROWS)
                lists = some.column(1)
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                coded = lists.flatten().dictionary_encode()
                code, wide = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(len(coded.dictionary), 1)
                parts, part = np.unique(some.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
                row = np.repeat(np.arange(len(sizes)), sizes)
                cell, n = np.unique(row * wide + code, return_counts=True)
                at = part[cell // wide] * wide + cell % wide
                cf, df = np.bincount(at, n, len(parts) * wide), np.bincount(at, minlength=len(parts) * wide)
                there = np.flatnonzero(df)
                yield pa.RecordBatch.from_arrays([
                    coded.dictionary.take(pa.array(there % wide)).cast(pa.string()),
                    pa.array(parts[there // wide], pa.int32()), pa.array(cf[there].astype(np.int64)),
                    pa.array(df[there].astype(np.int64))], names=["term", "_part", "cf", "df"])

    seen = rows.where(F.col("_part").isNotNull()).select("_part", "terms").mapInArrow(
        run, "term string, _part int, cf long, df long")
    found = []
    for i, parts in enumerate(sets):
        inside = F.col("_part").isin(*sorted(parts)) if parts else F.lit(False)
        found += [F.sum(F.when(inside, F.col(c)).otherwise(0)).alias(f"{c}{i}") for c in ("cf", "df")]
    return seen.groupBy("term").agg(*found)


def _vocabularies(counts: DataFrame, specs: Sequence[Spec], sets: list[frozenset[int]]) -> DataFrame:
    """``model, term, df``: at most ``max_features`` rows of each model, the most frequent terms."""
    out = None
    for m, spec in enumerate(specs):
        i, p = sets.index(spec.fit), spec.params
        fits = F.col(f"df{i}") >= max(1, p.min_df)
        if p.ngram_high == 1:
            fits = fits & ~F.contains("term", F.lit(" "))
        best = counts.where(fits).orderBy(F.desc(f"cf{i}"), "term").limit(int(p.max_features)).select(
            F.lit(m).alias("model"), "term", F.col(f"df{i}").alias("df"))
        out = best if out is None else out.unionByName(best)
    return out


def _row_terms(terms: list[str]):
    """Arrays of terms as sorted columns with ``1 + ln(count)``, whole batches at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, wide = pa.array(terms, pa.string()), max(len(terms), 1)
        for batch in batches:
            lists = batch.column("terms")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            code = pc.fill_null(pc.index_in(lists.flatten().cast(pa.string()), value_set=known), -1).to_numpy(
                zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            cell, n = np.unique((row * wide + code)[code >= 0], return_counts=True)
            ends = np.searchsorted(cell, np.arange(len(sizes) + 1) * wide).astype(np.int32)
            made = [pa.ListArray.from_arrays(pa.array(ends), pa.array((cell % wide).astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(1.0 + np.log(n)))]
            kept = [c for c in batch.schema.names if c != "terms"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], *made], names=[*kept, "_columns", "_tf"])
    return run


def store_features(rows: DataFrame, text: str, label: str, part: Column, specs: Sequence[Spec],
                   keep: Sequence[str] = ()) -> Features:
    """Count the terms, choose each spec's vocabulary and write the rows once.

    ``part`` is a small integer. To the driver go the classes, their sizes by part, and the
    vocabularies, at most ``max_features`` terms a spec.
    """
    base = rows.select(*[F.col(f"`{c}`") for c in keep], part.cast("int").alias("_part"),
                       F.col(f"`{label}`").cast("string").alias("_label"), F.col(f"`{text}`").alias("_text"))
    worded = with_terms(base, "_text", max(s.params.ngram_high for s in specs)).drop("_text")
    tally = [(r[0], r[1], r[2]) for r in base.where("_label IS NOT NULL AND _part IS NOT NULL").groupBy(
        "_part", "_label").agg(F.count(F.lit(1))).collect()]
    classes = sorted({c for _, c, _ in tally})
    top = 1 + max([p for p, _, _ in tally] + [p for s in specs for p in s.fit], default=0)
    sizes = np.zeros((top, max(len(classes), 1)))
    for p, c, n in tally:
        sizes[p, classes.index(c)] = n
    sets = sorted({s.fit for s in specs}, key=sorted)
    learned = worded.where(F.col("_label").isNotNull()).select("_part", "terms")
    counts = stored(_term_counts(learned, sets), "term-counts")
    chosen = _vocabularies(counts, specs, sets).collect()
    terms = sorted({r["term"] for r in chosen})
    place = {t: i for i, t in enumerate(terms)}
    scales = np.zeros((len(specs), len(terms)))
    totals = [sizes[sorted(s.fit)].sum() for s in specs]
    for r in chosen:
        scales[r["model"], place[r["term"]]] = np.log((1 + totals[r["model"]]) / (1 + r["df"])) + 1.0
    names = F.array(*[F.lit(c) for c in classes]).cast("array<string>")
    coded = worded.withColumn("_y", F.coalesce(F.array_position(names, F.col("_label")), F.lit(0)).cast("int") - 1)
    coded = coded.withColumn("_part", F.coalesce("_part", F.lit(-1))).select(*keep, "_part", "_y", "terms")
    schema = T.StructType([f for f in coded.schema.fields if f.name != "terms"]).add(
        "_columns", T.ArrayType(T.IntegerType())).add("_tf", T.ArrayType(T.DoubleType()))
    return Features(stored(coded.mapInArrow(_row_terms(terms), schema), "text-features"), list(keep),
                    list(specs), classes, terms, scales, sizes)


class _Batch:
    """The cells of a batch of stored rows, flat."""

    def __init__(self, batch: pa.RecordBatch):
        self.n = batch.num_rows
        self.part = batch.column("_part").to_numpy(zero_copy_only=False)
        self.y = batch.column("_y").to_numpy(zero_copy_only=False)
        lists = batch.column("_columns")
        self.row = np.repeat(np.arange(self.n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        self.col = lists.flatten().to_numpy(zero_copy_only=False)
        self.tf = batch.column("_tf").flatten().to_numpy(zero_copy_only=False)

    def unit(self, scale: np.ndarray) -> np.ndarray:
        v = self.tf * scale[self.col]
        norm = np.sqrt(np.bincount(self.row, v * v, self.n))
        return v / np.where(norm > 0, norm, 1.0)[self.row]

    def log_shares(self, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        z = np.stack([np.bincount(self.row, x * w[self.col, k], self.n) for k in range(w.shape[1])], 1) + w[-1]
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


PIECES = T.StructType([T.StructField("model", T.IntegerType()), T.StructField("piece", T.IntegerType()),
                       T.StructField("task", T.IntegerType()), T.StructField("sums", T.BinaryType())])


def _piece_batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    model, piece, task, sums = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(model, pa.int32()), pa.array(piece, pa.int32()), pa.array(task, pa.int32()),
         pa.array(sums, pa.binary())], names=PIECES.names)


def _gradients(weights: np.ndarray, scales: np.ndarray, fit: np.ndarray, by_class: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, wide, classes = weights.shape
        sums = np.zeros((models, wide * classes + 1))
        for raw in batches:
            b = _Batch(raw)
            for m in range(models):
                weight = by_class[m][b.y] * (fit[m][b.part] & (b.y >= 0))
                if not weight.any():
                    continue
                x = b.unit(scales[m])
                log_p = b.log_shares(x, weights[m])
                at = np.arange(b.n), b.y
                sums[m, -1] -= (weight * log_p[at]).sum()
                error = np.exp(log_p)
                error[at] -= 1.0
                error *= weight[:, None]
                slope = sums[m, :-1].reshape(wide, classes)
                for k in range(classes):
                    slope[:-1, k] += np.bincount(b.col, x * error[b.row, k], wide - 1)
                slope[-1] += error.sum(0)
        task = TaskContext.get().partitionId()
        for m in range(models):
            rows = [(m, i // PIECE, task, sums[m, i:i + PIECE].tobytes()) for i in range(0, sums.shape[1], PIECE)]
            yield _piece_batch(rows)
    return run


def _judge(weights: np.ndarray, scales: np.ndarray, mask: np.ndarray, models: list[int], keep: list[str]):
    """Probabilities of each row by every model whose mask holds its part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = weights.shape[2]
        for raw in batches:
            b = _Batch(raw)
            for i, m in enumerate(models):
                at = np.flatnonzero(mask[i][b.part])
                if not len(at):
                    continue
                p = np.exp(b.log_shares(b.unit(scales[i]), weights[i]))[at]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(at) + 1, dtype=np.int32) * classes), pa.array(p.ravel()))
                here = raw.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [*[here.column(c) for c in keep], pa.array(np.full(len(at), m), pa.int32()),
                     here.column("_y"), lists], names=[*keep, "model", "_y", "probabilities"])
    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of model, piece and task, so a sum is the same on every run."""
    key, total = None, None
    for batch in batches:
        for model, piece, sums in zip(*[batch.column(c).to_pylist() for c in ("model", "piece", "sums")], strict=True):
            if key is not None and key != (model, piece):
                yield _piece_batch([(*key, 0, total.tobytes())])
                total = None
            key, part = (model, piece), np.frombuffer(sums)
            total = part.copy() if total is None else total + part
    if key is not None:
        yield _piece_batch([(*key, 0, total.tobytes())])


class Walk:
    """Limited-memory quasi-Newton descent; each step costs one evaluation, a refused one halves."""

    def __init__(self, size: int):
        self.x, self.f, self.g = np.zeros(size), None, None
        self.d, self.step, self.past, self.done = None, 1.0, [], False

    def at(self) -> np.ndarray:
        return self.x if self.f is None else self.x + self.step * self.d

    def take(self, f: float, g: np.ndarray) -> None:
        if self.done:
            return
        if self.f is not None:
            if not f <= self.f + SUFFICIENT * self.step * (self.g @ self.d):
                self.step /= 2
                self.done = self.step < 1e-9
                return
            moved, bent = self.step * self.d, g - self.g
            if moved @ bent > 1e-14:
                self.past = [*self.past, (moved, bent)][-MEMORY:]
            self.x = self.x + moved
        self.f, self.g, self.step = f, g, 1.0
        self.done = float(np.abs(g).max(initial=0.0)) <= FLAT
        q, used = g.copy(), []
        for moved, bent in reversed(self.past):
            a = (moved @ q) / (moved @ bent)
            q -= a * bent
            used.append(a)
        if self.past:
            moved, bent = self.past[-1]
            q *= (moved @ bent) / (bent @ bent)
        for (moved, bent), a in zip(self.past, reversed(used), strict=True):
            q += (a - (bent @ q) / (moved @ bent)) * moved
        self.d = -q


class Fit:
    """The walks of all specs of a feature table."""

    def __init__(self, features: Features):
        self.features = features
        terms, classes = len(features.terms), max(len(features.classes), 1)
        self.shape = (terms + 1, classes)
        self.walks = [Walk((terms + 1) * classes) for _ in features.specs]
        self.passes = [0] * len(features.specs)
        own = np.array([features.sizes[sorted(s.fit)].sum(0) for s in features.specs])
        self.rows = own.sum(1)
        seen = own > 0
        even = self.rows[:, None] / np.where(seen, own, 1.0) / np.maximum(seen.sum(1), 1)[:, None]
        balanced = np.array([s.params.balanced for s in features.specs])[:, None]
        self.by_class = np.where(balanced, even, 1.0)
        for m in np.flatnonzero(seen.sum(1) < 2):
            self.walks[m].done = True

    def _mask(self, wanted) -> np.ndarray:
        """Specs by part, with a last column for rows without a part."""
        mask = np.zeros((len(self.features.specs), len(self.features.sizes) + 1), bool)
        for m, spec in enumerate(self.features.specs):
            mask[m, :-1] = [wanted(spec, p) for p in range(len(self.features.sizes))]
        return mask

    def run(self, passes: int, models: Sequence[int] | None = None) -> None:
        """At most so many passes over the rows, for all of ``models`` together."""
        f = self.features
        fit = self._mask(lambda spec, p: p in spec.fit)
        for _ in range(passes):
            live = [m for m in (range(len(f.specs)) if models is None else models) if not self.walks[m].done]
            if not live:
                return
            tried = np.stack([self.walks[m].at().reshape(self.shape) for m in live])
            work = _gradients(tried, f.scales[live], fit[live], self.by_class[live])
            sums = f.rows.select("_part", "_y", "_columns", "_tf").mapInArrow(work, PIECES)
            added = sums.repartition("model", "piece").sortWithinPartitions("model", "piece", "task").mapInArrow(
                _add, PIECES).collect()
            pieces = {(r["model"], r["piece"]): np.frombuffer(r["sums"]) for r in added}
            for i, m in enumerate(live):
                total = np.concatenate([pieces[i, p] for p in range(-(-(tried[i].size + 1) // PIECE))])
                penalty = tried[i] / (f.specs[m].params.C * self.rows[m])
                penalty[-1] = 0.0
                loss = total[-1] / self.rows[m] + 0.5 * float((penalty * tried[i]).sum())
                self.walks[m].take(loss, total[:-1] / self.rows[m] + penalty.ravel())
                self.passes[m] += 1

    def scores(self, wanted, models: Sequence[int] | None = None) -> DataFrame:
        """``keep, model, label, predicted, probabilities`` of the rows of the parts a spec is ``wanted`` for.

        ``wanted(spec, part)`` says so. ``probabilities`` follow the order of the classes.
        """
        f = self.features
        models = list(range(len(f.specs)) if models is None else models)
        mask, scales = self._mask(wanted)[models], f.scales[models]
        weights = np.stack([self.walks[m].x.reshape(self.shape) for m in models])
        schema = T.StructType([f.rows.schema[c] for c in f.keep]).add("model", "integer").add("_y", "integer").add(
            "probabilities", T.ArrayType(T.DoubleType()))

        names = F.array(*[F.lit(c) for c in f.classes]).cast("array<string>")
        best = F.array_position("probabilities", F.array_max("probabilities")).cast("int")
        work = _judge(weights, scales, mask, models, f.keep)
        return f.rows.mapInArrow(work, schema).select(
            *f.keep, "model", F.get(names, F.col("_y")).alias("label"),
            F.get(names, best - 1).alias("predicted"), "probabilities")


def macro_f1(scored: DataFrame) -> dict[int, float]:
    """Macro F1 of each model to nine digits, over classes that are a label or a prediction."""
    known = scored.where("label IS NOT NULL").groupBy("model", "label", "predicted").agg(
        F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = known.select("model", F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("all"), hit.alias("tp")),
        F.struct(F.col("predicted").alias("class"), F.col("n").alias("all"), F.lit(0).alias("tp")))).alias("s"))
    by_class = sides.groupBy("model", "s.class").agg((2 * F.sum("s.tp") / F.sum("s.all")).alias("f1"))
    return {r[0]: r[1] for r in by_class.groupBy("model").agg(F.round(F.avg("f1"), 9)).collect()}


def search(rows: DataFrame, text: str, label: str, split: str, space, trials: int, seed: int,
           rungs: Sequence[int] = (4, 4, 8), base: TextParams = TextParams()) -> tuple[TextParams, DataFrame]:
    """Successive halving over seeded trials: the best parameters and the table of trials.

    All trials learn from ``train`` in the same passes; after each rung the better half by
    macro F1 on ``validation`` goes on (ties: the smaller trial). Other rows are not read.
    """
    rng = random.Random(seed)
    drawn = []
    for _ in range(trials):
        found = sample_params(space, rng)
        drawn.append(TextParams(**{**vars(base), **found, "balanced": bool(found.get("balanced", base.balanced))}))
    part = F.when(F.col(split) == "train", 0).when(F.col(split) == "validation", 1)
    features = store_features(
        rows.where(F.col(split).isin("train", "validation")), text, label, part,
        [Spec(p, frozenset({0})) for p in drawn])
    fit, live, score, rung = Fit(features), list(range(trials)), {}, {}
    for i, passes in enumerate(rungs):
        fit.run(passes, live)
        found = macro_f1(fit.scores(lambda spec, p: p == 1, live))
        for m in live:
            score[m], rung[m] = found.get(m, 0.0), i
        order = sorted(live, key=lambda m: (-score[m], m))
        live = sorted(order[:max(1, len(order) // 2)]) if i + 1 < len(rungs) else order[:1]
    table = [(m, score[m], rung[m], fit.passes[m], m == live[0],
              {n: float(getattr(drawn[m], n)) for n, *_ in space}) for m in range(trials)]
    return drawn[live[0]], rows.sparkSession.createDataFrame(
        table, "trial int, score double, rung int, passes int, chosen boolean, params map<string,double>")


def fold_of(text: Column, folds: int, seed: int) -> Column:
    """Rows of equal texts share a fold, so a model never saw a copy of what it scores."""
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit("")), F.lit(seed)), F.lit(folds)).cast("int")


def out_of_fold(rows: DataFrame, text: str, label: str, positive: str, keep: Sequence[str],
                params: TextParams = TextParams(), folds: int = 5, seed: int = 0,
                passes: int = 20) -> DataFrame:
    """``keep, fold, label, score``: each row's share of ``positive`` from the model that left its fold out.

    Vocabulary and term weights leave it out as well. Rows with a NULL label are scored
    like all others. All models are fitted in the same passes.
    """
    every = frozenset(range(folds))
    features = store_features(rows, text, label, fold_of(F.col(f"`{text}`"), folds, seed),
                              [Spec(params, every - {k}) for k in range(folds)], keep)
    fit = Fit(features)
    fit.run(passes)
    scored = fit.scores(lambda spec, p: p not in spec.fit)
    at = features.classes.index(positive) if positive in features.classes else None
    share = F.get("probabilities", F.lit(at)) if at is not None else F.lit(0.0)
    return scored.select(*keep, F.col("model").alias("fold"), "label", share.alias("score"))


def issue_report(folds: DataFrame, params: TextParams, text: str, label: str, passes: int = 20) -> DataFrame:
    """Learned from the rows whose ``split`` is not ``test``, reported on those where it is."""
    part = F.when(F.col("split") == "test", 1).when(F.col("split").isNotNull(), 0)
    fit = Fit(store_features(folds, text, label, part, [Spec(params, frozenset({0}))]))
    fit.run(passes)
    scored = fit.scores(lambda spec, p: p == 1).where("label IS NOT NULL")
    return metrics.classification_summary(scored, "label", "predicted")


def temporal_penalty(folds: DataFrame, id_column: str, text: str, label: str,
                     params: TextParams = TextParams(), passes: int = 20) -> DataFrame:
    """Balanced accuracy under the temporal split and under a shuffled one.

    A row's part says on which side of either split it is, so both models are fitted in the
    same passes over one feature table.
    """
    late = F.col("split") == "test"
    drawn = random_split(folds.withColumn("_late", late), id_column)
    part = (F.col("_late").cast("int") + 2 * (F.col("split") == "test").cast("int"))
    fit = Fit(store_features(drawn, text, label, part, [Spec(params, frozenset({0, 2})), Spec(params, frozenset({0, 1}))]))
    fit.run(passes)
    scored = stored(fit.scores(lambda spec, p: p not in spec.fit).where("label IS NOT NULL"), "penalty")
    out = None
    for m, name in enumerate(("temporal", "random")):
        found = metrics.classification_summary(scored.where(F.col("model") == m), "label", "predicted").select(
            F.lit(name).alias("split_kind"), "balanced_accuracy")
        out = found if out is None else out.unionByName(found)
    return out
