"""Classification, ranking and gate metrics as distributed aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remedia import policy
from remedia.operators import skew
from remedia.session import stored


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(
        F.col(label).cast("string").alias("label"),
        F.col(prediction).cast("string").alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def class_report(matrix: DataFrame) -> DataFrame:
    """Precision, recall and F1 per class; 0 where undefined. Starts from the confusion counts."""
    hit = F.col("label") == F.col("prediction")
    sides = matrix.select(F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"),
                 F.when(hit, F.col("n")).otherwise(0).alias("tp"),
                 F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("support"),
                 F.lit(0).cast("long").alias("tp"), F.col("n").alias("predicted")))).alias("s")
    ).select("s.*")
    sums = sides.groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("tp").alias("tp"),
        F.sum("predicted").alias("predicted"))
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), zero)
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), zero)
    return sums.withColumn("precision", precision).withColumn("recall", recall).withColumn(
        "f1", F.coalesce(F.try_divide(
            2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
            zero))


def classification_summary(df: DataFrame, label="label", prediction="prediction") -> DataFrame:
    """Accuracy, macro and micro F1, and balanced accuracy (over classes in the truth)."""
    classes = class_report(confusion(df, label, prediction))
    return classes.agg(
        F.sum("support").alias("rows"), F.count(F.lit(1)).alias("classes"),
        F.try_divide(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        F.try_divide(F.sum("tp"), F.sum("predicted")).alias("micro_f1"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"))


def weakest_classes(classes: DataFrame, k: int = 3) -> DataFrame:
    return classes.where("support > 0").orderBy("f1", "class").limit(k).select("class", "f1")


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the curve with mid-ranks for ties, from counts per distinct score."""
    positive = F.col(label).cast("int") == 1
    counts = df.groupBy(F.col(score).alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(positive).alias("pos"))
    placed = skew.running_total(counts, ["score"], "n")
    mid = F.col("before") + (F.col("n") + 1) / 2.0
    sums = placed.agg(
        F.sum("pos").alias("positives"), F.sum(F.col("n") - F.col("pos")).alias("negatives"),
        F.sum(F.col("pos") * mid).alias("_ranks"))
    p, q = F.col("positives"), F.col("negatives")
    return sums.withColumn(
        "roc_auc", F.try_divide(F.col("_ranks") - p * (p + 1) / 2.0, (p * q).cast("double"))
    ).drop("_ranks")


def top_rows(df: DataFrame, score: str, tie: str, k: Column) -> DataFrame:
    """The ``k`` rows with the highest scores, ties by ``tie`` ascending.

    ``k`` is a Column over ``_n``, the number of rows, and may grow with it: the
    cut score is found from counts per distinct score, and only rows that share
    it are ranked, in key-range buckets. Nothing is sorted in one task.
    """
    scored = df.where(F.col(score).isNotNull())
    counts = stored(skew.value_counts(scored, score).withColumn("_down", -F.col(score)), "counts")
    size = counts.agg(F.sum("n")).scalar()
    placed = skew.running_total(counts, ["_down"], "n").withColumn("_n", size)
    edge = placed.withColumn("_k", k.cast("long")).where(
        (F.col("before") < F.col("_k")) & (F.col("_k") <= F.col("before") + F.col("n")))
    edge = stored(edge, "edge")
    reached = stored(scored.withColumn("_cut", edge.select(F.max(score)).scalar()).where(
        F.col("_cut").isNull() | (F.col(score) >= F.col("_cut"))), "reached")
    sure = reached.where(F.col("_cut").isNull() | (F.col(score) > F.col("_cut"))).drop("_cut")
    tied = reached.where(F.col(score) == F.col("_cut")).drop("_cut").withColumn(
        "_one", F.lit(1))
    take = edge.select(F.max(F.col("_k") - F.col("before"))).scalar()
    ranked = skew.running_total(tied, [tie], "_one", out="_before").withColumn("_take", take)
    return sure.unionByName(
        ranked.where(F.col("_before") < F.col("_take")).drop("_one", "_before", "_take"))


def recall_at_budget(
    df: DataFrame, label: str = "label", score: str = "score", tie: str = "id",
    budget: float = policy.ALERT_BUDGET,
) -> DataFrame:
    """Recall and precision when only the top share of rows is alerted; lift over the base rate."""
    k = F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(budget), 0))
    caught = top_rows(df.select(label, score, tie), score, tie, k).agg(
        F.count(F.lit(1)).alias("alerts"),
        F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0)).alias("caught"))
    truth = df.agg(F.sum(F.col(label).cast("long")).alias("p"), F.count(F.lit(1)).alias("n"))
    return (
        caught.withColumn("positives", truth.select("p").scalar())
        .withColumn("rows", truth.select("n").scalar())
        .withColumn("recall", F.try_divide(F.col("caught"), F.col("positives")))
        .withColumn("precision", F.try_divide(F.col("caught"), F.col("alerts")))
        .withColumn("base_rate", F.try_divide(F.col("positives"), F.col("rows")))
        .withColumn("lift", F.try_divide(F.col("precision"), F.col("base_rate"))))


def eta_squared(df: DataFrame, label: str, score: str) -> DataFrame:
    """Share of the score's variance that the label explains, from per-label moments."""
    groups = df.groupBy(label).agg(
        F.count(score).alias("n"), F.avg(score).alias("m"), F.var_pop(score).alias("v"))
    total = groups.agg(
        F.sum(F.col("n") * F.col("m")).alias("s"), F.sum("n").alias("n"))
    grand = total.select(F.try_divide("s", "n")).scalar()
    parts = groups.withColumn("_grand", grand).agg(
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("_grand"), 2)).alias("between"),
        F.sum(F.col("n") * F.col("v")).alias("within"), F.count(F.lit(1)).alias("classes"))
    spread = F.col("between") + F.col("within")
    return parts.select(
        "classes", (F.col("between") / F.when(spread == 0, 1.0).otherwise(spread)).alias(
            "eta_squared"))


def share_where(df: DataFrame, condition: Column, out: str = "share") -> DataFrame:
    return df.agg(F.avg(condition.cast("double")).alias(out))


def exactness(df: DataFrame, actual: str, expected: str, kind: str | None = None) -> DataFrame:
    """Share of cases whose computed value equals the expected one, NULLs comparing equal."""
    hit = F.col(actual).eqNullSafe(F.col(expected))
    groups = df.groupBy(kind) if kind else df.groupBy()
    return groups.agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(hit).alias("exact"),
        F.avg(hit.cast("double")).alias("exactness"))


def promotion_gates(
    metrics: DataFrame, gates=policy.GATES, invented_dates: Column | None = None,
) -> DataFrame:
    """``gate, minimum, actual, status`` from a ``name, actual`` table.

    A metric nobody produced is ``skipped``, which is not the same as passed. One
    invented date fails the run whatever the rates say.
    """
    names = [g for g, _ in gates]
    wanted = metrics.sparkSession.range(0, len(names), 1, 1).select(
        F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("id") + 1).cast("int")).alias(
            "gate"),
        F.element_at(F.array(*[F.lit(float(m)) for _, m in gates]),
                     (F.col("id") + 1).cast("int")).alias("minimum"))
    actual = metrics.select(F.col("name").alias("gate"), "actual")
    judged = wanted.join(actual, "gate", "left").withColumn(
        "status", F.when(F.col("actual").isNull(), "skipped")
        .when(F.col("actual") >= F.col("minimum"), "pass").otherwise("FAIL"))
    if invented_dates is None:
        return judged
    hard = metrics.sparkSession.range(0, 1, 1, 1).select(
        F.lit("no_invented_dates").alias("gate"), F.lit(0.0).alias("minimum"),
        invented_dates.cast("double").alias("actual"), F.lit("FAIL").alias("status"))
    return judged.unionByName(hard.where("actual > 0"))
