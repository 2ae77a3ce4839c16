"""Incumbent against candidate on the same rows, segment first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remedia import policy

KEEP_IN_SHADOW = "no traffic observed; keep the candidate in shadow"
PROMOTE = (
    "promote: the candidate wins the contested cases and does not disturb the high-value segment")
PROMOTE_AFTER_REVIEW = (
    "promote only after a human review of the high-value disagreements: the candidate is better on "
    "aggregate but is changing decisions in the segment where a wrong one is expensive")
DO_NOT_PROMOTE = (
    "do not promote: the incumbent is right more often where the two disagree")
HOLD = "hold in shadow: not enough separation to justify a change"


def value_segment(amount: Column, escalated: Column) -> Column:
    number = F.coalesce(amount.try_cast("double"), F.lit(0.0))
    return (F.when(number >= policy.HIGH_VALUE_AMOUNT, F.lit("high_value"))
            .when(F.lower(escalated.cast("string")).isin("true", "yes"),
                  F.lit("high_escalation"))
            .otherwise(F.lit("standard")))


def challenger(probability: Column, classes: list[str]) -> Column:
    """The top class where the model is confident enough, else its second choice."""
    ranked = F.reverse(F.array_sort(F.zip_with(
        probability, F.array(*[F.lit(x) for x in classes]),
        lambda p, label: F.struct(p.alias("p"), label.alias("label")))))
    return F.when(ranked[0]["p"] > policy.CHALLENGER_CONFIDENCE, ranked[0]["label"]).otherwise(
        F.coalesce(F.get(ranked, F.lit(1))["label"], ranked[0]["label"]))


def records(
    df: DataFrame, key: str, incumbent: Column, candidate: Column,
    segment: Column | None = None, observed: Column | None = None,
) -> DataFrame:
    """One comparison per row. Predictions are Columns; a Pandas UDF call is one too."""
    return df.select(
        F.col(key).cast("string").alias("key"), incumbent.alias("incumbent"),
        candidate.alias("candidate"),
        (segment if segment is not None else F.lit("all")).alias("segment"),
        (observed if observed is not None else F.lit(None).cast("string")).alias("observed"),
    ).withColumn("agreed", F.col("incumbent").eqNullSafe(F.col("candidate")))


def segment_counts(recs: DataFrame, *extra: str | Column) -> DataFrame:
    """The counts every report is made of: one map-side combined aggregate."""
    seen = F.col("observed").isNotNull()
    right = {n: seen & F.coalesce(F.col(n) == F.col("observed"), F.lit(False))
             for n in ("incumbent", "candidate")}
    contested = seen & ~F.col("agreed")
    return recs.groupBy(*extra, "segment").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("agreed").alias("agreed"),
        F.count_if(seen).alias("labelled"),
        F.count_if(right["incumbent"]).alias("incumbent_right"),
        F.count_if(right["candidate"]).alias("candidate_right"),
        F.count_if(contested).alias("contested"),
        F.count_if(contested & right["incumbent"]).alias("incumbent_wins"),
        F.count_if(contested & right["candidate"]).alias("candidate_wins"))


def by_segment(recs: DataFrame) -> DataFrame:
    """Correctness is over labelled rows only, NULL where there are none."""
    share = lambda part, whole: F.try_divide(F.col(part), F.col(whole))
    return segment_counts(recs).select(
        "segment", "n", share("agreed", "n").alias("agreement"),
        (F.col("n") - F.col("agreed")).alias("disagreements"), "labelled",
        share("incumbent_right", "labelled").alias("incumbent_correct"),
        share("candidate_right", "labelled").alias("candidate_correct"))


def report(recs: DataFrame) -> DataFrame:
    """One row: agreement, contested cases, verdict and recommendation.

    Built from the segment counts, so the records are read once.
    """
    counts = segment_counts(recs)
    disturbed = F.col("segment").startswith("high") & (F.col("n") > F.col("agreed"))
    total = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"),
        F.try_divide(F.sum("agreed"), F.sum("n")).alias("overall_agreement"),
        F.sum("labelled").alias("labelled_records"), F.sum("contested").alias("contested"),
        F.sum("candidate_wins").alias("candidate_correct"),
        F.sum("incumbent_wins").alias("incumbent_correct"),
        F.array_sort(F.collect_set(F.when(disturbed, F.col("segment")))).alias(
            "high_value_segments_with_disagreement"))
    cand, inc = F.col("candidate_correct"), F.col("incumbent_correct")
    high = F.size("high_value_segments_with_disagreement") > 0
    return total.select(
        "*", (F.col("contested") - cand - inc).alias("neither_correct"),
        F.when(cand > inc, "candidate better on contested cases")
        .when(inc > cand, "incumbent better on contested cases")
        .otherwise("no separation on contested cases").alias("verdict"),
        F.when(F.col("records") == 0, KEEP_IN_SHADOW)
        .when((cand > inc) & ~high, PROMOTE).when(cand > inc, PROMOTE_AFTER_REVIEW)
        .when(inc > cand, DO_NOT_PROMOTE).otherwise(HOLD).alias("recommendation"))


def disagreement_examples(recs: DataFrame, limit: int = 5) -> DataFrame:
    return recs.where(~F.col("agreed")).orderBy("key").limit(limit)


def prediction_mix(recs: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most frequent predictions of each model."""
    out = None
    for model in ("incumbent", "candidate"):
        top = (
            recs.groupBy(F.col(model).cast("string").alias("prediction"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "prediction").limit(k)
            .select(F.lit(model).alias("model"), "prediction", "n"))
        out = top if out is None else out.unionByName(top)
    return out
