"""Population stability: all monitored columns of both windows in one shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remedia import policy
from remedia.operators import skew

NOTES = {
    "realised_outcome": (
        "outcomes moved: with stable inputs, the same cases are now resolved differently"),
    "prediction_mix": "the model's own output mix moved, which shows before outcomes do",
}
ACTIONS = {
    "concept": ("hold the model and re-baseline: the input-output relationship has moved, not "
                "just the inputs"),
    "stable": "no action",
    "investigate": "review the top contributors before the next promotion",
    "alert": "hold promotion and investigate the inputs",
}


def category_text(df: DataFrame, name: str) -> Column:
    """A value as the category it counts under; NULL is the category ``None``."""
    kind = dict(df.dtypes)[name]
    text = F.col(name).cast("string")
    if kind == "boolean":
        text = F.initcap(text)
    return F.coalesce(text, F.lit("None"))


def _long(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    pairs = F.array(*[
        F.struct(F.lit(signal).alias("signal"), category_text(df, name).alias("category"))
        for signal, name in columns.items()])
    return df.select(F.explode(pairs).alias("p")).select("p.*")


def frequencies(
    baseline: DataFrame, current: DataFrame, columns: Sequence[str] | dict[str, str],
) -> DataFrame:
    """``signal, category, baseline_n, current_n`` for all columns at once.

    Counting both windows in one aggregate aligns their categories (a missing one
    is 0) without a join, and is combined map-side.
    """
    names = columns if isinstance(columns, dict) else {n: n for n in columns}
    both = _long(baseline, names).withColumn("_old", F.lit(1)).unionByName(
        _long(current, names).withColumn("_old", F.lit(0)))
    return both.groupBy("signal", "category").agg(
        F.sum("_old").alias("baseline_n"), F.sum(1 - F.col("_old")).alias("current_n"))


def contributions(freq: DataFrame) -> DataFrame:
    """Add each category's shares and its term of the index. One row per signal is broadcast."""
    totals = freq.groupBy("signal").agg(
        F.greatest(F.sum("baseline_n"), F.lit(1)).alias("_b"),
        F.greatest(F.sum("current_n"), F.lit(1)).alias("_c"))
    floor = F.lit(policy.PSI_FLOOR)
    b = F.greatest(F.col("baseline_n") / F.col("_b"), floor)
    c = F.greatest(F.col("current_n") / F.col("_c"), floor)
    return (
        freq.join(F.broadcast(totals), "signal").withColumn("baseline_share", b)
        .withColumn("current_share", c)
        .withColumn("contribution", (F.col("current_share") - F.col("baseline_share"))
                    * F.ln(F.col("current_share") / F.col("baseline_share")))
        .drop("_b", "_c"))


def status(value: Column) -> Column:
    return (F.when(value < policy.PSI_STABLE, F.lit("stable"))
            .when(value < policy.PSI_ALERT, F.lit("investigate")).otherwise(F.lit("alert")))


def psi(contrib: DataFrame) -> DataFrame:
    return contrib.groupBy("signal").agg(F.sum("contribution").alias("psi")).withColumn(
        "status", status(F.col("psi")))


def _leading(df: DataFrame, k: int, *order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("signal").orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def top_contributors(contrib: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` largest terms of each signal (limited per task before the shuffle)."""
    return _leading(contrib, k, F.abs(F.round("contribution", 6)).desc(), F.col("category"))


def new_categories(freq: DataFrame, k: int | None = 5) -> DataFrame:
    fresh = freq.where("baseline_n = 0 AND current_n > 0")
    return fresh if k is None else _leading(fresh, k, F.col("category"))


def _long_numbers(df: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    pairs = F.array(*[
        F.struct(F.lit(n).alias("signal"), F.col(n).cast("double").alias("value"))
        for n in columns])
    return df.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.*").where("value IS NOT NULL")


def baseline_edges(baseline: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """``signal, edges``: exact quantile edges of the baseline alone, ``bins - 1`` of each."""
    positions = F.transform(
        F.sequence(F.lit(1), F.lit(bins - 1)),
        lambda i: F.floor(F.col("_n") * i / F.lit(bins)))
    found = skew.order_statistics(
        _long_numbers(baseline, columns), "value", positions, by=["signal"])
    return found.groupBy("signal").agg(F.array_sort(F.collect_list("value")).alias("edges"))


def bin_of(value: Column, edges: Column) -> Column:
    return F.size(F.filter(edges, lambda e: e < value))


def binned(df: DataFrame, columns: Sequence[str], edges: DataFrame, *keep: str) -> DataFrame:
    """``keep, signal, value, bin`` of every value; a column without edges has the one bin 0.

    ``edges`` has one row per monitored column.
    """
    return _long_numbers(df, columns, *keep).join(F.broadcast(edges), "signal", "left").select(
        *keep, "signal", "value", F.coalesce(bin_of(F.col("value"), F.col("edges")), F.lit(0)).alias("bin"))


def numeric_frequencies(
    baseline: DataFrame, current: DataFrame, columns: Sequence[str], bins: int = 10,
) -> DataFrame:
    """Frequencies over the baseline's bins, with the means of both windows per signal row."""
    edges = F.broadcast(baseline_edges(baseline, columns, bins))
    both = _long_numbers(baseline, columns).withColumn("_old", F.lit(1)).unionByName(
        _long_numbers(current, columns).withColumn("_old", F.lit(0)))
    binned = both.join(edges, "signal", "left").withColumn(
        "category", F.coalesce(bin_of(F.col("value"), F.col("edges")), F.lit(0)).cast("string"))
    old = F.col("_old") == 1
    return binned.groupBy("signal", "category").agg(
        F.sum("_old").alias("baseline_n"), F.sum(1 - F.col("_old")).alias("current_n"),
        F.sum(F.when(old, F.col("value"))).alias("baseline_sum"),
        F.sum(F.when(~old, F.col("value"))).alias("current_sum"))


def numeric_means(freq: DataFrame) -> DataFrame:
    return freq.groupBy("signal").agg(
        F.try_divide(F.sum("baseline_sum"), F.sum("baseline_n")).alias("baseline_mean"),
        F.try_divide(F.sum("current_sum"), F.sum("current_n")).alias("current_mean"))


def reference_window(df: DataFrame, date_column: str, months: int = 12) -> DataFrame:
    """The first ``months`` calendar months of the data."""
    first = df.agg(F.min(date_column)).scalar()
    return df.where(F.col(date_column) < F.add_months(F.trunc(first, "MM"), months))


def signals(
    baseline: DataFrame, current: DataFrame, categorical: Sequence[str] = (),
    numeric: Sequence[str] = (), label: str | None = None, prediction: str | None = None,
) -> DataFrame:
    """One row per monitored signal: ``signal, kind, statistic, value, status, detail``."""
    named = {n: n for n in categorical}
    if label:
        named["realised_outcome"] = label
    if prediction:
        named["prediction_mix"] = prediction
    parts = []
    if named:
        freq = frequencies(baseline, current, named)
        contrib = contributions(freq)
        fresh = new_categories(freq).groupBy("signal").agg(
            F.array_sort(F.collect_list("category")).alias("new_categories"))
        parts.append((contrib, fresh, 5))
    if numeric:
        freq = numeric_frequencies(baseline, current, numeric)
        parts.append((contributions(freq.drop("baseline_sum", "current_sum")),
                      numeric_means(freq), 4))
    out = None
    concept = F.col("signal").isin("realised_outcome", "prediction_mix")
    for contrib, extra, k in parts:
        top = top_contributors(contrib, k).groupBy("signal").agg(
            F.array_sort(F.collect_list(F.struct(
                "rank", "category", F.round("contribution", 6).alias("contribution"))))
            .alias("top_contributors"))
        detail = F.to_json(F.struct(
            "top_contributors", *[n for n in extra.columns if n != "signal"]))
        rows = psi(contrib).join(top, "signal", "left").join(extra, "signal", "left").select(
            "signal", F.when(concept, "concept").otherwise("data").alias("kind"),
            F.lit("psi").alias("statistic"), F.col("psi").alias("value"), "status",
            detail.alias("detail"))
        out = rows if out is None else out.unionByName(rows)
    return out


def roll_up(found: DataFrame) -> DataFrame:
    """Worst status, whether a concept signal moved, and the action that follows."""
    level = (F.when(F.col("status") == "alert", 2)
             .when(F.col("status") == "investigate", 1).otherwise(0))
    moved = (F.col("kind") == "concept") & (F.col("status") != "stable")
    worst = F.coalesce(F.max_by("status", level), F.lit("stable"))
    return found.agg(
        worst.alias("overall_status"),
        F.coalesce(F.bool_or(moved), F.lit(False)).alias("concept_drift_detected"),
        F.count(F.lit(1)).alias("signals")).withColumn(
        "action", F.when(F.col("concept_drift_detected"), ACTIONS["concept"])
        .when(F.col("overall_status") == "alert", ACTIONS["alert"])
        .when(F.col("overall_status") == "investigate", ACTIONS["investigate"])
        .otherwise(ACTIONS["stable"]))
