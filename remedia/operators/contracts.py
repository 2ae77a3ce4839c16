"""Declarative data contracts, compiled into few passes over a table.

All checks that are one aggregate are computed in a single ``agg``. Checks on
values (uniqueness, membership, balance) share one shuffle: their columns are
unpivoted and counted together, combined map-side, so a value that holds a large
share of the rows costs one partial row per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from remedia.operators import skew
from remedia.session import stored

REPORT = ("position int, name string, column string, severity string, passed boolean, "
          "violations long, detail string, consequence string")


class DataContractError(RuntimeError):
    """A blocking expectation of a layer was not met."""


@dataclass(frozen=True)
class Expectation:
    name: str
    column: str | None
    kind: str
    consequence: str = ""
    severity: str = "error"
    args: dict = field(default_factory=dict)


def _expect(kind):
    def build(name, column, consequence, severity, **args):
        return Expectation(name, column, kind, consequence, severity, args)
    return build


def not_null(column, consequence="", severity="error"):
    return _expect("not_null")(f"{column} is never null", column, consequence, severity)


def unique(column, consequence="", severity="error"):
    return _expect("unique")(f"{column} is unique", column, consequence, severity)


def in_set(column, allowed: Sequence, consequence="", severity="error"):
    return _expect("in_set")(f"{column} is one of {len(set(allowed))} known values", column,
                             consequence, severity, allowed=[str(a) for a in allowed])


def matches(column, pattern, consequence="", severity="error"):
    return _expect("matches")(f"{column} matches {pattern}", column, consequence, severity,
                              pattern=pattern)


def between(column, low, high, consequence="", severity="error"):
    return _expect("between")(f"{column} within [{low}, {high}]", column, consequence, severity,
                              low=low, high=high)


def monotonic(column, ordinal: Sequence[str], consequence="", severity="error"):
    """``column`` does not decrease along the unique ``ordinal`` columns."""
    return _expect("monotonic")(f"{column} is non-decreasing", column, consequence, severity,
                                ordinal=list(ordinal))


def class_balance(column, min_share, consequence="", severity="warning"):
    return _expect("class_balance")(f"{column} classes each hold >= {min_share:.1%}", column,
                                    consequence, severity, min_share=min_share)


def row_count(minimum, consequence="", severity="error"):
    return _expect("row_count")(f"at least {minimum} rows", None, consequence, severity,
                                minimum=minimum)


def referential(column, valid: DataFrame, valid_column: str, consequence="", severity="error"):
    return _expect("referential")(f"{column} resolves to a known key", column, consequence,
                                  severity, valid=valid, valid_column=valid_column)


def custom(name, passed: Column, violations: Column, consequence="", severity="error"):
    """A user's own check, given as aggregate Columns."""
    return _expect("custom")(name, None, consequence, severity, passed=passed,
                             violations=violations)


SCALAR = {"not_null", "matches", "between", "row_count", "custom"}
VALUES = {"unique", "in_set", "class_balance"}


def _scalar(e: Expectation) -> tuple[Column, Column, Column]:
    """(passed, violations, detail) as aggregate Columns."""
    c = F.col(e.column) if e.column else None
    if e.kind == "row_count":
        rows, least = F.count(F.lit(1)), e.args["minimum"]
        return rows >= least, F.greatest(F.lit(least) - rows, F.lit(0)), F.to_json(
            F.struct(rows.alias("rows"), F.lit(least).alias("minimum")))
    if e.kind == "custom":
        return e.args["passed"], e.args["violations"], F.lit("{}")
    text = c.cast("string")
    if e.kind == "not_null":
        bad = c.isNull() | (text == "")
    elif e.kind == "matches":
        bad = ~F.coalesce(text, F.lit("")).rlike(f"(?U)^(?:{e.args['pattern']})\\z")
    else:
        number = c.try_cast("double")
        bad = F.when(c.isNull() | (text == ""), F.lit(False)).otherwise(
            number.isNull() | F.isnan(number) | (number < e.args["low"])
            | (number > e.args["high"]))
    violations = F.count_if(bad)
    example = F.any_value(F.when(bad, text), F.lit(True))
    return violations == 0, violations, F.to_json(F.struct(
        violations.alias("violations"), example.alias("example")))


def _row(i: int, e: Expectation, passed: Column, violations: Column, detail: Column) -> Column:
    return F.struct(
        F.lit(i).alias("position"), F.lit(e.name).alias("name"),
        F.lit(e.column).cast("string").alias("column"), F.lit(e.severity).alias("severity"),
        passed.alias("passed"), violations.cast("long").alias("violations"),
        detail.alias("detail"), F.lit(e.consequence).alias("consequence"))


def _scalar_report(df: DataFrame, checks: list[tuple[int, Expectation]]) -> DataFrame:
    aggs, rows = [], []
    for i, e in checks:
        passed, violations, detail = _scalar(e)
        aggs += [passed.alias(f"p{i}"), violations.alias(f"v{i}"), detail.alias(f"d{i}")]
        rows.append(_row(i, e, F.col(f"p{i}"), F.col(f"v{i}"), F.col(f"d{i}")))
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _value_report(df: DataFrame, checks: list[tuple[int, Expectation]]) -> DataFrame:
    """One shuffle for every value check; at most eight example values are kept of each."""
    pairs = F.array(*[
        F.struct(F.lit(i).alias("check"), F.col(e.column).cast("string").alias("value"))
        for i, e in checks])
    counts = df.select(F.explode(pairs).alias("p")).groupBy("p.check", "p.value").agg(
        F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("check").agg(F.sum("n").alias("total"))
    counts = counts.join(F.broadcast(sizes), "check")
    bad, weight = F.lit(False), F.lit(1)
    for i, e in checks:
        here = F.col("check") == i
        if e.kind == "unique":
            bad = F.when(here, F.col("n") > 1).otherwise(bad)
            weight = F.when(here, F.col("n") - 1).otherwise(weight)
        elif e.kind == "in_set":
            allowed = F.coalesce(F.col("value").isin(e.args["allowed"]), F.lit(False))
            bad = F.when(here, ~allowed).otherwise(bad)
        else:
            bad = F.when(here, F.col("n") / F.col("total") < e.args["min_share"]).otherwise(bad)
    marked = counts.withColumn("_bad", bad).withColumn("_weight", F.when(bad, weight).otherwise(0))
    summary = marked.groupBy("check").agg(
        F.sum("_weight").alias("violations"), F.count(F.lit(1)).alias("distinct_values"))
    shown = F.coalesce("value", F.lit("None"))
    first = Window.partitionBy("check").orderBy("_shown")
    examples = (
        marked.where("_bad").withColumn("_shown", shown)
        .withColumn("_rank", F.row_number().over(first)).where("_rank <= 8")
        .groupBy("check").agg(F.array_sort(F.collect_list("_shown")).alias("examples")))
    last = max(i for i, _ in checks)
    every = df.sparkSession.range(0, last + 1, 1, 1).select(
        F.col("id").cast("int").alias("check")).where(
        F.col("check").isin([i for i, _ in checks]))
    joined = every.join(summary, "check", "left").join(examples, "check", "left").fillna(
        0, ["violations", "distinct_values"])
    detail = F.to_json(F.struct("violations", "distinct_values", "examples"))
    rows = None
    for i, e in checks:
        row = _row(i, e, F.col("violations") == 0, F.col("violations"), detail)
        rows = F.when(F.col("check") == i, row) if rows is None else rows.when(
            F.col("check") == i, row)
    return joined.select(rows.alias("r")).select("r.*")


def first_break(df: DataFrame, column: str, ordinal: Sequence[str]) -> DataFrame:
    """Adjacent pairs out of order: ``violations`` and the ordinal of the first break.

    Rows are placed in ordinal-range buckets; pairs inside a bucket are compared
    by a window over that bucket, pairs across buckets through the last row of
    the nearest earlier one (a table with one row per bucket).
    """
    keys = list(ordinal)
    rows = skew._bucketed(
        stored(df.select(*keys, F.col(column).alias("_v")), "ordered"), keys, skew.range_buckets(df))
    key = F.struct(*keys)
    ends = rows.groupBy("_bucket").agg(F.max_by(F.struct("_v"), key).alias("_last"))
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket")
    ends = ends.select("_bucket", F.lag("_last").over(before).alias("_carried"))
    inside = Window.partitionBy("_bucket").orderBy(*keys)
    previous = F.coalesce(F.lag(F.struct("_v")).over(inside), F.col("_carried"))
    paired = (
        rows.join(F.broadcast(ends), "_bucket").withColumn("_prev", previous)
        .withColumn("_broken", F.col("_prev").isNotNull()
                    & ~F.coalesce(F.col("_prev._v") <= F.col("_v"), F.lit(False))))
    return paired.agg(
        F.count_if("_broken").alias("violations"),
        F.min(F.when(F.col("_broken"), key)).alias("first_break"))


def _monotonic_report(df: DataFrame, i: int, e: Expectation) -> DataFrame:
    found = first_break(df, e.column, e.args["ordinal"])
    return found.select(_row(
        i, e, F.col("violations") == 0, F.col("violations"),
        F.to_json(F.struct("violations", "first_break"))).alias("r")).select("r.*")


def unresolved(df: DataFrame, column: str, valid: DataFrame, valid_column: str) -> DataFrame:
    """Distinct values of ``column`` that are not among the valid keys (NULL included)."""
    distinct = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    keys = valid.select(F.col(valid_column).alias("value")).distinct()
    return distinct.join(keys, "value", "left_anti")


def _referential_report(df: DataFrame, i: int, e: Expectation) -> DataFrame:
    lost = unresolved(df, e.column, e.args["valid"], e.args["valid_column"])
    shown = F.coalesce(F.col("value").cast("string"), F.lit("None")).alias("s")
    examples = lost.select(shown).orderBy("s").limit(8).agg(
        F.array_sort(F.collect_list("s")).alias("e"))
    summary = lost.agg(F.count(F.lit(1)).alias("violations")).withColumn(
        "unresolvable", examples.scalar())
    return summary.select(_row(
        i, e, F.col("violations") == 0, F.col("violations"),
        F.to_json(F.struct("unresolvable"))).alias("r")).select("r.*")


def report(df: DataFrame, expectations: Sequence[Expectation]) -> DataFrame:
    """One row per expectation, in declared order of ``position``."""
    numbered = list(enumerate(expectations))
    parts = []
    scalar = [(i, e) for i, e in numbered if e.kind in SCALAR]
    values = [(i, e) for i, e in numbered if e.kind in VALUES]
    if scalar:
        parts.append(_scalar_report(df, scalar))
    if values:
        parts.append(_value_report(df, values))
    for i, e in numbered:
        if e.kind == "monotonic":
            parts.append(_monotonic_report(df, i, e))
        elif e.kind == "referential":
            parts.append(_referential_report(df, i, e))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def enforce(layer: str, checked: DataFrame) -> list:
    """Raise when a blocking expectation failed. The report has one row per check."""
    rows = checked.orderBy("position").collect()
    blocking = [r for r in rows if r["severity"] == "error" and not r["passed"]]
    if blocking:
        lines = "\n".join(
            f"  - {r['name']}: {r['detail']}  ({r['consequence']})" for r in blocking)
        raise DataContractError(
            f"{layer} failed {len(blocking)} blocking expectation(s):\n{lines}")
    return rows


def observed(
    df: DataFrame, expectations: Sequence[Expectation], name: str,
) -> tuple[DataFrame, Observation]:
    """The scalar checks as metrics of ``df`` itself, gathered while it is written."""
    watch = Observation(name)
    metrics = [_scalar(e)[1].cast("long").alias(e.name)
               for e in expectations if e.kind in SCALAR]
    return df.observe(watch, *metrics), watch
