"""Typing, quarantine, first-valid-wins deduplication, splits and labels."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remedia import policy
from remedia.functions.dates import parse_day
from remedia.functions.text import strip, to_float, to_int, word_count
from remedia.operators import contracts as c
from remedia.operators.deadlines import regulation_for_issue
from remedia.operators.skew import join_unique
from remedia.session import stored

REASON = "_quarantine_reason"
TEXT_FIELDS = ("product", "issue", "company", "company_size", "state", "submitted_via",
               "narrative", "company_response")


class Layer(NamedTuple):
    name: str
    rows: DataFrame
    quarantine: DataFrame | None
    report: DataFrame


def mark_repeats(
    df: DataFrame, key: str, ordinal: list[str], valid: Column, out: str = "_repeat",
) -> DataFrame:
    """Flag rows that come after the first *valid* row of their key.

    A row that is itself not valid does not claim its key. The first valid
    ordinal is a map-side combined aggregate, stored for the keys that occur more than
    once; only these are joined back, hot ones spread over many tasks.
    """
    order = F.struct(*ordinal)
    firsts = stored(df.withColumn("_valid", valid).groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(F.when(F.col("_valid"), order)).alias("_first")).where("_n > 1"), "firsts")
    joined = join_unique(df, firsts, key, "_n", df.agg(F.count(F.lit(1))).scalar(), ordinal)
    return joined.withColumn(
        out, F.coalesce(order > F.col("_first"), F.lit(False))).drop("_first")


def _bad_number(name: str, parsed: Column, kind: str = "float") -> Column:
    text = F.col(name)
    said = ("could not convert string to float: '" if kind == "float"
            else "invalid literal for int() with base 10: '")
    return (
        F.when(text.isNull(), F.lit(f"KeyError: '{name}'"))
        .when(parsed.isNull(), F.concat(F.lit(f"ValueError: {said}"), text, F.lit("'"))))


def parse_complaints(bronze: DataFrame) -> DataFrame:
    """Add the typed silver struct ``_typed``, the trimmed id and ``_error`` (NULL when valid)."""
    amount_text = F.coalesce(F.col("disputed_amount"), F.lit(""))
    amount = F.when(amount_text != "", to_float(amount_text))
    received = parse_day(F.col("date_received"))
    trimmed = {n: strip(F.coalesce(F.col(n), F.lit(""))) for n in TEXT_FIELDS}
    stated = strip(F.coalesce(F.col("regulation"), F.lit("")))
    yes = {n: F.coalesce(strip(F.col(n)) == "Yes", F.lit(False))
           for n in ("timely_response", "consumer_disputed")}
    error = F.coalesce(
        F.when(F.col("complaint_id").isNull(), F.lit("KeyError: 'complaint_id'")),
        F.when(received.isNull(), F.concat(
            F.lit("ValueError: date_received is not an ISO date: '"),
            F.coalesce("date_received", F.lit("")), F.lit("'"))),
        F.when((amount_text != "") & amount.isNull(), F.concat(
            F.lit("ValueError: could not convert string to float: '"), amount_text, F.lit("'"))))
    typed = F.struct(
        strip(F.col("complaint_id")).alias("complaint_id"),
        received.alias("date_received"),
        trimmed["product"].alias("product"),
        trimmed["issue"].alias("issue"),
        F.when(stated != "", stated).otherwise(
            regulation_for_issue(trimmed["issue"])).alias("regulation"),
        *[trimmed[n].alias(n) for n in
          ("company", "company_size", "state", "submitted_via", "narrative")],
        word_count(trimmed["narrative"]).alias("narrative_length"),
        amount.alias("disputed_amount"),
        trimmed["company_response"].alias("company_response"),
        *[yes[n].alias(n) for n in yes])
    return bronze.select(
        "*", strip(F.col("complaint_id")).alias("_key"), typed.alias("_typed"), error.alias("_error"))


def split_silver(parsed: DataFrame, duplicate_reason: str | None, ordinal: list[str] | None,
                 raw_columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(clean typed rows, quarantined raw rows with a reason); together they are the input."""
    reason = F.col("_error")
    if duplicate_reason:
        parsed = mark_repeats(parsed, "_key", ordinal, F.col("_error").isNull())
        reason = F.when(F.col("_repeat"), F.lit(duplicate_reason)).otherwise(reason)
    judged = parsed.withColumn(REASON, reason)
    clean = judged.where(F.col(REASON).isNull()).select("_typed.*")
    quarantine = judged.where(F.col(REASON).isNotNull()).select(*raw_columns, REASON)
    return clean, quarantine


def bronze_complaints(rows: DataFrame, minimum: int = 1000) -> Layer:
    return Layer("bronze/complaints", rows, None, c.report(rows, [
        c.row_count(minimum, "an empty or cut-off extract leaves nothing to learn from"),
        c.not_null("complaint_id", "a row without an id cannot be deduplicated or traced"),
        c.not_null("date_received", "splits are by date; an undated row has no place"),
    ]))


def bronze_fraud(rows: DataFrame, minimum: int = 1000) -> Layer:
    return Layer("bronze/fraud", rows, None, c.report(rows, [
        c.row_count(minimum, "too few rows to estimate a base rate near one percent"),
        c.not_null("application_id", "a row without an id cannot be deduplicated"),
        c.not_null("month", "the month is the split key"),
    ]))


def complaint_contract(rows: DataFrame, ordinal: list[str] | None = None) -> DataFrame:
    """``ordinal`` names the columns of the stored row order, where there is one."""
    return c.report(rows, [
        c.unique("complaint_id", "a repeated complaint could sit in both train and test"),
        c.not_null("narrative", "the classifier reads nothing else"),
        c.in_set("issue", policy.KNOWN_ISSUES, "an unknown issue has no regulation"),
        c.in_set("company_response", policy.RESPONSE_CATEGORIES,
                 "an unknown response breaks the outcome label"),
        c.in_set("regulation", policy.REGULATIONS, "the regulation drives every deadline"),
        c.monotonic("date_received", ordinal or ["date_received", "complaint_id"],
                    "an unordered table makes the temporal split random"),
        c.between("narrative_length", 3, 400, "so short or long a narrative was misparsed"),
        c.class_balance("issue", 0.005, "too rare a class has no meaningful test recall"),
    ])


def fraud_contract(rows: DataFrame, ordinal: list[str] | None = None) -> DataFrame:
    return c.report(rows, [
        c.unique("application_id", "a repeated application leaks across the split"),
        c.in_set("fraud_bool", [0, 1], "the label is binary"),
        c.between("month", 0, 11, "the month is the split key"),
        c.monotonic("month", ordinal or ["month", "application_id"],
                    "an unordered table makes the temporal split random"),
        c.between("customer_age", 10, 100, "an age out of range was misparsed"),
    ])


def silver_complaints(bronze: DataFrame, ordinal: list[str]) -> Layer:
    raw = [n for n in bronze.columns if n not in ordinal]
    clean, quarantine = split_silver(
        parse_complaints(bronze), "duplicate complaint_id", ordinal, raw)
    return Layer("silver/complaints", clean, quarantine, complaint_contract(clean))


def silver_fraud(bronze: DataFrame, ordinal: list[str] | None = None) -> Layer:
    """Typed applications. Repeats are reported by the contract, not removed."""
    raw = [n for n in bronze.columns if n not in (ordinal or [])]
    ints = {n: to_int(F.col(n)) for n in ("month", "fraud_bool")}
    floats = {n: to_float(F.col(n)) for n in policy.FRAUD_FEATURES}
    error = F.coalesce(
        F.when(F.col("application_id").isNull(), F.lit("KeyError: 'application_id'")),
        *[_bad_number(n, v, "int") for n, v in ints.items()],
        *[_bad_number(n, v) for n, v in floats.items()])
    typed = F.struct(
        strip(F.col("application_id")).alias("application_id"),
        *[v.alias(n) for n, v in ints.items()], *[v.alias(n) for n, v in floats.items()])
    parsed = bronze.select("*", typed.alias("_typed"), error.alias("_error"))
    clean, quarantine = split_silver(parsed, None, None, raw)
    return Layer("silver/fraud", clean, quarantine, fraud_contract(clean))


def temporal_split(value: Column, train_end, validation_end) -> Column:
    return (F.when(value < F.lit(train_end), F.lit("train"))
            .when(value < F.lit(validation_end), F.lit("validation"))
            .otherwise(F.lit("test")))


def with_labels(df: DataFrame) -> DataFrame:
    return df.select(
        "*", F.col("issue").alias("label_issue"),
        F.col("company_response").alias("label_outcome"),
        F.col("company_response").isin(policy.RELIEF_CATEGORIES).alias("label_relief"),
        F.col("consumer_disputed").alias("label_escalation"))


def gold_complaints(silver: Layer, split_dates=policy.COMPLAINT_SPLIT_DATES) -> Layer:
    bounds = [F.to_date(F.lit(d)) for d in split_dates]
    rows = with_labels(silver.rows.withColumn(
        "split", F.when(F.col("date_received") < bounds[0], "train")
        .when(F.col("date_received") < bounds[1], "validation").otherwise("test")))
    return Layer("gold/complaints", rows, silver.quarantine, c.report(rows, [
        c.in_set("split", ["train", "validation", "test"], "an unassigned row is in no fold"),
        c.not_null("label_issue", "the classification target"),
        c.class_balance("split", 0.10, "so small a fold gives no usable interval"),
    ]))


def gold_fraud(silver: Layer, split_months=policy.FRAUD_SPLIT_MONTHS) -> Layer:
    rows = silver.rows.withColumn("split", temporal_split(F.col("month"), *split_months))
    return Layer("gold/fraud", rows, silver.quarantine, c.report(rows, [
        c.in_set("split", ["train", "validation", "test"], "an unassigned row is in no fold"),
        c.class_balance("split", 0.10, "so small a fold cannot estimate a one-percent rate"),
    ]))


def fold(df: DataFrame, name: str) -> DataFrame:
    """One fold; a partition filter where the table is stored partitioned by ``split``."""
    return df.where(F.col("split") == name)


def counts(df: DataFrame, key: str, out: str = "rows") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(out))


def union_quarantines(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
