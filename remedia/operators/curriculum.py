"""Difficulty of a case, ordering by difficulty, and chat-format examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remedia import policy
from remedia.functions.dates import iso
from remedia.functions.text import word_count
from remedia.operators import metrics, skew

INSTRUCTION = (
    "Answer the consumer's dispute from the sections and computed dates given. Cite every "
    "statement of fact, quote dates exactly as supplied, and do not decide the outcome.")


def difficulty_parts(
    deadlines: Column, valid: Column, code_mapped: Column, narrative: Column,
) -> dict[str, Column]:
    """Six parts between 0 and 1, from the deadline struct and the checks of a case."""
    flag = lambda cond: F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))
    items = deadlines["deadlines"]
    long_basis = F.exists(
        items, lambda d: d["basis"].contains("90") | d["basis"].contains("20 business"))
    count = F.when(items.isNull(), 0).otherwise(F.size(items))
    return {
        "deadline_count": F.least(count / 6.0, F.lit(1.0)),
        "extension_branch": flag(long_basis),
        "out_of_time": flag(~deadlines["consumer_notice_timely"]),
        "validation_problem": flag(~F.coalesce(valid, F.lit(True))),
        "unmapped_reason_code": flag(~F.coalesce(code_mapped, F.lit(True))),
        "narrative_noise": F.least(
            word_count(F.coalesce(narrative, F.lit(""))) / 90.0, F.lit(1.0)),
    }


def weighted(parts: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for name, weight in policy.DIFFICULTY_WEIGHTS.items():
        total = total + F.lit(weight) * parts[name]
    return total


def with_difficulty(df: DataFrame, out: str = "difficulty", parts_out: str = "difficulty_parts",
                    deadlines: str = "deadlines", validation: str = "validation",
                    reason_code: str = "reason_code", narrative: str = "narrative") -> DataFrame:
    parts = difficulty_parts(
        F.col(deadlines), F.col(f"{validation}.ok"), F.col(f"{reason_code}.mapped"),
        F.col(narrative))
    named = F.create_map(*[x for n, v in parts.items() for x in (F.lit(n), v)])
    return df.withColumn(parts_out, named).withColumn(
        out, weighted({n: F.try_element_at(F.col(parts_out), F.lit(n)) for n in parts}))


def derive_dates(df: DataFrame, id_column: str, received: Column) -> DataFrame:
    """Dispute dates a complaint does not carry, drawn from a hash of its id.

    Notice 0 to 12 days before receipt, statement one of seven gaps before that,
    transaction 1 to 20 days earlier, discovery 0 to 4 days before the notice;
    flags with fixed rates. The same id always gives the same dates.
    """
    def draw(salt: str, n: int) -> Column:
        digest = F.md5(F.concat(F.lit(f"{salt}:"), F.col(id_column).cast("string")))
        return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n).cast("int")

    def chance(salt: str, rate: float) -> Column:
        return draw(salt, 10_000) < int(rate * 10_000)

    gaps = F.array(*[F.lit(g) for g in policy.STATEMENT_GAPS])
    gap = F.element_at(gaps, draw("statement", len(policy.STATEMENT_GAPS)) + 1)
    return (
        df.withColumn("notice_date", F.date_sub(received, draw("notice", 13)))
        .withColumn("statement_date", F.date_sub(F.col("notice_date"), gap))
        .withColumn("transaction_date",
                    F.date_sub(F.col("statement_date"), draw("transaction", 20) + 1))
        .withColumn("discovery_date", F.date_sub(F.col("notice_date"), draw("discovery", 5)))
        .withColumn("point_of_sale", chance("pos", 0.35))
        .withColumn("foreign_initiated", chance("foreign", 0.08))
        .withColumn("provisional_credit_given", chance("credit", 0.55))
        .withColumn("dates_derived", F.lit(True)))


def chat(system: Column, user: Column, assistant: Column) -> Column:
    def turn(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(turn("system", system), turn("user", user), turn("assistant", assistant))


def chat_examples(
    cases: DataFrame, id_column: str = "complaint_id", instruction: str = INSTRUCTION,
) -> DataFrame:
    """Chat examples of drafted cases: the request as JSON, the letter as the answer.

    Cases whose dates do not parse are left out: they cannot carry a grounded
    answer. Needs the columns the triage plan adds, and ``difficulty``.
    """
    dates_ok = ~F.exists(
        F.col("validation.issues"),
        lambda i: i["field"].endswith("_date") & (i["severity"] == "error"))
    days = ("transaction_date", "statement_date", "notice_date")
    request = F.to_json(F.struct(
        F.struct(
            F.col(id_column).alias("complaint_id"), "issue", "narrative", "disputed_amount",
            *[iso(F.col(f"validation.{n}")).alias(n) for n in days]).alias("complaint"),
        F.col("deadlines").alias("computed_deadlines"),
        F.col("sections").alias("retrieved_sections"), "validation", "reason_code"))
    split = F.col("split") if "split" in cases.columns else F.lit(None).cast("string")
    return cases.where(dates_ok).select(
        F.col(id_column).alias("example_id"),
        chat(F.lit(instruction), request, F.col("letter")).alias("messages"),
        F.round("difficulty", 4).alias("difficulty"), "difficulty_parts",
        F.struct("issue", "regulation", split.alias("split")).alias("metadata"))


def difficulty_summary(df: DataFrame, score: str = "difficulty") -> DataFrame:
    """Count, least, upper median and greatest difficulty. The median is exact."""
    stats = skew.order_statistics(df, score, F.array(F.expr("_n div 2")))
    return df.agg(
        F.count(score).alias("examples"), F.min(score).alias("difficulty_min"),
        F.max(score).alias("difficulty_max")).withColumn(
        "difficulty_median", stats.select(F.max("value")).scalar())


def top_drivers(df: DataFrame, parts: list[str], score: str = "difficulty",
                tie: str = "example_id") -> DataFrame:
    """Mean of each part over the hardest tenth of the examples."""
    k = F.greatest(F.lit(1), F.expr("_n div 10"))
    hardest = metrics.top_rows(df.select(tie, score, *parts), score, tie, k)
    return hardest.agg(
        F.count(F.lit(1)).alias("hardest"), *[F.avg(p).alias(p) for p in parts])


def curriculum_buckets(
    df: DataFrame, score: str = "difficulty", tie: str = "example_id", buckets: int = 5,
    seed: int = 0,
) -> DataFrame:
    """Add ``rank`` (from 0), ``bucket`` and the seeded ``position`` key inside the bucket.

    Bucket size is ``n div buckets``, so a remainder forms one bucket more.
    """
    ranked = skew.running_total(
        df.withColumn("_one", F.lit(1)), [score, tie], "_one", out="rank").drop("_one")
    size = df.agg(F.greatest(F.expr(f"count(1) div {buckets}"), F.lit(1))).scalar()
    return ranked.withColumn("_size", size).withColumn(
        "bucket", F.floor(F.col("rank") / F.col("_size")).cast("long")).withColumn(
        "position", F.xxhash64(F.col(tie), F.lit(seed))).drop("_size")
