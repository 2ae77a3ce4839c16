"""The case chain over a whole table of disputes: one ``transform`` per step.

classify -> validate -> deadlines -> risk -> retrieve -> draft and verify -> route
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remedia import policy
from remedia.operators import retrieval, skew
from remedia.operators.deadlines import compute_deadlines, regulation_for_issue
from remedia.operators.letters import SECTION, draft_and_verify
from remedia.operators.validation import map_reason_code, validate_fields
from remedia.session import once, stored

STEPS = ["intake", "classify", "validate", "compute_deadlines", "assess_risk",
         "retrieve_regulation"]
NO_ISSUE = "no issue supplied and no classifier available"


def _optional(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def classify(df: DataFrame) -> DataFrame:
    """A stated issue wins over a predicted one; neither means the case is unclassifiable."""
    issue = F.coalesce(_optional(df, "issue", "string"), _optional(df, "predicted_issue", "string"))
    given = F.nullif(_optional(df, "regulation", "string"), F.lit(""))
    ident = F.coalesce(_optional(df, "complaint_id", "string"), F.lit("unassigned"))
    df = df.withColumn("complaint_id", ident).withColumn("issue", F.nullif(issue, F.lit("")))
    return df.withColumn("regulation", F.when(
        F.col("issue").isNotNull(), F.coalesce(given, regulation_for_issue(F.col("issue")))))


def validate(df: DataFrame, as_of: Column) -> DataFrame:
    checked = validate_fields(df, as_of)
    return checked.withColumn("reason_code", map_reason_code(
        _optional(df, "reason_code", "string"), F.col("issue")))


def assess_risk(df: DataFrame) -> DataFrame:
    """Priority is a policy over the escalation probability, validity and timeliness."""
    p = F.coalesce(_optional(df, "escalation_probability", "double"), F.lit(0.0))
    late = F.coalesce(~F.col("deadlines.consumer_notice_timely"), F.lit(False))
    return df.withColumn("priority", F.when(
        (p >= policy.ESCALATION_HIGH) | ~F.col("validation.ok"), "high")
        .when((p < policy.ESCALATION_LOW) & ~late, "low").otherwise("standard"))


def retrieve(
    df: DataFrame, corpus: DataFrame, projection: retrieval.Projection | None = None,
    narrative_chars: int | None = None, told: DataFrame | None = None,
) -> DataFrame:
    """Add the top sections of each case, for its issue and its narrative.

    ``narrative_chars`` limits the search to the head of the narrative. ``told`` are the same
    cases before the steps that the search does not need: requests are gathered from them.

    Cases that ask the same thing are searched once: the request text is reduced
    to its distinct values first, however many copies one of them has, and the
    answers are joined back with the copies of a hot request spread out.
    """
    head = F.coalesce(_optional(df, "narrative", "string"), F.lit(""))
    if narrative_chars is not None:
        head = F.left(head, F.lit(narrative_chars))
    text = F.concat_ws(" ", F.nullif(F.col("issue"), F.lit("")), F.nullif(head, F.lit("")))

    def requests(cases: DataFrame) -> DataFrame:
        return cases.withColumn("_text", text).withColumn(
            "_request", F.md5(F.concat_ws("\u0001", "regulation", "_text")))

    asked = requests(df)
    distinct = stored(requests(df if told is None else told).groupBy("_request").agg(
        F.count(F.lit(1)).alias("_n"), F.any_value("_text").alias("query"),
        F.any_value("regulation").alias("regulation")), "requests")
    queries = distinct.select(F.col("_request").alias("query_id"), "query", "regulation")
    top = stored(retrieval.hybrid_search(corpus, queries, projection, large="queries"), "sections")
    texts = corpus.select(F.col("id").alias("doc_id"), "regulation", "title", "text")
    found = top.join(texts, "doc_id").groupBy(F.col("query_id").alias("_request")).agg(
        F.array_sort(F.collect_list(F.struct(
            "rank", F.col("doc_id").alias("id"), "regulation", "title", "text"))).alias("_s"))
    sections = F.transform("_s", lambda s: F.struct(
        s["id"].alias("id"), s["regulation"].alias("regulation"), s["title"].alias("title"),
        s["text"].alias("text"))).cast(f"array<{SECTION}>")
    answers = distinct.select("_request", "_n").join(found, "_request", "left").select(
        "_request", "_n", sections.alias("sections"))
    total = distinct.agg(F.sum("_n")).scalar()
    return skew.join_unique(
        asked, answers, "_request", "_n", total, ["complaint_id", "notice_date"]
    ).drop("_request", "_text")


def without_sections(df: DataFrame) -> DataFrame:
    return df.withColumn("sections", F.array().cast(f"array<{SECTION}>"))


def route(df: DataFrame) -> DataFrame:
    """Queue, approval flag and the path each case took; unclassifiable cases escape."""
    known = F.col("issue").isNotNull()
    person = ~F.col("verification_passed") | (F.col("priority") == "high")
    loop = F.flatten(F.transform(
        F.sequence(F.lit(1), F.col("attempts")),
        lambda i: F.array(F.lit("draft"), F.lit("verify"))))
    path = F.when(known, F.concat(F.array(*[F.lit(s) for s in STEPS]), loop,
                                  F.array(F.lit("route")))).otherwise(
        F.array(F.lit("intake"), F.lit("classify"), F.lit("unclassifiable")))
    kept = {n: F.when(known, F.col(n)) for n in (
        "validation", "reason_code", "deadlines", "liability", "priority", "sections",
        "letter", "verification", "verification_passed", "attempts")}
    routed = df.withColumn("queue", F.when(~known | person, "manual_review").otherwise(
        "auto_send")).withColumn("requires_human_approval", ~known | person).withColumn(
        "reason", F.when(~known, F.lit(NO_ISSUE))).withColumn("path", path)
    return routed.select(*[
        kept[n].alias(n) if n in kept else F.col(n) for n in routed.columns])


def triage(
    disputes: DataFrame, as_of: Column, corpus: DataFrame | None = None,
    projection: retrieval.Projection | None = None, valid_sections: Column | None = None,
    narrative_chars: int | None = None,
) -> DataFrame:
    """Every step for every dispute.

    ``corpus`` is the section corpus; without it no sections are quoted and
    ``valid_sections`` (an array of ids) says which citations resolve. Predicted
    columns (``predicted_issue``, ``escalation_probability``) are used if present.
    """
    if valid_sections is None:
        if corpus is None:
            raise ValueError("give a section corpus or the valid section ids")
        valid_sections = corpus.agg(F.array_sort(F.collect_set("id"))).scalar()
    classified = disputes.transform(classify)
    cases = (
        classified.transform(lambda d: validate(d, as_of))
        .transform(lambda d: once(d, "validation", "reason_code"))
        .transform(compute_deadlines).transform(lambda d: once(d, "deadlines", "liability"))
        .transform(assess_risk))
    if corpus is None:
        cases = without_sections(cases)
    else:
        cases = retrieve(cases, corpus, projection, narrative_chars, classified)
    return cases.transform(lambda d: draft_and_verify(d, valid_sections)).transform(route)


def required_stages_met(cases: DataFrame, *more: Column) -> DataFrame:
    """Cases with an outcome that skipped a required stage without escaping (should be 0).

    ``more`` aggregates over the same cases are taken in the same pass.
    """
    escaped = F.array_contains("path", "unclassifiable")
    skipped = F.col("deadlines").isNull() | F.col("verification").isNull()
    return cases.agg(F.count_if(F.col("queue").isNotNull() & ~escaped & skipped).alias(
        "violations"), *more)


def seeded_sample(df: DataFrame, id_column: str, n: int, seed: int) -> DataFrame:
    """``n`` rows in the order of a seeded hash: a sampling operator, repeatable."""
    return df.orderBy(F.xxhash64(F.col(id_column), F.lit(seed)), id_column).limit(n)


def evaluation(cases: DataFrame) -> DataFrame:
    """One row over verified letters: resolution, invented dates, pass and attempt rates."""
    v, passed = F.col("verification"), F.col("verification_passed")
    seen = passed.isNotNull()
    return cases.agg(
        F.count(passed).alias("letters"), F.sum(v["citations"]).alias("citations"),
        F.coalesce(F.try_divide(F.sum(v["resolved"]), F.sum(v["citations"])), F.lit(1.0)).alias(
            "citation_resolution"),
        F.sum(F.size(v["invented_dates"])).alias("invented_dates"),
        F.sum(F.size(v["uncited_claims"])).alias("uncited_claims"),
        F.avg(passed.cast("double")).alias("verification_pass_rate"),
        F.avg((passed & (F.col("attempts") == 1)).cast("double")).alias(
            "passed_on_first_attempt"),
        F.avg("attempts").alias("mean_draft_attempts"),
        F.count_if(seen & (F.col("queue") == "auto_send")).alias("auto_send"),
        F.count_if(seen & (F.col("queue") == "manual_review")).alias("manual_review"))


def failures(cases: DataFrame, limit: int = 5) -> DataFrame:
    return cases.where(~F.col("verification_passed")).orderBy("complaint_id").limit(limit).select(
        "complaint_id", "verification")
