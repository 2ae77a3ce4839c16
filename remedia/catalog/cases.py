"""Queries over letters, routing, difficulty and training examples of whole case tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from remedia import policy
from remedia.catalog.base import disputes, sql_list, sql_str, table
from remedia.catalog.monitoring import AUC_SQL, BUDGET_PART, PRED_SQL, predictions, scored_events
from remedia.catalog.rules import ALL_ROWS_SQL, FINDINGS_SQL
from remedia.operators import curriculum, manifest, metrics
from remedia.operators.deadlines import compute_deadlines, explode_deadlines, regulation_for_issue
from remedia.plans import triage as plan
from remedia.session import stored

AS_OF = "2000-06-30"
# every citation a rule can give except one, which therefore never resolves
VALID_SECTIONS = [
    "1005.11(b)", "1005.11(c)(1)", "1005.11(c)(2)", "1005.11(c)(3)", "1005.11(d)",
    "1026.13(b)", "1026.13(c)(1)", "1026.13(c)(2)", "1681i(a)(1)", "1681i(a)(5)"]
ORDER = [
    "consumer notice deadline (missed)", "consumer notice deadline",
    "investigation concluded, or provisional credit given", "extended investigation deadline",
    "notify consumer of the provisional credit", "report results to the consumer",
    "correct the error if one occurred", "billing error notice deadline",
    "written acknowledgement to the consumer", "resolution complete", "reinvestigation complete",
    "notify the consumer of any reinsertion", "validation notice sent",
    "consumer dispute window closes"]


def claims(spark, sf_dir, orders=None):
    """Disputes with some issues missing, a model score and a narrative of varying length."""
    k = F.col("key")
    return disputes(spark, sf_dir, orders).withColumn(
        "issue", F.when(k % 31 != 0, F.col("issue"))).withColumn(
        "escalation_probability", (k % 100) / 100.0).withColumn(
        "narrative", F.repeat(F.lit("word "), (k % 120).cast("int")))


def cases(spark, sf_dir):
    valid = F.array(*[F.lit(x) for x in VALID_SECTIONS])
    return plan.triage(claims(spark, sf_dir), F.to_date(F.lit(AS_OF)), valid_sections=valid)


def letters_verified(spark, sf_dir):
    v = F.col("verification")
    return cases(spark, sf_dir).select(
        "complaint_id", v["citations"].alias("citations"), v["resolved"].alias("resolved"),
        F.size(v["unresolved"]).alias("unresolved"),
        F.size(v["uncited_claims"]).alias("uncited_claims"),
        F.size(v["invented_dates"]).alias("invented_dates"),
        F.col("verification_passed").alias("passed"),
        "attempts", F.md5("letter").alias("letter_md5"), "priority", "queue",
        F.size("path").alias("steps"))


def triage_routing(spark, sf_dir):
    return cases(spark, sf_dir).groupBy(
        "regulation", "queue", "priority", "attempts").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("requires_human_approval").alias("approvals"))


def workflow_evaluation(spark, sf_dir):
    e = plan.evaluation(cases(spark, sf_dir))
    rates = ("citation_resolution", "verification_pass_rate", "passed_on_first_attempt",
             "mean_draft_attempts")
    return e.select(
        "letters", "citations", "invented_dates", "uncited_claims", "auto_send", "manual_review",
        *[F.round(n, 6).alias(n) for n in rates])


def required_stages(spark, sf_dir):
    """Cases that skipped a required stage, and how many stages all cases went through."""
    return plan.required_stages_met(
        cases(spark, sf_dir), F.count(F.lit(1)).alias("cases"), F.sum(F.size("path")).alias("steps"))


def stated_deadlines(spark, sf_dir):
    """Every computed deadline beside a stated one: 30 days from the notice, for some cases 45."""
    df = disputes(spark, sf_dir).withColumn("regulation", regulation_for_issue(F.col("issue")))
    rows = explode_deadlines(compute_deadlines(df, liability=None), ["complaint_id", "key", "notice_date"])
    return rows.withColumn("stated", F.date_add("notice_date", F.when(F.col("key") % 10 == 0, 45).otherwise(30)))


STATED_SQL = """stated AS (
  SELECT r.name, r.due, d.notice_date + CASE WHEN d.key % 10 = 0 THEN 45 ELSE 30 END AS stated
  FROM deadline_rows r JOIN disputes d USING (complaint_id))"""


def deadline_exactness(spark, sf_dir):
    """Share of computed deadlines that are the stated date, and the days of all of them, by name."""
    rows = stated_deadlines(spark, sf_dir)
    days = rows.groupBy("name").agg(F.sum(F.date_diff("due", F.to_date(F.lit("1990-01-01")))).alias("due_days"))
    return metrics.exactness(rows, "due", "stated", "name").join(days, "name").select(
        "name", "cases", "exact", F.round("exactness", 6).alias("exactness"), "due_days")


def promotion_gates(spark, sf_dir):
    """Gates over the deadlines, letters and models of this catalogue; two metrics are not produced."""
    def named(name, df, column):
        return df.select(F.lit(name).alias("name"), F.round(column, 6).alias("actual"))

    letters = stored(plan.evaluation(cases(spark, sf_dir)), "letters")
    scored = scored_events(spark, sf_dir)
    produced = (
        named("deadline_exactness", metrics.exactness(stated_deadlines(spark, sf_dir), "due", "stated"), "exactness")
        .unionByName(named("citation_resolution", letters, "citation_resolution"))
        .unionByName(named("issue_macro_f1", metrics.classification_summary(
            predictions(spark, sf_dir)), "macro_f1"))
        .unionByName(named("escalation_roc_auc", metrics.roc_auc(scored), "roc_auc"))
        .unionByName(named("fraud_recall_at_budget", metrics.recall_at_budget(scored), "recall")))
    return metrics.promotion_gates(produced, invented_dates=letters.select("invented_dates").scalar())


def letter_failures(spark, sf_dir):
    return plan.failures(cases(spark, sf_dir)).select(
        "complaint_id", F.size("verification.unresolved").alias("unresolved"))


def scored_cases(spark, sf_dir):
    known = cases(spark, sf_dir).where(F.col("issue").isNotNull())
    return curriculum.with_difficulty(known)


def difficulty_scores(spark, sf_dir):
    return scored_cases(spark, sf_dir).select(
        "complaint_id", F.round("difficulty", 6).alias("difficulty"),
        *[F.round(F.try_element_at("difficulty_parts", F.lit(p)), 6).alias(p)
          for p in policy.DIFFICULTY_WEIGHTS])


def chat_examples(spark, sf_dir):
    made = curriculum.chat_examples(scored_cases(spark, sf_dir))
    user = F.element_at("messages", 2)["content"]
    return made.select(
        "example_id", F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"),
        F.md5(F.element_at("messages", 3)["content"]).alias("answer_md5"),
        F.get_json_object(user, "$.complaint.issue").alias("issue"),
        F.get_json_object(user, "$.complaint.notice_date").alias("notice_date"),
        F.get_json_object(user, "$.computed_deadlines.regulation").alias("regulation"),
        F.round("difficulty", 4).alias("difficulty"))


LETTER_SQL = f"""
{ALL_ROWS_SQL},
found AS ({FINDINGS_SQL}),
lines AS (
  SELECT complaint_id, string_agg('- ' || upper(left(name, 1)) || substr(name, 2) || ': '
      || strftime(due, '%Y-%m-%d') || ' (' || basis || ') [calc:'
      || regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')
      || '] [reg:' || citation || '].', chr(10)
      ORDER BY list_position({sql_list(ORDER)}, name)) AS dated,
    list(strftime(due, '%Y-%m-%d')) AS dues,
    list(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'))
      AS slugs,
    bool_or(basis LIKE '%90%' OR basis LIKE '%20 business%') AS long_basis
  FROM deadline_rows GROUP BY 1),
codes(code, label, evidence) AS (VALUES {', '.join(
    f"({sql_str(c)}, {sql_str(lb)}, {sql_str(', '.join(ev))})"
    for c, _, lb, _, _, _, ev in policy.REASON_CODES)}),
derive(issue, code) AS (VALUES {', '.join(
    f'({sql_str(i)}, {sql_str(x)})' for i, x in policy.REASON_CODE_OF_ISSUE.items())}),
facts0 AS (
  SELECT d.*, f.regulation, f.timely, f.findings, f.citations, f.deadlines AS n_deadlines,
    l.dated, l.dues, l.slugs, l.long_basis, c.code, c.label, c.evidence,
    [x FOR x IN [
      CASE WHEN transaction_date > DATE '{AS_OF}' THEN
        strftime(transaction_date, '%Y-%m-%d') || ' is in the future' END,
      CASE WHEN statement_date > DATE '{AS_OF}' THEN
        strftime(statement_date, '%Y-%m-%d') || ' is in the future' END,
      CASE WHEN notice_date > DATE '{AS_OF}' THEN
        strftime(notice_date, '%Y-%m-%d') || ' is in the future' END] IF x IS NOT NULL] AS problems
  FROM disputes d JOIN found f USING (complaint_id) JOIN lines l USING (complaint_id)
  LEFT JOIN derive r ON r.issue = d.issue LEFT JOIN codes c ON c.code = r.code
  WHERE key % 31 <> 0),
facts1 AS (
  SELECT *, CASE WHEN (key % 100) / 100 >= 0.65 OR len(problems) > 0 THEN 'high'
      WHEN (key % 100) / 100 < 0.35 AND timely THEN 'low' ELSE 'standard' END AS priority,
    concat_ws(chr(10), 'Re: dispute ' || complaint_id || ' - ' || issue, '',
      {sql_str(policy.LETTER_THANKS)}, '', {sql_str(policy.HEADING_APPLIES)}, '',
      CASE WHEN timely THEN chr(10) || {sql_str(policy.HEADING_DATES)} || chr(10) || chr(10) || dated
           ELSE chr(10) || {sql_str(policy.LETTER_LATE)} || split_part(citations, ',', 1) || '].' END,
      CASE WHEN findings <> '' THEN chr(10) || {sql_str(policy.HEADING_MEANS)} || chr(10) || chr(10)
        || '- ' || replace(findings, '|', chr(10) || '- ') END,
      CASE WHEN code IS NOT NULL THEN chr(10) || {sql_str(policy.LETTER_CODE)} || code || ' ('
        || label || '). ' || {sql_str(policy.LETTER_EVIDENCE)} || evidence || '.'
        ELSE chr(10) || {sql_str(policy.LETTER_UNMAPPED)} END,
      CASE WHEN len(problems) > 0 THEN chr(10) || {sql_str(policy.HEADING_NEEDED)} || chr(10)
        || chr(10) || '- ' || array_to_string(problems, chr(10) || '- ') END,
      chr(10) || {sql_str(policy.LETTER_CLOSING)}) AS base
  FROM facts0)"""


def _check_sql(source: str, name: str) -> str:
    """Verification of column ``txt`` as one CTE."""
    boiler = " OR ".join(f"contains(lower(s), {sql_str(b)})" for b in policy.BOILERPLATE)
    facts = " OR ".join(f"contains(lower(s), {sql_str(m)})" for m in policy.FACT_MARKERS)
    cite = policy.CITATION_PATTERN
    return rf"""{name}_a AS (
      SELECT *, regexp_extract_all(txt, '{cite}', 1) AS cited,
        regexp_extract_all(txt, '\b(\d{{4}}-\d{{2}}-\d{{2}})\b', 1) AS quoted,
        list_transform(string_split(regexp_replace(txt, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
          lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')) AS pieces FROM {source}),
    {name}_b AS (
      SELECT *, list_filter(cited, lambda c: NOT list_contains(
          list_concat({sql_list(VALID_SECTIONS)}, slugs), c)) AS lost,
        list_filter(quoted, lambda q: NOT list_contains(dues, q)) AS invented,
        list_filter(pieces, lambda s: len(string_split_regex(s, '\s+')) >= 8
          AND NOT starts_with(s, '#') AND NOT starts_with(s, '<!--') AND NOT starts_with(s, '|')
          AND NOT ({boiler}) AND ({facts}) AND NOT regexp_matches(s, '{cite}')) AS uncited
      FROM {name}_a),
    {name} AS MATERIALIZED (
      SELECT *, len(lost) = 0 AND len(invented) = 0 AND len(uncited) = 0 AS passed,
        concat_ws('; ',
          CASE WHEN len(lost) > 0 THEN 'citations that resolve to nothing: '
            || array_to_string(lost, ', ') END,
          CASE WHEN len(invented) > 0 THEN 'dates not produced by the rules engine: '
            || array_to_string(invented, ', ') || '; quote only the supplied deadlines' END,
          CASE WHEN len(uncited) > 0 THEN len(uncited)
            || ' factual sentence(s) with no citation' END) AS critique
      FROM {name}_b)"""


def _again(source: str, name: str, attempt: int) -> str:
    drop = "cited, quoted, pieces, lost, invented, uncited, passed, critique, txt, attempts"
    return f"""{name} AS (
      SELECT * EXCLUDE ({drop}),
        CASE WHEN passed THEN txt ELSE base || chr(10) || chr(10) || '<!-- revised after review: '
          || left(critique, 200) || ' -->' END AS txt,
        CASE WHEN passed THEN attempts ELSE {attempt} END AS attempts FROM {source})"""


VERIFIED_SQL = f"""{LETTER_SQL},
t1 AS (SELECT *, base AS txt, 1 AS attempts FROM facts1),
{_check_sql('t1', 'v1')}, {_again('v1', 't2', 2)},
{_check_sql('t2', 'v2')}, {_again('v2', 't3', 3)},
{_check_sql('t3', 'v3')},
final AS (
  SELECT *, CASE WHEN NOT passed OR priority = 'high' THEN 'manual_review' ELSE 'auto_send' END
    AS queue FROM v3)"""

DIFFICULTY_SQL = f"""{VERIFIED_SQL},
parts AS (
  SELECT *, least(n_deadlines / 6, 1) AS deadline_count,
    CASE WHEN long_basis THEN 1 ELSE 0 END AS extension_branch,
    CASE WHEN timely THEN 0 ELSE 1 END AS out_of_time,
    CASE WHEN len(problems) > 0 THEN 1 ELSE 0 END AS validation_problem,
    CASE WHEN code IS NULL THEN 1 ELSE 0 END AS unmapped_reason_code,
    least((key % 120) / 90, 1) AS narrative_noise FROM final),
scored AS (
  SELECT *, 0.25 * deadline_count + 0.25 * extension_branch + 0.20 * out_of_time
    + 0.15 * validation_problem + 0.10 * unmapped_reason_code + 0.05 * narrative_noise
    AS difficulty FROM parts)"""


def derived_dates(spark, sf_dir):
    """Derived dispute dates and flags of every order."""
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("C"), F.col("o_orderkey").cast("string")).alias("complaint_id"),
        F.col("o_orderdate").cast("date").alias("received"))
    return curriculum.derive_dates(rows, "complaint_id", F.col("received")).drop("dates_derived")


def _draw(salt: str, n: int) -> str:
    return f"CAST(CAST('0x' || substr(md5('{salt}:' || complaint_id), 1, 8) AS BIGINT) % {n} AS INT)"


DERIVED_SQL = f"""
WITH o AS (SELECT 'C' || o_orderkey AS complaint_id, CAST(o_orderdate AS DATE) AS received FROM orders),
n AS (SELECT *, received - {_draw('notice', 13)} AS notice_date FROM o),
s AS (SELECT *, notice_date - {sql_list(policy.STATEMENT_GAPS)}[{_draw('statement', len(policy.STATEMENT_GAPS))} + 1]::INT
        AS statement_date FROM n)
SELECT *, statement_date - ({_draw('transaction', 20)} + 1) AS transaction_date,
  notice_date - {_draw('discovery', 5)} AS discovery_date, {_draw('pos', 10_000)} < 3500 AS point_of_sale,
  {_draw('foreign', 10_000)} < 800 AS foreign_initiated, {_draw('credit', 10_000)} < 5500 AS provisional_credit_given
FROM s"""


def dataset_manifest(spark, sf_dir):
    """Row counts and order-free sums of three tables."""
    out = None
    for name in ("orders", "lineitem", "events"):
        s = manifest.table_summary(table(spark, sf_dir, name), name)
        key = {"orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id"}[name]
        value = {"orders": "o_totalprice", "lineitem": "l_extendedprice", "events": "value"}[name]
        part = s.select("name", "rows", F.col(key).alias("key_sum"), F.col(value).alias(
            "value_sum"))
        out = part if out is None else out.unionByName(part)
    return out


def dataset_fingerprint(spark, sf_dir):
    tracked = None
    for name in ("orders", "lineitem", "events", "documents"):
        part = manifest.track_table(table(spark, sf_dir, name), name)
        tracked = part if tracked is None else tracked.unionByName(part)
    return manifest.fingerprint(tracked)


def manifest_verify(spark, sf_dir):
    """A stored manifest against tables of which one changed and one is gone."""
    orders, events = table(spark, sf_dir, "orders"), table(spark, sf_dir, "events")
    parts = table(spark, sf_dir, "part")
    stored = (manifest.track_table(orders, "orders").unionByName(
        manifest.track_table(events, "events")).unionByName(manifest.track_table(parts, "part")))
    changed = events.withColumn("value", F.when(F.col("event_id") == 7, -1.0).otherwise(
        F.col("value")))
    actual = manifest.track_table(orders.repartition(3), "orders").unionByName(
        manifest.track_table(changed, "events"))
    return manifest.verify(stored, actual).select("name", "state")


_COUNTS = """complaint_id, CAST(len(cited) AS INT) AS citations,
  CAST(len(cited) - len(lost) AS INT) AS resolved, CAST(len(lost) AS INT) AS unresolved,
  CAST(len(uncited) AS INT) AS uncited_claims, CAST(len(invented) AS INT) AS invented_dates"""

QUERIES = {
    "letters_verified": (letters_verified, VERIFIED_SQL + f"""
        SELECT {_COUNTS}, passed, attempts, md5(txt) AS letter_md5, priority, queue,
          CAST(7 + 2 * attempts AS INT) AS steps FROM final
        UNION ALL
        SELECT complaint_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
          'manual_review', 3 FROM disputes WHERE key % 31 = 0"""),
    "triage_routing": (triage_routing, VERIFIED_SQL + """
        SELECT regulation, queue, priority, attempts, count(*) AS cases,
          count(*) FILTER (queue = 'manual_review') AS approvals
        FROM (SELECT regulation, queue, priority, attempts FROM final
              UNION ALL SELECT NULL, 'manual_review', NULL, NULL FROM disputes
              WHERE key % 31 = 0) GROUP BY 1, 2, 3, 4"""),
    "workflow_evaluation": (workflow_evaluation, VERIFIED_SQL + """
        SELECT count(*) AS letters, CAST(sum(len(cited)) AS BIGINT) AS citations,
          CAST(sum(len(invented)) AS BIGINT) AS invented_dates,
          CAST(sum(len(uncited)) AS BIGINT) AS uncited_claims,
          count(*) FILTER (queue = 'auto_send') AS auto_send,
          count(*) FILTER (queue = 'manual_review') AS manual_review,
          round(1 - sum(len(lost)) / sum(len(cited)), 6) AS citation_resolution,
          round(avg(passed::INT), 6) AS verification_pass_rate,
          round(avg((passed AND attempts = 1)::INT), 6) AS passed_on_first_attempt,
          round(avg(attempts), 6) AS mean_draft_attempts FROM final"""),
    "required_stages": (required_stages, VERIFIED_SQL + """
        SELECT count(*) FILTER (passed IS NULL OR regulation IS NULL) AS violations,
          (SELECT count(*) FROM disputes) AS cases, CAST(sum(7 + 2 * attempts)
            + 3 * (SELECT count(*) FROM disputes WHERE key % 31 = 0) AS BIGINT) AS steps FROM final"""),
    "deadline_exactness": (deadline_exactness, ALL_ROWS_SQL + f""", {STATED_SQL}
        SELECT name, count(*) AS cases, count(*) FILTER (due = stated) AS exact,
          round(avg((due = stated)::INT), 6) AS exactness,
          CAST(sum(due - DATE '1990-01-01') AS BIGINT) AS due_days FROM stated GROUP BY 1"""),
    "promotion_gates": (promotion_gates, VERIFIED_SQL + f""", {STATED_SQL}, {PRED_SQL}, {AUC_SQL}, {BUDGET_PART},
        m(name, actual) AS (
          SELECT 'deadline_exactness', round(avg((due = stated)::INT), 6) FROM stated
          UNION ALL SELECT 'citation_resolution', round(1 - sum(len(lost)) / sum(len(cited)), 6) FROM final
          UNION ALL SELECT 'issue_macro_f1', round(avg(f1), 6) FROM rep
          UNION ALL SELECT 'escalation_roc_auc', round(roc_auc, 6) FROM auc
          UNION ALL SELECT 'fraud_recall_at_budget', round(caught / positives, 6) FROM bud),
        g(gate, minimum) AS (VALUES {', '.join(
            f"('{g}', {m}::DOUBLE)" for g, m in policy.GATES)})
        SELECT gate, minimum, actual, CASE WHEN actual IS NULL THEN 'skipped'
          WHEN actual >= minimum THEN 'pass' ELSE 'FAIL' END AS status
        FROM g LEFT JOIN m ON name = gate
        UNION ALL
        SELECT 'no_invented_dates', 0, n, 'FAIL'
        FROM (SELECT sum(len(invented))::DOUBLE AS n FROM final) WHERE n > 0"""),
    "letter_failures": (letter_failures, VERIFIED_SQL + """
        SELECT complaint_id, CAST(len(lost) AS INT) AS unresolved FROM final WHERE NOT passed
        ORDER BY complaint_id LIMIT 5"""),
    "difficulty_scores": (difficulty_scores, DIFFICULTY_SQL + f"""
        SELECT complaint_id, round(difficulty, 6) AS difficulty,
          {', '.join(f'round({p}::DOUBLE, 6) AS {p}' for p in policy.DIFFICULTY_WEIGHTS)}
        FROM scored"""),
    "chat_examples": (chat_examples, DIFFICULTY_SQL + """
        SELECT complaint_id AS example_id, 'system,user,assistant' AS roles,
          md5(txt) AS answer_md5, issue, strftime(notice_date, '%Y-%m-%d') AS notice_date,
          regulation, round(round(difficulty, 4), 4) AS difficulty
        FROM scored WHERE len(problems) = 0"""),
    "derived_dates": (derived_dates, DERIVED_SQL),
    "dataset_manifest": (dataset_manifest, """
        SELECT 'orders' AS name, count(*) AS rows, round(sum(o_orderkey)::DOUBLE, 2) AS key_sum,
          round(sum(o_totalprice), 2) AS value_sum FROM orders
        UNION ALL SELECT 'lineitem', count(*), round(sum(l_orderkey)::DOUBLE, 2),
          round(sum(l_extendedprice), 2) FROM lineitem
        UNION ALL SELECT 'events', count(*), round(sum(event_id)::DOUBLE, 2),
          round(sum(value), 2) FROM events"""),
    "dataset_fingerprint": (dataset_fingerprint, None),
    "manifest_verify": (manifest_verify, """
        SELECT 'orders' AS name, 'clean' AS state UNION ALL SELECT 'events', 'changed'
        UNION ALL SELECT 'part', 'missing'"""),
}
