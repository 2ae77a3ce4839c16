"""Queries over the calendar and the deadline rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from remedia.catalog.base import CALENDAR_SQL, DISPUTES_SQL, REGULATION_SQL, disputes, table
from remedia.operators import calendar as cal
from remedia.operators.deadlines import (
    compute_deadlines,
    explode_deadlines,
    regulation_for_issue,
)


def business_calendar(spark, sf_dir):
    """Orders per calendar day, with the day's place in the business calendar."""
    per_day = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderdate").cast("date").alias("day"))
        .agg(F.count(F.lit(1)).alias("orders")))
    return per_day.select("day", *cal.place(F.col("day"), "1990-01-01"), "orders")


def add_business_days(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("start"),
        (F.col("o_orderkey") % 121 - 60).cast("int").alias("n"))
    return cal.add_business_days(df, "start", "n", "due").select(
        "o_orderkey", "start", "n", "due")


def next_business_day(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return cal.next_business_day(df, "day", "next_day").select("o_orderkey", "day", "next_day")


def business_days_between(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("ordered"))
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("shipped"))
    joined = lines.join(orders, "l_orderkey")
    return cal.business_days_between(joined, "ordered", "shipped", "business_days").select(
        "l_orderkey", "l_linenumber", "ordered", "shipped", "business_days")


def _long(spark, sf_dir, regulation):
    df = disputes(spark, sf_dir).withColumn("regulation", F.lit(regulation))
    rows = explode_deadlines(compute_deadlines(df, liability=None), ["complaint_id"])
    return rows.drop("regulation")


def reg_e_deadlines(spark, sf_dir):
    return _long(spark, sf_dir, "REG_E")


def reg_z_deadlines(spark, sf_dir):
    return _long(spark, sf_dir, "REG_Z")


def fcra_deadlines(spark, sf_dir):
    return _long(spark, sf_dir, "FCRA")


def fdcpa_deadlines(spark, sf_dir):
    return _long(spark, sf_dir, "FDCPA")


def reg_e_liability(spark, sf_dir):
    """Liability of each transaction: discovery is the ship date of the order line."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("key"), "l_linenumber",
        F.col("l_shipdate").cast("date").alias("discovery_date"))
    df = (
        disputes(spark, sf_dir).drop("discovery_date").join(lines, "key")
        .withColumn("regulation", F.lit("REG_E")))
    out = compute_deadlines(df, out="_deadlines")
    return out.select("key", "l_linenumber", "discovery_date", "notice_date", "liability.tier",
                      "liability.liability_cap_usd",
                      F.col("liability.business_days_from_discovery_to_notice").alias("bd_days"),
                      F.col("liability.calendar_days_from_statement_to_notice").alias("cal_days"),
                      "liability.citation")


def _by_issue(spark, sf_dir):
    df = disputes(spark, sf_dir).withColumn("regulation", regulation_for_issue(F.col("issue")))
    return compute_deadlines(df)


def deadline_rows_by_regulation(spark, sf_dir):
    """The flagship query: every deadline of every dispute, under its own regulation."""
    return explode_deadlines(_by_issue(spark, sf_dir), ["complaint_id", "issue"])


def deadline_findings(spark, sf_dir):
    return _by_issue(spark, sf_dir).select(
        "complaint_id", "deadlines.regulation",
        F.col("deadlines.consumer_notice_timely").alias("timely"),
        F.size("deadlines.deadlines").cast("long").alias("deadlines"),
        F.concat_ws("|", "deadlines.findings").alias("findings"),
        F.concat_ws(",", "deadlines.citations").alias("citations"))


def deadline_outlook(spark, sf_dir):
    """Deadlines falling due per regulation, deadline and month."""
    return (
        deadline_rows_by_regulation(spark, sf_dir)
        .groupBy("regulation", "name", F.date_format("due", "yyyy-MM").alias("month"))
        .agg(F.count(F.lit(1)).alias("due_count")))


REG_E_FACTS = """facts AS (
  SELECT *, coalesce(notice_date - account_opened BETWEEN 0 AND 30, FALSE) AS is_new,
    statement_date + 60 AS window_end
  FROM disputes),
reg_e AS (
  SELECT f.*, CASE WHEN is_new THEN 20 ELSE 10 END AS first_days,
    CASE WHEN is_new OR point_of_sale OR foreign_initiated THEN 90 ELSE 45 END AS long_days,
    c.idx AS nidx
  FROM facts f JOIN cal c ON c.day = f.notice_date),
reg_e2 AS (
  SELECT r.*, b.day AS first_due,
    CASE WHEN provisional_credit_given THEN notice_date + long_days ELSE b.day END AS concluded
  FROM reg_e r JOIN bd b ON b.idx = r.nidx + first_days),
reg_e3 AS (
  SELECT r.*, c.idx AS cidx FROM reg_e2 r JOIN cal c ON c.day = r.concluded)"""

REG_E_ROWS = """
  SELECT complaint_id, issue, 'consumer notice deadline (missed)' AS name, window_end AS due,
    '60 calendar days' AS basis, '1005.11(b)' AS citation, '' AS note
  FROM reg_e3 WHERE notice_date > window_end
  UNION ALL
  SELECT complaint_id, issue, 'consumer notice deadline', window_end, '60 calendar days',
    '1005.11(b)', 'notice received ' || (window_end - notice_date) || ' day(s) inside the window'
  FROM reg_e3 WHERE notice_date <= window_end
  UNION ALL
  SELECT complaint_id, issue, 'investigation concluded, or provisional credit given', first_due,
    first_days || ' business days',
    CASE WHEN is_new THEN '1005.11(c)(3)' ELSE '1005.11(c)(1)' END, ''
  FROM reg_e3 WHERE notice_date <= window_end
  UNION ALL
  SELECT complaint_id, issue, 'extended investigation deadline', notice_date + long_days,
    long_days || ' calendar days',
    CASE WHEN long_days = 90 THEN '1005.11(c)(3)' ELSE '1005.11(c)(2)' END,
    'available because provisional credit was given' ||
      CASE WHEN is_new THEN '; 90-day period applies (new account)'
           WHEN point_of_sale THEN '; 90-day period applies (point-of-sale transfer)'
           WHEN foreign_initiated
             THEN '; 90-day period applies (transfer initiated outside the United States)'
           ELSE '' END
  FROM reg_e3 WHERE notice_date <= window_end AND provisional_credit_given
  UNION ALL
  SELECT complaint_id, issue, 'notify consumer of the provisional credit', b.day,
    '2 business days', '1005.11(c)(2)', ''
  FROM reg_e3 JOIN bd b ON b.idx = nidx + 2
  WHERE notice_date <= window_end AND provisional_credit_given
  UNION ALL
  SELECT complaint_id, issue, 'report results to the consumer', b.day, '3 business days',
    '1005.11(d)', 'measured from the date the investigation concludes'
  FROM reg_e3 JOIN bd b ON b.idx = cidx + 3 WHERE notice_date <= window_end
  UNION ALL
  SELECT complaint_id, issue, 'correct the error if one occurred', b.day, '1 business days',
    '1005.11(c)(1)', ''
  FROM reg_e3 JOIN bd b ON b.idx = cidx + 1 WHERE notice_date <= window_end"""

REG_Z_ROWS = """
  SELECT complaint_id, issue, 'billing error notice deadline' AS name,
    statement_date + 60 AS due, '60 calendar days' AS basis, '1026.13(b)' AS citation, '' AS note
  FROM disputes
  UNION ALL
  SELECT complaint_id, issue, 'written acknowledgement to the consumer', notice_date + 30,
    '30 calendar days', '1026.13(c)(1)',
    'not required if the dispute is fully resolved within the same 30 days'
  FROM disputes WHERE notice_date <= statement_date + 60
  UNION ALL
  SELECT complaint_id, issue, 'resolution complete',
    notice_date + least(2 * billing_cycle_days, 90),
    least(2 * billing_cycle_days, 90) || ' calendar days', '1026.13(c)(2)',
    CASE WHEN 2 * billing_cycle_days <= 90 THEN 'two complete billing cycles'
         ELSE 'the 90-day cap binds before two cycles elapse' END
  FROM disputes WHERE notice_date <= statement_date + 60"""

FCRA_ROWS = """
  SELECT complaint_id, issue, 'reinvestigation complete' AS name,
    notice_date + (CASE WHEN additional_information_provided THEN 45 ELSE 30 END) AS due,
    (CASE WHEN additional_information_provided THEN 45 ELSE 30 END) || ' calendar days' AS basis,
    '1681i(a)(1)' AS citation,
    CASE WHEN additional_information_provided THEN 'extended to 45 days because the consumer '
      || 'supplied further relevant information' ELSE '' END AS note
  FROM disputes
  UNION ALL
  SELECT complaint_id, issue, 'notify the consumer of any reinsertion',
    notice_date + (CASE WHEN additional_information_provided THEN 45 ELSE 30 END),
    '5 business days', '1681i(a)(5)',
    'five business days after any reinsertion of deleted information'
  FROM disputes"""

FDCPA_ROWS = """
  SELECT complaint_id, issue, 'validation notice sent' AS name,
    coalesce(first_contact_date, notice_date) + 5 AS due, '5 calendar days' AS basis,
    '1692g(a)' AS citation, '' AS note
  FROM disputes
  UNION ALL
  SELECT complaint_id, issue, 'consumer dispute window closes',
    coalesce(first_contact_date, notice_date) + 30, '30 calendar days', '1692g(a)', ''
  FROM disputes"""

ALL_ROWS_SQL = f"""
WITH {CALENDAR_SQL}, {DISPUTES_SQL}, {REG_E_FACTS},
all_rows AS (
  SELECT 'REG_E' AS regulation, * FROM ({REG_E_ROWS})
  UNION ALL SELECT 'REG_Z', * FROM ({REG_Z_ROWS})
  UNION ALL SELECT 'FCRA', * FROM ({FCRA_ROWS})
  UNION ALL SELECT 'FDCPA', * FROM ({FDCPA_ROWS})),
deadline_rows AS (SELECT * FROM all_rows WHERE regulation = {REGULATION_SQL})"""

FINDINGS_SQL = f"""
WITH {CALENDAR_SQL}, {DISPUTES_SQL}, {REG_E_FACTS},
base AS (
  SELECT *, {REGULATION_SQL} AS regulation,
    coalesce(first_contact_date, notice_date) AS contact FROM reg_e3)
SELECT complaint_id, regulation,
  CASE WHEN regulation IN ('REG_E', 'REG_Z') THEN notice_date <= window_end
       WHEN regulation = 'FCRA' THEN TRUE
       ELSE coalesce(written_dispute_date - contact <= 30, TRUE) END AS timely,
  CAST(CASE regulation
    WHEN 'REG_E' THEN CASE WHEN notice_date > window_end THEN 1
                           WHEN provisional_credit_given THEN 6 ELSE 4 END
    WHEN 'REG_Z' THEN CASE WHEN notice_date > window_end THEN 1 ELSE 3 END
    ELSE 2 END AS BIGINT) AS deadlines,
  CASE regulation
    WHEN 'REG_E' THEN CASE
      WHEN notice_date > window_end THEN 'Consumer notice arrived ' || (notice_date - window_end)
        || ' day(s) after the 60-day window that closed on ' || strftime(window_end, '%Y-%m-%d')
        || '; the error resolution obligations under 1005.11 are not triggered, though the '
        || 'institution may still investigate voluntarily.'
      ELSE concat_ws('|',
        CASE WHEN is_new THEN 'The transfer occurred within 30 days of the first deposit, so the '
          || 'new-account periods apply.' END,
        CASE WHEN NOT provisional_credit_given THEN 'No provisional credit recorded, so the '
          || 'extension to ' || long_days || ' days is not available and the investigation must '
          || 'conclude within ' || first_days || ' business days, by '
          || strftime(first_due, '%Y-%m-%d') || '.' END) END
    WHEN 'REG_Z' THEN CASE
      WHEN notice_date > window_end THEN 'The billing error notice arrived after the 60-day '
        || 'window closed on ' || strftime(window_end, '%Y-%m-%d')
        || ', so the 1026.13 resolution procedures are not triggered.'
      ELSE 'The creditor may not attempt to collect the disputed amount, report it as '
        || 'delinquent, or close the account solely because the consumer asserted billing error '
        || 'rights, until the dispute is resolved.' END
    WHEN 'FCRA' THEN 'The furnisher must complete its own investigation within the same window '
        || 'and report corrections to every agency it supplied.'
    ELSE CASE
      WHEN written_dispute_date IS NULL THEN ''
      WHEN written_dispute_date - contact <= 30 THEN 'A written dispute was received on '
        || strftime(written_dispute_date, '%Y-%m-%d') || ', within the 30-day window. Collection '
        || 'must cease until verification of the debt is obtained and mailed to the consumer.'
      ELSE 'The written dispute was received on ' || strftime(written_dispute_date, '%Y-%m-%d')
        || ', after the 30-day validation window. The cessation requirement is not triggered, '
        || 'though the collector remains bound by the prohibitions on false representations and '
        || 'harassment.' END
    END AS findings,
  CASE regulation
    WHEN 'REG_E' THEN CASE
      WHEN notice_date > window_end THEN '1005.11(b)'
      ELSE '1005.11(b),1005.11(c)(1)'
        || CASE WHEN provisional_credit_given AND long_days = 45 THEN ',1005.11(c)(2)' ELSE '' END
        || CASE WHEN is_new OR (provisional_credit_given AND long_days = 90)
             THEN ',1005.11(c)(3)' ELSE '' END
        || ',1005.11(d)' END
    WHEN 'REG_Z' THEN CASE WHEN notice_date > window_end THEN '1026.13(b)'
      ELSE '1026.13(b),1026.13(c)(1),1026.13(c)(2),1026.13(d)' END
    WHEN 'FCRA' THEN '1681i(a)(1),1681i(a)(5),1681s-2(b)'
    ELSE CASE WHEN written_dispute_date IS NULL THEN '1692g(a)'
              WHEN written_dispute_date - contact <= 30 THEN '1692g(a),1692g(b)'
              ELSE '1692d,1692e,1692g(a)' END
    END AS citations
FROM base"""

_ONE = "SELECT complaint_id, name, due, basis, citation, note FROM"

QUERIES = {
    "deadline_rows_by_regulation": (
        deadline_rows_by_regulation,
        ALL_ROWS_SQL + """ SELECT complaint_id, issue, regulation, name, due, basis, citation, note
        FROM deadline_rows"""),
    "deadline_findings": (deadline_findings, FINDINGS_SQL),
    "deadline_outlook": (
        deadline_outlook,
        ALL_ROWS_SQL + """ SELECT regulation, name, strftime(due, '%Y-%m') AS month,
        count(*) AS due_count FROM deadline_rows GROUP BY ALL"""),
    "business_calendar": (business_calendar, f"""
        WITH {CALENDAR_SQL}
        SELECT day, is_holiday, is_bd AS is_business_day, idx, orders
        FROM cal JOIN (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS orders
                       FROM orders GROUP BY 1) USING (day)"""),
    "add_business_days": (add_business_days, f"""
        WITH {CALENDAR_SQL},
        o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS start,
                CAST(o_orderkey % 121 - 60 AS INT) AS n FROM orders),
        p AS (SELECT o.*, idx, is_bd FROM o JOIN cal ON day = start)
        SELECT o_orderkey, start, n, CASE WHEN n = 0 THEN start ELSE b.day END AS due
        FROM p LEFT JOIN bd b ON b.idx = CASE
          WHEN n > 0 THEN p.idx + n
          ELSE p.idx - CASE WHEN is_bd THEN 1 ELSE 0 END + n + 1 END"""),
    "next_business_day": (next_business_day, f"""
        WITH {CALENDAR_SQL}
        SELECT o_orderkey, c.day, b.day AS next_day
        FROM orders JOIN cal c ON c.day = CAST(o_orderdate AS DATE)
        JOIN bd b ON b.idx = c.idx + 1"""),
    "business_days_between": (business_days_between, f"""
        WITH {CALENDAR_SQL}
        SELECT l_orderkey, l_linenumber, a.day AS ordered, b.day AS shipped,
          b.idx - a.idx AS business_days
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey
        JOIN cal a ON a.day = CAST(o_orderdate AS DATE)
        JOIN cal b ON b.day = CAST(l_shipdate AS DATE)"""),
    "reg_e_deadlines": (
        reg_e_deadlines,
        f"WITH {CALENDAR_SQL}, {DISPUTES_SQL}, {REG_E_FACTS} {_ONE} ({REG_E_ROWS})"),
    "reg_z_deadlines": (reg_z_deadlines, f"WITH {DISPUTES_SQL} {_ONE} ({REG_Z_ROWS})"),
    "fcra_deadlines": (fcra_deadlines, f"WITH {DISPUTES_SQL} {_ONE} ({FCRA_ROWS})"),
    "fdcpa_deadlines": (fdcpa_deadlines, f"WITH {DISPUTES_SQL} {_ONE} ({FDCPA_ROWS})"),
    "reg_e_liability": (reg_e_liability, f"""
        WITH {CALENDAR_SQL}, {DISPUTES_SQL},
        x AS (
          SELECT key, l_linenumber, CAST(l_shipdate AS DATE) AS discovery_date, notice_date,
            access_device, n.idx - s.idx AS bd_days,
            CAST(notice_date - statement_date AS INT) AS cal_days
          FROM disputes JOIN lineitem ON l_orderkey = key
          JOIN cal n ON n.day = notice_date JOIN cal s ON s.day = CAST(l_shipdate AS DATE))
        SELECT key, l_linenumber, discovery_date, notice_date, bd_days, cal_days,
          CASE WHEN NOT access_device AND cal_days <= 60
                 THEN 'no liability for transfers reported within 60 days'
               WHEN NOT access_device THEN 'unlimited for transfers after the 60-day window'
               WHEN bd_days <= 2 THEN 'tier 1' WHEN cal_days <= 60 THEN 'tier 2'
               ELSE 'tier 3' END AS tier,
          CAST(CASE WHEN NOT access_device AND cal_days <= 60 THEN 0
               WHEN NOT access_device THEN NULL WHEN bd_days <= 2 THEN 50
               WHEN cal_days <= 60 THEN 500 END AS DOUBLE) AS liability_cap_usd,
          CASE WHEN access_device THEN '1005.6(b)' ELSE '1005.6(b)(3)' END AS citation
        FROM x"""),
}
