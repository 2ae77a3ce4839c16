"""Shared inputs of the registered queries, in Spark and in SQL.

The dispute feed is derived from ``orders`` by arithmetic on the order key, so
both engines see the same rows and the work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from remedia import policy
from remedia.session import spread

ISSUES = policy.KNOWN_ISSUES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def sql_str(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def disputes(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """One dispute per order, with every date and flag the rules read."""
    k = F.col("o_orderkey")
    day = F.col("_day")
    notice = F.date_add(day, (k % 75).cast("int"))
    if orders is None:
        orders = spread(table(spark, sf_dir, "orders"))
    return (
        orders
        .withColumn("_day", F.col("o_orderdate").cast("date"))
        .select(
            F.concat(F.lit("C"), k.cast("string")).alias("complaint_id"),
            k.alias("key"),
            pick(ISSUES, k).alias("issue"),
            F.date_sub(day, (k % 30).cast("int")).alias("transaction_date"),
            day.alias("statement_date"),
            notice.alias("notice_date"),
            F.when(k % 5 == 0, F.date_sub(notice, (k % 50).cast("int"))).alias("account_opened"),
            F.date_sub(notice, (k % 9).cast("int")).alias("discovery_date"),
            F.when(k % 6 != 0, notice).alias("first_contact_date"),
            F.when(k % 3 != 1, F.date_add(notice, (k % 45).cast("int")))
            .alias("written_dispute_date"),
            (k % 3 == 0).alias("point_of_sale"),
            (k % 7 == 0).alias("foreign_initiated"),
            (k % 2 == 0).alias("provisional_credit_given"),
            (k % 11 != 0).alias("access_device"),
            (k % 4 == 1).alias("additional_information_provided"),
            (k % 30 + 25).cast("int").alias("billing_cycle_days"),
            F.col("o_totalprice").alias("disputed_amount"),
            (k % 4 == 0).alias("consumer_disputed"),
            pick(policy.RESPONSE_CATEGORIES, k).alias("company_response"),
            F.col("o_orderpriority").alias("priority_class"),
            F.col("o_orderstatus").alias("status"),
        ))


DISPUTES_SQL = f"""disputes AS (
  SELECT 'C' || o_orderkey AS complaint_id, o_orderkey AS key,
    {sql_list(ISSUES)}[CAST(o_orderkey % {len(ISSUES)} AS INT) + 1] AS issue,
    d - CAST(o_orderkey % 30 AS INT) AS transaction_date, d AS statement_date,
    n AS notice_date,
    CASE WHEN o_orderkey % 5 = 0 THEN n - CAST(o_orderkey % 50 AS INT) END AS account_opened,
    n - CAST(o_orderkey % 9 AS INT) AS discovery_date,
    CASE WHEN o_orderkey % 6 <> 0 THEN n END AS first_contact_date,
    CASE WHEN o_orderkey % 3 <> 1 THEN n + CAST(o_orderkey % 45 AS INT) END
      AS written_dispute_date,
    o_orderkey % 3 = 0 AS point_of_sale, o_orderkey % 7 = 0 AS foreign_initiated,
    o_orderkey % 2 = 0 AS provisional_credit_given, o_orderkey % 11 <> 0 AS access_device,
    o_orderkey % 4 = 1 AS additional_information_provided,
    CAST(o_orderkey % 30 + 25 AS INT) AS billing_cycle_days,
    o_totalprice AS disputed_amount, o_orderkey % 4 = 0 AS consumer_disputed,
    {sql_list(policy.RESPONSE_CATEGORIES)}[CAST(o_orderkey % 5 AS INT) + 1] AS company_response,
    o_orderpriority AS priority_class, o_orderstatus AS status
  FROM (SELECT *, CAST(o_orderdate AS DATE) AS d,
          CAST(o_orderdate AS DATE) + CAST(o_orderkey % 75 AS INT) AS n FROM orders))"""

REGULATION_SQL = "CASE " + " ".join(
    f"WHEN issue IN ({', '.join(sql_str(i) for i in issues)}) THEN '{reg}'"
    for reg, issues in policy.ISSUES_BY_REGULATION.items()) + " ELSE 'REG_E' END"

# holidays listed year by year, then days numbered: a different route from the
# predicate the Spark calendar uses
CALENDAR_SQL = """years AS (SELECT CAST(y AS INT) AS y FROM range(1990, 2062) t(y)),
fixed AS (
  SELECT make_date(y, m, d) AS h
  FROM years, (VALUES (1, 1, 0), (6, 19, 2021), (7, 4, 0), (11, 11, 0), (12, 25, 0)) f(m, d, s)
  WHERE y >= s),
holidays AS (
  SELECT CASE isodow(h) WHEN 6 THEN h - 1 WHEN 7 THEN h + 1 ELSE h END AS h FROM fixed
  UNION
  SELECT first_day + CAST((wd - isodow(first_day) + 7) % 7 + 7 * (nth - 1) AS INT)
  FROM (SELECT make_date(y, m, 1) AS first_day, wd, nth
        FROM years, (VALUES (1, 1, 3), (2, 1, 3), (9, 1, 1), (10, 1, 2), (11, 4, 4)) f(m, wd, nth))
  UNION
  SELECT make_date(y, 5, 31) - CAST((isodow(make_date(y, 5, 31)) + 6) % 7 AS INT) FROM years),
days AS (
  SELECT CAST(DATE '1990-01-01' + CAST(i AS INT) AS DATE) AS day FROM range(0, 25933) t(i)),
cal AS (
  SELECT day, is_holiday, is_bd,
    CAST(sum(CASE WHEN is_bd THEN 1 ELSE 0 END) OVER (ORDER BY day) AS INT) AS idx
  FROM (SELECT day, day IN (SELECT h FROM holidays) AS is_holiday,
          isodow(day) < 6 AND day NOT IN (SELECT h FROM holidays) AS is_bd FROM days)),
bd AS (SELECT idx, day FROM cal WHERE is_bd)"""
