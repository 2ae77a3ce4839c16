"""Regulatory deadlines for whole tables of disputes.

Each regulation is a builder of one struct Column from date and flag Columns.
Business-day due dates come from two broadcast look-ups (the notice date and the
date the investigation concludes); calendar-day ones are plain ``date_add``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remedia import policy
from remedia.functions.dates import iso, parse_day
from remedia.functions.dates import business_index
from remedia.operators.calendar import look_ahead, nth_ahead
from remedia.session import once, unnest

DEADLINE = "struct<name:string,due:date,basis:string,citation:string,note:string>"
RESULT = (
    "struct<regulation:string,consumer_notice_timely:boolean,"
    f"deadlines:array<{DEADLINE}>,findings:array<string>,citations:array<string>,error:string>")
LIABILITY = (
    "struct<tier:string,liability_cap_usd:double,business_days_from_discovery_to_notice:int,"
    "calendar_days_from_statement_to_notice:int,citation:string,note:string>")

NOTICE_WINDOW = 60


def regulation_for_issue(issue: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in policy.REGULATION_OF_ISSUE.items() for x in kv])
    return F.coalesce(F.try_element_at(table, issue), F.lit(policy.DEFAULT_REGULATION))


def _lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _deadline(name, due: Column, count, unit: str, citation, note="") -> Column:
    return F.struct(
        _lit(name).alias("name"),
        due.alias("due"),
        F.concat(_lit(count).cast("string"), F.lit(f" {unit}")).alias("basis"),
        _lit(citation).alias("citation"),
        _lit(note).alias("note"),
    ).cast(DEADLINE)


def _present(*items: Column) -> Column:
    """The items in order, without the NULL ones."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def _result(regulation, timely, deadlines, findings, citations, error=None) -> Column:
    return F.struct(
        _lit(regulation).alias("regulation"),
        _lit(timely).alias("consumer_notice_timely"),
        deadlines.alias("deadlines"),
        findings.alias("findings"),
        F.array_sort(F.array_distinct(citations)).alias("citations"),
        _lit(error).cast("string").alias("error"),
    ).cast(RESULT)


def _days(end: Column, start: Column) -> Column:
    return F.datediff(end, start)


def reg_e_new_account(notice: Column, opened: Column) -> Column:
    return F.coalesce(_days(notice, opened).between(0, 30), F.lit(False))


def reg_e_extended_days(new: Column, pos: Column, foreign: Column) -> Column:
    return F.when(new | pos | foreign, F.lit(90)).otherwise(F.lit(45))


def regulation_e(
    notice: Column, statement: Column, opened: Column, pos: Column, foreign: Column,
    credit: Column, initial_due: Column, credit_due: Column, report_due: Column, correct_due: Column,
) -> Column:
    """Error resolution timing. Its business-day due dates come computed."""
    window_end = F.date_add(statement, NOTICE_WINDOW)
    timely = notice <= window_end
    new = reg_e_new_account(notice, opened)
    initial_days = F.when(new, F.lit(20)).otherwise(F.lit(10))
    initial_cite = F.when(new, F.lit("1005.11(c)(3)")).otherwise(F.lit("1005.11(c)(1)"))
    extended_days = reg_e_extended_days(new, pos, foreign)
    extended_cite = F.when(
        extended_days == 90, F.lit("1005.11(c)(3)")).otherwise(F.lit("1005.11(c)(2)"))
    why = (
        F.when(new, F.lit("; 90-day period applies (new account)"))
        .when(pos, F.lit("; 90-day period applies (point-of-sale transfer)"))
        .when(foreign,
              F.lit("; 90-day period applies (transfer initiated outside the United States)"))
        .otherwise(F.lit("")))

    late = _result(
        "REG_E", False,
        F.array(_deadline(
            "consumer notice deadline (missed)", window_end, NOTICE_WINDOW, "calendar days",
            "1005.11(b)")),
        F.array(F.concat(
            F.lit("Consumer notice arrived "), _days(notice, window_end).cast("string"),
            F.lit(" day(s) after the 60-day window that closed on "), iso(window_end),
            F.lit("; the error resolution obligations under 1005.11 are not triggered, though "
                  "the institution may still investigate voluntarily."))),
        F.array(F.lit("1005.11(b)")))

    deadlines = _present(
        _deadline(
            "consumer notice deadline", window_end, NOTICE_WINDOW, "calendar days", "1005.11(b)",
            F.concat(F.lit("notice received "), _days(window_end, notice).cast("string"),
                     F.lit(" day(s) inside the window"))),
        _deadline("investigation concluded, or provisional credit given", initial_due,
                  initial_days, "business days", initial_cite),
        F.when(credit, _deadline(
            "extended investigation deadline", F.date_add(notice, extended_days), extended_days,
            "calendar days", extended_cite,
            F.concat(F.lit("available because provisional credit was given"), why))),
        F.when(credit, _deadline(
            "notify consumer of the provisional credit", credit_due, 2,
            "business days", "1005.11(c)(2)")),
        _deadline("report results to the consumer", report_due, 3,
                  "business days", "1005.11(d)",
                  "measured from the date the investigation concludes"),
        _deadline("correct the error if one occurred", correct_due, 1,
                  "business days", "1005.11(c)(1)"))
    findings = _present(
        F.when(new, F.lit("The transfer occurred within 30 days of the first deposit, so the "
                          "new-account periods apply.")),
        F.when(~credit, F.concat(
            F.lit("No provisional credit recorded, so the extension to "),
            extended_days.cast("string"),
            F.lit(" days is not available and the investigation must conclude within "),
            initial_days.cast("string"), F.lit(" business days, by "), iso(initial_due),
            F.lit("."))))
    citations = _present(
        F.lit("1005.11(b)"), initial_cite, F.when(credit, extended_cite),
        F.lit("1005.11(d)"), F.lit("1005.11(c)(1)"))
    return F.when(timely, _result("REG_E", True, deadlines, findings, citations)).otherwise(late)


def regulation_e_liability(
    discovery_to_notice: Column, statement_to_notice: Column, access_device: Column,
) -> Column:
    """Liability tier from two clocks: business days since discovery, calendar days since
    the statement. A NULL cap means the liability is not capped."""
    in_window = statement_to_notice <= NOTICE_WINDOW

    def tier(name: str, cap: float | None, citation: str) -> Column:
        return F.struct(
            F.lit(name).alias("tier"), F.lit(cap).cast("double").alias("liability_cap_usd"),
            discovery_to_notice.cast("int").alias("business_days_from_discovery_to_notice"),
            statement_to_notice.cast("int").alias("calendar_days_from_statement_to_notice"),
            F.lit(citation).alias("citation"),
            F.lit(policy.LIABILITY_NOTE).alias("note")).cast(LIABILITY)

    return (
        F.when(~access_device & in_window,
               tier("no liability for transfers reported within 60 days", 0.0, "1005.6(b)(3)"))
        .when(~access_device,
              tier("unlimited for transfers after the 60-day window", None, "1005.6(b)(3)"))
        .when(discovery_to_notice <= 2, tier("tier 1", 50.0, "1005.6(b)"))
        .when(in_window, tier("tier 2", 500.0, "1005.6(b)"))
        .otherwise(tier("tier 3", None, "1005.6(b)")))


def regulation_z(notice: Column, statement: Column, cycle_days: Column) -> Column:
    """Billing error resolution timing; two cycles, but never more than 90 days."""
    window_end = F.date_add(statement, NOTICE_WINDOW)
    timely = notice <= window_end
    notice_deadline = _deadline("billing error notice deadline", window_end, NOTICE_WINDOW,
                                "calendar days", "1026.13(b)")
    late = _result(
        "REG_Z", False, F.array(notice_deadline),
        F.array(F.concat(
            F.lit("The billing error notice arrived after the 60-day window closed on "),
            iso(window_end),
            F.lit(", so the 1026.13 resolution procedures are not triggered."))),
        F.array(F.lit("1026.13(b)")))
    span = F.least(F.lit(2) * cycle_days, F.lit(90))
    on_time = _result(
        "REG_Z", True,
        F.array(
            notice_deadline,
            _deadline("written acknowledgement to the consumer", F.date_add(notice, 30), 30,
                      "calendar days", "1026.13(c)(1)",
                      "not required if the dispute is fully resolved within the same 30 days"),
            _deadline("resolution complete", F.date_add(notice, span), span, "calendar days",
                      "1026.13(c)(2)",
                      F.when(2 * cycle_days <= 90, F.lit("two complete billing cycles"))
                      .otherwise(F.lit("the 90-day cap binds before two cycles elapse")))),
        F.array(F.lit(
            "The creditor may not attempt to collect the disputed amount, report it as "
            "delinquent, or close the account solely because the consumer asserted billing error "
            "rights, until the dispute is resolved.")),
        F.array(*[F.lit(c) for c in
                  ("1026.13(b)", "1026.13(c)(1)", "1026.13(c)(2)", "1026.13(d)")]))
    return F.when(timely, on_time).otherwise(late)


def fcra(dispute: Column, more_information: Column) -> Column:
    days = F.when(more_information, F.lit(45)).otherwise(F.lit(30))
    due = F.date_add(dispute, days)
    return _result(
        "FCRA", True,
        F.array(
            _deadline("reinvestigation complete", due, days, "calendar days", "1681i(a)(1)",
                      F.when(more_information, F.lit(
                          "extended to 45 days because the consumer supplied further relevant "
                          "information")).otherwise(F.lit(""))),
            _deadline("notify the consumer of any reinsertion", due, 5, "business days",
                      "1681i(a)(5)",
                      "five business days after any reinsertion of deleted information")),
        F.array(F.lit(
            "The furnisher must complete its own investigation within the same window and report "
            "corrections to every agency it supplied.")),
        F.array(*[F.lit(c) for c in ("1681i(a)(1)", "1681i(a)(5)", "1681s-2(b)")]))


def fdcpa(first_contact: Column, written: Column) -> Column:
    within = _days(written, first_contact) <= 30
    return _result(
        "FDCPA", F.coalesce(within, F.lit(True)),
        F.array(
            _deadline("validation notice sent", F.date_add(first_contact, 5), 5,
                      "calendar days", "1692g(a)"),
            _deadline("consumer dispute window closes", F.date_add(first_contact, 30), 30,
                      "calendar days", "1692g(a)")),
        _present(
            F.when(within, F.concat(
                F.lit("A written dispute was received on "), iso(written),
                F.lit(", within the 30-day window. Collection must cease until verification of "
                      "the debt is obtained and mailed to the consumer."))),
            F.when(~within, F.concat(
                F.lit("The written dispute was received on "), iso(written),
                F.lit(", after the 30-day validation window. The cessation requirement is not "
                      "triggered, though the collector remains bound by the prohibitions on "
                      "false representations and harassment.")))),
        _present(
            F.lit("1692g(a)"), F.when(within, F.lit("1692g(b)")),
            F.when(~within, F.lit("1692e")), F.when(~within, F.lit("1692d"))))


# columns of a dispute that the rules read, with the value used where one is absent
DISPUTE_DEFAULTS = {
    "account_opened": ("string", None),
    "discovery_date": ("string", None),
    "first_contact_date": ("string", None),
    "written_dispute_date": ("string", None),
    "point_of_sale": ("boolean", False),
    "foreign_initiated": ("boolean", False),
    "provisional_credit_given": ("boolean", False),
    "additional_information_provided": ("boolean", False),
    "access_device": ("boolean", True),
    "billing_cycle_days": ("int", 30),
}


def _field(df: DataFrame, name: str) -> Column:
    kind, default = DISPUTE_DEFAULTS[name]
    if name not in df.columns:
        return F.lit(default).cast(kind)
    value = F.col(name).cast(kind)
    return value if default is None else F.coalesce(value, F.lit(default).cast(kind))


def _as_day(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("date")
    return F.col(name) if dict(df.dtypes)[name] == "date" else parse_day(F.col(name))


def compute_deadlines(
    df: DataFrame, regulation: str = "regulation",
    out: str = "deadlines", liability: str | None = "liability",
) -> DataFrame:
    """Add the deadline struct (and the liability struct of REG_E rows) to every dispute.

    A missing date a regulation needs gives an empty result with ``error``; an
    unknown regulation takes the FDCPA branch.
    """
    flags = {n: _field(df, n) for n in DISPUTE_DEFAULTS if not n.endswith(("_date", "opened"))}
    keep = df.columns
    work = df.select(
        "*",
        _as_day(df, "notice_date").alias("_notice"),
        _as_day(df, "statement_date").alias("_statement"),
        _as_day(df, "account_opened").alias("_opened"),
        _as_day(df, "discovery_date").alias("_discovery"),
        _as_day(df, "first_contact_date").alias("_first_contact"),
        _as_day(df, "written_dispute_date").alias("_written"),
        *[c.alias(f"_{n}") for n, c in flags.items()])
    notice, statement, opened = F.col("_notice"), F.col("_statement"), F.col("_opened")
    pos, foreign = F.col("_point_of_sale"), F.col("_foreign_initiated")
    credit = F.col("_provisional_credit_given")
    new = reg_e_new_account(notice, opened)

    work = look_ahead(work, notice, "notice")
    work = once(work.withColumns({
        "_initial_due": nth_ahead("notice", F.when(new, F.lit(20)).otherwise(F.lit(10))),
        "_credit_due": nth_ahead("notice", 2)}), "_initial_due", "_credit_due")
    conclusion = F.when(credit, F.date_add(notice, reg_e_extended_days(new, pos, foreign))).otherwise(
        F.col("_initial_due"))
    work = look_ahead(work.withColumn("_conclusion", conclusion), F.col("_conclusion"), "conclusion")
    work = once(work.withColumns({
        "_report_due": nth_ahead("conclusion", 3), "_correct_due": nth_ahead("conclusion", 1)}),
        "_report_due", "_correct_due")

    def missing(name: str) -> Column:
        return _result(F.col(regulation), F.lit(None).cast("boolean"),
                       F.array().cast(f"array<{DEADLINE}>"), F.array().cast("array<string>"),
                       F.array().cast("array<string>"), F.lit(name))

    no_notice = missing("missing date field 'notice_date'")
    no_statement = missing("missing date field 'statement_date'")
    reg = F.col(regulation)
    contact = F.coalesce(F.col("_first_contact"), notice)
    result = (
        F.when(reg.isin("REG_E", "REG_Z", "FCRA") & notice.isNull(), no_notice)
        .when(reg.isin("REG_E", "REG_Z") & statement.isNull(), no_statement)
        .when(reg == "REG_E", regulation_e(
            notice, statement, opened, pos, foreign, credit,
            *[F.col(n) for n in ("_initial_due", "_credit_due", "_report_due", "_correct_due")]))
        .when(reg == "REG_Z", regulation_z(notice, statement, F.col("_billing_cycle_days")))
        .when(reg == "FCRA", fcra(notice, F.col("_additional_information_provided")))
        .when(contact.isNull(), no_notice)
        .otherwise(fdcpa(contact, F.col("_written"))))
    added = [result.alias(out)]
    if liability:
        found = F.coalesce(F.col("_discovery"), notice)
        work = once(work.withColumn("_clock", F.when(
            reg == "REG_E", business_index(notice) - business_index(found))), "_clock")
        added.append(F.when(
            (reg == "REG_E") & notice.isNotNull() & statement.isNotNull(),
            regulation_e_liability(
                F.col("_clock"), _days(notice, statement), F.col("_access_device"))).alias(liability))
    return work.select(*keep, *added)


def explode_deadlines(df: DataFrame, keys: list[str], result: str = "deadlines") -> DataFrame:
    """The long deadline table: one row per deadline of each dispute."""
    named = df.select(*keys, result, F.col(f"{result}.regulation").alias("regulation"))
    return unnest(named, F.col(f"{result}.deadlines"), "_d", *keys, "regulation").select(
        *keys, "regulation", "_d.*")
