"""Field validation and reason codes as Column expressions over each dispute row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remedia import policy
from remedia.functions.dates import iso, parse_day
from remedia.functions.text import money, parse_money, strip
from remedia.session import once

ISSUE = "struct<field:string,severity:string,message:string>"
ISSUES = f"array<{ISSUE}>"
REASON = (
    "struct<mapped:boolean,code:string,derived:boolean,network:string,label:string,"
    "category:string,issuer_window_days:int,regulation:string,evidence:array<string>,"
    "issue:string,reason:string>")
DATE_FIELDS = ("transaction_date", "statement_date", "notice_date")


def issue(field: str, severity: str, message) -> Column:
    text = message if isinstance(message, Column) else F.lit(message)
    return F.struct(
        F.lit(field).alias("field"), F.lit(severity).alias("severity"), text.alias("message")
    ).cast(ISSUE)


def _kept(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda i: i.isNotNull())


def no_issues() -> Column:
    return F.array().cast(ISSUES)


def has_error(issues: Column) -> Column:
    return F.exists(issues, lambda i: i["severity"] == "error")


def _two(amount: Column) -> Column:
    return F.format_string("%.2f", amount)


def _plain(amount: Column) -> Column:
    """The number with all its digits and no exponent, at least one behind the point."""
    digits = F.regexp_replace(amount.cast("decimal(38,10)").cast("string"), "0+$", "")
    return F.coalesce(F.regexp_replace(digits, r"\.$", ".0"), amount.cast("string"))


def _number(amount: Column, kind: str) -> Column:
    return money(amount) if kind == "string" else amount.cast("double")


def amount_issues(amount: Column) -> Column:
    """Issues of the amount alone: missing or unparseable, not positive."""
    return F.when(amount.isNull(), F.array(issue(
        "disputed_amount", "error", "the disputed amount is missing or unparseable"))
    ).when(amount <= 0, F.array(issue(
        "disputed_amount", "error",
        F.concat(F.lit("the disputed amount must be positive, got "), _plain(amount))))
    ).otherwise(no_issues())


def reconcile_issue(amount: Column, total: Column, count: Column) -> Column:
    """NULL when the listed transactions add up to the disputed amount."""
    return F.when(
        F.abs(total - amount) > policy.AMOUNT_TOLERANCE,
        issue("disputed_amount", "error", F.concat(
            F.lit("the disputed amount "), _two(amount), F.lit(" does not reconcile to the "),
            count.cast("string"), F.lit(" transaction(s) listed, which total "), _two(total))))


def validate_amounts(df: DataFrame, out: str = "amount_check") -> DataFrame:
    """Add ``struct<issues, disputed_amount, transaction_total>``.

    ``disputed_amount`` may be a number or text; ``transactions`` (optional) is an
    array of ``struct<id, amount>`` carried by the row.
    """
    amount = parse_money(df, "disputed_amount")
    total = F.lit(None).cast("double")
    listed = no_issues()
    if "transactions" in df.columns:
        kind = df.schema["transactions"].dataType.elementType["amount"].dataType.simpleString()
        items = F.transform(
            "transactions",
            lambda t: F.struct(t["id"].cast("string").alias("id"),
                               _number(t["amount"], kind).alias("amount")))
        any_listed = F.coalesce(F.size("transactions") > 0, F.lit(False))
        total = F.when(any_listed, F.round(F.aggregate(
            items, F.lit(0.0), lambda acc, t: acc + F.coalesce(t["amount"], F.lit(0.0))), 2))
        bad = F.transform(
            F.filter(items, lambda t: t["amount"].isNull()),
            lambda t: issue("transactions", "error", F.concat(
                F.lit("transaction "), F.coalesce(t["id"], F.lit("?")),
                F.lit(" has no parseable amount"))))
        listed = F.when(any_listed, F.concat(
            _kept(reconcile_issue(F.col("_amount"), total, F.size("transactions"))), bad)
        ).otherwise(no_issues())
    own = amount_issues(F.col("_amount"))
    usable = F.col("_amount") > 0
    return (
        df.withColumn("_amount", amount)
        .withColumn(out, F.struct(
            F.when(F.coalesce(usable, F.lit(False)), listed).otherwise(own).alias("issues"),
            F.when(usable, F.round("_amount", 2)).alias("disputed_amount"),
            F.when(usable, total).alias("transaction_total")))
        .drop("_amount"))


def reconcile_transactions(
    df: DataFrame, transactions: DataFrame, key: str, amount: str, txn_amount: str,
) -> DataFrame:
    """Reconciliation when the transactions are a table of their own.

    Transactions are summed per dispute first (map-side combined, so a dispute
    that owns a large share of them is no hot task), then joined one to one.
    Adds ``transaction_total, transactions, unparseable, reconciles``.
    """
    value = parse_money(transactions, txn_amount)
    totals = transactions.groupBy(key).agg(
        F.round(F.sum(F.coalesce(value, F.lit(0.0))), 2).alias("transaction_total"),
        F.count(F.lit(1)).alias("transactions"),
        F.count_if(value.isNull()).alias("unparseable"))
    gap = F.abs(F.col("transaction_total") - F.col(amount))
    return df.join(totals, key, "left").withColumn(
        "reconciles",
        F.when(F.col("transactions").isNull(), F.lit(True))
        .otherwise((gap <= policy.AMOUNT_TOLERANCE) & (F.col("unparseable") == 0)))


def _date_findings(raw: dict[str, Column], parsed: dict[str, Column], as_of: Column,
                   ) -> list[tuple[Column, str, str, Column]]:
    """``(condition, field, severity, message)`` of all that may be wrong with the dates, in order."""
    found = []
    for name in DATE_FIELDS:
        text = raw[name].cast("string")
        blank = text.isNull() | (text == "")
        found.append((parsed[name].isNull(), name, "error", F.when(blank, F.lit("date is missing")).otherwise(
            F.concat(F.lit("'"), text, F.lit("' is not an ISO date")))))
    for name in DATE_FIELDS:
        day = parsed[name]
        found.append((day > as_of, name, "error", F.concat(iso(day), F.lit(" is in the future"))))
        found.append((F.year(day) < 2000, name, "warning", F.concat(iso(day), F.lit(" is implausibly old"))))
    txn, stmt, notice = (parsed[n] for n in DATE_FIELDS)
    return [
        *found,
        (txn > stmt, "statement_date", "error", F.concat(
            F.lit("the statement was transmitted on "), iso(stmt),
            F.lit(", before the transaction on "), iso(txn),
            F.lit("; the 60-day clock cannot start before the transaction it reflects"))),
        (notice < stmt, "notice_date", "error", F.concat(
            F.lit("notice on "), iso(notice), F.lit(" precedes the statement on "), iso(stmt))),
        (F.datediff(notice, txn) > 540, "notice_date", "warning", F.concat(
            F.datediff(notice, txn).cast("string"),
            F.lit(" days elapsed between the transaction and the notice, which is outside every "
                  "network chargeback window even where the regulatory claim survives"))),
    ]


def date_issues(raw: dict[str, Column], parsed: dict[str, Column], as_of: Column) -> Column:
    """Missing, malformed, future, old and wrongly ordered dates, in that order."""
    return _kept(*[F.when(wrong, issue(name, severity, message))
                   for wrong, name, severity, message in _date_findings(raw, parsed, as_of)])


def _date_columns(df: DataFrame) -> tuple[dict[str, Column], dict[str, Column]]:
    types = dict(df.dtypes)
    raw = {n: (F.col(n) if n in types else F.lit(None).cast("string")) for n in DATE_FIELDS}
    return raw, {n: (raw[n] if types.get(n) == "date" else parse_day(raw[n])) for n in DATE_FIELDS}


def count_date_issues(df: DataFrame, as_of: Column, errors: str = "errors", warnings: str = "warnings") -> DataFrame:
    """Add how many errors and warnings ``validate_dates`` finds; their messages are not made.

    The days are parsed once, however many findings read them.
    """
    raw, parsed = _date_columns(df)
    days = {n: f"_day_{n}" for n in DATE_FIELDS}
    held = once(df.withColumns({days[n]: parsed[n] for n in DATE_FIELDS}), *days.values())
    found = _date_findings(raw, {n: F.col(days[n]) for n in DATE_FIELDS}, as_of)

    def count(kind: str) -> Column:
        return reduce(lambda a, b: a + b, [
            F.when(wrong, 1).otherwise(0) for wrong, _, severity, _ in found if severity == kind])

    return held.withColumns({errors: count("error"), warnings: count("warning")}).drop(*days.values())


def validate_dates(df: DataFrame, as_of: Column, out: str = "date_check") -> DataFrame:
    """Add ``struct<issues, transaction_date, statement_date, notice_date>`` (parsed days).

    ``as_of`` is the day the check is made for; the clock is never read.
    """
    raw, parsed = _date_columns(df)
    return df.withColumn(out, F.struct(
        date_issues(raw, parsed, as_of).alias("issues"),
        *[parsed[n].alias(n) for n in DATE_FIELDS]))


def validate_fields(df: DataFrame, as_of: Column, out: str = "validation") -> DataFrame:
    """Both checks in one struct: ``ok, issues`` and the normalised values."""
    checked = validate_dates(validate_amounts(df, "_amounts"), as_of, "_dates")
    issues = F.concat(F.col("_amounts.issues"), F.col("_dates.issues"))
    return checked.withColumn(out, F.struct(
        (~has_error(issues)).alias("ok"), issues.alias("issues"),
        F.col("_amounts.disputed_amount").alias("disputed_amount"),
        F.col("_amounts.transaction_total").alias("transaction_total"),
        *[F.col(f"_dates.{n}").alias(n) for n in DATE_FIELDS])).drop("_amounts", "_dates")


def map_reason_code(code: Column, complaint_issue: Column) -> Column:
    """Resolve a stated code, else derive one from the issue; never guess.

    A stated code that is not in the table stays unmapped even where the issue
    would map, so that it reaches a person.
    """
    entries = F.create_map(*[
        part for c, network, label, category, window, regulation, evidence in policy.REASON_CODES
        for part in (F.lit(c), F.struct(
            F.lit(network).alias("network"), F.lit(label).alias("label"),
            F.lit(category).alias("category"), F.lit(window).alias("issuer_window_days"),
            F.lit(regulation).alias("regulation"),
            F.array(*[F.lit(e) for e in evidence]).alias("evidence")))])
    by_issue = F.create_map(
        *[F.lit(x) for kv in policy.REASON_CODE_OF_ISSUE.items() for x in kv])
    stated = F.coalesce(code != "", F.lit(False))
    derived = F.try_element_at(by_issue, F.coalesce(complaint_issue, F.lit("")))
    entry = F.try_element_at(entries, F.when(stated, strip(code)).otherwise(derived))
    mapped = entry.isNotNull()
    return F.struct(
        mapped.alias("mapped"),
        F.when(stated, code).otherwise(derived).alias("code"),
        F.when(mapped, ~stated).alias("derived"),
        *[entry[f].alias(f) for f in
          ("network", "label", "category", "issuer_window_days", "regulation", "evidence")],
        F.when(~mapped & ~stated, complaint_issue).alias("issue"),
        F.when(~mapped & stated, F.lit(policy.UNKNOWN_CODE_REASON))
        .when(~mapped, F.lit(policy.NO_CODE_REASON)).alias("reason")).cast(REASON)
