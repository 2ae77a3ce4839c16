"""Contracts, layers, validation, sources and the medallion build."""

import csv

import pytest
from pyspark.sql import functions as F

from remedia import policy
from remedia.operators import contracts as c
from remedia.operators import layers
from remedia.operators import manifest
from remedia.operators import validation as v
from remedia.plans import medallion
from remedia.sources import readers, writers

AS_OF = "2025-01-01"


def complaint(i, **over):
    row = dict(
        complaint_id=f"C{i}", date_received="2023-05-01", product="Card",
        issue=policy.KNOWN_ISSUES[i % 20], regulation="", company="X", company_size="large",
        state="NY", submitted_via="Web", consumer_consent="Yes",
        narrative="they charged me\ntwice, \"twice\" for this", disputed_amount="12.5",
        company_response=policy.RESPONSE_CATEGORIES[i % 5], timely_response="Yes",
        consumer_disputed="No")
    return row | over


def application(i, **over):
    return dict(application_id=f"A{i}", month=str(i % 8), fraud_bool="0",
                **{f: "20" for f in policy.FRAUD_FEATURES}) | over


def write(path, rows):
    with open(path, "w", newline="") as fh:
        out = csv.DictWriter(fh, fieldnames=list(rows[0]))
        out.writeheader()
        out.writerows(rows)
    return str(path)


def test_silver_accounts_for_every_row(spark, tmp_path):
    rows = [complaint(i) for i in range(50)]
    rows.insert(3, complaint(7, disputed_amount="abc"))  # bad first row does not claim its id
    rows.append(complaint(5))
    path = write(tmp_path / "c.csv", rows)
    bronze = readers.read_csv(spark, path, readers.COMPLAINT_COLUMNS)
    layer = layers.silver_complaints(bronze, readers.ORDINAL)
    held = {r["complaint_id"]: r[layers.REASON] for r in layer.quarantine.collect()}
    assert layer.rows.count() == 50 and len(held) == 2
    assert held["C5"] == "duplicate complaint_id"
    assert held["C7"] == "ValueError: could not convert string to float: 'abc'"
    assert layer.rows.first()["narrative_length"] == 7


def test_contract_kinds(spark):
    df = spark.createDataFrame(
        [(i, "a" if i else "b", None if i == 3 else i, f"2024-01-{i + 1:02d}")
         for i in range(100 // 5)], "n int, k string, v int, d string")
    got = {r["name"]: r for r in c.report(df, [
        c.not_null("v"), c.unique("k"), c.in_set("k", ["a"]), c.between("v", 0, 10),
        c.matches("d", r"\d{4}-\d\d-\d\d"), c.monotonic("d", ["n"]),
        c.class_balance("k", 0.06), c.row_count(21)]).collect()}
    assert [got[n]["violations"] for n in ("v is never null", "k is unique",
            "k is one of 1 known values", "v within [0, 10]")] == [1, 18, 1, 9]
    assert got["d is non-decreasing"]["passed"]
    assert got["k classes each hold >= 6.0%"]["violations"] == 1
    assert not got["at least 21 rows"]["passed"]
    with pytest.raises(c.DataContractError, match="never null.*"):
        c.enforce("layer", c.report(df, [c.not_null("v", "why it matters")]))
    c.enforce("layer", c.report(df, [c.not_null("v", severity="warning")]))


def test_monotonic_finds_the_first_break(spark):
    df = spark.createDataFrame([(i, i if i not in (300, 700) else 0) for i in range(1000)],
                               "n int, v int")
    row = c.first_break(df, "v", ["n"]).first()
    assert row["violations"] == 2 and row["first_break"]["n"] == 300


def test_empty_table_passes_value_checks(spark):
    df = spark.createDataFrame([], "k string")
    rows = c.report(df, [c.unique("k"), c.in_set("k", ["a"])]).collect()
    assert len(rows) == 2 and all(r["passed"] for r in rows)


def test_amounts(spark):
    schema = "id int, disputed_amount double, transactions array<struct<id:string,amount:double>>"
    df = spark.createDataFrame([
        (1, 100.0, [("a", 60.0), ("b", 40.0)]), (2, 100.0, [("a", 60.0)]), (3, None, None),
        (4, -5.0, None), (5, 60.0, [("a", 60.0), ("b", None)])], schema)
    got = {r["id"]: [i["message"] for i in r["amount_check"]["issues"]]
           for r in v.validate_amounts(df).collect()}
    assert got[1] == []
    assert "does not reconcile to the 1 transaction(s)" in got[2][0]
    assert got[3] == ["the disputed amount is missing or unparseable"]
    assert got[4] == ["the disputed amount must be positive, got -5.0"]
    assert got[5] == ["transaction b has no parseable amount"]


def test_money_text(spark):
    cases = {"$1,234.56": 1234.56, "-50": 50.0, "1500": 1500.0, "1500.00": 1500.0, "none": None}
    df = spark.createDataFrame([(k,) for k in cases], "disputed_amount string")
    got = {r["disputed_amount"]: r["amount_check"]["disputed_amount"]
           for r in v.validate_amounts(df).collect()}
    assert got == cases


def test_dates(spark):
    rows = [("2024-11-10", "2024-11-01", "2024-11-20"), ("2024-10-01", "2024-11-01", "2024-10-15"),
            (None, "soon", "2026-01-01"), ("1999-01-01", "2024-11-01", "2024-11-02")]
    df = spark.createDataFrame(rows, "transaction_date string, statement_date string, "
                                     "notice_date string")
    got = [[(i["field"], i["severity"]) for i in r["date_check"]["issues"]]
           for r in v.validate_dates(df, F.to_date(F.lit(AS_OF))).collect()]
    assert got[0] == [("statement_date", "error")]
    assert got[1] == [("notice_date", "error")]
    assert got[2] == [("transaction_date", "error"), ("statement_date", "error"),
                      ("notice_date", "error")]
    assert got[3] == [("transaction_date", "warning"), ("notice_date", "warning")]


def test_unknown_reason_code_is_not_guessed(spark):
    df = spark.createDataFrame([("99.9", "Fraud or scam"), (None, "Fraud or scam"),
                                (None, "Managing an account")], "c string, i string")
    got = [r["m"] for r in df.select(v.map_reason_code(F.col("c"), F.col("i")).alias("m")).collect()]
    assert [m["mapped"] for m in got] == [False, True, False]
    assert got[1]["code"] == "10.4" and got[1]["derived"]


def test_build_writes_layers_and_manifest(spark, tmp_path):
    a = write(tmp_path / "c.csv", [
        complaint(i, date_received=f"2023-{i % 12 + 1:02d}-05") for i in range(200)])
    b = write(tmp_path / "f.csv", [application(i) for i in range(200)]
              + [application(1000, income="?")])
    out = str(tmp_path / "out")
    built = medallion.build(spark, a, b, out, minimum=100)
    assert {r["layer"]: r["blocking"] for r in medallion.summary(built).collect()} == {
        n: 0 for n in built.layers}
    assert sum(r["rows"] for r in built.splits.collect()) == 400
    assert spark.read.json(f"{out}/silver/quarantine").count() == 1
    test = readers.read_gold(spark, f"{out}/gold/complaints", "test")
    assert test.count() == sum(1 for i in range(200) if i % 12 + 1 >= 11)
    again = manifest.track_table(spark.read.parquet(f"{out}/gold/fraud"), "gold/fraud")
    state = {r["name"]: r["state"] for r in manifest.verify(built.manifest, again).collect()}
    assert state["gold/fraud"] == "clean" and state["gold/complaints"] == "missing"
    with pytest.raises(c.DataContractError):
        medallion.build(spark, a, b, minimum=1000)


def test_manifest_detects_a_changed_file(spark, tmp_path):
    path = tmp_path / "data.csv"
    path.write_text("a,b\n1,2\n")
    before = manifest.track_files(spark, {"x": str(path)})
    stored = before.collect()[0]
    kept = spark.createDataFrame([stored], before.schema)
    assert stored["rows"] == 2
    old = manifest.fingerprint(kept).first()["fingerprint"]
    assert manifest.is_clean(manifest.verify(kept, before)).first()["clean"]
    path.write_text("a,b\n1,3\n")
    after = manifest.track_files(spark, {"x": str(path)})
    assert not manifest.is_clean(manifest.verify(kept, after)).first()["clean"]
    assert manifest.fingerprint(after).first()["fingerprint"] != old and len(old) == 16


def test_examples_are_written_easy_first(spark, tmp_path):
    df = spark.createDataFrame([(f"e{i}", (i * 7 % 10) / 10) for i in range(10)],
                               "example_id string, difficulty double")
    path = str(tmp_path / "examples")
    writers.write_examples(df, path)
    lines = [r["difficulty"] for r in spark.read.json(path).coalesce(1).collect()]
    assert sorted(lines) == [i / 10 for i in range(10)]
