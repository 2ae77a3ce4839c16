"""Scans: CSV with every field a string, JSON lines, single-document JSON, parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remedia import policy

COMPLAINT_COLUMNS = [
    "complaint_id", "date_received", "product", "issue", "regulation", "company", "company_size",
    "state", "submitted_via", "consumer_consent", "narrative", "disputed_amount",
    "company_response", "timely_response", "consumer_disputed"]
FRAUD_COLUMNS = ["application_id", "month", "fraud_bool", *policy.FRAUD_FEATURES]
ORDINAL = ["_file", "_block", "_row"]

SECTION_SCHEMA = (
    "note string, retrieved_at string, sources map<string,string>, "
    "sections array<struct<id:string,regulation:string,title:string,text:string>>")
GOLDEN_SCHEMA = (
    "questions array<struct<qid:string,question:string,regulation:string,"
    "primary:array<string>,secondary:array<string>,deadline_check:string,expected:int,"
    "reference_answer:string>>")
DISPUTE_SCHEMA = (
    "complaint_id string, issue string, regulation string, narrative string, "
    "disputed_amount double, transactions array<struct<id:string,amount:double>>, "
    "transaction_date string, statement_date string, notice_date string, "
    "discovery_date string, first_contact_date string, written_dispute_date string, "
    "account_opened string, reason_code string, point_of_sale boolean, "
    "foreign_initiated boolean, provisional_credit_given boolean, access_device boolean, "
    "additional_information_provided boolean, billing_cycle_days int, company_size string, "
    "submitted_via string")


def all_strings(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in columns])


def read_csv(
    spark: SparkSession, path, columns: list[str], multiline: bool = True,
) -> DataFrame:
    """Every field as the text in the file, plus the row's place as ``ORDINAL`` columns.

    ``_row`` counts within one scan task, which reads one block of one file, so
    the three columns order rows as the files do. Quoted line breaks need
    ``multiline``; without them leave it off, so that large files can be split.
    """
    rows = (
        spark.read.schema(all_strings(columns)).option("header", True)
        .option("multiLine", multiline).option("quote", '"').option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .option("enforceSchema", False).csv(path))
    return rows.select(
        "*", F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"))


def with_row_index(rows: DataFrame) -> DataFrame:
    """A parquet scan plus the stable place of each row: file and row index in it."""
    return rows.select(
        "*", F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.row_index").alias("_index"))


def read_json_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines; blank lines are skipped, a missing path is an error."""
    return spark.read.schema(schema).json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """``id, regulation, title, text``; a missing file gives an empty corpus."""
    if not _exists(spark, path):
        return spark.createDataFrame(
            [], "id string, regulation string, title string, text string")
    doc = spark.read.schema(SECTION_SCHEMA).option("multiLine", True).json(path)
    return doc.select(F.explode("sections").alias("s")).select("s.*")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.schema(GOLDEN_SCHEMA).option("multiLine", True).json(path)
    return doc.select(F.explode("questions").alias("q")).select("q.*")


def read_disputes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DISPUTE_SCHEMA).json(path)


def read_gold(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A gold table; ``split`` prunes to one fold's partition."""
    rows = spark.read.parquet(path)
    return rows if split is None else rows.where(F.col("split") == split)
