"""Readers and writers: bills, pages, clauses, lists, traces and reports as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BILL_SCHEMA = (
    "bill_id STRING, policy STRING, sum_insured BIGINT, policy_start_date STRING, admission_date STRING, discharge_date STRING,"
    " category STRING, total_charged DOUBLE, bill_text STRING,"
    " policy_schedule STRUCT<room_limit_per_day: DOUBLE, room_category: STRING>,"
    " lines ARRAY<STRUCT<item: STRING, amount: DOUBLE, qty: INT>>, _corrupt_record STRING"
)
#: The largest text file that counts as a bill.
MAX_BYTES = 25 * 1024 * 1024


def read_bills(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One JSON object for each admission; objects that cannot be read keep their text in _corrupt_record."""
    return spark.read.schema(BILL_SCHEMA).option("multiLine", multi_line).option("mode", "PERMISSIVE").json(path)


def bill_lines(bills: DataFrame) -> DataFrame:
    """(bill_id, line_no, item, cents, qty): header to line grain, in the order of the bill; a missing quantity is 1."""
    each = bills.select("bill_id", F.posexplode("lines").alias("pos", "line"))
    return each.select(
        "bill_id", (F.col("pos") + 1).alias("line_no"), F.col("line.item").alias("item"),
        F.round(F.col("line.amount").cast("decimal(18,4)") * 100).cast("bigint").alias("cents"), F.coalesce("line.qty", F.lit(1)).alias("qty"),
    )


def read_text_bills(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, refused): a whole file is one bill. Refused are PDF files, files that are no UTF-8, and those over 25 MB."""
    files = spark.read.format("binaryFile").load(path)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    refused = (
        F.when(F.col("length") > MAX_BYTES, "too large").when(F.substring("content", 1, 4) == F.lit(b"%PDF"), "pdf").when(text.isNull(), "not utf-8")
    )
    return files.select("path", F.when(refused.isNull(), text).alias("text"), refused.alias("refused"))


def policy_slug(name: Column) -> Column:
    """A file's name as policy id: lower case, other characters than a-z and 0-9 as single underscores."""
    bare = F.regexp_replace(F.regexp_extract(name, r"([^/]*?)(?:\.[^./]*)?$", 1), "%20", " ")
    return F.btrim(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", "_"), F.lit("_"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(policy, page, text) of text files whose pages are parted by form feeds."""
    files = spark.read.format("binaryFile").load(path)
    pages = F.split(F.col("content").cast("string"), "\f", -1)
    return files.select(policy_slug(F.col("path")).alias("policy"), F.posexplode(pages).alias("pos", "text")).select("policy", (F.col("pos") + 1).alias("page"), "text")


def write_clauses(clauses: DataFrame, path: str) -> None:
    clauses.write.partitionBy("policy").mode("overwrite").parquet(path)


def read_clauses(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Clauses by policy: a filter on policy reads that policy's files only."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def read_exclusion_list(spark: SparkSession, path: str) -> DataFrame:
    """(no, item): objects with a number, or plain strings, which are numbered from 1."""
    lists = spark.read.text(path, wholetext=True)
    kind = "array<struct<no:int,item:string>>"
    objects, strings = F.from_json("value", kind), F.from_json("value", "array<string>")
    plain = F.transform(strings, lambda s, i: F.struct((i + 1).alias("no"), s.alias("item")))
    flat = lists.select(F.when(F.get_json_object("value", "$[0].item").isNotNull(), objects).otherwise(plain).alias("e"))
    return flat.select(F.posexplode("e").alias("pos", "e")).select(F.coalesce("e.no", F.col("pos") + 1).alias("no"), "e.item")


def append_trace(df: DataFrame, path: str, fixed: tuple = ("run_id", "ts", "elapsed", "node")) -> None:
    """Append step records; all other columns go into a map of strings."""
    free = [c for c in df.columns if c not in fixed]
    pairs = [x for c in free for x in (F.lit(c), F.col(c).cast("string"))]
    fields = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    df.select(*fixed, fields.alias("fields")).write.mode("append").json(path)


def report_rows(lines: DataFrame) -> DataFrame:
    """(section, line_no, item, charged, allowed): lines of a report (flagged ones say so), then three totals."""
    detail = lines.select(
        F.lit(0).alias("section"), "line_no", "item", F.col("cents").cast("string").alias("charged"),
        F.coalesce(F.col("allowed").cast("string"), F.lit("FLAGGED")).alias("allowed"),
    )
    sums = lines.agg(F.sum("cents").alias("c"), F.sum(F.coalesce("allowed", F.lit(0))).alias("a"), F.count_if(F.col("allowed").isNull()).alias("f"))
    totals = sums.select(F.expr("stack(3, 1, 'Total charged', c, 2, 'Total allowed', a, 3, 'Flagged', f) AS (line_no, item, allowed)"))
    return detail.unionByName(totals.select(F.lit(1).alias("section"), "line_no", "item", F.lit("").alias("charged"), F.col("allowed").cast("string").alias("allowed")))


def export_report_csv(lines: DataFrame, path: str) -> None:
    ordered = report_rows(lines).orderBy("section", "line_no").drop("section", "line_no")
    ordered.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
