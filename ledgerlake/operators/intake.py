"""Intake: masking, reading printed bills, reconciling readers, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ledgerlake.functions.text import has_identifier, mask, normalise_item

#: A printed row: description, two spaces or more, whole quantity, amount with two decimals.
ROW = r"^(.*?\S) {2,}([0-9]+) {2,}([0-9][0-9,]*\.[0-9]{2})$"
TOTAL = r"^GRAND TOTAL +([0-9][0-9,]*\.[0-9]{2})$"
#: Words of lines that only sum others up.
SUMMING = r"(?i)^(grand |sub ?)?total\b[^A-Za-z]*$"


def mask_identifiers(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn(column, mask(F.col(column)))


def quarantine(df: DataFrame, column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(clean, held back): rows in which no identifier is left, and those in which one is."""
    hit = F.coalesce(has_identifier(F.col(column)), F.lit(False))
    return df.where(~hit), df.where(hit)


def assert_no_identifiers(df: DataFrame, column: str = "text") -> DataFrame:
    """The same rows; the job fails at the first in which an identifier is left."""
    hit = F.coalesce(has_identifier(F.col(column)), F.lit(False))
    return df.withColumn(column, F.when(hit, F.raise_error(F.lit("a text still holds an identifier"))).otherwise(F.col(column)))


def cents(amount: Column) -> Column:
    """'1,234.50' as whole cents; null where it is no amount."""
    return F.regexp_replace(amount, "[,.]", "").try_cast("bigint")


def text_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """One row for each line, numbered from 0 as ``pos``."""
    return df.select("*", F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))


def read_printed_rows(bills: DataFrame, text: str = "text") -> DataFrame:
    """(bill_id, line_no, item, qty, cents) of the fixed-column rows, in their order."""
    rows = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(ROW) & ~line.rlike(TOTAL))
    each = bills.select("bill_id", F.posexplode(rows).alias("pos", "line"))
    part = lambda n: F.regexp_extract("line", ROW, n)
    return each.select(
        "bill_id", (F.col("pos") + 1).alias("line_no"), part(1).alias("item"), part(2).cast("int").alias("qty"), cents(part(3)).alias("cents")
    )


def printed_total(bills: DataFrame, text: str = "text") -> DataFrame:
    """(bill_id, total): the grand total that the bill states, null where it states none."""
    stated = F.try_element_at(F.filter(F.split(text, "\n", -1), lambda line: line.rlike(TOTAL)), F.lit(-1))
    return bills.select("bill_id", cents(F.regexp_extract(stated, TOTAL, 1)).alias("total"))


def read_charges_shy(bills: DataFrame, text: str = "text") -> DataFrame:
    """(bill_id, pos, item, cents) by a reader that takes a line only if it surely is a charge.

    It drops rules, lines with a colon, summing words and descriptions of fewer than
    three letters; the amount must look like money at the end of the line. A trailing
    quantity is cut off the description.
    """
    lines = text_lines(bills.select("bill_id", F.col(text).alias("text"))).where("NOT contains(line, ':')")
    money = r"^(.*\S)\s+([0-9][0-9,]*\.[0-9]{2})\s*$"
    found = lines.where(F.col("line").rlike(money) & ~F.col("line").rlike(r"^[-=_ ]+$"))
    told = found.select(
        "bill_id", "pos",
        F.regexp_replace(F.regexp_extract("line", money, 1), r"\s+[0-9]+$", "").alias("item"),
        cents(F.regexp_extract("line", money, 2)).alias("cents"),
    )
    letters = F.length(F.regexp_replace("item", "[^A-Za-z]", ""))
    return told.where((letters >= 3) & ~F.col("item").rlike(SUMMING))


def bill_stats(charges: DataFrame) -> DataFrame:
    return charges.groupBy("bill_id").agg(F.count(F.lit(1)).alias("n_items"), F.sum("cents").alias("total"))


def reconcile_text_vs_lines(printed: DataFrame, lines: DataFrame, totals: DataFrame) -> DataFrame:
    """(bill_id, line_no, problem): differences of the printed rows and the lines of each bill.

    Where the counts differ, only that is told of the bill. Else, at each position:
    description (a mere prefix is a warning), amount off by more than a cent, quantity;
    and a grand total that is missing or wrong (line_no 0).
    """
    p = printed.select("bill_id", "line_no", F.col("item").alias("p_item"), F.col("qty").alias("p_qty"), F.col("cents").alias("p_cents"))
    both = lines.join(p, ["bill_id", "line_no"], "full_outer")
    counts = both.groupBy("bill_id").agg(F.count("item").alias("n"), F.count("p_item").alias("m"), F.sum("cents").alias("sum"))
    uneven = counts.where("n <> m").selectExpr("bill_id", "0 AS line_no", "'count' AS problem")
    even = counts.where("n = m").select("bill_id", "sum")
    flags = F.array_compact(
        F.array(
            F.when(F.col("item") != F.col("p_item"), F.when(F.col("item").startswith(F.col("p_item")), "prefix").otherwise("item")),
            F.when(F.abs(F.col("cents") - F.col("p_cents")) > 1, "amount"),
            F.when(F.col("qty") != F.col("p_qty"), "qty"),
        )
    )
    by_line = both.join(even.select("bill_id"), "bill_id").select("bill_id", "line_no", F.explode(flags).alias("problem"))
    wrong = even.join(totals, "bill_id", "left").where("total IS NULL OR total <> sum")
    by_total = wrong.selectExpr("bill_id", "0 AS line_no", "CASE WHEN total IS NULL THEN 'no total' ELSE 'total' END AS problem")
    return uneven.unionByName(by_line).unionByName(by_total)


def reconcile_parser(parsed: DataFrame, lines: DataFrame) -> DataFrame:
    """(bill_id, line_no, problem) for another parser's rows; items are compared as normalised, quantities not."""
    p = parsed.select("bill_id", "line_no", normalise_item(F.col("item")).alias("p_item"), F.col("cents").alias("p_cents"))
    both = lines.select("bill_id", "line_no", normalise_item(F.col("item")).alias("item"), "cents").join(p, ["bill_id", "line_no"], "full_outer")
    problem = (
        F.when(F.col("item").isNull(), "extra").when(F.col("p_item").isNull(), "missing")
        .when(F.col("item") != F.col("p_item"), "item").when(F.abs(F.col("cents") - F.col("p_cents")) > 1, "amount")
    )
    return both.select("bill_id", "line_no", problem.alias("problem")).where("problem IS NOT NULL")


def reader_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(bill_id, agree): whether two readers found as many items of the same sum."""
    x, y = bill_stats(a), bill_stats(b).withColumnsRenamed({"n_items": "n2", "total": "t2"})
    return x.join(y, "bill_id", "full_outer").selectExpr("bill_id", "(n_items <=> n2) AND (total <=> t2) AS agree")


def validate_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): amounts over 0, quantities of 1 at least (1 where none is given), a sum insured over 0."""
    filled = lines.withColumn("qty", F.coalesce("qty", F.lit(1)))
    good = F.coalesce((F.col("cents") > 0) & (F.col("qty") >= 1) & (F.col("sum_insured") > 0), F.lit(False))
    return filled.where(good), filled.where(~good)


def validate_policy(bills: DataFrame, clauses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known, unknown): bills whose policy has clauses, and those whose policy has none."""
    some = clauses.select("policy").distinct()
    return bills.join(some, "policy", "left_semi"), bills.join(some, "policy", "left_anti")


def schedule_or_null(df: DataFrame, limit: str = "per_day", category: str = "category") -> DataFrame:
    """Null both where there is neither a figure nor a category."""
    blank = F.col(limit).isNull() & (F.coalesce(category, F.lit("")) == "")
    return df.withColumn(category, F.when(~blank, F.col(category)))


def bill_index(bills: DataFrame) -> DataFrame:
    """One row for each bill; the room is rupees a day, else a category, else '-'."""
    room = F.coalesce(F.concat(F.format_number(F.col("per_day") / 100, 0), F.lit("/day")), F.nullif(F.col("category"), F.lit("")), F.lit("-"))
    return bills.select("bill_id", "policy", "sum_insured", "admitted", "started", room.alias("room"))


class IdentifiersLeft(ValueError):
    pass


def write_masked(df: DataFrame, path: str, column: str = "text") -> dict:
    """Mask a column and write the rows; the write itself counts rows, changed ones and those in which an identifier is left.

    A row in which one is left is never written, and the call fails with the figures once
    the others are. Null texts are written as they are.
    """
    seen, was = Observation(), "__was"
    masked = df.withColumn(was, F.col(column)).withColumn(column, mask(F.col(column)))
    left = F.coalesce(has_identifier(F.col(column)), F.lit(False))
    counts = [F.count(F.lit(1)).alias("rows"), F.count_if(~F.col(column).eqNullSafe(F.col(was))).alias("changed"), F.count_if(left).alias("left")]
    masked.observe(seen, *counts).where(~left).drop(was).write.mode("overwrite").parquet(path)
    figures = seen.get
    if figures["left"]:
        raise IdentifiersLeft(f"{figures['left']} of {figures['rows']} rows still hold an identifier and are not in {path}")
    return figures
