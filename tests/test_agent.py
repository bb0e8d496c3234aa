"""The audit with searches line by line, and the gate on identifiers."""

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import agent as G
from ledgerlake.operators import intake as I
from ledgerlake.operators import judging as J
from ledgerlake.operators.rules import deduction_clauses, not_payable_list, waiting_terms

LINES = "bill_id LONG, policy STRING, line_no INT, item STRING, cents LONG, qty INT, sum_insured LONG"
BILLS = "bill_id LONG, policy STRING, admitted DATE, started DATE"


def audit(spark, lines, bills, tried, judge=None):
    clauses = [(10, "paid"), (11, "This is not covered: Rs 0."), (12, "This is excluded: Rs 0."), (13, "For gear Rs 1,500 per day."), (14, "Rs 0 only"), (15, "Rs 700 in all"), (16, "See the schedule")]
    clauses = spark.createDataFrame([("AFRICA", k, t) for k, t in clauses], "policy STRING, clause_id LONG, text STRING")
    terms = waiting_terms(spark).withColumn("ped_clause", F.lit("12"))
    entitled = spark.createDataFrame([(1, "schedule", 150_000, None, "R.1"), (4, "schedule", None, "small", "R.2")], "bill_id LONG, source STRING, per_day LONG, category STRING, clause_id STRING")
    rows = spark.createDataFrame(tried, "item STRING, attempt INT, clause_id LONG, score LONG").withColumn("rank", F.lit(1))
    lines, bills = spark.createDataFrame(lines, LINES), spark.createDataFrame(bills, BILLS)

    def search(open_, attempt):
        asked = open_.join(lines.select(*G.KEYS, "item"), G.KEYS)
        return asked.join(rows.where(F.col("attempt") == attempt), "item").select(*G.KEYS, "clause_id", "score", "rank")

    return G.audit_with_searches(lines, bills, terms, not_payable_list(spark), entitled, deduction_clauses(spark), search, G.graded(lines, clauses, judge)).collect()


def test_every_stage(spark):
    old, new = datetime.date(2000, 1, 1), datetime.date(2010, 1, 1)
    bills = [(1, "AFRICA", new, old), (2, "AFRICA", new, new), (3, "AFRICA", None, old), (4, "AFRICA", new, old)]
    items = ["blue gear", "widget", "rope", "small anvil", "cord", "line", "tape", "glue", "nail", "wire", "hook"]
    lines = [(1, "AFRICA", i + 1, item, 500_000 if i == 0 else 100_000, 2, 300_000) for i, item in enumerate(items)]
    lines += [(2, "AFRICA", 1, "cord", 5, 1, 1), (3, "AFRICA", 1, "wire", 100_000, 1, 1), (4, "AFRICA", 1, "blue gear", 900, 1, 1), (None, "AFRICA", 1, "cord", 5, 1, 1), (1, "AFRICA", None, "cord", 5, 1, 1)]
    tried = [("widget", 0, 10, 500_000), ("rope", 0, 99, 500_000), ("cord", 0, 11, 500_000), ("line", 0, 12, 500_000), ("tape", 0, 13, 500_000), ("tape", 1, 13, 500_000)]
    tried += [("nail", 0, 14, 500_000), ("nail", 1, 15, 1), ("nail", 2, 10, 500_000), ("wire", 0, 10, 1), ("wire", 1, 15, 300_000), ("hook", 0, 16, 500_000)]
    got = {(r["bill_id"], r["line_no"]): r for r in audit(spark, lines, bills, tried)}
    assert {k: (r["stage"], r["allowed"], r["clause_id"], r["attempts"], r["calls"]) for k, r in got.items()} == {
        (1, 1): ("room", 300_000, "R.1", None, 0), (1, 2): ("judged", 60_000, "II.4", 1, 2), (1, 3): ("judged", None, None, None, 2),
        (1, 4): ("list", 0, None, None, 0), (1, 5): ("judged", 0, "11", 1, 2), (1, 6): ("judged", None, "12", 1, 2), (1, 7): ("judged", None, None, None, 3),
        (1, 8): ("judged", None, None, None, 6), (1, 9): ("judged", 100_000, "10", 3, 6), (1, 10): ("judged", 70_000, "15", 2, 4), (1, 11): ("judged", None, None, None, 2),
        (2, 1): ("waiting", 0, "W.3", None, 0), (3, 1): ("judged", 70_000, "15", 2, 4), (4, 1): ("room", None, "R.2", None, 0),
    }
    assert got[1, 6]["why"].startswith("12 is a waiting period, but 120 months") and got[1, 2]["why"] == "scaled with the room"
    assert [got[1, k]["why"] for k in (3, 7, 8, 11)] == ["fabricated", "repeated searches", "attempts", "detail"]
    assert {k for k, r in got.items() if r["changed"]} == {(1, 9), (1, 10), (3, 1)}
    assert {k for k, r in got.items() if r["fast_path"]} == {(1, 1), (1, 4), (2, 1), (4, 1)}
    assert {k for k, r in got.items() if r["abstained"]} == {(1, 3), (1, 6), (1, 7), (1, 8), (1, 11), (4, 1)}


def test_a_judge_of_ones_own_and_empty_tables(spark):
    day = [(1, "AFRICA", datetime.date(2010, 1, 1), datetime.date(2000, 1, 1))]
    none = F.array().cast(J.LIMITS)
    judge = lambda found: found.select(*G.KEYS, "clause_id", none.alias("limits"), F.lit(True).alias("confident"))
    got = audit(spark, [(1, "AFRICA", 1, "cord", 7, 1, 1)], day, [("cord", 0, 14, 0)], judge)
    assert [(r["allowed"], r["clause_id"], r["attempts"]) for r in got] == [(7, "14", 1)]
    assert audit(spark, [], [], []) == []


def test_a_search_has_what_it_asks_by_at_hand(spark):
    old, new = datetime.date(2000, 1, 1), datetime.date(2010, 1, 1)
    lines = spark.createDataFrame([(1, "AFRICA", 1, "cord", 900, 2, 1), (1, "AFRICA", 2, "wire", 900, 3, 1)], LINES)
    bills = spark.createDataFrame([(1, "AFRICA", new, old)], BILLS)
    entitled = spark.createDataFrame([], "bill_id LONG, source STRING, per_day LONG, category STRING, clause_id STRING")
    clauses = spark.createDataFrame([("AFRICA", 10, "paid"), ("AFRICA", 11, "Rs 5 in all")], "policy STRING, clause_id LONG, text STRING")
    asked = []

    def search(open_, attempt):
        asked.append(open_.columns)
        score = F.when((F.col("item") == "wire") & (F.lit(attempt) == 0), 1).otherwise(500_000)
        return open_.select(*G.KEYS, "policy", "item", (F.col("qty") + 8 - (F.lit(attempt) > 0).cast("int")).alias("clause_id"), score.alias("score"), F.lit(1).alias("rank"))

    judge = G.graded(lines, clauses)
    assert "Join" not in judge(lines.selectExpr("bill_id", "line_no", "policy", "item", "10L AS clause_id", "1 AS score", "1 AS rank"))._jdf.queryExecution().analyzed().toString().split("LeftOuter")[1]
    got = G.audit_with_searches(lines, bills, waiting_terms(spark), not_payable_list(spark), entitled, deduction_clauses(spark), search, judge).collect()
    assert sorted((r["line_no"], r["allowed"], r["clause_id"], r["attempts"]) for r in got) == [(1, 900, "10", 1), (2, 900, "10", 2)]
    assert all({"policy", "item", "qty"} <= set(c) for c in asked)


def test_rows_that_keep_an_identifier_are_not_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, "call 9876543210 now"), (2, "plain"), (3, None), (4, "a@b.org and 1234 5678 9012")], "id INT, text STRING")
    assert I.write_masked(rows, f"{tmp_path}/a") == {"rows": 4, "changed": 2, "left": 0}
    assert {r["id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/a").collect()} == {1: "call [REDACTED] now", 2: "plain", 3: None, 4: "[REDACTED] and [REDACTED]"}
    glued = spark.createDataFrame([(5, "x@y.org9876543210@z.org"), (6, "fine")], "id INT, text STRING")
    masks = I.mask
    I.mask = lambda c: c
    try:
        with pytest.raises(I.IdentifiersLeft, match="1 of 2 rows"):
            I.write_masked(glued, f"{tmp_path}/b")
    finally:
        I.mask = masks
    assert [r["id"] for r in spark.read.parquet(f"{tmp_path}/b").collect()] == [6]
