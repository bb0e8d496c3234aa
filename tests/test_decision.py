"""Each rule of a decision table on a bill of its own; facts of rooms; amounts as text."""

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import decision as D

R = D.Rule
TABLE = D.Table(
    rules=(
        R("waiting", "nil", ":waiting", when="waiting"),
        R("list", "nil", "LIST", when="listed", unless="(?i)ambulance"),
        R("registration", "nil", "A.31", "(?i)registration", policy="a"),
        R("ambulance", "cap", "A.8", "(?i)ambulance", policy="a", cap="stay"),
        R("room open", "human", ":room", "(?i)room rent", when="unresolved"),
        R("room", "per_day", ":room", "(?i)room rent", when="limited"),
        R("room full", "full", ":room", "(?i)room rent"),
        R("icu", "full", ":room", "(?i)icu"),
        R("follows open", "human", ":ratio", "(?i)surgeon", when="unresolved"),
        R("follows", "ratio", ":ratio", "(?i)surgeon", when="breached"),
        R("physio", "human", None, "(?i)physio"),
        R("other", "full", ":room"),
    ),
    policies={"a": ("A.1", "A.2", "A.3", 2), "b": ("B.1", "B.2", "B.3", None)},
    caps={("room", "a", 100): 200_000, ("stay", "a", 100): 75_000},
    waiting="(?i)hernia",
    ladder=(("shared", 1), ("deluxe", 4)),
)


def derive(spark, bills, lines):
    day = datetime.date
    b = spark.createDataFrame([(i, p, s, start or day(2015, 1, 1), day(2020, 1, 1), limit) for i, p, s, start, limit in bills], "bill_id INT, policy STRING, sum_insured BIGINT, started DATE, admitted DATE, room_limit BIGINT")
    rows = spark.createDataFrame(lines, "bill_id INT, line_no INT, item STRING, cents BIGINT, qty INT")
    listed = spark.createDataFrame([(1, "gloves"), (2, "ambulance (any)")], "no INT, name STRING")
    return {(r["bill_id"], r["line_no"]): (r["rule"], r["expected"], r["clause_id"], r["why"]) for r in D.derive_key(rows, b, listed, TABLE).collect()}


def test_rules(spark):
    start = datetime.date(2018, 1, 2)
    bills = [(1, "a", 100, None, None), (2, "a", 500, None, None), (3, "b", 100, start, None), (4, "a", 100, None, 100_000), (5, "a", 500, None, None), (6, "c", 1, None, None)]
    lines = [
        (1, 1, "Room rent", 1_000_000, 4), (1, 2, "Surgeon fee", 12_345_651, 1), (1, 3, "Gloves", 500, 1), (1, 4, "Ambulance", 80_000, 1), (1, 5, "Registration", 10, 1), (1, 6, None, 7, 1),
        (2, 1, "Room rent (deluxe)", 900, 1), (2, 2, "Surgeon fee", 5, 1), (2, 3, "Ambulance", 80_000, 1), (2, 4, "Physio", 9, 1), (2, 5, "ICU", 9, 1),
        (3, 1, "Hernia repair", 5, 1), (3, 2, "Room rent", 5, 1),
        (4, 1, "Room rent 2,000 x 3 days", 600_000, 3), (4, 2, "Surgeon fee", 101, 1),
        (5, 1, "Room rent (shared)", 900, 1), (5, 2, "Surgeon fee", 5, 1),
        (6, 1, "Room rent", 900, 0), (6, 2, "Surgeon fee", 5, 1),
    ]
    got = derive(spark, bills, lines)
    assert got[1, 1] == ("room", 800_000, "A.1", "A.1: min(10,000, 2,000 x 4) = 8,000")
    assert got[1, 2] == ("follows", 9_876_521, "A.2", "A.2: 1,23,456.51 x 8,000/10,000 = 98,765.21")
    assert got[1, 3] == ("list", 0, "LIST", "LIST: nil")
    assert got[1, 4] == ("ambulance", 75_000, "A.8", "A.8: min(800, 750) = 750")
    assert got[1, 5][:3] == ("registration", 0, "A.31") and got[1, 6][:3] == ("other", 7, "A.1")
    # A category instead of a figure: above it neither the room nor what follows it can be decided; no stated cap either.
    assert [got[2, k][:3] for k in (1, 2, 3, 4, 5)] == [("room open", None, "A.1"), ("follows open", None, "A.2"), ("ambulance", None, "A.8"), ("physio", None, None), ("icu", 9, "A.1")]
    assert got[3, 1][:3] == ("waiting", 0, "B.3") and got[3, 2][:3] == ("waiting", 0, "B.3")  # a month short, by a day
    assert got[4, 1][:2] == ("room", 300_000) and got[4, 2] == ("follows", 51, "A.2", "A.2: 1.01 x 1,000/2,000 = 0.51")  # half up
    assert got[5, 1][:2] == ("room full", 900) and got[5, 2][:2] == ("other", 5)
    assert got[6, 1][:3] == ("room full", 900, None) and got[6, 2][:3] == ("other", 5, None)


def test_empty_tables_and_bad_rules(spark):
    assert derive(spark, [], []) == {}
    for wrong in ({"outcome": "some"}, {"outcome": "cap"}, {"outcome": "nil", "when": "rain"}):
        with pytest.raises(ValueError):
            R("x", **wrong)


def test_rupees(spark):
    got = spark.createDataFrame([(k,) for k in (0, 5, 100, 99_999, 10_000_000, 123_456_789_00)], "c BIGINT").select(D.rupees(F.col("c")).alias("r")).collect()
    assert [r["r"] for r in got] == ["0", "0.05", "1", "999.99", "1,00,000", "12,34,56,789"]
