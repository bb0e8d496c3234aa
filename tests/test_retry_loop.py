"""How lines leave the retry loop: an answer, an unknown citation, too many calls, equal searches, too many attempts."""

from pyspark.sql import functions as F

from ledgerlake.operators import judging as J
from ledgerlake.plans.scratch import stored


def test_every_way_out(spark, tmp_path):
    lines = spark.createDataFrame([(k, 1) for k in range(1, 8)], "bill_id LONG, line_no INT")
    # (line, attempt, clause, calls, decision)
    script = [
        (1, 0, 10, 1, "save"), (2, 0, 99, 1, "abstain"), (3, 0, 10, 1, "rewrite"), (3, 1, 11, 1, "save"),
        (4, 0, 10, 4, "rewrite"), (4, 1, 11, 2, "rewrite"), (4, 2, 12, 1, "save"),
        (5, 0, 10, 1, "rewrite"), (5, 1, 10, 1, "save"), *[(6, k, 10 + k, 1, "rewrite") for k in range(3)],
    ]
    rows = spark.createDataFrame(script, "bill_id LONG, attempt INT, clause_id LONG, calls INT, decision STRING").withColumn("line_no", F.lit(1))
    asked = []

    def search(open_, attempt):
        asked.append(sorted(r["bill_id"] for r in open_.collect()))
        return rows.where(F.col("attempt") == attempt).join(open_, J.KEYS).select(*J.KEYS, "clause_id", "calls", "decision")

    def judge(found):
        return found.select(*J.KEYS, "clause_id", F.array().cast(J.LIMITS).alias("limits"), "decision", (F.col("clause_id") != 99).alias("known"))

    got = J.retry_loop(lines, search, judge, lambda df, name: stored(df, f"{tmp_path}/{name}")).collect()
    assert {r["bill_id"]: (r["clause_id"], r["attempts"], r["calls"], r["reason"]) for r in got} == {
        1: (10, 1, 2, None), 2: (None, None, 2, "fabricated"), 3: (11, 2, 4, None), 4: (None, None, 8, "call cap"),
        5: (None, None, 3, "repeated searches"), 6: (None, None, 6, "attempts"), 7: (None, None, 6, "attempts"),
    }
    assert len(got) == 7 and asked == [[1, 2, 3, 4, 5, 6, 7], [3, 4, 5, 6, 7], [6, 7]]
