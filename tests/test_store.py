"""The store of results: runs apart, invalid rows, repeated parts, repeated contents, an empty store."""

from pyspark.sql import functions as F

from ledgerlake.operators import memo as M
from ledgerlake.plans.scratch import stored as kept


def run(spark, path, rows, factor, calls, part=None):
    df = spark.createDataFrame(rows, "id INT, x INT")

    def compute(asked):
        calls.append(sorted(r["x"] for r in asked.select(F.coalesce("x", F.lit(-1)).alias("x")).collect()))
        return asked.select("key", F.expr(f"x * {factor}").alias("y"))

    got = M.memoise_in(df, path, {"factor": factor}, ["x"], compute, "y INT", F.col("y") > 0, part)
    return sorted((r["id"], r["y"], r["replayed"]) for r in got.collect())


def test_a_run_replays_its_own_rows_only(spark, tmp_path):
    path, calls = str(tmp_path / "store"), []
    assert run(spark, path, [(1, 5), (2, 5), (3, 7)], 2, calls) == [(1, 10, False), (2, 10, False), (3, 14, False)]
    assert run(spark, path, [(1, 5)], 3, calls) == [(1, 15, False)]
    assert run(spark, path, [(4, 5), (5, 8)], 2, calls) == [(4, 10, True), (5, 16, False)]
    assert calls == [[5, 7], [5], [8]]  # equal contents are computed once
    stored = M.read_store(spark, path, "key STRING, y INT")
    assert sorted(r["y"] for r in stored.collect()) == [10, 14, 15, 16]


def test_invalid_and_null_results_come_back_and_are_not_kept(spark, tmp_path):
    path, calls = str(tmp_path / "store"), []
    for _ in range(2):
        got = run(spark, path, [(1, -3), (2, None), (3, 4)], 2, calls)
    assert got == [(1, -6, False), (2, None, False), (3, 8, True)]
    assert calls == [[-3, -1, 4], [-3, -1]]


def test_a_repeated_part_keeps_its_rows_and_other_parts_stay(spark, tmp_path):
    path, calls = str(tmp_path / "store"), []
    run(spark, path, [(1, 1)], 2, calls, "a")
    run(spark, path, [(2, 2)], 2, calls, "b")
    run(spark, path, [(1, 1), (3, 3)], 2, calls, "a")
    assert run(spark, path, [(1, 1), (2, 2), (3, 3)], 2, calls, "a") == [(1, 2, True), (2, 4, True), (3, 6, True)]
    assert calls == [[1], [2], [3], []]
    stored = M.read_store(spark, path, "key STRING, y INT")
    assert sorted((r["part"], r["y"]) for r in stored.collect()) == [("a", 2), ("a", 6), ("b", 4)]


def test_a_run_reads_its_own_folders_only(spark, tmp_path):
    path = str(tmp_path / "store")
    run(spark, path, [(1, 1)], 2, [])
    run(spark, path, [(1, 1)], 3, [])
    mine = M.read_store(spark, path, "key STRING, y INT", M.identity({"factor": 2}))
    assert "PartitionFilters: [isnotnull(fingerprint" in mine._jdf.queryExecution().toString()
    assert [r["y"] for r in mine.collect()] == [2]
    assert M.read_store(spark, str(tmp_path / "none"), "y INT").count() == 0


def test_rows_move_once_and_without_their_key(spark, tmp_path, monkeypatch):
    plans = []
    monkeypatch.setattr(M, "stored", lambda df, path, *rest: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, path, *rest))
    df = spark.range(40).selectExpr("id", "id % 30 AS x")
    for rows in (df.where("id < 5"), df):
        got = M.memoise_in(rows, str(tmp_path / "store"), {}, ["x"], lambda d: d.select("key", F.expr("x * 2 AS y")), "y BIGINT", F.lit(True))
    # The second run: its rows and what is stored, each shuffled by an expression (so without the key), and the same exchanges again where contents are asked.
    moved = [line for line in plans[-1].splitlines() if "Exchange" in line and "Reused" not in line]
    assert moved and all("hashpartitioning(" in m and "REPARTITION_BY_COL" in m for m in moved)
    assert len({m.split("hashpartitioning(")[1].split("#")[0] for m in moved}) == 2 and "isnotnull(coalesce(sha2" not in plans[-1]
    assert sorted((r["id"], r["y"], r["replayed"]) for r in got.collect()) == [(i, i % 30 * 2, i % 30 < 5) for i in range(40)]
