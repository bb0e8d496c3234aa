"""Models as hooks, fitted vectors, and vector search by hashing against the exact way."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import retrieval as R


def test_a_model_gives_vectors_and_null_texts_are_empty(spark):
    def lengths():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([(1, "ab"), (2, None)], "i int, text string")
    assert [r["vec"] for r in R.embed_with(df, lengths, prefix="q:").orderBy("i").collect()] == [[4.0, 1.0], [2.0, 1.0]]


def test_a_model_reranks(spark):
    def same_start():
        return lambda queries, texts: [float(q[0] == t[0]) for q, t in zip(queries, texts)]

    rows = [(1, "p", c, 0, "apple", t) for c, t in ((1, "boat"), (2, "arch"), (3, "ant"))]
    pairs = spark.createDataFrame(rows, "query_id int, policy string, clause_id int, window int, query_text string, text string")
    best = R.rerank(pairs, 2, lambda df: R.score_with(df, same_start), matched=True).orderBy("rank").collect()
    assert [(r["clause_id"], r["matched"]) for r in best] == [(2, "arch"), (3, "ant")]


def test_fitted_vectors_number_by_number(spark):
    rows = [(1, "room rent room"), (2, "rent"), (3, "the room"), (4, " .. "), (5, None)]
    df = spark.createDataFrame(rows, "i int, text string")
    idf = R.fit_idf(df, ["i"], size=1 << 20)
    weight = {"room": math.log(6 / 3), "rent": math.log(6 / 3), "the": math.log(6 / 2)}
    got = {r["i"]: [x for x in r["vec"] if x] for r in R.embed(df, ["i"], R.fit_idf(df, ["i"]), prefix="").collect()}
    norm = math.hypot(2 * weight["room"], weight["rent"])
    assert sorted(got[1]) == pytest.approx(sorted([2 * weight["room"] / norm, weight["rent"] / norm])) and got[4] == got[5] == []
    assert idf.count() == 3


def test_hashing_finds_what_all_pairs_find(spark):
    rnd = random.Random(6)
    centres = [[rnd.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = []
    for i in range(600):
        v = [x + rnd.gauss(0, 0.1) for x in centres[i % 12]]
        n = math.sqrt(sum(x * x for x in v))
        rows.append(("p" if i % 3 else "q", i, [x / n for x in v]))
    known = spark.createDataFrame(rows, "policy string, clause_id int, vec array<double>")
    asked = known.where("clause_id % 20 = 0").withColumnRenamed("clause_id", "query_id")
    exact, found = R.dense_topk(asked, known, 5), R.lsh_topk(asked, known, 5, width=0.5, tables=16)
    told = R.recall_of(found, exact).agg(F.sum("n"), F.sum("hit")).first()
    assert told[0] == 150 and told[1] >= 0.9 * told[0]
    policy = {i: p for p, i, _ in rows}
    assert all(r["policy"] == policy[r["clause_id"]] == policy[r["query_id"]] for r in found.collect())


def test_search_adds_references_with_their_text(spark):
    clauses = spark.createDataFrame([("p", 1, "room rent is paid up to a limit"), ("p", 2, "x" * 2000), ("q", 1, "room rent of another policy")], "policy string, clause_id long, text string")
    refs = spark.createDataFrame([("p", 1, [2, 9])], "policy string, clause_id long, refs array<long>")
    asked = spark.createDataFrame([(7, "p", "room rent")], "query_id long, policy string, text string")
    rows = R.search(asked, clauses, refs, lambda df, _: df.cache(), top_n=1).collect()
    assert [(r["policy"], r["clause_id"], r["via_ref_of"], len(r["matched"])) for r in sorted(rows, key=lambda r: r["clause_id"])] == [("p", 1, None, 31), ("p", 2, 1, 900)]
