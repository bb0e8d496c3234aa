"""Queries of judging: benchmark passages stand for lines, reranked documents for their candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.operators import judging as J
from ledgerlake.operators import retrieval as R
from ledgerlake.operators.rules import Pack
from ledgerlake.plans import views as V
from ledgerlake.plans.q_retrieval import _BM25, _CHUNKS, _OVER, _candidates, _queries, _reranked
from ledgerlake.plans.registry import register
from ledgerlake.plans.scratch import folder, stored

PLAIN = Pack(exclusion="worthless", defers="token", default="Licensed")


@register("states_exclusion", "SELECT doc_id AS clause_id, contains(text, 'worthless') AS excludes FROM documents")
def states_exclusion(spark, sf_dir):
    return V.clauses(spark, sf_dir).select("clause_id", J.states_exclusion(F.col("text"), PLAIN).alias("excludes"))


#: Two of three clauses state limits, among figures that are none.
_STATED = """concat(text, CASE clause_id % 3 WHEN 0 THEN ' Up to 5% of the sum insured or Rs 2,00,000 per day from 2024.' WHEN 1 THEN ' A limit of Rs. 1,500/- or INR 750.50 daily, code 400001' ELSE '' END)"""
_HITS = f"{_CHUNKS}, {_BM25}, {_OVER}, hits AS (SELECT rr.*, {_STATED.replace('text,', 'd.text,').replace('clause_id', 'rr.clause_id')} AS text FROM rr JOIN documents d ON d.doc_id = rr.clause_id)"


def _hits(spark, sf_dir):
    found = _reranked(spark, sf_dir).withColumnRenamed("query_id", "bill_id").withColumn("line_no", F.lit(1))
    texts = V.clauses(spark, sf_dir).selectExpr("clause_id", f"{_STATED} AS text")
    return stored(texts.join(R.near(found), "clause_id"), folder(spark, "hits"))


@register("defers_to_schedule", f"WITH {_HITS} SELECT query_id AS bill_id, 1 AS line_no, bool_or(contains(text, 'token') AND NOT contains(text, 'Licensed')) AS defers FROM hits GROUP BY query_id")
def defers_to_schedule(spark, sf_dir):
    return J.defers_to_schedule(_hits(spark, sf_dir), PLAIN)


_JUDGED = f"""{_HITS}, jd AS (SELECT query_id, clause_id, list_transform(regexp_extract_all(text, '{J.AMOUNT}', 0), lambda m: CAST(round(CAST(replace(regexp_extract(m, '{J.FIGURE}', 1), ',', '') AS DOUBLE) * 100) AS BIGINT)) AS limits,
  list_transform(regexp_extract_all(text, '{J.SHARE}', 1), lambda m: CAST(m AS INTEGER)) AS shares, len(list_filter(regexp_extract_all(text, '{J.AMOUNT}', 0), lambda m: regexp_matches(m, '{J.DAILY}'))) AS daily, score >= 300000 AS confident, text FROM hits WHERE rank = 1)"""


@register("judge", f"WITH {_JUDGED} SELECT query_id AS bill_id, 1 AS line_no, clause_id, CAST(len(limits) + len(shares) AS INTEGER) AS n_limits, list_min(limits) AS lowest, list_min(shares) AS share, CAST(daily AS INTEGER) AS daily, confident FROM jd")
def judge(spark, sf_dir):
    judged = J.default_judge(_hits(spark, sf_dir))
    return judged.select(
        "bill_id", "line_no", "clause_id", F.size("limits").alias("n_limits"), F.array_min(F.transform("limits", lambda x: x["amount"])).alias("lowest"),
        F.array_min(F.transform("limits", lambda x: x["percentage"])).alias("share"), F.size(F.filter("limits", lambda x: x["basis"] == "per_day")).alias("daily"), "confident",
    )


def _graded(spark, sf_dir):
    """Judgements of which some cite another policy's clause, some a zero limit and some a per-day limit."""
    hits = _hits(spark, sf_dir)
    judged = J.default_judge(hits).withColumn("policy", F.concat(F.lit("src"), F.col("bill_id") % 20))
    odd = "CASE bill_id % 5 WHEN 0 THEN clause_id + 1 ELSE clause_id END"
    limits = "CASE bill_id % 4 WHEN 1 THEN array(named_struct('amount', 0L, 'percentage', CAST(NULL AS INT), 'basis', 'total')) WHEN 2 THEN array(named_struct('amount', 5L, 'percentage', CAST(NULL AS INT), 'basis', 'per_day')) ELSE limits END"
    judged = judged.withColumns({"clause_id": F.expr(odd), "limits": F.expr(limits)})
    known = J.guard_unknown_citation(judged, V.clauses(spark, sf_dir))
    cited = stored(judged.select("clause_id").distinct(), folder(spark, "cited"))
    texts = V.clauses(spark, sf_dir).select("clause_id", "text").join(R.near(cited), "clause_id", "left_semi").hint("merge")
    joined = known.join(texts, "clause_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    flags = joined.withColumns({
        "room_cap": J.guard_room_cap(F.expr("bill_id % 3 = 0"), F.contains(F.col("text"), F.lit("the"))), "zero": J.guard_zero_limit(F.col("text"), PLAIN),
    })
    return J.grade(flags.join(J.defers_to_schedule(hits, PLAIN), J.KEYS))


_GRADED = f"""{_JUDGED}, o AS (SELECT query_id, CASE WHEN query_id % 5 = 0 THEN clause_id + 1 ELSE clause_id END AS clause_id, confident, daily FROM jd),
  df AS (SELECT query_id, bool_or(contains(text, 'token') AND NOT contains(text, 'Licensed')) AS defers FROM hits GROUP BY 1),
  g AS (SELECT o.*, d.source IS NOT NULL AND d.source = 'src' || (query_id % 20) AS known, coalesce(d.text, '') AS t, defers FROM o LEFT JOIN documents d ON d.doc_id = o.clause_id JOIN df USING (query_id)),
  fg AS (SELECT *, (query_id % 4 = 2 OR (query_id % 4 <> 1 AND daily > 0)) AND query_id % 3 <> 0 AND contains(t, 'the') AS room_cap, query_id % 4 = 1 AND NOT contains(t, 'worthless') AS zero FROM g)"""


@register("guard_unknown_citation", f"WITH {_GRADED} SELECT query_id AS bill_id, clause_id, known FROM fg")
def guard_unknown_citation(spark, sf_dir):
    return _graded(spark, sf_dir).select("bill_id", "clause_id", "known")


@register("guard_room_cap", f"WITH {_GRADED} SELECT query_id AS bill_id, room_cap FROM fg")
def guard_room_cap(spark, sf_dir):
    return _graded(spark, sf_dir).select("bill_id", F.coalesce("room_cap", F.lit(False)).alias("room_cap"))


@register("guard_zero_limit", f"WITH {_GRADED} SELECT query_id AS bill_id, zero FROM fg")
def guard_zero_limit(spark, sf_dir):
    return _graded(spark, sf_dir).select("bill_id", "zero")


@register("grade", f"""WITH {_GRADED} SELECT query_id AS bill_id, CASE WHEN NOT known THEN 'abstain' WHEN NOT confident OR room_cap OR zero THEN 'rewrite' WHEN defers THEN 'abstain' ELSE 'save' END AS decision FROM fg""")
def grade(spark, sf_dir):
    return _graded(spark, sf_dir).select("bill_id", "decision")


@register("abstain_reason", f"""WITH {V.LINES} SELECT bill_id, line_no, CASE WHEN bill_id % 7 = 0 THEN 'fabricated' WHEN bill_id % 5 = 0 THEN 'repeated searches' WHEN qty >= 8 THEN 'call cap' WHEN line_no >= 3 THEN 'attempts' ELSE 'detail' END AS reason FROM lines""")
def abstain_reason(spark, sf_dir):
    lines = V.bill_lines(spark, sf_dir)
    return lines.select("bill_id", "line_no", J.abstain_reason(F.expr("bill_id % 7 = 0"), F.expr("bill_id % 5 = 0"), F.col("qty"), F.col("line_no")).alias("reason"))


_SCORES = f"""{_CHUNKS}, {_BM25}, {_OVER}, ra AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, clause_id) AS k FROM sc)"""


@register("retry_loop", f"""WITH {_SCORES}, rounds AS (SELECT query_id, clause_id, score, k, (k - 1) // 3 AS attempt FROM ra WHERE k <= 9), best AS (SELECT * FROM rounds WHERE (k - 1) % 3 = 0 AND score >= 100000)
  SELECT item_id AS bill_id, 1 AS line_no, arg_min(clause_id, attempt) AS clause_id, CAST(min(attempt) + 1 AS INTEGER) AS attempts, CASE WHEN count(clause_id) = 0 THEN 'attempts' END AS reason
  FROM benchmark b LEFT JOIN best ON best.query_id = b.item_id GROUP BY item_id""")
def retry_loop(spark, sf_dir):
    candidates = _all_scores(spark, sf_dir)
    ranked = stored(R.top_k(candidates, 9), folder(spark, "ranked")).withColumnRenamed("query_id", "bill_id").withColumn("line_no", F.lit(1))
    lines = _queries(spark, sf_dir).selectExpr("query_id AS bill_id", "1 AS line_no")
    path = folder(spark, "rounds")
    search = lambda open_, attempt: ranked.where((F.col("rank") - 1 >= 3 * attempt) & (F.col("rank") <= 3 * attempt + 3)).join(open_.select(*J.KEYS), J.KEYS)

    def judge(found):
        best = found.groupBy(*J.KEYS).agg(F.min_by(F.struct("clause_id", "score"), "rank").alias("b"))
        return best.select(*J.KEYS, "b.clause_id", F.array().cast(J.LIMITS).alias("limits"), (F.col("b.score") >= 100_000).alias("confident"))

    done = J.retry_loop(lines, search, judge, lambda df, name: stored(df, f"{path}/{name}"))
    return done.select("bill_id", "line_no", "clause_id", "attempts", "reason")


def _all_scores(spark, sf_dir):
    scored = _candidates(spark, sf_dir).withColumn("score", R.overlap(F.col("q_words"), F.col("words")))
    return scored.groupBy("query_id", "clause_id").agg(F.max("score").alias("score"))


@register("naive_audit", f"""WITH {_JUDGED} SELECT b.item_id AS bill_id, 1 AS line_no, clause_id, CASE WHEN coalesce(confident, false) THEN CAST(least(b.item_id * 100000, list_min(limits), list_min(shares) * 100000) AS BIGINT) END AS allowed
  FROM benchmark b LEFT JOIN jd ON jd.query_id = b.item_id""")
def naive_audit(spark, sf_dir):
    lines = V.table(spark, sf_dir, "benchmark").selectExpr("item_id AS bill_id", "1 AS line_no", "item_id * 100000 AS cents", "1 AS qty", "100000L AS sum_insured")
    return J.naive_audit(lines, J.default_judge(_hits(spark, sf_dir)))
