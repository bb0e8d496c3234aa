"""The audit with searches. Documents are clauses of the five policies, with wording of limits, exclusions and schedules added by slot."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.operators import agent as G
from ledgerlake.operators.rules import PACK, deduction_clauses, not_payable_list, waiting_terms
from ledgerlake.plans import views as V
from ledgerlake.plans.q_adjudicate import _DED, _ENTITLED, _LIST, _WAIT, _entitlement
from ledgerlake.plans.registry import register
from ledgerlake.plans.scratch import folder, stored

POLICIES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
_POLICY = f"CASE doc_id % 5 {' '.join(f'WHEN {i} THEN {p!r}' for i, p in enumerate(POLICIES))} END"
#: What the clause of a slot says beside its text.
_WORDING = """concat(text, CASE slot % 6 WHEN 0 THEN ' Up to 5% of the sum insured or Rs 2,00,000 per day from 2024.' WHEN 1 THEN ' For gear Rs 1,500 per day.'
  WHEN 2 THEN ' A limit of Rs 0.' WHEN 3 THEN ' This is not covered: Rs 0.' WHEN 4 THEN ' As the schedule says.' ELSE '' END)"""
#: Every eleventh slot cites a document of another policy.
_CITED, _SCORE = "d + CASE WHEN slot % 11 = 0 THEN 1 ELSE 0 END", "(slot * 7) % 10 * 100000"
_SLOT = "(length(item) + qty + 5 * attempt * (qty % 3)) % 24"


def _slots(spark, sf_dir):
    """(policy, slot, d, clause_id, text, score): the clause that a search of the slot finds."""
    docs = V.table(spark, sf_dir, "documents").selectExpr(f"{_POLICY} AS policy", "CAST(doc_id DIV 5 % 24 AS INT) AS slot", "doc_id", "text")
    first = docs.groupBy("policy", "slot").agg(F.min_by(F.struct("doc_id", "text"), "doc_id").alias("b"))
    found = first.select("policy", "slot", F.col("b.doc_id").alias("d"), F.col("b.text").alias("text"))
    return stored(found.selectExpr("policy", "slot", "d", f"{_CITED} AS clause_id", f"{_WORDING} AS text", f"{_SCORE} AS score", "1 AS rank"), folder(spark, "slots"))


def _audited(spark, sf_dir):
    slots = _slots(spark, sf_dir)
    lines, bills = V.lines_of_bills(spark, sf_dir), V.bills(spark, sf_dir)
    own = stored(lines.select(*G.KEYS, "policy", "item", "qty", "cents", "sum_insured"), folder(spark, "own"))
    third = slots.where("slot = 9").select("policy", F.col("d").cast("string").alias("third"))
    terms = waiting_terms(spark).join(third, "policy", "left").withColumn("initial_clause", F.coalesce("third", "initial_clause")).drop("third")
    clauses = slots.select("policy", F.col("d").alias("clause_id"), "text")
    entitled = _entitlement(spark, sf_dir).withColumn("clause_id", F.lit("R.1"))

    def search(open_, attempt):
        asked = open_.withColumn("attempt", F.lit(attempt)).withColumn("slot", F.expr(_SLOT)).select(*G.KEYS, "policy", "item", "slot")
        # One clause for each policy and slot: 120 rows at most.
        return asked.join(F.broadcast(slots.drop("text")), ["policy", "slot"]).select(*G.KEYS, "policy", "item", "clause_id", "score", "rank")

    return G.audit_with_searches(own, bills, terms, not_payable_list(spark), entitled, deduction_clauses(spark), search, G.graded(own, clauses))


_ROOM = r"\bgear\b"
_AGENT = rf"""{_WAIT}, {_ENTITLED.removeprefix(V.BOTH + ", ")}, {_DED}, {_LIST},
  hit AS (SELECT bill_id, line_no, min(no) AS no FROM lines JOIN entries ON contains(item, name) GROUP BY ALL HAVING min(no) <> 4),
  docs AS (SELECT {_POLICY} AS policy, CAST(doc_id // 5 % 24 AS INTEGER) AS slot, doc_id, text FROM documents),
  firsts AS (SELECT policy, slot, min(doc_id) AS d, arg_min(text, doc_id) AS text FROM docs GROUP BY ALL),
  slots AS (SELECT policy, slot, d, {_CITED} AS clause_id, {_WORDING} AS text, {_SCORE} AS score FROM firsts),
  third AS (SELECT policy, CAST(d AS VARCHAR) AS third FROM slots WHERE slot = 9),
  r AS (SELECT lb.bill_id, lb.policy, line_no, item, cents, qty, lb.sum_insured, waiting, waiting IN ('specified', 'initial') AS nil, no IS NOT NULL AS listed, source, per_day, ent.category AS cat, coalesce(third, 'W.3') AS w3,
      item LIKE '% gear' AS room FROM lb JOIN waiting USING (bill_id) LEFT JOIN ent USING (bill_id) LEFT JOIN hit USING (bill_id, line_no) LEFT JOIN third ON third.policy = lb.policy),
  st AS (SELECT *, CASE WHEN nil THEN 'waiting' WHEN listed THEN 'list' WHEN room AND source IS NOT NULL THEN 'room' ELSE 'judged' END AS stage,
      CASE WHEN per_day IS NOT NULL THEN least(cents, per_day * qty) WHEN cat IS NOT NULL THEN CASE WHEN list_position(['small', 'red', 'blue', 'large', 'green'], split_part(item, ' ', 1)) <= list_position(['small', 'red', 'blue', 'large', 'green'], cat) THEN cents END
        WHEN source = 'at_actuals' THEN cents END AS room_allowed FROM r),
  tries AS (SELECT st.bill_id, line_no, attempt, room, qty, s.clause_id, s.slot, s.text, s.score, CASE WHEN s.slot IS NULL THEN 'none' WHEN s.slot % 11 = 0 THEN 'abstain' WHEN s.score < 300000 THEN 'rewrite'
      WHEN s.slot % 6 IN (0, 1) AND regexp_matches(s.text, '{_ROOM}') AND NOT room THEN 'rewrite' WHEN s.slot % 6 IN (2, 3) AND NOT regexp_matches(s.text, '{PACK.exclusion}') THEN 'rewrite'
      WHEN s.slot % 6 IN (4, 5) AND regexp_matches(s.text, '{PACK.defers}') AND NOT regexp_matches(s.text, '{PACK.default}') THEN 'abstain' ELSE 'save' END AS decision
    FROM st CROSS JOIN (VALUES (0), (1), (2)) a(attempt) LEFT JOIN slots s ON s.policy = st.policy AND s.slot = {_SLOT} WHERE stage = 'judged'),
  kept AS (SELECT * FROM tries WHERE attempt = 0 OR qty % 3 <> 0 OR decision = 'none'),
  ended AS (SELECT bill_id, line_no, min(attempt) FILTER (decision IN ('save', 'abstain')) AS att, arg_min(decision, attempt) FILTER (decision IN ('save', 'abstain')) AS decision,
      arg_min(slot, attempt) FILTER (decision IN ('save', 'abstain')) AS slot, arg_min(clause_id, attempt) FILTER (decision IN ('save', 'abstain')) AS cited, count(*) = 1 AS once FROM kept GROUP BY ALL),
  al AS (SELECT st.*, e.att, e.decision, e.slot, CASE WHEN e.decision = 'save' THEN CAST(e.cited AS VARCHAR) END AS cited, e.decision = 'save' AS saved,
      CASE WHEN stage <> 'judged' THEN 0 WHEN e.att IS NOT NULL THEN 2 * (e.att + 1) WHEN once THEN 3 ELSE 6 END AS calls,
      CASE WHEN stage <> 'judged' OR e.decision = 'save' THEN NULL WHEN e.decision = 'abstain' THEN CASE WHEN e.slot % 11 = 0 THEN 'fabricated' ELSE 'detail' END WHEN once THEN 'repeated searches' ELSE 'attempts' END AS reason,
      CASE WHEN stage = 'room' THEN room_allowed WHEN e.decision = 'save' THEN CASE e.slot % 6 WHEN 0 THEN least(cents, sum_insured * 5, 20000000 * qty) WHEN 1 THEN least(cents, 150000 * qty) WHEN 2 THEN 0 WHEN 3 THEN 0 ELSE cents END END AS a0,
      CASE WHEN stage = 'room' THEN per_day WHEN e.decision = 'save' THEN CASE e.slot % 6 WHEN 0 THEN 20000000 WHEN 1 THEN 150000 END END AS pd FROM st LEFT JOIN ended e USING (bill_id, line_no)),
  ov AS (SELECT *, room AND stage IN ('room', 'judged') AND coalesce(cents > pd * qty, false) AS over_limit, stage = 'judged' AND coalesce(a0 = 0 AND cited = w3, false) AS expired FROM al),
  worst AS (SELECT DISTINCT ON (bill_id) bill_id, pd * greatest(qty, 1) AS lim, cents AS chg FROM ov WHERE over_limit ORDER BY bill_id, CAST(pd * greatest(qty, 1) AS HUGEINT) * 1000000000000000000 // cents, line_no),
  sc AS (SELECT ov.*, lim, chg, clause, lim IS NOT NULL AND clause IS NOT NULL AND a0 IS NOT NULL AND NOT expired AND NOT over_limit AND (item LIKE '% widget' OR item LIKE '% ring') AND stage IN ('room', 'judged') AS scaled
    FROM ov LEFT JOIN worst USING (bill_id) LEFT JOIN ded ON ded.policy = ov.policy),
  fin AS (SELECT bill_id, policy, line_no, stage, CAST(calls AS INTEGER) AS calls, CASE WHEN saved THEN CAST(att + 1 AS INTEGER) END AS attempts, coalesce(saved AND att > 0, false) AS changed, reason, expired,
      CAST(CASE WHEN stage IN ('waiting', 'list') THEN 0 WHEN expired THEN NULL WHEN scaled THEN (2 * CAST(a0 AS HUGEINT) * lim + chg) // (2 * CAST(chg AS HUGEINT)) ELSE a0 END AS BIGINT) AS allowed,
      CASE WHEN stage = 'waiting' THEN CASE waiting WHEN 'specified' THEN 'W.2' ELSE w3 END WHEN stage = 'list' THEN NULL WHEN scaled THEN clause WHEN stage = 'room' THEN 'R.1' ELSE cited END AS clause_id FROM sc)"""


@register("audit_with_searches", f"WITH {_AGENT} SELECT bill_id, line_no, allowed, clause_id, stage, attempts, calls, changed, stage <> 'judged' AS fast_path, allowed IS NULL AS abstained, expired FROM fin")
def audit_with_searches(spark, sf_dir):
    done = _audited(spark, sf_dir).withColumn("expired", F.col("why").contains("is a waiting period, but"))
    return done.select("bill_id", "line_no", "allowed", "clause_id", "stage", "attempts", "calls", "changed", "fast_path", "abstained", "expired")


@register("line_summary", f"WITH {_AGENT} SELECT policy, stage, count(*) AS lines, CAST(sum(calls) AS BIGINT) AS calls, count(*) FILTER (changed) AS changed, count(*) FILTER (allowed IS NULL) AS abstained FROM fin GROUP BY ALL")
def line_summary(spark, sf_dir):
    return G.line_summary(_audited(spark, sf_dir))
