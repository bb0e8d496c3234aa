"""Queries of the adjudication rules, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.operators import adjudicate as A
from ledgerlake.operators.rules import PACK, deduction_clauses, not_payable_list, room_caps, waiting_terms
from ledgerlake.plans import views as V
from ledgerlake.plans.registry import register

_CAPS = "caps(policy, cap_rate) AS (VALUES " + ", ".join(f"('{k}', {v})" for k, v in sorted(PACK.caps.items())) + ")"
_LIST = "entries(no, name) AS (VALUES (1, 'anvil'), (2, 'small anvil'), (3, 'red ring'), (4, 'bolt'))"
_DED = "ded(policy, clause) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in sorted(PACK.deductions.items())) + ")"
_CAPPED = f"""{V.BOTH}, {_CAPS}, capped AS (
  SELECT lb.*, CASE WHEN item LIKE '% gear' THEN sum_insured * cap_rate // 100 END AS per_day FROM lb JOIN caps USING (policy)
), decided AS (SELECT *, least(cents, coalesce(per_day * qty, cents)) AS allowed0, coalesce(cents > per_day * qty, false) AS over_limit FROM capped)"""
_SECOND = f"""{_CAPPED}, worst AS (
  SELECT DISTINCT ON (bill_id, policy) bill_id, policy, per_day * greatest(qty, 1) AS lim, cents AS chg FROM decided WHERE over_limit
  ORDER BY bill_id, policy, CAST(CAST(per_day * greatest(qty, 1) AS HUGEINT) * 1000000000000000000 // cents AS HUGEINT), line_no
), {_DED}, told AS (
  SELECT decided.*, lim, chg, clause, CASE WHEN lim IS NULL THEN 'no per-day cap was breached' WHEN clause IS NULL THEN 'no clause states the deduction' WHEN over_limit THEN 'the room line itself'
      WHEN item LIKE '% gear' OR item LIKE '% gizmo' THEN 'outside the associated expenses' WHEN NOT (item LIKE '% widget' OR item LIKE '% ring') THEN 'not named by the definition' END AS why
  FROM decided LEFT JOIN worst USING (bill_id, policy) LEFT JOIN ded USING (policy)
), passed AS (
  SELECT *, why IS NULL AS scaled, CASE WHEN why IS NULL THEN clause END AS deduction,
    CASE WHEN why IS NULL THEN CAST((2 * CAST(allowed0 AS HUGEINT) * lim + chg) // (2 * CAST(chg AS HUGEINT)) AS BIGINT) ELSE allowed0 END AS allowed FROM told
)"""
_WAIT = f"""{V.BOTH}, told AS (SELECT bill_id, bool_or(item LIKE 'black %') AS accident, bool_or(item LIKE '% rod') AS cond FROM lines GROUP BY bill_id),
served AS (
  SELECT bills.*, accident, cond, CAST((year(admitted) - year(started)) * 12 + month(admitted) - month(started)
    - (CASE WHEN day(admitted) < day(started) THEN 1 ELSE 0 END) AS INTEGER) AS months, CAST(admitted - started AS INTEGER) AS days
  FROM bills LEFT JOIN told USING (bill_id)
), waiting AS (
  SELECT *, CASE WHEN started IS NULL OR admitted IS NULL THEN 'not_assessed' WHEN coalesce(accident, false) THEN 'accident'
    WHEN coalesce(cond, false) AND policy <> 'MIDDLE EAST' AND months < {PACK.specified_months} THEN 'specified' WHEN days < {PACK.initial_days} THEN 'initial' ELSE 'served' END AS waiting
  FROM served
)"""


def _capped(spark, sf_dir):
    return A.cap_rooms(V.lines_of_bills(spark, sf_dir), room_caps(spark))


def _second(spark, sf_dir):
    return A.second_pass(_capped(spark, sf_dir), deduction_clauses(spark))


@register(
    "policy_totals",
    f"""WITH {_SECOND} SELECT policy, count(*) AS n_lines, CAST(sum(cents) AS BIGINT) AS charged, CAST(sum(allowed) AS BIGINT) AS allowed
    FROM passed GROUP BY policy""",
)
def policy_totals(spark, sf_dir):
    return _second(spark, sf_dir).groupBy("policy").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("cents").alias("charged"), F.sum("allowed").alias("allowed")
    )


@register("bill_lines", f"WITH {V.LINES} SELECT * FROM lines")
def bill_lines(spark, sf_dir):
    return V.bill_lines(spark, sf_dir)


_LIMITS = """CASE bill_id % 4 WHEN 0 THEN [] WHEN 1 THEN [1] WHEN 2 THEN [2] ELSE [1, 2] END"""
_LIMIT_ROWS = f"""{V.BOTH}, lim AS (SELECT bill_id, line_no, unnest({_LIMITS}) AS kind FROM lb), res AS (
  SELECT bill_id, line_no, min(CASE kind WHEN 1 THEN sum_insured ELSE 200000 * qty END) AS low,
    bool_or(kind = 2 AND cents > 200000 * qty) AS over, min(CASE WHEN kind = 2 THEN 200000 END) AS rate
  FROM lim JOIN lb USING (bill_id, line_no) GROUP BY ALL)"""


def _with_limits(spark, sf_dir):
    one, two = "named_struct('amount', CAST(NULL AS BIGINT), 'percentage', 1, 'basis', 'total')", "named_struct('amount', 200000L, 'percentage', CAST(NULL AS INT), 'basis', 'per_day')"
    limits = f"CASE bill_id % 4 WHEN 0 THEN array() WHEN 1 THEN array({one}) WHEN 2 THEN array({two}) ELSE array({one}, {two}) END"
    return V.lines_of_bills(spark, sf_dir).withColumn("limits", F.expr(f"CAST({limits} AS {A.LIMITS})"))


@register("resolve_limits", f"WITH {_LIMIT_ROWS} SELECT bill_id, line_no, CAST(low AS BIGINT) AS lowest FROM lb LEFT JOIN res USING (bill_id, line_no)")
def resolve_limits(spark, sf_dir):
    return A.resolve_limits(_with_limits(spark, sf_dir)).select("bill_id", "line_no", F.array_min("resolved").alias("lowest"))


@register(
    "allowed_amount",
    f"WITH {_LIMIT_ROWS} SELECT bill_id, line_no, CAST(least(cents, coalesce(low, cents)) AS BIGINT) AS allowed, coalesce(over, false) AS over_limit FROM lb LEFT JOIN res USING (bill_id, line_no)",
)
def allowed_amount(spark, sf_dir):
    return A.allowed_amount(_with_limits(spark, sf_dir)).select("bill_id", "line_no", "allowed", "over_limit")


@register("per_day_rate", f"WITH {_LIMIT_ROWS} SELECT bill_id, line_no, CAST(rate AS BIGINT) AS rate FROM lb LEFT JOIN res USING (bill_id, line_no)")
def per_day_rate(spark, sf_dir):
    return _with_limits(spark, sf_dir).select("bill_id", "line_no", A.per_day_rate().alias("rate"))


@register("apply_copay", f"WITH {_CAPPED} SELECT bill_id, line_no, CAST((allowed0 * (100 - grp * 5) + 50) // 100 AS BIGINT) AS allowed FROM decided")
def apply_copay(spark, sf_dir):
    return _capped(spark, sf_dir).select("bill_id", "line_no", A.apply_copay(F.col("allowed"), F.col("grp") * 5).alias("allowed"))


@register("cap_total", f"WITH {_CAPPED} SELECT bill_id, CAST(least(sum(allowed0), any_value(sum_insured) * 100) AS BIGINT) AS total FROM decided GROUP BY bill_id")
def cap_total(spark, sf_dir):
    totals = _capped(spark, sf_dir).groupBy("bill_id", "sum_insured").agg(F.sum("allowed").alias("t"))
    return totals.select("bill_id", A.cap_total(F.col("t"), F.col("sum_insured")).alias("total"))


@register(
    "non_payable_match",
    f"""WITH {V.LINES}, {_LIST}, hit AS (
      SELECT bill_id, line_no, min(no) AS list_no FROM lines JOIN entries ON contains(item, name) GROUP BY ALL HAVING min(no) <> 4)
    SELECT bill_id, line_no, list_no, CASE WHEN list_no IS NOT NULL THEN CAST(0 AS BIGINT) END AS allowed FROM lines LEFT JOIN hit USING (bill_id, line_no)""",
)
def non_payable_match(spark, sf_dir):
    done = A.non_payable_match(V.bill_lines(spark, sf_dir), not_payable_list(spark))
    return done.select("bill_id", "line_no", "list_no", "allowed")


@register(
    "non_payable_longest",
    f"""WITH {V.LINES}, {_LIST}, hit AS (
      SELECT bill_id, line_no, arg_max(no, length(name) * 100 - no) AS list_no FROM lines JOIN entries ON contains(item, name) GROUP BY ALL)
    SELECT bill_id, line_no, list_no FROM lines LEFT JOIN hit USING (bill_id, line_no)""",
)
def non_payable_longest(spark, sf_dir):
    return A.non_payable_longest(V.bill_lines(spark, sf_dir), not_payable_list(spark)).select("bill_id", "line_no", "list_no")


@register(
    "room_rank",
    f"""WITH {V.LINES} SELECT bill_id, line_no, CAST(CASE split_part(item, ' ', 1) WHEN 'small' THEN 1 WHEN 'red' THEN 2 WHEN 'blue' THEN 3
      WHEN 'large' THEN 4 WHEN 'green' THEN 5 END AS INTEGER) AS rank FROM lines""",
)
def room_rank(spark, sf_dir):
    return V.bill_lines(spark, sf_dir).select("bill_id", "line_no", A.room_rank(F.col("item")).alias("rank"))


_ENTITLED = f"""{V.BOTH}, ent AS (
  SELECT bill_id, CASE WHEN bill_id % 11 = 0 THEN 'schedule' WHEN bill_id % 11 = 1 THEN 'schedule'
      WHEN policy IN ('AFRICA', 'ASIA') AND sum_insured <= 300000 THEN 'table' WHEN policy = 'EUROPE' THEN 'at_actuals'
      WHEN policy IN ('AMERICA', 'EUROPE') THEN 'defers' END AS source,
    CAST(CASE WHEN bill_id % 11 = 0 THEN 150000 WHEN bill_id % 11 = 1 THEN NULL
      WHEN policy = 'AFRICA' AND sum_insured <= 300000 THEN sum_insured END AS BIGINT) AS per_day,
    CASE WHEN bill_id % 11 = 1 THEN 'blue' WHEN bill_id % 11 = 0 THEN NULL WHEN policy = 'ASIA' AND sum_insured <= 300000 THEN 'red' END AS category
  FROM bills)"""


def _entitlement(spark, sf_dir):
    bills = V.bills(spark, sf_dir)
    schedules = bills.where("bill_id % 11 < 2").selectExpr(
        "bill_id", "CAST(CASE WHEN bill_id % 11 = 0 THEN 150000 END AS BIGINT) AS per_day", "CASE WHEN bill_id % 11 = 1 THEN 'blue' END AS category"
    )
    rows = [(p, s, s if p == "AFRICA" else None, "red" if p == "ASIA" else None) for p in ("AFRICA", "ASIA") for s in (100000, 200000, 300000)]
    table_rows = spark.createDataFrame(rows, "policy string, sum_insured long, per_day long, category string")
    wording = spark.createDataFrame([("EUROPE", True, True), ("AMERICA", False, True)], "policy string, at_actuals boolean, defers boolean")
    return A.room_entitlement(bills, schedules, table_rows, wording)


@register("room_entitlement", f"WITH {_ENTITLED} SELECT * FROM ent WHERE source IS NOT NULL")
def room_entitlement(spark, sf_dir):
    return _entitlement(spark, sf_dir)


@register(
    "room_verdict",
    f"""WITH {_ENTITLED}, v AS (
      SELECT lb.bill_id, line_no, cents, qty, per_day, CASE WHEN per_day IS NOT NULL THEN 'per_day'
        WHEN ent.category IS NOT NULL THEN CASE WHEN list_position(['small', 'red', 'blue', 'large', 'green'], split_part(item, ' ', 1))
            <= list_position(['small', 'red', 'blue', 'large', 'green'], ent.category)
            AND list_contains(['small', 'red', 'blue', 'large', 'green'], split_part(item, ' ', 1)) THEN 'category_ok' ELSE 'category_flag' END
        WHEN source = 'at_actuals' THEN 'at_actuals' WHEN source = 'defers' THEN 'defers' ELSE 'open' END AS verdict
      FROM lb LEFT JOIN ent USING (bill_id) WHERE item LIKE '% gear')
    SELECT bill_id, line_no, verdict, CAST(CASE WHEN verdict = 'per_day' THEN least(cents, per_day * qty)
      WHEN verdict IN ('category_ok', 'at_actuals') THEN cents END AS BIGINT) AS allowed FROM v""",
)
def room_verdict(spark, sf_dir):
    lines = V.lines_of_bills(spark, sf_dir).drop("category")
    return A.room_verdict(lines, _entitlement(spark, sf_dir)).select("bill_id", "line_no", "verdict", "allowed")


@register("months_served", f"WITH {_WAIT} SELECT bill_id, months, days FROM waiting")
def months_served(spark, sf_dir):
    return A.assess_waiting(V.bills(spark, sf_dir), V.bill_lines(spark, sf_dir), waiting_terms(spark)).select("bill_id", "months", "days")


_WHY = """CASE waiting WHEN 'not_assessed' THEN 'a date is missing' WHEN 'accident' THEN 'an accident is carved out'
  WHEN 'specified' THEN 'W.2: rod waits 24 months, ' || months || ' were served' WHEN 'initial' THEN 'W.3: ' || days || ' of 30 days were served'
  ELSE months || ' months were served' || CASE WHEN coalesce(cond, false) AND policy <> 'MIDDLE EAST' THEN ', rod is named but its 24 months are over' ELSE '' END || '; W.1 on earlier conditions was not assessed' END AS why"""
_CITES = "CASE waiting WHEN 'specified' THEN 'W.2' WHEN 'initial' THEN 'W.3' END AS clause_id"


@register("assess_waiting", f"WITH {_WAIT} SELECT bill_id, waiting, {_CITES}, {_WHY} FROM waiting")
def assess_waiting(spark, sf_dir):
    return A.assess_waiting(V.bills(spark, sf_dir), V.bill_lines(spark, sf_dir), waiting_terms(spark)).select("bill_id", "waiting", "clause_id", "why")


@register(
    "waiting_nil_lines",
    f"WITH {_WAIT} SELECT bill_id, line_no, waiting, {_CITES}, CAST(0 AS BIGINT) AS allowed FROM lines JOIN waiting USING (bill_id) WHERE waiting IN ('specified', 'initial')",
)
def waiting_nil_lines(spark, sf_dir):
    lines = V.bill_lines(spark, sf_dir)
    nil = A.waiting_nil_lines(lines, A.assess_waiting(V.bills(spark, sf_dir), lines, waiting_terms(spark)))
    return nil.select("bill_id", "line_no", "waiting", "clause_id", "allowed")


@register(
    "ame_scope",
    f"""WITH {V.LINES} SELECT CASE WHEN split_part(item, ' ', 2) IN ('gear', 'gizmo') THEN 'excluded' WHEN split_part(item, ' ', 2) IN ('widget', 'ring')
      THEN 'included' ELSE 'unnamed' END AS scope, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM lines GROUP BY 1""",
)
def ame_scope(spark, sf_dir):
    scoped = V.bill_lines(spark, sf_dir).withColumn("scope", A.ame_scope(F.col("item")))
    return scoped.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


@register(
    "route_item",
    f"""WITH {V.LINES} SELECT CASE split_part(item, ' ', 2) WHEN 'gear' THEN 'room_rent' WHEN 'bolt' THEN 'copay' WHEN 'rod' THEN 'waiting_period'
      WHEN 'plate' THEN 'sub_limit' ELSE 'other' END AS route, count(*) AS n FROM lines GROUP BY 1""",
)
def route_item(spark, sf_dir):
    return V.bill_lines(spark, sf_dir).groupBy(A.route_item(F.col("item")).alias("route")).agg(F.count(F.lit(1)).alias("n"))


@register("breach_ratio", f"WITH {_SECOND} SELECT bill_id, policy, CAST(lim AS BIGINT) AS limit_cents, chg AS charged FROM worst")
def breach_ratio(spark, sf_dir):
    return A.breach_ratio(_capped(spark, sf_dir))


@register("second_pass", f"WITH {_SECOND} SELECT bill_id, line_no, allowed, scaled, deduction, why FROM passed")
def second_pass(spark, sf_dir):
    return _second(spark, sf_dir).select("bill_id", "line_no", "allowed", "scaled", "deduction", "why")


_FLAGGED = f"""{_SECOND}, final AS (SELECT *, CASE WHEN item LIKE '% plate' THEN NULL ELSE allowed END AS told FROM passed)"""


def _flagged(spark, sf_dir):
    """Second-pass lines of which one kind is still to be decided by a person."""
    return _second(spark, sf_dir).withColumn("allowed", F.when(~F.col("item").rlike(r"\bplate\b"), F.col("allowed")))


@register(
    "report",
    f"""WITH {_FLAGGED} SELECT bill_id, policy, count(*) AS n_lines, CAST(sum(cents) AS BIGINT) AS charged, CAST(sum(coalesce(told, 0)) AS BIGINT) AS allowed,
      count(*) FILTER (told IS NULL) AS flagged FROM final GROUP BY bill_id, policy""",
)
def report(spark, sf_dir):
    return A.report(_flagged(spark, sf_dir))


@register(
    "report_split",
    f"""WITH {_FLAGGED}, s AS (SELECT bill_id, policy, sum(coalesce(told, 0)) AS paid, sum(cents) AS charged, sum(CASE WHEN told IS NULL THEN cents ELSE 0 END) AS o
      FROM final GROUP BY ALL) SELECT bill_id, policy, CAST(paid AS BIGINT) AS paid, CAST(greatest(charged - paid - o, 0) AS BIGINT) AS cut, CAST(o AS BIGINT) AS open FROM s""",
)
def report_split(spark, sf_dir):
    return A.report_split(_flagged(spark, sf_dir))


@register(
    "explain_line",
    f"""WITH {_FLAGGED} SELECT bill_id, line_no, CASE WHEN told IS NULL THEN 'flagged' WHEN told >= cents THEN 'paid' WHEN told = 0 THEN 'not_payable'
      WHEN per_day > 0 AND told % per_day = 0 AND told // per_day BETWEEN 1 AND 366 THEN 'per_day_cap' WHEN scaled THEN 'proportionate' ELSE 'reduced' END AS why FROM final""",
)
def explain_line(spark, sf_dir):
    return A.explain_line(_flagged(spark, sf_dir)).select("bill_id", "line_no", "why")


@register(
    "compare_policies",
    f"""WITH {V.BILLS}, {V.LINES}, {_CAPS}, {_DED}, p AS (SELECT policy, cap_rate, row_number() OVER (ORDER BY policy) AS place FROM caps),
    decided AS (SELECT l.*, p.policy, place, CASE WHEN item LIKE '% gear' THEN sum_insured * cap_rate // 100 END AS per_day
      FROM lines l JOIN bills b USING (bill_id) CROSS JOIN p),
    d2 AS (SELECT *, least(cents, coalesce(per_day * qty, cents)) AS allowed0, coalesce(cents > per_day * qty, false) AS over_limit FROM decided),
    worst AS (SELECT DISTINCT ON (bill_id, policy) bill_id, policy, per_day * greatest(qty, 1) AS lim, cents AS chg FROM d2 WHERE over_limit
      ORDER BY bill_id, policy, CAST(per_day * greatest(qty, 1) AS HUGEINT) * 1000000000000000000 // cents, line_no),
    t AS (SELECT bill_id, policy, any_value(place) AS place, sum(CASE WHEN lim IS NOT NULL AND policy IN (SELECT policy FROM ded) AND (item LIKE '% widget' OR item LIKE '% ring') AND NOT over_limit
        THEN (2 * CAST(allowed0 AS HUGEINT) * lim + chg) // (2 * CAST(chg AS HUGEINT)) ELSE allowed0 END) AS total
      FROM d2 LEFT JOIN worst USING (bill_id, policy) GROUP BY bill_id, policy),
    r AS (SELECT *, row_number() OVER (PARTITION BY bill_id ORDER BY total DESC, place) AS k, max(total) OVER (PARTITION BY bill_id) AS hi, min(total) OVER (PARTITION BY bill_id) AS lo FROM t)
    SELECT bill_id, policy AS best, CAST(hi AS BIGINT) AS best_total, CAST(hi - lo AS BIGINT) AS difference FROM r WHERE k = 1""",
)
def compare_policies(spark, sf_dir):
    places = [(p, i + 1, PACK.caps[p]) for i, p in enumerate(sorted(PACK.caps))]
    policies = spark.createDataFrame(places, "policy string, place int, cap_rate int")
    return A.compare_policies(V.lines_of_bills(spark, sf_dir), policies, deduction_clauses(spark))


@register(
    "derive_expected",
    f"""WITH {_WAIT}, {_CAPS}, {_DED}, {_LIST}, hit AS (SELECT bill_id, line_no, max(no) AS no FROM lines JOIN entries ON contains(item, name) AND no <> 4 GROUP BY ALL),
    r AS (SELECT lb.*, waiting IN ('specified', 'initial') AS nil, no IS NOT NULL AS listed, CASE WHEN item LIKE '% gear' THEN lb.sum_insured * cap_rate // 100 END AS pd
      FROM lb JOIN waiting USING (bill_id) JOIN caps ON caps.policy = lb.policy LEFT JOIN hit USING (bill_id, line_no)),
    worst AS (SELECT DISTINCT ON (bill_id) bill_id, pd * greatest(qty, 1) AS lim, cents AS chg FROM r WHERE NOT nil AND NOT listed AND cents > pd * qty AND policy IN (SELECT policy FROM ded)
      ORDER BY bill_id, CAST(pd * greatest(qty, 1) AS HUGEINT) * 1000000000000000000 // cents, line_no),
    ruled AS (SELECT r.*, lim, chg, CASE WHEN nil THEN 'waiting' WHEN listed THEN 'list' WHEN item LIKE '% gear' THEN 'room'
      WHEN lim IS NOT NULL AND (item LIKE '% widget' OR item LIKE '% ring') THEN 'proportionate' ELSE 'full' END AS rule FROM r LEFT JOIN worst USING (bill_id))
    SELECT bill_id, line_no, rule, CAST(CASE WHEN rule IN ('waiting', 'list') THEN 0 WHEN rule = 'room' THEN least(cents, pd * qty)
      WHEN rule = 'proportionate' THEN (2 * CAST(cents AS HUGEINT) * lim + chg) // (2 * CAST(chg AS HUGEINT)) ELSE cents END AS BIGINT) AS expected FROM ruled""",
)
def derive_expected(spark, sf_dir):
    lines = V.lines_of_bills(spark, sf_dir)
    waiting = A.assess_waiting(V.bills(spark, sf_dir), V.bill_lines(spark, sf_dir), waiting_terms(spark))
    done = A.derive_expected(lines, waiting, not_payable_list(spark), room_caps(spark), deduction_clauses(spark))
    return done.select("bill_id", "line_no", "rule", "expected")
