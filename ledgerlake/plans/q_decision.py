"""Answer keys by a decision table, in the words of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.operators import decision as D
from ledgerlake.operators.rules import PACK, not_payable_list
from ledgerlake.plans import views as V
from ledgerlake.plans.registry import register

_R = D.Rule
#: ``gear`` is a room, ``rod`` a condition of the specified list, ``widget`` and ``ring`` follow the room; colours and ages tell the rest apart.
TABLE = D.Table(
    rules=(
        _R("waiting", "nil", ":waiting", when="waiting"),
        _R("list", "nil", "LIST", when="listed", unless=r"\bbolt\b"),
        _R("registration", "nil", "A.31", "^cold plate$", policy="AFRICA"),
        _R("ambulance", "cap", "A.8", r"\bbolt\b", policy="AFRICA", cap="stay"),
        _R("per eye", "cap", "A.3", "^red widget$", policy="AFRICA", cap="eye"),
        _R("modern treatment", "cap", "A.5", "^blue widget$", policy="AFRICA", cap="modern"),
        _R("other systems", "human", None, "^old", policy="AMERICA"),
        _R("room open", "human", ":room", r"\bgear\b", when="unresolved"),
        _R("room limit", "per_day", ":room", r"\bgear\b", when="limited"),
        _R("room", "full", ":room", r"\bgear\b"),
        _R("intensive care", "full", ":room", "^hot"),
        _R("follows open", "human", ":ratio", r"\b(widget|ring)\b", when="unresolved"),
        _R("follows", "ratio", ":ratio", r"\b(widget|ring)\b", when="breached"),
        _R("follows in full", "full", ":room", r"\b(widget|ring)\b"),
        _R("outside", "full", ":room", r"\bgizmo\b"),
        _R("physiotherapy", "human", None, "^new plate$"),
        _R("other", "full", ":room"),
    ),
    policies={"AFRICA": ("A.1", "A.2", "A.9", 2), "AMERICA": ("B.1", "B.2", "B.9", None), "ASIA": ("C.1", "C.2", "C.9", 2), "EUROPE": ("E.1", "E.2", "E.9", 1)},
    caps={
        **{("room", p, s): c for p in ("AFRICA", "ASIA") for s, c in ((100_000, 120_000), (200_000, 120_000), (300_000, 180_000))},
        **{("stay", "AFRICA", k * 100_000): 750_000 for k in range(1, 6)}, **{("eye", "AFRICA", k * 100_000): 1_200_000 * k for k in range(1, 6)},
        ("modern", "AFRICA", 100_000): 2_500_000, ("modern", "AFRICA", 200_000): 5_000_000,
    },
    room=r"\bgear\b", waiting=r"\brod\b", waiting_months=6, ladder=PACK.ladder,
)


@register("derive_key", f"""WITH {V.BILLS}, {V.LINES}, c(policy, safe, l) AS (VALUES ('AFRICA', 2, 'A'), ('AMERICA', NULL, 'B'), ('ASIA', 2, 'C'), ('EUROPE', 1, 'E')),
  rm AS (SELECT DISTINCT ON (bill_id) bill_id, item AS r_item, cents AS den, qty AS r_qty FROM lines WHERE item LIKE '% gear' ORDER BY bill_id, line_no),
  wt AS (SELECT bill_id, bool_or(item LIKE '% rod') AS waits FROM lines GROUP BY 1),
  b AS (SELECT bills.*, safe, l, r_item, den, r_qty, CASE WHEN grp = 0 THEN 100000 WHEN policy IN ('AFRICA', 'ASIA') AND sum_insured <= 200000 THEN 120000 WHEN policy IN ('AFRICA', 'ASIA') AND sum_insured = 300000 THEN 180000 END AS lim,
      waits AND (year(admitted) - year(started)) * 12 + month(admitted) - month(started) - CASE WHEN day(admitted) < day(started) THEN 1 ELSE 0 END < 6 AS waiting,
      CASE split_part(r_item, ' ', 1) WHEN 'small' THEN 1 WHEN 'red' THEN 2 WHEN 'blue' THEN 3 WHEN 'large' THEN 4 WHEN 'green' THEN 5 END AS rank
    FROM bills JOIN wt USING (bill_id) LEFT JOIN rm USING (bill_id) LEFT JOIN c USING (policy)),
  f AS (SELECT lines.*, b.* EXCLUDE (bill_id), coalesce(lim * r_qty < den, false) AS breached, r_qty IS NOT NULL AND lim IS NULL AND safe IS NOT NULL AND coalesce(rank > safe, true) AS unresolved FROM lines JOIN b USING (bill_id)),
  r AS (SELECT *, CASE WHEN waiting THEN 'waiting' WHEN item LIKE '%anvil' OR item = 'red ring' THEN 'list' WHEN item = 'cold plate' AND policy = 'AFRICA' THEN 'registration'
      WHEN item LIKE '% bolt' AND policy = 'AFRICA' THEN 'ambulance' WHEN item = 'red widget' AND policy = 'AFRICA' THEN 'per eye' WHEN item = 'blue widget' AND policy = 'AFRICA' THEN 'modern treatment'
      WHEN item LIKE 'old%' AND policy = 'AMERICA' THEN 'other systems' WHEN item LIKE '% gear' AND unresolved THEN 'room open' WHEN item LIKE '% gear' AND lim IS NOT NULL THEN 'room limit' WHEN item LIKE '% gear' THEN 'room'
      WHEN item LIKE 'hot%' THEN 'intensive care' WHEN (item LIKE '% widget' OR item LIKE '% ring') AND unresolved THEN 'follows open' WHEN (item LIKE '% widget' OR item LIKE '% ring') AND breached THEN 'follows'
      WHEN item LIKE '% widget' OR item LIKE '% ring' THEN 'follows in full' WHEN item LIKE '% gizmo' THEN 'outside' WHEN item = 'new plate' THEN 'physiotherapy' ELSE 'other' END AS rule FROM f)
  SELECT bill_id, line_no, rule, CAST(CASE WHEN rule IN ('waiting', 'list', 'registration') THEN 0 WHEN rule = 'ambulance' THEN least(cents, 750000) WHEN rule = 'per eye' THEN least(cents, 12 * sum_insured)
      WHEN rule = 'modern treatment' THEN CASE WHEN sum_insured <= 200000 THEN least(cents, 25 * sum_insured) END WHEN rule IN ('other systems', 'room open', 'follows open', 'physiotherapy') THEN NULL
      WHEN rule = 'room limit' THEN least(cents, lim * qty) WHEN rule = 'follows' THEN (2 * CAST(cents AS HUGEINT) * lim * r_qty + den) // (2 * CAST(den AS HUGEINT)) ELSE cents END AS BIGINT) AS expected,
    CASE WHEN rule = 'list' THEN 'LIST' WHEN rule = 'registration' THEN 'A.31' WHEN rule = 'ambulance' THEN 'A.8' WHEN rule = 'per eye' THEN 'A.3' WHEN rule = 'modern treatment' THEN 'A.5'
      WHEN rule IN ('other systems', 'physiotherapy') THEN NULL WHEN rule = 'waiting' THEN l || '.9' WHEN rule IN ('follows', 'follows open') THEN l || '.2' ELSE l || '.1' END AS clause_id FROM r""")
def derive_key(spark, sf_dir):
    bills = V.bills(spark, sf_dir).withColumn("room_limit", F.expr("IF(grp = 0, 100000L, NULL)"))
    return D.derive_key(V.bill_lines(spark, sf_dir), bills, not_payable_list(spark), TABLE).select("bill_id", "line_no", "rule", "expected", "clause_id")
