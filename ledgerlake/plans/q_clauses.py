"""Queries of what clauses state, and of the compositions: corpus, search and audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.operators import adjudicate as A
from ledgerlake.operators import clause_rules as K
from ledgerlake.operators import corpus as C
from ledgerlake.operators.rules import deduction_clauses, not_payable_list, room_caps, waiting_terms
from ledgerlake.plans import views as V
from ledgerlake.plans.q_adjudicate import _CAPS, _DED, _LIST, _SECOND, _WAIT, _capped
from ledgerlake.plans.q_corpus import _ISL, _L, _lines, _numbered
from ledgerlake.plans.registry import register
from ledgerlake.plans.scratch import folder
from ledgerlake.streaming import streams as G


def _tabled(spark, sf_dir):
    """Clauses of which every seventh has a row for a sum insured."""
    row = "concat(text, '\\nSum Insured ', 100000 * (1 + clause_id % 5))"
    return V.clauses(spark, sf_dir).withColumn("text", F.expr(f"CASE WHEN clause_id % 7 = 0 THEN {row} ELSE text END"))


_T = """tb AS (SELECT source AS policy, doc_id AS clause_id, CASE WHEN doc_id % 7 = 0 THEN text || chr(10) || 'Sum Insured ' || (100000 * (1 + doc_id % 5)) ELSE text END AS text FROM documents),
  gv AS (SELECT *, contains(text, 'Licensed') OR contains(text, 'reserved') OR contains(text, 'token') AS is_room, regexp_matches(text, 'Sum Insured [0-9]{5,8}') AS has_rows,
    contains(text, 'reserved') AS states, contains(text, 'token') AS defers FROM tb)"""


def _told(spark, sf_dir):
    return K.governs_room(_tabled(spark, sf_dir), "Licensed|reserved|token", "reserved", "token")


@register("governs_room", f"WITH {_T} SELECT policy, clause_id, is_room AND (has_rows OR states OR defers) AS governs FROM gv")
def governs_room(spark, sf_dir):
    return _told(spark, sf_dir).select("policy", "clause_id", "governs")


@register("room_clause", f"""WITH {_T}, r AS (SELECT policy, clause_id, CASE WHEN has_rows THEN 1 WHEN states OR defers THEN 2 ELSE 3 END AS tier, length(text) AS n FROM gv WHERE is_room)
  SELECT DISTINCT ON (policy) policy, clause_id, tier FROM r ORDER BY policy, tier, n DESC, clause_id""")
def room_clause(spark, sf_dir):
    return K.room_clause(_told(spark, sf_dir))


@register("sum_insured_options", f"""WITH {_T} SELECT policy, coalesce(string_agg(DISTINCT (100000 * (1 + clause_id % 5))::VARCHAR, ',' ORDER BY (100000 * (1 + clause_id % 5))::VARCHAR) FILTER (clause_id % 7 = 0),
  '300000,500000,1000000,2500000') AS options FROM tb GROUP BY policy""")
def sum_insured_options(spark, sf_dir):
    return K.sum_insured_options(_tabled(spark, sf_dir)).select("policy", F.array_join("options", ",").alias("options"))


def _coded(spark, sf_dir):
    """Clauses of which some carry exclusion codes with their periods."""
    code = """CASE clause_id % 6 WHEN 0 THEN ' Code Excl01: 12 or 36 months' WHEN 1 THEN ' Code Excl02: 24 months for rod, anvil' WHEN 2 THEN ' Code Excl02: 18 months for anvil'
      WHEN 3 THEN ' Code Excl03: 30 days' WHEN 4 THEN ' Code Excl03: no number' ELSE '' END"""
    return V.clauses(spark, sf_dir).withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.expr(code)))


_PERIODS = r"""pc AS (SELECT source AS policy, doc_id AS clause_id, coalesce(text, '') || CASE doc_id % 6 WHEN 0 THEN ' Code Excl01: 12 or 36 months' WHEN 1 THEN ' Code Excl02: 24 months for rod, anvil'
    WHEN 2 THEN ' Code Excl02: 18 months for anvil' WHEN 3 THEN ' Code Excl03: 30 days' WHEN 4 THEN ' Code Excl03: no number' ELSE '' END AS text FROM documents),
  pm AS (SELECT policy, clause_id, text, length(text) AS n, list_transform(regexp_extract_all(text, '([0-9]{1,3})\s*months', 1), lambda x: x::INTEGER) AS ms, list_transform(regexp_extract_all(text, '([0-9]{1,3})\s*days', 1), lambda x: x::INTEGER) AS ds FROM pc),
  pk AS (SELECT policy, 'ped' AS kind, clause_id, n, CASE WHEN list_contains(ms, 36) THEN 36 ELSE ms[1] END AS months, NULL::INTEGER AS days FROM pm WHERE regexp_matches(text, '(?i)\bexcl\s*-?0?1\b') AND len(ms) > 0
    UNION ALL SELECT policy, 'specified', clause_id, n, CASE WHEN list_contains(ms, 24) THEN 24 ELSE ms[1] END, NULL FROM pm WHERE regexp_matches(text, '(?i)\bexcl\s*-?0?2\b') AND len(ms) > 0
    UNION ALL SELECT policy, 'initial', clause_id, n, NULL, ds[1] FROM pm WHERE regexp_matches(text, '(?i)\bexcl\s*-?0?3\b') AND len(ds) > 0),
  periods AS (SELECT DISTINCT ON (policy, kind) policy, kind, clause_id, months, days FROM pk ORDER BY policy, kind, n, clause_id)"""


@register("waiting_periods", f"WITH {_PERIODS} SELECT policy, kind, clause_id, months, days FROM periods")
def waiting_periods(spark, sf_dir):
    return K.waiting_periods(_coded(spark, sf_dir))


@register("waiting_by_clauses", f"""WITH {V.BOTH}, {_PERIODS}, tm AS (SELECT policy, max(clause_id) FILTER (kind = 'specified') AS sc, max(months) FILTER (kind = 'specified') AS sm,
    max(clause_id) FILTER (kind = 'initial') AS ic, max(days) FILTER (kind = 'initial') AS idays FROM periods GROUP BY policy),
  tt AS (SELECT tm.*, lower(pc.text) AS words FROM tm LEFT JOIN pc ON pc.policy = tm.policy AND pc.clause_id = tm.sc),
  told AS (SELECT bill_id, bool_or(item LIKE 'black %') AS accident, bool_or(item LIKE '% rod') AS rod, bool_or(item LIKE '% anvil') AS anvil FROM lines GROUP BY bill_id),
  b AS (SELECT bill_id, started, admitted, accident, (coalesce(rod, false) AND contains(words, 'rod')) OR (coalesce(anvil, false) AND contains(words, 'anvil')) AS cond, sc, sm, ic, idays,
    (year(admitted) - year(started)) * 12 + month(admitted) - month(started) - (CASE WHEN day(admitted) < day(started) THEN 1 ELSE 0 END) AS months, admitted - started AS d
    FROM bills LEFT JOIN told USING (bill_id) LEFT JOIN tt ON tt.policy = 'src' || (bill_id % 20)),
  w AS (SELECT *, CASE WHEN started IS NULL OR admitted IS NULL THEN 'not_assessed' WHEN coalesce(accident, false) THEN 'accident' WHEN cond AND months < sm THEN 'specified' WHEN d < idays THEN 'initial' ELSE 'served' END AS waiting FROM b)
  SELECT bill_id, waiting, CASE waiting WHEN 'specified' THEN sc WHEN 'initial' THEN ic END AS clause_id FROM w""")
def waiting_by_clauses(spark, sf_dir):
    """Periods, their clauses and the confirmed conditions all read from the clauses of a bill's policy."""
    clauses = _coded(spark, sf_dir)
    bills = V.bills(spark, sf_dir).withColumn("policy", F.expr("concat('src', bill_id % 20)"))
    terms = K.waiting_terms(K.waiting_periods(clauses), clauses)
    return A.assess_waiting(bills, V.bill_lines(spark, sf_dir), terms).select("bill_id", "waiting", "clause_id")


_CONDITIONS = [("AFRICA", "bolt and rod"), ("ASIA", "Ring"), ("EUROPE", "none")]


@register("confirmed_condition", f"""WITH {V.BOTH}, c(policy, text) AS (VALUES ('AFRICA', 'bolt and rod'), ('ASIA', 'ring'), ('EUROPE', 'none'))
  SELECT DISTINCT ON (bill_id) bill_id, line_no, split_part(item, ' ', 2) AS condition FROM lb JOIN c USING (policy)
  WHERE split_part(item, ' ', 2) IN ('bolt', 'rod', 'ring') AND contains(text, split_part(item, ' ', 2)) ORDER BY bill_id, line_no""")
def confirmed_condition(spark, sf_dir):
    return K.confirmed_condition(V.lines_of_bills(spark, sf_dir), spark.createDataFrame(_CONDITIONS, "policy string, text string"), " (bolt|rod|ring)$")


@register("reject_expired_exclusion", f"""WITH {V.BOTH} SELECT bill_id, line_no, CASE WHEN bill_id % 4 = 0 AND bill_id % 3 = 0 AND NOT bill_id % 5 = 0 THEN NULL WHEN bill_id % 4 = 0 THEN 0 ELSE cents END AS allowed FROM lb""")
def reject_expired_exclusion(spark, sf_dir):
    lines = V.lines_of_bills(spark, sf_dir)
    verdicts = lines.selectExpr("bill_id", "line_no", "policy", "bill_id % 3 AS clause_id", "CASE WHEN bill_id % 4 = 0 THEN 0 ELSE cents END AS allowed")
    periods = V.table(spark, sf_dir, "region").selectExpr("r_name AS policy", "0L AS clause_id")
    served = V.bills(spark, sf_dir).selectExpr("bill_id", "bill_id % 5 = 0 AS excluded")
    return K.reject_expired_exclusion(verdicts, periods, served).select("bill_id", "line_no", "allowed")


@register("carve_out_quote", """WITH f AS (SELECT DISTINCT ON (source) source AS policy, doc_id AS clause_id, text, instr(text, 'token') AS a1 FROM documents WHERE contains(text, 'token') ORDER BY source, doc_id)
  SELECT policy, clause_id, md5(substr(text, greatest(a1 - 120, 1), a1 - greatest(a1 - 120, 1) + 5 + 120)) AS quote FROM f""")
def carve_out_quote(spark, sf_dir):
    return K.carve_out_quote(V.clauses(spark, sf_dir), "token").withColumn("quote", F.md5("quote"))


@register("deduction_clause", "SELECT DISTINCT ON (source) source AS policy, doc_id AS clause_id FROM documents WHERE contains(text, 'the') ORDER BY source, contains(text, 'ing'), doc_id")
def deduction_clause(spark, sf_dir):
    return K.deduction_clause(V.clauses(spark, sf_dir), "the", "ing")


@register("assumptions", "SELECT conv_id AS run_id, role AS name, count(*) AS n FROM conversations WHERE turn % 2 = 0 GROUP BY ALL")
def assumptions(spark, sf_dir):
    trace = V.table(spark, sf_dir, "conversations").selectExpr("conv_id AS run_id", "CASE WHEN turn % 2 = 0 THEN role END AS assumption")
    return K.assumptions(trace)


@register("explain_ratio", f"""WITH {_SECOND}, fr AS (SELECT DISTINCT ON (bill_id) bill_id, per_day * greatest(qty, 1) AS l, cents FROM decided WHERE per_day IS NOT NULL ORDER BY bill_id, line_no)
  SELECT bill_id, coalesce(abs(CAST(lim AS DECIMAL(38,12)) / chg - least(CAST(l AS DECIMAL(38,12)) / cents, 1)) <= 0.0001, false) AS accepted FROM worst LEFT JOIN fr USING (bill_id)""")
def explain_ratio(spark, sf_dir):
    lines = _capped(spark, sf_dir)
    return K.explain_ratio(lines, A.breach_ratio(lines).drop("policy"))


_TERMS = f"""{_L}, tl AS (SELECT * REPLACE (CASE WHEN seq % 3 = 0 THEN 'Term' || seq || ': ' || line ELSE line END AS line) FROM lines), tm AS (SELECT * FROM tl WHERE seq < 60 AND regexp_matches(line, '^[A-Z][^:]{{2,60}}: \\S')),
  kp AS (SELECT *, count(*) OVER (PARTITION BY policy) AS n FROM tm)"""


@register("split_unnumbered_definitions", f"WITH {_TERMS} SELECT policy, 'I.Def' || row_number() OVER (PARTITION BY policy ORDER BY seq) AS clause_id, split_part(line, ': ', 1) AS title FROM kp WHERE n >= 10 AND length(line) >= 20")
def split_unnumbered_definitions(spark, sf_dir):
    lines = _lines(spark, sf_dir).withColumn("line", F.expr("CASE WHEN seq % 3 = 0 THEN concat('Term', seq, ': ', line) ELSE line END"))
    first = lines.select("policy").distinct().withColumn("first", F.lit(60))
    return K.split_unnumbered_definitions(lines, first)


@register("parse_exclusion_pairs", f"""WITH {V.LINES}, p AS (SELECT bill_id, line_no, CASE WHEN line_no % 3 = 1 THEN line_no * 10 END AS no, item FROM lines),
  f AS (SELECT DISTINCT ON (bill_id, item) * FROM p ORDER BY bill_id, item, line_no), g AS (SELECT *, count(no) OVER (PARTITION BY bill_id ORDER BY line_no) AS k FROM f)
  SELECT bill_id, CAST(coalesce(max(no) OVER (PARTITION BY bill_id, k), 0) + row_number() OVER (PARTITION BY bill_id, k ORDER BY line_no) - least(k, 1) AS INTEGER) AS no, item FROM g""")
def parse_exclusion_pairs(spark, sf_dir):
    """Each bill as a printed list: every third entry has a number, names are spaced out and some come again."""
    spaced = F.replace("item", F.lit(" "), F.lit("   "))
    no = F.when(F.col("line_no") % 3 == 1, F.col("line_no") * 10)
    rows = V.bill_lines(spark, sf_dir).select(F.col("bill_id").alias("list"), F.col("line_no").alias("pos"), no.alias("no"), spaced.alias("item"))
    return K.parse_exclusion_pairs(rows).withColumnRenamed("list", "bill_id")


@register("damaged_table_cells", f"WITH {V.LINES} SELECT bill_id AS table_id, line_no AS row, 1 AS col FROM lines l WHERE line_no > 1 AND length(item) > 9 AND item = (SELECT item FROM lines f WHERE f.bill_id = l.bill_id AND f.line_no = 1)")
def damaged_table_cells(spark, sf_dir):
    cells = V.bill_lines(spark, sf_dir).selectExpr("bill_id AS table_id", "line_no AS row", "1 AS col", "item AS cell")
    return K.damaged_table_cells(cells, 9)


AUDIT = f"""{_WAIT}, {_CAPS}, {_DED}, {_LIST}, hit AS (SELECT bill_id, line_no, min(no) AS no FROM lines JOIN entries ON contains(item, name) GROUP BY ALL HAVING min(no) <> 4),
  r AS (SELECT lb.*, waiting, waiting IN ('specified', 'initial') AS nil, no IS NOT NULL AS listed, CASE WHEN item LIKE '% gear' THEN lb.sum_insured * cap_rate // 100 END AS pd
    FROM lb JOIN waiting USING (bill_id) JOIN caps ON caps.policy = lb.policy LEFT JOIN hit USING (bill_id, line_no)),
  worst AS (SELECT DISTINCT ON (bill_id) bill_id, pd * greatest(qty, 1) AS lim, cents AS chg FROM r WHERE NOT nil AND NOT listed AND cents > pd * qty AND policy IN (SELECT policy FROM ded)
    ORDER BY bill_id, CAST(pd * greatest(qty, 1) AS HUGEINT) * 1000000000000000000 // cents, line_no),
  ruled AS (SELECT r.*, lim, chg, clause, CASE WHEN nil THEN 'waiting' WHEN listed THEN 'list' WHEN item LIKE '% gear' THEN 'room' WHEN item LIKE '% plate' THEN 'judged' WHEN item LIKE '% bolt' AND qty > 45 THEN 'open'
    WHEN lim IS NOT NULL AND (item LIKE '% widget' OR item LIKE '% ring') THEN 'proportionate' ELSE 'full' END AS rule FROM r LEFT JOIN worst USING (bill_id) LEFT JOIN ded ON ded.policy = r.policy),
  fin AS (SELECT *, CASE rule WHEN 'waiting' THEN 0 WHEN 'list' THEN 0 WHEN 'room' THEN least(cents, pd * qty) WHEN 'judged' THEN least(cents, 5000000) WHEN 'open' THEN NULL
    WHEN 'proportionate' THEN CAST((2 * CAST(cents AS HUGEINT) * lim + chg) // (2 * CAST(chg AS HUGEINT)) AS BIGINT) ELSE cents END AS allowed,
    CASE WHEN rule = 'waiting' AND waiting = 'specified' THEN 'W.2' WHEN rule = 'waiting' THEN 'W.3' WHEN rule = 'proportionate' THEN clause WHEN rule = 'judged' THEN 'P.1' END AS clause_id FROM ruled)"""


def judge_plates(lines):
    """A judge for the driver's words: plates have a sub-limit that a clause states, many bolts at once stay open."""
    told = lines.select("bill_id", "line_no", "cents", F.col("item").rlike(r"\bplate\b").alias("limited"), (F.col("item").rlike(r"\bbolt\b") & (F.col("qty") > 45)).alias("open"))
    return told.where("limited OR open").selectExpr(
        "bill_id", "line_no", "CASE WHEN limited THEN least(cents, 5000000) END AS allowed", "CASE WHEN limited THEN 'P.1' END AS clause_id", "CASE WHEN open THEN 'attempts' END AS reason"
    )


def audited(lines, bills):
    """The whole audit under the packs of the driver's words."""
    spark = lines.sparkSession
    return A.audit_lines(lines, bills, waiting_terms(spark), not_payable_list(spark), room_caps(spark), deduction_clauses(spark), judge_plates)


@register("audit_lines", f"WITH {AUDIT} SELECT bill_id, line_no, allowed, clause_id FROM fin")
def audit_lines(spark, sf_dir):
    return audited(V.lines_of_bills(spark, sf_dir), V.bills(spark, sf_dir)).select("bill_id", "line_no", "allowed", "clause_id")


@register("audit_bills", f"""WITH {AUDIT} SELECT bill_id, policy, count(*) AS n_lines, CAST(sum(cents) AS BIGINT) AS charged, CAST(coalesce(sum(allowed), 0) AS BIGINT) AS allowed, count(*) FILTER (allowed IS NULL) AS flagged
  FROM fin GROUP BY bill_id, policy""")
def audit_bills(spark, sf_dir):
    """Each bill's report: waiting periods, the list, rooms and judgements, the second pass."""
    return A.report(audited(V.lines_of_bills(spark, sf_dir), V.bills(spark, sf_dir)))


@register("stream_intake", f"WITH {V.LINES} SELECT bill_id, line_no, item || ' [REDACTED]' AS text FROM lines")
def stream_intake(spark, sf_dir):
    path, target = folder(spark, "arriving"), folder(spark, "masked")
    V.bill_lines(spark, sf_dir).selectExpr("bill_id", "line_no", "concat(item, ' a.b', bill_id, '@mail.org') AS text").repartition(4, "bill_id").write.json(path)
    schema = "bill_id BIGINT, line_no INT, text STRING"
    stream = G.stream_intake(spark, path, schema, files=2)
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", folder(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(target)


