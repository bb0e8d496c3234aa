"""Queries of the corpus operators, over the documents as pages (policy = source, page = doc_id)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.operators import clause_rules as K
from ledgerlake.operators import corpus as C
from ledgerlake.operators import grid as T
from ledgerlake.operators.rules import not_payable_list
from ledgerlake.plans import sql_text as S
from ledgerlake.plans import views as V
from ledgerlake.plans.registry import register
from ledgerlake.plans.scratch import folder, stored

_BANNER = r"^[A-Z][a-z]{1,4}\.$"
_MARK = "The "


def _q(s: str) -> str:
    return s.replace("'", "''")


def _pages(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").selectExpr("source AS policy", "doc_id AS page", "text")


def _lines(spark, sf_dir):
    return C.page_lines(_pages(spark, sf_dir))


def _numbered(spark, sf_dir):
    """Lines of which every fifth carries a dotted number, so that there are headings."""
    number = "concat(CAST(seq DIV 35 AS STRING), '.', CAST(seq % 35 DIV 5 + 1 AS STRING), ' ', trim(line))"
    return _lines(spark, sf_dir).withColumn("line", F.expr(f"CASE WHEN seq % 5 = 0 AND trim(line) <> '' THEN {number} ELSE line END"))


_L = """lines AS (
  SELECT policy, page, CAST(pos AS INTEGER) AS pos, CAST(row_number() OVER (PARTITION BY policy ORDER BY page, pos) AS INTEGER) AS seq, line FROM (
    SELECT source AS policy, doc_id AS page, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents))"""
_N = f"""{_L}, nl AS (SELECT * REPLACE (CASE WHEN seq % 5 = 0 AND trim(line) <> ''
    THEN (seq // 35)::VARCHAR || '.' || (seq % 35 // 5 + 1)::VARCHAR || ' ' || trim(line) ELSE line END AS line) FROM lines),
  head AS (SELECT *, regexp_matches(line, '{C.HEADING}') AND length(regexp_extract(line, '{C.HEADING}', 2)) <= 120
      AND regexp_matches(regexp_extract(line, '{C.HEADING}', 2), '^[A-Z0-9"'']') AND regexp_matches(regexp_extract(line, '{C.HEADING}', 2), '[A-Za-z]{{3}}') AS good FROM nl),
  titled AS (SELECT *, CASE WHEN good THEN regexp_extract(line, '{C.HEADING}', 1) END AS number, CASE WHEN good THEN regexp_extract(line, '{C.HEADING}', 2) END AS title FROM head)"""
_ISL = f"""{_N}, isl AS (SELECT *, count(number) OVER (PARTITION BY policy ORDER BY seq) AS island FROM titled),
  cl AS (SELECT policy, island, max(number) AS clause_id, max(title) AS title, min(seq) AS pos, count(*) FILTER (number IS NULL) AS n_lines,
    coalesce(string_agg(line, chr(10) ORDER BY seq) FILTER (number IS NULL), '') AS text FROM isl WHERE island > 0 GROUP BY policy, island)"""


@register("page_lines", f"WITH {_L} SELECT policy, page, pos, seq, md5(line) AS line FROM lines")
def page_lines(spark, sf_dir):
    return _lines(spark, sf_dir).withColumn("line", F.md5("line"))


_FURN = f"""{_L}, pg AS (SELECT policy, count(DISTINCT page) AS pages FROM lines GROUP BY 1),
  furn AS (SELECT policy, trim(line) AS line FROM lines JOIN pg USING (policy) WHERE trim(line) <> '' GROUP BY policy, trim(line), pages
    HAVING count(DISTINCT page) >= greatest(2, floor(pages * 0.1)))"""


@register("drop_furniture", f"""WITH {_FURN} SELECT l.policy, seq FROM lines l LEFT JOIN furn f ON l.policy = f.policy AND trim(l.line) = f.line
  WHERE f.line IS NULL AND NOT regexp_matches(trim(l.line), '^(?i:page )?[0-9]+$')""")
def drop_furniture(spark, sf_dir):
    return C.drop_furniture(_lines(spark, sf_dir), 0.1).select("policy", "seq")


@register("section_carry", f"""WITH {_L} SELECT policy, seq, last_value(CASE WHEN regexp_matches(line, '{_BANNER}') THEN trim(line) END IGNORE NULLS)
  OVER (PARTITION BY policy ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM lines""")
def section_carry(spark, sf_dir):
    return C.section_carry(_lines(spark, sf_dir), _BANNER).select("policy", "seq", "section")


@register("heading_candidates", f"WITH {_N} SELECT policy, seq, number, title FROM titled WHERE number IS NOT NULL")
def heading_candidates(spark, sf_dir):
    return C.heading_candidates(_numbered(spark, sf_dir)).where("number IS NOT NULL").select("policy", "seq", "number", "title")


_DANGLES = C.FUNCTION_WORDS.removesuffix("$") + r"\s*$"
_STEPS = "".join(
    f"""s{i} AS (SELECT * REPLACE (CASE WHEN go THEN title || ' ' || more[{i}] ELSE title END AS title) FROM (SELECT *, head IS NULL AND len(more) >= {i}
    AND regexp_matches(title, '{_DANGLES}') AND length(title) < 90 AS go FROM c{i - 1})), c{i} AS (SELECT * EXCLUDE (go) REPLACE (coalesce(head, {S.colon("title")}) AS head) FROM s{i}),"""
    for i in (1, 2, 3)
)
#: The title of each row of c0: (more, title, head) and what it is known by.
TITLES = f"""{_STEPS} tt AS (SELECT * REPLACE (coalesce(head, {S.strip("regexp_replace(CASE WHEN length(title) <= 90 THEN title WHEN contains(substr(title, 1, 90), ' ') THEN regexp_extract(substr(title, 1, 90), '(?s)^(.*) [^ ]*$', 1) ELSE substr(title, 1, 90) END, '[ ,;:]+$', '')")}) AS title) FROM c3)"""


def more(nx: str) -> str:
    return f"list_filter(list_transform(list_filter({nx}, lambda x: x IS NOT NULL), lambda x: {S.strip('x')}), lambda x: NOT starts_with(x, '[table]'))"


@register("complete_title", f"""WITH {_N}, nx AS (SELECT *, [lead(line) OVER w, lead(line, 2) OVER w, lead(line, 3) OVER w] AS n FROM titled WINDOW w AS (PARTITION BY policy ORDER BY seq)),
  c0 AS (SELECT policy, seq, more, title, {S.colon("title")} AS head FROM (SELECT policy, seq, {more("n")} AS more, {S.cap(S.strip("regexp_replace(title, ':+$', '')"))} AS title FROM nx WHERE title IS NOT NULL)),
  {TITLES} SELECT policy, seq, title AS full_title FROM tt""")
def complete_title(spark, sf_dir):
    lines = C.heading_candidates(_numbered(spark, sf_dir))
    told = C.with_following(lines.where("title IS NOT NULL"), lines).withColumnRenamed("title", "raw")
    told = told.withColumn("following", F.filter(F.array("next1", "next2", "next3"), lambda x: x.isNotNull()))
    return C.complete_title(told).select("policy", "seq", F.col("title").alias("full_title"))


@register("is_table_debris", f"WITH {_L} SELECT policy, seq FROM lines WHERE {S.debris('line')}")
def is_table_debris(spark, sf_dir):
    return _lines(spark, sf_dir).where(C.is_table_debris(F.col("line"))).select("policy", "seq")


@register("fix_letter_spacing", f"""WITH {_L}, sp AS (SELECT policy, seq, regexp_replace(line, '^([A-Z])(.)', '\\1 \\2') AS line FROM lines) SELECT policy, seq, md5({S.cap("line")}) AS line FROM sp""")
def fix_letter_spacing(spark, sf_dir):
    """Lines whose first capital stands apart."""
    spaced = F.regexp_replace("line", "^([A-Z])(.)", "$1 $2")
    return _lines(spark, sf_dir).select("policy", "seq", F.md5(C.fix_letter_spacing(spaced)).alias("line"))


def _islands(spark, sf_dir):
    return C.islands(C.heading_candidates(_numbered(spark, sf_dir)))


@register("islands", f"WITH {_ISL} SELECT policy, island, clause_id, title, pos, n_lines, md5(text) AS text FROM cl")
def islands(spark, sf_dir):
    return _islands(spark, sf_dir).withColumn("text", F.md5("text"))


@register("join_wrapped_lines", f"""WITH {_L}, s AS (SELECT policy, seq, trim(line) AS line FROM lines WHERE trim(line) <> ''),
  f AS (SELECT *, lag(line) OVER (PARTITION BY policy ORDER BY seq) AS p FROM s),
  b AS (SELECT *, sum(CASE WHEN p IS NULL OR regexp_matches(line, '{C.HEADING}') OR starts_with(line, '[table]') OR regexp_matches(p, '{C.HEADING}') OR starts_with(p, '[table]')
    OR regexp_matches(p, '[.!?:;]$') THEN 1 ELSE 0 END) OVER (PARTITION BY policy ORDER BY seq) AS block FROM f)
  SELECT policy, CAST(block AS BIGINT) AS block, md5(replace(replace(string_agg(line, chr(10) ORDER BY seq), '-' || chr(10), ''), chr(10), ' ')) AS text FROM b GROUP BY policy, block""")
def join_wrapped_lines(spark, sf_dir):
    return C.join_wrapped_lines(_lines(spark, sf_dir)).withColumn("text", F.md5("text"))


@register("drop_short", f"WITH {_ISL} SELECT policy, count(*) AS n FROM cl WHERE length(text) >= 60 GROUP BY policy")
def drop_short(spark, sf_dir):
    return C.drop_short(_islands(spark, sf_dir)).groupBy("policy").agg(F.count(F.lit(1)).alias("n"))


@register("keep_fullest", f"""WITH {_ISL}, c2 AS (SELECT policy, regexp_extract(clause_id, '([0-9]+)$', 1) AS clause_id, pos, text FROM cl),
  r AS (SELECT *, row_number() OVER (PARTITION BY policy, clause_id ORDER BY length(text) DESC, pos) AS k FROM c2) SELECT policy, clause_id, pos FROM r WHERE k = 1""")
def keep_fullest(spark, sf_dir):
    short = _islands(spark, sf_dir).withColumn("clause_id", F.regexp_extract("clause_id", "([0-9]+)$", 1))
    return C.keep_fullest(short).select("policy", "clause_id", "pos")


@register("split_definitions", f"""WITH d AS (SELECT source AS policy, doc_id, text, string_split(text, '{_MARK}')[2:] AS parts FROM documents),
  m AS (SELECT policy, doc_id, text, list_filter(list_transform(range(1, len(parts) + 1), lambda i: {{'n': i, 't': trim(parts[i])}}), lambda x: length(x.t) >= 40) AS kept, len(parts) AS n FROM d)
  SELECT policy, doc_id::VARCHAR || '.Def ' || e.n::VARCHAR AS clause_id, md5(e.t) AS text FROM (SELECT policy, doc_id, unnest(kept) AS e FROM m WHERE n >= 5 AND len(kept) > 0)
  UNION ALL SELECT policy, doc_id::VARCHAR, md5(text) FROM m WHERE n < 5 OR len(kept) = 0""")
def split_definitions(spark, sf_dir):
    clauses = V.clauses(spark, sf_dir).withColumn("title", F.lit(""))
    return C.split_definitions(clauses, _MARK).select("policy", "clause_id", F.md5("text").alias("text"))


@register("trim_address_blocks", """WITH d AS (SELECT source AS policy, doc_id AS clause_id, text, string_split(text, chr(10)) AS ls, len(regexp_extract_all(text, 'The')) AS n FROM documents),
  l AS (SELECT *, list_max(list_transform(range(1, len(ls) + 1), lambda i: CASE WHEN contains(ls[i], 'The') THEN i END)) AS last FROM d),
  o AS (SELECT policy, clause_id, n, CASE WHEN n >= 4 THEN array_to_string(ls[last + 1:], chr(10)) ELSE text END AS text FROM l)
  SELECT policy, clause_id, md5(text) AS text FROM o WHERE n < 4 OR length(text) >= 60""")
def trim_address_blocks(spark, sf_dir):
    return C.trim_address_blocks(V.clauses(spark, sf_dir), "The").select("policy", "clause_id", F.md5("text").alias("text"))


def _id(n: str, div: str) -> str:
    """Ids of four shapes, by the number of the document."""
    return f"CASE {n} % 4 WHEN 0 THEN concat('A.', {n}) WHEN 1 THEN concat('II.', {n}) WHEN 2 THEN concat({n} {div} 10, '.', {n} % 10) ELSE concat({n}, '') END"


_M = ("4 * (n * 3 % 50)", "4 * (n % 60) + 1", "4 * (n % 60) + 5", "4 * (n % 70) + 2", "4 * (n % 20) + 3")


def _referring(spark, sf_dir):
    """Clauses with ids of four shapes whose texts name others: alone, in lists and twice."""
    a, v, w, c, e = (_id(m, "DIV") for m in (f"({m})" for m in _M))
    told = f"concat(text, ' as in clause ', {c}, ' or Coverages ', {v}, ', ', {w}, ' and ', {v}, ' of Section ', replace({a}, '.', '-'), ' see Exclusion No. ', {e}, ' too')"
    docs = V.clauses(spark, sf_dir).withColumnRenamed("clause_id", "n")
    return docs.select("policy", "n", F.expr(_id("n", "DIV")).alias("clause_id"), F.expr(told).alias("text"))


@register("extract_refs", f"""WITH d AS (SELECT source AS policy, doc_id AS n FROM documents), k AS (SELECT policy, {_id("n", "//")} AS clause_id, unnest([{", ".join(_id(f"({m})", "//") for m in _M)}]) AS ref, unnest([1, 2, 3, 4, 5]) AS k FROM d),
  own AS (SELECT policy, {_id("n", "//")} AS ref FROM d), f AS (SELECT policy, clause_id, ref, min(k) AS k FROM k WHERE ref <> clause_id AND (policy, ref) IN (SELECT policy, ref FROM own) GROUP BY ALL)
  SELECT policy, clause_id, string_agg(ref, ',' ORDER BY k) AS refs FROM f GROUP BY policy, clause_id""")
def extract_refs(spark, sf_dir):
    return C.extract_refs(_referring(spark, sf_dir)).select("policy", "clause_id", F.array_join("refs", ",").alias("refs"))


_EXCL = r"Code[- ]?\s?Excl\s?(0?[0-9]{1,2})"
_CODED = """cd AS (SELECT source AS policy, doc_id AS clause_id, (doc_id * 7) % 1000 AS pos, CASE WHEN doc_id % 5 = 0 THEN doc_id % 7 END AS own, (doc_id + 3) % 7 AS other FROM documents),
  rc AS (SELECT DISTINCT ON (policy, own) policy, CAST(own AS VARCHAR) AS code, clause_id FROM cd WHERE own IS NOT NULL ORDER BY policy, own, pos, clause_id)"""


def _with_codes(spark, sf_dir):
    """Clauses of which every fifth carries a code in its heading and all name another one at the end."""
    text = "concat(CASE WHEN clause_id % 5 = 0 THEN concat('Code-Excl0', clause_id % 7, ': ') ELSE '' END, coalesce(text, ''), ' subject to Code Excl ', (clause_id + 3) % 7)"
    return V.clauses(spark, sf_dir).select("policy", "clause_id", F.expr("(clause_id * 7) % 1000").alias("pos"), F.expr(text).alias("text"))


@register("resolve_codes", f"WITH {_CODED} SELECT policy, code, clause_id FROM rc")
def resolve_codes(spark, sf_dir):
    clauses = _with_codes(spark, sf_dir).withColumn("text", F.regexp_replace("text", " subject to Code Excl [0-9]$", ""))
    return C.resolve_codes(clauses, _EXCL, order="pos")


@register("append_code_refs", f"""WITH {_CODED}, t AS (SELECT policy, clause_id, CAST(clause_id + 1 AS VARCHAR) AS ref, 0 AS k FROM cd
    UNION ALL SELECT cd.policy, cd.clause_id, CAST(rc.clause_id AS VARCHAR), 1 FROM cd JOIN rc ON rc.policy = cd.policy AND rc.code = CAST(own AS VARCHAR)
    UNION ALL SELECT cd.policy, cd.clause_id, CAST(rc.clause_id AS VARCHAR), 2 FROM cd JOIN rc ON rc.policy = cd.policy AND rc.code = CAST(other AS VARCHAR)),
  f AS (SELECT policy, clause_id, ref, min(k) AS k FROM t WHERE ref <> CAST(clause_id AS VARCHAR) GROUP BY ALL)
  SELECT policy, clause_id, string_agg(ref, ',' ORDER BY k) AS refs FROM f GROUP BY policy, clause_id""")
def append_code_refs(spark, sf_dir):
    clauses = _with_codes(spark, sf_dir)
    codes = C.resolve_codes(clauses.withColumn("text", F.regexp_replace("text", " subject to Code Excl [0-9]$", "")), _EXCL, order="pos")
    told = C.append_code_refs(clauses.withColumn("refs", F.array((F.col("clause_id") + 1).cast("string"))), codes)
    return told.select("policy", "clause_id", F.array_join("refs", ",").alias("refs"))


_RULES = (("worthless", "exclusion"), ("token", "definition"), (" onen ", "limit"))
_RULE_SQL = "CASE WHEN regexp_matches(text, 'worthless') THEN 'exclusion' WHEN regexp_matches(text, 'token') THEN 'definition' WHEN regexp_matches(text, ' onen ') THEN 'limit' ELSE 'other' END"


@register("label_rule_type", f"SELECT doc_id AS clause_id, {_RULE_SQL} AS rule_type FROM documents")
def label_rule_type(spark, sf_dir):
    return C.label_rule_type(V.clauses(spark, sf_dir), _RULES).select("clause_id", "rule_type")


@register("labels_of_table", f"""WITH given AS (SELECT doc_id, CASE WHEN max(toxic) = 1 THEN 'exclusion' ELSE 'checked' END AS given FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id)
  SELECT doc_id AS clause_id, coalesce(given, {_RULE_SQL}) AS rule_type FROM documents LEFT JOIN given USING (doc_id)""")
def labels_of_table(spark, sf_dir):
    """The label of a table where a clause has one, that of the patterns elsewhere."""
    clauses = V.clauses(spark, sf_dir)
    given = V.table(spark, sf_dir, "labels").where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("clause_id")).agg(F.max("toxic").alias("toxic"))
    labels = given.join(clauses.select("policy", "clause_id").hint("merge"), "clause_id").selectExpr("policy", "clause_id", "IF(toxic = 1, 'exclusion', 'checked') AS rule_type")
    return C.label_rule_type(clauses, _RULES, labels).select("clause_id", "rule_type")


@register("clause_documents", f"SELECT source || ':' || doc_id AS id, source AS policy, md5(text) AS text, lang AS title, doc_id % 10 AS page, {_RULE_SQL} AS rule_type FROM documents")
def clause_documents(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").selectExpr("source AS policy", "doc_id AS clause_id", "text", "lang AS title", "doc_id % 10 AS page")
    return C.clause_documents(C.label_rule_type(docs, _RULES)).withColumn("text", F.md5("text"))


@register("corpus_counts", f"""SELECT source AS policy, rule_type, count(*) AS n FROM (SELECT *, {_RULE_SQL} AS rule_type FROM documents) GROUP BY CUBE (source, rule_type)
  UNION ALL SELECT NULL, 'non-payable list', 5
  UNION ALL SELECT source, 'sums insured', coalesce(nullif(count(DISTINCT doc_id % 5) FILTER (doc_id % 7 = 0), 0), 4) FROM documents GROUP BY source""")
def corpus_counts(spark, sf_dir):
    clauses = V.clauses(spark, sf_dir)
    tabled = clauses.withColumn("text", F.expr("CASE WHEN clause_id % 7 = 0 THEN concat(text, '\\nSum Insured ', 100000 * (1 + clause_id % 5)) ELSE text END"))
    return C.corpus_counts(C.label_rule_type(clauses, _RULES), not_payable_list(spark), K.sum_insured_options(tabled))


def _grouped(n: str) -> str:
    return f"concat(CAST({n} DIV 100000 AS STRING), ',00,000')"


@register("table_rows", """SELECT source AS policy, doc_id AS clause_id, CAST(k * 100000 AS BIGINT) AS sum_insured, 'Up to ' || (doc_id + k) || ' per day' AS limit_text
  FROM documents, (VALUES (1), (2), (3)) t(k) WHERE doc_id % 3 = 0""")
def table_rows(spark, sf_dir):
    row = lambda k, n: f"concat('[table] Sum Insured ', {_grouped(k)}, '/- - Limit Up to ', {n}, ' per day')"
    rows = ", ".join(row(f"{k}00000", f"clause_id + {k}") for k in (1, 2, 3)) + ", " + row("100000", "0") + ", concat('[table] Sum Insured 4,00,000/- - Limit Up to ', clause_id, ' visits')"
    text = F.expr(f"CASE WHEN clause_id % 3 = 0 THEN concat_ws('\\n', substring(text, 1, 40), {rows}) ELSE text END")
    return C.table_rows(V.clauses(spark, sf_dir).withColumn("text", text))


@register("corruption_signals", r"""WITH d AS (SELECT source AS policy, doc_id AS clause_id, replace(replace(text, ' the ', ' days '), ' of ', ' up to ') AS text FROM documents)
  SELECT policy, clause_id, 'units' AS signal FROM d WHERE len(regexp_extract_all(text, '\b(?:days|months|per day)\b')) > 2
  UNION ALL SELECT policy, clause_id, 'upto' FROM d WHERE len(regexp_extract_all(text, '(?i)\bup ?to\b')) > 2
  UNION ALL SELECT policy, clause_id, 'not covered' FROM d WHERE regexp_matches(text, '(?i)not covered[^\n]*[0-9]{3}')
  UNION ALL SELECT policy, clause_id, 'numbers' FROM d WHERE len(list_filter(string_split(text, chr(10)), lambda l: len(list_filter(string_split(l, ' '), lambda w: w <> '')) >= 4
    AND len(list_filter(string_split(l, ' '), lambda w: regexp_matches(w, '^[0-9][0-9.,/-]*$'))) * 5 >= len(list_filter(string_split(l, ' '), lambda w: w <> '')) * 2)) > 0
  UNION ALL SELECT policy, clause_id, 'lists' FROM d WHERE len(list_filter(string_split(text, chr(10)), lambda l: len(regexp_extract_all(l, '\b[0-9]{1,2}\. ')) >= 3)) > 0""")
def corruption_signals(spark, sf_dir):
    text = F.replace(F.replace("text", F.lit(" the "), F.lit(" days ")), F.lit(" of "), F.lit(" up to "))
    return C.corruption_signals(V.clauses(spark, sf_dir).withColumn("text", text))


@register("text_diff", """WITH a AS (SELECT source AS policy, doc_id AS clause_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS x FROM documents),
  b AS (SELECT source AS policy, doc_id AS clause_id, unnest(range(len(string_split(regexp_replace(text, '\\n[^\\n]*$', ''), chr(10))))) AS pos,
    unnest(string_split(replace(regexp_replace(text, '\\n[^\\n]*$', ''), 'token', 'TOKEN'), chr(10))) AS y FROM documents)
  SELECT policy, clause_id, CAST(pos AS INTEGER) AS pos, md5(x) AS expected, md5(y) AS actual FROM a FULL JOIN b USING (policy, clause_id, pos) WHERE x IS DISTINCT FROM y""")
def text_diff(spark, sf_dir):
    clauses = V.clauses(spark, sf_dir)
    other = clauses.withColumn("text", F.replace(F.regexp_replace("text", r"\n[^\n]*$", ""), F.lit("token"), F.lit("TOKEN")))
    return C.text_diff(clauses, other).withColumns({c: F.md5(c) for c in ("expected", "actual")})


@register("index_coverage", """SELECT source AS policy, CAST(sum(length(text)) AS BIGINT) AS characters, count(*) AS n, sum(length(text)) >= 100000 AND count(*) * 100 >= 50 * 95 AS ok FROM documents GROUP BY source""")
def index_coverage(spark, sf_dir):
    floors = V.table(spark, sf_dir, "documents").select(F.col("source").alias("policy")).distinct().withColumns({"floor": F.lit(100000), "pinned": F.lit(50)})
    return C.index_coverage(V.clauses(spark, sf_dir), floors)


@register("lost_pages", """WITH d AS (SELECT source AS policy, doc_id AS page, text, regexp_replace(lower(text), '[^0-9a-z]', '', 'g') AS sq FROM documents),
  p AS (SELECT policy, page, substr(sq, 11, 30) AS probe FROM d WHERE length(sq) >= 40), c AS (SELECT policy, CASE WHEN page % 9 = 0 THEN regexp_replace(lower(substr(text, 1, 20)), '[^0-9a-z]', '', 'g') ELSE sq END AS sq FROM d)
  SELECT policy, page FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.policy = p.policy AND contains(c.sq, p.probe))""")
def lost_pages(spark, sf_dir):
    """Each document as a page of which a probe was kept, against clauses of which every ninth lost its text."""
    pages = _pages(spark, sf_dir).withColumn("sq", C.squash(F.col("text"))).where("length(sq) >= 40")
    probes = pages.select("policy", "page", F.substring("sq", 11, 30).alias("probe"))
    clauses = V.clauses(spark, sf_dir).withColumn("text", F.expr("CASE WHEN clause_id % 9 = 0 THEN substring(text, 1, 20) ELSE text END"))
    return C.lost_pages(clauses, probes)


def _cells(spark, sf_dir):
    """Lines of a bill as a table of two columns, with blanks, under one heading row."""
    lines = V.bill_lines(spark, sf_dir)
    one = lines.selectExpr("bill_id AS table_id", "line_no AS row", "1 AS col", "CASE WHEN line_no % 2 = 0 AND line_no > 1 THEN '' ELSE item END AS cell", "true AS is_data")
    two = lines.selectExpr("bill_id AS table_id", "line_no AS row", "2 AS col", "CAST(qty AS STRING) AS cell", "true AS is_data")
    return one.unionByName(two)


@register("fill_down_rows", f"""WITH {V.LINES}, f AS (SELECT bill_id, line_no, qty, last_value(CASE WHEN line_no % 2 = 0 THEN NULL ELSE item END IGNORE NULLS)
    OVER (PARTITION BY bill_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS item FROM lines)
  SELECT bill_id AS table_id, line_no AS row, '[table] Item ' || item || ' - Days ' || qty AS line FROM f""")
def fill_down_rows(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    headers = cells.select("table_id", "col").distinct().withColumn("header", F.expr("CASE col WHEN 1 THEN 'Item' ELSE 'Days' END"))
    return C.render_rows(C.fill_down(cells), headers)


def _words(spark, sf_dir):
    """Lines of bills laid out as words on a page: two words for each item."""
    lines = V.bill_lines(spark, sf_dir)
    each = lines.select("bill_id", "line_no", F.posexplode(F.split("item", " ")).alias("i", "word"))
    return each.selectExpr("bill_id AS doc", "line_no AS page", "CAST(i * 50 + (bill_id % 7) * 10 AS DOUBLE) AS x0", "CAST(i * 50 + 40 + (bill_id % 7) * 10 AS DOUBLE) AS x1", "0.0D AS top", "10.0D AS bottom", "word")


@register("words_to_cells", f"""WITH {V.LINES}, w AS (SELECT bill_id, line_no, i, split_part(item, ' ', i + 1) AS word, i * 50 + 20 + (bill_id % 7) * 10 AS mid FROM lines, (VALUES (0), (1)) t(i))
  SELECT bill_id AS doc, line_no AS page, cell, string_agg(word, ' ' ORDER BY i) AS text FROM w JOIN (VALUES (1, 0, 60), (2, 60, 100)) c(cell, a, b) ON mid BETWEEN a AND b GROUP BY ALL""")
def words_to_cells(spark, sf_dir):
    words = _words(spark, sf_dir)
    boxes = spark.createDataFrame([(1, 0.0, 60.0, 0.0, 20.0), (2, 60.0, 100.0, 0.0, 20.0)], "cell int, cx0 double, cx1 double, cy0 double, cy1 double")
    cells = words.select("doc", "page").distinct().crossJoin(F.broadcast(boxes))  # two boxes a page
    return T.words_to_cells(words, cells)


@register("table_rows", f"""WITH {V.LINES} SELECT bill_id AS doc, line_no AS row, col, CASE WHEN col = 1 THEN item
      WHEN bill_id % 2 = 0 AND line_no % 3 = 0 THEN qty::VARCHAR || ' ' || cents::VARCHAR WHEN col = 2 THEN qty::VARCHAR
      WHEN bill_id % 2 = 1 AND line_no % 2 = 0 THEN lag(cents) OVER (PARTITION BY bill_id, col ORDER BY line_no)::VARCHAR ELSE cents::VARCHAR END AS text
    FROM lines, (VALUES (1), (2), (3)) c(col)""")
def table_rows(spark, sf_dir):
    """Bills as printed tables of item, days and amount; some rows have one cell over two columns, others share the amount's cell with the row below."""
    lines = stored(V.bill_lines(spark, sf_dir), folder(spark, "lines"))
    items = lines.select("bill_id", "line_no", F.posexplode(F.split("item", " ")).alias("i", "word")).selectExpr("bill_id AS doc", "1 AS page", "i * 40.0D AS x0", "i * 40.0D + 30 AS x1", "line_no * 20.0D AS top", "line_no * 20.0D + 8 AS bottom", "word")
    shared = "bill_id % 2 = 1 AND line_no % 2 = 0"
    figures = lines.selectExpr("bill_id AS doc", "1 AS page", f"stack(2, 110.0D, 140.0D, CAST(qty AS STRING), 210.0D, 280.0D, IF({shared}, NULL, CAST(cents AS STRING))) AS (x0, x1, word)", "line_no * 20.0D AS top", "line_no * 20.0D + 8 AS bottom")
    wide, tall = "bill_id % 2 = 0 AND line_no % 3 = 0", "bill_id % 2 = 1"
    cell = "named_struct('k', {k}, 'cx0', {a}.0D, 'cx1', {b}, 'h', {h})".format
    boxes = [cell(k=0, a=0, b="100.0D", h="20.0D"), cell(k=1, a=100, b=f"IF({wide}, 300.0D, 200.0D)", h="20.0D"), f"IF({wide} OR {shared}, NULL, {cell(k=2, a=200, b='300.0D', h=f'IF({tall}, 40.0D, 20.0D)')})"]
    each = lines.selectExpr("bill_id AS doc", "line_no", f"explode(array({', '.join(boxes)})) AS c").where("c IS NOT NULL")
    cells = each.selectExpr("doc", "1 AS page", "1 AS table_no", "line_no * 3 + c.k AS cell", "c.cx0", "c.cx1", "line_no * 20.0D - 5 AS cy0", "line_no * 20.0D - 5 + c.h AS cy1")
    cells = stored(cells, folder(spark, "cells"))
    return T.table_rows(items.unionByName(figures), cells).select("doc", "row", "col", "text")


@register("drop_phantom_spaces", f"""WITH {V.LINES} SELECT bill_id AS doc, line_no AS page, CASE WHEN line_no % 2 = 0 THEN replace(item, ' ', '') ELSE item END AS text FROM lines""")
def drop_phantom_spaces(spark, sf_dir):
    lines = V.bill_lines(spark, sf_dir)
    each = lines.select("bill_id", "line_no", F.posexplode(F.filter(F.split("item", ""), lambda c: c != "")).alias("n", "char"))
    # On even pages a space has no width of its own: it lies in the box of the glyph before it.
    space = "char = ' ' AND line_no % 2 = 0"
    glyphs = each.selectExpr("bill_id AS doc", "line_no AS page", "n", "char", f"CASE WHEN {space} THEN n * 10 - 5.0D ELSE n * 10.0D END AS x0", f"CASE WHEN {space} THEN n * 10 - 2.0D ELSE n * 10 + 9.0D END AS x1", "5.0D AS top")
    kept = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "char"))), lambda g: g["char"]), "")
    return C.drop_phantom_spaces(glyphs).groupBy("doc", "page").agg(kept.alias("text"))


@register("layout_vote", f"""WITH {V.LINES}, w AS (SELECT bill_id % 500 AS doc, line_no AS page, bill_id // 500 AS y, (bill_id % 7 + qty) * 10 AS x0 FROM lines),
  l AS (SELECT doc, page, y, min(x0) AS x0 FROM w GROUP BY ALL), s AS (SELECT doc, page, count(*) FILTER (x0 > 200) * 1000000 // count(*) AS share FROM l GROUP BY ALL),
  v AS (SELECT doc, list_sort(list(share)) AS s FROM s GROUP BY doc) SELECT doc, CAST(s[len(s) // 2 + 1] AS BIGINT) AS share, s[len(s) // 2 + 1] > 150000 AS two_columns FROM v""")
def layout_vote(spark, sf_dir):
    lines = V.bill_lines(spark, sf_dir)
    words = lines.selectExpr("bill_id % 500 AS doc", "line_no AS page", "CAST(bill_id DIV 500 * 3 AS DOUBLE) AS top", "CAST((bill_id % 7 + qty) * 10 AS DOUBLE) AS x0")
    return C.layout_vote(words, 400.0)


@register("echo_lines", f"""WITH {_L}, r AS (SELECT DISTINCT source AS policy, unnest(string_split(lower(text), ' ')) AS word FROM documents WHERE regexp_matches(text, '[0-9]')),
  o AS (SELECT policy, seq, unnest(list_filter(string_split(lower(line), ' '), lambda w: w <> '')) AS word FROM lines),
  t AS (SELECT o.policy, seq, count(*) AS n, count(r.word) AS k FROM o LEFT JOIN r ON r.policy = o.policy AND r.word = o.word GROUP BY ALL)
  SELECT policy, seq FROM t WHERE k * 5 >= n * 4""")
def echo_lines(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").where("text RLIKE '[0-9]'")  # documents with figures are taken for tables
    words = docs.select(F.col("source").alias("policy"), F.explode(F.split(F.lower("text"), " ")).alias("word"))
    return C.echo_lines(_lines(spark, sf_dir), words)


