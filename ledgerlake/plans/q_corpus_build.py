"""The whole corpus build over the documents as pages (policy = source, page = doc_id), laid out like policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.operators import corpus as C
from ledgerlake.operators import corpus_build as B
from ledgerlake.plans import sql_text as S
from ledgerlake.plans import views as V
from ledgerlake.plans.q_corpus import TITLES, more
from ledgerlake.plans.registry import register

#: A line x with number i of page d gets the marks of a policy: banners, headings, tables, items, hyphens, references, definitions, addresses.
_MARKED = """CASE WHEN i % 8 = 0 AND d % 5 = 0 THEN concat('SECTION ', {chr}, ' Cover rules')
  WHEN i % 8 = 1 THEN concat(CAST(d % 40 AS {text}), '.', CAST(i % 3 + 1 AS {text}), ' Room ', substr(x, 1, 40), CASE WHEN d % 2 = 0 THEN ' of the' ELSE '' END)
  WHEN d % 13 = 0 AND i % 8 > 1 THEN concat('Def. ', CAST(i AS {text}), '. Term', CAST(i AS {text}), ' means ', x)
  WHEN d % 17 = 0 AND i % 8 IN (2, 3) THEN concat('Ombudsman Tel.: Email: bimalokpal ', x)
  WHEN i % 8 = 2 AND d % 4 = 0 THEN concat('[table] ', substr(x, 1, 30)) WHEN i % 8 = 3 AND d % 3 = 0 THEN concat('a) ', x) WHEN i % 8 = 4 AND d % 7 = 0 THEN concat(x, '-')
  WHEN i % 8 = 5 THEN concat(x, ' see Section ', {chr}, '.', CAST(d % 40 AS {text}), '.2 and Code Excl 0', CAST(d % 5 AS {text})) ELSE x END"""
_TYPES = (("worthless", "exclusion"), (r"means", "definition"), (r"\[table\]", "limit"))


def _pages(spark, sf_dir):
    line = F.expr(f"transform(split(text, '\\n', -1), (x, i) -> {_MARKED.format(chr='chr(65 + d % 3)', text='STRING')})")
    docs = V.table(spark, sf_dir, "documents").select(F.col("source").alias("policy"), F.col("doc_id").alias("page"), F.col("doc_id").alias("d"), "text")
    foot = F.array(F.lit("Policy wording"), F.concat(F.lit("Page "), F.col("d") % 100, F.lit(" of 100")))
    return docs.select("policy", "page", F.array_join(F.concat(line, foot), "\n").alias("text"))


def _glue(line: str, above: str) -> str:
    layout = B.LAYOUT
    table = lambda c: f"starts_with({S.strip(c)}, '[table]')"
    starts = f"(regexp_matches({line}, '{layout.heading}') OR {table(line)} OR regexp_matches({line}, '{layout.sub_item}'))"
    closed = f"(regexp_matches({above}, '{layout.heading}') OR {table(above)})"
    return f"CASE WHEN {above} IS NULL OR {starts} OR {closed} THEN 'new' WHEN ends_with({above}, '-') THEN 'word' WHEN regexp_matches({above}, '[.:;?!|]$') THEN 'new' ELSE 'space' END"


_L = B.LAYOUT
_LEFT = r"regexp_replace(line, '^\s+', '')"
_SQL = rf"""WITH doc AS (SELECT source AS policy, doc_id AS page, doc_id AS d, string_split(text, chr(10)) AS ls FROM documents),
  ml AS (SELECT policy, page, i, {_MARKED.format(chr="chr(CAST(65 + d % 3 AS INTEGER))", text="VARCHAR")} AS line FROM (SELECT policy, page, d, unnest(range(len(ls))) AS i, unnest(ls) AS x FROM doc)
    UNION ALL SELECT policy, page, len(ls), 'Policy wording' FROM doc UNION ALL SELECT policy, page, len(ls) + 1, 'Page ' || (d % 100)::VARCHAR || ' of 100' FROM doc),
  ln AS (SELECT policy, page, i, regexp_replace(line, '\s+$', '') AS line, {S.strip("line")} AS t FROM ml),
  fu AS (SELECT policy, t FROM (SELECT DISTINCT policy, page, t FROM ln WHERE t <> '') JOIN (SELECT policy, count(*) AS n FROM doc GROUP BY policy) USING (policy) GROUP BY policy, t, n HAVING count(*) >= greatest(2, floor(n * 0.5))),
  ok AS (SELECT ln.* FROM ln LEFT JOIN fu USING (policy, t) WHERE t <> '' AND NOT regexp_matches(t, '{_L.page_number}') AND NOT EXISTS (SELECT 1 FROM fu f WHERE f.policy = ln.policy AND f.t = ln.t)),
  w AS (SELECT policy, page, i, line, CASE WHEN regexp_matches(line, '{_L.banners[0]}') THEN regexp_extract(line, '{_L.banners[0]}', 1) WHEN regexp_matches(line, '{_L.banners[1]}') THEN regexp_extract(line, '{_L.banners[1]}', 1) END AS banner,
    lag(line) OVER o AS above, lead(line) OVER o AS below, [lead(line) OVER o, lead(line, 2) OVER o, lead(line, 3) OVER o] AS nx, row_number() OVER o AS k FROM ok WINDOW o AS (PARTITION BY policy ORDER BY page, i)),
  h AS (SELECT *, last_value(banner IGNORE NULLS) OVER (PARTITION BY policy ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section, regexp_extract(line, '{_L.heading}', 2) AS raw FROM w),
  c0 AS (SELECT policy, k, more, title, {S.colon("title")} AS head
    FROM (SELECT *, {more("nx")} AS more, {S.cap(S.strip("regexp_replace(raw, ':+$', '')"))} AS title FROM h WHERE banner IS NULL AND regexp_matches(line, '{_L.heading}') AND {S.title_like("raw")} AND NOT {S.debris("raw")})),
  {TITLES},
  hd AS (SELECT h.*, tt.title AS title FROM h LEFT JOIN (SELECT * FROM tt WHERE NOT {S.debris("title")}) tt USING (policy, k)),
  nb AS (SELECT *, count(title) OVER (PARTITION BY policy ORDER BY k) AS clause, {_glue("line", "above")} AS how, CASE WHEN below IS NOT NULL THEN {_glue("below", "line")} END AS nexthow FROM hd),
  pc AS (SELECT policy, clause, k, CASE how WHEN 'new' THEN chr(10) || line WHEN 'space' THEN ' ' || {_LEFT} ELSE {_LEFT} END AS piece, nexthow FROM nb WHERE clause > 0 AND title IS NULL),
  bd AS (SELECT policy, clause, substr(string_agg(CASE WHEN nexthow = 'word' THEN regexp_replace(piece, '-$', '') ELSE piece END, '' ORDER BY k), 2) AS body FROM pc GROUP BY ALL),
  cl AS (SELECT policy, concat_ws('.', section, regexp_extract(line, '{_L.heading}', 1)) AS clause_id, substr(title, 1, 120) AS title, {S.strip(f"{S.cap(S.strip('raw'))} || chr(10) || {S.cap('body')}")} AS text, page, clause AS pos
    FROM nb JOIN bd USING (policy, clause) WHERE title IS NOT NULL AND length(body) >= 60),
  ft AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY policy, clause_id ORDER BY length(text) DESC, pos) AS r FROM cl) WHERE r = 1),
  df AS (SELECT *, regexp_extract_all(text, '{_L.definition}', 1) AS ns, list_transform(regexp_split_to_array(text, '{_L.definition}')[2:], lambda x: {S.strip("x")}) AS bs FROM ft),
  dp AS (SELECT *, CASE WHEN len(ns) >= 5 THEN list_filter(list_zip(ns, bs, range(len(ns))), lambda z: length(z[2]) >= 40) ELSE [] END AS kept FROM df),
  ex AS (SELECT policy, clause_id, title, text, page, pos, 0 AS sub FROM dp WHERE len(kept) = 0
    UNION ALL SELECT policy, clause_id || '.Def' || e[1], CASE WHEN length(regexp_split_to_array(e[2], '{_L.defined}')[1]) < 80 THEN substr({S.strip(f"regexp_split_to_array(e[2], '{_L.defined}')[1]")}, 1, 80) ELSE substr(e[2], 1, 60) END, e[2], page, pos, e[3]
      FROM (SELECT policy, clause_id, page, pos, unnest(kept) AS e FROM dp WHERE len(kept) > 0)),
  ab AS (SELECT *, CASE WHEN len(regexp_extract_all(text, '{_L.address}')) >= 4 THEN {S.strip(f"array_to_string(string_split(text, chr(10))[list_max(list_transform(range(1, len(string_split(text, chr(10))) + 1), lambda i: CASE WHEN regexp_matches(string_split(text, chr(10))[i], '{_L.address}') THEN i END)) + 1:], chr(10))")} END AS cut FROM ex),
  fin AS (SELECT policy, clause_id, CASE WHEN cut IS NULL THEN title ELSE substr(coalesce(list_filter(list_transform(string_split(cut, chr(10)), lambda x: {S.strip("x")}), lambda x: NOT starts_with(x, '[table]') AND {S.title_like("x")} AND NOT {S.debris("x")})[1], title), 1, 120) END AS title,
    coalesce(cut, text) AS text, page, pos, sub FROM ab WHERE cut IS NULL OR length(cut) >= 60),
  sr AS (SELECT policy, clause_id, ref, 0 AS kind, min(n) AS n FROM (SELECT policy, clause_id, unnest(list_transform(regexp_extract_all(text, '\bSection\s+([A-E][.\- ]\s?[0-9]+(?:\.[0-9]+)*)', 1), lambda r: regexp_replace(r, '^([A-E])[.\- ]\s?', '\1.'))) AS ref,
      unnest(range(len(regexp_extract_all(text, '\bSection\s+([A-E][.\- ]\s?[0-9]+(?:\.[0-9]+)*)', 1)))) AS n FROM fin) WHERE (policy, ref) IN (SELECT policy, clause_id FROM fin) GROUP BY ALL),
  cd AS (SELECT DISTINCT ON (policy, code) policy, code, clause_id AS target FROM (SELECT policy, clause_id, pos, sub, unnest(list_transform(regexp_extract_all(substr(text, 1, 160), '{_L.code}', 1), lambda r: regexp_replace(r, '^0+(.)', '\1'))) AS code FROM fin) ORDER BY policy, code, pos, sub),
  cr AS (SELECT policy, clause_id, target AS ref, 1 AS kind, min(n) AS n FROM (SELECT policy, clause_id, unnest(list_transform(regexp_extract_all(text, '{C.CODE_MENTION}', 1), lambda r: regexp_replace(r, '^0+(.)', '\1'))) AS code,
      unnest(range(len(regexp_extract_all(text, '{C.CODE_MENTION}', 1)))) AS n FROM fin) JOIN cd USING (policy, code) GROUP BY ALL),
  rf AS (SELECT policy, clause_id, ref, min(kind * 100000 + n) AS n FROM (SELECT * FROM sr UNION ALL SELECT * FROM cr) WHERE ref <> clause_id GROUP BY ALL),
  rl AS (SELECT policy, clause_id, string_agg(ref, ',' ORDER BY n) AS refs FROM (SELECT *, row_number() OVER (PARTITION BY policy, clause_id ORDER BY n) AS r FROM rf) WHERE r <= 12 GROUP BY ALL)
  SELECT policy, clause_id, md5(title) AS title, md5(text) AS text, page, coalesce(refs, '') AS refs,
    CASE WHEN regexp_matches(text, 'worthless') THEN 'exclusion' WHEN regexp_matches(text, 'means') THEN 'definition' WHEN contains(text, '[table]') THEN 'limit' ELSE 'other' END AS rule_type
  FROM fin LEFT JOIN rl USING (policy, clause_id)"""


@register("build_corpus", _SQL)
def build_corpus(spark, sf_dir):
    """Clauses of all policies with ids, titles, texts, pages, types and references."""
    told = B.build_corpus(_pages(spark, sf_dir), _TYPES)
    return told.select("policy", "clause_id", F.md5("title").alias("title"), F.md5("text").alias("text"), "page", F.array_join("refs", ",").alias("refs"), "rule_type")
