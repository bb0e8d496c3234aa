"""Queries of scoring and of the audit of the key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.functions.text import normalise_quote as normalise
from ledgerlake.operators import evaluation as E
from ledgerlake.operators import locate as L
from ledgerlake.plans import views as V
from ledgerlake.plans.q_retrieval import holding
from ledgerlake.plans.registry import register

_KEY = f"""{V.BOTH}, v AS (SELECT bill_id, line_no, policy, category, CASE WHEN bill_id % 6 = 0 THEN NULL ELSE cents END AS allowed, bill_id % 4 AS clause,
    CASE WHEN bill_id % 5 = 0 THEN NULL ELSE cents + CASE WHEN bill_id % 7 = 0 THEN 500 ELSE 50 END END AS expected, bill_id % 3 AS key_clause, bill_id % 10 = 0 AS key_flag FROM lb),
  fl AS (SELECT *, expected IS NOT NULL OR key_flag AS filled, expected IS NULL AS sh, allowed IS NULL AS di FROM v),
  flags AS (SELECT bill_id, line_no, category, expected, allowed, filled, filled AND CASE WHEN sh THEN di ELSE coalesce(abs(allowed - expected) <= 100, false) END AS "right",
    filled AND clause = key_clause AS cited, filled AND sh AS should_abstain, filled AND di AS did_abstain, filled AND sh AND NOT di AS false_answer, filled AND NOT sh AND di AS dodge,
    filled AND clause IS NOT NULL AND NOT EXISTS (SELECT 1 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = fl.policy AND n_nationkey % 5 = fl.clause) AS fabricated FROM fl)"""


def _key(spark, sf_dir):
    lines = V.lines_of_bills(spark, sf_dir)
    key = lines.selectExpr(
        "bill_id", "line_no", "policy", "category", "CASE WHEN bill_id % 5 = 0 THEN NULL ELSE cents + CASE WHEN bill_id % 7 = 0 THEN 500 ELSE 50 END END AS expected",
        "bill_id % 3 AS key_clause", "bill_id % 10 = 0 AS key_flag",
    )
    verdicts = lines.selectExpr("bill_id", "line_no", "CASE WHEN bill_id % 6 = 0 THEN NULL ELSE cents END AS allowed", "bill_id % 4 AS clause")
    return key, verdicts


def _known(spark, sf_dir):
    """The clauses of each policy: a number for each of its nations."""
    places = V.table(spark, sf_dir, "nation").join(V.table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    return places.selectExpr("r_name AS policy", "n_nationkey % 5 AS clause")


def _flags(spark, sf_dir):
    key, verdicts = _key(spark, sf_dir)
    return E.score_lines(verdicts, key, _known(spark, sf_dir))


@register("score_lines", f"WITH {_KEY} SELECT * FROM flags")
def score_lines(spark, sf_dir):
    return _flags(spark, sf_dir)


_SUM = """sm AS (SELECT category, count(*) FILTER (filled) AS n, count(*) FILTER ("right") * 10000 // nullif(count(*) FILTER (filled), 0) AS accuracy,
  count(*) FILTER (cited) * 10000 // nullif(count(*) FILTER (filled), 0) AS citations,
  CAST(sum(CASE WHEN filled AND expected IS NOT NULL THEN abs(coalesce(allowed, 0) - expected) END) * 10000 // nullif(sum(CASE WHEN filled THEN expected END), 0) AS BIGINT) AS payout_error,
  count(*) FILTER (should_abstain AND did_abstain) * 10000 // nullif(count(*) FILTER (should_abstain), 0) AS recall,
  count(*) FILTER (should_abstain AND did_abstain) * 10000 // nullif(count(*) FILTER (did_abstain), 0) AS precision,
  count(*) FILTER (false_answer) AS false_answers, count(*) FILTER (dodge) AS dodges, count(*) FILTER (fabricated) AS fabricated FROM flags GROUP BY ROLLUP (category))"""


@register("score_summary", f"WITH {_KEY}, {_SUM} SELECT * FROM sm")
def score_summary(spark, sf_dir):
    return E.score_summary(_flags(spark, sf_dir))


@register("threshold_gate", f"""WITH {_KEY}, {_SUM}, ru AS (SELECT count(*) AS in_run, count(DISTINCT CASE WHEN qty = 50 THEN 'fallback' ELSE 'first' END) AS backends FROM lines WHERE cents > 200000)
  SELECT n, accuracy, accuracy >= 5200 AS passed, in_key, in_run, backends, CASE WHEN in_run < in_key THEN 'narrowed' ELSE 'whole' END AS scope, in_run = in_key AND backends = 1 AS may_record
  FROM sm, ru, (SELECT count(*) AS in_key FROM lb) WHERE category IS NULL""")
def threshold_gate(spark, sf_dir):
    runs = V.bill_lines(spark, sf_dir).where("cents > 200000").selectExpr("bill_id", "line_no", "CASE WHEN qty = 50 THEN 'fallback' ELSE 'first' END AS backend")
    return E.threshold_gate(E.score_summary(_flags(spark, sf_dir)), runs, _key(spark, sf_dir)[0], 5200)


@register("latency_summary", """WITH e AS (SELECT user_id AS job, CAST(round(value * 100) AS BIGINT) AS v FROM events), s AS (SELECT job, list_sort(list(v)) AS vs, count(*) AS n FROM e GROUP BY job),
  p AS (SELECT *, least(greatest((n * 95 + 95) // 100, 1), greatest(n - 1, 1)) AS lo FROM s)
  SELECT job, n, (SELECT CAST(sum(1 + event_id % 3) * 100 // count(*) AS BIGINT) FROM events WHERE user_id = p.job) AS mean_calls, CAST(CASE WHEN n = 1 THEN vs[1] * 100 ELSE vs[lo] * 100 + (vs[lo + 1] - vs[lo]) * (n * 95 + 95 - lo * 100) END AS BIGINT) AS p FROM p""")
def latency_summary(spark, sf_dir):
    spent = V.table(spark, sf_dir, "events").selectExpr("user_id AS job", "CAST(round(value * 100) AS BIGINT) AS v", "1 + event_id % 3 AS calls")
    return E.latency_summary(spent, "job", "v", "calls")


@register("retry_summary", f"""WITH {V.LINES} SELECT count(*) AS n, count(*) FILTER (qty % 5 = 0) AS fast, CAST(sum(1 + line_no % 3) AS BIGINT) AS attempts, count(*) FILTER (1 + line_no % 3 > 1) AS retried,
  count(*) FILTER (1 + line_no % 3 > 1 AND NOT bill_id % 6 = 0) AS answered_later FROM lines""")
def retry_summary(spark, sf_dir):
    return E.retry_summary(V.bill_lines(spark, sf_dir).selectExpr("1 + line_no % 3 AS attempts", "qty % 5 = 0 AS fast_path", "bill_id % 6 = 0 AS abstained"))


@register("key_fill_status", f"""WITH {_KEY} SELECT category, count(*) AS n, count(*) FILTER (filled) AS filled, count(*) FILTER (key_flag) AS flagged, CAST(sum(expected) AS BIGINT) AS total FROM fl GROUP BY category""")
def key_fill_status(spark, sf_dir):
    return E.key_fill_status(_key(spark, sf_dir)[0])


@register("key_diff", f"""WITH {V.LINES}, b AS (SELECT bill_id, line_no, CASE WHEN bill_id % 50 = 0 THEN cents + 1 ELSE cents END AS cents, CASE WHEN bill_id % 70 = 0 THEN NULL ELSE qty END AS qty FROM lines WHERE bill_id % 90 <> 1)
  SELECT bill_id, line_no, 'cents' AS field, l.cents::VARCHAR AS a, b.cents::VARCHAR AS b FROM lines l FULL JOIN b USING (bill_id, line_no) WHERE l.cents IS DISTINCT FROM b.cents
  UNION ALL SELECT bill_id, line_no, 'qty', l.qty::VARCHAR, b.qty::VARCHAR FROM lines l FULL JOIN b USING (bill_id, line_no) WHERE l.qty IS DISTINCT FROM b.qty""")
def key_diff(spark, sf_dir):
    lines = V.bill_lines(spark, sf_dir)
    other = lines.where("bill_id % 90 <> 1").selectExpr("bill_id", "line_no", "CASE WHEN bill_id % 50 = 0 THEN cents + 1 ELSE cents END AS cents", "CASE WHEN bill_id % 70 = 0 THEN NULL ELSE qty END AS qty")
    return E.key_diff(lines, other, ["cents", "qty"])


@register("version_compare", """WITH r AS (SELECT event_type AS metric, CAST(user_id % 12 AS BIGINT) AS version, count(*) AS value FROM events GROUP BY ALL)
  SELECT metric, version, value, value - lag(value) OVER (PARTITION BY metric ORDER BY version) AS delta FROM r""")
def version_compare(spark, sf_dir):
    rows = V.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric"), F.expr("user_id % 12 AS version")).agg(F.count(F.lit(1)).alias("value"))
    return E.version_compare(rows)


@register("normalise_quote", "SELECT doc_id, md5(regexp_replace(lower(trim(regexp_replace(translate(text, '‘’“”–—', '''''\"\"--'), '[ \\t\\n\\r]+', ' ', 'g'))), ' ?/ ?', '/', 'g')) AS text FROM documents")
def normalise_quote(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", F.md5(normalise(F.col("text"))).alias("text"))


@register("quoted_spans", """WITH q AS (SELECT doc_id, unnest(regexp_extract_all(replace(text, '. ', '"'), '"([^"]{12,})"', 1)) AS s FROM documents),
  c AS (SELECT doc_id, regexp_replace(regexp_replace(s, '(\\.\\.\\.|…).*$', ''), '[,;:]+$', '') AS s FROM q) SELECT doc_id, count(*) AS n, md5(string_agg(s, '|' ORDER BY s)) AS spans FROM c WHERE length(s) >= 12 GROUP BY doc_id""")
def quoted_spans(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit(". "), F.lit('"')))
    each = docs.select("doc_id", E.quoted_spans(F.col("text")).alias("spans")).where("size(spans) > 0")
    return each.select("doc_id", F.size("spans").cast("bigint").alias("n"), F.md5(F.array_join(F.array_sort("spans"), "|")).alias("spans"))


_HELD = "held AS (SELECT item_id AS quote_id, source AS policy, doc_id AS clause_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def _holders(spark, sf_dir):
    bench = V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("q"))
    return holding(V.clauses(spark, sf_dir), bench, "q").select("quote_id", "policy", "clause_id")


@register("quote_sources", f"""WITH {_HELD}, t AS (SELECT *, policy = 'src' || (quote_id % 20) AS own FROM held), a AS (SELECT quote_id, bool_or(own) AS any_own FROM t GROUP BY 1)
  SELECT quote_id, policy, clause_id, own FROM t JOIN a USING (quote_id) WHERE own OR NOT any_own""")
def quote_sources(spark, sf_dir):
    quotes = V.table(spark, sf_dir, "benchmark").selectExpr("item_id AS quote_id", "concat('src', item_id % 20) AS policy")
    return E.quote_sources(_holders(spark, sf_dir), quotes)


_NORM = r"""regexp_replace(lower(trim(regexp_replace(translate({t}, '‘’“”–—', '''''""--'), '[ \t\n\r]+', ' ', 'g'))), ' ?/ ?', '/', 'g')"""


@register("find_pages", rf"""WITH p AS (SELECT doc_id, 'book' || (doc_id // 25) AS policy, {_NORM.format(t="text")} AS t FROM documents),
  q AS (SELECT item_id AS quote_id, {_NORM.format(t="text")} AS q FROM benchmark
    UNION ALL SELECT -1 - a.doc_id, {_NORM.format(t="right(a.t, 30) || ' ' || left(b.t, 30)")} FROM p a JOIN p b ON b.doc_id = a.doc_id + 1),
  s AS (SELECT policy, string_agg(t, ' ' ORDER BY doc_id) AS s FROM p WHERE t <> '' GROUP BY policy),
  r AS (SELECT policy, doc_id AS page, sum(length(t) + 1) OVER (PARTITION BY policy ORDER BY doc_id) - length(t) - 1 AS a, length(t) AS n FROM p WHERE t <> ''),
  sp AS (SELECT policy, quote_id, q, string_split(s, q) AS parts FROM s JOIN q ON contains(s, q) AND length(q) >= 12),
  occ AS (SELECT policy, quote_id, length(q) AS n, list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * length(q) AS at FROM (SELECT *, unnest(range(1, len(parts))) AS k FROM sp))
  SELECT DISTINCT quote_id, policy, page FROM occ JOIN r USING (policy) WHERE r.a < occ.at + occ.n AND occ.at < r.a + r.n""")
def find_pages(spark, sf_dir):
    """Documents as pages of books of 25; asked are the benchmark's texts, and for each page its end with the start of the next one."""
    docs = V.table(spark, sf_dir, "documents").select("doc_id", F.expr("concat('book', doc_id DIV 25)").alias("policy"), "text")
    ends = docs.select("doc_id", normalise(F.col("text")).alias("t"))
    following = ends.select((F.col("doc_id") - 1).alias("doc_id"), F.expr("left(t, 30)").alias("head"))
    planted = ends.join(following.hint("merge"), "doc_id").select((-1 - F.col("doc_id")).alias("quote_id"), F.expr("concat(right(t, 30), ' ', head)").alias("quote"))
    quotes = V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote")).unionByName(planted)
    return L.find_pages(docs.withColumnRenamed("doc_id", "page"), quotes).select("quote_id", "policy", "page")


@register("repair_citation", f"""WITH {_HELD}, li AS (SELECT item_id // 2 AS line_id, min(item_id) AS lo FROM benchmark GROUP BY 1), nq AS (SELECT item_id // 2 AS line_id, count(*) AS n FROM benchmark GROUP BY 1),
  hc AS (SELECT quote_id // 2 AS line_id, clause_id, count(DISTINCT quote_id) AS k FROM held GROUP BY 1, 2), f AS (SELECT line_id, clause_id FROM hc JOIN nq USING (line_id) WHERE k = n),
  m AS (SELECT line_id, count(*) AS m, min(clause_id) AS one FROM f GROUP BY 1)
  SELECT line_id, CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.line_id = li.line_id AND f.clause_id = li.lo) THEN 'keep' WHEN m = 1 THEN 'move' ELSE 'human' END AS verdict,
    CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.line_id = li.line_id AND f.clause_id = li.lo) THEN li.lo WHEN m = 1 THEN one END AS target FROM li LEFT JOIN m USING (line_id)""")
def repair_citation(spark, sf_dir):
    quotes = V.table(spark, sf_dir, "benchmark").selectExpr("item_id DIV 2 AS line_id", "item_id AS quote_id")
    cited = quotes.groupBy("line_id").agg(F.min("quote_id").alias("clause_id"))
    return E.repair_citation(cited, quotes, _holders(spark, sf_dir))


@register("supported_prefix", r"""WITH q AS (SELECT item_id, regexp_replace(lower(trim(regexp_replace(translate(text, '‘’“”–—', '''''""--'), '[ \t\n\r]+', ' ', 'g'))), ' ?/ ?', '/', 'g') AS q FROM benchmark),
  d AS (SELECT doc_id, source, regexp_replace(lower(trim(regexp_replace(translate(text, '‘’“”–—', '''''""--'), '[ \t\n\r]+', ' ', 'g'))), ' ?/ ?', '/', 'g') AS t FROM documents)
  SELECT item_id, doc_id, CAST(coalesce(list_max(list_filter(range(1, len(string_split(q, ' ')) + 1), lambda n: contains(t, array_to_string(string_split(q, ' ')[1:n], ' ')))), 0) AS INTEGER) AS words FROM q JOIN d ON source = 'src' || (item_id % 20)""")
def supported_prefix(spark, sf_dir):
    # Each quote is held against the clauses of its policy.
    docs = V.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("policy"), normalise(F.col("text")).alias("t"))
    bench = V.table(spark, sf_dir, "benchmark").selectExpr("item_id", "concat('src', item_id % 20) AS policy", "text AS q")
    joined = docs.join(bench.hint("shuffle_hash"), "policy")
    return joined.select("item_id", "doc_id", E.supported_prefix(F.col("q"), F.col("t")).alias("words"))


@register("longest_support", rf"""WITH d AS (SELECT source AS policy, {_NORM.format(t="text")} AS t FROM documents),
  q AS (SELECT item_id AS quote_id, 'src' || (item_id % 20) AS policy, {_NORM.format(t="text")} AS q FROM benchmark
    UNION ALL SELECT -1 - doc_id, source, {_NORM.format(t="substr(text, 3, 90) || ' ' || item")} FROM documents JOIN (SELECT min(text) AS item FROM benchmark) ON true),
  w AS (SELECT *, string_split(q, ' ') AS ws FROM q)
  SELECT quote_id, w.policy, max(CAST(coalesce(list_max(list_filter(range(1, len(ws) + 1), lambda n: contains(t, array_to_string(ws[1:n], ' ')))), 0) AS INTEGER)) AS words, CAST(max(len(ws)) AS INTEGER) AS total
  FROM w JOIN d ON d.policy = w.policy GROUP BY quote_id, w.policy""")
def longest_support(spark, sf_dir):
    """Asked are the benchmark's texts, and of each document a part of its text with a foreign end."""
    docs = V.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("policy"), "text")
    bench = V.table(spark, sf_dir, "benchmark")
    foreign = bench.agg(F.min("text").alias("item"))
    planted = docs.crossJoin(F.broadcast(foreign)).select((-1 - F.col("doc_id")).alias("quote_id"), "policy", F.expr("concat(substring(text, 3, 90), ' ', item)").alias("quote"))
    quotes = bench.select(F.col("item_id").alias("quote_id"), F.expr("concat('src', item_id % 20)").alias("policy"), F.col("text").alias("quote")).unionByName(planted)
    return L.longest_support(docs.select("policy", "text"), quotes)


_REVIEW = """k AS (SELECT doc_id AS line_id, source AS policy, CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN doc_id + 1 ELSE doc_id END AS clause_id,
    CASE WHEN doc_id % 4 = 0 THEN 'no such words' WHEN doc_id % 4 = 1 THEN substr(text, 3, 12) END AS quote, doc_id % 5 AS expected, 3 AS charged FROM documents),
  j AS (SELECT k.*, d.text FROM k LEFT JOIN documents d ON d.source = k.policy AND d.doc_id = k.clause_id),
  pr AS (SELECT line_id, policy, 'unknown clause' AS reason FROM j WHERE clause_id IS NOT NULL AND text IS NULL UNION ALL SELECT line_id, policy, 'quote' FROM j WHERE quote IS NOT NULL AND NOT coalesce(contains(text, quote), false)
    UNION ALL SELECT line_id, policy, 'uncited deduction' FROM j WHERE expected < charged AND clause_id IS NULL)"""


def _problems(spark, sf_dir):
    key = V.table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS line_id", "source AS policy", "CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN doc_id + 1 ELSE doc_id END AS clause_id",
        "CASE WHEN doc_id % 4 = 0 THEN 'no such words' WHEN doc_id % 4 = 1 THEN substring(text, 3, 12) END AS quote", "doc_id % 5 AS expected", "3L AS charged",
    )
    return E.review_problems(key, V.clauses(spark, sf_dir))


@register("review_problems", f"WITH {_REVIEW} SELECT line_id, policy, reason FROM pr")
def review_problems(spark, sf_dir):
    return _problems(spark, sf_dir)


@register("triage", f"WITH {_REVIEW} SELECT CASE reason WHEN 'unknown clause' THEN 1 WHEN 'quote' THEN 2 ELSE 3 END AS tier, policy, reason, count(*) AS n FROM pr GROUP BY ALL")
def triage(spark, sf_dir):
    return E.triage(_problems(spark, sf_dir))


@register("match_printed_row", f"WITH {V.LINES} SELECT a.bill_id, a.line_no, min(b.line_no) AS row_no FROM lines a JOIN lines b ON a.bill_id = b.bill_id AND contains(lower(b.item), lower(substr(a.item, 1, 22))) GROUP BY ALL")
def match_printed_row(spark, sf_dir):
    lines = V.bill_lines(spark, sf_dir)
    rows = lines.selectExpr("bill_id", "line_no AS row_no", "concat(upper(item), '   ', qty) AS row")
    return E.match_printed_row(lines.select("bill_id", "line_no", "item"), rows)


@register("assumption_flags", f"""WITH {V.LINES} SELECT bill_id, line_no, 'colour' AS flag FROM lines WHERE regexp_matches(item, '^(red|blue|green)') UNION ALL SELECT bill_id, line_no, 'room' FROM lines WHERE item LIKE '% gear'""")
def assumption_flags(spark, sf_dir):
    return E.assumption_flags(V.bill_lines(spark, sf_dir), {"colour": "^(red|blue|green)", "room": " gear$"})


@register("operative_quote", r"""WITH d AS (SELECT doc_id AS clause_id, CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || '[table] Sum Insured 300000 - Limit ' || doc_id ELSE text END AS text FROM documents)
  SELECT clause_id, md5(CASE WHEN clause_id % 3 = 0 THEN '[table] Sum Insured 300000 - Limit ' || clause_id
    ELSE list_filter(string_split(regexp_replace(text, '([.!?])[ \n]+', '\1' || chr(1), 'g'), chr(1)), lambda s: length(s) >= 40)[1] END) AS quote FROM d""")
def operative_quote(spark, sf_dir):
    row = "concat(text, '\\n[table] Sum Insured 300000 - Limit ', clause_id)"
    clauses = V.clauses(spark, sf_dir).withColumn("text", F.expr(f"CASE WHEN clause_id % 3 = 0 THEN {row} ELSE text END"))
    return E.operative_quote(clauses, F.lit("300000")).withColumn("quote", F.md5("quote"))


@register("audit_profile", """WITH g AS (SELECT user_id AS job, epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_id) AS gap, event_type AS backend, event_id FROM events),
  c AS (SELECT job, string_agg(backend || '=' || n, ',' ORDER BY backend || '=' || n) AS backends FROM (SELECT job, backend, count(*) AS n FROM g GROUP BY ALL) GROUP BY job)
  SELECT job, count(*) AS n, CAST(max(gap) AS BIGINT) AS largest_gap, count(*) FILTER (gap = 0) AS together, count(*) FILTER (event_id % 4 = 0) AS retried, any_value(backends) AS backends FROM g JOIN c USING (job) GROUP BY job""")
def audit_profile(spark, sf_dir):
    return E.audit_profile(V.table(spark, sf_dir, "events").selectExpr("user_id AS job", "event_id", "unix_seconds(CAST(ts AS TIMESTAMP)) AS at", "event_type AS backend", "IF(event_id % 4 = 0, 2, 1) AS attempts"))


@register("time_shares", """WITH s AS (SELECT event_type AS kind, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1)
  SELECT kind, total, CAST(total * 10000 // (SELECT sum(total) FROM s) AS BIGINT) AS share FROM s""")
def time_shares(spark, sf_dir):
    return E.time_shares(V.table(spark, sf_dir, "events").selectExpr("event_type AS kind", "CAST(round(value * 100) AS BIGINT) AS spent"))


@register("example_report", "SELECT user_id % 10 AS run, event_type AS bill_id, max(epoch_us(ts) // 3600000000) AS recorded_at, arg_max(props, (epoch_us(ts) // 3600000000) * 100000000 + event_id) AS report FROM events GROUP BY ALL")
def example_report(spark, sf_dir):
    store = V.table(spark, sf_dir, "events").selectExpr("user_id % 10 AS run", "event_type AS bill_id", "unix_seconds(CAST(ts AS TIMESTAMP)) DIV 3600 AS recorded_at", "props AS report", "event_id AS seq")
    return E.example_report(store)
