"""Queries of batch retrieval: benchmark passages are the queries, documents the clauses of their sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.operators import retrieval as R
from ledgerlake.plans import views as V
from ledgerlake.plans.registry import register
from ledgerlake.plans.scratch import folder, stored
from ledgerlake.operators.adjudicate import route_item


def _queries(spark, sf_dir):
    return V.table(spark, sf_dir, "benchmark").selectExpr("item_id AS query_id", "concat('src', item_id % 20) AS policy", "text")


_TOK = "list_filter(string_split(regexp_replace(lower({t}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
_SENT = "list_filter(string_split(regexp_replace({t}, '([.;:])[ \\t\\n\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"
_WIN = f"""RECURSIVE s AS (SELECT doc_id, text, {_SENT.format(t="text")} AS ss FROM documents),
  walk AS (SELECT doc_id, ss, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS a, CAST(length(ss[1]) AS BIGINT) AS size, CAST(NULL AS BIGINT) AS ea, CAST(NULL AS BIGINT) AS eb FROM s WHERE len(ss) > 0
    UNION ALL SELECT doc_id, ss, i + 1, CASE WHEN size + length(ss[i + 1]) > 600 THEN i ELSE a END, CASE WHEN size + length(ss[i + 1]) > 600 THEN length(ss[i]) ELSE size END + length(ss[i + 1]),
      CASE WHEN size + length(ss[i + 1]) > 600 THEN a END, CASE WHEN size + length(ss[i + 1]) > 600 THEN i END FROM walk WHERE i < len(ss)),
  win AS (SELECT doc_id, ss, ea, eb FROM walk WHERE ea IS NOT NULL UNION ALL SELECT doc_id, ss, a, i FROM walk WHERE i = len(ss)),
  windows AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY eb, ea) - 1 AS INTEGER) AS w, array_to_string(ss[ea:eb], ' ') AS text FROM win)"""


@register("sentence_windows", f"WITH {_WIN} SELECT doc_id AS clause_id, w AS window, md5(text) AS text FROM windows")
def sentence_windows(spark, sf_dir):
    docs = V.clauses(spark, sf_dir)
    return docs.select("clause_id", F.posexplode(R.sentence_windows(F.col("text"))).alias("window", "text")).withColumn("text", F.md5("text"))


_CHUNKS = f"""{_WIN}, chunks AS (SELECT d.source AS policy, d.doc_id AS clause_id, 0 AS w, d.text FROM documents d WHERE length(d.text) <= 1500
  UNION ALL SELECT d.source, d.doc_id, w.w, w.text FROM windows w JOIN documents d USING (doc_id) WHERE length(d.text) > 1500)"""


@register("sub_chunk", f"""WITH {_CHUNKS} SELECT policy, clause_id, w AS window, md5(CASE WHEN length(d.text) > 1500 THEN trim(lang || chr(10) || chunks.text, ' ') ELSE chunks.text END) AS text
  FROM chunks JOIN documents d ON doc_id = clause_id""")
def sub_chunk(spark, sf_dir):
    clauses = V.table(spark, sf_dir, "documents").selectExpr("source AS policy", "doc_id AS clause_id", "text", "lang AS title")
    return R.sub_chunk(clauses).withColumn("text", F.md5("text"))


_BM25 = f"""t AS (SELECT source AS policy, doc_id, unnest({_TOK.format(t="text")}) AS term FROM documents), tf AS (SELECT policy, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
  dl AS (SELECT source AS policy, doc_id, len({_TOK.format(t="text")}) AS dl FROM documents), st AS (SELECT policy, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY policy),
  dfs AS (SELECT policy, term, count(*) AS df FROM tf GROUP BY ALL), q AS (SELECT DISTINCT item_id AS query_id, 'src' || (item_id % 20) AS policy, unnest({_TOK.format(t="text")}) AS term FROM benchmark),
  bm AS (SELECT query_id, policy, doc_id AS clause_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS s
    FROM q JOIN dfs USING (policy, term) JOIN st USING (policy) JOIN tf USING (policy, term) JOIN dl USING (policy, doc_id) GROUP BY ALL),
  lex AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, clause_id) AS INTEGER) AS rank FROM bm) WHERE rank <= 20)"""


def _lexical(spark, sf_dir):
    return R.bm25_topk(_queries(spark, sf_dir), V.clauses(spark, sf_dir))


@register("bm25_topk", f"WITH {_BM25} SELECT query_id, clause_id, rank, CAST(round(s * 10000) AS BIGINT) AS score FROM lex")
def bm25_topk(spark, sf_dir):
    return _lexical(spark, sf_dir).select("query_id", "clause_id", "rank", F.round(F.col("score") * 10000).cast("bigint").alias("score"))


def _vectors(spark, sf_dir):
    return V.table(spark, sf_dir, "embeddings").selectExpr("vec_id AS clause_id", "label AS policy", "CAST(embedding AS ARRAY<DOUBLE>) AS vec")


_DENSE = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), dn AS (
  SELECT q.vec_id AS query_id, c.vec_id AS clause_id, list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), lambda a, b: a + b) AS s
  FROM v q JOIN v c ON q.label = c.label AND q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
  dense AS (SELECT * FROM (SELECT query_id, clause_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, clause_id) AS INTEGER) AS rank FROM dn) WHERE rank <= 20)"""


def _asked(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return rows.where("clause_id % 20 = 0").withColumnRenamed("clause_id", "query_id"), rows


@register("dense_topk", f"WITH {_DENSE} SELECT query_id, clause_id, rank FROM dense")
def dense_topk(spark, sf_dir):
    return R.dense_topk(*_asked(spark, sf_dir), itself=False).select("query_id", "clause_id", "rank")


@register("dense_recall", f"WITH {_DENSE} SELECT label AS policy, count(*) AS n, true AS enough FROM dense JOIN v ON vec_id = query_id GROUP BY label")
def dense_recall(spark, sf_dir):
    """Whether locality-sensitive hashing finds nine tenths of the exact neighbours of each policy."""
    exact = R.dense_topk(*_asked(spark, sf_dir), itself=False)
    told = R.recall_of(R.lsh_topk(*_asked(spark, sf_dir), itself=False), exact)
    return told.select("policy", "n", (F.col("hit") >= 0.9 * F.col("n")).alias("enough"))


#: Vectors by hashed words with fitted weights: of clauses (ve) and of queries (qv), and the 20 nearest clauses of each query (dense).
_EMB = f"""tk AS (SELECT source AS policy, doc_id, unnest({_TOK.format(t="text")}) AS w FROM documents),
  bc AS (SELECT policy, doc_id, CAST('0x' || substr(md5(w), 1, 6) AS BIGINT) % 256 AS b, count(*) AS tf FROM tk GROUP BY ALL),
  idf AS (SELECT b, ln((n + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE)) AS idf FROM bc, (SELECT count(*) AS n FROM documents) GROUP BY b, n),
  wt AS (SELECT policy, doc_id, b, tf * idf AS w FROM bc JOIN idf USING (b)), nm AS (SELECT policy, doc_id, sqrt(sum(w * w)) AS norm FROM wt GROUP BY ALL),
  ve AS (SELECT policy, doc_id, b, w / norm AS w FROM wt JOIN nm USING (policy, doc_id) WHERE norm > 0)"""
_QV = f"""{_EMB}, qk AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS policy, unnest({_TOK.format(t="'find: ' || text")}) AS w FROM benchmark),
  qb AS (SELECT query_id, policy, CAST('0x' || substr(md5(w), 1, 6) AS BIGINT) % 256 AS b, count(*) AS tf FROM qk GROUP BY ALL), qw_ AS (SELECT query_id, policy, b, tf * idf AS w FROM qb JOIN idf USING (b)),
  qv AS (SELECT query_id, policy, b, w / norm AS w FROM qw_ JOIN (SELECT query_id, sqrt(sum(w * w)) AS norm FROM qw_ GROUP BY query_id) USING (query_id) WHERE norm > 0),
  dq AS (SELECT item_id AS query_id, source AS policy, doc_id AS clause_id FROM benchmark JOIN documents ON source = 'src' || (item_id % 20)),
  dots AS (SELECT query_id, policy, clause_id, round(coalesce(s, 0), 9) AS s FROM dq LEFT JOIN (SELECT query_id, policy, doc_id AS clause_id, sum(qv.w * ve.w) AS s FROM qv JOIN ve USING (policy, b) GROUP BY ALL) USING (query_id, policy, clause_id)),
  dense AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, clause_id) AS INTEGER) AS rank FROM dots) WHERE rank <= 20),
  fused AS (SELECT query_id, policy, clause_id, sum(part) AS part FROM (SELECT query_id, policy, clause_id, 0.6::DOUBLE / (60 + rank) AS part FROM dense UNION ALL SELECT query_id, policy, clause_id, 0.4::DOUBLE / (60 + rank) FROM lex) GROUP BY ALL)"""


@register("embed", f"WITH {_EMB} SELECT doc_id, CAST(b AS INTEGER) AS place, CAST(round(w * 1000000) AS BIGINT) AS weight FROM ve WHERE abs(w) > 1e-9")
def embed(spark, sf_dir):
    """Vectors of all documents, number by number where they are not zero."""
    docs = V.clauses(spark, sf_dir)
    idf = stored(R.fit_idf(docs, ["policy", "clause_id"]), folder(spark, "idf"))
    told = R.embed(docs, ["policy", "clause_id"], idf).select("clause_id", F.posexplode("vec").alias("place", "w")).where("abs(w) > 1e-9")
    return told.select(F.col("clause_id").alias("doc_id"), "place", F.round(F.col("w") * 1_000_000).cast("bigint").alias("weight"))


def letter_model():
    """A small model for the hook: shares of the letters a to h and the length in words, as a matrix."""
    import numpy as np

    return lambda texts: np.array([[t.count(c) for c in "abcdefgh"] + [len(t.split(" "))] for t in texts], dtype=float).reshape(len(texts), 9)


_LETTERS = ", ".join(f"length(text) - length(replace(text, '{c}', ''))" for c in "abcdefgh")


@register("embed_with", f"SELECT doc_id, CAST(unnest(range(9)) AS INTEGER) AS place, CAST(unnest([{_LETTERS}, len(string_split(text, ' '))]) AS DOUBLE) AS value FROM documents")
def embed_with(spark, sf_dir):
    """Vectors by a model that is loaded once in each task."""
    return R.embed_with(V.table(spark, sf_dir, "documents").select("doc_id", "text"), letter_model).select("doc_id", F.posexplode("vec").alias("place", "value"))


_OVER = f"""qw AS (SELECT item_id AS query_id, list_distinct({_TOK.format(t="text")}) AS a FROM benchmark),
  cw AS (SELECT policy, clause_id, w, list_distinct({_TOK.format(t="text")}) AS b FROM chunks),
  sc AS (SELECT query_id, clause_id, max(CAST(len(list_intersect(a, b)) AS BIGINT) * len(list_intersect(a, b)) * 1000000 // greatest(len(a) * len(b), 1)) AS score
    FROM lex JOIN qw USING (query_id) JOIN cw USING (clause_id) GROUP BY ALL),
  rr AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, clause_id) AS INTEGER) AS rank FROM sc) WHERE rank <= 3)"""


def _candidates(spark, sf_dir):
    asked = _queries(spark, sf_dir).select("query_id", F.array_distinct(R.tokens(F.col("text"))).alias("q_words"))
    found = stored(_lexical(spark, sf_dir).select("query_id", "policy", "clause_id"), folder(spark, "found"))
    # Windows are cut of the candidates' texts only.
    ids = stored(found.select("policy", "clause_id").distinct(), folder(spark, "ids"))
    texts = V.clauses(spark, sf_dir).join(R.near(ids), ["policy", "clause_id"], "left_semi")
    windows = R.sub_chunk(texts).select("policy", "clause_id", "window", F.array_distinct(R.tokens(F.col("text"))).alias("words"))
    return found.join(asked.hint("merge"), "query_id").hint("merge").join(windows, ["policy", "clause_id"])


def _reranked(spark, sf_dir):
    """Read more than once by most queries, so it is written."""
    return stored(R.rerank(_candidates(spark, sf_dir)), folder(spark, "reranked"))


@register("rerank", f"WITH {_CHUNKS}, {_BM25}, {_OVER} SELECT query_id, clause_id, rank, CAST(score AS BIGINT) AS score FROM rr")
def rerank(spark, sf_dir):
    return _reranked(spark, sf_dir).drop("policy")


def _fused(spark, sf_dir):
    queries, clauses = _queries(spark, sf_dir), V.clauses(spark, sf_dir)
    keys = ["policy", "clause_id"]
    idf = stored(R.fit_idf(clauses, keys), folder(spark, "idf"))
    dense = R.dense_topk(R.embed(queries, ["query_id", "policy"], idf, prefix="find: "), R.embed(clauses, keys, idf))
    return R.fuse_rrf([(dense, 0.6), (_lexical(spark, sf_dir), 0.4)])


@register("fuse_rrf", f"WITH {_BM25}, {_QV} SELECT query_id, clause_id, CAST(round(part * 1000000) AS BIGINT) AS score FROM fused")
def fuse_rrf(spark, sf_dir):
    return _fused(spark, sf_dir).select("query_id", "clause_id", F.round(F.col("score") * 1_000_000).cast("bigint").alias("score"))


_REFS = "refs AS (SELECT doc_id AS clause_id, [doc_id + 20, (doc_id * 3) % 1000, doc_id + 40] AS r FROM documents)"
_FOLLOW = f"""{_CHUNKS}, {_BM25}, {_OVER}, {_REFS}, nm AS (SELECT query_id, rank, clause_id AS via, unnest(r) AS ref, unnest([0, 1, 2]) AS pos FROM rr JOIN refs USING (clause_id)),
  fr AS (SELECT query_id, ref, min(rank * 10 + pos) AS k, arg_min(via, rank * 10 + pos) AS via FROM nm n WHERE NOT EXISTS (SELECT 1 FROM rr WHERE rr.query_id = n.query_id AND rr.clause_id = n.ref) GROUP BY query_id, ref),
  ad AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k) AS n FROM fr),
  followed AS (SELECT query_id, clause_id, CAST(score AS BIGINT) AS score, CAST(NULL AS BIGINT) AS via_ref_of FROM rr UNION ALL SELECT query_id, ref, 0, via FROM ad WHERE n <= 4)"""


def _followed(spark, sf_dir):
    refs = V.clauses(spark, sf_dir).selectExpr("policy", "clause_id", "array(clause_id + 20, (clause_id * 3) % 1000, clause_id + 40) AS refs")
    return R.follow_refs(_reranked(spark, sf_dir), refs)


@register("follow_refs", f"WITH {_FOLLOW} SELECT * FROM followed")
def follow_refs(spark, sf_dir):
    return _followed(spark, sf_dir).drop("policy")


@register("drop_unknown", f"WITH {_FOLLOW} SELECT query_id, clause_id FROM followed JOIN documents ON doc_id = clause_id AND source = concat('src', query_id % 20)")
def drop_unknown(spark, sf_dir):
    return R.drop_unknown(_followed(spark, sf_dir), V.clauses(spark, sf_dir)).select("query_id", "clause_id")


@register("below_threshold", f"WITH {_CHUNKS}, {_BM25}, {_OVER} SELECT query_id, CAST(max(score) AS BIGINT) AS best FROM rr GROUP BY query_id HAVING max(score) < 300000")
def below_threshold(spark, sf_dir):
    return R.below_threshold(_reranked(spark, sf_dir), 300_000)


_TEMPLATES = [(r, a, f"{{item}} {r} {w}") for r in ("room_rent", "copay", "waiting_period", "sub_limit", "other") for a, w in enumerate(("limit", "cap", "clause"))]


@register("build_queries", f"""WITH {V.LINES} SELECT bill_id, line_no, item || ' ' || CASE split_part(item, ' ', 2) WHEN 'gear' THEN 'room_rent' WHEN 'bolt' THEN 'copay' WHEN 'rod' THEN 'waiting_period'
  WHEN 'plate' THEN 'sub_limit' ELSE 'other' END || ' cap' AS query FROM lines""")
def build_queries(spark, sf_dir):
    lines = V.bill_lines(spark, sf_dir).withColumn("route", route_item(F.col("item")))
    told = lines.withColumn("item", F.expr("concat(item, ' (', qty, ' days) @ 12,5 ', 10000 + qty)"))
    return R.build_queries(told, spark.createDataFrame(_TEMPLATES, "route string, attempt int, template string"), 1).select("bill_id", "line_no", "query")


@register("naive_query", f"WITH {V.LINES} SELECT bill_id, line_no, item || ' limit coverage' AS query FROM lines")
def naive_query(spark, sf_dir):
    return R.naive_query(V.bill_lines(spark, sf_dir)).select("bill_id", "line_no", "query")


_HOLDS = "SELECT item_id AS query_id, source AS policy, doc_id AS clause_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)"


@register("recall_at_k", f"""WITH {_BM25.replace("q AS (SELECT DISTINCT item_id AS query_id, 'src' || (item_id % 20) AS policy,", f"kk AS ({_HOLDS}), q AS (SELECT DISTINCT item_id AS query_id, kk.policy,").replace("FROM benchmark),", "FROM benchmark JOIN kk ON kk.query_id = item_id),")},
  l2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, clause_id) AS k FROM bm), f AS (SELECT kk.*, k FROM kk LEFT JOIN l2 USING (query_id, clause_id))
  SELECT policy, count(*) AS n, count(*) FILTER (k <= 3) AS hit3, count(*) FILTER (k <= 20) AS hit20 FROM f GROUP BY ROLLUP (policy)""")
def recall_at_k(spark, sf_dir):
    bench = V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    clauses = V.clauses(spark, sf_dir)
    key = holding(clauses, bench, "q").select("query_id", "policy", "clause_id")
    asked = bench.join(key.select("query_id", "policy").distinct(), "query_id").withColumnRenamed("q", "text")
    return R.recall_at_k(R.bm25_topk(asked, clauses), key)


#: Quotes and candidates up to which they are broadcast, after they were counted.
FEW = 100_000


def holding(texts, quotes, quote: str):
    """Rows of texts joined with the quotes that they contain.

    Runs of three words of the texts meet the second run of each quote (its first word
    may be cut off within a text); only ids and hashes take part in that, and of the
    texts those with a hit are looked at again. Quotes under five words have no such
    run: there are few of them, and each text is searched for them where it lies.
    """
    words = lambda c: F.split(F.regexp_replace(c, r"[ \n]+", " "), " ")
    runs = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    rest = [c for c in quotes.columns if c != quote]
    asked = quotes.withColumn("__w", words(F.col(quote)))
    long = asked.where(F.size("__w") >= 5).withColumn("__k", F.xxhash64(*[F.get("__w", F.lit(i)) for i in (1, 2, 3)])).drop("__w")
    short = asked.where(F.size("__w") < 5).drop("__w")
    few = quotes.count() <= FEW
    small = lambda df: F.broadcast(df) if few else df.hint("merge")
    own = texts.withColumn("__w", words(F.col("text"))).where(F.size("__w") >= 3)
    own = own.select("policy", "clause_id", F.explode(F.array_distinct(runs(F.col("__w")))).alias("__k"))
    hits = own.join(small(long.select("__k", *rest)), "__k").select("policy", "clause_id", *rest).distinct()
    hits = stored(hits, folder(texts.sparkSession, "holding"))
    near = F.broadcast(hits) if hits.count() <= FEW else hits.hint("merge")
    told = texts.join(near, ["policy", "clause_id"]).join(small(long.drop("__k")), rest).where(F.contains(F.col("text"), F.col(quote)))
    if not short.limit(1).count():
        return told
    inside = texts.join(F.broadcast(short) if few else short, F.contains(F.col("text"), F.col(quote)))
    return told.unionByName(inside.select(told.columns))


@register("topic_clauses", f"""WITH {V.LINES}, tp(pattern, priority, ids) AS (VALUES ('gear', 1, [1, 2, 999999999]), ('small', 2, [2, 3]), ('rod', 3, [7])),
  e AS (SELECT bill_id, line_no, unnest(ids) AS clause_id, priority * 10 + unnest(range(len(ids))) AS k FROM lines JOIN tp ON contains(item, pattern)),
  f AS (SELECT bill_id, line_no, clause_id, min(k) AS k FROM e WHERE clause_id IN (SELECT doc_id FROM documents) GROUP BY ALL)
  SELECT bill_id, line_no, CAST(clause_id AS BIGINT) AS clause_id, CAST(row_number() OVER (PARTITION BY bill_id, line_no ORDER BY k) AS INTEGER) AS place FROM f""")
def topic_clauses(spark, sf_dir):
    topics = spark.createDataFrame([("gear", 1, [1, 2, 999999999]), ("small", 2, [2, 3]), ("rod", 3, [7])], "pattern string, priority int, ids array<long>")
    return R.topic_clauses(V.bill_lines(spark, sf_dir), topics, V.clauses(spark, sf_dir))


_REGION = "CASE doc_id % 3 WHEN 0 THEN 'AFRICA' WHEN 1 THEN 'ASIA' ELSE 'EUROPE' END"


@register("topics_of_policy", f"""WITH {V.BOTH}, tp(policy, pattern, priority, ids) AS (VALUES ('AFRICA', 'gear', 1, [1, 3, 6]), ('ASIA', 'gear', 1, [3, 4, 1]), ('ASIA', 'small', 2, [7, 4]), ('EUROPE', 'rod', 3, [7])),
  e AS (SELECT bill_id, line_no, lb.policy, unnest(ids) AS clause_id, priority * 10 + unnest(range(len(ids))) AS k FROM lb JOIN tp ON contains(item, pattern) AND tp.policy = lb.policy),
  f AS (SELECT bill_id, line_no, clause_id, min(k) AS k FROM e WHERE (policy, clause_id) IN (SELECT ({_REGION}, doc_id) FROM documents) GROUP BY ALL)
  SELECT bill_id, line_no, CAST(clause_id AS BIGINT) AS clause_id, CAST(row_number() OVER (PARTITION BY bill_id, line_no ORDER BY k) AS INTEGER) AS place FROM f""")
def topics_of_policy(spark, sf_dir):
    """Topics of three policies, of which some name clauses that only another policy has."""
    rows = [("AFRICA", "gear", 1, [1, 3, 6]), ("ASIA", "gear", 1, [3, 4, 1]), ("ASIA", "small", 2, [7, 4]), ("EUROPE", "rod", 3, [7])]
    topics = spark.createDataFrame(rows, "policy string, pattern string, priority int, ids array<long>")
    clauses = V.table(spark, sf_dir, "documents").selectExpr(f"{_REGION} AS policy", "doc_id AS clause_id")
    return R.topic_clauses(V.lines_of_bills(spark, sf_dir), topics, clauses)


@register("browse_clauses", "SELECT source AS policy, doc_id AS clause_id, md5(substr(text, 1, 420)) AS preview FROM documents WHERE regexp_matches(text, '(?i)licen[sc]e')")
def browse_clauses(spark, sf_dir):
    return R.browse_clauses(V.clauses(spark, sf_dir), "(?i)licen[sc]e").withColumn("preview", F.md5("preview"))


_SEARCH = f"""{_CHUNKS}, {_BM25}, {_QV}, qw AS (SELECT item_id AS query_id, list_distinct({_TOK.format(t="text")}) AS a FROM benchmark),
  cw AS (SELECT policy, clause_id, w, text, list_distinct({_TOK.format(t="text")}) AS b FROM chunks),
  sw AS (SELECT query_id, policy, clause_id, w, cw.text, CAST(len(list_intersect(a, b)) AS BIGINT) * len(list_intersect(a, b)) * 1000000 // greatest(len(a) * len(b), 1) AS score FROM fused JOIN qw USING (query_id) JOIN cw USING (policy, clause_id)),
  sb AS (SELECT DISTINCT ON (query_id, clause_id) * FROM sw ORDER BY query_id, clause_id, score DESC, w),
  rr AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, clause_id) AS INTEGER) AS rank FROM sb) WHERE rank <= 3), {_REFS},
  nm2 AS (SELECT query_id, policy, rank, clause_id AS via, unnest(r) AS ref, unnest([0, 1, 2]) AS pos FROM rr JOIN refs USING (clause_id)),
  fr AS (SELECT query_id, policy, ref, min(rank * 10 + pos) AS k, arg_min(via, rank * 10 + pos) AS via FROM nm2 n WHERE NOT EXISTS (SELECT 1 FROM rr WHERE rr.query_id = n.query_id AND rr.clause_id = n.ref) GROUP BY ALL),
  ad AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k) AS n FROM fr)"""


@register("search", f"""WITH {_SEARCH} SELECT query_id, clause_id, CAST(score AS BIGINT) AS score, CAST(NULL AS BIGINT) AS via_ref_of, md5(text) AS matched FROM rr
  UNION ALL SELECT query_id, ref, 0, via, md5(substr(text, 1, 900)) FROM ad JOIN documents ON doc_id = ref AND source = policy WHERE n <= 4""")
def search(spark, sf_dir):
    """Benchmark items against the clauses of their policies: vectors and words fused, windows reranked, references added."""
    clauses = V.clauses(spark, sf_dir)
    refs = clauses.selectExpr("policy", "clause_id", "array(clause_id + 20, (clause_id * 3) % 1000, clause_id + 40) AS refs")
    told = R.search(_queries(spark, sf_dir), clauses, refs, lambda df, name: stored(df, folder(spark, name)), prefix="find: ")
    return told.select("query_id", "clause_id", "score", "via_ref_of", F.md5("matched").alias("matched"))
