"""Queries of the intake operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.functions import text as T
from ledgerlake.operators import intake as I
from ledgerlake.plans import views as V
from ledgerlake.plans.registry import register
from ledgerlake.plans.scratch import folder


def _q(s: str) -> str:
    return s.replace("'", "''")


_MASKED = "text"
for _pattern, _to in T.MASKS:
    _MASKED = f"regexp_replace({_MASKED}, '{_q(_pattern)}', '{_q(_to.replace('$1', chr(92) + '1'))}', 'g')"
_HAS = " OR ".join(f"regexp_matches(text, '{_q(p)}')" for p, _ in T.MASKS[1:])


@register("mask_identifiers", f"SELECT doc_id, sha256({_MASKED}) AS masked FROM documents")
def mask_identifiers(spark, sf_dir):
    return I.mask_identifiers(V.table(spark, sf_dir, "documents")).select("doc_id", F.sha2("text", 256).alias("masked"))


@register("has_identifier", f"SELECT doc_id, {_HAS} AS hit FROM documents")
def has_identifier(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", T.has_identifier(F.col("text")).alias("hit"))


@register(
    "assert_no_identifiers",
    f"SELECT source, count(*) AS n, count(*) FILTER ({_HAS}) AS held_back FROM documents GROUP BY source",
)
def assert_no_identifiers(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select("source", "text")
    clean, held = I.quarantine(docs)
    checked = I.assert_no_identifiers(clean).select("source", F.lit(0).alias("h"), F.length("text").alias("n"))
    every = checked.unionByName(held.select("source", F.lit(1).alias("h"), F.length("text").alias("n")))
    return every.groupBy("source").agg(F.count("n").alias("n"), F.sum("h").alias("held_back"))


_CALLS = "SELECT doc_id, text || ' call 9' || lpad(CAST(doc_id % 1000 AS VARCHAR), 9, '0') || ' now' AS text FROM documents"


@register("write_masked", f"SELECT doc_id, sha256({_MASKED}) AS masked, (SELECT count(*) FROM documents) AS changed FROM ({_CALLS})")
def write_masked(spark, sf_dir):
    """Each document with a phone number; what was written, and how many rows the write counted as changed."""
    docs, path = V.table(spark, sf_dir, "documents"), folder(spark, "masked")
    called = docs.select("doc_id", F.expr("concat(text, ' call 9', lpad(doc_id % 1000, 9, '0'), ' now')").alias("text"))
    figures = I.write_masked(called, path)
    return spark.read.parquet(path).select("doc_id", F.sha2("text", 256).alias("masked"), F.lit(figures["changed"]).cast("bigint").alias("changed"))


@register("normalise_item", "SELECT doc_id, sha256(lower(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')))) AS item FROM documents")
def normalise_item(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalise_item(F.col("text")), 256).alias("item"))


@register("search_key", "SELECT doc_id, sha256(regexp_replace(lower(text), '[^a-z ]', ' ', 'g')) AS key FROM documents")
def search_key(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.search_key(F.col("text")), 256).alias("key"))


def _money(cents: str) -> str:
    return f"concat(CAST({cents} DIV 100 AS STRING), '.', lpad(CAST({cents} % 100 AS STRING), 2, '0'))"


def _printed_bills(spark, sf_dir, tampered: bool = False):
    """Bills printed as text from their lines; tampered: some amounts, quantities, names, rows and totals are wrong."""
    lines = V.bill_lines(spark, sf_dir)
    if tampered:
        lines = lines.selectExpr(
            "bill_id", "line_no",
            "CASE WHEN bill_id % 9 = 1 AND line_no = 1 THEN substring(item, 1, 4) WHEN bill_id % 9 = 2 AND line_no = 1 THEN concat('x', item) ELSE item END AS item",
            "CASE WHEN bill_id % 9 = 3 AND line_no = 2 THEN cents + 500 ELSE cents END AS cents",
            "CASE WHEN bill_id % 9 = 4 AND line_no = 2 THEN qty + 1 ELSE qty END AS qty",
        ).where("NOT (bill_id % 9 = 5 AND line_no = 1)")
    row = F.expr(f"struct(line_no, concat(item, '   ', qty, '   ', {_money('cents')}) AS row)")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["row"]), "\n")
    by_bill = lines.groupBy("bill_id").agg(text.alias("rows"), F.sum("cents").alias("sum"))
    total = f"CASE WHEN bill_id % 9 = 6 AND {str(tampered).lower()} THEN '' ELSE concat('GRAND TOTAL   ', {_money('sum')}) END"
    return by_bill.selectExpr("bill_id", f"concat('Bill No: ', bill_id, '\\n-----\\n', rows, '\\n-----\\n', {total}) AS text")


@register("read_printed_rows", f"WITH {V.LINES} SELECT bill_id, line_no, item, qty, cents FROM lines")
def read_printed_rows(spark, sf_dir):
    return I.read_printed_rows(_printed_bills(spark, sf_dir))


@register("read_charges_shy", f"WITH {V.LINES} SELECT bill_id, item, cents, count(*) AS n FROM lines GROUP BY ALL")
def read_charges_shy(spark, sf_dir):
    return I.read_charges_shy(_printed_bills(spark, sf_dir)).groupBy("bill_id", "item", "cents").agg(F.count(F.lit(1)).alias("n"))


@register("bill_stats", f"WITH {V.LINES} SELECT bill_id, count(*) AS n_items, CAST(sum(cents) AS BIGINT) AS total FROM lines GROUP BY bill_id")
def bill_stats(spark, sf_dir):
    return I.bill_stats(I.read_charges_shy(_printed_bills(spark, sf_dir)))


_TAMPERED = f"""{V.LINES}, tam AS (
  SELECT bill_id, line_no, CASE WHEN bill_id % 9 = 1 AND line_no = 1 THEN substr(item, 1, 4) WHEN bill_id % 9 = 2 AND line_no = 1 THEN 'x' || item ELSE item END AS item,
    CASE WHEN bill_id % 9 = 3 AND line_no = 2 THEN cents + 500 ELSE cents END AS cents, CASE WHEN bill_id % 9 = 4 AND line_no = 2 THEN qty + 1 ELSE qty END AS qty
  FROM lines), tam2 AS (SELECT * REPLACE (CAST(line_no - (bill_id % 9 = 5)::INTEGER AS INTEGER) AS line_no) FROM tam WHERE NOT (bill_id % 9 = 5 AND line_no = 1))"""


@register(
    "reconcile_text_vs_lines",
    f"""WITH {_TAMPERED}, c AS (SELECT bill_id, count(*) AS n, sum(cents) AS s FROM lines GROUP BY 1), m AS (SELECT bill_id, count(*) AS m, sum(cents) AS t FROM tam2 GROUP BY 1),
    pair AS (SELECT l.bill_id, l.line_no, l.item, l.cents, l.qty, t.item AS i2, t.cents AS c2, t.qty AS q2 FROM lines l JOIN tam2 t USING (bill_id, line_no) WHERE bill_id % 9 <> 5)
    SELECT bill_id, 0 AS line_no, 'count' AS problem FROM c WHERE bill_id % 9 = 5 AND EXISTS (SELECT 1 FROM m WHERE m.bill_id = c.bill_id)
    UNION ALL SELECT bill_id, line_no, CASE WHEN starts_with(item, i2) THEN 'prefix' ELSE 'item' END FROM pair WHERE item <> i2
    UNION ALL SELECT bill_id, line_no, 'amount' FROM pair WHERE abs(cents - c2) > 1
    UNION ALL SELECT bill_id, line_no, 'qty' FROM pair WHERE qty <> q2
    UNION ALL SELECT bill_id, 0, CASE WHEN bill_id % 9 = 6 THEN 'no total' ELSE 'total' END FROM c JOIN m USING (bill_id) WHERE bill_id % 9 <> 5 AND (bill_id % 9 = 6 OR s <> t)
    UNION ALL SELECT bill_id, 0, 'count' FROM c WHERE bill_id % 9 = 5 AND n = 1""",
)
def reconcile_text_vs_lines(spark, sf_dir):
    printed = _printed_bills(spark, sf_dir, tampered=True)
    lines = V.bill_lines(spark, sf_dir)
    return I.reconcile_text_vs_lines(I.read_printed_rows(printed), lines, I.printed_total(printed))


@register(
    "reconcile_parser",
    f"""WITH {_TAMPERED}, j AS (SELECT bill_id, line_no, l.item, l.cents, t.item AS i2, t.cents AS c2 FROM lines l FULL JOIN tam2 t USING (bill_id, line_no))
    SELECT bill_id, line_no, CASE WHEN item IS NULL THEN 'extra' WHEN i2 IS NULL THEN 'missing' WHEN item <> i2 THEN 'item' ELSE 'amount' END AS problem
    FROM j WHERE item IS NULL OR i2 IS NULL OR item <> i2 OR abs(cents - c2) > 1""",
)
def reconcile_parser(spark, sf_dir):
    return I.reconcile_parser(I.read_printed_rows(_printed_bills(spark, sf_dir, tampered=True)), V.bill_lines(spark, sf_dir))


@register(
    "reader_agreement",
    f"""WITH {_TAMPERED}, a AS (SELECT bill_id, count(*) AS n, sum(cents) AS t FROM lines GROUP BY 1), b AS (SELECT bill_id, count(*) AS n, sum(cents) AS t FROM tam2 GROUP BY 1)
    SELECT bill_id, a.n IS NOT DISTINCT FROM b.n AND a.t IS NOT DISTINCT FROM b.t AS agree FROM a FULL JOIN b USING (bill_id)""",
)
def reader_agreement(spark, sf_dir):
    return I.reader_agreement(V.bill_lines(spark, sf_dir), I.read_charges_shy(_printed_bills(spark, sf_dir, tampered=True)))


def _raw_lines(spark, sf_dir):
    return V.lines_of_bills(spark, sf_dir).selectExpr(
        "bill_id", "line_no", "CASE WHEN bill_id % 13 = 0 THEN -cents ELSE cents END AS cents",
        "CASE WHEN bill_id % 5 = 0 THEN NULL WHEN bill_id % 17 = 1 THEN 0 ELSE qty END AS qty", "CASE WHEN grp = 3 THEN 0 ELSE sum_insured END AS sum_insured",
    )


@register(
    "validate_lines",
    f"""WITH {V.BOTH} SELECT CASE WHEN bill_id % 13 = 0 OR (bill_id % 5 <> 0 AND bill_id % 17 = 1) OR grp = 3 THEN 'rejected' ELSE 'valid' END AS state,
      count(*) AS n, CAST(sum(CASE WHEN bill_id % 5 = 0 THEN 1 WHEN bill_id % 17 = 1 THEN 0 ELSE qty END) AS BIGINT) AS qty FROM lb GROUP BY 1""",
)
def validate_lines(spark, sf_dir):
    valid, rejected = I.validate_lines(_raw_lines(spark, sf_dir))
    every = valid.withColumn("state", F.lit("valid")).unionByName(rejected.withColumn("state", F.lit("rejected")))
    return every.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"))


@register("validate_policy", f"WITH {V.BILLS} SELECT policy, count(*) AS n, policy LIKE 'A%' AS known FROM bills GROUP BY policy")
def validate_policy(spark, sf_dir):
    some = V.table(spark, sf_dir, "region").where("r_name LIKE 'A%'").selectExpr("r_name AS policy")
    known, unknown = I.validate_policy(V.bills(spark, sf_dir), some)
    count = lambda df, flag: df.groupBy("policy").agg(F.count(F.lit(1)).alias("n")).withColumn("known", F.lit(flag))
    return count(known, True).unionByName(count(unknown, False))


def _scheduled(spark, sf_dir):
    return V.bills(spark, sf_dir).drop("category").selectExpr(
        "*", "CAST(CASE WHEN bill_id % 3 = 0 THEN 1234500 END AS BIGINT) AS per_day", "CASE bill_id % 4 WHEN 0 THEN 'single' WHEN 1 THEN '' END AS category"
    )


@register(
    "schedule_or_null",
    f"""WITH {V.BILLS} SELECT bill_id, CASE WHEN bill_id % 4 = 0 THEN 'single' WHEN bill_id % 4 = 1 AND bill_id % 3 = 0 THEN '' END AS category,
      CAST(CASE WHEN bill_id % 3 = 0 THEN 1234500 END AS BIGINT) AS per_day FROM bills""",
)
def schedule_or_null(spark, sf_dir):
    return I.schedule_or_null(_scheduled(spark, sf_dir)).select("bill_id", "category", "per_day")


@register(
    "bill_index",
    f"""WITH {V.BILLS} SELECT bill_id, policy, sum_insured, CAST(admitted AS VARCHAR) AS admitted, CAST(started AS VARCHAR) AS started,
      CASE WHEN bill_id % 3 = 0 THEN '12,345/day' WHEN bill_id % 4 = 0 THEN 'single' ELSE '-' END AS room FROM bills""",
)
def bill_index(spark, sf_dir):
    index = I.bill_index(_scheduled(spark, sf_dir))
    return index.withColumns({c: F.col(c).cast("string") for c in ("admitted", "started")})
