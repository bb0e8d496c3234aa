"""Queries of sources, sinks, reuse and streams: files are written in the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.operators import memo as M
from ledgerlake.plans import views as V
from ledgerlake.plans.q_clauses import AUDIT, audited
from ledgerlake.plans.registry import register
from ledgerlake.plans.scratch import dropped, finished_shuffles_removed, folder, stored
from ledgerlake.sources import files as S
from ledgerlake.streaming import arrivals as R
from ledgerlake.streaming import streams as G


@register("read_bills", f"WITH {V.BOTH} SELECT bill_id::VARCHAR AS bill_id, line_no, item, cents, qty FROM lb")
def read_bills(spark, sf_dir):
    line = F.struct("line_no", F.struct("item", (F.col("cents") / 100).alias("amount"), "qty").alias("line"))
    nested = V.lines_of_bills(spark, sf_dir).groupBy(F.col("bill_id").cast("string").alias("bill_id"), "policy", "sum_insured").agg(
        F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]).alias("lines")
    )
    path = folder(spark, "bills")
    nested.write.json(path)
    return S.bill_lines(S.read_bills(spark, path, multi_line=False).where("_corrupt_record IS NULL"))


@register("read_clauses", "SELECT source AS policy, doc_id AS clause_id, md5(text) AS text FROM documents")
def read_clauses(spark, sf_dir):
    path, clauses = folder(spark, "clauses"), V.clauses(spark, sf_dir)
    S.write_clauses(clauses, path)
    return S.read_clauses(spark, path, clauses.schema).select("policy", "clause_id", F.md5("text").alias("text"))


@register("append_trace", "SELECT role AS node, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS size FROM conversations GROUP BY role")
def append_trace(spark, sf_dir):
    path = folder(spark, "trace")
    turns = V.table(spark, sf_dir, "conversations").selectExpr("conv_id AS run_id", "turn AS ts", "0L AS elapsed", "role AS node", "length(text) AS size", "turn % 2 AS side")
    for side in (0, 1):
        S.append_trace(turns.where(F.col("side") == side), path)
    read = spark.read.schema("run_id BIGINT, ts BIGINT, elapsed BIGINT, node STRING, fields MAP<STRING, STRING>").json(path)
    return read.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("fields")["size"].cast("bigint")).alias("size"))


@register("export_report_csv", f"""WITH {V.LINES} SELECT item, cents::VARCHAR AS charged, CASE WHEN qty % 4 = 0 THEN 'FLAGGED' ELSE cents::VARCHAR END AS allowed FROM lines
  UNION ALL SELECT 'Total charged', NULL, sum(cents)::VARCHAR FROM lines UNION ALL SELECT 'Total allowed', NULL, sum(CASE WHEN qty % 4 = 0 THEN 0 ELSE cents END)::VARCHAR FROM lines
  UNION ALL SELECT 'Flagged', NULL, count(*) FILTER (qty % 4 = 0)::VARCHAR FROM lines""")
def export_report_csv(spark, sf_dir):
    path = folder(spark, "report")
    S.export_report_csv(V.bill_lines(spark, sf_dir).withColumn("allowed", F.expr("CASE WHEN qty % 4 <> 0 THEN cents END")), path)
    return spark.read.schema("item STRING, charged STRING, allowed STRING").option("header", True).option("escape", '"').csv(path)


@register("memoise", f"WITH {V.LINES} SELECT bill_id, line_no, CAST(cents * 2 + qty AS BIGINT) AS result FROM lines")
def memoise(spark, sf_dir):
    lines = V.bill_lines(spark, sf_dir)
    columns = ["bill_id", "line_no", "cents", "qty"]
    compute = lambda df: df.select("key", "bill_id", "line_no", F.expr("cents * 2 + qty").alias("result"))
    _, fresh = M.memoise(lines.where("bill_id % 3 = 0"), None, columns, compute, F.lit(True))
    store = stored(fresh, folder(spark, "memo"))
    results, _ = M.memoise(lines, store, columns, compute, F.lit(True))
    return results.select("bill_id", "line_no", "result")


@register("memoise_in", f"""WITH {V.LINES}, r(run, factor, known) AS (VALUES ('third of a', 2, 0), ('all of b', 3, 0), ('all of a', 2, 1), ('all of a again', 2, 2))
  SELECT run, bill_id, line_no, CASE WHEN qty % 5 = 0 THEN NULL ELSE CAST(cents * factor + qty AS BIGINT) END AS result,
    qty % 5 <> 0 AND (known = 2 OR known = 1 AND bill_id % 3 = 0) AS replayed FROM lines CROSS JOIN r WHERE run <> 'third of a' OR bill_id % 3 = 0""")
def memoise_in(spark, sf_dir):
    """Runs of two settings share a store: a run replays its own setting's rows only, and rows that are not valid are computed again."""
    lines, path = stored(V.bill_lines(spark, sf_dir).drop("item"), folder(spark, "lines")), folder(spark, "store")

    def run(name, df, factor):
        compute = lambda d: d.select("key", F.expr(f"IF(qty % 5 = 0, NULL, cents * {factor} + qty) AS result"))
        got = M.memoise_in(df, path, {"factor": factor}, ["bill_id", "line_no", "cents", "qty"], compute, "result BIGINT", F.col("result").isNotNull(), name)
        return got.select(F.lit(name).alias("run"), "bill_id", "line_no", "result", "replayed")

    first = run("third of a", lines.where("bill_id % 3 = 0"), 2)
    return first.unionByName(run("all of b", lines, 3)).unionByName(run("all of a", lines, 2)).unionByName(run("all of a again", lines, 2))


@register("fingerprint", f"""WITH {V.BILLS}, f AS (SELECT *, sha256('{{"tuning": [' || grp % 3 || ', 2], "version": "a"}}') AS fingerprint FROM bills)
  SELECT policy, fingerprint, fingerprint = sha256('{{"tuning": [1, 2], "version": "a"}}') AS replayable, count(*) AS n FROM f GROUP BY ALL""")
def fingerprint(spark, sf_dir):
    """Stored results of three settings, of which one is the present one's: only its rows may be replayed."""
    config = lambda k: {"version": "a", "tuning": [k, 2]}
    path = folder(spark, "results")
    rows = stored(V.bills(spark, sf_dir).select("bill_id", "policy", "grp"), folder(spark, "bills"))
    for k in range(3):
        M.write_store(rows.where(F.col("grp") % 3 == k), path, M.identity(config(k)), "first")
    held = M.read_store(spark, path, "bill_id BIGINT, policy STRING, grp INT")
    told = held.withColumn("replayable", F.col("fingerprint") == M.fingerprint(config(1)))
    return told.groupBy("policy", "fingerprint", "replayable").agg(F.count(F.lit(1)).alias("n"))


@register("resume_scored", f"""WITH {V.BILLS} SELECT bill_id, bill_id % 3 = 0 AND bill_id % 5 <> 0 AS finished FROM bills""")
def resume_scored(spark, sf_dir):
    keys = ["CAST(bill_id AS STRING) AS bill_hash", "policy AS key_hash", "'f' AS fingerprint", "1 AS version", "'sql' AS backend"]
    bills = V.bills(spark, sf_dir).selectExpr("bill_id", *keys)
    store = bills.where("bill_id % 3 = 0").withColumn("key_hash", F.expr("CASE WHEN bill_id % 5 = 0 THEN 'old' ELSE key_hash END"))
    finished, open_ = M.resume_scored(bills, store)
    return finished.select("bill_id", F.lit(True).alias("finished")).unionByName(open_.select("bill_id", F.lit(False).alias("finished")))


@register("stream_audit", f"""WITH {AUDIT} SELECT bill_id, line_no, allowed, clause_id FROM fin WHERE cents > 0 AND bill_id % 13 <> 0""")
def stream_audit(spark, sf_dir):
    """Bills arrive whole, in files; each micro-batch goes through the whole audit, lines without an amount go aside."""
    path, target = folder(spark, "incoming"), folder(spark, "audited")
    cents = "CASE WHEN bill_id % 13 = 0 THEN -cents ELSE cents END AS cents"
    raw = V.lines_of_bills(spark, sf_dir).selectExpr("bill_id", "policy", "line_no", "item AS text", cents, "qty", "sum_insured", "started", "admitted")
    raw.repartition(max(4, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))), "bill_id").write.json(path, compression="gzip")
    schema = "bill_id BIGINT, policy STRING, line_no INT, text STRING, cents BIGINT, qty INT, sum_insured BIGINT, started DATE, admitted DATE"

    def audit(batch):
        lines = batch.withColumnRenamed("text", "item")
        return audited(lines, lines.select("bill_id", "policy", "started", "admitted").distinct()).select("bill_id", "line_no", "allowed", "clause_id")

    # Half of the files in each micro-batch, however many there are.
    files = -(-len(spark.read.schema(schema).json(path).inputFiles()) // 2)
    G.stream_audit(G.stream_intake(spark, path, schema, files=files), audit, target, folder(spark, "offsets")).awaitTermination()
    return spark.read.schema("bill_id BIGINT, line_no INT, allowed BIGINT, clause_id STRING").parquet(f"{target}/valid").select("bill_id", "line_no", "allowed", "clause_id")


@register("audit_arrivals", f"""WITH {AUDIT} SELECT bill_id, line_no, allowed, clause_id, bill_id % 11 <> 0 OR bill_id % 5 = 0 AS complete FROM fin WHERE cents > 0 AND bill_id % 13 <> 0""")
def audit_arrivals(spark, sf_dir):
    """Bills whose lines come in three parts, some of them twice, and a last part of whole bills ten days later; bills that miss a line close by timeout."""
    path, target = folder(spark, "parts"), folder(spark, "audited")
    cents = "CASE WHEN bill_id % 13 = 0 THEN -cents ELSE cents END AS cents"
    n = "CAST(count(*) OVER (PARTITION BY bill_id) AS INT) + IF(bill_id % 11 = 0 AND bill_id % 5 <> 0, 1, 0) AS n_lines"
    raw = V.lines_of_bills(spark, sf_dir).selectExpr("bill_id", "policy", "line_no", "item", cents, "qty", "sum_insured", "started", "admitted", n)
    part = F.expr("IF(bill_id % 5 = 0, 3, line_no % 3)")
    lines = folder(spark, "lines")
    parted = stored(raw.withColumn("part", part), lines)
    days = "timestamp'2024-01-01' + make_dt_interval(IF(part = 3, 10, 0), part)"
    for k in range(4):
        again = parted.where((F.col("part") == k - 1) & (F.col("line_no") % 4 == 0)) if 0 < k < 3 else parted.limit(0)
        sent = parted.where(F.col("part") == k).unionByName(again).withColumn("arrived", F.expr(days)).drop("part")
        with finished_shuffles_removed(spark):
            sent.repartition(2, "bill_id").write.mode("append").parquet(path)
    dropped(spark, lines)

    def audit(lines):
        bills = lines.select("bill_id", "policy", "started", "admitted").distinct()
        done = audited(lines.drop("complete"), bills).select("bill_id", "line_no", "allowed", "clause_id")
        return done.join(lines.select("bill_id", "line_no", "complete"), ["bill_id", "line_no"])

    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 2).parquet(path)
    R.audit_arrivals(stream, audit, target, folder(spark, "offsets")).awaitTermination()
    schema = "bill_id BIGINT, line_no INT, allowed BIGINT, clause_id STRING, complete BOOLEAN"
    return spark.read.schema(schema).parquet(f"{target}/valid").select("bill_id", "line_no", "allowed", "clause_id", "complete")


@register("stream_progress", """SELECT user_id AS job, count(*) FILTER (event_type = 'purchase') AS done, count(*) AS total, arg_max(event_type, CAST(epoch_us(ts) AS HUGEINT) * 10000000 + event_id) AS status FROM events GROUP BY user_id""")
def stream_progress(spark, sf_dir):
    """A running stream over files of events that arrive in any order; its last updates, day by day, add up to the progress of each job."""
    path, target = folder(spark, "events"), folder(spark, "progress")
    events = V.table(spark, sf_dir, "events").selectExpr("user_id AS job", "event_type AS status", "CAST(ts AS TIMESTAMP) AS ts", "event_id")
    events.repartition(4, "event_id").write.parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(path)
    # All files hold all days here, so none may count as finished before the last file.
    G.follow_progress(stream, target, folder(spark, "offsets"), late="36500 days").awaitTermination()
    return G.read_progress(spark.read.parquet(target))


@register("read_text_bills", "SELECT md5(text || chr(10)) AS text, CAST(NULL AS VARCHAR) AS refused, count(*) AS n FROM benchmark GROUP BY ALL")
def read_text_bills(spark, sf_dir):
    path = folder(spark, "printed")
    V.table(spark, sf_dir, "benchmark").select("text").write.option("maxRecordsPerFile", 1).text(path)  # a file for each text
    return S.read_text_bills(spark, path).groupBy(F.md5("text").alias("text"), "refused").agg(F.count(F.lit(1)).alias("n"))


@register("read_pages", """WITH p AS (SELECT unnest([text, 'item ' || item_id || chr(10)]) AS text, unnest([1, 2]) AS page FROM benchmark) SELECT page, md5(text) AS text, count(*) AS n FROM p GROUP BY ALL""")
def read_pages(spark, sf_dir):
    path = folder(spark, "documents")
    paged = V.table(spark, sf_dir, "benchmark").select(F.concat("text", F.lit("\f"), F.lit("item "), "item_id"))
    paged.write.option("maxRecordsPerFile", 1).text(path)
    return S.read_pages(spark, path).groupBy("page", F.md5("text").alias("text")).agg(F.count(F.lit(1)).alias("n"))


@register("read_exclusion_list", "SELECT CAST(n_nationkey + 1 AS INTEGER) AS no, n_name AS item, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def read_exclusion_list(spark, sf_dir):
    path = folder(spark, "list")
    entry = F.struct((F.col("n_nationkey") + 1).alias("no"), F.col("n_name").alias("item"))
    V.table(spark, sf_dir, "nation").agg(F.to_json(F.collect_list(entry)).alias("value")).write.text(path)  # a list of 25 names
    customers = V.table(spark, sf_dir, "customer").groupBy((F.col("c_nationkey") + 1).alias("no")).agg(F.count(F.lit(1)).alias("n"))
    return S.read_exclusion_list(spark, path).join(customers.hint("merge"), "no", "left").select("no", "item", F.coalesce("n", F.lit(0)).alias("n"))
