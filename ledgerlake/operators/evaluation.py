"""Scoring against a key, and the audit of the key itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.text import normalise_quote


def score_lines(verdicts: DataFrame, key: DataFrame, known: DataFrame) -> DataFrame:
    """Flags of each line (bill_id, line_no): key (policy, expected, key_clause, key_flag) against (allowed, clause).

    Right: within one rupee, or both leave the line open. Lines that the key has not
    filled (no amount and no flag) are marked unfilled and count for nothing else. A
    citation is fabricated where the policy has no such clause (known: policy, clause).
    """
    there = known.select("policy", "clause").distinct().withColumn("there", F.lit(True))
    both = key.join(verdicts, ["bill_id", "line_no"]).join(there, ["policy", "clause"], "left")
    filled = F.col("expected").isNotNull() | F.coalesce("key_flag", F.lit(False))
    should, did = F.col("expected").isNull(), F.col("allowed").isNull()
    right = F.when(should, did).otherwise(F.coalesce(F.abs(F.col("allowed") - F.col("expected")) <= 100, F.lit(False)))
    return both.select(
        "bill_id", "line_no", "category", "expected", "allowed",
        filled.alias("filled"), (filled & right).alias("right"),
        (filled & F.coalesce(F.col("clause") == F.col("key_clause"), F.lit(False))).alias("cited"),
        (filled & should).alias("should_abstain"), (filled & did).alias("did_abstain"),
        (filled & should & ~did).alias("false_answer"), (filled & ~should & did).alias("dodge"),
        (filled & F.col("clause").isNotNull() & F.col("there").isNull()).alias("fabricated"),
    )


def _rate(part: Column, whole: Column) -> Column:
    """In hundredths of a per cent, null for nothing."""
    return F.when(whole > 0, F.floor(part * 10000 / whole).cast("bigint"))


def score_summary(flags: DataFrame) -> DataFrame:
    """Rates by category, and over all (category null)."""
    n, right = F.count_if("filled"), F.count_if("right")
    should, did = F.count_if("should_abstain"), F.count_if("did_abstain")
    both = F.count_if(F.col("should_abstain") & F.col("did_abstain"))
    counted = F.col("filled") & F.col("expected").isNotNull()
    off = F.sum(F.when(counted, F.abs(F.coalesce("allowed", F.lit(0)) - F.col("expected"))))
    due = F.sum(F.when(counted, F.col("expected")))
    return flags.rollup("category").agg(
        n.alias("n"), _rate(right, n).alias("accuracy"), _rate(F.count_if("cited"), n).alias("citations"),
        _rate(off, due).alias("payout_error"), _rate(both, should).alias("recall"), _rate(both, did).alias("precision"),
        F.count_if("false_answer").alias("false_answers"), F.count_if("dodge").alias("dodges"), F.count_if("fabricated").alias("fabricated"),
    )


def exclusive_percentile(df: DataFrame, by: str, value: str, percent: int) -> DataFrame:
    """(by, n, p): the percentile by the exclusive method, which extrapolates beyond the largest value of few rows.

    ``value`` is a whole number; p comes in hundredths. Ranks are found by a window, so
    no group's values are gathered.
    """
    order = Window.partitionBy(by).orderBy(value)
    whole = Window.partitionBy(by)
    ranked = df.select(by, F.col(value).alias("v"), F.row_number().over(order).alias("k"), F.count(F.lit(1)).over(whole).alias("n"))
    place = F.col("n").cast("bigint") * percent + percent  # in hundredths of a rank
    low = F.least(F.greatest(F.floor(place / 100), F.lit(1)), F.greatest(F.col("n") - 1, F.lit(1)))
    near = ranked.withColumns({"low": low, "place": place}).where("k = low OR k = low + 1")
    ends = near.groupBy(by, "n", "low", "place").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    return ends.select(by, "n", F.when(F.col("n") == 1, F.col("a") * 100).otherwise(F.col("a") * 100 + (F.col("b") - F.col("a")) * (F.col("place") - F.col("low") * 100)).cast("bigint").alias("p"))


def latency_summary(runs: DataFrame, by: str, spent: str, calls: str, percent: int = 95) -> DataFrame:
    """(by, n, p, mean_calls): the percentile of the time spent, and the mean number of calls in hundredths."""
    mean = runs.groupBy(by).agg(F.expr(f"CAST(sum({calls}) * 100 DIV count(1) AS BIGINT)").alias("mean_calls"))
    return exclusive_percentile(runs, by, spent, percent).join(mean, by)


def retry_summary(summaries: DataFrame) -> DataFrame:
    """(n, fast, attempts, retried, answered_later) over (attempts, fast_path, abstained) of all lines."""
    return summaries.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("fast_path").alias("fast"), F.sum("attempts").alias("attempts"),
        F.count_if(F.col("attempts") > 1).alias("retried"), F.count_if((F.col("attempts") > 1) & ~F.col("abstained")).alias("answered_later"),
    )


def threshold_gate(summary: DataFrame, runs: DataFrame, key: DataFrame, least: int) -> DataFrame:
    """(n, accuracy, passed, in_key, in_run, backends, scope, may_record): accuracy against the least.

    ``runs`` (bill_id, line_no, backend) is what was run. A run that left lines of the
    key out is narrowed; such a run, or one of several backends, passes or fails but may
    not be recorded. Each part is one row.
    """
    whole = key.agg(F.count(F.lit(1)).alias("in_key"))
    asked = key.select("bill_id", "line_no")
    run = runs.join(asked, ["bill_id", "line_no"], "left_semi").agg(F.count(F.lit(1)).alias("in_run"), F.count_distinct("backend").alias("backends"))
    one = summary.where("category IS NULL").select("n", "accuracy", (F.col("accuracy") >= least).alias("passed"))
    told = one.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(run))
    scope = F.when(F.col("in_run") < F.col("in_key"), "narrowed").otherwise("whole")
    return told.withColumn("scope", scope).withColumn("may_record", (scope == "whole") & (F.col("backends") == 1))


def key_fill_status(key: DataFrame) -> DataFrame:
    return key.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("expected").isNotNull() | F.coalesce("key_flag", F.lit(False))).alias("filled"),
        F.count_if(F.coalesce("key_flag", F.lit(False))).alias("flagged"), F.sum("expected").alias("total"),
    )


def key_diff(a: DataFrame, b: DataFrame, fields: list[str]) -> DataFrame:
    """(bill_id, line_no, field, a, b): every field on which two keys differ."""
    x = a.select("bill_id", "line_no", *[F.col(f).cast("string").alias(f"a_{f}") for f in fields])
    y = b.select("bill_id", "line_no", *[F.col(f).cast("string").alias(f"b_{f}") for f in fields])
    both = x.join(y, ["bill_id", "line_no"], "full_outer")
    parts = ", ".join(f"'{f}', a_{f}, b_{f}" for f in fields)
    each = both.select("bill_id", "line_no", F.expr(f"stack({len(fields)}, {parts}) AS (field, a, b)"))
    return each.where("NOT (a <=> b)")


def version_compare(rows: DataFrame) -> DataFrame:
    """(metric, version, value, delta): each metric's change since the version before."""
    order = Window.partitionBy("metric").orderBy("version")
    return rows.select("metric", "version", "value", (F.col("value") - F.lag("value").over(order)).alias("delta"))


def quoted_spans(column: Column, least: int = 12) -> Column:
    """Spans in double quotes, cut at an ellipsis, without trailing , ; : and of ``least`` characters at least."""
    spans = F.regexp_extract_all(column, F.lit('"([^"]{%d,})"' % least), F.lit(1))
    cut = F.transform(spans, lambda s: F.regexp_replace(F.regexp_replace(s, r"(\.\.\.|…).*$", ""), "[,;:]+$", ""))
    return F.filter(cut, lambda s: F.length(s) >= least)


def quote_sources(holders: DataFrame, quotes: DataFrame) -> DataFrame:
    """(quote_id, policy, clause_id, own): clauses of the quote's policy that hold it; where there are none, those of others.

    ``holders`` are pairs (quote_id, policy, clause_id) of quotes and clauses that hold them.
    """
    told = holders.join(quotes.select("quote_id", F.col("policy").alias("asked")), "quote_id")
    told = told.withColumn("own", F.col("policy") == F.col("asked"))
    any_own = told.groupBy("quote_id").agg(F.max("own").alias("any_own"))
    return told.join(any_own, "quote_id").where("own OR NOT any_own").select("quote_id", "policy", "clause_id", "own")


def repair_citation(cited: DataFrame, quotes: DataFrame, holders: DataFrame) -> DataFrame:
    """(line_id, verdict, target): keep where the cited clause holds all quotes of a line, move where exactly one other
    does, human else. cited (line_id, clause_id); quotes (line_id, quote_id)."""
    n = quotes.groupBy("line_id").agg(F.countDistinct("quote_id").alias("n"))
    held = quotes.join(holders.select("quote_id", "clause_id").distinct(), "quote_id")
    full = held.groupBy("line_id", "clause_id").agg(F.countDistinct("quote_id").alias("k")).join(n, "line_id").where("k = n")
    target = full.groupBy("line_id").agg(F.count(F.lit(1)).alias("m"), F.min("clause_id").alias("only"))
    keep = full.join(cited, ["line_id", "clause_id"]).select("line_id", F.lit(True).alias("keep"))
    joined = cited.join(target, "line_id", "left").join(keep, "line_id", "left")
    verdict = F.when(F.col("keep"), "keep").when(F.col("m") == 1, "move").otherwise("human")
    return joined.select("line_id", verdict.alias("verdict"), F.when(verdict == "keep", F.col("clause_id")).when(verdict == "move", F.col("only")).alias("target"))


def supported_prefix(quote: Column, text: Column) -> Column:
    """Number of leading words of the quote that stand in the text as one run: one word more at a time, to the first that fails."""
    start = F.struct(F.lit("").alias("run"), F.lit(0).alias("n"), F.lit(True).alias("fits"))

    def add(state: Column, word: Column) -> Column:
        run = F.when(state["n"] == 0, word).otherwise(F.concat(state["run"], F.lit(" "), word))
        fits = state["fits"] & F.contains(text, run)
        return F.struct(F.when(fits, run).otherwise(state["run"]).alias("run"), (state["n"] + fits.cast("int")).alias("n"), fits.alias("fits"))

    return F.aggregate(F.split(normalise_quote(quote), " "), start, add, lambda s: s["n"])


def triage(findings: DataFrame) -> DataFrame:
    """(tier, policy, reason, n): one question for each policy and reason, those with most rows first."""
    tier = F.when(F.col("reason") == "unknown clause", 1).when(F.col("reason") == "quote", 2).otherwise(3)
    return findings.groupBy(tier.alias("tier"), "policy", "reason").agg(F.count(F.lit(1)).alias("n")).orderBy("tier", F.desc("n"), "policy")


def match_printed_row(key: DataFrame, rows: DataFrame, width: int = 22) -> DataFrame:
    """(bill_id, line_no, row_no): the first printed row (bill_id, row_no, row) that holds the start of the item."""
    joined = key.join(rows, "bill_id").where(F.contains(F.lower("row"), F.lower(F.substring("item", 1, width))))
    return joined.groupBy("bill_id", "line_no").agg(F.min("row_no").alias("row_no"))


def audit_profile(progress: DataFrame) -> DataFrame:
    """(job, n, largest_gap, together, retried, backends): the longest wait between completions, how many came with the one
    before, how many took more than one attempt, and the lines of each backend as ``name=count``, comma-joined."""
    order = Window.partitionBy("job").orderBy("at", "event_id")
    gaps = progress.withColumn("gap", F.col("at") - F.lag("at").over(order))
    each = gaps.groupBy("job", "backend").agg(
        F.count(F.lit(1)).alias("n"), F.max("gap").alias("largest_gap"), F.count_if(F.col("gap") == 0).alias("together"), F.count_if(F.col("attempts") > 1).alias("retried")
    )
    names = F.array_join(F.array_sort(F.collect_list(F.concat("backend", F.lit("="), F.col("n")))), ",")
    return each.groupBy("job").agg(
        F.sum("n").alias("n"), F.max("largest_gap").alias("largest_gap"), F.sum("together").alias("together"), F.sum("retried").alias("retried"), names.alias("backends")
    )


def time_shares(trace: DataFrame) -> DataFrame:
    """(kind, total, share): cents of time by kind, and the share of all in hundredths of a per cent."""
    sums = trace.groupBy("kind").agg(F.sum("spent").alias("total"))
    whole = sums.agg(F.sum("total").alias("whole"))
    return sums.crossJoin(F.broadcast(whole)).select("kind", "total", F.expr("total * 10000 DIV whole AS share"))


def example_report(store: DataFrame) -> DataFrame:
    """(run, bill_id, recorded_at, report): the latest stored report of each run and bill."""
    return store.groupBy("run", "bill_id").agg(F.max("recorded_at").alias("recorded_at"), F.max_by("report", F.struct("recorded_at", "seq")).alias("report"))


def assumption_flags(lines: DataFrame, rules: dict) -> DataFrame:
    """(bill_id, line_no, flag): the judgement calls that a row rests on, by pattern."""
    flags = F.array_compact(F.array(*[F.when(F.col("item").rlike(p), name) for name, p in rules.items()]))
    return lines.select("bill_id", "line_no", F.explode(flags).alias("flag"))


def operative_quote(clauses: DataFrame, sum_insured: Column) -> DataFrame:
    """(clause_id, quote): the table rows of this sum insured, else the first sentence of 40 characters or more."""
    lines = F.split("text", "\n", -1)
    rows = F.filter(lines, lambda x: F.startswith(x, F.lit("[table]")) & F.contains(x, sum_insured))
    parts = F.filter(F.split(F.regexp_replace("text", r"([.!?])[ \n]+", "$1\u0001"), "\u0001"), lambda s: F.length(s) >= 40)
    return clauses.select("clause_id", F.when(F.size(rows) > 0, F.array_join(rows, "\n")).otherwise(F.get(parts, F.lit(0))).alias("quote"))


def review_problems(key: DataFrame, clauses: DataFrame) -> DataFrame:
    """(line_id, problem) of key rows (line_id, policy, clause_id, quote, expected, charged)."""
    known = clauses.select("policy", "clause_id", F.col("text").alias("clause_text"))
    joined = key.join(known, ["policy", "clause_id"], "left")
    problems = F.array_compact(
        F.array(
            F.when(F.col("clause_id").isNotNull() & F.col("clause_text").isNull(), "unknown clause"),
            F.when(F.col("quote").isNotNull() & ~F.coalesce(F.contains("clause_text", F.col("quote")), F.lit(False)), "quote"),
            F.when((F.col("expected") < F.col("charged")) & F.col("clause_id").isNull(), "uncited deduction"),
        )
    )
    return joined.select("line_id", "policy", F.explode(problems).alias("reason"))
