"""Judging candidates: the default judge, the guards, the grade and the bounded retry loop.

A judge reports limits and a citation, never an amount. The default one reads limit
phrases from the clause's text; another one is any function from candidates to
(key columns, clause_id, limits, confident).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.text import parse_amount
from ledgerlake.operators.adjudicate import LIMITS, allowed_amount
from ledgerlake.operators.rules import PACK, Pack

KEYS = ["bill_id", "line_no"]
MAX_ATTEMPTS = 3
#: Calls of search and judge that a line may take.
MAX_CALLS = 8


def states_exclusion(text: Column, pack: Pack = PACK) -> Column:
    return text.rlike(pack.exclusion)


def defers_to_schedule(hits: DataFrame, pack: Pack = PACK) -> DataFrame:
    """(bill_id, line_no, defers): some candidate hands the figure to the schedule and states no default."""
    defers = F.col("text").rlike(pack.defers) & ~F.col("text").rlike(pack.default)
    return hits.groupBy(*KEYS).agg(F.max(defers).alias("defers"))


# How limits are worded. A share is a whole per cent of the sum insured; an amount carries its currency, so years, codes and counts are none.
SHARE = r"(?i)(?:^|[^0-9.])([0-9]{1,3})\s*%\s*of\s+(?:the\s+)?sum\s+insured"
AMOUNT = r"(?i)(?:\bRs\.?|\bINR|₹)\s*[0-9][0-9,]*(?:\.[0-9]{1,2})?(?:\s*/-)?(?:\s*(?:per\s+day|a\s+day|/\s*day|daily))?"
FIGURE, DAILY = r"([0-9][0-9,]*(?:\.[0-9]{1,2})?)", r"(?i)day|daily"


def limits_in(text: Column) -> Column:
    """The limits that a text states, shares first, each in the order of the text.

    Amounts are rupees with any grouping ("2,00,000", "1,500/-", "750.50"), for each day
    where the wording says so. All of them apply, so "whichever is lower" needs no rule.
    """
    shares = F.transform(
        F.regexp_extract_all(text, F.lit(SHARE), F.lit(1)),
        lambda m: F.struct(F.lit(None).cast("bigint").alias("amount"), m.cast("int").alias("percentage"), F.lit("total").alias("basis")),
    )
    amounts = F.transform(
        F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(0)),
        lambda m: F.struct(
            parse_amount(F.regexp_extract(m, FIGURE, 1)).alias("amount"), F.lit(None).cast("int").alias("percentage"),
            F.when(m.rlike(DAILY), "per_day").otherwise("total").alias("basis"),
        ),
    )
    return F.concat(shares, amounts).cast(LIMITS)


def default_judge(candidates: DataFrame) -> DataFrame:
    """(keys, clause_id, limits, confident): the best candidate and the limits that its text states."""
    best = candidates.groupBy(*KEYS).agg(F.min_by(F.struct("clause_id", "text", "score"), "rank").alias("b"))
    return best.select(*KEYS, F.col("b.clause_id").alias("clause_id"), limits_in(F.col("b.text")).alias("limits"), (F.col("b.score") >= 300_000).alias("confident"))


def guard_unknown_citation(judgements: DataFrame, clauses: DataFrame) -> DataFrame:
    """Add ``known``: whether the cited clause is one of the policy."""
    ids = clauses.select("policy", "clause_id").distinct().withColumn("known", F.lit(True))
    return judgements.join(ids.hint("merge"), ["policy", "clause_id"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def guard_room_cap(is_room: Column, governs_room: Column) -> Column:
    """A per-day limit from a room clause on a line that is no room."""
    return governs_room & ~is_room & F.exists("limits", lambda x: x["basis"] == "per_day")


def guard_zero_limit(text: Column, pack: Pack = PACK) -> Column:
    """A zero limit from a clause that states no exclusion."""
    zero = F.exists("limits", lambda x: (x["amount"] == 0) | (x["percentage"] == 0))
    return F.coalesce(zero, F.lit(False)) & ~states_exclusion(text, pack)


def grade(judgements: DataFrame) -> DataFrame:
    """Add ``decision``: abstain, rewrite or save, the first of the ladder that applies."""
    decision = (
        F.when(F.col("clause_id").isNull(), "rewrite")
        .when(~F.col("known"), "abstain")
        .when(~F.col("confident"), "rewrite")
        .when(F.col("room_cap"), "rewrite")
        .when(F.col("zero"), "rewrite")
        .when(F.col("defers"), "abstain")
        .otherwise("save")
    )
    return judgements.withColumn("decision", decision)


def abstain_reason(fabricated: Column, repeated: Column, calls: Column, attempts: Column) -> Column:
    """Why a line stays open: fabricated citation, repeated searches, too many calls, too many attempts, or the detail."""
    return (
        F.when(fabricated, "fabricated").when(repeated, "repeated searches").when(calls >= MAX_CALLS, "call cap")
        .when(attempts >= MAX_ATTEMPTS, "attempts").otherwise("detail")
    )


def retry_loop(
    lines: DataFrame, search: Callable[[DataFrame, int], DataFrame], judge: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, str], DataFrame], carry: tuple = (),
) -> DataFrame:
    """(keys, clause_id, limits, attempts, calls, reason) of every line: up to three rounds over the lines that are still open.

    ``search(open lines, attempt)`` gives candidates, with ``calls`` where a line's search
    takes more than one; ``judge`` gives judgements, with ``decision`` as ``grade`` makes it
    (and ``known``), else a confident one is saved and another one asked again. Abstaining
    is final: a citation that is unknown is never asked again nor told. A line whose two
    last searches gave the same clauses stops before it is judged, one that took MAX_CALLS
    calls of search and judge after it. Lines without an answer come back with nulls and
    the reason. ``write(df, name)`` stores each round and reads it back, so that plans do
    not grow with the rounds. ``carry`` are columns of ``lines`` that open lines keep, so
    that a search has them at hand.
    """
    open_, ends, seen = lines.select(*KEYS, *carry, F.lit(0).alias("calls")), [], None
    nothing = {"clause_id": F.lit(None).cast("long"), "limits": F.lit(None).cast(LIMITS), "attempts": F.lit(None).cast("int")}
    no, columns = F.lit(False), [*KEYS, "clause_id", "limits", "attempts", "calls", "reason"]
    for attempt in range(MAX_ATTEMPTS):
        found = write(search(open_.drop("calls"), attempt), f"found{attempt}")
        cost = F.max("calls") if "calls" in found.columns else F.lit(1)
        sets = found.groupBy(*KEYS).agg(F.array_sort(F.collect_set("clause_id")).alias("ids"), cost.cast("int").alias("cost"))
        spent = open_.join(sets.select(*KEYS, "cost"), KEYS, "left")
        open_ = write(spent.select(*KEYS, *carry, (F.col("calls") + F.coalesce("cost", F.lit(1))).alias("calls")), f"asked{attempt}")
        if seen is not None:
            same = sets.alias("a").join(seen.alias("b"), KEYS).where("a.ids = b.ids").select(*KEYS)
            same = write(open_.join(same, KEYS, "left_semi"), f"same{attempt}")
            ends.append(same.withColumns({**nothing, "reason": abstain_reason(no, F.lit(True), F.col("calls"), F.lit(attempt))}))
            found, open_ = found.join(same, KEYS, "left_anti"), open_.join(same, KEYS, "left_anti")
        judged = judge(found)
        if "decision" not in judged.columns:
            judged = judged.withColumn("decision", F.when(F.col("confident"), "save").otherwise("rewrite"))
        known = F.col("known") if "known" in judged.columns else F.lit(True)
        told = judged.where("decision IN ('save', 'abstain')").select(*KEYS, "clause_id", "limits", "decision", known.alias("known"))
        judged = write(open_.withColumn("calls", F.col("calls") + 1).join(told, KEYS, "left"), f"judged{attempt}")
        saved, final = judged.where("decision = 'save'"), judged.where("decision = 'abstain'")
        ends.append(saved.withColumns({"attempts": F.lit(attempt + 1), "reason": F.lit(None).cast("string")}))
        ends.append(final.withColumns({**nothing, "reason": abstain_reason(~F.col("known"), no, F.lit(0), F.lit(0))}))
        rest = judged.where("decision IS NULL").select(*KEYS, *carry, "calls")
        over = F.col("calls") >= MAX_CALLS
        ends.append(rest.where(over).withColumns({**nothing, "reason": abstain_reason(no, no, F.col("calls"), F.lit(attempt))}))
        open_, seen = rest.where(~over), sets
    ends.append(open_.withColumns({**nothing, "reason": abstain_reason(no, no, F.col("calls"), F.lit(MAX_ATTEMPTS))}))
    rows = ends[0].select(*columns)
    for more in ends[1:]:
        rows = rows.unionByName(more.select(*columns))
    return rows


def naive_audit(lines: DataFrame, judgements: DataFrame) -> DataFrame:
    """A single pass: no or an unsure judgement leaves the line open (an unsure one keeps its citation), else compute."""
    joined = lines.join(judgements, KEYS, "left")
    computed = allowed_amount(joined.withColumn("limits", F.coalesce("limits", F.array().cast(LIMITS))))
    sure = F.coalesce("confident", F.lit(False))
    return computed.withColumn("allowed", F.when(sure, F.col("allowed"))).select(*KEYS, "clause_id", "allowed")
