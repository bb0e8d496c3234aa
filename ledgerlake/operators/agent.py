"""The audit with searches: what rules leave open is searched and judged in rounds, and each line accounts for itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators import adjudicate as A
from ledgerlake.operators import judging as J
from ledgerlake.operators.rules import PACK, Pack
from ledgerlake.plans.scratch import folder, stored

KEYS = J.KEYS
#: Clauses up to which what they say is broadcast, after they were counted.
FEW = 100_000


def graded(lines: DataFrame, clauses: DataFrame, judge: Callable[[DataFrame], DataFrame] | None = None, pack: Pack = PACK, sure: int = 300_000) -> Callable[[DataFrame], DataFrame]:
    """A judge for ``retry_loop`` that keeps the guards: candidates in, judgements with ``known`` and ``decision`` out.

    ``lines`` are (bill_id, line_no, policy, item), ``clauses`` (policy, clause_id, text) without
    repeats; candidates carry (keys, clause_id, score, rank), and (policy, item) where a search has them. What a clause says (limits, rooms,
    exclusion, schedule) is read once for each clause, and written; texts never go along with
    lines. Without ``judge`` the best candidate is cited, surely from the score ``sure`` up. A
    citation has to be a clause of the line's policy; a room's per-day limit is no limit of
    another line; a limit of zero needs a clause that excludes; without a figure, a candidate
    that defers to the schedule leaves the line open.
    """
    text = F.coalesce("text", F.lit(""))
    says = F.struct(
        J.limits_in(text).alias("limits"), text.rlike(pack.room).alias("room"), J.states_exclusion(text, pack).alias("excludes"),
        (text.rlike(pack.defers) & ~text.rlike(pack.default)).alias("defers"),
    )
    facts = stored(clauses.select("policy", "clause_id", says.alias("says")), folder(clauses.sparkSession, "says"))
    facts = F.broadcast(facts) if facts.count() <= FEW else facts.hint("merge")
    whose = lines.select(*KEYS, "policy", "item")

    def run(found: DataFrame) -> DataFrame:
        # Candidates that carry their line's policy and item need not meet the lines again.
        theirs = found if {"policy", "item"} <= set(found.columns) else found.join(whose.hint("merge"), KEYS)
        told = theirs.join(facts, ["policy", "clause_id"], "left")
        per = told.groupBy(*KEYS, "policy", "item").agg(
            F.min_by(F.struct("clause_id", "score", "says"), "rank").alias("best"), F.max(F.coalesce("says.defers", F.lit(False))).alias("defers")
        )
        if judge:
            judged = judge(found.drop("policy", "item")).join(per.drop("best").hint("merge"), KEYS).join(facts, ["policy", "clause_id"], "left")
        else:
            judged = per.select(*KEYS, "item", "defers", "best.clause_id", "best.says", F.col("best.says.limits").alias("limits"), (F.col("best.score") >= sure).alias("confident"))
        judged = judged.withColumn("limits", F.coalesce("limits", F.array().cast(A.LIMITS)))
        zero = F.exists("limits", lambda x: F.coalesce((x["amount"] == 0) | (x["percentage"] == 0), F.lit(False)))
        flags = {
            "known": F.col("says").isNotNull(), "room_cap": J.guard_room_cap(F.col("item").rlike(pack.room), F.coalesce("says.room", F.lit(False))),
            "zero": zero & ~F.coalesce("says.excludes", F.lit(False)), "defers": F.col("defers") & (F.size("limits") == 0),
        }
        return J.grade(judged.withColumns(flags)).select(*KEYS, "clause_id", "limits", "known", "decision")

    return run


def audit_with_searches(
    lines: DataFrame, bills: DataFrame, terms: DataFrame, listed: DataFrame, entitlement: DataFrame, deductions: DataFrame,
    search: Callable[[DataFrame, int], DataFrame], judge: Callable[[DataFrame], DataFrame], pack: Pack = PACK,
) -> DataFrame:
    """(bill_id, policy, line_no, cents, allowed, clause_id, why, stage, attempts, calls, changed, fast_path, abstained).

    Each line stops at the first stage that settles it: ``waiting`` (the bill falls into a
    waiting period), ``list`` (non-payable), ``room`` (by the bill's entitlement, capped, in
    full or flagged), else ``judged``: ``search`` gets open lines (keys, policy, item, qty) and the attempt
    and ``judge`` its candidates, as ``retry_loop`` calls them. A judged nil that cites a
    waiting clause of the policy is open again where the bill is not excluded and a note says
    why. The second pass scales what follows a breached room. ``entitlement`` is (bill_id,
    source, per_day, category, clause_id); a room without one is judged.

    ``calls`` counts searches and judgements, ``attempts`` the rounds to an answer (null
    without one), ``changed`` whether a later round than the first gave it, ``fast_path`` whether
    nothing was searched, ``abstained`` whether a person has to decide. Lines are read once
    and written before the rounds, in which only keys and candidates move. Line numbers are
    unique in a bill, and each bill has one policy. Rows without a bill id or a line number
    are no lines and take no part; an empty table gives an empty result.
    """
    spark = lines.sparkSession
    path = folder(spark, "audit")
    write = lambda df, name: stored(df, f"{path}/{name}")
    own = lines.select(*KEYS, "policy", "item", F.col("cents").cast("bigint").alias("cents"), F.col("qty").cast("int").alias("qty"), "sum_insured")
    own = write(own.where("bill_id IS NOT NULL AND line_no IS NOT NULL"), "lines")

    waits = A.assess_waiting(bills, own, terms, pack).select("bill_id", F.struct("waiting", "clause_id", "why").alias("wait"))
    cites = terms.select("policy", F.array("specified_clause", "initial_clause", "ped_clause").alias("periods"))
    facts = bills.select("bill_id", "policy").join(cites, "policy", "left").drop("policy").join(waits, "bill_id")
    room = entitlement.select("bill_id", "source", "per_day", "category", F.col("clause_id").cast("string").alias("room_clause"))
    told = own.join(facts.join(room, "bill_id", "left"), "bill_id", "left")
    told = A.judge_rooms(A.non_payable_match(told, listed, pack).drop("allowed"), pack)
    is_room = F.col("item").rlike(pack.room)
    stage = (
        F.when(F.col("wait.waiting").isin("specified", "initial"), "waiting").when(F.col("list_no").isNotNull(), "list")
        .when(is_room & (F.col("verdict") != "open"), "room").otherwise("judged")
    )
    staged = write(told.withColumn("stage", stage), "staged")

    answers = J.retry_loop(staged.where("stage = 'judged'"), search, judge, write, ("policy", "item", "qty"))
    answers = answers.select(*KEYS, F.col("clause_id").cast("string").alias("cited"), "limits", "attempts", "calls", "reason")
    # Written, so that the amounts below are not made again for every column that rests on them.
    both = write(staged.join(answers.hint("merge"), KEYS, "left"), "answered")
    saved, by_room = F.col("attempts").isNotNull(), F.col("stage") == "room"
    both = A.allowed_amount(both.withColumn("__room", F.col("allowed")).withColumn("limits", F.coalesce("limits", F.array().cast(A.LIMITS))))
    both = both.withColumn("allowed", F.when(by_room, F.col("__room")).when(saved, F.col("allowed")))
    both = both.withColumn("per_day", F.when(by_room, F.col("per_day")).when(saved, A.per_day_rate()))
    over = F.when(by_room, F.expr("cents > per_day * qty")).when(saved & is_room, F.col("over_limit"))
    both = both.withColumn("over_limit", F.coalesce(over, F.lit(False)))
    expired = (F.col("stage") == "judged") & (F.col("allowed") == 0) & F.array_contains("periods", F.col("cited")) & F.col("wait.why").isNotNull()
    both = both.withColumn("expired", F.coalesce(expired, F.lit(False))).withColumn("allowed", F.when(~F.col("expired"), F.col("allowed")))

    scaled = A.second_pass(write(both, "amounts"), deductions, pack)
    by = lambda name: F.col("stage") == name
    clause = F.when(by("waiting"), F.col("wait.clause_id")).when(by("room"), F.coalesce("deduction", "room_clause")).when(by("judged"), F.coalesce("deduction", "cited"))
    why = (
        F.when(by("waiting"), F.col("wait.why")).when(by("list"), "on the non-payable list")
        .when(F.col("expired"), F.concat("cited", F.lit(" is a waiting period, but "), "wait.why"))
        .when(F.col("deduction").isNotNull(), "scaled with the room")
        .when(by("room"), F.concat(F.col("source"), F.lit(": "), F.col("verdict"))).otherwise(F.coalesce("reason", F.lit("judged")))
    )
    allowed = F.when(by("waiting") | by("list"), F.lit(0).cast("bigint")).otherwise(F.col("allowed"))
    out = scaled.withColumns({"allowed": allowed, "__clause": clause, "__why": why})
    return out.select(
        "bill_id", "policy", "line_no", "cents", "allowed", F.col("__clause").alias("clause_id"), F.col("__why").alias("why"), "stage", "attempts",
        F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce(F.col("attempts") > 1, F.lit(False)).alias("changed"),
        (~by("judged")).alias("fast_path"), F.col("allowed").isNull().alias("abstained"),
    )


def line_summary(audited: DataFrame) -> DataFrame:
    """(policy, stage, lines, calls, changed, abstained): what the rounds cost and gave, by policy and stage."""
    return audited.groupBy("policy", "stage").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("calls").alias("calls"), F.count_if("changed").alias("changed"), F.count_if("abstained").alias("abstained")
    )
