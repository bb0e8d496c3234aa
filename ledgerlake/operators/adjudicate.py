"""Adjudication: limits, room rules, waiting periods, the second pass and the report.

Every rule is a column or a join over all lines of all bills. Lines carry
(bill_id, policy, line_no, item, cents, qty, sum_insured); amounts are cents. A null
``allowed`` means "not decided", which is not 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.text import search_key
from ledgerlake.operators.rules import PACK, Pack, first_match
from ledgerlake.plans.scratch import folder, stored

LIMITS = "array<struct<amount:bigint,percentage:int,basis:string>>"


def resolve_limits(lines: DataFrame) -> DataFrame:
    """Add ``resolved``: each limit in cents (percentage of the sum insured first, else the amount; times qty per day)."""
    return lines.withColumn(
        "resolved",
        F.expr(
            "transform(limits, l -> coalesce(sum_insured * l.percentage, l.amount)"
            " * CASE WHEN l.basis = 'per_day' THEN qty ELSE 1 END)"
        ),
    )


def allowed_amount(lines: DataFrame) -> DataFrame:
    """Add ``allowed`` (the charge, or the lowest limit if that is less) and ``over_limit`` (a per-day limit is exceeded)."""
    resolved = resolve_limits(lines)
    out = resolved.withColumn("allowed", F.expr("least(cents, array_min(filter(resolved, x -> x IS NOT NULL)))"))
    over = "exists(limits, l -> l.basis = 'per_day' AND cents > coalesce(sum_insured * l.percentage, l.amount) * qty)"
    return out.withColumn("over_limit", F.expr(f"coalesce({over}, false)")).drop("resolved")


def per_day_rate(limits: str = "limits") -> Column:
    """The lowest per-day amount; percentages do not count."""
    return F.expr(f"array_min(transform(filter({limits}, l -> l.basis = 'per_day' AND l.amount IS NOT NULL), l -> l.amount))")


def apply_copay(allowed: Column, percent: Column) -> Column:
    """allowed * (1 - percent / 100), in whole cents, half up."""
    return F.floor((allowed * (100 - percent) + 50) / 100).cast("bigint")


def cap_total(total: Column, sum_insured: Column) -> Column:
    return F.least(total, sum_insured * 100)


def room_rank(column: Column, pack: Pack = PACK) -> Column:
    return first_match(column, pack.ladder).cast("int")


def ame_scope(column: Column, pack: Pack = PACK) -> Column:
    """excluded (tested first), included or unnamed."""
    return F.when(column.rlike(pack.excluded), "excluded").when(column.rlike(pack.included), "included").otherwise("unnamed")


def route_item(column: Column, pack: Pack = PACK) -> Column:
    return first_match(column, pack.routes, "other")


def _with_hits(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """Lines with ``__hits``: the list entries (no, entry), in list order, whose short name stands in the keyed item."""
    name = F.trim(search_key(F.regexp_extract("name", r"^([^(/-]*)", 1)))
    named = entries.select("no", name.alias("entry")).where(F.length("entry") > 3)
    # The list is a rule pack of some hundred rows: one array, read by every line where it is.
    listed = named.agg(F.array_sort(F.collect_list(F.struct("no", "entry"))).alias("__entries"))
    # The key is bound to a variable: else Spark puts its expression into the inner function and makes it again for every entry.
    hits = F.transform(F.array(search_key(F.col("item"))), lambda k: F.filter("__entries", lambda e: F.contains(k, e["entry"])))
    return lines.crossJoin(F.broadcast(listed)).withColumn("__hits", hits[0]).drop("__entries")


def non_payable_match(lines: DataFrame, entries: DataFrame, pack: Pack = PACK) -> DataFrame:
    """Add (list_no, allowed): the first entry in list order; one that is a named benefit leaves the line open."""
    first = F.get("__hits", F.lit(0))
    hit = _with_hits(lines, entries).withColumn("__first", F.when(~first["entry"].rlike(pack.overridden), first))
    return hit.select(*lines.columns, F.col("__first.no").alias("list_no"), F.when(F.col("__first").isNotNull(), F.lit(0)).cast("bigint").alias("allowed"))


def non_payable_longest(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """Add list_no: the entry with the longest name, the first of these in list order."""
    order = F.array_max(F.transform("__hits", lambda e: F.struct(F.length(e["entry"]).alias("size"), (-e["no"]).alias("no"))))
    return _with_hits(lines, entries).select(*lines.columns, (-order["no"]).alias("list_no"))


def room_entitlement(bills: DataFrame, schedules: DataFrame, table_rows: DataFrame, wording: DataFrame) -> DataFrame:
    """(bill_id, source, per_day, category): a schedule figure, else its category, else the table row of exactly
    this sum insured, else the wording (at actuals, then deferral); nothing where none applies."""
    keyed = bills.select("bill_id", "policy", "sum_insured")
    none = F.lit(None)
    candidates = [
        (1, keyed.join(schedules.where("per_day IS NOT NULL"), "bill_id"), "schedule", F.col("per_day"), none),
        (2, keyed.join(schedules.where("category <> ''"), "bill_id"), "schedule", none, F.col("category")),
        (3, keyed.join(table_rows, ["policy", "sum_insured"]), "table", F.col("per_day"), F.col("category")),
        (4, keyed.join(wording.where("at_actuals"), "policy"), "at_actuals", none, none),
        (5, keyed.join(wording.where("defers"), "policy"), "defers", none, none),
    ]
    rows = [
        df.select("bill_id", F.lit(n).alias("priority"), F.lit(source).alias("source"), day.cast("bigint").alias("per_day"), cat.cast("string").alias("category"))
        for n, df, source, day, cat in candidates
    ]
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    best = every.groupBy("bill_id").agg(F.min_by(F.struct("source", "per_day", "category"), "priority").alias("b"))
    return best.select("bill_id", "b.source", "b.per_day", "b.category")


def judge_rooms(rooms: DataFrame, pack: Pack = PACK) -> DataFrame:
    """Add (verdict, allowed) to room lines that carry their entitlement (source, per_day, category)."""
    occupied, entitled = room_rank(F.col("item"), pack), room_rank(F.coalesce("category", F.lit("")), pack)
    verdict = (
        F.when(F.col("per_day").isNotNull(), "per_day")
        .when(F.col("category").isNotNull(), F.when(occupied <= entitled, "category_ok").otherwise("category_flag"))
        .when(F.col("source") == "at_actuals", "at_actuals")
        .when(F.col("source") == "defers", "defers")
        .otherwise("open")
    )
    out = rooms.withColumn("verdict", verdict)
    allowed = F.expr(
        "CASE WHEN verdict = 'per_day' THEN least(cents, per_day * qty) WHEN verdict IN ('category_ok', 'at_actuals') THEN cents END"
    )
    return out.withColumn("allowed", allowed)


def room_verdict(lines: DataFrame, entitlement: DataFrame, pack: Pack = PACK) -> DataFrame:
    """Room lines with (allowed, verdict): capped per day, in full, or flagged; other lines are left out."""
    return judge_rooms(lines.where(F.col("item").rlike(pack.room)).join(entitlement, "bill_id", "left"), pack)


def months_served(start: str, end: str) -> Column:
    """Whole months from start to end: one less where the day of the month is not reached."""
    return F.expr(
        f"CAST((year({end}) - year({start})) * 12 + month({end}) - month({start})"
        f" - CASE WHEN day({end}) < day({start}) THEN 1 ELSE 0 END AS INT)"
    )


def assess_waiting(bills: DataFrame, lines: DataFrame, terms: DataFrame, pack: Pack = PACK) -> DataFrame:
    """(bill_id, months, days, waiting, clause_id, why): whether a bill falls into a waiting period of its policy.

    ``terms`` holds what each policy states (``waiting_terms``). waiting: not_assessed (a
    date is missing), accident (carved out of every period), specified (nil: a condition
    that the policy's own clause confirms), initial (nil) or served. A nil cites its
    clause. The period for conditions that were there before is named, never applied:
    nothing on a bill tells.
    """
    first = [F.min(F.when(F.col("item").rlike(rf"\b{w}\b"), F.col("line_no"))).alias(f"__{w}") for w in pack.conditions]
    told = lines.groupBy("bill_id").agg(F.max(F.col("item").rlike(pack.accident)).alias("accident"), *first)
    joined = bills.join(terms, "policy", "left").join(told, "bill_id", "left").withColumn("months", months_served("started", "admitted"))
    joined = joined.withColumn("days", F.datediff("admitted", "started"))
    named = [F.when(F.contains(F.lower("specified_text"), F.lit(w)) & F.col(f"__{w}").isNotNull(), F.struct(F.col(f"__{w}").alias("at"), F.lit(w).alias("word"))) for w in pack.conditions]
    joined = joined.withColumn("condition", F.array_min(F.array_compact(F.array(*named)))["word"])
    waiting = (
        F.when(F.col("started").isNull() | F.col("admitted").isNull(), "not_assessed")
        .when(F.coalesce("accident", F.lit(False)), "accident")
        .when(F.col("condition").isNotNull() & (F.col("months") < F.col("specified_months")), "specified")
        .when(F.col("days") < F.col("initial_days"), "initial")
        .otherwise("served")
    )
    joined = joined.withColumn("waiting", waiting)
    over = F.expr("CASE WHEN condition IS NOT NULL THEN concat(', ', condition, ' is named but its ', specified_months, ' months are over') END")
    before = F.expr("CASE WHEN ped_clause IS NOT NULL THEN concat('; ', ped_clause, ' on earlier conditions was not assessed') END")
    why = (
        F.when(F.col("waiting") == "not_assessed", "a date is missing")
        .when(F.col("waiting") == "accident", "an accident is carved out")
        .when(F.col("waiting") == "specified", F.expr("concat(specified_clause, ': ', condition, ' waits ', specified_months, ' months, ', months, ' were served')"))
        .when(F.col("waiting") == "initial", F.expr("concat(initial_clause, ': ', days, ' of ', initial_days, ' days were served')"))
        .otherwise(F.concat_ws("", F.concat(F.col("months"), F.lit(" months were served")), over, before))
    )
    cited = F.when(F.col("waiting") == "specified", F.col("specified_clause")).when(F.col("waiting") == "initial", F.col("initial_clause"))
    return joined.select("bill_id", "months", "days", "waiting", cited.alias("clause_id"), why.alias("why"))


def waiting_nil_lines(lines: DataFrame, waiting: DataFrame) -> DataFrame:
    """The lines of excluded bills, allowed 0, with the clause and the reason; all later stages leave them alone."""
    nil = waiting.where("waiting IN ('specified', 'initial')")
    return lines.join(nil.select("bill_id", "waiting", "clause_id", "why"), "bill_id").withColumn("allowed", F.lit(0).cast("bigint"))


def cap_rooms(lines: DataFrame, caps: DataFrame, pack: Pack = PACK) -> DataFrame:
    """Add (per_day, allowed, over_limit): room lines capped per day, all others in full."""
    joined = lines.join(F.broadcast(caps), "policy", "left")
    room = F.col("item").rlike(pack.room)
    out = joined.withColumn("per_day", F.when(room, F.expr("sum_insured * cap_rate DIV 100")))
    out = out.withColumn("allowed", F.expr("least(cents, per_day * qty)"))
    return out.withColumn("over_limit", F.expr("coalesce(cents > per_day * qty, false)")).drop("cap_rate")


def breach_ratio(lines: DataFrame, pack: Pack = PACK) -> DataFrame:
    """(bill_id, policy, limit_cents, charged): the breached room line with the smallest ratio limit / charge.

    A breach on a line that is no room sets no ratio. Ratios are compared as fractions
    of whole cents, so no rounding decides.
    """
    breached = lines.where(F.col("over_limit") & F.col("item").rlike(pack.room)).selectExpr(
        "bill_id", "policy", "line_no", "per_day * greatest(qty, 1) AS limit_cents", "cents AS charged"
    )
    order = F.struct(F.expr("CAST(limit_cents AS DECIMAL(38,18)) / charged"), "line_no")
    best = breached.groupBy("bill_id", "policy").agg(F.min_by(F.struct("limit_cents", "charged"), order).alias("b"))
    return best.select("bill_id", "policy", "b.limit_cents", "b.charged")


def with_breach(lines: DataFrame, pack: Pack = PACK) -> DataFrame:
    """Each line with (limit_cents, charged) of its bill's ``breach_ratio``, taken where the bill's lines lie together."""
    room = F.col("over_limit") & F.col("item").rlike(pack.room)
    worst = F.expr("struct(CAST(per_day * greatest(qty, 1) AS DECIMAL(38,18)) / cents AS ratio, line_no, per_day * greatest(qty, 1) AS limit_cents, cents AS charged)")
    told = lines.withColumn("__worst", F.min(F.when(room, worst)).over(Window.partitionBy("bill_id", "policy")))
    return told.withColumns({"limit_cents": F.col("__worst.limit_cents"), "charged": F.col("__worst.charged")}).drop("__worst")


def second_pass(lines: DataFrame, clauses: DataFrame, pack: Pack = PACK, differential_billing: bool = True) -> DataFrame:
    """Scale answered lines that follow the room, where the bill's room rate is breached. Adds (scaled, deduction, why).

    ``clauses`` (policy, clause_id) state the deduction: without one nothing is deducted,
    since there would be nothing to cite; nor where differential billing is ruled out.
    ``deduction`` is the clause that a scaled line cites, ``why`` tells why a line of a
    breached bill was left alone.
    """
    joined = with_breach(lines, pack).join(F.broadcast(clauses.select("policy", F.col("clause_id").alias("__clause"))), "policy", "left")
    scope = ame_scope(F.col("item"), pack)
    why = (
        F.when(F.col("limit_cents").isNull(), "no per-day cap was breached")
        .when(~F.lit(differential_billing), "differential billing was ruled out")
        .when(F.col("__clause").isNull(), "no clause states the deduction")
        .when(F.col("allowed").isNull(), "flagged, so there is no amount")
        .when(F.col("over_limit"), "the room line itself")
        .when(scope == "excluded", "outside the associated expenses")
        .when(scope != "included", "not named by the definition")
    )
    told = joined.withColumn("why", why).withColumn("scaled", why.isNull())
    new = F.expr("CAST((2 * CAST(allowed AS DECIMAL(20,0)) * limit_cents + charged) DIV (2 * CAST(charged AS DECIMAL(20,0))) AS BIGINT)")
    out = told.withColumn("allowed", F.when(F.col("scaled"), new).otherwise(F.col("allowed")))
    return out.withColumn("deduction", F.when(F.col("scaled"), F.col("__clause"))).drop("limit_cents", "charged", "__clause")


def audit_lines(
    lines: DataFrame, bills: DataFrame, terms: DataFrame, listed: DataFrame, caps: DataFrame, deductions: DataFrame,
    judge: Callable[[DataFrame], DataFrame] | None = None, pack: Pack = PACK,
) -> DataFrame:
    """(bill_id, policy, line_no, cents, allowed, clause_id, why): the whole audit, a row for each line.

    Waiting periods, then the list, then rooms and judgements, then the second pass: each
    stage takes what the one before left open. ``judge`` gets the lines that reach it and
    gives (bill_id, line_no, allowed, clause_id, reason) of those it decides; a null
    amount leaves a line open, with the reason, and the second pass does not touch it.
    """
    keys = ["bill_id", "line_no"]
    nil = assess_waiting(bills, lines, terms, pack).where("waiting IN ('specified', 'initial')")
    waits = lines.join(nil.select("bill_id", F.struct("clause_id", "why").alias("__w")), "bill_id", "left")
    named = non_payable_match(waits, listed).withColumn("__listed", F.col("allowed").isNotNull())
    settled = F.col("__w").isNotNull() | F.col("__listed")
    # Settled lines go along, marked, instead of being joined out: they set no ratio and no judge sees them.
    capped = cap_rooms(named, caps, pack).withColumn("__settled", settled).withColumn("over_limit", F.col("over_limit") & ~settled)
    if judge:
        # Written once, so that the judge's branch does not go through the steps above again.
        capped = stored(capped, folder(lines.sparkSession, "capped"))
        told = judge(capped.where("NOT __settled")).select(*keys, F.struct("allowed", "clause_id", "reason").alias("__j"))
        capped = capped.join(told, keys, "left")
    else:
        capped = capped.withColumn("__j", F.lit(None).cast("struct<allowed:bigint,clause_id:string,reason:string>"))
    decided = capped.withColumn("allowed", F.expr("CASE WHEN __settled THEN NULL WHEN __j IS NULL THEN allowed ELSE __j.allowed END"))
    scaled = second_pass(decided, deductions, pack)
    cited = F.when(F.col("__w").isNotNull(), F.col("__w.clause_id")).when(~F.col("__listed"), F.coalesce("deduction", "__j.clause_id"))
    why = F.when(F.col("__w").isNotNull(), F.col("__w.why")).when(F.col("__listed"), "on the non-payable list").otherwise(F.coalesce("__j.reason", "why"))
    allowed = F.expr("CASE WHEN __settled THEN 0L ELSE allowed END")
    return scaled.select("bill_id", "policy", "line_no", "cents", allowed.alias("allowed"), cited.alias("clause_id"), why.alias("why"))


def report(lines: DataFrame) -> DataFrame:
    """(bill_id, policy, n_lines, charged, allowed, flagged) of each bill under each policy."""
    return lines.groupBy("bill_id", "policy").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum("cents").alias("charged"),
        F.sum(F.coalesce("allowed", F.lit(0))).alias("allowed"),
        F.count_if(F.col("allowed").isNull()).alias("flagged"),
    )


def report_split(lines: DataFrame) -> DataFrame:
    """(bill_id, policy, paid, cut, open): what is paid, cut by a clause, and still open."""
    sums = lines.groupBy("bill_id", "policy").agg(
        F.sum(F.coalesce("allowed", F.lit(0))).alias("paid"),
        F.sum("cents").alias("charged"),
        F.sum(F.when(F.col("allowed").isNull(), F.col("cents")).otherwise(0)).alias("open"),
    )
    return sums.selectExpr("bill_id", "policy", "paid", "greatest(charged - paid - open, 0) AS cut", "open")


def compare_policies(lines: DataFrame, policies: DataFrame, clauses: DataFrame, pack: Pack = PACK) -> DataFrame:
    """(bill_id, best, best_total, difference): each bill under each policy (policy, place, cap_rate)."""
    every = lines.drop("policy").crossJoin(F.broadcast(policies.select("policy", "place")))
    done = second_pass(cap_rooms(every, policies.select("policy", "cap_rate"), pack), clauses, pack)
    totals = done.groupBy("bill_id", "policy").agg(F.sum("allowed").alias("total")).join(F.broadcast(policies.select("policy", "place")), "policy")
    best = totals.groupBy("bill_id").agg(
        F.max_by("policy", F.struct("total", -F.col("place"))).alias("best"),
        F.max("total").alias("best_total"),
        (F.max("total") - F.min("total")).alias("difference"),
    )
    return best


def explain_line(lines: DataFrame) -> DataFrame:
    """Add ``why``: flagged, paid, not_payable, per_day_cap (whole days 1 to 366), proportionate or reduced."""
    why = (
        F.when(F.col("allowed").isNull(), "flagged")
        .when(F.col("allowed") >= F.col("cents"), "paid")
        .when(F.col("allowed") == 0, "not_payable")
        .when(F.expr("per_day > 0 AND allowed % per_day = 0 AND allowed DIV per_day BETWEEN 1 AND 366"), "per_day_cap")
        .when(F.col("scaled"), "proportionate")
        .otherwise("reduced")
    )
    return lines.withColumn("why", why)


def derive_expected(lines: DataFrame, waiting: DataFrame, entries: DataFrame, caps: DataFrame, clauses: DataFrame, pack: Pack = PACK) -> DataFrame:
    """An independent decision list: waiting nil, list nil, room cap, proportionate, full. Adds (expected, rule).

    Named benefits of the list decide nothing, and a policy without a clause deducts nothing.
    """
    nil = waiting.where("waiting IN ('specified', 'initial')").select("bill_id", F.lit(True).alias("nil"))
    benefit = F.trim(search_key(F.regexp_extract("name", r"^([^(/-]*)", 1))).rlike(pack.overridden)
    listed = non_payable_longest(lines, entries.where(~benefit))
    joined = cap_rooms(listed, caps, pack).join(nil, "bill_id", "left")
    joined = joined.join(F.broadcast(clauses.select("policy", F.lit(True).alias("stated"))), "policy", "left")
    joined = joined.withColumn("nil", F.coalesce("nil", F.lit(False)))
    on_list = F.col("list_no").isNotNull()
    open_ = ~F.col("nil") & ~on_list
    w = Window.partitionBy("bill_id")
    ratio = F.when(open_ & F.col("over_limit") & F.coalesce("stated", F.lit(False)), F.struct(F.expr("CAST(per_day * greatest(qty, 1) AS DECIMAL(38,18)) / cents AS r"), F.expr("line_no AS k"), F.expr("per_day * greatest(qty, 1) AS a"), F.expr("cents AS b")))
    with_ratio = joined.withColumn("worst", F.min(ratio).over(w))
    follows = open_ & (ame_scope(F.col("item"), pack) == "included") & F.col("worst").isNotNull() & ~F.col("over_limit")
    rule = (
        F.when(F.col("nil"), "waiting").when(on_list, "list").when(F.col("item").rlike(pack.room), "room")
        .when(follows, "proportionate").otherwise("full")
    )
    scaled = F.expr("CAST((2 * CAST(cents AS DECIMAL(20,0)) * worst.a + worst.b) DIV (2 * CAST(worst.b AS DECIMAL(20,0))) AS BIGINT)")
    ruled = with_ratio.withColumn("rule", rule)
    expected = F.when(F.col("rule").isin("waiting", "list"), F.lit(0).cast("bigint")).when(F.col("rule") == "proportionate", scaled).otherwise(F.col("allowed"))
    return ruled.withColumn("expected", expected).drop("worst", "nil", "stated", "allowed", "per_day", "over_limit", "list_no")
