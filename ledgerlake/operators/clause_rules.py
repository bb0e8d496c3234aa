"""Facts that clauses state: rooms, waiting periods, deductions, definitions, and checks that rest on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUM_ROW = r"Sum Insured ([0-9]{5,8})"
STANDARD_SUMS = (300_000, 500_000, 1_000_000, 2_500_000)


def governs_room(clauses: DataFrame, room: str, actuals: str, defers: str) -> DataFrame:
    """Add (has_rows, states, defers, governs): what a clause says of rooms."""
    t = F.col("text")
    told = clauses.withColumns({"is_room": t.rlike(room), "has_rows": t.rlike(SUM_ROW), "states": t.rlike(actuals), "defers": t.rlike(defers)})
    return told.withColumn("governs", F.col("is_room") & (F.col("has_rows") | F.col("states") | F.col("defers")))


def room_clause(told: DataFrame) -> DataFrame:
    """(policy, clause_id, tier): the room clause with table rows, else the first that states or defers, else the longest."""
    tier = F.when(F.col("has_rows"), 1).when(F.col("states") | F.col("defers"), 2).otherwise(3)
    order = F.struct(tier.alias("tier"), (-F.length("text")).alias("less"), "clause_id")
    best = told.where("is_room").groupBy("policy").agg(F.min(order).alias("b"))
    return best.select("policy", F.col("b.clause_id").alias("clause_id"), F.col("b.tier").alias("tier"))


def sum_insured_options(clauses: DataFrame) -> DataFrame:
    """(policy, options): the sums insured that the policy's tables name, sorted; the standard four where none does."""
    named = F.transform(F.regexp_extract_all("text", F.lit(SUM_ROW), F.lit(1)), lambda x: x.cast("bigint"))
    each = clauses.select("policy", F.explode_outer(F.array_distinct(named)).alias("option")).distinct()
    found = each.groupBy("policy").agg(F.array_sort(F.collect_list("option")).alias("options"))
    standard = F.array(*[F.lit(x).cast("bigint") for x in STANDARD_SUMS])
    return found.withColumn("options", F.when(F.size("options") > 0, F.col("options")).otherwise(standard))


#: Kind -> (pattern of the exclusion code, pattern of the number, number preferred where several are stated, unit).
WAITING_KINDS = {
    "ped": (r"(?i)\bexcl\s*-?0?1\b", r"([0-9]{1,3})\s*months", 36, "months"),
    "specified": (r"(?i)\bexcl\s*-?0?2\b", r"([0-9]{1,3})\s*months", 24, "months"),
    "initial": (r"(?i)\bexcl\s*-?0?3\b", r"([0-9]{1,3})\s*days", None, "days"),
}


def waiting_periods(clauses: DataFrame, kinds: dict = WAITING_KINDS) -> DataFrame:
    """(policy, kind, clause_id, months, days): for each kind the shortest clause that carries its code and states a
    number, and that number: the preferred one if it is among them, else the first. One clause may state several kinds."""
    t = F.col("text")

    def stated(kind: str) -> Column:
        code, number, best, unit = kinds[kind]
        every = F.transform(F.regexp_extract_all("text", F.lit(number), F.lit(1)), lambda x: x.cast("int"))
        value = F.when(F.array_contains(every, best), best).otherwise(F.get(every, F.lit(0))) if best else F.get(every, F.lit(0))
        months, days = (value, F.lit(None)) if unit == "months" else (F.lit(None), value)
        return F.when(t.rlike(code) & value.isNotNull(), F.struct(F.lit(kind).alias("kind"), months.cast("int").alias("months"), days.cast("int").alias("days")))

    told = clauses.select("policy", "clause_id", F.length("text").alias("size"), F.explode(F.array_compact(F.array(*[stated(k) for k in kinds]))).alias("p"))
    order = F.struct("size", "clause_id")
    short = told.groupBy("policy", F.col("p.kind").alias("kind")).agg(F.min_by(F.struct("clause_id", "p.months", "p.days"), order).alias("b"))
    return short.select("policy", "kind", "b.clause_id", "b.months", "b.days")


def waiting_terms(periods: DataFrame, clauses: DataFrame) -> DataFrame:
    """One row for each policy of ``waiting_periods``, with the text of the clause on specified conditions, for ``assess_waiting``."""
    text = clauses.select(F.col("policy").alias("__p"), F.col("clause_id").alias("__c"), F.col("text").alias("specified_text"))
    told = periods.join(text.hint("merge"), F.expr("kind = 'specified' AND policy = __p AND clause_id = __c"), "left")
    pick = lambda kind, field: F.max(F.when(F.col("kind") == kind, F.col(field)))
    return told.groupBy("policy").agg(
        pick("specified", "clause_id").alias("specified_clause"), pick("specified", "months").alias("specified_months"), pick("specified", "specified_text").alias("specified_text"),
        pick("initial", "clause_id").alias("initial_clause"), pick("initial", "days").alias("initial_days"),
        pick("ped", "clause_id").alias("ped_clause"), pick("ped", "months").alias("ped_months"),
    )


def confirmed_condition(lines: DataFrame, clauses: DataFrame, pattern: str) -> DataFrame:
    """(bill_id, line_no, condition): the first line of a bill whose condition word stands in its policy's clause (policy, text)."""
    told = lines.withColumn("condition", F.regexp_extract("item", pattern, 1)).where("condition <> ''")
    # The texts are searched once for each policy and word, not once for each line.
    words = told.select("policy", "condition").distinct()
    held = words.join(clauses.hint("merge"), "policy").where(F.contains(F.lower("text"), F.col("condition"))).select("policy", "condition").distinct()
    first = told.join(held, ["policy", "condition"], "left_semi").groupBy("bill_id").agg(F.min_by(F.struct("line_no", "condition"), "line_no").alias("f"))
    return first.select("bill_id", "f.line_no", "f.condition")


def reject_expired_exclusion(verdicts: DataFrame, periods: DataFrame, served: DataFrame) -> DataFrame:
    """Verdicts in which a nil that cites a waiting clause is open again where the bill is not excluded."""
    cites = periods.select("policy", "clause_id").distinct().withColumn("waits", F.lit(True))
    joined = verdicts.join(F.broadcast(cites), ["policy", "clause_id"], "left").join(served, "bill_id", "left")
    expired = (F.col("allowed") == 0) & F.coalesce("waits", F.lit(False)) & ~F.coalesce("excluded", F.lit(False))
    return joined.withColumn("allowed", F.when(~F.coalesce(expired, F.lit(False)), F.col("allowed"))).drop("waits", "excluded")


def carve_out_quote(clauses: DataFrame, pattern: str, around: int = 120) -> DataFrame:
    """(policy, clause_id, quote): each policy's first clause with the wording, and what stands around it."""
    first = clauses.where(F.col("text").rlike(pattern)).groupBy("policy").agg(F.min_by(F.struct("clause_id", "text"), "clause_id").alias("f"))
    before = F.length(F.get(F.split("f.text", pattern, 2), F.lit(0)))
    start = F.greatest(before - around, F.lit(0))
    size = before - start + F.length(F.regexp_extract("f.text", pattern, 0)) + around
    return first.select("policy", F.col("f.clause_id").alias("clause_id"), F.substring("f.text", start + 1, size).alias("quote"))


def deduction_clause(clauses: DataFrame, pattern: str, definition: str) -> DataFrame:
    """(policy, clause_id): the first clause that states the rule, definitions last."""
    told = clauses.where(F.col("text").rlike(pattern))
    order = F.struct(F.col("text").rlike(definition).alias("d"), "clause_id")
    return told.groupBy("policy").agg(F.min(order).alias("b")).select("policy", F.col("b.clause_id").alias("clause_id"))


def assumptions(trace: DataFrame) -> DataFrame:
    """(run_id, name, n): facts taken on trust, from the records that hold one."""
    return trace.where("assumption IS NOT NULL").groupBy("run_id", F.col("assumption").alias("name")).agg(F.count(F.lit(1)).alias("n"))


def explain_ratio(lines: DataFrame, ratios: DataFrame) -> DataFrame:
    """(bill_id, accepted): a stated ratio (bill_id, limit_cents, charged) holds if the first room line gives it to 1e-4."""
    rooms = lines.where("per_day IS NOT NULL").groupBy("bill_id").agg(F.min_by(F.struct("per_day", "qty", "cents"), "line_no").alias("r"))
    joined = ratios.join(rooms, "bill_id", "left")
    stated, own = F.expr("CAST(limit_cents AS DECIMAL(38,12)) / charged"), F.expr("CAST(r.per_day * greatest(r.qty, 1) AS DECIMAL(38,12)) / r.cents")
    return joined.select("bill_id", F.coalesce(F.abs(stated - F.least(own, F.lit(1))) <= 0.0001, F.lit(False)).alias("accepted"))


def split_unnumbered_definitions(lines: DataFrame, first_clause: DataFrame, least: int = 10, short: int = 20) -> DataFrame:
    """(policy, clause_id, title): ``Term: text`` lines above the first numbered clause, as I.Def1 and so on.

    Only where a policy has ``least`` such lines; numbered after lines under ``short`` characters went.
    """
    head = lines.join(first_clause, "policy", "left").where("first IS NULL OR seq < first")
    terms = head.where(F.col("line").rlike(r"^[A-Z][^:]{2,60}: \S"))
    enough = terms.groupBy("policy").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("policy")
    kept = terms.join(enough, "policy", "left_semi").where(F.length("line") >= short)
    number = F.row_number().over(Window.partitionBy("policy").orderBy("seq"))
    return kept.select("policy", F.concat(F.lit("I.Def"), number).alias("clause_id"), F.substring_index("line", ": ", 1).alias("title"))


def parse_exclusion_pairs(rows: DataFrame) -> DataFrame:
    """(list, no, item) of (list, pos, no, item): names squeezed, the first of equal ones, longer than two letters; a missing
    number is the next free one above the entry before. A printed list has some hundred rows and is folded in order; there
    may be any number of lists."""
    named = rows.withColumn("item", F.trim(F.regexp_replace("item", r"\s+", " "))).where((F.length("item") > 2) & (F.lower("item") != "item"))
    told = named.select("list", F.lower("item").alias("k"), "pos", F.col("no").cast("int").alias("no"), "item")
    first = told.groupBy("list", "k").agg(F.min(F.struct("pos", "no", "item")).alias("e"))
    lists = first.groupBy("list").agg(F.array_sort(F.collect_list("e")).alias("es"))
    stated = F.filter(F.transform("es", lambda e: e["no"]), lambda n: n.isNotNull())
    none = F.array().cast("array<struct<no:int,item:string>>")
    start = F.struct(stated.alias("used"), F.lit(0).alias("before"), none.alias("out"))

    def add(state: Column, e: Column) -> Column:
        # Of the next size(used) + 1 numbers one at least is free.
        after = F.sequence(state["before"] + 1, state["before"] + 1 + F.size(state["used"]))
        no = F.coalesce(e["no"], F.array_except(after, state["used"])[0])
        used = F.array_append(state["used"], no)
        return F.struct(used.alias("used"), no.alias("before"), F.array_append(state["out"], F.struct(no.alias("no"), e["item"].alias("item"))).alias("out"))

    filled = lists.select("list", F.explode(F.aggregate("es", start, add, lambda state: state["out"])).alias("e"))
    return filled.select("list", "e.no", "e.item")


def damaged_table_cells(cells: DataFrame, least: int = 12) -> DataFrame:
    """(table_id, row, col): data cells that repeat a heading of over ``least`` characters of their table."""
    heads = cells.where((F.col("row") == 1) & (F.length("cell") > least)).select("table_id", F.col("cell").alias("head")).distinct()
    data = cells.where("row > 1")
    return data.join(heads, (data["table_id"] == heads["table_id"]) & (data["cell"] == heads["head"]), "left_semi").select("table_id", "row", "col")
