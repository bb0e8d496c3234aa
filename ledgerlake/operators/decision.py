"""Answer keys derived from a decision table: rules as data, compiled into one ordered expression.

A rule says which lines it takes (pattern, exception, policy, a fact about the bill), what
becomes of them (nil, a cap, so much a day, in proportion, in full, a person decides) and
which clause it cites. The first rule that takes a line decides it. Nothing of the audit
is read, so that a key made here can be held against it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.text import indian_grouping, parse_amount
from ledgerlake.operators.adjudicate import months_served, non_payable_longest
from ledgerlake.operators.rules import first_match

OUTCOMES = ("nil", "cap", "per_day", "ratio", "full", "human")
#: Facts a rule can ask for: see ``with_facts``.
FACTS = ("waiting", "listed", "unresolved", "limited", "breached")
#: What is billed by the day says so: an amount, how many days.
DAILY = r"(?i)([0-9,]+)\s*x\s*[0-9]+\s*day"


@dataclass(frozen=True)
class Rule:
    name: str
    outcome: str
    #: The clause as it is cited, or ``:room``, ``:ratio``, ``:waiting`` for that of the policy.
    clause: str | None = None
    pattern: str | None = None
    unless: str | None = None
    policy: str | None = None
    when: str | None = None
    #: The name of the cap in the table of caps.
    cap: str | None = None

    def __post_init__(self):
        if self.outcome not in OUTCOMES or self.when not in (None, *FACTS) or (self.outcome == "cap") != (self.cap is not None):
            raise ValueError(f"rule {self.name}: an outcome of {OUTCOMES}, a fact of {FACTS}, and a cap for the outcome cap only")


@dataclass(frozen=True)
class Table:
    rules: tuple[Rule, ...]
    #: Policy -> clauses (room, ratio, waiting) and the highest rank of room that is safe where no
    #: figure is stated; None where such a policy pays the actual rate.
    policies: dict[str, tuple[str, str, str, int | None]]
    #: (cap, policy, sum insured) -> cents. ``room`` is the room limit a day.
    caps: dict[tuple[str, str, int], int] = field(default_factory=dict)
    room: str = r"(?i)room rent"
    waiting: str = r"(?!)"
    waiting_months: int = 24
    ladder: tuple = ()


def with_facts(lines: DataFrame, bills: DataFrame, listed: DataFrame, table: Table) -> DataFrame:
    """Lines with what the rules ask for.

    lines (bill_id, line_no, item, cents, qty); bills (bill_id, policy, sum_insured, started,
    admitted, room_limit in cents a day or null). waiting: an item of the bill is on the
    specified list and the months were not served. listed: the longest entry of the list
    in the item. limited: the schedule, or else the table, states a room limit. breached: the
    first room line costs more a day than that. unresolved: no limit is stated, and the
    room taken is not safe. A bill without a room line, or with one of no days, is neither.
    A policy that the table does not know has no clauses and pays the actual rate.
    """
    spark = lines.sparkSession
    # The table is written by hand: one row for each policy, one map of caps for each policy and sum insured.
    known = [(p, *facts) for p, facts in sorted(table.policies.items())]
    known = spark.createDataFrame(known, "policy string, c_room string, c_ratio string, c_waiting string, safe int")
    maps: dict[tuple[str, int], dict[str, int]] = {}
    for (cap, policy, insured), cents in table.caps.items():
        maps.setdefault((policy, insured), {})[cap] = cents
    caps = spark.createDataFrame([(*key, value) for key, value in sorted(maps.items())], "policy string, sum_insured bigint, caps map<string,bigint>")

    is_room = F.col("item").rlike(table.room)
    of_bill = lines.groupBy("bill_id").agg(
        F.max(F.col("item").rlike(table.waiting)).alias("waits"), F.min_by(F.struct("item", "cents", "qty"), F.when(is_room, F.col("line_no"))).alias("room")
    )
    told = bills.join(F.broadcast(known), "policy", "left").join(F.broadcast(caps), ["policy", "sum_insured"], "left").join(of_bill, "bill_id")
    limit = F.coalesce("room_limit", F.element_at("caps", F.lit("room")))
    daily = parse_amount(F.nullif(F.regexp_extract("room.item", DAILY, 1), F.lit("")))
    # The rate as a fraction: by the text, else what the line costs over its days.
    den = F.coalesce(daily, F.col("room.cents"))
    num = limit * F.when(daily.isNotNull(), 1).otherwise(F.col("room.qty"))
    rated = F.coalesce((den > 0) & (daily.isNotNull() | (F.col("room.qty") > 0)), F.lit(False))
    rank = first_match(F.col("room.item"), table.ladder).cast("int") if table.ladder else F.lit(None).cast("int")
    unsafe = F.col("safe").isNotNull() & F.coalesce(rank > F.col("safe"), F.lit(True))
    facts = told.select(
        "bill_id", "policy", "c_room", "c_ratio", "c_waiting", "caps", limit.alias("limit"), num.alias("num"), den.alias("den"),
        F.coalesce(F.col("waits") & (months_served("started", "admitted") < table.waiting_months), F.lit(False)).alias("f_waiting"),
        limit.isNotNull().alias("f_limited"), (rated & F.coalesce(num < den, F.lit(False))).alias("f_breached"), (rated & limit.isNull() & unsafe).alias("f_unresolved"),
    )
    own = lines.select("bill_id", "line_no", "item", "cents", "qty")
    return non_payable_longest(own, listed).withColumn("f_listed", F.col("list_no").isNotNull()).join(facts, "bill_id")


def compiled(rules: tuple[Rule, ...]) -> Column:
    """The first rule that takes a line, as (name, outcome, clause, cap): one CASE in the order of the rules."""
    case = None
    for rule in rules:
        takes = F.lit(True)
        for pattern, wanted in ((rule.pattern, True), (rule.unless, False)):
            if pattern is not None:
                hit = F.coalesce(F.col("item").rlike(pattern), F.lit(False))
                takes = takes & (hit if wanted else ~hit)
        if rule.policy is not None:
            takes = takes & (F.col("policy") == rule.policy)
        if rule.when is not None:
            takes = takes & F.col(f"f_{rule.when}")
        clause = F.col("c_" + rule.clause[1:]) if rule.clause and rule.clause.startswith(":") else F.lit(rule.clause).cast("string")
        cap = F.element_at("caps", F.lit(rule.cap)) if rule.cap else F.lit(None).cast("bigint")
        told = F.struct(F.lit(rule.name).alias("name"), F.lit(rule.outcome).alias("outcome"), clause.alias("clause"), cap.alias("cap"))
        case = F.when(takes, told) if case is None else case.when(takes, told)
    return case


def rupees(cents: Column) -> Column:
    """120000000 -> 12,00,000; paise only where there are some."""
    paise = F.pmod(cents, F.lit(100))
    return F.concat(indian_grouping(((cents - paise) / 100).cast("bigint")), F.when(paise > 0, F.concat(F.lit("."), F.lpad(paise.cast("string"), 2, "0"))).otherwise(""))


def derive_key(lines: DataFrame, bills: DataFrame, listed: DataFrame, table: Table) -> DataFrame:
    """(bill_id, line_no, rule, expected, clause_id, needs_human, why): what each line should get, by the first rule that takes it.

    A null amount is for a person to decide: by the rule, where a rule asks for a cap or a
    limit a day that the table does not state, or where no rule takes the line (null rule).
    Amounts are whole cents, half up.
    """
    ruled = with_facts(lines, bills, listed, table).withColumn("r", compiled(table.rules))
    outcome = F.col("r.outcome")
    scaled = F.expr("CAST((2 * CAST(cents AS DECIMAL(20,0)) * num + den) DIV (2 * CAST(den AS DECIMAL(20,0))) AS BIGINT)")
    least = lambda c: F.when(c.isNotNull(), F.least(F.col("cents"), c))
    expected = (
        F.when(outcome == "nil", F.lit(0).cast("bigint"))
        .when(outcome == "cap", least(F.col("r.cap")))
        .when(outcome == "per_day", least(F.col("limit") * F.coalesce("qty", F.lit(1))))
        .when(outcome == "ratio", F.when(F.col("f_breached"), scaled))
        .when(outcome == "full", F.col("cents"))
    )
    done = ruled.withColumn("expected", expected)
    charged, got = rupees(F.col("cents")), rupees(F.col("expected"))
    why = (
        F.when(F.col("expected").isNull(), "no figure can be derived")
        .when(outcome == "nil", "nil")
        .when(outcome == "cap", F.concat(F.lit("min("), charged, F.lit(", "), rupees(F.col("r.cap")), F.lit(") = "), got))
        .when(outcome == "per_day", F.concat(F.lit("min("), charged, F.lit(", "), rupees(F.col("limit")), F.lit(" x "), F.coalesce("qty", F.lit(1)).cast("string"), F.lit(") = "), got))
        .when(outcome == "ratio", F.concat(charged, F.lit(" x "), rupees(F.col("num")), F.lit("/"), rupees(F.col("den")), F.lit(" = "), got))
        .otherwise("paid in full")
    )
    return done.select(
        "bill_id", "line_no", F.col("r.name").alias("rule"), "expected", F.col("r.clause").alias("clause_id"), F.col("expected").isNull().alias("needs_human"),
        F.concat_ws(": ", F.col("r.clause"), why).alias("why"),
    )
