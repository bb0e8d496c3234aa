"""Rule packs: patterns, ladders and caps as data, and the expressions made of them.

The packs here fit the words of the driver's tables (``gear`` stands for a room,
``widget`` and ``ring`` for charges that follow the room, ``gizmo`` for those that do
not, ``anvil`` for an entry of the non-payable list). Another vocabulary is another
pack.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pack:
    room: str = r"\bgear\b"
    included: str = r"\b(widget|ring)\b"
    excluded: str = r"\b(gear|gizmo)\b"
    accident: str = r"\bblack\b"
    exclusion: str = r"(?i)\b(worthless|not covered|excluded)\b"
    defers: str = r"(?i)\bschedule\b"
    default: str = r"(?i)\bdefault\b"
    #: (pattern, route), first match wins.
    routes: tuple = ((r"\bgear\b", "room_rent"), (r"\bbolt\b", "copay"), (r"\brod\b", "waiting_period"), (r"\bplate\b", "sub_limit"))
    #: (pattern, rank) from the plainest room up.
    ladder: tuple = ((r"\bsmall\b", 1), (r"\bred\b", 2), (r"\bblue\b", 3), (r"\blarge\b", 4), (r"\bgreen\b", 5))
    #: Non-payable list in its order: (no, name as printed).
    not_payable: tuple = ((1, "anvil (any)"), (2, "small anvil / tool"), (3, "red ring - spare"), (4, "bolt"), (5, "xyz"))
    #: Entries that the policies name as a benefit: they never decide a line.
    overridden: str = r"^bolt$"
    #: Policy -> per-day room cap in hundredths of a per cent of the sum insured.
    caps: dict = field(default_factory=lambda: {"AFRICA": 100, "AMERICA": 150, "ASIA": 50, "EUROPE": 200, "MIDDLE EAST": 75})
    #: Policy -> the clause that states the proportionate deduction; a policy without one makes none.
    deductions: dict = field(default_factory=lambda: {"AFRICA": "II.4", "AMERICA": "B.2", "ASIA": "C.7", "EUROPE": "II.9"})
    #: Words that may name a condition of the specified list; a policy's own clause has to confirm them.
    conditions: tuple = ("rod", "anvil")
    #: Policy -> the words of its clause on specified conditions.
    specified: dict = field(default_factory=lambda: {"AFRICA": "rod", "AMERICA": "rod, ring", "ASIA": "a rod", "EUROPE": "Rod", "MIDDLE EAST": "bolt"})
    #: Kind -> months or days to be served.
    initial_days: int = 30
    specified_months: int = 24
    preexisting_months: int = 36


PACK = Pack()


def first_match(column: Column, rules: tuple, otherwise=None) -> Column:
    """The value of the first pattern that the column matches: one CASE for the whole pack."""
    case = None
    for pattern, value in rules:
        hit = column.rlike(pattern)
        case = F.when(hit, F.lit(value)) if case is None else case.when(hit, F.lit(value))
    return case.otherwise(F.lit(otherwise))


def not_payable_list(spark: SparkSession, pack: Pack = PACK) -> DataFrame:
    return spark.createDataFrame(list(pack.not_payable), "no int, name string")


def deduction_clauses(spark: SparkSession, pack: Pack = PACK) -> DataFrame:
    return spark.createDataFrame(sorted(pack.deductions.items()), "policy string, clause_id string")


def waiting_terms(spark: SparkSession, pack: Pack = PACK) -> DataFrame:
    """One row for each policy, as ``clause_rules.waiting_terms`` reads it from clauses."""
    rows = [(p, "W.2", pack.specified_months, words, "W.3", pack.initial_days, "W.1", pack.preexisting_months) for p, words in sorted(pack.specified.items())]
    names = "specified_clause string, specified_months int, specified_text string, initial_clause string, initial_days int, ped_clause string, ped_months int"
    return spark.createDataFrame(rows, "policy string, " + names)


def room_caps(spark: SparkSession, pack: Pack = PACK) -> DataFrame:
    return spark.createDataFrame(sorted(pack.caps.items()), "policy string, cap_rate int")
