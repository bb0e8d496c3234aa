"""Column functions on text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "[REDACTED]"

# Labels of lines that name a person or a case.
LABELS = (
    r"patient(?:'s)?\s*name", "patient", r"insured(?:\s*name)?", "name", "uhid", "mrn", r"ip\s*no\.?", r"policy\s*no\.?", r"member\s*id", r"claim\s*no\.?",
)
# Identifiers to mask, in order: labelled lines (label kept), long numbers, phones, mail addresses.
MASKS = (
    (rf"(?i)((?:^|\n)[ \t]*(?:{'|'.join(LABELS)})[ \t]*[:\-][ \t]*)[^\n]+", "$1" + REDACTED),
    (r"\b[0-9]{4}\s?[0-9]{4}\s?[0-9]{4}(?:[0-9]{4})?\b", REDACTED),
    (r"\b(?:\+?91[-\s]?)?[6-9][0-9]{9}\b", REDACTED),
    (r"\+?[0-9]{0,2} ?\(?[0-9]{3}\)?[ -][0-9]{3}-[0-9]{4}", REDACTED),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", REDACTED),
)


def mask(column: Column, masks: tuple = MASKS) -> Column:
    """All masks, one after the other, as one expression."""
    return reduce(lambda c, m: F.regexp_replace(c, m[0], m[1]), masks, column)


def has_identifier(column: Column, masks: tuple = MASKS[1:]) -> Column:
    """Whether a number, phone or address is left; labelled fields are not looked at."""
    return reduce(lambda a, b: a | b, [column.rlike(pattern) for pattern, _ in masks])


def normalise_item(column: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(column, r"[ \t\n\r]+", " ")))


def search_key(column: Column) -> Column:
    """Lower case; every other character than a to z and the space becomes a space."""
    return F.regexp_replace(F.lower(column), "[^a-z ]", " ")


def normalise_quote(column: Column) -> Column:
    """Plain quotes and dashes, single spaces, lower case, no spaces around slashes."""
    plain = F.translate(column, "‘’“”–—", "''\"\"--")
    squeezed = F.lower(F.trim(F.regexp_replace(plain, r"[ \t\n\r]+", " ")))
    return F.regexp_replace(squeezed, " ?/ ?", "/")


def indian_grouping(column: Column) -> Column:
    """1234567 -> 12,34,567."""
    return F.regexp_replace(column.cast("string"), r"(\d)(?=(\d\d)+\d$)", "$1,")


def parse_amount(column: Column) -> Column:
    """'1,20,000.50' -> cents; null where it is no amount."""
    return (F.regexp_replace(column, ",", "").try_cast("decimal(18,2)") * 100).cast("bigint")
