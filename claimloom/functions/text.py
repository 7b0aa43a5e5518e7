"""Text predicates and normal forms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ways in which the data write that a value is missing, in lower case.
STAND_INS = [
    "-", "--", "---", "?", "??", "???", ".", "...", "n/a", "n.a.", "n.a", "na", "nan", "nil", "none", "null", "nul", "unknown", "tbd", "tba", "undefined", "missing", "not available", "not applicable", "not specified", "empty", "<none>", "<null>", "#n/a",
]


# The characters with the property White_Space.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def stripped(c: Column) -> Column:
    """The string without white space at its ends."""
    return F.btrim(c, F.lit(WHITE))


def is_blank(c: Column) -> Column:
    """True if the string is empty or only white space (Unicode white space included)."""
    return stripped(c) == ""


def present(c: Column) -> Column:
    """True if the string is neither null nor blank."""
    return c.isNotNull() & ~is_blank(c)


def has_value(c: Column) -> Column:
    """True if the string is neither null nor blank nor a stand-in for a missing value."""
    return c.isNotNull() & ~F.lower(stripped(c)).isin("", *STAND_INS)


def letters_digits(c: Column) -> Column:
    """Letters and digits of the string in order, without regard to case.

    Final sigma counts as sigma and sharp s as two s.
    """
    folded = F.replace(F.translate(F.lower(F.upper(c)), "ς", "σ"), F.lit("ß"), F.lit("ss"))
    return F.regexp_replace(folded, r"[^\p{L}\p{Nd}]+", "")
