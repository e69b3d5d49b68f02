"""Text expressions that treat all Unicode white space alike."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Java's \s is ASCII only: add the ASCII separators, NEL and all Unicode separators.
_SPACE = "\\s\\x1c-\\x1f\\x85\\p{Z}"
WHITESPACE = f"[{_SPACE}]++"
# Largest length that a counted pattern tests; beyond, the text is normalised.
MAX_COUNTED = 200

# Upper bounds (exclusive) of the text length classes, in characters.
LENGTH_CLASSES = {"very_short": 100, "short": 500, "medium": 2000, "long": 5000}
LONGEST_CLASS = "very_long"


def normalize_space(text: Column) -> Column:
    """Collapse every run of white space to one space and strip the ends."""
    return F.trim(F.regexp_replace(text, WHITESPACE, " "))


def at_least(text: Column, length: int) -> Column:
    """True if the normalised text has at least ``length`` characters.

    A pattern that stops at the ``length``-th character of the raw text decides it,
    so a filter on the length need not normalise the text a second time. After the
    first character, a step is one more character or a run of white space that
    another character follows.
    """
    if length <= 0:
        return F.lit(True)
    if length > MAX_COUNTED:
        return F.coalesce(F.length(normalize_space(text)) >= length, F.lit(False))
    step = f"(?:[^{_SPACE}]|[{_SPACE}]++(?=[^{_SPACE}]))"
    return F.coalesce(text.rlike(f"[^{_SPACE}]{step}{{{length - 1}}}"), F.lit(False))


def word_count(text: Column) -> Column:
    """Words between white space.

    Each word with the white space around it becomes one mark, so the marks are
    counted by a length and no array is built per row. Text without a word has no
    mark. There is no branch, so that the pattern runs once per row.
    """
    marks = F.regexp_replace(text, f"[{_SPACE}]*+[^{_SPACE}]++[{_SPACE}]*+", "x")
    return F.length(marks) * F.startswith(marks, F.lit("x")).cast("int")


def length_class(length: Column) -> Column:
    """Name of the length class, NULL for a NULL length."""
    name = F.when(length.isNull(), F.lit(None).cast("string"))
    for label, bound in LENGTH_CLASSES.items():
        name = name.when(length < bound, F.lit(label))
    return name.otherwise(F.lit(LONGEST_CLASS))
