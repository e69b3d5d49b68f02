"""Per-document topic expressions over the wide weight columns.

Expressions over all topics are written as SQL text: one call builds them, where
the same expression from single Columns takes some hundred round trips to the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from rostrum.schema import ACTIVE_WEIGHT, TOPIC_PREFIX

# Fixed value: keeps the logarithm and the division defined at zero.
EPSILON = "1e-10D"


def _all(template: str, cols: Sequence[str], separator: str = ", ") -> str:
    return separator.join(template.format(c=f"`{c}`", name=c) for c in cols)


def max_weight(cols: Sequence[str]) -> Column:
    """Row maximum; missing weights are skipped."""
    return F.expr(f"array_max(array({_all('{c}', cols)}))")


def dominant_topic(cols: Sequence[str], row_max: str) -> Column:
    """First column that equals the row maximum; NULL when all are missing.

    A position in an array keeps the expression small: it grows with the number
    of topics, not with its square, when a filter on it is pushed down.
    """
    values, names = _all("{c}", cols), _all("'{name}'", cols)
    position = f"CAST(array_position(array({values}), `{row_max}`) AS INT)"
    return F.expr(f"get(array({names}), {position} - 1)")


def weight_sum(cols: Sequence[str]) -> Column:
    """Row sum that skips missing weights."""
    return F.expr(_all("coalesce({c}, 0.0D)", cols, " + "))


def clipped_sum(cols: Sequence[str]) -> Column:
    """Row sum after missing weights are set to 0 and all are clipped to [0, 1]."""
    clipped = _all("greatest(0.0D, least(1.0D, coalesce({c}, 0.0D)))", cols, " + ")
    return F.expr(clipped)


def strict_weight_sum(cols: Sequence[str]) -> Column:
    """Row sum that is NULL as soon as one weight is missing."""
    return F.expr(_all("{c}", cols, " + "))


def entropy(cols: Sequence[str], strict_sum: str) -> Column:
    """Natural-log entropy of the normalised weights; NULL if one is missing."""
    share = f"{{c}} / (`{strict_sum}` + {EPSILON})"
    return F.expr(f"-({_all(f'({share}) * ln({share} + {EPSILON})', cols, ' + ')})")


def active_count(cols: Sequence[str], threshold: float = ACTIVE_WEIGHT) -> Column:
    """Number of weights above the threshold; missing weights do not count."""
    return F.expr(_all(f"(CASE WHEN {{c}} > {threshold!r}D THEN 1 ELSE 0 END)", cols, " + "))


def top_k(cols: Sequence[str], k: int) -> Column:
    """The k largest positive weights as ``array<struct<topic, weight>>``.

    Sorting (-weight, position) structs needs no comparator lambda and breaks
    ties by column order.
    """
    entries = ", ".join(
        f"struct(-`{c}` AS neg, {i} AS pos, '{c}' AS topic)" for i, c in enumerate(cols)
    )
    ranked = F.slice(F.sort_array(F.expr(f"filter(array({entries}), e -> e.neg < 0)")), 1, k)
    return F.transform(
        ranked, lambda e: F.struct(e["topic"].alias("topic"), (-e["neg"]).alias("weight"))
    )


def display_name(topic: Column) -> Column:
    """``tw_civil_rights`` -> ``Civil Rights``."""
    bare = F.regexp_replace(topic, f"^{TOPIC_PREFIX}", "")
    return F.initcap(F.replace(bare, F.lit("_"), F.lit(" ")))
