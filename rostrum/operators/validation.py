"""Scored validation: four categories of rules as one tidy report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rostrum.functions import parsing, topics as tf
from rostrum.schema import FIRST_CONGRESS, LAST_CONGRESS, topic_columns

STRUCTURE, CONTENT, TOPICS, CONSISTENCY = "basic", "content", "topic", "consistency"
CATEGORIES = (STRUCTURE, CONTENT, TOPICS, CONSISTENCY)

# Required columns and the tolerated share of very short texts.
REQUIRED_COLUMNS = ("text",)
SHORT_TEXT = 10
SHORT_SHARE = 0.05


def _row_identity(df: DataFrame) -> list[Column]:
    """128 bits that identify a row: two hashes of all columns from different seeds.

    The hash skips NULLs, so a mask tells which columns are NULL. Chance equality
    among 10^10 rows has a probability below 10^-18.
    """
    columns = ", ".join(f"`{c}`" for c in df.columns)
    mask = ", ".join(f"if(`{c}` IS NULL, '1', '0')" for c in df.columns)
    return [F.expr(f"xxhash64({s}, concat({mask}), {columns}) AS __id{s}") for s in (1, 2)]


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: total rows, and rows beyond the first of their kind.

    Only 16 bytes and a count per distinct row are shuffled, not the row; copies
    combine before the shuffle.
    """
    counts = df.groupBy(*_row_identity(df)).agg(F.count("*").alias("n"))
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


Rule = tuple[str, str, str, str, str]


def _rules(df: DataFrame) -> tuple[DataFrame, list[Rule]]:
    """Staged rows, and per rule its category, name, column, the SQL aggregate that
    counts violations and the one that gives the tolerated number."""
    cols = topic_columns(df)
    staged: list[Column] = [F.col(c) for c in cols]
    rules: list[Rule] = []
    if "text" in df.columns:
        staged.append(F.length("text").alias("__length"))
        short = f"count_if(__length < {SHORT_TEXT})"
        rules += [
            (CONTENT, "empty_text", "text", "count_if(__length = 0)", "0"),
            (CONTENT, "very_short_text", "text", short, f"count(*) * {SHORT_SHARE}D"),
        ]
    for c in cols:
        rules += [
            (TOPICS, "out_of_range", c, f"count_if(`{c}` < 0 OR `{c}` > 1)", "0"),
            (TOPICS, "missing_weight", c, f"count_if(`{c}` IS NULL)", "0"),
        ]
    if cols:
        staged.append(tf.weight_sum(cols).alias("__total"))
        rules.append((TOPICS, "all_zero_weights", "", "count_if(__total = 0)", "0"))
    if "congno" in df.columns:
        staged.append(parsing.number_column(df, "congno").alias("__congno"))
        outside = f"count_if(__congno NOT BETWEEN {FIRST_CONGRESS} AND {LAST_CONGRESS})"
        rules.append((CONSISTENCY, "congress_out_of_range", "congno", outside, "0"))
    if "date" in df.columns:
        staged.append(parsing.date_column(df).alias("__date"))
        rules.append((CONSISTENCY, "invalid_date", "date", "count_if(__date IS NULL)", "0"))
    if "training_set" in df.columns:
        staged.append(parsing.number_column(df, "training_set").alias("__flag"))
        # A missing flag is invalid; without the coalesce it would be neither.
        invalid = "count_if(NOT coalesce(__flag IN (0, 1), false))"
        rules.append((CONSISTENCY, "invalid_flag", "training_set", invalid, "0"))
    return df.select(*staged), rules


def _report(row: DataFrame, entries: list[tuple[str, str, str, str, str]]) -> DataFrame:
    """One row per entry ``(category, rule, column, violations, passed)`` in SQL."""
    structs = ", ".join(
        f"struct('{category}' AS category, '{rule}' AS rule, '{column}' AS column, "
        f"CAST({violations} AS BIGINT) AS violations, {passed} AS passed)"
        for category, rule, column, violations, passed in entries
    )
    return row.selectExpr(f"inline(array({structs}))")


def validation_report(df: DataFrame) -> DataFrame:
    """``(category, rule, column, violations, passed)`` for every rule.

    Content, topic and consistency rules are aggregates of one scan; the
    structure rules need the shuffle of the row hashes.
    """
    missing = {c: int(c not in df.columns) for c in REQUIRED_COLUMNS}
    structure = _report(
        duplicate_rows(df),
        [
            (STRUCTURE, "empty_table", "", "int(total_rows = 0)", "total_rows > 0"),
            *[(STRUCTURE, "missing_column", c, str(n), f"{n} = 0") for c, n in missing.items()],
            (STRUCTURE, "duplicate_rows", "", "duplicate_rows", "duplicate_rows = 0"),
        ],
    )
    staged, rules = _rules(df)
    if not rules:
        return structure
    row = staged.agg(
        *[F.expr(f"{violations} AS v{i}") for i, (*_, violations, _) in enumerate(rules)],
        *[F.expr(f"{limit} AS t{i}") for i, (*_, limit) in enumerate(rules) if limit != "0"],
    )
    entries = [
        (category, rule, column, f"v{i}", f"v{i} <= {'0' if limit == '0' else f't{i}'}")
        for i, (category, rule, column, _, limit) in enumerate(rules)
    ]
    return structure.unionByName(_report(row, entries))


def category_results(report: DataFrame) -> DataFrame:
    """``(category, issues, passed)``; a category without rules passes."""
    spark = report.sparkSession
    everything = spark.createDataFrame([(c,) for c in CATEGORIES], "category string")
    failed = report.groupBy("category").agg(F.count_if(~F.col("passed")).alias("issues"))
    return everything.join(F.broadcast(failed), "category", "left").select(
        "category",
        F.coalesce("issues", F.lit(0)).alias("issues"),
        (F.coalesce("issues", F.lit(0)) == 0).alias("passed"),
    )


def validation_score(report: DataFrame) -> DataFrame:
    """One row: passed categories, categories and the score from 0 to 100."""
    return category_results(report).agg(
        F.count_if("passed").alias("passed_categories"),
        F.count("*").alias("categories"),
        (F.count_if("passed") / F.count("*") * 100).alias("score"),
    )
