"""Standardise text, dates, identifiers, numbers and topic weights.

Everything but the category fill is row-wise, so a clean-up is one narrow pass
that Spark fuses with whatever reads it. The category fill needs the most common
value, which is a small aggregate read back as a scalar subquery.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from rostrum.functions import parsing, text as tx, topics as tf
from rostrum.schema import (
    CATEGORY_COLUMNS,
    FIRST_CONGRESS,
    ID_COLUMNS,
    LAST_CONGRESS,
    MIN_TEXT_LENGTH,
    TEXT_COLUMNS,
    topic_columns,
)

DATE_PARTS = ("year", "month", "day_of_year", "decade")
UNKNOWN = "unknown"


def _present(df: DataFrame, names: tuple[str, ...]) -> list[str]:
    return [c for c in names if c in df.columns]


def _replaced(df: DataFrame, formulas: Mapping[str, str]) -> DataFrame:
    """Replace columns by SQL expressions, in one projection."""
    if not formulas:
        return df
    return df.selectExpr(*[f"{formulas.get(c, f'`{c}`')} AS `{c}`" for c in df.columns])


def standardize_text(df: DataFrame) -> DataFrame:
    """Missing text to '', any run of white space to one space."""
    return df.withColumns(
        {
            c: tx.normalize_space(F.coalesce(F.col(c).cast("string"), F.lit("")))
            for c in _present(df, TEXT_COLUMNS)
        }
    )


def drop_short_text(df: DataFrame, min_length: int = MIN_TEXT_LENGTH) -> DataFrame:
    """Keep documents whose standardised text has ``min_length`` characters.

    Works on raw and on standardised text alike; use it before standardising, so
    that dropped documents cost nothing more.
    """
    return df.filter(tx.at_least(F.col("text"), min_length)) if "text" in df.columns else df


def standardize_dates(df: DataFrame) -> DataFrame:
    """Parse ``date`` and add year, month, day of year and decade (NULL where bad)."""
    if "date" not in df.columns:
        return df
    return df.withColumn("date", parsing.date_column(df)).withColumns(
        {
            "year": parsing.year_of(F.col("date")),
            "month": F.month("date"),
            "day_of_year": F.dayofyear("date"),
            "decade": parsing.decade_of(F.col("date")),
        }
    )


def category_modes(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    """Most common value per column, the smallest on ties, from one scalar subquery.

    Counting by value first combines on the map side and keeps a column with
    many values out of a single aggregation buffer.
    """
    if not columns:
        return {}
    values = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    counts = (
        values.unpivot([], columns, "column", "value")
        .groupBy("column", "value")
        .agg(F.count("value").alias("n"))
        .filter(F.col("n") > 0)
    )
    most_common = "min_by(value, struct(-n, value)) FILTER (WHERE column = '{c}') AS `{c}`"
    modes = counts.agg(*[F.expr(most_common.format(c=c)) for c in columns])
    found = modes.select(F.struct(*columns)).scalar()
    return {c: found[c] for c in columns}


def fill_categories(df: DataFrame, modes: Mapping[str, str | Column] | None = None) -> DataFrame:
    """Missing categories to the most common value, else to 'unknown'.

    On a stream the modes must be given, as a stream has no final counts.
    """
    columns = _present(df, CATEGORY_COLUMNS)
    if modes is None:
        if df.isStreaming:
            raise ValueError("give the modes when cleaning a stream")
        modes = category_modes(df, columns)
    fills = {
        c: m if isinstance(m, Column) else F.lit(m).cast("string") for c, m in modes.items()
    }
    return df.withColumns(
        {c: F.coalesce(F.col(c), fills.get(c, F.lit(None)), F.lit(UNKNOWN)) for c in columns}
    )


def fill_ids(df: DataFrame) -> DataFrame:
    """Identifiers to text, missing ones (also the text 'nan') to ''."""
    def filled(c: str) -> Column:
        value = F.col(c).cast("string")
        return F.when(value.isNull() | (value == "nan"), F.lit("")).otherwise(value)

    return df.withColumns({c: filled(c) for c in _present(df, ID_COLUMNS)})


def fill_weights(df: DataFrame) -> DataFrame:
    cols = topic_columns(df)
    return _replaced(df, {c: f"coalesce(`{c}`, 0.0D)" for c in cols})


def fill_missing(df: DataFrame, modes: Mapping[str, str | Column] | None = None) -> DataFrame:
    """Categories, identifiers and topic weights."""
    return fill_weights(fill_ids(fill_categories(df, modes)))


def clean_numbers(df: DataFrame) -> DataFrame:
    """Congress to number, training flag to 0/1 integer, weights clipped to [0, 1]."""
    changes = {}
    if "congno" in df.columns:
        if not isinstance(df.schema["congno"].dataType, T.IntegralType):
            changes["congno"] = parsing.number_column(df, "congno")
    if "training_set" in df.columns:
        flag = parsing.number_column(df, "training_set")
        changes["training_set"] = F.coalesce(flag.try_cast("int"), F.lit(0))
    numbers = df.withColumns(changes) if changes else df
    # NULL stays NULL, while ``least`` alone would turn it into 1.
    clip = "CASE WHEN `{c}` < 0 THEN 0.0D WHEN `{c}` > 1 THEN 1.0D ELSE `{c}` END"
    return _replaced(numbers, {c: clip.format(c=c) for c in topic_columns(df)})


def clean(
    df: DataFrame,
    fix_dates: bool = True,
    standardize: bool = True,
    handle_missing: bool = True,
    min_length: int = MIN_TEXT_LENGTH,
    modes: Mapping[str, str | Column] | None = None,
) -> DataFrame:
    """Text, dates, missing values, numbers, in that order.

    Feature columns keep the values they had before, see ``refresh_features``.
    """
    if standardize:
        df = standardize_text(drop_short_text(df, min_length))
    if fix_dates:
        df = standardize_dates(df)
    if handle_missing:
        df = fill_missing(df, modes)
    return clean_numbers(df)


def clean_observed(df: DataFrame, **options) -> tuple[DataFrame, Observation, Observation]:
    """:func:`clean` with row counts before and after, taken while the data flows.

    The observations are filled by the first action on the result.
    """
    before, after = Observation(), Observation()
    counted = df.observe(before, F.count(F.lit(1)).alias("original_size"))
    cleaned = clean(counted, **options)
    return cleaned.observe(after, F.count(F.lit(1)).alias("final_size")), before, after


def cleaning_report(df: DataFrame, min_length: int = MIN_TEXT_LENGTH) -> DataFrame:
    """What a clean-up of ``df`` does, as ``(metric, value)``, in one scan.

    Counts: rows before, after and removed; invalid dates, congress numbers and
    weights per topic among the kept rows; empty texts and documents without any
    weight after the clean-up.
    """
    cols = topic_columns(df)
    staged = df
    if "date" in df.columns:
        staged = staged.withColumn("date", parsing.date_column(df))
    if "congno" in df.columns:
        staged = staged.withColumn("congno", parsing.number_column(df, "congno"))
    keep = tx.at_least(F.col("text"), min_length) if "text" in df.columns else F.lit(True)
    staged = staged.withColumn("__keep", keep)
    kept = F.col("__keep")
    metrics = {
        "original_size": F.count("*"),
        "final_size": F.count_if(kept),
        "removed": F.count_if(~kept),
    }
    if "date" in df.columns:
        metrics["invalid_dates"] = F.count_if(kept & F.col("date").isNull())
    if "congno" in df.columns:
        metrics["invalid_congress"] = F.count_if(
            kept & ~F.col("congno").between(FIRST_CONGRESS, LAST_CONGRESS)
        )
    if "text" in df.columns:
        metrics["empty_text_documents"] = F.count_if(kept & ~tx.at_least(F.col("text"), 1))
    if cols:
        staged = staged.withColumn("__total", tf.clipped_sum(cols))
        metrics["zero_weight_documents"] = F.count_if(kept & (F.col("__total") == 0))
        for c in cols:
            metrics[f"clipped_{c}"] = F.expr(f"count_if(__keep AND (`{c}` < 0 OR `{c}` > 1))")
    row = staged.agg(*[value.alias(name) for name, value in metrics.items()])
    return row.unpivot([], list(metrics), "metric", "value")
