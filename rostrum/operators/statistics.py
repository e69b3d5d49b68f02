"""Statistics as tidy DataFrames: one function per family.

Global metrics are ``(metric, value)`` rows. Each family names its aggregates in a
dictionary, so :func:`corpus_metrics` can put all of them into a single scan.
Missing values are skipped throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rostrum.functions import parsing, text as tx, topics as tf
from rostrum.operators.features import long_weights
from rostrum.operators.quantiles import (
    approximate_quantiles,
    counted_quantile,
    exact_quantiles,
    wide_quantiles,
    with_ranks,
)
from rostrum.schema import ACTIVE_WEIGHT, HIGH_WEIGHT, topic_columns

# Bounds of the diversity and weight-sum classes.
LOW_ENTROPY, HIGH_ENTROPY = 1.0, 2.0
MANY_TOPICS = 3
HIGH_WEIGHT_SUM = 1.1
SHORT_TEXT = 10
ENTROPY_PERCENTILES = {0.1: "p10", 0.25: "p25", 0.5: "p50", 0.75: "p75", 0.9: "p90"}
LENGTH_PERCENTILES = {0.1: "p10", 0.25: "p25", 0.75: "p75", 0.9: "p90"}

Metrics = dict[str, Column]


def _tall(df: DataFrame, metrics: Metrics) -> DataFrame:
    row = df.agg(*[value.cast("double").alias(name) for name, value in metrics.items()])
    return row.unpivot([], list(metrics), "metric", "value")


def _quantiles(df, value, names, group=None, exact=True) -> DataFrame:
    function = exact_quantiles if exact else approximate_quantiles
    return wide_quantiles(function(df, value, list(names), group), names, group)


# ---- topics -----------------------------------------------------------------


def topic_summary(df: DataFrame, quantiles: bool = True, exact: bool = True) -> DataFrame:
    """One row per topic: moments, range, counts by weight and quartiles."""
    weight = F.col("weight")
    long = long_weights(df)
    summary = long.groupBy("topic").agg(
        F.avg(weight).alias("mean"),
        F.stddev_samp(weight).alias("std"),
        F.min(weight).alias("min"),
        F.max(weight).alias("max"),
        F.count_if(weight > 0).alias("positive_documents"),
        F.count_if(weight > ACTIVE_WEIGHT).alias("active_documents"),
        F.count_if(weight > HIGH_WEIGHT).alias("high_weight_documents"),
        F.count_if(weight == 0).alias("zero_weight_documents"),
    )
    if not quantiles:
        return summary
    quartiles = _quantiles(
        long, "weight", {0.25: "q25", 0.5: "median", 0.75: "q75"}, "topic", exact
    )
    return summary.join(quartiles, "topic", "left")


def dominant_distribution(df: DataFrame, k: int = 15) -> DataFrame:
    """The k most frequent dominant topics; ties in name order."""
    # Counting non-missing values leaves 0 for the NULL group, so it can be dropped
    # afterwards; a filter on the topic itself would compute it twice per row.
    counts = df.groupBy("dominant_topic").agg(F.count("dominant_topic").alias("documents"))
    counts = counts.filter(F.col("documents") > 0)
    top = counts.orderBy(F.desc("documents"), "dominant_topic").limit(k)
    return top.select(
        "dominant_topic", tf.display_name(F.col("dominant_topic")).alias("display_name"), "documents"
    )


def _diversity_metrics() -> Metrics:
    entropy = F.col("topic_entropy")
    return {
        "mean_entropy": F.avg(entropy),
        "std_entropy": F.stddev_samp(entropy),
        "low_diversity_docs": F.count_if(entropy < LOW_ENTROPY),
        "high_diversity_docs": F.count_if(entropy > HIGH_ENTROPY),
    }


def topic_diversity(df: DataFrame, exact: bool = True) -> DataFrame:
    """Entropy: mean, deviation, narrow and broad documents, percentiles."""
    probabilities = list(ENTROPY_PERCENTILES)
    function = exact_quantiles if exact else approximate_quantiles
    quantiles = function(df, "topic_entropy", probabilities)
    names = F.when(F.lit(False), F.lit(""))
    for p, name in ENTROPY_PERCENTILES.items():
        names = names.when(F.col("p") == p, F.lit(name))
    return _tall(df, _diversity_metrics()).unionByName(
        quantiles.select(names.alias("metric"), F.col("quantile").alias("value"))
    )


def _active_metrics() -> Metrics:
    active = F.col("active_topic_count")
    return {
        "mean_active_topics": F.avg(active),
        "std_active_topics": F.stddev_samp(active),
        "max_active_topics": F.max(active),
        "single_topic_docs": F.count_if(active == 1),
        "multi_topic_docs": F.count_if(active > MANY_TOPICS),
    }


def active_topics(df: DataFrame) -> DataFrame:
    return _tall(df, _active_metrics())


def active_topic_distribution(df: DataFrame, k: int = 10) -> DataFrame:
    """The k most common numbers of active topics; ties by the smaller number."""
    counts = df.groupBy("active_topic_count").agg(F.count("*").alias("documents"))
    return counts.orderBy(F.desc("documents"), "active_topic_count").limit(k)


_PAIR_SUMS = (
    "i int, j int, n long, mean_a double, mean_b double, square_a double, square_b double, "
    "product double"
)
# A column whose variance is below this share of its mean square is constant but for
# rounding.
_CONSTANT = 1e-13


def _pair_sums(columns: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per Arrow batch and pair of columns: rows with both, means, centred sums."""
    first, second = np.triu_indices(columns, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            values = values.astype(np.float64)
            there = np.isfinite(values)
            some = there.any(axis=0)
            # Centred on the batch's means, so that little cancels within it.
            shift = np.where(some, np.where(there, values, 0).sum(axis=0) / np.maximum(there.sum(axis=0), 1), 0)
            x = np.where(there, values - shift, 0.0)
            m = there.astype(np.float64)
            n = (m.T @ m)[first, second]
            keep = n > 0
            i, j, n = first[keep], second[keep], n[keep]
            sum_a, sum_b = (x.T @ m)[i, j], (x.T @ m)[j, i]
            squares = (x * x).T @ m
            yield pa.record_batch(
                {
                    "i": pa.array(i, pa.int32()),
                    "j": pa.array(j, pa.int32()),
                    "n": pa.array(n.astype(np.int64)),
                    "mean_a": pa.array(sum_a / n + shift[i]),
                    "mean_b": pa.array(sum_b / n + shift[j]),
                    "square_a": pa.array(squares[i, j] - sum_a * sum_a / n),
                    "square_b": pa.array(squares[j, i] - sum_b * sum_b / n),
                    "product": pa.array((x.T @ x)[i, j] - sum_a * sum_b / n),
                }
            )

    return run


def topic_correlations(df: DataFrame, k: int | None = 10) -> DataFrame:
    """Strongest Pearson correlations among all topic pairs, descending.

    Each pair uses the documents that have both weights. A constant topic has no
    correlation and is left out. Every Arrow batch of weights gives one row per pair,
    from a few matrix products; these are merged, so nothing grows with pairs times
    documents.
    """
    cols = topic_columns(df)
    weights = df.filter(F.coalesce(*cols).isNotNull()).select(*[F.col(c).cast("double") for c in cols])
    sums = weights.mapInArrow(_pair_sums(len(cols)), _PAIR_SUMS)
    n, a, b = F.col("n"), F.col("mean_a"), F.col("mean_b")
    merged = sums.groupBy("i", "j").agg(
        F.sum("n").alias("n"),
        F.sum(n * a).alias("a"),
        F.sum(n * b).alias("b"),
        F.sum(F.col("square_a") + n * a * a).alias("aa"),
        F.sum(F.col("square_b") + n * b * b).alias("bb"),
        F.sum(F.col("product") + n * a * b).alias("ab"),
    )
    merged = merged.select(
        "i",
        "j",
        (F.col("aa") - F.col("a") * F.col("a") / n).alias("var_a"),
        (F.col("bb") - F.col("b") * F.col("b") / n).alias("var_b"),
        (F.col("ab") - F.col("a") * F.col("b") / n).alias("cov"),
        (_CONSTANT * F.col("aa")).alias("least_a"),
        (_CONSTANT * F.col("bb")).alias("least_b"),
    )
    varies = (F.col("var_a") > F.col("least_a")) & (F.col("var_b") > F.col("least_b"))
    names = F.array(*[F.lit(c) for c in cols])
    result = merged.filter(varies).select(
        F.get(names, F.col("i")).alias("topic_a"),
        F.get(names, F.col("j")).alias("topic_b"),
        (F.col("cov") / F.sqrt(F.col("var_a") * F.col("var_b"))).alias("correlation"),
    )
    ordered = result.orderBy(F.desc("correlation"), "topic_a", "topic_b")
    return ordered if k is None else ordered.limit(k)


# ---- counts and distributions -------------------------------------------------


def basic_counts(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Rows, columns, distinct documents and legislators, topic columns."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    metrics = {
        "total_documents": F.count("*"),
        "total_columns": F.lit(len(df.columns)),
        "topic_columns": F.lit(len(topic_columns(df))),
        "unique_documents": distinct("doc_id") if "doc_id" in df.columns else F.count("*"),
    }
    if "bonica_rid" in df.columns:
        metrics["unique_legislators"] = distinct("bonica_rid")
    return _tall(df, metrics)


DISTRIBUTIONS = {
    "legislative_body": "legis_body",
    "congress": "congno",
    "training_split": "training_set",
}


def distributions(df: DataFrame) -> DataFrame:
    """``(distribution, value, documents)`` of the key columns, in one pass."""
    present = {name: c for name, c in DISTRIBUTIONS.items() if c in df.columns}
    wide = df.select(*[F.col(c).cast("string").alias(name) for name, c in present.items()])
    return (
        wide.unpivot([], list(present), "distribution", "value")
        .filter(F.col("value").isNotNull())
        .groupBy("distribution", "value")
        .agg(F.count("*").alias("documents"))
    )


# ---- text ---------------------------------------------------------------------


def _text_counts(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """``(measure, value, n)``: how many texts have which length and word count."""
    columns = {"length": F.length("text"), "words": tx.word_count(F.col("text"))}
    measured = df.filter(F.col("text").isNotNull()).select(
        *[columns[m].alias(m) for m in measures]
    )
    return (
        measured.unpivot([], list(measures), "measure", "value")
        .groupBy("measure", "value")
        .agg(F.count("*").alias("n"))
    )


def text_statistics(df: DataFrame, measures: Sequence[str] = ("length", "words")) -> DataFrame:
    """Character and word statistics, one row per measure.

    The text is read once into a table of counts per length; all moments and
    percentiles come from that small table.
    """
    counts = _text_counts(df, measures).select(
        "measure", F.col("value").cast("double").alias("v"), "n"
    )
    whole = Window.partitionBy("measure")
    ranked = with_ranks(counts, "measure").withColumn(
        "mean", F.sum(F.col("n") * F.col("v")).over(whole) / F.col("total")
    )
    squares = F.sum(F.expr("n * (v - mean) * (v - mean)"))
    return ranked.groupBy("measure").agg(
        F.max("total").alias("documents"),
        F.max("mean").alias("mean"),
        counted_quantile(0.5).alias("median"),
        F.sqrt(F.try_divide(squares, F.max("total") - 1)).alias("std"),
        F.min("v").cast("long").alias("min"),
        F.max("v").cast("long").alias("max"),
        *[
            counted_quantile(p).cast("long").alias(name)
            for p, name in LENGTH_PERCENTILES.items()
        ],
    )


def length_categories(df: DataFrame) -> DataFrame:
    """Documents per text length class; classes without documents count 0."""
    length = F.length("text")
    classes = [*tx.LENGTH_CLASSES, tx.LONGEST_CLASS]
    row = df.agg(*[F.count_if(tx.length_class(length) == c).alias(c) for c in classes])
    return row.unpivot([], classes, "length_class", "documents")


# ---- quality --------------------------------------------------------------------


def missing_data(df: DataFrame) -> DataFrame:
    """``(column, missing, percent)`` of the columns with any missing value."""
    row = df.agg(
        F.count("*").alias("__rows"),
        *[F.expr(f"count_if(`{c}` IS NULL) AS `{c}`") for c in df.columns],
    )
    return (
        row.unpivot(["__rows"], df.columns, "column", "missing")
        .filter(F.col("missing") > 0)
        .select("column", "missing", (F.col("missing") / F.col("__rows") * 100).alias("percent"))
    )


def missing_fractions(
    df: DataFrame, columns: Sequence[str] = ("text", "date", "congno", "bonica_rid")
) -> DataFrame:
    """``(column, fraction)`` from 0 to 1, also for columns without missing values."""
    present = [c for c in columns if c in df.columns]
    row = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in present])
    return row.unpivot([], present, "column", "fraction")


def duplicate_ids(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows beyond the first of their id; missing ids count as equal."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_document_ids")
    )


def _text_quality_metrics() -> Metrics:
    length = F.length("text")
    empty, short = F.count_if(length == 0), F.count_if(length < SHORT_TEXT)
    rows = F.count("*")
    return {
        "empty_text_documents": empty,
        "very_short_documents": short,
        # Counts an empty text twice, as it is very short too.
        "percentage_problematic": F.try_divide((empty + short) * F.lit(100.0), rows),
        "percentage_problematic_distinct": F.try_divide(short * F.lit(100.0), rows),
    }


def _weight_quality_metrics(total: Column) -> Metrics:
    return {
        "zero_weight_documents": F.count_if(total == 0),
        "high_sum_documents": F.count_if(total > HIGH_WEIGHT_SUM),
        "mean_topic_sum": F.avg(total),
        "std_topic_sum": F.stddev_samp(total),
    }


def _with_weight_sum(df: DataFrame, kept: Sequence[str]) -> DataFrame:
    cols = topic_columns(df)
    return df.select(*kept, tf.weight_sum(cols).alias("__total")) if cols else df.select(*kept)


def quality_metrics(df: DataFrame) -> DataFrame:
    """Text and topic-weight quality."""
    metrics: Metrics = {}
    kept = []
    if "text" in df.columns:
        kept = ["text"]
        metrics.update(_text_quality_metrics())
    if topic_columns(df):
        metrics.update(_weight_quality_metrics(F.col("__total")))
    return _tall(_with_weight_sum(df, kept), metrics)


# ---- time -----------------------------------------------------------------------


def date_range(df: DataFrame) -> DataFrame:
    """Start, end, span and validity of the dates; no dates gives NULLs, not an error."""
    dates = df.select(parsing.date_column(df).alias("d"))
    return dates.agg(
        F.min("d").alias("start_date"),
        F.max("d").alias("end_date"),
        F.datediff(F.max("d"), F.min("d")).alias("span_days"),
        F.count("d").alias("valid_dates"),
        F.count_if(F.col("d").isNull()).alias("invalid_dates"),
    )


def _with_year(df: DataFrame, *kept: str) -> DataFrame:
    if "year" in df.columns:
        return df.select(*kept, "year")
    return df.select(*kept, parsing.year_of(parsing.date_column(df)).alias("year"))


def documents_per_year(df: DataFrame) -> DataFrame:
    years = _with_year(df).filter(F.col("year").isNotNull())
    return years.groupBy("year").agg(F.count("*").alias("documents"))


def years_covered(df: DataFrame) -> DataFrame:
    return documents_per_year(df).agg(F.count("*").alias("years_covered"))


def congress_years(df: DataFrame) -> DataFrame:
    """First year, last year and number of dated documents per congress."""
    return (
        _with_year(df, "congno")
        .filter(F.col("congno").isNotNull())
        .groupBy("congno")
        .agg(
            F.min("year").alias("min_year"),
            F.max("year").alias("max_year"),
            F.count("year").alias("document_count"),
        )
    )


def congress_span(df: DataFrame) -> DataFrame:
    """Congress range as text, e.g. ``104-112``."""
    low, high = F.min("congno"), F.max("congno")
    return df.agg(F.concat_ws("-", low.cast("string"), high.cast("string")).alias("congress_range"))


# ---- overview ---------------------------------------------------------------------


def column_types(df: DataFrame) -> DataFrame:
    """``(position, column, type)`` from the schema alone."""
    fields = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(fields, "position int, column string, type string")


def table_info(df: DataFrame, source: str | None = None, split: str | None = None) -> DataFrame:
    """One row: size, text length, date and congress ranges."""
    staged = df
    aggregates = [
        F.lit(source).cast("string").alias("source"),
        F.lit(split).cast("string").alias("split"),
        F.count("*").alias("documents"),
        F.lit(len(df.columns)).alias("columns"),
        F.lit(len(topic_columns(df))).alias("topic_columns"),
    ]
    if "date" in df.columns:
        staged = staged.withColumn("date", parsing.date_column(df))
        aggregates += [F.min("date").alias("start_date"), F.max("date").alias("end_date")]
    if "congno" in df.columns:
        aggregates += [
            F.min("congno").alias("min_congress"),
            F.max("congno").alias("max_congress"),
            F.count_distinct("congno").alias("unique_congresses"),
        ]
    # Text lengths come from their table of counts, like all text percentiles.
    info = staged.agg(*aggregates)
    if "text" not in df.columns:
        return info
    lengths = text_statistics(df, ["length"]).select(
        F.struct(
            F.col("mean").alias("mean_length"),
            F.col("median").alias("median_length"),
            F.col("min").alias("min_length"),
            F.col("max").alias("max_length"),
        )
    )
    return info.withColumn("__text", lengths.scalar()).select(*info.columns, "__text.*")


def corpus_metrics(df: DataFrame) -> DataFrame:
    """``(family, metric, value)``: every global metric of a table in one scan.

    Derived per-row values are projected first; text, dates and weights are each
    touched once. Percentiles and distinct counts are not among these metrics, as
    they need a shuffle of their own.
    """
    cols = topic_columns(df)
    staged: list[Column | str] = [c for c in df.columns if c not in cols and c != "date"]
    families: dict[str, Metrics] = {"basic": {"total_documents": F.count("*")}}
    if "date" in df.columns:
        staged.append(parsing.date_column(df).alias("date"))
        families["dates"] = {
            "span_days": F.datediff(F.max("date"), F.min("date")),
            "valid_dates": F.count("date"),
            "invalid_dates": F.count_if(F.col("date").isNull()),
        }
    if "text" in df.columns:
        staged += [F.length("text").alias("__length"), tx.word_count(F.col("text")).alias("__words")]
        for family, name in (("length", "__length"), ("words", "__words")):
            value = F.col(name)
            families[family] = {
                "mean": F.avg(value),
                "std": F.stddev_samp(value),
                "min": F.min(value),
                "max": F.max(value),
            }
        families["length_categories"] = {
            c: F.count_if(tx.length_class(F.col("__length")) == c)
            for c in [*tx.LENGTH_CLASSES, tx.LONGEST_CLASS]
        }
        families["text_quality"] = _text_quality_metrics()
    if cols:
        staged.append(tf.weight_sum(cols).alias("__total"))
        families["weight_quality"] = _weight_quality_metrics(F.col("__total"))
    if "topic_entropy" in df.columns:
        families["diversity"] = _diversity_metrics()
    if "active_topic_count" in df.columns:
        families["active_topics"] = _active_metrics()
    named = [(family, m, value) for family, ms in families.items() for m, value in ms.items()]
    row = df.select(*staged).agg(
        *[value.cast("double").alias(f"m{i}") for i, (_, _, value) in enumerate(named)]
    )
    entries = ", ".join(
        f"struct('{family}' AS family, '{metric}' AS metric, m{i} AS value)"
        for i, (family, metric, _) in enumerate(named)
    )
    return row.selectExpr(f"inline(array({entries}))")


# ---- research views -----------------------------------------------------------------


BREAKDOWNS = (
    ("legis_body",),
    ("congno",),
    ("training_set",),
    ("year",),
    ("legis_body", "congno"),
)


def breakdowns(df: DataFrame, sets: Sequence[Sequence[str]] = BREAKDOWNS) -> DataFrame:
    """Documents, text size, breadth and mean topic weights per group, for many groupings at once.

    One scan and one shuffle by grouping sets, with counts combined on the map side. A row
    has the grouping's name in ``breakdown`` (columns joined by ``+``), the group's values
    in its columns and NULL in the others; a NULL in one of its own columns is the group of
    missing values. Sets with a column the table lacks are left out; ``year`` is taken
    from ``date`` if need be.
    """
    cols = topic_columns(df)
    others = [c for c in df.columns if c != "year"]
    dated = "year" in df.columns or "date" in df.columns
    staged = _with_year(df, *others) if dated else df
    wanted = [list(s) for s in sets if set(s) <= set(staged.columns)]
    keys = list(dict.fromkeys(c for s in wanted for c in s))
    if not keys:
        raise ValueError("the table has no column of these breakdowns")
    measures = {"documents": F.count(F.lit(1))}
    measured = [F.col(c) for c in (*keys, *cols)]
    if "text" in df.columns:
        measured.append(F.length("text").alias("__length"))
        measures["mean_length"] = F.avg("__length")
    for c in ("topic_entropy", "active_topic_count"):
        if c in df.columns:
            measured.append(F.col(c))
            measures[f"mean_{c}"] = F.avg(c)
    measures |= {c: F.avg(c) for c in cols}
    # Keys that a set does not group by have their bit set, the first key the highest.
    bits = {c: 1 << (len(keys) - 1 - i) for i, c in enumerate(keys)}
    name = F.lit(None).cast("string")
    for s in wanted:
        rolled_up = sum(bits[c] for c in keys if c not in s)
        name = F.when(F.col("__set") == rolled_up, "+".join(s)).otherwise(name)
    grouped = staged.select(*measured).groupingSets([[F.col(c) for c in s] for s in wanted], *keys)
    return grouped.agg(
        F.grouping_id().alias("__set"), *[m.alias(f"{c}") for c, m in measures.items()]
    ).select(name.alias("breakdown"), *keys, *measures)


def legislator_profiles(df: DataFrame) -> DataFrame:
    """Mean weight per topic and number of documents for each legislator."""
    cols = topic_columns(df)
    return (
        df.filter(F.col("bonica_rid").isNotNull())
        .groupBy("bonica_rid")
        .agg(F.count("*").alias("documents"), *[F.expr(f"avg(`{c}`) AS `{c}`") for c in cols])
    )


def topic_trend(df: DataFrame) -> DataFrame:
    """Mean weight per year and topic."""
    cols = topic_columns(df)
    yearly = _with_year(df, *cols).filter(F.col("year").isNotNull())
    return (
        long_weights(yearly, ["year"])
        .groupBy("year", "topic")
        .agg(F.avg("weight").alias("mean_weight"), F.count("weight").alias("documents"))
    )


def body_comparison(df: DataFrame) -> DataFrame:
    """Speech patterns per legislative body: text size, focus and breadth."""
    return df.groupBy("legis_body").agg(
        F.count("*").alias("documents"),
        F.avg(F.length("text")).alias("mean_length"),
        F.avg(tx.word_count(F.col("text"))).alias("mean_words"),
        F.avg("max_topic_weight").alias("mean_max_weight"),
        F.avg("topic_entropy").alias("mean_entropy"),
        F.avg("active_topic_count").alias("mean_active_topics"),
    )


def congress_comparison(df: DataFrame) -> DataFrame:
    """Mean weight per congress and topic, with the change from the congress before."""
    means = (
        long_weights(df.filter(F.col("congno").isNotNull()), ["congno"])
        .groupBy("congno", "topic")
        .agg(F.avg("weight").alias("mean_weight"))
    )
    previous = means.select(
        (F.col("congno") + 1).alias("congno"), "topic", F.col("mean_weight").alias("previous")
    )
    return means.join(previous, ["congno", "topic"], "left").select(
        "congno",
        "topic",
        "mean_weight",
        (F.col("mean_weight") - F.col("previous")).alias("change"),
    )
