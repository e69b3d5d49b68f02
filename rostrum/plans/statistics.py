"""Queries on corpus statistics and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.operators import sketches, statistics as stats, validation
from rostrum.plans.registry import as_double, as_long, query, rounded
from rostrum.plans.speech_view import (
    SQL_FEATURES,
    SQL_SPACE,
    SQL_SPEECHES,
    VIEW_COLUMNS,
    features,
    speeches,
)
from rostrum.schema import TOPIC_COLUMNS
from rostrum.session import scratch_path

_SUM = " + ".join(f"coalesce({c}, 0.0)" for c in TOPIC_COLUMNS)
_WORDS = (
    f"(CASE WHEN {SQL_SPACE.format(c='text')} = '' THEN 0 ELSE "
    f"len(string_split({SQL_SPACE.format(c='text')}, ' ')) END)"
)


def _tall(ctes: str, source: str, metrics: dict[str, str]) -> str:
    columns = ", ".join(f"CAST({sql} AS DOUBLE) AS {name}" for name, sql in metrics.items())
    return f"""WITH {ctes}, row AS (SELECT {columns} FROM {source})
SELECT metric, round(value, 6) + 0.0 AS value FROM (UNPIVOT row ON * INTO NAME metric VALUE value)"""


_BASIC = {
    "total_documents": "count(*)",
    "total_columns": str(len(VIEW_COLUMNS)),
    "topic_columns": str(len(TOPIC_COLUMNS)),
    "unique_documents": "count(DISTINCT doc_id)",
    "unique_legislators": "count(DISTINCT bonica_rid)",
}


@query("basic_stats", _tall(SQL_SPEECHES, "speeches", _BASIC))
def basic_stats(spark, sf_dir):
    return rounded(stats.basic_counts(speeches(spark, sf_dir)), "value")


@query(
    "distributions",
    f"""WITH {SQL_SPEECHES}, long AS (
  SELECT 'legislative_body' AS distribution, legis_body AS value FROM speeches
  UNION ALL SELECT 'congress', CAST(congno AS VARCHAR) FROM speeches
  UNION ALL SELECT 'training_split', CAST(training_set AS VARCHAR) FROM speeches
)
SELECT distribution, value, CAST(count(*) AS BIGINT) AS documents FROM long
WHERE value IS NOT NULL GROUP BY 1, 2""",
)
def distributions(spark, sf_dir):
    return stats.distributions(
        speeches(spark, sf_dir, ["legis_body", "congno", "training_set"])
    )


@query(
    "table_info",
    f"""WITH {SQL_SPEECHES}
SELECT 'speeches' AS source, 'train' AS split, CAST(count(*) AS BIGINT) AS documents,
  CAST({len(VIEW_COLUMNS)} AS BIGINT) AS columns, CAST({len(TOPIC_COLUMNS)} AS BIGINT) AS topic_columns,
  strftime(min(TRY_CAST(date AS DATE)), '%Y-%m-%d') AS start_date,
  strftime(max(TRY_CAST(date AS DATE)), '%Y-%m-%d') AS end_date,
  CAST(min(congno) AS BIGINT) AS min_congress, CAST(max(congno) AS BIGINT) AS max_congress,
  CAST(count(DISTINCT congno) AS BIGINT) AS unique_congresses,
  round(avg(length(text)), 6) + 0.0 AS mean_length,
  round(quantile_cont(length(text), 0.5), 6) + 0.0 AS median_length,
  CAST(min(length(text)) AS BIGINT) AS min_length, CAST(max(length(text)) AS BIGINT) AS max_length
FROM speeches""",
)
def table_info(spark, sf_dir):
    info = stats.table_info(speeches(spark, sf_dir), "speeches", "train")
    info = as_long(info, "columns", "topic_columns", "min_length", "max_length")
    dates = {c: F.date_format(c, "yyyy-MM-dd") for c in ("start_date", "end_date")}
    return rounded(info.withColumns(dates), "mean_length", "median_length")


def _measure_sql(name: str, value: str) -> str:
    percentiles = ", ".join(
        f"CAST(floor(quantile_cont({value}, {p})) AS BIGINT) AS p{int(p * 100)}"
        for p in (0.1, 0.25, 0.75, 0.9)
    )
    return f"""SELECT '{name}' AS measure, CAST(count(*) AS BIGINT) AS documents,
  round(avg({value}), 6) + 0.0 AS mean, round(quantile_cont({value}, 0.5), 6) + 0.0 AS median,
  round(stddev_samp({value}), 6) + 0.0 AS std, CAST(min({value}) AS BIGINT) AS min,
  CAST(max({value}) AS BIGINT) AS max, {percentiles} FROM measured"""


@query(
    "text_stats",
    f"""WITH {SQL_SPEECHES}, measured AS (
  SELECT length(text) AS chars, {_WORDS} AS words FROM speeches WHERE text IS NOT NULL
) {_measure_sql("length", "chars")} UNION ALL {_measure_sql("words", "words")}""",
)
def text_stats(spark, sf_dir):
    table = stats.text_statistics(speeches(spark, sf_dir, ["text"]))
    return rounded(as_long(table, "min", "max"), "mean", "median", "std")


_CLASSES = {
    "very_short": "length(text) < 100",
    "short": "length(text) >= 100 AND length(text) < 500",
    "medium": "length(text) >= 500 AND length(text) < 2000",
    "long": "length(text) >= 2000 AND length(text) < 5000",
    "very_long": "length(text) >= 5000",
}


@query(
    "length_categories",
    f"WITH {SQL_SPEECHES} "
    + " UNION ALL ".join(
        f"SELECT '{name}' AS length_class, CAST(count_if({rule}) AS BIGINT) AS documents FROM speeches"
        for name, rule in _CLASSES.items()
    ),
)
def length_categories(spark, sf_dir):
    return stats.length_categories(speeches(spark, sf_dir, ["text"]))


@query(
    "missing_data",
    f"WITH {SQL_SPEECHES}, counts AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count_if({c} IS NULL) AS missing, count(*) AS n FROM speeches"
        for c in VIEW_COLUMNS
    )
    + """) SELECT "column", CAST(missing AS BIGINT) AS missing,
  round(missing / n * 100, 6) + 0.0 AS percent FROM counts WHERE missing > 0""",
)
def missing_data(spark, sf_dir):
    return rounded(stats.missing_data(speeches(spark, sf_dir)), "percent")


_KEY_COLUMNS = ["text", "date", "congno", "bonica_rid"]


@query(
    "missing_fractions",
    f"WITH {SQL_SPEECHES} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(count_if({c} IS NULL) / count(*), 6) + 0.0 AS fraction
FROM speeches"""
        for c in _KEY_COLUMNS
    ),
)
def missing_fractions(spark, sf_dir):
    return rounded(stats.missing_fractions(speeches(spark, sf_dir, _KEY_COLUMNS)), "fraction")


@query(
    "duplicate_ids",
    f"""WITH {SQL_SPEECHES}
SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_document_ids, CAST(
  (SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM speeches GROUP BY page_id)) AS BIGINT)
  AS duplicate_page_ids
FROM (SELECT count(*) AS n FROM speeches GROUP BY doc_id)""",
)
def duplicate_ids(spark, sf_dir):
    view = speeches(spark, sf_dir, ["doc_id", "page_id"])
    pages = stats.duplicate_ids(view, "page_id")
    return stats.duplicate_ids(view).withColumn("duplicate_page_ids", pages.scalar())


_QUALITY = {
    "empty_text_documents": "count_if(length(text) = 0)",
    "very_short_documents": "count_if(length(text) < 10)",
    "percentage_problematic": "(count_if(length(text) = 0) + count_if(length(text) < 10)) * 100.0 / count(*)",
    "percentage_problematic_distinct": "count_if(length(text) < 10) * 100.0 / count(*)",
    "zero_weight_documents": f"count_if({_SUM} = 0)",
    "high_sum_documents": f"count_if({_SUM} > 1.1)",
    "mean_topic_sum": f"avg({_SUM})",
    "std_topic_sum": f"stddev_samp({_SUM})",
}


@query("quality_metrics", _tall(SQL_SPEECHES, "speeches", _QUALITY))
def quality_metrics(spark, sf_dir):
    return rounded(stats.quality_metrics(speeches(spark, sf_dir, ["text"], topics=True)), "value")


@query(
    "date_range",
    f"""WITH {SQL_SPEECHES}, dates AS (SELECT TRY_CAST(date AS DATE) AS d FROM speeches)
SELECT strftime(min(d), '%Y-%m-%d') AS start_date, strftime(max(d), '%Y-%m-%d') AS end_date,
  CAST(date_diff('day', min(d), max(d)) AS BIGINT) AS span_days,
  CAST(count(d) AS BIGINT) AS valid_dates, CAST(count_if(d IS NULL) AS BIGINT) AS invalid_dates
FROM dates""",
)
def date_range(spark, sf_dir):
    span = as_long(stats.date_range(speeches(spark, sf_dir, ["date"])), "span_days")
    return span.withColumns(
        {c: F.date_format(c, "yyyy-MM-dd") for c in ("start_date", "end_date")}
    )


_YEARS = f"""{SQL_SPEECHES}, dated AS (
  SELECT congno, CAST(year(TRY_CAST(date AS DATE)) AS BIGINT) AS year FROM speeches
)"""


@query(
    "yearly",
    f"""WITH {_YEARS} SELECT year, CAST(count(*) AS BIGINT) AS documents FROM dated
WHERE year IS NOT NULL GROUP BY year""",
)
def yearly(spark, sf_dir):
    return as_long(stats.documents_per_year(speeches(spark, sf_dir, ["date"])), "year")


@query(
    "years_covered",
    f"WITH {_YEARS} SELECT CAST(count(DISTINCT year) AS BIGINT) AS years_covered FROM dated",
)
def years_covered(spark, sf_dir):
    return stats.years_covered(speeches(spark, sf_dir, ["date"]))


@query(
    "congress_years",
    f"""WITH {_YEARS} SELECT congno, CAST(min(year) AS DOUBLE) AS min_year,
  CAST(max(year) AS DOUBLE) AS max_year, CAST(count(year) AS BIGINT) AS document_count
FROM dated WHERE congno IS NOT NULL GROUP BY congno""",
)
def congress_years(spark, sf_dir):
    table = stats.congress_years(speeches(spark, sf_dir, ["date", "congno"]))
    return as_double(table, "min_year", "max_year")


@query(
    "congress_span",
    f"WITH {SQL_SPEECHES} SELECT min(congno) || '-' || max(congno) AS congress_range FROM speeches",
)
def congress_span(spark, sf_dir):
    return stats.congress_span(speeches(spark, sf_dir, ["congno"]))


_FAMILIES = {
    "basic": {"total_documents": "count(*)"},
    "dates": {
        "span_days": "date_diff('day', min(TRY_CAST(date AS DATE)), max(TRY_CAST(date AS DATE)))",
        "valid_dates": "count(TRY_CAST(date AS DATE))",
        "invalid_dates": "count_if(TRY_CAST(date AS DATE) IS NULL)",
    },
    **{
        family: {
            "mean": f"avg({v})",
            "std": f"stddev_samp({v})",
            "min": f"min({v})",
            "max": f"max({v})",
        }
        for family, v in (("length", "length(text)"), ("words", _WORDS))
    },
    "length_categories": {name: f"count_if({rule})" for name, rule in _CLASSES.items()},
    "text_quality": {k: v for k, v in _QUALITY.items() if "topic" not in k and "weight" not in k and "sum" not in k},
    "weight_quality": {k: v for k, v in _QUALITY.items() if "topic" in k or "weight" in k or "sum" in k},
    "diversity": {
        "mean_entropy": "avg(topic_entropy)",
        "std_entropy": "stddev_samp(topic_entropy)",
        "low_diversity_docs": "count_if(topic_entropy < 1.0)",
        "high_diversity_docs": "count_if(topic_entropy > 2.0)",
    },
    "active_topics": {
        "mean_active_topics": "avg(active_topic_count)",
        "std_active_topics": "stddev_samp(active_topic_count)",
        "max_active_topics": "max(active_topic_count)",
        "single_topic_docs": "count_if(active_topic_count = 1)",
        "multi_topic_docs": "count_if(active_topic_count > 3)",
    },
}


@query(
    "corpus_metrics",
    f"WITH {SQL_FEATURES} "
    + " UNION ALL ".join(
        f"SELECT '{family}' AS family, '{name}' AS metric, "
        f"round(CAST({sql} AS DOUBLE), 6) + 0.0 AS value FROM features"
        for family, metrics in _FAMILIES.items()
        for name, sql in metrics.items()
    ),
)
def corpus_metrics(spark, sf_dir):
    view = features(spark, sf_dir, ["doc_id", "text", "date"])
    return rounded(stats.corpus_metrics(view), "value")


@query(
    "body_comparison",
    f"""WITH {SQL_FEATURES}
SELECT legis_body, CAST(count(*) AS BIGINT) AS documents,
  round(avg(length(text)), 6) + 0.0 AS mean_length, round(avg({_WORDS}), 6) + 0.0 AS mean_words,
  round(avg(max_topic_weight), 6) + 0.0 AS mean_max_weight,
  round(avg(topic_entropy), 6) + 0.0 AS mean_entropy,
  round(avg(active_topic_count), 6) + 0.0 AS mean_active_topics
FROM features GROUP BY legis_body""",
)
def body_comparison(spark, sf_dir):
    table = stats.body_comparison(features(spark, sf_dir, ["text", "legis_body"]))
    return rounded(
        table, "mean_length", "mean_words", "mean_max_weight", "mean_entropy", "mean_active_topics"
    )


_ALL = ", ".join(VIEW_COLUMNS)
_RULES = [
    ("basic", "empty_table", "", "CASE WHEN count(*) = 0 THEN 1 ELSE 0 END", "0"),
    ("basic", "missing_column", "text", "0 * count(*)", "0"),
    (
        "basic",
        "duplicate_rows",
        "",
        f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT {_ALL} FROM speeches))",
        "0",
    ),
    ("content", "empty_text", "text", "count_if(length(text) = 0)", "0"),
    ("content", "very_short_text", "text", "count_if(length(text) < 10)", "count(*) * 0.05"),
    *[
        rule
        for c in TOPIC_COLUMNS
        for rule in (
            ("topic", "out_of_range", c, f"count_if({c} < 0 OR {c} > 1)", "0"),
            ("topic", "missing_weight", c, f"count_if({c} IS NULL)", "0"),
        )
    ],
    ("topic", "all_zero_weights", "", f"count_if({_SUM} = 0)", "0"),
    ("consistency", "congress_out_of_range", "congno", "count_if(congno < 100 OR congno > 120)", "0"),
    ("consistency", "invalid_date", "date", "count_if(TRY_CAST(date AS DATE) IS NULL)", "0"),
    (
        "consistency",
        "invalid_flag",
        "training_set",
        "count_if(NOT coalesce(training_set IN (0, 1), false))",
        "0",
    ),
]
_REPORT_SQL = f"{SQL_SPEECHES}, report AS (" + " UNION ALL ".join(
    f"SELECT '{category}' AS category, '{rule}' AS rule, '{column}' AS \"column\", "
    f"CAST({violations} AS BIGINT) AS violations, ({violations}) <= ({limit}) AS passed FROM speeches"
    for category, rule, column, violations, limit in _RULES
) + ")"


@query("validation_report", f"WITH {_REPORT_SQL} SELECT * FROM report")
def validation_report(spark, sf_dir):
    return validation.validation_report(speeches(spark, sf_dir))


@query(
    "validation_score",
    f"""WITH {_REPORT_SQL}, categories AS (
  SELECT category, bool_and(passed) AS passed FROM report GROUP BY category
)
SELECT CAST(count_if(passed) AS BIGINT) AS passed_categories, CAST(count(*) AS BIGINT) AS categories,
  round(count_if(passed) / count(*) * 100, 6) + 0.0 AS score FROM categories""",
)
def validation_score(spark, sf_dir):
    report = validation.validation_report(speeches(spark, sf_dir))
    return rounded(validation.validation_score(report), "score")


# Types of the view's columns, as the fixture describes them.
_VIEW_TYPES = {c: "string" for c in VIEW_COLUMNS if c not in TOPIC_COLUMNS}
_VIEW_TYPES |= {"congno": "bigint", "training_set": "int"} | {c: "double" for c in TOPIC_COLUMNS}


@query(
    "column_types",
    "SELECT * FROM (VALUES "
    + ", ".join(f"('{c}', '{t}')" for c, t in _VIEW_TYPES.items())
    + """) AS v("column", type)""",
)
def column_types(spark, sf_dir):
    return stats.column_types(speeches(spark, sf_dir)).select("column", "type")


# Sketches are stored per congress; later ones are merged, the others not read.
_MEASURES = {
    **{c: c for c in TOPIC_COLUMNS},
    "max_topic_weight": "max_topic_weight",
    "topic_entropy": "topic_entropy",
    "active_topic_count": "active_topic_count",
    "text_length": "length(text)",
    "text_words": f"CASE WHEN text IS NOT NULL THEN {_WORDS} END",
}
_SKETCHED = f"""WITH {SQL_FEATURES}, merged AS (
  SELECT doc_id, bonica_rid, {", ".join(f"CAST({v} AS DOUBLE) AS {m}" for m, v in _MEASURES.items())}
  FROM features WHERE congno >= 106
)"""
# Bounds that the sketches' errors keep: share of ranks, and relative.
_RANK_ERROR, _DISTINCT_ERROR = 0.015, 0.04


def _sketched(spark, sf_dir):
    """The rows, and the sketches stored in two goes and read for the later congresses."""
    columns = ["doc_id", "bonica_rid", "text", "congno"]
    view = features(spark, sf_dir, columns)
    path = scratch_path(spark, "sketches")
    sketches.add_sketches(view.filter("congno < 108"), path, "congno")
    stored = sketches.add_sketches(view, path, "congno")
    return view.filter("congno >= 106"), stored.filter("shard >= 106")


@query(
    "sketch_summary",
    f"""{_SKETCHED}, tall AS (
  UNPIVOT (SELECT * EXCLUDE (doc_id, bonica_rid) FROM merged) ON * INTO NAME measure VALUE value
)
SELECT measure, CAST(count(value) AS BIGINT) AS n, round(avg(value), 6) + 0.0 AS mean,
  round(stddev_samp(value), 6) + 0.0 AS std, round(min(value), 6) + 0.0 AS min,
  round(max(value), 6) + 0.0 AS max, true AS quantiles_hold
FROM tall GROUP BY measure""",
)
def sketch_summary(spark, sf_dir):
    """The merged summary; its quartiles are held against the ranks they have in the rows."""
    rows, stored = _sketched(spark, sf_dir)
    found = sketches.summary(stored)
    measured = sketches._measures(rows)
    tall = (
        rows.select(*[m.cast("double").alias(name) for name, m in measured.items()])
        .unpivot([], list(measured), "measure", "value")
        .join(found.select("measure", *sketches.QUARTILES.values()), "measure")
    )
    holds = F.lit(True)
    for p, name in sketches.QUARTILES.items():
        below = F.count_if(F.col("value") < F.col(name)) / F.count("value")
        up_to = F.count_if(F.col("value") <= F.col(name)) / F.count("value")
        holds = holds & (below <= p + _RANK_ERROR) & (up_to >= p - _RANK_ERROR)
    checked = tall.groupBy("measure").agg(holds.alias("quantiles_hold"))
    result = found.drop(*sketches.QUARTILES.values()).join(checked, "measure")
    return rounded(result, "mean", "std", "min", "max")


@query(
    "sketch_distinct",
    f"""{_SKETCHED}, tall AS (
  UNPIVOT (SELECT doc_id, bonica_rid FROM merged) ON * INTO NAME measure VALUE value
)
SELECT measure, CAST(count(value) AS BIGINT) AS n,
  CAST(count(DISTINCT value) AS BIGINT) AS exact, true AS estimate_holds
FROM tall GROUP BY measure""",
)
def sketch_distinct(spark, sf_dir):
    """Merged distinct counts, held against exact ones."""
    rows, stored = _sketched(spark, sf_dir)
    names = list(sketches.IDENTIFIERS)
    exact = (
        rows.select(*names)
        .unpivot([], names, "measure", "value")
        .filter(F.col("value").isNotNull())
        .groupBy("measure", "value")
        .agg(F.count("*"))
        .groupBy("measure")
        .agg(F.count("*").alias("exact"))
    )
    counted = sketches.distinct_counts(stored).join(exact, "measure")
    apart = F.abs(F.col("distinct_values") - F.col("exact"))
    return counted.select(
        "measure", "n", "exact", (apart <= F.lit(_DISTINCT_ERROR) * F.col("exact")).alias("estimate_holds")
    )


def _breakdown_sql(columns: tuple[str, ...]) -> str:
    keys = ", ".join(
        f"CAST({c} AS {'VARCHAR' if c == 'legis_body' else 'DOUBLE'}) AS {c}"
        if c in columns
        else f"CAST(NULL AS {'VARCHAR' if c == 'legis_body' else 'DOUBLE'}) AS {c}"
        for c in ("legis_body", "congno", "training_set", "year")
    )
    means = {
        "mean_length": "length(text)",
        "mean_topic_entropy": "topic_entropy",
        "mean_active_topic_count": "active_topic_count",
        **{c: c for c in TOPIC_COLUMNS},
    }
    averages = ", ".join(f"round(avg({v}), 6) + 0.0 AS {name}" for name, v in means.items())
    groups = ", ".join(f"dated.{c}" for c in columns)
    return (
        f"SELECT '{'+'.join(columns)}' AS breakdown, {keys}, "
        f"CAST(count(*) AS BIGINT) AS documents, {averages} FROM dated GROUP BY {groups}"
    )


@query(
    "breakdowns",
    f"""WITH {SQL_FEATURES}, dated AS (
  SELECT *, CAST(year(TRY_CAST(date AS DATE)) AS BIGINT) AS year FROM features
) """
    + " UNION ALL ".join(_breakdown_sql(s) for s in stats.BREAKDOWNS),
)
def breakdowns(spark, sf_dir):
    columns = ["text", "date", "congno", "legis_body", "training_set"]
    found = stats.breakdowns(features(spark, sf_dir, columns))
    means = [c for c in found.columns if c.startswith("mean_") or c in TOPIC_COLUMNS]
    return rounded(as_double(found, "congno", "training_set", "year"), *means)
