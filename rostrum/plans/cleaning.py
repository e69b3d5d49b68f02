"""Queries on cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.operators import cleaning
from rostrum.operators.features import refresh_features
from rostrum.plans.registry import as_double, as_long, query, r6, rounded
from rostrum.plans.speech_view import SQL_CLEANED, SQL_SPACE, SQL_SPEECHES, features, speeches
from rostrum.schema import TOPIC_COLUMNS

_WEIGHTS = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in TOPIC_COLUMNS)
_TOTAL = " + ".join(f"greatest(0.0, least(1.0, coalesce({c}, 0.0)))" for c in TOPIC_COLUMNS)
_DATE_PARTS = ("year", "month", "day_of_year", "decade")


@query(
    "clean_text",
    f"""WITH {SQL_SPEECHES}, norm AS (
  SELECT doc_id, {SQL_SPACE.format(c="text")} AS text, {SQL_SPACE.format(c="stemmed_text")} AS stemmed_text
  FROM speeches
)
SELECT doc_id, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS text_length,
  md5(stemmed_text) AS stemmed_md5
FROM norm WHERE length(text) >= 10""",
)
def clean_text(spark, sf_dir):
    view = speeches(spark, sf_dir, ["doc_id", "text", "stemmed_text"])
    kept = cleaning.standardize_text(cleaning.drop_short_text(view))
    return kept.select(
        "doc_id",
        F.md5("text").alias("text_md5"),
        F.length("text").cast("long").alias("text_length"),
        F.md5("stemmed_text").alias("stemmed_md5"),
    )


@query(
    "clean_dates",
    f"""WITH {SQL_SPEECHES}, parsed AS (SELECT doc_id, TRY_CAST(date AS DATE) AS d FROM speeches)
SELECT doc_id, strftime(d, '%Y-%m-%d') AS date, CAST(year(d) AS DOUBLE) AS year,
  CAST(month(d) AS DOUBLE) AS month, CAST(dayofyear(d) AS DOUBLE) AS day_of_year,
  CAST((year(d) // 10) * 10 AS DOUBLE) AS decade FROM parsed""",
)
def clean_dates(spark, sf_dir):
    parsed = cleaning.standardize_dates(speeches(spark, sf_dir, ["doc_id", "date"]))
    return as_double(parsed.withColumn("date", F.date_format("date", "yyyy-MM-dd")), *_DATE_PARTS)


@query(
    "fill_missing",
    f"""WITH {SQL_SPEECHES}
SELECT doc_id, coalesce(bonica_rid, '') AS bonica_rid, coalesce(bill_id, '') AS bill_id,
  coalesce(page_id, '') AS page_id,
  coalesce(legis_body, (SELECT legis_body FROM speeches WHERE legis_body IS NOT NULL
    GROUP BY legis_body ORDER BY count(*) DESC, legis_body LIMIT 1), 'unknown') AS legis_body,
  doc_type, {", ".join(f"round(coalesce({c}, 0), 6) + 0.0 AS {c}" for c in TOPIC_COLUMNS)}
FROM speeches""",
)
def fill_missing(spark, sf_dir):
    ids = ["doc_id", "bonica_rid", "bill_id", "page_id", "legis_body", "doc_type"]
    return rounded(
        cleaning.fill_missing(speeches(spark, sf_dir, ids, topics=True)), *TOPIC_COLUMNS
    )


@query(
    "clean_numbers",
    f"""WITH {SQL_SPEECHES}
SELECT doc_id, congno, CAST(coalesce(training_set, 0) AS BIGINT) AS training_set,
  {", ".join(f"round(CASE WHEN {c} < 0 THEN 0 WHEN {c} > 1 THEN 1 ELSE {c} END, 6) + 0.0 AS {c}" for c in TOPIC_COLUMNS)}
FROM speeches""",
)
def clean_numbers(spark, sf_dir):
    view = speeches(spark, sf_dir, ["doc_id", "congno", "training_set"], topics=True)
    return rounded(as_long(cleaning.clean_numbers(view), "training_set"), *TOPIC_COLUMNS)


@query(
    "clean_all",
    f"""WITH {SQL_CLEANED}
SELECT doc_id, bonica_rid, bill_id, page_id, md5(text) AS text_md5, md5(stemmed_text) AS stemmed_md5,
  strftime(date, '%Y-%m-%d') AS date, congno, legis_body, CAST(training_set AS BIGINT) AS training_set,
  doc_type, CAST(year AS DOUBLE) AS year, CAST(month AS DOUBLE) AS month,
  CAST(day_of_year AS DOUBLE) AS day_of_year, CAST(decade AS DOUBLE) AS decade, dominant_topic,
  round(topic_entropy, 6) + 0.0 AS topic_entropy, {_WEIGHTS}
FROM cleaned""",
)
def clean_all(spark, sf_dir):
    cleaned = cleaning.clean(features(spark, sf_dir))
    return cleaned.select(
        "doc_id",
        "bonica_rid",
        "bill_id",
        "page_id",
        F.md5("text").alias("text_md5"),
        F.md5("stemmed_text").alias("stemmed_md5"),
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        "congno",
        "legis_body",
        F.col("training_set").cast("long").alias("training_set"),
        "doc_type",
        *[F.col(c).cast("double").alias(c) for c in _DATE_PARTS],
        "dominant_topic",
        r6("topic_entropy").alias("topic_entropy"),
        *TOPIC_COLUMNS,
    ).transform(rounded, *TOPIC_COLUMNS)


@query(
    "refresh_features",
    f"""WITH {SQL_CLEANED}, totals2 AS (
  SELECT * EXCLUDE (dominant_topic, max_topic_weight, topic_entropy, active_topic_count),
    greatest({", ".join(TOPIC_COLUMNS)}) AS m, {" + ".join(TOPIC_COLUMNS)} + CAST(1e-10 AS DOUBLE) AS t2
  FROM cleaned
)
SELECT doc_id, CASE {" ".join(f"WHEN {c} = m THEN '{c}'" for c in TOPIC_COLUMNS)} END AS dominant_topic,
  round(m, 6) + 0.0 AS max_topic_weight,
  round(-({" + ".join(f"({c} / t2) * ln({c} / t2 + CAST(1e-10 AS DOUBLE))" for c in TOPIC_COLUMNS)}), 6) + 0.0
    AS topic_entropy
FROM totals2""",
)
def refreshed(spark, sf_dir):
    columns = ["doc_id", "text", "legis_body"]
    cleaned = refresh_features(cleaning.clean(features(spark, sf_dir, columns)))
    return cleaned.select(
        "doc_id",
        "dominant_topic",
        r6("max_topic_weight").alias("max_topic_weight"),
        r6("topic_entropy").alias("topic_entropy"),
    )


_REPORT = {
    "original_size": "count(*)",
    "final_size": "count_if(keep)",
    "removed": "count_if(NOT keep)",
    "invalid_dates": "count_if(keep AND TRY_CAST(date AS DATE) IS NULL)",
    "invalid_congress": "count_if(keep AND congno NOT BETWEEN 100 AND 120)",
    "empty_text_documents": "count_if(keep AND length(norm) = 0)",
    "zero_weight_documents": f"count_if(keep AND {_TOTAL} = 0)",
    **{f"clipped_{c}": f"count_if(keep AND ({c} < 0 OR {c} > 1))" for c in TOPIC_COLUMNS},
}


@query(
    "cleaning_report",
    f"""WITH {SQL_SPEECHES}, marked AS (
  SELECT *, length(norm) >= 10 AS keep FROM (SELECT *, {SQL_SPACE.format(c="text")} AS norm FROM speeches)
), row AS (
  SELECT {", ".join(f"CAST({sql} AS BIGINT) AS {name}" for name, sql in _REPORT.items())} FROM marked
)
SELECT metric, value FROM (UNPIVOT row ON * INTO NAME metric VALUE value)""",
)
def cleaning_report(spark, sf_dir):
    return cleaning.cleaning_report(
        speeches(spark, sf_dir, ["text", "date", "congno"], topics=True)
    )
