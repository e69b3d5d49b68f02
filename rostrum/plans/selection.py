"""Queries on projection, filters, samples and subsets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from rostrum.operators import sampling, select
from rostrum.plans.registry import query, rounded
from rostrum.plans.speech_view import SQL_FEATURES, SQL_SPEECHES, features, speeches


@query(
    "project_columns",
    f"""WITH {SQL_SPEECHES}
SELECT doc_id, date, legis_body, round(tw_economy, 6) + 0.0 AS tw_economy FROM speeches""",
)
def project_columns(spark, sf_dir):
    wanted = ["doc.id", "date", "legis.body", "tw.economy"]
    view = speeches(spark, sf_dir, ["doc_id", "text", "date", "legis_body", "tw_economy"])
    return rounded(select.project(view, wanted), "tw_economy")


@query(
    "filter_declarative",
    f"""WITH {SQL_SPEECHES}
SELECT doc_id, congno, legis_body, round(tw_economy, 6) + 0.0 AS tw_economy FROM speeches
WHERE congno >= 104 AND congno < 120 AND legis_body = 'US House' AND tw_economy <= 0.2
  AND tw_economy > 0.0""",
)
def filter_declarative(spark, sf_dir):
    view = speeches(spark, sf_dir, ["doc_id", "congno", "legis_body", "tw_economy"])
    specs = [
        {"column": "congno", "condition": "ge", "value": 104},
        {"column": "congno", "condition": "lt", "value": 120},
        {"column": "legis_body", "value": "US House"},
        {"column": "tw_economy", "condition": "le", "value": 0.2},
        {"column": "tw_economy", "condition": "gt", "value": 0.0},
    ]
    return rounded(reduce(select.where_spec, specs, view), "tw_economy")


_STANDARD = {
    "house_only": "legis_body = 'US House'",
    "senate_only": "legis_body = 'US Senate'",
    "recent_congress": "congno >= 110",
    "congress_108": "congno = 108",
    "congress_109": "congno = 109",
    "training_only": "training_set = 1",
    "test_only": "training_set = 0",
    "healthcare_focused": "tw_healthcare > 0.1",
    "economy_focused": "tw_economy > 0.1",
    "defense_and_foreign_policy_focused": "tw_defense_and_foreign_policy > 0.1",
}
_CUSTOM = {"old_house": {"column": "congno", "condition": "le", "value": 105}}
STANDARD_COLUMNS = [
    "legis_body",
    "congno",
    "training_set",
    "tw_healthcare",
    "tw_economy",
    "tw_defense_and_foreign_policy",
]


def filter_counts_sql(extra: dict[str, str]) -> str:
    parts = [
        f"SELECT '{name}' AS filter_name, CAST(count_if({rule}) AS BIGINT) AS documents FROM speeches"
        for name, rule in {**_STANDARD, **extra}.items()
    ]
    return f"WITH {SQL_SPEECHES} " + " UNION ALL ".join(parts)


@query("standard_filters", filter_counts_sql({}))
def standard_filters(spark, sf_dir):
    return select.filter_counts(speeches(spark, sf_dir, STANDARD_COLUMNS))


@query("custom_filters", filter_counts_sql({"old_house": "congno <= 105"}))
def custom_filters(spark, sf_dir):
    return select.filter_counts(speeches(spark, sf_dir, STANDARD_COLUMNS), _CUSTOM)


@query(
    "filter_by_topic",
    f"""WITH {SQL_FEATURES}
SELECT doc_id, round(tw_healthcare, 6) + 0.0 AS tw_healthcare, dominant_topic FROM features
WHERE tw_healthcare >= 0.1""",
)
def filter_by_topic(spark, sf_dir):
    focused = select.where_topic(features(spark, sf_dir, ["doc_id"]), "tw.healthcare")
    return rounded(focused.select("doc_id", "tw_healthcare", "dominant_topic"), "tw_healthcare")


@query(
    "topic_focused",
    f"""WITH {SQL_SPEECHES}
SELECT doc_id, topic, round(weight, 6) + 0.0 AS weight FROM (
  SELECT doc_id, 'tw_healthcare' AS topic, tw_healthcare AS weight FROM speeches
  UNION ALL SELECT doc_id, 'tw_economy', tw_economy FROM speeches
  UNION ALL SELECT doc_id, 'tw_defense_and_foreign_policy', tw_defense_and_foreign_policy FROM speeches
) WHERE weight >= 0.1""",
)
def topic_focused(spark, sf_dir):
    view = speeches(spark, sf_dir, ["doc_id"], topics=True)
    return rounded(select.topic_memberships(view), "weight")


_CUSTOM_SQL = f"""WITH {SQL_SPEECHES}
SELECT doc_id, congno, round(tw_healthcare, 6) + 0.0 AS tw_healthcare FROM speeches
WHERE congno IN (104, 105, 110, 111, 112) AND length(text) > 500 AND tw_healthcare > 0.01"""


@query("custom_predicates", _CUSTOM_SQL)
def custom_predicates(spark, sf_dir):
    view = speeches(spark, sf_dir, ["doc_id", "congno", "text", "tw_healthcare"])
    kept = select.where_columns(
        view,
        {
            "congno": lambda c: c.isin(104, 105, 110, 111, 112),
            "text": lambda c: F.length(c) > 500,
            "tw.healthcare": lambda c: c > 0.01,
        },
    )
    return rounded(kept.drop("text"), "tw_healthcare")


@query("python_predicates", _CUSTOM_SQL)
def python_predicates(spark, sf_dir):
    view = speeches(spark, sf_dir, ["doc_id", "congno", "text", "tw_healthcare"])
    kept = select.where_columns(
        view,
        {
            "congno": lambda x: x in (104, 105, 110, 111, 112),
            "text": lambda x: len(x) > 500,
            "tw.healthcare": lambda x: x > 0.01,
        },
        python=True,
    )
    return rounded(kept.drop("text"), "tw_healthcare")


@query(
    "range_filters",
    f"""WITH {SQL_SPEECHES}
SELECT doc_id, congno, date FROM speeches WHERE congno BETWEEN 104 AND 111
  AND TRY_CAST(date AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1998-06-30'""",
)
def range_filters(spark, sf_dir):
    view = speeches(spark, sf_dir, ["doc_id", "congno", "date"])
    return select.in_date_range(select.in_congress_range(view, 104, 111), "1996-01-01", "1998-06-30")


@query(
    "split_by_body",
    f"""WITH {SQL_SPEECHES}
SELECT coalesce(legis_body, 'none') AS part, CAST(count(*) AS BIGINT) AS documents,
  CAST(min(congno) AS BIGINT) AS first_congress FROM speeches GROUP BY 1""",
)
def split_by_body(spark, sf_dir):
    parts = select.split_by(speeches(spark, sf_dir, ["congno", "legis_body"]), "legis_body")
    tagged = [df.withColumn("part", F.lit(value or "none")) for value, df in parts.items()]
    whole = reduce(DataFrame.unionByName, tagged)
    return whole.groupBy("part").agg(
        F.count("*").alias("documents"), F.min("congno").alias("first_congress")
    )


def _sample_sql(n: int, where: str = "true") -> str:
    return f"""WITH {SQL_SPEECHES}
SELECT doc_id, congno, CAST(length(text) AS BIGINT) AS length FROM speeches WHERE {where}
ORDER BY md5('42:' || doc_id), doc_id LIMIT {n}"""


def _sampled(df):
    return df.select("doc_id", "congno", F.length("text").cast("long").alias("length"))


@query("hash_sample", _sample_sql(100))
def hash_sample(spark, sf_dir):
    view = _sampled(speeches(spark, sf_dir, ["doc_id", "congno", "text"]))
    return sampling.sample_rows(view, 100)


@query("few_rows", _sample_sql(5))
def few_rows(spark, sf_dir):
    view = _sampled(speeches(spark, sf_dir, ["doc_id", "congno", "text"]))
    return sampling.sample_rows(view, 5)


@query("quick_sample", _sample_sql(20, "congno = 110"))
def quick_sample(spark, sf_dir):
    view = _sampled(speeches(spark, sf_dir, ["doc_id", "congno", "text"]))
    return sampling.quick_sample(view, 20, congress=110)
