"""Queries on topic features and topic statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.operators import statistics as stats
from rostrum.operators.features import explode_top_topics
from rostrum.plans.registry import as_long, query, r6, rounded
from rostrum.plans.speech_view import SQL_FEATURES, SQL_LONG, features, speeches
from rostrum.schema import TOPIC_COLUMNS

QUOTED_TOPICS = ", ".join(f"'{c}'" for c in TOPIC_COLUMNS)
FEATURE_SQL = f"""WITH {SQL_FEATURES}
SELECT doc_id, dominant_topic, round(max_topic_weight, 6) + 0.0 AS max_topic_weight,
  round(topic_entropy, 6) + 0.0 AS topic_entropy, CAST(active_topic_count AS BIGINT) AS active_topic_count
FROM features"""


def feature_columns(df):
    return df.select(
        "doc_id",
        "dominant_topic",
        r6("max_topic_weight").alias("max_topic_weight"),
        r6("topic_entropy").alias("topic_entropy"),
        F.col("active_topic_count").cast("long").alias("active_topic_count"),
    )


@query("topic_features", FEATURE_SQL)
def topic_features(spark, sf_dir):
    return feature_columns(features(spark, sf_dir, ["doc_id"]))


@query(
    "dominant_topics",
    f"""WITH {SQL_FEATURES}
SELECT dominant_topic, CAST(count(*) AS BIGINT) AS documents,
  round(avg(topic_entropy), 6) + 0.0 AS mean_entropy
FROM features WHERE dominant_topic IS NOT NULL GROUP BY dominant_topic""",
)
def dominant_topics(spark, sf_dir):
    return (
        features(spark, sf_dir, [])
        .groupBy("dominant_topic")
        .agg(
            F.count("dominant_topic").alias("documents"),
            r6(F.avg("topic_entropy")).alias("mean_entropy"),
        )
        .filter(F.col("documents") > 0)
    )


@query(
    "top_k_topics",
    f"""WITH {SQL_FEATURES}, {SQL_LONG}, positions AS (
  SELECT unnest([{QUOTED_TOPICS}]) AS topic,
    unnest(range({len(TOPIC_COLUMNS)})) AS position
), ranked AS (
  SELECT doc_id, topic, weight,
    row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, position) AS rank
  FROM long JOIN positions USING (topic) WHERE weight > 0
)
SELECT doc_id, CAST(rank AS BIGINT) AS rank, topic,
  list_aggregate(list_transform(string_split(substr(topic, 4), '_'),
    lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS display_name,
  round(weight, 6) + 0.0 AS weight
FROM ranked WHERE rank <= 5""",
)
def top_k_topics(spark, sf_dir):
    ranked = explode_top_topics(speeches(spark, sf_dir, ["doc_id"], topics=True), 5)
    return rounded(as_long(ranked, "rank"), "weight")


@query(
    "dominant_distribution",
    f"""WITH {SQL_FEATURES}
SELECT dominant_topic,
  list_aggregate(list_transform(string_split(substr(dominant_topic, 4), '_'),
    lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS display_name,
  CAST(count(*) AS BIGINT) AS documents
FROM features WHERE dominant_topic IS NOT NULL GROUP BY dominant_topic
ORDER BY documents DESC, dominant_topic LIMIT 15""",
)
def dominant_distribution(spark, sf_dir):
    return stats.dominant_distribution(features(spark, sf_dir, []), 15)


@query(
    "topic_summary",
    f"""WITH {SQL_FEATURES}, {SQL_LONG}
SELECT topic, round(avg(weight), 6) + 0.0 AS mean, round(stddev_samp(weight), 6) + 0.0 AS std,
  round(min(weight), 6) + 0.0 AS min, round(max(weight), 6) + 0.0 AS max,
  CAST(count_if(weight > 0) AS BIGINT) AS positive_documents,
  CAST(count_if(weight > 0.01) AS BIGINT) AS active_documents,
  CAST(count_if(weight > 0.1) AS BIGINT) AS high_weight_documents,
  CAST(count_if(weight = 0) AS BIGINT) AS zero_weight_documents,
  round(quantile_cont(weight, 0.25), 6) + 0.0 AS q25,
  round(quantile_cont(weight, 0.5), 6) + 0.0 AS median,
  round(quantile_cont(weight, 0.75), 6) + 0.0 AS q75
FROM long GROUP BY topic""",
)
def topic_summary(spark, sf_dir):
    summary = stats.topic_summary(speeches(spark, sf_dir, [], topics=True))
    return rounded(summary, "mean", "std", "min", "max", "q25", "median", "q75")


@query(
    "topic_diversity",
    f"""WITH {SQL_FEATURES}, row AS (
  SELECT avg(topic_entropy) AS mean_entropy, stddev_samp(topic_entropy) AS std_entropy,
    CAST(count_if(topic_entropy < 1.0) AS DOUBLE) AS low_diversity_docs,
    CAST(count_if(topic_entropy > 2.0) AS DOUBLE) AS high_diversity_docs,
    quantile_cont(topic_entropy, 0.1) AS p10, quantile_cont(topic_entropy, 0.25) AS p25,
    quantile_cont(topic_entropy, 0.5) AS p50, quantile_cont(topic_entropy, 0.75) AS p75,
    quantile_cont(topic_entropy, 0.9) AS p90
  FROM features
)
SELECT metric, round(value, 6) + 0.0 AS value FROM (UNPIVOT row ON * INTO NAME metric VALUE value)""",
)
def topic_diversity(spark, sf_dir):
    return rounded(stats.topic_diversity(features(spark, sf_dir, [])), "value")


@query(
    "active_topics",
    f"""WITH {SQL_FEATURES}, row AS (
  SELECT avg(active_topic_count) AS mean_active_topics,
    stddev_samp(active_topic_count) AS std_active_topics,
    CAST(max(active_topic_count) AS DOUBLE) AS max_active_topics,
    CAST(count_if(active_topic_count = 1) AS DOUBLE) AS single_topic_docs,
    CAST(count_if(active_topic_count > 3) AS DOUBLE) AS multi_topic_docs
  FROM features
)
SELECT metric, round(value, 6) + 0.0 AS value FROM (UNPIVOT row ON * INTO NAME metric VALUE value)""",
)
def active_topics(spark, sf_dir):
    return rounded(stats.active_topics(features(spark, sf_dir, [])), "value")


@query(
    "active_topic_distribution",
    f"""WITH {SQL_FEATURES}
SELECT CAST(active_topic_count AS BIGINT) AS active_topic_count, CAST(count(*) AS BIGINT) AS documents
FROM features GROUP BY active_topic_count ORDER BY documents DESC, active_topic_count LIMIT 10""",
)
def active_topic_distribution(spark, sf_dir):
    counts = stats.active_topic_distribution(features(spark, sf_dir, []), 10)
    return as_long(counts, "active_topic_count")


@query(
    "topic_correlations",
    f"""WITH {SQL_FEATURES}, {SQL_LONG}, positions AS (
  SELECT unnest([{QUOTED_TOPICS}]) AS topic,
    unnest(range({len(TOPIC_COLUMNS)})) AS position
), placed AS (SELECT doc_id, topic, position, weight FROM long JOIN positions USING (topic)
  WHERE weight IS NOT NULL)
SELECT topic_a, topic_b, round(cov / scale, 6) + 0.0 AS correlation FROM (
  SELECT a.topic AS topic_a, b.topic AS topic_b, covar_pop(a.weight, b.weight) AS cov,
    nullif(sqrt(var_pop(a.weight) * var_pop(b.weight)), 0) AS scale
  FROM placed a JOIN placed b ON a.doc_id = b.doc_id AND a.position < b.position
  GROUP BY a.topic, b.topic
) WHERE scale IS NOT NULL ORDER BY cov / scale DESC, topic_a, topic_b LIMIT 10""",
)
def topic_correlations(spark, sf_dir):
    return rounded(
        stats.topic_correlations(speeches(spark, sf_dir, [], topics=True), 10), "correlation"
    )


@query(
    "legislator_profile",
    f"""WITH {SQL_FEATURES}
SELECT bonica_rid, CAST(count(*) AS BIGINT) AS documents,
  {", ".join(f"round(avg({c}), 6) + 0.0 AS {c}" for c in TOPIC_COLUMNS)}
FROM features WHERE bonica_rid IS NOT NULL GROUP BY bonica_rid""",
)
def legislator_profile(spark, sf_dir):
    profiles = stats.legislator_profiles(speeches(spark, sf_dir, ["bonica_rid"], topics=True))
    return rounded(profiles, *TOPIC_COLUMNS)


@query(
    "topic_trend",
    f"""WITH {SQL_FEATURES}, {SQL_LONG}
SELECT CAST(year(TRY_CAST(date AS DATE)) AS BIGINT) AS year, topic,
  round(avg(weight), 6) + 0.0 AS mean_weight, CAST(count(weight) AS BIGINT) AS documents
FROM long WHERE TRY_CAST(date AS DATE) IS NOT NULL GROUP BY 1, 2""",
)
def topic_trend(spark, sf_dir):
    trend = stats.topic_trend(speeches(spark, sf_dir, ["date"], topics=True))
    return rounded(as_long(trend, "year"), "mean_weight")


@query(
    "congress_comparison",
    f"""WITH {SQL_FEATURES}, {SQL_LONG}, means AS (
  SELECT congno, topic, avg(weight) AS mean_weight FROM long GROUP BY congno, topic
)
SELECT m.congno AS congno, m.topic AS topic, round(m.mean_weight, 6) + 0.0 AS mean_weight,
  round(m.mean_weight - p.mean_weight, 6) + 0.0 AS change
FROM means m LEFT JOIN means p ON p.congno + 1 = m.congno AND p.topic = m.topic""",
)
def congress_comparison(spark, sf_dir):
    compared = stats.congress_comparison(speeches(spark, sf_dir, ["congno"], topics=True))
    return rounded(compared, "mean_weight", "change")
