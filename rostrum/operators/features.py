"""Topic features as added columns: row-wise, no shuffle, also on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rostrum.functions import topics as tf
from rostrum.schema import ACTIVE_WEIGHT, topic_columns

FEATURE_COLUMNS = ("dominant_topic", "max_topic_weight", "topic_entropy", "active_topic_count")

_TOTAL = "__weight_total"


def with_topic_features(df: DataFrame, active_weight: float = ACTIVE_WEIGHT) -> DataFrame:
    """Add dominant topic, maximum weight, entropy and active-topic count.

    The maximum and the sum get a projection of their own, so that they are
    computed once per row and not once per topic. Features that exist already
    are recomputed. A table without topic columns is returned unchanged.
    """
    cols = topic_columns(df)
    if not cols:
        return df
    kept = [c for c in df.columns if c not in FEATURE_COLUMNS]
    staged = df.select(
        *kept,
        tf.max_weight(cols).alias("max_topic_weight"),
        tf.strict_weight_sum(cols).alias(_TOTAL),
    )
    return staged.select(
        *kept,
        tf.dominant_topic(cols, "max_topic_weight").alias("dominant_topic"),
        "max_topic_weight",
        tf.entropy(cols, _TOTAL).alias("topic_entropy"),
        tf.active_count(cols, active_weight).alias("active_topic_count"),
    )


def refresh_features(df: DataFrame, active_weight: float = ACTIVE_WEIGHT) -> DataFrame:
    """Recompute the features, e.g. after cleaning changed the weights."""
    return with_topic_features(df, active_weight)


def with_top_topics(df: DataFrame, k: int = 5, name: str = "top_topics") -> DataFrame:
    """Add the k largest positive weights per document, without a shuffle."""
    return df.withColumn(name, tf.top_k(topic_columns(df), k))


def explode_top_topics(df: DataFrame, k: int = 5, key: str = "doc_id") -> DataFrame:
    """One row per document and rank: ``key, rank, topic, display_name, weight``."""
    ranked = df.select(key, F.posexplode(tf.top_k(topic_columns(df), k)).alias("pos", "entry"))
    return ranked.select(
        key,
        (F.col("pos") + 1).alias("rank"),
        F.col("entry.topic").alias("topic"),
        tf.display_name(F.col("entry.topic")).alias("display_name"),
        F.col("entry.weight").alias("weight"),
    )


def long_weights(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``(keys, topic, weight)``: the view for per-topic aggregation."""
    cols = topic_columns(df)
    return df.select(*(keys or []), *cols).unpivot(keys or [], cols, "topic", "weight")
