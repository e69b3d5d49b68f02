"""Statistics from sketches that are stored per shard and merged for any subset.

:func:`shard_sketches` reads a table once and leaves one row per shard and measure:
number, mean, spread, range and a quantile sketch of numbers, a distinct sketch of
identifiers. :func:`summary` and :func:`distinct_counts` merge the rows of the shards
asked for and read no documents. Numbers, means, deviations and ranges are exact;
quantiles have a rank error of about 0.4 % (``QUANTILE_SIZE``), distinct counts a relative
one of about 0.8 % (``DISTINCT_BITS``), however many shards are merged.

Missing values are skipped. A measure without any value has n = 0 and no other result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rostrum.functions import text as tx
from rostrum.schema import topic_columns
from rostrum.session import path_exists

QUANTILE_SIZE = 800
DISTINCT_BITS = 14
IDENTIFIERS = ("doc_id", "bonica_rid")
QUARTILES = {0.25: "q25", 0.5: "median", 0.75: "q75"}
_FEATURES = ("max_topic_weight", "topic_entropy", "active_topic_count")


def _measures(df: DataFrame) -> dict[str, Column]:
    found = {c: F.col(c) for c in (*topic_columns(df), *_FEATURES) if c in df.columns}
    if "text" in df.columns:
        found["text_length"] = F.length("text")
        found["text_words"] = F.when(F.col("text").isNotNull(), tx.word_count(F.col("text")))
    return found


def shard_sketches(
    df: DataFrame, by: str = "shard", identifiers: Sequence[str] = IDENTIFIERS
) -> DataFrame:
    """``(shard, measure, n, mean, spread, min, max, quantiles, distinct)`` per shard and measure.

    Measures are topic weights, features and text sizes as far as the table has them,
    and the identifiers, which have n and the distinct sketch only. ``spread`` is the sum
    of squares about the shard's mean. Sketches are built in the tasks that read the
    rows; only they are shuffled, so a shard of any size is spread over tasks.
    """
    measures = _measures(df)
    names = [c for c in identifiers if c in df.columns]
    staged = df.select(
        F.col(by).alias("shard"),
        *[m.cast("double").alias(f"m{i}") for i, m in enumerate(measures.values())],
        *[F.col(c).cast("string").alias(f"d{i}") for i, c in enumerate(names)],
    )
    aggregates, entries = [], []
    for i, name in enumerate(measures):
        value = F.col(f"m{i}")
        parts = {
            "n": F.count(value),
            "mean": F.avg(value),
            "spread": F.var_pop(value) * F.count(value),
            "min": F.min(value),
            "max": F.max(value),
            "quantiles": F.kll_sketch_agg_double(value, F.lit(QUANTILE_SIZE)),
        }
        aggregates.append(F.struct(*[p.alias(k) for k, p in parts.items()]).alias(f"s{i}"))
        entries.append(
            f"named_struct('measure', '{name}', 'n', s{i}.n, 'mean', s{i}.mean, 'spread', s{i}.spread, "
            f"'min', s{i}.min, 'max', s{i}.max, 'quantiles', s{i}.quantiles, "
            "'distinct', CAST(NULL AS BINARY))"
        )
    nothing = ", ".join(
        f"'{c}', CAST(NULL AS {t})"
        for c, t in [*((c, "DOUBLE") for c in ("mean", "spread", "min", "max")), ("quantiles", "BINARY")]
    )
    for i, name in enumerate(names):
        value = F.col(f"d{i}")
        sketch = F.hll_sketch_agg(value, F.lit(DISTINCT_BITS))
        aggregates.append(F.struct(F.count(value).alias("n"), sketch.alias("distinct")).alias(f"i{i}"))
        entries.append(
            f"named_struct('measure', '{name}', 'n', i{i}.n, {nothing}, 'distinct', i{i}.distinct)"
        )
    if not entries:
        raise ValueError("the table has no column to sketch")
    return staged.groupBy("shard").agg(*aggregates).selectExpr(
        "shard", f"inline(array({', '.join(entries)}))"
    )


def add_sketches(
    df: DataFrame, path: str, by: str = "shard", identifiers: Sequence[str] = IDENTIFIERS
) -> DataFrame:
    """Sketch the shards that the table at ``path`` does not have yet, and return it as a whole.

    Shards count as done by their name; one that is written anew needs a new name or a new
    table. Rows whose shard is missing are sketched together, once.
    """
    spark = df.sparkSession
    if path_exists(spark, path):
        done = spark.read.parquet(path).select(F.col("shard").alias("__done")).distinct()
        new = df.join(done, F.col(by).eqNullSafe(F.col("__done")), "left_anti")
    else:
        new = df
    shard_sketches(new, by, identifiers).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def summary(sketches: DataFrame, names: Mapping[float, str] = QUARTILES) -> DataFrame:
    """``(measure, n, mean, std, min, max, <quantiles>)`` over all rows given.

    Spreads are added about the common mean, so nothing cancels for many rows.
    """
    numbers = sketches.filter(F.col("quantiles").isNotNull())
    means = numbers.groupBy("measure").agg(
        (F.sum(F.col("n") * F.col("mean")) / F.nullif(F.sum("n"), F.lit(0))).alias("__mean")
    )
    apart = F.col("mean") - F.col("__mean")
    merged = (
        numbers.join(means, "measure")
        .groupBy("measure")
        .agg(
            F.sum("n").alias("n"),
            F.first("__mean").alias("mean"),
            F.sum(F.col("spread") + F.col("n") * apart * apart).alias("spread"),
            F.min("min").alias("min"),
            F.max("max").alias("max"),
            F.kll_merge_agg_double("quantiles").alias("quantiles"),
        )
    )
    ranks = F.array(*[F.lit(float(p)) for p in names])
    # An empty sketch has no quantiles and would raise.
    found = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("quantiles", ranks))
    return merged.select(
        "measure",
        "n",
        "mean",
        F.when(F.col("n") > 1, F.sqrt(F.col("spread") / (F.col("n") - 1))).alias("std"),
        "min",
        "max",
        *[F.get(found, F.lit(i)).alias(name) for i, name in enumerate(names.values())],
    )


def distinct_counts(sketches: DataFrame) -> DataFrame:
    """``(measure, n, distinct_values)`` of the identifiers, over all rows given."""
    merged = (
        sketches.filter(F.col("distinct").isNotNull())
        .groupBy("measure")
        .agg(F.sum("n").alias("n"), F.hll_union_agg("distinct").alias("distinct"))
    )
    return merged.select("measure", "n", F.hll_sketch_estimate("distinct").alias("distinct_values"))
