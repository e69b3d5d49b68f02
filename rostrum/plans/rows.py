"""Queries on row positions, batches, shards and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.operators import batches, dictionaries, epochs, splits
from rostrum.operators.numbering import ROW_ID, look_up, number_by_key
from rostrum.plans.registry import as_double, as_long, query
from rostrum.plans.speech_view import SQL_SPEECHES, speeches
from rostrum.schema import TOPIC_COLUMNS
from rostrum.session import materialize
from rostrum.sources.writers import with_shards

_NUMBERED = f"""WITH {SQL_SPEECHES}, numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM speeches
), shuffled AS (
  SELECT *, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS row_id FROM speeches
)"""


@query(
    "row_lookup",
    f"""{_NUMBERED}
SELECT CAST(row_id AS BIGINT) AS row_id, doc_id, congno, 'slice' AS kind FROM numbered
WHERE row_id >= 10 AND row_id < 80 AND (row_id - 10) % 7 = 0
UNION ALL SELECT CAST(row_id AS BIGINT), doc_id, congno, 'list' FROM numbered JOIN (
  SELECT unnest([0, 3, 199, (SELECT count(*) - 1 FROM speeches)]) AS position
) ON row_id = position
UNION ALL SELECT CAST(row_id AS BIGINT), doc_id, congno, 'single' FROM numbered WHERE row_id = 42""",
)
def row_lookup(spark, sf_dir):
    view = speeches(spark, sf_dir, ["doc_id", "congno"])
    kinds = {"slice": slice(10, 80, 7), "list": [0, 3, 199, -1], "single": 42}
    found = [look_up(view, p).withColumn("kind", F.lit(k)) for k, p in kinds.items()]
    return as_long(found[0].unionByName(found[1]).unionByName(found[2]), "row_id")


@query(
    "batches",
    f"""{_NUMBERED}
SELECT CAST(row_id // 32 AS BIGINT) AS batch_id, CAST(row_id AS BIGINT) AS row_id, doc_id
FROM shuffled""",
)
def shuffled_batches(spark, sf_dir):
    return as_long(batches.with_batches(speeches(spark, sf_dir, ["doc_id"])), "row_id")


@query(
    "ordered_batches",
    f"""{_NUMBERED}
SELECT CAST(row_id // 25 AS BIGINT) AS batch_id, CAST(row_id AS BIGINT) AS row_id, doc_id
FROM numbered""",
)
def ordered_batches(spark, sf_dir):
    view = speeches(spark, sf_dir, ["doc_id"])
    return as_long(batches.with_batches(view, 25, shuffle=False), "row_id")


@query(
    "batch_arrays",
    f"""{_NUMBERED}
SELECT CAST(row_id // 32 AS BIGINT) AS batch_id, CAST(count(*) AS BIGINT) AS documents,
  string_agg(doc_id, ',' ORDER BY row_id) AS ids, string_agg(congno, ',' ORDER BY row_id) AS congresses
FROM shuffled GROUP BY 1""",
)
def batch_arrays(spark, sf_dir):
    batched = batches.with_batches(speeches(spark, sf_dir, ["doc_id", "congno"]))
    columnar = batches.columnar_batches(batched)
    return columnar.select(
        "batch_id",
        F.size("doc_id").cast("long").alias("documents"),
        F.array_join("doc_id", ",").alias("ids"),
        F.array_join(F.col("congno").cast("array<string>"), ",").alias("congresses"),
    )


@query(
    "shard_batches",
    f"""{_NUMBERED}
SELECT 'documents.parquet' AS shard, CAST(row_id // 64 AS BIGINT) AS batch_id,
  CAST(row_id AS BIGINT) AS row_id, doc_id FROM shuffled""",
)
def shard_batches(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("_metadata.file_name").alias("shard")
    )
    return batches.with_shard_batches(documents, batch_size=64)


def epoch_sql(epoch: int) -> str:
    """Query for ``row_id, position`` in an epoch, over a table ``numbered``.

    The size of the table, and with it the bases of the digits, is known to SQL only.
    """
    digits = "SELECT row_id, value // b AS x, value % b AS y, a, b, n FROM walk_{e}, size"
    inner = digits.format(e=epoch) + " WHERE steps = 0 OR value >= n"
    inner = inner.replace("SELECT row_id,", "SELECT row_id, steps,")
    for i, (factor, summand) in enumerate(epochs.Epoch(0, epoch=epoch).keys):
        moved, given, base = ("y", "x", "b") if i % 2 else ("x", "y", "a")
        mixed = f"(({given} * {factor} + {summand}) % {epochs.PRIME})"
        change = f"(({mixed} * {mixed} % {epochs.PRIME}) >> 8) % {base}"
        inner = f"SELECT * REPLACE (({moved} + {change}) % {base} AS {moved}) FROM ({inner})"
    return f"""size AS (
  SELECT n, a, CAST(ceil(n / a) AS BIGINT) AS b
  FROM (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM numbered)
), walk_{epoch} AS (
  SELECT CAST(row_id AS BIGINT) AS row_id, CAST(row_id AS BIGINT) AS value, 0 AS steps FROM numbered
  UNION ALL SELECT row_id, x * b + y, steps + 1 FROM ({inner})
), placed AS (
  SELECT row_id, max_by(value, steps) AS position FROM walk_{epoch} GROUP BY row_id
)"""


@query(
    "epoch_batches",
    f"""{_NUMBERED.replace("WITH", "WITH RECURSIVE", 1)}, {epoch_sql(3)}
SELECT row_id, position, position // 32 AS batch_id, doc_id FROM placed JOIN numbered USING (row_id)""",
)
def epoch_batches(spark, sf_dir):
    """Batches of the epoch after the third, computed from the rows' numbers."""
    numbered = number_by_key(speeches(spark, sf_dir, ["doc_id"]), ["doc_id"])
    placed = epochs.with_epoch_batches(numbered, numbered.count(), epoch=3)
    return placed.select(F.col(ROW_ID).cast("long").alias(ROW_ID), "position", "batch_id", "doc_id")


@query(
    "feature_vectors",
    f"""WITH {SQL_SPEECHES}, arrays AS (
  SELECT doc_id, [{", ".join(f"CAST({c} AS FLOAT)" for c in TOPIC_COLUMNS)},
    CAST(congno AS FLOAT), CAST(training_set AS FLOAT)] AS v FROM speeches
)
SELECT doc_id, CAST(len(v) AS BIGINT) AS width,
  CAST(len(list_filter(v, lambda x: x IS NULL)) AS BIGINT) AS missing,
  CAST(v[1] AS DOUBLE) AS first_weight, CAST(v[26] AS DOUBLE) AS congno FROM arrays""",
)
def feature_vectors(spark, sf_dir):
    view = speeches(spark, sf_dir, ["doc_id", "congno", "training_set"], topics=True)
    vectors = batches.with_feature_vector(view)
    vector = F.col("features")
    return vectors.select(
        "doc_id",
        F.size(vector).cast("long").alias("width"),
        F.size(F.filter(vector, lambda x: x.isNull())).cast("long").alias("missing"),
        vector[0].cast("double").alias("first_weight"),
        vector[25].cast("double").alias("congno"),
    )


@query(
    "shards",
    f"""{_NUMBERED}
SELECT CAST(row_id // 64 AS BIGINT) AS shard_id, CAST(count(*) AS BIGINT) AS documents,
  min(doc_id) AS first_id, max(doc_id) AS last_id FROM numbered GROUP BY 1""",
)
def shards(spark, sf_dir):
    sharded = with_shards(speeches(spark, sf_dir, ["doc_id"]), 64)
    return sharded.groupBy("shard_id").agg(
        F.count("*").alias("documents"),
        F.min("doc_id").alias("first_id"),
        F.max("doc_id").alias("last_id"),
    )


def _flag_split_sql(minimum: int) -> str:
    return f"""WITH {SQL_SPEECHES}, train AS (
  SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS r FROM speeches
  WHERE training_set = 1
), size AS (SELECT least(greatest({minimum}, CAST(floor(0.1 * count(*)) AS BIGINT)), count(*)) AS n FROM train)
SELECT doc_id, CASE WHEN r < n THEN 'validation' ELSE 'train' END AS split FROM train, size
UNION ALL SELECT doc_id, 'test' FROM speeches WHERE training_set = 0"""


@query("train_val_test", _flag_split_sql(100))
def train_val_test(spark, sf_dir):
    view = speeches(spark, sf_dir, ["doc_id", "training_set"])
    return splits.split_by_flag(view).select("doc_id", "split")


@query(
    "positional_split",
    f"""{_NUMBERED}
SELECT doc_id, CASE WHEN row_id < CAST(floor(0.8 * (SELECT count(*) FROM speeches)) AS BIGINT)
  THEN 'train' ELSE 'test' END AS split FROM numbered""",
)
def positional_split(spark, sf_dir):
    return splits.split_by_position(speeches(spark, sf_dir, ["doc_id"]))


@query("release_split", _flag_split_sql(0))
def release_split(spark, sf_dir):
    view = speeches(spark, sf_dir, ["doc_id", "training_set"])
    return splits.split_for_release(view).select("doc_id", "split")


_STRINGS = ("legis_body", "bonica_rid", "doc_type", "page_id", "date")


@query(
    "category_codes",
    f"""WITH {SQL_SPEECHES}, tall AS (
  {" UNION ALL ".join(f"SELECT doc_id, '{c}' AS category, {c} AS value FROM speeches" for c in _STRINGS)}
), chosen AS (
  SELECT category FROM tall GROUP BY category HAVING count(DISTINCT value) < 0.5 * count(*)
)
SELECT doc_id, category, value, CAST(CASE WHEN value IS NOT NULL THEN
  dense_rank() OVER (PARTITION BY category ORDER BY value NULLS LAST) - 1 END AS DOUBLE) AS code
FROM tall JOIN chosen USING (category)""",
)
def category_codes(spark, sf_dir):
    """String columns of few values as codes of a shared dictionary, and back."""
    # Read four times; and stored, the constant column is a column like the others.
    view = materialize(speeches(spark, sf_dir, ["doc_id", *_STRINGS]), "strings")
    chosen = dictionaries.category_columns(view, _STRINGS)
    words = dictionaries.build_dictionary(view, chosen)
    codes = dictionaries.encode(view, words, chosen)
    values = dictionaries.decode(codes, words, chosen).unpivot("doc_id", chosen, "category", "value")
    told = codes.unpivot("doc_id", chosen, "category", "code").transform(as_double, "code")
    return values.join(told, ["doc_id", "category"])
