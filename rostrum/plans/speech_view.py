"""The speech table as a view over the test tables, in Spark and in SQL.

``documents`` give id, text, congress and body; ``orders`` date and legislator;
``labels`` the training flag; ``embeddings`` the 25 topic weights.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from rostrum.operators.features import with_topic_features
from rostrum.schema import TOPIC_COLUMNS
from rostrum.sources.writers import stored_bytes

DOCUMENT_COLUMNS = {
    "doc_id": "CAST(doc_id AS STRING)",
    "bill_id": "CAST(NULL AS STRING)",
    "page_id": "CAST(doc_id DIV 10 AS STRING)",
    "text": "text",
    "stemmed_text": "lower(text)",
    "congno": "102 + CAST(regexp_extract(source, '[0-9]+', 0) AS BIGINT)",
    "legis_body": "CASE lang WHEN 'en' THEN 'US House' WHEN 'fr' THEN 'US Senate' END",
    "doc_type": "'speech'",
}
ORDER_COLUMNS = {
    "bonica_rid": "CAST(o_custkey AS STRING)",
    "date": "date_format(o_orderdate, 'yyyy-MM-dd')",
}
VIEW_COLUMNS = (
    "doc_id",
    "bonica_rid",
    "bill_id",
    "page_id",
    "text",
    "stemmed_text",
    "date",
    "congno",
    "legis_body",
    "training_set",
    "doc_type",
    *TOPIC_COLUMNS,
)


# The tables the view reads. With the schema given, no job reads the file footers.
TABLE_SCHEMAS = {
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderdate TIMESTAMP_NTZ",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
}
# Below this size a table may sit in one file split, i.e. in one task.
SMALL_TABLE_BYTES = 256 * 1024**2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str, with_text: bool) -> DataFrame:
    """Documents; the texts of a small table are dealt out to all cores by id.

    Text patterns are the expensive part of the queries, and a small file is one
    task. A large table has enough splits and is left as it is.
    """
    documents = _table(spark, sf_dir, "documents")
    if with_text and stored_bytes(spark, f"{sf_dir}/documents.parquet") < SMALL_TABLE_BYTES:
        return documents.repartition(spark.sparkContext.defaultParallelism, "doc_id")
    return documents


def _weights(embeddings: DataFrame) -> DataFrame:
    """Positive parts cubed and divided by their sum, one column per topic.

    ``inline`` makes the weights plain columns to the optimizer, as in a stored
    speech table; otherwise it would copy their formula into every feature.
    """
    first = F.slice("embedding", 1, len(TOPIC_COLUMNS)).cast("array<double>")
    positive = F.transform(first, lambda e: F.when(e > 0, e).when(e <= 0, 0.0))
    cubes = embeddings.select("vec_id", F.transform(positive, lambda p: p * p * p).alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda a, p: a + p)
    shares = ", ".join(f"get(p, {i}) / s AS {c}" for i, c in enumerate(TOPIC_COLUMNS))
    summed = cubes.withColumn("s", F.nullif(total, F.lit(0.0)))
    return summed.selectExpr("vec_id", f"inline(array(struct({shares})))")


def attach(documents: DataFrame, spark: SparkSession, sf_dir: str, wanted: Sequence[str]) -> DataFrame:
    """Speech columns for (possibly streaming) documents.

    All joins are on the document id, so a large table is shuffled once at most;
    tables that give none of the wanted columns are not joined.
    """
    names = [c for c in VIEW_COLUMNS if c in wanted]
    # The stems come from the text after the joins, which would shuffle it twice otherwise.
    stems = DOCUMENT_COLUMNS["stemmed_text"]
    joined = {"text" if c == "stemmed_text" else c for c in names}
    view = documents.selectExpr(
        "doc_id AS __id",
        *[f"{sql} AS {c}" for c, sql in DOCUMENT_COLUMNS.items() if c in joined],
    )
    if set(names) & set(ORDER_COLUMNS):
        orders = _table(spark, sf_dir, "orders").selectExpr(
            "o_orderkey AS __id",
            *[f"{sql} AS {c}" for c, sql in ORDER_COLUMNS.items() if c in names],
        )
        view = view.join(orders, "__id", "left")
        if "date" in names:
            bad = F.col("__id") % 37 == 0
            view = view.withColumn("date", F.when(bad, "n/a").otherwise(F.col("date")))
    if "training_set" in names:
        labels = _table(spark, sf_dir, "labels").selectExpr(
            "doc_id AS __id", "CAST(quality AS INT) AS training_set"
        )
        view = view.join(labels, "__id", "left")
    topics = [c for c in TOPIC_COLUMNS if c in names]
    if topics:
        weights = _weights(_table(spark, sf_dir, "embeddings"))
        view = view.join(
            weights.select(F.col("vec_id").alias("__id"), *topics), "__id", "left"
        )
    return view.selectExpr(*[f"{stems} AS {c}" if c == "stemmed_text" else c for c in names])


def speeches(
    spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None, topics: bool = False
) -> DataFrame:
    """The speech view with the given columns (all by default), plus all topics if asked."""
    wanted = list(columns) if columns is not None else list(VIEW_COLUMNS)
    if topics:
        wanted += TOPIC_COLUMNS
    with_text = bool({"text", "stemmed_text"} & set(wanted))
    return attach(_documents(spark, sf_dir, with_text), spark, sf_dir, wanted)


def features(spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Speech view with topic weights and topic features."""
    return with_topic_features(speeches(spark, sf_dir, columns, topics=columns is not None))


# ---- the same view as SQL common table expressions --------------------------------


def _list(template: str, separator: str = ", ") -> str:
    return separator.join(template.format(i=i, c=c) for i, c in enumerate(TOPIC_COLUMNS))


SQL_SPACE = r"trim(regexp_replace(coalesce({c}, ''), '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g'))"

SQL_SPEECHES = f"""
entries AS (
  SELECT vec_id, {_list("CAST(embedding[{i} + 1] AS DOUBLE) AS e{i}")} FROM embeddings
), cubes AS (
  SELECT vec_id, {_list("CASE WHEN e{i} > 0 THEN e{i} * e{i} * e{i} WHEN e{i} <= 0 THEN 0.0 END AS p{i}")}
  FROM entries
), sums AS (
  SELECT *, nullif({_list("p{i}", " + ")}, 0) AS s FROM cubes
), weights AS (
  SELECT vec_id, {_list("p{i} / s AS {c}")} FROM sums
), speeches AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, CAST(o.o_custkey AS VARCHAR) AS bonica_rid,
    CAST(NULL AS VARCHAR) AS bill_id, CAST(d.doc_id // 10 AS VARCHAR) AS page_id,
    d.text AS text, lower(d.text) AS stemmed_text,
    CASE WHEN d.doc_id % 37 = 0 THEN 'n/a' ELSE strftime(o.o_orderdate, '%Y-%m-%d') END AS date,
    102 + CAST(regexp_extract(d.source, '[0-9]+') AS BIGINT) AS congno,
    CASE d.lang WHEN 'en' THEN 'US House' WHEN 'fr' THEN 'US Senate' END AS legis_body,
    CAST(l.quality AS INTEGER) AS training_set, 'speech' AS doc_type,
    {_list("w.{c}")}
  FROM documents d LEFT JOIN orders o ON o.o_orderkey = d.doc_id
  LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN weights w ON w.vec_id = d.doc_id
)"""

SQL_FEATURES = f"""{SQL_SPEECHES}, totals AS (
  SELECT *, greatest({_list("{c}")}) AS max_topic_weight,
    ({_list("{c}", " + ")}) + CAST(1e-10 AS DOUBLE) AS t FROM speeches
), features AS (
  SELECT * EXCLUDE (t),
    CASE {_list("WHEN {c} = max_topic_weight THEN '{c}'", " ")} END AS dominant_topic,
    -({_list("({c} / t) * ln({c} / t + CAST(1e-10 AS DOUBLE))", " + ")}) AS topic_entropy,
    {_list("(CASE WHEN {c} > 0.01 THEN 1 ELSE 0 END)", " + ")} AS active_topic_count
  FROM totals
)"""

SQL_LONG = f"""long AS (
  SELECT doc_id, congno, date, unnest([{_list("'{c}'")}]) AS topic, unnest([{_list("{c}")}]) AS weight
  FROM features
)"""


def _sql_mode(column: str) -> str:
    return (
        f"(SELECT {column} FROM kept WHERE {column} IS NOT NULL "
        f"GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT 1)"
    )


SQL_CLEANED = f"""{SQL_FEATURES}, kept AS (
  SELECT * FROM (
    SELECT * REPLACE ({SQL_SPACE.format(c="text")} AS text,
      {SQL_SPACE.format(c="stemmed_text")} AS stemmed_text) FROM features
  ) WHERE length(text) >= 10
), cleaned AS (
  SELECT * REPLACE (TRY_CAST(date AS DATE) AS date,
      coalesce(legis_body, {_sql_mode("legis_body")}, 'unknown') AS legis_body,
      coalesce(doc_type, {_sql_mode("doc_type")}, 'unknown') AS doc_type,
      coalesce(bonica_rid, '') AS bonica_rid, coalesce(bill_id, '') AS bill_id,
      coalesce(page_id, '') AS page_id, coalesce(doc_id, '') AS doc_id,
      coalesce(training_set, 0) AS training_set,
      {_list("greatest(0.0, least(1.0, coalesce({c}, 0.0))) AS {c}")}),
    year(TRY_CAST(date AS DATE)) AS year, month(TRY_CAST(date AS DATE)) AS month,
    dayofyear(TRY_CAST(date AS DATE)) AS day_of_year,
    (year(TRY_CAST(date AS DATE)) // 10) * 10 AS decade
  FROM kept
)"""
