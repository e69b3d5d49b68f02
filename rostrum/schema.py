"""The speech table: column names, types and the topic dimension."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

TOPIC_PREFIX = "tw_"

# Topic names in column order (ties go to the earlier one).
TOPIC_NAMES = (
    "latent1",
    "abortion.and.social.conservatism",
    "agriculture",
    "banking.and.finance",
    "civil.rights",
    "congress.and.procedural",
    "crime",
    "defense.and.foreign.policy",
    "economy",
    "education",
    "energy",
    "environment",
    "fair.elections",
    "federal.agencies.and.gov.regulation",
    "guns",
    "healthcare",
    "higher.education",
    "immigration",
    "indian.affairs",
    "intelligence.and.surveillance",
    "labor",
    "law.courts.and.judges",
    "transportation",
    "veterans.affairs",
    "womens.issues",
)

# Column names as published, before the dots are renamed.
PUBLISHED_COLUMNS = {
    "doc.id": T.StringType(),
    "bonica.rid": T.StringType(),
    "bill.id": T.StringType(),
    "page.id": T.StringType(),
    "text": T.StringType(),
    "stemmed.text": T.StringType(),
    "date": T.StringType(),
    "congno": T.LongType(),
    "legis.body": T.StringType(),
    "training.set": T.IntegerType(),
    "doc.type": T.StringType(),
    **{f"tw.{name}": T.DoubleType() for name in TOPIC_NAMES},
}

ID_COLUMNS = ("doc_id", "bonica_rid", "bill_id", "page_id")
TEXT_COLUMNS = ("text", "stemmed_text")
CATEGORY_COLUMNS = ("legis_body", "doc_type")

# Thresholds shared by several operators.
ACTIVE_WEIGHT = 0.01
HIGH_WEIGHT = 0.1
MIN_TEXT_LENGTH = 10
FIRST_CONGRESS, LAST_CONGRESS = 100, 120


def spark_name(published: str) -> str:
    """Column name without dots, so it never needs backticks."""
    return published.replace(".", "_")


TOPIC_COLUMNS = tuple(spark_name(f"tw.{name}") for name in TOPIC_NAMES)

SPEECH_SCHEMA = T.StructType(
    [
        T.StructField(spark_name(name), dtype, True, {"published_name": name})
        for name, dtype in PUBLISHED_COLUMNS.items()
    ]
)


# Types of the columns that cleaning and features add, for formats without types.
DERIVED_COLUMNS = {
    "dominant_topic": T.StringType(),
    "max_topic_weight": T.DoubleType(),
    "topic_entropy": T.DoubleType(),
    "active_topic_count": T.IntegerType(),
    "year": T.IntegerType(),
    "month": T.IntegerType(),
    "day_of_year": T.IntegerType(),
    "decade": T.IntegerType(),
}
STORED_SCHEMA = T.StructType(
    SPEECH_SCHEMA.fields + [T.StructField(n, t, True) for n, t in DERIVED_COLUMNS.items()]
)


def topic_columns(columns: DataFrame | Iterable[str]) -> list[str]:
    """Topic weight columns in table order."""
    names = columns.columns if isinstance(columns, DataFrame) else columns
    return [c for c in names if c.startswith(TOPIC_PREFIX)]


def topic_file_name(column: str) -> str:
    """``tw_civil_rights`` or ``tw.civil.rights`` -> ``civil_rights``."""
    return spark_name(column).removeprefix(TOPIC_PREFIX)


def topic_display_name(column: str) -> str:
    """``tw_civil_rights`` -> ``Civil Rights``."""
    return topic_file_name(column).replace("_", " ").title()


def to_spark_names(df: DataFrame) -> DataFrame:
    """Rename dotted columns once; the published name stays in the metadata."""
    return df.select(
        *[
            F.col(f"`{c}`").alias(spark_name(c), metadata={"published_name": c})
            if "." in c
            else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def to_published_names(df: DataFrame) -> DataFrame:
    """Undo :func:`to_spark_names` from the column metadata."""
    return df.select(
        *[
            F.col(f"`{f.name}`").alias(f.metadata.get("published_name", f.name))
            for f in df.schema.fields
        ]
    )


def nan_to_null(df: DataFrame) -> DataFrame:
    """Spark ranks NaN above every number, so missing values are NULL from ingest on."""
    floats = {
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    if not floats:
        return df

    def cleaned(c: str) -> Column:
        value = F.expr(f"CASE WHEN NOT isnan(`{c}`) THEN `{c}` END")
        return value.alias(c, metadata=df.schema[c].metadata)

    return df.select(*[cleaned(c) if c in floats else F.col(f"`{c}`") for c in df.columns])
