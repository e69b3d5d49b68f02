"""Train, validation and test parts as a ``split`` column."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rostrum.operators.numbering import ROW_ID, first_shuffled, number_by_key
from rostrum.schema import spark_name

TRAIN, VALIDATION, TEST = "train", "validation", "test"

# Share and least size of the validation part, share of the
# positional train part.
VALIDATION_SHARE = 0.1
MIN_VALIDATION = 100
TRAIN_SHARE = 0.8


def split_by_flag(
    df: DataFrame,
    flag: str = "training_set",
    seed: int = 42,
    key: str = "doc_id",
    min_validation: int = MIN_VALIDATION,
) -> DataFrame:
    """Flag 1 is train, 0 is test; a tenth of train, in hash order, is validation.

    Validation has at least ``min_validation`` rows, at most all of train. Rows
    with another flag or none belong to no part and are left out. Parts follow
    from the flag and a hash of the id, without a shuffle of the rows.
    """
    column = F.col(spark_name(flag))
    train = df.filter(column == 1)
    total = train.count()
    n = min(max(min_validation, int(VALIDATION_SHARE * total)), total)
    if 0 < total == n:
        warnings.warn(f"all {total} train rows become validation", stacklevel=2)
    border = first_shuffled(train, n, seed, key)
    part = (
        F.when(column == 0, F.lit(TEST))
        .when((column == 1) & border.inside, F.lit(VALIDATION))
        .when((column == 1) & border.outside, F.lit(TRAIN))
    )
    clear = df.withColumn("split", part).filter(F.col("split").isNotNull())
    if border.edge is None:
        return clear
    edge_part = F.when(F.col("__first"), F.lit(VALIDATION)).otherwise(F.lit(TRAIN))
    return clear.unionByName(border.edge.withColumn("split", edge_part).drop("__first"))


def split_by_position(
    df: DataFrame, order_by: Sequence[str] = ("doc_id",), share: float = TRAIN_SHARE
) -> DataFrame:
    """The first share of the rows in key order is train, the rest test.

    Only the key columns are sorted, to find the key at the border; the wide
    rows are then told apart by comparing keys. Rows with the border key itself
    are numbered among themselves.
    """
    keys = list(order_by)
    numbered = number_by_key(df.select(*keys), keys)
    cut = int(share * numbered.count())
    row_key: Column = F.struct(*keys)
    at_cut = numbered.filter(F.col(ROW_ID) == cut).select(*keys).first()
    if at_cut is None:
        return df.withColumn("split", F.lit(TRAIN))
    border: Column = F.struct(
        *[F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in at_cut.asDict().items()]
    )
    start = numbered.filter(row_key == border).agg(F.min(ROW_ID)).first()[0]
    part = F.when(row_key < border, F.lit(TRAIN)).otherwise(F.lit(TEST))
    if start == cut:
        return df.withColumn("split", part)
    tied = number_by_key(df.filter(row_key == border), keys)
    tied_part = F.when(F.col(ROW_ID) < cut - start, F.lit(TRAIN)).otherwise(F.lit(TEST))
    clear = df.filter(row_key != border).withColumn("split", part)
    return clear.unionByName(tied.withColumn("split", tied_part).drop(ROW_ID))


def split_for_release(
    df: DataFrame,
    flag: str = "training_set",
    order_by: Sequence[str] = ("doc_id",),
    seed: int = 42,
    whole: bool = False,
) -> DataFrame:
    """Older rule: split by flag, without a least validation size, or else by position.

    With ``whole`` the table is not split and all of it is train. That is the caller's
    choice; the size of the table never decides it.
    """
    if whole:
        return df.withColumn("split", F.lit(TRAIN))
    if spark_name(flag) in df.columns:
        return split_by_flag(df, flag, seed, order_by[0], min_validation=0)
    return split_by_position(df, order_by)


def prepare_splits(
    df: DataFrame, flag: str = "training_set", order_by: Sequence[str] = ("doc_id",), seed: int = 42
) -> DataFrame:
    """Split by flag if the table has it, else by position."""
    if spark_name(flag) in df.columns:
        return split_by_flag(df, flag, seed, order_by[0])
    return split_by_position(df, order_by)
