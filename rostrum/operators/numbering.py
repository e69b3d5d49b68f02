"""Exact row positions 0, 1, 2, ... over a distributed table.

No step sorts the table in one task. Two ways lead to the same kind of result:

* key order: range partitions, positions counted inside each, partition offsets
  added. Range bounds are sampled anew by every job, so the numbered partitions
  are written to the shared folder before their sizes are counted.
* shuffled order: the same, by a seeded hash of the key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from rostrum.session import full_retry, materialize, shared_dir

ROW_ID = "row_id"

# Hash cells: 16^4 cells hold 1.5 GB each at 100 TB.
CELL_DIGITS = 4

_POSITION_MASK = (1 << 33) - 1


def hash_key(seed: int, key: str = "doc_id") -> Column:
    """Order of a seeded shuffle; missing keys count as ''."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def hash_cell(hashed: Column, digits: int = CELL_DIGITS) -> Column:
    """Leading hex digits as a number; cells follow the order of the hash."""
    return F.conv(F.substring(hashed, 1, digits), 16, 10).cast("int")


def row_tie(df: DataFrame) -> Column:
    """Order of rows with equal keys: by their content."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])


def _place(
    df: DataFrame, order_by: Sequence[str | Column], partitions: int | None = None, **stored: str
) -> DataFrame:
    """Stored rows with their range partition ``__part`` and place ``__pos`` in it."""
    keys = [c if isinstance(c, Column) else F.col(c) for c in order_by]
    order = [*keys, F.col("__tie"), F.col("__scan")]
    tied = df.withColumns({"__tie": row_tie(df), "__scan": F.monotonically_increasing_id()})
    ranged = (
        tied.repartitionByRange(partitions, *order)
        if partitions
        else tied.repartitionByRange(*order)
    )
    position = F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_MASK))
    placed = ranged.sortWithinPartitions(*order).withColumns(
        {"__part": F.spark_partition_id(), "__pos": position}
    )
    with full_retry(df.sparkSession):
        return materialize(placed.drop("__tie", "__scan"), "numbered", **stored)


def place_by_key(
    df: DataFrame, order_by: Sequence[str | Column], partitions: int | None = None
) -> DataFrame:
    """Rows stored in key order, in little space, for jobs that write them several times."""
    return _place(df, order_by, partitions, compression="zstd")


def number_by_key(
    df: DataFrame,
    order_by: Sequence[str | Column],
    partitions: int | None = None,
    name: str = ROW_ID,
) -> DataFrame:
    """Number rows in the order of the given columns.

    Ties are broken by the row's content, and equal rows by where they were
    read, so copies of one row spread over partitions too. The placed rows are
    stored: numbering stays the same however often it is read or an executor is
    lost. Their sizes are counted from one narrow column.
    """
    placed = _place(df, order_by, partitions)
    joined = placed.join(F.broadcast(part_offsets(placed)), "__part")
    numbered = joined.select((F.col("__offset") + F.col("__pos")).alias(name), *df.columns)
    numbered.scratch_path = placed.scratch_path
    return numbered


def part_offsets(placed: DataFrame) -> DataFrame:
    """Rows ``__n`` of each partition of :func:`_place`, and ``__offset``, those before it."""
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    # One row per partition: the only window without a partition key.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(
        "__part", "__n", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")
    )


def _cell_offsets(df: DataFrame, cell: Column) -> DataFrame:
    """Counts per hash cell with the number of rows in earlier cells."""
    counts = df.groupBy(cell.alias("__cell")).agg(F.count("*").alias("__n"))
    # At most 16^CELL_DIGITS rows, whatever the size of the table.
    before = Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        "__cell", "__n", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")
    )


def number_shuffled(
    df: DataFrame, seed: int = 42, key: str = "doc_id", name: str = ROW_ID
) -> DataFrame:
    """Number rows in the order of ``md5(seed:key)``: a reproducible global shuffle."""
    return number_by_key(df, [hash_key(seed, key), F.col(key)], name=name)


@dataclass(frozen=True)
class Border:
    """Where the first n rows of the shuffled order end.

    ``inside`` and ``outside`` hold for the rows before and after the border; both
    only look at the hash of the row's key. ``edge`` is None unless the border runs
    through rows of one key; then it has these rows, with ``__first`` true for
    those among the first n.
    """

    inside: Column
    outside: Column
    edge: DataFrame | None = None


def first_shuffled(
    df: DataFrame,
    n: int,
    seed: int = 42,
    key: str = "doc_id",
) -> Border | None:
    """Border of the first n rows in the order of :func:`number_shuffled`.

    None if the table has fewer than n rows. Two jobs over the key column find the
    cell and then the hash at which the n-th row lies; a frequent key is a single
    count to them. The rows themselves are then told apart by a filter.
    """
    shared_dir(df.sparkSession)
    if n <= 0:
        return Border(F.lit(False), F.lit(True))
    hashed = hash_key(seed, key)
    cell = hash_cell(hashed)
    holds_nth = (F.col("__offset") < n) & (F.col("__offset") + F.col("__n") >= n)
    at_cell = _cell_offsets(df, cell).filter(holds_nth).first()
    if at_cell is None:
        return None
    before = Window.partitionBy("__cell").orderBy("__hash").rowsBetween(
        Window.unboundedPreceding, -1
    )
    hashes = (
        df.filter(cell == F.lit(at_cell["__cell"]))
        .groupBy(cell.alias("__cell"), hashed.alias("__hash"))
        .agg(F.count("*").alias("__n"))
    )
    in_cell = F.coalesce(F.sum("__n").over(before), F.lit(0))
    placed = hashes.withColumn("__offset", in_cell + F.lit(at_cell["__offset"]))
    nth = placed.filter(holds_nth).first()
    at, left = F.lit(nth["__hash"]), n - nth["__offset"]
    if nth["__n"] == left:
        return Border(hashed <= at, hashed > at)
    tied = df.filter(hashed == at)
    numbered = number_by_key(tied, [key], name="__pos")
    edge = numbered.select(*df.columns, (F.col("__pos") < left).alias("__first"))
    return Border(hashed < at, hashed > at, edge)


def rows_at(numbered: DataFrame, positions: int | slice | Sequence[int] | DataFrame) -> DataFrame:
    """Rows of a numbered table by position.

    A number, a slice or a list as in Python, negative positions from the end; a
    position that the table does not have raises. A list gives its rows in its order, a
    repeated position its row again. A DataFrame with a ``row_id`` column serves very
    long lists; its positions are joined as they are.
    """
    if isinstance(positions, DataFrame):
        return numbered.join(positions.select(ROW_ID), ROW_ID)
    if isinstance(positions, bool) or not isinstance(positions, (int, slice, list, tuple)):
        raise TypeError(f"invalid index type: {type(positions).__name__}")
    row = F.col(ROW_ID)
    if isinstance(positions, slice):
        wanted = [positions.start, positions.stop, positions.step]
        if all(v is None or v >= 0 for v in wanted):
            start, step = positions.start or 0, 1 if positions.step is None else positions.step
            if step == 0:
                raise ValueError("slice step cannot be zero")
            rule = row >= start
            if positions.stop is not None:
                rule = rule & (row < positions.stop)
            if step != 1:
                rule = rule & (F.pmod(row - start, F.lit(step)) == 0)
            return numbered.filter(rule)
        chosen = range(*positions.indices(numbered.count()))
        if not chosen:
            return numbered.limit(0)
        low, high = min(chosen[0], chosen[-1]), max(chosen[0], chosen[-1])
        stride = F.pmod(row - chosen[0], F.lit(abs(chosen.step)))
        return numbered.filter(row.between(low, high) & (stride == 0))
    listed = [positions] if isinstance(positions, int) else list(positions)
    total = numbered.count()
    outside = [p for p in listed if not -total <= p < total]
    if outside:
        raise IndexError(f"no rows at positions {outside[:10]}, the table has {total}")
    if not listed:
        return numbered.limit(0)
    places = [(i, p + total if p < 0 else p) for i, p in enumerate(listed)]
    wanted = numbered.sparkSession.createDataFrame(places, f"__place long, {ROW_ID} long")
    return numbered.join(F.broadcast(wanted), ROW_ID).orderBy("__place").drop("__place")


def look_up(
    df: DataFrame,
    positions: int | slice | Sequence[int] | DataFrame,
    order_by: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Rows by position in key order, with ``row_id``, without storing the table.

    Keys and a hash of the row are numbered and stored; the rows with the keys found are
    then filtered out of the table, where they lie, before anything is shuffled. Equal rows
    take the positions of each other. ``operators.positions`` serves many look-ups.
    """
    keys = list(order_by)
    tied = df.withColumn("__row", row_tie(df))
    narrow = tied.select(*keys, "__row")
    found = rows_at(number_by_key(narrow, [*keys, "__row"]), positions)
    found = found.withColumn("__place", F.monotonically_increasing_id())
    match = F.lit(True)
    for name in [*keys, "__row"]:
        match = match & F.col(f"t.`{name}`").eqNullSafe(F.col(f"f.`{name}`"))
    wanted = found.select(*keys, "__row").distinct()
    if not isinstance(positions, (slice, DataFrame)):
        # As many rows as the list has positions.
        wanted = F.broadcast(wanted)
    held = tied.alias("t").join(wanted.alias("f"), match, "left_semi")
    once = held.dropDuplicates([*keys, "__row"])
    rows = once.alias("t").join(found.alias("f"), match)
    chosen = rows.select("f.__place", f"f.{ROW_ID}", *[F.col(f"t.`{c}`") for c in df.columns])
    return chosen.orderBy("__place").drop("__place")
