"""Exact quantiles without collecting or globally sorting the values.

``percentile`` keeps every distinct value of a group in one buffer. Here each
pass narrows down where the wanted ranks lie instead:

1. count values per coarse cell (a logarithmic grid that follows the order of
   the values), combined on the map side;
2. in the cells with a wanted rank, count values per cell of a linear grid;
3. in the few cells with a wanted rank, count per distinct value and read the
   values at the ranks.

Only cell counts are shuffled in the first two passes, and the third sees a small
share of the rows. Equal values collapse into one count, so a value that makes up
a third of the rows costs nothing extra. What comes to the driver between the
passes is one row per group and probability.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

GRID_PER_E_FOLD = 64
GRID_SCALE = 1e12
FINE_CELLS = 4096
NO_CELL = -(2**31)


def _coarse(value: Column) -> Column:
    """Cell of a value; never decreases with it, about 1.5 % wide, 0 has its own.

    Missing values get a cell without counts rather than NULL: a NULL-able join
    key would make the optimizer test the value's whole formula for NULL first.
    """
    size = F.log1p(F.abs(value) * GRID_SCALE) * GRID_PER_E_FOLD
    # Beyond about 1e296 the scaled value is infinite; all these share the last cell.
    size = F.least(size, F.lit(2.0**30))
    cell = F.floor(F.when(value < 0, -size).otherwise(size)).cast("int")
    return F.coalesce(cell, F.lit(NO_CELL))


def _fine(value: Column, low: Column, high: Column) -> Column:
    """Cell of a value on a linear grid over [low, high]."""
    share = (value - low) / F.when(high > low, high - low).otherwise(F.lit(1.0))
    share = F.nanvl(share, F.lit(0.0))
    return F.least(F.lit(FINE_CELLS - 1), F.floor(share * FINE_CELLS).cast("int"))


def _before(keys: Sequence[str], order: str) -> Column:
    """Rows counted in earlier cells of the same group."""
    window = Window.partitionBy(*keys).orderBy(order)
    earlier = F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(earlier, F.lit(0))


_IN_CELL = "rank >= start AND rank < start + n"


def _probe(counts: DataFrame, group: str, probabilities: Sequence[float]) -> DataFrame:
    """For both neighbours of each fractional rank the cell that holds it.

    Adds ``p, gamma, upper, rank``; the rank counts from the start of the cell.
    """
    placed = counts.withColumns(
        {
            "start": _before([group], "c"),
            "position": F.sum("n").over(Window.partitionBy(group)) - 1,
        }
    )
    probes = ", ".join(f"{float(p)!r}D" for p in probabilities)
    sides = (
        "explode(array(struct(0 AS upper, floor(position) AS rank), "
        "struct(1 AS upper, ceil(position) AS rank))) AS side"
    )
    return (
        placed.selectExpr("*", f"explode(array({probes})) AS p")
        .withColumn("position", F.col("position") * F.col("p"))
        .selectExpr("*", "position - floor(position) AS gamma", sides)
        .selectExpr("* EXCEPT (side)", "side.*")
        .filter(_IN_CELL)
        .withColumn("rank", F.col("rank") - F.col("start"))
    )


def _descend(counts: DataFrame, targets: DataFrame, keys: list[str], cell: str) -> DataFrame:
    """Find each target rank among the finer cells of its cell."""
    placed = counts.withColumn("start", _before(keys, cell))
    # Two rows per group and probability.
    found = placed.join(F.broadcast(targets), keys).filter(_IN_CELL)
    return found.withColumn("rank", F.col("rank") - F.col("start"))


def _gathered(located: DataFrame, columns: list[str]) -> DataFrame:
    """Located ranks as a local table."""
    rows = located.select(*columns)
    return located.sparkSession.createDataFrame(rows.collect(), rows.schema)


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: Sequence[float],
    group: str | None = None,
) -> DataFrame:
    """``(group, p, quantile)`` with linear interpolation; missing values are skipped.

    ``group`` must have few values (topics, metrics): two rows per group and
    probability are gathered and broadcast to the value rows.
    """
    g = group or "__group"
    values = df.select(
        F.col(group) if group else F.lit(0).alias(g), F.col(value).cast("double").alias("v")
    )
    values = values.withColumns({"c": _coarse(F.col("v")), "f": F.lit(0)})
    rank = [g, "p", "gamma", "upper", "rank"]

    coarse = values.groupBy(g, "c", "f").agg(
        F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")
    )
    coarse = coarse.filter(F.col("n") > 0)
    targets = _gathered(
        _probe(coarse, g, probabilities), [*rank, "c", "f", "low", "high"]
    )

    cells = targets.select(g, "c", "low", "high").distinct()
    values = (
        values.drop("f")
        .join(F.broadcast(cells), [g, "c"])
        .withColumn("f", _fine(F.col("v"), F.col("low"), F.col("high")))
        .drop("low", "high")
    )
    fine = values.groupBy(g, "c", "f").agg(F.count("*").alias("n"))
    targets = _gathered(
        _descend(fine, targets.drop("f", "low", "high"), [g, "c"], "f"), [*rank, "c", "f"]
    )

    cells = targets.select(g, "c", "f").distinct()
    hits = values.join(F.broadcast(cells), [g, "c", "f"])
    counts = hits.groupBy(g, "c", "f", "v").agg(F.count("*").alias("n"))
    found = _descend(counts, targets.select(*rank, "c", "f"), [g, "c", "f"], "v")
    return _interpolated(found, g).select(*([g] if group else []), "p", "quantile")


def _interpolated(found: DataFrame, group: str) -> DataFrame:
    lower = F.max(F.when(F.col("upper") == 0, F.col("v")))
    upper = F.max(F.when(F.col("upper") == 1, F.col("v")))
    return (
        found.groupBy(group, "p")
        .agg(lower.alias("lo"), upper.alias("hi"), F.max("gamma").alias("gamma"))
        .select(
            group,
            "p",
            (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("gamma")).alias("quantile"),
        )
    )


def with_ranks(counts: DataFrame, group: str) -> DataFrame:
    """Prepare a table ``(group, v, n)`` of value counts for :func:`counted_quantile`.

    Adds the rows of the group, and those before each value. Meant for values with
    few levels, such as text lengths.
    """
    return counts.withColumns(
        {
            "total": F.sum("n").over(Window.partitionBy(group)),
            "start": _before([group], "v"),
        }
    )


def counted_quantile(p: float) -> Column:
    """Aggregate over the rows of a group of :func:`with_ranks`: its quantile at p."""
    position = f"((total - 1) * {float(p)!r}D)"

    def at(rank: str) -> str:
        return f"max(CASE WHEN {rank} >= start AND {rank} < start + n THEN v END)"

    low, high = at(f"floor({position})"), at(f"ceil({position})")
    return F.expr(f"{low} + ({high} - {low}) * max({position} - floor({position}))")


def approximate_quantiles(
    df: DataFrame,
    value: str,
    probabilities: Sequence[float],
    group: str | None = None,
    accuracy: int = 10_000,
) -> DataFrame:
    """One-pass quantiles within a rank error of 1/accuracy, same shape as the exact ones."""
    probes = F.array(*[F.lit(float(p)) for p in probabilities])
    sketch = F.percentile_approx(value, [float(p) for p in probabilities], accuracy)
    keys = [group] if group else []
    grouped = df.groupBy(*keys).agg(sketch.alias("q"))
    return grouped.select(*keys, F.explode(F.arrays_zip(probes.alias("p"), "q")).alias("z")).select(
        *keys, F.col("z.p").alias("p"), F.col("z.q").alias("quantile")
    )


def wide_quantiles(quantiles: DataFrame, names: dict[float, str], group: str | None = None) -> DataFrame:
    """Long quantiles to one column per probability."""
    keys = [group] if group else []
    return quantiles.groupBy(*keys).agg(
        *[F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(name) for p, name in names.items()]
    )
