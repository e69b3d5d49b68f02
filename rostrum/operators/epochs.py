"""Shuffled epochs without a sort: a keyed permutation of row positions.

Position ``p`` of an epoch holds row ``row(p)``, and row ``r`` comes at ``position(r)``; both
are arithmetic on one number, so an epoch needs no shuffle and no stored order, and batch k
is looked up by the rows that it is computed to have. Every epoch and seed has an order of
its own, each row once.

The permutation is a Feistel network over pairs of digits: with ``a = ceil(sqrt(n))`` and
``b = ceil(n / a)`` a row is ``left * b + right``, and rounds add a keyed function of one
digit to the other, modulo its base. The pairs are fewer than ``n + a``. A row that lands
beyond n is sent through again until it is below (cycle walking). Fewer than ``a`` numbers
lie beyond n, so the longest such walk is found by following these, and that many steps are
enough for every row.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cached_property
from math import isqrt

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from rostrum.operators.batches import BATCH_ID, DEFAULT_BATCH
from rostrum.operators.numbering import ROW_ID
from rostrum.operators.positions import PositionIndex

POSITION = "position"
ROUNDS = 8
# Products of two numbers below this prime fit into 64 bits.
PRIME = 2**31 - 1
# Digits stay below the prime, and the driver follows no more than a million numbers.
MAX_ROWS = 10**12


@dataclass(frozen=True)
class Epoch:
    """The order of ``n`` rows in one epoch of a seeded sequence of epochs."""

    n: int
    seed: int = 42
    epoch: int = 0

    def __post_init__(self) -> None:
        if not 0 <= self.n <= MAX_ROWS:
            raise ValueError(f"{self.n} rows, an epoch has 0 to {MAX_ROWS}")

    @property
    def bases(self) -> tuple[int, int]:
        """Bases of the left and the right digit."""
        left = max(1, isqrt(max(0, self.n - 1)) + 1)
        return left, max(1, -(-self.n // left))

    @property
    def keys(self) -> list[tuple[int, int]]:
        """Factor and summand of each round."""
        found = []
        for i in range(ROUNDS):
            digest = hashlib.md5(f"{self.seed}:{self.epoch}:{i}".encode()).digest()
            parts = (int.from_bytes(digest[k : k + 8], "big") for k in (0, 8))
            found.append(tuple(1 + p % (PRIME - 1) for p in parts))
        return found

    @cached_property
    def steps(self) -> tuple[int, int]:
        """Longest walks, forwards and backwards: how often a row is sent through at most."""
        return self._longest(False), self._longest(True)

    def _longest(self, backwards: bool) -> int:
        left, right = self.bases
        beyond = np.arange(self.n, left * right, dtype=np.int64)
        # Where walks of rows leave the rows; the network also has cycles that none enters.
        at = beyond[self._once(beyond, not backwards) < self.n]
        steps = 1
        while len(at):
            steps += 1
            at = self._once(at, backwards)
            at = at[at >= self.n]
        return steps

    def _once(self, value: np.ndarray, backwards: bool) -> np.ndarray:
        """The network over whole numbers below the product of the bases."""
        left, right = self.bases
        x, y = value // right, value % right
        rounds = list(enumerate(self.keys))
        for i, (factor, summand) in reversed(rounds) if backwards else rounds:
            base, given = (right, x) if i % 2 else (left, y)
            mixed = (given * factor + summand) % PRIME
            added = (mixed * mixed % PRIME >> 8) % base
            if backwards:
                added = base - added
            if i % 2:
                y = (y + added) % base
            else:
                x = (x + added) % base
        return x * right + y

    def _walk(self, start: Column, backwards: bool) -> Column:
        """The network as a column, with the digits as the state of a fold over the rounds.

        A fold, as a formula that names both digits twice a round would double each time.
        """
        left, right = self.bases
        rounds = list(enumerate(self.keys))
        listed = F.array(
            *[
                F.struct(F.lit(i % 2 == 1).alias("odd"), F.lit(f).alias("f"), F.lit(s).alias("s"))
                for i, (f, s) in (reversed(rounds) if backwards else rounds)
            ]
        )

        def turn(state: Column, key: Column) -> Column:
            given = F.when(key["odd"], state["x"]).otherwise(state["y"])
            mixed = (given * key["f"].cast("long") + key["s"].cast("long")) % F.lit(PRIME)
            added = F.shiftright(mixed * mixed % F.lit(PRIME), 8)

            def moved(digit: Column, base: int) -> Column:
                change = F.lit(base) - added % F.lit(base) if backwards else added % F.lit(base)
                return ((digit + change) % F.lit(base)).cast("long")

            return F.struct(
                F.when(key["odd"], state["x"]).otherwise(moved(state["x"], left)).alias("x"),
                F.when(key["odd"], moved(state["y"], right)).otherwise(state["y"]).alias("y"),
            )

        def once(value: Column) -> Column:
            digits = F.struct(
                ((value - value % F.lit(right)) / F.lit(right)).cast("long").alias("x"),
                (value % F.lit(right)).cast("long").alias("y"),
            )
            return F.aggregate(listed, digits, turn, lambda s: s["x"] * F.lit(right) + s["y"])

        first = once(start)
        more = self.steps[backwards] - 1
        if not more:
            return first
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(more)),
            first,
            lambda value, _: F.when(value < self.n, value).otherwise(once(value)),
        )

    def position(self, row: Column | str = ROW_ID) -> Column:
        """Where in the epoch a row comes; null for null and for numbers that are no row."""
        return self._column(row, False)

    def row(self, position: Column | str = POSITION) -> Column:
        """Which row comes at a position of the epoch."""
        return self._column(position, True)

    def _column(self, value: Column | str, backwards: bool) -> Column:
        given = (F.col(value) if isinstance(value, str) else value).cast("long")
        return F.when((given >= 0) & (given < self.n), self._walk(given, backwards))

    def rows_of(self, first: int, last: int) -> list[int]:
        """Rows at the positions from ``first`` up to ``last``, which is not included."""
        at = np.arange(max(0, first), min(last, self.n), dtype=np.int64)
        at = self._once(at, True)
        while (beyond := at >= self.n).any():
            at[beyond] = self._once(at[beyond], True)
        return at.tolist()


def with_epoch_batches(
    numbered: DataFrame,
    n: int,
    batch_size: int = DEFAULT_BATCH,
    seed: int = 42,
    epoch: int = 0,
) -> DataFrame:
    """Add ``position`` and ``batch_id`` in one epoch to rows numbered 0 to n - 1.

    A narrow projection. Columns of these names are replaced. Rows whose ``row_id`` is
    missing or no number below n have neither.
    """
    placed = numbered.withColumn(POSITION, Epoch(n, seed, epoch).position())
    return placed.withColumn(BATCH_ID, F.floor(F.col(POSITION) / batch_size).cast("long"))


def epoch_batch(
    index: PositionIndex,
    number: int,
    batch_size: int = DEFAULT_BATCH,
    seed: int = 42,
    epoch: int = 0,
) -> DataFrame:
    """Batch ``number`` of an epoch over indexed shards, in its order, with ``position``.

    Its rows are computed and looked up: of all shards only those that hold one of them are
    opened. A batch beyond the last has no rows.
    """
    if number < 0 or batch_size < 1:
        raise ValueError("batches are numbered from 0 and have a row or more")
    order = Epoch(index.count(), seed, epoch)
    rows = order.rows_of(number * batch_size, (number + 1) * batch_size)
    return index.rows_at(rows).withColumn(POSITION, order.position())
