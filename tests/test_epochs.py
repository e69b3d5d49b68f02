"""Epochs as keyed permutations: bijections, walks, batches and their look-up."""

from __future__ import annotations

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from rostrum.operators.epochs import MAX_ROWS, Epoch, epoch_batch, with_epoch_batches
from rostrum.operators.positions import build_index


def _plain(order: Epoch, row: int) -> int:
    """Position of a row, by the definition: rounds over two digits, again until below n."""
    left, right = order.bases
    while True:
        x, y = divmod(row, right)
        for i, (factor, summand) in enumerate(order.keys):
            mixed = ((x if i % 2 else y) * factor + summand) % (2**31 - 1)
            added = (mixed * mixed % (2**31 - 1)) >> 8
            if i % 2:
                y = (y + added) % right
            else:
                x = (x + added) % left
        row = x * right + y
        if row < order.n:
            return row


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 400), st.integers(), st.integers(0, 50))
def test_every_row_comes_once(n, seed, epoch):
    order = Epoch(n, seed, epoch)
    rows = order.rows_of(0, n)
    assert sorted(rows) == list(range(n))
    assert [_plain(order, r) for r in rows] == list(range(n))
    left, right = order.bases
    assert n <= left * right < n + left + 1


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 4097])
def test_columns_agree_with_the_definition(spark, n):
    for epoch in range(2):
        order = Epoch(n, 7, epoch)
        table = spark.range(n).select("id", order.position("id").alias("p"), order.row("id").alias("r"))
        for row in table.collect():
            assert row.p == _plain(order, row.id) and _plain(order, row.r) == row.id


def test_long_walks_end_below_n(spark):
    """Sizes whose walks are long: as many steps as the longest needs, no more."""
    sizes = max(range(2, 400), key=lambda n: max(Epoch(n, 1).steps))
    order = Epoch(sizes, 1)
    assert max(order.steps) > 2
    got = [r.p for r in spark.range(sizes).select(order.position("id").alias("p")).collect()]
    assert sorted(got) == list(range(sizes))


def test_large_tables(spark):
    order = Epoch(MAX_ROWS - 12_345, 5, 2)
    rows = order.rows_of(10**11, 10**11 + 50)
    assert len(set(rows)) == 50 and all(0 <= r < order.n for r in rows)
    table = spark.createDataFrame([(r,) for r in rows], "r long")
    got = [r.p for r in table.select(order.position("r").alias("p")).collect()]
    assert got == list(range(10**11, 10**11 + 50)) == [_plain(order, r) for r in rows]


def test_orders_differ_and_look_random():
    orders = [Epoch(10_000, seed, epoch).rows_of(0, 10_000) for seed in (1, 2) for epoch in (0, 1)]
    assert len({tuple(o) for o in orders}) == 4
    for rows in orders:
        # Neighbours of a random order are a third of the table apart.
        apart = sum(abs(a - b) for a, b in zip(rows, rows[1:])) / (len(rows) - 1)
        assert 0.31 < apart / len(rows) < 0.36
        fixed = sum(r == i for i, r in enumerate(rows))
        assert fixed < 10
    # No row of a batch need share its batch in the next epoch: pairs that stay are as few as by chance.
    first, second = ({r: i // 100 for i, r in enumerate(o)} for o in orders[:2])
    stay = sum(first[r] == first[r + 1] and second[r] == second[r + 1] for r in range(9_999))
    assert stay < 12


def test_missing_and_other_numbers(spark):
    table = spark.createDataFrame([(None, "a"), (-1, "b"), (3, "c"), (2, "d")], "row_id long, position string")
    got = {r.row_id: (r.position, r.batch_id) for r in with_epoch_batches(table, 3, 2).collect()}
    assert got[None] == got[-1] == got[3] == (None, None)
    place = _plain(Epoch(3), 2)
    assert got[2] == (place, place // 2)
    assert with_epoch_batches(table.limit(0), 0).collect() == []
    for n in (-1, MAX_ROWS + 1):
        with pytest.raises(ValueError, match="an epoch has"):
            Epoch(n)


def test_no_shuffle(spark):
    plan = with_epoch_batches(spark.range(1000).withColumnRenamed("id", "row_id"), 1000)
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_batches_are_looked_up(spark, tmp_path):
    folder = str(tmp_path / "shards")
    rows = spark.range(103).select(F.format_string("%04d", "id").alias("doc_id"), F.lit("x").alias("text"))
    rows.repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id").write.parquet(folder)
    index = build_index(spark, folder)
    ids = [r.doc_id for r in index.rows_at(slice(None)).orderBy("row_id").collect()]
    for epoch, k in ((0, 0), (0, 10), (1, 4), (1, 11)):
        batch = epoch_batch(index, k, 10, epoch=epoch).collect()
        assert [r.position for r in batch] == list(range(k * 10, min(103, k * 10 + 10)))
        assert [r.doc_id for r in batch] == [ids[r.row_id] for r in batch]
        assert [r.row_id for r in batch] == Epoch(103, 42, epoch).rows_of(k * 10, k * 10 + 10)
    one = epoch_batch(index, 0, 1)
    assert len(one.inputFiles()) == 1
    with pytest.raises(ValueError, match="numbered from 0"):
        epoch_batch(index, -1)
