"""Near-duplicate components against all pairs."""

from __future__ import annotations

import random
import re

import pytest

from rostrum.llm import jaccard_join
from rostrum.llm.jaccard_join import drop_near_duplicates, near_duplicates


def shingles(text, size):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if len(w) >= size else {tuple(w)}


def brute(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            o = len(a & sets[j])
            if a and 100 * o >= percent * len(a | sets[j]):
                parent[top(i)] = top(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[top(i)] = min(key, least.get(top(i), key))
    return sorted(((k, len(s), least.get(top(i))) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=repr)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(["x", "y", "zz", "new"])
    return words


def tables(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = []
    passage = rng.choices(vocabulary, k=30)
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randint(4, 160))
        if rng.random() < 0.5:
            base += passage
        for _ in range(rng.randint(1, 14)):
            rows.append(" ".join(edited(rng, base, rng.randint(0, 5))))
    rows += ["", None, " \n", "one", "One", "one two", "one  TWO", "two one", "a b c", "c b a", "a b c d"]
    rows += ["lone words " * 3000, "lone words " * 2999]
    rng.shuffle(rows)
    keyed = [(i * 3 + 1, t) for i, t in enumerate(rows)]
    keyed += [(None, rows[0]), (None, "nobody has this text"), keyed[5], keyed[5]]
    return keyed


@pytest.mark.parametrize(
    ("seed", "rare", "rounds", "percent"),
    [(0, 64, 4, 90), (1, 2, 1, 90), (2, 0, 0, 80), (3, 3, 2, 70), (4, 1, 3, 90)],
)
def test_equals_all_pairs(documents, seed, rare, rounds, percent):
    rows = tables(seed)
    found = near_duplicates(
        documents(rows), percent=percent, rare=rare, hub_rounds=rounds, block_bytes=4000, bucket_bytes=9000
    )
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, 3, percent)


def test_a_chain_is_one_component(documents):
    """Each text is like the next alone; the first and last share nothing."""
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[2 * i : 2 * i + 60])) for i in range(60)]
    found = near_duplicates(documents(rows), percent=85)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, 3, 85)
    assert {r.component_id for r in found.collect()} == {0}


def test_empty_table_and_lone_rows(documents):
    assert near_duplicates(documents([])).collect() == []
    found = near_duplicates(documents([(4, "some words of a text"), (5, None)])).collect()
    assert sorted(map(tuple, found)) == [(4, 3, 4), (5, 0, 5)]


def test_one_row_of_each_component_stays(spark, documents, tmp_path):
    rows = tables(9)
    documents(rows).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    found = [(r.doc_id, r.text) for r in kept.collect()]
    filled = [t for t in found if shingles(t[1], 3)]
    judged = brute(rows, 3, 90)
    groups = {c for _, n, c in judged if n and c is not None}
    # One group has a row without a key, which counts as the least, and one has no key at all.
    assert len(filled) == len(groups) + 1
    assert sum(1 for t in found if not shingles(t[1], 3)) == sum(1 for t in rows if not shingles(t[1], 3))


def test_rows_that_no_file_has_are_stored_first(spark, documents):
    rows = [(1, "an ordinary text of some words"), (2, "An ordinary text of some words"), (3, "")]
    grown = documents(rows).mapInArrow(lambda batches: batches, documents([]).schema)
    assert sorted(r.doc_id for r in drop_near_duplicates(grown).collect()) == [1, 3]


def test_hot_group_makes_no_pairs(documents, monkeypatch):
    """Thousands of near copies of one text are compared with hubs, not with each other."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(300)]
    rows = [(i, " ".join([*base[: i % 290], f"new{i}", *base[i % 290 + 1 :]])) for i in range(1500)]
    compared = []
    linked = jaccard_join._linked

    def counted(pairs, classes, percent):
        compared.append(pairs.count())
        return linked(pairs, classes, percent)

    monkeypatch.setattr(jaccard_join, "_linked", counted)
    found = near_duplicates(documents(rows)).collect()
    assert {r.component_id for r in found} == {0}
    assert sum(compared) < 5 * len(rows)


@pytest.mark.parametrize("few", [True, False])
def test_components_are_found_in_few_steps(spark, monkeypatch, few):
    """Links to a hub, repeated and both ways: one round and a look, each store a task per partition."""
    if not few:
        monkeypatch.setattr(jaccard_join, "FEW_ROWS", 0)
    stores = []
    store = jaccard_join.materialize
    monkeypatch.setattr(jaccard_join, "materialize", lambda df, name: stores.append(name) or store(df, name))

    def found(pairs):
        links = store(spark.createDataFrame(pairs, "a long, b long"), "links")
        return sorted(map(tuple, jaccard_join.components(links).collect()))

    star = [(i, 50) for i in range(100)] + [(50, i) for i in range(0, 100, 3)]
    assert found(star) == [(i, 0) for i in range(1, 100)]
    assert stores == ["least", "edges", "least"] if few else stores == ["least", "lower", "edges", "least"]
    stars = [(3, 1), (1, 2), (2, 1), (9, 8)]
    stores.clear()
    assert found(stars) == [(2, 1), (3, 1), (9, 8)]
    assert stores == ["least"]
    assert found([]) == []
    assert found([(i, i + 1) for i in range(60)]) == [(i, 0) for i in range(1, 61)]


def test_stored_sides_give_the_same_components(documents, monkeypatch):
    rows = [(i, t) for i, t in tables(3)]
    monkeypatch.setattr(jaccard_join, "FEW_BYTES", -1)
    monkeypatch.setattr(jaccard_join, "FEW_ROWS", -1)
    assert sorted(map(tuple, near_duplicates(documents(rows)).collect()), key=repr) == brute(rows, 3, 90)
