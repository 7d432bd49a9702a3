"""Tiles of the matrix product against brute force, over many small blocks, chunks and batches."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import similarity as sim
from shelfwise.operators import tiles as T


@pytest.fixture(params=[(16, 1), (16, 1 << 20), (0, 7)])
def small(request, monkeypatch):
    cells, products = request.param
    for name, value in (("LEFT_ENTRIES", 40), ("RIGHT_ENTRIES", 60), ("PRODUCTS", products), ("CELLS", cells), ("DEALT", 50)):
        monkeypatch.setattr(T, name, value)


def matrix(spark, weighted):
    rnd = random.Random(5)
    entries = {(rnd.randrange(25), f"i{rnd.randrange(18)}"): float(rnd.randint(1, 9)) if weighted else 1.0 for _ in range(160)}
    entries[99, "alone"] = 1.0
    rows = [(u, i, w) for (u, i), w in entries.items()]
    return entries, spark.createDataFrame([*rows, (None, "i1", 1.0)], "user_id long, item_id string, w double")


def cosines(entries, of_items):
    lists = defaultdict(dict)
    for (u, i), w in entries.items():
        lists[i if of_items else u][u if of_items else i] = w
    out = {}
    for a, x in lists.items():
        for b, y in lists.items():
            m = len(x.keys() & y.keys())
            if a != b and m:
                c = sum(x[k] * y[k] for k in x.keys() & y.keys())
                out[a, b] = (c / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5, m)
    return out


def top(scores, k):
    lists = defaultdict(list)
    for (a, b), s in scores.items():
        lists[a].append((-s, b))
    return {(a, b): (r + 1, pytest.approx(-s, abs=1e-9)) for a, x in lists.items() for r, (s, b) in enumerate(sorted(x)[:k])}


@pytest.mark.parametrize("of_items", [True, False])
def test_pairs_and_neighbours(spark, small, of_items):
    entries, m = matrix(spark, True)
    pairs = (sim.itemcf if of_items else sim.usercf)(m)
    want = cosines(entries, of_items)
    assert {(r.i, r.j): (r.sim, r.m) for r in pairs.collect()} == {
        k: (pytest.approx(s, abs=1e-12), n) for k, (s, n) in want.items() if k[0] < k[1]}
    near = sim.neighbours(pairs, 3)
    # equal cosines that differ in the last bits may change places, so scores are compared by rank
    got, expected = defaultdict(list), defaultdict(list)
    for r in near.orderBy("i", "rank").collect():
        got[r.i].append(r.sim)
        assert r.sim == pytest.approx(want[r.i, r.j][0], abs=1e-12)
    for (a, _b), (s, _m) in want.items():
        expected[a].append(s)
    assert got == {a: pytest.approx(sorted(s, reverse=True)[:3], abs=1e-12) for a, s in expected.items()}


def test_votes(spark, small):
    entries, m = matrix(spark, False)
    near = sim.neighbours(sim.itemcf(m), 4).persist()
    lists = {(r.i, r.j): r.sim for r in near.collect()}
    scores = defaultdict(float)
    for u, i in entries:
        for (a, j), s in lists.items():
            if a == i and (u, j) not in entries:
                scores[u, j] += s
    own = m.filter("user_id IS NOT NULL")
    got = {(r.user_id, r.item_id): (r["rank"], r.score) for r in sim.recommend_item_votes(own, own, near, 5).collect()}
    assert got == top({k: round(s, 10) for k, s in scores.items()}, 5)


def test_empty_matrix(spark):
    m = matrix(spark, False)[1].filter("user_id < 0")
    assert sim.itemcf(m).count() == 0 and sim.neighbours(sim.itemcf(m), 2).count() == 0
    assert sim.recommend_usercf(m, 3).count() == 0


def test_pairs_are_not_shuffled(spark):
    near = sim.neighbours(sim.itemcf(matrix(spark, False)[1]), 1)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "HashAggregate" not in plan and plan.count("Exchange") <= 2


def test_profile_cosines(spark, small):
    entries, m = matrix(spark, False)
    own = m.filter("user_id IS NOT NULL").select(F.col("user_id").cast("string").alias("e"), F.col("item_id").alias("k"))
    users = {str(u) for u, _ in entries}
    wanted = [(u, f"i{n}") for u in users for n in range(0, 20, 3)] + [("nobody", "i0"), ("99", "alone")]
    targets = spark.createDataFrame([*wanted, *wanted[:9]], "e string, o string")  # repeated rows count once
    cos, want = cosines(entries, True), {}
    for u, o in wanted:
        s = sum(1.0 if o == i else cos.get((o, i), (0.0, 0))[0] for v, i in entries if str(v) == u)
        if s:
            want[u, o] = pytest.approx(s, abs=1e-9)
    assert {(r.e, r.o): r.score for r in T.profile_cosines(own, targets).collect()} == want
