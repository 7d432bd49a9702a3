"""Replay rows at several cuts: one shuffle of pairs, cuts spelled out after it."""

from datetime import datetime

import pytest

from shelfwise.operators import replay as Rp

CUTS = [datetime(2001, 3, 1), datetime(2001, 4, 1), datetime(2001, 5, 1)]


@pytest.fixture(scope="module")
def frames(spark):
    tx = spark.createDataFrame(
        [(1, "a", 1, "2001-01-05"), (1, "a", 1, "2001-01-06"), (1, "a", 2, "2001-03-10"), (2, "a", 3, "2001-04-02"),
         (2, "b", None, "2001-02-01"), (1, "b", 5, "2001-04-15"), (None, "c", 6, "2001-01-01"), (3, None, 7, "2001-01-01")],
        "user_id long, item_id string, order_id long, ts string").selectExpr(
        "user_id", "item_id", "order_id", "cast(ts AS timestamp_ntz) AS ts")
    cand = spark.createDataFrame(
        [(1, "a"), (1, "b"), (1, "b"), (2, "b"), (2, "c"), (3, "a"), (4, "a"), (None, "a")], "user_id long, item_id string")
    return tx, cand


def brute(tx, cand):
    tx, out = [r for r in tx.collect()], []
    for c in CUTS:
        nxt = datetime(c.year, c.month + 1, 1)
        for r in cand.collect():
            if r.user_id is None or not any(t.user_id == r.user_id and t.ts < c for t in tx if t.user_id is not None):
                continue
            if not any(t.item_id == r.item_id and t.ts < c for t in tx):
                continue
            own = [t for t in tx if (t.user_id, t.item_id) == (r.user_id, r.item_id)]
            prior = any(t.ts < c for t in own)
            label = any(c <= t.ts < nxt for t in own)
            n = len({t.order_id for t in own if t.ts < c and t.order_id is not None})
            out.append((c, r.user_id, r.item_id, f"{c:%Y-%m}", int(label), int(prior), int(label and not prior), n))
    return sorted(out)


def test_replay_brute_force(frames):
    tx, cand = frames
    assert sorted(tuple(r) for r in Rp.replay(tx, cand, CUTS).collect()) == brute(tx, cand)


def test_no_shuffle_carries_a_row_per_cut(frames):
    plan = Rp.replay(*frames, CUTS)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Exchange")


def test_weights_of_two_keys_do_not_deal_rows_again(frames):
    rows = Rp.replay(*frames, CUTS)
    got = {(r.ym, r.user_id): r.weight for r in Rp.weight_equal_group(rows).collect()}
    sizes = {}
    for r in rows.collect():
        sizes[r.ym, r.user_id] = sizes.get((r.ym, r.user_id), 0) + 1
    assert got == {k: 1 / n for k, n in sizes.items()}
