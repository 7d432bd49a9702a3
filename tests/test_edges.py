"""Hand-made frames: ties, single classes, empty sides, hot groups."""

import random
from collections import defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import ranks as R
from shelfwise.functions import scalar as S
from shelfwise.operators import aggregates as A
from shelfwise.operators import baskets as B
from shelfwise.operators import cleaning
from shelfwise.operators import features as Fe
from shelfwise.operators import fusion as Fu
from shelfwise.operators import learners as L
from shelfwise.operators import metrics as M
from shelfwise.operators import profiling
from shelfwise.operators import recall as Rc
from shelfwise.operators import sampling as Sa
from shelfwise.operators import sequences as Q
from shelfwise.operators import serving as Sv
from shelfwise.operators import similarity as sim
from shelfwise.operators import vectors as V


def test_group_metric_with_tie(spark):
    df = spark.createDataFrame(
        [("m", 1, "a", 1, .9), ("m", 1, "b", 0, .8), ("m", 1, "c", 1, .8), ("m", 1, "d", 0, .1)],
        "ym string, user_id int, item_id string, label int, s double")
    ref = M.group_metrics(df, "s").first()
    std = M.group_metrics(df, "s", idcg="standard").first()
    assert ref["auc"] == pytest.approx(0.875) and ref["recall"] == 1.0
    assert ref["ndcg"] == pytest.approx(0.58028, abs=1e-5) and std["ndcg"] == pytest.approx(0.91972, abs=1e-5)
    assert M.composite(M.group_metrics(df, "s")).first()["composite"] == pytest.approx(0.78211, abs=1e-5)


def test_single_class_groups(spark):
    df = spark.createDataFrame([("m", 1, "a", 1, .9), ("m", 1, "b", 1, .8), ("m", 2, "a", 0, .9)],
                               "ym string, user_id int, item_id string, label int, s double")
    got = {r["user_id"]: r for r in M.group_metrics(df, "s").collect()}
    assert got[1]["auc"] is None and got[1]["recall"] == 1.0
    assert got[2]["auc"] is None and got[2]["ndcg"] is None and got[2]["recall"] is None


def test_average_rank_and_group_of_one(spark):
    df = spark.createDataFrame([("g", 1.), ("g", 2.), ("g", 2.), ("g", 3.), ("h", 5.)], "g string, v double")
    got = sorted(r["r"] for r in R.average_rank(df, ["g"], "v", "r").filter("g = 'g'").collect())
    assert got == [1.0, 2.5, 2.5, 4.0]
    one = R.percent_rank_zero_one(df, ["g"], "v", "p").filter("g = 'h'").first()
    assert one["p"] == 0.0


@pytest.mark.parametrize("hot", [3, 100_000])
def test_ranges_do_not_change_results(spark, monkeypatch, hot):
    monkeypatch.setattr(R, "HOT_VALUES", hot)
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < .5 else f"g{rnd.randrange(5)}", float(rnd.randrange(40)), rnd.randrange(2)) for _ in range(600)]
    df = spark.createDataFrame(rows, "g string, v double, label int")
    got = {r["g"]: r for r in R.group_auc(df, ["g"], "v").collect()}
    med = {r["g"]: r["m"] for r in R.grouped_median(df, ["g"], "v", "m").collect()}
    by = defaultdict(list)
    for g, v, y in rows:
        by[g].append((v, y))
    for g, vals in by.items():
        pos, neg = [v for v, y in vals if y], [v for v, y in vals if not y]
        want = sum((p > n) + .5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
        assert got[g]["auc"] == pytest.approx(want)
        s = sorted(v for v, _ in vals)
        assert med[g] == (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2


def test_hot_key_pair_sums(spark):
    """A key above the block size is cut into slots; the sums stay the same."""
    rnd = random.Random(5)
    rows = {("hot", f"i{k:02d}") for k in range(30)} | {(f"k{rnd.randrange(8)}", f"i{rnd.randrange(30):02d}") for _ in range(80)}
    df = spark.createDataFrame(sorted(rows), "k string, e string").withColumn("w", F.lit(1.0))
    got = {(r["i"], r["j"]): r["c"] for r in sim.pair_sums(df, "k", "e", block=4).collect()}
    want = defaultdict(float)
    by = defaultdict(list)
    for k, e in rows:
        by[k].append(e)
    for es in by.values():
        for a in es:
            for b in es:
                if a < b:
                    want[(a, b)] += 1
    assert got == dict(want)


def test_blocked_neighbours_equal_one_block(spark):
    rnd = random.Random(1)
    vec = spark.createDataFrame([(str(i), [rnd.gauss(0, 1) for _ in range(6)]) for i in range(40)], "item_id string, vec array<double>")
    u = V.unit_vectors(vec)
    one = {(r[0], r[1]) for r in V.nearest(u, u, "item_id", "item_id", 5).select("item_id", "neighbor").collect()}
    many = {(r[0], r[1]) for r in V.nearest(u, u, "item_id", "item_id", 5, block=7).select("item_id", "neighbor").collect()}
    assert one == many and len(one) == 200


def test_popular_route_is_exact(spark, monkeypatch):
    monkeypatch.setattr(Rc, "HEAD", 4)
    pop = spark.createDataFrame([(f"i{k}", 10 - k, k) for k in range(1, 11)], "item_id string, weight long, pos long")
    own = spark.createDataFrame([(1, f"i{k}") for k in (1, 2, 4, 9)] + [(2, "i3")], "user_id long, item_id string")
    got = defaultdict(list)
    for r in Rc.popular_route(pop, own, own, 3).orderBy("user_id", "rank").collect():
        got[r["user_id"]].append(r["item_id"])
    assert got == {1: ["i3", "i5", "i6"], 2: ["i1", "i2", "i4"]}


def test_ordered_fusion(spark):
    def route(items):
        return spark.createDataFrame([(1, x, 0.0, k + 1) for k, x in enumerate(items)], "user_id long, item_id string, score double, rank int")

    routes = {"popular": route(["p", "q"]), "similar": route(["q", "r"])}
    got = [r["item_id"] for r in Rc.fuse_ordered(routes, {"popular": 1, "similar": 1}, 2).orderBy("rank").collect()]
    assert got == ["p", "q"]
    zero = [r["item_id"] for r in Rc.fuse_ordered(routes, {"popular": 0, "similar": 1}, 2).orderBy("rank").collect()]
    assert zero == ["p", "q"]


def test_draw_unbought(spark):
    cat = spark.createDataFrame([(f"i{k}",) for k in range(6)], "item_id string")
    out = spark.createDataFrame([(1, "i0"), (1, "i1"), (2, "i5")], "user_id long, item_id string")
    need = spark.createDataFrame([(1, 3), (2, 50)], "user_id long, n long")
    got = defaultdict(set)
    for r in Sa.draw_unbought(need, out, cat).collect():
        got[r["user_id"]].add(r["item_id"])
    assert len(got[1]) == 3 and not got[1] & {"i0", "i1"}
    assert got[2] == {f"i{k}" for k in range(5)}


def test_cleaning_edges(spark):
    rows = [("1", 1.0, 1.0, None), ("C123", 1.0, 1.0, 1), (" c9", 1.0, 1.0, 1), ("2", 0.0, 1.0, 1),
            ("3", None, 1.0, 1), ("4", 1.0, 0.0, 1), ("5", 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "invoice_no string, qty double, unit_price double, user_id long")
    assert sorted(r["invoice_no"] for r in cleaning.clean(df).collect()) == ["3", "5"]
    last = {r["stage"]: r["rows_after"] for r in cleaning.cleaning_funnel(df).collect()}
    assert last["stage3_drop_invalid_price"] == 2


def test_price_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.01,), (50.0,), (50.01,)], "unit_price double")
    got = {r["bin"]: r["n"] for r in profiling.price_histogram(df).collect()}
    assert got["0~1"] == 2 and got["1~2"] == 1 and got["20~50"] == 1 and got["50+"] == 1 and len(got) == 11


def test_repurchase_cycle(spark):
    from datetime import timedelta

    t0 = datetime(2020, 1, 1)
    rows = [(1, "a", t0 + timedelta(days=k)) for k in (0, 10, 30)] + [(1, "b", t0), (1, "b", t0)]
    h = spark.createDataFrame(rows, "user_id long, item_id string, ts timestamp_ntz").withColumn("cut", S.at(t0 + timedelta(days=40)))
    got = {r["item_id"]: r for r in Fe.pair_cycles(h).collect()}
    assert got["a"]["n_times"] == 3 and got["a"]["median_gap"] == 15.0 and got["b"]["n_times"] == 1


def test_basket_similarity(spark):
    t0 = datetime(2020, 1, 1)
    rows = [(1, o, i, t0) for o, items in ((1, "ab"), (2, "abc"), (3, "c")) for i in items]
    tx = spark.createDataFrame(rows, "user_id long, order_id long, item_id string, ts timestamp_ntz")
    r = B.basket_rows(tx).withColumn("cut", S.at(datetime(2020, 2, 1)))
    get = lambda s: {(x["i"], x["j"]): x["sim"] for x in B.item_similarity(r, s).collect()}
    assert get("cos_raw")[("a", "b")] == pytest.approx(1.0) and get("cos_raw")[("a", "c")] == pytest.approx(.5)
    assert get("jaccard")[("a", "c")] == pytest.approx(1 / 3)
    assert get("cos_bigbasket")[("a", "c")] == pytest.approx(1 / 3)
    cand = spark.createDataFrame([(1, "c"), (1, "a"), (2, "a")], "user_id long, item_id string").withColumn("cut", S.at(datetime(2020, 2, 1)))
    f = {(x["user_id"], x["item_id"]): x for x in B.basket_features(cand, r, B.item_similarity(r, "cos_raw")).collect()}
    assert f[(1, "c")]["sim_last1"] == 1.0 and f[(1, "c")]["simnb_last1"] == -1.0
    assert f[(2, "a")]["has_basket"] == 0.0 and f[(2, "a")]["sim_last3_max"] == 0.0


def test_global_position_and_whole_days(spark):
    df = spark.range(1000).withColumn("k", (F.col("id") * 7919) % 1000)
    assert R.global_position(df, [F.col("k")], "p").filter("p != k").count() == 0
    x = spark.createDataFrame([(datetime(2020, 1, 1, 13),)], "ts timestamp_ntz").select(S.whole_days("ts", "2020-01-03").alias("d"))
    assert x.first()["d"] == 1


def test_hot_group_in_a_narrow_span_is_spread(spark, monkeypatch):
    monkeypatch.setattr(R, "HOT_VALUES", 100)
    rows = [("hot", 5.0 + k / 1e6) for k in range(900)] + [("cold", float(k)) for k in range(100)]
    vals = spark.createDataFrame(rows, "g string, v double")
    cut = R._with_range(vals, ["g"], "v").groupBy("g").agg(F.count_distinct("__range").alias("n"), F.max("__range").alias("m"))
    got = {r["g"]: r for r in cut.collect()}
    assert got["hot"]["n"] > 50 and got["cold"]["m"] == 0


def test_long_baskets_stay_whole(spark):
    rows = [("o", f"i{k:04d}") for k in range(2500)] + [("p", "i1"), ("p", "i2")]
    df = spark.createDataFrame(rows, "order_id string, item_id string")
    assert {r["order_id"]: len(r["items"]) for r in A.collected_sets(df, "order_id", "item_id").collect()} == {"o": 2500, "p": 2}
    assert {r["order_id"]: len(r["items"]) for r in Q.basket_corpus(df).collect()} == {"o": 2500, "p": 2}


def test_rerank_keeps_the_whole_list(spark):
    df = spark.createDataFrame([(1, f"i{k:02d}", float(k)) for k in range(60)], "user_id long, item_id string, score double")
    assert Sv.rerank(df).count() == 60 and Sv.rerank(df, k=10).count() == 10 and Sv.rerank(df, k=0).count() == 0


def test_draws_are_spread_over_the_catalogue(spark):
    cat = spark.createDataFrame([(f"i{k:04d}",) for k in range(500)], "item_id string")
    need = spark.createDataFrame([(u, 8) for u in range(400)], "user_id long, n long")
    got = defaultdict(list)
    for r in Sa.draw_unbought(need, need.select("user_id", F.lit("none").alias("item_id")), cat).collect():
        got[r["user_id"]].append(int(r["item_id"][1:]))
    assert all(len(set(x)) == 8 for x in got.values())
    spread = [max(x) - min(x) for x in got.values()]
    assert sum(s > 200 for s in spread) > 380
    times = [0] * 500
    for x in got.values():
        for k in x:
            times[k] += 1
    assert max(times) < 25 and sum(t == 0 for t in times) < 10


def test_pairwise_rows_draw_the_stated_number(spark):
    rows = [("m", 1, f"i{k}", int(k == 0), float(k)) for k in range(6)]
    df = spark.createDataFrame(rows, "ym string, user_id long, item_id string, label int, f double")
    assert L.pairwise_rows(df, ["f"], per_positive=20).count() == 20


def test_factors_take_any_user_id(spark):
    rows = [(3_000_000_000 + u, f"i{k}", 1.0) for u in range(6) for k in range(4) if (u + k) % 2]
    conf = spark.createDataFrame(rows, "user_id long, item_id string, r double")
    model, index = L.implicit_factors(conf, rank=2, iterations=2)
    scored = L.factor_scores(spark.createDataFrame([(3_000_000_000, "i1"), (7, "i1")], "user_id long, item_id string"), model, index)
    got = {r["user_id"]: r["als"] for r in scored.collect()}
    assert got[7] == 0.0 and got[3_000_000_000] != 0.0


def test_join_predictions_refuses_unmatched_and_doubled_keys(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, s string")
    b = a.withColumnRenamed("s", "t")
    assert Fu.join_predictions(a, b, ["k"]).count() == 2
    for bad in (b.filter("k = 1"), b.union(b.filter("k = 1"))):
        with pytest.raises(Exception, match="not one to one"):
            Fu.join_predictions(a, bad, ["k"]).collect()
