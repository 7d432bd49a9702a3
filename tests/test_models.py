"""Learners and sweeps against plain counterparts: tree prefixes, node tables, list-wise weights, weighted copies, grids."""

import os
import shutil
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import baskets as B, fusion as Fu, grids, learners as L, metrics as M, tree_models as T
from shelfwise.sources import transactions

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    rows = [(f"2001-0{1 + i % 3}", i % 40, str(i), int(x + 0.5 * y * z + rng.normal(0, 0.4) > 0.8), float(x), float(y), float(z))
            for i, (x, y, z) in enumerate(rng.random((1500, 3)))]
    return spark.createDataFrame(rows, "ym string, user_id long, item_id string, label int, a double, b double, c double").coalesce(2).cache()


def test_prefixes_and_node_table(table):
    model = L.boosted_trees(FEATURES, trees=6, depth=3, min_rows=5).fit(table)
    short = L.boosted_trees(FEATURES, trees=2, depth=3, min_rows=5).fit(table)
    rows = L.add_probability(short, L.add_probability(model, table, "whole"), "two")
    got = T.prefix_scores(model, rows, FEATURES, [2, 6]).agg(
        F.max(F.abs(F.col("score_6") - F.col("whole"))), F.max(F.abs(F.col("score_2") - F.col("two")))).first()
    assert max(got) < 1e-12
    with pytest.raises(ValueError):
        T.prefix_scores(model, table, FEATURES, [7])
    counts = {r.feature: r.splits for r in T.split_counts(model, [*FEATURES, "never"]).collect()}
    trees = model.stages[-1]
    assert sum(counts.values()) == (trees.totalNumNodes - len(trees.treeWeights)) // 2 and counts["never"] == 0


def test_linear_scores_equal_the_model(table):
    model = L.logistic_on(table, FEATURES).fit(table)
    scaler, last = model.stages[1], model.stages[-1]
    w = last.coefficients.toArray() / scaler.std.toArray()
    got = T.linear_scores(L.add_probability(model, table, "s"), FEATURES, {"t": (w, last.intercept - w @ scaler.mean.toArray())})
    assert got.agg(F.max(F.abs(F.col("s") - F.col("t")))).first()[0] < 1e-12


def test_list_weights_raise_ndcg(spark):
    """Short lists follow one column and long lists the other; equal pairs follow the long lists, NDCG weights the short."""
    rows = []
    for u in range(60):
        if u < 45:
            rows += [(u, f"{u}-{i}", int(i == 0), 1.0 if i == 0 else 0.0, -1.0 if i == 0 else 0.0) for i in range(12)]
        else:
            rows += [(u, f"{u}-{i}", int(i < 60), -1.0 if i < 60 else 0.0, 1.0 if i < 60 else 0.0) for i in range(120)]
    df = spark.createDataFrame([("m", *r) for r in rows], "ym string, user_id long, item_id string, label int, a double, b double")
    plain = L.pairwise_ranker(["a", "b"]).fit(L.pairwise_rows(df, ["a", "b"]))
    listed = L.list_ranker(df, ["a", "b"])
    value = [L.mean_ndcg(L.list_discounts(L.add_margin(m, df))) for m in (plain, listed)]
    assert value[1] > value[0] + 0.05


def test_discounts_equal_plain_ndcg(spark):
    df = spark.createDataFrame([("m", 1, x, y, s) for x, y, s in (("p", 1, 0.9), ("q", 0, 0.5), ("r", 1, 0.1))],
                               "ym string, user_id long, item_id string, label int, score double")
    want = (1 + 1 / np.log2(4)) / (1 + 1 / np.log2(3))
    assert abs(L.mean_ndcg(L.list_discounts(df)) - want) < 1e-12


def test_copies_follow_the_weights(spark):
    rows = spark.range(20000).select(F.lit("m").alias("ym"), F.col("id").alias("user_id"), F.col("id").cast("string").alias("item_id"),
                                     F.when(F.col("id") % 4 == 0, 5.0).otherwise(0.3).alias("w"))
    out = L.copies_by_weight(rows, "w", ["ym", "user_id", "item_id"]).groupBy("w").agg(
        F.avg("copies").alias("m"), F.min("copies").alias("lo"), F.max("copies").alias("hi")).collect()
    scale = 2.0 / (0.25 * 5 + 0.75 * 0.3)
    for r in out:
        assert abs(r.m - r.w * scale) < 0.02 and r.lo == int(r.w * scale) and r.hi == r.lo + 1
    many = L.replicate_by_weight(rows, "w", ["ym", "user_id", "item_id"])
    assert abs(many.count() / 40000 - 1) < 0.02 and many.columns == rows.columns


def test_sweeps_state_every_configuration(table):
    months = ["2001-01", "2001-02", "2001-03"]
    linear = L.linear_sweep(table, months, FEATURES, (1, None), (0.5, 1.0), (1.0,), 20).collect()
    assert {r.config for r in linear} == {f"lr_w{w}_a{a}_c1.0" for w in (1, "all") for a in (0.5, 1.0)}
    one = L.out_of_fold(table, months, lambda t: L.logistic_on(t, FEATURES, 1.0, "weight", 20),
                        lambda r: L.Rp.weight_group_power(r, 0.5))
    want = L.R.group_auc(one, ["ym", "user_id"], "score").agg(*M.auc_aggregates()).first()
    got = next(r for r in linear if r.config == "lr_wall_a0.5_c1.0")
    assert abs(got.gauc_macro - want.gauc_macro) < 1e-6 and got.gauc_macro > 0.6
    trees = L.tree_sweep(table, months, FEATURES, {"x": (dict(depth=2, min_rows=5), 0.0), "y": (dict(depth=2, min_rows=5), 0.5)}, (1, 3))
    assert {r.config for r in trees.collect() if r.gauc_macro > 0.6} == {"x_1", "x_3", "y_1", "y_3"}


def test_grid_equals_one_metric_per_vector(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = []
    for u in [None, *range(9)]:
        for i in range(3 + 8 * (u or 0)):
            score = [None, float("nan"), 0.5, 0.5, float(rng.random())][rng.integers(5)]
            rows.append(("m", u, f"i{i:03d}", int(rng.random() < (0.3 if u != 3 else 0)), score, float(rng.integers(3))))
    df = spark.createDataFrame(rows, "ym string, user_id long, item_id string, label int, x double, y double")
    vectors = [(1.0, 0.0), (0.0, 1.0), (0.25, 0.75)]
    want = None
    for i, v in enumerate(vectors):
        part = M.group_metrics(df.withColumn("s", 0.0 + v[0] * F.col("x") + v[1] * F.col("y")), "s").withColumn("weight_id", F.lit(i))
        want = part if want is None else want.unionByName(part)
    columns = ["weight_id", "ym", "user_id", "n", "p", "auc", "ndcg", "recall", "hits"]

    def plain(frame):
        return sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in frame.select(*columns).collect()], key=str)

    expected = [r for r in plain(want) if r[2] is not None]  # the one-vector path joins on its keys and drops null ones
    for hot, block in ((100_000, 200_000), (100_000, 7), (20, 7)):
        monkeypatch.setattr(grids, "HOT_ROWS", hot)
        monkeypatch.setattr(grids, "BLOCK_ROWS", block)
        got = plain(grids.grid_group_metrics(df, ["x", "y"], vectors))
        assert [r for r in got if r[2] is not None] == expected
    assert Fu.grid_composite(df.where("1 = 0"), ["x", "y"], vectors).count() == 0


def test_all_schemes_equal_each_scheme(spark):
    rng = np.random.default_rng(3)
    lines = [(int(o) % 7, int(o), f"i{i}", f"2001-0{1 + o % 3}-0{1 + o % 9} 10:00:00") for o in range(30)
             for i in rng.choice(8, rng.integers(1, 5), replace=False)]
    tx = spark.createDataFrame(lines, "user_id long, order_id long, item_id string, t string").select(
        "user_id", "order_id", "item_id", F.col("t").cast("timestamp_ntz").alias("ts"))
    cut = F.lit("2001-05-01").cast("timestamp_ntz")
    rows = B.basket_rows(tx).withColumn("cut", cut)
    cand = spark.range(8).crossJoin(spark.range(9).withColumnRenamed("id", "i")).select(
        cut.alias("cut"), F.col("id").alias("user_id"), F.concat(F.lit("i"), "i").alias("item_id"))
    got = {(r.user_id, r.item_id): r for r in B.scheme_means(cand, rows, B.scheme_similarities(rows)).collect()}
    for s in B.SCHEMES:
        for r in B.basket_features(cand, rows, B.item_similarity(rows, s)).collect():
            assert abs(got[r.user_id, r.item_id][s] - r.sim_last3_mean) < 1e-9


def test_snapshot_follows_its_input(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "snap")
    built = []

    def build():
        built.append(1)
        return spark.read.parquet(source)

    spark.range(5).coalesce(1).write.parquet(source)
    assert [transactions.read_or_build(spark, path, build, [source]).count() for _ in range(2)] == [5, 5] and len(built) == 1
    time.sleep(1.1)
    spark.range(7).coalesce(1).write.mode("overwrite").parquet(source)
    assert transactions.read_or_build(spark, path, build, [source]).count() == 7 and len(built) == 2
    assert transactions.read_or_build(spark, path, build, [source], "other").count() == 7 and len(built) == 3
    done = next(d for d in os.listdir(path) if not d.startswith("manifest"))
    os.remove(f"{path}/{done}/_SUCCESS")  # an unfinished version is built again
    transactions.read_or_build(spark, path, build, [source])
    transactions.read_or_build(spark, path, build, [source], "other")
    assert len(built) == 4
    shutil.rmtree(path)


def test_candidates_keep_the_order_of_their_files(spark, tmp_path):
    rng = np.random.default_rng(4)
    want = []
    for name, n in (("a.csv", 4000), ("b.csv", 2500)):
        rows = [(int(u), f"I{i}") for u, i in rng.integers(0, 10 ** 6, (n, 2))]
        (tmp_path / name).write_text("CustomerID,StockCode\n" + "".join(f"{u},{i}\n" for u, i in rows))
        want += rows
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        read = spark.read.csv(str(tmp_path), header=True)
        assert read.rdd.getNumPartitions() > 4
        cand = transactions.read_candidates(read)
        scored = cand.repartition(5, "item_id").withColumn("score", F.lit(1.0))
        assert [(r.user_id, r.item_id) for r in transactions.submission(scored).collect()] == want
        numbered = spark.createDataFrame([(i, *r) for i, r in enumerate(want)], "n long, user_id long, item_id string")
        back = transactions.submission(transactions.read_candidates(numbered.repartition(7, "user_id"), ["n"]).withColumn("score", F.lit(0.0)))
        assert [(r.user_id, r.item_id) for r in back.collect()] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
