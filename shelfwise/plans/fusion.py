"""Q: score fusion and rank transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.operators import fusion as Fu, season
from shelfwise.plans import shared
from shelfwise.plans.base import Family, cte
from shelfwise.plans.metrics import ALPHAS, COMP, groups_sql, r6, sweep_sql
from shelfwise.sources import retail, transactions as T

FAMILY = Family()
add = FAMILY.add
KEY = ["ym", "user_id", "item_id"]

cte("granks", """
SELECT *, (rank() OVER (ORDER BY s_pop) + (count(*) OVER (PARTITION BY s_pop) - 1) / 2.0) / count(*) OVER () AS g_pop,
 (rank() OVER (ORDER BY s_rec) + (count(*) OVER (PARTITION BY s_rec) - 1) / 2.0) / count(*) OVER () AS g_rec,
 (rank() OVER (ORDER BY s_own) + (count(*) OVER (PARTITION BY s_own) - 1) / 2.0) / count(*) OVER () AS g_own,
 (rank() OVER (PARTITION BY ym, user_id ORDER BY s_pop) + (count(*) OVER (PARTITION BY ym, user_id, s_pop) - 1) / 2.0) / count(*) OVER (PARTITION BY ym, user_id) AS u_pop,
 (rank() OVER (PARTITION BY ym, user_id ORDER BY s_own) + (count(*) OVER (PARTITION BY ym, user_id, s_own) - 1) / 2.0) / count(*) OVER (PARTITION BY ym, user_id) AS u_own
FROM preds
""")
cte("seasonal", """
SELECT DISTINCT item_id FROM tx WHERE regexp_matches(upper(descr), 'RING|PLATE') AND strftime(ts, '%Y-%m') IN ('2001-06', '2001-07')
""")
W3 = {"s_pop": 0.1, "s_rec": 0.3, "s_own": 0.6}


def preds(spark, d):
    return shared.predictions(spark, d)


@add("q01_global_rank_blend", "SELECT ym, user_id, item_id, round(0.1 * g_pop + 0.3 * g_rec + 0.6 * g_own + 1e-9, 6) AS score FROM granks")
def q01(spark, d):
    return Fu.blend_global_ranks(preds(spark, d), W3).select(*KEY, F.round(F.col("score") + 1e-9, 6).alias("score"))


@add("q02_user_rank_blend", "SELECT ym, user_id, item_id, round(0.4 * u_pop + 0.6 * u_own + 1e-9, 6) AS score FROM granks")
def q02(spark, d):
    return Fu.blend_group_ranks(preds(spark, d), {"s_pop": 0.4, "s_own": 0.6}).select(*KEY, F.round(F.col("score") + 1e-9, 6).alias("score"))


@add("q03_average", "SELECT ym, user_id, item_id, round(0.5 * s_pop + 0.5 * s_rec, 6) AS score FROM preds")
def q03(spark, d):
    return Fu.average_scores(preds(spark, d), ["s_pop", "s_rec"]).select(*KEY, r6("score"))


def _grid_sql(cols, vectors):
    values = ", ".join("(" + ", ".join([str(i), *[f"{w}::DOUBLE" for w in v]]) + ")" for i, v in enumerate(vectors))
    names = ", ".join(["weight_id", *[f"w{k}" for k in range(len(cols))]])
    expr = " + ".join(["0.0::DOUBLE", *[f"w{k} * {c}" for k, c in enumerate(cols)]])
    return f"(SELECT v.weight_id, p.*, {expr} AS fin FROM preds p, (VALUES {values}) v({names}))"


GRID3 = Fu.simplex(0.5, 3)
GRID2 = Fu.simplex(0.25, 2)


@add("q04_simplex_grid", f"""
SELECT weight_id, round(avg(auc), 6) AS gauc_macro, round(sum(auc * n) / sum(CASE WHEN auc IS NOT NULL THEN n END), 6) AS gauc_weighted
FROM {groups_sql('fin', _grid_sql(['s_pop', 's_rec', 's_own'], GRID3), 'weight_id, ym, user_id')} GROUP BY 1
""")
def q04(spark, d):
    out = Fu.grid_group_auc(preds(spark, d), ["s_pop", "s_rec", "s_own"], GRID3)
    return out.select("weight_id", r6("gauc_macro"), r6("gauc_weighted"))


@add("q05_two_model_sweep", f"""
SELECT weight_id, round({COMP}, 6) AS composite FROM {groups_sql('fin', _grid_sql(['s_pop', 's_own'], GRID2), 'weight_id, ym, user_id')} GROUP BY 1
""")
def q05(spark, d):
    return Fu.grid_composite(preds(spark, d), ["s_pop", "s_own"], GRID2).select("weight_id", r6("composite"))


@add("q06_pooled_vs_group_argmax", f"""
SELECT * FROM (
WITH g AS (SELECT weight_id, avg(auc) AS m FROM {groups_sql('fin', _grid_sql(['s_pop', 's_own'], GRID2), 'weight_id, ym, user_id')} GROUP BY 1),
p AS (SELECT weight_id, auc AS m FROM {groups_sql('fin', _grid_sql(['s_pop', 's_own'], GRID2), 'weight_id')})
SELECT 'group' AS metric, weight_id, round(m, 6) AS value FROM g QUALIFY row_number() OVER (ORDER BY m DESC, weight_id) = 1
UNION ALL SELECT 'pooled', weight_id, round(m, 6) FROM p QUALIFY row_number() OVER (ORDER BY m DESC, weight_id) = 1)
""")
def q06(spark, d):
    p, cols = preds(spark, d), ["s_pop", "s_own"]
    g = Fu.best_row(Fu.grid_group_auc(p, cols, GRID2), "gauc_macro", "weight_id").select(
        F.lit("group").alias("metric"), "weight_id", r6("gauc_macro", "value"))
    a = Fu.best_row(Fu.grid_pooled_auc(p, cols, GRID2), "auc", "weight_id").select(
        F.lit("pooled").alias("metric"), "weight_id", r6("auc", "value"))
    return g.unionByName(a)


@add("q07_residual_sweep", f"SELECT alpha, round({COMP}, 6) AS composite FROM {sweep_sql('s_rec')} GROUP BY 1")
def q07(spark, d):
    return Fu.alpha_sweep(Fu.add_residual(preds(spark, d), "s_rec"), "s_pop", ALPHAS).select("alpha", r6("composite"))


def boosted(spark, d):
    tx = retail.retail_view(spark, d, product=True)
    items = Fu.seasonal_items(tx, season.first_descr(tx), "RING|PLATE", ["2001-06", "2001-07"]).withColumn("flag", F.lit(1))
    return Fu.boost(preds(spark, d).join(items, "item_id", "left").na.fill(0, ["flag"]), "flag", 0.10, "s_pop")


@add("q08_seasonal_boost", """
SELECT ym, user_id, p.item_id, round(s_pop + CASE WHEN s.item_id IS NULL THEN 0 ELSE 0.1 END, 6) AS boosted FROM preds p LEFT JOIN seasonal s ON s.item_id = p.item_id
""")
def q08(spark, d):
    return boosted(spark, d).select(*KEY, r6("boosted"))


@add("q09_rank_uniform", """
SELECT ym, user_id, item_id, round(row_number() OVER (ORDER BY s_own, ym, user_id, item_id) / (count(*) OVER () + 1.0), 9) AS uniform FROM preds
""")
def q09(spark, d):
    return Fu.rank_uniform(preds(spark, d), "s_own", KEY).select(*KEY, F.round("uniform", 9).alias("uniform"))


@add("q09_user_blocks", """
SELECT ym, user_id, item_id, round((dense_rank() OVER (ORDER BY user_id) - 1 + row_number() OVER (PARTITION BY user_id ORDER BY s_own, ym, item_id)
 / (count(*) OVER (PARTITION BY user_id) + 1.0) * 0.98) / (SELECT count(DISTINCT user_id) FROM preds), 9) AS block FROM preds
""")
def q09b(spark, d):
    return Fu.user_blocks(preds(spark, d), "s_own", ["ym", "item_id"]).select(*KEY, F.round("block", 9).alias("block"))


@add("q10_fused_submission", """
SELECT user_id, item_id, round(0.1 * a + 0.9 * b + 1e-9, 6) AS score FROM (SELECT user_id, item_id,
 (rank() OVER (ORDER BY s_pop) + (count(*) OVER (PARTITION BY s_pop) - 1) / 2.0) / count(*) OVER () AS a,
 (rank() OVER (ORDER BY s_own) + (count(*) OVER (PARTITION BY s_own) - 1) / 2.0) / count(*) OVER () AS b FROM preds WHERE ym = '2001-07')
""")
def q10(spark, d):
    last = preds(spark, d).filter(F.col("ym") == "2001-07").withColumn("row_idx", F.monotonically_increasing_id())
    return T.submission(Fu.blend_global_ranks(last, {"s_pop": 0.1, "s_own": 0.9})).withColumn("score", F.round(F.col("score") + 1e-9, 6))


@add("q11_stored_fusion_equal", "SELECT count(*) AS n_rows, false AS equal, count(*) FILTER (WHERE user_id % 10 = 3) AS n_changed FROM preds")
def q11(spark, d):
    path = T.scratch_path(spark, "fusion")
    blend = Fu.average_scores(preds(spark, d), ["s_pop", "s_rec"]).select(*KEY, "score")
    changed = F.when(F.col("user_id") % 10 == 3, F.col("score") + 0.5).otherwise(F.col("score"))
    blend.withColumn("score", changed).write.parquet(path)
    stored = spark.read.parquet(path)
    return Fu.max_gap(blend, stored, KEY, "score", "score").select(
        "n_rows", (F.col("max_gap") <= 1e-12).alias("equal"), "n_changed")
