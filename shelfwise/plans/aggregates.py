"""E: aggregation and window forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import ranks as R
from shelfwise.functions import scalar as S
from shelfwise.operators import aggregates as A
from shelfwise.plans.base import Family
from shelfwise.plans import shared
from shelfwise.schema import MONTH_CUTS
from shelfwise.sources import retail

FAMILY = Family()
add = FAMILY.add


def tx(spark, d, **kw):
    return retail.retail_view(spark, d, **kw)


def r6(c):
    return F.round(c, 6).alias(c)


@add("e01_group_stats", """
SELECT item_id, count(*) AS n, count(DISTINCT user_id) AS users, sum(qty) AS units, min(qty) AS lo, max(qty) AS hi, round(avg(qty), 6) AS mean FROM tx GROUP BY item_id
""")
def e01(spark, d):
    return tx(spark, d).groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.sum("qty").alias("units"),
        F.min("qty").alias("lo"), F.max("qty").alias("hi"), F.round(F.avg("qty"), 6).alias("mean"))


@add("e02_group_median", "SELECT user_id, round(median(unit_price), 8) AS med FROM tx GROUP BY user_id")
def e02(spark, d):
    return R.grouped_median(tx(spark, d), ["user_id"], "unit_price", "med").withColumn("med", F.round("med", 8))


@add("e03_group_mode", """
SELECT user_id, category FROM (SELECT user_id, category, count(*) n FROM tx GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, category) = 1
""")
def e03(spark, d):
    return A.group_mode(tx(spark, d, product=True), ["user_id"], "category")


@add("e04_argmax", """
SELECT item_id, CAST(wd AS INTEGER) AS wd FROM (SELECT item_id, isodow(ts) - 1 AS wd, sum(qty) q FROM tx GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY q DESC, wd) = 1
""")
def e04(spark, d):
    q = tx(spark, d).groupBy("item_id", S.monday0("ts").alias("wd")).agg(F.sum("qty").alias("q"))
    return A.arg_max(q, ["item_id"], "wd", "q")


@add("e05_pivot", """
SELECT user_id, CAST(count(*) FILTER (WHERE category = 'ECONOMY') AS BIGINT) AS economy, count(*) FILTER (WHERE category = 'LARGE') AS large,
 count(*) FILTER (WHERE category = 'PROMO') AS promo FROM tx GROUP BY user_id
""")
def e05(spark, d):
    p = A.pivot_counts(tx(spark, d, product=True), "user_id", "category", ["ECONOMY", "LARGE", "PROMO"])
    return p.select("user_id", F.col("ECONOMY").alias("economy"), F.col("LARGE").alias("large"), F.col("PROMO").alias("promo"))


@add("e06_mean_of_counts", """
SELECT user_id, round(avg(n), 6) AS mean_items FROM (SELECT user_id, order_id, count(DISTINCT item_id) n FROM tx GROUP BY 1, 2) GROUP BY 1
""")
def e06(spark, d):
    return A.mean_of_counts(tx(spark, d), "user_id", "order_id", "item_id").select("user_id", F.round("mean_count", 6).alias("mean_items"))


@add("e07_collect_set", """
SELECT order_id, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT order_id, item_id FROM tx) GROUP BY 1
""")
def e07(spark, d):
    lists = A.collected_sets(tx(spark, d), "order_id", "item_id")
    return lists.select("order_id", F.array_join("items", ",").alias("items"))


@add("e08_group_total_on_rows", """
SELECT user_id, item_id, sum(qty) AS q, round(sum(qty) / (sum(sum(qty)) OVER (PARTITION BY user_id)), 6) AS share FROM tx GROUP BY 1, 2
""")
def e08(spark, d):
    q = tx(spark, d).groupBy("user_id", "item_id").agg(F.sum("qty").alias("q"))
    return A.with_group_sum(q, ["user_id"], "q", "t").select("user_id", "item_id", "q", F.round(F.col("q") / F.col("t"), 6).alias("share"))


@add("e09_pair_gap", """
SELECT user_id, item_id, CAST(ts AS DATE) AS day, date_diff('day', lag(ts) OVER (PARTITION BY user_id, item_id ORDER BY ts), ts) AS gap
FROM (SELECT DISTINCT user_id, item_id, ts FROM tx)
""")
def e09(spark, d):
    return A.pair_gaps(tx(spark, d)).select("user_id", "item_id", F.to_date("ts").alias("day"), F.col("gap").cast("bigint").alias("gap"))


@add("e10_position", """
SELECT order_id, item_id, line_no, qty, unit_price, row_number() OVER (PARTITION BY order_id ORDER BY line_no, item_id, qty, unit_price) - 1 AS pos FROM tx
""")
def e10(spark, d):
    return A.positions(tx(spark, d), ["order_id"], ["line_no", "item_id", "qty", "unit_price"]).select(
        "order_id", "item_id", "line_no", "qty", "unit_price", F.col("pos").cast("bigint").alias("pos"))


RANK_SQL = """
SELECT ym, user_id, item_id, {expr} AS v FROM (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY ym, user_id, s_rec) - 1) / 2.0 AS ar,
 count(*) OVER (PARTITION BY ym, user_id) AS gn FROM preds WINDOW w AS (PARTITION BY ym, user_id ORDER BY s_rec))
"""
GROUP = ["ym", "user_id"]


@add("e11_average_rank", RANK_SQL.format(expr="ar"))
def e11(spark, d):
    return R.average_rank(shared.predictions(spark, d), GROUP, "s_rec", "v").select("ym", "user_id", "item_id", "v")


@add("e12_first_rank", "SELECT ym, user_id, item_id, row_number() OVER (PARTITION BY ym, user_id ORDER BY s_rec DESC, item_id) AS v FROM preds")
def e12(spark, d):
    return R.first_rank_desc(shared.predictions(spark, d), GROUP, "s_rec", "item_id", "v").select(
        "ym", "user_id", "item_id", F.col("v").cast("bigint").alias("v"))


@add("e13_percent_rank", RANK_SQL.format(expr="round(CASE WHEN gn > 1 THEN (ar - 1) / (gn - 1) ELSE 0.0 END, 6)"))
def e13(spark, d):
    return R.percent_rank_zero_one(shared.predictions(spark, d), GROUP, "s_rec", "v").select(
        "ym", "user_id", "item_id", F.round("v", 6).alias("v"))


@add("e14_global_percentile", """
SELECT ym, user_id, item_id, round((rank() OVER (ORDER BY s_own) + (count(*) OVER (PARTITION BY s_own) - 1) / 2.0) / count(*) OVER (), 6) AS v FROM preds
""")
def e14(spark, d):
    return R.percent_rank_avg(shared.predictions(spark, d), [], "s_own", "v").select(
        "ym", "user_id", "item_id", F.round("v", 6).alias("v"))


@add("e15_last_k_rows", """
SELECT user_id, order_id, CAST(r AS INTEGER) AS r FROM (SELECT user_id, order_id, row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, order_id DESC) AS r FROM tx GROUP BY 1, 2) WHERE r <= 3
""")
def e15(spark, d):
    return A.last_orders(tx(spark, d), 3).select("user_id", "order_id", F.col("rank").alias("r"))


@add("e16_last_time_rows", "SELECT user_id, order_id, item_id, line_no FROM tx QUALIFY ts = max(ts) OVER (PARTITION BY user_id)")
def e16(spark, d):
    return A.last_time_rows(tx(spark, d)).select("user_id", "order_id", "item_id", "line_no")


@add("e17_last_order", """
SELECT user_id, order_id FROM tx QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, order_id DESC) = 1
""")
def e17(spark, d):
    return A.last_order(tx(spark, d))


@add("e18_macro_and_weighted_mean", """
SELECT round(avg(m), 6) AS macro, round(sum(m * n) / sum(CASE WHEN m IS NOT NULL THEN n END), 6) AS weighted
FROM (SELECT user_id, count(*) AS n, CASE WHEN count(*) > 30 THEN avg(qty) END AS m FROM tx GROUP BY 1)
""")
def e18(spark, d):
    g = tx(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("qty").alias("a")).withColumn(
        "m", F.when(F.col("n") > 30, F.col("a")))
    return A.macro_and_weighted(g, "m", "n").select(r6("macro"), r6("weighted"))


@add("e19_correlation", """
SELECT * FROM (
WITH r AS (SELECT *, rank() OVER (PARTITION BY ym, user_id ORDER BY s_rec) + (count(*) OVER (PARTITION BY ym, user_id, s_rec) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY ym, user_id ORDER BY s_own) + (count(*) OVER (PARTITION BY ym, user_id, s_own) - 1) / 2.0 AS rb FROM preds),
g AS (SELECT ym, user_id, corr(ra, rb) AS c FROM r GROUP BY 1, 2 HAVING count(*) >= 3 AND count(DISTINCT s_rec) > 1 AND count(DISTINCT s_own) > 1)
SELECT round((SELECT corr(s_rec, s_own) FROM preds), 6) AS pearson, round(avg(c), 6) AS mean_spearman, count(*) AS n_groups FROM g)
""")
def e19(spark, d):
    return A.correlations(shared.predictions(spark, d), GROUP, "s_rec", "s_own").select(r6("pearson"), r6("mean_spearman"), "n_groups")


@add("e20_quantiles", """
SELECT round(quantile_cont(n, 0.5), 6) AS q50, round(quantile_cont(n, 0.9), 6) AS q90, round(quantile_cont(n, 0.99), 6) AS q99
FROM (SELECT order_id, count(DISTINCT item_id) AS n FROM tx GROUP BY 1)
""")
def e20(spark, d):
    sizes = tx(spark, d).groupBy("order_id").agg(F.count_distinct("item_id").alias("n"))
    return A.quantiles(sizes, "n", [0.5, 0.9, 0.99]).select(*[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q50", "q90", "q99"))])
