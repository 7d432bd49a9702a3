"""D: join shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import ranks as R
from shelfwise.functions import scalar as S
from shelfwise.operators import features, profiling, replay, similarity as sim
from shelfwise.plans.base import Family
from shelfwise.schema import CUT, MONTH_CUTS
from shelfwise.sources import retail

FAMILY = Family()
add = FAMILY.add


def tx(spark, d, **kw):
    return retail.retail_view(spark, d, **kw)


@add("d01_user_last_time", "SELECT order_id, line_no, item_id, CAST(max(ts) OVER (PARTITION BY user_id) AS DATE) AS last_day FROM tx")
def d01(spark, d):
    return profiling.last_rows_flag(tx(spark, d)).select("order_id", "line_no", "item_id", F.to_date("last_ts").alias("last_day"))


@add("d02_left_default", """
SELECT d.invoice_no, d.item_id, coalesce(p.p_type, '其他') AS category, count(*) AS n FROM dirty d
LEFT JOIN part p ON CAST(p.p_partkey AS VARCHAR) = d.item_id GROUP BY ALL
""")
def d02(spark, d):
    rows = retail.dirty_transactions(spark, d)
    dim = retail.products(spark, d).select("item_id", "category")
    return rows.join(dim, "item_id", "left").groupBy(
        "invoice_no", "item_id", F.coalesce("category", F.lit("其他")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@add("d03_left_aggregate", """
SELECT c.user_id, c.item_id, coalesce(b.n, 0) AS buyers FROM cand c
LEFT JOIN (SELECT item_id, count(DISTINCT user_id) n FROM fut GROUP BY 1) b USING (item_id)
""")
def d03(spark, d):
    recent = tx(spark, d).filter(F.col("ts") >= S.at(CUT)).groupBy("item_id").agg(F.count_distinct("user_id").alias("buyers"))
    return retail.candidate_pairs(spark, d).join(recent, "item_id", "left").na.fill(0, ["buyers"]).select("user_id", "item_id", "buyers")


@add("d04_left_pair", """
SELECT c.user_id, c.item_id, coalesce(b.q, 0) AS qty FROM cand c
LEFT JOIN (SELECT user_id, item_id, sum(qty) q FROM hist GROUP BY 1, 2) b ON b.user_id = c.user_id AND b.item_id = c.item_id
""")
def d04(spark, d):
    pair = tx(spark, d).filter(F.col("ts") < S.at(CUT)).groupBy("user_id", "item_id").agg(F.sum("qty").alias("qty"))
    return retail.candidate_pairs(spark, d).join(pair, ["user_id", "item_id"], "left").na.fill(0.0, ["qty"])


@add("d05_left_user_category", """
SELECT c.user_id, c.item_id, coalesce(b.n, 0) AS n FROM cand c JOIN part p ON CAST(p.p_partkey AS VARCHAR) = c.item_id
LEFT JOIN (SELECT user_id, category, count(DISTINCT item_id) n FROM hist GROUP BY 1, 2) b ON b.user_id = c.user_id AND b.category = p.p_type
""")
def d05(spark, d):
    per_cat = tx(spark, d, product=True).filter(F.col("ts") < S.at(CUT)).groupBy("user_id", "category").agg(
        F.count_distinct("item_id").alias("n"))
    dim = retail.products(spark, d).select("item_id", "category")
    return retail.candidate_pairs(spark, d).join(dim, "item_id").join(per_cat, ["user_id", "category"], "left").na.fill(
        0, ["n"]).select("user_id", "item_id", "n")


@add("d06_known_candidates", """
SELECT strftime(u.cut, '%Y-%m') AS ym, c.user_id, c.item_id FROM cand c JOIN cut_user u ON u.user_id = c.user_id
JOIN cut_item i ON i.cut = u.cut AND i.item_id = c.item_id
""")
def d06(spark, d):
    hist = replay.as_of(tx(spark, d), MONTH_CUTS)
    return replay.known_candidates(retail.candidate_pairs(spark, d), hist).select(S.month_key("cut").alias("ym"), "user_id", "item_id")


@add("d07_anti_owned", "SELECT user_id, item_id FROM cand EXCEPT SELECT user_id, item_id FROM hist")
def d07(spark, d):
    own = tx(spark, d).filter(F.col("ts") < S.at(CUT)).select("user_id", "item_id")
    return retail.candidate_pairs(spark, d).join(own, ["user_id", "item_id"], "left_anti")


@add("d08_flag", """
SELECT c.user_id, c.item_id, CASE WHEN f.user_id IS NULL THEN 0 ELSE 1 END AS flag FROM cand c
LEFT JOIN fpairs f ON f.user_id = c.user_id AND f.item_id = c.item_id
""")
def d08(spark, d):
    f = tx(spark, d).filter(F.col("ts") >= S.at(CUT)).select("user_id", "item_id").distinct().withColumn("flag", F.lit(1))
    return retail.candidate_pairs(spark, d).join(f, ["user_id", "item_id"], "left").na.fill(0, ["flag"])


@add("d09_self_join", """
SELECT a.item_id AS i, b.item_id AS j, count(*) AS m FROM (SELECT DISTINCT order_id, item_id FROM tx) a
JOIN (SELECT DISTINCT order_id, item_id FROM tx) b ON a.order_id = b.order_id AND a.item_id < b.item_id GROUP BY 1, 2
""")
def d09(spark, d):
    rows = tx(spark, d).select("order_id", "item_id").distinct().withColumn("w", F.lit(1.0))
    return sim.pair_sums(rows, "order_id", "item_id").select("i", "j", "m")


@add("d10_one_to_one", """
SELECT ym, user_id, item_id, round(s_pop, 6) AS s_pop, round(s_rec, 6) AS s_rec FROM preds
""")
def d10(spark, d):
    from shelfwise.operators import fusion
    from shelfwise.plans import shared

    p = shared.predictions(spark, d)
    return fusion.join_predictions(
        p.select("ym", "user_id", "item_id", "s_pop"), p.select("ym", "user_id", "item_id", "s_rec"), ["ym", "user_id", "item_id"]
    ).select("ym", "user_id", "item_id", F.round("s_pop", 6).alias("s_pop"), F.round("s_rec", 6).alias("s_rec"))


@add("d11_key_alignment", """
SELECT count(*) FILTER (WHERE user_id % 7 <> 1 AND user_id % 7 <> 2) AS matched, count(*) FILTER (WHERE user_id % 7 = 1) AS left_only,
 count(*) FILTER (WHERE user_id % 7 = 2) AS right_only, count(*) FILTER (WHERE user_id % 7 = 3) AS duplicate_keys FROM preds
""")
def d11(spark, d):
    from shelfwise.operators import fusion
    from shelfwise.plans import shared

    p = shared.predictions(spark, d)
    keys = ["ym", "user_id", "item_id"]
    third = F.col("user_id") % 7
    left = p.select(*keys, "s_pop").filter(third != 2)
    right = p.select(*keys, "s_rec").filter(third != 1)
    return fusion.alignment_check(left, right.unionByName(right.filter(third == 3)), keys)


@add("d12_as_of", """
SELECT strftime(cut, '%Y-%m') AS ym, user_id, count(*) AS n_rows, count(DISTINCT item_id) AS items FROM cuts JOIN tx ON ts < cut GROUP BY 1, 2
""")
def d12(spark, d):
    return replay.as_of(tx(spark, d), MONTH_CUTS).groupBy(S.month_key("cut").alias("ym"), "user_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("item_id").alias("items"))


@add("d13_negative_pool", """
SELECT user_id, (SELECT count(DISTINCT item_id) FROM hist) - count(*) FILTER (WHERE item_id IN (SELECT item_id FROM hist)) AS pool FROM pairs GROUP BY user_id
""")
def d13(spark, d):
    from shelfwise.operators import sampling

    t = tx(spark, d)
    return sampling.pool_sizes(t.select("user_id", "item_id").distinct(), t.filter(F.col("ts") < S.at(CUT)).select("item_id").distinct())
