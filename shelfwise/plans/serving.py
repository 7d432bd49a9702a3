"""K: ranking stage and batch serving."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfwise import schema as C
from shelfwise.operators import learners as L, profiling, recall as Rc, serving as Sv, similarity as sim, tree_models as Tm
from shelfwise.plans.base import Family, cte
from shelfwise.plans.recall import three_routes, _pop_and_cf
from shelfwise.sources import retail

FAMILY = Family()
add = FAMILY.add

cte("tprice", "SELECT item_id, median(unit_price) AS price FROM train GROUP BY 1")
cte("self_cf", """
SELECT user_id, item_id, sum(sim) AS s FROM (SELECT t.user_id, b.j AS item_id, b.sim FROM town t JOIN tbin b ON b.i = t.item_id
 UNION ALL SELECT user_id, item_id, 1.0 FROM town) GROUP BY 1, 2
""")


def r6(c):
    return F.round(c, 6).alias(c)


def wide(spark, d):
    x = three_routes(spark, d)
    pairs = sim.itemcf(x["own"].withColumn("w", F.lit(1.0)))
    rows = Sv.rank_features(x["fused"].persist(), x["train"], x["pop"], pairs, x["vec"])
    return x, Sv.basket_label(rows, x["test"])


_FEATS = [c for c in C.FEATURES_RANK]


@add("k01_rank_features", """
SELECT f.user_id, f.item_id, round(ln(1 + p.b), 6) AS pop_buyers_log, round((p.pos - 1) / ((SELECT count(*) FROM pop) - 1), 6) AS pop_rank_frac,
 round(ln(1 + t.price), 6) AS price_log, round(coalesce(list_inner_product(v.vec, u.vec), 0), 6) AS emb_sim_uservec, round(coalesce(c.s, 0), 6) AS cf_agg_sim,
 CAST(f.n_routes AS INTEGER) AS n_routes, CASE WHEN f.routes LIKE '%popular%' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS fl_pop, CASE WHEN f.routes LIKE '%similar%' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS fl_sim,
 CASE WHEN f.routes LIKE '%user_vec%' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS fl_vec, round(ln(1 + o.n), 6) AS user_n_owned_log
FROM fused3 f JOIN pop p USING (item_id) JOIN tprice t USING (item_id) LEFT JOIN vunit v ON v.item_id = f.item_id LEFT JOIN uv_unit u ON u.user_id = f.user_id
LEFT JOIN self_cf c ON c.user_id = f.user_id AND c.item_id = f.item_id JOIN (SELECT user_id, count(*) AS n FROM town GROUP BY 1) o ON o.user_id = f.user_id
""")
def k01(spark, d):
    _, w = wide(spark, d)
    return w.select("user_id", "item_id", "n_routes", *[r6(c) for c in _FEATS if c != "n_routes"])


@add("k02_basket_label", """
SELECT f.user_id, f.item_id, CASE WHEN b.user_id IS NULL THEN 0 ELSE 1 END AS label FROM fused3 f LEFT JOIN basket b ON b.user_id = f.user_id AND b.item_id = f.item_id
""")
def k02(spark, d):
    x = three_routes(spark, d)
    return Sv.basket_label(x["fused"].select("user_id", "item_id"), x["test"])


def _scored(spark, d):
    x, w = wide(spark, d)
    w = w.persist()
    model = L.logistic_on(w, _FEATS).fit(w)
    return x, w, model, L.add_probability(model, w)


@add("k03_score_and_rerank", """
SELECT f.user_id, f.item_id, CASE WHEN b.user_id IS NULL THEN 0 ELSE 1 END AS label, count(*) OVER (PARTITION BY f.user_id) AS n, true AS rank_ok, true AS score_ok
FROM fused3 f LEFT JOIN basket b ON b.user_id = f.user_id AND b.item_id = f.item_id
""")
def k03(spark, d):
    _, _, _, scored = _scored(spark, d)
    ranked = Sv.rerank(scored)
    w = Window.partitionBy("user_id")
    order = F.lag("score").over(w.orderBy("rank"))
    fine = (F.max("rank").over(w) == F.count(F.lit(1)).over(w)) & F.coalesce(order >= F.col("score"), F.lit(True))
    return ranked.select("user_id", "item_id", "label", F.count(F.lit(1)).over(w).alias("n"), fine.alias("rank_ok"),
                         F.col("score").between(0.0, 1.0).alias("score_ok"))


def _display_dims(spark, d):
    cat = profiling.item_catalog(retail.retail_view(spark, d, product=True))
    products = retail.products(spark, d).withColumn("descr_zh", F.when(F.col("category") == "PROMO", "").otherwise(F.upper("descr")))
    return cat, products


@add("k04_batch_top_n", "SELECT user_id, CAST(least(10, count(*)) AS BIGINT) AS n, true AS shown FROM fused3 GROUP BY 1")
def k04(spark, d):
    _, _, _, scored = _scored(spark, d)
    cat, products = _display_dims(spark, d)
    top = Sv.rerank(scored, k=10).select("user_id", "item_id", "rank", "score", F.array_join("routes", "|").alias("routes"))
    shown = F.col("descr").isNotNull() & F.col("descr_zh").isNotNull() & F.col("category").isNotNull() & (F.col("routes") != "")
    return Sv.display_rows(top, cat, products).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min(shown).alias("shown"))


_SHOW = """round(t.sim, 4) AS sim, CAST(t.r AS INTEGER) AS rank, p.p_name AS descr, CASE WHEN p.p_type = 'PROMO' THEN p.p_name ELSE upper(p.p_name) END AS descr_zh,
 p.p_type AS category, b.n AS buyers FROM {t} t JOIN part p ON CAST(p.p_partkey AS VARCHAR) = t.j LEFT JOIN pw_i b ON b.item_id = t.j WHERE t.r <= 5"""


@add("k05_similar_items", "SELECT 'item2vec' AS method, t.i AS source, t.j AS item_id, " + _SHOW.format(t="vtop")
     + " UNION ALL SELECT 'itemcf', t.i, t.j, " + _SHOW.format(t="itop"))
def k05(spark, d):
    cat, products = _display_dims(spark, d)
    cat = cat.persist()
    cols = ["method", "source", "item_id", "sim", "rank", "descr", "descr_zh", "category", "buyers"]
    vec = Sv.similar_items(Rc.vector_neighbours(retail.item_vectors(spark, d), 5), cat, products, 5).withColumn("method", F.lit("item2vec"))
    near = sim.neighbours(sim.itemcf(sim.purchase_matrix(retail.retail_view(spark, d), weighted=True)), 5)
    cf = Sv.similar_items(near, cat, products, 5).withColumn("method", F.lit("itemcf"))
    return vec.select(*cols).unionByName(cf.select(*cols))


@add("k06_method_comparison", """
SELECT r.user_id, method, CAST(rank AS INTEGER) AS rank, r.item_id, b.user_id IS NOT NULL AS hit FROM (
 SELECT user_id, 'popular' AS method, rank, item_id FROM r_pop WHERE rank <= 10 UNION ALL SELECT user_id, 'itemcf', rank, item_id FROM r_itemcf WHERE rank <= 10
 UNION ALL SELECT user_id, 'fused', recall_rank, item_id FROM fused3 WHERE recall_rank <= 10) r LEFT JOIN basket b ON b.user_id = r.user_id AND b.item_id = r.item_id
""")
def k06(spark, d):
    _, test, _, pop, cf = _pop_and_cf(spark, d)
    fused = three_routes(spark, d)["fused"].withColumnRenamed("recall_rank", "rank")
    return Sv.compare_methods({"popular": pop, "itemcf": cf, "fused": fused}, test).select("user_id", "method", "rank", "item_id", "hit")


_REQ = """SELECT CASE WHEN c_custkey % 5 = 0 THEN '' ELSE CAST(c_custkey * 2 AS VARCHAR) END AS user_id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CAST(c_custkey * 2 AS VARCHAR) END AS item_id,
 CASE WHEN c_custkey % 4 = 0 THEN 'xgb' ELSE 'lr' END AS ranker, c_custkey FROM customer"""


@add("k07_request_status", f"""
SELECT c_custkey, user_id, item_id, CASE WHEN user_id = '' AND item_id = '' THEN 'missing_id'
 WHEN item_id <> '' AND item_id NOT IN (SELECT item_id FROM tx) THEN 'cold_item'
 WHEN user_id <> '' AND user_id NOT IN (SELECT CAST(user_id AS VARCHAR) FROM tx) THEN 'unknown_user'
 WHEN ranker NOT IN ('lr', 'lgb') THEN 'bad_ranker' ELSE 'ok' END AS status FROM ({_REQ})
""")
def k07(spark, d):
    c = F.col("c_custkey")
    text = (c * 2).cast("string")
    req = retail.table(spark, d, "customer").select(
        F.when(c % 5 == 0, "").otherwise(text).alias("user_id"), F.when(c % 3 == 0, "").otherwise(text).alias("item_id"),
        F.when(c % 4 == 0, "xgb").otherwise("lr").alias("ranker"), "c_custkey")
    tx = retail.retail_view(spark, d)
    return Sv.request_status(req, tx, tx).select("c_custkey", "user_id", "item_id", "status")


@add("k08_display_rows", """
SELECT i.item_id, p.p_name AS descr, CASE WHEN p.p_type = 'PROMO' THEN p.p_name ELSE upper(p.p_name) END AS descr_zh, p.p_type AS category, i.n AS buyers
FROM pw_i i JOIN part p ON CAST(p.p_partkey AS VARCHAR) = i.item_id
""")
def k08(spark, d):
    cat, products = _display_dims(spark, d)
    return Sv.display_rows(cat.select("item_id"), cat, products).select("item_id", "descr", "descr_zh", "category", "buyers")


@add("k09_contribution_report", "SELECT m AS model, f AS feature, true AS valid FROM (VALUES ('lr'), ('gbt'), ('gbt_splits')) m(m), (VALUES "
     + ", ".join(f"('{f}')" for f in _FEATS) + ") f(f)")
def k09(spark, d):
    _, w, model, _ = _scored(spark, d)
    trees = L.boosted_trees(_FEATS, trees=100, depth=5).fit(w)
    rows = [("lr", f, v) for f, v in L.contribution_report(model, _FEATS)]
    rows += [("gbt", f, v) for f, v in L.contribution_report(trees, _FEATS)]
    report = spark.createDataFrame(rows, "model string, feature string, value double").unionByName(
        Tm.split_counts(trees, _FEATS).select(F.lit("gbt_splits").alias("model"), "feature", F.col("splits").cast("double").alias("value")))
    return report.select("model", "feature", (~F.isnan("value") & (F.abs("value") < float("inf"))).alias("valid"))
