"""J: candidate recall."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise import schema as C
from shelfwise.functions import ranks as R
from shelfwise.operators import aggregates as A, metrics as M, recall as Rc, similarity as sim
from shelfwise.plans.base import Family, cte
from shelfwise.sources import retail

FAMILY = Family()
add = FAMILY.add

cte("train", "SELECT * FROM tx QUALIFY ts < max(ts) OVER (PARTITION BY user_id)")
cte("test_rows", "SELECT * FROM tx QUALIFY ts = max(ts) OVER (PARTITION BY user_id)")
cte("basket", "SELECT DISTINCT user_id, item_id FROM test_rows")
cte("town", "SELECT DISTINCT user_id, item_id FROM train")
cte("tusers", "SELECT DISTINCT user_id FROM train")
cte("bsize", "SELECT user_id, count(*) AS size FROM basket GROUP BY 1")
cte("pop", "SELECT item_id, b, row_number() OVER (ORDER BY b DESC, item_id) AS pos FROM (SELECT item_id, count(DISTINCT user_id) AS b FROM train GROUP BY 1)")
cte("popq", "SELECT item_id, b, row_number() OVER (ORDER BY b DESC, item_id) AS pos FROM (SELECT item_id, sum(qty) AS b FROM train GROUP BY 1)")


def _fresh(source, score, order):
    return f"""SELECT user_id, item_id, {score} AS score, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS rank
FROM {source} s WHERE NOT EXISTS (SELECT 1 FROM town o WHERE o.user_id = s.user_id AND o.item_id = s.item_id)"""


cte("r_pop", _fresh("(SELECT user_id, item_id, pos FROM tusers, pop)", "pos", "pos") + " QUALIFY rank <= 50")
cte("r_popq", _fresh("(SELECT user_id, item_id, pos FROM tusers, popq)", "pos", "pos") + " QUALIFY rank <= 50")
cte("lastb", "SELECT DISTINCT user_id, item_id FROM train QUALIFY ts = max(ts) OVER (PARTITION BY user_id)")
cte("lasto", """
SELECT DISTINCT t.user_id, t.item_id FROM train t JOIN (SELECT user_id, arg_max(order_id, (ts, order_id)) AS o FROM train GROUP BY 1) m
ON m.user_id = t.user_id AND m.o = t.order_id
""")
cte("near12", "SELECT i, j, sim FROM vtop WHERE r <= 12")
cte("near5", "SELECT i, j, sim FROM vtop WHERE r <= 5")
cte("twt", "SELECT user_id, item_id, sum(qty) AS w FROM train WHERE qty > 0 GROUP BY 1, 2")
cte("twt_i", "SELECT item_id, sum(w * w) AS d, CAST(count(*) AS DOUBLE) AS n FROM twt GROUP BY 1")
cte("cf5", """
SELECT i, j, c / sqrt(x.d * y.d) AS sim FROM (SELECT a.item_id AS i, b.item_id AS j, sum(a.w * b.w) AS c FROM twt a JOIN twt b ON a.user_id = b.user_id AND a.item_id <> b.item_id GROUP BY 1, 2)
JOIN twt_i x ON x.item_id = i JOIN twt_i y ON y.item_id = j QUALIFY row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) <= 5
""")
cte("tbin", """
SELECT i, j, c / sqrt(x.n * y.n) AS sim FROM (SELECT a.item_id AS i, b.item_id AS j, CAST(count(*) AS DOUBLE) AS c FROM town a JOIN town b ON a.user_id = b.user_id AND a.item_id <> b.item_id GROUP BY 1, 2)
JOIN twt_i x ON x.item_id = i JOIN twt_i y ON y.item_id = j
""")


def _expand(near, seeds, cap):
    return _fresh(f"(SELECT user_id, j AS item_id, max(sim) AS sc FROM {seeds} q JOIN {near} n ON n.i = q.item_id GROUP BY 1, 2)",
                  "sc", "sc DESC, item_id") + f" QUALIFY rank <= {cap}"


def _uvec(src, norm):
    return f"""SELECT user_id, list(m{norm} ORDER BY k) AS vec FROM (SELECT user_id, k, m, sqrt(sum(m * m) OVER (PARTITION BY user_id)) AS nrm FROM (
 SELECT user_id, k, avg(x) AS m FROM (SELECT user_id, unnest(vec) AS x, unnest(range(len(vec))) AS k FROM town JOIN {src} USING (item_id)) GROUP BY 1, 2)) GROUP BY 1"""


cte("uv_unit", _uvec("vunit", ""))
cte("uv_raw", _uvec("vec_raw", " / nrm"))
cte("r_sim", _expand("near12", "lastb", 80))
cte("r_hist", _expand("near5", "town", 50))
cte("r_cf5", _expand("cf5", "town", 50))
cte("r_recent", _expand("near5", "lasto", 50))
cte("r_vec", _fresh("(SELECT user_id, v.item_id, round(list_inner_product(u.vec, v.vec), 10) AS sc FROM uv_unit u, vunit v)", "sc", "sc DESC, item_id") + " QUALIFY rank <= 80")
cte("r_vec5", _fresh("(SELECT user_id, v.item_id, round(list_inner_product(u.vec, v.vec), 10) AS sc FROM uv_raw u, vunit v)", "sc", "sc DESC, item_id") + " QUALIFY rank <= 50")
cte("r_itemcf", _fresh("(SELECT user_id, j AS item_id, round(sum(sim), 10) AS sc FROM town t JOIN tbin b ON b.i = t.item_id GROUP BY 1, 2)", "sc", "sc DESC, item_id") + " QUALIFY rank <= 50")
cte("routes3", """
SELECT user_id, item_id, 0 AS no, 'popular' AS route, 1 - (rank - 1) / 10.0 AS s FROM r_pop WHERE rank <= 10
UNION ALL SELECT user_id, item_id, 1, 'similar', 1 - (rank - 1) / 20.0 FROM r_sim WHERE rank <= 20
UNION ALL SELECT user_id, item_id, 2, 'user_vec', 1 - (rank - 1) / 20.0 FROM r_vec WHERE rank <= 20
""")
cte("merged3", """
SELECT user_id, item_id, max(s) AS score, string_agg(route, '|' ORDER BY no) AS routes, count(*) AS n_routes
FROM routes3 WHERE item_id IN (SELECT item_id FROM train) GROUP BY 1, 2
""")
cte("fill3", """
SELECT p.user_id, p.item_id, row_number() OVER (PARTITION BY p.user_id ORDER BY p.rank) - 1 AS f FROM r_pop p
WHERE NOT EXISTS (SELECT 1 FROM merged3 m WHERE m.user_id = p.user_id AND m.item_id = p.item_id)
""")
cte("fused3", """
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS recall_rank FROM (
 SELECT user_id, item_id, score, routes, n_routes FROM merged3
 UNION ALL SELECT f.user_id, f.item_id, greatest(CAST(0.02 AS DOUBLE), CAST(0.2 AS DOUBLE) - CAST(0.01 AS DOUBLE) * f.f), 'popular', 1 FROM fill3 f
 LEFT JOIN (SELECT user_id, count(*) AS n FROM merged3 GROUP BY 1) c ON c.user_id = f.user_id WHERE f.f < 50 - coalesce(c.n, 0)
) QUALIFY recall_rank <= 50
""")


def _stages(prefix, quotas):
    """CTEs of the ordered fusion: stage k adds from route k what earlier stages did not."""
    routes = [("popular", "r_popq"), ("similar", "r_hist"), ("user_vec", "r_vec5"), ("itemcf", "r_cf5"), ("recent", "r_recent")]
    cte(f"{prefix}_0", "SELECT user_id, item_id, 0 AS pos, '' AS route FROM r_popq WHERE false")
    for k, (name, table) in enumerate(routes, 1):
        q = max(quotas[name], 1)
        cte(f"{prefix}_{k}", f"""
SELECT * FROM {prefix}_{k - 1} UNION ALL
SELECT n.user_id, n.item_id, n.rn + coalesce(c.n, 0), '{name}' FROM (
 SELECT r.user_id, r.item_id, row_number() OVER (PARTITION BY r.user_id ORDER BY r.rank) AS rn FROM {table} r
 WHERE NOT EXISTS (SELECT 1 FROM {prefix}_{k - 1} a WHERE a.user_id = r.user_id AND a.item_id = r.item_id)) n
LEFT JOIN (SELECT user_id, count(*) AS n FROM {prefix}_{k - 1} GROUP BY 1) c ON c.user_id = n.user_id
WHERE n.rn <= {q} AND n.rn + coalesce(c.n, 0) <= 50
""")


QUOTAS_ZERO = {"popular": 0, "similar": 10, "user_vec": 15, "itemcf": 10, "recent": 5}
_stages("fz", C.QUOTAS_5)
_stages("fa", C.QUOTAS_5_ALT)
_stages("f0", QUOTAS_ZERO)


def split(spark, d):
    train, test = Rc.holdout(retail.retail_view(spark, d))
    return train.persist(), test


def r6(c):
    return F.round(c, 6).alias(c)


def three_routes(spark, d):
    train, test = split(spark, d)
    own, vec = Rc.owned_items(train).persist(), retail.item_vectors(spark, d)
    pop = Rc.popularity(train).persist()
    users = own.select("user_id").distinct()
    popular = Rc.popular_route(pop, own, users, 50).persist()
    near = Rc.vector_neighbours(vec, 12)
    routes = {
        "popular": popular, "similar": Rc.expand_route(near, A.last_time_rows(train), own, 80),
        "user_vec": Rc.vector_route(own, vec, 80),
    }
    fused = Rc.fuse_three(routes, popular, pop)
    return {"train": train, "test": test, "own": own, "pop": pop, "fused": fused, "vec": vec, "users": users, "popular": popular}


def five_routes(spark, d):
    train, test = split(spark, d)
    own, vec = Rc.owned_items(train).persist(), retail.item_vectors(spark, d)
    pop = Rc.popularity(train, "units").persist()
    near = Rc.vector_neighbours(vec, C.NEIGHBOR_K_5).persist()
    cf = sim.neighbours(sim.itemcf(sim.purchase_matrix(train, weighted=True)), C.NEIGHBOR_K_5)
    recent = train.join(A.last_order(train), ["user_id", "order_id"], "left_semi")
    routes = {
        "popular": Rc.popular_route(pop, own, own.select("user_id"), 50), "similar": Rc.expand_route(near, own, own, 50),
        "user_vec": Rc.vector_route(own, vec, 50, raw_mean=True), "itemcf": Rc.expand_route(cf, own, own, 50),
        "recent": Rc.expand_route(near, recent, own, 50),
    }
    return {"routes": {k: v.persist() for k, v in routes.items()}, "own": own, "pop": pop, "train": train, "test": test}


@add("j01_holdout_split", """
SELECT user_id, CAST(sum(CASE WHEN t THEN 1 ELSE 0 END) AS BIGINT) AS n_test, CAST(sum(CASE WHEN t THEN 0 ELSE 1 END) AS BIGINT) AS n_train
FROM (SELECT user_id, ts = max(ts) OVER (PARTITION BY user_id) AS t FROM tx) GROUP BY 1
""")
def j01(spark, d):
    train, test = Rc.holdout(retail.retail_view(spark, d))
    a = train.select("user_id", F.lit(0).alias("t"), F.lit(1).alias("n"))
    b = test.select("user_id", F.lit(1).alias("t"), F.lit(0).alias("n"))
    return a.unionAll(b).groupBy("user_id").agg(F.sum("t").alias("n_test"), F.sum("n").alias("n_train"))


@add("j02_owned_and_basket", """
SELECT 'owned' AS part, user_id, item_id FROM town UNION ALL SELECT 'basket', user_id, item_id FROM basket
""")
def j02(spark, d):
    train, test = Rc.holdout(retail.retail_view(spark, d))
    return Rc.owned_items(train).select(F.lit("owned").alias("part"), "user_id", "item_id").unionByName(
        Rc.owned_items(test).select(F.lit("basket").alias("part"), "user_id", "item_id"))


def _route_sql(table, score="round(score + 3e-11, 6)", k=50):
    return f"SELECT user_id, item_id, {score} AS score, CAST(rank AS INTEGER) AS rank FROM {table} WHERE rank <= {k}"


def _route(df, k=50):
    return df.filter(F.col("rank") <= k).select(
        "user_id", "item_id", F.round(F.col("score") + 3e-11, 6).alias("score"), "rank")


@add("j03_popular_route", _route_sql("r_pop", "CAST(1 - rank AS DOUBLE)"))
def j03(spark, d):
    train, _ = split(spark, d)
    own = Rc.owned_items(train)
    return _route(Rc.popular_route(Rc.popularity(train), own, own, 50))


@add("j04_popular_units_route", _route_sql("r_popq", "CAST(1 - rank AS DOUBLE)"))
def j04(spark, d):
    train, _ = split(spark, d)
    own = Rc.owned_items(train)
    return _route(Rc.popular_route(Rc.popularity(train, "units"), own, own, 50))


@add("j05_similar_route", _route_sql("r_sim", k=80))
def j05(spark, d):
    train, _ = split(spark, d)
    near = Rc.vector_neighbours(retail.item_vectors(spark, d), 12)
    return _route(Rc.expand_route(near, A.last_time_rows(train), Rc.owned_items(train), 80), 80)


@add("j06_user_vector_route", _route_sql("r_vec", k=80))
def j06(spark, d):
    train, _ = split(spark, d)
    return _route(Rc.vector_route(Rc.owned_items(train), retail.item_vectors(spark, d), 80), 80)


@add("j07_itemcf_route", _route_sql("r_itemcf"))
def j07(spark, d):
    train, _ = split(spark, d)
    own = Rc.owned_items(train)
    return _route(Rc.itemcf_route(own, sim.itemcf(own.withColumn("w", F.lit(1.0))), 50))


@add("j08_expand_merge", _route_sql("r_cf5", k=20))
def j08(spark, d):
    train, _ = split(spark, d)
    own = Rc.owned_items(train)
    cf = sim.neighbours(sim.itemcf(sim.purchase_matrix(train, weighted=True)), C.NEIGHBOR_K_5)
    return _route(Rc.expand_route(cf, own, own, 20), 20)


def _five(name):
    def run(spark, d):
        return _route(five_routes(spark, d)["routes"][name])

    return run


add("j06_user_vector_raw_route", _route_sql("r_vec5"))(_five("user_vec"))
add("j09_history_route", _route_sql("r_hist"))(_five("similar"))
add("j10_itemcf_neighbour_route", _route_sql("r_cf5"))(_five("itemcf"))
add("j11_recent_route", _route_sql("r_recent"))(_five("recent"))


@add("j12_three_route_fusion", """
SELECT user_id, item_id, round(score, 6) AS score, routes, CAST(n_routes AS INTEGER) AS n_routes, CAST(recall_rank AS INTEGER) AS recall_rank FROM fused3
""")
def j12(spark, d):
    return Rc.recall_table(three_routes(spark, d)["fused"])


def _fused5(quotas):
    def run(spark, d):
        f = Rc.fuse_ordered(five_routes(spark, d)["routes"], quotas)
        return f.select("user_id", "item_id", F.col("rank").cast("bigint").alias("rank"), "route")

    return run


_F5 = "SELECT user_id, item_id, pos AS rank, route FROM {t}_5"
add("j13_five_route_fusion", _F5.format(t="fz"))(_fused5(C.QUOTAS_5))
add("j13_quota_zero", _F5.format(t="f0"))(_fused5(QUOTAS_ZERO))


@add("j14_cold_start", """
SELECT user_id, item_id, CAST(pos AS INTEGER) AS rank, false AS is_cold_start FROM fz_5
UNION ALL SELECT c.user_id, p.item_id, CAST(p.pos AS INTEGER), true
FROM (SELECT c_custkey + 1000000 AS user_id FROM customer UNION SELECT user_id FROM test_rows EXCEPT SELECT user_id FROM train) c, popq p WHERE p.pos <= 50
""")
def j14(spark, d):
    f = five_routes(spark, d)
    fused = Rc.fuse_ordered(f["routes"], C.QUOTAS_5)
    strangers = retail.table(spark, d, "customer").select((F.col("c_custkey") + 1000000).alias("user_id"))
    requests = strangers.unionByName(f["train"].select("user_id")).unionByName(f["test"].select("user_id"))
    return Rc.with_cold_users(requests, fused, f["pop"], 50)


def _coverage_sql(t):
    return f"""SELECT count(DISTINCT user_id) AS n_users, count(*) AS n_rows, round(avg(CASE WHEN q.pos <= 100 THEN 1.0 ELSE 0.0 END), 6) AS hot_share,
 round(count(*) / count(DISTINCT user_id), 6) AS mean_length,
 round((SELECT avg(CASE WHEN n >= 50 THEN 1.0 ELSE 0.0 END) FROM (SELECT count(*) AS n FROM {t}_5 GROUP BY user_id)), 6) AS full_share,
 count(DISTINCT f.item_id) AS n_unique, round(count(DISTINCT q.item_id) / (SELECT count(*) FROM popq), 6) AS coverage
FROM {t}_5 f LEFT JOIN popq q ON q.item_id = f.item_id"""


def _coverage(spark, d, f, quotas):
    out = Rc.list_coverage(Rc.fuse_ordered(f["routes"], quotas), f["pop"], f["pop"])
    return out.select("n_users", "n_rows", r6("hot_share"), r6("mean_length"), r6("full_share"), "n_unique", r6("coverage"))


@add("j15_quota_comparison", f"SELECT 'default' AS quotas, * FROM ({_coverage_sql('fz')}) UNION ALL SELECT 'alt', * FROM ({_coverage_sql('fa')})")
def j15(spark, d):
    f = five_routes(spark, d)
    a = _coverage(spark, d, f, C.QUOTAS_5).withColumn("quotas", F.lit("default"))
    return a.unionByName(_coverage(spark, d, f, C.QUOTAS_5_ALT).withColumn("quotas", F.lit("alt")))


@add("j16_recall_table", """
SELECT user_id, string_agg(item_id || ':' || routes, ',' ORDER BY recall_rank) AS recall_list, count(*) AS list_length FROM fused3 GROUP BY 1
""")
def j16(spark, d):
    t = Rc.recall_table(three_routes(spark, d)["fused"]).withColumn("item_id", F.concat("item_id", F.lit(":"), "routes"))
    return Rc.recall_lists(t.withColumnRenamed("recall_rank", "rank"))


@add("j17_recall_diagnostics", """
SELECT * FROM (
WITH t AS (SELECT f.*, b.item_id IS NOT NULL AS hit, p.pos <= 100 AS hot, z.size FROM fused3 f JOIN bsize z USING (user_id)
 LEFT JOIN basket b ON b.user_id = f.user_id AND b.item_id = f.item_id JOIN pop p ON p.item_id = f.item_id),
u AS (SELECT user_id, max(size) AS size, count(*) AS n, count(*) FILTER (WHERE hit) AS h, count(*) FILTER (WHERE hot) AS hot, count(*) FILTER (WHERE n_routes >= 2) AS multi,
 max(CASE WHEN routes LIKE '%popular%' THEN 1.0 ELSE 0.0 END) AS a, max(CASE WHEN routes LIKE '%similar%' THEN 1.0 ELSE 0.0 END) AS b, max(CASE WHEN routes LIKE '%user_vec%' THEN 1.0 ELSE 0.0 END) AS c FROM t GROUP BY 1)
SELECT count(*) AS n_users, round(avg(h / size), 6) AS recall_at_k, round(avg(CASE WHEN h > 0 THEN 1.0 ELSE 0.0 END), 6) AS user_hit_share, round(avg(n), 6) AS rows_per_user,
 round(sum(hot) / sum(n), 6) AS hot_share, round(sum(multi) / sum(n), 6) AS multi_route_share, round(avg(a), 6) AS users_with_popular, round(avg(b), 6) AS users_with_similar,
 round(avg(c), 6) AS users_with_user_vec, round((SELECT count(DISTINCT item_id) FROM fused3) / (SELECT count(*) FROM pop), 6) AS coverage FROM u)
""")
def j17(spark, d):
    x = three_routes(spark, d)
    out = Rc.recall_diagnostics(x["fused"].persist(), x["test"], x["pop"], x["pop"])
    return out.select("n_users", *[r6(c) for c in out.columns if c != "n_users"])


add("j18_list_coverage", _coverage_sql("fz"))(lambda spark, d: _coverage(spark, d, five_routes(spark, d), C.QUOTAS_5))


def _pr(t):
    return f"""SELECT '{t}' AS method, round(avg(h5 / 5.0), 6) AS precision_5, round(avg(h10 / 10.0), 6) AS precision_10, round(avg(h10 / size), 6) AS recall_10, round(avg(CASE WHEN h10 > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_10
FROM (SELECT u.user_id, z.size, count(b.item_id) FILTER (WHERE r.rank <= 5) AS h5, count(b.item_id) FILTER (WHERE r.rank <= 10) AS h10 FROM tusers u JOIN bsize z USING (user_id)
 LEFT JOIN {t} r ON r.user_id = u.user_id LEFT JOIN basket b ON b.user_id = r.user_id AND b.item_id = r.item_id GROUP BY 1, 2)"""


def _pop_and_cf(spark, d):
    train, test = split(spark, d)
    own = Rc.owned_items(train).persist()
    pop = Rc.popular_route(Rc.popularity(train), own, own, 10).persist()
    cf = Rc.itemcf_route(own, sim.itemcf(own.withColumn("w", F.lit(1.0))), 10).persist()
    return train, test, own, pop, cf


@add("j19_popular_vs_itemcf", _pr("r_pop") + " UNION ALL " + _pr("r_itemcf"))
def j19(spark, d):
    train, test, own, pop, cf = _pop_and_cf(spark, d)
    parts = [M.list_metrics(x, test, users=own).withColumn("method", F.lit(n)) for x, n in ((pop, "r_pop"), (cf, "r_itemcf"))]
    return parts[0].unionByName(parts[1]).select("method", *[r6(c) for c in ("precision_5", "precision_10", "recall_10", "hit_10")])


@add("j19_top10_overlap", """
SELECT count(*) AS n_users, round(avg(jac), 6) AS jaccard_mean, round(median(jac), 6) AS jaccard_median FROM (
 SELECT user_id, count(*) FILTER (WHERE c = 2) / count(*) AS jac FROM (SELECT user_id, item_id, count(*) AS c FROM (
  SELECT user_id, item_id FROM r_pop WHERE rank <= 10 UNION ALL SELECT user_id, item_id FROM r_itemcf WHERE rank <= 10) GROUP BY 1, 2) GROUP BY 1)
""")
def j19b(spark, d):
    _, _, _, pop, cf = _pop_and_cf(spark, d)
    return Rc.top10_overlap(pop, cf).select("n_users", r6("jaccard_mean"), r6("jaccard_median"))


@add("j20_case_picker", """
SELECT z.user_id, z.size AS basket_size, g.user_id IS NOT NULL AS good_hit, p.user_id IS NOT NULL AS base_hit FROM bsize z
LEFT JOIN (SELECT DISTINCT r.user_id FROM r_itemcf r JOIN basket b ON b.user_id = r.user_id AND b.item_id = r.item_id WHERE rank <= 10) g ON g.user_id = z.user_id
LEFT JOIN (SELECT DISTINCT r.user_id FROM r_pop r JOIN basket b ON b.user_id = r.user_id AND b.item_id = r.item_id WHERE rank <= 10) p ON p.user_id = z.user_id
WHERE z.size BETWEEN 3 AND 30 ORDER BY (g.user_id IS NOT NULL AND p.user_id IS NULL) DESC, z.size DESC, z.user_id LIMIT 20
""")
def j20(spark, d):
    _, test, _, pop, cf = _pop_and_cf(spark, d)
    return Rc.pick_cases(test, cf, pop, n=20)
