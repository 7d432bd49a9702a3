"""H: similarity and collaborative filtering; B20-B22 use its neighbour tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import scalar as S
from shelfwise.operators import baskets, profiling, recall, similarity as sim, vectors as V
from shelfwise.plans.base import Family, cte
from shelfwise.schema import CUT
from shelfwise.sources import retail, transactions

FAMILY = Family()
add = FAMILY.add

cte("pw", "SELECT user_id, item_id, sum(qty) AS w FROM tx WHERE qty > 0 GROUP BY 1, 2")
cte("pw_u", "SELECT user_id, sum(w * w) AS d, count(*) AS n FROM pw GROUP BY 1")
cte("pw_i", "SELECT item_id, sum(w * w) AS d, count(*) AS n FROM pw GROUP BY 1")
cte("ucos", """
SELECT i, j, c / sqrt(x.d * y.d) AS sim FROM (SELECT a.user_id AS i, b.user_id AS j, sum(a.w * b.w) AS c FROM pw a JOIN pw b ON a.item_id = b.item_id AND a.user_id <> b.user_id GROUP BY 1, 2)
JOIN pw_u x ON x.user_id = i JOIN pw_u y ON y.user_id = j
""")
cte("icos", """
SELECT i, j, c / sqrt(x.d * y.d) AS sim FROM (SELECT a.item_id AS i, b.item_id AS j, sum(a.w * b.w) AS c FROM pw a JOIN pw b ON a.user_id = b.user_id AND a.item_id <> b.item_id GROUP BY 1, 2)
JOIN pw_i x ON x.item_id = i JOIN pw_i y ON y.item_id = j
""")
cte("bcos", """
SELECT i, j, m, c / sqrt(x.n * y.n) AS sim FROM (SELECT a.item_id AS i, b.item_id AS j, count(*) AS m, CAST(count(*) AS DOUBLE) AS c FROM pairs a JOIN pairs b ON a.user_id = b.user_id AND a.item_id <> b.item_id GROUP BY 1, 2)
JOIN pw_i x ON x.item_id = i JOIN pw_i y ON y.item_id = j
""")
cte("utop", "SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS r FROM ucos QUALIFY r <= 10")
cte("itop", "SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS r FROM icos QUALIFY r <= 10")
cte("vec_raw", "SELECT CAST(vec_id AS VARCHAR) AS item_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings")
cte("vunit", "SELECT item_id, list_transform(vec, lambda x: x / sqrt(list_inner_product(vec, vec))) AS vec FROM vec_raw")
cte("vsim", """
SELECT a.item_id AS i, b.item_id AS j, round(list_inner_product(a.vec, b.vec), 10) AS sim FROM vunit a JOIN vunit b ON a.item_id <> b.item_id
""")
cte("vtop", "SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS r FROM vsim QUALIFY r <= 20")
cte("bk", """
SELECT user_id, order_id, item_id, count(*) OVER (PARTITION BY user_id, order_id) AS size, min(t) OVER (PARTITION BY user_id, order_id) AS bts
FROM (SELECT user_id, order_id, item_id, min(ts) AS t FROM hist GROUP BY 1, 2, 3)
""")


def tx(spark, d, **kw):
    return retail.retail_view(spark, d, **kw)


def r6(c):
    return F.round(c, 6).alias(c)


def off_half(c):
    """Six places for a value already rounded to ten: the shift keeps half-way cases apart."""
    return F.round(F.col(c) + 3e-11, 6).alias(c)


def weighted(spark, d):
    return sim.purchase_matrix(tx(spark, d), weighted=True).persist()


def binary(spark, d):
    return sim.purchase_matrix(tx(spark, d)).persist()


@add("h01_purchase_matrix", "SELECT user_id, item_id, w FROM pw")
def h01(spark, d):
    return weighted(spark, d)


@add("h02_similar_users", "SELECT j AS user_id, round(sim, 6) AS sim FROM ucos WHERE i = (SELECT min(user_id) FROM tx) ORDER BY ucos.sim DESC, j LIMIT 10")
def h02(spark, d):
    m = weighted(spark, d)
    first = m.agg(F.min("user_id").alias("u")).first()["u"]
    return sim.similar_users(m, first, 10).select("user_id", r6("sim"))


@add("h03_user_cosine_top_k", "SELECT i, j, round(sim, 4) AS sim, CAST(r AS INTEGER) AS rank FROM utop")
def h03(spark, d):
    return sim.neighbours(sim.usercf(weighted(spark, d)), 10).select("i", "j", F.round("sim", 4).alias("sim"), "rank")


@add("h04_item_cosine_top_k", "SELECT i, j, round(sim, 4) AS sim, CAST(r AS INTEGER) AS rank FROM itop")
def h04(spark, d):
    return sim.neighbours(sim.itemcf(weighted(spark, d)), 10).select("i", "j", F.round("sim", 4).alias("sim"), "rank")


@add("h05_binary_itemcf", "SELECT i, j, m, round(sim, 6) AS sim FROM bcos WHERE i < j")
def h05(spark, d):
    return sim.itemcf(binary(spark, d)).select("i", "j", "m", r6("sim"))


@add("h06_vector_top_k", "SELECT i AS item_id, j AS neighbor, round(sim + 3e-11, 6) AS sim, CAST(r AS INTEGER) AS rank FROM vtop")
def h06(spark, d):
    return V.all_pairs_top_k(retail.item_vectors(spark, d), 20).select("item_id", "neighbor", off_half("sim"), "rank")


_UVEC = """
SELECT user_id, k, round(m{norm}, 6) AS v FROM (SELECT user_id, k, m, sqrt(sum(m * m) OVER (PARTITION BY user_id)) AS nrm FROM (
 SELECT user_id, k, avg(x) AS m FROM (SELECT user_id, unnest(vec) AS x, unnest(range(len(vec))) AS k FROM pairs JOIN {src} USING (item_id)) GROUP BY 1, 2))
"""


def _vec_long(df):
    return df.select("user_id", F.posexplode("vec").alias("k", "v")).select("user_id", F.col("k").cast("bigint").alias("k"), r6("v"))


@add("h07_user_vectors", _UVEC.format(norm="", src="vunit"))
def h07(spark, d):
    return _vec_long(V.mean_vectors(recall.owned_items(tx(spark, d)), retail.item_vectors(spark, d)))


@add("h08_user_vectors_raw_mean", _UVEC.format(norm=" / nrm", src="vec_raw"))
def h08(spark, d):
    return _vec_long(V.mean_vectors(recall.owned_items(tx(spark, d)), retail.item_vectors(spark, d),
                                    normalise_items=False, normalise_mean=True))


@add("h09_vector_knn", "SELECT j AS item_id, round(sim + 3e-11, 6) AS sim FROM vsim WHERE i = '0' ORDER BY vsim.sim DESC, j LIMIT 20")
def h09(spark, d):
    return V.similar_to(retail.item_vectors(spark, d), "0", 20).select("item_id", off_half("sim"))


@add("h10_usercf_recommend", """
SELECT * FROM (
WITH bu AS (SELECT i, j, c / sqrt(x.n * y.n) AS sim FROM (SELECT a.user_id AS i, b.user_id AS j, CAST(count(*) AS DOUBLE) AS c FROM pairs a JOIN pairs b ON a.item_id = b.item_id AND a.user_id <> b.user_id GROUP BY 1, 2)
 JOIN pw_u x ON x.user_id = i JOIN pw_u y ON y.user_id = j),
t AS (SELECT i, j, sim FROM bu QUALIFY row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) <= 20),
v AS (SELECT i AS user_id, item_id, round(sum(sim), 10) AS score FROM t JOIN pairs p ON p.user_id = t.j GROUP BY 1, 2),
f AS (SELECT v.* FROM v ANTI JOIN pairs p ON p.user_id = v.user_id AND p.item_id = v.item_id)
SELECT user_id, item_id, round(score + 3e-11, 6) AS score FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY f.score DESC, item_id) <= 10)
""")
def h10(spark, d):
    return sim.recommend_usercf(binary(spark, d), 10).select("user_id", "item_id", off_half("score"))


@add("h11_itemcf_vote_recommend", """
SELECT * FROM (
WITH t AS (SELECT i, j, sim FROM bcos QUALIFY row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) <= 200),
v AS (SELECT user_id, j AS item_id, round(sum(sim), 10) AS score FROM pairs JOIN t ON t.i = pairs.item_id GROUP BY 1, 2),
f AS (SELECT v.* FROM v ANTI JOIN pairs p ON p.user_id = v.user_id AND p.item_id = v.item_id)
SELECT user_id, item_id, round(score + 3e-11, 6) AS score FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY f.score DESC, item_id) <= 10)
""")
def h11(spark, d):
    m = binary(spark, d)
    near = sim.neighbours(sim.itemcf(m), 200)
    return sim.recommend_item_votes(m, m, near, 10).select("user_id", "item_id", off_half("score"))


_VREC = """
SELECT * FROM (
WITH u AS (SELECT user_id, list(m ORDER BY k) AS vec FROM (SELECT user_id, k, avg(x) AS m FROM (SELECT user_id, unnest(vec) AS x, unnest(range(len(vec))) AS k FROM pairs JOIN vunit USING (item_id)) GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT user_id, item_id, round(list_inner_product(u.vec, v.vec), 10) AS sim FROM u, vunit v),
f AS (SELECT s.* FROM s ANTI JOIN pairs p ON p.user_id = s.user_id AND p.item_id = s.item_id WHERE sim > 0)
SELECT user_id, item_id, round(sim + 3e-11, 6) AS sim FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY f.sim DESC, item_id) <= 20)
"""


@add("h12_vector_recommend", _VREC)
def h12(spark, d):
    own, vec = recall.owned_items(tx(spark, d)), retail.item_vectors(spark, d)
    return V.recommend(V.mean_vectors(own, vec), vec, own, 20, positive_only=True).select("user_id", "item_id", off_half("sim"))


@add("h13_restrict_vocabulary", """
SELECT user_id, item_id, w FROM pw WHERE item_id IN (SELECT item_id FROM vunit)
""")
def h13(spark, d):
    return sim.restrict_items(weighted(spark, d), retail.item_vectors(spark, d)).select("user_id", "item_id", "w")


@add("h14_neighbour_agreement", """
SELECT * FROM (
WITH a AS (SELECT i, list(j) AS s, max(CASE WHEN r = 1 THEN j END) AS f, max(CASE WHEN r = 1 THEN sim END) AS t FROM vtop WHERE r <= 10 GROUP BY 1),
b AS (SELECT i, list(j) AS s, max(CASE WHEN r = 1 THEN j END) AS f, max(CASE WHEN r = 1 THEN sim END) AS t FROM itop GROUP BY 1)
SELECT count(*) AS n_items, round(median(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))), 6) AS median_jaccard,
 round(median(a.t), 6) AS median_top1_a, round(median(b.t), 6) AS median_top1_b, round(avg(CASE WHEN a.f = b.f THEN 1.0 ELSE 0.0 END), 6) AS same_top1
FROM a JOIN b ON a.i = b.i)
""")
def h14(spark, d):
    a = recall.vector_neighbours(retail.item_vectors(spark, d), 10)
    b = sim.neighbours(sim.itemcf(weighted(spark, d)), 10)
    out = sim.neighbour_agreement(a, b, "i", "j")
    return out.select("n_items", *[r6(c) for c in ("median_jaccard", "median_top1_a", "median_top1_b", "same_top1")])


@add("h15_anchor_report", """
SELECT t.i AS anchor, t.j AS item_id, CAST(t.r AS INTEGER) AS rank, round(t.sim, 4) AS sim, p.p_name AS descr, b.n AS buyers
FROM vtop t JOIN part p ON CAST(p.p_partkey AS VARCHAR) = t.j LEFT JOIN pw_i b ON b.item_id = t.j WHERE t.r <= 5
""")
def h15(spark, d):
    near = recall.vector_neighbours(retail.item_vectors(spark, d), 5)
    cat = profiling.item_catalog(tx(spark, d, product=True)).select("item_id", "buyers")
    names = retail.products(spark, d).select("item_id", "descr")
    rows = near.select(F.col("i").alias("anchor"), F.col("j").alias("item_id"), "rank", F.round("sim", 4).alias("sim"))
    return rows.join(names, "item_id").join(cat, "item_id", "left").select("anchor", "item_id", "rank", "sim", "descr", "buyers")


_CO = """
SELECT * FROM (
WITH w AS (SELECT user_id || '|' || order_id AS b, item_id, {w} AS w FROM bk),
c AS (SELECT x.item_id AS i, y.item_id AS j, sum(x.w * y.w) AS c, count(*) AS m FROM w x JOIN w y ON x.b = y.b AND x.item_id <> y.item_id GROUP BY 1, 2),
g AS (SELECT item_id, sum(w * w) AS d, count(*) AS n FROM w GROUP BY 1)
SELECT c.i, c.j, round({s} + 1e-9, 6) AS sim FROM c JOIN g gi ON gi.item_id = c.i JOIN g gj ON gj.item_id = c.j)
"""
_BIG = "CASE WHEN size > 1 THEN 1 / sqrt(size - 1.0) ELSE 1.0 END"
_COS = "c.c / sqrt(gi.d * gj.d)"
_DEC = " * exp(-date_diff('day', bts, TIMESTAMP '2001-06-01') / {t}.0)"


def _scheme_query(scheme):
    def run(spark, d):
        from shelfwise.operators.replay import as_of

        rows = as_of(baskets.basket_rows(tx(spark, d)), [CUT])
        return baskets.item_similarity(rows, scheme).select("i", "j", F.round(F.col("sim") + 1e-9, 6).alias("sim"))

    return run


for _name, _scheme, _w, _s in [
    ("h16_basket_cosine", "cos_bigbasket", _BIG, _COS),
    ("h17_basket_cosine_raw", "cos_raw", "1.0", _COS),
    ("h18_basket_jaccard", "jaccard", "1.0", "c.m / (gi.n + gj.n - c.m)"),
    ("h19_basket_conditional", "cond", _BIG, "least(c.c / gi.d, 1.0)"),
    ("h20_basket_decay_90", "cos_bigbasket_t90", _BIG + _DEC.format(t=90), _COS),
    ("h20_basket_decay_30", "cos_bigbasket_t30", _BIG + _DEC.format(t=30), _COS),
    ("h21_hypergraph", "hg_linear", "1 / sqrt(size)", _COS),
]:
    add(_name, _CO.format(w=_w, s=_s))(_scheme_query(_scheme))

_BUCKET = "CASE WHEN deg <= {0} THEN '{5}' WHEN deg <= {1} THEN '{6}' WHEN deg <= {2} THEN '{7}' WHEN deg <= {3} THEN '{8}' ELSE '{4}' END"
_UB = _BUCKET.format(2, 10, 50, 200, ">200 种", "1–2 种", "3–10 种", "11–50 种", "51–200 种")
_IB = _BUCKET.format(1, 5, 30, 200, ">200 人", "1 人", "2–5 人", "6–30 人", "31–200 人")


@add("b20_user_degree_buckets", f"""
SELECT {_UB} AS bucket, count(*) AS n, round(median(sim), 6) AS median_top1 FROM (SELECT n AS deg, sim FROM utop JOIN pw_u ON pw_u.user_id = i WHERE r = 1) GROUP BY 1
""")
def b20(spark, d):
    m = weighted(spark, d)
    near = sim.neighbours(sim.usercf(m), 1)
    return sim.degree_buckets(m, near, "user_id", sim.USER_DEGREE_BUCKETS).select("bucket", "n", r6("median_top1"))


@add("b21_item_buyer_buckets", f"""
SELECT {_IB} AS bucket, count(*) AS n, round(median(sim), 6) AS median_top1 FROM (SELECT n AS deg, sim FROM itop JOIN pw_i ON pw_i.item_id = i WHERE r = 1) GROUP BY 1
""")
def b21(spark, d):
    m = weighted(spark, d)
    near = sim.neighbours(sim.itemcf(m), 1)
    return sim.degree_buckets(m, near, "item_id", sim.ITEM_BUYER_BUCKETS).select("bucket", "n", r6("median_top1"))


@add("b21_buyer_summary", "SELECT count(*) FILTER (WHERE n = 1) AS one_buyer, median(n) AS median_buyers FROM pw_i")
def b21b(spark, d):
    return sim.buyer_summary(binary(spark, d))


@add("b22_top1_overlap", """
SELECT median(n) AS overlap_median, round(avg(n), 6) AS overlap_mean FROM (
 SELECT i, count(*) FILTER (WHERE b.item_id IS NOT NULL) AS n FROM utop JOIN pairs a ON a.user_id = i LEFT JOIN pairs b ON b.user_id = j AND b.item_id = a.item_id WHERE r = 1 GROUP BY 1)
""")
def b22(spark, d):
    m = weighted(spark, d)
    return sim.top1_overlap(m, sim.neighbours(sim.usercf(m), 1), "user_id", "item_id").select("overlap_median", r6("overlap_mean"))


@add("a14_neighbour_rows", """
SELECT i AS item_id, string_agg(j || ':' || CAST(r AS VARCHAR), ',' ORDER BY r) AS neighbors FROM vtop WHERE r <= 10 GROUP BY 1
""")
def a14(spark, d):
    path = transactions.scratch_path(spark, "neighbours")
    near = V.all_pairs_top_k(retail.item_vectors(spark, d), 10)
    transactions.neighbor_rows(near, "item_id", "neighbor", 10).write.json(path)
    back = spark.read.schema("item_id string, neighbors array<struct<id:string,sim:double>>").json(path)
    text = F.array_join(F.transform("neighbors", lambda e, k: F.concat(e["id"], F.lit(":"), (k + 1).cast("string"))), ",")
    return back.select("item_id", text.alias("neighbors"))
