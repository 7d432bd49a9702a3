"""G: point-in-time features."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise import schema as C
from shelfwise.functions import scalar as S
from shelfwise.operators import features as Fe
from shelfwise.plans import shared
from shelfwise.plans.base import Family, cte
from shelfwise.schema import CUT, MONTH_CUTS
from shelfwise.sources import retail, transactions

FAMILY = Family()
add = FAMILY.add
TOP_N = 3  # the test products carry six categories; three are kept so that the rest is folded

CUT_SQL = "TIMESTAMP '2001-06-01'"
cte("h", f"SELECT *, date_diff('day', ts, {CUT_SQL}) AS age, qty * unit_price AS spend FROM hist")
cte("h_pair", """
SELECT user_id, item_id, count(DISTINCT order_id) AS n_ord, sum(qty) AS qty, sum(spend) AS spend, min(age) AS last_age,
       max(age) AS first_age, count(DISTINCT ts) AS n_times, count(DISTINCT strftime(ts, '%Y-%m')) AS n_months,
       count(DISTINCT CASE WHEN age <= 30 THEN order_id END) AS n_ord30, max(ts) AS last_ts
FROM h GROUP BY 1, 2
""")
cte("raw_map", """
SELECT category, CASE WHEN row_number() OVER (ORDER BY sum(spend) DESC, category) <= 3 THEN category ELSE '其他' END AS collapsed,
       sum(spend) AS spend FROM h GROUP BY category
""")
cte("item_cat", """
SELECT CAST(p_partkey AS VARCHAR) AS item_id, coalesce(collapsed, '其他') AS collapsed
FROM part LEFT JOIN raw_map ON category = p_type
""")
cte("bucket", """
SELECT collapsed, sum(spend) AS bucket_spend, sum(spend) / sum(sum(spend)) OVER () AS bucket_share,
       CAST(row_number() OVER (ORDER BY sum(spend) DESC, collapsed) - 1 AS DOUBLE) AS ordinal FROM raw_map GROUP BY collapsed
""")
cte("u_tot", """
SELECT user_id, count(DISTINCT order_id) AS n_orders, count(DISTINCT item_id) AS n_items, sum(qty) AS qty, sum(spend) AS spend,
       count(DISTINCT CAST(ts AS DATE)) AS days, min(age) AS gap, count(DISTINCT strftime(ts, '%Y-%m')) AS n_months
FROM h GROUP BY user_id
""")
cte("u_basket", """
SELECT user_id, avg(n) AS basket, avg(CASE WHEN isodow(t) >= 6 THEN 1.0 ELSE 0.0 END) AS weekend_ratio
FROM (SELECT user_id, order_id, count(DISTINCT item_id) AS n, min(ts) AS t FROM h GROUP BY 1, 2) GROUP BY 1
""")
cte("u_ent", """
SELECT user_id, CASE WHEN count(*) >= 2 THEN -sum(c / t * ln(c / t)) / ln(count(*)) ELSE 0 END AS ent
FROM (SELECT user_id, collapsed, count(*) AS c, sum(count(*)) OVER (PARTITION BY user_id) AS t
      FROM hpairs JOIN item_cat USING (item_id) GROUP BY 1, 2) GROUP BY 1
""")
cte("u_share", """
SELECT user_id, collapsed, sum(spend) / sum(sum(spend)) OVER (PARTITION BY user_id) AS share
FROM h_pair JOIN item_cat USING (item_id) GROUP BY 1, 2
""")
cte("u_country", """
SELECT user_id, country FROM (SELECT user_id, country, count(*) AS n FROM h GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, country) = 1
""")
cte("u_feat", """
SELECT user_id, ln(1 + n_orders) AS u_n_orders_log, ln(1 + n_items) AS u_n_items_log, ln(1 + qty) AS u_qty_log, ln(1 + spend) AS u_spend_log,
 ln(1 + spend / qty) AS u_avg_unit_price_log, ln(1 + basket) AS u_avg_basket_size_log, ln(1 + days) AS u_active_days_log,
 ln(1 + gap) AS u_last_active_gap_log, weekend_ratio AS u_weekend_ratio, ent AS u_cat_entropy, spend / qty AS avg_price, n_months
FROM u_tot JOIN u_basket USING (user_id) JOIN u_ent USING (user_id)
""")
cte("i_tot", """
SELECT item_id, count(DISTINCT user_id) AS buyers, count(DISTINCT order_id) AS orders, sum(qty) AS qty, median(unit_price) AS price_med,
 max(age) AS first_age, min(age) AS last_age, count(DISTINCT CASE WHEN age <= 7 THEN user_id END) AS r7_buy,
 count(DISTINCT CASE WHEN age <= 30 THEN user_id END) AS r30_buy, count(DISTINCT CASE WHEN age <= 30 THEN order_id END) AS r30_ord,
 count(DISTINCT CASE WHEN age <= 60 THEN user_id END) AS r60_buy FROM h GROUP BY item_id
""")
cte("i_wd", """
SELECT item_id, wd FROM (SELECT item_id, isodow(ts) - 1 AS wd, sum(qty) AS q FROM h GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY q DESC, wd) = 1
""")
cte("i_rep", "SELECT item_id, sum(n_ord - 1) / sum(n_ord) AS rep_frac FROM h_pair GROUP BY 1")
cte("i_feat", """
SELECT i.item_id, ln(1 + buyers) AS i_pop_buyers_log, ln(1 + orders) AS i_pop_orders_log, ln(1 + qty) AS i_qty_log, ln(1 + price_med) AS i_price_log,
 (row_number() OVER (ORDER BY buyers DESC, i.item_id) - 1) / (count(*) OVER () - 1) AS i_pop_rank_frac,
 ln(1 + first_age) AS i_first_gap_log, ln(1 + last_age) AS i_last_gap_log, CAST(wd AS DOUBLE) AS i_top_weekday_code,
 ln(1 + r7_buy) AS i_r7_buy_log, ln(1 + r30_buy) AS i_r30_buy_log, ln(1 + r30_ord) AS i_r30_ord_log, ln(1 + r60_buy) AS i_r60_buy_log,
 ln(1 + r30_buy / greatest(buyers - r30_buy, 1)) AS i_growth30_log, rep_frac AS i_rep_incid_frac
FROM i_tot i JOIN i_wd USING (item_id) JOIN i_rep USING (item_id)
""")
cte("h_cycle", """
SELECT user_id, item_id, count(*) AS n, median(gap) AS med, max(day) AS last_day FROM (
 SELECT user_id, item_id, date_diff('day', TIMESTAMP '1970-01-01', ts) AS day,
  date_diff('day', lag(ts) OVER (PARTITION BY user_id, item_id ORDER BY ts), ts) AS gap FROM (SELECT DISTINCT user_id, item_id, ts FROM h)) GROUP BY 1, 2
""")
cte("cf_dup", "SELECT user_id, item_id FROM hpairs")
cte("cf_n", "SELECT item_id, count(*) AS n FROM hpairs GROUP BY 1")
cte("cf_sim", """
SELECT a.item_id AS i, b.item_id AS j, count(*) / sqrt(max(x.n) * max(y.n)) AS sim FROM hpairs a JOIN hpairs b ON a.user_id = b.user_id
JOIN cf_n x ON x.item_id = a.item_id JOIN cf_n y ON y.item_id = b.item_id GROUP BY 1, 2
""")
cte("vec_unit", """
SELECT CAST(vec_id AS VARCHAR) AS item_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS vec FROM embeddings
""")
cte("vec_near", """
SELECT i, j, sim, r FROM (SELECT a.item_id AS i, b.item_id AS j, list_inner_product(a.vec, b.vec) AS sim,
 row_number() OVER (PARTITION BY a.item_id ORDER BY list_inner_product(a.vec, b.vec) DESC, b.item_id) AS r
 FROM vec_unit a JOIN vec_unit b ON a.item_id <> b.item_id) WHERE r <= 20
""")
cte("u_vec", """
SELECT user_id, list(m ORDER BY k) AS vec FROM (SELECT user_id, k, avg(x) AS m FROM (
 SELECT user_id, unnest(vec) AS x, unnest(range(len(vec))) AS k FROM hpairs JOIN vec_unit USING (item_id)) GROUP BY 1, 2) GROUP BY 1
""")


def tx(spark, d, **kw):
    return retail.retail_view(spark, d, **kw)


def bundle(spark, d, cuts=(CUT,)):
    return Fe.build_bundle(tx(spark, d, country=True), retail.products(spark, d), list(cuts), TOP_N)


def hist(spark, d, **kw):
    return Fe.history(tx(spark, d, **kw), [CUT])


def rows(spark, d):
    return shared.candidates(spark, d).withColumn("cut", S.at(CUT))


def rounded(df, keys, cols):
    return df.select(*keys, *[F.round(c, 6).alias(c) for c in cols])


def round_sql(*cols, prefix=""):
    return ", ".join(f"round({prefix}{c}, 6) AS {c}" for c in cols)


@add("g01_window_split", "SELECT user_id, count(*) FILTER (WHERE ts < TIMESTAMP '2001-06-01') AS n_hist, count(*) FILTER (WHERE ts >= TIMESTAMP '2001-06-01') AS n_label FROM tx GROUP BY 1")
def g01(spark, d):
    fp, lp = Fe.window_split(tx(spark, d), CUT)
    a = fp.select("user_id", F.lit(1).alias("h"), F.lit(0).alias("l"))
    b = lp.select("user_id", F.lit(0).alias("h"), F.lit(1).alias("l"))
    return a.unionAll(b).groupBy("user_id").agg(F.sum("h").alias("n_hist"), F.sum("l").alias("n_label"))


def _cats(spark, d):
    return Fe.collapse_categories(hist(spark, d), retail.products(spark, d), TOP_N, by=["cut"])


@add("g02_category_collapse", "SELECT item_id, collapsed FROM item_cat")
def g02(spark, d):
    items = retail.products(spark, d).select("item_id").withColumn("cut", S.at(CUT))
    return _cats(spark, d).of_items(items, retail.products(spark, d)).select("item_id", "collapsed")


@add("g03_bucket_table", "SELECT collapsed, round(bucket_spend, 2) AS bucket_spend, round(bucket_share, 6) AS bucket_share, ordinal FROM bucket")
def g03(spark, d):
    return _cats(spark, d).buckets.select(
        "collapsed", F.round("bucket_spend", 2).alias("bucket_spend"), F.round("bucket_share", 6).alias("bucket_share"),
        F.col("cat_code_ordinal").alias("ordinal"))


def _user_query(col):
    def run(spark, d):
        return rounded(bundle(spark, d).users, ["user_id"], [col])

    return run


for _n, _c in zip(range(4, 14), C.FEATURES_USER):
    add(f"g{_n:02d}_{_c}", f"SELECT user_id, round({_c}, 6) AS {_c} FROM u_feat")(_user_query(_c))


@add("g14_user_category_share", "SELECT user_id, collapsed, round(share, 6) AS share FROM u_share")
def g14(spark, d):
    b = bundle(spark, d)
    return rounded(Fe.user_category_share(b.pairs, b.cats, b.products), ["user_id", "collapsed"], ["share"])


@add("g15_user_country", """
SELECT user_id, country, CAST(country NOT IN ('United Kingdom', 'France') AS INT)::DOUBLE AS country_other, CAST(country = 'United Kingdom' AS INT)::DOUBLE AS country_uk
FROM (SELECT user_id, CASE country WHEN (SELECT max(n_name) FROM nation) THEN 'France' WHEN (SELECT min(n_name) FROM nation) THEN 'United Kingdom' ELSE country END AS country FROM u_country)
""")
def g15(spark, d):
    h = hist(spark, d, country=True)
    names = retail.table(spark, d, "nation").agg(F.min("n_name").alias("a"), F.max("n_name").alias("z")).first()
    c = Fe.user_country(h).withColumn("country", F.when(F.col("country") == names["a"], "United Kingdom")
                                      .when(F.col("country") == names["z"], "France").otherwise(F.col("country")))
    return c.select("user_id", "country", *[x for i, x in enumerate(S.country_indicators("country")) if i in (0, 4)])


def _item_query(cols):
    def run(spark, d):
        items = tx(spark, d).select("item_id").distinct().withColumn("cut", S.at(CUT))
        b = bundle(spark, d)
        out = Fe.add_item_recent(items, b) if cols[0] in Fe_recent else Fe.add_item(items, b)
        return rounded(out, ["item_id"], cols)

    return run


Fe_recent = {"i_r30_buy_log", "i_r30_ord_log", "i_r60_buy_log", "i_growth30_log", "i_r7_buy_log", "i_rep_incid_frac"}
_ITEM = [
    ("g16", "i_pop_buyers_log"), ("g17", "i_pop_orders_log"), ("g18", "i_qty_log"), ("g19", "i_price_log"),
    ("g20", "i_pop_rank_frac"), ("g21", "i_first_gap_log"), ("g22", "i_last_gap_log"), ("g23", "i_top_weekday_code"),
    ("g35", "i_r30_buy_log", "i_r30_ord_log"), ("g36", "i_r60_buy_log"), ("g37", "i_growth30_log"),
    ("g46", "i_r7_buy_log"), ("g49", "i_rep_incid_frac"),
]
for _id, *_cols in _ITEM:
    _sel = ", ".join(f"round(coalesce({c}, 0), 6) AS {c}" for c in _cols)
    add(f"{_id}_{_cols[0]}", f"SELECT item_id, {_sel} FROM (SELECT DISTINCT item_id FROM tx) LEFT JOIN i_feat USING (item_id)")(_item_query(_cols))


@add("g24_category_columns", """
SELECT user_id, item_id, round(ln(1 + bucket_spend), 6) AS i_cat_sales_log, round(bucket_share, 6) AS i_cat_sales_share, ordinal AS cat_code_ordinal
FROM cand JOIN item_cat USING (item_id) JOIN bucket USING (collapsed)
""")
def g24(spark, d):
    return Fe.add_category(rows(spark, d), bundle(spark, d)).select(
        "user_id", "item_id", F.round("i_cat_sales_log", 6).alias("i_cat_sales_log"),
        F.round("i_cat_sales_share", 6).alias("i_cat_sales_share"), "cat_code_ordinal")


@add("g25_category_lift", """
SELECT c.user_id, c.item_id, round(ln(1 + coalesce(s.share, 0) / greatest(bucket_share, 1e-9)), 6) AS ui_cat_lift_log
FROM cand c JOIN item_cat USING (item_id) JOIN bucket USING (collapsed) LEFT JOIN u_share s ON s.user_id = c.user_id AND s.collapsed = item_cat.collapsed
""")
def g25(spark, d):
    return rounded(Fe.add_category(rows(spark, d), bundle(spark, d)), ["user_id", "item_id"], ["ui_cat_lift_log"])


@add("g26_price_gap", """
SELECT c.user_id, c.item_id, round(CASE WHEN u.user_id IS NULL OR i.item_id IS NULL THEN 0 ELSE i_price_log - ln(1 + avg_price) END, 6) AS ui_price_gap_log
FROM cand c LEFT JOIN u_feat u ON u.user_id = c.user_id LEFT JOIN i_feat i ON i.item_id = c.item_id
""")
def g26(spark, d):
    b = bundle(spark, d)
    return rounded(Fe.add_price_gap(Fe.add_item(Fe.add_user(rows(spark, d), b), b)), ["user_id", "item_id"], ["ui_price_gap_log"])


@add("g27_vector_similarity", """
SELECT c.user_id, c.item_id, round(coalesce(list_inner_product(v.vec, u.vec), 0), 6) AS ui_emb_sim
FROM cand c LEFT JOIN vec_unit v ON v.item_id = c.item_id LEFT JOIN u_vec u ON u.user_id = c.user_id
""")
def g27(spark, d):
    out = Fe.add_vector_similarity(rows(spark, d), bundle(spark, d), retail.item_vectors(spark, d))
    return rounded(out, ["user_id", "item_id"], ["ui_emb_sim"])


@add("g28_neighbour_hit_rate", """
SELECT c.user_id, c.item_id, round(count(o.item_id) / 20.0, 6) AS ui_nn_hit_rate
FROM cand c LEFT JOIN vec_near n ON n.i = c.item_id LEFT JOIN hpairs o ON o.user_id = c.user_id AND o.item_id = n.j GROUP BY 1, 2
""")
def g28(spark, d):
    out = Fe.add_neighbour_hits(rows(spark, d), bundle(spark, d), retail.item_vectors(spark, d))
    return rounded(out, ["user_id", "item_id"], ["ui_nn_hit_rate"])


@add("g29_cf_similarity", """
SELECT c.user_id, c.item_id, round(coalesce(sum(s.sim), 0), 6) AS ui_cf_sim FROM cand c LEFT JOIN hpairs o ON o.user_id = c.user_id
LEFT JOIN cf_sim s ON s.i = c.item_id AND s.j = o.item_id GROUP BY 1, 2
""")
def g29(spark, d):
    return rounded(Fe.add_cf(rows(spark, d), bundle(spark, d)), ["user_id", "item_id"], ["ui_cf_sim"])


@add("g30_owned", """
SELECT c.user_id, c.item_id, CASE WHEN p.user_id IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS ui_owned FROM cand c
LEFT JOIN h_pair p ON p.user_id = c.user_id AND p.item_id = c.item_id
""")
def g30(spark, d):
    return Fe.add_owned(rows(spark, d), bundle(spark, d)).select("user_id", "item_id", "ui_owned")


def _pair_query(fn, cols):
    def run(spark, d):
        return rounded(fn(rows(spark, d), bundle(spark, d)), ["user_id", "item_id"], cols)

    return run


_LEFT = "FROM cand c LEFT JOIN h_pair p ON p.user_id = c.user_id AND p.item_id = c.item_id"
for _id, _fn, _c, _expr in [
    ("g31", Fe.add_owned, "ui_owned_recency_log", "ln(1 + coalesce(p.last_age, 0))"),
    ("g32", Fe.add_pair_history, "p_ui_n_ord_log", "ln(1 + coalesce(p.n_ord, 0))"),
    ("g33", Fe.add_pair_history, "p_ui_qty_log", "ln(1 + coalesce(p.qty, 0))"),
    ("g34", Fe.add_pair_history, "p_ui_first_age_log", "ln(1 + coalesce(p.first_age, 0))"),
    ("g48", Fe.add_pair_history, "p_ui_recent_ord30_log", "ln(1 + coalesce(p.n_ord30, 0))"),
    ("g44", Fe.add_cycles, "p_n_dates_log", "ln(1 + coalesce(p.n_times, 0))"),
]:
    add(f"{_id}_{_c}", f"SELECT c.user_id, c.item_id, round({_expr}, 6) AS {_c} {_LEFT}")(_pair_query(_fn, [_c]))

_CTX = """SELECT c.user_id, c.item_id, round({e}, 6) AS {c} FROM (SELECT c.user_id, c.item_id, CASE WHEN p.user_id IS NULL THEN 0.0 ELSE 1.0 END AS o
FROM cand c LEFT JOIN h_pair p ON p.user_id = c.user_id AND p.item_id = c.item_id) c"""
for _id, _c, _expr in [
    ("g38", "cc_u_cand_size_log", "ln(1 + count(*) OVER (PARTITION BY user_id))"),
    ("g39", "cc_i_cand_freq_log", "ln(1 + count(*) OVER (PARTITION BY item_id))"),
    ("g40", "cc_u_owned_ratio", "(sum(o) OVER (PARTITION BY user_id) + 0.5) / (count(*) OVER (PARTITION BY user_id) + 1)"),
    ("g41", "cc_i_hit_ratio", "(sum(o) OVER (PARTITION BY item_id) + 0.5) / (count(*) OVER (PARTITION BY item_id) + 1)"),
]:
    add(f"{_id}_{_c}", _CTX.format(e=_expr, c=_c))(_pair_query(Fe.add_context, [_c]))

_CYC = """SELECT c.user_id, c.item_id, round(CASE WHEN y.n >= 2 AND y.med > 0 THEN {e} ELSE 0 END, 6) AS {c} FROM cand c
LEFT JOIN h_cycle y ON y.user_id = c.user_id AND y.item_id = c.item_id"""
for _id, _c, _expr in [
    ("g42", "p_cycle_median_log", "ln(1 + y.med)"),
    ("g43", "p_due_capped", "least((date_diff('day', TIMESTAMP '1970-01-01', TIMESTAMP '2001-06-01') - y.last_day) / y.med, 6)"),
]:
    add(f"{_id}_{_c}", _CYC.format(e=_expr, c=_c))(_pair_query(Fe.add_cycles, [_c]))


@add("g45_category_recent", """
SELECT * FROM (
WITH r AS (SELECT user_id, item_id, collapsed FROM h_pair JOIN item_cat USING (item_id) WHERE last_age <= 45),
t AS (SELECT user_id, count(*) AS tot FROM r GROUP BY 1), k AS (SELECT user_id, collapsed, count(*) AS cnt FROM r GROUP BY 1, 2)
SELECT c.user_id, c.item_id, round(ln(1 + coalesce(cnt, 0)), 6) AS cc_cat_recent_log, round((coalesce(cnt, 0) + 0.5) / (coalesce(tot, 0) + 1), 6) AS cc_cat_recent_share
FROM cand c JOIN item_cat m USING (item_id) LEFT JOIN t ON t.user_id = c.user_id LEFT JOIN k ON k.user_id = c.user_id AND k.collapsed = m.collapsed)
""")
def g45(spark, d):
    return rounded(Fe.add_category_recent(rows(spark, d), bundle(spark, d)), ["user_id", "item_id"], ["cc_cat_recent_log", "cc_cat_recent_share"])


@add("g47_active_month_share", """
SELECT c.user_id, c.item_id, round(coalesce(p.n_months, 0) / greatest(coalesce(u.n_months, 0), 1), 6) AS p_ui_act_mon_frac
FROM cand c LEFT JOIN h_pair p ON p.user_id = c.user_id AND p.item_id = c.item_id LEFT JOIN u_tot u ON u.user_id = c.user_id
""")
def g47(spark, d):
    return rounded(Fe.add_cycles(rows(spark, d), bundle(spark, d)), ["user_id", "item_id"], ["p_ui_act_mon_frac"])


def _labelled_wide(spark, d):
    b = bundle(spark, d)
    f = tx(spark, d).filter(F.col("ts") >= S.at(CUT)).select("user_id", "item_id").distinct().withColumn("label", F.lit(1))
    r = rows(spark, d).join(f, ["user_id", "item_id"], "left").na.fill(0, ["label"])
    return Fe.context_features(r, b)


@add("g50_validate_wide", "SELECT count(*) AS n_rows, count(*) FILTER (WHERE user_id % 11 = 4) AS null_cells, count(*) FILTER (WHERE user_id % 11 = 5) AS bad_labels, true AS columns_ok, count(*) FILTER (WHERE user_id % 11 = 6) AS unknown_items FROM cand")
def g50(spark, d):
    index = retail.products(spark, d).select("item_id")
    kind, first = F.col("user_id") % 11, C.FEATURES_CONTEXT[0]
    wide = _labelled_wide(spark, d)
    damaged = wide.withColumns({
        first: F.when(kind != 4, F.col(first)), "label": F.when(kind == 5, 2).otherwise(F.col("label")),
        "item_id": F.when(kind == 6, F.lit("no such item")).otherwise(F.col("item_id"))})
    return Fe.validate_wide(damaged, C.FEATURES_CONTEXT, index)


@add("g51_train_serve_equal", "SELECT count(*) AS n_rows, " + ", ".join(f"0.0::DOUBLE AS {c}" for c in C.FEATURES_CONTEXT) + ", 0.5::DOUBLE AS served_wrong FROM cand")
def g51(spark, d):
    """The same cut computed alone and together with other cuts gives the same columns; a column that is served with an
    offset shows it."""
    alone = Fe.context_features(rows(spark, d), bundle(spark, d)).withColumn("served_wrong", F.col("p_ui_n_ord_log"))
    together = Fe.context_features(rows(spark, d), bundle(spark, d, MONTH_CUTS)).withColumn(
        "served_wrong", F.col("p_ui_n_ord_log") + 0.5)
    out = Fe.max_difference(alone, together, ["cut", "user_id", "item_id"], [*C.FEATURES_CONTEXT, "served_wrong"])
    return out.select("n_rows", *[F.round(c, 9).alias(c) for c in [*C.FEATURES_CONTEXT, "served_wrong"]])


@add("g52_class_means", """
SELECT 'p_ui_n_ord_log' AS feature, round(avg(CASE WHEN f.user_id IS NOT NULL THEN ln(1 + coalesce(p.n_ord, 0)) END), 6) AS pos_mean,
 round(avg(CASE WHEN f.user_id IS NULL THEN ln(1 + coalesce(p.n_ord, 0)) END), 6) AS neg_mean
FROM cand c LEFT JOIN h_pair p ON p.user_id = c.user_id AND p.item_id = c.item_id LEFT JOIN fpairs f ON f.user_id = c.user_id AND f.item_id = c.item_id
""")
def g52(spark, d):
    return Fe.class_means(_labelled_wide(spark, d), ["p_ui_n_ord_log"]).select(
        "feature", F.round("pos_mean", 6).alias("pos_mean"), F.round("neg_mean", 6).alias("neg_mean"))


@add("g_wide_base", """
SELECT c.user_id, c.item_id, """ + round_sql(*C.FEATURES_USER, prefix="u.") + """,
 round(coalesce(i_pop_buyers_log, 0), 6) AS i_pop_buyers_log, round(coalesce(i_pop_rank_frac, 0), 6) AS i_pop_rank_frac,
 round(coalesce(i_price_log, 0), 6) AS i_price_log, CASE WHEN p.user_id IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS ui_owned, 1.0::DOUBLE AS country_other, b.ordinal AS cat_code_ordinal
FROM cand c JOIN u_feat u ON u.user_id = c.user_id LEFT JOIN i_feat i ON i.item_id = c.item_id
LEFT JOIN h_pair p ON p.user_id = c.user_id AND p.item_id = c.item_id JOIN item_cat m ON m.item_id = c.item_id JOIN bucket b ON b.collapsed = m.collapsed
""")
def g_wide(spark, d):
    """All base columns of the wide table assembled in one job (known users only)."""
    b = bundle(spark, d)
    known = rows(spark, d).join(b.users.select("cut", "user_id"), ["cut", "user_id"], "left_semi")
    wide = Fe.base_features(known, b, retail.item_vectors(spark, d))
    cols = C.FEATURES_USER + ["i_pop_buyers_log", "i_pop_rank_frac", "i_price_log", "ui_owned", "country_other", "cat_code_ordinal"]
    return rounded(wide, ["user_id", "item_id"], cols)
