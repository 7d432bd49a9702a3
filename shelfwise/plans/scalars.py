"""C: projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import scalar as S
from shelfwise.plans.base import Family
from shelfwise.schema import CUT
from shelfwise.sources import retail

FAMILY = Family()
add = FAMILY.add
KEY = ["order_id", "line_no", "item_id"]


def tx(spark, d, **kw):
    return retail.retail_view(spark, d, **kw)


def r6(c, name):
    return F.round(c, 6).alias(name)


@add("c01_log1p", "SELECT order_id, line_no, item_id, round(ln(1 + greatest(qty - 10, 0)), 6) AS v FROM tx")
def c01(spark, d):
    return tx(spark, d).select(*KEY, r6(S.log1p0(F.col("qty") - 10), "v"))


@add("c02_discount_sqrt_decay", """
SELECT order_id, line_no, item_id, round(1 / log2(line_no + 1), 6) AS disc, round(sqrt(qty), 6) AS root,
       round(exp(-date_diff('day', ts, TIMESTAMP '2001-08-02') / 90.0), 6) AS decayed FROM tx
""")
def c02(spark, d):
    return tx(spark, d).select(
        *KEY, r6(1 / F.log2(F.col("line_no") + 1), "disc"), r6(F.sqrt("qty"), "root"),
        r6(S.decay(S.frac_days("ts", "2001-08-02"), 90.0), "decayed"))


@add("c03_whole_days", """
SELECT order_id, line_no, item_id,
       CAST(floor(date_diff('second', ts + INTERVAL 7 HOUR * line_no, TIMESTAMP '2001-06-01') / 86400.0) AS BIGINT) AS age,
       CAST(greatest(floor(date_diff('second', ts + INTERVAL 7 HOUR * line_no, TIMESTAMP '2001-06-01') / 86400.0), 0) AS BIGINT) AS age0 FROM tx
""")
def c03(spark, d):
    t = tx(spark, d).withColumn("ts", F.col("ts") + F.make_dt_interval(hours=F.col("line_no") * 7))
    return t.select(*KEY, S.whole_days("ts", CUT).alias("age"), S.whole_days0("ts", CUT).alias("age0"))


@add("c04_weekday", "SELECT order_id, line_no, item_id, CAST(isodow(ts) - 1 AS INTEGER) AS wd, isodow(ts) >= 6 AS weekend FROM tx")
def c04(spark, d):
    return tx(spark, d).select(*KEY, S.monday0("ts").alias("wd"), S.is_weekend("ts").alias("weekend"))


@add("c05_month_key", "SELECT order_id, line_no, item_id, strftime(ts, '%Y-%m') AS ym, CAST(ts AS DATE) AS day FROM tx")
def c05(spark, d):
    return tx(spark, d).select(*KEY, S.month_key("ts").alias("ym"), F.to_date("ts").alias("day"))


@add("c06_next_month", "SELECT DISTINCT CAST(date_trunc('month', ts) AS DATE) AS m, CAST(date_trunc('month', ts) + INTERVAL 1 MONTH AS DATE) AS nxt FROM tx")
def c06(spark, d):
    m = tx(spark, d).select(F.date_trunc("month", "ts").alias("m")).distinct()
    return m.select(F.to_date("m").alias("m"), F.to_date(S.next_month("m")).alias("nxt"))


@add("c07_day_number", "SELECT order_id, line_no, item_id, CAST(date_diff('day', TIMESTAMP '1994-12-31', ts) AS INTEGER) AS day_no FROM tx")
def c07(spark, d):
    return tx(spark, d).select(*KEY, S.day_number("ts", "1994-12-31").alias("day_no"))


@add("c08_trim_upper_prefix", """
SELECT order_id, line_no, item_id, upper(trim('  ' || descr || ' ')) AS t, upper(descr) LIKE 'S%' AS p FROM tx
""")
def c08(spark, d):
    return tx(spark, d, product=True).select(
        *KEY, F.upper(F.trim(F.concat(F.lit("  "), "descr", F.lit(" ")))).alias("t"),
        F.upper("descr").startswith("S").alias("p"))


@add("c09_blacklist", "SELECT invoice_no, item_id, count(*) AS n FROM dirty WHERE item_id NOT IN ('POST', 'DOT', 'M') GROUP BY ALL")
def c09(spark, d):
    keep = retail.dirty_transactions(spark, d).filter(S.not_service("item_id", ["POST", "DOT", "M"]))
    return keep.groupBy("invoice_no", "item_id").agg(F.count(F.lit(1)).alias("n"))


@add("c10_regex", "SELECT p_name AS descr, regexp_matches(upper(p_name), 'RING|PLATE') AS hit, count(*) AS n FROM part GROUP BY ALL")
def c10(spark, d):
    return retail.products(spark, d).groupBy("descr", S.has_keyword("descr", "RING|PLATE").alias("hit")).agg(
        F.count(F.lit(1)).alias("n"))


@add("c11_right_closed_bucket", """
SELECT order_id, line_no, item_id, CASE WHEN qty <= 3 THEN '1-3' WHEN qty <= 8 THEN '4-8' WHEN qty <= 15 THEN '9-15' ELSE '16+' END AS b FROM tx
""")
def c11(spark, d):
    return tx(spark, d).select(*KEY, S.right_closed_bucket("qty", [3, 8, 15], ["1-3", "4-8", "9-15", "16+"]).alias("b"))


@add("c12_floor_ratio", "SELECT order_id, line_no, item_id, round(qty / greatest(line_no - 3, 1), 6) AS v FROM tx")
def c12(spark, d):
    return tx(spark, d).select(*KEY, r6(S.ratio("qty", F.col("line_no") - 3, 1.0), "v"))


@add("c13_smoothing", "SELECT user_id, round((count(*) FILTER (WHERE cancelled) + 0.5) / (count(*) + 1), 6) AS v FROM tx GROUP BY user_id")
def c13(spark, d):
    g = tx(spark, d).groupBy("user_id").agg(F.sum(F.col("cancelled").cast("double")).alias("h"), F.count(F.lit(1)).alias("n"))
    return g.select("user_id", r6(S.smoothed("h", "n"), "v"))


@add("c14_country_indicators", """
SELECT DISTINCT country, CASE WHEN country = 'NATION_3' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS country_uk,
 CASE WHEN country = 'NATION_7' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS country_de,
 CASE WHEN country IN ('NATION_3', 'NATION_7') THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS country_other FROM tx
""")
def c14(spark, d):
    c = tx(spark, d, country=True).select("country").distinct()
    named = F.when(F.col("country") == "NATION_3", "United Kingdom").when(F.col("country") == "NATION_7", "Germany").otherwise(F.col("country"))
    c = c.withColumn("name", named)
    cols = S.country_indicators("name")
    return c.select("country", cols[0], cols[1], cols[4])


@add("c15_rounding", """
SELECT order_id, line_no, item_id, round(ln(unit_price), 4) AS r4, round(ln(unit_price) / 3, 5) AS r5,
       round_even(qty / 4, 0) AS half_even FROM tx
""")
def c15(spark, d):
    return tx(spark, d).select(*KEY, F.round(F.log("unit_price"), 4).alias("r4"), F.round(F.log("unit_price") / 3, 5).alias("r5"),
                               F.bround(F.col("qty") / 4, 0).alias("half_even"))


@add("c16_set_algebra", """
SELECT coalesce(h.user_id, f.user_id) AS user_id, count(*) FILTER (WHERE h.item_id IS NOT NULL AND f.item_id IS NOT NULL) AS n_both,
       count(*) AS n_any, count(*) FILTER (WHERE f.item_id IS NULL) AS n_hist_only
FROM hpairs h FULL JOIN fpairs f ON h.user_id = f.user_id AND h.item_id = f.item_id GROUP BY 1
""")
def c16(spark, d):
    t = tx(spark, d).select("user_id", "item_id", (F.col("ts") < S.at(CUT)).alias("old"))
    per_pair = t.groupBy("user_id", "item_id").agg(F.bool_or("old").alias("h"), F.bool_or(~F.col("old")).alias("f"))
    return per_pair.groupBy("user_id").agg(
        F.sum((F.col("h") & F.col("f")).cast("bigint")).alias("n_both"), F.count(F.lit(1)).alias("n_any"),
        F.sum((F.col("h") & ~F.col("f")).cast("bigint")).alias("n_hist_only"))


@add("c17_id_list_text", """
SELECT user_id, string_agg(item_id, ',' ORDER BY rk) AS ids FROM (
 SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, item_id) AS rk
 FROM (SELECT user_id, item_id, sum(qty) AS s FROM tx GROUP BY 1, 2)) WHERE rk <= 10 GROUP BY user_id
""")
def c17(spark, d):
    from shelfwise.functions import ranks as R

    s = tx(spark, d).groupBy("user_id", "item_id").agg(F.sum("qty").alias("s"))
    head = R.top_k(s, ["user_id"], [F.col("s").desc(), F.col("item_id")], 10)
    arr = F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda e: e["item_id"])
    return head.groupBy("user_id").agg(S.text_key(arr).alias("ids"))


@add("c18_sigmoid", "SELECT order_id, line_no, item_id, round(1 / (1 + exp(-greatest(least((qty - 25) * 2, 30), -30))), 6) AS v FROM tx")
def c18(spark, d):
    return tx(spark, d).select(*KEY, r6(S.sigmoid_clipped((F.col("qty") - 25) * 2), "v"))
