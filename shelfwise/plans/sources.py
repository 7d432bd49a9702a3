"""A: sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import scalar as S
from shelfwise.operators import cleaning
from shelfwise.plans.base import Family
from shelfwise.schema import CUT
from shelfwise.sources import retail, transactions as T

FAMILY = Family()
add = FAMILY.add


def _file_view(spark, d):
    """The dirty transactions with the integer quantity of the file format."""
    return retail.dirty_transactions(spark, d).withColumn("qty", F.col("qty").cast("int"))


@add("a01_read_transactions", """
SELECT count(*) AS n, count(user_id) AS with_user, count(DISTINCT invoice_no) AS invoices,
       CAST(sum(CAST(qty AS BIGINT)) AS BIGINT) AS units, round(sum(unit_price), 2) AS prices,
       CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day FROM dirty
""")
def a01(spark, d):
    path = T.scratch_path(spark, "transactions")
    T.write_transactions(_file_view(spark, d), path)
    back = T.load_clean(T.read_transactions(spark, path))
    return back.agg(
        F.count(F.lit(1)).alias("n"), F.count("user_id").alias("with_user"),
        F.count_distinct("invoice_no").alias("invoices"), F.sum("qty").alias("units"),
        F.round(F.sum("unit_price"), 2).alias("prices"),
        F.to_date(F.min("ts")).alias("first_day"), F.to_date(F.max("ts")).alias("last_day"),
    )


@add("a02_read_products", """
SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_name AS descr, p_name AS descr_zh, p_type AS category FROM part
""")
def a02(spark, d):
    path = T.scratch_path(spark, "products")
    retail.products(spark, d).select(
        F.col("item_id").alias("﻿StockCode"), F.col("descr").alias("Description"),
        F.col("descr").alias("Chinese_Description"), F.col("category").alias("Product_Category"),
    ).write.csv(path, header=True)
    return T.read_products(spark, path)


@add("a03_load_clean", """
SELECT TRY_CAST(CASE WHEN line_no = 7 THEN 'guest' ELSE CAST(user_id AS VARCHAR) || '.0' END AS DOUBLE)::BIGINT AS user_id,
       item_id, CAST(ts AS DATE) AS day, order_id FROM tx
""")
def a03(spark, d):
    tx = retail.retail_view(spark, d)
    text = tx.select(
        F.when(F.col("line_no") == 7, "guest").otherwise(F.concat(F.col("user_id").cast("string"), F.lit(".0"))).alias("user_id"),
        "item_id", F.col("ts").cast("string").alias("ts"), "order_id",
    )
    return T.load_clean(text).select("user_id", "item_id", F.to_date("ts").alias("day"), "order_id")


@add("a04_clean_or_raw", """
SELECT 'clean' AS source, count(*) AS n FROM dirty
WHERE user_id IS NOT NULL AND NOT (invoice_no LIKE 'C%') AND NOT coalesce(qty <= 0, false) AND unit_price > 0
UNION ALL SELECT 'raw', count(*) FROM dirty
""")
def a04(spark, d):
    raw_path, clean_path = T.scratch_path(spark, "raw"), T.scratch_path(spark, "clean")
    raw = _file_view(spark, d)
    T.write_transactions(raw, raw_path)
    first = T.clean_or_raw(spark, clean_path, raw_path).agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.lit("raw"))
    T.write_transactions(cleaning.clean(raw), clean_path, encoding="UTF-8")
    second = T.clean_or_raw(spark, clean_path, raw_path).agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.lit("clean"))
    return first.unionByName(second).select("source", "n")


@add("a05_read_candidates", "SELECT user_id, item_id FROM cand")
def a05(spark, d):
    raw = retail.candidate_pairs(spark, d).select(
        F.col("user_id").cast("string").alias("CustomerID"), F.col("item_id").alias("Stock_Code"))
    return T.read_candidates(raw).select("user_id", "item_id")


@add("a06_labelled_month_key", """
SELECT user_id, item_id, strftime(ts, '%Y-%m') AS ym, count(*) AS n FROM tx GROUP BY ALL
""")
def a06(spark, d):
    tx = retail.retail_view(spark, d)
    return tx.groupBy("user_id", "item_id", S.month_key("ts").alias("ym")).agg(F.count(F.lit(1)).alias("n"))


@add("a07_write_table", "SELECT invoice_no, item_id, count(*) AS n FROM dirty WHERE user_id IS NOT NULL GROUP BY ALL")
def a07(spark, d):
    path = T.scratch_path(spark, "table")
    T.write_table(cleaning.drop_null_user(retail.dirty_transactions(spark, d)).select("invoice_no", "item_id"), path)
    return spark.read.csv(path, header=True).groupBy("invoice_no", "item_id").agg(F.count(F.lit(1)).alias("n"))


@add("a08_write_monthly", "SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n FROM tx GROUP BY ALL")
def a08(spark, d):
    path = T.scratch_path(spark, "monthly")
    tx = retail.retail_view(spark, d).withColumn("month", S.month_key("ts"))
    T.write_monthly(tx, path)
    back = spark.read.schema(tx.schema).parquet(path)
    return back.groupBy("month").agg(F.count(F.lit(1)).alias("n"))


@add("a09_vector_index", """
SELECT CAST(vec_id AS VARCHAR) AS item_id, len(embedding) AS dim,
       round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))
             / list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS unit_norm
FROM embeddings
""")
def a09(spark, d):
    from shelfwise.operators import vectors

    path = T.scratch_path(spark, "vectors")
    vectors.unit_vectors(retail.item_vectors(spark, d)).write.parquet(path)
    return spark.read.parquet(path).select(
        "item_id", F.size("vec").cast("bigint").alias("dim"),
        F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x), 6).alias("unit_norm"))


@add("a10_item_index", """
SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS item_idx FROM (SELECT DISTINCT item_id FROM tx)
""")
def a10(spark, d):
    return T.item_index(retail.retail_view(spark, d))


@add("a11_category_map", """
SELECT DISTINCT category, CASE WHEN rk <= 3 THEN category ELSE '其他' END AS collapsed
FROM (SELECT category, row_number() OVER (ORDER BY s DESC, category) AS rk
      FROM (SELECT category, round(sum(qty * unit_price), 2) AS s FROM hist GROUP BY category))
""")
def a11(spark, d):
    from shelfwise.operators import features

    tx = retail.retail_view(spark, d)
    cats = features.collapse_categories(tx.filter(F.col("ts") < S.at(CUT)), retail.products(spark, d), top_n=3)
    return cats.raw_map.select("category", "collapsed")


@add("a12_submission", "SELECT c.user_id, c.item_id, round(ln(1 + i.b), 6) AS score FROM cand c JOIN (SELECT item_id, count(DISTINCT user_id) b FROM tx GROUP BY item_id) i USING (item_id)")
def a12(spark, d):
    cand = T.read_candidates(retail.candidate_pairs(spark, d))
    buyers = retail.retail_view(spark, d).groupBy("item_id").agg(F.count_distinct("user_id").alias("b"))
    return T.submission(cand.join(buyers, "item_id").withColumn("score", F.round(F.log1p("b"), 6)))


@add("a15_run_metadata", """
SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users, '2001-06-01' AS cut, 42 AS seed FROM hist
""")
def a15(spark, d):
    path = T.scratch_path(spark, "meta")
    hist = retail.retail_view(spark, d).filter(F.col("ts") < S.at(CUT))
    hist.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("user_id").alias("n_users"),
        F.lit(CUT.strftime("%Y-%m-%d")).alias("cut"), F.lit(42).alias("seed"),
    ).write.json(path)
    return spark.read.schema("n_rows bigint, n_users bigint, cut string, seed int").json(path)


@add("a16_reuse_snapshot", "SELECT count(*) AS n, count(DISTINCT user_id) AS users FROM hist")
def a16(spark, d):
    path = T.scratch_path(spark, f"hist-{CUT:%Y%m%d}")
    tx = retail.retail_view(spark, d)

    def build():
        return tx.filter(F.col("ts") < S.at(CUT))

    T.read_or_build(spark, path, build)
    again = T.read_or_build(spark, path, build)
    return again.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))
