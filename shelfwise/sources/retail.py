"""Retail order-line view over the test tables.

Only the joins a query needs are made: order lines join orders always, the product and
country dimensions on request.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def retail_view(spark: SparkSession, sf_dir: str, product: bool = False, country: bool = False) -> DataFrame:
    """One row per order line: user, item, order, time, quantity, unit price."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("item_key"),
        F.col("l_linenumber").alias("line_no"), F.col("l_quantity").alias("qty"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        (F.col("l_returnflag") == "R").alias("cancelled"),
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("ts"),
    )
    out = lines.join(orders, "order_id").select(
        "order_id", "item_key", F.col("item_key").cast("string").alias("item_id"), "line_no", "qty", "unit_price", "cancelled",
        "user_id", "ts")  # the text after the join: its shuffle carries the number
    if product:
        part = table(spark, sf_dir, "part").select(
            F.col("p_partkey").alias("item_key"), F.col("p_name").alias("descr"),
            F.col("p_type").alias("category"),
        )
        out = out.join(part, "item_key")
    if country:
        nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("country"))
        customer = table(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("n_nationkey")
        )
        out = out.join(customer.join(nation, "n_nationkey").drop("n_nationkey"), "user_id")
    return out.drop("item_key")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product dimension: item id, description, raw category."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("item_id"), F.col("p_name").alias("descr"),
        F.col("p_type").alias("category"), F.col("p_brand").alias("brand"),
    )


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed dense item vectors: item id and a double array."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("item_id"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


def dirty_transactions(spark: SparkSession, sf_dir: str, dimensions: bool = True) -> DataFrame:
    """The raw transaction file as it arrives: NULL users, cancelled invoices, bad quantities,
    zero prices, service codes and repeated rows, all derived from the order lines.

    ``dimensions=False`` leaves out description and country, and the joins for them."""
    tx = retail_view(spark, sf_dir, product=dimensions, country=dimensions)
    key = F.col("order_id")
    raw = tx.select(
        F.concat(F.when(F.col("cancelled"), F.lit("C")).otherwise(F.lit("")), key.cast("string")).alias("invoice_no"),
        F.when((F.col("line_no") == 6) & (key % 11 == 0), F.lit("POST")).otherwise(F.col("item_id")).alias("item_id"),
        *["descr"] * dimensions,
        F.when((key % 9 == 0) & (F.col("line_no") == 5), -F.col("qty"))
        .when((key % 17 == 0) & (F.col("line_no") == 4), F.lit(None).cast("double"))
        .otherwise(F.col("qty")).alias("qty"),
        "ts",
        F.when((key % 10 == 0) & (F.col("line_no") == 3), F.lit(0.0)).otherwise(F.col("unit_price")).alias("unit_price"),
        F.when(key % 7 == 0, F.lit(None).cast("bigint")).otherwise(F.col("user_id")).alias("user_id"),
        *["country"] * dimensions,
    )
    copies = F.when(F.col("invoice_no").endswith("3"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return raw.withColumn("__copy", F.explode(copies)).drop("__copy")


def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed candidate set: every bought (user, item) pair and its right-hand catalogue neighbour.

    One aggregate holds the bought pairs and the neighbours; only the latter are looked up in the catalogue."""
    tx = retail_view(spark, sf_dir)
    key = F.col("item_id").cast("bigint")
    both = tx.select("user_id", F.explode(F.array(
        F.struct(key.alias("k"), F.lit(True).alias("own")), F.struct((key + 1).alias("k"), F.lit(False).alias("own")))).alias("e"))
    pairs = both.select("user_id", "e.*").groupBy("user_id", "k").agg(F.max("own").alias("own"))
    known = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    shifted = pairs.filter(~F.col("own")).join(known, "k", "left_semi")
    return (
        pairs.filter("own").select("user_id", "k").unionByName(shifted.select("user_id", "k"))
        .select("user_id", F.col("k").cast("string").alias("item_id"))
    )
