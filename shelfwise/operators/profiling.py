"""Profiles and exploratory tables over the transaction fact."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import ranks as R
from shelfwise.functions import scalar as S

# Price histogram edges (right-closed) and labels.
PRICE_EDGES = [1, 2, 3, 4, 5, 7, 10, 15, 20, 50]
PRICE_LABELS = ["0~1", "1~2", "2~3", "3~4", "4~5", "5~7", "7~10", "10~15", "15~20", "20~50", "50+"]


def top_items(df: DataFrame, k: int = 10) -> DataFrame:
    """Items by row count, ties by id."""
    return (
        df.filter(F.col("item_id").isNotNull()).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "item_id").limit(k)
    )


def profile(df: DataFrame, k: int = 10) -> DataFrame:
    """Rows, users (NULL counts as one), items, NULL-user ratio, share of the top-k items."""
    top = top_items(df, k).agg(F.sum("n").alias("t")).scalar()
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        (F.count_distinct("user_id") + F.max(F.col("user_id").isNull().cast("int"))).cast("bigint").alias("unique_users"),
        F.count_distinct("item_id").alias("unique_items"),
        F.avg(F.col("user_id").isNull().cast("double")).alias("missing_user_ratio"),
    ).withColumn("top10_share", top / F.col("total_rows"))


def first_product_row(products: DataFrame) -> DataFrame:
    """One row per item code: smallest (description, category) stands for the first."""
    return products.groupBy("item_id").agg(
        F.min(F.struct("descr", "category")).alias("p")
    ).select("item_id", "p.descr", "p.category")


def top_items_named(df: DataFrame, products: DataFrame, k: int = 10, missing: str = "<未匹配>") -> DataFrame:
    top = top_items(df, k)
    return top.join(first_product_row(products), "item_id", "left").select(
        "item_id", "n", F.coalesce("descr", F.lit(missing)).alias("descr"), "category"
    )


def headline(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_distinct("user_id").alias("users"),
        F.count_distinct("item_id").alias("items"), F.count_distinct("order_id").alias("orders"),
        F.sum(F.col("qty") * F.col("unit_price")).alias("revenue"),
    ).withColumn("avg_order_value", F.when(F.col("orders") > 0, F.col("revenue") / F.col("orders")).otherwise(0.0))


def top_countries(df: DataFrame, k: int = 10) -> DataFrame:
    return (
        df.groupBy("country").agg(F.count_distinct("order_id").alias("orders"))
        .orderBy(F.col("orders").desc(), "country").limit(k)
    )


def item_share(df: DataFrame, k: int = 10, rest: str = "其余") -> DataFrame:
    """Top-k items by rows with percent, plus one row for all others."""
    total = df.agg(F.count(F.lit(1)).alias("c")).scalar()
    top = top_items(df, k).withColumn("total", total)
    others = (
        top.agg(F.sum("n").alias("s"))
        .select(F.lit(rest).alias("item_id"), total.alias("total"), F.col("s"))
        .select("item_id", (F.col("total") - F.col("s")).alias("n"), "total")
    )
    return top.unionByName(others).select(
        "item_id", "n", F.round(F.col("n") / F.col("total") * 100, 2).alias("pct")
    )


def daily_volume(df: DataFrame, start, end) -> DataFrame:
    """Rows per day over a dense range of days; missing days are 0."""
    days = df.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day")
    )
    inside = df.filter(
        (F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
        & (F.col("ts") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))
    )
    counts = inside.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def top_units(df: DataFrame, k: int = 10) -> DataFrame:
    return (
        df.groupBy("item_id").agg(F.sum("qty").alias("units"), F.min("descr").alias("descr"))
        .orderBy(F.col("units").desc(), "item_id").limit(k)
    )


def price_histogram(df: DataFrame) -> DataFrame:
    """Right-closed bins, lowest edge included, empty bins kept, negative prices left out."""
    bins = df.sparkSession.range(1).select(
        F.posexplode(F.array(*[F.lit(x) for x in PRICE_LABELS])).alias("bin_no", "bin")
    )
    counts = (
        df.filter(F.col("unit_price") >= 0)
        .groupBy(S.right_closed_bucket("unit_price", PRICE_EDGES, PRICE_LABELS).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return bins.join(counts, "bin", "left").select("bin_no", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def matrix_density(df: DataFrame) -> DataFrame:
    """Users, items, distinct pairs and the filled percentage."""
    pairs = df.select("user_id", "item_id").distinct()
    return pairs.agg(
        F.count_distinct("user_id").alias("users"), F.count_distinct("item_id").alias("items"),
        F.count(F.lit(1)).alias("nnz"),
    ).withColumn("density_pct", F.col("nnz") / (F.col("users") * F.col("items")) * 100)


def item_catalog(df: DataFrame, missing: str = "(无描述)") -> DataFrame:
    """Per item: first non-blank description, median price, buyers, units, orders."""
    text = F.trim(F.coalesce("descr", F.lit("")))
    base = df.groupBy("item_id").agg(
        F.min_by(F.when(text != "", text), F.when(text != "", F.struct("ts", "order_id", "line_no"))).alias("descr"),
        F.count_distinct("user_id").alias("buyers"), F.sum("qty").alias("units"),
        F.count_distinct("order_id").alias("orders"),
    )
    med = R.grouped_median(df, ["item_id"], "unit_price", "price")
    return base.join(med, "item_id", "left").select(
        "item_id", F.coalesce("descr", F.lit(missing)).alias("descr"), "price", "buyers", "units", "orders"
    )


def user_summary(df: DataFrame, shown: int = 5) -> DataFrame:
    """Per user: orders, distinct items, and the first few item ids bought at the last time."""
    base = df.groupBy("user_id").agg(
        F.count_distinct("order_id").alias("n_orders"), F.count_distinct("item_id").alias("n_items"),
        F.max("ts").alias("last_ts"),
    )
    last = (
        df.join(base.select("user_id", "last_ts"), "user_id").filter(F.col("ts") == F.col("last_ts"))
        .select("user_id", "item_id").distinct()
    )
    head = R.top_k(last, ["user_id"], [F.col("item_id")], shown)
    head = head.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("last_items"))
    return base.drop("last_ts").join(head, "user_id", "left")


def last_rows_flag(df: DataFrame) -> DataFrame:
    """Adds the user's latest time to every row."""
    return df.withColumn("last_ts", F.max("ts").over(Window.partitionBy("user_id")))
