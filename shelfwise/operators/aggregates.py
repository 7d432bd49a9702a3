"""Small aggregation and window forms reused by the other families."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import ranks as R


def group_mode(df: DataFrame, by, value: str) -> DataFrame:
    """Most frequent value per group; ties to the smaller value."""
    n = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    return n.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("__n"), value)).alias(value))


def arg_max(df: DataFrame, by, key: str, value: str) -> DataFrame:
    """Key of the largest value per group; ties to the smaller numeric key."""
    return df.groupBy(*by).agg(F.max_by(key, F.struct(value, -F.col(key))).alias(key))


def pivot_counts(df: DataFrame, by: str, column: str, values) -> DataFrame:
    return df.groupBy(by).pivot(column, list(values)).count().na.fill(0)


def mean_of_counts(df: DataFrame, outer: str, inner: str, counted: str) -> DataFrame:
    per = df.groupBy(outer, inner).agg(F.count_distinct(counted).alias("n"))
    return per.groupBy(outer).agg(F.avg("n").alias("mean_count"))


def collected_sets(df: DataFrame, by: str, value: str) -> DataFrame:
    """Sorted distinct values per group, one row and one array per group."""
    rows = df.select(by, value).distinct()
    return rows.groupBy(by).agg(F.array_sort(F.collect_list(value)).alias("items"))


def with_group_sum(df: DataFrame, by, value: str, out: str) -> DataFrame:
    """Group total on every row by aggregate and join (a hot group is summed in parts)."""
    return df.join(df.groupBy(*by).agg(F.sum(value).alias(out)), list(by))


def pair_gaps(df: DataFrame) -> DataFrame:
    """Days since the pair's previous distinct purchase time."""
    w = Window.partitionBy("user_id", "item_id").orderBy("ts")
    return df.select("user_id", "item_id", "ts").distinct().withColumn("gap", F.datediff("ts", F.lag("ts").over(w)))


def positions(df: DataFrame, by, order) -> DataFrame:
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def last_orders(df: DataFrame, k: int) -> DataFrame:
    """Latest k orders per user by (time, order id)."""
    orders = df.groupBy("user_id", "order_id").agg(F.max("ts").alias("ts"))
    return R.top_k(orders, ["user_id"], [F.col("ts").desc(), F.col("order_id").desc()], k)


def last_time_rows(df: DataFrame) -> DataFrame:
    """Rows at the user's latest time: a max aggregate joined back on (user, time)."""
    last = df.groupBy("user_id").agg(F.max("ts").alias("ts"))
    return df.join(last, ["user_id", "ts"], "left_semi")


def earlier_rows(df: DataFrame) -> DataFrame:
    """Rows before the user's latest time."""
    last = df.groupBy("user_id").agg(F.max("ts").alias("__last"))
    return df.join(last, "user_id").filter(F.col("ts") < F.col("__last")).drop("__last")


def last_order(df: DataFrame) -> DataFrame:
    """The order holding the user's last row by (time, order id)."""
    return df.groupBy("user_id").agg(F.max_by("order_id", F.struct("ts", "order_id")).alias("order_id"))


def macro_and_weighted(df: DataFrame, metric: str, weight: str) -> DataFrame:
    """Plain mean over groups with a value, and the mean weighted by group size."""
    return df.agg(
        F.avg(metric).alias("macro"),
        (F.sum(F.col(metric) * F.col(weight)) / F.sum(F.when(F.col(metric).isNotNull(), F.col(weight)))).alias("weighted"))


def group_spearman(df: DataFrame, by, a: str, b: str, min_rows: int = 3) -> DataFrame:
    """Spearman correlation per group of at least ``min_rows`` rows with variation in both."""
    by = list(by)
    ranked = R.average_rank(R.average_rank(df, by, a, "__ra"), by, b, "__rb")
    return ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.corr("__ra", "__rb").alias("spearman"),
        F.min("__ra").alias("la"), F.max("__ra").alias("ha"), F.min("__rb").alias("lb"), F.max("__rb").alias("hb"),
    ).filter((F.col("n") >= min_rows) & (F.col("la") < F.col("ha")) & (F.col("lb") < F.col("hb"))).select(*by, "n", "spearman")


def correlations(df: DataFrame, by, a: str, b: str) -> DataFrame:
    """Row Pearson and mean per-group Spearman."""
    pearson = df.agg(F.corr(a, b).alias("c")).scalar()
    return group_spearman(df, by, a, b).agg(
        F.avg("spearman").alias("mean_spearman"), F.count(F.lit(1)).alias("n_groups")).withColumn("pearson", pearson)


def quantiles(df: DataFrame, value: str, probabilities) -> DataFrame:
    """Exact quantiles of an integer-like column (the aggregate keeps distinct values only)."""
    return df.agg(F.percentile(value, F.array(*[F.lit(p) for p in probabilities])).alias("q"))
