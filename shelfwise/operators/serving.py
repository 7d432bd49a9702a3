"""Ranking-stage features, batch top-N tables and request outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import ranks as R
from shelfwise.functions import scalar as S
from shelfwise.operators import similarity as sim
from shelfwise.operators import vectors as V


def rank_features(fused: DataFrame, train: DataFrame, pop: DataFrame, pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """The ten ranking columns for recall rows (user_id, item_id, routes, ...)."""
    own = train.select("user_id", "item_id").distinct()
    size = pop.select(F.max("pos").alias("m")).scalar()
    price = R.grouped_median(train, ["item_id"], "unit_price", "price_med")
    items = pop.join(price, "item_id", "left").withColumn("m", size).select(
        "item_id", S.log1p0("weight").alias("pop_buyers_log"),
        ((F.col("pos") - 1) / F.greatest(F.col("m") - 1, F.lit(1))).alias("pop_rank_frac"),
        S.log1p0("price_med").alias("price_log"))
    u = V.unit_vectors(vectors)
    prof = V.mean_vectors(own, vectors).withColumnRenamed("vec", "uvec")
    cf = sim.profile_scores(own, pairs, targets=fused).withColumnRenamed("score", "cf_agg_sim")
    n_own = own.groupBy("user_id").agg(S.log1p0(F.count(F.lit(1))).alias("user_n_owned_log"))
    out = (
        fused.join(items, "item_id", "left").join(u, "item_id", "left").join(prof, "user_id", "left")
        .join(cf, ["user_id", "item_id"], "left").join(n_own, "user_id", "left")
    )
    flag = lambda r: F.array_contains("routes", r).cast("double")
    return out.select(
        *fused.columns, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("pop_buyers_log", "pop_rank_frac", "price_log")],
        F.coalesce(V.dot("vec", "uvec"), F.lit(0.0)).alias("emb_sim_uservec"),
        F.coalesce("cf_agg_sim", F.lit(0.0)).alias("cf_agg_sim"),
        flag("popular").alias("fl_pop"), flag("similar").alias("fl_sim"), flag("user_vec").alias("fl_vec"),
        F.coalesce("user_n_owned_log", F.lit(0.0)).alias("user_n_owned_log"),
    )


def basket_label(rows: DataFrame, truth: DataFrame) -> DataFrame:
    hit = truth.select("user_id", "item_id").distinct().withColumn("label", F.lit(1))
    return rows.join(hit, ["user_id", "item_id"], "left").na.fill(0, ["label"])


def rerank(scored: DataFrame, score: str = "score", k: int | None = None) -> DataFrame:
    """Order by model score; the first k rows of each user, or without k the whole list."""
    ranked = R.first_rank_desc(scored, ["user_id"], score, "item_id", "rank")
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def display_rows(rows: DataFrame, catalog: DataFrame, products: DataFrame) -> DataFrame:
    """Adds description, translated description (falls back to the description) and category."""
    shown = products.select("item_id", F.col("descr_zh").alias("zh"), F.col("category").alias("cat")).dropDuplicates(["item_id"])
    out = rows.join(catalog.select("item_id", "descr", "price", "buyers"), "item_id", "left").join(shown, "item_id", "left")
    return out.withColumn("descr_zh", F.coalesce(F.nullif(F.trim("zh"), F.lit("")), F.col("descr"))).withColumn(
        "category", F.coalesce(F.nullif(F.trim("cat"), F.lit("")), F.lit(""))).drop("zh", "cat")


def similar_items(near: DataFrame, catalog: DataFrame, products: DataFrame, k: int) -> DataFrame:
    """Similar-items table with display fields; ``near`` holds i, j, sim, rank."""
    rows = near.filter(F.col("rank") <= k).select(
        F.col("i").alias("source"), F.col("j").alias("item_id"), F.round("sim", 4).alias("sim"), "rank")
    return display_rows(rows, catalog, products)


def compare_methods(lists: dict, truth: DataFrame, k: int = 10) -> DataFrame:
    """Top-k of several methods side by side with a hit flag against the last basket."""
    parts = None
    for name, frame in lists.items():
        part = frame.filter(F.col("rank") <= k).select("user_id", F.lit(name).alias("method"), "rank", "item_id")
        parts = part if parts is None else parts.unionByName(part)
    hit = truth.select("user_id", "item_id").distinct().withColumn("hit", F.lit(True))
    return parts.join(hit, ["user_id", "item_id"], "left").na.fill(False, ["hit"])


def request_status(requests: DataFrame, users: DataFrame, items: DataFrame, rankers=("lr", "lgb")) -> DataFrame:
    """Outcome per request (user_id, item_id, ranker text): first failing check wins."""
    u = users.select(F.col("user_id").cast("string").alias("user_id")).distinct().withColumn("ku", F.lit(True))
    i = items.select("item_id").distinct().withColumn("ki", F.lit(True))
    joined = requests.join(u, "user_id", "left").join(i, "item_id", "left")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    status = (
        F.when(blank("user_id") & blank("item_id"), "missing_id")
        .when(~blank("item_id") & F.col("ki").isNull(), "cold_item")
        .when(~blank("user_id") & F.col("ku").isNull(), "unknown_user")
        .when(~F.coalesce(F.col("ranker").isin(list(rankers)), F.lit(True)), "bad_ranker")
        .otherwise("ok"))
    return joined.withColumn("status", status).drop("ku", "ki")


def score_summary(scored: DataFrame, score: str, known_users: DataFrame, known_items: DataFrame, owned: DataFrame) -> DataFrame:
    """min / mean / median / max of the score; rows of unknown users or items; owned rows."""
    med = R.grouped_median(scored, [], score, "p50").scalar()
    t = (
        scored.join(known_users.select("user_id").distinct().withColumn("ku", F.lit(1)), "user_id", "left")
        .join(known_items.select("item_id").distinct().withColumn("ki", F.lit(1)), "item_id", "left")
        .join(owned.select("user_id", "item_id").distinct().withColumn("ow", F.lit(1)), ["user_id", "item_id"], "left")
    )
    return t.agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(score).alias("lo"), F.avg(score).alias("mean"), F.max(score).alias("hi"),
        F.sum((F.col("ku").isNull() | F.col("ki").isNull()).cast("bigint")).alias("cold_rows"),
        F.sum(F.coalesce("ow", F.lit(0))).alias("owned_rows"),
    ).withColumn("p50", med)
