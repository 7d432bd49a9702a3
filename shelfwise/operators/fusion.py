"""Score fusion, rank transforms and weight search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import ranks as R
from shelfwise.operators import metrics as M
from shelfwise.operators.grids import grid_group_metrics

GROUP = ["ym", "user_id"]


def join_predictions(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """One-to-one key join of two prediction tables; order is never assumed.

    A key that is missing on one side or occurs twice on one ends the job with the key in the message; use
    ``alignment_check`` to count such keys first.
    """
    keys = list(keys)
    left = a.withColumn("__a", F.lit(1)).withColumn("__na", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    right = b.withColumn("__b", F.lit(1)).withColumn("__nb", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    both = left.join(right, keys, "full")
    told = F.concat(F.lit("not one to one: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    one = F.col("__a").isNotNull() & F.col("__b").isNotNull() & (F.col("__na") == 1) & (F.col("__nb") == 1)
    return both.filter(F.when(one, F.lit(True)).otherwise(F.raise_error(told).cast("boolean"))).drop("__a", "__b", "__na", "__nb")


def alignment_check(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Matched keys, keys on one side only and keys that occur more than once on a side."""
    keys = list(keys)
    tagged = a.select(*keys, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        b.select(*keys, F.lit(0).alias("a"), F.lit(1).alias("b")))
    per_key = tagged.groupBy(*keys).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    one = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    return per_key.agg(
        one((F.col("a") > 0) & (F.col("b") > 0)).alias("matched"), one(F.col("b") == 0).alias("left_only"),
        one(F.col("a") == 0).alias("right_only"), one((F.col("a") > 1) | (F.col("b") > 1)).alias("duplicate_keys"))


def _weighted(cols, weights):
    total = F.lit(0.0)
    for c, w in zip(cols, weights):
        total = total + F.lit(float(w)) * F.col(c)
    return total


def blend_global_ranks(df: DataFrame, weights: dict, out: str = "score") -> DataFrame:
    """Weighted mean of global percentile ranks."""
    ranked, names = df, []
    for c in weights:
        names.append(f"__p_{c}")
        ranked = R.percent_rank_avg(ranked, [], c, names[-1])
    return ranked.withColumn(out, _weighted(names, weights.values())).drop(*names)


def blend_group_ranks(df: DataFrame, weights: dict, by=GROUP, out: str = "score") -> DataFrame:
    """Weighted mean of percentile ranks inside each user's list."""
    ranked, names = df, []
    for c in weights:
        names.append(f"__p_{c}")
        ranked = R.percent_rank_avg(ranked, by, c, names[-1])
    return ranked.withColumn(out, _weighted(names, weights.values())).drop(*names)


def average_scores(df: DataFrame, cols, out: str = "score") -> DataFrame:
    return df.withColumn(out, _weighted(cols, [1.0 / len(cols)] * len(cols)))


def simplex(step: float, m: int) -> list[tuple[float, ...]]:
    """All weight vectors of length m on the grid that sum to one."""
    n = round(1 / step)

    def parts(left, slots):
        if slots == 1:
            return [(left,)]
        return [(i, *rest) for i in range(left + 1) for rest in parts(left - i, slots - 1)]

    return [tuple(i * step for i in p) for p in parts(n, m)]


def expand_weights(df: DataFrame, cols, vectors, out: str = "score") -> DataFrame:
    """One copy of every row per weight vector with its blended score; row-local explode."""
    table = F.array(*[
        F.struct(F.lit(i).alias("weight_id"), *[F.lit(float(w)).alias(f"w{k}") for k, w in enumerate(v)])
        for i, v in enumerate(vectors)
    ])
    score = F.lit(0.0)
    for k, c in enumerate(cols):
        score = score + F.col(f"__w.w{k}") * F.col(c)
    return df.withColumn("__w", F.explode(table)).withColumn("weight_id", F.col("__w.weight_id")).withColumn(
        out, score).drop("__w")


def grid_metrics(df: DataFrame, cols, vectors, metric, chunk: int = 64) -> DataFrame:
    """Metric table per weight vector.  Vectors go through in chunks so that the exploded rows
    of one shuffle stay bounded."""
    parts = None
    for start in range(0, len(vectors), chunk):
        part = metric(expand_weights(df, cols, vectors[start:start + chunk])).withColumn(
            "weight_id", F.col("weight_id") + start)
        parts = part if parts is None else parts.unionByName(part)
    return parts


def grid_group_auc(df: DataFrame, cols, vectors) -> DataFrame:
    """Macro and weighted group AUC per weight vector."""
    return grid_group_metrics(df, cols, vectors).groupBy("weight_id").agg(*M.auc_aggregates())


def grid_composite(df: DataFrame, cols, vectors) -> DataFrame:
    """Composite metric per weight vector."""
    return M.composite(grid_group_metrics(df, cols, vectors), by=["weight_id"])


def grid_pooled_auc(df: DataFrame, cols, vectors, chunk: int = 64) -> DataFrame:
    """Pooled AUC per weight vector."""
    return grid_metrics(
        df, cols, vectors,
        lambda x: R.group_auc(x, ["weight_id"], "score").select("weight_id", "auc"), chunk)


def best_row(table: DataFrame, metric: str, tie: str) -> DataFrame:
    return table.orderBy(F.col(metric).desc(), tie).limit(1)


def add_residual(df: DataFrame, residual: str, by=GROUP, out: str = "resid_pct") -> DataFrame:
    """Residual signal as a 0..1 percentile inside the group."""
    return R.percent_rank_zero_one(df, by, residual, out)


def alpha_sweep(df: DataFrame, anchor: str, alphas, resid: str = "resid_pct", by=()) -> DataFrame:
    """Composite of anchor + alpha * residual percentile for every alpha in one job."""
    return M.composite(alpha_groups(df, anchor, alphas, resid), by=["alpha", *by])


def alpha_groups(df: DataFrame, anchor: str, alphas, resid: str = "resid_pct", by=GROUP) -> DataFrame:
    """Group metrics of anchor + alpha * residual percentile for every alpha."""
    groups = grid_group_metrics(df, [anchor, resid], [(1.0, a) for a in alphas], by)
    return groups.withColumn("alpha", F.element_at(F.array(*[F.lit(float(a)) for a in alphas]), F.col("weight_id") + 1))


def boost(df: DataFrame, flag: str, delta: float = 0.10, score: str = "score", out: str = "boosted") -> DataFrame:
    """Adds delta to the score of flagged rows."""
    return df.withColumn(out, F.col(score) + F.lit(delta) * F.coalesce(F.col(flag), F.lit(0)).cast("double"))


def seasonal_items(tx: DataFrame, descr: DataFrame, pattern: str, alive_months) -> DataFrame:
    """Keyword items sold in any of the given months."""
    from shelfwise.functions import scalar as S

    alive = tx.filter(S.month_key("ts").isin(list(alive_months))).select("item_id").distinct()
    return descr.filter(S.has_keyword("descr", pattern)).join(alive, "item_id", "left_semi").select("item_id")


def rank_uniform(df: DataFrame, score: str, tie, out: str = "uniform") -> DataFrame:
    """(position + 1) / (n + 1) over all rows, ascending score, ties by key: all values differ."""
    total = df.select(F.count(F.lit(1)).alias("c")).scalar()
    pos = R.global_position(df, [F.col(score), *[F.col(t) for t in tie]], "__pos")
    return pos.withColumn(out, (F.col("__pos") + 1.0) / (total + 1.0)).drop("__pos")


def user_blocks(df: DataFrame, score: str, tie, user: str = "user_id", out: str = "block") -> DataFrame:
    """Each user gets an own score interval; the order inside the user is kept.

    Positions come from one range sort by (user, score, tie), so no user is sorted by one task.
    """
    pos = R.global_position(df, [F.col(user), F.col(score), *[F.col(t) for t in tie]], "__pos")
    per_user = pos.groupBy(user).agg(F.min("__pos").alias("__lo"), F.count(F.lit(1)).alias("__n"))
    blocks = R.global_position(per_user, [F.col(user)], "__block")
    n_users = blocks.select(F.count(F.lit(1)).alias("c")).scalar()
    inner = (F.col("__pos") - F.col("__lo") + 1.0) / (F.col("__n") + 1.0) * 0.98
    return pos.join(blocks, user).withColumn(out, (F.col("__block") + inner) / n_users).drop(
        "__pos", "__lo", "__n", "__block")


def max_gap(a: DataFrame, b: DataFrame, keys, col_a: str, col_b: str) -> DataFrame:
    """Matched rows, largest absolute difference of two stored scores, and rows that differ by more than 1e-12."""
    other = b.select(*keys, F.col(col_b).alias("__other"))
    return a.join(other, list(keys)).agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.abs(F.col(col_a) - F.col("__other"))).alias("max_gap"),
        F.sum((F.abs(F.col(col_a) - F.col("__other")) > 1e-12).cast("bigint")).alias("n_changed"))


def seats(df: DataFrame, by, score: str, k: int = 10, tie: str = "item_id") -> DataFrame:
    return R.top_k(df, by, [F.col(score).desc(), F.col(tie)], k).drop("rank")


def seat_difference(df: DataFrame, by, a: str, b: str, k: int = 10) -> DataFrame:
    """Per group: top-k seats held only under score a, only under score b."""
    sa = seats(df, by, a, k).select(*by, "item_id", F.lit(1).alias("a"), F.lit(0).alias("b"))
    sb = seats(df, by, b, k).select(*by, "item_id", F.lit(0).alias("a"), F.lit(1).alias("b"))
    per = sa.unionByName(sb).groupBy(*by, "item_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return per.groupBy(*by).agg(
        F.sum((F.col("b") == 0).cast("bigint")).alias("only_a"), F.sum((F.col("a") == 0).cast("bigint")).alias("only_b"))
