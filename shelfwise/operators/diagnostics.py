"""Comparison diagnostics of two scores on the same labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import ranks as R
from shelfwise.functions import scalar as S
from shelfwise.operators import aggregates as A
from shelfwise.operators import fusion as Fu
from shelfwise.operators import metrics as M

GROUP = ["ym", "user_id"]
# History and basket size buckets (right-closed edges and labels).
HISTORY_EDGES, HISTORY_LABELS = [3, 8, 15], ["1-3", "4-8", "9-15", "16+"]
BASKET_EDGES, BASKET_LABELS = [1, 2, 5, 10, 30], ["1", "2", "3-5", "6-10", "11-30", "31+"]


def head_positions(df: DataFrame, score: str, out: str, depth: int = 30, by=GROUP) -> DataFrame:
    """Adds the list position of the first ``depth`` rows of each group; later rows get NULL.
    Only the head is ranked, so the cost per group is bounded."""
    head = R.top_k(df.select(*by, "item_id", score), by, [F.col(score).desc(), F.col("item_id")], depth, out)
    return df.join(head.select(*by, "item_id", out), [*by, "item_id"], "left")


def band(position) -> "F.Column":
    p = F.col(position)
    return F.when(p <= 10, "top10").when(p <= 30, "11_30").otherwise("below30")


def saved_kicked(df: DataFrame, anchor: str, final: str, k: int = 10) -> DataFrame:
    """Positives that enter the top-k from positions k+1..3k, and that leave it, per prior flag."""
    both = head_positions(head_positions(df, anchor, "pa", 3 * k), final, "pf", k)
    a_top, f_top = F.coalesce(F.col("pa") <= k, F.lit(False)), F.coalesce(F.col("pf") <= k, F.lit(False))
    near = F.coalesce((F.col("pa") > k) & (F.col("pa") <= 3 * k), F.lit(False))
    n = lambda c: F.sum(c.cast("bigint"))
    return both.filter(F.col("label") == 1).groupBy("prior_bought").agg(
        F.count(F.lit(1)).alias("pos_total"), n(a_top).alias("anchor_hits"), n(f_top).alias("final_hits"),
        n(near & f_top).alias("saved"), n(a_top & ~f_top).alias("kicked"),
    ).withColumn("net", F.col("saved") - F.col("kicked"))


def repeat_explore(df: DataFrame) -> DataFrame:
    return df.groupBy("prior_bought").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("label").alias("n_pos"))


def band_rates(df: DataFrame, anchor: str) -> DataFrame:
    """Per month and repeat/explore bucket: rows, positives, positives per rank band and rates."""
    tagged = head_positions(df, anchor, "pa").withColumn("band", band("pa"))
    pos = F.col("label") == 1
    n = lambda c: F.sum(c.cast("bigint"))
    return tagged.groupBy("ym", F.when(F.col("prior_bought") == 1, "repeat").otherwise("explore").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n_rows"), n(pos).alias("pos"), n(pos & (F.col("band") == "top10")).alias("pos_top10"),
        n(pos & (F.col("band") == "11_30")).alias("pos_11_30"), n(pos & (F.col("band") == "below30")).alias("pos_below30"),
    ).withColumn("pos_rate", F.col("pos") / F.col("n_rows")).withColumn(
        "top10_hit_rate", F.when(F.col("pos") > 0, F.col("pos_top10") / F.col("pos")))


def signal_density(df: DataFrame, anchor: str, signal: str, has_flag: str) -> DataFrame:
    """Share of rows with a positive signal, its mean and the flag share, by bucket x label x band."""
    tagged = head_positions(df, anchor, "pa").withColumn("band", band("pa"))
    return tagged.groupBy(
        F.when(F.col("prior_bought") == 1, "repeat").otherwise("explore").alias("bucket"), "label", "band"
    ).agg(F.count(F.lit(1)).alias("n_rows"), F.avg((F.col(signal) > 0).cast("double")).alias("share_positive"),
          F.avg(signal).alias("mean_signal"), F.avg(has_flag).alias("flag_share"))


def user_history(baskets: DataFrame) -> DataFrame:
    """(cut, user): number of baskets and size of the newest one (baskets carry cut, order, ts, size)."""
    return baskets.select("cut", "user_id", "order_id", "ts", "size").distinct().groupBy("cut", "user_id").agg(
        F.count(F.lit(1)).alias("hist_baskets"), F.max_by("size", F.struct("ts", "order_id")).alias("last_size"))


def bucket_metrics(df: DataFrame, history: DataFrame, anchor: str, final: str, min_users: int = 5) -> DataFrame:
    """Composite of both scores per history-size and last-basket-size bucket."""
    joined = df.join(history, ["cut", "user_id"], "left").na.fill(0, ["hist_baskets", "last_size"])
    dims = F.explode(F.array(
        F.struct(F.lit("hist_baskets").alias("dim"), S.right_closed_bucket("hist_baskets", HISTORY_EDGES, HISTORY_LABELS).alias("bin")),
        F.struct(F.lit("last_size").alias("dim"), S.right_closed_bucket("last_size", BASKET_EDGES, BASKET_LABELS).alias("bin"))))
    rows = joined.withColumn("__d", dims).select("*", F.col("__d.dim").alias("dim"), F.col("__d.bin").alias("bin")).drop("__d")
    by = ["dim", "bin", *GROUP]

    def comp(score, name):
        c = M.composite(M.group_metrics(rows, score, by), by=["dim", "bin"])
        return c.select("dim", "bin", "n_rows", "n_pos", F.col("composite").alias(name))

    users = rows.groupBy("dim", "bin").agg(F.count_distinct("user_id").alias("n_users")).filter(F.col("n_users") >= min_users)
    return comp(anchor, "anchor_comp").join(comp(final, "final_comp").drop("n_rows", "n_pos"), ["dim", "bin"]).join(
        users, ["dim", "bin"]).withColumn("d_comp", F.col("final_comp") - F.col("anchor_comp"))


def basket_dominance(baskets: DataFrame, share: float = 0.01) -> DataFrame:
    """Basket count, largest size, size quantiles, and the weight share of the heaviest 1 %.

    Weights depend on the size only, so everything is computed on the size histogram.
    """
    from pyspark.sql import Window

    w = 1.0 / F.sqrt(F.greatest(F.col("size") - 1, F.lit(1)).cast("double"))
    hist = baskets.groupBy("size").agg(F.count(F.lit(1)).alias("c")).withColumn("w", w)
    # one row per distinct basket size
    order = Window.orderBy(F.col("w").desc(), "size").rowsBetween(Window.unboundedPreceding, -1)
    total = hist.agg(F.sum("c").alias("n")).scalar()
    placed = hist.withColumn("before", F.coalesce(F.sum("c").over(order), F.lit(0))).withColumn(
        "take", F.greatest(F.lit(1), F.floor(total * share)))
    inside = F.greatest(F.least(F.col("c"), F.col("take") - F.col("before")), F.lit(0))
    weight_share = placed.agg((F.sum(inside * F.col("w")) / F.sum(F.col("c") * F.col("w"))).alias("s")).scalar()
    q = A.quantiles(baskets, "size", [0.5, 0.9, 0.99])
    return q.select(*[F.col("q")[i].alias(n) for i, n in enumerate(("q50", "q90", "q99"))]).withColumn(
        "n_baskets", total).withColumn("top_weight_share", weight_share)


def exclusive_seats(df: DataFrame, a: str, b: str, items: DataFrame, k: int = 10, by=GROUP) -> DataFrame:
    """Seats held under one score only: count, owned share, mean log units of the items."""
    seats = Fu.seats(df, by, a, k).select(*by, "item_id", F.lit("a").alias("side")).unionByName(
        Fu.seats(df, by, b, k).select(*by, "item_id", F.lit("b").alias("side")))
    only = seats.groupBy(*by, "item_id").agg(F.count(F.lit(1)).alias("n"), F.max("side").alias("side")).filter(F.col("n") == 1)
    full = only.join(df.select(*by, "item_id", "prior_bought"), [*by, "item_id"]).join(items, "item_id", "left")
    return full.groupBy("side").agg(
        F.count(F.lit(1)).alias("n_seats"), F.avg(F.col("prior_bought").cast("double")).alias("owned_share"),
        F.avg(S.log1p0("units")).alias("mean_log_units"))


def menu_displacement(df: DataFrame, a: str, b: str, weights, k: int = 10, by=GROUP) -> DataFrame:
    """Top-k seats that change when the weight of ``a`` moves along a menu: against the previous
    weight and against both pure scores.  ``a`` and ``b`` are comparable scores (ranks)."""
    ws = [0.0, *weights, 1.0]
    rows = Fu.expand_weights(df, [a, b], [(w, 1.0 - w) for w in ws])
    seats = R.top_k(rows, ["weight_id", *by], [F.col("score").desc(), F.col("item_id")], k)
    held = seats.groupBy(*by, "item_id").agg(F.collect_set("weight_id").alias("ids"))  # at most one entry per weight
    steps = F.array(*[F.struct(
        F.lit(float(w)).alias("weight"), F.lit(i).alias("me"), F.lit(i - 1).alias("prev")) for i, w in enumerate(ws) if 0 < i < len(ws) - 1])
    x = held.withColumn("s", F.explode(steps))
    has = lambda c: F.array_contains("ids", c).cast("bigint")
    moved = lambda c: F.sum(F.abs(has(F.col("s.me")) - has(c)))
    return x.groupBy(F.col("s.weight").alias("weight")).agg(
        moved(F.col("s.prev")).alias("vs_previous"), moved(F.lit(0)).alias("vs_b"), moved(F.lit(len(ws) - 1)).alias("vs_a"))


def flagged_swaps(df: DataFrame, before: str, after: str, flag: str, k: int = 10, by=GROUP) -> DataFrame:
    """Seats changed by a boost, and how many flagged items came in or went out."""
    old = Fu.seats(df, by, before, k).select(*by, "item_id", flag, F.lit(1).alias("o"), F.lit(0).alias("n"))
    new = Fu.seats(df, by, after, k).select(*by, "item_id", flag, F.lit(0).alias("o"), F.lit(1).alias("n"))
    per = old.unionByName(new).groupBy(*by, "item_id").agg(F.max(flag).alias("f"), F.sum("o").alias("o"), F.sum("n").alias("n"))
    n = lambda c: F.sum(c.cast("bigint"))
    enter, leave, marked = F.col("o") == 0, F.col("n") == 0, F.col("f") == 1
    return per.agg(n(enter).alias("swapped"), n(enter & marked).alias("flagged_in"), n(leave & marked).alias("flagged_out"))


def scheme_comparison(df: DataFrame, a: str, b: str, k: int = 10, by=GROUP) -> DataFrame:
    """Row Pearson, mean group Spearman and mean top-k overlap (hits / min(k, n)) of two signals."""
    corr = A.correlations(df, by, a, b)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    shared = Fu.seats(df, by, a, k).select(*by, "item_id").join(Fu.seats(df, by, b, k).select(*by, "item_id"), [*by, "item_id"], "left_semi")
    per = sizes.join(shared.groupBy(*by).agg(F.count(F.lit(1)).alias("h")), by, "left").na.fill(0, ["h"])
    overlap = per.agg(F.avg(F.col("h") / F.least(F.lit(k), F.col("n"))).alias("o")).scalar()
    return corr.withColumn("top_overlap", overlap)
