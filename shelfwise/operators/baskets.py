"""Basket-history features: similarity of a candidate to the user's latest baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import ranks as R
from shelfwise.functions import scalar as S
from shelfwise.operators import similarity as sim
from shelfwise.operators.replay import as_of
from shelfwise.schema import SERVICE_CODES

SCHEMES = ["cos_bigbasket", "cos_raw", "jaccard", "cond", "cos_bigbasket_t90", "cos_bigbasket_t30", "hg_linear"]
FEATURES = ["sim_last1", "sim_last3_max", "sim_last3_mean", "simnb_last1", "simnb_last3_max",
            "simnb_last3_mean", "nb_item_baskets", "has_basket"]


def vocabulary(tx: DataFrame, extra: DataFrame | None = None, codes=SERVICE_CODES) -> DataFrame:
    """Items without service codes, plus extra items."""
    base = tx.select("item_id").distinct().filter(~F.col("item_id").isin(list(codes)))
    return base if extra is None else base.unionByName(extra.select("item_id")).distinct()


def basket_rows(tx: DataFrame, codes=SERVICE_CODES) -> DataFrame:
    """Distinct (user, order, item) with basket time (earliest row) and basket size."""
    items = tx.filter(~F.col("item_id").isin(list(codes))).groupBy("user_id", "order_id", "item_id").agg(F.min("ts").alias("t"))
    heads = items.groupBy("user_id", "order_id").agg(F.min("t").alias("ts"), F.count(F.lit(1)).alias("size"))
    return items.drop("t").join(heads, ["user_id", "order_id"])


def basket_table(tx: DataFrame, codes=SERVICE_CODES) -> DataFrame:
    """One row per basket: user, order, time, size."""
    return basket_rows(tx, codes).select("user_id", "order_id", "ts", "size").distinct()


def recent_baskets(baskets: DataFrame, k: int, by=("cut", "user_id")) -> DataFrame:
    """Latest k baskets per user, age_rank 1 = newest, by (time, order id)."""
    heads = baskets.select(*by, "order_id", "ts").distinct()
    return R.top_k(heads, list(by), [F.col("ts").desc(), F.col("order_id").desc()], k, "age_rank")


def _weight(scheme: str):
    """Weight of a basket's entries in a scheme."""
    size = F.col("size").cast("double")
    if scheme in ("cos_raw", "jaccard"):
        w = F.lit(1.0)
    elif scheme == "hg_linear":
        w = 1.0 / F.sqrt(size)
    else:
        w = F.when(size > 1, 1.0 / F.sqrt(size - 1.0)).otherwise(F.lit(1.0))
    for tag, tau in (("_t90", 90.0), ("_t30", 30.0)):
        if scheme.endswith(tag):
            w = w * S.decay(S.frac_days("ts", F.col("cut")), tau)
    return w


def item_similarity(rows: DataFrame, scheme: str, by=("cut",)) -> DataFrame:
    """Similarity (by, i, j, sim) for i <> j from basket co-occurrence; the diagonal (1) is implied.

    Basket weights: 1 (raw, jaccard), 1/sqrt(size - 1) with 1 for single-item baskets (big-basket
    schemes and cond), 1/sqrt(size) (hypergraph); a ``_tN`` suffix multiplies exp(-age/N), so the
    product of two entries carries the factor twice.
    """
    by = list(by)
    w = _weight(scheme)
    weighted = rows.select(*by, F.concat_ws("|", "user_id", "order_id").alias("basket"), "item_id", w.alias("w"))
    full = sim.with_diagonal(
        sim.pair_sums(weighted, "basket", "item_id", "w", by), sim.diagonal(weighted, "item_id", "w", by), by)
    if scheme == "jaccard":
        s = F.col("m") / (F.col("n_i") + F.col("n_j") - F.col("m"))
        return sim.mirror(full.withColumn("sim", s), "sim", by=by)
    if scheme == "cond":
        both = F.explode(F.array(
            F.struct(F.col("i").alias("i"), F.col("j").alias("j"), F.least(F.col("c") / F.col("d_i"), F.lit(1.0)).alias("sim")),
            F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.least(F.col("c") / F.col("d_j"), F.lit(1.0)).alias("sim"))))
        return full.select(*by, both.alias("p")).select(*by, "p.*")
    return sim.mirror(full.withColumn("sim", F.col("c") / F.sqrt(F.col("d_i") * F.col("d_j"))), "sim", by=by)


def basket_features(cand: DataFrame, rows: DataFrame, pairs: DataFrame, last: int = 3) -> DataFrame:
    """Adds the eight columns to candidates (cut, user_id, item_id, ...).

    Per candidate and recent basket: the best similarity to its items (1 if the candidate is in
    it), and the best similarity to the other items.  A candidate alone in its basket counts -1
    in the second form; a basket without any similar item counts 0.  The mean runs over the
    user's min(last, n) baskets.
    """
    key = ["cut", "user_id", "item_id"]
    recent = recent_baskets(rows, last).select("cut", "user_id", "order_id", "age_rank")
    inside = rows.join(recent, ["cut", "user_id", "order_id"])
    keyed = cand.select(*key).distinct()
    # similar items: basket item j reaches candidate i through the pair table
    reach = (
        inside.select("cut", "user_id", "order_id", "age_rank", F.col("item_id").alias("j"))
        .join(pairs, ["cut", "j"])
        .select("cut", "user_id", F.col("i").alias("item_id"), "order_id", "age_rank", "sim", F.lit(0).alias("own"))
        .join(keyed, key, "left_semi")
    )
    member = (
        inside.join(keyed, key, "left_semi")
        .select(*key, "order_id", "age_rank", F.when(F.col("size") == 1, -1.0).alias("sim"), F.lit(1).alias("own"))
    )
    per_basket = reach.unionByName(member).groupBy(*key, "order_id", "age_rank").agg(
        F.max("own").alias("own"), F.coalesce(F.max("sim"), F.lit(0.0)).alias("nb"))
    per_basket = per_basket.withColumn("mx", F.when(F.col("own") == 1, 1.0).otherwise(F.col("nb")))
    n_recent = recent.groupBy("cut", "user_id").agg(F.count(F.lit(1)).alias("n_recent"))
    agg = per_basket.groupBy(*key).agg(
        F.max(F.when(F.col("age_rank") == 1, F.col("mx"))).alias("sim_last1"), F.max("mx").alias("mx_max"),
        F.sum("mx").alias("mx_sum"), F.max(F.when(F.col("age_rank") == 1, F.col("nb"))).alias("simnb_last1"),
        F.max("nb").alias("nb_max"), F.sum("nb").alias("nb_sum"), F.count(F.lit(1)).alias("seen"))
    bought_in = rows.groupBy(*key).agg(F.count_distinct("order_id").alias("nb_item_baskets"))
    out = cand.join(n_recent, ["cut", "user_id"], "left").join(agg, key, "left").join(bought_in, key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    all_seen = F.coalesce("seen", F.lit(0)) == F.coalesce("n_recent", F.lit(0))

    def best(c):  # a basket without any entry stands for 0
        return F.when(all_seen, zero(c)).otherwise(F.greatest(zero(c), F.lit(0.0)))

    n = F.greatest(F.coalesce("n_recent", F.lit(0)), F.lit(1))
    return out.select(
        *cand.columns, zero("sim_last1").alias("sim_last1"), best("mx_max").alias("sim_last3_max"),
        (zero("mx_sum") / n).alias("sim_last3_mean"), zero("simnb_last1").alias("simnb_last1"),
        best("nb_max").alias("simnb_last3_max"), (zero("nb_sum") / n).alias("simnb_last3_mean"),
        F.coalesce("nb_item_baskets", F.lit(0)).cast("double").alias("nb_item_baskets"),
        F.col("n_recent").isNotNull().cast("double").alias("has_basket"))


def scheme_similarities(rows: DataFrame, by=("cut",)) -> DataFrame:
    """(by, i, j) with a column per scheme of SCHEMES, i <> j: all weights are summed in one self-join."""
    by = list(by)
    own = {"raw": "cos_raw", "big": "cos_bigbasket", "t90": "cos_bigbasket_t90", "t30": "cos_bigbasket_t30", "hg": "hg_linear"}
    weighted = rows.select(*by, F.concat_ws("|", "user_id", "order_id").alias("basket"), "item_id",
                           *[_weight(s).alias(w) for w, s in own.items()])
    diag = weighted.groupBy(*by, F.col("item_id").alias("e")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(w) * F.col(w)).alias(w) for w in own])
    left, right = (diag.select(*by, F.col("e").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ["n", *own]]) for side in "ij")
    full = sim.pair_sums_many(weighted, "basket", "item_id", list(own), by).join(left, [*by, "i"]).join(right, [*by, "j"])
    both = {s: F.col(w) / F.sqrt(F.col(f"{w}_i") * F.col(f"{w}_j")) for w, s in own.items()}
    both["jaccard"] = F.col("m") / (F.col("n_i") + F.col("n_j") - F.col("m"))

    def way(i, j):
        cond = F.least(F.col("big") / F.col(f"big_{i}"), F.lit(1.0))
        return F.struct(F.col(i).alias("i"), F.col(j).alias("j"), *[both.get(s, cond).alias(s) for s in SCHEMES])

    return full.select(*by, F.explode(F.array(way("i", "j"), way("j", "i"))).alias("p")).select(*by, "p.*")


def scheme_means(cand: DataFrame, rows: DataFrame, pairs: DataFrame, last: int = 3) -> DataFrame:
    """``sim_last3_mean`` of every scheme as a column of that name, for ``pairs`` of ``scheme_similarities``."""
    key = ["cut", "user_id", "item_id"]
    recent = recent_baskets(rows, last).select("cut", "user_id", "order_id")
    inside = rows.join(recent, ["cut", "user_id", "order_id"])
    keyed = cand.select(*key).distinct()
    reach = (
        inside.select("cut", "user_id", "order_id", F.col("item_id").alias("j")).join(pairs, ["cut", "j"])
        .select("cut", "user_id", F.col("i").alias("item_id"), "order_id", *SCHEMES).join(keyed, key, "left_semi")
    )
    member = inside.join(keyed, key, "left_semi").select(*key, "order_id", *[F.lit(1.0).alias(s) for s in SCHEMES], F.lit(1).alias("own"))
    # a similarity may pass 1 by a rounding error, and a candidate in the basket counts exactly 1
    best = reach.withColumn("own", F.lit(0)).unionByName(member).groupBy(*key, "order_id").agg(
        F.max("own").alias("own"), *[F.max(s).alias(s) for s in SCHEMES])
    best = best.select(*key, *[F.when(F.col("own") == 1, 1.0).otherwise(F.col(s)).alias(s) for s in SCHEMES])
    n = recent.groupBy("cut", "user_id").agg(F.count(F.lit(1)).alias("__n"))
    sums = best.groupBy(*key).agg(*[F.sum(s).alias(s) for s in SCHEMES])
    out = cand.join(n, ["cut", "user_id"], "left").join(sums, key, "left")
    each = F.greatest(F.coalesce("__n", F.lit(0)), F.lit(1))
    return out.select(*cand.columns, *[(F.coalesce(F.col(s), F.lit(0.0)) / each).alias(s) for s in SCHEMES])


def features_for_scheme(tx: DataFrame, cand: DataFrame, cuts, scheme: str, last: int = 3) -> DataFrame:
    """All months of one scheme in one job; ``cand`` carries ``cut``."""
    rows = as_of(basket_rows(tx), cuts).persist()
    return basket_features(cand, rows, item_similarity(rows, scheme), last)
