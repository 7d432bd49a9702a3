"""Ranking metrics.  A group is a user, or a (month, user) pair; single-class groups are NULL and
skipped by the means.  The AUC part adds up rank sums per score range and the list part keeps
ten rows per group, so no group is sorted whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import ranks as R

GROUP = ["ym", "user_id"]
WEIGHTS = (0.4, 0.4, 0.2)


def _discount(i: int) -> float:
    import math

    return math.log2(i + 1)


def ideal_dcg(p, k: int, mode: str):
    """Ideal DCG for p positives: ``standard`` sums 1/log2(i+1); ``reference`` sums log2(i+1),
    the form some published figures were computed with."""
    total, table = 0.0, [0.0]
    for i in range(1, k + 1):
        total += _discount(i) if mode == "reference" else 1.0 / _discount(i)
        table.append(total)
    index = F.least(p, F.lit(float(k))).cast("int") + 1
    return F.element_at(F.array(*[F.lit(x) for x in table]), index)


def group_metrics(df: DataFrame, score: str, by=GROUP, label: str = "label", k: int = 10,
                  idcg: str = "reference", tie: str = "item_id") -> DataFrame:
    """Per group: n, p, auc, ndcg, recall, hits."""
    by = list(by)
    base = R.group_auc(df, by, score, label)
    head = R.top_k(df.select(*by, tie, score, label), by, [F.col(score).desc(), F.col(tie)], k, "__rk")
    hit = F.col(label) == 1
    lists = head.groupBy(*by).agg(
        F.sum(hit.cast("double")).alias("hits"),
        F.sum(F.when(hit, 1.0 / F.log2(F.col("__rk") + 1.0)).otherwise(0.0)).alias("dcg"))
    out = base.join(lists, by)
    has_pos = F.col("p") > 0
    return out.select(
        *by, "n", "p", "auc",
        F.when(has_pos, F.col("dcg") / ideal_dcg(F.col("p"), k, idcg)).alias("ndcg"),
        F.when(has_pos, F.col("hits") / F.col("p")).alias("recall"), "hits")


def auc_aggregates():
    n = F.when(F.col("auc").isNotNull(), F.col("n"))
    return [F.avg("auc").alias("gauc_macro"), (F.sum(F.col("auc") * F.col("n")) / F.sum(n)).alias("gauc_weighted")]


def composite(groups: DataFrame, by=()) -> DataFrame:
    """0.4 GAUC + 0.4 NDCG + 0.2 recall of the macro means, with the parts."""
    agg = groups.groupBy(*by).agg(
        F.avg("auc").alias("gauc"), F.avg("ndcg").alias("ndcg"), F.avg("recall").alias("recall"),
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"), F.sum("p").cast("bigint").alias("n_pos"))
    a, b, c = WEIGHTS
    return agg.withColumn("composite", a * F.col("gauc") + b * F.col("ndcg") + c * F.col("recall"))


def aggregation_variants(groups: DataFrame) -> DataFrame:
    """Macro and exposure-weighted means of the three parts, and the eight composites that pick
    macro (m) or weighted (w) for AUC, NDCG and recall in turn."""
    def weighted(c):
        return F.sum(F.col(c) * F.col("n")) / F.sum(F.when(F.col(c).isNotNull(), F.col("n")))

    one = groups.agg(
        *[F.avg(c).alias(f"{c}_m") for c in ("auc", "ndcg", "recall")],
        *[weighted(c).alias(f"{c}_w") for c in ("auc", "ndcg", "recall")])
    a, b, c = WEIGHTS
    rows = F.array(*[
        F.struct(F.lit(x + y + z).alias("variant"),
                 (a * F.col(f"auc_{x}") + b * F.col(f"ndcg_{y}") + c * F.col(f"recall_{z}")).alias("composite"))
        for x in "mw" for y in "mw" for z in "mw"])
    return one.select(F.inline(rows))


def pooled_auc(df: DataFrame, score: str, label: str = "label") -> DataFrame:
    """ROC AUC over all rows, ties averaged."""
    return R.group_auc(df, [], score, label).select("n", F.col("p").cast("bigint").alias("p"), "auc")


def list_metrics(recs: DataFrame, truth: DataFrame, ks=(5, 10), users: DataFrame | None = None) -> DataFrame:
    """precision@k, recall@k, hit@k of ranked lists (user_id, item_id, rank) against baskets.

    Averages run over all users of ``users`` (default: users with a basket); a user without a
    list counts as zero.
    """
    basket = truth.select("user_id", "item_id").distinct()
    sizes = basket.groupBy("user_id").agg(F.count(F.lit(1)).alias("size"))
    base = sizes if users is None else users.select("user_id").distinct().join(sizes, "user_id")
    hits = recs.filter(F.col("rank") <= max(ks)).join(basket, ["user_id", "item_id"], "left_semi")
    per = hits.groupBy("user_id").agg(*[F.sum((F.col("rank") <= k).cast("bigint")).alias(f"h{k}") for k in ks])
    full = base.join(per, "user_id", "left").na.fill(0, [f"h{k}" for k in ks])
    aggs = [F.count(F.lit(1)).alias("n_users")]
    for k in ks:
        aggs += [F.avg(F.col(f"h{k}") / F.lit(float(k))).alias(f"precision_{k}"),
                 F.avg(F.col(f"h{k}") / F.col("size")).alias(f"recall_{k}"),
                 F.avg((F.col(f"h{k}") > 0).cast("double")).alias(f"hit_{k}")]
    return full.agg(*aggs)


def pool_metrics(df: DataFrame, score: str, ks=(5, 10), by=("user_id",), label: str = "label") -> DataFrame:
    """hit / precision / recall @k on a scored labelled pool; groups with positives only, and
    precision divides by min(k, group size)."""
    by = list(by)
    totals = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("p"))
    head = R.top_k(df, by, [F.col(score).desc(), F.col("item_id")], max(ks), "__rk")
    per = head.groupBy(*by).agg(*[F.sum(F.when(F.col("__rk") <= k, F.col(label)).otherwise(0)).alias(f"h{k}") for k in ks])
    full = totals.join(per, by).filter(F.col("p") > 0)
    aggs = [F.count(F.lit(1)).alias("n_groups")]
    for k in ks:
        aggs += [F.avg((F.col(f"h{k}") > 0).cast("double")).alias(f"hit_{k}"),
                 F.avg(F.col(f"h{k}") / F.least(F.lit(k), F.col("n"))).alias(f"prec_{k}"),
                 F.avg(F.col(f"h{k}") / F.col("p")).alias(f"rec_{k}")]
    return full.agg(*aggs)


def jaccard_coverage(df: DataFrame, score: str, k: int = 10, by=("user_id",), label: str = "label") -> DataFrame:
    """Mean Jaccard of the top-k with the positives, and distinct items in all top-k lists over
    distinct items in the pool."""
    by = list(by)
    head = R.top_k(df, by, [F.col(score).desc(), F.col("item_id")], k, "__rk").persist()
    per = head.groupBy(*by).agg(F.count(F.lit(1)).alias("t"), F.sum(label).alias("h"))
    pos = df.groupBy(*by).agg(F.sum(label).alias("p")).filter(F.col("p") > 0)
    items = df.select(F.count_distinct("item_id").alias("c")).scalar()
    shown = head.select(F.count_distinct("item_id").alias("c")).scalar()
    return per.join(pos, by).agg(
        F.count(F.lit(1)).alias("n_groups"), F.avg(F.col("h") / (F.col("t") + F.col("p") - F.col("h"))).alias("jaccard"),
    ).withColumn("coverage", shown / items)


def monthly_composite(df: DataFrame, score: str, **kw) -> DataFrame:
    return composite(group_metrics(df, score, **kw), by=["ym"])


def monthly_gain(df: DataFrame, anchor: str, final: str, **kw) -> DataFrame:
    a = monthly_composite(df, anchor, **kw).select(
        "ym", F.col("composite").alias("anchor_comp"), F.col("gauc").alias("anchor_gauc"),
        F.col("ndcg").alias("anchor_ndcg"), F.col("recall").alias("anchor_recall"), "n_rows", "n_pos")
    b = monthly_composite(df, final, **kw).select(
        "ym", F.col("composite").alias("final_comp"), F.col("gauc").alias("final_gauc"),
        F.col("ndcg").alias("final_ndcg"), F.col("recall").alias("final_recall"))
    return a.join(b, "ym").withColumn("d_comp", F.col("final_comp") - F.col("anchor_comp"))


def reproduction_check(computed: DataFrame, stored: DataFrame, keys, cols, tolerance: float = 5e-4) -> DataFrame:
    """Absolute difference per metric between a computed and a stored table, and a verdict."""
    other = stored.select(*keys, *[F.col(c).alias(f"__{c}") for c in cols])
    diffs = [F.abs(F.col(c) - F.col(f"__{c}")) for c in cols]
    ok = F.lit(True)
    for d in diffs:
        ok = ok & F.coalesce(d <= tolerance, F.lit(False))
    return computed.join(other, list(keys), "full").select(
        *keys, *[d.alias(f"diff_{c}") for c, d in zip(cols, diffs)], ok.alias("reproduced"))


def adoption(select_month: DataFrame, confirm_month: DataFrame, min_gain: float = 5e-4) -> DataFrame:
    """Per candidate: alpha chosen on the select month (largest composite, smaller alpha on ties),
    its gain there and on the confirm month, and whether it is adopted.  Inputs: candidate, alpha,
    composite; alpha 0 is the anchor."""
    best = select_month.groupBy("candidate").agg(
        F.max_by("alpha", F.struct("composite", -F.col("alpha"))).alias("alpha"), F.max("composite").alias("comp_select"),
        F.max(F.when(F.col("alpha") == 0, F.col("composite"))).alias("base_select"))
    conf = confirm_month.select("candidate", "alpha", F.col("composite").alias("comp_confirm"))
    base = confirm_month.filter(F.col("alpha") == 0).select("candidate", F.col("composite").alias("base_confirm"))
    return best.join(conf, ["candidate", "alpha"]).join(base, "candidate").select(
        "candidate", "alpha", (F.col("comp_select") - F.col("base_select")).alias("gain_select"),
        (F.col("comp_confirm") - F.col("base_confirm")).alias("gain_confirm"),
    ).withColumn("adopt", (F.col("gain_select") >= 0) & (F.col("gain_confirm") >= min_gain))
