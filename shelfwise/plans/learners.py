"""N: learners, with K10, A13, R12 and R13, which need a fitted model.

Scores differ between engines, so a query returns what SQL can state about them: the keys of the scored rows, whether each
score is a number in its range, and whether the scores order the rows better than chance where they are fitted.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from shelfwise import schema as C
from shelfwise.functions import ranks as R
from shelfwise.functions import scalar as S
from shelfwise.operators import features as Fe, fusion as Fu, learners as L, metrics as M, recall as Rc, replay as Rp, sampling as Sa, serving as Sv
from shelfwise.plans import shared
from shelfwise.plans.base import Family, cte
from shelfwise.plans.features import TOP_N
from shelfwise.schema import CUT, MONTH_CUTS
from shelfwise.sources import retail, transactions as T

FAMILY = Family()
add = FAMILY.add
FEATS = [c for c in C.FEATURES_CONTEXT] + ["ui_owned"]
MONTHS = [f"{c:%Y-%m}" for c in MONTH_CUTS]
G = ["ym", "user_id"]


def wide(spark, d):
    """Replay rows of all months with the context columns."""
    def build():
        b = Fe.build_bundle(retail.retail_view(spark, d, country=True), retail.products(spark, d), MONTH_CUTS, TOP_N)
        rows = shared.replay_rows(spark, d).select("cut", "ym", "user_id", "item_id", "label", "prior_bought")
        return Fe.context_features(rows, b).withColumn("ui_owned", F.col("prior_bought").cast("double"))

    return shared.stored(spark, d, "wide", build)


#: Tree counts of the two boosted configurations and the forest, iterations of the linear models.
TREES, FOREST_TREES, MAX_ITER = 300, 100, 100


def lr(weight="weight", c=1.0, features=FEATS):
    return lambda train: L.logistic_on(train, features, c, weight, MAX_ITER)


def gbt(weight="weight", trees=TREES, depth=5, step=0.05):
    return lambda train: L.boosted_trees(FEATS, weight=weight, trees=trees, depth=depth, step=step)


def _fit(learner, train):
    return learner(train).fit(train)


def _metrics(oof, name):
    c = M.composite(M.group_metrics(oof, "score"))
    return c.select(F.lit(name).alias("model"), "n_rows", "n_groups", "n_pos", "composite", "gauc", "ndcg", "recall")


def _train_last(w):
    """(training rows, rows of the last month)."""
    return w.filter(F.col("ym") < MONTHS[-1]), w.filter(F.col("ym") == MONTHS[-1])


def in_unit(score="score"):
    return F.coalesce(F.col(score).between(0.0, 1.0) & ~F.isnan(score), F.lit(False))


def is_number(score="score"):
    return F.coalesce(~F.isnan(score) & (F.abs(F.col(score)) < float("inf")), F.lit(False))


def facts(scored, *more, valid=None):
    return scored.select(*G, "item_id", "label", *more, (in_unit() if valid is None else valid).alias("valid"))


def ordered_by_fit(model_scores):
    """One row: rows, and whether the pooled AUC on the rows the model was fitted on is above one half."""
    auc = M.pooled_auc(model_scores, "score")
    return auc.select("n", "p", (F.col("auc") > 0.5).alias("better_than_chance"))


LAST = f"SELECT ym, user_id, item_id, label, true AS valid FROM replay WHERE ym = '{MONTHS[-1]}'"
LATER = f"SELECT ym, user_id, item_id, label, true AS valid FROM replay WHERE ym > '{MONTHS[0]}'"


@add("n01_logistic", LAST)
def n01(spark, d):
    train, last = _train_last(wide(spark, d))
    return facts(L.add_probability(_fit(lr(), Rp.weight_equal_group(train)), last))


@add("n01_logistic_fit", f"SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS p, true AS better_than_chance FROM replay WHERE ym < '{MONTHS[-1]}'")
def n01_fit(spark, d):
    train = Rp.weight_equal_group(_train_last(wide(spark, d))[0])
    return ordered_by_fit(L.add_probability(_fit(lr(), train), train))


@add("n02_boosted_trees", LAST)
def n02(spark, d):
    train, last = _train_last(wide(spark, d))
    return facts(L.add_probability(_fit(gbt(step=0.1), Rp.weight_macro(train)), last))


@add("n03_boosted_trees_alt", LAST)
def n03(spark, d):
    train, last = _train_last(wide(spark, d))
    model = L.boosted_trees_alt(FEATS, "weight", trees=TREES, depth=6).fit(Rp.weight_equal_group(train))
    return facts(L.add_probability(model, last))


@add("n04_forest", LAST)
def n04(spark, d):
    train, last = _train_last(wide(spark, d))
    model = L.forest(FEATS, "weight", trees=FOREST_TREES, depth=6).fit(Rp.weight_equal_group(train))
    return facts(L.add_probability(model, last))


@add("n05_pairwise_ranker", LATER)
def n05(spark, d):
    """Out of fold: every later month scored by the ranker of the months before it."""
    return facts(L.out_of_fold_ranker(wide(spark, d), MONTHS, FEATS), valid=is_number())


@add("n06_factorization_machine", LAST)
def n06(spark, d):
    """Rows are repeated by their weight: 1/sqrt(rows of the user), times the class ratio for positives."""
    train, last = _train_last(wide(spark, d))
    encode = L.id_encoder(train, FEATS)
    copies = L.replicate_by_weight(Rp.weight_macro_scaled(train), "weight", [*G, "item_id"], mean_copies=1.0)
    model = L.factorization(factor=16, max_iter=50).fit(encode(copies))
    return facts(L.add_probability(model, encode(last)))


@add("n06_weight_copies", f"""
SELECT * FROM (
WITH r AS (SELECT ym, user_id, item_id, label FROM replay WHERE ym < '{MONTHS[-1]}'),
c AS (SELECT sum(1 - label) / sum(label) AS ratio FROM r),
w AS (SELECT r.*, CASE WHEN label = 1 THEN ratio ELSE 1 END / sqrt(count(*) OVER (PARTITION BY user_id)) AS weight FROM r, c),
x AS (SELECT *, weight * (SELECT round(2.0::DOUBLE / avg(weight), 6) FROM w) AS scaled FROM w)
SELECT label, count(*) AS n, CAST(sum(floor(scaled) + CASE WHEN ('0x' || substr(md5(ym || '-' || user_id || '-' || item_id || '-42-copies'), 1, 7))::BIGINT / 268435456.0::DOUBLE
  < scaled - floor(scaled) THEN 1 ELSE 0 END) AS BIGINT) AS copies, CAST(count(*) FILTER (WHERE scaled >= 1) AS BIGINT) AS n_sure FROM x GROUP BY label)
""")
def n06_copies(spark, d):
    """Rows, their copies, and rows that have one for sure, by class."""
    weighted = Rp.weight_macro_scaled(_train_last(wide(spark, d))[0])
    out = L.copies_by_weight(weighted, "weight", [*G, "item_id"])
    mean = weighted.agg(F.avg("weight").alias("m")).first()["m"]
    sure = (F.col("weight") * F.lit(round(2.0 / mean, 6)) >= 1).cast("bigint")
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("copies"), F.sum(sure).alias("n_sure"))


def _als(spark, d, tau=None, gamma=0.0, rank=48, iterations=18):
    tx = retail.retail_view(spark, d)
    hist = tx.filter(F.col("ts") < S.at(CUT))
    model, index = L.implicit_factors(L.purchase_confidence(hist, CUT, tau), rank=rank, iterations=iterations)
    pop = hist.groupBy("item_id").agg(F.count_distinct("user_id").alias("weight")) if gamma else None
    return L.factor_scores(retail.candidate_pairs(spark, d), model, index, "score", pop, gamma)


cte("known", "SELECT c.user_id, c.item_id, u.user_id IS NOT NULL AND i.item_id IS NOT NULL AS known FROM cand c LEFT JOIN (SELECT DISTINCT user_id FROM hist) u ON u.user_id = c.user_id LEFT JOIN (SELECT DISTINCT item_id FROM hist) i ON i.item_id = c.item_id")


@add("n07_implicit_factors", "SELECT user_id, item_id, known FROM known")
def n07(spark, d):
    """Exactly the pairs of a known user and a known item have a score other than zero."""
    return _als(spark, d).select("user_id", "item_id", (F.col("score") != 0).alias("known"))


@add("n08_decayed_factors", "SELECT user_id, item_id, true AS valid FROM cand")
def n08(spark, d):
    scored = _als(spark, d, tau=60.0, gamma=0.1, rank=32)
    return scored.select("user_id", "item_id", is_number().alias("valid"))


@add("n09_factor_pair_scores", "SELECT count(*) AS n, count(*) FILTER (WHERE NOT known) AS zero, CAST(0 AS BIGINT) AS nan FROM known")
def n09(spark, d):
    """Share of pairs with a zero score because the user or the item has no factor."""
    return _als(spark, d).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("score") == 0).cast("bigint")).alias("zero"),
                              F.sum(F.isnan("score").cast("bigint")).alias("nan"))


@add("n10_out_of_fold", LATER)
def n10(spark, d):
    return facts(L.out_of_fold(wide(spark, d), MONTHS, lr(), Rp.weight_equal_group, parallel=2))


@add("n11_parameter_sweep", "SELECT 'lr_w' || coalesce(CAST(w AS VARCHAR), 'all') || '_a' || a || '_c' || c AS config, true AS gauc_macro_ok, true AS gauc_weighted_ok"
     " FROM (VALUES (2), (3), (NULL)) w(w), (VALUES ('0.5'), ('1.0')) a(a), (VALUES ('0.3'), ('1.0'), ('3.0')) c(c)")
def n11(spark, d):
    """Window of training months x exponent of the group weight x inverse regularisation."""
    out = L.linear_sweep(wide(spark, d), MONTHS, FEATS, (2, 3, None), (0.5, 1.0), (0.3, 1.0, 3.0), MAX_ITER)
    return out.select("config", in_unit("gauc_macro").alias("gauc_macro_ok"), in_unit("gauc_weighted").alias("gauc_weighted_ok"))


#: The eight boosted configurations (leaf counts as depths) and the exponent of the class ratio.
TREE_GRID = {
    "xb_base": (dict(depth=6, step=0.05, subsample=0.8, columns="0.8"), 0.0),
    "xb_d5": (dict(depth=5, step=0.05, subsample=0.8, columns="0.8"), 0.0),
    "xb_d7_l03": (dict(depth=7, step=0.03, subsample=0.8, columns="0.8"), 0.0),
    "xb_cs5_ss1": (dict(depth=6, step=0.05, subsample=1.0, columns="0.5"), 0.0),
    "xb_spw05": (dict(depth=6, step=0.05, subsample=0.8, columns="0.8"), 0.5),
    "lb_base": (dict(depth=5, step=0.05, subsample=0.8, columns="0.8", min_rows=20), 0.0),
    "lb_nl63": (dict(depth=6, step=0.05, subsample=0.8, columns="0.8", min_rows=20), 0.0),
    "lb_l03": (dict(depth=5, step=0.03, subsample=0.8, columns="0.8", min_rows=10), 0.0),
}
#: Tree counts of the sweep; all come from the longest fit.
SWEEP_TREES = (2, 4)


@add("n11_tree_sweep", "SELECT g || '_' || t AS config, true AS gauc_macro_ok, true AS gauc_weighted_ok FROM (VALUES "
     + ", ".join(f"('{g}')" for g in TREE_GRID) + ") g(g), (VALUES " + ", ".join(f"({t})" for t in SWEEP_TREES) + ") t(t)")
def n11_trees(spark, d):
    out = L.tree_sweep(wide(spark, d), MONTHS, FEATS, TREE_GRID, SWEEP_TREES)
    return out.select("config", in_unit("gauc_macro").alias("gauc_macro_ok"), in_unit("gauc_weighted").alias("gauc_weighted_ok"))


@add("n12_expert_pair", f"SELECT ym, user_id, item_id, label, CAST(prior_bought AS DOUBLE) AS ui_owned, true AS valid FROM replay WHERE ym = '{MONTHS[-1]}'")
def n12(spark, d):
    train, last = _train_last(wide(spark, d))
    return facts(L.expert_pair(Rp.weight_equal_group(train), last, lr()), "ui_owned")


@add("n13_residual_learner", f"SELECT ym, user_id, item_id, label, true AS lr_valid, true AS tree_valid FROM replay WHERE ym = '{MONTHS[-1]}'")
def n13(spark, d):
    from shelfwise.operators import baskets as B

    rows = shared.replay_rows(spark, d).select("cut", "ym", "user_id", "item_id", "label")
    f = B.features_for_scheme(retail.retail_view(spark, d), rows, MONTH_CUTS, "cos_bigbasket").persist()
    train, last = _train_last(f)
    model = L.logistic_on(train, B.FEATURES, c=0.1, max_iter=MAX_ITER).fit(train)
    small = L.boosted_trees(B.FEATURES, trees=50, depth=2).fit(train)
    both = L.add_probability(small, L.add_probability(model, last, "lr_resid"), "tree_resid")
    return both.select(*G, "item_id", "label", in_unit("lr_resid").alias("lr_valid"), in_unit("tree_resid").alias("tree_valid"))


@add("n14_back_test", " UNION ALL ".join(
    f"SELECT '{m}' AS model, '{a}' AS train_month, '{b}' AS test_month, (SELECT count(*) FROM replay WHERE ym = '{b}') AS n_rows, true AS valid"
    for a, b in zip(MONTHS[-3:], MONTHS[-2:]) for m in ("trees", "factorization")))
def n14(spark, d):
    """Train on month m, score month m + 1, for the last two pairs: boosted trees and a factorization machine."""
    w = wide(spark, d)
    out = None
    for train_m, test_m in zip(MONTHS[-3:], MONTHS[-2:]):
        train, test = Rp.weight_macro(w.filter(F.col("ym") == train_m)), w.filter(F.col("ym") == test_m)
        encode = L.id_encoder(train, FEATS)
        for name, scored in (
            ("trees", L.add_probability(_fit(gbt(trees=50), train), test)),
            ("factorization", L.add_probability(L.factorization(factor=16, max_iter=50).fit(encode(train)), encode(test))),
        ):
            part = scored.agg(F.lit(name).alias("model"), F.lit(train_m).alias("train_month"), F.lit(test_m).alias("test_month"),
                              F.count(F.lit(1)).alias("n_rows"), F.min(in_unit()).alias("valid"))
            out = part if out is None else out.unionByName(part)
    return out


def _retrained(spark, d):
    """Fit on all replay months, score every candidate at a later cut."""
    from datetime import datetime

    w = Rp.weight_equal_group(wide(spark, d))
    model = _fit(lr(), w)
    later = datetime(2001, 8, 1)
    b = Fe.build_bundle(retail.retail_view(spark, d, country=True), retail.products(spark, d), [later], TOP_N)
    cand = T.read_candidates(retail.candidate_pairs(spark, d)).withColumn("cut", S.at(later))
    rows = Fe.add_owned(Fe.context_features(cand, b), b)
    return T.submission(L.add_probability(model, rows))


@add("n15_retrain_and_score", "SELECT user_id, item_id, true AS valid FROM cand")
def n15(spark, d):
    return _retrained(spark, d).select("user_id", "item_id", in_unit().alias("valid"))


@add("k10_candidate_scoring", """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE c.user_id NOT IN (SELECT user_id FROM tx) OR c.item_id NOT IN (SELECT item_id FROM tx)) AS cold_rows,
 count(p.user_id) AS owned_rows, true AS valid FROM cand c LEFT JOIN pairs p ON p.user_id = c.user_id AND p.item_id = c.item_id
""")
def k10(spark, d):
    """Model of an earlier cut applied at a later one, with the coverage summary."""
    sub = _retrained(spark, d)
    tx = retail.retail_view(spark, d)
    out = Sv.score_summary(sub, "score", tx, tx, tx)
    fine = in_unit("lo") & in_unit("p50") & in_unit("hi") & (F.col("lo") <= F.col("p50")) & (F.col("p50") <= F.col("hi"))
    return out.select("n_rows", "cold_rows", "owned_rows", fine.alias("valid"))


@add("a13_model_round_trip", f"SELECT count(*) AS n, true AS same FROM replay WHERE ym = '{MONTHS[-1]}'")
def a13(spark, d):
    train, last = _train_last(wide(spark, d))
    path = T.scratch_path(spark, "model")
    model = _fit(lr(None), train)
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    a, b = L.add_probability(model, last, "s1"), L.add_probability(again, last, "s2")
    keys = [*G, "item_id"]
    both = a.select(*keys, "s1").join(b.select(*keys, "s2"), keys)
    return both.agg(F.count(F.lit(1)).alias("n"), (F.max(F.abs(F.col("s1") - F.col("s2"))) == 0).alias("same"))


_LAST_COUNTS = f"""(SELECT count(*) FROM replay WHERE ym = '{MONTHS[-1]}') AS n_rows,
 (SELECT count(DISTINCT user_id) FROM replay WHERE ym = '{MONTHS[-1]}') AS n_groups, (SELECT CAST(sum(label) AS BIGINT) FROM replay WHERE ym = '{MONTHS[-1]}') AS n_pos"""


def _checked(metrics):
    return metrics.select("model", "n_rows", "n_groups", "n_pos", in_unit("composite").alias("composite_ok"), in_unit("gauc").alias("gauc_ok"))


@add("r12_recipe_matrix", f"""
SELECT 'active=' || a || ',split=' || s AS model, {_LAST_COUNTS}, true AS composite_ok, true AS gauc_ok FROM (VALUES ('False'), ('True')) a(a), (VALUES ('False'), ('True')) s(s)
""")
def r12(spark, d):
    """Active-user filter on/off x expert split on/off, composite of the last month."""
    w = wide(spark, d)
    train, last = _train_last(w)
    out = None
    for active in (False, True):
        t = Rp.keep_active(train, retail.retail_view(spark, d)) if active else train
        t = Rp.weight_equal_group(t)
        for split in (False, True):
            scored = L.expert_pair(t, last, lr()) if split else L.add_probability(_fit(lr(), t), last)
            part = _metrics(scored, f"active={active},split={split}")
            out = part if out is None else out.unionByName(part)
    return _checked(out)


@add("r13_feature_ablation", f"""
SELECT m AS model, (SELECT count(*) FROM replay WHERE ym > '{MONTHS[0]}') AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT ym, user_id FROM replay WHERE ym > '{MONTHS[0]}')) AS n_groups,
 (SELECT CAST(sum(label) AS BIGINT) FROM replay WHERE ym > '{MONTHS[0]}') AS n_pos, true AS composite_ok, true AS gauc_ok FROM (VALUES ('pair columns'), ('all columns')) v(m)
""")
def r13(spark, d):
    """Same folds with fewer and with all columns."""
    w = wide(spark, d)
    a = L.out_of_fold(w, MONTHS, lr(features=FEATS[:3]), Rp.weight_equal_group)
    b = L.out_of_fold(w, MONTHS, lr(), Rp.weight_equal_group)
    return _checked(_metrics(a, "pair columns").unionByName(_metrics(b, "all columns")))
