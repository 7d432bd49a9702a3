"""P: evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import ranks as R
from shelfwise.operators import fusion as Fu, metrics as M, recall as Rc
from shelfwise.plans import shared
from shelfwise.plans.base import Family
from shelfwise.plans.recall import split
from shelfwise.sources import retail

FAMILY = Family()
add = FAMILY.add
G = ["ym", "user_id"]


def r6(c, name=None):
    return F.round(c, 6).alias(name or c)


def groups_sql(score: str, source: str = "preds", by: str = "ym, user_id") -> str:
    """Per-group metrics in SQL: windows over the whole group."""
    return f"""(SELECT {by}, n, p, CASE WHEN p > 0 AND n > p THEN (sr - p * (p + 1) / 2.0) / (p * (n - p)) END AS auc,
 CASE WHEN p > 0 THEN dcg / list_sum(list_transform(range(1, CAST(least(p, 10) AS BIGINT) + 1), lambda i: log2(i + 1))) END AS ndcg,
 CASE WHEN p > 0 THEN dcg / list_sum(list_transform(range(1, CAST(least(p, 10) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))) END AS ndcg_std,
 CASE WHEN p > 0 THEN hits / p END AS recall, hits, CASE WHEN p > 0 THEN h5 END AS h5 FROM (
 SELECT {by}, count(*) AS n, sum(label) AS p, sum(label * ar) AS sr, sum(CASE WHEN rd <= 10 AND label = 1 THEN 1 / log2(rd + 1) ELSE 0 END) AS dcg,
  sum(CASE WHEN rd <= 10 THEN label ELSE 0 END) AS hits, sum(CASE WHEN rd <= 5 THEN label ELSE 0 END) AS h5 FROM (
  SELECT *, rank() OVER (PARTITION BY {by} ORDER BY sc) + (count(*) OVER (PARTITION BY {by}, sc) - 1) / 2.0 AS ar,
   row_number() OVER (PARTITION BY {by} ORDER BY sc DESC, item_id) AS rd FROM (SELECT *, {score} AS sc FROM {source})) GROUP BY {by}))"""


COMP = "0.4 * avg(auc) + 0.4 * avg(ndcg) + 0.2 * avg(recall)"


@add("p01_topk_metrics", """
SELECT count(*) AS n_users, round(avg(h5 / 5.0), 6) AS precision_5, round(avg(h5 / size), 6) AS recall_5, round(avg(CASE WHEN h5 > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_5,
 round(avg(h10 / 10.0), 6) AS precision_10, round(avg(h10 / size), 6) AS recall_10, round(avg(CASE WHEN h10 > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_10
FROM (SELECT u.user_id, z.size, count(b.item_id) FILTER (WHERE r.rank <= 5) AS h5, count(b.item_id) FILTER (WHERE r.rank <= 10) AS h10 FROM tusers u JOIN bsize z USING (user_id)
 LEFT JOIN r_pop r ON r.user_id = u.user_id LEFT JOIN basket b ON b.user_id = r.user_id AND b.item_id = r.item_id GROUP BY 1, 2)
""")
def p01(spark, d):
    train, test = split(spark, d)
    own = Rc.owned_items(train)
    out = M.list_metrics(Rc.popular_route(Rc.popularity(train), own, own, 10), test, users=own)
    return out.select("n_users", *[r6(c) for c in out.columns if c != "n_users"])


@add("p02_pool_metrics", f"""
SELECT count(*) AS n_groups, round(avg(CASE WHEN h5 > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_5, round(avg(h5 / least(5, n)), 6) AS prec_5, round(avg(h5 / p), 6) AS rec_5,
 round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_10, round(avg(hits / least(10, n)), 6) AS prec_10, round(avg(hits / p), 6) AS rec_10 FROM {groups_sql('s_pop')} WHERE p > 0
""")
def p02(spark, d):
    out = M.pool_metrics(shared.predictions(spark, d), "s_pop", by=G)
    return out.select("n_groups", *[r6(c) for c in out.columns if c != "n_groups"])


@add("p03_jaccard_coverage", f"""
SELECT count(*) AS n_groups, round(avg(hits / (least(10, n) + p - hits)), 6) AS jaccard,
 round((SELECT count(DISTINCT item_id) FROM (SELECT item_id FROM preds QUALIFY row_number() OVER (PARTITION BY ym, user_id ORDER BY s_pop DESC, item_id) <= 10)) / (SELECT count(DISTINCT item_id) FROM preds), 6) AS coverage
FROM {groups_sql('s_pop')} WHERE p > 0
""")
def p03(spark, d):
    return M.jaccard_coverage(shared.predictions(spark, d), "s_pop", by=G).select("n_groups", r6("jaccard"), r6("coverage"))


@add("p04_ndcg_standard", f"SELECT ym, user_id, round(ndcg_std, 6) AS ndcg FROM {groups_sql('s_own')}")
def p04(spark, d):
    return M.group_metrics(shared.predictions(spark, d), "s_own", idcg="standard").select(*G, r6("ndcg"))


@add("p05_pooled_auc", """
SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS p, round((sum(label * ar) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label)), 6) AS auc
FROM (SELECT label, rank() OVER (ORDER BY s_rec) + (count(*) OVER (PARTITION BY s_rec) - 1) / 2.0 AS ar FROM preds)
""")
def p05(spark, d):
    return M.pooled_auc(shared.predictions(spark, d), "s_rec").withColumn("auc", F.round("auc", 6))


@add("p06_group_auc", f"SELECT ym, user_id, n, round(auc, 6) AS auc FROM {groups_sql('s_rec')}")
def p06(spark, d):
    return R.group_auc(shared.predictions(spark, d), G, "s_rec").select(*G, "n", r6("auc"))


@add("p06_group_auc_means", f"""
SELECT round(avg(auc), 6) AS gauc_macro, round(sum(auc * n) / sum(CASE WHEN auc IS NOT NULL THEN n END), 6) AS gauc_weighted FROM {groups_sql('s_rec')}
""")
def p06b(spark, d):
    return R.group_auc(shared.predictions(spark, d), G, "s_rec").agg(*M.auc_aggregates()).select(r6("gauc_macro"), r6("gauc_weighted"))


@add("p07_ndcg_reference", f"SELECT ym, user_id, round(ndcg, 6) AS ndcg FROM {groups_sql('s_own')}")
def p07(spark, d):
    return M.group_metrics(shared.predictions(spark, d), "s_own").select(*G, r6("ndcg"))


@add("p08_group_recall", f"SELECT ym, user_id, round(recall, 6) AS recall FROM {groups_sql('s_own')}")
def p08(spark, d):
    return M.group_metrics(shared.predictions(spark, d), "s_own").select(*G, r6("recall"))


@add("p09_composite", f"SELECT round({COMP}, 6) AS composite, round(avg(auc), 6) AS gauc, round(avg(ndcg), 6) AS ndcg, round(avg(recall), 6) AS recall FROM {groups_sql('s_own')}")
def p09(spark, d):
    return M.composite(M.group_metrics(shared.predictions(spark, d), "s_own")).select(*[r6(c) for c in ("composite", "gauc", "ndcg", "recall")])


@add("p10_monthly_composite", f"""
SELECT ym, round({COMP}, 6) AS composite, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_groups, CAST(sum(p) AS BIGINT) AS n_pos FROM {groups_sql('s_own')} GROUP BY ym
""")
def p10(spark, d):
    return M.monthly_composite(shared.predictions(spark, d), "s_own").select("ym", r6("composite"), "n_rows", "n_groups", "n_pos")


_W = {"m": "avg({c})", "w": "sum({c} * n) / sum(CASE WHEN {c} IS NOT NULL THEN n END)"}
_VAR = " UNION ALL ".join(
    f"SELECT '{a}{b}{c}' AS variant, round(0.4 * {_W[a].format(c='auc')} + 0.4 * {_W[b].format(c='ndcg')} + 0.2 * {_W[c].format(c='recall')}, 6) AS composite FROM g"
    for a in "mw" for b in "mw" for c in "mw")


@add("p11_aggregation_variants", f"SELECT * FROM (WITH g AS (SELECT * FROM {groups_sql('s_own')}) {_VAR})")
def p11(spark, d):
    return M.aggregation_variants(M.group_metrics(shared.predictions(spark, d), "s_own")).withColumn("composite", F.round("composite", 6))


def _month_sql(score):
    return f"(SELECT ym, {COMP} AS comp FROM {groups_sql(score)} GROUP BY ym)"


@add("p12_monthly_gain", f"""
SELECT a.ym, round(a.comp, 6) AS anchor_comp, round(b.comp, 6) AS final_comp, round(b.comp - a.comp, 6) AS d_comp FROM {_month_sql('s_pop')} a JOIN {_month_sql('s_own')} b USING (ym)
""")
def p12(spark, d):
    return M.monthly_gain(shared.predictions(spark, d), "s_pop", "s_own").select("ym", r6("anchor_comp"), r6("final_comp"), r6("d_comp"))


@add("p13_reproduction_check", """SELECT DISTINCT ym, CASE WHEN ym = '2001-06' THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END AS diff_composite, ym <> '2001-06' AS reproduced FROM preds""")
def p13(spark, d):
    """The stored table is written first, with one month changed, then compared with a fresh computation."""
    from shelfwise.sources import transactions as T

    table = M.monthly_composite(shared.predictions(spark, d), "s_own").select("ym", "composite")
    path = T.scratch_path(spark, "stored-metrics")
    changed = F.when(F.col("ym") == "2001-06", F.col("composite") + 0.01).otherwise(F.col("composite"))
    table.withColumn("composite", changed).write.parquet(path)
    return M.reproduction_check(table, spark.read.parquet(path), ["ym"], ["composite"]).withColumn(
        "diff_composite", F.round("diff_composite", 9))


ALPHAS = [0.0, 0.05, 0.2]


def sweep_sql(resid: str, anchor: str = "s_pop", source: str = "preds", values=None) -> str:
    """Composite per (alpha, month) of anchor + alpha * group percentile of the residual."""
    alphas = ", ".join(f"({a}::DOUBLE)" for a in values or ALPHAS)
    src = f"""(SELECT a.alpha, q.*, q.{anchor} + a.alpha * q.rp AS fin FROM (VALUES {alphas}) a(alpha), (
 SELECT *, CASE WHEN gn > 1 THEN (r0 - 1.0) / (gn - 1.0) ELSE 0.0 END AS rp FROM (SELECT *, rank() OVER (PARTITION BY ym, user_id ORDER BY {resid}) + (count(*) OVER (PARTITION BY ym, user_id, {resid}) - 1) / 2.0 AS r0,
  count(*) OVER (PARTITION BY ym, user_id) AS gn FROM {source})) q)"""
    return groups_sql("fin", src, "alpha, ym, user_id")


@add("p14_adoption", f"""
SELECT * FROM (
WITH t AS (SELECT 's_rec' AS candidate, alpha, ym, {COMP} AS c FROM {sweep_sql('s_rec')} GROUP BY 2, 3
 UNION ALL SELECT 's_own', alpha, ym, {COMP} FROM {sweep_sql('s_own')} GROUP BY 2, 3),
b AS (SELECT candidate, alpha, c, (SELECT c FROM t z WHERE z.candidate = t.candidate AND z.ym = '2001-05' AND z.alpha = 0) AS base FROM t WHERE ym = '2001-05'
 QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY c DESC, alpha) = 1)
SELECT b.candidate, b.alpha, round(b.c - b.base, 6) AS gain_select, round(f.c - z.c, 6) AS gain_confirm, b.c - b.base >= 0 AND f.c - z.c >= 5e-4 AS adopt
FROM b JOIN t f ON f.candidate = b.candidate AND f.alpha = b.alpha AND f.ym = '2001-06' JOIN t z ON z.candidate = b.candidate AND z.alpha = 0 AND z.ym = '2001-06')
""")
def p14(spark, d):
    preds = shared.predictions(spark, d)
    table = None
    for resid in ("s_rec", "s_own"):
        part = Fu.alpha_sweep(Fu.add_residual(preds, resid), "s_pop", ALPHAS, by=["ym"]).withColumn("candidate", F.lit(resid))
        table = part if table is None else table.unionByName(part)
    table = table.persist()
    out = M.adoption(table.filter(F.col("ym") == "2001-05"), table.filter(F.col("ym") == "2001-06"))
    return out.select("candidate", "alpha", r6("gain_select"), r6("gain_confirm"), "adopt")
