"""R: comparison diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import scalar as S
from shelfwise.operators import baskets as B, diagnostics as D, fusion as Fu, metrics as M, serving as Sv
from shelfwise.operators.replay import as_of
from shelfwise.plans import shared
from shelfwise.plans.base import Family, cte
from shelfwise.plans.fusion import boosted
from shelfwise.plans.metrics import ALPHAS, COMP, groups_sql, r6, sweep_sql
from shelfwise.schema import CUT, MONTH_CUTS
from shelfwise.session import settle
from shelfwise.sources import retail

FAMILY = Family()
add = FAMILY.add
G = ["ym", "user_id"]
cte("pos2", """
SELECT *, row_number() OVER (PARTITION BY ym, user_id ORDER BY s_pop DESC, item_id) AS ra, row_number() OVER (PARTITION BY ym, user_id ORDER BY s_own DESC, item_id) AS rb FROM preds
""")
cte("cut_basket", """
SELECT cut, user_id, order_id, min(ts) AS bts, count(DISTINCT item_id) AS size FROM cuts JOIN tx ON ts < cut GROUP BY 1, 2, 3
""")


def preds(spark, d):
    return shared.predictions(spark, d)


@add("r01_saved_kicked", """
SELECT prior_bought, count(*) AS pos_total, count(*) FILTER (WHERE ra <= 10) AS anchor_hits, count(*) FILTER (WHERE rb <= 10) AS final_hits,
 count(*) FILTER (WHERE ra BETWEEN 11 AND 30 AND rb <= 10) AS saved, count(*) FILTER (WHERE ra <= 10 AND rb > 10) AS kicked,
 count(*) FILTER (WHERE ra BETWEEN 11 AND 30 AND rb <= 10) - count(*) FILTER (WHERE ra <= 10 AND rb > 10) AS net FROM pos2 WHERE label = 1 GROUP BY 1
""")
def r01(spark, d):
    return D.saved_kicked(preds(spark, d), "s_pop", "s_own")


@add("r02_repeat_explore", "SELECT prior_bought, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS n_pos FROM preds GROUP BY 1")
def r02(spark, d):
    return D.repeat_explore(preds(spark, d))


@add("r03_band_rates", """
SELECT ym, CASE WHEN prior_bought = 1 THEN 'repeat' ELSE 'explore' END AS bucket, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS pos,
 count(*) FILTER (WHERE label = 1 AND ra <= 10) AS pos_top10, count(*) FILTER (WHERE label = 1 AND ra BETWEEN 11 AND 30) AS pos_11_30, count(*) FILTER (WHERE label = 1 AND ra > 30) AS pos_below30,
 round(sum(label) / count(*), 6) AS pos_rate, round(count(*) FILTER (WHERE label = 1 AND ra <= 10) / nullif(sum(label), 0), 6) AS top10_hit_rate FROM pos2 GROUP BY 1, 2
""")
def r03(spark, d):
    return D.band_rates(preds(spark, d), "s_pop").withColumn("pos_rate", F.round("pos_rate", 6)).withColumn(
        "top10_hit_rate", F.round("top10_hit_rate", 6))


@add("r04_signal_density", """
SELECT CASE WHEN prior_bought = 1 THEN 'repeat' ELSE 'explore' END AS bucket, label, CASE WHEN ra <= 10 THEN 'top10' WHEN ra <= 30 THEN '11_30' ELSE 'below30' END AS band,
 count(*) AS n_rows, round(avg(CASE WHEN s_own > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS share_positive, round(avg(s_own - 0.5), 6) AS mean_signal, round(avg(prior_bought), 6) AS flag_share FROM pos2 GROUP BY ALL
""")
def r04(spark, d):
    p = preds(spark, d).withColumn("signal", F.col("s_own") - 0.5)
    out = D.signal_density(p, "s_pop", "signal", "prior_bought")
    return out.select("bucket", "label", "band", "n_rows", r6("share_positive"), r6("mean_signal"), r6("flag_share"))


def _bucket_source(dim, expr):
    return f"""(SELECT '{dim}' AS dim, {expr} AS bin, p.* FROM preds p LEFT JOIN (SELECT cut, user_id, count(*) AS hb, arg_max(size, (bts, order_id)) AS ls FROM cut_basket GROUP BY 1, 2) h
 ON h.cut = p.cut AND h.user_id = p.user_id)"""


_HB = _bucket_source("hist_baskets", "CASE WHEN hb <= 3 THEN '1-3' WHEN hb <= 8 THEN '4-8' WHEN hb <= 15 THEN '9-15' ELSE '16+' END")
_LS = _bucket_source("last_size", "CASE WHEN ls <= 1 THEN '1' WHEN ls <= 2 THEN '2' WHEN ls <= 5 THEN '3-5' WHEN ls <= 10 THEN '6-10' WHEN ls <= 30 THEN '11-30' ELSE '31+' END")


def _bucket_sql(src):
    a = f"SELECT dim, bin, CAST(sum(n) AS BIGINT) AS n_rows, count(DISTINCT user_id) AS n_users, CAST(sum(p) AS BIGINT) AS n_pos, {COMP} AS comp FROM {groups_sql('{s}', src, 'dim, bin, ym, user_id')} GROUP BY 1, 2"
    return f"""SELECT a.dim, a.bin, a.n_rows, a.n_pos, a.n_users, round(a.comp, 6) AS anchor_comp, round(b.comp, 6) AS final_comp, round(b.comp - a.comp, 6) AS d_comp
FROM ({a.replace('{s}', 's_pop')}) a JOIN ({a.replace('{s}', 's_own')}) b ON a.dim = b.dim AND a.bin = b.bin WHERE a.n_users >= 5"""


@add("r05_history_buckets", _bucket_sql(_HB) + " UNION ALL " + _bucket_sql(_LS))
def r05(spark, d):
    rows = as_of(B.basket_rows(retail.retail_view(spark, d)), MONTH_CUTS)
    out = D.bucket_metrics(preds(spark, d), D.user_history(rows), "s_pop", "s_own")
    return out.select("dim", "bin", "n_rows", "n_pos", "n_users", r6("anchor_comp"), r6("final_comp"), r6("d_comp"))


@add("r06_basket_dominance", """
SELECT * FROM (
WITH b AS (SELECT order_id, count(DISTINCT item_id) AS size FROM hist GROUP BY 1), w AS (SELECT size, 1 / sqrt(CAST(greatest(size - 1, 1) AS DOUBLE)) AS w, row_number() OVER (ORDER BY 1 / sqrt(CAST(greatest(size - 1, 1) AS DOUBLE)) DESC, size) AS r FROM b)
SELECT quantile_cont(size, 0.5) AS q50, round(quantile_cont(size, 0.9), 6) AS q90, round(quantile_cont(size, 0.99), 6) AS q99, count(*) AS n_baskets,
 round(sum(CASE WHEN r <= greatest(1, floor((SELECT count(*) FROM w) * 0.01)) THEN w ELSE 0 END) / sum(w), 6) AS top_weight_share FROM w)
""")
def r06(spark, d):
    h = retail.retail_view(spark, d).filter(F.col("ts") < S.at(CUT))
    return D.basket_dominance(B.basket_table(h)).select("q50", r6("q90"), r6("q99"), "n_baskets", r6("top_weight_share"))


@add("r07_exclusive_seats", """
SELECT CASE WHEN ra <= 10 THEN 'a' ELSE 'b' END AS side, count(*) AS n_seats, round(avg(prior_bought), 6) AS owned_share, round(avg(ln(1 + u.units)), 6) AS mean_log_units
FROM pos2 JOIN (SELECT item_id, sum(qty) AS units FROM tx GROUP BY 1) u USING (item_id) WHERE (ra <= 10) <> (rb <= 10) GROUP BY 1
""")
def r07(spark, d):
    units = retail.retail_view(spark, d).groupBy("item_id").agg(F.sum("qty").alias("units"))
    return D.exclusive_seats(preds(spark, d), "s_pop", "s_own", units).select("side", "n_seats", r6("owned_share"), r6("mean_log_units"))


@add("r08_menu_displacement", """
SELECT * FROM (
WITH v AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE), (1, 0.25::DOUBLE), (2, 0.75::DOUBLE), (3, 1.0::DOUBLE)) z(k, w)),
s AS (SELECT k, ym, user_id, item_id FROM (SELECT v.k, p.ym, p.user_id, p.item_id, 0.0::DOUBLE + v.w * p.s_pop + (1.0 - v.w) * p.s_own AS sc FROM preds p, v)
 QUALIFY row_number() OVER (PARTITION BY k, ym, user_id ORDER BY sc DESC, item_id) <= 10),
d AS (SELECT a.k AS ka, b.k AS kb, sum(CASE WHEN NOT EXISTS (SELECT 1 FROM s t WHERE t.k = b.k AND t.ym = a.ym AND t.user_id = a.user_id AND t.item_id = a.item_id) THEN 1 ELSE 0 END) AS n
 FROM s a, v b GROUP BY 1, 2)
SELECT v.w AS weight, CAST((SELECT sum(n) FROM d WHERE (ka = v.k AND kb = v.k - 1) OR (ka = v.k - 1 AND kb = v.k)) AS BIGINT) AS vs_previous,
 CAST((SELECT sum(n) FROM d WHERE (ka = v.k AND kb = 0) OR (ka = 0 AND kb = v.k)) AS BIGINT) AS vs_b, CAST((SELECT sum(n) FROM d WHERE (ka = v.k AND kb = 3) OR (ka = 3 AND kb = v.k)) AS BIGINT) AS vs_a
FROM v WHERE v.k IN (1, 2))
""")
def r08(spark, d):
    return D.menu_displacement(preds(spark, d), "s_pop", "s_own", [0.25, 0.75])


@add("r09_boost_swaps", """
SELECT * FROM (
WITH b AS (SELECT p.*, s.item_id IS NOT NULL AS f, s_pop + CASE WHEN s.item_id IS NULL THEN 0.0::DOUBLE ELSE 0.1::DOUBLE END AS bo FROM preds p LEFT JOIN seasonal s ON s.item_id = p.item_id),
r AS (SELECT *, row_number() OVER (PARTITION BY ym, user_id ORDER BY s_pop DESC, item_id) <= 10 AS o, row_number() OVER (PARTITION BY ym, user_id ORDER BY bo DESC, item_id) <= 10 AS n FROM b)
SELECT count(*) FILTER (WHERE n AND NOT o) AS swapped, count(*) FILTER (WHERE n AND NOT o AND f) AS flagged_in, count(*) FILTER (WHERE o AND NOT n AND f) AS flagged_out FROM r)
""")
def r09(spark, d):
    return D.flagged_swaps(boosted(spark, d), "s_pop", "boosted", "flag")


def _signals(spark, d, schemes):
    """Candidates at one cut with the last-basket similarity of several schemes side by side."""
    tx = retail.retail_view(spark, d)
    base = preds(spark, d).filter(F.col("ym") == "2001-06").select("ym", "cut", "user_id", "item_id", "label", "s_pop")
    base, rows = settle(base), settle(as_of(B.basket_rows(tx), [CUT]))
    out = base
    for s in schemes:
        f = B.basket_features(base.select("cut", "user_id", "item_id"), rows, B.item_similarity(rows, s))
        out = out.join(f.select("user_id", "item_id", F.round("sim_last3_mean", 8).alias(s)), ["user_id", "item_id"])
    return out


cte("sig", """
SELECT p.ym, p.cut, p.user_id, p.item_id, p.label, p.s_pop, round(f.sim_last3_mean, 8) AS cos_bigbasket, round(g.sim_last3_mean, 8) AS hg_linear
FROM preds p JOIN bfeat f ON f.user_id = p.user_id AND f.item_id = p.item_id JOIN hgfeat g ON g.user_id = p.user_id AND g.item_id = p.item_id WHERE p.ym = '2001-06'
""")
cte("hgw", "SELECT user_id || '|' || order_id AS b, item_id, 1 / sqrt(size) AS w FROM bk")
cte("hgs", """
SELECT c.i, c.j, c.c / sqrt(x.d * y.d) AS sim FROM (SELECT x.item_id AS i, y.item_id AS j, sum(x.w * y.w) AS c FROM hgw x JOIN hgw y ON x.b = y.b AND x.item_id <> y.item_id GROUP BY 1, 2) c
JOIN (SELECT item_id, sum(w * w) AS d FROM hgw GROUP BY 1) x ON x.item_id = c.i JOIN (SELECT item_id, sum(w * w) AS d FROM hgw GROUP BY 1) y ON y.item_id = c.j
""")
cte("hgfeat", """
SELECT c.user_id, c.item_id, coalesce(avg(mx), 0) AS sim_last3_mean FROM cand c LEFT JOIN (
 SELECT c.user_id, c.item_id, r.ar, max(CASE WHEN k.item_id = c.item_id THEN 1 ELSE coalesce(s.sim, 0) END) AS mx FROM cand c JOIN brecent r ON r.user_id = c.user_id
 JOIN bk k ON k.user_id = r.user_id AND k.order_id = r.order_id LEFT JOIN hgs s ON s.i = c.item_id AND s.j = k.item_id GROUP BY 1, 2, 3) p ON p.user_id = c.user_id AND p.item_id = c.item_id GROUP BY 1, 2
""")


@add("r10_scheme_ablation", """
SELECT round(corr(cos_bigbasket, hg_linear), 6) AS correlation, round(avg(CASE WHEN cos_bigbasket > 0 THEN 1.0 ELSE 0.0 END), 6) AS share_main, round(avg(CASE WHEN hg_linear > 0 THEN 1.0 ELSE 0.0 END), 6) AS share_other FROM sig
""")
def r10(spark, d):
    s = _signals(spark, d, ["cos_bigbasket", "hg_linear"])
    return s.agg(F.round(F.corr("cos_bigbasket", "hg_linear"), 6).alias("correlation"),
                 F.round(F.avg((F.col("cos_bigbasket") > 0).cast("double")), 6).alias("share_main"),
                 F.round(F.avg((F.col("hg_linear") > 0).cast("double")), 6).alias("share_other"))


@add("r10_scheme_sweep", " UNION ALL ".join(
    f"SELECT '{s}' AS scheme, alpha, round({COMP}, 6) AS composite FROM {sweep_sql(s, source='sig')} GROUP BY 2" for s in ("cos_bigbasket", "hg_linear")))
def r10b(spark, d):
    """Composite per alpha of the anchor plus each scheme's group percentile."""
    s = settle(_signals(spark, d, ["cos_bigbasket", "hg_linear"]))
    out = None
    for scheme in ("cos_bigbasket", "hg_linear"):
        part = Fu.alpha_sweep(Fu.add_residual(s, scheme), "s_pop", ALPHAS).withColumn("scheme", F.lit(scheme))
        out = part if out is None else out.unionByName(part)
    return out.select("scheme", "alpha", r6("composite"))


#: Alphas of the reference; alpha* is chosen in the select month and confirmed in the next.
ALL_ALPHAS = [0.0, 0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.07, 0.1, 0.15, 0.2, 0.3, 0.5, 0.75, 1.0]
SELECT_MONTH, CONFIRM_MONTH = "2001-06", "2001-07"
cte("msig", """
SELECT f.scheme, p.ym, p.user_id, p.item_id, p.label, p.s_pop, round(f.sim_last3_mean, 8) AS signal FROM preds p JOIN mfeat f ON f.cut = p.cut AND f.user_id = p.user_id AND f.item_id = p.item_id
""", once=True)
_MSIG = "(SELECT * FROM msig WHERE scheme = '{}')"
cte("mgroups", " UNION ALL ".join(
    f"SELECT '{s}' AS scheme, * FROM {sweep_sql('signal', source=_MSIG.format(s), values=ALL_ALPHAS)}" for s in B.SCHEMES), once=True)
cte("msweep", f"""
SELECT scheme, alpha, ym, {COMP} AS composite FROM mgroups GROUP BY 1, 2, 3 UNION ALL SELECT scheme, alpha, 'all', {COMP} FROM mgroups GROUP BY 1, 2
""", once=True)


def _all_signals(spark, d):
    """Candidates of all months with the last-baskets similarity of every scheme, long form, stored."""
    def build():
        base = preds(spark, d).select("ym", "cut", "user_id", "item_id", "label", "s_pop")
        rows = settle(as_of(B.basket_rows(retail.retail_view(spark, d)), MONTH_CUTS))
        means = B.scheme_means(base, rows, B.scheme_similarities(rows))
        long = F.explode(F.array(*[F.struct(F.lit(s).alias("scheme"), F.round(s, 8).alias("signal")) for s in B.SCHEMES]))
        return means.select(*base.columns, long.alias("s")).select("s.scheme", *base.columns, "s.signal")

    return shared.stored(spark, d, "signals", build)


def _all_sweeps(signals):
    """Composite per scheme, alpha and month, and over all months (``all``)."""
    ranked = Fu.add_residual(signals, "signal", ["scheme", *G])
    groups = settle(Fu.alpha_groups(ranked, "s_pop", ALL_ALPHAS, by=["scheme", *G]))
    months = M.composite(groups, by=["scheme", "alpha", "ym"])
    every = M.composite(groups, by=["scheme", "alpha"]).withColumn("ym", F.lit("all"))
    columns = ["scheme", "alpha", "ym", "composite"]
    return months.select(*columns).unionByName(every.select(*columns))


@add("r10_all_schemes_sweep", "SELECT scheme, alpha, ym, round(composite, 6) AS composite FROM msweep")
def r10c(spark, d):
    return _all_sweeps(_all_signals(spark, d)).select("scheme", "alpha", "ym", r6("composite"))


@add("r10_all_schemes_ablation", f"""
SELECT b.scheme, b.alpha, round(sa.composite, 6) AS select_anchor, round(sf.composite, 6) AS select_final, round(sf.composite - sa.composite, 6) AS select_gain,
 round(ca.composite, 6) AS confirm_anchor, round(cf.composite, 6) AS confirm_final, round(cf.composite - ca.composite, 6) AS confirm_gain, round(k.c, 6) AS corr_with_main
FROM (SELECT scheme, alpha FROM msweep WHERE ym = '{SELECT_MONTH}' QUALIFY row_number() OVER (PARTITION BY scheme ORDER BY round(composite, 9) DESC NULLS LAST, alpha) = 1) b
JOIN msweep sa ON sa.scheme = b.scheme AND sa.ym = '{SELECT_MONTH}' AND sa.alpha = 0 JOIN msweep sf ON sf.scheme = b.scheme AND sf.ym = '{SELECT_MONTH}' AND sf.alpha = b.alpha
JOIN msweep ca ON ca.scheme = b.scheme AND ca.ym = '{CONFIRM_MONTH}' AND ca.alpha = 0 JOIN msweep cf ON cf.scheme = b.scheme AND cf.ym = '{CONFIRM_MONTH}' AND cf.alpha = b.alpha
JOIN (SELECT s.scheme, corr(m.signal, s.signal) AS c FROM msig s JOIN msig m ON m.scheme = 'cos_bigbasket' AND m.ym = s.ym AND m.user_id = s.user_id AND m.item_id = s.item_id WHERE s.signal > 0 GROUP BY 1) k ON k.scheme = b.scheme
""")
def r10d(spark, d):
    """Per scheme: alpha* of the select month, gains of select and confirm month, correlation with the main scheme where positive."""
    signals = _all_signals(spark, d)
    sweep = settle(_all_sweeps(signals).where(F.col("ym").isin(SELECT_MONTH, CONFIRM_MONTH)))
    chosen = sweep.where(F.col("ym") == SELECT_MONTH).groupBy("scheme").agg(
        F.max_by("alpha", F.struct(F.round("composite", 9), -F.col("alpha"))).alias("best"))
    at = lambda ym, a: F.max(F.when((F.col("ym") == ym) & (F.col("alpha") == a), F.col("composite")))
    gains = sweep.join(chosen, "scheme").groupBy("scheme").agg(
        F.first("best").alias("alpha"), at(SELECT_MONTH, 0.0).alias("select_anchor"), at(SELECT_MONTH, F.col("best")).alias("select_final"),
        at(CONFIRM_MONTH, 0.0).alias("confirm_anchor"), at(CONFIRM_MONTH, F.col("best")).alias("confirm_final"))
    main = signals.where("scheme = 'cos_bigbasket'").select(*G, "item_id", F.col("signal").alias("main"))
    corr = signals.where("signal > 0").join(main, [*G, "item_id"]).groupBy("scheme").agg(F.corr("main", "signal").alias("corr_with_main"))
    out = gains.withColumn("select_gain", F.col("select_final") - F.col("select_anchor")).withColumn(
        "confirm_gain", F.col("confirm_final") - F.col("confirm_anchor")).join(corr, "scheme")
    return out.select("scheme", "alpha", *[r6(c) for c in ("select_anchor", "select_final", "select_gain", "confirm_anchor", "confirm_final", "confirm_gain", "corr_with_main")])


@add("r11_scheme_comparison", """
SELECT * FROM (
WITH r AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY s_rec) + (count(*) OVER (PARTITION BY ym, user_id, s_rec) - 1) / 2.0 AS x FROM preds WHERE false),
k AS (SELECT *, rank() OVER (PARTITION BY ym, user_id ORDER BY s_rec) + (count(*) OVER (PARTITION BY ym, user_id, s_rec) - 1) / 2.0 AS ka, rank() OVER (PARTITION BY ym, user_id ORDER BY s_pop) + (count(*) OVER (PARTITION BY ym, user_id, s_pop) - 1) / 2.0 AS kb,
 row_number() OVER (PARTITION BY ym, user_id ORDER BY s_rec DESC, item_id) AS pa, row_number() OVER (PARTITION BY ym, user_id ORDER BY s_pop DESC, item_id) AS pb FROM preds),
g AS (SELECT corr(ka, kb) AS c FROM k GROUP BY ym, user_id HAVING count(*) >= 3 AND count(DISTINCT s_rec) > 1 AND count(DISTINCT s_pop) > 1),
o AS (SELECT count(*) FILTER (WHERE pa <= 10 AND pb <= 10) / least(10, count(*)) AS o FROM k GROUP BY ym, user_id)
SELECT round((SELECT corr(s_rec, s_pop) FROM preds), 6) AS pearson, round((SELECT avg(c) FROM g), 6) AS mean_spearman, (SELECT count(*) FROM g) AS n_groups, round((SELECT avg(o) FROM o), 6) AS top_overlap)
""".replace("""WITH r AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY s_rec) + (count(*) OVER (PARTITION BY ym, user_id, s_rec) - 1) / 2.0 AS x FROM preds WHERE false),
k AS""", "WITH k AS"))
def r11(spark, d):
    return D.scheme_comparison(preds(spark, d), "s_rec", "s_pop").select(r6("pearson"), r6("mean_spearman"), "n_groups", r6("top_overlap"))


@add("r14_score_summary", """
SELECT count(*) AS n_rows, round(min(s), 6) AS lo, round(avg(s), 6) AS mean, round(median(s), 6) AS p50, round(max(s), 6) AS hi,
 count(*) FILTER (WHERE ku IS NULL OR ki IS NULL) AS cold_rows, count(ow) AS owned_rows
FROM (SELECT ln(1 + length(c.item_id) + c.user_id % 7) AS s, u.user_id AS ku, i.item_id AS ki, o.item_id AS ow FROM cand c LEFT JOIN (SELECT DISTINCT user_id FROM fut) u ON u.user_id = c.user_id
 LEFT JOIN (SELECT DISTINCT item_id FROM fut) i ON i.item_id = c.item_id LEFT JOIN hpairs o ON o.user_id = c.user_id AND o.item_id = c.item_id)
""")
def r14(spark, d):
    tx = retail.retail_view(spark, d)
    known, own = tx.filter(F.col("ts") >= S.at(CUT)), tx.filter(F.col("ts") < S.at(CUT))
    scored = retail.candidate_pairs(spark, d).withColumn("s", F.log1p(F.length("item_id") + F.col("user_id") % 7))
    out = Sv.score_summary(scored, "s", known, known, own)
    return out.select("n_rows", r6("lo"), r6("mean"), r6("p50"), r6("hi"), "cold_rows", "owned_rows")
