"""M: sampling, splitting, labels, replay and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import scalar as S
from shelfwise.operators import replay as Rp, sampling as Sa
from shelfwise.plans import shared
from shelfwise.plans.base import Family, cte
from shelfwise.schema import CUT, MONTH_CUTS
from shelfwise.sources import retail

FAMILY = Family()
add = FAMILY.add

cte("elig", "SELECT user_id FROM hist GROUP BY 1 HAVING count(DISTINCT order_id) >= 2")
cte("pos_new", "SELECT user_id, item_id FROM fpairs WHERE user_id IN (SELECT user_id FROM elig) EXCEPT SELECT user_id, item_id FROM hist")
cte("pos_all", "SELECT user_id, item_id FROM fpairs WHERE user_id IN (SELECT user_id FROM elig)")
_RING = """
SELECT item_id, row_number() OVER (ORDER BY md5(item_id || '-42-ring'), item_id) - 1 AS idx, (
  SELECT min(k) FROM range(2000000) t(k) WHERE k >= greatest(2, (SELECT count(DISTINCT item_id) FROM {src}))
  AND k < (SELECT count(DISTINCT item_id) FROM {src}) + 400
  AND NOT EXISTS (SELECT 1 FROM range(2, 1500) f(f) WHERE f.f * f.f <= k AND k % f.f = 0)) AS sz
FROM (SELECT DISTINCT item_id FROM {src})"""
cte("ring", _RING.format(src="hist"))
cte("ring_all", _RING.format(src="tx"))


def _draw(need, excluded, ring="ring"):
    """Step at which a user's walk reaches an item: (place - start) times the inverse of the stride, found by listing steps."""
    hashed = "('0x' || substr(md5(n.user_id || '-42-{}'), 1, 7))::BIGINT"
    return f"""SELECT user_id, item_id FROM (SELECT w.user_id, r.item_id, w.n, row_number() OVER (PARTITION BY w.user_id ORDER BY w.p) AS k
 FROM (SELECT n.user_id, n.n, t.p, ({hashed.format('start')} % z.sz + t.p * ({hashed.format('stride')} % (z.sz - 1) + 1)) % z.sz AS idx
  FROM {need} n, (SELECT DISTINCT sz FROM {ring}) z, (SELECT unnest(range((SELECT max(sz) FROM {ring}))) AS p) t) w
 JOIN {ring} r ON r.idx = w.idx
 WHERE NOT EXISTS (SELECT 1 FROM {excluded} x WHERE x.user_id = w.user_id AND x.item_id = r.item_id)) WHERE k <= n"""


cte("neg_new", _draw("(SELECT user_id, count(*) * 3 AS n FROM pos_new GROUP BY 1)", "pairs"))
cte("own_need", "SELECT user_id, count(*) * 3 AS need FROM pos_all GROUP BY 1")
cte("own_neg", """
SELECT o.user_id, o.item_id FROM (SELECT user_id, item_id FROM hpairs EXCEPT SELECT user_id, item_id FROM pos_all) o JOIN own_need n USING (user_id)
QUALIFY row_number() OVER (PARTITION BY o.user_id ORDER BY md5(o.user_id || '-' || o.item_id || '-42')) <= round_even(0.125::DOUBLE * n.need, 0)
""")
cte("own_or_pos", "SELECT user_id, item_id FROM hpairs UNION SELECT user_id, item_id FROM pos_all")
cte("fresh_neg", _draw("(SELECT d.user_id, need - coalesce(t, 0) AS n FROM own_need d LEFT JOIN (SELECT user_id, count(*) AS t FROM own_neg GROUP BY 1) q ON q.user_id = d.user_id)", "own_or_pos"))
cte("splits", """
SELECT user_id, row_number() OVER (ORDER BY md5(user_id || '-42'), user_id) <= round_even(0.3::DOUBLE * count(*) OVER (), 0) AS is_valid FROM (SELECT DISTINCT user_id FROM tx)
""")
cte("pool_users", "SELECT DISTINCT user_id FROM fpairs")
cte("pool_neg", _draw("(SELECT user_id, 200 AS n FROM pool_users)", "fpairs", "ring_all"))


def parts(spark, d):
    t = retail.retail_view(spark, d)
    hist, label = t.filter(F.col("ts") < S.at(CUT)), t.filter(F.col("ts") >= S.at(CUT))
    return t, hist, label, hist.select("item_id").distinct()


@add("m01_eligible_users", "SELECT user_id, count(DISTINCT order_id) AS n_orders FROM hist GROUP BY 1 HAVING count(DISTINCT order_id) >= 2")
def m01(spark, d):
    return Sa.eligible_users(parts(spark, d)[1])


@add("m02_first_purchases", "SELECT * FROM pos_new")
def m02(spark, d):
    _, h, f, _ = parts(spark, d)
    return Sa.positives_first(h, f)


@add("m03_negatives", "SELECT * FROM neg_new")
def m03(spark, d):
    t, h, f, cat = parts(spark, d)
    return Sa.negatives(Sa.positives_first(h, f).persist(), t.select("user_id", "item_id"), cat)


@add("m04_positives_with_repeats", "SELECT * FROM pos_all")
def m04(spark, d):
    _, h, f, _ = parts(spark, d)
    return Sa.positives_all(h, f)


def _stratified(spark, d):
    _, h, f, cat = parts(spark, d)
    pos = Sa.positives_all(h, f).persist()
    return pos, Sa.stratified_negatives(pos, h, cat)


@add("m05_stratified_negatives", "SELECT user_id, item_id, 'owned' AS stratum FROM own_neg UNION ALL SELECT user_id, item_id, 'fresh' FROM fresh_neg")
def m05(spark, d):
    return _stratified(spark, d)[1]


@add("m06_pair_dataset", """
SELECT count(DISTINCT user_id) AS n_users, (SELECT count(*) FROM pos_all) AS pos_n, (SELECT count(*) FROM own_neg) + (SELECT count(*) FROM fresh_neg) AS neg_n FROM pos_all
""")
def m06(spark, d):
    pos, neg = _stratified(spark, d)
    return Sa.pair_stats(Sa.labelled_pairs(pos, neg))


@add("m07_user_split", "SELECT user_id, is_valid FROM splits")
def m07(spark, d):
    return Sa.user_split(retail.retail_view(spark, d))


@add("m08_evaluation_pool", "SELECT user_id, item_id, 1 AS label FROM fpairs UNION ALL SELECT user_id, item_id, 0 FROM pool_neg")
def m08(spark, d):
    t, _, f, _ = parts(spark, d)
    return Sa.evaluation_pool(f, f, t.select("item_id").distinct())


@add("m09_candidate_replay", "SELECT ym, user_id, item_id, label, prior_bought FROM replay")
def m09(spark, d):
    return shared.replay_rows(spark, d).select("ym", "user_id", "item_id", "label", "prior_bought")


@add("m10_new_combo", "SELECT ym, user_id, item_id, new_combo FROM replay WHERE label = 1")
def m10(spark, d):
    return shared.replay_rows(spark, d).filter(F.col("label") == 1).select("ym", "user_id", "item_id", "new_combo")


@add("m11_replay_gate", """
SELECT ym, count(*) AS samples, CAST(sum(label) AS BIGINT) AS positives, CAST(sum(new_combo) AS BIGINT) AS new_pairs, round(sum(label) / count(*), 6) AS rate FROM replay GROUP BY ROLLUP (ym)
""")
def m11(spark, d):
    return Rp.replay_gate(shared.replay_rows(spark, d)).withColumn("rate", F.round("rate", 6))


@add("m12_two_month_labels", """
SELECT DISTINCT strftime(cut, '%Y-%m') AS ym, user_id, item_id FROM cuts JOIN tx ON ts >= cut AND ts < cut + INTERVAL 2 MONTH
""")
def m12(spark, d):
    return Rp.two_month_labels(retail.retail_view(spark, d), MONTH_CUTS).select(S.month_key("cut").alias("ym"), "user_id", "item_id")


@add("m12_monthly_pairs", "SELECT DISTINCT strftime(ts, '%Y-%m') AS ym, user_id, item_id FROM tx")
def m12b(spark, d):
    return Rp.monthly_pairs(retail.retail_view(spark, d))


MONTHS = [f"{c:%Y-%m}" for c in MONTH_CUTS]
_FOLD = """SELECT t.ym AS target, r.ym, CAST(t.k - s.k AS INTEGER) AS gap, count(*) AS n FROM replay r JOIN ({m}) s ON s.ym = r.ym JOIN ({m}) t ON t.k > s.k {extra} GROUP BY 1, 2, 3"""
_MON = "SELECT ym, row_number() OVER (ORDER BY ym) AS k FROM (SELECT DISTINCT ym FROM replay)"


@add("m13_forward_folds", _FOLD.format(m=_MON, extra=""))
def m13(spark, d):
    return Rp.fold_rows(shared.replay_rows(spark, d), MONTHS).groupBy("target", "ym", "gap").agg(F.count(F.lit(1)).alias("n"))


@add("m14_last_k_months", _FOLD.format(m=_MON, extra="AND t.k - s.k <= 2"))
def m14(spark, d):
    return Rp.fold_rows(shared.replay_rows(spark, d), MONTHS, last_k=2).groupBy("target", "ym", "gap").agg(F.count(F.lit(1)).alias("n"))


@add("m15_extended_months", """
SELECT strftime(c.cut, '%Y-%m') AS ym, count(*) AS samples FROM (SELECT unnest(generate_series(TIMESTAMP '2000-12-01', TIMESTAMP '2001-07-01', INTERVAL 1 MONTH)) AS cut) c, cand d
WHERE EXISTS (SELECT 1 FROM (SELECT user_id, min(ts) AS a FROM tx GROUP BY 1) u WHERE u.user_id = d.user_id AND u.a < c.cut)
AND EXISTS (SELECT 1 FROM (SELECT item_id, min(ts) AS a FROM tx GROUP BY 1) u WHERE u.item_id = d.item_id AND u.a < c.cut) GROUP BY 1
""")
def m15(spark, d):
    from datetime import datetime

    cuts = [datetime(2000, 12, 1), datetime(2001, 1, 1), datetime(2001, 2, 1), *MONTH_CUTS]
    rows = Rp.replay(retail.retail_view(spark, d), retail.candidate_pairs(spark, d), cuts)
    return rows.groupBy("ym").agg(F.count(F.lit(1)).alias("samples"))


@add("m16_active_user_months", """
SELECT ym, user_id, count(*) AS n FROM replay r WHERE EXISTS (SELECT 1 FROM tx t WHERE t.user_id = r.user_id AND strftime(t.ts, '%Y-%m') = r.ym) GROUP BY 1, 2
""")
def m16(spark, d):
    counts = shared.replay_rows(spark, d).groupBy("ym", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return Rp.keep_active(counts, retail.retail_view(spark, d))  # a user's month is kept or dropped whole


_RATIO = "(SELECT sum(1 - label) / sum(label) FROM replay)"


def _weight(name, fn, expr):
    @add(name, f"SELECT ym, user_id, item_id, round({expr}, 6) AS weight FROM replay")
    def run(spark, d):
        return fn(shared.replay_rows(spark, d)).select("ym", "user_id", "item_id", F.round("weight", 6).alias("weight"))


_MACRO = "1 / sqrt(count(*) OVER (PARTITION BY user_id))"
_weight("m17_weight_macro", Rp.weight_macro, _MACRO)
_weight("m18_weight_scale_pos", Rp.weight_scale_pos, f"CASE WHEN label = 1 THEN {_RATIO} ELSE 1.0 END")
_weight("m18_weight_macro_scaled", Rp.weight_macro_scaled, f"{_MACRO} * CASE WHEN label = 1 THEN {_RATIO} ELSE 1.0 END")
_weight("m19_weight_equal_group", Rp.weight_equal_group, "1.0 / count(*) OVER (PARTITION BY ym, user_id)")
_weight("m20_weight_power", lambda r: Rp.weight_power(r, 0.5), f"CASE WHEN label = 1 THEN pow({_RATIO}, 0.5) ELSE 1.0 END")
_weight("m22_weight_balanced", Rp.weight_balanced, "count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY label))")


@add("m21_weight_decay", f"""
SELECT t.ym AS target, r.ym, round(exp(-0.3 * (t.k - s.k)), 6) AS weight, count(*) AS n FROM replay r JOIN ({_MON}) s ON s.ym = r.ym JOIN ({_MON}) t ON t.k > s.k GROUP BY ALL
""")
def m21(spark, d):
    rows = Rp.weight_decay(Rp.fold_rows(shared.replay_rows(spark, d), MONTHS), 0.3)
    return rows.groupBy("target", "ym", F.round("weight", 6).alias("weight")).agg(F.count(F.lit(1)).alias("n"))


@add("m23_prior_split", "SELECT CASE WHEN prior_bought = 1 THEN 'repeat' ELSE 'first' END AS part, ym, count(*) AS n, CAST(sum(label) AS BIGINT) AS pos FROM replay GROUP BY 1, 2")
def m23(spark, d):
    first, again = Rp.split_by_prior(shared.replay_rows(spark, d))
    both = first.withColumn("part", F.lit("first")).unionByName(again.withColumn("part", F.lit("repeat")))
    return both.groupBy("part", "ym").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"))
