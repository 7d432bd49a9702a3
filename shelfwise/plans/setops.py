"""F: sort, limit, top-k, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import ranks as R
from shelfwise.functions import scalar as S
from shelfwise.operators import fusion
from shelfwise.plans import shared
from shelfwise.plans.base import Family
from shelfwise.schema import CUT
from shelfwise.sources import retail

FAMILY = Family()
add = FAMILY.add


def tx(spark, d, **kw):
    return retail.retail_view(spark, d, **kw)


@add("f01_global_top_k", "SELECT item_id, sum(qty) AS units FROM tx GROUP BY 1 ORDER BY units DESC, item_id LIMIT 100")
def f01(spark, d):
    return tx(spark, d).groupBy("item_id").agg(F.sum("qty").alias("units")).orderBy(F.col("units").desc(), "item_id").limit(100)


@add("f02_group_top_k", """
SELECT ym, user_id, item_id, CAST(r AS INTEGER) AS r FROM (SELECT *, row_number() OVER (PARTITION BY ym, user_id ORDER BY s_own DESC, item_id) AS r FROM preds) WHERE r <= 10
""")
def f02(spark, d):
    return R.top_k(shared.predictions(spark, d), ["ym", "user_id"], [F.col("s_own").desc(), F.col("item_id")], 10, "r").select(
        "ym", "user_id", "item_id", "r")


@add("f03_multi_key_sort", """
SELECT user_id, CAST(ts AS DATE) AS day, order_id, item_id, count(*) AS n FROM tx GROUP BY ALL ORDER BY user_id, day, order_id, item_id
""")
def f03(spark, d):
    return tx(spark, d).groupBy("user_id", F.to_date("ts").alias("day"), "order_id", "item_id").agg(
        F.count(F.lit(1)).alias("n")).orderBy("user_id", "day", "order_id", "item_id")


@add("f04_union_labelled", """
SELECT 'hist' AS part, user_id, item_id, count(*) AS n FROM hist GROUP BY ALL UNION ALL SELECT 'label', user_id, item_id, count(*) FROM fut GROUP BY ALL
""")
def f04(spark, d):
    def side(name, cond):
        return tx(spark, d).filter(cond).groupBy(F.lit(name).alias("part"), "user_id", "item_id").agg(F.count(F.lit(1)).alias("n"))

    return side("hist", F.col("ts") < S.at(CUT)).unionByName(side("label", F.col("ts") >= S.at(CUT)))


@add("f05_distinct_pairs", "SELECT user_id, item_id FROM pairs")
def f05(spark, d):
    return tx(spark, d).select("user_id", "item_id").dropDuplicates()


@add("f06_intersect_except", """
SELECT 'both' AS part, * FROM (SELECT user_id, item_id FROM hist INTERSECT SELECT user_id, item_id FROM fut)
UNION ALL SELECT 'new', * FROM (SELECT user_id, item_id FROM fut EXCEPT SELECT user_id, item_id FROM hist)
""")
def f06(spark, d):
    h = tx(spark, d).filter(F.col("ts") < S.at(CUT)).select("user_id", "item_id")
    f = tx(spark, d).filter(F.col("ts") >= S.at(CUT)).select("user_id", "item_id")
    both = h.intersect(f).withColumn("part", F.lit("both"))
    return both.unionByName(f.subtract(h).withColumn("part", F.lit("new"))).select("part", "user_id", "item_id")


@add("f07_top_seat_difference", """
SELECT * FROM (
WITH a AS (SELECT ym, user_id, item_id FROM preds QUALIFY row_number() OVER (PARTITION BY ym, user_id ORDER BY s_own DESC, item_id) <= 10),
b AS (SELECT ym, user_id, item_id FROM preds QUALIFY row_number() OVER (PARTITION BY ym, user_id ORDER BY s_pop DESC, item_id) <= 10)
SELECT coalesce(a.ym, b.ym) AS ym, coalesce(a.user_id, b.user_id) AS user_id, count(*) FILTER (WHERE b.item_id IS NULL) AS only_a,
 count(*) FILTER (WHERE a.item_id IS NULL) AS only_b FROM a FULL JOIN b ON a.ym = b.ym AND a.user_id = b.user_id AND a.item_id = b.item_id GROUP BY 1, 2)
""")
def f07(spark, d):
    return fusion.seat_difference(shared.predictions(spark, d), ["ym", "user_id"], "s_own", "s_pop", 10)
