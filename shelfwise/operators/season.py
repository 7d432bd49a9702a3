"""Seasonality diagnostics: one peak month against the months around it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import scalar as S

# Keyword patterns for seasonal goods.
WIDE_KEYWORDS = (
    "CHRISTMAS|XMAS|SANTA|MERRY|FESTIVE|STOCKING|ANGEL|SNOW|TREE|WRAP|DECORAT|CARD|NOVELTY"
)
NARROW_KEYWORDS = "CHRISTMAS|XMAS"
# Lift buckets as (low, high, label), low included.
LIFT_BUCKETS = [
    (0.0, 0.5, "<0.5"), (0.5, 1.5, "0.5-1.5"), (1.5, 3.0, "1.5-3"), (3.0, None, ">=3"),
]
LIFT_THRESHOLDS = [1.5, 2.0, 3.0]


def monthly_volume(df: DataFrame) -> DataFrame:
    return df.filter(F.col("qty") > 0).groupBy(S.month_key("ts").alias("month")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("qty").alias("units"),
        F.count_distinct("user_id").alias("users"), F.count_distinct("item_id").alias("items"),
    )


def peak_ratio(df: DataFrame, peak: str, rest) -> DataFrame:
    """Peak-month rows and units over the mean of the other months."""
    m = monthly_volume(df)
    is_peak, is_rest = F.col("month") == peak, F.col("month").isin(list(rest))
    return m.agg(
        (F.max(F.when(is_peak, F.col("n_rows"))) / F.avg(F.when(is_rest, F.col("n_rows")))).alias("ratio_rows"),
        (F.max(F.when(is_peak, F.col("units"))) / F.avg(F.when(is_rest, F.col("units")))).alias("ratio_units"),
    )


def item_lift(df: DataFrame, peak: str, rest) -> DataFrame:
    """Per item: peak units, mean monthly units of the other months, and their ratio."""
    rest = list(rest)
    m = S.month_key("ts")
    return (
        df.filter((F.col("qty") > 0) & m.isin([peak] + rest))
        .groupBy("item_id")
        .agg(
            F.sum(F.when(m == peak, F.col("qty")).otherwise(0.0)).alias("peak_units"),
            F.sum(F.when(m != peak, F.col("qty")).otherwise(0.0)).alias("rest_units"),
        )
        .withColumn("rest_monthly", F.col("rest_units") / F.lit(float(len(rest))))
        .withColumn("lift", S.ratio("peak_units", "rest_monthly", 1e-9))
    )


def stable_lift(lift: DataFrame, min_monthly: float = 2.0) -> DataFrame:
    return lift.filter(F.col("rest_monthly") >= min_monthly)


def lift_shares(lift: DataFrame, thresholds=LIFT_THRESHOLDS) -> DataFrame:
    """Items over each threshold and their share of peak and other units; one pass."""
    aggs = []
    for i, t in enumerate(thresholds):
        hi = F.col("lift") >= t
        aggs += [
            F.sum(hi.cast("bigint")).alias(f"n{i}"),
            F.sum(F.when(hi, F.col("peak_units")).otherwise(0.0)).alias(f"p{i}"),
            F.sum(F.when(hi, F.col("rest_units")).otherwise(0.0)).alias(f"r{i}"),
        ]
    one = lift.agg(F.sum("peak_units").alias("peak"), F.sum("rest_units").alias("rest"), *aggs)
    rows = F.array(*[
        F.struct(F.lit(t).alias("threshold"), F.col(f"n{i}").alias("n_items"),
                 (F.col(f"p{i}") / F.greatest(F.col("peak"), F.lit(1e-9))).alias("peak_share"),
                 (F.col(f"r{i}") / F.greatest(F.col("rest"), F.lit(1e-9))).alias("rest_share"))
        for i, t in enumerate(thresholds)
    ])
    return one.select(F.inline(rows))


def first_descr(df: DataFrame) -> DataFrame:
    return df.groupBy("item_id").agg(F.min_by("descr", F.struct("ts", "order_id", "line_no")).alias("descr"))


def lift_bucket(c="lift"):
    out = F.lit(LIFT_BUCKETS[-1][2])
    for _lo, hi, label in reversed(LIFT_BUCKETS[:-1]):
        out = F.when(F.col(c) < hi, F.lit(label)).otherwise(out)
    return out


def keyword_share(lift: DataFrame, descr: DataFrame, pattern: str = WIDE_KEYWORDS) -> DataFrame:
    """Share of keyword items in each lift bucket."""
    return (
        lift.join(descr, "item_id", "left")
        .groupBy(lift_bucket().alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n_items"),
             F.avg(S.has_keyword("descr", pattern).cast("double")).alias("keyword_share"))
    )


def keyword_month_profile(df: DataFrame, descr: DataFrame, pattern: str, min_units: float = 50.0) -> DataFrame:
    """Units per month of keyword items with enough units, share of the total, peak month."""
    units = df.filter(F.col("qty") > 0).groupBy("item_id").agg(F.sum("qty").alias("u"))
    chosen = (
        descr.filter(S.has_keyword("descr", pattern)).join(units.filter(F.col("u") >= min_units), "item_id")
        .select("item_id")
    )
    prof = (
        df.filter(F.col("qty") > 0).join(chosen, "item_id", "left_semi")
        .groupBy(S.month_key("ts").alias("month")).agg(F.sum("qty").alias("units"))
    )
    total = prof.agg(F.sum("units").alias("t")).scalar()
    best = prof.agg(F.max(F.struct("units", "month")).getField("month").alias("m")).scalar()
    return prof.select("month", "units", (F.col("units") / total).alias("share"),
                       (F.col("month") == best).alias("is_peak"))


def candidate_coverage(cand: DataFrame, lift: DataFrame, peak_pairs: DataFrame) -> DataFrame:
    """How much of the candidate set is high-lift or was bought in the peak month."""
    tagged = (
        cand.join(lift.select("item_id", "lift"), "item_id", "left")
        .join(peak_pairs.select("user_id", "item_id").distinct().withColumn("peak", F.lit(1)),
              ["user_id", "item_id"], "left")
    )
    per_user = tagged.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("lift").isNotNull().cast("bigint")).alias("known"),
        F.sum(F.coalesce(F.col("lift") >= 2.0, F.lit(False)).cast("bigint")).alias("hi2"),
        F.sum(F.coalesce(F.col("lift") >= 3.0, F.lit(False)).cast("bigint")).alias("hi3"),
        F.sum(F.coalesce(F.col("peak"), F.lit(0))).alias("peak"),
    )
    return per_user.agg(
        F.sum("n").alias("n_pairs"), F.sum("known").alias("n_known"), F.sum("hi2").alias("n_lift2"),
        F.sum("hi3").alias("n_lift3"), F.avg(F.col("hi2") / F.col("n")).alias("mean_user_share"),
        F.sum((F.col("hi2") > 0).cast("bigint")).alias("users_with_lift2"),
        F.sum("peak").alias("n_peak_pairs"), F.sum((F.col("peak") > 0).cast("bigint")).alias("users_with_peak"),
    )
