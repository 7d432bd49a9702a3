"""Cleaning stages, funnel, strict clean and the clean report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import scalar as S
from shelfwise.schema import SERVICE_CODES

AUDIT_PATTERN = "bank charge|adjust|postage|test"  # fixed value: audit keywords


def has_user():
    return F.col("user_id").isNotNull()


def is_sale():
    """Not a cancelled invoice and not a known non-positive quantity; NULLs pass."""
    return ~S.is_cancelled("invoice_no") & ~F.coalesce(F.col("qty") <= 0, F.lit(False))


def has_price():
    return F.coalesce(F.col("unit_price") > 0, F.lit(False))


def drop_null_user(df: DataFrame) -> DataFrame:
    return df.filter(has_user())


def drop_cancelled(df: DataFrame) -> DataFrame:
    return df.filter(is_sale())


def drop_bad_price(df: DataFrame) -> DataFrame:
    return df.filter(has_price())


def clean(df: DataFrame) -> DataFrame:
    return df.filter(has_user() & is_sale() & has_price())


def cleaning_funnel(df: DataFrame) -> DataFrame:
    """Rows before, removed and after each stage from one pass over the data."""
    s1, s2, s3 = has_user(), has_user() & is_sale(), has_user() & is_sale() & has_price()
    counts = df.agg(
        F.count(F.lit(1)).alias("n0"),
        *[F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).alias(n) for c, n in ((s1, "n1"), (s2, "n2"), (s3, "n3"))],
    )
    stages = F.array(*[
        F.struct(F.lit(name).alias("stage"), F.col(b).alias("rows_before"), F.col(a).alias("rows_after"),
                 F.col("n0").alias("total"))
        for name, b, a in (
            ("stage1_drop_missing_customer", "n0", "n1"),
            ("stage2_drop_cancellations", "n1", "n2"),
            ("stage3_drop_invalid_price", "n2", "n3"),
        )
    ])
    return counts.select(F.explode(stages).alias("s")).select(
        "s.stage", "s.rows_before",
        (F.col("s.rows_before") - F.col("s.rows_after")).alias("rows_removed"),
        "s.rows_after",
        ((F.col("s.rows_before") - F.col("s.rows_after")) / F.col("s.rows_before")).alias("removed_ratio"),
        (F.col("s.rows_after") / F.col("s.total")).alias("cum_retention"),
    )


def dedup_and_drop_services(df: DataFrame, codes=SERVICE_CODES) -> DataFrame:
    """Whole-row duplicates first, then the service codes."""
    return (
        df.dropDuplicates()
        .withColumn("item_id", F.trim("item_id"))
        .filter(S.not_service("item_id", codes))
    )


def service_audit(df: DataFrame, codes=SERVICE_CODES) -> DataFrame:
    """Removed service rows, distinct codes, and how many carry an audit keyword."""
    removed = df.dropDuplicates().filter(~S.not_service("item_id", codes))
    return removed.agg(
        F.count(F.lit(1)).alias("removed_rows"),
        F.count_distinct(F.trim("item_id")).alias("removed_codes"),
        F.coalesce(
            F.sum(F.lower(F.coalesce("descr", F.lit(""))).rlike(AUDIT_PATTERN).cast("bigint")), F.lit(0)
        ).alias("keyword_rows"),
    )


def strict_clean(df: DataFrame) -> DataFrame:
    """NULL user, cancelled, non-positive quantity or price, blank item and bad time go; then
    whole-row duplicates.  Service codes stay."""
    keep = (
        has_user()
        & ~F.coalesce(F.col("invoice_no").startswith("C"), F.lit(False))
        & (F.col("qty") > 0) & (F.col("unit_price") > 0)
        & (F.coalesce(F.trim("item_id"), F.lit("")) != "")
        & F.expr("try_cast(ts AS timestamp)").isNotNull()
    )
    return df.filter(keep).dropDuplicates()


def clean_report(df: DataFrame, codes=SERVICE_CODES) -> DataFrame:
    """Counts, time range, distinct keys and invariants of the cleaned frame."""
    return dedup_and_drop_services(df, codes).agg(
        F.count(F.lit(1)).alias("clean_rows"),
        F.to_date(F.min("ts")).alias("first_day"), F.to_date(F.max("ts")).alias("last_day"),
        F.count_distinct("user_id").alias("users"), F.count_distinct("item_id").alias("items"),
        F.count_distinct("invoice_no").alias("orders"),
        (F.sum(F.col("user_id").isNull().cast("bigint")) == 0).alias("no_null_user"),
        F.coalesce(F.bool_and(F.coalesce(F.col("qty") > 0, F.lit(False))), F.lit(True)).alias("qty_positive"),
        F.coalesce(F.bool_and(F.coalesce(F.col("unit_price") > 0, F.lit(False))), F.lit(True)).alias("price_positive"),
        F.coalesce(F.bool_or(F.col("item_id").isin(list(codes))), F.lit(False)).alias("service_left"),
    )
