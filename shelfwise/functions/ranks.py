"""Ranks, positions and medians that stay exact when one group holds most of the rows.

Tie rule everywhere: higher score first, then the smaller item id.

Three tools:

* ``top_k`` - only the head of each group is needed.  ``row_number <= k`` lets Spark cut
  every map partition to k rows per group before the shuffle.
* ``tie_table`` / ``average_rank`` / ``group_auc`` / ``grouped_median`` - a full ranking is
  needed.  Rows collapse to (group, value, n) first, so ties cost nothing; then the values of a
  group that has very many are cut into value ranges, each (group, range) is a window of its own
  and only one row per range is added up over the whole group.
* ``global_position`` - a dense 0-based position over the whole frame by a range sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.session import settle

#: A group with more distinct values than this is cut into value ranges of its own.
HOT_VALUES = 100_000
#: Ranges of such a group.
RANGES = 256


def top_k(df: DataFrame, by, order, k: int, rank: str = "rank") -> DataFrame:
    """First k rows of each group; the rank column starts at 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def first_rank_desc(df: DataFrame, by, score: str, tie: str, out: str) -> DataFrame:
    """Position by score desc, then tie key, for groups of candidate-list size."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn(out, F.row_number().over(w))


def _with_range(vals: DataFrame, by: list, value: str) -> DataFrame:
    """Number the value range of each row inside its group; ``vals`` has one row per (group, value).

    Only groups with more than HOT_VALUES distinct values are cut, at their own approximate quantiles, so a
    hot group whose values lie close together is spread as well.  Any boundaries give the same result.
    """
    fractions = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    keys = [F.col(k).alias(f"__h_{k}") for k in by]
    sizes = vals.groupBy(*keys).agg(F.count(F.lit(1)).alias("__c")).filter(F.col("__c") > HOT_VALUES).drop("__c")
    if by:  # the sketch reads the rows of hot groups only; with none of them, adaptive execution drops both joins
        large, names = vals.select(*keys, F.col(value).alias("__v")), [f"__h_{k}" for k in by]
        found = sizes.toDF(*[f"__s_{k}" for k in by])
        same = F.lit(True)
        for k in by:
            same = same & F.col(f"__h_{k}").eqNullSafe(F.col(f"__s_{k}"))
        hot = large.join(found, same, "left_semi").groupBy(*names).agg(
            F.array_distinct(F.percentile_approx("__v", fractions, F.lit(1000))).alias("__bounds"))
    else:
        hot = vals.agg(
            F.count(F.lit(1)).alias("__c"), F.array_distinct(F.percentile_approx(value, fractions, F.lit(1000))).alias("__bounds")
        ).filter(F.col("__c") > HOT_VALUES).drop("__c")
    if by:
        same = F.lit(True)
        for k in by:
            same = same & F.col(k).eqNullSafe(F.col(f"__h_{k}"))
        cut = vals.join(hot, same, "left").drop(*[f"__h_{k}" for k in by])
    else:
        cut = vals.withColumn("__bounds", hot.scalar())
    below = F.size(F.filter("__bounds", lambda b: b < F.col(value)))
    return cut.withColumn("__range", F.when(F.col("__bounds").isNull(), 0).otherwise(below)).drop("__bounds")


def tie_table(df: DataFrame, by, value: str, extra=()) -> DataFrame:
    """One row per (group, distinct value): n rows, and ``below`` = rows of the group with a
    smaller value.  ``extra`` adds aggregates such as the positives per value."""
    by = list(by)
    vals = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), *extra)
    vals = _with_range(vals, by, value)
    inside = (
        Window.partitionBy(*by, "__range").orderBy(value)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    vals = vals.withColumn("__in", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    before = (
        Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        vals.groupBy(*by, "__range").agg(F.sum("n").alias("__n"))
        .withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    keys = by + ["__range"]
    left, right = vals, offsets
    for k in by:
        right = right.withColumnRenamed(k, f"__o_{k}")
    right = right.withColumnRenamed("__range", "__o_range")
    cond = F.col("__range") == F.col("__o_range")
    for k in by:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__o_{k}"))
    if not by:
        right = F.broadcast(right)  # at most RANGES rows
    joined = left.join(right, cond, "inner")
    return joined.withColumn("below", F.col("__in") + F.col("__off")).drop(
        "__in", "__off", "__range", "__o_range", *[f"__o_{k}" for k in by]
    )


def average_rank(df: DataFrame, by, value: str, out: str, size: str | None = None) -> DataFrame:
    """Ascending rank with ties averaged, 1-based; optional group size column."""
    by = list(by)
    ties = tie_table(df, by, value).select(
        *[F.col(k).alias(f"__t_{k}") for k in by], F.col(value).alias("__t_value"),
        (F.col("below") + (F.col("n") + 1) / 2.0).alias(out),
    )
    cond = F.col(value).eqNullSafe(F.col("__t_value"))
    for k in by:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__t_{k}"))
    ranked = df.join(ties, cond, "left").drop("__t_value", *[f"__t_{k}" for k in by])
    if size is None:
        return ranked
    if not by:
        total = df.select(F.count(F.lit(1)).alias("c")).scalar()
        return ranked.withColumn(size, total)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias(size))
    return ranked.join(sizes, by, "left")


def percent_rank_avg(df: DataFrame, by, value: str, out: str) -> DataFrame:
    """Average rank divided by the group size (or by the row count when ``by`` is empty)."""
    ranked = average_rank(df, by, value, "__r", "__n")
    return ranked.withColumn(out, F.col("__r") / F.col("__n")).drop("__r", "__n")


def percent_rank_zero_one(df: DataFrame, by, value: str, out: str) -> DataFrame:
    """(average rank - 1) / (n - 1); a group of one row gets 0."""
    ranked = average_rank(df, by, value, "__r", "__n")
    return ranked.withColumn(
        out,
        F.when(F.col("__n") > 1, (F.col("__r") - 1.0) / (F.col("__n") - 1.0)).otherwise(F.lit(0.0)),
    ).drop("__r", "__n")


def group_auc(df: DataFrame, by, score: str, label: str = "label") -> DataFrame:
    """Per group: n, p and the exact ROC AUC (NULL when only one class is present).

    Rank sums add up range by range, so no row-level ranking is written back.
    """
    by = list(by)
    vals = df.groupBy(*by, score).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("p")
    )
    vals = _with_range(vals, by, score)
    inside = (
        Window.partitionBy(*by, "__range").orderBy(score)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    vals = vals.withColumn("__in", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    per_range = vals.groupBy(*by, "__range").agg(
        F.sum("n").alias("n"), F.sum("p").alias("p"),
        F.sum(F.col("p") * (F.col("__in") + (F.col("n") + 1) / 2.0)).alias("r"),
    )
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    per_range = per_range.withColumn("__off", F.coalesce(F.sum("n").over(before), F.lit(0)))
    total = per_range.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("p").alias("p"),
        F.sum(F.col("r") + F.col("p") * F.col("__off")).alias("r"),
    )
    neg = F.col("n") - F.col("p")
    auc = F.when(
        (F.col("p") > 0) & (neg > 0),
        (F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p") * neg),
    )
    return total.select(*by, "n", "p", auc.alias("auc"))


def grouped_median(df: DataFrame, by, value: str, out: str) -> DataFrame:
    """Exact interpolated median per group from the collapsed value counts."""
    by = list(by)
    known = df.filter(F.col(value).isNotNull())
    ties = tie_table(known, by, value)
    sizes = ties.groupBy(*by).agg(F.sum("n").alias("__total"))
    if by:
        ties = ties.join(sizes, by)
    else:
        ties = ties.withColumn("__total", sizes.scalar())
    low = F.floor((F.col("__total") + 1) / 2)
    high = F.floor(F.col("__total") / 2) + 1

    def holds(position):
        return (F.col("below") < position) & (position <= F.col("below") + F.col("n"))

    return (
        ties.filter(holds(low) | holds(high))
        .groupBy(*by)
        .agg(
            ((F.max(F.when(holds(low), F.col(value))) + F.max(F.when(holds(high), F.col(value)))) / 2.0)
            .alias(out)
        )
    )


def global_position(df: DataFrame, order, out: str) -> DataFrame:
    """0-based position over the whole frame under a total order.

    A range sort spreads the rows; the id inside a sorted partition plus the summed sizes of
    the partitions before it is the position.  The sorted rows are written to the checkpoint
    folder first, because range boundaries are sampled and must not differ between two reads.
    """
    ordered = settle(
        df.orderBy(*order)
        .withColumn("__gp_mono", F.monotonically_increasing_id())
        .withColumn("__gp_part", F.shiftrightunsigned("__gp_mono", 33))
        .withColumn("__gp_pos", F.col("__gp_mono").bitwiseAND(F.lit((1 << 33) - 1)))
    )
    before = Window.orderBy("__gp_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ordered.groupBy(F.col("__gp_part").alias("__gp_p")).agg(F.count(F.lit(1)).alias("__gp_c"))
        .withColumn("__gp_off", F.coalesce(F.sum("__gp_c").over(before), F.lit(0)))
        .drop("__gp_c")
    )  # one row per sort partition
    return (
        ordered.join(F.broadcast(offsets), F.col("__gp_part") == F.col("__gp_p"))
        .withColumn(out, F.col("__gp_off") + F.col("__gp_pos"))
        .drop("__gp_mono", "__gp_part", "__gp_pos", "__gp_p", "__gp_off")
    )
