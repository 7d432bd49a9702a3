"""As-of snapshots at several cuts, candidate replay, labels, folds and sample weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import scalar as S


def as_of(df: DataFrame, cuts, ts: str = "ts") -> DataFrame:
    """One copy of a row for every cut after it.  The cuts sit in an array literal, so this is
    a row-local explode and no range join."""
    later = F.filter(F.array(*[S.at(c) for c in cuts]), lambda c: c > F.col(ts))
    return df.filter(F.col(ts) < S.at(max(cuts))).withColumn("cut", F.explode(later))


def label_window(df: DataFrame, cuts, months: int = 1, ts: str = "ts") -> DataFrame:
    """Distinct (cut, user, item) bought in [cut, cut + months)."""
    inside = F.filter(
        F.array(*[S.at(c) for c in cuts]),
        lambda c: (c <= F.col(ts)) & (F.add_months(c, months).cast("timestamp_ntz") > F.col(ts)),
    )
    return (
        df.filter(F.col(ts) >= S.at(min(cuts)))
        .withColumn("cut", F.explode(inside)).select("cut", "user_id", "item_id").distinct()
    )


def known_candidates(cand: DataFrame, hist: DataFrame) -> DataFrame:
    """Candidates whose user and item both appear before the cut (``hist`` carries ``cut``)."""
    users = hist.select("cut", "user_id").distinct()
    items = hist.select("cut", "item_id").distinct()
    return cand.join(users, "user_id").join(items, ["cut", "item_id"], "left_semi")


def replay(tx: DataFrame, cand: DataFrame, cuts) -> DataFrame:
    """Candidate rows per cut with label, prior purchase and first-purchase flags.

    A candidate meets the first sale of its item, then it and the order lines are dealt by user once. One row per
    (user, item) holds what it has for each cut; the cuts are spelled out last, so no shuffle carries a row per cut, and
    the rows stay dealt by user.
    """
    lines = tx.filter(F.col("user_id").isNotNull()).select("user_id", "item_id", "order_id", "ts")
    first_sale = tx.groupBy("item_id").agg(F.min("ts").alias("item_first"))
    wanted = cand.join(first_sale, "item_id").filter(F.col("user_id").isNotNull())
    kind = {c: lines.schema[c].dataType for c in ("order_id", "ts", "user_id")}
    none = {c: F.lit(None).cast(kind[c]) for c in ("order_id", "ts")}
    dealt = wanted.select(
        F.col("user_id").cast(kind["user_id"]).alias("user_id"), "item_id", none["order_id"].alias("order_id"), none["ts"].alias("ts"),
        "item_first").unionByName(lines.withColumn("item_first", F.lit(None).cast(kind["ts"]))).repartition("user_id")

    def bought(cut):  # as in label_window
        return (F.col("ts") >= S.at(cut)) & (F.add_months(S.at(cut), 1).cast("timestamp_ntz") > F.col("ts"))

    cuts = list(cuts)
    per_order = dealt.groupBy("user_id", "item_id", "order_id", F.col("item_first").isNotNull().alias("__cand")).agg(
        F.min("ts").alias("first"), F.min("item_first").alias("item_first"), F.count("item_first").alias("copies"),
        *[F.max(bought(c)).alias(f"l{i}") for i, c in enumerate(cuts)])
    per_pair = per_order.groupBy("user_id", "item_id").agg(
        F.min("first").alias("first"), F.min("item_first").alias("item_first"), F.sum("copies").alias("copies"),
        *[F.max(f"l{i}").alias(f"l{i}") for i in range(len(cuts))],
        *[F.sum(((F.col("first") < S.at(c)) & F.col("order_id").isNotNull()).cast("bigint")).alias(f"n{i}") for i, c in enumerate(cuts)])
    known = per_pair.withColumn("user_first", F.min("first").over(Window.partitionBy("user_id"))).filter(F.col("copies") > 0)
    at_cut = F.array(*[F.struct(
        S.at(c).alias("cut"), F.coalesce(F.col(f"l{i}"), F.lit(False)).alias("bought"),
        F.coalesce(F.col("first") < S.at(c), F.lit(False)).alias("prior"),
        F.coalesce(F.col(f"n{i}"), F.lit(0)).cast("bigint").alias("n_ord")) for i, c in enumerate(cuts)])
    live = F.filter(at_cut, lambda e: (e["cut"] > F.col("user_first")) & (e["cut"] > F.col("item_first")))
    rows = known.select("user_id", "item_id", F.explode(
        F.flatten(F.transform(F.sequence(F.lit(1), F.col("copies")), lambda _: live))).alias("e"))
    return rows.select(
        F.col("e.cut").alias("cut"), "user_id", "item_id", S.month_key("e.cut").alias("ym"),
        F.col("e.bought").cast("int").alias("label"), F.col("e.prior").cast("int").alias("prior_bought"),
        (F.col("e.bought") & ~F.col("e.prior")).cast("int").alias("new_combo"), F.col("e.n_ord").alias("n_ord"))


def with_item_history(rows: DataFrame, tx: DataFrame, cuts) -> DataFrame:
    """Adds buyers and last sale before the cut."""
    item = as_of(tx, cuts).groupBy("cut", "item_id").agg(
        F.count_distinct("user_id").alias("buyers"), F.max("ts").alias("last_ts"))
    return rows.join(item, ["cut", "item_id"])


def replay_gate(rows: DataFrame) -> DataFrame:
    """Samples, positives, rate and new pairs per month plus a total row (month NULL)."""
    return rows.rollup("ym").agg(
        F.count(F.lit(1)).alias("samples"), F.sum("label").alias("positives"),
        F.sum("new_combo").alias("new_pairs"),
    ).withColumn("rate", F.col("positives") / F.col("samples"))


def monthly_pairs(tx: DataFrame) -> DataFrame:
    return tx.select(S.month_key("ts").alias("ym"), "user_id", "item_id").distinct()


def two_month_labels(tx: DataFrame, cuts) -> DataFrame:
    """Pairs bought in the month of the cut or the one after."""
    return label_window(tx, cuts, months=2)


def forward_folds(months, first: int = 1, last_k: int | None = None) -> list[tuple[str, list[str]]]:
    """(target month, training months) pairs, expanding or limited to the last k months."""
    out = []
    for i in range(first, len(months)):
        train = months[:i] if last_k is None else months[max(0, i - last_k):i]
        out.append((months[i], list(train)))
    return out


def fold_rows(rows: DataFrame, months, last_k: int | None = None) -> DataFrame:
    """Rows tagged with every target month they train for, and the month gap.

    The fold table is an array literal per month, so no join is needed.
    """
    idx = {m: i for i, m in enumerate(months)}
    pairs = [(t, m, idx[t] - idx[m]) for t, train in forward_folds(months, last_k=last_k) for m in train]
    table = F.array(*[F.struct(F.lit(t).alias("target"), F.lit(m).alias("m"), F.lit(g).alias("gap")) for t, m, g in pairs])
    hits = F.filter(table, lambda e: e["m"] == F.col("ym"))
    return rows.withColumn("__f", F.explode(hits)).select(
        "*", F.col("__f.target").alias("target"), F.col("__f.gap").alias("gap")).drop("__f")


def active_user_months(tx: DataFrame) -> DataFrame:
    return tx.select("user_id", S.month_key("ts").alias("ym")).distinct()


def keep_active(rows: DataFrame, tx: DataFrame) -> DataFrame:
    """Rows of users who bought anything in the row's month."""
    return rows.join(active_user_months(tx), ["user_id", "ym"], "left_semi")


def _with_group_count(rows: DataFrame, by, out: str) -> DataFrame:
    """Row count of the group on every row: an aggregate plus join, so that a hot group is
    counted by partial sums and the join can be split. Counts by more keys meet the rows on the first one, as a map by
    the others: rows dealt by it already are not dealt again."""
    first, *rest = by
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias(out))
    if not rest:
        return rows.join(counts, first)
    known = F.col(first).isNotNull()
    for c in rest:
        known = known & F.col(c).isNotNull()
    maps = counts.filter(known).groupBy(first).agg(
        F.map_from_entries(F.collect_list(F.struct(F.struct(*rest), out))).alias("__by"))
    return rows.filter(known).join(maps, first).withColumn(out, F.col("__by")[F.struct(*rest)]).drop("__by")


def class_ratio(rows: DataFrame):
    """Negatives over positives as a scalar column."""
    return rows.agg((F.sum(1 - F.col("label")) / F.sum("label")).alias("r")).scalar()


def weight_macro(rows: DataFrame) -> DataFrame:
    return _with_group_count(rows, ["user_id"], "__n").withColumn("weight", 1 / F.sqrt("__n")).drop("__n")


def weight_scale_pos(rows: DataFrame, base=None) -> DataFrame:
    base = F.lit(1.0) if base is None else base
    return rows.withColumn("weight", F.when(F.col("label") == 1, base * class_ratio(rows)).otherwise(base))


def weight_macro_scaled(rows: DataFrame) -> DataFrame:
    out = weight_macro(rows)
    return out.withColumn(
        "weight", F.when(F.col("label") == 1, F.col("weight") * class_ratio(rows)).otherwise(F.col("weight")))


def weight_equal_group(rows: DataFrame) -> DataFrame:
    return _with_group_count(rows, ["user_id", "ym"], "__n").withColumn("weight", 1 / F.col("__n")).drop("__n")


def weight_group_power(rows: DataFrame, alpha: float) -> DataFrame:
    """n to the power of -alpha, n = rows of the user in the month."""
    return _with_group_count(rows, ["user_id", "ym"], "__n").withColumn(
        "weight", F.pow(F.col("__n").cast("double"), F.lit(-alpha))).drop("__n")


def weight_power(rows: DataFrame, alpha: float) -> DataFrame:
    return rows.withColumn(
        "weight", F.when(F.col("label") == 1, F.pow(class_ratio(rows), F.lit(alpha))).otherwise(F.lit(1.0)))


def weight_decay(rows: DataFrame, alpha: float) -> DataFrame:
    """exp(-alpha * month gap); ``rows`` come from ``fold_rows``."""
    return rows.withColumn("weight", F.exp(-F.lit(alpha) * F.col("gap")))


def weight_balanced(rows: DataFrame) -> DataFrame:
    counts = rows.agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")
    ).select(F.struct(
        (F.col("n") / (2 * F.col("p"))).alias("w1"), (F.col("n") / (2 * (F.col("n") - F.col("p")))).alias("w0")
    ).alias("s")).scalar()
    return rows.withColumn("__s", counts).withColumn(
        "weight", F.when(F.col("label") == 1, F.col("__s.w1")).otherwise(F.col("__s.w0"))).drop("__s")


def split_by_prior(rows: DataFrame, flag: str = "prior_bought") -> tuple[DataFrame, DataFrame]:
    """(first-purchase rows, repurchase rows)."""
    return rows.filter(F.col(flag) == 0), rows.filter(F.col(flag) == 1)
