"""Point-in-time features.  Every frame carries ``cut``; only rows before it are used.

History is reduced once to order-level and time-level pair events; user, item and pair columns
are roll-ups of those two tables.  Pair rows then pick their columns up by equi-joins, so a
user or item that is unknown before the cut ends with zeros.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise import schema as C
from shelfwise.functions import ranks as R
from shelfwise.functions import scalar as S
from shelfwise.operators import tiles as T
from shelfwise.operators.replay import as_of

CYCLE_RECENT_DAYS = 45
NN_K = 20


@dataclass
class Categories:
    """Collapsed categories: raw label map and bucket table with spend, share and ordinal."""

    raw_map: DataFrame
    buckets: DataFrame
    by: list

    def of_items(self, items: DataFrame, products: DataFrame) -> DataFrame:
        """Adds ``collapsed`` to a frame with item_id (and ``by``)."""
        raw = products.select("item_id", raw_category("category").alias("category"))
        tagged = items.join(raw, "item_id", "left").withColumn(
            "category", F.coalesce("category", F.lit(C.UNLABELLED_CATEGORY)))
        out = tagged.join(self.raw_map, self.by + ["category"], "left")
        return out.withColumn("collapsed", F.coalesce("collapsed", F.lit(C.OTHER_CATEGORY))).drop("category")


def raw_category(c):
    text = F.trim(F.coalesce(F.col(c), F.lit("")))
    return F.when(text == "", F.lit(C.UNLABELLED_CATEGORY)).otherwise(text)


def window_split(tx: DataFrame, cut) -> tuple[DataFrame, DataFrame]:
    return tx.filter(F.col("ts") < S.at(cut)), tx.filter(F.col("ts") >= S.at(cut))


def history(tx: DataFrame, cuts) -> DataFrame:
    """Rows before each cut with ``cut``, spend and whole-day age."""
    return as_of(tx, cuts).withColumn("spend", F.col("qty") * F.col("unit_price")).withColumn(
        "age", S.whole_days("ts", F.col("cut")))


def collapse_categories(hist: DataFrame, products: DataFrame, top_n: int = 9, by=()) -> Categories:
    """Keep the top-n raw categories by revenue, fold the rest and the unlabelled into one."""
    by = list(by)
    spend = hist.groupBy(*by, "item_id").agg(F.sum(F.col("qty") * F.col("unit_price")).alias("spend"))
    raw = products.select("item_id", raw_category("category").alias("category")).dropDuplicates(["item_id"])
    per_raw = (
        spend.join(raw, "item_id", "left")
        .withColumn("category", F.coalesce("category", F.lit(C.UNLABELLED_CATEGORY)))
        .groupBy(*by, "category").agg(F.sum("spend").alias("spend"))
    )
    fixed = F.col("category").isin(C.OTHER_CATEGORY, C.UNLABELLED_CATEGORY)
    w = Window.partitionBy(*by, fixed).orderBy(F.col("spend").desc(), "category")
    ranked = per_raw.withColumn("__rk", F.row_number().over(w)).withColumn(
        "collapsed",
        F.when(~fixed & (F.col("__rk") <= top_n), F.col("category")).otherwise(F.lit(C.OTHER_CATEGORY)))
    buckets = ranked.groupBy(*by, "collapsed").agg(F.sum("spend").alias("bucket_spend"))
    wb = Window.partitionBy(*by)
    buckets = buckets.withColumn(
        "bucket_share", F.col("bucket_spend") / F.sum("bucket_spend").over(wb)
    ).withColumn(
        "cat_code_ordinal", (F.row_number().over(wb.orderBy(F.col("bucket_spend").desc(), "collapsed")) - 1).cast("double")
    )
    return Categories(ranked.select(*by, "category", "collapsed"), buckets, by)


# ------------------------------------------------------------------ event tables
def pair_orders(hist: DataFrame) -> DataFrame:
    """One row per (cut, user, item, order)."""
    return hist.groupBy("cut", "user_id", "item_id", "order_id").agg(
        F.sum("qty").alias("qty"), F.sum("spend").alias("spend"), F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"), F.min("age").alias("min_age"), F.max("age").alias("max_age"))


def pair_history(orders: DataFrame) -> DataFrame:
    """One row per (cut, user, item)."""
    return orders.groupBy("cut", "user_id", "item_id").agg(
        F.count(F.lit(1)).alias("n_ord"), F.sum("qty").alias("qty"), F.sum("spend").alias("spend"),
        F.min("min_age").alias("last_age"), F.max("max_age").alias("first_age"),
        F.sum((F.col("min_age") <= 30).cast("bigint")).alias("n_ord30"),
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def pair_cycles(hist: DataFrame, anchor: str = "1970-01-01") -> DataFrame:
    """Per pair: distinct purchase times, median day gap, last day number, active months."""
    times = hist.select("cut", "user_id", "item_id", "ts").distinct().withColumn("day", S.day_number("ts", anchor))
    w = Window.partitionBy("cut", "user_id", "item_id").orderBy("ts")
    gaps = times.withColumn("gap", F.col("day") - F.lag("day").over(w))
    return gaps.groupBy("cut", "user_id", "item_id").agg(
        F.count(F.lit(1)).alias("n_times"), F.percentile("gap", F.lit(0.5)).alias("median_gap"),
        F.max("day").alias("last_day"), F.count_distinct(S.month_key("ts")).alias("n_months"))


# ------------------------------------------------------------------ profiles
def user_profile(hist: DataFrame, pairs: DataFrame, cats: Categories, products: DataFrame) -> DataFrame:
    """The ten user columns plus raw average price and country."""
    key = ["cut", "user_id"]
    totals = pairs.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_items"), F.greatest(F.sum("qty"), F.lit(0.0)).alias("qty"),
        F.greatest(F.sum("spend"), F.lit(0.0)).alias("spend"), F.min("last_age").alias("gap"))
    baskets = (
        hist.groupBy(*key, "order_id", "item_id").agg(F.min("ts").alias("ts"))
        .groupBy(*key, "order_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("ts"))
        .groupBy(*key).agg(
            F.count(F.lit(1)).alias("n_orders"), F.avg("n").alias("basket"),
            F.sum(S.is_weekend("ts").cast("double")).alias("weekend"))
    )
    days = hist.groupBy(*key).agg(F.count_distinct(F.to_date("ts")).alias("days"))
    entropy = category_entropy(pairs, cats, products)
    avg_price = F.when(F.col("qty") > 0, F.col("spend") / F.col("qty")).otherwise(0.0)
    return (
        totals.join(baskets, key).join(days, key).join(entropy, key, "left")
        .select(
            *key,
            S.log1p0("n_orders").alias("u_n_orders_log"), S.log1p0("n_items").alias("u_n_items_log"),
            S.log1p0("qty").alias("u_qty_log"), S.log1p0("spend").alias("u_spend_log"),
            S.log1p0(avg_price).alias("u_avg_unit_price_log"), S.log1p0("basket").alias("u_avg_basket_size_log"),
            S.log1p0("days").alias("u_active_days_log"), S.log1p0("gap").alias("u_last_active_gap_log"),
            (F.col("weekend") / F.col("n_orders")).alias("u_weekend_ratio"),
            F.coalesce("entropy", F.lit(0.0)).alias("u_cat_entropy"),
            avg_price.alias("avg_price"), "n_orders",
        )
    )


def category_entropy(pairs: DataFrame, cats: Categories, products: DataFrame) -> DataFrame:
    """Shannon entropy of distinct items over buckets divided by ln(#touched buckets)."""
    counts = cats.of_items(pairs.select("cut", "user_id", "item_id"), products).groupBy(
        "cut", "user_id", "collapsed").agg(F.count(F.lit(1)).cast("double").alias("c"))
    agg = counts.groupBy("cut", "user_id").agg(
        F.sum("c").alias("t"), F.sum(F.col("c") * F.log("c")).alias("a"), F.count(F.lit(1)).alias("nb"))
    return agg.select(
        "cut", "user_id",
        F.when(F.col("nb") >= 2, (F.log("t") - F.col("a") / F.col("t")) / F.log("nb")).otherwise(0.0).alias("entropy"))


def user_category_share(pairs: DataFrame, cats: Categories, products: DataFrame) -> DataFrame:
    """(cut, user, bucket) share of the user's spend."""
    spend = cats.of_items(pairs.select("cut", "user_id", "item_id", "spend"), products).groupBy(
        "cut", "user_id", "collapsed").agg(F.sum("spend").alias("s"))
    total = spend.groupBy("cut", "user_id").agg(F.sum("s").alias("t"))
    return spend.join(total, ["cut", "user_id"]).select(
        "cut", "user_id", "collapsed", F.when(F.col("t") != 0, F.col("s") / F.col("t")).otherwise(0.0).alias("share"))


def user_country(hist: DataFrame) -> DataFrame:
    """Most frequent country of a user, ties to the smaller name."""
    n = hist.groupBy("cut", "user_id", "country").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("cut", "user_id").agg(F.min_by("country", F.struct(-F.col("n"), "country")).alias("country"))


def item_counts(orders: DataFrame, pairs: DataFrame) -> DataFrame:
    """Item counts, ages, recent windows and repeat share."""
    key = ["cut", "item_id"]
    base = pairs.groupBy(*key).agg(
        F.count(F.lit(1)).alias("buyers"), F.sum("qty").alias("qty"),
        F.max("first_age").alias("first_age"), F.min("last_age").alias("last_age"),
        F.sum((F.col("last_age") <= 7).cast("bigint")).alias("r7_buy"),
        F.sum((F.col("last_age") <= 30).cast("bigint")).alias("r30_buy"),
        F.sum((F.col("last_age") <= 60).cast("bigint")).alias("r60_buy"),
        (F.sum(F.col("n_ord") - 1) / F.sum("n_ord")).alias("rep_frac"))
    per_order = orders.groupBy(*key, "order_id").agg(F.min("min_age").alias("a")).groupBy(*key).agg(
        F.count(F.lit(1)).alias("orders"), F.sum((F.col("a") <= 30).cast("bigint")).alias("r30_ord"))
    return base.join(per_order, key)


def item_profile(hist: DataFrame, counts: DataFrame) -> DataFrame:
    """Item counts plus median price, popularity position and peak weekday."""
    key = ["cut", "item_id"]
    price = R.grouped_median(hist, key, "unit_price", "price_med")
    peak = (
        hist.groupBy(*key, S.monday0("ts").alias("wd")).agg(F.sum("qty").alias("q"))
        .groupBy(*key).agg(F.max_by("wd", F.struct("q", -F.col("wd"))).alias("peak_wd"))
    )
    return counts.join(price, key, "left").join(peak, key).join(
        popularity_fraction(counts.select(*key, "buyers")), key)


def popularity_fraction(buyers: DataFrame) -> DataFrame:
    """Position by buyers (desc, then item id) divided by catalogue size - 1, per cut."""
    pos = R.global_position(buyers, [F.col("cut"), F.col("buyers").desc(), F.col("item_id")], "p")
    span = pos.groupBy("cut").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    return pos.join(span, "cut").select(
        "cut", "item_id", ((F.col("p") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))).alias("pop_frac"))


# ------------------------------------------------------------------ blocks
@dataclass
class Bundle:
    """Shared history tables for a list of cuts; user and item profiles are built on first use."""

    hist: DataFrame
    orders: DataFrame
    pairs: DataFrame
    cats: Categories
    products: DataFrame

    @cached_property
    def users(self) -> DataFrame:
        return user_profile(self.hist, self.pairs, self.cats, self.products)

    @cached_property
    def item_counts(self) -> DataFrame:
        return item_counts(self.orders, self.pairs)

    @cached_property
    def items(self) -> DataFrame:
        return item_profile(self.hist, self.item_counts)


def build_bundle(tx: DataFrame, products: DataFrame, cuts, top_n: int = 9) -> Bundle:
    hist = history(tx, cuts)
    orders = pair_orders(hist).persist()
    pairs = pair_history(orders).persist()
    cats = collapse_categories(hist, products, top_n, by=["cut"])
    return Bundle(hist, orders, pairs, cats, products)


def add_user(rows: DataFrame, b: Bundle) -> DataFrame:
    cols = C.FEATURES_USER + ["avg_price", "n_orders"]
    return rows.join(b.users.select("cut", "user_id", *cols), ["cut", "user_id"], "left").withColumn(
        "known_user", F.col("n_orders").isNotNull()).drop("n_orders").na.fill(0.0, C.FEATURES_USER + ["avg_price"])


def add_country(rows: DataFrame, b: Bundle) -> DataFrame:
    """Unknown users count as "other"."""
    named = rows.join(user_country(b.hist), ["cut", "user_id"], "left")
    return named.select("*", *S.country_indicators("country")).drop("country")


def add_item(rows: DataFrame, b: Bundle) -> DataFrame:
    i = b.items.select(
        "cut", "item_id", S.log1p0("buyers").alias("i_pop_buyers_log"), S.log1p0("orders").alias("i_pop_orders_log"),
        S.log1p0("qty").alias("i_qty_log"), S.log1p0("price_med").alias("i_price_log"),
        F.col("pop_frac").alias("i_pop_rank_frac"), S.log1p0("first_age").alias("i_first_gap_log"),
        S.log1p0("last_age").alias("i_last_gap_log"), F.col("peak_wd").cast("double").alias("i_top_weekday_code"),
        F.lit(True).alias("known_item"))
    stats = [c for c in C.FEATURES_ITEM if not c.startswith("i_cat")]
    return rows.join(i, ["cut", "item_id"], "left").na.fill(0.0, stats).withColumn(
        "known_item", F.coalesce("known_item", F.lit(False)))


def add_category(rows: DataFrame, b: Bundle) -> DataFrame:
    """Bucket columns and the user's lift in the bucket; filled for unknown items too."""
    tagged = b.cats.of_items(rows, b.products).join(b.cats.buckets, ["cut", "collapsed"], "left")
    share = user_category_share(b.pairs, b.cats, b.products)
    return tagged.join(share, ["cut", "user_id", "collapsed"], "left").select(
        *[c for c in tagged.columns if c not in ("collapsed", "bucket_spend", "bucket_share")],
        S.log1p0("bucket_spend").alias("i_cat_sales_log"),
        F.coalesce("bucket_share", F.lit(0.0)).alias("i_cat_sales_share"),
        S.log1p0(F.coalesce("share", F.lit(0.0)) / F.greatest(F.coalesce("bucket_share", F.lit(0.0)), F.lit(1e-9))).alias("ui_cat_lift_log"),
    ).na.fill(0.0, ["cat_code_ordinal"])


def add_price_gap(rows: DataFrame) -> DataFrame:
    return rows.withColumn(
        "ui_price_gap_log",
        F.when(F.col("known_user") & F.col("known_item"), F.col("i_price_log") - S.log1p0("avg_price")).otherwise(0.0))


def add_owned(rows: DataFrame, b: Bundle) -> DataFrame:
    own = b.pairs.select("cut", "user_id", "item_id", "last_age")
    return rows.join(own, ["cut", "user_id", "item_id"], "left").withColumn(
        "ui_owned", F.col("last_age").isNotNull().cast("double")
    ).withColumn("ui_owned_recency_log", S.log1p0("last_age")).drop("last_age")


def add_cf(rows: DataFrame, b: Bundle) -> DataFrame:
    """Aggregated item cosine to the owned items, computed from the cut's own history."""
    def by_cut(c):
        return F.concat_ws("\n", F.col("cut").cast("string"), F.col(c).cast("string"))

    known = F.col("user_id").isNotNull() & F.col("item_id").isNotNull()
    owned = b.pairs.filter(known).select(by_cut("user_id").alias("e"), by_cut("item_id").alias("k"))
    targets = rows.filter(known & F.col("cut").isNotNull())
    scores = T.profile_cosines(owned, targets.select(by_cut("user_id").alias("e"), by_cut("item_id").alias("o"))).select(
        F.substring_index("e", "\n", 1).cast(rows.schema["cut"].dataType).alias("cut"),
        F.expr("substr(e, instr(e, '\n') + 1)").cast(rows.schema["user_id"].dataType).alias("user_id"),
        F.expr("substr(o, instr(o, '\n') + 1)").alias("item_id"), F.col("score").alias("ui_cf_sim"))
    return rows.join(scores, ["cut", "user_id", "item_id"], "left").na.fill(0.0, ["ui_cf_sim"])


def add_vectors(rows: DataFrame, b: Bundle, vectors: DataFrame, k: int = NN_K) -> DataFrame:
    """Similarity to the mean owned unit vector and share of the item's k neighbours owned."""
    return add_neighbour_hits(add_vector_similarity(rows, b, vectors), b, vectors, k)


def add_vector_similarity(rows: DataFrame, b: Bundle, vectors: DataFrame) -> DataFrame:
    """Similarity of the item to the mean owned unit vector."""
    from shelfwise.operators import vectors as V

    own = b.pairs.select("cut", "user_id", "item_id")
    prof = V.mean_vectors(own, vectors, by=("cut", "user_id")).withColumnRenamed("vec", "uvec")
    return rows.join(V.unit_vectors(vectors), "item_id", "left").join(prof, ["cut", "user_id"], "left").withColumn(
        "ui_emb_sim", F.coalesce(V.dot("vec", "uvec"), F.lit(0.0))).drop("vec", "uvec")


def add_neighbour_hits(rows: DataFrame, b: Bundle, vectors: DataFrame, k: int = NN_K) -> DataFrame:
    """Share of the item's k nearest items that the user owns."""
    from shelfwise.operators import vectors as V

    own = b.pairs.select("cut", "user_id", "item_id")
    near = V.all_pairs_top_k(vectors, k).select("item_id", F.col("neighbor").alias("nb"))
    sizes = near.groupBy("item_id").agg(F.count(F.lit(1)).alias("k"))
    hits = (
        rows.select("cut", "user_id", "item_id").distinct().join(near, "item_id")
        .join(own.withColumnRenamed("item_id", "nb"), ["cut", "user_id", "nb"], "left_semi")
        .groupBy("cut", "user_id", "item_id").agg(F.count(F.lit(1)).alias("h"))
    )
    out = (
        rows.join(hits, ["cut", "user_id", "item_id"], "left").join(sizes, "item_id", "left")
    )
    return out.withColumn("ui_nn_hit_rate", F.coalesce(F.col("h") / F.col("k"), F.lit(0.0))).drop("h", "k")


def add_pair_history(rows: DataFrame, b: Bundle) -> DataFrame:
    p = b.pairs.select(
        "cut", "user_id", "item_id", S.log1p0("n_ord").alias("p_ui_n_ord_log"), S.log1p0("qty").alias("p_ui_qty_log"),
        S.log1p0("first_age").alias("p_ui_first_age_log"), S.log1p0("n_ord30").alias("p_ui_recent_ord30_log"))
    return rows.join(p, ["cut", "user_id", "item_id"], "left").na.fill(0.0, p.columns[3:])


def add_item_recent(rows: DataFrame, b: Bundle) -> DataFrame:
    older = F.greatest(F.col("buyers") - F.col("r30_buy"), F.lit(0))
    i = b.item_counts.select(
        "cut", "item_id", S.log1p0("r30_buy").alias("i_r30_buy_log"), S.log1p0("r30_ord").alias("i_r30_ord_log"),
        S.log1p0("r60_buy").alias("i_r60_buy_log"),
        S.log1p0(F.col("r30_buy") / F.greatest(older, F.lit(1))).alias("i_growth30_log"),
        S.log1p0("r7_buy").alias("i_r7_buy_log"), F.col("rep_frac").alias("i_rep_incid_frac"))
    return rows.join(i, ["cut", "item_id"], "left").na.fill(0.0, i.columns[2:])


def add_context(rows: DataFrame, b: Bundle, smooth: float = 0.5) -> DataFrame:
    """Candidate-set context: list sizes and smoothed owned shares per user and per item.
    Counts are aggregates joined back, so one huge candidate list is summed in parts."""
    own = b.pairs.select("cut", "user_id", "item_id", F.lit(1.0).alias("__own"))
    keyed = rows.select("cut", "user_id", "item_id").join(own, ["cut", "user_id", "item_id"], "left").na.fill(0.0, ["__own"])
    per_user = keyed.groupBy("cut", "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("__own").alias("h")).select(
        "cut", "user_id", S.log1p0("n").alias("cc_u_cand_size_log"), S.smoothed("h", "n", smooth).alias("cc_u_owned_ratio"))
    per_item = keyed.groupBy("cut", "item_id").agg(F.count(F.lit(1)).alias("n"), F.sum("__own").alias("h")).select(
        "cut", "item_id", S.log1p0("n").alias("cc_i_cand_freq_log"), S.smoothed("h", "n", smooth).alias("cc_i_hit_ratio"))
    return rows.join(per_user, ["cut", "user_id"]).join(per_item, ["cut", "item_id"])


def add_cycles(rows: DataFrame, b: Bundle, anchor: str = "1970-01-01", cap: float = 6.0) -> DataFrame:
    """Repurchase rhythm of the pair.  Purchase times are counted, not calendar days."""
    cyc = pair_cycles(b.hist, anchor)
    months = b.hist.groupBy("cut", "user_id").agg(F.count_distinct(S.month_key("ts")).alias("u_months"))
    out = rows.join(cyc, ["cut", "user_id", "item_id"], "left").join(months, ["cut", "user_id"], "left")
    ok = (F.coalesce("n_times", F.lit(0)) >= 2) & (F.coalesce("median_gap", F.lit(0.0)) > 0)
    since = F.greatest(S.day_number("cut", anchor) - F.col("last_day"), F.lit(0))
    return (
        out.withColumn("p_cycle_median_log", F.when(ok, S.log1p0("median_gap")).otherwise(0.0))
        .withColumn("p_due_capped", F.when(ok, F.least(F.greatest(since / F.col("median_gap"), F.lit(0.0)), F.lit(cap))).otherwise(0.0))
        .withColumn("p_n_dates_log", S.log1p0("n_times"))
        .withColumn("p_ui_act_mon_frac", F.coalesce("n_months", F.lit(0)) / F.greatest(F.coalesce("u_months", F.lit(0)), F.lit(1)))
        .drop("n_times", "median_gap", "last_day", "n_months", "u_months")
    )


def add_category_recent(rows: DataFrame, b: Bundle, days: int = CYCLE_RECENT_DAYS, smooth: float = 0.5) -> DataFrame:
    """Distinct items of the same bucket bought in the last days: log count and smoothed share."""
    recent = b.cats.of_items(
        b.pairs.filter(F.col("last_age") <= days).select("cut", "user_id", "item_id"), b.products)
    total = recent.groupBy("cut", "user_id").agg(F.count(F.lit(1)).alias("__tot"))
    per_cat = recent.groupBy("cut", "user_id", "collapsed").agg(F.count(F.lit(1)).alias("__cnt"))
    out = b.cats.of_items(rows, b.products).join(per_cat, ["cut", "user_id", "collapsed"], "left").join(
        total, ["cut", "user_id"], "left").na.fill(0, ["__cnt", "__tot"])
    return (
        out.withColumn("cc_cat_recent_log", S.log1p0("__cnt"))
        .withColumn("cc_cat_recent_share", S.smoothed_raw("__cnt", "__tot", smooth))
        .drop("__cnt", "__tot", "collapsed")
    )


def base_features(rows: DataFrame, b: Bundle, vectors: DataFrame | None = None) -> DataFrame:
    """The 31 + 2 columns for pair rows (cut, user_id, item_id, ...)."""
    out = add_price_gap(add_category(add_item(add_country(add_user(rows, b), b), b), b))
    out = add_owned(add_cf(out, b), b)
    if vectors is None:
        out = out.withColumn("ui_emb_sim", F.lit(0.0)).withColumn("ui_nn_hit_rate", F.lit(0.0))
    else:
        out = add_vectors(out, b, vectors)
    keep = [c for c in rows.columns]
    return out.select(*keep, *C.FEATURES_BASE, *C.FEATURES_OWNED)


def context_features(rows: DataFrame, b: Bundle) -> DataFrame:
    """The 11 context columns."""
    out = add_context(add_item_recent(add_pair_history(rows, b), b), b)
    return out.select(*rows.columns, *C.FEATURES_CONTEXT)


def cycle_features(rows: DataFrame, b: Bundle) -> DataFrame:
    """The 6 cycle columns."""
    out = add_category_recent(add_cycles(add_item_recent(rows, b), b), b)
    return out.select(*rows.columns, *C.FEATURES_CYCLE)


def rhythm_features(rows: DataFrame, b: Bundle) -> DataFrame:
    """The 4 rhythm columns."""
    out = add_cycles(add_item_recent(add_pair_history(rows, b), b), b)
    return out.select(*rows.columns, *C.FEATURES_RHYTHM)


def validate_wide(wide: DataFrame, features, index: DataFrame | None = None) -> DataFrame:
    """Row count, NULL/NaN cells, rows with a label outside {0, 1}, unknown item ids, and whether
    the feature columns are present in order and numeric."""
    present = [c for c in wide.columns if c in features]
    numeric = all(dict(wide.dtypes)[c] in ("double", "float", "int", "bigint") for c in present)
    bad = sum([(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("bigint") for c in present], F.lit(0))
    out = wide.agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(bad), F.lit(0)).alias("null_cells"),
        F.sum((~F.coalesce(F.col("label").isin(0, 1), F.lit(False))).cast("bigint")).alias("bad_labels"),
    ).withColumn("columns_ok", F.lit(present == list(features) and numeric))
    if index is not None:
        unknown = wide.join(index.select("item_id"), "item_id", "left_anti").agg(F.count(F.lit(1)).alias("c")).scalar()
        out = out.withColumn("unknown_items", unknown)
    return out


def max_difference(a: DataFrame, b: DataFrame, keys, cols) -> DataFrame:
    """Largest absolute difference per column over a key join, with the number of matched rows."""
    other = b.select(*keys, *[F.col(c).alias(f"__{c}") for c in cols])
    return a.join(other, list(keys)).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.max(F.abs(F.col(c) - F.col(f"__{c}"))).alias(c) for c in cols])


def class_means(wide: DataFrame, features) -> DataFrame:
    """Mean of every feature for negatives and positives, long form."""
    means = wide.groupBy("label").agg(*[F.avg(c).alias(c) for c in features])
    long = means.unpivot(["label"], list(features), "feature", "mean")
    return long.groupBy("feature").agg(
        F.max(F.when(F.col("label") == 1, F.col("mean"))).alias("pos_mean"),
        F.max(F.when(F.col("label") == 0, F.col("mean"))).alias("neg_mean"))
