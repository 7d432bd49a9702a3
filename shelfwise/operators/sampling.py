"""Eligible users, positives, negatives, splits and evaluation pools.

Random choices are an md5 order over (user, item, seed), so they are the same on every cluster.
Negatives walk the catalogue on a ring in md5 order with a start and a stride of each user's own.  Only
need + (number of excluded items) + (padding to a prime) places per user are laid out, never the
user x catalogue product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise import schema as C
from shelfwise.functions import ranks as R
from shelfwise.functions import scalar as S


def eligible_users(hist: DataFrame, min_orders: int = 2) -> DataFrame:
    return hist.groupBy("user_id").agg(F.count_distinct("order_id").alias("n_orders")).filter(F.col("n_orders") >= min_orders)


def positives_first(hist: DataFrame, label: DataFrame, min_orders: int = 2) -> DataFrame:
    """Label-window pairs of eligible users that were never bought before."""
    return positives_all(hist, label, min_orders).join(
        hist.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def positives_all(hist: DataFrame, label: DataFrame, min_orders: int = 2) -> DataFrame:
    """Label-window pairs of eligible users, repeat purchases included."""
    users = eligible_users(hist, min_orders)
    return label.select("user_id", "item_id").distinct().join(users, "user_id", "left_semi")


def pool_sizes(bought: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalogue size minus owned catalogue items per user, without forming the product."""
    total = catalog.select(F.count_distinct("item_id").alias("c")).scalar()
    inside = bought.join(catalog, "item_id", "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    users = bought.select("user_id").distinct()
    return users.join(inside, "user_id", "left").select("user_id", (total - F.coalesce("n", F.lit(0))).alias("pool"))


def next_prime(n: int) -> int:
    """Least prime that is at least n."""
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, int(n ** 0.5) + 1)):
        n += 1
    return n


def _hashed(user: str, seed: int, name: str):
    """Leading 28 bits of an md5 over user, seed and name."""
    head = F.substring(S.md5_key(F.col(user).cast("string"), seed, name), 1, 7)
    return F.conv(head, 16, 10).cast("bigint")


def draw_unbought(need: DataFrame, excluded: DataFrame, catalog: DataFrame, seed: int = C.SEED) -> DataFrame:
    """``need`` (user_id, n) negatives per user from the catalogue minus ``excluded`` pairs,
    without replacement; a pool that is too small is taken whole.

    Items lie on a ring in md5 order, padded with empty places to a prime length P.  User u visits the places
    (start_u + p * stride_u) mod P for p = 0, 1, ...: start and stride are hashed per user, and as P is prime every
    stride visits each place once, so each item is equally likely and draws of two users are unrelated.  Among
    the first n + e + (P - size) places (e = the user's excluded items) at least n hold a free item.
    """
    items = catalog.select("item_id").distinct()
    keyed = items.withColumn("key", S.md5_key(F.col("item_id"), seed, "ring"))
    index = R.global_position(keyed, [F.col("key"), F.col("item_id")], "item_idx").select("item_id", "item_idx")
    size = index.count()
    prime = next_prime(size)
    out = excluded.select("user_id", "item_id").distinct()
    n_out = out.groupBy("user_id").agg(F.count(F.lit(1)).alias("e"))
    start = F.pmod(_hashed("user_id", seed, "start"), F.lit(prime))
    stride = F.pmod(_hashed("user_id", seed, "stride"), F.lit(prime - 1)) + 1
    span = (
        need.filter(F.col("n") > 0).join(n_out, "user_id", "left")
        .withColumn("last", F.least(F.col("n") + F.coalesce("e", F.lit(0)) + F.lit(prime - size), F.lit(prime)))
        .withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last") - 1)))
        .withColumn("item_idx", F.pmod(start + F.col("p") * stride, F.lit(prime)))
    )
    free = span.join(index, "item_idx").join(out, ["user_id", "item_id"], "left_anti")
    w = Window.partitionBy("user_id").orderBy("p")
    return free.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= F.col("n")).select("user_id", "item_id")


def negatives(pos: DataFrame, ever: DataFrame, catalog: DataFrame, ratio: int = 3, seed: int = C.SEED) -> DataFrame:
    """ratio x positives never-bought items per user (``ever`` covers history and label window)."""
    need = pos.groupBy("user_id").agg((F.count(F.lit(1)) * ratio).alias("n"))
    return draw_unbought(need, ever, catalog, seed)


def stratified_negatives(pos: DataFrame, hist: DataFrame, catalog: DataFrame, ratio: int = 3,
                         owned_share: float = 0.125, seed: int = C.SEED) -> DataFrame:
    """bround(share * need) owned-not-rebought items by md5 order, the rest never bought."""
    need = pos.groupBy("user_id").agg((F.count(F.lit(1)) * ratio).alias("need"))
    owned = hist.select("user_id", "item_id").distinct()
    lapsed = owned.join(pos, ["user_id", "item_id"], "left_anti").join(need, "user_id")
    w = Window.partitionBy("user_id").orderBy(S.md5_key(F.col("user_id").cast("string"), F.col("item_id"), seed))
    own = lapsed.withColumn("r", F.row_number().over(w)).filter(
        F.col("r") <= F.bround(F.col("need") * owned_share)).select("user_id", "item_id")
    taken = own.groupBy("user_id").agg(F.count(F.lit(1)).alias("t"))
    rest = need.join(taken, "user_id", "left").select("user_id", (F.col("need") - F.coalesce("t", F.lit(0))).alias("n"))
    fresh = draw_unbought(rest, owned.unionByName(pos.select("user_id", "item_id")), catalog, seed)
    return own.withColumn("stratum", F.lit("owned")).unionByName(fresh.withColumn("stratum", F.lit("fresh")))


def labelled_pairs(pos: DataFrame, neg: DataFrame) -> DataFrame:
    return pos.select("user_id", "item_id", F.lit(1).alias("label")).unionByName(
        neg.select("user_id", "item_id", F.lit(0).alias("label")))


def pair_stats(pairs: DataFrame) -> DataFrame:
    return pairs.agg(
        F.count_distinct("user_id").alias("n_users"), F.sum("label").alias("pos_n"),
        F.sum(1 - F.col("label")).alias("neg_n"))


def user_split(users: DataFrame, share: float = 0.3, seed: int = C.SEED) -> DataFrame:
    """Validation flag per user: the first bround(share * n) users in md5 order."""
    keyed = users.select("user_id").distinct().withColumn("key", S.md5_key(F.col("user_id").cast("string"), seed))
    total = keyed.select(F.count(F.lit(1)).alias("c")).scalar()
    placed = R.global_position(keyed, [F.col("key"), F.col("user_id")], "p")
    return placed.select("user_id", (F.col("p") < F.bround(F.lit(share) * total)).alias("is_valid"))


def evaluation_pool(label: DataFrame, users: DataFrame, catalog: DataFrame, n_neg: int = 200, seed: int = C.SEED) -> DataFrame:
    """All label-window pairs of the users plus n_neg items not bought in the window."""
    pos = label.select("user_id", "item_id").distinct().join(users.select("user_id").distinct(), "user_id", "left_semi")
    need = pos.select("user_id").distinct().withColumn("n", F.lit(n_neg).cast("long"))
    return labelled_pairs(pos, draw_unbought(need, pos, catalog, seed))
