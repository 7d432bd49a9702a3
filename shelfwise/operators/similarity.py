"""Sparse similarities and neighbour-vote recommenders.

The pair sums behind every cosine come from one self-join on the shared key.  A key that holds
more than ``BLOCK`` entries is cut into slots and each pair of slots becomes a join key of its
own, so no task sees a whole hot key.  Products are summed map-side before the shuffle on the
pair, and only i < j is computed; the mirror is added afterwards.

Cosines without ``by`` and votes come from tiles of the matrix product (``tiles.py``) instead: pairs are not shuffled, and a
list of neighbours leaves a tile as its head only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import ranks as R
from shelfwise.functions import scalar as S
from shelfwise.operators import tiles as T

BLOCK = 2000


def purchase_matrix(df: DataFrame, weighted: bool = False) -> DataFrame:
    """Long user x item matrix: summed quantity or 1; NULL users and qty <= 0 are dropped."""
    w = F.sum("qty").cast("double") if weighted else F.lit(1.0)
    return (
        df.filter(F.col("user_id").isNotNull() & (F.col("qty") > 0))
        .groupBy("user_id", "item_id").agg(w.alias("w"))
    )


def _shared(rows: DataFrame, key, entity: str, weights, by, block: int) -> DataFrame:
    """Pairs i < j per shared key with the weights of both, ``<weight>_i`` and ``<weight>_j``."""
    keys = by + ([key] if isinstance(key, str) else list(key))
    big = (
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > block)
        .withColumn("__slots", F.ceil(F.col("__n") / block).cast("int")).drop("__n")
    )
    sized = rows.join(big, keys, "left").withColumn("__slots", F.coalesce("__slots", F.lit(1)))
    slot = F.pmod(F.xxhash64(entity), F.col("__slots")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("__slots") - 1))
    a = sized.select(*keys, F.col(entity).alias("i"), *[F.col(w).alias(f"{w}_i") for w in weights], slot.alias("__s"), every.alias("__t"))
    b = sized.select(*keys, F.col(entity).alias("j"), *[F.col(w).alias(f"{w}_j") for w in weights], slot.alias("__t"), every.alias("__s"))
    return a.join(b, keys + ["__s", "__t"]).filter(F.col("i") < F.col("j"))


def pair_sums(rows: DataFrame, key, entity: str, weight: str = "w", by=(), block: int = BLOCK) -> DataFrame:
    """For i < j: sum over shared keys of w_i * w_j (``c``) and the number of shared keys (``m``).

    ``rows`` holds one row per (by, key, entity).
    """
    by = list(by)
    return _shared(rows, key, entity, [weight], by, block).groupBy(*by, "i", "j").agg(
        F.sum(F.col(f"{weight}_i") * F.col(f"{weight}_j")).alias("c"), F.count(F.lit(1)).alias("m"))


def pair_sums_many(rows: DataFrame, key, entity: str, weights, by=(), block: int = BLOCK) -> DataFrame:
    """``pair_sums`` of several weights in one join: a column named after each weight, and ``m``."""
    by = list(by)
    return _shared(rows, key, entity, weights, by, block).groupBy(*by, "i", "j").agg(
        *[F.sum(F.col(f"{w}_i") * F.col(f"{w}_j")).alias(w) for w in weights], F.count(F.lit(1)).alias("m"))


def diagonal(rows: DataFrame, entity: str, weight: str = "w", by=()) -> DataFrame:
    return rows.groupBy(*by, F.col(entity).alias("e")).agg(
        F.sum(F.col(weight) * F.col(weight)).alias("d"), F.count(F.lit(1)).alias("n"))


def with_diagonal(sums: DataFrame, diag: DataFrame, by=()) -> DataFrame:
    """Adds d_i, n_i, d_j, n_j to a pair table."""
    by = list(by)
    left = diag.select(*by, F.col("e").alias("i"), F.col("d").alias("d_i"), F.col("n").alias("n_i"))
    right = diag.select(*by, F.col("e").alias("j"), F.col("d").alias("d_j"), F.col("n").alias("n_j"))
    return sums.join(left, by + ["i"]).join(right, by + ["j"])


def mirror(pairs: DataFrame, *values: str, by=()) -> DataFrame:
    """(i, j) and (j, i) rows from the upper triangle in one pass."""
    both = F.explode(F.array(F.struct(F.col("i").alias("i"), F.col("j").alias("j")),
                             F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return pairs.select(*by, both.alias("__p"), *values).select(*by, "__p.i", "__p.j", *values)


def cosine_pairs(rows: DataFrame, key: str, entity: str, weight: str = "w", by=(), block: int = BLOCK) -> DataFrame:
    """Upper triangle (i < j) with ``sim`` = cosine, ``m`` = shared keys."""
    if not by:
        blocks, kind = T.packed_pairs(rows, key, entity, weight), rows.schema[entity].dataType.simpleString()
        out = T.cosine_pairs(blocks, kind)
        out.heads = lambda k: T.cosine_heads(blocks, kind, k)  # what ``neighbours`` takes, without the pairs between
        out.entities = lambda: rows.select(entity).distinct().count()
        return out
    sums = pair_sums(rows, key, entity, weight, by, block)
    full = with_diagonal(sums, diagonal(rows, entity, weight, by), by)
    return full.select(*by, "i", "j", (F.col("c") / F.sqrt(F.col("d_i") * F.col("d_j"))).alias("sim"), "m")


def neighbours(pairs: DataFrame, k: int, by=()) -> DataFrame:
    """Top-k neighbours per row entity, similarity > 0, both directions."""
    if heads := getattr(pairs, "heads", None):
        out = T.best(heads(k), "i", "j", "sim", k)
        out.at_most = lambda: k * pairs.entities()
        return out
    both = mirror(pairs, "sim", by=by).filter(F.col("sim") > 0)
    return R.top_k(both, [*by, "i"], [F.col("sim").desc(), F.col("j")], k)


def _at_most(near: DataFrame):
    """Upper bound of the rows of a neighbour table, where it has one: counting would compute it."""
    bound = getattr(near, "at_most", None)
    return bound() if bound else None


def _best_votes(voters: DataFrame, owned: DataFrame, lists: DataFrame, k: int, n_voters=None, n_lists=None) -> DataFrame:
    """Sums of ``w`` over the shared keys of ``voters`` (user_id, key, w) and ``lists`` (item_id, key, w) for items that the user
    does not own: the best k, ties to the smaller item."""
    kinds = (voters.schema["user_id"].dataType.simpleString(), lists.schema["item_id"].dataType.simpleString())
    least = int(voters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    right = T.pack(lists, "item_id", "key", "w", True, T.RIGHT_ENTRIES, n=n_lists)
    left = T.pack(voters, "user_id", "key", "w", False, T.LEFT_ENTRIES, least, more=owned.select("user_id", "item_id"), n=n_voters)
    return T.best(T.vote_heads(left, right, *kinds, k), "user_id", "item_id", "score", k)


def itemcf(rows: DataFrame, by=(), block: int = BLOCK) -> DataFrame:
    """Binary item-item cosine over buyers (upper triangle)."""
    return cosine_pairs(rows, "user_id", "item_id", "w", by, block)


def usercf(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """User-user cosine over items (upper triangle)."""
    return cosine_pairs(rows, "item_id", "user_id", "w", (), block)


def similar_users(rows: DataFrame, user_id: int, k: int) -> DataFrame:
    """Top-k users by cosine to one user: only that user's items are joined."""
    norms = rows.groupBy("user_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("nrm"))
    mine = rows.filter(F.col("user_id") == user_id).select("item_id", F.col("w").alias("mw"))
    my_norm = norms.filter(F.col("user_id") == user_id).select("nrm").scalar()
    sums = (
        rows.filter(F.col("user_id") != user_id).join(mine, "item_id")
        .groupBy("user_id").agg(F.sum(F.col("w") * F.col("mw")).alias("c"))
    )
    return (
        sums.join(norms, "user_id").withColumn("my", my_norm)
        .select("user_id", (F.col("c") / (F.col("nrm") * F.col("my"))).alias("sim"))
        .filter(F.col("sim") > 0).orderBy(F.col("sim").desc(), "user_id").limit(k)
    )


def recommend_usercf(rows: DataFrame, k: int, n_neighbours: int = 20, block: int = BLOCK) -> DataFrame:
    """Nearest users vote with their similarity for items the user does not own."""
    near = neighbours(usercf(rows, block), n_neighbours)
    voters = near.select(F.col("i").alias("user_id"), F.col("j").alias("key"), F.col("sim").alias("w"))
    lists = rows.select("item_id", F.col("user_id").alias("key"), F.lit(1.0).alias("w"))
    return _best_votes(voters, rows, lists, k, n_voters=_at_most(near))


def recommend_item_votes(seeds: DataFrame, owned: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """Sum of seed-to-neighbour similarities over items not owned.

    Seeds are a parameter; pass the training items.  (Seeding with the held-out basket leaks the
    answer and is only for reproducing inflated figures.)
    """
    voters = seeds.select("user_id", F.col("item_id").alias("key")).distinct().withColumn("w", F.lit(1.0))
    lists = near.select(F.col("j").alias("item_id"), F.col("i").alias("key"), F.col("sim").alias("w"))
    return _best_votes(voters, owned, lists, k, n_lists=_at_most(near))


def profile_scores(owned: DataFrame, pairs: DataFrame, by=(), targets: DataFrame | None = None) -> DataFrame:
    """Sum of item cosines to the owned items, self (cosine 1) included for owned items.

    One row per (by, user, item) with a non-zero score.  ``targets`` (by, user, item) keeps only
    wanted rows before they are summed and shuffled.
    """
    by = list(by)
    both = mirror(pairs, "sim", by=by)
    own = owned.select(*by, "user_id", F.col("item_id").alias("i")).distinct()
    spread = own.join(both, by + ["i"]).select(*by, "user_id", F.col("j").alias("item_id"), "sim")
    itself = own.select(*by, "user_id", F.col("i").alias("item_id"), F.lit(1.0).alias("sim"))
    scores = spread.unionByName(itself)
    if targets is not None:
        keys = by + ["user_id", "item_id"]
        scores = scores.join(targets.select(*keys).distinct(), keys, "left_semi")
    return scores.groupBy(*by, "user_id", "item_id").agg(F.sum("sim").alias("score"))


def restrict_items(recs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    return recs.join(vocabulary.select("item_id").distinct(), "item_id", "left_semi")


def neighbour_agreement(a: DataFrame, b: DataFrame, key: str, other: str) -> DataFrame:
    """Per item: Jaccard of two neighbour lists and whether their first entries match; then the
    medians and the share of equal first entries.  Lists are top-k, so bounded."""
    la = a.groupBy(key).agg(F.collect_set(other).alias("sa"), F.min_by(other, "rank").alias("fa"),
                            F.max(F.when(F.col("rank") == 1, F.col("sim"))).alias("ta"))
    lb = b.groupBy(key).agg(F.collect_set(other).alias("sb"), F.min_by(other, "rank").alias("fb"),
                            F.max(F.when(F.col("rank") == 1, F.col("sim"))).alias("tb"))
    both = la.join(lb, key).select(
        (F.size(F.array_intersect("sa", "sb")) / F.size(F.array_union("sa", "sb"))).alias("jac"),
        (F.col("fa") == F.col("fb")).cast("double").alias("same"), "ta", "tb",
    )
    return both.agg(
        F.count(F.lit(1)).alias("n_items"), F.percentile("jac", F.lit(0.5)).alias("median_jaccard"),
        F.percentile("ta", F.lit(0.5)).alias("median_top1_a"), F.percentile("tb", F.lit(0.5)).alias("median_top1_b"),
        F.avg("same").alias("same_top1"),
    )


# Degree buckets as (label, low, high), both ends included.
USER_DEGREE_BUCKETS = [("1–2 种", 1, 2), ("3–10 种", 3, 10), ("11–50 种", 11, 50),
                       ("51–200 种", 51, 200), (">200 种", 201, None)]
ITEM_BUYER_BUCKETS = [("1 人", 1, 1), ("2–5 人", 2, 5), ("6–30 人", 6, 30),
                      ("31–200 人", 31, 200), (">200 人", 201, None)]


def degree_buckets(rows: DataFrame, near: DataFrame, entity: str, buckets) -> DataFrame:
    """Entities with a neighbour per degree bucket and their median best similarity."""
    deg = rows.groupBy(F.col(entity).alias("i")).agg(F.count(F.lit(1)).alias("deg"))
    top = near.filter(F.col("rank") == 1).select("i", "sim").join(deg, "i")
    label = S.right_closed_bucket("deg", [hi for _l, _lo, hi in buckets[:-1]], [b[0] for b in buckets])
    tagged = top.select(label.alias("bucket"), "sim").persist()  # read several times; one row per entity
    return tagged.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).join(
        R.grouped_median(tagged, ["bucket"], "sim", "median_top1"), "bucket")


def buyer_summary(rows: DataFrame) -> DataFrame:
    """Number of one-buyer items and the median number of buyers."""
    deg = rows.groupBy("item_id").agg(F.count_distinct("user_id").alias("b"))
    return deg.agg(F.sum((F.col("b") == 1).cast("bigint")).alias("one_buyer"),
                   F.percentile("b", F.lit(0.5)).alias("median_buyers"))


def top1_overlap(rows: DataFrame, near: DataFrame, entity: str, other: str) -> DataFrame:
    """Median and mean number of entries an entity shares with its first neighbour."""
    top = near.filter(F.col("rank") == 1).select("i", "j")
    mine = rows.select(F.col(entity).alias("i"), other).join(top, "i")
    shared = (
        mine.join(rows.select(F.col(entity).alias("j"), F.col(other)), ["j", other], "left_semi")
        .groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    )
    counts = top.join(shared, "i", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return counts.agg(F.percentile("n", F.lit(0.5)).alias("overlap_median"), F.avg("n").alias("overlap_mean"))
