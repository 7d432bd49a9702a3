"""Candidate recall routes, quota fusion and recall diagnostics.

A route is a frame (user_id, item_id, score, rank) with rank 1 = best.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise import schema as C
from shelfwise.functions import ranks as R
from shelfwise.operators import aggregates as A
from shelfwise.operators import similarity as sim
from shelfwise.operators import vectors as V

HEAD = 20_000


def holdout(tx: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, test): rows at each user's latest time are the test basket."""
    return A.earlier_rows(tx), A.last_time_rows(tx)


def owned_items(tx: DataFrame) -> DataFrame:
    return tx.select("user_id", "item_id").distinct()


def popularity(tx: DataFrame, by: str = "buyers") -> DataFrame:
    """item_id, weight, pos (1 = most popular) by buyers or units, ties by id."""
    weight = F.count_distinct("user_id") if by == "buyers" else F.sum("qty")
    w = tx.groupBy("item_id").agg(weight.alias("weight"))
    return R.global_position(w, [F.col("weight").desc(), F.col("item_id")], "p").select(
        "item_id", "weight", (F.col("p") + 1).alias("pos"))


def popular_route(pop: DataFrame, owned: DataFrame, users: DataFrame, k: int) -> DataFrame:
    """The k most popular items each user does not own.

    If the user's owned items have popularity positions r1 < r2 < ..., the first k free ones lie
    within k + c, where c counts the j with r_j - j < k.  So only k + c positions per user are
    laid out and the owned ones removed: exact for any number of owned items.  Positions up to
    HEAD are joined from a broadcast table of at most HEAD rows, later ones by a shuffle join.
    """
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("pos"))
    extra = (
        owned.select("user_id", "item_id").distinct().join(pop.select("item_id", "pos"), "item_id")
        .withColumn("j", place).filter(F.col("pos") - F.col("j") < k)
        .groupBy("user_id").agg(F.count(F.lit(1)).alias("c"))
    )
    want = (
        users.select("user_id").distinct().join(extra, "user_id", "left")
        .withColumn("pos", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k) + F.coalesce("c", F.lit(0)))))
        .select("user_id", "pos")
    )
    table = pop.select("pos", "item_id")
    near = want.filter(F.col("pos") <= HEAD).join(F.broadcast(table.filter(F.col("pos") <= HEAD)), "pos")
    far = want.filter(F.col("pos") > HEAD).join(table.filter(F.col("pos") > HEAD), "pos")
    free = near.unionByName(far).join(owned.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    return R.top_k(free, ["user_id"], [F.col("pos")], k).select(
        "user_id", "item_id", (-F.col("rank") + 1.0).alias("score"), "rank")


def expand_route(near: DataFrame, seeds: DataFrame, owned: DataFrame, cap: int) -> DataFrame:
    """Best similarity of any seed's neighbour, owned items dropped, first ``cap`` kept.

    ``near`` holds (i, j, sim) with the neighbours to use already chosen.
    """
    best = (
        seeds.select("user_id", F.col("item_id").alias("i")).distinct().join(near.select("i", "j", "sim"), "i")
        .groupBy("user_id", F.col("j").alias("item_id")).agg(F.max("sim").alias("score"))
    )
    fresh = best.join(owned.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    return R.top_k(fresh, ["user_id"], [F.col("score").desc(), F.col("item_id")], cap)


def vector_route(owned: DataFrame, vectors: DataFrame, k: int, raw_mean: bool = False) -> DataFrame:
    """Items nearest to the user's mean vector; ``raw_mean`` averages raw vectors and scales after."""
    users = V.mean_vectors(owned, vectors, normalise_items=not raw_mean, normalise_mean=raw_mean)
    return V.recommend(users, vectors, owned, k).withColumnRenamed("sim", "score")


def itemcf_route(owned: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Sum of item cosines to everything owned, owned items dropped."""
    scores = sim.profile_scores(owned, pairs).withColumn("score", F.round("score", 10))
    fresh = scores.join(owned.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    return R.top_k(fresh, ["user_id"], [F.col("score").desc(), F.col("item_id")], k)


def vector_neighbours(vectors: DataFrame, k: int) -> DataFrame:
    return V.all_pairs_top_k(vectors, k).select(F.col("item_id").alias("i"), F.col("neighbor").alias("j"), "sim", "rank")


def fuse_three(routes: dict, popular: DataFrame, catalog: DataFrame, quotas=C.QUOTAS_3,
               final_k: int = C.RECALL_FINAL_K) -> DataFrame:
    """Quota fusion: rank <= quota per route, in-route score 1 - (rank - 1)/quota, best score over
    routes, popular back-fill, order by (score desc, item id), cut at final_k.

    ``popular`` is the popular route with at least final_k rows per user for the back-fill.
    """
    parts = None
    for i, (name, frame) in enumerate(routes.items()):
        q = quotas.get(name, 0)
        part = frame.filter(F.col("rank") <= q).select(
            "user_id", "item_id", F.lit(i).alias("route_no"), F.lit(name).alias("route"),
            F.greatest(F.lit(0.0), 1.0 - (F.col("rank") - 1) / F.lit(float(max(1, q)))).alias("s"))
        parts = part if parts is None else parts.unionByName(part)
    merged = (
        parts.join(catalog.select("item_id").distinct(), "item_id", "left_semi")
        .groupBy("user_id", "item_id")
        .agg(F.max("s").alias("score"),
             F.transform(F.array_sort(F.collect_set(F.struct("route_no", "route"))), lambda e: e["route"]).alias("routes"))
    )
    counts = merged.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("user_id").orderBy("rank")
    fill = (
        popular.join(merged.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
        .withColumn("f", F.row_number().over(w) - 1).join(counts, "user_id", "left")
        .filter(F.col("f") < F.lit(final_k) - F.coalesce("n", F.lit(0)))
        .select("user_id", "item_id", F.greatest(F.lit(0.02), 0.2 - 0.01 * F.col("f")).alias("score"),
                F.array(F.lit("popular")).alias("routes"))
    )
    both = merged.unionByName(fill)
    return R.top_k(both, ["user_id"], [F.col("score").desc(), F.col("item_id")], final_k, "recall_rank").withColumn(
        "n_routes", F.size("routes"))


def fuse_ordered(routes: dict, quotas: dict, final_k: int = C.RECALL_FINAL_K, zero_admits_one: bool = True) -> DataFrame:
    """Ordered quota fusion: each route in turn adds up to its quota of items that no earlier
    route added, until final_k.  With ``zero_admits_one`` a quota of 0 still lets one item in.

    A user's pool holds at most final_k rows per route, so it fits one array; the sequential rule
    is a fold over it.
    """
    parts = None
    for i, (name, frame) in enumerate(routes.items()):
        part = frame.filter(F.col("rank") <= final_k).select(
            "user_id", F.struct(F.lit(i).alias("no"), F.col("rank"), F.col("item_id").alias("item")).alias("e"))
        parts = part if parts is None else parts.unionByName(part)
    limits = F.array(*[F.lit(max(quotas.get(n, 0), 1 if zero_admits_one else 0)) for n in routes])
    start = F.array().cast("array<struct<no:int,item:string>>")

    def step(acc, e):
        used = F.size(F.filter(acc, lambda a: a["no"] == e["no"]))
        ok = (
            (F.size(acc) < final_k) & (used < F.element_at(limits, e["no"] + 1))
            & ~F.exists(acc, lambda a: a["item"] == e["item"])
        )
        return F.when(ok, F.concat(acc, F.array(F.struct(e["no"].alias("no"), e["item"].alias("item"))))).otherwise(acc)

    pools = parts.groupBy("user_id").agg(F.array_sort(F.collect_list("e")).alias("pool"))
    picked = pools.select("user_id", F.posexplode(F.aggregate("pool", start, step)).alias("pos", "x"))
    names = F.array(*[F.lit(n) for n in routes])
    return picked.select(
        "user_id", F.col("x.item").alias("item_id"), (F.col("pos") + 1).alias("rank"),
        F.element_at(names, F.col("x.no") + 1).alias("route"))


def recall_lists(fused: DataFrame) -> DataFrame:
    """One comma-joined list per user with its length."""
    arr = F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda e: e["item_id"])
    return fused.groupBy("user_id").agg(F.array_join(arr, ",").alias("recall_list"), F.count(F.lit(1)).alias("list_length"))


def with_cold_users(requests: DataFrame, fused: DataFrame, pop: DataFrame, k: int) -> DataFrame:
    """Users without a list get the popular head and a flag."""
    known = fused.select("user_id").distinct().withColumn("known", F.lit(True))
    cold = requests.select("user_id").distinct().join(known, "user_id", "left_anti")
    head = pop.filter(F.col("pos") <= k).select("item_id", F.col("pos").cast("int").alias("rank"))
    span = cold.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(k))))
    filled = span.join(F.broadcast(head), "rank").select("user_id", "item_id", "rank", F.lit(True).alias("is_cold_start"))
    warm = fused.join(requests.select("user_id").distinct(), "user_id", "left_semi").select(
        "user_id", "item_id", F.col("rank").cast("int").alias("rank"), F.lit(False).alias("is_cold_start"))
    return warm.unionByName(filled)


def recall_table(fused: DataFrame) -> DataFrame:
    """Stored recall set: rank, pipe-joined routes, score rounded to 6, route count."""
    return fused.select(
        "user_id", "item_id", "recall_rank", F.array_join("routes", "|").alias("routes"),
        F.round("score", 6).alias("score"), "n_routes")


def hot_items(pop: DataFrame, n: int = C.HOT_TOP_N) -> DataFrame:
    return pop.filter(F.col("pos") <= n).select("item_id")


def recall_diagnostics(fused: DataFrame, truth: DataFrame, pop: DataFrame, catalog: DataFrame,
                       k: int = C.RECALL_FINAL_K, hot: int = C.HOT_TOP_N) -> DataFrame:
    """recall@k, user hit share, rows per user, coverage, hot share, multi-route share and the
    share of users with at least one row per route."""
    basket = truth.select("user_id", "item_id").distinct().withColumn("hit", F.lit(1))
    sizes = basket.groupBy("user_id").agg(F.count(F.lit(1)).alias("size"))
    hot_tab = F.broadcast(hot_items(pop, hot).withColumn("hot", F.lit(1)))
    tagged = (
        fused.join(basket, ["user_id", "item_id"], "left").join(hot_tab, "item_id", "left").join(sizes, "user_id")
    )
    routes = ("popular", "similar", "user_vec")
    per = tagged.groupBy("user_id").agg(
        F.first("size").alias("size"), F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("hit", F.lit(0))).alias("hits"),
        F.sum(F.coalesce("hot", F.lit(0))).alias("hot"), F.sum((F.col("n_routes") >= 2).cast("int")).alias("multi"),
        *[F.max(F.array_contains("routes", r).cast("double")).alias(f"has_{r}") for r in routes])
    library = catalog.select(F.count_distinct("item_id").alias("c")).scalar()
    distinct = fused.join(sizes, "user_id", "left_semi").select(F.count_distinct("item_id").alias("c")).scalar()
    return per.agg(
        F.count(F.lit(1)).alias("n_users"), F.avg(F.col("hits") / F.col("size")).alias("recall_at_k"),
        F.avg((F.col("hits") > 0).cast("double")).alias("user_hit_share"), F.avg("n").alias("rows_per_user"),
        (F.sum("hot") / F.sum("n")).alias("hot_share"), (F.sum("multi") / F.sum("n")).alias("multi_route_share"),
        *[F.avg(f"has_{r}").alias(f"users_with_{r}") for r in routes],
    ).withColumn("coverage", distinct / library)


def list_coverage(fused: DataFrame, catalog: DataFrame, pop: DataFrame, k: int = C.RECALL_FINAL_K,
                  hot: int = C.HOT_TOP_N) -> DataFrame:
    """Total rows, distinct items, coverage, hot share, mean length and share of full lists."""
    library = catalog.select(F.count_distinct("item_id").alias("c")).scalar()
    hot_tab = F.broadcast(hot_items(pop, hot).withColumn("hot", F.lit(1)))
    distinct = fused.select(F.count_distinct("item_id").alias("c")).scalar()
    inside = fused.join(catalog.select("item_id"), "item_id", "left_semi").select(
        F.count_distinct("item_id").alias("c")).scalar()
    per = fused.join(hot_tab, "item_id", "left").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("hot", F.lit(0))).alias("hot"))
    return per.agg(
        F.count(F.lit(1)).alias("n_users"), F.sum("n").alias("n_rows"), (F.sum("hot") / F.sum("n")).alias("hot_share"),
        F.avg("n").alias("mean_length"), F.avg((F.col("n") >= k).cast("double")).alias("full_share"),
    ).withColumn("n_unique", distinct).withColumn("coverage", inside / library)


def top10_overlap(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """Mean and median Jaccard of two top-k lists per user."""
    tagged = a.filter(F.col("rank") <= k).select("user_id", "item_id", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        b.filter(F.col("rank") <= k).select("user_id", "item_id", F.lit(0).alias("a"), F.lit(1).alias("b")))
    per = tagged.groupBy("user_id", "item_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).groupBy("user_id").agg(
        (F.sum(F.col("a") * F.col("b")) / F.count(F.lit(1))).alias("jac"))
    return per.agg(F.count(F.lit(1)).alias("n_users"), F.avg("jac").alias("jaccard_mean"),
                   F.percentile("jac", F.lit(0.5)).alias("jaccard_median"))


def pick_cases(truth: DataFrame, good: DataFrame, base: DataFrame, low: int = 3, high: int = 30, k: int = 10,
               n: int = 2, prefer_win: bool = True) -> DataFrame:
    """Users with a basket of low..high items, those where ``good`` hits and ``base`` misses first
    (``prefer_win=False`` gives the opposite order), then larger baskets, then user id."""
    basket = truth.select("user_id", "item_id").distinct()
    sizes = basket.groupBy("user_id").agg(F.count(F.lit(1)).alias("basket_size")).filter(
        F.col("basket_size").between(low, high))

    def hits(recs, name):
        return recs.filter(F.col("rank") <= k).join(basket, ["user_id", "item_id"], "left_semi").select(
            "user_id").distinct().withColumn(name, F.lit(True))

    tagged = sizes.join(hits(good, "good_hit"), "user_id", "left").join(hits(base, "base_hit"), "user_id", "left").na.fill(
        False, ["good_hit", "base_hit"])
    win = F.col("good_hit") & ~F.col("base_hit")
    first = win.desc() if prefer_win else win.asc()
    return tagged.orderBy(first, F.col("basket_size").desc(), "user_id").limit(n)
