"""Spark ML learners, out-of-fold replay training, factor models and parameter sweeps."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    FMClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.feature import OneHotEncoder, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise import schema as C
from shelfwise.functions import ranks as R
from shelfwise.functions import scalar as S
from shelfwise.operators import metrics as M, replay as Rp
from shelfwise.operators.grids import grid_group_metrics
from shelfwise.operators.tree_models import linear_scores, prefix_scores
from shelfwise.session import settle


def _assembled(features):
    return VectorAssembler(inputCols=list(features), outputCol="x", handleInvalid="keep")


def logistic(features, c: float = 1.0, weight: str | None = None, weight_sum: float = 1.0, max_iter: int = 100) -> Pipeline:
    """Standardised logistic regression with inverse regularisation strength ``c``."""
    scaler = StandardScaler(inputCol="x", outputCol="z", withMean=True, withStd=True)
    lr = LogisticRegression(featuresCol="z", labelCol="label", maxIter=max_iter, standardization=False,
                            regParam=1.0 / (c * weight_sum), elasticNetParam=0.0)
    return Pipeline(stages=[_assembled(features), scaler, lr.setWeightCol(weight) if weight else lr])


def boosted_trees(features, weight: str | None = None, trees: int = 50, depth: int = 5, step: float = 0.05,
                  subsample: float = 0.8, columns: str = "0.8", min_rows: int = 20, seed: int = C.SEED) -> Pipeline:
    gbt = GBTClassifier(featuresCol="x", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=step,
                        subsamplingRate=subsample, featureSubsetStrategy=columns, minInstancesPerNode=min_rows, seed=seed)
    return Pipeline(stages=[_assembled(features), gbt.setWeightCol(weight) if weight else gbt])


def boosted_trees_alt(features, weight: str | None = None, trees: int = 50, depth: int = 6, seed: int = 7) -> Pipeline:
    """A second boosted configuration: deeper trees, other seed, half of the columns."""
    return boosted_trees(features, weight, trees, depth, 0.05, 0.8, "0.5", 5, seed)


def forest(features, weight: str | None = None, trees: int = 100, depth: int = 6, seed: int = C.SEED) -> Pipeline:
    """Third tree family: a random forest, less correlated with the boosted ones."""
    rf = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[_assembled(features), rf.setWeightCol(weight) if weight else rf])


def weight_total(rows: DataFrame, weight: str | None = None) -> float:
    """Sum of the weights, or the number of rows without weights; the strength of regularisation is relative to it."""
    one = F.lit(1.0) if weight is None else F.col(weight)
    return float(rows.agg(F.coalesce(F.sum(one), F.lit(0.0)).alias("t")).first()["t"]) or 1.0


def logistic_on(rows: DataFrame, features, c: float = 1.0, weight: str | None = None, max_iter: int = 100) -> Pipeline:
    """``logistic`` with the weight total of the training rows."""
    return logistic(features, c, weight, weight_total(rows, weight), max_iter)


def id_encoder(known: DataFrame, features):
    """Function that adds vector ``x``: dense columns and one column per known user and item id; other ids have no column.

    Codes are positions in id order, so the vector is as wide as the data needs; an unknown id takes the one code
    that the encoder drops.
    """
    users = R.global_position(known.select("user_id").distinct(), [F.col("user_id")], "user_code").persist()
    items = R.global_position(known.select("item_id").distinct(), [F.col("item_id")], "item_code").persist()
    n_users, n_items = users.count(), items.count()
    spark = known.sparkSession
    stages = [
        OneHotEncoder(inputCols=[c], outputCols=[o], dropLast=True).fit(spark.range(n + 1).select(F.col("id").alias(c)))
        for c, o, n in (("user_code", "__u", n_users), ("item_code", "__i", n_items))]
    stages.append(VectorAssembler(inputCols=[*features, "__u", "__i"], outputCol="x"))

    def encode(rows: DataFrame) -> DataFrame:
        coded = rows.join(users, "user_id", "left").join(items, "item_id", "left").na.fill(
            {"user_code": n_users, "item_code": n_items})
        for stage in stages:
            coded = stage.transform(coded)
        return coded.drop("user_code", "item_code", "__u", "__i")

    return encode


def copies_by_weight(rows: DataFrame, weight: str, keys, mean_copies: float = 2.0, seed: int = C.SEED) -> DataFrame:
    """Adds ``copies``, whose expectation is the weight times a common scale: ``mean_copies`` over the mean weight.

    A row gets the whole part of its scaled weight, and one more by an md5 draw on the fraction, so a row's copies miss
    their expectation by less than one (variance at most 1/4), and the sum over m rows by a standard error of at most
    sqrt(m) / 2. A larger ``mean_copies`` makes the error smaller.
    """
    mean = rows.agg(F.avg(weight).alias("m")).first()["m"] or 1.0
    scaled = F.col(weight) * F.lit(round(mean_copies / mean, 6))
    head = F.conv(F.substring(S.md5_key(*[F.col(k).cast("string") for k in keys], seed, "copies"), 1, 7), 16, 10)
    more = head.cast("double") / F.lit(float(1 << 28)) < scaled - F.floor(scaled)
    return rows.withColumn("copies", F.floor(scaled).cast("long") + more.cast("long"))


def replicate_by_weight(rows: DataFrame, weight: str, keys, mean_copies: float = 2.0, seed: int = C.SEED) -> DataFrame:
    """Every row as many times as its ``copies``: a learner without row weights then fits the weighted rows."""
    counted = copies_by_weight(rows, weight, keys, mean_copies, seed).filter(F.col("copies") > 0)
    return counted.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("__k", "copies")


def factorization(factor: int = 16, max_iter: int = 50, step: float = 0.02, reg: float = 1e-4, seed: int = C.SEED) -> FMClassifier:
    """Factorization machine over a prepared vector ``x``.  Spark's learner has no row
    weights; ``replicate_by_weight`` gives them to it."""
    return FMClassifier(featuresCol="x", labelCol="label", factorSize=factor, maxIter=max_iter, stepSize=step,
                        regParam=reg, solver="adamW", seed=seed)


def sampled_pairs(rows: DataFrame, features, by=("ym", "user_id"), per_positive: int = 20, seed: int = C.SEED) -> DataFrame:
    """Positives against sampled negatives of the same list: by, item_id, other (the negative), label, feature differences.

    The ranking loss is defined over sampled pairs: the negatives of a list are numbered in hash order and every
    positive draws ``per_positive`` numbers by hash, so each draw meets exactly one negative and all pairs of a
    list are never formed. The numbers come from one range sort over all lists, so no list is sorted by one task.
    """
    by, diff = list(by), [*features]
    key = lambda *p: F.xxhash64(*by, *p, F.lit(seed))
    neg = R.global_position(rows.filter(F.col("label") == 0).select(*by, "item_id", *diff),
                            [*[F.col(c) for c in by], key("item_id"), F.col("item_id")], "__pos")
    sizes = neg.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.min("__pos").alias("__lo"))
    neg = neg.select(*by, F.col("__pos").alias("__slot"), F.col("item_id").alias("other"), *[F.col(c).alias(f"n_{c}") for c in diff])
    pos = rows.filter(F.col("label") == 1).join(sizes, by).withColumn(
        "__d", F.explode(F.sequence(F.lit(1), F.lit(per_positive)))
    ).withColumn("__slot", F.col("__lo") + F.pmod(key("item_id", "__d"), F.col("__n"))).select(*by, "__slot", "item_id", "__d", *diff)
    pairs = pos.join(neg, by + ["__slot"])
    flip = F.pmod(key("item_id", "__d", F.lit("flip")), F.lit(2)) == 0
    sign = F.when(flip, -1.0).otherwise(1.0)
    return pairs.select(*by, "item_id", "other", F.when(flip, 0).otherwise(1).alias("label"),
                        *[(sign * (F.col(c) - F.col(f"n_{c}"))).alias(c) for c in diff])


def pairwise_rows(rows: DataFrame, features, by=("ym", "user_id"), per_positive: int = 20, seed: int = C.SEED) -> DataFrame:
    """Feature differences of ``sampled_pairs``."""
    return sampled_pairs(rows, features, by, per_positive, seed).drop("other")


def pairwise_ranker(features, reg: float = 1e-3, max_iter: int = 100, weight: str | None = None) -> Pipeline:
    """Linear ranker: logistic regression on pair differences without intercept."""
    lr = LogisticRegression(featuresCol="x", labelCol="label", fitIntercept=False, regParam=reg, maxIter=max_iter)
    return Pipeline(stages=[_assembled(features), lr.setWeightCol(weight) if weight else lr])


def list_discounts(scored: DataFrame, by=("ym", "user_id"), score: str = "score") -> DataFrame:
    """by, item_id, label, gain (1 / log2(1 + rank) by descending score, ties averaged), ideal (DCG of the best order)."""
    by = list(by)
    ranked = R.average_rank(scored, by, score, "__r", "__n")
    rows = ranked.select(*by, "item_id", "label", (1.0 / F.log2(F.col("__n") + 2.0 - F.col("__r"))).alias("gain"))
    p = rows.filter(F.col("label") == 1).groupBy(*by).agg(F.count(F.lit(1)).alias("__p"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("__p").cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    return rows.join(p.select(*by, ideal.alias("ideal")), by)


def mean_ndcg(discounts: DataFrame, by=("ym", "user_id")) -> float:
    """Mean NDCG over lists with a positive."""
    lists = discounts.groupBy(*by).agg((F.sum(F.col("label") * F.col("gain")) / F.first("ideal")).alias("v"))
    return float(lists.agg(F.coalesce(F.avg("v"), F.lit(0.0)).alias("v")).first()["v"])


def list_ranker(rows: DataFrame, features, by=("ym", "user_id"), rounds: int = 4, tolerance: float = 1e-3,
                per_positive: int = 20, reg: float = 1e-3) -> PipelineModel:
    """Linear list-wise ranker: every sampled pair weighs as much as its swap changes the NDCG of its list.

    The first fit counts pairs alike. Each round scores the rows with the last model, ranks them inside their lists,
    weights the pairs by |1/log2(1 + r_i) - 1/log2(1 + r_j)| / ideal DCG and fits again, until the direction of the
    coefficients moves by less than ``tolerance`` or ``rounds`` are over. The model with the highest mean NDCG on the
    training lists is kept, so the weights never make it worse there.
    """
    by = list(by)
    pairs = settle(sampled_pairs(rows, features, by, per_positive))
    model = pairwise_ranker(features, reg).fit(pairs)
    best, value, last = model, None, None
    for turn in range(rounds + 1):
        scored = add_margin(model, rows.select(*by, "item_id", "label", *features)).select(*by, "item_id", "label", "score")
        places = settle(list_discounts(scored, by))
        now = mean_ndcg(places, by)
        if value is None or now > value:
            best, value = model, now
        w = model.stages[-1].coefficients.toArray()
        w = w / (float((w * w).sum()) ** 0.5 or 1.0)
        if turn == rounds or last is not None and float(((w - last) ** 2).sum()) ** 0.5 < tolerance:
            break
        last = w
        own = places.select(*by, "item_id", F.col("gain").alias("__g"), F.col("ideal").alias("__i"))
        other = places.select(*by, F.col("item_id").alias("other"), F.col("gain").alias("__h"))
        weighted = pairs.join(own, by + ["item_id"]).join(other, by + ["other"]).withColumn(
            "weight", F.abs(F.col("__g") - F.col("__h")) / F.col("__i"))
        model = pairwise_ranker(features, reg, weight="weight").fit(weighted)
    return best


def add_probability(model, rows: DataFrame, out: str = "score") -> DataFrame:
    scored = model.transform(rows).withColumn(out, vector_to_array("probability")[1])
    return scored.drop("x", "z", "rawPrediction", "probability", "prediction")


def add_margin(model: PipelineModel, rows: DataFrame, out: str = "score") -> DataFrame:
    """Linear score of a pairwise ranker on single rows."""
    scored = model.transform(rows).withColumn(out, vector_to_array("rawPrediction")[1])
    return scored.drop("x", "rawPrediction", "probability", "prediction")


def equal_group_weight(rows: DataFrame) -> DataFrame:
    return Rp.weight_equal_group(rows)


def out_of_fold(rows: DataFrame, months, learner, weigh=None, last_k: int | None = None, score: str = "score",
                parallel: int = 1, keep=("ym", "user_id", "item_id", "label")) -> DataFrame:
    """For every month after the first: fit on earlier months, score that month.

    ``learner`` takes the training rows and returns an estimator; ``weigh`` adds their weight column.  Folds
    are few (one per month) and independent, so they may be submitted side by side.
    """
    def fold(item):
        target, train_months = item
        train = rows.filter(F.col("ym").isin(train_months))
        if weigh is not None:
            train = weigh(train)
        model = learner(train).fit(train)
        return add_probability(model, rows.filter(F.col("ym") == target), score).select(*keep, score)

    folds = Rp.forward_folds(list(months), last_k=last_k)
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        parts = list(pool.map(fold, folds))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def out_of_fold_ranker(rows: DataFrame, months, features, score: str = "score", rounds: int = 2, parallel: int = 4) -> DataFrame:
    """Every later month scored by the list-wise ranker of the months before it; folds run side by side."""
    def fold(item):
        target, train_months = item
        model = list_ranker(rows.filter(F.col("ym").isin(train_months)), features, rounds=rounds)
        return add_margin(model, rows.filter(F.col("ym") == target), score).select("ym", "user_id", "item_id", "label", score)

    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        parts = list(pool.map(fold, Rp.forward_folds(list(months))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def expert_pair(train: DataFrame, rows: DataFrame, learner, flag: str = "ui_owned", score: str = "score") -> DataFrame:
    """One model for first purchases and one for repurchases, each scoring its own rows."""
    out = None
    for value in (0, 1):
        own = train.filter(F.col(flag) == value)
        model = learner(own).fit(own)
        part = add_probability(model, rows.filter(F.col(flag) == value), score)
        out = part if out is None else out.unionByName(part)
    return out


# ------------------------------------------------------------------ factor models
def purchase_confidence(hist: DataFrame, cut=None, tau: float | None = None) -> DataFrame:
    """(user, item, r): 1 per distinct pair, or the sum of exp(-age/tau) over its rows."""
    if tau is None:
        return hist.select("user_id", "item_id").distinct().withColumn("r", F.lit(1.0))
    decayed = S.decay(S.frac_days("ts", S.at(cut)), tau)
    return hist.groupBy("user_id", "item_id").agg(F.sum(decayed).alias("r"))


def implicit_factors(conf: DataFrame, rank: int = 48, reg: float = 5.0, alpha: float = 30.0, iterations: int = 18,
                     seed: int = C.SEED):
    """Implicit-feedback ALS.  Returns (model, index); users and items of any type get dense codes, kept in ``index``
    as a pair of frames."""
    users = R.global_position(conf.select("user_id").distinct(), [F.col("user_id")], "u").persist()
    items = R.global_position(conf.select("item_id").distinct(), [F.col("item_id")], "i").persist()
    coded = conf.join(users, "user_id").join(items, "item_id").select(
        F.col("u").cast("int").alias("u"), F.col("i").cast("int").alias("i"), F.col("r").cast("float").alias("r"))
    als = ALS(userCol="u", itemCol="i", ratingCol="r", rank=rank, regParam=reg, alpha=alpha, maxIter=iterations,
              implicitPrefs=True, nonnegative=False, coldStartStrategy="nan", seed=seed)
    return als.fit(coded), (users, items)


def factor_scores(rows: DataFrame, model, index, out: str = "als", popularity: DataFrame | None = None,
                  gamma: float = 0.0) -> DataFrame:
    """Dot product of user and item factors; unknown ids score 0; optional popularity term."""
    users, items = index
    users = model.userFactors.join(users, F.col("id") == F.col("u")).select("user_id", F.col("features").alias("fu"))
    items = model.itemFactors.join(items, F.col("id") == F.col("i")).select("item_id", F.col("features").alias("fi"))
    prod = F.aggregate(F.zip_with("fu", "fi", lambda a, b: (a * b).cast("double")), F.lit(0.0), lambda s, v: s + v)
    out_df = rows.join(users, "user_id", "left").join(items, "item_id", "left").withColumn(out, F.coalesce(prod, F.lit(0.0))).drop("fu", "fi")
    if popularity is not None:
        out_df = out_df.join(popularity.select("item_id", F.log1p("weight").alias("__pop")), "item_id", "left").withColumn(
            out, F.col(out) + F.lit(gamma) * F.coalesce("__pop", F.lit(0.0))).drop("__pop")
    return out_df


# ------------------------------------------------------------------ reports
def contribution_report(model: PipelineModel, features) -> list[tuple[str, float]]:
    """(feature, value) by absolute size: coefficients of a linear model, gain of a tree model."""
    last = model.stages[-1]
    values = last.coefficients if hasattr(last, "coefficients") else last.featureImportances
    return sorted(zip(features, [float(v) for v in values.toArray()]), key=lambda t: -abs(t[1]))


def _config_auc(scored: DataFrame, configs: dict[str, str]) -> DataFrame:
    """Macro and weighted group AUC per score column (column -> configuration), from one pass over the rows."""
    columns = list(configs)
    unit = [tuple(float(i == k) for i in range(len(columns))) for k in range(len(columns))]
    config = F.element_at(F.array(*[F.lit(n) for n in configs.values()]), F.col("weight_id") + 1)
    return grid_group_metrics(scored, columns, unit).groupBy(config.alias("config")).agg(*M.auc_aggregates())


def linear_sweep(rows: DataFrame, months, features, windows, alphas, cs, max_iter: int = 100, parallel: int = 4) -> DataFrame:
    """config, group AUCs of standardised logistic models over forward folds: training window x exponent of the group
    weight x inverse regularisation.

    A fold's vectors are standardised and stored once per set of training months; the strengths of one weight share
    its rows; windows that hold the same months share their fits.
    """
    folds = {w: dict(Rp.forward_folds(list(months), last_k=w)) for w in windows}
    jobs = sorted({(tuple(train), a) for f in folds.values() for train in f.values() for a in alphas})
    prepared = {}
    for train_months in sorted({t for t, _ in jobs}):
        train = Rp.weight_group_power(rows.filter(F.col("ym").isin(list(train_months))), 1.0)
        scaler = Pipeline(stages=[_assembled(features), StandardScaler(inputCol="x", outputCol="z", withMean=True, withStd=True)]).fit(train)
        prepared[train_months] = scaler.stages[-1], settle(scaler.transform(train).select("label", "z", "weight"))

    def fit(job):
        train_months, alpha = job
        scaler, vectors = prepared[train_months]
        weighted = vectors.withColumn("weight", F.pow("weight", F.lit(alpha)))  # 1/n to the power alpha
        total = weight_total(weighted, "weight")
        lr = LogisticRegression(featuresCol="z", labelCol="label", maxIter=max_iter, standardization=False, weightCol="weight")
        models = lr.fit(weighted, [{lr.regParam: 1.0 / (c * total)} for c in cs])
        std = scaler.std.toArray()
        out = []
        for m in models:
            w = np.divide(m.coefficients.toArray(), std, out=np.zeros(len(std)), where=std > 0)
            out.append((w, float(m.intercept - w @ scaler.mean.toArray())))
        return out

    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        fitted = dict(zip(jobs, pool.map(fit, jobs)))
    grid = [(w, a, i) for w in windows for a in alphas for i in range(len(cs))]
    scored = None
    for target in dict(Rp.forward_folds(list(months))):
        models = {f"s{k}": fitted[tuple(folds[w][target]), a][i] for k, (w, a, i) in enumerate(grid)}
        part = linear_scores(rows.filter(F.col("ym") == target).select("ym", "user_id", "item_id", "label", *features), features, models)
        part = part.drop(*features)
        scored = part if scored is None else scored.unionByName(part)
    return _config_auc(scored, {f"s{k}": f"lr_w{w or 'all'}_a{a}_c{cs[i]}" for k, (w, a, i) in enumerate(grid)})


def tree_sweep(rows: DataFrame, months, features, grid: dict, counts, parallel: int = 2) -> DataFrame:
    """config, group AUCs of boosted configurations over forward folds at every tree count, one fit a fold each.

    ``grid``: name -> (arguments of ``boosted_trees``, exponent of the class ratio on positives); rows weigh 1/n of
    their list. A configuration's scores at all ``counts`` come from the longest fit.
    """
    counts = sorted(set(counts))
    train_sets = {}
    for target, train_months in Rp.forward_folds(list(months)):
        train_sets[target] = settle(Rp.weight_equal_group(rows.filter(F.col("ym").isin(train_months))).select("label", "weight", *features))

    def fold(item):
        target, name = item
        args, alpha = grid[name]
        train = train_sets[target]
        if alpha:
            ratio = Rp.class_ratio(train)
            train = train.withColumn("weight", F.when(F.col("label") == 1, F.col("weight") * F.pow(ratio, F.lit(alpha))).otherwise(F.col("weight")))
        return boosted_trees(features, "weight", trees=counts[-1], **args).fit(train)

    items = [(t, n) for t in train_sets for n in grid]
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        models = dict(zip(items, pool.map(fold, items)))
    scored = None
    for target in train_sets:
        part = rows.filter(F.col("ym") == target).select("ym", "user_id", "item_id", "label", *features)
        for k, name in enumerate(grid):
            part = prefix_scores(models[target, name], part, features, counts, f"s{k}")
        part = part.drop(*features)
        scored = part if scored is None else scored.unionByName(part)
    return _config_auc(scored, {f"s{k}_{c}": f"{n}_{c}" for k, n in enumerate(grid) for c in counts})
