"""Dense item and user vectors: unit length, means, exact nearest neighbours."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import ranks as R

BLOCK_ROWS = 4096


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a):
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))


def unit(a):
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda v: v / n)).otherwise(a)


def unit_vectors(df: DataFrame, vec: str = "vec") -> DataFrame:
    return df.withColumn(vec, unit(F.col(vec)))


def mean_vectors(owned: DataFrame, vectors: DataFrame, by=("user_id",), normalise_items: bool = True,
                 normalise_mean: bool = False) -> DataFrame:
    """Mean vector of the items a user owns; users without any known item are left out.

    ``normalise_items`` averages unit vectors, otherwise raw ones; ``normalise_mean`` scales the
    mean to unit length.  The mean is a JVM aggregate with map-side partials.
    """
    vecs = unit_vectors(vectors) if normalise_items else vectors
    mean = (
        owned.select(*by, "item_id").distinct().join(vecs, "item_id")
        .groupBy(*by).agg(vector_to_array(Summarizer.mean(array_to_vector("vec"))).alias("vec"))
    )
    return unit_vectors(mean) if normalise_mean else mean


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, k: int,
            extra: str | None = None, skip_same: bool = True, positive_only: bool = False,
            n_left: int | None = None, n_right: int | None = None, block: int = BLOCK_ROWS) -> DataFrame:
    """Exact top-k right rows per left row by dot product of ``vec``.

    Both sides are cut into blocks by hash; every (left block, right block) pair is one bounded
    task that multiplies two small matrices and returns only the best k (plus ``extra``, an
    integer column of the left side) of each left row.  The per-block heads are then merged by
    a top-k window, so the full similarity matrix never exists as rows.
    """
    n_left = left.count() if n_left is None else n_left
    n_right = right.count() if n_right is None else n_right
    lb, rb = max(1, math.ceil(n_left / block)), max(1, math.ceil(n_right / block))
    extra_col = F.col(extra).cast("long") if extra else F.lit(0).cast("long")
    lrows = left.select(
        F.col(left_id).cast("string").alias("id"), F.col("vec"), extra_col.alias("more"),
        F.lit(0).alias("side"), F.pmod(F.xxhash64(left_id), F.lit(lb)).cast("int").alias("lb"),
        F.explode(F.sequence(F.lit(0), F.lit(rb - 1))).alias("rb"),
    )
    rrows = right.select(
        F.col(right_id).cast("string").alias("id"), F.col("vec"), F.lit(0).cast("long").alias("more"),
        F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.lit(lb - 1))).alias("lb"),
        F.pmod(F.xxhash64(right_id), F.lit(rb)).cast("int").alias("rb"),
    ).select(lrows.columns)

    def block_heads(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.side == 0], pdf[pdf.side == 1]
        empty = pd.DataFrame({"lid": pd.Series(dtype=str), "rid": pd.Series(dtype=str),
                              "sim": pd.Series(dtype=float), "keep": pd.Series(dtype="int64")})
        if a.empty or b.empty:
            return empty
        b = b.sort_values("id", kind="stable")
        ids = b["id"].to_numpy()
        m = np.stack(b["vec"].to_numpy()).astype(float)
        out = []
        for start in range(0, len(a), 512):
            part = a.iloc[start:start + 512]
            sims = np.round(np.stack(part["vec"].to_numpy()).astype(float) @ m.T, 10)
            keep = (k + part["more"]).to_numpy()
            take = min(len(ids), int(keep.max()) + (1 if skip_same else 0))
            best = np.argsort(-sims, axis=1, kind="stable")[:, :take]
            lid = np.repeat(part["id"].to_numpy(), take)
            inside = (np.arange(take)[None, :] < (keep[:, None] + int(skip_same))).ravel()
            got = pd.DataFrame({
                "lid": lid, "rid": ids[best].ravel(), "sim": np.take_along_axis(sims, best, 1).ravel(),
                "keep": np.repeat(keep, take),
            })[inside]
            out.append(got)
        got = pd.concat(out, ignore_index=True)
        if skip_same:
            got = got[got.lid != got.rid]
        return got[got.sim > 0] if positive_only else got

    heads = (
        lrows.unionByName(rrows).groupBy("lb", "rb")
        .applyInPandas(block_heads, "lid string, rid string, sim double, keep long")
    )
    best_first = [F.col("sim").desc(), F.col("rid")]
    if extra:
        w = Window.partitionBy("lid").orderBy(*best_first)
        ranked = heads.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.col("keep"))
    else:
        ranked = R.top_k(heads, ["lid"], best_first, k)
    return ranked.select(
        F.col("lid").cast(left.schema[left_id].dataType).alias(left_id),
        F.col("rid").alias("item_id" if left_id != "item_id" else "neighbor"), "sim", "rank",
    )


def all_pairs_top_k(vectors: DataFrame, k: int = 20) -> DataFrame:
    """k nearest items of every item by cosine: item_id, neighbor, sim, rank."""
    u = unit_vectors(vectors).persist()
    return nearest(u, u, "item_id", "item_id", k)


def similar_to(vectors: DataFrame, item_id: str, k: int) -> DataFrame:
    """Nearest items of one item: one query vector as a scalar, then a global top-k."""
    u = unit_vectors(vectors)
    q = u.filter(F.col("item_id") == item_id).select("vec").scalar()
    return (
        u.filter(F.col("item_id") != item_id).withColumn("q", q).select("item_id", F.round(dot("vec", "q"), 10).alias("sim"))
        .orderBy(F.col("sim").desc(), "item_id").limit(k)
    )


def recommend(user_vectors: DataFrame, vectors: DataFrame, owned: DataFrame, k: int,
              positive_only: bool = False, normalise_items: bool = True) -> DataFrame:
    """Top-k not-owned items per user by similarity to the user vector.

    Asks for k plus the number of owned items with a vector, then drops the owned ones: exact
    without pushing the owned sets into the similarity step.
    """
    vecs = unit_vectors(vectors) if normalise_items else vectors
    own = owned.select("user_id", "item_id").distinct()
    n_own = own.join(vecs.select("item_id"), "item_id", "left_semi").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_own"))
    left = user_vectors.join(n_own, "user_id", "left").na.fill(0, ["n_own"]).persist()
    near = nearest(left, vecs.persist(), "user_id", "item_id", k, extra="n_own", skip_same=False,
                   positive_only=positive_only)
    fresh = near.drop("rank").join(own, ["user_id", "item_id"], "left_anti")
    return R.top_k(fresh, ["user_id"], [F.col("sim").desc(), F.col("item_id")], k)
