"""Fitted boosted models as tables: nodes, split counts, and the scores of every prefix of their trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from shelfwise.sources.transactions import scratch_path


def _boosted(model):
    """The tree model itself, or the last stage of a pipeline model."""
    return model.stages[-1] if hasattr(model, "stages") else model


def tree_nodes(model) -> DataFrame:
    """One row per node of a saved tree model: tree, node, feature and threshold of its split, children, prediction, gain.

    Leaves have children -1. All splits are thresholds: the columns are numbers.
    """
    trees, spark = _boosted(model), SparkSession.active()
    path = scratch_path(spark, "trees")
    trees.write().overwrite().save(path)
    node = F.col("nodeData")
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), node["id"].alias("node"), node["split"]["featureIndex"].alias("feature"),
        F.get(node["split"]["leftCategoriesOrThreshold"], 0).alias("threshold"), node["leftChild"].alias("left"),
        node["rightChild"].alias("right"), node["prediction"].alias("prediction"), node["gain"].alias("gain"))


def split_counts(model, features) -> DataFrame:
    """feature, splits, gain: internal nodes that split on each feature (0 where none does) and the sum of their gains."""
    nodes = tree_nodes(model).where(F.col("left") >= 0)
    found = nodes.groupBy("feature").agg(F.count(F.lit(1)).alias("splits"), F.sum("gain").alias("gain"))
    names = found.sparkSession.createDataFrame(list(enumerate(features)), "feature int, name string")
    return names.join(found, "feature", "left").select(
        F.col("name").alias("feature"), F.coalesce("splits", F.lit(0)).alias("splits"), F.coalesce("gain", F.lit(0.0)).alias("gain"))


def prefix_scores(model, rows: DataFrame, features, counts, out: str = "score") -> DataFrame:
    """Adds ``<out>_<n>`` for every n of ``counts``: the probability after the first n trees, all from one pass.

    The node table goes to every task; its size is set by the number and depth of the trees.
    """
    trees, features, counts = _boosted(model), list(features), sorted(set(counts))
    weights = [float(w) for w in trees.treeWeights][:counts[-1]]
    if len(weights) < counts[-1]:
        raise ValueError(f"the model has {len(weights)} trees, {counts[-1]} are asked for")
    found = tree_nodes(trees).where(F.col("tree") < counts[-1]).orderBy("tree", "node").toArrow()
    tree = found.column("tree").to_numpy()
    starts = np.searchsorted(tree, np.arange(len(weights)))
    shift = starts[tree]  # children become places in the table
    left, right = (np.where(found.column(c).to_numpy() < 0, -1, found.column(c).to_numpy() + shift) for c in ("left", "right"))
    nodes = (np.maximum(found.column("feature").to_numpy(), 0), found.column("threshold").fill_null(0.0).to_numpy(), left, right,
             found.column("prediction").to_numpy())

    def run(batches):
        feature, threshold, left, right, prediction = nodes
        for batch in batches:
            x = np.stack([batch.column(c).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
                          for c in features], axis=1)
            margin, every, more = np.zeros(len(x)), np.arange(len(x)), []
            for t, w in enumerate(weights):
                at = np.full(len(x), starts[t])
                while (inner := left[at] >= 0).any():
                    low = x[every, feature[at]] <= threshold[at]
                    at = np.where(inner, np.where(low, left[at], right[at]), at)
                margin += w * prediction[at]
                if t + 1 in counts:
                    more.append(pa.array(1.0 / (1.0 + np.exp(-2.0 * margin))))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *names])

    names = [f"{out}_{n}" for n in counts]
    schema = StructType(rows.schema.fields + [StructField(n, DoubleType()) for n in names])
    return rows.mapInArrow(run, schema)


def linear_scores(rows: DataFrame, features, models: dict[str, tuple[np.ndarray, float]]) -> DataFrame:
    """Adds the probability of every named linear model (coefficients over ``features``, intercept) in one pass."""
    features, names = list(features), list(models)
    weights = np.stack([np.asarray(models[n][0], np.float64) for n in names], axis=1)
    intercepts = np.array([models[n][1] for n in names])

    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(c).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
                          for c in features], axis=1)
            p = 1.0 / (1.0 + np.exp(-(x @ weights + intercepts)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(np.ascontiguousarray(p[:, i])) for i in range(len(names))]], [*batch.schema.names, *names])

    return rows.mapInArrow(run, StructType(rows.schema.fields + [StructField(n, DoubleType()) for n in names]))
