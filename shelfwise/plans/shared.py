"""Frames several families start from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import scalar as S
from shelfwise.operators import replay
from shelfwise.schema import MONTH_CUTS
from shelfwise.session import drop_shuffles, ensure_checkpoint_dir
from shelfwise.sources import retail, transactions as T


def stored(spark, d, name: str, build) -> DataFrame:
    """A frame built once per input: stored in the checkpoint folder, found again by the state of the input files."""
    ensure_checkpoint_dir(spark)
    tables = [f"{d}/{t}.parquet" for t in ("lineitem", "orders", "part", "customer", "nation")]
    out = T.read_or_build(spark, f"{spark.sparkContext.getCheckpointDir()}/shared-{name}", build, tables)
    drop_shuffles(spark)
    return out


def candidates(spark, d) -> DataFrame:
    return stored(spark, d, "candidates", lambda: retail.candidate_pairs(spark, d))


def replay_rows(spark, d) -> DataFrame:
    return replay.replay(retail.retail_view(spark, d), candidates(spark, d), MONTH_CUTS)


def predictions(spark, d) -> DataFrame:
    """Replay rows of all months with three history scores standing for model scores."""
    def build():
        rows = replay.with_item_history(replay_rows(spark, d), retail.retail_view(spark, d), MONTH_CUTS)
        return rows.select(
            "ym", "cut", "user_id", "item_id", "label", "prior_bought",
            (F.col("buyers") / (F.col("buyers") + 50.0)).alias("s_pop"),
            (F.lit(1.0) / (1 + S.whole_days("last_ts", F.col("cut")))).alias("s_rec"),
            (F.col("n_ord") + F.col("buyers") / 1000.0).alias("s_own"),
        )

    return stored(spark, d, "predictions", build)
