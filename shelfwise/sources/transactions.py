"""Readers and writers for transaction, product, candidate and result files."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from shelfwise.schema import RAW_COLUMNS, RAW_FILE_SCHEMA, RAW_HEADER
from shelfwise.session import ensure_checkpoint_dir

FILE_TIME_FORMAT = "M/d/yyyy H:mm"  # fixed value: time format of the transaction file


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def read_transactions(spark: SparkSession, path: str, encoding: str = "ISO-8859-1",
                      time_format: str = FILE_TIME_FORMAT) -> DataFrame:
    """Order lines from CSV; ids stay strings, the user id is cast later by ``load_clean``."""
    raw = spark.read.schema(RAW_FILE_SCHEMA).option("encoding", encoding).csv(path, header=True)
    out = raw.select(*[F.col(h).alias(c) for h, c in zip(RAW_HEADER, RAW_COLUMNS)])
    return out.withColumn("ts", F.try_to_timestamp(F.col("ts"), F.lit(time_format)).cast("timestamp_ntz"))


def write_transactions(df: DataFrame, path: str, encoding: str = "ISO-8859-1",
                       time_format: str = FILE_TIME_FORMAT) -> None:
    """The same eight columns in file order under their file names."""
    cols = [
        (F.date_format(c, time_format) if c == "ts" else F.col(c)).alias(h)
        for h, c in zip(RAW_HEADER, RAW_COLUMNS)
    ]
    df.select(*cols).write.mode("overwrite").option("encoding", encoding).csv(path, header=True)


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """Product dimension from UTF-8 CSV; a byte order mark before the header is dropped."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8")
    clean = [c.replace("﻿", "").strip() for c in raw.columns]
    raw = raw.toDF(*clean)
    names = {"StockCode": "item_id", "Description": "descr",
             "Chinese_Description": "descr_zh", "Product_Category": "category"}
    return raw.select(*[
        (F.col(h) if h in clean else F.lit(None).cast("string")).alias(c) for h, c in names.items()
    ])


def load_clean(df: DataFrame) -> DataFrame:
    """User to bigint (unreadable -> NULL), item to string, time to timestamp."""
    return (
        df.withColumn("user_id", F.expr("try_cast(try_cast(user_id AS double) AS bigint)"))
        .withColumn("item_id", F.col("item_id").cast("string"))
        .withColumn("ts", F.expr("try_cast(ts AS timestamp_ntz)"))
    )


def clean_or_raw(spark: SparkSession, clean_path: str, raw_path: str) -> DataFrame:
    """The cleaned file if it exists, else the raw one."""
    if path_exists(spark, clean_path):
        return load_clean(read_transactions(spark, clean_path, encoding="UTF-8"))
    return load_clean(read_transactions(spark, raw_path))


# Accepted spellings of the two candidate columns, compared in lower case.
CANDIDATE_ALIASES = {
    "user_id": ["user_id", "customerid", "customer_id"],
    "item_id": ["item_id", "stockcode", "stock_code"],
}


def _file_order(df: DataFrame) -> list | None:
    """Columns that give the place of a row in its files: path, block, and place in the block; None without files."""
    try:
        df.select("_metadata.file_path", "_metadata.file_block_start")
    except AnalysisException:
        return None
    return [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]


def read_candidates(df: DataFrame, order=None) -> DataFrame:
    """Candidate pairs under any accepted header: user bigint, item kept verbatim as text.

    Input order is recorded once as ``row_idx``: by the columns of ``order``, else by the place of the rows in the files
    that ``df`` reads (path, block, place in the block; a task reads a block from its start), whatever partitions they
    were read in. A frame with neither keeps the order of its partitions. Fails on a missing column.
    """
    by_lower = {c.strip().lower(): c for c in df.columns}
    picked = {}
    for target, names in CANDIDATE_ALIASES.items():
        hits = [by_lower[n] for n in names if n in by_lower]
        if not hits:
            raise ValueError(f"candidate input has no {target} column: {df.columns}")
        picked[target] = hits[0]
    columns = [
        F.col(picked["user_id"]).cast("string").cast("bigint").alias("user_id"),
        F.col(picked["item_id"]).cast("string").alias("item_id"),
    ]
    places = [F.col(c) for c in order] if order else _file_order(df)
    if places is None:
        return df.select(*columns).withColumn("row_idx", F.monotonically_increasing_id())
    from shelfwise.functions.ranks import global_position

    names = [f"__o{i}" for i in range(len(places))]
    placed = df.select(*columns, *[c.alias(n) for c, n in zip(places, names)])
    return global_position(placed, [F.col(n) for n in names], "row_idx").drop(*names)


def candidate_gaps(cand: DataFrame) -> DataFrame:
    """Row count and number of rows with an empty user or item."""
    return cand.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("user_id").isNull().cast("bigint")).alias("null_users"),
        F.sum((F.coalesce(F.trim("item_id"), F.lit("")) == "").cast("bigint")).alias("blank_items"),
    )


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.csv(path, header=True)
    else:
        writer.format(fmt).save(path)


def write_monthly(df: DataFrame, path: str, month: str = "month") -> None:
    """One folder per month; adaptive execution deals a month over as many tasks as its size asks for."""
    df.hint("rebalance", month).write.mode("overwrite").partitionBy(month).parquet(path)


def submission(scored: DataFrame) -> DataFrame:
    """Exactly (user_id, item_id, score) in input order, full precision."""
    return scored.orderBy("row_idx").select("user_id", "item_id", F.col("score").cast("double").alias("score"))


def neighbor_rows(neighbors: DataFrame, key: str, other: str, k: int = 10) -> DataFrame:
    """One row per id with its neighbours as an ordered array (at most k entries each)."""
    entry = F.struct(F.col("rank"), F.col(other).alias("id"), F.col("sim"))
    return (
        neighbors.filter(F.col("rank") <= k)
        .groupBy(key)
        .agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["id"], e["sim"])).alias("neighbors"))
    )


def input_state(spark: SparkSession, inputs) -> str:
    """One line per input file, in order of its name: name, length, modification time. Folders are listed through."""
    lines = []
    for path in inputs:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(place, True)
        while files.hasNext():
            f = files.next()
            lines.append(f"{f.getPath().toString()}\t{f.getLen()}\t{f.getModificationTime()}")
    return "\n".join(sorted(lines))


def read_or_build(spark: SparkSession, path: str, build, inputs=None, params: str = "") -> DataFrame:
    """Reuse a finished Parquet snapshot of the same inputs and parameters, else build and write it.

    A version is named by the names, lengths and modification times of the input files and by ``params``; its manifest
    lies beside it, and it counts as committed once its ``_SUCCESS`` file is there. ``inputs``: files or folders;
    by default those that the frame itself reads.
    """
    frame = build() if inputs is None else None
    state = input_state(spark, frame.inputFiles() if inputs is None else inputs)
    version = hashlib.sha256(f"{params}\n{state}".encode()).hexdigest()[:24]
    place = f"{path}/{version}"
    if not path_exists(spark, f"{place}/_SUCCESS"):
        rows = [tuple(line.split("\t")) for line in state.split("\n") if line]
        spark.createDataFrame([(params, *r) for r in rows], "params string, file string, length string, modified string").coalesce(
            1).write.mode("overwrite").json(f"{path}/manifest-{version}")
        (build() if frame is None else frame).write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)


def item_index(df: DataFrame) -> DataFrame:
    """Item id to dense integer over the sorted distinct ids."""
    from shelfwise.functions.ranks import global_position

    return global_position(df.select("item_id").distinct(), [F.col("item_id")], "item_idx")
