"""Helpers shared by the corpus operators: stored intermediates, global positions, text columns."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from shelfwise.sources.transactions import scratch_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared checkpoint folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete stored frames that nothing reads any more; others are left alone."""
    for df in frames:
        if path := getattr(df, "stored_at", None):
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
            df.stored_at = None


def drop_shuffles(spark: SparkSession) -> None:
    """Run the collectors of the driver, so that Spark's cleaner drops the shuffle files of plans nobody holds."""
    gc.collect()
    spark._jvm.System.gc()


#: log2 of the bits of a table that is tried before a join.
TABLE_BITS = 23


def bit_table(keys: DataFrame) -> np.ndarray:
    """Bits that are set for the long column of ``keys``, as bytes; their number does not depend on the rows.

    For dropping most rows that a join would drop, before it; it decides nothing.
    """

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"slot": np.unique(_slot(batch.column(0).to_numpy())).astype(np.int32)})

    slots = keys.mapInArrow(run, "slot int")
    found = slots.groupBy(F.expr("slot >> 3").alias("at")).agg(
        F.expr("bit_or(1 << (slot & 7))").cast("short").alias("bits")).toArrow()
    bits = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
    bits[found.column("at").to_numpy()] = found.column("bits").to_numpy().astype(np.uint8)
    return bits


def in_table(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the keys whose bit is set."""
    slot = _slot(keys)
    return np.flatnonzero(bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)


def _slot(keys: np.ndarray) -> np.ndarray:
    x = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    return (x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - TABLE_BITS)


def schema_with(docs: DataFrame, names: list[str], more: str) -> StructType:
    """Schema of the named columns of a frame followed by those of a DDL text."""
    return StructType([docs.schema[n] for n in names] + _parse_datatype_string(more).fields)


def slices(batch, rows: int = 500):
    """A record batch in pieces of a few rows, so that only those are Python objects at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def give_back() -> None:
    """Return freed memory to the system; Spark keeps a task's worker process for the tasks of later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """True where crc32 of the id as text leaves no remainder; a null id counts as the empty string."""
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return (F.crc32(key.cast("binary")) % folds) == 0


def global_order(df: DataFrame, order: list[str], weight: str | None = None, name: str = "order") -> DataFrame:
    """Add ``before``: rows (or the sum of ``weight``) ahead of each row in the order of the given columns.

    The rows are range-partitioned and sorted, stored once, and each partition's total is added up first, so
    no task holds more than one range. ``order`` must name a unique key or ties take any order. Totals: one row
    per range partition, which bounds what is broadcast.
    """
    w = F.lit(1) if weight is None else F.col(weight)
    ranged = (
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id()).withColumn("_w", w.cast("long"))
        .withColumn("_at", F.monotonically_increasing_id())
    )
    stored = stash(ranged, name)
    totals = stored.groupBy("_part").agg(F.sum("_w").alias("_total"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", F.coalesce(F.sum("_total").over(ahead), F.lit(0)).alias("_start"))
    if weight is None:
        inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    else:
        within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        inside = F.coalesce(F.sum("_w").over(within), F.lit(0))
    out = stored.join(F.broadcast(starts), "_part").withColumn("before", F.col("_start") + inside)
    return out.drop("_part", "_w", "_at", "_start")


def bounded_sample(ids: DataFrame, group: str, rows: int) -> DataFrame:
    """doc_id of at most ``rows`` rows: the groups in turn, each in the order of a hash.

    Rows of a group that come after about its first 2 * ``rows`` in that order are left out before anything is
    sorted, so what meets in one task is bounded by the parameter and not by the group.
    """
    place = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    sizes = ids.groupBy(group).agg(F.count("*").alias("_n"))
    early = ids.join(sizes, group).withColumn("_h", place).where(F.col("_h") * F.col("_n") <= 2 * rows + 1000)
    turn = F.row_number().over(Window.partitionBy(group).orderBy("_h", "doc_id"))
    first = early.withColumn("_turn", turn).where(F.col("_turn") <= rows)
    return first.orderBy("_turn", group, "_h", "doc_id").limit(rows).select("doc_id")
