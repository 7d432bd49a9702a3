"""Sharding along a Hilbert curve over document metadata.

Language, source and size are quantised to 8 bits each, the three codes give an index on a Hilbert curve, rows are
sorted by it and cut into runs, so every shard covers a small box of the three dimensions and a filter on any of
them skips most shards. Language and source are binned by cumulated row counts in value order, so the bins
keep the order and are of like mass; sizes are binned on a log scale. A group of equal texts takes the smallest
language and source of its rows, so it has one index and stays together but for a cut that falls into it.

Law ``rows``: run i holds positions [ceil(i*n/k), ceil((i+1)*n/k)), so counts differ by at most one.

Defined cases: a null or empty text has size 16 and crc 0 (equal texts); null language or source is the lowest
bin; null or repeated ids are kept, ties go by text hash and id; fewer rows than shards leave some shards empty; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from shelfwise.llm.common import global_order, text_or_empty

BITS = 8


def hilbert_index(codes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Curve position of integer points, shape (n, dims): the transpose form of J. Skilling (2004)."""
    x = codes.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(hit, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


@F.pandas_udf(LongType())
def _curve(lang: pd.Series, source: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series(hilbert_index(np.stack([lang, source, size], axis=1)))


def _bins(groups: DataFrame, column: str, total: int) -> DataFrame:
    """Value -> code: cumulated rows before the value, in value order, scaled to BITS bits."""
    counts = groups.groupBy(column).agg(F.sum("n").alias("n"))
    placed = global_order(counts, [column], "n", f"bins-{column}")
    code = F.floor(F.col("before") * (1 << BITS) / F.lit(total))
    return placed.select(F.col(column).alias(f"_{column}"), code.alias(f"{column}_code"))


def hilbert_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, curve, shard, slot."""
    text = text_or_empty()
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"),
        F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
    )
    n = docs.count()
    same = ["text_hash", "text_crc32", "size"]
    groups = rows.groupBy(*same).agg(F.min("lang").alias("lang"), F.min("source").alias("source"), F.count("*").alias("n"))
    for column in ("lang", "source"):
        bins = _bins(groups, column, n)
        groups = groups.join(bins, F.col(column) == F.col(f"_{column}")).drop(f"_{column}")
    top = (1 << BITS) - 1
    size_code = F.least(F.lit(top), F.floor(F.log2(F.col("size")) * 8))
    curve = groups.select(*same, _curve("lang_code", "source_code", size_code).alias("curve"))
    placed = global_order(rows.join(curve, same), ["curve", "text_hash", "doc_id"], name="curve")
    shard = F.floor(F.col("before") * shards / F.lit(n))
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id", "size", "text_crc32", "curve", "shard",
        (F.col("before") - F.ceil(F.col("shard") * F.lit(n) / shards)).alias("slot"),
    )
