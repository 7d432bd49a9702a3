"""Groups of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Two positional indexes give the pairs, which are verified on their whole shingle sets, as 64-bit hashes.
The first is op7's: SimHash fingerprints and postings that need five equal byte positions (``simhash_dups``). It joins the
close copies. Bits of a SimHash differ in 15 % of the positions at 0.8, so it cannot reach all similar pairs, and a key of
24 bits would have to be taken some 700 times to do so. The second index finds the rest: 120 minima of hashed shingles
(MinHash), a position of which agrees with the probability of the similarity itself, keyed by 30 runs of four positions.
A pair at 0.8 shares none of them with probability (1 - 0.8 ** 4) ** 30 = 1.4e-7, one at 0.85 with 2e-10, while a pair at
0.1 meets in one of 330 cases.

Equal sets are one node. ``set_links`` compares the members of a posting and gives out links that join groups, no pairs.

Defined cases: texts without a word have the empty set and are one group; shorter texts are one shingle; repeated
rows and repeated or null ids are kept; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm import set_links, simhash_dups
from shelfwise.llm.common import discard, give_back, schema_with, slices, stash, text_or_empty

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
BANDS, WIDTH = 30, 4
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(SEED).integers(0, 1 << 64, BANDS * WIDTH, dtype=np.uint64)


def minima(hashes: np.ndarray) -> np.ndarray:
    """Least value of a set under each hash function; the empty set has the largest number."""
    least = np.full(len(_SEEDS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        x = (hashes[at:at + 1024, None] ^ _SEEDS) * _ODD
        x ^= x >> np.uint64(32)
        least = np.minimum(least, (x * _ODD).min(axis=0))
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """Keys of a set's minima in the index."""
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD
    for part in least.reshape(BANDS, WIDTH).T:
        keys = (keys ^ part) * _ODD
        keys ^= keys >> np.uint64(29)
    return keys


def signatures(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, th (hash of key and text), node (hash of the shingle set), size, bands, sketch, fp (SimHash) for every row."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                nodes, sizes, keys, sketches, fps = [], [], [], [], []
                for text in part.column(1).to_pylist():
                    found = set_links.shingles(text, SHINGLE)
                    nodes.append(set_links.node_of(found))
                    sizes.append(len(found))
                    least = minima(found)
                    keys.append(bands(least).view(np.int64) if len(found) else [])
                    sketches.append(set_links.sketch(least))
                    fps.append(simhash_dups.fingerprint(text))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(np.array(nodes, np.uint64).view(np.int64)),
                     pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary()),
                     pa.array(np.array(fps, np.uint64).view(np.int64))],
                    [key, "th", "node", "size", "bands", "sketch", "fp"])
        give_back()

    rows = docs.select(F.col(key), text_or_empty().alias("text"), F.xxhash64(key, "text").alias("th"))
    return rows.mapInArrow(run, schema_with(docs, [key], "th long, node long, size long, bands array<long>, sketch binary, fp long"))


def fingerprint_pairs(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that SimHash links: equal fingerprints, or those that ``simhash_dups.links`` joins.

    ``prints``: node, fp. The nodes of a fingerprint are paired with their least one, so there are no more pairs than rows
    and links.
    """
    prints = stash(prints.distinct(), "prints")
    heads = stash(prints.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    equal = prints.join(heads, "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    close = simhash_dups.links(heads.select("fp")).join(
        heads.select(F.col("fp").alias("a"), F.col("head").alias("left")), "a").join(
        heads.select(F.col("fp").alias("b"), F.col("head").alias("right")), "b").where("left <> right").select(
        F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b"))
    pairs = stash(equal.unionByName(close).distinct(), "simhash-pairs")
    discard(prints, heads)
    return pairs


def near_duplicates(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every row's key with ``node`` and ``component_id``, the least key reachable over similar texts."""
    signed = stash(signatures(docs, key), "shingles")
    rows = stash(signed.select(key, "th", "node"), "rows")
    found = fingerprint_pairs(signed.select("node", "fp"))
    nodes = stash(signed.groupBy("node").agg(
        F.min(key).alias("least"), F.first("size").alias("size"), F.first("bands").alias("bands"),
        F.first("sketch").alias("sketch")), "nodes")
    discard(signed)
    index = nodes.select("node", "size", F.posexplode("bands").alias("place", "key"))
    sketches = nodes.select("node", "sketch", F.lit((1 << BANDS) - 1).cast("long").alias("posted"))
    linked = set_links.linked(index, sketches, set_links.sets_from(docs, rows, key, SHINGLE), round(100 * SIMILARITY), WIDTH,
                              found)
    discard(found)
    grouped = nodes.select("node", "least").join(linked, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    lowest = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stash(grouped.join(lowest, "component").select("node", "component_id"), "groups")
    discard(nodes)
    return rows.select(key, "node").join(named, "node")
