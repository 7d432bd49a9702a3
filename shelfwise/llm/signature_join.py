"""MinHash near-duplicates through an inverted join over (coordinate, value) pairs of signatures.

A signature holds 64 minima of a text's distinct shingles (``set_links.signature``); two texts agree in a coordinate with
the probability of their Jaccard similarity. Every (coordinate, value) pair is a posting of the texts that have it,
and a pair of texts is kept if it collides in at least ``match_threshold`` coordinates, 28 of 64 at 0.8, which a pair
at exactly 0.8 misses with probability 3e-11.

Collisions are counted without merging the long lists. All postings have one order, by a counted size class and then
by key. Two signatures with T collisions share at least one of the first 64 - T + 1 pairs in that order (prefix), so
only those are posted: the frequent values, such as those of a passage in a third of all texts, come last and are
skipped, and their collisions are counted by comparing the signatures of pairs that meet in the prefix. Pairs at or
above the threshold are confirmed on their whole sets. Equal sets are one node, identified by 64 bits of a hash, as
single shingles are. The size classes come from 2^18 counters and only order the lists; any order gives the same links.

Defined cases: null, empty and wordless texts have the empty set and are linked with nothing; fewer words than a shingle
are one shingle; repeated rows and repeated ids are kept, each row linked by its own text; a null id never names a
component unless all its ids are null, and its row is not kept by id; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm import set_links
from shelfwise.llm.common import discard, give_back, schema_with, slices, stash, text_or_empty
from shelfwise.llm.ngrams import sum_vectors

WORDS, PERCENT = 4, 80
COUNTERS = 1 << 18
_PLACE = np.arange(1, set_links.COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def posting_keys(values: np.ndarray) -> np.ndarray:
    """Posting of each coordinate's value."""
    x = (values ^ _PLACE) * _MIX
    return x ^ (x >> np.uint64(29))


def counter(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64(COUNTERS - 1)).astype(np.int64)


def signatures(docs: DataFrame, key: str, words: int) -> DataFrame:
    """key, th (hash of key and text), node, size and posting keys (64 longs as bytes, null for the empty set) for every row."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                nodes, sizes, keys = [], [], []
                for text in part.column(1).to_pylist():
                    found = set_links.shingles(text, words)
                    nodes.append(set_links.node_of(found))
                    sizes.append(len(found))
                    keys.append(posting_keys(set_links.signature(found)).tobytes() if len(found) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(np.array(nodes, np.uint64).view(np.int64)),
                     pa.array(sizes, pa.int64()), pa.array(keys, pa.binary())], [key, "th", "node", "size", "keys"])
        give_back()

    rows = docs.select(F.col(key), text_or_empty().alias("text"), F.xxhash64(key, "text").alias("th"))
    return rows.mapInArrow(run, schema_with(docs, [key], "th long, node long, size long, keys binary"))


def posting_sizes(nodes: DataFrame) -> np.ndarray:
    """Size class (log2) of each counter's postings."""

    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for part in slices(batch, 5000):
                keys = np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint64)
                total += np.bincount(counter(keys), minlength=COUNTERS)
        yield pa.RecordBatch.from_pydict({"vector": [total.tobytes()]})

    summed = sum_vectors(nodes.select("keys").mapInArrow(run, "vector binary")).first()
    counts = np.zeros(COUNTERS, np.int64) if summed is None or summed[0] is None else np.frombuffer(summed[0], np.int64)
    return np.log2(np.maximum(counts, 1)).astype(np.uint8)


def prefix_places(keys: np.ndarray, classes: np.ndarray, percent: int) -> np.ndarray:
    """Coordinates of the pairs that a node is posted under: the first ones in the order of size class and key."""
    prefix = set_links.COORDINATES - set_links.match_threshold(percent) + 1
    return np.lexsort((keys, classes[counter(keys)]), axis=1)[:, :prefix]


def prefix_postings(nodes: DataFrame, classes: np.ndarray, percent: int) -> DataFrame:
    """key, place, node, size of the postings that a node's rarest pairs put it in."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2000):
                if part.num_rows:
                    keys = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint64).reshape(part.num_rows, -1)
                    places = prefix_places(keys, classes, percent)
                    node, size = (np.repeat(part.column(i).to_numpy(), places.shape[1]) for i in range(2))
                    yield pa.RecordBatch.from_pydict({
                        "key": np.take_along_axis(keys, places, axis=1).reshape(-1).view(np.int64),
                        "place": places.reshape(-1).astype(np.int32), "node": node, "size": size})

    return nodes.select("node", "size", "keys").mapInArrow(run, "key long, place int, node long, size long")


def sketches(nodes: DataFrame, classes: np.ndarray, percent: int) -> DataFrame:
    """node, sketch, posted (a bit for each coordinate that the node is posted under)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2000):
                if part.num_rows:
                    keys = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint64).reshape(part.num_rows, -1)
                    places = prefix_places(keys, classes, percent).astype(np.uint64)
                    posted = np.bitwise_or.reduce(np.uint64(1) << places, axis=1).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array([set_links.sketch(k) for k in keys], pa.binary()), pa.array(posted)],
                        ["node", "sketch", "posted"])

    return nodes.select("node", "keys").mapInArrow(run, "node long, sketch binary, posted long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Every row's key with n_shingles, component_id (the least key reachable) and kept."""
    signed = stash(signatures(docs, key, words), "signatures")
    rows = stash(signed.select(key, "th", "node", "size"), "rows")
    nodes = stash(signed.where("size > 0").groupBy("node").agg(
        F.min(key).alias("least"), F.first("size").alias("size"), F.first("keys").alias("keys")), "nodes")
    discard(signed)
    classes = posting_sizes(nodes)
    joined = set_links.linked(prefix_postings(nodes, classes, percent), sketches(nodes, classes, percent),
                              set_links.sets_from(docs, rows, key, words), percent)
    grouped = nodes.select("node", "least").join(joined, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    lowest = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stash(grouped.join(lowest, "component").select("node", "component_id"), "groups")
    discard(nodes)
    out = rows.select(key, "node", "size").join(named, "node", "left")
    own = F.when(F.col("size") == 0, F.col(key)).otherwise(F.col("component_id"))
    return out.select(key, F.col("size").alias("n_shingles"), own.alias("component_id"),
                      F.coalesce(F.col(key) == own, F.lit(False)).alias("kept"))

