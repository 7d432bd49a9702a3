"""SimHash near-duplicates through an inverted index over byte positions keyed by the least number of matches.

A 64-bit fingerprint is eight (position, byte) terms. Fingerprints at 3 or fewer differing bits differ in at most three
bytes, so they share at least five of the eight terms: the guaranteed minimum of matches. A posting for one byte
holds 1/256 of all fingerprints and its pairs would grow with the square of the corpus, so the count filter sits
in the index: postings are keyed by every choice of five positions together with their bytes (56 per distinct
fingerprint). Two fingerprints meet in a posting exactly if they share those five; the key itself
enforces the minimum, no tally is kept per pair, and pairs of a posting are verified on all 64 bits.

Only distinct fingerprints are indexed; documents with equal ones are one node. A posting gives a spanning forest
of its links, which loses no connection: up to ``PAIRWISE`` fingerprints each pair is compared; larger ones look up,
for every member, the 2,324 patterns within three bits of the free bytes, so the work is linear in the posting.

Defined cases: null, empty and white-space texts have no word and fingerprint zero, linked like any other; repeated
rows and repeated or null ids are kept (a null id never names a component unless all its ids are null); other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import give_back, schema_with, slices, stash, text_or_empty
from shelfwise.llm.components import components

SHINGLE, MAX_BITS, SEED = 3, 3, 42
PAIRWISE = 1000
_CHOICES = list(combinations(range(8), 8 - MAX_BITS))


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of a text: bits set in over half the hashes of its word shingles, repeats included."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[:-1]])[:len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())]
    counts = np.zeros(64, np.int64)
    every = np.array(hashes, "<u8")
    for at in range(0, len(every), 4096):
        part = np.unpackbits(every[at:at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, fp (the 64 bits as a signed long) for every row."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                fps = np.array([fingerprint(t) for t in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], [key, "fp"])
        give_back()

    rows = docs.select(F.col(key), text_or_empty().alias("text"))
    return rows.mapInArrow(run, schema_with(docs, [key], "fp long"))


def _patterns(bits: int) -> np.ndarray:
    """Non-zero masks of at most MAX_BITS bits out of ``bits``."""
    return np.array([sum(1 << b for b in c) for k in range(1, MAX_BITS + 1) for c in combinations(range(bits), k)],
                    np.uint64)


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> list[int]:
    """Indexes of links that join two trees."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append(i)
    return kept


def posting_links(fps: np.ndarray, choice: int, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links among fingerprints that share the chosen five byte positions."""
    fps = np.unique(fps.astype(np.uint64))
    n = len(fps)
    if n <= PAIRWISE:
        low = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= MAX_BITS
        a, b = np.nonzero(np.triu(low, 1))
        kept = _forest(n, a, b)
        return fps[a[kept]], fps[b[kept]]
    root, out_a, out_b = np.arange(n), [], []
    for mask in masks[choice]:
        other = fps ^ mask
        at = np.minimum(np.searchsorted(fps, other), n - 1)
        a = np.flatnonzero((fps[at] == other) & (fps < other))
        b = at[a]
        new = root[a] != root[b]
        for x, y in zip(a[new].tolist(), b[new].tolist()):
            while root[x] != x:
                root[x] = x = root[root[x]]
            while root[y] != y:
                root[y] = y = root[root[y]]
            if x != y:
                root[max(x, y)] = min(x, y)
        out_a.append(fps[a[new]])
        out_b.append(fps[b[new]])
    a, b = np.searchsorted(fps, np.concatenate(out_a)), np.searchsorted(fps, np.concatenate(out_b))
    kept = _forest(n, a, b)
    return fps[a[kept]], fps[b[kept]]


def _choice_masks() -> list[np.ndarray]:
    """Per choice of five positions, the bit patterns that lie in the other three bytes."""
    flat = _patterns(8 * MAX_BITS)
    masks = []
    for chosen in _CHOICES:
        free = [p for p in range(8) if p not in chosen]
        out = np.zeros(len(flat), np.uint64)
        for i, p in enumerate(free):
            out |= ((flat >> np.uint64(8 * i)) & np.uint64(255)) << np.uint64(8 * p)
        masks.append(out)
    return masks


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp): a spanning forest per posting, repeats removed."""
    keyed = [F.struct(F.lit(i).cast("byte").alias("choice"),
                      F.col("fp").bitwiseAND(F.lit(_signed(sum(255 << 8 * p for p in c)))).alias("shared"))
             for i, c in enumerate(_CHOICES)]
    postings = (
        fps.select("fp", F.explode(F.array(*keyed)).alias("k"))
        .groupBy("k.choice", "k.shared").agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1).select("choice", "fps")
    )

    def run(batches):
        masks = _choice_masks()
        for batch in batches:
            choices, ends = batch.column(0).to_pylist(), np.array(batch.column(1).offsets)
            values = batch.column(1).values.to_numpy().view(np.uint64)
            found = [posting_links(values[ends[i]:ends[i + 1]], c, masks) for i, c in enumerate(choices)]
            if found:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*found))
                yield pa.RecordBatch.from_pydict({"a": a, "b": b})

    return postings.mapInArrow(run, "a long, b long").distinct()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_duplicates(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every row's key with ``fp`` and ``component_id``, the least key reachable over links."""
    rows = stash(fingerprints(docs, key), "simhash")
    nodes = rows.groupBy("fp").agg(F.min(key).alias("least"))
    linked = components(links(nodes.select("fp")))
    grouped = nodes.join(linked, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))
    lowest = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.join(lowest, "component").select("fp", "component_id")
    return rows.join(named, "fp")
