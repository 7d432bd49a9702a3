"""Benchmark decontamination with a distributed positional inverted index.

1. Terms of the benchmark items are counted over all documents.
2. Every window of an item (``WINDOW`` consecutive words, or the whole shorter item) names its two rarest terms.
3. The index stores, for those terms, one posting per document: the term's word positions.
4. The rarest term's list is joined with the windows and intersected with the second one's at the adjusted offset; what
   stays is an alignment (document, item, shift). Overlapping windows share alignments.
5. An exact check compares the words of each alignment and keeps runs of at least a window.

Documents are scanned with a bitmap of hashed terms (``FILTER_BITS`` bits whatever the benchmark's size, the only
thing broadcast by hand); a false hit costs a posting and no more. ``proximity_matches`` answers near queries.

Words: A-Z lower-cased, then maximal runs of 0-9, a-z and all non-ASCII characters. Defined cases: null, empty or
wordless texts have no words and no hits; an item without words never occurs; rows with equal id and text have equal
results and are all kept; a null id is a key of its own; items that repeat an id count once, a null item id
is the empty string; texts of any length are read whole; other columns are ignored; empty tables give no rows or no hits.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import stash, text_or_empty

WINDOW = 10
FILTER_BITS = 1 << 20
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


def _bucket(term: bytes) -> int:
    return xxhash.xxh32_intdigest(term) % FILTER_BITS


class TermFilter:
    """Bitmap over hashed terms; may say yes wrongly, never no."""

    def __init__(self, buckets: list[int]):
        bits = np.zeros(FILTER_BITS, bool)
        bits[buckets] = True
        self.bits = np.packbits(bits).tobytes()

    def some(self, terms) -> set[bytes]:
        bits = self.bits
        return {t for t in terms if bits[(b := _bucket(t)) >> 3] >> (7 - (b & 7)) & 1}


def _filter(rows: DataFrame, *columns: str) -> TermFilter:
    """Filter of all bucket numbers in the columns: at most FILTER_BITS distinct numbers reach the driver."""
    one = rows.select(F.explode(F.array(*columns)).alias("b")).where("b is not null").distinct()
    return TermFilter([r.b for r in one.collect()])


def keyed(docs: DataFrame) -> DataFrame:
    """did, th, text: the id with nulls replaced, and a hash of id and text, together the key of a row."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("did"),
        F.xxhash64("doc_id", "text").alias("th"), text_or_empty().alias("text"),
    )


def item_terms(benchmark: DataFrame) -> DataFrame:
    """item_key, item_id, pos, term, bucket: one row per item word."""

    def run(batches):
        for batch in batches:
            words = [words_of(t) for t in batch.column(2).to_pylist()]
            at = np.repeat(np.arange(len(words)), [len(w) for w in words])
            flat = list(chain.from_iterable(words))
            yield pa.RecordBatch.from_pydict({
                "item_key": batch.column(0).take(pa.array(at)), "item_id": batch.column(1).take(pa.array(at)),
                "pos": pa.array([i for w in words for i in range(len(w))], pa.int32()),
                "term": pa.array([t.decode() for t in flat], pa.string()),
                "bucket": pa.array([_bucket(t) for t in flat], pa.int32())})

    rows = benchmark.select(F.monotonically_increasing_id().alias("item_key"),
                            F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), text_or_empty().alias("text"))
    return stash(rows.mapInArrow(run, "item_key long, item_id string, pos int, term string, bucket int"), "items")


def term_counts(docs: DataFrame, wanted: TermFilter) -> DataFrame:
    """term, n: occurrences over all documents of the terms that pass the filter."""

    def run(batches):
        held: Counter = Counter()

        def out():
            some = wanted.some(held)
            return pa.RecordBatch.from_pydict({"term": pa.array([t.decode() for t in some], pa.string()),
                                               "n": pa.array([held[t] for t in some], pa.int64())})

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(words_of(text))
                if len(held) > 300_000:
                    yield out()
                    held.clear()
        yield out()

    parts = docs.select("text").mapInArrow(run, "term string, n long")
    return parts.groupBy("term").agg(F.sum("n").alias("n"))


def window_anchors(items: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_key, p1, t1, b1, p2, t2, b2: positions of the two rarest terms of the item's windows, each pair once.

    A window with a term that no document holds cannot occur and is left out.
    """

    def run(batches):
        for batch in batches:
            out = []
            for key, ps in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = [p["n"] for p in ps]
                width = min(window, len(ps))
                pairs = set()
                for start in range(len(ps) - width + 1):
                    span = range(start, start + width)
                    if all(n[i] for i in span):
                        pairs.add(tuple((sorted(span, key=lambda i: (n[i], i)) + [None])[:2]))
                for a, b in sorted(pairs, key=str):
                    out.append({"item_key": key, "p1": a, "t1": ps[a]["term"], "b1": ps[a]["bucket"]}
                               | {"p2": b, "t2": None if b is None else ps[b]["term"],
                                  "b2": None if b is None else ps[b]["bucket"]})
            schema = pa.schema([("item_key", pa.int64()), ("p1", pa.int32()), ("t1", pa.string()), ("b1", pa.int32()),
                                ("p2", pa.int32()), ("t2", pa.string()), ("b2", pa.int32())])
            yield pa.RecordBatch.from_pylist(out, schema)

    counted = items.join(counts, "term", "left")
    one = F.struct("pos", "term", "bucket", F.coalesce("n", F.lit(0)).alias("n"))
    grouped = counted.groupBy("item_key").agg(F.sort_array(F.collect_list(one)).alias("terms"))
    return stash(grouped.mapInArrow(
        run, "item_key long, p1 int, t1 string, b1 int, p2 int, t2 string, b2 int"), "anchors")


def positional_index(docs: DataFrame, wanted: TermFilter) -> DataFrame:
    """Stored postings did, th, term, positions, and per document a row with null term and ``n_words``."""

    def run(batches):
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = batch.column(2).to_pylist()
            for at in range(0, len(texts), 1000):
                docs_words = [words_of(t) for t in texts[at:at + 1000]]
                some = wanted.some(set().union(*docs_words))
                did, th, term, positions, n_words = [], [], [], [], []
                for i, words in enumerate(docs_words, at):
                    found: dict[bytes, list[int]] = {}
                    for p, w in enumerate(words):
                        if w in some:
                            found.setdefault(w, []).append(p)
                    rows = 1 + len(found)
                    did += [ids[i]] * rows
                    th += [keys[i]] * rows
                    term += [None, *(t.decode() for t in found)]
                    positions += [None, *found.values()]
                    n_words += [len(words)] + [None] * len(found)
                yield pa.RecordBatch.from_pydict({
                    "did": pa.array(did, pa.int64()), "th": pa.array(th, pa.int64()), "term": pa.array(term, pa.string()),
                    "positions": pa.array(positions, pa.list_(pa.int32())), "n_words": pa.array(n_words, pa.int64())})

    schema = "did long, th long, term string, positions array<int>, n_words long"
    return stash(docs.select("did", "th", "text").mapInArrow(run, schema), "postings")


def alignments(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """did, th, item_key, shift: document position less item position where the two rarest terms of a window meet."""
    postings = index.where("term is not null").select("did", "th", "term", "positions")
    first = anchors.join(postings, F.col("t1") == F.col("term")).select(
        "item_key", "p2", "t2", "did", "th", F.explode(F.transform("positions", lambda p: p - F.col("p1"))).alias("shift"))
    second = postings.select(F.col("did").alias("_did"), F.col("th").alias("_th"), F.col("term").alias("_term"),
                             F.col("positions").alias("_positions"))
    alone = first.where("t2 is null").select("did", "th", "item_key", "shift")
    met = first.where("t2 is not null").join(
        second, (F.col("did") == F.col("_did")) & (F.col("th") == F.col("_th")) & (F.col("t2") == F.col("_term")))
    both = met.where(F.array_contains("_positions", F.col("shift") + F.col("p2")))
    return both.select("did", "th", "item_key", "shift").union(alone).distinct()


def proximity_matches(index: DataFrame, left: str, right: str, gap: int) -> DataFrame:
    """did, th, left_pos, right_pos: the two terms at most ``gap`` words apart, in either order. The index must hold both."""
    a = index.where(F.col("term") == left).select("did", "th", F.explode("positions").alias("left_pos"))
    b = index.where(F.col("term") == right).select("did", "th", "positions")
    met = a.join(b, ["did", "th"])
    near = F.filter("positions", lambda p: (F.abs(p - F.col("left_pos")) <= gap) & (p != F.col("left_pos")))
    return met.select("did", "th", "left_pos", F.explode(near).alias("right_pos")).distinct()


def phrase_hits(docs: DataFrame, items: DataFrame, aligned: DataFrame, window: int = WINDOW) -> DataFrame:
    """did, th, hits (array of start, end in words), items: exact check of the alignments against whole texts."""

    def run(batches):
        for batch in batches:
            out = []
            for did, th, text, found in zip(*(batch.column(i).to_pylist() for i in range(4))):
                words = words_of(text)
                mask, names = np.zeros(len(words), bool), set()
                for c in found:
                    item, shift = [w.encode() for w in c["words"]], c["shift"]
                    need, run_at = min(window, len(item)), None
                    lo, hi = max(0, -shift), min(len(item), len(words) - shift)
                    for j in range(lo, hi + 1):
                        if j < hi and words[shift + j] == item[j]:
                            run_at = j if run_at is None else run_at
                        elif run_at is not None:
                            if j - run_at >= need:
                                mask[shift + run_at:shift + j] = True
                                names.add(c["item_id"])
                            run_at = None
                if names:
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                    out.append({"did": did, "th": th, "items": sorted(names),
                                "hits": [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()]})
            span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            yield pa.RecordBatch.from_pylist(out, pa.schema([
                ("did", pa.int64()), ("th", pa.int64()), ("hits", pa.list_(span)), ("items", pa.list_(pa.string()))]))

    texts = items.groupBy("item_key", "item_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "term"))).alias("w")).select(
        "item_key", "item_id", F.col("w.term").alias("words"))
    per_doc = aligned.join(texts, "item_key").groupBy("did", "th").agg(
        F.collect_list(F.struct("item_id", "words", "shift")).alias("found"))
    once = docs.select("did", "th", "text").join(per_doc, ["did", "th"])
    checked = once.mapInArrow(
        run, "did long, th long, hits array<struct<start:bigint,end:bigint>>, items array<string>")
    return checked.dropDuplicates(["did", "th"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """did, th, n_words, hits, items for every document row; hits and items are empty where nothing occurs."""
    rows = keyed(docs)
    items = item_terms(benchmark)
    counts = term_counts(rows, _filter(items, "bucket"))
    anchors = window_anchors(items, counts, window)
    index = positional_index(rows, _filter(anchors, "b1", "b2"))
    aligned = stash(alignments(index, anchors), "alignments")
    hits = phrase_hits(rows, items, aligned, window)
    every = index.where("term is null").select("did", "th", "n_words")
    joined = every.join(hits, ["did", "th"], "left")
    return joined.select(
        "did", "th", "n_words", F.coalesce("hits", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("hits"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, h: s + h["end"] - h["start"])
    return found.select(
        F.nullif("did", F.lit(-(1 << 63))).alias("doc_id"), "n_words", n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
