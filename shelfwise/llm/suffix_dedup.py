"""Suffix-array dedup by bucket-pointer refinement: bytes covered by a string of 400 bytes that starts anywhere else too.

Schuermann and Stoye (2005) sort suffixes into q-gram buckets and refine a bucket by sorting on the bucket
identifiers of later offsets, reusing refined identifiers recursively. Here the identifiers are hashes of content, so
each document computes its own (``repeats.bucket_at``: 50 bytes, then pairs of 100, 200 and 400), and Spark groups
rows by them. Suffixes are sampled without losing a match: all copies of a 400-byte string hold the same least
50-gram at the same offset (``anchor_ranges``), so one row stands for the match starts that share an anchor.

A bucket with one member is final. The others are refined in three rounds of (bucket, identifier of a later offset):
1. the whole range of match starts of an anchor: the string from the first start to the last one's end;
2. blocks of ``BLOCK`` offsets from the anchor: bucket is the string common to the block's matches, the
   refinement all bytes its matches cover;
3. single match starts of what is left, which a bucket of two settles.
In the first two rounds a string found twice settles its starts, a bucket of one drops out, and the rest goes on, with one
witness for each settled string of the same bucket. Counts are
added map-side and joined back, so a passage in a third of all documents is one counted key. Identifiers have 64 bits,
and only strings with equal anchors are compared.

Defined cases: null texts are empty; matches never cross documents; repeated rows are copies of each other; a null id
is a key of its own; documents below 400 bytes keep everything; any length is scanned whole; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfwise.llm.common import discard, drop_shuffles, schema_with, slices, stash, text_or_empty
from shelfwise.llm.repeats import LENGTH, anchor_ranges, bucket_at, mix, qgram_buckets, span_of, string_at

BLOCK = 32
#: Bytes and whole words of a repeated passage: four bytes a word with its space.
PASSAGE = (200, 50)
NO_ID = -(1 << 63)


def keyed(docs: DataFrame) -> DataFrame:
    """did, th, text: the id with nulls replaced and a hash of id and text, together the key of a row."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"),
                       F.xxhash64("doc_id", "text").alias("th"), text_or_empty().alias("text"))


def _u(x: np.ndarray) -> np.ndarray:
    return np.asarray(x).astype(np.uint64)


def _batch(names: list[str], columns: list[np.ndarray]) -> pa.RecordBatch:
    kinds = {"a": pa.int32(), "lo": pa.int32(), "hi": pa.int32()}
    arrays = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c, kinds.get(n, pa.int64()))
              for n, c in zip(names, columns)]
    return pa.RecordBatch.from_arrays(arrays, names)


def pairs_of(lists: pa.Array) -> list[np.ndarray]:
    """(start, end) rows of each list; a null is an empty one."""
    flat = lists.flatten()
    pairs = np.stack([flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2)], axis=1)
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.split(pairs, np.cumsum(sizes)[:-1]) if len(sizes) else []


def merged(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint, non-adjacent (start, end) rows of all lists in order, and their number in each list."""
    sizes = [len(x) for x in lists]
    s, row = np.concatenate(lists), np.repeat(np.arange(len(lists)), sizes)
    if not len(s):
        return s, np.array(sizes)
    apart = row * (s.max() + 2)
    order = np.argsort(s[:, 0] + apart, kind="stable")
    s, row, apart = s[order], row[order], apart[order]
    reach = np.maximum.accumulate(s[:, 1] + apart)
    new = np.concatenate([[True], s[1:, 0] + apart[1:] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(s) - 1]])
    return np.stack([s[new, 0], (reach - apart)[last]], axis=1), np.bincount(row[new], minlength=len(lists))


ROWS = "did long, th long, a int, lo int, hi int, hq long, bucket long, refined long"
_NAMES = ["did", "th", "a", "lo", "hi", "hq", "bucket", "refined"]


def anchors(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Round 1 rows: one per anchor of each document, or of each part of it that the spans in ``within`` cover."""
    gram = length // 8

    def run(batches):
        for batch in (part for batch in batches for part in slices(batch)):
            ids, keys, texts = (batch.column(i).to_pylist() for i in range(3))
            within = [x.tolist() for x in pairs_of(batch.column(3))] if batch.num_columns > 3 else [None] * len(ids)
            out, held = [], 0
            for did, th, text, parts in zip(ids, keys, texts, within):
                whole_text = np.frombuffer(text.encode(), np.uint8)
                for start, end in [(0, len(whole_text))] if parts is None else parts:
                    data = whole_text[start:end]
                    if len(data) < length:
                        continue
                    q = qgram_buckets(data, gram)
                    a, lo, hi = anchor_ranges(q, len(data) - length + 1, span_of(length))
                    whole = mix(mix(mix(bucket_at(q, lo, length, gram), bucket_at(q, hi, length, gram)), _u(a - lo)),
                                _u(hi - lo))
                    n = len(a)
                    out.append((np.full(n, did), np.full(n, th), a + start, lo + start, hi + start, q[a], q[a], whole))
                    held += n
                if held > 200_000:
                    yield _batch(_NAMES, [np.concatenate(c) for c in zip(*out)])
                    out, held = [], 0
            if out:
                yield _batch(_NAMES, [np.concatenate(c) for c in zip(*out)])

    return docs.select("did", "th", "text", *[c for c in docs.columns if c == "within"]).mapInArrow(run, ROWS)


def blocks(contexts: DataFrame, size: int, length: int = LENGTH) -> DataFrame:
    """Rows of the next round: the offsets in ``ranges`` of each anchor cut into blocks of the given size."""
    gram = length // 8

    def run(batches):
        for batch in batches:
            did, th, a, lo, hq = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            text, ranges = batch.column(5), batch.column(6)
            ends = np.cumsum([len(b.as_buffer()) for b in text], dtype=np.int64)
            if not len(ends):
                continue
            start = np.concatenate([[0], ends[:-1]])
            q = qgram_buckets(np.frombuffer(b"".join(b.as_py() for b in text), np.uint8), gram)
            flat = ranges.flatten()
            p1, p2 = (np.asarray(flat.field(i)).astype(np.int64) for i in range(2))
            row = np.repeat(np.arange(len(ends)), ranges.value_lengths().to_numpy(zero_copy_only=False))
            first, last = (a[row] - p2) // size, (a[row] - p1) // size
            n = last - first + 1
            part = np.repeat(np.arange(len(row)), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[part]
            at = row[part]
            b1 = np.maximum(p1[part], a[at] - k * size - size + 1)
            b2 = np.minimum(p2[part], a[at] - k * size)
            shift = start[at] - lo[at]
            common = string_at(q, a[at] - k * size + shift, np.full(len(at), length - size + 1), gram)
            bucket = mix(mix(common, _u(k)), hq[at].view(np.uint64))
            cover = mix(mix(mix(bucket_at(q, b1 + shift, length, gram), bucket_at(q, b2 + shift, length, gram)),
                            _u(a[at] - b1)), _u(b2 - b1))
            for i in range(0, len(at), 200_000):
                s = slice(i, i + 200_000)
                yield _batch(_NAMES, [x[s] for x in (did[at], th[at], a[at], b1, b2, hq[at], bucket, cover)])

    return contexts.select("did", "th", "a", "lo", "hq", "context", "ranges").mapInArrow(run, ROWS)


def refine(rows: DataFrame) -> DataFrame:
    """Rows of buckets with two members or more, with two marks.

    ``twice``: the refined identifier has two members too, so the match starts are settled. ``onward``: the row goes into the
    next round, either because it is not settled or as the one witness of its settled string in a bucket where others
    are not: a part of that string may be what they share.
    """
    rows = rows.withColumn("row", F.xxhash64("did", "th", "a", "lo"))
    members = rows.groupBy("bucket", "refined").agg(F.count("*").alias("n"), F.min("row").alias("witness"))
    shared = members.groupBy("bucket").agg(F.sum("n").alias("total"), F.min("n").alias("least")).where("total > 1")
    state = members.join(shared, "bucket").select(
        "bucket", "refined", (F.col("n") > 1).alias("twice"),
        F.when(F.col("least") == 1, F.col("witness")).alias("witness"))
    joined = rows.join(state, ["bucket", "refined"])
    onward = ~F.col("twice") | F.coalesce(F.col("row") == F.col("witness"), F.lit(False))
    return stash(joined.withColumn("onward", onward).drop("bucket", "refined", "row", "witness"), "refined")


def shared(rows: DataFrame) -> DataFrame:
    """Rows of buckets with two members or more, counted by bucket alone: the others are left out before ``refine``."""
    twice = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    return stash(rows.join(twice, "bucket", "left_semi").select(*rows.columns), "shared")


def _contexts(docs: DataFrame, open_rows: DataFrame, length: int) -> DataFrame:
    """Bytes around the open anchors, from the first match start to the end of the last match."""

    def run(batches):
        for batch in (part for batch in batches for part in slices(batch)):
            out, held = [], 0
            for did, th, text, found in zip(*(batch.column(i).to_pylist() for i in range(4))):
                data = text.encode()
                out += [(did, th, f["a"], f["lo"], f["hi"], f["hq"], data[f["lo"]:f["hi"] + length]) for f in found]
                held += len(found)
                if held > 20_000:
                    yield rows_of(out)
                    out, held = [], 0
            if out:
                yield rows_of(out)

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    names = ["did", "th", "a", "lo", "hi", "hq", "context"]

    def rows_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    wanted = open_rows.groupBy("did", "th").agg(F.collect_set(F.struct("a", "lo", "hi", "hq")).alias("found"))
    return stash(docs.join(wanted, ["did", "th"]).select("did", "th", "text", "found").mapInArrow(
        run, "did long, th long, a int, lo int, hi int, hq long, context binary"), "contexts")


def _merge(found: DataFrame) -> DataFrame:
    """did, th and the spans of that row: disjoint, non-adjacent, in order."""
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, n = merged(pairs_of(batch.column(2)))
            pairs = pa.StructArray.from_arrays([pa.array(flat[:, i], pa.int32()) for i in range(2)], fields=list(kind))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["did", "th", "spans"])

    return found.groupBy("did", "th").agg(F.collect_set(F.struct("start", "end"))).mapInArrow(
        run, "did long, th long, spans array<struct<start: int, end: int>>")


def spans_by_row(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """did, th, spans: the byte spans covered by repeated strings of ``length`` bytes, for rows that have some.

    ``length`` is a multiple of eight, and at least 64. Rows that repeat id and text have their spans once. A column
    ``within`` of spans restricts the search to the bytes they cover: the spans of a shorter length lose no match.
    """
    spark = docs.sparkSession
    first = stash(anchors(docs, length), "anchors")
    some = shared(first)
    discard(first)
    whole = refine(some)
    discard(some)
    drop_shuffles(spark)
    contexts = _contexts(docs, whole.where("onward"), length)
    one = contexts.withColumn("ranges", F.array(F.struct(F.col("lo").alias("p1"), F.col("hi").alias("p2"))))
    parts = stash(blocks(one, BLOCK, length), "blocks")
    coarse = refine(parts)
    discard(parts)
    drop_shuffles(spark)
    left = coarse.where("onward").groupBy("did", "th", "a").agg(
        F.collect_set(F.struct(F.col("lo").alias("p1"), F.col("hi").alias("p2"))).alias("ranges"))
    # A block of one start is its own cover: its bucket says all.
    starts = stash(blocks(contexts.join(left, ["did", "th", "a"]), 1, length).select("did", "th", "lo", "hi", "bucket"),
                   "starts")
    discard(contexts)
    fine = shared(starts)
    discard(starts)
    drop_shuffles(spark)
    settled = (whole.where("twice"), coarse.where("twice"), fine)
    found = [r.select("did", "th", F.col("lo").alias("start"), (F.col("hi") + length).alias("end")) for r in settled]
    spans = stash(_merge(found[0].union(found[1]).union(found[2])), "spans")
    discard(whole, coarse, fine)
    return spans


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """did, th, start, end: one row per span of ``spans_by_row``."""
    return spans_by_row(docs, length).select("did", "th", F.inline("spans"))


def _cut(data: bytes, spans: np.ndarray) -> bytes:
    at, kept = 0, []
    for a, b in spans.tolist():
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return b"".join(kept)


def whole_characters(data: bytes, spans: np.ndarray) -> np.ndarray:
    """Spans shrunk to whole UTF-8 characters: a character that is covered in part stays."""
    out = []
    for a, b in spans.tolist():
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while a < b and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


def _without(text: str, data: bytes, spans: np.ndarray) -> str:
    return _cut(data, whole_characters(data, spans)).decode() if len(spans) else text


def of_words(data: bytes, spans: np.ndarray, least: int) -> np.ndarray:
    """The spans that hold at least so many whole words (between ASCII white space)."""
    out = []
    for a, b in spans.tolist():
        words = data[max(0, a - 1):b + 1].split()
        n = len(words) - (a > 0 and not data[a - 1:a].isspace()) - (b < len(data) and not data[b:b + 1].isspace())
        if n >= least:
            out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


def remove_repeats(docs: DataFrame, carry: list[str] | None = None, with_text: bool = False, length: int = LENGTH,
                   least_words: int = 0, passages: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row, with the columns named in ``carry``.

    ``length``: bytes of a repeated string. ``least_words``: spans of fewer whole words stay. ``with_text`` adds
    ``kept_text``: the text without the spans, each shrunk to whole characters. ``passages``, bytes below ``length`` and
    words, adds ``passage_text``: the text without the repeated passages of so many bytes and whole words. Those are
    found first; a repeated string of ``length`` lies within the spans of the shorter one, so only these are searched.
    """
    carry = carry or []
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"),
                       F.xxhash64("doc_id", "text").alias("th"), text_or_empty().alias("text"),
                       F.struct("doc_id", *carry).alias("_carried"))
    here = ["did", "th"]
    if passages:
        shorter = spans_by_row(keyed(docs), passages[0]).withColumnRenamed("spans", "within")
        reach = F.exists("within", lambda x: x["end"] - x["start"] >= length)
        rows = stash(rows.join(shorter, here, "left").withColumn("long", F.coalesce(reach, F.lit(False))), "passages")
        some = rows.where("long")
        drop_shuffles(docs.sparkSession)
        spans = spans_by_row(some.select(*here, "text", "within"), length)
        joined = some.join(spans, here, "left").unionByName(
            rows.where("not long").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType)))
    else:
        joined = rows.join(spans_by_row(keyed(docs), length), here, "left").withColumn(
            "within", F.col("spans"))
    texts = ["kept_text"] * with_text + ["passage_text"] * bool(passages)
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *texts]
    own = schema_with(docs, [], ", ".join(["n_bytes long, n_removed long, n_spans long, kept_sha256 string",
                                           *(f"{n} string" for n in texts)]))
    schema = StructType(own.fields + [docs.schema[c] for c in ["doc_id", *carry]])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out = {n: [] for n in names}
                for text, cut, short in zip(part.column(0).to_pylist(), *(pairs_of(part.column(i)) for i in (1, 2))):
                    data = text.encode()
                    if least_words:
                        cut = of_words(data, cut, least_words)
                    out["n_bytes"].append(len(data))
                    out["n_removed"].append(int((cut[:, 1] - cut[:, 0]).sum()))
                    out["n_spans"].append(len(cut))
                    out["kept_sha256"].append(hashlib.sha256(_cut(data, cut)).hexdigest())
                    if with_text:
                        out["kept_text"].append(_without(text, data, cut))
                    if passages:
                        out["passage_text"].append(_without(text, data, of_words(data, short, passages[1])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v) for v in out.values()] + part.columns[3:], [*out, "doc_id", *carry])

    return joined.select(F.col("text").alias("_text"), "spans", "within", "_carried.*").mapInArrow(run, schema)
