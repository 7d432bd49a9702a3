"""Sparse matrix products in tiles, without a shuffle of products.

Two long matrices (entity, key, w) are packed into blocks of whole entities; a block is one compressed row, stored once in
the checkpoint folder. Every pair of blocks is one task of a Cartesian product, which reads both and needs no shuffle. It
expands the entries that share a key in chunks of bounded size and adds them up, so all sums over the keys are whole inside
a tile and only what is asked for leaves it: heads of a few rows per entity, or the pairs themselves.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.session import drop_shuffles, settle

#: Entries of a left and of a right block, on average; products that are held at a time.
LEFT_ENTRIES, RIGHT_ENTRIES, PRODUCTS = 500_000, 4_000_000, 1 << 20
#: Rows that are dealt at a time.
DEALT = 200_000
#: Cells of a chunk that are added up as a dense array, per product; beyond that the products are sorted.
CELLS = 16


def _coded(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Distinct values in order (numbers by value, texts by their bytes) and the place of each entry among them."""
    coded = column if pa.types.is_dictionary(column.type) else pc.dictionary_encode(column)
    coded = coded.unify_dictionaries().combine_chunks()
    coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy()]


def _dump(block: dict) -> bytes:
    raw = pickle.dumps({k: pa.RecordBatch.from_arrays([v], ["v"]).serialize().to_pybytes() if isinstance(v, pa.Array) else v
                        for k, v in block.items()}, protocol=5)
    return pickle.dumps((len(raw), {k: v.type for k, v in block.items() if isinstance(v, pa.Array)},
                         pa.compress(raw, "zstd", asbytes=True)), protocol=5)


def _load(data: bytes) -> dict:
    size, kinds, packed = pickle.loads(data)
    block = pickle.loads(pa.decompress(packed, size, "zstd", asbytes=True))
    return {k: pa.ipc.read_record_batch(v, pa.schema([("v", kinds[k])])).column(0) if k in kinds else v for k, v in block.items()}


def give_back() -> None:
    """Return freed memory to the system; Spark keeps a task's worker process for the tasks of later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _parts(column: pa.ChunkedArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Part of each entry by a hash of its value, and the place of the value: rows of a part in its order pack well."""
    names, place = _coded(column)
    return (pd.util.hash_array(names.to_numpy(zero_copy_only=False)) % np.uint64(n)).astype(np.int32)[place], place


def deal(rows: DataFrame, column: str, n: int) -> DataFrame:
    """Rows dealt by a hash of ``column`` into ``n`` partitions, as compressed record batches ``data``: a few bytes a row."""
    n = max(1, n)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= DEALT:
                yield from cut(held)
                held, size = [], 0
        if size:
            yield from cut(held)
        give_back()

    def cut(held):
        table = pa.Table.from_batches(held)
        part, place = _parts(table.column(column), n)
        order = np.lexsort((place, part))
        table = table.take(pa.array(order)).combine_chunks()
        found, starts = np.unique(part[order], return_index=True)
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        data = []
        for a, b in zip(starts, [*starts[1:], table.num_rows]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=options) as out:
                out.write_table(table.slice(a, b - a))
            data.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_pydict({"part": pa.array(found, pa.int32()), "data": pa.array(data, pa.binary())})

    return rows.mapInArrow(run, "part int, data binary").repartitionById(n, "part").select("data")


def undealt(batches):
    """Record batches of the dealt rows."""
    for batch in batches:
        for data in batch.column(0):
            with pa.ipc.open_stream(pa.py_buffer(data.as_py())) as found:
                yield from found


def _coded_batches(batches, columns):
    """Columns of many batches, texts and keys as codes among their distinct values while they arrive."""
    held = []
    for batch in batches:
        if batch.num_rows:
            held.append(pa.RecordBatch.from_arrays(
                [c.dictionary_encode() if n in columns else c for n, c in zip(batch.schema.names, batch.columns)], batch.schema.names))
    return pa.Table.from_batches(held) if held else None


def pack(rows: DataFrame, entity: str, key: str, weight: str, by_key: bool, entries: int, least: int = 1,
         more: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """One row ``data`` per block of entities. Entries lie by entity, or by key with ``by_key``.

    ``more`` (entity, other): a second list of each entity, such as what a user owns; repeated rows count once. ``n``: rows at most, where counting
    would compute them.
    """
    known = rows.filter(F.col(entity).isNotNull() & F.col(key).isNotNull()).select(
        F.col(entity).alias("e"), F.col(key).alias("k"), F.col(weight).cast("double").alias("w"))
    n = rows.count() if n is None else n
    if more is not None:
        e, o = more.columns
        known = known.withColumn("o", F.lit(None).cast(more.schema[o].dataType)).unionByName(more.filter(
            F.col(e).isNotNull() & F.col(o).isNotNull()).select(
            F.col(e).alias("e"), F.lit(None).cast(known.schema["k"].dataType).alias("k"), F.lit(None).cast("double").alias("w"),
            F.col(o).alias("o")))

    two = more is not None

    def run(batches):
        table = _coded_batches(undealt(batches), ("e", "k", "o"))
        if table is None:
            return
        names, ent = _coded(table.column("e"))
        first = pc.is_valid(table.column("k")).to_numpy()
        part = table.filter(pa.array(first)) if two else table
        keys, key_of = _coded(part.column("k"))
        own, w = ent[first], part.column("w").to_numpy()
        order = np.lexsort((own, key_of) if by_key else (key_of, own))
        own, key_of, w = own[order], key_of[order], w[order]
        block = {"names": names, "keys": keys, "w": w if (w != 1).any() else None,
                 "d": np.bincount(own, w * w, len(names)), "n": np.bincount(own, minlength=len(names))}
        block["e"], block["k"] = (own, np.bincount(key_of, minlength=len(keys))) if by_key else (
            np.bincount(own, minlength=len(names)), key_of)
        if two:
            rest = table.filter(pa.array(~first))
            other, code = _coded(rest.column("o"))
            listed = np.unique(ent[~first].astype(np.int64) * max(1, len(other)) + code)
            block |= {"other": other, "oe": (listed // max(1, len(other))).astype(np.int32), "oc": (listed % max(1, len(other))).astype(np.int32)}
        del table, own, key_of, w, order, ent, first
        yield pa.RecordBatch.from_pydict({"data": pa.array([_dump(block)], pa.binary())})
        del block
        give_back()

    blocks = settle(deal(known, "e", max(least, -(-n // entries))).mapInArrow(run, "data binary"))
    drop_shuffles(rows.sparkSession)
    return blocks


def _codes(values: pa.Array, among: pa.Array) -> np.ndarray:
    """Place of each value in ``among``, -1 where it is missing."""
    return pc.index_in(values, value_set=among).fill_null(-1).to_numpy()


def expand(at: np.ndarray, ptr: np.ndarray):
    """For places ``at`` (-1: none) in a list cut by ``ptr``: sizes of their runs, and the places of all entries."""
    size = np.where(at < 0, 0, ptr[at + 1] - ptr[at])
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return size, np.repeat(ptr[at] - (ends - size), size) + np.arange(total)


def pointers(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def chunks(left: dict, right: dict):
    """(first, last, i, j, c, m): sums ``c`` of products and numbers ``m`` of shared keys of the pairs (i, j) of entities that
    share one, in order, for the left entities from ``first`` to before ``last``."""
    n_i, n_j = len(left["names"]), len(right["names"])
    key = _codes(left["keys"], right["keys"])[left["k"]] if len(left["k"]) else left["k"]
    by_key, by_ent = pointers(right["k"]), pointers(left["e"])
    size = np.where(key < 0, 0, by_key[key + 1] - by_key[key])
    ends = pointers(size)[by_ent]  # products before each entity
    first = 0
    while first < n_i:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + PRODUCTS, "right")) - 1)
        s = slice(by_ent[first], by_ent[last])
        width, place = expand(key[s], by_key)
        owner = np.repeat(np.arange(last - first), left["e"][first:last])
        code = np.repeat(owner, width) * n_j + right["e"][place]
        value = None
        if left["w"] is not None:
            value = np.repeat(left["w"][s], width)
        if right["w"] is not None:
            value = right["w"][place] if value is None else value * right["w"][place]
        cells = (last - first) * n_j
        if cells <= CELLS * len(code):
            m = np.bincount(code, minlength=cells)
            pair = np.flatnonzero(m)
            c = m[pair].astype(float) if value is None else np.bincount(code, value, cells)[pair]
            m = m[pair]
        elif value is None:
            pair, m = np.unique(code, return_counts=True)
            c = m.astype(float)
        else:
            order = np.argsort(code, kind="stable")
            code = code[order]
            starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.empty(0, np.int64)
            pair, m = code[starts], np.diff(np.append(starts, len(code)))
            c = np.add.reduceat(value[order], starts) if len(starts) else np.empty(0)
        yield first, last, first + pair // n_j, pair % n_j, c, m
        first = last


def heads(i: np.ndarray, j: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each i: score descending, then j."""
    order = np.lexsort((j, -score, i))
    at = i[order]
    start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.empty(0, np.int64)
    rank = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
    return order[rank < k]


def tiles(left: DataFrame, right: DataFrame, work, schema: str) -> DataFrame:
    """Rows that ``work(left block, right block)`` yields, as lists of arrays, for every pair of blocks."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches):
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1)):
                for columns in work(_load(a.as_py()), _load(b.as_py())):
                    for s in range(0, len(columns[0]), 100_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c[s:s + 100_000]) for c in columns], names)
        give_back()

    both = left.select(F.col("data").alias("a")).crossJoin(right.select(F.col("data").alias("b")))
    return both.mapInArrow(run, schema)


def cosine(left: dict, right: dict, i: np.ndarray, j: np.ndarray, c: np.ndarray) -> np.ndarray:
    return c / np.sqrt(left["d"][i] * right["d"][j])


def packed_pairs(rows: DataFrame, key: str, entity: str, weight: str) -> tuple[DataFrame, DataFrame]:
    """The same matrix as left and right blocks."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (pack(rows, entity, key, weight, False, LEFT_ENTRIES, least), pack(rows, entity, key, weight, True, RIGHT_ENTRIES))


def cosine_pairs(blocks: tuple[DataFrame, DataFrame], kind: str) -> DataFrame:
    """i < j, sim, m."""
    def work(left, right):
        n = len(right["names"])
        every, place = _coded(pa.chunked_array([right["names"], left["names"]]))
        after = np.cumsum(np.bincount(place[:n], minlength=len(every)))[place[n:]]  # right entities up to each left one
        for _a, _b, i, j, c, m in chunks(left, right):
            up = j >= after[i]
            i, j, c, m = i[up], j[up], c[up], m[up]
            yield [left["names"].take(pa.array(i)), right["names"].take(pa.array(j)), cosine(left, right, i, j, c), m.astype(np.int64)]

    return tiles(*blocks, work, f"i {kind}, j {kind}, sim double, m long")


def cosine_heads(blocks: tuple[DataFrame, DataFrame], kind: str, k: int) -> DataFrame:
    """i, j, sim of the k best of each tile, similarity > 0."""
    def work(left, right):
        same = _codes(left["names"], right["names"])
        for _a, _b, i, j, c, _m in chunks(left, right):
            sim = cosine(left, right, i, j, c)
            some = (j != same[i]) & (sim > 0)
            i, j, sim = i[some], j[some], sim[some]
            best = heads(i, j, sim, k)
            yield [left["names"].take(pa.array(i[best])), right["names"].take(pa.array(j[best])), sim[best]]

    return tiles(*blocks, work, f"i {kind}, j {kind}, sim double")


def vote_heads(left: DataFrame, right: DataFrame, user_kind: str, item_kind: str, k: int) -> DataFrame:
    """user_id, item_id, score: the k best sums of each tile, to ten places, without what the user owns (``more`` of left)."""
    def work(left, right):
        n_j = len(right["names"])
        own = _codes(left["other"], right["names"])[left["oc"]] if len(left["oc"]) else left["oc"]
        own = np.sort(left["oe"][own >= 0].astype(np.int64) * n_j + own[own >= 0])
        for _a, _b, i, j, c, _m in chunks(left, right):
            code = i * n_j + j
            at = np.minimum(np.searchsorted(own, code), len(own) - 1)
            fresh = own[at] != code if len(own) else np.ones(len(code), bool)
            i, j, score = i[fresh], j[fresh], np.round(c[fresh], 10)
            best = heads(i, j, score, k)
            yield [left["names"].take(pa.array(i[best])), right["names"].take(pa.array(j[best])), score[best]]

    return tiles(left, right, work, f"user_id {user_kind}, item_id {item_kind}, score double")


def best(rows: DataFrame, by: str, other: str, score: str, k: int) -> DataFrame:
    """The k best rows of each ``by`` with their ``rank``: score descending, then ``other``. For heads of tiles, a few per row."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        table = _coded_batches(undealt(batches), (by, other))
        if table is None:
            return
        (names, i), (others, j) = _coded(table.column(by)), _coded(table.column(other))
        found = table.column(score).to_numpy()
        at = heads(i, j, found, k)
        i, j, found = i[at], j[at], found[at]
        start = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
        rank = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i)))) + 1
        for s in range(0, len(i), 100_000):
            p = slice(s, s + 100_000)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(i[p])), others.take(pa.array(j[p])), pa.array(found[p]),
                                              pa.array(rank[p], pa.int32())], [by, other, score, "rank"])
        give_back()

    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return deal(rows.select(by, other, score), by, n).mapInArrow(
        run, f"{by} {kind[by]}, {other} {kind[other]}, {score} double, rank int")


def _sums(rows: DataFrame) -> DataFrame:
    """Sum of ``score`` of each (e, o), dealt by e."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        table = _coded_batches(undealt(batches), ("e", "o"))
        if table is None:
            return
        (names, i), (others, j) = _coded(table.column("e")), _coded(table.column("o"))
        pair, place = np.unique(i.astype(np.int64) * len(others) + j, return_inverse=True)
        total = np.bincount(place, table.column("score").to_numpy(), len(pair))
        for s in range(0, len(pair), 100_000):
            p = pair[s:s + 100_000]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(p // len(others))), others.take(pa.array(p % len(others))),
                                              pa.array(total[s:s + 100_000])], ["e", "o", "score"])
        give_back()

    return deal(rows, "e", n).mapInArrow(run, "e string, o string, score double")


def profile_cosines(owned: DataFrame, targets: DataFrame) -> DataFrame:
    """e, o, score: for each target (e, o) the sum of the binary cosines of item o to the items that e owns.

    ``owned`` (e, k): distinct users and items, as text. The cosine of o and k is their common owners v over the roots of both
    numbers of owners, so the sum is that of G(e, v) over the owners v of o, over the root of o's owners; G(e, v) adds up one over
    the root of the owners of every item that e and v share. G comes from tiles users x users; no pair of items is formed.
    """
    owners = owned.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    weighted = owned.join(owners, "k").select("e", "k", (1 / F.sqrt("n")).alias("w"))
    least, n = int(owned.sparkSession.conf.get("spark.sql.shuffle.partitions")), owned.count()
    right = pack(weighted, "e", "k", "w", True, RIGHT_ENTRIES, n=n)
    left = pack(owned.withColumn("w", F.lit(1.0)), "e", "k", "w", False, LEFT_ENTRIES, least, more=targets.select("e", "o"), n=n)

    def work(left, right):
        n_j, by_key = len(right["names"]), pointers(right["k"])
        user, item = left["oe"], left["oc"]
        at = _codes(left["other"], right["keys"])[item] if len(item) else item
        weight = right["w"] if right["w"] is not None else np.ones(len(right["e"]))
        for first, last, i, j, c, _m in chunks(left, right):
            pair = np.append(i * n_j + j, -1)
            start, stop = np.searchsorted(user, [first, last])
            while start < stop:
                size = np.cumsum(np.where(at[start:stop] < 0, 0, by_key[at[start:stop] + 1] - by_key[at[start:stop]]))
                end = start + max(1, int(np.searchsorted(size, PRODUCTS, "right")))
                width, place = expand(at[start:end], by_key)
                target = np.repeat(np.arange(end - start), width)
                code = user[start:end][target].astype(np.int64) * n_j + right["e"][place]
                found = np.minimum(np.searchsorted(pair[:-1], code), len(pair) - 1)
                score = np.bincount(target, np.where(pair[found] == code, np.append(c, 0.0)[found] * weight[place], 0.0), end - start)
                some = np.flatnonzero(score)
                yield [left["names"].take(pa.array(user[start:end][some])), left["other"].take(pa.array(item[start:end][some])), score[some]]
                start = end

    return _sums(tiles(left, right, work, "e string, o string, score double"))
