"""Hashed character n-gram counts of whole texts, and sums of vectors over partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: log2 of the number of hashed features.
BITS = 15
DIMS = 1 << BITS
#: Texts and code points that are counted at once; a longer text is counted in slices.
CHUNK_TEXTS, CHUNK_CHARS = 32, 400_000
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def _add(counts: np.ndarray, codes: np.ndarray, row: np.ndarray, longest: int, first_row: bool) -> None:
    """Add the n-grams (1 to ``longest``) of concatenated code points; ``row`` is the text of each."""
    rows = len(counts)
    for n in range(1, longest + 1):
        if len(codes) < n:
            return
        h = np.full(len(codes) - n + 1, n * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ codes[k:len(codes) - n + 1 + k]) * _MULTIPLIERS[k]
            h ^= h >> np.uint32(15)
        flat = (h >> np.uint32(32 - BITS)).astype(np.int64)
        flat += row[:len(flat)] * DIMS
        if n > 1 and not first_row:
            flat = flat[row[:len(flat)] == row[n - 1:]]
        counts += np.bincount(flat, minlength=rows * DIMS).reshape(rows, DIMS)


def count_chunks(texts: list[str], longest: int = 3) -> Iterator[tuple[int, np.ndarray]]:
    """(index of the first text, counts of shape (texts, DIMS)) over all texts in order."""
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and end - at < CHUNK_TEXTS and (end == at or chars + len(texts[end]) <= CHUNK_CHARS):
            chars += len(texts[end])
            end += 1
        counts = np.zeros((end - at, DIMS), np.int64)
        if chars > CHUNK_CHARS:
            text = texts[at]
            for i in range(0, len(text), CHUNK_CHARS):
                part = np.frombuffer(text[i:i + CHUNK_CHARS].encode("utf-32-le"), np.uint32)
                _add(counts, part, np.zeros(len(part), np.int64), longest, True)
                for n in range(2, longest + 1):  # n-grams across the slice's end
                    edge = i + CHUNK_CHARS
                    if edge < len(text):
                        _across(counts, text[max(0, edge - n + 1):edge + n - 1], n)
        else:
            sizes = [len(t) for t in texts[at:end]]
            codes = np.frombuffer("".join(texts[at:end]).encode("utf-32-le"), np.uint32)
            _add(counts, codes, np.repeat(np.arange(end - at), sizes), longest, end - at == 1)
        yield at, counts
        at = end


def _across(counts: np.ndarray, text: str, n: int) -> None:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if len(codes) >= n:
        only = np.zeros_like(counts)
        lower = np.zeros_like(counts)
        row = np.zeros(len(codes), np.int64)
        _add(only, codes, row, n, True)
        _add(lower, codes, row, n - 1, True)
        counts += only - lower


def sum_vectors(rows: DataFrame, width: int = 64) -> DataFrame:
    """One row with the sum of the int64 vectors in the binary column ``vector``: first over ``width`` tasks, then one."""

    def add(batches):
        total = None
        for batch in batches:
            for v in batch.column(0).to_pylist():
                v = np.frombuffer(v, np.int64)
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_pydict({"vector": pa.array([total.tobytes()], pa.binary())})

    some = rows.select("vector").repartition(width).mapInArrow(add, "vector binary")
    return some.repartition(1).mapInArrow(add, "vector binary")
