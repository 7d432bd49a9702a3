"""Token ids stored as wavelet matrices, one self-contained compressed shard at a time.

A wavelet matrix keeps one bit-plane per bit of an id, from the highest down; each plane is the sequence stably split
by the bits above, so rank counts on the planes give ``access`` (the id at a position), ``rank`` / ``count``
(occurrences of an id in a range) and ``select`` (position of the k-th occurrence) without unpacking the ids.
Claude, Navarro, Ordonez (2015).

``write_shards`` encodes documents in ascending doc_id order and writes shards of about ``SHARD_TOKENS`` ids as rows
of Parquet files, one file per range of ids; ``read_tokens`` reads ids back from the files alone, and
``count_token`` / ``locate_token`` answer over all shards by their planes.

Defined cases: a null or empty text is the end id alone; null ids sort first, repeated ids follow their text and are all
kept; a document is never cut, so one above the shard size makes a larger shard; no rows give no shards; other
columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import stash, text_or_empty

SHARD_TOKENS = 1 << 19
#: Bits per entry of the rank directory.
BLOCK = 512
_HEAD = struct.Struct("<4sBQ")
_MAGIC = b"WVM1"


class WaveletMatrix:
    """Bit-planes with rank and select over one sequence of ids."""

    def __init__(self, n: int, planes: list[np.ndarray]):
        self.n, self.planes, self.bits = n, planes, len(planes)
        self._ones: list[np.ndarray] | None = None

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        seq, planes = np.asarray(ids, dtype=np.uint16 if bits <= 16 else np.uint32), []
        for b in range(bits - 1, -1, -1):
            one = (seq >> b & 1).astype(bool)
            planes.append(np.packbits(one, bitorder="little"))
            seq = np.concatenate([seq[~one], seq[one]])
        return cls(len(seq), planes)

    def to_bytes(self) -> bytes:
        raw = b"".join(p.tobytes() for p in self.planes)
        return _HEAD.pack(_MAGIC, self.bits, self.n) + zstandard.compress(raw, 1)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        magic, bits, n = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a wavelet shard")
        width = (n + 7) // 8
        raw = np.frombuffer(zstandard.decompress(data[_HEAD.size:], width * bits or 1), np.uint8)
        return cls(n, [raw[i * width:(i + 1) * width] for i in range(bits)])

    def decode(self) -> np.ndarray:
        """All ids, by undoing the splits from the lowest plane up."""
        dtype = np.uint16 if self.bits <= 16 else np.uint32
        seq = np.zeros(self.n, dtype)
        for b, plane in enumerate(reversed(self.planes)):
            one = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            zeros = self.n - np.count_nonzero(one)
            above = np.empty(self.n, dtype)
            above[~one] = seq[:zeros]
            above[one] = seq[zeros:] | dtype(1 << b)
            seq = above
        return seq

    @property
    def ones(self) -> list[np.ndarray]:
        """Rank directory: ones before each block of each plane."""
        if self._ones is None:
            self._ones = []
            for plane in self.planes:
                counts = np.add.reduceat(np.bitwise_count(plane), np.arange(0, len(plane), BLOCK // 8), dtype=np.int64) \
                    if len(plane) else np.zeros(0, np.int64)
                self._ones.append(np.concatenate([[0], np.cumsum(counts)]))
        return self._ones

    def _rank1(self, level: int, i: int) -> int:
        block, rest = divmod(i, BLOCK)
        out = int(self.ones[level][block])
        if rest:
            part = self.planes[level][block * (BLOCK // 8):block * (BLOCK // 8) + (rest + 7) // 8]
            out += int(np.unpackbits(part, count=rest, bitorder="little").sum())
        return out

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (i & 7) & 1

    def _zeros(self, level: int) -> int:
        return self.n - int(self.ones[level][-1])

    def access(self, i: int) -> int:
        out = 0
        for level in range(self.bits):
            bit = self._bit(level, i)
            out = out << 1 | bit
            ahead = self._rank1(level, i)
            i = self._zeros(level) + ahead if bit else i - ahead
        return out

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token >> self.bits:
            return 0, 0
        for level in range(self.bits):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            if token >> (self.bits - 1 - level) & 1:
                lo, hi = self._zeros(level) + a, self._zeros(level) + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of the id in positions lo to hi."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def rank(self, token: int, i: int) -> int:
        return self.count(token, 0, i)

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of this kind in a plane."""
        ahead = self.ones[level]
        if not bit:
            ahead = np.minimum(np.arange(len(ahead)) * BLOCK, self.n) - ahead
        block = int(np.searchsorted(ahead, k, side="right")) - 1
        start = block * BLOCK
        some = np.unpackbits(self.planes[level][start // 8:(start + BLOCK) // 8], bitorder="little")
        return start + int(np.flatnonzero(some == bit)[k - int(ahead[block])])

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of the id."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            i = self._select_bit(level, bit, i - self._zeros(level) if bit else i)
        return i

    def locate(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]


#: A word of Latin letters (none of which changes its kind when lower-cased) and the run of marks after it.
_SIMPLE = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([-.,;:!?%&*+/#$@=)]*)").fullmatch


def _byte_letters() -> dict[int, str]:
    """The visible character that byte-level BPE writes for each byte: itself where printable, else one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class PieceEncoder(dict):
    """Ids of a text from its space-separated pieces; the mapping holds the pieces met so far.

    The tokenizer drops white space and never joins across it, so pieces cut at space and line feed encode
    as they do inside the text. A piece that is one Latin word, perhaps with marks after it, goes straight to the
    library's BPE model, lower-cased and in byte letters; any other piece takes its whole path. The memories of
    pieces and of words are emptied when they hold ``most`` of them, between two batches.
    """

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most, self.words = Tokenizer.from_file(path), most, {}
        self.letters = _byte_letters()
        self.model = self.tokenizer.model

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            found = self.words[word] = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return found

    def __missing__(self, piece: str) -> bytes:
        if simple := _SIMPLE(piece):
            word, marks = simple.groups()
            found = self._word(word.lower())
            if marks:
                found += self._word(marks)
        else:
            found = array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        self[piece] = found
        return found

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        if len(self) > self.most:
            self.clear()
        if len(self.words) > self.most // 2:
            self.words.clear()
        known = self.__getitem__
        return [np.frombuffer(b"".join(map(known, t.replace("\n", " ").split(" "))), np.uint32) for t in texts]


_ENCODERS: dict[str, PieceEncoder] = {}

SHARD_SCHEMA = ("part int, shard int, part_start long, n_tokens long, doc_ids array<bigint>, lengths array<bigint>, "
                "payload binary")


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 1, bits: int = 16) -> DataFrame:
    """Shards of the encoded documents, written and read back: SHARD_SCHEMA. ``bits`` covers the ids."""

    def shards(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _ENCODERS.get(tokenizer_path)
        if encoder is None:
            encoder = _ENCODERS[tokenizer_path] = PieceEncoder(tokenizer_path)
        part, number, start = TaskContext.get().partitionId(), 0, 0
        ids, arrays, held = [], [], 0

        def flush():
            nonlocal number, start, ids, arrays, held
            payload = WaveletMatrix.build(np.concatenate(arrays), bits).to_bytes()
            row = pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "shard": pa.array([number], pa.int32()),
                "part_start": [start], "n_tokens": [held], "doc_ids": pa.array([ids], pa.list_(pa.int64())),
                "lengths": pa.array([[len(a) for a in arrays]], pa.list_(pa.int64())),
                "payload": pa.array([payload], pa.binary())})
            number, start, ids, arrays, held = number + 1, start + held, [], [], 0
            return row

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(texts), 500):
                for name, found in zip(names[at:at + 500], encoder.batch(texts[at:at + 500])):
                    if found.size and int(found.max()) >> bits:
                        raise ValueError(f"an id needs more than {bits} bits")
                    ids.append(name)
                    arrays.append(np.append(found, np.uint32(end_id)).astype(np.uint16 if bits <= 16 else np.uint32))
                    held += len(arrays[-1])
                    if held >= SHARD_TOKENS:
                        yield flush()
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stash(ordered.mapInArrow(shards, SHARD_SCHEMA), "wavelet")


def _with_starts(shards: DataFrame) -> DataFrame:
    """Add ``start``: ids before the shard. One total per partition of the writer, not per shard, is broadcast."""
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    return shards.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("part_start"))


def read_tokens(shards: DataFrame) -> DataFrame:
    """Per document, from the shards: doc_id, start, n_tokens, ids_crc32 (ids as little-endian unsigned 32 bits)."""

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                tokens = WaveletMatrix.from_bytes(row["payload"]).decode().astype("<u4")
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                begins = ends - lengths
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(row["doc_ids"], pa.int64()), "start": begins + row["start"],
                    "n_tokens": lengths,
                    "ids_crc32": pa.array([zlib.crc32(tokens[a:b]) for a, b in zip(begins, ends)], pa.int64())})

    needed = _with_starts(shards).select("start", "doc_ids", "lengths", "payload")
    return needed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def count_token(shards: DataFrame, token: int) -> DataFrame:
    """Occurrences of an id per shard, by rank: part, shard, n."""

    def count(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n = WaveletMatrix.from_bytes(row["payload"]).count(token)
                yield pa.RecordBatch.from_pydict({"part": pa.array([row["part"]], pa.int32()),
                                                  "shard": pa.array([row["shard"]], pa.int32()), "n": [n]})

    return shards.select("part", "shard", "payload").mapInArrow(count, "part int, shard int, n long")


def locate_token(shards: DataFrame, token: int) -> DataFrame:
    """Global positions of an id, by select: position."""

    def locate(batches):
        for batch in batches:
            for row in batch.to_pylist():
                found = np.array(WaveletMatrix.from_bytes(row["payload"]).locate(token), np.int64)
                yield pa.RecordBatch.from_pydict({"position": found + row["start"]})

    return _with_starts(shards).select("start", "payload").mapInArrow(locate, "position long")
