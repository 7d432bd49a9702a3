"""Byte-level BPE in DuckDB, one in-memory database per task.

Encoding: every distinct word of a batch becomes token-position rows, one per byte. A recursive query joins each
neighbouring pair with the merge table, takes each word's leftmost pair of least rank, contracts it, and ends when
no pair of any word is in the table. Words longer than ``LONG_WORD`` bytes contract, in one round, their hits of the
least rank from the left up to the first one that brings up a pair of lower rank, which is what the single steps would
do. Long words run ``ROUNDS`` rounds per call and go on from the state they reached, so what a call gathers is
bounded. Decoding: an ordered aggregation of the bytes of a word's ids. A text's ids and bytes are those of its words
in order; a task keeps the words it has met, up to a bound, and starts anew beyond it.

Defined cases: a null or empty text has no ids; texts of any length are encoded whole; repeated rows give
repeated results; null ids are kept; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import give_back, schema_with, slices, text_or_empty

LONG_WORD = 64
ROUNDS = 64
#: Rows of bytes that one encoding query starts from, and ids that one decoding query takes.
ENCODE_ROWS, DECODE_ROWS = 400_000, 500_000

_ENCODE = """
WITH RECURSIVE s(word, pos, tok, hit) AS (
  SELECT word, pos, tok, 0::BIGINT FROM start_rows
  UNION ALL (
    WITH best AS (
      SELECT a.word, min((m.rank::BIGINT << 32) | a.pos) AS hit
      FROM s a JOIN s b ON b.word = a.word AND b.pos = a.pos + 1
      JOIN merges m ON m.pair = ((a.tok::BIGINT << 32) | b.tok)
      WHERE a.hit IS NOT NULL GROUP BY a.word)
    SELECT s.word,
      CASE WHEN s.pos > (best.hit & 4294967295) THEN s.pos - 1 ELSE s.pos END,
      CASE WHEN s.pos = (best.hit & 4294967295) THEN (best.hit >> 32)::INT ELSE s.tok END, best.hit
    FROM s LEFT JOIN best USING (word)
    WHERE s.hit IS NOT NULL AND s.pos IS DISTINCT FROM (best.hit & 4294967295) + 1)
)
SELECT word, pos, tok, 0 AS step FROM s WHERE hit IS NULL ORDER BY word, pos
"""
_ENCODE_LONG = """
WITH RECURSIVE s(word, pos, tok, step) AS (
  SELECT word, pos, tok, 0::INT FROM start_rows
  UNION ALL (
    WITH pairs AS (
      SELECT a.word, a.pos, m.rank, min(m.rank) OVER (PARTITION BY a.word) AS least
      FROM s a JOIN s b ON b.word = a.word AND b.pos = a.pos + 1
      JOIN merges m ON m.pair = ((a.tok::BIGINT << 32) | b.tok) WHERE a.step < $rounds),
    hits AS (
      SELECT word, pos, rank, pos - row_number() OVER (PARTITION BY word ORDER BY pos) AS run
      FROM pairs WHERE rank = least),
    apart AS (
      SELECT word, pos, rank, lag(pos) OVER (PARTITION BY word ORDER BY pos) IS NOT DISTINCT FROM pos - 2 AS touches
      FROM (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY word, run ORDER BY pos) % 2 = 1)),
    lower AS (
      SELECT c.word, c.pos, c.rank,
        coalesce(ml.rank < c.rank, false) OR coalesce(mr.rank < c.rank, false) AS opens
      FROM apart c
      LEFT JOIN s l ON l.word = c.word AND l.pos = c.pos - 1
      LEFT JOIN s r ON r.word = c.word AND r.pos = c.pos + 2
      LEFT JOIN merges ml ON ml.pair = ((CASE WHEN c.touches THEN c.rank ELSE l.tok END::BIGINT << 32) | c.rank)
      LEFT JOIN merges mr ON mr.pair = ((c.rank::BIGINT << 32) | r.tok)),
    chosen AS (
      SELECT word, pos, rank FROM lower
      QUALIFY coalesce(sum(opens::INT) OVER (
        PARTITION BY word ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0)
    SELECT s.word, (row_number() OVER (PARTITION BY s.word ORDER BY s.pos) - 1)::INT,
      coalesce(here.rank, s.tok)::INT, s.step + 1
    FROM s SEMI JOIN chosen live ON live.word = s.word
    LEFT JOIN chosen here ON here.word = s.word AND here.pos = s.pos
    ANTI JOIN chosen gone ON gone.word = s.word AND gone.pos = s.pos - 1)
)
SELECT s.word, s.pos, s.tok, s.step FROM s
JOIN (SELECT word, max(step) AS step FROM s GROUP BY word) l ON l.word = s.word AND l.step = s.step
ORDER BY s.word, s.pos
"""
_DECODE = """
SELECT doc, string_agg(piece, '' ORDER BY pos) AS text FROM ids JOIN vocabulary USING (tok) GROUP BY doc
"""


class DuckBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str, most: int = 1_000_000):
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.split = regex.compile(pattern).findall
        self.most, self.words = most, {}
        merges = [(left, right, rank) for piece, rank in self.ranks.items() for cut in range(1, len(piece))
                  if (left := self.ranks.get(piece[:cut])) is not None
                  and (right := self.ranks.get(piece[cut:])) is not None]
        self.bytes = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        m = np.array(merges, np.int64).reshape(-1, 3)
        given = pa.table({"pair": (m[:, 0] << 32) | m[:, 1], "rank": m[:, 2].astype(np.int32)})
        self.con.register("given", given)
        self.con.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.con.unregister("given")
        # one character per byte, so that an ordered string aggregation joins bytes
        given = pa.table({"tok": pa.array(self.ranks.values(), pa.int32()),
                          "piece": [p.decode("latin-1") for p in self.ranks]})
        self.con.register("given", given)
        self.con.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
        self.con.unregister("given")

    def _contract(self, query: str, tokens: np.ndarray, sizes: np.ndarray, rounds: int = 0) -> tuple[np.ndarray, ...]:
        """Tokens that the words end in, their number for each word, and the step of the last one."""
        word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        pos = (np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        self.con.register("start_rows", pa.table({"word": word, "pos": pos, "tok": tokens}))
        got = self.con.execute(query, {"rounds": rounds} if rounds else {}).fetchnumpy()
        self.con.unregister("start_rows")
        word, tok, step = (np.asarray(got[c]) for c in ("word", "tok", "step"))
        return tok, np.bincount(word, minlength=len(sizes)), step[-1:]

    def _remember(self, words: list[str], tokens: np.ndarray, sizes: np.ndarray) -> None:
        ids = tokens.astype("<u4").tobytes()
        ends = (4 * np.cumsum(sizes)).tolist()
        parts = [ids[a:b] for a, b in zip([0, *ends], ends)]
        self.words.update(zip(words, zip(parts, self.decode(parts))))

    def _encode_words(self, words: list[str]) -> None:
        """Put the ids of new words, and the bytes they decode to, into ``words``."""
        encoded = [w.encode() for w in words]
        ranks = [self.ranks.get(e) for e in encoded]
        whole = [i for i, r in enumerate(ranks) if r is not None]
        self._remember([words[i] for i in whole], np.array([ranks[i] for i in whole], np.int32), np.ones(len(whole), np.int64))
        parts = [i for i, r in enumerate(ranks) if r is None]
        short = [i for i in parts if len(encoded[i]) <= LONG_WORD]
        for at in range(0, len(short), ENCODE_ROWS // LONG_WORD):
            some = short[at:at + ENCODE_ROWS // LONG_WORD]
            tokens = self.bytes[np.frombuffer(b"".join(encoded[i] for i in some), np.uint8)]
            tokens, sizes, _ = self._contract(_ENCODE, tokens, np.array([len(encoded[i]) for i in some]))
            self._remember([words[i] for i in some], tokens, sizes)
        for i in parts:
            if len(encoded[i]) > LONG_WORD:
                tokens, step = self.bytes[np.frombuffer(encoded[i], np.uint8)], [ROUNDS]
                while step[0] >= ROUNDS:
                    tokens, sizes, step = self._contract(_ENCODE_LONG, tokens.astype(np.int32), np.array([len(tokens)]), ROUNDS)
                self._remember([words[i]], tokens, sizes)

    def encode_decode(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Ids of each text as little-endian unsigned 32 bits, and the bytes that they decode to.

        Each match of the pattern is a word; a word seen before is neither contracted nor decoded again.
        """
        if len(self.words) > self.most:
            self.words = {}
        found = [self.split(t) for t in texts]
        new = set().union(*found).difference(self.words)
        if new:
            self._encode_words(list(new))
        known, ids, decoded = self.words.__getitem__, [], []
        for words in found:
            pairs = list(map(known, words))
            ids.append(b"".join([p[0] for p in pairs]))
            decoded.append(b"".join([p[1] for p in pairs]))
        return ids, decoded

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32 bits."""
        return self.encode_decode(texts)[0]

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        """Bytes of each list of ids."""
        out, at = [b""] * len(encoded), 0
        while at < len(encoded):
            end, rows = at, 0
            while end < len(encoded) and (rows == 0 or rows + len(encoded[end]) // 4 <= DECODE_ROWS):
                rows += len(encoded[end]) // 4
                end += 1
            tok = np.frombuffer(b"".join(encoded[at:end]), "<u4").astype(np.int32)
            sizes = [len(e) // 4 for e in encoded[at:end]]
            doc = np.repeat(np.arange(at, end, dtype=np.int32), sizes)
            self.con.register("ids", pa.table({"doc": doc, "pos": np.arange(len(tok), dtype=np.int32), "tok": tok}))
            for d, text in self.con.execute(_DECODE).fetchall():
                out[d] = text.encode("latin-1")
            self.con.unregister("ids")
            at = end
        return out


_CODERS: dict[tuple[str, str], DuckBpe] = {}


def coder(path: str, pattern: str) -> DuckBpe:
    """The task process's encoder; a reused worker keeps it."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = DuckBpe(path, pattern)
    return _CODERS[path, pattern]


def encode_decode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", with_ids: bool = False,
                  reuse: bool = True) -> DataFrame:
    """Per row: key, n_tokens, ids_sha256, decoded_sha256, and the ids when ``with_ids``.

    ``reuse`` keeps a worker's encoder and its memory of words for its next task; without it the worker gives them back
    at the end of each task, for jobs whose other stages need the memory.
    """
    extra = ", ids array<int>" if with_ids else ""

    def run(batches):
        bpe = coder(path, pattern) if reuse else DuckBpe(path, pattern)
        try:
            yield from encoded(bpe, batches)
        finally:
            if not reuse:
                bpe.con.close()
                bpe.words = {}
                give_back()

    def encoded(bpe, batches):
        for batch in batches:
            for part in slices(batch):
                ids, decoded = bpe.encode_decode(part.column(1).to_pylist())
                out = {
                    key: part.column(0),
                    "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()),
                    "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
                    "decoded_sha256": [hashlib.sha256(d).hexdigest() for d in decoded],
                }
                if with_ids:
                    ends = np.cumsum([0, *(len(i) // 4 for i in ids)], dtype=np.int32)
                    out["ids"] = pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_pydict(out)

    rows = docs.select(F.col(key), text_or_empty().alias("text"))
    return rows.mapInArrow(run, schema_with(docs, [key], f"n_tokens long, ids_sha256 string, decoded_sha256 string{extra}"))
