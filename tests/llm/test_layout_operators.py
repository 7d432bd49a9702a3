"""Hilbert shards, chat formatting and vector search."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from shelfwise.llm import chat_format, hilbert_shards, queries, vector_search

from odd_rows import no_docs, odd_docs, sf_dir  # noqa: E402, F401  (fixtures)


def test_hilbert_curve_is_a_walk():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    index = hilbert_shards.hilbert_index(grid, 3)
    assert sorted(index) == list(range(512))
    assert np.abs(np.diff(grid[np.argsort(index)], axis=0)).sum(axis=1).max() == 1


def test_shard_query(spark, sf_dir):
    got = queries.op8_hilbert_shards(spark, sf_dir).collect()
    docs = {r.doc_id: r.text or "" for r in queries.read_table(spark, sf_dir, "documents").collect()}
    sizes = [sorted(r.slot for r in got if r.shard == s) for s in range(40)]
    assert max(map(len, sizes)) - min(map(len, sizes)) <= 1
    assert all(s == list(range(len(s))) for s in sizes)
    assert all(r.size == len(docs[r.doc_id].encode()) + 16 for r in got)
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in got)


def test_shards_odd_rows(odd_docs, no_docs):
    got = hilbert_shards.hilbert_shards(odd_docs, 5).collect()
    assert len(got) == 12 and sorted((r.shard, r.slot) for r in got) == [
        (s, i) for s in range(5) for i in range(math.ceil((s + 1) * 12 / 5) - math.ceil(s * 12 / 5))]
    assert len({r.curve for r in got if r.doc_id in (8, 9)}) == 1
    assert hilbert_shards.hilbert_shards(no_docs).count() == 0


def turns_frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq int, segment string")


def test_chat_round_trip(spark):
    hard = "</s>[INST] ok [/INST]\\s\\b<<s>s>\\"
    rows = [(1, 0, "system", "be [INST]"), (1, 1, "user", hard), (1, 2, "assistant", hard), (1, 3, "user", None),
            (1, 4, "assistant", "zwei 😀"), (2, 0, "user", "only"), (None, 0, "assistant", ""), (3, 0, None, "x"),
            (3, 0, "assistant", "tie"), (3, 0, "assistant", "tie"), (4, None, "user", "first"), (4, 1, "assistant\\", "y")]
    frame = turns_frame(spark, [r + (9, "clash") for r in rows])
    segments = chat_format.format_turns(frame)
    got = {r.conv_id: r for r in chat_format.read_back(segments, chat_format.prefix_targets(segments)).collect()}
    for conv in (1, 2, None, 3, 4):
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        turns = "".join(f"{r}\n{x}\n" for _, _, r, x in own)
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    examples = chat_format.prefix_targets(segments).where("conv_id = 1")
    texts = chat_format.example_texts(segments, examples).orderBy("example_no").collect()
    assert [t.n_turns for t in texts] == [3, 5] and texts[1].text.startswith(texts[0].text)
    assert all(len(t.text) == t.n_chars for t in texts)
    assert texts[1].text[texts[1].loss_start:texts[1].loss_end] == "zwei 😀"
    empty = chat_format.format_turns(frame.where("1 = 0"))
    assert chat_format.read_back(empty, chat_format.prefix_targets(empty)).count() == 0


def brute_nearest(rows, query, k):
    scored = {}
    for i, v in rows:
        if i != query[0] and len(v) == len(query[1]):
            scored[i] = max(scored.get(i, -math.inf), float(np.dot(v, query[1])))
    return [i for i, _ in sorted(scored.items(), key=lambda x: (-x[1], x[0]))[:k]]


def test_vector_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, np.array(r.embedding)) for r in queries.read_table(spark, sf, "embeddings").collect()]
    got, known, hits, total = {}, dict(rows), 0, 0
    for r in queries.op2_cross_polytope(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for i, v in rows:
        if i % 20 == 0:
            want = brute_nearest(rows, (i, v), 20)
            hits += len(set(want) & {x for x, _ in got[i]})
            total += 20
            assert len(got[i]) == 20 and got[i] == sorted(got[i], key=lambda x: (-x[1], x[0]))
            assert all(math.isclose(s, float(np.dot(v, known[x])), rel_tol=1e-12, abs_tol=1e-12) for x, s in got[i])
    assert set(got) == {i for i, _ in rows if i % 20 == 0} and hits >= 0.9 * total


def test_vectors_odd_rows(spark):
    inf, nan = math.inf, math.nan
    rows = [(0, [1.0, 0.0, 2.0]), (1, [0.5, 0.0, 0.1]), (2, [9.0, 1.0, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [nan, 1.0, 1.0]),
            (6, [inf, 1.0, 1.0]), (7, [None, 1.0, 1.0]), (8, []), (None, [1.0, 1.0, 1.0]), (9, [1.0, 1.0]), (1, [0.5, 0.0, 0.1]),
            (10, [1e-3, 0.0, 0.0]), (20, [-1.0, -1.0, -1.0]), (12, [9.0, 1.0, 0.0])]
    frame = spark.createDataFrame([r + ("clash",) for r in rows], "vec_id long, embedding array<double>, id string")
    got = {}
    for r in vector_search.nearest(frame, frame.where("vec_id % 10 = 0"), k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    usable = [(i, v) for i, v in rows if i in (0, 1, 2, 9, 10, 20, 12)]
    assert got == {q: brute_nearest(usable, (q, dict(usable)[q]), 20) for q in (0, 10, 20)}
    assert vector_search.nearest(frame.where("1 = 0"), frame.where("1 = 0")).count() == 0


def test_equal_vectors_tie_by_id(spark):
    rows = [(i, [0.1, 0.2, 0.3, 0.4]) for i in range(3000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = vector_search.nearest(frame, frame.where("vec_id = 40"), k=20).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(20)) and len({r.score for r in got}) == 1


def test_every_query_is_registered():
    assert [n for n in queries.QUERIES if n.startswith("op")] == sorted(
        (n for n in queries.QUERIES if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert len(queries.QUERIES) == 11 and "pipeline" in queries.QUERIES
