"""Language, quality, tokens, BPE: brute force, round trips and held-out accuracy."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfwise.llm import byte_bpe, language_id, quality, queries, wavelet_tokens

TIKTOKEN, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"))

from odd_rows import no_docs, odd_docs, sf_dir  # noqa: E402, F401  (fixtures)


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(TIKTOKEN, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_tiktoken(tik):
    rng = random.Random(2)
    texts = ["", " ", "  a", "a  \n b", "a \n\n  b ", "it's  'll \t\tq", "a" * 4000, "===" * 400, "日本語テキスト " * 20, "😀" * 40]
    texts += ["".join(rng.choice("ab '\n\t é1! \x85\x1c") for _ in range(rng.randint(1, 40))) for _ in range(1000)]
    texts += ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (60, 70, 600)]
    coder = byte_bpe.DuckBpe(TIKTOKEN, public_tokenizers.PATTERN)
    ids = coder.encode(texts)
    assert [np.frombuffer(i, "<u4").tolist() for i in ids] == [tik.encode_ordinary(t) for t in texts]
    assert coder.decode(ids) == [t.encode() for t in texts]


def test_bpe_query(spark, sf_dir, tik):
    docs = {r.doc_id: r.text or "" for r in queries.read_table(spark, sf_dir, "documents").collect()}
    for r in queries.op10_byte_bpe(spark, sf_dir).collect():
        ids = np.array(tik.encode_ordinary(docs[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_bpe_odd_rows(odd_docs, no_docs):
    found = byte_bpe.encode_decode(odd_docs, TIKTOKEN, public_tokenizers.PATTERN, with_ids=True).collect()
    assert len(found) == 12 and sum(r.n_tokens == 0 for r in found) == 3
    assert all(len(r.ids) == r.n_tokens for r in found)
    assert byte_bpe.encode_decode(no_docs, TIKTOKEN, public_tokenizers.PATTERN).count() == 0


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    ids = (rng.zipf(1.4, 5000) % 900).astype(np.uint16)
    m = wavelet_tokens.WaveletMatrix.from_bytes(wavelet_tokens.WaveletMatrix.build(ids, 10).to_bytes())
    assert m.decode().tolist() == ids.tolist()
    assert [m.access(i) for i in range(0, 5000, 97)] == ids[::97].tolist()
    for token in (1, 2, 5, 899, 1000, 5000):
        at = np.flatnonzero(ids == token).tolist()
        assert m.locate(token) == at and m.count(token, 100, 3000) == sum(100 <= i < 3000 for i in at)
        assert m.rank(token, 777) == sum(i < 777 for i in at)
    empty = wavelet_tokens.WaveletMatrix.from_bytes(wavelet_tokens.WaveletMatrix.build(np.zeros(0, np.uint16), 4).to_bytes())
    assert empty.decode().tolist() == [] and empty.count(1) == 0


def test_piece_encoder_equals_whole_text():
    rng = random.Random(3)
    letters = "aZéÉßŒſǅÿŸİıŉ'sẞ ,.!-#$\n\t1２²Ⅷéﬁ中😀́ \x85\x1c"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["x" + chr(c) + "y" for c in range(0xC0, 0x250)]
    whole = Tokenizer.from_file(WORDS)
    got = wavelet_tokens.PieceEncoder(WORDS).batch(texts)
    assert [g.tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_query(spark, sf_dir):
    whole, at = Tokenizer.from_file(WORDS), 0
    got = {r.doc_id: r for r in queries.op3_wavelet_tokens(spark, sf_dir).collect()}
    for doc in queries.read_table(spark, sf_dir, "documents").orderBy("doc_id").collect():
        ids = np.array(whole.encode(doc.text or "", add_special_tokens=False).ids + [1], "<u4")
        r = got[doc.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_shards_odd_rows(odd_docs, no_docs):
    shards = wavelet_tokens.write_shards(odd_docs, WORDS)
    found = wavelet_tokens.read_tokens(shards).orderBy("start").collect()
    assert len(found) == 12 and found[0].doc_id is None and found[-1].doc_id == 9
    ends = wavelet_tokens.locate_token(shards, 1).orderBy("position").collect()
    assert {r.start + r.n_tokens - 1 for r in found} <= {e.position for e in ends}
    assert wavelet_tokens.count_token(shards, 1).agg(F.sum("n")).first()[0] == len(ends)
    assert wavelet_tokens.read_tokens(wavelet_tokens.write_shards(no_docs, WORDS)).count() == 0


def test_language(spark, sf_dir):
    docs = queries.read_table(spark, sf_dir, "documents")
    got = queries.op1_language_id(spark, sf_dir).join(docs, "doc_id").where("held_out and lang is not null").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got) > 0
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd_rows(odd_docs, no_docs):
    found = language_id.identify(odd_docs).collect()
    assert len(found) == 12
    for r in found:
        assert (r.lang_pred == "und" and r.score == 0) == (r.doc_id in (2, 3, 4, 7) or r.doc_id is None and r.score == 0)
    assert language_id.identify(no_docs).count() == 0
    unlabelled = language_id.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_ftrl_is_sparse_and_learns():
    model = language_id.FtrlSoftmax(2)
    rng = np.random.default_rng(0)
    for _ in range(200):
        y = int(rng.integers(2))
        at = np.array([y, 5 + int(rng.integers(500))])
        model.step(at, np.array([0.8, 0.6]), y)
    w = model.weights(slice(None))
    assert w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0] and (w == 0).mean() > 0.9


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    labels = queries.read_table(spark, sf, "labels")
    got = queries.op4_quality(spark, sf).join(labels, "doc_id").where("held_out").collect()
    good = [r.score for r in got if r.quality == 1]
    bad = [r.score for r in got if r.quality == 0]
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert wins >= 0.9 * len(good) * len(bad) > 0
    assert all(r.predicted == (r.score >= 0.3) for r in got)


def test_quality_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (8, 0, 0), (None, 1, 0), (6, None, 0), (77, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    found = quality.rate(odd_docs, labels).collect()
    assert len(found) == 12 and all(0 <= r.score <= 1 for r in found)
    assert quality.rate(no_docs, labels).count() == 0
    assert {r.score for r in quality.rate(odd_docs, labels.where("1 = 0")).collect()} == {0.5}


def test_dual_coordinate_descent_separates():
    rows = [np.array([i % 2, 10 + i]) for i in range(40)]
    y = np.array([1.0 if i % 2 else -1.0 for i in range(40)])
    w = quality.dual_coordinate_descent(rows, np.ones(quality.DIMS), y, np.ones(40))
    assert all(np.sign(w[r].sum() + w[-1]) == t for r, t in zip(rows, y))
