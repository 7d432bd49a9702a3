"""Near-duplicates of the pipeline against brute force over word shingles."""

import re

import numpy as np

import corpus_pipeline
from shelfwise.llm import queries, similar_texts, simhash_dups

from odd_rows import no_docs, odd_docs, sf_dir  # noqa: E402, F401  (fixtures)
from test_dedup_operators import brute_components, lower


def brute_groups(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    near = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i])
            if len(a & b) >= 0.8 * len(a | b)]
    return brute_components(len(texts), near)


def groups(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(similar_texts.near_duplicates(docs).select("doc_id", "component_id").collect())
    return [got[i] for i in range(len(texts))]


def edited(words, rng, share):
    """Words with runs replaced until about this Jaccard similarity is left."""
    out = list(words)
    n = round(len(words) * (1 - share) / (1 + share) / 5)
    for at in rng.choice(len(words) // 10, n, replace=False):
        out[10 * at] = f"new{rng.integers(10 ** 9)}"
    return out


def test_groups_of_similar_texts(spark):
    rng = np.random.default_rng(3)
    texts = [None, "", " \n", "one two", "One two", "one two three", "five words are one shingle"]
    for share in (0.7, 0.78, 0.82, 0.85, 0.9, 0.95, 0.98):
        for size in (60, 300, 1000):
            words = [f"w{x}" for x in rng.integers(0, 10 ** 6, size)]
            texts += [" ".join(words), " ".join(edited(words, rng, share))]
    chain = [f"c{i}" for i in range(400)]  # each close to the next, the ends far apart
    texts += [" ".join(chain[20 * i:20 * i + 240]) for i in range(8)]
    assert groups(spark, texts) == brute_groups(texts)


def test_stage_uses_the_simhash_index(spark, monkeypatch):
    """The stage pairs texts by op7's fingerprints and postings, and its pairs are confirmed before they link."""
    rng = np.random.default_rng(4)
    words = [f"w{x}" for x in rng.integers(0, 10 ** 6, 400)]
    other = [f"v{x}" for x in rng.integers(0, 10 ** 6, 400)]
    # a line of many repeats governs both fingerprints, the sets have little else in common
    hot = "same line again " * 400
    texts = [" ".join(words), " ".join(words[:-1] + ["end"]), " ".join(other), hot + " ".join(words[:40]),
             hot + " ".join(other[:40]), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    signed = similar_texts.signatures(docs).collect()
    assert [r.fp & 2 ** 64 - 1 for r in signed] == [simhash_dups.fingerprint(t or "") for t in texts]
    node = {r.doc_id: r.node for r in signed}
    prints = spark.createDataFrame([(r.node, r.fp) for r in signed], "node long, fp long")
    got = {frozenset(r) for r in similar_texts.fingerprint_pairs(prints).collect()}
    assert got == {frozenset((node[0], node[1])), frozenset((node[3], node[4]))}
    # without the other index, the pairs of this one are all that links, and only the similar ones do
    monkeypatch.setattr(similar_texts, "bands", lambda least: np.arange(0, dtype=np.uint64))
    assert groups(spark, texts) == [0, 0, 2, 3, 4, 5, 5]


def test_stage_drops_near_copies(spark, sf_dir):
    docs = queries.read_table(spark, sf_dir, "documents")
    rows = docs.orderBy("doc_id").collect()
    want = {rows[g].doc_id for g in brute_groups([r.text for r in rows])}
    got = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, sf_dir)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == sorted(want)


def test_stages_after_it(spark, sf_dir, odd_docs, no_docs):
    docs = queries.read_table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = corpus_pipeline.stash(stage(spark, docs, sf_dir), "t")
    assert docs.count() > 0 and corpus_pipeline.STAGES[4][1](spark, docs, sf_dir).count() == docs.count()
    near = corpus_pipeline.keep_one_of_near_duplicates
    out = near(spark, odd_docs, sf_dir)
    assert out.columns == odd_docs.columns and out.where("doc_id = 1").count() == 1
    assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 0, 1, 5, 6, 7, 8]
    assert near(spark, no_docs, sf_dir).count() == 0
