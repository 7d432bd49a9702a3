"""SimHash groups, repeated bytes, benchmark passages and the pipeline, each against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from shelfwise.llm import components, decontaminate, queries, simhash_dups, suffix_dedup
from shelfwise.llm.repeats import LENGTH

from odd_rows import no_docs, odd_docs, sf_dir  # noqa: E402, F401  (fixtures)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_query(spark, sf_dir):
    docs = queries.read_table(spark, sf_dir, "documents").orderBy("doc_id").collect()
    fps = np.array([brute_fingerprint(d.text) for d in docs], np.uint64)
    near = [(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= 3) if i < j]
    want = brute_components(len(fps), near)
    got = {r.doc_id: r for r in queries.op7_simhash(spark, sf_dir).collect()}
    for d, f, c in zip(docs, fps.tolist(), want):
        assert (got[d.doc_id].fingerprint, got[d.doc_id].component_id) == (f"{f:016x}", docs[c].doc_id)


def test_posting_links_keep_connections(monkeypatch):
    masks, rng = simhash_dups._choice_masks(), np.random.default_rng(1)
    choice = simhash_dups._CHOICES.index((3, 4, 5, 6, 7))
    for fps in (np.unique(rng.integers(0, 1 << 12, 1500, dtype=np.uint64)), np.unique(rng.integers(0, 1 << 24, 2500, dtype=np.uint64))):
        found = []
        for limit in (1000, 10 ** 9):
            monkeypatch.setattr(simhash_dups, "PAIRWISE", limit)
            a, b = simhash_dups.posting_links(fps, choice, masks)
            found.append(brute_components(len(fps), zip(np.searchsorted(fps, a), np.searchsorted(fps, b))))
        assert found[0] == found[1]


def test_links_find_every_close_pair(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    close = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, 3, replace=False)) for b in base]
    fps = [simhash_dups._signed(x) for x in [*base.tolist(), *close]]
    rows = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {frozenset((r.a, r.b)) for r in simhash_dups.links(rows).collect()}
    assert {frozenset((fps[i], fps[40 + i])) for i in range(40)} <= got


def test_simhash_odd_rows(odd_docs, no_docs):
    got = simhash_dups.near_duplicates(odd_docs.select("doc_id", "text")).collect()
    assert len(got) == 12
    assert {r.component_id for r in got if r.fp == 0} == {2}
    assert {r.component_id for r in got if r.doc_id in (8, 9)} == {8}
    assert simhash_dups.near_duplicates(no_docs.select("doc_id", "text")).count() == 0


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(51)} | {100 + i: 100 for i in range(60)}


def brute_repeats(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[p:p + LENGTH] for b in data for p in range(len(b) - LENGTH + 1))
    out = []
    for b in data:
        cover = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - LENGTH + 1):
            if seen[b[p:p + LENGTH]] > 1:
                cover[p:p + LENGTH] = True
        cover = cover[:-1]
        spans = int(np.sum(cover & ~np.concatenate([[False], cover[:-1]])))
        kept = np.frombuffer(b, np.uint8)[~cover].tobytes()
        out.append((len(b), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def same_repeats(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(rows).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)


def test_repeats_planted(spark):
    rng = np.random.default_rng(5)

    def noise(n):
        return "".join(rng.choice(list("abcdefghij é"), n))

    a, b, c = noise(460), noise(399), noise(900)
    same_repeats(spark, [
        a, noise(50) + a + noise(300), noise(10) + b + noise(9), b + "x", c + c[:500], noise(700) + c[200:640],
        c[100:499], "x" * 1000, "ab" * 700, None, "", noise(399), a[1:401], "é" * 300, c[:400], noise(60) + c[240:] + a[30:]])


def test_repeated_passages_of_fifty_words(spark):
    """The stage's own length: passages from 50 words on go, wherever they start and end, shorter ones stay."""
    rng = np.random.default_rng(8)

    def words(n, least=2, most=9):
        return " ".join("".join(rng.choice(list("abcdefghijklmnopé"), rng.integers(least, most))) for _ in range(n))

    passages = {n: words(n) for n in (40, 48, 51, 60, 70)} | {52: words(52, 3, 4), 53: words(53, 4, 5)}
    texts = [f"{words(30)} {p} {words(25)}" for p in passages.values() for _ in range(2)]
    texts += [words(30) + "x" + passages[70] + "y" + words(30), passages[70], None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in corpus_pipeline.cut_repeats(spark, docs, "").orderBy("doc_id").collect()]
    for i, (n, p) in enumerate(passages.items()):
        for at in (2 * i, 2 * i + 1):
            assert (p in got[at]) == (n < 50) and (n < 50) == (got[at] == texts[at])
            assert n < 50 or len(got[at].split()) >= 54
    assert len(got[-4].split()) <= 63 and got[-3] == "" and got[-2:] == [None, ""]


def test_passages_beside_repeats(spark, sf_dir):
    """passage_text lacks passages of 50 words that are below 400 bytes; the 400-byte columns and text keep them."""
    rng = np.random.default_rng(11)

    def words(n):
        return " ".join("".join(rng.choice(list("abcdefghijklmnopé"), rng.integers(2, 6))) for _ in range(n))

    short, long, few = words(56), words(200), words(44)
    assert 200 < len(short.encode()) < LENGTH < len(long.encode())
    texts = [f"{words(30)} {p} {words(25)}" for p in (short, long, few) for _ in range(2)]
    texts += [f"{words(20)} {short} {words(9)} {long}", long[300:900] + words(40), words(90), short, "", None, None]
    docs = spark.createDataFrame([*enumerate(texts), (4, texts[4]), (20, short)], "doc_id long, text string")
    texts += [texts[4], short]
    got = suffix_dedup.remove_repeats(docs, with_text=True, passages=suffix_dedup.PASSAGE).collect()
    digest = [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got]
    assert Counter(digest) == Counter(brute_repeats(texts))
    alone = suffix_dedup.remove_repeats(docs, with_text=True, length=200, least_words=50).collect()
    assert Counter((r.doc_id, r.passage_text) for r in got) == Counter((r.doc_id, r.kept_text) for r in alone)
    by_id = {r.doc_id: r for r in got}
    for i in (0, 1, 6):
        assert short in by_id[i].kept_text and short not in by_id[i].passage_text
    for i in (2, 3, 6):
        assert long not in by_id[i].kept_text and long not in by_id[i].passage_text
    assert few in by_id[5].passage_text and by_id[8].passage_text == texts[8] and by_id[9].passage_text == ""
    assert "passage_text" in queries.op5_suffix_dedup(spark, sf_dir).columns


def test_rows_that_repeat_id_and_text(spark):
    text = "".join(np.random.default_rng(9).choice(list("abcdefgh "), 900))
    rows = [(None, text)] * 30 + [(1, text[:600])] * 3 + [(2, "short")] * 2
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_removed, r.n_spans) for r in got) == {(None, 900, 1): 30, (1, 600, 1): 3, (2, 0, 0): 2}
    spans = suffix_dedup.repeated_spans(suffix_dedup.keyed(spark.createDataFrame(rows, "doc_id long, text string")))
    assert spans.count() == spans.distinct().count()


def test_repeats_query(spark, sf_dir):
    docs = queries.read_table(spark, sf_dir, "documents").orderBy("doc_id").collect()
    got = queries.op5_suffix_dedup(spark, sf_dir).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute_repeats([d.text for d in docs])


def test_repeats_odd_rows(odd_docs, no_docs):
    got = suffix_dedup.remove_repeats(odd_docs, ["score", "_row", "th"], with_text=True).collect()
    assert len(got) == 12
    assert {r.n_removed for r in got if r.doc_id == 6} == {3000} and sum(r.n_removed for r in got) == 3000
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_cut_text_keeps_whole_characters():
    data = "aéb".encode()
    assert suffix_dedup.whole_characters(data, np.array([[2, 4]])).tolist() == [[3, 4]]
    assert suffix_dedup.whole_characters(data, np.array([[0, 2]])).tolist() == [[0, 1]]


def brute_contamination(docs, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    known = {}
    for i, text in items:
        w = word.findall(lower(text))
        n = min(window, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            known.setdefault(tuple(w[a:a + n]), set()).add("" if i is None else str(i))
    out = []
    for text in docs:
        w, hit, names = word.findall(lower(text)), set(), set()
        for n in {len(k) for k in known}:
            for a in range(len(w) - n + 1):
                if found := known.get(tuple(w[a:a + n])):
                    hit |= set(range(a, a + n))
                    names |= found
        out.append((len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


def test_contamination_query(spark, sf_dir):
    docs = queries.read_table(spark, sf_dir, "documents").orderBy("doc_id").collect()
    items = [(r.item_id, r.text) for r in queries.read_table(spark, sf_dir, "benchmark").collect()]
    got = queries.op6_decontaminate(spark, sf_dir).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got] == \
        brute_contamination([d.text for d in docs], items)


def test_contamination_planted_and_odd(spark, odd_docs, no_docs):
    items = [(1, "a b c d e f g h i j k l"), (2, "Short one"), (3, ""), (None, "null item"), (4, None), (5, "solo"),
             (6, "the the the the the the the the the the the"), (1, "a b c d e f g h i j")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = ["x A,b c-d e f g h i j y", "b c d e f g h i j k l", "a b c d e f g h i", "short two short ONE", "solo solo",
             "the " * 25, None, "", "null item null", "a b c d e f g h i j " * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontaminate.digest(decontaminate.contamination(docs, bench)).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got] == brute_contamination(texts, items)
    assert decontaminate.contamination(odd_docs, bench).count() == 12
    assert decontaminate.contamination(no_docs, bench).count() == 0
    assert decontaminate.contamination(odd_docs, bench.where("1 = 0")).where(F.size("hits") > 0).count() == 0


def test_proximity(spark):
    docs = decontaminate.keyed(spark.createDataFrame([(1, "alpha x x beta x alpha")], "doc_id long, text string"))
    index = decontaminate.positional_index(docs, decontaminate.TermFilter(
        [decontaminate._bucket(b"alpha"), decontaminate._bucket(b"beta")]))
    near = decontaminate.proximity_matches(index, "alpha", "beta", 2).collect()
    assert [(r.left_pos, r.right_pos) for r in near] == [(5, 3)]


def test_pipeline_stages(spark, sf_dir, odd_docs):
    docs = queries.read_table(spark, sf_dir, "documents")
    labels = queries.read_table(spark, sf_dir, "labels")
    names = docs.columns
    (_, rate), (_, dedup), (_, cut), (_, clean), (_, tokens) = corpus_pipeline.STAGES
    from shelfwise.llm import quality

    kept = corpus_pipeline.stash(rate(spark, docs, sf_dir), "t")
    want = {r.doc_id for r in quality.rate(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == names
    one = corpus_pipeline.stash(dedup(spark, kept, sf_dir), "t")
    from test_similar_texts import brute_groups

    rows = kept.orderBy("doc_id").collect()
    groups = {rows[g].doc_id for g in brute_groups([r.text for r in rows])}
    assert sorted(r.doc_id for r in one.collect()) == sorted(groups) and one.columns == names
    short = corpus_pipeline.stash(cut(spark, one, sf_dir), "t")
    assert short.count() == one.count() and short.columns == names
    assert short.where("n_chars <> length(text)").count() == 0
    left = corpus_pipeline.stash(clean(spark, short, sf_dir), "t")
    items = [(r.item_id, r.text) for r in queries.read_table(spark, sf_dir, "benchmark").collect()]
    rows = short.collect()
    hit = brute_contamination([r.text for r in rows], items)
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r, h in zip(rows, hit) if not h[-1]}
    assert tokens(spark, left, sf_dir).count() == left.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd_docs, sf_dir)
        assert out.columns == odd_docs.columns and out.count() <= 12
        assert stage(spark, odd_docs.where("1 = 0"), sf_dir).count() == 0
    assert dedup(spark, odd_docs, sf_dir).where("doc_id = 1").count() == 1
