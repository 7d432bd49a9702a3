"""Collocations, hard negatives and signature-join near-duplicates against brute force, on hot groups and odd rows."""

import re
from collections import Counter

import numpy as np
import pytest

import check
from shelfwise.llm import collocations, hard_negatives, queries, set_links, signature_join

from odd_rows import no_docs, odd_docs, sf_dir  # noqa: E402, F401  (fixtures)
from test_dedup_operators import brute_components, lower


@pytest.mark.parametrize("name", ["op11_collocations", "op12_hard_negatives", "op13_signature_join"])
def test_equal_to_sql(spark, con, sf_dir, name):
    ok, message, _, rows = check.compare(spark, con, name, queries.QUERIES[name], queries.ORACLES[name], sf_dir)
    assert ok, message
    assert rows > 0 or name == "op11_collocations"


def brute_phrases(rows, least, longest, top):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall("[^ \t]+", piece)
            totals[lang] += len(w)
            counts.update((lang, tuple(w[i:i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    many = {p: a for p, a in counts.items() if a >= least and len(p[1]) > 1}
    out = {}
    for (lang, p), a in many.items():
        if any(g == lang and len(q) > len(p) and b >= a and any(q[i:i + len(p)] == p for i in range(len(q)))
               for (g, q), b in many.items()):
            continue
        cuts = [(1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append(
            (-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]], totals[lang]))
    return sorted((lang, i, p.decode(), -a, left, right, n, -score) for lang, found in out.items()
                  for i, (score, a, p, left, right, n) in enumerate(sorted(found)[:top], 1))


def phrases(docs, least, longest=5, top=2000, chunk_words=1 << 20):
    return sorted(tuple(r) for r in collocations.collocations(docs, least, longest, top, chunk_words).collect())


@pytest.mark.parametrize("sent, least, chunk_words", [
    (collocations.PHRASES_SENT, 5, 1 << 20), (collocations.PHRASES_SENT, 10 ** 6, 40), (0, 5, 40), (0, 60, 40)])
def test_phrases_equal_brute_force(spark, monkeypatch, sent, least, chunk_words):
    monkeypatch.setattr(collocations, "PHRASES_SENT", sent)
    rng = np.random.default_rng(1)
    rows = [(None, None), ("en", ""), ("und", "So on, so on"), (None, "so ON; so on\x0bso on\x0c so on")]
    for _ in range(300):
        words = rng.choice(["a", "b", "c", "d", "ß", "é", "İ", "x y", "to", "be"], rng.integers(1, 40))
        text = "".join(w + str(rng.choice([" ", "  ", "\t", ", ", ".", "\n", " ", " "])) for w in words)
        rows.append((["en", "de", None, ""][rng.integers(4)], text + "New York City hall, " * int(rng.integers(3))))
    rows += [("en", "the same line again and again and again")] * 150
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS n", "2 AS chunk")
    want = brute_phrases(rows, least, 5, 25)
    assert phrases(docs.repartition(3), least, 5, 25, chunk_words) == want
    assert bool(want) == (least < 10 ** 6)


def test_phrases_of_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.lang, r.text) for r in odd_docs.collect()]
    assert phrases(odd_docs, 2) == brute_phrases(rows, 2, 5, 2000)
    assert phrases(no_docs, 1) == []


def test_exact_scores_past_64_bits(spark):
    from pyspark.sql import functions as F

    big = 10 ** 16
    row = spark.range(1).select(F.lit(big).alias("a"), F.lit(9 * big).alias("n"), F.lit(big + 7).alias("l"), F.lit(big + 9).alias("r"))
    score = row.selectExpr(f"{collocations.SCORE} AS s").first().s
    assert score == 1000 * big * 9 * big // ((big + 7) * (big + 9))


def test_strassen_is_exact():
    rng = np.random.default_rng(2)
    for shape in ((1, 1, 1), (3, 0, 4), (65, 64, 130), (129, 200, 77), (256, 128, 300)):
        for bound in (300, 2 ** 24):
            a = rng.integers(-bound, bound, shape[:2])
            b = rng.integers(-bound, bound, shape[1:])
            assert (hard_negatives.strassen(a, b) == a @ b).all()
    a = rng.integers(-2 ** 40, 2 ** 40, (70, 70))
    b = rng.integers(-2 ** 15, 2 ** 15, (70, 70))
    want = a.astype(object) @ b.astype(object)
    assert (hard_negatives.strassen(a, b) == want.astype(np.int64)).all()


def brute_negatives(rows, every):
    taken = [(i, g, [int(np.floor(256 * x)) for x in v]) for i, g, v in rows if None not in (i, g, v)
             and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, own, u in taken:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(u, v)), i, g) for i, g, v in taken if i != a)
        for s, p, _ in [x for x in scored if x[2] == own][:5]:
            near = [(n, t) for t, n, g in scored if g != own and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, p, k, n, -s, -t) for k, (n, t) in enumerate(near, 1)]
    return sorted(out)


def test_negatives_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(3)), rng.normal(0, 0.3, 6).round(2).tolist()) for i in range(240)]
    rows += [(300 + i, 1, [0.5, 0.25, 0.0, -0.5, 1.0, 0.0]) for i in range(80)]  # one common vector
    rows += [(400, None, [1.0] * 6), (401, 1, None), (402, 1, [1.0, None]), (403, 1, [float("nan")] * 6),
             (404, 1, [float("inf")] * 6), (None, 1, [1.0] * 6), (405, 2, []), (450, 0, [2.0, 1.0])]
    rows = [(i, g, v and [float(np.float32(x)) if x is not None else None for x in v]) for i, g, v in rows]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr(
        "*", "1 AS row", "2 AS group", "'x' AS ints")
    want = brute_negatives(rows, 10)
    for cells in (1 << 19, 640):
        monkeypatch.setattr(hard_negatives, "GROUP_CELLS", cells)
        got = hard_negatives.hard_negatives(frame.repartition(3), 10).collect()
        assert sorted(tuple(r) for r in got) == want and want
    assert hard_negatives.hard_negatives(frame.where("1 = 0")).count() == 0
    # repeated rows are candidates of their own; out of range rows take no part
    twice = spark.createDataFrame([(0, 1, [1.0]), (1, 1, [1.0]), (1, 1, [1.0]), (2, 0, [0.75]), (2, 0, [0.75]), (3, 0, [1e300])],
                                  "vec_id long, label int, embedding array<double>")
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(twice).collect())
    assert got == [(0, 1, k, 2, 65536, 49152) for k in (1, 1, 2, 2)]


def brute_groups(texts, words, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    near = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i])
            if a and b and 100 * len(a & b) >= percent * len(a | b)]
    return [len(s) for s in sets], brute_components(len(texts), near)


def hot_texts(rng):
    """A passage that makes up most of many texts, at similarities around the threshold, besides copies and a chain."""
    passage = [f"p{i}" for i in range(150)]
    texts = [None, "", " \t ", "one", "One", "one two", "a b c d", "a b c d e"]
    for size in (12, 17, 22, 30, 40):
        texts += [" ".join([f"q{rng.integers(10 ** 9)}" for _ in range(size)] + passage) for _ in range(25)]
    base = [f"w{x}" for x in rng.integers(0, 10 ** 6, 200)]
    for _ in range(60):
        copy = list(base)
        copy[int(rng.integers(200))] = f"n{rng.integers(10 ** 9)}"
        texts.append(" ".join(copy))
    chain = [f"c{i}" for i in range(400)]
    return texts + [" ".join(chain[20 * i:20 * i + 240]) for i in range(8)] + ["same text of five words"] * 40


def test_links_equal_brute_force(spark, monkeypatch):
    texts = hot_texts(np.random.default_rng(5))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS key")
    sizes, groups = brute_groups(texts, 4, 80)
    assert len(set(groups[8:133])) < 125  # some of the passage's texts are linked, others not
    monkeypatch.setattr(set_links, "RUN_CELLS", 3000)  # small runs: hot postings span many blocks
    got = signature_join.near_duplicates(docs.repartition(3)).collect()
    assert sorted(tuple(r) for r in got) == [(i, sizes[i], g, i == g) for i, g in enumerate(groups)]


def test_block_links_are_a_forest():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 60, 100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base, rng.integers(0, 1 << 60, 5, dtype=np.uint64)])) for _ in range(30)]
    sets += [np.unique(rng.integers(0, 1 << 60, 100, dtype=np.uint64)) for _ in range(5)]
    def block(parts, sides, sets):
        sketches = [set_links.sketch(set_links.signature(s)) for s in sets]
        posted = np.full(len(sets), -1, np.int64)
        found = []
        for place in range(set_links.COORDINATES):  # every pair belongs to one place
            one = set_links.Block(place, parts, np.array(sides), np.array([len(s) for s in sets]), sketches, posted, 80)
            found.append(one)
        return found

    def pairs(blocks):
        return [(i, k) for b in blocks for i, js in b.near() for k in js.tolist()]

    whole = block(list(range(35)), [3] * 35, sets)
    assert sorted(pairs(whole)) == [(i, j) for i in range(30) for j in range(i + 1, 30)]
    joined = [x for b in whole for x in b.links(sets)]
    assert max(max(x) for x in joined) < 30 and len(set(brute_components(30, joined))) == 1
    assert pairs(block([7, 7], [1, 2], sets[:2])) == [] and pairs(block([7, 8], [1, 1], sets[:2])) == []
    assert pairs(block([7, 8], [1, 2], sets[:2])) == [(0, 1)]
    one = next(b for b in block([7, 8], [1, 2], sets[:2]) if list(b.near()))
    assert one.members().tolist() == [0, 1] and one.links(sets[:2]) == [(0, 1)]


def test_hot_postings_make_rows_in_proportion(spark, monkeypatch):
    """Members of a hot group, none similar, are rows of few blocks: not once for each posting and pair of runs."""
    rows = [(key, key % 64, node, 100, node) for key in range(40) for node in range(300) if (node + key) % 50]
    rest = spark.createDataFrame(rows, "key long, place int, node long, size long, part long")
    monkeypatch.setattr(set_links, "RUN_CELLS", 20_000)  # 34 members in a run
    runs, blocks = set_links._blocks(rest)
    sides = blocks.selectExpr("k", "explode(array_distinct(array(run, run2))) AS run")
    assert sides.join(runs, ["k", "run"]).count() <= len(rows)
    # every posting's members and its place are together in one block
    met = {(r.k, r.run): set() for r in blocks.where("run = run2").collect()}
    for r in runs.collect():
        met[r.k, r.run].add(r.node)
    places = {(r.k, r.run): r.places for r in blocks.where("run = run2").collect()}
    for key in range(40):
        nodes = {node for node in range(300) if (node + key) % 50}
        assert any(nodes <= found and places[k] >> key & 1 for k, found in met.items())


@pytest.mark.parametrize("members", [7, 8192])
def test_links_of_many_runs(spark, monkeypatch, members):
    """Runs of few members and of few hashes lose no link and make no other."""
    texts = hot_texts(np.random.default_rng(7))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes, groups = brute_groups(texts, 4, 80)
    monkeypatch.setattr(set_links, "RUN_NODES", members)
    monkeypatch.setattr(set_links, "RUN_CELLS", 3000)
    got = signature_join.near_duplicates(docs).collect()
    assert sorted(tuple(r) for r in got) == [(i, sizes[i], g, i == g) for i, g in enumerate(groups)]


def test_pieces_hold_every_pair(monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 60, 100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base, rng.integers(0, 1 << 60, 5, dtype=np.uint64)])) for _ in range(30)]
    sketches = [set_links.sketch(set_links.signature(s)) for s in sets]
    monkeypatch.setattr(set_links, "RUN_CELLS", 4000)
    for sides in ([3] * 30, [1] * 12 + [2] * 18):
        def block(some, sides):
            return set_links.Block(list(range(64)), list(some), np.array(sides), np.array([len(sets[i]) for i in some]),
                                   [sketches[i] for i in some], np.full(len(some), -1, np.int64), 80)

        whole = block(range(30), sides)
        want = {(i, k) for i, js in whole.near() for k in js.tolist()}
        got = []
        for _, some, side in whole.pieces():
            assert (whole.sizes[some] + set_links.ROW_CELLS).sum() <= 2 * 4000 + 2 * 700
            got += [(some[i], some[k]) for i, js in block(some, side).near() for k in js.tolist()]
        assert len(got) == len(set(got)) and want == set(got) and want


def test_links_of_odd_rows(spark, odd_docs, no_docs):
    got = signature_join.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by[1] == [(11, 1, True)] * 2 and by[2] == [(0, 2, True)] and by[4] == [(0, 4, True)]
    assert by[8] == [(1, 8, True)] and by[9] == [(1, 8, False)]
    assert sorted(by[None]) == [(0, None, False), (1, None, False)]
    assert signature_join.near_duplicates(no_docs).count() == 0


def test_one_id_with_two_texts(spark):
    texts = ["a b c d e f", "g h i j k l"]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[0]), (3, texts[1]), (None, texts[1])]
    got = signature_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 1), (1, 1), (1, 1), (2, 1), (3, 1)]
