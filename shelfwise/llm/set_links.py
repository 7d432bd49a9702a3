"""Groups of similar sets among those that share a posting, without a row per pair.

Sets are ascending 64-bit hashes. First every member of a posting is compared with its least node, which joins a group
of near copies in as many rows as it has members. Postings that then still hold more than one group are taken together
with those of nearly the same members (equal least two of the members' hashes), so that a hot group is a row of each
member once and not once for every posting that it shares. They are cut into runs of RUN_NODES members, and each pair of
runs is one block; a task passes over pairs of a block that are in one group already, of too different sizes, below the
match threshold of their sketches (32 bits of each minimum), or to be compared in another posting that they share. What
is left is cut again by the size of its sets; a task reads those, compares them whole, and gives out at most as
many links as there are groups to join. Runs that lie in one group are not compared at all; no posting is capped.

Rows are in proportion to the members up to RUN_NODES; n members above it are n / RUN_NODES times as many.
"""

from __future__ import annotations

from collections.abc import Callable
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import (bit_table, discard, drop_shuffles, give_back, global_order, in_table, slices, stash,
                                  text_or_empty)
from shelfwise.llm.components import components

SEED, COORDINATES, MISSED = 42, 64, 1e-10
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(SEED + 1).integers(0, 1 << 64, COORDINATES, dtype=np.uint64)
#: Members whose sketches are compared at once.
RUN_NODES = 8192
#: Hashes of sets that are compared at once; a set counts ROW_CELLS more, which bounds the sets as well.
RUN_CELLS, ROW_CELLS = 250_000, 500


def match_threshold(percent: int, coordinates: int = COORDINATES, missed: float = MISSED) -> int:
    """Matches that a pair at this similarity has with a probability of at least 1 - ``missed``."""
    p, below = percent / 100, 0.0
    for matches in range(coordinates):
        below += comb(coordinates, matches) * p ** matches * (1 - p) ** (coordinates - matches)
        if below > missed:
            return matches
    return coordinates


def shingles(text: str, size: int) -> np.ndarray:
    """Distinct hashes of a text's word shingles, ascending; A-Z count as a-z, fewer words are one shingle."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])[:max(1, len(words) - size + 1)].tolist()
    last = (ends[min(size, len(words)) - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, last)], np.uint64))


def node_of(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Least value of a set under each of COORDINATES hash functions."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        x = (hashes[at:at + 1024, None] ^ _SEEDS) * _ODD
        x ^= x >> np.uint64(32)
        least = np.minimum(least, (x * _ODD).min(axis=0))
    return least


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Jaccard similarity of two sets, at least ``percent`` of a hundred."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketch(values: np.ndarray) -> bytes:
    """32 bits of each coordinate's value: equal values stay equal."""
    x = values * _ODD
    return (x >> np.uint64(32)).astype(np.uint32).tobytes()


def sets_from(docs: DataFrame, rows: DataFrame, key: str, size: int) -> Callable[[DataFrame], DataFrame]:
    """Gives node, hashes (the set as bytes) for a frame of nodes; ``rows``: th (xxhash64 of key and text) and its node.

    One text of a node is read again where it lies, most others being passed over by a bit table; the node is taken
    from that text, so texts of equal hashes are kept apart.
    """

    def sets_for(wanted: DataFrame) -> DataFrame:
        one = rows.select("node", "th").join(wanted, "node", "left_semi").groupBy("node").agg(F.min("th").alias("th"))
        bits = bit_table(one.select("th"))

        def run(batches):
            for batch in batches:
                some = batch.take(pa.array(in_table(bits, batch.column(0).to_numpy())))
                for part in slices(some):
                    found = [shingles(t, size) for t in part.column(1).to_pylist()]
                    nodes = np.array([node_of(s) for s in found], np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(nodes), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "hashes"])
            give_back()

        texts = docs.select(F.xxhash64(key, "text").alias("th"), text_or_empty().alias("text"))
        sets = texts.mapInArrow(run, "node long, hashes binary").join(wanted, "node", "left_semi")
        return stash(sets.groupBy("node").agg(F.first("hashes").alias("hashes")), "sets")

    return sets_for


def _many_matches(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches match in as many coordinates as similar ones do."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2000):
                left, right = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint32) for c in (2, 3))
                if part.num_rows:
                    same = (left == right).reshape(part.num_rows, -1)
                    yield part.select(["a", "b"]).filter(
                        pa.array(same.sum(axis=1) >= match_threshold(percent, same.shape[1])))

    both = pairs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("left")), "a").join(
        sketches.select(F.col("node").alias("b"), F.col("sketch").alias("right")), "b")
    return both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that are similar on their whole sets."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 50):
                left, right = ([np.frombuffer(x, np.uint64) for x in part.column(c).to_pylist()] for c in (2, 3))
                kept = pa.array([similar(a, b, percent) for a, b in zip(left, right)], pa.bool_())
                yield part.select(["a", "b"]).filter(kept)
        give_back()

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("left")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("hashes").alias("right")), "b")
    return both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


class Block:
    """Members of one or two runs of a posting, to be compared across parts.

    Postings have a place, and a posting at place p stands for coordinates p * width to (p + 1) * width of the sketch.
    ``posted`` has a bit for each place at which a member is posted. A pair belongs to the first place at which both
    are posted and agree, so it is compared in one posting of all that it shares. ``place``: that of the block's
    posting, or those of its postings.
    """

    def __init__(self, place: int | list[int], parts: list[int], sides: np.ndarray, sizes: np.ndarray, sketches: list[bytes],
                 posted: np.ndarray, percent: int, width: int = 1):
        self.group = np.unique(parts, return_inverse=True)[1]
        self.left, self.right, self.sizes, self.percent = sides & 1 > 0, sides & 2 > 0, sizes, percent
        self.sketches = np.frombuffer(b"".join(sketches), np.uint32).reshape(len(parts), -1)
        self.threshold = match_threshold(percent, self.sketches.shape[1])
        bits = np.unpackbits(posted.astype("<i8").view(np.uint8).reshape(len(parts), 8), axis=1, bitorder="little")
        self.width, self.posted = width, bits[:, :self.sketches.shape[1] // width] > 0
        self.here = np.isin(np.arange(self.posted.shape[1]), place)

    def near(self):
        """(i, members j) for each left member i: right members of other parts that may be similar and belong here."""
        other = np.flatnonzero(self.right)
        for i in np.flatnonzero(self.left).tolist():
            n = self.sizes[other]
            j = other[(self.group[other] != self.group[i])
                      & (100 * np.minimum(n, self.sizes[i]) >= self.percent * np.maximum(n, self.sizes[i]))]
            if self.right[i]:
                j = j[(j > i) | ~self.left[j]]
            same = self.sketches[j] == self.sketches[i]
            many = np.flatnonzero(same.sum(axis=1) >= self.threshold)
            j, same = j[many], same[many]
            both = same.reshape(len(j), self.posted.shape[1], self.width).all(axis=2) & self.posted[j] & self.posted[i]
            j = j[both.any(axis=1) & self.here[both.argmax(axis=1)]]
            if len(j):
                yield i, j

    def members(self) -> np.ndarray:
        """Members of at least one such pair."""
        some = np.zeros(len(self.group), bool)
        for i, j in self.near():
            some[i] = True
            some[j] = True
        return np.flatnonzero(some)

    def pieces(self):
        """(number, members, sides) of blocks of bounded sets that hold every such pair."""
        start = np.where(self.left, 0, 1 + (self.sizes + ROW_CELLS).sum() // RUN_CELLS)
        run = np.zeros(len(self.group), np.int64)
        for some in (np.flatnonzero(self.left), np.flatnonzero(~self.left)):
            run[some] = start[some] + np.cumsum(self.sizes[some] + ROW_CELLS) // RUN_CELLS
        found = {}
        for i, j in self.near():
            for r in np.unique(run[j]).tolist():
                some = found.setdefault((int(run[i]), r), np.zeros(len(run), bool))
                some[i] = True
                some[j[run[j] == r]] = True
        for number, ((a, b), some) in enumerate(found.items()):
            some = np.flatnonzero(some)
            yield number, some, np.where(run[some] == a, 1, 0) + np.where(run[some] == b, 2, 0)

    def links(self, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        """Similar pairs, only those that join two groups.

        A member's hashes are marked, and the marks in the sets of its candidates are added up, all at once.
        """
        flat, sizes = np.unique(np.concatenate(sets), return_inverse=True)[1], np.array([len(s) for s in sets])
        starts, marks, out = np.cumsum(sizes) - sizes, np.zeros(sizes.sum(), np.int64), []
        for i, others in self.near():
            own = flat[starts[i]:starts[i] + sizes[i]]
            marks[own] = 1
            while len(others := others[self.group[others] != self.group[i]]):
                some = others[:64]
                n = sizes[some]
                ends = np.cumsum(n)
                at = np.arange(ends[-1]) + np.repeat(starts[some] - ends + n, n)
                both = np.add.reduceat(marks[flat[at]], ends - n)
                hit = some[100 * both >= self.percent * (n + sizes[i] - both)]
                for k in hit.tolist():
                    if self.group[k] != self.group[i]:
                        self.group[self.group == self.group[k]] = self.group[i]
                        out.append((i, k))
                others = others[64:]
            marks[own] = 0
        return out


def _block(places: int, rows: pa.StructArray, percent: int, width: int) -> tuple[Block, dict[str, pa.Array]]:
    own = {rows.type.field(i).name: column for i, column in enumerate(rows.flatten())}
    return Block([p for p in range(64) if places >> p & 1], own["part"].to_pylist(), own["side"].to_numpy(),
                 own["size"].to_numpy(), own["sketch"].to_pylist(), own["posted"].to_numpy(), percent, width), own


def _blocks(rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs (k, node, part, size, run) of postings taken together, and blocks (k, places, run, run2) of them."""
    twins = F.struct(F.min(F.xxhash64("node")).alias("h"), F.min(F.xxhash64(F.lit(1), "node")).alias("g"))
    keys = rest.groupBy("key").agg(twins.alias("k"), F.min("place").alias("place"))
    places = keys.groupBy("k").agg(F.expr("bit_or(shiftleft(1L, place))").alias("places"))
    members = rest.join(keys.drop("place"), "key").select("k.h", "k.g", "node", "part", "size").distinct()
    ordered = global_order(members, ["h", "g", "part", "node"], None, "runs")
    runs = stash(ordered.select(F.struct("h", "g").alias("k"), "node", "part", "size",
                                F.floor(F.col("before") / RUN_NODES).alias("run")), "runs")
    pieces = stash(runs.groupBy("k", "run").agg(F.min("part").alias("x"), F.max("part").alias("y")), "pieces")
    pairs = pieces.join(pieces.toDF("k", "run2", "x2", "y2"), "k").where("run <= run2 AND NOT (x = y AND x = x2 AND x2 = y2)")
    blocks = stash(pairs.select("k", "run", "run2").join(places, "k"), "blocks")
    discard(pieces)
    return runs, blocks


def _across(rest: DataFrame, sketches: DataFrame, sets_for: Callable[[DataFrame], DataFrame], percent: int,
            width: int) -> DataFrame:
    """Links (a, b) between the parts of postings (key, place, node, part, size)."""
    runs, blocks = _blocks(rest)
    sides = F.when(F.col("run") == F.col("run2"), F.array(F.struct(F.col("run").alias("run"), F.lit(3).alias("side")))).otherwise(
        F.array(F.struct(F.col("run").alias("run"), F.lit(1).alias("side")),
                F.struct(F.col("run2").alias("run"), F.lit(2).alias("side"))))
    wanted = blocks.select("k", F.struct("k", "places", "run", "run2").alias("block"), F.explode(sides).alias("s")).select(
        "k", "block", "s.run", "s.side")
    members = wanted.join(runs, ["k", "run"]).join(sketches, "node")
    grouped = members.groupBy("block").agg(
        F.collect_list(F.struct("node", "part", "side", "size", "sketch", "posted")).alias("members"))

    def candidates(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column(1).slice(i, 1).flatten()
                places = batch.column(0).field("places")[i].as_py()
                some = _block(places, rows, percent, width)[0].members()
                if not len(some):
                    continue
                rows = rows.take(pa.array(some))
                block, own = _block(places, rows, percent, width)
                for number, some, side in block.pieces():
                    taken = {n: c.take(pa.array(some)) for n, c in own.items()} | {"side": pa.array(side.astype(np.int32))}
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([i] * len(some))), pa.array([number] * len(some), pa.int32()),
                         pa.StructArray.from_arrays(list(taken.values()), list(taken))], ["block", "piece", "m"])

    def confirm(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                places = batch.column(0).field("places")[i].as_py()
                block, own = _block(places, batch.column(1).slice(i, 1).flatten(), percent, width)
                nodes = own["node"].to_pylist()
                sets = [np.frombuffer(x, np.uint64) for x in own["hashes"].to_pylist()]
                out += [(nodes[a], nodes[b]) for a, b in block.links(sets)]
            yield pa.RecordBatch.from_pydict({n: pa.array([x[i] for x in out], pa.int64()) for i, n in enumerate("ab")})
        give_back()

    member = "struct<node:long,part:long,side:int,size:long,sketch:binary,posted:long>"
    near = stash(grouped.mapInArrow(
        candidates, f"block struct<k:struct<h:long,g:long>,places:long,run:long,run2:long>, piece int, m {member}"), "near")
    discard(runs, blocks)
    drop_shuffles(near.sparkSession)
    sets = sets_for(near.select("m.node").distinct())
    whole = near.select("block", "piece", "m.*").join(sets, "node").groupBy("block", "piece").agg(
        F.collect_list(F.struct("node", "part", "side", "size", "sketch", "posted", "hashes")).alias("members"))
    links = stash(whole.drop("piece").mapInArrow(confirm, "a long, b long").distinct(), "links")
    discard(near, sets)
    return links


def linked(postings: DataFrame, sketches: DataFrame, sets_for: Callable[[DataFrame], DataFrame], percent: int,
           width: int = 1, found: DataFrame | None = None) -> DataFrame:
    """node, component (its least node) of the nodes that a link joins.

    ``postings``: key, place, node, size, a row for each key of a node; pairs that may be similar share a key.
    ``sketches``: node, its sketch and the places of its postings (``Block``). ``sets_for`` gives node and hashes for a
    frame of nodes, stored. ``found``: pairs (a, b) of another index, confirmed with those of the least nodes.
    """
    postings = stash(postings, "postings")
    heads = postings.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = stash(postings.join(heads, "key"), "met")
    discard(postings)
    first = met.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    first = (first if found is None else first.unionByName(found)).distinct()
    near = stash(_many_matches(first, sketches, percent), "near")
    sets = sets_for(near.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    links = stash(confirmed(near, sets, percent), "links")
    discard(near, sets)
    joined = components(links)
    parts = met.join(joined, "node", "left").select(
        "key", "place", "node", "size", F.coalesce("component", "node").alias("part"))
    mixed = parts.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("key")
    rest = stash(parts.join(mixed, "key"), "rest")
    discard(met)
    drop_shuffles(rest.sparkSession)
    more = _across(rest, sketches, sets_for, percent, width)
    discard(rest)
    out = components(links.unionByName(more))
    discard(links, more)
    return out
