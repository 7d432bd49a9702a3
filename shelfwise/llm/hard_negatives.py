"""Hard negatives of labelled vectors: exact integer scores by Strassen's multiplication, kept in mergeable heaps.

Vectors become integers. Candidates lie in groups of at most about ``GROUP_CELLS`` numbers; every anchor, a stated query set, is
sent to every group in tiles of ``TILE`` rows. A task multiplies a tile with its group by Strassen's recursion on int64
matrices, padded with zeros to halves of equal size, and keeps a heap per anchor. Additions are exact: int64 wraps
around, and so gives each product that fits 64 bits whatever the sums in between. Leaves are multiplied in double
precision where all their sums are below 2^53, which is exact too, and in int64 otherwise.

Two passes: heaps of the best rows of the anchor's label give its positives; their scores open a window each, and
heaps of the best rows of other labels inside a window give its negatives. Heaps of the groups merge by taking the first of
their union, so each task hands on a bounded number of rows per anchor.

Defined cases: rows with a null id, label or vector or with a null or non-finite component take no part, nor do rows
whose integers could take a score out of range (``RANGE``); a shorter vector ends in zeros, an empty one is all
zeros; rows that share the anchor's id are not other rows; every row of a repeated id is an anchor and a candidate of its
own; ties go to the smaller id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import give_back, stash

POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
GROUP_CELLS, TILE, LEAF = 1 << 19, 256, 64
#: A row takes part if its length times its largest component squared is below this, so 100 scores fit 64 bits.
RANGE = float(1 << 55)


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of two int64 matrices, exact where it fits 64 bits."""
    n, m, p = a.shape[0], a.shape[1], b.shape[1]
    if min(n, m, p) < LEAF:
        most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * m
        if most < 2 ** 53:
            return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
        return a @ b
    a = np.pad(a, ((0, n % 2), (0, m % 2)))
    b = np.pad(b, ((0, m % 2), (0, p % 2)))
    h, k, q = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :k], a[:h, k:], a[h:, :k], a[h:, k:]
    b11, b12, b21, b22 = b[:k, :q], b[:k, q:], b[k:, :q], b[k:, q:]
    m1, m2 = strassen(a11 + a22, b11 + b22), strassen(a21 + a22, b11)
    m3, m4 = strassen(a11, b12 - b22), strassen(a22, b21 - b11)
    m5, m6 = strassen(a11 + a12, b22), strassen(a21 - a11, b11 + b12)
    m7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * h, 2 * q), np.int64)
    out[:h, :q] = m1 + m4 - m5 + m7
    out[:h, q:] = m3 + m5
    out[h:, :q] = m2 + m4
    out[h:, q:] = m1 - m2 + m3 + m6
    return out[:n, :p]


def best(scores: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` of the ascending ``places`` with the highest scores, ties to the earlier one."""
    if len(places) > k:
        s = scores[places]
        bound = np.partition(s, len(s) - k)[len(s) - k]
        above, level = places[s > bound], places[s == bound]
        places = np.concatenate([above, level[:k - len(above)]])
    return places[np.lexsort((places, -scores[places]))]


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """row, vec_id, label, ints of the rows that take part, stored; ``row`` is unique."""
    ints = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.forall("embedding", lambda x: F.abs(F.lit(float(scale)) * x.cast("double")) < 2.0 ** 40)
    taken = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
    taken = taken.where(finite).where(whole).select("vec_id", F.col("label").cast("long").alias("label"), ints.alias("ints"))
    largest = F.aggregate("ints", F.lit(0.0), lambda acc, x: F.greatest(acc, F.abs(x.cast("double"))))
    fitting = taken.where(F.pow(largest, F.lit(2)) * F.greatest(F.size("ints"), F.lit(1)) < F.lit(RANGE))
    return stash(fitting.withColumn("row", F.monotonically_increasing_id()), "integers")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    sizes, flat = column.value_lengths().to_numpy(), column.flatten().to_numpy()
    out = np.zeros((len(sizes), dims), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _searched(rows: DataFrame, anchors: DataFrame, dims: int, groups: int, find, schema: str) -> DataFrame:
    """``find`` over every group of ``rows`` and every tile of ``anchors`` (row, vec_id, label, ints, asked).

    ``find`` gets a tile's columns, the group's ids and labels in ascending order of id, and the tile's scores.
    """
    asked = anchors.schema["asked"].dataType.simpleString()
    own = rows.select(F.pmod("row", F.lit(groups)).cast("int").alias("group"), F.lit(0).alias("kind"), "row", "vec_id",
                      "label", "ints", F.lit(None).cast(asked).alias("asked"))
    sent = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(1).alias("kind"), "row",
                          "vec_id", "label", "ints", "asked")
    dealt = own.unionByName(sent).repartition(groups, "group").sortWithinPartitions("group", "kind", "vec_id", "row")

    def run(batches):
        group, held, ids, labels, columns = None, [], None, None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            marks = np.stack([table.column(i).to_numpy() for i in range(2)], axis=1)
            cuts = np.flatnonzero((np.diff(marks, axis=0) != 0).any(axis=1)) + 1
            for at, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(marks)]):
                part, (which, kind) = table.slice(at, end - at).combine_chunks(), marks[at].tolist()
                if which != group:
                    group, held, columns = which, [], None
                if kind == 0:
                    held.append(part)
                    continue
                if columns is None:
                    whole = pa.concat_tables(held).combine_chunks() if held else part.slice(0, 0)
                    ids, labels = (whole.column(n).to_numpy() for n in ("vec_id", "label"))
                    columns = _matrix(whole.column("ints").combine_chunks(), dims).T.copy()
                    held = []
                for i in range(0, part.num_rows, TILE):
                    tile = part.slice(i, TILE)
                    scores = strassen(_matrix(tile.column("ints").combine_chunks(), dims), columns)
                    found = find(tile, ids, labels, scores)
                    if found:
                        yield pa.RecordBatch.from_pydict(
                            {n: pa.array(np.concatenate(c), pa.int64()) for n, c in zip(names, zip(*found))})
        give_back()

    names = [c.split()[0] for c in schema.split(", ")]
    return dealt.mapInArrow(run, schema)


def _heap_positives(k: int):
    def find(tile, ids, labels, scores):
        out = []
        rows, own, label = (tile.column(n).to_numpy() for n in ("row", "vec_id", "label"))
        for i in range(len(rows)):
            top = best(scores[i], np.flatnonzero((labels == label[i]) & (ids != own[i])), k)
            out.append((np.full(len(top), rows[i]), ids[top], scores[i][top]))
        return out
    return find


def _heap_negatives(k: int, low: int, high: int):
    def find(tile, ids, labels, scores):
        out = []
        rows, label, asked = tile.column("row").to_numpy(), tile.column("label").to_numpy(), tile.column("asked")
        for i in range(len(rows)):
            other = np.flatnonzero(labels != label[i])
            hundred = 100 * scores[i][other]
            for p in set(asked[i].as_py()):
                top = best(scores[i], other[(hundred >= low * p) & (hundred <= high * p)], k)
                out.append((np.full(len(top), rows[i]), np.full(len(top), p), ids[top], scores[i][top]))
        return out
    return find


def hard_negatives(vectors: DataFrame, anchor_every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows (vec_id, label, embedding).

    Anchors are the rows whose id is divisible by ``anchor_every``.
    """
    rows = integer_vectors(vectors.select("vec_id", "label", "embedding"))
    n, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("ints")), F.lit(0))).first()
    dims, groups = max(1, dims), max(1, -(-n * max(64, dims) // GROUP_CELLS))
    anchors = rows.where(F.col("vec_id") % anchor_every == 0)

    first = _searched(rows, anchors.withColumn("asked", F.lit(None).cast("array<long>")), dims, groups,
                      _heap_positives(positives), "row long, positive_id long, positive_score long")
    merged = Window.partitionBy("row").orderBy(F.col("positive_score").desc(), "positive_id")
    found = stash(first.withColumn("place", F.row_number().over(merged)).where(F.col("place") <= positives), "positives")

    asked = found.groupBy("row").agg(F.collect_set("positive_score").alias("asked"))
    second = _searched(rows, anchors.join(asked, "row"), dims, groups, _heap_negatives(negatives, low, high),
                       "row long, positive_score long, negative_id long, negative_score long")
    window = Window.partitionBy("row", "positive_score").orderBy(F.col("negative_score").desc(), "negative_id")
    mined = second.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= negatives)
    named = found.join(mined, ["row", "positive_score"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
