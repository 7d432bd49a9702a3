"""Group metrics of many weight vectors from one pass over the rows.

Rows are dealt and sorted by group once, whatever the number of vectors. A task reads whole groups, blends the score
columns with one vector after another and gives out a row per vector and group. Groups of more than ``HOT_ROWS`` rows
are left to the exact path that splits a group by value ranges (``metrics.group_metrics``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from shelfwise.operators import metrics as M

HOT_ROWS = 100_000
#: Rows that are scored at a time; a group is never cut.
BLOCK_ROWS = 200_000


def _starts(table: pa.Table, by: list[str]) -> np.ndarray:
    """Rows at which a group begins."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in by:
        codes = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Doubles, and where they are null."""
    x = column.combine_chunks().cast(pa.float64())
    return x.fill_null(0.0).to_numpy(zero_copy_only=False), x.is_null().to_numpy(zero_copy_only=False)


def _metrics(score: np.ndarray, label: np.ndarray, group: np.ndarray, first: np.ndarray, k: int,
             ideal: np.ndarray) -> dict[str, np.ndarray]:
    """Per group; ties of the list part go to the earlier row."""
    n = np.diff(np.append(first, len(score)))
    p = np.bincount(group, label, len(first))
    up = np.lexsort((score, group))
    s, g = score[up], group[up]
    run = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (g[1:] != g[:-1])]))
    size = np.diff(np.append(run, len(s)))
    rank = np.repeat(run - first[g[run]] + (size + 1) / 2.0, size)
    ranks = np.bincount(g, rank * label[up], len(first))
    down = np.lexsort((-score, group))
    place = np.arange(len(score)) - first[group[down]]
    top = down[place < k]
    gain = label[top] == 1
    hits = np.bincount(group[top], gain, len(first))
    dcg = np.bincount(group[top], np.where(gain, 1.0 / np.log2(place[place < k] + 2.0), 0.0), len(first))
    with np.errstate(divide="ignore", invalid="ignore"):
        return {"n": n, "p": p, "auc": (ranks - p * (p + 1) / 2.0) / (p * (n - p)),
                "ndcg": dcg / ideal[np.minimum(p, k).astype(int)], "recall": hits / p, "hits": hits}


def grid_group_metrics(df: DataFrame, cols, vectors, by=M.GROUP, label: str = "label", k: int = 10,
                       idcg: str = "reference", tie: str = "item_id") -> DataFrame:
    """weight_id and the columns of ``group_metrics`` per weight vector and group."""
    from shelfwise.operators.fusion import expand_weights

    by, cols = list(by), list(cols)
    keys = [F.col(c).alias(f"__h_{c}") for c in by]
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > HOT_ROWS).drop("__n")
    same = F.lit(True)
    for c in by:
        same = same & df[c].eqNullSafe(hot[f"__h_{c}"])
    rows = df.join(hot, same, "left_anti").select(*by, tie, label, *[F.col(c).cast("double").alias(c) for c in cols])
    dealt = rows.repartition(*by).sortWithinPartitions(*by, tie)
    ideal = [0.0]
    for i in range(1, k + 1):
        ideal.append(ideal[-1] + (np.log2(i + 1) if idcg == "reference" else 1 / np.log2(i + 1)))
    ideal, weights = np.array(ideal), [tuple(float(w) for w in v) for v in vectors]

    def scored(table: pa.Table, first: np.ndarray):
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, table.num_rows)))
        numbers = [_numbers(table.column(c)) for c in cols]
        parts, none_at = [x for x, _ in numbers], np.any([m for _, m in numbers], axis=0)
        target = _numbers(table.column(label))[0]
        heads = table.select(by).take(pa.array(first)).combine_chunks()
        for i, vector in enumerate(weights):
            score = np.zeros(table.num_rows)
            with np.errstate(invalid="ignore"):
                for w, x in zip(vector, parts):
                    score = score + w * x
            # Spark's order: a null blend below everything, NaN above
            score = np.where(none_at, -np.inf, np.where(np.isnan(score), np.inf, score))
            m = _metrics(score, target, group, first, k, ideal)
            none = {"auc": (m["p"] == 0) | (m["p"] == m["n"]), "ndcg": m["p"] == 0, "recall": m["p"] == 0}
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(first), i, np.int32)), *[c.combine_chunks() for c in heads.columns],
                 pa.array(m["n"].astype(np.int64)),
                 *[pa.array(m[c].astype(np.float64), mask=none.get(c)) for c in ("p", "auc", "ndcg", "recall", "hits")]],
                ["weight_id", *by, "n", "p", "auc", "ndcg", "recall", "hits"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            if size >= BLOCK_ROWS:
                table = pa.concat_tables(held).combine_chunks()
                first = _starts(table, by)
                if len(first) > 1:  # the last group may go on in the next batch
                    yield from scored(table.slice(0, first[-1]).combine_chunks(), first[:-1])
                held = [table.slice(first[-1])]
                size = held[0].num_rows
        if size:
            table = pa.concat_tables(held).combine_chunks()
            yield from scored(table, _starts(table, by))

    own = _parse_datatype_string("n long, p double, auc double, ndcg double, recall double, hits double")
    schema = StructType(_parse_datatype_string("weight_id int").fields + [rows.schema[c] for c in by] + own.fields)
    split = M.group_metrics(expand_weights(df.join(hot, same, "left_semi"), cols, vectors), "score", ["weight_id", *by],
                            label, k, idcg, tie)
    return dealt.mapInArrow(run, schema).unionByName(split.select(*schema.names))
