"""Quality classifier: naive Bayes support vectors (Wang and Manning 2012).

A text is the set of its hashed 1- to 3-grams of characters, case kept. Each indicator is scaled by the class log-count
ratio, counted over every labelled training row, and the vector is brought to unit length. A linear hinge-loss model is
fitted by dual coordinate descent (Hsieh et al. 2008), with the classes weighted alike; a sigmoid over the margin,
fitted on rows the descent does not see, gives the score.

The descent reads at most ``sample_rows`` labelled rows, half of each class where there are enough, in the order of a hash;
log-count ratios and scores cover all rows.

Defined cases: a null or empty text has no indicator and gets the score of the intercept; without labelled rows of both
classes every score is the share of label 1 (0.5 without any); a label id that repeats takes its mean, rounded up from 0.5;
null ids or labels are never learnt from; repeated rows are all kept; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import bounded_sample, give_back, held_out, schema_with, slices, stash, text_or_empty
from shelfwise.llm.ngrams import DIMS, count_chunks, sum_vectors

SAMPLE_ROWS = 6000
THRESHOLD = 0.3


def log_count_ratio(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    p, q = ones + 1.0, zeros + 1.0
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: list[np.ndarray], r: np.ndarray, y: np.ndarray, c: np.ndarray,
                            epochs: int = 12) -> np.ndarray:
    """Weights (last: intercept) of the hinge-loss model; ``rows`` hold feature indexes, y is +1 or -1, c the costs."""
    w = np.zeros(DIMS + 1)
    scaled = [r[i] / max(np.sqrt((r[i] ** 2).sum()), 1e-12) for i in rows]
    size = np.array([(x * x).sum() + 1.0 for x in scaled])
    alpha, rng = np.zeros(len(rows)), np.random.default_rng(11)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i], scaled[i]
            g = y[i] * (w[at] @ x + w[-1]) - 1
            new = min(max(alpha[i] - g / size[i], 0.0), c[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * x
                w[-1] += (new - alpha[i]) * y[i]
                alpha[i] = new
    return w


def fit_sigmoid(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a * margin + b))): Platt's targets, Newton steps with a small ridge."""
    t = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    x, v = np.stack([margin, np.ones_like(margin)], axis=1), np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        g = x.T @ (weight * (p - t)) + 1e-3 * v
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        v = v - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
    return float(v[0]), float(v[1])


def _labelled(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """text, y, chosen: training rows with their label and whether the descent reads them."""
    one = labels.where("doc_id is not null and quality is not null and not " + _held_sql()).groupBy("doc_id").agg(
        (F.avg("quality") >= 0.5).cast("int").alias("y"))
    first = bounded_sample(one, "y", sample_rows)
    marked = one.join(first.withColumn("chosen", F.lit(True)), "doc_id", "left")
    # labels grow with the corpus, so they are never broadcast, however few there are
    return docs.select("doc_id", text_or_empty().alias("text")).join(marked.hint("merge"), "doc_id").select(
        "text", "y", F.coalesce("chosen", F.lit(False)).alias("chosen"))


def _held_sql() -> str:
    return "(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0)"


def train_quality_model(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row: weights (DIMS + 1, the ratio included), a, b of the sigmoid, share of label 1."""

    def read(batches):
        total = np.zeros(2 * DIMS + 2, np.int64)
        for batch in (part for batch in batches for part in slices(batch)):
            texts, y, chosen = (batch.column(i).to_pylist() for i in range(3))
            for at, counts in count_chunks(texts):
                has, out = counts > 0, []
                for k, row in enumerate(has, at):
                    total[y[k] * DIMS:(y[k] + 1) * DIMS] += row
                    total[2 * DIMS + y[k]] += 1
                    if chosen[k]:
                        out.append((y[k], np.flatnonzero(row).astype("<u4").tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary()),
                         pa.nulls(len(out), pa.binary())], ["y", "idx", "vector"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()),
                                          pa.array([total.tobytes()], pa.binary())], ["y", "idx", "vector"])
        give_back()

    seen = stash(_labelled(docs, labels, sample_rows).mapInArrow(read, "y int, idx binary, vector binary"), "labelled")
    counts = sum_vectors(seen.where("vector is not null")).select(
        F.lit(None).cast("int").alias("y"), F.lit(None).cast("binary").alias("idx"), "vector")

    def fit(batches):
        rows, total = [], np.zeros(2 * DIMS + 2, np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                if r["vector"] is not None:
                    total = np.frombuffer(r["vector"], np.int64)
                else:
                    rows.append((r["idx"], r["y"]))
        zeros, ones = total[-2:]
        share = float(ones / (zeros + ones)) if zeros + ones else 0.5
        rows.sort()
        rows = [rows[i] for i in np.random.default_rng(5).permutation(len(rows))]
        y = np.array([1.0 if r[1] else -1.0 for r in rows])
        w, a, b = np.zeros(DIMS + 1), 0.0, float(np.log(share / (1 - share))) if 0 < share < 1 else 30.0 * (2 * share - 1)
        if zeros and ones:
            idx = [np.frombuffer(r[0], "<u4").astype(np.int64) for r in rows]
            ratio = log_count_ratio(total[DIMS:2 * DIMS].astype(float), total[:DIMS].astype(float))
            kept = max(1, len(rows) // 5)
            learn = slice(kept, None) if len(set(y[kept:])) == 2 else slice(None)
            tune = slice(None, kept) if len(set(y[:kept])) == 2 else slice(None)
            half = len(y[learn]) / 2
            cost = np.where(y[learn] > 0, half / (y[learn] > 0).sum(), half / (y[learn] < 0).sum())
            w = dual_coordinate_descent(idx[learn], ratio, y[learn], cost)
            margin = np.array([_margin(i, ratio, w) for i in idx[tune]])
            # the tuning rows are balanced; weigh them back to the shares of all labelled rows
            got = max((y[tune] > 0).mean(), 1e-9)
            weight = np.where(y[tune] > 0, share / got, (1 - share) / max(1 - got, 1e-9))
            a, b = fit_sigmoid(margin, y[tune], weight)
            w = np.append(w[:-1] * ratio, w[-1])
            ratio2 = ratio * ratio
        else:
            ratio2 = np.ones(DIMS)
        yield pa.RecordBatch.from_pydict({"weights": pa.array([w.tobytes()], pa.binary()),
                                          "ratio2": pa.array([ratio2.tobytes()], pa.binary()), "a": [a], "b": [b]})

    both = seen.where("vector is null").unionByName(counts).repartition(1)
    return stash(both.mapInArrow(fit, "weights binary, ratio2 binary, a double, b double"), "quality")


def _margin(at: np.ndarray, r: np.ndarray, w: np.ndarray) -> float:
    x = r[at] / max(np.sqrt((r[at] ** 2).sum()), 1e-12)
    return float(w[at] @ x + w[-1])


def score_quality(docs: DataFrame, model: DataFrame, key: list[str]) -> DataFrame:
    """The key columns with score for every row. The model is half a MB whatever the corpus."""
    m = model.first()
    spec = (np.frombuffer(bytes(m.weights)), np.frombuffer(bytes(m.ratio2)), m.a, m.b)
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches):
        w, ratio2, a, b = shared.value
        for batch in batches:
            for part in slices(batch):
                score = np.zeros(part.num_rows)
                for at, counts in count_chunks(part.column(0).to_pylist()):
                    has = (counts > 0).astype(np.float64)
                    margin = (has @ w[:-1]) / np.maximum(np.sqrt(has @ ratio2), 1e-12) + w[-1]
                    score[at:at + len(counts)] = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(score)], [*key, "score"])
        give_back()

    rows = docs.select(text_or_empty().alias("_text"), *key)
    return rows.mapInArrow(run, schema_with(docs, key, "score double"))


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, learnt from the labels of rows that are not held out."""
    model = train_quality_model(docs, labels)
    marked = docs.select("doc_id", held_out().alias("held_out"), "text")
    scored = score_quality(marked, model, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
