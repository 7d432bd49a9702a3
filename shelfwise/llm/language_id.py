"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1- to 3-grams of the lower-cased whole text, weighted by document frequencies over every
labelled training row and scaled to unit length. Weights are fitted by follow-the-regularised-leader (McMahan et al.
2013, per-coordinate rates) with an elastic net: ``l1`` sets most weights to exactly zero, ``l2`` shrinks the rest.
A part of the sample that the fit does not see sets one temperature for the softmax.

The fit reads at most ``sample_rows`` labelled rows, the same number of each language where there are enough, in the
order of a hash; document frequencies and predictions cover all rows.

Defined cases: a null text or one without a letter is ``und`` with score 0; rows with null id are predicted but never
learnt from; without any labelled row everything is ``und``; repeated rows are all kept; other columns are ignored.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import bounded_sample, held_out, schema_with, stash, text_or_empty
from shelfwise.llm.ngrams import DIMS, count_chunks, sum_vectors

SAMPLE_ROWS = 6000


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = counts * idf
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class FtrlSoftmax:
    """FTRL-proximal for a softmax over sparse rows; weights are a function of the sums z and n."""

    def __init__(self, classes: int, alpha=2.0, beta=1.0, l1=0.02, l2=0.01):
        self.z, self.n = np.zeros((DIMS + 1, classes)), np.zeros((DIMS + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def step(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = _softmax(x @ w)
        p[y] -= 1
        g = x[:, None] * p
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """Temperature of least log loss, by golden-section search on its logarithm."""
    def loss(t):
        p = _softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).mean() + 1e-4 * t * t

    lo, hi, g = -4.0, 3.0, (5 ** 0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _document_frequencies(rows: DataFrame) -> DataFrame:
    """One row: documents holding each feature, and in the last place all documents."""

    def count(batches):
        total = np.zeros(DIMS + 1, np.int64)
        for batch in batches:
            for _, counts in count_chunks(_lower(batch.column(0).to_pylist())):
                total[:-1] += np.count_nonzero(counts, axis=0)
                total[-1] += len(counts)
        yield pa.RecordBatch.from_pydict({"vector": pa.array([total.tobytes()], pa.binary())})

    return sum_vectors(rows.select("text").mapInArrow(count, "vector binary"))


def _lower(texts: list[str]) -> list[str]:
    return [t.lower() for t in texts]


def _sample(train: DataFrame, rows: int) -> DataFrame:
    """text, lang of at most ``rows`` rows, the languages in turn; the ids of that many rows are all that is broadcast."""
    chosen = bounded_sample(train.where("doc_id is not null").select("doc_id", "lang"), "lang", rows)
    return train.join(F.broadcast(chosen.distinct()), "doc_id").select("text", "lang")


def _sample_features(sample: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for at, counts in count_chunks(_lower(batch.column(0).to_pylist())):
                found = [np.flatnonzero(c) for c in counts]
                yield pa.RecordBatch.from_pydict({
                    "lang": langs[at:at + len(counts)],
                    "idx": pa.array([f.astype("<u4").tobytes() for f in found], pa.binary()),
                    "tf": pa.array([c[f].astype("<u4").tobytes() for f, c in zip(found, counts)], pa.binary())})

    return sample.mapInArrow(run, "lang string, idx binary, tf binary")


def train_language_model(train: DataFrame, sample_rows: int = SAMPLE_ROWS, epochs: int = 3) -> DataFrame:
    """One row, or none without labelled rows: langs (JSON), weights (DIMS + 1 by languages), idf, temperature.

    ``train`` has doc_id, text, lang, without null lang.
    """
    sample = _sample_features(_sample(train, sample_rows)).withColumn("vector", F.lit(None).cast("binary"))
    df = _document_frequencies(train).select(
        F.lit(None).cast("string").alias("lang"), F.lit(None).cast("binary").alias("idx"),
        F.lit(None).cast("binary").alias("tf"), "vector")

    def fit(batches):
        rows, freq = [], None
        for batch in batches:
            for r in batch.to_pylist():
                if r["vector"] is not None:
                    freq = np.frombuffer(r["vector"], np.int64)
                else:
                    rows.append((r["lang"], np.frombuffer(r["idx"], "<u4"), np.frombuffer(r["tf"], "<u4")))
        if not rows:
            return
        idf = np.log((1 + freq[-1]) / (1 + freq[:-1])) + 1
        langs = sorted({r[0] for r in rows})
        rows.sort(key=lambda r: (r[1].tobytes(), r[2].tobytes(), r[0]))
        order = np.random.default_rng(7).permutation(len(rows))
        data = []
        for i in order:
            lang, idx, tf = rows[i]
            x = tf * idf[idx]
            x = x / max(np.sqrt((x * x).sum()), 1e-12)
            data.append((np.append(idx, DIMS).astype(np.int64), np.append(x, 1.0), langs.index(lang)))
        kept = max(1, len(data) // 5)
        tune, learn = data[:kept], data[kept:] or data
        model = FtrlSoftmax(len(langs))
        for _ in range(epochs):
            for at, x, y in learn:
                model.step(at, x, y)
        w = model.weights(slice(None))
        heat = temperature(np.array([x @ w[at] for at, x, _ in tune]), np.array([y for _, _, y in tune]))
        yield pa.RecordBatch.from_pydict({
            "langs": [json.dumps(langs)], "weights": pa.array([w.tobytes()], pa.binary()),
            "idf": pa.array([idf.tobytes()], pa.binary()), "temperature": [heat]})

    both = sample.unionByName(df).repartition(1)
    return stash(both.mapInArrow(fit, "langs string, weights binary, idf binary, temperature double"), "language")


def predict_languages(docs: DataFrame, model: DataFrame, key: list[str]) -> DataFrame:
    """The key columns with lang_pred and score for every row. The model is a few MB whatever the corpus."""
    found = model.collect()
    spec = None
    if found:
        langs = json.loads(found[0].langs)
        w = np.frombuffer(bytes(found[0].weights)).reshape(DIMS + 1, len(langs))
        spec = (langs, w, np.frombuffer(bytes(found[0].idf)), found[0].temperature)
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches):
        spec = shared.value
        for batch in batches:
            texts = batch.column(0).to_pylist()
            best, score = np.full(len(texts), -1), np.zeros(len(texts))
            if spec:
                langs, w, idf, heat = spec
                for at, counts in count_chunks(_lower(texts)):
                    p = _softmax((_weighted(counts, idf) @ w[:-1] + w[-1]) / heat)
                    best[at:at + len(p)], score[at:at + len(p)] = p.argmax(axis=1), p.max(axis=1)
                for i, t in enumerate(texts):
                    if not any(map(str.isalpha, t)):
                        best[i], score[i] = -1, 0.0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(["und" if b < 0 else langs[b] for b in best.tolist()], pa.string()),
                 pa.array(score)], [*key, "lang_pred", "score"])

    rows = docs.select(text_or_empty().alias("_text"), *key)
    return rows.mapInArrow(run, schema_with(docs, key, "lang_pred string, score double"))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, learnt from the rows that are not held out and have a language."""
    train = docs.where(~held_out() & F.col("lang").isNotNull()).select("doc_id", text_or_empty().alias("text"), "lang")
    model = train_language_model(train)
    marked = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict_languages(marked, model, ["doc_id", "held_out"])
