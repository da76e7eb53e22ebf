"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear (logistic) models over the words of a text; the probability of
every earlier category is an input of the later models.  While training, those inputs are out-of-fold predictions, so
a later model sees earlier probabilities as unsure as they'll be on new texts.

Features are the presence of a word, and of the first five bytes of a longer word (which catches compounds and
inflected forms).  Each category selects its share of them on a bounded labelled sample, by how far their rate differs
between its classes; counts and selection are Spark aggregations, and only the selected features' rows reach the driver.

Defined results: null and empty texts have no features and get the intercepts' probabilities; unlabelled rows and rows
with a null label aren't learned from; a category with one class gets a constant probability; repeated rows are scored
alike; without labels every probability is 0.5 at most and nothing is toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimsieve.llm.words import ALNUM, Scan, bounded_batches, chunks, encoded, span_hashes
from claimsieve.session import materialize

SAMPLE_ROWS = 10_000
FEATURES = 4_096  # of all categories; each has an equal share
MIN_ROWS = 4
FOLDS = 3
STEM = 5


def _features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature hash) of every word and stem, repeats included."""
    scan = Scan(texts, ALNUM, lower=True)
    owner = np.repeat(np.arange(len(texts)), np.diff(scan.first))
    long = scan.ends - scan.starts > STEM
    stems = span_hashes(scan.bytes, scan.starts[long], scan.starts[long] + STEM) ^ np.uint64(1)
    return np.concatenate([owner, owner[long]]), np.concatenate([scan.hashes(), stems])


def _feature_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, features`` (distinct hashes) of every row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            texts = encoded(batch.column(1))
            for lo, hi in chunks(texts):
                owner, feature = _features(texts[lo:hi])
                order = np.lexsort((feature, owner))
                owner, feature = owner[order], feature[order]
                new = np.ones(len(owner), dtype=bool)
                new[1:] = (owner[1:] != owner[:-1]) | (feature[1:] != feature[:-1])
                owner, feature = owner[new], feature[new].view(np.int64)
                at = np.searchsorted(owner, np.arange(hi - lo + 1))
                lists += [feature[a:b] for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "features"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("features", T.ArrayType(T.LongType()))])
    return docs.select("doc_id", F.col("text").cast("string").alias("_t")).mapInArrow(read, schema)


@dataclass
class Linear:
    """Logistic model over sparse presences and some dense inputs (log odds of earlier categories)."""

    weights: np.ndarray
    dense: np.ndarray
    intercept: float

    def odds(self, row: np.ndarray, col: np.ndarray, n: int, dense: np.ndarray) -> np.ndarray:
        return self.intercept + np.bincount(row, self.weights[col], minlength=n)[:n] + dense @ self.dense


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def fit_linear(row: np.ndarray, col: np.ndarray, dense: np.ndarray, y: np.ndarray, features: int, steps: int = 300, rate: float = 0.1, ridge: float = 1e-4) -> Linear:
    n, k = len(y), dense.shape[1]
    share = float(np.clip(y.mean() if n else 0.0, 1e-4, 1 - 1e-4))
    w = np.zeros(features + k + 1)
    w[-1] = np.log(share / (1 - share))
    if not n or y.min() == y.max():
        return Linear(w[:features], w[features:-1], float(w[-1]))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        odds = w[-1] + np.bincount(row, w[col], minlength=n) + dense @ w[features:-1]
        miss = (_sigmoid(odds) - y) / n
        g = np.concatenate([np.bincount(col, miss[row], minlength=features), dense.T @ miss, [miss.sum()]])
        g[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Linear(w[:features], w[features:-1], float(w[-1]))


@dataclass
class Chain:
    categories: list[str]
    features: np.ndarray  # sorted hashes
    models: list[Linear]
    threshold: float

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """One row per text, one column per category."""
        n = len(texts)
        owner, feature = _features(texts)
        if len(self.features):
            at = np.minimum(np.searchsorted(self.features, feature), len(self.features) - 1)
            hit = self.features[at] == feature
            pair = np.unique(owner[hit] * len(self.features) + at[hit])
            row, col = pair // len(self.features), pair % len(self.features)
        else:
            row = col = np.zeros(0, dtype=np.int64)
        out = np.zeros((n, 0))
        for model in self.models:
            p = _sigmoid(model.odds(row, col, n, _logit(out)))
            out = np.concatenate([out, p[:, None]], axis=1)
        return out


def train_chain(row: np.ndarray, col: np.ndarray, y: np.ndarray, fold: np.ndarray, features: np.ndarray, categories: list[str]) -> Chain:
    """``row, col``: presences; ``y``: one 0/1 column per category; ``fold``: fold number of every row."""
    n, known, models = len(y), np.zeros((len(y), 0)), []
    for k in range(len(categories)):
        dense, out = _logit(known), np.zeros(n)
        for f in range(FOLDS):
            inside = fold != f
            place = np.cumsum(inside) - 1
            of = inside[row]
            model = fit_linear(place[row[of]], col[of], dense[inside], y[inside, k].astype(float), len(features))
            out[~inside] = _sigmoid(model.odds(row, col, n, dense))[~inside]
        models.append(fit_linear(row, col, dense, y[:, k].astype(float), len(features)))
        known = np.concatenate([known, out[:, None]], axis=1)
    # the cut that is right most often on the out-of-fold predictions of the last category, halfway to the next value
    threshold = 0.5
    if n and 0 < y[:, -1].sum() < n:
        order = np.argsort(-known[:, -1], kind="stable")
        truth, p = y[order, -1].astype(float), known[order, -1]
        hits = np.cumsum(truth)
        f1 = 2 * hits / (np.arange(1, n + 1) + truth.sum())
        f1[:-1][p[:-1] == p[1:]] = -1
        best = int(np.argmax(f1))
        threshold = float((p[best] + p[min(best + 1, n - 1)]) / 2)
    return Chain(categories, features, models, threshold)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: list[str], rows: int = SAMPLE_ROWS, features: int = FEATURES) -> Chain:
    """Fit on at most ``rows`` labelled documents (those with the smallest hash of ``doc_id``, one row of each); ``labels`` has ``doc_id``
    and a 0/1 column per category, in the chain's order."""
    bounded_batches(docs.sparkSession)
    known = labels.select("doc_id", *[F.col(c).cast("int").alias(c) for c in categories]).dropna().dropDuplicates(["doc_id"])
    known = materialize(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "labels")
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")
    sample = sample.groupBy("doc_id").agg(F.min("text").alias("text"))  # one row of a repeated id: bounded by rows
    found = materialize(_feature_rows(sample).join(F.broadcast(known), "doc_id"), "features")
    totals = found.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in categories]).first()
    if not totals["n"]:
        return Chain(categories, np.zeros(0, dtype=np.uint64), [Linear(np.zeros(0), np.zeros(k), -1.0) for k in range(len(categories))], 0.5)
    counts = found.select(F.explode("features").alias("f"), *categories).groupBy("f").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in categories]).filter(F.col("n") >= MIN_ROWS)

    def differs(c: str) -> F.Column:
        """Standardised difference of the feature's rate between the classes of a category."""
        share = max(totals[c], 1) / totals["n"]
        return F.abs(F.col(c) - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share) + 1e-9)

    counts = materialize(counts, "counts")
    best = [counts.orderBy(F.desc(differs(c)), "f").limit(features // len(categories)).select("f") for c in categories]
    names = sorted({r["f"] for b in best for r in b.collect()})  # bounded by features
    chosen = np.sort(np.array(names, dtype=np.int64).view(np.uint64))
    wanted = F.array(*[F.lit(int(x)) for x in chosen.view(np.int64)])
    got = found.select("doc_id", *categories, F.array_intersect("features", wanted).alias("f")).orderBy("doc_id").toArrow()  # bounded by rows x features
    lists = got.column("f").combine_chunks()
    lens = lists.value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(got), dtype=np.int32), lens)
    col = np.searchsorted(chosen, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)).astype(np.int32)
    y = np.stack([got.column(c).to_numpy() for c in categories], axis=1)
    fold = (np.arange(len(got)) * 2654435761 % 4294967296) % FOLDS
    return train_chain(row, col, y, fold, chosen, categories)


def predict_chain(docs: DataFrame, chain: Chain) -> DataFrame:
    """``doc_id``, a probability ``p_<category>`` each, ``toxicity`` (that of the last category) and ``is_toxic`` of every row."""
    bounded_batches(docs.sparkSession)
    names = [f"p_{c}" for c in chain.categories]
    sent = docs.sparkSession.sparkContext.broadcast(chain)  # bounded by the number of features

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = encoded(batch.column(1))
            p = np.concatenate([model.probabilities(texts[lo:hi]) for lo, hi in chunks(texts)]) if texts else np.zeros((0, len(names)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(p[:, k]) for k in range(len(names))]], ["doc_id", *names])

    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(c, T.DoubleType()) for c in names]])
    out = docs.select("doc_id", F.col("text").cast("string").alias("_t")).mapInArrow(read, schema)
    return out.withColumn("toxicity", F.col(names[-1])).withColumn("is_toxic", F.col(names[-1]) > chain.threshold)


def score_toxicity(docs: DataFrame, labels: DataFrame, categories: list[str], rows: int = SAMPLE_ROWS) -> DataFrame:
    return predict_chain(docs, fit_chain(docs, labels, categories, rows))
