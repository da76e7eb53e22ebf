"""Quality scores by Bradley-Terry ranking.

Preference pairs join a document labelled good with one labelled bad of a bounded training sample.  The score is linear
in the statistics of a text; its weights minimise the logistic loss on feature differences of the pairs, so only the
order of documents is learned.  The threshold is the score quantile at the share of bad documents in the sample, and
``1 / (1 + exp(threshold - score))`` maps scores to 0..1 with 0.5 at the threshold.

Defined results: empty and null texts are scored by their (zero) statistics; a sample with one class only gives equal
scores of 0.5 to all; repeated rows get equal scores; null labels and null ids are not learned from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimsieve.llm.quality_rules import SAMPLE_ROWS, labelled_sample
from claimsieve.llm.textstats import ratios, text_stats

PAIRS_PER_ROW = 8


@dataclass
class Ranking:
    names: list[str]
    weights: np.ndarray
    centre: np.ndarray
    threshold: float

    def score(self, columns: dict[str, F.Column]) -> F.Column:
        """Score in 0..1 as a Spark expression."""
        parts = [(c - float(m)) * float(w) for c, m, w in zip(_inputs(columns).values(), self.centre, self.weights)]
        total = F.lit(-self.threshold)
        for p in parts:
            total = total + p
        total = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))
        return 1 / (1 + F.exp(-total))


def _inputs(columns: dict[str, F.Column]) -> dict[str, F.Column]:
    return columns | {f"{k} root": F.sqrt(c) for k, c in columns.items()}


def learn_ranking(x: np.ndarray, good: np.ndarray, names: list[str], steps: int = 600, rate: float = 0.05, ridge: float = 1e-4) -> Ranking:
    """Weights from preference pairs by full-gradient Adam; deterministic."""
    wide = np.concatenate([x, np.sqrt(x)], axis=1) if len(x) else np.zeros((0, 2 * len(names)))
    centre = wide.mean(axis=0) if len(wide) else np.zeros(wide.shape[1])
    spread = np.maximum(wide.std(axis=0), 1e-9) if len(wide) else np.ones(wide.shape[1])
    z = (wide - centre) / spread
    w = np.zeros(z.shape[1])
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    threshold = 0.0
    if len(up) and len(down):
        rng = np.random.default_rng(11)
        a = np.concatenate([rng.choice(up, len(down) * PAIRS_PER_ROW), np.repeat(up, 1)])
        b = np.concatenate([np.repeat(down, PAIRS_PER_ROW), rng.choice(down, len(up))])
        d = z[a] - z[b]
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, steps + 1):
            g = -(d.T @ (1 / (1 + np.exp(np.clip(d @ w, -30, 30))))) / len(d) + ridge * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        threshold = float(np.quantile(z @ w, len(down) / len(z)))
    return Ranking(names, w / spread, centre, threshold)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def rank_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> tuple[DataFrame, Ranking]:
    """``doc_id, held_out, score, predicted`` of every row; learned from labels outside the held-out third only."""
    model = learn_ranking(*labelled_sample(docs, labels, label, where=~held_out(), rows=rows))
    scored = text_stats(docs, ["doc_id"]).select("doc_id", held_out().alias("held_out"), model.score(ratios()).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")), model
