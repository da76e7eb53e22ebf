"""Quality rules: fixed base checks and a decision list learned from labelled statistics.

Sequential covering: on two thirds of a bounded labelled sample a rule, a conjunction of threshold tests, is grown by
information gain until it covers no good document; on the rest its last tests are cut while that does not lower its
worth; then the rows it covers are set aside and the next rule is grown.  Rules name bad documents, in order; what no
rule covers is good.  The list is one Spark conditional expression, so it runs inside the scan's stage.

Defined results: null or empty text fails the base check; missing labels or a sample of one class give an empty list
(everything is good); repeated rows are judged alike; ties between tests go to the first column and the lowest threshold.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimsieve.llm.textstats import BASE, ratios, text_stats
from claimsieve.session import materialize

SAMPLE_ROWS = 20_000
MIN_WORDS = 20


@dataclass(frozen=True)
class Test:
    name: str
    above: bool
    threshold: float

    def column(self) -> F.Column:
        return F.col(self.name) > self.threshold if self.above else F.col(self.name) <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Ordered rules for the bad class."""

    rules: list[list[Test]] = field(default_factory=list)

    def verdict(self) -> F.Column:
        """True (good) or false, over columns named as the statistics."""
        out = None
        for rule in self.rules:
            cond = rule[0].column()
            for test in rule[1:]:
                cond = cond & test.column()
            out = F.when(cond, False) if out is None else out.when(cond, False)
        return F.lit(True) if out is None else out.otherwise(True)

    def __str__(self) -> str:
        return "\n".join(f"reject if {' and '.join(map(str, r))}" for r in self.rules) + "\nelse keep"


def _mask(rule: list[Test], x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for t in rule:
        v = x[:, names.index(t.name)]
        out &= v > t.threshold if t.above else v <= t.threshold
    return out


def _best_test(x: np.ndarray, bad: np.ndarray, names: list[str]) -> tuple[float, Test | None]:
    """The threshold test with the largest gain: covered bad rows times what is learned about each of them."""
    p0, n0 = bad.sum(), (~bad).sum()
    best, found = 1e-9, None
    base = np.log2(p0 / (p0 + n0))
    for k, name in enumerate(names):
        order = np.argsort(x[:, k], kind="stable")
        v, b = x[order, k], bad[order]
        cut = np.flatnonzero(v[:-1] < v[1:])  # below: rows up to the cut; above: the rest
        if not len(cut):
            continue
        p, n = np.cumsum(b)[cut], np.cumsum(~b)[cut]
        for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - base), -1)
            i = int(np.argmax(gain))
            if gain[i] > best:
                best, found = float(gain[i]), Test(name, above, float((v[cut[i]] + v[cut[i] + 1]) / 2))
    return best, found


def learn_list(x: np.ndarray, good: np.ndarray, names: list[str], min_precision: float = 0.9, min_rows: int = 5, max_tests: int = 4, max_rules: int = 20) -> DecisionList:
    """Grow and prune rules for the rows that are not ``good``."""
    out = DecisionList()
    bad = ~good.astype(bool)
    turn = np.random.default_rng(7).permutation(len(x))
    grow_side = np.zeros(len(x), dtype=bool)
    grow_side[turn[: 2 * len(x) // 3]] = True
    left = np.ones(len(x), dtype=bool)
    while len(out.rules) < max_rules:
        grow, prune = left & grow_side, left & ~grow_side
        rule: list[Test] = []
        covered = grow.copy()
        while len(rule) < max_tests and bad[covered].any() and (~bad[covered]).any():
            _, test = _best_test(x[covered], bad[covered], names)
            if test is None:
                break
            rule.append(test)
            covered &= _mask([test], x, names)

        def worth(r: list[Test]) -> float:
            m = _mask(r, x, names) & prune
            return (bad[m].sum() + 1) / (m.sum() + 2) if r else 0.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        if not rule:
            break
        hit = left & _mask(rule, x, names)
        if hit.sum() < min_rows or bad[hit].mean() < min_precision or worth(rule) < min_precision * (prune & hit).sum() / ((prune & hit).sum() + 2):
            break
        out.rules.append(rule)
        left &= ~hit
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, where: F.Column | None = None, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Ratios and label of at most ``rows`` labelled documents, those with the smallest hash of ``doc_id``, one row (the least
    text) of each.  Their ids are broadcast (the bound is ``rows``), so only their texts are shuffled and counted."""
    named = ratios()
    known = labels.select("doc_id", F.col(label).cast("int").alias("_label")).dropna().filter(where if where is not None else F.lit(True))
    known = materialize(known.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "labels")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"))  # one row of a repeated id
    stats = text_stats(texts, ["doc_id"]).join(F.broadcast(known), "doc_id")
    got = stats.select("doc_id", "_label", *[c.alias(k) for k, c in named.items()]).orderBy("doc_id", *named).toPandas()  # bounded by rows
    return got[list(named)].to_numpy(dtype=np.float64), got["_label"].to_numpy() == 1, list(named)


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def judge(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, label: str = "quality", rows: int = SAMPLE_ROWS) -> tuple[DataFrame, DecisionList]:
    """``keep`` columns (default ``doc_id``) with the base counts, ``base_failed`` and ``kept``; and the learned list."""
    keep = keep or ["doc_id"]
    rules = learn_list(*labelled_sample(docs, labels, label, rows=rows))
    wide = text_stats(docs, keep).select(*keep, *BASE, *[c.alias(k) for k, c in ratios().items()])
    return wide.select(*keep, *BASE, base_failed().alias("base_failed"), (~base_failed() & rules.verdict()).alias("kept")), rules


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rows of ``docs`` that are kept, with all their columns, in one pass without a join."""
    rules = learn_list(*labelled_sample(docs, labels, label, rows=rows))
    keys = [f"_column_{i}" for i in range(len(docs.columns))]  # names of the table may be those of statistics
    plain = docs.toDF(*keys)
    wide = text_stats(plain, keys, keys[docs.columns.index("text")]).select(*keys, *BASE, *[c.alias(k) for k, c in ratios().items()])
    return wide.filter(~base_failed() & rules.verdict()).select(*[F.col(k).alias(c) for k, c in zip(keys, docs.columns)])
