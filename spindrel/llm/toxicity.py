"""Toxicity scores by non-negative positive-unlabelled learning (a class-prior-corrected risk estimator, in numpy)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Adam, fold, sigmoid, with_scores
from .labels import training_texts

#: Bounds of the fitted sample and of the model.
MOST_TOXIC, MOST_UNLABELLED, FEATURES = 6000, 12000, 1024
#: A feature must occur in so many toxic texts of the sample, and be so many times as frequent there as in other texts.
LEAST_TEXTS, LEAST_LIFT, LEAST_Z = 4, 2.5, 4.0
_WORD = re.compile(r"[^\W_]+")
_MEMORY = 400_000


def stems(word: str) -> list[int]:
    """A word (lower case) stands for itself and its beginnings of 4 to 7 letters, each as a 63-bit hash that 4 divides."""
    out = [f"w{word}"] + [f"p{word[:n]}" for n in (4, 5, 6, 7) if len(word) >= n]
    return [xxhash.xxh3_64_intdigest(x) >> 3 << 2 for x in out]


def features(counts: dict[int, int]) -> list[int]:
    """From stems and how many distinct words of a text have them: the stem, and again from two and from three words on."""
    return [s + k for s, n in counts.items() for k in range(min(n, 3))]


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


@dataclass
class Model:
    weights: dict[int, float]
    bias: float
    prior: float

    def __post_init__(self):
        self._of: dict[str, tuple[int, ...]] = {}
        self._stems = {f & ~3 for f in self.weights}

    def hits(self, word: str) -> tuple[int, ...]:
        found = tuple(f for f in stems(word) if f in self._stems)
        if len(self._of) >= _MEMORY:
            self._of.clear()
        self._of[word] = found
        return found

    def known(self, text: str | None) -> list[int]:
        """The model's features that a whole text has, in order."""
        of, counts = self._of, {}
        for w in words_of(text):
            for f in of[w] if w in of else self.hits(w):
                counts[f] = counts.get(f, 0) + 1
        return sorted(f for f in features(counts) if f in self.weights)

    def score(self, text: str | None) -> float:
        return float(sigmoid(np.float64(self.bias + sum(self.weights[f] for f in self.known(text)))))


def non_negative_pu(x: np.ndarray, positive: np.ndarray, prior: float, epochs: int = 400, rate: float = 0.05, l2: float = 1e-4, slack: float = 0.0) -> tuple[np.ndarray, float]:
    """A linear model from positive rows and unlabelled ones.

    With the sigmoid loss l(z) = 1 / (1 + exp(z)), the risk is prior * E+[l(g)] + max(0, E?[l(-g)] - prior * E+[l(-g)]): the
    unlabelled rows count as negative, less what the positives among them add. Where that difference falls below -slack,
    the step goes the other way on it, as it can't be negative but by overfitting.
    """
    w, b = np.zeros(x.shape[1]), np.zeros(1)
    adam = Adam([w, b], rate)
    p, u = x[positive], x[~positive]
    for _ in range(epochs):
        sp, su = sigmoid(p @ w + b), sigmoid(u @ w + b)
        dp, du = sp * (1 - sp) / max(1, len(p)), su * (1 - su) / max(1, len(u))
        negative = su.mean() - prior * sp.mean() if len(u) and len(p) else 0.0
        up, uu = -prior * dp, np.zeros_like(du)  # of prior * E+[l(g)]
        if negative >= -slack:
            up, uu = up - prior * dp, du
        else:
            up, uu = prior * dp, -du
        adam.step([p.T @ up + u.T @ uu + l2 * w, np.array([up.sum() + uu.sum()])])
    return w, float(b[0])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """From labelled toxic texts of folds 1 to 4 and unlabelled texts; the prior is the share of toxic among those labels.

    Chosen features are those whose frequency among toxic texts is far above that among non-toxic ones, the latter being
    estimated as the unlabelled frequency less the prior's share of the toxic one. The sample is at most about MOST_TOXIC and
    MOST_UNLABELLED texts; with no toxic label at all the model scores every text alike, below 0.5.
    """
    known = labels.where(F.col("toxic").isNotNull() & (fold("doc_id") != 0)).agg(F.avg(F.col("toxic").cast("double")).alias("prior")).first()
    prior = min(0.95, max(0.001, known["prior"] or 0.0))
    texts = training_texts(docs, labels, "toxic", MOST_TOXIC, MOST_UNLABELLED, only=1)

    def all_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, positive = [], []
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                got = features(Counter(f for w in words_of(text) for f in stems(w)))
                ids.extend(got)
                positive.extend([label == 1] * len(got))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(positive, pa.bool_())], ["feature", "positive"])

    sizes = {r["positive"]: r["n"] for r in texts.groupBy(F.col("label").isNotNull().alias("positive")).agg(F.count("*").alias("n")).collect()}
    n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
    if not n_p or not n_u:
        return Model({}, float(np.log(prior / (1 - prior))), prior)
    counts = texts.mapInArrow(all_features, "feature long, positive boolean").groupBy("feature").agg(F.count_if("positive").alias("a"), F.count_if(~F.col("positive")).alias("b"))
    p, u = F.col("a") / n_p, F.col("b") / n_u
    rest = F.greatest((u - prior * p) / (1 - prior), F.lit(0.5 / n_u))
    error = F.sqrt(p * (1 - p) / n_p + F.greatest(u, F.lit(1.0 / n_u)) / n_u)
    chosen = counts.where((F.col("a") >= LEAST_TEXTS) & (p >= LEAST_LIFT * rest) & (p - rest >= LEAST_Z * error))
    names = [r["feature"] for r in chosen.orderBy(F.desc((p - rest) / error), "feature").limit(FEATURES).collect()]
    model, place = Model(dict.fromkeys(names, 0.0), 0.0, prior), {f: i for i, f in enumerate(names)}

    def chosen_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [sorted(place[f] for f in model.known(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.int32())), pa.array([x == 1 for x in b.column("label").to_pylist()])], ["hits", "positive"])

    rows = texts.mapInArrow(chosen_features, "hits array<int>, positive boolean").toPandas()
    rows = rows.iloc[sorted(range(len(rows)), key=lambda i: (bool(rows["positive"].iloc[i]), tuple(rows["hits"].iloc[i])))]  # sums don't depend on the order of tasks
    x = np.zeros((len(rows), len(names)), np.float32)
    for i, hits in enumerate(rows["hits"]):
        x[i, np.asarray(hits, int)] = 1
    w, bias = non_negative_pu(x, rows["positive"].to_numpy(bool), prior)
    model.weights, model.bias = dict(zip(names, map(float, w), strict=True)), bias
    model._of.clear()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with `score`, 0 to 1. Null text counts as empty; every other column stays, but an own column `score` is replaced."""
    return with_scores(docs, lambda texts: [model.score(t) for t in texts])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (score >= 0.5).

    Labels are learnt from folds 1 to 4. A null doc_id is not held out; rows with one doc_id or text are scored one by one;
    rows without text score as the empty text; an empty table gives no row.
    """
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    held_out = F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
