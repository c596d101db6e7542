"""A quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled text train a linear model that minimises the non-negative unbiased risk
prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)).  A text's features are its hashed words and its hashed
shape trigrams (bytes with letters and digits alike). The class prior is estimated from the same rows: a classifier of positives
against unlabelled text is fitted on half of them, and the prior is the least ratio, over score levels, of the unlabelled to the
positive rows above the level in the other half.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import RID, columns, numbered, small, written
from lodestone.llm._text import blocks, buffer, span_hash, strings, words

HALF_BITS = 10
BUCKETS = 2 << HALF_BITS
#: Rows of each kind, positive and unlabelled, that the model is fitted on at most.
FIT_ROWS = 4000
STEPS = 600
THRESHOLD = 0.5

#: Letters of any script are alike but for their case, digits are alike: what is left is a text's shape.
_CLASS = np.arange(256, dtype=np.uint32)
_CLASS[48:58] = 48
_CLASS[97:123] = 97
_CLASS[65:91] = 65
_CLASS[128:] = 97
_ROWS = 512


def features(column: pa.LargeStringArray):
    """(first row, rows x BUCKETS) blocks: roots of the shares of words, then of shape trigrams, as unit vectors."""
    half = BUCKETS // 2
    done = 0
    for _, block in blocks(column):
        data, offsets = buffer(block)
        shape = _CLASS[data]
        code = np.zeros(len(data), np.uint32)
        if len(data):
            place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))  # within the text: no trigram reaches back over its start
            code[:] = shape * np.uint32(257)
            code[1:] += np.where(place[1:] > 0, shape[:-1], np.uint32(0))
            code[2:] += np.where(place[2:] > 1, shape[:-2], np.uint32(0)) * np.uint32(66049)
        shapes = half + ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - HALF_BITS)).astype(np.int64)
        lower, start, end, owner = words(block)
        said = (span_hash(lower, start, end) >> np.uint64(64 - HALF_BITS)).astype(np.int64)
        firsts = np.searchsorted(owner, np.arange(len(block) + 1))
        for at in range(0, len(block), _ROWS):
            stop = min(at + _ROWS, len(block))
            lengths = np.diff(offsets[at : stop + 1])
            row, own = np.repeat(np.arange(stop - at), lengths), slice(firsts[at], firsts[stop])
            place = np.r_[row * BUCKETS + shapes[offsets[at] : offsets[stop]], (owner[own] - at) * BUCKETS + said[own]]
            counts = np.bincount(place, minlength=(stop - at) * BUCKETS).reshape(stop - at, BUCKETS).astype(float)
            counts[:, :half] /= 2 * np.maximum(counts[:, :half].sum(axis=1), 1)[:, None]
            counts[:, half:] /= 2 * np.maximum(lengths, 1)[:, None]
            yield done + at, np.sqrt(counts)
        done += len(block)


def matrix(texts: list[str]) -> np.ndarray:
    parts = [x for _, x in features(strings(pa.array(texts, pa.string())))]
    return np.concatenate(parts) if parts else np.zeros((0, BUCKETS))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, column: pa.LargeStringArray) -> np.ndarray:
        out = np.zeros(len(column))
        for at, x in features(column):
            out[at : at + len(x)] = 1 / (1 + np.exp(-(x @ self.weights + self.bias)))
        return out


def _adam(gradient, size: int, steps: int, rate: float = 0.05) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _logit(p: np.ndarray, u: np.ndarray, steps: int) -> np.ndarray:
    x = np.concatenate([p, u])
    y = np.r_[np.ones(len(p)), np.zeros(len(u))]
    share = np.where(y > 0, 0.5 / max(1, len(p)), 0.5 / max(1, len(u)))
    return _adam(lambda w: x.T @ (share * (1 / (1 + np.exp(-(x @ w))) - y)) + 1e-4 * w, x.shape[1], steps)


def estimated_prior(p: np.ndarray, u: np.ndarray, steps: int = STEPS // 3) -> float:
    """The share of positives in u: the least ratio, over score levels, of u's to p's share of rows above it, held out."""
    w = _logit(p[::2], u[::2], steps)
    sp, su = p[1::2] @ w, u[1::2] @ w
    levels = np.quantile(sp, np.linspace(0.02, 0.5, 25)) if len(sp) else np.zeros(0)
    ratios = [(su >= t).mean() / (sp >= t).mean() for t in levels if len(su)]
    return float(np.clip(min(ratios, default=0.5), 0.05, 0.95))


def fit(positives: list[str], unlabelled: list[str], prior: float | None = None, steps: int = STEPS) -> Model:
    """Minimises the non-negative risk with the sigmoid loss; where its second part is negative, its gradient is undone."""
    one = lambda x: np.concatenate([x, np.ones((len(x), 1))], axis=1)
    p, u = one(matrix(positives)), one(matrix(unlabelled))
    prior = estimated_prior(p, u) if prior is None else prior

    def gradient(w: np.ndarray) -> np.ndarray:
        sp, su = 1 / (1 + np.exp(-(p @ w))), 1 / (1 + np.exp(-(u @ w)))
        dp, du = p.T @ (sp * (1 - sp)) / len(p), u.T @ (su * (1 - su)) / len(u)  # of the mean of R-
        rest = su.mean() - prior * sp.mean()
        negative = du - prior * dp
        return -prior * dp + (negative if rest >= 0 else -negative) + 2e-5 * w

    w = _adam(gradient, p.shape[1], steps)
    return Model(w[:-1], float(w[-1]), prior)


def fitted(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model | None:
    """A model from at most fit_rows positives (labels of quality 1) and fit_rows rows of docs, by hash; None without either."""
    docs = numbered(columns(docs, doc_id="bigint", text="string")).where("text IS NOT NULL")
    good = columns(labels, doc_id="bigint", quality="int").where("quality = 1").select("doc_id").distinct()
    order = F.xxhash64("doc_id", F.lit(23))
    ids = docs.select(RID, "doc_id")
    p = ids.join(good, "doc_id").select(RID, order.alias("h"), F.lit(True).alias("positive")).orderBy("h", RID).limit(fit_rows)
    u = ids.select(RID, F.xxhash64("doc_id", F.lit(29)).alias("h"), F.lit(False).alias("positive")).orderBy("h", RID).limit(fit_rows)
    chosen = written(p.unionByName(u))
    got = docs.join(small(chosen), RID).select("h", RID, "positive", "text").orderBy("h", RID).toPandas()
    is_p = got["positive"].astype(bool)
    if not is_p.any() or is_p.all():
        return None
    return fit(got["text"][is_p].tolist(), got["text"][~is_p].tolist())


def scored(docs: DataFrame, labels: DataFrame | None = None, model: Model | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of docs as (doc_id, score, keep): score is in [0, 1], keep where it reaches the threshold.

    Null and empty texts score 0 and are not kept. Without a positive label nothing can be learned: every text scores
    0.5. A score of just the threshold is kept. Null and non-integer doc_ids are null and have no label. An empty table gives an
    empty result; extra columns are ignored; repeated rows score alike; a text of any length is scored whole.
    """
    model = model or fitted(docs, labels)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        column = strings(text)
        s = model.scores(column) if model is not None else np.full(len(column), 0.5)
        return pa.array(np.where(np.diff(buffer(column)[1]) > 0, s, 0.0))

    rows = columns(docs, doc_id="bigint", text="string").select("doc_id", score("text").alias("score"))
    return rows.withColumn("keep", F.col("score") >= F.lit(float(threshold)))
