"""Language identification by a string kernel.

The kernel of two texts is the number of byte n-grams, of 1 to ORDERS bytes, that both contain, over the root of the
product of their numbers of n-grams (blended spectrum, presence only). Nystroem landmarks span its feature space, and a
ridge regression for each language against the rest is fitted there. n-grams live in BUCKETS hashed buckets, so texts and
landmarks are 0/1 rows; scores are their matrix product with landmarks x weights, multiplied once when fitting.

Scores only compare the languages with each other, so what is none of them is told by another measure, which their number
doesn't move: the share of a text's n-grams that the best language's fitted rows hold. What share a language's own texts
have is found by leaving each fitted row out in turn.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._common import RID, columns, numbered, quoted, small, tidy, written
from lodestone.llm._text import blocks, buffer, give_back, strings

ORDERS = 3
BUCKETS = 1 << 15
#: Labelled rows of each language that the classifier is fitted on at most, and landmarks of each.
FIT_ROWS = 300
LANDMARKS = 48
RIDGE = 1e-3
#: A text whose best score is below this is rejected. The best of k scores is never below (2 - k) / k.
MIN_SCORE = -0.4
#: A text is rejected, too, if its share of n-grams unknown to its language is over SLACK times what all but TAIL of that
#: language's fitted rows stay within.
TAIL, SLACK = 0.01, 2.0
_SHIFT = np.uint32(32 - 15)
#: Texts whose rows are multiplied together.
ROWS = 128


def _grams(data: np.ndarray) -> list[np.ndarray]:
    """Buckets of the n-grams that start at each byte, for each order."""
    out, code = [], np.zeros(len(data), np.uint32)
    for n in range(1, ORDERS + 1):
        if len(data) < n:
            break
        code = (code[: len(data) - n + 1] << np.uint32(8)) | data[n - 1 :]
        out.append(((code + np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)) >> _SHIFT)
    return out


def presence(column: pa.LargeStringArray, rows: int = ROWS) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows x BUCKETS) blocks: which buckets each lower-cased text has an n-gram in."""
    for first, block in blocks(column):
        data, offsets = buffer(pc.utf8_lower(block))
        grams = _grams(data)
        for at in range(0, len(block), rows):
            ends = offsets[at : min(at + rows, len(block)) + 1]
            seen = np.zeros((len(ends) - 1, BUCKETS), bool)
            for n, g in enumerate(grams):
                lengths = np.maximum(np.diff(ends) - n, 0)
                row = np.repeat(np.arange(len(lengths)), lengths)
                place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(ends[:-1], lengths)
                seen[row, g[place]] = True
            yield first + at, seen


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    known: np.ndarray  # languages x buckets: n-grams of the language's fitted rows
    min_known: np.ndarray  # the least share of known n-grams, of each language

    def judged(self, column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores of each language, distinct n-grams, whether the best language knows enough of them) of each text."""
        out, sizes = np.zeros((len(column), len(self.languages))), np.zeros(len(column), np.int64)
        familiar = np.zeros(len(column), bool)
        both = np.concatenate([self.weights, self.known.T], axis=1).astype(np.float32)
        for at, seen in presence(column):
            rows = slice(at, at + len(seen))
            size = seen.sum(axis=1)
            product = seen.astype(np.float32) @ both
            score = product[:, : len(self.languages)] / np.sqrt(np.maximum(size, 1))[:, None]
            best = (score + self.bias).argmax(axis=1)
            share = product[np.arange(len(seen)), len(self.languages) + best] / np.maximum(size, 1)
            out[rows], sizes[rows] = score, size
            familiar[rows] = (size > 0) & (share.astype(np.float64) >= self.min_known[best] - 1e-6)
        return out + self.bias, sizes, familiar

    def scores(self, column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """(scores of each language, distinct n-grams) of each text: products of the batch's 0/1 rows and the weights."""
        return self.judged(column)[:2]


def _familiarity(rows: np.ndarray, texts: list[str], labels: list[str], names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(known n-grams, least known share) of each language, by its distinct rows; a row's share is what the others know of it."""
    known, least = np.zeros((len(names), rows.shape[1]), bool), np.zeros(len(names))
    first = {(label, text): i for i, (label, text) in reversed(list(enumerate(zip(labels, texts, strict=True))))}
    for k, name in enumerate(names):
        own = rows[sorted(i for (label, _), i in first.items() if label == name)]
        times = own.sum(axis=0)
        known[k] = times > 0
        share = (own & (times > 1)).sum(axis=1) / np.maximum(1, own.sum(axis=1))
        least[k] = 1 - SLACK * (1 - np.quantile(share, TAIL))
    return known, least


def fit(texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """One-versus-rest kernel ridge regression on the given rows; landmarks are the first rows of each language."""
    names = sorted(set(labels))
    rows, unit = np.zeros((len(texts), BUCKETS), bool), np.zeros(len(texts), np.float32)
    for at, seen in presence(strings(pa.array(texts, pa.string()))):
        rows[at : at + len(seen)], unit[at : at + len(seen)] = seen, 1 / np.sqrt(np.maximum(1, seen.sum(axis=1)))
    y = np.array([[1.0 if label == name else -1.0 for name in names] for label in labels])
    chosen = [i for name in names for i in [k for k, label in enumerate(labels) if label == name][:landmarks]]
    marks = rows[chosen] * unit[chosen, None]
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])  # K_mm ** -1/2
    near = [(rows[at : at + ROWS] * unit[at : at + ROWS, None]) @ marks.T for at in range(0, len(rows), ROWS)]  # a float for each bucket of ROWS rows at a time
    features = np.concatenate(near) @ root
    mean, target = features.mean(axis=0), y.mean(axis=0)
    centred = features - mean
    w = np.linalg.solve(centred.T @ centred + ridge * len(texts) * np.eye(centred.shape[1]), centred.T @ (y - target))
    weights = np.concatenate([(part.T @ (root @ w)).astype(np.float32) for part in np.array_split(marks, 8, axis=1)])
    return Model(tuple(names), weights, target - mean @ w, *_familiarity(rows, texts, labels, names))


def fitted(docs: DataFrame, rows_each: int = FIT_ROWS, landmarks: int = LANDMARKS) -> Model | None:
    """A model from at most `rows_each` labelled rows of each language, chosen by hash; None without labelled rows."""
    docs = numbered(columns(docs, doc_id="bigint", text="string", lang="string"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(17)), RID)
    labelled = docs.where("lang IS NOT NULL AND lang <> '' AND text IS NOT NULL").select(RID, "doc_id", "lang")
    chosen = written(labelled.withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows_each).select(RID))
    got = docs.join(small(chosen), RID).select(RID, "text", "lang").orderBy(RID).toPandas()
    got = got[got["text"].str.len() > 0]
    model = fit(got["text"].tolist(), got["lang"].tolist(), landmarks) if len(got) else None
    del got
    give_back()
    return model


def _classifier(model: Model | None, min_score: float):
    kind = "struct<language:string,score:double,accepted:boolean>"

    @F.arrow_udf(kind)
    def classify(text: pa.Array) -> pa.Array:
        column = strings(text)
        if model is None:
            best, score, sizes, names = np.zeros(len(column), int), np.full(len(column), -1.0), np.zeros(len(column)), ("",)
            familiar = np.zeros(len(column), bool)
        else:
            scores, sizes, familiar = model.judged(column)
            best, names = scores.argmax(axis=1), model.languages
            score = scores[np.arange(len(column)), best]
        letters = np.array(pc.match_substring_regex(column, r"\p{L}").to_pylist(), bool)
        ok = (score >= min_score) & (sizes > 0) & familiar & letters
        give_back()
        language = pa.array([names[b] if k else None for b, k in zip(best, ok, strict=True)], pa.string())
        return pa.StructArray.from_arrays([language, pa.array(score.astype(np.float64)), pa.array(ok)], ["language", "score", "accepted"])

    return classify


def identified(docs: DataFrame, model: Model | None = None, min_score: float = MIN_SCORE) -> DataFrame:
    """Every row of docs as (doc_id, language, score, accepted), by the whole text.

    Rejected, with a null language: null and empty texts, texts without a letter, texts that score below min_score for
    every language, texts too few of whose n-grams their best language's fitted rows hold, and every text if no row is
    labelled. The fewer distinct rows a language has, the looser that bound; with one row it rejects nothing. Ties go to the
    name that sorts first. An empty table gives an empty result; extra columns are ignored.
    """
    model = model or fitted(docs)
    rows = columns(docs, doc_id="bigint", text="string")
    return rows.select("doc_id", _classifier(model, min_score)("text").alias("c")).select("doc_id", "c.language", "c.score", "c.accepted")


def accepted(docs: DataFrame, model: Model | None = None, min_score: float = MIN_SCORE) -> DataFrame:
    """docs without the rows that identified() rejects, null and empty texts among them; all columns stay.

    Repeated rows share their fate, ties between languages reject nothing, an empty table stays empty, and a table without a
    column text loses all its rows. An input column named __c goes.
    """
    model = model or fitted(docs)
    docs = tidy(docs, ["__c"])
    text = next((c for c in docs.columns if c.lower() == "text"), None)
    if text is None:
        return docs.limit(0)
    return docs.withColumn("__c", _classifier(model, min_score)(F.col(quoted(text)).cast("string"))).where("__c.accepted").drop("__c")
