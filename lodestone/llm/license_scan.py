"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

Templates of S/2 to S shingles are looked for in windows of 2 S shingles that start every S shingles, so any place where a
template stands lies whole in some window, and the window's Jaccard similarity with it is 1/4 at least. With BANDS bands
of one hash each a window then meets the template with probability 1 - (3/4) ** BANDS, over 0.9999. A window that holds a share
c of the template's shingles has Jaccard c / (5 - c) at least, so it is met with probability 1 - (1 - c / (5 - c)) ** BANDS or
more, 0.9988 at 0.8. Templates of one shingle need
no bands: they are where their shingle is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm._common import columns, map_batches
from lodestone.llm._text import blocks, mix, span_hash, strings, words
from lodestone.llm.license_templates import TEMPLATES

SHINGLE = 3
BANDS = 32
#: The share of a template's shingles that a match contains.
CONTAINMENT = 0.8
SCHEMA = "doc_id bigint, license string, word int, containment double"


def _shingles(column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word within the row, hash) of the shingles of each text."""
    data, start, end, row = words(column)
    h = span_hash(data, start, end)
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    place = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
    if len(h) < SHINGLE:
        return row[:0], place[:0], h[:0]
    whole = row[SHINGLE - 1 :] == row[: len(row) - SHINGLE + 1]
    out = h[: len(h) - SHINGLE + 1]
    for k in range(1, SHINGLE):
        out = mix(out * np.uint64(3) + h[k : len(h) - SHINGLE + 1 + k])
    return row[: len(whole)][whole], place[: len(whole)][whole], out[whole]


def _band(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash function: an odd multiple, high bits last."""
    x = h * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & (2**64 - 1))
    return x ^ (x >> np.uint64(29))


@dataclass(frozen=True)
class Index:
    names: tuple[str, ...]
    shingles: tuple[np.ndarray, ...]  # sorted, distinct
    single: tuple[np.ndarray, np.ndarray]  # the sorted shingles of templates that have one, templates
    bands: dict[int, list[tuple[np.ndarray, np.ndarray]]]  # by S and band: sorted minima, templates


def index(templates: list[tuple[str, str]]) -> Index:
    names, sets = [], []
    for name, text in templates:
        h = np.unique(_shingles(strings(pa.array([text])))[2])
        if not len(h):
            raise ValueError(f"a template needs at least {SHINGLE} words: {name}")
        names.append(name)
        sets.append(h)
    one = np.array([t for t, h in enumerate(sets) if len(h) == 1], np.int64)
    lone = np.array([sets[t][0] for t in one], np.uint64)
    order = np.argsort(lone, kind="stable")
    single = lone[order], one[order]
    size = np.array([max(4, 1 << int(len(h) - 1).bit_length()) if len(h) > 1 else 0 for h in sets], np.int64)
    bands = {}
    for s in sorted(set(size[size > 0].tolist())):
        of = np.flatnonzero(size == s)
        bands[s] = []
        for k in range(BANDS):
            low = np.array([_band(sets[t], k).min() for t in of])
            order = np.argsort(low, kind="stable")
            bands[s].append((low[order], of[order]))
    return Index(tuple(names), tuple(sets), single, bands)


def _candidates(ix: Index, first: np.ndarray, n: np.ndarray, h: np.ndarray):
    """(template, first shingle, end) of the windows that meet a template's minimum in some band, and of lone shingles."""
    lone, of = ix.single
    left, right = np.searchsorted(lone, h, "left"), np.searchsorted(lone, h, "right")
    for w in np.flatnonzero(left < right):
        for t in of[left[w] : right[w]]:
            yield int(t), int(w), int(w) + 1
    hashed = [_band(h, k) for k in range(BANDS)]
    for s, tables in ix.bands.items():
        steps = -(-n // s)
        row = np.repeat(np.arange(len(n)), steps)
        step = np.arange(len(row)) - np.repeat(np.cumsum(steps) - steps, steps)
        start = first[row] + step * s
        stop = first[row] + n[row]
        last = np.r_[row[1:] != row[:-1], True] if len(row) else np.zeros(0, bool)
        for k, (low, of) in enumerate(tables):
            part = np.minimum.reduceat(hashed[k], start)
            window = part.copy()
            window[:-1] = np.where(last[:-1], part[:-1], np.minimum(part[:-1], part[1:]))
            left = np.searchsorted(low, window, "left")
            for w in np.flatnonzero(left < np.searchsorted(low, window, "right")):
                for t in of[left[w] : np.searchsorted(low, window[w], "right")]:
                    yield int(t), int(start[w]), int(min(start[w] + 2 * s, stop[w]))


def matches(column: pa.LargeStringArray, ix: Index, containment: float = CONTAINMENT) -> list[tuple[int, int, int, float]]:
    """(row, template, first word, containment) of each text's matches: of each template the fullest, then the first.

    A match that overlaps a fuller one, of a template that differs in a few words, gives way to it.
    """
    best: dict[tuple[int, int], tuple[float, int]] = {}
    at = 0
    for at, block in blocks(column):
        row, place, h = _shingles(block)
        if not len(h):
            continue
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        n = np.diff(np.r_[first, len(row)])
        for t, start, end in set(_candidates(ix, first, n, h)):
            inside = np.isin(h[start:end], ix.shingles[t])
            share = len(np.unique(h[start:end][inside])) / len(ix.shingles[t])
            if share >= containment:
                key, word = (at + int(row[start]), t), int(place[start + int(inside.argmax())])
                best[key] = min(best.get(key, (1.0, 0)), (-share, word))
    out: dict[int, list[tuple[int, int, float]]] = {}
    for (row, t), (share, word) in sorted(best.items(), key=lambda m: m[1]):  # fullest first
        over = lambda m: m[2] > -share and m[1] < word + len(ix.shingles[t]) and word < m[1] + len(ix.shingles[m[0]])  # noqa: B023, E731
        if not any(map(over, out.setdefault(row, []))):
            out[row].append((t, word, -share))
    return [(row, *m) for row in sorted(out) for m in sorted(out[row])]


def scanned(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """A row (doc_id, license, word, containment) for each template that a row's whole text contains.

    word counts from 0 and is where the fullest place begins. Null, empty and shorter than three-word texts match nothing.
    Repeated rows repeat their matches; null doc_ids stay null; templates that match equally well in one place are all given. An empty
    table gives an empty result; extra columns are ignored.
    """
    ix = index(templates)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = matches(strings(batch.column("text")), ix, containment)
        row, t, word, share = zip(*found, strict=True) if found else ((),) * 4
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id").take(pa.array(np.array(row, np.int64))),
                "license": pa.array([ix.names[i] for i in t], pa.string()),
                "word": pa.array(word, pa.int32()),
                "containment": pa.array(share, pa.float64()),
            }
        )

    return map_batches(columns(docs, doc_id="bigint", text="string"), run, SCHEMA)
