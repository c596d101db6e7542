"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score."""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import columns, map_batches
from lodestone.llm._text import strings

#: Spans that score less are left out.
MIN_SCORE = 0.5
#: Characters on either side of a span in which context words count.
CONTEXT = 48


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return len(digits) > 1 and total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _card(s: str) -> float:
    d = re.sub(r"[ -]", "", s)
    return 0.5 if 13 <= len(d) <= 19 and len(set(d)) > 1 and d[0] in "23456" and luhn(d) else -1.0


_IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21,
    "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}


def _iban(s: str) -> float:
    s = s.replace(" ", "")
    return 0.5 if len(s) == _IBAN_LENGTHS.get(s[:2], 0) and mod97(s) else -1.0


def _ip(s: str) -> float:
    parts = [int(p) for p in s.split(".")]
    return 0.1 if max(parts) < 256 and parts[0] not in (0, 127) and all(p == str(int(p)) for p in s.split(".")) else -1.0


def _ssn(s: str) -> float:
    a, b, c = s.split("-")
    return 0.1 if a not in ("000", "666") and a < "900" and b != "00" and c != "0000" else -1.0


def _phone(s: str) -> float:
    n = sum(c.isdigit() for c in s)
    return 0.1 if 9 <= n <= 15 else -1.0


_LEFT, _RIGHT = r"(?<![\w.+-])", r"(?![\w-])"
_SECRET = r"password|passwd|pwd|token|secret|api[_-]?key"
#: kind, what any match contains (None: a digit), pattern, base score, validator's change of score (-1 rejects), context words
KINDS = [
    ("email", "@", re.compile(r"(?<![\w.+%-])[A-Za-z0-9_][\w.+%-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![\w-])"), 0.9, None, ("mail", "contact", "write")),
    ("aws_key", "A", re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"), 0.9, None, ("key", "aws", "secret")),
    ("secret", re.compile(rf"(?i){_SECRET}"), re.compile(rf"(?i)(?<![A-Za-z0-9])(?:{_SECRET})[ \t]{{0,3}}[:=][ \t]{{0,3}}\"?[A-Za-z0-9_/+=-]{{12,}}\"?"), 0.8, None, ("login", "auth", "key")),
    ("iban", None, re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"), 0.4, _iban, ("iban", "account", "bank", "konto")),
    ("card", None, re.compile(r"(?<![\w.-])[2-6][0-9]{3}(?:[0-9]{9,15}|(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}|[ -][0-9]{6}[ -][0-9]{4,5})(?![\w-])"), 0.4, _card, ("card", "visa", "credit", "pay", "karte")),
    ("ipv4", None, re.compile(r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[\w])"), 0.5, _ip, ("ip", "host", "server", "address", "log")),
    ("ssn", None, re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"), 0.4, _ssn, ("ssn", "social", "security")),
    ("phone", None, re.compile(r"(?<![\w.+-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,4}(?![\w-]|\.[0-9])"), 0.2, _phone, ("phone", "tel", "call", "mobile", "fax", "dial")),
]
_EXAMPLE = ("example", "sample", "dummy", "test")


def spans(text: str, min_score: float = MIN_SCORE) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of the text's spans, in order; of overlapping ones the best, then the first, stays."""
    found, digit = [], re.search("[0-9]", text) is not None
    for rank, (kind, needle, pattern, base, validate, context) in enumerate(KINDS):
        if not (digit if needle is None else needle in text if isinstance(needle, str) else needle.search(text)):
            continue
        for m in pattern.finditer(text):
            score = base
            if validate is not None:
                change = validate(m.group())
                if change < 0:
                    continue
                score += change
            if kind == "phone" and m.group()[0] in "+(":
                score += 0.3
            near = re.findall(r"[a-z]+", (text[max(0, m.start() - CONTEXT) : m.start()] + " " + text[m.end() : m.end() + CONTEXT]).lower())
            score += 0.3 * any(w in near for w in context) - 0.2 * any(w in near for w in _EXAMPLE)
            score = round(min(1.0, score), 2)
            if score >= min_score:
                found.append((-score, rank, m.start(), m.end(), kind))
    taken: list[tuple[int, int]] = []
    out = []
    for score, _, start, end, kind in sorted(found):
        at = bisect_left(taken, (start, end))
        if (at and taken[at - 1][1] > start) or (at < len(taken) and taken[at][0] < end):
            continue
        taken.insert(at, (start, end))
        out.append((kind, start, end, -score))
    return sorted(out, key=lambda s: s[1])


SCHEMA = "doc_id bigint, kind string, start int, end int, score double"


def personal_data(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """A row (doc_id, kind, start, end, score) for each span of each row's whole text, in characters from 0.

    Null and empty texts have no spans. Repeated rows repeat their spans. Null doc_ids stay null, and those that are no integers
    become null. Of spans that overlap the best-scored stays, of equal ones the kind that comes first in KINDS, then the one that
    begins first. A text of any length is searched whole. An empty table gives an empty result; extra columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(i, *s) for i, t in enumerate(strings(batch.column("text")).to_pylist()) for s in spans(t, min_score)]
        at, kind, start, end, score = zip(*rows, strict=True) if rows else ((),) * 5
        ids = batch.column("doc_id").take(pa.array(np.array(at, np.int64)))
        return pa.RecordBatch.from_pydict(
            {"doc_id": ids, "kind": pa.array(kind, pa.string()), "start": pa.array(start, pa.int32()), "end": pa.array(end, pa.int32()), "score": pa.array(score, pa.float64())}
        )

    texts = columns(docs, doc_id="bigint", text="string").where(F.col("text").rlike(f"[0-9@]|A[KS]IA|(?iu:{_SECRET})"))
    return map_batches(texts, run, SCHEMA)


def redact(text: str, min_score: float = MIN_SCORE) -> str:
    """text with each span replaced by its kind in brackets."""
    out, last = [], 0
    for kind, start, end, _ in spans(text, min_score):
        out += [text[last:start], f"[{kind}]"]
        last = end
    return "".join([*out, text[last:]])
