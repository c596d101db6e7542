"""SentencePiece encoding and decoding as a relational lattice.

Texts fall into words that no piece crosses: two characters are parted where no piece holds two such characters side by
side. A word's substrings of bounded length are exploded, joined to the piece table by equality, grouped by word as the
lattice's edges, and folded by the higher-order function aggregate. For a unigram model the fold is Viterbi's: the best path
to each position, extended by the edges that end there. A BPE model's scores are merge ranks, and the path of the greatest
sum isn't what the model means: there the fold takes, again and again, the best-ranked leftmost edge that spans exactly two
neighbouring pieces. Characters without a piece become byte pieces.

Documents are not shuffled. The most frequent words of the whole table, HOT_WORDS at most, are encoded beforehand and broadcast.
A first pass writes the documents in packs, as word codes with the pack's other words beside them. A second one explodes
these words and their substrings; a word's edges come out of the join side by side, so they are grouped where they are, and
the documents are put together from the ids in the same task.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lodestone.llm._common import columns, quoted, tidy, written
from lodestone.llm._text import blocks, buffer, give_back, span_hash, strings

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Frequent words whose ids are broadcast at most: 24 bytes of table for each and 2 or 4 bytes for each id.
HOT_WORDS = 1 << 19
#: Words that a task counts at a time.
TASK_WORDS = 1 << 18
#: Bytes of short texts that travel in one row: small enough for the JVM to copy them without large allocations.
PACK_BYTES = 1 << 17
#: The fold's state is a 64-bit mask. A word of more characters, which no place parts, is folded by a heap in Python.
LONGEST = 61
SPACE = "▁"


@dataclass(frozen=True)
class Pieces:
    """A piece table: pieces that text can match, each with its id, score and rank (0 is best), and byte pieces' ids."""

    unigram: bool
    ids: dict[str, int]
    scores: dict[str, float]
    ranks: dict[str, int]
    byte_ids: tuple[int, ...]
    unknown: int
    decoded: tuple[bytes, ...]

    @property
    def longest(self) -> int:
        return max(map(len, self.ids))

    @property
    def unknown_score(self) -> float:
        return min(self.scores.values()) - 10.0


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        shift += 7
        at += 1
        if data[at - 1] < 128:
            return value, at


def _fields(data: bytes):
    """(number, value) of a protocol buffer's fields."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else (8 if kind == 1 else 4, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


@lru_cache(maxsize=4)
def load(path: str = MODEL) -> Pieces:
    """Reads a model file. Types: 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte."""
    with open(path, "rb") as f:
        return parse(f.read())


def parse(model: bytes) -> Pieces:
    unigram, pieces = True, []
    for number, value in _fields(model):
        if number == 1:
            fields = dict(_fields(value))
            score = np.frombuffer(fields[2], "<f4")[0] if 2 in fields else 0.0
            pieces.append((fields[1].decode(), float(score), fields.get(3, 1)))
        elif number == 2:
            unigram = dict(_fields(value)).get(3, 1) == 1
    text = {p: (i, s) for i, (p, s, kind) in enumerate(pieces) if kind in (1, 4)}
    ranked = sorted({s for _, s in text.values()}, reverse=True)
    rank = {s: r for r, s in enumerate(ranked)}
    byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == 6}
    unknown = next((i for i, p in enumerate(pieces) if p[2] == 2), 0)
    decoded = tuple(
        bytes([int(p[3:5], 16)]) if kind == 6 else b"" if kind == 3 else " ⁇ ".encode() if kind == 2 else p.replace(SPACE, " ").encode() for p, _, kind in pieces
    )
    return Pieces(
        unigram, {p: i for p, (i, _) in text.items()}, {p: s for p, (_, s) in text.items()}, {p: rank[s] for p, (_, s) in text.items()},
        tuple(byte[b] for b in range(256)) if len(byte) == 256 else (), unknown, decoded,
    )


def joined(pieces: Pieces) -> np.ndarray:
    """256 x 256: whether a piece has a character that ends with the first byte before one that begins with the second."""
    out = np.zeros((256, 256), bool)
    for p in pieces.ids:
        p = p.replace(SPACE, " ")
        for x, y in zip(p, p[1:], strict=False):
            out[x.encode()[-1], y.encode()[0]] = True
    return out


def segments(column: pa.LargeStringArray, joins: np.ndarray):
    """(data, start, end, row): the words of the texts, each text with a space before it; an empty text has none."""
    empty = pc.equal(pc.binary_length(column), 0)
    column = pc.if_else(empty, pa.scalar("", pa.large_string()), pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string())))
    data, offsets = buffer(column)
    if not len(data):
        return data, offsets[:0], offsets[:0], offsets[:0]
    first = np.empty(len(data), bool)
    first[1:] = ~joins.ravel()[(data[:-1].astype(np.int32) << 8) | data[1:]] & ((data[1:] & 0xC0) != 0x80)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    start = np.flatnonzero(first)
    return data, start, np.r_[start[1:], len(data)], np.searchsorted(offsets, start, "right") - 1


def sliced(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.LargeStringArray:
    """data[start:end] of each span, as strings."""
    n = end - start
    offsets = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=offsets[1:])
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], n) + np.repeat(start, n)
    return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(offsets), pa.py_buffer(data[at]))


def tidied(fn):
    """fn over batches, after which the worker, which later tasks use for other work, gives its memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return run


class Places:
    """A table from words' keys, a 64-bit hash and a 32-bit check, to numbers: open addressing over numpy arrays."""

    def __init__(self, room: int):
        self.bits = max(4, int(2 * max(room, 1)).bit_length())
        n = 1 << self.bits
        self.key, self.check, self.value = np.zeros(n, np.uint64), np.zeros(n, np.uint32), np.full(n, -1, np.int32)

    def find(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where there is none."""
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.value[slot]
        open_ = np.flatnonzero((out >= 0) & ((self.key[slot] != h) | (self.check[slot] != check)))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            got = self.value[slot]
            out[open_] = got
            more = (got >= 0) & ((self.key[slot] != h[open_]) | (self.check[slot] != check[open_]))
            open_, slot = open_[more], slot[more]
        return out

    def add(self, h: np.ndarray, check: np.ndarray, value: np.ndarray) -> None:
        """Enters distinct keys that aren't there, with distinct values."""
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(h):
            free = self.value[slot] < 0
            self.value[slot[free]] = value[free]  # of several in one place one stays
            won = self.value[slot] == value
            self.key[slot[won]], self.check[slot[won]] = h[won], check[won]
            h, check, value, slot = h[~won], check[~won], value[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)


class Words:
    """The distinct words of a task, numbered from 0."""

    def __init__(self, room: int):
        self.room, self.n, self.places = room, 0, Places(room)

    def full(self, more: int) -> bool:
        return self.n + more > self.room

    def numbers(self, h: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the number of each key, where the words that are new stand, by number)."""
        number = self.places.find(h, check)
        new = np.flatnonzero(number < 0)
        order = new[np.lexsort((check[new], h[new]))]
        first = np.ones(len(order), bool)
        first[1:] = (h[order[1:]] != h[order[:-1]]) | (check[order[1:]] != check[order[:-1]])
        number[order] = self.n + np.cumsum(first) - 1
        at = order[first]
        self.places.add(h[at], check[at], number[at])
        self.n += len(at)
        return number, at


_OTHER = np.random.default_rng(20240608).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, independent 32-bit check) of each data[start:end]."""
    return span_hash(data, start, end), (span_hash(data, start, end, _OTHER) >> np.uint64(32)).astype(np.uint32)


def counted(texts: DataFrame, pieces: Pieces, room: int = TASK_WORDS) -> DataFrame:
    """(word, n): how often each word occurs, without what occurs once in what a task remembers."""
    joins = joined(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, parts, count = Words(room), [], np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            n = pa.array(count)
            often = pc.greater(n, 1)
            return pa.RecordBatch.from_arrays([pa.concat_arrays(parts).cast(pa.string()).filter(often), n.filter(often)], ["word", "n"])

        for batch in batches:
            for _, block in blocks(strings(batch.column(0))):
                data, start, end, _ = segments(block, joins)
                if not len(start):
                    continue
                if seen.n and seen.full(len(start)):
                    yield out()
                    seen, parts, count = Words(max(room, len(start))), [], np.zeros(0, np.int64)
                elif seen.full(len(start)):
                    seen = Words(len(start))
                number, at = seen.numbers(*keys(data, start, end))
                parts.append(sliced(data, start[at], end[at]))
                count = np.r_[count, np.zeros(seen.n - len(count), np.int64)] + np.bincount(number, minlength=seen.n)
        if parts:
            yield out()

    return texts.mapInArrow(tidied(run), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def hot_words(texts: DataFrame, pieces: Pieces, most: int = HOT_WORDS) -> DataFrame:
    """(word) of the most frequent words of texts, `most` at most, by levels of an eighth of an octave."""
    counts = written(counted(texts, pieces).where(F.length("word") <= LONGEST).withColumn("level", F.floor(F.log2("n") * 8).cast("int")))
    taken, least = 0, 1 << 30
    for level, n in sorted(map(tuple, counts.groupBy("level").count().collect()), reverse=True):  # some hundred levels
        if taken + n > most:
            break
        taken, least = taken + n, level
    return counts.where(F.col("level") >= least).select("word").repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: An edge is one integer: rank, start, end, whether its merge is risky, id; from the highest bits down.
_RANK, _START, _END, _RISKY = 38, 32, 26, 25
_NO_ID = (1 << 25) - 1
_LAST_RANK = (1 << 25) - 1
_E = {"s": f"int(shiftright(e, {_START}) & 63)", "t": f"int(shiftright(e, {_END}) & 63)"}
#: Boundaries strictly inside the edge, and whether both its ends are boundaries of mask m.
_INNER = "((1L << {t}) - (1L << ({s} + 1)))".format(**_E)
_ENDS = "((shiftright(m, {t}) & shiftright(m, {s}) & 1L) = 1L)".format(**_E)


def risky(pieces: Pieces) -> set[str]:
    """Pieces whose merge can make a better-ranked one possible: they begin or end such a piece, and a piece is left."""
    out = set()
    for p, r in pieces.ranks.items():
        for k in range(1, len(p)):
            if p[:k] in pieces.ids and p[k:] in pieces.ids:
                out |= {part for part in (p[:k], p[k:]) if len(part) > 1 and pieces.ranks[part] > r}
    return out


def lattice(rows: DataFrame, pieces: Pieces) -> DataFrame:
    """(body, word) rows with edges: the piece matches in each row's word as sorted integers; none without a word.

    Nothing is shuffled: the rows of a word's spans stay side by side through explode and the join with the broadcast table,
    and the first of them, which alone has the word, tells where the next word begins. Words have LONGEST characters at most.
    A row without a word, which has a body, passes through.
    """
    if max(pieces.decoded and len(pieces.decoded), len(pieces.ranks)) >= _NO_ID:
        raise ValueError("too many pieces")
    at_risk = set() if pieces.unigram else risky(pieces)
    rank = lambda p: pieces.ranks[p] if pieces.unigram or len(p) > 1 else _LAST_RANK
    codes = [(p, rank(p) << _RANK | (p in at_risk) << _RISKY | i) for p, i in pieces.ids.items()]
    table = F.broadcast(rows.sparkSession.createDataFrame(codes, "piece string, code bigint"))  # fixed by the model
    spans = rows.select("body", "word", F.translate("word", " ", SPACE).alias("text"), F.coalesce(F.length("word"), F.lit(1)).alias("length"))
    spans = spans.select("body", "word", "text", "length", F.explode(F.expr("sequence(0, length - 1)")).alias("start"))
    spans = spans.select("body", "word", "text", "start", F.explode(F.expr(f"sequence(1, least({pieces.longest}, length - start))")).alias("size"))
    word = F.expr("CASE WHEN start = 0 AND size = 1 THEN word END").alias("word")
    spans = spans.select("body", word, F.col("text").isNotNull().alias("real"), "start", "size", F.expr("substr(text, start + 1, size)").alias("piece"))
    spans = spans.join(table, "piece", "left").where("code IS NOT NULL OR size = 1")
    lost = _LAST_RANK << _RANK | _NO_ID
    edge = F.expr(f"coalesce(code, {lost}L) | (cast(start AS BIGINT) << {_START}) | (cast(start + size AS BIGINT) << {_END})")
    spans = spans.select("body", "word", F.when(F.col("real"), edge).alias("edge"))

    def firsts(batch: pa.RecordBatch) -> pa.Array:
        return pc.or_(batch.column("word").is_valid(), batch.column("body").is_valid())

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        first, edge = firsts(batch), batch.column("edge")
        at = np.cumsum(first.to_numpy(zero_copy_only=False))
        owner = (at - 1)[edge.is_valid().to_numpy(zero_copy_only=False)]
        edge = edge.drop_null().to_numpy()
        n = np.bincount(owner, minlength=int(at[-1]))
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(edge[np.lexsort((edge, owner))]))
        return pa.RecordBatch.from_arrays([*(batch.column(c).filter(first) for c in ("body", "word")), lists], ["body", "word", "edges"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last word, which may go on in the next batch
        for batch in batches:
            if held is not None and len(held):
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if not len(batch):
                continue
            last = len(batch) - 1 - int(np.argmax(firsts(batch).to_numpy(zero_copy_only=False)[::-1]))
            if last:
                yield whole(batch.slice(0, last))
            held = pa.Table.from_batches([batch.slice(last)]).take(pa.array(range(len(batch) - last))).combine_chunks().to_batches()[0]
        if held is not None and len(held):
            yield whole(held)

    return spans.mapInArrow(tidied(gathered), "body binary, word string, edges array<bigint>")


def merged(edges: str, n: str) -> Column:
    """The BPE fold: the mask of the boundaries that remain.

    One pass over the edges by rank and start is exact unless a merge makes a better-ranked edge possible. A risky merge
    beside such an edge sets the mask's sign, and the word is folded again with a search for the best edge before each merge.
    """
    everything = f"((1L << ({n} + 1)) - 1L)"
    beside = (
        f"(shiftright(e, {_RISKY}) & 1L) = 1L AND exists({edges}, x -> x < e AND ((shiftright(x, {_START}) & 63) = (shiftright(e, {_START}) & 63)"
        f" OR (shiftright(x, {_END}) & 63) = (shiftright(e, {_END}) & 63)) AND (shiftright(x, {_END}) & 63) - (shiftright(x, {_START}) & 63) > (shiftright(e, {_END}) & 63) - (shiftright(e, {_START}) & 63))"
    )
    sign = "(1L << 63)"
    once = (
        f"aggregate({edges}, {everything}, (m, e) -> if(bit_count(m & {_INNER}) = 1 AND {_ENDS},"
        f" if({beside}, (m & ~{_INNER}) | {sign}, m & ~{_INNER}), m))"
    )
    first = f"get(filter({edges}, e -> bit_count(m & {_INNER}) = 1 AND {_ENDS}), 0)"
    again = f"aggregate(sequence(1, greatest({n}, 2) - 1), {everything}, (m, i) -> coalesce(get(transform(filter(array({first}), f -> f IS NOT NULL), e -> m & ~{_INNER}), 0), m))"
    return F.expr(f"transform(array({once}), once -> if(once < 0, {again}, once))[0]")


def merged_path(edges: str, mask: str) -> Column:
    """(start << 25 | id) of the edges between neighbouring boundaries, in order."""
    return F.expr(f"sort_array(transform(filter({edges}, e -> ({mask} & {_INNER}) = 0 AND {_ENDS.replace('(m,', f'({mask},')}), e -> ((shiftright(e, {_START}) & 63) << 25) | (e & {_NO_ID}L)))")


def viterbi_path(edges: str, n: str, pieces: Pieces) -> Column:
    """The unigram fold: (start << 25 | id) of the path with the greatest sum of scores; ties go to the longer last piece."""
    scores = [0.0] * (max(pieces.ranks.values()) + 1)
    for p, r in pieces.ranks.items():
        scores[r] = pieces.scores[p]
    table = "from_json('" + json.dumps(scores) + "', 'array<double>')"
    score = f"coalesce(get({table}, int(shiftright(e, {_RANK}))), {pieces.unknown_score}D)"
    best = (
        f"array_max(transform(filter({edges}, e -> (shiftright(e, {_END}) & 63) = i), e -> named_struct('score', get(p, {_E['s']}).score + {score}, 'early', -{_E['s']}, 'step',"
        f" ((shiftright(e, {_START}) & 63) << 25) | (e & {_NO_ID}L))))"
    )
    node = f"transform(array({best}), b -> named_struct('score', b.score, 'path', concat(get(p, -b.early).path, array(b.step))))"
    origin = "array(named_struct('score', 0D, 'path', cast(array() AS array<bigint>)))"
    return F.expr(f"aggregate(sequence(1, {n}), {origin}, (p, i) -> concat(p, {node}), p -> element_at(p, -1).path)")


def _ids(path: str, word: str, pieces: Pieces) -> Column:
    """The ids of a path's steps; a character without a piece has an id for each byte."""
    plain = f"transform({path}, p -> int(p & {_NO_ID}L))"
    if not pieces.byte_ids:
        return F.expr(f"transform({path}, p -> CASE WHEN (p & {_NO_ID}L) = {_NO_ID}L THEN {pieces.unknown} ELSE int(p & {_NO_ID}L) END)")
    table = "array(" + ",".join(map(str, pieces.byte_ids)) + ")"
    code = f"hex(encode(substr({word}, int(shiftright(p, 25)) + 1, 1), 'UTF-8'))"
    lost = f"transform(sequence(1, length({code}) div 2), i -> get({table}, int(conv(substr({code}, i * 2 - 1, 2), 16, 10))))"
    mixed = f"flatten(transform({path}, p -> CASE WHEN (p & {_NO_ID}L) = {_NO_ID}L THEN {lost} ELSE array(int(p & {_NO_ID}L)) END))"
    return F.expr(f"CASE WHEN exists({path}, p -> (p & {_NO_ID}L) = {_NO_ID}L) THEN {mixed} ELSE {plain} END")


def _chars(word: str, pieces: Pieces) -> list[int]:
    i = pieces.ids.get(word)
    return [i] if i is not None else [pieces.byte_ids[b] for b in word.encode()] if pieces.byte_ids else [pieces.unknown]


def encoded_long(word: str, pieces: Pieces) -> list[int]:
    """One word of any length: the same result as the folds, by a heap of merges or by Viterbi over bounded edges."""
    word = word.replace(" ", SPACE)
    n = len(word)
    if pieces.unigram:
        best, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
        for end in range(1, n + 1):
            for start in range(max(0, end - pieces.longest), end):
                score = pieces.scores.get(word[start:end], pieces.unknown_score if end - start == 1 else None)
                if score is not None and best[start] + score > best[end]:
                    best[end], back[end] = best[start] + score, start
        cuts = [n]
        while cuts[-1]:
            cuts.append(back[cuts[-1]])
        cuts.reverse()
    else:
        before, after, alive = list(range(-1, n)), list(range(1, n + 2)), [True] * (n + 1)  # of boundaries
        heap: list[tuple[int, int, int]] = []

        def push(start: int, end: int) -> None:
            if end - start <= pieces.longest and (rank := pieces.ranks.get(word[start:end])) is not None:
                heapq.heappush(heap, (rank, start, end))

        for i in range(n - 1):
            push(i, i + 2)
        while heap:
            _, start, end = heapq.heappop(heap)
            if not (alive[start] and alive[end]) or after[start] == end or after[after[start]] != end:
                continue
            gone = after[start]
            alive[gone] = False
            after[start], before[end] = end, start
            if start:
                push(before[start], end)
            if end < n:
                push(start, after[end])
        cuts = [i for i in range(n + 1) if alive[i]]
    return [i for a, b in zip(cuts, cuts[1:], strict=False) for i in _chars(word[a:b], pieces)]


def folded(rows: DataFrame, pieces: Pieces) -> DataFrame:
    """(body, word) rows with ids: those of each row's word, null where there is none."""
    edges = lattice(rows, pieces)
    own, some = ("body", "word"), F.col("word").isNotNull()
    if pieces.unigram:
        path = edges.select(*own, F.when(some, viterbi_path("edges", "length(word)", pieces)).alias("path"))
    else:
        path = edges.select(*own, "edges", F.when(some, merged("edges", "length(word)")).alias("mask"))
        path = path.select(*own, F.when(some, merged_path("edges", "mask")).alias("path"))
    return path.select(*own, F.when(some, _ids("path", f"translate(word, ' ', '{SPACE}')", pieces)).alias("ids"))


class Store:
    """Lists of ids by number, in one array: those of the hot words, then those of a pack's own."""

    def __init__(self, sizes: np.ndarray, ids: np.ndarray):
        self.hot, self.hot_ids = len(sizes), len(ids)
        self.start, self.size, self.ids = np.cumsum(sizes, dtype=np.int64) - sizes, sizes.astype(np.int64), ids

    def own(self, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Puts a pack's lists in the place of the last one's."""

        def room(a: np.ndarray, used: int, more: int) -> np.ndarray:
            return a if used + more <= len(a) else np.concatenate([a[:used], np.empty(2 * more, a.dtype)])

        self.start, self.size, self.ids = room(self.start, self.hot, len(sizes)), room(self.size, self.hot, len(sizes)), room(self.ids, self.hot_ids, len(ids))
        self.start[self.hot : self.hot + len(sizes)] = self.hot_ids + np.cumsum(sizes) - sizes
        self.size[self.hot : self.hot + len(sizes)] = sizes
        self.ids[self.hot_ids : self.hot_ids + len(ids)] = ids

    def lists(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, how many each code has); code -1 - i is the pack's word i."""
        at = np.where(codes >= 0, codes, self.hot - 1 - codes)
        n = self.size[at]
        total = np.cumsum(n)
        return self.ids[np.arange(total[-1] if len(n) else 0) + np.repeat(self.start[at] - (total - n), n)], n


def encode(docs: DataFrame, pieces: Pieces | None = None, hot: int = HOT_WORDS, decoded: bool = False) -> DataFrame:
    """docs without text, with ids: the piece ids of the whole text; other columns stay.

    A null or an empty text has no ids (an empty array). A text of any length is encoded whole, short ones
    PACK_BYTES at a time. Repeated rows are encoded alike. An empty table gives an empty result; without a column text every row
    counts as a null one; an input column named ids is replaced. With `decoded` the result is that of decode(), made by the
    same Python workers. Words are told apart by 96 bits of hash among the hot ones and the pack's own: that two of 2 million
    unlike words meet has a probability below 1e-16.
    """
    pieces = pieces or load()
    docs = tidy(docs, ["ids", "decoded"] if decoded else ["ids"])
    name = next((c for c in docs.columns if c.lower() == "text"), None)
    text = F.col(quoted(name)).cast("string") if name else F.lit(None).cast("string")
    rest = [f for f in docs.schema if f.name != name]
    joins, context = joined(pieces), docs.sparkSession.sparkContext
    small = np.uint16 if len(pieces.decoded) <= 1 << 16 else np.int32

    frequent = hot_words(docs.select(text.alias("text")), pieces, hot).select(F.lit(None).cast("binary").alias("body"), "word")
    frequent = written(folded(frequent, pieces).select("word", "ids")).toArrow()  # HOT_WORDS rows at most
    lists = frequent.column("ids").combine_chunks()
    places = Places(len(lists))
    for first, block in blocks(strings(frequent.column("word"))):
        data, offsets = buffer(block)
        places.add(*keys(data, offsets[:-1], offsets[1:]), np.arange(first, first + len(block), dtype=np.int32))
    known = context.broadcast(places)
    sizes, ids = pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
    kept = context.broadcast((sizes.astype(np.int32), ids.astype(small)))
    del frequent, lists, sizes, ids
    give_back()

    def packed(batch: pa.RecordBatch) -> pa.Array:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        return pa.array([sink.getvalue().to_pybytes()], pa.binary())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each pack: the words that aren't hot, and a body that holds its rows with their words' codes.

        A code is the hot word's number, or -1 - the number of the pack's own. Own words that are too long for the lattice come
        last and are encoded here; their ids travel in the body's metadata.
        """
        table = known.value
        for batch in batches:
            for first, block in blocks(strings(batch.column(len(rest))), PACK_BYTES):
                data, start, end, row = segments(block, joins)
                h, check = keys(data, start, end)
                code = table.find(h, check)
                cold = np.flatnonzero(code < 0)
                number, at = Words(len(cold)).numbers(h[cold], check[cold])
                word = sliced(data, start[cold[at]], end[cold[at]]).cast(pa.string())
                long = pc.greater(pc.utf8_length(word), LONGEST).to_numpy(zero_copy_only=False)
                order = np.argsort(long, kind="stable")
                place = np.empty(len(order), np.int32)
                place[order] = np.arange(len(order), dtype=np.int32)
                code[cold] = -1 - place[number]
                slow = [encoded_long(w, pieces) for w in word.filter(pa.array(long)).to_pylist()]
                short = word.filter(pa.array(~long))
                codes = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(block) + 1)).astype(np.int32)), pa.array(code))
                rows = pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, len(block)) for i in range(len(rest))), codes], [str(i) for i in range(len(rest) + 1)])
                rows = rows.replace_schema_metadata({"sizes": np.array([len(x) for x in slow], np.int64).tobytes(), "ids": np.array([i for x in slow for i in x], np.int64).tobytes()})
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(short)], pa.int32()), short), packed(rows)], ["words", "body"])

    back = decoder(pieces) if decoded else None
    labels = [*[f.name for f in rest], "ids", *(["decoded"] if decoded else [])]

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, own_sizes, own_ids = Store(*kept.value), [], []
        for batch in batches:
            body, lists = batch.columns
            last = 0
            for at in [*np.flatnonzero(body.is_valid().to_numpy(zero_copy_only=False)).tolist(), len(batch)]:
                part = lists.slice(last, at - last)
                own_sizes.append(pc.list_value_length(part).to_numpy(zero_copy_only=False).astype(np.int64))
                own_ids.append(part.flatten().to_numpy(zero_copy_only=False).astype(small))
                last = at + 1
                if at == len(batch):
                    break
                rows = pa.ipc.open_stream(body[at].as_buffer()).read_next_batch()
                slow = rows.schema.metadata
                store.own(np.concatenate([*own_sizes, np.frombuffer(slow[b"sizes"], np.int64)]), np.concatenate([*own_ids, np.frombuffer(slow[b"ids"], np.int64).astype(small)]))
                own_sizes, own_ids = [], []
                codes = rows.column(len(rest))
                ids, each = store.lists(codes.values.to_numpy())
                made = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(each)][codes.offsets.to_numpy()].astype(np.int32)), pa.array(ids.astype(np.int32)))]
                made += [back(made[0])] if decoded else []
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(rest)], *made], labels)

    rows = docs.select(*[F.col(quoted(f.name)) for f in rest], text.alias("text"))
    packs = written(rows.mapInArrow(tidied(cut), "words array<string>, body binary"))
    each = F.expr("explode(concat(transform(words, w -> struct(cast(null AS binary) AS body, w AS word)), array(struct(body, cast(null AS string) AS word)))) AS e")
    schema = StructType([StructField(f.name, f.dataType) for f in rest]).add("ids", ArrayType(IntegerType()))
    done = folded(packs.select(each).select("e.body", "e.word"), pieces).select("body", "ids")
    return done.mapInArrow(tidied(put_together), schema.add("decoded", StringType()) if decoded else schema)


def decoder(pieces: Pieces):
    """The function from arrays of ids to an array of their texts."""
    data = np.frombuffer(b"".join(pieces.decoded), np.uint8)
    size = np.array([len(p) for p in pieces.decoded], np.int64)
    first = np.cumsum(size) - size

    def text(ids: pa.Array) -> pa.Array:
        lists = pc.if_else(pc.is_valid(ids), ids, pa.scalar([], ids.type)) if ids.null_count else ids
        flat = np.asarray(lists.flatten().fill_null(-1)).astype(np.int64)
        flat = np.where((flat >= 0) & (flat < len(size)), flat, pieces.unknown)
        bounds = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))].astype(np.int64)
        n = size[flat]
        total = np.r_[0, np.cumsum(n)]
        out = data[np.arange(total[-1]) - np.repeat(total[:-1], n) + np.repeat(first[flat], n)]
        cut = total[bounds]
        leading = np.zeros(len(cut) - 1, bool)
        some = cut[1:] > cut[:-1]
        leading[some] = out[cut[:-1][some]] == 32
        keep = np.ones(len(out), bool)
        keep[cut[:-1][leading]] = False
        offsets = np.r_[0, np.cumsum(np.diff(cut) - leading)].astype(np.int64)
        binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(out[keep])])
        try:
            result = binary.cast(pa.large_string())
        except pa.ArrowInvalid:
            result = pa.array([b.decode(errors="replace") for b in binary.to_pylist()], pa.large_string())
        result = pc.if_else(pc.is_valid(ids), result, pa.scalar(None, pa.large_string())) if ids.null_count else result
        return result.cast(pa.string())

    return text


def decode(encoded: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """encoded with decoded, the text of the ids: pieces joined, the leading space dropped. Null ids give null.

    Ids outside the model count as unknown. Byte pieces that make no valid UTF-8 become U+FFFD. An input column named
    decoded is replaced.
    """
    encoded = tidy(encoded, ["decoded"])
    return encoded.withColumn("decoded", F.arrow_udf(decoder(pieces or load()), "string")("ids"))


def round_trip(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, ids, decoded) of every row of docs: encode(), then decode(). Null texts decode to empty ones."""
    pieces = load(path)
    rows = columns(docs, doc_id="bigint", text="string")
    return encode(rows, pieces, decoded=True).select("doc_id", "ids", "decoded")
