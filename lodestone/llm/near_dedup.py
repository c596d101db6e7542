"""Near-duplicate detection: SimHash fingerprints searched in bands of their bits, with vantage-point trees where these grow large.

A document's fingerprint has 128 bits, each the sign of a sum over its distinct words. Two fingerprints within RADIUS of each
other are within (RADIUS / 5 =) 3 on at least one of five blocks of 25 or 26 bits, and so equal on at least one of the block's
four parts. A shard holds the fingerprints that are equal on one part of one block: 20 shards for each, whatever their number.
The rest of the block, 19 or 20 bits, is looked up with each of the masks of up to 3 bits, and what is found is compared whole.
Shards that would hold over LEAF on average are cut by vantage-point trees over Hamming distance on that rest: a fingerprint
lives in the leaf that it falls into and is sent, too, to the later leaves that its ball overlaps, which triangle bounds on the
distances to the vantage points tell.

A pair is found once, by the first block and part that can. A shard doesn't return its pairs but, for each fingerprint, how many
rows it is linked to there and the least fingerprint that it hangs together with, so a cluster of n costs n rows and not n * n.
Fingerprints are joined to groups by these, of which one document is kept.

Cost: 20 rows are shuffled and about 7,900 masks looked up for each fingerprint, whatever their number; comparisons grow with its
square, but by 4e-4 of all pairs (of evenly spread bits; three times that in texts).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import RID, columns, map_batches, numbered, small, tidy, without_rows, written
from lodestone.llm._text import bit_counts, blocks, distinct_rows, give_back, mix, span_hash, strings, words

#: Hamming distance, of 128 bits, up to which documents are near-duplicates: (BLOCK_RADIUS + 1) * BLOCKS - 1 at most.
RADIUS = 19
BLOCK_BITS, BLOCK_RADIUS = (26, 26, 26, 25, 25), 3
BLOCKS, PARTS = len(BLOCK_BITS), BLOCK_RADIUS + 1
#: Fingerprints that live in a shard on average at most, and fingerprints that vantage points are chosen from.
LEAF, SAMPLE = 1 << 18, 2_000
#: Masks that are looked up, and candidate pairs of a shard that are compared, at once.
LOOKUPS, STEP = 1 << 18, 1_000_000
#: Rows with fingerprints, groups and links, some 100 bytes each, that are broadcast at most.
FEW = 250_000


def simhash(column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """(n x 2 fingerprint halves, which rows have words) of whole texts."""
    out, has = np.zeros((len(column), 2), np.uint64), np.zeros(len(column), bool)
    for at, block in blocks(column):
        data, start, end, row = words(block)
        row, h = distinct_rows(row, span_hash(data, start, end))
        for half in (0, 1):
            count, ones = bit_counts(row, mix(h + np.uint64(half + 1)), len(block))
            out[at : at + len(block), half] = np.packbits(2 * ones > count[:, None], axis=1).view(np.uint64).ravel()
        has[at : at + len(block)] = count > 0
    return out, has


def fingerprints(docs: DataFrame) -> DataFrame:
    """(__rid, doc_id, a, b) of the rows whose text has a word."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp, has = simhash(strings(batch.column("text")))
        out = {RID: batch.column(RID), "doc_id": batch.column("doc_id"), "a": pa.array(fp[:, 0].view(np.int64)), "b": pa.array(fp[:, 1].view(np.int64))}
        return pa.RecordBatch.from_pydict(out).filter(pa.array(has))

    return map_batches(columns(docs, **{RID: "bigint", "doc_id": "bigint", "text": "string"}), run, f"{RID} bigint, doc_id bigint, a bigint, b bigint")


def block_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """n x 5 block values."""
    parts = [a, a >> np.uint64(26), (a >> np.uint64(52)) | (b << np.uint64(12)), b >> np.uint64(14), b >> np.uint64(39)]
    return np.stack([(p & np.uint64((1 << bits) - 1)).astype(np.int64) for p, bits in zip(parts, BLOCK_BITS, strict=True)], axis=1)


@dataclass(frozen=True)
class Band:
    """A part of a block, `width` bits from `shift` on. masks: by their highest bit, the masks of the block's other bits that have
    BLOCK_RADIUS bits at most and one at least in each part before, so that no pair is found by two parts."""

    block: int
    shift: int
    width: int
    masks: tuple[tuple[int, np.ndarray], ...]

    @property
    def bits(self) -> int:
        return BLOCK_BITS[self.block] - self.width

    def split(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the part, the rest) of block values."""
        part = (values >> self.shift) & ((1 << self.width) - 1)
        return part, values & ((1 << self.shift) - 1) | values >> (self.shift + self.width) << self.shift


def _bands() -> Iterator[Band]:
    for block, bits in enumerate(BLOCK_BITS):
        before: list[int] = []
        for part in range(PARTS):
            shift, width = bits * part // PARTS, bits * (part + 1) // PARTS - bits * part // PARTS
            masks: dict[int, list[int]] = {}
            for n in range(BLOCK_RADIUS + 1):
                for ones in combinations(range(bits - width), n):
                    mask = sum(1 << i for i in ones)
                    if all(mask & m for m in before):
                        masks.setdefault(mask.bit_length() - 1, []).append(mask)
            before.append(((1 << width) - 1) << shift)
            yield Band(block, shift, width, tuple((top, np.array(m, np.int64)) for top, m in sorted(masks.items())))


BANDS = tuple(_bands())
_WIDTH = max(band.width for band in BANDS)


@dataclass(frozen=True)
class Tree:
    """A vantage-point tree: the nodes' points and the distances that part what is near them; node i's children are 2i + 1 and 2i + 2."""

    depth: int
    points: np.ndarray
    middles: np.ndarray

    def leaves(self, values: np.ndarray, radius: int = BLOCK_RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, whether it lives there): each value's own leaf and the later ones that its ball overlaps."""
        row, node, lives = np.arange(len(values)), np.zeros(len(values), np.int64), np.ones(len(values), bool)
        for _ in range(self.depth):
            far = np.bitwise_count(values[row] ^ self.points[node]) - self.middles[node]
            inner, outer = far - radius < 0, far + radius > 0
            lives = np.r_[lives[inner] & (far[inner] < 0), lives[outer] & (far[outer] > 0)]
            row, node = np.r_[row[inner], row[outer]], np.r_[2 * node[inner] + 1, 2 * node[outer] + 2]
        home = np.empty(len(values), np.int64)
        home[row[lives]] = node[lives]
        kept = lives | (node > home[row])
        return row[kept], node[kept] - (1 << self.depth) + 1, lives[kept]


def grown(sample: np.ndarray, depth: int, bits: int, seed: int = 0) -> Tree:
    """Each node's vantage point, of a few drawn from its part of the sample, spreads that part's distances the most."""
    rng = np.random.default_rng(seed)
    points, middles, parts = [], [], [sample]
    for _ in range(depth):
        below = []
        for part in parts:
            pool = part if len(part) else rng.integers(0, 1 << bits, 8)
            tries = rng.choice(pool, min(8, len(pool)), replace=False)
            point = tries[int(np.argmax([np.bitwise_count(pool ^ v).astype(float).var() for v in tries]))]
            middle = np.floor(np.median(np.bitwise_count(pool ^ point))) + 0.5  # distances are whole numbers, so none lies on it
            near = np.bitwise_count(part ^ point) < middle
            points.append(point)
            middles.append(middle)
            below += [part[near], part[~near]]
        parts = below
    return Tree(depth, np.array(points, np.int64), np.array(middles, np.float32))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Which values a shard has and their places; empty between two calls of candidates()."""
    size = 1 << max(band.bits for band in BANDS)
    return np.zeros(size, bool), np.zeros(size, np.int32)


def candidates(band: Band, left: np.ndarray, right: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, y): the places in left and right whose values differ by a mask of the band; of left alone each pair once."""
    other = left if right is None else right
    order = np.argsort(other, kind="stable")
    value, first, n = np.unique(other[order], return_index=True, return_counts=True)
    has, place = _tables()

    def spread(x: np.ndarray, begin: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        total, at = np.cumsum(size), 0
        while at < len(x):
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP, "right")))
            each = size[at:stop]
            y = np.arange(int(each.sum())) + np.repeat(begin[at:stop] - (np.cumsum(each) - each), each)
            yield np.repeat(x[at:stop], each), order[y]
            at = stop

    has[value], place[value] = True, np.arange(len(value), dtype=np.int32)
    try:
        for top, masks in band.masks:
            if top < 0 and right is None:  # equal values
                after = np.arange(1, len(order) + 1)
                yield from spread(order, after, np.repeat(first + n, n) - after)
                continue
            rows = np.arange(len(left)) if right is not None else np.flatnonzero(left >> top & 1 == 0)  # the lesser value of a pair
            step = max(1, LOOKUPS // len(masks))
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                looked = (left[some][:, None] ^ masks).ravel()
                hit = np.flatnonzero(has.take(looked))
                if len(hit):
                    found = place[looked[hit]]
                    yield from spread(some[hit // len(masks)], first[found], n[found])
    finally:
        has[value] = False


def shard_pairs(band: Band, a: np.ndarray, b: np.ndarray, lives: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, y): the pairs within radius of a shard of distinct fingerprints, of which one at least lives there.

    A pair that an earlier block finds, because that block's distance is small too, is left to it.
    """
    rest = band.split(block_values(a, b)[:, band.block])[1]
    home, guest = np.flatnonzero(lives), np.flatnonzero(~lives)
    for who in (home, guest) if len(guest) else (home,):
        for x, y in candidates(band, rest[home], None if who is home else rest[guest]):
            x, y = home[x], who[y]
            near = np.bitwise_count(a[x] ^ a[y]) + np.bitwise_count(b[x] ^ b[y]) <= radius
            x, y = x[near], y[near]
            if band.block and len(x):
                fresh = (np.bitwise_count(block_values(a[x] ^ a[y], b[x] ^ b[y])[:, : band.block]) > BLOCK_RADIUS).all(axis=1)
                x, y = x[fresh], y[fresh]
            if len(x):
                yield x, y


def connected(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """label, the least place that each place hangs together with, after the pairs (x, y) are joined, too."""
    while True:
        one, two = label[x], label[y]
        apart = one != two
        if not apart.any():
            return label
        x, y = x[apart], y[apart]
        np.minimum.at(label, np.maximum(one, two)[apart], np.minimum(one, two)[apart])
        while (label[label] != label).any():
            label = label[label]


def sharded(prints: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(shard, lives, a, b, n) of a written table of distinct fingerprints (a, b) of n rows each; without n of one."""
    n = prints.count()
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / (leaf << min(band.width for band in BANDS))))))
    trees = [Tree(0, np.zeros(0), np.zeros(0))] * len(BANDS)
    if depth:
        sample = prints.orderBy(F.xxhash64("a", "b")).limit(SAMPLE).toPandas()
        values = block_values(*(sample[c].to_numpy(np.int64).view(np.uint64) for c in "ab"))
        trees = [grown(band.split(values[:, band.block])[1], depth, band.bits, seed=k) for k, band in enumerate(BANDS)]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = block_values(*(batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in "ab"))
            for k, band in enumerate(BANDS):
                part, rest = band.split(values[:, band.block])
                row, cell, lives = trees[k].leaves(rest)
                shard = ((k << _WIDTH) + part[row] << depth) + cell
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(lives), *batch.take(pa.array(row)).columns], ["shard", "lives", "a", "b", "n"])
        batch = values = part = rest = row = shard = lives = None
        give_back()

    many = F.col("n").cast("int") if "n" in prints.columns else F.lit(1)
    return prints.select("a", "b", many.alias("n")).mapInArrow(send, "shard bigint, lives boolean, a bigint, b bigint, n int").withColumn("band", F.shiftright("shard", depth + _WIDTH).cast("int"))


def _arrays(shard: pa.Table) -> tuple[Band, np.ndarray, np.ndarray, np.ndarray]:
    a, b = (shard.column(c).to_numpy().view(np.uint64) for c in "ab")
    return BANDS[shard.column("band")[0].as_py()], a, b, shard.column("lives").to_numpy()


def _checked(radius: int) -> int:
    if not 0 <= radius < BLOCKS * (BLOCK_RADIUS + 1):
        raise ValueError("radius must be below " + str(BLOCKS * (BLOCK_RADIUS + 1)))
    return radius


def near_pairs(prints: DataFrame, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """(a, b, a2, b2): every pair of distinct fingerprints (a, b) of a written table within radius, once."""
    _checked(radius)

    def search(shard: pa.Table) -> pa.Table:
        band, a, b, lives = _arrays(shard)
        found = list(shard_pairs(band, a, b, lives, radius))
        x, y = (np.concatenate(p) for p in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        return pa.table({name: pa.array(of.view(np.int64)) for name, of in (("a", a[x]), ("b", b[x]), ("a2", a[y]), ("b2", b[y]))})

    return sharded(prints, leaf).groupBy("shard").applyInArrow(search, "a bigint, b bigint, a2 bigint, b2 bigint")


def near_links(prints: DataFrame, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """(a, b, others, a2, b2) of each fingerprint with a pair, once for each shard that finds one.

    The sum of others is the number of rows of other fingerprints within radius. What pairs join is joined by (a, b) and (a2, b2), too.
    """
    _checked(radius)

    def search(shard: pa.Table) -> pa.Table:
        band, a, b, lives = _arrays(shard)
        n, others, label = shard.column("n").to_numpy().astype(np.int64), np.zeros(len(a), np.int64), np.arange(len(a))
        for x, y in shard_pairs(band, a, b, lives, radius):
            np.add.at(others, x, n[y])
            np.add.at(others, y, n[x])
            label = connected(label, x, y)
        x = np.flatnonzero(others)
        y = label[x]
        give_back()
        return pa.table({name: pa.array(of.view(np.int64)) for name, of in (("a", a[x]), ("b", b[x]), ("others", others[x]), ("a2", a[y]), ("b2", b[y]))})

    return sharded(prints, leaf).groupBy("shard").applyInArrow(search, "a bigint, b bigint, others bigint, a2 bigint, b2 bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of (x, y) edges that aren't their component's least: alternating large and small stars.

    Each round moves every neighbour of a node to the least one around; it ends when all hang on their root, after a number
    of rounds that grows with the logarithm of the component's size.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.select("x", "y").unionAll(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = e.groupBy("x").agg(F.min("y").alias("m"))
        joined = e.join(least, "x").withColumn("m", F.least("m", "x"))
        if large:
            return joined.where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        moved = joined.where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        return moved.unionAll(joined.select("x", F.col("m").alias("y"))).where("x <> y").distinct()

    e = edges.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).where("x <> y").distinct()
    last = None
    while True:
        e = written(star(star(e, True), False))
        state = e.agg(F.count("*").alias("n"), F.count_distinct("x").alias("nodes"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")).alias("sum")).first()
        if state == last:
            return e.select(F.col("x").alias("node"), F.col("y").alias("root"))
        last = state


def groups(docs: DataFrame, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """(__rid, doc_id, keeper, keeper_rid, links) of the rows of numbered docs that have a near-duplicate."""
    rows = written(fingerprints(docs))
    key = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", RID)).alias("first")
    prints = written(rows.groupBy("a", "b").agg(key, F.count("*").alias("n")).select("a", "b", "first", "n"))
    point = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    near = written(near_links(prints.select("a", "b", "n"), radius, leaf))
    pairs = near.select(point("a", "b").alias("x"), point("a2", "b2").alias("y"))
    root = small(components(pairs).select(F.col("node.a").alias("a"), F.col("node.b").alias("b"), "root"), FEW)
    others = near.groupBy("a", "b").agg(F.sum("others").alias("others"))
    rooted = prints.join(root, ["a", "b"], "left").withColumn("root", F.coalesce("root", point("a", "b")))
    per = rooted.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("size")).where("size > 1")
    links = (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links")
    found = rooted.join(per.select("root", F.col("first").alias("kept")), "root").join(others, ["a", "b"], "left").select("a", "b", F.col("kept").alias("first"), links)
    found = written(found)
    return rows.join(small(found, FEW), ["a", "b"]).select(RID, "doc_id", F.col("first.doc_id").alias("keeper"), F.col(f"first.{RID}").alias("keeper_rid"), "links")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Every row of docs as (doc_id, keeper, duplicate, links).

    keeper, the class id, is the least doc_id of the row's group; links counts the other rows within radius of the row. Groups
    are what pairs of fingerprints within radius join; equal fingerprints are at distance 0. Null and empty texts and texts
    without a word have no fingerprint, are their own keepers and have no links. Null doc_ids, as which those count that are
    no integers, come after all others. Of repeated rows one is kept, as of rows that tie in doc_id. A long text is
    fingerprinted whole. An empty table gives an empty result; extra columns are ignored.
    """
    docs = numbered(columns(docs, doc_id="bigint", text="string"))
    found = small(written(groups(docs, radius)).drop("doc_id"), FEW)
    return docs.select(RID, "doc_id").join(found, RID, "left").select(
        "doc_id",
        F.when(F.col("keeper_rid").isNull(), F.col("doc_id")).otherwise(F.col("keeper")).alias("keeper"),
        (F.col("keeper_rid").isNotNull() & (F.col("keeper_rid") != F.col(RID))).alias("duplicate"),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("links"),
    )


def without_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each group, that of the least doc_id; all columns stay.

    Rows without a fingerprint (null, empty and wordless texts) stay; of repeated rows one stays. An empty table stays empty; a
    table without a column text stays as it is. An input column named __rid goes.
    """
    docs = numbered(tidy(docs))
    return without_rows(docs, written(groups(docs, radius).where(f"keeper_rid <> {RID}").select(RID)))
