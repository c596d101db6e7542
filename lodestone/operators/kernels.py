"""Graph kernels for one Python task: numpy over int arrays, no node by node work except on cyclic cores.

Strings are numbered in their own order, so the least number is the least name. All kernels take linear memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

HELD = 4_000_000  # rows that a task holds before it reduces them
_ROW = (1 << 33) - 1  # monotonically_increasing_id: the partition's number, then 33 bits of row


def numbered(*columns: list[pa.Array]) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct strings in order, and each column's numbers in them."""
    parts = [a.cast(pa.large_string()) for column in columns for a in column]
    coded = pa.chunked_array(parts, pa.large_string()).combine_chunks()
    coded = (pa.concat_arrays(coded.chunks) if isinstance(coded, pa.ChunkedArray) else coded).dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    codes = rank[coded.indices.to_numpy(zero_copy_only=False)]
    ends = np.cumsum([sum(len(a) for a in column) for column in columns])
    return coded.dictionary.take(order), np.split(codes, ends[:-1])


class Links:
    """Targets by source of the edges a -> b over 0 .. n - 1."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n: int):
        self.degree = np.bincount(a, minlength=n)
        self.start = np.cumsum(self.degree) - self.degree
        self.target = b[np.argsort(a, kind="stable")]

    def out(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The edges out of nodes: the place of each in nodes, and its target."""
        degree = self.degree[nodes]
        place = np.repeat(np.arange(len(nodes)), degree)
        first = np.cumsum(degree) - degree
        return place, self.target[np.arange(len(place)) + (self.start[nodes] - first)[place]]


def depths(links: Links, seeds: np.ndarray, n: int, max_depth: int | None = None) -> np.ndarray:
    """Each node's least number of steps from a seed; -1 where there is none."""
    depth = np.full(n, -1, np.int64)
    depth[seeds] = 0
    front, d = np.unique(seeds), 0
    while len(front) and (max_depth is None or d < max_depth):
        d += 1
        reached = links.out(front)[1]
        front = np.unique(reached[depth[reached] < 0])
        depth[front] = d
    return depth


def reach(links: Links, n: int, first: int, last: int) -> np.ndarray:
    """How many other nodes each of first .. last - 1 reaches, 64 times `words` of them at once, a bit for each.

    A step passes on only the bits that are new at a node, so cycles end. Memory is bounded by the graph, whatever the pairs.
    """
    words = max(1, min(16, (1 << 24) // max(n, len(links.target), 1)))
    seen = np.zeros((n, words), np.uint64)
    counts = np.zeros(last - first, np.int64)
    for at in range(first, last, 64 * words):
        front = np.arange(at, min(at + 64 * words, last))
        new = np.zeros((len(front), words), np.uint64)
        bit = np.arange(len(front))
        new[bit, bit // 64] = np.uint64(1) << (bit % 64).astype(np.uint64)
        seen[front] = new
        touched = [front]
        while True:
            place, target = links.out(front)
            if not len(place):
                break
            order = np.argsort(target, kind="stable")
            target = target[order]
            starts = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
            front, came = target[starts], np.bitwise_or.reduceat(new[place[order]], starts, axis=0)
            old = seen[front]
            new = came & ~old
            kept = new.any(axis=1)
            front, new, old = front[kept], new[kept], old[kept]
            touched.append(front[~old.any(axis=1)])
            seen[front] = old | new
        nodes = np.concatenate(touched)
        for i in range(0, len(nodes), 1 << 14):
            bits = np.unpackbits(seen[nodes[i : i + (1 << 14)]].view(np.uint8), axis=1, bitorder="little")
            counts[at - first : at - first + 64 * words] += bits.sum(axis=0, dtype=np.int64)[: last - at]
        seen[nodes] = 0
    return counts - 1


def dense(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """monotonically_increasing_id's numbers without the gaps between partitions, and the first of each partition."""
    sizes = np.zeros(1 + max((int(c.max()) >> 33 for c in columns if len(c)), default=0), np.int64)
    for c in columns:
        np.maximum.at(sizes, c >> 33, (c & _ROW) + 1)
    first = np.r_[0, np.cumsum(sizes)]
    return [first[c >> 33] + (c & _ROW) for c in columns], first


def sparse(numbers: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What dense() made numbers of."""
    part = np.searchsorted(first, numbers, side="right") - 1
    return (part << 33) + numbers - first[part]


def least(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component, edges taken both ways: roots hook onto lesser roots, edges shrink to roots."""
    label = np.arange(n)
    while True:
        a, b = label[a], label[b]
        apart = a != b
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, y) of each node and the least of its component among a task's edges; what is held is reduced as it grows."""
    xs, ys, rows, null = [], [], 0, False
    kind = pa.string()

    def reduced() -> tuple[pa.Array, pa.Array]:
        names, (a, b) = numbered(xs, ys)
        return names, names.take(pa.array(least(a, b, len(names))))

    def sent(x: pa.Array, y: pa.Array) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(x), 100_000):
            yield pa.record_batch([x[i : i + 100_000].cast(kind), y[i : i + 100_000].cast(kind)], ["x", "y"])

    for batch in batches:
        x, y = batch.column(0), batch.column(1)
        if x.null_count or y.null_count:
            null = True
            x, y = pc.coalesce(x, y), pc.coalesce(y, x)
            x, y = x.drop_null(), y.drop_null()
        xs.append(x)
        ys.append(y)
        rows += len(x)
        if rows >= HELD:
            x, y = reduced()
            xs, ys, rows = [x], [y], len(x)
            if rows > HELD // 2:
                yield from sent(x, y)
                xs, ys, rows = [], [], 0
    if rows:
        yield from sent(*reduced())
    if null:
        yield pa.record_batch([pa.array([None], kind), pa.array([None], kind)], ["x", "y"])


def cyclic(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes on cycles of two nodes or more, and the least node of each one's strong component.

    Edges from nodes without edges in, and to nodes without edges out, are cut while a round cuts a tenth; then Tarjan's search.
    """
    names, before = np.arange(n), None
    while before is None or len(a) < 0.9 * before:
        before = len(a)
        has_in, has_out = np.zeros(n, bool), np.zeros(n, bool)
        has_in[b] = has_out[a] = True
        kept = has_in[a] & has_out[b]
        a, b = a[kept], b[kept]
        if 4 * len(a) < n:  # so that later rounds cost what is left
            left, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
            names, n, a, b = names[left], len(left), codes[: len(a)], codes[len(a) :]
    links = Links(a, b, n)
    start, end, target = links.start.tolist(), (links.start + links.degree).tolist(), links.target.tolist()
    number, low, component, stack, count = [-1] * n, [0] * n, [-1] * n, [], 0
    for root in range(n):
        if number[root] >= 0:
            continue
        path = [root]
        number[root] = low[root] = count
        count += 1
        stack.append(root)
        while path:
            v = path[-1]
            if start[v] < end[v]:
                w = target[start[v]]
                start[v] += 1
                if number[w] < 0:
                    number[w] = low[w] = count
                    count += 1
                    stack.append(w)
                    path.append(w)
                elif component[w] < 0:
                    low[v] = min(low[v], number[w])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == number[v]:
                members = []
                while not members or members[-1] != v:
                    members.append(stack.pop())
                name = min(members)
                for w in members:
                    component[w] = name
    component = np.array(component, np.int64)
    nodes = np.flatnonzero(np.bincount(component, minlength=n)[component] > 1)
    return names[nodes], names[component[nodes]]
