"""Triangles of a large graph in bounded memory: blocks of nodes, their edges in one task, and all wedges streamed past them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges that a task holds, edges packed at a time, wedges looked up at a time; blocks of nodes at least.
HELD, PACKED, WEDGES, BLOCKS = 8_000_000, 1_000_000, 4_000_000, 8
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray, bits: int) -> np.ndarray:
    """The upper bits of a multiplicative hash."""
    return (x.astype(np.uint64) * _MIX) >> np.uint64(64 - bits)


def block_of(v: np.ndarray, blocks: int) -> np.ndarray:
    return (mixed(v, 31) % np.uint64(blocks)).astype(np.int64)


def packed(*arrays: np.ndarray) -> bytes:
    """Integer arrays as bytes: differences, compressed; sizes first."""
    flat = np.concatenate([np.array([len(arrays), *map(len, arrays)], np.int64), *[np.diff(a.astype(np.int64), prepend=0) for a in arrays]])
    return np.int64(flat.nbytes).tobytes() + pa.compress(flat.tobytes(), codec="zstd", asbytes=True)


def unpacked(b: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(b, np.int64, 1)[0])
    flat = np.frombuffer(pa.decompress(b[8:], decompressed_size=n, codec="zstd", asbytes=True), np.int64)
    k = int(flat[0])
    cuts = 1 + k + np.cumsum(flat[1 : 1 + k])
    return [np.cumsum(x) for x in np.split(flat[1 + k :], cuts[:-1] - 1 - k)]


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[np.ndarray]]:
    """Rows in arrays of about so many, sorted by the first column and cut only where it changes."""
    kept: list[list[np.ndarray]] = []
    n = 0
    for b in batches:
        if b.num_rows:
            kept.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            n += b.num_rows
        if n >= size:
            whole = [np.concatenate(x) for x in zip(*kept, strict=True)]
            cut = int(np.searchsorted(whole[0], whole[0][-1]))
            if cut:
                yield [x[:cut] for x in whole]
            kept = [[x[cut:] for x in whole]]
            n = (n - cut) if cut else 0  # a node of more edges is read on
    if kept:
        yield [np.concatenate(x) for x in zip(*kept, strict=True)]


def _dealt(blocks: int):
    """Packs edges (u, v by u): for a task (j, k) the edges between its blocks, and beside them the edges into either block, by u."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u, v in chunks(batches, PACKED):
            bu, bv = block_of(u, blocks), block_of(v, blocks)
            ids, at = np.unique(u, return_inverse=True)
            into = [(at[bv == j], v[bv == j]) for j in range(blocks)]
            low, high = np.minimum(bu, bv), np.maximum(bu, bv)
            for j in range(blocks):
                for k in range(j, blocks):
                    task, rows = j * blocks + k, []
                    between = (low == j) & (high == k)
                    if between.any():
                        a, b = u[between], v[between]
                        swap = (a > b) if j == k else (bu[between] != j)
                        a, b = np.where(swap, b, a), np.where(swap, a, b)
                        o = np.lexsort((b, a))
                        rows.append((task, 0, packed(a[o], b[o])))
                    if len(into[j][0]) and len(into[k][0]):
                        # Only nodes with edges into both blocks have wedges here.
                        both = np.zeros(len(ids), bool)
                        both[np.intersect1d(into[j][0], into[k][0])] = True
                        if both.any():
                            new = np.cumsum(both) - 1
                            parts = [x for i in ((j,) if j == k else (j, k)) for x in (new[into[i][0][both[into[i][0]]]], into[i][1][both[into[i][0]]])]
                            rows.append((task, 1, packed(ids[both], *parts)))
                    for row in rows:
                        yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), pa.array([row[1]], pa.int32()), pa.array([row[2]], pa.binary())], names=["task", "kind", "data"])

    return run


class _Held:
    """A task's edges, and counts of triangles over their ends."""

    def __init__(self, parts: list[list[np.ndarray]], same: bool):
        a, b = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in (0, 1))
        self.same, self.a, self.b = same, np.unique(a), np.unique(b)
        self.keys = np.searchsorted(self.a, a) * len(self.b) + np.searchsorted(self.b, b)
        self.keys.sort()
        self.bits = min(26, max(10, int(len(self.keys)).bit_length() + 3))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[mixed(self.keys, self.bits)] = True
        self.at_a, self.at_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)

    @staticmethod
    def _known(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(ids, x), len(ids) - 1)
        hit = ids[at] == x
        return at[hit], hit

    def counted(self, ids: np.ndarray, u1: np.ndarray, v1: np.ndarray, u2: np.ndarray, v2: np.ndarray) -> np.ndarray:
        """Closed wedges of each u of ids; those of the other two corners are added up here."""
        out = np.zeros(len(ids), np.int64)
        if not len(self.keys):
            return out
        if self.same:  # pairs of a list, the lesser first
            o = np.lexsort((v1, u1))
            u1 = u2 = u1[o]
            v1 = v2 = v1[o]
        (a, hit1), (b, hit2) = self._known(self.a, v1), self._known(self.b, v2)
        where, u1, u2 = np.flatnonzero(hit1), u1[hit1], u2[hit2]
        end = np.searchsorted(u2, u1, "right")
        # Of one list only what stands behind an entry.
        start = np.searchsorted(np.flatnonzero(hit2), where, "right") if self.same else np.searchsorted(u2, u1)
        n = np.maximum(end - start, 0)
        upto = np.cumsum(n)
        lo = 0
        while lo < len(n):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + WEDGES, "right")))
            reps = n[lo:hi]
            first = np.repeat(np.arange(lo, hi), reps)
            second = np.arange(len(first)) - np.repeat(np.cumsum(reps) - reps, reps) + start[first]
            key = a[first] * len(self.b) + b[second]
            may = np.flatnonzero(self.seen[mixed(key, self.bits)])
            key = key[may]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            closed = may[self.keys[at] == key]
            np.add.at(out, u1[first[closed]], 1)
            np.add.at(self.at_a, a[first[closed]], 1)
            np.add.at(self.at_b, b[second[closed]], 1)
            lo = hi
        return out


def _counted(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids[n > 0], pa.int64()), pa.array(n[n > 0], pa.int64())], names=["a", "t"])

        task, parts, held = None, [], None
        for batch in batches:
            for t, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if t != task:
                    if held is not None:
                        yield rows(held.a, held.at_a)
                        yield rows(held.b, held.at_b)
                    task, parts, held = t, [], None
                if kind == 0:
                    parts.append(unpacked(data))
                    continue
                if held is None:
                    held, parts = _Held(parts, t // blocks == t % blocks), []
                ids, *x = unpacked(data)
                yield rows(ids, held.counted(ids, *(x if len(x) == 4 else x + x)))
        if held is not None:
            yield rows(held.a, held.at_a)
            yield rows(held.b, held.at_b)

    return run


def triangles(out: DataFrame, edges: int) -> DataFrame:
    """a, t: how many triangles each node is in. out: every edge (u, v) once, so directed that no cycle arises; edges: about how many.

    A wedge at u with its ends in blocks j and k is looked up in the task that holds all edges between these: each edge is packed once for each block, and no wedge is shuffled.
    """
    blocks = max(BLOCKS, int(np.ceil(np.sqrt(2 * edges / HELD))))
    dealt = out.select(F.col("u").cast("long"), F.col("v").cast("long")).repartition("u").sortWithinPartitions("u", "v").mapInArrow(_dealt(blocks), "task int, kind int, data binary")
    # A partition a task: j <= k as a dense number.
    j, k = F.floor(F.col("task") / blocks), F.col("task") % blocks
    place = (j * blocks - j * (j - 1) / 2 + k - j).cast("int")
    tasks = dealt.repartitionById(blocks * (blocks + 1) // 2, place).sortWithinPartitions("task", "kind")
    return tasks.mapInArrow(_counted(blocks), "a long, t long").groupBy("a").agg(F.sum("t").alias("t"))
