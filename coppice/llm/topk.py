"""Exact top-k inner-product search by multi-resolution segment statistics (operator 2).

A vector's segments are known by their means and deviations. Over a segment of m
components, by the inequality of Cauchy and Schwarz,

    q . c <= m * mean(q) * mean(c) + m * dev(q) * dev(c),

so the sum over segments is an upper bound of the inner product, which is the same as a
lower bound of the distance |q|^2 + |c|^2 - 2 q . c. Bounds are products of short vectors
of statistics, one number each for a segment's mean and deviation. They are taken coarse
to fine: what a level can't rule out against the k-th best score found so far goes to the
next, and only survivors are compared component by component. Where a level rules out too
little to be worth its time (it does over vectors of noise), it is left out and tried
again every PROBE tiles. Results don't depend on that.

Whole numbers whose products stay below 2**24 (2**53) in magnitude are multiplied exactly
by the matrix product of 32-bit (64-bit) floats; larger ones go by a 64-bit product with a
margin for its rounding, and what that leaves by whole numbers of any size.

Queries are dealt in blocks of HELD components and vectors in parts of VECTORS rows; a
task holds one block and streams a part past it by vec_id, so that its memory doesn't
depend on the table and a later candidate must have a greater score. Each pair of block
and part sends k rows a query on; these are ranked by a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow import cut

HELD, VECTORS, TILE = 1 << 24, 1 << 18, 1024
#: Components in a segment, level by level.
LEVELS = (16, 4)
#: Tiles from one try of the bounds to the next; what a pair on its own costs, in pairs of a matrix product.
PROBE, PAIR = 64, 32
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def whole(vector: str = "embedding", scale: int = 256):
    """The vector as whole numbers floor(scale * x); null where it is null or holds a null or non-finite component."""
    x = F.transform(F.col(vector), lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("long"))
    bad = F.exists(F.col(vector), lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    return F.when(~bad, x)


def statistics(rows: np.ndarray, m: int) -> np.ndarray:
    """sqrt(m) times mean and deviation of each segment of m components; the last may be filled up with zeros."""
    short = -rows.shape[1] % m
    if short:
        rows = np.pad(rows, ((0, 0), (0, short)))
    x = rows.reshape(len(rows), -1, m).astype(np.float64)
    mean = x.mean(axis=2)
    dev = np.sqrt(np.maximum((x * x).mean(axis=2) - mean * mean, 0))
    return np.concatenate([mean, dev], axis=1) * np.sqrt(m)


def _largest(rows: np.ndarray) -> float:
    """The largest length of a row, no less than it is."""
    return max((float(np.sqrt(np.square(rows[k : k + TILE].astype(np.float64)).sum(axis=1).max())) for k in range(0, len(rows), TILE)), default=0.0) * (1 + 1e-9)


class Block:
    """A block of queries and the k best candidates of each so far. Candidates come by their ids, those without one last."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, keys: np.ndarray, k: int):
        self.ids, self.rows, self.keys, self.k = ids, rows, keys, k
        n = len(ids)
        self.score = np.full((n, k), _LOW, np.int64)
        self.vec = np.zeros((n, k), np.int64)
        self.none = np.zeros((n, k), bool)  # candidates without an id
        self.found = np.zeros((n, k), bool)
        self.least = np.full(n, -np.inf)  # the k-th best score, which a candidate must exceed; -inf until k are found
        self.length = _largest(rows)
        self.stats = [np.concatenate([statistics(rows[x : x + TILE], m).astype(np.float32) for x in range(0, n, TILE)]) if n else np.zeros((0, 0), np.float32) for m in LEVELS]
        self.pays, self.turn = [True] * len(LEVELS), 0

    def meet(self, ids: np.ndarray, none: np.ndarray, rows: np.ndarray, keys: np.ndarray) -> None:
        most = self.length * _largest(rows)
        for k in range(0, len(rows), TILE):
            x = slice(k, k + TILE)
            self._meet(ids[x], none[x], rows[x], keys[x], most)

    def _meet(self, ids: np.ndarray, none: np.ndarray, rows: np.ndarray, keys: np.ndarray, most: float) -> None:
        width = min(self.rows.shape[1], rows.shape[1])  # what a shorter one lacks counts as zeros
        kind, exact = np.float32 if most < 1 << 24 else np.float64, most < 1 << 53
        slack = 0.0 if exact else (width + 8) * 2.0**-52 * most
        rows = rows[:, :width]
        other = rows.astype(kind)
        stats: list[np.ndarray | None] = [None] * len(LEVELS)
        for k in range(0, len(self.ids), TILE):
            x = slice(k, k + TILE)
            mine, least = self.rows[x, :width].astype(kind), self.least[x]
            qs, cs = np.arange(len(mine)), np.arange(len(other))
            pairs, probe = False, False
            if exact and len(qs) and least.min() > -np.inf:
                probe, self.turn = self.turn % PROBE == 0, self.turn + 1
                for level, m in enumerate(LEVELS):
                    if not (probe or self.pays[level]):
                        continue
                    if stats[level] is None:
                        stats[level] = statistics(rows, m).astype(np.float32)
                    a, b = self.stats[level][x], stats[level]
                    w = min(a.shape[1], b.shape[1]) // 2
                    if a.shape[1] != b.shape[1]:  # means and deviations of the segments that both have
                        a, b = (np.concatenate([y[:, :w], y[:, y.shape[1] // 2 :][:, :w]], axis=1) for y in (a, b))
                    floor = least - (2 * w + 8) * 2.0**-23 * most  # a margin for the rounding of bounds
                    if pairs:
                        keep = np.einsum("ij,ij->i", a[qs], b[cs]) > floor[qs]
                        qs, cs = qs[keep], cs[keep]
                        continue
                    may = a[qs] @ b[cs].T > floor[qs].astype(np.float32)[:, None]
                    n, some_q, some_c = np.count_nonzero(may), may.any(axis=1), may.any(axis=0)
                    area = np.count_nonzero(some_q) * np.count_nonzero(some_c)
                    self.pays[level] = 4 * min(area, PAIR * n) < may.size
                    if PAIR * n < area:
                        q, c = np.nonzero(may)
                        qs, cs, pairs = qs[q], cs[c], True
                    else:
                        qs, cs = qs[some_q], cs[some_c]
            if not len(qs) or not len(cs):
                continue
            if pairs:
                step = max(1, (1 << 22) // max(1, width))
                score = np.concatenate([np.einsum("ij,ij->i", mine[qs[y : y + step]], other[cs[y : y + step]]) for y in range(0, len(qs), step)])
                hit = score > least[qs]
                q, c, score = qs[hit], cs[hit], score[hit]
            else:
                whole = len(qs) == len(mine), len(cs) == len(other)
                got = (mine if whole[0] else mine[qs]) @ (other if whole[1] else other[cs]).T
                if not exact:  # as scores are held
                    got = np.clip(got, float(_LOW), float(_HIGH))
                hit = got > (least[qs] - slack).astype(kind)[:, None]
                if len(cs) > self.k + 1 and np.count_nonzero(hit) > 8 * self.k * len(qs):  # the query itself is one of these
                    hit &= got >= (np.partition(got, -self.k - 1, axis=1)[:, -self.k - 1] - kind(2 * slack))[:, None]
                at = np.flatnonzero(hit)
                q, c = np.divmod(at, len(cs))
                q, c, score = qs[q], cs[c], got.ravel()[at]
            q = q + k
            own = self.keys[q] != keys[c]
            q, c, score = q[own], c[own], score[own]
            if len(q):
                score = score.astype(np.int64) if exact else self._exact(q, rows, c)
                self._add(q, score, ids[c], none[c])

    def _exact(self, q: np.ndarray, rows: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Whole numbers of any size, held within 64 bits at the end."""
        a, b = {}, {}
        for i in np.unique(q).tolist():
            a[i] = self.rows[i, : rows.shape[1]].astype(object)
        for j in np.unique(c).tolist():
            b[j] = rows[j].astype(object)
        return np.array([min(max(int((a[i] * b[j]).sum()), _LOW + 1), _HIGH) for i, j in zip(q.tolist(), c.tolist(), strict=True)], np.int64)

    def _add(self, q: np.ndarray, score: np.ndarray, vec: np.ndarray, none: np.ndarray) -> None:
        keep = ~self.found[q, -1] | (score > self.score[q, -1])
        q, score, vec, none = q[keep], score[keep], vec[keep], none[keep]
        if not len(q):
            return
        who = np.unique(q)
        old = self.found[who]
        qs = np.concatenate([np.repeat(who, self.k)[old.ravel()], q])
        ss = np.concatenate([self.score[who][old], score])
        vs = np.concatenate([self.vec[who][old], vec])
        ns = np.concatenate([self.none[who][old], none])
        order = np.lexsort((~ss, qs))  # stable: what came first has the smaller id
        qs, ss, vs, ns = qs[order], ss[order], vs[order], ns[order]
        start = np.r_[True, qs[1:] != qs[:-1]]
        rank = np.arange(len(qs)) - np.maximum.accumulate(np.where(start, np.arange(len(qs)), 0))
        top = rank < self.k
        qs, ss, vs, ns, rank = qs[top], ss[top], vs[top], ns[top], rank[top]
        self.found[who] = False
        self.score[qs, rank], self.vec[qs, rank], self.none[qs, rank], self.found[qs, rank] = ss, vs, ns, True
        last = self.score[who, -1]
        self.least[who] = np.where(self.found[who, -1], np.where(last == _HIGH, np.inf, last.astype(np.float64)), -np.inf)

    def best(self) -> pa.RecordBatch:
        q, k = np.nonzero(self.found)
        return pa.RecordBatch.from_arrays([pa.array(self.keys[q]), pa.array(self.ids[q]), pa.array(self.vec[q, k], mask=self.none[q, k]), pa.array(self.score[q, k])], ["key", "query_id", "vec_id", "score"])


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of whole numbers, filled up with zeros to the longest."""
    n = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(n) and (n == n[0]).all():
        return flat.reshape(len(n), n[0])
    out = np.zeros((len(n), int(n.max(initial=0))), flat.dtype)
    out[np.repeat(np.arange(len(n)), n), np.concatenate([np.arange(x) for x in n]) if len(n) else []] = flat
    return out


def cells(n: int, asked: int, width: int, tasks: int) -> tuple[int, int]:
    """Blocks of queries and parts of vectors: n * blocks + asked * parts rows are moved, blocks * parts tasks run, in full rounds of `tasks`."""
    return max(1, -(-asked * max(1, width) // HELD)), tasks * max(1, -(-n // (tasks * VECTORS)))


def search(spark: SparkSession, vectors: DataFrame, queries: str, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best candidates of each row that fulfils the SQL condition `queries` on vec_id.

    Candidates are all rows but the query's own; ties go to the smaller vec_id, a null id last. Vectors that are null or hold null or non-finite components
    take no part. Shorter vectors count as filled up with zeros, an empty one as zeros. A repeated row is a candidate of its twin, and each is a query.
    Scores beyond 64 bits are held at their ends. An empty table gives no rows; other columns are not read.
    """
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), F.col(vector).alias("embedding"))
    rows = rows.select("vec_id", whole("embedding", scale).alias("v")).where("v is not null").withColumn("key", F.monotonically_increasing_id())
    rows = cut(spark, rows)
    asks = F.coalesce(F.expr(queries), F.lit(False))
    n, nq, width, low, high = rows.agg(F.count("*"), F.count_if(asks), F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    blocks, parts = cells(n, nq, width or 0, spark.sparkContext.defaultParallelism)
    kind = next((t for t, bits in (("short", 15), ("int", 31)) if -(1 << bits) <= (low or 0) and (high or 0) < 1 << bits), "long")
    rows = rows.select("key", "vec_id", F.col("v").cast(f"array<{kind}>").alias("v"), asks.alias("asks"))
    spread = lambda m, seed: F.pmod(F.xxhash64(F.col("key"), F.lit(seed)), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    held = rows.where("asks").select(spread(blocks, 1).alias("block"), every(parts).alias("part"), F.lit(0).alias("kind"), "key", "vec_id", "v")
    met = rows.select(every(blocks).alias("block"), spread(parts, 2).alias("part"), F.lit(1).alias("kind"), "key", "vec_id", "v")
    # Each block and part is a task; its queries come first, then its vectors by their ids.
    dealt = held.unionByName(met).select((F.col("block") * parts + F.col("part")).alias("cell"), "kind", "key", "vec_id", "v")
    dealt = dealt.repartitionById(blocks * parts, "cell").sortWithinPartitions("cell", "kind", F.asc_nulls_last("vec_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, waiting = None, None, []

        def made() -> Block:
            rows = _matrix(pa.concat_arrays([x.column(4) for x in waiting]))
            ids, keys = (np.concatenate([x.column(c).to_numpy(zero_copy_only=False) for x in waiting]) for c in (3, 2))
            return Block(ids, rows, keys, k)

        for batch in batches:
            at = 0
            which, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            while at < batch.num_rows:
                same = (which[at:] == which[at]) & (kinds[at:] == kinds[at])
                end = at + (int(same.argmin()) if not same.all() else len(same))
                if which[at] != now:
                    if block:
                        yield block.best()
                    now, block, waiting = which[at], None, []
                if kinds[at] == 0:
                    waiting.append(batch.slice(at, end - at))
                elif waiting or block:
                    if block is None:
                        block, waiting = made(), []
                    part = batch.slice(at, end - at)
                    ids, none = part.column(3).fill_null(0).to_numpy(), part.column(3).is_null().to_numpy(zero_copy_only=False)
                    block.meet(ids, none, _matrix(part.column(4)), part.column(2).to_numpy())
                at = end
        if block:
            yield block.best()

    found = dealt.mapInArrow(run, "key long, query_id long, vec_id long, score long")
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
