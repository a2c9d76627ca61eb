"""All pairs of query vectors and rows, in tiles of matrices: each dimension is added in its turn, so that a sum is that of a fold over the dimensions, bit by bit."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries that a task holds, rows packed together, pairs of a tile.
QUERIES, ROWS, TILE = 8192, 1024, 1 << 15
#: Stands for null among ids and labels.
NULL = np.iinfo(np.int64).min


@dataclass
class Block:
    """Vectors by dimension; gaps: nulls inside and what is missing at the end, 0 in e; there: not null; whole: without nulls inside."""

    id: np.ndarray
    label: np.ndarray
    e: np.ndarray
    gaps: np.ndarray
    size: np.ndarray
    there: np.ndarray
    whole: np.ndarray


def block(batches: list[pa.RecordBatch]) -> Block:
    """Of columns id, label, vector."""
    t = pa.Table.from_batches(batches)
    number = lambda c: np.asarray(t.column(c).cast(pa.int64()).fill_null(int(NULL)))
    v = t.column(2).combine_chunks()
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    there = ~np.asarray(v.is_null())
    size = np.asarray(v.value_lengths().fill_null(0)).astype(np.int64)
    flat = v.flatten()
    dims = int(size.max(initial=0))
    e, gaps = np.zeros((len(size), dims)), np.ones((len(size), dims), bool)
    at = np.arange(dims)[None, :] < size[:, None]
    e[at] = np.asarray(flat.cast(pa.float64()).fill_null(0.0))
    gaps[at] = np.asarray(flat.is_null())
    return Block(number(0), number(1), np.ascontiguousarray(e.T), np.ascontiguousarray(gaps.T), size, there, there & (gaps.sum(axis=1) == dims - size))


def joined(blocks: list[Block]) -> Block:
    dims = max(b.e.shape[0] for b in blocks)
    wide = lambda x: np.pad(x, ((0, dims - x.shape[0]), (0, 0)), constant_values=x.dtype == bool)
    return Block(*(np.concatenate([getattr(b, c) for b in blocks]) for c in ("id", "label")), *(np.concatenate([wide(getattr(b, c)) for b in blocks], axis=1) for c in ("e", "gaps")), *(np.concatenate([getattr(b, c) for b in blocks]) for c in ("size", "there", "whole")))


def _steps(q: Block, t: Block) -> Iterator[slice]:
    step = max(1, TILE // max(1, len(t.id)))
    for lo in range(0, len(q.id), step):
        yield slice(lo, min(lo + step, len(q.id)))


def _folded(q: Block, t: Block, part: Callable) -> Iterator[tuple[slice, np.ndarray]]:
    """Tiles of q: sums over the dimensions, to which gaps add nothing."""
    dims = min(q.e.shape[0], t.e.shape[0])
    for s in _steps(q, t):
        acc = np.zeros((s.stop - s.start, len(t.id)))
        x = np.empty_like(acc)
        for d in range(dims):
            part(q.e[d, s, None], t.e[d, None], x)
            _hole(x, q, t, s, d)
            acc += x
        yield s, acc


def _hole(x: np.ndarray, q: Block, t: Block, s: slice, d: int) -> None:
    a, b = q.gaps[d, s], t.gaps[d]
    if a.any():
        x[a] = 0
    if b.any():
        x[:, b] = 0


def _short(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> None:
    np.subtract(a, b, out=x)
    np.maximum(x, 0.0, out=x)
    np.multiply(x, x, out=x)


def _square(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> None:
    np.subtract(a, b, out=x)
    np.multiply(x, x, out=x)


def violations(q: Block, t: Block) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Sum of max(0, q - t)^2, and where there is one: greatest passes over nulls."""
    for s, x in _folded(q, t, _short):
        yield s, x, q.there[s, None] & t.there[None]


def distances(q: Block, t: Block) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Sum of (q - t)^2, and where there is one: of whole vectors of a size."""
    for s, x in _folded(q, t, _square):
        yield s, x, q.whole[s, None] & t.whole[None] & (q.size[s, None] == t.size[None])


def greater(q: Block, t: Block) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """In how many dimensions q is greater; NaN is greater than all else, null than nothing."""
    dims = min(q.e.shape[0], t.e.shape[0])
    for s in _steps(q, t):
        acc = np.zeros((s.stop - s.start, len(t.id)), np.int16 if dims < 1 << 15 else np.int64)
        for d in range(dims):
            a, b = q.e[d, s, None], t.e[d, None]
            more = a > b
            if np.isnan(a).any():
                more |= np.isnan(a) & ~np.isnan(b)
            _hole(more, q, t, s, d)
            acc += more
        yield s, acc, q.there[s, None] & t.there[None]


def batch(schema: pa.Schema, *columns: np.ndarray) -> pa.RecordBatch:
    """Of arrays in which NULL and masked entries are null."""
    made = []
    for c, f in zip(columns, schema, strict=True):
        values, null = c if isinstance(c, tuple) else (c, c == NULL if c.dtype == np.int64 else None)
        made.append(pa.array(values, mask=null, from_pandas=False).cast(f.type))
    return pa.RecordBatch.from_arrays(made, schema=schema)


class Pairs:
    """What a task does with its queries and each block of rows; subclasses keep sums."""

    def __init__(self, schema: pa.Schema):
        self.schema = schema

    def rows(self, q: Block, t: Block) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def end(self, q: Block) -> Iterator[pa.RecordBatch]:
        return iter(())


def rounded(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """To so many digits, halves away from zero by the shortest decimal, as in SQL; only what is near a half is taken as a decimal."""
    size = np.abs(x) * 10**digits
    with np.errstate(invalid="ignore"):
        low = np.floor(size)
        out = np.copysign(np.floor(size + 0.5) / 10**digits, x) + 0.0
        out = np.where(size < 1 << 60, out, x)  # beyond, and where there is no number, there are no more digits
        near = np.flatnonzero((size < 1 << 60) & ((size > 1 << 45) | (np.abs(size - low - 0.5) <= 1e-6 + size * 1e-14)))
    for k in near:
        out[k] = float(Decimal(repr(float(x[k]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) + 0.0
    return out


def log_rounded(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return rounded(np.log(x + 1e-7))


class Matrix(Pairs):
    """Every pair and what is shown of its value, null where there is none."""

    def __init__(self, schema: pa.Schema, values: Callable, shown: Callable):
        super().__init__(schema)
        self.values, self.shown = values, shown

    def rows(self, q, t):
        for s, x, ok in self.values(q, t):
            n = s.stop - s.start
            yield batch(self.schema, np.repeat(q.id[s], len(t.id)), np.tile(t.id, n), (self.shown(x.ravel()), ~ok.ravel()))


class PerQuery(Pairs):
    """Sums over the rows of other ids, one row a query and task; queries without such rows have none."""

    def __init__(self, schema: pa.Schema, values: Callable, start: tuple, add: Callable):
        super().__init__(schema)
        self.values, self.start, self.add, self.kept = values, start, add, None

    def rows(self, q, t):
        if self.kept is None:
            self.kept, self.pairs = [np.full(len(q.id), x) for x in self.start], np.zeros(len(q.id), bool)
        for s, x, ok in self.values(q, t):
            other = (q.id[s, None] != t.id[None]) & (q.id[s, None] != NULL) & (t.id[None] != NULL)
            self.pairs[s] |= other.any(axis=1)
            for kept, new in zip(self.kept, self.add(q, t, s, x, ok & other, other, [k[s] for k in self.kept]), strict=True):
                kept[s] = new
        return iter(())

    def end(self, q):
        if self.kept is not None:
            yield batch(self.schema, q.id[self.pairs], *[k[self.pairs] for k in self.kept])


class PerLabel(Pairs):
    """Of each label's queries and each row: whether all values of pairs that have one are at most so much; null where no pair has one."""

    def __init__(self, schema: pa.Schema, values: Callable, most: float):
        super().__init__(schema)
        self.values, self.most = values, most

    def rows(self, q, t):
        labels, at = np.unique(q.label, return_inverse=True)
        bad, any_ = np.zeros((len(labels), len(t.id)), bool), np.zeros((len(labels), len(t.id)), bool)
        for s, x, ok in self.values(q, t):
            np.logical_or.at(bad, at[s], ok & ~(x <= self.most))
            np.logical_or.at(any_, at[s], ok)
        yield batch(self.schema, np.repeat(labels, len(t.id)), np.tile(t.id, len(labels)), (~bad.ravel(), ~any_.ravel()))


def _packed(kind: int, places: Callable):
    """Blocks of rows as bytes, each in so many places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId() * 7919, 0

        def made(kept: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal n
            whole = pa.Table.from_batches(kept).combine_chunks()
            for lo in range(0, whole.num_rows, ROWS):
                cut = whole.slice(lo, ROWS)
                data = pickle.dumps(block(cut.to_batches()), protocol=5)
                at = list(places(task + n))
                n += 1
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([kind] * len(at), pa.int32()), pa.array([data] * len(at), pa.binary())], names=["place", "kind", "data"])

        kept, size = [], 0
        for b in batches:
            if b.num_rows:
                kept.append(b)
                size += b.num_rows
            if size >= ROWS:
                yield from made(kept)
                kept, size = [], 0
        if kept:
            yield from made(kept)

    return run


def _met(pairs: Pairs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, q = [], None
        for b in batches:
            for kind, data in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                got = pickle.loads(data.as_buffer())
                if kind == 0:
                    mine.append(got)
                elif mine or q is not None:
                    if q is None:
                        q, mine = joined(mine), []
                    yield from pairs.rows(q, got)
        if q is not None:
            yield from pairs.end(q)

    return run


def over_pairs(queries: DataFrame, rows: DataFrame, pairs: Pairs, schema: str) -> DataFrame:
    """What pairs makes of every query and every row (id, label, vector). Rows are moved once for each QUERIES queries, queries once for each part of the rows."""
    blocks = max(1, -(-queries.count() // QUERIES))
    parts = 3 * rows.sparkSession.sparkContext.defaultParallelism
    q = queries.mapInArrow(_packed(0, lambda n: [n % blocks * parts + p for p in range(parts)]), "place int, kind int, data binary")
    t = rows.mapInArrow(_packed(1, lambda n: [b * parts + n % parts for b in range(blocks)]), "place int, kind int, data binary")
    return q.unionByName(t).repartitionById(blocks * parts, F.col("place")).sortWithinPartitions("kind").mapInArrow(_met(pairs), schema)


__all__ = ["Block", "Matrix", "PerLabel", "PerQuery", "distances", "greater", "log_rounded", "over_pairs", "rounded", "violations"]
