"""Whole programs in batches: what a forest's queries make of neighbourhoods, in arrays over many programs at once.

Programs come sorted, and are put together from the batches that they are spread over; a program is handled by one task, in one piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tiles import NULL, batch

#: Rows of programs taken together, buckets of an encoding.
CHUNK, BUCKETS = 400_000, 64
NODE, EDGE = 1, 2


def rows_of(nodes: DataFrame | None, edges: DataFrame) -> DataFrame:
    """prog, kind, node, parent, type, span: a node's row, and an edge's (parent to node)."""
    none = F.lit(None).cast("string")
    e = edges.select("prog", F.lit(EDGE).alias("kind"), F.col("dst").alias("node"), F.col("src").alias("parent"), none.alias("type"), none.alias("span"))
    return e if nodes is None else nodes.select("prog", F.lit(NODE).alias("kind"), "node", F.lit(None).cast("long").alias("parent"), "type", "span").unionByName(e)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns in arrays of whole programs, nulls among numbers as NULL, texts as objects."""

    def arrays(kept: list[pa.RecordBatch]) -> list[np.ndarray]:
        t = pa.Table.from_batches(kept)
        return [np.asarray(c.cast(pa.int64()).fill_null(int(NULL))) if pa.types.is_integer(c.type) else c.to_pandas().to_numpy(object) for c in t.columns]

    kept: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        kept.append(b)
        n += b.num_rows
        if n >= CHUNK:
            last = b.column(0)[-1]
            if last == kept[0].column(0)[0]:
                continue  # a large program is read on
            whole = pa.Table.from_batches(kept)
            prog = np.asarray(whole.column(0).fill_null(int(NULL)))
            cut = int(np.searchsorted(prog, prog[-1]))
            yield arrays(whole.slice(0, cut).to_batches())
            kept = whole.slice(cut).combine_chunks().to_batches()
            n -= cut
    if kept:
        yield arrays(kept)


def by_program(rows: DataFrame, made: Callable[..., Iterator[tuple]], schema: str, types: pa.Schema) -> DataFrame:
    """What made yields, columns in tuples, from the columns of whole programs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _chunks(batches):
            for out in made(*columns):
                for b in pa.Table.from_batches([out if isinstance(out, pa.RecordBatch) else batch(types, *out)]).to_batches(max_chunksize=50_000):
                    yield b

    return rows.repartition("prog").sortWithinPartitions("prog").mapInArrow(run, schema)


def _starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new group begins."""
    n = len(sorted_columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return new


def _within(groups: np.ndarray) -> np.ndarray:
    """Places from 0 within sorted groups."""
    new = _starts(groups)
    first = np.flatnonzero(new)
    return np.arange(len(groups)) - first[np.cumsum(new) - 1] if len(groups) else np.zeros(0, np.int64)


class _Joined:
    """Rows by a dense key: pairs of places with equal keys."""

    def __init__(self, key: np.ndarray, n: int):
        self.order = np.argsort(key, kind="stable")
        self.ends = np.cumsum(np.bincount(key, minlength=n))

    def with_(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        end = self.ends[key]
        start = np.where(key > 0, self.ends[key - 1], 0)
        reps = end - start
        left = np.repeat(np.arange(len(key)), reps)
        return left, self.order[np.arange(len(left)) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(start, reps)]


class Hoods:
    """Nodes of programs as dense numbers in order of program and id; the anchors of most degree, and the nodes nearest to each along out-edges, ties by id."""

    def __init__(self, prog: np.ndarray, src: np.ndarray, dst: np.ndarray, more: tuple[np.ndarray, np.ndarray] | None, top: int, radius: int, nearest: int):
        n = len(prog)
        p, x = np.concatenate([prog, prog, *(() if more is None else more[:1])]), np.concatenate([src, dst, *(() if more is None else more[1:])])
        o = np.lexsort((x, p))
        new = _starts(p[o], x[o])
        at = np.empty(len(p), np.int64)
        at[o] = np.cumsum(new) - 1
        self.prog, self.node, self.n = p[o][new], x[o][new], int(new.sum())
        self.src, self.dst, self.more = at[:n], at[n : 2 * n], at[2 * n :]
        program = np.cumsum(_starts(self.prog)) - 1
        degree = np.bincount(at[: 2 * n], minlength=self.n)
        ranked = np.lexsort((-degree, program))
        ranked = ranked[degree[ranked] > 0]
        self.anchor = np.sort(ranked[_within(program[ranked]) < top])
        # Nulls are joined with nothing.
        self.kept = np.flatnonzero((prog != NULL) & (src != NULL))
        self.out = _Joined(self.src[self.kept], self.n)
        sets, at_, hop = np.arange(len(self.anchor)), self.anchor, np.zeros(len(self.anchor), np.int64)
        keys, last = sets * self.n + at_, (sets, at_)
        for h in range(1, radius + 1):
            # Sets that are full take nobody from farther away.
            room = np.bincount(keys // max(1, self.n), minlength=len(self.anchor))[last[0]] < nearest
            left, e = self.out.with_(last[1][room])
            new = np.setdiff1d(np.unique(last[0][room][left] * self.n + self.dst[self.kept[e]]), keys, assume_unique=True)
            keys, hop = np.concatenate([keys, new]), np.concatenate([hop, np.full(len(new), h)])
            last = (new // max(1, self.n), new % max(1, self.n))
        o = np.lexsort((keys, hop, keys // max(1, self.n)))
        keys, hop = keys[o], hop[o]
        rank = _within(keys // max(1, self.n)) + 1
        near = rank <= nearest
        #: Members by set, hop and id.
        self.keys, self.hop, self.rank = keys[near], hop[near], rank[near]
        self.set, self.at = self.keys // max(1, self.n), self.keys % max(1, self.n)
        self.sorted = np.argsort(self.keys)

    def members(self, sets: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which member a node of a set is; -1 if none."""
        keys = sets * self.n + at
        found = self.sorted[np.minimum(np.searchsorted(self.keys, keys, sorter=self.sorted), len(self.keys) - 1)] if len(self.keys) else np.zeros(0, np.int64)
        return np.where((self.keys[found] == keys) & (at >= 0), found, -1)

    def inner(self) -> tuple[np.ndarray, np.ndarray]:
        """Members at both ends of each edge within a set; edges of a node to itself are dropped."""
        left, e = self.out.with_(self.at)
        e = self.kept[e]
        ends = self.members(self.set[left], self.dst[e])
        real = (ends >= 0) & (self.src[e] != self.dst[e]) & (self.node[self.dst[e]] != NULL) & (self.node[self.anchor[self.set[left]]] != NULL)
        return left[real], ends[real]

    def named(self, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.prog[self.anchor[sets]], self.node[self.anchor[sets]]


def _hoods(made: Callable[[Hoods], Iterator[tuple]], top: int, radius: int, nearest: int):
    def run(prog, kind, node, parent, *_):
        e = kind & EDGE > 0
        yield from made(Hoods(prog[e], parent[e], node[e], None, top, radius, nearest))

    return run


def _types(**columns: pa.DataType) -> pa.Schema:
    return pa.schema(list(columns.items()))


_LONG, _INT = pa.int64(), pa.int32()


def members(edges: DataFrame, *sizes: int) -> DataFrame:
    """prog, anchor, node, hop, rank."""

    def made(h: Hoods):
        yield *h.named(h.set), h.node[h.at], h.hop, h.rank

    return by_program(rows_of(None, edges), _hoods(made, *sizes), "prog long, anchor long, node long, hop int, rank int", _types(prog=_LONG, anchor=_LONG, node=_LONG, hop=_INT, rank=_INT))


def inner_edges(edges: DataFrame, *sizes: int) -> DataFrame:
    """prog, anchor, src, dst of the edges within each neighbourhood."""

    def made(h: Hoods):
        a, b = h.inner()
        yield *h.named(h.set[a]), h.node[h.at[a]], h.node[h.at[b]]

    return by_program(rows_of(None, edges), _hoods(made, *sizes), "prog long, anchor long, src long, dst long", _types(prog=_LONG, anchor=_LONG, src=_LONG, dst=_LONG))


def roots(edges: DataFrame, *sizes: int) -> DataFrame:
    """prog, anchor, root: the first member that no other leads to."""

    def made(h: Hoods):
        free = np.ones(len(h.keys), bool)
        free[h.inner()[1]] = False
        real = np.sort(h.keys[free & (h.node[h.at] != NULL)])
        sets = real // max(1, h.n)
        first = _starts(sets)
        yield *h.named(sets[first]), h.node[real[first] % max(1, h.n)]

    return by_program(rows_of(None, edges), _hoods(made, *sizes), "prog long, anchor long, root long", _types(prog=_LONG, anchor=_LONG, root=_LONG))


def number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16)


def shapes(edges: DataFrame, *sizes: int, rounds: int = 3) -> DataFrame:
    """size, hash, members, first: neighbourhoods by the hash of the subgraphs that they induce, counted by chunk; colours as in graphs.wl_of_sets."""

    def made(h: Hoods):
        a, b = h.inner()
        c = np.where(h.at == h.anchor[h.set], number("1"), number("0"))
        for _ in range(rounds):
            s = np.zeros(len(c), np.int64)
            np.add.at(s, a, c[b])
            np.add.at(s, b, c[a])
            kinds, kc = np.unique(c, return_inverse=True)
            sums, ks = np.unique(s, return_inverse=True)
            pairs, at = np.unique(kc * len(sums) + ks, return_inverse=True)
            c = np.array([number(f"{kinds[x // len(sums)]}|{sums[x % len(sums)]}") for x in pairs], np.int64)[at]
        size, total = np.bincount(h.set, minlength=len(h.anchor)), np.zeros(len(h.anchor), np.int64)
        np.add.at(total, h.set, c)
        prog = h.prog[h.anchor]
        o = np.lexsort((np.where(prog == NULL, np.iinfo(np.int64).max, prog), total, size))
        first = np.flatnonzero(_starts(size[o], total[o]))
        yield size[o][first], total[o][first], np.diff(np.append(first, len(o))), prog[o][first]

    found = by_program(rows_of(None, edges), _hoods(made, *sizes), "size long, hash long, members long, first long", _types(size=_LONG, hash=_LONG, members=_LONG, first=_LONG))
    return found.groupBy("size", "hash").agg(F.sum("members").alias("members"), F.min("first").alias("first"))


def outlines(edges: DataFrame, *sizes: int) -> DataFrame:
    """prog, anchor, size, hash of the hops, score (direct neighbours), holes (nodes two hops away)."""
    radius = sizes[1]

    def made(h: Hoods):
        n = np.bincount(h.set * (radius + 1) + h.hop, minlength=len(h.anchor) * (radius + 1)).reshape(-1, radius + 1)
        kinds, at = np.unique(n, axis=0, return_inverse=True)
        text = np.array([hashlib.md5(",".join(str(k) for k, m in enumerate(row) for _ in range(m)).encode()).hexdigest() for row in kinds], object)
        of = lambda k: n[:, k] if k <= radius else np.zeros(len(n), np.int64)
        yield h.prog[h.anchor], h.node[h.anchor], n.sum(axis=1), (text[at.ravel()], None), of(1), of(2)

    return by_program(rows_of(None, edges), _hoods(made, *sizes), "prog long, anchor long, size long, hash string, score long, holes long", _types(prog=_LONG, anchor=_LONG, size=_LONG, hash=pa.string(), score=_LONG, holes=_LONG))


def bucket(token: str) -> int:
    return int(hashlib.md5(token.encode()).hexdigest()[:2], 16) % BUCKETS


def _token_buckets(row: tuple, whole: bool) -> list[int]:
    """The buckets of a labelled row's tokens: type, label, edge, edge with spans, 2-path; -1 for none."""
    kind, span, up, up_span, over = (None if pd.isna(x) else x for x in row)
    ws = lambda sep, *parts: sep.join(p for p in parts if p is not None)
    tokens = [kind, ws("|", kind, span), ws(">", up, kind)]
    if whole:
        tokens += [ws(">", ws("|", up, up_span), ws("|", kind, span)), ws(">", over, up, kind)]
    return [-1 if t is None else bucket(t) for t in tokens]


def _phi(h: Hoods, node: np.ndarray, kind: np.ndarray, span: np.ndarray, whole: bool) -> np.ndarray:
    """Counts by bucket of the tokens of each set (plans.search.encode); node: the dense numbers of rows of nodes."""
    codes, kinds = pd.factorize(kind, sort=True)
    spans = pd.factorize(span)
    rows = _Joined(node, h.n)
    real = h.kept[h.node[h.dst[h.kept]] != NULL]
    e, r = rows.with_(h.src[real])  # an edge and a row of the parent's label
    e = real[e]
    # What stands over a parent: of its own parents the least, then by type.
    o = np.lexsort((np.where(codes[r] < 0, -1, codes[r]), h.src[e], h.dst[e]))
    one = o[_starts(h.dst[e][o])] if len(o) else o
    over_at, over_kind = np.full(h.n, -1), np.full(h.n, -1)
    over_at[h.dst[e][one]], over_kind[h.dst[e][one]] = h.src[e][one], codes[r][one]
    # Rows of nodes with each of their parents' rows.
    mine, up = _Joined(h.dst[e], h.n).with_(node)
    alone = np.setdiff1d(np.arange(len(node)), mine)
    mine = np.concatenate([mine, alone])
    none = np.full(len(alone), -1)
    parent = np.concatenate([h.src[e][up], none])
    row_of = np.concatenate([r[up], none])
    look = lambda c, at: np.where(at >= 0, c[at], -1)
    parts = [codes[mine], spans[0][mine], look(codes, row_of), look(spans[0], row_of), look(over_kind, parent)]
    key = np.zeros(len(mine), np.int64)
    for c in parts:
        key = np.unique(key * (int(c.max(initial=-1)) + 2) + c + 1, return_inverse=True)[1]
    _, first, at = np.unique(key, return_index=True, return_inverse=True)
    name = lambda values, c: values[c] if c >= 0 else None
    table = np.array([_token_buckets((name(kinds, parts[0][i]), name(spans[1], parts[1][i]), name(kinds, parts[2][i]), name(spans[1], parts[3][i]), name(kinds, parts[4][i])), whole) for i in first], np.int64).reshape(len(first), -1)
    at = at.ravel()
    # Members and their labelled rows.
    ok = (h.prog[h.at] != NULL) & (h.node[h.at] != NULL)
    who = np.flatnonzero(ok)
    left, row = _Joined(node[mine], h.n).with_(h.at[who])
    sets = h.set[who[left]]
    inside = (parent[row] >= 0) & (h.members(sets, parent[row]) >= 0)
    over = look(over_at, parent)[row]
    far = inside & (over >= 0) & (h.members(sets, over) >= 0)
    phi = np.zeros(len(h.anchor) * BUCKETS, np.int64)
    for k in range(table.shape[1]):
        b = table[at[row], k]
        take = (b >= 0) & (True if k < 2 else far if k == 4 else inside)
        phi += np.bincount(sets[take] * BUCKETS + b[take], minlength=len(phi))
    return phi.reshape(-1, BUCKETS).astype(np.int32)


def _distinct(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and which of them each row is."""
    mix = np.random.default_rng(5).integers(1, 1 << 62, m.shape[1], dtype=np.int64).astype(np.uint64) | np.uint64(1)
    _, first, at = np.unique(m.astype(np.uint64) @ mix, return_index=True, return_inverse=True)
    at = at.ravel()
    if not np.array_equal(m[first][at], m):  # two rows of one hash
        rows, at = np.unique(m, axis=0, return_inverse=True)
        return rows, at.ravel()
    return m[first], at


def _encoded(made: Callable[[Hoods, np.ndarray], Iterator[tuple]], whole: bool, sizes: tuple):
    def run(prog, kind, node, parent, type_, span):
        e, n = kind & EDGE > 0, kind & NODE > 0
        h = Hoods(prog[e], parent[e], node[e], (prog[n], node[n]), *sizes)
        if len(h.anchor):
            yield from made(h, _phi(h, h.more, type_[n], span[n], whole))

    return run


def phi_texts(rows: DataFrame, whole: bool, *sizes: int) -> DataFrame:
    """prog, anchor, phi (counts joined by commas) of each neighbourhood."""

    def made(h: Hoods, phi: np.ndarray):
        some = np.flatnonzero(phi.any(axis=1))
        kinds, at = _distinct(phi[some])
        text = pa.array([",".join(map(str, x)) for x in kinds.tolist()], pa.string())
        yield pa.RecordBatch.from_arrays([*(pa.array(x, _LONG, mask=x == NULL) for x in h.named(some)), text.take(pa.array(at))], names=["prog", "anchor", "phi"])

    return by_program(rows, _encoded(made, whole, sizes), "prog long, anchor long, phi string", _types(prog=_LONG, anchor=_LONG, phi=pa.string()))


def phi_counts(rows: DataFrame, *sizes: int) -> DataFrame:
    """phi, n: how many neighbourhoods have an encoding, counted by chunk and then by table."""

    def made(h: Hoods, phi: np.ndarray):
        kinds, at = _distinct(phi[phi.any(axis=1)])
        yield pa.RecordBatch.from_arrays([pa.array(list(kinds), pa.list_(_INT)), pa.array(np.bincount(at, minlength=len(kinds)), _LONG)], names=["phi", "n"])

    return by_program(rows, _encoded(made, True, sizes), "phi array<int>, n long", _types(phi=pa.list_(_INT), n=_LONG)).groupBy("phi").agg(F.sum("n").alias("n"))


def grown_parts(rows: DataFrame, size: int, seed: int) -> DataFrame:
    """prog, step, node: a connected part of each program that has nodes, from a drawn start, at each step the frontier node that comes first by digest."""

    def digest(step: int, prog: int, node: int) -> tuple[str, int]:
        return hashlib.md5("|".join(map(str, (seed, step, *(() if prog == NULL else (prog,)), *(() if node == NULL else (node,))))).encode()).hexdigest(), node

    def made(prog, kind, node, parent, *_):
        out = []
        cuts = [*np.flatnonzero(_starts(prog)).tolist(), len(prog)]
        prog, is_edge, is_node, node, parent = prog.tolist(), (kind & EDGE > 0).tolist(), (kind & NODE > 0).tolist(), node.tolist(), parent.tolist()
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            p, near, first = prog[lo], {}, None
            for k in range(lo, hi):
                if is_node[k]:
                    d = digest(0, p, node[k])
                    first = d if first is None or d < first else first
                if is_edge[k] and p != NULL:
                    near.setdefault(parent[k], []).append(node[k])
                    near.setdefault(node[k], []).append(parent[k])
            if first is None:
                continue
            out.append((p, 0, first[1]))
            part, frontier = {first[1]}, set()
            last = first[1]
            for step in range(1, size):
                if last != NULL:
                    frontier.update(near.get(last, ()))
                frontier -= part
                if not frontier:
                    break
                last = min(digest(step, p, x) for x in frontier)[1]
                part.add(last)
                out.append((p, step, last))
        cols = np.array(out, np.int64).reshape(-1, 3)
        yield cols[:, 0], cols[:, 1], cols[:, 2]

    return by_program(rows, made, "prog long, step int, node long", _types(prog=_LONG, step=_INT, node=_LONG))
