"""Best-fit packing of documents into sequences by linear grouping (operator 8).

Lengths are whole numbers up to the sequence length, so the corpus is known to
the planner by its histogram: at most that many numbers, however many documents
there are. Large lengths are rounded up within groups of equal cardinality, a
linear programme over configurations of the few sizes (solved by column
generation) says how many sequences have which configuration, actual lengths are
substituted, and small lengths and leftovers are placed by best fit. All of it
works on runs of equal sequences.

Documents find their places by their rank among those of the same length:
each task numbers its own, and the counts of tasks before it are added.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow import cut, slices, texts
from .bpe import byte_bpe

GROUPS, LARGE = 96, 0.2
Run = tuple[int, tuple[int, ...]]


def best_fit(hist: dict[int, int], cap: int, open_runs: list[Run] = ()) -> list[Run]:
    """Best-fit decreasing on runs of equal sequences; each run is (how many, lengths in each)."""
    free: dict[int, list[Run]] = defaultdict(list)
    rooms: list[int] = []

    def put(n: int, held: tuple[int, ...]) -> None:
        room = cap - sum(held)
        if not free[room]:
            bisect.insort(rooms, room)
        free[room].append((n, held))

    for n, held in open_runs:
        put(n, held)
    for size in sorted(hist, reverse=True):
        left = hist[size]
        while left:
            k = bisect.bisect_left(rooms, size)
            if k == len(rooms):
                fit = cap // size
                whole, rest = divmod(left, fit)
                if whole:
                    put(whole, (size,) * fit)
                if rest:
                    put(1, (size,) * rest)
                break
            room = rooms[k]
            n, held = free[room].pop()
            if not free[room]:
                rooms.pop(k)
            fit = room // size
            whole = min(n, left // fit)
            if whole:
                put(whole, held + (size,) * fit)
                left -= whole * fit
                n -= whole
            if n and left and left < fit:
                put(1, held + (size,) * left)
                n, left = n - 1, 0
            if n:
                put(n, held)
    return [r for runs in free.values() for r in runs]


def configurations(sizes: list[int], counts: list[int], cap: int, rounds: int = 1500) -> list[tuple[float, list[int]]]:
    """How often to use which configuration (numbers of each size in one sequence), by column generation."""
    g = len(sizes)
    base = np.diag([float(cap // s) for s in sizes])
    need = np.array(counts, float)
    inverse = np.linalg.inv(base)
    for _ in range(rounds):
        worth = inverse.sum(axis=0)
        best, last = np.zeros(cap + 1), np.full(cap + 1, -1)
        sz = np.array(sizes)
        order = np.argsort(sz)
        ss, ws = sz[order], worth[order]
        for c in range(int(ss[0]), cap + 1):
            m = int(np.searchsorted(ss, c, "right"))
            got = best[c - ss[:m]] + ws[:m]
            k = int(got.argmax())
            if got[k] > best[c - 1] + 1e-12:
                best[c], last[c] = got[k], order[k]
            else:
                best[c], last[c] = best[c - 1], -2
        if best[cap] < 1 + 1e-7:
            break
        col, c = np.zeros(g), cap
        while c > 0 and last[c] != -1:
            if last[c] == -2:
                c -= 1
            else:
                col[last[c]] += 1
                c -= sizes[last[c]]
        step, now = inverse @ col, inverse @ need
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, np.maximum(now, 0) / step, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        base[:, out] = col
        try:
            inverse = np.linalg.inv(base)
        except np.linalg.LinAlgError:
            break
    amount = inverse @ need
    return [(float(x), [int(v) for v in base[:, k]]) for k, x in enumerate(amount) if x >= 1]


def linear_grouping(hist: dict[int, int], cap: int) -> list[Run]:
    """Group, optimise, substitute, then best fit. A configuration's slots take the longest actual lengths of their groups, its last slot the longest that the room left by the others admits."""
    large = sorted((s for s in hist if s > LARGE * cap and s < cap), reverse=True)
    runs: list[Run] = [(hist[cap], (cap,))] if cap in hist else []
    left = {s: n for s, n in hist.items() if s < cap}
    if len(large) < 2:
        return runs + best_fit(left, cap)
    each = max(1, -(-sum(hist[s] for s in large) // GROUPS))
    groups: list[list[int]] = [[]]  # lengths, each group's largest first
    held = 0
    for s in large:
        if held >= each:
            groups.append([])
            held = 0
        groups[-1].append(s)
        held += hist[s]
    rising = large[::-1]

    def longest(lengths: list[int], room: int, picked: Counter[int]) -> int | None:
        return next((s for s in lengths if s <= room and left[s] > picked[s]), None)

    for amount, config in sorted(configurations([x[0] for x in groups], [sum(hist[s] for s in x) for x in groups], cap), reverse=True):
        slots = [k for k, n in enumerate(config) for _ in range(n)]
        todo = int(amount + 1e-9)
        while todo and slots:
            picked: Counter[int] = Counter()
            room = cap
            for k in slots[:-1]:
                if (s := longest(groups[k], room, picked)) is not None:
                    picked[s] += 1
                    room -= s
            if (s := longest(rising[: bisect.bisect_right(rising, room)][::-1], room, picked)) is not None:
                picked[s] += 1
            if not picked:
                break
            n = min([todo, *(left[s] // times for s, times in picked.items())])
            for s, times in picked.items():
                left[s] -= n * times
            runs.append((n, tuple(sorted(picked.elements(), reverse=True))))
            todo -= n
    return best_fit({s: n for s, n in left.items() if n}, cap, runs)


def plan(hist: dict[int, int], cap: int) -> list[Run]:
    """Linear grouping, checked: each length as often as it occurs, no sequence over `cap`."""
    runs = linear_grouping(hist, cap)
    got: Counter[int] = Counter()
    for n, held in runs:
        for s in held:
            got[s] += n
    if dict(got) != {s: n for s, n in hist.items() if n} or any(sum(held) > cap for _, held in runs):
        raise AssertionError("the plan doesn't hold the lengths")
    return runs


def places(runs: list[Run]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first rank, first sequence and offset of each stretch of places."""
    taken: Counter[int] = Counter()
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    first = 0
    for n, held in runs:
        offset = 0
        for s in held:
            out[s].append((taken[s], first, offset))
            taken[s] += n
            offset += s
        first += n
    return {s: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for s, v in out.items()}


def pieces(docs: DataFrame, path: str, cap: int, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each document and their numbers (seq) among the task's (pid) pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, pid = byte_bpe(path, speculate=False), TaskContext.get().partitionId()
        seen = [0] * (cap + 1)
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch):
                row, piece, first, size, crc, seq = ([] for _ in range(6))
                for at, ids in enumerate(bpe.encode(texts(part, "text"))):
                    ids += last
                    n = len(ids) // 4
                    start, length, k = 0, (n - 1) % cap + 1, 0
                    while start < n:
                        row.append(at)
                        piece.append(k)
                        first.append(start)
                        size.append(length)
                        crc.append(zlib.crc32(ids[4 * start : 4 * (start + length)]))
                        seq.append(seen[length])
                        seen[length] += 1
                        start, length, k = start + length, cap, k + 1
                columns = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (first, size, crc)), pa.array(np.full(len(row), pid, np.int32)), pa.array(seq, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "pid", "seq"]
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, seq long")


def pack(spark: SparkSession, docs: DataFrame, path: str, cap: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece's place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty: one piece that holds the end id alone. Repeated rows are packed each; ids may be null; an empty table gives no rows.
    """
    made = cut(spark, pieces(docs, path, cap, end, id_col, text_col))
    counts = made.groupBy("length", "pid").agg(F.count("*").alias("n"))
    hist = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `cap` rows
    where = places(plan(hist, cap)) if hist else {}
    before = F.sum("n").over(Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("length", "pid", F.coalesce(before, F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (3, 5))
            seq, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for s in np.unique(length).tolist():
                at = np.flatnonzero(length == s)
                ranks, firsts, offsets = where[s]
                k = np.searchsorted(ranks, rank[at], "right") - 1
                seq[at], offset[at] = firsts[k] + rank[at] - ranks[k], offsets[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = made.join(base, ["length", "pid"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("seq") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
