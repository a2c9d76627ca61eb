"""Near-duplicate components by MinHash and sequential Bayesian verification (operator 6).

1. Documents with equal shingle sets are one class; its smallest id stands for it.
2. A class has HASHES minima, in bands. Two classes that agree in a band are
   candidates: at the similarity sought, a pair is missed with probability
   (1 - t**rows)**bands, about 5e-8 at 0.8.
3. Signatures of candidates are compared batch by batch. After each, a pair is
   dropped once the posterior probability (uniform prior) that its similarity
   reaches the threshold is below MISS. So is a pair whose sets' sizes exclude it.
4. What survives is verified exactly on the full sets of shingles.

Pairs are never listed. First each class is tried with the one leader that it
shares most bands with: at most one pair a class. Buckets whose classes are one
component by then are done. The classes of the others are dealt into cells of
bounded size, a bucket's own. A task holds one cell, goes through its pairs
across components by signature, best first, verifies survivors on the full
sets and joins components as it goes, so a cell sends at most one link less
than it has components. A bucket of several cells that still holds several
components then has its smaller components met with all of it, cell by cell.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from functools import cache
from hashlib import sha256
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import cut, forget, slices
from .components import components

HASHES, ROWS = 128, 4
BATCH, MISS = 32, 1e-6
#: Classes, and shingles of classes, on one side of a cell.
SIDE, HELD = 512, 1 << 20
_draw = np.random.default_rng(20240229)
_XOR = _draw.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_MUL = _draw.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_FOLD = _draw.integers(0, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)


class _Words(dict):
    def __missing__(self, w: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[w] = h = xxhash.xxh3_64_intdigest(w)
        return h


_words = _Words()


def shingles(text: str | None, k: int) -> np.ndarray:
    """Distinct shingles of k words as sorted 64-bit hashes: A-Z lowered; with fewer words the whole sequence is one; none without words."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and split at space and \t to \r
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(k, len(words))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)]
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out)


def signature(s: np.ndarray, first: int = 0, end: int = HASHES) -> np.ndarray:
    low = np.full(end - first, 0xFFFFFFFF, np.uint32)
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    for k in range(0, len(x), 1024):
        y = (x[k : k + 1024, None] ^ _XOR[first:end]) * _MUL[first:end]
        y ^= y >> np.uint32(15)
        np.minimum(low, y.min(axis=0), out=low)
    return low


def bands(sig: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        b = sig.reshape(-1, HASHES // ROWS, ROWS).astype(np.uint64)
        h = np.broadcast_to(np.arange(1, HASHES // ROWS + 1, dtype=np.uint64), b.shape[:2]).copy()
        for i in range(ROWS):
            h = (h ^ (h >> np.uint64(29))) * _FOLD[i] + b[:, :, i]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h.astype(np.int64)


@cache
def least_matches(n: int, t: float, miss: float = MISS) -> int:
    """Fewest matches of n with which P(similarity >= t) is still `miss` or more. That probability is P(Binomial(n + 1, t) <= matches)."""
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def surviving(a: np.ndarray, b: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of signatures (rows of a and b): those that no batch rules out, and their matches."""
    left = np.arange(len(a))
    got = np.zeros(len(a), np.int64)
    for k in range(0, HASHES, BATCH):
        got[left] += (a[left, k : k + BATCH] == b[left, k : k + BATCH]).sum(axis=1)
        left = left[got[left] >= least_matches(k + BATCH, t)]
    return left, got[left]


def sketch(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n, key, sig = [], [], []
                for t in part.column(1).to_pylist():
                    s = shingles(t, k)
                    n.append(len(s))
                    key.append(sha256(s.tobytes()).digest()[:16] if len(s) else None)
                    sig.append(signature(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "key", "sig"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, key binary, sig binary")


def banded(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2048):
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, HASHES)
                b = bands(sig)
                yield pa.RecordBatch.from_arrays([pa.array(b.ravel()), *(pa.array(np.repeat(part.column(c).to_numpy(), b.shape[1])) for c in (0, 2))], ["band", "id", "size"])

    return classes.select("id", "sig", F.col("n").cast("int")).mapInArrow(run, "band long, id long, size int")


def _similar(pairs: DataFrame, t: float) -> DataFrame:
    """Pairs (u, v, sig_u, sig_v) that their signatures don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2048):
                a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in (2, 3))
                keep, _ = surviving(a, b, t)
                yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(keep)) for c in (0, 1)], ["u", "v"])

    return pairs.select("u", "v", "sig_u", "sig_v").mapInArrow(run, "u long, v long")


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (u, v) whose full shingle sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[str, np.ndarray] = OrderedDict()  # a leader comes with many partners

        def of(t: str) -> np.ndarray:
            if t not in held:
                held[t] = shingles(t, k)
                if len(held) > 32:
                    held.popitem(last=False)
            return held[t]

        for batch in batches:
            for part in slices(batch):
                u, v = [], []
                for a, b, x, y in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    s, r = of(x), of(y)
                    both = len(s) + len(r) - len(np.union1d(s, r))
                    if 100 * both >= percent * (len(s) + len(r) - both):
                        u.append(a)
                        v.append(b)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    side = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}"))
    return pairs.select("u", "v").distinct().join(side("u"), "u").join(side("v"), "v").select("u", "v", "text_u", "text_v").mapInArrow(run, "u long, v long")


class Cell:
    """Classes that a task holds together. side: 1 is compared with 0, 2 with all; of two that are both asked (both), the larger id asks."""

    def __init__(self, band: int, rows: list[dict], t: float):
        self.band, self.t = band, t
        self.id, self.root, self.n, self.side = (np.array([r[c] for r in rows], np.int64) for c in ("id", "root", "n", "side"))
        self.both = np.array([r["both"] for r in rows], bool)
        self.sig = np.frombuffer(b"".join(r["sig"] for r in rows), np.uint32).reshape(-1, HASHES)

    def asking(self) -> list[int]:
        return np.flatnonzero(self.side > 0).tolist()

    def survivors(self, k: int) -> np.ndarray:
        """Rows that the k-th may be linked with across components, most matches first. A pair is looked at in the first band that it shares only."""
        at = np.flatnonzero((self.root != self.root[k]) & (self.side != 1) & (~self.both | (self.id < self.id[k])) & (np.minimum(self.n, self.n[k]) >= self.t * np.maximum(self.n, self.n[k]) - 1e-6))
        j = int(np.flatnonzero(bands(self.sig[k : k + 1])[0] == self.band)[0])
        if j and len(at):
            before = (self.sig[at, : j * ROWS] == self.sig[k, : j * ROWS]).reshape(len(at), j, ROWS)
            at = at[~before.all(axis=2).any(axis=1)]
        keep, got = surviving(np.broadcast_to(self.sig[k], (len(at), HASHES)), self.sig[at], self.t)
        return at[keep][np.lexsort((self.id[at[keep]], -got))]

    def concerned(self) -> set[int]:
        """Ids of pairs that survive."""
        out: set[int] = set()
        for k in self.asking():
            at = self.survivors(k)
            if len(at):
                out.add(int(self.id[k]))
                out.update(self.id[at].tolist())
        return out

    def links(self, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
        """Pairs of components (by root) that exact links join; none that others of the cell join already."""
        label: dict[int, int] = {}

        def find(r: int) -> int:
            while label.get(r, r) != r:
                label[r] = r = label.get(label[r], label[r])
            return r

        out = []
        for k in self.asking():
            at = self.survivors(k)
            first = True
            while len(at):
                own = find(int(self.root[k]))
                of = np.array([find(r) for r in self.root[at].tolist()])
                at, of = at[of != own], of[of != own]
                # The best of each component, then all that is left of components that aren't joined by then.
                some = np.sort(np.unique(of, return_index=True)[1]) if first else np.arange(len(at))
                for x in np.flatnonzero(linked(sets[k], [sets[y] for y in at[some].tolist()], percent)).tolist():
                    r = find(int(self.root[at[some[x]]]))
                    if r != find(own):
                        out.append((int(self.root[k]), int(self.root[at[some[x]]])))
                        label[r] = find(own)
                at, first = np.delete(at, some), False
        return out


def linked(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets (sorted, none empty) have 100 * intersection >= percent * union with the one."""
    if not others:
        return np.zeros(0, bool)
    sizes = np.array([len(x) for x in others])
    flat = np.concatenate(others)
    shared = np.add.reduceat(one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat, np.cumsum(sizes) - sizes, dtype=np.int64)
    return 100 * shared >= percent * (len(one) + sizes - shared)


def _cells(dealt: DataFrame, names: list[str], made, schema: str) -> DataFrame:
    """made(band, block, part, rows) -> record batch or None for each cell, whose rows come together to one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for part in slices(batch, 2048):
                for r in part.to_pylist():
                    if (key := (r["band"], r["block"], r["part"])) != now:
                        if rows and (out := made(*now, rows)) is not None:
                            yield out
                        now, rows = key, []
                    rows.append(r)
        if rows and (out := made(*now, rows)) is not None:
            yield out

    return dealt.select("band", "block", "part", *names).repartition("band", "block", "part").sortWithinPartitions("band", "block", "part").mapInArrow(run, schema)


def across(spark: SparkSession, members: DataFrame, classes: DataFrame, texts: DataFrame, t: float, k: int, percent: int) -> DataFrame:
    """Links between components (u, v: their roots) within cells. members: band, block, part, side, both, id, root. Only the texts that some pair still needs after its signatures move."""

    def first(band, block, part, rows):
        ids = sorted(Cell(band, rows, t).concerned())
        return pa.RecordBatch.from_arrays([pa.array([x], y) for x, y in ((band, pa.int64()), (block, pa.int32()), (part, pa.int32()), (ids, pa.list_(pa.int64())))], ["band", "block", "part", "ids"]) if ids else None

    def then(band, block, part, rows):
        cell = Cell(band, rows, t)
        found = cell.links([shingles(r["text"], k) for r in rows], percent)
        return pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], ["u", "v"]) if found else None

    names = ["side", "both", "id", "root", "n", "sig"]
    whole = cut(spark, members.join(classes.select("id", "n", "sig"), "id"))
    asked = cut(spark, _cells(whole, names, first, "band long, block int, part int, ids array<long>").select("band", "block", "part", F.explode("ids").alias("id")))
    held = whole.join(asked, ["band", "block", "part", "id"]).join(texts, "id")
    found = cut(spark, _cells(held, [*names, "text"], then, "u long, v long").distinct())
    forget(spark, whole, asked)
    return found


def duplicates(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Documents without text or words are linked with nothing. Rows of one doc_id are one document: links of any of them count. A null id takes no part: its
    component is null and it is kept. The smallest id of a component is kept (each of its rows).
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    t = percent / 100
    rows = cut(spark, sketch(docs, k))
    named = rows.where("doc_id is not null and n_shingles > 0")
    classes = cut(spark, named.groupBy("key").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n")))
    least = classes.select("key", "id")
    # An id with several texts joins their classes.
    member = named.select("doc_id", "key").join(least, "key").select("doc_id", "id")
    several = member.groupBy("doc_id").agg(F.min("id").alias("u"), F.max("id").alias("v")).where("u <> v")
    links = several.select("u", "v")
    if not links.isEmpty():
        links = member.join(several.select("doc_id", "u"), "doc_id").select("u", F.col("id").alias("v"))
    band = banded(classes)
    shared = band.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    sized = cut(spark, band.join(shared, "band"))
    # A bucket's leader is the class whose buckets are largest together: of a text and its variants, the text that they vary.
    weight = sized.groupBy("id").agg(F.sum("n").alias("weight"))
    leads = sized.select("band", "id").join(weight, "id").groupBy("band").agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("lead"))
    buckets = cut(spark, sized.select("band", "id", "size").join(leads, "band"))
    forget(spark, sized)
    asked = buckets.select("id").distinct()
    # The texts and signatures that may be compared.
    texts = cut(spark, docs.where("doc_id is not null").withColumnRenamed("doc_id", "id").join(asked, "id").distinct())
    sigs = classes.select("id", "sig")
    one = buckets.where("id <> lead").groupBy("id", "lead").count().groupBy("id").agg(F.max_by("lead", F.struct("count", -F.col("lead"))).alias("lead"))
    first = one.select(F.col("lead").alias("u"), F.col("id").alias("v"))
    first = first.join(sigs.toDF("u", "sig_u"), "u").join(sigs.toDF("v", "sig_v"), "v")
    links = cut(spark, links.unionByName(verified(_similar(first, t), texts, k, percent)))
    roots = components(spark, links)
    spread = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    both = F.lit(True).alias("both")
    for turn in range(2):
        here = buckets.select("band", "id", "size").join(roots, "id", "left").select("band", "id", "size", F.coalesce("root", "id").alias("root"))
        parts = here.groupBy("band", "root").agg(F.count("*").alias("n"), F.sum("size").alias("held"))
        mixed = parts.groupBy("band").agg(F.sum("n").alias("n"), F.sum("held").alias("held"), F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("most")).where("roots > 1")
        cells = lambda n: F.ceil(F.greatest(F.col(n) / SIDE, F.col("held") / HELD)).cast("int")
        mixed = mixed.withColumn("blocks", cells("n")).withColumn("rest", F.col("n") - F.col("most")).withColumn("pieces", cells("rest")).drop("n", "held", "most", "rest")
        if turn == 0:  # each bucket's cells by themselves
            sides = here.join(mixed, "band")
            members = sides.select("band", spread("blocks", 7).alias("block"), F.lit(0).alias("part"), F.lit(2).alias("side"), both, "id", "root")
        else:  # what is left: smaller components with all of their bucket
            mixed = cut(spark, mixed.where("blocks > 1"))
            if mixed.isEmpty():
                break
            sides = here.join(mixed, "band")
            minors = sides.where("root <> main").select("band", every("blocks").alias("block"), spread("pieces", 11).alias("part"), F.lit(1).alias("side"), both, "id", "root")
            others = sides.select("band", spread("blocks", 7).alias("block"), every("pieces").alias("part"), F.lit(0).alias("side"), (F.col("root") != F.col("main")).alias("both"), "id", "root")
            members = minors.unionByName(others)
        new = across(spark, members, classes, texts, t, k, percent)
        if not new.isEmpty():
            joined = components(spark, new).select(F.col("id").alias("root"), F.col("root").alias("to"))
            known = roots.unionByName(joined.select(F.col("root").alias("id"), "root").join(roots.select("id"), "id", "left_anti"))
            roots = cut(spark, known.join(joined, "root", "left").select("id", F.coalesce("to", "root").alias("root")))
    smallest = roots.join(roots.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("id", "component_id")
    of = least.join(smallest, "id", "left").select("key", F.coalesce("component_id", "id").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")).join(of, "key", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicate(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each component; all their columns."""
    keep = cut(spark, duplicates(spark, docs, k, percent, id_col, text).where("not kept").select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(keep, docs[id_col] == keep["_gone"], "left_anti")
