"""Removal of repeated byte strings by sorting suffixes in range-partitioned buckets (operator 4).

Sorting the suffix of every byte would move many times the corpus. A string of
`length` bytes is found by one suffix: that of its anchor (anchors.py), which lies
at the same place in each of its occurrences. Two sorts, the coarse one first:

1. Suffixes of anchors, by two tokens: the leading gram, and all bytes of the
   stretch of windows that have this anchor (digests of 64 and 128 bits). A gram
   that occurs once ends its windows. A stretch that occurs again is repeated as
   a whole. Others beside one of the same gram are asked further, one of each.
2. Suffixes of these stretches' blocks of `block` windows. All windows of a block
   share its core; the suffixes are sorted by the bytes of their cores. In a run
   of equal cores windows are compared by the few bytes beside the core.

Both sorts are alike. Splitters are sampled, and suffixes are dealt into ranges
of their leading tokens, ties by text and place: so a hot key is split over as
many buckets as it fills. A bucket is sorted by multikey quicksort, token by
token and only where the tokens before are equal, and its runs of equal keys are
read off. Only a bucket's first and last run may go on in another bucket: of
these one row a kind is sent on and compared across boundaries.

A text is known by its digest; a task passes on two copies of it at most, enough
to know that it is repeated.

Passages may also be counted in words: a text is then the digests of its words,
WORD bytes each, and a window is so many digests from the begin of one. Windows
that begin within a digest may be found too, and are left out at the end.
"""

from __future__ import annotations

import gc
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import GRAM, runs
from .arrow import cut, forget, slices

BLOCK, LEAD = 64, 64
#: Suffixes in a bucket of either sort, about.
HEADS, CORES = 1 << 18, 1 << 16
#: Digests of texts that a task remembers.
REMEMBERED = 400_000
WHOLE, ASKED, EDGE = 1, 2, 3
#: Bytes of a word's digest, where words are compared, and windows in a block of these.
WORD = 8
WORD_BLOCK = 16 * WORD


def _digest(text: str = "text"):
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256), 1, 32))


def _key(data: bytes) -> bytes:
    return sha256(data).digest()[:16]


def _units(data: bytes, unit: int) -> bytes:
    """What is compared: the bytes themselves (unit 1), or the digests of the words between whitespace (unit WORD)."""
    return data if unit == 1 else b"".join(map(xxhash.xxh3_64_digest, data.split()))


def _table(columns: list, kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def multikey_sort(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by their tokens, and how many leading tokens each shares with the one before it.

    Multikey quicksort, all ranges of a depth at a time: a range of rows that are equal so far is sorted by the next token, and only what is
    equal in it goes on to the token after.
    """
    n = len(tokens[0])
    order, shared = np.arange(n), np.zeros(n, np.int64)
    at, group = np.arange(n), np.zeros(n, np.int64)  # places in `order` that are still open, and their ranges
    for token in tokens:
        if not len(at):
            break
        rows = order[at]
        rows = rows[np.lexsort((token[rows], group))]
        order[at] = rows
        same = np.zeros(len(at), bool)
        same[1:] = (group[1:] == group[:-1]) & (token[rows[1:]] == token[rows[:-1]])
        shared[at[same]] += 1
        begins = ~same
        group = np.cumsum(begins)
        keep = same.copy()
        keep[:-1] |= same[1:]
        at, group = at[keep], group[keep]
    return order, shared


def heads(docs: DataFrame, length: int, gram: int, unit: int = 1) -> DataFrame:
    """One row a stretch of window starts [lo, hi] with one anchor (at): its two tokens, the second in halves."""
    names = ["gram", "a0", "a1", "th", "lo", "hi", "at"]
    kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int32()] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for part in slices(batch, 64):
                cols: list[list] = [[] for _ in names]
                for text in part.column(0).to_pylist():
                    raw = (text or "").encode()
                    data = _units(raw, unit)
                    if len(data) < length:
                        continue
                    th = _key(raw)
                    if seen[th] == 2:
                        continue
                    seen[th] += 1
                    first, last, anchor = (x * unit for x in runs(np.frombuffer(data, f"<u{unit}"), length // unit, gram // unit))
                    view, lo, hi, at = memoryview(data), first.tolist(), last.tolist(), anchor.tolist()
                    around = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[a : b + length]) for a, b in zip(lo, hi, strict=True)]), np.int64)
                    grams = np.array([xxhash.xxh3_64_intdigest(view[a : a + gram]) for a in at], np.uint64).view(np.int64)
                    for c, x in zip(cols, (grams, around[::2], around[1::2], [th] * len(lo), lo, hi, at), strict=True):
                        c.extend(x)
                if len(seen) > REMEMBERED:
                    seen.clear()
                yield _table(cols, kinds, names)

    return docs.select("text").mapInArrow(run, "gram long, a0 long, a1 long, th binary, lo int, hi int, at int")


def _bucketed(spark: SparkSession, rows: DataFrame, keys: list[str], each: int, sort, schema: str) -> DataFrame:
    """rows (a written table) dealt into ranges of `keys` by sampled splitters; sort(table) -> record batches of a bucket's runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from sort(pa.Table.from_batches(held))

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // each))
    return rows.repartitionByRange(parts, *keys).mapInArrow(run, schema)


def _first_sort(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """WHOLE: repeated stretches. ASKED: one of each kind of stretch that shares its gram with others. EDGE: one of each kind in the first and last run."""
    order, shared = multikey_sort([_numbers(table, c) for c in ("gram", "a0", "a1")])
    begins, kind = np.flatnonzero(shared == 0), np.flatnonzero(shared < 3)
    size = np.diff(np.r_[kind, len(order)])
    run = np.cumsum(shared == 0)[kind] - 1  # of each kind
    kinds, least = np.bincount(run), np.full(len(begins), 1 << 60)
    np.minimum.at(least, run, size)
    edge = (run == 0) | (run == len(begins) - 1)
    # Of rows of one text and place one is enough.
    whole = order[np.repeat(size > 1, size)]
    asked = order[kind[~edge & (kinds[run] > 1) & (least[run] == 1)]]
    edges = order[kind[edge]]
    for what, rows, m in ((WHOLE, whole, None), (ASKED, asked, None), (EDGE, edges, size[edge])):
        part = table.take(pa.array(rows)).combine_chunks()
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), what, np.int32)), *(part.column(c).combine_chunks() for c in part.column_names), pa.array(np.zeros(len(rows), np.int64) if m is None else m)], ["what", *part.column_names, "m"])


def blocks(texts: DataFrame, length: int, unit: int = 1, block: int = BLOCK) -> DataFrame:
    """The stretches of each text (th, text, found: array of lo, hi, at) cut into blocks: the core, and the bytes beside it.

    from_, to: the block's windows, by how many bytes before the core they begin; place: where the core begins.
    """
    names = ["lead", "mix", "core", "th", "place", "from_", "to", "left", "right"]
    kinds = [pa.binary(), pa.int64(), pa.binary(), pa.binary(), *[pa.int32()] * 3, pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, 64):
                cols: list[list] = [[] for _ in names]
                for th, text, found in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if th in seen:  # a copy: its windows are repeated, and known to be
                        continue
                    seen.add(th)
                    data = _units((text or "").encode(), unit)
                    for r in found:
                        at, lo, hi = r["at"], r["lo"], r["hi"]
                        for j in range((at - hi) // block, (at - lo) // block + 1):
                            a, b = max(at - hi - j * block, 0), min(at - lo - j * block, block - 1)
                            begin = at - j * block
                            end = begin - block + 1 + length
                            core = data[begin:end]
                            row = (core[:LEAD], xxhash.xxh3_64_intdigest(core) - (1 << 63), core, th, begin, a, b, data[begin - b : begin], data[end : end + block - 1 - a])
                            for c, x in zip(cols, row, strict=True):
                                c.append(x)
                if len(seen) > REMEMBERED:
                    seen.clear()
                yield _table(cols, kinds, names)

    return texts.select("th", "text", "found").mapInArrow(run, "lead binary, mix long, core binary, th binary, place int, from_ int, to int, left binary, right binary")


def _common(a: bytes, b: bytes) -> int:
    """How many leading bytes are equal."""
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])).bit_length() + 7) // 8


def _second_sort(parts: int, unit: int = 1, block: int = BLOCK):
    """Hits: th, lo, hi. Of the first and last run, what windows there are: packed by core and shard, one entry a distinct window."""
    packed = np.dtype([("k0", "<i8"), ("k1", "<i8"), ("th", "S16"), ("start", "<i4"), ("known", "u1")])
    names, kinds = ["th", "lo", "hi", "core", "shard", "windows"], [pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]

    def sort(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cores = table.column("core").to_pylist()
        width = -(-max(map(len, cores)) // 8) * 8
        raw = np.frombuffer(b"".join(c.ljust(width, b"\0") for c in cores), ">u8").reshape(len(cores), -1).astype(np.uint64)
        mix = (_numbers(table, "mix").astype(np.int64).view(np.uint64)) ^ np.uint64(1 << 63)
        lead = LEAD // 8
        tokens = [*(raw[:, k] for k in range(min(lead, raw.shape[1]))), mix, *(raw[:, k] for k in range(lead, raw.shape[1]))]
        order, shared = multikey_sort(tokens)
        begins = np.flatnonzero(shared < len(tokens))
        ends = np.r_[begins[1:], len(order)]
        ths, lefts, rights = (table.column(c).to_pylist() for c in ("th", "left", "right"))
        place, first, last = (_numbers(table, c).tolist() for c in ("place", "from_", "to"))
        out: list[tuple] = []
        for k in [*np.flatnonzero(ends - begins > 1).tolist(), *({0, len(begins) - 1} - set(np.flatnonzero(ends - begins > 1).tolist()))]:
            rows = order[begins[k] : ends[k]].tolist()
            edge = k in (0, len(begins) - 1)
            alike: dict[tuple, list[int]] = {}
            for x in rows:
                alike.setdefault((first[x], last[x], lefts[x], rights[x]), []).append(x)
            single = [v[0] for v in alike.values() if len(v) == 1]
            out += [(ths[x], place[x] - last[x], place[x] - first[x], None, None, None) for v in alike.values() if len(v) > 1 for x in v]
            if not edge and (len(alike) < 2 or not single):
                continue
            if len(alike) == 2 and not edge:
                x, y = (v[0] for v in alike.values())
                low = max(first[x], first[y], block - 1 - _common(rights[x], rights[y]))
                high = min(last[x], last[y], _common(lefts[x][::-1], lefts[y][::-1]))
                if low <= high:
                    out += [(ths[z], place[z] - high, place[z] - low, None, None, None) for z in single]
                continue
            hits: dict[int, list[int]] = {x: [] for x in single}
            entries: list[tuple] = []
            kinds_of = [(v[0], len(v)) for v in alike.values()]
            for o in range(-(-min(first[x] for x, _ in kinds_of) // unit) * unit, max(last[x] for x, _ in kinds_of) + 1, unit):
                here = [(x, n, lefts[x][last[x] - o :] + b"|" + rights[x][: block - 1 - o]) for x, n in kinds_of if first[x] <= o <= last[x]]
                often: Counter[bytes] = Counter()
                for _, n, w in here:
                    often[w] += n
                for x, n, w in here:
                    if n == 1 and often[w] > 1:
                        hits[x].append(o)
                if edge:
                    entries += [(*np.frombuffer(xxhash.xxh3_128_digest(bytes([o]) + w), np.int64).tolist(), ths[x], place[x] - o, often[w] > 1) for w, x in {w: x for x, _, w in here}.items()]
            for x, at in hits.items():
                begin = 0
                for k in range(1, len(at) + 1):
                    if k == len(at) or at[k] != at[k - 1] + unit:
                        out.append((ths[x], place[x] - at[k - 1], place[x] - at[begin], None, None, None))
                        begin = k
            if edge:
                core = sha256(cores[rows[0]]).digest()[:16]
                sent = np.array(entries, packed)
                shards = sent["k0"] % parts
                for s in np.unique(shards).tolist():
                    out.append((None, None, None, core, s, sent[shards == s].tobytes()))
        yield _table(list(zip(*out, strict=True)) if out else [[]] * 6, kinds, names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows that several buckets sent: rows come sorted by core and shard."""
        now, held = None, []

        def hits() -> pa.RecordBatch:
            e = np.frombuffer(b"".join(held), packed)
            e = e[np.lexsort((e["k1"], e["k0"]))]
            same = (e["k0"][1:] == e["k0"][:-1]) & (e["k1"][1:] == e["k1"][:-1])
            hit = e[(np.r_[False, same] | np.r_[same, False]) & (e["known"] == 0)]
            th = [x.ljust(16, b"\0") for x in hit["th"].tolist()]
            return _table([th, hit["start"], hit["start"]], kinds[:3], names[:3])

        for batch in batches:
            for core, shard, windows in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if (core, shard) != now:
                    if len(held) > 1:
                        yield hits()
                    now, held = (core, shard), []
                held.append(windows)
        if len(held) > 1:
            yield hits()

    return sort, meet


def repeated(spark: SparkSession, docs: DataFrame, length: int = 400, gram: int = GRAM, unit: int = 1) -> DataFrame:
    """Starts of repeated windows by text: th, found (array of struct lo, hi); texts without any are absent. All are in bytes of _units."""
    docs = docs.select(F.col("text").cast("string").alias("text"))
    block = min(BLOCK if unit == 1 else WORD_BLOCK, length // unit // 2 * unit)
    made = cut(spark, heads(docs, length, gram, unit))
    first = cut(spark, _bucketed(spark, made, ["gram", "a0", "a1", "th", "lo"], HEADS, _first_sort, "what int, gram long, a0 long, a1 long, th binary, lo int, hi int, at int, m long"))
    _free(spark, made)
    # Across boundaries: kinds of stretches that several buckets hold.
    edges = first.where(f"what = {EDGE}")
    kinds = edges.groupBy("gram", "a0", "a1").agg(F.sum("m").alias("m"), F.min(F.struct("th", "lo", "hi", "at")).alias("one"))
    again = edges.where("m = 1").drop("m").join(kinds.where("m > 1").select("gram", "a0", "a1"), ["gram", "a0", "a1"])
    whole = first.where(f"what = {WHOLE}").select("th", "lo", "hi").unionByName(again.select("th", "lo", "hi"))
    need = first.where(f"what = {ASKED}").select("th", "lo", "hi", "at").unionByName(kinds.select("one.*"))
    asked = need.groupBy("th").agg(F.collect_set(F.struct("lo", "hi", "at")).alias("found"))
    parts = cut(spark, blocks(docs.withColumn("th", _digest()).join(asked, "th"), length, unit, block))
    sort, meet = _second_sort(int(spark.conf.get("spark.sql.shuffle.partitions")), unit, block)
    second = cut(spark, _bucketed(spark, parts, ["lead", "mix", "th", "place"], CORES, sort, "th binary, lo int, hi int, core binary, shard int, windows binary"))
    _free(spark, parts)
    met = second.where("core is not null").select("core", "shard", "windows").repartition("core", "shard").sortWithinPartitions("core", "shard").mapInArrow(meet, "th binary, lo int, hi int")
    found = whole.unionByName(second.where("core is null").select("th", "lo", "hi")).unionByName(met)
    found = cut(spark, found.groupBy("th").agg(F.collect_set(F.struct("lo", "hi")).alias("found")))
    _free(spark, first, second)
    return found


def _free(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables, and let the driver find out that the shuffles they were made by aren't needed any more."""
    forget(spark, *tables)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def covered(found: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Disjoint, maximal stretches of bytes that the windows cover."""
    out: list[list[int]] = []
    for lo, hi in sorted((r["lo"], r["hi"] + length) for r in found or ()):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def stretches(found: pa.ListArray, length: int, unit: int = 1) -> list[list[tuple[int, int]]]:
    """Like covered, of each row and in units of `unit` bytes; windows that begin within a unit are none."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(found))]
    lo, hi = (x.to_numpy().astype(np.int64) for x in found.flatten().flatten())
    row = np.repeat(np.arange(len(found)) << 40, pc.list_value_length(found).fill_null(0).to_numpy())
    lo, hi = -(-lo // unit), hi // unit
    whole = lo <= hi
    begin, end = (row + lo)[whole], (row + hi + length)[whole]
    if len(begin):
        order = np.argsort(begin)
        begin, end = begin[order], np.maximum.accumulate(end[order])
        new = np.flatnonzero(np.r_[True, begin[1:] > end[:-1]])
        a, b = begin[new], end[np.r_[new[1:], len(begin)] - 1]
        at = a >> 40
        for r, x, y in zip(at.tolist(), (a - (at << 40)).tolist(), (b - (at << 40)).tolist(), strict=True):
            out[r].append((x, y))
    return out


def _joined(spark: SparkSession, docs: DataFrame, length: int, gram: int, words: int = 0) -> DataFrame:
    """docs (with a column text) and `found` for each row; with `words` also `worded`, of windows of so many words."""
    found = [repeated(spark, docs, length, gram)]
    if words:
        found.append(repeated(spark, docs, words * WORD, GRAM, WORD).withColumnRenamed("found", "worded"))
    docs = docs.withColumn("th", _digest())
    for f in found:
        docs = docs.join(f, "th", "left")
    return docs.drop("th")


def report(spark: SparkSession, docs: DataFrame, length: int = 400, gram: int = GRAM, id_col: str = "doc_id", text: str = "text", words: int = 0) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with `words` also n_passages and n_passage_words.

    These two count the words that stand in `words` successive words found twice or more, whatever the whitespace between and however many bytes they
    have, and the maximal runs of them; nothing more is removed for it. `words` is 8 (GRAM // WORD) at least.

    A null text is empty. Texts shorter than `length` bytes lose nothing; a repeated row is a repetition of all its windows; ids may repeat or be null;
    other columns are not read; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["n_passages", "n_passage_words"][: 2 * bool(words)]]
    kinds = [pa.string() if n == "kept_sha256" else pa.int64() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                found = [stretches(part.column(2), length), *(stretches(c, words, WORD) for c in part.columns[3:])]
                for doc, t, spans, *told in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), *found, strict=True):
                    data = (t or "").encode()
                    digest, at = sha256(), 0
                    for a, b in spans:
                        digest.update(data[at:a])
                        at = b
                    digest.update(data[at:])
                    rows.append((doc, len(data), sum(b - a for a, b in spans), len(spans), digest.hexdigest(), *(x for p in told for x in (len(p), sum(b - a for a, b in p)))))
                yield _table(list(zip(*rows, strict=True)) if rows else [[]] * len(names), kinds, names)

    schema = ", ".join(f"{n} {'string' if n == 'kept_sha256' else 'long'}" for n in names)
    return _joined(spark, docs, length, gram, words).select("doc_id", "text", "found", *["worded"][: bool(words)]).mapInArrow(run, schema)


def strip(spark: SparkSession, docs: DataFrame, length: int = 400, gram: int = GRAM, text: str = "text") -> DataFrame:
    """docs with repeated strings taken out of their texts; a character goes only if all its bytes are covered. A null text stays null.

    Other columns stay, whatever their names; repeated rows are repetitions of each other; an empty table gives no rows.
    """

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                new = []
                for t, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    if found and t is not None:
                        data, kept, at = t.encode(), [], 0
                        for a, b in covered(found, length):
                            while a < b and data[a] & 0xC0 == 0x80:
                                a += 1
                            while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                                b -= 1
                            kept.append(data[at:a])
                            at = b
                        t = b"".join([*kept, data[at:]]).decode()
                    new.append(t)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(new, pa.string())], ["row", "text"])

    rows = docs.select(F.struct("*").alias("row"), F.col(text).cast("string").alias("text"))
    cleaned = _joined(spark, rows, length, gram).select("row", "text", "found").mapInArrow(shorten, rows.schema)
    return cleaned.select(*[F.col("text").cast(docs.schema[c].dataType).alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
