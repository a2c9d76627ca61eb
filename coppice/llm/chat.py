"""Chat formatting with a prefix tree (operator 7).

Conversations that share their first turns share the nodes of these turns. A turn's node
is known by a digest of all turns up to it, so the tree needs no comparison of texts: equal
digests are one node. Every node is owned by the least conversation that passes through it.
What a conversation owns is the end of its path, so it is emitted as one run of tokens; a
run's children branch off from it, and a depth-first walk lists a run, then its children
from the last branching to the first. The walk's order is the order of the runs' paths
(their owners and depths), found by sorting; a path has at most one entry for each turn of
its conversation. Starts are sums over that order: by task, then over the tasks' totals.

A run has the position of its first token (the tokens of its ancestors come before) and
the stretches of the stream that its tokens may attend to beside its own earlier ones.

No step gathers a tree: hot first turns are pre-aggregated by node, and joins on nodes
and owners have one row a key on one side, so the other side's large partitions may split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import cut, slices
from .bpe import byte_bpe

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
NOBODY = -(1 << 63)
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE), re.S)


def escape(text: str) -> str:
    """Texts never hold `<|` afterwards: one more backslash goes between < and | (and any backslashes there)."""
    return _CONTROL.sub(r"<\1\\|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def turn(role: str, text: str) -> tuple[str, str, str]:
    """Opening, content and end of a formatted turn."""
    return f"{OPEN}{escape_role(role)}\n", escape(text), CLOSE


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    return [(unescape_role(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def chained(rows: DataFrame, path: str) -> DataFrame:
    """One row a turn: its node, the tokens before it (position) and its own, and which of them bear loss.

    A task streams its conversations, sorted by turn (ties by role and text), with one running digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, now, key, at, depth = byte_bpe(path), object(), b"", 0, 0
        for batch in batches:
            for part in slices(batch):
                conv, roles, texts = (part.column(c).to_pylist() for c in (0, 2, 3))
                parts = [turn(r or "", t or "") for r, t in zip(roles, texts, strict=True)]
                ids = bpe.encode([x for p in parts for x in p])
                out: list[tuple] = []
                for k, (c, r) in enumerate(zip(conv, roles, strict=True)):
                    if c != now:
                        now, key, at, depth = c, b"", 0, 0
                    head, body, tail = ids[3 * k : 3 * k + 3]
                    # A head has one line end, so head and body can't be confused with those of another turn.
                    key = sha256(key + sha256("".join(parts[k]).encode()).digest()).digest()[:16]
                    n = (len(head) + len(body) + len(tail)) // 4
                    out.append((c, depth, key, at, n, head + body + tail, len(head) // 4, (len(head) + len(body) * ((r or "") == "assistant")) // 4))
                    at, depth = at + n, depth + 1
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names) if out else pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds], names)

    names = ["conv", "depth", "node", "position", "n_tokens", "ids", "loss_from", "loss_to"]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32()]
    dealt = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    return dealt.select("conv", "turn", "role", "text").mapInArrow(run, "conv long, depth int, node binary, position long, n_tokens long, ids binary, loss_from int, loss_to int")


def starts(spark: SparkSession, runs: DataFrame) -> DataFrame:
    """Adds `start`: the tokens of all runs before each in the order of their paths, over any number of tasks."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            before = np.cumsum(n) - n + total
            total += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), pid, np.int32)), pa.array(before), batch.column(1)], ["run", "pid", "before", "length"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = runs.select("run", "length", "path").repartitionByRange(parts, "path").sortWithinPartitions("path")
    local = cut(spark, order.select("run", "length").mapInArrow(number, "run long, pid int, before long, length long"))
    totals = {r.pid: r.n for r in local.groupBy("pid").agg(F.sum("length").alias("n")).collect()}  # one row a task
    base, rows = 0, []
    for pid in sorted(totals):
        rows.append((pid, base))
        base += totals[pid]
    bases = spark.createDataFrame(rows, "pid int, base long")
    return local.join(F.broadcast(bases), "pid").select("run", (F.col("before") + F.col("base")).alias("start"))


def prefix_tree(spark: SparkSession, conversations: DataFrame, path: str, conv_id: str = "conv_id", turn_col: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: nodes, runs and paths.

    nodes: node, run, depth, position, n_tokens, ids (little-endian 32-bit integers), loss_from, loss_to (tokens of an assistant's text).
    runs: run (the conversation that owns it), tree (the run at its root), start and position of its first token, length, attends (stretches
    of the stream [lo, hi) before it that its tokens see beside their own run's earlier ones).
    paths: conv, depth, node; one row a turn.

    A null role or text is empty. Rows of a null conv_id are one conversation, whose conv is NOBODY. Equal turn numbers are ordered by role and text;
    repeated rows are turns of their own. Equal conversations share all nodes, and only the least one has a run. An empty table gives empty tables.
    """
    rows = conversations.select(F.coalesce(F.col(conv_id).cast("long"), F.lit(NOBODY)).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    turns = cut(spark, chained(rows, path))
    paths = turns.select("conv", "depth", "node")
    owners = turns.groupBy("node").agg(F.min("conv").alias("run"))
    # Of each node the owner's row has the tokens, and no other is read for it.
    nodes = cut(spark, turns.join(owners.select("node", F.col("run").alias("conv")), ["node", "conv"]).select("node", F.col("conv").alias("run"), "depth", "position", "n_tokens", "ids", "loss_from", "loss_to"))
    owned = paths.join(nodes.select("node", "run", "n_tokens"), "node").groupBy("conv", "run").agg(F.min("depth").alias("depth"), F.sum("n_tokens").alias("n"))
    entry = F.struct((-F.col("depth")).alias("up"), F.col("run").alias("run"), F.col("n").alias("n"))
    by_conv = owned.groupBy("conv").agg(F.reverse(F.array_sort(F.collect_list(entry))).alias("of"))
    last = F.element_at("of", -1)
    made = by_conv.where(last["run"] == F.col("conv"))
    before = F.slice("of", F.lit(1), F.size("of") - 1)
    runs = cut(
        spark,
        made.select(
            F.col("conv").alias("run"),
            F.col("of")[0]["run"].alias("tree"),
            F.aggregate(before, F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("position"),
            last["n"].alias("length"),
            F.transform("of", lambda x: F.struct(x["up"].alias("up"), x["run"].alias("run"))).alias("path"),
            F.transform(before, lambda x: F.struct(x["run"].alias("run"), x["n"].alias("n"))).alias("above"),
        ),
    )
    start = cut(spark, starts(spark, runs))
    above = runs.select("run", F.explode("above").alias("a")).select("run", F.col("a.run").alias("of"), F.col("a.n").alias("n"))
    sees = above.join(start.select(F.col("run").alias("of"), F.col("start").alias("lo")), "of").groupBy("run").agg(F.array_sort(F.collect_list(F.struct("lo", (F.col("lo") + F.col("n")).alias("hi")))).alias("attends"))
    none = F.array().cast("array<struct<lo:long,hi:long>>")
    listed = runs.select("run", "tree", "position", "length").join(start, "run").join(sees, "run", "left").select("run", "tree", "start", "position", "length", F.coalesce("attends", none).alias("attends"))
    return nodes, listed, paths


def read_back(nodes: DataFrame, runs: DataFrame, paths: DataFrame, path: str) -> DataFrame:
    """Digests of each conversation, read from the emitted stream alone: what its last turn's tokens attend to, and its own run up to its end.

    The stretches of a conversation are taken from the stream by their starts, decoded, parsed and unescaped in that order. Each token must have the
    position that its place in them gives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, now, state = byte_bpe(path), None, None

        def row(conv, s):
            return {"conv": conv, "n_turns": s[0], "turns_sha256": s[1].hexdigest(), "loss_chars": s[2], "loss_sha256": s[3].hexdigest(), "formatted_chars": s[4], "n_tokens": s[5], "n_shared_tokens": s[6]}

        for batch in batches:
            for part in slices(batch):
                out = []
                for conv, owner, at, ids, lo, hi in zip(*(part.column(c).to_pylist() for c in (0, 1, 2, 3, 4, 5)), strict=True):
                    if state is None or conv != now:
                        if state:
                            out.append(row(now, state))
                        now, state = conv, [0, sha256(), 0, sha256(), 0, 0, 0]
                    if at != state[5]:
                        raise ValueError(f"conversation {conv}: position {at} after {state[5]} tokens")
                    formatted = bpe.decode(ids)
                    for r, t in parse(formatted):
                        state[0] += 1
                        state[1].update(f"{r}\n{t}\n".encode())
                    loss = unescape(bpe.decode(ids[4 * lo : 4 * hi]))
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                    state[4] += len(formatted)
                    state[5] += len(ids) // 4
                    state[6] += len(ids) // 4 if owner != conv else 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
        if state:
            yield pa.RecordBatch.from_pylist([row(now, state)], schema=schema)

    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_shared_tokens"]
    schema = pa.schema([(n, pa.string() if "sha256" in n else pa.int64()) for n in names])
    # A node's place in the stream is its run's start and what the run holds before it.
    begins = runs.select("run", "start", F.col("position").alias("first"), "attends")
    stream = nodes.join(begins.drop("attends"), "run").select("run", F.col("start").alias("lo"), (F.col("start") + F.col("position") - F.col("first")).alias("start"), "position", "ids", "loss_from", "loss_to")
    ends = paths.groupBy("conv").agg(F.max_by("node", "depth").alias("node")).join(nodes.select("node", "run", (F.col("position") + F.col("n_tokens")).alias("end")), "node").join(begins, "run")
    own = F.struct(F.col("start").alias("lo"), (F.col("start") + F.col("end") - F.col("first")).alias("hi"))
    seen = ends.select("conv", F.posexplode(F.concat("attends", F.array(own))).alias("nth", "stretch")).select("conv", "nth", "stretch.lo", "stretch.hi")
    read = seen.join(stream, "lo").where("start < hi").select("conv", "run", "position", "ids", "loss_from", "loss_to", "nth", "start")
    whole = read.repartition("conv").sortWithinPartitions("conv", "nth", "start")
    return whole.mapInArrow(run, ", ".join(f"{n} {'string' if 'sha256' in n else 'long'}" for n in names))


def report(spark: SparkSession, conversations: DataFrame, path: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation and of conversation -1, which says control strings."""
    said = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    asked = conversations.select(*[F.col(n).cast(k).alias(n) for n, k in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))])
    back = read_back(*prefix_tree(spark, asked.unionByName(more), path), path)
    return back.select(F.when(F.col("conv") != NOBODY, F.col("conv")).alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_shared_tokens")
