"""Patterns, samples, message passing and projections over labelled forests and vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import code
from ..sources import files
from ..sources.tables import FOREST, forest, forest_rows, table, written
from . import programs
from .code import _TRUNC
from .text import SQL as TEXT_SQL
from .text import context_window
from .trees import _DEG, _HOP, NEAREST, RADIUS, TOP, induced, near_top, top_degree
from .vectors import vectors

#: A pattern is a tree: (node, parent, type, span) with parents first; None fits any span.
PATTERN = [(0, None, "customer", None), (1, 0, "order", "F"), (2, 1, "line", "AF"), (3, 1, "line", "RF")]
TRIALS, STEPS = 100, 5


def match_pattern(nodes: DataFrame, edges: DataFrame, pattern: list[tuple]) -> DataFrame:
    """prog, n0, n1, ...: every place of the pattern, by one join a pattern edge; type and span of each node agree, and no node is used twice."""

    def labelled(k: int, kind: str, span: str | None) -> DataFrame:
        hit = nodes.where(F.col("type") == kind)
        return (hit if span is None else hit.where(F.col("span") == span)).select("prog", F.col("node").alias(f"n{k}"))

    k, _, kind, span = pattern[0]
    out = labelled(k, kind, span)
    for k, parent, kind, span in pattern[1:]:
        step = edges.select("prog", F.col("src").alias(f"n{parent}"), F.col("dst").alias(f"n{k}"))
        out = out.join(step, ["prog", f"n{parent}"]).join(labelled(k, kind, span), ["prog", f"n{k}"])
        for other, up, _, _ in pattern[:k]:
            if up == parent and other != pattern[0][0]:
                out = out.where(F.col(f"n{k}") != F.col(f"n{other}"))
    return out.select("prog", *[f"n{k}" for k, *_ in pattern])


def pattern_match_tree(spark, sf_dir):
    return match_pattern(*forest(spark, sf_dir), PATTERN)


def pattern_first_match(spark, sf_dir):
    """One match a program: the least."""
    m = match_pattern(*forest(spark, sf_dir), PATTERN)
    return m.groupBy("prog").agg(F.min(F.struct("n0", "n1", "n2", "n3")).alias("m")).select("prog", "m.n0", "m.n1", "m.n2", "m.n3")


def patterns_all_match(spark, sf_dir):
    """Programs in which every pattern matches, and the nodes of all matches together."""
    nodes, edges = forest(spark, sf_dir)
    seeds = [[(0, None, "order", "F"), (1, 0, "line", "AF")], [(0, None, "order", "O"), (1, 0, "line", "NO")]]
    hits = None
    for k, seed in enumerate(seeds):
        m = match_pattern(nodes, edges, seed)
        h = m.select("prog", F.lit(k).alias("seed"), F.explode(F.array("n0", "n1")).alias("node"))
        hits = h if hits is None else hits.unionByName(h)
    hits = hits.distinct()
    return hits.groupBy("prog").agg(F.countDistinct("seed").alias("seeds"), F.countDistinct("node").alias("n"), F.min("node").alias("least"), F.max("node").alias("most")).where(F.col("seeds") == len(seeds)).drop("seeds")


def remove_nodes(spark, sf_dir):
    """What is left of each program without its open orders and every edge that touches one."""
    nodes, edges = forest(spark, sf_dir)
    gone = nodes.where("type = 'order' and span = 'O'").select("prog", "node")
    left = nodes.join(gone, ["prog", "node"], "left_anti").groupBy("prog").agg(F.count("*").alias("nodes"))
    kept = edges.join(gone.withColumnRenamed("node", "src"), ["prog", "src"], "left_anti").join(gone.withColumnRenamed("node", "dst"), ["prog", "dst"], "left_anti").groupBy("prog").agg(F.count("*").alias("edges"))
    return left.join(kept, "prog", "left").select("prog", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"))


def _hoods(spark, sf_dir):
    edges = forest(spark, sf_dir)[1]
    return edges, near_top(edges)


def component_roots(spark, sf_dir):
    """The first member of each neighbourhood that no other member leads to."""
    return programs.roots(forest(spark, sf_dir)[1], TOP, RADIUS, NEAREST)


def connected_idioms(spark, sf_dir):
    """Neighbourhoods that hang together (of n members in a forest n - 1 edges) and have at least two direct neighbours."""
    edges, members = _hoods(spark, sf_dir)
    n = members.groupBy("prog", "anchor").agg(F.count("*").alias("size"), F.count_if(F.col("hop") == 1).alias("nhoods"))
    e = induced(edges, members).groupBy("prog", "anchor").agg(F.count("*").alias("edges"))
    return n.join(e, ["prog", "anchor"]).where("edges = size - 1 and nhoods >= 2").select("prog", "anchor", "size", "nhoods")


def membership_flags(spark, sf_dir):
    """Nodes of each program, and how many belong to the neighbourhood of its first anchor."""
    edges, members = _hoods(spark, sf_dir)
    first = top_degree(edges, 1).select("prog", F.col("node").alias("anchor"))
    inside = members.join(first, ["prog", "anchor"]).select("prog", "node", F.lit(1).alias("is_idiom"))
    return forest(spark, sf_dir)[0].join(inside, ["prog", "node"], "left").groupBy("prog").agg(F.count("*").alias("nodes"), F.count("is_idiom").alias("inside"))


def wl_of_sets(edges: DataFrame, members: DataFrame, rounds: int = 3) -> DataFrame:
    """prog, anchor, size, hash of the subgraph that each member set induces: colours refined by those of out- and in-neighbours; a set's hash sums digests, so no set is gathered.

    The anchor has a colour of its own.
    """
    spark = edges.sparkSession
    members = written(spark, members.select("prog", "anchor", "node"))
    e = written(spark, induced(edges, members).select("prog", "anchor", "src", "dst"))
    both = e.select("prog", "anchor", F.col("src").alias("node"), F.col("dst").alias("next")).unionByName(e.select("prog", "anchor", F.col("dst").alias("node"), F.col("src").alias("next")))
    number = lambda c: F.conv(F.substring(F.md5(c), 1, 12), 16, 10).cast("long")
    colour = members.select("prog", "anchor", "node", number(F.when(F.col("node") == F.col("anchor"), "1").otherwise("0")).alias("c"))
    for _ in range(rounds):
        near = both.join(colour.select("prog", "anchor", F.col("node").alias("next"), "c"), ["prog", "anchor", "next"]).groupBy("prog", "anchor", "node").agg(F.sum("c").alias("s"))
        colour = colour.join(near, ["prog", "anchor", "node"], "left").select("prog", "anchor", "node", number(F.concat_ws("|", F.col("c").cast("string"), F.coalesce("s", F.lit(0)).cast("string"))).alias("c"))
    return colour.groupBy("prog", "anchor").agg(F.count("*").alias("size"), F.sum("c").alias("hash"))


def neighbourhood_clusters(spark, sf_dir):
    """Neighbourhoods by the hash of the subgraphs that they induce: members of each shape and size."""
    return programs.shapes(forest(spark, sf_dir)[1], TOP, RADIUS, NEAREST)


def mining_seeds(spark, sf_dir):
    """Starts of mining: programs drawn by size and a node of each, which is one node drawn of all; with the nodes that it leads to."""
    nodes, edges = forest(spark, sf_dir)
    drawn = files.drawn_with_replacement(nodes, ["prog", "node"], TRIALS, 24)
    out = edges.where("src <> dst").groupBy("prog", F.col("src").alias("node")).agg(F.count("*").alias("frontier"), F.min("dst").alias("least"))
    return drawn.join(out, ["prog", "node"], "left").select("draw", "prog", "node", F.coalesce("frontier", F.lit(0)).alias("frontier"), "least")


def sampled_subgraphs(nodes: DataFrame, edges: DataFrame, size: int, seed: int) -> DataFrame:
    """prog, step, node: a connected part of each program, from a drawn start, at each step the frontier node that comes first by digest."""
    return programs.grown_parts(programs.rows_of(nodes, edges), size, seed)


def sampled_neighbourhoods(spark, sf_dir):
    return programs.grown_parts(forest_rows(spark, sf_dir), STEPS, 7)


def training_pairs(spark, sf_dir):
    """Pairs for an order embedding: the first three nodes of a sampled part within the whole part (pos), and within the part of another program (neg)."""
    s = sampled_neighbourhoods(spark, sf_dir).groupBy("prog").agg(F.array_sort(F.collect_list(F.struct("step", "node"))).alias("s"))
    s = written(spark, files.numbered(s.where(F.size("s") == STEPS).select("prog", F.transform("s", lambda x: x["node"]).alias("part")), "prog"))
    n = s.agg(F.count("*").alias("n"))
    other = s.select((F.col("idx") + 1).alias("idx"), F.col("prog").alias("target_prog"), F.col("part").alias("target"))
    pos = s.select(F.lit("pos").alias("kind"), "prog", F.col("prog").alias("target_prog"), F.slice("part", 1, 3).alias("query"), F.col("part").alias("target"))
    wrapped = other.join(F.broadcast(n), F.lit(True)).select((F.col("idx") % F.col("n")).alias("idx"), "target_prog", "target")
    neg = s.join(wrapped, "idx").where("prog <> target_prog").select(F.lit("neg").alias("kind"), "prog", "target_prog", F.slice("part", 1, 3).alias("query"), "target")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return pos.unionByName(neg).select("kind", "prog", "target_prog", text("query").alias("query"), text("target").alias("target"))


def gin_layer(h: DataFrame, edges: DataFrame, eps: float) -> DataFrame:
    """prog, node, h: (1 + eps) times a node's state and the sum of its neighbours'."""
    both = edges.select("prog", "src", "dst").unionByName(edges.select("prog", F.col("dst").alias("src"), F.col("src").alias("dst")))
    got = both.join(h.select("prog", F.col("node").alias("src"), "h"), ["prog", "src"]).groupBy("prog", F.col("dst").alias("node")).agg(F.sum("h").alias("s"))
    return h.join(got, ["prog", "node"], "left").select("prog", "node", ((1 + eps) * F.col("h") + F.coalesce("s", F.lit(0.0))).alias("h"))


def gin_pool(spark, sf_dir):
    """Two layers over states by type, summed up a program."""
    nodes, edges = forest(spark, sf_dir)
    h = nodes.select("prog", "node", F.when(F.col("type") == "customer", 1.0).when(F.col("type") == "order", 0.5).otherwise(0.25).alias("h"))
    for _ in range(2):
        h = gin_layer(h, edges, 0.1)
    return h.groupBy("prog").agg(F.round(F.sum("h"), 6).alias("pooled"))


def feature_hstack(spark, sf_dir):
    """Vectors with further features behind: the label and the sum of the components."""
    v = vectors(spark, sf_dir).select("vec_id", F.concat("e", F.array(F.col("label").cast("double"), F.aggregate("e", F.lit(0.0), lambda a, x: a + x))).alias("f"))
    return v.select("vec_id", F.size("f").alias("n"), F.round(F.col("f")[64], 6).alias("label"), F.round(F.col("f")[65], 6).alias("total"))


def moments(v: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and covariance of vectors: each task sums its own, and d * d sums come to the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, ss = 0, None, None
        for b in batches:
            if len(b):
                x = np.stack(list(b["e"]))
                n, s, ss = n + len(x), x.sum(axis=0) + (0 if s is None else s), x.T @ x + (0 if ss is None else ss)
        if n:
            flat = np.concatenate([[n], s, ss.ravel()])
            yield pd.DataFrame({"k": np.arange(len(flat)), "x": flat})

    sums = v.select("e").mapInPandas(run, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()
    flat = np.array([r.x for r in sorted(sums, key=lambda r: r.k)])
    d = int((np.sqrt(4 * len(flat) - 3) - 1) / 2)
    n, mean = int(flat[0]), flat[1 : d + 1] / flat[0]
    return n, mean, flat[d + 1 :].reshape(d, d) / n - np.outer(mean, mean)


def principal(v: DataFrame, k: int) -> DataFrame:
    """vec_id, p: the k coordinates of most variance; each axis points to where its largest part is positive."""
    _, mean, cov = moments(v)
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, :k].T
    axes = axes * np.sign(axes[np.arange(k), np.abs(axes).argmax(axis=1)])[:, None]
    centred = F.zip_with("e", F.array(*map(F.lit, mean.tolist())), lambda a, b: a - b)
    parts = [F.aggregate(F.zip_with(centred, F.array(*map(F.lit, a.tolist())), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) for a in axes]
    return v.select("vec_id", F.array(*parts).alias("p"))


def pca_projection(spark, sf_dir):
    p = principal(vectors(spark, sf_dir), 2)
    return p.select("vec_id", F.round(F.col("p")[0], 4).alias("x"), F.round(F.col("p")[1], 4).alias("y"))


def pca_variance(spark, sf_dir):
    """Each axis' variance, and the whole one (which SQL knows)."""
    p = principal(vectors(spark, sf_dir), 64)
    v = p.select(F.posexplode("p").alias("axis", "x")).groupBy("axis").agg(F.var_pop("x").alias("v"))
    return v.agg(F.round(F.sum("v"), 6).alias("whole"), F.count("*").alias("axes"))


def program_prefix(spark, sf_dir):
    """A sample of the first hundred programs; a negative number stands for all."""
    return table(spark, sf_dir, "customer").select("c_custkey").orderBy("c_custkey").limit(100)


def api_programs(spark, sf_dir):
    """The corpus of an API: snippets about its first line, without outer white space, at most 20,000 drawn by digest."""
    s = context_window(spark, sf_dir).select("doc_id", F.regexp_replace("snippet", r"^\s+|\s+$", "").alias("snippet"))
    return files.drawn(s, "doc_id", 20_000, 42)


def baseline_sizes(spark, sf_dir):
    """How many random vectors a label's baseline has: a tenth of its vectors, at most as many as the query set and the others have."""
    v = vectors(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % 10 == 0).alias("a"), F.count_if(F.col("vec_id") % 10 == 1).alias("b"))
    return v.select("label", F.least(F.round(F.col("n") / 10).cast("long"), "a", "b").alias("k"))


def evaluation_loop(spark, sf_dir):
    """Predictions of each task truncated and judged by a keyword; pass@1 of tasks with any."""
    t = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", code.truncated(F.coalesce("text", F.lit(""))).alias("t"))
    return t.groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("t").contains("the")).alias("c")).withColumn("pass_at_1", F.round(F.col("c") / F.col("n"), 6))


def program_order(spark, sf_dir):
    """A window over one program's nodes: each with its place in the order of ids."""
    w = Window.partitionBy("prog").orderBy("node")
    return forest(spark, sf_dir)[0].select("prog", "node", F.row_number().over(w).alias("place"))


_F = "WITH " + FOREST
_E2 = "(SELECT prog, src, dst FROM edges UNION ALL SELECT prog, dst, src FROM edges)"
_IND = "ind AS (SELECT a.prog, a.anchor, src, dst FROM hood AS a JOIN edges ON a.prog = edges.prog AND a.node = src JOIN hood AS b ON b.prog = a.prog AND b.anchor = a.anchor AND b.node = dst WHERE src <> dst)"
_MATCH = "m AS (SELECT a.prog, a.node AS n0, b.node AS n1, c.node AS n2, d.node AS n3 FROM nodes AS a JOIN edges AS x ON x.prog = a.prog AND x.src = a.node JOIN nodes AS b ON b.prog = a.prog AND b.node = x.dst JOIN edges AS y ON y.prog = a.prog AND y.src = b.node JOIN nodes AS c ON c.prog = a.prog AND c.node = y.dst JOIN edges AS z ON z.prog = a.prog AND z.src = b.node JOIN nodes AS d ON d.prog = a.prog AND d.node = z.dst WHERE a.type = 'customer' AND b.type = 'order' AND b.span = 'F' AND c.type = 'line' AND c.span = 'AF' AND d.type = 'line' AND d.span = 'RF' AND c.node <> d.node)"
_NUM = lambda x: f"CAST('0x' || substr(md5({x}), 1, 12) AS BIGINT)"
_SETS = [f"k0 AS (SELECT prog, anchor, node, {_NUM("CASE WHEN node = anchor THEN '1' ELSE '0' END")} AS c FROM hood)", "nb AS (SELECT prog, anchor, src AS node, dst AS next FROM ind UNION ALL SELECT prog, anchor, dst, src FROM ind)"]
for _k in range(3):
    _SETS.append(f"k{_k + 1} AS (SELECT prog, anchor, node, {_NUM("c || '|' || coalesce(s, 0)")} AS c FROM k{_k} LEFT JOIN (SELECT nb.prog, nb.anchor, nb.node, CAST(sum(c) AS BIGINT) AS s FROM nb JOIN k{_k} AS o ON o.prog = nb.prog AND o.anchor = nb.anchor AND o.node = nb.next GROUP BY ALL) USING (prog, anchor, node))")
_GIN = ["g0 AS (SELECT prog, node, CASE type WHEN 'customer' THEN 1.0::DOUBLE WHEN 'order' THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS h FROM nodes)", f"b AS {_E2}"]
for _k in range(2):
    _GIN.append(f"g{_k + 1} AS (SELECT prog, node, 1.1::DOUBLE * h + coalesce(s, 0) AS h FROM g{_k} LEFT JOIN (SELECT b.prog, b.dst AS node, sum(h) AS s FROM b JOIN g{_k} AS o ON o.prog = b.prog AND o.node = b.src GROUP BY ALL) USING (prog, node))")
_SN = f"SELECT doc_id, regexp_replace(snippet, '^\\s+|\\s+$', '', 'g') AS snippet FROM ({TEXT_SQL['context_window']}) ORDER BY md5('42|' || doc_id), doc_id LIMIT 20000"

SQL = {
    "pattern_match_tree": f"{_F}, {_MATCH} SELECT * FROM m",
    "pattern_first_match": f"{_F}, {_MATCH} SELECT prog, n0, n1, n2, n3 FROM m QUALIFY row_number() OVER (PARTITION BY prog ORDER BY n0, n1, n2, n3) = 1",
    "patterns_all_match": f"{_F}, p AS (SELECT a.prog, a.node AS n0, b.node AS n1, CASE a.span WHEN 'F' THEN 0 ELSE 1 END AS seed FROM nodes AS a JOIN edges AS e ON e.prog = a.prog AND e.src = a.node JOIN nodes AS b ON b.prog = a.prog AND b.node = e.dst WHERE a.type = 'order' AND b.type = 'line' AND (a.span = 'F' AND b.span = 'AF' OR a.span = 'O' AND b.span = 'NO')), h AS (SELECT DISTINCT prog, seed, unnest([n0, n1]) AS node FROM p) SELECT prog, count(DISTINCT node) AS n, min(node) AS least, max(node) AS most FROM h GROUP BY 1 HAVING count(DISTINCT seed) = 2",
    "remove_nodes": f"{_F}, g AS (SELECT prog, node FROM nodes WHERE type = 'order' AND span = 'O') SELECT l.prog, l.n AS nodes, coalesce(k.n, 0) AS edges FROM (SELECT prog, count(*) AS n FROM nodes ANTI JOIN g USING (prog, node) GROUP BY 1) AS l LEFT JOIN (SELECT e.prog, count(*) AS n FROM edges AS e WHERE NOT EXISTS (FROM g WHERE g.prog = e.prog AND (g.node = e.src OR g.node = e.dst)) GROUP BY 1) AS k USING (prog)",
    "component_roots": f"{_F}, {_DEG}, {_HOP}, {_IND} SELECT prog, anchor, min(node) AS root FROM hood WHERE NOT EXISTS (FROM ind WHERE ind.prog = hood.prog AND ind.anchor = hood.anchor AND ind.dst = hood.node) GROUP BY ALL",
    "connected_idioms": f"{_F}, {_DEG}, {_HOP}, {_IND} SELECT n.prog, n.anchor, size, nhoods FROM (SELECT prog, anchor, count(*) AS size, count(*) FILTER (hop = 1) AS nhoods FROM hood GROUP BY ALL) AS n JOIN (SELECT prog, anchor, count(*) AS e FROM ind GROUP BY ALL) AS k ON k.prog = n.prog AND k.anchor = n.anchor WHERE e = size - 1 AND nhoods >= 2",
    "membership_flags": f"{_F}, {_DEG}, {_HOP}, i AS (SELECT h.prog, h.node FROM hood AS h JOIN top ON top.prog = h.prog AND top.node = h.anchor AND top.rank = 1) SELECT nodes.prog, count(*) AS nodes, count(i.node) AS inside FROM nodes LEFT JOIN i ON i.prog = nodes.prog AND i.node = nodes.node GROUP BY 1",
    "neighbourhood_clusters": f"{_F}, {_DEG}, {_HOP}, {_IND}, {', '.join(_SETS)} SELECT size, hash, count(*) AS members, min(prog) AS first FROM (SELECT prog, anchor, count(*) AS size, CAST(sum(c) AS BIGINT) AS hash FROM k3 GROUP BY ALL) GROUP BY ALL",
    "mining_seeds": f"{_F}, n AS (SELECT prog, node, row_number() OVER (ORDER BY prog, node) - 1 AS i, count(*) OVER () AS total FROM nodes) SELECT d AS draw, n.prog, n.node, count(dst) AS frontier, min(dst) AS least FROM range({TRIALS}) AS r(d) JOIN n ON n.i = CAST('0x' || substr(md5('24|' || d), 1, 12) AS BIGINT) % total LEFT JOIN edges ON edges.prog = n.prog AND src = n.node AND src <> dst GROUP BY ALL",
    "gin_pool": f"{_F}, {', '.join(_GIN)} SELECT prog, round(sum(h), 6) AS pooled FROM g2 GROUP BY 1",
    "feature_hstack": "SELECT vec_id, 66 AS n, round(label::DOUBLE, 6) AS label, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings",
    "pca_variance": "SELECT round(sum(v), 6) AS whole, count(*) AS axes FROM (SELECT k, var_pop(x) AS v FROM (SELECT unnest(range(64)) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1)",
    "program_prefix": "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 100",
    "api_programs": _SN,
    "baseline_sizes": "SELECT label, least(CAST(floor(n / 10.0 + 0.5) AS BIGINT), a, b) AS k FROM (SELECT label, count(*) AS n, count(*) FILTER (vec_id % 10 = 0) AS a, count(*) FILTER (vec_id % 10 = 1) AS b FROM embeddings GROUP BY 1)",
    "evaluation_loop": f"SELECT conv_id, n, c, round(c / n::DOUBLE, 6) AS pass_at_1 FROM (SELECT conv_id, count(*) AS n, count(*) FILTER (contains({_TRUNC("coalesce(text, '')")}, 'the')) AS c FROM conversations WHERE role = 'assistant' GROUP BY 1)",
    "program_order": f"{_F} SELECT prog, node, CAST(row_number() OVER (PARTITION BY prog ORDER BY node) AS INTEGER) AS place FROM nodes",
}

QUERIES = {f.__name__: f for f in (pattern_match_tree, pattern_first_match, patterns_all_match, remove_nodes, component_roots, connected_idioms, membership_flags, neighbourhood_clusters, mining_seeds, sampled_neighbourhoods, training_pairs, gin_pool, feature_hstack, pca_projection, pca_variance, program_prefix, api_programs, baseline_sizes, evaluation_loop, program_order)}
