"""Graph operators over labelled forests (nodes: prog, node, type, span; edges: prog, src, dst) and plain edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import FOREST, forest, table, written
from . import programs
from .triangles import triangles

TOP, NEAREST, RADIUS = 10, 10, 3


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select("prog", F.col("src").alias("node")).unionByName(edges.select("prog", F.col("dst").alias("node")))
    return ends.groupBy("prog", "node").agg(F.count("*").alias("degree"))


def top_degree(edges: DataFrame, n: int = TOP) -> DataFrame:
    w = Window.partitionBy("prog").orderBy(F.desc("degree"), "node")
    return degrees(edges).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def neighbourhoods(edges: DataFrame, anchors: DataFrame, radius: int = RADIUS, nearest: int = NEAREST) -> DataFrame:
    """prog, anchor, node, hop: the nodes nearest to each anchor along out-edges, ties by id."""
    reached = [anchors.select("prog", F.col("node").alias("anchor"), "node", F.lit(0).alias("hop"))]
    for hop in range(1, radius + 1):
        reached.append(reached[-1].join(edges, (F.col("node") == F.col("src")) & (edges["prog"] == reached[-1]["prog"])).select(reached[-1]["prog"], "anchor", F.col("dst").alias("node"), F.lit(hop).alias("hop")))
    out = reached[0]
    for r in reached[1:]:
        out = out.unionByName(r)
    w = Window.partitionBy("prog", "anchor").orderBy("hop", "node")
    return out.groupBy("prog", "anchor", "node").agg(F.min("hop").alias("hop")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= nearest)


def tree_degree_topn(spark, sf_dir):
    return top_degree(forest(spark, sf_dir)[1]).select("prog", "node", "degree", "rank")


def near_top(edges: DataFrame) -> DataFrame:
    """prog, anchor, node, hop, rank: the neighbourhoods of each program's anchors, in one pass over its edges."""
    return programs.members(edges, TOP, RADIUS, NEAREST)


def _khop(spark, sf_dir):
    edges = written(spark, forest(spark, sf_dir)[1])
    return edges, near_top(edges)


def khop_neighbourhoods(spark, sf_dir):
    return near_top(forest(spark, sf_dir)[1])


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends in the same member set; edges of a node to itself are dropped."""
    inside = members.select("prog", "anchor", F.col("node").alias("src")).join(edges.where("src <> dst"), ["prog", "src"])
    return inside.join(members.select("prog", "anchor", F.col("node").alias("dst")), ["prog", "anchor", "dst"], "left_semi")


def induced_edges(spark, sf_dir):
    return programs.inner_edges(forest(spark, sf_dir)[1], TOP, RADIUS, NEAREST)


def radial(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Successors and predecessors of a member set that aren't members."""
    both = edges.select("prog", F.col("src").alias("node"), F.col("dst").alias("next")).unionByName(edges.select("prog", F.col("dst").alias("node"), F.col("src").alias("next")))
    near = members.select("prog", "anchor", "node").join(both, ["prog", "node"]).select("prog", "anchor", F.col("next").alias("node")).distinct()
    return near.join(members.select("prog", "anchor", "node"), ["prog", "anchor", "node"], "left_anti")


def radial_frontier(spark, sf_dir):
    edges, members = _khop(spark, sf_dir)
    return radial(edges, members).groupBy("prog", "anchor").agg(F.count("*").alias("n"), F.min("node").alias("least"))


def roots_of(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """id, root (least id reachable), by contraction: each node moves to the least of its neighbours' least, edges follow, and those within one node go.

    The least id of a component never moves, and each round's edges are those between what the round before left; the moves are put together from the last, the smallest, back.
    """
    e = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v")
    moves = []
    while moves == [] or not e.isEmpty():
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select(F.col("x.u").alias("id"), F.col("x.v").alias("v"))
        near = written(spark, both.groupBy("id").agg(F.least("id", F.min("v")).alias("to")))
        # A node's least neighbour has moved too.
        jump = written(spark, near.join(near.select(F.col("id").alias("to"), F.col("to").alias("next")), "to").select("id", F.col("next").alias("to")))
        moves.append(jump)
        for c in ("u", "v"):
            e = e.join(jump.select(F.col("id").alias(c), F.col("to").alias(f"{c}_to")), c).drop(c).withColumnRenamed(f"{c}_to", c)
        e = written(spark, e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct())
    root = moves.pop().withColumnRenamed("to", "root")
    while moves:
        root = moves.pop().join(root.select(F.col("id").alias("to"), "root"), "to", "left").select("id", F.coalesce("root", "to").alias("root"))
    return root


def components(lines: DataFrame) -> DataFrame:
    """Components of orders (even ids) and parts (odd ids) linked by lines."""
    found = roots_of(lines.sparkSession, lines.select((F.col("l_orderkey") * 2).alias("u"), (F.col("l_partkey") * 2 + 1).alias("v")))
    return found.select("id", "root")


def connected_components(spark, sf_dir):
    return components(table(spark, sf_dir, "lineitem"))


def pagerank(edges: DataFrame, rounds: int = 5, alpha: float = 0.85) -> DataFrame:
    """Power iterations over a directed edge table (u, v); nodes without out-edges spread evenly."""
    nodes = edges.select(F.col("u").alias("id")).union(edges.select("v")).distinct()
    out = edges.groupBy("u").agg(F.count("*").alias("d"))
    n = nodes.agg(F.count("*").alias("n"))
    rank = nodes.join(F.broadcast(n), F.lit(True)).join(out.withColumnRenamed("u", "id"), "id", "left").select("id", "n", "d", (1.0 / F.col("n")).alias("r"))
    for _ in range(rounds):
        loose = rank.agg(F.coalesce(F.sum(F.when(F.col("d").isNull(), F.col("r"))), F.lit(0.0)).alias("loose"))
        got = edges.join(rank.select(F.col("id").alias("u"), (F.col("r") / F.col("d")).alias("s")), "u").groupBy(F.col("v").alias("id")).agg(F.sum("s").alias("s"))
        rank = rank.join(got, "id", "left").join(F.broadcast(loose), F.lit(True)).select("id", "n", "d", ((1 - alpha) / F.col("n") + alpha * (F.coalesce("s", F.lit(0.0)) + F.col("loose") / F.col("n"))).alias("r"))
    return rank


def _places(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return (
        t("nation").select(name("n", "n_nationkey").alias("u"), name("r", "n_regionkey").alias("v"))
        .union(t("customer").select(name("c", "c_custkey"), name("n", "c_nationkey")))
        .union(t("supplier").select(name("s", "s_suppkey"), name("n", "s_nationkey")))
    )


def pagerank_fixed_iters(spark, sf_dir):
    return pagerank(_places(spark, sf_dir), 3).select("id", F.round("r", 9).alias("r"))


def clustering(lines: DataFrame) -> DataFrame:
    """Of parts sold in one order: triangles over pairs of neighbours."""
    spark = lines.sparkSession
    b = lines.select("l_orderkey", "l_partkey").repartition("l_orderkey").distinct()
    pairs = b.select("l_orderkey", F.col("l_partkey").alias("a")).join(b.select("l_orderkey", F.col("l_partkey").alias("b")), "l_orderkey").where("a < b").select("a", "b")
    e = written(spark, pairs.distinct())
    degree = written(spark, e.select(F.explode(F.array("a", "b")).alias("a")).groupBy("a").agg(F.count("*").alias("d")))
    # Every edge leads from its end of lower degree to the other: an end has few such edges, however hot it is, and a triangle is found once.
    rank = lambda c, d: degree.select(F.col("a").alias(c), F.struct(F.col("d"), F.col("a").alias("i")).alias(d))
    ranked = e.join(rank("a", "ra"), "a").join(rank("b", "rb"), "b")
    first = F.col("ra") < F.col("rb")
    out = ranked.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v"))
    return degree.join(triangles(out, e.count()), "a", "left").select(F.col("a").alias("part"), F.round(F.when(F.col("d") > 1, 2 * F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0), 6).alias("c"))


def clustering_coefficient(spark, sf_dir):
    return clustering(table(spark, sf_dir, "lineitem"))


def wl_colours(nodes: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """prog, hash: colours are refined by those of the children; a tree's hash is that of its sorted colours. Labels aren't looked at."""
    colour = nodes.select("prog", "node", F.md5(F.when(F.col("node") == 0, "1").otherwise("0")).alias("c"))
    for _ in range(rounds):
        below = edges.join(colour.select("prog", F.col("node").alias("dst"), "c"), ["prog", "dst"]).groupBy("prog", F.col("src").alias("node")).agg(F.array_join(F.array_sort(F.collect_list("c")), ",").alias("of"))
        colour = colour.join(below, ["prog", "node"], "left").select("prog", "node", F.md5(F.concat("c", F.lit("|"), F.coalesce("of", F.lit("")))).alias("c"))
    return colour.groupBy("prog").agg(F.md5(F.array_join(F.array_sort(F.collect_list("c")), ",")).alias("hash"))


def wl_hash(spark, sf_dir):
    return wl_colours(*forest(spark, sf_dir), 3)


def seed_pattern_match(spark, sf_dir):
    """Matches of order[F] with a child line[NO]... by labels: one join a pattern edge."""
    nodes, edges = forest(spark, sf_dir)
    head = nodes.where("type = 'order' and span = 'F'").select("prog", F.col("node").alias("src"))
    leaf = nodes.where("type = 'line' and span = 'AF'").select("prog", F.col("node").alias("dst"))
    return edges.join(head, ["prog", "src"]).join(leaf, ["prog", "dst"]).groupBy("prog").agg(F.count("*").alias("matches"), F.min("src").alias("first"))


def multi_seed_match(spark, sf_dir):
    """Trees in which every seed label occurs, and the least node of each."""
    nodes = forest(spark, sf_dir)[0]
    hit = nodes.where("span in ('F', 'AF', 'RF')").groupBy("prog", "span").agg(F.min("node").alias("node"))
    return hit.groupBy("prog").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("node")), ",").alias("nodes")).where("n = 3").select("prog", "nodes")


def sibling_ordinals(spark, sf_dir):
    edges = forest(spark, sf_dir)[1]
    return edges.select("prog", F.col("dst").alias("node"), (F.row_number().over(Window.partitionBy("prog", "src").orderBy("dst")) - 1).alias("relpos"))


_F = "WITH " + FOREST
_DEG = "deg AS (SELECT prog, node, count(*) AS degree FROM (SELECT prog, src AS node FROM edges UNION ALL SELECT prog, dst FROM edges) GROUP BY ALL), top AS (SELECT *, row_number() OVER (PARTITION BY prog ORDER BY degree DESC, node) AS rank FROM deg QUALIFY rank <= 10)"
_HOP = """h0 AS (SELECT prog, node AS anchor, node, 0 AS hop FROM top), h1 AS (SELECT h0.prog, anchor, dst AS node, 1 AS hop FROM h0 JOIN edges ON h0.prog = edges.prog AND node = src),
h2 AS (SELECT h1.prog, anchor, dst AS node, 2 AS hop FROM h1 JOIN edges ON h1.prog = edges.prog AND node = src), h3 AS (SELECT h2.prog, anchor, dst AS node, 3 AS hop FROM h2 JOIN edges ON h2.prog = edges.prog AND node = src),
hood AS (SELECT *, row_number() OVER (PARTITION BY prog, anchor ORDER BY hop, node) AS rank FROM (SELECT prog, anchor, node, min(hop) AS hop FROM (FROM h0 UNION ALL FROM h1 UNION ALL FROM h2 UNION ALL FROM h3) GROUP BY ALL) QUALIFY rank <= 10)"""
_WL = ["c0 AS (SELECT prog, node, md5(CASE WHEN node = 0 THEN '1' ELSE '0' END) AS c FROM nodes)"]
for _k in range(3):
    _WL.append(f"c{_k + 1} AS (SELECT c{_k}.prog, c{_k}.node, md5(c || '|' || coalesce(kids, '')) AS c FROM c{_k} LEFT JOIN (SELECT edges.prog, src AS node, string_agg(c, ',' ORDER BY c) AS kids FROM edges JOIN c{_k} ON edges.prog = c{_k}.prog AND dst = c{_k}.node GROUP BY ALL) AS k USING (prog, node))")
_PR = ["e AS (SELECT 'n' || n_nationkey AS u, 'r' || n_regionkey AS v FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)", "i AS (SELECT u AS id FROM e UNION SELECT v FROM e)", "o AS (SELECT u, count(*) AS d FROM e GROUP BY 1)", "r0 AS (SELECT id, d, 1.0::DOUBLE / (SELECT count(*) FROM i) AS r FROM i LEFT JOIN o ON u = id)"]
for _k in range(3):
    _PR.append(f"r{_k + 1} AS (SELECT id, d, 0.15::DOUBLE / (SELECT count(*) FROM i) + 0.85::DOUBLE * (coalesce(s, 0) + (SELECT sum(r) FROM r{_k} WHERE d IS NULL) / (SELECT count(*) FROM i)) AS r FROM r{_k} LEFT JOIN (SELECT v, sum(r / d) AS s FROM e JOIN r{_k} ON id = u GROUP BY 1) ON v = id)")

SQL = {
    "tree_degree_topn": f"{_F}, {_DEG} SELECT prog, node, degree, rank FROM top",
    "khop_neighbourhoods": f"{_F}, {_DEG}, {_HOP} SELECT prog, anchor, node, hop, rank FROM hood",
    "induced_edges": f"{_F}, {_DEG}, {_HOP} SELECT a.prog, a.anchor, src, dst FROM hood AS a JOIN edges ON a.prog = edges.prog AND a.node = src JOIN hood AS b ON b.prog = a.prog AND b.anchor = a.anchor AND b.node = dst WHERE src <> dst",
    "radial_frontier": f"{_F}, {_DEG}, {_HOP}, f AS (SELECT hood.prog, anchor, dst AS node FROM hood JOIN edges ON hood.prog = edges.prog AND node = src UNION SELECT hood.prog, anchor, src FROM hood JOIN edges ON hood.prog = edges.prog AND node = dst EXCEPT SELECT prog, anchor, node FROM hood) SELECT prog, anchor, count(*) AS n, min(node) AS least FROM f GROUP BY ALL",
    "pagerank_fixed_iters": "WITH " + ", ".join(_PR) + " SELECT id, round(r, 9) AS r FROM r3",
    "clustering_coefficient": """WITH b AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), e AS (SELECT DISTINCT x.l_partkey AS a, y.l_partkey AS b FROM b AS x JOIN b AS y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey),
s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), d AS (SELECT a, count(*) AS d FROM s GROUP BY 1), t AS (SELECT x.a, count(*) AS t FROM s AS x JOIN s AS y ON x.a = y.a AND x.b < y.b JOIN e ON e.a = x.b AND e.b = y.b GROUP BY 1)
SELECT a AS part, round(CASE WHEN d > 1 THEN 2 * coalesce(t, 0) / (d * (d - 1))::DOUBLE ELSE 0.0 END, 6) AS c FROM d LEFT JOIN t USING (a)""",
    "wl_hash": f"{_F}, {', '.join(_WL)} SELECT prog, md5(string_agg(c, ',' ORDER BY c)) AS hash FROM c3 GROUP BY 1",
    "seed_pattern_match": f"{_F} SELECT e.prog, count(*) AS matches, min(src) AS first FROM edges AS e JOIN nodes AS a ON a.prog = e.prog AND a.node = src JOIN nodes AS b ON b.prog = e.prog AND b.node = dst WHERE a.type = 'order' AND a.span = 'F' AND b.type = 'line' AND b.span = 'AF' GROUP BY 1",
    "multi_seed_match": f"{_F}, h AS (SELECT prog, span, min(node) AS node FROM nodes WHERE span IN ('F', 'AF', 'RF') GROUP BY ALL) SELECT prog, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS nodes FROM h GROUP BY 1 HAVING count(*) = 3",
    "sibling_ordinals": f"{_F} SELECT prog, dst AS node, CAST(row_number() OVER (PARTITION BY prog, src ORDER BY dst) - 1 AS INTEGER) AS relpos FROM edges",
}
QUERIES = {f.__name__: f for f in (tree_degree_topn, khop_neighbourhoods, induced_edges, radial_frontier, connected_components, pagerank_fixed_iters, clustering_coefficient, wl_hash, seed_pattern_match, multi_seed_match, sibling_ordinals)}
