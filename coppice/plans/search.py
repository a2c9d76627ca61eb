"""Idiom search by beams over a labelled forest: encode, count containing neighbourhoods, grow, report.

Subgraphs are encoded as counts of structural tokens in 64 buckets, so a part's counts never exceed its whole's: what contains an idiom is never missed.
Candidates and neighbourhoods with equal counts are scored once; a generation is one plan over all beams, and ends in a written table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import programs, tiles
from ..operators.trees import _DEG, _HOP, NEAREST, RADIUS, TOP
from ..sources.tables import FOREST, forest_rows, written

BUCKETS = 64


@dataclass(frozen=True)
class Config:
    seed: str = "F"
    min_size: int = 3
    max_size: int = 30
    max_holes: int = 8
    max_init_beams: int = 200
    n_beams: int = 1
    stop_at_equilibrium: bool = False


def bucket(token: Column) -> Column:
    return F.conv(F.substring(F.md5(token), 1, 2), 16, 10).cast("int") % BUCKETS


def labelled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with parent and its parent (over), their labels, and holes (children)."""
    up = edges.join(nodes.select("prog", F.col("node").alias("src"), F.col("type").alias("up"), F.col("span").alias("up_span")), ["prog", "src"]).select("prog", F.col("dst").alias("node"), F.col("src").alias("parent"), "up", "up_span")
    # One row a node: order 0's node has the root's id.
    over = up.groupBy("prog", F.col("node").alias("parent")).agg(F.min(F.struct("parent", "up")).alias("o")).select("prog", "parent", F.col("o.parent").alias("over"), F.col("o.up").alias("over_type"))
    up = up.join(over, ["prog", "parent"], "left")
    kids = edges.groupBy("prog", F.col("src").alias("node")).agg(F.count("*").cast("int").alias("holes"), F.array_sort(F.collect_list("dst")).alias("kids"))
    return nodes.join(up, ["prog", "node"], "left").join(kids, ["prog", "node"], "left").select("prog", "node", "type", "span", "parent", "up", "up_span", "over", "over_type", F.coalesce("holes", F.lit(0)).alias("holes"), F.coalesce("kids", F.array().cast("array<long>")).alias("kids"))


def encode(members: DataFrame, nodes: DataFrame, key: list[str], whole: bool = True) -> DataFrame:
    """key, phi: counts by bucket of node, edge and 2-path tokens of each member set (prog, key.., node, all: its nodes); not whole: without edges with spans and 2-paths."""
    m = members.join(nodes, ["prog", "node"])
    inside = F.array_contains("all", F.col("parent"))
    tokens = [F.col("type"), F.concat_ws("|", "type", "span"), F.when(inside, F.concat_ws(">", "up", "type"))]
    if whole:
        tokens.append(F.when(inside, F.concat_ws(">", F.concat_ws("|", "up", "up_span"), F.concat_ws("|", "type", "span"))))
        tokens.append(F.when(inside & F.array_contains("all", F.col("over")), F.concat_ws(">", "over_type", "up", "type")))
    tokens = F.array(*tokens)
    counts = m.select(*key, F.explode(F.filter(tokens, lambda x: x.isNotNull())).alias("token")).groupBy(*key, bucket(F.col("token")).alias("b")).agg(F.count("*").alias("n"))
    at = F.map_from_entries(F.collect_list(F.struct("b", "n")))
    return counts.groupBy(*key).agg(at.alias("m")).select(*key, F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0)).cast("int")).alias("phi"))


def corpus_of(rows: DataFrame) -> DataFrame:
    """Encodings of all neighbourhoods, and how many have each: phi, n."""
    return programs.phi_counts(rows, TOP, RADIUS, NEAREST)


class Contained(tiles.Pairs):
    """phi, score of each query in a task: how many neighbourhoods (their numbers are the labels of rows) have no less in any bucket."""

    def __init__(self):
        super().__init__(pa.schema([("phi", pa.list_(pa.int32())), ("score", pa.int64())]))
        self.score = None

    def rows(self, q, t):
        self.score = np.zeros(len(q.id), np.int64) if self.score is None else self.score
        for s, more, ok in tiles.greater(q, t):
            self.score[s] += ((more == 0) & ok) @ t.label
        return iter(())

    def end(self, q):
        if self.score is not None:
            yield pa.RecordBatch.from_arrays([pa.array(list(q.e.T.astype(np.int32)), self.schema[0].type), pa.array(self.score)], schema=self.schema)


def scored(candidates: DataFrame, corpus: DataFrame) -> DataFrame:
    """phi, score: how many neighbourhoods (corpus: phi, n) have no less in any bucket."""
    kinds = candidates.select("phi").distinct().select(F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("label"), "phi")
    rows = corpus.select(F.lit(0).cast("long").alias("id"), F.col("n").alias("label"), "phi")
    found = tiles.over_pairs(kinds, rows, Contained(), "phi array<int>, score long")
    return found.groupBy("phi").agg(F.sum("score").alias("score"))


def starts(nodes: DataFrame, cfg: Config) -> DataFrame:
    """One node a program: its least with the seed's label; the limit is a feature of the search."""
    hit = nodes.where(F.col("span") == cfg.seed).groupBy("prog").agg(F.min("node").alias("node"))
    return hit.orderBy("prog").limit(cfg.max_init_beams)


def seeds(named: DataFrame, first: DataFrame) -> DataFrame:
    """Beams of one node each."""
    near = F.filter(F.concat("kids", F.array("parent")), lambda x: x.isNotNull())
    return first.join(named, ["prog", "node"]).select("prog", F.array("node").alias("members"), F.array_sort(near).alias("frontier"), F.array("node").alias("visited"), "holes")


def within(df: DataFrame, beams: DataFrame) -> DataFrame:
    """The rows of the beams' programs: no other program's are looked at again."""
    return df.join(beams.select("prog").distinct(), "prog", "left_semi")


def grow(beams: DataFrame, nodes: DataFrame, corpus: DataFrame, cfg: Config) -> DataFrame:
    """One step: every frontier node of every beam is tried; holes are bounded before anything is scored; the best stay."""
    tried = beams.where((F.size("members") < cfg.max_size) & (F.size("frontier") > 0)).select("*", F.explode("frontier").alias("node"))
    met = tried.join(nodes.select("prog", "node", "parent", "kids", F.col("holes").alias("own")), ["prog", "node"]).withColumn("open", F.col("holes") + F.col("own") - 1)
    near = F.filter(F.concat("kids", F.array("parent")), lambda x: x.isNotNull())
    made = met.where(F.col("open").between(0, cfg.max_holes)).select(
        "prog", "node", F.array_sort(F.array_append("members", F.col("node"))).alias("members"),
        F.array_sort(F.array_except(F.array_union("frontier", near), F.array_append("visited", F.col("node")))).alias("frontier"),
        F.array_append("visited", F.col("node")).alias("visited"), F.col("open").alias("holes"),
    )
    phi = encode(made.select("prog", F.col("node").alias("cand"), F.col("members").alias("all"), F.explode("members").alias("node")), nodes, ["prog", "cand"])
    full = written(beams.sparkSession, made.join(phi.withColumnRenamed("cand", "node"), ["prog", "node"]))
    rated = full.join(scored(full, corpus), "phi", "left").withColumn("score", F.coalesce("score", F.lit(0)))
    ratio = F.when(F.col("holes") == 0, F.col("score")).otherwise(F.col("score") / F.col("holes"))
    w = Window.partitionBy("prog").orderBy(F.desc(ratio), "holes", "node")
    return rated.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cfg.n_beams).drop("phi", "node")


def begin(spark: SparkSession, rows: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Beams, the labelled nodes of their programs, and the corpus of all programs."""
    nodes = rows.where(F.col("kind").bitwiseAND(programs.NODE) > 0).select("prog", "node", "type", "span")
    edges = rows.where(F.col("kind").bitwiseAND(programs.EDGE) > 0).select("prog", F.col("parent").alias("src"), F.col("node").alias("dst"))
    first = written(spark, starts(nodes, cfg))
    named = written(spark, labelled(within(nodes, first), within(edges, first)))
    return written(spark, seeds(named, first)), named, written(spark, corpus_of(rows))


def search(spark: SparkSession, rows: DataFrame, edges: DataFrame | None = None, cfg: Config = Config()) -> DataFrame:
    """gen, prog, members, score, holes of the best beam of each program and generation. rows: of operators.programs, or the nodes beside edges."""
    beams, named, corpus = begin(spark, written(spark, rows if edges is None else programs.rows_of(rows, edges)), cfg)
    found, gen = [], 1
    while gen < cfg.max_size:
        best = written(spark, grow(beams, named, corpus, cfg))
        if best.isEmpty():
            break
        gen += 1
        if gen >= cfg.min_size:
            found.append(best.where("rank = 1").select(F.lit(gen).alias("gen"), "prog", "members", "score", "holes"))
            if cfg.stop_at_equilibrium and balanced(found[-1]):
                break
        beams = best.drop("rank", "score")
    out = spark.createDataFrame([], "gen int, prog long, members array<long>, score long, holes int")
    for f in found:
        out = out.unionByName(f)
    return out


def balanced(generation: DataFrame) -> bool:
    """Whether a generation's diversity has reached its reusability (one row comes to the driver)."""
    r = generation.agg(F.countDistinct("score", "holes").alias("kinds"), (F.sum("score") / F.count("*")).alias("reuse")).first()
    return (r.kinds if r.kinds > 0 else 1) >= (r.reuse if r.reuse > 0 else r.reuse + 1)


def idiom_search(spark, sf_dir):
    return search(spark, forest_rows(spark, sf_dir)).select("gen", "prog", F.concat_ws(",", F.transform("members", lambda x: x.cast("string"))).alias("members"), "score", "holes")


def grow_one_step(spark, sf_dir):
    cfg = Config()
    return grow(*begin(spark, forest_rows(spark, sf_dir), cfg), cfg).select("prog", F.concat_ws(",", F.transform("members", lambda x: x.cast("string"))).alias("members"), "score", "holes")


def encode_neighbourhoods(spark, sf_dir):
    """The three token families of its SQL; the search counts all five."""
    return programs.phi_texts(forest_rows(spark, sf_dir), False, TOP, RADIUS, NEAREST)


_PHI = f"""WITH {FOREST}, {_DEG}, {_HOP}, tok AS (
SELECT h.prog, h.anchor, unnest([n.type, n.type || '|' || n.span, CASE WHEN p.node IS NOT NULL THEN up.type || '>' || n.type END]) AS token FROM hood AS h JOIN nodes AS n ON n.prog = h.prog AND n.node = h.node
LEFT JOIN edges AS e ON e.prog = h.prog AND e.dst = h.node LEFT JOIN (SELECT prog, anchor, node FROM hood) AS p ON p.prog = h.prog AND p.anchor = h.anchor AND p.node = e.src LEFT JOIN nodes AS up ON up.prog = e.prog AND up.node = e.src),
b AS (SELECT prog, anchor, CAST('0x' || substr(md5(token), 1, 2) AS INT) % 64 AS b, count(*) AS n FROM tok WHERE token IS NOT NULL GROUP BY ALL),
phi AS (SELECT g.prog, g.anchor, array_to_string(list(coalesce(n, 0) ORDER BY i), ',') AS phi FROM (SELECT DISTINCT prog, anchor FROM b) AS g CROSS JOIN range(64) AS r(i) LEFT JOIN b ON b.prog = g.prog AND b.anchor = g.anchor AND b.b = i GROUP BY ALL)"""
SQL = {"encode_neighbourhoods": f"{_PHI} SELECT prog, anchor, phi FROM phi"}
QUERIES = {f.__name__: f for f in (idiom_search, grow_one_step, encode_neighbourhoods)}
