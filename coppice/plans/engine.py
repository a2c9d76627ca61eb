"""The engine: searches by one API, several or none, saved generations, cached results and benchmark runs.

A search's result is a table of idioms in folders by query and size; asking for a query whose results are there reads them.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graphs import match_pattern, wl_of_sets
from ..operators.programs import rows_of
from ..operators.trees import induced
from ..sources import files
from ..sources.tables import written
from .search import Config, corpus_of, grow, labelled, search, within

IDIOMS = "query string, mode string, prog long, members string, cluster long, rank int, nhoods long, holes int, size int"


def seeded(nodes: DataFrame, edges: DataFrame, patterns: list[list[tuple]], limit: int | None = None) -> DataFrame:
    """One beam a program in which every pattern matches: the union of the least match of each, and its frontier.

    limit: at most so many programs, the first by id; None for all.
    """
    found = None
    for k, pattern in enumerate(patterns):
        m = match_pattern(nodes, edges, pattern)
        names = [c for c in m.columns if c != "prog"]
        least = m.groupBy("prog").agg(F.min(F.struct(*names)).alias("m"))
        h = least.select("prog", F.lit(k).alias("seed"), F.explode(F.array(*[F.col("m")[c] for c in names])).alias("node"))
        found = h if found is None else found.unionByName(h)
    whole = found.groupBy("prog").agg(F.countDistinct("seed").alias("n"), F.array_sort(F.collect_set("node")).alias("members")).where(F.col("n") == len(patterns)).drop("n")
    if limit is not None:
        whole = whole.orderBy("prog").limit(limit)
    return _beams(whole, nodes)


def mining(nodes: DataFrame, edges: DataFrame, trials: int, seed: int = 24) -> DataFrame:
    """Beams of mining: a drawn node of all is the start of its program's beam; of several in a program the least draw's."""
    drawn = files.drawn_with_replacement(nodes, ["prog", "node"], trials, seed)
    first = drawn.groupBy("prog").agg(F.min(F.struct("draw", "node")).alias("m"))
    return _beams(first.select("prog", F.array("m.node").alias("members")), nodes)


def _beams(whole: DataFrame, nodes: DataFrame) -> DataFrame:
    near = F.filter(F.concat("kids", F.array("parent")), lambda x: x.isNotNull())
    at = whole.select("prog", "members", F.explode("members").alias("node")).join(nodes.select("prog", "node", "kids", "parent", "holes"), ["prog", "node"])
    # A child within the members fills a hole of its parent.
    filled = F.size(F.array_intersect("kids", "members"))
    got = at.groupBy("prog", "members").agg(F.array_distinct(F.flatten(F.collect_list(near))).alias("near"), F.sum(F.col("holes") - filled).cast("int").alias("holes"))
    return got.select("prog", "members", F.array_sort(F.array_except("near", "members")).alias("frontier"), F.col("members").alias("visited"), "holes")


def generation(found: DataFrame, edges: DataFrame, query: str, mode: str, min_nhoods: int = 1) -> DataFrame:
    """Idioms of one size clustered by the hash of their subgraphs, clusters by number of members and idioms by neighbourhoods; with several seeds only connected ones of enough neighbourhoods are kept."""
    members = found.select("prog", F.col("members")[0].alias("anchor"), F.explode("members").alias("node"))
    hashed = wl_of_sets(edges, members).select("prog", "hash")
    rows = written(found.sparkSession, found.join(hashed, "prog"))
    from pyspark.sql import Window

    order = Window.orderBy(F.desc("n"), "hash")
    clusters = rows.groupBy("hash").agg(F.count("*").alias("n")).withColumn("cluster", F.row_number().over(order).cast("long"))  # a row a shape
    ranked = rows.join(clusters.drop("n"), "hash").withColumn("rank", F.row_number().over(Window.partitionBy("hash").orderBy(F.desc("score"), "prog")))
    if mode == "mq":
        inner = induced(edges, members).groupBy("prog").agg(F.count("*").alias("inner"))
        ranked = ranked.join(inner, "prog", "left").where((F.coalesce("inner", F.lit(0)) == F.size("members") - 1) & (F.col("score") >= min_nhoods)).drop("inner")
    text = F.array_join(F.transform("members", lambda x: x.cast("string")), ",")
    return ranked.select(F.lit(query).alias("query"), F.lit(mode).alias("mode"), "prog", text.alias("members"), "cluster", "rank", F.col("score").alias("nhoods"), "holes", F.size("members").alias("size"))


def figures(idioms: DataFrame) -> DataFrame:
    """One row: diversity (clusters), reusability (mean neighbourhoods), and whether a search may stop, by their logs (of one more where they aren't positive)."""
    r = idioms.agg(F.countDistinct("cluster").alias("diversity"), F.coalesce(F.avg("nhoods"), F.lit(0.0)).alias("reusability"))
    log = lambda c: F.ln(F.when(F.col(c) <= 0, F.col(c) + 1).otherwise(F.col(c)))
    return r.select("diversity", "reusability", (log("diversity") >= log("reusability")).alias("stop"))


class Engine:
    """Searches a forest; results are kept below `place`."""

    def __init__(self, spark: SparkSession, nodes: DataFrame, edges: DataFrame, place: str, config: Config = Config()):
        self.spark, self.edges, self.place, self.config = spark, edges, place, config
        self.plain = nodes
        self.nodes = written(spark, labelled(nodes, edges))
        self.corpus = written(spark, corpus_of(rows_of(nodes, edges)))

    def _where(self, query: str) -> str:
        return f"{self.place}/{query.replace('/', '__').replace(';', '+')}"

    def status(self, query: str) -> bool:
        """Whether a query's results are there."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self._where(query)}/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def run(self, query: str, mode: str = "q", min_nhoods: int = 1, trials: int = 100) -> DataFrame:
        """Search by mode: q (one API, a label), mq (several, joined by semicolons), m (mining); all generations of enough size are saved."""
        cfg = replace(self.config, seed=query)
        if mode == "m":
            beams = mining(self.nodes, self.edges, trials)
        elif mode in ("q", "mq"):
            kinds = [r.type for r in self.plain.select("type").distinct().collect()]  # the few types of nodes
            patterns = [[(0, None, kind, s)] for s in query.split(";") for kind in kinds if not self.plain.where((F.col("type") == kind) & (F.col("span") == s)).isEmpty()]
            beams = seeded(self.nodes, self.edges, patterns, cfg.max_init_beams) if len(patterns) >= len(query.split(";")) else None
        else:
            raise ValueError(f"unknown mode {mode}")
        saved, size, beams = [], 0, written(self.spark, beams) if beams is not None else None
        near = written(self.spark, within(self.nodes, beams)) if beams is not None else None
        while beams is not None and not beams.isEmpty():
            best = written(self.spark, grow(beams, near, self.corpus, cfg))
            if best.isEmpty():
                break
            size += 1
            made = written(self.spark, generation(best.where("rank = 1").select("prog", "members", "score", "holes").where(F.size("members") >= cfg.min_size), self.edges, query, mode, min_nhoods))
            saved.append(made)
            if cfg.stop_at_equilibrium and not made.isEmpty() and figures(made).first().stop:
                break
            beams = best.drop("rank", "score")
        out = self.spark.createDataFrame([], IDIOMS)
        for s in saved:
            out = out.unionByName(s)
        files.save_idioms(out.repartition("size"), self._where(query))
        return self.saved(query)

    def saved(self, query: str, size: int | None = None, supported: bool = False) -> DataFrame:
        return files.read_idioms(self.spark, self._where(query), IDIOMS, None, size, supported)

    def search(self, query: str, size: int | None = None, mode: str = "q") -> DataFrame:
        """Idioms of a query (of a size, with neighbourhoods): from its results if they are there."""
        if not self.status(query):
            self.run(query, mode)
        return self.saved(query, size, supported=True)

    def plot(self, query: str) -> DataFrame:
        """size, cluster, freq of all idioms of a query."""
        return self.saved(query).select("size", "cluster", F.col("nhoods").alias("freq"))

    def benchmark(self, queries: Iterable[str], mode: str = "q") -> DataFrame:
        """Figures of each benchmark query by size; queries with results aren't run again."""
        out = None
        for q in queries:
            self.search(q, mode=mode)
            sizes = self.saved(q).groupBy("size").agg(F.countDistinct("cluster").alias("diversity"), F.avg("nhoods").alias("reusability")).select(F.lit(q).alias("query"), "size", "diversity", F.round("reusability", 6).alias("reusability"))
            out = sizes if out is None else out.unionByName(sizes)
        return out


__all__ = ["Config", "Engine", "figures", "generation", "mining", "search", "seeded"]
