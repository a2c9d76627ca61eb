"""Data sets of files, samples and saved results: sources and sinks over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import files
from ..sources.tables import FOREST, folder, forest, table
from .reports import _I, clusters, idioms
from .trees import top_degree

SEED, DRAWS = 24, 1000


def _place(spark) -> str:
    return f"{folder(spark)}/{uuid.uuid4().hex}"


def _pages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("repo"))


def repository_names(spark, sf_dir):
    """Names written as JSON lists, read back, each once."""
    at = _place(spark)
    files.save_lines(_pages(spark, sf_dir).groupBy((F.col("page_id") % 8).alias("file")).agg(F.collect_set("repo").alias("items")).select("items"), at)
    return files.load_names(spark, at)


def number_files(spark, sf_dir):
    """Pages numbered by their flat names; the mapping goes through CSV."""
    at = _place(spark)
    files.write_mapping(files.numbered(_pages(spark, sf_dir).select("page_id", files.flattened(F.col("url")).alias("flat")), "flat", "page_id"), at)
    return files.read_mapping(spark, at, "page_id long, flat string, idx long")


def split_first_80(spark, sf_dir):
    return files.split_first(_pages(spark, sf_dir), "url", "page_id").select("page_id", "side")


def renumber_examples(spark, sf_dir):
    """What a filter left of the numbered files gets dense names, and the mapping follows by a join."""
    named = files.numbered(_pages(spark, sf_dir), "url", "page_id")
    kept = files.numbered(named.where("idx % 3 <> 1").select("idx"), "idx", name="new")
    return named.join(kept, "idx").select("page_id", "idx", F.concat(F.lit("example_"), F.col("new").cast("string")).alias("name"))


def sample_with_replacement(spark, sf_dir):
    """DRAWS draws of programs."""
    return files.drawn_with_replacement(table(spark, sf_dir, "customer"), "c_custkey", DRAWS, SEED)


def sample_without_replacement(spark, sf_dir):
    """A sample of DRAWS documents, first by digest."""
    return files.drawn(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", DRAWS, 42)


def _reported(spark, sf_dir) -> DataFrame:
    c = clusters(idioms(spark, sf_dir))
    return c.select(F.lit("F").alias("query"), F.col("size").cast("int"), "cluster", F.col("score").alias("nhoods"), "members")


def saved_idioms(spark, sf_dir):
    """Idioms of a size with neighbourhoods, from folders by query and size."""
    at = _place(spark)
    files.save_idioms(_reported(spark, sf_dir), at)
    return files.read_idioms(spark, at, "query string, size int, cluster int, nhoods long, members long", "F", 4)


def plot_metrics(spark, sf_dir):
    """size, cluster, freq of all saved idioms."""
    at = _place(spark)
    files.save_idioms(_reported(spark, sf_dir), at)
    return files.read_idioms(spark, at, "query string, size int, cluster int, nhoods long, members long", "F", supported=False).select("size", "cluster", F.col("nhoods").alias("freq"))


def mine_log(spark, sf_dir):
    """A summary by size, as text."""
    g = _reported(spark, sf_dir).groupBy("size").agg(F.count("*").alias("clusters"), F.sum("members").alias("idioms"))
    return g.select(F.format_string("size %d: %d clusters, %d idioms", F.col("size"), F.col("clusters"), F.col("idioms")).alias("line"))


def api_sheets(spark, sf_dir):
    """Lines of each API's sheet, through CSV folders."""
    at = _place(spark)
    files.save_sheets(table(spark, sf_dir, "lineitem").groupBy("l_linestatus", "l_returnflag").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("total")), at, "l_linestatus")
    return spark.read.option("header", True).schema("l_returnflag string, n long, total long, l_linestatus string").csv(at)


def task_lines(spark, sf_dir):
    """Tasks written as JSON lines and read back."""
    at = _place(spark)
    files.save_lines(table(spark, sf_dir, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("text")), at)
    return spark.read.schema("item_id long, text string").json(at)


def cached_embeddings(spark, sf_dir):
    """Embeddings of the programs asked for, by an inner join: missing ones are skipped; one list a label, from a cached table."""
    v = files.cached(table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e")), _place(spark))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vec_id"))
    return v.join(asked, "vec_id", "left_semi").groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum(F.aggregate("e", F.lit(0.0), lambda a, x: a + x)), 6).alias("total"))


def embedded_programs(spark, sf_dir):
    """Only programs that have embeddings are indexed; blocks of embeddings are put together."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("prog"))
    both = v.where("prog % 2 = 0").unionByName(v.where("prog % 2 <> 0")).distinct()
    return forest(spark, sf_dir)[0].join(both, "prog", "left_semi").groupBy("prog").agg(F.count("*").alias("n"))


def provenance(spark, sf_dir):
    """Each reported idiom with its program's root label and whether a node of the program belongs to it."""
    i = idioms(spark, sf_dir).select("prog", "anchor", "size", "score")
    nodes, edges = forest(spark, sf_dir)
    root = nodes.where("type = 'customer'").select("prog", F.col("span").alias("segment"))
    first = top_degree(edges, 1).select("prog", F.col("node").alias("first"))
    return i.join(root, "prog").join(first, "prog", "left").select("prog", "anchor", "size", "score", "segment", F.when(F.col("anchor") == F.col("first"), 1).otherwise(0).alias("is_anchor"))


def alias_lookup(spark, sf_dir):
    """Flags by a fixed table of names; unknown ones stand for themselves."""
    known = spark.createDataFrame([("A", "accepted"), ("R", "returned")], "l_returnflag string, name string")  # two rows
    return table(spark, sf_dir, "lineitem").join(F.broadcast(known), "l_returnflag", "left").groupBy(F.coalesce("name", "l_returnflag").alias("name")).agg(F.count("*").alias("n"))


def apis_by_library(spark, sf_dir):
    """Distinct APIs a library, beside their libraries by place."""
    d = table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.array_sort(F.collect_set("l_returnflag")).alias("apis"))
    zipped = F.arrays_zip(F.transform("apis", lambda a: F.col("l_linestatus")).alias("library"), F.col("apis").alias("api"))
    return d.select(F.explode(zipped).alias("z")).select("z.library", "z.api")


def program_counts(spark, sf_dir):
    """Programs, and how many are open."""
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("programs"), F.count_if(F.col("o_orderstatus") == "O").alias("mined"), F.count_if(F.col("o_orderstatus") != "O").alias("skipped"))


def ideal_size(spark, sf_dir):
    """The first size at which the log of diversity passes that of reusability, and three more; null if none does."""
    s = _reported(spark, sf_dir).groupBy("size").agg(F.countDistinct("cluster").alias("d"), F.avg("nhoods").alias("r"))
    rank = s.withColumn("k", F.row_number().over(Window.orderBy("size")) - 1)  # one row a size, at most NEAREST
    return rank.agg((F.min(F.when(F.col("d") > F.col("r"), F.col("k"))) + 3).alias("at"), F.count("*").alias("sizes"))


def sorted_report(spark, sf_dir):
    """Idioms by frequency, falling, and by program size, with their places in either order."""
    c = _reported(spark, sf_dir)
    return files.numbered(files.numbered(c.withColumn("up", -F.col("nhoods")), "up", "size", "cluster", name="by_freq"), "size", "cluster", name="by_size").select("size", "cluster", "by_freq", "by_size")


def distinct_predictions(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select("text").distinct().agg(F.count("*").alias("n"), F.count("text").alias("n_text"))


_PG = "p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS repo FROM pages)"
_N = "CAST(row_number() OVER (ORDER BY url, page_id) - 1 AS BIGINT)"
_REP = f"{_I}, r AS (SELECT CAST(size AS INTEGER) AS size, cluster, score AS nhoods, members FROM c)"
SQL = {
    "repository_names": f"WITH {_PG} SELECT DISTINCT repo FROM p",
    "number_files": "SELECT page_id, replace(url, '/', '__') AS flat, CAST(row_number() OVER (ORDER BY replace(url, '/', '__'), page_id) - 1 AS BIGINT) AS idx FROM pages",
    "split_first_80": f"SELECT page_id, CASE WHEN i < floor(n * 4 / 5) THEN 'train' ELSE 'test' END AS side FROM (SELECT page_id, {_N} AS i, count(*) OVER () AS n FROM pages)",
    "renumber_examples": f"SELECT page_id, idx, 'example_' || (row_number() OVER (ORDER BY idx) - 1) AS name FROM (SELECT page_id, {_N} AS idx FROM pages) WHERE idx % 3 <> 1",
    "sample_with_replacement": f"WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer) SELECT d AS draw, c_custkey FROM range({DRAWS}) AS r(d) JOIN c ON c.i = CAST('0x' || substr(md5('{SEED}|' || d), 1, 12) AS BIGINT) % n",
    "sample_without_replacement": f"SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT {DRAWS}",
    "saved_idioms": f"{_REP} SELECT 'F' AS query, size, cluster, nhoods, members FROM r WHERE size = 4 AND nhoods > 0",
    "plot_metrics": f"{_REP} SELECT size, cluster, nhoods AS freq FROM r",
    "mine_log": f"{_REP} SELECT 'size ' || size || ': ' || count(*) || ' clusters, ' || CAST(sum(members) AS BIGINT) || ' idioms' AS line FROM r GROUP BY size",
    "api_sheets": "SELECT l_linestatus, l_returnflag, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY 1, 2",
    "task_lines": "SELECT item_id, coalesce(text, '') AS text FROM benchmark",
    "cached_embeddings": "SELECT label, count(*) AS n, round(sum(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))), 6) AS total FROM embeddings WHERE vec_id IN (SELECT c_custkey FROM customer) GROUP BY 1",
    "embedded_programs": f"WITH {FOREST} SELECT prog, count(*) AS n FROM nodes WHERE prog IN (SELECT vec_id FROM embeddings) GROUP BY 1",
    "provenance": f"{_I}, t AS (SELECT prog, node AS first FROM (SELECT prog, node, row_number() OVER (PARTITION BY prog ORDER BY count(*) DESC, node) AS k FROM (SELECT prog, src AS node FROM edges UNION ALL SELECT prog, dst FROM edges) GROUP BY 1, 2) WHERE k = 1) SELECT i.prog, anchor, size, i.score, span AS segment, CASE WHEN anchor = first THEN 1 ELSE 0 END AS is_anchor FROM i JOIN nodes AS n ON n.prog = i.prog AND n.type = 'customer' LEFT JOIN t ON t.prog = i.prog",
    "alias_lookup": "SELECT CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE l_returnflag END AS name, count(*) AS n FROM lineitem GROUP BY 1",
    "apis_by_library": "SELECT DISTINCT l_linestatus AS library, l_returnflag AS api FROM lineitem",
    "program_counts": "SELECT count(*) AS programs, count(*) FILTER (o_orderstatus = 'O') AS mined, count(*) FILTER (o_orderstatus <> 'O') AS skipped FROM orders",
    "ideal_size": f"{_REP}, s AS (SELECT size, count(DISTINCT cluster) AS d, avg(nhoods) AS r, row_number() OVER (ORDER BY size) - 1 AS k FROM r GROUP BY 1) SELECT CAST(min(k) FILTER (ln(d) > ln(r)) + 3 AS INTEGER) AS at, count(*) AS sizes FROM s",
    "sorted_report": f"{_REP} SELECT size, cluster, row_number() OVER (ORDER BY nhoods DESC, size, cluster) - 1 AS by_freq, row_number() OVER (ORDER BY size, cluster) - 1 AS by_size FROM r",
    "distinct_predictions": "SELECT count(*) AS n, count(text) AS n_text FROM (SELECT DISTINCT text FROM conversations WHERE role = 'assistant')",
}
QUERIES = {f.__name__: f for f in (repository_names, number_files, split_first_80, renumber_examples, sample_with_replacement, sample_without_replacement, saved_idioms, plot_metrics, mine_log, api_sheets, task_lines, cached_embeddings, embedded_programs, provenance, alias_lookup, apis_by_library, program_counts, ideal_size, sorted_report, distinct_predictions)}
