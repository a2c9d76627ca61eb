"""Tables of a folder of Parquet files, and the entity forest derived from them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; only where that is unset (tests), one under the warehouse."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        sc.setCheckpointDir(where or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return sc.getCheckpointDir()


def written(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df as a table in the shared checkpoint folder: its lineage ends there, and a lost executor costs one stage."""
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers, orders and lines of the forest: prog, node, parent, type, span. Lines are dealt by order once, and each is there once."""
    t = lambda n: table(spark, sf_dir, n)
    orders = t("orders").select(F.col("o_custkey").alias("prog"), (F.col("o_orderkey") * 64).alias("order"), "o_orderkey", "o_orderstatus")
    lines = t("lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("k"), F.concat("l_returnflag", "l_linestatus").alias("span")).where("l_orderkey is not null")
    lines = lines.repartition("l_orderkey").groupBy("l_orderkey", "k").agg(F.min("span").alias("span"))
    lines = lines.join(orders.select("prog", "order", "o_orderkey").distinct(), F.col("l_orderkey") == F.col("o_orderkey"))
    made = lambda df, node, parent, kind, span: df.select("prog", node.alias("node"), parent.cast("long").alias("parent"), F.lit(kind).alias("type"), span.alias("span"))
    customers = t("customer").select(F.col("c_custkey").alias("prog"), "c_mktsegment")
    return (
        made(customers, F.lit(0).cast("long"), F.lit(None), "customer", F.col("c_mktsegment")),
        made(orders, F.col("order"), F.lit(0), "order", F.col("o_orderstatus")),
        made(lines, F.col("order") + F.col("k"), F.col("order"), "line", F.col("span")),
    )


def forest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labelled trees: customer, orders, lines. nodes: prog, node, type, span; edges: prog, src, dst (parent to child)."""
    customers, orders, lines = _parts(spark, sf_dir)
    nodes = customers.unionByName(orders).unionByName(lines).drop("parent")
    edges = orders.unionByName(lines).select("prog", F.col("parent").alias("src"), F.col("node").alias("dst"))
    return nodes, edges


def forest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest as rows of operators.programs, a node and the edge to it in one: lines are joined once."""
    customers, orders, lines = _parts(spark, sf_dir)
    return customers.withColumn("kind", F.lit(1)).unionByName(orders.unionByName(lines).withColumn("kind", F.lit(3))).select("prog", "kind", "node", "parent", "type", "span")


#: The same forest in SQL.
FOREST = """lines AS (SELECT o_custkey AS prog, o_orderkey * 64 AS ord, o_orderkey * 64 + l_linenumber AS node, min(l_returnflag || l_linestatus) AS span FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
nodes AS (SELECT c_custkey AS prog, CAST(0 AS BIGINT) AS node, 'customer' AS type, c_mktsegment AS span FROM customer
  UNION ALL SELECT o_custkey, o_orderkey * 64, 'order', o_orderstatus FROM orders UNION ALL SELECT prog, node, 'line', span FROM lines),
edges AS (SELECT o_custkey AS prog, CAST(0 AS BIGINT) AS src, o_orderkey * 64 AS dst FROM orders UNION ALL SELECT prog, ord, node FROM lines)"""
