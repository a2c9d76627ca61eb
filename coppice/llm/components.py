"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import cut, forget


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """id, root for every end of the links (u, v: long); each component has one root.

    In each round every node takes the label of the neighbour (or itself) that
    comes first in an order drawn anew, and links between equal labels vanish.
    The order is random, so chains shorten by a share each round, and a star's
    leaves, however many, are pre-aggregated before they meet.
    """
    edges = cut(spark, links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    labels: DataFrame | None = None
    turn = 0
    while not edges.isEmpty():
        both = edges.select("u", "v").union(edges.select("v", "u"))
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        near = both.groupBy("u").agg(F.min(order("v")).alias("m"))
        step = cut(spark, near.select(F.col("u").alias("id"), F.least("m", order("u"))["id"].alias("to")))
        new = edges.join(step.select(F.col("id").alias("u"), F.col("to").alias("a")), "u").join(step.select(F.col("id").alias("v"), F.col("to").alias("b")), "v")
        edges, old = cut(spark, new.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()), edges
        if labels is None:
            labels = step.withColumnRenamed("to", "root")
        else:
            # Nodes of this round are labels of earlier ones.
            moved = labels.join(step.select(F.col("id").alias("root"), "to"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
            labels, before = cut(spark, moved), labels
            forget(spark, before, step)
        forget(spark, old)
        turn += 1
    if labels is None:
        return spark.createDataFrame([], "id long, root long")
    return labels
