"""Files and folders as tables and tables as files: names, sources, numbered files, idioms, sheets, tasks.

Paths may be of any store that Spark reads; nothing is opened on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import folder, written


def load_names(spark: SparkSession, path: str) -> DataFrame:
    """Distinct repository names of JSON files with a field `items`, an array of names."""
    return spark.read.json(path).select(F.explode("items").alias("repo")).distinct()


def read_sources(spark: SparkSession, path: str, suffix: str = "*.py") -> DataFrame:
    """path, name, code of every file below a folder whose name fits; each whole."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=suffix)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("code"))


def flattened(path: Column) -> Column:
    """A path as a name: its separators doubled underscores."""
    return F.replace(path, F.lit("/"), F.lit("__"))


def numbered(df: DataFrame, *order: str, name: str = "idx") -> DataFrame:
    """df with dense numbers from 0 in a total order: sorted over ranges, each task numbers its own rows, and the rows of ranges before are added.

    One row a task comes to the driver, never the rows themselves.
    """
    spark = df.sparkSession
    local = written(spark, df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    split = F.shiftright("_id", 33)
    sizes = sorted((r.part, r.n) for r in local.groupBy(split.alias("part")).agg(F.count("*").alias("n")).collect())
    before, rows = 0, []
    for part, n in sizes:
        rows.append((part, before))
        before += n
    base = spark.createDataFrame(rows, "_part long, _before long")
    inside = F.col("_id").bitwiseAND((1 << 33) - 1)
    return local.join(F.broadcast(base), split == F.col("_part")).withColumn(name, F.col("_before") + inside).drop("_id", "_part", "_before")


def write_mapping(df: DataFrame, path: str) -> None:
    """A mapping as CSV with semicolons."""
    df.write.option("sep", ";").option("header", True).mode("overwrite").csv(path)


def read_mapping(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("sep", ";").option("header", True).schema(schema).csv(path)


def split_first(df: DataFrame, *order: str, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """side: train for the first share of the rows in an order, test for the others."""
    rows = numbered(df, *order)
    n = rows.agg(F.count("*").alias("_n"))  # one row
    return rows.join(F.broadcast(n), F.lit(True)).withColumn("side", F.when(F.col("idx") < F.floor(F.col("_n") * share[0] / share[1]), "train").otherwise("test")).drop("_n")


def drawn_with_replacement(df: DataFrame, key: str | list[str], k: int, seed: int) -> DataFrame:
    """draw and key of k draws, each of any row: its number by a digest of seed and draw."""
    keys = [key] if isinstance(key, str) else key
    rows = numbered(df.select(*keys), *keys)
    n = rows.agg(F.count("*").alias("_n"))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"))), 1, 12), 16, 10).cast("long")
    draws = df.sparkSession.range(k).withColumnRenamed("id", "draw").join(F.broadcast(n), F.lit(True)).where("_n > 0").select("draw", (h % F.col("_n")).alias("idx"))
    return draws.join(rows, "idx").select("draw", *keys)


def drawn(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, the first by a digest of seed and key."""
    return df.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))).orderBy("_h", key).limit(n).drop("_h")


def save_idioms(df: DataFrame, path: str) -> None:
    """Idioms as JSON, in folders by query and size."""
    df.write.partitionBy("query", "size").mode("overwrite").json(path)


def read_idioms(spark: SparkSession, path: str, schema: str, query: str | None = None, size: int | None = None, supported: bool = True) -> DataFrame:
    """Saved idioms; query and size are folders and read no others; supported: with neighbourhoods."""
    df = spark.read.schema(schema).json(path)
    if query is not None:
        df = df.where(F.col("query") == query)
    if size is not None:
        df = df.where(F.col("size") == size)
    return df.where("nhoods > 0") if supported else df


def save_sheets(df: DataFrame, path: str, by: str) -> None:
    """One CSV folder a sheet."""
    df.write.partitionBy(by).option("header", True).mode("overwrite").csv(path)


def save_lines(df: DataFrame, path: str) -> None:
    """JSON lines: tasks and predictions."""
    df.write.mode("overwrite").json(path)


def cached(df: DataFrame, path: str) -> DataFrame:
    """df as a Parquet table at path: written if it isn't there yet, then read."""
    spark = df.sparkSession
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def indexed(spark: SparkSession, *names: str) -> DataFrame:
    """name, there: whether each index table can be read by name."""
    return spark.createDataFrame([(n, spark.catalog.tableExists(n)) for n in names], "name string, there boolean")


__all__ = ["cached", "drawn", "drawn_with_replacement", "flattened", "folder", "indexed", "load_names", "numbered", "read_idioms", "read_mapping", "read_sources", "save_idioms", "save_lines", "save_sheets", "split_first", "write_mapping"]
