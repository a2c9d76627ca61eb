"""Small helpers shared by the Arrow-batched operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows an operator's own Arrow batch holds at most; long texts make batches large well before that.
BATCH_BYTES = 16 << 20


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column as Python strings; nulls are empty texts."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batch in short runs of rows, so that what is derived from its texts stays small."""
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def per_batch(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                if part.num_rows:
                    yield f(part)

    return df.mapInArrow(run, schema)


def cut(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Write df as a table in the shared checkpoint folder and go on from there, so that a lost executor costs no more than one stage."""
    where = f"{folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that cut() wrote and nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for df in tables:
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; only where that is unset (tests), one under the warehouse."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return sc.getCheckpointDir()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


__all__ = ["BATCH_BYTES", "F", "StorageLevel", "cut", "documents", "forget", "folder", "per_batch", "slices", "texts"]
