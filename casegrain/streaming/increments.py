"""Extension: lines that arrive as a stream, folded into points and rollups batch by batch.

The batch semantics hold: a point's count goes up with its hits, and no count changes
a status.  Files are read once, by checkpoint; rows delivered twice are dropped within
the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of Parquet files as they come into a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def windowed_counts(rows: DataFrame, time: str, key: str, kind: str, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """start, kind, rows: kinds by window of event time, repeats of a key dropped; rows later than the watermark are left out."""
    x = rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return x.groupBy(F.window(time, width), kind).agg(F.count("*").alias("rows")).select(F.col("window.start").alias("start"), kind, "rows")


def upsert_counts(batch: DataFrame, batch_id: int, path: str, keys: list[str], count: str) -> None:
    """foreachBatch: adds a batch's counts to a table of totals, each batch a version of its own.

    Version n holds the totals after batch n.  It is made of the newest version before n,
    so a batch that is replayed after a failure writes the same again, and a version that
    was not finished (it has no _SUCCESS mark) is never read.  Only the versions that a
    replay may need are kept.
    """
    spark = batch.sparkSession
    fs, root = _files(spark, path)
    done = sorted(v for v in _versions(fs, root, path, spark) if v < batch_id)
    new = batch.groupBy(*keys).agg(F.sum(count).alias(count))
    if done:
        new = spark.read.parquet(f"{path}/v={done[-1]}").unionByName(new).groupBy(*keys).agg(F.sum(count).alias(count))
    new.write.mode("overwrite").parquet(f"{path}/v={batch_id}")
    for v in done[:-1]:
        fs.delete(_path(spark, f"{path}/v={v}"), True)


def totals(spark: SparkSession, path: str) -> DataFrame:
    """The newest finished totals; an error if there are none yet."""
    fs, root = _files(spark, path)
    return spark.read.parquet(f"{path}/v={max(_versions(fs, root, path, spark))}")


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    root = _path(spark, path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), root


def _versions(fs, root, path: str, spark: SparkSession) -> list[int]:
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return [int(n[2:]) for n in names if n.startswith("v=") and fs.exists(_path(spark, f"{path}/{n}/_SUCCESS"))]
