"""Lineage cuts, size checks and distributed dense numbering."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; an own one only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="vertexloom-")
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's stored tables, once results that read them have been written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fits(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows, reading no more than that and one."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if(df: DataFrame, rows: int = 100_000) -> DataFrame:
    return F.broadcast(df) if fits(df, rows) else df


def dense_ids(df: DataFrame, order: list[Column], name: str = "id", start: int = 0) -> DataFrame:
    """``df`` with dense numbers ``start``... in ``order``, without ever sorting in one task.

    A range exchange deals the rows, each partition sorts and numbers its own, and the numbers are
    shifted by the sizes of the partitions before (one row per partition)."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__mid", F.monotonically_increasing_id())
    kept = stored(ranged, "ranged")
    part = F.shiftright(F.col("__mid"), 33)
    sizes = kept.groupBy(part.alias("__part")).agg(F.count("*").alias("c"))  # a row per partition
    before = sizes.select("__part", (F.sum("c").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).alias("__before"))
    out = kept.withColumn("__part", part).join(F.broadcast(before), "__part")
    return out.withColumn(name, (F.col("__before") + F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1)) + F.lit(start)).cast("long")).drop("__mid", "__part", "__before")


def numbered_lines(spark: SparkSession, path) -> DataFrame:
    """value, line: text lines with their place over all files in name order.

    A split's rows keep their order in one task; splits are put in order by file and offset, so
    only one row per split is sorted."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    raw = stored(raw, "lines")
    splits = raw.groupBy("f", "b").agg(F.min("m").alias("m0"), F.count("*").alias("c"))
    w = Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, 0)
    before = splits.select("f", "b", "m0", (F.sum("c").over(w) - F.col("c")).alias("before"))
    return raw.join(broadcast_if(before), ["f", "b"]).select("value", (F.col("before") + F.col("m") - F.col("m0")).alias("line"))
