"""Degrees and distinct edges over a stream of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_edge_stream(spark: SparkSession, path: str, schema: str = "src long, dst long, ts timestamp", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def degrees(edges: DataFrame, side: str = "both") -> DataFrame:
    """Running id, deg; state is one row per vertex seen (complete or update mode)."""
    ends = F.explode(F.array("src", "dst")) if side == "both" else F.col({"out": "src", "in": "dst"}[side])
    return edges.select(ends.alias("id")).groupBy("id").agg(F.count("*").alias("deg"))


def windowed_degrees(edges: DataFrame, window: str = "5 minutes", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Out-degrees per window; windows close, and their state goes, ``late`` after their end."""
    return edges.withWatermark(ts, late).groupBy(F.window(ts, window), F.col("src").alias("id")).agg(F.count("*").alias("deg"))


def distinct_edges(edges: DataFrame, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Each edge once within the watermark."""
    return edges.withWatermark(ts, late).dropDuplicatesWithinWatermark(["src", "dst"])
