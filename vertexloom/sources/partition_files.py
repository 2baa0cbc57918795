"""Files of a partitioned graph: index, cross graph and sub-graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import decode_tag
from ..graph import Graph
from ..operators import partition as P
from ..plans.scratch import numbered_lines, stored


def index_name(base: str, parts: int) -> str:
    return f"{base}.p{parts}.index"


def cross_name(base: str, parts: int) -> str:
    return f"{base}.p{parts}.cross"


def part_name(base: str, parts: int, part: int, ext: str) -> str:
    return f"{base}.p{parts}_{part}.{ext}"


def write_partition(g: Graph, assignment: DataFrame, base: str, parts: int, merge: bool = True, index: bool = True, subgraphs: bool = True, cross: bool = True) -> dict[str, DataFrame]:
    """Write index lines, sub-graphs (Parquet by part) and the cross graph under ``base``."""
    ix = stored(P.part_index(assignment), "index")
    mirrors = stored(P.ghosts(g, ix, merge), "ghosts")
    if index:
        P.index_lines(ix, mirrors).repartitionByRange("id").sortWithinPartitions("id").select(F.col("line").alias("value")).write.mode("overwrite").text(index_name(base, parts))
    if cross:
        P.cross_graph(mirrors).repartitionByRange("tag", "ghost_local", "owner_local").sortWithinPartitions("tag", "ghost_local", "owner_local").write.mode("overwrite").parquet(cross_name(base, parts))
    if subgraphs:
        P.subgraph_edges(g, ix, mirrors).write.mode("overwrite").partitionBy("part").parquet(f"{base}.p{parts}_parts")
    return {"index": ix, "ghosts": mirrors}


def read_index(spark: SparkSession, path) -> DataFrame:
    """id, part, local_id, ghosts (array of part, local_id) of index lines."""
    f = F.split(F.trim("value"), r"\s+")
    rest = F.transform(F.sequence(F.lit(0), F.expr("size(f) div 2 - 2")), lambda i: F.struct(F.get("f", 2 + 2 * i).cast("int").alias("part"), F.get("f", 3 + 2 * i).cast("long").alias("local_id")))
    rows = numbered_lines(spark, path).select(F.col("line").alias("id"), f.alias("f"))
    empty = F.expr("cast(array() as array<struct<part:int,local_id:bigint>>)")
    return rows.select("id", F.col("f")[0].cast("int").alias("part"), F.col("f")[1].cast("long").alias("local_id"), F.when(F.size("f") > 2, rest).otherwise(empty).alias("ghosts"))


def read_cross(spark: SparkSession, path: str, part: int | None = None, transposed: bool = False) -> DataFrame:
    """owner_local, ghost_local, owner, part; with ``part`` only the rows that concern it."""
    owner, to = decode_tag(F.col("tag"))
    c = spark.read.parquet(path).select("owner_local", "ghost_local", owner.alias("owner"), to.alias("part"))
    if transposed:
        c = c.select(F.col("ghost_local").alias("owner_local"), F.col("owner_local").alias("ghost_local"), F.col("part").alias("owner"), F.col("owner").alias("part"))
    return c if part is None else P.own_cross_graph(c, part)


def read_part(spark: SparkSession, base: str, parts: int, part: int, transposed: bool = False) -> DataFrame:
    """src, dst of one part; only its folder is read."""
    e = spark.read.parquet(f"{base}.p{parts}_parts").where(F.col("part") == part).drop("part")
    return e.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if transposed else e


def vertex_count(spark: SparkSession, path) -> int:
    return spark.read.text(path).count()


def reassembled(parts: DataFrame, index: DataFrame, mirrors: DataFrame) -> DataFrame:
    """src, dst in global numbers from the sub-graphs of all parts."""
    ids = index.select("id", "part", "local_id").unionAll(mirrors.select("id", "part", F.col("ghost_local").alias("local_id")))
    a = ids.select(F.col("id").alias("gs"), "part", F.col("local_id").alias("src"))
    b = ids.select(F.col("id").alias("gd"), "part", F.col("local_id").alias("dst"))
    return parts.join(a, ["part", "src"]).join(b, ["part", "dst"]).select(F.col("gs").alias("src"), F.col("gd").alias("dst"))
