"""Partitioning: vertices to parts, ghosts, sub-graphs and the 2-D block layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import encode_tag
from ..graph import Graph
from ..plans.scratch import stored

#: vertices packed together in the block-cyclic layout, and the largest numbers of blocks and parts
PACK, MAX_BLOCKS, MAX_PARTS = 32, 128, 128


def _checked(parts: int, most: int = MAX_PARTS) -> int:
    if not 1 <= parts <= most:
        raise ValueError(f"between 1 and {most}, not {parts}")
    return parts


def block_parts(g: Graph, parts: int) -> DataFrame:
    """id, part: equal ranges of ids."""
    size = max(1, -(-g.n // _checked(parts)))
    return g.spark.range(g.n).select("id", F.expr(f"cast(id div {size} as int)").alias("part"))


def random_parts(g: Graph, parts: int, seed: int = 0) -> DataFrame:
    """id, part: by a seeded hash of the id, the same on any number of tasks."""
    return g.spark.range(g.n).select("id", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(_checked(parts))).cast("int").alias("part"))


def file_parts(g: Graph, vector: DataFrame) -> DataFrame:
    """id, part from a read partition vector; it must cover all vertices (runs a job)."""
    found = vector.where(F.col("id") < g.n)
    if found.select("id").distinct().count() != g.n:
        raise ValueError("the partition vector does not cover all vertices")
    return found.select("id", F.col("part").cast("int").alias("part"))


def part_index(assignment: DataFrame, segments: int = 64) -> DataFrame:
    """id, part, local_id: the running number within a part in id order.

    Numbers are taken per (part, range of ids) and shifted by the counts of the ranges before, so
    that a part is spread over ``segments`` tasks (ranges cut at the ids' own bounds; runs a job)."""
    top = assignment.agg(F.max("id")).first()[0]
    size = max(1, -(-((top or 0) + 1) // segments))
    a = assignment.withColumn("seg", F.expr(f"id div {size}"))
    w = Window.partitionBy("part", "seg").orderBy("id")
    counts = a.groupBy("part", "seg").agg(F.count("*").alias("c"))
    before = counts.select("part", "seg", (F.sum("c").over(Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).alias("b"))
    return a.withColumn("r", F.row_number().over(w) - 1).join(F.broadcast(before), ["part", "seg"]).select("id", "part", (F.col("r") + F.col("b")).cast("long").alias("local_id"))


def cross_pairs(g: Graph, index: DataFrame, merge: bool = True) -> DataFrame:
    """id, part: vertex ``id`` is needed in ``part``, where an edge of another part's vertex leads to it."""
    a = index.select(F.col("id").alias("src"), F.col("part").alias("ps"))
    b = index.select(F.col("id").alias("dst"), F.col("part").alias("pd"))
    pairs = g.edges.select("src", "dst").join(a, "src").join(b, "dst").where("ps <> pd").select(F.col("dst").alias("id"), F.col("ps").alias("part"))
    return pairs.distinct() if merge else pairs


def ghosts(g: Graph, index: DataFrame, merge: bool = True) -> DataFrame:
    """id, owner, owner_local, part, ghost_local: mirrors numbered after the part's own vertices."""
    pairs = stored(cross_pairs(g, index, merge), "cross")
    size = index.groupBy("part").agg(F.count("*").alias("own"))
    # a part that owns no vertex has no out-edges and so no ghosts: the inner join is complete
    numbered = part_index(pairs) if merge else pairs.withColumn("local_id", F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1)
    owner = index.select("id", F.col("part").alias("owner"), F.col("local_id").alias("owner_local"))
    return numbered.join(F.broadcast(size), "part").join(owner, "id").select("id", "owner", "owner_local", "part", (F.col("local_id") + F.col("own")).cast("long").alias("ghost_local"))


def subgraph_edges(g: Graph, index: DataFrame, mirrors: DataFrame) -> DataFrame:
    """part, src, dst (local numbers; ghosts for foreign targets) and the edges' further columns."""
    rest = [c for c in g.edges.columns if c not in ("src", "dst")]
    a = index.select(F.col("id").alias("src"), "part", F.col("local_id").alias("ls"))
    b = index.select(F.col("id").alias("dst"), F.col("part").alias("pd"), F.col("local_id").alias("ld"))
    m = mirrors.select(F.col("id").alias("dst"), "part", "ghost_local").dropDuplicates(["dst", "part"])
    e = g.edges.join(a, "src").join(b, "dst").join(m, ["dst", "part"], "left")
    return e.select("part", F.col("ls").alias("src"), F.when(F.col("pd") == F.col("part"), F.col("ld")).otherwise(F.col("ghost_local")).alias("dst"), *rest)


def cross_graph(mirrors: DataFrame) -> DataFrame:
    """owner_local, ghost_local, tag: how mirrors are routed; tag packs owner and part."""
    return mirrors.select("owner_local", "ghost_local", encode_tag(F.col("owner"), F.col("part")).alias("tag"))


def own_cross_graph(mirrors: DataFrame, part: int) -> DataFrame:
    return mirrors.where((F.col("owner") == part) | (F.col("part") == part))


def index_lines(index: DataFrame, mirrors: DataFrame) -> DataFrame:
    """id, line: ``part local [ghost_part ghost_local]...`` (at most MAX_PARTS pairs a line)."""
    pairs = mirrors.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("part", "ghost_local"))).alias("g"))
    text = F.array_join(F.transform("g", lambda x: F.concat_ws(" ", x["part"].cast("string"), x["ghost_local"].cast("string"))), " ")
    return index.join(pairs, "id", "left").select("id", F.concat_ws(" ", F.col("part").cast("string"), F.col("local_id").cast("string"), F.when(F.size("g") > 0, text)).alias("line"))


def crossing_ratio(g: Graph, index: DataFrame) -> DataFrame:
    """One row: crossing pairs (each mirror once), edges, and the share in percent."""
    c = cross_pairs(g, index).agg(F.count("*").alias("crossing"))
    return c.join(F.broadcast(g.edges.agg(F.count("*").alias("edges")))).select("crossing", "edges", F.try_divide(F.col("crossing") * 100.0, F.col("edges")).alias("percent"))


def sync_out(values: DataFrame, mirrors: DataFrame) -> DataFrame:
    """part, local_id, value: owners' values (id, value) fanned out to their mirrors."""
    return mirrors.join(values, "id").select("part", F.col("ghost_local").alias("local_id"), "value")


def sync_in(partial: DataFrame, index: DataFrame, mirrors: DataFrame) -> DataFrame:
    """id, value: partial values (part, local_id, value) of owners and mirrors summed at the owner."""
    own = index.select("id", "part", "local_id")
    away = mirrors.select("id", "part", F.col("ghost_local").alias("local_id"))
    return partial.join(own.unionAll(away), ["part", "local_id"]).groupBy("id").agg(F.sum("value").alias("value"))


def block_of(c: str, blocks: int):
    return F.expr(f"cast(({c} div {PACK}) % {blocks} as int)")


def index_in_block(c: str, blocks: int):
    return F.expr(f"(({c} div {PACK}) div {blocks}) * {PACK} + {c} % {PACK}")


def block_ids(g: Graph, blocks: int) -> DataFrame:
    """The edges with brow, bcol, local_src, local_dst of the 2-D block-cyclic layout."""
    _checked(blocks, MAX_BLOCKS)
    return g.edges.select("*", block_of("src", blocks).alias("brow"), block_of("dst", blocks).alias("bcol"), index_in_block("src", blocks).alias("local_src"), index_in_block("dst", blocks).alias("local_dst"))


def from_blocks(e: DataFrame, blocks: int) -> DataFrame:
    """src, dst back from the block layout."""
    back = lambda b, i: F.expr(f"(({i} div {PACK}) * {blocks} + {b}) * {PACK} + {i} % {PACK}")
    return e.select(back("brow", "local_src").alias("src"), back("bcol", "local_dst").alias("dst"))


def block_edge_counts(g: Graph, blocks: int) -> DataFrame:
    return block_ids(g, blocks).groupBy("brow", "bcol").agg(F.count("*").alias("n"))
