"""Adjacency text (a line of neighbours per vertex) and partition vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.scratch import dense_ids, numbered_lines, stored


def _content(spark: SparkSession, path) -> DataFrame:
    """value, line (dense over the lines that are no comments)."""
    lines = numbered_lines(spark, path).where(~F.col("value").rlike("^[#%]"))
    return dense_ids(lines, [F.col("line")], "row").select("value", "row")


def read_adjacency(spark: SparkSession, path) -> Graph:
    """Header ``V E [fmt [ncon]]``, then a line of 1-based neighbours per vertex.

    fmt: three digits for vertex size, vertex weight and edge weight; the first weight is the
    vertex tag, further ones are skipped; a blank line is an isolated vertex (runs jobs)."""
    rows = stored(_content(spark, path), "rows")
    head = rows.where("row = 0").select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")).first()
    if head is None:
        return Graph(spark.range(0).select(F.col("id").alias("src"), F.col("id").alias("dst")), 0)
    h = head[0]
    fmt = (h[2] if len(h) > 2 else "0").zfill(3)
    size, vw, ew = (c == "1" for c in fmt[-3:])
    weights = (int(h[3]) if len(h) > 3 else 1) if vw else 0
    skip = int(size) + weights
    body = rows.where("row > 0").select((F.col("row") - 1).alias("id"), F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "").alias("f"))
    n = body.count()
    fields = F.slice("f", skip + 1, F.greatest(F.lit(0), F.size("f") - skip))
    e = body.select(F.col("id").alias("src"), F.posexplode(fields).alias("p", "x"), fields.alias("g"))
    if ew:
        e = e.where("p % 2 = 0").select("src", (F.col("x").cast("long") - 1).alias("dst"), F.coalesce(F.get("g", F.col("p") + 1).cast("long"), F.lit(0).cast("long")).alias("etag"))
    else:
        e = e.select("src", (F.col("x").cast("long") - 1).alias("dst"))
    v = body.select("id", F.get("f", F.lit(int(size))).cast("long").alias("vtag")) if vw else None
    return Graph(e, n, v)


def adjacency_lines(g: Graph) -> DataFrame:
    """row, line of the adjacency form: the header (edges halved, as the form asks), then vertices."""
    tags, vtags = g.has_etag, g.vertex_data is not None and "vtag" in g.vertex_data.columns
    item = F.struct("dst", "etag") if tags else F.struct("dst")
    text = (lambda x: F.concat_ws(" ", (x["dst"] + 1).cast("string"), x["etag"].cast("string"))) if tags else (lambda x: (x["dst"] + 1).cast("string"))
    near = g.edges.groupBy("src").agg(F.sort_array(F.collect_list(item)).alias("a")).select(F.col("src").alias("id"), F.array_join(F.transform("a", text), " ").alias("t"))
    rows = g.vertices().join(near, "id", "left")
    line = F.concat_ws(" ", *([F.col("vtag").cast("string")] if vtags else []), F.when(F.col("t") != "", F.col("t")))
    fmt = f" 0{int(vtags)}{int(tags)}" if tags or vtags else ""
    head = g.edges.agg(F.count("*").alias("m")).select(F.lit(0).cast("long").alias("row"), F.concat(F.lit(f"{g.n} "), F.expr("m div 2").cast("string"), F.lit(fmt)).alias("line"))
    return head.unionAll(rows.select((F.col("id") + 1).alias("row"), line.alias("line")))


def cleaned(g: Graph, form: str) -> Graph:
    """``dimacs`` is symmetric without loops, duplicates and isolated vertices; ``csc`` is transposed."""
    from ..operators.transform import remove_duplicates, remove_loops, remove_unconnected, symmetrize, transpose

    if form == "dimacs":
        return remove_unconnected(remove_duplicates(symmetrize(remove_loops(g))))
    return transpose(g) if form == "csc" else g


def write_adjacency(g: Graph, path: str, form: str = "csr") -> None:
    """Part files in line order."""
    lines = adjacency_lines(cleaned(g, form))
    lines.repartitionByRange("row").sortWithinPartitions("row").select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def read_vector(spark: SparkSession, path, name: str = "part") -> DataFrame:
    """id, <name>: the first number of each line, the line's number being the vertex."""
    return numbered_lines(spark, path).select(F.col("line").alias("id"), F.regexp_extract("value", r"-?\d+", 0).cast("long").alias(name))


def write_vector(values: DataFrame, path: str, column: str = "deg", order: tuple[str, ...] = ("id",)) -> None:
    """One number per line in the order of ``order``; floats with six decimals."""
    c = F.format_string("%.6f", column) if dict(values.dtypes)[column] in ("double", "float") else F.col(column).cast("string")
    values.repartitionByRange(*order).sortWithinPartitions(*order).select(c.alias("value")).write.mode("overwrite").text(path)


def read_matrix(spark: SparkSession, path) -> DataFrame:
    """bin_src, bin_dst, value of a square row-major list of numbers (runs a job)."""
    v = stored(numbered_lines(spark, path), "matrix")
    side = round(v.count() ** 0.5)
    return v.select(F.expr(f"cast(line div {max(side, 1)} as int)").alias("bin_src"), F.expr(f"cast(line % {max(side, 1)} as int)").alias("bin_dst"), F.trim("value").cast("double").alias("value"))
