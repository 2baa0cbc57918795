"""Transforms: Graph in, Graph out; all lazy unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.scratch import dense_ids, stored


def transpose(g: Graph) -> Graph:
    """Every edge turned round; a projection."""
    rest = [c for c in g.edges.columns if c not in ("src", "dst")]
    return g.with_edges(g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def symmetrize(g: Graph) -> Graph:
    """Each edge and its reverse, loops twice (bag semantics); one scan that doubles rows."""
    rest = [c for c in g.edges.columns if c not in ("src", "dst")]
    ends = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return g.with_edges(g.edges.select(ends.alias("e"), *rest).select("e.src", "e.dst", *rest))


def to_undirected(g: Graph, keep: str = "upper") -> Graph:
    """Edges of one triangle: ``upper`` src <= dst, ``lower`` dst <= src."""
    return g.with_edges(g.edges.where("src <= dst" if keep == "upper" else "dst <= src"))


def remove_duplicates(g: Graph, merge: Callable[[Column], Column] = F.sum) -> Graph:
    """One edge per (src, dst); tags folded by ``merge`` (an aggregate, default the sum)."""
    extra = [c for c in g.edges.columns if c not in ("src", "dst", "etag")]
    aggs = ([merge(F.col("etag")).cast("long").alias("etag")] if g.has_etag else []) + [F.first(c).alias(c) for c in extra]
    return g.with_edges(g.edges.groupBy("src", "dst").agg(*aggs) if aggs else g.edges.select("src", "dst").distinct())


def remove_loops(g: Graph) -> Graph:
    return g.with_edges(g.edges.where("src <> dst"))


def _relabel(g: Graph, mapping: DataFrame, n: int) -> Graph:
    """Endpoints through ``mapping`` (id, new_id); vertices without a new id lose their edges.

    Spark broadcasts a mapping of small known size by itself; a large one costs two shuffles."""
    rest = [c for c in g.edges.columns if c not in ("src", "dst")]
    a, b = (mapping.select(F.col("id").alias(c), F.col("new_id").alias(f"n_{c}")) for c in ("src", "dst"))
    e = g.edges.join(a, "src").join(b, "dst").select(F.col("n_src").alias("src"), F.col("n_dst").alias("dst"), *rest)
    v = g.vertex_data
    if v is not None:
        v = v.join(mapping, "id").drop("id").withColumnRenamed("new_id", "id").select("id", *(c for c in v.columns if c != "id"))
    return replace(g, edges=e, n=n, vertex_data=v)


def remove_unconnected(g: Graph) -> Graph:
    """Drop vertices without any edge; the others are numbered densely in their old order (runs jobs)."""
    used = g.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    mapping = stored(dense_ids(used, [F.col("id")], "new_id"), "mapping")
    return _relabel(g, mapping, mapping.count())


def sort_by_degree(g: Graph) -> Graph:
    """Number vertices by falling out-degree, ties by id (runs jobs)."""
    from .stats import out_degree

    ordered = dense_ids(out_degree(g), [F.col("deg").desc(), F.col("id")], "new_id").select("id", "new_id")
    return _relabel(g, stored(ordered, "mapping"), g.n)


def align_edges(g: Graph, multiple: int, dst: int) -> Graph:
    """Pad each vertex's edges to a multiple with edges to ``dst`` (at most the last vertex)."""
    deg = g.edges.groupBy("src").agg(F.count("*").alias("d"))
    pad = deg.withColumn("p", F.pmod(-F.col("d"), F.lit(multiple))).where("p > 0")
    cols = [F.col("src"), F.lit(min(dst, g.n - 1)).cast("long").alias("dst"), *(F.lit(0).cast("long").alias("etag") if c == "etag" else F.lit(None).cast(g.edges.schema[c].dataType).alias(c) for c in g.edges.columns if c not in ("src", "dst"))]
    rows = pad.select("src", F.explode(F.sequence(F.lit(1), F.col("p").cast("int")))).select(*cols)
    return g.with_edges(g.edges.unionByName(rows))


def mapped_copy(g: Graph, edge_filter: Column | None = None, src: Column | None = None, dst: Column | None = None, etag: Column | None = None) -> Graph:
    """Filter and relabel edges by column expressions; n is the largest new id and one (runs a job)."""
    e = g.edges if edge_filter is None else g.edges.where(edge_filter)
    cols = {"src": F.col("src") if src is None else src, "dst": F.col("dst") if dst is None else dst}
    if etag is not None:
        cols["etag"] = etag
    rest = [c for c in e.columns if c not in cols]
    return Graph.from_edges(e.select(*(v.cast("long").alias(k) for k, v in cols.items()), *rest))


def vertex_range(g: Graph) -> DataFrame:
    """One row: least and largest endpoint."""
    return g.edges.agg(F.min(F.least("src", "dst")).alias("lo"), F.max(F.greatest("src", "dst")).alias("hi"))


def shift_vertices(g: Graph, k: int) -> Graph:
    return g.with_edges(g.edges.withColumns({"src": F.col("src") + F.lit(k), "dst": F.col("dst") + F.lit(k)}), max(0, g.n + k))


def rebase_vertices(g: Graph, zero: int = 0) -> Graph:
    """Shift so that the least endpoint is ``zero`` (runs a job)."""
    lo = vertex_range(g).first().lo
    return g if lo is None else shift_vertices(g, zero - lo)


def insert_vertices(g: Graph, at: int, count: int = 1) -> Graph:
    """Open a gap of ``count`` isolated vertices at ``at``."""
    move = lambda c: F.when(F.col(c) >= at, F.col(c) + F.lit(count)).otherwise(F.col(c))
    v = None if g.vertex_data is None else g.vertex_data.withColumn("id", move("id"))
    return replace(g, edges=g.edges.withColumns({"src": move("src"), "dst": move("dst")}), n=g.n + count, vertex_data=v)


def add_vertices(g: Graph, count: int = 1) -> Graph:
    return insert_vertices(g, g.n, count)


def add_edges(g: Graph, pairs: list[tuple[int, int]], count: int = 1) -> Graph:
    """Append ``count`` copies of each pair, tags 0; the list is the caller's own."""
    rows = g.spark.createDataFrame(pairs, "src long, dst long").select("src", "dst", F.explode(F.sequence(F.lit(1), F.lit(count)))).drop("col")
    return add_edgelist(g, rows)


def add_edgelist(g: Graph, rows: DataFrame) -> Graph:
    """Append the edges of a table (src, dst, optionally the graph's further columns)."""
    for c in g.edges.columns:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(0).cast("long") if c == "etag" else F.lit(None).cast(g.edges.schema[c].dataType))
    top = rows.agg(F.max(F.greatest("src", "dst"))).first()[0]
    return g.with_edges(g.edges.unionByName(rows.select(*g.edges.columns)), max(g.n, -1 if top is None else top + 1) if top is not None else g.n)


def clear(g: Graph) -> Graph:
    return Graph(g.edges.limit(0), 0, None)


def clear_tags(g: Graph) -> Graph:
    e = g.edges.withColumn("etag", F.lit(0).cast("long")) if g.has_etag else g.edges
    v = g.vertex_data
    return replace(g, edges=e, vertex_data=v if v is None or "vtag" not in v.columns else v.withColumn("vtag", F.lit(0).cast("long")))


def toggle(g: Graph, flag: str, on: bool) -> Graph:
    """Add or drop an optional column (TAG_E, TAG_V, DEG_I, DEG_O) or sort partitions (SORT)."""
    from .stats import in_degree, out_degree

    if flag == "TAG_E":
        return g.with_edges(g.edges.withColumn("etag", F.lit(0).cast("long")) if on and not g.has_etag else g.edges.drop("etag") if not on else g.edges)
    if flag == "SORT":
        return g.with_edges(g.edges.sortWithinPartitions("src", "dst")) if on else g
    if flag == "PIN":
        if on:
            g.edges.persist()
        else:
            g.edges.unpersist()
        return g
    name = {"TAG_V": "vtag", "DEG_I": "deg_in", "DEG_O": "deg_out"}[flag]
    base = g.vertices()
    if not on:
        return replace(g, vertex_data=base.drop(name))
    if name in base.columns:
        return g
    if flag == "TAG_V":
        return replace(g, vertex_data=base.withColumn("vtag", F.lit(0).cast("long")))
    deg = (in_degree if flag == "DEG_I" else out_degree)(g).withColumnRenamed("deg", name)
    return replace(g, vertex_data=base.join(deg, "id"))


def set_edge_tag(g: Graph, src: int, dst: int, tag: int) -> Graph:
    old = F.col("etag") if g.has_etag else F.lit(0).cast("long")
    return g.with_edges(g.edges.withColumn("etag", F.when((F.col("src") == src) & (F.col("dst") == dst), F.lit(tag).cast("long")).otherwise(old)))


def edge_tag(g: Graph, src: int, dst: int) -> DataFrame:
    tag = F.col("etag") if g.has_etag else F.lit(0).cast("long").alias("etag")
    return g.edges.where((F.col("src") == src) & (F.col("dst") == dst)).select(tag)


def set_vertex_tag(g: Graph, vertex: int, tag: int) -> Graph:
    v = toggle(g, "TAG_V", True).vertices()
    return replace(g, vertex_data=v.withColumn("vtag", F.when(F.col("id") == vertex, F.lit(tag).cast("long")).otherwise(F.col("vtag"))))


def edge_exists(g: Graph, pairs: DataFrame) -> DataFrame:
    """The pairs (src, dst) that are edges: a semi join."""
    return pairs.join(g.edges.select("src", "dst"), ["src", "dst"], "left_semi")


def edge_index(g: Graph) -> DataFrame:
    """src, dst, idx: places in (src, dst) order (runs jobs)."""
    return dense_ids(g.edges.select("src", "dst"), [F.col("src"), F.col("dst")], "idx")


def adjacency(g: Graph) -> DataFrame:
    """id, neighbours (sorted array): the row view; vertices without edges have an empty array.

    A hub's row holds all its neighbours in one cell; use the edge table where hubs are huge."""
    rows = g.edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("neighbours")).withColumnRenamed("src", "id")
    return g.vertices().select("id").join(rows, "id", "left").select("id", F.coalesce("neighbours", F.expr("cast(array() as array<bigint>)")).alias("neighbours"))


def row_index(g: Graph) -> DataFrame:
    """id, first: where each vertex's edges begin in (src, dst) order, for ids 0..n.

    Running sums are taken per block of ids and joined by the sums of the blocks before."""
    from .stats import out_degree

    size = 1 << 16
    deg = out_degree(g).withColumn("blk", F.expr(f"id div {size}"))
    from pyspark.sql import Window

    w = Window.partitionBy("blk").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    inside = deg.select("id", "blk", "deg", (F.sum("deg").over(w) - F.col("deg")).alias("x"))
    blocks = deg.groupBy("blk").agg(F.sum("deg").alias("d"))  # n / 65536 rows
    before = blocks.select("blk", (F.sum("d").over(Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("d")).alias("before"))
    rows = inside.join(before, "blk").select("id", (F.col("x") + F.col("before")).alias("first"))
    return rows.unionAll(g.edges.agg(F.count("*").alias("first")).select(F.lit(g.n).cast("long").alias("id"), "first"))


def sanitize(g: Graph, no_loops: bool = False, directed: bool = False, undirected: bool = False, unique: bool = False, connected: bool = False, transposed: bool = False, sort: bool = False, align: int = 0, keep: str = "lower", explain_counts: bool = False) -> Graph:
    """The cleaning pipeline, in the fixed order of its switches; counts only on request."""
    steps = [
        (no_loops, remove_loops), (directed, symmetrize), (undirected, lambda x: to_undirected(x, keep)), (unique, remove_duplicates),
        (connected, remove_unconnected), (transposed, transpose), (sort, sort_by_degree), (align > 0, lambda x: align_edges(add_vertices(x), align, x.n)),
    ]
    if transposed and directed and not undirected:
        raise ValueError("a symmetrized graph is its own transpose")
    for on, step in steps:
        if on:
            g = step(g)
            if explain_counts:
                print(f"{getattr(step, '__name__', 'step')}: {g.n} vertices, {g.edge_count()} edges")
    return g
