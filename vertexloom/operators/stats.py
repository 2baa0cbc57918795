"""Graph statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.scratch import dense_ids, stored


def _degree(g: Graph, side: str) -> DataFrame:
    ends = F.explode(F.array("src", "dst")) if side == "both" else F.col({"out": "src", "in": "dst"}[side])
    count = g.edges.select(ends.alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    return g.spark.range(g.n).join(count, "id", "left").select("id", F.coalesce("d", F.lit(0).cast("long")).alias("deg"))


def out_degree(g: Graph) -> DataFrame:
    """id, deg of all 0..n-1; parallel edges and loops count."""
    return _degree(g, "out")


def in_degree(g: Graph) -> DataFrame:
    return _degree(g, "in")


def degree(g: Graph) -> DataFrame:
    """In and out; a loop counts twice."""
    return _degree(g, "both")


def block_degree(g: Graph, blocks: int, side: str = "out") -> DataFrame:
    """brow, bcol, id, deg: degrees within each block of the 2-D layout."""
    from .partition import block_ids

    e = block_ids(g, blocks)
    return e.groupBy("brow", "bcol", F.col("src" if side == "out" else "dst").alias("id")).agg(F.count("*").alias("deg"))


def histogram(values: DataFrame, column: str = "deg", size: int | None = None) -> DataFrame:
    """deg, n for every degree from 0 to the largest (or below ``size``), zeros included (runs a job)."""
    counts = values.groupBy(F.col(column).alias("deg")).agg(F.count("*").alias("n"))
    top = size - 1 if size is not None else values.agg(F.max(column)).first()[0]
    every = values.sparkSession.range(0 if top is None else top + 1).withColumnRenamed("id", "deg")
    return every.join(counts, "deg", "left").select("deg", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


#: quantile in hundredths -> which end the rank is counted from
QUANTILES = {0: "low", 5: "low", 10: "low", 25: "low", 50: "low", 75: "high", 90: "high", 95: "high", 100: "high"}


def summary(values: DataFrame, column: str = "deg") -> DataFrame:
    """One row: avg, stddev (population), skewness 3(avg - median)/stddev, and exact quantiles.

    Ranks: floor(n q) from below up to the median, floor(n (1 - q)) from above beyond it.  Reads
    ranks from the counts per value, so only distinct values are ordered, not all rows."""
    counts = stored(values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c")), "counts")
    upto = counts.select("v", "c", F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    total = counts.agg(F.sum("c").alias("n"))
    ranked = upto.join(F.broadcast(total))
    at = {q: F.expr(f"n * {q} div 100") if end == "low" else F.expr(f"n - 1 - (n * {100 - q} div 100)") for q, end in QUANTILES.items()}
    picks = [F.min(F.when(F.col("upto") > r, F.col("v"))).alias(f"p{q}") for q, r in at.items()]
    n, s, ss = F.max("n"), F.sum(F.col("v") * F.col("c")), F.sum(F.col("v").cast("double") * F.col("v") * F.col("c"))
    one = ranked.agg(n.cast("long").alias("n"), (s / n).alias("avg"), F.sqrt(F.greatest(F.lit(0.0), ss / n - (s / n) * (s / n))).alias("stddev"), *picks)
    return one.select("avg", "stddev", F.when(F.col("stddev") > 0, 3 * (F.col("avg") - F.col("p50")) / F.col("stddev")).alias("skewness"), *(f"p{q}" for q in QUANTILES))


def heat_map(g: Graph, bins: int = 4096, dense: bool = True) -> DataFrame:
    """bin_src, bin_dst, value: edges per cell times bins / n; ``dense`` fills the empty cells."""
    v = F.lit(float(g.n))
    cell = lambda c: F.floor(F.col(c).cast("double") / v * F.lit(float(bins))).cast("int")
    hit = g.edges.groupBy(cell("src").alias("bin_src"), cell("dst").alias("bin_dst")).agg((F.count("*") * F.lit(float(bins)) / v).alias("value"))
    if not dense:
        return hit
    cells = g.spark.range(bins * bins).select(F.expr(f"cast(id div {bins} as int)").alias("bin_src"), F.expr(f"cast(id % {bins} as int)").alias("bin_dst"))
    return cells.join(hit, ["bin_src", "bin_dst"], "left").select("bin_src", "bin_dst", F.coalesce("value", F.lit(0.0)).alias("value"))


def clustering(g: Graph, salts: int = 16) -> DataFrame:
    """One row: closed (triples v1->v2->v3 with an edge v1->v3, all distinct), triples, value.

    Parallel edges multiply the two hops, while the closing edge only has to exist.  Edges are
    first folded to distinct pairs with multiplicities; the wedge join is salted on the middle
    vertex's in-edges so that a hub spreads over ``salts`` tasks, and wedges meet the closing
    edges without being written as rows of their own."""
    w = stored(g.edges.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("c")), "pairs")
    salted = w.select(F.col("src").alias("a"), F.col("dst").alias("m"), F.col("c").alias("c1"), F.pmod(F.xxhash64("src"), F.lit(salts)).alias("s"))
    spread = w.select(F.col("src").alias("m"), F.col("dst").alias("b"), F.col("c").alias("c2"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("s"))
    wedge = salted.join(spread, ["m", "s"]).where("a <> b")
    close = w.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    closed = wedge.join(close, ["a", "b"], "left_semi").agg(F.coalesce(F.sum(F.col("c1") * F.col("c2")), F.lit(0).cast("long")).alias("closed"))
    triples = g.edges.groupBy("src").agg(F.count("*").alias("d")).agg(F.coalesce(F.sum(F.col("d") * (F.col("d") - 1)), F.lit(0).cast("long")).alias("triples"))
    return closed.join(F.broadcast(triples)).select("closed", "triples", F.try_divide(F.col("closed").cast("double"), F.col("triples").cast("double")).alias("value"))


def avg_neighbour_degree(g: Graph, side: str = "in") -> DataFrame:
    """One row: sum of squared degrees over n (what summing the neighbours' degrees comes to)."""
    d = g.edges.groupBy("dst" if side == "in" else "src").agg(F.count("*").alias("d"))
    return d.agg(F.try_divide(F.coalesce(F.sum(F.col("d") * F.col("d")), F.lit(0)).cast("double"), F.lit(float(g.n))).alias("value"))


def assortativity(g: Graph) -> DataFrame:
    """One row: sums sd = o*i, so, si, soo, sii over edges of o = deg_out(src)-1, i = deg_in(dst)-1, and
    the correlation with 1 added inside the root, so that it is always defined."""
    o = g.edges.groupBy("src").agg((F.count("*") - 1).alias("o"))
    i = g.edges.groupBy("dst").agg((F.count("*") - 1).alias("i"))
    oi = g.edges.select("src", "dst").join(o, "src").join(i, "dst").agg(F.sum(F.col("o") * F.col("i")).alias("s_oi"))
    # the four other sums need no edge table: a degree d contributes d rows
    so = o.agg(F.sum((F.col("o") + 1) * F.col("o")).alias("s_o"), F.sum((F.col("o") + 1) * F.col("o") * F.col("o")).alias("s_oo"), F.sum(F.col("o") + 1).alias("m"))
    si = i.agg(F.sum((F.col("i") + 1) * F.col("i")).alias("s_i"), F.sum((F.col("i") + 1) * F.col("i") * F.col("i")).alias("s_ii"))
    one = oi.join(F.broadcast(so)).join(F.broadcast(si)).select(*(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("s_oi", "s_o", "s_i", "s_oo", "s_ii", "m")))
    m, x = F.col("m").cast("double"), {c: F.col(c).cast("double") for c in ("s_oi", "s_o", "s_i", "s_oo", "s_ii")}
    over = m * x["s_oi"] - x["s_o"] * x["s_i"]
    root = F.sqrt((m * x["s_oo"] - x["s_o"] * x["s_o"]) * (m * x["s_ii"] - x["s_i"] * x["s_i"]) + 1)
    return one.select("s_oi", "s_o", "s_i", "s_oo", "s_ii", F.coalesce(over / root, F.lit(0.0)).alias("value"))


def edge_order(g: Graph) -> DataFrame:
    """src, dst, eid: edges numbered in (src, dst) order (runs jobs)."""
    return dense_ids(g.edges.select("src", "dst"), [F.col("src"), F.col("dst")], "eid")


def stride(g: Graph, ordered: DataFrame | None = None, segment: int = 1 << 20) -> DataFrame:
    """One row: packing n*n/E, mean step of dst between neighbours of one source, between any
    consecutive edges, and |src - dst|; whole-number means, null where undefined.

    The step to the preceding edge is a window per segment of ``segment`` edges with the segments'
    last edges looked up beside, so the order is never held in one task."""
    e = ordered if ordered is not None else edge_order(g)
    e = stored(e.withColumn("seg", F.expr(f"eid div {segment}")), "ordered")
    w = Window.partitionBy("seg").orderBy("eid")
    ends = e.groupBy((F.col("seg") + 1).alias("seg")).agg(F.max_by("src", "eid").alias("ls"), F.max_by("dst", "eid").alias("ld"))
    step = e.select("*", F.lag("src").over(w).alias("ps"), F.lag("dst").over(w).alias("pd")).join(F.broadcast(ends), "seg", "left")
    ps, pd = F.coalesce("ps", "ls", F.lit(0)), F.coalesce("pd", "ld", F.lit(0))
    step = step.select((ps == F.col("src")).alias("same"), F.abs(F.col("dst") - pd).alias("d"), F.abs(F.col("src") - F.col("dst")).alias("diag"))
    one = step.agg(F.count("*").alias("m"), F.sum(F.when(F.col("same"), F.col("d"))).alias("sv"), F.count_if("same").alias("cv"), F.sum("d").alias("sg"), F.sum("diag").alias("sd"))
    n = F.lit(g.n).cast("long")
    div = lambda a, b: F.expr(f"case when {b} > 0 then {a} div {b} end")
    one = one.withColumn("nn", n * n)
    return one.select(div("nn", "m").alias("packing"), div("sv", "cv").alias("vertex"), div("sg", "m").alias("global"), div("sd", "m").alias("diagonal"))


def cache_hits(g: Graph, window: int = 4096, lanes: int = 16, compat: bool = True, ordered: DataFrame | None = None) -> DataFrame:
    """One row: edges that repeat a cached slot (time), share a cached line (local) or miss.

    A line is ``lanes`` neighbouring vertices; it lives while it is touched at least every
    ``window`` edges.  With ``compat`` the touch that loads a line marks the slots that the bits of
    its own number name (shifted by one) instead of itself."""
    e = ordered if ordered is not None else edge_order(g)
    e = e.select("eid", F.expr(f"dst div {lanes}").alias("line"), (F.col("dst") % lanes).cast("int").alias("slot"))
    by_line = Window.partitionBy("line").orderBy("eid")
    gap = F.col("eid") - F.lag("eid").over(by_line)
    e = e.withColumn("miss", (gap.isNull() | (gap > window)).cast("int"))
    e = e.withColumn("life", F.sum("miss").over(by_line.rowsBetween(Window.unboundedPreceding, 0)))
    life = Window.partitionBy("line", "life").orderBy("eid")
    e = e.withColumn("first", F.first("slot").over(life.rowsBetween(Window.unboundedPreceding, 0)))
    mine = Window.partitionBy("line", "life", "slot", "miss").orderBy("eid")
    e = e.withColumn("again", F.row_number().over(mine) > 1)
    marked = F.expr("shiftright(first, slot + 1) & 1") == 1 if compat else F.col("slot") == F.col("first")
    kind = F.when(F.col("miss") == 1, "miss").when(marked | F.col("again"), "time").otherwise("local")
    return e.select(kind.alias("k")).agg(F.count_if(F.col("k") == "time").alias("time"), F.count_if(F.col("k") == "local").alias("local"), F.count_if(F.col("k") == "miss").alias("miss"))


def stats_row(g: Graph) -> DataFrame:
    """One row of clustering, neighbour degrees and assortativity."""
    c, i, o, a = clustering(g).select(F.col("value").alias("clustering")), avg_neighbour_degree(g, "in").select(F.col("value").alias("avg_in")), avg_neighbour_degree(g, "out").select(F.col("value").alias("avg_out")), assortativity(g).select(F.col("value").alias("assortativity"))
    return c.join(F.broadcast(i)).join(F.broadcast(o)).join(F.broadcast(a))


def byte_size(g: Graph) -> dict[str, int]:
    """Bytes that 32-bit arrays of the edge list and of the row layout would take (runs a job)."""
    m, tags = g.edge_count(), g.has_etag
    return {"edge_list": 4 * m * (3 if tags else 2), "rows": 4 * (g.n + 1 + m * (2 if tags else 1)), "edges": m, "vertices": g.n}
