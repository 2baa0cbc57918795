"""PageRank as joins and aggregations, in four plan shapes.

All shapes compute one Jacobi step ``new = d * sum(rank / deg_out over in-edges) + base`` with
``base = (d * dangling mass + 1 - d) / n`` and differ in where work is shared:

* ``def``: rank / degree is divided on every edge;
* ``stp``: it is divided once per vertex, before the join;
* ``rdx``: partial sums per block of the 2-D layout, then per vertex;
* ``part``: partial sums per part of an edge cut, then mirrors add to their owners.

The edges are held hash-partitioned by source, so a step shuffles ranks (n rows) and partial
sums, never edges; Spark broadcasts the ranks by itself while they are small.  The dangling mass
is a one-row aggregate joined in the same job.  Every ``local_iterations`` steps the ranks go to the
shared folder, which cuts lineage and survives lost executors, and the L1 change of the last step
comes from the same table."""

from __future__ import annotations

import fnmatch
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from .scratch import stored


@dataclass(frozen=True)
class Options:
    damping: float = 0.85
    epsilon: float = 1e-6
    min_iterations: int = 1
    max_iterations: int = 250
    local_iterations: int = 2
    blocks: int = 4
    parts: int = 4


@dataclass
class Result:
    ranks: DataFrame
    iterations: int
    diff: float
    seconds: dict[str, float] = field(default_factory=dict)


def _prepare(g: Graph, plan: str, opt: Options) -> tuple[DataFrame, DataFrame]:
    """(vertices id, deg; edges src, dst and what the plan groups by), the edges cached by source.

    Parallel edges fold into one row with a multiplicity, which every plan multiplies in."""
    from ..operators.partition import block_of, block_parts

    e = g.edges.select("src", "dst")
    if plan == "rdx":
        e = e.select("src", "dst", block_of("src", opt.blocks).alias("brow"), block_of("dst", opt.blocks).alias("bcol"))
    elif plan == "part":
        e = e.join(block_parts(g, opt.parts).select(F.col("id").alias("src"), "part"), "src")
    folded = e.groupBy(*e.columns).agg(F.count("*").alias("c")).repartition("src").persist()
    deg = folded.groupBy("src").agg(F.sum("c").alias("deg"))
    v = g.spark.range(g.n).join(deg, F.col("id") == F.col("src"), "left").select("id", F.coalesce("deg", F.lit(0).cast("long")).alias("deg"))
    return stored(v, "pagerank-vertices"), folded


def _sums(ranks: DataFrame, edges: DataFrame, plan: str) -> DataFrame:
    """dst, s: what flows into every vertex with in-edges."""
    live = ranks.where("deg > 0")
    if plan == "def":
        return edges.join(live.select(F.col("id").alias("src"), "rank", "deg"), "src").groupBy("dst").agg(F.sum(F.col("c") * (F.col("rank") / F.col("deg"))).alias("s"))
    flow = live.select(F.col("id").alias("src"), (F.col("rank") / F.col("deg")).alias("x"))
    e = edges.join(flow, "src")
    if plan == "stp":
        return e.groupBy("dst").agg(F.sum(F.col("c") * F.col("x")).alias("s"))
    by = ["brow", "bcol"] if plan == "rdx" else ["part"]
    partial = e.groupBy(*by, "dst").agg(F.sum(F.col("c") * F.col("x")).alias("p"))
    return partial.groupBy("dst").agg(F.sum("p").alias("s"))


def step(ranks: DataFrame, edges: DataFrame, n: int, damping: float, plan: str = "stp") -> DataFrame:
    """id, deg, rank, prev after one step."""
    dangling = ranks.agg(F.coalesce(F.sum(F.when(F.col("deg") == 0, F.col("rank"))), F.lit(0.0)).alias("dangling"))
    base = dangling.select((F.lit(damping) * F.col("dangling") / F.lit(n) + F.lit((1 - damping) / n)).alias("base"))
    s = _sums(ranks, edges, plan).select(F.col("dst").alias("id"), "s")
    return ranks.join(s, "id", "left").join(F.broadcast(base)).select("id", "deg", (F.lit(damping) * F.coalesce("s", F.lit(0.0)) + F.col("base")).alias("rank"), F.col("rank").alias("prev"))


def pagerank(g: Graph, plan: str = "stp", options: Options = Options(), steps: int | None = None) -> Result:
    """Ranks (id, rank).  With ``steps`` exactly that many steps; else until the L1 change of the last
    of ``local_iterations`` steps is at most epsilon, within the bounds."""
    if plan not in ("def", "stp", "rdx", "part"):
        raise ValueError(f"no plan {plan!r}")
    if g.n == 0:
        return Result(g.spark.range(0).select("id", F.lit(0.0).alias("rank")), 0, 0.0)
    t0 = time.perf_counter()
    vertices, edges = _prepare(g, plan, options)
    t1 = time.perf_counter()
    ranks = vertices.select("id", "deg", F.lit(1.0 / g.n).alias("rank"))
    done, diff = 0, float("inf")
    try:
        while (steps is not None and done < steps) or (steps is None and (done < options.min_iterations or (done < options.max_iterations and diff > options.epsilon))):
            for _ in range(options.local_iterations if steps is None else min(options.local_iterations, steps - done)):
                ranks = step(ranks.select("id", "deg", "rank"), edges, g.n, options.damping, plan)
                done += 1
            ranks = stored(ranks, "ranks")
            if steps is None or done >= steps:
                diff = ranks.agg(F.sum(F.abs(F.col("rank") - F.col("prev")))).first()[0]
    finally:
        edges.unpersist()
    return Result(ranks.select("id", "rank"), done, diff, {"init": t1 - t0, "rank": time.perf_counter() - t1})


def check(result: DataFrame, reference: DataFrame, tolerance: float = 10 * 1.1920929e-07, share: float = 0.05, total: float = 1e-3) -> DataFrame:
    """One row: bad_share, total and ok of a result against a reference (id, rank)."""
    j = result.join(reference.select("id", F.col("rank").alias("ref")), "id")
    one = j.agg(F.avg((F.abs(F.col("rank") - F.col("ref")) > tolerance).cast("int")).alias("bad_share"), F.sum("rank").alias("total"))
    return one.select("bad_share", "total", ((F.col("bad_share") <= share) & (F.abs(F.col("total") - 1) <= total)).alias("ok"))


def spmv_weights(g: Graph) -> DataFrame:
    """src, dst, w = 1 / deg_out(src): the matrix of the product form."""
    deg = g.edges.groupBy("src").agg(F.count("*").alias("d"))
    return g.edges.select("src", "dst").join(deg, "src").select("src", "dst", (F.lit(1.0) / F.col("d")).alias("w"))


def spmv(weights: DataFrame, x: DataFrame) -> DataFrame:
    """id, y: the product of the transposed matrix with x (id, x)."""
    return weights.join(x, weights["src"] == x["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("x")).alias("y"))


#: device and method families in solver names -> plan shape
_METHODS = {"def": "def", "map": "def", "stp": "stp", "wrp": "stp", "mix": "stp", "dyn": "stp", "bin": "stp", "lib": "stp", "rdx": "rdx"}
_NAMES = {
    "ref": ("def", "stp", "map"), "omp": ("def", "stp", "map", "rdx"), "ocl": ("map", "stp", "wrp", "mix"), "cud": ("map", "stp", "wrp", "dyn", "mix"), "spu": ("map", "stp", "rdx"), "mpi": ("def", "stp", "map", "rdx"),
}


class Registry:
    """Solvers by name, to be switched on and off by glob patterns (``!`` negates)."""

    def __init__(self):
        self.solvers: dict[str, Callable[..., Result]] = {}
        self.active: dict[str, bool] = {}
        for layout in ("csc", "csr"):
            for name in ("mkl_lib", "cud_lib", "omp_bin"):
                self.add(f"pr_{layout}_{name}", _METHODS[name[-3:]])
            for device, methods in _NAMES.items():
                for m in methods:
                    self.add(f"pr_b{layout}_{device}_{m}", _METHODS[m])
        for layout in ("pcsc", "pcsr"):
            for m in ("def", "stp", "map"):
                self.add(f"pr_{layout}_mpi_{m}", "part")

    def add(self, name: str, plan: str) -> None:
        self.solvers[name] = lambda g, options=Options(), steps=None, plan=plan: pagerank(g, plan, options, steps)
        self.active[name] = True

    def toggle(self, pattern: str, on: bool = True) -> int:
        """Switch the solvers whose name matches; a leading ``!`` takes those that don't."""
        negate, glob = pattern.startswith("!"), pattern.lstrip("!")
        hit = [n for n in self.solvers if fnmatch.fnmatchcase(n, glob) != negate]
        self.active.update(dict.fromkeys(hit, on))
        return len(hit)

    def names(self, active_only: bool = False) -> list[str]:
        """Active ones first, otherwise in order of registration."""
        order = sorted(self.solvers, key=lambda n: not self.active[n])
        return [n for n in order if self.active[n] or not active_only]

    def count(self) -> int:
        return sum(self.active.values())


def kernels(g: Graph, damping: float = 0.85) -> dict[str, DataFrame]:
    """The steps of an iteration as tables of their own, for timing and tests."""
    from ..operators.stats import out_degree

    r = out_degree(g).withColumn("rank", F.lit(1.0 / max(1, g.n)))
    tmp = r.where("deg > 0").select("id", (F.col("rank") / F.col("deg")).alias("tmp"))
    sums = g.edges.join(tmp, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum("tmp").alias("s"))
    return {
        "fill": r.select("id", F.lit(1.0).alias("x")), "add": r.select("id", (F.col("rank") + F.lit(1.0)).alias("x")), "asum": r.agg(F.sum("rank").alias("x")),
        "base": r.agg((F.coalesce(F.sum(F.when(F.col("deg") == 0, F.col("rank"))), F.lit(0.0)) * (damping / max(1, g.n)) + (1 - damping) / max(1, g.n)).alias("x")),
        "base_mapped": r.select("id", F.when(F.col("deg") == 0, F.col("rank")).otherwise(0.0).alias("x")), "tmp": tmp, "update": sums,
        "dest": sums.select(F.col("dst").alias("id"), (F.col("s") * damping + (1 - damping) / max(1, g.n)).alias("x")), "diff_mapped": r.select("id", F.abs(F.col("rank") - F.lit(0.0)).alias("x")),
        "diff": r.agg(F.sum(F.abs(F.col("rank") - F.lit(0.0))).alias("x")), "weights": spmv_weights(g),
    }
