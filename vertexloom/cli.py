"""Command lines of the tools: ``python -m vertexloom.cli TOOL ...``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.scalars import parse_bound, parse_size
from .operators import generate, partition, stats, tokens, transform
from .plans import pagerank as pr
from .plans.scratch import numbered_lines
from .sources import adjacency, edges, partition_files

SIDES = {"in": "in", "i": "in", "out": "out", "o": "out", "both": "both", "b": "both"}


def _io(p: argparse.ArgumentParser, output: bool = True) -> None:
    p.add_argument("-I", "-f", "--input-format", default=None)
    p.add_argument("-i", "--input", required=True)
    if output:
        p.add_argument("-o", "--output", default=None)
        p.add_argument("-O", "--output-format", default=None)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="vertexloom")
    sub = top.add_subparsers(dest="tool", required=True)
    p = sub.add_parser("graphdeg", help="degrees, their histogram or summary")
    p.add_argument("-m", "--mode", default="both", choices=sorted(SIDES))
    p.add_argument("-H", "--histogram", action="store_true")
    p.add_argument("-s", "--summary", action="store_true")
    _io(p)
    p = sub.add_parser("graphgen", help="generate a graph")
    p.add_argument("-a", "--algorithm", default="random")
    p.add_argument("-v", "--vertices", type=parse_size, required=True)
    p.add_argument("-e", "--edges", type=parse_size, default=0)
    p.add_argument("-m", "--mean-degree", type=parse_size, default=0)
    p.add_argument("-r", "--seed", type=int, default=12345)
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-O", "--output-format", default="el")
    p = sub.add_parser("graphheat", help="heat map of edges")
    p.add_argument("-b", "--bins", type=parse_size, default=4096)
    _io(p)
    p = sub.add_parser("graphpart", help="partition a graph")
    p.add_argument("parts", type=int)
    p.add_argument("base")
    p.add_argument("-m", "--method", default="block", choices=["block", "random", "file"])
    p.add_argument("-p", "--partition-file")
    p.add_argument("-n", "--no-merge", action="store_true")
    p.add_argument("-x", "--no-index", action="store_true")
    p.add_argument("-s", "--no-subgraph", action="store_true")
    p.add_argument("-c", "--no-crossgraph", action="store_true")
    p.add_argument("-r", "--seed", type=int, default=0)
    _io(p, output=False)
    p = sub.add_parser("graphsan", help="clean a graph")
    for short, name in (("-l", "no-loops"), ("-d", "directed"), ("-u", "undirected"), ("-q", "unique"), ("-c", "connected"), ("-t", "transpose"), ("-s", "sort")):
        p.add_argument(short, f"--{name}", action="store_true")
    p.add_argument("-m", "--matrix", action="store_true", help="as -l -d -q -c")
    p.add_argument("-a", "--align", type=int, default=0)
    p.add_argument("--counts", action="store_true")
    _io(p)
    p = sub.add_parser("graphstride", help="locality statistics")
    p.add_argument("-t", "--transpose", action="store_true")
    _io(p, output=False)
    p = sub.add_parser("strtoidx", help="tokens to numbers")
    p.add_argument("-f", "--first", type=int, default=0)
    p.add_argument("-l", "--skip-lines", type=int, default=0)
    p.add_argument("-s", "--skip", default="#%")
    p.add_argument("-d", "--delimiters", default=tokens.DELIMITERS)
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-o", "--output")
    p = sub.add_parser("pagerank", help="run solvers and print log rows")
    p.add_argument("-l", "--list", action="store_true")
    p.add_argument("-y", "--enable", action="append", default=[])
    p.add_argument("-n", "--disable", action="append", default=[])
    p.add_argument("-d", "--damping", type=float, default=0.85)
    p.add_argument("-p", "--epsilon", type=float, default=1e-6)
    p.add_argument("-s", "--steps", default=None)
    p.add_argument("-b", "--blocks", default="4")
    p.add_argument("-w", "--warm-up", type=int, default=1)
    p.add_argument("--repeat", type=int, default=5)
    p.add_argument("-g", "--generate", default=None)
    p.add_argument("-v", "--vertices", default="1K")
    p.add_argument("-e", "--edges", default="8K")
    p.add_argument("-r", "--seed", type=int, default=12345)
    p.add_argument("-f", "--format", default=None)
    p.add_argument("-i", "--input", default=None)
    return top


def run(argv: list[str], spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"vertexloom-{a.tool}").getOrCreate()
    load = lambda: edges.read_graph(spark, a.input, form=a.input_format)
    if a.tool == "graphdeg":
        deg = {"in": stats.in_degree, "out": stats.out_degree, "both": stats.degree}[SIDES[a.mode]](load())
        if a.histogram:
            deg = stats.histogram(deg).select(F.col("deg").alias("id"), F.col("n").alias("deg"))
        if a.summary:
            print(stats.summary(deg).first().asDict())
        if a.output:
            adjacency.write_vector(deg, a.output)
    elif a.tool == "graphgen":
        edges.write_graph(generate.generate(spark, a.algorithm, a.vertices, a.edges, a.mean_degree, a.seed), a.output, a.output_format)
    elif a.tool == "graphheat":
        heat = stats.heat_map(load(), a.bins)
        if a.output:
            adjacency.write_vector(heat, a.output, "value", ("bin_src", "bin_dst"))
    elif a.tool == "graphpart":
        g = load()
        if a.partition_file or a.method == "file":
            parts = partition.file_parts(g, adjacency.read_vector(spark, a.partition_file))
            a.no_index = True
        else:
            parts = partition.block_parts(g, a.parts) if a.method == "block" else partition.random_parts(g, a.parts, a.seed)
        made = partition_files.write_partition(g, parts, a.base, a.parts, not a.no_merge, not a.no_index, not a.no_subgraph, not a.no_crossgraph)
        print(partition.crossing_ratio(g, made["index"]).first().asDict())
    elif a.tool == "graphsan":
        m = a.matrix
        g = transform.sanitize(load(), a.no_loops or m, a.directed or m, a.undirected, a.unique or m, a.connected or m, a.transpose, a.sort, a.align, explain_counts=a.counts)
        if a.output:
            edges.write_graph(g, a.output, a.output_format)
    elif a.tool == "graphstride":
        g = transform.transpose(load()) if a.transpose else load()
        order = stats.edge_order(g)
        print({**stats.stats_row(g).first().asDict(), **stats.stride(g, order).first().asDict(), **stats.cache_hits(g, ordered=order).first().asDict()})
    elif a.tool == "strtoidx":
        out = tokens.strtoidx(numbered_lines(spark, a.input), a.first, a.skip_lines, a.skip, a.delimiters)
        if a.output:
            out.repartitionByRange("line").sortWithinPartitions("line").select("value").write.mode("overwrite").text(a.output)
    elif a.tool == "pagerank":
        return _bench(spark, a)
    return 0


def _bench(spark: SparkSession, a) -> int:
    import time

    reg = pr.Registry()
    if a.enable:
        reg.toggle("*", False)
    for p in a.enable:
        reg.toggle(p, True)
    for p in a.disable:
        reg.toggle(p, False)
    if a.list:
        print("\n".join(f"{'*' if reg.active[n] else ' '} {n}" for n in reg.names()))
        return 0
    if a.input:
        g = edges.read_graph(spark, a.input, form=a.format)
    else:
        g = generate.generate(spark, a.generate or "random", parse_bound(a.vertices, 1 << 18, 1 << 24), parse_bound(a.edges, 1, 256), seed=a.seed)
    opt = pr.Options(damping=a.damping, epsilon=a.epsilon, blocks=parse_bound(a.blocks, 1, 16))
    steps, m, first = None if a.steps is None else parse_bound(a.steps, 1, 250), g.edge_count(), None
    print("DATASET\tSOLVER\t|B|\t|V|\t|E|\tit\ttime_ms\tinit_ms\tbase_us\trank_us\tdiff_us\ttrans_ms")
    for name in reg.names(active_only=True):
        for k in range(a.warm_up + a.repeat):
            t = time.perf_counter()
            r = reg.solvers[name](g, opt, steps)
            ms = (time.perf_counter() - t) * 1e3
            if first is None:
                first = r.ranks
            ok = pr.check(r.ranks, first).first().ok
            if k >= a.warm_up:
                print(f"{a.input or a.generate or 'random'}\t{name}\t{opt.blocks}\t{g.n}\t{m}\t{r.iterations}\t{ms:.3f}\t{r.seconds['init'] * 1e3:.3f}\t0\t{r.seconds['rank'] * 1e6:.0f}\t0\t0{'' if ok else '  # differs'}")
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
