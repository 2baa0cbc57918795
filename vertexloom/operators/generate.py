"""Graph generators.

Deterministic ones are arithmetic over ``range``; random ones draw from hashes of a seed and the
edge's or vertex's own number, so that the same seed gives the same graph on any cluster."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph

#: published quadrant probabilities of the Graph500 generator
RMAT = (0.57, 0.19, 0.19, 0.05)


def _uniform(*key, seed: int) -> Column:
    """A number in (0, 1) from a hash of ``key``."""
    return (F.shiftrightunsigned(F.xxhash64(*key, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)


def erdos_renyi(spark: SparkSession, n: int, m: int, seed: int = 12345, piece: int = 1 << 17) -> Graph:
    """About m edges: each ordered pair (but (0, 0)) with probability m / n^2, by geometric skips.

    Bands of rows that expect about ``piece`` edges are tasks of their own; each walks its cells with
    its own chain of skips, seeded by the band's number, and emits edges piece by piece."""
    p = min(1.0, m / (n * n)) if n else 0.0
    if p <= 0:
        return Graph(spark.range(0).select(F.col("id").alias("src"), F.col("id").alias("dst")), n)
    rows = max(1, min(n, int(piece * n / m)))

    def run(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            for band in b["id"].tolist():
                g = np.random.default_rng([seed, band])
                first, end = band * rows * n, min(n, (band + 1) * rows) * n
                at = first - 1
                while at < end:
                    cells = at + np.cumsum(g.geometric(p, piece))
                    at = int(cells[-1])
                    cells = cells[(cells < end) & (cells > 0)]
                    yield pd.DataFrame({"src": cells // n, "dst": cells % n})

    bands = -(-n // rows)
    return Graph(spark.range(0, bands, 1, min(bands, 1 << 14)).mapInPandas(run, "src long, dst long"), n)


def blocked_random(spark: SparkSession, blocks: int, n: int, m: int, seed: int = 12345) -> Graph:
    """Erdős–Rényi per block of a blocks x blocks grid; sizes rounded up to whole blocks."""
    size, each = -(-n // blocks), -(-m // (blocks * blocks))
    parts = None
    for b in range(blocks * blocks):
        r, c = divmod(b, blocks)
        e = erdos_renyi(spark, size, each, seed + b).edges.select((F.col("src") + r * size).alias("src"), (F.col("dst") + c * size).alias("dst"))
        parts = e if parts is None else parts.unionAll(e)
    return Graph(parts, size * blocks)


def regular(spark: SparkSession, n: int, deg: int, stride: int = 1) -> Graph:
    """v to ((v + d) * stride) mod n for d < deg."""
    e = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(deg - 1))).alias("d")) if deg > 0 else spark.range(0).select(F.col("id").alias("src"), F.lit(0).alias("d"))
    return Graph(e.select("src", F.expr(f"((src + d) * {stride}) % {max(n, 1)}").alias("dst")), n)


def rmat(spark: SparkSession, n: int, m: int, seed: int = 2, probabilities=RMAT) -> Graph:
    """m edges over 2^round(log2 n) vertices: one quadrant per bit and edge."""
    scale = max(0, round(math.log2(max(1, n))))
    a, b, c, _ = probabilities
    e = spark.range(m)
    src, dst = F.lit(0).cast("long"), F.lit(0).cast("long")
    for k in range(scale):
        u = _uniform("id", F.lit(k), seed=seed)
        src = src * 2 + F.when(u >= a + b, 1).otherwise(0)
        dst = dst * 2 + F.when((u >= a) & (u < a + b) | (u >= a + b + c), 1).otherwise(0)
        if k % 8 == 7:  # keep expressions short
            e = e.select("id", src.alias("s"), dst.alias("t"))
            src, dst = F.col("s"), F.col("t")
    return Graph(e.select(src.cast("long").alias("src"), dst.cast("long").alias("dst")), 1 << scale)


def geometric(spark: SparkSession, n: int, m: int, seed: int = 12345) -> Graph:
    """Points on the unit torus joined within radius sqrt(2m / (n^2 pi)); src < dst.

    Points meet only those of their own and neighbouring cells of a grid as wide as the radius."""
    r = min(0.5, math.sqrt(2 * m / (n * n * math.pi))) if n else 0.0
    k = max(1, min(1 << 15, int(1 / r))) if r > 0 else 1
    pts = spark.range(n).select("id", _uniform("id", F.lit("x"), seed=seed).alias("x"), _uniform("id", F.lit("y"), seed=seed).alias("y"))
    cell = lambda c: F.floor(F.col(c) * k).cast("int")
    a = pts.select("id", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    near = sorted({(i % k, j % k) for i in (-1, 0, 1) for j in (-1, 0, 1)})
    shifts = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in near))
    b = a.select("id", "x", "y", "cx", "cy", F.explode(shifts).alias("d")).select(F.col("id").alias("o"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.pmod(F.col("cx") + F.col("d.i"), F.lit(k)).alias("cx"), F.pmod(F.col("cy") + F.col("d.j"), F.lit(k)).alias("cy"))
    wrap = lambda p, q: F.least(F.abs(F.col(p) - F.col(q)), 1 - F.abs(F.col(p) - F.col(q)))
    e = a.join(b, ["cx", "cy"]).where((F.col("id") < F.col("o")) & (wrap("x", "ox") * wrap("x", "ox") + wrap("y", "oy") * wrap("y", "oy") <= r * r))
    return Graph(e.select(F.col("id").alias("src"), F.col("o").alias("dst")), n)


def static_powerlaw(spark: SparkSession, n: int, m: int, exponent: float = 2.5, seed: int = 12345) -> Graph:
    """m edges whose ends are drawn with weights (i + 1)^(-1 / (exponent - 1)); no loops.

    The inverse of the weights' integral is closed, so no table of weights is needed; parallel
    edges stay only if n exceeds m allows none otherwise (they are removed)."""
    a = 1 - 1 / (exponent - 1)
    draw = lambda name: F.least(F.lit(n - 1).cast("long"), F.floor(F.pow(_uniform("id", F.lit(name), seed=seed) * float((n + 1) ** a - 1) + 1, F.lit(1 / a)) - 1).cast("long"))
    e = spark.range(m).select(draw("s").alias("src"), F.pmod(draw("t") + F.lit(0), F.lit(n)).alias("dst")).where("src <> dst")
    return Graph(e if n > m else e.distinct(), n)


def barabasi(spark: SparkSession, n: int, m: int, power: float = 2.5, seed: int = 12345) -> Graph:
    """Preferential attachment, each new vertex with m / n edges to earlier ones.

    Each step depends on all before it, so this runs on the driver: bounded by its memory (about
    16 bytes a vertex and edge)."""
    import numpy as np
    import pandas as pd

    g, k = np.random.default_rng(seed), max(1, m // max(1, n))
    deg = np.zeros(n)
    src, dst = [], []
    for v in range(1, n):
        w = deg[:v] ** power + 1
        t = g.choice(v, size=k, p=w / w.sum()) if n > m else g.choice(v, size=min(k, v), replace=False, p=w / w.sum())
        src.extend([v] * len(t)), dst.extend(t.tolist())
        np.add.at(deg, t, 1)
        deg[v] += len(t)
    return Graph(spark.createDataFrame(pd.DataFrame({"src": np.array(src, "int64"), "dst": np.array(dst, "int64")}), "src long, dst long"), n)


def forest_fire(spark: SparkSession, n: int, m: int, forward: float = 0.1, backward: float = 0.15, seed: int = 12345) -> Graph:
    """Forest fire with m / n ambassadors; sequential, on the driver, bounded by its memory."""
    import numpy as np
    import pandas as pd

    g, k = np.random.default_rng(seed), max(1, m // max(1, n))
    out, into = [set() for _ in range(n)], [set() for _ in range(n)]
    for v in range(1, n):
        burnt, fire = set(), list(dict.fromkeys(g.integers(0, v, k).tolist()))
        while fire:
            x = fire.pop()
            if x in burnt:
                continue
            burnt.add(x)
            for pool, p in ((sorted(out[x] - burnt), forward), (sorted(into[x] - burnt), forward * backward)):
                c = min(len(pool), int(g.geometric(1 - p)) - 1)
                if c:
                    fire.extend(g.choice(pool, c, replace=False).tolist())
        for x in burnt:
            out[v].add(x), into[x].add(v)
    e = [(v, x) for v in range(n) for x in sorted(out[v])]
    return Graph(spark.createDataFrame(pd.DataFrame(e, columns=["src", "dst"]).astype("int64"), "src long, dst long"), n)


def lattice(spark: SparkSession, n: int, m: int) -> Graph:
    """Circular lattice of ceil(m / 2 / n) dimensions and side ceil(n^(1/dims)).

    With round(m / n) > 1 edges are mutual, for which half the edges are counted."""
    mutual = round(m / max(1, n)) > 1
    per = (m / 2 if mutual else m) / 2
    dims = max(1, math.ceil(per / max(1, n)))
    side = max(1, round(n ** (1 / dims)))
    side += side**dims < n
    total = side**dims
    d = F.explode(F.sequence(F.lit(0), F.lit(dims - 1))).alias("d")
    e = spark.range(total).select("id", d).withColumn("step", F.expr("cast(" + " ".join(["case d", *(f"when {i} then {side**i}" for i in range(dims)), "end"]) + " as bigint)"))
    e = e.select(F.col("id").alias("src"), F.expr(f"id - ((id div step) % {side}) * step + (((id div step) + 1) % {side}) * step").alias("dst"))
    g = Graph(e, total)
    if mutual:
        from .transform import symmetrize

        g = symmetrize(g)
    return g


def star(spark: SparkSession, n: int, m: int = 0) -> Graph:
    """All vertices to vertex 0, and back with round(m / n) > 1."""
    e = spark.range(1, n).select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"))
    if round(m / max(1, n)) > 1:
        e = e.unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return Graph(e, n)


def tree(spark: SparkSession, n: int, m: int) -> Graph:
    """ceil(m / n)-ary tree, children to parents."""
    k = max(1, math.ceil(m / max(1, n)))
    return Graph(spark.range(1, n).select(F.col("id").alias("src"), F.expr(f"(id - 1) div {k}").alias("dst")), n)


def full(spark: SparkSession, n: int, m: int = 0) -> Graph:
    """Complete digraph without loops on isqrt(max(m, n)) vertices."""
    k = math.isqrt(max(m, n))
    e = spark.range(k * k).select(F.expr(f"id div {max(k, 1)}").alias("src"), F.expr(f"id % {max(k, 1)}").alias("dst")).where("src <> dst")
    return Graph(e, k)


ALGORITHMS = {
    "random": erdos_renyi, "regular": lambda s, n, m, seed=0: regular(s, n, m // max(1, n)), "kronecker": rmat, "grg": geometric, "barabasi": barabasi, "forest": forest_fire,
    "powerlaw": static_powerlaw, "lattice": lambda s, n, m, seed=0: lattice(s, n, m), "star": lambda s, n, m, seed=0: star(s, n, m), "tree": lambda s, n, m, seed=0: tree(s, n, m), "full": lambda s, n, m, seed=0: full(s, n, m),
}
# Accepted names of the generators.
ALIASES = {
    "rnd": "random", "erdos_renyi": "random", "erdosrenyi": "random", "er": "random", "r": "random", "grg_random": "grg", "grgrandom": "grg", "g": "grg", "brb": "barabasi", "b": "barabasi",
    "forest_fire": "forest", "ff": "forest", "pl": "powerlaw", "p": "powerlaw", "k": "kronecker", "graph500": "kronecker", "reg": "regular", "l": "lattice", "s": "star", "t": "tree", "f": "full",
}


def generate(spark: SparkSession, algorithm: str, n: int, m: int = 0, mean_degree: int = 0, seed: int = 12345) -> Graph:
    """Any generator by name; ``mean_degree`` adds n times as many edges to ``m``."""
    name = ALIASES.get(algorithm.lower(), algorithm.lower())
    return ALGORITHMS[name](spark, n, m + n * mean_degree, seed=seed)


def sweep(v_from: int = 1 << 18, v_to: int = 1 << 24, v_step: int = 4, d_from: int = 1, d_to: int = 256, d_step: int = 4):
    """(n, m) of the benchmark's sweep over Erdős–Rényi graphs."""
    v = v_from
    while v <= v_to:
        d = d_from
        while d <= d_to:
            yield v, v * d
            d *= d_step
        v *= v_step


def suite(n: int = 1 << 20, seed: int = 12345):
    """(name, algorithm, n, m, seed) of the synthetic suite; clean with loops, duplicates and
    unconnected vertices removed."""
    for name in ("random", "regular", "powerlaw", "kronecker"):
        for k in range(8):
            yield f"{name}_{n}_{1 << k}", name, n, n << k, seed
