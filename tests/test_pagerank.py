import pytest
from goldens import H1, H2, column, graph

from vertexloom.plans import pagerank as P

TWO = {
    "H1": (H1, [0.319692663, 0.204480078, 0.285938411, 0.084713921, 0.035058309, 0.035058309, 0.035058309], 0.1906304665),
    "H2": (H2, [0.44225, 0.18725, 0.3105, 0.03, 0.03], 0.289),
}
END = {
    "H1": (H1, 34, [0.327788709, 0.214049011, 0.324035947, 0.049220673, 0.028301887, 0.028301887, 0.028301887]),
    "H2": (H2, 28, [0.374901187, 0.189332840, 0.375765973, 0.03, 0.03]),
}


@pytest.mark.parametrize("plan", ["stp", "def", "rdx", "part"])
@pytest.mark.parametrize("name", TWO)
def test_two_steps(spark, name, plan):
    edges, want, diff = TWO[name]
    r = P.pagerank(graph(spark, edges), plan, P.Options(parts=2, blocks=2), steps=2)
    assert [round(x, 9) for x in column(r.ranks, "id", "rank")] == want
    assert abs(r.diff - diff) < 1e-9 and r.iterations == 2


def test_converges(spark):
    edges, it, want = END["H2"]
    r = P.pagerank(graph(spark, edges))
    assert r.iterations == it and [round(x, 9) for x in column(r.ranks, "id", "rank")] == want


def test_registry():
    reg = P.Registry()
    assert len(reg.names()) == 58 and reg.count() == 58
    reg.toggle("*", False)
    assert reg.toggle("*_omp_*") == 2 + 8 and reg.count() == 10
    assert all("omp" in n for n in reg.names()[:10])
    assert reg.toggle("!*_omp_*", True) == 48


def test_check_and_spmv(spark):
    g = graph(spark, H2)
    a = P.pagerank(g, steps=2).ranks
    assert P.check(a, a).first().ok
    assert not P.check(a.withColumn("rank", a["rank"] * 2), a).first().ok
    k = P.kernels(g)
    assert k["asum"].first()[0] == pytest.approx(1.0) and k["weights"].count() == 6
    assert sum(r.w for r in k["weights"].collect()) == pytest.approx(5)


def test_empty(spark):
    g = graph(spark, H2)
    assert P.pagerank(g.with_edges(g.edges.limit(0), 0)).ranks.count() == 0
    r = P.pagerank(g.with_edges(g.edges.limit(0), 4), steps=2)
    assert column(r.ranks, "id", "rank") == [0.25] * 4
