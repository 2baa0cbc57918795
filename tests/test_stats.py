import math

from goldens import H1, H2, column, graph

from vertexloom.operators import stats as S


def test_degrees(spark):
    g = graph(spark, H1)
    assert column(S.out_degree(g), "id", "deg") == [3, 1, 1, 2, 0, 0, 1]
    assert column(S.in_degree(g), "id", "deg") == [2, 2, 3, 1, 0, 0, 0]
    assert column(S.degree(g), "id", "deg") == [5, 3, 4, 3, 0, 0, 1]
    assert column(S.histogram(S.degree(g)), "deg", "n") == [2, 1, 0, 2, 1, 1]
    assert column(S.histogram(S.degree(g), size=3), "deg", "n") == [2, 1, 0]


def test_summary(spark):
    for edges, avg, std, skew, ps in ((H1, 2.286, 1.829, -1.171, [0, 0, 0, 0, 3, 4, 5, 5, 5]), (H2, 2.4, 1.356, 0.885, [1, 1, 1, 1, 2, 4, 4, 4, 4])):
        r = S.summary(S.degree(graph(spark, edges))).first()
        assert [round(x, 3) for x in (r.avg, r.stddev, r.skewness)] == [avg, std, skew]
        assert [r[f"p{q}"] for q in S.QUANTILES] == ps


def test_clustering_and_neighbours(spark):
    for edges, closed, triples, a, b in ((H1, 2, 8, 2.5714285714, 2.2857142857), (H2, 1, 2, 2.8, 1.6)):
        g = graph(spark, edges)
        r = S.clustering(g, salts=3).first()
        assert (r.closed, r.triples, r.value) == (closed, triples, closed / triples)
        assert math.isclose(S.avg_neighbour_degree(g, "in").first()[0], a, rel_tol=1e-9)
        assert math.isclose(S.avg_neighbour_degree(g, "out").first()[0], b, rel_tol=1e-9)


def test_assortativity(spark):
    for edges, sums, value in ((H1, (10, 8, 10, 14, 16), 0.0), (H2, (2, 2, 8, 2, 14), -0.3152441625)):
        r = S.assortativity(graph(spark, edges)).first()
        assert (r.s_oi, r.s_o, r.s_i, r.s_oo, r.s_ii) == sums and abs(r.value - value) < 1e-9


def test_heat_map(spark):
    r = [x.value for x in S.heat_map(graph(spark, H1), 2).orderBy("bin_src", "bin_dst").collect()]
    assert [round(x, 9) for x in r] == [2.0, 0.0, 0.285714286, 0.0]


def test_stride_and_cache(spark):
    for edges, packing, cache in ((H1, 6, (3, 4, 1)), (H2, 4, (3, 2, 1))):
        g = graph(spark, edges)
        for segment in (1 << 20, 3):
            r = S.stride(g, segment=segment).first()
            assert r.packing == packing and r["global"] == 1 and r.diagonal == 1
        c = S.cache_hits(g).first()
        assert (c.time, c.local, c.miss) == cache


def test_empty(spark):
    g = graph(spark, H2).with_edges(graph(spark, H2).edges.limit(0), 0)
    assert S.clustering(g).first().value is None and S.stride(g).first().packing is None
    assert S.histogram(S.degree(g)).count() == 0 and S.summary(S.degree(g)).first().avg is None
    assert S.assortativity(g).first().value == 0.0
