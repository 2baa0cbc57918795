import pytest
from goldens import H1, H2, graph, pairs
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from vertexloom.operators import transform as T

EDGES = st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=30)
FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def test_vertex_universe(spark):
    g = graph(spark, H1)
    assert g.n == 7 and g.edge_count() == 8 and g.vertices().count() == 7
    assert graph(spark, [(None, 1), (2, None), (0, 1)]).edge_count() == 1


def test_sanitize_gives_second_golden(spark):
    g = T.sanitize(graph(spark, H1), no_loops=True, unique=True, connected=True)
    assert pairs(g.edges) == sorted(H2) and g.n == 5


@FEW
@given(EDGES)
def test_properties(spark, edges):
    g = graph(spark, edges)
    assert pairs(T.transpose(T.transpose(g)).edges) == sorted(edges)
    twice = T.remove_duplicates(T.symmetrize(g))
    assert pairs(T.remove_duplicates(T.symmetrize(twice)).edges) == pairs(twice.edges) == sorted({*edges, *((b, a) for a, b in edges)})
    assert pairs(T.to_undirected(g).edges) == sorted(e for e in edges if e[0] <= e[1])
    assert pairs(T.to_undirected(g, "lower").edges) == sorted(e for e in edges if e[1] <= e[0])


def test_tags_add_up(spark):
    from vertexloom.graph import Graph

    e = spark.createDataFrame([(0, 1, 2), (0, 1, 3), (0, 1, None), (1, 0, 7)], "src long, dst long, etag long")
    got = {(r.src, r.dst): r.etag for r in T.remove_duplicates(Graph.from_edges(e)).edges.collect()}
    assert got == {(0, 1): 5, (1, 0): 7}


def test_align(spark):
    g = T.align_edges(graph(spark, H2), 4, 99)
    rows = pairs(g.edges)
    assert [sum(r[0] == v for r in rows) for v in range(5)] == [4, 4, 4, 4, 4] and rows.count((1, 4)) == 3


def test_insert_add_shift(spark):
    g = graph(spark, H2)
    assert pairs(T.insert_vertices(g, 2, 3).edges) == sorted((a + 3 * (a >= 2), b + 3 * (b >= 2)) for a, b in H2)
    assert T.insert_vertices(g, 2, 3).n == 8 and T.add_vertices(g, 2).n == 7
    assert pairs(T.rebase_vertices(T.shift_vertices(g, 5), 1).edges) == sorted((a + 1, b + 1) for a, b in H2)
    more = T.add_edges(g, [(7, 7)], 2)
    assert more.n == 8 and pairs(more.edges).count((7, 7)) == 2


def test_sort_by_degree(spark):
    g = T.sort_by_degree(graph(spark, H2))
    assert [sum(r[0] == v for r in pairs(g.edges)) for v in range(5)] == [2, 1, 1, 1, 1]


def test_row_index_and_adjacency(spark):
    g = graph(spark, H1)
    assert [r.first for r in T.row_index(g).orderBy("id").collect()] == [0, 3, 4, 5, 7, 7, 7, 8]
    assert [r.neighbours for r in T.adjacency(g).orderBy("id").collect()] == [[1, 1, 2], [2], [0], [2, 3], [], [], [0]]


def test_points_and_flags(spark):
    g = T.set_edge_tag(graph(spark, H2), 1, 2, 9)
    assert T.edge_tag(g, 1, 2).first()[0] == 9 and T.edge_tag(g, 0, 1).first()[0] == 0
    g = T.set_vertex_tag(g, 3, 4)
    assert [r.vtag for r in g.vertices().orderBy("id").collect()] == [0, 0, 0, 4, 0] and g.flags() == 12
    assert not T.toggle(g, "TAG_E", False).has_etag
    assert T.toggle(g, "DEG_O", True).vertices().where("id = 0").first().deg_out == 2
    assert g.equals(g.copy()) and not g.equals(T.transpose(g)) and not g.equals(g.copy(etag=False))
    assert T.clear(g).edge_count() == 0


def test_empty(spark):
    g = T.clear(graph(spark, H2))
    assert T.remove_unconnected(g).n == 0 and pairs(T.symmetrize(g).edges) == []


def test_views(spark):
    graph(spark, H2).create_views("h2")
    assert spark.sql("select count(*) c from h2_edges join h2_vertices on id = src").first().c == 6


def test_unknown_step(spark):
    with pytest.raises(ValueError):
        T.sanitize(graph(spark, H2), directed=True, transposed=True)
