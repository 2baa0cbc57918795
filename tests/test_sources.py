import pytest
from goldens import H1, H2, column, graph, pairs

from vertexloom.operators import stats
from vertexloom.operators.transform import set_edge_tag
from vertexloom.sources import adjacency as A
from vertexloom.sources import edges as E


def test_text(spark, tmp_path):
    p = tmp_path / "a.el"
    p.write_text("# c\n% d\n0 1\n\n 2\t3 7\n")
    e = E.read_text(spark, str(p), tags=True).orderBy("src").collect()
    assert [tuple(r) for r in e] == [(0, 1, 0), (2, 3, 7)]
    (tmp_path / "u.uel").write_text("0 1\n1 1")
    assert pairs(E.read_graph(spark, str(tmp_path / "u.uel")).edges) == [(0, 1), (1, 0), (1, 1), (1, 1)]
    (tmp_path / "b.el").write_text("0 x\n1 2\n")
    with pytest.raises(Exception, match="not an edge"):
        E.read_text(spark, str(tmp_path / "b.el")).collect()
    assert E.read_text(spark, str(tmp_path / "b.el"), strict=False).count() == 1


@pytest.mark.parametrize("form", ["el", "del", "el_gz", "del_gz", "csr", "csc", "parquet"])
def test_round_trip(spark, tmp_path, form):
    g = graph(spark, H1)
    path = str(tmp_path / f"x.{form}")
    E.write_graph(g, path)
    back = E.read_graph(spark, path)
    assert pairs(back.edges) == sorted({*H1} if form.startswith("del") else H1) and back.n == 7


def test_tags_survive(spark, tmp_path):
    g = set_edge_tag(graph(spark, H2), 1, 2, 77)
    for form in ("el", "el_gz", "csr"):
        E.write_graph(g, str(tmp_path / f"t.{form}"))
        back = E.read_graph(spark, str(tmp_path / f"t.{form}"), tags=True)
        assert {(r.src, r.dst): r.etag for r in back.edges.collect()}[1, 2] == 77, form


def test_adjacency_weights(spark, tmp_path):
    p = tmp_path / "w.dimacs"
    p.write_text("% c\n3 2 111 2\n9 5 6 2 40\n9 7 8 1 40 3 50\n\n")
    g = E.read_graph(spark, str(p))
    assert g.n == 3 and sorted(tuple(r) for r in g.edges.collect()) == [(0, 1, 40), (1, 0, 40), (1, 2, 50)]
    assert column(g.vertices(), "id", "vtag") == [5, 7, 0]


def test_dimacs_is_clean(spark, tmp_path):
    lines = [r.line for r in A.adjacency_lines(A.cleaned(graph(spark, H1), "dimacs")).orderBy("row").collect()]
    assert lines == ["5 5", "2 3 5", "1 3", "1 2 4", "3", "1"]


def test_matrix_market(spark, tmp_path):
    p = tmp_path / "m.mtx"
    p.write_text("%%MatrixMarket matrix coordinate real symmetric\n% c\n3 3 2\n1 2 .5\n3 3 1\n")
    g = E.read_graph(spark, str(p))
    assert pairs(g.edges) == [(1, 2), (2, 1), (3, 3), (3, 3)]


def test_vectors(spark, tmp_path):
    A.write_vector(stats.degree(graph(spark, H1)), str(tmp_path / "d"))
    assert column(A.read_vector(spark, str(tmp_path / "d"), "deg"), "id", "deg") == [5, 3, 4, 3, 0, 0, 1]
    A.write_vector(stats.heat_map(graph(spark, H1), 2), str(tmp_path / "h"), "value", ("bin_src", "bin_dst"))
    assert [round(r.value, 6) for r in A.read_matrix(spark, str(tmp_path / "h")).orderBy("bin_src", "bin_dst").collect()] == [2.0, 0.0, 0.285714, 0.0]


def test_codec():
    s, d, t = [5, 5, 9], [1, 0, 3], [7, 8, 9]
    flags, a, b, c = E.decode_edges(E.encode_edges(s, d, t))
    assert flags == 8 and (a.tolist(), b.tolist(), c.tolist()) == (s, d, t)
    assert E.decode_edges(E.encode_edges([], []))[1].tolist() == []


def test_pairs(spark):
    assert E.from_pairs(spark, [(0, 3)]).n == 4
