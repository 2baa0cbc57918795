from goldens import H2, column, graph, pairs

from vertexloom.operators import partition as P
from vertexloom.sources import partition_files as PF


def _parts(spark):
    g = graph(spark, H2)
    ix = P.part_index(P.block_parts(g, 2))
    return g, ix, P.ghosts(g, ix)


def test_golden(spark):
    g, ix, m = _parts(spark)
    assert column(ix, "id", "part") == [0, 0, 0, 1, 1] and column(ix, "id", "local_id") == [0, 1, 2, 0, 1]
    assert sorted((r.id, r.part, r.ghost_local) for r in m.collect()) == [(0, 1, 2), (2, 1, 3)]
    sub = P.subgraph_edges(g, ix, m)
    assert pairs(sub.where("part = 0")) == [(0, 1), (0, 2), (1, 2), (2, 0)] and pairs(sub.where("part = 1")) == [(0, 3), (1, 2)]
    assert column(P.index_lines(ix, m), "id", "line") == ["0 0 1 2", "0 1", "0 2 1 3", "1 0", "1 1"]
    assert sorted(tuple(r) for r in P.cross_graph(m).collect()) == [(0, 2, 1), (2, 3, 1)]
    assert P.own_cross_graph(m, 0).count() == 2 and P.own_cross_graph(m, 5).count() == 0
    assert P.crossing_ratio(g, ix).first().crossing == 2


def test_files(spark, tmp_path):
    g, _, _ = _parts(spark)
    base = str(tmp_path / "g")
    made = PF.write_partition(g, P.block_parts(g, 2), base, 2)
    back = PF.read_index(spark, PF.index_name(base, 2)).orderBy("id").collect()
    assert [(r.part, r.local_id, [tuple(x) for x in r.ghosts]) for r in back] == [(0, 0, [(1, 2)]), (0, 1, []), (0, 2, [(1, 3)]), (1, 0, []), (1, 1, [])]
    assert PF.read_cross(spark, PF.cross_name(base, 2), 1).count() == 2
    assert pairs(PF.read_part(spark, base, 2, 1)) == [(0, 3), (1, 2)]
    assert PF.vertex_count(spark, PF.index_name(base, 2)) == 5
    everything = P.subgraph_edges(g, made["index"], made["ghosts"])
    assert pairs(PF.reassembled(everything, made["index"], made["ghosts"])) == sorted(H2)


def test_block_cyclic(spark):
    ids = spark.createDataFrame([(v,) for v in (0, 31, 32, 63, 64, 100)], "v long")
    got = [tuple(r) for r in ids.select(P.block_of("v", 2), P.index_in_block("v", 2)).collect()]
    assert got == [(0, 0), (0, 31), (1, 0), (1, 31), (0, 32), (1, 36)]


def test_random_is_stable(spark):
    g = graph(spark, H2, 1000)
    a, b = (column(P.random_parts(g, 4, 9), "id", "part") for _ in range(2))
    assert a == b and {*a} == {0, 1, 2, 3}


def test_part_index_segments(spark):
    g = graph(spark, H2, 500)
    parts = spark.range(500).selectExpr("id", "cast(id * 7 % 3 as int) as part")
    got = {r.id: r.local_id for r in P.part_index(parts, segments=7).collect()}
    seen = [0, 0, 0]
    for v in range(500):
        assert got[v] == seen[v * 7 % 3]
        seen[v * 7 % 3] += 1
