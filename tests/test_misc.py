import pytest
from goldens import H2, column, graph, pairs

from vertexloom import cli
from vertexloom.functions import scalars as S
from vertexloom.operators import analytics, generate, tokens
from vertexloom.plans.scratch import dense_ids, numbered_lines


def test_regular(spark):
    g = generate.regular(spark, 5, 2, 1)
    assert pairs(g.edges) == [(0, 0), (0, 1), (1, 1), (1, 2), (2, 2), (2, 3), (3, 3), (3, 4), (4, 0), (4, 4)]


@pytest.mark.parametrize("name", sorted(generate.ALGORITHMS))
def test_generators(spark, name):
    a, b = (generate.generate(spark, name, 64, 256, seed=5) for _ in range(2))
    assert pairs(a.edges) == pairs(b.edges)  # the seed decides
    assert all(0 <= x < a.n and 0 <= y < a.n for x, y in pairs(a.edges)) and a.edge_count() > 0


def test_random_hits_its_size(spark):
    m = generate.erdos_renyi(spark, 1000, 20000).edge_count()
    assert abs(m - 20000) < 800
    assert len([*generate.sweep()]) == 4 * 5 and len([*generate.suite()]) == 32


def test_strtoidx(spark):
    lines = spark.createDataFrame([(0, "# b a"), (1, "b  a\tb"), (2, ""), (3, " c a ")], "line long, value string")
    out = tokens.strtoidx(lines, first=5)
    assert column(out, "line", "value") == ["# b a", "5  6\t5", "", " 7 6 "]
    assert column(tokens.strtoidx(lines, skip_lines=2, skip_prefix=""), "line", "value") == ["# b a", "b  a\tb", "", " 0 1 "]


def test_sizes():
    assert [S.parse_size(x) for x in ("10", "2K", "1m", "0x10", "010", "3G")] == [10, 2048, 1 << 20, 16, 8, 3 << 30]
    assert S.parse_bound("max", 1, 9) == 9 and S.parse_bound("b", 1, 9) == 1 and S.parse_bound("4", 1, 9) == 4
    assert [S.parse_bool(x) for x in (None, "no", "1", "False")] == [False, False, True, False]
    with pytest.raises(ValueError):
        S.parse_size("x")
    assert S.file_extension("a/b.EL_GZ") == "el_gz" and S.file_extension("a.b/c") == ""


def test_log_reader(spark, tmp_path):
    head = "DATASET\tSOLVER\t|B|\t|V|\t|E|\tit\ttime_ms\tinit_ms\tbase_us\trank_us\tdiff_us\ttrans_ms\n"
    for n in "ab":
        (tmp_path / f"{n}.log").write_text(head + "# note\n" + f"{n}\tpr_bcsc_omp_stp\t1\t10\t20\t2\t4.0\t1\t1\t1\t1\t1\n")
    log = analytics.read_log(spark, [str(tmp_path / "a.log"), str(tmp_path / "b.log")])
    assert sorted(r.DATASET for r in log.collect()) == ["a", "b"]
    m = analytics.with_metrics(analytics.with_names(log, {"a": "A"})).orderBy("DATASET").first()
    assert (m.GRAPH, m.FLOW, m.KERNEL, m.DEVICE, m.EPS) == ("A", "pull", "OpenMP", "CPU", 20 / 1e6 / 2.0)


def test_percentile_bins(spark):
    got = analytics.percentile_bins(spark.range(100), "id", 4).groupBy("bin").count().orderBy("bin").collect()
    assert [r.bin for r in got] == [0, 1, 2, 3] and all(24 <= r["count"] <= 26 for r in got)


def test_dense_ids(spark):
    from pyspark.sql import functions as F

    df = spark.range(1000).select((F.col("id") * 37 % 1009).alias("v")).repartition(7)
    got = dense_ids(df, [F.col("v")], start=3).orderBy("v").collect()
    assert [r.id for r in got] == list(range(3, 1003))


def test_clear_scratch(spark, tmp_path):
    from vertexloom.plans import scratch

    kept = scratch.stored(spark.range(3), "x")
    assert kept.count() == 3
    scratch.clear_scratch(spark)
    with pytest.raises(Exception):  # noqa: B017
        scratch.stored(spark.range(3), "y").unionAll(kept).count()


def test_numbered_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(f"a{i}" for i in range(50)))
    (tmp_path / "b.txt").write_text("b0\nb1\n")
    got = [r.value for r in numbered_lines(spark, str(tmp_path)).orderBy("line").collect()]
    assert got == [f"a{i}" for i in range(50)] + ["b0", "b1"]


def test_cli(spark, tmp_path, capsys):
    src = str(tmp_path / "g.el")
    assert cli.run(["graphgen", "-a", "regular", "-v", "32", "-m", "2", "-o", src], spark) == 0
    assert cli.run(["graphsan", "-m", "-i", src, "-o", str(tmp_path / "c.el"), "-O", "el"], spark) == 0
    assert cli.run(["graphdeg", "-s", "-H", "-i", src, "-o", str(tmp_path / "d")], spark) == 0
    assert cli.run(["graphstride", "-i", src], spark) == 0
    assert cli.run(["graphpart", "2", str(tmp_path / "p"), "-i", src], spark) == 0
    assert cli.run(["graphheat", "-b", "4", "-i", src, "-o", str(tmp_path / "h")], spark) == 0
    assert cli.run(["pagerank", "-l", "-y", "*_omp_*"], spark) == 0
    assert cli.run(["pagerank", "-y", "pr_bcsc_omp_stp", "-s", "2", "-w", "0", "--repeat", "1", "-i", src], spark) == 0
    assert "pr_bcsc_omp_stp" in capsys.readouterr().out


def test_streaming(spark, tmp_path):
    from vertexloom.streaming import degrees as D

    spark.createDataFrame(H2, "src long, dst long").selectExpr("src", "dst", "timestamp'2024-01-01' as ts").write.parquet(str(tmp_path / "e"))
    q = D.degrees(D.read_edge_stream(spark, str(tmp_path / "e"))).writeStream.outputMode("complete").format("memory").queryName("deg").start()
    q.processAllAvailable()
    q.stop()
    assert [r.deg for r in spark.sql("select * from deg order by id").collect()] == [4, 2, 4, 1, 1]
    q = D.distinct_edges(D.read_edge_stream(spark, str(tmp_path / "e"))).writeStream.format("memory").queryName("dis").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("dis").count() == 6


def test_entry_contract(spark):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and "deg_hist" in q
    assert graph(spark, H2).n == 5 and e.entry(spark).count() > 0
