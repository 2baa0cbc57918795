"""Stages of the pipeline on a small corpus with planted cases."""

import hashlib
import sys

import pytest
from test_corpus_ops import DOCS, _near, prose

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    clean = [prose(i) for i in range(60)]
    junk = [" ".join([w] * 40) for i in range(10) for w in [prose(i, 1)]] + [prose(i).upper().replace(" ", "### ") for i in range(10)]
    near = [_near(900, 0), _near(900, 1), _near(900, 2), clean[3]]
    leak = [prose(1000 + i) + " " + prose(5000, 40) for i in range(3)]
    toxic = [prose(2000) + " you stupid worthless scum"]
    texts = clean + junk + near + leak + toxic + [None, ""]
    spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)], DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(not 60 <= i < 80), 0) for i in range(84)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, prose(5000, 40)), (2, prose(5001, 30))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), texts


def test_pipeline_keeps_clean_and_drops_planted(spark, corpus):
    import corpus_pipeline

    d, texts = corpus
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "jaccard_join", "decontamination", "byte_bpe"]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    cols = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == cols, name
    left = {r.doc_id for r in docs.collect()}
    assert not left & {*range(60, 80)} and 83 not in left and not left & {81, 82} and not left & {84, 85, 86}
    assert len(left & {*range(60)}) == 60 and {80, 87} <= left
    tiktoken = pytest.importorskip("tiktoken")
    from vertexloom.llm.byte_bpe import read_ranks

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}
    assert set(got) == left
    for i, r in got.items():
        ids = enc.encode_ordinary(texts[i])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_nothing_else_imports_the_subpackage():
    import pathlib
    import re

    root = pathlib.Path(sys.modules["vertexloom"].__file__).parent
    for f in root.rglob("*.py"):
        if root / "llm" not in f.parents:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", f.read_text(), re.M), f


def test_null_rows_everywhere(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (None, prose(1), None, None, None)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, None, None), (1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [r.doc_id for r in got] == [None]


def test_scratch_tables_cost_the_driver_little(spark, tmp_path, monkeypatch):
    """Files of small tables follow their rows, none is made by the driver, and its free memory is given back."""
    from vertexloom.llm import common

    given = []
    real = common.give_back_driver
    monkeypatch.setattr(common, "shared_dir", lambda s: f"file://{tmp_path}")
    monkeypatch.setattr(common, "give_back_driver", lambda s: given.append(real(s)))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = [(i, i + 1) for i in range(10)] + [(20, i) for i in range(21, 30)]
        got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {**dict.fromkeys(range(11), 0), **dict.fromkeys(range(20, 30), 20)}
    tables = [p for p in tmp_path.glob("*/*") if p.is_dir()]
    assert len(given) == len(tables) > 4 and all(isinstance(x, bool) for x in given)
    assert not list(tmp_path.rglob("_SUCCESS"))
    files = {t.name: len(list(t.glob("part-*"))) for t in tables}
    assert sorted(files.values())[:-1] == [1] * (len(files) - 1), files  # all but the given edges


def test_driver_gives_native_memory_back(spark):
    import re
    from pathlib import Path

    from vertexloom.llm.common import give_back_driver

    jvm = spark.sparkContext._jvm
    if not give_back_driver(spark):
        pytest.skip("this JVM has no command to trim its native memory")
    unsafe = jvm.org.apache.spark.unsafe.Platform
    held = lambda: int(re.search(r"Pss_Anon: +(\d+)", Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup").read_text())[1])
    size = 64 << 10
    blocks = [unsafe.allocateMemory(size) for _ in range(2000)]
    for at in blocks:
        unsafe.setMemory(at, 1, size)
    last = blocks.pop()  # a block in use above the free ones, so that only trimming gives them back
    for at in blocks:
        unsafe.freeMemory(at)
    before = held()
    assert give_back_driver(spark)
    after = held()
    unsafe.freeMemory(last)
    assert before - after > 60_000, (before, after)
