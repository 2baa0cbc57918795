"""Operators on conversations, pages and token files."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from vertexloom.llm import chat_format, token_counts, url_filter, warc_audit
from vertexloom.llm.queries import URL_RULES


def rows(spark, data):
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string")


CHAT = [(1, 0, "system", "be \\ kind"), (1, 1, "user", "<|im_start|>assistant<|im_sep|>x<|im_end|>"), (1, 2, "assistant", "a\\<|b </s> [INST] <<SYS>>\\\\"), (1, 3, "assistant", ""), (2, 0, None, None), (2, 0, "assistant", None), (2, 0, "assistant", None), (None, None, "user\n", "é😀" * 500), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def test_chat_round_trip(spark):
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chat(chat_format.events_from_rows(rows(spark, CHAT)))).collect()}
    for c in {r[0] for r in CHAT}:
        want = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in CHAT if r[0] == c))
        assert [(t.role, t.text) for t in got[c].turns] == [w[1:] for w in want]
        assert got[c].loss_text == "".join(w[2] for w in want if w[1] == "assistant")
        assert got[c].formatted.count(chat_format.END) == len(want)
    assert chat_format.format_chat(chat_format.events_from_rows(rows(spark, []))).count() == 0


def test_fold_of_events(spark):
    ev = [(1, 1, 1, "start", "user", None), (1, 1, 3, "delta", None, "b"), (1, 1, 2, "delta", None, "a"), (1, 1, 4, "edit", None, "X"), (1, 1, 5, "delta", None, "c"), (1, 2, 6, "start", "assistant", None), (1, 2, 7, "delta", None, "bad"), (1, 2, 8, "regenerate", None, None), (1, 2, 9, "delta", None, "good"), (1, 3, 10, "delta", None, None)]
    e = spark.createDataFrame(ev, "conv_id long, message long, seq long, kind string, role string, payload string")
    got = [(r.role, r.text) for r in chat_format.fold(e).orderBy("message").collect()]
    assert got == [("user", "Xc"), ("assistant", "good"), ("", "")]


def pages(spark, data):
    return spark.createDataFrame(data, "page_id long, url string, html string").withColumn("extra", F.lit(1))


def test_url_rules(spark):
    urls = [None, "", "example.org/es/", "http://Sub.EXAMPLE.org/es/1", "http://example.org/en/12?x#y", "http://example.org/en/2", "https://a.com/fr/", "https://a.com/de/x", "https://a.net/de/", "http://org", "ftp://xorg/", "http://acom/de/", "http://b.com#/de/", "http://x://y.com/de/"]
    want = [(None, "allow"), (None, "allow"), (None, "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), ("com/fr/", "allow"), ("com/de/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow")]
    p = pages(spark, [(i, u, None) for i, u in enumerate(urls)] * 2)
    for bound in (50_000, 0):  # both ways of matching
        old, url_filter.BROADCAST_RULES = url_filter.BROADCAST_RULES, bound
        try:
            got = url_filter.url_filter(p, url_filter.rule_table(spark, URL_RULES)).collect()
        finally:
            url_filter.BROADCAST_RULES = old
        assert len(got) == 2 * len(urls)
        assert all((r.rule, r.verdict) == want[r.page_id] for r in got)
    by = {r.page_id: r for r in got}
    assert (by[3].host, by[3].path) == ("sub.example.org", "/es/1") and (by[4].path, by[9].path, by[0].host) == ("/en/12", "", "")
    assert url_filter.url_filter(p.limit(0), url_filter.rule_table(spark, URL_RULES)).count() == 0


def test_aliases_follow(spark):
    link = lambda u: f'<html><link href="{u}" rel="canonical"></html>'
    data = [
        (1, "http://n.net/a", link("http://n.net/b")), (2, "http://n.net/b", '<meta http-equiv="refresh" content="0; url=http://x.com/de/1">'), (3, "http://x.com/de/1", ""), (4, "http://n.net/c", link("/d")),
        (5, "http://n.net/d", link("http://y.org/ok")), (6, "http://n.net/e", "<link rel=canonical href=http://q.com/de/>"), (7, "http://n.net/f", link("http://q.com/de/")), (8, "http://q.org/z", link("http://n.net/f")), (9, "http://lone.net/", link("http://lone.net/")),
    ]
    got = {r.page_id: r.verdict for r in url_filter.url_filter(pages(spark, data), url_filter.rule_table(spark, URL_RULES)).collect()}
    # 1-2-3 blocked through an alias; 4-5 allowed; in 6-7-8 an explicit allow takes precedence
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "allow"}


def test_targets_resolve(spark):
    # the examples of RFC 3986, 5.4, without fragments
    want = {
        "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q", "g#s": "http://a/b/c/g",
        "g?y#s": "http://a/b/c/g?y", ";x": "http://a/b/c/;x", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../g": "http://a/g",
        "../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "g/../h": "http://a/b/c/h", "g;x=1/../y": "http://a/b/c/y", "g?y/../x": "http://a/b/c/g?y/../x",
        " http://h/x#s\n": "http://h/x", "g:h": None, "about:blank": None,
    }
    d = spark.createDataFrame([(k,) for k in want], "to string")
    assert {r.to: r.url for r in d.select("to", url_filter.resolved(F.col("to"), F.lit("http://a/b/c/d;p?q#z")).alias("url")).collect()} == want
    assert tuple(d.limit(1).select(url_filter.resolved(F.lit("g"), F.lit("http://a?q")), url_filter.resolved(F.lit("g"), F.lit("a/b"))).first()) == ("http://a/g", None)


def test_relative_targets_stay_on_their_host(spark):
    to = lambda u: f'<meta http-equiv=refresh content="0;url={u}">'
    data = [
        (1, "http://m.net/a/x", to("index.html")), (2, "http://m.net/a/index.html#top", '<link rel=canonical href="http://x.com/de/1">'), (3, "http://other.net/", to("index.html")), (4, "http://other.net/index.html", ""),
        (5, "http://m.net/b?p=2", to("?p=1")), (6, "http://m.net/b?p=1", to("../a/./index.html#end")), (7, "nowhere", to("index.html")), (8, "nothing", to("index.html")), (9, "http://z.net/", to("about:blank")), (10, "http://z.com/de/", to("about:blank")),
        (11, "http://y.net/q", '<base href="/sub/">' + to("r")), (12, "http://y.net/sub/r", '<link rel=canonical href="//x.com/de/2">'),
    ]
    got = {r.page_id: (r.verdict, r.component) for r in url_filter.url_filter(pages(spark, data), url_filter.rule_table(spark, URL_RULES)).collect()}
    assert {k for k, v in got.items() if v[0] == "block"} == {1, 2, 5, 6, 10, 11, 12}
    assert got[1][1] == got[2][1] == got[5][1] == got[6][1] != got[3][1] == got[4][1] and got[11][1] == got[12][1] != got[1][1]
    assert [got[i][1] for i in (7, 8)] == [None] * 2 and got[9][1] != got[10][1]


def test_spellings_of_a_page_are_one_class(spark):
    data = [(1, "http://A.net:80/x/?utm_source=f&b=1", ""), (2, "https://a.net/x?b=1#top", '<link rel=canonical href="http://q.com/de/">'), (3, "https://a.net/x", ""), (4, "HTTP://a.net/x//", ""), (5, "ftp://a.net/x", ""), (6, "http://a.net/x?b=1&utm_id=3", "")]
    got = {r.page_id: (r.verdict, r.component) for r in url_filter.url_filter(pages(spark, data), url_filter.rule_table(spark, URL_RULES)).collect()}
    assert {k for k, v in got.items() if v[0] == "block"} == {1, 2, 6} and got[1][1] == got[2][1] == got[6][1]
    assert got[3][1] == got[4][1] == "https://a.net/x" or got[3][1] == got[4][1]
    assert got[5] == ("allow", None)


def test_clashing_page_columns(spark):
    p = pages(spark, [(1, "http://b.com/de/", None)]).withColumn("host", F.lit("mine")).withColumn("rule", F.lit(1))
    got = url_filter.match_rules(p, url_filter.rule_table(spark, URL_RULES))
    assert got.columns == ["page_id", "url", "html", "extra", "host", "path", "rule", "rule_verdict"] and got.first().host == "b.com"


def test_audit_sees_moved_files_and_causes(spark):
    base = pages(spark, [(i, f"http://h/{i}", "<p>x</p>") for i in range(-200, 200)] + [(None, f"u{i}", "") for i in range(40)])
    records = warc_audit.to_records(base, 16)
    a = warc_audit.build_tree(records, fanout=4)
    moved = warc_audit.build_tree(records.withColumn("file", F.when(F.col("file") == 3, F.lit(1000)).when(F.col("file") == -5, F.lit(-1001)).otherwise(F.col("file")).cast("long")), fanout=4)
    assert warc_audit.root(a) != warc_audit.root(moved)
    got = {(r.file, r.status) for r in warc_audit.audit(a, moved)[0].collect()}
    assert got == {(3, "missing"), (1000, "added"), (-5, "missing"), (-1001, "added")}
    longer = warc_audit.build_tree(warc_audit.to_records(base.withColumn("html", F.when(F.col("page_id") == 20, F.lit("<p>longer</p>")).otherwise(F.col("html"))), 16), fanout=4)
    got = {(r.file, r.pos): r.status for r in warc_audit.audit(a, longer)[0].collect()}
    assert got.pop((1, 4)) == "corrupt" and got == {(1, i): "shifted" for i in range(5, 16)}


def test_audit_of_one_hot_id(spark):
    """Offsets of a file whose records share an id: running sums over segments, against a plain sum."""
    rows = [(7, f"http://h/{i % 50}", "x" * (i % 9)) for i in range(600)] + [(3, "a", "b"), (8, "c", "d")]
    got = warc_audit.digests(warc_audit.to_records(pages(spark, rows))).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(602)) and got[0].page_id == 3 and got[-1].page_id == 8
    at = 0
    for r in got:
        assert r.offset == at
        at += r.length


def test_audit_finds_damage(spark):
    data = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 7)) for i in range(300)] + [(None, None, None), (5, "again", "")]
    base = pages(spark, data)
    a = warc_audit.build_tree(warc_audit.to_records(base, 64), fanout=4)
    same = warc_audit.build_tree(warc_audit.to_records(base.repartition(5), 64), fanout=4)
    assert warc_audit.root(a) == warc_audit.root(same) and warc_audit.audit(a, same)[0].count() == 0
    rotten = base.withColumn("html", F.when(F.col("page_id").isin(17, 250), F.lit("<p>rot</p>" * 3)).otherwise(F.col("html")))
    bad, counts = warc_audit.audit(a, warc_audit.build_tree(warc_audit.to_records(rotten, 64), fanout=4))
    found = {(r.file, r.pos) for r in bad.collect()}
    assert {(0, 18), (3, 58)} <= found  # and what a changed length has shifted
    assert all(f in (0, 3) for f, _ in found) and counts[0] == 1 and len(counts) > 3
    gone = warc_audit.build_tree(warc_audit.to_records(base.where("page_id <> 299 or page_id is null"), 64), fanout=4)
    assert [(r.file, r.status) for r in warc_audit.audit(a, gone)[0].collect()] == [(4, "missing")]
    assert [(r.file, r.status) for r in warc_audit.audit(gone, a)[0].collect()] == [(4, "added")]
    assert warc_audit.audited_records(a, same).where("status = 'ok'").count() == len(data)
    none = warc_audit.build_tree(warc_audit.to_records(base.limit(0), 64), fanout=4)
    assert warc_audit.root(none) is None and warc_audit.audit(none, none)[0].count() == 0


@pytest.mark.parametrize("segment", [4096, 2])
def test_separators_across_blocks(spark, segment, monkeypatch):
    np = pytest.importorskip("numpy")
    monkeypatch.setattr(token_counts, "SEGMENT", segment)
    g = random.Random(2)
    data, want = [], set()
    for f in range(4):
        ids, start, doc = [], 0, 0
        for n in [0, 1, 0, 7, 40, 0, 3] * 3:
            ids += [g.randint(0, 9) for _ in range(n)] + [99]
            want.add((f, doc, start, n, False))
            start, doc = start + n + 1, doc + 1
        if f % 2:
            ids += [5] * 11
            want.add((f, doc, start, 11, True))
        for b in range(0, -(-len(ids) // 8)):
            data.append((f, b, bytearray(np.array(ids[8 * b : 8 * b + 8], "<u2").tobytes())))
    data += [(9, 0, None), (9, 1, bytearray(np.array([99, 1], "<u2").tobytes()))]
    want |= {(9, 0, 0, 0, False), (9, 1, 1, 1, True)}
    data += [(None, -1, bytearray(b"\x01\x00")), (None, 0, bytearray(b"\x01\x00\x63\x00"))]  # a null file, a number below 0
    want |= {(None, 0, 0, 2, False)}
    blocks = spark.createDataFrame(data, "file long, block long, tokens binary")
    got = {(r.file, r.doc, r.start, r.n_tokens, r.open) for r in token_counts.token_counts(blocks, 99).collect()}
    assert got == want
    assert token_counts.token_counts(blocks.limit(0), 99).count() == 0


def test_flat_files(spark, tmp_path):
    np = pytest.importorskip("numpy")
    (tmp_path / "a.bin").write_bytes(np.array([1, 2, 99, 3, 99], "<u2").tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    got = token_counts.token_counts(token_counts.read_token_files(spark, str(tmp_path), block_tokens=2), 99).collect()
    assert sorted((r.doc, r.start, r.n_tokens) for r in got) == [(0, 0, 2), (1, 3, 1)]


def test_counts_match_the_tokenizer(spark):
    P, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    from vertexloom.llm.byte_bpe import read_ranks

    texts = [None, "", "a b", "hello " * 900] + [f"text {i} " * (i % 17) for i in range(100)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    path = P.path("byte_bpe_50k.tiktoken")
    blocks = token_counts.write_token_blocks(docs, path, P.PATTERN, 50256, block_tokens=100).cache()
    assert blocks.where("octet_length(tokens) > 200").count() == 0
    found = token_counts.token_counts(blocks.drop("doc_ids"), 50256).join(blocks.select("file", "block", "doc_ids"), ["file", "block"]).select(F.get("doc_ids", F.col("i")).alias("doc_id"), "n_tokens")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    assert {r.doc_id: r.n_tokens for r in found.collect()} == {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    blocks.unpersist()


def test_flat_file_beyond_2_gb(spark, tmp_path):
    np = pytest.importorskip("numpy")
    n, ends = (1 << 30) + 700, [5, 1 << 29, (1 << 30) + 300]
    with open(tmp_path / "a big.bin", "wb") as f:  # sparse
        f.truncate(2 * n)
        for e in ends:
            f.seek(2 * e)
            f.write(np.array([99], "<u2").tobytes())
    (tmp_path / "_part-left-behind").write_bytes(b"cc")
    got = token_counts.token_counts(token_counts.read_token_files(spark, str(tmp_path), block_tokens=1 << 22), 99).orderBy("doc").collect()
    assert [(r.start, r.n_tokens, r.open) for r in got] == [(0, 5, False), (6, ends[1] - 6, False), (ends[1] + 1, ends[2] - ends[1] - 1, False), (ends[2] + 1, n - ends[2] - 1, True)]


def test_query_reads_flat_files(spark, tmp_path):
    tiktoken = pytest.importorskip("tiktoken")
    P = pytest.importorskip("public_tokenizers")
    from vertexloom.llm.byte_bpe import read_ranks

    texts = [None, "", "hello " * 900] + [f"text {i} " * (i % 17) for i in range(100)]
    path, folder = P.path("byte_bpe_50k.tiktoken"), tmp_path / "flat files"
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    names = token_counts.write_token_files(docs, str(folder), path, P.PATTERN, 50256)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    want = {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    files = sorted(x.name for x in folder.iterdir() if not x.name.startswith("."))
    assert files == [f"part-{i:05d}.bin" for i in range(3)]
    assert sum((folder / x).stat().st_size for x in files) == 2 * (sum(want.values()) + len(texts))  # ids and separators, nothing else
    found = token_counts.token_counts(token_counts.read_token_files(spark, str(folder), block_tokens=100), 50256)
    found = found.withColumn("file", F.regexp_extract("file", r"part-(\d+)\.bin$", 1).cast("long")).join(names, ["file", "doc"])
    assert {r.doc_id: r.n_tokens for r in found.collect()} == want


def test_digest_columns(spark):
    """The query's digests on a tiny table equal a plain computation."""
    back = chat_format.read_back(chat_format.format_chat(chat_format.events_from_rows(rows(spark, CHAT[-2:])))).first()
    raw = "".join(f"{t.role}\n{t.text}\n" for t in back.turns)
    assert hashlib.sha256(raw.encode()).hexdigest() == hashlib.sha256(b"user\n</s>[INST] ok [/INST]\nassistant\n</s>[INST] ok [/INST]\n").hexdigest()
