"""Operators on documents: brute force, edge cases and planted cases on small tables."""

import hashlib
import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vertexloom.llm import byte_bpe, decontaminate, jaccard_join, license_scan, quality_classifier, quality_rules
from vertexloom.llm.common import components

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and river stone lamp window garden market bridge cloud paper engine winter copper signal harbour violet meadow thunder".split()


def prose(seed: int, n: int = 120) -> str:
    g = random.Random(seed)
    return " ".join(g.choice(WORDS) + str(g.randint(0, 400)) for _ in range(n)) + "."


def table(spark, texts, **more):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOCS)


ODD = [None, "", " \n\t ", "one", "a b c d e f g", "x " * 30_000, "y" * 50_000, prose(1), prose(1), "Grüße 漢字 😀 ﬀ\u2028 nbsp\u00a0end", "\\ ' \" <|im_end|> \x00 \x1c"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i % 4 == 0 else "en", None if i % 3 == 0 else "s", None) for i, t in enumerate(ODD)]
    rows += [(7, ODD[7], "en", "s", 1), (None, prose(2), None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).withColumn("n_words", F.lit("clash")).withColumn("score", F.lit("clash")).withColumn("ids", F.lit("clash"))


def test_rules_brute_force(spark, odd):
    got = quality_rules.quality_rules(odd).collect()
    assert len(got) == len(ODD) + 3
    for r in got:
        t = {i: x for i, x in enumerate(ODD)}.get(r.doc_id) if r.doc_id is not None else None
        if r.doc_id is None:
            continue
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = {}
        for i in range(len(w) - 7):
            seen.setdefault(tuple(w[i : i + 8]), []).append(i)
        rep = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep))
        assert r.base_failed == (len(w) < 20 or 100 * len(rep) > 30 * len(w)) and not (r.base_failed and r.kept)


def test_rules_adapt_and_keep(spark):
    clean = [prose(i) for i in range(80)]
    junk = [re.sub(r" ", "### ", prose(1000 + i)) for i in range(8)]
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(table(spark, clean + junk)).collect()}
    assert all(got[i] for i in range(80)) and not any(got[80 + i] for i in range(8))
    kept = quality_rules.filter_by_rules(table(spark, clean + junk))
    assert kept.count() == 80 and kept.columns == table(spark, []).columns
    assert quality_rules.filter_by_rules(table(spark, [])).count() == 0


def test_fences_follow_the_source(spark):
    """One text, two verdicts: a source whose symbols vary keeps it, a source without symbols rejects it."""
    plain = [prose(i) for i in range(200)]
    tables = ["| ".join(t.split(" ")[: 10 + i % 80]) + " " + t for i, t in enumerate(plain)]
    text = "| ".join(prose(900).split(" ")[:20]) + " " + prose(901)
    rows = [(i, t, "en", "books", 0) for i, t in enumerate(plain)] + [(300 + i, t, "en", "tables", 0) for i, t in enumerate(tables)] + [(1000, text, "en", "books", 0), (1001, text, "en", "tables", 0)]
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, DOCS)).collect()}
    assert not got[1000] and got[1001]
    assert sum(got[i] for i in range(200)) >= 190 and sum(got[300 + i] for i in range(200)) >= 190


def test_filters_return_clashing_columns(spark):
    docs = table(spark, [prose(i) for i in range(70)]).withColumn("n_words", F.lit("a")).withColumn("kept", F.lit(-1)).withColumn("score", F.lit("s")).withColumn("items", F.col("doc_id")).withColumn("hi_len100", F.lit(0))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(70)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "none of these words is found")], "item_id long, text string")
    want = sorted(map(tuple, docs.collect()))
    for got in (quality_rules.filter_by_rules(docs), quality_classifier.filter_by_quality(docs, labels, steps=50), decontaminate.decontaminate(docs, bench)):
        assert got.columns == docs.columns and got.count() > 0 and set(map(tuple, got.collect())) <= set(want)


def test_sketches_merge(spark):
    m = quality_rules.measure(table(spark, [prose(i, 30 + i) for i in range(60)]))
    one = quality_rules.sketches(m).groupBy("feature", "bucket").agg(F.sum("n").alias("n"))
    two = quality_rules.sketches(m.where("doc_id % 2 = 0")).unionAll(quality_rules.sketches(m.where("doc_id % 2 = 1"))).groupBy("feature", "bucket").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    got = spark.range(5000).select("id", quality_rules.bucket("id").alias("b")).collect()
    assert all(r.b <= r.id <= r.b * 17 / 16 + 1 for r in got)


def test_classifier(spark, odd):
    good, bad = [prose(i) for i in range(150)], [" ".join([w] * 40) + " " + w for i in range(30) for w in [prose(i, 1)]] + [prose(i).upper().replace(" ", "!! ") for i in range(30)]
    docs = table(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(210) if i % 2], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(docs, labels, steps=600)
    assert 0.5 < model.prior < 0.9  # 150 of 210
    s = quality_classifier.score(docs, model, ["doc_id"]).withColumn("h", quality_classifier.held_out()).collect()
    right = [(r.score >= 0.5) == (r.doc_id < 150) for r in s if r.h]
    assert sum(right) / len(right) > 0.9
    assert {r.h for r in s} == {True, False} and all(0 <= r.score <= 1 for r in s)
    assert quality_classifier.score(odd, model, ["doc_id", "score"]).count() == len(ODD) + 3
    assert quality_classifier.fit(docs, labels.where("quality = 5")) is None
    assert [r.score for r in quality_classifier.score(table(spark, ["a"]), None, ["doc_id"]).collect()] == [0.5]
    assert quality_classifier.filter_by_quality(docs, labels, steps=600).columns == docs.columns


def test_prior_from_positives_and_unlabelled():
    np = pytest.importorskip("numpy")
    g = np.random.default_rng(0)
    pos, neg = g.normal(2, 1, (4000, 4)), g.normal(-2, 1, (1200, 4))
    got = quality_classifier.estimate_prior(pos[:2000], np.concatenate([pos[2000:], neg]))
    assert abs(got - 2000 / 3200) < 0.08


def _brute_join(texts):
    def shingles(t):
        w = (t or "").lower().split()
        k = min(5, len(w))
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()

    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t or "", i)
    sets = {i: shingles(t) for t, i in first.items()}
    links = {(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    return first, links


def _near(seed, edits):
    w, g = prose(seed, 150).split(), random.Random(seed * 31 + edits)
    for _ in range(edits):
        w[g.randrange(len(w))] = f"edit{g.randint(0, 999)}"
    return " ".join(w)


@pytest.mark.parametrize("how", [{}, {"bucket": 8, "tile": 16, "depth": 3}])
def test_join_brute_force(spark, how):
    texts = [_near(s, e) for s in range(6) for e in range(8)] + [prose(99), prose(99), "a b", "A  b", "", None, None] + [_near(50, i % 4 + 1) + f" tail{i}" for i in range(60)]
    # a passage that many different texts share is no link
    texts += [prose(7, 30) + " " + prose(3000 + i, 150) for i in range(60)]
    first, links = _brute_join(texts)
    got = {r.doc_id: r for r in jaccard_join.similarity_join(table(spark, texts), **how).collect()}
    assert len(got) == len(texts)
    root = {i: i for i in first.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in sorted(links):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    for i, t in enumerate(texts):
        rep = first[t or ""]
        assert (got[i].rep_id, got[i].class_id, got[i].n_links) == (rep, find(rep), sum(rep in p for p in links))


def test_join_odd_rows(spark, odd):
    got = jaccard_join.similarity_join(odd).collect()
    assert len(got) == len(ODD) + 3
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[8].class_id == 7 and by[8].n_links == 0 and by[2].class_id == 2
    assert sorted([r.class_id for r in got if r.doc_id is None], key=str) == [0, None]  # a null text copies document 0's
    kept = jaccard_join.deduplicate(odd).collect()
    # null and empty texts are one text: document 0 stands for both, and for the one without an id
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [0, 2, 3, 4, 5, 6, 7, 9, 10] and sum(r.doc_id is None for r in kept) == 1
    assert jaccard_join.deduplicate(table(spark, [])).count() == 0


@pytest.mark.parametrize("bits", [1 << 28, 1 << 10])
def test_one_id_with_two_texts(spark, bits, monkeypatch):
    """No link and no text is lost; a filter too small for its rows changes nothing."""
    monkeypatch.setattr(jaccard_join, "FILTER_BITS", bits)
    w, v = prose(1, 150), prose(2, 150)
    fewer = lambda t: " ".join(t.split()[1:])
    rows = [(1, w), (1, v), (2, fewer(w)), (3, fewer(v)), (1, w), (9, w), (None, v), (None, prose(3)), (None, prose(3))] + [(100 + i, prose(100 + i)) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).withColumn("drop", F.lit(1)).withColumn("k", F.lit(2))
    got = [(r.doc_id, r.class_id, r.n_links) for r in jaccard_join.similarity_join(docs).collect() if r.doc_id is None or r.doc_id < 100]
    assert sorted(got, key=str) == sorted([(1, 1, 1)] * 3 + [(2, 1, 1), (3, 1, 1), (9, 1, 1), (None, 1, 1)] + [(None, None, 0)] * 2, key=str)
    kept = jaccard_join.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted([(r.doc_id, r.text) for r in kept.collect() if r.doc_id is None or r.doc_id < 100], key=str) == sorted([(1, w), (1, v), (None, prose(3))], key=str)
    assert kept.count() == 303


def test_measured_recall(spark):
    """Links of every text whose id is divisible by 20, against all texts by brute force."""
    texts = [_near(s, e) for s in range(150) for e in (0, 1, 2, 3, 4, 5, 6, 8)] + [prose(5000 + i, 20 + i) for i in range(300)]
    sets = [frozenset(zip(*(t.lower().split()[i:] for i in range(5)))) for t in texts]
    want = {i: sum(texts[i] != texts[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in range(len(texts))) for i in range(0, len(texts), 20)}
    got = {r.doc_id: r.n_links for r in jaccard_join.similarity_join(table(spark, texts)).collect()}
    assert sum(want.values()) > 50 and all(got[i] <= n for i, n in want.items())
    assert sum(got[i] for i in want) >= 0.99 * sum(want.values())


def test_size_classes_lose_no_pair(spark):
    sizes = [1, 2, 3, 4, 5, 79, 80, 99, 100, 101, 125, 1000, 1250, 1251] * 30
    sized = spark.createDataFrame([(i, 0, n) for i, n in enumerate(sizes)], "doc long, comp long, size long")
    met: dict = {}
    for r in jaccard_join._tiles(sized, 0.8, 8).collect():
        met.setdefault(r.key, []).append((r.doc, r.side, r.diagonal))
    pairs = {}
    for rows in met.values():
        for a, sa, d in rows:
            for b, sb, _ in rows:
                if (a < b) if d else (sa < sb):
                    pairs[min(a, b), max(a, b)] = pairs.get((min(a, b), max(a, b)), 0) + 1
    assert all(n == 1 for n in pairs.values())
    assert all((a, b) in pairs for a in range(len(sizes)) for b in range(a + 1, len(sizes)) if min(sizes[a], sizes[b]) >= 0.8 * max(sizes[a], sizes[b]))


def test_runs_reach_recall():
    n = jaccard_join.runs_for(0.999, 3, 64)
    assert 1 - (1 - jaccard_join.survival(3, 64)) ** n >= 0.999 > 1 - (1 - jaccard_join.survival(3, 64)) ** (n - 1)


def test_shared_counts():
    np = pytest.importorskip("numpy")
    g = np.random.default_rng(3)
    sets = [np.unique(g.integers(0, 300, g.integers(1, 120)).astype(np.uint64)) for _ in range(40)]
    got = jaccard_join._shared_counts(sets[:25], sets[25:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[25:]] for a in sets[:25]]


def test_components(spark):
    g = random.Random(4)
    e = [(i, i + 1) for i in range(0, 60)] + [(g.randint(100, 160), g.randint(100, 160)) for _ in range(40)] + [(200, 200 + i) for i in range(1, 50)] + [(None, 1)]
    root = {x: x for p in e for x in p if x is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in e:
        if a is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(e, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in root if any(x in p and p[0] != p[1] and p[0] is not None for p in e)}


def _brute_hits(text, items):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    w, hit, names = words(text), set(), set()
    for name, t in items:
        iw = words(t)
        k = min(8, len(iw))
        windows = {tuple(iw[j : j + k]) for j in range(len(iw) - k + 1)} if iw else set()
        for i in range(len(w) - k + 1 if windows else 0):
            if tuple(w[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                names.add(str(name))
    return len(w), len(hit), sorted(names)


@pytest.mark.parametrize("block", [8 << 20, 200])
def test_decontamination_brute_force(spark, odd, block):
    items = [(1, prose(500, 40)), (2, "É Two words"), (3, prose(501, 12)), (3, prose(502, 9)), (10, ""), (11, None), (12, "Solo")]
    texts = [prose(1) + " " + prose(500, 40) + " " + prose(2), prose(500, 40)[20:200].upper(), "é two, WORDS! é two words", "solo", prose(501, 12) + prose(502, 9), prose(3), None, "", prose(500, 40) * 3]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_matches(table(spark, texts), bench, keep=["doc_id"], block_bytes=block).collect()
    for r in got:
        assert (r.n_words, sum(s.length for s in r.hit_spans), r["items"]) == _brute_hits(texts[r.doc_id], items)
        # spans of different matches may touch and merge, so a span bounds the longest match
        assert min(8, r.n_words, max([s.length for s in r.hit_spans], default=0)) <= r.longest <= max([s.length for s in r.hit_spans], default=0) or r.doc_id in (2, 3)
    assert decontaminate.find_matches(odd, bench).count() == len(ODD) + 3
    left = decontaminate.decontaminate(table(spark, texts), bench, min_items=1)
    assert sorted(r.doc_id for r in left.collect()) == [2, 5, 6, 7] and left.columns == table(spark, []).columns
    assert decontaminate.find_matches(table(spark, texts), bench.limit(0)).where("size(items) > 0").count() == 0


def test_longest_match(spark):
    bench = spark.createDataFrame([(4, prose(77, 60))], "item_id long, text string")
    text = prose(78, 10) + " " + " ".join(prose(77, 60).split()[5:30]) + " " + prose(79, 5)
    r = decontaminate.find_matches(table(spark, [text]), bench).first()
    assert (r.longest, r.longest_start, r.longest_item) == (25, 10, "4")


def test_suffix_array_brute_force():
    """Every place, item and longest match of small shards over few words, in one block and in many."""
    g = random.Random(1)
    for _ in range(150):
        known = [f"w{i}" for i in range(g.choice([2, 3, 8, 30]))]
        texts = [None if g.random() < 0.1 else " ".join(g.choice([*known, "zz"]) for _ in range(g.randrange(40))) for _ in range(6)]
        rows = [(str(i // 2), " ".join(g.choice(known) for _ in range(g.randrange(14)))) for i in range(5)]
        width = g.choice([1, 2, 3, 8])
        one = decontaminate.match_shard(texts, decontaminate.Items(rows, width))
        many = decontaminate.match_shard(texts, decontaminate.Items(rows[:1], width))
        for r in rows[1:]:
            many = [decontaminate._merge(a, b) for a, b in zip(many, decontaminate.match_shard(texts, decontaminate.Items([r], width)))]
        items = [(n, t.split()) for n, t in rows if t]
        for text, got, again in zip(texts, one, many):
            w, hit, names, starts = (text or "").split(), set(), set(), set()
            for n, x in items:
                k = min(width, len(x))
                windows = {tuple(x[j : j + k]) for j in range(len(x) - k + 1)}
                here = {i for i in range(len(w) - k + 1) if tuple(w[i : i + k]) in windows}
                starts |= here
                hit |= {i + d for i in here for d in range(k)}
                names |= {n} if here else set()
            best = (0, 0, "")
            for i in starts:
                for n, x in items:
                    for j in range(len(x)):
                        common = 0
                        while i + common < len(w) and j + common < len(x) and w[i + common] == x[j + common]:
                            common += 1
                        best = max(best, (common, -i, n))
            covered = {p for s in got[1] for p in range(s["start"], s["start"] + s["length"])}
            assert (got[0], covered, got[2]) == (len(w), hit, sorted(names)) and again[:3] == got[:3]
            assert got[3:] == ((best[0], -best[1], best[2]) if starts else (0, None, None))


def test_suffix_order():
    import numpy as np

    g = np.random.default_rng(3)
    for n in (1, 2, 50, 400):
        numbers = np.append(g.integers(0, 3, n), 0)
        order, texts = decontaminate.SuffixOrder(numbers), [tuple(numbers[i : i + int(np.argmax(numbers[i:] == 0))]) for i in range(n + 1)]
        a, b = g.integers(0, n + 1, 500), g.integers(0, n + 1, 500)
        shared = [next((k for k, (x, y) in enumerate(zip(texts[i], texts[j])) if x != y), min(len(texts[i]), len(texts[j]))) for i, j in zip(a, b)]
        assert order.common(a, b).tolist() == shared
        assert all((order.ranks[-1][i] < order.ranks[-1][j]) == (texts[i] < texts[j]) for i, j in zip(a, b))


@pytest.fixture(scope="module")
def encoding():
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    return path, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})


def test_bpe_equals_the_library(spark, odd, encoding):
    path, enc = encoding
    g = random.Random(5)
    alphabet = [" ", "  ", "\n", "\t", "\xa0", "a", "B", "'s", "'", "9", "é", "!", "##", "\x85", "\x1c", "漢", "😀", "word", "\u2003", "²"]
    texts = [x for x in ODD] + ["".join(g.choice(alphabet) for _ in range(g.randint(0, 20))) for _ in range(400)] + [prose(i) for i in range(30)] * 2
    docs = table(spark, texts)
    enc_df = byte_bpe.encode(docs, path, P.PATTERN, keep=["doc_id"])
    for r in byte_bpe.decode(enc_df, path).collect():
        t = texts[r.doc_id] or ""
        assert r.ids == enc.encode_ordinary(t) and bytes(r.decoded) == t.encode()
    for r in byte_bpe.round_trip(docs, path, P.PATTERN, ["doc_id"], max_words=64).collect():
        ids = enc.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest())
    assert byte_bpe.encode(odd, path, P.PATTERN).count() == len(ODD) + 3
    assert byte_bpe.round_trip(docs.limit(0), path, P.PATTERN, ["doc_id"]).count() == 0


def _merge(word: bytes, ranks):
    part = [word[i : i + 1] for i in range(len(word))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(part, part[1:])) if a + b in ranks]
        if not found:
            return [ranks[x] for x in part]
        i = min(found)[1]
        part[i : i + 2] = [part[i] + part[i + 1]]


@pytest.mark.parametrize("long", [0, 5, 64])
def test_bpe_folds_alike(spark, encoding, long, monkeypatch):
    """Both ways of merging against the plain rule; 0: every word merges all places at once."""
    ranks = byte_bpe.read_ranks(encoding[0])
    monkeypatch.setattr(byte_bpe, "LONG", long)
    g = random.Random(6)
    words = ["".join(g.choice(a) for _ in range(g.randint(1, n))) for a, n in (("abcdeinorst éüß漢", 14), ("aab", 30), ("etaoin", 200), ("漢字", 9)) for _ in range(60)]
    got = spark.createDataFrame([(sorted(set(words)),)], "w array<string>").select("w", byte_bpe.fold_words(F.col("w"), ranks).alias("ids")).first()
    assert [list(x) for x in got.ids] == [_merge(w.encode(), ranks) for w in got.w]


def test_bpe_merges_in_place_order(spark):
    """Ranks at which merging all places at once would differ: 'aba' goes before the rest of 'ab'."""
    ranks = {b"a": 0, b"b": 1, b"aba": 2, b"ab": 3, b"ba": 4, b"abab": 5}
    words = ["ab" * n + "a" * m for n in range(1, 60) for m in range(3)]
    got = spark.createDataFrame([(words,)], "w array<string>").select(byte_bpe.fold_words(F.col("w"), ranks)).first()[0]
    assert [list(x) for x in got] == [_merge(w.encode(), ranks) for w in words]


def test_bpe_has_one_way_for_all_words(spark, encoding, monkeypatch):
    """Ids come from the higher-order fold alone, whatever the dictionary holds and however often a task forgets."""
    path, enc = encoding
    texts = [prose(i, 60) for i in range(40)] + ["x" * 40 + "Qz" * 700, "漢字" * 300, "aAbB" * 300]
    for asked, slice_, most in ((50, 400, 0), (1 << 20, 1000, 10), (300, 100_000, 1 << 19)):
        monkeypatch.setattr(byte_bpe, "ASKED", asked)
        monkeypatch.setattr(byte_bpe, "SLICE", slice_)
        got = byte_bpe.encode(table(spark, texts).repartition(2, "doc_id"), path, P.PATTERN, keep=["doc_id"], max_words=most).collect()
        assert {r.doc_id: r.ids for r in got} == {i: enc.encode_ordinary(t) for i, t in enumerate(texts)}
    assert not [k for k in vars(byte_bpe) if k.startswith("fold") and k != "fold_words"]


@pytest.mark.parametrize("long", [0, 64])
def test_bpe_of_any_ranks(spark, long, monkeypatch):
    """Small random vocabularies with gaps, bytes without a rank and pieces that merging does not reach."""
    monkeypatch.setattr(byte_bpe, "LONG", long)
    g = random.Random(12)
    for _ in range(6):
        pieces = sorted({"".join(g.choice("abc") for _ in range(g.randint(2, 6))) for _ in range(60)} | set("abc"))
        ranks = {x.encode(): r for x, r in zip(pieces, g.sample(range(500), len(pieces)))}
        words = sorted({"".join(g.choice("abc") for _ in range(g.randint(1, 24))) for _ in range(150)} | {"abcabc" * 9, "aabbcc" * 8}) + pieces
        got = spark.createDataFrame([(words,)], "w array<string>").select(byte_bpe.fold_words(F.col("w"), ranks)).first()[0]
        assert [list(x) for x in got] == [[ranks[w.encode()]] if w.encode() in ranks else _merge(w.encode(), ranks) for w in words]
    got = spark.createDataFrame([(["abd", "d", "", "dé"],)], "w array<string>").select(byte_bpe.fold_words(F.col("w"), {b"a": 7, b"b": 3, b"ab": 9})).first()[0]
    assert [list(x) for x in got] == [[9, None], [None], [], [None, None, None]]


def test_bpe_folds_numbers(spark):
    """A step of the fold neither spells nor cuts: ranks are found by numbers of pieces, and one array is passed over once."""
    ranks = {b"a": 7, b"b": 3, b"ab": 9, b"aba": 1, b"abab": 20}
    plan = spark.createDataFrame([(["ab"],)], "w array<string>").select(byte_bpe.fold_words(F.col("w"), ranks))._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" in plan and not re.search(r"\b(hex|slice|concat|regexp_extract_all)\(", plan)
    pairs = byte_bpe.Pairs(ranks)
    number = {x: i for i, x in enumerate(pairs.pieces, 1)}
    for x in [*ranks, b"c"]:
        for y in ranks:
            k = number.get(x, pairs.none) << pairs.bits | number[y]
            got = pairs.slots[(k + pairs.shifts[k % len(pairs.shifts)]) % len(pairs.slots)] ^ k << pairs.bits
            assert (got if got < 1 << pairs.bits else None) == number.get(x + y)


def test_bpe_numbers_of_words(monkeypatch):
    """Numbers are exact, also where hashes clash, and a look-up costs by the words asked for."""
    g = random.Random(9)
    every = sorted({"".join(g.choice("abcdeé漢") for _ in range(g.randint(1, 9))) for _ in range(30_000)})
    g.shuffle(every)
    held, other = pa.array(every[::2] + ["y" * 50_000, ""]), pa.array(every[1::2])
    numbers = byte_bpe.Numbers(held.slice(0, 7))
    numbers.add(held.slice(7))
    assert numbers.find(held).tolist() == list(range(len(held))) and set(numbers.find(other).tolist()) == {-1}
    began = time.process_time()
    for _ in range(2_000):
        numbers.find(held.slice(50, 5))
    assert time.process_time() - began < 3  # hashing all held words at each call takes over 1 ms a call
    monkeypatch.setattr(byte_bpe, "_hashes", lambda words: np.array([len(w) for w in words.to_pylist()], np.uint64))
    clash = byte_bpe.Numbers(pa.array(["ab", "cd", "e"]))
    assert clash.find(pa.array(["e", "ab", "cd", "zz", "xyz"])).tolist() in ([2, 0, -1, -1, -1], [2, -1, 1, -1, -1])


def test_bpe_dictionary_takes_what_fits(spark, encoding, monkeypatch):
    """Words of three slices are kept where those of two do not fit."""
    path, _ = encoding
    monkeypatch.setattr(byte_bpe, "COUNT_SLICE", 1)
    docs = table(spark, ["two three", "two three", "xx three", "yy zz"])
    got = byte_bpe.dictionary(docs, byte_bpe.read_ranks(path), P.PATTERN, max_words=1)
    assert [r.word for r in got.collect()] == [" three"]


def test_license_scan(spark, odd):
    notes = {"apache": "Licensed under the Apache License, Version 2.0.", "mit": "Released under the MIT License.", "gpl": "This work is licensed under the GNU General Public License, version 3.", "cc-by-nc": "Licensed under CC BY-NC 4.0.", "reserved": "All rights reserved."}
    texts = [prose(i) + "\n" + t + "\n" + prose(i + 50) for i, t in enumerate(notes.values())] + [prose(i) for i in range(20)] + ["licensed taxi drivers have rights to version their version of the public"]
    docs = table(spark, texts)
    model = license_scan.train(docs, copies=30)
    got = {r.doc_id: r for r in license_scan.scan(docs, model, ["doc_id"]).collect()}
    for i, family in enumerate(notes):
        assert [(x.line, x.family, x.confirmed) for x in got[i].found] == [(1, family, True)], family
    assert not any(x.confirmed for i in range(5, len(texts)) for x in got[i].found)
    assert license_scan.scan(odd, model, ["doc_id", "found"] if "found" in odd.columns else ["doc_id"]).count() == len(ODD) + 3
    # held-out variants: changed case and a dropped word
    variants = [t.upper() for t in notes.values()] + [" ".join(t.split()[1:]) for t in list(notes.values())[:4]]
    right = sum(model.classify(v)[0] == f for v, f in zip(variants, [*notes, *list(notes)[:4]]))
    assert right >= 8
    assert license_scan.train(None, copies=5).classify(prose(1))[0] == "unknown"
    assert license_scan.scan(docs.limit(0), model, ["doc_id"]).count() == 0


def test_license_scores_brute_force():
    """Every line and paragraph gets the probabilities of the plain sum over all its n-grams."""
    model = license_scan.train(None, copies=10)
    known, seen = [license_scan.words_of(t) for ts in license_scan.TEMPLATES.values() for t in ts], set()
    g = random.Random(4)
    every = [x for w in known for x in w]
    lines = [*known, [], ["of", "the"], ["zz"], *([g.choice([*every, "zz"]) for _ in range(g.randrange(30))] for _ in range(200))]
    lines += [w[: g.randrange(len(w))] + ["zz"] * g.randrange(3) + w[g.randrange(len(w)) :] for w in known for _ in range(5)]
    for w in lines:
        found = [model.matrix[model.row[x]] for x in license_scan.grams(w) if x in model.row]
        s = [b + sum(float(r[c]) for r in found) / max(1, len(found)) ** 0.5 for c, b in enumerate(model.bias)]
        e = [math.exp((x - max(s)) / model.temperature) for x in s]
        p = [x / sum(e) for x in e]
        assert list(model.probabilities(w)) == pytest.approx(p, abs=1e-5)
        best = max(range(len(p)), key=p.__getitem__)
        name, sure, _ = model.classify_words(w)
        seen.add(name)
        if abs(p[best] - model.cutoff) > 1e-5:
            assert name == (model.classes[best] if p[best] >= model.cutoff else "unknown") and sure == pytest.approx(p[model.classes.index(name)], abs=1e-5)
    assert len(seen) > 8


def test_wrapped_licenses(spark):
    """Notices wrapped over lines are found whole, once each, however narrow the lines are."""
    import textwrap

    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    texts, want = [], []
    for family, notice in (("mit", mit), ("bsd", bsd), ("gpl", gpl)):
        for width in (76, 30):
            body = textwrap.fill(notice, width)
            texts += [f"{prose(1)}\n\n{body}\n\n{prose(2)}", f"{prose(3)}\n" + "\n".join(f" * {x}" for x in body.split("\n")) + f"\n{prose(4)}"]
            want += [(family, 2, 3), (family, 1, 1)]
    texts += [prose(i).replace(" ", "\n", 40) for i in range(5, 9)]
    docs = table(spark, texts)
    got = {r.doc_id: r for r in license_scan.scan(docs, license_scan.train(docs), ["doc_id"]).collect()}
    for i, (family, line, n) in enumerate(want):
        sure = [x for x in got[i].found if x.confirmed]
        assert [x.family for x in sure] == [family], (i, got[i].found)
        assert got[i].n_paragraphs == n and line - 1 <= sure[0].line <= line + 1
    assert not any(x.confirmed for i in range(len(want), len(texts)) for x in got[i].found)
