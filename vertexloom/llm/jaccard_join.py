"""Set similarity join of documents by chosen paths, with exact verification.

A document is the set of its word shingles; two documents link if the Jaccard similarity of their
sets is ``threshold`` or more.  Exact copies are one text first.  Then:

1. *Sketch*: every set is embedded as ``tokens`` MinHash values; each (coordinate, value) is a token,
   and two sets share a token of a coordinate with their similarity as the probability.
2. *Choose paths*: every run splits the texts recursively.  At a node the coordinates are sampled by
   a hash of the path so that ``1 / threshold`` of them are expected to be chosen; each chosen token
   leads to the child of all texts that share it.  Similar texts survive a level with an expected
   one common child, others thin out.  Nodes of up to ``bucket`` texts are brute-forced on their
   sketches.  Nodes that are still larger at ``depth`` go on in tiles of pairs of blocks.
3. *Repeat*: the number of runs is the least that reaches ``recall`` for a pair exactly at the
   threshold that splits ``levels`` deep (``runs_for``); pairs above it, or within larger groups,
   do better.
4. *Verify*: pairs alike in sketch join texts into candidate groups (distributed connected
   components, one star per bucket, never all pairs).  Inside a candidate group all pairs are
   compared on whole shingle sets whose sizes allow a link at all: a group's texts are ordered into
   size classes, of which only equal and neighbouring ones can link, and the classes dealt to blocks of
   about ``tile`` texts and TILE_BYTES.  A task holds two blocks; only a text's number of links and its
   least linked partner leave it.

Texts are known by their MD5 and get a number, so that rows of one id with different texts stay apart.
No step moves texts: the sets of group members are made beside the scan, for the rows that a Bloom filter
of the members lets through (FILTER_BITS at most; a fuller filter lets more rows through, which the exact
join after it drops).

Words are runs of non-whitespace, lower-cased.  Defined cases: a text of fewer than ``width`` words
is one shingle of all its words; a null text (the empty text) or one without words links to nothing but
its exact copies; repeated rows and copies share a class; an id of several texts has one row for each, with
the class of its text; class_id is the least id of a class, so two classes that share an id share the number;
a class of rows that all lack an id is null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, give_back, stored, text_slices

SHINGLE = 5
THRESHOLD = 0.8
SEED = 20_241
#: bytes of shingle sets in a block of texts
TILE_BYTES = 4 << 20
#: 32 MB
FILTER_BITS = 1 << 28


def survival(levels: int, tokens: int) -> float:
    """Least probability that a pair at the threshold shares a node ``levels`` deep in one run."""
    p = 1.0
    for _ in range(levels):
        p = 1 - (1 - p / tokens) ** tokens
    return p


def runs_for(recall: float, levels: int, tokens: int) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(levels, tokens)))


def _mix(x):
    """splitmix64 finaliser on an array of uint64."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


class Shingler:
    """Texts to sorted arrays of 64-bit shingle hashes; word hashes are kept while there is room."""

    def __init__(self, width: int = SHINGLE, room: int = 100_000):
        self.width, self.room, self.seen = width, room, WordHashes()

    def __call__(self, text: str | None):
        import numpy as np

        words = (text or "").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        seen = self.seen
        if len(seen) > self.room:
            seen.clear()
        h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        k = min(self.width, len(words))
        out = np.full(len(words) - k + 1, k, np.uint64)
        for i in range(k):  # a polynomial of the words' hashes, mixed once
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += h[i : len(words) - k + 1 + i]
        return np.unique(_mix(out))


def minhash(sets: list, tokens: int):
    """tokens x len(sets) MinHash values (32 bits); a column of zeros for an empty set."""
    import numpy as np

    n = len(sets)
    out = np.zeros((tokens, n), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    flat = np.concatenate([sets[i] for i in full])
    at = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
    g = np.random.default_rng(SEED)
    a, b = g.integers(1, 1 << 63, tokens, dtype=np.uint64) | np.uint64(1), g.integers(0, 1 << 63, tokens, dtype=np.uint64)
    for t in range(tokens):
        v = (flat ^ b[t]) * a[t]
        v ^= v >> np.uint64(32)
        v *= np.uint64(0xD6E8FEB86659FD93)
        out[t, full] = np.minimum.reduceat((v >> np.uint64(32)).astype(np.uint32), at)
    return out


def _chosen(paths, tokens: int, threshold: float):
    """Which coordinates a node chooses: len(paths) x tokens, by a hash of path and coordinate."""
    import numpy as np

    limit = np.uint64(min((1 << 64) - 1, int((1 << 64) / (threshold * tokens))))
    salt = _mix(np.arange(1, tokens + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return _mix(paths[:, None] ^ salt[None, :]) < limit


def _child(path, coordinate, value):
    import numpy as np

    return _mix(_mix(path + np.uint64(0x632BE59BD9B4E019) * (coordinate.astype(np.uint64) + np.uint64(1))) ^ value.astype(np.uint64))


def text_key(text: str = "text") -> F.Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def _hashes(key: str = "key", id_: str = "doc_id") -> list[F.Column]:
    """Two hashes of a row's text and id."""
    return [F.xxhash64(key, id_).alias("h1"), F.xxhash64(F.lit(7), id_, key).alias("h2")]


class Filter:
    """A Bloom filter over pairs of hashes: four positions, of 2**log bits."""

    def __init__(self, words: bytes, log: int):
        self.words, self.log = words, log

    @classmethod
    def of(cls, hashes: DataFrame) -> "Filter":
        """Of the columns h1 and h2; combined before the shuffle, FILTER_BITS / 64 rows at most reach the driver."""
        import numpy as np

        log = 10
        rows = hashes.count()
        while 1 << log < min(FILTER_BITS, 16 * rows):
            log += 1
        mask = F.lit((1 << log) - 1)
        places = F.array(*(F.shiftrightunsigned(h, n).bitwiseAND(mask) for h in ("h1", "h2") for n in (0, 32)))
        at = hashes.select(F.explode(places).alias("p"))
        got = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b")).toArrow()
        words = np.zeros(1 << (log - 6), np.int64)
        words[got.column("w").to_numpy()] = got.column("b").to_numpy()
        del got
        give_back()
        return cls(words.tobytes(), log)

    def holds(self, h1, h2):
        import numpy as np

        words, out = np.frombuffer(self.words, np.uint64), np.ones(len(h1), bool)
        for h in (h1, h2):
            for n in (0, 32):
                p = (h.astype(np.int64).view(np.uint64) >> np.uint64(n)) & np.uint64((1 << self.log) - 1)
                out &= (words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return out


def _may_hold(filter_: Filter, spark):
    """A column function of (h1, h2): whether the filter may hold the row."""
    import pandas as pd

    shared = spark.sparkContext.broadcast((filter_.words, filter_.log))
    holds = Filter.holds

    def test(h1, h2):
        return pd.Series(holds(Filter(*shared.value), h1.to_numpy(), h2.to_numpy()))

    test.__annotations__ = dict.fromkeys(("h1", "h2", "return"), pd.Series)
    return F.pandas_udf(test, "boolean")


def records(docs: DataFrame, runs: int, tokens: int, threshold: float, width: int) -> DataFrame:
    """doc_id, key (128-bit hash of the text), size, paths (first-level nodes of all runs), sketch."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        shingle = Shingler(width)
        roots = _mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
        run_, coord = np.nonzero(_chosen(roots, tokens, threshold))
        for whole in batches:
            for b in text_slices(whole, "text", 4 << 20):
                texts = b.column(b.schema.get_field_index("text")).to_pylist()
                sets = [shingle(t) for t in texts]
                sketch = minhash(sets, tokens)
                size = np.array([len(s) for s in sets], np.int64)
                nodes = _child(roots[run_][:, None], coord[:, None], sketch[coord]).T.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(b.schema.get_field_index("doc_id")), b.column(b.schema.get_field_index("key")), pa.array(size),
                        pa.array([p if n else None for p, n in zip(nodes, size)], pa.list_(pa.int64())), pa.array([sketch[:, i].tobytes() if n else None for i, n in enumerate(size)], pa.binary()),
                    ],
                    names=["doc_id", "key", "size", "paths", "sketch"],
                )

    return docs.select("doc_id", "text", text_key().alias("key")).mapInArrow(run, f"doc_id {kind}, key binary, size long, paths array<long>, sketch binary")


def _split(nodes: DataFrame, tokens: int, threshold: float) -> DataFrame:
    """(path, doc, sketch) to the children (path, doc) of every node."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            path = b.column(b.schema.get_field_index("path")).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            sketch = np.frombuffer(b"".join(b.column(b.schema.get_field_index("sketch")).to_pylist()), np.uint32).reshape(-1, tokens)
            row, coord = np.nonzero(_chosen(path, tokens, threshold))
            got = _child(path[row], coord, sketch[row, coord]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(got), b.column(b.schema.get_field_index("doc")).take(pa.array(row))], names=["path", "doc"])

    return nodes.mapInArrow(run, f"path long, doc {nodes.schema['doc'].dataType.simpleString()}").select("doc", "path")


def _forest(a, b, n: int) -> list[int]:
    """Least member of each of ``n`` items' classes under the links (a[i], b[i])."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a, b):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def _compare(buckets: DataFrame, tokens: int, alike: float) -> DataFrame:
    """Star edges (src, dst) between texts of a node whose sketches agree on ``alike`` or more.

    Rows of a node come together, sorted; nodes are small by construction."""
    kind = buckets.schema["doc"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held = None

        def edges(table):
            path = table.column("path").to_numpy().astype(np.int64)
            doc = table.column("doc").to_pylist()
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint32).reshape(-1, tokens)
            cut = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1], [True]]))
            src, dst = [], []
            size = np.diff(cut)
            two = cut[:-1][size == 2]
            if len(two):
                ok = (sketch[two] == sketch[two + 1]).mean(1) >= alike
                for i in two[ok].tolist():
                    src.append(doc[i]), dst.append(doc[i + 1])
            for s, n in zip(cut[:-1][size > 2].tolist(), size[size > 2].tolist()):
                part = sketch[s : s + n]
                label = np.arange(n)
                for i in range(n - 1):
                    # texts already joined need no comparison: only classes matter here
                    other = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
                    if not len(other):
                        continue
                    same = other[(part[other] == part[i]).mean(1) >= alike]
                    if len(same):
                        joined = np.unique(np.append(label[same], label[i]))
                        label[np.isin(label, joined)] = joined[0]
                for i in np.flatnonzero(label != np.arange(n)).tolist():
                    src.append(doc[s + i]), dst.append(doc[s + int(label[i])])
            return pa.RecordBatch.from_arrays([pa.array(src, table.schema.field("doc").type), pa.array(dst, table.schema.field("doc").type)], names=["src", "dst"])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            last = t.column("path")[-1].as_py()
            path = t.column("path").to_numpy()
            done = int(np.searchsorted(path, last, "left"))
            held = t.slice(done)
            if done:
                yield edges(t.slice(0, done))
            give_back()
        if held is not None and held.num_rows:
            yield edges(held)
        held = None
        give_back()

    by_path = buckets.select("path", "doc", "sketch").repartition("path").sortWithinPartitions("path", "doc")
    return by_path.mapInArrow(run, f"src {kind}, dst {kind}")


def candidate_edges(rec: DataFrame, tokens: int, threshold: float, bucket: int, depth: int, alike: float) -> DataFrame:
    """Star edges of all nodes of all runs; ``rec``: doc, paths, sketch."""
    frontier, found = rec.where("paths is not null").select("doc", F.explode("paths").alias("path")), []
    for level in range(1, depth + 1):
        frontier = stored(frontier, "paths")
        # stored, so that the join with the hot nodes' rows is one that AQE can split
        sizes = stored(frontier.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
        placed = stored(frontier.join(sizes, "path"), "nodes")
        found.append(placed.where(F.col("n") <= bucket).select("path", "doc"))
        large = placed.where(F.col("n") > bucket)
        if large.isEmpty():
            break
        if level == depth:  # groups of close texts that tokens hardly split: tiles of pairs of blocks
            half = max(1, bucket // 2)
            blocks = F.ceil(F.col("n") / half).cast("int")
            mine = F.pmod(F.xxhash64("doc"), blocks).cast("int")
            other = large.select("doc", "path", mine.alias("i"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j"))
            found.append(other.select(F.xxhash64("path", F.least("i", "j"), F.greatest("i", "j")).alias("path"), "doc"))
            break
        frontier = _split(large.join(rec.select("doc", "sketch"), "doc").select("path", "doc", "sketch"), tokens, threshold)
    every = found[0]
    for f in found[1:]:
        every = every.unionAll(f)
    return stored(_compare(every.join(rec.select("doc", "sketch"), "doc"), tokens, alike), "alike").distinct()


def _shared_counts(a: list, b: list):
    """len(a) x len(b) sizes of intersections of sorted arrays.

    Tokens of few sets are counted pair by pair, tokens of many by a product of 0-1 matrices."""
    import numpy as np

    out = np.zeros((len(a), len(b)), np.float32)
    ta, tb = np.concatenate(a), np.concatenate(b)
    ra, rb = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    both = np.intersect1d(ta, tb)
    if not len(both):
        return out.astype(np.int64)
    ia, ib = np.searchsorted(both, ta), np.searchsorted(both, tb)
    ka, kb = both[np.minimum(ia, len(both) - 1)] == ta, both[np.minimum(ib, len(both) - 1)] == tb
    ia, ra, ib, rb = ia[ka], ra[ka], ib[kb], rb[kb]
    na, nb = np.bincount(ia, minlength=len(both)), np.bincount(ib, minlength=len(both))
    many = np.flatnonzero(na * nb > 64)
    slot = np.full(len(both), -1, np.int64)
    for c in range(0, len(many), 4096):
        slot[:] = -1
        cols = many[c : c + 4096]
        slot[cols] = np.arange(len(cols))
        xa, xb = np.zeros((len(a), len(cols)), np.float32), np.zeros((len(b), len(cols)), np.float32)
        sa, sb = slot[ia], slot[ib]
        xa[ra[sa >= 0], sa[sa >= 0]] = 1
        xb[rb[sb >= 0], sb[sb >= 0]] = 1
        out += xa @ xb.T
    few = na * nb <= 64
    fa, fb = few[ia], few[ib]
    ia, ra, ib, rb = ia[fa], ra[fa], ib[fb], rb[fb]
    oa, ob = np.argsort(ia, kind="stable"), np.argsort(ib, kind="stable")
    ia, ra, ib, rb = ia[oa], ra[oa], ib[ob], rb[ob]
    lo, hi = np.searchsorted(ib, ia, "left"), np.searchsorted(ib, ia, "right")
    reps = hi - lo
    if reps.sum():
        left = np.repeat(ra, reps)
        right = rb[np.repeat(lo - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps) + np.arange(reps.sum())]
        np.add.at(out, (left, right), 1)
    return out.round().astype(np.int64)


def _block_roots(ok, l, r):
    """Least index of each row's and column's class under the links of one block."""
    import numpy as np

    least_l, least_r = l.copy(), r.copy()
    far = np.iinfo(np.int64).max
    while True:
        new_l = np.minimum(least_l, np.where(ok, least_r[None, :], far).min(1))
        new_r = np.minimum(least_r, np.where(ok, new_l[:, None], far).min(0))
        both = dict(zip(l.tolist(), new_l.tolist()))
        for i, x in zip(r.tolist(), new_r.tolist()):
            both[i] = min(both.get(i, x), x)
        new_l, new_r = np.array([both[i] for i in l.tolist()]), np.array([both.get(i, far) for i in r.tolist()])
        if (new_l == least_l).all() and (new_r == least_r).all():
            return new_l, new_r
        least_l, least_r = new_l, new_r


def _verify(tiles: DataFrame, threshold: float, tile: int) -> DataFrame:
    """(doc, links, root): exact links of each text inside a tile and its least linked class member.

    ``tiles``: key, diagonal, side, doc, shingles (binary); sorted rows of a key come together."""
    kind = tiles.schema["doc"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def solve(rows, diagonal):
            docs, sides, sets = rows
            sets = [np.frombuffer(x, np.uint64) for x in sets]
            out_doc, out_n, out_root = [], [], []
            left = list(range(len(docs))) if diagonal else [i for i, s in enumerate(sides) if s == 0]
            right = left if diagonal else [i for i, s in enumerate(sides) if s == 1]
            links = np.zeros(len(docs), np.int64)
            a, b = [], []
            # blocks are dealt by hash, so a side may exceed ``tile``: cut it here, every pair still met
            for x in range(0, len(left), tile):
                for y in range(x if diagonal else 0, len(right), tile):
                    l, r = np.array(left[x : x + tile]), np.array(right[y : y + tile])
                    inter = _shared_counts([sets[i] for i in l], [sets[i] for i in r])
                    sl, sr = np.array([len(sets[i]) for i in l]), np.array([len(sets[i]) for i in r])
                    ok = inter >= threshold * (sl[:, None] + sr[None, :] - inter) - 1e-9
                    if diagonal and x == y:
                        ok &= np.triu(np.ones(ok.shape, bool), 1)
                    if not ok.any():
                        continue
                    np.add.at(links, l, ok.sum(1))
                    np.add.at(links, r, ok.sum(0))
                    root_l, root_r = _block_roots(ok, l, r)
                    a.extend(l.tolist()), b.extend(root_l.tolist())
                    a.extend(r.tolist()), b.extend(root_r.tolist())
            for i, root in enumerate(_forest(a, b, len(docs))):
                if links[i]:
                    out_doc.append(docs[i]), out_n.append(int(links[i])), out_root.append(docs[root])
            t = pa_type
            return pa.RecordBatch.from_arrays([pa.array(out_doc, t), pa.array(out_n, pa.int64()), pa.array(out_root, t)], names=["doc", "links", "root"])

        key, diagonal, rows = None, None, ([], [], [])
        for b in batches:
            pa_type = b.column(b.schema.get_field_index("doc")).type
            sets = b.column(b.schema.get_field_index("shingles"))  # copied row by row, for one tile at a time
            for i, (k, g, s, d) in enumerate(zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("key", "diagonal", "side", "doc")))):
                if k != key and rows[0]:
                    yield solve(rows, diagonal)
                    rows = ([], [], [])
                key, diagonal = k, g
                rows[0].append(d), rows[1].append(s), rows[2].append(sets[i].as_py())
            give_back()
        if rows[0]:
            yield solve(rows, diagonal)
        rows = ([], [], [])
        give_back()

    return tiles.repartition("key").sortWithinPartitions("key", "side", "doc").mapInArrow(run, f"doc {kind}, links long, root {kind}")


def _shingles(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """doc (number), shingles of the texts of ``members`` (key, rep_id, doc): one row of ``docs`` each."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    pairs = members.select(*_hashes("key", "rep_id"))
    filter_ = Filter.of(pairs)
    shared = docs.sparkSession.sparkContext.broadcast((filter_.words, filter_.log))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        shingle, may = Shingler(width), Filter(*shared.value)
        for whole in batches:
            hit = may.holds(*(whole.column(whole.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("h1", "h2")))
            for b in text_slices(whole.take(pa.array(np.flatnonzero(hit))), "text", 4 << 20):
                got = [shingle(t).tobytes() for t in b.column(b.schema.get_field_index("text")).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in ("doc_id", "key")), pa.array(got, pa.binary())], names=["doc_id", "key", "shingles"])

    rows = docs.select("doc_id", "text", text_key().alias("key")).select("doc_id", "text", "key", *_hashes())
    made = rows.mapInArrow(run, f"doc_id {kind}, key binary, shingles binary")
    # of rows repeated with id and text one is enough
    found = made.join(members.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("rep_id")))
    return found.select("doc", "shingles").dropDuplicates(["doc"])


def _tiles(sized: DataFrame, threshold: float, tile: int) -> DataFrame:
    """doc and the tiles it lies in: key, diagonal, side.  ``sized``: doc, comp, size.

    Sets of which one is smaller than ``threshold`` times the other cannot link, so a text meets its own
    size class and the next ones only."""
    step = math.log(1 / threshold) * (1 + 1e-6) if threshold < 1 else 1e-6
    of = sized.withColumn("s", F.floor(F.log(F.greatest("size", F.lit(1))) / F.lit(step)))
    sizes = of.groupBy("comp", "s").agg(F.count("*").alias("n"), F.sum(F.col("size") * 8).alias("bytes"))
    sizes = sizes.withColumn("b", F.greatest(F.ceil(F.col("n") / tile), F.ceil(F.col("bytes") / TILE_BYTES)).cast("int"))
    w = Window.partitionBy("comp").orderBy("s")
    beside = lambda f, d: F.coalesce(F.when(f("s").over(w) == F.col("s") + d, f("b").over(w)), F.lit(0))
    sizes = stored(sizes.select(F.col("comp").alias("c"), F.col("s").alias("z"), "b", beside(F.lead, 1).alias("up"), beside(F.lag, -1).alias("down")), "size-classes")
    mine = of.join(sizes, (F.col("comp") == F.col("c")) & (F.col("s") == F.col("z"))).withColumn("h", F.pmod(F.xxhash64("doc"), "b").cast("int"))
    key = lambda *x: F.concat_ws(":", *(F.col(c) if isinstance(c, str) else c for c in x))
    upto = lambda n, f: F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col(n) - 1)), lambda j: F.col(n) > 0), f)
    at = lambda k, diagonal, side: F.struct(k.alias("key"), diagonal.alias("diagonal"), side.cast("int").alias("side"))
    no = F.lit(False)
    same = upto("b", lambda j: at(key("comp", "s", F.least("h", j), "s", F.greatest("h", j)), F.col("h") == j, F.col("h") > j))
    above = upto("up", lambda j: at(key("comp", "s", "h", F.col("s") + 1, j), no, F.lit(0)))
    below = upto("down", lambda j: at(key("comp", F.col("s") - 1, j, "s", "h"), no, F.lit(1)))
    return mine.select("doc", F.explode(F.concat(same, above, below)).alias("t")).select("doc", "t.key", "t.diagonal", "t.side")


def _classes(docs: DataFrame, threshold: float, width: int, recall: float, tokens: int, levels: int, depth: int, bucket: int, tile: int, slack: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, key, doc, rep_id) of every row, (key, rep_id, doc) of every text, and (doc, class, n_links) of those that link.

    doc: the number of a text; class: the least number among the texts linked to it."""
    rec = stored(records(docs, runs_for(recall, levels, tokens), tokens, threshold, width), "sketches")
    reps = rec.groupBy("key").agg(F.min("doc_id").alias("rep_id"))
    reps = stored(reps.withColumn("doc", F.monotonically_increasing_id()), "reps")  # stored: numbers stay, and AQE splits a hot text
    named = stored(rec.select("doc_id", "key").join(reps, "key"), "named")
    right = reps.withColumnRenamed("key", "k")
    texts = rec.join(right, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))).select("doc", "size", "paths", "sketch").dropDuplicates(["doc"])
    texts = stored(texts, "texts")
    edges = candidate_edges(texts, tokens, threshold, bucket, depth, threshold - slack)
    comp = stored(components(edges).select(F.col("node").alias("doc"), F.col("component").alias("comp")), "groups")
    sized = stored(comp.join(texts.select("doc", "size"), "doc"), "sized")
    members = stored(sized.select("doc").join(reps, "doc"), "members")
    sets = stored(_shingles(docs, members, width), "sets")
    tiles = _tiles(sized, threshold, tile).join(sets, "doc").select("key", "diagonal", "side", "doc", "shingles")
    linked = stored(_verify(tiles, threshold, tile), "links")
    counts = linked.groupBy("doc").agg(F.sum("links").alias("n_links"))
    classes = components(linked.select(F.col("doc").alias("src"), F.col("root").alias("dst"))).select(F.col("node").alias("doc"), F.col("component").alias("class"))
    return named, reps, stored(counts.join(classes, "doc"), "classes")


def similarity_join(docs: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE, recall: float = 0.999, tokens: int = 64, levels: int = 3, depth: int = 8, bucket: int = 2048, tile: int = 512, slack: float = 0.22) -> DataFrame:
    """doc_id, rep_id, class_id, n_links for every row of ``docs``.

    rep_id: the least id of the rows with the same text; class_id: the least rep_id of the texts
    linked to it, directly or over others; n_links: how many different texts it links to."""
    named, reps, found = _classes(docs, threshold, width, recall, tokens, levels, depth, bucket, tile, slack)
    least = stored(found.join(reps, "doc").groupBy("class").agg(F.min("rep_id").alias("class_id")), "class-ids")
    of = stored(found.join(least, "class").select("doc", "class_id", "n_links", F.lit(True).alias("linked")), "linked")
    got = named.join(of, "doc", "left")
    return got.select("doc_id", "rep_id", F.when(F.col("linked"), F.col("class_id")).otherwise(F.col("rep_id")).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE, recall: float = 0.999, tokens: int = 64, levels: int = 3, depth: int = 8, bucket: int = 2048, tile: int = 512, slack: float = 0.22) -> DataFrame:
    """One row of each class: of the text of the least rep_id (then of the least MD5; texts without an
    id last), the row of that id; of rows equal in id and text one stays."""
    named, reps, found = _classes(docs, threshold, width, recall, tokens, levels, depth, bucket, tile, slack)
    rows = stored(named.groupBy("key", "doc_id", "rep_id", "doc").agg(F.count("*").alias("n")), "rows")
    best = found.join(reps, "doc").groupBy("class").agg(F.min(F.struct(F.col("rep_id").isNull().alias("no_id"), "rep_id", "key", "doc")).alias("b"))
    lose = stored(found.join(best, "class").where("doc <> b.doc").select("doc"), "losers").withColumn("lost", F.lit(True))
    fate = rows.join(lose, "doc", "left").select(F.col("key").alias("__k"), F.col("doc_id").alias("__id"), (F.col("lost").isNotNull() | ~F.col("doc_id").eqNullSafe(F.col("rep_id"))).alias("__drop"), (F.col("n") > 1).alias("__again"))
    fate = stored(fate.where("__drop or __again"), "fate")
    # only rows that the filter lets through meet the exact table; the others stay where they are
    may = _may_hold(Filter.of(fate.select(*_hashes("__k", "__id"))), docs.sparkSession)
    private = docs.select("*", text_key().alias("__key"))
    private = private.select("*", may(*_hashes("__key", "doc_id")).alias("__may"))
    met = private.where("__may").join(fate, (F.col("__key") == F.col("__k")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    own = [F.col(f"`{c}`") for c in docs.columns]
    left = private.where("not __may").select(*own).unionAll(met.where("__drop is null").select(*own))
    if fate.where("__again and not __drop").isEmpty():
        return left
    return left.unionAll(met.where("__again and not __drop").dropDuplicates(["__key", "doc_id"]).select(*own))
