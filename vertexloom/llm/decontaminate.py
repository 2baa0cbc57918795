"""Benchmark decontamination by suffix arrays of the training text.

Every shard (a slice of a partition, bounded in bytes) becomes one array of word numbers.  Its runs
of benchmark words, as far as they reach the shortest window, are sorted into a true suffix array by
prefix doubling, together with the test items, whose suffixes so get an order among the shard's.
Every test suffix is binary-searched there: the suffixes beside its place give its longest verbatim
match and where that is, the range equal in a window's words gives all places of the window.  Shards
need nothing of each other, so nothing is shuffled.

Words are runs of 0-9, a-z and code points from 128 on, after lower-casing A-Z.  A window is
``width`` consecutive words of an item; a shorter, non-empty item is one window.  ``longest`` is the
longest verbatim match with any item that begins at a place of a window: the first such place and,
of items alike there, the last name.

Items go to the tasks in blocks of ``block_bytes`` of text, each broadcast by itself; the driver and
a task hold one block at a time, and a task matches a slice with all blocks before the next slice.
Defined cases: null or empty text: no words, nothing hit; null or empty items never occur; a null
item_id is named ``""``; items sharing an id count once; repeated rows come back repeatedly; an empty
benchmark hits nothing; clashing columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shielded, text_slices

WIDTH = 8
RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())), T.StructField("longest", T.LongType()), T.StructField("longest_start", T.LongType()), T.StructField("longest_item", T.StringType()),
])
_table = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_table).split() if text else []


class Items:
    """A block of test items: their words numbered from 1, items closed by a 0, and the windows."""

    def __init__(self, rows: list[tuple[str, str]], width: int = WIDTH):
        import numpy as np

        self.ids: dict[bytes, int] = {}
        self.names: list[str] = []
        numbers: list[int] = []
        at, sizes, owners = [], [], []
        for name, text in rows:
            w = [self.ids.setdefault(x, len(self.ids) + 1) for x in words_of(text)]
            if not w:
                continue
            size = min(width, len(w))
            at.extend(range(len(numbers), len(numbers) + len(w) - size + 1))
            sizes.extend([size] * (len(w) - size + 1))
            owners.extend([len(self.names)] * (len(w) + 1))
            self.names.append(name)
            numbers.extend([*w, 0])
        self.numbers = np.array(numbers, np.int64)
        self.owner = np.array(owners, np.int64)  # of each place of numbers
        self.at, self.size = np.array(at, np.int64), np.array(sizes, np.int64)  # of each window
        self.shortest = min(sizes, default=0)


class SuffixOrder:
    """Ranks of all suffixes of ``numbers`` by their first 1, 2, 4, ... numbers; a 0 ends a suffix."""

    def __init__(self, numbers):
        import numpy as np

        n = len(numbers)
        zero = np.flatnonzero(numbers == 0)
        #: numbers from each place to the end of its suffix
        self.left = zero[np.searchsorted(zero, np.arange(n))] - np.arange(n)
        rank = np.unique(numbers, return_inverse=True)[1].astype(np.int64)  # the 0 gets rank 0
        self.ranks, step = [rank], 1
        longest = int(self.left.max(initial=0))
        while step < longest:
            rank = np.unique(self._key(np.arange(n), len(self.ranks) - 1, step), return_inverse=True)[1].astype(np.int64)
            self.ranks.append(rank)
            step *= 2

    def _key(self, at, level: int, further: int):
        """The rank of a place with that of the place ``further`` on: ordered like both together."""
        import numpy as np

        rank = self.ranks[level]
        second = np.where(self.left[at] > further, rank[np.minimum(at + further, len(rank) - 1)], 0)
        return rank[at] * (len(rank) + 1) + second

    def key(self, at, words: int):
        """Numbers ordered and equal as the first ``words`` numbers of the suffixes at ``at`` are."""
        level = min(words.bit_length() - 1, len(self.ranks) - 1)
        return self._key(at, level, words - (1 << level))

    def common(self, a, b):
        """Length of the longest common start of the suffixes at ``a`` and ``b``, pair by pair."""
        import numpy as np

        a, b = a.copy(), b.copy()
        found = np.zeros(len(a), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            step, rank = 1 << level, self.ranks[level]
            same = (rank[a] == rank[b]) & (self.left[a] >= step) & (self.left[b] >= step)
            a[same] += step
            b[same] += step
            found[same] += step
        return found


def _neighbours(order: SuffixOrder, ours, queries):
    """Best common start of each of ``queries`` with the sorted suffixes ``ours``, and its place in ``ours``."""
    import numpy as np

    rank = order.ranks[-1]
    pos = np.searchsorted(rank[ours], rank[queries])
    low, high = np.maximum(pos - 1, 0), np.minimum(pos, len(ours) - 1)
    a, b = order.common(queries, ours[low]), order.common(queries, ours[high])
    return np.maximum(a, b), np.where(b >= a, high, low)


def match_shard(texts: list[str | None], items: Items):
    """Per text: n_words, merged hit spans, item names, and the longest match (length, start, item)."""
    import numpy as np

    get = items.ids.get
    parts, starts, at = [], [], 0
    for t in texts:
        w = words_of(t)
        parts.append(np.fromiter((get(x, 0) for x in w), np.int64, len(w)))
        starts.append(at)
        at += len(w) + 1  # a 0 between texts
    out = [(len(p), [], [], 0, None, None) for p in parts]
    if not items.names or not at:
        return out
    numbers = np.zeros(at, np.int64)
    for s, p in zip(starts, parts):
        numbers[s : s + len(p)] = p
    # runs of item words that can hold a window, each closed by its 0
    zero = np.flatnonzero(numbers == 0)
    begin = np.concatenate([[0], zero[:-1] + 1])
    long_enough = zero - begin >= items.shortest
    mark = np.zeros(at + 1, np.int64)
    mark[begin[long_enough]] += 1
    mark[zero[long_enough] + 1] -= 1
    where = np.flatnonzero(np.cumsum(mark[:-1]))  # place in the shard of each number that is left
    if not len(where):
        return out
    base = len(where)
    order = SuffixOrder(np.concatenate([numbers[where], items.numbers]))
    rank = order.ranks[-1]
    train = np.flatnonzero(order.left[:base])
    array = train[np.argsort(rank[train], kind="stable")]  # the suffix array
    test = base + np.flatnonzero(items.numbers)
    # binary search of every test suffix; one whose longest match is short of its window has no place
    best = np.zeros(len(items.numbers), np.int64)
    best[test - base] = _neighbours(order, array, test)[0]
    live = best[items.at] >= items.size
    window_at, size = items.at[live], items.size[live]
    first = np.array(starts, np.int64)
    on = np.zeros(at + 1, np.int64)
    held: dict[int, set[int]] = {}
    places = []
    for k in np.unique(size).tolist():
        mine = window_at[size == k]
        keys, wanted = order.key(array, k), order.key(mine + base, k)
        wanted, group = np.unique(wanted, return_inverse=True)
        by_group = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[by_group], np.arange(len(wanted) + 1))
        low, high = np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, "right")
        for g, (a, b) in enumerate(zip(low.tolist(), high.tolist())):
            # once for all items that share the window
            there = where[array[a:b]]
            owners = set(items.owner[mine[by_group[cuts[g] : cuts[g + 1]]]].tolist())
            for d in np.unique(np.searchsorted(first, there, "right") - 1).tolist():
                held.setdefault(d, set()).update(owners)
            on[there] += 1
            on[there + k] -= 1
            places.append(array[a:b])
    if not places:
        return out
    on = np.concatenate([np.cumsum(on)[:-1] > 0, [False]])
    edge = np.flatnonzero(np.diff(np.concatenate([[False], on]).astype(np.int8)))
    span_doc = np.searchsorted(first, edge[::2], "right") - 1
    # the other way about, every hit place among the test suffixes gives the longest match from there
    hit = np.unique(np.concatenate(places))
    sorted_test = test[np.argsort(rank[test], kind="stable")]
    length, beside = _neighbours(order, sorted_test, hit)
    hit_doc = np.searchsorted(first, where[hit], "right") - 1
    top = np.lexsort((hit, -length, hit_doc))
    top = top[np.unique(hit_doc[top], return_index=True)[1]]
    spans: dict[int, list[dict]] = {}
    for d, a, b in zip(span_doc.tolist(), edge[::2].tolist(), edge[1::2].tolist()):
        spans.setdefault(d, []).append({"start": a - starts[d], "length": b - a})
    for n in np.unique(length[top]).tolist():
        keys = order.key(sorted_test, n)
        for i in top[length[top] == n].tolist():
            d, key = int(hit_doc[i]), keys[beside[i]]
            alike = sorted_test[np.searchsorted(keys, key) : np.searchsorted(keys, key, "right")]
            who = max(items.names[o] for o in np.unique(items.owner[alike - base]).tolist())
            out[d] = (len(parts[d]), spans[d], sorted({items.names[o] for o in held[d]}), n, int(where[hit[i]]) - starts[d], who)
    return out


def _merge(x: tuple, y: tuple) -> tuple:
    """Results of one text against two blocks of items."""
    n, spans, names, long_, at, who = y
    joined: list[list[int]] = []
    for a, b in sorted((s["start"], s["start"] + s["length"]) for s in [*x[1], *spans]):
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    best = max((r for r in (x, y) if r[3]), key=lambda r: (r[3], -r[4], r[5]), default=x)
    return n, [{"start": a, "length": b - a} for a, b in joined], sorted({*x[2], *names}), *best[3:]


def item_blocks(benchmark: DataFrame, block_bytes: int = 8 << 20, width: int = WIDTH):
    """The benchmark in blocks of at most ``block_bytes`` of text (one item at least), read one at a time."""
    rows, size = [], 0
    for r in benchmark.where("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), "text").toLocalIterator():
        if rows and size + len(r.text) > block_bytes:
            yield Items(rows, width)
            rows, size = [], 0
        rows.append((r.i, r.text))
        size += len(r.text)
    yield Items(rows, width)


def find_matches(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, text: str = "text", width: int = WIDTH, block_bytes: int = 8 << 20, shard_bytes: int = 8 << 20) -> DataFrame:
    """The columns ``keep`` of every row with RESULT: word count, hit spans, items and longest match."""
    names = [f.name for f in RESULT]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    rows = docs.select(*dict.fromkeys([*keep, text]))
    schema = T.StructType([rows.schema[c] for c in keep] + list(RESULT))
    # plain values: executors need no copy of the class; the handles keep none of them on the driver
    shared = [docs.sparkSession.sparkContext.broadcast(vars(items)) for items in item_blocks(benchmark, block_bytes, width)]

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kinds, block = [to_arrow_type(f.dataType) for f in RESULT], Items([])
        for whole in batches:
            for b in text_slices(whole, text, shard_bytes):
                texts, got = b.column(b.schema.get_field_index(text)).to_pylist(), None
                for one in shared:
                    vars(block).update(one.value)
                    if len(shared) > 1 and hasattr(one, "_path"):
                        vars(one).pop("_value", None)  # read again for the next slice, from the executor's copy
                    new = match_shard(texts, block)
                    got = new if got is None else [_merge(x, y) for x, y in zip(got, new)]
                cols = [b.column(b.schema.get_field_index(c)) for c in keep] + [pa.array([g[i] for g in got], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *names])

    return rows.mapInArrow(run, schema)


def contaminated(min_items: int = 2):
    return F.size("items") >= min_items


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_items: int = 2, **how) -> DataFrame:
    """The rows of ``docs`` that hold windows of fewer than ``min_items`` items, with its columns."""
    safe, back = shielded(docs, [f.name for f in RESULT])
    return find_matches(safe, benchmark, **how).where(~contaminated(min_items)).select(*back)
