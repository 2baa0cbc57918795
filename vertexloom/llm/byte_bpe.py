"""Byte-level BPE encoding and decoding.

Every word (match of the split pattern) is spelt in bytes and folded by Spark higher-order functions:
a step merges the neighbours of the lowest rank, looked up in a literal rank map (pairs of numbered
pieces in a perfect hash of two arrays, because a map look-up is a scan), until none is left.  Words of
any length and count go this way:

1. *Dictionary*: the distinct words of every slice of text are counted over the slices; the words
   found in most slices (``max_words`` at most, so that it can be broadcast) are folded once for all.
2. *Ask*: every task numbers, slice by slice, the words of its texts (first the dictionary's, then its
   own) and lists the distinct words that neither the dictionary nor an earlier slice of the task
   holds; they ride on the slice's first row.
3. *Fold*: the same higher-order functions fold them, in the same task.
4. *Spell*: the ids of all words of a slice are put in the texts' order by Arrow kernels, by the words'
   numbers.  Decoding concatenates the pieces' bytes.

Texts are read twice (dictionary, encoding), split once each time and never shuffled; only (word,
slices) is.  From the splitting to the spelling a text is four bytes a word.

Words of more than LONG bytes merge all places of the lowest rank in one step, from left to right.
That is the same as one by one unless a merged piece joins a neighbour (or the start of the next
place) at a still lower rank; then one place is merged in that step.

Defined cases: null text is the empty text (no ids, empty bytes); ids outside the vocabulary are
an error on decoding; repeated rows come back repeatedly; an empty table gives an empty result;
a column that clashes with a result's (``ids``, ``decoded``) is replaced by it.
"""

from __future__ import annotations

import functools
import json
import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, give_back_driver, stored, text_slices

MAPS = 4096
LONG = 64
#: bits of a place in a word of LONG bytes at most
PLACE = 7
#: bytes of text whose words are listed at a time, for the dictionary and for encoding
COUNT_SLICE = 8 << 20
SLICE = 2 << 20
#: words asked for in a task after which it forgets them and asks anew
ASKED = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(8)
def explicit_pattern(pattern: str) -> str:
    r"""``pattern`` with \p{L}, \p{N}, \s and \S as explicit sets, for the standard library's matcher.

    Made once on the driver; tasks compile the string, which the matcher keeps per process."""
    import sys
    import unicodedata

    def spans(test) -> str:
        out, start = [], None
        for c in range(sys.maxunicode + 2):
            if c <= sys.maxunicode and test(c):
                start = c if start is None else start
            elif start is not None:
                out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
                start = None
        return "".join(out)

    white = {*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
    sets = {r"\p{L}": spans(lambda c: unicodedata.category(chr(c))[0] == "L"), r"\p{N}": spans(lambda c: unicodedata.category(chr(c))[0] == "N"), r"\s": spans(white.__contains__)}
    out, inside, i = [], False, 0
    while i < len(pattern):
        token = next((t for t in (*sets, r"\S") if pattern.startswith(t, i)), None)
        if token is None:
            step = 2 if pattern[i] == "\\" else 1
            inside = {"[": True, "]": False}.get(pattern[i], inside) if step == 1 else inside
            out.append(pattern[i : i + step])
            i += step
        else:
            body = sets[r"\s"] if token == r"\S" else sets[token]
            out.append(body if inside and token != r"\S" else f"[{'^' if token == chr(92) + 'S' else ''}{body}]")
            i += len(token)
    return "".join(out)


# --- folding -------------------------------------------------------------------------------------


class Pairs:
    """The ranked merges in numbers: a piece is its place in the order of ranks, from 1 on.

    ``slots`` is a perfect hash of all pairs of pieces whose joined bytes are a piece: the pair (a, b) with key
    k = a << bits | b can only be at slots[(k + shifts[k % len(shifts)]) % len(slots)], which holds
    k << bits | number of the joined piece (0: nobody), so a look-up is two array reads whatever the size of the vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        import random

        self.pieces = sorted(ranks, key=ranks.get)
        self.ids = [ranks[x] for x in self.pieces]
        number = {x: i for i, x in enumerate(self.pieces, 1)}
        for i in range(256):  # a byte without a rank can still be part of a piece
            number.setdefault(bytes([i]), len(number) + 1)
        self.bytes = [number[bytes([i])] for i in range(256)]
        self.none = len(number) + 1
        self.bits = self.none.bit_length()
        if 3 * self.bits > 63:
            raise ValueError("a vocabulary of 2 million pieces or more")
        self.joined = {}
        for x in self.pieces:
            for i in range(1, len(x)):
                left, right = number.get(x[:i]), number.get(x[i:])
                if left and right:
                    self.joined[left << self.bits | right] = number[x]
        keys, n = list(self.joined), max(1, len(self.joined) // 4)
        m = len(keys) * 5 // 4 + 2
        while len({(k % n, k % m) for k in keys}) < len(keys):
            m += 1
        dealt: list[list[int]] = [[] for _ in range(n)]
        for k in keys:
            dealt[k % n].append(k)
        self.slots, self.shifts = [0] * m, [0] * n
        g, used = random.Random(8), bytearray(m)
        for at in sorted(range(n), key=lambda i: -len(dealt[i])):
            places = [k % m for k in dealt[at]]
            shift = next(d for d in iter(lambda: g.randrange(m), -1) if not any(used[(x + d) % m] for x in places))
            self.shifts[at] = shift
            for k, x in zip(dealt[at], places):
                used[(x + shift) % m] = 1
                self.slots[(x + shift) % m] = k << self.bits | self.joined[k]

    def unreached(self) -> dict[str, int]:
        """Pieces that merging their bytes does not give, with their ids; a word that equals one is taken whole."""
        out, never = {}, self.none
        for i, x in enumerate(self.pieces, 1):
            part = [self.bytes[c] for c in x]
            while len(part) > 1:
                near = [self.joined.get(a << self.bits | b, never) for a, b in zip(part, part[1:])]
                low = min(near)
                if low == never:
                    break
                at = near.index(low)
                part[at : at + 2] = [low]
            if part != [i]:
                try:
                    out[x.decode()] = self.ids[i - 1]
                except UnicodeDecodeError:  # no whole word
                    pass
        return out


@functools.lru_cache(2)
def _literals(ranks: tuple[tuple[bytes, int], ...]) -> tuple[Pairs, str, str, str, str]:
    pairs = Pairs(dict(ranks))
    whole: list[dict[str, int]] = [{} for _ in range(MAPS)]
    unreached = pairs.unreached()
    for w, v in unreached.items():
        whole[zlib.crc32(w.encode()) % MAPS][w] = v
    plain = pairs.ids == list(range(len(pairs.ids)))
    return pairs, *(json.dumps(x, separators=(",", ":")) for x in (pairs.slots, pairs.shifts, [] if plain else pairs.ids, whole if unreached else []))


def _let(value: F.Column, body) -> F.Column:
    """``body`` of ``value``, evaluated once: the end of a fold over nothing, which copies neither."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda a, _: a, body)


def fold_words(words: F.Column, ranks: dict[bytes, int]) -> F.Column:
    """array<string> of words to array<array<int>> of their ids.

    A word is one array of longs: joined << (bits + PLACE) | place << bits | number for every piece, ``joined``
    being what it and the next piece join to (1 << bits: nothing), so the least long is the first place of the lowest rank."""
    pairs, *texts = _literals(tuple(ranks.items()))
    bits, top = pairs.bits, pairs.bits + PLACE
    long = lambda x: F.lit(x).cast("long")
    none, over, idle, pad = (long(x) for x in (pairs.none, 1 << bits, 1 << bits << top, 1 << bits << top | pairs.none))
    n_slots, n_shifts = long(len(pairs.slots)), long(len(pairs.shifts))
    number = lambda x: x.bitwiseAND(long((1 << bits) - 1))
    low = lambda x: x.bitwiseAND(long((1 << top) - 1))
    place = lambda x: x.bitwiseAND(long((1 << top) - (1 << bits)))
    joined = lambda x: F.shiftright(x, top)
    tables = [F.from_json(F.lit(x), t) for x, t in zip(texts, ("array<bigint>", "array<int>", "array<int>", "array<map<string,int>>"))]
    alphabet = F.from_json(F.lit(json.dumps(pairs.bytes)), "array<bigint>")
    plain, some_unreached = texts[2] == "[]", texts[3] != "[]"

    def folded(slots, shifts, named, whole, alphabet):
        def look(a, b):
            """number of what two pieces join to, or ``over``"""
            return _let(F.shiftleft(a, bits).bitwiseOR(b), lambda k: F.least(slots[(k + shifts[k % n_shifts]) % n_slots].bitwiseXOR(F.shiftleft(k, bits)), over))

        def entry(x, b):
            """place and number ``x`` before the piece ``b``"""
            return F.shiftleft(look(number(x), b), top).bitwiseOR(x)

        def number_at(e, i):
            return number(F.coalesce(F.get(e, i), none))

        def one(e, i, m):
            """merge place ``i`` to ``m``; the array keeps its length"""

            def at(x, t):
                moved = F.when(t > i, F.coalesce(F.get(e, t + 1), pad)).when(t + 1 < i, x)
                return moved.when(t < i, entry(low(x), m)).otherwise(entry(place(x).bitwiseOR(m), number_at(e, t + 2)))

            return F.transform(e, at)

        def first(e, least):
            return _let((F.array_position(e, least) - 1).cast("int"), lambda i: _let(joined(least), lambda m: one(e, i, m)))

        def every(e, m):
            """merge all places of the lowest rank, from left to right, if that equals one by one"""
            chosen = F.split(F.replace(F.array_join(F.transform(e, lambda x: F.when(joined(x) == m, "1").otherwise("0")), ""), F.lit("11"), F.lit("10")), "")

            def merged(s, k):
                new = F.transform(k, lambda i: F.when(F.get(s, i) == "1", m).otherwise(number(F.get(e, i))))
                hit = lambda t: F.coalesce(F.get(s, F.get(k, t)) == "1", F.lit(False))
                ranked = lambda q: F.transform(k, lambda i, t: F.when(hit(t) | hit(t + 1), entry(F.get(q, t), number_at(q, t + 1))).otherwise(F.get(e, i)))
                # a merged piece and the start of a place right behind it
                apart = F.forall(k, lambda i: F.when((F.get(s, i) == "1") & (F.get(s, i + 2) == "1"), look(m, number_at(e, i + 2)) > m).otherwise(True))
                by_one = lambda: one(e, (F.array_position(s, F.lit("1")) - 1).cast("int"), m)
                return _let(_let(new, ranked), lambda e2: F.when((joined(F.array_min(e2)) > m) & F.coalesce(apart, F.lit(True)), e2).otherwise(by_one()))

            kept = lambda s: F.filter(F.sequence(F.lit(0), F.size(e) - 1), lambda i: (i == 0) | (F.get(s, i - 1) != "1"))
            return _let(chosen, lambda s: _let(kept(s), lambda k: merged(s, k)))

        def step(merge):
            return lambda e, _: _let(F.array_min(e), lambda least: F.when(least >= idle, e).otherwise(merge(e, least)))

        def ids(w):
            # a byte is a letter of Latin-1
            letters = F.split(F.decode(F.encode(w, "utf-8"), "iso-8859-1"), "")
            numbers = F.transform(letters, lambda c: alphabet[F.ascii(c)])
            start = lambda label: _let(numbers, lambda p: F.transform(p, lambda x, t: entry(label(x, t), number_at(p, t + 1))))
            size = F.octet_length(w)
            name = lambda x: (x - 1).cast("int") if plain else F.get(named, (x - 1).cast("int"))
            known = lambda x: name(x) if len(pairs.pieces) + 1 == pairs.none else F.when(x <= len(pairs.pieces), name(x))
            spelt = lambda e: F.transform(F.filter(e, lambda x: number(x) != none), lambda x: known(number(x)))
            run = F.aggregate(F.sequence(F.lit(2), F.greatest(F.lit(2), size)), start(lambda x, t: F.shiftleft(t.cast("long"), bits).bitwiseOR(x)), step(first), spelt)
            # of a long word: root(n) rounds of root(n) steps, as idle steps cost as much as the word is long
            some = F.sequence(F.lit(0), F.ceil(F.sqrt(size)).cast("int"))
            further = lambda e, _: F.aggregate(some, e, step(lambda x, least: every(x, joined(least))))
            run_long = F.aggregate(some, start(lambda x, t: x), step(further), spelt)
            merge = F.when(size == 0, F.array().cast("array<int>")).when(size <= LONG, run).otherwise(run_long)
            if not some_unreached:
                return merge
            found = F.get(whole, F.pmod(F.crc32(w.cast("binary")), F.lit(MAPS)).cast("int"))[w]
            return _let(found, lambda v: F.when(v.isNotNull(), F.array(v)).otherwise(merge))

        return F.transform(words, ids)

    return _let(tables[0], lambda a: _let(tables[1], lambda b: _let(tables[2], lambda c: _let(tables[3], lambda d: _let(alphabet, lambda e: folded(a, b, c, d, e))))))


# --- words of texts ------------------------------------------------------------------------------

# Fixed value: the split pattern whose words hold a space only as their first character or inside a
# run of white space.  Cutting a text before every space then cuts no word, unless white space
# stands on both sides of a space or a space ends a run at the text's end.
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_white = "\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_joined = f"[{_white}] (?:[{_white}]|\\z)"
#: pieces that are one word, or a word and a mark, whatever the version of Unicode
_letters = r"\A ?[A-Za-zÀ-ÖØ-öø-ɏ]+\z"
_marked = r"\A ?[A-Za-zÀ-ÖØ-öø-ɏ]+[.,;:!?]\z"


class Splitter:
    """Arrow arrays of texts to words; pieces between spaces are split once per slice."""

    def __init__(self, pattern: str, explicit: str):
        self.spaced, self.find = pattern == SPACED, re.compile(explicit).findall

    def _pieces(self, texts):
        """pieces (distinct), code of every piece in the texts' order, offsets of the texts among them"""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        n = len(texts)
        whole = np.ones(n, bool) if not self.spaced else pc.match_substring_regex(texts, _joined).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(whole)
        cut = texts.filter(pa.array(~whole)) if len(at) else texts
        lists = pc.split_pattern(cut, " ")
        coded = pc.dictionary_encode(lists.flatten())
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        off = lists.offsets.to_numpy().astype(np.int64)
        off = off - off[0]
        first = np.zeros(len(code), bool)
        first[off[:-1]] = True
        bodies = coded.dictionary
        empty = pc.equal(bodies, "").to_numpy(zero_copy_only=False)
        drop = first & empty[code] if len(code) else first
        combo, kept = (2 * code + first)[~drop], ~drop
        used = np.zeros(2 * len(bodies), bool)
        used[combo] = True
        both = np.flatnonzero(used)
        number = np.cumsum(used) - 1
        spaces = pa.array(np.where(both % 2, "", " ").astype(object), pa.string())
        pieces = pc.binary_join_element_wise(spaces, bodies.take(pa.array(both // 2)), "")
        sizes = np.zeros(n, np.int64)
        sizes[~whole] = np.add.reduceat(kept.astype(np.int64), off[:-1]) if len(off) > 1 else 0
        code = number[combo]
        if len(at):  # texts that are one piece each
            order = np.repeat(np.flatnonzero(~whole), sizes[~whole])
            order = np.concatenate([order, at])
            code = np.concatenate([code, len(pieces) + np.arange(len(at))])[np.argsort(order, kind="stable")]
            sizes[at] = 1
            pieces = pa.concat_arrays([pieces, texts.take(pa.array(at)).cast(pieces.type)])
        return pieces, code, np.concatenate([[0], np.cumsum(sizes)])

    def _words(self, pieces):
        """words (distinct), code of every word in the pieces' order, words per piece"""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        test = lambda p: pc.match_substring_regex(pieces, p).to_numpy(zero_copy_only=False) if self.spaced else np.zeros(len(pieces), bool)
        one, two = test(_letters), test(_marked)
        rest = np.flatnonzero(~one & ~two)
        one, two = np.flatnonzero(one), np.flatnonzero(two)
        found = [self.find(x) for x in pieces.take(pa.array(rest)).to_pylist()]
        size = np.ones(len(pieces), np.int64)
        size[two] = 2
        size[rest] = [len(x) for x in found]
        marked = pieces.take(pa.array(two))
        flat = [pieces.take(pa.array(one)), pc.utf8_slice_codeunits(marked, 0, -1), pc.utf8_slice_codeunits(marked, -1), pa.array([w for x in found for w in x], pa.string())]
        # place of each word: its piece, then its number in the piece
        piece = np.concatenate([one, two, two, np.repeat(rest, size[rest])])
        turn = np.concatenate([np.zeros(len(one) + len(two), np.int64), np.ones(len(two), np.int64), np.arange(size[rest].sum()) - np.repeat(np.cumsum(size[rest]) - size[rest], size[rest])])
        start = np.cumsum(size) - size
        coded = pa.concat_arrays([x.cast(pa.string()) for x in flat]).dictionary_encode()
        out = np.empty(len(piece), np.int64)
        out[start[piece] + turn] = coded.indices.to_numpy(zero_copy_only=False)
        return coded.dictionary, out, size

    def distinct(self, texts):
        """The distinct words of the texts."""
        return self._words(self._pieces(texts)[0])[0]

    def words(self, texts):
        """words (distinct), code of every word in the texts' order, offsets of the texts among them"""
        import numpy as np

        pieces, code, off = self._pieces(texts)
        words, inner, size = self._words(pieces)
        start, mine = np.cumsum(size) - size, size[code]
        ends = np.concatenate([[0], np.cumsum(mine)])
        every = np.repeat(start[code] - ends[:-1], mine) + np.arange(ends[-1])
        return words, inner[every], ends[off]


def _texts(batch, column: str):
    """The column as Arrow strings, null as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.string()), "")


def _data(column, kind):
    """Offsets and values of an Arrow array of strings or binaries, without copying."""
    import numpy as np

    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32, len(column) + 1, 4 * column.offset) if len(column) else np.zeros(1, np.int32)
    size = np.dtype(kind).itemsize
    return off.astype(np.int64), np.frombuffer(data, kind, int(off[-1]) // size) if off[-1] else np.zeros(0, kind)


@functools.lru_cache(1)
def _factors():
    import numpy as np

    g = np.random.default_rng(8)
    return g.integers(1, 1 << 63, 256, np.uint64), g.integers(1, 1 << 63, 4096, np.uint64) | np.uint64(1)


def _hashes(words):
    """64 bits of every word."""
    import numpy as np

    off, data = _data(words, np.uint8)
    first, last = int(off[0]), int(off[-1])
    letter, place = _factors()
    at = np.arange(first, last) - np.repeat(off[:-1], np.diff(off))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letter[data[first:last]] * place[at & 4095], dtype=np.uint64)])
    return sums[off[1:] - first] - sums[off[:-1] - first]


class Numbers:
    """Numbers of distinct words, found by their hashes and then compared whole.

    Arrow's index_in hashes all the words anew at every call.  Of two words with one hash the later is
    never found and so is taken for a new word, which costs a fold and changes no result."""

    def __init__(self, words):
        self.words = words.slice(0, 0)
        self.hashes, self.number = _hashes(self.words), _hashes(self.words).astype("int64")
        self.add(words)

    def __len__(self):
        return len(self.words)

    def add(self, words):
        import numpy as np
        import pyarrow as pa

        h = _hashes(words)
        order = np.argsort(h)
        at = np.searchsorted(self.hashes, h[order], "right")
        self.number = np.insert(self.number, at, order + len(self))
        self.hashes = np.insert(self.hashes, at, h[order])
        self.words = pa.concat_arrays([self.words, words]) if len(self) else words

    def find(self, words):
        """Number of each word, -1 if it has none."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        out = np.full(len(words), -1, np.int64)
        if not len(self) or not len(words):
            return out
        h = _hashes(words)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self) - 1)
        alike = np.flatnonzero(self.hashes[at] == h)
        number = self.number[at[alike]]
        same = pc.equal(self.words.take(pa.array(number)), words.take(pa.array(alike))).to_numpy(zero_copy_only=False)
        out[alike[same]] = number[same]
        return out


# --- encoding ------------------------------------------------------------------------------------


def count_slices(docs: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """word, n: the distinct words of all whole texts and how many slices of text hold each."""
    explicit = explicit_pattern(pattern)

    def run(batches):
        import pyarrow as pa

        split = Splitter(pattern, explicit)
        for whole in batches:
            for b in text_slices(whole, text, COUNT_SLICE):
                yield pa.RecordBatch.from_arrays([split.distinct(_texts(b, text))], names=["word"])

    return docs.select(text).mapInArrow(run, "word string").groupBy("word").agg(F.count("*").alias("n"))


def dictionary(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", max_words: int = 1 << 20) -> DataFrame:
    """word, ids of the words found in most slices, in two slices at least: ``max_words`` at most.

    Kept are the words of so many slices or more (from 64 on: of a power of two) as fit.  It only saves
    folding a word again in another task."""
    counts = stored(count_slices(docs, pattern, text).where("n > 1"), "words")
    level = F.expr("if(n < 64, n, 57 + length(bin(n)))")
    seen = {r.k: r.c for r in counts.groupBy(level.alias("k")).agg(F.count("*").alias("c")).collect()}
    k, total = 57 + 65, 0
    while k > 2 and total + seen.get(k - 1, 0) <= max_words:
        k -= 1
        total += seen.get(k, 0)
    few = counts.where(level >= k).select("word")
    bundles = few.groupBy(F.pmod(F.xxhash64("word"), F.lit(max(1, total // 4096))).alias("b")).agg(F.collect_list("word").alias("word"))
    folded = bundles.repartition(max(1, min(4096, total // 4096))).select("word", fold_words(F.col("word"), ranks).alias("ids"))
    return folded.select(F.explode(F.arrays_zip("word", "ids")).alias("o")).select("o.word", "o.ids")


def _sealed(array) -> bytes:
    """An Arrow array as bytes, for a broadcast."""
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("x", array.type)])) as stream:
        stream.write_table(pa.table([array], names=["x"]))
    return sink.getvalue().to_pybytes()


def _opened(raw: bytes):
    """The array of ``_sealed``, read where the bytes lie."""
    import pyarrow as pa

    column = pa.ipc.open_stream(raw).read_all().column("x")
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _asked(docs: DataFrame, keep: list[str], shared, pattern: str, explicit: str, text: str) -> DataFrame:
    """``keep`` with ``__code`` (the numbers of the text's words, four bytes each: the dictionary's words
    come first, then those asked for), ``__ask`` (words to fold) and ``__at``: on the first row of a
    slice the number of words asked for before (0: all earlier ones are forgotten), else -1."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("__code", T.BinaryType()), T.StructField("__ask", T.ArrayType(T.StringType())), T.StructField("__at", T.LongType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        split, known = Splitter(pattern, explicit), Numbers(_opened(shared.value))
        asked = Numbers(pa.array([], pa.string()))
        for whole in batches:
            for b in text_slices(whole, text, SLICE):
                words, code, off = split.words(_texts(b, text))
                number = known.find(words)
                rest = np.flatnonzero(number < 0)
                words = words.take(pa.array(rest))
                if len(asked) + len(words) > ASKED:
                    asked = Numbers(words.slice(0, 0))
                mine, at = asked.find(words), len(asked)
                new = np.flatnonzero(mine < 0)
                fresh = words.take(pa.array(new))
                mine[new] = at + np.arange(len(new))
                asked.add(fresh)
                number[rest] = len(known) + mine
                first = np.arange(b.num_rows) == 0
                codes = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((4 * off).astype(np.int32)), pa.py_buffer(number.astype(np.int32)[code])])
                ask = pa.ListArray.from_arrays(pa.array(np.minimum(np.arange(b.num_rows + 1), 1) * len(fresh), pa.int32()), fresh)
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), codes, ask, pa.array(np.where(first, at, -1), pa.int64())], names=[*keep, "__code", "__ask", "__at"])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def _column(batch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def _offsets(lengths):
    import numpy as np

    return np.concatenate([[0], np.cumsum(lengths)])


def _list(offsets, values):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep: list[str], text: str, out: list[T.StructField], finish, max_words: int) -> DataFrame:
    """``keep`` and the columns ``out`` that ``finish`` makes of a slice: ids per distinct word, the
    number of the distinct word at every place, and the offsets of the texts among the places."""
    import pyarrow as pa

    explicit, kind = explicit_pattern(pattern), pa.list_(pa.int32())
    got = dictionary(docs, ranks, pattern, text, max_words).toArrow().combine_chunks()  # max_words rows at most
    size = got.num_rows
    sealed = [_sealed(pa.concat_arrays([*got.column(c).chunks, pa.array([], got.schema.field(c).type)]).cast(t)) for c, t in (("word", pa.string()), ("ids", kind))]
    del got
    shared, shared_ids = map(docs.sparkSession.sparkContext.broadcast, sealed)
    del sealed
    give_back()
    give_back_driver(docs.sparkSession)
    rows = _asked(docs, keep, shared, pattern, explicit, text).withColumn("__ids", fold_words(F.col("__ask"), ranks))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known = _opened(shared_ids.value)
        ids = known.slice(0, 0)

        def learned(b):
            """the batch cut before every row that begins a slice; the words that it brings are taken in first"""
            nonlocal ids
            begins = _column(b, "__at").to_numpy(zero_copy_only=False)
            cut = [0, *(i for i in np.flatnonzero(begins >= 0).tolist() if i), b.num_rows]
            for x, y in zip(cut, cut[1:]):
                part = b.slice(x, y - x)
                if begins[x] >= 0:
                    ids = ids.slice(0, int(begins[x]) and len(ids))
                    if begins[x] != len(ids):
                        raise RuntimeError("words came in another order than they were asked for")
                    ids = pa.concat_arrays([ids, _column(part, "__ids").flatten().cast(kind)])
                yield part

        for batch in batches:
            for part in learned(batch) if batch.num_rows else ():
                for b in text_slices(part, "__code", SLICE // 2):
                    off, codes = _data(_column(b, "__code"), np.int32)
                    off = off // 4
                    coded = pa.array(codes[off[0] :]).dictionary_encode()
                    used = coded.dictionary.to_numpy(zero_copy_only=False)
                    old = used < size
                    place = np.where(old, np.cumsum(old) - 1, old.sum() + np.cumsum(~old) - 1)
                    picked = pa.concat_arrays([known.take(pa.array(used[old])), ids.take(pa.array(used[~old] - size))])
                    yield pa.RecordBatch.from_arrays([*(_column(b, k) for k in keep), *finish(picked, place[coded.indices.to_numpy(zero_copy_only=False)], off - off[0])], names=[*keep, *(f.name for f in out)])

    return rows.mapInArrow(run, T.StructType([docs.schema[c] for c in keep] + out))


def encode(docs: DataFrame, rank_file: str, pattern: str, keep: list[str] | None = None, text: str = "text", max_words: int = 1 << 20) -> DataFrame:
    """The columns ``keep`` of every row with ``ids`` (array of int)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "ids"]

    def finish(ids, code, off):
        import pyarrow as pa

        every = ids.take(pa.array(code))
        return [_list(_offsets(every.value_lengths().to_numpy(zero_copy_only=False))[off], every.flatten())]

    return _encoded(docs, read_ranks(rank_file), pattern, keep, text, [T.StructField("ids", T.ArrayType(T.IntegerType()))], finish, max_words)


def _pieces(ranks: dict[bytes, int]) -> list[bytes | None]:
    out: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for k, v in ranks.items():
        out[v] = k
    return out


def _bytes_of(ids, pieces):
    """Lists of ids to the concatenated bytes of their pieces."""
    import pyarrow.compute as pc

    got = pieces.take(ids.flatten())
    if got.null_count:
        raise ValueError("an id is outside the vocabulary")
    return pc.binary_join(_list(_offsets(pc.fill_null(ids.value_lengths(), 0).to_numpy(zero_copy_only=False)), got), b"")


def decode(encoded: DataFrame, rank_file: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded`` (binary): the pieces of the ids, concatenated; null ids: empty."""
    vocabulary = _pieces(read_ranks(rank_file))
    keep = [c for c in encoded.columns if c != "decoded"]

    def run(batches):
        import pyarrow as pa

        pieces = pa.array(vocabulary, pa.binary())
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(_column(b, c) for c in keep), _bytes_of(_column(b, ids), pieces)], names=[*keep, "decoded"])

    return encoded.select(*keep).mapInArrow(run, T.StructType([encoded.schema[c] for c in keep] + [T.StructField("decoded", T.BinaryType())]))


def round_trip(docs: DataFrame, rank_file: str, pattern: str, keep: list[str], text: str = "text", max_words: int = 1 << 20) -> DataFrame:
    """``keep``, n_tokens, ids_sha256 and decoded_sha256: encode and decode within one task, so that
    the ids (several times the text) never leave it."""
    ranks = read_ranks(rank_file)
    vocabulary = _pieces(ranks)

    def finish(ids, code, off):
        from hashlib import sha256

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        lengths = ids.value_lengths().to_numpy(zero_copy_only=False)
        spelt = pc.binary_join(_list(_offsets(lengths), ids.flatten().cast(pa.string())), ",")
        decoded = _bytes_of(ids, pa.array(vocabulary, pa.binary()))
        at = pa.array(code)
        joined = [pc.binary_join(_list(off, x.take(at)), glue) for x, glue in ((spelt, ","), (decoded, b""))]
        digests = [pa.array([sha256(t.as_buffer()).hexdigest() for t in x]) for x in joined]
        return [pa.array(np.diff(_offsets(lengths[code])[off]), pa.int64()), *digests]

    out = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _encoded(docs, ranks, pattern, keep, text, out, finish, max_words)
