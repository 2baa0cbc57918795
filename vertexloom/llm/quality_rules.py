"""Quality rules whose cutoffs come from mergeable quantile sketches per language and source.

One scan measures each whole text.  A sketch is a histogram over integer buckets that keep the
five leading bits of a value (relative error below 1/16, at most ~900 buckets per feature), so
sketches merge by adding counts: a (lang, source) sketch is a groupBy, a language's sketch is the
sum of its sources, and the corpus sketch the sum of all.  Documents that fail the base rules are
not sketched.  A threshold lies ``m`` times the distance of a tail quantile ``p`` to the median beyond
that quantile (for the mean word length on both sides); only where the two fall into one bucket the
bucket's width stands for the distance.  No threshold holds a constant of the measure's own scale.  A
source with fewer than ``min_docs`` sketched documents takes its language's, a rare language the corpus's.

Defined cases: a null text has no words (all measures 0, base_failed, not kept); null lang or
source form their own group; repeated rows each count and each come back; an empty table gives an
empty result; ``filter_by_rules`` returns input columns unchanged even where their names clash with the
measures, the other functions replace such columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if, shielded, stored, text_slices

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: feature -> (p, the tail quantile in per cent; m, its multiple; whether values below a lower fence fail too)
FEATURES = {"len100": (90, 2, True), "sym1000": (90, 2, False), "dup1000": (99, 1, False), "rep1000": (99, 1, False)}
#: at most so many (lang, source) groups are joined by broadcast: some 100 bytes each
BROADCAST_GROUPS = 50_000


def repeat_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur twice or more, the first time included."""
    import numpy as np

    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    if len(ids) == len(words):
        return 0
    # rows that can start a repeated window repeat their first word and their last word
    key = np.zeros(n, np.uint64)
    for k in range(width):
        key = key * np.uint64(0x9E3779B97F4A7C15) + (x[k : k + n] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    at = np.flatnonzero(hit)
    # equal hashes are only candidates: compare the windows themselves
    rows = np.stack([x[at + k] for k in range(width)], 1)
    _, inverse, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    at = at[count[inverse.reshape(-1)] > 1]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure_text(text: str | None) -> tuple[int, ...]:
    """The MEASURES of one text."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split on exactly \x20 and \x09-\x0D
    lines = [x for x in raw.split(b"\n") if x.translate(None, SPACE)]
    return (
        len(words), len(text) - (len(raw) - len(raw.translate(None, SPACE))), len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines), len(lines) - len(set(lines)), repeat_words(words),
    )


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the MEASURES of the text appended."""
    docs = docs.drop(*(m for m in MEASURES if m != text))
    keep = tuple(docs.columns) if keep is None else keep
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(m, T.LongType()) for m in MEASURES])

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for b in text_slices(whole, text, 8 << 20):
                got = [measure_text(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
                cols = [b.column(b.schema.get_field_index(c)) for c in keep]
                cols += [pa.array([g[i] for g in got], pa.int64()) for i in range(len(MEASURES))]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *MEASURES])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def base_failed() -> F.Column:
    """Fewer than 20 words, or over 30 % of the words in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def features() -> dict[str, F.Column]:
    per = lambda a, k, b: F.when(F.col(b) > 0, F.expr(f"({k} * {a}) div {b}")).otherwise(F.lit(0).cast("long"))
    return {"len100": per("word_chars", 100, "n_words"), "sym1000": per("n_symbols", 1000, "n_words"), "dup1000": per("n_dup_lines", 1000, "n_lines"), "rep1000": per("n_repeat_words", 1000, "n_words")}


def bucket(v: str) -> F.Column:
    """The bucket of an integer value >= 0: its five leading bits."""
    drop = f"greatest(0, length(bin({v})) - 5)"
    return F.expr(f"shiftleft(shiftright({v}, {drop}), {drop})")


def width(v: str) -> str:
    """SQL for the width of the bucket at ``v``."""
    return f"shiftleft(1L, greatest(0, length(bin({v})) - 5))"


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, feature, bucket, n: one mergeable sketch per group, of documents that pass the base rules."""
    with_words = measured.where(~base_failed()).select("lang", "source", *(c.alias(k) for k, c in features().items()))
    long = with_words.select("lang", "source", F.explode(F.map_from_arrays(F.array(*(F.lit(k) for k in FEATURES)), F.array(*FEATURES))).alias("feature", "v"))
    return long.groupBy("lang", "source", "feature", bucket("v").alias("bucket")).agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, docs, lo_<feature>, hi_<feature>: quantiles read from sketches merged to ``keys``."""
    merged = sketch.groupBy(*keys, "feature", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "feature")
    cum = merged.select("*", F.sum("n").over(w.orderBy("bucket")).alias("upto"), F.sum("n").over(w).alias("docs"))
    q = lambda p: F.min(F.when(F.col("upto") * 100 >= F.col("docs") * p, F.col("bucket")))
    percents = sorted({x for p, _, _ in FEATURES.values() for x in (p, 100 - p, 50)})
    each = cum.groupBy(*keys, "feature").agg(F.max("docs").alias("docs"), *(q(x).alias(f"q{x}") for x in percents))
    out = [F.max("docs").alias("docs")]
    for f, (p, m, both) in FEATURES.items():
        at = lambda x, f=f: F.max(F.when(F.col("feature") == f, F.expr(x)))
        out.append(at(f"q{p} + {m} * greatest(q{p} - q50, {width(f'q{p}')})").alias(f"hi_{f}"))
        if both:
            out.append(at(f"q{100 - p} - {m} * greatest(q50 - q{100 - p}, {width(f'q{100 - p}')})").alias(f"lo_{f}"))
    return each.groupBy(*keys).agg(*out)


def thresholds(sketch: DataFrame, min_docs: int = 50) -> DataFrame:
    """One row per (lang, source) of the sketch: its own fences, its language's, or the corpus's."""
    names = [f"{p}_{f}" for f, (_, _, both) in FEATURES.items() for p in (("hi", "lo") if both else ("hi",))]
    own, lang, corpus = fences(sketch, ["lang", "source"]), fences(sketch, ["lang"]), fences(sketch.withColumn("one", F.lit(1)), ["one"])
    rename = lambda d, p: d.select(*(F.col(c).alias(f"{p}_{c}") for c in d.columns))
    joined = own.join(F.broadcast(rename(corpus, "c"))).join(rename(lang, "l"), F.col("lang").eqNullSafe(F.col("l_lang")), "left")
    pick = lambda n: F.when(F.col("docs") >= min_docs, F.col(n)).when(F.col("l_docs") >= min_docs, F.col(f"l_{n}")).otherwise(F.col(f"c_{n}"))
    return joined.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *(pick(n).alias(n) for n in names))


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` with base_failed and kept, by a join on (lang, source).

    The limits are broadcast up to BROADCAST_GROUPS groups; beyond that the join shuffles, where
    AQE splits a hot source."""
    f = features()
    lim = broadcast_if(limits, BROADCAST_GROUPS)
    joined = measured.join(lim, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    over = F.lit(False)
    for k, (_, _, both) in FEATURES.items():
        over = over | F.coalesce(f[k] > F.col(f"hi_{k}"), F.lit(False))
        if both:
            over = over | F.coalesce(f[k] < F.col(f"lo_{k}"), F.lit(False))
    return joined.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & ~over}).drop(*limits.columns)


def quality_rules(docs: DataFrame, min_docs: int = 50) -> DataFrame:
    """doc_id, lang, source, the MEASURES, base_failed and kept for every row of ``docs``."""
    measured = stored(measure(docs, keep=("doc_id", "lang", "source")), "measures")
    return judge(measured, stored(thresholds(sketches(measured), min_docs), "limits"))


def filter_by_rules(docs: DataFrame, min_docs: int = 50) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``.

    Texts never move: a first scan gives the sketches, a second measures again beside the text."""
    measured = stored(measure(docs, keep=("lang", "source")), "measures")
    limits = stored(thresholds(sketches(measured), min_docs), "limits")
    safe, back = shielded(docs, [*MEASURES, "base_failed", "kept", *limits.columns])
    return judge(measure(safe), limits).where("kept").select(*back)
