"""Quality classifier by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled web text train a small network that minimises the
non-negative unbiased risk ``pi * R_p(+1) + max(0, R_u(-1) - pi * R_p(-1))`` with the logistic
loss; no negative label is ever used.  The class prior ``pi`` is itself estimated from positives
and unlabelled text: the least ratio of the unlabelled to the positive mass above a score.

The fit takes bounded samples (``max_positive``, ``max_unlabelled`` rows, the ones with the lowest
hash of doc_id); scoring covers every whole text.  A score depends on the text alone.

Defined cases: a null or empty text gets the score of the all-zero measures; rows with a null
doc_id are scored and are never held out; repeated rows come back repeatedly with equal scores; an id
of several rows counts once in a sample, with the least vector of measures; with no positive rows every
score is 0.5; extra columns are ignored, and returned unchanged by ``filter_by_quality``.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, shielded, stored, text_slices

DIM = 24
_symbol = re.compile(r"[#*$%&|<>]")


def text_features(text: str | None) -> list[float]:
    """DIM bounded measures of one text; all ratios, so that whole texts of any length compare."""
    import math

    t = text or ""
    words = t.split()
    n, c = len(words), len(t)
    if not n:
        return [0.0] * DIM
    low = [w.lower() for w in words]
    count: dict[str, int] = {}
    for w in low:
        count[w] = count.get(w, 0) + 1
    upper = sum(map(str.isupper, words))
    pairs = sum(a == b for a, b in zip(low, low[1:]))
    lines = [x for x in t.split("\n") if x.strip()]
    starts = {}
    for x in lines:
        starts[x] = starts.get(x, 0) + 1
    ends = sum(w[-1] in ".!?" for w in words)
    symbols = len(_symbol.findall(t))
    letters = sum(map(len, words)) - symbols
    digits = sum(map(t.count, "0123456789"))
    squeezed = len(zlib.compress(t[:1 << 16].encode("utf-8", "replace"), 1)) if c <= 1 << 16 else sum(len(zlib.compress(t[i : i + (1 << 16)].encode("utf-8", "replace"), 1)) for i in range(0, c, 1 << 16))
    r = lambda a, b=n: min(a / b, 3.0)
    return [
        1.0, math.log1p(n) / 10, math.log1p(c) / 12, r(letters, 10 * n), r(upper), r(len(count)), math.log1p(n) / 10 * r(len(count)), r(pairs), 4 * r(max(count.values())),
        r(symbols), r(t.count("!")), r(t.count("|")), r(sum(map(t.count, "#*$%&"))), r(t.count("<") + t.count(">")), r(t.count(",")), r(ends), r(digits), r(10 * t.count("\n")),
        r(len(lines) - len(starts), max(1, len(lines))), r(sum(len(w) > 20 for w in words)), r(sum(len(w) == 1 for w in words)), r(squeezed, c), r(sum(w[0].isupper() for w in words)), r(10 * (t.count("http") + t.count("@"))),
    ]


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


class PUModel:
    """One hidden layer on standardised measures; plain arrays, so that it travels with a task."""

    def __init__(self, mean, scale, weights, prior):
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    def margin(self, x):
        import numpy as np

        w1, b1, w2, b2 = self.weights
        return np.maximum(((x - self.mean) / self.scale).clip(-6, 6) @ w1 + b1, 0) @ w2 + b2

    def score(self, x):
        import numpy as np

        return 1 / (1 + np.exp(-self.margin(x).clip(-30, 30)))


def _train(p, u, prior, seed, steps, hidden, rate=0.01, batch=512):
    """Adam on the non-negative risk; ``prior`` None trains positives against unlabelled as such."""
    import numpy as np

    g = np.random.default_rng(seed)
    both = np.concatenate([p, u])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    zp, zu = ((p - mean) / scale).clip(-6, 6), ((u - mean) / scale).clip(-6, 6)
    w = [g.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], hidden)), np.zeros(hidden), g.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    sig = lambda s: 1 / (1 + np.exp(-s.clip(-30, 30)))
    soft = lambda s: np.logaddexp(0, s)
    for t in range(1, steps + 1):
        a, b = zp[g.integers(0, len(zp), batch)], zu[g.integers(0, len(zu), batch)]
        x = np.concatenate([a, b])
        h = np.maximum(x @ w[0] + w[1], 0)
        s = h @ w[2] + w[3]
        sp, su = s[:batch], s[batch:]
        if prior is None:
            ds = np.concatenate([-(1 - sig(sp)), sig(su)]) / batch
        else:
            slack = soft(su).mean() - prior * soft(sp).mean()  # the negative part of the risk
            if slack >= 0:
                ds = np.concatenate([-prior * (1 - sig(sp)) - prior * sig(sp), sig(su)]) / batch
            else:  # step back up along the overfitted part only
                ds = np.concatenate([prior * sig(sp), -sig(su)]) / batch
        dh = np.outer(ds, w[2]) * (h > 0)
        grad = [x.T @ dh + 1e-4 * w[0], dh.sum(0), h.T @ ds + 1e-4 * w[2], ds.sum(keepdims=True)]
        for i in range(4):
            m[i] = 0.9 * m[i] + 0.1 * grad[i]
            v[i] = 0.999 * v[i] + 0.001 * grad[i] ** 2
            w[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return PUModel(mean, scale, w, prior)


def estimate_prior(p, u, seed: int = 7, steps: int = 600, hidden: int = 16) -> float:
    """The least ratio P_u(score > t) / P_p(score > t) over thresholds that keep half the positives
    or more, read on halves that did not train the score."""
    import numpy as np

    first = _train(p[::2], u[::2], None, seed, steps, hidden)
    sp, su = np.sort(first.margin(p[1::2])), np.sort(first.margin(u[1::2]))
    if not len(sp) or not len(su):
        return 0.5
    cut = np.quantile(sp, np.linspace(0, 0.5, 51))
    cut[0] -= 1e-9
    keep_p = 1 - np.searchsorted(sp, cut, "right") / len(sp)
    keep_u = 1 - np.searchsorted(su, cut, "right") / len(su)
    return float(np.clip((keep_u / np.maximum(keep_p, 1e-9)).min(), 0.05, 0.98))


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = 8000, max_unlabelled: int = 8000, seed: int = 7, steps: int = 1500, hidden: int = 16) -> PUModel | None:
    """Fit on bounded samples of rows that are not held out; None without positives.

    Positives: label 1.  Unlabelled: any documents, their labels unread."""
    import numpy as np

    order = F.xxhash64(F.col("doc_id"), F.lit(seed))
    train = lambda d: d.where(F.col("doc_id").isNotNull() & ~held_out())
    pos = train(labels.where("quality = 1")).select("doc_id").distinct().orderBy(order, "doc_id").limit(max_positive).select("doc_id", F.lit(1).alias("kind"))
    unl = train(docs).select("doc_id").distinct().orderBy(F.xxhash64(F.col("doc_id"), F.lit(seed + 1)), "doc_id").limit(max_unlabelled).select("doc_id", F.lit(0).alias("kind"))
    chosen = stored(pos.unionAll(unl), "sample")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # max_positive + max_unlabelled ids at most
    # one row of each id, whatever the number of its rows: the one of the least measures
    got = _featured(texts, ["kind", "doc_id"]).groupBy("kind", "doc_id").agg(F.min("x").alias("x")).orderBy("kind", "doc_id").toArrow()
    x, kind = got.column("x").combine_chunks().flatten().to_numpy().reshape(got.num_rows, DIM), got.column("kind").to_numpy()
    p, u = x[kind == 1], x[kind == 0]
    del got, x
    if len(p) < 2 or len(u) < 2:
        return None
    model = _train(p, u, estimate_prior(p, u, seed), seed, steps, hidden)
    give_back()
    return model


def _featured(df: DataFrame, keep: list[str]) -> DataFrame:
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", x array<double>"

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = [text_features(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])

    return df.mapInArrow(run, schema)


def score(docs: DataFrame, model: PUModel | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row with ``score`` (0 to 1) of its whole text."""
    from pyspark.sql import types as T

    keep = [c for c in keep if c != "score"]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for b in text_slices(whole, "text", 8 << 20):
                if model is None:
                    s = np.full(b.num_rows, 0.5)
                else:
                    s = model.score(np.array([text_features(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()], float))
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(s, pa.float64())], names=[*keep, "score"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def filter_by_quality(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` with a score of 0.5 or more, with the columns of ``docs``."""
    safe, back = shielded(docs, ["score"])
    return score(safe, fit(docs, labels, **how), safe.columns).where("score >= 0.5").select(*back)
