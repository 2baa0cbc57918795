"""Licence scan by a trained paragraph classifier.

A paragraph is a run of non-blank lines.  Its single lines, windows of neighbouring lines and the
whole of it are scored by a multinomial logistic regression on sparse word 1- to 3-grams
over licence families and a class ``unknown``.  It is trained here: positives are the templates
with dropped, changed and added words, negatives a bounded sample of corpus paragraphs and
shuffled template words.  A held-back third calibrates a temperature and the least probability at
which a family is named at all; below it the paragraph is unknown.  A named family is then
confirmed by comparison with its templates: the share of a template's word pairs found in the
paragraph must reach ``confirm``.

Every line and every paragraph is scored: only words of the model's vocabulary can form its n-grams,
so the others are skipped on the way to an equal score.  Windows reach as far as a template's words
can from a line, however narrowly it is wrapped; a window is named only if confirmed (it is scored
where its word pairs suffice for that), and where no line or smaller window it shares has been
confirmed for that family, so that a notice counts once.  A paragraph of several lines that is named
and not confirmed counts if none of its lines is named for that family.  Defined cases: null or empty
text: no paragraphs; blank lines are none; a line without any word of the vocabulary gets the
probabilities of the model's bias; repeated rows come back repeatedly; an empty table trains on
templates alone; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_slices

# Public licence notices by family.
TEMPLATES = {
    "agpl": ["This program is licensed under the GNU Affero General Public License, version 3.", "Licensed under the AGPL, version 3 or later."],
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "bsd": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1."],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "public-domain": ["This work has been dedicated to the public domain.", "This is free and unencumbered software released into the public domain."],
    "reserved": ["All rights reserved.", "Copyright. All rights reserved. No part of this publication may be reproduced without permission of the publisher."],
}
_word = re.compile(r"[a-z0-9][a-z0-9.\-]*")


def words_of(paragraph: str) -> list[str]:
    return [w.rstrip(".-") or w for w in _word.findall(paragraph.lower())]


def grams(words: list[str], n: int = 3) -> set[str]:
    return {" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)}


def _pairs(words: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(words, words[1:])} or set(words)


class LicenseModel:
    """Weights per n-gram, temperature and cutoff; plain values."""

    def __init__(self, classes, weights, bias, temperature, cutoff, confirm):
        import numpy as np

        self.classes, self.bias, self.temperature, self.cutoff, self.confirm = classes, bias, temperature, cutoff, confirm
        self.templates = {c: [_pairs(words_of(t)) for t in TEMPLATES[c]] for c in classes if c in TEMPLATES}
        self.longest = max(len(words_of(t)) for ts in TEMPLATES.values() for t in ts)
        # pair -> numbers of the templates that hold it, and how many of each one's pairs confirm it
        every = [t for c in sorted(self.templates) for t in self.templates[c]]
        self.needed, self.holders = [confirm * len(t) for t in every], {}
        for k, t in enumerate(every):
            for pair in t:
                self.holders.setdefault(pair, []).append(k)
        # one row per n-gram of the vocabulary; words that no n-gram holds are passed over
        self.row = {g: i for i, g in enumerate(weights)}
        self.matrix = np.array([*weights.values()], np.float64).reshape(len(weights), len(classes))
        self.words = {w for g in weights for w in g.split(" ")}
        self.memo: dict[tuple[int, ...], tuple[str, float]] = {}

    def grams_of(self, words: list[str]) -> set[int]:
        """Numbers of the vocabulary's n-grams found in ``words``."""
        known, row, out = self.words, self.row, set()
        a = b = None  # the two words before, where they are known
        for c in words:
            if c not in known:
                a = b = None
                continue
            for g in (c, b and f"{b} {c}", a and f"{a} {b} {c}"):
                if g in row:
                    out.add(row[g])
            a, b = b, c
        return out

    def probabilities(self, words: list[str]):
        return self._softmax(self.grams_of(words))

    def _softmax(self, found):
        import numpy as np

        s = self.bias + self.matrix[sorted(found)].sum(0) / np.sqrt(max(1, len(found)))
        e = np.exp((s - s.max()) / self.temperature)
        return e / e.sum()

    def _best(self, found: set[int]) -> tuple[str, float]:
        """The class of a set of n-grams (unknown below the cutoff) and its probability; small sets recur."""
        import numpy as np

        key = tuple(sorted(found)) if len(found) <= 4 else None
        if key in self.memo:
            return self.memo[key]
        p = self._softmax(found)
        best = int(np.argmax(p))
        if self.classes[best] == "unknown" or p[best] < self.cutoff:
            best = self.classes.index("unknown")
        got = self.classes[best], float(p[best])
        if key is not None and len(self.memo) < 1 << 16:
            self.memo[key] = got
        return got

    def classify(self, paragraph: str) -> tuple[str, float, bool]:
        """family (or unknown), its probability, and whether a template confirms it."""
        return self.classify_words(words_of(paragraph))

    def classify_words(self, words: list[str]) -> tuple[str, float, bool]:
        name, p = self._best(self.grams_of(words))
        if name == "unknown":
            return name, p, False
        mine = _pairs(words)
        return name, p, any(len(t & mine) >= self.confirm * len(t) for t in self.templates[name])

    def _may_confirm(self, hits) -> bool:
        """Whether ``hits`` (sets of known pairs) hold enough of some template together."""
        count: dict[int, int] = {}
        for pair in set().union(*hits):
            for k in self.holders[pair]:
                count[k] = count.get(k, 0) + 1
        return any(n >= self.needed[k] for k, n in count.items())

    def paragraph(self, lines: list[tuple[int, str]]) -> list[dict]:
        """What is found in one paragraph, given as (line number, text)."""
        found = []
        numbered = [(i, w) for i, x in lines if (w := words_of(x))]
        for i, w in numbered:
            family, p, sure = self.classify_words(w)
            if family != "unknown":
                found.append({"line": i, "family": family, "probability": p, "confirmed": sure})
        n = len(numbered)
        if n < 2:
            return found
        # known pairs of a line, and the one that runs into the next line
        inside = [{x for a, b in zip(w, w[1:]) if (x := f"{a} {b}") in self.holders} for _, w in numbered]
        across = [{x} if (x := f"{a[-1]} {b[0]}") in self.holders else set() for (_, a), (_, b) in zip(numbered, numbered[1:])]
        if not self._may_confirm([*inside, *across]):
            return self._whole(numbered, found)
        place = {i: k for k, (i, _) in enumerate(numbered)}
        taken = [(place[x["line"]], place[x["line"]], x["family"]) for x in found if x["confirmed"]]
        windows = []
        for a in range(n - 1):
            more = 0
            for b in range(a + 1, n):
                if (inside[a] or across[a]) and (inside[b] or across[b - 1]):
                    windows.append((a, b))
                more += len(numbered[b][1])
                if more >= self.longest:
                    break
        for a, b in [*sorted(windows, key=lambda w: (w[1] - w[0], w[0])), (0, n - 1)]:
            if not self._may_confirm([*inside[a : b + 1], *across[a:b]]):
                continue
            family, p, sure = self.classify_words([x for _, w in numbered[a : b + 1] for x in w])
            if sure and not any(f == family and c <= b and a <= d for c, d, f in taken):
                taken.append((a, b, family))
                found = [x for x in found if x["confirmed"] or x["family"] != family or not a <= place[x["line"]] <= b]
                found.append({"line": numbered[a][0], "family": family, "probability": p, "confirmed": True})
        return self._whole(numbered, sorted(found, key=lambda x: x["line"]))

    def _whole(self, numbered: list[tuple[int, list[str]]], found: list[dict]) -> list[dict]:
        """``found`` with the paragraph's own family in front, unless a line or window has it already."""
        family, p, sure = self.classify_words([x for _, w in numbered for x in w])
        if family == "unknown" or any(x["family"] == family for x in found):
            return found
        return [{"line": numbered[0][0], "family": family, "probability": p, "confirmed": sure}, *found]


def paragraphs_of(text: str) -> list[list[tuple[int, str]]]:
    """Runs of non-blank lines, each line with its number in the text."""
    out: list[list[tuple[int, str]]] = [[]]
    for i, x in enumerate(text.split("\n")):
        if x.strip():
            out[-1].append((i, x))
        elif out[-1]:
            out.append([])
    return out if out[-1] else out[:-1]


def _train(negatives: list[str], seed: int, copies: int, confirm: float, rounds: int = 300) -> LicenseModel:
    import numpy as np

    g = np.random.default_rng(seed)
    pool = sorted({w for t in negatives for w in words_of(t)}) or ["lorem", "ipsum", "dolor"]
    classes = [*sorted(TEMPLATES), "unknown"]
    rows, y = [], []
    for c, name in enumerate(classes[:-1]):
        for t in TEMPLATES[name]:
            base = words_of(t)
            for i in range(copies):
                w = [x if g.random() > 0.06 else pool[g.integers(len(pool))] for x in base if i == 0 or g.random() > 0.05] or base
                if i % 3 == 1:
                    w = [*(pool[k] for k in g.integers(0, len(pool), g.integers(0, 12))), *w, *(pool[k] for k in g.integers(0, len(pool), g.integers(0, 12)))]
                rows.append(w if i else base), y.append(c)
    every = [w for ts in TEMPLATES.values() for t in ts for w in words_of(t)]
    for _ in range(copies * 6):
        k = int(g.integers(1, 12))
        rows.append([every[j] if g.random() < 0.6 else pool[g.integers(len(pool))] for j in g.integers(0, len(every), k)]), y.append(len(classes) - 1)
    for t in negatives:
        rows.append(words_of(t)), y.append(len(classes) - 1)
    known = {x for ts in TEMPLATES.values() for t in ts for x in grams(words_of(t))}
    vocabulary = {x: i for i, x in enumerate(sorted(known))}
    x, y = np.zeros((len(rows), len(vocabulary)), np.float32), np.array(y)
    for i, w in enumerate(rows):
        at = [vocabulary[z] for z in grams(w) if z in vocabulary]
        x[i, at] = 1 / np.sqrt(max(1, len(at)))
    part = g.permutation(len(rows))
    fit, held = part[len(part) // 3 :], part[: len(part) // 3]
    hot = np.eye(len(classes), dtype=np.float32)[y]
    w, b = np.zeros((len(vocabulary), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    mw, mb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        s = x[fit] @ w + b
        p = np.exp(s - s.max(1, keepdims=True))
        d = (p / p.sum(1, keepdims=True) - hot[fit]) / len(fit)
        mw, mb = 0.9 * mw + x[fit].T @ d + 1e-5 * w, 0.9 * mb + d.sum(0)
        w, b = w - 8 * mw, b - 8 * mb
    s = x[held] @ w + b

    def soft(t):
        e = np.exp((s - s.max(1, keepdims=True)) / t)
        return e / e.sum(1, keepdims=True)

    temperature = min(np.geomspace(0.25, 4, 25), key=lambda t: -np.log(soft(t)[np.arange(len(held)), y[held]] + 1e-12).mean())
    p = soft(temperature)
    wrong = (p.argmax(1) != y[held]) & (p.argmax(1) != len(classes) - 1)
    cutoff = float(np.clip(np.quantile(p[wrong].max(1), 0.9) if wrong.any() else 0.5, 0.5, 0.95))
    return LicenseModel(classes, {k: w[i] for k, i in vocabulary.items()}, b, float(temperature), cutoff, confirm)


def train(docs: DataFrame | None = None, seed: int = 11, copies: int = 60, max_docs: int = 500, confirm: float = 0.75) -> LicenseModel:
    """Fit on the templates and up to 4 short paragraphs of ``max_docs`` documents (lowest hash of id)."""
    negatives: list[str] = []
    if docs is not None:
        lines = F.slice(F.filter(F.split("text", "\n"), lambda x: (F.length(x) > 0) & (F.length(x) < 400)), 1, 4)
        # ids are chosen first, so that no task sends texts that lose
        chosen = stored(docs.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_docs), "sample")
        # one row of each id, whatever the number of its rows: the one of the least lines
        few = docs.join(F.broadcast(chosen), "doc_id").where("text is not null").groupBy("doc_id").agg(F.min(lines).alias("l"))
        for r in few.orderBy("doc_id").collect():
            negatives.extend(r.l)
    known = [[_pairs(words_of(t)) for t in ts] for ts in TEMPLATES.values()]
    clean = [n for n in negatives if not any(len(t & _pairs(words_of(n))) >= 0.5 * len(t) for ts in known for t in ts)]
    return _train(clean, seed, copies, confirm)


def scan(docs: DataFrame, model: LicenseModel, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with n_paragraphs and ``found``: line (the first), family, probability,
    confirmed of every line, window or paragraph that is not unknown."""
    from pyspark.sql import types as T

    item = T.StructType([T.StructField("line", T.IntegerType()), T.StructField("family", T.StringType()), T.StructField("probability", T.DoubleType()), T.StructField("confirmed", T.BooleanType())])
    keep = [c for c in keep if c not in ("n_paragraphs", "found")]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("n_paragraphs", T.LongType()), T.StructField("found", T.ArrayType(item))])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(T.ArrayType(item))
        for whole in batches:
            for b in text_slices(whole, text, 8 << 20):
                count, found = [], []
                for t in b.column(b.schema.get_field_index(text)).to_pylist():
                    parts = paragraphs_of(t or "")
                    count.append(len(parts))
                    found.append([x for lines in parts for x in model.paragraph(lines)])
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(count, pa.int64()), pa.array(found, kind)], names=[*keep, "n_paragraphs", "found"])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
