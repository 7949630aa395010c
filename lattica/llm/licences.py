"""Licence scans by a trained paragraph classifier, with DataFrame functions only.

Lines, and passages of adjacent lines, as notices are usually wrapped, become
sparse vectors of hashed word n-grams.  A multinomial logistic regression over licence families and an unknown class is fitted on
statements built from the templates below and on paragraphs of the corpus.  Its
confidence is calibrated on statements and paragraphs it has not seen: what is
less likely than not to be the named family is unknown.  A prediction counts
once the paragraph holds most words of one of the family's templates.
"""

from __future__ import annotations

import re
from functools import reduce
from math import ceil

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import few, once, stored

# Families, how they are named, and sentences of their notices.
NAMES = {
    "mit": ["the MIT License", "the MIT license terms", "The MIT License (MIT)"],
    "apache-2.0": ["the Apache License, Version 2.0", "Apache-2.0", "the Apache License 2.0", "Apache License, Version 2.0"],
    "gpl": ["the GNU General Public License, version 3", "GPL-3.0", "the GNU General Public License", "GNU GPL v2 or later", "GPLv3"],
    "lgpl": ["the GNU Lesser General Public License", "LGPL-2.1", "the GNU Lesser General Public License, version 3", "LGPLv3"],
    "agpl": ["the GNU Affero General Public License", "AGPL-3.0", "the GNU Affero General Public License, version 3", "AGPLv3"],
    "bsd": ["the BSD 3-Clause License", "BSD-3-Clause", "the BSD license", "the 2-clause BSD license", "BSD-2-Clause"],
    "mpl-2.0": ["the Mozilla Public License, v. 2.0", "MPL-2.0", "the Mozilla Public License 2.0"],
    "cc-by": ["CC BY 4.0", "a Creative Commons Attribution 4.0 International License", "CC-BY-4.0"],
    "cc-by-sa": ["CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"],
    "cc0": ["CC0 1.0 Universal", "the Creative Commons CC0 1.0 Public Domain Dedication", "CC0-1.0"],
    "isc": ["the ISC License", "the ISC license terms"],
}
NOTICES = {
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "apache-2.0": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
             "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "agpl": ["You should have received a copy of the GNU Affero General Public License along with this program",
             "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
}
LEADS = [
    "{}", "Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "Distributed under {}.", "Published under {}.",
    "This file is available under the terms of {}.", "The code is covered by {}.", "SPDX-License-Identifier: {}", "License: {}",
    "All texts are made available under {}.", "Use of this document is governed by {}.", "Copyright 2021 by the authors, licensed under {}.",
]
NOT_LICENCES = [
    "A driving license is needed to rent a car.", "The license of the restaurant was not renewed.", "He was licensed to practise medicine.",
    "The new version was released under pressure.", "This work is distributed among the members.", "The public library is open to all.",
    "Copyright law differs between countries.", "The apache helicopter was seen again.", "Students of MIT won the prize.",
    "The general public was not admitted.", "Version 3 of the plan is available.", "Use of this document is restricted to employees.",
]
UNKNOWN = "unknown"

NEGATIVES = 5_000  # paragraphs of the corpus the classifier is fitted on
FEATURES = 1 << 14
BINS = 20  # of confidence, for calibration
COVERAGE = 0.8  # share of a template's words that a paragraph must hold
_GRID = 1 << 30
_WORD = re.compile(r"[a-z0-9]+(?:[.+][a-z0-9]+)*")  # as `words` finds them in templates, which are ASCII

FAMILIES = [UNKNOWN, *sorted(NAMES)]


def words(text: Column) -> Column:
    """Lower-case words; letters and digits of any script, with dots and pluses inside."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.+][\p{L}\p{N}]+)*"), F.lit(0))


def vectors(paragraphs: DataFrame, text: str, out: str) -> DataFrame:
    """`paragraphs` with the words (`out`_w) and the vector of hashed words and pairs of words (`out`)."""
    w, pairs, terms = f"{out}_w", f"{out}_p", f"{out}_t"
    tokens = paragraphs.withColumn(w, words(F.col(text)))
    grams = NGram(n=2, inputCol=w, outputCol=pairs).transform(tokens)
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol=terms, outputCol=out).transform(grams.withColumn(terms, F.concat(w, pairs))).drop(pairs, terms)


def paragraphs_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(`id`, `paragraph`) of the non-empty lines of every text."""
    lines = F.explode(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n"))
    return docs.select(F.col(id_col).alias("id"), lines.alias("paragraph")).where(F.length(F.trim("paragraph")) > 0)


def examples(docs: DataFrame, id_col: str, text_col: str, bound: int = NEGATIVES) -> DataFrame:
    """Labelled paragraphs: `paragraph`, `label` (a place in FAMILIES).

    Statements name a family in each way; corpus paragraphs, chosen by hash and
    without those that name one, are unknown.
    """
    spark = docs.sparkSession
    rows = [(lead.format(name), FAMILIES.index(f)) for f, names in NAMES.items() for name in names for lead in LEADS]
    rows += [(_bare(name), FAMILIES.index(f)) for f, names in NAMES.items() for name in names if name != _bare(name)]
    for f, texts in NOTICES.items():
        for text in texts:  # whole, and cut at either end
            w = text.split()
            rows += [(" ".join(part), FAMILIES.index(f)) for part in (w, w[: len(w) * 2 // 3], w[len(w) // 3 :], w[2:], w[:-2])]
    rows += [(text, 0) for text in NOT_LICENCES]
    total = docs.agg(F.sum(F.size(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n")))).first()[0] or 0
    some = paragraphs_of(docs, id_col, text_col).where(F.pmod(F.xxhash64("id", "paragraph"), F.lit(_GRID)) < ceil(_GRID * min(1.0, bound / max(total, 1))))
    some = some.where(~_names_one(F.col("paragraph")) & ~_quotes_one(F.col("paragraph"))).select("paragraph", F.lit(0).alias("label"))
    return spark.createDataFrame(rows, "paragraph string, label int").union(some)


def _bare(name: str) -> str:
    """A name without its article, as titles have it."""
    return re.sub(r"^(?:the|a) ", "", name, flags=re.IGNORECASE)


def _templates() -> list[tuple[str, str]]:
    """(family, sentence) of every template."""
    return [(f, _bare(lead)) for f, names in NAMES.items() for lead in names] + [(f, t) for f, texts in NOTICES.items() for t in texts]


def _coverage(tokens: Column, family: str) -> Column:
    """Largest share of a template's words that the tokens hold."""
    shares = []
    for f, sentence in _templates():
        if f == family:
            wanted = F.array_distinct(words(F.lit(sentence)))
            shares.append(F.size(F.array_intersect(tokens, wanted)) / F.size(wanted))
    return F.greatest(*shares, F.lit(0.0))


def _names_one(text: Column) -> Column:
    """Whether a template is part of the text, whatever the case."""
    tests = [F.contains(F.lower(text), F.lit(s.lower())) for _, s in _templates()]
    return reduce(lambda a, b: a | b, tests)


def _quotes_one(text: Column) -> Column:
    """Whether four words in a row are those of a notice: a line of a wrapped notice is no example of the unknown."""
    runs = {" ".join(w[i : i + 4]) for texts in NOTICES.values() for t in texts for w in [_WORD.findall(t.lower())] for i in range(len(w) - 3)}
    plain = F.concat(F.lit(" "), F.array_join(words(text), " "), F.lit(" "))
    return plain.rlike(" (?:" + "|".join(re.escape(r) for r in sorted(runs)) + ") ")


def _telling() -> list[str]:
    """Words of which each template has so many that `COVERAGE` of it holds at least one."""
    out: set[str] = set()
    for _, sentence in _templates():
        distinct = set(_WORD.findall(sentence.lower()))
        missing = len(distinct) - ceil(COVERAGE * len(distinct) - 1e-9)
        out.update(sorted(distinct, key=lambda w: (w not in out, -len(w), w))[: missing + 1])
    return sorted(out)


def passages_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(`id`, `paragraph`) of the passages of adjacent lines that a template may be wrapped over, as words.

    A passage starts and ends in lines of its paragraph, which lines without a
    word end (blank ones, bare comment marks).  All stretches of up to as many
    words as the longest template has, over two lines or more, lie in one; of
    its first and last line only as many words are kept.  Passages without a
    telling word are left out, since no template could be covered.
    """
    longest = max(len(_WORD.findall(t.lower())) for _, t in _templates())
    telling = F.array(*[F.lit(w) for w in _telling()])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    some = docs.select(F.col(id_col).alias("id"), text.alias("text")).where(F.contains("text", F.lit("\n")))
    some = some.where(F.arrays_overlap(words(F.col("text")), telling))
    lines = once(some, F.transform(F.split("text", "\n"), words), "lines").select("id", "lines")
    # Lines from each one on; a passage has at most `longest` lines between its first and last.
    starts = F.transform(F.sequence(F.lit(1), F.size("lines")), lambda i: F.slice(F.col("lines"), i, longest + 1))
    runs = lines.select("id", F.explode(starts).alias("run")).where((F.size("run") > 1) & (F.size(F.col("run")[0]) > 0))

    def passage(k: Column) -> Column:
        first, last, inner = F.col("run")[0], F.element_at("run", k), F.slice("run", 2, k - 2)
        kept = F.slice(first, F.greatest(F.size(first) - longest + 1, F.lit(1)), longest)
        fits = F.forall(inner, lambda x: F.size(x) > 0) & (F.size(F.flatten(inner)) <= longest - 2) & (F.size(last) > 0)
        return F.when(fits, F.concat(kept, F.flatten(inner), F.slice(last, 1, longest)))

    found = runs.select("id", F.explode(F.transform(F.sequence(F.lit(2), F.size("run")), passage)).alias("w"))
    return found.where(F.arrays_overlap("w", telling)).select("id", F.array_join("w", " ").alias("paragraph"))


class Model:
    """A fitted regression and the calibration of its confidence."""

    def __init__(self, regression, rates: list[float]):
        self.regression, self.rates = regression, rates

    def predict(self, paragraphs: DataFrame) -> DataFrame:
        """Columns `family`, `confidence`, `confirmed` for the column `paragraph`.

        `confidence` is the calibrated chance that the most likely family is
        right; below one half the family is unknown.
        """
        ready = vectors(paragraphs, "paragraph", "_v")
        scored = once(self.regression.transform(ready).drop("_v", "_raw", "_prediction"), vector_to_array("_probability"), "_p")
        best = F.array_max(F.slice("_p", 2, len(FAMILIES) - 1))
        scored = scored.withColumn("_best", best).withColumn("_place", F.array_position("_p", F.col("_best")).cast("int"))
        rate = F.element_at(F.array(*[F.lit(r) for r in self.rates]), _bin(F.col("_best")) + 1)
        known = scored.withColumn("confidence", rate)
        family = F.when(F.col("confidence") >= 0.5, F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), F.col("_place"))).otherwise(F.lit(UNKNOWN))
        named = known.withColumn("family", family)
        covered = F.lit(None).cast("double")
        for f in FAMILIES[1:]:
            covered = F.when(F.col("family") == f, _coverage(F.col("_v_w"), f)).otherwise(covered)
        confirmed = F.coalesce(covered >= COVERAGE, F.lit(False))
        return named.withColumn("confirmed", confirmed).select(*paragraphs.columns, "family", "confidence", "confirmed")


def _bin(confidence: Column) -> Column:
    return F.least(F.floor(confidence * BINS), F.lit(BINS - 1)).cast("int")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = NEGATIVES) -> Model:
    """Calibrate on three tenths of the examples by a fit on the others, then fit on all."""
    # Written once: the fits pass over a few thousand examples many times, not over the documents.
    some = few(stored(examples(docs, id_col, text_col, bound)), bound, bound)
    rows = vectors(some, "paragraph", "_v").withColumn("_fold", F.pmod(F.xxhash64("paragraph"), F.lit(10)))
    regression = LogisticRegression(featuresCol="_v", labelCol="label", probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_prediction",
                                    family="multinomial", regParam=1e-4, maxIter=60)
    fitted = regression.fit(rows.where("_fold < 7").select("_v", "label"))
    held = fitted.transform(rows.where("_fold >= 7")).withColumn("_p", vector_to_array("_probability"))
    best = F.array_max(F.slice("_p", 2, len(FAMILIES) - 1))
    right = (F.array_position("_p", best) == F.col("label") + 1).cast("double")
    bins = {r.bin: (r.n, r.right) for r in held.select(_bin(best).alias("bin"), right.alias("right")).groupBy("bin").agg(F.count("*").alias("n"), F.sum("right").alias("right")).collect()}
    # Rates grow with confidence: adjacent bins that disagree are pooled.
    pools: list[list[float]] = []
    for b in range(BINS):
        n, good = bins.get(b, (0, 0.0))
        pools.append([1, n + 2, good + 2 * (b + 0.5) / BINS])
        while len(pools) > 1 and pools[-2][2] / pools[-2][1] > pools[-1][2] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last)]
    return Model(regression.fit(rows.select("_v", "label")), [good / n for width, n, good in pools for _ in range(int(width))])


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence paragraphs: `id`, `paragraph`, `family`, `confidence`, `confirmed`; unknown ones are left out."""
    return model.predict(paragraphs_of(docs, id_col, text_col)).where(F.col("family") != UNKNOWN)


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = NEGATIVES) -> DataFrame:
    """One row per id: paragraphs, licence paragraphs, confirmed families (sorted, comma-joined), largest confidence.

    Paragraphs are non-empty lines.  Families are those that a line or a passage
    of adjacent lines confirms; where only a passage does, it counts as one
    licence paragraph, and passages that confirm nothing do not count.
    Rows that repeat an id are one document.  A null or empty text has no
    paragraphs, no family and confidence 0; so has a text without a licence.
    """
    model = fit(docs, id_col, text_col, bound)
    every = docs.select(F.col(id_col).alias("id"), F.size(F.filter(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n"), lambda x: F.length(F.trim(x)) > 0)).alias("n"))
    none = [F.lit(0).alias("hit"), F.lit(None).cast("string").alias("family"), F.lit(0.0).alias("confidence"), F.lit(0).alias("wrapped")]
    hits = scan(docs, model, id_col, text_col).select("id", F.lit(0).alias("n"), F.lit(1).alias("hit"), F.when(F.col("confirmed"), F.col("family")).alias("family"), "confidence", F.lit(0).alias("wrapped"))
    confirmed = model.predict(passages_of(docs, id_col, text_col)).where(F.col("confirmed"))
    wrapped = confirmed.select("id", F.lit(0).alias("n"), F.lit(0).alias("hit"), "family", "confidence", F.lit(1).alias("wrapped"))
    # At most one entry for each family is gathered per document.
    out = every.select("id", "n", *none).union(hits).union(wrapped).groupBy("id").agg(
        F.sum("n").alias("n_paragraphs"), F.greatest(F.sum("hit"), F.max("wrapped")).alias("n_licence"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.max("confidence").alias("confidence")
    )
    return out.select(F.col("id").alias("doc_id"), "n_paragraphs", "n_licence", "families", "confidence")
