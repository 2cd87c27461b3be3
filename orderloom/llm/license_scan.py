"""Licence notices in documents: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are the lines of a text. Each becomes a sparse vector of marks: the words and word pairs of the templates
that it has, and its number of words by powers of two. A multinomial logistic regression gives the probability of each
licence family and of ``unknown``. It is trained on the templates below and, as ``unknown``, on every paragraph of the
corpus that contains no template. Paragraphs with the same marks have the same vector, so they are trained on once with
their number as weight. All of these paragraphs calibrate the unknown class, too: a family is only reported from
the probability that at most ``FALSE_SHARE`` of them reach. A prediction is confirmed if the paragraph contains at least
``SIMILARITY`` of the word pairs of some template of the family. DataFrame functions and pipelines only.

Defined results: a null or empty text has no paragraphs; lines without words have none either; rows that
repeat an identifier are scanned each; an empty table gives an empty table; other columns are not read,
whatever their names.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, NGram, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm.common import stored

# The usual wording of notices, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License.",
        "Apache License Version 2.0, January 2004",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is released under the Apache 2.0 license.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "Licensed under CC BY-NC-ND 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
        "Released under the GNU GPL v2 or later.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "Released under the LGPL.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction.",
        "The MIT License (MIT)",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright by the authors. All rights reserved.",
        "No part of this publication may be reproduced or distributed without the prior written permission of the "
        "publisher.",
        "This document is confidential and proprietary.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work (CC0 1.0).",
        "This work is in the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
        "Released under CC0.",
    ),
}
FAMILIES = ("unknown", *TEMPLATES)

#: Share of the unknown paragraphs that may be taken for licences, the least probability, and the steps between
#: the probabilities that are tried.
FALSE_SHARE, LEAST_PROBABILITY, STEPS = 0.0005, 0.5, 10_000
#: Share of a template's word pairs that a paragraph must contain.
SIMILARITY = 0.6
#: The share of the unknown paragraphs that a template weighs in training, however many they are.
TEMPLATE_SHARE = 0.005
#: Lengths are told apart up to this power of two.
LONGEST = 12


def _templates(spark: SparkSession) -> DataFrame:
    """(label, text) of the templates."""
    rows = [
        F.struct(F.lit(FAMILIES.index(family)).alias("label"), F.lit(text).alias("line"))
        for family, texts in TEMPLATES.items()
        for text in texts
    ]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.label", "t.line")


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, paragraph, line) of the lines that have a letter or digit."""
    lines = F.split(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), "\n", -1)
    return (
        docs.select(F.col(f"`{id_col}`").alias("id"), F.posexplode(lines).alias("paragraph", "line"))
        .where(F.col("line").rlike(r"[\p{L}\p{N}]"))
    )


def _worded(lines: DataFrame) -> DataFrame:
    """``lines`` with words and pairs. Neither step has to be fitted."""
    words = RegexTokenizer(inputCol="line", outputCol="words", pattern=r"[^\p{L}\p{N}]+")
    return NGram(n=2, inputCol="words", outputCol="pairs").transform(words.transform(lines))


def _length_marks(words: Column) -> Column:
    """A mark for each power of two that the number of words reaches."""
    power = F.least(F.floor(F.log2(F.greatest(F.size(words), F.lit(1)))).cast("int"), F.lit(LONGEST))
    return F.transform(F.sequence(F.lit(0), power), lambda k: F.concat(F.lit("#"), k.cast("string")))


def _marked(lines: DataFrame, terms: list[str]) -> DataFrame:
    """``lines`` with words, pairs and marks; equal sets of marks are equal arrays."""
    known = F.filter(F.concat("words", "pairs"), lambda g: g.isin(terms))
    return _worded(lines).withColumn("marks", F.concat(F.array_sort(F.array_distinct(known)), _length_marks(F.col("words"))))


def _featured(marked: DataFrame, terms: list[str]) -> DataFrame:
    """The vector of the marks. The vocabulary is given, so nothing has to be fitted."""
    vocabulary = [*terms, *(f"#{k}" for k in range(LONGEST + 1))]
    return CountVectorizerModel.from_vocabulary(vocabulary, inputCol="marks", outputCol="features").transform(marked)


def _some(lines: DataFrame, n: int) -> DataFrame:
    """About n paragraphs chosen by hash."""
    chosen = F.xxhash64("id", "paragraph", F.lit("licence sample"))
    share = min(1.0, n / max(1, lines.count()))
    return lines.where(F.pmod(chosen, F.lit(1 << 24)) < int(share * (1 << 24)))


def _unknown(lines: DataFrame, templates: list[tuple[list[str], list[str]]], terms: list[str]) -> DataFrame:
    """(marks, n): how many paragraphs have the marks, without those that contain a template: they are
    no examples of the unknown class."""
    counted = _marked(lines, terms).groupBy("marks").agg(F.count("*").alias("n"))
    pairs = F.filter("marks", lambda m: m.contains(" "))
    contained = _largest_share(pairs, [p for _, p in templates if p])
    return stored(counted.where(contained < SIMILARITY / 2), "licence-unknown")


def _largest_share(pairs: Column, templates: list[list[str]]) -> Column:
    """The same as ``_containment`` of all templates, for distinct pairs that are all in some template."""
    of: dict[str, list[int]] = {}
    for number, template in enumerate(templates):
        for pair in template:
            of.setdefault(pair, []).append(number)
    numbers = F.map_from_arrays(F.array(*map(F.lit, of)), F.array(*(F.array(*map(F.lit, n)) for n in of.values())))
    sizes = F.array(*(F.lit(len(t)) for t in templates))

    def largest(hits: Column) -> Column:
        share = F.transform(F.array_distinct(hits), lambda t: F.size(F.filter(hits, lambda h: h == t)) / F.get(sizes, t))
        return F.coalesce(F.array_max(share), F.lit(0.0))

    return F.transform(F.array(F.flatten(F.transform(pairs, lambda p: numbers[p]))), largest)[0]


def _containment(pairs: Column, templates: Column) -> Column:
    """The largest share of a template's word pairs that the paragraph has."""
    share = F.transform(templates, lambda t: F.size(F.array_intersect(t, pairs)) / F.size(t))
    return F.coalesce(F.array_max(share), F.lit(0.0))


def _template_pairs(spark: SparkSession) -> DataFrame:
    """(label, templates as arrays of word pairs): a row per family."""
    worded = _worded(_templates(spark)).select("label", F.array_distinct("pairs").alias("pairs"))
    return worded.groupBy("label").agg(F.collect_list("pairs").alias("templates"))


def _terms_of_templates(spark: SparkSession) -> list[tuple[list[str], list[str]]]:
    """The words and the word pairs of every template; as many as there are fixed values."""
    found = _worded(_templates(spark)).select(F.array_distinct("words").alias("words"), F.array_distinct("pairs").alias("pairs"))
    return [(row["words"], row["pairs"]) for row in found.collect()]


class LicenceModel:
    """A trained classifier, the terms it knows, and the probability from which it names a family."""

    def __init__(self, model: PipelineModel, terms: list[str], least: float):
        self.model, self.terms, self.least = model, terms, least

    def predict(self, lines: DataFrame) -> DataFrame:
        """``lines`` with words, pairs, label and probability; label 0 if unknown."""
        return self.classify(_marked(lines, self.terms)).drop("marks")

    def classify(self, marked: DataFrame) -> DataFrame:
        """Rows with marks, with label and probability."""
        p = vector_to_array("probability")
        scored = self.model.transform(_featured(marked, self.terms)).withColumn("p", p)
        best = F.slice("p", 2, len(FAMILIES) - 1)
        return (
            scored.withColumn("probability", F.array_max(best))
            .withColumn("label", F.array_position(best, F.col("probability")).cast("int"))
            .withColumn("label", F.when(F.col("probability") >= self.least, F.col("label")).otherwise(0))
            .drop("features", "rawPrediction", "prediction", "p")
        )


def _least_probability(scored: DataFrame, n_unknown: int) -> float:
    """The least of the probabilities tried that at most ``FALSE_SHARE`` of the unknown paragraphs reach; 1 if none is."""
    step = F.floor(F.col("probability") * STEPS).cast("int")
    first = round(LEAST_PROBABILITY * STEPS)
    # A row per step.
    reached = {r["step"]: r["n"] for r in scored.groupBy(step.alias("step")).agg(F.sum("n").alias("n")).where(f"step >= {first}").collect()}
    above = sum(reached.values())
    for tried in range(first, STEPS):
        if above <= FALSE_SHARE * n_unknown:
            return tried / STEPS
        above -= reached.get(tried, 0)
    return 1.0


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int | None = None) -> LicenceModel:
    """A model of the whole corpus, or of about ``sample`` of its paragraphs where a caller asks for that."""
    spark = docs.sparkSession
    lines = paragraphs(docs, id_col, text_col)
    templates = _terms_of_templates(spark)
    terms = sorted({term for words, pairs in templates for term in (*words, *pairs)})
    unknown = _unknown(lines if sample is None else _some(lines, sample), templates, terms)
    n_unknown = unknown.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # There are far fewer templates than unknown paragraphs.
    known = _marked(_templates(spark), terms).select("label", "marks", F.lit(max(1.0, TEMPLATE_SHARE * n_unknown)).alias("weight"))
    rows = known.unionByName(unknown.select(F.lit(0).alias("label"), "marks", F.col("n").cast("double").alias("weight")))
    regression = LogisticRegression(family="multinomial", regParam=1e-4, maxIter=30, weightCol="weight")
    model = Pipeline(stages=[regression]).fit(_featured(rows, terms))
    scored = LicenceModel(model, terms, 0.0).classify(unknown)
    return LicenceModel(model, terms, _least_probability(scored, n_unknown))


def scan(docs: DataFrame, model: LicenceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per paragraph that the model takes for a notice: id, paragraph, family, probability,
    similarity (largest share of a template's word pairs), confirmed, line."""
    found = model.predict(paragraphs(docs, id_col, text_col)).where("label > 0")
    names = F.array(*(F.lit(f) for f in FAMILIES))
    # A row per family.
    compared = found.join(F.broadcast(_template_pairs(docs.sparkSession)), "label")
    similarity = _containment(F.col("pairs"), F.col("templates"))
    return compared.select(
        F.col("id").alias(id_col),
        F.col("paragraph").cast("long").alias("paragraph"),
        F.element_at(names, F.col("label") + 1).alias("family"),
        "probability",
        similarity.alias("similarity"),
        (similarity >= SIMILARITY).alias("confirmed"),
        "line",
    )
