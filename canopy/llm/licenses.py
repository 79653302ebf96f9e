"""Licence scan: a trained paragraph classifier, in DataFrame functions only.

Paragraphs (lines of a text) are classed into licence families, an *unknown* class for notices
of no known family, and *none*, by multinomial logistic regression over the presence of word
unigrams and bigrams. Its temperature is calibrated on labelled rows kept out of the fit, and a
prediction is confirmed by comparing the paragraph with the texts of the predicted family.

Features are the word n-grams of the notices that hold at least one word that is rare in the
corpus. A paragraph without such a word has no feature and is *none*, so a test for shared words
stands in front of everything else, and the scan needs no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.session import materialize

NONE, UNKNOWN = "none", "unknown"
#: Bounds of the training sample of the corpus: documents looked at, paragraphs taken.
SAMPLE_DOCS = 1_000
SAMPLE_PARAGRAPHS = 3_000
#: A word of a notice is common if this share of the sampled paragraphs holds it.
COMMON = 0.01
#: Below this calibrated probability a family is not named.
SURE = 0.5
#: Shares of the words that paragraph and family text must have in common: of the shorter of both.
CONFIRM = 0.6
TEMPERATURES = (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)

# Short notices of public licences and notices that name none (fixed values).
NOTICES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
        " files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy,"
        " modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    ),
    "Apache": (
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the"
        " License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Released under the terms of the Apache License 2.0 by the Apache Software Foundation.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as"
        " published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Released under the GNU GPL v2.",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "You can redistribute this library and/or modify it under the terms of the GNU Lesser General Public License.",
    ),
    "AGPL": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License.",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
        " conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the"
        " following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "CC0": (
        "To the extent possible under law, the author has dedicated all copyright to this work to the public domain under CC0 1.0.",
        "SPDX-License-Identifier: CC0-1.0",
        "Released into the public domain under the Unlicense.",
    ),
    UNKNOWN: (
        "All rights reserved.",
        "Copyright 2020 by the author. All rights reserved.",
        "This software is licensed under a proprietary license agreement.",
        "Use of this product is subject to the terms of the accompanying license agreement.",
        "Unauthorized copying of this file is strictly prohibited.",
        "Distributed under a custom license, see the license file.",
        "The license terms are stated in the documentation.",
    ),
}

_WEAK_LABEL = r"(?i)licen[cs]|copyright|rights reserved|public domain"


def word_list(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def grams(words: Column) -> Column:
    """Distinct words and pairs of neighbours."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.concat(words, F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>"))))


def constant(values: list[str]) -> Column:
    """A constant array of texts without line breaks."""
    return F.split(F.lit("\n".join(values)), "\n")


def paragraphs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, paragraph, body): the lines of each text, numbered from 0. Null texts have none."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.col(text), "\n")).alias("paragraph", "body"))


def notices(spark: SparkSession) -> DataFrame:
    rows = [(family, k, body) for family, bodies in NOTICES.items() for k, body in enumerate(bodies)]
    return spark.createDataFrame(rows, "family string, number int, body string")


def labelled(spark: SparkSession, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(family, words, held): notices, whole and without one word that other families use too, and sampled paragraphs.

    The sample of the corpus is at most SAMPLE_PARAGRAPHS lines of at most about SAMPLE_DOCS texts, chosen
    by a hash; lines that speak of licences or copyright are left out. A quarter of the rows,
    chosen by a hash of their words, is held out for the calibration.
    """
    whole, _ = materialize(notices(spark).select("family", word_list(F.col("body")).alias("words")), "notices")
    used = whole.select("family", F.explode("words").alias("word")).groupBy("word").agg(F.count_distinct("family").alias("_n"))
    shared = constant(sorted(r["word"] for r in used.where("_n > 1").collect()))
    without = F.transform(
        F.filter(F.sequence(F.lit(0), F.size("words")), lambda k: (k == 0) | F.array_contains(shared, F.get("words", k - 1))),
        lambda k: F.filter(F.col("words"), lambda w, i: i != k - 1),
    )
    notes = whole.select("family", F.explode(without).alias("words")).where(F.size("words") > 1).distinct()
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    # Hashed by the text as well, so that a repeated id does not decide for many rows.
    chosen = docs.where(F.pmod(F.xxhash64(doc_id, text), F.lit(1_000_000)) < int(1_000_000 * share))
    lines = paragraphs(chosen, doc_id, text).where((F.trim("body") != "") & ~F.col("body").rlike(_WEAK_LABEL))
    lines = lines.select("body").distinct().orderBy(F.xxhash64("body")).limit(SAMPLE_PARAGRAPHS)
    plain = lines.select(F.lit(NONE).alias("family"), word_list(F.col("body")).alias("words"))
    # One line without words stands for an empty corpus.
    empty = spark.createDataFrame([(NONE, [""])], "family string, words array<string>")
    rows = notes.unionByName(plain).unionByName(empty)
    held = (F.pmod(F.xxhash64("words"), F.lit(4)) == 0) & (F.col("words") != F.array(F.lit("")))
    return materialize(rows.withColumn("held", held), "labelled")[0]


class Model:
    """Weights by gram, classes, temperature, and the rare words that any gram holds one of."""

    def __init__(self, classes: list[str], intercept: list[float], weights: dict[str, list[float]], rare: list[str], temperature: float):
        self.classes, self.intercept, self.weights = classes, intercept, weights
        self.rare, self.temperature = rare, temperature

    def margins(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``_margins`` of the classes, in the order of ``classes``, for their ``words``."""
        # One SQL text that Spark folds into a constant; grams hold letters, digits and blanks only.
        entries = (f"'{g}', array({', '.join(f'{x:.17g}D' for x in w)})" for g, w in sorted(self.weights.items()))
        table = F.expr(f"map({', '.join(entries)})")
        start = F.array(*[F.lit(float(x)) for x in self.intercept])
        add = lambda acc, g: F.zip_with(acc, F.element_at(table, g), lambda a, b: a + b)
        # One column per step: an expression used twice would be worked out twice.
        found = rows.withColumn("_grams", grams(F.col("words")))
        found = found.withColumn("_found", F.array_intersect("_grams", constant(sorted(self.weights))))
        return found.withColumn("_margins", F.aggregate("_found", start, add)).drop("_grams", "_found")


def probabilities(rows: DataFrame, temperature: Column) -> DataFrame:
    """``rows`` with ``_p``, the class probabilities of their ``_margins`` at a temperature."""
    rows = rows.withColumn("_most", F.array_max("_margins")).withColumn("_heat", temperature)
    rows = rows.withColumn("_powers", F.transform("_margins", lambda m: F.exp((m - F.col("_most")) / F.col("_heat"))))
    rows = rows.withColumn("_total", F.aggregate("_powers", F.lit(0.0), lambda a, b: a + b))
    return rows.withColumn("_p", F.transform("_powers", lambda x: x / F.col("_total"))).drop("_most", "_heat", "_powers", "_total")


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fits the classifier on the labelled rows and calibrates its temperature on the held-out ones."""
    spark = docs.sparkSession
    rows = labelled(spark, docs, doc_id, text)
    plain = rows.where(F.col("family") == NONE)
    n_plain = plain.count()
    common = plain.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").count()
    common = common.where(F.col("count") > COMMON * n_plain).select("word")
    notes = rows.where(F.col("family") != NONE)
    rare = notes.select(F.explode("words").alias("word")).distinct().join(common, "word", "left_anti")
    # Words and grams of the notices only: their number does not depend on the corpus.
    rare_words = sorted(r["word"] for r in rare.collect() if not r["word"].isdigit())
    with_rare = F.arrays_overlap(F.split("gram", " "), constant(rare_words))
    vocabulary = sorted(r["gram"] for r in notes.select(F.explode(grams(F.col("words"))).alias("gram")).distinct().where(with_rare).collect())
    classes = sorted(NOTICES) + [NONE]
    number = reduce(lambda acc, k: F.when(F.col("family") == classes[k], F.lit(float(k))).otherwise(acc), range(len(classes)), F.lit(None))
    counter = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features", minTF=None, binary=True)
    ready = counter.transform(rows.withColumn("grams", grams(F.col("words"))).withColumn("label", number))
    size = ready.groupBy("label").count().withColumnRenamed("count", "_n")
    ready = ready.join(F.broadcast(size), "label").withColumn("weight", 1 / F.sqrt("_n"))
    fit = LogisticRegression(family="multinomial", regParam=0.0005, maxIter=40, weightCol="weight").fit(ready.where("NOT held").coalesce(2))
    matrix = fit.coefficientMatrix.toArray()
    intercept = [float(x) for x in fit.interceptVector.toArray()]
    model = Model(classes, intercept, {g: matrix[:, k].tolist() for k, g in enumerate(vocabulary)}, rare_words, 1.0)
    model.temperature = _calibrated(model, rows.where("held"), classes)
    return model


def _calibrated(model: Model, rows: DataFrame, classes: list[str]) -> float:
    """The temperature with the least mean log loss over the held-out rows, classes weighing alike."""
    margins, _ = materialize(model.margins(rows).select("family", "_margins"), "margins")
    each = margins.withColumn("_t", F.explode(F.array(*[F.lit(t) for t in TEMPERATURES])))
    at = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("family")).cast("int")
    loss = -F.log(F.greatest(F.element_at("_p", at), F.lit(1e-12)))
    per_class = probabilities(each, F.col("_t")).groupBy("_t", "family").agg(F.avg(loss).alias("_loss"))
    best = per_class.groupBy("_t").agg(F.avg("_loss").alias("_loss")).orderBy("_loss", "_t").first()
    return best["_t"] if best else 1.0


def scan(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per paragraph that is taken for a licence notice.

    doc_id, paragraph, family (``unknown`` if no family reaches SURE), probability, similarity (words
    shared with the family's closest notice, as a share of the shorter of both) and confirmed.
    Null and empty texts have no notices; repeated rows are scanned one by one.
    """
    spark = docs.sparkSession
    lines = paragraphs(docs, doc_id, text).withColumn("words", word_list(F.col("body")))
    maybe = lines.where(F.arrays_overlap("words", constant(model.rare)))
    # Written down, so that no later filter is pushed into the scan together with the classifier.
    classed, _ = materialize(model.margins(maybe).select("doc_id", "paragraph", "words", "_margins"), "margins")
    scored = probabilities(classed, F.lit(float(model.temperature))).withColumn("probability", F.array_max("_p"))
    top = F.element_at(F.array(*[F.lit(c) for c in model.classes]), F.array_position("_p", F.col("probability")).cast("int"))
    named = scored.withColumn("_top", top).where(F.col("_top") != NONE)
    known = (
        notices(spark).select("family", F.array_distinct(word_list(F.col("body"))).alias("_w"))
        .groupBy("family").agg(F.collect_list("_w").alias("_texts"))
    )
    own = F.array_distinct("words")
    alike = F.array_max(F.transform("_texts", lambda t: F.size(F.array_intersect(own, t)) / F.least(F.size(own), F.size(t))))
    compared = named.join(F.broadcast(known.withColumnRenamed("family", "_top")), "_top").withColumn("similarity", alike)
    sure = F.col("probability") >= SURE
    return compared.select(
        "doc_id", "paragraph",
        F.when(sure, F.col("_top")).otherwise(F.lit(UNKNOWN)).alias("family"),
        "probability", "similarity",
        (sure & (F.col("_top") != UNKNOWN) & (F.col("similarity") >= CONFIRM)).alias("confirmed"),
    )
