"""Licence scans with DataFrame and SQL functions only: a trained paragraph classifier.

1. Training paragraphs are the templates below and windows of them, bare and inside ordinary
   text, against paragraphs of the corpus that are like no template, whatever words they have (at
   most ``ordinary_rows`` of about ``sample_documents`` documents, documented bounds), and
   sentences that use licence words for something else.
2. Words and word pairs are hashed into a sparse vector and an L1-penalized multinomial logistic
   regression tells the families and the unknown class apart.
3. The probabilities are calibrated by a temperature that is fitted on held-out scores: a third of
   the templates is held out whole, so the scored paragraphs are of wordings that the model has
   not seen.  The final model is fitted on all.
4. A family below ``least`` is unknown.  A prediction is confirmed if the paragraph shares enough
   word pairs with a template of the family; one that is not is reported as unknown.

Paragraphs are the parts of a text between newlines, and every one with a word is classified: by windows of
``WINDOW`` words that start every ``STEP`` words, so that a notice inside a long paragraph counts as it would
alone (any ``WINDOW - STEP`` words in a row are inside one window).  A paragraph has the result of its best window: a confirmed
one first, then one of a family, then the higher probability, then the earlier.
Reported are paragraphs of a family and those with an anchor word (which may be unknown); one of several
windows without an anchor word only if a window is confirmed, as one of many may look like a family by chance.

Defined cases: null and empty texts have no paragraphs to report.  Repeated rows each report
theirs.  Very long texts are read whole, and a very long paragraph is one paragraph of many windows.  Of equal
probabilities the first class in order wins.  An empty table gives an empty result.  Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Short reference wordings of each family, as used in notices.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "MIT License",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY",
        "SPDX-License-Identifier: MIT",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Distributed under the GPL, version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "bsd": (
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "isc": (
        "ISC License",
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "epl": (
        "Eclipse Public License - v 2.0",
        "Licensed under the Eclipse Public License, version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "boost": (
        "Boost Software License - Version 1.0",
        "Distributed under the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Released into the public domain under the Unlicense license.",
    ),
    "cc_by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc_by_sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc_by_nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc0": (
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work (CC0).",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this publication may be reproduced without permission.",
        "This document is confidential and proprietary; no licence is granted.",
    ),
}
#: Sentences that use anchor words for something else.
OTHER_SENSES = (
    "He lost his driving licence after the accident.",
    "The court discussed copyright law and its history.",
    "The city gave permission for the parade on Sunday.",
    "Civil rights were debated in the public square.",
    "The apache helicopter landed near the village.",
    "Students at MIT built a creative robot.",
    "The warranty covers parts and labour for two years.",
    "A fishing license costs ten dollars in this county.",
    "The public library is open until six.",
    "She wrote about animal rights and general welfare.",
    "The license plate was reported to the police.",
    "Please cc the general manager on that message.",
)
#: Paragraphs with one of these words are reported even if unknown.
ANCHORS = (
    "license", "licence", "licensed", "licenses", "copyright", "rights", "permission", "permitted", "redistribute", "redistribution",
    "gnu", "gpl", "lgpl", "agpl", "mit", "bsd", "apache", "mozilla", "mpl", "cc", "cc0", "creative", "spdx", "warranty", "public", "eclipse", "boost", "unlicense",
)
UNKNOWN = "unknown"
#: Words of a window (longer than any template) and from one to the next.
WINDOW, STEP = 48, 24
FEATURES = 1 << 13
#: Templates are dealt to so many folds, of which one is held out for the calibration.
FOLDS, HELD_OUT = 3, 1
TEMPERATURES = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0)
#: A corpus paragraph that shares this part of its pairs with a template does not train the unknown class.
ALIKE = 0.3


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def pairs(w: str) -> Column:
    """The distinct word pairs of the words in column ``w``."""
    return F.array_distinct(F.expr(f"CASE WHEN size({w}) >= 2 THEN transform(sequence(0, size({w}) - 2), i -> concat({w}[i], ' ', {w}[i + 1])) ELSE cast(array() AS array<string>) END"))


def once(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed a single time."""
    return F.element_at(F.transform(F.array(value), use), 1)


def literal_rows(spark: SparkSession, rows: list[tuple], names: tuple[str, ...]) -> DataFrame:
    one = spark.range(1).select(F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(r, names, strict=True))) for r in rows))).alias("r"))
    return one.select("r.*")


def templates(spark: SparkSession) -> DataFrame:
    rows = [(f, t, i % FOLDS) for f, texts in TEMPLATES.items() for i, t in enumerate(texts)]
    return literal_rows(spark, rows, ("family", "template", "fold")).withColumn("w", words(F.col("template"))).withColumn("pairs", pairs("w")).drop("w")


def shared(p: str | Column, t: Column) -> Column:
    """Part of the smaller set of pairs that the other one has too."""
    p = F.col(p) if isinstance(p, str) else p
    return F.size(F.array_intersect(p, t)) / F.greatest(F.least(F.size(p), F.size(t)), F.lit(1))


def featured(df: DataFrame) -> DataFrame:
    """With ``features``, the hashed words and word pairs of column ``w``."""
    rows = NGram(n=2, inputCol="w", outputCol="_two").transform(df).withColumn("_grams", F.concat("w", "_two"))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="_grams", outputCol="features").transform(rows).drop("_two", "_grams")


def training_paragraphs(docs: DataFrame, key: str, text: str, ordinary_rows: int, sample_documents: int) -> DataFrame:
    """``family, paragraph, fold``: template windows alone and inside ordinary words, and unknown paragraphs."""
    spark = docs.sparkSession
    part = min(1.0, sample_documents / max(1, docs.count()))
    some = docs.where(F.pmod(F.xxhash64(key, text), F.lit(1 << 20)) < int(part * (1 << 20)))
    known = templates(spark).agg(F.collect_list("pairs").alias("known"))  # one row, the templates above
    plain = some.select(F.explode(F.split(F.col(text), "\n")).alias("paragraph")).where(F.length(F.trim("paragraph")) > 0).distinct()
    plain = plain.withColumn("w", words(F.col("paragraph"))).withColumn("pairs", pairs("w"))
    plain = plain.join(F.broadcast(known)).where(F.forall("known", lambda t: shared("pairs", t) < ALIKE))
    order = F.xxhash64("paragraph")
    plain = plain.select(F.lit(UNKNOWN).alias("family"), "paragraph").orderBy(order, "paragraph").limit(ordinary_rows)  # of the sample
    plain = plain.withColumn("fold", F.pmod(order, F.lit(FOLDS)).cast("int"))
    other = literal_rows(spark, [(UNKNOWN, t, i % FOLDS) for i, t in enumerate(OTHER_SENSES)], ("family", "paragraph", "fold"))
    cut = templates(spark).select("family", "fold", F.split("template", " ").alias("t"))
    # leave out up to a quarter of the words at either end
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.floor(F.size("t") / 4).cast("int"))).alias("a"))
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.floor(F.size("t") / 4).cast("int"))).alias("b"))
    bare = cut.select("family", F.array_join(F.expr("slice(t, a + 1, size(t) - a - b)"), " ").alias("paragraph"), "fold").distinct()
    around = literal_rows(spark, [("Notice:", ""), ("Acme tools 1.2,", "See the file for details."), ("Copyright 2021 The Authors.", "Thank you for reading.")], ("before", "after"))
    inside = bare.join(F.broadcast(around)).select("family", F.concat_ws(" ", "before", "paragraph", "after").alias("paragraph"), "fold")  # three fixed frames
    return plain.unionByName(other).unionByName(bare).unionByName(inside)


def softmax(raw: Column, temperature: float) -> Column:
    scaled = F.transform(raw, lambda x: x / temperature)
    top = F.array_max(scaled)
    powers = F.transform(scaled, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda s, y: s + y))


def fit(rows: DataFrame) -> LogisticRegressionModel:
    """A few thousand short rows; the model computes raw scores only."""
    model = LogisticRegression(family="multinomial", regParam=0.0005, elasticNetParam=0.5, maxIter=40, maxBlockSizeInMB=8.0).fit(rows.coalesce(1))
    return model.setProbabilityCol("").setPredictionCol("")


def train(docs: DataFrame, key: str, text: str, ordinary_rows: int, sample_documents: int, scratch: C.Scratch) -> tuple[LogisticRegressionModel, list[str], float]:
    """The model, its classes in order and the temperature."""
    names = [UNKNOWN, *TEMPLATES]
    label = F.element_at(F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (n, float(i)))), F.col("family")).alias("label")
    rows = scratch.table(training_paragraphs(docs, key, text, ordinary_rows, sample_documents), "license-training")
    rows = scratch.table(featured(rows.withColumn("w", words(F.col("paragraph")))).select(label, "features", "fold"), "license-features")
    held = F.col("fold") == HELD_OUT
    scored = fit(rows.where(~held)).transform(rows.where(held)).select("label", vector_to_array("rawPrediction").alias("raw"))
    p = lambda t: F.element_at(softmax(F.col("raw"), t), F.col("label").cast("int") + 1)
    loss = scored.agg(*(F.avg(-F.log(F.greatest(p(t), F.lit(1e-12)))).alias(f"t{i}") for i, t in enumerate(TEMPERATURES))).first()
    best = min(range(len(TEMPERATURES)), key=lambda i: loss[i] if loss[i] is not None else abs(TEMPERATURES[i] - 1))
    return fit(rows), names, TEMPERATURES[best]


def windowed(w: Column) -> Column:
    """The words in windows; all of them in one if they fit."""
    last = F.greatest(F.ceil((F.size(w) - WINDOW) / STEP).cast("int"), F.lit(0)) * STEP
    return F.transform(F.sequence(F.lit(0), last, F.lit(STEP)), lambda i: F.slice(w, i + 1, WINDOW))


def classified(docs: DataFrame, model: LogisticRegressionModel, key: str, text: str) -> DataFrame:
    """Every window that has an anchor word or that the model finds to be of a family: the number of its row, paragraph and place, words and raw scores."""
    parts = docs.select(key, F.monotonically_increasing_id().alias("_row"), F.posexplode(F.split(text, "\n")).alias("paragraph", "_line"))
    parts = parts.select(key, "_row", "paragraph", words(F.col("_line")).alias("_words"))
    several = (F.size("_words") > WINDOW).alias("several")
    parts = parts.select(key, "_row", "paragraph", several, F.posexplode(windowed(F.col("_words"))).alias("window", "w"))
    raw = vector_to_array(F.col("rawPrediction")).alias("raw")
    anchor = F.arrays_overlap("w", F.array(*(F.lit(a) for a in ANCHORS))).alias("anchor")
    # the number of the task keeps the filter above this projection, so that scores are computed once
    scored = model.transform(featured(parts)).select(key, "_row", "paragraph", "several", "window", "w", raw, anchor, F.spark_partition_id().alias("_task"))
    return scored.where((F.size("w") > 0) & (F.col("anchor") | once(F.col("raw"), lambda x: F.array_max(x) > x[0]))).drop("_task")


def scan_licenses(
    docs: DataFrame, least: float = 0.5, similar: float = 0.6, ordinary_rows: int = 2000, sample_documents: int = 1000, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per paragraph with an anchor or of a family: id, ``paragraph`` number, ``license`` (family or unknown),
    ``predicted``, calibrated ``probability``, ``similarity`` to the closest template of the family and ``confirmed``."""
    spark = docs.sparkSession
    scratch = C.Scratch(spark)
    texts = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    model, names, temperature = train(texts, key, "_text", ordinary_rows, sample_documents, scratch)
    classes = F.array(*(F.lit(n) for n in names))
    scored = classified(texts, model, key, "_text").withColumn("p", softmax(F.col("raw"), temperature))
    scored = scored.withColumn("probability", F.array_max("p")).withColumn("predicted", F.element_at(classes, F.array_position("p", F.col("probability")).cast("int")))
    scored = scored.withColumn("pairs", pairs("w")).drop("w", "p", "raw")
    known = templates(spark).groupBy("family").agg(F.collect_list("pairs").alias("known"))  # the templates above
    joined = scored.join(F.broadcast(known), F.col("predicted") == F.col("family"), "left")
    joined = joined.withColumn("similarity", F.coalesce(F.array_max(F.transform("known", lambda t: shared("pairs", t))), F.lit(0.0)))
    confirmed = (F.col("predicted") != UNKNOWN) & (F.col("probability") >= least) & (F.col("similarity") >= similar)
    value = F.struct(confirmed.alias("confirmed"), (F.col("predicted") != UNKNOWN).alias("family"), "probability", (-F.col("window")).alias("place"), "predicted", "similarity")
    # only windows with an anchor or a family are grouped, a paragraph's with a map-side part
    best = joined.groupBy("_row", "paragraph").agg(F.first(key).alias(key), F.max(value).alias("b"), F.max("anchor").alias("anchor"), F.max("several").alias("several"))
    best = best.where(F.col("anchor") | F.col("b.confirmed") | ~F.col("several"))
    return best.select(
        key, F.col("paragraph").cast("long").alias("paragraph"), F.when(F.col("b.confirmed"), F.col("b.predicted")).otherwise(F.lit(UNKNOWN)).alias("license"),
        "b.predicted", F.round("b.probability", 4).alias("probability"), F.round("b.similarity", 4).alias("similarity"), "b.confirmed",
    )
