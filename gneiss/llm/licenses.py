"""Operator 10, licence scans by a trained paragraph classifier, with DataFrame functions and Spark ML only.

A paragraph is a line, or the lines that a hard-wrapped paragraph was broken into, without the marks of comments (see
paragraphs). Every one is classed by multinomial logistic regression over sparse word n-grams, those of the training
wordings. Classes are the licence families, "unknown" (licence wording of no family) and "none" (no licence wording).
Training rows are the wordings whole, thinned and beside prose of the corpus, and that prose. Scores are calibrated by
a temperature, chosen on wordings and prose that the fit has not seen; what falls below CONFIDENT is unknown. A family
counts as confirmed if a template of it and the paragraph hold each other's word triples to a large part, the paragraph
has all numbers of the template (its version), and no qualifier that the template has not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.common import cut, table, text_or_empty

# Public licence notices by family, the names that short notices give, and sentences around such a name.
NOTICES = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
NAMES = [
    ("AGPL-3.0", "the GNU Affero General Public License, version 3"), ("AGPL-3.0", "AGPL-3.0"),
    ("Apache-2.0", "the Apache License, Version 2.0"), ("Apache-2.0", "Apache-2.0"),
    ("BSD-2-Clause", "the BSD 2-Clause License"), ("BSD-3-Clause", "the BSD 3-Clause License"),
    ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-4.0", "a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"), ("CC-BY-NC-4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"), ("CC-BY-SA-4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "CC0 1.0"), ("CC0-1.0", "the CC0 1.0 Universal Public Domain Dedication"),
    ("GPL-2.0", "the GNU General Public License, version 2"), ("GPL-2.0", "GPL-2.0"),
    ("GPL-3.0", "the GNU General Public License, version 3"), ("GPL-3.0", "GPL-3.0"),
    ("ISC", "the ISC License"),
    ("LGPL-3.0", "the GNU Lesser General Public License, version 3"), ("LGPL-3.0", "LGPL-3.0"),
    ("MIT", "the MIT License"),
    ("MPL-2.0", "the Mozilla Public License 2.0"), ("MPL-2.0", "MPL-2.0"),
]
SENTENCES = ["Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "Distributed under the terms of {}.", "You may use this file under {}.", "The source code is available under {}."]
#: The calibration's rows: short notices of the last HELD_SENTENCES sentences, one in HELD_OF nameless wordings and pieces of prose.
HELD_SENTENCES, HELD_OF = 2, 4
TEMPLATES = [*NOTICES, *((f, s.format(n)) for f, n in NAMES for s in SENTENCES)]
HELD = {s.format(n) for _, n in NAMES for s in SENTENCES[-HELD_SENTENCES:]}
# Wording that names no family, sentences without licence wording, and stems that keep a line out of the prose.
NAMELESS = [
    "All rights reserved. Copyright by the author.", "See the license file for details.", "The license terms are stated elsewhere.", "Used with permission of the owner.",
    "A licence is needed to drive.", "This is a proprietary license; redistribution is not allowed.", "Copyright holders keep all rights.", "Licensed to the buyer under a separate agreement.",
    "Released under license of the publisher.", "Licensed under terms to be agreed.", "This work is protected by copyright.", "Version 2.0 of the license plate register.",
]
# Names of licences without a template here, which are licence wording of no family.
OTHERS = [
    "the Academic Free License 3.0", "the Artistic License 2.0", "the Boost Software License 1.0", "the Common Development and Distribution License", "the Eclipse Public License 2.0", "EPL-2.0",
    "the European Union Public Licence, version 1.2", "the EUPL, version 1.2", "EUPL-1.2", "the Open Software License 3.0", "the SIL Open Font License, Version 1.1", "OFL-1.1", "the Unlicense", "the zlib License",
]
OTHER_SENTENCES = [*SENTENCES, "{} applies to this program."]
PLAIN = ["The weather was fine, so we walked along the river.", "This is the last part of the work that we began in spring.", "All of them came to the meeting and left early.", "You may find the files of the second version in the other room."]
CUES = ["licen", "copyright", "redistribut", "permission", "public license", "creative commons"]
# Neighbouring words that make another licence of the one they stand in.
QUALIFIERS = ["by nc", "by nd", "by sa", "nc nd", "nc sa", "attribution noncommercial", "attribution noderivatives", "attribution sharealike", "noncommercial sharealike", "gnu affero", "gnu lesser", "gnu library"]
UNKNOWN, NONE = "unknown", "none"
FAMILIES = sorted({f for f, _ in TEMPLATES})
CLASSES = [*FAMILIES, UNKNOWN, NONE]
#: Documents of the corpus that training takes at most, pieces of them, words of a piece, and the model's ridge.
TRAIN_DOCS, TRAIN_PIECES, PIECE, RIDGE = 500, 600, 40, 1e-3
#: Thinned copies of a template, of a nameless wording and of a plain sentence, and groups of prose to put beside them.
COPIES, NAMELESS_COPIES, SLOTS = 3, 12, 64
CONFIDENT, ALIKE = 0.6, 0.8
TEMPERATURES = [0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0, 3.0]


#: What parts words: a character of none, those after it, and dots on either side. A dot after a dot starts no gap, so runs of dots are read once.
GAP = r"(?:[^a-z0-9.\p{L}\p{N}]|\.(?<!\.\.)\.*+[^a-z0-9.\p{L}\p{N}])[^a-z0-9.\p{L}\p{N}]*+\.*+"


def words(paragraph: Column) -> Column:
    """Lower-cased words of letters, digits and dots, without dots at their ends, which go with the gaps."""
    return F.array_remove(F.split(F.trim(F.lower(paragraph), F.lit(".")), GAP), "")


def extended(grams: Column, w: Column, n: int) -> Column:
    """The n-grams of the words w from their (n - 1)-grams: each with the word behind it. Neighbours are zipped, no array is searched."""
    fewer = F.greatest(F.size(grams) - 1, F.lit(0))
    return F.zip_with(F.slice(grams, 1, fewer), F.slice(w, n, fewer), lambda x, y: F.concat(x, F.lit(" "), y))


def pairs(w: Column) -> Column:
    return extended(w, w, 2)


def triples(w: Column) -> Column:
    return extended(pairs(w), w, 3)


def _others() -> list[str]:
    """Short notices of licences without a template."""
    return [x.format(n)[0].upper() + x.format(n)[1:] for n in OTHERS for x in OTHER_SENTENCES]


#: Characters of a line that may be wrapped: from the first on if no sentence ends with it, from the second on if one does, up to the third.
WRAPPED = (40, 60, 90)
#: Lines of a wrapped paragraph that are classed together, and how many further on the next ones begin.
MOST_LINES, NEXT_LINES = 24, 16
_OPEN = r"^[ \t]*(?:/{2,}|/\*+|\*+/|\*+|#+|;+|-{2,}|%+|<!--)[ \t]*"
_CLOSE = r"[ \t]*(?:\*+/|-->)$"
_JOINED = "\x0b"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _bare(line: Column) -> Column:
    """A line without blanks and marks of comments at its ends; patterns run only on lines that begin or end like one."""
    cut = F.when(F.substring(line, -1, 1).isin(" ", "\t", "\r"), F.rtrim(line, F.lit(" \t\r"))).otherwise(line)
    open_ = lambda x: F.when(F.substring(x, 1, 1).isin(*" \t/*#;-%<"), F.regexp_replace(x, _OPEN, "")).otherwise(x)
    close = lambda x: F.when(F.substring(x, -1, 1).isin("/", ">"), F.regexp_replace(x, _CLOSE, "")).otherwise(x)
    return close(open_(cut))


def _goes_on(line: Column, after: Column) -> Column:
    """Whether a line end is inside a paragraph."""
    low, full, most = WRAPPED
    n = F.length(line)
    return after.isNotNull() & n.between(low, most) & F.length(after).between(1, most) & ((n >= full) | ~F.substring(line, -1, 1).isin(*".!?")) & after.rlike(r"[\p{L}\p{N}]")


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text, each as an array of its lines.

    Marks of comments at the ends of lines go. A line end is inside a paragraph if the line before it is as long as
    wrapped ones are (WRAPPED: shorter ones and ones that end a sentence early end a paragraph, longer ones are not
    wrapped) and the line after it is neither blank nor longer.
    """

    def joined(bare: Column) -> Column:
        ends = F.zip_with(bare, F.slice(bare, 2, F.greatest(F.size(bare) - 1, F.lit(1))), lambda x, y: F.when(_goes_on(x, y), F.lit(_JOINED)).when(y.isNull(), F.lit("")).otherwise(F.lit("\n")))
        put = lambda e: F.transform(F.split(F.array_join(F.zip_with(bare, e, lambda x, y: F.concat(x, y)), ""), "\n"), lambda x: F.split(x, _JOINED))
        return _let(ends, lambda e: F.when(F.array_contains(e, _JOINED), put(e)).otherwise(F.transform(bare, lambda x: F.array(x))))

    return _let(F.transform(F.split(F.when(F.contains(text, F.lit(_JOINED)), F.translate(text, _JOINED, " ")).otherwise(text), "\n"), _bare), joined)


def has_cue(c: Column) -> Column:
    return F.lower(c).rlike("|".join(CUES))


def _literal_rows(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(r, names))) for r in rows))).alias("r")).select("r.*")


def training_rows(docs: DataFrame) -> DataFrame:
    """family, paragraph and held: wordings alone, thinned, and before or after prose; prose alone and with a licence word.

    Prose is at most TRAIN_PIECES pieces, from all over the lines without a cue of at most TRAIN_DOCS documents.
    """
    spark = docs.sparkSession
    some = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(TRAIN_DOCS).select("doc_id")
    lines = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(some.distinct()), "doc_id").select(F.explode(F.split("text", "\n")).alias("line")).filter(~has_cue(F.col("line")))
    w = lines.select(F.split("line", " ").alias("w"))
    pieces = w.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.lit(PIECE)), lambda i: F.array_join(F.slice("w", i + 1, PIECE), " "))).alias("piece"))
    prose = cut(pieces.filter(F.trim("piece") != "").distinct().orderBy(F.xxhash64("piece"), "piece").limit(TRAIN_PIECES))
    wordings = [(f, x, COPIES, x in HELD) for f, x in TEMPLATES]
    wordings += [(UNKNOWN, x, 1, i % HELD_OF == 0) for i, x in enumerate(_others())]
    wordings += [(UNKNOWN, x, NAMELESS_COPIES, i % HELD_OF == 0) for i, x in enumerate(NAMELESS)] + [(NONE, x, NAMELESS_COPIES, False) for x in PLAIN]
    copies = _literal_rows(spark, wordings, ["family", "paragraph", "n", "held"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("copy", F.col("copy") - 1)
    slot = lambda *c: F.pmod(F.xxhash64(*c), F.lit(SLOTS)).alias("slot")
    thin = copies.select("family", "held", slot("paragraph", "copy"), F.when(F.col("copy") == 0, F.col("paragraph")).otherwise(F.array_join(F.filter(F.split("paragraph", " "), lambda w, i: F.pmod(F.xxhash64(i, F.col("copy"), w), F.lit(12)) > 0), " ")).alias("paragraph"))
    mixed = thin.join(F.broadcast(prose.select(slot("piece"), "piece").groupBy("slot").agg(F.min("piece").alias("piece"))), "slot")
    beside = mixed.select("family", F.explode(F.array(F.concat_ws(" ", "paragraph", "piece"), F.concat_ws(" ", "piece", "paragraph"))).alias("paragraph"), "held")
    held = F.pmod(F.xxhash64("piece", F.lit("held")), F.lit(HELD_OF)) == 0
    plain = prose.select(F.lit(NONE), "piece", held).union(prose.select(F.lit(UNKNOWN), F.concat_ws(" ", "piece", F.lit("license")), held))
    return thin.select("family", "paragraph", "held").union(beside).union(plain)


class Model:
    """The n-grams that count, the regression over them, and the calibration's temperature."""

    def __init__(self, grams: CountVectorizerModel, regression: LogisticRegressionModel, temperature: float):
        self.grams, self.regression, self.temperature = grams, regression, temperature

    def margins(self, rows: DataFrame, paragraph: str) -> DataFrame:
        """rows with z, the margins by class."""
        scored = self.regression.transform(self.grams.transform(featured(rows, paragraph, self.grams)))
        return scored.withColumn("z", vector_to_array("margins")).drop("grams", "features", "margins")


def featured(rows: DataFrame, paragraph: str, counted: CountVectorizerModel | None = None) -> DataFrame:
    """rows with grams, the paragraph's words, pairs and triples. Step by step, or each gram would split the text anew.

    With counted, only grams of words that it counts: other words that follow each other are one null, and pairs and
    triples with it are null.
    """
    steps = rows.withColumn("w", words(F.col(paragraph)))
    if counted is not None:
        single = [g for g in counted.vocabulary if " " not in g]
        steps = steps.withColumn("w", F.transform("w", lambda x: F.when(x.isin(single), x)))
        steps = steps.withColumn("w", F.filter("w", lambda x, i: x.isNotNull() | F.get(F.col("w"), i - 1).isNotNull()))
    steps = steps.withColumn("two", pairs(F.col("w")))
    return steps.withColumn("grams", F.array_compact(F.flatten(F.array(F.col("w"), F.col("two"), extended(F.col("two"), F.col("w"), 3))))).drop("w", "two")


def _qualifiers(w: Column) -> Column:
    """The QUALIFIERS among the neighbouring words of w."""
    return F.array_intersect(pairs(w), F.array(*map(F.lit, QUALIFIERS)))


def fit(docs: DataFrame) -> Model:
    """A model of the wordings beside prose of docs(doc_id, text); without documents, of the wordings alone."""
    spark = docs.sparkSession
    label = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("family")).cast("double") - 1
    worded = _literal_rows(spark, [(x,) for x in [*(x for _, x in TEMPLATES), *_others(), *NAMELESS, *PLAIN]], ["paragraph"])
    counter = CountVectorizer(inputCol="grams", outputCol="features", binary=True).fit(featured(worded, "paragraph").select("grams"))
    rows = cut(training_rows(docs).select(label.alias("label"), "paragraph", "held").coalesce(2))
    logistic = LogisticRegression(family="multinomial", regParam=RIDGE, maxIter=60, featuresCol="features", labelCol="label", rawPredictionCol="margins", probabilityCol="", predictionCol="")
    fitted = counter.transform(featured(rows.filter("NOT held"), "paragraph", counter))
    model = Model(counter, logistic.fit(fitted), 1.0)
    found = model.margins(rows.filter("held"), "paragraph").agg(*(F.sum(_loss(t)).alias(f"t{i}") for i, t in enumerate(TEMPERATURES))).first()
    model.temperature = min((found[f"t{i}"], t) for i, t in enumerate(TEMPERATURES))[1]
    return model


def _loss(t: float) -> Column:
    """Negative log-likelihood of a row's label at temperature t, from its margins z."""
    return F.log(F.aggregate("z", F.lit(0.0), lambda s, x: s + F.exp(x / t))) - F.element_at("z", F.col("label").cast("int") + 1) / t


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """For each row of docs(doc_id, text): n_candidates (paragraphs of licence wording: the likeliest class is not none),
    families (confirmed ones, sorted, comma-joined), n_confirmed (families of paragraphs), n_unknown (candidates without
    one), and probability (the greatest of a confirmed paragraph, else null). Of classes equally likely, the first in
    CLASSES counts. Long wrapped paragraphs are classed in overlapping parts, and have what any part has.

    Null and empty texts have no candidates; repeated rows give a row each; an empty table gives none; other columns,
    whatever their names, are ignored.
    """
    spark = docs.sparkSession
    numbered = docs.select("doc_id", text_or_empty().alias("text")).withColumn("row", F.monotonically_increasing_id())
    blocks = numbered.select("row", "doc_id", F.posexplode(paragraphs(F.col("text"))).alias("block", "lines"))
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.size("lines") - MOST_LINES + NEXT_LINES - 1, F.lit(0)), F.lit(NEXT_LINES)), lambda i: F.array_join(F.slice("lines", i + 1, MOST_LINES), " "))
    lines = blocks.select("row", "doc_id", "block", F.explode(pieces).alias("line"))
    z = model.margins(lines, "line").withColumn("top", F.array_max("z"))
    scaled = F.transform("z", lambda x: F.exp((x - F.col("top")) / F.lit(model.temperature)))
    classed = z.withColumn("p", 1 / F.aggregate(scaled, F.lit(0.0), lambda s, x: s + x)).withColumn("likeliest", F.element_at(F.array(*map(F.lit, CLASSES)), F.array_position("z", F.col("top")).cast("int")))
    blank = ~F.col("line").rlike(r"[\p{L}\p{N}]")
    known = F.when(blank | (F.col("likeliest") == NONE), F.lit(NONE)).when(F.col("p") >= CONFIDENT, F.col("likeliest")).otherwise(F.lit(UNKNOWN))
    named = classed.select("row", "doc_id", "block", "p", known.alias("known"), "line").withColumn("w", F.when(~F.col("known").isin(UNKNOWN, NONE), words(F.col("line"))))
    compared = named.select("row", "doc_id", "block", "p", "known", _parts(F.col("w")).alias("of")).join(F.broadcast(_templates(spark)), F.col("known") == F.col("family"), "left")
    own = F.col("of")
    shared = lambda s: F.size(F.array_intersect(s["triples"], own["triples"]))
    same = lambda s: (F.size(F.array_except(s["numbers"], own["numbers"])) == 0) & (F.size(F.array_except(own["qualifiers"], s["qualifiers"])) == 0)
    near = lambda s: (shared(s) >= ALIKE * F.size(s["triples"])) | ((F.size(own["triples"]) >= 8) & (shared(s) >= ALIKE * F.size(own["triples"])))
    alike = F.coalesce(F.exists("templates", lambda s: near(s) & same(s)), F.lit(False))
    judged = compared.select("row", "doc_id", "block", "p", "known", F.when(alike, F.col("known")).alias("sure"))
    sets = judged.groupBy("row", "doc_id").agg(
        F.collect_set(F.when(F.col("known") != NONE, F.col("block"))).alias("candidates"), F.collect_set(F.when(F.col("sure").isNotNull(), F.struct("block", "sure"))).alias("found"), F.max(F.when(F.col("sure").isNotNull(), F.col("p"))).alias("probability"),
    )
    return sets.select(
        "doc_id", F.size("candidates").cast("long").alias("n_candidates"), F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda s: s["sure"]))), ",").alias("families"), F.size("found").cast("long").alias("n_confirmed"),
        F.size(F.array_except("candidates", F.transform("found", lambda s: s["block"]))).cast("long").alias("n_unknown"), "probability",
    )


def _parts(w: Column) -> Column:
    """What the comparison takes of words: triples, numbers and qualifiers; null words have none."""
    return F.when(w.isNotNull(), F.struct(F.array_distinct(triples(w)).alias("triples"), F.filter(w, lambda x: x.rlike(r"^[0-9.]+$")).alias("numbers"), _qualifiers(w).alias("qualifiers")))


def _templates(spark: SparkSession) -> DataFrame:
    rows = _literal_rows(spark, TEMPLATES, ["family", "template"]).select("family", words(F.col("template")).alias("w"))
    return rows.groupBy("family").agg(F.collect_list(_parts(F.col("w"))).alias("templates"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan of all documents by a model fitted on templates and prose of them; edge cases as there."""
    docs = table(spark, sf_dir, "documents")
    return scan(docs, fit(docs))
