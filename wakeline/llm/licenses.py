"""Licence scans with a trained paragraph classifier, with DataFrame functions only.

A multinomial logistic regression over sparse word 1- and 2-grams is trained on paragraphs made
from public licence notices and on all lines of the corpus' own paragraphs as the
class ``unknown``. Paragraphs that hold ``CONFIRM`` of a notice are no background: they
neither teach ``unknown`` nor make a notice's words common, so a licence is found however many
documents have it. Features are the notices' words that are rare in the background (of each notice
at least the ``ANCHORS`` rarest, whatever their rate) and the pairs that hold such a word. A family is
predicted if its probability passes a threshold calibrated on the held-out half of all lines, and
confirmed if the paragraph holds enough of a notice of that family, the words that tell the family
from its neighbours (``TELLS``: a CC BY notice is not CC BY-NC, Lesser and Affero are not the GNU
GPL), and no denial (``DENIALS``: "not released under").

A window without any feature has the probabilities of the intercepts alone, and fit() lifts that of
``unknown`` to the largest; every feature holds a word that is a feature itself; so only
texts and paragraphs with such a word go on, and this loses nothing. Scoring explodes their n-grams, joins the weights (at most
``MAX_FEATURES`` rows, a proven bound for a broadcast) and adds up by paragraph.

Defined cases: null and empty texts have no paragraph; rows are told apart by doc_id (null or not) and text, and repeated rows each get the same answer; a
paragraph is a run of lines with a word, and holds what any of its windows of neighbouring lines
holds, so a hard-wrapped notice counts like one on a line; several families in a text are all named, in order; the corpus
may be empty (then only the intercept keeps unknown apart, and the threshold is 0.5); a very long text is
read whole; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read, settled

# Short notices and identifiers of licence families, as published by their stewards.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", "This project is licensed under the terms of the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "The MIT License (MIT)", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Apache License, Version 2.0, January 2004.", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.", "GNU General Public License version 3.", "License: GPLv3", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "GNU General Public License version 2.", "License: GPLv2", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later"],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "GNU Lesser General Public License version 3.", "License: LGPLv3", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "GNU Affero General Public License version 3.", "License: AGPLv3", "SPDX-License-Identifier: AGPL-3.0-only"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Use of this source code is governed by a BSD-style license.", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "BSD 2-Clause", "SPDX-License-Identifier: BSD-2-Clause"],
    "ISC": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "SPDX-License-Identifier: ISC"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "EPL-2.0": ["Licensed under the Eclipse Public License, version 2.0.", "Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0"],
}
# Fixed values: (of these words and pairs one must be there, none of these may) for families that others resemble.
_CREATIVE_NC = ["by-nc", "noncommercial", "attribution-noncommercial", "cc-by-nc-4.0"]
_CREATIVE_SA = ["by-sa", "sharealike", "attribution-sharealike", "cc-by-sa-4.0"]
_CREATIVE_MORE = ["by-nd", "by-nc-sa", "by-nc-nd", "attribution-noderivatives", "attribution-noncommercial-sharealike", "attribution-noncommercial-noderivatives"]
_LESSER = ["lesser", "gnu library", "lgpl", "lgplv2.1", "lgplv3", "lgpl-2.1-only", "lgpl-2.1-or-later", "lgpl-3.0-only", "lgpl-3.0-or-later"]
_AFFERO = ["affero", "agpl", "agplv3", "agpl-3.0-only", "agpl-3.0-or-later"]
_SECOND = ["version 2", "version 2.0", "v2", "gplv2", "gpl-2.0", "gpl-2.0-only", "gpl-2.0-or-later"]
_TWO_CLAUSES = ["2-clause", "bsd-2-clause", "simplified bsd"]
TELLS = {
    "MIT": (["mit", "permission"], ["isc"]),
    "Apache-2.0": (["apache", "apache-2.0"], []),
    "GPL-3.0": (["gnu", "gplv3", "gpl-3.0-only", "gpl-3.0-or-later", "free software"], _LESSER + _AFFERO + _SECOND),
    "GPL-2.0": (_SECOND, _LESSER + _AFFERO),
    "LGPL": (_LESSER, _AFFERO),
    "AGPL-3.0": (_AFFERO, _LESSER),
    "CC-BY-4.0": (["cc", "attribution", "cc-by-4.0"], _CREATIVE_NC + _CREATIVE_SA + _CREATIVE_MORE),
    "CC-BY-SA-4.0": (_CREATIVE_SA, _CREATIVE_NC + _CREATIVE_MORE),
    "CC-BY-NC-4.0": (_CREATIVE_NC, _CREATIVE_SA + _CREATIVE_MORE),
    "BSD-3-Clause": (["redistribution", "bsd-style", "3-clause", "bsd-3-clause"], _TWO_CLAUSES),
    "BSD-2-Clause": (_TWO_CLAUSES, ["3-clause", "bsd-3-clause"]),
    "ISC": (["isc", "without fee"], []),
    "MPL-2.0": (["mozilla", "mpl-2.0"], ["eclipse"]),
    "EPL-2.0": (["eclipse", "epl-2.0"], ["mozilla"]),
}
DENIALS = ["not release", "not released", "not license", "not licensed", "not under", "not covered", "never released", "never licensed", "longer released", "longer licensed", "longer under"]
WHOLE = 4  # notices of so few words are only known whole
MAX_FEATURES, RARE, ANCHORS = 2000, 0.01, 2
LINE_WEIGHT, FULL_LINES = 0.2, 10_000  # a line's weight beside a notice's; more lines share the weight of so many
CONFIRM = 0.6
WORD = "[a-z0-9]+(?:[.+-][a-z0-9]+)*"


def text_key() -> Column:
    return F.xxhash64("text")


def words_of(text: Column) -> Column:
    """Lower-cased words of letters and digits, with signs only between them."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def ngrams(words: Column) -> Column:
    pairs = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", F.get(words, i), w))
    return F.array_distinct(F.concat(words, pairs))


def blocks_of(documents: DataFrame, keys: list[str]) -> DataFrame:
    """keys, the place of each paragraph and its lower-cased text."""
    return documents.select(*keys, F.posexplode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\n[^a-z0-9\n]*(?=\n)")).alias("place", "block"))


def longest_notice() -> int:
    return max(len(re.findall(WORD, t.lower())) for texts in NOTICES.values() for t in texts)


def windows(documents: DataFrame, keys: list[str], rare: Column) -> DataFrame:
    """keys, the place of each paragraph, a window number and words, of the windows whose first line has a rare word.

    A paragraph is a run of lines with a word. A window is a line with any number of the next lines
    of its paragraph, up to the line that reaches the words of the longest notice.
    """
    blocks = blocks_of(documents, keys).where(F.arrays_overlap(words_of(F.col("block")), rare))
    # an explode of one element, so that the words are made once and not again for each line
    lines = blocks.select(*keys, "place", F.explode(F.array(F.filter(F.transform(F.split("block", "\n"), words_of), lambda w: F.size(w) > 0))).alias("lines"))
    longest = longest_notice()

    def opened(words: Column, i: Column) -> Column:
        start = F.struct(words.alias("last"), F.array(words).alias("all"))
        more = lambda a, w: F.when(F.size(a["last"]) >= longest, a).otherwise(F.struct(F.concat(a["last"], w).alias("last"), F.concat(a["all"], F.array(F.concat(a["last"], w))).alias("all")))
        grown = F.aggregate(F.slice("lines", i + 2, F.lit(longest)), start, more)["all"]
        return F.when(F.arrays_overlap(words, rare), grown).otherwise(F.array().cast("array<array<string>>"))

    return lines.select(*keys, "place", F.posexplode(F.flatten(F.transform("lines", opened))).alias("window", "words"))


class LicenseModel:
    """weights: feature, one weight for each class, and the notices it is part of; classes end with unknown."""

    def __init__(self, classes: list[str], intercepts: list[float], weights: list[tuple[str, list[float]]], threshold: float):
        self.classes, self.intercepts, self.weights, self.threshold = classes, intercepts, weights, threshold


def _training(spark: SparkSession) -> DataFrame:
    """Notices whole, and those of over WHOLE words with one word in four left out, for a classifier that bears small changes."""
    rows = [(family, text, drop) for family, texts in NOTICES.items() for text in texts for drop in (range(-1, 8) if len(re.findall(WORD, text.lower())) > WHOLE else [-1])]
    made = spark.createDataFrame(rows, "family string, text string, drop int")
    words = words_of(F.col("text"))
    kept = F.when(F.col("drop") < 0, words).otherwise(F.filter(words, lambda w, i: F.pmod(i * 5 + F.col("drop"), F.lit(8)) > 1))
    return made.select("family", kept.alias("words"))


def notice_grams(text: str) -> list[str]:
    """ngrams(words_of(text)) of a notice, in Python."""
    words = re.findall(WORD, text.lower())
    return list(dict.fromkeys([*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]))


def told(grams: Column) -> Column:
    """A bit for each family of NOTICES, set if the grams hold what tells it from its neighbours and no denial."""
    some = lambda words: F.arrays_overlap(grams, F.array(*map(F.lit, words)))
    bits = F.lit(0)
    for i, family in enumerate(NOTICES):
        needs, bars = TELLS.get(family, ([], []))
        fits = F.lit(True)
        fits = fits & some(needs) if needs else fits
        fits = fits & ~some(bars) if bars else fits
        bits = bits + F.when(fits, 1 << i).otherwise(0)
    return F.when(some(DENIALS), 0).otherwise(bits)


def _features(counts: dict[str, int], most: float) -> list[str]:
    """The notices' words of at most ``most`` background paragraphs or among their notice's rarest, and the pairs with one."""
    every = [notice_grams(text) for texts in NOTICES.values() for text in texts]
    words: set[str] = set()
    for own in every:
        single = sorted((g for g in own if " " not in g), key=lambda g: (counts.get(g, 0), g))
        words |= {g for i, g in enumerate(single) if i < ANCHORS or counts.get(g, 0) <= most}
    found = dict.fromkeys(g for own in every for g in own if set(g.split(" ")) & words and (" " in g or g in words))
    return sorted(sorted(found, key=lambda g: (" " in g, counts.get(g, 0), g))[:MAX_FEATURES])


def _background(documents: DataFrame, rare: list[str] | None = None) -> DataFrame:
    """half and grams (the notices' grams among a line's) of each line with a word, of paragraphs that hold no notice.

    Words of no notice become empty, so that what follows sees a notice's words only. With rare, of lines with one of these words only.
    """
    every = [notice_grams(text) for texts in NOTICES.values() for text in texts]
    known = {g for own in every for g in own}
    singles = sorted(g for g in known if " " not in g)
    pairs = sorted(known - set(singles))
    blocks = documents.select(F.coalesce("text", F.lit("")).alias("text"))
    if rare is not None:
        some = F.array(*map(F.lit, rare))
        blocks = blocks.where(F.arrays_overlap(words_of(F.col("text")), some))
    blocks = blocks_of(blocks, []).select("block")
    blocks = blocks if rare is None else blocks.where(F.arrays_overlap(words_of(F.col("block")), some))

    def own_grams(words: Column) -> Column:
        both = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.when((w != "") & (F.get(words, i) != ""), F.concat_ws(" ", F.get(words, i), w)))
        return F.array_distinct(F.concat(F.filter(words, lambda w: w != ""), F.filter(both, lambda g: g.isin(pairs))))

    # explodes of one element, so that words and grams are made once, not again for each use
    once = lambda rows, column, name: rows.withColumn(name, F.explode(F.array(column)))
    split = F.transform(F.split("block", "\n"), lambda x: F.transform(words_of(x), lambda w: F.when(w.isin(singles), w).otherwise("")))
    rows = once(blocks, F.filter(split, lambda w: F.size(w) > 0), "lines").select("block", "lines").where(F.size("lines") > 0)
    rows = once(once(rows, F.flatten("lines"), "words"), own_grams(F.col("words")), "all")
    notices = F.array(*(F.array(*map(F.lit, own)) for own in every))  # one constant, however many notices
    held = F.array_max(F.transform(notices, lambda own: F.size(F.array_intersect(own, "all")) / F.size(own)))
    # the words themselves, not the line, tell the halves apart
    halves = F.transform(F.filter(F.transform(F.split("block", "\n"), words_of), lambda w: F.size(w) > 0), lambda w: F.pmod(F.xxhash64(w), F.lit(2)))
    rows = rows.where((F.size("all") == 0) | (held < CONFIRM)).select(F.explode(F.arrays_zip("lines", halves.alias("half"))).alias("l"))
    return once(rows.select("l.half", "l.lines"), own_grams(F.col("lines")), "grams").select("half", "grams")


def fit(documents: DataFrame) -> LicenseModel:
    """Trains on the notices and on every line of the documents.

    One pass counts the lines and the notices' grams in them. The next groups the lines with a
    feature by their features, a row with a count for each set; the rest differ in nothing but number.
    The lines of one half train, those of the other set the threshold.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel

    spark = documents.sparkSession
    line = F.concat(F.lit("\n"), F.col("half").cast("string"))  # no gram, so each line counts once for its half
    counted = _background(documents).select(F.explode(F.concat("grams", F.array(line))).alias("g")).groupBy("g").count()  # as many rows as the notices have grams
    counts = {r["g"]: r["count"] for r in counted.collect()}
    n_train, n_other = counts.pop("\n0", 0), counts.pop("\n1", 0)
    vocabulary = _features(counts, RARE * (n_train + n_other))
    inside = F.array_sort(F.filter("grams", lambda g: g.isin(vocabulary)))
    lines = _background(documents, [g for g in vocabulary if " " not in g]).select("half", F.explode(F.array(inside)).alias("grams")).where(F.size("grams") > 0)
    sets = settled(lines.groupBy("half", "grams").agg(F.count("*").alias("c")))
    without = n_train - (sets.where("half = 0").agg(F.sum("c")).first()[0] or 0)
    notices = _training(spark).coalesce(1).select("family", ngrams(F.col("words")).alias("grams"), F.lit(1.0).alias("weight"))
    classes = [*NOTICES, "unknown"]
    index = F.array_position(F.array(*map(F.lit, classes)), F.col("family")).cast("double") - 1
    vector = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features")
    vector.setBinary(True)
    each = LINE_WEIGHT * min(1.0, FULL_LINES / max(n_train, 1))
    rows = notices.unionByName(sets.where("half = 0").select(F.lit("unknown").alias("family"), "grams", (F.col("c") * each).alias("weight")))
    rows = rows.unionByName(spark.createDataFrame([("unknown", [], LINE_WEIGHT * 20 + without * each)], "family string, grams array<string>, weight double").coalesce(1))
    data = vector.transform(rows.withColumn("label", index)).cache()
    model = LogisticRegression(family="multinomial", regParam=0.002, maxIter=40, weightCol="weight").fit(data)
    data.unpersist()
    coefficients, intercepts = model.coefficientMatrix.toArray(), model.interceptVector.toArray().copy()
    intercepts[-1] = max(intercepts)  # a paragraph without features has no licence
    found = LicenseModel(classes, intercepts.tolist(), [(g, coefficients[:, i].tolist()) for i, g in enumerate(vocabulary)], 0.5)
    kept = sets.where("half = 1").select(F.col("c").alias("doc_id"), F.xxhash64("grams").alias("place"), "grams")
    best = _probabilities(kept, found, ["doc_id"]).select(F.round(F.array_max(F.slice("p", 1, len(classes) - 1)), 4).alias("x"), "doc_id")
    # at most 10,001 different values meet in one task
    worst = best.groupBy("x").agg(F.sum("doc_id").alias("c")).agg(F.percentile("x", 0.999, F.col("c"))).first()[0]
    found.threshold = min(0.95, max(0.5, worst or 0.0))
    return found


def _probabilities(grams: DataFrame, model: LicenseModel, keys: list[str]) -> DataFrame:
    """keys, place, p (an array by class) and the features found, of paragraphs with at least one feature."""
    spark = grams.sparkSession
    weights = spark.createDataFrame(model.weights, "gram string, w array<double>")
    hits = grams.select(*keys, "place", F.explode("grams").alias("gram")).join(F.broadcast(weights), "gram")

    once = F.array_sort(F.collect_set(F.struct("gram", "w")))  # repeated rows give the same grams again
    logits = F.aggregate("hit", F.array(*map(F.lit, model.intercepts)), lambda a, h: F.zip_with(a, h["w"], lambda x, y: x + y))
    # an explode of one element, so that the logits are made once and not for each class
    scored = hits.groupBy(*keys, "place").agg(once.alias("hit")).select(*keys, "place", F.col("hit.gram").alias("found"), F.explode(F.array(F.transform(logits, F.exp))).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return scored.select(*keys, "place", F.transform("e", lambda x: x / total).alias("p"), "found")


def scan(documents: DataFrame, model: LicenseModel, keys: list[str]) -> DataFrame:
    """keys, text_key, place, family, probability and confirmed of each family that a paragraph holds.

    keys and text_key (a hash of the text) name a row; repeated rows are answered once.
    """
    keys = [*keys, "text_key"]
    documents = documents.withColumn("text_key", text_key())
    spark = documents.sparkSession
    rare = F.array(*(F.lit(g) for g, _ in model.weights if " " not in g))
    documents = documents.where(F.arrays_overlap(words_of(F.col("text")), rare))
    # an explode of one element, so that the grams of a window are made once
    grams = windows(documents, keys, rare).select(*keys, "place", "window", F.explode(F.array(ngrams(F.col("words")))).alias("grams"))
    scored = _probabilities(grams.withColumn("told", told(F.col("grams"))), model, [*keys, "window", "told"])
    families = F.slice("p", 1, len(model.classes) - 1)
    best = F.array_max(families)
    scored = scored.withColumn("probability", best).where(F.col("probability") >= model.threshold)
    names = F.array(*map(F.lit, model.classes))
    place = F.array_position(families, best).cast("int") - 1
    scored = scored.withColumn("family", F.get(names, place)).withColumn("tells", F.get(F.array(*(F.lit(1 << i) for i in range(len(NOTICES)))), place).bitwiseAND(F.col("told")) > 0)
    known = {g for g, _ in model.weights}
    notices = _training(spark).coalesce(1).where(F.size("words") > 0).select("family", ngrams(F.col("words")).alias("grams"))
    notices = notices.select("family", F.array_sort(F.filter("grams", lambda g: F.array_contains(F.array(*(F.lit(x) for x in sorted(known))), g))).alias("notice")).where(F.size("notice") > 0).groupBy("family").agg(F.collect_set("notice").alias("notices"))
    joined = scored.join(F.broadcast(notices), "family")
    held = F.array_max(F.transform("notices", lambda n: F.size(F.array_intersect(n, "found")) / F.size(n)))
    sure = (held >= CONFIRM) & F.col("tells")
    own = joined.withColumn("evidence", F.array_intersect("found", F.flatten("notices")))
    own = own.groupBy(*keys, "place", "family").agg(F.max("probability").alias("probability"), F.collect_set(F.when(sure, F.col("found"))).alias("founds"), F.array_distinct(F.flatten(F.collect_set(F.when(sure, F.col("evidence"))))).alias("evidence"))
    whole = own.groupBy(*keys, "place").agg(F.collect_list(F.struct("family", "probability", "founds", "evidence")).alias("all"))

    def stands(f: Column) -> Column:
        """Whether a window of f is more than a part of another family's larger notice in the paragraph."""
        part = lambda found: F.exists("all", lambda g: (g["family"] != f["family"]) & (F.size(g["evidence"]) > F.size(f["evidence"])) & (F.size(F.array_except(found, g["evidence"])) == 0))
        return F.exists(f["founds"], lambda found: ~part(found))

    return whole.select(*keys, "place", F.inline(F.transform("all", lambda f: F.struct(f["family"].alias("family"), f["probability"].alias("probability"), stands(f).alias("confirmed")))))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses(documents, fit(documents))


def licenses(documents: DataFrame, model: LicenseModel) -> DataFrame:
    """doc_id, n_predicted, n_confirmed and families (sorted) of each row of documents (doc_id, text)."""
    found = scan(documents, model, ["doc_id"])
    by_doc = found.groupBy(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).agg(F.count("*").alias("n"), F.count_if("confirmed").alias("c"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("f"))
    rows = documents.select("doc_id", text_key().alias("text_key"))
    joined = rows.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key")), "left")
    return joined.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_predicted"), F.coalesce("c", F.lit(0)).cast("long").alias("n_confirmed"), F.coalesce("f", F.lit("")).alias("families"))
