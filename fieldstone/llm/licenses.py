"""License scans (op4): a paragraph classifier on sparse word n-grams, confirmed by comparison with templates. DataFrame functions only.

Texts are cut at line ends and after sentences. Neighbouring pieces that speak the templates' language make up a paragraph, so a notice
wrapped over lines is one, and one sentence within prose too; every other piece is one by itself. All are classified."""

from __future__ import annotations

from collections import Counter
from functools import reduce
from math import log
from operator import or_

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

UNKNOWN = "unknown"
#: Wordings by which public licences are named or granted, by family.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU General Public License, version 2 or any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal.",
    ],
}
#: Wordings near to licences that grant nothing: examples of the unknown class beside the documents' own.
NEGATIVES = [
    "A MIT License is one that we discussed under the tree.",
    "The MIT License and the Apache License are compared in the next chapter.",
    "They released the project under the name of its first author.",
    "He lost his driving license, version two of the story says.",
    "The terms of the license were never published.",
    "You must obtain a license to fish here.",
    "Permission is required to copy this file.",
    "The general public may use the source of the river free of charge.",
    "All rights reserved. Copyright by the author.",
    "The work of the foundation is free and open to the public.",
    "Apache helicopters and the GNU project have nothing in common.",
    "This license does not permit redistribution in any form.",
]
#: What every template holds one of, in small letters; a word that holds one speaks for a licence alone.
ANCHORS = ("licen", "spdx", "copyright", "permission is", "redistribut", "public domain", "unencumbered")
FAMILIES = [UNKNOWN, *TEMPLATES]
#: Paragraphs of the documents that the classifier is fitted on beside the templates, at most: the documented bound of its sample.
BACKGROUND = 3000
#: Share of the scanned paragraphs that no template confirms which may be given to a known family.
FALSE_SHARE = 0.001
#: Probability below which no paragraph is given to a known family.
LEAST = 0.5
#: Share of a template's word pairs that a confirmed paragraph holds, and share of its own pairs that stand in the family's templates.
FORWARD, BACKWARD = 0.6, 0.5


def _let(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used: optimisers copy a named column into every place that names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    """Lower-case words of letters, digits and version dots."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}.]+|\.(?=\s|$)"), lambda w: w != "")


def _pairs(tokens: Column) -> Column:
    shifted = F.concat(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), F.array(F.lit("")))
    return F.when(F.size(tokens) > 1, F.slice(F.zip_with(tokens, shifted, lambda a, b: F.concat(a, F.lit(" "), b)), 1, F.greatest(F.size(tokens) - 1, F.lit(0)))).otherwise(tokens)


def pairs(text: Column) -> Column:
    """Distinct pairs of neighbouring words, joined; the single word of a text that has one."""
    return F.array_distinct(_let(words(text), _pairs))


def _terms(text: Column) -> Column:
    return _let(words(text), lambda t: F.concat(t, _pairs(t)))


def vocabulary(spark: SparkSession) -> CountVectorizerModel:
    """The words and pairs of the templates, all that can speak for a family; a few hundred, whatever the documents."""
    rows = _examples(spark).filter("label > 0").select(F.explode(_terms(F.col("text"))).alias("term")).distinct().orderBy("term").collect()
    return CountVectorizerModel.from_vocabulary([r.term for r in rows], "terms", "features").setBinary(True)


def _features(df: DataFrame, terms: CountVectorizerModel) -> DataFrame:
    """df (..., text) with its features."""
    return terms.transform(df.withColumn("terms", _terms(F.col("text")))).drop("terms")


def _examples(spark: SparkSession) -> DataFrame:
    """(label, text): templates, whole and in part (the first and the last two thirds of their words, so that cut notices are known too),
    and the negatives as class 0."""
    rows = [(0, x) for x in NEGATIVES]
    for y, (_, texts) in enumerate(TEMPLATES.items(), 1):
        for t in texts:
            w = t.split()
            part = max(2, len(w) * 2 // 3)
            rows += [(y, x) for x in dict.fromkeys([t, " ".join(w[:part]), " ".join(w[-part:]), t.upper()] if len(w) > 4 else [t])]
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(float(y)).alias("label"), F.lit(x).alias("text")) for y, x in rows])))


def _speech(spark: SparkSession) -> tuple:
    """speaks(text, before, behind) and meets(text, behind), as Columns, for pieces and the texts of the pieces before and behind them. A
    piece speaks if two of its word pairs and a quarter of them, or half of them, are a template's, or if it is one word that has an anchor
    and is of the templates, or that makes a template's pair with the word before or behind it. Pieces meet if the last word of one and
    the first of the other make such a pair."""
    known = sorted(r.p for r in _examples(spark).filter("label > 0").select(F.explode(pairs(F.col("text"))).alias("p")).distinct().collect())
    first, second = (sorted({p.split(" ")[k] for p in known if " " in p}) for k in (0, 1))
    single = F.array(*map(F.lit, sorted({w for ts in TEMPLATES.values() for t in ts for w in t.lower().rstrip(".,").split() if any(a in w for a in ANCHORS)})))

    def meets(text: Column, behind: Column) -> Column:
        return F.coalesce(F.concat(F.try_element_at(words(text), F.lit(-1)), F.lit(" "), F.get(words(behind), F.lit(0))).isin(known), F.lit(False))

    def speaks(text: Column, before: Column, behind: Column) -> Column:
        def holds(t: Column) -> Column:
            """Whether words are one, or two neighbours are a known pair: what else can't speak, and needs no pairs made."""
            return (F.size(t) == 1) | (F.size(F.filter(t, lambda a, i: a.isin(first) & F.get(t, i + 1).isin(second) & F.concat(a, F.lit(" "), F.get(t, i + 1)).isin(known))) > 0)

        def of(p: Column) -> Column:
            one = (F.size(p) == 1) & ~F.get(p, F.lit(0)).contains(" ") & (F.arrays_overlap(p, single) | meets(before, text) | meets(text, behind))
            return _let(F.size(F.filter(p, lambda x: x.isin(known))), lambda told: (told >= 2) & (told * 4 >= F.size(p)) | (told * 2 >= F.size(p)) & (told > 0) | one)

        return _let(words(text), lambda t: F.when(holds(t), _let(F.array_distinct(_pairs(t)), of)).otherwise(False))

    return speaks, meets


def _pieces(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pieces): of each row's text all pieces, with the numbers of their lines, and their places."""
    whole = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def sentences(line: Column) -> Column:
        ends = reduce(or_, (line.contains(a + b) for a in ".!?" for b in " \t"))  # few lines have one: searching is cheaper than splitting
        return F.when(ends, F.split(line, r"(?<=[.!?])[ \t]+")).otherwise(F.array(line))

    pieces = F.flatten(F.transform(F.split("text", "\n"), lambda line, i: F.transform(sentences(line), lambda t: F.struct(i.alias("line"), t.alias("text")))))
    return whole.select("id", pieces.alias("pieces")).select("id", F.transform("pieces", lambda p, i: F.struct(i.alias("at"), p["line"].alias("line"), p["text"].alias("text"))).alias("pieces"))


def _around(i: Column) -> tuple[Column, Column]:
    return F.get("pieces", i - 1)["text"], F.get("pieces", i + 1)["text"]


def _spoken(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, s): of each row the number of pieces that aren't blank, and those that speak."""
    speaks, _ = _speech(docs.sparkSession)
    told = F.filter("pieces", lambda p, i: speaks(p["text"], *_around(i)))
    return _pieces(docs, id_col, text_col).select("id", F.size(F.filter("pieces", lambda p: F.trim(p["text"]) != "")).alias("n"), told.alias("s"))


def _runs(df: DataFrame, follows) -> DataFrame:
    """df (s, ...) with `runs`, of the pieces s: those that each follow the one before, follows(piece, the one before)."""
    begins = F.filter(F.transform("s", lambda p, i: F.when((i == 0) | ~follows(p, F.get("s", i - 1)), i + 1)), lambda i: i.isNotNull())

    def run(i: Column) -> Column:
        first, after = F.get("b", i - 1), F.get("b", i)  # get: Spark may ask this of rows without pieces before it drops them
        own = F.slice("s", first, after - first)
        return F.struct(F.get("s", first - 1)["line"].alias("paragraph"), F.get("s", after - 2)["line"].alias("last_line"), F.array_join(F.transform(own, lambda p: p["text"]), " ").alias("text"), own.alias("s"))

    return df.withColumn("b", F.concat(begins, F.array(F.size("s") + 1))).withColumn("runs", F.transform(F.sequence(F.lit(1), F.size("b") - 1), run)).drop("b")


def _joined(spoken: DataFrame) -> DataFrame:
    _, meets = _speech(spoken.sparkSession)
    told = _runs(spoken.filter(F.size("s") > 0).select("id", "s"), lambda p, q: p["at"] == q["at"] + 1).select("id", F.inline("runs"))
    parts = _runs(told, lambda p, q: meets(q["text"], p["text"]))
    return parts.select("id", "paragraph", "last_line", "text", F.transform("runs", lambda r: r.dropFields("s")).alias("parts"))


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, paragraph, last_line, text, parts): runs of neighbouring pieces that speak the templates' language, with the numbers (from 0,
    blank lines counted) of the first and last lines that they touch, and what each falls into where neighbours don't meet, as notices
    do that follow one another. Every other piece is a paragraph of its own: _others has those."""
    return _joined(_spoken(docs, id_col, text_col))


def _agreement(found: Column) -> Column:
    """For each known family, in order, the best share of a template's pairs that are found, and the share of found pairs that its templates have."""
    out = []
    for texts in TEMPLATES.values():
        sets = [pairs(F.lit(t)) for t in texts]
        forward = [F.size(F.array_intersect(found, s)) / F.greatest(F.lit(1), F.size(s)) for s in sets]
        backward = F.size(F.array_intersect(found, F.array_distinct(F.concat(*sets)))) / F.greatest(F.lit(1), F.size(found))
        out.append(F.struct((F.greatest(*forward) if len(forward) > 1 else forward[0]).alias("forward"), backward.alias("backward")))
    return F.array(*out)


def _hash() -> Column:
    return F.xxhash64("text", "id", "paragraph")


def train(scanned: DataFrame, background: int = BACKGROUND) -> tuple[CountVectorizerModel, LogisticRegressionModel, int]:
    """The vocabulary, the classifier, and the hash below which paragraphs may have been fitted on. `scanned` (id, paragraph, text,
    agrees) is read several times. Class 0, unknown, is learned from the negatives and from `background` paragraphs that agree with no template,
    those of lowest hash; a threshold on the hash leaves about four times as many to be put in order."""
    spark = scanned.sparkSession
    terms = vocabulary(spark)
    others = scanned.filter(~F.col("agrees")).withColumn("hash", _hash())
    share = min(1.0, 4 * background / max(1, others.count()))
    low = int(-(1 << 63) + share * ((1 << 64) - 1)) if share < 1 else (1 << 63) - 1
    sample = others.filter(F.col("hash") <= low).orderBy("hash", "id", "paragraph").limit(background)
    last = sample.agg(F.max("hash")).first()[0]
    unknown = _features(sample.select("text").distinct(), terms).select(F.lit(0.0).alias("label"), "features", F.lit(1.0).alias("importance"))
    known = _features(_examples(spark), terms).select("label", "features", F.lit(5.0).alias("importance"))
    fitted = cut(unknown.unionByName(known).coalesce(1), "licence-fit")
    fit = LogisticRegression(family="multinomial", regParam=0.002, elasticNetParam=0.5, maxIter=30, weightCol="importance", labelCol="label")
    return terms, fit.fit(fitted), last if last is not None else -(1 << 63)


def _best(text: Column) -> Column:
    return _let(_agreement(pairs(text)), lambda a: F.struct(a.alias("by_family"), F.array_max(F.transform(a, lambda x: x["forward"])).alias("top")))


def _top(scored: DataFrame) -> DataFrame:
    """scored by the model, with `top`: the highest probability of a known family, and all."""
    top = _let(vector_to_array("probability"), lambda p: F.struct(F.array_max(F.slice(p, 2, len(FAMILIES) - 1)).alias("probability"), p.alias("all")))
    return scored.withColumn("top", top)


def _judged(df: DataFrame) -> DataFrame:
    """df (top, agreement, ...) with family, probability, similarity and confirmed."""
    place = F.array_position("top.all", F.col("top.probability")).cast("int")
    told = df.withColumn("probability", F.col("top.probability")).withColumn("family", F.element_at(F.array(*map(F.lit, FAMILIES)), place)).withColumn("own", F.element_at("agreement.by_family", F.greatest(place - 1, F.lit(1))))
    confirmed = (F.col("probability") >= LEAST) & (F.col("own.forward") >= FORWARD) & (F.col("own.backward") >= BACKWARD) & (F.col("own.forward") >= F.col("agreement.top"))
    return told.withColumn("similarity", F.col("own.forward")).withColumn("confirmed", confirmed)


_ROW = ["id", "paragraph", "last_line", "family", "probability", "similarity", "confirmed", "fitted", "text"]


def _chosen(judged: DataFrame) -> DataFrame:
    """Of each run (part 0) its row, or those of its parts: if they are confirmed for several families, or if some are and it isn't."""
    rows = judged.groupBy("run").agg(F.collect_list(F.struct("part", *_ROW)).alias("r"))
    whole, sure = F.filter("r", lambda x: x["part"] == 0), F.filter("r", lambda x: (x["part"] > 0) & x["confirmed"])
    kinds = F.size(F.array_distinct(F.transform(sure, lambda x: x["family"])))
    apart = (kinds > 1) | (kinds > 0) & ~F.get(whole, F.lit(0))["confirmed"]
    return rows.select(F.inline(F.when(apart, F.filter("r", lambda x: x["part"] > 0)).otherwise(whole))).select(_ROW)


def _bound(terms: CountVectorizerModel, model: LogisticRegressionModel):
    """least(t), as a Column: whether the classifier could give words t to a known family with LEAST or more, for which that family's margin
    above the unknown class has to be large enough. Terms count with their largest gain over all families, a pair's at that of its words
    which fewer terms have; that is never less than the margin, so what falls short need not be scored."""
    weights, own = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    common = Counter(w for term in terms.vocabulary for w in term.split(" "))
    gains: dict[str, float] = {}
    for term, gain in zip(terms.vocabulary, (weights[1:] - weights[0]).max(axis=0).tolist(), strict=True):
        if gain > 0:
            word = min(term.split(" "), key=common.__getitem__)
            gains[word] = gains.get(word, 0.0) + gain
    needed = float(own[0] - own[1:].max()) + log(LEAST / (1 - LEAST)) - 1e-6  # sums of doubles in another order
    if needed <= 0 or not gains:
        return lambda t: F.lit(needed <= 0)
    gain = F.create_map(*(F.lit(x) for pair in sorted(gains.items()) for x in pair))
    return lambda t: _let(F.filter(t, lambda w: w.isin(sorted(gains))), lambda told: (F.size(told) > 0) & (F.aggregate(told, F.lit(0.0), lambda a, w: a + F.element_at(gain, w)) >= needed))


def _others(docs: DataFrame, id_col: str, text_col: str, terms: CountVectorizerModel, model: LogisticRegressionModel) -> DataFrame:
    """The rows of pieces that don't speak and that the classifier gives to a known family with LEAST or more. Every piece is scored, but
    where a bound on its score already falls short of LEAST; what speaks is left out only then, as few are left. No template confirms one,
    as less than half of its pairs are theirs."""
    speaks, _ = _speech(docs.sparkSession)
    least = _bound(terms, model)
    near = _pieces(docs, id_col, text_col).withColumn("near", F.filter("pieces", lambda p: least(words(p["text"]))))  # no filter on it: that would cut up texts twice
    every = near.select("id", F.inline(F.transform("near", lambda p: F.struct(p["line"].alias("paragraph"), p["text"].alias("text"), *(x.alias(n) for x, n in zip(_around(p["at"]), ("before", "behind"), strict=True))))))
    scored = _top(model.transform(_features(every.filter(F.trim("text") != ""), terms)))
    likely = cut(scored.select("id", "paragraph", "text", "before", "behind", "top").filter(F.col("top.probability") >= LEAST), "licence-others")
    quiet = likely.filter(~speaks(F.col("text"), F.col("before"), F.col("behind"))).withColumn("agreement", _best(F.col("text")))
    return _judged(quiet.withColumn("last_line", F.col("paragraph")).withColumn("fitted", F.lit(False))).select(_ROW)


def _level(unconfirmed: DataFrame, others: int) -> float:
    """The probability above which no more than FALSE_SHARE of the unconfirmed paragraphs lie, repeats counted, by those that the
    classifier wasn't fitted on (by all if there are none). `unconfirmed` has those with LEAST or more; of the paragraphs that don't
    speak it has the likely ones alone, and `others` is the number of all."""
    new = ~F.col("fitted")
    told = unconfirmed.agg(F.count_if(new & F.col("spoken")).alias("new"), F.count_if(F.col("spoken")).alias("every")).first()
    rows, n = (unconfirmed.filter(new), told.new + others) if told.new + others else (unconfirmed, told.every)
    likely = rows.filter(F.col("probability") >= LEAST)
    many, allowed = likely.count(), int(FALSE_SHARE * n)
    if many <= allowed:
        return 0.0
    return likely.agg(F.percentile_approx("probability", (many - allowed) / many, 100_000)).first()[0]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", background: int = BACKGROUND) -> DataFrame:
    """Licence paragraphs of every whole text: id_col, paragraph (its first line), last_line, family, probability, similarity, confirmed, text.

    A row for each paragraph that the classifier gives to a known family with LEAST or more and that this family's templates confirm in
    both directions (FORWARD, BACKWARD) and as well as any other family's, or that lies above the level calibrated over all unconfirmed
    paragraphs outside the fit. Neighbouring notices of several families give a row each. Every piece of every text is classified and
    counts in the level. Others are of unknown family and give no row, as do null and empty texts and empty tables. Texts
    of any length are cut up whole; repeated rows and null ids give their rows each; ties of families go to the first; other columns are not read."""
    spoken = cut(_spoken(docs, id_col, text_col), "licence-pieces")
    others = spoken.agg(F.sum(F.col("n") - F.size("s"))).first()[0] or 0
    found = cut(_joined(spoken).withColumn("run", F.monotonically_increasing_id()), "licence-runs")
    whole = F.array(F.struct("paragraph", "last_line", "text"))
    parts = found.select("id", "run", F.posexplode(F.concat(whole, F.when(F.size("parts") > 1, F.col("parts")).otherwise(F.slice("parts", 1, 0)))).alias("part", "p")).select("id", "run", "part", "p.*")
    scanned = cut(parts.withColumn("agreement", _best(F.col("text"))).withColumn("agrees", F.col("agreement.top") >= FORWARD), "licence-paragraphs")
    terms, model, last = train(scanned.filter("part = 0"), background)
    scored = _top(model.transform(_features(scanned, terms))).withColumn("fitted", (F.col("part") == 0) & (_hash() <= last))
    judged = cut(_judged(scored).select("run", "part", *_ROW), "licences")
    told = cut(_chosen(judged).withColumn("spoken", F.lit(True)).unionByName(_others(docs, id_col, text_col, terms, model).withColumn("spoken", F.lit(False))), "licences-told")
    level = _level(told.filter(~F.col("confirmed")), others)
    shown = told.filter(F.col("confirmed") | (F.col("probability") >= LEAST) & (F.col("probability") > level))
    return shown.select(F.col("id").alias(id_col), F.col("paragraph").cast("long").alias("paragraph"), F.col("last_line").cast("long").alias("last_line"), "family", "probability", "similarity", "confirmed", "text")
