"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest
ancestor directory with a licence file, all as joins."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, ascii_lower, near, saved

# The notices by which licences are named in files.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license.",
    ],
    "BSD-2-Clause": [
        "Licensed under the BSD 2-Clause License.",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "LGPL-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC0-1.0": [
        "Licensed under CC0 1.0.",
        "This work has been dedicated to the public domain under CC0 1.0 Universal.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
    ],
    "All-Rights-Reserved": [
        "All rights reserved.",
    ],
}
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)([.-][^/]*)?$"
COSINE = 0.6
BROADCAST_DIRS = 100_000
_LOWER = str.maketrans(UPPER, LOWER)
_TOKEN = "[a-z0-9]+(?:[.][0-9]+)*"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(f"({_TOKEN})"))


def _cosines(units: DataFrame, idf: DataFrame, templates: DataFrame, unseen: float) -> DataFrame:
    """(file, unit, licence, score): of every unit (file, unit, words) its best template at COSINE or more."""
    counts = units.select("file", "unit", F.explode("words").alias("token")).groupBy("file", "unit", "token").agg(F.count("*").alias("tf"))
    weighed = counts.join(F.broadcast(idf), "token", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    norms = weighed.groupBy("file", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.where("idf is not null").join(F.broadcast(templates), "token").groupBy("file", "unit", "template", "licence").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scores = dots.join(norms, ["file", "unit"]).withColumn("score", F.col("dot") / F.col("norm")).where(F.col("score") >= COSINE)
    best = scores.groupBy("file", "unit").agg(F.max(F.struct(F.round("score", 9).alias("score"), "licence")).alias("best"))
    return best.select("file", "unit", "best.licence", "best.score")


def _heavy(weights: dict[str, float]) -> tuple[list[str], int]:
    """Of a template's words those of which a text at COSINE or more holds one at least, and how many it holds at least."""
    ordered = sorted(weights.items(), key=lambda x: (-x[1], x[0]))
    squares = [w * w for _, w in ordered]
    bound = COSINE * COSINE * sum(squares) * (1 - 1e-9)
    anchors = next(i for i in range(1, len(squares) + 1) if sum(squares[i:]) < bound)
    needed = next(i for i in range(1, len(squares) + 1) if sum(squares[:i]) >= bound)
    return [t for t, _ in ordered[:anchors]], needed


def _windows(some: DataFrame, listed: list[tuple[str, str, list[str]]], idf: dict[str, float]) -> DataFrame:
    """(file, licence, score): of every file the best run of as many words as a template has, wherever it begins or ends.

    A run is laid so that one of the template's heavy words, of which it must hold one, is in its place. Words that are
    not the template's weigh as its heaviest one, so what other files or neighbouring sentences hold does not count."""
    spark, rows, words = some.sparkSession, [], []
    for template, licence, text in listed:
        weights = {t: text.count(t) * idf[t] for t in text}
        anchors, needed = _heavy(weights)
        norm = math.sqrt(sum(w * w for w in weights.values()))
        rows += [(t, template, licence, q, len(text), sorted(weights), needed, max(idf[t] for t in text)) for q, t in enumerate(text) if t in anchors]
        words += [(template, t, idf[t], w / norm) for t, w in weights.items()]
    laid = spark.createDataFrame(rows, "anchor string, template string, licence string, q int, length int, own array<string>, needed int, foreign double")
    own = spark.createDataFrame(words, "template string, token string, idf double, tw double")
    longest = max(len(text) for _, _, text in listed)
    heavy = F.array(*map(F.lit, sorted({r[0] for r in rows})))
    # a stretch of words around each anchor; its first word is number `lo` of the text
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.array_contains(heavy, F.get("words", i)))
    around = lambda i: F.struct(
        F.get("words", i).alias("anchor"), i.alias("at"), F.greatest(i - longest, F.lit(0)).alias("lo"), F.slice("words", F.greatest(i - longest, F.lit(0)) + 1, F.lit(2 * longest + 1)).alias("around"))
    found = some.where(F.arrays_overlap("words", heavy)).select("file", F.explode(F.transform(places, around)).alias("x")).select("file", "x.*")
    found = found.join(F.broadcast(laid), "anchor").withColumn("start", F.col("at") - F.col("q"))
    first = F.greatest(F.col("start"), F.lit(0))
    run = F.slice("around", first - F.col("lo") + 1, F.col("start") + F.col("length") - first)
    found = found.select("file", "template", "licence", "start", "own", "needed", "foreign", run.alias("run")).where(F.size(F.array_intersect("run", "own")) >= F.col("needed"))
    counts = found.dropDuplicates(["file", "template", "start"]).select("file", "template", "licence", "start", "foreign", F.explode("run").alias("token"))
    counts = counts.groupBy("file", "template", "licence", "start", "foreign", "token").agg(F.count("*").alias("tf"))
    weighed = counts.join(F.broadcast(own), ["template", "token"], "left").withColumn("w", F.col("tf") * F.coalesce("idf", "foreign"))
    scores = weighed.groupBy("file", "licence", "template", "start").agg((F.sum(F.col("w") * F.coalesce("tw", F.lit(0.0))) / F.sqrt(F.sum(F.col("w") * F.col("w")))).alias("score"))
    return scores.where(F.col("score") >= COSINE).select("file", "licence", F.round("score", 9).alias("score"))


def _reaches(words: Column, idf: dict[str, float], unseen: float) -> Column:
    """Whether a unit's cosine to any template can reach COSINE: it is at most the length of the unit's part inside the
    templates' words, over its whole length, to which each other word adds the weight of an unseen one or more."""
    known = F.array(*map(F.lit, idf))
    weight = F.create_map(*[x for t, w in idf.items() for x in (F.lit(t), F.lit(w))])
    times = lambda t: F.size(F.filter(words, lambda x: x == t))
    return F.aggregate(
        F.array_intersect(words, known), F.struct(F.lit(0.0).alias("squares"), F.lit(0).alias("inside")),
        lambda acc, t: F.struct((acc["squares"] + F.pow(times(t) * F.element_at(weight, t), F.lit(2.0))).alias("squares"), (acc["inside"] + times(t)).alias("inside")),
        lambda acc: acc["squares"] >= COSINE * COSINE * (1 - 1e-9) * (acc["squares"] + (F.size(words) - acc["inside"]) * (unseen * unseen)),
    )


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """One row per row of `files`: path, licence, score, origin (file, text, header, inherited or null), inherited_from.

    A file is like a template by its whole text (origin text), else by the most similar of its lines or of its runs of as
    many words as a template has, over any lines and sentences (header). One with either that is named as a licence file
    (origin file) speaks for its directory too, and no other: what a text says is said of that text alone. A file
    without either takes the licence of the nearest directory above it, its own first, that has a licence file; of
    several there the most similar, then the smallest path.

    Every text at COSINE or more to a template holds one of the template's heaviest words, which follow from the weights;
    texts and lines without any are not compared further.

    Weights are term counts times ln((1 + n) / (1 + df)) + 1, with n files and df of the templates' words counted over
    whole texts of all files; words outside the templates weigh as unseen ones. Equal scores go to the licence last by
    name. Null texts are empty, without licence of their own; rows with a null path inherit nothing; repeated rows and
    paths are each reported. Other columns are ignored; an empty table gives none. The templates are the only table
    broadcast without a check, as they are given by the caller.
    """
    spark = files.sparkSession
    files = files.select(F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("text"))
    listed = [(f"{name}:{i}", name, text) for name, texts in sorted(templates.items()) for i, text in enumerate(texts)]
    given = spark.createDataFrame(listed, "template string, licence string, text string").select("template", "licence", F.explode(tokens(F.col("text"))).alias("token"))
    given = given.groupBy("template", "licence", "token").agg(F.count("*").alias("tf"))
    vocabulary = sorted(r["token"] for r in given.select("token").distinct().collect())
    known = F.array(*map(F.lit, vocabulary))
    held = files.select(F.array_intersect(tokens(F.coalesce("text", F.lit(""))), known).alias("held"))
    stats = held.groupBy().agg(F.count("*").alias("n"), *[F.count_if(F.array_contains("held", t)).alias(f"t{i}") for i, t in enumerate(vocabulary)]).first()
    n = stats["n"]
    df = {t: stats[f"t{i}"] for i, t in enumerate(vocabulary)}
    exact = {t: math.log((1.0 + n) / (1 + df[t])) + 1 for t in vocabulary}
    idf = spark.createDataFrame([(t, df[t]) for t in vocabulary], "token string, df long").select("token", (F.log((1.0 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    unseen = math.log(1.0 + n) + 1
    weights = given.join(F.broadcast(idf), "token").withColumn("tw", F.col("tf") * F.col("idf"))
    norms = weights.groupBy("template").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("norm"))
    weights = weights.join(F.broadcast(norms), "template").select("template", "licence", "token", (F.col("tw") / F.col("norm")).alias("tw"))
    read = [(template, name, re.findall(_TOKEN, text.translate(_LOWER))) for template, name, text in listed]
    read = [x for x in read if x[2]]
    rare = F.array(*map(F.lit, sorted({t for *_, words in read for t in _heavy({w: words.count(w) * exact[w] for w in words})[0]})))

    some = files.where(F.arrays_overlap(tokens(F.col("text")), rare)).select(F.xxhash64("path", "text").alias("file"), "path", "text").dropDuplicates(["file"])
    some = saved(some.withColumn("words", tokens(F.col("text"))))
    lines = some.select("file", F.posexplode(F.split("text", "\n")).alias("unit", "line")).withColumn("words", tokens(F.col("line")))
    reaches = _reaches(F.col("words"), exact, unseen)
    headers = _cosines(lines.where(F.arrays_overlap("words", rare)).where(reaches).select("file", "unit", "words"), idf, weights, unseen)
    headers = headers.select("file", "licence", "score").unionByName(_windows(some, read, exact))
    headers = headers.groupBy("file").agg(F.max(F.struct("score", "licence")).alias("header"))
    wholes = some.select("file", F.lit(0).alias("unit"), "words").where(reaches)
    wholes = _cosines(wholes, idf, weights, unseen).select("file", F.struct("score", "licence").alias("whole"))
    own = headers.join(wholes, "file", "full_outer").join(some.select("file", "path"), "file")
    is_file = F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False))
    origin = F.when(is_file, "file").when(F.col("whole").isNotNull(), "text").otherwise("header")
    own = own.select("file", "path", origin.alias("origin"), F.coalesce("whole", "header").alias("best"))
    own = saved(own.select("file", "path", "origin", "best.licence", "best.score"))

    folder = lambda p: F.regexp_extract(p, r"(?s)^(.*)/[^/]*$", 1)
    dirs = own.where("origin = 'file' and path is not null").groupBy(folder(F.col("path")).alias("dir")).agg(
        F.min(F.struct((-F.col("score")).alias("s"), "path", "licence")).alias("of"))
    dirs = dirs.select("dir", "of.path", "of.licence", (-F.col("of.s")).alias("score"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    asked = files.where("path is not null").select(folder(F.col("path")).alias("dir")).distinct()
    asked = asked.select("dir", F.posexplode(above).alias("depth", "ancestor"))
    taken = asked.join(dirs.withColumnRenamed("dir", "ancestor"), "ancestor").groupBy("dir").agg(F.max(F.struct("depth", "path", "licence", "score")).alias("up"))
    taken = saved(taken.select("dir", "up.path", "up.licence", "up.score"))
    out = files.select("path", F.xxhash64("path", "text").alias("file"), folder(F.col("path")).alias("dir"))
    out = out.join(own.select("file", "origin", F.col("licence").alias("l"), F.col("score").alias("s")), "file", "left")
    out = out.join(near(taken, BROADCAST_DIRS).select("dir", F.col("path").alias("from"), "licence", "score"), "dir", "left")
    inherits = F.col("origin").isNull() & F.col("licence").isNotNull() & F.col("path").isNotNull()
    return out.select(
        F.col("path").alias(path_col), F.coalesce("l", F.when(inherits, F.col("licence"))).alias("licence"), F.coalesce("s", F.when(inherits, F.col("score"))).alias("score"),
        F.coalesce("origin", F.when(inherits, F.lit("inherited"))).alias("origin"), F.when(inherits, F.col("from")).alias("inherited_from"),
    )
