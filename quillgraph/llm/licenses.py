"""License scans: TF-IDF cosine of passages to licence templates, then inheritance along directories.

Every sentence, line, paragraph and whole text is compared with the templates (short statements, file headers and licence
texts), except where it has none of the ``needed_words``: then its cosine to every template is below the threshold for certain.  Weights are tf * idf, with idf = ln((1 + documents) / (1 + documents with the word)) + 1
counted over all documents; words of no template have the largest idf and only lengthen a passage.  The vectors stay sparse: passages meet
templates on shared words.  A document's licence is that of its best passage, if its cosine reaches ``THRESHOLD``.

A licence file is one with such a name (LICENSE, COPYING ...) or whose whole text is the best passage.  It holds for its directory and
those below it.  A document without a licence of its own inherits from the nearest ancestor directory that has a licence
file: directories are joined with licensed directories by their ancestors, one row per directory and level.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillgraph.llm.common import ascii_lower, ascii_lower_str, write_table

THRESHOLD = 0.7
TOKEN = r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"
FILE_NAME = r"(?i)^(un)?licen[sc]e([._-].*)?$|^copying([._-].*)?$|^copyright([._-].*)?$"

# Names of licences and the words by which texts are put under them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
     "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
     "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
     "merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
     "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
     "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "All rights reserved"),
)


def template_words(templates=TEMPLATES) -> list[tuple[int, str, str, int]]:
    """(template, license, word, tf)"""
    token = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
    return [(i, name, word, tf) for i, (name, text) in enumerate(templates)
            for word, tf in sorted(Counter(token.findall(ascii_lower_str(text))).items())]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(TOKEN), F.lit(0))


def word_weights(docs: DataFrame, words: list[str]) -> DataFrame:
    """(word, idf) for the words of the templates, and the idf of an unseen word under the null word."""
    spark = docs.sparkSession
    known = F.array(*map(F.lit, words))
    counts = docs.select(F.explode(F.array_append(F.array_intersect(tokens(F.coalesce("text", F.lit(""))), known), F.lit(" "))).alias("word")).groupBy(
        "word").agg(F.count("*").alias("_df"))  # every document counts once under a space
    counted, _ = write_table(counts, "idf")
    n = (counted.filter("word = ' '").first() or {"_df": 0})["_df"]
    idf = F.log((F.lit(float(n)) + 1) / (F.coalesce("_df", F.lit(0)) + 1)) + 1
    every = spark.createDataFrame([(w,) for w in words], "word string").join(counted, "word", "left").select("word", idf.alias("idf"))
    return every.unionByName(spark.range(1).select(F.lit(None).cast("string").alias("word"), (F.log(F.lit(float(n)) + 1) + 1).alias("idf")))


def needed_words(rows: list[tuple[int, str, str, int]], idf: dict[str, float], threshold: float) -> list[str]:
    """Words of which a passage has at least one if its cosine to a template reaches the threshold.

    Per template the commonest words are left out as long as their part of its norm stays below the threshold: a passage that shares no
    other word has a cosine of that part at most (Cauchy-Schwarz).  Cosines are rounded to six places, so the bound is a little lower.
    """
    vectors: dict[int, list[tuple[float, str, float]]] = {}
    for i, _, word, tf in rows:
        vectors.setdefault(i, []).append((idf[word], word, (tf * idf[word]) ** 2))
    needed = set()
    for vector in vectors.values():
        room = max(threshold - 1e-5, 0) ** 2 * sum(part for _, _, part in vector)
        for _, word, part in sorted(vector):
            room -= part
            if room <= 0:
                needed.add(word)
    return sorted(needed)


def passages(docs: DataFrame, needed: list[str]) -> DataFrame:
    """doc_id, path, passage, whole: the different sentences, lines, paragraphs and the text that hold one of the words."""
    words = F.array(*map(F.lit, needed)).cast("array<string>")
    holds = lambda x: F.arrays_overlap(tokens(x), words)
    text = F.coalesce("text", F.lit(""))
    cut = lambda x, pattern: F.split(x, pattern)
    parts = F.array_distinct(F.transform(F.concat(
        cut(F.col("_text"), r"\n|(?<=[.!?])\s+"), cut(F.col("_text"), r"\n"), cut(F.col("_text"), r"\n\s*\n"), F.array("_text")), F.trim))
    marked = docs.select("doc_id", "path", text.alias("_text")).filter(holds(F.col("_text")))
    return marked.select("doc_id", "path", F.explode(F.filter(parts, holds)).alias("passage"), F.trim("_text").alias("_whole")).select(
        "doc_id", "path", "passage", (F.col("passage") == F.col("_whole")).alias("whole"))


def own_licenses(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """doc_id, path, license, cosine, whole of the documents with a passage that reaches the threshold."""
    spark = docs.sparkSession
    rows = template_words(templates)
    weights, _ = write_table(word_weights(docs, sorted({w for _, _, w, _ in rows})), "weights")
    idf = weights.filter("word is not null")
    unseen = weights.filter("word is null").first()["idf"]
    posts = spark.createDataFrame(rows, "template int, license string, word string, tf int").join(idf, "word").select(
        "template", "license", "word", (F.col("tf") * F.col("idf")).alias("_t"))
    norms = posts.groupBy("template").agg(F.sqrt(F.sum(F.col("_t") * F.col("_t"))).alias("_norm"))
    posts, _ = write_table(posts.join(norms, "template").select("template", "license", "word", (F.col("_t") / F.col("_norm")).alias("_t")), "templates")

    # equal passages are compared once
    needed = needed_words(rows, {r["word"]: r["idf"] for r in idf.collect()}, threshold)
    found, _ = write_table(passages(docs, needed), "passages")
    texts = found.select(F.sha2("passage", 256).alias("_key"), "passage").dropDuplicates(["_key"])
    vectors, _ = write_table(texts.select("_key", F.explode(tokens(F.col("passage"))).alias("word")).groupBy("_key", "word").agg(
        F.count("*").alias("_tf")).join(idf, "word", "left").select(
        "_key", "word", (F.col("_tf") * F.coalesce("idf", F.lit(unseen))).alias("_p")), "vectors")
    size = vectors.groupBy("_key").agg(F.sqrt(F.sum(F.col("_p") * F.col("_p"))).alias("_norm"))
    dots = vectors.join(posts, "word").groupBy("_key", "template", "license").agg(F.sum(F.col("_p") * F.col("_t")).alias("_dot"))
    near = dots.join(size, "_key").withColumn("cosine", F.round(F.col("_dot") / F.col("_norm"), 6)).filter(F.col("cosine") >= threshold)
    best = near.groupBy("_key").agg(F.max(F.struct("cosine", "license")).alias("_b")).select("_key", "_b.*")
    scored = found.select("doc_id", "path", "whole", F.sha2("passage", 256).alias("_key")).join(best, "_key")
    return scored.groupBy("doc_id", "path").agg(F.max(F.struct("cosine", "license", "whole")).alias("_b")).select("doc_id", "path", "_b.*")


def directory(path: Column) -> Column:
    """All before the last slash; empty at the top and for null."""
    return F.regexp_extract(F.coalesce(path, F.lit("")), r"(?s)^(.*)/[^/]*$", 1)


def scan_licenses(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """doc_id, path, license, cosine, origin (own, inherited or null), license_dir for every row of ``docs`` (doc_id, path, text).

    Null text counts as empty and has no licence of its own.  A null path lies in the top directory and inherits from it.  Of equally near
    licences the last in order of names wins; of several licence files in a directory the one with the highest cosine, then the last name.
    Rows that repeat id and path share their best passage.  Whole texts are read, however long.  Empty table: no rows.
    """
    own, _ = write_table(own_licenses(docs, threshold, templates), "licenses")
    name = F.regexp_extract(F.coalesce("path", F.lit("")), r"(?s)([^/]*)$", 1)
    licensed = own.filter(name.rlike(FILE_NAME) | F.col("whole")).groupBy(directory(F.col("path")).alias("_at")).agg(
        F.max(F.struct("cosine", "license")).alias("_b")).select("_at", F.col("_b.license").alias("_l"), F.col("_b.cosine").alias("_c"))
    rows = docs.select("doc_id", "path", directory(F.col("path")).alias("_dir"))
    steps = F.split("_dir", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))
    climbed = rows.select("_dir").distinct().select("_dir", F.explode(F.array_distinct(F.array_append(up, F.lit("")))).alias("_at"))
    nearest = climbed.join(licensed, "_at").groupBy("_dir").agg(F.max(F.struct(
        F.length("_at").alias("n"), "_at", "_l", "_c")).alias("_near")).select("_dir", "_near")
    mine = own.select(F.col("doc_id").alias("_id"), F.col("path").alias("_path"), "license", "cosine")
    both = rows.join(mine, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("path").eqNullSafe(F.col("_path")), "left").join(nearest, "_dir", "left")
    return both.select(
        "doc_id", "path", F.coalesce("license", "_near._l").alias("license"), F.coalesce("cosine", "_near._c").alias("cosine"),
        F.when(F.col("license").isNotNull(), "own").when(F.col("_near").isNotNull(), "inherited").alias("origin"),
        F.when(F.col("license").isNull(), F.col("_near._at")).alias("license_dir"))
