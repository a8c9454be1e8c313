"""Licences of files: sparse TF-IDF cosine of their sentences to licence notices, then inheritance along directories.

Every sentence or line of a whole file is a unit. Weights are term counts times the inverse document frequency over all
files; words outside the notices' vocabulary weigh as the mean of it, so only the vocabulary is counted. A unit can only
reach the threshold with a notice if it has one of the notice's heaviest terms, those whose removal leaves too
little of its norm (Cauchy-Schwarz); units without any are passed over, and no match is lost by that. The dot products
are a join on terms. A file's licence is that of its best unit.

A file without a licence of its own takes that of the nearest directory above it, its own directory first, that holds a
licence file (LICENSE, COPYING or NOTICE with any ending) with a recognised licence; of several in one directory the
surest, then the first by path. Directories are made distinct before they are joined, so one that holds a third of all
files is one row there.

The notices are a parameter; their vocabulary is broadcast and may have MAX_TERMS terms. Null texts have no licence of
their own. A file without a path inherits nothing. Rows equal in path and text get the same result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gopmill.llm.common import fresh
from gopmill.session import written

THRESHOLD = 0.6
MAX_TERMS = 100_000
FILE = "_file"
TERM = r"[\p{L}0-9]+"
UNITS = r"\n|(?<=[.!?;])[\x20\x09-\x0D]+"
LICENCE_FILE = r"(?i)(?:^|/)(?:license|licence|copying|notice)[^/]*$"
# fixed values: notices as they are commonly written, several for each licence
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD", "Use of this source code is governed by a BSD style license."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("proprietary", "All rights reserved."),
)


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _file() -> Column:
    return F.xxhash64(F.col("path"), F.col("text")).alias(FILE)


def notice_vectors(files: DataFrame, notices=NOTICES, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, float]:
    """(notice, licence, term, weight / norm, heavy), (term, idf) and the idf of other words."""
    spark = files.sparkSession
    units = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(notices)], "notice int, licence string, text string")
    counted = units.select("notice", "licence", F.explode(terms(F.col("text"))).alias("term")).groupBy("notice", "licence", "term").agg(F.count(F.lit(1)).alias("tf"))
    counted = written(counted)
    vocabulary = counted.select("term").distinct()
    if vocabulary.count() > MAX_TERMS:
        raise ValueError(f"the notices have more than {MAX_TERMS} terms")
    total = files.count()
    in_files = files.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).join(F.broadcast(vocabulary), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.lit(total) + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 1.0
    weights = written(vocabulary.join(in_files, "term", "left").select("term", idf.alias("idf")))
    other = weights.agg(F.avg("idf")).first()[0] or 1.0
    of_notice = Window.partitionBy("notice", "licence")  # a notice's terms are few
    weighted = counted.join(weights, "term").withColumn("raw", F.col("tf") * F.col("idf")).withColumn("norm", F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(of_notice)))
    scaled = weighted.withColumn("weight", F.col("raw") / F.col("norm"))
    # what is left of the norm before this term is taken off, heaviest first
    lighter = F.sum(F.col("weight") * F.col("weight")).over(of_notice.orderBy("weight", "term"))
    vectors = scaled.withColumn("heavy", lighter >= threshold * threshold * 0.999999).select("notice", "licence", "term", "weight", "heavy")
    return written(vectors), weights, float(other)


def unit_scores(files: DataFrame, notices=NOTICES, threshold: float = THRESHOLD) -> DataFrame:
    """(file, unit, notice, licence, score) of the units at least as near to a notice as the threshold."""
    vectors, weights, other = notice_vectors(files, notices, threshold)
    heavy = sorted(r.term for r in vectors.filter("heavy").select("term").distinct().collect())
    if not heavy:
        heavy = [""]
    asked = r"(?iu)(?<![\p{L}0-9])(?:" + "|".join(map(re.escape, heavy)) + r")(?![\p{L}0-9])"
    units = files.filter(F.col("text").rlike(asked)).select(_file(), F.posexplode(F.split("text", UNITS)).alias("unit", "line")).filter(F.col("line").rlike(asked))
    counted = units.distinct().select(FILE, "unit", F.explode(terms(F.col("line"))).alias("term")).groupBy(FILE, "unit", "term").agg(F.count(F.lit(1)).alias("tf"))
    weighted = written(counted.join(F.broadcast(weights), "term", "left").withColumn("raw", F.col("tf") * F.coalesce("idf", F.lit(other))))
    norms = weighted.groupBy(FILE, "unit").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    dots = weighted.join(F.broadcast(vectors), "term").groupBy(FILE, "unit", "notice", "licence").agg(F.sum(F.col("raw") * F.col("weight")).alias("dot"))
    return dots.join(norms, [FILE, "unit"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("score") >= threshold).drop("dot", "norm")


def own_licences(files: DataFrame, notices=NOTICES, threshold: float = THRESHOLD) -> DataFrame:
    """(file, licence, score, licences): the best unit's licence, and all that were found."""
    best = F.struct("score", F.negative("notice").alias("first"))
    return unit_scores(files, notices, threshold).groupBy(FILE).agg(
        F.max_by("licence", best).alias("licence"), F.max("score").alias("score"), F.array_sort(F.collect_set("licence")).alias("licences")
    )


def scan(files: DataFrame, notices=NOTICES, threshold: float = THRESHOLD) -> DataFrame:
    """``files`` (path, text and others) with licence, score, licences, inherited, inherited_from and effective after them."""
    name, folder = fresh(files, FILE), fresh(files, "_folder")
    plain = files.select("path", "text")
    own = written(own_licences(plain, notices, threshold))
    where = F.when(F.col("path").contains("/"), F.regexp_extract("path", r"^((?s).*)/[^/]*$", 1)).when(F.col("path").isNotNull(), F.lit(""))
    # licences of directories, from their licence files
    sources = plain.filter(F.col("path").rlike(LICENCE_FILE)).select("path", where.alias("above"), _file()).distinct().join(own, FILE)
    by = F.struct(F.negative("score").alias("score"), "path")
    held = sources.groupBy("above").agg(F.min_by("licence", by).alias("inherited"), F.min_by("path", by).alias("inherited_from"))
    # every directory with those above it, the root last
    folders = plain.filter("path is not null").select(where.alias("folder")).distinct()
    parts = F.when(F.col("folder") == "", F.array().cast("array<string>")).otherwise(F.split("folder", "/"))
    chain = folders.withColumn("parts", parts).select("folder", F.explode(F.transform(F.sequence(F.lit(0), F.size("parts")), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice("parts", F.lit(1), i), "/").alias("above")))).alias("x"))
    nearest = chain.select("folder", "x.depth", "x.above").join(held, "above").groupBy("folder").agg(
        F.max_by("inherited", "depth").alias("inherited"), F.max_by("inherited_from", "depth").alias("inherited_from")
    )
    found = own.select(F.col(FILE).alias(name), *[F.col(c).alias(f"{name}{c}") for c in ("licence", "score", "licences")])
    above = nearest.select(F.col("folder").alias(folder), *[F.col(c).alias(f"{name}{c}") for c in ("inherited", "inherited_from")])
    every = files.withColumn(name, _file()).withColumn(folder, where).join(found, name, "left").join(above, folder, "left")
    got = lambda c: F.col(f"{name}{c}")
    alone = got("licence").isNull()
    return every.select(
        *files.columns, got("licence").alias("licence"), F.coalesce(got("score"), F.lit(0.0)).alias("score"), F.coalesce(got("licences"), F.array().cast("array<string>")).alias("licences"),
        F.when(alone, got("inherited")).alias("inherited"), F.when(alone, got("inherited_from")).alias("inherited_from"), F.coalesce(got("licence"), got("inherited")).alias("effective"),
    )


def as_files(docs: DataFrame) -> DataFrame:
    """Documents have no paths: they are put into folders of source, language and a block of ids.

    One whose last line speaks of a licence stands for a licence file, of the folder, the language or the source by turns.
    """
    at = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.floor(F.col("doc_id") / 100).cast("string"))
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    last = F.lower(F.substring_index("text", "\n", -1)).rlike("licen[cs]e")
    level = F.coalesce(F.pmod("doc_id", F.lit(3)), F.lit(0)).cast("int")
    path = F.when(last, F.concat_ws("/", F.substring_index(at, "/", 1), F.when(level > 0, F.element_at(F.split(at, "/"), 2)), F.when(level > 1, F.element_at(F.split(at, "/"), 3)), F.concat(F.lit("LICENSE-"), id_text)))
    return docs.select("doc_id", F.coalesce(path, F.concat_ws("/", at, id_text)).alias("path"), "text")


def op3(docs: DataFrame) -> DataFrame:
    return scan(as_files(docs)).select("doc_id", "path", "licence", "score", F.array_join("licences", ",").alias("licences"), "inherited", "inherited_from", "effective")
