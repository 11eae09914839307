"""Licences of files: TF-IDF cosine of their lines to templates, and inheritance by directory.

A licence header is a line here, and every line of a file is looked at. Document frequencies of all
words come from all files. A line that lacks the words without
which no template can reach the threshold is passed over early; that test follows from the
weights and loses nothing. A file without a header of its own takes the licence of the nearest
directory above it that holds a licence file. Only DataFrame functions are used.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancewright.llm.scratch import written

# Short notices by which common licences are declared.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "Subject to the terms of the Mozilla Public License, version 2.0.",
}
#: File names that speak for their directory.
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|unlicense)(\..*)?$"
BETWEEN = "[^a-z0-9]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), BETWEEN), lambda w: w != "")


def _template_words(templates: DataFrame) -> list:
    """Words of each template with their counts: the template table is a short list."""
    rows = templates.select("name", F.explode(words(F.col("notice"))).alias("word"))
    return rows.groupBy("name", "word").agg(F.count(F.lit(1)).alias("n")).orderBy("name", "word").collect()


def key_words(weights: Mapping[str, Mapping[str, float]], threshold: float) -> list[str]:
    """Words of which a line needs one at least to reach the threshold with any template.

    The words of a template that are left out, the lightest ones, make up less than the
    threshold of its length, so that a line with no others cannot reach it.
    """
    keys = set()
    for vector in weights.values():
        length2 = sum(w * w for w in vector.values())
        left_out = 0.0
        for word, w in sorted(vector.items(), key=lambda x: (x[1], x[0])):
            left_out += w * w
            if left_out >= threshold**2 * length2 * (1 - 1e-9):
                keys.add(word)
    return sorted(keys)


def match_headers(
    files: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = 0.7
) -> DataFrame:
    """``file``, ``own_license``, ``cosine`` of the files with a line near a template.

    ``files`` has a unique ``file`` and ``text``. Of equally near templates the first name wins; a file
    takes its nearest line. A word weighs by the number of files that hold it, whether a template has it
    or not, so that a header's cosine does not depend on the size of the corpus.
    """
    spark = files.sparkSession
    table = _template_words(spark.createDataFrame(sorted(templates.items()), "name string, notice string"))
    vocabulary = sorted({r["word"] for r in table})
    n = files.count()
    held = files.select(F.explode(F.array_distinct(words(F.coalesce("text", F.lit(""))))).alias("word"))
    counts = written(held.groupBy("word").agg(F.count(F.lit(1)).alias("df")), "word-files")
    # One row per word of the templates.
    df = {r["word"]: r["df"] for r in counts.where(F.col("word").isin(vocabulary)).collect()}
    idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in vocabulary}
    weights: dict[str, dict[str, float]] = {}
    for r in table:
        weights.setdefault(r["name"], {})[r["word"]] = r["n"] * idf[r["word"]]
    needed = F.array(*[F.lit(w) for w in key_words(weights, threshold)])
    lines = files.select("file", F.posexplode(F.split("text", "\n")).alias("line", "header"))
    lines = lines.select("file", "line", words(F.col("header")).alias("words")).where(F.arrays_overlap("words", needed))
    counted = written(
        lines.select("file", "line", F.explode("words").alias("word"))
        .groupBy("file", "line", "word").agg(F.count(F.lit(1)).alias("n")),
        "header-words",
    )
    entries = [
        (name, word, w / math.sqrt(sum(x * x for x in vector.values())))
        for name, vector in sorted(weights.items()) for word, w in sorted(vector.items())
    ]
    # Has the size of the template list.
    vectors = F.broadcast(spark.createDataFrame(entries, "name string, word string, weight double"))
    rarity = F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1
    weighed = counted.join(counts, "word").withColumn("w", F.col("n") * rarity)
    length = weighed.groupBy("file", "line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    dots = weighed.join(vectors, "word").groupBy("file", "line", "name").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    near = dots.join(length, ["file", "line"]).select(
        "file", "name", F.round(F.col("dot") / F.col("length"), 6).alias("cosine")
    ).where(F.col("cosine") >= threshold)
    best = near.groupBy("file").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "name")).alias("x"))
    return best.select("file", F.col("x.name").alias("own_license"), (-F.col("x.c")).alias("cosine"))


def parent(path: Column) -> Column:
    """Directory of a path, '' at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def ancestors(directory: Column) -> Column:
    """The directory itself and all above it, as (depth, path)."""
    parts = F.split(directory, "/")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, F.lit(1), d), "/").alias("above")),
    )


def inherited(paths: DataFrame, headers: DataFrame) -> DataFrame:
    """``directory``, ``from_directory``, ``license`` of the directories below a licence file.

    Worked out once per directory, not per file, so that a directory with a third of all files
    is one row. Of several licence files the nearest match speaks, then the first name.
    """
    spoken = (
        paths.where(F.regexp_extract("path", "([^/]*)$", 1).rlike(LICENSE_FILE)).join(headers, "file")
        .groupBy(F.col("directory").alias("above"))
        .agg(F.min(F.struct((-F.col("cosine")).alias("c"), "own_license"))["own_license"].alias("license"))
    )
    above = paths.select("directory").distinct().select(
        "directory", F.explode(ancestors(F.col("directory"))).alias("x")
    ).select("directory", "x.depth", "x.above")
    return (
        above.join(spoken, "above").groupBy("directory")
        .agg(F.max(F.struct("depth", "above", "license")).alias("x"))
        .select("directory", F.col("x.above").alias("from_directory"), F.col("x.license").alias("license"))
    )


def scan_licenses(
    files: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = 0.7,
    id_col: str = "doc_id", path: Column | None = None, text_col: str = "text",
) -> DataFrame:
    """One row per row of ``files``: id, path, own_license, cosine, from_directory, license.

    ``license`` is the file's own, or else that of the nearest directory above it; NULL if there
    is neither. ``from_directory`` tells where an inherited one comes from. NULL and empty texts
    have no header and inherit; a NULL path lies at the top, where a licence file speaks for
    all. Rows that repeat id, path and text are each judged alike; an empty table gives an
    empty one; other columns are not read.
    """
    where = F.coalesce((F.col("path") if path is None else path).cast("string"), F.lit(""))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = files.select(F.col(f"`{id_col}`").alias("_id"), where.alias("path"), text.alias("text")).withColumn(
        "file", F.struct(F.col("_id").cast("string").alias("id"), F.xxhash64("path", "text").alias("h"))
    )
    headers = written(match_headers(rows.select("file", "text"), templates, threshold), "license-headers")
    paths = written(
        rows.select("_id", "file", "path", parent(F.col("path")).alias("directory")), "file-paths"
    )
    below = inherited(paths, headers)
    joined = paths.join(headers, "file", "left").join(below, "directory", "left")
    own = F.col("own_license")
    return joined.select(
        F.col("_id").alias(id_col), "path", "own_license", "cosine",
        F.when(own.isNull(), F.col("from_directory")).alias("from_directory"),
        F.coalesce(own, F.col("license")).alias("license"),
    )
