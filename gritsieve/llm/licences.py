"""Licence scan in SQL: TF-IDF cosine of parts of texts to templates, then inheritance.

Parts are sentences (lines too end sentences), paragraphs, up to eight of them in a row
and, of licence files, the whole text, which is held against the texts whose title it has. They are compared with statements, headers and
texts of licences; SPDX identifiers count as they stand. A part can only reach the threshold if
it has one of a template's heavy words, those without which the rest of the template is
too light; parts without any are not split into words. Weights come from the words' document counts in the whole
table, for the words of templates and of parts alike. Files without a licence of their own take that of the licence file in the nearest
directory above them.
"""

from __future__ import annotations

import math
from collections import Counter
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritsieve.llm.common import stage
from gritsieve.llm.licence_headers import HEADERS, TITLES, whole_texts

#: Identifiers and customary statements of licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3",
    "MPL-2.0": "This work is subject to the terms of the Mozilla Public License, version 2.0",
    "BSD-3-Clause": "Licensed under the BSD 3 Clause License",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY NC 4.0",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}
THRESHOLD = 0.8
LICENCE_FILE = "(?i)(^|/)(licen[cs]e|copying|unlicense)([.][a-z]+)?$"
PARAGRAPHS = r"\n[^a-z0-9\n]*(?=\n)"  # lines without words, comment marks or none, lie between
HEADER_PARAGRAPHS = 8  # a header with its title and copyright line has no more
SPDX = r"spdx-license-identifier:\s*\(?([a-z0-9.-]+)"
BROADCAST_WORDS = 1_000_000
SENTENCES = r"\n|(?<=[.!?;])[ \t]+"


def words(text: str) -> list[str]:
    return [x for x in re.split("[^a-z0-9]+", text.lower()) if x]


def heavy(weights: dict[str, float], threshold: float) -> set[str]:
    """The fewest words without which a text stays below the threshold (by Cauchy and
    Schwarz, with the share of the length that the other words have)."""
    total = sum(x * x for x in weights.values())
    left, found = total, set()
    for word in sorted(weights, key=lambda x: (-weights[x], x)):
        if left < threshold * threshold * total * (1 - 1e-9):
            break
        found.add(word)
        left -= weights[word] ** 2
    return found


def document_counts(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """In how many texts each wanted word is."""
    few = wanted.count() <= BROADCAST_WORDS
    every = base.selectExpr("explode(array_distinct(split(lower(text), '[^a-z0-9]+'))) AS word")
    return every.join(F.broadcast(wanted) if few else wanted, "word", "left_semi").groupBy("word").count()


def own_licences(
    df: DataFrame, text: str = "text", id: str = "doc_id", threshold: float = THRESHOLD, path: str | None = None
) -> DataFrame:
    """id, own_licence and score of each row with a part that reaches the threshold: the
    best one, of equal ones the first by name. Null and empty texts have none; rows that
    share an id share the result. path: the column that tells licence files, if any."""
    spark = df.sparkSession
    is_file = F.coalesce(F.col(path).cast("string").rlike(LICENCE_FILE), F.lit(False)) if path else F.lit(False)
    base = df.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"), is_file.alias("file"))
    short = [*TEMPLATES.items(), *HEADERS]
    every = [*((*x, False) for x in short), *((*x, True) for x in whole_texts())]
    terms = sorted({w for _, template, _ in every for w in words(template)})
    total = base.agg(F.count("text")).first()[0]
    rows = {
        x["word"]: x["count"]  # one for each word of the templates
        for x in document_counts(base, spark.createDataFrame([(w,) for w in terms], "word string")).collect()
    }
    weight = {x: math.log((1 + total) / (1 + rows.get(x, 0))) + 1 for x in terms}
    vectors, needed = [], set()
    for number, (name, template, whole) in enumerate(every):
        vector = {w: n * weight[w] for w, n in Counter(words(template)).items()}
        length = math.sqrt(sum(x * x for x in vector.values()))
        vectors += [(number, name, whole, w, x / length) for w, x in vector.items()]
        if not whole:
            needed |= heavy(vector, threshold)
    templates = spark.createDataFrame(vectors, "template int, licence string, whole boolean, word string, part double")
    has_heavy = "(^|[^a-z0-9])(" + "|".join(sorted(needed)) + ")([^a-z0-9]|$)"
    # a header may stand anywhere: up to so many paragraphs in a row, where one has a heavy word
    runs = f"transform(sequence(1, {HEADER_PARAGRAPHS}), n -> IF(exists(slice(heavy, i + 1, n), y -> y), array_join(slice(paragraphs, i + 1, n), ' '), NULL))"
    headers = f"filter(flatten(transform(paragraphs, (x, i) -> {runs})), x -> x IS NOT NULL)"
    low = base.withColumn("low", F.lower("text"))
    part = (
        low.where(F.col("low").rlike(has_heavy)).withColumn("paragraphs", F.split("low", PARAGRAPHS))
        .withColumn("heavy", F.transform("paragraphs", lambda x: x.rlike(has_heavy)))
        .select("id", F.explode(F.array_distinct(F.concat(F.split("low", SENTENCES), F.expr(headers)))).alias("part"), F.lit(False).alias("whole"))
        .where(F.col("part").rlike(has_heavy))
        .unionByName(low.where("file AND low IS NOT NULL").selectExpr("id", "low AS part", "true AS whole"))
        .withColumn("key", F.xxhash64("id", "part", "whole"))
    )
    # the title that stands first names the text; others are mentioned in it
    listed = ", ".join(f"named_struct('at', instr(plain, '{title}'), 'name', '{name}')" for name, title in TITLES.items())
    plain = "IF(whole, concat(regexp_replace(part, '[^a-z0-9]+', ' '), ' '), '') AS plain"
    mentioned = F.expr(f"filter(array({listed}), x -> x.at > 0)")
    titled = F.expr("transform(filter(mentioned, x -> x.at = array_min(transform(mentioned, y -> y.at))), x -> x.name)")
    vector = stage(
        part.dropDuplicates(["key", "id"]).selectExpr("*", plain).withColumn("mentioned", mentioned).withColumn("titled", titled)
        .select("key", "id", "titled", F.explode(F.split("part", "[^a-z0-9]+")).alias("word")).where("word <> ''")
        .groupBy("key", "id", "titled", "word").agg(F.count("*").alias("n"))
    )
    counts = document_counts(base, stage(vector.select("word").distinct()))
    weights = stage(counts.selectExpr("word", f"ln({1 + total}D / (1 + count)) + 1 AS weight"))
    few = weights.count() <= BROADCAST_WORDS
    vector = vector.join(F.broadcast(weights) if few else weights, "word").withColumn("weight", F.col("n") * F.col("weight"))
    lengths = vector.groupBy("key", "id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    dots = (
        vector.join(F.broadcast(templates), "word").where("NOT whole OR array_contains(titled, licence)")
        .groupBy("key", "id", "template", "licence").agg(F.sum(F.col("weight") * F.col("part")).alias("dot"))
    )
    scored = dots.join(lengths, ["key", "id"]).withColumn("score", F.round(F.col("dot") / F.col("length"), 6))
    known = {name.lower(): name for name, _, _ in every}
    known |= {f"{x}{end}": name for x, name in known.items() if "gpl" in x for end in ("-only", "-or-later")}
    spelt = ", ".join(f"'{x}', '{name}'" for x, name in sorted(known.items()))
    spdx = (
        low.where("low LIKE '%spdx-license-identifier:%'")
        .select("id", F.explode(F.regexp_extract_all("low", F.lit(SPDX), F.lit(1))).alias("spelt"))
        .select("id", F.expr(f"map({spelt})[spelt]").alias("licence"), F.lit(1.0).alias("score")).where("licence IS NOT NULL")
    )
    best = F.min(F.struct((-F.col("score")).alias("minus"), "licence"))
    return (
        scored.where(F.col("score") >= threshold).select("id", "licence", "score").unionByName(spdx)
        .groupBy("id").agg(best.alias("best"))
        .select("id", F.col("best.licence").alias("own_licence"), (-F.col("best.minus")).alias("score"))
    )


def licences(
    df: DataFrame, path: str = "path", text: str = "text", id: str = "doc_id", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per row of df: id, path, own_licence, score, licence, inherited_from.

    licence is the file's own one, or else that of the licence file (a name such as
    LICENSE or COPYING) in the nearest directory at or above it; of several in one
    directory the best score counts, then the smallest path. Paths are parted by slashes;
    files at the top have the directory ''. Null paths and files under no licence
    inherit nothing. Null ids have no own licence. An empty table gives no rows.
    """
    files = df.select(F.col(id).cast("long").alias("id"), F.col(path).cast("string").alias("path")).withColumn(
        "dir", F.regexp_replace("path", "/?[^/]*$", "")
    )
    own = files.join(own_licences(df, text, id, threshold, path), "id", "left")
    best = F.min(F.struct((-F.col("score")).alias("minus"), "path", "own_licence"))
    given = own.where(F.col("own_licence").isNotNull() & F.col("path").rlike(LICENCE_FILE)).groupBy("dir").agg(
        best.alias("best")
    ).select(F.col("dir").alias("above"), F.col("best.own_licence").alias("licence"), F.col("best.path").alias("from"))
    # directories, not files, look for what is above them
    dirs = files.where("dir IS NOT NULL").select("dir").distinct()
    above = dirs.selectExpr(
        "dir", "explode(array_distinct(concat(array(''), transform(sequence(1, size(split(dir, '/'))), "
        "i -> array_join(slice(split(dir, '/'), 1, i), '/'))))) AS above",
    )
    nearest = F.max(F.struct(F.length("above").alias("depth"), "licence", "from"))
    inherited = above.join(given, "above").groupBy("dir").agg(nearest.alias("n")).select(
        "dir", F.col("n.licence").alias("dir_licence"), F.col("n.from").alias("dir_from")
    )
    return own.join(inherited, "dir", "left").select(
        F.col("id").alias(id), "path", "own_licence", "score",
        F.coalesce("own_licence", "dir_licence").alias("licence"),
        F.when(F.col("own_licence").isNull(), F.col("dir_from")).alias("inherited_from"),
    )
