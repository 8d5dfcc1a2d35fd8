"""License scan in SQL expressions: MinHash bands over overlapping windows retrieve notices, containment verifies."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import fresh, sized, table

#: Notices by license (fixed values).
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "proprietary": ["Copyright, all rights reserved. No part of this work may be reproduced without permission."],
}
WORDS = 5
#: Share of a notice's shingles that a text must hold close together.
CONTAINMENT = 0.8
#: Windows of so many shingles begin at every half of it. Notices are cut into segments that fit in half a window.
WINDOW = 32
#: MinHash: one hash a band, over a segment's own shingles alone. A band meets where the segment's least shingle is
#: held, so a segment held to a share s is met but for (1 - s)**BANDS, and of a notice that is found some segment is
#: held to the wanted containment. More bands are taken where that is low.
BANDS = 24
LOSS = 1e-12
#: Shingles of all notices that may travel inside the plan.
MOST_SHINGLES = 100_000


def _tokens(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def segments(notices: dict[str, list[str]], words: int = WORDS, window: int = WINDOW) -> list[tuple[str, int, int, int, list[str]]]:
    """(license, notice, shingles of the notice, segment, shingles): shingles as word strings, notices cut evenly."""
    out = []
    for license_id, texts in notices.items():
        for number, text in enumerate(texts):
            t = _tokens(text)
            if len(t) < words:
                raise ValueError(f"a notice needs {words} words: {text!r}")
            grams = list(dict.fromkeys(" ".join(t[i : i + words]) for i in range(len(t) - words + 1)))
            half = window // 2
            parts = -(-len(grams) // half)
            for k in range(parts):
                out.append((license_id, number, len(grams), k, grams[k * len(grams) // parts : (k + 1) * len(grams) // parts]))
    return out


def word_array(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits; null text gives none."""
    cleaned = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))
    return F.filter(F.split(cleaned, " "), lambda w: w != "")


def minhash(items: Column, bands: int) -> Column:
    """Array of (band, least hash of the items under the band's seed)."""

    def least(band: int) -> Column:
        return F.array_min(F.transform(items, lambda x: F.xxhash64(x, F.lit(band * 7919 + 17))))

    return F.array(*[F.struct(F.lit(b).alias("band"), least(b).alias("value")) for b in range(bands)])


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", notices: dict[str, list[str]] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """Rows (key, license, notice, position, contained): each place where a text holds a notice.

    Position is the word at which the first held shingle of the notice starts, contained the share of its shingles.
    A key's rows count as one text if their texts are equal. Null, empty and short texts hold nothing. The notices'
    shingles are looked up while a text is read, so only hits are shuffled; notices are bounded by MOST_SHINGLES.
    """
    spark = df.sparkSession
    cut = segments(notices or NOTICES)
    vocabulary = sorted({s for *_, own in cut for s in own})
    if len(vocabulary) > MOST_SHINGLES:
        raise ValueError(f"notices have {len(vocabulary)} shingles; split them into scans of {MOST_SHINGLES}")
    firsts = sorted({s.split(" ")[0] for s in vocabulary})
    k, tokens, text_key = fresh([], "k", "tokens", "text_key")
    rows = df.select(F.col(key).alias(k), F.xxhash64(text).alias(text_key), word_array(F.col(text)).alias(tokens)).filter(F.size(tokens) >= WORDS)
    # Shingles are built only where a word begins one of the notices'; those that are a notice's are hits.
    begins = F.filter(F.transform(F.col(tokens), lambda w, i: F.when(w.isin(firsts), i)), lambda i: i.isNotNull() & (i <= F.size(tokens) - WORDS))
    built = F.transform(begins, lambda i: F.struct(i.alias("at"), F.array_join(F.slice(F.col(tokens), i + 1, WORDS), " ").alias("shingle")))
    hits = F.filter(built, lambda s: s["shingle"].isin(vocabulary))
    hit = rows.select(k, text_key, F.inline(hits)).withColumn("h", F.xxhash64("shingle")).drop("shingle")
    listed = spark.createDataFrame([(a, b, n, s, g) for a, b, n, s, own in cut for g in own], "license string, notice int, size int, segment int, shingle string")
    listed = listed.select("license", "notice", "size", "segment", F.xxhash64("shingle").alias("h"))
    segment = ["license", "notice", "size", "segment"]
    bands = max(BANDS, math.ceil(math.log(LOSS) / math.log(1 - min(containment, 0.9))))
    known = listed.groupBy(*segment).agg(F.collect_set("h").alias("own")).select(*segment, minhash(F.col("own"), bands).alias("bands"))
    half = WINDOW // 2
    spread = hit.join(sized(listed), "h").withColumn("window", F.explode(F.array(F.floor(F.col("at") / half), F.floor(F.col("at") / half) - 1)))
    windows = spread.groupBy(k, text_key, "window", *segment).agg(F.collect_set("h").alias("items"), F.collect_set(F.struct("h", "at")).alias("places"))
    met = windows.join(sized(known), segment).withColumn("met", F.arrays_overlap(minhash(F.col("items"), bands), F.col("bands")))
    # All places of a notice count, those of segments and windows that did not meet too; places follow each other less gaps over half a window.
    one = met.select(k, text_key, "license", "notice", "size", "met", F.explode("places").alias("p")).groupBy(k, text_key, "license", "notice", "size", "p.h", "p.at").agg(F.max("met").alias("met"))
    order = W.partitionBy(k, text_key, "license", "notice").orderBy("at")
    gap = F.col("at") - F.lag("at").over(order) > WINDOW // 2
    runs = one.withColumn("run", F.sum(F.when(gap, 1).otherwise(0)).over(order))
    found = runs.groupBy(k, text_key, "license", "notice", "size", "run").agg(F.min("at").alias("position"), F.size(F.collect_set("h")).alias("n"), F.max("met").alias("met")).filter("met")
    found = found.withColumn("contained", F.col("n") / F.col("size")).filter(F.col("contained") >= containment)
    return found.select(F.col(k).alias(key), "license", "notice", F.col("position").cast("int").alias("position"), "contained")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _oracle() -> str:
    """The notices of at most a window, found by their shingles alone: what the scan is to return."""
    rows = [(a, b, n, g) for a, b, n, _, own in segments(NOTICES) for g in own]
    values = ", ".join(f"({_literal(a)}, {b}, {n}, {_literal(g)})" for a, b, n, g in rows)
    return f"""
WITH notices(license, notice, size, shingle) AS (VALUES {values}),
w AS (SELECT doc_id, text, list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS t FROM documents),
s AS (SELECT doc_id, hash(text) AS k, t, unnest(range(len(t) - {WORDS - 1})) AS pos_at FROM w WHERE len(t) >= {WORDS}),
h AS (SELECT doc_id, k, pos_at, array_to_string(list_slice(t, pos_at + 1, pos_at + {WORDS}), ' ') AS shingle FROM s),
m AS (SELECT DISTINCT doc_id, k, license, notice, size, pos_at, shingle FROM h JOIN notices USING (shingle)),
g AS (SELECT *, CASE WHEN pos_at - lag(pos_at) OVER (PARTITION BY doc_id, k, license, notice ORDER BY pos_at) > {WINDOW // 2} THEN 1 ELSE 0 END AS cut FROM m),
r AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id, k, license, notice ORDER BY pos_at ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT doc_id, license, CAST(notice AS INTEGER) AS notice, CAST(min(pos_at) AS INTEGER) AS position, count(DISTINCT shingle) / max(size)::DOUBLE AS contained
FROM r GROUP BY doc_id, k, license, notice, run HAVING count(DISTINCT shingle) / max(size)::DOUBLE >= {CONTAINMENT}
"""


OP7_SQL = _oracle()
