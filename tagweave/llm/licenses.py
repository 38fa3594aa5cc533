"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

Texts and templates are sets of five-word shingles. Shingles that no template has cannot add to a containment, so
windows are taken over the others alone, numbered per text and class: however much other text stands around a template
or between its words, its shingles follow each other. Templates of like length, within a factor of two, form a class
with windows of its own, twice as long as its longest template and overlapping by half, so each occurrence lies whole
in some window unless shingles of other templates of its class stand inside it. A template contained to 0.8 then has a
Jaccard similarity J of 0.19 or more with that window; `BANDS` bands of one MinHash value retrieve it with probability
1 - (1 - J) ** BANDS, short of 1 by 1.4e-6 at most. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.common import table, text_of

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 64
#: Shingles of all templates together that may be broadcast.
TEMPLATE_SHINGLES = 50_000

# Names, families and wordings of public license notices.
TEMPLATES = (
    ("MIT-short", "MIT", "Released under the MIT License."),
    ("MIT-terms", "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
     "software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
     "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or "
     "sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
     "following conditions:"),
    ("Apache-2.0-short", "Apache", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header", "Apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not "
     "use this file except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0-short", "GPL", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-short", "GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-notice", "GPL", "This program is free software: you can redistribute it and/or modify it under the "
     "terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
     "License, or (at your option) any later version."),
    ("MPL-2.0-notice", "MPL", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
     "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-terms", "BSD", "Redistribution and use in source and binary forms, with or without modification, are "
     "permitted provided that the following conditions are met:"),
    ("ISC-terms", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
     "without fee is hereby granted, provided that the above copyright notice and this permission notice appear in "
     "all copies."),
    ("CC-BY-4.0-short", "CC", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0-short", "CC", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0-short", "CC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0-notice", "CC", "This work is licensed under a Creative Commons Attribution 4.0 International "
     "License."),
)


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES), "license string, family string, text string")


def shingles(text: Column) -> Column:
    """Hashes of all runs of five words (lower-case letters and digits), in order; none for fewer words."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")
    # the word list is bound once, as the one element of an array
    made = F.transform(F.array(words), lambda w: F.when(F.size(w) >= SHINGLE, F.transform(
        F.sequence(F.lit(0), F.size(w) - SHINGLE),
        lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))).otherwise(F.array().cast("array<bigint>")))
    return made[0]


def size_class(n: Column) -> Column:
    """Templates of up to 2, 4, 8, ... shingles share windows."""
    return F.ceil(F.log(F.greatest(n, F.lit(1))) / F.log(F.lit(2)) - 1e-9).cast("int")


def described(spark: SparkSession, given: DataFrame) -> DataFrame:
    """Templates with their distinct shingles `own`, number `n`, size class `c` and `length`, counting repeats."""
    cut = given.filter(F.col("text").isNotNull()).select("license", "family", shingles(F.col("text")).alias("all"))
    own = cut.select("license", "family", F.array_distinct("all").alias("own"), F.size("all").alias("length"))
    return own.withColumn("n", F.size("own")).withColumn("c", size_class(F.col("n"))).filter("n > 0")


def minima(own: Column) -> Column:
    """One MinHash value of a set of hashes per band."""
    def least(band: int) -> Column:
        return F.array_min(F.transform(own, lambda x: F.xxhash64(x, F.lit(band))))

    return F.array(*[least(k) for k in range(BANDS)])


def scan(docs: DataFrame, given: DataFrame | None = None, text: str = "text", key: str = "doc_id",
         containment: float = CONTAINMENT) -> DataFrame:
    """One row per document and license found: key, license, family, n_shared, n_shingles, containment, best.

    A license is found if one window holds at least the share `containment` of its template's shingles; `n_shared`
    is the most that a window holds. `best` marks the license of each family with the highest containment (ties:
    more shingles, then the first name). `given` has columns license, family, text (default: TEMPLATES); templates
    of fewer than five words are passed over. Null, empty and shorter texts hold none. A repeated row is found once;
    rows without a key are found with a null key. Other columns are not looked at; empty tables give no rows.
    """
    spark = docs.sparkSession
    known = described(spark, templates(spark) if given is None else given)
    listed = known.collect()  # bounded, checked here
    if sum(r.n for r in listed) > TEMPLATE_SHINGLES:
        raise ValueError(f"the templates have more than {TEMPLATE_SHINGLES} shingles: scan for them in parts")
    longest = {c: max(r.length for r in listed if r.c == c) for c in {r.c for r in listed}}
    every = sorted({s for r in listed for s in r.own})
    of_class = sorted({(s, r.c, longest[r.c]) for r in listed for s in r.own})
    marks = spark.createDataFrame(of_class, "s long, c int, step int")
    spelled = spark.createDataFrame([tuple(r) for r in listed], known.schema)
    bands = spelled.select("license", "family", "own", "n", "c", F.posexplode(minima(F.col("own"))).alias("band", "value"))

    cut = docs.select(F.col(f"`{key}`").alias("doc"), text_of(text).alias("t")).select(
        "doc", F.xxhash64("t").alias("body"), shingles(F.col("t")).alias("all"))
    hit = cut.filter(F.arrays_overlap("all", F.lit(every).cast("array<bigint>"))) if every else cut.filter(F.lit(False))
    places = hit.select("doc", "body", F.posexplode("all").alias("i", "s")).join(F.broadcast(marks), "s")
    # the template shingles of a class in one text, in order; copies of a row give the same places
    rows = places.groupBy("doc", "body", "c", "step").agg(F.sort_array(F.collect_set(F.struct("i", "s"))).alias("p"))
    steps = F.sequence(F.lit(0), F.floor((F.size("p") - 1) / F.col("step")).cast("int"))
    cuts = F.transform(steps, lambda w: F.array_distinct(F.slice(F.col("p.s"), w * F.col("step") + 1, 2 * F.col("step"))))
    windows = rows.select("doc", "body", "c", F.explode(cuts).alias("held"))
    banded = windows.select("doc", "body", "c", "held", F.posexplode(minima(F.col("held"))).alias("band", "value"))
    shared = F.size(F.array_intersect("held", "own"))
    found = (banded.join(F.broadcast(bands), ["c", "band", "value"]).withColumn("shared", shared)
             .filter(F.col("shared") >= F.lit(containment) * F.col("n") - 1e-9)
             .groupBy("doc", "body", "license", "family", "n").agg(F.max("shared").alias("n_shared")))
    per_doc = found.groupBy("doc", "body", "family").agg(F.max(F.struct(
        (F.col("n_shared") / F.col("n")).alias("share"), F.col("n"))).alias("top"),
        F.collect_list(F.struct("license", "n", "n_shared")).alias("all"))
    leading = F.array_min(F.transform(F.filter("all", lambda x: (x["n"] == F.col("top.n"))
                                               & (x["n_shared"] / x["n"] == F.col("top.share"))), lambda x: x["license"]))
    return per_doc.select("doc", "family", leading.alias("lead"), F.explode("all").alias("x")).select(
        F.col("doc").alias(key), F.col("x.license").alias("license"), "family",
        F.col("x.n_shared").cast("long").alias("n_shared"), F.col("x.n").cast("long").alias("n_shingles"),
        (F.col("x.n_shared") / F.col("x.n")).alias("containment"), (F.col("x.license") == F.col("lead")).alias("best"))


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan(table(spark, folder, "documents"))
