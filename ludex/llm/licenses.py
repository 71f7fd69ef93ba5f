"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Words are lower-cased and lose the punctuation at their ends; what has no letter or digit, as
comment marks, is no word.  A window is two neighbouring word shingles (of five words, so six
words in all) and starts at every word.  Templates are cut into the same windows.  Each of
``bands`` bands is one MinHash: a window and a template window meet if any of their MinHashes
agree.  An unchanged stretch of two shingles meets surely; a template of one shingle lies in two
windows of a text that holds it, and misses a band only if both other shingles hash lower:
probability 1/3 a band, and 3^-8 < 2e-4 over eight bands.  Where a window was retrieved, the
stretches around it are verified exactly, word by word: the share of the template's shingles
that occur in a stretch must be at least ``least``.  Stretches are three templates long and
start at every multiple of the template's length, so a template with as many words again put
in between lies in one, and the work is linear in texts and templates.

Phrases are shorter than a shingle; they are found where their words stand in a row.

Only DataFrame expressions are used; the templates are the one broadcast side.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F

SHINGLE = 5

#: Wordings that public licences ask for.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                         "compliance with the License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
           "the following conditions are met:",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                      "associated documentation files, to deal in the Software without restriction.",
    "gpl-2.0-or-later-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                               "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
                               "option) any later version.",
    "gpl-3.0-or-later-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                               "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                               "option) any later version.",
    "lgpl-2.1-or-later-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
                                "General Public License as published by the Free Software Foundation; either version 2.1 of the License, "
                                "or (at your option) any later version.",
    "agpl-3.0-or-later-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
                                "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
                                "(at your option) any later version.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                      "distributed with this file, You can obtain one at",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
}

#: Full texts, a file each, named text:<SPDX id>.
TEXTS = Path(__file__).with_name("license_texts")

#: Notices shorter than a shingle.
PHRASES = {"all-rights-reserved": "All rights reserved."} | {f"spdx:{i}".lower(): f"SPDX-License-Identifier: {i}" for i in (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0",
    "CC0-1.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later",
    "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense")}


def shipped() -> dict[str, str]:
    """Wordings and full texts."""
    return TEMPLATES | {f"text:{p.stem}".lower(): p.read_text(encoding="utf-8") for p in sorted(TEXTS.glob("*.txt"))}


#: Between words: white space and the punctuation beside it.  A match begins where its run of
#: such characters begins, so long runs are read once.
BETWEEN = r"(?<![^\p{L}\p{N}\p{Z}\x09-\x0D\x85])[^\p{L}\p{N}\p{Z}\x09-\x0D\x85]*+[\p{Z}\x09-\x0D\x85][^\p{L}\p{N}]*+"


def _words(text: Column) -> Column:
    """The lower-cased words; [] where there is none."""
    cut = F.split(F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" ")), BETWEEN)
    return F.slice(cut, 2, F.greatest(F.lit(0), F.size(cut) - 2))


def _probes(rows: DataFrame, words: str, others: list[str], bands: int, sizes: list[int]) -> DataFrame:
    """(others, at, size, probe, run) for the window at every word: with size 0 the bands'
    MinHashes (the window at the last shingle has that shingle alone), with each of ``sizes``
    the hash of as many words from there on.  ``run`` has the words, for the exact comparison."""
    width = max([SHINGLE + 1, *sizes])
    ahead = [F.col(words)] + [F.slice(words, i, F.size(words)) for i in range(2, width + 1)]
    zipped = F.arrays_zip(*[c.alias(f"w{i}") for i, c in enumerate(ahead)])
    each = rows.select(*others, zipped.alias("_z")).select(*others, F.posexplode("_z").alias("at", "_w"))
    word = [F.col(f"_w.w{i}") for i in range(width)]
    first, second = F.xxhash64(*word[:SHINGLE]), F.xxhash64(*word[1:SHINGLE + 1])
    run = F.array(*word)
    each = each.select(*others, "at", run.alias("run"), first.alias("_a"), F.when(word[SHINGLE].isNotNull(), second).otherwise(first).alias("_b"),
                       *[F.when(word[n - 1].isNotNull(), F.xxhash64(*word[:n])).alias(f"_s{n}") for n in sizes],
                       word[SHINGLE - 1].isNotNull().alias("_full"))
    probes = [F.struct(F.lit(0).alias("size"), F.when(F.col("_full"), F.least(F.xxhash64("_a", F.lit(i)), F.xxhash64("_b", F.lit(i)))).alias("probe"))
              for i in range(bands)]
    probes += [F.struct(F.lit(n).alias("size"), F.col(f"_s{n}").alias("probe")) for n in sizes]
    return (each.select(*others, "at", "run", F.explode(F.array(*probes)).alias("_p"))
            .select(*others, "at", "run", "_p.size", "_p.probe").where(F.col("probe").isNotNull()))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text",
         bands: int = 8, least: float = 0.8, phrases: dict[str, str] | None = None) -> DataFrame:
    """(key, license, containment, from_word, matches) per row and template found in it.

    ``containment``: the best share of the template's shingles in one stretch of the text;
    ``from_word``: the first shingle's first word in such stretches, from 0, words as above;
    ``matches``: windows retrieved in them (phrases: places).  Templates need five words or
    more (ValueError), ``phrases`` one to four.  What is shipped is scanned if neither is given.

    Null, blank and short texts match nothing; repeated rows are found each; null keys stay;
    other columns aren't read.  An empty table, or no template, gives an empty result.
    """
    plain = templates is None and phrases is None
    given = sorted((shipped() if plain else templates or {}).items())
    short_given = sorted((PHRASES if plain else phrases or {}).items())
    spark = docs.sparkSession
    rows = [(*x, False) for x in given] + [(*x, True) for x in short_given]
    kinds = (spark.createDataFrame(rows, "license string, wording string, short boolean").select("license", "short", _words(F.col("wording")).alias("tw"))
             .withColumn("tn", F.size("tw")))
    # a few rows, whatever the documents
    counted = {(r.license, r.short): r.tn for r in kinds.select("license", "short", "tn").collect()}
    wrong = [name for (name, is_short), n in counted.items() if (not 1 <= n < SHINGLE if is_short else n < SHINGLE)]
    if wrong:
        raise ValueError(f"templates need {SHINGLE} words, phrases 1 to {SHINGLE - 1}: {wrong}")
    sizes = sorted({n for (_, is_short), n in counted.items() if is_short} | {SHINGLE})
    own = F.when(F.col("short"), F.col("tn")).otherwise(F.lit(SHINGLE))
    probes = (_probes(kinds, "tw", ["license", "tn", "short"], bands, sizes)
              .where((F.col("size") == own) | ((F.col("size") == 0) & ~F.col("short")))
              .select("license", "tn", "short", "size", "probe", F.when(F.col("size") > 0, F.slice("run", 1, F.greatest("size", F.lit(1)))).alias("wording"))
              .distinct())
    shares = probes.where("size > 0").groupBy("license", "short").agg(F.count(F.lit(1)).alias("of"))
    own_rows = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), _words(F.col(text)).alias("w"))
    met = (_probes(own_rows, "w", ["key", "row"], bands, sizes).join(F.broadcast(probes), ["size", "probe"])
           .where((F.col("size") == 0) | (F.slice("run", 1, F.greatest("size", F.lit(1))) == F.col("wording")))
           .select("key", "row", "license", "short", "tn", "at", F.when(F.col("size") > 0, F.array_join("wording", " ")).alias("shingle"))
           .distinct())
    # a place lies in the stretches that start at the last three multiples of the template's length
    block = F.floor(F.col("at") / F.col("tn"))
    spread = met.select("*", F.explode(F.when(F.col("short"), F.array(F.lit(0).cast("long"))).otherwise(F.array(block - 2, block - 1, block))).alias("stretch"))
    found = (spread.groupBy("row", "key", "license", "short", "stretch")
             .agg(F.countDistinct("shingle").alias("n"), F.min(F.when(F.col("shingle").isNotNull(), F.col("at"))).alias("place"),
                  F.collect_set(F.when(F.col("shingle").isNull() | F.col("short"), F.col("at"))).alias("windows"))
             .join(F.broadcast(shares), ["license", "short"]).withColumn("share", F.col("n") / F.col("of"))
             .where((F.col("share") >= least) & (F.size("windows") > 0)))
    return (found.groupBy("row", "key", "license")
            .agg(F.max("share").alias("containment"), F.min("place").cast("long").alias("from_word"),
                 F.size(F.array_distinct(F.flatten(F.collect_list("windows")))).cast("long").alias("matches"))
            .select(F.col("key").alias(key), "license", "containment", "from_word", "matches"))
