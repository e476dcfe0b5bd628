"""Licence scan by Dice coefficient over word bigrams, in DataFrame functions only.

The units compared are the lines of a text, the text as a whole, and windows of its words, normalised to
lower-case words (runs of letters and digits).  Two bigram sets of a and b elements can only reach a
coefficient t if t / (2 - t) <= a / b <= (2 - t) / t, so each template is listed once under every unit size
that it can match, and a line or text meets only the templates listed under its own size: a broadcast
equi-join with a table whose size the fixed templates bound.

Windows find the notices that are wrapped over lines or stand among other words.  A match shares at least
the least listed size of bigrams with its template, so only texts that hold that many of them are looked
at; the windows begin at a bigram of the template and have up to the greatest listed size of bigrams
(repeated ones counted).  Windows touch no matching line and are not taken from a text that matches as a
whole, which count as units themselves; of overlapping windows the best counts.

Null texts and units of fewer than two words have no bigrams and match nothing; rows without a doc_id
are not reported (they cannot be named); repeated rows add to the counts of their doc_id; empty
tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Per cent of the Dice coefficient that a match needs.
DICE_PERCENT = 80

#: Licence notices, one unit each.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "ARR": "All rights reserved.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def template_bigrams(templates: dict[str, str] | None = None) -> dict[str, list[str]]:
    out = {}
    for name, text in (templates or TEMPLATES).items():
        words = re.findall(r"[^\W_]+", text.lower())
        out[name] = sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})
    return out


def matching_sizes(size: int, percent: int = DICE_PERCENT) -> list[int]:
    """Unit sizes u with 200 * min(u, size) >= percent * (u + size)."""
    return [u for u in range(1, 2 * size * 100 // percent + 1) if 200 * min(u, size) >= percent * (u + size)]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _places(words: Column) -> Column:
    """The bigram at each place, repeated ones too."""
    return F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get(words, i + 1)))


def _bigrams(words: Column) -> Column:
    return F.array_distinct(_places(words))


def _windows(text: DataFrame, templates: dict[str, str] | None, percent: int) -> DataFrame:
    """doc_id, license, dice, n, unit (line of the first) of the notices that only windows of words show."""
    listed = [(name, grams, sizes[0], sizes[-1]) for name, grams in template_bigrams(templates).items() if (sizes := matching_sizes(len(grams), percent))]
    if not listed:
        return text.select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("dice"), F.lit(0).alias("n"), F.lit(0).alias("unit")).limit(0)
    strings = lambda grams: F.array(*map(F.lit, grams))
    table = F.array(*(F.struct(F.lit(name).alias("license"), strings(grams).alias("grams"), F.lit(least).alias("least"), F.lit(most).alias("most"))
                      for name, grams, least, most in listed))
    # texts with enough of a template's bigrams; explode drops the others without computing anything twice
    known = text.select("doc_id", "t", _words(F.col("t")).alias("w")).select("doc_id", "t", _places(F.col("w")).alias("b")).select(
        "doc_id", "t", "b", F.array_intersect("b", strings(sorted({g for _, grams, _, _ in listed for g in grams}))).alias("known"))
    near = known.select("doc_id", "t", "b", F.explode(F.filter(table, lambda x: F.size(F.array_intersect(x["grams"], "known")) >= x["least"])).alias("x"))
    near = near.select("doc_id", "t", "b", "x.*")

    def reached(grams: Column) -> Column:
        return 200 * F.size(F.array_intersect(grams, "grams")) >= percent * (F.size(grams) + F.size("grams"))

    # the line of every word, negative in a line that matches
    lines = F.transform(F.split("t", "\n"), lambda x, i: F.struct(_words(x).alias("w"), (i + 1).alias("line")))
    marks = near.withColumn("lines", lines).withColumn("whole", reached(F.array_distinct("b"))).withColumn("mark", F.flatten(F.transform(
        "lines", lambda x: F.array_repeat(F.when((F.size(x["w"]) > 1) & reached(_bigrams(x["w"])), -x["line"]).otherwise(x["line"]), F.size(x["w"])))))
    free = marks.select("doc_id", "license", "grams", "least", "most", "mark", F.when(F.col("whole"), F.array().cast("array<string>")).otherwise(F.transform(
        "b", lambda x, i: F.when((F.get("mark", i) > 0) & (F.get("mark", i + 1) > 0), x).otherwise(F.lit("")))).alias("b"))
    starts = F.filter(F.transform("b", lambda x, i: F.when(F.array_contains("grams", x), i)), lambda i: i.isNotNull())
    # the places from each start on, up to a matching line
    ahead = free.withColumn("starts", starts).withColumn("ahead", F.transform("starts", lambda i: F.struct(
        i.alias("at"), F.slice("b", i + 1, F.col("most")).alias("g")))).withColumn("ahead", F.transform("ahead", lambda x: F.struct(
            x["at"].alias("at"), F.when(F.array_contains(x["g"], ""), F.slice(x["g"], F.lit(1), F.array_position(x["g"], F.lit("")).cast("int") - 1)).otherwise(x["g"]).alias("g"))))
    enough = ahead.withColumn("ahead", F.filter("ahead", lambda x: F.size(F.array_intersect(x["g"], "grams")) >= F.col("least")))

    def best(x: Column) -> Column:
        """The best window that begins at x, the shortest of equals: dice, -places."""
        def score(n: Column) -> Column:
            g = F.slice(x["g"], F.lit(1), n)
            common, sizes = F.size(F.array_intersect(g, "grams")), F.size(F.array_distinct(g)) + F.size("grams")
            return F.when(200 * common >= percent * sizes, F.struct((2.0 * common / sizes).alias("dice"), (-n).alias("n")))
        return F.array_max(F.transform(F.sequence(F.col("least"), F.size(x["g"])), score))

    scored = enough.withColumn("found", F.transform("ahead", lambda x: F.struct(x["at"].alias("at"), best(x).alias("best")))).withColumn(
        "found", F.filter("found", lambda x: x["best"].isNotNull()))
    # from left to right; one that overlaps the last (by a word) replaces it if it is better

    def step(a: Column, x: Column) -> Column:
        dice, end = x["best"]["dice"], x["at"] - x["best"]["n"]       # last word
        new, better = x["at"] > a["end"], dice > a["dice"]
        return F.when(new | better, F.struct(F.when(new, a["n"] + 1).otherwise(a["n"]).alias("n"), end.alias("end"), dice.alias("dice"), F.greatest(a["top"], dice).alias("top"),
                                             F.when((a["n"] == 0) | (~new & (a["n"] == 1)), x["at"]).otherwise(a["first"]).alias("first"))).otherwise(a)

    none = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end"), F.lit(0.0).alias("dice"), F.lit(0.0).alias("top"), F.lit(0).alias("first"))
    sums = scored.select("doc_id", "license", "mark", F.explode(F.array(F.aggregate("found", none, step))).alias("a")).where("a.n > 0")
    return sums.select("doc_id", "license", F.col("a.top").alias("dice"), F.col("a.n").alias("n"), F.get("mark", F.col("a.first")).alias("unit"))


def licenses(docs: DataFrame, templates: dict[str, str] | None = None, percent: int = DICE_PERCENT) -> DataFrame:
    """doc_id, license, dice (of the best unit), n_units (matching ones), first_unit (0: the whole text, else the
    number of the line, or of the line in which the window begins), a row for each document and licence found in it."""
    spark = docs.sparkSession
    listed = [(u, name, grams) for name, grams in template_bigrams(templates).items() for u in matching_sizes(len(grams), percent)]
    listing = spark.createDataFrame(listed, "size int, license string, grams array<string>")

    text = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    lines = text.select("doc_id", F.split("t", "\n").alias("lines"), "t")
    units = F.when(F.size("lines") > 1, F.concat(F.array("t"), F.col("lines"))).otherwise(F.concat(F.array(F.lit("")), F.col("lines")))
    unit = lines.select("doc_id", F.posexplode(units).alias("unit", "u"))
    words = unit.select("doc_id", "unit", _words(F.col("u")).alias("w"))
    grams = words.where(F.size("w") > 1).select("doc_id", "unit", _bigrams(F.col("w")).alias("g"))
    met = grams.join(F.broadcast(listing), F.size("g") == F.col("size"))
    common = F.size(F.array_intersect("g", "grams"))
    sizes = F.size("g") + F.size("grams")
    found = met.where(200 * common >= percent * sizes).select("doc_id", "license", (2.0 * common / sizes).alias("dice"), F.lit(1).alias("n"), "unit")
    return found.unionByName(_windows(text, templates, percent)).groupBy("doc_id", "license").agg(
        F.max("dice").alias("dice"), F.sum("n").alias("n_units"), F.min("unit").cast("long").alias("first_unit"))
