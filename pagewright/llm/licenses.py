"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

A window is a run of consecutive shingles; its bands are its smallest shingle hashes, one row each, and they retrieve every
template that has such a hash. Sizes and bands follow from the templates. A template of LONG or more shingles covers windows of WINDOW shingles
at steps of half a window; of a window that lies in it at most a share of 1 - threshold is foreign, so more than that
many bands always include one of its own: with WINDOW 8 and 4 bands a template that is there is retrieved for certain. For
shorter templates the window is one shingle, whose one band is the shingle: certain as well.

Templates are a table of any size: its hashes are joined with those of the documents, by broadcast only after a count. DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, once, shingles, small, words, written

WIDTH, THRESHOLD = 5, 0.8
WINDOW, STEP, BANDS, LONG = 8, 4, 4, 16

# The notices that licenses ask for, by SPDX name.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the MIT License",
        "SPDX-License-Identifier: MIT is the license of this file",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "licensed under the GNU General Public License v3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "licensed under the GNU General Public License, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("licensed under the GNU Lesser General Public License",),
    "AGPL-3.0": ("licensed under the GNU Affero General Public License",),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related rights to this work",),
    "Unlicense": ("This is free and unencumbered software released into the public domain",),
}

#: Comment marks at the start and the end of a line; those of punctuation only, such as # and *, go with it.
MARKS = r"^[ \t]*(?://+!?|--+|/\*+!?|<!--+|rem(?:[ \t\r]|$))|(?:\*+/|--+>)[ \t\r]*$"
PUNCTUATION = ".,;:()[]{}\"'`*#_"


def normal(text: Column) -> Column:
    """A-Z lower-cased, without the comment marks of lines and the ASCII punctuation that license texts vary in."""
    return F.translate(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), f"(?md){MARKS}", " "), PUNCTUATION, "")


def _shingled(df: DataFrame, keys: list, text: Column) -> DataFrame:
    return df.select(*keys, once(words(normal(text))).alias("w"))


def _hashes() -> Column:
    return once(shingles(F.col("w"), WIDTH, lambda run: F.xxhash64(F.concat_ws(" ", *run))))


def _texts() -> Column:
    return once(shingles(F.col("w"), WIDTH, lambda run: F.concat_ws(" ", *run)))


def template_table(spark, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``(name, template, text)`` of license names with their notices; template is a notice's place among its license's."""
    rows = [(name, k, text) for name, texts in (TEMPLATES if templates is None else templates).items() for k, text in enumerate(texts)]
    return spark.createDataFrame(rows, "name string, template int, text string")


def licenses(docs: DataFrame, id: str = "doc_id", text: str = "text", templates: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document and template found in it: the columns of ``docs`` but the text, and the struct ``license``.

    ``templates`` is a table like :func:`template_table`'s. license has name, template, containment (share of the template's distinct 5-word shingles that
    the document has, ``threshold`` or more; a template whose shared shingles another one has too, with a higher share, is left out), first_word (place of the first shared shingle).
    Words are compared in lower case without punctuation and without comment marks at a line's start or end. A template of fewer than five words is one shingle and matches only a text that is
    equal to it; one without words matches nothing. Null and blank texts have no license. A document is an id with its text: repeated rows give repeated results, null ids are an id like any other; a column named license is replaced.
    """
    known = template_table(docs.sparkSession) if templates is None else templates
    known = written(_shingled(known, ["name", "template"], F.col("text")).select("name", "template", F.array_distinct(_texts()).alias("s")).where("size(s) > 0").distinct(), "templates")
    of_template = small(written(known.select("name", "template", F.size("s").alias("n"), F.explode("s").alias("shingle")), "template-shingles"))
    keys = of_template.select(F.xxhash64("shingle").alias("hash"), (F.col("n") >= LONG).alias("long"), "name", "template")
    keys = small(written(keys, "template-hashes"))

    own = docs.select(F.col(id).alias("_doc"), F.xxhash64(F.col(text)).alias("_key"), F.col(text).alias("_text"))
    hashed = _shingled(own, ["_doc", "_key"], F.col("_text")).select("_doc", "_key", _hashes().alias("h")).where("size(h) > 0")
    windows = F.transform(F.sequence(F.lit(1), F.size("h"), F.lit(STEP)), lambda i: F.slice(F.sort_array(F.slice("h", i, F.lit(WINDOW))), 1, BANDS))
    offer = lambda hashes, long: F.transform(F.array_distinct(hashes), lambda h: F.struct(F.lit(long).alias("long"), h.alias("hash")))
    offered = hashed.select("_doc", "_key", F.explode(F.concat(offer(F.col("h"), False), offer(F.flatten(windows), True))).alias("o")).select("_doc", "_key", "o.long", "o.hash")
    found = written(offered.join(keys, ["hash", "long"]).select("_doc", "_key", "name", "template").distinct(), "license-candidates")

    # Verified on the shingles themselves, for the templates that a band retrieved.
    same = lambda a, b: a["_doc"].eqNullSafe(b["_doc"]) & (a["_key"] == b["_key"])
    some = small(written(found.select("_doc", "_key").distinct(), "license-documents"))
    texts = own.join(some, same(own, some), "left_semi").distinct()
    texts = _shingled(texts, ["_doc", "_key"], F.col("_text")).select("_doc", "_key", F.posexplode(_texts()).alias("place", "shingle"))
    texts = texts.groupBy("_doc", "_key", "shingle").agg(F.min("place").alias("place"))
    shared = texts.join(of_template, "shingle").groupBy("_doc", "_key", "name", "template", "n").agg(F.collect_list("shingle").alias("common"), F.min("place").alias("first_word"))
    tried = found.select(F.col("_doc").alias("_d"), F.col("_key").alias("_k"), F.col("name").alias("_n"), F.col("template").alias("_t"))
    passed = shared.join(tried, F.expr("_doc <=> _d and _key = _k and name = _n and template = _t"), "left_semi").where(F.size("common") >= F.ceil(F.col("n") * threshold - 1e-9))
    passed = passed.groupBy("_doc", "_key").agg(F.collect_list(F.struct("name", "template", "n", "common", "first_word")).alias("p"))
    share = lambda x: F.size(x["common"]) / x["n"]
    better = lambda x, y: (share(y) > share(x)) & (F.size(F.array_except(x["common"], y["common"])) == 0)
    best = F.filter("p", lambda x: ~F.exists("p", lambda y: better(x, y)))
    best = F.transform(best, lambda x: F.struct(x["name"].alias("name"), x["template"].alias("template"), share(x).alias("containment"), x["first_word"].alias("first_word")))
    result = small(written(passed.select("_doc", "_key", best.alias("_found")), "licenses"))
    columns = [c for c in docs.columns if c.lower() != "license" and c != text]
    rows = docs.select(F.struct(*columns).alias("_row"), F.col(id).alias("_id"), F.xxhash64(F.col(text)).alias("_hash"))
    told = rows.join(result, rows["_id"].eqNullSafe(result["_doc"]) & (rows["_hash"] == result["_key"])).select("_row", F.explode("_found").alias("license"))
    return told.select(*[F.col("_row")[c].alias(c) for c in columns], "license")
