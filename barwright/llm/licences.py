"""Licence scan: sparse TF-IDF cosine of header lines and licence files to templates, then inheritance by path.

Units of a text are its lines and header blocks that hold a cue, a word that licence texts are made of, and the whole
text of a file with a licence file's name; so is its beginning, the first three lines that aren't blank, as licence texts begin with their title. A header block is a run of two or more neighbouring lines, without their comment marks,
of at most WRAP characters each. Every unit is compared with all statements, identifiers and licence texts known; a token's weight
comes from the number of distinct units and templates that hold it. A file's own licence is that of its best unit, if the
cosine reaches THRESHOLD; a unit that gives version numbers isn't compared with licences of other versions. "All rights reserved" without any
other licence is PROPRIETARY, which stops inheritance. A file with a licence file's name, or whose words are mostly licence lines, licenses its
directory; files without a licence of their own take that of the nearest directory above them that has one.

Edge cases: null and empty texts have no licence of their own and may inherit; a null path is the root directory;
of equal cosines the name that sorts first is taken; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import cut

THRESHOLD = 0.6
#: Every template holds one of these.
CUE = r"(?i)licen[sc]e|copyright|spdx|public domain|all rights reserved|redistribut|permission|unencumbered|\b[AL]?GPL|\bCC[ -]BY|\bCC0"
#: Longest line of a wrapped header.
WRAP = 100
#: Short statements by which files name their licence.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution is permitted under the terms of the BSD 3-Clause License"),
    ("BSD-2-Clause", "Redistribution is permitted under the terms of the BSD 2-Clause License"),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0"),
    ("CC-BY-4.0", "Licensed under the Creative Commons Attribution 4.0 International License CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain Unlicense"),
    ("ISC", "Released under the ISC License"),
)
GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
#: Standard headers and licence texts of more than one line.
HEADERS = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("GPL-3.0", GNU.format("General Public License", "3")),
    ("GPL-2.0", GNU.format("General Public License", "2")),
    ("LGPL-3.0", GNU.format("Lesser General Public License", "3")),
    ("AGPL-3.0", GNU.format("Affero General Public License", "3")),
    ("BSD-3-Clause", BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", BSD),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
)
#: Further statements and identifiers; a licence may have several.
IDENTIFIERS = tuple((name, f"SPDX-License-Identifier: {name}") for name, _ in TEMPLATES)
STYLES = (
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."),
)
#: Titles of licence texts, and further ways to name licences.
TITLES = (
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-1.0", "GNU General Public License Version 1, February 1989"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-2.0", "GNU Library General Public License Version 2, June 1991"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-1.1", "Mozilla Public License Version 1.1"),
    ("Artistic-1.0", "The Artistic License Preamble"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("MIT", "The MIT License (MIT)"),
    ("ISC", "ISC License"),
    ("GPL-3.0", "Distributed under the terms of the GNU GPL v3"),
    ("GPL-2.0", "Distributed under the terms of the GNU GPL v2"),
    ("LGPL-2.1", GNU.format("Lesser General Public License", "2.1")),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1"),
    ("Apache-2.0 OR MIT", "Dual licensed under MIT or Apache-2.0"),
    ("Apache-2.0 OR MIT", "Licensed under either of the Apache License, Version 2.0 or the MIT license at your option"),
)
KNOWN = (*TEMPLATES, *IDENTIFIERS, *STYLES, *HEADERS, *TITLES)
#: The name of what isn't licensed to others, and the words for it.
PROPRIETARY, RESERVED = "LicenseRef-Proprietary", r"(?i)all rights reserved"
#: Version numbers of licences in lower-cased texts.
VERSION = r"(?:version|\bv\.?|licen[sc]e,?|gpl|mpl|apache|cc0|attribution|\bby|-nc|-sa)[ ,-]*v?\.?([0-9]{1,2}(?:\.[0-9]{1,2})?)(?![0-9])"
MARKS = r"(?m)^[\s/*#;%!<>|-]+|[ \t\r*/>-]+$"
FILE = r"(?i)(^|/)(licen[sc]e|copying|unlicense)(\.[a-z]+)?$"


def _tokens(line: Column) -> Column:
    """Words, digits with their points, and pairs of neighbouring words."""
    words = F.regexp_extract_all(F.lower(line), F.lit(r"[a-z]+|[0-9]+(?:\.[0-9]+)*"), F.lit(0))
    others = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, F.lit(1), others), F.slice(words, F.lit(2), others), lambda a, b: F.concat_ws("_", a, b))
    return F.concat(words, pairs)


def _blocks(text: Column, path: Column) -> Column:
    """The cued header blocks of at least two lines as one line each, and the whole text of a licence file."""
    plain = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, MARKS, ""))
    wrapped = F.transform(plain, lambda x: F.when(F.length(x) <= WRAP, x).otherwise(""))
    blocks = F.filter(F.transform(F.split(F.array_join(wrapped, "\n"), r"\n{2,}"), lambda x: F.trim(x)), lambda x: x.rlike(CUE) & x.contains("\n"))
    whole = F.when(path.rlike(FILE), F.array(F.array_join(plain, "\n"))).otherwise(F.array().cast("array<string>"))
    title = F.filter(F.array(F.array_join(F.slice(F.filter(plain, lambda x: x != ""), 1, 3), " ")), lambda x: x.rlike(CUE))
    return F.array_distinct(F.transform(F.concat(blocks, whole, title), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))))


def _versions(line: Column) -> Column:
    """Version numbers that a text gives, with a point."""
    return F.transform(F.regexp_extract_all(F.lower(line), F.lit(VERSION), F.lit(1)), lambda v: F.when(v.contains("."), v).otherwise(F.concat(v, F.lit(".0"))))


def line_matches(lines: DataFrame, known_lines: tuple = TEMPLATES) -> DataFrame:
    """(line, licence, cosine) of the best template for each distinct line."""
    spark = lines.sparkSession
    templates = spark.createDataFrame([(k, *known) for k, known in enumerate(known_lines)], "k int, licence string, line string")
    # rows of tokens name their unit by a digest, as blocks may be long
    units = cut(lines.distinct().withColumn("u", F.unhex(F.md5("line"))))
    counted = units.select("line").union(templates.select("line")).select(F.explode(F.array_distinct(_tokens(F.col("line")))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    n = units.count() + len(known_lines)

    def weighted(rows: DataFrame, *key: str) -> DataFrame:
        tf = rows.select(*key, F.explode(_tokens(F.col("line"))).alias("token")).groupBy(*key, "token").agg(F.count("*").alias("tf"))
        return tf.join(counted, "token").select(*key, "token", ((1 + F.log("tf")) * (F.log((F.lit(1.0) + n) / (1 + F.col("df"))) + 1)).alias("w"))

    def unit(rows: DataFrame, *key: str) -> DataFrame:
        return rows.join(rows.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")), list(key)).select(*key, "token", (F.col("w") / F.col("norm")).alias("w"))

    known = F.broadcast(cut(unit(weighted(templates, "k", "licence"), "k", "licence")).withColumnRenamed("w", "v"))  # fixed: some 1,000 rows
    shared = unit(weighted(units, "u"), "u").join(known, "token").groupBy("u", "k", "licence").agg(F.sum(F.col("w") * F.col("v")).alias("cosine"))
    named = F.regexp_extract("licence", r"-([0-9]+\.[0-9]+)$", 1)
    shared = shared.join(units.select("u", _versions(F.col("line")).alias("versions")), "u").where((named == "") | (F.size("versions") == 0) | F.array_contains("versions", named))
    best = shared.groupBy("u").agg(F.min(F.struct((-F.round("cosine", 9)).alias("c"), "licence")).alias("best"))
    return best.join(units, "u").select("line", "best.licence", (-F.col("best.c")).alias("cosine"))


def scan(files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, path, licence, cosine, origin (header, file or inherited; null without a licence), from_dir (the directory inherited from)."""
    rows = files.select(F.col(key).alias("k"), F.coalesce(path, F.lit("")).alias("path"), F.col(text).alias("t"))
    cued = F.when(F.col("t").rlike(CUE), F.filter(F.transform(F.split("t", "\n", -1), F.trim), lambda x: x.rlike(CUE))).otherwise(F.array().cast("array<string>"))
    words = F.size(F.filter(F.split("t", r"\s+"), lambda w: w != ""))
    held = cut(rows.where(F.col("t").rlike(CUE)).select("k", "path", F.array_distinct(cued).alias("lines"), _blocks(F.col("t"), F.col("path")).alias("blocks"), words.alias("words"), F.col("t").rlike(RESERVED).alias("reserved")).distinct())
    every = held.select(F.explode(F.concat("lines", "blocks")).alias("line"))
    sized = cut(line_matches(every, KNOWN).where(F.col("cosine") >= threshold).withColumn("own", F.size(F.split("line", r"\s+"))))
    by_line = held.select("k", "path", "words", F.explode("lines").alias("line")).join(sized, "line").withColumn("kind", F.lit(0))
    by_block = held.select("k", "path", "words", F.explode("blocks").alias("line")).join(sized, "line").withColumn("kind", F.lit(1))
    # lines lie in blocks, so the words of both aren't added
    found = by_line.unionByName(by_block).groupBy("k", "path", "words", "kind").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("best"), F.sum("own").alias("own"))
    own = found.groupBy("k", "path", "words").agg(F.min("best").alias("best"), F.max("own").alias("own"))
    is_file = F.col("path").rlike(FILE) | (F.col("own") * 2 >= F.col("words"))
    # any licence that is named comes before words that reserve all rights
    kept_back = held.where("reserved").select("k", "path", "words", F.struct(F.lit(0.0).alias("c"), F.lit(PROPRIETARY).alias("licence")).alias("best"), F.lit(0).alias("own"))
    own = own.unionByName(kept_back)
    # rows that repeat with the same key, path and length are one file here; the licence is the same for all
    own = cut(own.select("k", "path", F.col("best.licence").alias("licence"), (-F.col("best.c")).alias("cosine"), is_file.alias("is_file")).groupBy("k", "path").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence", "is_file")).alias("x")).select("k", "path", "x.licence", (-F.col("x.c")).alias("cosine"), "x.is_file"))

    parent = F.regexp_replace("path", r"/?[^/]*$", "")
    licensed = own.where("is_file").groupBy(parent.alias("dir")).agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("d")).select("dir", F.col("d.licence").alias("dir_licence"), (-F.col("d.c")).alias("dir_cosine"))
    dirs = rows.select(parent.alias("home")).distinct()
    parts = F.split("home", "/", -1)
    above = dirs.select("home", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))).alias("dir")).distinct()
    nearest = above.join(licensed, "dir").groupBy("home").agg(F.max(F.struct(F.length("dir").alias("n"), "dir", "dir_licence", "dir_cosine")).alias("up")).select("home", "up.dir", "up.dir_licence", "up.dir_cosine")

    out = rows.select("k", "path", parent.alias("home")).alias("r")
    mine = own.alias("o")
    out = out.join(mine, F.col("r.k").eqNullSafe(F.col("o.k")) & (F.col("r.path") == F.col("o.path")), "left").select("r.k", "r.path", "r.home", "o.licence", "o.cosine", "o.is_file")
    out = out.join(nearest, "home", "left")
    has = F.col("licence").isNotNull()
    return out.select(
        F.col("k").alias(key),
        F.col("path"),
        F.coalesce("licence", "dir_licence").alias("licence"),
        F.when(has, F.col("cosine")).otherwise(F.col("dir_cosine")).alias("cosine"),
        F.when(has & F.col("is_file"), "file").when(has, "header").when(F.col("dir_licence").isNotNull(), "inherited").alias("origin"),
        F.when(~has, F.col("dir")).alias("from_dir"),
    )
