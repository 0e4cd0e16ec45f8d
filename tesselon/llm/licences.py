"""Licence scans by sentence rules.

Texts are cut into sentences twice: once with every line break as an end, for notices on a line of their own, and once with
only blank lines as ends, for texts that are wrapped or stand in comments. Sentences are normalised and looked up in a fixed
table of known licence sentences; the identifiers found are then matched against ordered rules, each a sequence of sentence
identifiers. Everything is DataFrame functions; the two tables are constants of this module and as small as it is.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A plus, as in ``GPL-2.0+``, tells licences apart and becomes a letter.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ+", "abcdefghijklmnopqrstuvwxyzp"
#: A sentence with a slot for a name, in its normal form, and what the slot is filled with; a name that ends in a stop cuts it short.
SLOT_HEAD, SLOT_TAIL, CUT_SHORT = "neither the name of ", "nor the names of", "neither the name of the copyright holder"
SLOT, FILLED = "^neither the name of .+ nor the names of its contributors may", "neither the name of the copyright holder nor the names of its contributors may"
#: Where a sentence ends inside a line, where a paragraph ends (comment marks may stand on the empty line), and what stands for an end.
STOP, EMPTY_LINE, END = "([.!?;:])[ \\t\\r\\n]+", "\\n[ \\t\\r#*/;%-]*\\n", "\x01"
LEAST = 3

# Known sentences of public licences and notices, by identifier.
SENTENCES = {
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3.",
    "mit-short": "Released under the MIT License.",
    "mit-short-2": "Licensed under the MIT License.",
    "cc-by-nc-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-short": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-short": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-short": "This work is dedicated to the public domain under CC0 1.0.",
    "apache2-short": "Licensed under the Apache License, Version 2.0.",
    "apache2-1": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache2-2": "you may not use this file except in compliance with the License.",
    "apache2-3": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache2-3a": "You may obtain a copy of the License at",
    "apache2-3b": "http://www.apache.org/licenses/LICENSE-2.0",
    "apache2-4": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache2-5": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl-1": "This program is free software:",
    "gpl-2": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-3": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-4": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-5": "See the GNU General Public License for more details.",
    "gpl2-1": "This program is free software;",
    "gpl2-2": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    "gpl2-3": "either version 2 of the License, or (at your option) any later version.",
    "lgpl-1": "This library is free software;",
    "lgpl2-2": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;",
    "lgpl2-3": "either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-2": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-2": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl2-1": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "mpl2-2": "2.0.",
    "mit-1": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-2": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-3": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "bsd-1": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-2": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-3": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-4": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-4a": "Neither the name of the copyright holder",
    "bsd-4b": "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "zlib-1": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-2": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-3": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost-1": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "isc-1": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense-1": "This is free and unencumbered software released into the public domain.",
    "cc-by-nc-sa-short": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nd-short": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "mit-short-3": "This project is licensed under the MIT License - see the LICENSE file for details.",
    "mit-short-4": "This project is licensed under the MIT License - see the [LICENSE](LICENSE) file for details.",
    "mit-short-5": "This project is licensed under the MIT License - see the LICENSE.md file for details.",
    "mit-short-6": "This project is licensed under the MIT License - see the [LICENSE.md](LICENSE.md) file for details.",
    "mit-short-7": "This project is licensed under the MIT License.",
    "apache2-short-2": "This project is licensed under the Apache License 2.0.",
    "cc-by-short-2": "Licensed under CC BY 4.0.",
    "cc-by-short-3": "Available under CC BY 4.0.",
    "cc-by-sa-short-2": "Licensed under CC BY-SA 4.0.",
    "cc-by-sa-short-3": "Available under CC BY-SA 4.0.",
    "apache2-head": "Apache License",
    "apache2-version": "Version 2.0, January 2004",
    "gpl-head": "GNU GENERAL PUBLIC LICENSE",
    "lgpl-head": "GNU LESSER GENERAL PUBLIC LICENSE",
    "agpl-head": "GNU AFFERO GENERAL PUBLIC LICENSE",
    "gpl2-version": "Version 2, June 1991",
    "gpl3-version": "Version 3, 29 June 2007",
    "agpl3-version": "Version 3, 19 November 2007",
    "lgpl21-version": "Version 2.1, February 1999",
    "gpl2-as-published": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "isc-2": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "spdx": "SPDX-License-Identifier:",
}
# Identifiers that a line may name outright.
SPDX = (
    "MIT ISC Zlib Unlicense WTFPL BSL-1.0 Apache-2.0 BSD-2-Clause BSD-3-Clause MPL-2.0 EPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later "
    "LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0"
).split()
# Older identifiers of the same licences.
OLDER = {f"{name}{mark}": f"{name}-{word}" for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for mark, word in (("", "only"), ("+", "or-later"))}
SENTENCES |= {f"spdx-{i}": i for i in (*SPDX, *OLDER)}

# The rules in order; an earlier rule takes precedence over the sentences that two rules claim.
RULES = (
    ("Apache-2.0", ("apache2-1", "apache2-2", "apache2-3", "apache2-4", "apache2-5")),
    ("Apache-2.0", ("apache2-1", "apache2-2", "apache2-3a", "apache2-3b", "apache2-4", "apache2-5")),
    ("GPL-3.0-or-later", ("gpl-1", "gpl-2", "gpl-3", "gpl-4", "gpl-5")),
    ("GPL-3.0-or-later", ("gpl-1", "gpl-2")),
    ("AGPL-3.0-or-later", ("gpl-1", "agpl3-2")),
    ("LGPL-3.0-or-later", ("gpl-1", "lgpl3-2")),
    ("GPL-2.0-or-later", ("gpl2-1", "gpl2-2", "gpl2-3")),
    ("LGPL-2.1-or-later", ("lgpl-1", "lgpl2-2", "lgpl2-3")),
    ("MPL-2.0", ("mpl2-1", "mpl2-2")),
    ("MIT", ("mit-1", "mit-2", "mit-3")),
    ("MIT", ("mit-1", "mit-2")),
    ("Apache-2.0", ("apache2-1", "apache2-2")),
    ("Apache-2.0", ("apache2-head", "apache2-version")),
    ("GPL-2.0-only", ("gpl-head", "gpl2-version")),
    ("GPL-3.0-only", ("gpl-head", "gpl3-version")),
    ("LGPL-2.1-only", ("lgpl-head", "lgpl21-version")),
    ("LGPL-3.0-only", ("lgpl-head", "gpl3-version")),
    ("AGPL-3.0-only", ("agpl-head", "agpl3-version")),
    ("GPL-2.0-only", ("gpl2-1", "gpl2-as-published")),
    ("GPL-3.0-only", ("gpl3-short",)),
    ("MIT", ("mit-short",)),
    *(("MIT", (f"mit-short-{k}",)) for k in range(2, 8)),
    ("CC-BY-NC-4.0", ("cc-by-nc-short",)),
    *(("CC-BY-4.0", (f"cc-by-short{k}",)) for k in ("", "-2", "-3")),
    *(("CC-BY-SA-4.0", (f"cc-by-sa-short{k}",)) for k in ("", "-2", "-3")),
    ("CC0-1.0", ("cc0-short",)),
    ("Apache-2.0", ("apache2-short",)),
    ("Apache-2.0", ("apache2-short-2",)),
    ("BSD-3-Clause", ("bsd-1", "bsd-2", "bsd-3", "bsd-4")),
    ("BSD-3-Clause", ("bsd-1", "bsd-2", "bsd-3", "bsd-4a", "bsd-4b")),
    ("BSD-2-Clause", ("bsd-1", "bsd-2", "bsd-3")),
    ("LicenseRef-BSD", ("bsd-1",)),
    ("ISC", ("isc-1",)),
    ("ISC", ("isc-2",)),
    ("Zlib", ("zlib-1", "zlib-2", "zlib-3")),
    ("BSL-1.0", ("boost-1",)),
    ("Unlicense", ("unlicense-1",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-short",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-short",)),
    *((i, ("spdx", f"spdx-{i}")) for i in SPDX),
    *((new, ("spdx", f"spdx-{old}")) for old, new in OLDER.items()),
)


def plain(sentence: str) -> str:
    """Normal form of a known sentence: A-Z lower-cased, a plus as a letter, everything else but a-z and digits a single blank."""
    return re.sub(r"[^a-z0-9]+", " ", sentence.translate(str.maketrans(UPPER, LOWER))).strip(" ")


def plain_column(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(sentence, UPPER, LOWER), "[^a-z0-9]+", " "))


def filled(norm: Column) -> Column:
    """A normal form with the name in its slot left out."""
    whole = F.when(F.contains(norm, F.lit(SLOT_TAIL)), F.regexp_replace(norm, SLOT, FILLED)).otherwise(F.lit(CUT_SHORT))
    return F.when(F.startswith(norm, F.lit(SLOT_HEAD)), whole).otherwise(norm)


def sentences(text: Column, wrapped: bool) -> Column:
    """Normal forms of the sentences of a text in their order; list numbers and the like, shorter than LEAST, do not count."""
    joined = F.translate(F.regexp_replace(text, EMPTY_LINE, END), "\n", " ") if wrapped else F.translate(text, "\n", END)
    cut = F.split(F.regexp_replace(joined, STOP, "$1" + END), END)
    # Two transforms, so that a normal form is worked out once and not wherever it is looked at.
    return F.filter(F.transform(F.transform(cut, plain_column), filled), lambda s: F.length(s) >= LEAST)


def recognised(docs: DataFrame) -> DataFrame:
    """``(doc_id, copy, cut, pos, sentence)``: the known licence sentences of each document by cut and number of sentence.

    ``copy`` is a hash of the text; with ``doc_id`` it names a row's content.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame([(plain(s), i) for i, s in SENTENCES.items()], "norm string, sentence string")
    lengths = sorted({len(plain(s)) for s in SENTENCES.values()})
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("copy"), F.posexplode(F.array(sentences(text, False), sentences(text, True))).alias("cut", "all"))
    each = keyed.select("doc_id", "copy", "cut", F.posexplode("all").alias("pos", "norm")).where(F.length("norm").between(lengths[0], lengths[-1]))
    return each.join(F.broadcast(known), "norm").select("doc_id", "copy", "cut", "pos", "sentence").distinct()


def licence_matches(docs: DataFrame) -> DataFrame:
    """``(doc_id, copy, cut, licence, rule, begin, n_sentences)``: rules whose sentences stand in their order one after the other.

    Where matches of a cut overlap, only those stay that no earlier rule contests. A document that names a licence twice has two rows.
    Rows that share ``doc_id`` and text count as one document; those that share the id only are told apart by ``copy``. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    steps = [(r, lic, k, s, len(seq)) for r, (lic, seq) in enumerate(RULES) for k, s in enumerate(seq)]
    rules = spark.createDataFrame(steps, "rule int, licence string, step int, sentence string, n int")
    hits = recognised(docs).join(F.broadcast(rules), "sentence").withColumn("begin", F.col("pos") - F.col("step"))
    text = ["doc_id", "copy", "cut"]
    full = hits.withColumn("found", F.count("*").over(W.partitionBy(*text, "rule", "begin"))).where("found = n")
    best = full.withColumn("first", F.min("rule").over(W.partitionBy(*text, "pos")))
    kept = best.groupBy(*text, "rule", "licence", "begin").agg(F.count("*").alias("n_sentences"), F.min(F.col("first") == F.col("rule")).alias("own"))
    return kept.where("own").select(*text, "licence", "rule", "begin", F.col("n_sentences").cast("int").alias("n_sentences"))


def licences(docs: DataFrame) -> DataFrame:
    """``(doc_id, licences, n_matches)`` per row of ``docs(doc_id, text, ...)``: distinct licences in alphabetical order, comma-joined, empty if none.

    A match that both cuts find counts once: of each licence, the cut that finds more counts. Null and empty texts have none; extra
    columns are ignored; repeated rows get equal results.
    """
    each = licence_matches(docs).groupBy("doc_id", "copy", "licence", "cut").agg(F.count("*").alias("n"))
    most = each.groupBy("doc_id", "copy", "licence").agg(F.max("n").alias("n"))
    found = most.groupBy(F.col("doc_id").alias("id"), F.col("copy").alias("same")).agg(F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("found"), F.sum("n").alias("n"))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("copy"))
    joined = keyed.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("copy") == F.col("same")), "left")
    return joined.select("doc_id", F.coalesce("found", F.lit("")).alias("licences"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_matches"))
