"""Licence recognition by sentences and rules, in DataFrame functions only.

A text is cut into sentences twice: at line ends as well as sentence ends, and at sentence ends alone (for
notices wrapped over lines). Sentences are normalised (ASCII lower case, runs of anything but a-z and 0-9 as
one space) and looked up among known licence sentences. The identifiers of those found, in the text's order,
are matched against rules, ordered sequences of identifiers: a rule holds if its sequence stands in either
list without another known sentence in between. Of rules that hold, one whose sequence is part of a longer
one's is dropped.

A rule table says what is recognised: MIT, Apache-2.0, the GPL family, BSD, EPL, MPL, ISC, Zlib, BSL, Unlicense and Creative Commons
notices, and "all rights reserved"; other licences need sentences and rules of their own (parameters). Sentences are
looked up by hash among the known ones, then only those found are given their identifiers, so thousands may be known.

Whether a text needs cutting at all is told by one word of each known sentence; a text with none of these has
no known sentence. Null or empty text: nothing found; a null id is passed on; each row of repeated ids gives
its own row; an empty table gives no rows; columns besides the two named are not looked at. A text of any length is cut whole; its sentences are
one array of the row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and notices.
SENTENCES = {
    "mit-name": "Released under the MIT License",
    "mit-name-2": "Licensed under the MIT License",
    "mit-head": "The MIT License (MIT)",
    "mit-head-2": "MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-asis": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "apache-name": "Licensed under the Apache License, Version 2.0",
    "apache-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-asis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "gpl3-name": "This work is licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-details": "See the GNU General Public License for more details",
    "cc-by": "Licensed under CC BY 4.0",
    "cc-by-sa": "Licensed under CC BY-SA 4.0",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by-nd": "Licensed under CC BY-ND 4.0",
    "cc-by-nc-sa": "Licensed under CC BY-NC-SA 4.0",
    "cc-by-nc-nd": "Licensed under CC BY-NC-ND 4.0",
    "cc-zero": "Licensed under CC0 1.0",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "bsd-use": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-names-2": "Neither the name of the copyright holder nor the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-asis": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    "bsd-name-2": "Licensed under the BSD 2-Clause License",
    "bsd-name-3": "Licensed under the BSD 3-Clause License",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "lgpl-details": "See the GNU Lesser General Public License for more details",
    "agpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl-details": "See the GNU Affero General Public License for more details",
    "epl-2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl-1": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "boost-name": "Distributed under the Boost Software License, Version 1.0",
    "zlib-asis": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "reserved": "All rights reserved",
}
# Licences (SPDX identifiers where there are any) and the sentences that make them, in order.
RULES = [
    ("MIT", ["mit-name"]), ("MIT", ["mit-name-2"]), ("MIT", ["mit-grant", "mit-asis", "mit-liability"]), ("MIT", ["mit-head", "mit-grant"]), ("MIT", ["mit-head-2", "mit-grant"]),
    ("Apache-2.0", ["apache-name"]), ("Apache-2.0", ["apache-notice"]), ("Apache-2.0", ["apache-notice", "apache-copy", "apache-asis", "apache-see"]),
    ("GPL-3.0-only", ["gpl3-name"]), ("GPL-3.0-or-later", ["gpl-free"]), ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-details"]),
    ("GPL-2.0-or-later", ["gpl2-free"]), ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope", "gpl-details"]),
    ("CC-BY-4.0", ["cc-by"]), ("CC-BY-SA-4.0", ["cc-by-sa"]), ("CC-BY-NC-4.0", ["cc-by-nc"]), ("CC-BY-ND-4.0", ["cc-by-nd"]), ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa"]), ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd"]),
    ("CC0-1.0", ["cc-zero"]), ("CC-BY-4.0", ["cc-by-long"]), ("CC-BY-SA-4.0", ["cc-by-sa-long"]),
    ("BSD-2-Clause", ["bsd-use", "bsd-source", "bsd-binary"]), ("BSD-3-Clause", ["bsd-use", "bsd-source", "bsd-binary", "bsd-names"]), ("BSD-3-Clause", ["bsd-use", "bsd-source", "bsd-binary", "bsd-names-2"]),
    ("BSD-2-Clause", ["bsd-name-2"]), ("BSD-3-Clause", ["bsd-name-3"]), ("GPL-2.0-only", ["gpl2-only"]),
    ("LGPL-2.1-or-later", ["lgpl21-free"]), ("LGPL-2.1-or-later", ["lgpl21-free", "lgpl-hope", "lgpl-details"]), ("LGPL-3.0-or-later", ["lgpl3-free"]), ("LGPL-3.0-or-later", ["lgpl3-free", "gpl-hope", "lgpl-details"]),
    ("AGPL-3.0-or-later", ["agpl-free"]), ("AGPL-3.0-or-later", ["agpl-free", "gpl-hope", "agpl-details"]), ("EPL-2.0", ["epl-2"]), ("EPL-1.0", ["epl-1"]), ("BSL-1.0", ["boost-name"]), ("Zlib", ["zlib-asis", "zlib-grant"]),
    ("MPL-2.0", ["mpl-notice"]), ("Unlicense", ["unlicense"]), ("ISC", ["isc-grant"]),
    ("LicenseRef-all-rights-reserved", ["reserved"]),
]
ENDS = r"[.!?:;]+(?:[ \t\n\r\f\x0B]+|\z)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", "".join(c.lower() if c in UPPER else c for c in sentence)).strip()


def pieces(sentence: str) -> list[str]:
    """Where a known sentence has ends within, each piece is a sentence."""
    return [n for x in re.split(r"[.!?:;]+(?:[ \t\n\r\f\x0B]+|\Z)", sentence) if (n := normal(x))]


def compiled(sentences: dict[str, str], rules: list[tuple[str, list[str]]]) -> tuple[dict[str, str], list[tuple[str, str]]]:
    """Normalised pieces to identifiers, and rules as (licence, ',id,id,'). Equal pieces share an identifier."""
    known: dict[str, str] = {}
    parts: dict[str, list[str]] = {}
    for name, sentence in sentences.items():
        own = pieces(sentence)
        parts[name] = [known.setdefault(p, name if len(own) == 1 else f"{name}.{i + 1}") for i, p in enumerate(own)]
    return known, [(licence, "," + "".join(f"{p}," for name in sequence for p in parts[name])) for licence, sequence in rules]


def triggers(known: dict[str, str]) -> list[str]:
    """Words such that every known sentence holds one of them: greedily, among those of six letters or more
    (where a sentence has any), the one in most sentences left, and of these the longest."""
    left, out = list(known), []
    while left:
        words = sorted({w for s in left for w in s.split()})
        best = max(words, key=lambda w: (len(w) >= 6, sum(w in s for s in left), len(w), w))
        out.append(best)
        left = [s for s in left if best not in s]
    return out


def license_scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_sentences (known ones, cut at lines), sentence_ids (comma-joined, in
    order) and licenses (comma-joined, sorted); empty strings where there are none."""
    known, ordered = compiled(SENTENCES if sentences is None else sentences, RULES if rules is None else rules)
    lookup = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    lower = F.translate(F.col("text"), UPPER, LOWER)
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    some = F.coalesce(lower.rlike("|".join(triggers(known))), F.lit(False))

    def found(ends: str) -> Column:
        normalised = F.transform(F.split(lower, ends, -1), lambda x: F.trim(F.regexp_replace(x, "[^a-z0-9]+", " ")))
        ids = F.transform(F.filter(normalised, lambda x: x.isin(*known)), lambda x: F.try_element_at(lookup, x))
        return F.when(some, ids).otherwise(F.array().cast("array<string>"))

    cut = named.select("id", found(rf"\n+|{ENDS}").alias("ids"), found(ENDS).alias("wrapped"))
    sequence = F.concat(F.lit(","), F.array_join("ids", ","), F.lit(",|,"), F.array_join("wrapped", ","), F.lit(","))
    table = F.array(*[F.struct(F.lit(licence).alias("licence"), F.lit(s).alias("s")) for licence, s in ordered])
    held = cut.select("id", F.col("ids"), F.filter(table, lambda r: F.instr(sequence, r["s"]) > 0).alias("held"))
    longest = F.filter("held", lambda r: ~F.exists("held", lambda q: (F.length(q["s"]) > F.length(r["s"])) & (F.instr(q["s"], r["s"]) > 0)))
    licences = F.array_join(F.array_sort(F.array_distinct(F.transform(longest, lambda r: r["licence"]))), ",")
    return held.select(F.col("id").alias(id_col), F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), licences.alias("licenses"))


def oracle() -> str:
    """The same in DuckDB's SQL, for `documents`."""
    known, ordered = compiled(SENTENCES, RULES)
    text = lambda s: "'" + s.replace("'", "''") + "'"
    lookup = "MAP {" + ", ".join(f"{text(k)}: {text(v)}" for k, v in known.items()) + "}"
    table = "[" + ", ".join(f"{{'licence': {text(a)}, 's': {text(s)}}}" for a, s in ordered) + "]"
    ids = lambda ends: f"list_filter(list_transform(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ends}'), lambda x: {lookup}[trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))]), lambda x: x IS NOT NULL)"
    return rf"""
        WITH c AS (SELECT doc_id, {ids(r"\n+|" + ENDS)} AS ids, {ids(ENDS)} AS wrapped FROM documents),
        s AS (SELECT doc_id, ids, ',' || array_to_string(ids, ',') || ',|,' || array_to_string(wrapped, ',') || ',' AS seq FROM c),
        h AS (SELECT doc_id, ids, list_filter({table}, lambda r: contains(seq, r.s)) AS held FROM s),
        l AS (SELECT doc_id, ids, list_filter(held, lambda r: len(list_filter(held, lambda q: length(q.s) > length(r.s) AND contains(q.s, r.s))) = 0) AS kept FROM h)
        SELECT doc_id, len(ids) AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
               array_to_string(list_sort(list_distinct(list_transform(kept, lambda r: r.licence))), ',') AS licenses
        FROM l"""
