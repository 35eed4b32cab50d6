"""Licence scans by sentence rules.

A document's sentences are normalised and mapped to the identifiers of known
licence sentences; the sequence of identifiers is then matched against ordered
licence rules, long rules before the single sentences they are made of.
DataFrame functions only; the tables of sentences and rules are constants.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.common import LOWER, SPACES, UPPER, fresh, quoted

# Sentences of public licence texts and notices, as published.
SENTENCES = {
    "mit-ref": "Released under the MIT License.",
    "mit-ref-2": "Licensed under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "mit-condition": (
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software."
    ),
    "mit-warranty": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    "mit-liability": (
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
        "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
        "OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "isc-warranty": (
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
        "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
    ),
    "apache-ref": "Licensed under the Apache License, Version 2.0.",
    "apache-grant": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-warranty": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        'on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "gpl3-ref": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3-grant": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."
    ),
    "gpl2-grant": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
        "later version."
    ),
    "lgpl3-grant": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version."
    ),
    "lgpl21-grant": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
        "option) any later version."
    ),
    "agpl3-grant": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version."
    ),
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-library-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-merchant": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mpl-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "epl-notice": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/"
    ),
    "unlicense-grant": "This is free and unencumbered software released into the public domain.",
    "unlicense-use": (
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
        "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "zlib-warranty": 'This software is provided "as-is", without any express or implied warranty.',
    "zlib-liability": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions:"
    ),
    "cc0-ref": "Licensed under CC0 1.0.",
    "cc-by-nc-ref": "Licensed under CC BY-NC 4.0.",
    "cc-by-ref": "Licensed under CC BY 4.0.",
    "cc-by-sa-ref": "Licensed under CC BY-SA 4.0.",
    "bsd-grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:"
    ),
    "bsd-source-clause": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer."
    ),
    "bsd-name-clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission."
    ),
}
# Identifiers of the SPDX licence list that are looked for after "SPDX-License-Identifier:".
IDENTIFIERS = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0",
    "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only",
    "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT",
    "MPL-2.0", "Unlicense", "Zlib",
)
NAMED = {"MIT": "mit-name", "Apache-2.0": "apache-name", "GPL-3.0-only": "gpl3-name", "BSD-3-Clause": "bsd3-name"}
NAMED |= {x: f"spdx-{x.lower()}" for x in IDENTIFIERS if x not in NAMED}
SENTENCES |= {k: f"SPDX-License-Identifier: {x}" for x, k in NAMED.items()}
#: Licence, then its sentences in order. Earlier rules take their sentences first.
RULES = (
    ("MIT", ("mit-grant", "mit-condition", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-condition")),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("ISC", ("isc-grant",)),
    ("Apache-2.0", ("apache-grant", "apache-use", "apache-warranty")),
    ("Apache-2.0", ("apache-grant", "apache-use")),
    ("AGPL-3.0-or-later", ("agpl3-grant", "gpl-warranty", "gpl-merchant")),
    ("AGPL-3.0-or-later", ("agpl3-grant",)),
    ("LGPL-3.0-or-later", ("lgpl3-grant", "gpl-warranty", "gpl-merchant")),
    ("LGPL-3.0-or-later", ("lgpl3-grant",)),
    ("LGPL-2.1-or-later", ("lgpl21-grant", "gpl-library-warranty", "gpl-merchant")),
    ("LGPL-2.1-or-later", ("lgpl21-grant",)),
    ("GPL-3.0-or-later", ("gpl3-grant", "gpl-warranty", "gpl-merchant")),
    ("GPL-3.0-or-later", ("gpl3-grant",)),
    ("GPL-2.0-or-later", ("gpl2-grant", "gpl-warranty", "gpl-merchant")),
    ("GPL-2.0-or-later", ("gpl2-grant",)),
    ("MPL-2.0", ("mpl-notice",)),
    ("EPL-2.0", ("epl-notice",)),
    ("Unlicense", ("unlicense-grant", "unlicense-use")),
    ("Unlicense", ("unlicense-grant",)),
    ("Zlib", ("zlib-warranty", "zlib-liability", "zlib-grant")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source-clause", "bsd-name-clause")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-name-clause")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source-clause")),
    ("MIT", ("mit-ref",)),
    ("MIT", ("mit-ref-2",)),
    ("Apache-2.0", ("apache-ref",)),
    ("GPL-3.0", ("gpl3-ref",)),
    ("CC0-1.0", ("cc0-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-ref",)),
    ("CC-BY-4.0", ("cc-by-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-ref",)),
    *((x, (k,)) for x, k in NAMED.items()),
)
#: Every known sentence holds one of these, so a text without any has none.
ANCHORS = ("licens", "software", "warrant", "redistribut", "copyright")
#: So many unknown sentences between two known ones end a rule's sequence.
GAP = 4

ENDS = r"[.!?;:]+[\x20\x09-\x0D]+"
OTHER = "[^a-z0-9]+"


def normal(sentence: str) -> str:
    return re.sub(OTHER, " ", sentence.translate(str.maketrans(UPPER, LOWER))).strip(" ")


KNOWN = {normal(s): k for k, s in SENTENCES.items()}
#: Known sentences with a mark inside, by the parts that splitting makes of them.
PARTED = {"".join(f"<{normal(p)}>" for p in parts): f"<{normal(s)}>" for s in SENTENCES.values() if len(parts := re.split(ENDS, s)) > 1}
assert len(KNOWN) == len(SENTENCES) and all(any(a in s for a in ANCHORS) for s in KNOWN)


def _marks(text: Column) -> Column:
    """The sentences of a text, each as <id>, or as ~ where it isn't known; empty ones not at all."""
    known = F.create_map(*(F.lit(x) for pair in KNOWN.items() for x in pair))
    sentences = F.split(F.regexp_replace(F.concat(text, F.lit("\n")), ENDS, "\n"), "\n", -1)
    sentences = F.transform(sentences, lambda s: F.trim(F.regexp_replace(F.translate(s, UPPER, LOWER), OTHER, " "), F.lit(" ")))
    marked = F.concat(F.lit("<"), F.array_join(sentences, "><"), F.lit(">"))
    for parts, whole in PARTED.items():
        marked = F.replace(marked, F.lit(parts), F.lit(whole))
    sentences = F.filter(F.split(F.trim(marked, F.lit("<>")), "><", -1), lambda s: s != "")
    one = lambda s: F.coalesce(F.concat(F.lit("<"), F.try_element_at(known, s), F.lit(">")), F.lit("~"))
    return F.array_join(F.transform(sentences, one), "")


def _known(marks: Column) -> Column:
    return F.char_length(marks) - F.char_length(F.replace(marks, F.lit("<"), F.lit("")))


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with sentence_ids (array of the known sentences' ids, in order), licenses (array, by order of the rules) and n_matches.

    A sentence ends at a line end or at a mark before white space; known
    sentences with such a mark inside are put together again. Each paragraph,
    which an empty line ends, is read by lines and, for wrapped notices, with
    its line ends taken as spaces; the reading that knows more sentences
    holds, that by lines on a tie. A rule's sentences must follow each other
    with fewer than GAP unknown ones between two of them.

    Null and empty texts have no sentences and empty arrays. All rows stay,
    repeated ones too, and all other columns, whatever their names; columns
    with the new names are replaced. A very long text is scanned as one row.
    An empty table gives an empty table.
    """
    docs = docs.drop("sentence_ids", "licenses", "n_matches")
    (both,) = fresh(docs, "_marks")
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    low = F.lower(text)
    none = F.array().cast("array<string>")
    may = reduce(lambda a, b: a | b, (low.contains(a) for a in ANCHORS))

    def read(paragraph: Column) -> Column:
        by_line, flowing = _marks(paragraph), _marks(F.replace(paragraph, F.lit("\n"), F.lit(" ")))
        readings = F.array(F.struct(by_line.alias("m"), flowing.alias("f")))  # so that each is made once
        return F.element_at(F.transform(readings, lambda r: F.when(_known(r["f"]) > _known(r["m"]), r["f"]).otherwise(r["m"])), 1)

    # only paragraphs that could hold a known sentence are read; any other counts as one unknown sentence for each line
    relevant = lambda p: reduce(lambda a, b: a | b, (F.lower(p).contains(a) for a in ANCHORS))
    unknown = lambda p: F.repeat(F.lit("~"), F.size(F.filter(F.split(p, "\n", -1), lambda x: F.trim(x, F.lit(SPACES)) != "")))
    marks = F.array_join(F.transform(F.split(text, "\n\n+", -1), lambda p: F.when(relevant(p), read(p)).otherwise(unknown(p))), "")
    out = docs.withColumn(both, F.when(may, F.regexp_replace(F.regexp_replace(marks, "~{%d,}" % GAP, "|"), "~", "")).otherwise(F.lit("")))
    found_ids = F.split(F.trim(F.regexp_replace(F.replace(F.col(both), F.lit("|"), F.lit("")), "><", "\n"), F.lit("<>")), "\n", -1)
    any_known = F.col(both).contains("<")
    out = out.withColumn("sentence_ids", F.when(any_known, found_ids).otherwise(none))
    # each rule takes its sentences out of the sequence, leaving a mark that no later rule spans
    left, found, counts = F.col(both), [], []
    for name, parts in RULES:
        pattern = "".join(f"<{p}>" for p in parts)
        rest = F.replace(left, F.lit(pattern), F.lit("|"))
        counts.append(((F.char_length(left) - F.char_length(rest)) / (len(pattern) - 1)).cast("long"))
        found.append(F.when(left.contains(pattern), F.lit(name)))
        left = rest
    names = F.when(any_known, F.array_distinct(F.array_compact(F.array(*found)))).otherwise(none)
    total = F.when(any_known, reduce(lambda a, b: a + b, counts)).otherwise(F.lit(0)).cast("long")
    return out.withColumns({"licenses": names, "n_matches": total}).drop(both)
