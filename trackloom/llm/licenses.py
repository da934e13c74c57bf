"""License scan by sentence rules: normalised sentences to identifiers, identifier sequences to ordered rules."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice, zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import small_batches

# Sentences of public licence texts and notices, and which of them, in this order, make up a licence.
SENTENCES = {
    "apache2-by": "Licensed under the Apache License, Version 2.0",
    "apache2-may-not": "you may not use this file except in compliance with the License",
    "apache2-obtain": "You may obtain a copy of the License at",
    "apache2-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "mit-by": "Released under the MIT License",
    "mit-by-2": "Licensed under the MIT License",
    "mit-granted": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "gpl3-by": "This work is licensed under the GNU General Public License, version 3",
    "gpl3-by-2": "Licensed under the GNU General Public License, version 3",
    "gpl-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0",
    "cc-by-4": "Licensed under CC BY 4.0",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0",
    "cc-by-4-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "reserved": "All rights reserved",
    "isc-granted": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "gpl2-redistribute": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "lgpl21-redistribute": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "agpl3-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "spdx-apache2": "SPDX-License-Identifier: Apache-2.0",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-bsd3": "SPDX-License-Identifier: BSD-3-Clause",
    "spdx-bsd2": "SPDX-License-Identifier: BSD-2-Clause",
    "spdx-gpl3": "SPDX-License-Identifier: GPL-3.0-only",
    "spdx-gpl3-later": "SPDX-License-Identifier: GPL-3.0-or-later",
    "spdx-mpl2": "SPDX-License-Identifier: MPL-2.0",
    "spdx-isc": "SPDX-License-Identifier: ISC",
}
RULES = {
    "Apache-2.0": [["apache2-by"], ["apache2-may-not", "apache2-obtain", "apache2-as-is"], ["spdx-apache2"]],
    "MIT": [["mit-by"], ["mit-by-2"], ["mit-granted", "mit-notice", "mit-as-is"], ["spdx-mit"]],
    "GPL-3.0-only": [["gpl3-by"], ["gpl3-by-2"], ["spdx-gpl3"]],
    "GPL-3.0-or-later": [["gpl-redistribute", "gpl-hope"], ["spdx-gpl3-later"]],
    "GPL-2.0-or-later": [["gpl2-redistribute"]],
    "LGPL-2.1-or-later": [["lgpl21-redistribute"]],
    "AGPL-3.0-or-later": [["agpl3-redistribute"]],
    "ISC": [["isc-granted"], ["spdx-isc"]],
    "CC-BY-NC-4.0": [["cc-by-nc-4"]],
    "CC-BY-4.0": [["cc-by-4"], ["cc-by-4-long"]],
    "CC-BY-SA-4.0": [["cc-by-sa-4"]],
    "CC0-1.0": [["cc0"]],
    "BSD-3-Clause": [["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"], ["spdx-bsd3"]],
    "BSD-2-Clause": [["bsd-redistribution", "bsd-source", "bsd-binary"], ["spdx-bsd2"]],
    "MPL-2.0": [["mpl2"], ["spdx-mpl2"]],
    "Unlicense": [["unlicense"]],
    "All-rights-reserved": [["reserved"]],
}

BORDER = re.compile(r"(?<=[.;:!?])\s+")
LINE = re.compile(r"\n+")
MARKS = re.compile(r"[^a-z0-9.]+")
HEAD = re.compile(r"([a-z0-9][a-z0-9.]*)(?:[^a-z0-9.]+([a-z0-9.]+))?")
WORD, FIRST = re.compile(r"[a-z0-9.]+"), re.compile(r"[a-z0-9]")


def normalised(sentence: str) -> str:
    """Lower case; what is no letter, digit or dot becomes one blank; no dots or blanks at the ends."""
    return MARKS.sub(" ", sentence.lower()).strip(" .")


def by_head(known: dict[str, str]) -> dict[tuple[str, str], list[tuple[str, str]]]:
    """The known sentences (normalised) and their identifiers by their first two words, the second empty where there is none."""
    heads: dict[tuple[str, str], list[tuple[str, str]]] = {}
    for s, name in known.items():
        if m := HEAD.search(s):
            heads.setdefault((m[1].rstrip("."), (m[2] or "").rstrip(".")), []).append((s, name))
    return heads


def sentence_ids(text: str, heads: dict[tuple[str, str], list[tuple[str, str]]]) -> list[tuple[int, str]]:
    """(start, identifier) of the known sentences, in order. Each begins and ends at a border or at a line's; it may hold borders and go over several lines."""
    low = text.lower()
    cuts = [m.span() for border in (BORDER, LINE) for m in border.finditer(low)]
    ends = sorted({a for a, _ in cuts} | {len(low)})
    found, past, m, done = set(), len(low), None, -1
    for at in sorted({0, *(b for _, b in cuts)}, reverse=True):
        # the first word after this cut: before the next cut, else the one found for that
        if near := FIRST.search(low, at, past):
            m = HEAD.match(low, near.start())
        past = at
        if not m or m.start() == done:  # many cuts may have the same first word
            continue
        done = m.start()
        first, second = m[1].rstrip("."), (m[2] or "").rstrip(".")
        some = heads.get((first, second), []) + (heads.get((first, ""), []) if second else [])
        found |= {(m.start(), name) for s, name in some if ends_well(low, m.start(), s, ends)}
    return sorted(found)


def ends_well(low: str, start: int, sentence: str, ends: list[int]) -> bool:
    """Whether the words from start on are the sentence's, however far apart, and only marks and blanks follow up to a border."""
    words = sentence.split(" ")
    past = start
    for i, (word, m) in enumerate(zip_longest(words, islice(WORD.finditer(low, start), len(words))), 1):
        if m is None or (m[0] != word and not (i == len(words) and m[0].rstrip(".") == word)):
            return False
        past = m.start() + len(word)
    border = ends[bisect_left(ends, past)]
    return not FIRST.search(low, past, border)


def matched(ids: list[str], rules: dict[str, list[list[str]]]) -> list[str]:
    """Licences of which a rule's identifiers all come, in its order (others may stand between).

    Longer rules are tried first, each as often as it comes; a sentence that one has used is not there for the next, so a
    licence inside a longer one is found only where its own sentences come once more.
    """
    rest, found = list(ids), set()
    for _, name, way in sorted((-len(way), name, way) for name, ways in rules.items() for way in ways):
        while way:
            at, used = 0, []
            for x in way:
                if x not in rest[at:]:
                    break
                at = rest.index(x, at) + 1
                used.append(at - 1)
            if len(used) < len(way):
                break
            found.add(name)
            rest = [x for i, x in enumerate(rest) if i not in used]
    return sorted(found)


def scan_licenses(docs: DataFrame, sentences: dict[str, str] | None = None, rules: dict[str, list[list[str]]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document with a known sentence: doc_id, sentence_ids and licenses (comma-joined), n_sentences.

    Null and empty texts have none. Repeated rows give a row each, repeated sentences repeat their identifier. An empty
    table gives an empty result. The dictionaries are the caller's and small. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    known = {normalised(s): n for n, s in (sentences or SENTENCES).items()}
    heads = by_head(known)
    rules = rules or RULES
    # a document without any of these words has no known sentence; each sentence has at least one of them
    hints = ["licen", "permi", "redistribut", "copyright", "warrant", "software", "rights", "endorse"]
    hints += [max(s.split(), key=len) for s in known if s and not any(h in s for h in hints)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, text in zip(b.column("id").to_pylist(), b.column("t").to_pylist(), strict=True):
                low = text.lower() if text else ""
                if any(h in low for h in hints) and (ids := [n for _, n in sentence_ids(text, heads)]):
                    rows.append((i, ",".join(ids), ",".join(matched(ids, rules)), len(ids)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [id_col, "sentence_ids", "licenses", "n_sentences"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return source.mapInArrow(run, f"{id_col} long, sentence_ids string, licenses string, n_sentences long")
