"""License notices found by conditional compression.

Blocks around licence words are cut from whole texts, wide enough for the longest
notice on either side of each. Spans of a block that may hold a template's wording are
confirmed by a word diff that must leave no identifying word (names, versions)
unmatched, change no word that turns a term round (not, without, only, ...), and no
more than a tenth of the other words. Each confirmed span is
compressed alone and once more with its template as zstandard raw dictionary; where
spans overlap, the one whose template saves most bytes is the notice (ties: fewer
changed words, then the first by name).

Defined results: one row per notice, in the order of the text, over the notice alone;
a null or empty text has none; texts of any length are scanned whole; SPDX identifiers
count as notices; line breaks, indents and comment signs between words
don't count; rows that share an id are scanned on their own; an empty table gives an
empty result.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Wordings of public licence notices.
TEMPLATES = {
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT/notice": "Released under the MIT License.",
    "MIT/licensed": "Licensed under the MIT License.",
    "MIT/full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "ISC/full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD/notice": "Released under the BSD License.",
    "BSD-3-Clause/full": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "GPL-3.0/notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0/notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0/notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0/notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0/notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0/notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0/notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0/notice": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0/notice": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-4.0/long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0/long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0/notice": "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "Unlicense/notice": "This is free and unencumbered software released into the public domain.",
}
#: Identifiers of the SPDX licence list.
SPDX = "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib".split()
TEMPLATES |= {f"{name}/spdx": f"SPDX-License-Identifier: {name}" for name in SPDX}
ANCHOR = r"(?i)licen[cs]e|copyright|redistribut|public\W+domain|creative\W+commons|permission|warrant"
#: A block reaches so far beyond its outer anchors: over the longest notice, indented and commented.
REACH = 2000
#: The share of words other than names that may differ.
LOOSE = 0.1
WORD = re.compile(r"[\w.+-]*\w")
SCHEMA = "doc_id long, block int, start long, length long, license string, plain_bytes long, conditional_bytes long, saved_bytes long, missing_words long, extra_words long, exact boolean"


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the candidate blocks."""
    start = end = None
    for m in re.finditer(ANCHOR, text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if end is None or a > end:
            if end is not None:
                yield start, end
            start = a
        end = b
    if end is not None:
        yield start, end


def _words(text: str) -> list[str]:
    return WORD.findall(text)


def _names(words: list[str]) -> set[str]:
    """Identifying words: names and versions, and in short notices all numbers and acronyms (long ones number and shout)."""
    short = len(words) < 60
    return {w.lower() for w in words if w in NAMES or re.search(r"\d\.\d", w) or short and (any(c.isdigit() for c in w) or sum(c.isupper() for c in w) > 1)}


#: Names of licences that are ordinary words otherwise.
NAMES = {"Apache", "Mozilla", "Creative", "Commons", "Lesser", "Affero", "ShareAlike", "Attribution", "Universal", "unencumbered"}


#: Words that turn a term round: a wording that adds, lacks or swaps one is another wording.
TERMS = ("not", "no", "non", "never", "with", "without", "except", "only", "unless", "must", "commercial", "noncommercial")


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, level: int = 19):
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False)
        self.known = []
        for name, text in sorted(templates.items()):
            held = zstandard.ZstdCompressionDict(" ".join(text.split()).lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words = _words(text)
            self.known.append((name, zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=False), [w.lower() for w in words], _names(words)))

    def scan(self, block: str) -> tuple | None:
        """(licence, plain, conditional, saved, missing, extra) of the notice that saves most."""
        found = self.notices(block)
        return max(found, key=lambda x: x[5])[2:] if found else None

    def notices(self, block: str) -> list[tuple]:
        """(start, end, licence, plain, conditional, saved, missing, extra) of every notice, none over another."""
        at = [m.span() for m in WORD.finditer(block)]
        words = [block[a:b].lower() for a, b in at]
        places: dict[str, list[int]] = {}
        for k, w in enumerate(words):
            places.setdefault(w, []).append(k)
        found = []
        for name, compressor, wanted, names in self.known:
            if not names <= places.keys():
                continue
            for first, last, missing, extra in occurrences(wanted, words, places, names):
                data = " ".join(block[at[first][0] : at[last - 1][1]].split()).lower().encode()
                alone, size = len(self.plain.compress(data)), len(compressor.compress(data))
                if size < alone:
                    found.append((alone - size, -missing - extra, name, first, last, alone, size, missing, extra))
        found.sort(key=lambda x: (-x[0], -x[1], x[2], x[3]))
        taken, out = bytearray(len(words)), []
        for saved, _, name, first, last, alone, size, missing, extra in found:
            if not any(taken[first:last]):
                taken[first:last] = b"\1" * (last - first)
                out.append((at[first][0], at[last - 1][1], name.partition("/")[0], alone, size, saved, missing, extra))
        return sorted(out)


def _loose(wanted: list[str]) -> int:
    return max(1 if len(wanted) > 8 else 0, int(LOOSE * len(wanted)))


def occurrences(wanted: list[str], words: list[str], places: dict[str, list[int]], names: set[str]) -> Iterator[tuple[int, int, int, int]]:
    """(first, last, missing, extra) of the spans of ``words`` that are the template.

    The words of a span that it shares with the template lie on few neighbouring
    diagonals (place in the text less place in the template), and all but ``loose`` of
    the template's words are on them. Only there are words compared in order.
    """
    n, loose = len(wanted), _loose(wanted)
    on = [np.array(places[w]) - i for i, w in enumerate(wanted) if w in places]
    if len(on) < n - loose:
        return
    counts = np.bincount(np.concatenate(on) + n, minlength=len(words) + 2 * n)
    summed = np.concatenate([[0], np.cumsum(counts)])
    width = 2 * loose + 1  # diagonals of one span lie at most missing + extra apart
    near = summed[width:] - summed[:-width]
    need, done = Counter(wanted), -1
    for low in np.flatnonzero(near >= n - loose).tolist():
        if low < done:
            continue
        a, b = max(0, low - n - loose), min(len(words), low + 2 * width)
        if (need & Counter(words[a:b])).total() < n - loose:
            continue
        if span := differences(wanted, words[a:b], names):
            # the place of the first diagonal may have cut it short
            a, b = max(0, a + span[0] - width), min(len(words), a + span[1] + width)
            if whole := differences(wanted, words[a:b], names):
                first, last, missing, extra = whole
                yield a + first, a + last, missing, extra
                done = a + last + n - loose  # the first diagonal of a span behind this one


def differences(wanted: list[str], words: list[str], names: set[str]) -> tuple[int, int, int, int] | None:
    """(first, last, missing, extra) of the template in ``words``, with fewest differences, or None if it isn't there."""
    match = [m for m in difflib.SequenceMatcher(None, wanted, words, autojunk=False).get_matching_blocks() if m.size]
    n, loose, best = len(wanted), _loose(wanted), None
    for x in range(len(match)):
        held, shared = set(), 0
        for m in match[x:]:
            held.update(wanted[m.a : m.a + m.size])
            shared += m.size
            missing, extra = n - shared, m.b + m.size - match[x].b - shared
            if extra > loose:
                break
            if missing <= loose and names <= held and (best is None or missing + extra < best[2] + best[3]):
                best = match[x].b, m.b + m.size, missing, extra
    if best:
        changed = Counter(words[best[0] : best[1]])
        changed.subtract(wanted)
        if any(changed[t] for t in TERMS):  # the nearest wording is another one
            return None
    return best


def _run(templates: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, schema = Scanner(templates), None
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]] for c in SCHEMA.split(", ")]
        schema = pa.schema(list(zip(names, kinds)))
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py().decode("utf-8", "replace")
                for k, (start, end) in enumerate(blocks(text)):
                    for first, last, name, alone, size, saved, missing, extra in scanner.notices(text[start:end]):
                        rows.append((doc_id, k, start + first, last - first, name, alone, size, saved, missing, extra, not missing and not extra))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], schema=schema)

    return run


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per notice; only texts with a licence word leave the JVM."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").rlike(ANCHOR))
    return narrow.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_run(templates), SCHEMA)
