"""License scans: winnowed fingerprints of templates, then banded alignment.

Templates of licence notices are cut into runs of ``GRAM`` tokens; winnowing keeps the smallest
hash of every ``WINDOW`` neighbouring ones, which together form a small inverted index. Hashes of
all runs of a document are looked up in it; hits on neighbouring diagonals that show a share of
the template's fingerprints make a candidate, and an alignment within a band around them gives the
matched share of the template and its span.
Within that span the words that tell a licence from its siblings (name, version, conditions) must
stand as they do in the template, with nothing between them.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.expressions import named

GRAM = 3
WINDOW = 2
#: Share of a template's tokens that must be matched in order.
MIN_COVERAGE = 0.8
#: Share of a template's fingerprints that a candidate must show; 80 % of the tokens in order leave more of them.
MIN_PRINTS = 0.1
#: Tokens that may be inserted or missing: a share of the template, and at least so many.
BAND_SHARE, LEAST_BAND = 0.15, 3

#: Licence notices, as published with the licences.
TEMPLATES = {
    "Apache-2.0 (line)": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT (line)": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "BSD (line)": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause (endorsement)": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "GPL-3.0 (line)": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-4.0 (line)": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 (line)": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0 (line)": "Licensed under CC BY-NC 4.0.",
    "GPL-2.0 (line)": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1 (line)": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0 (line)": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0 (line)": "This work is licensed under the GNU Affero General Public License, version 3.",
    "GPL-3.0-or-later (grant)": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0-or-later": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3",
    "GPL-2.0-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "GPL-3.0-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation.",
    "GPL-2.0 (text)": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc.",
    "GPL-3.0 (text)": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.",
    "LGPL-2.1 (text)": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc.",
    "LGPL-3.0 (text)": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.",
    "AGPL-3.0 (text)": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc.",
    "Apache-2.0 (text)": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "MIT-0": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "0BSD": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
}

_BSD_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
TEMPLATES["BSD-2-Clause (text)"] = f"{TEMPLATES['BSD-2-Clause']} {_BSD_DISCLAIMER}"
TEMPLATES["BSD-3-Clause (text)"] = f"{TEMPLATES['BSD-2-Clause']} {TEMPLATES['BSD-3-Clause (endorsement)']} {_BSD_DISCLAIMER}"

#: Words that tell a licence from its siblings; each run must stand unbroken in a match (one of several spellings).
_GPL = "GNU General Public License"
_LOOSE = (_GPL, "GNU Public License")
CORES: dict[str, list[tuple[str, ...]]] = {
    "Apache-2.0 (line)": [("Apache License Version 2.0",)],
    "Apache-2.0": [("Apache License Version 2.0",)],
    "Apache-2.0 (text)": [("Apache License Version 2.0",)],
    "MIT (line)": [("MIT License",)],
    "MIT": [("notice shall be included", "shall be included in", "included in all copies")],
    "MIT-0": [("furnished to do so the",)],
    "ISC": [("provided that the above", "the above copyright notice", "notice appear in all copies")],
    "0BSD": [("hereby granted the software", "hereby the software")],
    "BSD (line)": [("a BSD style license",)],
    "BSD-3-Clause (endorsement)": [("the names of its contributors", "neither the name of", "endorse or promote products")],
    "BSD-3-Clause (text)": [("the names of its contributors", "neither the name of", "endorse or promote products")],
    "GPL-2.0 (line)": [(f"{_GPL} version 2",)],
    "GPL-3.0 (line)": [(f"{_GPL} version 3",)],
    "LGPL-2.1 (line)": [("GNU Lesser General Public License version 2.1",)],
    "LGPL-3.0 (line)": [("GNU Lesser General Public License version 3",)],
    "AGPL-3.0 (line)": [("GNU Affero General Public License version 3",)],
    "GPL-2.0-or-later": [_LOOSE, ("either version 2 of", "either 2 of")],
    "GPL-3.0-or-later": [_LOOSE, ("either version 3 of", "either 3 of")],
    "GPL-3.0-or-later (grant)": [_LOOSE, ("either version 3 of", "either 3 of")],
    # Of these two the name may lack its first word, but not have another one there.
    "LGPL-2.1-or-later": [("GNU Lesser General Public License", _GPL), ("2.1 of the License",)],
    "AGPL-3.0-or-later": [("GNU Affero General Public License", _GPL), ("3 of the License",)],
    "LGPL-3.0-or-later": [("GNU Lesser General Public License",), ("either version 3",)],
    "GPL-2.0-only": [_LOOSE, ("License version 2 as",)],
    "GPL-3.0-only": [_LOOSE, ("License version 3 as",)],
    "GPL-2.0 (text)": [(f"{_GPL} version 2 June 1991",)],
    "GPL-3.0 (text)": [(f"{_GPL} version 3 29 June 2007",)],
    "LGPL-2.1 (text)": [("GNU Lesser General Public License version 2.1",)],
    "LGPL-3.0 (text)": [("GNU Lesser General Public License version 3",)],
    "AGPL-3.0 (text)": [("GNU Affero General Public License version 3",)],
    "MPL-2.0": [("Mozilla Public License v 2.0", "Mozilla Public License version 2.0")],
}
_CONDITIONS = {"BY": ("Attribution",), "NC": ("NonCommercial", "Non Commercial"), "ND": ("NoDerivatives", "No Derivatives", "NoDerivs"), "SA": ("ShareAlike", "Share Alike")}
for _kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
    _names = list(product(*[_CONDITIONS[x] for x in _kind.split("-")]))
    for _version, _suffix in (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic")):
        _key = f"CC-{_kind}-{_version}"
        # The names of three older templates stay as they are.
        _long, _short = (f"{_key} (notice)", f"{_key} (line)") if _key == "CC-BY-NC-4.0" else (f"{_key} (line)", f"{_key} (short)")
        TEMPLATES[_long] = f"This work is licensed under a Creative Commons {'-'.join(_names[0])} {_version} {_suffix} License."
        TEMPLATES[_short] = f"Licensed under CC {_kind} {_version}."
        CORES[_long] = [tuple(f"Creative Commons {' '.join(x)} {_version}" for x in _names)]
        CORES[_short] = [(f"CC {_kind} {_version}",)]

_ASCII = "".join(chr(c) if chr(c).isalnum() else " " for c in range(128))
TABLE = bytes(ord(c) for c in _ASCII.lower()) + bytes(range(128, 256))
TOKEN = re.compile(r"[A-Za-z0-9\x80-\U0010ffff]+")

NAMES = ["doc_id", "license", "start", "end", "n_matched", "n_template", "coverage"]
OUTPUT = "doc_id long, license string, start long, end long, n_matched long, n_template long, coverage double"


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


def grams(numbers: np.ndarray) -> np.ndarray:
    """Hashes of all runs of ``GRAM`` tokens."""
    n = len(numbers) - GRAM + 1
    out = np.zeros(max(n, 0), np.uint64)
    if n <= 0:
        return out
    for k in range(GRAM):
        out = (out ^ numbers[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


def winnow(hashes: np.ndarray, window: int = WINDOW) -> list[int]:
    """Places of the rightmost smallest hash of each window (of all of them, if there are fewer)."""
    if not len(hashes):
        return []
    picked = {max(range(a, min(a + window, len(hashes))), key=lambda i: (-int(hashes[i]), i)) for a in range(max(1, len(hashes) - window + 1))}
    return sorted(picked)


class Index:
    """The inverted index of winnowed template fingerprints."""

    def __init__(self, templates: dict[str, str], cores: dict[str, list[tuple[str, ...]]] = CORES):
        self.names, self.vocabulary, self.items = list(templates), {}, []
        self.cores = [[[tokens(x) for x in spellings] for spellings in cores.get(name, ())] for name in templates]
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.needed: list[int] = []
        for k, text in enumerate(templates.values()):
            numbers = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in tokens(text)], dtype=np.int64)
            self.items.append(numbers)
            found = grams(numbers)
            prints = winnow(found)
            self.needed.append(max(1, int(MIN_PRINTS * len(prints))))
            for at in prints:
                self.places[int(found[at])].append((k, at))
        self.marks = np.zeros(1 << 18, dtype=bool)
        keys = np.array(list(self.places), dtype=np.uint64)
        self.marks[(keys >> np.uint64(46)).astype(np.int64)] = True


def align(template: np.ndarray, doc: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """``(matched, first, last)``: the most tokens of the template matched in order within ``band`` of a diagonal, and where.

    ``shift`` is the place in the document of the template's first token on the diagonal. Rows
    are template tokens, columns the places within the band; of equally good alignments the one
    that begins last and then ends first counts. A cell holds matched tokens, first place and last
    place (from the end) in one number, so that a maximum compares them in this order.
    """
    m, width = len(template), 2 * band + 1
    low, size = shift - band, m + 2 * band  # all places are counted from the band's first
    place = np.arange(low, low + size)
    inside = (place >= 0) & (place < len(doc))
    tokens_there = np.full(size, -1, dtype=np.int64)
    tokens_there[inside] = doc[place[inside]]
    bits = 21
    mask, columns = (1 << bits) - 1, np.arange(width, dtype=np.int64)
    row, best = np.zeros(width + 1, dtype=np.int64), 0
    for i in range(m):
        equal = tokens_there[i : i + width] == template[i]
        if equal.any():
            at = columns + i
            matched = row[:-1] >> (2 * bits)
            first = np.where(matched > 0, row[:-1] >> bits & mask, at)
            hit = (matched + 1 << 2 * bits) | (first << bits) | (mask - at)
            value = np.maximum(row[1:], np.where(equal, hit, 0))
        else:
            value = row[1:]
        row = np.append(np.maximum.accumulate(value), 0)
        best = max(best, int(row[-2]))
    if not best:
        return 0, 0, -1
    return best >> (2 * bits), low + (best >> bits & mask), low + mask - (best & mask)


def holds(words: list[bytes], cores: list[list[list[bytes]]]) -> bool:
    """Whether one spelling of every core is an unbroken run of the words."""
    return all(any(words[i : i + len(x)] == x for x in spellings for i in range(len(words) - len(x) + 1)) for spellings in cores)


def scan_text(text: str | None, index: Index, min_coverage: float = MIN_COVERAGE) -> list[tuple[str, int, int, int, int, float]]:
    """``(license, start, end, n_matched, n_template, coverage)`` of one text; spans in code points, end exclusive.

    A match holds the cores of its licence. Of matches whose spans overlap, the one with the most
    matched tokens is kept.
    """
    known = index.vocabulary
    words = tokens(text)
    numbers = np.array([known.get(w, 0) for w in words], dtype=np.int64)
    hashes = grams(numbers)
    hits = np.flatnonzero(index.marks[(hashes >> np.uint64(46)).astype(np.int64)])
    diagonals: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    for at in hits.tolist():
        for k, place in index.places.get(int(hashes[at]), ()):
            diagonals[k][at - place].append(place)
    found = []
    for k, shifts in diagonals.items():
        item = index.items[k]
        band = max(LEAST_BAND, int(BAND_SHARE * len(item)))
        ordered, at = sorted(shifts), 0
        while at < len(ordered):
            end = at
            while end + 1 < len(ordered) and ordered[end + 1] - ordered[at] <= band:
                end += 1
            if len({place for shift in ordered[at : end + 1] for place in shifts[shift]}) < index.needed[k]:
                at = end + 1
                continue
            # The band reaches as far beyond the outermost diagonals on either side.
            spread = ordered[end] - ordered[at]
            matched, first, last = align(item, numbers, ordered[at] + spread // 2, band + (spread + 1) // 2)
            if matched >= max(GRAM, min_coverage * len(item)) and holds(words[first : last + 1], index.cores[k]):
                found.append((matched, first, last, k))
            at = end + 1
    out, taken = [], []
    for matched, first, last, k in sorted(found, key=lambda x: (-x[0], -x[0] / len(index.items[x[3]]), x[1], x[3])):
        if all(last < a or first > b for a, b in taken):
            taken.append((first, last))
            out.append((matched, first, last, k))
    if not out:
        return []
    spans = [m.span() for m in TOKEN.finditer(text)]
    return [(index.names[k], spans[a][0], spans[b][1], matched, len(index.items[k]), matched / len(index.items[k])) for matched, a, b, k in sorted(out, key=lambda x: x[1])]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row for each licence notice found in a text.

    Null or empty texts give no row; repeated rows each give theirs; of notices that overlap with
    equally many tokens the one with the higher coverage, then the first, counts; other columns do
    not matter; empty tables give an empty result. Documents are read once and never shuffled; the
    index of the templates is broadcast (a few hundred kilobytes; templates are texts that a caller
    lists or reads with ``read_templates``, not a table that grows with the documents).
    """
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        for batch in batches:
            rows = [(doc, *hit) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in scan_text(text, index, min_coverage)]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], NAMES)

    return docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text")).mapInArrow(run, OUTPUT)


def read_templates(spark: SparkSession, path: str, most_chars: int = 20_000_000) -> dict[str, str]:
    """Templates from a folder of licence texts, one a file, named by the file; more than ``most_chars`` in all is an error."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*?)(\.txt)?$", 1).alias("name"), "value")
    size = files.agg(F.sum(F.length("value"))).first()[0] or 0
    if size > most_chars:
        raise ValueError(f"{size} characters are too many for templates that are held in memory")
    return {r["name"]: r["value"] for r in files.orderBy("name").collect()}
