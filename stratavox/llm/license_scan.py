"""License scans by conditional compression.

Candidate blocks are found over all of a text. A template counts as there if at most a tenth of its words are missing, so of its longest words, one more than
may miss, at least one must be there: each place of such a word, with as many words around it as the template can take up, is a block. It is dropped if the
template's words, in any order, aren't there. Each block is compressed with each template that it may hold as a zstandard raw dictionary, and the templates are
ranked by the bytes they save. Those that save enough of what they save of themselves are confirmed by their wording: the words of
block and template are aligned, and the differences may not touch what tells licenses apart (numbers, names and terms); the confirmed span alone must then gain
``GAIN``, so words that are scattered among others don't count. Of spans that overlap, the one that saves most stays (ties: fewer differences, then the earlier
template and place), with its exact differences. Line breaks and comment signs between words don't count, nor does case.

Tags (``SPDX-License-Identifier:`` or ``SPDX:``) carry expressions: each identifier of one, written out as a tag of its own, is such a block. Identifiers without a
template, and the exceptions after WITH, aren't reported.

Templates are notices, headings and opening paragraphs of common licenses, Creative Commons terms by version, and tags.

Each text is one task's work; nothing is shuffled. Defined results: a null or empty text has no spans; repeated rows are scanned alike; an
empty table gives an empty result; columns named n_blocks, licenses or found are replaced; texts of any length are scanned whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values: (license, wording). Notices and the opening paragraphs of license texts.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Apache-2.0", "Licensed under the Apache 2.0 license."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "MIT License Copyright (c)"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Proprietary", "All rights reserved."),
]
#: Creative Commons terms with their full names and versions, and identifiers of licenses in tags.
CC_TERMS = [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]
CC_VERSIONS = ["2.0", "3.0", "4.0"]
SPDX = "BSL-1.0 0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause CC0-1.0 EPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib".split()
for _version in CC_VERSIONS:
    for _term, _name in CC_TERMS:
        _kind = "International" if _version == "4.0" else "Unported" if _version == "3.0" else "Generic"
        TEMPLATES += [(f"CC-{_term}-{_version}", f"Licensed under CC {_term} {_version}."), (f"CC-{_term}-{_version}", f"This work is licensed under a Creative Commons {_name} {_version} {_kind} License.")]
SPDX += [f"CC-{_term}-{_version}" for _version in CC_VERSIONS for _term, _ in CC_TERMS]
TAGS = range(len(TEMPLATES), len(TEMPLATES) + len(SPDX))
TEMPLATES += [(_id, f"SPDX-License-Identifier: {_id}") for _id in SPDX]
#: Words that tell licenses apart.
TELLING = frozenset("isc zlib epl eclipse unlicense boost bsl 0bsd cc0 only later apache gnu general lesser affero public mit bsd mozilla mpl cc by nc sa nd creative commons attribution noncommercial sharealike noderivatives not no gpl lgpl agpl".split())
#: What a span must save, as a part of what the template saves of itself, what of that its block must save, and how much of a template must be there.
GAIN, BLOCK_SHARE, COVER = 0.6, 0.5, 0.9
LEVEL = 19

_WORD = re.compile(r"[^\W_]+")
_COMMENT = re.compile(r"^[^\S\n]*(?:dnl|rem)\b", re.M)
_TAG = re.compile(r"\bSPDX(?:-License-Identifier)?:", re.I)
_ID = re.compile(r"[ \t()]*([A-Za-z0-9][A-Za-z0-9.+-]*)")


def _lower(text: str) -> str:
    low = text.lower()
    if len(low) != len(text):  # some letters change length
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low


def words(text: str) -> list[tuple[str, int, int]]:
    """(lower word, start, end); line breaks and comment signs fall between words, and comment words at line starts are left out."""
    low = _lower(text)
    signs = {m.end() for m in _COMMENT.finditer(low)}
    return [(m[0], m.start(), m.end()) for m in _WORD.finditer(low) if m.end() not in signs]


def tags(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, identifier) of the identifiers of a text's tags, the first with its tag; an expression ends with the line, or where two
    identifiers stand without an operator between."""
    for m in _TAG.finditer(text):
        start, end, joined, exception = m.start(), m.end(), True, False
        while t := _ID.match(text, end):
            end = t.end()
            if t[1] in ("AND", "OR", "WITH"):
                joined, exception = True, t[1] == "WITH"
                continue
            if not joined:
                break
            if not exception:
                yield t.start(1) if start is None else start, end, t[1].rstrip(".")
            start, joined, exception = None, False, False


class Scanner:
    def __init__(self, gain: float = GAIN):
        import zstandard as z

        self.gain = gain
        bare = z.ZstdCompressionParameters.from_level(LEVEL, source_size=1 << 14, write_content_size=False, write_checksum=False, write_dict_id=False)  # small tables, as blocks are short
        self.alone = z.ZstdCompressor(compression_params=bare)
        self.words = [[w for w, _, _ in words(t)] for _, t in TEMPLATES]
        self.versioned = [any(w.isdecimal() for w in own) for own in self.words]  # elsewhere a number is that of a list
        self.counts = [Counter(w) for w in self.words]
        self.telling = [{w for w in own if w in TELLING or w.isdecimal() and v} for own, v in zip(self.words, self.versioned)]
        self.given = [z.ZstdCompressor(compression_params=bare, dict_data=z.ZstdCompressionDict(" ".join(w).encode(), dict_type=z.DICT_TYPE_RAWCONTENT)) for w in self.words]
        self.own = [self.saved(w, k) for k, w in enumerate(self.words)]
        self.anchors: dict[str, list[tuple[int, int]]] = {}  # (template, word) of the places of a template's longest words
        for k, own in enumerate(self.words):
            places = sorted(range(len(own)), key=lambda j: (-len(own[j]), j))
            for j in places[: int(len(own) * (1 - COVER) + 1e-9) + 1]:
                self.anchors.setdefault(own[j], []).append((k, j))

    def saved(self, have: list[str], k: int) -> int:
        """Bytes that a template saves of the words' compressed size."""
        raw = " ".join(have).encode("utf-8", "replace")
        return len(self.alone.compress(raw)) - len(self.given[k].compress(raw))

    def rank(self, block: str) -> list[tuple[float, int]]:
        """(gain, template), best first; gain is what the template saves of the block, as a part of what it saves of itself."""
        have = [w for w, _, _ in words(block)]
        return sorted(((self.saved(have, k) / own, k) for k, own in enumerate(self.own)), key=lambda x: (-x[0], x[1]))

    def possible(self, have: list[str], k: int) -> bool:
        """Whether enough of a template's words are there in any order."""
        return sum((self.counts[k] - Counter(have)).values()) <= len(self.words[k]) * (1 - COVER) + 1e-9

    def differences(self, have: list[str], k: int) -> tuple[float, list[str], int, int] | None:
        """(cover, differences, first word, end word) of a template's wording where it stands; None if it isn't there or a telling word differs."""
        want = self.words[k]
        match = SequenceMatcher(None, want, have, autojunk=False)
        same = [m for m in match.get_matching_blocks() if m.size]
        cover = sum(m.size for m in same) / len(want)
        if cover < COVER - 1e-9:
            return None
        first, last = same[0], same[-1]
        if last.b + last.size - first.b > 1.5 * len(want) + 3:  # scattered words
            return None
        out = [f"-{w}" for w in want[: first.a]]
        for x, y in zip(same, same[1:]):
            out += [f"-{w}" for w in want[x.a + x.size : y.a]] + [f"+{w}" for w in have[x.b + x.size : y.b]]
        out += [f"-{w}" for w in want[last.a + last.size :]]
        if any(w[1:] in TELLING or w[1:].isdecimal() and self.versioned[k] for w in out):
            return None
        return cover, out, first.b, last.b + last.size

    def within(self, there: set[str] | frozenset[str], k: int) -> bool:
        """Whether a set of words can hold a template: all that tells it apart, and enough of its words."""
        return self.telling[k] <= there and len(self.counts[k].keys() - there) <= len(self.words[k]) * (1 - COVER) + 1e-9

    def blocks(self, have: list[str]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(word, [(template, where it would start)]) of the places where templates may stand."""
        there = set(have)
        here = {w: ks for w in there if (ks := [(k, j) for k, j in self.anchors.get(w, ()) if self.within(there, k)])}
        if not here:
            return
        for i, w in enumerate(have):
            if w in here:
                near: dict[int, set[str]] = {}
                found = []
                for k, j in here[w]:
                    n = len(self.words[k])
                    reach = 1 << (3 * n // 2 + 4).bit_length()
                    if reach not in near:
                        near[reach] = set(have[max(0, i - reach) : i + reach])
                    if self.within(near[reach], k):
                        found.append((k, i - j))
                if found:
                    yield i, found

    def confirm(self, have: list[str], k: int, start: int) -> tuple | None:
        """(-bytes saved, number of differences, template, first word, end word, gain, differences) of a template that would start there."""
        n = len(self.words[k])
        for slack in (1, n // 10 + 2, n // 2 + 3):  # the nearest words first, as other notices may stand beside
            a, b = max(0, start - slack), start + n + slack
            said = self.differences(have[a:b], k) if self.possible(have[a:b], k) else None
            if said:
                _, diff, x, y = said
                saved = self.saved(have[a + x : a + y], k)
                return (-saved, len(diff), k, a + x, a + y, round(saved / self.own[k], 4), " ".join(diff)) if saved >= self.gain * self.own[k] else None
        return None

    def scan(self, text: str) -> list[tuple[int, str, float, str]]:
        """(start, license, gain, differences) of the confirmed spans that don't overlap a better one, by start."""
        found, tagged = [], []
        for start, end, name in tags(text):
            block = [w for w, _, _ in words(f"SPDX-License-Identifier: {name}")]
            for saved, k in sorted((-self.saved(block, k), k) for k in TAGS if self.telling[k] <= set(block)):
                if block == self.words[k]:
                    found.append((start, TEMPLATES[k][0], round(-saved / self.own[k], 4), ""))
                    tagged.append((start, end))
                    break
        there = set(_WORD.findall(_lower(text)))
        if any(self.within(there, k) for w in self.anchors.keys() & there for k, _ in self.anchors[w]):
            read = words(text)
            have = [w for w, _, _ in read]
            tried: set[tuple[int, int]] = set()  # a template's longest words often agree on where it starts
            confirmed = set()
            for _, places in self.blocks(have):
                size: dict[tuple[int, int], int] = {}
                ranked = []
                for k, at in places:
                    if (k, at) in tried:
                        continue
                    tried.add((k, at))
                    n = len(self.words[k])
                    a, b = max(0, at - n // 2 - 3), at + n + n // 2 + 3
                    if self.possible(have[a:b], k):
                        raw = " ".join(have[a:b]).encode("utf-8", "replace")
                        if (a, b) not in size:
                            size[a, b] = len(self.alone.compress(raw))
                        saved = size[a, b] - len(self.given[k].compress(raw))
                        if saved >= BLOCK_SHARE * self.gain * self.own[k]:
                            ranked.append((-saved, k, at))
                for _, k, at in sorted(ranked):
                    if said := self.confirm(have, k, at):
                        confirmed.add(said)
            first = [a for _, a, _ in read]
            taken = {i for a, z in tagged for i in range(bisect_left(first, a), bisect_left(first, z))}
            for _, _, k, x, y, gain, diff in sorted(confirmed):
                if taken.isdisjoint(range(x, y)):
                    taken.update(range(x, y))
                    found.append((read[x][1], TEMPLATES[k][0], gain, diff))
        return sorted(found)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """The rows of docs with n_blocks, licenses (sorted, comma-joined) and found (start:license:gain:differences, semicolon-joined)."""
    new = ["n_blocks", "licenses", "found"]
    docs = docs.select(*(c for c in docs.columns if c not in new))
    schema = docs.select(*docs.columns).schema.add("n_blocks", "long").add("licenses", "string").add("found", "string")

    def run(batches):
        scanner = Scanner()
        for b in batches:
            found = [scanner.scan(t.as_py() or "") for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([len(x) for x in found], pa.int64()), pa.array([",".join(sorted({y[1] for y in x})) for x in found], pa.string()), pa.array([";".join(":".join(map(str, y)) for y in x) for x in found], pa.string())],
                names=schema.names,
            )

    return docs.mapInArrow(run, schema)


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")


QUERIES = {"op2_license_scan": op2_license_scan}
