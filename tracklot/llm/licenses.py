"""License scans by conditional compression.

The words around a licensing cue, as far as a template can reach, are searched for each template in windows of its size;
a window with enough of the template's words is a candidate block, cut to the words from the first to the last that the
two share. Each block is compressed with zstandard, alone and with the template as a raw dictionary, and blocks are ranked
by the bytes that the dictionary saves. From the top, a block that no winner overlaps wins once the exact differences in
wording confirm it. Notices next to each other are rows of their own, however their lines are laid out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklot.llm.common import table, text_slices

_CC = (
    ("CC", "CC BY", "Attribution"),
    ("CC-BY-NC", "CC BY-NC", "Attribution-NonCommercial"),
    ("CC-BY-SA", "CC BY-SA", "Attribution-ShareAlike"),
    ("CC-BY-ND", "CC BY-ND", "Attribution-NoDerivatives"),
    ("CC-BY-NC-SA", "CC BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("CC-BY-NC-ND", "CC BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
)
#: (license, wording). One license may have several wordings; all are parts of the licenses' published texts or usual notices.
TEMPLATES = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD", "Released under the BSD License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL", "This work is licensed under the GNU General Public License."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, for any purpose, commercial or non-commercial, and by any means."),
    ("proprietary", "All rights reserved."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD", "Licensed under the BSD License."),
    ("GPL", "Licensed under the GNU General Public License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("CC0", "Licensed under CC0 1.0 Universal."),
    *((name, f"Licensed under {short} 4.0.") for name, short, _ in _CC),
    *((name, f"This work is licensed under a Creative Commons {long} 4.0 International License.") for name, _, long in _CC[1:]),
)
#: Words of a cue may stand on two lines.
CUES = re.compile(r"licen[cs]e|copyright|all[\W_]+rights[\W_]+reserved|permission[\W_]+(?:is|to)|redistribut|public[\W_]+domain|creative[\W_]+commons|free[\W_]+software", re.I)
#: Characters to either side of a cue that are searched: three times the longest template, for its layout.
REACH = 3 * max(len(t) for _, t in TEMPLATES)
#: A template of fewer words is confirmed only with all its words but these and numbers: without its name it is no license.
SHORT, GENERIC = 16, frozenset("released licensed license under the this work is a of version public general all rights reserved international universal".split())
#: Share of the template's words that the block must have in order, and the least saving.
MIN_WORDING, MIN_SAVING = 0.75, 0.08
FOUND = "doc_id long, start long, length long, license string, template int, saving double, wording double, missing_words string"
_WORD = re.compile(r"[^\W_]+")


def regions(text: str) -> Iterator[tuple[int, int]]:
    """(start, end): what lies within reach of a cue."""
    start = end = None
    for m in CUES.finditer(text):
        low, high = max(0, m.start() - REACH), m.end() + REACH
        if end is not None and low <= end:
            end = high
            continue
        if end is not None:
            yield start, end
        start, end = low, high
    if end is not None:
        yield start, end


@cache
def _compressors() -> tuple[zstandard.ZstdCompressor, list[zstandard.ZstdCompressor]]:
    raw = [zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for _, t in TEMPLATES]
    plain = {"level": 9, "write_content_size": False, "write_checksum": False}
    return zstandard.ZstdCompressor(**plain), [zstandard.ZstdCompressor(dict_data=d, write_dict_id=False, **plain) for d in raw]


def _words(s: str) -> list[str]:
    return _WORD.findall(s.lower())


@cache
def _wanted() -> list[tuple[list[str], Counter, frozenset]]:
    """Each template's words, their counts and those that may not be missing."""
    out = []
    for _, t in TEMPLATES:
        want = _words(t)
        out.append((want, Counter(want), frozenset(w for w in want if w not in GENERIC and not w.isdigit()) if len(want) < SHORT else frozenset()))
    return out


def _align(k: int, have: list[str]) -> tuple[float, int, int, set[int]]:
    """(wording, first, last, places in the template) of a template's words in order; a stray word before or after is left out."""
    want = _wanted()[k][0]
    parts = [p for p in SequenceMatcher(None, want, have, autojunk=False).get_matching_blocks() if p.size]
    stray = lambda p, q: q.b - p.b - p.size > q.a - p.a - p.size + 3
    while len(parts) > 1 and parts[0].size <= 2 and stray(parts[0], parts[1]):
        del parts[0]
    while len(parts) > 1 and parts[-1].size <= 2 and stray(parts[-2], parts[-1]):
        del parts[-1]
    hit = {i for p in parts for i in range(p.a, p.a + p.size)}
    return len(hit) / len(want), parts[0].b if parts else 0, parts[-1].b + parts[-1].size if parts else 0, hit


def _first(k: int, have: list[str]) -> tuple[int, int, float, set[int]] | None:
    """(first word, end, wording, places in the template) of a template's first confirmed spot."""
    want, counts, named = _wanted()[k]
    need, wide = math.ceil(MIN_WORDING * len(want)), math.ceil(1.5 * len(want))
    seen: Counter = Counter()
    low = both = 0
    for i, w in enumerate(have):
        if w in counts:
            both += seen[w] < counts[w]
            seen[w] += 1
        if i - low >= wide:
            gone = have[low]
            if gone in counts:
                seen[gone] -= 1
                both -= seen[gone] < counts[gone]
            low += 1
        if both < need or w not in counts:
            continue
        best, starts = None, [low, low + _align(k, have[low : i + 1])[1]]
        for start in starts:
            for size in (len(want), math.ceil(1.25 * len(want)), wide):
                wording, x, y, hit = _align(k, have[start : start + size])
                if wording >= MIN_WORDING and named <= {want[j] for j in hit} and (best is None or (wording, x - y) > (best[2], best[0] - best[1])):
                    best = start + x, start + y, wording, hit
            if best and best[0] not in starts:  # the window may have ended inside the notice
                starts.append(best[0])
        if best:
            return best
    return None


def _spots(k: int, have: list[str]) -> Iterator[tuple[int, int, float, set[int]]]:
    """All confirmed spots of a template, left to right."""
    low = 0
    while found := _first(k, have[low:]):
        x, y, wording, hit = found
        yield low + x, low + y, wording, hit
        low += y


def find_notices(text: str) -> list[tuple[int, int, int, float, float, str]]:
    """(start, length, template, saving, wording, words of the template that are missing) of all notices, in order."""
    plain, withs = _compressors()
    out = []
    for low, high in regions(text):
        at = [(low + m.start(), low + m.end(), m[0].lower()) for m in _WORD.finditer(text[low:high])]
        have = [w for _, _, w in at]
        there, ranked = set(have), []
        for k, (want, counts, named) in enumerate(_wanted()):
            if named <= there and sum(c for w, c in counts.items() if w in there) >= MIN_WORDING * len(want):
                for x, y, wording, hit in _spots(k, have):
                    block = " ".join(text[at[x][0] : at[y - 1][1]].lower().split()).encode()
                    alone = len(plain.compress(block))
                    saved = alone - len(withs[k].compress(block))
                    ranked.append((saved, wording, -k, x, y, saved / alone, hit))
        taken: list[tuple] = []
        for r in sorted(ranked, key=lambda r: r[:5], reverse=True):
            if not any(r[3] < t[4] and t[3] < r[4] for t in taken) and r[5] >= MIN_SAVING and r[1] >= MIN_WORDING:
                taken.append(r)
        for _, wording, k, x, y, saving, hit in sorted(taken, key=lambda t: t[3]):
            missing = " ".join(w for i, w in enumerate(_wanted()[-k][0]) if i not in hit)
            out.append((at[x][0], at[y - 1][1] - at[x][0], -k, saving, wording, missing))
    return out


def scan_block(block: str) -> tuple[int, float, float, str] | None:
    """(template, saving, wording, words of the template that are missing) of the best confirmed template."""
    found = [f[2:] for f in find_notices(block)]
    return max(found, key=lambda f: (f[2], len(_wanted()[f[0]][0]), f[1])) if found else None


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        for low, high, texts in text_slices(batch):
            rows: list[tuple] = []
            for d, text in zip(ids[low:high], texts, strict=True):
                if CUES.search(text):
                    for start, length, k, saving, wording, missing in find_notices(text):
                        rows.append((d, start, length, TEMPLATES[k][0], k, saving, wording, missing))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.string())
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[f.split()[0] for f in FOUND.split(", ")])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """A row per confirmed license notice (doc_id, text; other columns are ignored).

    Null, empty and license-free texts give no rows, and so does an empty table; a null doc_id comes back with its notices;
    repeated rows are scanned each. Templates that save as many bytes of a block are ranked by wording, then by their
    order in ``TEMPLATES``. Nothing is shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_scan, FOUND)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
