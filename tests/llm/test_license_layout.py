import random
import textwrap

import pytest

from tracklot.llm.licenses import TEMPLATES, find_notices, op9_licenses, scan_block, scan_licenses


def names(text):
    return [TEMPLATES[f[2]][0] for f in find_notices(text)]


@pytest.mark.parametrize("width", [30, 60, 78])
@pytest.mark.parametrize("prefix", ["", " * ", "# "])
def test_templates_in_published_layout(width, prefix):
    for name, text in TEMPLATES:
        notice = textwrap.fill(text, width, initial_indent=prefix, subsequent_indent=prefix, break_long_words=False, break_on_hyphens=False)
        body = f"int before = 1;\nsome more text\n{notice}\nand after\n"
        (start, length, k, _, wording, missing), = find_notices(body)
        assert (TEMPLATES[k][0], wording, missing) == (name, 1, "") and body[start : start + length].split()[-1].strip(".") == text.split()[-1].strip(".").strip("/")


def test_headers_with_few_cues():
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */\n"
    un = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.\n"
    assert names(mpl) == ["MPL-2.0"] and names(un) == ["Unlicense"]


def test_notices_side_by_side():
    for a in TEMPLATES:
        for b in TEMPLATES:
            assert names(f"{a[1]}\n{b[1]}\n") == [a[0], b[0]], (a, b)
    assert names("Licensed under CC BY-NC 4.0.") == ["CC-BY-NC"]
    assert scan_block("Released under the Zed License.") is None


def test_every_notice_of_the_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {(r.doc_id, n) for r in rows for n, notice in (("CC-BY-NC", "Licensed under CC BY-NC 4.0."), ("proprietary", "All rights reserved.")) if notice in (r.text or "")}
    assert want <= {(r.doc_id, r.license) for r in op9_licenses(spark, sf).collect()}


def test_notices_planted_in_prose_are_found_at_their_places(spark):
    """Brute force: texts are put together from prose and whole templates, so every notice and its place are known."""
    rng = random.Random(9)
    prose = lambda: " ".join(rng.choice(["haon", "thed", "rean", "ingly", "stea", "nder", "onha"]) for _ in range(rng.randint(12, 60)))
    rows, want = [], {}
    for d in range(60):
        text, spans = prose() + "\n", []
        for k in rng.sample(range(len(TEMPLATES)), rng.randint(0, 3)):
            name, wording = TEMPLATES[k]
            spans.append((name, len(text), len(text) + len(wording)))
            text += wording + "\n" + prose() + "\n"
        rows.append((d, text))
        want[d] = spans
    found = {}
    for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault(r.doc_id, []).append((r.license, r.start, r.start + r.length))
    for d, spans in want.items():
        got = sorted(found.get(d, []), key=lambda x: x[1])
        assert [g[0] for g in got] == [s[0] for s in spans], rows[d]
        assert all(abs(g[1] - s[1]) <= 3 and abs(g[2] - s[2]) <= 3 for g, s in zip(got, spans, strict=True))


def test_two_short_notices_side_by_side_and_far_cues():
    assert [TEMPLATES[f[2]][0] for f in find_notices("Released under the MIT License.\nLicensed under the Apache License, Version 2.0.")] == ["MIT", "Apache-2.0"]
    many = "".join(f"line {i} speaks of a license for words\n" for i in range(60))
    assert [TEMPLATES[f[2]][0] for f in find_notices(many + "Released under the MIT License.")] == ["MIT"]


def test_null_ids_ties_and_empty_tables(spark):
    text = "Released under the MIT License."
    docs = spark.createDataFrame([(None, text, 1), (2, text, 1), (2, text, 1), (3, None, 1), (4, "", 1), (5, "no cue", 1)], "doc_id long, text string, saving int")
    rows = scan_licenses(docs).collect()
    assert sorted((r.doc_id or -1, r.license, r.start, r.length) for r in rows) == [(-1, "MIT", 0, 30), (2, "MIT", 0, 30), (2, "MIT", 0, 30)]
    assert scan_licenses(docs.limit(0)).count() == 0
