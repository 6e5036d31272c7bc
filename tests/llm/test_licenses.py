import re

from tracklot.llm.licenses import TEMPLATES, op9_licenses, scan_block, scan_licenses


def test_every_template_finds_itself_and_edits_are_named():
    for name, text in TEMPLATES:
        k, _, wording, missing = scan_block(text)
        assert TEMPLATES[k][0] == name and wording == 1 and missing == ""
    k, _, wording, missing = scan_block(TEMPLATES[0][1].replace("without restriction", "with restraint"))
    assert TEMPLATES[k][0] == "MIT" and wording < 1 and "restriction" in missing
    assert scan_block("Driving license fees rose sharply this year in the whole region.") is None


def test_whole_table(spark, sf):
    notices = {"MIT": "Released under the MIT License", "Apache-2.0": "Licensed under the Apache License, Version 2.0", "GPL": "licensed under the GNU General Public"}
    want = {(r.doc_id, name) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for name, n in notices.items() if n in (r.text or "")}
    got = {(r.doc_id, r.license) for r in op9_licenses(spark, sf).collect()}
    assert want <= got
    plain = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if not re.search("licen|copyright|rights reserved", r.text or "", re.I)}
    assert not plain & {d for d, _ in got}


def test_long_texts_nulls_repeats(spark):
    long = "word " * 50_000 + "\n" + TEMPLATES[0][1] + "\n" + "word " * 100
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, long, 1), (4, "Released under the MIT License.", 1), (4, "Released under the MIT License.", 1)], "doc_id long, text string, start int")
    rows = sorted((r.doc_id, r.start, r.license) for r in scan_licenses(docs).collect())
    assert rows == [(3, 250_001, "MIT"), (4, 0, "MIT"), (4, 0, "MIT")]
    assert scan_licenses(docs.limit(0)).count() == 0
