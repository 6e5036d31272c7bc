from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm.test_line_dedup import brute as without_repeats
from tests.llm.test_near_dups import brute as groups
from tests.llm.test_quality import brute as base_rules


def test_stages_against_brute_force(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, given = docs.columns, {r.doc_id: r for r in docs.collect()}
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf), name)
        out[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    good = {r.doc_id for r in out["quality"]}
    assert all(not base_rules(given[d].text)[5] for d in good) and all(tuple(r) == tuple(given[r.doc_id]) for r in out["quality"])
    want = without_repeats([(r.doc_id, r.text) for r in out["quality"]])
    assert {r.doc_id: r.text for r in out["line_dedup"]} == {d: w[2] for d, w in want.items()}
    kept = groups([(r.doc_id, r.text) for r in out["line_dedup"]])
    assert {r.doc_id for r in out["near_dedup"]} == {d for d, g in kept.items() if g[2]}
    assert {r.doc_id for r in out["mixing"]} <= {r.doc_id for r in out["near_dedup"]}
    pieces = Counter(r.doc_id for r in out["packing"])
    assert set(pieces) == {r.doc_id for r in out["mixing"]}
    ends = defaultdict(int)
    for r in sorted(out["packing"], key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 4096
    assert sorted(map(str, corpus_pipeline.run(spark, sf).select("doc_id", "piece", "ids_crc32").collect())) == sorted(str(r) for r in corpus_pipeline.materialize(docs, "x").select("doc_id", "piece", "ids_crc32").collect())


def test_stages_take_odd_rows(spark):
    names = ["lang", "source", "k", "found", "row", "bucket", "low", "words", "kept", "text_hash"]
    schema = "doc_id long, text string, n_chars int, " + ", ".join(f"{n} string" for n in names)
    long = " ".join(f"w{i}" for i in range(30_000))
    plain = " ".join(f"x{i}" for i in range(40))
    texts = [(1, None), (2, ""), (3, plain), (3, plain), (3, plain + " and more words"), (None, plain), (4, long), (5, "few words")]
    docs = spark.createDataFrame([(d, t, len(t) if t is not None else None, *[None if i % 2 else "s"] * len(names)) for i, (d, t) in enumerate(texts)], schema)
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, "unused")
            rows = out.collect()
            if name != "packing":
                assert out.schema.names == docs.schema.names and all(r.n_chars == len(r.text) for r in rows if r.text is not None)
            if name == "quality":
                assert sorted(str(r.doc_id) for r in rows) == (["3", "3", "3", "4", "None"] if table is docs else [])
            if name in ("line_dedup", "packing") and table is docs:
                assert len({(r.doc_id, r.text) if name == "line_dedup" else r.doc_id for r in rows}) >= 6
            if name == "near_dedup" and table is docs:
                assert sorted(str(r.doc_id) for r in rows) == ["1", "2", "3", "3", "4", "5"]
            if name == "mixing":
                assert all(r.text for r in rows)
