import hashlib

from tracklot.llm.common import order_bounds, with_order_bucket
from tracklot.llm.fingerprints import fingerprints, op6_fingerprints


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    rows = {r.doc_id: r for r in op6_fingerprints(spark, sf).collect()}
    assert len(rows) == len(docs)
    better = 0
    for i, (d, text) in enumerate(docs):
        n = len(text) // 2
        edited = text[: len(text) - n] + docs[(i + 1) % len(docs)][1][:n]
        r = rows[d]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        better += r.near_edited > r.near_next
    assert better >= 0.96 * len(docs)


def brute(text):
    import struct

    import xxhash

    signed = lambda x: x - 2**64 if x >= 2**63 else x
    longs = lambda xs: __import__("functools").reduce(lambda seed, x: xxhash.xxh64(struct.pack("<q", x), seed=seed).intdigest(), xs, 42)
    h = [signed(xxhash.xxh64(w, seed=42).intdigest()) for w in text.encode().split()]
    g = [signed(longs(p)) for p in zip(h, h[1:])]
    cut = lambda x: x & (2**37 - 1)
    out = [(cut(longs(g[i : i + 5 : 2])), i) for i in range(len(g) - 4) if min(g[i : i + 5]) in (g[i], g[i + 4])]
    return out or ([(cut(longs(h)), 0)] if h else [])


def brute_likeness(a, b):
    a, b = ({x: p for x, p in reversed(own)} for own in (a, b))
    shifts = sorted(a[x] - b[x] for x in a if x in b)
    return sum(abs(s - shifts[len(shifts) // 2]) <= 16 for s in shifts) / len({*a, *b}) if a or b else 1.0


def test_closed_syncmers_and_likeness_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    rows = {r.doc_id: r for r in op6_fingerprints(spark, sf).collect()}
    own = [brute(t) for _, t in docs]
    for i, (d, text) in enumerate(docs):
        n, after = len(text) // 2, (i + 1) % len(docs)
        changed = brute(text[: len(text) - n] + docs[after][1][:n])
        assert rows[d].fingerprint == ",".join(f"{x:x}:{p}" for x, p in own[i])
        assert rows[d].edited_fingerprint == ",".join(f"{x:x}:{p}" for x, p in changed)
        assert abs(rows[d].near_edited - brute_likeness(own[i], changed)) < 1e-12 and abs(rows[d].near_next - brute_likeness(own[i], own[after])) < 1e-12


def test_equal_passages_choose_equal_anchors():
    passage = " ".join(f"p{i}" for i in range(400))
    inner = {x for x, p in brute(passage)}
    assert inner <= {x for x, _ in brute("one two three " * 9 + passage + " end " * 20)} and 0.3 * 400 < len(inner) < 0.5 * 400


def test_order_over_buckets_nulls_and_repeats(spark):
    words = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    docs = spark.createDataFrame([(i * 7, words(i), 1) for i in range(30)] + [(None, words(99), 1), (7, None, 1), (210, words(29), 1)], "doc_id long, text string, bucket int").repartition(3)
    rows = fingerprints(docs, rows_per_bucket=4).collect()
    key = lambda r: (r.doc_id or -1, r.n_chars, r.edited_sha256, r.near_next)
    assert sorted(map(key, rows)) == sorted(map(key, fingerprints(docs).collect()))
    assert len(rows) == 33
    by = {r.doc_id: r for r in rows if r.doc_id != 7}
    n = by[14].n_chars // 2
    assert by[14].edited_sha256 == hashlib.sha256((words(2)[: len(words(2)) - n] + words(3)[:n]).encode()).hexdigest()
    assert by[203].near_next == 1.0 and by[203].fingerprint == by[210].fingerprint
    n = by[210].n_chars // 2
    assert by[210].edited_sha256 == hashlib.sha256((words(29)[: len(words(29)) - n] + words(99)[:n]).encode()).hexdigest()
    empty = [r for r in rows if r.doc_id == 7 and r.n_chars == 0][0]
    assert empty.fingerprint == "" and empty.near_edited == 1.0
    assert fingerprints(docs.limit(0)).count() == 0


def test_buckets_are_even_for_ids_in_clusters(spark):
    from collections import Counter

    ids = [None] * 5 + [i for s in range(4) for i in range(s * 10**12, s * 10**12 + 500)] + [2**62]
    df = spark.createDataFrame([(i, j) for j, i in enumerate(ids)], "doc_id long, h long").repartition(5)
    bounds = order_bounds(df, ["doc_id", "h"], 40)
    rows = with_order_bucket(df, ["doc_id", "h"], bounds).collect()
    by = Counter(r.bucket for r in rows)
    assert sum(by.values()) == len(ids) and max(by.values()) <= 40 and sum(r.opens for r in rows) == len(bounds) == len(by)
    order = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    assert [r.bucket for r in order] == sorted(r.bucket for r in order)
