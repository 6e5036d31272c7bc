import random
import re
from collections import defaultdict

import numpy as np

from tracklot.llm import near_dups
from tracklot.llm.components import connected_components
from tracklot.llm.near_dups import MAX_DISTANCE, SLOTS, drop_near_duplicates, index_keys, linked, near_duplicates, op4_near_duplicates, signature


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """Components over all linked pairs, candidates from an index of shingles."""
    sets = {d: shingles(t) for d, t in rows}
    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            parent[d] = parent[parent[d]]
            d = parent[d]
        return d

    for d, s in sets.items():
        both = defaultdict(int)
        for x in s:
            for e in where[x]:
                if e > d:
                    both[e] += 1
        for e, n in both.items():
            if 100 * n >= 75 * (len(s) + len(sets[e]) - n):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


def got(df):
    return {r.doc_id: tuple(r)[1:] for r in df.collect()}


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(op4_near_duplicates(spark, sf)) == brute(rows)


def test_pigeonhole_guarantee():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = rng.integers(0, 2**16, SLOTS).astype(np.uint16)
        b = a.copy()
        at = rng.choice(SLOTS, MAX_DISTANCE, replace=False)
        b[at] ^= rng.integers(1, 2**16, MAX_DISTANCE).astype(np.uint16)
        assert np.intersect1d(*index_keys(np.stack([a, b]))).size


def edited(rng, words, share):
    return " ".join(f"new{rng.random()}" if rng.random() < share else w for w in words)


def test_large_groups_keep_every_link(spark, monkeypatch):
    # blocks and buckets small enough that both late paths run
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = [(i, edited(rng, base, rng.choice([0.0, 0.01, 0.03, 0.06]))) for i in range(260)] + [(300 + i, "same text of a few words here") for i in range(40)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(near_duplicates(docs)) == brute(rows)
    monkeypatch.setattr(near_dups, "SMALL_BUCKET", 10_000)
    assert got(near_duplicates(docs)) == brute(rows)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 102), (102, 101)], "a long, b long")
    labels = {r.node: r.component for r in connected_components(edges).collect()}
    assert labels == {i: 0 for i in range(51)} | {100: 100, 101: 100, 102: 100}


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(5, None, 1), (4, "", 1), (3, " \n", 1), (9, "A b C", 1), (7, "a B c", 1), (7, "a B c", 1), (None, "a b c", 1), (None, "alone", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    out = sorted(((r.doc_id or -1), r.n_shingles, r.component_id or -1, r.kept) for r in near_duplicates(docs).collect())
    assert out == [(-1, 1, -1, True), (-1, 1, 7, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (7, 1, 7, True), (7, 1, 7, True), (9, 1, 7, False)]
    assert near_duplicates(docs.limit(0)).count() == 0
    assert drop_near_duplicates(docs).columns == docs.columns


def test_sql_gives_the_same_rows(spark, sf):
    import duckdb

    from tracklot.llm.queries import oracle_sql

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rows = con.sql(oracle_sql()["op4_near_duplicates"]).fetchall()
    assert {r[0]: tuple(r[1:]) for r in rows} == got(op4_near_duplicates(spark, sf))


def test_repeated_ids_with_other_texts_lose_no_link(spark):
    a = " ".join(f"a{i}" for i in range(60))
    b = " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (5, b + " more"), (6, a + " more")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        assert sorted(tuple(r)[:1] + tuple(r)[2:] for r in near_duplicates(docs).collect()) == [(1, 1, True), (1, 1, True), (5, 1, False), (6, 1, False)]
        assert sorted(r.text for r in drop_near_duplicates(docs).collect()) == [a, b]


def test_null_ids_are_linked_and_one_text_stays(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(7, a, 1), (None, a, 1), (9, a, 1), (None, a + " more", 1), (None, b, 1), (None, b + " more", 1), (None, "", 1), (None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone_id int")
    assert sorted((str(r.component_id), r.kept) for r in near_duplicates(docs).collect()) == [("7", False)] * 3 + [("7", True)] + [("None", False)] + [("None", True)] * 3
    left = drop_near_duplicates(docs).collect()
    assert [r.doc_id for r in left if (r.text or "").startswith("a")] == [7] and sum((r.text or "").startswith("b") for r in left) == 1 and len(left) == 4


def test_links_just_at_the_limit_are_found():
    # 240 shingles each, 206 shared: 100 * 206 >= 75 * 274 holds, 205 would not
    rng, missed = np.random.default_rng(11), 0
    for _ in range(3000):
        x = rng.integers(0, 2**63, 275).astype(np.uint64)
        one, two = np.sort(x[:240]), np.sort(np.append(x[:206], x[240:274]))
        assert linked(one, two) and not linked(one, np.sort(np.append(x[:205], x[240:])))
        missed += not np.intersect1d(*index_keys(np.stack([signature(one), signature(two)]))).size
    assert missed <= 2
