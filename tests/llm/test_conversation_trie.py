import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tracklot.llm import conversation_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, depth int, bucket string"


def brute(rows, rebuild=True):
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(turns.get(c - c % 5, [])[:h] + own[h:]) if rebuild else tuple(own)
    members = defaultdict(list)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    digest = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if whole[c] == p).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p], digest(p)) for p, m in members.items())


def got(df):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in df.collect())


def test_against_brute_force_with_odd_rows(spark, monkeypatch):
    """Small buckets, so that conversations lie in several; ties, nulls, repeats, unknown bases, clashing columns."""
    rng = random.Random(4)
    rows = [(c, rng.choice([None, 0, 1, 1, 2, 5, 9]), rng.choice([None, "", "user", "bot"]), rng.choice([None, "", "a", "ab", "é" * 40]), 7, "x") for c in [*range(40), 10**12, 10**12 + 3, 77, 78] for _ in range(rng.choice([1, 2, 4, 9, 14]))]
    rows += [(500, i, "user", "long " * (i % 3), 7, "x") for i in range(28)] + [(501, i, "user", "x", 7, "x") for i in range(30)]
    rows += [(None, 1, "user", "nobody", 7, "x"), rows[0], rows[0]]
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(T, "BUCKET_ROWS", 25)
    monkeypatch.setattr(T, "BLOCK", 4)
    assert got(T.conversation_trie(df, T.rebuilt)) == brute(rows)
    assert got(T.conversation_trie(df)) == brute(rows, rebuild=False)


def test_empty_table_and_turnless_conversations(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert T.conversation_trie(df, T.rebuilt).count() == 0
    rows = [(c, 0, "user", "x", 1, "x") for c in (1, 2, 3, 4, 6, 7, 8, 9, 11)]  # no bases
    assert got(T.conversation_trie(spark.createDataFrame(rows, SCHEMA), T.rebuilt)) == brute(rows)


def test_totals_of_long_chains_and_hubs(spark):
    """A chain of 40 nodes, a hub of 200 leaves at its end, and a second root."""
    up = {i: i - 1 for i in range(1, 40)} | {1000 + i: 39 for i in range(200)} | {0: None, 5000: None}
    tree = spark.createDataFrame([(n, -n, p, None if p is None else -p, n % 7, 1) for n, p in up.items()], "a long, b long, pa long, pb long, v long, w long")
    want = {n: [n % 7, 1] for n in up}
    for n in sorted(up, key=lambda n: (n < 1000, -n)):
        if up[n] is not None:
            want[up[n]] = [x + y for x, y in zip(want[up[n]], want[n], strict=True)]
    assert {r.a: [r.v, r.w] for r in T.subtree_totals(tree, ["v", "w"]).collect()} == want


def test_a_key_is_of_the_whole_prefix(spark):
    rows = [(1, 0, "ab", "c", 1, "x"), (2, 0, "a", "bc", 1, "x"), (3, 0, "u", "x", 1, "x"), (3, 1, "u", "y", 1, "x"), (4, 0, "u", "y", 1, "x"), (4, 1, "u", "x", 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(T.conversation_trie(df)) == brute(rows, rebuild=False)
    assert T.turns_of(df).where(F.col("conv_id") < 3).select("da", "db").distinct().count() == 2
