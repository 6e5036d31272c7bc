import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracklot.llm import mixing
from tracklot.llm.mixing import Mixture, mix_documents, mix_taken, op10_mixing, permuted, shard_counts, targets


@given(st.integers(1, 400), st.integers(0, 2**40))
@settings(max_examples=60, deadline=None)
def test_permutation(n, key):
    assert sorted(permuted(np.arange(n), n, key).tolist()) == list(range(n))


def test_targets():
    assert targets([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75, 37.5])
    assert targets([10, 500, 0], [5, 2, 1]) == pytest.approx([30, 480, 0])
    assert targets([], []) == [] and targets([0], [5]) == [0]


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = op10_mixing(spark, sf).collect()
    size = {r.doc_id: len(re.findall("[^\x20\x09-\x0d]+", r.text or "")) for r in docs}
    source = {r.doc_id: r.source for r in docs}
    assert {r.doc_id: r["size"] for r in rows} == size
    total = Counter()
    for d, n in size.items():
        total[source[d]] += n
    order = sorted(total)
    want = dict(zip(order, targets([total[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))]), strict=True))
    taken = Counter()
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"] and r.source_size == total[source[r.doc_id]] and r.target == pytest.approx(want[source[r.doc_id]])
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 192 for s in order)
    assert sorted(map(tuple, op10_mixing(spark, sf).collect())) == sorted(map(tuple, rows))


def test_texts_agree_with_counts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counted = {r.doc_id: r.taken for r in mix_taken(docs).where("taken > 0").collect()}
    words = Counter()
    for r in mix_documents(docs).collect():
        words[r.doc_id] += len(re.findall("[^\x20\x09-\x0d]+", r.text))
        assert r.n_chars == len(r.text)
    assert words == counted


def test_shard_counts_follow_the_mixture(spark):
    docs = spark.createDataFrame([(i, "w " * 2000, "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    shards = Mixture(docs, block=2).slots.groupBy("shard", "source_id").count().collect()
    by = Counter()
    for r in shards:
        by[r.shard] += r["count"]
    assert len(by) > 5 and sorted(by.values())[1:] == [4096] * (len(by) - 1)
    assert all(abs(r["count"] / by[r.shard] - (5 / 7 if r.source_id == 0 else 2 / 7)) < 0.06 for r in shards if by[r.shard] == 4096)
    assert len({r["count"] for r in shards if r.source_id == 0}) > 3


def test_nulls_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, None, 5), (2, "", "s", 5), (3, "a b c", "s", 5), (3, "a b c", "s", 5), (None, "z", None, 5)], "doc_id long, text string, source string, size int")
    rows = sorted((r.doc_id or -1, r["size"], r.taken) for r in mix_taken(docs).collect())
    assert [r[:2] for r in rows] == [(-1, 1), (1, 0), (2, 0), (3, 3), (3, 3)] and all(t <= 3 * n for _, n, t in rows)
    assert set(mix_documents(docs).columns) == set(docs.columns)
    assert mix_taken(docs.limit(0)).count() == 0 and mix_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("drawn", [10**8, 50])
def test_shards_draw_what_the_sources_have(monkeypatch, drawn):
    monkeypatch.setattr(mixing, "DRAWN_SLOTS", drawn)
    slots, before = np.array([700, 0, 33, 5]), np.zeros(4, np.int64)
    for shard in range(-(-slots.sum() // 40)):
        first, counts = shard_counts(slots, shard, 40, 3)
        assert first.tolist() == before.tolist() and (counts >= 0).all() and counts.sum() == min(40, slots.sum() - 40 * shard)
        before += counts
    assert before.tolist() == slots.tolist()


def test_counts_of_any_size_are_drawn():
    slots = np.array([600_000_000, 400_000_000, 5])
    draws = np.array([mixing._halved(slots, 500_000_000, (s, 1)) for s in range(400)])
    assert len({tuple(d) for d in draws}) > 390 and (draws.sum(1) == 500_000_000).all() and (draws >= 0).all() and (draws <= slots).all()
    assert abs(draws[:, 0].mean() - 300_000_000) < 4 * 7746 / 20 and 0.85 < draws[:, 0].std() / 7746 < 1.15
    wide = np.array([10**15, 3, 0, 10**14])
    assert mixing._halved(wide, int(wide.sum()), (1,)).tolist() == wide.tolist()


def test_slots_take_every_block_before_any_again(spark):
    docs = spark.createDataFrame([(i, "w " * (50 + i), "abc"[i % 3]) for i in range(60)], "doc_id long, text string, source string")
    times = Counter((r.source_id, r.block) for r in Mixture(docs, block=4).slots.collect())
    for s in range(3):
        own = [n for (i, _), n in times.items() if i == s]
        assert max(own) - min(own) <= 1 or max(own) == 1
