import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tracklot.llm.packing import op5_packing, pack_documents, plan_packing
from tracklot.llm.tokens import WORD_BPE


def laid_out(plan):
    ranks, sequences = defaultdict(set), defaultdict(list)
    for n, first, k, sequence, offset in plan:
        for i in range(k):
            assert first + i not in ranks[n]
            ranks[n].add(first + i)
            sequences[sequence + i].append((offset, n))
    return ranks, sequences


def test_plan_places_every_piece_without_gaps():
    rng = random.Random(5)
    for _ in range(40):
        capacity = rng.choice([10, 64, 100])
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 300)))
        ranks, sequences = laid_out(plan_packing(dict(counts), capacity))
        assert {n: len(r) for n, r in ranks.items()} == dict(counts)
        assert all(r == set(range(len(r))) for r in ranks.values())
        for pieces in sequences.values():
            end = 0
            for offset, n in sorted(pieces):
                assert offset == end
                end += n
            assert end <= capacity
        assert len(sequences) <= 1 + 1.15 * -(-sum(n * c for n, c in counts.items()) // capacity) + sum(c for n, c in counts.items() if n > capacity // 2) * 0.4


def test_exact_fills_come_first():
    _, sequences = laid_out(plan_packing({10: 2, 7: 3, 3: 3, 5: 1, 4: 1, 1: 1}, 10))
    assert len(sequences) == 6


def test_against_brute_force(spark, sf):
    tok = Tokenizer.from_file(public_tokenizers.path(WORD_BPE))
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, a in enumerate(range(0, len(ids), 4096)):
            want[r.doc_id, k] = (a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes()))
    rows = op5_packing(spark, sf).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for pieces in at.values():
        end = 0
        for offset, n in sorted(pieces):
            assert offset == end
            end += n
        assert end <= 4096
    assert len(at) <= -(-sum(w[1] for w in want.values()) // 4096) + 1


def test_null_empty_repeated(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "", "x"), (None, "a b c", "x")], "doc_id long, text string, length string")
    rows = pack_documents(docs).collect()
    assert sorted(r.length for r in rows) == [1, 1, 1, 4] and len({r.sequence_id for r in rows}) == 1
    assert pack_documents(docs.limit(0)).count() == 0
