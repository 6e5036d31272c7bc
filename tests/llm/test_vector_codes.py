import hashlib
import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hn

from tracklot.llm import vector_codes
from tracklot.llm.vector_codes import ENTRIES, PartCodes, encode_parts, fit_part_codes, integer_vectors, nearest, op12_vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code int, bucket string"


def brute(rows):
    """(vec_id, code, error, label_error, codebooks) in plain integers, for rows of one length."""
    good = [(r[0], r[2], [math.floor(1024 * float(np.float32(x))) for x in r[1]]) for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not good:
        return []
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = len(good[0][2]) // 4
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, _, v in good[:256]] for p in range(4)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda v, p: min((dist(cut(v, p), e), i) for i, e in enumerate(books[p]))
    for _ in range(4):
        for p in range(4):
            own: dict = {}
            for _, _, v in good:
                own.setdefault(best(v, p)[1], []).append(cut(v, p))
            for i, parts in own.items():
                books[p][i] = [sum(c) // len(parts) for c in zip(*parts, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    coded = [(i, label, [best(v, p) for p in range(4)]) for i, label, v in good]
    total: dict = {}
    for _, label, b in coded:
        total[label] = total.get(label, 0) + sum(d for d, _ in b)
    return [(i, "".join(f"{e:02x}" for _, e in b), sum(d for d, _ in b), total[label], digest) for i, label, b in coded]


def run(spark, rows, tmp):
    path = f"{tmp}/x"
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/embeddings.parquet")
    return [tuple(r) for r in op12_vector_codes(spark, path).collect()]


def same(a, b):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(a, key=key) == sorted(b, key=key)


def test_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(size=8)], int(rng.integers(3)) if i % 7 else None, 1, "x") for i in rng.permutation(330)]
    rows += [(400, None, 1, 1, "x"), (401, [1.0, None] * 4, 1, 1, "x"), (402, [math.nan] * 8, 1, 1, "x"), (403, [math.inf] * 8, 1, 1, "x")]
    rows += [rows[0], rows[0], (None, [0.5] * 8, None, 1, "x"), (None, [0.25] * 8, 2, 1, "x")]
    same(run(spark, rows, tmp_path), brute(rows))


def test_few_rows_ties_and_large_numbers(spark, tmp_path):
    rows = [(3, [0.0] * 4, 1, 1, "x"), (1, [0.0] * 4, 1, 1, "x"), (2, [1.0, -1.0, 0.0009, -0.0009], None, 1, "x"), (9, [700_000.0, 0.0, 0.0, 1.0], None, 1, "x")]
    same(run(spark, rows, tmp_path), brute(rows))


def test_empty_table_and_other_lengths(spark, tmp_path):
    assert run(spark, [], tmp_path / "a") == []
    assert run(spark, [(1, None, 1, 1, "x")], tmp_path / "b") == []
    rows = [(0, [], 1, 1, "x"), (1, [1.0] * 4, 1, 1, "x"), (2, [1.0] * 8, 2, 1, "x"), (3, [2.0] * 4, 1, 1, "x")]
    got = {r[0]: r[1:4] for r in run(spark, rows, tmp_path / "c")}
    assert got == {0: (None, None, 0), 1: ("00000000", 0, 0), 2: (None, None, 0), 3: ("01010101", 0, 0)}


def test_extra_columns_stay(spark):
    df = integer_vectors(spark.createDataFrame([(1, [1.0] * 4, 1, 7, "b")], SCHEMA))
    assert [tuple(r) for r in encode_parts(*fit_part_codes(df)).select("vec_id", "bucket", "code", "error").collect()] == [(1, "b", "00000000", 0)]


@given(hn.arrays(np.int64, (40, 3), elements=st.integers(-4, 4) | st.integers(-2000, 2000)), st.integers(1, 30))
@settings(max_examples=150, deadline=None)
def test_bounds_lose_nothing(x, k):
    books = PartCodes(np.repeat(x[:k], 4, axis=1))
    entries, pivots = books.entries[1], books.pivots[1]
    x = np.repeat(x, 4, axis=1)[:, books.width : 2 * books.width]
    code, error, _ = nearest(x, PartCodes.distances(x, pivots).astype(np.float32).astype(float), entries, books.to_pivots[1])
    d = ((x[:, None] - entries[None]) ** 2).sum(-1)
    assert code.tolist() == d.argmin(1).tolist() and error.tolist() == d.min(1).tolist()


def test_bounds_prune():
    rng = np.random.default_rng(1)
    middle = rng.integers(-1000, 1000, (ENTRIES, 16))
    books = PartCodes(middle)
    x = middle[rng.integers(0, ENTRIES, 400)] + rng.integers(-20, 20, (400, 16))
    done = 0
    for p in range(vector_codes.PARTS):
        part = books.part(x, p)
        done += nearest(part, PartCodes.distances(part, books.pivots[p]), books.entries[p], books.to_pivots[p])[2]
    assert done < 0.1 * vector_codes.PARTS * len(x) * ENTRIES
