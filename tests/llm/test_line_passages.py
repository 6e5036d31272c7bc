import pytest
from pyspark.sql import functions as F

from tests.llm.test_line_dedup import brute
from tracklot.llm import line_dedup
from tracklot.llm.line_dedup import dedup_lines, op3_line_dedup


def test_whole_table_by_passages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    want = brute(rows)
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in dedup_lines(docs).collect()} == want
    assert {r.doc_id: (r.n_removed, r.text) for r in op3_line_dedup(spark, sf).collect()} == {d: w[1:] for d, w in want.items()}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6])
def test_passage_goes_whole_between_unlike_neighbours(spark, n):
    words = iter(range(10_000))
    texts = {}
    for kind in range(12):  # 51 to 60 words each, one line or n sentences
        passage = " ".join(" ".join(f"w{next(words)}" for _ in range(-(-51 // n))) + "." for _ in range(n))
        for copy in range(3):
            texts[kind * 3 + copy] = (f"Before {kind} {copy}.\n", passage, f"\nAfter {kind} {copy}.")
    docs = spark.createDataFrame([(d, "".join(t)) for d, t in texts.items()], "doc_id long, text string")
    for r in dedup_lines(docs).collect():
        before, passage, after = texts[r.doc_id]
        assert (r.n_removed, r.text) == ((0, before + passage + after) if r.doc_id % 3 == 0 else (n, before + after.lstrip()))


def words(name, n):
    return " ".join(f"{name}{j}" for j in range(n)) + ".\n"


def left(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in dedup_lines(docs).orderBy("doc_id").collect()]


def test_lines_that_met_only_piecemeal_stay(spark):
    a, b, c, d = (words(x, 15) for x in "abcd")  # each pair was there before, 60 words in a row never were
    texts = [a + b + words("p", 9), words("q", 9) + b + c + words("r", 9), words("s", 9) + c + d, words("t", 9) + a + b + c + d + words("u", 9)]
    assert left(spark, texts) == texts
    again = [*texts, words("v", 9) + a + b + c + d + words("w", 9)]
    assert left(spark, again) == [*texts, words("v", 9) + words("w", 9)]


def test_what_is_new_beside_a_repeated_passage_stays(spark):
    a, b, c = (words(x, 26) for x in "abc")
    texts = [a + b, b + words("x", 12) + c, words("y", 12) + a + b + c]
    assert left(spark, texts) == [a + b, b + words("x", 12) + c, words("y", 12) + c]


def test_uneven_lines_and_blank_ones_go_with_their_passage(spark):
    passage = words("long", 60) + "\n\n" + words("end", 3)
    assert left(spark, [words("a", 9) + passage + words("b", 9), words("c", 9) + passage + words("d", 9)])[1] == words("c", 9) + words("d", 9)
    assert left(spark, [words("a", 9) + words("short", 2) + words("long", 60) + words("b", 9), words("short", 2) + words("long", 60)])[1] == ""
    assert left(spark, ["\n" * 200 + "One.", "\n" * 200 + "Two."]) == ["\n" * 200 + "One.", "\n" * 200 + "Two."]
    assert left(spark, ["a  b\tc " * 30 + "\n"] * 2 + ["字" * 399 + "\nx", "y\n" + "字" * 399]) == ["a  b\tc " * 30 + "\n", "", "字" * 399 + "\nx", "y\n" + "字" * 399]


def test_different_lines_under_one_line_hash_stay(spark, monkeypatch):
    real = line_dedup._with_lines
    monkeypatch.setattr(line_dedup, "_with_lines", lambda d, t: real(d, t).withColumn("h", F.expr("transform(c, u -> 7L)")))
    texts = ["".join(words(f"l{i}x{j}", 12) for j in range(9)) for i in range(3)]
    assert left(spark, texts) == texts


def test_short_pairs_stay(spark):
    docs = spark.createDataFrame([(i, f"Own {i} one.\nHello there.\nGood day.\nOwn {i} two.\n") for i in range(2)], "doc_id long, text string")
    assert {r.n_removed for r in dedup_lines(docs).collect()} <= {0, 2}
    one = spark.createDataFrame([(i, f"Own {i}.\n" + "word " * 30 + f"\nEnd {i}.") for i in range(2)], "doc_id long, text string")
    assert sum(r.n_removed for r in dedup_lines(one).collect()) == 0


def test_unequal_spans_under_one_hash_stay(spark, monkeypatch):
    real = line_dedup._spots
    monkeypatch.setattr(line_dedup, "_spots", lambda d: real(d).withColumn("hash", F.lit(1).cast("long")))
    docs = spark.createDataFrame([(i, "".join(f"line {i} {j} with some more words in it so that a run is long\n" for j in range(9))) for i in range(3)], "doc_id long, text string")
    assert sum(r.n_removed for r in dedup_lines(docs).collect()) == 0
