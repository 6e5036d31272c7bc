import hashlib
import itertools
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tracklot.llm.bilstm_crf import BiLstmCrf
from tracklot.llm.pii import KINDS, N_SYMBOLS, N_TAGS, all_spans, base_spans, find_pii, luhn, mask_pii, op7_pii, tag_texts, train, training_windows

PLAIN = {
    0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    2: r"[0-9]([\x20-]?[0-9])+",
    3: r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    ok = {0: lambda s: True, 1: lambda s: all(int(x) <= 255 for x in s.split(".")), 2: lambda s: 12 <= len(re.sub("[^0-9]", "", s)) <= 19 and luhn(re.sub("[^0-9]", "", s)), 3: lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15}
    return sorted((m.start(), k, m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if ok[k](m[0]))


@given(st.lists(st.sampled_from(["a@b.c", "@", ".", "x", "4432867513508897", "1", "255", "256", "000000300", " ", "-", "+1 (782) 555-8750", "(", "é", "\n"]), max_size=14).map("".join))
@settings(max_examples=400, deadline=None)
def test_base_equals_plain_patterns(text):
    assert base_spans(text) == brute(text)


def test_gradients():
    m = BiLstmCrf(5, 3, 4, 3)
    for k in m.p:
        m.p[k] = m.p[k].astype(np.float64)
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 5, (2, 6)), rng.integers(0, 3, (2, 6))
    _, grads = m.gradients(x, y)
    for k in m.p:
        at = tuple(rng.integers(0, s) for s in m.p[k].shape)
        old, h = m.p[k][at], 1e-3
        m.p[k][at] = old + h
        up, _ = m.gradients(x, y)
        m.p[k][at] = old - h
        down, _ = m.gradients(x, y)
        m.p[k][at] = old
        assert abs((up - down) / (2 * h) - grads[k][at]) < 2e-3


def test_held_out_spans_and_respellings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = train(docs.where("doc_id % 2 = 0"))
    held = [r.text for r in docs.where("doc_id % 2 = 1").collect() if base_spans(r.text)]
    x, y = training_windows(held, seed=11)
    assert (model.decode(x) == y).mean() > 0.95
    wanted = got = 0
    for text, seen in zip(held, tag_texts(model, held), strict=True):
        base = {s for s in base_spans(text)}
        wanted, got = wanted + len(base), got + len(base & set(seen))
    assert got >= 0.7 * wanted
    # other spellings are added; plain numbers are not
    texts = ["the onha ndthe jane.doe@mail3.example.com thed".replace("@", " [at] "), "In 1984 there were 1,234 of 50 and v1.2.3 at 12:30", "ñ" * 500]
    (_, first), (_, second), (_, third) = all_spans(model, texts)
    assert [KINDS[s[1]] for s in first] == ["email"] and second == [] and third == []


def test_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op7_pii(spark, sf).collect():
        base = brute(texts[r.doc_id] or "")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[1] == k for s in base) for k in range(4))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
        assert {f"{KINDS[k]}:{a}:{b}" for a, k, b in base} <= set(r.spans.split(","))


def test_nulls_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "mail a@b.cd now", "x"), (3, "mail a@b.cd now", "x"), (None, "+1 (782) 555-8750", "x")], "doc_id long, text string, spans string")
    rows = sorted((r.doc_id or -1, r.n_email, r.n_phone) for r in find_pii(docs).collect())
    assert rows == [(-1, 0, 1), (1, 0, 0), (2, 0, 0), (3, 1, 0), (3, 1, 0)]
    assert sorted(r.text or "" for r in mask_pii(docs).collect()) == ["", "", "<phone>", "mail <email> now", "mail <email> now"]
    assert find_pii(docs.limit(0)).count() == 0


def test_very_long_numbers_do_not_stop_the_job(spark):
    texts = ["9" * 5000 + ".1.1.1", "0" * 5000 + "7.1.1.1 end", "1" * 6000, "+" + "2" * 5000]
    assert [len(base_spans(t)) for t in texts] == [0, 1, 0, 0]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_ip for r in find_pii(docs).orderBy("doc_id").collect()] == [0, 1, 0, 0]


def test_decoding_equals_the_best_of_all_tag_paths():
    m = BiLstmCrf(5, 3, 4, 3)
    x = np.random.default_rng(2).integers(1, 5, (6, 5))
    for row, best in zip(x, m.decode(x), strict=True):
        paths = np.array(list(itertools.product(range(3), repeat=5)))
        score = lambda y: -m.gradients(np.tile(row, (1, 1)), y[None])[0]  # noqa: B023, E731
        scores = [score(y) for y in paths]
        assert np.isclose(score(best), max(scores), atol=1e-4)


def test_windows_of_a_long_text_agree_with_one_wide_window(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = train(docs)
    long = "the onha ndthe " * 3 + "averyveryverylongnameofaperson.with.many.parts.jane.doe [at] mail3.dept.example.com" + " onha thed" * 3
    short = "jane.doe [at] mail3.example.com"
    assert tag_texts(model, [short]) == [[(a, k, b) for a, k, b in tag_texts(model, [short], margin=1000)[0]]]
    # a span never ends where decoding did, unless the text does
    for text, spans in zip([long, short], tag_texts(model, [long, short], margin=4), strict=True):
        again = tag_texts(model, [text], margin=len(text))[0]
        assert all(any(abs(a - c) <= 40 for c, _, _ in again) for a, _, _ in spans)


def test_masking_keeps_rows_and_counts(spark):
    docs = spark.createDataFrame([(1, "mail a@b.cd now", 15), (2, None, None), (None, "ip 1.2.3.4", 10)], "doc_id long, text string, n_chars int")
    rows = {r.doc_id: r for r in mask_pii(docs).collect()}
    assert rows[1].text == "mail <email> now" and rows[1].n_chars == 16 and rows[2].text is None and rows[2].n_chars is None and rows[None].text == "ip <ip>"
    assert mask_pii(docs.limit(0)).count() == 0 and mask_pii(docs).schema == docs.schema
