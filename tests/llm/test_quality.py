import math
import re
from collections import Counter, defaultdict

import numpy as np

from tracklot.llm import quality
from tracklot.llm.quality import COMMON_SHARE, common_form, js_distance, keep_good, op8_quality, references, repeated_words, score_quality


def brute(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(windows)
    hit = set()
    for i, w in enumerate(windows):
        if many[w] > 1:
            hit |= set(range(i, i + 5))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit), failed


def test_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op8_quality(spark, sf).collect()
    assert {r.doc_id: tuple(r)[1:7] for r in rows} == {d: brute(t) for d, t in texts.items()}
    assert not any(r.kept and r.base_failed for r in rows)


def test_labelled_documents(spark):
    d = "/root/testdata/sf0.01"
    rows = op8_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed").collect()
    assert np.mean([r.kept for r in rows if r.quality == 1]) >= 0.99
    assert np.mean([not r.kept for r in rows if r.quality == 0]) >= 0.9


def test_references_count_every_document(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    refs = references(docs)
    for lang in ("en", "de"):
        words = [common_form(w) for r in docs.where(docs.lang == lang).collect() for w in (r.text or "").encode().split()]
        if len(words) >= quality.MIN_REFERENCE_WORDS:
            want = {w: n for w, n in Counter(words).items() if w and n >= COMMON_SHARE * len(words)}
            assert set(refs[lang]["index"]) == set(want)
            assert all(abs(refs[lang]["words"][i] - want[w] / len(words)) < 1e-12 for w, i in refs[lang]["index"].items())


def test_distance():
    q = np.array([0.5, 0.5, 0])
    assert js_distance(np.array([[2, 2, 0], [0, 0, 3], [0, 0, 0]]), q).round(6).tolist() == [0, 1, 0]


def test_repeated_words_overlap():
    assert repeated_words(b"a b c d e a b c d e".split()) == 10
    assert repeated_words(b"a a a a a a".split()) == 6 and repeated_words(b"a b c d".split()) == 0


def test_nulls_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, None, 1), (2, "", "en", 1), (3, "one two three four five six seven eight nine ten", None, 1), (3, "one two three four five six seven eight nine ten", None, 1), (None, "x", "xx", 1)], "doc_id long, text string, lang string, kept int")
    assert sorted((r.doc_id or -1, r.kept) for r in score_quality(docs).collect()) == [(-1, False), (1, False), (2, False), (3, True), (3, True)]
    good = keep_good(docs)
    assert good.columns == docs.columns and good.count() == 2
    assert score_quality(docs.limit(0)).count() == 0


def plain_distance(p, q):
    total = sum(p)
    if not total:
        return 0.0
    p = [x / total for x in p]
    kl = lambda a, m: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
    m = [(x + y) / 2 for x, y in zip(p, q)]
    return math.sqrt(max(0.0, (kl(p, m) + kl(q, m)) / 2))


def brute_verdicts(rows):
    """Distances from references of whole languages, all in plain Python: (doc_id, text, lang) to kept."""
    table = quality._class_table()
    classes = lambda t: [Counter(table[min(ord(c), 65_536)] for c in t)[k] for k in range(len(quality.CLASSES))]
    words, chars = defaultdict(Counter), defaultdict(lambda: [0] * len(quality.CLASSES))
    for _, text, lang in rows:
        words[lang or ""].update(common_form(w) for w in (text or "").encode().split())
        chars[lang or ""] = [a + b for a, b in zip(chars[lang or ""], classes(text or ""))]
    out = []
    for d, text, lang in rows:
        n, failed = len((text or "").encode().split()), brute(text)[5]
        total = sum(words[lang or ""].values())
        odd = False
        if total >= quality.MIN_REFERENCE_WORDS and n >= quality.MIN_WORDS:
            common = [w for w, c in words[lang or ""].items() if w and c >= COMMON_SHARE * total]
            ref = [words[lang or ""][w] / total for w in common]
            own = Counter(common_form(w) for w in text.encode().split())
            mine = [own[w] for w in common]
            by_char = plain_distance(classes(text), [c / sum(chars[lang or ""]) for c in chars[lang or ""]])
            by_word = plain_distance([*mine, n - sum(mine)], [*ref, 1 - sum(ref)])
            odd = by_char > quality.MAX_CHAR_DISTANCE or by_word > quality.MAX_WORD_DISTANCE
        out.append((d, not failed and not odd))
    return sorted(out, key=str)


def test_verdicts_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted(((r.doc_id, r.kept) for r in score_quality(docs).collect()), key=str)
    want = brute_verdicts([(r.doc_id, r.text, r.lang) for r in docs.collect()])
    assert got == want and 0.02 < np.mean([not k for _, k in want]) < 0.5


def test_words_that_look_like_class_numbers_are_words(spark):
    docs = spark.createDataFrame([(i, "#1 apple #1 pear " * 400 + f"word{i} " * 3, "en") for i in range(8)], "doc_id long, text string, lang string")
    ref = references(docs)["en"]
    assert set(ref["index"]) == {b"#1", b"apple", b"pear"} and abs(ref["words"][ref["index"][b"#1"]] - 800 / 1603) < 1e-9
    assert abs(ref["classes"].sum() - 1) < 1e-9 and abs(ref["classes"][quality.CLASSES.index("symbol")] - 800 / len(docs.first().text)) < 1e-9


def test_rare_languages_meet_the_base_rules_only(spark):
    rows = [(i, " ".join(f"en{(i * 7 + j) % 40}" for j in range(300)), "en") for i in range(40)] + [(100, " ".join(f"xx{j}" for j in range(80)), "xx"), (101, " ".join(f"xx{j}" for j in range(80)), None)]
    got = {r.doc_id: r for r in score_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[100].kept and got[101].kept and got[100].word_distance is None and got[0].word_distance is not None
    assert set(references(spark.createDataFrame(rows, "doc_id long, text string, lang string"))) == {"en"}
