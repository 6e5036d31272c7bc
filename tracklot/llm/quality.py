"""Quality rules: distribution divergence from language references.

A document's histogram of character classes and of its language's common words is compared with the same histograms
of the whole language by Jensen-Shannon distance. References cover every document: character classes add up; common
words (a share of ``COMMON_SHARE`` of the language's words or more) are found in two passes. The first keeps, of
every slice, words that reach half that share there; a word with the full share overall must have half of its mass in
such slices, so at most ``2 / COMMON_SHARE`` candidates a language are left, and the second pass counts those exactly.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklot.llm.common import kept, strings, table, text_slices

COMMON_SHARE = 0.004
#: Histograms of fewer words say little; such documents meet the base rules only.
MIN_WORDS = 50
#: A language with fewer words has no reference, and no foreign one is taken; its documents meet the base rules only.
MIN_REFERENCE_WORDS = 10_000
MAX_CHAR_DISTANCE = 0.28
MAX_WORD_DISTANCE = 0.42
BASE_MIN_WORDS, BASE_REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
CLASSES = ("lower", "upper", "digit", "space", "stop", "mark", "symbol", "other")
_EDGES = b".,;:!?\"'()"
SCORES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"


@cache
def _class_table() -> np.ndarray:
    """Class of each code point of the basic plane; the last entry is for all others."""
    kinds = np.full(65_537, CLASSES.index("other"), np.uint8)
    for c in range(65_536):
        ch, cat = chr(c), unicodedata.category(chr(c))
        name = "lower" if cat in ("Ll", "Lo", "Lm", "Mn", "Mc") else "upper" if cat in ("Lu", "Lt") else "digit" if cat[0] == "N" else "space" if ch in SPACES or cat == "Zs" else "stop" if ch in ".,;:'\"-" else "symbol" if ch in SYMBOLS or cat[0] == "S" else "mark" if cat[0] == "P" else "other"
        kinds[c] = CLASSES.index(name)
    return kinds


def char_histograms(texts: list[str]) -> np.ndarray:
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    kinds = _class_table()[np.minimum(codes, 65_536)]
    owner = np.repeat(np.arange(len(texts)) * len(CLASSES), [len(t) for t in texts])
    return np.bincount(owner + kinds, minlength=len(texts) * len(CLASSES)).reshape(len(texts), len(CLASSES))


def common_form(word: bytes) -> bytes:
    return word.lower().strip(_EDGES)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of counts p to the distribution q; 0 for an empty row."""
    total = p.sum(axis=1, keepdims=True)
    p = p / np.maximum(total, 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = lambda a: np.where(a > 0, a * np.log2(a / m), 0).sum(axis=1)
        return np.where(total[:, 0] > 0, np.sqrt(np.maximum(0, (kl(p) + kl(np.broadcast_to(q, p.shape))) / 2)), 0)


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words that lie in a window of ``size`` words found twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = h[:n].copy()
    for i in range(1, size):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[i : n + i]
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    delta = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(delta, at, 1)
    np.add.at(delta, at + size, -1)
    return int((np.cumsum(delta)[:-1] > 0).sum())


#: Kinds of counts: all words of a language, its characters of a class, a word.
TOTAL, CLASS, WORD = 0, 1, 2
COUNTS = "lang string, kind int, class int, word binary, n long"


def _counted(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[f.split()[0] for f in COUNTS.split(", ")])


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str]]]:
    """The texts of each language in a slice of a batch; a null language is the empty one."""
    langs = strings(batch.column("lang"))
    for low, high, texts in text_slices(batch):
        own: dict[str, list[str]] = {}
        for lang, text in zip(langs[low:high], texts, strict=True):
            own.setdefault(lang, []).append(text)
        yield from own.items()


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slice and language: the number of words, counts of character classes, frequent words."""
    kept("quality", _class_table)
    for batch in batches:
        for lang, texts in _by_language(batch):
            count = Counter(map(common_form, "\n".join(texts).encode().split()))
            total = sum(count.values())
            rows = [(lang, TOTAL, None, None, total)]
            rows += [(lang, CLASS, k, None, int(c)) for k, c in enumerate(char_histograms(texts).sum(axis=0))]
            yield _counted(rows + [(lang, WORD, None, w, c) for w, c in count.items() if w and c >= total * COMMON_SHARE / 2])


def _second_pass(batches: Iterator[pa.RecordBatch], wanted: dict[str, set[bytes]]) -> Iterator[pa.RecordBatch]:
    """Exact counts of the candidates."""
    for batch in batches:
        for lang, texts in _by_language(batch):
            if candidates := wanted.get(lang):
                count = Counter(filter(candidates.__contains__, map(common_form, "\n".join(texts).encode().split())))
                yield _counted([(lang, WORD, None, w, n) for w, n in count.items()])


def references(docs: DataFrame) -> dict[str, dict]:
    """Class distribution and common-word distribution (the last entry: all other words) of each language with words enough.

    The driver gets, per such language, a few class counts and at most ``2 / COMMON_SHARE`` words.
    """
    rows = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    first = rows.mapInArrow(_first_pass, COUNTS).groupBy("lang", "kind", "class", "word").agg(F.sum("n").alias("n"))
    first = first.withColumn("total", F.max(F.when(F.col("kind") == TOTAL, F.col("n"))).over(Window.partitionBy("lang")))
    first = first.where((F.col("total") >= MIN_REFERENCE_WORDS) & ((F.col("kind") != WORD) | (F.col("n") >= F.col("total") * COMMON_SHARE / 2)))
    found: dict[str, dict] = {}
    for r in first.collect():
        own = found.setdefault(r["lang"], {"total": r["total"], "classes": np.zeros(len(CLASSES)), "candidates": set()})
        if r["kind"] == CLASS:
            own["classes"][r["class"]] = r["n"]
        elif r["kind"] == WORD:
            own["candidates"].add(bytes(r["word"]))
    wanted = docs.sparkSession.sparkContext.broadcast({k: v["candidates"] for k, v in found.items()})
    second = rows.mapInArrow(lambda b: _second_pass(b, wanted.value), COUNTS).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    exact: dict[str, dict[bytes, int]] = {}
    for r in second.collect():
        exact.setdefault(r["lang"], {})[bytes(r["word"])] = r["n"]
    out = {}
    for lang, own in found.items():
        common = {w: n for w, n in sorted(exact.get(lang, {}).items()) if n >= own["total"] * COMMON_SHARE}
        counts = np.array([*common.values(), own["total"] - sum(common.values())], float)
        out[lang] = {"classes": own["classes"] / max(1, own["classes"].sum()), "index": {w: i for i, w in enumerate(common)}, "words": counts / counts.sum()}
    return out


def word_histogram(words: list[bytes], reference: dict) -> np.ndarray:
    at = [i for i in map(reference["index"].get, words) if i is not None]
    counts = np.bincount(np.array(at, np.int64), minlength=len(reference["words"]))
    counts[-1] = len(words) - len(at)
    return counts


def _score(batches: Iterator[pa.RecordBatch], refs: dict[str, dict]) -> Iterator[pa.RecordBatch]:
    kept("quality", _class_table)
    for batch in batches:
        ids, langs = batch.column("doc_id").to_pylist(), strings(batch.column("lang"))
        for low, high, texts in text_slices(batch):
            chars = char_histograms(texts)
            out: list[tuple] = []
            for k, t in enumerate(texts):
                words = t.encode().split()
                n = len(words)
                word_chars = len(t) - sum(map(t.count, SPACES))
                symbols = sum(map(t.count, SYMBOLS))
                lines = [x for x in t.split("\n") if x.strip(SPACES)]
                repeats = repeated_words(words)
                failed = n < BASE_MIN_WORDS or 100 * repeats > BASE_REPEAT_PERCENT * n
                by_char = by_word = None
                if own := refs.get(langs[low + k]):
                    by_char = float(js_distance(chars[k : k + 1], own["classes"])[0])
                    by_word = float(js_distance(word_histogram(list(map(common_form, words)), own)[None, :], own["words"])[0])
                odd = n >= MIN_WORDS and by_char is not None and (by_char > MAX_CHAR_DISTANCE or by_word > MAX_WORD_DISTANCE)
                out.append((ids[low + k], n, word_chars, symbols, len(lines) - len(set(lines)), repeats, failed, not failed and not odd, by_char, by_word))
            names = [f.split()[0] for f in SCORES.split(", ")]
            kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()] * 2
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def score_quality(docs: DataFrame) -> DataFrame:
    """Measures, base rules and verdict per document (doc_id, text, lang; other columns are ignored).

    A null text is empty and fails the base rules; null is a language like any other. In a language of fewer than
    ``MIN_REFERENCE_WORDS`` words, and in texts of fewer than ``MIN_WORDS``, only the base rules decide, and the distances
    of the first are null. Repeated rows are scored each; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(references(docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    return rows.mapInArrow(lambda b: _score(b, shared.value), SCORES)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their columns as they were, whatever their names; see ``score_quality`` for odd rows."""
    shared = docs.sparkSession.sparkContext.broadcast(references(docs))
    schema = docs.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {"doc_id": pa.array(np.arange(batch.num_rows)), "text": batch.column("text"), "lang": batch.column("lang")}
            for scored in _score(iter([pa.record_batch(columns)]), shared.value):
                yield batch.take(scored.column("doc_id").filter(scored.column("kept")))

    return docs.mapInArrow(keep, schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"))
