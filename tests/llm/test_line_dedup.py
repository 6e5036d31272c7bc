import re
import struct
from functools import reduce

import xxhash

from tracklot.llm.line_dedup import dedup_lines


def h64(data, seed=42):
    return xxhash.xxh64(data, seed=seed).intdigest()


def longs(xs):
    return reduce(lambda seed, x: h64(struct.pack("<Q", x), seed), xs, 42)


def lines_of(text):
    return [x for x in re.split(r"(?<=\n)|(?<=[.!?] )", text) if x]


def contents_of(lines):
    return [re.sub(r"(?<=[.!?]) \Z|\n\Z", "", x) for x in lines]


def chunks_of(bare):
    h = [h64(x.encode()) for x in bare]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    r = [None, *(signed(longs(p)) for p in zip(h, h[1:]))]
    cuts = [i for i in range(len(h) + 1) if i in (0, len(h)) or 2 <= i <= len(h) - 2 and r[i] < min(r[i - 1], r[i + 1])]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:]) if b - a > 1]


def weight(line):
    return max(8 * len([w for w in re.split("[ \t]+", line) if w]), len(line))


def spans_of(bare):
    """Chunks by their first line and number of lines: between boundaries, or the fewest lines of 400 from each line on and up to it."""
    out, w = set(), [weight(x) for x in bare]
    for i in range(len(w)):
        for step in (1, -1):
            total, j = w[i], i
            while total < 400 and 0 <= j + step < len(w):
                j += step
                total += w[j]
            if total >= 400:
                out.add((min(i, j), abs(i - j) + 1))
    return out | {(a, m) for a, m in chunks_of(bare) if sum(w[a : a + m]) < 400}


def brute(rows):
    """Chunks that occurred before go, each as it stands, with blank lines between their lines."""
    seen, out = set(), {}
    for d, text in sorted(rows):
        lines = lines_of(text)
        all_bare = contents_of(lines)
        places = [i for i, x in enumerate(all_bare) if x.strip(" \t\r")]
        bare, gone = [all_bare[i] for i in places], set()
        for a, n in sorted(spans_of(bare)):
            if tuple(bare[a : a + n]) in seen:
                gone |= set(range(a, a + n))
            seen.add(tuple(bare[a : a + n]))
        away = {places[i] for i in gone}
        away |= {j for i in gone if i + 1 in gone for j in range(places[i], places[i + 1])}
        out[d] = (len(lines), len(away), "".join(x for i, x in enumerate(lines) if i not in away))
    return out


def test_shifted_passage_is_found(spark):
    passage = "".join(f"Shared sentence number {i} of the passage. " for i in range(30))
    docs = spark.createDataFrame([(i, "".join(f"Own line {i} {j}.\n" for j in range(i + 3)) + passage + f"End {i}.", 0) for i in range(6)], "doc_id long, text string, n_chars int")
    rows = {r.doc_id: r for r in dedup_lines(docs).collect()}
    assert rows[0].n_removed == 0
    for i in range(1, 6):
        assert rows[i].n_removed >= 22 and f"Own line {i} 0." in rows[i].text and f"End {i}." in rows[i].text and rows[i].n_chars == len(rows[i].text)


def test_nulls_repeats_and_clashing_columns(spark):
    text = "".join(f"One line {j}.\n" for j in range(12))
    docs = spark.createDataFrame([(1, text, "a"), (1, text, "a"), (2, text, "b"), (3, None, None), (4, "", "c"), (None, "x", "d")], "doc_id long, text string, found string")
    rows = dedup_lines(docs)
    assert rows.columns == ["doc_id", "text", "found", "n_lines", "n_removed"]
    by = sorted(((r.doc_id or -1, r.found or "", r.n_removed > 0, r.text) for r in rows.collect()), key=lambda x: x[:2])
    assert [b[:3] for b in by] == [(-1, "d", False), (1, "a", False), (1, "a", False), (2, "b", True), (3, "", False), (4, "c", False)] and by[4][3] is None
    assert dedup_lines(docs.limit(0)).count() == 0


def test_lines_and_contents_of_odd_texts(spark):
    from pyspark.sql import functions as F

    from tracklot.llm.line_dedup import contents, lines

    texts = ["", "\n", " ", "a", "a\n", "a\n\nb. c", "x. y! z? w.  v . \n. ", "no end ", "é. \n ü!\n", "mark￿. here\n too", ". . .", "a\r\nb. \tc"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", F.expr(lines("text")).alias("l"), F.expr(contents("text")).alias("c")).collect():
        assert r.l == lines_of(r.text) and "".join(r.l) == r.text and r.c == contents_of(r.l)
