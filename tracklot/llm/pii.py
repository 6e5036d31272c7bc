"""Personal data: base patterns, and spans that a character tagger adds to them.

The tagger (a BiLSTM with CRF transitions) is trained on the driver from labelled spans: the base spans of a bounded
sample of rows, in their contexts, as they are and rewritten in other common spellings of the same datum. Tasks decode
overlapping windows around every place where such data can be, give each character the tag of the window in which it
stands most centrally, and read spans off the whole text. A window needs a digit, an ``@`` or a bracketed ``at`` or
``dot``; none of the four kinds can be written without one. Where a span reaches the end of what was decoded, more of the
text is. Base spans always stay; an added span may not touch one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklot.llm.bilstm_crf import BiLstmCrf
from tracklot.llm.common import table, text_slices

KINDS = ("email", "ip", "card", "phone")
#: Rows whose base spans label the training set, at most.
TRAIN_ROWS = 250
WINDOW, STRIDE, MARGIN = 64, 32, 24
#: Other spellings of each labelled span in the training set.
RESPELLED = 5
#: Updates of the tagger at least, in batches of 32 windows.
UPDATES = 240
FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# possessive forms match what the plain ones do: giving back a character never helps any of them
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]+")
_TRIGGER = re.compile(r"[0-9@]|[\[(](?:at|dot)[\])]", re.IGNORECASE)
Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _in_byte(digits: str) -> bool:
    """Whether a number is at most 255, however many digits it has."""
    digits = digits.lstrip("0")
    return len(digits) < 4 and int(digits or "0") <= 255


def _digits(s: str) -> str:
    return "".join(_DIGITS.findall(s))


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the base patterns, by start and then kind."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        low = at
        while low > done and text[low - 1] in _LOCAL:
            low -= 1
        if low < at and (m := _DOMAIN.match(text, at)):
            out.append((low, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGITS.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_in_byte, m[0].split(".")))]
        out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def _symbol_table() -> np.ndarray:
    """Symbols: printable ASCII by itself, line ends, letters beyond ASCII, the rest; 0 pads."""
    kinds = np.full(65_537, 98, np.uint8)
    kinds[32:127] = np.arange(1, 96)
    kinds[[9, 10, 11, 12, 13]] = 96
    kinds[[c for c in range(128, 65_536) if chr(c).isalpha()]] = 97
    return kinds


_SYMBOLS = _symbol_table()
N_SYMBOLS, N_TAGS = 99, 1 + 2 * len(KINDS)


def symbols(text: str) -> np.ndarray:
    return _SYMBOLS[np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 65_536)]


def _respelled(kind: int, s: str, rng: np.random.Generator) -> str:
    """The same datum as people also write it."""
    way = rng.integers(4)
    d = _digits(s)
    if kind == 0:
        user, _, host = s.partition("@")
        return (s, f"{user} [at] {host}", f"{user} (at) {host.replace('.', ' (dot) ')}", f"{user}[at]{host.replace('.', '[dot]')}")[way]
    if kind == 1:
        return (s, s.replace(".", "[.]"), s.replace(".", " . "), s)[way]
    if kind == 2:
        return (s, d, ".".join(d[i : i + 4] for i in range(0, len(d), 4)), " ".join(d[i : i + 4] for i in range(0, len(d), 4)))[way]
    if len(d) < 10:
        return s
    area, a, b = d[-10:-7], d[-7:-4], d[-4:]
    return (s, f"({area}) {a}-{b}", f"00{d[:-10]} {area} {a} {b}", f"{area}-{a}-{b}")[way]


_PLAIN_NUMBERS = ("2021-03-04", "12:30", "1,234", "3.14", "v1.2.3", "1984", "$45.00", "10%", "50", "7", "ISO 9001", "chapter 12", "1-2", "100 000", "pp. 12-15", "@home", "look@this", "0.5")


def training_windows(texts: list[str], seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and tag windows: each labelled span in its context, some respelled; plain numbers and plain text."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []

    def add(left: str, datum: str, right: str, kind: int | None) -> None:
        shift = int(rng.integers(2, max(3, min(MARGIN, WINDOW - len(datum) if len(datum) < WINDOW - 2 else 3))))
        left = left[-shift:]
        s = (left + datum + right)[:WINDOW]
        x, y = np.zeros(WINDOW, np.uint8), np.zeros(WINDOW, np.int8)
        x[: len(s)] = symbols(s)
        if kind is not None and len(left) < WINDOW:
            end = min(WINDOW, len(left) + len(datum))
            y[len(left) : end] = 2 + 2 * kind
            y[len(left)] = 1 + 2 * kind
        xs.append(x)
        ys.append(y)

    for text in texts:
        spans = [s for s in base_spans(text) if s[2] - s[0] <= WINDOW - 4]
        for start, kind, end in spans[:6]:
            left, right = text[max(0, start - 40) : start], text[end : end + 60]
            add(left, text[start:end], right, kind)
            for _ in range(RESPELLED):
                add(left, _respelled(kind, text[start:end], rng), right, kind)
            add(left, str(rng.choice(_PLAIN_NUMBERS)), right, None)
        words = text[int(rng.integers(0, max(1, len(text) - 80))) :][:80]
        if not base_spans(words):
            add(words[:20], "", words[20:], None)
    if not xs:
        return np.zeros((0, WINDOW), np.uint8), np.zeros((0, WINDOW), np.int8)
    return np.stack(xs), np.stack(ys)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, texts in text_slices(batch):
            h, xs, ys = batch.column("h").slice(low, high - low).to_pylist(), [], []
            for seed, text in zip(h, texts, strict=True):
                x, y = training_windows([text], seed % 2**32)
                xs.append(x.tobytes())
                ys.append(y.tobytes())
            yield pa.record_batch([pa.array(h, pa.int64()), pa.array(xs, pa.binary()), pa.array(ys, pa.binary())], names=["h", "x", "y"])


def train(docs: DataFrame, rows: int = TRAIN_ROWS, updates: int = UPDATES) -> BiLstmCrf:
    """A tagger trained on the driver from at most ``rows`` rows with a digit or ``@``, chosen by hash.

    The driver gets the least hashes, and then the windows cut from those rows (a few kilobytes each), never a text.
    """
    holds = docs.where(F.col("text").rlike("[0-9]{4}|@|[0-9]\\.[0-9]")).select("text", F.xxhash64("doc_id", "text").alias("h"))
    least = [r["h"] for r in holds.select("h").orderBy("h").limit(rows).collect()]
    model = BiLstmCrf(N_SYMBOLS, N_TAGS)
    if not least:
        return model
    hashed = docs.select("text", F.xxhash64("doc_id", "text").alias("h")).where(F.col("h").isin(least))
    # rows that are equal share a hash and are labelled once
    cut = {r["h"]: r for r in hashed.mapInArrow(_windows, "h long, x binary, y binary").dropDuplicates(["h"]).collect()}
    x = np.concatenate([np.frombuffer(cut[h]["x"], np.uint8) for h in sorted(cut)]).reshape(-1, WINDOW)
    y = np.concatenate([np.frombuffer(cut[h]["y"], np.int8) for h in sorted(cut)]).reshape(-1, WINDOW)
    if len(x):
        model.fit(x, y, max(4, -(-updates * 32 // len(x))), batch=32, rate=0.02)
    return model


def _stretches(text: str, margin: int) -> list[tuple[int, int]]:
    """Parts of the text within the margin of a trigger."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        low, high = max(0, m.start() - margin), min(len(text), m.end() + margin)
        if out and low <= out[-1][1]:
            out[-1][1] = high
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def tag_texts(model: BiLstmCrf, texts: list[str], chunk: int = 2048, margin: int = MARGIN) -> list[list[Span]]:
    """Spans that the tagger sees in each text; a text is decoded with wider margins until no span reaches the end of a stretch."""
    windows: list[tuple[int, int, int]] = []  # text, first character, of stretch
    places: list[tuple[int, int, int]] = []
    for k, text in enumerate(texts):
        for low, high in _stretches(text, margin):
            places.append((k, low, high))
            at = low
            while True:
                windows.append((k, at, len(places) - 1))
                if at + WINDOW >= high:
                    break
                at += STRIDE
    tags = [np.zeros(b - a, np.int8) for _, a, b in places]
    best = [np.full(b - a, -1, np.int16) for _, a, b in places]
    central = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]).astype(np.int16)
    for c in range(0, len(windows), chunk):
        own = windows[c : c + chunk]
        x = np.zeros((len(own), WINDOW), np.uint8)
        for i, (k, at, s) in enumerate(own):
            piece = symbols(texts[k][at : min(at + WINDOW, places[s][2])])
            x[i, : len(piece)] = piece
        y = model.decode(x)
        for i, (_, at, s) in enumerate(own):
            _, low, high = places[s]
            n = min(WINDOW, high - at)
            here = slice(at - low, at - low + n)
            weight = central[:n].copy()
            if at == low:
                weight[: WINDOW // 2] = WINDOW
            if at + n == high:
                weight[n // 2 :] = WINDOW
            wins = weight > best[s][here]
            tags[s][here][wins] = y[i, :n][wins]
            best[s][here][wins] = weight[wins]
    out: list[list[Span]] = [[] for _ in texts]
    for (k, low, _), own in zip(places, tags, strict=True):
        at = 0
        while at < len(own):
            if own[at] == 0:
                at += 1
                continue
            kind, end = (own[at] - 1) // 2, at + 1
            while end < len(own) and own[end] == 2 + 2 * kind:
                end += 1
            out[k].append((low + at, int(kind), low + end))
            at = end
    cut = set()
    for (k, low, high), own in zip(places, tags, strict=True):
        if (low and own[0]) or (high < len(texts[k]) and own[-1]):
            cut.add(k)
    if cut:
        cut = sorted(cut)
        for k, spans in zip(cut, tag_texts(model, [texts[k] for k in cut], chunk, 4 * margin), strict=True):
            out[k] = spans
    return out


#: What a tagged span may be a part of, by kind.
_WIDE = (
    re.compile(r"[A-Za-z0-9._%+-]++ ?(?:@|\[at\]|\(at\)) ?[A-Za-z0-9-]++(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]++)+", re.IGNORECASE),
    re.compile(r"(?<![0-9])[0-9]{1,3}(?: ?(?:\.|\[\.\]|\(\.\)|\[dot\]|\(dot\)) ?[0-9]{1,3}){3}(?![0-9])", re.IGNORECASE),
    re.compile(r"(?<![0-9])[0-9](?:[ .-]?[0-9]){11,18}(?![0-9])"),
    re.compile(r"\+?(?:\([0-9]+\)|[0-9])(?:[ .-]{0,2}(?:\([0-9]+\)|[0-9]))+"),
)


def settled(text: str, span: Span) -> Span | None:
    """The datum that a tagged span is part of, or none if it is not one of its kind: a tagger may miss a character at either end."""
    start, kind, end = span
    around = _WIDE[kind].finditer(text, max(0, start - MARGIN), min(len(text), end + MARGIN))
    found = max(((min(end, m.end()) - max(start, m.start()), -m.start(), m) for m in around), key=lambda x: x[:2], default=None)
    if found is None or found[0] <= 0:
        return None
    m = found[2]
    digits = _digits(m[0])
    right = (True, all(map(_in_byte, re.findall("[0-9]+", m[0]))), luhn(digits) if kind == 2 else False, 9 <= len(digits) <= 15)[kind]
    return (m.start(), kind, m.end()) if right else None


def all_spans(model: BiLstmCrf, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and added spans of each text. An added span may not touch a base one; of two that touch the first one counts."""
    out = []
    for t, seen in zip(texts, tag_texts(model, texts), strict=True):
        own, added, done = base_spans(t), [], -1
        for span in sorted({s for s in (settled(t, x) for x in seen) if s}):
            if span[0] >= done and not any(a < span[2] and span[0] < b for a, _, b in own):
                added.append(span)
                done = span[2]
        out.append((own, added))
    return out


def _join(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def _find(batches: Iterator[pa.RecordBatch], model: BiLstmCrf) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, texts in text_slices(batch):
            counts, digests, spans, more = [[] for _ in KINDS], [], [], []
            for base, added in all_spans(model, texts):
                for k, c in enumerate(counts):
                    c.append(sum(s[1] == k for s in base))
                digests.append(hashlib.sha256(_join(base).encode()).hexdigest())
                spans.append(_join(base + added))
                more.append(len(added))
            yield pa.record_batch([batch.column("doc_id").slice(low, high - low), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(more, pa.int64())], names=[f.split()[0] for f in FOUND.split(", ")])


def find_pii(docs: DataFrame) -> DataFrame:
    """Counts of base spans, their digest, and all spans of each document (doc_id, text; other columns are ignored).

    A null text is empty and has no spans; repeated rows are searched each; a table without any base span leaves the
    tagger untrained, and its spans still have to be plausible. No row leaves its task: nothing is shuffled.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda b: _find(b, model.value), FOUND)


def mask_pii(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; all columns return, ``n_chars`` (if there) following the text.

    Spans that overlap are masked as one, named after the first. A null text stays null; see ``find_pii`` for other odd rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")))
    at, at_size = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, texts in text_slices(batch):
                rows, out = batch.slice(low, high - low), []
                for t, (base, added) in zip(texts, all_spans(model.value, texts), strict=True):
                    parts, done = [], 0
                    for a, k, b in sorted(base + added):
                        if a >= done:
                            parts += [t[done:a], f"<{KINDS[k]}>"]
                        done = max(done, b)
                    out.append("".join([*parts, t[done:]]))
                null = rows.column("text").is_null().to_pylist()
                columns = rows.columns
                columns[at] = pa.array([None if n else t for t, n in zip(out, null, strict=True)], rows.schema.field("text").type)
                if at_size is not None:
                    columns[at_size] = pa.array([None if n else len(t) for t, n in zip(out, null, strict=True)]).cast(rows.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays(columns, schema=rows.schema)

    return docs.mapInArrow(mask, docs.schema)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
