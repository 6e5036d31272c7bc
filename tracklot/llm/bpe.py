"""Byte-pair encoding by a queue of merge ranks over a linked list of symbols, and decoding by joining vocabulary strings.

A piece of text starts as one symbol a byte, linked to its neighbours. A heap holds the rank of every adjacent pair that
the vocabulary merges, lowest rank and then leftmost first; a merge relinks three symbols and adds at most two pairs, so
a piece of n bytes costs n log n whatever its length. Entries whose pair has changed since are skipped when they come up.

Text is cut into pieces as the vocabulary's file says (see ``tokens``): common words by pattern, all others and any text
whose white space is unusual by the tokenizers library's pre-tokenizer. The merges themselves are never the library's. A
process remembers the ids of the words it has met.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklot.llm.common import kept, table, text_slices
from tracklot.llm.tokens import BYTE_BPE, PieceEncoder, _byte_letters

#: Bits that hold any id, and any place in a piece.
ID_BITS, PLACE_BITS = 20, 40
PLACES = (1 << PLACE_BITS) - 1


class LinkedBpe(PieceEncoder):
    """Encodes and decodes with a byte-level vocabulary file; equal to the library's ids and texts."""

    def __init__(self, path: str, special: bool = True):
        super().__init__(path, special)
        if self.kind != "byte":
            raise ValueError("a byte-level BPE vocabulary without dropout is needed")
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self.vocab: dict[str, int] = parts["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in parts["model"]["merges"]]
        self.ranks = {self.vocab[a] << ID_BITS | self.vocab[b]: r for r, (a, b) in enumerate(pairs)}
        self.made = [self.vocab[a + b] for a, b in pairs]
        self.added = {t["content"]: t["id"] for t in parts["added_tokens"]} if special else {}
        letters = {c: b for b, c in _byte_letters().items()}
        self.strings = {i: bytes(map(letters.__getitem__, s)) for s, i in self.vocab.items()} | {t["id"]: t["content"].encode() for t in parts["added_tokens"]}

    def merge(self, letters: str) -> list[int]:
        """Ids of one piece, given as its bytes' letters."""
        ids = [self.vocab[c] for c in letters]
        n, rank_of = len(ids), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = [rank_of(a << ID_BITS | b, -1) for a, b in zip(ids, ids[1:], strict=False)] + [-1]
        queue = [r << PLACE_BITS | i for i, r in enumerate(rank) if r >= 0]
        heapify(queue)
        while queue:
            top = heappop(queue)
            i = top & PLACES
            if rank[i] != top >> PLACE_BITS:
                continue  # stale: the pair at this place is another one by now
            j = after[i]
            ids[i] = self.made[top >> PLACE_BITS]
            ids[j] = rank[j] = -1
            k = after[i] = after[j]
            rank[i] = -1
            if k < n:
                before[k] = i
                self._offer(queue, rank, i, ids[i], ids[k])
            if before[i] >= 0:
                self._offer(queue, rank, before[i], ids[before[i]], ids[i])
        return [x for x in ids if x >= 0]

    def _offer(self, queue: list[int], rank: list[int], at: int, left: int, right: int) -> None:
        rank[at] = r = self.ranks.get(left << ID_BITS | right, -1)
        if r >= 0:
            heappush(queue, r << PLACE_BITS | at)

    def _merged(self, piece: str) -> bytes:
        return array("I", self.merge(piece.encode().decode("latin-1").translate(_byte_letters()))).tobytes()

    def _whole(self, text: str) -> bytes:
        """Ids of any text: special tokens first, as the library finds them, then the pre-tokenizer's pieces."""
        out = array("I")
        while text:
            at, mark = min(((text.find(m), m) for m in self.added if m in text), default=(len(text), ""), key=lambda x: (x[0], -len(x[1])))
            for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text[:at]):
                out.extend(self.merge(piece))
            if mark:
                out.append(self.added[mark])
            text = text[at + len(mark) :]
        return out.tobytes()

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings joined; bytes that are no UTF-8 become U+FFFD, ids outside the vocabulary are left out."""
        return b"".join([self.strings.get(i, b"") for i in ids]).decode("utf-8", "replace")


def _coder(file: str, folder: str | None) -> LinkedBpe:
    path = f"{folder}/{file}" if folder else public_tokenizers.path(file)
    return kept(f"linked {path}", lambda: LinkedBpe(path))


def _replaced(df: DataFrame, source: str, kept_source: bool, name: str, kind: str, convert) -> DataFrame:
    """``df`` with a column that ``convert`` makes of another, a slice of rows at a time."""
    names = [c for c in df.columns if c != name and (kept_source or c != source)]
    whole = df.select(*names, F.col(source).alias("_source"))
    out = df.select(*names, F.lit(None).cast(kind).alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, made in convert(batch):
                columns = [batch.column(i).slice(low, high - low) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, made], names=[*names, name])

    return whole.mapInArrow(run, out.schema)


def encode_bpe(df: DataFrame, text: str = "text", ids: str = "ids", keep_text: bool = True, file: str = BYTE_BPE, folder: str | None = None) -> DataFrame:
    """Add ``ids``: the text's token ids, four little-endian bytes each (a null text is empty).

    Special tokens' strings in a text are those tokens, as the library has them by default. All other columns stay; a column
    that is already called ``ids`` is replaced. Rows do not move, so a hot source or group of copies weighs no more than its rows.
    """
    def convert(batch):
        coder = _coder(file, folder)
        for low, high, texts in text_slices(batch, "_source"):
            yield low, high, pa.array(coder.encode(texts), pa.binary())

    return _replaced(df, text, keep_text, ids, "binary", convert)


def decode_bpe(df: DataFrame, ids: str = "ids", text: str = "text", keep_ids: bool = True, file: str = BYTE_BPE, folder: str | None = None) -> DataFrame:
    """Add ``text``: the vocabulary strings of ``ids`` (as ``encode_bpe`` writes them; null is empty) joined."""
    def convert(batch):
        coder = _coder(file, folder)
        column = batch.column(batch.num_columns - 1)
        for low in range(0, batch.num_rows, 500):
            part = column.slice(low, 500).to_pylist()
            yield low, low + len(part), pa.array([coder.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in part], pa.string())

    return _replaced(df, ids, keep_ids, text, "string", convert)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text that they decode to; one row per input row, repeats and null ids included."""
    coded = encode_bpe(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    coded = coded.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    back = decode_bpe(coded, keep_ids=False)
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
