"""Token ids through public tokenizers, remembered word by word.

Most of a corpus is repeats of the same words. Both vocabularies split text at white space before their merges run, so a
word's ids do not depend on its neighbours: a process gets a word's ids from the tokenizers library once and looks them
up afterwards. Words of common letters, digits and ASCII marks are split as the vocabulary's own pattern does and go
straight to the library's model; any other word, and a text whose white space or special tokens reach over words, goes
through the whole library. Ids are kept as bytes (little-endian, 32 bits), so a text's ids are a join of its words'.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import cache

import public_tokenizers
from tokenizers import Tokenizer

from tracklot.llm.common import kept

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
#: Words that one process remembers; beyond it the memory is emptied and fills anew.
CACHE_WORDS = 600_000
#: Letters whose class and lower case are the same in every version of Unicode, and that no normal form changes.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įĴ-ľŁ-ňŊ-žЀ-ҁ"
_PLAIN = re.compile(f" ?[!-~{_LETTERS}]+")
#: What some engine takes for white space.
_ODD = re.compile("[\\s\x1c-\x1f\x85\u180e\u200b\ufeff]")
_TAILS = "'s|'t|'re|'ve|'m|'ll|'d"
#: The pieces of a word as the vocabularies' own patterns make them.
_BYTE_PIECES = re.compile(f"{_TAILS}| ?[{_LETTERS}]+| ?[0-9]+| ?[^ 0-9{_LETTERS}]+")
_WORD_PIECES = re.compile(f"{_TAILS}|[{_LETTERS}]+|[0-9]|[^0-9{_LETTERS}]+")
#: How vocabulary files describe those patterns (fixed values).
_BYTE_CUT = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_WORD_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_NORMS = ["NFC", "Replace", "Lowercase"]


class _Reaches(Exception):  # noqa: N818
    """A word's ids may depend on its neighbours."""


@cache
def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it is visible, else from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in seen)}


_SPACE = _byte_letters()[32]


class _Words(dict):
    """Ids by word, learned when first asked for."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, word):
        ids = self[word] = self.learn(word)
        return ids


class PieceEncoder:
    """Encodes texts; equal to the library's ids for every text.

    With ``special`` (the library's default) a special token's string in a text is that token; without, ordinary text.
    A file with another pre-tokenizer than the two known ones works too: all its texts go through the library.
    """

    def __init__(self, path: str, special: bool = True):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self.marks = [t["content"] for t in parts["added_tokens"]]
        before, norm = parts.get("pre_tokenizer") or {}, parts.get("normalizer") or {}
        cuts = [p.get("pattern", {}).get("Regex") for p in before.get("pretokenizers", [])]
        plain = not parts["model"].get("dropout") and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or not t["content"].startswith("<|") for t in parts["added_tokens"])
        self.kind = "byte" if plain and before == _BYTE_CUT and not norm else "word" if plain and cuts == [_WORD_CUT, None] and [n["type"] for n in norm.get("normalizers", [])] == _WORD_NORMS else "other"
        self._clear()

    def _clear(self) -> None:
        self.rest, self.head, self.breaks = _Words(self._rest), _Words(self._head), _Words(lambda n: self._whole("\n" * n))

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _merged(self, piece: str) -> bytes:
        """Ids of one piece of the pattern, from the library's model."""
        letters = piece.replace(" ", _SPACE) if piece.isascii() else piece.encode().decode("latin-1").translate(_byte_letters())
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _learn(self, lead: str, word: str) -> bytes:
        """Ids of a word of a byte vocabulary and the space before it, if any."""
        if word.isascii() and word.isalpha():  # most words
            return self._merged(lead + word)
        if not word or "<|" in word or _ODD.search(word):
            raise _Reaches(word)
        if not _PLAIN.fullmatch(word):
            return self._whole(lead + word)
        pieces = _BYTE_PIECES.findall(lead + word)
        return self._merged(lead + word) if len(pieces) == 1 else b"".join([self.rest[p[1:]] if p[0] == " " else self.head[p] for p in pieces])

    def _rest(self, word: str) -> bytes:
        return self._learn(" ", word)

    def _head(self, word: str | bytes) -> bytes:
        if self.kind == "byte":
            return self._learn("", word)
        if word.isalpha():  # bytes: ASCII letters only
            return self._merged(word.decode().lower())
        word = word.decode()
        if "<|" in word or not _PLAIN.fullmatch(word):
            return self._whole(word)
        pieces = _WORD_PIECES.findall(word.lower())
        return self._merged(pieces[0]) if len(pieces) == 1 else b"".join([self.head[p.encode()] for p in pieces])

    def _lines(self, text: str) -> bytes:
        """Ids of a text for a byte vocabulary: of a run of line ends all but the last are one piece, as at the text's end."""
        out: list[bytes] = []
        rest, run = self.rest.__getitem__, 0
        for i, line in enumerate(text.split("\n")):
            run += i > 0
            if line:
                if run:
                    out += (self.breaks[run - 1], self.breaks[1])
                    run = 0
                words = line.split(" ")
                out.append(self.head[words[0]])
                del words[0]
                out.extend(map(rest, words))
        out.append(self.breaks[run])
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as bytes, four each."""
        if len(self.rest) + len(self.head) > CACHE_WORDS:
            self._clear()
        if self.kind == "other":
            return [self._whole(t) for t in texts]
        if self.kind == "word":
            return [b"".join(map(self.head.__getitem__, t.encode().split())) for t in texts]
        out = []
        for t in texts:
            try:
                out.append(self._lines(t))
            except _Reaches:
                out.append(self._whole(t))
        return out


def encoder(file: str, folder: str | None = None) -> PieceEncoder:
    """This process's encoder for a vocabulary file; ``folder`` replaces the installed files' place."""
    path = f"{folder}/{file}" if folder else public_tokenizers.path(file)
    return kept(path, lambda: PieceEncoder(path))
