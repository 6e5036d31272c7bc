import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.test_token_ids import ODD, PARTS
from tracklot.llm.bpe import LinkedBpe, decode_bpe, encode_bpe, op11_bpe
from tracklot.llm.tokens import BYTE_BPE, WORD_BPE

PATH = public_tokenizers.path(BYTE_BPE)
MADE: dict = {}


def both():
    if not MADE:
        MADE["x"] = LinkedBpe(PATH), Tokenizer.from_file(PATH)
    return MADE["x"]


@given(st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=60), st.text(st.sampled_from("abthe ING'\n12"), max_size=60), st.lists(st.sampled_from(PARTS), max_size=14).map("".join)), max_size=6))
@settings(max_examples=300, deadline=None)
def test_ids_and_texts_equal_the_library(texts):
    own, library = both()
    ids = [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)]
    assert ids == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [own.decode(i) for i in ids] == texts == [library.decode(i, skip_special_tokens=False) for i in ids]


@given(st.lists(st.integers(0, 50_300), max_size=40))
@settings(max_examples=300, deadline=None)
def test_any_ids_decode_as_the_library_does(ids):
    own, library = both()
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_merges_are_not_the_librarys(monkeypatch):
    own = LinkedBpe(PATH)
    own.model = None  # no way to the library's merges
    assert np.frombuffer(own.encode(["The lowest prices, newest あ!"])[0], "<u4").tolist() == both()[1].encode("The lowest prices, newest あ!").ids


@pytest.mark.parametrize("piece", ["a" * 30_000, "ab" * 20_000, "thethethe" * 5_000, "あ" * 9_000])
def test_one_very_long_piece(piece):
    own, library = both()
    assert np.frombuffer(own.encode([piece])[0], "<u4").tolist() == library.encode(piece, add_special_tokens=False).ids


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        LinkedBpe(public_tokenizers.path(WORD_BPE))


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    library, want = both()[1], set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.add((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [tuple(r) for r in op11_bpe(spark, sf).collect()]
    assert set(got) == want and len(got) == len(want)


def test_nulls_repeats_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b", "x", 9), (1, "a <|endoftext|> b", "x", 9), (None, None, None, None), (2, "", "y", 1)], "doc_id long, text string, ids string, n_tokens int")
    coded = encode_bpe(docs)
    assert coded.columns == ["doc_id", "text", "n_tokens", "ids"]
    back = decode_bpe(coded, text="again").orderBy("doc_id").collect()
    assert [(r.doc_id, r.text, r.again, len(r.ids) // 4, r.n_tokens) for r in back] == [(None, None, "", 0, None), (1, "a <|endoftext|> b", "a <|endoftext|> b", 4, 9), (1, "a <|endoftext|> b", "a <|endoftext|> b", 4, 9), (2, "", "", 0, 1)]
    assert encode_bpe(docs.limit(0)).count() == 0
    assert decode_bpe(spark.createDataFrame([(None,)], "ids binary")).collect()[0].text == ""
