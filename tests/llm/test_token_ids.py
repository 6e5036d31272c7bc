import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from tracklot.llm.common import scratch_path
from tracklot.llm.token_ids import BLOCK_IDS, decode_ids, describe_token_ids, encode_ids, op1_token_ids, pack, read_token_ids, unpack, write_token_ids
from tracklot.llm.tokens import BYTE_BPE, WORD_BPE, PieceEncoder, encoder

ODD = ["", " ", "a  b", "x\n\ny", " lead", "tail ", "it's 1,234  \t\n don't x ñ<|endoftext|> y", "<|endoftext|>", "a\x1cb c", "é ́ İ ΑΣ ς's", "a b c", "👩‍👩‍👧 日本語 text"]
PARTS = ["a", "It's", "WORD", "x'LL", "\n", "\n\n", " ", "  ", "1", "42,", "é", "Ñandú", "Ж", "ß", "µ", "İ", "ſ", "<|endoftext|>", "<|startoftext|>", "<|", "?'s", "'", "''re", "...", "\t", "\u00a0", "\u0301", "ʼn", "½", "日本", "\x00"]
MADE: dict = {}


@pytest.mark.parametrize("special", [True, False])
@pytest.mark.parametrize("file", [BYTE_BPE, WORD_BPE])
@given(st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=40), st.lists(st.sampled_from(PARTS), max_size=12).map("".join)), max_size=6))
@settings(max_examples=150, deadline=None)
def test_equal_to_the_library(file, special, texts):
    path = public_tokenizers.path(file)
    if (key := (path, special)) not in MADE:
        MADE[key] = PieceEncoder(path, special), Tokenizer.from_file(path)
        MADE[key][1].encode_special_tokens = not special
    own, library = MADE[key]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_special_tokens_as_the_library_has_them_by_default():
    assert np.frombuffer(encoder(BYTE_BPE).encode(["a<|endoftext|>b"])[0], "<u4").tolist() == [64, 50256, 65]
    assert 49407 in np.frombuffer(encoder(WORD_BPE).encode(["a <|endoftext|> b"])[0], "<u4").tolist()


def test_other_vocabularies_go_through_the_library(tmp_path):
    Tokenizer(models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?")).save(path := str(tmp_path / "own.json"))
    own = PieceEncoder(path)
    assert own.kind == "other" and [list(x) for x in own.encode(["b", "c"])] == [[1, 0, 0, 0], [2, 0, 0, 0]]


@given(st.lists(st.integers(0, 2**60 - 1).flatmap(lambda x: st.sampled_from([0, 1, x % 8, x % 50_000, x])), max_size=700))
@settings(max_examples=80, deadline=None)
def test_words_round_trip(values):
    assert unpack(pack(np.array(values, np.uint64))).tolist() == values


def test_runs_share_words_and_escapes_return():
    assert len(pack(np.zeros(480, np.uint64))) == 2
    assert len(pack(np.full(12, 30_000, np.uint64))) == 3
    ids = np.arange(3 * BLOCK_IDS + 5, dtype=np.uint64)
    ids[[3, BLOCK_IDS + 1]] = [2**60, 2**64 - 1]
    coded = encode_ids(ids)
    assert np.array_equal(decode_ids(*coded), ids)
    assert np.array_equal(decode_ids(*coded, BLOCK_IDS - 2, 2 * BLOCK_IDS + 7), ids[BLOCK_IDS - 2 : 2 * BLOCK_IDS + 7])


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    tok = Tokenizer.from_file(public_tokenizers.path(BYTE_BPE))
    start, want = 0, []
    for r in docs:
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = op1_token_ids(spark, sf).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


def test_null_rows_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame([(3, "a b", 9), (1, None, 9), (3, "a b", 9), (2, "", 9), (None, "z", 9)], "doc_id long, text string, start int")
    write_token_ids(docs, path := scratch_path(spark, "t"))
    got = [tuple(r)[:3] for r in describe_token_ids(spark, path).orderBy("start").collect()]
    assert got == [(None, 0, 2), (1, 2, 1), (2, 3, 1), (3, 4, 3), (3, 7, 3)]
    assert {tuple(r.ids) for r in read_token_ids(spark, path).where("doc_id = 1").collect()} == {(2,)}
    write_token_ids(docs.limit(0), path := scratch_path(spark, "t"))
    assert describe_token_ids(spark, path).count() == 0
