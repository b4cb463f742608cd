import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lintel.llm import batches, bpe, packing
from lintel.llm.tokens import tokenizer

from .conftest import HARD, prose

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abzAZ éÉßİΣσ'-.,!?<|>_01\t\ń \x01中"), max_size=40), max_size=4))
def test_words_alone_give_the_whole_texts_ids(library, texts):
    offsets, ids = tokenizer(WORDS)(pa.array(texts, pa.string()), 2)
    for text, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True):
        assert list(ids[a:b]) == [*library(text), 2]


def test_special_strings_are_ordinary_text(library):
    texts = ["<|endoftext|> hi", "a<|startoftext|>b", "Don't we'll IT'S"]
    offsets, ids = tokenizer(WORDS)(pa.array(texts))
    assert [list(ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [library(t) for t in texts]


def check_packing(rows, expected: dict, window=4096):
    """Pieces of each document tile it, CRCs fit, and sequences are gapless."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert {d: sum(p.length for p in ps) for d, ps in pieces.items()} == {d: sum(map(len, ids)) for d, ids in expected.items()}
    for doc, ids in expected.items():
        if len(ids) == 1:
            at = 0
            for p in sorted(pieces[doc], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(ids[0])
                assert p.ids_crc32 == zlib.crc32(np.array(ids[0][at : at + p.length], "<u4").tobytes())
                at += p.length
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= window
    return [sum(p.length for p in own) for own in sequences.values()]


def test_packing_of_hard_texts(hard_docs, library):
    expected = defaultdict(list)
    for r in hard_docs.collect():
        expected[r.doc_id].append([*library(r.text or ""), 2])
    for window in (4096, 64):
        check_packing(packing.pack(hard_docs, window=window, open_windows=3, slack=2).collect(), expected, window)


def test_packing_pads_little_over_many_partitions(spark, library):
    docs = spark.createDataFrame([(i, prose(i, 5 + i * 7 % 400)) for i in range(300)], "doc_id bigint, text string").repartition(9)
    expected = {r.doc_id: [[*library(r.text), 2]] for r in docs.collect()}
    filled = check_packing(packing.pack(docs).collect(), expected)
    assert sum(4096 - n for n in filled) <= 4096 + 8 * len(filled)


def test_packing_merges_in_groups(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 2)
    # large ids beside a null one
    docs = spark.createDataFrame([((1 << 60) + i if i else None, prose(i, 30)) for i in range(40)], "doc_id bigint, text string").repartition(9)
    filled = check_packing(packing.pack(docs).collect(), {r.doc_id: [[*library(r.text), 2]] for r in docs.collect()})
    assert len(filled) == 1 + sum(filled) // 4096 or len(filled) == -(-sum(filled) // 4096)


def test_empty_table(no_docs):
    assert packing.pack(no_docs).count() == 0
    assert bpe.digests(no_docs).count() == 0 == bpe.encode(no_docs).count()


def whole(text: str) -> list[int]:
    return bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken")).encode_ordinary(text)


def test_bpe_of_hard_texts(hard_docs):
    expected = sorted((r.doc_id or -1, len(whole(r.text or "")), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in hard_docs.collect())
    rows = bpe.digests(hard_docs).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.decoded_sha256) for r in rows) == expected
    ids = {r.doc_id: r.ids for r in bpe.encode(hard_docs).collect() if r.doc_id is not None}
    assert all(ids[r.doc_id] == whole(r.text or "") for r in hard_docs.collect() if r.doc_id is not None)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word", " ", "\n", "  ", "\t", "é", "'s", "12", " ", "!?", " " * 50]), max_size=60))
def test_pieces_do_not_change_ids(parts):
    text, old = "".join(parts), (bpe.PIECE_CHARS, bpe.RUN_CHARS, bpe.LONG_RUN)
    try:
        bpe.PIECE_CHARS, bpe.RUN_CHARS, bpe.LONG_RUN = 7, 4, bpe.re.compile(r"\s{4,}")
        got = bpe.ids_of(bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken")), text)
    finally:
        bpe.PIECE_CHARS, bpe.RUN_CHARS, bpe.LONG_RUN = old
    assert got == whole(text)


def test_runs_of_blanks_that_the_library_cannot_take():
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for text in (" " * 300_000 + "x", "a" + "\n" * 300_000, "a" + " \n" * 200_000 + "b c"):
        assert enc.decode_bytes(bpe.ids_of(enc, text)) == text.encode()


def test_round_trip(spark, hard_docs):
    tokens = bpe.encode(hard_docs.filter("doc_id is not null").dropDuplicates(["doc_id"]))
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decode(tokens).collect()}
    assert back == {r.doc_id: (r.text or "").encode() for r in hard_docs.collect() if r.doc_id is not None}
    assert len(HARD) > 5


def test_workers_drop_the_tokenizer_when_they_run_other_operators():
    kept = tokenizer(WORDS, "lintel.llm.packing")
    batches.clear_others("lintel.llm.packing")
    assert tokenizer(WORDS, "lintel.llm.packing") is kept
    batches.clear_others("lintel.llm.toxicity")
    assert tokenizer(WORDS, "lintel.llm.packing") is not kept
