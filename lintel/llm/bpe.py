"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

``encode`` gives every text's ids, ``decode`` turns ids back into bytes. A text is cut in front of
white space that follows other characters, where no match of the splitting pattern can reach across, so
the library never sees more than PIECE_CHARS characters unless one word is longer. Long runs of
white space, on which the library's regex engine overflows its stack, are matched here by the
pattern's own rule: all but the last character of a run that a word follows are one match.

Null texts count as empty and give no ids. Repeated rows give repeated results; an empty table
gives an empty one; further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame

from lintel.llm.batches import map_arrow, slices

PIECE_CHARS = 1 << 16
RUN_CHARS = 4096
BREAK = re.compile(r"(?<=\S)(?=\s)")
LONG_RUN = re.compile(r"\s{%d,}" % RUN_CHARS)


@lru_cache(2)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str) -> Iterator[tuple[str, bool]]:
    """(piece, whether it is one match): the pieces' matches are the text's."""
    at = 0
    while len(text) - at > PIECE_CHARS:
        cut = BREAK.search(text, at + PIECE_CHARS)
        end = cut.start() if cut else len(text)
        if end == at:
            break
        yield from runs(text[at:end], end < len(text))
        at = end
    yield from runs(text[at:], False)


def runs(piece: str, more: bool) -> Iterator[tuple[str, bool]]:
    """Cuts out long runs of white space. A piece ends at the text's end or ahead of white space."""
    at = 0
    for run in LONG_RUN.finditer(piece):
        end = run.end() - (run.end() < len(piece))
        if run.start() > at:
            yield piece[at : run.start()], False
        yield piece[run.start() : end], True
        at = end
    if at < len(piece):
        yield piece[at:], False


def ids_of(enc: tiktoken.Encoding, text: str) -> list[int]:
    if len(text) < RUN_CHARS:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece, single in pieces(text):
        ids += enc._core_bpe.encode_single_piece(piece.encode()) if single else enc.encode_ordinary(piece)
    return ids


def encode(documents: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """key, ids (array of int) of every text."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def make():
        enc = encoding(path)

        def run(batches):
            for rows, texts in slices(batches, text):
                yield {key: rows.column(key), "ids": [ids_of(enc, x) for x in texts.to_pylist()]}

        return run

    return map_arrow(documents.select(key, text), make, f"{key} {documents.schema[key].dataType.simpleString()}, ids array<int>")


def decode(tokens: DataFrame, ids: str = "ids", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """key, bytes (binary; not always valid UTF-8) of every row's ids; null ids count as none."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def make():
        enc = encoding(path)

        def run(batches):
            for batch in batches:
                yield {key: batch.column(key), "bytes": [enc.decode_bytes(x or []) for x in batch.column(ids).to_pylist()]}

        return run

    return map_arrow(tokens.select(key, ids), make, f"{key} {tokens.schema[key].dataType.simpleString()}, bytes binary")


def digests(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode of each text in one pass, digested in place."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def make():
        enc = encoding(path)

        def run(batches):
            for rows, texts in slices(batches, "text"):
                found = [ids_of(enc, x) for x in texts.to_pylist()]
                yield {
                    "doc_id": rows.column("doc_id"),
                    "n_tokens": [len(x) for x in found],
                    "ids_sha256": [hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest() for x in found],
                    "decoded_sha256": [hashlib.sha256(enc.decode_bytes(x)).hexdigest() for x in found],
                }

        return run

    return map_arrow(documents.select("doc_id", "text"), make, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
