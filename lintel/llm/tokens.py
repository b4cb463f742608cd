"""Ids of the word-level public tokenizer, a word at a time.

The tokenizer drops white space and no token or normalisation reaches across it, so a text's ids
are its words' ids in order. Each distinct word is encoded once. A word of Latin letters with
ASCII marks behind it is two of the tokenizer's pre-tokens and needs no normalisation but lower
case, so its parts go straight to the tokenizer's model; any other word goes through the whole
tokenizer. The ids of parts are kept by the worker (at most KEPT parts: a bound on memory, not on
what is encoded).
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from lintel.llm.batches import LEFT, words

KEPT = 150_000
SIMPLE = re.compile(r"([a-zà-öø-ÿÀ-ÖØ-Þ]*)([.,;:!?#$%&*|<>()]*)")


class WordTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.model = self.library.model
        self.as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.known: dict[str, list[int]] = {"": []}

    def encode(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def part(self, text: str) -> list[int]:
        """Ids of one pre-token of Latin letters or of marks."""
        ids = self.known.get(text)
        if ids is None:
            plain = text if text.isascii() else self.as_bytes.pre_tokenize_str(text.lower())[0][0]
            ids = [token.id for token in self.model.tokenize(plain)]
            if len(self.known) < KEPT and len(text) < 64:
                self.known[text] = ids
        return ids

    def word(self, word: str) -> list[int]:
        match = SIMPLE.fullmatch(word)
        if match is None:
            return self.encode(word)
        letters, marks = match.groups()
        return self.part(letters) + self.part(marks) if marks else self.part(letters)

    def __call__(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts; end: an id after each text."""
        offsets, codes, vocabulary = words(texts)
        if end is not None:
            codes = np.insert(codes, offsets[1:], len(vocabulary))
            offsets = offsets + np.arange(len(offsets))
        found = [*map(self.word, vocabulary.to_pylist()), *([[end]] if end is not None else [])]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))
        starts, each = np.cumsum(lengths) - lengths, lengths[codes]
        ends = np.concatenate(([0], np.cumsum(each)))
        at = np.arange(ends[-1]) + np.repeat(starts[codes] - ends[:-1], each)
        return ends[offsets], flat[at]


@lru_cache(2)
def loaded(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def tokenizer(path: str, module: str = __name__) -> WordTokenizer:
    """The tokenizer, which the worker keeps until it runs another module's tasks."""
    LEFT[module] = loaded.cache_clear
    return loaded(path)
