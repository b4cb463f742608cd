"""Language identification with hyperdimensional profiles.

Every letter has a random vector of DIMENSIONS signs, drawn from its code point. A trigram of
letters, with a mark for a word's edge, binds them: the first letter's vector rotated twice, times the second's
rotated once, times the third's. A text's vector bundles (adds) its trigrams' vectors and a
language's prototype bundles those of all texts it is learnt from. Prototypes are added up over
all partitions, so they rest on every labelled text.

A text is compared with prototypes by the cosine of its bundle. Bundles of some texts at a time are
products of their trigram counts with the vectors of the trigrams that they hold. Prototypes are centred on their
mean, which removes what all languages share. Unrelated letters have cosines of about 0 with a
deviation of 1 over the root of DIMENSIONS, so a best cosine below a few of those is no language's.

Null texts and texts without a letter are "und" with score 0. Text is read whole and lower-cased.
Repeated rows give repeated results; ties go to the language that sorts first; without any labels
everything is "und".
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.batches import map_arrow, remainder, rows_of, slices, words

DIMENSIONS, SEED, SHARPNESS, EDGE = 2048, 7919, 30.0, 32
BITS = 21
#: Trigrams whose counts a worker adds up before it bundles them, at most.
KEPT = 1 << 20
#: Deviations above 0 from which on a cosine is more than chance; texts of fewer than SHORT trigrams are too short to tell.
CHANCE, SHORT = 3.5, 12
#: Texts that are bundled together, and trigrams whose vectors are there at a time.
TOGETHER, AT_ONCE = 512, 2048


@lru_cache(1)
def is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def trigrams(vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets by word, trigrams as numbers): of each run of letters with an edge on both sides."""
    text = " " + " \n ".join(vocabulary.to_pylist()).lower() + " \n" if len(vocabulary) else ""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = is_letter()[points]
    ends = np.flatnonzero(points == 10)
    points = np.where(letter, points, EDGE)
    n = max(len(points) - 2, 0)
    grams = (points[:n] << 2 * BITS) | (points[1 : n + 1] << BITS) | points[2:]
    real = letter[1 : n + 1]
    at = np.concatenate(([0], np.cumsum(real)))
    return np.concatenate(([0], at[np.minimum(ends, n)])), grams[real]


@lru_cache(20_000)
def letter_vector(point: int) -> np.ndarray:
    return (np.random.default_rng((SEED, point)).integers(0, 2, DIMENSIONS, np.int8) * 2 - 1).astype(np.int8)


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """Bound sign vectors, a row for each trigram."""
    points, found = np.unique(np.concatenate([grams >> 2 * BITS, (grams >> BITS) & ((1 << BITS) - 1), grams & ((1 << BITS) - 1)]), return_inverse=True)
    letters = np.array([letter_vector(int(p)) for p in points]).reshape(-1, DIMENSIONS)
    a, b, c = found.reshape(3, -1)
    return np.roll(letters, 2, 1)[a] * np.roll(letters, 1, 1)[b] * letters[c]


def bundle(grams: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted sums of gram vectors: weights has a row for each trigram; exact in doubles."""
    out = np.zeros((weights.shape[1], DIMENSIONS))
    for at in range(0, len(grams), 4096):
        out += weights[at : at + 4096].T.astype(float) @ gram_vectors(grams[at : at + 4096]).astype(float)
    return out


def prototypes(documents: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Bundles of all rows by language; rows without a language teach nothing."""

    def make():
        def run(batches):
            known: dict[str, pd.Series] = {}
            for part, texts in slices(batches, text):
                names = part.column(lang).to_pylist()
                offsets, codes, vocabulary = words(texts)
                at, grams = trigrams(vocabulary)
                values, found = np.unique(grams, return_inverse=True)
                row = np.array([hash_of.setdefault(x, len(hash_of)) for hash_of in [{}] for x in names])
                for k, name in enumerate(dict.fromkeys(names)):
                    n = np.bincount(codes[(row == k)[rows_of(offsets)]], minlength=len(vocabulary))
                    own = pd.Series(np.bincount(found, np.repeat(n, np.diff(at)), len(values)), values)
                    own = own[own > 0]
                    known[name] = own if name not in known else known[name].add(own, fill_value=0)
                    if len(known[name]) > KEPT:  # a part of the sum goes out early
                        yield summed(name, known.pop(name))
            for name, own in known.items():
                yield summed(name, own)

        return run

    def summed(name: str, own: pd.Series) -> dict:
        total = bundle(own.index.to_numpy(np.int64), own.to_numpy()[:, None])[0]
        return {"lang": [name] * DIMENSIONS, "at": np.arange(DIMENSIONS), "value": np.rint(total).astype(np.int64)}

    known = documents.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("own_lang"), F.col(text).alias("own_text"))
    lang, text = "own_lang", "own_text"
    rows = map_arrow(known, make, "lang string, at int, value bigint").groupBy("lang", "at").agg(F.sum("value").alias("value")).toPandas()
    return {name: own.sort_values("at")["value"].to_numpy(float) for name, own in rows.sort_values("lang").groupby("lang")}


class Profiles:
    """Unit prototypes, centred where there are two or more."""

    def __init__(self, by_lang: dict[str, np.ndarray]):
        units = {k: v / np.linalg.norm(v) for k, v in by_lang.items() if v.any()}
        self.langs = sorted(units)
        matrix = np.array([units[k] for k in self.langs]).reshape(-1, DIMENSIONS)
        if len(matrix) > 1:
            matrix = matrix - matrix.mean(0)
            matrix /= np.linalg.norm(matrix, axis=1, keepdims=True) + 1e-12
        self.matrix = matrix.astype(np.float32)

    def cosines(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(cosine by text and language, trigrams by text)"""
        offsets, codes, vocabulary = words(texts)
        at, grams = trigrams(vocabulary)
        values, found = np.unique(grams, return_inverse=True)
        # each text's distinct trigrams and their counts
        each = np.diff(at)[codes]
        flat = np.arange(each.sum()) + np.repeat(at[codes] - (np.cumsum(each) - each), each)
        row = np.repeat(rows_of(offsets), each)
        pair, uniques = pd.factorize(row * np.int64(len(values) + 1) + found[flat])
        of, gram, n = uniques // (len(values) + 1), uniques % (len(values) + 1), np.bincount(pair, minlength=len(uniques))
        out = np.zeros((len(texts), len(self.langs)))
        for low in range(0, len(texts), TOGETHER):
            a, b = np.searchsorted(of, (low, low + TOGETHER))
            bundles = bundled(of[a:b] - low, values, gram[a:b], n[a:b], min(TOGETHER, len(texts) - low))
            size = np.sqrt(np.einsum("ij,ij->i", bundles, bundles, dtype=np.float64))
            out[low : low + TOGETHER] = (bundles @ self.matrix.T) / np.maximum(size, 1e-12)[:, None]
        return out, np.bincount(row, minlength=len(texts))


def bundled(row: np.ndarray, values: np.ndarray, gram: np.ndarray, n: np.ndarray, rows: int) -> np.ndarray:
    """Sums of n times the vectors of values[gram], by row."""
    out = np.zeros((rows, DIMENSIONS), np.float32)
    held, column = np.unique(gram, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column, n = row[order], column[order], n[order]
    for low in range(0, len(held), AT_ONCE):
        own = held[low : low + AT_ONCE]
        a, b = np.searchsorted(column, (low, low + len(own)))
        counts = np.zeros((rows, len(own)), np.float32)
        counts[row[a:b], column[a:b] - low] = n[a:b]
        out += counts @ gram_vectors(values[own]).astype(np.float32)
    return out


def identified(documents: DataFrame, learn_from: DataFrame, text: str = "text", extra: tuple[str, ...] = ("doc_id",), names: tuple[str, str, str] = ("lang_pred", "score", "known")) -> DataFrame:
    """extra columns and, under names that are none of theirs, the language, the softmax of SHARPNESS times the cosines, and whether it is known.

    Known is a language whose cosine is more than chance, or that of a text too short to tell, but never "und".
    """
    profiles = Profiles(prototypes(learn_from, text))
    if not profiles.langs:
        return documents.select(*extra, F.lit("und").alias(names[0]), F.lit(0.0).alias(names[1]), F.lit(False).alias(names[2]))
    shared = documents.sparkSession.sparkContext.broadcast(profiles)

    def make():
        own = shared.value

        def run(batches):
            for part, texts in slices(batches, text):
                cosines, n = own.cosines(texts)
                best = cosines.argmax(1)
                likely = np.exp(SHARPNESS * (cosines - cosines.max(1, keepdims=True)))
                score = np.where(n > 0, 1 / likely.sum(1), 0.0)
                known = (n > 0) & ((n < SHORT) | (cosines.max(1) >= CHANCE / np.sqrt(DIMENSIONS)))
                yield {c: part.column(c) for c in extra} | {names[0]: [own.langs[b] if k else "und" for b, k in zip(best, n, strict=True)], names[1]: score, names[2]: known}

        return run

    fields = [f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in extra]
    return map_arrow(documents.select(*dict.fromkeys([*extra, text])), make, ", ".join([*fields, f"`{names[0]}` string, `{names[1]}` double, `{names[2]}` boolean"]))


def predicted(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; languages of keys with crc32 mod 4 = 2 are not learnt from."""
    found = identified(documents, documents.filter(remainder("doc_id", 4) != 2))
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
