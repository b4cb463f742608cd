"""Removal of repeated units of text by their digests.

A unit is a line or, on request, a paragraph (what blank lines part) or a sentence within a line: a run of
characters up to and with the marks that end it. Units are normalised (A-Z lowered, ASCII white space runs made one space,
trimmed). All but blank units count, whatever their length and script; min_words lets only longer ones count. Of the
units with equal digests the one with the least (doc_id, start) stays, all others go; starts and
ends of what goes are offsets into the original text, in characters.

Slices drop repeats of their own units first, so a unit that is everywhere is shuffled once for
each slice; the rest is sorted by digest and read as a stream, which holds one row of a digest.

Null texts have no units. Rows that share an id and a place are told apart by nothing: each later
one goes. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.batches import checkpointed, map_arrow, slices

PATTERNS = {"line": r"[^\n]*(?:\n|$)", "paragraph": r"(?:[^\n]|\n(?![ \t]*\n))*(?:\n[ \t]*\n|$)", "sentence": r"[^.!?\n]*(?:[.!?]+|\n|$)"}
SPACES = re.compile(r"[ \t\n\x0b\x0c\r]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def units(text: str, pattern: re.Pattern, min_words: int):
    """(start, end, normalised) of the units that count."""
    for found in pattern.finditer(text):
        if found.end() - found.start() < 2 * min_words - 1:
            continue
        plain = SPACES.sub(" ", found[0]).strip(" ")
        if plain and plain.count(" ") + 1 >= min_words:
            yield found.start(), found.end(), plain.translate(LOWER) if not plain.islower() else plain


def unit_rows(documents: DataFrame, kind: str, min_words: int) -> DataFrame:
    """d1, d2 (null: a repeat already), doc_id, start, end."""

    def make():
        pattern = re.compile(PATTERNS[kind])

        def run(batches):
            for part, texts in slices(batches, "text"):
                rows = [(doc, a, b, xxhash.xxh3_128_digest(plain)) for doc, text in zip(part.column("doc_id").to_pylist(), texts.to_pylist(), strict=True) for a, b, plain in units(text, pattern, min_words)]
                if not rows:
                    continue
                doc, start, end, digest = zip(*rows, strict=True)
                d = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
                doc, start, end = np.array(doc, np.int64), np.array(start), np.array(end)
                order = np.lexsort((start, doc, d[:, 1], d[:, 0]))
                d, doc, start, end = d[order], doc[order], start[order], end[order]
                again = np.zeros(len(d), bool)
                again[1:] = (d[1:] == d[:-1]).all(1)
                yield {"d1": np.where(again, doc, d[:, 0]), "d2": pa.array(d[:, 1], mask=again), "doc_id": doc, "start": start, "end": end}

        return run

    return map_arrow(documents, make, "d1 bigint, d2 bigint, doc_id bigint, start int, end int")


def repeats(documents: DataFrame, kind: str = "line", min_words: int = 1) -> DataFrame:
    """doc_id, start, end of each unit that goes. documents: doc_id, text."""

    def make():
        def run(batches):
            last = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                known = batch.column("d2").is_null().to_numpy(zero_copy_only=False)
                d1, d2 = batch.column("d1").to_numpy(), batch.column("d2").fill_null(0).to_numpy()
                again = np.zeros(len(d1), bool)
                own = np.flatnonzero(~known)
                if len(own):
                    again[own[1:]] = (d1[own[1:]] == d1[own[:-1]]) & (d2[own[1:]] == d2[own[:-1]])
                    again[own[0]] = last == (d1[own[0]], d2[own[0]])
                    last = (d1[own[-1]], d2[own[-1]])
                pick = pa.array(again | known)
                yield {c: batch.column(c).filter(pick) for c in ("doc_id", "start", "end")}

        return run

    dealt = unit_rows(documents, kind, min_words).repartition("d1").sortWithinPartitions("d1", "d2", "doc_id", "start")
    return map_arrow(dealt, make, "doc_id bigint, start int, end int")


def with_repeats(documents: DataFrame, kind: str = "line", min_words: int = 1) -> DataFrame:
    """All columns of documents and own_spans, the sorted starts and ends of what goes, null where nothing does."""
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    found = checkpointed(repeats(own, kind, min_words)).groupBy(F.col("doc_id").alias("own_id")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("own_spans"))
    return documents.join(found, F.col("doc_id") == F.col("own_id"), "left").drop("own_id")


def digests(documents: DataFrame, kind: str = "line", min_words: int = 1) -> DataFrame:
    """doc_id, n_removed, n_chars_removed, removed (start-end of each unit, commas between), kept_md5 of every row."""

    def make():
        def run(batches):
            for part, texts in slices(batches, "text"):
                out: dict[str, list] = {k: [] for k in ("n_removed", "n_chars_removed", "removed", "kept_md5")}
                for text, own in zip(texts.to_pylist(), part.column("own_spans").to_pylist(), strict=True):
                    cut = [(s["start"], s["end"]) for s in own or ()]
                    kept, at = [], 0
                    for a, b in cut:
                        kept.append(text[at:a])
                        at = b
                    kept.append(text[at:])
                    out["n_removed"].append(len(cut))
                    out["n_chars_removed"].append(sum(b - a for a, b in cut))
                    out["removed"].append(",".join(f"{a}-{b}" for a, b in cut))
                    out["kept_md5"].append(hashlib.md5("".join(kept).encode()).hexdigest())
                yield {"doc_id": part.column("doc_id")} | out

        return run

    return map_arrow(with_repeats(documents.select("doc_id", "text"), kind, min_words), make, "doc_id bigint, n_removed bigint, n_chars_removed bigint, removed string, kept_md5 string")
