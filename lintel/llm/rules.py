"""Quality rules: a learned decision list over statistics of a text.

``features`` counts, in one pass, what the rules are stated in. ``learn`` is sequential covering in
the manner of IREP: it grows a conjunction of thresholds by information gain on two thirds of the
rows, prunes it from its end on the other third, keeps it while it is more often right than wrong
there, removes what it covers and goes on. Rules are ordered; ``verdict`` states them as one Spark
conditional expression, which first-match evaluates from the top.

Null texts have no words. Texts of any length are counted whole. Repeated rows give repeated
results; without labels of both kinds nothing is learned and the default verdict, keep, stands.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.llm.batches import M1, U64, checkpointed, least_hashed, map_arrow, mix, rows_of, slices, sums, text_bytes, words

SYMBOLS = b"#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Labelled rows that the rules are fitted on, at most, by the least hash of their ids.
FIT_ROWS = 20_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_lines", "n_distinct_words", "n_digits", "n_upper", "n_bytes"]


def table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int8)
    out[list(chars)] = 1
    return out


LETTERS = np.ones(256, np.int8)
LETTERS[list(SPACES.encode())] = 0
LETTERS[0x80:0xC0] = 0
TABLES = {"word_chars": LETTERS, "n_symbols": table(SYMBOLS), "n_digits": table(b"0123456789"), "n_upper": table(bytes(range(65, 91)))}


def duplicate_lines(text: str) -> tuple[int, int]:
    """(lines with a word that equal an earlier one, lines with a word)"""
    lines = [x for x in text.split("\n") if x and x.strip(SPACES)]
    return len(lines) - len(set(lines)), len(lines)


def repeated_words(offsets: np.ndarray, codes: np.ndarray, size: int = 5) -> np.ndarray:
    """By row: words within windows of size words that the row holds twice or more."""
    n, row = len(codes), rows_of(offsets)
    window = mix(row.astype(U64) + U64(1))
    for k in range(size):
        window[: n - k] = window[: n - k] * M1 + codes[k:].astype(U64)
    valid = np.flatnonzero(np.arange(n) + size <= offsets[1:][row])
    found, _ = pd.factorize(mix(window[valid]))
    starts = valid[np.bincount(found)[found] > 1] if len(found) else valid
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return sums(np.cumsum(edge[:-1]) > 0, offsets)


def features(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, COUNTS and EXTRA of every text."""

    def make():
        def run(batches):
            for part, texts in slices(batches, text):
                offsets, codes, _ = words(texts, lower=False)
                ends, data = text_bytes(texts)
                lines = np.array([duplicate_lines(x) for x in texts.to_pylist()], np.int64).reshape(-1, 2)
                found, _ = pd.factorize(rows_of(offsets) * np.int64(1 << 32) + codes)
                first = np.zeros(len(codes), bool)
                first[np.unique(found, return_index=True)[1]] = True
                yield {
                    key: part.column(key),
                    "n_words": np.diff(offsets),
                    "n_repeat_words": repeated_words(offsets, codes),
                    "n_dup_lines": lines[:, 0],
                    "n_lines": lines[:, 1],
                    "n_distinct_words": sums(first, offsets),
                    "n_bytes": np.diff(ends),
                } | {name: sums(own[data], ends) for name, own in TABLES.items()}

        return run

    kind = documents.schema[key].dataType.simpleString()
    return map_arrow(documents.select(key, text), make, ", ".join([f"{key} {kind}", *(f"{c} bigint" for c in COUNTS + EXTRA)]))


def statistics() -> dict[str, Column]:
    """What rules are stated in, over the columns of features."""
    c = {name: F.col(name).cast("double") for name in COUNTS + EXTRA}
    share = lambda a, b: F.when(F.col(b) > 0, c[a] / c[b]).otherwise(F.lit(0.0))
    return {
        "words": c["n_words"],
        "word_length": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "duplicate_lines": share("n_dup_lines", "n_lines"),
        "repeated_words": share("n_repeat_words", "n_words"),
        "distinct_words": share("n_distinct_words", "n_words"),
        "digits": share("n_digits", "word_chars"),
        "capitals": share("n_upper", "word_chars"),
        "words_per_line": share("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Rule:
    """All conditions (statistic, '<=' or '>', threshold) hold: the label is this one."""

    conditions: tuple[tuple[str, str, float], ...]
    label: int

    def column(self, stats: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, sign, at in self.conditions:
            out = out & ((stats[name] <= at) if sign == "<=" else (stats[name] > at))
        return out


def covered(conditions, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for name, sign, at in conditions:
        out &= x[name] <= at if sign == "<=" else x[name] > at
    return out


def grow(x: dict[str, np.ndarray], y: np.ndarray, most: int = 4) -> list[tuple[str, str, float]]:
    """Conditions that raise the share of y, by FOIL's gain, until the rule is pure or has most of them."""
    inside, rule = np.ones(len(y), bool), []
    while len(rule) < most:
        p, n = (y & inside).sum(), (~y & inside).sum()
        if not p or not n:
            break
        best = (1e-9, None)
        for name, values in x.items():
            v, own = values[inside], y[inside]
            order = np.argsort(v, kind="stable")
            v, own = v[order], own[order]
            cuts = np.flatnonzero(v[1:] > v[:-1])
            hits = np.cumsum(own)[cuts]
            for sign, p1, all1 in (("<=", hits, cuts + 1), (">", p - hits, len(v) - cuts - 1)):
                gain = np.where(p1 > 0, p1 * (np.log2(np.maximum(p1, 1e-9) / all1) - np.log2(p / (p + n))), 0)
                if gain.size and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (gain[k], (name, sign, float((v[cuts[k]] + v[cuts[k] + 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= covered([best[1]], x)
    return rule


def learn(x: dict[str, np.ndarray], y: np.ndarray, target: int = 0, most: int = 16) -> list[Rule]:
    """Ordered rules for the label target; what none covers has the other label."""
    rules: list[Rule] = []
    wanted = y == target
    fold = np.arange(len(y)) % 3
    left = np.ones(len(y), bool)
    while len(rules) < most and wanted[left].any() and not wanted[left].all():
        grown, held = left & (fold != 2), left & (fold == 2)
        conditions = grow({k: v[grown] for k, v in x.items()}, wanted[grown])
        best = (-2.0, 0)
        for size in range(len(conditions), 0, -1):
            hit = covered(conditions[:size], {k: v[held] for k, v in x.items()})
            p, n = (hit & wanted[held]).sum(), (hit & ~wanted[held]).sum()
            if p + n and (p - n) / (p + n) >= best[0]:
                best = ((p - n) / (p + n), size)
        hit = covered(conditions[: best[1]], x) & left if best[1] else np.zeros(len(y), bool)
        if best[0] <= 0 or hit.sum() < 5:
            break
        rules.append(Rule(tuple(conditions[: best[1]]), target))
        left &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list over the columns of features: whether the text is kept."""
    stats, out = statistics(), F
    for rule in rules:
        out = out.when(rule.column(stats), F.lit(rule.label == 1))
    return F.lit(True) if out is F else out.otherwise(F.lit(True))


def fit(counted: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", rows: int = FIT_ROWS) -> list[Rule]:
    """Rules from rows labelled rows at most; labels that are null, or disagree for a key, teach nothing."""
    known = labels.groupBy(key).agg(F.min(label).alias("y"), F.max(label).alias("y_most")).filter("y = y_most and y in (0, 1)")
    found = counted.join(known, key).withColumn("h", F.xxhash64(key)).select("h", key, "y", *(c.alias(n) for n, c in statistics().items()))
    sample = least_hashed(found, "h", key, rows, found.count()).toPandas().sort_values(["h", key], kind="stable")
    if sample["y"].nunique() < 2:
        return []
    return learn({n: sample[n].to_numpy() for n in statistics()}, sample["y"].to_numpy())


def judged(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept: the base limits first, then the learned list."""
    counted = checkpointed(features(documents))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & verdict(fit(counted, labels))).alias("kept"))
