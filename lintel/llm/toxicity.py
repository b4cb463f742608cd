"""Toxicity by class-conditional Kneser-Ney models.

An expression is a word, spelt in characters. For each class an interpolated Kneser-Ney model of
order ORDER over the padded spelling takes its highest-order counts from the texts of that class;
all lower orders are continuation counts that both classes share, so an expression that was seen
too rarely to tell the classes apart is equally likely in both. The log-likelihood ratio of a
character is then one number for each observed n-gram, one for each observed context (where the
shared backoff cancels), and 0 elsewhere; ratios of words are sums. Windows of WINDOWS words give
length-normalised ratios; the largest of each size, the whole text's and its log length enter a
logistic calibration. It is fitted on all labelled texts, each scored by models whose counts leave
out its fold of FOLDS.

FIT_ROWS bounds the labelled texts of either class that the model is fitted on, taken by the least
hash of their ids; every text is scored whole. Null texts are scored as empty. Labels that are
null or disagree for a key teach nothing. Without both classes all scores are 0. Repeated rows
give repeated results, and further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.batches import least_hashed, map_arrow, remainder, rows_of, slices, sums, trim, words, written

FIT_ROWS, FOLDS, ORDER, DISCOUNT = 2000, 4, 10, 0.75
WINDOWS = (1, 3, 12)
#: Bits of a symbol. PAD stands ahead of a word and END behind it; a-z follow, all other characters share the 35 that are left.
BITS, PAD, END = 6, 1, 2


def spelt(vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets by word, n-gram keys): each word's ORDER-grams, padded ahead and closed with an end mark.

    Line feeds, which no word holds, part the words; marks are set after characters became symbols,
    so no character of a text can be taken for one.
    """
    if not len(vocabulary):
        return np.zeros(1, np.int64), np.zeros(0, np.int64)
    text = "\n".join(vocabulary.to_pylist()).lower() + "\n"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    end = points == 10
    symbols = np.where((points >= 97) & (points <= 122), points - 94, 29 + points * 11 % 35)
    symbols[end] = END
    word = np.cumsum(end) - end
    place = np.arange(len(points)) + (word + 1) * (ORDER - 1)
    padded = np.full(len(points) + len(vocabulary) * (ORDER - 1), PAD)
    padded[place] = symbols
    keys = np.zeros(len(points), np.int64)
    for k in range(ORDER):
        keys = (keys << BITS) | padded[place - (ORDER - 1) + k]
    return np.concatenate(([0], np.flatnonzero(end) + 1)), keys


def class_counts(documents: DataFrame, label: str, fold: str, text: str) -> DataFrame:
    """gram, and counts named by class and fold, of the labelled texts' n-grams."""
    names = [f"n{y}_{k}" for y in (0, 1) for k in range(FOLDS)]

    def make():
        def run(batches):
            for part, texts in slices(batches, text):
                offsets, codes, vocabulary = words(texts)
                kind = (part.column(label).to_numpy() * FOLDS + part.column(fold).to_numpy())[rows_of(offsets)]
                at, keys = spelt(vocabulary)
                grams, found = np.unique(keys, return_inverse=True)
                each = np.diff(at)
                of_words = (np.bincount(codes[kind == k], minlength=len(vocabulary)) for k in range(2 * FOLDS))
                yield {"gram": grams} | {name: np.bincount(found, np.repeat(n, each), len(grams)).astype(np.int64) for name, n in zip(names, of_words, strict=True)}

        return run

    rows = map_arrow(documents.select(label, fold, text), make, ", ".join(["gram bigint", *(f"{n} bigint" for n in names)]))
    return rows.groupBy("gram").agg(*(F.sum(n).cast("int").alias(n) for n in names))


def shared_backoff(grams: np.ndarray) -> np.ndarray:
    """For each distinct n-gram the probability of its last character after its context without the first one.

    Continuation counts: how many distinct longer n-grams end in a shorter one.
    """
    mask = (1 << BITS) - 1
    lower = np.full(len(grams), 1.0 / (mask + 1))
    for size in range(1, ORDER):
        longer = np.unique(grams & ((1 << BITS * (size + 1)) - 1))
        short, n = np.unique(longer & ((1 << BITS * size) - 1), return_counts=True)
        context, of, types = np.unique(short >> BITS, return_inverse=True, return_counts=True)
        total = np.bincount(of, n)
        at = np.searchsorted(short, grams & ((1 << BITS * size) - 1))
        c = of[at]
        lower = np.maximum(n[at] - DISCOUNT, 0) / total[c] + DISCOUNT * types[c] / total[c] * lower
    return lower


@dataclass
class Ratios:
    """Log-likelihood ratios of the observed n-grams, ascending, and, by each of them, of its context where only that was observed.

    In single precision, as every task holds them.
    """

    grams: np.ndarray
    of_gram: np.ndarray
    of_context: np.ndarray

    @classmethod
    def fit(cls, counts: pd.DataFrame) -> Ratios:
        """counts: gram, n1, n0."""
        counts = counts[counts["n1"] + counts["n0"] > 0].sort_values("gram")
        grams, n = counts["gram"].to_numpy(), {k: counts[k].to_numpy().astype(float) for k in ("n1", "n0")}
        backoff = shared_backoff(grams)
        contexts, of = np.unique(grams >> BITS, return_inverse=True)
        of_gram, of_context = np.zeros(len(grams)), np.zeros(len(contexts))
        for k, sign in (("n1", 1), ("n0", -1)):
            total, types = np.bincount(of, n[k], len(contexts)), np.bincount(of, n[k] > 0, len(contexts))
            weight = np.where(total > 0, DISCOUNT * types / np.maximum(total, 1), 1.0)
            of_gram += sign * np.log(np.maximum(n[k] - DISCOUNT, 0) / np.maximum(total[of], 1) + weight[of] * backoff)
            of_context += sign * np.log(weight)
        return cls(grams, of_gram.astype(np.float32), of_context.astype(np.float32)[of])

    def of_words(self, vocabulary: pa.Array) -> np.ndarray:
        at, keys = spelt(vocabulary)
        if not len(self.grams) or not len(keys):
            return np.zeros(len(vocabulary))
        keys, found = np.unique(keys, return_inverse=True)
        i = np.minimum(np.searchsorted(self.grams, keys), len(self.grams) - 1)
        # the first n-gram of a context
        j = np.minimum(np.searchsorted(self.grams, keys >> BITS << BITS), len(self.grams) - 1)
        ratio = np.where(self.grams[i] == keys, self.of_gram[i], np.where(self.grams[j] >> BITS == keys >> BITS, self.of_context[j], 0.0)).astype(float)
        return sums(ratio[found], at)


def window_features(ratios: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """By row: the largest mean ratio of WINDOWS words, the whole text's mean, and the log of its length."""
    n = np.diff(offsets)
    out = np.zeros((len(n), len(WINDOWS) + 2))
    full = n > 0
    total = np.concatenate(([0.0], np.cumsum(ratios)))
    row = rows_of(offsets)
    for k, size in enumerate(WINDOWS):
        end = np.minimum(np.arange(len(ratios)) + size, offsets[1:][row])
        mean = (total[end] - total[:-1]) / size
        if len(mean):
            out[full, k] = np.maximum.reduceat(mean, offsets[:-1][full])
    out[full, -2] = (total[offsets[1:]] - total[offsets[:-1]])[full] / n[full]
    out[:, -1] = np.log1p(n)
    return out


def featured(documents: DataFrame, model, text: str, extra: list[str], name: str = "x") -> DataFrame:
    """extra columns and, under name, the window features of each text."""

    def make():
        ratios = model.value

        def run(batches):
            for part, texts in slices(batches, text):
                offsets, codes, vocabulary = words(texts)
                yield {c: part.column(c) for c in extra} | {name: list(window_features(ratios.of_words(vocabulary)[codes], offsets))}

        return run

    fields = [f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in extra]
    return map_arrow(documents.select(*dict.fromkeys([*extra, text])), make, ", ".join([*fields, f"`{name}` array<double>"]))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, scales, weights with the intercept last) by Newton's method; the ridge is a fixed prior, which matters less the more texts there are."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        penalty = np.full(len(w), ridge)
        penalty[-1] = 0
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (p - y) + penalty * w)
        w -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return mean, scale, w


class Toxicity:
    """A fitted scorer: fit once, score any number of tables."""

    def __init__(self, ratios: Ratios | None, calibration: tuple | None):
        self.ratios, self.calibration = ratios, calibration

    @classmethod
    def fit(cls, documents: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id", rows: int = FIT_ROWS) -> Toxicity:
        known = labels.groupBy(key).agg(F.min(label).alias("y"), F.max(label).alias("y_most")).filter(F.col("y").isin(0, 1) & (F.col("y") == F.col("y_most"))).select(key, "y", F.xxhash64(key).alias("h"))
        of_class = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
        chosen = [r for y in (1, 0) for r in least_hashed(known.filter(F.col("y") == y), "h", key, rows, of_class.get(y, 0)).collect()]
        spark = documents.sparkSession
        kind = labels.schema[key].dataType.simpleString()
        # at most 2 * rows ids: small enough to send everywhere
        ids = spark.createDataFrame([(r[key], int(r["y"]), r["h"] % FOLDS) for r in chosen], f"own_key {kind}, own_label int, own_fold int")
        sample = written(documents.select(F.col(key).alias("own_key"), F.col(text).alias("own_text")).join(F.broadcast(ids), "own_key").drop("own_key"))
        table = class_counts(sample, "own_label", "own_fold", "own_text").toArrow()
        counts = {c: table.column(c).to_numpy() for c in table.column_names}
        del table
        by_class = {y: sum(counts[f"n{y}_{k}"] for k in range(FOLDS)) for y in (0, 1)}
        if not by_class[0].any() or not by_class[1].any():
            return cls(None, None)
        held = []
        # a fold's model at a time, here and in the executors
        for k in range(FOLDS):
            model = spark.sparkContext.broadcast(Ratios.fit(pd.DataFrame({"gram": counts["gram"]} | {f"n{y}": by_class[y] - counts[f"n{y}_{k}"] for y in (0, 1)})))
            trim()
            held.append(featured(sample.filter(F.col("own_fold") == k), model, "own_text", ["own_label"]).toPandas())
            model.destroy()
        ratios = Ratios.fit(pd.DataFrame({"gram": counts["gram"], "n0": by_class[0], "n1": by_class[1]}))
        del counts, by_class
        trim()
        held = pd.concat(held)
        return cls(ratios, logistic(np.array(held["x"].tolist()), held["own_label"].to_numpy()))

    def score(self, documents: DataFrame, text: str = "text", extra: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
        """extra columns and, under a name that is none of theirs, a score from 0 to 1 of every row."""
        if self.calibration is None:
            return documents.select(*extra, F.lit(0.0).alias(name))
        mean, scale, w = self.calibration
        rows = featured(documents, documents.sparkSession.sparkContext.broadcast(self.ratios), text, list(extra), name)
        z = F.lit(float(w[-1]))
        for k in range(len(mean)):
            z = z + (F.col(name)[k] - float(mean[k])) * float(w[k] / scale[k])
        return rows.select(*extra, (1 / (1 + F.exp(-z))).alias(name))


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every text; labels of keys with crc32 mod 5 = 0 are not learnt from."""
    model = Toxicity.fit(documents, labels.filter(remainder("doc_id", 5) != 0))
    return model.score(documents).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
