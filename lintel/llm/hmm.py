"""A hidden Markov language model over words, and the add-one unigram base it is held against.

Words are lower-cased (A-Z) runs without white space; every text ends in one end token. The HEAD
most frequent words of the training texts have emission probabilities of their own, all others
share one event, within which a word's probability is its add-one estimate among them. The chain
starts from seeded random deviations from the unigram model; rounds of Baum-Welch run over all
training texts, their expected counts added up over the partitions, until their likelihood settles.
A text's score is its exact likelihood by the scaled forward recursion.

Counts rest on every training text. The KNOWN most frequent words' counts, a bounded number, go to
all tasks; the counts of rarer words are joined to the texts that hold them, so no hot word is
shuffled and nothing that grows with the corpus is sent everywhere or held by one process.

Null texts count as empty: an end token alone. Texts are read whole. Repeated rows give repeated
results. Without training texts every word is unknown.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.batches import map_arrow, remainder, rows_of, slices, sums, trim, words, written

STATES, HEAD, KNOWN, SEED = 8, 40_000, 200_000, 11
#: The likelihood has settled once a round gains no more than this share of it.
SETTLED = 5e-4
ONES = np.ones(STATES)
#: Every so many tokens a text's vectors are scaled; no product of so many probabilities leaves the doubles.
SCALED = 8
SLICE = 6 << 20
#: Tokens of a long text, which is put with others of its kind until they have so many together.
LONG, TOKENS = 1500, 800_000
#: Texts at a place, up to which it is done together with others.
FEW = 64
#: Events whose counts of a task are handed on in one row.
PART = 512
PARTED = "part int, seen binary, sums binary"
#: Vectors whose states are parted at a time, which stay in the processor's cache.
TURNED = 512
END = "\n"  # no word
LOG = logging.getLogger(__name__)
SMOOTHING = 4.0


def word_counts(documents: DataFrame, text: str) -> DataFrame:
    """word, c: tokens of all texts, the end tokens too."""

    def make():
        def run(batches):
            for part, texts in slices(batches, text, SLICE):
                _, codes, vocabulary = words(texts)
                yield {"word": pa.concat_arrays([vocabulary, pa.array([END])]), "n": np.append(np.bincount(codes, minlength=len(vocabulary)), len(texts))}

        return run

    return map_arrow(documents.select(text), make, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Vocabulary:
    """Frequent words with their counts, most frequent first; totals of all and of the words beyond HEAD."""

    known: pa.Array
    counts: np.ndarray
    tokens: int
    distinct: int

    @classmethod
    def of(cls, counted: DataFrame) -> Vocabulary:
        n = counted.agg(F.sum("c").alias("tokens"), F.count("*").alias("distinct")).first()
        # the least count that at most KNOWN words have or exceed; there are at most as many counts as the root of twice the tokens
        each = counted.filter("c > 1").groupBy("c").agg(F.count("*").alias("words")).toPandas().sort_values("c", ascending=False)
        within = each[(each["words"].cumsum() <= KNOWN).to_numpy()]
        least = int(within["c"].min()) if len(within) else 1 << 62
        least = 1 if (n["distinct"] or 0) <= KNOWN else least
        top = counted.filter(F.col("c") >= least).toPandas().sort_values(["c", "word"], ascending=[False, True])
        return cls(pa.array(top["word"].tolist(), pa.string()), top["c"].to_numpy(np.int64), n["tokens"] or 0, n["distinct"])

    def __post_init__(self):
        self.head = self.known.slice(0, HEAD)
        self.n_head = len(self.head)
        end = pc.index(self.head, END).as_py() if self.n_head else -1
        #: Events: words of the head, then the shared event of all others, then the end where it isn't in the head.
        self.other, self.end = self.n_head, end if end >= 0 else self.n_head + 1
        self.events = self.n_head + 2
        self.rest_tokens = self.tokens - int(self.counts[: self.n_head].sum())
        self.rest_distinct = self.distinct - self.n_head

    def rest_log(self) -> float:
        return float(np.log10(self.rest_tokens + self.rest_distinct + 1))

    def base_log(self) -> float:
        return float(np.log10(self.tokens + self.distinct + 1))

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """(offsets, events, word codes with -1 for ends, vocabulary)"""
        offsets, codes, vocabulary = words(texts)
        event = pc.fill_null(pc.index_in(vocabulary, self.head), self.other).to_numpy(zero_copy_only=False).astype(np.int64)
        codes = np.insert(codes, offsets[1:], -1)
        offsets = offsets + np.arange(len(offsets))
        return offsets, np.append(event, self.end)[codes], codes, vocabulary

    def code(self) -> np.dtype:
        return np.min_scalar_type(self.events)

    def unigram(self) -> np.ndarray:
        p = np.append(self.counts[: self.n_head].astype(float), [max(self.rest_tokens, 1), 0]) + 0.5
        return p / p.sum()


def places(sizes: np.ndarray) -> np.ndarray:
    """Ends of the places of texts of these sizes, longest first, whose tokens are laid by their place in the text."""
    alive = np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0))), "left")  # texts longer than t
    return np.concatenate(([0], np.cumsum(alive)))


def laid(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens laid by their place in the text, longer texts first: (texts in that order, ends of places, each token's index)."""
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    ends = places(sizes[order])
    alive = np.diff(ends)
    rank = np.arange(ends[-1]) - np.repeat(ends[:-1], alive)
    return order, ends, offsets[:-1][order][rank] + np.repeat(np.arange(len(alive)), alive)


def lasts(ends: np.ndarray) -> np.ndarray:
    """Where the last tokens of laid texts lie, those of texts without tokens left out."""
    alive = np.diff(ends)
    rank = np.arange(alive[0] if len(alive) else 0)
    return ends[np.searchsorted(-alive, -rank, "left") - 1] + rank


class Space:
    """Arrays of vectors that one batch after another is worked out in: fresh ones would be cleared by the system each time."""

    held: dict[str, np.ndarray] = {}

    @classmethod
    def of(cls, name: str, n: int) -> np.ndarray:
        if name not in cls.held or len(cls.held[name]) < n:
            cls.held[name] = np.empty((n + n // 8, STATES))
        return cls.held[name][:n]

    @classmethod
    def clear(cls) -> None:
        cls.held.clear()
        trim()


@dataclass
class Chain:
    """Start, transition and emission probabilities; emissions have a row for each event."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray

    @classmethod
    def first(cls, vocabulary: Vocabulary) -> Chain:
        rng = np.random.default_rng(SEED)
        emit = vocabulary.unigram()[:, None] * rng.uniform(0.5, 1.5, (vocabulary.events, STATES))
        step = np.full((STATES, STATES), 0.3 / STATES) + 0.7 * np.eye(STATES)
        return cls(np.full(STATES, 1 / STATES), step, emit / emit.sum(0))

    def forward(self, offsets: np.ndarray, events: np.ndarray, keep: bool = False):
        """(log likelihood by text, scaled forward vectors, scales, 1 where none is), all texts a token at a time together; the latter two as laid().

        The vectors, which are there with keep alone, lie in a space that the next call overwrites.
        """
        order, ends, place = laid(offsets)
        own, alphas, scales = self.along(ends, events[place])
        out = np.zeros(len(order))
        out[order[: len(own)]] = own
        return out, alphas if keep else None, scales

    def along(self, ends: np.ndarray, events: np.ndarray):
        """As forward(), of laid texts, those without tokens left out."""
        alphas, bounds = self.emit.take(events, 0, Space.of("alphas", len(events)), "clip"), ends.tolist()
        scales, step = np.ones(len(alphas)), self.step
        out = np.zeros(bounds[1] if len(bounds) > 1 else 0)
        before, moved = None, np.empty((len(out), STATES))
        for at, (low, high) in enumerate(zip(bounds, bounds[1:])):
            # a place's emissions turn into its forward vectors
            alpha = alphas[low:high]
            alpha *= self.start if before is None else np.matmul(before[: high - low], step, out=moved[: high - low])
            if not at % SCALED:
                scale = np.matmul(alpha, ONES, out=scales[low:high])
                alpha *= np.reciprocal(scale)[:, None]
                out[: high - low] += np.log(scale)
            before = alpha
        out += np.log(alphas[lasts(ends)] @ ONES)
        return out, alphas, scales

    def expected(self, offsets: np.ndarray, events: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts, transitions and emissions (by event) of texts: one E-step."""
        return self.judged(offsets, events)[1:]

    def judged(self, offsets: np.ndarray, events: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """The texts' log likelihood, and as expected()."""
        _, ends, place = laid(offsets)
        return self.counted(ends, events[place])

    def counted(self, ends: np.ndarray, events: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """As judged(), of laid texts."""
        events = events.astype(np.intp, copy=False)
        likelihood, alphas, scales = self.along(ends, events)
        last, bounds, back = lasts(ends), ends.tolist(), np.ascontiguousarray(self.step.T)
        aheads = self.emit.take(events, 0, Space.of("aheads", len(events)), "clip")
        for low, high in zip(bounds[:-1:SCALED], bounds[1::SCALED]):
            aheads[low:high] *= np.reciprocal(scales[low:high])[:, None]
        final = np.reciprocal(alphas[last] @ ONES)[:, None]
        aheads[last] *= final
        alphas[last] *= final  # with it all products of vectors ahead and back add up to one
        moves, ahead = np.zeros((STATES, STATES)), None
        # places of few texts come first, of which there are many: what can be done for all of them together is
        alive = np.diff(ends)
        many = int((alive > FEW).sum())
        for low, high in zip(bounds[-2:many - 1 if many else None:-1], bounds[:many:-1]):
            own = aheads[low:high]
            if ahead is not None:
                own[: len(ahead)] *= ahead @ back
            ahead = own
        if len(alive) > many + 1:
            first = bounds[many + 1]
            before = np.arange(first, len(events)) - np.repeat(alive[many:-1], alive[many + 1 :])
            alpha = alphas.take(before, 0)
            moves += alpha.T @ aheads[first:]
            alphas[before] = alpha * (aheads[first:] @ back)
        moved = np.empty((len(likelihood), STATES))
        for low, high in zip(bounds[:many][::-1], bounds[1 : many + 1][::-1]):
            # a place's scaled emissions turn into what the place before it looks ahead to
            own = aheads[low:high]
            if ahead is not None:
                more = len(ahead)
                alpha = alphas[low : low + more]
                moves += alpha.T @ ahead
                beta = np.matmul(ahead, back, out=moved[:more])
                own[:more] *= beta
                alpha *= beta
            ahead = own
        # by state, in the space of the vectors ahead, which are done with
        columns = Space.of("aheads", len(events)).reshape(STATES, len(events))
        for low in range(0, len(events), TURNED):
            columns[:, low : low + TURNED] = alphas[low : low + TURNED].T
        emitted = np.stack([np.bincount(events, column, len(self.emit)) for column in columns], 1)
        return float(likelihood.sum()), alphas[: bounds[min(1, len(bounds) - 1)]].sum(0), moves * self.step, emitted

    @classmethod
    def of(cls, start: np.ndarray, moves: np.ndarray, emitted: np.ndarray, vocabulary: Vocabulary) -> Chain:
        """The M-step; a little of the unigram model keeps every event possible."""
        start, moves = start + 0.1, moves + 0.1
        weight = SMOOTHING * np.sqrt(emitted.sum(0) + 1)
        emit = emitted + vocabulary.unigram()[:, None] * weight
        return cls(start / start.sum(), moves / moves.sum(1, keepdims=True), emit / emit.sum(0))


def coded(documents: DataFrame, shared, text: str) -> DataFrame:
    """sizes, events: of some texts at a time, longest first, the tokens of each and the events of all as laid(), the former as bytes of 32-bit numbers, the latter of the shortest that hold all events.

    Texts of more than LONG tokens are put together apart from the rest, as texts that are read
    a token at a time together should be about equally long.
    """

    def part_of(offsets: np.ndarray, events: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.diff(offsets)
        return sizes[pick], events[np.repeat(pick, sizes)].astype(shared.value.code())

    def together(*parts: tuple[np.ndarray, np.ndarray]) -> dict[str, list[bytes]]:
        sizes, events = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, _, place = laid(np.concatenate(([0], np.cumsum(sizes))))
        return {"sizes": [sizes[order].astype(np.int32).tobytes()], "events": [events[place].tobytes()]}

    def make():
        def run(batches):
            held: list[tuple[np.ndarray, np.ndarray]] = []
            for _, texts in slices(batches, text, SLICE):
                offsets, events, _, _ = shared.value.read(texts)
                long = np.diff(offsets) > LONG
                yield together(part_of(offsets, events, ~long))
                held.append(part_of(offsets, events, long))
                if sum(len(x[1]) for x in held) > TOKENS:
                    yield together(*held)
                    held = []
            if held:
                yield together(*held)

        return run

    return map_arrow(documents.select(text), make, "sizes binary, events binary")


def parted(table: np.ndarray) -> dict[str, list]:
    """part, seen, sums: of PART rows of a table at a time the numbers of those that aren't all zero, and these, as bytes."""
    seen = np.flatnonzero(table.any(1)).astype(np.int32)
    parts, first = np.unique(seen // PART, return_index=True)
    bounds = [*first.tolist(), len(seen)]
    pieces = [seen[low:high] for low, high in zip(bounds, bounds[1:])]
    return {"part": parts, "seen": [x.tobytes() for x in pieces], "sums": [table[x].tobytes() for x in pieces]}


def add_parts(table: np.ndarray, seen, sums) -> None:
    """Adds what parted() gave to the table."""
    for rows, own in zip(seen, sums, strict=True):
        table[np.frombuffer(rows, np.int32)] += np.frombuffer(own).reshape(-1, STATES)


def added(tables: DataFrame, n: int) -> np.ndarray:
    """The sum of tables of n rows, each dealt to rows as parted(): a part's are added up in one task, as a stream."""

    def make():
        def run(batches):
            table = np.zeros((n, STATES))
            for batch in batches:
                add_parts(table, *([x.as_buffer() for x in batch.column(c)] for c in ("seen", "sums")))
            yield parted(table)

        return run

    rows = map_arrow(tables.repartition("part"), make, PARTED).collect()
    table = np.zeros((n, STATES))
    add_parts(table, [r.seen for r in rows], [r.sums for r in rows])
    return table


def trained(documents: DataFrame, vocabulary: Vocabulary, text: str = "text") -> Chain:
    """Baum-Welch over all rows until their likelihood settles: expected counts of each partition are added up by event."""
    context = documents.sparkSession.sparkContext
    texts = written(coded(documents, context.broadcast(vocabulary), text))
    chain, before, n_events = Chain.first(vocabulary), None, vocabulary.events
    # a row of sums by state for each event, then starts, transitions from each state, and the likelihood
    n, code = n_events + 2 + STATES, vocabulary.code()
    while True:
        model = context.broadcast(chain)

        def make(model=model):
            def run(batches):
                table = np.zeros((n, STATES))
                for batch in batches:
                    for sizes, events in zip(batch.column("sizes"), batch.column("events"), strict=True):
                        own = model.value.counted(places(np.frombuffer(sizes.as_buffer(), np.int32)), np.frombuffer(events.as_buffer(), code))
                        for at, part in zip((slice(n - 1, n), slice(n_events, n_events + 1), slice(n_events + 1, n - 1), slice(n_events)), own, strict=True):
                            table[at] += part
                Space.clear()
                yield parted(table)

            return run

        table = added(map_arrow(texts, make, PARTED), n)
        model.unpersist()
        after = table[-1, 0] / max(vocabulary.tokens, 1)
        LOG.info("mean log likelihood of a token: %.5f", after)
        if before is not None and after - before <= SETTLED * abs(before):
            return chain
        before, chain = after, Chain.of(table[n_events], table[n_events + 1 : -1], table[:n_events], vocabulary)


def scored_rows(documents: DataFrame, vocabulary: Vocabulary, chain: Chain) -> DataFrame:
    """Of each text: row, doc_id, n_tokens, and of its frequent words n_known, base, score; rare: its other words and how often."""
    context = documents.sparkSession.sparkContext
    shared, model = context.broadcast(vocabulary), context.broadcast(chain)

    def make():
        v = shared.value

        def run(batches):
            row = TaskContext.get().partitionId() << 33
            base, rest = v.base_log(), v.rest_log()
            for part, texts in slices(batches, "text", SLICE):
                offsets, events, codes, vocabulary_ = v.read(texts)
                at = pc.fill_null(pc.index_in(pa.concat_arrays([vocabulary_, pa.array([END])]), v.known), -1).to_numpy(zero_copy_only=False)
                logs = np.where(at >= 0, np.log10(v.counts[at] + 1.0) if len(v.counts) else 0.0, 0.0)
                n = np.diff(offsets)
                known = sums((at >= 0)[codes], offsets)
                score = model.value.forward(offsets, events)[0] / np.log(10)
                beyond = np.where(events == v.other, logs[codes], 0.0)
                others = sums(events == v.other, offsets)
                rare = np.flatnonzero(at[codes] < 0)
                rare = rare[codes[rare] >= 0] if v.distinct else rare[:0]
                pair, first = pd.factorize(rows_of(offsets)[rare] * np.int64(len(vocabulary_) + 1) + codes[rare])
                times = np.bincount(pair, minlength=len(first))
                of_row, word = first // (len(vocabulary_) + 1), first % (len(vocabulary_) + 1)
                ends = np.searchsorted(of_row, np.arange(len(n) + 1))
                lists = pa.StructArray.from_arrays([vocabulary_.take(pa.array(word)), pa.array(times, pa.int32())], ["word", "times"])
                yield {
                    "row": row + np.arange(len(n)),
                    "doc_id": part.column("doc_id"),
                    "n_tokens": n,
                    "n_known": known,
                    "base": sums(logs[codes], offsets) - n * base,
                    "score": score + sums(beyond, offsets) - others * rest,
                    "rare": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lists),
                }
                row += len(n)
            Space.clear()

        return run

    return map_arrow(documents.select("doc_id", "text"), make, "row bigint, doc_id bigint, n_tokens bigint, n_known bigint, base double, score double, rare array<struct<word:string,times:int>>")


def scored(documents: DataFrame, learn_from: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of documents."""
    counted = written(word_counts(learn_from, "text"))
    vocabulary = Vocabulary.of(counted)
    chain = trained(learn_from, vocabulary)
    rows = written(scored_rows(documents, vocabulary, chain))
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times")
    found = rare.join(counted, "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("gain"))
    gain = F.coalesce("gain", F.lit(0.0))
    return rows.drop("rare").join(found, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + gain).alias("base_score"),
        (F.col("score") + gain).alias("score"),
    )


def judged(documents: DataFrame) -> DataFrame:
    """As scored, with held_out; rows with crc32 mod 7 = 2 are not learnt from."""
    held = remainder("doc_id", 7) == 2
    return scored(documents, documents.filter(~held)).withColumn("held_out", held).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
